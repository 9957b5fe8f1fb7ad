"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is a BPE model with byte fallback, read from a file. Merges are taken from an agenda, the best score first, the
leftmost among equals. With dropout, a candidate merge is skipped if a keyed hash says so: the key is made of the seed, the
chunk's text and its occurrence (the text's id, its copy number and the place), the hash takes the place and size of both parts. So a text's pieces vary with the
seed and from one occurrence of a word to the next, but are the same on every run; whatever is skipped, pieces spell the text,
and decoding gives it back byte by byte. Without dropout the pieces are those of the SentencePiece library.

No piece holds a space mark after another character, so texts are cut into chunks, a run of spaces and what follows,
that are merged alone. Workers remember, up to a bound, the pieces of chunks without dropout and the merges that lead to
them: an occurrence that skips none of these has these pieces. The others are merged together in arrays, one step of
every chunk's agenda at a time; long ones alone, with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import REMEMBERED, hold_batches, lean, mix, slices

VOCABULARIES = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
SEED, DROPOUT = 23, 0.1
LANES = 4  # occurrences that the tests try; nothing is cut to so many
CACHE_BYTES = 24 << 20  # of remembered chunks, pieces and merges in a worker
LONG = 48  # characters from which a chunk has a heap of its own
MARK = "▁"  # fixed value: how a space is written in a piece
M64 = (1 << 64) - 1
NEVER = 1 << 24  # past every place in the agenda's order
PLACE, LEFT, RIGHT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9  # odd factors of the keyed hash


class Codec:
    def __init__(self, path: str, dropout: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.seed, self.limit = dropout, seed, int(dropout * 2.0**64)
        self.table: dict[str, tuple[float, int]] = {}
        self.spelled: list[bytes] = []  # the bytes that each id stands for
        self.byte_ids = [0] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelled.append(b"")
            else:
                self.table[piece] = (-model.get_score(i), i)
                self.spelled.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.table):
            raise ValueError("a piece of this model spans a space inside; chunks can't be merged alone")
        lines = not any("\n" in p for p in self.table)
        self.chunks = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if lines else rf"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.held = 0  # bytes in known
        self.known: dict[str, tuple[bytes, bytes]] = {}  # pieces without dropout, and the codes of the merges that lead to them
        self._tabulate()

    def _tabulate(self) -> None:
        """The merges as arrays: for two neighbouring symbols, the agenda's order and the merged symbol."""
        number = {piece: i for piece, (_, i) in self.table.items()}
        for char in sorted({c for piece in self.table for c in piece}):  # a character that only occurs in longer pieces
            number.setdefault(char, len(self.spelled) + len(number))
        self.symbols = max(number.values(), default=0) + 2
        order = {score: i for i, score in enumerate(sorted({score for score, _ in self.table.values()}))}
        merges = [(number[p[:k]] * self.symbols + number[p[k:]], order[score], i) for p, (score, i) in self.table.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.pairs, self.orders, self.merged = np.array(sorted(merges), dtype=np.int64).reshape(-1, 3).T
        self.maybe = np.zeros(1 << 22, dtype=bool)  # rules out most pairs without a search
        self.maybe[self._slot(self.pairs)] = True
        self.symbol_of = np.full(0x110000, self.symbols - 1, dtype=np.int64)  # the last symbol merges with nothing
        for char, i in number.items():
            if len(char) == 1:
                self.symbol_of[ord(char)] = i

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs.astype(np.uint64)) >> np.uint64(42)).astype(np.int64)

    def candidates(self, keys: np.ndarray | None, at: np.ndarray, origin: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agenda's order (or one past all) and the symbol of merging the parts left and right. keys, at: of the characters, of which each part's first is its origin."""
        pairs = symbols[left] * self.symbols + symbols[right]
        order, merged = np.full(len(left), NEVER), np.zeros(len(left), dtype=np.int64)
        some = np.flatnonzero(self.maybe[self._slot(pairs)])
        found = np.minimum(np.searchsorted(self.pairs, pairs[some]), len(self.pairs) - 1)
        hit = self.pairs[found] == pairs[some]
        some, found = some[hit], found[hit]
        if keys is not None:
            begin = origin[left[some]]
            stay = ~self.skips(keys[begin], merge_codes(at[begin], sizes[left[some]], sizes[right[some]]))
            some, found = some[stay], found[stay]
        order[some], merged[some] = self.orders[found], self.merged[found]
        return order, merged

    def skips(self, keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return mix(keys ^ codes) < np.uint64(min(self.limit, M64))

    def keys_of(self, chunks: list[str], occurrences: np.ndarray) -> np.ndarray:
        """The keys of occurrences of chunks."""
        return mix(np.array([xxhash.xxh64_intdigest(c, self.seed) for c in chunks], dtype=np.uint64) + occurrences)

    def merge_many(self, chunks: list[str], occurrences: list[int]) -> list[bytes]:
        """The ids of each chunk, as merge() gives them."""
        return self._merged(chunks, self.keys_of(chunks, np.array(occurrences, dtype=np.uint64)) if self.limit else None)[0]

    def _merged(self, chunks: list[str], key: np.ndarray | None) -> tuple[list[bytes], list[bytes]]:
        """The ids of each chunk under its key, or without dropout; and, without, the codes of the merges of chunks that aren't long."""
        lengths = np.array([len(c) for c in chunks])
        out, codes = [b""] * len(chunks), [b""] * len(chunks)
        alone = range(len(chunks)) if not len(self.pairs) else np.flatnonzero(lengths >= LONG).tolist()
        for i in alone:
            out[i] = self._merge(chunks[i], None if key is None else int(key[i]))
        short = np.flatnonzero(lengths < LONG)
        if not len(short) or not len(self.pairs):
            return out, codes
        picked = [chunks[i] for i in short.tolist()]
        points = np.frombuffer("".join(picked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        chunk = np.repeat(np.arange(len(short)), lengths[short])
        at = np.arange(len(points)) - np.repeat(np.cumsum(lengths[short]) - lengths[short], lengths[short])
        # one row for each part: chunk, first character, size, symbol, agenda order and symbol of merging with the next
        keys, origin = None if key is None else key[short][chunk], np.arange(len(points))
        sizes, symbols = np.ones(len(points), dtype=np.int64), self.symbol_of[points]
        order, merged = np.full(len(points), NEVER), np.zeros(len(points), dtype=np.int64)
        left = np.flatnonzero(chunk[1:] == chunk[:-1])
        order[left], merged[left] = self.candidates(keys, at, origin, sizes, symbols, left, left + 1)
        done, made = [], []
        while len(chunk):
            first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            count = np.diff(np.append(first, len(chunk)))
            best = np.minimum.reduceat(order * len(chunk) + np.arange(len(chunk)), first)
            live = best < NEVER * len(chunk)
            stays = np.repeat(live, count)
            over = np.flatnonzero(~stays)
            done.append(np.stack([chunk[over], symbols[over], points[origin[over]]]))
            i = best[live] % len(chunk)
            if keys is None:
                made.append((chunk[i], merge_codes(at[origin[i]], sizes[i], sizes[i + 1])))
            symbols[i], sizes[i] = merged[i], sizes[i] + sizes[i + 1]
            stays[i + 1] = False
            left = np.flatnonzero(stays)
            chunk, origin, sizes, symbols, order, merged = (x[left] for x in (chunk, origin, sizes, symbols, order, merged))
            i = np.searchsorted(left, i)
            again = np.concatenate([i, i[i > 0] - 1])
            order[again] = NEVER
            again = again[(again + 1 < len(chunk))]
            again = again[chunk[again] == chunk[again + 1]]
            order[again], merged[again] = self.candidates(keys, at, origin, sizes, symbols, again, again + 1)
        chunk, symbols, points = np.concatenate(done, axis=1)
        by = np.argsort(chunk, kind="stable")
        chunk, symbols, points = chunk[by], symbols[by], points[by]
        unknown = symbols >= len(self.spelled)
        spelled = {p: [self.byte_ids[b] for b in chr(p).encode("utf-8", "surrogatepass")] for p in np.unique(points[unknown]).tolist()}
        times = np.ones(len(symbols), dtype=np.int64)
        times[unknown] = [len(spelled[p]) for p in points[unknown].tolist()]
        ids = np.repeat(symbols, times).astype("<i4")
        starts = np.cumsum(times) - times
        for k, p in zip(starts[unknown].tolist(), points[unknown].tolist(), strict=True):
            ids[k : k + len(spelled[p])] = spelled[p]
        ends = (np.cumsum(np.bincount(chunk, times, len(short))) * 4).astype(np.int64).tolist()
        raw, start = ids.tobytes(), 0
        for i, end in zip(short.tolist(), ends, strict=True):
            out[i] = raw[start:end]
            start = end
        if made:
            of = np.concatenate([x for x, _ in made])
            raw = np.concatenate([x for _, x in made])[np.argsort(of, kind="stable")].tobytes()
            ends = (np.cumsum(np.bincount(of, minlength=len(short))) * 8).tolist()
            for i, start, end in zip(short.tolist(), [0, *ends], ends, strict=False):
                codes[i] = raw[start:end]
        return out, codes

    def skipped(self, key: int, at: int, left: int, right: int) -> bool:
        x = (key ^ (at * PLACE + left * LEFT + right * RIGHT)) & M64
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & M64
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & M64
        return x ^ (x >> 32) < self.limit

    def merge(self, chunk: str, occurrence: int) -> bytes:
        """The ids of one occurrence of a chunk, as 4-byte numbers."""
        return self._merge(chunk, int(self.keys_of([chunk], np.array([occurrence], dtype=np.uint64))[0]) if self.limit else None)

    def _merge(self, chunk: str, key: int | None) -> bytes:
        parts, table = list(chunk), self.table
        n = len(parts)
        following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if found := table.get(parts[i] + parts[i + 1]):
                agenda.append((found[0], i, i + 1, parts[i] + parts[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, merged = heapq.heappop(agenda)
            if not parts[i] or following[i] != j or j >= n or len(parts[i]) + len(parts[j]) != len(merged):
                continue  # one of the two has merged with another part meanwhile
            if key is not None and self.skipped(key, i, len(parts[i]), len(parts[j])):
                continue
            parts[i], parts[j] = merged, ""
            after = following[i] = following[j]
            if after < n:
                preceding[after] = i
                if found := table.get(merged + parts[after]):
                    heapq.heappush(agenda, (found[0], i, after, merged + parts[after]))
            before = preceding[i]
            if before >= 0 and (found := table.get(parts[before] + merged)):
                heapq.heappush(agenda, (found[0], before, i, parts[before] + merged))
        ids: list[int] = []
        for part in parts:
            if part:
                if found := table.get(part):
                    ids.append(found[1])
                else:
                    ids.extend(self.byte_ids[b] for b in part.encode())
        return np.array(ids, dtype="<i4").tobytes()

    def cut(self, text: str) -> list[str | None]:
        """The chunks of a text. A space mark that the text itself holds is a chunk of its own, None."""
        chunks: list = []
        for i, part in enumerate(text.split(MARK) if text else ()):
            chunks += [None] if i else []
            chunks += self.chunks((MARK if not i else "") + part.replace(" ", MARK))
        return chunks

    def plain(self, chunks: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Pieces and merge codes without dropout."""
        mark = np.array([self.byte_ids[b] for b in MARK.encode()], dtype="<i4").tobytes()
        new: dict[str | None, tuple[bytes, bytes]] = {None: (mark, b"")}
        missing = [c for c in chunks if c is not None and c not in self.known]
        for at in range(0, len(missing), 1 << 16):  # bounds the arrays
            part = missing[at : at + (1 << 16)]
            new.update(zip(part, zip(*self._merged(part, None), strict=True), strict=True))
        out = [self.known.get(c) or new[c] for c in chunks]
        for c in missing:
            size = 4 * len(c) + len(new[c][0]) + len(new[c][1]) + 150
            if self.held + size > CACHE_BYTES:
                break
            if len(c) < LONG:
                self.known[c] = new[c]
                self.held += size
        return out

    def encode_many(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """The ids of each text. A space mark that a text itself holds is spelled in bytes, so it isn't taken for a space."""
        cuts = [self.cut(t) for t in texts]
        number: dict[str | None, int] = {}
        which = np.array([number.setdefault(c, len(number)) for chunks in cuts for c in chunks], dtype=np.int64)
        distinct = list(number)
        known = self.plain(distinct)
        found = [known[i][0] for i in which.tolist()]
        if self.limit and distinct:
            occurrences = np.concatenate([mix(np.arange(len(c), dtype=np.uint64) + np.uint64(k & M64)) for c, k in zip(cuts, keys, strict=True)])
            own = np.array([xxhash.xxh64_intdigest(c or "", self.seed) for c in distinct], dtype=np.uint64)
            codes = np.frombuffer(b"".join([x for _, x in known]), dtype=np.uint64)
            counts = np.array([len(x) // 8 for _, x in known])
            begins = np.cumsum(counts) - counts
            long = np.array([c is not None and (len(c) >= LONG or not len(self.pairs)) for c in distinct])
            for at in range(0, len(which), 1 << 16):  # bounds the arrays
                kind = which[at : at + (1 << 16)]
                key, n = mix(own[kind] + occurrences[at : at + (1 << 16)]), counts[kind]
                owner = np.repeat(np.arange(len(kind)), n)
                code = codes[np.arange(len(owner)) + np.repeat(begins[kind] - (np.cumsum(n) - n), n)]
                other = long[kind]
                other[owner[self.skips(np.repeat(key, n), code)]] = True
                other = np.flatnonzero(other)
                ids, _ = self._merged([distinct[k] for k in kind[other].tolist()], key[other])
                for i, x in zip((other + at).tolist(), ids, strict=True):
                    found[i] = x
        ends = np.cumsum([len(c) for c in cuts]).tolist()
        return [np.frombuffer(b"".join(found[a:b]), dtype="<i4") for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_many([text], [key])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def merge_codes(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What the keyed hash takes of a merge: the place and the sizes of both parts."""
    return at.astype(np.uint64) * np.uint64(PLACE) + left.astype(np.uint64) * np.uint64(LEFT) + right.astype(np.uint64) * np.uint64(RIGHT)


_codecs: dict[tuple, Codec] = {}
REMEMBERED.append(_codecs)


def codec(vocabularies: str, dropout: float, seed: int) -> Codec:
    """One for each worker and set of parameters."""
    wanted = (os.path.join(vocabularies, MODEL), dropout, seed)
    if wanted not in _codecs:
        _codecs.clear()
        _codecs[wanted] = Codec(*wanted)
    return _codecs[wanted]


def text_keys(ids: pa.Array, copies: pa.Array | None = None) -> list[int]:
    """One for each text id and number of its copy."""
    keys = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if copies is not None:
        keys = keys + copies.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(RIGHT)
    return mix(keys).tolist()


def encoded(documents: DataFrame, dropout: float = DROPOUT, seed: int = SEED, vocabularies: str = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text", by_copy: bool = False) -> DataFrame:
    """One row per row of documents: doc_id and ids, the pieces of the whole text (array of int).

    A null or empty text has no pieces. A null id is a key like any other; repeated rows have the same pieces, or with
    by_copy each its own, by the row's number among the rows of its id and text. An empty
    table gives no rows; extra columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabularies, dropout, seed)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = own.encode_many([x or "" for x in batch.column("text").to_pylist()], text_keys(batch.column("id"), batch.column("copy")))
                offsets = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), ids], ["doc_id", "ids"])

    hold_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    copies = Window.partitionBy("id", F.xxhash64("text")).orderBy("text")
    rows = rows.withColumn("copy", F.row_number().over(copies) - 1 if by_copy else F.lit(0))
    return rows.mapInArrow(lean(run, forgets=False), "doc_id long, ids array<int>")


def decoded(pieces: DataFrame, vocabularies: str = VOCABULARIES) -> DataFrame:
    """doc_id and text, one row per row of pieces (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabularies, 0.0, 0)
        for batch in batches:
            texts = [own.decode(np.array(x or [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pieces.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(documents: DataFrame, dropout: float = DROPOUT, seed: int = SEED, vocabularies: str = VOCABULARIES) -> DataFrame:
    """One row per row of documents: doc_id, n_bytes, n_pieces, ids_sha256 (of the ids as 4-byte little-endian numbers), lossless.

    lossless says that decoding the pieces gives the text back. Cases as for encoded().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabularies, dropout, seed)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                found = own.encode_many(texts, text_keys(batch.column("id")))
                columns = [
                    batch.column("id"),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()),
                    pa.array([own.decode(x) == t for x, t in zip(found, texts, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_pieces", "ids_sha256", "lossless"])

    hold_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, lossless boolean")
