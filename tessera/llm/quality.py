"""Quality rules by tokeniser fertility.

Public vocabularies, read from files, tokenise every word of a text. Three measures follow: characters per token (of
each vocabulary), the share of byte-fallback tokens and the entropy of the tokens in bits. A text whose measures leave the
bands of its language, or of its script where the language has none, is rejected. Bands widen as texts get shorter, so they hold at
any length. Distinct words of a batch are tokenised once.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import IS_SPACE, hold_batches, lean, mix, slices, string_bytes, word_codes

VOCABULARIES = "/opt/tokenizers"
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"

# The characters that count as symbols, and the limits of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20


class Band(NamedTuple):
    """Ends for long texts: characters per token in the two vocabularies, share of byte fallback, entropy (see verdicts())."""

    pieces_low: float
    pieces_high: float
    bytes_low: float
    bytes_high: float
    fallback: float
    entropy: float


#: By language, fitted on labelled good documents: each end leaves out under one in a thousand of them.
BANDS = {
    "en": Band(2.16, 2.24, 2.09, 2.28, 0.02, 1.108),
    "de": Band(2.06, 2.26, 2.01, 2.07, 0.02, 1.087),
    "fr": Band(1.99, 2.05, 1.86, 1.94, 0.02, 1.086),
    "es": Band(1.95, 2.13, 1.78, 1.92, 0.02, 1.09),
}
#: By script, for other languages: mostly one-byte characters, or mostly longer ones.
SCRIPT_BANDS = {"latin": Band(1.5, 7.0, 1.3, 7.5, 0.2, 1.0), "other": Band(0.3, 7.0, 0.2, 7.5, 0.95, 0.9)}
#: How much wider a band is for a text of n tokens, divided by the root of n; and the fall of the entropy's share with log2 n.
CHARS_WIDTH, FALLBACK_WIDTH, ENTROPY_WIDTH, ENTROPY_FALL = 5.0, 1.0, 0.2, 0.045
CACHE_BYTES = 8 << 20  # of words that a worker remembers
SLICE_BYTES = 2 << 20  # of text that is measured at once


class Tokeniser:
    """Tokens of single words in both vocabularies; remembers the words it has seen, up to a bound."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        with open(os.path.join(folder, RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # a word has no white space, so one pattern for a leading space and the rest is enough
        self.ranks = tiktoken.Encoding("words", pat_str=r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, tuple[bytes, int]] = {}
        self.held = 0  # bytes of words in known

    def of(self, words: list[bytes]) -> list[tuple[bytes, int]]:
        """For each word its piece ids, as 4-byte numbers, and the number of its byte-level tokens."""
        missing = [w for w in words if w not in self.known]
        texts = [w.decode("utf-8", "replace") for w in missing]
        new = dict(zip(missing, zip([struct.pack(f"<{len(x)}i", *x) for x in self.pieces.encode(texts, num_threads=1)], [len(self.ranks.encode_ordinary(" " + x)) for x in texts], strict=True), strict=True))
        out = [self.known.get(w) or new[w] for w in words]
        if self.held < CACHE_BYTES:
            new = {w: x for w, x in new.items() if len(w) < 100}
            self.known.update(new)
            self.held += sum(map(len, new))
        return out


def repeats(keys: np.ndarray) -> np.ndarray:
    """Which of the keys, in order, equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def per_text(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The sum of flags between neighbouring borders."""
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[borders])


def repeated_windows(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where the windows of REPEAT_WINDOW words start that occur twice or more in their text."""
    windows = len(codes) - REPEAT_WINDOW + 1
    if windows < 1:
        return np.zeros(0, np.int64)
    inside = np.flatnonzero(owner[:windows] == owner[REPEAT_WINDOW - 1 :])
    key = mix(owner[inside].astype(np.uint64))
    for i in range(REPEAT_WINDOW):
        key = mix(key + codes[inside + i].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = inside[order[1:][same]], inside[order[:-1][same]]
    if any((codes[a + i] != codes[b + i]).any() for i in range(REPEAT_WINDOW)) or (owner[a] != owner[b]).any():
        every = np.column_stack([owner[inside], *(codes[inside + i] for i in range(REPEAT_WINDOW))])  # a hash collided
        _, number, times = np.unique(every, axis=0, return_inverse=True, return_counts=True)
        return inside[times[number.ravel()] > 1]
    return np.unique(np.concatenate([a, b]))


def duplicate_lines(column: pa.Array) -> np.ndarray:
    """For each text the lines with a word that equal an earlier line of it."""
    lists = pc.split_pattern(column.fill_null("").cast(pa.large_string()), "\n")
    owner = np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    found = lists.flatten().dictionary_encode()
    worded = pc.binary_length(pc.ascii_trim_whitespace(found.dictionary)).to_numpy(zero_copy_only=False) > 0
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    held = worded[codes]
    again = repeats(owner[held] * np.int64(len(worded)) + codes[held])
    return np.bincount(owner[held][again], minlength=len(column))


def measure(column: pa.Array, tokeniser: Tokeniser) -> dict[str, np.ndarray]:
    """All counts and measures of the texts. Words and lines are told apart by content."""
    n_texts = len(column)
    data, offsets = string_bytes(column)
    codes, first, distinct = word_codes(column)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(n_texts), n_words)
    space = IS_SPACE[data]
    out = {"n_words": n_words, "word_chars": per_text(~space & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets)}
    out["n_dup_lines"] = duplicate_lines(column)
    windows = repeated_windows(codes, owner)
    covered = np.zeros(len(codes) + 1, dtype=np.int32)
    np.add.at(covered, windows, 1)
    np.add.at(covered, windows + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = per_text(np.cumsum(covered[:-1]) > 0, first)
    found, inverse = tokeniser.of(distinct.cast(pa.large_binary()).to_pylist()), codes
    if not found:
        zero = np.zeros(n_texts)
        return out | {"n_tokens": np.zeros(n_texts, np.int64), "chars_per_piece": zero, "chars_per_byte_token": zero, "fallback_share": zero, "entropy": zero}
    counts = np.array([len(x) // 4 for x, _ in found])
    flat = np.frombuffer(b"".join([x for x, _ in found]), dtype="<i4")
    flat_start = np.cumsum(counts) - counts
    fallback = np.add.reduceat(np.append(tokeniser.is_byte[flat], False), flat_start, dtype=np.int64) * (counts > 0)
    tokens, byte_tokens = np.bincount(owner, counts[inverse], n_texts), np.bincount(owner, np.array([n for _, n in found])[inverse], n_texts)
    least = np.maximum(tokens, 1)
    # token entropy: log2(n) - sum(c log2 c) / n over the counts c of a text's tokens
    length = counts[inverse]
    at = np.repeat(flat_start[inverse] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    pair = np.sort(np.repeat(owner, length) * np.int64(1 << 20) + flat[at])
    head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(pair)))
    entropy = np.log2(least) - np.bincount(pair[head] >> 20, times * np.log2(np.maximum(times, 1)), n_texts) / least
    return out | {
        "n_tokens": tokens.astype(np.int64),
        "chars_per_piece": out["word_chars"] / least,
        "chars_per_byte_token": out["word_chars"] / np.maximum(byte_tokens, 1),
        "fallback_share": np.bincount(owner, fallback[inverse], n_texts) / least,
        "entropy": entropy,
    }


def verdicts(found: dict[str, np.ndarray], langs: list[str | None], ascii_share: np.ndarray) -> np.ndarray:
    """Whether the measures of each text lie in its bands, which widen as texts get shorter.

    The entropy is taken as a share of log2 n, its most for n tokens; that share falls by about ENTROPY_FALL with each doubling of n.
    """
    bands = np.array([BANDS.get((x or "").lower()) or SCRIPT_BANDS["latin" if a >= 0.5 else "other"] for x, a in zip(langs, ascii_share.tolist(), strict=True)]).reshape(-1, 6).T
    n = np.maximum(found["n_tokens"], 2)
    wide, most = 1 / np.sqrt(n), np.log2(n)
    inside = (found["chars_per_piece"] >= bands[0] - CHARS_WIDTH * wide) & (found["chars_per_piece"] <= bands[1] + CHARS_WIDTH * wide)
    inside &= (found["chars_per_byte_token"] >= bands[2] - CHARS_WIDTH * wide) & (found["chars_per_byte_token"] <= bands[3] + CHARS_WIDTH * wide)
    inside &= found["fallback_share"] <= bands[4] + FALLBACK_WIDTH * wide
    return inside & (found["entropy"] / most >= bands[5] - ENTROPY_FALL * most - ENTROPY_WIDTH * wide)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
MEASURES = ("chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy")


def judgements(texts: pa.Array, langs: pa.Array, tokeniser: Tokeniser) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The measures of texts, who fails the base rules and who is kept."""
    data, offsets = string_bytes(texts)
    found = measure(texts, tokeniser)
    failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PERCENT * found["n_words"])
    plain = per_text(data < 128, offsets) / np.maximum(np.diff(offsets), 1)
    return found, failed, ~failed & verdicts(found, langs.to_pylist(), plain)


def judged(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabularies: str = VOCABULARIES) -> DataFrame:
    """One row per row of documents: doc_id, lang, the counts, the measures, base_failed and kept.

    A null or empty text has no words and fails the base rules. A null or unknown language takes the band of the
    text's script. Null ids and repeated rows stay. An empty table gives no rows; extra columns are ignored.
    """
    names = [*COUNTS, *MEASURES]
    schema = "id long, lang string, " + ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in MEASURES), "base_failed boolean", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokeniser = None
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                tokeniser = tokeniser or Tokeniser(vocabularies)
                found, failed, kept = judgements(batch.column("text"), batch.column("lang"), tokeniser)
                columns = [pa.array(found[c].astype(np.int64 if c in COUNTS else np.float64)) for c in names]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), *columns, pa.array(failed), pa.array(kept)], ["id", "lang", *names, "base_failed", "kept"])

    hold_batches(documents.sparkSession)
    lang = F.col(lang_col).cast("string") if lang_col in documents.columns else F.lit(None).cast("string")
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", "doc_id")


def kept_documents(documents: DataFrame, vocabularies: str = VOCABULARIES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of documents that the rules keep, with all columns; only text and language go through Python.

    Each row is judged by itself, whatever its id. Null and empty texts go; a null, unknown or missing language takes the band of the text's
    script. Repeated rows stay or go together; an empty table stays empty; extra columns stay, whatever their names.
    """

    def flags(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tokeniser = None
        for texts, langs in batches:
            tokeniser = tokeniser or Tokeniser(vocabularies)
            batch = pa.RecordBatch.from_arrays([texts, langs], ["text", "lang"])
            yield pa.concat_arrays([pa.array([], pa.bool_()), *(pa.array(judgements(x.column("text"), x.column("lang"), tokeniser)[2]) for x in slices(batch, "text", SLICE_BYTES))])

    @arrow_udf("boolean")
    def keeps(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from lean(flags)(batches)

    hold_batches(documents.sparkSession)
    lang = F.col(lang_col).cast("string") if lang_col in documents.columns else F.lit(None).cast("string")
    return documents.where(keeps(F.col(text_col).cast("string"), lang))
