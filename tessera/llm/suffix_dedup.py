"""Removal of byte strings that an earlier document already holds, by blockwise suffix sorting over a difference cover.

Every byte covered by a `length`-byte string that also starts in a document with a smaller id goes. Texts are
dealt out by id into batches of a few MB. One plan; the exchange of the texts, each compressed alone, is made once and reused:

1. Cover sample. Positions p with p mod v in a difference cover D are sampled. For any two places i, j there
   is a shift d < v for which i + d and j + d are both sampled. A batch sends the sorted hashes of its sampled strings of
   length - v + 1 bytes, as packed steps.
2. Cover ranks. A hash range at a time, the sample is sorted. A string that two documents hold gets a rank, its place in
   that order; a string of one document gets none. A suffix can only have an equal in another document if one of the
   sampled strings in its head has a rank.
3. Runs. A suffix's bucket is the smallest hash among the 16-byte strings in its head, so neighbouring suffixes share
   buckets in runs. Of each run with a rank in it, the batch sends bucket, a hash of its text, id and place; runs that are equal
   within a batch are settled there, and one of them goes on.
4. Equal runs meet by bucket and hash of the text: all but those of the smallest id are covered. The texts that are left and their suffixes are counted by
   bucket, from sums of each task. A bucket of one text has nothing left to compare. One of over HOT suffixes, such as a passage
   that very many documents hold between different texts, is split: of its suffixes with a rank in the head, two 64-bit hashes are sent and settle them.
5. Blockwise sort. A bucket's suffixes are sorted by their first v bytes, one block of buckets at a time. Longer ties are resolved by
   the ranks: each suffix stands once for each of its sampled shifts d, with the rank there and the bytes that follow the sampled string, and equal suffixes
   meet at the shift that the cover has for them. The smallest id among equal ones decides. Ties of ranks are verified by
   bytes; if a hash has collided, the block is sorted by all bytes instead.
6. The batch cuts the covered bytes out of its texts.

No task holds more than a batch, one hash range of the sample or one range of buckets, and all three counts grow with the
text. A string that very many documents share reaches a task at most once from each batch. Inside a batch, work on places runs in
slabs, so a very long text takes a few times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hold_batches, lean, mix, string_bytes

BATCH_BYTES, LEAST_BYTES = 8 << 20, 1 << 17  # of text in a batch; batches are no smaller to have one for each shuffle partition
BLOCK = 1 << 17  # suffixes that are sorted at once
SLAB = 1 << 18  # places that are worked on at once
HOT = 60_000  # suffixes of different texts from which a bucket is split, below 2 ** 16; hashes of each are sent then instead of texts, so not long before they fill a block


def gram(length: int) -> int:
    """Bytes whose hashes choose a bucket: few give long runs, many give small buckets."""
    return 16 if length >= 32 else 8


@cache
def difference_cover(v: int) -> np.ndarray:
    """The residues of the smallest difference cover modulo v in lexicographic order: all differences occur."""
    size = 1
    while size * (size - 1) + 1 < v:
        size += 1

    def extend(chosen: list[int], size: int) -> list[int] | None:
        if len(chosen) == size:
            return chosen if len({(a - b) % v for a in chosen for b in chosen}) == v else None
        for x in range(chosen[-1] + 1, v):
            if found := extend([*chosen, x], size):
                return found
        return None

    while (found := extend([0], size)) is None:
        size += 1
    return np.array(found)


def cover_period(length: int) -> int:
    """The period of the cover: 21 or 7, perfect difference sets, so that sampled strings have 8 bytes or more."""
    for v in (21, 7):
        if length - v + 1 >= max(8, v):
            return v
    raise ValueError("strings of fewer than 14 bytes aren't supported")


def hashes_at(data: np.ndarray, places: np.ndarray, size: int, factor: int = 0x9E3779B97F4A7C15, shift: int = 29) -> np.ndarray:
    """A 64-bit hash of the size bytes (8 or more) at each place; another odd factor and shift make another hash."""
    words = np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
    out = np.full(len(places), size, dtype=np.uint64)
    for at in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        out = (out ^ words[places + at]) * np.uint64(factor)
        out ^= out >> np.uint64(shift)
    return mix(out)


def pack(values: np.ndarray) -> bytes:
    """Rising numbers as steps: as many low bits as the mean step has, and the rest, which adds up to two a number at most, in unary."""
    n = len(values)
    if not n:
        return b""
    steps = np.diff(values)
    mean = int(values[-1] - values[0]) // max(n - 1, 1)
    width = max(mean.bit_length() - 1, 0)
    whole, bits = divmod(width, 8)
    low = np.ascontiguousarray(steps, "<u8").view(np.uint8).reshape(-1, 8)
    part = np.unpackbits(low[:, whole : whole + 1], axis=1, bitorder="little")[:, :bits]
    rest = (steps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(rest + 1)
    unary = np.zeros(ends[-1] if n > 1 else 0, dtype=bool)
    unary[ends - 1] = True
    return bytes([width]) + np.array([n], "<u4").tobytes() + values[:1].astype("<u8").tobytes() + low[:, :whole].tobytes() + np.packbits(part).tobytes() + np.packbits(unary).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint64)
    n = int(np.frombuffer(blob, "<u4", 1, 1)[0]) - 1
    whole, bits = divmod(blob[0], 8)
    steps, at = np.zeros((n, 8), dtype=np.uint8), 13 + n * whole
    steps[:, :whole] = np.frombuffer(blob, np.uint8, n * whole, 13).reshape(n, whole)
    if bits:
        part = np.unpackbits(np.frombuffer(blob, np.uint8, (n * bits + 7) // 8, at), count=n * bits).reshape(n, bits)
        steps[:, whole : whole + 1] = np.packbits(part, axis=1, bitorder="little")
    rest = np.diff(np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + (n * bits + 7) // 8))), prepend=-1) - 1
    out = np.frombuffer(blob, "<u8", 1, 5).repeat(n + 1)
    out[1:] += np.cumsum(steps.view("<u8")[:, 0] + (rest.astype(np.uint64) << np.uint64(blob[0])), dtype=np.uint64)
    return out


def compressed(texts: pa.Array) -> pa.Array:
    """Each text with zstd after its size in 8 bytes, or as it is where that isn't shorter."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    for x in texts.to_pylist():
        packed = codec.compress(x, asbytes=True) if x else b""
        out.append(len(x).to_bytes(8, "little") + (packed if len(packed) < len(x) else x))
    return pa.array(out, pa.binary())


def opened(rows: pa.Table) -> pa.Table:
    """The rows with the texts that compressed() made their blobs from."""
    codec, out = pa.Codec("zstd"), []
    for x in rows.column("text").to_pylist():
        size = int.from_bytes(x[:8], "little")
        out.append(x[8:] if len(x) - 8 == size else codec.decompress(x[8:], size, asbytes=True))
    return rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(out, pa.binary()))


def words_from(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from every place on, as numbers."""
    return np.ndarray((max(0, len(data) - 7),), dtype=kind, buffer=data, strides=(1,))


class Batch:
    """The texts of one batch in a fixed order, end to end."""

    def __init__(self, rows: pa.Table, length: int):
        rows = rows.combine_chunks()
        texts = rows.column("text")
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.binary())
        ids = rows.column("id").to_numpy()
        order = np.lexsort((np.array([hash_of(x) for x in texts.to_pylist()], dtype=np.uint64), ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        self.rows, self.ids, self.length = rows.take(pa.array(order)), ids[order], length
        column = self.rows.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        data, self.offsets = string_bytes(column)
        self.data = np.ascontiguousarray(data)
        self.v = cover_period(length)
        self.size = length - self.v + 1
        self.starts, self.sizes = self.offsets[:-1], np.diff(self.offsets)

    def slabs(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, place in the text, bytes from there to the text's end) of every slab."""
        for s in range(0, len(self.data), SLAB):
            e = min(len(self.data), s + SLAB)
            counts = np.diff(np.clip(self.offsets, s, e))
            place = np.arange(s, e)
            yield s, e, (place - np.repeat(self.starts, counts)).astype(np.int32), (np.repeat(self.offsets[1:], counts) - place).astype(np.int32)

    def sample(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled places, the order that sorts them by hash, and the sorted hashes."""
        cover = np.isin(np.arange(self.v), difference_cover(self.v))
        places = [np.zeros(0, np.int32)]
        for s, _, at, left in self.slabs():
            places.append((np.flatnonzero(cover[at % self.v] & (left >= self.size) & (at + left >= self.length)) + s).astype(np.int32))
        places = np.concatenate(places)
        hashes = np.empty(len(places), dtype=np.uint64)
        for s in range(0, len(places), SLAB):
            hashes[s : s + SLAB] = hashes_at(self.data, places[s : s + SLAB], self.size) >> np.uint64(64 - bits)
        order = np.argsort(hashes)
        return places, order, hashes[order]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, side="right") - 1


def hash_of(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text or b"")


def heads(hashes: np.ndarray) -> np.ndarray:
    """Whether each of the sorted hashes is the first of its value."""
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    return first


def bucket_starts(hashes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where the hashes of each of the equal hash ranges begin, and the end."""
    return np.append(np.searchsorted(hashes, np.array([(i << bits) // buckets for i in range(buckets)], dtype=np.uint64)), len(hashes))


def sample_blobs(length: int, bits: int, buckets: int):
    """Step 1: one row for each hash range that the batch has a sampled string in. several: a bit for each, set if two documents hold it."""

    def run(rows: pa.Table) -> pa.Table:
        batch = Batch(opened(rows), length)
        places, order, hashes = batch.sample(bits)
        number = np.unique(batch.ids, return_inverse=True)[1].astype(np.int32)  # of each text's id
        owners = np.empty(len(places), dtype=np.int32)
        for s in range(0, len(places), SLAB):
            owners[s : s + SLAB] = number[batch.text_of(places[order[s : s + SLAB]])]
        del places, order
        begin = np.flatnonzero(heads(hashes))
        several = np.minimum.reduceat(owners, begin) != np.maximum.reduceat(owners, begin) if len(begin) else np.zeros(0, bool)
        hashes = hashes[begin]
        cuts = bucket_starts(hashes, buckets, bits).tolist()
        full = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
        part = lambda f, x: pa.array([f(x[cuts[i] : cuts[i + 1]]) for i in full], pa.binary())
        b = rows.column("b")[0].as_py()
        return pa.table({"bucket": pa.array(full, pa.int32()), "b": pa.array([b] * len(full), pa.int32()), "blob": part(pack, hashes), "several": part(lambda x: np.packbits(x).tobytes(), several)})

    return run


def shared_ranks(rows: pa.Table) -> pa.Table:
    """Step 2: for each batch of one hash range, a bit for each of its hashes, set if two documents hold it, and the ranks of those."""
    parts = [unpack(x) for x in rows.column("blob").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(rows.column("several").to_pylist(), parts, strict=True)]
    hashes = np.concatenate(parts)
    order = np.argsort(hashes)
    first = heads(hashes[order])
    shared = np.concatenate(several)[order]
    shared |= ~first
    shared = np.logical_or.reduceat(shared, np.flatnonzero(first)) if len(hashes) else shared  # of each different hash
    number, rank = np.cumsum(first, dtype=np.int32), np.cumsum(shared, dtype=np.int32)
    number, rank = number - np.int32(1), rank - np.int32(1)
    bits, ranks = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int32)
    bits[order], ranks[order] = shared[number], rank[number]
    ends = np.cumsum([len(x) for x in parts]).tolist()
    out = [(bits[e - len(x) : e], ranks[e - len(x) : e]) for x, e in zip(parts, ends, strict=True)]
    return pa.table({"b": rows.column("b"), "bucket": rows.column("bucket"), "flags": pa.array([np.packbits(f).tobytes() for f, _ in out], pa.binary()), "ranks": pa.array([pack(r[f].astype(np.uint64)) for f, r in out], pa.binary())})


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbouring values, from each place on; places near the end see fewer."""
    have, out = 1, values.copy()
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sample_ranks(batch: Batch, told: pa.Table, bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The sampled places that have a rank, rising, and their ranks, from 1."""
    places, order, hashes = batch.sample(bits)
    first = heads(hashes)
    distinct = hashes[first]
    cuts = bucket_starts(distinct, buckets, bits)
    ranks = np.zeros(len(distinct), dtype=np.uint64)
    for bucket, flags, own in zip(*(told.column(c).to_pylist() for c in ("bucket", "flags", "ranks")), strict=True):
        a, e = cuts[bucket], cuts[bucket + 1]
        shared = np.unpackbits(np.frombuffer(flags, np.uint8), count=e - a).astype(bool)
        ranks[a:e][shared] = unpack(own) * np.uint64(buckets) + np.uint64(bucket + 1)
    number = np.cumsum(first, dtype=np.int32) - np.int32(1)
    del hashes, distinct, first
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for s in range(0, len(places), SLAB):
        own = ranks[number[s : s + SLAB]]
        found.append((places[order[s : s + SLAB][own > 0]].astype(np.int64), own[own > 0]))
    del places, order, number, ranks
    places, ranks = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(places)
    return places[order], ranks[order]


def runs_of(batch: Batch, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of neighbouring suffixes of one text that share a bucket, if one of them has a ranked place in its head: place, size, bucket.

    A run is whole even if some of its suffixes have none, so equal passages have equal runs but at their ends.
    """
    n, length, width = len(batch.data), batch.length, gram(batch.length)
    words, reach = words_from(batch.data), length - width
    firsts, keys, key, at_end = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], None, True
    for s, e, at, left in batch.slabs():
        stop = min(e + reach, n - width + 1)
        if stop <= s:
            break
        values = np.full(e + reach - s, np.iinfo(np.uint64).max, dtype=np.uint64)
        out = np.full(stop - s, width, dtype=np.uint64)
        for x in range(0, width, 8):
            out = (out ^ words[s + x : stop + x]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        values[: stop - s] = mix(out)
        own = sliding_minimum(values, reach + 1)[: e - s]
        valid = left >= length
        new = valid & (at == 0)
        new[1:] |= valid[1:] & (~valid[:-1] | (own[1:] != own[:-1]))
        new[0] |= valid[0] and (at_end or own[0] != key)
        firsts.append(np.flatnonzero(new) + s)
        keys.append(own[new])
        key, at_end = own[-1], not valid[-1]
    first, keys = np.concatenate(firsts), np.concatenate(keys)
    if not len(first):
        return first, first, keys
    # the last run of a text ends where no string of the text starts any more
    stop = np.minimum(np.append(first[1:], n), batch.offsets[batch.text_of(first) + 1] - length + 1)
    held = np.searchsorted(ranked, stop + (batch.v - 1)) > np.searchsorted(ranked, first)
    return first[held], (stop - first)[held], keys[held]


def text_hashes(batch: Batch, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the text of each run: its bytes from place `at`, size + length - 1 of them."""
    total = sizes + (batch.length - 1)
    out = np.zeros(len(at), dtype=np.uint64)
    last = at + total - 8
    # words of 8 bytes every 8 bytes, the last one overlapping; runs that have ended keep their hash
    words = words_from(batch.data)
    live, step = np.arange(len(at)), 0
    while len(live):
        x = out[live] ^ words[np.minimum(at[live] + step, last[live])]
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[live] = x ^ (x >> np.uint64(29))
        step += 8
        live = live[step < total[live]]
    return mix(out ^ mix(total.astype(np.uint64)))


def pieces(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each run of equal numbers."""
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
    return [(int(bucket[s]), s, e) for s, e in zip(cuts, cuts[1:], strict=False)]


def spans_of(at: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Places and ends of what runs cover, joined where they touch; at rises."""
    if not len(at):
        return np.zeros((0, 2), dtype="<i4")
    ends = np.maximum.accumulate(at + sizes + (length - 1))
    new = np.append(True, at[1:] > ends[:-1])
    return np.stack([at[new], ends[np.append(new[1:], True)]], axis=1).astype("<i4")


def table_of(rows: list[dict], binary: tuple[str, ...]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("b", pa.int32()), *((x, pa.binary()) for x in binary)]))


def shrunk(values: np.ndarray) -> bytes:
    """Whole numbers of 0 and more in as few bytes each as they need, after a byte that says how many; others as 8 bytes."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    size = next((w for w in (1, 2, 4) if 0 <= low and high < 1 << (8 * w)), 8)
    return bytes([size]) + values.astype("<i8" if size == 8 else f"<u{size}").tobytes()


def grown(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8" if blob[0] == 8 else f"<u{blob[0]}", offset=1).astype(np.int64) if blob else np.zeros(0, np.int64)


RUNS = ("keys", "marks", "ids", "at", "n", "gone")


def send_runs(length: int, bits: int, buckets: int):
    """Step 3: one row for each range of buckets and marks that the batch has a run with a rank in. gone: spans that are settled here."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        batch = Batch(opened(rows), length) if rows.num_rows else None
        ranked = sample_ranks(batch, told, bits, buckets)[0] if batch else ()
        if not len(ranked):
            return table_of([], RUNS)
        at, sizes, keys = runs_of(batch, ranked)
        marks = text_hashes(batch, at, sizes)
        ids = batch.ids[batch.text_of(at)]
        settled = ids > lowest_of(ids, at, marks, keys)
        left = np.flatnonzero(~settled)
        bucket = (mix(keys[left] ^ marks[left]) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        left, bucket = left[by], bucket[by]
        b = rows.column("b")[0].as_py()
        # places and ids rise within a blob, so steps are sent
        out = [{"bucket": k, "b": b, "keys": keys[own].astype("<u8").tobytes(), "marks": marks[own].astype("<u8").tobytes(), "ids": shrunk(np.diff(ids[own], prepend=0)), "at": pack(at[own].astype(np.uint64)), "n": shrunk(sizes[own]), "gone": b""} for k, s, e in pieces(bucket) for own in [left[s:e]]]
        gone = spans_of(at[settled], sizes[settled], length)
        if len(gone):
            out.append({"bucket": b % buckets, "b": b} | dict.fromkeys(RUNS, b"") | {"gone": gone.tobytes()})
        return table_of(out, RUNS)

    return run


def lowest_of(ids: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """For each row the smallest id among the rows that agree in the last two of `same`; the first one only orders them."""
    order = np.lexsort((ids, *same[1:]))
    new = np.zeros(len(ids), dtype=bool)
    new[:1] = True
    for x in same[1:]:
        new[1:] |= x[order][1:] != x[order][:-1]
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
    return out


class Met:
    """The runs that meet in one range of buckets and marks. covered: an equal run has a smaller id."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        read = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in rows.column(name).to_pylist()]
        self.batches, self.gone = rows.column("b").to_pylist(), read("gone", "<i4")
        keys = read("keys", "<u8")
        self.owner = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        self.keys, self.marks, self.ids, self.at, self.sizes = (np.concatenate([np.zeros(0, x[0].dtype if x else "<u8"), *x]) for x in (keys, read("marks", "<u8"), [np.cumsum(grown(x)) for x in rows.column("ids").to_pylist()], [unpack(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in rows.column("at").to_pylist()], [grown(x) for x in rows.column("n").to_pylist()]))
        lowest = lowest_of(self.ids, self.at, self.marks, self.keys)
        self.covered = self.ids > lowest
        left = np.flatnonzero(~self.covered)
        order = left[np.lexsort((self.marks[left], self.keys[left]))]
        k, m = self.keys[order], self.marks[order]
        text = heads(m) | heads(k)
        self.distinct, number = np.unique(k, return_inverse=True)
        # of each bucket, here: the suffixes of its different texts, and whether there are several
        self.suffixes = np.minimum(np.bincount(number, text * self.sizes[order], len(self.distinct)), HOT + 1).astype(np.uint16)
        self.several = np.bincount(number, text, len(self.distinct)) > 1


def texts_here(buckets: int):
    """Step 4, first half: whether the task has several different texts of each bucket, and how many suffixes, one row for each range of buckets."""

    def run(rows: pa.Table) -> pa.Table:
        met, out = Met(rows), []
        at = rows.column("bucket")[0].as_py()
        cuts = bucket_starts(met.distinct, buckets, 64).tolist()
        for k in range(buckets):
            if cuts[k] < cuts[k + 1]:
                own = slice(cuts[k], cuts[k + 1])
                out.append({"bucket": k, "b": at, "keys": pack(met.distinct[own]), "suffixes": met.suffixes[own].tobytes(), "several": np.packbits(met.several[own]).tobytes()})
        return table_of(out, ("keys", "suffixes", "several"))

    return run


def texts_in_all(rows: pa.Table) -> pa.Table:
    """For each task of one range of buckets, 0, 1 or 2 for each of its buckets: one text, several, or so many suffixes that it is split. Equal texts are in one task."""
    parts = [unpack(x) for x in rows.column("keys").to_pylist()]
    suffixes = np.concatenate([np.frombuffer(x, np.uint16) for x in rows.column("suffixes").to_pylist()])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(rows.column("several").to_pylist(), parts, strict=True)])
    distinct, number = np.unique(np.concatenate(parts), return_inverse=True)
    many = np.bincount(number, several + 1, len(distinct)) > 1
    kind = (many.astype(np.uint8) + (many & (np.bincount(number, suffixes, len(distinct)) > HOT)))[number]
    ends = np.cumsum([len(x) for x in parts]).tolist()
    return pa.table({"b": rows.column("b"), "bucket": rows.column("bucket"), "kinds": pa.array([kind[e - len(x) : e].tobytes() for x, e in zip(parts, ends, strict=True)], pa.binary())})


WANTED = ("keys", "at", "n", "hot", "gone")


def equal_runs(length: int, buckets: int):
    """Step 4, second half: for each batch the spans that equal runs of smaller ids cover, and the runs whose text is wanted."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return table_of([], WANTED).drop_columns(["bucket"])
        met = Met(rows)
        cuts = bucket_starts(met.distinct, buckets, 64)
        kinds = np.zeros(len(met.distinct), dtype=np.uint8)
        for k, x in zip(told.column("bucket").to_pylist(), told.column("kinds").to_pylist(), strict=True):
            kinds[cuts[k] : cuts[k + 1]] = np.frombuffer(x, np.uint8)
        kind = np.zeros(len(met.keys), dtype=np.uint8)
        left = ~met.covered
        kind[left] = kinds[np.searchsorted(met.distinct, met.keys[left])]
        out = [{"b": b, "gone": [x.reshape(-1, 2)]} for b, x in zip(met.batches, met.gone, strict=True)]
        for rows_of, name in ((np.flatnonzero(met.covered), "gone"), (np.flatnonzero(kind > 0), "want")):
            by = np.lexsort((met.at[rows_of], met.owner[rows_of]))
            for i, s, e in pieces(met.owner[rows_of][by]):
                own = rows_of[by[s:e]]
                if name == "gone":
                    out[i]["gone"].append(spans_of(met.at[own].astype(np.int64), met.sizes[own].astype(np.int64), length))
                else:
                    out[i]["want"] = own
        made = []
        for x in out:
            want = x.get("want", np.zeros(0, dtype=np.int64))
            made.append({"bucket": 0, "b": x["b"], "keys": met.keys[want].astype("<u8").tobytes(), "at": pack(met.at[want].astype(np.uint64)), "n": shrunk(met.sizes[want]), "hot": (kind[want] > 1).astype(np.uint8).tobytes(), "gone": np.concatenate(x["gone"]).astype("<i4").tobytes()})
        return table_of([x for x in made if x["keys"] or x["gone"]], WANTED).drop_columns(["bucket"])

    return run


TEXTS = ("keys", "ids", "at", "n", "residues", "text", "ranks", "gone", "single", "second", "single_ids", "single_at")


def each_suffix(at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of every suffix of the runs, and the number of its run."""
    run = np.repeat(np.arange(len(at)), sizes)
    return at[run] + np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes), run


def split_runs(batch: Batch, at: np.ndarray, sizes: np.ndarray, ranked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the suffixes of hot runs, those with one of the ranked places in their head (if given): the places that go on with buckets by all their bytes; and which ones equal suffixes of the batch settle."""
    if not len(at):
        return at, at.astype(np.uint64), at
    places = np.unique(each_suffix(at, sizes)[0])
    if ranked is not None:
        places = places[np.searchsorted(ranked, places + batch.v) > np.searchsorted(ranked, places)]
    keys, second = hashes_at(batch.data, places, batch.length), second_hashes(batch, places)
    ids = batch.ids[batch.text_of(places)]
    settled = ids > lowest_of(ids, places, second, keys)
    return places[~settled], keys[~settled], places[settled]


def second_hashes(batch: Batch, places: np.ndarray) -> np.ndarray:
    return hashes_at(batch.data, places, batch.length, 0xC2B2AE3D27D4EB4F, 32)


def send_texts(length: int, bits: int, buckets: int):
    """One row for each range of buckets that wants a run's text of the batch, with the ranks in it, or the hashes of single suffixes of hot runs; spans that are settled go along."""

    def run(rows: pa.Table, wanted: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return table_of([], TEXTS)
        read = lambda name, kind: np.frombuffer(b"".join(wanted.column(name).to_pylist()), dtype=kind)
        numbers_of = lambda name, f: np.concatenate([f(x) for x in wanted.column(name).to_pylist()]).astype(np.int64)
        keys, at, sizes, hot, gone = read("keys", "<u8"), numbers_of("at", unpack), numbers_of("n", grown), read("hot", np.uint8) > 0, read("gone", "<i4").reshape(-1, 2)
        b, out, pack_text = rows.column("b")[0].as_py(), [], pa.Codec("zstd")
        if len(keys):
            batch = Batch(opened(rows), length)
            ranked, ranks = sample_ranks(batch, told, bits, buckets)
            singles, own_keys, settled = split_runs(batch, at[hot], sizes[hot], ranked)
            gone = np.concatenate([gone, spans_of(settled, np.ones(len(settled), dtype=np.int64), length)])
            keys, at, sizes = keys[~hot], at[~hot], sizes[~hot]
            raw, text = batch.data.tobytes(), batch.text_of(at)
            ids, residues = batch.ids[text], ((at - batch.starts[text]) % batch.v).astype(np.uint8)
            cover = np.isin(np.arange(batch.v), difference_cover(batch.v))
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            by = np.lexsort((at, bucket))  # places and ids rise within a row, so steps are sent
            for k, s, e in pieces(bucket[by]):
                own = by[s:e]
                joined = b"".join([raw[a : a + m] for a, m in zip(at[own].tolist(), (sizes[own] + (length - 1)).tolist(), strict=True)])
                # a rank or 0 for every sampled place in the runs
                places, r = each_suffix(at[own], sizes[own] + (batch.v - 1))
                places = places[cover[(residues[own][r].astype(np.int64) + places - at[own][r]) % batch.v]]
                found = np.minimum(np.searchsorted(ranked, places), len(ranked) - 1)
                numbers = np.where(ranked[found] == places, ranks[found], 0)
                # 16 bits of a hash tell two ranks apart but for chance, and ties are verified by bytes
                numbers = np.where(numbers > 0, mix(numbers) >> np.uint64(48) | np.uint64(1), 0).astype("<u2")
                out.append({"bucket": k, "b": b} | dict.fromkeys(TEXTS, b"") | {"keys": keys[own].tobytes(), "ids": shrunk(np.diff(ids[own], prepend=0)), "at": pack(at[own].astype(np.uint64)), "n": shrunk(sizes[own]), "residues": residues[own].tobytes(), "text": pack_text.compress(joined, asbytes=True), "ranks": some(numbers)})
            bucket, second, ids = (own_keys % np.uint64(buckets)).astype(np.int32), second_hashes(batch, singles), batch.ids[batch.text_of(singles)]
            by = np.argsort(bucket, kind="stable")
            for k, s, e in pieces(bucket[by]):
                own = by[s:e]
                out.append({"bucket": k, "b": b} | dict.fromkeys(TEXTS, b"") | {"single": own_keys[own].tobytes(), "second": second[own].tobytes(), "single_ids": shrunk(np.diff(ids[own], prepend=0)), "single_at": pack(singles[own].astype(np.uint64))})
        if len(gone):
            gone = gone[np.argsort(gone[:, 0], kind="stable")].astype(np.int64)
            gone = spans_of(gone[:, 0], gone[:, 1] - gone[:, 0], 1)
            out.append({"bucket": b % buckets, "b": b} | dict.fromkeys(TEXTS, b"") | {"gone": gone.tobytes()})
        return table_of(out, TEXTS)

    return run


def some(numbers: np.ndarray) -> bytes:
    """16-bit numbers, a bit for each that isn't 0 and those."""
    return np.array([len(numbers)], "<u4").tobytes() + np.packbits(numbers > 0).tobytes() + numbers[numbers > 0].astype("<u2").tobytes()


def all_of(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint16)
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    out = np.zeros(n, dtype=np.uint16)
    out[np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, 4), count=n).astype(bool)] = np.frombuffer(blob, "<u2", offset=4 + (n + 7) // 8)
    return out


def settled_singles(rows: pa.Table, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(batch, spans) of the single suffixes that an equal one of a smaller id covers."""
    singles = rows.filter(pc.greater(pc.binary_length(rows.column("single")), 0))
    if not singles.num_rows:
        return
    read = lambda name, f: [f(x) for x in singles.column(name).to_pylist()]
    keys = read("single", lambda x: np.frombuffer(x, "<u8"))
    owner = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    ids, at = np.concatenate([np.cumsum(grown(x)) for x in singles.column("single_ids").to_pylist()]), np.concatenate(read("single_at", unpack)).astype(np.int64)
    gone = np.flatnonzero(ids > lowest_of(ids, at, np.concatenate(read("second", lambda x: np.frombuffer(x, "<u8"))), np.concatenate(keys)))
    for i, s, e in pieces(owner[gone]):
        places = at[gone[s:e]]
        yield singles.column("b")[i].as_py(), spans_of(places, np.ones(len(places), dtype=np.int64), length)


def tied(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the keys, the first one first, and where a new value of them begins in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def covered_by_bytes(data: np.ndarray, places: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at places have their first length bytes in common with one of a smaller owner."""
    words = words_from(data, ">u8")
    order, new = tied([words[places + x].astype(np.uint64) for x in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]])
    begin = np.flatnonzero(new)
    lowest = np.empty(len(order), dtype=np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(owners[order], begin), np.diff(np.append(begin, len(order)))) if len(order) else 0
    return lowest < owners


def covered(data: np.ndarray, places: np.ndarray, owners: np.ndarray, length: int, residues: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The same by the first v bytes and, where these tie, by ranks. residues: of the places; ranks: of every place of data, 0 for none."""
    v = cover_period(length)
    size, words = length - v + 1, words_from(data, ">u8")
    order, new = tied([words[places + x].astype(np.uint64) for x in range(0, v, 8)])
    out = np.zeros(len(places), dtype=bool)
    begin = np.flatnonzero(new)
    if not len(begin):
        return out
    sizes = np.diff(np.append(begin, len(order)))
    owner = owners[order]
    open_ = np.repeat(np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin), sizes)
    group, own = np.repeat(np.arange(len(begin)), sizes)[open_], order[open_]
    # each suffix once for each sampled shift in its head
    shifts = np.array([[d for d in range(v) if (r + d) % v in difference_cover(v)] for r in range(v)])
    d = shifts[residues[own]]
    rank = ranks[places[own][:, None] + d]
    row, column = np.nonzero(rank)
    rank, d, own, group = rank[row, column], d[row, column], own[row], group[row]
    # classes of equal (tie, shift, rank, bytes after the sampled string), by a hash of the four
    kind = mix((group * v + d).astype(np.uint64)) + mix(rank.astype(np.uint64))
    for x in range(length - 8 * -(-(v - 1) // 8), length, 8):
        hidden = np.clip(np.arange(v) + size - x, 0, 8)
        mask = np.array([(1 << (8 * (8 - h))) - 1 for h in hidden.tolist()], dtype=np.uint64)
        some = np.flatnonzero(mask[d])
        kind[some] = mix(kind[some] ^ (words[places[own[some]] + x].astype(np.uint64) & mask[d[some]]))
    order = np.argsort(kind)
    begin = np.flatnonzero(heads(kind[order]))
    if not len(begin):
        return out
    own = own[order]
    sizes, owner = np.diff(np.append(begin, len(own))), owners[own]
    lowest = np.repeat(np.minimum.reduceat(owner, begin), sizes)
    hit = np.flatnonzero(lowest < owner)
    number = np.repeat(np.arange(len(begin)), sizes)
    holder = np.empty(len(begin), dtype=np.int64)
    is_lowest = owner == lowest
    holder[number[is_lowest]] = own[is_lowest]  # a suffix of the smallest id of each class
    own, first = np.unique(own[hit], return_index=True)
    held = holder[number[hit[first]]]
    if any((words[places[own] + x] != words[places[held] + x]).any() for x in [*range(0, length - 7, 8), length - 8]):
        return covered_by_bytes(data, places, owners, length)  # a hash collided
    out[own] = True
    return out


def sorted_buckets(length: int):
    """Step 5: spans of each batch that the suffixes of one range of buckets show to be covered."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        spans: dict[int, list[np.ndarray]] = {}
        read = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in rows.column(name).to_pylist()]
        batches = rows.column("b").to_pylist()
        for b, x in zip(batches, read("gone", "<i4"), strict=True):
            if len(x):
                spans.setdefault(b, []).append(x.reshape(-1, 2))
        for b, x in settled_singles(rows, length):
            spans.setdefault(b, []).append(x)
        keys, counts = read("keys", "<u8"), [grown(x) for x in rows.column("n").to_pylist()]
        owner = np.repeat(np.arange(len(batches)), [len(x) for x in keys])
        if not len(owner):
            return span_rows(spans)
        codec = pa.Codec("zstd")
        texts = [codec.decompress(x, int(n.sum() + len(n) * (length - 1)), asbytes=True) for x, n in zip(rows.column("text").to_pylist(), counts, strict=True) if len(n)]
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        ids, at, residues = np.concatenate([np.cumsum(grown(x)) for x in rows.column("ids").to_pylist()]), np.concatenate([unpack(x) for x in rows.column("at").to_pylist()]).astype(np.int64), np.concatenate(read("residues", np.uint8)).astype(np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        numbers = [all_of(x) for x in rows.column("ranks").to_pylist()]
        ends = np.cumsum(counts + (length - 1))
        begin = ends - counts - (length - 1)
        v = cover_period(length)
        cover = np.isin(np.arange(v), difference_cover(v))
        ranks, sent, done = np.zeros(len(data), dtype=np.uint16), np.concatenate(numbers), 0
        for s in range(0, len(keys), 1 << 14):  # bounds the places worked on at once
            places, r = each_suffix(begin[s : s + (1 << 14)], counts[s : s + (1 << 14)] + (v - 1))
            places = places[cover[(residues[r + s] + places - begin[r + s]) % v]]
            ranks[places] = sent[done : done + len(places)]
            done += len(places)
        order = np.argsort(keys, kind="stable")
        done = np.cumsum(counts[order])
        new = np.append(np.flatnonzero(heads(keys[order])), len(order))  # where buckets begin
        start = 0
        while start < len(order):
            base = done[start - 1] if start else 0
            stop = int(new[max(np.searchsorted(new, start, side="right"), np.searchsorted(new, np.searchsorted(done, base + BLOCK), side="right") - 1)])
            own = order[start:stop]
            places, r = each_suffix(begin[own], counts[own])
            r = own[r]
            inner = places - begin[r]
            hit = covered(data, places, ids[r], length, (residues[r] + inner) % v, ranks)
            if hit.any():
                batch, place = owner[r][hit], (at[r] + inner)[hit]
                cut = np.append(0, np.flatnonzero((np.diff(place) != 1) | (np.diff(batch) != 0)) + 1)
                last = np.append(cut[1:] - 1, len(place) - 1)
                found = np.stack([place[cut], place[last] + length], axis=1).astype("<i4")
                by = np.argsort(batch[cut], kind="stable")
                for b, s, e in pieces(batch[cut][by]):
                    spans.setdefault(batches[b], []).append(found[by[s:e]])
            start = stop
        return span_rows(spans)

    return run


def span_rows(spans: dict[int, list[np.ndarray]]) -> pa.Table:
    blobs = [np.concatenate(x).astype("<i4").tobytes() for x in spans.values()]
    return pa.table({"b": pa.array(list(spans), pa.int32()), "spans": pa.array(blobs, pa.binary())})


def without(batch: Batch, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the bytes and the runs that the spans cover, and all other bytes; takes a few bytes a place at most."""
    gone = gone[np.argsort(gone[:, 0], kind="stable")].astype(np.int64)
    begin, end = spans_of(gone[:, 0], gone[:, 1] - gone[:, 0], 1).T.astype(np.int64)
    border = np.searchsorted(begin, batch.offsets)  # spans that begin before each text
    over = np.where(border > 0, np.append(end, 0)[border - 1] - batch.offsets, 0).clip(0)  # bytes of them that reach into it
    removed = np.diff(np.append(0, np.cumsum(end - begin))[border] - over)
    pieces = np.diff(border) + ((over[:-1] > 0) & (batch.sizes > 0))
    level = np.zeros(len(batch.data) + 1, dtype=np.int8)
    level[begin] = 1
    level[end] = -1
    return removed, pieces, batch.data[np.cumsum(level[:-1], dtype=np.int8) == 0]


def cut_texts(length: int):
    """Step 6: the texts of a batch without the covered bytes."""

    def run(rows: pa.Table, spans: pa.Table) -> pa.Table:
        batch = Batch(opened(rows), length) if rows.num_rows else None
        if batch is None:
            out = rows.drop_columns(["b", "text"])
            return out.append_column("n_bytes", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("n_spans", pa.array([], pa.int64())).append_column("kept", pa.array([], pa.binary()))
        gone = [np.zeros((0, 2), "<i4"), *(np.frombuffer(x, dtype="<i4").reshape(-1, 2) for x in spans.column("spans").to_pylist())]
        removed, pieces, kept = without(batch, np.concatenate(gone))
        offsets = np.append(0, np.cumsum(batch.sizes - removed)).astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(batch.ids), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        out = batch.rows.drop_columns(["b", "text"])
        for name, x in (("n_bytes", batch.sizes), ("n_removed", removed), ("n_spans", pieces)):
            out = out.append_column(name, pa.array(x.astype(np.int64)))
        return out.append_column("kept", texts)

    return run


def _cut(documents: DataFrame, length: int, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """id, c0, c1 and so on (the other columns), n_bytes, n_removed, n_spans, kept; one row per row of documents."""
    raw = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), raw.alias("text"), *carried)
    size = documents.select(F.sum(F.octet_length(raw))).first()[0] or 0
    session = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(-(-size // BATCH_BYTES), min(session, -(-size // LEAST_BYTES)), 1)
    # of a random string's hash, a chance of about 1 in 64 to meet another
    bits = min(60, max(24, int(size).bit_length() + 5))
    hold_batches(documents.sparkSession)
    texts = rows.where("id is not null").withColumn("b", F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(n)).cast("int"))
    texts = texts.withColumn("text", F.arrow_udf(compressed, "binary")("text")).repartition(n, "b")
    binary = lambda names: ", ".join(f"{x} binary" for x in names)
    by = lambda df, key: df.repartition(n, key).groupBy(key)
    kinds = [f"c{i} {documents.select(f'`{c}`').schema[0].dataType.simpleString()}" for i, c in enumerate(others)]
    fields = ", ".join(["id long", *kinds, "n_bytes long", "n_removed long", "n_spans long", "kept binary"])
    blobs = texts.groupBy("b").applyInArrow(lean(sample_blobs(length, bits, n)), "bucket int, b int, blob binary, several binary")
    ranks = by(blobs, "bucket").applyInArrow(lean(shared_ranks), "b int, bucket int, flags binary, ranks binary").repartition(n, "b")
    runs = texts.groupBy("b").cogroup(ranks.groupBy("b")).applyInArrow(lean(send_runs(length, bits, n)), f"bucket int, b int, {binary(RUNS)}").repartition(n, "bucket")
    here = runs.groupBy("bucket").applyInArrow(lean(texts_here(n)), "bucket int, b int, keys binary, suffixes binary, several binary")
    told = by(here, "bucket").applyInArrow(lean(texts_in_all), "b int, bucket int, kinds binary")
    wanted = runs.groupBy("bucket").cogroup(told.withColumnRenamed("bucket", "range").withColumnRenamed("b", "bucket").repartition(n, "bucket").groupBy("bucket"))
    wanted = wanted.applyInArrow(lean(lambda own, x: equal_runs(length, n)(own, x.rename_columns({"range": "bucket", "bucket": "b"}))), f"b int, {binary(WANTED)}")
    # what a batch is told about ranks and what is wanted of it come as rows of one table
    asked = wanted.select("b", *WANTED, *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("flags", "binary"), ("ranks", "binary"))])
    asked = asked.repartition(n, "b").unionByName(ranks, allowMissingColumns=True)
    send = send_texts(length, bits, n)
    sent = texts.groupBy("b").cogroup(asked.groupBy("b")).applyInArrow(lean(lambda own, x: send(own, x.filter(pc.is_valid(x.column("keys"))), x.filter(pc.is_valid(x.column("flags"))))), f"bucket int, b int, {binary(TEXTS)}")
    spans = by(sent, "bucket").applyInArrow(lean(sorted_buckets(length)), "b int, spans binary")
    done = texts.groupBy("b").cogroup(spans.repartition(n, "b").groupBy("b")).applyInArrow(lean(cut_texts(length)), fields)
    zero = F.lit(0).cast("long")
    whole = rows.where("id is null").select("id", *[f"c{i}" for i in range(len(others))], F.length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"))
    return done.unionByName(whole)


def remove_repeats(documents: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns but the text, then n_bytes, n_removed, n_spans (long) and kept (binary), one row per row of documents.

    A null text counts as empty. Rows with a null id lose nothing and take nothing from others; rows that
    repeat an id take nothing from each other. Texts shorter than length stay whole. An empty table gives no rows. Other columns
    are carried along under their names, unless they are named like the four new ones, in any case: such columns are left out.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    others = [c for c in documents.columns if c not in (id_col, text_col) and c.lower() not in new]
    out = _cut(documents, length, id_col, text_col, others)
    return out.select(F.col("id").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], *new)


def documents_without_repeats(documents: DataFrame, length: int = 50) -> DataFrame:
    """documents with shortened texts and n_chars, if there is one, brought up to date; all other columns stay, whatever their names.

    Of a character that was cut into, no byte stays. Null texts become empty ones. Null and repeated ids and empty tables as for remove_repeats().
    """
    others = [c for c in documents.columns if c not in ("doc_id", "text", "n_chars")]
    out = _cut(documents, length, "doc_id", "text", others)
    whole = F.expr("try_validate_utf8(cast(kept as string))")
    partial = F.regexp_replace(F.expr("make_valid_utf8(cast(kept as string))"), r"[\x{FFFD}]+", "")
    out = out.withColumn("text", F.coalesce(whole, partial))
    made = {"doc_id": F.col("id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    return out.select(*[made[c].alias(c) for c in documents.columns])
