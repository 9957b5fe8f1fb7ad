"""Helpers that the corpus operators share: shared-folder tables, sizing and byte-level words."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The bytes that separate words, \x20 and \x09-\x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

#: Bytes A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PIECE_BYTES = 1 << 16  # bytes that are worked on at once, in the processor's cache

BATCH_BYTES, _BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: A Java regex for one word: a maximal run without the separators above.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where a local session names none (a test), a temporary folder of this machine is set; a cluster has to name one.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext._jsc.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def hold_batches(spark: SparkSession) -> None:
    """Holds the Arrow batches of the session to BATCH_BYTES, so that Python workers see long texts a few at a time."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors.

    The folder goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


#: What workers keep from one task to the next; a lean task drops it.
REMEMBERED: list[dict] = []


def give_back() -> None:
    """Gives the memory that a worker has freed back to the system. Workers outlive tasks and operators, and would hold the most that each has taken."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def forget() -> None:
    for held in REMEMBERED:
        held.clear()


def lean(f: Callable, forgets: bool = True) -> Callable:
    """f of one group, of two, or of an iterator of batches, for a worker that drops what is remembered (if forgets) and gives memory back when f is done."""

    def one(rows: pa.Table) -> pa.Table:
        if forgets:
            forget()
        out = f(rows)
        give_back()
        return out

    def two(rows: pa.Table, others: pa.Table) -> pa.Table:
        if forgets:
            forget()
        out = f(rows, others)
        give_back()
        return out

    def each(batches: Iterator) -> Iterator:
        if forgets:
            forget()
        yield from f(batches)
        give_back()

    return each if inspect.isgeneratorfunction(f) else two if len(inspect.signature(f).parameters) == 2 else one


def partitions_for(df: DataFrame, times: int = 1, mb: int = 64) -> int:
    """Shuffle partitions for df with each row `times` times: the session's number, or more if one would exceed mb of stored input."""
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # an unknown size is reported as a huge number; the session's own setting holds then
    stored = stored if stored < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored * times // (mb << 20)))


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one text after the other, and the len + 1 offsets. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most so many bytes of text, one row at least, to bound memory."""
    if not batch.num_rows:
        return
    _, ends = string_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z, as LOWER has them; by arithmetic, a piece in the cache at a time, which is faster than to look each byte up."""
    out = np.empty_like(data)
    for at in range(0, len(data), PIECE_BYTES):
        x = data[at : at + PIECE_BYTES]
        np.add(x, ((x - np.uint8(65)) < np.uint8(26)).view(np.uint8) << np.uint8(5), out=out[at : at + PIECE_BYTES])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of every text, and for each text the index of its first word (len + 1 numbers).

    A word never crosses the border of two texts.
    """
    n = len(data)
    if is_space is IS_SPACE:
        inside = np.empty(n, dtype=bool)
        for at in range(0, n, PIECE_BYTES):
            x = data[at : at + PIECE_BYTES]
            np.logical_and(x != np.uint8(32), (x - np.uint8(9)) > np.uint8(4), out=inside[at : at + PIECE_BYTES])
    else:
        inside = ~is_space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < n]
    first[borders] = inside[borders]
    starts = np.flatnonzero(first)
    # a word's last byte stands before a space, a text border or the end of the data
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = borders[borders > 0] - 1
    last[before] = inside[before]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: What is kept of eight bytes of which only the first k belong to a word, and the bytes up to which words are hashed in numpy.
_FIRST_BYTES, _SHORT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64), 256


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit multiply-xorshift hash; x itself stays as it is."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: The mixed lengths that hashes begin with.
_LENGTHS = mix(np.arange(_SHORT + 1, dtype=np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length: eight bytes at a time are mixed into what came before, words of over _SHORT bytes by XXH64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eights = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = np.empty(len(starts), np.uint64)
    for s in range(0, len(starts), PIECE_BYTES // 8):
        own = slice(s, s + PIECE_BYTES // 8)
        at, rest = starts[own], ends[own] - starts[own]
        # the first eight bytes of all words, then what is left of the longer ones
        hashes = _LENGTHS[np.minimum(rest, _SHORT)]
        hashes ^= eights[at] & _FIRST_BYTES[np.minimum(rest, 8)]
        hashes = mix(hashes)
        live = np.flatnonzero((rest > 8) & (rest <= _SHORT))
        at, rest = at[live] + 8, rest[live] - 8
        while len(live):
            hashes[live] = mix(hashes[live] ^ (eights[at] & _FIRST_BYTES[np.minimum(rest, 8)]))
            on = rest > 8
            live, at, rest = live[on], at[on] + 8, rest[on] - 8
        out[own] = hashes
    for i in np.flatnonzero(ends - starts > _SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return out


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The number of every word of a string column, by content; the index of each text's first word (len + 1 numbers); the distinct words."""
    lists = pc.ascii_split_whitespace(column.fill_null("").cast(pa.large_string()))
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    found = words.filter(pa.array(real)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(real))[offsets], found.dictionary


def block_pairs(rows: DataFrame, group: str, member: str, weight: Column, most: int) -> DataFrame:
    """rows with pair: each group is cut into k blocks of about `most` weight, and a member stands once in each pair of blocks with its own.

    Any two members of a group meet in some pair, and no pair has more than two blocks, however large the group is. Groups of one block have pair 0.
    """
    whole = rows.groupBy(group).agg(F.sum(weight).alias("weight__")).where(F.col("weight__") > most)
    large = materialise(whole.select(F.col(group).alias("group__"), F.ceil(F.col("weight__") / most).cast("int").alias("k__")), "large-groups")
    joined = rows.join(large, F.col(group) == F.col("group__"), "left")
    k = F.coalesce("k__", F.lit(1))
    own = F.pmod(F.xxhash64(F.col(member), F.lit(5)), k).cast("int")
    other = F.explode(F.sequence(F.lit(0), k - 1))
    out = joined.withColumn("own__", own).withColumn("other__", other)
    pair = F.least("own__", "other__") * F.coalesce("k__", F.lit(1)) + F.greatest("own__", "other__")
    return out.select(*rows.columns, pair.cast("long").alias("pair"), (F.col("k__").isNotNull()).alias("split"))
