"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors are dealt by their length into buckets of similar length, each packed into one row. A query's score to beat is
its k-th best among the longest vectors of its dimension. Divided by the query's length and a bucket's, it is that bucket's local
cosine threshold, which picks the pruning:

* above 1, no vector of the bucket is long enough: the bucket is skipped; a block of queries doesn't travel to a bucket that all of them skip;
* low, only lengths prune: a vector must be at least as long as score / |query|;
* high, coordinates prune too: on the query's largest coordinates, a unit vector within the threshold lies in an interval.

What is left is verified by integer products. Pruning keeps ties, so results are exact. Queries are a stated set and
meet the buckets in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

SCALE = 256
BUCKET_ROWS, BLOCK_ROWS = 4096, 256
FOCUS = 4  # coordinates that prune
COSINE = 0.2  # the local threshold from which coordinates prune more than they cost
SLACK = 1e-9  # for rounding, in favour of keeping
EXACT = float(1 << 52)  # products of lengths below this have exact double sums
LONG = (1 << 63) - 1


def usable(vector: str) -> Column:
    """Neither the vector nor a component is null, and every component is finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def scaled(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); infinite where that is beyond a double."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * rows)


def whole(x: float) -> int:
    """floor(SCALE * x) of any finite double."""
    return math.floor(x * SCALE) if abs(x) < EXACT else int(x) * SCALE


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products of raw vectors by Python's integers, held to the range of a long."""
    own = [whole(x) for x in query.tolist()]
    return np.array([max(-LONG - 1, min(LONG, sum(whole(a) * b for a, b in zip(row, own, strict=True)))) for row in rows.tolist()], dtype=np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:  # the k-th highest bounds what needs sorting
        near = scores >= np.partition(scores, -k)[-k]
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -LONG - 1 else -scores))[:k]
    return ids[order], scores[order]


def length_of(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((rows * rows).sum(axis=-1))


class Bucket:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        whole_rows = scaled(rows)
        lengths = length_of(whole_rows)
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.raw, self.rows, self.lengths = ids[order], rows[order], whole_rows[order], lengths[order]
        with np.errstate(invalid="ignore"):
            self.units = np.ascontiguousarray((self.rows / np.maximum(self.lengths, 1e-300)[:, None]).T)

    def search(self, query_id: int, raw: np.ndarray, to_beat: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of this bucket's vectors that can reach the score to beat."""
        query = scaled(raw)
        length = float(length_of(query))
        reach = length * self.lengths[0] if length else 0.0
        exact = reach < EXACT and length < EXACT and self.lengths[0] < EXACT
        left = np.arange(len(self.ids))
        if not np.isfinite(reach):
            to_beat = -1.0  # lengths beyond a double prune nothing
        if to_beat > 0:
            if to_beat > reach * (1 + SLACK):
                return self.ids[:0], np.zeros(0, np.int64)
            # lengths fall, so the vectors that are long enough come first
            left = left[: np.searchsorted(-self.lengths, -to_beat / (length * (1 + SLACK)), side="right")]
            cosine = to_beat / reach
            if cosine >= COSINE and len(left):
                unit = query / length
                rest = max(0.0, 1 - cosine * cosine)
                for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
                    middle, half = unit[f] * cosine, np.sqrt(rest * max(0.0, 1 - unit[f] ** 2))
                    # one-sided: a unit vector may also be nearer than the threshold, up to the query itself
                    x = self.units[f][left]
                    low = -1.0 if -unit[f] >= cosine else middle - half
                    high = 1.0 if unit[f] >= cosine else middle + half
                    left = left[(x >= low - SLACK) & (x <= high + SLACK)]
        left = left[self.ids[left] != query_id]
        scores = (self.rows[left] @ query).astype(np.int64) if exact else products(self.raw[left], raw)
        return best(self.ids[left], scores, k)


def unpacked(ids: bytes, rows: bytes, dim: int) -> Bucket:
    numbers = np.frombuffer(ids, "<i8")
    return Bucket(numbers, np.frombuffer(rows, "<f8").reshape(len(numbers), dim))


def pack_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, id, vector) of one range of lengths as rows (part, dim, ids, rows) of at most BUCKET_ROWS vectors."""
    part = TaskContext.get().partitionId()
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            for at in range(0, own.num_rows, BUCKET_ROWS):
                x = own.slice(at, BUCKET_ROWS)
                row = [pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([x.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([matrix(x.column("vector"), dim).astype("<f8").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*row, pa.array([float(length_of(scaled(matrix(x.column("vector"), dim))).max())])], ["part", "dim", "ids", "rows", "longest"])


def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, id, vector, mark) as blocks of at most BLOCK_ROWS queries of one dimension."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == d))
            for at in range(0, own.num_rows, BLOCK_ROWS):
                x = own.slice(at, BLOCK_ROWS)
                blobs = (x.column("id").to_numpy().astype("<i8"), x.column("mark").to_numpy().astype("<i8"), matrix(x.column("vector"), d).astype("<f8"))
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in blobs)], ["dim", "queries", "marks", "vectors"])


def first_scores(k: int):
    """Adds to blocks of queries, each beside the longest vectors of its dimension, every query's k-th best score there, or the lowest
    long, and the length from which a bucket can hold a better one for any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d, longest = row["dim"], unpacked(row["ids"], row["rows"], row["dim"])
                numbers = np.frombuffer(row["queries"], "<i8")
                vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(numbers), d)
                to_beat = np.full(len(numbers), -float(LONG) - 1)
                for i, (q, v) in enumerate(zip(numbers.tolist(), vectors, strict=True)):
                    _, scores = longest.search(q, v, -1.0, k)
                    to_beat[i] = float(scores[-1]) if len(scores) == k else to_beat[i]
                lengths = length_of(scaled(vectors))
                reach = np.where((to_beat > 0) & np.isfinite(lengths) & (lengths > 0), to_beat / np.maximum(lengths, 1e-300), -1.0)
                blobs = (row["queries"], row["marks"], row["vectors"], to_beat.astype("<f8").tobytes())
                columns = [pa.array([d], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs), pa.array([float(reach.min(initial=np.inf)) * (1 - SLACK)])]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "queries", "marks", "vectors", "to_beat", "least"])

    return run


def search_buckets(k: int):
    """Rows that hold a bucket and a block of queries, to (query_id, mark, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                bucket = unpacked(row["ids"], row["rows"], dim)
                queries, marks = np.frombuffer(row["queries"], "<i8"), np.frombuffer(row["marks"], "<i8")
                vectors, to_beat = np.frombuffer(row["vectors"], "<f8").reshape(len(queries), dim), np.frombuffer(row["to_beat"], "<f8")
                found = [bucket.search(q, v, t, k) for q, v, t in zip(queries.tolist(), vectors, to_beat.tolist(), strict=True)]
                sizes = [len(x) for x, _ in found]
                out = (np.repeat(queries, sizes), np.repeat(marks, sizes), np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found]))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["query_id", "mark", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows by integer inner product.

    Components count as floor(256 * x). Vectors that are null or hold null or non-finite components, and rows with a
    null id, take no part. Vectors of different dimension don't meet. The query's own row is every row with its id; identical query rows
    give one list, query rows that share an id but not a vector one list each. Fewer than k candidates give fewer rows, none
    give none. Scores beyond a long are held to its range.
    """
    spark = vectors.sparkSession
    rows = vectors.where(is_query.isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & usable("vector")).withColumn("dim", F.size("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    count = rows.count()
    parts = max(1, -(-count // BUCKET_ROWS))
    # the second key deals out vectors of one length that very many rows share
    dealt = rows.select("dim", "id", "vector", (-norm).alias("by")).repartitionByRange(parts, "by", F.xxhash64("id")).drop("by")
    buckets = materialise(dealt.mapInArrow(pack_buckets, "part int, dim int, ids binary, rows binary, longest double"), "topk-buckets")
    queries = rows.where("is_query").select("dim", "id", "vector", F.xxhash64("vector").alias("mark")).dropDuplicates(["id", "mark"])
    blocks = queries.mapInArrow(pack_queries, "dim int, queries binary, marks binary, vectors binary")
    # each dimension's longest vectors, once for each of a few shares of its blocks
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = buckets.select("part", "dim", "longest", F.xxhash64("ids").alias("one"))
    first = sizes.groupBy("dim").agg(F.max(F.struct("longest", "one")).alias("x")).select("dim", F.col("x.one").alias("one"))
    first = buckets.withColumn("one", F.xxhash64("ids")).join(first, ["dim", "one"]).dropDuplicates(["dim"]).select("dim", "ids", "rows", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    beside = blocks.withColumn("share", F.pmod(F.xxhash64("queries"), F.lit(shares)).cast("int")).join(first, ["dim", "share"])
    blocks = beside.mapInArrow(first_scores(k), "dim int, queries binary, marks binary, vectors binary, to_beat binary, least double")
    blocks = materialise(blocks, "topk-queries")
    # the pairs of a block and a bucket that can matter, before either travels
    meets = blocks.join(sizes, "dim").where("longest >= least").join(buckets.select(F.xxhash64("ids").alias("one"), "part", "dim", "ids", "rows"), ["part", "dim", "one"])
    found = meets.mapInArrow(search_buckets(k), "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
