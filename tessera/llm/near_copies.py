"""Near copies by exact similarity: groups of documents whose word shingles have a Jaccard similarity of a limit or more.

Candidates come from two sources: SimHashes within a radius (see simhash), and BANDS MinHash bands of ROWS values each, which
reach the similarities whose SimHashes lie further apart: a pair of similarity s meets in no band with a chance of
(1 - s^ROWS)^BANDS, 5 in 10^6 at 0.8. Candidates only form clusters; inside a cluster every link is a pair whose shingle sets
(64-bit hashes) reach the limit. A cluster is searched breadth first, so its pairs are never rows; one whose shingles are over
BLOCK_BYTES is cut into blocks, and each pair of blocks is searched by a task of its own. Work runs on distinct shingle sets,
and only those with a candidate travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import LOWER, block_pairs, hold_batches, lean, materialise, mix, slices, string_bytes, word_hashes, words_of

ROWS, BANDS = 6, 40
BLOCK_BYTES = 4 << 20  # of shingles
_FACTORS = np.random.Generator(np.random.PCG64(8)).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted within each text, and the len + 1 offsets.

    A text of fewer words than width has one shingle, all of its words; one without words has none.
    """
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    texts = len(n_words)
    size = np.minimum(n_words, width)
    counts = np.where(n_words > 0, n_words - size + 1, 0)
    owner = np.repeat(np.arange(texts), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][owner]
    keys = np.full(len(owner), np.uint64(width))
    for i in range(width):
        some = np.flatnonzero(size[owner] > i)
        keys[some] = mix(keys[some] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[some] + i])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[fresh], owner[fresh]
    return keys, np.append(0, np.cumsum(np.bincount(owner, minlength=texts))).astype(np.int64)


def set_keys(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; zero for an empty one."""
    out, full = np.zeros(len(offsets) - 1, dtype=np.uint64), np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(keys ^ np.uint64(0x94D049BB133111EB)), offsets[full]) + np.diff(offsets)[full].astype(np.uint64))
    return out


def band_keys(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set a 64-bit hash of the MinHash values of every band, the band's number included."""
    out, full = np.zeros((len(offsets) - 1, BANDS), dtype=np.uint64), np.flatnonzero(np.diff(offsets))
    if len(full):
        begins = offsets[full]
        for band in range(BANDS):
            held = np.full(len(full), np.uint64(band + 1))
            for factor in _FACTORS[band]:
                held = mix(held * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(keys * factor, begins))
            out[full, band] = held
    return out


def marks_of(documents: DataFrame, width: int) -> DataFrame:
    """(id, key, fp, bands) of every row with an id: its shingle set's hash, its SimHash and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = string_bytes(batch.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                prints = np.array([simhash.fingerprint(raw[a:b], width) for a, b in zip(at, at[1:], strict=False)], dtype=np.uint64)
                found = shingle_sets(data, offsets, width)
                bands = band_keys(*found)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * np.int32(BANDS)), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(set_keys(*found).view(np.int64)), pa.array(prints.view(np.int64)), lists], ["id", "key", "fp", "bands"])

    return documents.mapInArrow(lean(run), "id long, key long, fp long, bands array<long>")


def sets_of(documents: DataFrame, width: int) -> DataFrame:
    """(key, shingles) of every row, the shingles as 8-byte numbers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                keys, offsets = shingle_sets(*string_bytes(batch.column("text")), width)
                raw, at = keys.tobytes(), (offsets * 8).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(keys, offsets).view(np.int64)), pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["key", "shingles"])

    return documents.mapInArrow(lean(run), "key long, shingles binary")


def groups_within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of its group: sets that chains of pairs with a Jaccard similarity of percent or more connect."""
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    group, member = np.full(len(sets), -1), np.zeros(int(flat.max(initial=-1)) + 1, dtype=bool)
    left = np.arange(len(sets))
    while len(left):
        root, frontier, left = left[0], [left[0]], left[1:]
        group[root] = root
        while frontier and len(left):
            one = frontier.pop()
            own = flat[begins[one] : begins[one] + sizes[one]]
            # the smaller set must have its share of the larger one's size
            fits = left[(100 * sizes[left] >= percent * sizes[one]) & (100 * sizes[one] >= percent * sizes[left]) & (sizes[left] > 0)]
            if not len(fits):
                continue
            member[own] = True
            ends = np.cumsum(sizes[fits])
            at = np.arange(ends[-1]) + np.repeat(begins[fits] - (ends - sizes[fits]), sizes[fits])
            common = np.add.reduceat(member[flat[at]], ends - sizes[fits], dtype=np.int64)
            member[own] = False
            found = fits[100 * common >= percent * (sizes[fits] + sizes[one] - common)]
            group[found] = root
            frontier.extend(found.tolist())
            left = left[group[left] < 0]
    return group


def candidate_clusters(marks: DataFrame, radius: int) -> DataFrame:
    """(node, root) of every shingle set that shares a band with another or whose SimHash lies near another's."""
    distinct = marks.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    keyed = distinct.where("key <> 0").select("key", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("band", "low")
    # as a table of its own it leaves the join two plain shuffles, so a band that very many sets share can be split
    edges = keyed.join(materialise(shared, "near-bands"), "band").select(F.col("key").alias("a"), F.col("low").alias("b"))
    near = materialise(simhash.links(distinct.select("fp").distinct(), radius), "near-links")
    prints = distinct.select("key", "fp")
    low = prints.groupBy("fp").agg(F.min("key").alias("low"))
    edges = edges.union(prints.join(low, "fp").select(F.col("key").alias("a"), F.col("low").alias("b")))
    ends = near.join(low.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    edges = edges.union(ends.select("x", "y")).where("a <> b").distinct()
    return materialise(simhash.components(materialise(edges, "near-edges")), "near-clusters")


def groups(documents: DataFrame, width: int, radius: int, percent: int) -> DataFrame:
    """(doc_id, component_id) of every row of documents with an id: the smallest id of its group.

    Null and empty texts are one group of sets without shingles. Repeated rows stay; an empty table gives no rows; extra columns are ignored.
    """
    hold_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    marks = materialise(marks_of(rows, width), "near-marks")
    lowest = marks.groupBy("key").agg(F.min("id").alias("low"))
    clusters = candidate_clusters(marks, radius)
    wanted = clusters.join(lowest, clusters.node == lowest.key).select("key", "root", "low")
    wanted = materialise(wanted, "near-wanted")
    sets = sets_of(rows.join(wanted.select(F.col("low").alias("id")).distinct(), "id"), width)
    dealt = materialise(wanted.join(sets, "key").dropDuplicates(["key"]).select("root", "key", "low", "shingles"), "near-sets")
    paired = block_pairs(dealt, "root", "key", F.length("shingles") + 64, BLOCK_BYTES)

    def verified(cluster: pa.Table) -> pa.Table:
        keys, low = cluster.column("key").to_numpy(), cluster.column("low").to_numpy()
        found = groups_within([np.frombuffer(x, "<u8") for x in cluster.column("shingles").to_pylist()], percent)
        best = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(best, found, low)
        return pa.table({"key": keys, "head": keys[found], "low": best[found], "split": cluster.column("split")})

    found = materialise(paired.groupBy("root", "pair").applyInArrow(lean(verified), "key long, head long, low long, split boolean"), "near-groups")
    far = found.where("not split").select("key", F.col("low").alias("group"))
    links = found.where("split and key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    if not links.isEmpty():
        # the pairs of blocks of a large cluster give links, not groups
        roots = materialise(simhash.components(links), "near-roots")
        least = found.where("split").groupBy("key").agg(F.min("low").alias("low"))
        of_root = roots.join(least, roots.node == least.key).groupBy("root").agg(F.min("low").alias("group"))
        far = far.union(roots.join(of_root, "root").select(F.col("node").alias("key"), "group"))
    # sets of one row without a candidate are their own group; a table of the rest leaves the last join one plain shuffle
    several = marks.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("rows")).join(far, "key", "left").where("rows > 1 or group is not null")
    several = materialise(several.select("key", F.coalesce("group", "low").alias("group")), "near-several")
    return marks.join(several, "key", "left").select(F.col("id").alias("doc_id"), F.coalesce("group", "id").alias("component_id"))


def one_of_each_group(documents: DataFrame, width: int = 5, radius: int = 6, percent: int = 80) -> DataFrame:
    """The documents that are the smallest id of their group, with all columns; rows with a null id all stay.

    Rows that repeat an id stay or go together: they go if one of their texts is in a group of a smaller id. Cases as for groups().
    """
    gone = groups(documents, width, radius, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti")
