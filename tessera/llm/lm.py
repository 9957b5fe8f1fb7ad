"""Language-model scores: a smoothed unigram base and a hashed maximum-entropy model.

The model predicts a token by a class-factored softmax of three steps, each over CLASSES choices and each trained on the same
context features (the word before, the two words before, the word before that one alone), hashed to rows of a table:
p(token) = p(class | context) * p(group | class, context) * p(leaf | class, group, context) * p(token | leaf). Classes hold the
words of some last two bytes, groups and leaves are bits of the word's hash, so that every step's features tell apart words of
one class; only the words of one leaf, of some 4000, share by their smoothed counts. The end of a text is a class of its own. The
tables' rows grow with the training bytes between two documented bounds. Training starts from the frequencies of classes,
groups and leaves; in each round every partition takes gradient steps over all its training texts, and a weight's new value is the mean
of the partitions' values, weighted by how often each has met the feature. Word counts are exact: batches of texts
exchange packed lists of distinct words with the counting tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hold_batches, lowered, materialise, mix, slices, string_bytes, word_hashes, words_of

BATCH_TEXT, LEAST_TEXT = 4 << 20, 1 << 17  # bytes in a batch; batches are no smaller to have one for each shuffle partition
ADD = 0.1  # fixed value: added to every count
CHOICE_BITS = 4
CLASSES = 1 << CHOICE_BITS
STEPS = 3  # class, group, leaf
LEAVES = CLASSES**STEPS
END_LEAF = LEAVES - CLASSES * CLASSES  # the last class holds the end alone
ROW_BITS, MOST_ROW_BITS, ROW_TEXT = 16, 18, 1 << 13  # a step's table has a row for each ROW_TEXT bytes of training texts, within 2 ** these
SHARD = 1 << 14  # rows of a table that are added in one piece
ROUNDS = 2
RATE, DAMPING = 1.0, 30.0  # of a step; a feature met n times moves by the mean over n + DAMPING
MINIBATCH = 1 << 13
PIECE = 1 << 13  # tokens whose features are hashed at once, in the processor's cache
FAN_IN = 64
TRAIN_TEXT = 32 << 20  # bytes that one training task reads: each sends all rows it met, so larger tasks send less
END, BEFORE = np.uint64(0x51ED270B0A1F39C1), np.uint64(0x2545F4914F6CDD1D)


#: The class of words by their last byte and, in the low bits, the byte before it (0 if there is none).
CLASS_OF = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(CLASSES - 1)).astype(np.int64)


class Tokens:
    """The words of some texts, and the sequence of all tokens: each text's words, then its end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = lowered(data)
        self.starts, self.ends, first = words_of(self.data, offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.texts = len(offsets) - 1
        self.n_words = np.diff(first)
        self.owner = np.repeat(np.arange(self.texts), self.n_words)
        self.place = np.arange(len(self.hashes)) + self.owner  # of each word in the sequence
        self.end_place = first[1:] + np.arange(self.texts)

    def leaves(self) -> np.ndarray:
        """The leaf of every word: a class by the last two bytes, then eight bits of the word's hash."""
        out = np.empty(len(self.hashes), np.int64)
        for at in range(0, len(out), PIECE):
            cut = slice(at, at + PIECE)
            ends = self.ends[cut]
            before = self.data[np.maximum(ends - 2, 0)] * (ends - self.starts[cut] > 1)
            out[cut] = CLASS_OF[self.data[ends - 1].astype(np.int64) << 8 | before] << 2 * CHOICE_BITS
            out[cut] |= (self.hashes[cut] >> np.uint64(64 - 2 * CHOICE_BITS)).astype(np.int64)
        return out

    def sequence(self, bits: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The leaf of each token, and for each step of its tokens the choice, the table rows of its three features and the node where it chooses.

        The first step has all tokens, the others only the words, in their order.
        """
        n = len(self.hashes) + self.texts
        hashes, leaves = np.full(n, END), np.full(n, END_LEAF)
        hashes[self.place], leaves[self.place] = self.hashes, self.leaves()
        begin = np.append(0, self.end_place[:-1] + 1)[: self.texts]
        one, two = np.full(n, BEFORE), np.full(n, BEFORE)
        one[1:], two[2:] = hashes[:-1], hashes[:-2]
        one[begin] = two[begin] = BEFORE
        second = begin[begin < self.end_place] + 1  # a text's second token has one word before it
        two[second] = BEFORE
        shift = np.uint64(64 - bits)
        # a feature's numbers lie side by side, and a piece of the sequence goes through all steps while it is in the cache
        words = leaves[self.place]
        nodes = [np.zeros(n, np.int64), *(words >> (STEPS - step) * CHOICE_BITS for step in range(1, STEPS))]
        found = [np.empty((3, len(node)), np.int32) for node in nodes]
        salts = [mix(np.arange(CLASSES**step, dtype=np.uint64) + np.uint64(step << 32)) for step in range(STEPS)]
        features, bounds = np.empty((3, min(n, PIECE)), np.uint64), np.searchsorted(self.place, np.arange(0, n + PIECE, PIECE))
        for k, at in enumerate(range(0, n, PIECE)):
            cut, own = slice(at, at + PIECE), slice(bounds[k], bounds[k + 1])
            here = features[:, : min(PIECE, n - at)]
            here[0] = mix(one[cut] + np.uint64(1))
            here[1] = mix(one[cut] * np.uint64(0x9E3779B97F4A7C15) + two[cut])
            here[2] = mix(two[cut] ^ np.uint64(0xA5A5A5A5))
            found[0][:, cut] = here >> shift
            here = np.take(here, self.place[own] - at, axis=1)
            for step in range(1, STEPS):
                found[step][:, own] = mix(here ^ salts[step][nodes[step][own]]) >> shift
        choices = [leaves >> (STEPS - 1) * CHOICE_BITS, *(words >> (STEPS - 1 - step) * CHOICE_BITS & CLASSES - 1 for step in range(1, STEPS))]
        steps = [(choice, rows.T, node) for choice, rows, node in zip(choices, found, nodes, strict=True)]
        return leaves, steps


@dataclass
class Model:
    """weights: a table of CLASSES columns for each step; bias: for each step the log shares of the choices at every node; sums, known: counts and distinct words of each leaf."""

    weights: np.ndarray
    bias: list[np.ndarray]
    sums: np.ndarray
    known: np.ndarray
    ends: int

    @property
    def bits(self) -> int:
        return self.weights.shape[1].bit_length() - 1


def untrained(sums: np.ndarray, known: np.ndarray, ends: int, bits: int) -> Model:
    counts = sums.astype(np.float64)
    counts[END_LEAF] = ends
    bias = []
    for step in range(STEPS):
        own = counts.reshape(CLASSES**step, CLASSES, -1).sum(axis=2)
        bias.append(np.log((own + 1) / (own.sum(axis=1, keepdims=True) + CLASSES)).astype(np.float32))
    return Model(np.zeros((STEPS, 1 << bits, CLASSES), np.float32), bias, sums, known, ends)


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
    z, more = np.take(weights, rows[:, 0], axis=0), np.empty((len(rows), CLASSES), np.float32)
    for table, row in ((weights, rows[:, 1]), (weights, rows[:, 2]), (bias, node)):
        z += np.take(table, row, axis=0, out=more, mode="clip")  # rows are always within the table; the mode lets take write into more at once
    np.clip(z, -80, 80, out=z)  # exp and its sum stay finite and above zero
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(CLASSES, np.float32)))[:, None]
    return z


def learn(weights: np.ndarray, met: np.ndarray, bias: np.ndarray, choice: np.ndarray, rows: np.ndarray, node: np.ndarray) -> None:
    """Gradient steps of one table, in place; met counts how often each row was a feature."""
    # a complex number holds two neighbouring columns, which halves the additions
    as_pairs = lambda x: x.view(np.complex64)
    as_rows = lambda x: x.view(np.dtype((np.void, 4 * CLASSES))).ravel()
    whole, last = as_rows(weights), np.zeros(len(weights), np.int32)
    for at in range(0, len(choice), MINIBATCH):
        cut = slice(at, at + MINIBATCH)
        features = rows[cut].T.astype(np.int64, order="C")
        error = probabilities(weights, bias, features.T, node[cut])
        error.ravel()[np.arange(0, error.size, CLASSES) + choice[cut]] -= 1
        # the errors of all tokens with the same row are added up at the last of them, so that each row is written once
        token, features = np.tile(np.arange(len(error)), len(features)), features.ravel()
        number = np.arange(len(features), dtype=np.int32)
        last[features] = number
        is_last = np.take(last, features) == number
        once, again = np.flatnonzero(is_last), np.flatnonzero(~is_last)
        row, step = np.take(features, once), np.take(error, np.take(token, once), axis=0)
        last[row] = number[: len(once)]
        heir, more = np.take(last, np.take(features, again)).astype(np.int64), np.take(error, np.take(token, again), axis=0)
        for column in range(CLASSES // 2):
            np.add.at(as_pairs(step)[:, column], heir, as_pairs(more)[:, column])
        now = np.take(met, row) + (1 + np.bincount(heir, minlength=len(once))).astype(met.dtype)
        met[row] = now
        step *= (-np.float32(RATE) / (now + np.float32(DAMPING)))[:, None]
        step += np.take(weights, row, axis=0)
        whole[row] = as_rows(step)


def distinct_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An occurrence of each different hash, in their order, and for every hash the number of its own; equal ones needn't keep their order, so the sort is a fast one."""
    order = np.argsort(hashes)
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[order[1:]] != hashes[order[:-1]]
    number = np.empty(len(hashes), dtype=np.int64)
    number[order] = np.cumsum(first) - 1
    return order[first], number


def batch_words(rows: pa.Table) -> tuple[pa.Table, Tokens, np.ndarray, np.ndarray]:
    """A batch in a fixed order: its rows, tokens, an occurrence of each distinct word, and each word's number."""
    rows = rows.combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
    column = rows.column("text").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    tokens = Tokens(*string_bytes(column))
    return rows, tokens, *distinct_of(tokens.hashes)


def by_bucket(tokens: Tokens, sample: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the distinct words by bucket, and the buckets in that order."""
    bucket = (tokens.hashes[sample] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def send_words(buckets: int):
    """One row for each bucket: the batch's distinct words, their leaves and their counts in training texts."""

    def run(rows: pa.Table) -> pa.Table:
        rows, tokens, sample, number = batch_words(rows)
        train = rows.column("train").to_numpy()
        counts = np.bincount(number, train[tokens.owner], len(sample)).astype("<u4")
        leaves = tokens.leaves()[sample].astype("<u2")
        order, bucket = by_bucket(tokens, sample, buckets)
        raw, starts, ends = tokens.data.tobytes(), tokens.starts[sample], tokens.ends[sample]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(order)).tolist()
        b, out = rows.column("b")[0].as_py(), []
        for s, e in zip(cuts, cuts[1:], strict=False):
            own = order[s:e]
            words = b" ".join([raw[x:y] for x, y in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            out.append({"bucket": int(bucket[s]), "b": b, "words": words, "leaves": leaves[own].tobytes(), "counts": counts[own].tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int32()), ("b", pa.int32()), *((c, pa.binary()) for c in ("words", "leaves", "counts"))]))

    return run


def add_counts(rows: pa.Table) -> pa.Table:
    """The totals of one bucket's words, sent back to each batch; one row without b has the counts and distinct words of each leaf it met."""
    number: dict[bytes, int] = {}
    lists = [x.split(b" ") for x in rows.column("words").to_pylist()]
    places = [np.array([number.setdefault(w, len(number)) for w in words]) for words in lists]
    totals, kinds = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
    for place, counts, leaves in zip(places, rows.column("counts").to_pylist(), rows.column("leaves").to_pylist(), strict=True):
        totals[place] += np.frombuffer(counts, "<u4")
        kinds[place] = np.frombuffer(leaves, "<u2")
    found, place = np.unique(kinds[totals > 0], return_inverse=True)
    sums, known = np.zeros(len(found), np.int64), np.bincount(place, minlength=len(found))
    np.add.at(sums, place, totals[totals > 0])
    wide = "<u4" if not len(totals) or totals.max() < 1 << 32 else "<u8"
    back = [{"b": b, "bucket": k, "totals": wide[-1].encode() + totals[p].astype(wide).tobytes(), "leaves": None} for b, k, p in zip(rows.column("b").to_pylist(), rows.column("bucket").to_pylist(), places, strict=True)]
    back.append({"b": None, "bucket": None, "totals": None, "leaves": [{"leaf": x, "sum": y, "known": z} for x, y, z in zip(found.tolist(), sums.tolist(), known.tolist(), strict=True)]})
    return pa.Table.from_pylist(back, pa.schema([("b", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("leaves", pa.list_(pa.struct([("leaf", pa.int64()), ("sum", pa.int64()), ("known", pa.int64())])))]))


def train_partition(model: Model):
    """One row for each shard of the tables: the partition's changes, and how often it met each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, met = model.weights.copy(), np.zeros(model.weights.shape[:2], dtype=np.float32)
        for whole in batches:
            for batch in slices(whole, "text"):
                _, steps = Tokens(*string_bytes(batch.column("text"))).sequence(model.bits)
                for step, (choice, rows, node) in enumerate(steps):
                    learn(weights[step], met[step], model.bias[step], choice, rows, node)
        if met.any():
            part = TaskContext.get().partitionId()
            weights -= model.weights
            change, met = weights.reshape(-1, CLASSES), met.reshape(-1)
            for s in range(len(met) // SHARD):
                own = slice(s * SHARD, (s + 1) * SHARD)
                row = [pa.array([s], pa.int32()), pa.array([part], pa.int32()), pa.array([change[own].astype("<f2").tobytes()], pa.binary()), pa.array([met[own].astype("<f4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["shard", "part", "change", "met"])

    return run


def mean_change(changes: list[bytes], times: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of changes of the same rows, weighted by how often each was met, and the sum of those numbers."""
    moved, met = 0.0, 0.0
    for change, n in zip(changes, times, strict=True):
        n = np.frombuffer(n, "<f4").astype(np.float64)
        moved = moved + np.frombuffer(change, "<f2").reshape(-1, CLASSES) * n[:, None]
        met = met + n
    return moved / np.maximum(met, 1)[:, None], met


def add_shards(rows: pa.Table) -> pa.Table:
    """The mean over the rows of one shard and group of parts."""
    change, met = mean_change(rows.column("change").to_pylist(), rows.column("met").to_pylist())
    return pa.table({"shard": rows.column("shard")[:1], "part": rows.column("part")[:1], "change": pa.array([change.astype("<f2").tobytes()], pa.binary()), "met": pa.array([met.astype("<f4").tobytes()], pa.binary())})


def score_batch(model: Model, buckets: int):
    total, distinct = float(model.sums.sum() + model.ends), float(model.known.sum() + (model.ends > 0))
    spread = np.log10(total + ADD * (distinct + 1))
    within, ends = np.log10(model.sums + ADD * (model.known + 1)), model.ends

    def run(rows: pa.Table, counted: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not rows.num_rows:
            return schema.empty_table()
        rows, tokens, sample, number = batch_words(rows)
        order, bucket = by_bucket(tokens, sample, buckets)
        counts = np.zeros(len(sample), dtype=np.float64)
        for k, blob in zip(counted.column("bucket").to_pylist(), counted.column("totals").to_pylist(), strict=True):
            counts[order[np.searchsorted(bucket, k) : np.searchsorted(bucket, k, side="right")]] = np.frombuffer(blob, f"<u{blob[:1].decode()}", offset=1)
        log = np.log10(counts + ADD)[number]
        leaves, steps = tokens.sequence(model.bits)
        picked = []
        for step, (choice, features, node) in enumerate(steps):
            picked.append(np.empty(len(choice)))
            for at in range(0, len(choice), MINIBATCH):
                cut = slice(at, at + MINIBATCH)
                p = probabilities(model.weights[step], model.bias[step], features[cut], node[cut])
                picked[-1][cut] = np.log10(p[np.arange(len(p)), choice[cut]])
        owner, n = tokens.owner, tokens.texts
        base = np.bincount(owner, log - spread, n) + (np.log10(ends + ADD) - spread)
        score = np.bincount(owner, log - within[leaves[tokens.place]] + picked[0][tokens.place] + sum(picked[1:]), n) + picked[0][tokens.end_place]
        n_known = np.bincount(owner, counts[number] > 0, n).astype(np.int64) + (ends > 0)
        return pa.table([rows.column("id"), rows.column("train"), pa.array(tokens.n_words + 1), pa.array(n_known), pa.array(base), pa.array(score)], schema=schema)

    return run


def trained(model: Model, texts: DataFrame) -> Model:
    """The model after one round over all texts."""
    schema = "shard int, part int, change binary, met binary"
    rows = texts.mapInArrow(train_partition(model), schema)
    # a tree of means: no task adds more than FAN_IN pieces of a shard, for up to FAN_IN ** 3 partitions
    for _ in range(3):
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("shard", "part").applyInArrow(add_shards, schema)
    weights = model.weights.copy()
    flat = weights.reshape(-1, CLASSES)
    pieces: dict[int, list] = {}
    for row in rows.collect():  # one row a shard, together half the size of the tables, which MOST_ROW_BITS bounds
        pieces.setdefault(row["shard"], []).append(row)
    for s, own in pieces.items():
        change, met = mean_change([x["change"] for x in own], [x["met"] for x in own])
        flat[s * SHARD : (s + 1) * SHARD] += (change * (met / (met + DAMPING))[:, None]).astype(np.float32)
    return Model(weights, model.bias, model.sums, model.known, model.ends)


def scored(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id as text leaves a remainder by folds. A null text counts as empty: one token, its end.
    A row with a null id is scored as held out. Repeated rows count each time. Without training rows all counts are
    zero. An empty table gives no rows. Extra columns are ignored, whatever their names.
    """
    hold_batches(documents.sparkSession)
    size = documents.select(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n = max(-(-size // BATCH_TEXT), min(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_TEXT)), 1)
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("b"), "id", "text", F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds != 0, F.lit(False)).alias("train"))
    texts = rows.repartition(n, "b")
    sent = texts.groupBy("b").applyInArrow(send_words(n), "bucket int, b int, words binary, leaves binary, counts binary")
    counted = materialise(sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(add_counts, "b int, bucket int, totals binary, leaves array<struct<leaf: long, sum: long, known: long>>"), "lm-counts")
    sums, known = np.zeros(LEAVES, dtype=np.int64), np.zeros(LEAVES, dtype=np.int64)
    per_leaf = counted.where("b is null").select(F.explode("leaves").alias("x")).groupBy("x.leaf").agg(F.sum("x.sum"), F.sum("x.known"))
    for i, s, k in per_leaf.collect():  # LEAVES rows at most
        sums[i], known[i] = s, k
    bits = min(max((size // ROW_TEXT).bit_length(), ROW_BITS), MOST_ROW_BITS)
    model = untrained(sums, known, rows.where("train").count(), bits)
    tasks = max(-(-size // TRAIN_TEXT), documents.sparkSession.sparkContext.defaultParallelism)
    for _ in range(rounds):
        model = trained(model, rows.where("train").select("text").coalesce(tasks))
    out = texts.groupBy("b").cogroup(counted.where("b is not null").select("b", "bucket", "totals").repartition(n, "b").groupBy("b"))
    out = out.applyInArrow(score_batch(model, n), "id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(sums.sum()) + model.ends).cast("long").alias("train_tokens"), "base_score", "score")
