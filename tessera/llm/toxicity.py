"""Toxicity scores by a logistic classifier with counterfactual regularisation.

Features are the distinct words of a text, hashed. In every labelled sentence that names a group, the identity term is swapped
for each other term of its kind and language, which gives the features of a counterfactual text; training adds a penalty on the
squared change of the score from the text to it. So a neutral mention of one group does not raise the score. An L1 penalty leaves
weight only on words with evidence.

Labels are learned from a bounded sample: the training ids with the smallest hashes, `sample_rows` of them at most, with
`sample_words` different words in all. Everything else, the scores above all, covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, hold_batches, materialise, slices, string_bytes, word_hashes, words_of

# Identity terms by kind and language; the terms of a kind stand for each other in a counterfactual.
IDENTITIES = {
    "gender": ("woman", "women", "man", "men", "girl", "boy", "female", "male", "transgender", "nonbinary"),
    "religion": ("muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "buddhist", "sikh", "catholic", "atheist"),
    "origin": ("african", "asian", "american", "european", "arab", "mexican", "chinese", "indian", "black", "white", "latino", "immigrants"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    "ability": ("blind", "deaf", "disabled", "autistic", "sighted", "hearing"),
    "gender, de": ("frau", "frauen", "mann", "männer", "mädchen", "junge", "weiblich", "männlich", "transgeschlechtlich"),
    "religion, de": ("muslim", "muslime", "christ", "christen", "jude", "juden", "jüdisch", "muslimisch", "christlich", "atheist"),
    "origin, de": ("afrikaner", "asiaten", "amerikaner", "europäer", "araber", "türken", "deutsche", "ausländer", "schwarze", "weiße"),
    "orientation, de": ("schwul", "lesbisch", "bisexuell", "queer", "heterosexuell"),
    "ability, de": ("blind", "taub", "behindert", "autistisch", "sehend", "hörend"),
    "gender, fr": ("femme", "femmes", "homme", "hommes", "fille", "garçon", "féminin", "masculin", "transgenre"),
    "religion, fr": ("musulman", "musulmans", "chrétien", "chrétiens", "juif", "juifs", "hindou", "bouddhiste", "catholique", "athée"),
    "origin, fr": ("africain", "asiatique", "américain", "européen", "arabe", "arabes", "chinois", "noir", "blanc", "étrangers"),
    "orientation, fr": ("gay", "lesbienne", "bisexuel", "queer", "hétérosexuel"),
    "ability, fr": ("aveugle", "sourd", "handicapé", "autiste", "voyant", "entendant"),
    "gender, es": ("mujer", "mujeres", "hombre", "hombres", "niña", "niño", "femenino", "masculino", "transgénero"),
    "religion, es": ("musulmán", "musulmanes", "cristiano", "cristianos", "judío", "judíos", "hindú", "budista", "católico", "ateo"),
    "origin, es": ("africano", "asiático", "americano", "europeo", "árabe", "árabes", "chino", "mexicano", "negro", "blanco", "extranjeros"),
    "orientation, es": ("gay", "lesbiana", "bisexual", "queer", "heterosexual"),
    "ability, es": ("ciego", "sordo", "discapacitado", "autista", "vidente", "oyente"),
}
THRESHOLD = 0.3
BUCKETS = 1 << 18
SAMPLE_ROWS, SAMPLE_WORDS = 20_000, 4_500_000
LEAST_DOCS = 3  # a word of fewer training texts gets no weight
SWAPS, ROUNDS = 0.5, 250  # strength of the counterfactual penalty; gradient rounds
L1, L2 = 2e-4, 1e-5

#: Word characters here: letters and digits, and all bytes of longer characters.
BREAKS = np.ones(256, dtype=bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words of the texts: feature numbers text by text, and the len + 1 borders."""
    low = LOWER[data]
    starts, ends, first = words_of(low, offsets, BREAKS)
    numbers = (word_hashes(low, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pairs = np.unique(owner * BUCKETS + numbers)
    return (pairs % BUCKETS).astype(np.int32), np.searchsorted(pairs // BUCKETS, np.arange(len(offsets)))


def feature_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(features(data, np.array([0, len(data)]))[0][0])


def swaps(text: str, kinds: dict[str, tuple[str, ...]]) -> Iterator[tuple[int, int]]:
    """For each sentence and identity term in it, and each term it is swapped for: the feature that the text loses and the one that it gains.

    -1 stands for none: the term also occurs in another sentence, or the other one is there already.
    """
    kinds_of: dict[str, list[str]] = {}
    for kind, terms in kinds.items():
        for term in terms:
            kinds_of.setdefault(term, []).append(kind)
    sentences = [set(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", x)) for x in re.split(r"[.!?\n]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    times = Counter(w for words in sentences for w in words & kinds_of.keys())
    for words in sentences:
        for term in sorted(words & kinds_of.keys()):
            for other in sorted({x for kind in kinds_of[term] for x in kinds[kind]} - words):
                lost, gained = -1 if times[term] > 1 else feature_of(term), -1 if times[other] else feature_of(other)
                if lost != gained:
                    yield lost, gained


class Fit:
    """The objective over a sample: weighted log loss, and the mean squared score change of the counterfactuals, times `strength`.

    swapped: rows (text, feature lost, feature gained), -1 for no feature. Features are numbered from 0 to m - 1.
    """

    def __init__(self, flat: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray, m: int, swapped: np.ndarray, strength: float):
        self.flat, self.owner, self.labels, self.weight, self.m, self.strength = flat, owner, labels, weight, m, strength
        self.text, self.lost, self.gained = swapped.T.astype(np.int64)

    def scores(self, x: np.ndarray, intercept: float) -> np.ndarray:
        return np.bincount(self.owner, x[self.flat], len(self.labels)) + intercept

    def of(self, x: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return np.where(feature >= 0, x[feature], 0)

    def value(self, x: np.ndarray, intercept: float) -> float:
        z = self.scores(x, intercept)
        loss = float(self.weight @ (np.logaddexp(0, z) - self.labels * z))
        if not len(self.text):
            return loss
        change = logistic(z[self.text] - self.of(x, self.lost) + self.of(x, self.gained)) - logistic(z[self.text])
        return loss + self.strength * float(np.mean(change**2))

    def gradient(self, x: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
        z = self.scores(x, intercept)
        score = logistic(z)
        error = self.weight * (score - self.labels)
        more = np.zeros(self.m)
        if len(self.text):
            other = logistic(z[self.text] - self.of(x, self.lost) + self.of(x, self.gained))
            change = 2 * self.strength / len(self.text) * (other - score[self.text])
            there, here = change * other * (1 - other), change * (score * (1 - score))[self.text]
            error = error + np.bincount(self.text, there - here, len(error))
            for feature, sign in ((self.lost, -1), (self.gained, 1)):
                more += sign * np.bincount(feature[feature >= 0], there[feature >= 0], self.m)
        return np.bincount(self.flat, error[self.owner], self.m) + more, float(error.sum())


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(rows: list[np.ndarray], labels: np.ndarray, swapped: np.ndarray, strength: float = SWAPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps; swapped: (text, feature lost, feature gained) of counterfactuals."""
    weights = np.zeros(BUCKETS)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.01
        return weights, float(np.log(share / (1 - share)))
    sizes = np.array([len(x) for x in rows])
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    used = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) >= LEAST_DOCS)
    number = np.full(BUCKETS + 1, -1)  # the last one stands for -1
    number[used] = np.arange(len(used))
    keep = number[flat] >= 0
    flat, owner = number[flat][keep], owner[keep]
    n, m = len(labels), len(used)
    # both classes weigh the same in total, softened so that the scores stay near probabilities
    weight = np.where(labels == 1, np.sqrt((n - labels.sum()) / labels.sum()), 1.0)
    weight /= weight.sum()
    swapped = np.column_stack([swapped[:, 0], number[swapped[:, 1]], number[swapped[:, 2]]]) if len(swapped) else np.zeros((0, 3), np.int64)
    fit = Fit(flat, owner, labels, weight, m, swapped[swapped[:, 1] != swapped[:, 2]], strength)
    w, before, intercept = np.zeros(m), np.zeros(m), float(np.log(labels.mean() / (1 - labels.mean())))
    bias_before = intercept
    # a step for each coordinate, from its share of the curvature
    share = np.bincount(flat, weight[owner], m)
    touched = sum(np.bincount(f[f >= 0], minlength=m) for f in (fit.lost, fit.gained)) / max(1, len(fit.text))
    step = 1.0 / (4 * np.sqrt(share * share.max()) + 2 * strength * touched + L2)
    for t in range(ROUNDS):
        speed = t / (t + 3)
        x, c = w + speed * (w - before), intercept + speed * (intercept - bias_before)
        gradient, slope = fit.gradient(x, c)
        before, bias_before = w, intercept
        moved = x - step * (gradient + L2 * x)
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
        intercept = c - slope
    weights[used] = w
    return weights, intercept


def scored(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS, kinds: dict[str, tuple[str, ...]] = IDENTITIES, strength: float = SWAPS) -> DataFrame:
    """One row per row of documents: doc_id, held_out, score in 0..1, predicted.

    Learns from a sample of at most sample_rows labelled ids whose crc32 as text doesn't leave the remainder held_out by folds, and whose
    texts have at most sample_words distinct words together; a label that is null is none, an id with several labels is toxic if one says so.
    A null or empty text has the score of no words. Rows with a null id are scored as not held out. Without labels of both kinds, all
    scores are the smoothed share of toxic ones. Repeated rows stay; an empty table gives no rows; extra columns are ignored, whatever their names.
    """
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % folds
    chosen = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    chosen = chosen.where(fold(F.col("id")) != held_out).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    hold_batches(documents.sparkSession)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                numbers, borders = features(*string_bytes(batch.column("text")))
                own = [numbers[s:e].astype("<i4").tobytes() for s, e in zip(borders, borders[1:], strict=False)]
                pairs = [np.unique(np.array(list(swaps(x or "", kinds)), dtype="<i4").reshape(-1, 2), axis=0).tobytes() for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(own, pa.binary()), pa.array(pairs, pa.binary())], ["id", "toxic", "words", "pairs"])

    # the ids are at most sample_rows, so the side that is broadcast is bounded
    sample = rows.join(F.broadcast(chosen), "id").select("id", "toxic", "text").mapInArrow(labelled, "id long, toxic int, words binary, pairs binary")
    sample = materialise(sample.withColumn("place", F.xxhash64("id")), "toxicity-sample")
    sizes = sample.select("place", "id", (F.length("words") / 4).cast("long").alias("n")).orderBy("place", "id", "n").limit(sample_rows).collect()
    total = np.cumsum([r["n"] for r in sizes])
    fits = int(np.searchsorted(total, sample_words, side="right")) if len(total) else 0
    # every row up to the place of the last one that fits, or of the first if that one is too large alone
    end = sizes[max(0, fits - 1)] if sizes else None
    kept = sample.where((F.col("place") < end["place"]) | ((F.col("place") == end["place"]) & (F.col("id") <= end["id"]))) if end else sample
    sample = kept.orderBy("place", "id", "words").limit(max(1, fits)).collect()
    swapped = [np.column_stack([np.full(len(x), i), x]) for i, r in enumerate(sample) for x in [np.frombuffer(r["pairs"], "<i4").reshape(-1, 2)] if len(x)]
    labels_of = np.array([min(1, max(0, r["toxic"])) for r in sample])
    weights, intercept = train([np.frombuffer(r["words"], "<i4") for r in sample], labels_of, np.concatenate(swapped) if swapped else np.zeros((0, 3), np.int64), strength)
    at = np.flatnonzero(weights)
    values = weights[at]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS)
        table[at] = values
        for whole in batches:
            for batch in slices(whole, "text"):
                numbers, borders = features(*string_bytes(batch.column("text")))
                z = np.diff(np.append(0, np.cumsum(table[numbers]))[borders]) + intercept
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(logistic(z))], ["id", "score"])

    out = rows.mapInArrow(score, "id long, score double")
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id")) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
