"""Reading level of each document: a pairwise ranker over syntax and vocabulary features, calibrated to levels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?…]+(?=\s|$)|\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*")
# Words that open subordinate clauses in the languages of the corpus.
SUBORDINATORS = frozenset("que porque porquanto embora enquanto quando se como onde qual quais cujo cuja cujos cujas pois conforme consoante ainda aunque porque cuando donde which that because although while when where whose whereas".split())
LONG, VERY_LONG = 6, 9
FEATURES = ("words_per_sentence", "longest_sentence", "commas_per_sentence", "subordinators_per_sentence", "long_share", "very_long_share", "mean_word", "distinct_share")


def measure(text: str | None) -> tuple[float, ...] | None:
    """The features of a text, None where it has no word.

    A word is a run of letters; it is long above 6 letters. A sentence ends at . ! ? …
    before white space or the end, or at a blank line; what holds no word is no sentence.
    """
    if not text:
        return None
    counts, found = [], []
    for part in SENTENCE_END.split(text):
        own = LETTERS.findall(part)
        if own:
            counts.append(len(own))
            found += own
    if not found:
        return None
    n, s = len(found), len(counts)
    sizes = [len(w) for w in found]
    low = [w.lower() for w in found]
    return (n / s, float(max(counts)), text.count(",") / s, sum(w in SUBORDINATORS for w in low) / s, sum(x > LONG for x in sizes) / n, sum(x > VERY_LONG for x in sizes) / n, sum(sizes) / n, len(set(low)) / n**0.5)


#: The published assumption that longer sentences and more long words are harder: used only where next to nothing is graded.
ASSUMED = np.array([1.0, 0, 0, 0, 1.0, 0, 0, 0])


@dataclass
class Ranker:
    """score = weights . standardized(log1p(features)); level = isotonic(score)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    middle: float  # the mean level of the graded documents
    assumed: bool = False  # whether the weights lean on ASSUMED

    def standard(self, features: np.ndarray) -> np.ndarray:
        return (np.log1p(features) - self.mean) / self.scale

    def score(self, features: np.ndarray) -> np.ndarray:
        return self.standard(features) @ self.weights

    def level(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots and values of the best rising fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # value, weight, from, to
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        blocks.append([b, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            value, weight, _, last = blocks.pop()
            top = blocks[-1]
            top[0] = (top[0] * top[1] + value * weight) / (top[1] + weight)
            top[1] += weight
            top[3] = last
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    values = np.array([b[0] for b in blocks for _ in range(2)])
    return knots, values


def fit(features: np.ndarray, grades: np.ndarray, *, pairs: int = 200_000, rounds: int = 50, ridge: float = 1.0, prior: float = 0.0, seed: int = 7) -> Ranker:
    """Logistic regression on differences of documents with different grades, then isotonic calibration.

    The pairs together weigh as much as the graded documents they come from. The weights come from the grades alone,
    drawn to 0 with the weight of ``ridge`` documents; ``prior`` > 0 draws them to ASSUMED instead, with its own weight.
    """
    logs = np.log1p(features)
    mean, scale = logs.mean(0), logs.std(0)
    scale[scale == 0] = 1
    x = (logs - mean) / scale
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(x), (2, pairs))
    keep = grades[a] != grades[b]
    a, b = a[keep], b[keep]
    up = np.where((grades[a] > grades[b])[:, None], x[a] - x[b], x[b] - x[a])
    gap = np.abs(grades[a] - grades[b])
    gap *= len(x) / max(1e-9, gap.sum())
    centre, pull = (ASSUMED, prior) if prior > 0 else (np.zeros(len(FEATURES)), ridge)
    weights = centre.copy()
    for _ in range(rounds if len(up) else 0):
        p = 1 / (1 + np.exp(np.clip(up @ weights, -500, 500)))
        slope = up.T @ (gap * p) - pull * (weights - centre)
        curve = (up * (gap * p * (1 - p))[:, None]).T @ up + pull * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    knots, levels = isotonic(x @ weights, grades, np.ones(len(x)))
    return Ranker(mean, scale, weights, knots, levels, float(np.interp(x @ weights, knots, levels).mean()), prior > 0)


def measured(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text", ranker: Ranker | None = None) -> DataFrame:
    """doc_id and its features, and with a ranker its score and level. Texts without a word have nulls."""
    names = ["doc_id", *FEATURES, *(("score", "level") if ranker else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(1).to_pylist()]
            full = np.array([r for r in rows if r], float).reshape(-1, len(FEATURES))
            if ranker:
                score = ranker.score(full)
                full = np.column_stack([full, score, ranker.level(score)])
            spread = np.full((len(rows), full.shape[1]), np.nan)
            there = np.array([r is not None for r in rows], bool)
            spread[there] = full
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, mask=~there) for c in spread.T]], names=names)

    kind = corpus.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names[1:])
    return corpus.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").mapInArrow(run, schema)


def graded_features(corpus: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = 4000, seed: int = 7) -> DataFrame:
    """(doc_id, features, grade) of graded documents with words: the ``sample`` with the smallest hash, raters averaged."""
    graded = labels.where(F.col(grade).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(grade).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    texts = corpus.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by sample
    return measured(texts).join(F.broadcast(chosen), "doc_id").where("words_per_sentence is not null")


def train(corpus: DataFrame, labels: DataFrame, *, least: int = 30, prior: float = 10.0, seed: int = 7, **options: object) -> Ranker | None:
    """A ranker from graded documents; None where fewer than two grades are known.

    Raters are averaged. Of the graded documents the ``sample`` with the smallest hash are
    used: the bound on what the driver gets. Null grades and unknown documents are left out.
    Fewer than ``least`` graded documents say too little by themselves: only then the weights
    lean on ASSUMED as on ``prior`` documents more, and the ranker says so (``assumed``).
    """
    rows = graded_features(corpus, labels, seed=seed, **options).select(*FEATURES, "grade").collect()
    if len({r.grade for r in rows}) < 2:
        return None
    table = np.array([tuple(r) for r in rows], float)
    table = table[np.lexsort(table.T)]  # the same order on every cluster
    return fit(table[:, :-1], table[:, -1], prior=prior if len(rows) < least else 0.0, seed=seed)


def reading_levels(corpus: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """doc_id, features, score, level (1 easiest; null without words), the graded documents' middle level, and ``assumed``.

    Without usable labels score, level, middle and assumed are null.
    """
    names = {k: v for k, v in options.items() if k in ("doc_id", "text")}
    ranker = train(corpus, labels, **options)
    if ranker is None:
        nothing = F.lit(None).cast("double")
        return measured(corpus, **names).select("*", nothing.alias("score"), nothing.alias("level"), nothing.alias("middle"), F.lit(None).cast("boolean").alias("assumed"))
    return measured(corpus, **names, ranker=ranker).withColumn("middle", F.lit(ranker.middle)).withColumn("assumed", F.lit(ranker.assumed))


def pair_accuracy(score: np.ndarray, grades: np.ndarray) -> float:
    """The share of pairs with different grades that the score puts in the right order (ties count half), by counting ranks."""
    order = np.argsort(score, kind="stable")
    values, place = np.unique(score[order], return_inverse=True)
    right, total = 0.0, 0.0
    kinds = np.unique(grades)
    below = np.zeros(len(values))  # documents of lower grades at each score
    for g in kinds:
        own = np.bincount(place[grades[order] == g], minlength=len(values)).astype(float)
        less = np.concatenate([[0], np.cumsum(below)[:-1]])
        right += float((own * (less + below / 2)).sum())
        total += own.sum() * below.sum()
        below += own
    return right / total if total else 0.5


def held_out(corpus: DataFrame, labels: DataFrame, *, shuffles: int = 9, seed: int = 7, **options: object) -> dict[str, float]:
    """How well a ranker fitted on one half of the graded documents (by hash of the id) orders and grades the other half.

    tested: documents of the other half; accuracy: share of its pairs in the right order; error: mean distance of
    level and grade; guess: the same for the first half's mean grade; shuffled: mean accuracy of rankers fitted on
    shuffled grades, which should be about a half.
    """
    rows = graded_features(corpus, labels, seed=seed, **options).select(*FEATURES, "grade", (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").cast("int").alias("half")).collect()
    table = np.array([tuple(r) for r in rows], float).reshape(-1, len(FEATURES) + 2)
    table = table[np.lexsort(table.T)]
    one, two = table[table[:, -1] == 1], table[table[:, -1] == 0]
    if len(np.unique(one[:, -2])) < 2 or len(np.unique(two[:, -2])) < 2:
        return {"tested": len(two), "accuracy": 0.5, "error": float("nan"), "guess": float("nan"), "shuffled": 0.5}
    ranker = fit(one[:, :-2], one[:, -2], seed=seed)
    score, truth = ranker.score(two[:, :-2]), two[:, -2]
    rng = np.random.default_rng(seed)
    noise = [pair_accuracy(fit(one[:, :-2], rng.permutation(one[:, -2]), seed=seed).score(two[:, :-2]), truth) for _ in range(shuffles)]
    return {"tested": len(two), "accuracy": pair_accuracy(score, truth), "error": float(np.abs(ranker.level(score) - truth).mean()), "guess": float(np.abs(one[:, -2].mean() - truth).mean()), "shuffled": float(np.mean(noise))}


def calibration(levels: DataFrame, width: float = 0.02) -> DataFrame:
    """(documents, without_level, rising): whether levels never fall as scores rise, over score bins of a width; a bin is one row, however many documents it holds."""
    bins = levels.where("score is not null").groupBy(F.floor(F.col("score") / width).alias("bin")).agg(F.min("level").alias("low"), F.max("level").alias("high"))
    before = F.lag("high").over(Window.partitionBy(F.lit(1)).orderBy("bin"))  # some hundred bins
    rising = bins.withColumn("before", before).agg(F.coalesce(F.bool_and(F.coalesce(F.col("low") >= F.col("before"), F.lit(True))), F.lit(True)).alias("rising"))
    counts = levels.agg(F.count("*").alias("documents"), F.count_if(F.col("level").isNull()).alias("without_level"))
    return counts.join(F.broadcast(rising), F.lit(True))  # one row each


def extreme_bands(levels: DataFrame) -> DataFrame:
    """(doc_id, reading_band): of the documents the ranker puts on one side of the middle, those the definition confirms.

    'easy' has at most 12 words a sentence and 30 % long words, 'hard' at least 30 and 40 %.
    """
    easy = (F.col("level") <= F.col("middle")) & (F.col("words_per_sentence") <= 12) & (F.col("long_share") <= 0.3)
    hard = (F.col("level") >= F.col("middle")) & (F.col("words_per_sentence") >= 30) & (F.col("long_share") >= 0.4)
    return levels.select("doc_id", F.when(easy, "easy").when(hard, "hard").alias("reading_band")).where("reading_band is not null")
