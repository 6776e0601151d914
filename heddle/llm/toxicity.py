"""Toxicity by a counterfactual-regularised classifier.

Features are the words of a text and the beginnings of its words: that one is present, and that it makes up at least
a given share of the words. Those whose counts differ most between labels are kept. A logistic regression is fitted on them with one more penalty:
each labelled text is paired with copies in which one sentence names another group of people, or, where none is named,
gets a neutral mention of one, and the squared change of the score's logit between the two is added to the loss. So the
score of a neutral mention hangs neither on the group nor on there being one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.tokens import forget_encoders, slices

#: Fitting reads at most so many labelled rows, those with the smallest hash of doc_id, and keeps so many features.
MAX_FIT_ROWS, MAX_FEATURES = 8000, 1024
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features.
PREFIXES = (4, 5, 6, 7)
#: A feature with `@k` holds where its word or beginning is at least a 2^-k share of the text's words.
SHARES = (8, 7, 6, 5)
#: Language -> kinds of terms that may stand for each other; a parameter of `fit`.
IDENTITY: dict[str, tuple[tuple[str, ...], ...]] = {
    "en": (
        ("women", "men", "girls", "boys"),
        ("woman", "man", "girl", "boy"),
        ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("immigrants", "refugees", "foreigners", "natives"),
        ("deaf", "blind", "disabled", "autistic"),
    ),
    "fr": (("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous"), ("immigrés", "réfugiés", "étrangers"), ("sourds", "aveugles", "handicapés")),
    "es": (("mujeres", "hombres", "chicas", "chicos"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("inmigrantes", "refugiados", "extranjeros"), ("sordos", "ciegos", "discapacitados")),
    "de": (("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hindus"), ("einwanderer", "flüchtlinge", "ausländer"), ("gehörlose", "blinde", "behinderte")),
}
#: Neutral mentions for sentences that name no group, and words by which a text's language is told for that.
MENTION = {"en": "the {} live here too", "fr": "les {} vivent aussi ici", "es": "los {} viven aquí también", "de": "die {} wohnen auch hier"}
COMMON = {"en": {"the", "and", "of", "to"}, "fr": {"le", "les", "et", "des"}, "es": {"el", "los", "y", "que"}, "de": {"der", "die", "und", "das"}}
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Counterfactual pairs of a labelled text at most.
MAX_PAIRS = 16
COUNTERFACTUAL, RIDGE, MIN_ROWS, MIN_Z = 1.0, 0.0002, 3, 3.0
#: Rows that a step of the fit holds as numbers of eight bytes at once.
ROWS_AT_ONCE = 512
THRESHOLD = 0.7


def stems(word: str) -> list[str]:
    """A lower-cased word and its beginnings, marked as such."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


def features(words: Counter[str]) -> set[str]:
    """All features of a text."""
    counts: Counter[str] = Counter()
    for w, c in words.items():
        for s in stems(w):
            counts[s] += c
    total = words.total()
    return {f for s, c in counts.items() for f in (s, *(f"{s}@{k}" for k in SHARES if c << k >= total))}


class Model:
    """names: the kept features, by column; weights are one longer, the last being the intercept.

    report: rows and counterfactual pairs of the fit, and the pairs' mean absolute logit change with the penalty
    (`change`) and without it (`change_without`).
    """

    def __init__(self, names: list[str], weights: np.ndarray, report: dict[str, float] | None = None):
        self.names, self.weights, self.report = names, weights, report or {}
        self.stems: dict[str, list[tuple[int, int]]] = {}  # stem -> (column, k); k is -1 where presence is meant
        for i, name in enumerate(names):
            stem, _, k = name.partition("@")
            self.stems.setdefault(stem, []).append((i, int(k) if k else -1))

    def columns(self, words: Counter[str], seen: dict[str, tuple[str, ...]]) -> list[int]:
        """The text's columns in ascending order. seen: a worker's memory of the stems that count in a word."""
        counts: dict[str, int] = {}
        for w, c in words.items():
            hit = seen.get(w)
            if hit is None:
                hit = tuple(s for s in stems(w) if s in self.stems)
                if len(seen) >= 500_000:
                    seen.clear()
                seen[w] = hit
            for s in hit:
                counts[s] = counts.get(s, 0) + c
        total = words.total()
        return sorted(i for s, c in counts.items() for i, k in self.stems[s] if k < 0 or c << k >= total)

    def score(self, words: Counter[str], seen: dict[str, tuple[str, ...]]) -> float:
        z = float(self.weights[-1]) + math.fsum(self.weights[i] for i in self.columns(words, seen))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _moved(words: Counter[str], take: Counter[str], give: Counter[str]) -> Counter[str]:
    out = words.copy()
    out.subtract(take)
    out.update(give)
    return +out


def counterfactuals(text: str, groups: dict[str, tuple[tuple[str, ...], ...]] = IDENTITY) -> list[tuple[Counter[str], Counter[str]]]:
    """Pairs of word counts between which only the named group differs; MAX_PAIRS at most.

    In each sentence that names a group, the term is swapped for each other term of its kind, there alone. Where no
    sentence names one, one sentence of the text, told by its hash, gets a neutral mention in the text's language:
    the text is paired with that copy, and that copy with those that name another group of the kind.
    """
    words = words_of(text)
    kinds = {t: kind for some in groups.values() for kind in some for t in kind}
    out: list[tuple[Counter[str], Counter[str]]] = []
    if not words.keys().isdisjoint(kinds):
        for sentence in SENTENCE.split(text):
            found = words_of(sentence)
            for term in sorted(found.keys() & kinds.keys()):
                for other in kinds[term]:
                    if other != term:
                        out.append((words, _moved(words, Counter({term: found[term]}), Counter({other: found[term]}))))
                        if len(out) == MAX_PAIRS:
                            return out
    if out or not words:
        return out
    language = max((name for name in groups if name in MENTION), key=lambda name: sum(words[w] for w in COMMON[name]), default=None)
    if language is None:
        return out
    kind = groups[language][zlib.crc32(text.encode("utf-8", "replace")) % len(groups[language])]
    copies = [_moved(words, Counter(), words_of(MENTION[language].format(term))) for term in kind]
    return ([(words, copies[0])] + [(copies[0], c) for c in copies[1:]])[:MAX_PAIRS]


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic of the rows that may be learned from: crc32(doc_id) mod 3 is not 1; at most max_rows.

    A doc_id that repeats among labels is toxic if one of its rows says so; among docs, its greatest text counts.
    """
    usable = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 != 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows x 12 bytes
    return found.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with and without each feature by label, summed over the task; the bound on rows bounds them."""
    good, bad = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (bad if y else good).update(features(words_of(text)))
    names = list(good.keys() | bad.keys())
    for i in range(0, len(names), 20_000):
        part = names[i : i + 20_000]
        yield pa.record_batch([pa.array(part), pa.array([bad[f] for f in part], pa.int64()), pa.array([good[f] for f in part], pa.int64())], ["feature", "bad", "good"])


def fit(docs: DataFrame, labels: DataFrame, groups: dict[str, tuple[tuple[str, ...], ...]] = IDENTITY, max_rows: int = MAX_FIT_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Learns from at most max_rows labelled rows; without any, or with one label only, every score is the smoothed rate."""
    rows = materialise(training_rows(docs, labels, max_rows), "toxicity-fit")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)).alias("bad")).head()
    n, bad = total["n"], total["bad"]
    rate = (bad + 0.5) / (n + 1)
    flat = Model([], np.array([math.log(rate / (1 - rate))]))
    if not 0 < bad < n:
        return flat
    counts = rows.mapInArrow(_counts, "feature string, bad bigint, good bigint").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(f"bad + good >= {MIN_ROWS}")
    p, q = (F.col("bad") + 0.5) / (bad + 1), (F.col("good") + 0.5) / (n - bad + 1)
    both = (F.col("bad") + F.col("good") + 1) / (n + 2)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / bad + 1 / (n - bad)))
    best = counts.withColumn("z", F.abs(z)).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(max_features).collect()
    names = [r["feature"] for r in best]
    model = Model(names, np.zeros(len(names) + 1))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = [model.columns(words_of(t), seen) for t in texts]
            pairs = [[(set(model.columns(a, seen)), set(model.columns(b, seen))) for a, b in counterfactuals(t, groups)] for t in texts]
            one = pa.list_(pa.int32())
            gone, new = ([[sorted(p[k] - p[1 - k]) for p in row] for row in pairs] for k in (0, 1))
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(own, one), pa.array(gone, pa.list_(one)), pa.array(new, pa.list_(one))], ["doc_id", "toxic", "own", "gone", "new"])

    known = rows.mapInArrow(describe, "doc_id bigint, toxic int, own array<int>, gone array<array<int>>, new array<array<int>>").orderBy("doc_id").toArrow()  # max_rows rows, MAX_PAIRS pairs each
    texts = [(own.values.to_numpy(), int(y > 0)) for own, y in zip(known.column("own"), known.column("toxic").to_pylist(), strict=True)]
    pairs = [p for gone, new in zip(known.column("gone"), known.column("new"), strict=True) for p in zip(gone.as_py(), new.as_py(), strict=True)]
    weights, free = (_solve(texts, pairs, len(names), c) for c in (COUNTERFACTUAL, 0.0))
    return Model(names, weights, {"rows": len(texts), "pairs": len(pairs), "change": mean_change(pairs, weights), "change_without": mean_change(pairs, free)})


def mean_change(pairs: list[tuple[list[int], list[int]]], weights: np.ndarray) -> float:
    """Mean absolute logit change of the pairs."""
    return math.fsum(abs(weights[gone].sum() - weights[new].sum()) for gone, new in pairs) / max(len(pairs), 1)


def _solve(rows: list[tuple[Sequence[int], int]], pairs: list[tuple[list[int], list[int]]], k: int, counterfactual: float, steps: int = 40) -> np.ndarray:
    """Newton steps on mean log loss + ridge + `counterfactual` times the mean squared logit change of the pairs.

    rows: columns and label; pairs: the columns that only the one and only the other of a pair has; k: columns.
    The rows are held as bytes and worked on in blocks, as the driver's Python has little room.
    """
    x = np.zeros((len(rows), k + 1), dtype=np.uint8)
    x[:, k] = 1
    for i, (own, _) in enumerate(rows):
        x[i, own] = 1
    y = np.array([r[1] for r in rows], dtype=np.float64)
    blocks = [slice(i, i + ROWS_AT_ONCE) for i in range(0, len(rows), ROWS_AT_ONCE)]
    pull = np.zeros((k + 1, k + 1))
    if counterfactual:
        for gone, new in pairs:
            at, sign = gone + new, np.array([1.0] * len(gone) + [-1.0] * len(new))
            pull[np.ix_(at, at)] += np.outer(sign, sign)
        pull *= 2 * counterfactual / max(len(pairs), 1)
    ridge = np.full(k + 1, 2 * RIDGE)
    ridge[k] = 0
    w = np.zeros(k + 1)

    def logits(v: np.ndarray) -> np.ndarray:
        return np.concatenate([x[at].astype(np.float64) @ v for at in blocks])

    def loss(v: np.ndarray) -> float:
        z = logits(v)
        return float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (v * v) + 0.5 * v @ pull @ v)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(logits(w), -30, 30)))
        slope, curve = np.zeros(k + 1), np.zeros((k + 1, k + 1))
        for at in blocks:
            some = x[at].astype(np.float64)
            slope += some.T @ (p - y)[at]
            curve += some.T @ (some * (p * (1 - p))[at, None])
        slope = slope / len(y) + ridge * w + pull @ w
        curve /= len(y)
        curve += pull
        curve[np.diag_indices(k + 1)] += ridge + 1e-9
        move, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and (then := loss(w - size * move)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-9:
            break
        w, now = w - size * move, then
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    A null or empty text has no features and scores by the intercept. held_out is crc32(doc_id as text) mod 3 = 1,
    false for a null doc_id. Equal texts score alike, whatever their other columns. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                p = [model.score(words_of(t), seen) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below THRESHOLD; all columns stay, under their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        seen: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                keep = [model.score(words_of(t), seen) < THRESHOLD for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
