"""Toxicity: logistic regression over word beginnings, regularised by counterfactuals.

Features are beginnings of words (3 to 8 letters) and whole words, valued by the logarithm of their count in the text; the text's length is one
more. The features are chosen by their likelihood ratio between the classes in the teaching sample, and the terms of `IDENTITY` always
take part. For every teaching text that mentions a group, a counterfactual is made by swapping each identity term for the next of its
family; besides the logistic loss the fit penalises the squared change of score between a text and its counterfactual, so the mention
of a group by itself moves a score little.

The fit uses at most about `SAMPLE` labelled rows, chosen by a hash of the document id; every text is scored, whole.

Defined results: null and empty texts have no words and a score like any other; equal texts get equal scores; repeated rows are scored each; without
teaching rows, or with one class only, every score is the observed share of ones (0 if there is none); ties between features are broken by
their text; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.fitting import bounded_sample, label_rows, remainder
from sieveline.llm.shared import cut, table

MODULUS, KEPT_OUT = 3, 1
THRESHOLD = 0.7
SAMPLE = 16_000
CHOSEN = 800
LENGTHS = range(3, 9)
FAIRNESS = 0.5
#: How far the rare class is weighted up: 0 not at all, 1 to equal shares.
BALANCE = 0.75
RIDGE = 2e-4
ROUNDS = 400
HELD = 500_000

#: Families of identity terms; a counterfactual takes the next of the family.
IDENTITY = tuple(
    family.split()
    for family in (
        "women men girls boys femmes hommes frauen männer mujeres hombres",
        "muslims christians jews hindus buddhists atheists musulmans chrétiens juifs muslime christen juden musulmanes cristianos judíos",
        "muslim christian jewish hindu buddhist atheist musulman chrétien juif muslimisch christlich jüdisch musulmán cristiano judío",
        "gay lesbian straight bisexual transgender queer heterosexual homosexuel homosexuell homosexual",
        "black white asian african latino hispanic arab european noir blanc asiatique schwarz weiß asiatisch negro blanco asiático",
        "immigrants refugees foreigners citizens migrants immigrés réfugiés étrangers flüchtlinge ausländer inmigrantes refugiados extranjeros",
        "disabled elderly young handicapés jeunes behinderte alte discapacitados ancianos jóvenes",
    )
)
SWAP = {w: family[(i + 1) % len(family)] for family in IDENTITY for i, w in enumerate(family)}

_words = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def features_of(word: str) -> list[str]:
    return [word[:k] for k in LENGTHS if k <= len(word)] + [word + "$"]


@dataclass
class Model:
    """logit = bias + length * ln(1 + words) + sum of weight * ln(1 + count) over features."""

    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    length: float = 0.0
    bias: float = 0.0
    constant: float | None = None


class Hits(dict):
    """Chosen features of a word, kept for as many words as HELD."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > HELD:
            self.clear()
        out = self[word] = tuple(i for f in features_of(word) if (i := self.index.get(f)) is not None)
        return out


def counts_of(found: list[str], hits: Hits) -> Counter:
    got: Counter = Counter()
    for x in filter(None, map(hits.__getitem__, found)):
        got.update(x)
    return got


# ---- fitting


def _choose(rows: DataFrame, n: tuple[int, int], most: int) -> list[str]:
    """The features that tell the classes apart best. rows: text, y; n: rows of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for y in (0, 1):
                if seen[y]:
                    k = np.fromiter(seen[y].values(), np.int64, len(seen[y]))
                    yield pa.RecordBatch.from_arrays([pa.array(seen[y].keys(), pa.string()), pa.array(k * (1 - y)), pa.array(k * y)], names=["feature", "a", "b"])
                    seen[y].clear()

        for b in batches:
            for t, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
                seen[y].update({f for w in set(words(t)) for f in features_of(w)})
                if len(seen[0]) + len(seen[1]) > 2 * HELD:
                    yield from out()
        yield from out()

    found = rows.mapInArrow(run, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p, q = (F.col("b") + 0.5) / (n[1] + 1.0), (F.col("a") + 0.5) / (n[0] + 1.0)
    gain = F.col("b") * F.log(p / q) + (n[1] - F.col("b")) * F.log((1 - p + 1e-9) / (1 - q + 1e-9))
    best = found.filter((F.col("b") >= 2) & (p > q)).select("feature", F.round(gain, 9).alias("gain")).orderBy(F.col("gain").desc(), "feature").limit(most)
    return [r["feature"] for r in best.collect()]


def _vectors(rows: DataFrame, names: list[str]) -> list[dict]:
    """y, n, i, c of each row, and i2, c2 of its counterfactual (null without identity terms)."""
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(index)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("y", "n", "i", "c", "i2", "c2")}
            for t, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
                found = words(t)
                got = counts_of(found, hits)
                swapped = [SWAP.get(w, w) for w in found] if not SWAP.keys().isdisjoint(found) else None
                other = counts_of(swapped, hits) if swapped else None
                row = (y, len(found), list(got), list(got.values()), None if other is None else list(other), None if other is None else list(other.values()))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.int32(), pa.int32(), ints, ints, ints, ints), strict=True)], names=list(out))

    return rows.mapInArrow(run, "y int, n int, i array<int>, c array<int>, i2 array<int>, c2 array<int>").toArrow().to_pylist()


def _descend(x: np.ndarray, y: np.ndarray, change: np.ndarray, fairness: float, ridge: float, rounds: int) -> np.ndarray:
    """Weighted logistic loss + fairness * mean squared change of the logit + ridge, by gradient steps of adapted size (Adam)."""
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** BALANCE
    balance = (balance / balance.mean()).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        g = x.T @ ((p - y) * balance) / len(y) + 2 * ridge * w
        if len(change):
            g += 2 * fairness * change.T @ (change @ w) / len(change)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chosen: int = CHOSEN, fairness: float = FAIRNESS) -> Model:
    """docs: doc_id, text; labels: doc_id, y."""
    rows = cut(docs.join(bounded_sample(labels, sample, labels.count()), "doc_id").select("text", "y"), "toxicity-rows")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n = (sizes.get(0, 0), sizes.get(1, 0))
    if not all(n):
        return Model(constant=n[1] / max(sum(n), 1))
    names = _choose(rows, n, chosen)
    names += sorted({w + "$" for w in SWAP} - set(names))
    got = _vectors(rows, names)
    d = len(names)
    x = np.zeros((len(got), d + 2), np.float32)
    pairs = [k for k, r in enumerate(got) if r["i2"] is not None]
    swapped = np.zeros((len(pairs), d + 2), np.float32)
    for k, r in enumerate(got):
        x[k, r["i"]], x[k, d], x[k, d + 1] = np.log1p(r["c"]), math.log1p(r["n"]) / 8, 1
    for k, at in enumerate(pairs):
        swapped[k, got[at]["i2"]], swapped[k, d], swapped[k, d + 1] = np.log1p(got[at]["c2"]), x[at, d], 1
    w = _descend(x, np.array([r["y"] for r in got], np.float32), x[pairs] - swapped, fairness, RIDGE, ROUNDS)
    return Model(names, w[:d].astype(float), float(w[d]) / 8, float(w[d + 1]))


# ---- scoring


class Scorer:
    """Scores texts in a task; holds the features of words it has met."""

    def __init__(self, model: Model):
        self.model, self.weights = model, model.weights.tolist()
        self.hits = Hits({f: i for i, f in enumerate(model.names)})

    def __call__(self, text: str | None) -> float:
        if self.model.constant is not None:
            return self.model.constant
        found = words(text)
        z = self.model.bias + self.model.length * math.log1p(len(found))
        z += sum(self.weights[i] * math.log1p(c) for i, c in sorted(counts_of(found, self.hits).items()))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(of, b["text"].to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns as they are, without the rows predicted toxic."""
    model = fit(docs.selectExpr("cast(doc_id as long) doc_id", "text"), label_rows(labels, "toxic", MODULUS, KEPT_OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([of(t) < THRESHOLD for t in b["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs."""
    mine = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    model = fit(mine, label_rows(labels, "toxic", MODULUS, KEPT_OUT))
    return score(mine, model).select("doc_id", (remainder("doc_id", MODULUS) == KEPT_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
