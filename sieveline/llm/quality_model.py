"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Each text becomes a fixed vector of statistics (lengths, character classes, repeats, lines, entropy), standardised by the mean and deviation of the
teaching rows. Random Fourier features cos(w x + b) approximate a Gaussian kernel on them. Every task adds up its part of the normal equations
and Spark adds the parts, so all teaching rows take part and only one matrix of fixed size reaches the driver. Raw ridge scores are
calibrated by isotonic regression (pool adjacent violators) over a fixed number of bins of raw scores of teaching rows.

Defined results: null and empty texts have the statistics of an empty text and a score like any other; equal texts get equal scores; repeated rows
are scored each; without teaching rows, or with one class only, every score is the observed share of ones (0.5 if there is none); an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.fitting import label_rows, remainder
from sieveline.llm.shared import cut, table

MODULUS, KEPT_OUT = 5, 0
THRESHOLD = 0.3
FEATURES = 192
RIDGE = 1.0
WIDTH = 4.0
BINS = 400
SEED = 20

NAMES = (
    "log_words", "log_bytes", "mean_word", "deviation_word", "distinct_words", "top_word", "repeated_next", "repeated_pairs", "capital_words", "capitals",
    "digits", "blanks", "symbols", "punctuation", "exclamations", "pipes", "non_ascii", "controls", "log_lines", "repeated_lines", "mean_line", "entropy", "sentence_ends", "short_words",
)

_CLASS = np.zeros((256, 9), np.float64)
for _i, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"#*$%&<>@^~_=+\\/{}[]", b".,;:?!'\"()-", b"!", b"|", bytes(range(128, 256)), bytes(range(9)) + bytes(range(14, 32)) + b"\x7f")
):
    _CLASS[list(_chars), _i] = 1.0

_END = re.compile(rb"[.!?](?:\s|$)")


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    per_byte = counts @ _CLASS / max(size, 1)
    p = counts[counts > 0] / max(size, 1)
    low = raw.lower().split()
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds = len(set(low))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if n:
        _, ids = np.unique(np.fromiter(map(hash, low), np.int64, n), return_inverse=True)
        top = np.bincount(ids).max() / n
        same = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
        pairs = 1 - len(np.unique(ids[1:] * (ids.max() + 1) + ids[:-1])) / (n - 1) if n > 1 else 0.0
        caps = sum(map(bytes.isupper, words)) / n
    else:
        top = same = pairs = caps = 0.0
    return np.array(
        [
            np.log1p(n), np.log1p(size), lengths.mean() if n else 0, lengths.std() if n else 0, kinds / n if n else 0, top, same, pairs, caps, *per_byte,
            np.log1p(len(lines)), 1 - len(set(lines)) / len(lines) if lines else 0, np.log1p(size / len(lines)) if lines else 0, float(-(p * np.log2(p)).sum()),
            len(_END.findall(raw)) / n if n else 0, float((lengths <= 2).mean()) if n else 0,
        ],
        np.float64,
    )


def document_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, x) and the integer columns `more`: x array<float> in the order of NAMES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t).astype(np.float32) for t in b["text"].to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
            at = np.arange(0, len(flat) + 1, len(NAMES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), *(b[c] for c in more)], names=["doc_id", "x", *more])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", *more).mapInArrow(run, "doc_id long, x array<float>" + "".join(f", {c} int" for c in more))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(self.standard(x) @ self.w + self.b) * (2.0 / self.w.shape[1]) ** 0.5
        return np.hstack([np.ones((len(x), 1)), z])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between the centres of the calibrated bins the score is linear, so it follows the raw score without steps."""
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0.0, 1.0)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """Adds part(x, y), a vector of fixed size, over all rows: in each task, then by index in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b["x"]), b["y"].to_numpy().astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    got = rows.select("x", "y").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression: least squares among non-decreasing sequences."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, bins: int = BINS) -> Model:
    """rows: x, y. All of them teach."""
    d = len(NAMES)
    moments = _summed(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    n, ones = moments[:2]
    rng = np.random.default_rng(SEED)
    mean = moments[2 : 2 + d] / max(n, 1)
    scale = np.sqrt(np.maximum(moments[2 + d :] / max(n, 1) - mean**2, 1e-8))
    share = ones / n if n else 0.5
    model = Model(mean, scale, rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([share]))
    if not n or ones in (0, n):
        return model
    k = features + 1
    balance = np.array([n / (2 * (n - ones)), n / (2 * ones)])  # the rare class weighs as much as the other

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        wz = z * balance[y.astype(int)][:, None]
        return np.concatenate([(wz.T @ z).ravel(), wz.T @ y])

    sums = _summed(rows, equations, k * k + k)
    model.beta = np.linalg.solve(sums[: k * k].reshape(k, k) + ridge * np.eye(k), sums[k * k :])
    low, high = -0.5, 1.5

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = model.raw(x)
        at = np.clip(((raw - low) / (high - low) * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, weights=y, minlength=bins), np.bincount(at, weights=raw, minlength=bins)])

    seen, hits, raw = _summed(rows, binned, 3 * bins).reshape(3, bins)
    full = seen > 0
    model.edges = raw[full] / seen[full]
    model.levels = pool(hits[full] / seen[full], seen[full])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """stats: doc_id, x. Adds score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(model.score(_matrix(b["x"])) if b.num_rows else np.zeros(0))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs."""
    stats = cut(document_statistics(docs), "quality-statistics")
    rows = stats.join(label_rows(labels, "quality", MODULUS, KEPT_OUT), "doc_id").select("x", "y")
    scored = score(stats, fit(cut(rows, "quality-rows")))
    return scored.select("doc_id", (remainder("doc_id", MODULUS) == KEPT_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns as they are, without the rows predicted to be of low quality."""
    teach = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(label_rows(labels, "quality", MODULUS, KEPT_OUT), "doc_id")
    model = fit(cut(document_statistics(teach, "y").select("x", "y"), "quality-rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t).astype(np.float32) for t in b["text"].to_pylist()], np.float64)
                yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_model(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
