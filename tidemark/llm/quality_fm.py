"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The pairwise part, sum over i < j of <v_i, v_j> x_i x_j, is half of (sum of v x) squared less the sum of (v x) squared, so a
document is scored in time linear in its features. It is fitted on the driver from a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORDS, FACTORS, GROUP = 1 << 12, 8, 100
UPPER, DIGIT, LETTER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256))
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Statistics of each document, after the hashed words; a metadata column n_chars is the last.
STATISTICS = ("log_words", "log_bytes", "upper", "digit", "punctuation", "odd_punctuation", "distinct_words", "same_neighbour", "distinct_lines", "word_length", "pairs_distinct", "upper_words", "ends_odd", "n_chars")
SIZE = WORDS + len(STATISTICS)


def features(texts: list[str | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """indptr, indices and values of the documents' sparse rows."""
    words, n_words, dense = [], [], np.zeros((len(texts), len(STATISTICS)))
    for i, (text, n) in enumerate(zip(texts, n_chars)):
        b = (text or "").encode("utf-8", "surrogatepass")
        own = b.split()
        k, size = max(1, len(own)), max(1, len(b))
        rate = lambda chars, of=b: len(of) - len(of.translate(None, chars))
        lines = [x for x in b.split(b"\n") if x.strip()]
        low = b.lower().split()
        punctuation = rate(PUNCTUATION)
        dense[i] = (
            np.log1p(len(own)) / 5, np.log1p(len(b)) / 5, 4 * rate(UPPER) / size, 4 * rate(DIGIT) / size, 4 * punctuation / size, 8 * (punctuation - rate(b".,'")) / size,
            len(set(low)) / k, sum(map(eq, low, low[1:])) / k, len(set(lines)) / max(1, len(lines)), size / k / 10, len(set(zip(low, low[1:]))) / k,
            sum(map(bytes.isupper, own)) / k, sum(w[-1:] in b"!#$%&*|" for w in own) / k, np.log1p(max(0, n or 0)) / 5,
        )
        words += low
        n_words.append(len(low))
    n_words = np.array(n_words, np.int64)
    slots = (pd.util.hash_array(np.array(words, object), categorize=False) >> np.uint64(52)).astype(np.int64) if words else np.empty(0, np.int64)
    keys, counts = np.unique(np.repeat(np.arange(len(texts)), n_words) * WORDS + slots, return_counts=True)
    doc, slot, value = keys // WORDS, keys % WORDS, np.log1p(counts)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(texts)))
    value = value / norm[doc]
    n = np.bincount(doc, minlength=len(texts))
    indptr = np.concatenate([[0], np.cumsum(n + len(STATISTICS))])
    indices, values = np.empty(indptr[-1], np.int64), np.empty(indptr[-1])
    at = np.arange(len(keys)) + doc * len(STATISTICS)
    indices[at], values[at] = slot, value
    at = (indptr[1:] - len(STATISTICS))[:, None] + np.arange(len(STATISTICS))
    indices[at], values[at] = WORDS + np.arange(len(STATISTICS)), dense
    return indptr, indices, values


def raw_scores(indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output before the link, and for each document the sums of v x."""
    vx = model["v"][indices] * values[:, None]
    sums = np.add.reduceat(vx, indptr[:-1], axis=0)
    linear = np.add.reduceat(model["w"][indices] * values, indptr[:-1])
    return model["b"] + linear + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vx * vx).sum(1), indptr[:-1])), sums


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 1) -> dict:
    """Adagrad on the logistic loss. rows: indices, values and label of each document. Without rows of both labels the score is constant."""
    rng = np.random.default_rng(seed)
    model = {"b": 0.0, "w": np.zeros(SIZE), "v": rng.normal(0, 0.05, (SIZE, FACTORS))}
    labels = np.array([r[2] for r in rows], float)
    positive = labels.mean() if len(labels) else 0.5
    model["b"] = float(np.log((positive + 1e-3) / (1 - positive + 1e-3)))
    if not rows or not 0 < positive < 1:
        return model
    gb, gw, gv = 1.0, np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2)
    for _ in range(max(epochs, -(-600 * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            part = [rows[i] for i in order[at : at + batch]]
            size = np.array([len(r[0]) for r in part])
            indptr = np.concatenate([[0], np.cumsum(size)])
            indices, values = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            raw, sums = raw_scores(indptr, indices, values, model)
            error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - np.array([r[2] for r in part])) / len(part)
            each, gx = np.repeat(np.arange(len(part)), size), np.repeat(error, size) * values
            dw = np.bincount(indices, gx, minlength=SIZE) + decay * model["w"]
            step = gx[:, None] * (sums[each] - model["v"][indices] * values[:, None])
            dv = np.stack([np.bincount(indices, step[:, f], minlength=SIZE) for f in range(FACTORS)], 1) + decay * model["v"]
            gb, gw, gv = gb + error.sum() ** 2, gw + dw * dw, gv + dv * dv
            model["b"] -= rate * error.sum() / gb**0.5
            model["w"] -= rate * dw / np.sqrt(gw)
            model["v"] -= rate * dv / np.sqrt(gv)
    return model


def fold(doc_id) -> Column:
    """crc32 of the decimal doc_id modulo 4; rows of fold 2 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, epochs: int = 8) -> dict:
    """Fits on at most train_rows labelled rows outside fold 2, the first by a hash of doc_id. Conflicting labels of one doc_id count once, as the lower."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    sample = usable.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars_of(docs)).join(F.broadcast(sample), "doc_id")  # train_rows rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                indptr, indices, values = features(part["text"].to_pylist(), part["n_chars"].to_pylist())
                cut = lambda a, kind: pa.array([a[i:j].astype(kind).tobytes() for i, j in zip(indptr, indptr[1:])], pa.binary())  # noqa: E731, B023
                yield pa.record_batch([part["doc_id"], part["quality"], cut(indices, "<u2"), cut(values, "<f4")], names=["doc_id", "quality", "indices", "values"])

    found = rows.select("doc_id", "text", "n_chars", F.col("quality").cast("int").alias("quality")).mapInArrow(extract, "doc_id bigint, quality int, indices binary, `values` binary").orderBy("doc_id", "indices", "values").limit(2 * train_rows).toArrow().to_pylist()
    return fit([(np.frombuffer(r["indices"], "<u2").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float), r["quality"]) for r in found], epochs)


def n_chars_of(docs: DataFrame) -> Column:
    return (F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")).alias("n_chars")


def score(docs: DataFrame, model: dict, threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted and the columns of carry. The whole text counts; null is empty."""
    model = {"b": model["b"], "w": model["w"].astype(np.float64), "v": model["v"].astype(np.float64)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                raw, _ = raw_scores(*features(part["text"].to_pylist(), part["n_chars"].to_pylist()), model)
                yield pa.record_batch([part["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35)))), *[part[c] for c in kept]], names=["doc_id", "score", *kept])

    kept = [f"in_{i}" for i in range(len(carry))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars_of(docs), *[F.col(c).alias(k) for c, k in zip(carry, kept)])
    schema = ", ".join(["doc_id bigint", "score double", *[f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept]])
    scored = rows.mapInArrow(run, schema)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(k).alias(f"carried_{c}") for c, k in zip(carry, kept)])


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, threshold: float = 0.7) -> DataFrame:
    """Fits on the labels and scores every document: doc_id, held_out, score, predicted. An empty table gives no rows; without
    usable labels all scores are about one half; other columns and the labels never enter a score. A null text counts as empty, a null doc_id has no
    label and is not held out; repeated rows are scored each, the same."""
    return score(docs, train(docs, labels, train_rows), threshold)


def accepted(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    names = docs.columns
    scored = score(docs, train(docs, labels, train_rows), threshold, tuple(names))
    return scored.filter("predicted = 1").select(*[F.col(f"carried_{c}").alias(c) for c in names])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
