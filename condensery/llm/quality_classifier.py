"""Ordinal quality by cumulative-link regression on hashed text.

Grades 0 < 1 < 2 share one weight vector: P(grade > k) = sigmoid(w.x - threshold_k) with ordered thresholds. x holds the shares of hashed lower-case words and of
hashed surface forms (letter runs reduced to their case) among a text's words. Weights are fitted by full gradients: each step is a Spark job over the
sample's features whose tasks return one gradient each; only weights are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import slices, texts_of, words_of, written
from .toxicity import held_out, training_labels

#: Expected number of graded rows that are learnt from; hashed classes of words and of forms; gradient steps.
TRAINING_ROWS, WORD_CLASSES, FORM_CLASSES, STEPS = 16_000, 1 << 14, 1 << 11, 24
SIZE = WORD_CLASSES + FORM_CLASSES


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, class, share) of the classes of each text; each word counts once as a word and once as a form."""
    flat, offsets = words_of(texts)
    coded = flat.dictionary_encode()
    lower = pc.utf8_lower(coded.dictionary).to_pylist()
    forms = pc.replace_substring_regex(pc.replace_substring_regex(pc.replace_substring_regex(coded.dictionary, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\p{Nd}+", "0").to_pylist()
    h = xxhash.xxh3_64_intdigest
    names = np.array([[h(w) % WORD_CLASSES for w in lower], [WORD_CLASSES + h(f) % FORM_CLASSES for f in forms]], np.int64).reshape(2, -1)
    codes = coded.indices.to_numpy()
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(texts)), n)
    keys = np.concatenate([row * SIZE + names[0][codes], row * SIZE + names[1][codes]]) if len(codes) else np.zeros(0, np.int64)
    kinds, count = np.unique(keys, return_counts=True)
    row = kinds // SIZE
    return row, kinds % SIZE, np.sqrt(count / np.maximum(n[row], 1))


def sample_features(docs: DataFrame, grades: DataFrame) -> DataFrame:
    """(y, classes, shares) of graded rows."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                row, kind, share = hashed(texts_of(batch))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["y"], pa.ListArray.from_arrays(pa.array(ends), pa.array(kind.astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(share.astype(np.float32)))], ["y", "classes", "shares"])

    return docs.select("doc_id", "text").join(F.broadcast(grades), "doc_id").select("text", "y").mapInArrow(extract, "y int, classes array<int>, shares array<float>")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(features: DataFrame, w: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Summed gradient of the negative log-likelihood, the likelihood itself, and rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gw, gc, loss, rows = np.zeros(len(w)), np.zeros(len(cuts)), 0.0, 0
        for batch in batches:
            y = batch["y"].to_numpy()
            kinds, shares = batch["classes"], batch["shares"]
            row = np.repeat(np.arange(len(y)), np.diff(kinds.offsets.to_numpy()))
            kind, share = kinds.flatten().to_numpy(), shares.flatten().to_numpy().astype(np.float64)
            z = np.bincount(row, share * w[kind], len(y))
            # P(y) = s(z - cut_y) - s(z - cut_{y+1}) with cut_0 = -inf and the last one inf.
            upper = np.where(y > 0, sigmoid(z - cuts[np.maximum(y - 1, 0)]), 1.0)
            lower = np.where(y < len(cuts), sigmoid(z - cuts[np.minimum(y, len(cuts) - 1)]), 0.0)
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            dz = -(du - dl)
            gw += np.bincount(kind, share * dz[row], len(w))
            np.add.at(gc, y[y > 0] - 1, du[y > 0])
            np.add.at(gc, y[y < len(cuts)], -dl[y < len(cuts)])
            loss -= np.log(p).sum()
            rows += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([gw.tobytes()]), pa.array([gc.tobytes()]), pa.array([float(loss)]), pa.array([rows], pa.int64())], ["gw", "gc", "loss", "n"])

    parts = features.mapInArrow(partial, "gw binary, gc binary, loss double, n long").collect()
    total = [sum((np.frombuffer(p[k]) for p in parts), np.zeros(size)) for k, size in ((0, len(w)), (1, len(cuts)))]
    return total[0], total[1], sum(p[2] for p in parts), sum(p[3] for p in parts)


def fit(features: DataFrame, grades: int = 3, steps: int = STEPS, rate: float = 1.5, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the full gradient; thresholds are a first one and positive steps."""
    w, raw = np.zeros(SIZE), np.concatenate([[-2.0], np.full(grades - 2, 0.5)])
    m = v = np.zeros(SIZE + len(raw))
    for t in range(1, steps + 1):
        jumps = np.log1p(np.exp(raw[1:]))
        cuts = np.cumsum(np.concatenate([raw[:1], jumps]))
        gw, gc, _, n = gradient(features, w, cuts)
        if not n:
            break
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([gw / n + ridge * w, tail[:1] / n, tail[1:] / n * sigmoid(raw[1:])])
        m, v = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g
        step = rate / (1 + t / 12) * (m / (1 - 0.8**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-7)
        w, raw = w - step[:SIZE], raw - 0.3 * step[SIZE:]
    return w, np.cumsum(np.concatenate([raw[:1], np.log1p(np.exp(raw[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """Graded ratings: 0 for bad quality, 1 for good but toxic, 2 for good and clean."""
    return labels.withColumn("grade", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2))


def ordinal_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, steps: int = STEPS) -> DataFrame:
    """One row per document: doc_id, held_out, expected_grade, p_usable (grade of 1 or more), p_best (grade 2), kept (p_usable >= 0.5).

    Rows whose crc32(doc_id) mod 5 is 0 are never learnt from. A null or empty text has no features: its prediction is the thresholds'
    alone. Without graded rows the start values decide. Repeated rows are predicted alike; an empty table gives no rows.
    """
    features = written(sample_features(docs, training_labels(graded(labels), "grade", rows)), "graded")
    w, cuts = fit(features, steps=steps)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                row, kind, share = hashed(texts_of(batch))
                z = np.bincount(row, share * w[kind], batch.num_rows)
                tail = [sigmoid(z - c) for c in cuts]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.sum(tail, 0)), pa.array(tail[0]), pa.array(tail[-1])], ["doc_id", "expected_grade", "p_usable", "p_best"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, expected_grade double, p_usable double, p_best double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "p_usable", "p_best", (F.col("p_usable") >= 0.5).alias("kept"))
