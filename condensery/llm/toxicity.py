"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and digits or signs used as letters to Latin letters, and
everything else to spaces. The lexicon (whole words and word beginnings with log-odds weights) is learnt from labelled rows whose crc32(doc_id) mod 5 is
not 0; a text's score is a logistic function of its matched weight, in all and per word.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, texts_of, written

#: Expected number of labelled rows that the lexicon and the calibration are learnt from, and the most entries of the lexicon.
TRAINING_ROWS, ENTRIES = 20_000, 5_000
#: Lengths of word beginnings that may become entries; the share of toxic texts among those that have an entry.
STEMS, PRECISION = (4, 5, 6, 7), 0.6
#: Phrases in which an entry does not count.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid simple")
#: Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "s", "ø": "o", "æ": "a", "œ": "o", "ł": "l", "đ": "d", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "!": "i", "|": "l",
}


class Folding(dict):
    """A table for str.translate that works out each character once."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", chr(code)).lower()
        c = "".join(LOOKALIKES.get(x, x) for x in c if not unicodedata.combining(x))
        c = "".join(LOOKALIKES.get(x, x if x.isalpha() else " ") for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) or ("" if unicodedata.combining(chr(code)) else " ")
        self[code] = c
        return c


FOLDING = Folding()


def fold(text: str) -> str:
    """Folded text with a space at both ends. Signs that stand for letters inside a word are spaces at its ends."""
    for sign in "!|$@€":
        if sign in text:
            text = " ".join(w.strip("!|$@€") for w in text.split())
            break
    return f" {text.translate(FOLDING)} "


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(doc_id, y) of about ``rows`` labelled rows that are not held out, chosen by a hash of the id; of several labels of one id the largest."""
    able = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(column).cast("int").alias("y"))
    share = min(1.0, rows / max(1, able.count()))
    return able.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.max("y").alias("y"))


@functools.lru_cache(2)
def automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in entries:
        a.add_word(term, (len(term), weight))
    for phrase in exceptions:
        a.add_word(f" {phrase} ", (len(phrase) + 2, None))
    if len(a):
        a.make_automaton()
    return a


def matched(folded: str, a) -> tuple[float, int]:
    """Weight and number of the longest entry at each place, without those inside an exception phrase."""
    if not len(a):
        return 0.0, 0
    best: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    for end, (size, weight) in a.iter(folded):
        begin = end + 1 - size
        if weight is None:
            free.append((begin, end))
        elif size > best.get(begin, (0, 0.0))[0]:
            best[begin] = (size, weight)
    if free:
        best = {b: x for b, x in best.items() if not any(f <= b and b + x[0] - 1 <= t for f, t in free)}
    return sum(w for _, w in best.values()), len(best)


def evidence(texts: DataFrame, columns: list[str], entries: tuple, exceptions: tuple) -> DataFrame:
    """``columns`` with (weight, hits, n_words) of each text."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(entries, exceptions)
        for whole in batches:
            for batch in slices(whole):
                weights, hits, words = [], [], []
                for text in texts_of(batch).to_pylist():
                    weight, n = matched(fold(text), a)
                    weights.append(weight)
                    hits.append(n)
                    words.append(text.count(" ") + text.count("\n") + 1)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(weights, pa.float64()), pa.array(hits, pa.int64()), pa.array(words, pa.int64())], [*columns, "weight", "hits", "n_words"])

    kinds = dict(texts.dtypes)
    return texts.select(*columns, "text").mapInArrow(match, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", weight double, hits long, n_words long")


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(np.maximum(weight, 0)), np.log1p(100 * np.maximum(weight, 0) / np.maximum(words, 1))], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Weights by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> tuple[tuple, list[float]]:
    """The lexicon's entries with weights, and the calibration's weights."""
    # Bounded by ``rows``, so it can be broadcast and its texts kept.
    chosen = written(docs.select("doc_id", "text").join(F.broadcast(training_labels(labels, "toxic", rows)), "doc_id"), "toxic-sample")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found, labels_ = [], []
                for text, y in zip(texts_of(batch).to_pylist(), batch["y"].to_pylist(), strict=True):
                    own = set(fold(text).split())
                    own = {f" {w} " for w in own if len(w) > 2} | {f" {w[:n]}" for w in own for n in STEMS if len(w) > n}
                    found += own
                    labels_ += [y] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels_, pa.int64())], ["term", "y"])

    bad, n = chosen.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    if not bad or bad == n:
        return (), [math.log((bad + 0.5) / (n - bad + 0.5)), 0.0, 0.0]
    base = bad / n
    counts = chosen.mapInArrow(terms, "term string, y long").groupBy("term").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).filter("pos > 2")
    counts = written(counts, "toxic-terms")
    # Entries that chance alone would give among so many terms: fewer than one.
    evidence_needed = 2 * math.log(2 * max(1, counts.count()))
    neg = F.col("n") - F.col("pos")
    ratio = 2 * (F.col("pos") * F.log(F.col("pos") / (F.col("n") * base)) + F.when(neg > 0, neg * F.log(neg / (F.col("n") * (1 - base)))).otherwise(0.0))
    weight = F.log((F.col("pos") + 0.5) / (bad + 1)) - F.log((neg + 0.5) / (n - bad + 1))
    picked = counts.filter(F.col("pos") > max(base, PRECISION) * F.col("n")).withColumn("ratio", ratio).filter(F.col("ratio") >= evidence_needed).withColumn("weight", F.round(weight, 6))
    entries = tuple((r["term"], r["weight"]) for r in picked.orderBy(F.desc("ratio"), "term").limit(ENTRIES).collect())
    seen = evidence(chosen, ["y"], entries, exceptions).select("y", "weight", "n_words").toPandas()
    return entries, logistic(features(seen["weight"].to_numpy(), seen["n_words"].to_numpy()), seen["y"].to_numpy(np.float64))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, hits.

    A null or empty text has no matches and gets the lowest score. A null doc_id is scored and never learnt from. Without labels of
    both kinds the lexicon is empty and all scores equal the base rate. Repeated rows are scored alike. An empty table gives no rows.
    """
    entries, w = learn(docs, labels, rows, exceptions)
    seen = evidence(docs.select("doc_id", "text"), ["doc_id"], entries, exceptions)
    weight = F.greatest("weight", F.lit(0.0))
    z = F.lit(w[0]) + w[1] * F.log1p(weight) + w[2] * F.log1p(100 * weight / F.greatest("n_words", F.lit(1)))
    score = 1 / (1 + F.exp(-z))
    return seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "hits")
