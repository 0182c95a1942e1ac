"""Toxicity by boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled rows: those that stand in far more
toxic than clean texts. Features are its densities (plain, weighted, in words whose letters are
replaced by signs), how often its words stand near a second person, and rates of capitals,
punctuation and obfuscation. Halves of the sample get the lexicon of the other half, so that the
trees see it as it works on unseen texts; out-of-half scores calibrate.

Scale: the labelled sample is bounded by ``sample`` rows of each class, chosen by a hash of the id;
its word counts are summed in Spark and its features (a few kB a hundred rows) go to the driver.
Trees and calibration weight its rows by their class's share of all labels, so that a score keeps its meaning.
Scoring is a map over whole texts without a shuffle. Labels, ids, languages and sources are no features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import fit_isotonic, fit_trees
from .features import _SECOND, Words, describe, member
from .scratch import materialize
from .tables import fresh
from .textbuf import U64, pieces

#: Most labelled rows of each class, least toxic texts and odds of an entry, the reach of a pronoun, and the score from which a text counts as toxic.
SAMPLE, SUPPORT, ODDS, REACH, THRESHOLD = 6000, 3, 8.0, 5, 0.3
PREFIXES = (4, 5, 6)
_SALT = (U64(0), U64(0x1234567887654321), U64(0x2468135713572468), U64(0x3C3C5A5A69699696))


def _entries(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and word numbers of all whole words and word beginnings."""
    yield w.hash, np.arange(len(w.hash))
    for salt, n in zip(_SALT[1:], PREFIXES, strict=True):
        h, longer = w.prefix_hash(n)
        yield h ^ salt, np.flatnonzero(longer)


class Lexicon:
    """Sorted hashes with log odds."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]

    def features(self, w: Words) -> np.ndarray:
        rows, words = len(w.offsets) - 1, len(w.hash)
        weight = np.zeros(words)
        if len(self.keys):
            for h, of in _entries(w):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                np.maximum.at(weight, of[hit], self.weights[at[hit]])
        plain, odd = w.plain_hash()
        hidden = np.zeros(words, bool)
        hidden[np.flatnonzero(odd)] = member(plain, self.keys)
        found = (weight > 0) | hidden
        you = np.concatenate([[0], np.cumsum(member(w.hash, _SECOND))])
        low = np.maximum(np.arange(words) - REACH, w.first[:-1][w.row] if words else 0)
        high = np.minimum(np.arange(words) + REACH + 1, w.first[1:][w.row] if words else 0)
        near = found & (you[high] > you[low])
        n = np.maximum(np.diff(w.first), 1)
        top = np.zeros(rows)
        np.maximum.at(top, w.row, weight)
        hits = w.count(found)
        return np.stack([hits, hits / n, w.count(weight) / n, top, w.count(hidden), w.count(near), w.count(near) / n], 1)


def _features(w: Words, lexicon: Lexicon) -> np.ndarray:
    return np.concatenate([describe(w), lexicon.features(w)], 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(text, toxic, half)`` to counts of texts by entry, half and class, summed within a batch."""
    for batch in batches:
        toxic, half = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in pieces(batch.column(0)):
            w = Words(data, offsets)
            h = np.concatenate([x for x, _ in _entries(w)])
            row = np.concatenate([w.row[of] for _, of in _entries(w)])
            by = np.lexsort((row, h))
            h, row = h[by], row[by]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, cell = h[once], (2 * half + toxic)[first:last][row[once]]
            keys, at = np.unique(h, return_inverse=True)
            counts = np.bincount(at * 4 + cell, minlength=4 * len(keys)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(counts[:, i]) for i in range(4))], ["h", "c0", "t0", "c1", "t1"])


def _lexicon(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Lexicon:
    odds = np.log((toxic + 0.1) / (n_toxic + 0.2)) - np.log((clean + 0.1) / (n_clean + 0.2))
    good = (toxic >= SUPPORT) & (odds > np.log(ODDS))
    return Lexicon(keys[good], odds[good])


class Model:
    """What scoring needs: the lexicon, the trees and the calibration."""

    def __init__(self, lexicon: Lexicon, trees, calibration):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.trees.raw(_features(Words(data, offsets), self.lexicon))), 0.0, 1.0)


def _class_weights(of_class: dict[int, int], sample: int) -> np.ndarray:
    """How many labels of its class a sampled row stands for, scaled to a mean of 1; all 1 where no label is left out."""
    known = np.array([of_class.get(y, 0) for y in (0, 1)])
    used = np.minimum(known, sample)
    return known * used.sum() / np.maximum(used * known.sum(), 1)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from ``labels``, of which at most ``sample`` of each class are used.

    That bound makes the labels small enough to send to every task, so the texts stay where they are, and bounds
    the entries that are counted. Of several texts with one id the least is used. Other labels than 0 and 1 are left out; a null text is an empty one. Without rows of both classes
    the model is a constant.
    """
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"), F.pmod(F.xxhash64(F.lit(5), key), F.lit(2)).cast("int").alias("half"), F.xxhash64(F.lit(6), key).alias("o"))
    of_class = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    few = [marked.where(F.col("y") == y).orderBy("o").limit(sample) for y in (0, 1)]
    known = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), key).join(F.broadcast(few[0].unionByName(few[1])), F.col(key) == F.col("_key"))
    # one text for each label, also where an id is repeated: the sample stays within its bound
    use = materialize(known.groupBy("_key", "y", "half").agg(F.min("t").alias("t")).select("t", "y", "half"), "labelled")
    sizes = {(r["half"], r["y"]): r["n"] for r in use.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    counts = use.mapInArrow(_count, "h long, c0 long, t0 long, c1 long, t1 long").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
    # entries of the bounded sample that stand in enough toxic texts; which of them tell is decided half by half
    found = counts.where(F.col("t0") + F.col("t1") >= SUPPORT).select("h", "c0", "t0", "c1", "t1").toPandas().to_numpy(np.int64).reshape(-1, 5)
    keys, (c0, t0, c1, t1) = np.ascontiguousarray(found[:, 0]).view(np.uint64), found[:, 1:].T.astype(float)
    n = lambda half, y: sizes.get((half, y), 0)
    ones = [_lexicon(keys, t1, c1, n(1, 1), n(1, 0)), _lexicon(keys, t0, c0, n(0, 1), n(0, 0))]  # for half 0 that of half 1
    whole = _lexicon(keys, t0 + t1, c0 + c1, n(0, 1) + n(1, 1), n(0, 0) + n(1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(2).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in pieces(batch.column(0)):
                w = Words(data, offsets)
                x = np.where(half[first:last, None] == 0, _features(w, ones[0]), _features(w, ones[1]))
                yield pa.RecordBatch.from_arrays([batch.column(1)[first:last], batch.column(2)[first:last], pa.array([r.tobytes() for r in x], pa.binary())], ["y", "half", "x"])

    got = use.mapInArrow(run, "y int, half int, x binary").orderBy("x", "y", "half").collect()
    y, half = np.array([r["y"] for r in got], float), np.array([r["half"] for r in got])
    width = len(_features(Words(np.zeros(0, np.uint8), np.zeros(2, np.int64)), whole)[0])
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(-1, width)
    weight = _class_weights(of_class, sample)[y.astype(int)]
    unseen = np.zeros(len(y))
    for h in (0, 1):
        unseen[half == h] = fit_trees(x[half != h], y[half != h], weight[half != h]).raw(x[half == h])
    return Model(whole, fit_trees(x, y, weight), fit_isotonic(unseen, y, weight))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score``, a double from 0 to 1.

    A null text scores as an empty one. Where ``docs`` has a column ``score``, the new one is ``score_``.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(len(names))):
                cut = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], pa.array(model.score(data, offsets))], [*names, "score"])

    shape = rows.select(*names, F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, shape).toDF(*docs.columns, fresh(docs, "score"))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def query(spark, sf_dir: str) -> DataFrame:
    """``op9_score_toxicity``: scores of all documents, learned from the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = train(docs, labels)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
