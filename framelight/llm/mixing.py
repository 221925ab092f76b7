"""Mixing sources to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document posteriors over domains.  The rates r >= 0 of
documents minimise

    1/2 |sum_i r_i t_i p_i / T - target|^2 + ridge/2 sum_i (t_i / T) (r_i - 1)^2

with a ridge so small that it only chooses among rates that come equally close to the targets; t_i are a
document's tokens, p_i its posteriors.  Projected gradient steps on the rates find it,

    r_i <- max(0, r_i - p_i e - ridge (r_i - 1)),   e = sum_i r_i t_i p_i / T - target,

each one aggregation over the documents, of which the D numbers of e reach the driver and go back into the next
step; they end when a step moves the rates by less than MOVED.  As the ridge is small, plain steps would take
long to choose among equally good rates, so they start near the end: at the minimum r_i = max(0, 1 + p_i v) for one v
of D numbers, which Newton steps on the dual find, first over cells of documents whose posteriors agree on a grid of
``GRID`` steps (one shuffle sums tokens and expected domain tokens by cell), then over the documents.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .words import blocks, utf8, word_hashes

#: At most so many labelled documents, those with the smallest hash of their id, one text each, fit the classifier.
MAX_LABELLED = 20_000
FEATURES = 1 << 16
GRID = 64
RIDGE = 1e-6
#: A bound only; the steps end where the dual's gradient is below SETTLED.
STEPS = 300
SETTLED = 1e-9
#: Gradient steps on the rates, at most, and the mean move of a rate at which they end.
DESCENTS, MOVED = 60, 1e-7
#: Expected domain tokens are summed in fractions of a token, as whole numbers, so that sums are the same in every run.
FRACTION = 1 << 20
#: Target shares of tokens.
TARGETS = {"high": 0.90, "low": 0.05, "toxic": 0.05}


def domain_of_labels() -> Column:
    """The domain of a row of ``labels``; null where it cannot be told."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


class Classifier:
    """Naive-Bayes log odds of hashed words, summarised by text and turned into posteriors by softmax regression."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.odds = np.zeros((FEATURES, len(domains)), np.float32)
        self.mean = np.zeros(1)
        self.scale = np.ones(1)
        self.weights = np.zeros((2 + 2 * len(domains), len(domains)))

    def set_counts(self, counts: np.ndarray) -> None:
        """``counts``: FEATURES x domains."""
        p = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * FEATURES))
        self.odds = (p - p.mean(1, keepdims=True)).astype(np.float32)

    def features(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(one row a text: mean and highest log odds for each domain, log length; words of each text)."""
        d = len(self.domains)
        rows, sizes = np.zeros((len(texts), 2 * d + 1)), np.zeros(len(texts), np.int64)
        for a, b in blocks(texts):
            words, first = word_hashes(texts[a:b])
            n = np.diff(first)
            sizes[a:b] = n
            full = np.flatnonzero(n)
            rows[a:b, 2 * d] = np.log1p(n)
            if len(full):
                odds = self.odds[(words % np.uint64(FEATURES)).astype(np.int64)]
                at = first[:-1][full]
                rows[a + full, :d] = np.add.reduceat(odds, at, 0, dtype=np.float64) / n[full, None]
                rows[a + full, d : 2 * d] = np.maximum.reduceat(odds, at, 0)
        return rows, sizes

    def fit(self, rows: np.ndarray, domain: np.ndarray, steps: int = 400) -> None:
        """Softmax regression by accelerated gradient on at most MAX_LABELLED rows."""
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-9
        x = self._design(rows)
        y = np.eye(len(self.domains))[domain]
        w = v = np.zeros((x.shape[1], y.shape[1]))
        step = 2.0 / (np.linalg.norm(x, 2) ** 2 / len(x) + 1e-3)
        for k in range(steps):
            new = v - step * (x.T @ (self._softmax(x @ v) - y) / len(x) + 1e-4 * v)
            v, w = new + k / (k + 3) * (new - w), new
        self.weights = w

    def _design(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([(rows - self.mean) / self.scale, np.ones((len(rows), 1))])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posteriors(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        rows, sizes = self.features(texts)
        return self._softmax(self._design(rows) @ self.weights), sizes


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = MAX_LABELLED) -> Classifier:
    """``labelled``: doc_id, domain.  Word counts come from one half of the sample, the regression from the other."""
    spark = docs.sparkSession
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    chosen = known.select("doc_id", "domain").orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most)
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int")
    train = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    train = train.groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("text", "domain", half.alias("half"))
    code = {x: i for i, x in enumerate(domains)}

    def count(batches):
        for batch in batches:
            texts, domain = utf8(batch.column("text")), batch.column("domain").to_pylist()
            for a, b in blocks(texts):
                words, first = word_hashes(texts[a:b])
                of = np.repeat([code[x] for x in domain[a:b]], np.diff(first)).astype(np.int64)
                key, n = np.unique((words % np.uint64(FEATURES)).astype(np.int64) * len(domains) + of, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    out = Classifier(domains)
    counts = np.zeros(FEATURES * len(domains))
    for r in train.where("half = 0").select("text", "domain").mapInArrow(count,
        "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.key] = r.n
    out.set_counts(counts.reshape(FEATURES, len(domains)))
    shared = spark.sparkContext.broadcast(out)

    def featured(batches):
        for batch in batches:
            rows, _ = shared.value.features(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), batch.column("domain")], ["x", "domain"])

    rows = train.where("half = 1").select("text", "domain").mapInArrow(featured, "x array<double>, domain string").collect()
    if rows:
        rows.sort(key=lambda r: (r.domain, r.x))  # the same order, hence the same sums, in every run
        out.fit(np.array([r.x for r in rows]), np.array([code[r.domain] for r in rows]))
    return out


def membership(classifier: Classifier, text: Column) -> Column:
    """struct<tokens, posterior, cell>: words, posteriors, and posteriors in GRID steps (largest remainders)."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(classifier)

    @F.arrow_udf("struct<tokens:bigint,posterior:array<double>,cell:array<int>>")
    def member(texts: pa.Array) -> pa.Array:
        p, sizes = shared.value.posteriors(utf8(texts))
        cell = np.floor(p * GRID).astype(np.int32)
        short = GRID - cell.sum(1)
        rank = np.argsort(np.argsort(-(p * GRID - cell), 1, kind="stable"), 1, kind="stable")
        cell += rank < short[:, None]
        return pa.StructArray.from_arrays([pa.array(sizes), pa.array(list(p), pa.list_(pa.float64())), pa.array(list(cell), pa.list_(pa.int32()))],
            ["tokens", "posterior", "cell"])

    return member(text)


def _newton(at, goal: np.ndarray, ridge: float, steps: int, point: np.ndarray) -> np.ndarray:
    """The v at which the dual's gradient vanishes.  ``at``: v -> (sum w r^2 / 2, sum w r p, sum over r > 0 of w p p')."""

    def dual(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, slope, bend = at(v)
        return value - goal @ v + ridge / 2 * v @ v, slope - goal + ridge * v, bend + ridge * np.eye(len(v))

    (value, slope, bend), size, settled = dual(point), 1.0, False
    for _ in range(steps):
        settled = np.abs(slope).max() < SETTLED
        if settled:
            break
        if size == 1.0:
            step = -np.linalg.solve(bend, slope)
        trial = dual(point + size * step)
        if trial[0] <= value + 1e-4 * size * (slope @ step) or np.abs(trial[1]).max() < SETTLED:
            point, (value, slope, bend), size = point + size * step, trial, 1.0
        elif size < 1e-9:
            break
        else:
            size /= 2
    if not settled:
        logging.getLogger(__name__).warning("rates not settled; domain shares miss their targets by %s", (slope - ridge * point).tolist())
    return point


def fit_cells(cells: DataFrame, targets: list[float], steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """v over ``cells``: cell, tokens, and perhaps expected (domain tokens in FRACTIONs).  No tokens: zeros."""
    total, d = cells.agg(F.sum("tokens").alias("t")).first().t or 0, len(targets)
    if not total:
        return np.zeros(d)
    names = ["f", *[f"g{j}" for j in range(d)], *[f"h{j}" for j in range(d * d)]]

    def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def partial(batches):
            sums = np.zeros(len(names))
            for batch in batches:
                p, w = cell_posteriors(batch, d), batch.column("tokens").to_numpy() / total
                r = np.maximum(0, 1 + p @ v)
                sums += [w @ (r * r) / 2, *(p.T @ (w * r)), *(p.T @ (p * (w * (r > 0))[:, None])).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names)

        got = np.array(cells.mapInArrow(partial, ",".join(f"{x} double" for x in names)).agg(*[F.sum(x) for x in names]).first())
        return got[0], got[1 : 1 + d], got[1 + d :].reshape(d, d)

    return _newton(at, np.array(targets), ridge, steps, np.zeros(d))


def cell_posteriors(batch, d: int) -> np.ndarray:
    """The mean posteriors of a cell's tokens, or the cell's own where it has none."""
    p = np.array(batch.column("cell").to_pylist(), np.float64).reshape(-1, d) / GRID
    if "expected" in batch.schema.names:
        tokens = batch.column("tokens").to_numpy()
        some = tokens > 0
        p[some] = np.array(batch.column("expected").to_pylist(), np.float64).reshape(-1, d)[some] / FRACTION / tokens[some, None]
    return p


def rate_of(posterior: Column, v: np.ndarray) -> Column:
    """max(0, 1 + p v)"""
    inner = sum((posterior[k] * F.lit(float(x)) for k, x in enumerate(v)), F.lit(1.0))
    return F.greatest(F.lit(0.0), inner)


def fit_documents(members: DataFrame, targets: list[float], start: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """v over ``members`` (tokens, posterior), from ``start``; sums are built-in aggregates."""
    total, d = members.agg(F.sum("tokens").alias("t")).first().t or 0, len(targets)
    if not total:
        return start

    def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        w, p = F.col("tokens") / F.lit(float(total)), [F.col("posterior")[k] for k in range(d)]
        r = F.col("r")
        sums = [F.sum(w * r * r / 2), *[F.sum(w * r * x) for x in p], *[F.sum(F.when(r > 0,
            w * p[i] * p[j]).otherwise(0.0)) for i in range(d) for j in range(i, d)]]
        got = np.array(members.withColumn("r", rate_of(F.col("posterior"), v)).agg(*sums).first(), float)
        bend = np.zeros((d, d))
        bend[np.triu_indices(d)] = got[1 + d :]
        return got[0], got[1 : 1 + d], bend + np.triu(bend, 1).T

    return _newton(at, np.array(targets), ridge, steps, start)


@dataclass(frozen=True)
class Rates:
    """Where the gradient steps on the rates start, the differences e that they followed, and the last of those: expected less target shares."""

    start: np.ndarray
    pulls: tuple[np.ndarray, ...]
    unmet: np.ndarray

    def of(self, posterior: Column, ridge: float = RIDGE) -> Column:
        r = rate_of(posterior, self.start)
        for e in self.pulls:
            r = F.greatest(F.lit(0.0), r * (1 - ridge) + ridge - sum(posterior[k] * F.lit(float(x)) for k, x in enumerate(e)))
        return r


def descend(members: DataFrame, targets: list[float], start: np.ndarray, steps: int = DESCENTS, ridge: float = RIDGE) -> Rates:
    """Projected gradient steps on the rates of ``members`` (tokens, posterior).

    The longest step that is safe for any posteriors is 1, as they sum to 1.  A step's rates are a function of the
    posteriors and the steps before, so nothing is written.  Without tokens nothing moves.
    """
    total, d = members.agg(F.sum("tokens").alias("t")).first().t or 0, len(targets)
    done = Rates(start, (), np.zeros(d))
    if not total:
        return done
    p, w = F.col("posterior"), F.col("tokens") / F.lit(float(total))
    before = None
    while True:
        r = done.of(p, ridge)
        sums = [F.sum(w * F.col("r") * p[k]) for k in range(d)] + [F.sum(w * F.abs(F.col("r") - F.col("old")))]
        got = members.withColumns({"r": r, "old": before if before is not None else F.lit(0.0)}).agg(*sums).first()
        e = np.array(got[:d]) - np.array(targets)
        if before is not None and got[d] <= MOVED or len(done.pulls) >= steps:
            return Rates(start, done.pulls, e)
        before, done = r, Rates(start, (*done.pulls, e), e)


def fit(members: DataFrame, targets: dict[str, float], scratch: Scratch) -> Rates:
    """The rates of ``members`` (tokens, posterior, cell): started over cells, then over documents, and descended over documents."""
    expected = [F.sum(F.round(F.col("tokens") * F.col("posterior")[k] * FRACTION).cast("bigint")) for k in range(len(targets))]
    cells = scratch.save(members.groupBy("cell").agg(F.sum("tokens").alias("tokens"), F.array(*expected).alias("expected")), "cells")
    shares = [x / sum(targets.values()) for x in targets.values()]
    return descend(members, shares, fit_documents(members, shares, fit_cells(cells, shares)))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, posterior, rate, unmet for every row.

    ``unmet`` is the largest difference of a domain's expected and target share, the same in all rows: near 0 unless no
    rates meet the targets, or the steps did not settle.

    Null and empty texts have no tokens and the posterior of an empty text.  Equal texts get equal rates,
    repeated rows and ids included.  With no labelled row posteriors are uniform; without tokens every rate
    is 1.  Of a repeated id's texts the alphabetically first trains.  An empty table gives no rows; other
    columns are not read.
    """
    targets = targets or TARGETS
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    classifier = fit_classifier(docs, labelled, list(targets))
    slim = scratch.save(docs.select("doc_id", membership(classifier, F.col("text")).alias("m")).select("doc_id", "m.*"), "members")
    rates = fit(slim, targets, scratch)
    scratch.drop("cells")
    unmet = F.lit(float(np.abs(rates.unmet).max()))
    return slim.select("doc_id", "tokens", "posterior", F.round(rates.of(F.col("posterior")), 9).alias("rate"), unmet.alias("unmet"))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Rows of ``docs``, all columns whatever their names, each as often as its rate says: the whole part, and once more with the rest as chance.

    The chance is a hash of the row's id and text, so a rerun gives the same rows, and equal rows stay or go
    together.  Nulls, ties, repeats and empty tables as in ``mix``.
    """
    targets = targets or TARGETS
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    classifier = fit_classifier(docs, labelled, list(targets))
    # Rows are written with their posteriors, so that Python sees each text once.
    whole = scratch.save(docs.select(F.struct(*docs.columns).alias("row"), membership(classifier, F.col("text")).alias("m")), "members")
    rates = fit(whole.select("m.cell", "m.tokens", "m.posterior"), targets, scratch)
    scratch.drop("cells")
    chance = F.pmod(F.xxhash64(F.lit("mix"), "row.doc_id", "row.text"), F.lit(1_000_000)) / 1_000_000
    rows = whole.select("row", F.round(rates.of(F.col("m.posterior")), 9).alias("rate"))
    times = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rows.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select("row.*")
