"""Hard negatives by blocked dense products.

Anchors are cut into rounds of a bounded size.  A round's anchors, sorted by label, are one broadcast; every task
multiplies them in float64, block against block, with the candidates that it reads, and keeps the best few of
each anchor.  What tasks keep merges by anchor.

1.  Candidates of an anchor's own label give its positives.
2.  The positives' scores give each (anchor, positive) a window of scores; candidates of other labels give the
    best few inside each window.

Products are exact: in doubles while every sum stays below 2^53, else in Python's integers.  A task holds a round,
its best few and one block of scores, however many candidates it reads; a lost task reads its candidates again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .vector_search import _dots, pack, unpack

SCALE = 256
#: Bytes of a round's anchors as doubles (what is broadcast, and what the driver holds of them); anchors and candidates of a block.
ROUND_BYTES, ANCHORS, CANDIDATES = 16 << 20, 1024, 2048
#: A place without a score.
EMPTY = -(2**63) + 1


class Best:
    """The k best (score, id) of each key: higher scores first, ties by the smaller id."""

    def __init__(self, keys: int, k: int):
        self.k, self.score, self.id = k, np.full((keys, k), EMPTY), np.full((keys, k), 2**63 - 1)

    def offer(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(key):
            return
        some = np.unique(key)
        keys = np.concatenate([np.repeat(some, self.k), key])
        scores = np.concatenate([self.score[some].ravel(), score])
        ids = np.concatenate([self.id[some].ravel(), ident])
        order = np.lexsort((ids, -scores, keys))
        keys, first = keys[order], np.searchsorted(keys[order], some)
        chosen = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[some] = scores[chosen].reshape(-1, self.k)
        self.id[some] = ids[chosen].reshape(-1, self.k)

    def offer_block(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray, low: np.ndarray | None = None,
                    high: np.ndarray | None = None) -> None:
        """A block of scores, keys by ids; not those of an id that is the key's own, nor outside of low to high."""
        floor = self.score[keys, -1]
        if low is not None:
            scores = np.where(scores <= high[:, None], scores, float(EMPTY))
            floor = np.maximum(floor, low)
        near = scores >= floor[:, None].astype(scores.dtype)
        if scores.shape[1] > self.k + 1 and near.sum() > 16 * self.k * len(keys):
            # One more than k, as one may be the anchor itself.
            least = np.partition(scores, scores.shape[1] - self.k - 1, 1)[:, scores.shape[1] - self.k - 1]
            near &= scores >= least[:, None]
        row, column = np.nonzero(near & (scores > EMPTY + 1))
        other = ids[column] != own[row]
        row, column = row[other], column[other]
        self.offer(keys[row], scores[row, column].astype(np.int64), ids[column])

    def batch(self) -> pa.RecordBatch:
        key, place = np.nonzero(self.score != EMPTY)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(self.score[key, place]), pa.array(self.id[key, place])], ["key", "score", "id"])


def rows_of(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole numbers floor(scale x), packed), dim; without rows that hold a null or a non-finite component.  Equal rows stay once."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))

    @F.arrow_udf("binary")
    def packed(rows: pa.Array) -> pa.Array:
        return pa.array([pack(np.array(r, np.float64)) for r in rows.to_pylist()], pa.binary())

    good = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    out = good.select("vec_id", F.col("label").cast("long").alias("label"), packed(whole).alias("v"), F.size(x).alias("dim"))
    return out.dropDuplicates(["vec_id", "label", "v"])


class Round:
    """Anchors sorted by label: ids, labels, vectors, and where each label's begin."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        self.low = self.high = None

    def parts(self, label: int, same: bool) -> list[tuple[int, int]]:
        """Ranges of anchors, of at most ANCHORS each, of this label or of all others."""
        a, b = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, "right")
        whole = [(a, b)] if same else [(0, a), (b, len(self.ids))]
        return [(x, min(x + ANCHORS, y)) for i, y in whole for x in range(i, y, ANCHORS)]


def _pass(shared, dim: int, k: int, windows: int = 0):
    """Over candidates: the k best of each anchor's label, or of the others inside each of an anchor's windows."""

    def run(batches):
        anchors = shared.value
        best = Best(len(anchors.ids) * max(1, windows), k)
        for batch in batches:
            ids, labels, v = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), batch.column("v")
            order = np.lexsort((ids, labels))
            edges = [0, *(np.flatnonzero(np.diff(labels[order])) + 1).tolist(), len(order)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for at in range(a, b, CANDIDATES):
                    some = order[at : min(at + CANDIDATES, b)]
                    x = unpack(v.take(pa.array(some)).to_pylist(), dim)
                    for i, j in anchors.parts(labels[some[0]], not windows):
                        scores = _dots(anchors.v[i:j], x)
                        own, keys = anchors.ids[i:j], np.arange(i, j)
                        if not windows:
                            best.offer_block(keys, scores, ids[some], own)
                        for w in range(windows):
                            best.offer_block(keys * windows + w, scores, ids[some], own, anchors.low[i:j, w], anchors.high[i:j, w])
        yield best.batch()

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """key, score, id, rank of the k best of each key."""
    best = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(table: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, low: int = 50, high: int = 95, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``table`` (vec_id, embedding, label: a whole number).

    Anchors are the rows whose vec_id is divisible by ``every``; scores are inner products with the anchor.  An
    anchor's positives are its best ``positives`` rows of its label; for each, the best ``negatives`` rows of other
    labels with ``low`` <= 100 * score / positive score <= ``high`` are returned (none where the positive's score is
    below 0).  Higher scores come first, ties by the smaller id; all are taken where there are fewer.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.  Equal rows count
    once; no row with an anchor's own id is its positive or negative; an id that repeats with other values is
    several rows.  Shorter vectors go on with zeros.  An empty table, or none without anchors, gives no rows;
    other columns are not read.
    """
    spark = table.sparkSession
    scratch = Scratch(spark)
    data = scratch.save(rows_of(table), "rows")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    asked = data.where(F.pmod("vec_id", F.lit(every)) == 0)
    dim, n = data.agg(F.max("dim")).first()[0], asked.count()
    if not n or not dim:
        return spark.createDataFrame([], schema)
    # Of equal vectors of a label only the smallest ids (one may be the anchor's own) can be among anyone's best.
    same = Window.partitionBy("label", "v").orderBy("vec_id")
    own = data.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    few = data.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= max(positives, negatives) + own)
    candidates = scratch.save(few.select("vec_id", "label", "v"), "candidates")
    rounds = -(-n * dim * 8 * 5 // (round_bytes * 4))  # four fifths full, as hashes deal anchors out
    dealt = asked.select("vec_id", "label", "v", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(rounds)).cast("int").alias("round"))
    out = []
    for r in range(rounds):
        mined = _round(candidates, dealt.where(F.col("round") == r).select("vec_id", "label", "v"), dim, positives, negatives, low, high)
        if mined is not None:
            out.append(scratch.save(mined, f"round{r}"))
    scratch.drop("rows", "candidates")
    result = out[0] if out else spark.createDataFrame([], schema)
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _round(candidates: DataFrame, chosen: DataFrame, dim: int, positives: int, negatives: int, low: int, high: int) -> DataFrame | None:
    spark = candidates.sparkSession
    got = chosen.toArrow()
    if not got.num_rows:
        return None
    anchors = Round(got.column("vec_id").to_numpy(), got.column("label").to_numpy(), unpack(got.column("v").to_pylist(), dim))
    kinds = "key bigint, score bigint, id bigint"
    shared = spark.sparkContext.broadcast(anchors)
    found = _top(candidates.mapInArrow(_pass(shared, dim, positives), kinds), positives).select("key", "score", "id", "rank").toArrow()
    if not found.num_rows:
        return None
    key, score, ident, rank = (found.column(c).to_numpy() for c in ("key", "score", "id", "rank"))
    anchors.low, anchors.high = np.full((len(anchors.ids), positives), 1), np.full((len(anchors.ids), positives), EMPTY)
    for k, s, place in zip(key.tolist(), score.tolist(), (rank - 1).tolist(), strict=True):
        anchors.low[k, place], anchors.high[k, place] = -((-low * s) // 100), high * s // 100
    windows = spark.sparkContext.broadcast(anchors)
    best = _top(candidates.mapInArrow(_pass(windows, dim, negatives, positives), kinds), negatives)
    # At most ``positives`` rows for each anchor of a round, whose size is bounded.
    of = pa.table({"key": key * positives + rank - 1, "anchor_id": anchors.ids[key], "positive_id": ident, "positive_score": score})
    named = best.join(F.broadcast(spark.createDataFrame(of)), "key")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
