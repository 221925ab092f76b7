"""Sharding by sampled splitters.

Records are ordered by (hash of the text, id, row), so equal texts lie together and no two records are equal.
A sample in which a record occurs with a chance in proportion to its size gives quantile splitters; they cut
the order into ranges.  A range that holds more than twice its share is overfull: it is sampled again, more
finely, and subdivided, until every range has its share or a single record; so a hot text, or one id that
repeats, spans as many ranges as its bytes need.  Each range is sorted by one task, and exact sizes of the
ranges place the shard boundaries.  Shards have equal bytes up to one record, whatever the samples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

SHARDS = 8
#: Ranges, unless they held fewer than RANGE_ROWS rows each; above RANGE_BYTES each, more, up to MAX_RANGES (their splitters
#: and totals go to the driver).
RANGES, MAX_RANGES, RANGE_BYTES, RANGE_ROWS = 1024, 65_536, 64 << 20, 64
#: Expected sample records for each range.
OVERSAMPLE = 8
#: A range of more than so many times the mean is subdivided.
OVERFULL = 2


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, key (60 bits of a hash); a null text has size 1 and the checksum of nothing."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    key = F.conv(F.substring(F.md5(data), 1, 15), 16, 10).cast("long")
    return docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), key.alias("key"))


class Cuts:
    """Boundaries between ranges, rising: a record belongs to the range of the last boundary at or below it."""

    def __init__(self, points: list[tuple[int, int, int]]):
        self.points = sorted(set(points))
        self.columns = [np.array([p[k] for p in self.points], np.int64) for k in range(3)]

    def place(self, *record: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(record[0]), np.int64), np.full(len(record[0]), len(self.points), np.int64)
        for column, value in zip(self.columns, record, strict=True):
            # Within the stretch of boundaries that agree so far: below, equal, above.
            below, equal = lo.copy(), hi.copy()
            open_ = lo < hi
            for a, b in np.unique(np.stack([lo[open_], hi[open_]], 1), axis=0):
                mine = open_ & (lo == a) & (hi == b)
                below[mine] = a + np.searchsorted(column[a:b], value[mine], "left")
                equal[mine] = a + np.searchsorted(column[a:b], value[mine], "right")
            lo, hi = below, equal
        return hi.astype(np.int32)


def splitters(slim: DataFrame, ranges: int, total: int, salt: int = 0) -> list[tuple[int, int, int]]:
    """Boundaries (key, id, row) at the quantiles of a size-weighted sample of about ``OVERSAMPLE * ranges`` records."""
    want = OVERSAMPLE * ranges
    chance = (F.xxhash64(F.lit(f"shard {salt}"), "row") / F.lit(2.0**64)) + 0.5
    sample = slim.where(chance < F.col("size") * (want / max(total, 1))).select("key", "id", "row", "size").collect()
    points = sorted((r["key"], r["id"], r["row"], max(r["size"], total / want)) for r in sample)
    if not points:
        return []
    # A record larger than the sampling step stands for its whole size, the others for one step.
    weight = np.cumsum([p[3] for p in points])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return [points[i][:3] for i in at]


def _ranged(slim: DataFrame, cuts: Cuts) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def place(key: pa.Array, ident: pa.Array, row: pa.Array) -> pa.Array:
        return pa.array(shared.value.place(*(x.to_numpy(zero_copy_only=False) for x in (key, ident, row))))

    return slim.withColumn("range", place(F.col("key"), F.col("id"), F.col("row")))


def ranged(slim: DataFrame, ranges: int, total: int, scratch: Scratch) -> tuple[DataFrame, Cuts]:
    """``slim`` with its range, none overfull; and the boundaries."""
    cuts = Cuts(splitters(slim, ranges, total))
    most = OVERFULL * max(1, total // ranges)
    k = 0
    while True:
        placed = _ranged(slim, cuts)
        sums = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        full = {r["range"]: r["b"] for r in sums.where((F.col("b") > most) & (F.col("n") > 1)).collect()}
        if not full:
            return placed, cuts
        k += 1
        # All overfull ranges in one sample, in proportion to their bytes; two pieces each at least.
        inside = scratch.save(placed.where(F.col("range").isin(list(full))), f"overfull{k}")
        bytes_in = sum(full.values())
        new = splitters(inside, max(2 * len(full), 2 * bytes_in // most), bytes_in, k)
        # Where sampling finds no further boundary, the last record of each range is one.
        ends = inside.groupBy("range").agg(F.max(F.struct("key", "id", "row")).alias("p")).collect()
        cuts = Cuts([*cuts.points, *new, *[(r["p"]["key"], r["p"]["id"], r["p"]["row"]) for r in ends]])
        scratch.drop(f"overfull{k}")


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null) for every row.

    Null texts count as empty.  Null ids come first among equal texts; rows that repeat id and text are told
    apart by their place in the input and get slots of their own.  An empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    numbered = records(docs).withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "row": F.monotonically_increasing_id()})
    slim = scratch.save(numbered, "records")
    size = slim.agg(F.sum("size").alias("t"), F.count("*").alias("n")).first()
    total = size.t or 0
    ranges = min(MAX_RANGES, max(shards, min(ranges, size.n // RANGE_ROWS), total // RANGE_BYTES))
    placed, _ = ranged(slim, ranges, total, scratch)
    # Within a range: bytes and rows before each record.
    w = Window.partitionBy("range").orderBy("key", "id", "row")
    run = placed.withColumns({"bytes": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "rows": F.row_number().over(w) - 1})
    run = scratch.save(run.select("doc_id", "size", "text_crc32", "range", "bytes", "rows"), "ranges")
    sums = {r["range"]: (r["b"], r["n"]) for r in run.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    offset, b, n = [], 0, 0
    for k in sorted(sums):
        offset.append((k, b, n))
        b, n = b + sums[k][0], n + sums[k][1]
    before = spark.createDataFrame(offset, "range int, b long, n long")
    at = run.join(F.broadcast(before), "range")
    # The record's first byte decides; in decimals, as bytes * shards may pass 2^63.
    home = F.floor((F.col("bytes") + F.col("b")).cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(38,0)"))
    at = at.select("doc_id", "size", "text_crc32", F.least(home.cast("int"), F.lit(shards - 1)).alias("shard"), (F.col("rows") + F.col("n")).alias("rank"))
    first = [(r["shard"], r["f"]) for r in at.groupBy("shard").agg(F.min("rank").alias("f")).collect()]
    out = at.join(F.broadcast(spark.createDataFrame(first, "shard int, f long")), "shard")
    scratch.drop("records")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("f")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
