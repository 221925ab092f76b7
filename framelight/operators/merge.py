"""Captures put together and taken apart: merging by time, differences of frames."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Frames of a range, about; ranges, at most: beyond, each has more frames.
RANGE_ROWS, MOST_RANGES = 500_000, 4096
_NO_TIME = -(1 << 63)


def _key(file: str | None, number: int | None) -> tuple:
    """Place among frames of one time, as Spark orders it: nulls first."""
    return file is not None, file or "", number is not None, number or 0


def _range_of(splitters: pa.Table) -> Callable[[Column, Column, Column], Column]:
    """How many of the sorted ``splitters`` (t, f, k) are at or below a place: a search in their times, and among equal times in file and number."""
    times = splitters["t"].to_numpy()
    keys = list(map(_key, splitters["f"].to_pylist(), splitters["k"].to_pylist()))

    @F.arrow_udf("int")
    def of(t: pa.Array, f: pa.Array, k: pa.Array) -> pa.Array:
        t = t.to_numpy(zero_copy_only=False)
        low, out = np.searchsorted(times, t, "left"), np.searchsorted(times, t, "right")
        tied = np.flatnonzero(low < out)
        some = pa.array(tied)
        for i, file, number in zip(tied.tolist(), f.take(some).to_pylist(), k.take(some).to_pylist(), strict=True):
            out[i] = bisect_right(keys, _key(file, number), low[i], out[i])
        return pa.array(out, pa.int32())

    return of


def merged(frames: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """``frames`` (with ``time_exact``, file, number; frames without a time come first) in one order of time, numbered without gaps as ``merged_number``.

    Ties of time go by file and number.  Ranges of (time, file, number) are cut at splitters that are fixed once found,
    so a range has the same frames whenever it is computed again; a number is what comes before its range and its place
    in it.  Many frames of one time are cut too, by file and number.  Frames are computed twice: for their places,
    which are kept while ranges are found and counted, and for the result.
    """
    place = F.coalesce("time_exact", F.lit(_NO_TIME)).cast("long").alias("t"), F.col("file").alias("f"), F.col("number").cast("long").alias("k")
    places = frames.select(*place).persist()
    total = places.count()
    n = min(MOST_RANGES, max(1, -(-total // rows)))
    which, counts = F.lit(0), np.array([total], np.int64)
    if n > 1:
        # About 40 sampled places for each range, chosen by a hash: the same whenever it is asked again.
        share = max(1, total // (40 * n))
        sample = places.where(F.pmod(F.xxhash64("t", "f", "k"), F.lit(share)) == 0).orderBy("t", "f", "k").toArrow()
        at = sorted({len(sample) * j // n for j in range(1, n)}) if len(sample) else []
        range_of = _range_of(sample.take(pa.array(at, pa.int64())))
        counts = np.zeros(len(at) + 1, np.int64)
        for r in places.groupBy(range_of("t", "f", "k").alias("r")).count().collect():
            counts[r.r] = r["count"]
        which = range_of(*place)
    places.unpersist()
    order = Window.partitionBy("_range").orderBy(F.col("time_exact").asc_nulls_first(), "file", "number")
    before = F.get(F.lit(np.cumsum(counts) - counts), F.col("_range"))
    return frames.withColumn("_range", which).withColumn("merged_number", before + F.row_number().over(order)).drop("_range")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frames of ``left`` that ``right`` lacks, duplicates by count: of equal frames (link type and bytes) as many stay, the last
    ones in order of file and number, as left has more.

    Frames meet by a 128-bit fingerprint; counts of right are added up before they move.  Frames without bytes are
    equal to one another.
    """
    kind = F.encode(F.concat(F.coalesce(F.col("link_type").cast("string"), F.lit("")), F.lit("|")), "UTF-8")
    print_ = F.unhex(F.md5(F.concat(kind, F.coalesce("raw", F.lit(b""))))).alias("_print")
    have = right.select(print_).groupBy("_print").agg(F.count("*").alias("_have"))
    order = Window.partitionBy("_print").orderBy("file", "number")
    ranked = left.select("*", print_).withColumn("_rank", F.row_number().over(order))
    return ranked.join(have, "_print", "left").where("_rank > coalesce(_have, 0)").drop("_print", "_rank", "_have")
