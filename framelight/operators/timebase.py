"""Packet times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files whose anchors are broadcast, at most (some 60 bytes each).
MOST_FILES = 1_000_000

_STAMP = (
    "case when format = 'pcapng' and status in ('ok', 'truncated') then cast((cast(ts_hi as double) * 4294967296D + cast(ts_lo as double)) * "
    "0.001D as bigint) end"
)


def with_anchors(frames: DataFrame) -> DataFrame:
    """Adds ``zero_sec`` and ``zero_us`` where a reader has not.

    The anchors are one partial aggregate per file.  With at most MOST_FILES files, which are counted first,
    they are broadcast, so that frames stay where they are; with more they are joined by file.
    """
    if "zero_sec" in frames.columns:
        return frames
    stamped = frames.selectExpr("file", "number", f"{_STAMP} as stamp").where("stamp is not null")
    stamped = stamped.selectExpr("file", "number", "stamp div 1000000 as sec", "stamp % 1000000 as us")
    first = lambda c: f"min(case when {c} != 0 then struct(number, {c} as v) end)"
    anchors = stamped.groupBy("file").agg(F.expr(first("sec")).alias("a"), F.expr(first("us")).alias("b"))
    if anchors.limit(MOST_FILES + 1).count() <= MOST_FILES:
        anchors = F.broadcast(anchors)
    since = lambda x: f"case when number >= {x}.number then {x}.v else 0 end"
    out = frames.join(anchors, "file", "left")
    return out.selectExpr(*frames.columns, f"pmod({since('a')}, 4294967296) as zero_sec", f"{since('b')} as zero_us")


def with_time(frames: DataFrame) -> DataFrame:
    """Adds ``time`` (seconds, double) and ``time_exact`` (microseconds, bigint).

    A classic capture has absolute times.  A pcapng timestamp is taken as nanoseconds, scaled in doubles
    and cut; its time is relative to two anchors of its file: the first non-zero seconds part and, apart
    from it, the first non-zero microseconds part, each from its own frame on.  Frames without a decoded
    timestamp have no time and anchor nothing.
    """
    base = with_anchors(frames).selectExpr("*", f"{_STAMP} as stamp")
    at = lambda s, u: f"(cast({s} as double) + 10e-7D * cast({u} as double))"
    relative = f"{at('stamp div 1000000', 'stamp % 1000000')} - {at('zero_sec', 'zero_us')}"
    classic = "format = 'pcap' and status in ('ok', 'truncated')"
    return base.selectExpr(
        *frames.columns,
        f"case when {classic} then {at('ts_hi', 'ts_lo')} when stamp is not null then {relative} end as time",
        f"case when {classic} then ts_hi * 1000000 + ts_lo else stamp end as time_exact",
    )
