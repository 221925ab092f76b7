"""Statistics of packets: protocol hierarchy, endpoints, top talkers.  ``packets`` is the packet table, tracked or not."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a distinct-count sketch (2 to this power registers): a standard error of about 1.04 / sqrt(2 ** 12) = 1.6 %.
SKETCH = 12
#: Counters that a task keeps; talkers that are looked for again by broadcast, at most.
COUNTERS, MOST_TALKERS = 10_000, 500_000


def protocol_hierarchy(packets: DataFrame) -> DataFrame:
    """depth, l3, l4, protocol, frames, bytes: all frames (depth 0), by network layer, by transport, by protocol.

    One rollup: partial sums of the few groups of a task are moved, never frames.  Layers that a frame lacks show
    as ``none``; levels that a row does not tell apart are NULL.
    """
    named = packets.selectExpr("coalesce(l3, 'none') as l3", "coalesce(l4, 'none') as l4", "case when protocol = '' then 'none' else protocol end as protocol",
        "cast(octet_length(raw) as bigint) as size")
    out = named.rollup("l3", "l4", "protocol").agg(F.expr("case grouping_id() when 7 then 0 when 3 then 1 when 1 then 2 else 3 end").alias("depth"),
        F.count("*").alias("frames"), F.sum("size").alias("bytes"))
    return out.select("depth", "l3", "l4", "protocol", "frames", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _ends(packets: DataFrame) -> DataFrame:
    """Two rows a packet with addresses: either end, its peer, and whether it sent."""
    # The addresses' texts are made once, behind a generator of one row: several expressions read them.
    once = packets.selectExpr("file", "cast(octet_length(raw) as bigint) as size", "inline_outer(array(struct(source, destination)))")
    ends = "inline(array(struct(source as address, destination as peer, true as sent), struct(destination as address, source as peer, false as sent)))"
    return once.where("source != '' and destination != ''").selectExpr("file", "size", ends)


_SUMS = ["count_if(sent) as sent", "count_if(not sent) as received", "sum(case when sent then size else 0 end) as bytes_sent",
    "sum(case when sent then 0 else size end) as bytes_received"]


def endpoints(packets: DataFrame) -> DataFrame:
    """address, sent, received, bytes_sent, bytes_received, peers: exact.

    Pairs of ends are counted first, so each pair is moved once for a task that has it and an address that talks to
    all others is as many rows as it has peers, not as it has packets.
    """
    pairs = _ends(packets).groupBy("address", "peer").agg(*map(F.expr, _SUMS))
    sums = [F.sum(c).alias(c) for c in ("sent", "received", "bytes_sent", "bytes_received")]
    return pairs.groupBy("address").agg(*sums, F.count("*").alias("peers"))


def endpoint_sketches(packets: DataFrame, size: int = SKETCH) -> DataFrame:
    """file, address, sent, received, bytes_sent, bytes_received, peers (a mergeable sketch): what a file's packets tell.

    Kept beside the captures, sketches of any files are put together by ``merged_endpoints`` without their packets.
    """
    return _ends(packets).groupBy("file", "address").agg(*map(F.expr, _SUMS), F.hll_sketch_agg("peer", size).alias("peers"))


def merged_endpoints(sketches: DataFrame) -> DataFrame:
    """address, sent, received, bytes_sent, bytes_received, peers: sums are exact, distinct peers estimated."""
    sums = [F.sum(c).alias(c) for c in ("sent", "received", "bytes_sent", "bytes_received")]
    return sketches.groupBy("address").agg(*sums, F.hll_sketch_estimate(F.hll_union_agg("peers", F.lit(True))).alias("peers"))


def _summed(counters: int):
    """The heaviest keys of a task with lower bounds of their weights, and a row without a key: by how much a bound may be too low."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, int] = {}
        lost = 0
        for batch in batches:
            some = pa.Table.from_batches([batch]).group_by("key").aggregate([("weight", "sum")])
            for key, weight in zip(some.column("key").to_pylist(), some.column("weight_sum").to_pylist(), strict=True):
                held[key] = held.get(key, 0) + weight
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                lost += cut
                held = {k: w - cut for k, w in held.items() if w > cut}
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), lost], pa.int64())], ["key", "weight"])

    return run


def heaviest(weighted: DataFrame, k: int, counters: int = COUNTERS, report: dict | None = None) -> DataFrame:
    """key, weight: the k keys of ``weighted`` (key, weight >= 0) with the greatest sums, ties by the smaller key; exact.

    Every task keeps ``counters`` keys, however many it meets, and what it had to subtract from them in all.  A key's
    sum lies between its bounds' sum and that plus everything subtracted.  If the k-th lower bound is above what was
    subtracted, only keys whose upper bound reaches it can be among the first k; their sums are taken exactly in a
    second pass, in which other keys are not moved.  If not (no heavy keys stand out), all keys are summed.
    """
    some = weighted.select("key", "weight").where("key is not null")
    sums = some.mapInArrow(_summed(counters), "key string, weight bigint").groupBy("key").agg(F.sum("weight").alias("low"))
    lost = sums.where("key is null").first()
    lost = lost.low if lost else 0
    bounds = sums.where("key is not null")
    least = bounds.orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("least"), F.count("*").alias("n")).first()
    left = some
    # Where nothing was subtracted every key was kept, so fewer than k are all there are.
    if least.n and (lost == 0 or least.n == k and least.least > lost):
        survivors = bounds.where(F.col("low") + lost >= (least.least if least.n == k else 0)).select("key")
        n = survivors.limit(MOST_TALKERS + 1).count()
        if report is not None:
            report.update(survivors=n, lost=lost)
        if n <= MOST_TALKERS:
            left = some.join(F.broadcast(survivors), "key", "left_semi")
    return left.groupBy("key").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "key").limit(k)


def top_talkers(packets: DataFrame, k: int = 10, counters: int = COUNTERS, report: dict | None = None) -> DataFrame:
    """address, bytes: the k addresses that sent most bytes (a top-k report)."""
    sent = packets.where("source != ''").selectExpr("source as key", "cast(coalesce(octet_length(raw), 0) as bigint) as weight")
    return heaviest(sent, k, counters, report).withColumnsRenamed({"key": "address", "weight": "bytes"})
