"""Relative sequence and acknowledgement numbers of TCP connections.

A connection is an unordered pair of endpoints within a file; its client sends the first packet.  In ``track`` all
windows share one partitioning and order, hence one exchange and one sort; a connection's segments meet in one task,
where sorting them spills.  ``track_in_parts`` is for captures of which one connection is most: it cuts connections
into parts by frame number, each a group of its own, and carries their states over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight.functions.bytes import minus_u32

_ORDER = "order by number rows between unbounded preceding and current row"
_OVER = f"over (partition by file, conn_lo, conn_hi {_ORDER})"


def _connections(segments: DataFrame, once: bool = False) -> DataFrame:
    """``once``: the ends' texts are made behind a generator of one row, where many expressions read them before an exchange."""
    ends = {"src_ep": "concat(source, '|', sport)", "dst_ep": "concat(destination, '|', dport)", "syn": "flags & 2 != 0", "acked": "flags & 16 != 0"}
    if once:
        packed = ", ".join(f"'{k}', {v}" for k, v in ends.items())
        out = segments.selectExpr("*", f"inline_outer(array(named_struct({packed})))")
    else:
        out = segments.selectExpr("*", *[f"{v} as {k}" for k, v in ends.items()])
    alone = "when flags is null then concat('#', number)"
    return out.selectExpr("*", f"case {alone} else least(src_ep, dst_ep) end as conn_lo", f"case {alone} else greatest(src_ep, dst_ep) end as conn_hi")


#: Whether a segment sets the server's first number for sure, and whether it does if none is known; ``fwd``: it comes from the client.
_ANSWERS = "syn and acked and (not fwd or src_ep = dst_ep)"
_CAND = "answers or (not fwd and not syn)"


def _numbers(out: DataFrame) -> DataFrame:
    """rel_seq and rel_ack, where the client's and the server's first numbers are known."""
    mine, other = "case when fwd then client else server end", "case when fwd then server else client end"

    def rel(hidden: int, fixed: int, value: str, base: str) -> str:
        opening, answer = f"case when fwd then {hidden} end", f"case when answers then {fixed} end"
        known = f"when flags is null then null when syn and not acked then {opening} when syn then {answer}"
        return f"cast(case {known} else {minus_u32(value, base)} end as bigint)"

    return out.selectExpr("*", f"{rel(0, 0, 'seq', mine)} as rel_seq", f"{rel(-1, 1, 'ack', other)} as rel_ack")


def track(segments: DataFrame) -> DataFrame:
    """Adds rel_seq and rel_ack to ``segments`` (file, number, source, destination, sport, dport, seq, ack, flags, ...).

    NULL stands where a value is undefined, -1 where it is hidden.  Rows without decoded TCP flags (frames of
    other kinds, cut segments) have NULLs and take no part in any connection: each is a group of its own, so
    they spread over all partitions.
    """
    out = _connections(segments).selectExpr("*", f"src_ep = first(src_ep) {_OVER} as fwd", f"row_number() {_OVER} as rn")
    out = out.selectExpr("*", "rn = 1 or (fwd and syn and not acked) as opens", f"{_ANSWERS} as answers")
    out = out.selectExpr("*", f"{_CAND} as cand")
    out = out.selectExpr("*", f"last(case when opens then seq end, true) {_OVER} as client", f"sum(cast(cand as int)) {_OVER} as cn")
    out = out.selectExpr("*", f"coalesce(last(case when answers or (cand and cn = 1) then seq end, true) {_OVER}, 0) as server")
    return _numbers(out).select(*segments.columns, "rel_seq", "rel_ack")


def states_of_parts(connected: DataFrame) -> DataFrame:
    """One row for each part of a connection: who is the client, where it begins, and what the parts before leave behind.

    A part is summed up for either end as the client, since only the first part knows which one is: the last number
    with which the client opens, the last with which the server answers, the first that would stand for the server's.
    Sums are combined before they are moved; what is windowed is a row for each part, not for each segment.
    """
    some = connected.where("flags is not null")
    sums = ["min_by(src_ep = conn_lo, number) as lo_first", "min_by(seq, number) as first_seq", "min(number) as first_number"]
    for side in ("lo", "hi"):
        fwd = f"src_ep = conn_{side}"
        answers = f"({_ANSWERS.replace('fwd', f'({fwd})')})"
        cand = f"({_CAND.replace('answers', answers).replace('fwd', f'({fwd})')})"
        sums += [f"max_by(seq, number) filter (where {fwd} and syn and not acked) as opened_{side}",
            f"max_by(seq, number) filter (where {answers}) as answered_{side}", f"min_by(seq, number) filter (where {cand}) as stood_{side}"]
    parts = some.groupBy("file", "conn_lo", "conn_hi", "part").agg(*map(F.expr, sums))
    over = "over (partition by file, conn_lo, conn_hi order by part)"
    before = "over (partition by file, conn_lo, conn_hi order by part rows between unbounded preceding and 1 preceding)"
    out = parts.selectExpr("*", f"first(lo_first) {over} as lo_client", f"first(first_seq) {over} as opening", f"first(first_number) {over} as opened_at")
    of = lambda kind: f"case when lo_client then {kind}_lo else {kind}_hi end"
    out = out.selectExpr("*", *[f"{of(kind)} as {kind}" for kind in ("opened", "answered", "stood")])
    return out.selectExpr(
        "file", "conn_lo", "conn_hi", "part", "case when lo_client then conn_lo else conn_hi end as client_ep", "opened_at",
        f"coalesce(last(opened, true) {before}, opening) as client_before", f"first(stood, true) {before} as stood_before",
        f"coalesce(last(answered, true) {before}, first(stood, true) {before}) as server_before",
    )


def track_in_parts(segments: DataFrame, size: int) -> DataFrame:
    """As ``track``, but a connection's segments of every ``size`` frame numbers are a group of their own.

    Segments are read twice, the first time for a few columns.  No group is larger than ``size`` frames, however
    many frames a connection has.
    """
    connected = _connections(segments, once=True).selectExpr("*", f"cast((number - 1) div {int(size)} as int) as part")
    keys = ["file", "conn_lo", "conn_hi", "part"]
    over = f"over (partition by {', '.join(keys)} {_ORDER})"
    out = connected.join(states_of_parts(connected), keys, "left").selectExpr("*", "src_ep = client_ep as fwd")
    out = out.selectExpr("*", "number = opened_at or (fwd and syn and not acked) as opens", f"{_ANSWERS} as answers").selectExpr("*", f"{_CAND} as cand")
    out = out.selectExpr("*", f"coalesce(last(case when opens then seq end, true) {over}, client_before) as client", f"sum(cast(cand as int)) {over} as cn")
    first = "cand and cn = 1 and stood_before is null"
    out = out.selectExpr("*", f"coalesce(last(case when answers or ({first}) then seq end, true) {over}, server_before, 0) as server")
    return _numbers(out).select(*segments.columns, "rel_seq", "rel_ack")
