"""IPv4 fragments put together to whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight.functions.bytes import be, cut

#: Seconds after which a fragment of the same addresses, protocol and identification is of another datagram.
GAP = 30
#: Whether a frame is a fragment, on the bytes alone: it has an offset, or more follow.
IS_FRAGMENT = f"coalesce(substring(raw, 13, 2) = X'0800' and length(raw) >= 34 and ({be(20, 2)} & 16383) > 0, false)"

_SIZE = f"4 * ({be(14, 1)} & 15)"
#: One fragment after another: what it adds behind the bytes so far, or a hole.
_STEP = (
    "named_struct('upto', greatest(a.upto, f.at + length(f.data)), 'data', case when a.whole and f.at <= a.upto and f.at + length(f.data) > a.upto "
    "then concat(a.data, substring(f.data, cast(a.upto - f.at + 1 as int), length(f.data))) else a.data end, 'whole', a.whole and f.at <= a.upto)"
)


def _one_if(condition: str, fields: dict[str, str]) -> str:
    """The ``fields`` of a row for which ``condition`` holds, and no row for another.

    A filter on the bytes would move to where they come from and make them anew for each time that it names them.
    """
    return "inline(case when {} then array(named_struct({})) end)".format(condition, ", ".join(f"'{k}', {v}" for k, v in fields.items()))


def reassembled(frames: DataFrame, gap: int = GAP) -> DataFrame:
    """One frame for each IPv4 datagram whose fragments are all there, in any order; the columns of ``frames``.

    It has the number and time of the fragment that came last, the header of the first (offset 0), the whole length, and no
    fragment flags.  Where fragments overlap, bytes of the lower offset stay, then those of the earlier frame.  Fragments
    belong together by file, addresses, protocol and identification, as long as no more than ``gap`` seconds lie between
    two; datagrams with holes, without an end or of more than 65,535 bytes give no frame.  A datagram's fragments meet in
    one task; what is collected is one datagram's bytes.
    """
    rest = ", ".join(c for c in frames.columns if c != "raw")
    # A fragment that its frame does not hold whole, or whose header is too long, leaves a hole.
    fields = {"at": f"({be(20, 2)} & 8191) * 8", "more": f"({be(20, 2)} & 8192) != 0", "datagram": f"concat({cut(26, 8)}, {cut(23, 1)}, {cut(18, 2)})",
        "head": f"substring(raw, 1, cast(14 + {_SIZE} as int))", "data": f"substring(raw, 15 + cast({_SIZE} as int), cast({be(16, 2)} - {_SIZE} as int))"}
    held = f"{IS_FRAGMENT} and {_SIZE} >= 20 and {be(16, 2)} > {_SIZE} and length(raw) >= 14 + {be(16, 2)}"
    some = frames.selectExpr("file", "number", f"struct({rest}) as frame", "ts_hi + ts_lo / 1000000 as seconds", _one_if(held, fields))
    over = "over (partition by file, datagram order by number)"
    some = some.selectExpr("*", f"coalesce(seconds - lag(seconds) {over} > {int(gap)}, false) as anew")
    some = some.selectExpr("*", f"sum(cast(anew as int)) {over} as session")
    parts = "array_sort(collect_list(struct(at, number, data))) as parts"
    sums = [parts, "max_by(frame, number) as last", "min_by(head, struct(at, number)) as head",
        "min(at) as first", "max(case when not more then at + length(data) end) as end"]
    whole = some.groupBy("file", "datagram", "session").agg(*map(F.expr, sums))
    start = "named_struct('upto', cast(0 as bigint), 'data', X'', 'whole', true)"
    whole = whole.selectExpr("last", "head", "first", "end", f"inline(array(aggregate(parts, {start}, (a, f) -> {_STEP})))")
    whole = whole.where("first = 0 and whole and upto = end and length(head) - 14 + end <= 65535")
    total = "unhex(lpad(hex(length(head) - 14 + end), 4, '0'))"
    raw = f"concat(substring(head, 1, 16), {total}, substring(head, 19, 2), X'0000', substring(head, 23, length(head)), data)"
    made = {"raw": f"{raw} as raw", "cap_len": "length(head) + end as cap_len", "orig_len": "length(head) + end as orig_len"}
    return whole.selectExpr(*[made.get(c, f"last.{c}") for c in frames.columns])


def with_whole_datagrams(frames: DataFrame, gap: int = GAP) -> DataFrame:
    """``frames`` with datagrams in place of their fragments; fragments of datagrams that stay incomplete go."""
    others = frames.selectExpr("*", _one_if(f"not {IS_FRAGMENT}", {"_other": "true"})).drop("_other")
    return others.unionByName(reassembled(frames, gap))
