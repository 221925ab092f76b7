"""Internet checksums as expressions: one's-complement sums of 16-bit words, folded."""

from __future__ import annotations

from pyspark.sql import DataFrame

from framelight.functions.bytes import be, plus


def words_sum(start: str, end: str) -> str:
    """The sum of the big-endian 16-bit words of ``raw`` from ``start`` to before ``end``; a last odd byte counts as a word's high byte."""
    pair = be("k", 2)
    whole = f"aggregate(sequence({start}, {end} - 2, 2), 0L, (sum, k) -> sum + {pair})"
    whole = f"case when {end} - {start} >= 2 then {whole} else 0L end"
    odd = f"case when ({end} - {start}) % 2 = 1 then {be(plus(end, -1), 1)} * 256 else 0L end"
    return f"({whole} + {odd})"


def folded(total: str) -> str:
    """Carries added back until 16 bits are left: the sum of words that hold their own checksum is 65535."""
    return f"case when {total} = 0 then 0 else 1 + ({total} - 1) % 65535 end"


def with_checksums(packets: DataFrame) -> DataFrame:
    """Adds ``ip_sum_ok`` and ``l4_sum_ok`` to the packet table: whether the checksums are right.

    NULL where there is none to check: no IPv4 header (or one that is cut) for the first; for the second no TCP, UDP or ICMP,
    a UDP packet over IPv4 without a checksum (0), a fragment, or a packet that the frame does not hold whole.
    """
    ip_end = "(14 + 4 * (ip4.version_ihl & 15))"
    base = packets.selectExpr(
        "*", f"case when l3 = 'ip4' then {ip_end} when l3 = 'ip6' then 54 end as _start",
        "case when l3 = 'ip4' then 14 + ip4.total_length when l3 = 'ip6' then 54 + ip6.payload_length end as _end",
        "coalesce(udp.checksum = 0 and l3 = 'ip4', false) or coalesce((ip4.flags & 63) * 256 + ip4.fragment > 0, false) as _none",
    )
    ip = f"case when l3 = 'ip4' and (ip4.version_ihl & 15) >= 5 and octet_length(raw) >= {ip_end} then {folded(words_sum('14', ip_end))} = 65535 end"
    # The pseudo header: both addresses, the length and the protocol.
    pseudo = (
        f"case when l4 in ('icmp') then 0 when l3 = 'ip4' then {words_sum('26', '34')} + ip4.protocol + _end - _start "
        f"else {words_sum('22', '54')} + ip6.next_header + (_end - _start) end"
    )
    known = "coalesce(icmp.type, tcp.src_port, udp.src_port) is not null and not _none and _end > _start and octet_length(raw) >= _end"
    out = base.selectExpr("*", f"{ip} as ip_sum_ok", f"case when {known} then {words_sum('_start', '_end')} + {pseudo} end as _sum")
    return out.selectExpr(*packets.columns, "ip_sum_ok", f"case when _sum is not null then {folded('_sum')} = 65535 end as l4_sum_ok")
