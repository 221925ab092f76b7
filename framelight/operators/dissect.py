"""Frames to packets: Ethernet, IPv4, IPv6, ARP and RARP, ICMP, TCP, UDP and the application protocols.

Everything is SQL expressions in narrow stages, so pruning drops the headers that a query does not read.
The one exception is the DNS record loop: the readers decode it as they parse (column ``dns``); for frames
from elsewhere ``with_dns`` sends the DNS frames alone to Python.  A header that does not wholly fit into its
frame is not decoded; the frame is then ``truncated``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight import schema as S
from framelight.functions.bytes import U32, be, cut, hex_number, ipv4, ipv6, mac, minus_u32, plus, six_groups
from framelight.functions.names import dns_text


def _columns(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{v} as {k}" for k, v in exprs.items()])


#: Whether a frame carries TCP, on the bytes alone: a filter on ``l4`` would repeat its whole derivation.
IS_TCP = (
    "coalesce((substring(raw, 13, 2) = X'0800' and length(raw) >= 34 and substring(raw, 24, 1) = X'06') or (substring(raw, 13, 2) = X'86DD' and "
    "length(raw) >= 54 and substring(raw, 21, 1) = X'06'), false)"
)


def _ports_of(at: int | str, port: str) -> str:
    return f"(substring(raw, {plus(at, 1)}, 2) = {port} or substring(raw, {plus(at, 3)}, 2) = {port})"


#: Whether a frame has a DNS port over UDP, on the bytes alone.
_BEHIND_IP4 = f"cast(14 + 4 * ({be(14, 1)} & 15) as int)"
IS_DNS = (
    f"coalesce(case when substring(raw, 13, 2) = X'0800' and length(raw) >= 42 and substring(raw, 24, 1) = X'11' then "
    f"""{_ports_of(_BEHIND_IP4, "X'0035'")} when substring(raw, 13, 2) = X'86DD' and length(raw) >= 62 and substring(raw, 21, 1) = X'11' """
    f"""then {_ports_of(54, "X'0035'")} end, false)"""
)


def with_dns(frames: DataFrame) -> DataFrame:
    """Adds ``dns`` where a reader has not: only DNS frames go through Python, in a branch of their own."""
    if "dns" in frames.columns:
        return frames
    plain = frames.where(f"not {IS_DNS}").withColumn("dns", F.lit(None).cast("string"))
    return plain.unionByName(frames.where(IS_DNS).withColumn("dns", dns_text(F.col("raw"))))


def offsets(frames: DataFrame) -> DataFrame:
    """Adds the layer tags, offsets and the numbers that later stages branch on."""
    kind = f"case when length(raw) >= 14 then {be(12, 2)} end"
    out = _columns(frames, {"size": "length(raw)", "ethertype": kind})
    tags = {S.IPV4: ("ip4", 34), S.IPV6: ("ip6", 54), S.ARP: ("arp", 42), S.RARP: ("rarp", 42)}
    tag = "case " + " ".join(f"when ethertype = {k} then '{name}'" for k, (name, _) in tags.items()) + " end"
    fits = "case " + " ".join(f"when ethertype = {k} then size >= {n}" for k, (_, n) in tags.items()) + " else size >= 14 end"
    out = _columns(out, {"l3": f"case when {fits} then {tag} end", "l3_fits": fits})
    out = _columns(out, {
        "ihl": f"case when l3 = 'ip4' then {be(14, 1)} & 15 end",
        "proto": f"case when l3 = 'ip4' then {be(23, 1)} when l3 = 'ip6' then {be(20, 1)} end",
        "total": f"case when l3 = 'ip4' then {be(16, 2)} when l3 = 'ip6' then {be(18, 2)} end",
    })
    needs = f"case when proto in ({S.ICMP}, {S.ICMPV6}) then 8 when proto = {S.TCP} then 20 when proto = {S.UDP} then 8 else 0 end"
    out = _columns(out, {
        "l4_off": "cast(case when l3 = 'ip4' then 14 + 4 * ihl when l3 = 'ip6' then 54 end as int)",
        "ip_len": f"case when l3 = 'ip4' then {minus_u32('total', '4 * ihl')} else total end", "l4_size": needs,
    })
    l4 = (
        f"case when proto = {S.ICMP} then 'icmp' when proto = {S.ICMPV6} then 'icmp6' when proto = {S.TCP} then 'tcp' when proto = {S.UDP} then "
        f"'udp' when proto is not null then 'other' end"
    )
    # An ICMP text is made only where the declared length covers its header; the bytes must be there too.
    out = _columns(out, {"l4": l4, "l4_fits": "coalesce(size >= l4_off + l4_size, true)"})
    at = "l4_off"
    ported = "l4 in ('tcp', 'udp') and l4_fits"
    out = _columns(out, {"sport": f"case when {ported} then {be(at, 2)} end", "dport": f"case when {ported} then {be(plus(at, 2), 2)} end"})
    either = lambda *ports: f"(sport in {_in(ports)} or dport in {_in(ports)})"
    app = (
        "case when sport is null then null when l4 = 'tcp' then "
        f"case when {either(S.TELNET)} then 'Telnet' when {either(S.SMTP)} then 'SMTP' when {either(S.BGP)} then 'BGP' else 'TCP' end else "
        f"case when {either(*S.DNS)} then 'DNS' when {either(*S.DHCP)} then 'DHCP' when {either(*S.SNMP)} then 'SNMP' else 'UDP' end end"
    )
    out = _columns(out, {"app": app})
    # Each of these is made of the ones before.  The generator (of one row) makes them once: a condition on
    # what is derived from them stops here, instead of being rewritten in terms of the bytes over and over.
    once = ("size", "l3", "l3_fits", "l4_off", "ip_len", "l4", "l4_fits", "sport", "dport", "app")
    out = out.select(*frames.columns, F.inline_outer(F.array(F.struct(*once))))
    tcp, udp = "l4 = 'tcp' and l4_fits", "l4 = 'udp' and l4_fits"
    out = _columns(out, {
        "seq": f"case when {tcp} then {be(plus(at, 4), 4)} end", "ack": f"case when {tcp} then {be(plus(at, 8), 4)} end",
        "doff": f"case when {tcp} then shiftright({be(plus(at, 12), 1)}, 4) end", "flags": f"case when {tcp} then {be(plus(at, 13), 1)} end",
        "win": f"case when {tcp} then {be(plus(at, 14), 2)} end", "udp_len": f"case when {udp} then {be(plus(at, 4), 2)} end",
    })
    return _columns(out, {
        "pay_off": "cast(case when l4 = 'tcp' then l4_off + 4 * doff when l4 = 'udp' and l4_fits then l4_off + 8 end as int)",
        "tcp_len": minus_u32("ip_len", "4 * doff"),
    })


def _in(ports: tuple) -> str:
    return "(" + ", ".join(map(str, ports)) + ")"


def flags_text(flags: str) -> str:
    """Names of the set flags, with a comma and a space between."""
    return "concat_ws(', ', " + ", ".join(f"case when {flags} & {m} != 0 then '{name}' end" for name, m in S.TCP_FLAGS.items()) + ")"


def icmp_text(at: str) -> str:
    kind, code = be(at, 1), be(plus(at, 1), 1)
    tail = f"concat(', Identifier=', {be(plus(at, 4), 2)}, ', Sequence=', {be(plus(at, 6), 2)})"
    return (
        f"case {kind} when 8 then concat('ICMP Echo Request', {tail}) when 0 then concat('ICMP Echo Reply', {tail}) "
        f"when 3 then concat('ICMP Destination Unreachable, Code=', {code}) "
        f"when 11 then concat('ICMP Time Exceeded, Code=', {code}) else concat('ICMP Type=', {kind}, ', Code=', {code}) end"
    )


def arp_text() -> str:
    return (
        f"case {be(20, 2)} when 1 then concat('ARP Request: Who has ', {ipv4(38)}, '? Tell ', {ipv4(28)}) "
        f"when 2 then concat('ARP Reply: ', {ipv4(28)}, ' is at ', {mac(22)}) "
        f"when 3 then concat('ARP Announce: My IP is associated with MAC ', {mac(22)}) else 'ARP Unknown operation' end"
    )


def ipv6_word() -> tuple[str, str, str]:
    """(version, traffic class, flow label) as a little-endian host reads the first header word's bit-fields."""
    b = [be(14 + k, 1) for k in range(4)]
    return f"({b[0]} & 15)", f"(shiftright({b[0]}, 4) | shiftleft({b[1]} & 15, 4))", f"(shiftright({b[1]}, 4) | shiftleft({b[2]}, 4) | shiftleft({b[3]}, 12))"


def ipv6_info() -> str:
    version, traffic, flow = ipv6_word()
    return f"concat('IPv6 Version: ', {version}, ', Traffic Class: ', {traffic}, ', Flow Label: ', {flow}, ', Hop Limit: ', {be(21, 1)})"


def dhcp_text(at: str) -> str:
    parts = ["'DHCP '", f"case {be(at, 1)} when 1 then 'Request' when 2 then 'Reply' else '' end", "', XID: 0x'", hex_number(be(plus(at, 4), 4))]
    for label, k in (("Client IP", 12), ("Your IP", 16), ("Server IP", 20), ("Gateway IP", 24)):
        parts += [f"', {label}: '", ipv4(plus(at, k))]
    return f"concat({', '.join(parts)}, ', Client MAC: ', {mac(plus(at, 28))})"


#: len - 8 as an unsigned 64-bit number.
_LESS_8 = "cast(case when udp_len < 8 then 18446744073709551616BD + udp_len - 8 else udp_len - 8 end as string)"
#: Up to 50 bytes of payload, byte by byte as Latin-1.
_PAYLOAD = "decode(substring(raw, pay_off + 1, cast(least(tcp_len, 50) as int)), 'ISO-8859-1')"
_DNS_OK = "(udp_len < 8 or udp_len >= 20)"


def with_packets(located: DataFrame) -> DataFrame:
    """The display columns of ``offsets``, with ``dns``.  TCP info comes in two parts, ``info`` and ``info_tail``: tracked numbers go between them."""
    out = _columns(located, {side: f"case when l3 = 'ip6' then {six_groups(at)} end" for side, at in (("six_src", 22), ("six_dst", 38))})
    preset = f"case when l3 = 'ip6' then {ipv6_info()} else '' end"
    ports = "concat(sport, ' -> ', dport)"
    tcp_head = f"concat({ports}, ' [', {flags_text('flags')}, '] ')"
    window = "case when win > 0 then concat(' Win=', win) else '' end"
    kind = be("pay_off + 18", 1)
    bgp = f"case {kind} when 1 then 'OPEN' when 2 then 'UPDATE' when 3 then 'NOTIFICATION' when 4 then 'KEEPALIVE' else 'Unknown' end"
    dns = (
        f"concat(case when {be('pay_off + 2', 2)} & 32768 != 0 then 'Standard query response 0x' else 'Standard query 0x' end, "
        f"{hex_number(be('pay_off', 2))}, dns)"
    )
    udp = (
        f"case app when 'DNS' then case when {_DNS_OK} then {dns} else {preset} end when 'DHCP' then case when size >= pay_off + 44 then "
        f"{dhcp_text('pay_off')} end when 'SNMP' then concat('SNMP message (length: ', {_LESS_8}, ')') else concat({ports}, ' Len=', {_LESS_8}) end"
    )
    columns = {
        "source": f"case l3 when 'ip4' then {ipv4(26)} when 'ip6' then {ipv6('six_src')} when 'arp' then {mac(22)} when 'rarp' then {mac(22)} else '' end",
        "destination": f"case l3 when 'ip4' then {ipv4(30)} when 'ip6' then {ipv6('six_dst')} "
        f"when 'arp' then case when {mac(32)} = '00:00:00:00:00:00' then 'Broadcast' else {mac(32)} end "
        f"when 'rarp' then case when {mac(32)} = {mac(22)} then 'Broadcast' else {mac(32)} end else '' end",
        "protocol": "case when l4 = 'icmp' then 'ICMP' when l4 = 'icmp6' then 'ICMPv6' when l4 = 'tcp' then coalesce(app, 'TCP') "
        "when l4 = 'udp' then coalesce(app, 'UDP') when l4 = 'other' then 'Other' when l3 = 'arp' then 'ARP' when l3 = 'rarp' then 'RARP' else '' end",
        "length": "cast(case when l4 = 'tcp' then tcp_len when l4 = 'udp' then udp_len when l3 in ('ip4', 'ip6') then ip_len "
        "when l3 in ('arp', 'rarp') then 28 end as bigint)",
        "info": f"case when l4 in ('icmp', 'icmp6') then case when ip_len < 8 then {preset} when l4_fits then {icmp_text('l4_off')} end "
        f"when l4 = 'tcp' then case when app = 'SMTP' then concat('SMTP data: ', {_PAYLOAD}, '...') else {tcp_head} end "
        f"when l4 = 'udp' then {udp} when l3 in ('arp', 'rarp') then {arp_text()} else {preset} end",
        "info_tail": f"case when l4 = 'tcp' then concat({window}, case app when 'Telnet' then concat('[ Telnet data: ', {_PAYLOAD}, '... ]') "
        f"when 'BGP' then concat(' [ BGP: ', {bgp}, ' ]') else '' end) end",
    }
    known = {k: f"case when raw is not null then {v} {'' if k in ('length', 'info_tail') else chr(101) + 'lse ' + repr('')} end" for k, v in columns.items()}
    known["shown_status"] = "case when status = 'ok' and not (coalesce(l3_fits, true) and l4_fits) then 'truncated' else status end"
    out = _columns(out, known | headers() | {"payload": "substring(raw, 1, cast(coalesce(cap_len, size) as int))"})
    return out.drop("status").withColumnRenamed("shown_status", "status")


def _struct(present: str, at: int | str, fields: list[tuple[str, int, int | str]]) -> str:
    """A struct of (name, offset, size or kind) fields, NULL unless ``present``; byte order as on the wire."""
    parts = []
    for name, off, kind in fields:
        place = plus(at, off)
        value = {"mac": mac, "ip": ipv4}[kind](place) if kind in ("mac", "ip") else cut(place, int(kind[1:])) if isinstance(kind,
            str) else f"cast({be(place, kind)} as int)" if kind < 4 else be(place, kind)
        parts.append(f"'{name}', {value}")
    return f"case when {present} then named_struct({', '.join(parts)}) end"


def headers() -> dict[str, str]:
    """One nullable struct for each header that a frame may have."""
    return {
        "eth": _struct("size >= 14", 0, [("dst", 0, "mac"), ("src", 6, "mac"), ("type", 12, 2)]),
        "ip4": _struct("l3 = 'ip4'", 14, [("version_ihl", 0, 1), ("tos", 1, 1), ("total_length", 2, 2), ("id", 4, 2), ("flags", 6, 1),
            ("fragment", 7, 1), ("ttl", 8, 1), ("protocol", 9, 1), ("checksum", 10, 2), ("src", 12, "ip"), ("dst", 16, "ip")]),
        "ip6": _struct("l3 = 'ip6'", 14, [("word", 0, 4), ("payload_length", 4, 2), ("next_header", 6, 1), ("hop_limit", 7, 1), ("src", 8, "b16"),
            ("dst", 24, "b16")]),
        "arp": _struct("l3 in ('arp', 'rarp')", 14, [("hardware", 0, 2), ("protocol", 2, 2), ("hardware_size", 4, 1), ("protocol_size", 5, 1),
            ("operation", 6, 2), ("sender_mac", 8, "mac"), ("sender_ip", 14, "ip"), ("target_mac", 18, "mac"), ("target_ip", 24, "ip")]),
        "icmp": _struct("l4 in ('icmp', 'icmp6') and l4_fits", "l4_off", [("type", 0, 1), ("code", 1, 1), ("checksum", 2, 2), ("identifier", 4, 2), ("sequence", 6, 2)]),
        "tcp": _struct("l4 = 'tcp' and l4_fits", "l4_off", [("src_port", 0, 2), ("dst_port", 2, 2), ("seq", 4, 4), ("ack", 8, 4), ("offset", 12, 1),
            ("flags", 13, 1), ("window", 14, 2), ("checksum", 16, 2), ("urgent", 18, 2)]),
        "udp": _struct("l4 = 'udp' and l4_fits", "l4_off", [("src_port", 0, 2), ("dst_port", 2, 2), ("length", 4, 2), ("checksum", 6, 2)]),
        "dhcp": _struct("app = 'DHCP' and size >= pay_off + 236", "pay_off", [("op", 0, 1), ("htype", 1, 1), ("hlen", 2, 1), ("hops", 3, 1), ("xid", 4, 4), ("secs", 8, 2),
                ("flags", 10, 2), ("ciaddr", 12, "ip"), ("yiaddr", 16, "ip"), ("siaddr", 20, "ip"), ("giaddr", 24, "ip"), ("chaddr", 28, "b16"),
                    ("sname", 44, "b64"), ("file", 108, "b128")]),
    }


__all__ = ["IS_DNS", "IS_TCP", "U32", "headers", "ipv6_info", "offsets", "with_dns", "with_packets"]
