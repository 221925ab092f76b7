"""Packet details: labelled fields with byte ranges, and the lookups between bytes and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight.functions.bytes import be, ipv4, le, mac, plus
from framelight.operators.dissect import ipv6_word

#: Label, first and last byte within the layer, how the value is shown.
ETHERNET = [("Destination MAC", 0, 5, "mac"), ("Source MAC", 6, 11, "mac"), ("Type", 12, 13, "le")]
IPV4 = [
    ("Version", 0, 0, "high"), ("IHL", 0, 0, "low"), ("Type of Service", 1, 1, "le"), ("Total Length", 2, 3, "le"), ("Identification", 4, 5, "le"),
        ("Flags", 6, 6, "le"),
    ("Fragment Offset", 7, 7, "le"), ("TTL", 8, 8, "le"), ("Protocol", 9, 9, "le"), ("Header Checksum", 10, 11, "le"), ("Source IP", 12, 15, "ip"),
        ("Destination IP", 16, 19, "ip"),
]
IPV6 = [
    ("Version", 0, 3, "version"), ("Traffic Class", 0, 3, "traffic"), ("Flow Label", 0, 3, "flow"), ("Payload Length", 4, 5, "le"),
    ("Next Header", 6, 6, "le"), ("Hop Limit", 7, 7, "le"), ("Source IP", 8, 23, "source"), ("Destination IP", 24, 39, "destination"),
]
ARP = [("ARP Packet", 0, 27, None)]
TCP = [
    ("Source Port", 0, 1, "le"), ("Destination Port", 2, 3, "le"), ("Sequence Number", 4, 7, "le"), ("Acknowledgement Number", 8, 11, "le"),
        ("Data Offset", 12, 12, "le"),
    ("Flags", 13, 13, "le"), ("Window Size", 14, 15, "le"), ("Checksum", 16, 17, "le"), ("Urgent Pointer", 18, 19, "le"),
]
UDP = [("Source Port", 0, 1, "le"), ("Destination Port", 2, 3, "le"), ("Length", 4, 5, "le"), ("Checksum", 6, 7, "le")]
ICMP = [("ICMP Header", 0, 7, None)]


def _value(at: int | str, size: int, kind: str | None) -> str:
    """SQL of a field's value.  Numbers keep the host's byte order, as the detail view prints them unconverted."""
    if kind is None:
        return "cast(null as string)"
    if kind in ("source", "destination"):  # of IPv6: the packet table has their text
        return kind
    if kind in ("mac", "ip"):
        return {"mac": mac, "ip": ipv4}[kind](at)
    version, traffic, flow = ipv6_word()
    number = {"le": lambda: le(at, size), "high": lambda: f"shiftright({be(at, 1)}, 4)", "low": lambda: f"({be(at, 1)} & 15)",
        "version": lambda: version, "traffic": lambda: traffic, "flow": lambda: flow}[kind]()
    return f"cast({number} as string)"


def _layer(name: str, base: int | str, fields: list) -> str:
    def row(k: int, label: str, lo: int, hi: int, kind: str | None) -> str:
        ends = f"'lo', cast({plus(base, lo)} as int), 'hi', cast({plus(base, hi)} as int)"
        return f"named_struct('layer', '{name}', 'ord', {k}, 'label', '{label}', {ends}, 'value', {_value(plus(base, lo), hi - lo + 1, kind)})"

    return f"array({', '.join(row(k, *field) for k, field in enumerate(fields))})"


#: Bytes of the last layer's fields.
_LAST = "case l4 when 'tcp' then 20 else 8 end"
_BASE = "case l3 when 'ip4' then 34 when 'ip6' then 54 else 42 end"


def field_arrays(packets: DataFrame) -> DataFrame:
    """file, number, fields: all fields of each frame as one array of structs, absolute byte offsets.

    The third layer starts at byte 14; the fourth directly after the third layer's fixed header, so IPv4
    options are not counted.  A frame without a decoded third layer shows the ARP field, one without a
    fourth the ICMP field, these being what an empty header shows.
    """
    third = f"case l3 when 'ip4' then {_layer('L3', 14, IPV4)} when 'ip6' then {_layer('L3', 14, IPV6)} else {_layer('L3', 14, ARP)} end"
    fourth = f"case l4 when 'tcp' then {_layer('L4', 'l4_base', TCP)} when 'udp' then {_layer('L4', 'l4_base', UDP)} else {_layer('L4', 'l4_base', ICMP)} end"
    rows = packets.where("raw is not null").selectExpr("file", "number", "raw", "l3", "l4", "source", "destination", f"{_BASE} as l4_base")
    return rows.selectExpr("file", "number", f"concat({_layer('L2', 0, ETHERNET)}, {third}, {fourth}) as fields")


def packet_fields(packets: DataFrame) -> DataFrame:
    """file, number, layer, ord, label, lo, hi, value: one row for each of ``field_arrays``.

    No frame is without fields, so the outer form gives the same rows; the planner then does not derive, and
    evaluate twice, a condition on the arrays' size.
    """
    return field_arrays(packets).selectExpr("file", "number", "inline_outer(fields)")


def byte_to_fields(packets: DataFrame, bytes_: DataFrame) -> DataFrame:
    """``bytes_``: file, number, byte.  All fields that hold the byte; overlapping fields all match.  One row a frame is joined."""
    found = bytes_.join(field_arrays(packets), ["file", "number"])
    held = "inline(filter(fields, f -> byte between f.lo and f.hi))"
    return found.selectExpr("file", "number", "byte", held).select("file", "number", "byte", "layer", "ord", "label")


def field_to_bytes(packets: DataFrame, label: str) -> DataFrame:
    """The byte range of a field wherever it occurs."""
    chosen = F.filter("fields", lambda f: f["label"] == label)
    return field_arrays(packets).select("file", "number", F.inline(chosen)).select("file", "number", "layer", "lo", "hi")


def same_start(packets: DataFrame, label: str) -> DataFrame:
    """Fields marked together with ``label``: those of the same frame that start at the same byte.  Nothing is joined."""
    chosen = F.explode(F.filter("fields", lambda f: f["label"] == label))
    rows = field_arrays(packets).select("file", "number", "fields", chosen.alias("of"))
    beside = "inline(filter(fields, f -> f.lo = of.lo))"
    return rows.selectExpr("file", "number", "of.layer as of_layer", beside).select("file", "number", "of_layer", "layer", "label", "lo", "hi")


def payload_range(packets: DataFrame) -> DataFrame:
    """file, number, lo, hi of the bytes after the last field; none where no byte is left."""
    rows = packets.where("raw is not null").selectExpr("file", "number", f"cast({_BASE} + {_LAST} as int) as lo", "length(raw) - 1 as hi")
    return rows.where("hi >= lo")
