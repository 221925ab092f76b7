"""The decoder that column expressions cannot state: the DNS record loop."""

from __future__ import annotations

import socket

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A domain name and the offset after it; compression pointers are followed, each offset once."""
    labels, after, seen = [], None, set()
    while at < len(data):
        size = data[at]
        if size == 0:
            at += 1
            break
        if size >= 0xC0:
            if at + 1 >= len(data):
                raise ValueError("short name")
            if after is None:
                after = at + 2
            at = (size & 0x3F) << 8 | data[at + 1]
            if at in seen:
                raise ValueError("pointer loop")
            seen.add(at)
            continue
        labels.append(data[at + 1 : at + 1 + size].decode("latin-1"))
        at += 1 + size
    return ".".join(labels), at if after is None else after


def _u16(data: bytes, at: int) -> int:
    if at + 2 > len(data):
        raise ValueError("short record")
    return int.from_bytes(data[at : at + 2], "big")


def dns_records(data: bytes) -> str:
    """The questions and answers of a DNS message as the packet list shows them, up to the first that is cut off."""
    out: list[str] = []
    try:
        at = 12
        for _ in range(_u16(data, 4)):
            name, at = _name(data, at)
            kind = _u16(data, at)
            _u16(data, at + 2)
            at += 4
            out.append(f" {'A' if kind == 1 else 'AAAA' if kind == 28 else kind} {name}")
        for _ in range(_u16(data, 6)):
            name, at = _name(data, at)
            kind, size = _u16(data, at), _u16(data, at + 8)
            value = data[at + 10 : at + 10 + size]
            at += 10 + size
            shown = ""
            if kind == 1 and size == 4 and len(value) == 4:
                shown = " A " + socket.inet_ntoa(value)
            elif kind == 28 and size == 16 and len(value) == 16:
                shown = " AAAA " + socket.inet_ntop(socket.AF_INET6, value)
            elif kind == 6:
                shown = " SOA"
            out.append(f" {name}{shown}")
    except ValueError:
        pass
    return "".join(out)


def dns_of(raw: bytes | None) -> str | None:
    """``dns_records`` of the message that a frame carries over UDP; None where it carries none or not its whole header.

    A message ends where UDP says; a length under 8 wraps and lets everything through.
    """
    if raw is None or len(raw) < 42:
        return None
    kind = raw[12:14]
    if kind == b"\x08\x00" and raw[23] == 17:
        at = 14 + 4 * (raw[14] & 15)
    elif kind == b"\x86\xdd" and len(raw) >= 54 and raw[20] == 17:
        at = 54
    else:
        return None
    if len(raw) < at + 20 or b"\x00\x35" not in (raw[at : at + 2], raw[at + 2 : at + 4]):
        return None
    size = int.from_bytes(raw[at + 4 : at + 6], "big")
    if 8 <= size < 20:
        return None
    return dns_records(raw[at + 8 :] if size < 8 else raw[at + 8 : at + size])


def dns_text(raw: Column) -> Column:
    """``dns_of`` of a binary column (Arrow)."""

    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        return pa.array([dns_of(b) for b in rows.to_pylist()], pa.string())

    return text(raw)
