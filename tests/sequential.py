"""A plain reader of captures, one record after another: the model that the columnar scan is held against."""

from __future__ import annotations

import io
import socket
import struct
from collections.abc import Iterator

from framelight.functions.names import dns_of
from framelight.sources.scan import EPB, IDB, ISB, MOST_FILLED, NRB, PCAP_MAGIC, SHB, SPB, is_pcapng


def _frame(file, kind, number, block, interface, link, hi, lo, cap, orig, raw, status, zero=(None, None), place=(None, None)):
    return "frames", (file, kind, number, block, interface, link, hi, lo, cap, orig, raw, status, *zero, dns_of(raw), *place)


def parse_pcap(file: str, f: io.BufferedIOBase) -> Iterator[tuple[str, tuple]]:
    """Records of a classic capture in host (little-endian) order; another magic gives none.

    A record whose header or body is cut off is filled with zeros and ``truncated``.
    """
    head = f.read(24)
    if len(head) < 4 or struct.unpack("<I", head[:4])[0] != PCAP_MAGIC:
        yield "blocks", (file, 0, None, None, "bad_magic")
        return
    link = struct.unpack("<I", head.ljust(24, b"\0")[20:])[0] & 0x7FFFFFFF
    number = 0
    while part := f.read(16):
        sec, usec, cap, orig = struct.unpack("<IIII", part.ljust(16, b"\0"))
        raw = f.read(cap)
        number += 1
        cut = len(part) < 16 or len(raw) < cap
        if cap < MOST_FILLED:
            raw = raw.ljust(cap, b"\0")
        yield _frame(file, "pcap", number, None, None, link, sec, usec, cap, orig, raw, "truncated" if cut else "ok", (0, 0))


def _names(body: bytes) -> Iterator[tuple[int, str, list[str]]]:
    at = 0
    while at + 4 <= len(body):
        kind, size = struct.unpack_from("<HH", body, at)
        if kind == 0:
            return
        value = body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4
        n = {1: 4, 2: 16}.get(kind)
        if n is None or len(value) < n:
            continue
        address = socket.inet_ntoa(value[:4]) if kind == 1 else socket.inet_ntop(socket.AF_INET6, value[:16])
        yield kind, address, [x.decode("latin-1") for x in value[n:].split(b"\0") if x]


def parse_pcapng(file: str, f: io.BufferedIOBase) -> Iterator[tuple[str, tuple]]:
    """Blocks of a pcapng file.  Packets are numbered through the whole file.

    A section or interface block whose lengths disagree ends the scan; rows before it stay.  Packet and
    statistics blocks with such lengths are told by their status.  Unknown blocks are skipped.
    """
    ordinal = number = section = 0
    links: list[int] = []
    zero = [0, 0]
    while len(head := f.read(8)) == 8:
        kind, total = struct.unpack("<II", head)
        ordinal += 1
        if total < 12:
            yield "blocks", (file, ordinal, kind, total, "bad_length")
            return
        body = f.read(total - 12)
        tail = f.read(4)
        whole = len(body) == total - 12 and len(tail) == 4
        same = whole and struct.unpack("<I", tail)[0] == total
        status = "ok" if same else "length_mismatch" if whole else "truncated"
        yield "blocks", (file, ordinal, kind, total, status)
        if kind == SHB:
            links, section = [], section + 1
            if not same:
                return
        elif kind == IDB:
            link, reserved, snap = struct.unpack("<HHI", body[:8].ljust(8, b"\0"))
            resol, offset, name, about = 6, 0, None, None
            at = 8
            while same and at + 4 <= len(body):
                code, size = struct.unpack_from("<HH", body, at)
                value = body[at + 4 : at + 4 + size]
                if code == 0 or len(value) < size:
                    break
                if code == 9 and size:
                    resol = value[0]
                if code == 14 and size == 8:
                    offset = int.from_bytes(value, "little", signed=True)
                name = value.decode() if code == 2 else name
                about = value.decode() if code == 3 else about
                at += 4 + size + -size % 4
            yield "interfaces", (file, section, len(links), ordinal, link, reserved, snap, resol, offset, name, about, status)
            links.append(link)
            if not same:
                return
        elif kind == EPB:
            number += 1
            interface, hi, lo, cap, orig = struct.unpack("<IIIII", body[:20].ljust(20, b"\0"))
            link = links[interface] if interface < len(links) else None
            if status == "length_mismatch":
                yield _frame(file, "pcapng", number, kind, None, None, None, None, None, None, None, status, place=(section, ordinal))
            else:
                # Nanoseconds, scaled in doubles and cut; either part's first that is not 0 is an anchor from here on.
                stamp = int((float(hi) * 4294967296.0 + float(lo)) * 0.001)
                zero = [old or new for old, new in zip(zero, divmod(stamp, 1_000_000), strict=True)]
                yield _frame(file, "pcapng", number, kind, interface, link, hi, lo, cap, orig, body[20:], status, (zero[0] % (1 << 32), zero[1]), (section, ordinal))
        elif kind == SPB:
            number += 1
            orig = struct.unpack("<I", body[:4].ljust(4, b"\0"))[0]
            yield _frame(file, "pcapng", number, kind, None, links[0] if links else None, None, None, None, orig, None, "undecoded" if same else status, place=(section, ordinal))
        elif kind == ISB:
            yield "statistics", (file, ordinal, *struct.unpack("<III", body[:12].ljust(12, b"\0")), status)
        elif kind == NRB:
            for record in _names(body):
                yield "names", (file, section, ordinal, *record)


def parse(file: str, f: io.BufferedIOBase, kind: str = "capture") -> Iterator[tuple[str, tuple]]:
    if kind == "capture":
        head = f.read(4)
        f.seek(0)
        kind = "pcapng" if is_pcapng(head) else "pcap"
    return parse_pcapng(file, f) if kind == "pcapng" else parse_pcap(file, f)
