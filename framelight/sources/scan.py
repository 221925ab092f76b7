"""Capture records in columns: a walk over record lengths, then all records of a buffer at once, for a whole file or a range of it.

A scan starts at a record with the ``State`` that the records before it leave behind (counts, sections, interfaces,
time anchors), and takes every record that starts before its end.  States of neighbouring ranges compose, so ranges can
be walked apart and put together.
"""

from __future__ import annotations

import io
import socket
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

from framelight import schema as S
from framelight.functions.names import dns_of

#: Block types and magics.
SHB, IDB, SPB, NRB, ISB, EPB = 0x0A0D0D0A, 1, 3, 4, 5, 6
PCAP_MAGIC = 0xA1B2C3D4
#: A cut record is filled up with zeros to the length that it claims; a value of this size or more cannot be held.
MOST_FILLED = 1 << 30
#: Bytes that are read and turned into columns at once (a longer record alone); bytes of a look for a record's start; bytes
#: behind a range that are read with it, at least.
READ, LOOK, BEHIND = 8 << 20, 1 << 20, 1 << 16
#: A start is believed if so many records chain from it, none over MOST_LIKELY bytes; what is believed is checked later.
CHAIN, MOST_LIKELY = 16, 1 << 24
TABLES = {"frames": S.PARSED, "blocks": S.BLOCKS, "interfaces": S.INTERFACES, "statistics": S.STATISTICS, "names": S.NAMES}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of one of the engine's DDL strings; no session is needed, so workers can ask."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


@dataclass(frozen=True)
class State:
    """What the records before a place tell: packets, blocks and sections so far, the section's link types, the anchors, and whether the scan is over."""

    number: int = 0
    ordinal: int = 0
    section: int = 0
    links: tuple[int, ...] = ()
    zero: tuple[int, int] = (0, 0)
    ended: bool = False

    def then(self, after: State) -> State:
        """This state, and behind it records that led from nothing to ``after``."""
        links = after.links if after.section else self.links + after.links
        zero = (self.zero[0] or after.zero[0], self.zero[1] or after.zero[1])
        return State(self.number + after.number, self.ordinal + after.ordinal, self.section + after.section, links, zero, after.ended)


START = State()


def is_pcapng(head: bytes) -> bool:
    """Whether the first four bytes are a section header; anything else counts as classic pcap."""
    return head[:4] == b"\x0a\x0d\x0d\x0a"


def places(buf: bytes, limit: int, ng: bool) -> tuple[list[int], int, int]:
    """(starts of whole records before ``limit``, end of the last, bytes of the next: 0 if its head is cut, -1 if its length is impossible)"""
    get, at, n, out = struct.Struct("<I").unpack_from, 0, len(buf), []
    head, field, more = (8, 4, 0) if ng else (16, 8, 16)
    while at < limit and at + head <= n:
        size = get(buf, at + field)[0] + more
        if ng and size < 12:
            return out, at, -1
        if at + size > n:
            return out, at, size
        out.append(at)
        at += size
    return out, at, 0


@dataclass
class Window:
    """A buffer, its place in the file, starts of its records; the end of each; whether the last record is cut, or has an impossible length."""

    buf: bytes
    base: int
    at: np.ndarray
    end: np.ndarray
    cut: bool = False
    bad: bool = False


def windows(f: io.BufferedIOBase, begin: int, stop: int, size: int, ng: bool) -> Iterator[Window]:
    """All records that start from ``begin`` to before ``stop``.  The last window, maybe without records, ends where the next record starts."""
    f.seek(begin)
    buf, base, want = b"", begin, max(0, min(READ, stop - begin + BEHIND))
    while True:
        buf += f.read(min(want, size - base - len(buf)))
        at, end, need = places(buf, stop - base, ng)
        starts = np.array(at, np.int64)
        last = base + len(buf) >= size
        over = base + end >= stop
        if need < 0:
            yield Window(buf, base, np.append(starts, end), np.append(starts[1:], [end, end + 8]) if at else np.array([end + 8]), bad=True)
            return
        if last and not over and len(buf) - end >= (8 if ng else 1):  # the file ends within a record
            if at:
                yield Window(buf, base, starts, np.append(starts[1:], end))
            yield Window(buf[end:], base + end, np.zeros(1, np.int64), np.array([len(buf) - end]), cut=True)
            return
        if at or over or last:
            yield Window(buf, base, starts, np.append(starts[1:], end) if at else starts)
        if over or last:
            return
        buf, base = buf[end:], base + end
        want = max(READ, need - len(buf))


def _words(buf: np.ndarray, at: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """n little-endian 32-bit numbers from each place; bytes from ``end`` on count as zeros."""
    if not len(at):
        return np.zeros((0, n), np.int64)
    k = at[:, None] + np.arange(4 * n)
    data = np.where(k < end[:, None], buf[np.minimum(k, len(buf) - 1)], np.uint8(0))
    return np.ascontiguousarray(data).view("<u4").astype(np.int64)


def _slices(buf: bytes, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Parts of the buffer as one column, without a Python object for each; null where not ``keep``."""
    if not len(start):
        return pa.array([], pa.binary())
    edges = np.stack([start, end], 1).ravel().astype(np.int32)
    both = pa.Array.from_buffers(pa.binary(), 2 * len(start) - 1, [None, pa.py_buffer(edges), pa.py_buffer(buf)])
    return both.take(pa.array(2 * np.arange(len(start)), mask=~keep))


def _dns(buf: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> pa.Array:
    """DNS texts: only frames with a DNS port over UDP are looked at one by one."""
    size = end - start
    some = np.flatnonzero(keep & (size >= 42))
    byte = lambda at: data[np.minimum(start[some] + at, len(data) - 1)].astype(np.int64)
    kind = byte(12) << 8 | byte(13)
    four, six = (kind == 0x0800) & (byte(23) == 17), (kind == 0x86DD) & (byte(20) == 17)
    at = np.where(four, 14 + 4 * (byte(14) & 15), 54)
    port = [byte(at + k) << 8 | byte(at + k + 1) for k in (0, 2)]
    some = some[(four | six) & ((port[0] == 53) | (port[1] == 53))]
    if not len(some):
        return pa.nulls(len(start), pa.string())
    texts = pa.array([dns_of(buf[start[i] : end[i]]) for i in some.tolist()], pa.string())
    where = np.zeros(len(start), np.int64)
    where[some] = np.arange(len(some))
    return texts.take(pa.array(where, mask=~np.isin(np.arange(len(start)), some)))


def _masked(x: np.ndarray, keep: np.ndarray, kind=None) -> pa.Array:
    return pa.array(x, kind or pa.int64(), mask=~keep)


class Pcap:
    """Columns of a classic capture's records."""

    def __init__(self, file: str, link: int):
        self.file, self.link = file, link

    def columns(self, w: Window, state: State, table: str | None) -> tuple[dict | None, State]:
        n = len(w.at)
        after = replace(state, number=state.number + n)
        if table != "frames" or not n:
            return None, after
        buf, end, whole = w.buf, w.end, np.ones(n, bool)
        if w.cut:  # a body of the length that the record claims, filled with zeros
            cap = struct.unpack_from("<I", buf.ljust(16, b"\0"), 8)[0]
            buf = buf.ljust(16, b"\0")
            buf, whole = buf.ljust(16 + cap if cap < MOST_FILLED else 0, b"\0"), ~whole
            end = np.array([len(buf)])
        data = np.frombuffer(buf, np.uint8)
        sec, usec, cap, orig = _words(data, w.at, end, 4).T
        start, number = w.at + 16, state.number + 1 + np.arange(n)
        none = lambda kind: pa.nulls(n, kind)
        return {
            "file": pa.array([self.file]).take(pa.array(np.zeros(n, np.int64))), "format": pa.array(["pcap"]).take(pa.array(np.zeros(n, np.int64))),
            "number": number, "block_type": none(pa.int64()), "interface_id": none(pa.int64()), "link_type": np.full(n, self.link), "ts_hi": sec,
            "ts_lo": usec, "cap_len": cap, "orig_len": orig, "raw": _slices(buf, start, end, np.ones(n, bool)),
            "status": pa.array(["truncated", "ok"]).take(pa.array(whole.astype(np.int64))), "zero_sec": np.zeros(n, np.int64),
            "zero_us": np.zeros(n, np.int64), "dns": _dns(buf, data, start, end, np.ones(n, bool)), "section": none(pa.int32()), "block_ordinal": none(pa.int32()),
        }, after


def options(data: bytes) -> dict[int, bytes]:
    """First value of each option of a block: code, length, value filled up to 32 bits; up to the end mark, or to what is cut."""
    out, at = {}, 0
    while at + 4 <= len(data):
        code, size = struct.unpack_from("<HH", data, at)
        if code == 0 or at + 4 + size > len(data):
            break
        out.setdefault(code, data[at + 4 : at + 4 + size])
        at += 4 + (size + 3) // 4 * 4
    return out


def name_records(body: bytes) -> Iterator[tuple[int, str, list[str]]]:
    """(record type, address, names) of a name resolution block."""
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


STATUS = pa.array(["ok", "length_mismatch", "truncated", "undecoded", "bad_length"])


class Pcapng:
    """Columns of a pcapng file's blocks.

    A section or interface block whose lengths disagree ends the scan; rows before it stay.  Packet and
    statistics blocks with such lengths are told by their status.  Unknown blocks are skipped.
    """

    def __init__(self, file: str):
        self.file = file

    def columns(self, w: Window, state: State, table: str | None) -> tuple[dict | None, State]:
        n = len(w.at)
        if not n:
            return None, state
        data = np.frombuffer(w.buf, np.uint8)
        kind, total = _words(data, w.at, w.end, 2).T
        body, close = w.at + 8, np.minimum(w.at + total - 4, w.end)
        same = _words(data, w.at + total - 4, w.end, 1)[:, 0] == total
        status = np.where(same, 0, 1)
        if w.cut:
            same, status = same & False, np.full(n, 2)
        if w.bad:
            same[-1], status[-1], kind_of_bad = False, 4, kind[-1]
            kind = np.append(kind[:-1], -1)  # whatever it is, it is not looked into
        ends = np.flatnonzero(((kind == SHB) | (kind == IDB)) & ~same)
        if len(ends):
            kind, total, body, close, same, status = (x[: ends[0] + 1] for x in (kind, total, body, close, same, status))
        n = len(kind)
        ordinal = state.ordinal + 1 + np.arange(n)
        sections = state.section + np.cumsum(kind == SHB)
        is_packet = (kind == EPB) | (kind == SPB)
        packets = np.flatnonzero(is_packet)
        # Link types hold from one section or interface block to the next.
        links, table_at, tables, found = state.links, [0], [state.links], []
        for i in np.flatnonzero((kind == SHB) | (kind == IDB)).tolist():
            if kind[i] == SHB:
                links = ()
            else:
                link, reserved, snap = struct.unpack("<HHI", w.buf[body[i] : close[i]][:8].ljust(8, b"\0"))
                if table == "interfaces":
                    found.append((int(sections[i]), len(links), int(ordinal[i]), link, reserved, snap,
                        options(w.buf[body[i] + 8 : close[i]]) if same[i] else {}, int(status[i])))
                links += (link,)
            table_at.append(i)
            tables.append(links)
        is_stamped = (kind == EPB) & (status != 1)
        stamped = np.flatnonzero(is_stamped)
        epb = _words(data, body[stamped], close[stamped], 5)
        # Nanoseconds, scaled in doubles and cut; either part's first that is not 0 is an anchor from here on.
        stamp = ((epb[:, 1].astype(np.float64) * 4294967296.0 + epb[:, 2].astype(np.float64)) * 0.001).astype(np.int64)
        zero, anchors = [], []
        for part, old in zip(np.divmod(stamp, 1_000_000), state.zero, strict=True):
            first = int(np.argmax(part != 0)) if not old and (part != 0).any() else len(part)
            new = old or (int(part[first]) if first < len(part) else 0)
            zero.append(new)
            anchors.append(np.where(np.arange(len(part)) >= (0 if old else first), new, 0))
        after = State(state.number + len(packets), int(ordinal[-1]), int(sections[-1]), links, (zero[0], zero[1]), w.bad or bool(len(ends)))
        name = lambda n: pa.array([self.file]).take(pa.array(np.zeros(n, np.int64)))
        if table == "blocks":
            if w.bad and not len(ends):
                kind = np.append(kind[:-1], kind_of_bad)
            return {"file": name(n), "block_ordinal": ordinal, "block_type": kind, "total_length": total, "status": STATUS.take(pa.array(status))}, after
        if table == "statistics":
            some = np.flatnonzero(kind == ISB)
            interface, hi, lo = _words(data, body[some], close[some], 3).T
            return {"file": name(len(some)), "block_ordinal": ordinal[some], "interface_id": interface, "ts_hi": hi, "ts_lo": lo,
                "status": STATUS.take(pa.array(status[some]))}, after
        if table == "interfaces":
            return {
                "file": name(len(found)), "section": [x[0] for x in found], "interface_id": [x[1] for x in found], "block_ordinal": [x[2] for x in found],
                "link_type": [x[3] for x in found], "reserved": [x[4] for x in found], "snap_len": [x[5] for x in found],
                "ts_resol": [x[6][9][0] if x[6].get(9) else 6 for x in found],
                "ts_offset": [struct.unpack("<q", x[6][14])[0] if len(x[6].get(14, b"")) == 8 else 0 for x in found],
                "name": [x[6][2].decode("utf-8", "replace") if 2 in x[6] else None for x in found],
                "description": [x[6][3].decode("utf-8", "replace") if 3 in x[6] else None for x in found],
                "status": STATUS.take(pa.array(np.array([x[7] for x in found], np.int64))),
            }, after
        if table == "names":
            rows = [(i, r) for i in np.flatnonzero(kind == NRB).tolist() for r in name_records(w.buf[body[i] : close[i]])]
            return {"file": name(len(rows)), "section": [int(sections[i]) for i, _ in rows], "block_ordinal": [int(ordinal[i]) for i, _ in rows],
                "record_type": [r[0] for _, r in rows], "address": [r[1] for _, r in rows], "names": [r[2] for _, r in rows]}, after
        if table != "frames" or not len(packets):
            return None, after
        return self._frames(w, data, kind, body, close, same, status, ordinal, sections, packets, table_at, tables, is_stamped, epb, anchors, state, name), after

    def _frames(self, w, data, kind, body, close, same, status, ordinal, sections, packets, table_at, tables, is_stamped, epb, anchors, state, name) -> dict:
        n = len(packets)
        full = is_stamped[packets]
        simple = kind[packets] == SPB
        wide = np.zeros((n, 5), np.int64)
        wide[full] = epb
        wide[simple, 4] = _words(data, body[packets[simple]], close[packets[simple]], 1)[:, 0]
        interface, hi, lo, cap, orig = wide.T
        link, known = np.zeros(n, np.int64), np.zeros(n, bool)
        edges = np.searchsorted(packets, [*table_at, len(kind)])
        for links, a, b in zip(tables, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a < b and links:
                at = interface[a:b]
                known[a:b] = (at < len(links)) & (full[a:b] | simple[a:b])
                link[a:b] = np.array(links)[np.minimum(at, len(links) - 1)]
        zero = [np.zeros(n, np.int64) for _ in range(2)]
        for z, a in zip(zero, anchors, strict=True):
            z[full] = a
        start = np.minimum(body[packets] + 20, close[packets])
        shown = np.where(simple & same[packets], 3, status[packets])
        return {
            "file": name(n), "format": pa.array(["pcapng"]).take(pa.array(np.zeros(n, np.int64))), "number": state.number + 1 + np.arange(n),
            "block_type": kind[packets], "interface_id": _masked(interface, full), "link_type": _masked(link, known, pa.int32()),
            "ts_hi": _masked(hi, full), "ts_lo": _masked(lo, full), "cap_len": _masked(cap, full), "orig_len": _masked(orig, full | simple),
            "raw": _slices(w.buf, start, close[packets], full), "status": STATUS.take(pa.array(shown)), "zero_sec": _masked(zero[0] % (1 << 32), full),
            "zero_us": _masked(zero[1], full), "dns": _dns(w.buf, data, start, close[packets], full), "section": sections[packets],
            "block_ordinal": ordinal[packets],
        }


def layout(file: str, f: io.BufferedIOBase, size: int, kind: str = "capture") -> tuple[Pcap | Pcapng | None, int]:
    """(how to read the file, where its first record is); None for a classic capture of another magic."""
    f.seek(0)
    head = f.read(24)
    if kind == "pcapng" or kind == "capture" and is_pcapng(head):
        return Pcapng(file), 0
    if len(head) < 4 or struct.unpack("<I", head[:4])[0] != PCAP_MAGIC:
        return None, 0
    return Pcap(file, struct.unpack("<I", head.ljust(24, b"\0")[20:])[0] & 0x7FFFFFFF), min(24, size)


def scan(file: str, f: io.BufferedIOBase, size: int, table: str = "frames", kind: str = "capture", begin: int | None = None, stop: int | None = None,
         state: State = START) -> Iterator[pa.RecordBatch]:
    """A table's rows of a file, or of the records that start from ``begin`` to before ``stop``, where ``begin`` is a record's start."""
    schema = arrow_schema(TABLES[table])
    reader, first = layout(file, f, size, kind)
    if reader is None:
        if table == "blocks" and not begin:
            yield pa.RecordBatch.from_pylist([{"file": file, "block_ordinal": 0, "status": "bad_magic"}], schema=schema)
        return
    for w in windows(f, first if begin is None else begin, size if stop is None else stop, size, isinstance(reader, Pcapng)):
        found, state = reader.columns(w, state, table)
        if found is not None and len(found["file"]):
            arrays = [x if isinstance(x, pa.Array) and x.type == t.type else x.cast(t.type) if isinstance(x, pa.Array) else pa.array(x, t.type)
                      for x, t in zip((found[t.name] for t in schema), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        if state.ended:
            return


def walk(file: str, f: io.BufferedIOBase, size: int, begin: int, stop: int, kind: str = "capture") -> tuple[int, State]:
    """(start of the first record from ``stop`` on, what the records from ``begin`` to there tell)"""
    reader, _ = layout(file, f, size, kind)
    state, at = State(), begin
    if reader is None:
        return size, replace(state, ended=True)
    for w in windows(f, begin, stop, size, isinstance(reader, Pcapng)):
        _, state = reader.columns(w, state, None)
        at = w.base + int(w.end[-1]) if len(w.end) else w.base
        if w.cut:
            at = size
        if state.ended:
            break
    return at, state


def resync(f: io.BufferedIOBase, begin: int, stop: int, size: int, ng: bool) -> int | None:
    """The first place from ``begin`` to before ``stop`` from which records seem to chain; None if there is none."""
    head, behind = 12 if ng else 16, min(LOOK, max(BEHIND, stop - begin))
    for at in range(begin, stop, LOOK):
        f.seek(at)
        buf = f.read(min(LOOK, stop - at) + behind)
        n = min(LOOK, stop - at, len(buf) - head + 1)
        if n <= 0:
            return None
        data = np.frombuffer(buf, np.uint8)
        word = lambda k: sum(data[k + j : k + j + n].astype(np.int64) << 8 * j for j in range(4))
        if ng:
            total = word(4)
            fits = (total >= 12) & (total <= MOST_LIKELY) & (total % 4 == 0)
        else:
            usec, cap, orig = word(4), word(8), word(12)
            fits = (usec < 1_000_000) & (cap > 0) & (cap <= orig) & (orig <= MOST_LIKELY)
        for k in np.flatnonzero(fits).tolist():
            if _chains(buf, k, at + len(buf) >= size, ng):
                return at + k
    return None


def _chains(buf: bytes, at: int, last: bool, ng: bool) -> bool:
    """Whether CHAIN records follow one another, or as many as there are up to the buffer's end."""
    get, n = struct.Struct("<I").unpack_from, len(buf)
    for k in range(CHAIN):
        if at == n and last and k:
            return True
        if at + (12 if ng else 16) > n:
            return k > 0 and not last
        if ng:
            size = get(buf, at + 4)[0]
            if size < 12 or size > MOST_LIKELY or size % 4:
                return False
            if at + size > n:
                return k > 0 and not last
            if get(buf, at + size - 4)[0] != size:
                return False
        else:
            _, usec, cap, orig = struct.unpack_from("<IIII", buf, at)
            if usec >= 1_000_000 or not 0 < cap <= orig <= MOST_LIKELY:
                return False
            size = 16 + cap
            if at + size > n:
                return k > 0 and not last
        at += size
    return True
