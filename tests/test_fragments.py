"""Fragments against plain reassembly: any order, overlaps, holes, repeats, reused identifications."""

import random
import struct

from pyspark.sql import functions as F

from framelight import schema as S
from framelight.operators.fragments import reassembled, with_whole_datagrams
from framelight.plans.packets import packets

from .test_capture import A, B, ETH, ip4, plan_of, udp


def fragment(ident, at, more, data, proto=17):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(data), ident, at // 8 | more << 13, 64, proto, 0) + A + B
    return ETH + b"\x08\x00" + head + data


def table(spark, raws, seconds=None):
    rows = [("f", "pcap", k + 1, None, None, 1, (seconds or {}).get(k, 10), 5, len(r), len(r), r, "ok") for k, r in enumerate(raws)]
    return spark.createDataFrame(rows, S.FRAMES)


def plain(parts):
    """Bytes of (at, number, more, data) parts by offset, then number; None with a hole or without an end."""
    out, end = b"", None
    for at, _, more, data in sorted(parts):
        if at > len(out):
            return None
        out += data[len(out) - at :] if at + len(data) > len(out) else b""
        end = max(end or 0, at + len(data)) if not more else end
    return out if end == len(out) else None


def test_random_fragments_against_plain_code(spark):
    rng = random.Random(5)
    raws, want = [], {}
    for ident in range(150):
        size = 8 * rng.randrange(2, 12)
        whole = rng.randbytes(size)
        edges = sorted({0, size, *(8 * rng.randrange(size // 8) for _ in range(3))})
        pieces = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        pieces = [(max(0, a - 8 * rng.randrange(2)), b) for a, b in pieces] + rng.sample(pieces, rng.randrange(2))
        rng.shuffle(pieces)
        if rng.random() < 0.3:
            pieces.pop()
        parts = []
        for a, b in pieces:
            data = whole[a:b] if rng.random() < 0.8 else rng.randbytes(b - a)  # overlaps that disagree
            if a == 0 and b == size:
                continue
            raws.append(fragment(ident, a, b < size, data))
            parts.append((a, len(raws), b < size, data))
        got = plain(parts) if parts else None
        if got is not None and parts:
            want[max(p[1] for p in parts)] = got
    got = {r.number: r for r in reassembled(table(spark, raws)).collect()}
    assert {k: bytes(r.raw[34:]) for k, r in got.items()} == want and 40 < len(want) < 150
    assert all(r.raw[16:18] == struct.pack(">H", len(r.raw) - 14) and r.raw[20:22] == b"\0\0" and r.cap_len == len(r.raw) for r in got.values())


def test_datagrams_stand_in_for_their_fragments(spark):
    data = udp(1, 2, b"x" * 24)
    raws = [fragment(1, 16, False, data[16:]), ip4(17, udp(5, 6)), fragment(1, 0, True, data[:16]), fragment(2, 0, True, data[:16]), b"short"]
    got = {r.number: (r.protocol, r.info) for r in packets(with_whole_datagrams(table(spark, raws)), tracked=False).collect()}
    assert got == {3: ("UDP", "1 -> 2 Len=24"), 2: ("UDP", "5 -> 6 Len=0"), 5: ("", "")}


def test_an_identification_used_again_later(spark):
    a, b = udp(1, 2, b"a" * 24), udp(1, 2, b"b" * 24)
    raws = [fragment(1, 0, True, a[:16]), fragment(1, 16, False, a[16:]), fragment(1, 0, True, b[:16]), fragment(1, 16, False, b[16:])]
    got = reassembled(table(spark, raws, {2: 100, 3: 100})).orderBy("number").collect()
    assert [(r.number, bytes(r.raw[34:])) for r in got] == [(2, a), (4, b)]
    cut = [fragment(1, 0, True, a[:16])[:-1], fragment(1, 16, False, a[16:])]
    assert reassembled(table(spark, cut)).count() == 0 and reassembled(table(spark, raws).limit(0)).count() == 0


def test_bytes_are_made_once_for_each_pass(spark):
    """A condition on the bytes does not make them again: frames of expressions are read twice, as fragments and as others."""
    data = udp(1, 2, b"x" * 24)
    raws = [fragment(1, 16, False, data[16:]), ip4(17, udp(5, 6)), fragment(1, 0, True, data[:16])]
    rows = table(spark, raws).selectExpr(*[c if c != "raw" else "hex(raw) as raw" for c in table(spark, raws).columns]).localCheckpoint()
    whole = with_whole_datagrams(rows.withColumn("raw", F.unhex("raw")))
    assert plan_of(whole).count("unhex(raw") == 2
    assert {r.number: bytes(r.raw[34:]) for r in whole.collect()} == {3: data, 2: raws[1][34:]}
