"""Checksums against plain sums of words."""

import random
import struct

from framelight.operators.checksum import with_checksums
from framelight.plans.packets import packets

from .test_capture import ETH, GOLDEN, frames, ip4, ip6, tcp, udp


def ones(data):
    data += b"\0" * (len(data) % 2)
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total


def summed(raw, at, where):
    """The frame with the right checksum of the segment at ``at``, whose own checksum stands ``where`` bytes into it."""
    raw = bytearray(raw)
    raw[at + where : at + where + 2] = b"\0\0"
    four = raw[12:14] == b"\x08\x00"
    proto, pseudo = (raw[23], raw[26:34]) if four else (raw[20], raw[22:54])
    head = b"" if proto == 1 else bytes(pseudo) + struct.pack(">II", len(raw) - at, proto)
    raw[at + where : at + where + 2] = struct.pack(">H", (0xFFFF - ones(head + bytes(raw[at:]))) or 0xFFFF)
    if four:
        end = 14 + 4 * (raw[14] & 15)
        raw[24:26] = b"\0\0"
        raw[24:26] = struct.pack(">H", 0xFFFF - ones(bytes(raw[14:end])))
    return bytes(raw)


def test_sums_of_all_kinds(spark):
    rng = random.Random(7)
    raws, want = [], []
    for n in range(60):
        data = rng.randbytes(n)
        for raw, at, where in ((ip4(6, tcp(1, 2, data=data)), 34, 16), (ip4(17, udp(1, 2, data), ihl=7), 42, 6), (ip6(6, tcp(1, 2, data=data)), 54, 16),
                (ip6(17, udp(1, 2, data)), 54, 6), (ip6(58, bytes(8) + data), 54, 2), (ip4(1, bytes(8) + data), 34, 2)):
            good = summed(raw, at, where)
            bad = bytearray(good)
            bad[at + where] ^= 1
            four = good[12:14] == b"\x08\x00"
            raws += [good, bytes(bad)]
            want += [(True if four else None, True), (True if four else None, False)]
    fragment = bytearray(summed(ip4(17, udp(1, 2, b"abc")), 34, 6))
    fragment[20] |= 0x20
    raws += [bytes(fragment), raws[0][:-1] if len(raws[0]) > 60 else raws[12][:-1], ETH + b"\x88\xcc" + bytes(30), None]
    want += [(False, None), (True, None), (None, None), (None, None)]
    got = {r.number: (r.ip_sum_ok, r.l4_sum_ok) for r in with_checksums(packets(frames(spark, raws), tracked=False)).select("number", "ip_sum_ok", "l4_sum_ok").collect()}
    assert [got[k + 1] for k in range(len(raws))] == want


def test_prefixes_give_no_error(spark):
    raws = [g[1][:n] for g in GOLDEN[::4] for n in range(0, len(g[1]) + 1, 5)]
    assert with_checksums(packets(frames(spark, raws), tracked=False)).count() == len(raws)
