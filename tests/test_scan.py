"""The columnar scan and the reading by ranges against a plain sequential reader, on whole and damaged captures."""

import io
import random
import struct

import pytest

from framelight.sources import ranges, scan
from framelight.sources.capture import read_captures

from .sequential import parse
from .test_capture import DNS_A, DNS_Q, block, ip4, ip6, plan_of, tcp, udp


def payload(rng):
    dns = rng.choice([DNS_Q, DNS_A, DNS_A[:20]])
    return rng.choice([
        lambda: rng.randbytes(rng.randrange(90)), lambda: bytes(rng.randrange(300)), lambda: ip4(17, udp(53, 9, dns)), lambda: ip6(17, udp(9, 53, dns)),
        lambda: ip4(6, tcp(1, 80, 2)), lambda: struct.pack("<IIII", 1, 2, 4, 4) + b"abcd", lambda: pcap(rng, 20)[24:], lambda: pcapng(rng, 20),
    ])()


def pcap(rng, n):
    out = [struct.pack("<IHHiIII", scan.PCAP_MAGIC, 2, 4, 0, 0, 65535, 1)]
    for k in range(n):
        data = rng.randbytes(rng.randrange(1, 60)) if n <= 20 else payload(rng)
        out.append(struct.pack("<IIII", 1000 + k, rng.randrange(1_000_000), len(data), len(data)) + data)
    return b"".join(out)


def interface(rng):
    some = [struct.pack("<HHB3x", 9, 1, rng.choice([3, 6, 9, 0x8A])), struct.pack("<HHq", 14, 8, rng.randrange(-9, 9)), struct.pack("<HH", 2, 5) + b"eth00\0\0\0",
        struct.pack("<HH", 3, 4) + b"desc", struct.pack("<HH", 0, 0), struct.pack("<HH", 77, 900)]
    return block(scan.IDB, struct.pack("<HHI", rng.randrange(300), 0, 65535) + b"".join(rng.sample(some, rng.randrange(5))))


def pcapng(rng, n):
    shb = block(scan.SHB, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out = [shb, interface(rng)]
    for _ in range(n):
        data = rng.randbytes(rng.randrange(40)) if n <= 20 else payload(rng)
        data += bytes(-len(data) % 4)
        stamp = rng.choice([0, 5, 1_000_000_000, 7_000_000, rng.randrange(1 << 63)])
        epb = struct.pack("<IIIII", rng.randrange(3), stamp >> 32, stamp & 0xFFFFFFFF, len(data), len(data)) + data
        names = struct.pack("<HH", 1, 7) + b"\1\2\3\4ab\0\0" + struct.pack("<HH", 2, 18) + bytes(15) + b"\1x\0\0\0" + bytes(4)
        out.append(rng.choice([
            lambda e=epb: block(6, e), lambda e=epb: block(6, e), lambda e=epb: block(6, e), lambda e=epb: block(6, e, tail=9), lambda: interface(rng),
            lambda d=data: block(3, struct.pack("<I", 4) + d), lambda: block(5, struct.pack("<III", 0, 1, 2)), lambda m=names: block(4, m),
            lambda d=data: block(0xBAD, d), lambda: shb if rng.random() < 0.3 else b"", lambda e=epb: block(6, e[:4]), lambda: block(3, b""),
        ])())
    return b"".join(out)


def damaged(rng, data):
    """A capture as it is, cut, with a block that ends the scan, or with bytes changed."""
    return rng.choice([
        lambda: data, lambda: data, lambda: data[: rng.randrange(len(data) + 1)],
        lambda: data + block(rng.choice([scan.SHB, scan.IDB]), bytes(16), tail=5) + data,
        lambda: data + struct.pack("<II", 6, rng.randrange(12)) + data, lambda: data + b"abc",
        lambda: data[: (k := rng.randrange(len(data)))] + rng.randbytes(2) + data[k + 2 :],
    ])()


def model(data, table):
    return [r for name, r in parse("f", io.BytesIO(data)) if name == table]


def rows(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


def by_ranges(data, table, split):
    """What the ranges give, without Spark: looked at apart, settled, read apart."""
    n = max(1, -(-len(data) // split))
    import pyarrow as pa

    files = pa.RecordBatch.from_pylist([{"path": "f", "length": len(data), "split": k} for k in range(n)])
    looked = pa.Table.from_batches(list(ranges._look("capture", split)([files])))
    settled = ranges._settle("capture", split)(looked).to_pylist()
    assert [r["begin"] for r in settled] == sorted({r["begin"] for r in settled})
    got = []
    for r in settled:
        got += rows(scan.scan("f", io.BytesIO(data), len(data), table, "capture", r["begin"], r["stop"], ranges._state(r)))
    return got, len(settled)


@pytest.mark.parametrize("kind", [pcap, pcapng])
def test_against_the_sequential_reader(monkeypatch, kind):
    rng = random.Random(8)
    seen = 0
    for k in range(60):
        monkeypatch.setattr(scan, "READ", rng.choice([64, 300, 5000, 1 << 20]))
        data = damaged(rng, kind(rng, rng.randrange(1, 80)))
        for table in scan.TABLES:
            want = model(data, table)
            assert rows(scan.scan("f", io.BytesIO(data), len(data), table)) == want, (k, table)
            seen += len(want)
    assert seen > 1_500


@pytest.mark.parametrize("kind", [pcap, pcapng])
def test_ranges_give_the_same_rows(monkeypatch, kind):
    """Also where payloads hold records or whole captures, so that looks are mistaken."""
    rng = random.Random(9)
    several = 0
    for k in range(40):
        monkeypatch.setattr(scan, "READ", rng.choice([300, 1 << 20]))
        monkeypatch.setattr(scan, "LOOK", rng.choice([200, 1 << 20]))
        data = damaged(rng, kind(rng, rng.randrange(1, 120)))
        monkeypatch.setattr(ranges, "open_at", lambda path, data=data: io.BytesIO(data))
        split = rng.choice([100, 700, 5000])
        for table in scan.TABLES:
            got, n = by_ranges(data, table, split)
            assert got == model(data, table), (k, table)
            several += n > 3
    assert several > 30


def test_starts_are_found_without_the_records_before():
    rng = random.Random(2)
    for kind, ng in ((pcap, False), (pcapng, True)):
        data = kind(rng, 21 if ng else 400)
        if ng:
            data += b"".join(block(6, struct.pack("<IIIII", 0, 0, 5, 40, 40) + rng.randbytes(40)) for _ in range(300))
        starts = [b for w in scan.windows(io.BytesIO(data), 0 if ng else 24, len(data), len(data), ng) for b in (w.base + w.at).tolist()]
        begin = len(data) // 2
        assert scan.resync(io.BytesIO(data), begin, len(data), len(data), ng) == min(b for b in starts if b >= begin)


def test_read_captures_by_ranges(spark, tmp_path):
    rng = random.Random(5)
    for k in range(3):
        (tmp_path / f"a{k}.pcap").write_bytes(pcap(rng, 300))
        (tmp_path / f"b{k}.pcapng").write_bytes(pcapng(rng, 300))
    (tmp_path / "c.pcap").write_bytes(b"no capture at all")
    (tmp_path / "d.pcap").write_bytes(b"")
    pick = lambda df: sorted(map(repr, df.collect()))
    for table in scan.TABLES:
        apart, whole = (read_captures(spark, str(tmp_path), table, split=s) for s in (2000, 1 << 30))
        assert pick(apart) == pick(whole)
    plan = plan_of(read_captures(spark, str(tmp_path), split=2000))
    # Contents never pass through Spark: only paths and lengths are listed, and rows of ranges are moved.
    assert "content" not in plan.split("ReadSchema")[1][:60]
    found = read_captures(spark, str(tmp_path), split=2000)
    assert found.rdd.getNumPartitions() > 20


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("make", [pcap, pcapng])
def test_a_range_reads_its_own_bytes(make):
    """And some behind it, not the rest of the file."""
    data, split = make(random.Random(3), 60_000), 1 << 15
    for begin in (split, len(data) // 2):
        f = Counted(data)
        at = scan.resync(f, begin, begin + split, len(data), make is pcapng)
        assert f.taken <= 2 * scan.BEHIND
        scan.walk("f", f, len(data), at, begin + split)
        assert f.taken <= 5 * scan.BEHIND < len(data) // 2


def test_small_ranges_share_tasks(spark):
    """Tasks go by cores and bytes; ranges of a few kilobytes do not get one each."""
    cores = spark.sparkContext.defaultParallelism
    files = lambda n, size: spark.range(n).selectExpr("concat('f', id) as path", f"{size}L as length")
    assert ranges._tasks(files(100, 4 << 20), 1 << 15) == ranges.TASKS_A_CORE * cores
    assert ranges._tasks(files(100, 1 << 30), 1 << 15) == 1600 and ranges._tasks(files(100, 1 << 30), ranges.SPLIT) == 1600
    assert ranges._tasks(files(3, 10), 1 << 15) == 3 and ranges._tasks(files(0, 1), 1 << 15) == 1
