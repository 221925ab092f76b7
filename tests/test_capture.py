"""Golden frames, capture files, the tracker against a model, and prefixes of frames."""

import io
import random
import socket
import struct

import pytest
from pyspark.sql import functions as F

from framelight import schema as S
from framelight.functions.names import dns_records
from framelight.operators.fields import byte_to_fields, packet_fields, payload_range
from framelight.operators.hexdump import hex_dump, hex_text
from framelight.operators.tcp import track
from framelight.plans.packets import packet_at, packet_list, packets
from framelight.sources import capture as C
from framelight.sources import scan

ETH = bytes.fromhex("020000000001" "020000000002")
A, B = socket.inet_aton("10.0.0.1"), socket.inet_aton("10.0.0.2")


def ip4(proto, body, total=None, ihl=5):
    return ETH + b"\x08\x00" + bytes([0x40 | ihl, 0]) + struct.pack(">H",
        4 * ihl + len(body) if total is None else total) + b"\0\1\x40\0\x40" + bytes([proto]) + b"\0\0" + A + B + b"\0" * (4 * ihl - 20) + body


def ip6(proto, body, word=b"\x60\0\0\0"):
    return ETH + b"\x86\xdd" + word + struct.pack(">H", len(body)) + bytes([proto, 64]) + socket.inet_pton(socket.AF_INET6,
        "::1") + socket.inet_pton(socket.AF_INET6, "::ffff:1.2.3.4") + body


def tcp(sport, dport, flags=0, window=0, data=b"", seq=1, ack=0, off=5):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, ack, off << 4, flags, window, 0, 0) + b"\0" * (4 * off - 20) + data


def udp(sport, dport, data=b"", size=None):
    return struct.pack(">HHHH", sport, dport, 8 + len(data) if size is None else size, 0) + data


def arp(kind, op, target):
    return ETH + kind + bytes.fromhex("0001080006040000")[:6] + struct.pack(">H", op) + bytes.fromhex("020000000002") + A + target + B


DNS_Q = bytes.fromhex("00ab0100000100000000000003777777076578616d706c6503636f6d0000010001")
DNS_A = bytes.fromhex("000a8180000100020000000003777777076578616d706c6503636f6d0000010001" "c00c000100010000003c00040a000001" "c010000500010000003c0002c00c")
DHCP = bytes([1, 1, 6, 0]) + bytes.fromhex("00000abc") + b"\0" * 4 + b"\0" * 4 + A + B + b"\0" * 4 + bytes.fromhex("020000000005") + b"\0" * 202

GOLDEN = [
    ("unknown", ETH + b"\x88\xcc" + b"\0" * 20, ("", "", "", None, "")),
    ("icmp request", ip4(1, bytes([8, 0, 0, 0, 0, 5, 0, 7])), ("10.0.0.1", "10.0.0.2", "ICMP", 8, "ICMP Echo Request, Identifier=5, Sequence=7")),
    ("icmp reply", ip4(1, bytes([0, 0, 0, 0, 0, 5, 0, 7])), ("10.0.0.1", "10.0.0.2", "ICMP", 8, "ICMP Echo Reply, Identifier=5, Sequence=7")),
    ("icmp unreachable", ip4(1, bytes([3, 2] + [0] * 6)), ("10.0.0.1", "10.0.0.2", "ICMP", 8, "ICMP Destination Unreachable, Code=2")),
    ("icmp exceeded", ip4(1, bytes([11, 1] + [0] * 6)), ("10.0.0.1", "10.0.0.2", "ICMP", 8, "ICMP Time Exceeded, Code=1")),
    ("icmp other", ip4(1, bytes([5, 1] + [0] * 6)), ("10.0.0.1", "10.0.0.2", "ICMP", 8, "ICMP Type=5, Code=1")),
    ("icmp short", ip4(1, b"\0" * 8, total=27), ("10.0.0.1", "10.0.0.2", "ICMP", 7, "")),
    ("icmp options", ip4(1, bytes([8, 0, 0, 0, 0, 5, 0, 7]), ihl=6), ("10.0.0.1", "10.0.0.2", "ICMP", 8, "ICMP Echo Request, Identifier=5, Sequence=7")),
    ("other", ip4(99, b"x"), ("10.0.0.1", "10.0.0.2", "Other", 1, "")),
    ("wrap", ip4(99, b"", total=0), ("10.0.0.1", "10.0.0.2", "Other", 2**32 - 20, "")),
    ("tcp plain", ip4(6, tcp(1000, 80)), ("10.0.0.1", "10.0.0.2", "TCP", 0, "1000 -> 80 []  Seq=0 Ack=0")),
    ("tcp all flags", ip4(6, tcp(1000, 80, 0xFD, 9)), ("10.0.0.1", "10.0.0.2", "TCP", 0, "1000 -> 80 [FIN, RST, PSH, ACK, URG]  Seq=0 Ack=0 Win=9")),
    ("tcp offset", ip4(6, tcp(1000, 80, 2, off=8, data=b"abc")), ("10.0.0.1", "10.0.0.2", "TCP", 3, "1000 -> 80 [SYN]  Seq=0")),
    ("syn ack first", ip4(6, tcp(1000, 80, 18)), ("10.0.0.1", "10.0.0.2", "TCP", 0, "1000 -> 80 [SYN, ACK] ")),
    ("telnet", ip4(6, tcp(1000, 23, 2, data=b"hi\xff")), ("10.0.0.1", "10.0.0.2", "Telnet", 3, "1000 -> 23 [SYN]  Seq=0[ Telnet data: hi\xff... ]")),
    ("telnet over smtp", ip4(6, tcp(25, 23, 2, data=b"x" * 60)), ("10.0.0.1", "10.0.0.2", "Telnet", 60, "25 -> 23 [SYN]  Seq=0[ "
        "Telnet data: " + "x" * 50 + "... ]")),
    ("smtp", ip4(6, tcp(25, 1000, 2, data=b"HELO")), ("10.0.0.1", "10.0.0.2", "SMTP", 4, "SMTP data: HELO...")),
    ("bgp", ip4(6, tcp(179, 1000, 2, data=b"\xff" * 16 + b"\0\x13\x04")), ("10.0.0.1", "10.0.0.2", "BGP", 19, "179 -> 1000 [SYN]  Seq=0 [ BGP: KEEPALIVE ]")),
    ("bgp short", ip4(6, tcp(179, 1000, 2, data=b"\xff")), ("10.0.0.1", "10.0.0.2", "BGP", 1, "179 -> 1000 [SYN]  Seq=0 [ BGP: Unknown ]")),
    ("udp", ip4(17, udp(1, 2, b"abc")), ("10.0.0.1", "10.0.0.2", "UDP", 11, "1 -> 2 Len=3")),
    ("udp wrap", ip4(17, udp(1, 2, size=3)), ("10.0.0.1", "10.0.0.2", "UDP", 3, f"1 -> 2 Len={2**64 - 5}")),
    ("dns query", ip4(17, udp(5000, 53, DNS_Q)), ("10.0.0.1", "10.0.0.2", "DNS", 8 + len(DNS_Q), "Standard query 0xab A www.example.com")),
    ("dns answer", ip4(17, udp(53, 5000, DNS_A)), ("10.0.0.1", "10.0.0.2", "DNS", 8 + len(DNS_A), "Standard query response 0xa A www.example.com "
        "www.example.com A 10.0.0.1 example.com")),
    ("dns short", ip4(17, udp(53, 5000, b"abc")), ("10.0.0.1", "10.0.0.2", "DNS", 11, "")),
    ("dhcp", ip4(17, udp(68, 67, DHCP)), ("10.0.0.1", "10.0.0.2", "DHCP", 244, "DHCP Request, XID: 0xabc, Client IP: 0.0.0.0, Your IP: 10.0.0.1, "
        "Server IP: 10.0.0.2, Gateway IP: 0.0.0.0, Client MAC: 02:00:00:00:00:05")),
    ("snmp", ip4(17, udp(9, 162, b"abcd")), ("10.0.0.1", "10.0.0.2", "SNMP", 12, "SNMP message (length: 4)")),
    ("ipv6 other", ip6(59, b""), ("::1", "::ffff:1.2.3.4", "Other", 0, "IPv6 Version: 0, Traffic Class: 6, Flow Label: 0, Hop Limit: 64")),
    ("ipv6 word", ip6(59, b"", b"\x6a\xbc\xde\xf1"), ("::1", "::ffff:1.2.3.4", "Other", 0, f"IPv6 Version: 10, Traffic Class: {6 | 0xC << 4}, Flow "
        f"Label: {0xB | 0xDE << 4 | 0xF1 << 12}, Hop Limit: 64")),
    ("icmpv6", ip6(58, bytes([128, 0] + [0] * 6)), ("::1", "::ffff:1.2.3.4", "ICMPv6", 8, "ICMP Type=128, Code=0")),
    ("arp request", arp(b"\x08\x06", 1, b"\0" * 6), ("02:00:00:00:00:02", "Broadcast", "ARP", 28, "ARP Request: Who has 10.0.0.2? Tell 10.0.0.1")),
    ("arp reply", arp(b"\x08\x06", 2, b"\1" * 6), ("02:00:00:00:00:02", "01:01:01:01:01:01", "ARP", 28, "ARP Reply: 10.0.0.1 is at 02:00:00:00:00:02")),
    ("rarp same", arp(b"\x80\x35", 3, bytes.fromhex("020000000002")), ("02:00:00:00:00:02", "Broadcast", "RARP", 28, "ARP Announce: My IP is "
        "associated with MAC 02:00:00:00:00:02")),
    ("rarp zero", arp(b"\x80\x35", 4, b"\0" * 6), ("02:00:00:00:00:02", "00:00:00:00:00:00", "RARP", 28, "ARP Unknown operation")),
]


def frames(spark, raws, file=None):
    rows = [(file or str(k), "pcap", k + 1, None, None, 1, 10, 5, len(r) if r is not None else None, None, r, "ok") for k, r in enumerate(raws)]
    return spark.createDataFrame(rows, S.FRAMES)


def test_golden_frames(spark):
    got = {r.number: r for r in packets(frames(spark, [g[1] for g in GOLDEN])).collect()}
    for k, (name, _, want) in enumerate(GOLDEN):
        r = got[k + 1]
        assert (r.source, r.destination, r.protocol, r.length, r.info) == want, name
        assert r.status == "ok", name


def test_every_prefix_decodes_without_an_error(spark):
    raws = [raw[:n] for raw in (ip4(6, tcp(1, 23, 2, data=b"abc")), ip6(17, udp(53, 1, DNS_A)), ip4(17, udp(67, 68, DHCP[:60])),
        arp(b"\x08\x06", 1, b"\0" * 6)) for n in range(0, len(raw) + 1, 3)]
    got = packets(frames(spark, [*raws, None])).collect()
    assert len(got) == len(raws) + 1
    assert {r.status for r in got} == {"ok", "truncated"}


def test_packet_list_columns(spark):
    row = packet_list(packets(frames(spark, [GOLDEN[1][1]]))).first()
    assert row.asDict() == {"number": 1, "time": "10.000005", "source": "10.0.0.1", "destination": "10.0.0.2", "protocol": "ICMP", "length": 8,
        "info": GOLDEN[1][2][4]}


def model(rows):
    """The tracking rules, one segment after another."""
    state, out = {}, {}
    for f, n, src, sp, dst, dp, seq, ack, flags in rows:
        a, b = (src, sp), (dst, dp)
        key = (f, *sorted([a, b]))
        if key not in state:
            state[key] = {"client": a, "c": seq, "s": 0, "set": False}
        st = state[key]
        syn, acked, fwd = bool(flags & 2), bool(flags & 16), st["client"] == a
        sub = lambda x, y: (x - y) % 2**32
        if syn and not acked:
            if fwd:
                st["c"] = seq
                out[f, n] = (0, -1)
            else:
                out[f, n] = (None, None)
        elif syn:
            if not fwd or a == b:
                st["s"], st["set"] = seq, True
                out[f, n] = (0, 1)
            else:
                out[f, n] = (None, None)
        elif fwd:
            out[f, n] = (sub(seq, st["c"]), sub(ack, st["s"]))
        else:
            if not st["set"]:
                st["s"], st["set"] = seq, True
            out[f, n] = (sub(seq, st["s"]), sub(ack, st["c"]))
    return out


def test_tracker_against_the_model(spark):
    rng = random.Random(5)
    rows = []
    for f in range(25):
        for n in range(1, 40):
            ends = [(rng.choice(["1.1.1.1", "2.2.2.2"]), rng.choice([1, 2])) for _ in range(2)]
            rows.append((str(f), n, *ends[0], *ends[1], rng.choice([0, 5, 2**32 - 1, rng.randrange(2**32)]), rng.randrange(2**32),
                rng.choice([0, 2, 16, 18, 24])))
    df = spark.createDataFrame(rows, "file string, number int, source string, sport bigint, destination string, dport bigint, seq bigint, ack bigint, "
        "flags bigint")
    got = {(r.file, r.number): (r.rel_seq, r.rel_ack) for r in track(df).collect()}
    assert got == model(rows)


def block(kind, body, total=None, tail=None):
    n = 12 + len(body) if total is None else total
    return struct.pack("<II", kind, n) + body + struct.pack("<I", n if tail is None else tail)


SHB = block(scan.SHB, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
IDB = block(scan.IDB, struct.pack("<HHI", 1, 0, 65535))


def epb(ts, data, tail=None):
    return block(scan.EPB, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(data), len(data)) + data, tail=tail)


def rows_of(data, table="frames"):
    return [tuple(r.values()) for batch in scan.scan("f", io.BytesIO(data), len(data), table) for r in batch.to_pylist()]


def test_pcapng_blocks():
    spb = block(scan.SPB, struct.pack("<I", 4) + b"abcd")
    names = block(scan.NRB, struct.pack("<HH", 1, 7) + A + b"ab\0\0" + struct.pack("<HH", 2, 18) + b"\0" * 15 + b"\1" + b"x\0\0\0" + struct.pack("<HH", 0, 0))
    isb = block(scan.ISB, struct.pack("<III", 0, 1, 2))
    data = SHB + IDB + epb(5, b"abcd") + spb + block(0xBAD, b"zzzz") + epb(6, b"efgh", tail=9) + isb + names + SHB + IDB + epb(7, b"ijkl")
    got = rows_of(data)
    assert [(r[2], r[11]) for r in got] == [(1, "ok"), (2, "undecoded"), (3, "length_mismatch"), (4, "ok")]
    assert got[0][10] == b"abcd" and got[2][10] is None
    assert [r[3:] for r in rows_of(data, "names")] == [(1, "10.0.0.1", ["ab"]), (2, "::1", ["x"])]
    assert rows_of(data, "statistics")[0][2:5] == (0, 1, 2)
    assert len(rows_of(data, "interfaces")) == 2 and len(rows_of(data, "blocks")) == 11
    assert [r[2] for r in rows_of(SHB + block(scan.IDB, b"\0" * 8, tail=3) + epb(1, b"abcd"))] == []
    assert rows_of(SHB + IDB + epb(1, b"abcd")[:-6])[0][11] == "truncated"
    assert rows_of(SHB + struct.pack("<II", 7, 0) * 3, "blocks")[-1][-1] == "bad_length"


def test_pcap_records():
    head = struct.pack("<IHHiIII", scan.PCAP_MAGIC, 2, 4, 0, 0, 65535, 1)
    rec = lambda data, n=None: struct.pack("<IIII", 3, 4, len(data) if n is None else n, len(data)) + data
    got = rows_of(head + rec(b"abc") + rec(b"de", 5))
    assert [(r[2], r[10], r[11]) for r in got] == [(1, b"abc", "ok"), (2, b"de\0\0\0", "truncated")]
    assert rows_of(head + rec(b"abc") + b"\1\2")[-1][11] == "truncated"
    assert rows_of(head + rec(b"x", 1_000_000))[0][10] == b"x" + bytes(999_999)  # filled as far as the record claims
    assert rows_of(b"\xa1\xb2\xc3\xd4" + head[4:] + rec(b"abc")) == []
    assert rows_of(b"") == []


@pytest.fixture
def folder(tmp_path):
    head = struct.pack("<IHHiIII", scan.PCAP_MAGIC, 2, 4, 0, 0, 65535, 1)
    raw = ip4(6, tcp(1000, 80, 2))
    (tmp_path / "a.pcap").write_bytes(head + struct.pack("<IIII", 3, 4, len(raw), len(raw)) + raw)
    (tmp_path / "b.pcapng").write_bytes(SHB + IDB + epb(0, raw) + epb(5_000_000_007_000, raw) + epb(9_000_002_000_000, raw))
    return tmp_path


def test_sources_and_time(spark, folder):
    C.register(spark)
    by_source = spark.read.format("capture").load(str(folder))
    by_store = C.read_captures(spark, str(folder))
    pick = lambda df: sorted((r.file.rpartition("/")[2], r.number, r.ts_hi, r.ts_lo, bytes(r.raw)) for r in df.collect())
    assert pick(by_source) == pick(by_store) and len(pick(by_source)) == 4
    assert spark.read.format("pcapng").option("table", "interfaces").load(str(folder / "b.pcapng")).count() == 1
    times = [r.time for r in packets(by_store).where(F.col("file").endswith("ng")).orderBy("number").collect()]
    at = lambda s, u: s + 10e-7 * u
    assert times == [0.0, at(5000, 7) - at(5000, 7), at(9000, 2000) - at(5000, 7)]
    with pytest.raises(Exception):  # noqa: B017
        spark.read.format("capture").load(str(folder / "none")).count()


def test_stream_gives_the_batch_rows(spark, folder, tmp_path):
    from framelight.streaming.captures import stream_packets

    out = str(tmp_path / "out")
    query = stream_packets(spark, str(folder), lambda df, k: df.write.mode("append").parquet(out), str(tmp_path / "ck"), files_per_batch=1)
    query.awaitTermination(120)
    columns = ["number", "time", "source", "info"]
    want = packets(C.read_captures(spark, str(folder))).select(*columns)
    assert sorted(map(tuple, spark.read.parquet(out).select(*columns).collect())) == sorted(map(tuple, want.collect()))


def test_dns_loops_end():
    assert dns_records(bytes.fromhex("000081800001000000000000" + "c00c" + "00010001")) == ""
    assert dns_records(DNS_Q[:20]) == ""


def test_fields_and_bytes(spark):
    p = packets(frames(spark, [GOLDEN[10][1], ETH + b"\x88\xcc" + b"z" * 50])).cache()
    f = packet_fields(p)
    first = {(r.layer, r.label): (r.lo, r.hi, r.value) for r in f.where("number = 1").collect()}
    assert first["L2", "Type"] == (12, 13, "8") and first["L4", "Destination Port"] == (36, 37, "20480") and first["L3", "Source IP"] == (26, 29, "10.0.0.1")
    second = {r.label: (r.lo, r.hi) for r in f.where("number = 2").collect()}
    assert second["ARP Packet"] == (14, 41) and second["ICMP Header"] == (42, 49)
    at = p.where("number = 1").select("file", "number", F.lit(14).alias("byte"))
    assert {r.label for r in byte_to_fields(p, at).collect()} == {"Version", "IHL"}
    assert [(r.number, r.lo, r.hi) for r in payload_range(p).collect()] == [(2, 50, 63)]


def test_details_of_all_golden_frames(spark):
    """Values of every layer are read at their places, IPv6 addresses as text."""
    p = packets(frames(spark, [g[1] for g in GOLDEN])).cache()
    got = {(r.number, r.layer, r.label): r for r in packet_fields(p).collect()}
    for k, (name, raw, want) in enumerate(GOLDEN):
        if name.startswith("ipv6") or name == "icmpv6":
            assert (got[k + 1, "L3", "Source IP"].value, got[k + 1, "L3", "Destination IP"].value) == want[:2]
            assert got[k + 1, "L3", "Hop Limit"].value == "64" and (got[k + 1, "L3", "Destination IP"].lo, got[k + 1, "L3", "Destination IP"].hi) == (38, 53)
        if name == "udp":
            assert got[k + 1, "L4", "Length"].value == str(int.from_bytes(raw[38:40], "little"))
    assert (got[len(GOLDEN), "L3", "ARP Packet"].lo, got[len(GOLDEN), "L3", "ARP Packet"].hi) == (14, 41)


def test_ipv6_text(spark):
    """Built-in functions print addresses as the C library does."""
    rng = random.Random(4)
    words = lambda: b"".join(rng.choice([b"\0\0", b"\0\0", b"\0\1", b"\xff\xff", bytes([rng.randrange(256), 0]),
        rng.randbytes(2)]) for _ in range(8))
    some = [words() for _ in range(3000)]
    some += [bytes(16), bytes(15) + b"\1", bytes(12) + b"\1\2\3\4", bytes(10) + b"\xff\xff" + b"\1\2\3\4", bytes(12) + b"\0\0\1\0", b"\1" + bytes(15),
        b"\1" * 16, bytes(14) + b"\1\0"]
    raws = [ETH + b"\x86\xdd" + b"\x60\0\0\0\0\0\x3b\x40" + a + b for a, b in zip(some, some[1:] + some[:1], strict=True)]
    got = {r.number: (r.source, r.destination) for r in packets(frames(spark, raws), tracked=False).select("number", "source", "destination").collect()}
    text = [socket.inet_ntop(socket.AF_INET6, x) for x in some]
    assert got == {k + 1: (text[k], text[(k + 1) % len(text)]) for k in range(len(text))}


def test_hex_texts(spark):
    raws = [bytes(range(256))[: n] for n in (0, 1, 15, 16, 17, 32, 200)]
    for r in hex_text(frames(spark, raws)).collect():
        raw = raws[r.number - 1]
        lines = [raw[k : k + 16] for k in range(0, len(raw), 16)]
        assert r.hex == "".join("".join(f"{b:02x} " for b in x).ljust(48) + "\n" for x in lines)
        assert r.text == "".join("".join(chr(b) if 32 <= b < 127 else "." for b in x) + "\n" for x in lines)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_captures_are_parsed_and_moved_once(spark, folder):
    """One scan, one Python stage (the parser), one exchange, by connection and not by file alone."""
    plan = plan_of(packet_list(packets(C.read_captures(spark, str(folder)))))
    assert plan.count("Scan binaryFile") == 1 and plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    exchanges = [x for x in plan.split("\n") if "Exchange" in x]
    assert len(exchanges) == 1 and "conn_lo" in exchanges[0] and "BroadcastExchange" not in exchanges[0]
    assert "Join" not in plan
    assert "Exchange" not in plan_of(packets(C.read_captures(spark, str(folder))).select("number", "time", "source", "protocol"))


def test_python_sees_dns_frames_only(spark):
    plan = plan_of(packets(frames(spark, [GOLDEN[10][1]]).drop("file").withColumn("file", F.lit("f")), tracked=False).select("number", "info"))
    assert plan.count("ArrowEvalPython") == 1 and "Union" in plan
    both = packets(frames(spark, [g[1] for g in GOLDEN])).select("number", "info").collect()
    assert len(both) == len(GOLDEN)


def test_one_frame(spark):
    raws = [ip4(6, tcp(1000, 80, 2, seq=5)), ip4(17, udp(1, 2)), ip4(6, tcp(1000, 80, 16, seq=9))]
    table = frames(spark, raws, file="f").unionByName(frames(spark, raws, file="g"))
    assert [(r.file, r.number, r.rel_seq) for r in packet_at(table, "f", 3).collect()] == [("f", 3, 4)]
    assert packet_at(table, "f", 9).count() == packet_at(table, "h", 1).count() == 0


def test_hex_dump_holds_the_bytes(spark):
    raw = bytes(range(256))[:77]
    lines = hex_dump(frames(spark, [raw, b""])).orderBy("line").collect()
    assert bytes.fromhex("".join(r.bytes for r in lines)) == raw
    assert lines[1].address == "00000010: " and lines[2].ascii == ' !"#$%&\'()*+,-./' and lines[0].ascii == "." * 16


def test_conditions_on_derived_columns_plan_small(spark, folder):
    """A condition on the protocol or a port is not rewritten in terms of the bytes."""
    table = packets(C.read_captures(spark, str(folder)), tracked=False)
    chosen = table.where("protocol = 'TCP' and length < 99 and info like '%80%' and source != destination")
    assert len(plan_of(chosen.select("number"))) < 100_000 and chosen.count() == 4


def test_files_are_built_by_tasks_of_few(spark, monkeypatch):
    """More files are more tasks, so no task's batch holds more of them as they grow in number; a file without content is empty."""
    from framelight.plans import fixtures

    monkeypatch.setattr(fixtures, "EVENTS_A_FILE", 20)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for made in (fixtures.captures(events), fixtures.captures_ng(events), fixtures.captures_ended(events)):
        held = [r["count"] for r in made.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
        assert sum(held) >= 10 and max(held) <= 5
    assert C.parse_files(spark.createDataFrame([("a", None), ("b", b"")], "path string, content binary")).count() == 0


def test_numbers_wider_than_their_field_wrap(spark):
    """A DHCP transaction id of 33 bits is its low 32 in the frame; its high digits are what goes."""
    from framelight.plans import fixtures

    xid = 65_537 * 65_536
    got = spark.range(xid, xid + 1).select(fixtures.h(F.col("id"), 4), fixtures.le_hex(F.col("id"), 4), fixtures.h(-F.col("id"), 2), fixtures.h(F.col("id"), 16)).first()
    assert tuple(got) == ("00010000", "00000100", "0000", "0000000100010000".rjust(32, "0"))
