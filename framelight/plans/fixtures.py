"""Frames and captures built from ordinary tables, by expressions only: inputs for queries, tests and benchmarks."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelight.sources.ranges import put

SERVER = "C0A8000A"  # 192.168.0.10


def h(x: int | Column, size: int) -> Column:
    """A number as big-endian hex of ``size`` bytes; of a wider one the low bytes, as a counter that wraps."""
    return F.lit(f"{x:0{2 * size}x}") if isinstance(x, int) else F.substring(F.lpad(F.hex(x.cast("bigint")), max(16, 2 * size), "0"), -2 * size, 2 * size)


def le_hex(x: Column, size: int) -> Column:
    """A number as little-endian hex."""
    wide = h(x, size)
    return F.concat(*[F.substring(wide, 2 * k + 1, 2) for k in reversed(range(size))])


def join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def ethernet(kind: int, src: Column | None = None, dst: Column | None = None) -> Column:
    return join("0200", h(dst, 4) if dst is not None else "00000001", "0200", h(src, 4) if src is not None else "00000002", h(kind, 2))


def ip4(total: Column, proto: int | Column, src: Column | str, dst: Column | str, ident: Column | None = None, ttl: Column | None = None) -> Column:
    return join("4500", h(total, 2), h(ident, 2) if ident is not None else "0001", "4000", h(ttl, 1) if ttl is not None else "40", h(proto, 1),
        "0000", src, dst)


def ip6(word: Column | str, size: Column | int, proto: int | Column, src: Column, dst: Column) -> Column:
    return join(word, h(size, 2), h(proto, 1), "40", src, dst)


def tcp(sport: Column | int, dport: Column | int, seq: Column | int = 0, ack: Column | int = 0, flags: Column | int = 24, window: Column | int = 0) -> Column:
    return join(h(sport, 2), h(dport, 2), h(seq, 4), h(ack, 4), "50", h(flags, 1), h(window, 2), "00000000")


def udp(sport: Column | int, dport: Column | int, size: Column) -> Column:
    return join(h(sport, 2), h(dport, 2), h(size, 2), "0000")


def frames(rows: DataFrame, number: Column, body: Column, micros: Column | None = None, file: Column | None = None, dns: bool = True) -> DataFrame:
    """The frames table of hex bodies, as a classic capture's.  ``dns``: some may be DNS messages."""
    us = micros if micros is not None else F.lit(0).cast("bigint")
    raw = F.unhex(body)
    none = F.lit(None).cast("bigint")
    size = F.octet_length(raw).cast("bigint")
    out = rows.select(
        (file if file is not None else F.lit("mem")).alias("file"), F.lit("pcap").alias("format"), number.cast("int").alias("number"),
        none.alias("block_type"), none.alias("interface_id"), F.lit(1).alias("link_type"),
        F.floor(us / 1_000_000).cast("bigint").alias("ts_hi"), F.pmod(us, F.lit(1_000_000)).cast("bigint").alias("ts_lo"),
        size.alias("cap_len"), size.alias("orig_len"), raw.alias("raw"), F.lit("ok").alias("status"),
        F.lit(0).cast("bigint").alias("zero_sec"), F.lit(0).cast("bigint").alias("zero_us"),
    )
    return out if dns else out.withColumn("dns", F.lit(None).cast("string"))


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


event, user = lambda: F.col("event_id"), lambda: F.col("user_id")


def client() -> Column:
    """10.0.x.y of the user."""
    return join("0A00", h(F.pmod(user(), F.lit(65536)), 2))


def tcp_frames(events: DataFrame, file: Column | None = None) -> DataFrame:
    """One client segment for each event."""
    e = event()
    flags = F.when(e % 10 == 0, 2).otherwise(24)
    body = join(ethernet(0x0800, user(), e), ip4(40 + e % 100, 6, client(), SERVER, e % 65536, e % 256),
        tcp(1024 + user() % 1000, 80, F.pmod(e * 7919, F.lit(1 << 32)), e * 3, flags, e % 65536))
    return frames(events, e + 1, body, micros(), file, dns=False)


def flow_frames(events: DataFrame) -> DataFrame:
    """As ``tcp_frames``, with every second frame from the server and SYN-ACK on some of those."""
    e = event()
    back = e % 2 == 1
    flags = F.when(e % 10 == 0, 2).when(e % 10 == 1, 18).otherwise(24)
    port = 1024 + user() % 1000
    body = join(
        ethernet(0x0800), ip4(F.lit(40), 6, F.when(back, F.lit(SERVER)).otherwise(client()), F.when(back, client()).otherwise(F.lit(SERVER))),
        tcp(F.when(back, 80).otherwise(port), F.when(back, port).otherwise(80), F.pmod(e * 7919, F.lit(1 << 32)), e * 3, flags, F.lit(512)),
    )
    return frames(events, e + 1, body, micros(), dns=False)


#: The payload of a TCP segment whose IPv4 packet has the greatest length.
SEGMENT = 65_535 - 40


def text_frames(documents: DataFrame, port: Column | int) -> DataFrame:
    """TCP segments to ``port`` with each whole text: SEGMENT bytes each, the k-th of a text in file ``segment<k>``, sequence numbers rising."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    parts = F.greatest(F.lit(0), F.floor((F.octet_length("data") - 1) / SEGMENT).cast("int"))
    rows = documents.select("doc_id", data.alias("data")).select("*", F.explode(F.sequence(F.lit(0), parts)).alias("part"))
    rows = rows.withColumn("data", F.substring("data", F.col("part") * SEGMENT + 1, F.lit(SEGMENT)))
    body = join(ethernet(0x0800), ip4(40 + F.octet_length("data"), 6, "0A000001", SERVER), tcp(F.lit(40000), port, 1 + F.col("part") * SEGMENT, 1),
        F.hex("data"))
    return frames(rows, F.col("doc_id") + 1, body, file=F.concat(F.lit("segment"), F.col("part").cast("string")), dns=False)


def dns_name(host: Column) -> Column:
    return F.concat(F.array_join(F.transform(F.split(host, "[.]"), lambda x: F.concat(h(F.octet_length(x), 1), F.hex(x))), ""), F.lit("00"))


#: Events of a capture file, about: files grow in number with the rows.
EVENTS_A_FILE = 50_000


def files_of(events: DataFrame) -> int:
    return max(8, -(-events.count() // EVENTS_A_FILE))


def _dealt(events: DataFrame, kind: str) -> DataFrame:
    """``tcp_frames`` dealt to ``files_of`` files by user, a task for each file, so that none holds more of them as there are more."""
    files = files_of(events)
    return tcp_frames(events, join("cap", F.pmod(user(), F.lit(files)).cast("string"), f".{kind}")).repartition(files, "file")


def _joined(dealt: DataFrame, record: Column, head: str) -> DataFrame:
    """path, content: the records of each file behind ``head``, in order of number."""
    rows = dealt.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("number", record.alias("r")))).alias("rows"))
    return rows.select("path", F.unhex(join(head, F.array_join(F.transform("rows", lambda x: x["r"]), ""))).alias("content"))


def captures(events: DataFrame) -> DataFrame:
    """path, content: classic captures of ``tcp_frames``, dealt to ``files_of`` files by user, frames in order of event."""
    record = join(le_hex(F.col("ts_hi"), 4), le_hex(F.col("ts_lo"), 4), le_hex(F.col("cap_len"), 4), le_hex(F.col("orig_len"), 4), F.hex("raw"))
    return _joined(_dealt(events, "pcap"), record, "D4C3B2A1020004000000000000000000FFFF000001000000")


def captures_ng(events: DataFrame) -> DataFrame:
    """The same as pcapng: section, interface, one enhanced packet block a frame, timestamps in nanoseconds."""
    ns = (F.col("ts_hi") * 1_000_000 + F.col("ts_lo")) * 1000
    padded = F.pmod(-F.col("cap_len"), F.lit(4))
    total = le_hex(32 + F.col("cap_len") + padded, 4)
    record = join("06000000", total, "00000000", le_hex(F.shiftright(ns, 32), 4), le_hex(F.pmod(ns, F.lit(1 << 32)), 4),
        le_hex(F.col("cap_len"), 4), le_hex(F.col("orig_len"), 4), F.hex("raw"), F.expr("repeat('00', cast(pmod(-cap_len, 4) as int))"), total)
    return _joined(_dealt(events, "pcapng"), record, _SECTION + "01000000140000000100000000000400" + "14000000")


def _le(x: Column | int, size: int) -> Column:
    return le_hex(F.lit(x) if isinstance(x, int) else x, size)


def _block(kind: int, body: Column, wrong: int = 0, size: Column | None = None) -> Column:
    """A pcapng block; its closing length is wrong by ``wrong``.  ``size``: bytes of the body, where they are known."""
    total = 12 + (F.length(body) / 2 if size is None else size)
    return join(_le(kind, 4), _le(total, 4), body, _le(total + wrong, 4))


def captures_mixed(events: DataFrame) -> DataFrame:
    """path, content: pcapng files of all kinds of blocks, by event modulo 7.

    0, 1 enhanced packets, 2 a simple packet, 3 interface statistics, 4 an unknown block, 5 an enhanced packet
    whose lengths disagree, 6 a name record; after a section and an interface.
    """
    e = event()
    enhanced = join(_le(0, 4), _le(e % 1000, 4), _le(e, 4), _le(4, 4), _le(4, 4), h(e, 4))
    kinds = [
        _block(6, enhanced), _block(6, enhanced), _block(3, join(_le(4, 4), h(e, 4))), _block(5, join(_le(e % 3, 4), _le(1, 4), _le(e, 4))),
        _block(0xBAD, h(e, 4)), _block(6, enhanced, 4), _block(4, join(_le(1, 2), _le(6, 2), client(), "6E00", "0000", "00000000")),
    ]
    return _filed(events, "mixed", F.get(F.array(*kinds), (e % 7).cast("int")), _SECTION + "01000000140000000100000000000400" + "14000000")


_SECTION = "0A0D0D0A1C0000004D3C2B1A01000000FFFFFFFFFFFFFFFF1C000000"


def _filed(events: DataFrame, name: str, record: Column, head: str) -> DataFrame:
    """path, content: pcapng files of one record for each event, by user."""
    files = files_of(events)
    rows = events.select(F.pmod(user(), F.lit(files)).alias("f"), event().alias("n"), record.alias("r")).repartition(files, "f")
    rows = rows.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("n", "r"))).alias("rows"))
    content = F.unhex(join(head, F.array_join(F.transform("rows", lambda x: x["r"]), "")))
    return rows.select(F.concat(F.lit(name), F.col("f").cast("string"), F.lit(".pcapng")).alias("path"), content.alias("content"))


#: Events between two sections of ``captures_named``.
SECTION = 50


def captures_named(events: DataFrame) -> DataFrame:
    """path, content: pcapng files of sections, interfaces of three clocks, names and packets.

    Each event of a number divisible by SECTION opens a section.  Every fifth event names its user's address; the
    others are TCP frames of the interface event modulo 3: microseconds; nanoseconds, 7 seconds late; 1,024ths of a second.
    """
    option = lambda code, size, value: f"{code:02X}00{size:02X}00" + value.ljust(2 * (size + -size % 4), "0")
    plain = "01000000140000000100000000000400" + "14000000"
    nano = "010000002C0000000100000000000400" + option(9, 1, "09") + option(14, 8, "0700000000000000") + option(0, 0, "") + "2C000000"
    binary = "01000000200000000100000000000400" + option(9, 1, "8A") + option(0, 0, "") + "20000000"
    head = _SECTION + plain + nano + binary
    e, us = event(), micros()
    ticks = F.when(e % 3 == 0, us).when(e % 3 == 1, us * 1000).otherwise(F.floor(us / 1000))
    body = join(ethernet(0x0800), ip4(F.lit(40), 6, client(), SERVER), tcp(1024 + user() % 1000, 80, e, 0, 24, 0), "0000")
    packet = _block(6, join(_le(e % 3, 4), _le(F.shiftright(ticks, 32), 4), _le(F.pmod(ticks, F.lit(1 << 32)), 4), _le(54, 4), _le(54, 4), body), size=F.lit(76))
    label = F.hex(F.concat(F.lit("n"), e.cast("string")))
    size = 1 + F.length(e.cast("string"))
    named = join(_le(1, 2), _le(5 + size, 2), client(), label, "00", F.expr("repeat('00', cast(pmod(-5 - length(concat('n', event_id)), 4) as int))"), "00000000")
    record = F.concat(F.when(e % SECTION == 0, F.lit(head)).otherwise(F.lit("")), F.when(e % 5 == 2, _block(4, named, size=8 + 4 * F.ceil((5 + size) / 4))).otherwise(packet))
    return _filed(events, "named", record, head)


#: Events between two blocks that end a scan, in ``captures_ended``.
END = 300


def captures_ended(events: DataFrame) -> DataFrame:
    """path, content: pcapng files of packets, and of simple packets and statistics whose lengths disagree, by event modulo 4.

    An event before a number divisible by END is a section or interface block whose lengths disagree, which ends a scan.
    """
    e = event()
    enhanced = join(_le(0, 4), _le(1, 4), _le(e, 4), _le(4, 4), _le(4, 4), h(e, 4))
    kinds = [_block(6, enhanced, size=F.lit(24)), _block(3, join(_le(4, 4), h(e, 4)), 4, F.lit(8)), _block(5, join(_le(0, 4), _le(1, 4), _le(e, 4)), 4, F.lit(12)),
        _block(0xBAD, h(e, 4), size=F.lit(4))]
    ends = F.when(e % (2 * END) < END, _block(1, h(e, 8), 8, F.lit(8))).otherwise(_block(0x0A0D0D0A, h(e, 16), 4, F.lit(16)))
    record = F.when(e % END == END - 1, ends).otherwise(F.get(F.array(*kinds), (e % 4).cast("int")))
    return _filed(events, "ended", record, _SECTION + "01000000140000000100000000000400" + "14000000")


def fragment_frames(events: DataFrame) -> DataFrame:
    """UDP datagrams of 48 bytes in three fragments that overlap and come in any order; every seventh lacks its end."""
    e = event()
    rows = events.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).where((e % 7 != 0) | (F.col("k") < 2))
    data = join(h(1024 + user() % 1000, 2), h(9999, 2), h(48, 2), "0000", *[h(e + 5 * k, 4) for k in range(10)])
    k, pick = F.col("k"), lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("k"))
    at, size = pick([0, 8, 32]), pick([16, 24, 16])
    part = F.substring(data, 2 * at + 1, 2 * size)
    ip = join("4500", h(20 + size, 2), h(e % 65536, 2), h(at / 8 + F.when(k == 2, 0).otherwise(8192), 2), "4011", "0000", client(), SERVER)
    return frames(rows, 3 * e + (k + e) % 3 + 1, join(ethernet(0x0800), ip, part), micros(), dns=False)


def summed_frames(events: DataFrame) -> DataFrame:
    """UDP packets over IPv4 with their checksums: right ones, but for the header's in odd events and UDP's in every third, where it is one more; none (0) in every fifth."""
    e = event()
    low = F.pmod(user(), F.lit(65536))
    fold = lambda x: (x % 65536 + F.floor(x / 65536)) % 65536 + F.floor((x % 65536 + F.floor(x / 65536)) / 65536)
    server = [int(SERVER[:4], 16), int(SERVER[4:], 16)]
    header = F.lit(0x4500 + 32 + 0x4000 + 0x4011 + 0x0A00 + sum(server)) + e % 65536 + low
    segment = F.lit(0x0A00 + sum(server) + 17 + 12 + 9999 + 12) + low + 1024 + user() % 1000 + F.floor(e / 65536) % 65536 + e % 65536
    right = 65535 - fold(header), 65535 - fold(segment)
    of_udp = F.when(right[1] == 0, 65535).otherwise(right[1])
    of_udp = F.when(e % 5 == 0, 0).when(e % 3 == 0, of_udp % 65535 + 1).otherwise(of_udp)
    ip = join("4500", h(32, 2), h(e % 65536, 2), "4000", "4011", h((right[0] + e % 2) % 65536, 2), client(), SERVER)
    body = join(ethernet(0x0800), ip, h(1024 + user() % 1000, 2), h(9999, 2), h(12, 2), h(of_udp, 2), h(F.floor(e / 65536) % 65536, 2), h(e % 65536, 2))
    return frames(events, e + 1, body, micros(), dns=False)


def captures_cut(events: DataFrame) -> DataFrame:
    """path, content: ``captures`` whose last record lacks its last 10 bytes."""
    return captures(events).select("path", F.expr("substring(content, 1, length(content) - 10)").alias("content"))


def hot_frames(events: DataFrame) -> DataFrame:
    """Every event a segment of one connection, odd ones from the server."""
    e = event()
    back, flags = e % 2 == 1, F.when(e % 1000 == 0, 2).when(e % 1000 == 1, 18).otherwise(24)
    ends = ip4(F.lit(40), 6, F.when(back, F.lit(SERVER)).otherwise(F.lit("0A000001")), F.when(back, F.lit("0A000001")).otherwise(F.lit(SERVER)))
    ports = tcp(F.when(back, 80).otherwise(5000), F.when(back, 5000).otherwise(80), F.pmod(e * 7919, F.lit(1 << 32)), e * 3, flags, 512)
    return frames(events, e + 1, join(ethernet(0x0800), ends, ports), micros(), dns=False)


def written(files: DataFrame) -> str:
    """A new folder with ``files`` (path, content) and one file that is no capture.

    It lies below ``spark.checkpoint.dir``, a mounted folder or one of a store that Arrow knows; each task writes its
    files there.  Only a one-process session without that setting gets a folder of its own.
    """
    spark = files.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="framelight-")
        spark.conf.set("spark.checkpoint.dir", shared)
    folder = f"{shared.rstrip('/')}/captures-{uuid.uuid4().hex}"
    put(f"{folder}/notes.txt", b"not a capture")

    def write(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                put(f"{folder}/{path}", content.as_buffer())
                yield pa.RecordBatch.from_pydict({"path": [path]})

    files.mapInArrow(write, "path string").count()
    return re.sub("^file:/*", "/", folder)
