"""Connections over rotating captures against one capture of all frames, late segments, and idle state."""

import os
import random
import struct

import pytest

from framelight.operators.tcp import track
from framelight.sources import scan
from framelight.streaming.connections import Connection, segments_of, stream_connections

from .test_capture import ip4, model, tcp
from .test_statistics import COLUMNS, segments


def test_rules_against_the_windows():
    rows = [r for r in segments(random.Random(6), 2000, files=4) if r[8] is not None]
    state, got = {}, {}
    for file, number, a, b, p, q, seq, ack, flags in rows:
        ends = (f"{a}|{p}", f"{b}|{q}")
        got[file, number] = state.setdefault((file, *sorted(ends)), Connection()).take(*ends, seq, ack, flags)
    assert got == model([(f, n, a, p, b, q, seq, ack, flags) for f, n, a, b, p, q, seq, ack, flags in rows])


def capture(rows):
    out = [struct.pack("<IHHiIII", scan.PCAP_MAGIC, 2, 4, 0, 0, 65535, 1)]
    for second, sport, dport, flags, seq, ack in rows:
        raw = ip4(6, tcp(sport, dport, flags, seq=seq, ack=ack))
        if sport == 80:  # from the server
            raw = raw[:26] + raw[30:34] + raw[26:30] + raw[34:]
        out.append(struct.pack("<IIII", second, 0, len(raw), len(raw)) + raw)
    return b"".join(out)


def run(spark, folder, out, checkpoint, **options):
    query = stream_connections(spark, folder, files_per_batch=1, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation",
        checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(out)


@pytest.fixture
def rotated(tmp_path):
    """Three files that cut connections, with times of modification that rise, and what they hold in order."""
    rng, rows = random.Random(3), []
    for k in range(90):
        port, back = 1000 + rng.randrange(3), rng.random() < 0.5
        rows.append((1000 + k, 80 if back else port, port if back else 80, rng.choice([2, 18, 16, 16, 24]), rng.randrange(1 << 32), rng.randrange(1 << 32)))
    folder = tmp_path / "captures"
    folder.mkdir()
    for k in range(3):
        path = folder / f"r{k}.pcap"
        path.write_bytes(capture(rows[30 * k : 30 * k + 30]))
        os.utime(path, (1_700_000_000 + 100 * k,) * 2)
    return str(folder), rows


def test_rotating_files_give_the_rows_of_one(spark, tmp_path, rotated):
    folder, rows = rotated
    got = run(spark, folder, str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    server, client = "10.0.0.2", "10.0.0.1"
    flat = [("f", k + 1, server if s == 80 else client, client if s == 80 else server, s, d, seq, ack, f) for k, (_, s, d, f, seq, ack) in enumerate(rows)]
    want = {r.number: (r.rel_seq, r.rel_ack) for r in track(spark.createDataFrame(flat, COLUMNS)).collect()}
    assert len(got) == 90
    assert {30 * int(r.file[-6]) + r.number: (r.rel_seq, r.rel_ack) for r in got} == want
    # Apart, the files would give other rows.
    files = spark.read.format("binaryFile").load(folder)
    alone = segments_of(files).selectExpr("file", "number", "split(src_ep, '[|]')[0] as source", "split(dst_ep, '[|]')[0] as destination",
        "cast(split(src_ep, '[|]')[1] as bigint) as sport", "cast(split(dst_ep, '[|]')[1] as bigint) as dport", "seq", "ack", "flags")
    assert {30 * int(r.file[-6]) + r.number: (r.rel_seq, r.rel_ack) for r in track(alone).collect()} != want


def test_idle_connections_are_forgotten_and_late_segments_dropped(spark, tmp_path):
    folder = tmp_path / "captures"
    folder.mkdir()
    parts = [[(1000, 7, 80, 2, 50, 0)], [(9000, 8, 80, 2, 5, 0)], [(9001, 9, 80, 2, 5, 0)], [(9002, 7, 80, 16, 99, 3), (1001, 8, 80, 16, 6, 0)]]
    for k, rows in enumerate(parts):
        path = folder / f"r{k}.pcap"
        path.write_bytes(capture(rows))
        os.utime(path, (1_700_000_000 + 100 * k,) * 2)
    got = run(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), late="10 seconds", idle=60).collect()
    said = {(r.file[-6], r.number): (r.rel_seq, r.rel_ack) for r in got}
    # The segment after so long begins a connection of its own: its own number is the first, and no server's is known.
    assert said == {("0", 1): (0, -1), ("1", 1): (0, -1), ("2", 1): (0, -1), ("3", 1): (0, 3)}
