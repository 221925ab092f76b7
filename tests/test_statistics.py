"""Statistics, merging, names and clocks of captures against plain code, with small bounds so that every way is taken."""

import random
from collections import Counter

import pytest

from framelight import schema as S
from framelight.operators import merge, resolve, statistics
from framelight.operators.tcp import track, track_in_parts
from framelight.plans.packets import packets

from .test_capture import ETH, frames, ip4, plan_of, tcp, udp


@pytest.mark.parametrize("counters", [3, 40, 1000])
def test_heaviest_against_sums(spark, counters):
    rng = random.Random(counters)
    for heavy in (True, False):
        rows = [(f"k{rng.randrange(300)}", rng.randrange(5)) for _ in range(3000)] + [(f"h{k % 4}", 10) for k in range(900 if heavy else 8)] + [(None, 9)]
        rng.shuffle(rows)
        want = Counter()
        for key, weight in rows:
            if key:
                want[key] += weight
        report: dict = {}
        got = statistics.heaviest(spark.createDataFrame(rows, "key string, weight bigint").repartition(5), 4, counters, report).collect()
        assert [(r.key, r.weight) for r in got] == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:4]
        if heavy and counters == 40:  # the second pass is over few of the keys
            assert report["survivors"] < 100 and report["lost"] > 0
    few = spark.createDataFrame([("a", 1), ("b", 2)], "key string, weight bigint")
    assert [r.key for r in statistics.heaviest(few, 5, counters).collect()] == ["b", "a"]
    assert statistics.heaviest(few.where("key = 'c'"), 5, counters).count() == 0


def test_sketches_of_files_merge_within_their_error(spark):
    rows = spark.range(12_000).selectExpr("concat('f', id % 4) as file", "concat('a', id % 3) as source", "concat('p', (id * 7) % (1000 * (1 + id % 3))) as destination",
        "unhex(repeat('00', 60)) as raw")
    exact = {r.address: r for r in statistics.endpoints(rows).collect()}
    sketched = {r.address: r for r in statistics.merged_endpoints(statistics.endpoint_sketches(rows)).collect()}
    assert set(exact) == set(sketched)
    for k in ("a0", "a1", "a2"):
        assert exact[k].asDict() | {"peers": 0} == sketched[k].asDict() | {"peers": 0}
        assert abs(exact[k].peers - sketched[k].peers) <= 0.05 * exact[k].peers


def test_hierarchy_of_frames_without_layers(spark):
    raws = [ip4(6, tcp(1, 2)), ip4(17, udp(1, 2)), ETH + b"\x88\xcc" + b"z" * 20, b"abc", None]
    got = {(r.depth, r.l3, r.l4, r.protocol): (r.frames, r.bytes) for r in statistics.protocol_hierarchy(packets(frames(spark, raws), tracked=False)).collect()}
    assert got[0, None, None, None] == (5, sum(len(r or b"") for r in raws))
    assert got[1, "none", None, None][0] == 3 and got[3, "ip4", "udp", "UDP"] == (1, len(raws[1]))


def segments(rng, n, files=3):
    ends = [("10.0.0.1", 5), ("10.0.0.2", 6), ("10.0.0.3", 5)]
    out = []
    for number in range(1, n + 1):
        (a, p), (b, q) = rng.choice(ends), rng.choice(ends)
        flags = rng.choice([2, 18, 16, 16, 16, 0, 24, None])
        out.append((f"f{rng.randrange(files)}", number, a, b, p, q, rng.randrange(1 << 32), rng.randrange(1 << 32), flags))
    return out


COLUMNS = "file string, number int, source string, destination string, sport bigint, dport bigint, seq bigint, ack bigint, flags bigint"


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_parts_of_connections_give_the_same(spark, size):
    df = spark.createDataFrame(segments(random.Random(size), 900), COLUMNS)
    pick = lambda t: sorted((r.file, r.number, r.rel_seq, r.rel_ack) for r in t.collect())
    assert pick(track_in_parts(df, size)) == pick(track(df))


def test_one_connection_spreads(spark):
    """The windows' exchange is by part too, and what is windowed by connection is sums."""
    df = spark.createDataFrame(segments(random.Random(1), 50), COLUMNS)
    plan = plan_of(track_in_parts(df, 10))
    windows = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert sum("part" in x for x in windows) >= 2 and all("part" in x or "conn_hi" in x for x in windows)


@pytest.mark.parametrize("rows", [7, 100, 10_000])
def test_merged_numbers_have_no_gaps(spark, rows):
    rng = random.Random(rows)
    data = [(f"f{k % 5}", k, rng.choice([None, 5, rng.randrange(90)])) for k in range(400)]
    got = merge.merged(spark.createDataFrame(data, "file string, number int, time_exact bigint"), rows).collect()
    want = sorted(data, key=lambda x: (x[2] is not None, x[2] or 0, x[0], x[1]))
    assert [(r.file, r.number, r.time_exact) for r in sorted(got, key=lambda r: r.merged_number)] == want
    assert sorted(r.merged_number for r in got) == list(range(1, 401))
    assert merge.merged(spark.createDataFrame([], "file string, number int, time_exact bigint")).count() == 0


def test_merging_in_many_ranges_stays_small(spark):
    """Frames are computed twice, and a frame is not held against every range's start."""
    data = [(f"f{k % 3}", k, None if k % 50 == 0 else (k * 7) % 60) for k in range(600)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ddl = "file string, number int, time_exact bigint"
    got = merge.merged(spark.createDataFrame(data, ddl).mapInArrow(count, ddl), 2)
    assert len(plan_of(got)) < 10_000 and "filter(" not in plan_of(got)
    want = sorted(data, key=lambda x: (x[2] is not None, x[2] or 0, x[0], x[1]))
    assert [(r.file, r.number, r.time_exact) for r in sorted(got.collect(), key=lambda r: r.merged_number)] == want
    assert seen.value == 2 * len(data)


def test_difference_counts_duplicates(spark):
    left, right = [b"a", b"a", b"b", b"a", None, b"c"], [b"a", b"c", b"c", b"d"]
    got = merge.difference(frames(spark, left, "l"), frames(spark, right, "r")).collect()
    assert sorted(r.number for r in got) == [2, 3, 4, 5] and set(got[0].asDict()) == set(S.FRAMES.replace(",", "").split()[::2])


@pytest.mark.parametrize("most", [0, 1000])
def test_names_hold_from_their_block_on(spark, most):
    names = [("f", 1, 2, 1, "x", ["n1", "n0"]), ("f", 1, 5, 1, "x", ["n0", "n1"]), ("f", 1, 7, 1, "x", ["n2"]), ("f", 2, 12, 1, "x", ["n3"]), ("g", 1, 1, 1, "x", []),
        ("f", 1, 2, 1, "y", ["m"])]
    table = spark.createDataFrame(names, S.NAMES)
    asked = [("f", 1, k, "x", "y") for k in (1, 3, 6, 8)] + [("f", 2, 11, "y", "x"), ("f", 2, 13, "y", "x"), ("g", 1, 9, "x", "z"), ("f", None, None, "x", "")]
    rows = spark.createDataFrame(asked, "file string, section int, block_ordinal int, source string, destination string")
    got = resolve.with_names(rows, table, most)
    assert most == 0 or "BroadcastHashJoin" in plan_of(got)
    want = [(None, None), ("n0, n1", "m"), ("n0, n1", "m"), ("n2", "m"), (None, None), (None, "n3"), (None, None), (None, None)]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((a + w for a, w in zip(asked, want, strict=True)), key=key)
    assert {r.address: len(r.changes) for r in resolve.name_changes(table.where("file = 'f' and section = 1")).collect()} == {"x": 2, "y": 1}


def test_clocks_of_every_unit(spark):
    clocks = [(0, 6, 0), (1, 0, 5), (2, 9, -3), (3, 12, 0), (4, 30, 0), (5, 128 + 10, 1), (6, 128 + 63, 0), (7, 128 + 70, 0), (8, 128, 0)]
    table = spark.createDataFrame([("f", 1, i, 2, 1, 0, 0, r, o, None, None, "ok") for i, r, o in clocks], S.INTERFACES)
    ticks = 1_700_000_000_123_456_789
    rows = [("f", "pcapng", i + 1, 6, i, 1, ticks >> 32, ticks & 0xFFFFFFFF, 1, 1, b"x", "ok", 0, 0, None, 1, 5) for i, *_ in clocks]
    rows += [("f", "pcapng", 50, 6, 0, 1, 0, 7, 1, 1, b"x", "ok", 0, 0, None, 1, 1), ("f", "pcapng", 51, 3, None, 1, None, None, 1, 1, None, "undecoded", None, None,
        None, 1, 9), ("p", "pcap", 52, None, None, 1, 3, 4, 1, 1, b"x", "ok", 0, 0, None, None, None)]
    got = {r.number: r.time_ns for r in resolve.with_interface_time(spark.createDataFrame(rows, S.PARSED), table).collect()}
    for i, r, o in clocks:
        unit = ticks * 10**9 // (10**r if r < 128 else 2 ** (r - 128)) + o * 10**9
        assert got[i + 1] == (unit if unit < 2**63 else None), (i, r)
    assert got[50] is None and got[51] is None and got[52] == 3_000_004_000
