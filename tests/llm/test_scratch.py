"""Tables of a run: the shared folder, clean-up, batch sizes that are only lowered."""

import os
from types import SimpleNamespace

import pytest

from framelight.llm import scratch
from framelight.llm.components import components


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(spark)


def test_tables_go(spark):
    run = scratch.Scratch(spark)
    assert run.save(spark.range(5), "a").count() == 5
    folder = run.root.removeprefix("file:")
    assert os.path.isdir(f"{folder}/a") and not [f for f in os.listdir(f"{folder}/a") if f.endswith(".crc")]
    run.save(spark.range(5), "b")
    run.drop("a")
    assert os.listdir(folder) == ["b"]
    run.clear()
    assert not os.path.exists(folder)


def test_batches_are_only_lowered(spark):
    before = spark.conf.get(scratch._BATCH)
    try:
        spark.conf.set(scratch._BATCH, 3 << 20)
        scratch.small_batches(spark, 4 << 20)
        assert spark.conf.get(scratch._BATCH) in (str(3 << 20), f"{3 << 20}b")
        scratch.small_batches(spark, 1 << 20)
        assert spark.conf.get(scratch._BATCH) in (str(1 << 20), f"{1 << 20}b")
    finally:
        spark.conf.set(scratch._BATCH, before)


def test_a_long_chain(spark):
    """Steps go on until every node of a path of 4,096 links has the smallest."""
    links = spark.range(4096).selectExpr("id as a", "id + 1 as b")
    found = components(links, scratch.Scratch(spark))
    assert [tuple(r) for r in found.selectExpr("min(root)", "max(root)", "count(distinct node)").collect()] == [(0, 0, 4097)]
