"""The pipeline on the smallest tables against brute force, and each stage on awkward rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelight.llm import lang_id, mixing, queries

from .test_operators import AWKWARD, slow_components, slow_grams, slow_kept, slow_language, slow_measure

SF = "/root/testdata/sf0.001"


def slow_stages(spark):
    """Rows kept by the stages before mixing, by plain code."""
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    verdict = slow_kept({r.doc_id: (r.lang, r.source, slow_measure(r.text)) for r in rows}, 100)
    rows = [r for r in rows if verdict[r.doc_id][1]]
    own = slow_language([(r.text, r.lang) for r in rows])
    best = lambda grams: max(sum(g in s for g in grams) for s in own.values()) / max(1, len(grams))
    rows = [r for r in rows if best(slow_grams(r.text)) >= lang_id.LEAST_EVIDENCE]
    rows.sort(key=lambda r: r.doc_id)
    home = slow_components([r.text for r in rows])
    return [r for k, r in enumerate(rows) if home[k][1] == k]


def test_run_against_brute_force(spark):
    import public_tokenizers
    import sentencepiece

    rows = slow_stages(spark)
    kept = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", mixing.domain_of_labels().alias("domain"))
    rate = {r.doc_id: r.rate for r in mixing.mix(kept, labels).collect()}
    chance = {r.doc_id: r.c / 1_000_000 for r in kept.select("doc_id",
        F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text"), F.lit(1_000_000)).alias("c")).collect()}
    times = {k: int(x) + (chance[k] < x - int(x)) for k, x in rate.items()}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter({(r.doc_id, tuple(lib.encode(r.text))): times[r.doc_id] for r in rows if times[r.doc_id]})
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(r.parity and r.round_trip for r in got) and len(rows) > 50 and len(want) > 5
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want


CLASHING = ("row", "c", "m", "p", "rate", "copy", "cell", "kept", "__node", "__gone", "__lang", "root", "home", "n", "shard", "score")


@pytest.mark.parametrize("stage", range(4))
def test_awkward_rows(spark, stage):
    """Nulls in every column, empty and long texts, repeats, ties and clashing names: no stage fails or changes a column."""
    texts = [*AWKWARD, "the same words again and again in a line " * 20, "the same words again and again in a line " * 20]
    rows = [(k if k % 4 else None, t, ["en", "de", None][k % 3], None if k % 5 == 0 else "s", len(t or "")) for k, t in enumerate(texts)]
    rows += rows[:6] + [(None, None, None, None, None)] * 2 + [(3, "another text of an id that repeats", "en", "s", 1)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, columns).withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})
    name, f = corpus_pipeline.STAGES[stage]
    got = f(spark, df, SF)
    assert got.columns == df.columns, name
    found = Counter(map(tuple, got.collect()))
    before = Counter(map(tuple, df.collect()))
    assert set(found) <= set(before)
    if name != "mixing":
        assert all(found[r] <= before[r] for r in found)
    if name == "language ID":  # without a letter, or null
        assert not any(r[1] is None or not any(c.isalpha() for c in r[1]) for r in found)
    none = f(spark, df.limit(0), SF)
    assert none.columns == df.columns and none.count() == 0


def test_encoding_awkward_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "a\nb", 3)], "doc_id bigint, text string, ids int")
    got = corpus_pipeline.sentencepiece(spark, df, SF)
    assert sorted((r.doc_id or 0, len(r.ids), r.parity, r.round_trip) for r in got.collect())[:3] == [(0, 0, True, True), (1, 0, True, True),
        (1, 0, True, True)]
    assert corpus_pipeline.sentencepiece(spark, df.limit(0), SF).count() == 0


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "mixing", "SentencePiece"]
