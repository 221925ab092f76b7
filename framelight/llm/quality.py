"""Quality rules with thresholds from mergeable quantile sketches.

Each metric's sketch is a histogram with 32 buckets an octave (exact below 64): counts per bucket
add up, so sketches merge by a sum and partial sums run before the shuffle.  Sketches are kept per
(lang, source); a group of fewer than ``min_group`` documents uses its language's merged sketch and,
if that is small too, the sketch of all.

Symbols, repeated lines and repeated words are rates, ``count / (size + prior)``.  Sketches hold what each text's
rate would be with one event more, which is what its length leaves open: so a group's quantiles say something even
where nine tenths of its texts have none, and one event in a short text is no outlier.  A text's own rate fails above
``q90 + rate reach * (q90 - q50)`` of its group.  Word length fails outside ``q25 - reach * iqr - slack``
to ``q75 + reach * iqr + slack``.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import worker
from .scratch import Scratch, small_batches
from .words import mix, word_hashes

#: metric -> (count, size, prior size, what one event counts: a symbol, a line, a line of ten words twice); rates are in 10,000ths.
UPPER = {"sym": ("n_symbols", "n_words", 100, 1), "dup": ("n_dup_lines", "n_lines", 10, 1), "rep": ("n_repeat_words", "n_words", 100, 20)}
UNIT = 10_000
#: Hundredths of a code point of mean word length.
LENGTH_SLACK = 80
#: Spreads beyond the quantile, for word length and for rates.
REACH, RATE_REACH = 3, 2
MIN_GROUP = 100
MIN_WORDS = 50
#: Texts of more bytes are counted in arrays.
LONG = 4 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = (*COUNTS, "n_lines")
_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in _MEASURED) + ">"


def repeat_words(words: list) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total, end = 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def _measure_long(text: str, data: bytes) -> tuple[int, int, int, int, int, int]:
    """The same with 64-bit hashes for words and lines, in blocks; some 50 bytes a word however long the text."""
    code, _ = word_hashes([data], lower=False)
    repeated = 0
    if len(code) > 3:
        rolling = mix(code[:-2]) + mix(code[1:-1], 1) + mix(code[2:], 2)
        _, window, n = np.unique(rolling, return_inverse=True, return_counts=True)
        many = n[window] > 1
        inside = np.zeros(len(code), bool)
        for k in range(3):
            inside[k : k + len(many)] |= many
        repeated = int(inside.sum())
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen, lines, at = set(), 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        if line.strip():
            lines += 1
            seen.add(hashlib.blake2b(line, digest_size=12).digest())
        at = end + 1
    return len(code), chars, sum(map(text.count, "#*$%&|<>")), lines - len(seen), repeated, lines


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The five counts of one whole text and its lines with a word; a null text has none of anything."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode()
    if len(data) > LONG:
        return _measure_long(text, data)
    words = data.split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines)


def counts(text: Column) -> Column:
    """A struct of the five counts and the lines."""

    @F.arrow_udf(_TYPE)
    def counted(texts: pa.Array) -> pa.Array:
        worker.enter("quality")
        rows = [measure(t) for t in texts.to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in _MEASURED]
        return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], list(_MEASURED))

    return counted(text)


def _ratios(more: int = 0) -> dict[str, Column]:
    """A text's metrics, as they are or with ``more`` events."""
    rate = lambda count, size, prior, event: F.floor((F.col(count) + more * event) * UNIT / (F.col(size) + prior)).cast("long")
    out = {k: rate(*of) for k, of in UPPER.items()}
    return out | {"len_c": F.floor(F.col("word_chars") * 100 / F.greatest(F.col("n_words"), F.lit(1))).cast("long")}


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n over documents that pass the base rules."""
    long = measured.where(~_base_failed()).select("lang", "source", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v"))
        for k, v in _ratios(more=1).items()])))
    shift = "greatest(0, length(bin(v)) - 6)"
    bucket = F.expr(f"cast(shiftleft(shiftright(v, {shift}), {shift}) as bigint)")
    return long.select("lang", "source", "metric", bucket.alias("bucket")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


QUANTILES = {"q25": (1, 4), "q50": (1, 2), "q75": (3, 4), "q90": (9, 10)}


def _quantiles(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, q: number of documents and quantiles of merged sketches, each the first bucket whose running count reaches the share."""
    merged = hist.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    run = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "docs": F.sum("n").over(w)})
    at = [F.min(F.when(F.col("upto") * of >= F.col("docs") * share, F.col("bucket"))).alias(name) for name, (share, of) in QUANTILES.items()]
    return run.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), *at).select(*keys, "metric", F.struct("docs", *QUANTILES).alias("q"))


def thresholds(hist: DataFrame, min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """One row for each (lang, source): an upper fence for each metric, and a lower one for the word length."""
    fine = _quantiles(hist, ["lang", "source"])
    lang = _quantiles(hist, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), F.col("q").alias("by_lang"))
    whole = _quantiles(hist, []).select(F.col("metric").alias("w_metric"), F.col("q").alias("by_all"))
    rows = fine.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
    rows = rows.join(whole, F.col("metric") == F.col("w_metric"))
    pick = F.when(F.col("q.docs") >= min_group, F.col("q")).when(F.col("by_lang.docs") >= min_group, F.col("by_lang")).otherwise(F.col("by_all"))
    names = [*UPPER, "len_c"]
    each = [F.max(F.when(F.col("metric") == m, F.col("q"))).alias(m) for m in names]
    wide = rows.select("lang", "source", "metric", pick.alias("q")).groupBy("lang", "source").agg(*each)
    out = [(F.col(f"{m}.q90") + (F.col(f"{m}.q90") - F.col(f"{m}.q50")) * RATE_REACH).alias(f"{m}_hi") for m in UPPER]
    spread = (F.col("len_c.q75") - F.col("len_c.q25")) * reach + LENGTH_SLACK
    return wide.select("lang", "source", *out, (F.col("len_c.q75") + spread).alias("len_c_hi"), (F.col("len_c.q25") - spread).alias("len_c_lo"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept.  A group without limits (all its documents fail the base rules) has none to keep."""
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    good = ~F.col("base_failed")
    for metric, v in _ratios().items():
        good = good & F.coalesce(v <= F.col(f"{metric}_hi"), F.lit(True))
    good = good & F.coalesce(_ratios()["len_c"] >= F.col("len_c_lo"), F.lit(True))
    return joined.withColumn("base_failed", _base_failed()).withColumn("kept", good)


def quality(docs: DataFrame, min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """doc_id, the five counts, base_failed, kept for every row.

    Null or empty texts count nothing and fail the base rules; null lang or source form groups of their
    own; rows are judged one by one, so repeated rows get equal verdicts, and a value at a fence passes.
    An empty table gives no rows; other columns are not read.
    """
    measured, limits = _measured(docs.select("doc_id", "lang", "source", "text"), False, min_group, reach)
    return judge(measured.select("doc_id", "lang", "source", "c.*"), limits).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that the rules keep; nulls, repeats and ties as in ``quality``.

    Rows are written with their counts once and not joined on ids.
    """
    measured, limits = _measured(docs, True, min_group, reach)
    return judge(measured.select("row", "lang", "source", "c.*"), limits).where("kept").select("row.*")


def _measured(docs: DataFrame, whole: bool, min_group: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id or the whole row, lang, source, c: counts; the groups' limits), written."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    first = F.struct(*docs.columns).alias("row") if whole else F.col("doc_id")
    measured = scratch.save(docs.select(first, "lang", "source", counts(F.col("text")).alias("c")), "measured")
    hist = scratch.save(sketches(measured.select("lang", "source", "c.*")), "sketches")
    limits = scratch.save(thresholds(hist, min_group, reach), "limits")
    scratch.drop("sketches")
    return measured, limits
