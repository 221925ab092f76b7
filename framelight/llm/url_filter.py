"""URL filtering: a rule list first, then the ratio of two character models.

One variable-order Markov model is counted over rejected URLs and one over accepted URLs (by default those that
a rule blocks, and all others, of which a rule may yet come to block some; a table of labelled URLs may take
their place): the probability of a character after
the ORDER characters before it mixes the orders ORDER, ..., 1, 0 with Witten-Bell weights, so a context seen
seldom falls back to its shorter suffix.  A URL's score is the log-likelihood difference (rejected minus
accepted) divided by its length; the threshold is calibrated on labelled URLs that took no part in the counts.

Everything is DataFrame expressions.  Contexts are rows over the URLs' own characters, as many as the corpus
has, and tables of them are joined, never broadcast by hint: the planner broadcasts one only below its own size
bound, and AQE splits a join on a context that very many URLs share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: (host suffix and path, block or allow)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Share of held-out accepted URLs that the calibrated threshold may reject.
FALSE_REJECTS = 0.005
#: One in so many labelled URLs calibrates the threshold.
HELD_OUT = 5
#: Characters of the longest context.
ORDER = 5
#: Stands before a URL's first character; scores are kept in ten-thousandths.
_START, _UNIT = "\x01", 10_000
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _LETTERS.upper(), _LETTERS)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), both null where none does.  A rule fits its host and all subdomains, where the path starts with the rule's."""

    def fits(rule: str) -> Column:
        name, _, tail = rule.partition("/")
        return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))

    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    pick = lambda k: reduce(lambda c, r: c.when(fits(r[0]), r[k]), ordered[1:],
        F.when(fits(ordered[0][0]), ordered[0][k])) if ordered else F.lit(None).cast("string")
    return pick(0), pick(1)


def characters(url: Column) -> Column:
    """What the models read: the URL after ``://`` (all of it without one), A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url)
    return F.translate(F.coalesce(rest, F.lit("")), _LETTERS.upper(), _LETTERS)


def steps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, context (ORDER characters), symbol for each character of ``url``."""
    padded = F.concat(F.lit(_START * ORDER), characters(F.col("url"))).alias("p")
    long = rows.select(*keys, padded).where(F.length("p") > ORDER)
    long = long.select(*keys, "p", F.explode(F.sequence(F.lit(1), F.length("p") - ORDER)).alias("i"))
    return long.select(*keys, F.substring("p", F.col("i"), F.lit(ORDER)).alias("context"), F.substring("p", F.col("i") + ORDER, F.lit(1)).alias("symbol"))


def counts(labelled: DataFrame) -> DataFrame:
    """rejected, context, symbol, n over all rows of (url, rejected)."""
    return steps(labelled, ["rejected"]).groupBy("rejected", "context", "symbol").agg(F.count("*").alias("n"))


def _suffix(context: str, order: int) -> Column:
    return F.substring(F.col(context), ORDER - order + 1, order) if order else F.lit("")


def _blend(seen: str, total: str, types: str, lower: str) -> Column:
    """Witten-Bell: (n + types * lower) / (total + types); a context never seen is its shorter suffix."""
    n, total, types = (F.coalesce(F.col(c), F.lit(0)) for c in (seen, total, types))
    return F.when(total > 0, (n + types * F.col(lower)) / (total + types)).otherwise(F.col(lower))


def differences(found: DataFrame, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """context, symbol, diff = ln p(rejected) - ln p(accepted) for each (context, symbol) of ``asked``."""
    alphabet = max(1, asked.select("symbol").distinct().count())
    lower = None
    for order in range(ORDER + 1):
        need = asked.select(_suffix("context", order).alias("c"), "symbol").distinct()
        side = lambda y: F.sum(F.when(F.col("rejected") == y, F.col("n")).otherwise(0))
        seen = found.groupBy(_suffix("context", order).alias("c"), "symbol").agg(side(True).alias("r"), side(False).alias("a"))
        seen = scratch.save(seen, f"seen{order}")
        kinds = lambda c: F.count(F.when(F.col(c) > 0, 1))
        total = seen.groupBy("c").agg(F.sum("r").alias("r_all"), F.sum("a").alias("a_all"), kinds("r").alias("r_types"), kinds("a").alias("a_types"))
        rows = need.join(seen, ["c", "symbol"], "left").join(total, "c", "left")
        if lower is None:
            rows = rows.withColumns({"pr": F.lit(1.0 / alphabet), "pa": F.lit(1.0 / alphabet)})
        else:
            up = lower.select(F.col("c").alias("up"), F.col("symbol").alias("s"), "pr", "pa")
            rows = rows.join(up, (F.substring("c", 2, order) == F.col("up")) & (F.col("symbol") == F.col("s")))
        blended = [_blend(x, f"{x}_all", f"{x}_types", f"p{x}").alias(f"p{x}") for x in ("r", "a")]
        lower = scratch.save(rows.select("c", "symbol", *blended), f"order{order}")
    return lower.select(F.col("c").alias("context"), "symbol", (F.ln("pr") - F.ln("pa")).alias("diff"))


def scored(rows: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """row, score (in ten-thousandths) for each of ``rows`` (row, url) with a character: the mean difference over its characters.

    Only row numbers travel with the characters.
    """
    long = steps(rows, ["row"])
    asked = scratch.save(long.select("context", "symbol").distinct(), "asked")
    known = differences(found, asked, scratch).withColumnsRenamed({"context": "c", "symbol": "s"})
    joined = long.join(known, (F.col("context") == F.col("c")) & (F.col("symbol") == F.col("s")))
    return joined.groupBy("row").agg(F.round(F.sum("diff") / F.count("*") * _UNIT).cast("long").alias("score"))


def calibrated(hist: list[dict], most: float = FALSE_REJECTS) -> int | None:
    """From (rejected, bucket, n): the lowest bucket above which at most ``most`` of the accepted lie, hence most of the rejected.  None if one kind is missing."""
    total = {side: sum(r["n"] for r in hist if r["rejected"] == side) for side in (True, False)}
    if not total[True] or not total[False]:
        return None
    above = dict(total)
    by: dict[int, dict] = {}
    for r in hist:
        by.setdefault(r["bucket"], {True: 0, False: 0})[r["rejected"]] += r["n"]
    for bucket in sorted(by):
        for side in (True, False):
            above[side] -= by[bucket][side]
        if above[False] / total[False] <= most:
            return bucket
    return None


def bucket_of(score: Column) -> Column:
    """Thousandths, at most 30 from 0 either way."""
    return F.floor(F.least(F.greatest(score, F.lit(-30 * _UNIT)), F.lit(30 * _UNIT)) / 10).cast("int")


def held_out(url: Column) -> Column:
    return F.conv(F.substring(F.md5(F.encode(url, "UTF-8")), 1, 4), 16, 10).cast("int") % HELD_OUT == 0


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, most: float = FALSE_REJECTS) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of (page_id, url).

    ``labelled``: url, rejected; without it the URLs with a host count as rejected where a rule blocks them, else
    as accepted.  The rule's verdict stands where a rule fits; else block where the score is over the threshold.  A null or empty URL
    has empty host and path, fits no rule, scores 0 and is allowed.  Without both kinds of labelled URLs, held-out
    ones included, nothing can be learned and the method allows.  Rows are judged one by one: null and repeated
    ids stay, equal URLs get equal verdicts, a score at the threshold is allowed.  An empty table gives no rows;
    other columns are not read.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = host_path(F.col("url"))
    located = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = scratch.save(located.select(F.monotonically_increasing_id().alias("row"), "*", rule.alias("rule"), verdict.alias("ruled")), "rows")
    if labelled is None:
        labelled = rows.where("host != ''").select("url", F.coalesce(F.col("ruled") == "block", F.lit(False)).alias("rejected"))
    labelled = labelled.where("url is not null and rejected is not null").select("url", "rejected")
    found = scratch.save(counts(labelled.where(~held_out(F.col("url")))), "counts")
    # Held-out URLs of a table of their own are scored along with the pages.
    apart = labelled.where(held_out(F.col("url"))).select((-1 - F.monotonically_increasing_id()).alias("row"), "url", "rejected")
    apart = scratch.save(apart, "apart")
    scores = scratch.save(scored(rows.select("row", "url").unionByName(apart.select("row", "url")), found, scratch), "scores")
    hist = apart.join(scores, "row").groupBy("rejected", bucket_of(F.col("score")).alias("bucket")).agg(F.count("*").alias("n")).collect()
    cut = calibrated([r.asDict() for r in hist], most)
    scratch.drop(*(scratch.names - {"rows", "scores"}))
    judged = rows.join(scores, "row", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    own = F.when(bucket_of(F.col("score")) > F.lit(cut), "block").otherwise("allow") if cut is not None else F.lit("allow")
    own = F.when(F.coalesce("url", F.lit("")) == "", "allow").otherwise(own)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), (F.col("score") / _UNIT).alias("score"))
