"""The subpackage's queries, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_chunks, hard_negatives, lang_id, license_scan, mixing, ngram_join, quality, sentencepiece_codec, sharding, token_alignment, token_count, url_filter, vector_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import small_batches

    small_batches(spark)
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.languages(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(_table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as text), parity, round_trip."""
    ids = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    joined = F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(joined).alias("ids_crc32"), "parity", "round_trip")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_notices, licenses (in order of place, comma-separated), best_coverage (0 without a notice)."""
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    names = F.array_join(F.transform("notices", lambda n: n["license"]), ",")
    best = F.coalesce(F.array_max(F.transform("notices", lambda n: n["coverage"])), F.lit(0.0))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), names.alias("licenses"), best.alias("best_coverage"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, p_high, p_low, p_toxic, rate."""
    labelled = _table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of_labels().alias("domain"))
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), labelled)
    return mixed.select("doc_id", "tokens", *[F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(mixing.TARGETS)], "rate")


def op11_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and decoded text, taken before document ids are joined: copies of a text share one row."""
    docs = _table(spark, sf_dir, "documents")
    said = bpe_chunks.encode_texts(docs, _tokenizer("byte_bpe_50k.json"))
    digests = said.select("key", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
    return docs.select("doc_id", bpe_chunks.text_key(F.col("text")).alias("key")).join(digests, "key").drop("key")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_token_counts, op3_language_id, op4_ngram_jaccard_join, op5_sharding, op6_quality_rules,
        op7_exact_top_k, op8_sentencepiece, op9_license_scans, op10_source_mixing, op11_bpe_chunk_reuse,
        op12_hard_negatives,
        op13_cross_tokenizer_alignment)}


_OP7_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


_OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _op6_sql() -> str:
    """The base counts from words and windows, sketches as bucket counts, fences, verdicts."""
    space, least, reach = r"\x20\x09-\x0D", quality.MIN_GROUP, quality.REACH
    rates = lambda more: {k: f"({count} + {more * event}) * {quality.UNIT} // ({size} + {prior})" for k, (count, size, prior, event) in quality.UPPER.items()}
    metrics, sketched = ({**rates(more), "len_c": "word_chars * 100 // greatest(n_words, 1)"} for more in (0, 1))
    long = " UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{k}' AS metric, {v} AS v FROM m" for k, v in sketched.items())
    cuts = ", ".join(f"min(bucket) FILTER (upto * {of} >= docs * {n}) AS {q}" for q, (n, of) in quality.QUANTILES.items())

    def quantiles(keys: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        run = f"""SELECT {by}, bucket, sum(sum(n)) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(sum(n)) OVER (PARTITION BY {by}) AS docs
          FROM h GROUP BY {by}, bucket"""
        return f"(SELECT {by}, max(docs) AS docs, {cuts} FROM ({run}) GROUP BY {by})"

    pick = ", ".join(f"CASE WHEN f.docs >= {least} THEN f.{q} WHEN b.docs >= {least} THEN b.{q} ELSE a.{q} END AS {q}" for q in quality.QUANTILES)
    one = lambda metric, q: f"max({q}) FILTER (metric = '{metric}')"
    fences = [f"{one(k, 'q90')} + ({one(k, 'q90')} - {one(k, 'q50')}) * {quality.RATE_REACH} AS {k}_hi" for k in quality.UPPER]
    low, high = one("len_c", "q25"), one("len_c", "q75")
    fences.append(f"{high} + ({high} - {low}) * {reach} + {quality.LENGTH_SLACK} AS len_c_hi, {low} - ({high} - {low}) * {reach} - "
        f"{quality.LENGTH_SLACK} AS len_c_lo")
    good = " AND ".join([f"coalesce({metrics[k]} <= {k}_hi, true)" for k in (*quality.UPPER, "len_c")] + [f"coalesce({metrics['len_c']} >= len_c_lo, true)"])
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^{space}]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls FROM d),
g AS (SELECT rid, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'g': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]}})) AS u FROM w),
c AS (SELECT rid, u.i AS i, count(*) OVER (PARTITION BY rid, u.g) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
k AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON w.rid = r.rid),
m AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM k),
l AS ({long}),
h AS (SELECT lang, source, metric, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) AS bucket, count(*) AS n
  FROM l WHERE NOT base_failed GROUP BY ALL),
t AS (SELECT f.lang AS tl, f.source AS ts, f.metric, {pick} FROM {quantiles('lang, source')} f
  JOIN {quantiles('lang')} b ON f.lang IS NOT DISTINCT FROM b.lang AND f.metric = b.metric JOIN {quantiles('')} a ON f.metric = a.metric),
z AS (SELECT tl, ts, {', '.join(fences)} FROM t GROUP BY tl, ts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {good} AS kept
FROM m LEFT JOIN z ON lang IS NOT DISTINCT FROM tl AND source IS NOT DISTINCT FROM ts
"""


_OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(a, b) AS (SELECT x, y FROM u UNION SELECT r.a, u.y FROM r JOIN u ON r.b = u.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id
"""


def _op1_sql() -> str:
    """Rules by length, the labelled URLs' counts, Witten-Bell from order 0 up, mean differences, the calibrated bucket."""
    top, upper, lower = url_filter.ORDER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ordered = sorted(url_filter.RULES, key=lambda r: (-len(r[0]), r[0]))

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for r, v in ordered) + " END"
    levels = ""
    for k in range(top + 1):
        suffix = f"substr(context, {top - k + 1}, {k})" if k else "''"
        up = f"JOIN o{k - 1} u ON u.c = substr(q.c, 2, {k}) AND u.symbol = q.symbol" if k else "CROSS JOIN (SELECT 1.0::DOUBLE / count(DISTINCT symbol) AS pr, 1.0::DOUBLE / count(DISTINCT symbol) AS pa FROM f) u"
        blend = lambda x: f"CASE WHEN coalesce(t.{x}_all, 0) > 0 THEN (coalesce(s.{x}, 0) + t.{x}_types * u.p{x}) / (t.{x}_all + t.{x}_types) ELSE u.p{x} END AS p{x}"
        levels += f"""
s{k} AS (SELECT {suffix} AS c, symbol, coalesce(sum(n) FILTER (rejected), 0)::BIGINT AS r, coalesce(sum(n) FILTER (NOT rejected), 0)::BIGINT AS a FROM n GROUP BY ALL),
t{k} AS (SELECT c, sum(r)::BIGINT AS r_all, sum(a)::BIGINT AS a_all, count(*) FILTER (r > 0) AS r_types, count(*) FILTER (a > 0) AS a_types FROM s{k} GROUP BY c),
o{k} AS (SELECT q.c, q.symbol, {blend('r')}, {blend('a')} FROM (SELECT DISTINCT {suffix} AS c, symbol FROM f) q
  LEFT JOIN s{k} s ON s.c = q.c AND s.symbol = q.symbol LEFT JOIN t{k} t ON t.c = q.c {up}),"""
    bucket = f"floor(least(greatest(score, {-30 * url_filter._UNIT}), {30 * url_filter._UNIT}) / 10)::INTEGER"
    return f"""
WITH b AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
  translate(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE coalesce(url, '') END, '{upper}', '{lower}') AS chars FROM pages),
h AS (SELECT rid, page_id, url, chars, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM b),
r AS (SELECT *, {rule} AS rule, {verdict} AS ruled, ('0x' || substr(md5(url), 1, 4))::INTEGER % {url_filter.HELD_OUT} = 0 AS apart,
  CASE WHEN host <> '' THEN coalesce({verdict} = 'block', false) END AS rejected FROM h),
f AS (SELECT rid, rejected, apart, substr(p, i, {top}) AS context, substr(p, i + {top}, 1) AS symbol
  FROM (SELECT *, unnest(range(1, length(p) - {top - 1})) AS i FROM (SELECT *, repeat(chr(1), {top}) || chars AS p FROM r))),
n AS (SELECT rejected, context, symbol, count(*) AS n FROM f WHERE rejected IS NOT NULL AND NOT apart GROUP BY ALL),{levels}
e AS (SELECT rid, round(sum(ln(pr) - ln(pa)) / count(*) * {url_filter._UNIT})::BIGINT AS score FROM f JOIN o{top} o ON o.c = f.context AND o.symbol = f.symbol GROUP BY rid),
y AS (SELECT {bucket} AS bucket, count(*) FILTER (rejected) AS rj, count(*) FILTER (NOT rejected) AS ac FROM r JOIN e ON r.rid = e.rid WHERE rejected IS NOT NULL AND apart GROUP BY 1),
x AS (SELECT bucket, (sum(ac) OVER () - sum(ac) OVER (ORDER BY bucket))::DOUBLE / sum(ac) OVER () AS wrong,
  1 - (sum(rj) OVER () - sum(rj) OVER (ORDER BY bucket))::DOUBLE / sum(rj) OVER () AS missed, sum(ac) OVER () AS acs, sum(rj) OVER () AS rjs FROM y),
z AS (SELECT bucket AS cut FROM x WHERE wrong <= {url_filter.FALSE_REJECTS}::DOUBLE AND acs > 0 AND rjs > 0 ORDER BY bucket LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(url, '') <> '' AND {bucket} > (SELECT cut FROM z) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(score, 0)::DOUBLE / {url_filter._UNIT} AS score FROM r LEFT JOIN e ON r.rid = e.rid
"""


#: The checksum byte by byte; the order (hash, id) cut where the bytes before a record pass a shard's share.
_OP5_SQL = f"""
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hx FROM documents),
r AS (SELECT doc_id, (length(hx) // 2 + 1)::BIGINT AS size, ('0x' || substr(md5(text), 1, 15))::BIGINT AS key,
  xor(list_reduce(list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32 FROM d, t),
w AS (SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total, row_number() OVER o AS rank FROM r WINDOW o AS (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least({sharding.SHARDS} - 1, (before * {sharding.SHARDS}) // total)::INTEGER AS shard FROM w)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": _op1_sql(), "op4_ngram_jaccard_join": _OP4_SQL, "op5_sharding": _OP5_SQL, "op6_quality_rules": _op6_sql(),
        "op7_exact_top_k": _OP7_SQL, "op12_hard_negatives": _OP12_SQL,
    }
