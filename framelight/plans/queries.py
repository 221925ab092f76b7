"""One query for each operator group, over frames built from the tables, with the same in DuckDB's SQL.

The SQL computes expected values from the source columns, never from bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelight.operators import fields as fields_
from framelight.operators import statistics
from framelight.operators.checksum import with_checksums
from framelight.operators.fragments import with_whole_datagrams
from framelight.operators.hexdump import hex_dump, hex_text
from framelight.operators.merge import difference, merged
from framelight.operators.resolve import with_interface_time, with_names
from framelight.operators.timebase import with_time
from framelight.plans import fixtures as X
from framelight.plans.packets import diagnostics, frame_details, packet_at, packet_list, packets, tcp_tracking
from framelight.sources.capture import parse_files, read_captures, register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_E = """WITH e AS (
  SELECT event_id, user_id, event_type, event_id + 1 AS n, epoch_us(ts) AS us,
    '10.0.' || ((user_id % 65536) // 256)::VARCHAR || '.' || (user_id % 256)::VARCHAR AS ip, 1024 + user_id % 1000 AS port,
    (event_id * 7919) % 4294967296 AS seq, event_id * 3 AS ack, event_id % 65536 AS win, event_id % 10 = 0 AS syn,
    user_id % (SELECT greatest(8, (count(*) + 49999) // 50000) FROM events) AS fileno
  FROM events)
"""
_MAC = "format('02:00:{{:02x}}:{{:02x}}:{{:02x}}:{{:02x}}', ({0} >> 24) & 255, ({0} >> 16) & 255, ({0} >> 8) & 255, {0} & 255)"


@query(_E + """, t AS (SELECT *, last_value(CASE WHEN rn = 1 OR syn THEN seq END IGNORE NULLS) OVER (PARTITION BY ip, port ORDER BY n ROWS UNBOUNDED PRECEDING) AS isn
  FROM (SELECT *, row_number() OVER (PARTITION BY ip, port ORDER BY n) AS rn FROM e))
SELECT n::INTEGER AS number, printf('%.6f', (us // 1000000)::DOUBLE + 10e-7::DOUBLE * (us % 1000000)::DOUBLE) AS time,
  ip AS source, '192.168.0.10' AS destination,
  'TCP' AS protocol, (event_id % 100)::BIGINT AS length,
  port::VARCHAR || ' -> 80 [' || CASE WHEN syn THEN 'SYN' ELSE 'PSH, ACK' END || '] ' || CASE WHEN syn THEN ' Seq=0'
  ELSE ' Seq=' || ((seq - isn + 4294967296) % 4294967296)::VARCHAR || ' Ack=' || (ack % 4294967296)::VARCHAR END
  || CASE WHEN win > 0 THEN ' Win=' || win::VARCHAR ELSE '' END AS info
FROM t""")
def packet_list_tcp(spark, sf_dir):
    return packet_list(packets(X.tcp_frames(_table(spark, sf_dir, "events"))))


@query(_E + f"SELECT n::INTEGER AS number, {_MAC.format('event_id').replace('{{', '{').replace('}}', '}')} AS dst, "
    f"{_MAC.format('user_id').replace('{{', '{').replace('}}', '}')} AS src, 2048::BIGINT AS type FROM e")
def ethernet_fields(spark, sf_dir):
    p = packets(X.tcp_frames(_table(spark, sf_dir, "events")), tracked=False)
    return p.select("number", "eth.dst", "eth.src", F.col("eth.type").cast("bigint").alias("type"))


@query(_E + "SELECT n::INTEGER AS number, 69::BIGINT AS version_ihl, (40 + event_id % 100)::BIGINT AS total_length, (event_id % 65536)::BIGINT AS id, "
    "64::BIGINT AS flags, (event_id % 256)::BIGINT AS ttl, 6::BIGINT AS protocol, ip AS src, '192.168.0.10' AS dst FROM e")
def ipv4_fields(spark, sf_dir):
    p = packets(X.tcp_frames(_table(spark, sf_dir, "events")), tracked=False)
    return p.select("number", *[F.col(f"ip4.{c}").cast("bigint").alias(c) for c in ("version_ihl", "total_length", "id", "flags", "ttl", "protocol")],
        "ip4.src", "ip4.dst")


@query(_E + "SELECT n::INTEGER AS number, port::BIGINT AS src_port, 80::BIGINT AS dst_port, seq::BIGINT AS seq, (ack % 4294967296)::BIGINT AS ack, "
    "80::BIGINT AS \"offset\", (CASE WHEN syn THEN 2 ELSE 24 END)::BIGINT AS flags, win::BIGINT AS \"window\" FROM e")
def tcp_fields(spark, sf_dir):
    p = packets(X.tcp_frames(_table(spark, sf_dir, "events")), tracked=False)
    return p.select("number", *[F.col(f"tcp.{c}").cast("bigint").alias(c) for c in ("src_port", "dst_port", "seq", "ack", "offset", "flags", "window")])


def _udp(spark, sf_dir, sport, dport, size, data=None):
    events = _table(spark, sf_dir, "events")
    body = X.join(X.ethernet(0x0800), X.ip4(20 + size, 17, X.client(), X.SERVER), X.udp(sport, dport, size), data if data is not None else "")
    return X.frames(events, X.event() + 1, body, X.micros(), dns=False)


@query(_E + "SELECT n::INTEGER AS number, port::BIGINT AS src_port, 9999::BIGINT AS dst_port, (event_id % 300)::BIGINT AS length, 0::BIGINT AS checksum FROM e")
def udp_fields(spark, sf_dir):
    p = packets(_udp(spark, sf_dir, 1024 + X.user() % 1000, 9999, X.event() % 300), tracked=False)
    return p.select("number", *[F.col(f"udp.{c}").cast("bigint").alias(c) for c in ("src_port", "dst_port", "length", "checksum")])


@query(_E + "SELECT n::INTEGER AS number, 'UDP' AS protocol, (event_id % 300)::BIGINT AS length, port::VARCHAR || ' -> 9999 Len=' || CASE WHEN "
    "event_id % 300 < 8 THEN (18446744073709551616::HUGEINT + event_id % 300 - 8)::VARCHAR ELSE (event_id % 300 - 8)::VARCHAR END AS info FROM e")
def udp_info(spark, sf_dir):
    p = packets(_udp(spark, sf_dir, 1024 + X.user() % 1000, 9999, X.event() % 300), tracked=False)
    return p.select("number", "protocol", "length", "info")


_PORTS = (23, 25, 179, 53, 67, 161, 80, 68, 162)
_PROTOS = (1, 6, 17, 58, 99, 6, 17)


@query("""WITH e AS (SELECT event_id, [1,6,17,58,99,6,17][(event_id % 7 + 1)::INT] AS p, [23,25,179,53,67,161,80,68,162][(event_id % 9 + 1)::INT] AS s, [23,25,179,53,67,161,80,68,162][((event_id // 9) % 9 + 1)::INT] AS d FROM events)
SELECT (event_id + 1)::INTEGER AS number, CASE WHEN p = 1 THEN 'ICMP' WHEN p = 58 THEN 'ICMPv6' WHEN p = 99 THEN 'Other'
  WHEN p = 6 THEN CASE WHEN 23 IN (s, d) THEN 'Telnet' WHEN 25 IN (s, d) THEN 'SMTP' WHEN 179 IN (s, d) THEN 'BGP' ELSE 'TCP' END
  ELSE CASE WHEN 53 IN (s, d) THEN 'DNS' WHEN s IN (67, 68) OR d IN (67, 68) THEN 'DHCP' WHEN s IN (161, 162) OR d IN (161, 162) THEN 'SNMP'
  ELSE 'UDP' END END AS protocol FROM e""")
def protocol_dispatch(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), k.cast("int"))
    e = X.event()
    s, d = pick(_PORTS, e % 9), pick(_PORTS, F.floor(e / 9) % 9)
    body = X.join(X.ethernet(0x0800), X.ip4(F.lit(40), pick(_PROTOS, e % 7), X.client(), X.SERVER), X.tcp(s, d))
    return packets(X.frames(events, e + 1, body), tracked=False).select("number", "protocol")


@query("""SELECT (event_id + 1)::INTEGER AS number, (event_id % 256)::BIGINT AS flags, '1024 -> 80 [' || concat_ws(', ', CASE WHEN event_id & 1 > 0 THEN 'FIN' END, CASE WHEN event_id & 2 > 0 THEN 'SYN' END, CASE WHEN event_id & 4 > 0 THEN 'RST' END,
  CASE WHEN event_id & 8 > 0 THEN 'PSH' END, CASE WHEN event_id & 16 > 0 THEN 'ACK' END, CASE WHEN event_id & 32 > 0 THEN 'URG' END) || '] ' AS info
  FROM events""")
def tcp_flags(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    body = X.join(X.ethernet(0x0800), X.ip4(F.lit(40), 6, X.client(), X.SERVER), X.tcp(1024, 80, 0, 0, X.event() % 256))
    return packets(X.frames(events, X.event() + 1, body, dns=False), tracked=False).select("number", F.col("tcp.flags").cast("bigint").alias("flags"), "info")


@query(_E + """, p AS (SELECT *, event_id % 2 = 1 AS back, event_id % 10 = 1 AS synack FROM e),
f AS (SELECT *, back = first_value(back) OVER w AS fwd, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY ip, port
  ORDER BY n ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, synack AND NOT fwd AS answers, NOT fwd AND NOT syn AS cand FROM f),
d AS (SELECT *, sum(cand::INT) OVER w AS cn, last_value(CASE WHEN rn = 1 OR (fwd AND syn) THEN seq END IGNORE NULLS) OVER w AS client
  FROM c WINDOW w AS (PARTITION BY ip, port ORDER BY n ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, coalesce(last_value(CASE WHEN answers OR (cand AND cn = 1) THEN seq END IGNORE NULLS) OVER (PARTITION BY ip, port
  ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS server FROM d)
SELECT n::INTEGER AS number,
  (CASE WHEN syn THEN CASE WHEN fwd THEN 0 END WHEN synack THEN CASE WHEN answers THEN 0 END ELSE (seq - CASE WHEN fwd THEN client
  ELSE server END + 4294967296) % 4294967296 END)::BIGINT AS rel_seq,
  (CASE WHEN syn THEN CASE WHEN fwd THEN -1 END WHEN synack THEN CASE WHEN answers THEN 1 END ELSE (ack - CASE WHEN fwd THEN server
  ELSE client END + 4294967296) % 4294967296 END)::BIGINT AS rel_ack
FROM g""")
def tcp_relative_seq(spark, sf_dir):
    return tcp_tracking(X.flow_frames(_table(spark, sf_dir, "events"))).select("number", "rel_seq", "rel_ack")


def _icmp_body(kind, code):
    e = X.event()
    return X.join(X.h(kind, 1), X.h(code, 1), "0000", X.h(e % 65536, 2), X.h(X.user() % 65536, 2))


_ICMP_SQL = """CASE WHEN k = 8 THEN 'ICMP Echo Request, Identifier=' || (event_id % 65536)::VARCHAR || ', Sequence=' || (user_id % 65536)::VARCHAR
  WHEN k = 0 THEN 'ICMP Echo Reply, Identifier=' || (event_id % 65536)::VARCHAR || ', Sequence=' || (user_id % 65536)::VARCHAR
  WHEN k = 3 THEN 'ICMP Destination Unreachable, Code=' || c::VARCHAR WHEN k = 11 THEN 'ICMP Time Exceeded, Code=' || c::VARCHAR
  ELSE 'ICMP Type=' || k::VARCHAR || ', Code=' || c::VARCHAR END"""


@query(f"WITH e AS (SELECT *, event_id % 13 AS k, user_id % 7 AS c FROM events) SELECT (event_id + 1)::INTEGER AS number, 'ICMP' AS protocol, "
    f"(event_id % 12)::BIGINT AS length, CASE WHEN event_id % 12 < 8 THEN '' ELSE {_ICMP_SQL} END AS info FROM e")
def icmp_info(spark, sf_dir):
    events, e = _table(spark, sf_dir, "events"), X.event()
    body = X.join(X.ethernet(0x0800), X.ip4(20 + e % 12, 1, X.client(), X.SERVER), _icmp_body(e % 13, X.user() % 7))
    return packets(X.frames(events, e + 1, body, dns=False), tracked=False).select("number", "protocol", "length", "info")


def _six(x):
    return X.join("20010DB8" + "00" * 10, X.h(x, 2))


@query(f"WITH e AS (SELECT *, 128 + event_id % 8 AS k, user_id % 7 AS c FROM events) SELECT (event_id + 1)::INTEGER AS number, 'ICMPv6' AS protocol, "
    f"'2001:db8::' || format('{{:x}}', event_id % 65535 + 1) AS source, '2001:db8::' || format('{{:x}}', user_id % 65535 + 1) AS destination, "
        f"8::BIGINT AS length, {_ICMP_SQL} AS info FROM e")
def icmpv6_info(spark, sf_dir):
    events, e = _table(spark, sf_dir, "events"), X.event()
    body = X.join(X.ethernet(0x86DD), X.ip6("60000000", 8, 58, _six(e % 65535 + 1), _six(X.user() % 65535 + 1)), _icmp_body(128 + e % 8, X.user() % 7))
    return packets(X.frames(events, e + 1, body, dns=False), tracked=False).select("number", "protocol", "source", "destination", "length", "info")


@query("""WITH e AS (SELECT *, event_id % 256 AS tc, (event_id * 31) % 1048576 AS fl FROM events), b AS (SELECT *, 96 | (tc >> 4) AS b0, ((tc & 15) << 4) | (fl >> 16) AS b1, (fl >> 8) & 255 AS b2, fl & 255 AS b3 FROM e)
SELECT (event_id + 1)::INTEGER AS number, 'Other' AS protocol, (event_id % 1000)::BIGINT AS length,
  'IPv6 Version: ' || (b0 & 15)::VARCHAR || ', Traffic Class: ' || ((b0 >> 4) | ((b1 & 15) << 4))::VARCHAR || ', Flow Label: ' || ((b1 >> 4) | (b2 << 4) | (b3 << 12))::VARCHAR || ', Hop Limit: 64' AS info FROM b""")
def ipv6_info(spark, sf_dir):
    events, e = _table(spark, sf_dir, "events"), X.event()
    word = X.h(F.lit(6 << 28) + (e % 256) * (1 << 20) + (e * 31) % 1048576, 4)
    body = X.join(X.ethernet(0x86DD), X.ip6(word, e % 1000, 59, _six(e % 65535 + 1), _six(X.user() % 65535 + 1)))
    return packets(X.frames(events, e + 1, body, dns=False), tracked=False).select("number", "protocol", "length", "info")


def _arp(spark, sf_dir, kind):
    rows, k = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    target = F.when(k % 4 == 0, F.lit("000000000000")).when(k % 4 == 1, X.join("0200", X.h(k, 4))).otherwise(F.lit("0200000000FF"))
    body = X.join(X.ethernet(kind), "000108000604", X.h(k % 6, 2), "0200", X.h(k, 4), "0A00", X.h(k % 65536, 2), target, "0A0000FE")
    return packets(X.frames(rows, k + 1, body, dns=False), tracked=False).select("number", "source", "destination", "protocol", "length", "info")


def _arp_sql(name: str) -> str:
    own = _MAC.format("k").replace("{{", "{").replace("}}", "}")
    cast = f"CASE WHEN k % 4 = 0 THEN {'$B' if name == 'ARP' else '$Z'} WHEN k % 4 = 1 THEN {'own' if name == 'ARP' else '$B'} {'' if name == 'ARP' else "WHEN own = '02:00:00:00:00:ff' THEN $B "}ELSE '02:00:00:00:00:ff' END".replace("$B", "'Broadcast'").replace("$Z", "'00:00:00:00:00:00'")
    return f"""WITH c AS (SELECT c_custkey AS k, {own} AS own, '10.0.' || ((c_custkey % 65536) // 256)::VARCHAR || '.' || (c_custkey % 256)::VARCHAR AS ip FROM (SELECT c_custkey, c_custkey AS k FROM customer))
SELECT (k + 1)::INTEGER AS number, own AS source, {cast} AS destination, '{name}' AS protocol, 28::BIGINT AS length,
  CASE k % 6 WHEN 1 THEN 'ARP Request: Who has 10.0.0.254? Tell ' || ip WHEN 2 THEN 'ARP Reply: ' || ip || ' is at ' || own
  WHEN 3 THEN 'ARP Announce: My IP is associated with MAC ' || own ELSE 'ARP Unknown operation' END AS info FROM c"""


@query(_arp_sql("ARP"))
def arp_info(spark, sf_dir):
    return _arp(spark, sf_dir, 0x0806)


@query(_arp_sql("RARP"))
def rarp_info(spark, sf_dir):
    return _arp(spark, sf_dir, 0x8035)


def _dns(spark, sf_dir, answer: bool):
    pages, k = _table(spark, sf_dir, "pages"), F.col("page_id")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    kind = F.when(k % 3 == 0, 1).when(k % 3 == 1, 28).otherwise(15)
    name = X.dns_name(host)
    more = X.join("C00C00010001", "0000003C0004", "0A00", X.h(k % 65536, 2), "C00C001C0001", "0000003C0010", _six(k % 65535 + 1), "C00C00060001",
        "0000003C0002", "C00C") if answer else F.lit("")
    message = X.join(X.h(k % 65536, 2), "8180" if answer else "0100", "0001", "0003" if answer else "0000", "00000000", name, X.h(kind, 2), "0001", more)
    size = 8 + F.length(message) / 2
    body = X.join(X.ethernet(0x0800), X.ip4(20 + size, 17, "0A000001", X.SERVER), X.udp(53 if answer else 5353, 5353 if answer else 53, size), message)
    return packets(X.frames(pages.where("url is not null"), k + 1, body), tracked=False).select("number", "protocol", "info")


_DNS = (
    "WITH p AS (SELECT page_id AS k, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages WHERE url IS NOT NULL) SELECT (k + 1)::INTEGER AS "
    "number, 'DNS' AS protocol, "
)


@query(_DNS + "'Standard query 0x' || format('{:x}', k % 65536) || CASE k % 3 WHEN 0 THEN ' A ' WHEN 1 THEN ' AAAA ' ELSE ' 15 ' END || host AS info FROM p")
def dns_query_info(spark, sf_dir):
    return _dns(spark, sf_dir, False)


@query(_DNS + "'Standard query response 0x' || format('{:x}', k % 65536) || CASE k % 3 WHEN 0 THEN ' A ' WHEN 1 THEN ' AAAA ' ELSE ' 15 ' END || host "
    "|| ' ' || host || ' A 10.0.' || ((k % 65536) // 256)::VARCHAR || '.' || (k % 256)::VARCHAR || ' ' || host || ' AAAA 2001:db8::' || "
        "format('{:x}', k % 65535 + 1) || ' ' || host || ' SOA' AS info FROM p")
def dns_answer_info(spark, sf_dir):
    return _dns(spark, sf_dir, True)


@query("""SELECT (event_id + 1)::INTEGER AS number, 'DHCP' AS protocol, 'DHCP ' || CASE event_id % 3 WHEN 1 THEN 'Request' WHEN 2 THEN 'Reply' ELSE '' END || ', XID: 0x' || format('{:x}', event_id * 65537) || ', Client IP: 0.0.0.0, Your IP: 10.0.' || ((user_id % 65536) // 256)::VARCHAR || '.' || (user_id % 256)::VARCHAR
  || ', Server IP: 192.168.0.10, Gateway IP: 0.0.0.0, Client MAC: ' || """ + _MAC.format("user_id").replace("{{", "{").replace("}}",
      "}") + " AS info FROM events")
def dhcp_info(spark, sf_dir):
    e = X.event()
    data = X.join(X.h(e % 3, 1), "010600", X.h(e * 65537, 4), "00000000", "00000000", X.client(), X.SERVER, "00000000", "0200", X.h(X.user(), 4), "00" * 202)
    return packets(_udp(spark, sf_dir, 68, 67, F.lit(244), data), tracked=False).select("number", "protocol", "info")


@query("SELECT (event_id + 1)::INTEGER AS number, 'SNMP' AS protocol, (8 + event_id % 500)::BIGINT AS length, 'SNMP message (length: ' || (event_id % "
    "500)::VARCHAR || ')' AS info FROM events")
def snmp_info(spark, sf_dir):
    return packets(_udp(spark, sf_dir, 40000, 161, 8 + X.event() % 500), tracked=False).select("number", "protocol", "length", "info")


_FIFTY = "(SELECT coalesce(string_agg(chr(('0x' || substr(hx, 2 * i + 1, 2))::INT), '' ORDER BY i), '') FROM range(least(50, length(hx) // 2)) r(i))"
#: Segments of whole texts: number, file, hx.
_TEXT = f"""WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
k AS (SELECT *, unnest(range(greatest(1, (length(hx) // 2 + {X.SEGMENT - 1}) // {X.SEGMENT}))) AS part FROM w),
d AS (SELECT doc_id, part, 'segment' || part::VARCHAR AS file, substr(hx, part * {2 * X.SEGMENT} + 1, {2 * X.SEGMENT}) AS hx FROM k)
"""


@query(_TEXT + f"""SELECT (doc_id + 1)::INTEGER AS number, file || ' ' || (doc_id + 1)::VARCHAR AS file, 'Telnet' AS protocol, (length(hx) // 2)::BIGINT AS length,
  '40000 -> 23 [PSH, ACK]  Seq=0 Ack=1[ Telnet data: ' || {_FIFTY} || '... ]' AS info FROM d""")
def telnet_info(spark, sf_dir):
    # Each frame is a file of its own here, hence the first packet of its connection.
    frames = X.text_frames(_table(spark, sf_dir, "documents"), 23).withColumn("file", F.concat_ws(" ", "file", F.col("number").cast("string")))
    return packets(frames).select("number", "file", "protocol", "length", "info")


@query(_TEXT + f"""SELECT (doc_id + 1)::INTEGER AS number, file, 'SMTP' AS protocol, (length(hx) // 2)::BIGINT AS length,
  'SMTP data: ' || {_FIFTY} || '...' AS info FROM d""")
def smtp_info(spark, sf_dir):
    return packets(X.text_frames(_table(spark, sf_dir, "documents"), 25), tracked=False).select("number", "file", "protocol", "length", "info")


@query("SELECT (event_id + 1)::INTEGER AS number, 'BGP' AS protocol, '179 -> 5000 [PSH, ACK]  [ BGP: ' || CASE event_id % 6 WHEN 1 THEN 'OPEN' WHEN 2 "
    "THEN 'UPDATE' WHEN 3 THEN 'NOTIFICATION' WHEN 4 THEN 'KEEPALIVE' ELSE 'Unknown' END || ' ]' AS info FROM events")
def bgp_info(spark, sf_dir):
    events, e = _table(spark, sf_dir, "events"), X.event()
    body = X.join(X.ethernet(0x0800), X.ip4(F.lit(59), 6, X.client(), X.SERVER), X.tcp(179, 5000), "FF" * 16, "0013", X.h(e % 6, 1))
    return packets(X.frames(events, e + 1, body, dns=False), tracked=False).select("number", "protocol", "info")


@query(_E + "SELECT n::INTEGER AS number, printf('%.6f', (us // 1000000)::DOUBLE + 10e-7::DOUBLE * (us % 1000000)::DOUBLE) AS time, us AS time_exact FROM e")
def pcap_time(spark, sf_dir):
    return with_time(X.tcp_frames(_table(spark, sf_dir, "events"))).select("number", F.format_string("%.6f", "time").alias("time"), "time_exact")


@query("""WITH e AS (SELECT event_id + 1 AS n, user_id % 8 AS f, floor((epoch_us(ts) * 1000 + event_id % 1000)::DOUBLE * 0.001::DOUBLE)::BIGINT AS v FROM events),
w AS (SELECT *, v // 1000000 AS s, v % 1000000 AS u FROM e),
a AS (SELECT *, coalesce(first_value(nullif(s, 0) IGNORE NULLS) OVER w, 0) AS s0, coalesce(first_value(nullif(u, 0) IGNORE NULLS) OVER w, 0) AS u0
  FROM w WINDOW w AS (PARTITION BY f ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT n::INTEGER AS number, printf('%.6f', (s::DOUBLE + 10e-7::DOUBLE * u::DOUBLE) - (s0::DOUBLE + 10e-7::DOUBLE * u0::DOUBLE)) AS time FROM a""")
def pcapng_time(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    ns = X.micros() * 1000 + X.event() % 1000
    f = X.tcp_frames(events).join(events.select((X.event() + 1).cast("int").alias("number"), ns.alias("ns"),
        F.pmod(X.user(), F.lit(8)).cast("string").alias("f")), "number")
    f = f.drop("zero_sec", "zero_us").withColumns({"format": F.lit("pcapng"), "file": F.col("f"), "ts_hi": F.shiftright("ns", 32),
        "ts_lo": F.pmod("ns", F.lit(1 << 32))})
    return with_time(f).select("number", F.format_string("%.6f", "time").alias("time"))


_SWAP2 = "(({0}) % 256 * 256 + ({0}) // 256)"
_DETAIL = _E + """, f AS (SELECT * FROM (VALUES ('L2', 0, 'Destination MAC', 0, 5), ('L2', 1, 'Source MAC', 6, 11), ('L2', 2, 'Type', 12, 13),
 ('L3', 0, 'Version', 14, 14), ('L3', 1, 'IHL', 14, 14), ('L3', 2, 'Type of Service', 15, 15), ('L3', 3, 'Total Length', 16, 17),
  ('L3', 4, 'Identification', 18, 19), ('L3', 5, 'Flags', 20, 20), ('L3', 6, 'Fragment Offset', 21, 21), ('L3', 7, 'TTL', 22, 22),
  ('L3', 8, 'Protocol', 23, 23), ('L3', 9, 'Header Checksum', 24, 25), ('L3', 10, 'Source IP', 26, 29), ('L3', 11, 'Destination IP', 30, 33),
 ('L4', 0, 'Source Port', 34, 35), ('L4', 1, 'Destination Port', 36, 37), ('L4', 2, 'Sequence Number', 38, 41), ('L4', 3, 'Acknowledgement Number', 42, 45),
  ('L4', 4, 'Data Offset', 46, 46), ('L4', 5, 'Flags', 47, 47), ('L4', 6, 'Window Size', 48, 49), ('L4', 7, 'Checksum', 50, 51),
  ('L4', 8, 'Urgent Pointer', 52, 53)) t(layer, ord, label, lo, hi))
"""


def _tcp(spark, sf_dir):
    return packets(X.tcp_frames(_table(spark, sf_dir, "events")), tracked=False)


_VALUES = f"""CASE layer || label WHEN 'L2Destination MAC' THEN {_MAC.format('event_id').replace('{{', '{').replace('}}', '}')} WHEN 'L2Source MAC' THEN {_MAC.format('user_id').replace('{{', '{').replace('}}', '}')} WHEN 'L2Type' THEN '8'
 WHEN 'L3Version' THEN '4' WHEN 'L3IHL' THEN '5' WHEN 'L3Type of Service' THEN '0' WHEN 'L3Total Length' THEN {_SWAP2.format('40 + event_id % 100')}::VARCHAR
  WHEN 'L3Identification' THEN {_SWAP2.format('event_id % 65536')}::VARCHAR WHEN 'L3Flags' THEN '64' WHEN 'L3Fragment Offset' THEN '0'
 WHEN 'L3TTL' THEN (event_id % 256)::VARCHAR WHEN 'L3Protocol' THEN '6' WHEN 'L3Header Checksum' THEN '0' WHEN 'L3Source IP' THEN ip
  WHEN 'L3Destination IP' THEN '192.168.0.10'
 WHEN 'L4Source Port' THEN {_SWAP2.format('port')}::VARCHAR WHEN 'L4Destination Port' THEN '20480'
  WHEN 'L4Sequence Number' THEN ((seq % 256) * 16777216 + ((seq >> 8) % 256) * 65536 + ((seq >> 16) % 256) * 256 + (seq >> 24))::VARCHAR
 WHEN 'L4Acknowledgement Number' THEN ((ack % 256) * 16777216 + ((ack >> 8) % 256) * 65536 + ((ack >> 16) % 256) * 256 + (ack >> 24))::VARCHAR
  WHEN 'L4Data Offset' THEN '80' WHEN 'L4Flags' THEN CASE WHEN syn THEN '2' ELSE '24' END WHEN 'L4Window Size' THEN {_SWAP2.format('win')}::VARCHAR
  ELSE '0' END"""


@query(_DETAIL + f"SELECT n::INTEGER AS number, layer, ord::INTEGER AS ord, label, lo::INTEGER AS lo, hi::INTEGER AS hi, {_VALUES} AS value FROM e, f")
def packet_detail(spark, sf_dir):
    return fields_.packet_fields(_tcp(spark, sf_dir)).select("number", "layer", "ord", "label", "lo", "hi", "value")


def _details(rows: str, cte: str) -> str:
    """The SQL of a detail query: (layer, ord, label, lo, hi, value as SQL) for each field of each row of ``e``."""
    return f"{cte} SELECT (k + 1)::INTEGER AS number, u.* FROM e, LATERAL (VALUES {rows}) u(layer, ord, label, lo, hi, value)"


def _shown(layer: str, base: int, fields: list, values: dict[str, str]) -> str:
    return ", ".join(f"('{layer}', {k}, '{label}', {base + lo}, {base + hi}, "
        f"{values.get(label, 'NULL')}::VARCHAR)" for k, (label, lo, hi, _) in enumerate(fields))


_L2 = {"Destination MAC": "'02:00:00:00:00:01'", "Source MAC": "'02:00:00:00:00:02'"}
_V6 = {
    "Version": "0", "Traffic Class": "6", "Flow Label": "0", "Payload Length": _SWAP2.format("8 + k % 300"), "Next Header": "17", "Hop Limit": "64",
    "Source IP": "'2001:db8::' || format('{:x}', k % 65535 + 1)", "Destination IP": "'2001:db8::' || format('{:x}', v % 65535 + 1)",
}
_UDP = {"Source Port": _SWAP2.format("1024 + v % 1000"), "Destination Port": "3879", "Length": _SWAP2.format("8 + k % 300"), "Checksum": "0"}
_KV = "WITH e AS (SELECT event_id AS k, user_id AS v FROM events)"


@query(_details(f"{_shown('L2', 0, fields_.ETHERNET, _L2 | {'Type': '56710'})}, {_shown('L3', 14, fields_.IPV6, _V6)}, "
    f"{_shown('L4', 54, fields_.UDP, _UDP)}", _KV))
def detail_ipv6_udp(spark, sf_dir):
    events, e = _table(spark, sf_dir, "events"), X.event()
    body = X.join(X.ethernet(0x86DD), X.ip6("60000000", 8 + e % 300, 17, _six(e % 65535 + 1), _six(X.user() % 65535 + 1)),
        X.udp(1024 + X.user() % 1000, 9999, 8 + e % 300))
    p = packets(X.frames(events, e + 1, body, dns=False), tracked=False)
    return fields_.packet_fields(p).select("number", "layer", "ord", "label", "lo", "hi", "value")


@query(_details(f"{_shown('L2', 0, fields_.ETHERNET, _L2 | {'Type': '1544'})}, {_shown('L3', 14, fields_.ARP, {})}, "
    f"{_shown('L4', 42, fields_.ICMP, {})}", "WITH e AS (SELECT c_custkey AS k FROM customer)"))
def detail_arp(spark, sf_dir):
    rows, k = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    body = X.join(X.ethernet(0x0806), "000108000604", "0001", "0200", X.h(k, 4), "0A000001", "000000000000", "0A0000FE")
    p = packets(X.frames(rows, k + 1, body, dns=False), tracked=False)
    return fields_.packet_fields(p).select("number", "layer", "ord", "label", "lo", "hi", "value")


_V4 = {
    "Version": "4", "IHL": "5", "Type of Service": "0", "Total Length": "7168", "Identification": "256", "Flags": "64", "Fragment Offset": "0",
        "TTL": "64", "Protocol": "1",
    "Header Checksum": "0", "Source IP": "'10.0.' || ((v % 65536) // 256)::VARCHAR || '.' || (v % 256)::VARCHAR", "Destination IP": "'192.168.0.10'",
}


@query(_details(f"{_shown('L2', 0, fields_.ETHERNET, _L2 | {'Type': '8'})}, {_shown('L3', 14, fields_.IPV4, _V4)}, {_shown('L4', 34, fields_.ICMP, {})}", _KV))
def detail_icmp(spark, sf_dir):
    events, e = _table(spark, sf_dir, "events"), X.event()
    body = X.join(X.ethernet(0x0800), X.ip4(F.lit(28), 1, X.client(), X.SERVER), _icmp_body(e % 13, X.user() % 7))
    p = packets(X.frames(events, e + 1, body, dns=False), tracked=False)
    return fields_.packet_fields(p).select("number", "layer", "ord", "label", "lo", "hi", "value")


_PACKET = 42


@query(ORACLE["packet_list_tcp"] + f" WHERE n = {_PACKET}")
def packet_lookup(spark, sf_dir):
    """One frame by file and number (a report on a single packet is the feature)."""
    return packet_list(packet_at(X.tcp_frames(_table(spark, sf_dir, "events")), "mem", _PACKET))


@query(_DETAIL + "SELECT n::INTEGER AS number, (event_id % 54)::INTEGER AS byte, layer, ord::INTEGER AS ord, label FROM e JOIN f ON event_id % 54 "
    "BETWEEN lo AND hi")
def byte_to_field(spark, sf_dir):
    p = _tcp(spark, sf_dir)
    chosen = p.select("file", "number", ((F.col("number") - 1) % 54).cast("int").alias("byte"))
    return fields_.byte_to_fields(p, chosen).select("number", "byte", "layer", "ord", "label")


@query(_DETAIL + "SELECT n::INTEGER AS number, layer, lo::INTEGER AS lo, hi::INTEGER AS hi FROM e, f WHERE label = 'Flags'")
def field_to_bytes(spark, sf_dir):
    return fields_.field_to_bytes(_tcp(spark, sf_dir), "Flags").select("number", "layer", "lo", "hi")


@query(_DETAIL + "SELECT n::INTEGER AS number, label, lo::INTEGER AS lo, hi::INTEGER AS hi FROM e, f WHERE lo = 14")
def same_start(spark, sf_dir):
    return fields_.same_start(_tcp(spark, sf_dir), "Version").select("number", "label", "lo", "hi")


@query(_TEXT + "SELECT (doc_id + 1)::INTEGER AS number, file, 54::INTEGER AS lo, (53 + length(hx) // 2)::INTEGER AS hi FROM d WHERE length(hx) > 0")
def payload_range(spark, sf_dir):
    p = packets(X.text_frames(_table(spark, sf_dir, "documents"), 25), tracked=False)
    return fields_.payload_range(p).select("number", "file", "lo", "hi")


@query("SELECT (event_id + 1)::INTEGER AS number, 'Frame Number: ' || (event_id + 1)::VARCHAR AS frame_line, 'Packet Info: SNMP message (length: ' || "
    "(event_id % 500)::VARCHAR || ')' AS info_line FROM events")
def frame_lines(spark, sf_dir):
    return frame_details(packets(_udp(spark, sf_dir, 40000, 161, 8 + X.event() % 500), tracked=False)).select("number", "frame_line", "info_line")


_HEX = _TEXT + f""", r AS (SELECT doc_id + 1 AS n, file, '0200000000010200000000020800' || '4500' || format('{{:04X}}', 40 + length(hx) // 2) || '000140004006' || '0000'
  || '0A000001' || 'C0A8000A' || '9C400019' || format('{{:08X}}', 1 + part * {X.SEGMENT}) || '00000001' || '5018' || '0000' || '00000000' || hx AS raw FROM d),
l AS (SELECT n, file, unnest(range((length(raw) // 2 - 1) // 16 + 1)) AS line, raw FROM r), p AS (SELECT n, file, line, substr(raw, line * 32 + 1, 32) AS part
  FROM l),
q AS (SELECT *, regexp_replace(decode_ascii, '[^ -~]', '.', 'g') AS ascii FROM
  (SELECT *, array_to_string(list_transform(range(length(part) // 2), lambda i: CASE
  WHEN ('0x' || substr(part, 2 * i + 1, 2))::INT BETWEEN 32 AND 126 THEN chr(('0x' || substr(part, 2 * i + 1, 2))::INT) ELSE '.' END), '') AS decode_ascii
  FROM p))
"""


@query(_HEX + """SELECT n::INTEGER AS number, file, line::INTEGER AS line, format('{:08X}: ', line * 16) AS address,
  rtrim(regexp_replace(part, '(..)', '\\1 ', 'g')) AS bytes, ascii FROM q""")
def hex_dump_lines(spark, sf_dir):
    return hex_dump(X.text_frames(_table(spark, sf_dir, "documents"), 25)).select("number", "file", "line", "address", "bytes", "ascii")


@query(_HEX + """SELECT n::INTEGER AS number, file, string_agg(rpad(regexp_replace(lower(part), '(..)', '\\1 ', 'g'), 48, ' ') || chr(10), '' ORDER BY line) AS hex,
  string_agg(ascii || chr(10), '' ORDER BY line) AS text FROM q GROUP BY n, file""")
def hex_texts(spark, sf_dir):
    return hex_text(X.text_frames(_table(spark, sf_dir, "documents"), 25)).select("number", "file", "hex", "text")


@query("""SELECT (event_id + 1)::INTEGER AS number, (event_id % 3)::INTEGER AS op, 1::INTEGER AS htype, 6::INTEGER AS hlen, 0::INTEGER AS hops, (event_id * 65537)::BIGINT AS xid, 7::BIGINT AS secs, 32768::BIGINT AS flags,
  '0.0.0.0' AS ciaddr, '10.0.' || ((user_id % 65536) // 256)::VARCHAR || '.' || (user_id % 256)::VARCHAR AS yiaddr, '192.168.0.10' AS siaddr, '10.0.0.254' AS giaddr,
  '0200' || format('{:08X}', user_id) || repeat('00', 10) AS chaddr, repeat('41', 64) AS sname, repeat('42', 128) AS file FROM events""")
def dhcp_header(spark, sf_dir):
    e = X.event()
    data = X.join(X.h(e % 3, 1), "010600", X.h(e * 65537, 4), "0007", "8000", "00000000", X.client(), X.SERVER, "0A0000FE", "0200", X.h(X.user(), 4),
        "00" * 10, "41" * 64, "42" * 128)
    p = packets(_udp(spark, sf_dir, 68, 67, F.lit(244), data), tracked=False).select("number", "dhcp.*")
    wide = lambda c: F.col(c).cast("bigint").alias(c)
    small = lambda c: F.col(c).cast("int").alias(c)
    return p.select("number", *map(small, ("op", "htype", "hlen", "hops")), *map(wide, ("xid", "secs", "flags")), "ciaddr", "yiaddr", "siaddr",
        "giaddr", *[F.hex(c).alias(c) for c in ("chaddr", "sname", "file")])


@query(_E + """SELECT 'cap' || fileno::VARCHAR || '.pcap' AS file, row_number() OVER (PARTITION BY fileno ORDER BY n)::INTEGER AS number,
  (us // 1000000)::BIGINT AS ts_hi, (us % 1000000)::BIGINT AS ts_lo, 54::BIGINT AS cap_len, 'ok' AS status FROM e""")
def capture_scan_pcap(spark, sf_dir):
    return parse_files(X.captures(_table(spark, sf_dir, "events"))).select("file", "number", "ts_hi", "ts_lo", "cap_len", "status")


@query(_E + """SELECT 'cap' || fileno::VARCHAR || '.pcapng' AS file, row_number() OVER (PARTITION BY fileno ORDER BY n)::INTEGER AS number,
  ((us * 1000) >> 32)::BIGINT AS ts_hi, ((us * 1000) % 4294967296)::BIGINT AS ts_lo, 54::BIGINT AS cap_len, 1::INTEGER AS link_type, 'ok' AS status FROM e""")
def capture_scan_pcapng(spark, sf_dir):
    return parse_files(X.captures_ng(_table(spark, sf_dir, "events"))).select("file", "number", "ts_hi", "ts_lo", "cap_len", "link_type", "status")


@query(_E + "SELECT DISTINCT 'cap' || fileno::VARCHAR || '.pcapng' AS file, 2::INTEGER AS block_ordinal, 1::INTEGER AS link_type, 262144::BIGINT AS "
    "snap_len FROM e")
def capture_interfaces(spark, sf_dir):
    return parse_files(X.captures_ng(_table(spark, sf_dir, "events")), "interfaces").select("file", "block_ordinal", "link_type", "snap_len")


#: All kinds of blocks, by event; frames are the packet blocks.
_MIXED = _E + """, b AS (SELECT event_id AS e, user_id AS u, event_id % 7 AS kind, 'mixed' || fileno::VARCHAR || '.pcapng' AS file,
  2 + row_number() OVER (PARTITION BY fileno ORDER BY event_id) AS ordinal FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY e) AS n FROM b WHERE kind IN (0, 1, 2, 5))
"""


def _mixed(spark, sf_dir, table):
    return parse_files(X.captures_mixed(_table(spark, sf_dir, "events")), table)


@query(_MIXED + """SELECT file, n::INTEGER AS number, (CASE kind WHEN 2 THEN 3 ELSE 6 END)::BIGINT AS block_type, CASE kind WHEN 2 THEN 'undecoded' WHEN 5 THEN 'length_mismatch' ELSE 'ok' END AS status,
  CASE WHEN kind < 2 THEN e % 1000 END::BIGINT AS ts_hi, CASE WHEN kind < 2 THEN e END::BIGINT AS ts_lo, CASE WHEN kind <> 5 THEN 4 END::BIGINT AS orig_len,
  CASE WHEN kind < 2 THEN format('{:08X}', e) END AS raw FROM f""")
def capture_packet_blocks(spark, sf_dir):
    """Enhanced and simple packets, and packets whose lengths disagree."""
    return _mixed(spark, sf_dir, "frames").select("file", "number", "block_type", "status", "ts_hi", "ts_lo", "orig_len", F.hex("raw").alias("raw"))


@query(_MIXED + """SELECT file, ordinal::INTEGER AS block_ordinal, (CASE kind WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 2989 WHEN 6 THEN 4 ELSE 6 END)::BIGINT AS block_type,
  (CASE kind WHEN 2 THEN 20 WHEN 3 THEN 24 WHEN 4 THEN 16 WHEN 6 THEN 28 ELSE 36 END)::BIGINT AS total_length, CASE kind WHEN 5 THEN 'length_mismatch'
  ELSE 'ok' END AS status FROM b
UNION ALL SELECT DISTINCT file, 1, 168627466, 28, 'ok' FROM b UNION ALL SELECT DISTINCT file, 2, 1, 20, 'ok' FROM b""")
def capture_blocks(spark, sf_dir):
    """Sections, interfaces, packets, statistics, names and unknown blocks."""
    return _mixed(spark, sf_dir, "blocks").select("file", "block_ordinal", "block_type", "total_length", "status")


@query(_MIXED + "SELECT file, ordinal::INTEGER AS block_ordinal, (e % 3)::BIGINT AS interface_id, 1::BIGINT AS ts_hi, e::BIGINT AS ts_lo, 'ok' AS "
    "status FROM b WHERE kind = 3")
def capture_statistics(spark, sf_dir):
    return _mixed(spark, sf_dir, "statistics").select("file", "block_ordinal", "interface_id", "ts_hi", "ts_lo", "status")


@query(_MIXED + """SELECT file,
  ordinal::INTEGER AS block_ordinal, 1::INTEGER AS record_type, '10.0.' || ((u % 65536) // 256)::VARCHAR || '.' || (u % 256)::VARCHAR AS address, 'n' AS names
  FROM b WHERE kind = 6""")
def capture_names(spark, sf_dir):
    return _mixed(spark, sf_dir, "names").select("file", "block_ordinal", "record_type", "address", F.array_join("names", ",").alias("names"))


_FILED = _E + """, c AS (SELECT *, 'cap' || fileno::VARCHAR AS f, row_number() OVER (PARTITION BY fileno ORDER BY n) AS k, row_number() OVER (PARTITION BY fileno ORDER BY n DESC) AS last FROM e)
"""
_LISTED = "SELECT {source} AS source, f || '.{kind}' AS file, k::INTEGER AS number, 54::BIGINT AS cap_len, 'ok' AS status, ip AS address FROM c"


@query(_FILED + "SELECT f || '.pcap' AS file, k::INTEGER AS number, 54::BIGINT AS cap_len, 54::BIGINT AS size, CASE WHEN last = 1 THEN 'truncated' "
    "ELSE 'ok' END AS status, CASE WHEN last = 1 THEN 20 ELSE 0 END::INTEGER AS zeros FROM c")
def capture_cut_tail(spark, sf_dir):
    """A record that the file's end cuts off is filled up with zeros."""
    found = parse_files(X.captures_cut(_table(spark, sf_dir, "events")))
    # The window, checksum and urgent fields of these frames end in six zeros or, cut, in ten: bytes 44 to 53.
    zeros = F.when((F.col("status") == "truncated") & (F.expr("hex(substring(raw, 45, 10))") == "00" * 10), 20).otherwise(0).cast("int")
    return found.select("file", "number", "cap_len", F.octet_length("raw").cast("bigint").alias("size"), "status", zeros.alias("zeros"))


def _listed(found: DataFrame, source: str) -> DataFrame:
    name = F.regexp_extract("file", "[^/]+$", 0)
    return packets(found, tracked=False).select(F.lit(source).alias("source"), name.alias("file"), "number",
        F.octet_length("payload").cast("bigint").alias("cap_len"), "status", F.col("source").alias("address"))


@query(_FILED + " UNION ALL ".join(_LISTED.format(source=f"'{x}'", kind="pcap") for x in ("store", "capture", "pcap")))
def sources_pcap(spark, sf_dir):
    """Files of a folder by any store, by content and as classic captures; the file that is no capture is left out."""
    folder = X.written(X.captures(_table(spark, sf_dir, "events")))
    register(spark)
    by = {kind: spark.read.format(kind).option("pathGlobFilter", "*.pcap*").load(folder) for kind in ("capture", "pcap")}
    return _listed(read_captures(spark, folder), "store").unionByName(_listed(by["capture"], "capture")).unionByName(_listed(by["pcap"], "pcap"))


@query(_FILED + " UNION ALL ".join(_LISTED.format(source=f"'{x}'", kind="pcapng") for x in ("store", "capture", "pcapng")))
def sources_pcapng(spark, sf_dir):
    """The same of pcapng files."""
    folder = X.written(X.captures_ng(_table(spark, sf_dir, "events")))
    register(spark)
    by = {kind: spark.read.format(kind).option("pathGlobFilter", "*.pcap*").load(folder) for kind in ("capture", "pcapng")}
    return _listed(read_captures(spark, folder), "store").unionByName(_listed(by["capture"], "capture")).unionByName(_listed(by["pcapng"], "pcapng"))


@query("""WITH e AS (SELECT event_id + 1 AS n, event_id % 4 AS kind, event_id // 4 AS k FROM events)
SELECT 'mem' AS file, n::INTEGER AS number, CASE kind WHEN 0 THEN 'Invalid DNS packet' WHEN 1 THEN 'Invalid ICMP packet' WHEN 2 THEN 'Telnet'
  ELSE 'BGP' END AS message FROM e
WHERE kind > 1 OR (kind = 0 AND k % 40 >= 8 AND k % 40 < 20) OR (kind = 1 AND k % 12 < 8)
UNION ALL SELECT 'bad' || r_regionkey::VARCHAR, 0, 'Incompatible PCAP file format' FROM region""")
def capture_diagnostics(spark, sf_dir):
    """DNS, ICMP, Telnet and BGP packets by event, and a file of another magic for each region."""
    events, e = _table(spark, sf_dir, "events"), X.event()
    k = F.floor(e / 4)
    ip = lambda size, proto: X.ip4(20 + size, proto, X.client(), X.SERVER)
    filled = "00" * 60
    body = F.get(F.array(
        X.join(X.ethernet(0x0800), ip(k % 40, 17), X.udp(53, 5353, k % 40), filled),
            X.join(X.ethernet(0x0800), ip(k % 12, 1), _icmp_body(k % 13, k % 7), filled),
        X.join(X.ethernet(0x0800), ip(F.lit(20), 6), X.tcp(23, 5000), filled), X.join(X.ethernet(0x0800), ip(F.lit(39), 6), X.tcp(179, 5000), filled),
    ), (e % 4).cast("int"))
    region = _table(spark, sf_dir, "region")
    bad = region.select(F.concat(F.lit("bad"), F.col("r_regionkey").cast("string")).alias("path"), F.unhex(F.lit("A1B2C3D4" + "00" * 20)).alias("content"))
    return diagnostics(packets(X.frames(events, e + 1, body), tracked=False), parse_files(bad, "blocks"))


#: Bytes of a range in these queries, whose files have some 100 kB at sf0.01.
_RANGE = 1 << 15


def _by_ranges(files: DataFrame, table: str = "frames") -> DataFrame:
    return read_captures(files.sparkSession, X.written(files), table, split=_RANGE).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))


@query(ORACLE["capture_scan_pcap"])
def capture_ranges_pcap(spark, sf_dir):
    """Classic captures, each read by many tasks."""
    return _by_ranges(X.captures(_table(spark, sf_dir, "events"))).select("file", "number", "ts_hi", "ts_lo", "cap_len", "status")


@query("""WITH e AS (SELECT event_id + 1 AS n, user_id % (SELECT greatest(8, (count(*) + 49999) // 50000) FROM events) AS f,
  floor((epoch_us(ts) * 1000)::DOUBLE * 0.001::DOUBLE)::BIGINT AS v FROM events),
w AS (SELECT *, v // 1000000 AS s, v % 1000000 AS u, row_number() OVER (PARTITION BY f ORDER BY n) AS k FROM e),
a AS (SELECT *, coalesce(first_value(nullif(s, 0) IGNORE NULLS) OVER w, 0) AS s0, coalesce(first_value(nullif(u, 0) IGNORE NULLS) OVER w, 0) AS u0
  FROM w WINDOW w AS (PARTITION BY f ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT 'cap' || f::VARCHAR || '.pcapng' AS file, k::INTEGER AS number, 1::INTEGER AS link_type, 1::INTEGER AS section, (k + 2)::INTEGER AS block_ordinal,
  printf('%.6f', (s::DOUBLE + 10e-7::DOUBLE * u::DOUBLE) - (s0::DOUBLE + 10e-7::DOUBLE * u0::DOUBLE)) AS time FROM a""")
def capture_ranges_pcapng(spark, sf_dir):
    """pcapng files, each read by many tasks: numbers, places of blocks, interfaces and time anchors hold across ranges."""
    found = with_time_kept(_by_ranges(X.captures_ng(_table(spark, sf_dir, "events"))))
    return found.select("file", "number", "link_type", "section", "block_ordinal", "time")


def with_time_kept(frames: DataFrame) -> DataFrame:
    """Frames with their shown time; other columns stay."""
    return with_time(frames).withColumn("time", F.format_string("%.6f", "time"))


@query(ORACLE["capture_blocks"])
def capture_ranges_blocks(spark, sf_dir):
    """All kinds of blocks, each file read by many tasks."""
    return _by_ranges(X.captures_mixed(_table(spark, sf_dir, "events")), "blocks").select("file", "block_ordinal", "block_type", "total_length", "status")


@query("""WITH p AS (SELECT event_id + 1 AS n, event_id % 2 = 1 AS back, event_id % 1000 = 0 AS syn, event_id % 1000 = 1 AS synack, (event_id * 7919) % 4294967296 AS seq,
  (event_id * 3) % 4294967296 AS ack FROM events),
f AS (SELECT *, back = first_value(back) OVER w AS fwd, row_number() OVER w AS rn FROM p WINDOW w AS (ORDER BY n ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, synack AND NOT fwd AS answers, NOT fwd AND NOT syn AS cand FROM f),
d AS (SELECT *, sum(cand::INT) OVER w AS cn, last_value(CASE WHEN rn = 1 OR (fwd AND syn) THEN seq END IGNORE NULLS) OVER w AS client
  FROM c WINDOW w AS (ORDER BY n ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, coalesce(last_value(CASE WHEN answers OR (cand AND cn = 1) THEN seq END IGNORE NULLS) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS server FROM d)
SELECT n::INTEGER AS number,
  (CASE WHEN syn THEN CASE WHEN fwd THEN 0 END WHEN synack THEN CASE WHEN answers THEN 0 END ELSE (seq - CASE WHEN fwd THEN client
  ELSE server END + 4294967296) % 4294967296 END)::BIGINT AS rel_seq,
  (CASE WHEN syn THEN CASE WHEN fwd THEN -1 END WHEN synack THEN CASE WHEN answers THEN 1 END ELSE (ack - CASE WHEN fwd THEN server
  ELSE client END + 4294967296) % 4294967296 END)::BIGINT AS rel_ack
FROM g""")
def tcp_hot_connection(spark, sf_dir):
    """All frames are one connection: it is tracked in parts."""
    return tcp_tracking(X.hot_frames(_table(spark, sf_dir, "events")), part=1000).select("number", "rel_seq", "rel_ack")


#: ``captures_named``: events by file with their sections, and the frames among them.
_NAMED = _E + f""", s AS (SELECT *, 'named' || fileno::VARCHAR || '.pcapng' AS file, 1 + count(*) FILTER (event_id % {X.SECTION} = 0) OVER (PARTITION BY fileno ORDER BY n) AS section FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n) AS k FROM s WHERE event_id % 5 <> 2)
"""


@query(_NAMED + """SELECT file, k::INTEGER AS number, section::INTEGER AS section, (CASE event_id % 3 WHEN 0 THEN us * 1000 WHEN 1 THEN us * 1000 + 7000000000
  ELSE ((us // 1000)::HUGEINT * 1000000000) // 1024 END)::BIGINT AS time_ns FROM f""")
def interface_times(spark, sf_dir):
    """Exact times by the clock of each frame's interface: microseconds, shifted nanoseconds, 1,024ths of a second."""
    files = X.captures_named(_table(spark, sf_dir, "events"))
    return with_interface_time(parse_files(files), parse_files(files, "interfaces")).select("file", "number", "section", "time_ns")


@query(_NAMED + """, w AS (SELECT *, last_value(CASE WHEN event_id % 5 = 2 THEN 'n' || event_id::VARCHAR END IGNORE NULLS)
  OVER (PARTITION BY file, section, ip ORDER BY n ROWS UNBOUNDED PRECEDING) AS name FROM s)
SELECT f.file, k::INTEGER AS number, f.ip AS source, name AS source_name, NULL::VARCHAR AS destination_name FROM f JOIN w ON f.n = w.n""")
def resolved_names(spark, sf_dir):
    """Names as they hold at each packet; they change within a section."""
    files = X.captures_named(_table(spark, sf_dir, "events"))
    found = with_names(packets(parse_files(files), tracked=False), parse_files(files, "names"))
    return found.select("file", "number", "source", "source_name", "destination_name")


_LAYERS = """WITH e AS (SELECT event_id, [1,6,17,58,99,6,17][(event_id % 7 + 1)::INT] AS p FROM events),
l AS (SELECT 'ip4' AS l3, CASE p WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 58 THEN 'icmp6' ELSE 'other' END AS l4,
  CASE p WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 58 THEN 'ICMPv6' ELSE 'Other' END AS protocol FROM e
  UNION ALL SELECT 'arp', 'none', 'ARP' FROM customer)
"""


@query(_LAYERS + """SELECT (CASE GROUPING(l3, l4, protocol) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END)::INTEGER AS depth, l3, l4, protocol, count(*)::BIGINT AS frames,
  sum(CASE l3 WHEN 'ip4' THEN 54 ELSE 42 END)::BIGINT AS bytes FROM l GROUP BY ROLLUP (l3, l4, protocol)""")
def protocol_hierarchy(spark, sf_dir):
    """Frames and bytes of all protocols, at each layer."""
    events, e, k = _table(spark, sf_dir, "events"), X.event(), F.col("c_custkey")
    proto = F.get(F.array(*map(F.lit, _PROTOS)), (e % 7).cast("int"))
    body = X.join(X.ethernet(0x0800), X.ip4(F.lit(40), proto, X.client(), X.SERVER), X.tcp(5000, 6000))
    arp = X.join(X.ethernet(0x0806), "000108000604", "0001", "0200", X.h(k, 4), "0A000001", "000000000000", "0A0000FE")
    both = X.frames(events, e + 1, body, dns=False).unionByName(X.frames(_table(spark, sf_dir, "customer"), k + 1, arp, dns=False))
    return statistics.protocol_hierarchy(packets(both, tracked=False))


_ENDS = """WITH e AS (SELECT event_id % 2 = 1 AS back, '10.0.' || ((user_id % 65536) // 256)::VARCHAR || '.' || (user_id % 256)::VARCHAR AS ip FROM events),
p AS (SELECT CASE WHEN back THEN '192.168.0.10' ELSE ip END AS s, CASE WHEN back THEN ip ELSE '192.168.0.10' END AS d FROM e),
u AS (SELECT s AS address, d AS peer, 1 AS sent FROM p UNION ALL SELECT d, s, 0 FROM p)
"""


@query(_ENDS + """SELECT address, sum(sent)::BIGINT AS sent, sum(1 - sent)::BIGINT AS received, sum(54 * sent)::BIGINT AS bytes_sent,
  sum(54 * (1 - sent))::BIGINT AS bytes_received, count(DISTINCT peer)::BIGINT AS peers FROM u GROUP BY address""")
def endpoints(spark, sf_dir):
    """Packets, bytes and distinct peers of every address, exact."""
    return statistics.endpoints(packets(X.flow_frames(_table(spark, sf_dir, "events")), tracked=False))


@query(_E + "SELECT ip AS address, sum(54)::BIGINT AS bytes FROM e GROUP BY ip ORDER BY bytes DESC, address LIMIT 10")
def top_talkers(spark, sf_dir):
    """The ten addresses that sent most (a top-k report)."""
    return statistics.top_talkers(packets(X.tcp_frames(_table(spark, sf_dir, "events")), tracked=False), 10)


@query(_FILED + "SELECT row_number() OVER (ORDER BY us, f, k) AS merged_number, f || '.pcap' AS file, k::INTEGER AS number, us AS time_exact FROM c")
def merged_captures(spark, sf_dir):
    """Frames of all files in one order of time."""
    found = with_time(parse_files(X.captures(_table(spark, sf_dir, "events"))))
    return merged(found, 3000).select("merged_number", "file", "number", "time_exact")


@query(_E + """, f AS (SELECT n, user_id % 50 AS u FROM e), l AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n) AS r FROM f),
r AS (SELECT u, count(*) AS c FROM f WHERE n % 3 = 0 GROUP BY u)
SELECT n::INTEGER AS number, r::BIGINT AS nth FROM (SELECT l.n, l.r, coalesce(r.c, 0) AS c FROM l LEFT JOIN r ON l.u = r.u) WHERE r > c""")
def capture_difference(spark, sf_dir):
    """Frames that a second capture lacks, equal ones by count: each of 50 frames occurs many times."""
    events = _table(spark, sf_dir, "events")
    body = X.join(X.ethernet(0x0800), X.ip4(F.lit(40), 6, "0A000001", X.SERVER), X.tcp(1024 + X.user() % 50, 80))
    frames = X.frames(events, X.event() + 1, body, dns=False)
    left = difference(frames, frames.where("number % 3 = 0"))
    rank = Window.partitionBy("raw").orderBy("number")
    have = frames.withColumn("nth", F.row_number().over(rank).cast("long")).select("number", "nth")
    return left.select("number").join(have, "number")


#: ``captures_ended``: events of a file up to the block that ends its scan.
_ENDED = _E + f""", b AS (SELECT event_id AS e, 'ended' || fileno::VARCHAR || '.pcapng' AS file, event_id % {X.END} = {X.END - 1} AS ends,
  2 + row_number() OVER (PARTITION BY fileno ORDER BY event_id) AS ordinal FROM e),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY file ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM b),
k AS (SELECT *, CASE WHEN ends THEN CASE WHEN e % {2 * X.END} < {X.END} THEN 1 ELSE 168627466 END ELSE [6, 3, 5, 2989][(e % 4 + 1)::INT] END AS kind FROM c WHERE past = 0)
"""


@query(_ENDED + """SELECT file, ordinal::INTEGER AS block_ordinal, kind::BIGINT AS block_type,
  CASE WHEN kind IN (6, 2989) THEN 'ok' ELSE 'length_mismatch' END AS status FROM k
UNION ALL SELECT DISTINCT file, 1, 168627466, 'ok' FROM b UNION ALL SELECT DISTINCT file, 2, 1, 'ok' FROM b""")
def capture_ended_blocks(spark, sf_dir):
    """Sections and interfaces whose lengths disagree end a scan; simple packets and statistics do not."""
    return parse_files(X.captures_ended(_table(spark, sf_dir, "events")), "blocks").select("file", "block_ordinal", "block_type", "status")


@query(_ENDED + """SELECT file, row_number() OVER (PARTITION BY file ORDER BY e)::INTEGER AS number, kind::BIGINT AS block_type,
  CASE kind WHEN 6 THEN 'ok' ELSE 'length_mismatch' END AS status, CASE kind WHEN 6 THEN format('{:08X}', e) END AS raw FROM k WHERE kind IN (3, 6)""")
def capture_ended_packets(spark, sf_dir):
    """The packets before a scan's end."""
    return parse_files(X.captures_ended(_table(spark, sf_dir, "events"))).select("file", "number", "block_type", "status", F.hex("raw").alias("raw"))


@query("""SELECT (event_id + 1)::INTEGER AS number, event_id % 2 = 0 AS ip_sum_ok, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 <> 0 END AS l4_sum_ok FROM events""")
def packet_checksums(spark, sf_dir):
    """Checksums of IPv4 headers and UDP, right and wrong; a UDP packet without one has no verdict."""
    table = packets(X.summed_frames(_table(spark, sf_dir, "events")), tracked=False)
    return with_checksums(table).select("number", "ip_sum_ok", "l4_sum_ok")


@query(_E + """SELECT (3 * event_id + 3)::INTEGER AS number, 'UDP' AS protocol, 48::BIGINT AS length,
  port::VARCHAR || ' -> 9999 Len=40' AS info, format('{:04X}', port) || '270F00300000' || array_to_string(list_transform(range(10),
  lambda k: format('{:08X}', event_id + 5 * k)), '') AS segment FROM e WHERE event_id % 7 <> 0""")
def reassembled_datagrams(spark, sf_dir):
    """Datagrams from fragments that overlap and come in any order; those without an end are left out."""
    table = packets(with_whole_datagrams(X.fragment_frames(_table(spark, sf_dir, "events"))), tracked=False)
    return table.select("number", "protocol", "length", "info", F.hex(F.expr("substring(raw, 35, 65535)")).alias("segment"))
