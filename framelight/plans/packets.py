"""From frames to the packet table and its projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight import schema as S
from framelight.operators.dissect import IS_TCP, offsets, with_dns, with_packets
from framelight.operators.tcp import track, track_in_parts
from framelight.operators.timebase import with_time

COLUMNS = ["file", "number", "time", "time_exact", "source", "destination", "protocol", "length", "info", "eth", "ip4", "ip6", "arp", "icmp", "tcp",
    "udp", "dhcp", "l3", "l4", "raw", "payload", "status", "rel_seq", "rel_ack"]


def tcp_tracking(frames: DataFrame, part: int | None = None) -> DataFrame:
    """file, number, rel_seq, rel_ack of the TCP frames; raw bytes stay out of the shuffle.  ``part``: as in ``packets``."""
    segments = with_packets(offsets(frames.where(IS_TCP).withColumn("dns", F.lit(None).cast("string"))))
    segments = segments.select("file", "number", "source", "destination", "sport", "dport", "seq", "ack", "flags")
    return (track_in_parts(segments, part) if part else track(segments)).select("file", "number", "rel_seq", "rel_ack")


def packets(frames: DataFrame, tracked: bool = True, part: int | None = None) -> DataFrame:
    """The packet table: frames are parsed and dissected once, and meet one exchange, by connection.

    Frames of other kinds travel along, spread evenly, as a second pass over the bytes costs more than
    moving what a query reads.  If a query reads no tracked number, or with ``tracked=False`` (rel_seq and
    rel_ack are NULL), there is no exchange.  With ``part`` a connection's frames are tracked in groups of that many
    frame numbers, so that one connection of most frames spreads over tasks; frames are then read twice.
    """
    table = with_packets(offsets(with_time(with_dns(frames))))
    if not tracked:
        return _finish(table.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("rel_seq", "rel_ack")]))
    return _finish(track_in_parts(table, part) if part else track(table))


def packet_at(frames: DataFrame, file: str, number: int) -> DataFrame:
    """The packet table's row of one frame.  Only that file's frames up to it are dissected and tracked, as later ones cannot matter.

    For captures read ``frames`` from that file alone, as a filter does not reach into a file's parser.
    """
    return packets(frames.where((F.col("file") == file) & (F.col("number") <= number))).where(F.col("number") == number)


def _finish(table: DataFrame) -> DataFrame:
    shown = (
        "case when l4 = 'tcp' and protocol != 'SMTP' then concat(info, case when rel_seq >= 0 then concat(' Seq=', rel_seq) else '' end, case "
        "when rel_ack >= 0 then concat(' Ack=', rel_ack) else '' end, info_tail) else info end"
    )
    return table.withColumn("info", F.expr(shown)).select(*COLUMNS, *[c for c in ("section", "block_ordinal") if c in table.columns])


def packet_list(table: DataFrame) -> DataFrame:
    """The seven columns of the packet list: number, time as text, source, destination, protocol, length, info."""
    return table.select("number", F.format_string("%.6f", "time").alias("time"), "source", "destination", "protocol", "length", "info")


def frame_details(table: DataFrame) -> DataFrame:
    """The two header lines of a packet's details."""
    return table.select("file", "number", F.concat(F.lit("Frame Number: "), F.col("number").cast("string")).alias("frame_line"),
        F.concat(F.lit("Packet Info: "), F.col("info")).alias("info_line"))


def diagnostics(table: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """file, number, message: what a reader of the captures is told, in the words of the viewer.

    ``table``: the packet table; too short DNS and ICMP packets, the Telnet and BGP packets met, and packet
    blocks whose lengths disagree.  ``blocks``, if given, adds files and other blocks that cannot be read, with
    the block's place for the number.
    """
    said = (
        "case when status = 'length_mismatch' then 'Mismatched block length at end of block' "
        "when protocol = 'DNS' and length >= 8 and length < 20 then 'Invalid DNS packet' "
        "when protocol in ('ICMP', 'ICMPv6') and length < 8 then 'Invalid ICMP packet' when protocol in ('Telnet', 'BGP') then protocol end"
    )
    out = table.selectExpr("file", "number", f"{said} as message")
    if blocks is not None:
        ends = (
            "case when status = 'bad_magic' then 'Incompatible PCAP file format' "
            f"when status = 'length_mismatch' and block_type != {S.ENHANCED} then 'Mismatched block length at end of block' end"
        )
        out = out.unionByName(blocks.selectExpr("file", "block_ordinal as number", f"{ends} as message"))
    return out.where("message is not null")
