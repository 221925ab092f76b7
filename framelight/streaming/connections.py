"""TCP connections over rotating captures: relative numbers with state that outlives files and micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelight.plans.packets import packets
from framelight.sources.capture import parse_files
from framelight.streaming.captures import FILES

_OUT = "file string, number int, at timestamp, rel_seq bigint, rel_ack bigint"
#: Who is the client, its first number, and the server's, if it is known.
_STATE = "client_ep string, client bigint, server bigint"
_U32 = 1 << 32


class Connection:
    """The state of one connection; its client sends the first segment."""

    def __init__(self, client_ep: str | None = None, client: int | None = None, server: int | None = None):
        self.client_ep, self.client, self.server = client_ep, client, server

    def take(self, src: str, dst: str, seq: int, ack: int, flags: int) -> tuple[int | None, int | None]:
        """(relative sequence, relative acknowledgement number) of the next segment: None where undefined, -1 where hidden."""
        syn, acked = flags & 2 != 0, flags & 16 != 0
        if self.client_ep is None:
            self.client_ep, self.client = src, seq
        fwd = src == self.client_ep
        if fwd and syn and not acked:
            self.client = seq
        answers = syn and acked and (not fwd or src == dst)
        if answers or not fwd and not syn and self.server is None:
            self.server = seq
        if syn and not acked:
            return (0, -1) if fwd else (None, None)
        if syn:
            return (0, 1) if answers else (None, None)
        mine, other = (self.client, self.server or 0) if fwd else (self.server or 0, self.client)
        return (seq - mine) % _U32, (ack - other) % _U32


def _tracked(idle_ms: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # idle for so long that a segment of these ends would be another connection's
            state.remove()
            return
        held = state.getOption
        one = Connection(*[None if pd.isna(x) else x for x in held]) if held else Connection()
        rows = pd.concat(list(parts)).sort_values(["at", "file", "number"], kind="stable")
        columns = zip(*[rows[c].tolist() for c in ("src_ep", "dst_ep", "seq", "ack", "flags")], strict=True)
        found = [one.take(*x) for x in columns]
        state.update((one.client_ep, one.client, one.server))
        newest = int(rows["at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"file": rows["file"], "number": rows["number"], "at": rows["at"], "rel_seq": pd.array([x[0] for x in found], "Int64"),
            "rel_ack": pd.array([x[1] for x in found], "Int64")})

    return run


def segments_of(files: DataFrame) -> DataFrame:
    """file, number, at, src_ep, dst_ep, seq, ack, flags, conn_lo, conn_hi of the TCP segments of ``files`` (path, content), batch or stream."""
    table = packets(parse_files(files), tracked=False).where("tcp is not null and time_exact is not null")
    ends = table.selectExpr("file", "number", "timestamp_micros(time_exact) as at", "concat(source, '|', tcp.src_port) as src_ep",
        "concat(destination, '|', tcp.dst_port) as dst_ep", "tcp.seq as seq", "tcp.ack as ack", "cast(tcp.flags as bigint) as flags")
    return ends.selectExpr("*", "least(src_ep, dst_ep) as conn_lo", "greatest(src_ep, dst_ep) as conn_hi")


def stream_connections(spark: SparkSession, folder: str, late: str = "10 minutes", idle: int = 3600, files_per_batch: int = 64,
    pattern: str = "*.pcap*") -> DataFrame:
    """A streaming table file, number, at, rel_seq, rel_ack of the TCP segments in a growing folder of rotating captures.

    A connection goes on from file to file: its rows are those of one capture that holds all files' frames in order of
    time.  In a micro-batch segments are put in order of time; across micro-batches files must come in order, as
    rotation writes them, and segments older than the watermark (``late`` behind the newest) are dropped.  A
    connection's state is three values; it goes once the watermark is ``idle`` seconds past its last segment.  One
    connection's segments of one micro-batch meet in one task, so ``files_per_batch`` bounds its memory.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    keyed = segments_of(files).withWatermark("at", late).groupBy("conn_lo", "conn_hi")
    return keyed.applyInPandasWithState(_tracked(1000 * idle), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
