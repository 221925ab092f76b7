"""What a pcapng file says of its own frames: clocks of its interfaces, names of its addresses.

Both are joins from frames to small tables of the same file and section.  A table is broadcast only after its rows
were counted; beyond that bound it is joined by its keys, and a key of many frames is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a table that is broadcast, at most (some 100 bytes each).
MOST_ROWS = 500_000


def _small(table: DataFrame, most: int) -> DataFrame:
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def _whole(text: str) -> str:
    return f"cast({text} as decimal(38,0))"


def with_interface_time(frames: DataFrame, interfaces: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Adds ``time_ns``: nanoseconds since 1970 as the frame's interface counts them, exact and rounded down.

    An interface's unit is a power of ten or of two (option if_tsresol, else microseconds) and its seconds are shifted
    (if_tsoffset).  Frames of a section see the interfaces described before them.  A classic capture counts
    microseconds.  NULL where a frame has no timestamp or no interface, or the time does not fit into 64 bits.
    """
    clocks = interfaces.select("file", "section", "interface_id", F.col("block_ordinal").alias("described_at"), "ts_resol", "ts_offset")
    keys = ["file", "section", "interface_id"]
    out = frames.join(_small(clocks, most), keys, "left")
    tens = "array(" + ", ".join(f"{10**k}BD" for k in range(20)) + ")"
    # Counts are below 2^64, so nanoseconds of a unit of one second are below 2^94: a unit finer than that gives 0.
    out = out.selectExpr(
        *frames.columns, "ts_resol", "ts_offset", "cast(ts_hi as decimal(20,0)) * 4294967296BD + ts_lo as ticks",
        "status in ('ok', 'truncated') and (format = 'pcap' or described_at < block_ordinal) as timed",
        f"case when ts_resol < 128 then get({tens}, abs(ts_resol - 9)) when ts_resol <= 222 then {_whole('pow(2, ts_resol - 128)')} end as unit",
    )
    out = out.selectExpr("*", f"case when ts_resol <= 9 then {_whole('ticks * unit')} when ts_resol < 128 then ticks else {_whole('ticks * 1000000000BD')} end as whole")
    fits = "ts_resol between 10 and 127 or ts_resol >= 159 or whole < 9223372036854775808BD * unit"
    since = f"case when ts_resol <= 9 then try_cast(whole as bigint) when unit is null then 0 when {fits} then whole div unit end"
    exact = f"case when not timed then null when format = 'pcap' then ts_hi * 1000000000 + ts_lo * 1000 else try_add({since}, try_multiply(ts_offset, 1000000000L)) end"
    return out.selectExpr(*frames.columns, f"{exact} as time_ns")


def name_changes(names: DataFrame) -> DataFrame:
    """file, section, address, changes: from which block on an address has which names, in order.

    Names of one block come together; a block that repeats what holds already changes nothing.  So an address has
    an entry for each time that its names differ from before.
    """
    keys = ["file", "section", "address"]
    # The names that one block gives one address.
    told = names.select(*keys, "block_ordinal", F.explode("names").alias("name")).groupBy(*keys, "block_ordinal")
    told = told.agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("name"))
    before = F.lag("name").over(Window.partitionBy(*keys).orderBy("block_ordinal"))
    changed = told.withColumn("before", before).where("before is null or before != name")
    return changed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_ordinal", "name"))).alias("changes"))


def with_names(packets: DataFrame, names: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Adds ``source_name`` and ``destination_name`` to ``packets`` (file, section, block_ordinal, source, destination, ...).

    A name holds in its section from its record's block on, until another record of the address; NULL where none
    holds yet.  This is a join by address and time of which no key's packets need to meet in one task: an address
    has one row, with all its changes.
    """
    changes = _small(name_changes(names), most)
    out = packets
    for side in ("source", "destination"):
        one = changes.select("file", "section", F.col("address").alias(side), F.col("changes").alias(f"{side}_changes"))
        out = out.join(one, ["file", "section", side], "left")
    last = lambda side: f"element_at(filter({side}_changes, c -> c.block_ordinal < block_ordinal), -1).name"
    known = lambda side: f"case when size(filter({side}_changes, c -> c.block_ordinal < block_ordinal)) > 0 then {last(side)} end as {side}_name"
    return out.selectExpr(*packets.columns, known("source"), known("destination"))
