"""Hex dumps of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 16
HEADER = " ".join(f"{k:02X}" for k in range(WIDTH))


def hex_dump(frames: DataFrame) -> DataFrame:
    """file, number, line, address, bytes, ascii: 16 bytes a line, upper case; what is not 32 to 126 shows as a dot.  An empty frame has no lines."""
    every = F.expr(f"sequence(0, cast((length(raw) - 1) div {WIDTH} as int))")
    lines = frames.where("octet_length(raw) > 0").select("file", "number", "raw", F.explode(every).alias("line"))
    part = F.expr(f"substring(raw, line * {WIDTH} + 1, {WIDTH})")
    rows = lines.select("file", "number", "line", part.alias("part"))
    spaced = F.rtrim(F.regexp_replace(F.hex("part"), "(..)", "$1 "))
    text = F.regexp_replace(F.decode("part", "ISO-8859-1"), "[^\\x20-\\x7E]", ".")
    return rows.select("file", "number", "line", F.format_string("%08X: ", F.col("line") * WIDTH).alias("address"), spaced.alias("bytes"), text.alias("ascii"))


def hex_text(frames: DataFrame) -> DataFrame:
    """file, number, hex, text: the whole dump as two texts of lines that each end in a line feed.

    Bytes are lower case with a space after each, the last line padded with spaces to full width; what is not
    32 to 126 shows as a dot.  An empty frame has two empty texts.
    """
    lines = f"cast((length(raw) + {WIDTH - 1}) div {WIDTH} as int)"
    pairs = f"rpad(regexp_replace(lower(hex(raw)), '(..)', '$1 '), {lines} * {3 * WIDTH}, ' ')"
    shown = "regexp_replace(decode(raw, 'ISO-8859-1'), '[^\\\\x20-\\\\x7E]', '.')"
    cut = f"regexp_replace({shown}, '(.{{{WIDTH}}})', '$1\\n')"
    end = f"case when length(raw) % {WIDTH} > 0 then '\\n' else '' end"
    hexes = f"regexp_replace({pairs}, '(.{{{3 * WIDTH}}})', '$1\\n') as hex"
    return frames.where("raw is not null").selectExpr("file", "number", hexes, f"concat({cut}, {end}) as text")
