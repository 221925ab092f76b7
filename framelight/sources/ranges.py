"""Captures by byte ranges: records of one file are read by many tasks.

A capture has no marks at which a reader could start, so ranges are read twice, the first time for their record
lengths only:

1.  Each range looks for the first place from which records chain, and walks from there to the first record of the
    next range.  What it passes is summed up as a ``State``.
2.  A file's ranges are put together in order, one row each.  A range that began elsewhere than where the one before it
    ended was mistaken and is walked again from there, so no guess reaches a result.  The states before each range are
    its first number, its interfaces and its time anchors.
3.  Ranges are dealt out again and read from where their first record is.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight.sources.scan import START, TABLES, Pcapng, State, layout, resync, scan, walk

#: Bytes of a range, and of what a task reads at least where each core has TASKS_A_CORE; tasks that read ranges, at most.
SPLIT, TASKS_A_CORE, MOST_TASKS = 64 << 20, 8, 100_000

_STATE = "number bigint, ordinal bigint, section bigint, links array<bigint>, sec bigint, us bigint, ended boolean"
_FOUND = f"path string, length bigint, split bigint, start bigint, next bigint, {_STATE}"
_SETTLED = f"path string, length bigint, begin bigint, stop bigint, {_STATE}"


def open_at(path: str):
    """A file that can be read anywhere: a mounted one, or one of a store that Arrow knows."""
    local = re.fullmatch(r"(?:file:)?/*(/.*)", path)
    if local:
        return open(local[1], "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def put(path: str, content: bytes | pa.Buffer) -> None:
    """Writes a file where ``open_at`` reads it, whole or not at all, as a task may run twice."""
    local = re.fullmatch(r"(?:file:)?/*(/.*)", path)
    if local:
        os.makedirs(os.path.dirname(local[1]), exist_ok=True)
        part = f"{local[1]}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, local[1])
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(name))
    with store.open_output_stream(name) as f:
        f.write(content)


def can_open(path: str) -> bool:
    try:
        with open_at(path):
            return True
    except (OSError, ValueError, ImportError, pa.ArrowException):
        return False


def _row(state: State) -> tuple:
    return state.number, state.ordinal, state.section, list(state.links), *state.zero, state.ended


def _state(row: dict) -> State:
    return State(row["number"], row["ordinal"], row["section"], tuple(row["links"]), (row["sec"], row["us"]), row["ended"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _look(kind: str, split: int):
    """Where each range's records begin, and what they tell.  A file of one range need not be looked at."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(_names(_FOUND), look(r), strict=True)) for r in batch.to_pylist()], schema=_arrow(_FOUND))

    def look(r: dict) -> tuple:
        begin, stop = r["split"] * split, min((r["split"] + 1) * split, r["length"])
        with open_at(r["path"]) as f:
            reader, start = layout(r["path"], f, r["length"], kind)
            if r["length"] <= split or reader is None:
                at, state = r["length"], START
            else:
                start = start if r["split"] == 0 else resync(f, begin, stop, r["length"], isinstance(reader, Pcapng))
                at, state = walk(r["path"], f, r["length"], start, stop, kind) if start is not None else (None, START)
        return r["path"], r["length"], r["split"], start, at, *_row(state)

    return run


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _settle(kind: str, split: int):
    """A file's ranges in order, each with the place of its first record and the state before it."""

    def run(table: pa.Table) -> pa.Table:
        out, state, at = [], START, None
        for r in sorted(table.to_pylist(), key=lambda r: r["split"]):
            stop = min((r["split"] + 1) * split, r["length"])
            at = r["start"] if r["split"] == 0 else at
            if state.ended or at >= stop and r["length"]:
                continue
            out.append(dict(zip(_names(_SETTLED), (r["path"], r["length"], at, stop, *_row(state)), strict=True)))
            if r["start"] == at:
                at, found = r["next"], _state(r)
            else:
                with open_at(r["path"]) as f:
                    at, found = walk(r["path"], f, r["length"], at, stop, kind)
            state = state.then(found)
        return pa.Table.from_pylist(out, schema=_arrow(_SETTLED))

    return run


def settled_ranges(files: DataFrame, kind: str = "capture", split: int = SPLIT, tasks: int | None = None) -> DataFrame:
    """path, length, begin (a record's start), stop, and the state before it, for each range of ``files`` (path, length) in which a record starts."""
    ranges = files.selectExpr("path", "length", f"explode(sequence(0L, greatest(1L, cast(ceil(length / {split}) as bigint)) - 1)) as split")
    found = ranges.repartition(tasks or _tasks(files, split), "path", "split").mapInArrow(_look(kind, split), _FOUND)
    return found.groupBy("path").applyInArrow(_settle(kind, split), _SETTLED)


def _tasks(files: DataFrame, split: int) -> int:
    """One for each range, but no more than give each core several, or each task SPLIT bytes: small ranges cost less than tasks."""
    n = files.agg(F.expr(f"sum(greatest(1L, cast(ceil(length / {split}) as bigint)))").alias("ranges"), F.sum("length").alias("bytes")).first()
    enough = max(TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism, -(-(n.bytes or 0) // SPLIT))
    return max(1, min(MOST_TASKS, n.ranges or 1, enough))


def read_ranges(files: DataFrame, table: str = "frames", kind: str = "capture", split: int = SPLIT) -> DataFrame:
    """A table's rows of ``files`` (path, length) by ranges of ``split`` bytes; the same rows as of whole files."""

    def read(batches):
        for r in _rows(batches):
            with open_at(r["path"]) as f:
                # A classic capture of another magic has no record's start, but one row among its blocks.
                yield from scan(r["path"], f, r["length"], table, kind, r["begin"], r["stop"], _state(r))

    tasks = _tasks(files, split)
    settled = settled_ranges(files.select("path", "length"), kind, split, tasks)
    # A number of its own, as rows of a few bytes stand for ranges of megabytes.
    return settled.repartition(tasks, "path", "begin").mapInArrow(read, TABLES[table])


__all__ = ["SPLIT", "can_open", "open_at", "put", "read_ranges", "settled_ranges"]
