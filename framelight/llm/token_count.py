"""Token counts without ids.

1.  Every block of documents (an Arrow batch) is cut into units: before each space that a non-space follows, and
    at each line feed between non-spaces.  No pre-token of a byte-level vocabulary crosses such a cut, so a unit
    is a run of whole pre-tokens.  The block keeps its distinct units, and for each document which of them it
    has how often (packed, about two bytes each).
2.  The distinct units of all blocks meet by hash: in each bucket every distinct unit of the corpus is
    pre-tokenised once and every distinct pre-token's pieces are counted once.
3.  The counts go back to the blocks that asked, are joined to the documents' frequencies and summed.

So the corpus-wide join moves a block's distinct units once and a byte or two for each back, instead of a row
for each document and pre-token.  Ids are never kept.  Texts that hold one of the tokenizer's special strings,
and vocabularies of another kind than byte-level, are counted text by text by the library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker
from .scratch import Scratch, small_batches

#: Hash buckets for so many rows each, within these bounds; a bucket's distinct units are one task's table.
ROWS_A_BUCKET, BUCKETS = 1000, (256, 65_536)

#: A space before white space or the end, or a line feed beside white space or an end: then plain splits would cut too often.
_LOOSE = re.compile(r" (?=\s|\Z)")
_LOOSE_LINE = re.compile(r"\s\n|\n(?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a text that are cut into units at once.
PIECE = 1 << 20
#: The byte-level pre-token pattern over ASCII, where every library agrees about classes.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Letters of Latin-1 and Latin Extended-A, with a space before them: one pre-token.
_LATIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ſ]+")


def byte_chars() -> dict[int, str]:
    """Byte -> the printable character that byte-level vocabularies write for it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_BYTES = byte_chars()


class Pieces:
    """A tokenizer file: units of texts, and numbers of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = str(self.tokenizer.pre_tokenizer or "")
        #: Units are exact for a byte-level pre-tokeniser without normaliser or prefix space.
        self.units = self.tokenizer.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def by_units(self, text: str) -> bool:
        """Whether units say all; else only the library can count."""
        return self.units and not text[0].isspace() and not any(x in text for x in self.special)

    @staticmethod
    def cut(text: str) -> list[str]:
        """Keys of a text's or piece's units: what stands after a space, or begins with the line feed that stands before it."""
        if _LOOSE.search(text):
            return _CUT.split(text)
        if "\n" in text and not _LOOSE_LINE.search(text, 1):
            text = text[0] + text[1:].replace("\n", " \n")
        return text.split(" ")

    def pretokens(self, key: str) -> list[str]:
        unit = key if key[:1] == "\n" else " " + key
        if unit.isascii():
            return [p.translate(_BYTES) for p in _ASCII.findall(unit)]
        if _LATIN.fullmatch(unit):
            return [unit.encode().decode("latin-1").translate(_BYTES)]
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]

    def pieces(self, pretoken: str) -> int:
        return len(self.tokenizer.model.tokenize(pretoken))


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=4)
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _drop() -> None:
    pieces_of.cache_clear()
    _sentencepiece.cache_clear()


def _pieces(text: str):
    """The text in pieces of about PIECE characters, cut at a space between non-spaces, which falls away."""
    at = 0
    while len(text) - at > PIECE:
        space = _BETWEEN.search(text, at + PIECE)
        if not space:
            break
        yield text[at : space.start()]
        at = space.end()
    yield text[at:]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by bytes of equal weight, compressed: small numbers take little."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _strings(units: list[str]) -> bytes:
    data = [u.encode() for u in units]
    sizes = np.fromiter(map(len, data), "<u4", len(data))
    return zlib.compress(sizes.tobytes() + b"".join(data) + np.uint32(len(data)).tobytes(), 1)


def _unstrings(packed: bytes) -> list[str]:
    data = zlib.decompress(packed)
    n = int(np.frombuffer(data[-4:], "<u4")[0])
    ends = (4 * n + np.cumsum(np.frombuffer(data, "<u4", n).astype(np.int64))).tolist()
    return [data[a:b].decode() for a, b in pairwise([4 * n, *ends])]


def _bucket(keys: list[str], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(k.encode("utf-8", "surrogatepass")) % buckets for k in keys), np.int64, len(keys))


def pack(texts: list[str | None], pieces: Pieces, buckets: int) -> tuple[list[str], np.ndarray, bytes, bytes, bytes, np.ndarray]:
    """(distinct units as they first occur, their buckets, units of each document: how many, steps between them, frequencies; tokens known already)."""
    known, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    index: dict[str, int] = {}
    parts = [np.zeros(0, np.int64)]
    for i, t in enumerate(texts):
        if not t:
            continue
        if not pieces.by_units(t):
            known[i] = pieces.whole(t)
            continue
        known[i] = -1  # the line feed before the first unit is not the text's
        for piece in _pieces("\n" + t):
            keys = pieces.cut(piece)
            n[i] += len(keys)
            parts.append(np.fromiter((index.setdefault(u, len(index)) for u in keys), np.int64, len(keys)))
    at = np.concatenate(parts)
    names = list(index)
    bucket = _bucket(names, buckets)
    owner = np.repeat(np.arange(len(texts)), n)
    code, freq = np.unique(owner * max(1, len(names)) + at, return_counts=True)
    doc, unit = code // max(1, len(names)), code % max(1, len(names))
    sizes = np.bincount(doc, minlength=len(texts))
    step = np.diff(unit, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]  # each document's steps begin anew
    step[first] = unit[first]
    return names, bucket, _planes(sizes), _planes(step), _planes(freq), known


def sums(sizes: bytes, steps: bytes, freqs: bytes, known: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Tokens of each document from the pieces of the block's units."""
    sizes, step, freq = _unplanes(sizes), _unplanes(steps), _unplanes(freqs)
    out = known.copy()
    if not len(step):
        return out
    ends = np.cumsum(sizes)
    run = np.cumsum(step)
    full = np.flatnonzero(sizes)
    before = np.zeros(len(sizes), np.int64)
    first = (ends - sizes)[full]
    before[full] = run[first] - step[first]
    unit = run - np.repeat(before, sizes)
    out[full] += np.add.reduceat(count[unit] * freq, first)
    return out


_BLOCKS = (
    "block bigint, {ids} n_bytes array<bigint>, known array<bigint>, sizes binary, steps binary, freqs binary, buckets binary, asked "
    "array<struct<bucket:int,units:binary>>"
)


def _blocks(path: str, buckets: int, kind: pa.DataType | None = None):
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        worker.enter("tokens", _drop)
        pieces, base = pieces_of(path), TaskContext.get().partitionId() << 33
        for k, batch in enumerate(batches):
            texts = batch.column("text").to_pylist()
            names, bucket, sizes, steps, freqs, known = pack(texts, pieces, buckets)
            order = np.argsort(bucket, kind="stable")
            some, start = np.unique(bucket[order], return_index=True)
            units = [_strings([names[i] for i in order[a:b]]) for a, b in pairwise([*start, len(names)])]
            asked = [{"bucket": int(x), "units": u} for x, u in zip(some, units, strict=True)]
            one = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base + k]),
                    pa.ListArray.from_arrays(one, batch.column("doc_id")),
                    pa.ListArray.from_arrays(one, batch.column("n_bytes")),
                    pa.array([known.tolist()], pa.list_(pa.int64())),
                    *[pa.array([x], pa.binary()) for x in (sizes, steps, freqs, _planes(bucket))],
                    pa.array([asked], pa.list_(pa.struct([("bucket", pa.int32()), ("units", pa.binary())]))),
                ],
                ["block", "ids", "n_bytes", "known", "sizes", "steps", "freqs", "buckets", "asked"],
            )
        worker.leave()

    return run


def _counted(path: str):
    """Over rows (bucket, block, units) sorted by bucket: each distinct unit and pre-token is looked at once."""

    def run(batches: Iterator[pa.RecordBatch]):
        worker.enter("tokens", _drop)
        pieces, at, table, pretokens = pieces_of(path), None, {}, {}
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("units").to_pylist(), strict=True):
                if bucket != at:
                    at, table, pretokens = bucket, {}, {}
                units = _unstrings(packed)
                for u in units:
                    if u not in table:
                        n = 0
                        for p in pieces.pretokens(u):
                            m = pretokens.get(p)
                            if m is None:
                                m = pretokens[p] = pieces.pieces(p)
                            n += m
                        table[u] = n
                out.append(_planes(np.fromiter(map(table.__getitem__, units), np.int64, len(units))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "counts"])
        table.clear()
        worker.leave()

    return run


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block with the counts of its units, which come by bucket."""
    ids, n_bytes, out = [], [], []
    by = sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))
    count = np.concatenate([np.zeros(0, np.int64), *[_unplanes(c) for _, c in by]])
    for k in range(left.num_rows):
        ids.append(left.column("ids")[k].values)
        n_bytes.append(left.column("n_bytes")[k].values)
        known = np.array(left.column("known")[k].as_py(), np.int64)
        # Counts come in the order of buckets, and within a bucket as the units first occur.
        of_unit = np.empty(len(count), np.int64)
        of_unit[np.argsort(_unplanes(left.column("buckets")[k].as_py()), kind="stable")] = count
        out.append(sums(*[left.column(c)[k].as_py() for c in ("sizes", "steps", "freqs")], known, of_unit))
    kind = left.schema.field("ids").type.value_type
    flat = lambda parts, of: pa.concat_arrays([pa.array([], of), *[x.cast(of) for x in parts]])
    return pa.table([flat(ids, kind), flat(n_bytes, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *out]))], ["doc_id", "n_bytes", "n_tokens"])


def n_tokens(text: Column, path: str) -> Column:
    """The number of tokens of every text under the vocabulary file ``path`` (.json or .model), text by text."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        worker.enter("tokens", _drop)
        if path.endswith(".model"):
            sp = _sentencepiece(path)
            return pa.array([len(sp.encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())
        pieces = pieces_of(path)
        return pa.array([pieces.whole(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A null text counts as empty (0 bytes, 0 tokens).  Rows are independent: null or repeated ids and repeated
    rows are kept as they are.  Special strings inside texts count as the library's default treats them.  An
    empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit("")).alias("text")
    slim = docs.select(F.col(doc_id).alias("doc_id"), whole).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    if path.endswith(".model") or not pieces_of(path).units:
        out = slim.select("doc_id", "n_bytes", n_tokens(F.col("text"), path).alias("n_tokens"))
        return out.withColumn("over_limit", F.col("n_tokens") > limit)
    scratch = Scratch(docs.sparkSession)
    buckets = max(BUCKETS[0], min(BUCKETS[1], docs.count() // ROWS_A_BUCKET))
    kind = slim.schema["doc_id"].dataType.simpleString()
    blocks = scratch.save(slim.mapInArrow(_blocks(path, buckets), _BLOCKS.format(ids=f"ids array<{kind}>,")), "blocks")
    asked = blocks.select("block", F.inline("asked")).select("bucket", "block", "units")
    counted = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted(path), "block bigint, bucket int, counts binary")
    kept = blocks.drop("asked")
    out = kept.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_summed, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
