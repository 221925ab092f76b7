"""Byte-level BPE encoding that encodes what documents share once.

1.  Texts are cut into chunks where a rolling hash of the last 32 bytes says so, hence at the same places wherever
    the same passage stands.  Chunks that occur twice or more over all documents are shared.
2.  Every shared chunk is encoded once.  Its tokens are kept from its first to its last place where every encoding is
    sure to end a token (before a space or line feed behind a character that is no white space), with the text before
    and after.
3.  What lies between a text's shared chunks is encoded where the text is read.  Shared tokens go to the texts that
    asked for them, by text; equal texts ask once.
4.  The joins are repaired: from the last sure place before a join to the first one behind it, over as many chunks as
    lie between, the text is encoded again, so both sides agree with the encoding of the whole text.

A Bloom filter of bounded size tells tasks which chunks may be shared.  What it lets through beyond them is encoded
with the shared ones, so its size changes no result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker
from .scratch import Scratch, small_batches
from .token_count import byte_chars

#: Bytes of a chunk: at least, about (a power of two) beyond that, at most.  The window is shorter than the least chunk.
LEAST, ABOUT, MOST, WINDOW = 128, 512, 8192, 32
#: Bits of the filter, at most (16 MB), and for each shared chunk.
FILTER_BITS, BITS = 1 << 27, 12
#: Bytes hashed, characters encoded and ids decoded at once; join texts and texts seen that a worker remembers.
BLOCK, PIECE, IDS, MEMORY = 1 << 20, 1 << 18, 1 << 20, 200_000
#: Units that a worker remembers, also from task to task, until another operator's batch comes.
UNITS = 800_000

#: Where units begin inside a text, and what speaks against cutting at every space and line feed.
_SURE, _LOOSE = re.compile(r"(?<=\S)[ \n]"), re.compile(r"\s[ \n]")
#: Stands before a key that is a whole unit.  No text holds it, as it is no character.
_BARE = "\ud800"
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def marks(buf: np.ndarray) -> list[int]:
    """Ends of the windows whose hash is marked.  The hash of 32 bits shifts by one a byte, so 32 bytes decide it."""
    shift, out = np.uint32(33 - ABOUT.bit_length()), []
    for at in range(0, len(buf), BLOCK):
        low = max(0, at - WINDOW + 1)
        h = _GEAR[buf[low : at + BLOCK]]
        for step in (1, 2, 4, 8, 16):
            h[step:] += h[:-step] << np.uint32(step)
        found = np.flatnonzero(h >> shift == 0) + low + 1
        out += found[found > at].tolist()
    return out


def cuts(buf: np.ndarray, begin: int, end: int, marked: list[int]) -> list[int]:
    """Where the text in ``buf`` from begin to end is cut, both ends included; characters stay whole."""
    out = [begin]
    while True:
        at = out[-1]
        k = bisect_left(marked, at + LEAST)
        to = min(marked[k] if k < len(marked) else end, at + MOST, end)
        while to < end and buf[to] & 0xC0 == 0x80:
            to += 1
        out.append(to)
        if to >= end:
            return out


def digest(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


def chunked(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[bytes]]]:
    """Each text with its cuts and its chunks' digests."""
    group, size = [], 0
    for t in [*texts, None]:
        if t is None or size >= BLOCK:
            data = b"".join(group)
            buf = np.frombuffer(data, np.uint8)
            marked, at = marks(buf), 0
            for one in group:
                place = cuts(buf, at, at + len(one), marked) if one else [at]
                yield one, [p - at for p in place], [digest(data[a:b]) for a, b in zip(place[:-1], place[1:], strict=True)]
                at += len(one)
            group, size = [], 0
        if t is not None:
            group.append(t)
            size += len(t)


class Filter:
    """A Bloom filter of digests, two places each."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 64 * len(words)

    @staticmethod
    def places(digests: list[bytes], bits: int) -> np.ndarray:
        return (np.frombuffer(b"".join(digests), "<u8") % np.uint64(bits)).reshape(-1, 2)

    def may_hold(self, digests: list[bytes]) -> np.ndarray:
        if not self.bits or not digests:
            return np.zeros(len(digests), bool)
        at = self.places(digests, self.bits)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1).all(1)


def filter_of(shared: DataFrame, n: int) -> Filter:
    """The filter of the ``chunk`` column, OR-ed by word before it reaches the driver (at most FILTER_BITS / 64 words)."""
    if not n:
        return Filter(np.zeros(0, np.uint64))
    bits = min(FILTER_BITS, 1 << max(10, (BITS * n).bit_length()))

    def placed(batches):
        for batch in batches:
            at = Filter.places(batch.column("chunk").to_pylist(), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], ["w", "b"])

    words = shared.mapInArrow(placed, "w bigint, b int").groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return Filter(table.view(np.uint64))


class Encoder:
    """A tokenizer file: ids of strings, bytes of ids, and join texts met before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = str(self.tokenizer.pre_tokenizer or "")
        #: No token goes on past a sure place: byte-level, and no added token takes white space or looks beside itself.
        self.byte_level = (self.tokenizer.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre
            and not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added))
        of = {c: b for b, c in byte_chars().items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        parts = [bytes(map(of.__getitem__, n)) if all(c in of for c in n) else n.encode() for n in names]
        self.size = np.array(list(map(len, parts)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        self.joins: dict[bytes, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        """Units (from one sure place to the next) met before: key -> place of its ids in the pool."""
        self.known: dict[str, int] = {}
        self.unit_ids, self.unit_sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]

    @staticmethod
    def keys(text: str) -> list[str]:
        """A unit's key is its text without the space that it begins with, or with its line feed, or whole behind ``_BARE``."""
        if not text:
            return []
        if not _LOOSE.search(text):
            out = text.replace("\n", " \n").split(" ")
            if text[0] in " \n":
                del out[0]
            else:
                out[0] = _BARE + out[0]
            return out
        at = [0, *[m.start() for m in _SURE.finditer(text)], len(text)]
        units = [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return [u if u[0] == "\n" else _BARE + u if u[0] != " " or u[1:2] == "\n" else u[1:] for u in units]

    def learn(self, keys: list[str], most: int = 256) -> None:
        """Units that begin and end at sure places in any company are encoded many in one text, the others one by one."""
        units = [k[1:] if k[0:1] == _BARE else k if k[:1] == "\n" else " " + k for k in keys]
        some = [k for k, u in enumerate(units) if u[0] in " \n" and not u[-1].isspace()]
        groups = [some[k : k + most] for k in range(0, len(some), most)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(["".join(map(units.__getitem__, g)) for g in groups], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(got), np.int64)
        upto, want = self.size[flat].cumsum(), np.cumsum([len(units[k].encode()) for k in some])
        stop = np.searchsorted(upto, want)
        if len(some) and (stop[-1] + 1 != len(flat) or (upto[stop] != want).any()):  # tokens that are not bytes of the text: none is told apart
            some, flat, stop = [], flat[:0], stop[:0]
        done = set(some)
        rest = [k for k in range(len(units)) if k not in done]
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([units[k] for k in rest], add_special_tokens=False)]
        self.known.update(zip(map(keys.__getitem__, [*some, *rest]), range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.unit_sizes += [np.diff(stop, prepend=-1), np.fromiter(map(len, alone), np.int64, len(alone))]
        self.unit_ids += [flat.astype(np.uint32), np.fromiter(chain.from_iterable(alone), np.uint32)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin and end at sure places."""
        out, at = [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and size < 4 * PIECE:
                size += len(texts[to])
                to += 1
            if to == at + 1 and size > 8 * PIECE:  # one long text, in parts
                cut = [0]
                while cut[-1] < size:
                    cut.append(next_sure(texts[at], min(size, cut[-1] + 4 * PIECE)))
                out.append(np.concatenate([self._ids([texts[at][a:b]])[0] for a, b in zip(cut[:-1], cut[1:], strict=True)]))
            else:
                out += self._ids(texts[at:to])
            at = to
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > UNITS:
            self.forget()
        split = list(map(self.keys, texts))
        flat = list(chain.from_iterable(split))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            fresh = list(dict.fromkeys(map(flat.__getitem__, new)))
            for k in range(0, len(fresh), 8192):
                self.learn(fresh[k : k + 8192])
            at[new] = np.fromiter((self.known[flat[i]] for i in new), np.int64, len(new))
        self.unit_ids, self.unit_sizes = [np.concatenate(self.unit_ids)], [np.concatenate(self.unit_sizes)]
        size = self.unit_sizes[0][at]
        start = (np.cumsum(self.unit_sizes[0]) - self.unit_sizes[0])[at]
        ends = np.cumsum(size)
        ids = self.unit_ids[0][np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]
        total = np.concatenate(([0], ends))[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(total[:-1], total[1:], strict=True)]

    def joins_of(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of the texts around joins, all at once; short ones are remembered."""
        fresh = [t for t in dict.fromkeys(texts) if t not in self.joins]
        found = dict(zip(fresh, self.ids([t.decode() for t in fresh]), strict=True))
        out = {t: found[t] if t in found else self.joins[t] for t in texts}
        if len(self.joins) > MEMORY:
            self.joins.clear()
        self.joins.update((t, x) for t, x in found.items() if len(t) <= 64)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for k in range(0, len(ids), IDS):
            some = ids[k : k + IDS]
            size = self.size[some]
            ends = np.cumsum(size)
            out.append(self.pool[np.arange(ends[-1]) + np.repeat(self.start[some] - ends + size, size)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def next_sure(text: str, at: int) -> int:
    """The first sure place from ``at`` on, or the end: before a space or line feed behind a character that is no white space."""
    while True:
        a, b = text.find(" ", at), text.find("\n", at)
        at = min(x for x in (a, b, len(text)) if x >= 0)
        if at == len(text) or at and not text[at - 1].isspace():
            return at
        at += 1


def last_sure(text: str) -> int:
    """The last sure place, or -1."""
    at = len(text)
    while True:
        at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at))
        if at <= 0 or not text[at - 1].isspace():
            return at if at > 0 else -1


#: A part of a text: a shared chunk's digest alone; or the text before its first and behind its last sure place and the
#: ids between them; or, without a sure place, its whole text and None.
Part = tuple[bytes | None, bytes, np.ndarray | None, bytes]


def parts_of(runs: list[tuple[str, bool, bool]], code: Encoder) -> list[Part]:
    """Parts of runs of text.  The flags tell whether a run begins and ends its document, which are sure places too."""
    places = []
    for text, first, last in runs:
        a, b = 0 if first else next_sure(text, 0), len(text) if last else last_sure(text)
        places.append((a, b) if a <= b else None)
    middles = iter(code.ids([text[p[0] : p[1]] for (text, _, _), p in zip(runs, places, strict=True) if p]))
    return [(None, text[: p[0]].encode(), next(middles), text[p[1] :].encode()) if p else (None, text.encode(), None, b"")
            for (text, _, _), p in zip(runs, places, strict=True)]


def pack(parts: list[Part]) -> bytes:
    info = np.array([(0 if ref else 1 if ids is not None else 2, len(head), len(tail), 0 if ids is None else len(ids)) for ref, head, ids, tail in parts], "<u4")
    small = zlib.compress(info.tobytes() + b"".join(ref or head + tail for ref, head, _, tail in parts), 1)
    ids = np.concatenate([np.zeros(0, np.uint32), *[x for _, _, x, _ in parts if x is not None]])
    wide = 4 if len(ids) and ids.max() > 65535 else 2
    planes = ids.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes()
    return struct.pack("<IIB", len(parts), len(small), wide) + small + zlib.compress(planes, 1)


def unpack(data: bytes) -> list[Part]:
    n, size, wide = struct.unpack_from("<IIB", data)
    small = zlib.decompress(data[9 : 9 + size])
    info = np.frombuffer(small, "<u4", 4 * n).reshape(-1, 4).tolist()
    planes = np.frombuffer(zlib.decompress(data[9 + size :]), np.uint8).reshape(wide, -1).T
    ids = np.ascontiguousarray(planes).view(f"<u{wide}").ravel().astype(np.uint32)
    out, at, k = [], 16 * n, 0
    for kind, head, tail, count in info:
        if kind == 0:
            out.append((small[at : at + 16], b"", None, b""))
            at += 16
            continue
        out.append((None, small[at : at + head], ids[k : k + count] if kind == 1 else None, small[at + head : at + head + tail]))
        at += head + tail
        k += count
    return out


def planned(parts: list[Part], shared: dict[bytes, Part]) -> list[bytes | np.ndarray]:
    """A text's ids in order, and between them the text from the sure place before each join to the first one behind it."""
    out, pending = [], []
    for part in parts:
        _, head, ids, tail = shared[part[0]] if part[0] else part
        pending.append(head)
        if ids is not None:
            out += [b"".join(pending), ids]
            pending = [tail]
    out.append(b"".join(pending))
    return out


def joined(plans: list[list[bytes | np.ndarray]], code: Encoder) -> list[np.ndarray]:
    """Texts' ids: what lies around joins is encoded again."""
    known = code.joins_of([x for plan in plans for x in plan if isinstance(x, bytes)])
    return [np.concatenate([known[x] if isinstance(x, bytes) else x for x in plan]) for plan in plans]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _digests(batches: Iterator[pa.RecordBatch]):
    """Each text's key with its chunks' digests, one after another."""
    for batch in batches:
        digests = [b"".join(d) for _, _, d in chunked(_texts(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(digests, pa.binary())], ["key", "digests"])


def _apart(digests: bytes) -> list[bytes]:
    return [digests[k : k + 16] for k in range(0, len(digests), 16)]


def _counted(batches: Iterator[pa.RecordBatch]):
    """Chunks of texts, with how often a batch has them."""
    for batch in batches:
        n: dict[bytes, int] = {}
        for digests in batch.column("digests").to_pylist():
            for d in _apart(digests):
                n[d] = n.get(d, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["chunk", "n"])


class _Seen:
    """What a task has met of late: it spares repeats, and forgetting costs no more than a repeat."""

    def __init__(self):
        self.held: set = set()

    def new(self, x) -> bool:
        if x in self.held:
            return False
        if len(self.held) >= MEMORY:
            self.held.clear()
        self.held.add(x)
        return True


def _chunk_texts(shared):
    def run(batches):
        seen = _Seen()
        for batch in batches:
            out = []
            for text, at, digests in chunked(_texts(batch)):
                out += [(digests[k], text[at[k] : at[k + 1]]) for k in np.flatnonzero(shared.value.may_hold(digests)).tolist() if seen.new(digests[k])]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)], ["chunk", "text"])

    return run


def _asked(shared):
    def run(batches):
        seen = _Seen()
        for batch in batches:
            out = []
            for key, digests in zip(batch.column("key").to_pylist(), map(_apart, batch.column("digests").to_pylist()), strict=True):
                if digests and seen.new(key):
                    out += [(key, d) for d in {digests[k] for k in np.flatnonzero(shared.value.may_hold(digests)).tolist()}]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)], ["key", "chunk"])

    return run


def _encoded_chunks(path: str):
    def run(batches):
        worker.enter("chunks", encoder.cache_clear)
        code = encoder(path)
        for batch in batches:
            parts = parts_of([(t.decode(), False, False) for t in batch.column("text").to_pylist()], code)
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([pack([p]) for p in parts], pa.binary())], ["chunk", "data"])

    return run


def _own_parts(path: str, shared):
    """Each text's parts: shared chunks by digest, the rest encoded."""

    def run(batches):
        worker.enter("chunks", encoder.cache_clear)
        code, seen = encoder(path), _Seen()
        for batch in batches:
            keys, plans, runs = [], [], []
            for key, (text, at, digests) in zip(batch.column("key").to_pylist(), chunked(_texts(batch)), strict=True):
                if not seen.new(key):
                    continue
                plan, k = [], 0
                held = shared.value.may_hold(digests).tolist()
                while k < len(digests):
                    if held[k]:
                        plan.append(digests[k])
                        k += 1
                        continue
                    end = next((j for j in range(k, len(digests)) if held[j]), len(digests))
                    plan.append(None)
                    runs.append((text[at[k] : at[end]].decode(), k == 0, end == len(digests)))
                    k = end
                keys.append(key)
                plans.append(plan)
            own = iter(parts_of(runs, code))
            data = [pack([(d, b"", None, b"") if d else next(own) for d in plan]) for plan in plans]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["key", "data"])

    return run


def _repaired(path: str):
    """Over rows by key, shared chunks first: one row (key, ids, decoded) for each text."""

    def run(batches):
        worker.enter("chunks", encoder.cache_clear)
        code, at, held, done = encoder(path), None, {}, False
        for batch in batches:
            keys, plans = [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "chunk", "data")]
            for key, chunk, data in zip(*columns, strict=True):
                if key != at:
                    at, held, done = key, {}, False
                if chunk is not None:
                    held[chunk] = data
                elif not done:
                    parts = unpack(data)
                    keys.append(key)
                    plans.append(planned(parts, {p[0]: unpack(held[p[0]])[0] for p in parts if p[0]}))
                    held, done = {}, True
            out, size = [], 0
            for key, ids in zip(keys, joined(plans, code), strict=True):
                out.append((key, ids.astype("<u4").tobytes(), code.decode(ids)))
                size += 4 * len(ids) + len(out[-1][2])
                if size > 8 * BLOCK:
                    yield _rows(out)
                    out, size = [], 0
            yield _rows(out)

    return run


def _rows(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.string()))], ["key", "ids", "decoded"])


def text_key(text: Column) -> Column:
    """What tells texts apart: 128 bits of their SHA-256; a null text is an empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """key (``text_key``), ids (little-endian unsigned 32-bit), decoded: one row for each different text of ``docs`` (null: empty).

    Ids are the library's for the whole text without begin, end, truncation and padding, special strings inside
    texts being the special tokens; ``decoded`` is what they decode to, special tokens included.  Vocabularies of
    another kind than byte-level are encoded text by text.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(text_key(F.col("text")).alias("key"), whole.alias("text"))
    if not encoder(path).byte_level:
        return texts.dropDuplicates(["key"]).mapInArrow(_by_library(path), "key binary, ids binary, decoded string")
    scratch = Scratch(spark)
    cut = scratch.save(texts.mapInArrow(_digests, "key binary, digests binary"), "cut")
    counted = cut.mapInArrow(_counted, "chunk binary, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))
    shared = scratch.save(counted.where("n > 1").select("chunk"), "shared")
    may = spark.sparkContext.broadcast(filter_of(shared, shared.count()))
    scratch.drop("shared")
    once = texts.select("text").mapInArrow(_chunk_texts(may), "chunk binary, text binary").groupBy("chunk").agg(F.first("text").alias("text"))
    table = once.mapInArrow(_encoded_chunks(path), "chunk binary, data binary")
    asked = cut.mapInArrow(_asked(may), "key binary, chunk binary").dropDuplicates(["key", "chunk"])
    parts = asked.join(table, "chunk").select("key", "chunk", "data")
    own = texts.mapInArrow(_own_parts(path, may), "key binary, data binary").select("key", F.lit(None).cast("binary").alias("chunk"), "data")
    met = parts.unionByName(own).repartition("key").sortWithinPartitions("key", F.col("chunk").asc_nulls_last())
    return met.mapInArrow(_repaired(path), "key binary, ids binary, decoded string")


def _by_library(path: str):
    def run(batches):
        worker.enter("chunks", encoder.cache_clear)
        code = encoder(path).tokenizer
        for batch in batches:
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = code.encode(text, add_special_tokens=False).ids
                out.append((key, np.array(ids, "<u4").tobytes(), code.decode(ids, skip_special_tokens=False)))
            yield _rows(out)

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded of every row of ``docs`` (doc_id, text), as ``encode_texts`` gives them.

    Null or repeated ids and repeated rows are kept; a null text has no ids and an empty decoded text; other columns
    are not read.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return rows.join(encode_texts(docs, path), "key").select("doc_id", "ids", "decoded")
