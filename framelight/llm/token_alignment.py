"""Alignment of two tokenizers' tokens by bytes, with corpus-wide counts of linked ids.

1.  Each text, with a space before it, is cut into units where both tokenizers are sure to end a token.  A unit that
    a worker does not remember is encoded by both; the byte offsets where their tokens end give its groups and links
    (each stretch between two neighbouring ends is one link).  A document's figures are its units' together.
2.  A block of documents (an Arrow batch) keeps the multiplicities of its documents' id pairs, packed by bucket of
    the B id: the postings.
3.  Pair totals are added up over all blocks.  The totals and the postings of a bucket meet in one sorted stream,
    totals first: a task holds one bucket's totals, finds each B id's highest, and lets the postings pass by, however
    many.  Buckets of many postings are dealt to several streams, each with the totals.
4.  What a stream says of a block's documents is added up by document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker
from .scratch import Scratch, small_batches
from .sentencepiece_codec import BYTE, MARK, NORMAL, UNUSED, USER, Model
from .token_count import _planes, _unplanes, byte_chars

#: Buckets of B ids; bytes of packed postings that one stream takes, about.
BUCKETS, STREAM = 32, 64 << 20
#: Units a worker remembers between blocks; units that are encoded in one call; characters of texts that are looked at together.
MEMORY, CHUNK, PIECE = 400_000, 8_192, 1 << 20

#: Before a space or line feed behind a character that is no white space no token of either kind goes on.
_CUT = re.compile(r"(?<=\S) ")
_CUT_LINES = re.compile(r"(?<=\S)[ \n]")
_LOOSE = re.compile(r"\s[ \n]|\A[ \n]")
#: Stands before a key whose unit begins with a space and a line feed.  No text holds it, as it is no character.
_SPACED = "\ud800"


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each row, all values, the row of each value)"""
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    return n, np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum())), np.repeat(np.arange(len(rows)), n)


class _Pool:
    """Bytes of a vocabulary's tokens."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array(list(map(len, tokens)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def agrees(self, ids: list[list[int]], texts: list[bytes]) -> np.ndarray:
        """Whether the tokens' bytes together are the text, for each."""
        want = np.fromiter(map(len, texts), np.int64, len(texts))
        _, flat, owner = _flat(ids)
        out = np.bincount(owner, self.size[flat], len(texts)).astype(np.int64) == want
        flat, owner = flat[out[owner]], np.flatnonzero(out)
        size = self.size[flat]
        ends = np.cumsum(size)
        got = self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[flat] - ends + size, size)]
        wrong = got != np.frombuffer(b"".join(texts[k] for k in owner.tolist()), np.uint8)
        out[np.repeat(owner, want[owner])[wrong]] = False
        return out


class Aligner:
    """Two tokenizer files (A of tokenizers, B of sentencepiece) and the units met so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_b, "rb") as f:
            model = Model(f.read())
        self.prefix = model.dummy_prefix
        of_char = {c: b for b, c in byte_chars().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [bytes(map(of_char.__getitem__, n)) if all(c in of_char for c in n) else n.encode() for n in names]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        self.pool_a, self.pool_b = _Pool(self.bytes_a), _Pool(self.bytes_b)
        # Ids as they are shown, with what may follow them.
        shown = lambda n, ends: [np.array([f"{i}{e}" for i in range(n)], object) for e in ends]
        self.text_a, self.text_b = shown(len(self.bytes_a), ",|"), shown(len(self.bytes_b), (",", ";", ""))
        pre = str(self.a.pre_tokenizer or "")
        own = [p for p, _, kind in model.pieces if kind in (NORMAL, USER, UNUSED)]
        byte_level = self.a.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre
        #: Texts are cut into units if that changes no token; else a text is one unit.
        self.cuts = byte_level and model.units and self.prefix and not model.squeeze and not model.charsmap
        self.lines = not any("\n" in p for p in own)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[str] = []
        #: By unit: tokens of A and B, groups, links, whether all bytes agree; then the links' pairs, A's id before B's.
        self.figures, self.links = [np.zeros((0, 5), np.int64)], [np.zeros(0, np.int64)]

    def keys(self, text: str) -> list[str]:
        """A unit's key is its text without the space before it, or with the line feed that it begins with."""
        if not self.cuts:
            return [text]
        if not _LOOSE.search(text):
            return (text.replace("\n", " \n") if self.lines else text).split(" ")
        if not self.lines:
            return [_SPACED + k if k[:1] == "\n" else k for k in _CUT.split(text)]
        at = [0, *[m.start() for m in _CUT_LINES.finditer(text)], len(text)]
        units = [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        first = [_SPACED + units[0] if units[0][:1] == "\n" else units[0]]
        return first + [u if u[0] == "\n" else _SPACED + u[1:] if u[1:2] == "\n" else u[1:] for u in units[1:]]

    def learn(self, keys: list[str]) -> None:
        bare = [k[:1] == "\n" and self.cuts and self.lines for k in keys]
        texts = [k[1:] if k[:1] == _SPACED else k for k in keys]
        units = [k if no else " " + k for k, no in zip(texts, bare, strict=True)]
        whole = [u.encode() for u in units]
        parts = [self._together(units, whole, bare)] if self.cuts else []
        done = set(parts[0][0].tolist()) if parts else set()
        parts.append(self._apart([k for k in range(len(units)) if k not in done], units, whole, bare))
        good, n_a, a, n_b, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        figures, owner = np.zeros((len(keys), 5), np.int64), np.repeat(np.arange(len(good)), n_a)
        bad = sorted(set(range(len(keys))) - set(good.tolist()))
        # Over the good units' bytes one after another: the units' ends are ends of both.
        ends_a, ends_b = self.pool_a.size[a].cumsum(), self.pool_b.size[b].cumsum()
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = np.flatnonzero((ends_a[at_a] == ends) & (ends_b[at_b] == ends))
        per = lambda at: np.bincount(owner[at_a[at]], minlength=len(good))
        figures[: len(good)] = np.stack([n_a, n_b, per(both), per(slice(None)), np.ones(len(good), np.int64)], 1)
        # Tokens in the order in which groups show them, each with what follows it there.
        last_a, last_b = np.zeros(len(a), np.int8), np.zeros(len(b), np.int8)
        last_a[at_a[both]], last_b[at_b[both]] = 1, 1
        last_b[np.cumsum(n_b) - 1] = 2
        group_a, group_b = (np.cumsum(x > 0) - (x > 0) for x in (last_a, last_b))
        text = np.concatenate([np.where(last_a == 1, self.text_a[1][a], self.text_a[0][a]),
            np.choose(last_b, [t[b] for t in self.text_b]) if len(b) else np.zeros(0, object)])
        text = text[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        upto = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        self.shown += ["".join(text[i:j]) for i, j in zip(upto[:-1], upto[1:], strict=True)] + [""] * len(bad)
        self.known.update(zip(map(keys.__getitem__, [*good.tolist(), *bad]), range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.figures.append(figures)
        self.links.append(a[at_a] << 32 | b[at_b])

    def _together(self, units: list[str], whole: list[bytes], bare: list[bool], most: int = 256) -> tuple[np.ndarray, ...]:
        """(units, tokens of each, A's ids, tokens of each, B's ids) of units that end in no white space, encoded many in one text."""
        some = [k for k, u in enumerate(units) if not u[-1].isspace()]
        some = [k for k in some if not bare[k]] + [k for k in some if bare[k]]
        n = -(-len(some) // most)
        groups = [some[k::n] for k in range(n)]
        groups = [g for g in groups if not bare[g[0]]]  # the marker before a text is that of its first unit's space
        texts = ["".join(map(units.__getitem__, g)) for g in groups]
        got_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        got_b = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        joined = [t.encode() for t in texts]
        fine = np.flatnonzero(self.pool_a.agrees(got_a, joined) & self.pool_b.agrees(got_b, joined)).tolist()
        out = []
        for pool, got in ((self.pool_a, got_a), (self.pool_b, got_b)):
            _, flat, _ = _flat([got[k] for k in fine])
            out.append((flat, pool.size[flat].cumsum()))
        at = np.array([k for g in fine for k in groups[g]], np.int64)
        ends = np.cumsum([len(whole[k]) for k in at.tolist()])
        counts = []
        for flat, upto in out:
            stop = np.searchsorted(upto, ends)
            if len(ends) and (upto[np.minimum(stop, len(upto) - 1)] != ends).any():  # a token reaches over a unit's end
                return (np.zeros(0, np.int64),) * 5
            counts.append(np.diff(stop, prepend=-1))
        return at, counts[0], out[0][0], counts[1], out[1][0]

    def _apart(self, some: list[int], units: list[str], whole: list[bytes], bare: list[bool]) -> tuple[np.ndarray, ...]:
        """The same of units that are encoded one by one and whose bytes agree."""
        got_a = [e.ids for e in self.a.encode_batch_fast([units[k] for k in some], add_special_tokens=False)]
        got_b = self.b.encode([units[k] if bare[k] or not self.prefix else units[k][1:] for k in some], num_threads=1) if some else []
        for i, k in enumerate(some):
            if bare[k]:  # the marker that the library puts before every text is not the unit's
                got_b[i] = got_b[i][1:] if self.bytes_b[got_b[i][0]] == b" " else []
            elif units[k] == " " and not got_b[i]:  # nor does it put one before nothing
                got_b[i] = [self.b.piece_to_id(MARK)]
        texts = [whole[k] for k in some]
        good = np.flatnonzero(self.pool_a.agrees(got_a, texts) & self.pool_b.agrees(got_b, texts)).tolist()
        n_a, a, _ = _flat([got_a[i] for i in good])
        n_b, b, _ = _flat([got_b[i] for i in good])
        return np.array([some[i] for i in good], np.int64), n_a, a, n_b, b

    def look(self, texts: list[str]) -> tuple[np.ndarray, list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: figures (the last: units whose bytes disagree), groups by unit; then all (pair, text, multiplicity)."""
        if len(self.known) > MEMORY:
            self.forget()
        split = list(map(self.keys, texts))
        n = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(at < 0).tolist()
        fresh = list(dict.fromkeys(map(flat.__getitem__, new)))
        for k in range(0, len(fresh), CHUNK):
            self.learn(fresh[k : k + CHUNK])
        if new:
            at[new] = np.fromiter((self.known[flat[i]] for i in new), np.int64, len(new))
        self.figures, self.links = [np.concatenate(self.figures)], [np.concatenate(self.links)]
        figures, links = self.figures[0], self.links[0]
        upto = np.concatenate(([0], np.cumsum(n)))
        run = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(figures[at], 0)))
        out = run[upto[1:]] - run[upto[:-1]]
        out[:, 4] = n - out[:, 4]
        rows = at.tolist()
        shown = [list(map(self.shown.__getitem__, rows[a:b])) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        # Units of a text count once with their frequency, and so do their links.
        code, times = np.unique(np.repeat(np.arange(len(texts)), n) * max(1, len(figures)) + at, return_counts=True)
        text, unit = code // max(1, len(figures)), code % max(1, len(figures))
        starts = np.cumsum(figures[:, 3]) - figures[:, 3]
        size = figures[unit, 3]
        ends = np.cumsum(size)
        pair = links[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[unit] - ends + size, size)]
        return out, shown, pair, np.repeat(text, size), np.repeat(times, size)


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
    return Aligner(path_a, path_b)


def _added(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(weight, first)


def _pieces(text: str, cuts: bool) -> Iterator[tuple[str, bool]]:
    """(piece, whether its space before was cut off with it): long texts in parts, cut as units are."""
    at = 0
    while cuts and len(text) - at > PIECE:
        space = _CUT.search(text, at + PIECE)
        if not space:
            break
        yield text[at : space.start()]
        at = space.end()
    yield text[at:]


def _groups(texts: list[str | None], cuts: bool) -> Iterator[list[tuple[int, str]]]:
    """(place, piece) lists of about PIECE characters together."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for piece in _pieces(t, cuts) if t else ():
            held.append((i, piece))
            size += len(piece)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def bucket_of(b: np.ndarray, buckets: int) -> np.ndarray:
    """B ids spread over buckets: frequent ids lie close together in most vocabularies."""
    return (b * 2654435761 >> 16) % buckets


def align_block(texts: list[str | None], aligner: Aligner, buckets: int) -> tuple[np.ndarray, list[str], list[tuple[int, bytes]]]:
    """(n_a, n_b, n_groups, n_links) and sha256 of the groups of each text; postings by bucket."""
    n = len(texts)
    figures = np.zeros((n, 5), np.int64)
    digests: dict[int, object] = {}
    triples = []
    for group in _groups(texts, aligner.cuts):
        some, shown, pair, text, times = aligner.look([t for _, t in group])
        place = np.array([i for i, _ in group])
        np.add.at(figures, place, some)
        for (i, _), parts in zip(group, shown, strict=True):
            if i in digests:
                digests[i].update(b";")
            digests.setdefault(i, hashlib.sha256()).update(";".join(parts).encode())
        code, at = np.unique(pair, return_inverse=True)
        key, times = _added(at * n + place[text], times)
        triples.append((code[key // n], key % n, times))
    bad = figures[:, 4] > 0
    figures[bad] = 0
    shown = [digests[i].hexdigest() if figures[i, 0] else "" for i in range(n)]
    code, doc, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*triples, strict=True)) if triples else [np.zeros(0, np.int64)] * 3
    some, at = np.unique(code, return_inverse=True)
    at, doc, times = at[~bad[doc]], doc[~bad[doc]], times[~bad[doc]]
    key, times = _added(at * max(1, n) + doc, times)
    at, doc = key // max(1, n), key % max(1, n)
    bucket = bucket_of(some & 0xFFFFFFFF, buckets)
    order = np.argsort(bucket[at], kind="stable")
    at, doc, times = at[order], doc[order], times[order]
    edges = np.searchsorted(bucket[at], np.arange(buckets + 1))
    out = []
    for k in range(buckets):
        i, j = edges[k], edges[k + 1]
        if i < j:
            out.append((k, pack(n, some[at[i:j]], doc[i:j], times[i:j])))
    return figures[:, :4], shown, out


def pack(n: int, code: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Postings sorted by (code, doc): distinct codes, documents of each, steps between them, multiplicities."""
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    some, size = code[first], np.diff(np.concatenate((first, [len(code)])))
    step = np.diff(doc, prepend=0)
    step[first] = doc[first]
    parts = [_planes(x) for x in (some >> 32, some & 0xFFFFFFFF, size, step, times)]
    head = np.array([n, *map(len, parts)], "<u4").tobytes()
    return head + b"".join(parts)


def unpack(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents of the block, distinct codes, first posting of each, document and multiplicity of each posting)"""
    n, *sizes = np.frombuffer(data, "<u4", 6).tolist()
    ends = np.cumsum([24, *sizes]).tolist()
    a, b, size, step, times = (_unplanes(data[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True))
    first = np.cumsum(size) - size
    run = np.cumsum(step)
    return n, a << 32 | b, first, run - np.repeat(run[first] - step[first], size), times


_DOCS = "docs array<struct<doc_id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>"
_BLOCKS = "block bigint, {docs}, postings array<struct<bucket:int,data:binary>>"


def _blocks(path_a: str, path_b: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        worker.enter("alignment", _aligner.cache_clear)
        aligner, base = _aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for k, batch in enumerate(batches):
            figures, shown, postings = align_block(batch.column("text").to_pylist(), aligner, buckets)
            columns = [pa.array(x) for x in figures.T.copy()]
            docs = pa.StructArray.from_arrays([batch.column("doc_id"), *columns, pa.array(shown, pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            packed = pa.StructArray.from_arrays([pa.array([b for b, _ in postings], pa.int32()), pa.array([d for _, d in postings], pa.binary())],
                ["bucket", "data"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([base + k]), one(docs), one(packed)], ["block", "docs", "postings"])
        worker.leave()

    return run


def _totals(batches: Iterator[pa.RecordBatch]):
    """Pair totals of postings."""
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
            _, code, first, _, times = unpack(data)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), bucket, np.int32)), pa.array(code), pa.array(np.add.reduceat(times, first))],
                ["bucket", "code", "count"])


def _sums(n: int, doc: np.ndarray, times: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of times * count by document, exact: halves of the counts are added up in doubles below 2^53."""
    low = np.bincount(doc, times * (count & 0x3FFFFFF), n).astype(np.int64)
    return low + (np.bincount(doc, times * (count >> 26), n).astype(np.int64) << 26)


def _stream(batches: Iterator[pa.RecordBatch]):
    """Rows by (bucket, stream): totals by B id, then postings.  One packed row of contributions for each posting row."""
    at, parts, code, count, best = None, [], None, None, None
    for batch in batches:
        out = []
        keys = batch.column("bucket").to_numpy().astype(np.int64) << 32 | batch.column("stream").to_numpy()
        total = batch.column("kind").to_numpy() == 0
        edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (total[1:] != total[:-1]) | ~total[1:])))
        for i, j in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
            if keys[i] != at:
                at, parts, code = keys[i], [], None
            if total[i]:
                parts.append((batch.column("code").slice(i, j - i).to_numpy(), batch.column("count").slice(i, j - i).to_numpy()))
                continue
            if code is None:
                code, count = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(code & 0xFFFFFFFF, kind="stable")
                b = (code & 0xFFFFFFFF)[order]
                first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
                highest = np.empty(len(code), np.int64)
                highest[order] = np.repeat(np.maximum.reduceat(count[order], first), np.diff(np.concatenate((first, [len(b)]))))
                best = count == highest
                order = np.argsort(code)
                code, count, best, parts = code[order], count[order], best[order], []
            n, some, first, doc, times = unpack(batch.column("data")[i].as_py())
            where = np.repeat(np.searchsorted(code, some), np.diff(np.concatenate((first, [len(doc)]))))
            whole = _sums(n, doc, times, count[where])
            data = [_planes(x) for x in (np.bincount(doc, times * best[where], n), whole & 0xFFFFFFFF, whole >> 32)]
            out.append((batch.column("block")[i].as_py(), *data))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["block", "best", "low", "high"])


def _documents(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with the contributions of all streams."""
    docs = left.column("docs").combine_chunks().flatten()
    best, whole = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for b, low, high in zip(*[right.column(c).to_pylist() for c in ("best", "low", "high")], strict=True):
        best += _unplanes(b)
        whole += _unplanes(low) | _unplanes(high) << 32
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    columns = [docs.field(k) for k in range(5)] + [pa.array(best), pa.array(whole), docs.field(5)]
    return pa.table(columns, [*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, path_a: str, path_b: str, buckets: int = BUCKETS, stream: int = STREAM) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs`` (doc_id, text).

    A encodes a space and the text, B the text (a model that puts a space before it; else a space and the text),
    both without special tokens, whose strings are plain text.  ``n_best`` and ``count_sum`` are sums over the row's
    links of whether, and of how many, links of all rows hold the link's id pair.  A null or empty text, and one whose
    joined bytes differ from the space and the text under either tokenizer, has zeros, '' and no part in the counts.
    Rows are independent: null or repeated ids and repeated rows are kept, and repeated rows count again.  An empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "text")
    blocks = scratch.save(slim.mapInArrow(_blocks(path_a, path_b, buckets), _BLOCKS.format(docs=_DOCS.format(kind=kind))), "blocks")
    postings = blocks.select("block", F.inline("postings"))
    summed = postings.select("bucket", "data").mapInArrow(_totals, "bucket int, code bigint, count bigint").groupBy("bucket", "code")
    totals = scratch.save(summed.agg(F.sum("count").alias("count")), "totals")
    # A row for each of a fixed number of buckets.
    weight = {r.bucket: r.w for r in postings.groupBy("bucket").agg(F.sum(F.octet_length("data").cast("long")).alias("w")).collect()}
    pairs = {r.bucket: r.n for r in totals.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    # A stream takes four times its totals' bytes at least, so that repeating them stays cheap.
    streams = [max(1, -(-weight.get(k, 0) // max(stream, 64 * pairs.get(k, 0)))) for k in range(buckets)]
    n = F.get(F.array(*map(F.lit, streams)), F.col("bucket"))
    null = lambda t: F.lit(None).cast(t)
    first = totals.select("bucket", F.explode(F.sequence(F.lit(0), n - 1)).alias("stream"), F.lit(0).alias("kind"), null("bigint").alias("block"), "code",
        "count", null("binary").alias("data"))
    then = postings.select("bucket", F.pmod(F.xxhash64("block"), n).cast("int").alias("stream"), F.lit(1).alias("kind"), "block", null("bigint").alias("code"),
        null("bigint").alias("count"), "data")
    met = first.unionByName(then).repartition("bucket", "stream").sortWithinPartitions("bucket", "stream", "kind", "block")
    said = met.mapInArrow(_stream, "block bigint, best binary, low binary, high binary")
    out = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return blocks.select("block", "docs").groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_documents, out)
