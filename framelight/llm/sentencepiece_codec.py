"""SentencePiece models on the ``tokenizers`` backend.

The model protobuf is parsed here (pieces, scores, types, trainer and normaliser fields).  From it a
``tokenizers`` pipeline is rebuilt: the normaliser (character map, white-space squeezing, dummy
prefix, U+2581 marker), a unigram model with its scores or a BPE model whose merges follow the scores,
byte fallback, and the matching decoder.

Where no piece has the marker after another character, no merge crosses the start of a marker run, and
where no piece holds a line feed, none crosses one.  So a text is encoded unit by unit: each distinct
unit that a worker does not remember goes once through ``encode_batch`` (which is multithreaded), is held
against the sentencepiece library (parity) and decoded (round trip).  Tables are looked up in arrays.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker
from .scratch import small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct units a Python worker remembers between blocks; beyond them the less used half is forgotten.
MEMORY = 200_000
#: Units that are encoded in one call, at most: the library keeps a record of each token until the call ends.
CHUNK = 4_096


def _fields(data: bytes):
    """(field number, value) pairs of one protobuf message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind == 5:
            yield tag >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            raise ValueError(f"wire type {kind}")


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk_id = 1, False, 0
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        trainer, normal = {}, {}  # a message that comes in parts is merged
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif field == 2:
                trainer |= dict(_fields(value))
                self.kind = trainer.get(3, 1)
                self.byte_fallback = bool(trainer.get(35, 0))
                self.unk_id = trainer.get(40, 0)
            elif field == 3:
                normal |= dict(_fields(value))
                self.charsmap = normal.get(2, b"")
                self.dummy_prefix = bool(normal.get(3, 1))
                self.squeeze = bool(normal.get(4, 1))
                self.escape = bool(normal.get(5, 1))
        own = [p for p, _, kind in self.pieces if kind in (NORMAL, USER, UNUSED)]
        self.units = self.escape and not any(MARK in p.lstrip(MARK) for p in own)
        #: No piece holds a line feed, so no merge crosses one.
        self.lines = not any("\n" in p for p in own)

    def merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two pieces, best score of the result first."""
        score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER, UNUSED)}
        rank = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        found = [(-score[p], rank[p[:k]], rank[p[k:]], p[:k], p[k:]) for p in score for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        unk = self.pieces[self.unk_id][0] if self.pieces else None
        if self.kind == 1:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        elif self.kind == 2:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models have a tokenizers form")
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        if self.units:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*" if self.lines else f"{MARK}+[^{MARK}]*"), "isolated")
        tail = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
        return out


#: A unit is a run of spaces, or a line feed, with what follows up to the next of either.
_UNIT = re.compile(" +[^ \n]*|\n[^ \n]*")
_PLAIN_UNIT = re.compile(" +[^ ]*")
_BETWEEN = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
#: Characters of a text that are cut into units at once.
PIECE = 1 << 20


class Codec:
    """Encoding and decoding with one model file, checked against the sentencepiece library."""

    def __init__(self, path: str, threads: int = 1):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.threads = threads
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokenizer = self.model.tokenizer()
        #: A text is its units, each with the space before it, if the normaliser changes nothing else.
        self.by_unit = self.model.units and self.model.dummy_prefix and not self.model.squeeze and not self.model.charsmap
        mark = self.tokenizer.token_to_id(MARK)
        # Key of a unit (without its first space) -> its place in the tables.  "" is a space before an end: the marker alone.
        self.known = {"": 0}
        self.pool = [np.array([] if mark is None else [mark], np.int32)]
        self.sizes = [np.array([len(self.pool[0])])]
        self.good = [np.array([mark is not None])]
        self.back = [np.array([mark is not None])]
        self.uses = np.zeros(0, np.int64)

    def _settle(self) -> None:
        for name in ("pool", "sizes", "good", "back"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        self.uses = np.concatenate([self.uses, np.zeros(len(self.known) - len(self.uses), np.int64)])

    def _forget(self, keep: int) -> None:
        """Keeps the ``keep`` most used units (and the marker alone)."""
        self._settle()
        self.uses[0] = np.iinfo(np.int64).max // 2
        stay = np.sort(np.argsort(-self.uses, kind="stable")[:keep])
        sizes = self.sizes[0]
        starts = np.cumsum(sizes) - sizes
        n = sizes[stay]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(starts[stay] - ends + n, n)
        keys = list(self.known)
        self.known = {keys[k]: i for i, k in enumerate(stay.tolist())}
        self.pool, self.sizes = [self.pool[0][at]], [n]
        self.good, self.back = [self.good[0][stay]], [self.back[0][stay]]
        self.uses = self.uses[stay] // 2
        pa.default_memory_pool().release_unused()

    def _learn(self, units: list[str], together: int = 256) -> None:
        """Encode units, many in one text of a batch.

        The pre-tokeniser cuts such a text at markers and line feeds, so word ids tell the units apart.  A
        text whose ids or decoding differ from the library's is looked at unit by unit, and so are units
        that begin or end with spaces, as those would run together.
        """
        lines = [u for u in units if u[:1] == "\n"]
        plain = [u for u in units if u[:1] not in ("\n", " ") and u[-1:] != " "]
        odd = [[u] for u in units if u[:1] == " " or u[:1] != "\n" and u[-1:] == " "]
        cut = lambda some, n: [some[i : i + n] for i in range(0, len(some), n)]
        # (units, whether the text begins with a marker of its own)
        groups = [(g, True) for g in cut(lines, together)] + [(g, False) for g in [*cut(plain, together), *odd]]
        raw = ["".join(g) if own else "".join(u if u[:1] == "\n" else " " + u for u in g)[1:] for g, own in groups]
        got = self.tokenizer.encode_batch(raw, add_special_tokens=False)
        want = self.library.encode(raw, num_threads=self.threads)
        text = self.tokenizer.decode_batch([e.ids for e in got], skip_special_tokens=False)
        for (group, own), one, enc, theirs, decoded in zip(groups, raw, got, want, text, strict=True):
            ids, n = enc.ids, len(group)
            words = np.array(enc.word_ids, np.float64)
            sizes = np.bincount(words.astype(np.int64), minlength=n + own) if len(words) and not np.isnan(words).any() else np.zeros(0, np.int64)
            whole = ids == theirs and decoded == one and len(sizes) == n + own and sizes.min() > 0 and (not own or sizes[0] == 1)
            if whole:
                sizes, ids = sizes[own:], ids[own:]
                good = back = np.ones(n, bool)
            elif n > 1:
                for unit in group:
                    self._learn([unit])
                continue
            else:  # the library's ids stand; the marker that the text begins with is not the unit's
                good, back = np.array([ids == theirs]), np.array([decoded == one])
                ids = theirs[own:]
                sizes = np.array([len(ids)])
            for unit in group:
                self.known[unit] = len(self.known)
            self.pool.append(np.array(ids, np.int32))
            self.sizes.append(sizes)
            self.good.append(good)
            self.back.append(back)

    def _units(self, text: str) -> list[str]:
        """Keys of a text's units: a unit after a space without that space, a unit after a line feed with it."""
        if not text:
            return []
        lines = self.model.lines
        if "  " in text or text[0] == " " or text[-1] == " " or lines and " \n" in text:
            return [u[1:] if u[0] == " " else u for u in (_UNIT if lines else _PLAIN_UNIT).findall(" " + text)]
        return (text.replace("\n", " \n") if lines else text).split(" ")

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """For each text (null: empty): ids, whether the library gives the same, whether decoding gives the text."""
        texts = [t or "" for t in texts]
        if not self.by_unit:
            got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            want = self.library.encode(texts, num_threads=self.threads)
            back, theirs = self.tokenizer.decode_batch(got, skip_special_tokens=False), self.library.decode(want)
            return [np.array(x, np.int32) for x in want], [x == y for x, y in zip(got, want, strict=True)], [x == y for x, y in zip(back, theirs, strict=True)]
        return self._encode_long(texts) if any(len(t) > PIECE for t in texts) else self._encode_short(texts)

    def _encode_short(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        if len(self.known) > MEMORY:
            self._forget(MEMORY // 2)
        split = [self._units(t.replace(MARK, " ")) for t in texts]  # to the model the marker is a space
        n = np.fromiter(map(len, split), np.int64, len(split))
        flat_units = list(chain.from_iterable(split))
        at = np.fromiter(map(self.known.get, flat_units, repeat(-1)), np.int64, len(flat_units))
        new = np.flatnonzero(at < 0).tolist()
        fresh = list(dict.fromkeys(map(flat_units.__getitem__, new)))
        for k in range(0, len(fresh), CHUNK):
            self._learn(fresh[k : k + CHUNK])
        if new:
            at[new] = np.fromiter((self.known[flat_units[i]] for i in new), np.int64, len(new))
        self._settle()
        self.uses += np.bincount(at, minlength=len(self.uses))
        starts = np.concatenate(([0], np.cumsum(self.sizes[0])))
        size = self.sizes[0][at]
        ends = np.cumsum(size)
        flat = self.pool[0][np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + size, size)]
        upto = np.concatenate(([0], np.cumsum(n)))
        total = np.concatenate(([0], ends))[upto]
        bad = [np.concatenate(([0], np.cumsum(~x[0][at])))[upto] for x in (self.good, self.back)]
        good, back = ((x[1:] == x[:-1]).tolist() for x in bad)
        return [flat[a:b] for a, b in zip(total[:-1], total[1:], strict=True)], good, [ok and MARK not in t for ok, t in zip(back, texts, strict=True)]

    def _encode_long(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Text by text, in pieces cut at a space between non-spaces: the marker that a piece begins with stands for that space."""
        out = []
        for t in texts:
            at, got = 0, []
            while True:
                space = _BETWEEN.search(t, at + PIECE - 1) if len(t) - at > PIECE else None
                stop = space.start() if space else len(t)
                ids, good, back = self._encode_short([t[at:stop]])
                got.append((ids[0], good[0], back[0]))
                if not space:
                    break
                at = space.end()
            out.append((np.concatenate([x[0] for x in got]), all(x[1] for x in got), all(x[2] for x in got)))
        ids, good, back = zip(*out, strict=True)
        return list(ids), list(good), list(back)

    def decode(self, ids: list) -> list[str]:
        return self.tokenizer.decode_batch([list(x) for x in ids], skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str, threads: int = 1) -> Codec:
    os.environ.update(TOKENIZERS_PARALLELISM="true", RAYON_NUM_THREADS=str(threads))
    return Codec(path, threads)


def _threads() -> int:
    """Two threads encode a batch, or as many as the cluster gives one task."""
    from pyspark.sql import SparkSession

    return max(2, int(SparkSession.active().sparkContext.getConf().get("spark.task.cpus", "1")))


def encoded(text: Column, path: str) -> Column:
    """struct<ids, parity, round_trip>; a null text has no ids."""
    threads = _threads()

    @F.arrow_udf("struct<ids:array<int>,parity:boolean,round_trip:boolean>")
    def encode(texts: pa.Array) -> pa.Array:
        worker.enter("sentencepiece", codec.cache_clear)
        ids, good, back = codec(path, threads).encode(texts.to_pylist())
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(good, pa.bool_()), pa.array(back, pa.bool_())],
            ["ids", "parity", "round_trip"])

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of an array of ids; null for null."""
    threads = _threads()

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        worker.enter("sentencepiece", codec.cache_clear)
        values = rows.to_pylist()
        texts = iter(codec(path, threads).decode([x for x in values if x is not None]))
        return pa.array([None if x is None else next(texts) for x in values], pa.string())

    return decode(ids)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, parity, round_trip for every row.

    ``parity``: the rebuilt backend gives the library's ids for every part of the text; where it does not (two
    segmentations of one score, as in long runs of one character), ids are the library's.  Null and empty texts
    have no ids and true for both; repeated rows and null ids stay, equal rows get equal results; an empty table
    gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession, 1 << 20)
    return docs.select("doc_id", encoded(F.col("text"), path).alias("e")).select("doc_id", "e.*")
