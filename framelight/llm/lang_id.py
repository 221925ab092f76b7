"""Language identification with a bit-sliced Bloom filter of character n-grams.

Slot ``h`` of the filter holds a mask with a bit for each language, in as many 64-bit words as there are
languages; the AND of the slots of an n-gram's hashes returns all languages that contain it at once.  A
language contains an n-gram if its relative frequency there is at least ``SHARE`` of the highest in any
language, so every n-gram seen belongs to one language at least.  The filter grows with languages and
n-grams and is built by a distributed bit_or; only if it would pass ``FILTER_BYTES`` all languages keep
the same largest share of their n-gram occurrences that fits.  A text's score for a language is its number
of n-grams with the language's bit (popcount by language), corrected for the filter's false positives:
``(hits - n * p) / (1 - p)``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .words import blocks, mix

GRAM = 4
HASHES = 3
#: A language contains an n-gram if its relative frequency there is at least this share of the highest in any language.
SHARE = 0.5
#: Slots for each n-gram of each language.
PER_GRAM = 8
#: Characters of a text whose n-grams are made at once.
PIECE = 1 << 20
#: Bytes of the filter at most, as it is broadcast.
FILTER_BYTES = 1 << 26


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point -> lower-cased letter, or 32 for anything that is not a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram keys, text index of each, whether each text has a letter).

    An n-gram is GRAM consecutive characters of the folded text with runs of non-letters as one space,
    21 bits a character hashed to 64; grams of spaces only do not occur.
    """
    joined = "\x00".join(t or "" for t in texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    folded = _fold()[points]
    letter = folded != 32
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a letter stays as the space
    folded, owner = folded[keep].astype(np.uint64), owner[keep]
    n = len(folded) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), has
    key = np.zeros(n, np.uint64)
    for j in range(GRAM):
        key = key * np.uint64(0x100000001B3) + folded[j : j + n]
    same = owner[:n] == owner[GRAM - 1 :]
    return mix(key[same], 7), owner[:n][same], has


def gram_blocks(texts: list[str | None]):
    """(first, last) of a block of texts with its ``grams``; a text longer than PIECE comes in pieces, each of its n-grams once."""
    for a, b in blocks(texts):
        if b - a > 1 or len(texts[a] or "") <= PIECE:
            yield a, b, *grams(texts[a:b])
        else:
            for found in _long_grams(texts[a]):
                yield a, b, *found


def _long_grams(text: str):
    tail, after_letter = np.zeros(0, np.uint64), False
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE] + ("\x00" if at + PIECE >= len(text) else "")
        folded = _fold()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = folded != 32
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after_letter
        after_letter = bool(letter[-1])
        kept = np.concatenate([tail, folded[keep].astype(np.uint64)])
        n, tail = max(0, len(kept) - GRAM + 1), kept[-(GRAM - 1) :]
        key = np.zeros(n, np.uint64)
        for j in range(GRAM):
            key = key * np.uint64(0x100000001B3) + kept[j : j + n]
        yield mix(key, 7), np.zeros(n, np.int32), np.array([letter.any()])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram, n: occurrences over all rows of (text, lang), summed within blocks before the shuffle."""

    def count(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.fromiter((names.index(x) for x in langs), np.int64, len(langs))
            for a, b, key, owner, _ in gram_blocks(texts):
                lang = code[a:b][owner]
                for i, name in enumerate(names):
                    found, n = np.unique(key[lang == i], return_counts=True)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return labelled.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The bit-sliced filter, the languages' names and their false-positive rates.

    ``slots``: one row a slot, of as many 64-bit words as the languages need.  ``usual`` is the language
    for a text with letters but without a known n-gram.
    """

    def __init__(self, languages: list[str], slots: np.ndarray, usual: str | None = None):
        self.languages, self.slots = languages, slots
        self.usual = usual or (languages[0] if languages else None)
        fill = [float(np.mean((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(languages))]
        self.false = np.minimum(np.array(fill) ** HASHES, 0.999)

    def masks(self, key: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as words."""
        mask = np.full((len(key), self.slots.shape[1]), 2**64 - 1, np.uint64)
        for at in slots_of(key, len(self.slots)):
            mask &= self.slots[at]
        return mask

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, their shares of all languages' hits, and their hits for each n-gram of the text."""
        names, scores, evidence = [], np.zeros(len(texts)), np.zeros(len(texts))
        n, has = np.zeros(len(texts)), np.zeros(len(texts), bool)
        hits = np.zeros((len(texts), len(self.languages)))
        for a, b, key, owner, letters in gram_blocks(texts):
            m = b - a
            has[a:b] |= letters
            n[a:b] += np.bincount(owner, minlength=m)
            mask = self.masks(key)
            for i in range(len(self.languages)):
                bit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[a:b, i] += np.bincount(owner, weights=bit.astype(float), minlength=m)
        true = np.clip((hits - n[:, None] * self.false) / (1 - self.false), 0, None)
        best = true.argmax(1) if len(self.languages) else np.zeros(len(texts), int)
        total = true.sum(1)
        for j in range(len(texts)):
            if not has[j] or not len(self.languages):
                names.append("und")
            elif total[j]:
                names.append(self.languages[best[j]])
                scores[j] = true[j, best[j]] / total[j]
                evidence[j] = true[j, best[j]] / n[j]
            else:
                names.append(self.usual)
        return names, scores, evidence


def slots_of(key: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each n-gram, one array a hash."""
    return [(mix(key, 20 + k) & np.uint64(slots - 1)).astype(np.int64) for k in range(HASHES)]


def _cuts(levels: list, capacity: int) -> dict[str, int] | None:
    """``levels``: (lang, level, n-grams, occurrences).  None if all n-grams fit; else the least level that each language keeps.

    Every language keeps the most frequent n-grams that make up the same share of its occurrences, the largest
    share that fits, and its most frequent level in any case.
    """
    by: dict[str, list] = {}
    for lang, level, n, times in sorted(levels, key=lambda r: -r[1]):
        by.setdefault(lang, []).append((level, n, times))
    if sum(r[2] for r in levels) <= capacity:
        return None

    def at(share: float) -> tuple[dict[str, int], int]:
        cut, held = {}, 0
        for lang, rows in by.items():
            total, seen = sum(r[2] for r in rows), 0
            for level, n, times in rows:
                cut[lang], held, seen = level, held + n, seen + times
                if seen >= share * total:
                    break
        return cut, held

    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid)[1] <= capacity else (lo, mid)
    return at(lo)[0]


def learn(labelled: DataFrame, share: float = SHARE, filter_bytes: int = FILTER_BYTES) -> Filters:
    """Filters from all rows of (text, lang), with all n-grams of all languages as long as they fit into ``filter_bytes``."""
    small_batches(labelled.sparkSession)
    scratch = Scratch(labelled.sparkSession)
    found = scratch.save(gram_counts(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())), "grams")
    totals = scratch.save(found.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    size = {r.lang: r.total for r in totals.collect()}  # a number for each language
    names = sorted(size)
    words = max(1, -(-len(names) // 64))
    codes = {x: i for i, x in enumerate(names)}
    rated = found.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    # Counts in buckets of 32 an octave.
    shift = "greatest(0, length(bin(n)) - 6)"
    own = rated.join(top, "gram").where(F.col("rate") >= F.col("top") * share)
    own = scratch.save(own.select("lang", "gram", "n", F.expr(f"shiftright(n, {shift}) * shiftleft(1L, {shift})").alias("level")), "own")
    levels = [tuple(r) for r in own.groupBy("lang", "level").agg(F.count("*"), F.sum("n")).collect()]
    cut = _cuts(levels, filter_bytes // (8 * words * PER_GRAM))
    n_grams = sum(r[2] for r in levels if cut is None or r[1] >= cut[r[0]])
    slots = 1 << min(max(10, (PER_GRAM * n_grams).bit_length()), (filter_bytes // (8 * words)).bit_length() - 1)

    def sliced(batches):
        for batch in batches:
            key = batch.column("gram").to_numpy().view(np.uint64)
            lang, level = batch.column("lang").to_pylist(), batch.column("level").to_pylist()
            keep = np.array([cut is None or n >= cut[x] for x, n in zip(lang, level, strict=True)], bool)
            code = np.array([codes[x] for x in lang], np.int64)
            for at in slots_of(key[keep], slots):
                bit = (np.uint64(1) << (code[keep] % 64).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at * words + code[keep] // 64), pa.array(bit)], ["at", "bits"])

    # Bits meet before they reach the driver: at most one number for each word of the filter.
    bits = own.select("lang", "gram", "level").mapInArrow(sliced, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(slots * words, np.int64)
    table[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()
    scratch.clear()
    return Filters(names, table.view(np.uint64).reshape(slots, words), max(names, key=lambda x: (size[x], x), default=None))


def predicted(filters: Filters, text: Column) -> Column:
    """struct<lang_pred, score, evidence>; ``und`` and 0 for a null text or one without a letter."""
    shared = _broadcast(filters)

    @F.arrow_udf("struct<lang_pred:string,score:double,evidence:double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores, evidence = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(evidence)], ["lang_pred", "score", "evidence"])

    return predict(text)


def _broadcast(value):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(value)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Learns from text and lang of rows that are not held out; a null lang teaches nothing, a null doc_id is
    not held out.  A text with letters but no known n-gram gets the language with most n-grams and score 0;
    equal counts go to the alphabetically first language.  With no labelled row every prediction is ``und``
    with score 0.  Rows are judged one by one, an empty table gives none, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    filters = learn(docs.where(~held_out()).select("text", "lang"))
    return docs.select("doc_id", held_out().alias("held_out"), predicted(filters, F.col("text")).alias("p")).select("doc_id", "held_out",
        "p.lang_pred", "p.score")


#: A text is of no learned language if its best one has fewer of its n-grams.
LEAST_EVIDENCE = 0.1


def keep_known(docs: DataFrame, least: float = LEAST_EVIDENCE) -> DataFrame:
    """The rows of ``docs``, all columns, with a language that has at least ``least`` of the text's n-grams.

    Learns from all labelled rows.  Other languages' hits do not count against a text, so neither
    related languages nor a mixture of two makes a text unknown.
    """
    small_batches(docs.sparkSession)
    filters = learn(docs.select("text", "lang"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), predicted(filters, F.col("text")).alias("p"))
    return whole.where((F.col("p.lang_pred") != "und") & (F.col("p.evidence") >= least)).select("row.*")
