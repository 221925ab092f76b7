"""Licence texts and notices found by patience alignment.

Words unique both in the text's window and in the template are anchors; the longest increasing subsequence
of their positions is kept, and the gaps between anchors are aligned in the same way, with the equal words at
either end of a gap matched first.  A gap without a unique word is anchored at its rarest common words.
Coverage is the share of the whole template's words that are aligned; a template of fewer than SHORT words
must be there completely, as one other word makes it another notice.

Where to align: first near three of a template's words in a row.  Words between the parts of a notice, however
many, fall away, and so do the same words in ordinary prose.  Then the whole stretch up to the template's notices
before and behind (all of the text, if there is none) is aligned without that restriction, so that a notice with a
foreign word behind every word, or with repeated parts, has its true coverage: templates of SHORT words and more are
found whatever stands between their words.  Only lone words at either end that stand more than MARGIN words off fall
away.  A template of fewer words, all of them common, is looked for around each occurrence of its rarest word and may
have up to GAP - 1 foreign words between two of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker
from .license_texts import TEMPLATES
from .scratch import small_batches

COVERAGE = 0.8
SHORT = 16
#: Words beside three in a row that may belong to a notice.
MARGIN = 6
#: Words from one word of a short notice to its next, at most.
GAP = 8
#: Characters of a text that are split into words at once; only a template's words are kept of them.
PIECE = 1 << 20

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _pieces(text: str):
    """The text in pieces of about PIECE characters that end at white space."""
    at = 0
    while len(text) - at > PIECE:
        space = re.compile(r"\s").search(text, at + PIECE)
        stop = space.end() if space else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence rising in both members, by patience piles.  ``pairs``: by rising first, then falling second members."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back[i] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text position, template position) pairs, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        times = {w: n * theirs[w] for w, n in ours.items() if w in theirs}
        if not times:
            continue
        rarest = min(times.values())  # 1: unique in both
        where: dict = {}
        for j in range(d - 1, c - 1, -1):
            if times.get(template[j]) == rarest:
                where.setdefault(template[j], []).append(j)
        anchors = _increasing([(i, j) for i in range(a, b) for j in where.get(text[i], ())])
        out += anchors
        i0, j0 = a, c
        for i, j in [*anchors, (b, d)]:
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def _trimmed(pairs: list[tuple[int, int]], places: list[int]) -> list[tuple[int, int]]:
    """Without lone words at either end: runs of fewer than three that stand more than MARGIN words off the rest."""
    low, high = 0, len(pairs)
    at = [places[i] for i, _ in pairs]
    while high - low > 1:
        cut = next((k for k in range(low + 1, min(low + 3, high)) if at[k] - at[k - 1] > MARGIN), None)
        if cut is not None:
            low = cut
            continue
        cut = next((k for k in range(high - 1, max(high - 3, low), -1) if at[k] - at[k - 1] > MARGIN), None)
        if cut is None:
            break
        high = cut
    return pairs[low:high]


class _Template:
    def __init__(self, name: str, found: list[str], code: dict[str, int], coverage: float):
        self.name, self.codes = name, [code[w] for w in found]
        m = len(found)
        self.need = m if m < SHORT else max(1, int(np.ceil(coverage * m)))
        self.vocabulary = set(self.codes)
        #: Three words in a row (fewer in a shorter template) -> their first place.
        self.run = min(3, m)
        self.seeds: dict[tuple, int] = {}
        for j in range(m - self.run, -1, -1):
            self.seeds[tuple(self.codes[j : j + self.run])] = j
        #: Words of which a text with enough of the template must have one: the longest, as few as suffice.
        self.marks, left = set(), m - self.need + 1
        for w, n in sorted(Counter(found).items(), key=lambda x: (-len(x[0]), x[0])):
            if left <= 0:
                break
            self.marks.add(w)
            left -= n


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        found = {k: words(v) for k, v in templates.items()}
        found = {k: v for k, v in found.items() if v}
        self.code = {w: i for i, w in enumerate(dict.fromkeys(w for v in found.values() for w in v))}
        self.templates = [_Template(k, v, self.code, coverage) for k, v in found.items()]
        self.marks = {w for t in self.templates for w in t.marks}

    def _hits(self, text: str) -> tuple[list[int], list[int], set[str]]:
        """Places and codes of the words that any template has, and the marks among them; empty without a mark."""
        places, codes, marks, at = [], [], set(), 0
        get = self.code.get
        for piece in _pieces(text):
            found = words(piece)
            marks |= self.marks.intersection(found)
            for i, w in enumerate(found, at):
                c = get(w)
                if c is not None:
                    places.append(i)
                    codes.append(c)
            at += len(found)
        return places, codes, marks

    @staticmethod
    def _near(t: _Template, places: list[int], codes: list[int]) -> tuple[list[int], list[int], list[int]]:
        """(places, codes: the template's words near a seed; indices among them where an early seed starts)."""
        k, seeds = t.run, []
        for i in range(len(codes) - k + 1):
            if places[i + k - 1] - places[i] == k - 1:
                j = t.seeds.get(tuple(codes[i : i + k]))
                if j is not None:
                    seeds.append((places[i], j))
        near_places, near_codes, starts, s = [], [], [], 0
        first = dict(seeds)
        for p, c in zip(places, codes, strict=True):
            while s + 1 < len(seeds) and p > seeds[s][0] + k - 1 + MARGIN:
                s += 1
            if seeds and seeds[s][0] - MARGIN <= p <= seeds[s][0] + k - 1 + MARGIN and c in t.vocabulary:
                if first.get(p, len(t.codes)) <= len(t.codes) - t.need:
                    starts.append(len(near_places))
                near_places.append(p)
                near_codes.append(c)
        return near_places, near_codes, starts

    def _found(self, t: _Template, places: list[int], codes: list[int]) -> list[tuple[int, int, int]]:
        """Notices (aligned words, first word, word after the last), left to right."""
        own = [i for i, c in enumerate(codes) if c in t.vocabulary]
        places, codes = [places[i] for i in own], [codes[i] for i in own]
        seeded = list(self._seeded(t, places, codes))
        return seeded + self._scattered(t, places, codes, seeded) if len(t.codes) < SHORT else self._stretched(t, places, codes, seeded)

    @staticmethod
    def _stretched(t: _Template, places: list[int], codes: list[int], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Notices with what else of the template stands between their neighbours, and notices without three words in a row."""
        end = places[-1] + 1 if places else 0
        out, last = [], 0

        def best(low: int, high: int) -> tuple[int, int, int] | None:
            a, b = bisect_left(places, low), bisect_left(places, high)
            pairs = _trimmed(align(codes[a:b], t.codes), places[a:b]) if b - a >= t.need else []
            if pairs:  # once more without the words on either side, which may have led it astray
                c, d = a + pairs[0][0], a + pairs[-1][0] + 1
                closer = align(codes[c:d], t.codes)
                if len(closer) > len(pairs):
                    a, pairs = c, closer
            return (len(pairs), places[a + pairs[0][0]], places[a + pairs[-1][0]] + 1) if len(pairs) >= t.need else None

        for k, mine in enumerate(found):
            high = found[k + 1][1] if k + 1 < len(found) else end
            more = best(last, high) if mine[0] < len(t.codes) else None
            out.append(more if more and more[0] > mine[0] else mine)
            last = out[-1][2]
        # What lies between them, and on either side of what is found there.
        edges = [0, *[x for _, first, after in out for x in (first, after)], end]
        todo = list(zip(edges[::2], edges[1::2], strict=True))
        while todo:
            low, high = todo.pop()
            one = best(low, high)
            if one:
                out.append(one)
                todo += [(low, one[1]), (one[2], high)]
        return sorted(out, key=lambda x: x[1])

    @staticmethod
    def _scattered(t: _Template, places: list[int], codes: list[int], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Complete notices of a short template with few words between its own, apart from ``found``."""
        have, out = Counter(codes), []
        if any(have[c] < n for c, n in Counter(t.codes).items()):
            return []
        rare, reach = min(t.codes, key=lambda c: have[c]), GAP * len(t.codes)
        taken = [(first, last) for _, first, last in found]
        for i, c in enumerate(codes):
            if c != rare or any(first <= places[i] < last for first, last in taken):
                continue
            a, b = bisect_left(places, places[i] - reach), bisect_left(places, places[i] + reach + 1)
            at = [places[a + x] for x, _ in align(codes[a:b], t.codes)]
            if len(at) == len(t.codes) and all(y - x <= GAP for x, y in zip(at[:-1], at[1:], strict=True)):
                out.append((len(at), at[0], at[-1] + 1))
                taken.append((at[0], at[-1] + 1))
        return out

    def _seeded(self, t: _Template, places: list[int], codes: list[int]):
        """Notices near three of their words in a row."""
        places, codes, starts = self._near(t, places, codes)
        best: tuple[int, int, int] | None = None
        taken = -1
        for lo in starts:
            if best and places[lo] > best[1]:
                yield best
                taken, best = best[2], None
            # From the three words themselves, and with what stands before them.
            for at in dict.fromkeys((lo, max(0, lo - MARGIN))):
                while at < len(places) and places[at] < taken:
                    at += 1
                window = codes[at : at + 2 * len(t.codes) + 2 * MARGIN]
                if len(window) < t.need:
                    continue
                pairs = align(window, t.codes)
                if len(pairs) >= t.need:
                    mine = (len(pairs), places[at + pairs[0][0]], places[at + pairs[-1][0]] + 1)
                    if best is None or (mine[0], mine[1] - mine[2]) > (best[0], best[1] - best[2]):
                        best = mine
        if best:
            yield best

    def scan(self, text: str | None) -> list[dict]:
        """Every notice found: license, coverage, first word, word after the last; ordered by place."""
        if not text:
            return []
        places, codes, marks = self._hits(text)
        if not marks:
            return []
        seen, out = set(codes), []
        for t in self.templates:
            if t.marks.isdisjoint(marks) or sum(c in seen for c in t.codes) < t.need:
                continue
            for n, first, last in self._found(t, places, codes):
                out.append({"license": t.name, "coverage": n / len(t.codes), "first": first, "last": last, "words": n})
        return self._settle(out)

    @staticmethod
    def _settle(found: list[dict]) -> list[dict]:
        """Of overlapping notices the one with more aligned words, then the higher coverage; ties to the earlier name."""
        kept: list[tuple[int, int]] = []
        out = []
        for x in sorted(found, key=lambda x: (-x["words"], -x["coverage"], x["license"], x["first"])):
            at = bisect_left(kept, (x["first"], x["first"]))
            if (at and kept[at - 1][1] > x["first"]) or (at < len(kept) and kept[at][0] < x["last"]):
                continue
            insort(kept, (x["first"], x["last"]))
            out.append({k: x[k] for k in ("license", "coverage", "first", "last")})
        return sorted(out, key=lambda x: (x["first"], x["license"]))


_TYPE = "array<struct<license:string,coverage:double,first:int,last:int>>"


def notices(text: Column, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> Column:
    """All notices of each whole text as an array; empty for null, empty or unlicensed texts."""
    scanner = Scanner(templates or TEMPLATES, coverage)

    @F.arrow_udf(_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        worker.enter("licenses")
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
        return pa.array([scanner.scan(t) for t in texts.to_pylist()], kind)

    return scan(text)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, notices for every row.

    Null and empty texts have none.  Rows are independent: null or repeated ids stay as they are, repeated
    rows get equal results, an empty table gives no rows.  Of overlapping notices the one with more aligned
    words stays, ties go to the alphabetically first licence.  Other columns are not read, so their names do
    not matter.  A long text is read in pieces of which only a template's words are kept.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", notices(F.col("text"), templates, coverage).alias("notices"))
