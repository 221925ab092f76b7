"""Near duplicates by an exact n-gram Jaccard join with vertical partitioning.

1.  Every text's set of distinct shingles (hashes) gets a 128-bit fingerprint; equal sets form one class.
    Only classes are joined; copies are members of their class.
2.  The global n-gram order is (heat, hash): heat is the power of two of how often blocks of the corpus
    repeat an n-gram, kept in a table whose size follows the number of frequent n-grams.  Any order is
    valid; this one puts frequent n-grams last, so that prefixes (the first n - ceil(t n) + 1 n-grams of
    a set) hold rare ones.
3.  The order is cut into fragments by hash.  Each fragment counts, alone and in pieces of bounded size,
    the n-grams that two prefixes share there; the partial counts are summed per pair, and a pair stays if
    the sum and what lies beyond the prefixes can reach the threshold.
4.  N-grams that many prefixes share (hot) do not make pairs of each two sets.  Each set is paired with
    the hot n-gram's hub, the set in which it comes earliest.  Sets that verified links already join need
    no more pairs; for the others, in different components, the remaining pairs that sizes and positions
    allow are made in blocks, so no link is lost and no task holds a hot n-gram alone.
5.  Pairs are verified exactly on the whole texts, first one pair per set, then those between different
    components only.  Components are found by star steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker
from .components import components
from .scratch import Scratch, small_batches
from .words import blocks, mix, shingle_sets, utf8

K, PERCENT = 5, 75
#: An n-gram is hot from this many sets on, as blocks of the corpus count them, or if so many prefixes share it.
HOT = 64
#: Bytes of the heat table at most.  With more frequent n-grams than fit only the more frequent of them are told apart.
HEAT_BYTES = 1 << 24
#: Prefix n-grams in a fragment, about; fragments at least.
PER_FRAGMENT, FRAGMENTS = 1 << 18, 64
#: Bits of the Bloom filter of candidate ids at most; with more ids than a quarter of them texts are joined without it.
BLOOM_BITS = 1 << 28
#: Sets of a hot n-gram that one block of the remaining pairs holds on its left side, about.
BLOCK_SETS = 1024
#: Shingles that the survey holds, prefix n-grams that a block gathers, pairs that a fragment gathers before they are reduced.
_SURVEYED, _GATHERED, _PAIRS = 1 << 19, 1 << 18, 1 << 19


def need(nx, ny, percent: int = PERCENT):
    """The least intersection of sets of these sizes that reaches the threshold."""
    return -(-percent * (nx + ny) // (100 + percent))


def prefix(n, percent: int = PERCENT):
    return n - (-(-percent * n // 100)) + 1


def _sets(batches):
    for batch in batches:
        texts, ids = utf8(batch.column("text")), batch.column("doc_id").to_pylist()
        for a, b in blocks(texts):
            yield ids[a:b], shingle_sets(texts[a:b], K)


def _print(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s, 11).sum(dtype=np.uint64).view(np.int64)), int(mix(s, 12).sum(dtype=np.uint64).view(np.int64))


_SURVEY = ["doc_id", "n", "k1", "k2", "gram", "times"]


def _survey(batches):
    """Per document size and fingerprint; per block the n-grams that several of its sets share."""
    pending, size, seen = [], 0, set()

    def row(columns: dict):
        m = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * m), pa.int64()) for c in _SURVEY], _SURVEY)

    def shared():
        found, n = np.unique(np.concatenate(pending), return_counts=True)
        return row({"gram": found[n >= 2].view(np.int64), "times": n[n >= 2]})

    for ids, sets in _sets(batches):
        prints = [_print(s) for s in sets]
        yield row({"doc_id": ids, "n": [len(s) for s in sets], "k1": [p[0] for p in prints], "k2": [p[1] for p in prints]})
        for s, p in zip(sets, prints, strict=True):
            if len(s) and p not in seen:
                seen.add(p)
                pending.append(s)
                size += len(s)
        if size >= _SURVEYED:
            yield shared()
            pending, size, seen = [], 0, set()
    if pending:
        yield shared()
    worker.leave()


def _heat(survey: DataFrame, hot_level: int) -> np.ndarray:
    """The level of each slot: 8 slots a frequent n-gram, at most HEAT_BYTES; beyond that only higher levels count."""
    level = F.floor(F.log2(F.sum("times"))).cast("int")
    warm = survey.where("gram is not null").groupBy("gram").agg(level.alias("level")).where(F.col("level") >= hot_level - 2)
    sizes = {r.level: r["count"] for r in warm.groupBy("level").count().collect()}
    least, held = max(sizes, default=0), 0
    for at in sorted(sizes, reverse=True):
        if held and 8 * (held + sizes[at]) > HEAT_BYTES:
            break
        least, held = at, held + sizes[at]
    heat = np.zeros(min(HEAT_BYTES, 1 << max(10, (8 * held).bit_length())), np.uint8)
    slot = F.col("gram").bitwiseAND(len(heat) - 1).cast("int").alias("slot")
    rows = warm.where(F.col("level") >= least).groupBy(slot).agg(F.max("level").cast("int").alias("level")).toArrow()
    heat[rows.column("slot").to_numpy()] = np.minimum(rows.column("level").to_numpy(), 255)
    return heat


def _prefixes(heat, hot_level: int, fragments: int, percent: int):
    """Rows (fragment, packed prefixes of a block): n-gram and set as 64-bit, size (negative: hot) and place as 32-bit numbers.

    A hot n-gram needs no company, so its sets spread over all fragments.
    """

    def flush(parts):
        gram, key, n, pos, warm = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((key, gram))
        gram, key, n, pos, warm = gram[order], key[order], n[order], pos[order], warm[order]
        # Copies within the block once.
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])
        gram, key, n, pos, warm = gram[fresh], key[fresh], n[fresh], pos[fresh], warm[fresh]
        place = np.where(warm, mix(gram ^ key.view(np.uint64), 5), gram) >> np.uint64(32)
        frag = (place % np.uint64(fragments)).astype(np.int32)
        order = np.argsort(frag, kind="stable")
        frag, gram, key, n, pos = frag[order], gram[order], key[order], np.where(warm, -n, n)[order].astype(np.int32), pos[order].astype(np.int32)
        names, start = np.unique(frag, return_index=True)
        data = [b"".join(c[a:b].tobytes() for c in (gram, key, n, pos)) for a, b in zip(start, [*start[1:], len(frag)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], ["frag", "data"])

    def run(batches):
        table = heat.value
        mask = np.uint64(len(table) - 1)
        parts, size = [], 0
        for _, sets in _sets(batches):
            for s in sets:
                if not len(s):
                    continue
                level = table[(s & mask).astype(np.int64)]
                p = prefix(len(s), percent)
                if level.any():
                    order = np.argsort(level, kind="stable")[:p]
                    gram, warm = s[order], level[order] >= hot_level
                else:
                    gram, warm = s[:p], np.zeros(p, bool)
                parts.append((gram, np.full(p, _print(s)[0], np.int64), np.full(p, len(s), np.int64), np.arange(p, dtype=np.int64), warm))
                size += p
                if size >= _GATHERED:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)
        del table, parts
        worker.leave()

    return run


_COUNTED = ["x", "y", "nx", "ny", "shared", "gram"]


def _unpack(data: bytes) -> np.ndarray:
    """4 x m: n-gram (as signed), set, size, place."""
    m = len(data) // 24
    wide = np.frombuffer(data, np.int64, 2 * m).reshape(2, m)
    return np.vstack([wide, np.frombuffer(data, np.int32, 2 * m, 16 * m).reshape(2, m)])


class _Fragment:
    """The prefixes of one fragment; what it yields are partial counts of pairs, and sets of hot n-grams (with a gram)."""

    def __init__(self, percent: int, hot: int):
        self.percent, self.hot = percent, hot
        self.rows: list[np.ndarray] = []
        self.size, self.most = 0, 4 * PER_FRAGMENT
        self.many = np.zeros(0, np.int64)  # n-grams found to be hot here

    def _hot_rows(self, row: np.ndarray):
        if row.shape[1]:
            none = np.zeros(row.shape[1], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (row[1], none, np.abs(row[2]), row[3], none, row[0])], _COUNTED)

    def add(self, data: bytes):
        row = _unpack(data)
        warm = (row[2] < 0) | np.isin(row[0], self.many)
        yield from self._hot_rows(row[:, warm])
        self.rows.append(row[:, ~warm])
        self.size += self.rows[-1].shape[1]
        if self.size > self.most:  # what many sets share leaves at once, so memory stays bounded
            yield from self._sort()
            self.most = max(self.most, 2 * self.size)

    def _sort(self):
        row = np.hstack(self.rows)
        row = row[:, np.lexsort((row[1], row[0]))]
        fresh = np.ones(row.shape[1], bool)
        fresh[1:] = (row[:3, 1:] != row[:3, :-1]).any(0)  # copies of a set
        row = row[:, fresh]
        start = np.flatnonzero(np.concatenate(([True], row[0, 1:] != row[0, :-1]))) if row.shape[1] else np.zeros(0, int)
        size = np.diff(np.append(start, row.shape[1]))
        self.many = np.union1d(self.many, row[0, start[size >= self.hot]])
        warm = np.repeat(size >= self.hot, size)
        yield from self._hot_rows(row[:, warm])
        self.rows = [row[:, ~warm]]
        self.size = self.rows[0].shape[1]

    def pairs(self):
        if not self.rows:
            return
        yield from self._sort()
        row = self.rows[0]
        if not row.shape[1]:
            return
        start = np.flatnonzero(np.concatenate(([True], row[0, 1:] != row[0, :-1])))
        size = np.diff(np.append(start, row.shape[1]))
        keys, place = np.unique(row[1], return_inverse=True)
        place, n = place.astype(np.int64), row[2]
        found, held = [], 0
        for m in np.unique(size[size > 1]):
            at = start[size == m][:, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            step = max(1, _PAIRS // len(i))
            for lo in range(0, len(at), step):
                x, y = at[lo : lo + step][:, i].ravel(), at[lo : lo + step][:, j].ravel()
                fit = (100 * np.minimum(n[x], n[y]) >= self.percent * np.maximum(n[x], n[y])) & (place[x] != place[y])
                x, y = x[fit], y[fit]
                low = place[x] < place[y]
                x, y = np.where(low, x, y), np.where(low, y, x)
                # A set is told by its hash and size: two sets with one hash differ in size or are one.
                found.append(np.stack([place[x] * len(keys) + place[y], n[x], n[y]]))
                held += len(x)
                if held >= _PAIRS:
                    yield self._reduced(found, keys)
                    found, held = [], 0
        if held:
            yield self._reduced(found, keys)

    @staticmethod
    def _reduced(found: list[np.ndarray], keys: np.ndarray):
        pair = np.hstack(found)
        code, first, count = np.unique(pair[0], return_index=True, return_counts=True)
        x, y = keys[code // len(keys)], keys[code % len(keys)]
        none = np.zeros(len(code), np.int64)
        columns = (x, y, pair[1, first], pair[2, first], count)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([None] * len(none), pa.int64())], _COUNTED)


def _partial_counts(percent: int, hot: int):
    """Over rows sorted by fragment: one fragment at a time."""

    def run(batches):
        at, work = None, None
        for batch in batches:
            for frag, data in zip(batch.column("frag").to_pylist(), batch.column("data"), strict=True):
                if frag != at:
                    if work:
                        yield from work.pairs()
                    at, work = frag, _Fragment(percent, hot)
                yield from work.add(data.as_py())
        if work:
            yield from work.pairs()
        work = None
        worker.leave()

    return run


def _overlap(percent: int):
    """Whether two whole texts' sets reach the threshold; a text that is not of the set meant (a repeated id) does not."""

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array, ka: pa.Array, kb: pa.Array) -> pa.Array:
        left, right, kl, kr = utf8(a), utf8(b), ka.to_pylist(), kb.to_pylist()
        out, last, t = [], None, None
        for lo, hi in blocks(left):
            for s, i, j, hub in zip(shingle_sets(left[lo:hi], K), kl[lo:hi], kr[lo:hi], right[lo:hi], strict=True):
                if hub != last:  # rows of one hub lie together
                    last, t = hub, shingle_sets([hub], K)[0]
                if _print(s)[0] != i or _print(t)[0] != j or not len(s) or not len(t):
                    out.append(False)
                    continue
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                out.append(100 * both >= percent * (len(s) + len(t) - both) and both > 0)
        return pa.array(out, pa.bool_())

    return linked


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents that ``ids`` may name.

    A Bloom filter of the ids (12 bits an id, at most BLOOM_BITS, OR-ed before it reaches the driver) keeps
    other texts out of the shuffle; with so many ids that it would let most texts through, there is none.
    """
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null and text is not null")
    n = ids.count()
    if 4 * n > BLOOM_BITS:
        return texts
    bits = min(BLOOM_BITS, 1 << max(16, (12 * n).bit_length()))
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(bits)) for k in (1, 2)]))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))
    hashed = texts.select("*", *[F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(bits)).alias(f"h{k}") for k in (1, 2)])

    def chosen(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k in (1, 2):
                h = batch.column(f"h{k}").to_numpy()
                keep &= (shared.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.select(["id", "text"]).filter(pa.array(keep))

    return hashed.mapInArrow(chosen, "id bigint, text string")


def _verify(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (dx, dy, x, y) those whose whole texts reach the threshold: a, b.

    The text of dx is moved to dy; callers put a document of many pairs last, so its text moves once.
    """
    ids = pairs.select(F.explode(F.array("dx", "dy")).alias("id")).distinct()
    texts = _texts(docs, ids)
    left = pairs.join(texts.withColumnsRenamed({"id": "dx", "text": "tx"}), "dx")
    both = left.join(texts.withColumnsRenamed({"id": "dy", "text": "ty"}), "dy")
    return both.where(_overlap(percent)(F.col("tx"), F.col("ty"), F.col("x"), F.col("y"))).select(F.col("dx").alias("a"), F.col("dy").alias("b"))


def _reach(percent: int, nx: Column, ny: Column) -> Column:
    return F.floor((percent * (nx + ny) + (99 + percent)) / (100 + percent))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    A null, empty or wordless text has no shingles and is linked with nothing: its component is its id.
    The id names a document: texts of rows that share an id are one node.  A row with a null id keeps its
    place (its component is that of its equals, or null).  Ties in any choice go to the smaller id or hash.
    An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 1 << 20)
    scratch = Scratch(spark)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    survey = scratch.save(slim.mapInArrow(_survey, ", ".join(f"{c} bigint" for c in _SURVEY)), "survey")
    members = survey.where("n is not null").select("doc_id", "n", "k1", "k2")
    classes = scratch.save(members.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    counted = _counted(slim, survey, members, percent, scratch)
    candidates, hot = _candidates(counted, classes, percent, scratch)

    # One pair for each set, the one with the most n-grams shared; then what still lies between components.
    side = lambda a, b: F.struct(F.col(f"d{a}").alias("dx"), F.col(f"d{b}").alias("dy"), F.col(a).alias("x"), F.col(b).alias("y"))
    best = candidates.select(F.explode(F.array(side("x", "y"), side("y", "x"))).alias("p"), "shared")
    best = best.groupBy("p.dx").agg(F.min(F.struct(-F.col("shared"), "p.dy", "p.x", "p.y")).alias("b")).select("dx", "b.dy", "b.x", "b.y")
    once = best.groupBy(F.least("dx", "dy").alias("lo"), F.greatest("dx", "dy").alias("hi")).agg(F.min(F.struct("dx", "dy", "x", "y")).alias("p"))
    first = scratch.save(once.select("p.*"), "first")
    links = scratch.save(_verify(slim, first, percent).unionByName(_same_id(members, classes)), "links0")
    roots = scratch.save(components(links, scratch, "cc0"), "roots0")
    tried = first.select(F.least("dx", "dy").alias("dx"), F.greatest("dx", "dy").alias("dy"))
    later = _apart(_sorted(candidates).join(tried, ["dx", "dy"], "left_anti"), roots)
    if hot is not None:
        later = later.unionByName(_apart(_named(_rest_of_hot(hot, classes, roots, percent, scratch), classes), roots).select("dx", "dy", "x", "y"))
    second = scratch.save(later.distinct(), "second")
    if second.limit(1).count():
        links = links.unionByName(scratch.save(_verify(slim, second, percent), "links1"))
        roots = scratch.save(components(links, scratch, "cc1"), "roots1")
    labelled = classes.join(roots, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("root", "rep").alias("component_id"))
    labelled = scratch.save(labelled, "labelled")
    scratch.drop(*(scratch.names - {"survey", "labelled"}))
    joined = members.where("n > 0").join(labelled, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _counted(slim: DataFrame, survey: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Partial counts (x, y, nx, ny, shared) of all fragments, and sets of hot n-grams (x, nx, ny: place, gram)."""
    spark = slim.sparkSession
    hot_level = HOT.bit_length() - 1
    heat = spark.sparkContext.broadcast(_heat(survey, hot_level))
    total = members.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1).alias("t")).first().t or 0
    fragments = max(FRAGMENTS, int(total // PER_FRAGMENT))
    # A task takes about 64 MB of fragments, and no fewer tasks than shuffles have anyway.
    tasks = min(fragments, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 24) >> 26))
    emitted = slim.mapInArrow(_prefixes(heat, hot_level, fragments, percent), "frag int, data binary")
    dealt = emitted.repartition(tasks, "frag").sortWithinPartitions("frag")
    return scratch.save(dealt.mapInArrow(_partial_counts(percent, HOT), ", ".join(f"{c} bigint" for c in _COUNTED)), "counted")


def _candidates(counted: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(x, y, shared, dx, dy: pairs that may reach the threshold; gram, key, n, pos: sets of hot n-grams, if there are any)."""
    rest = lambda n: n - (n - F.floor((percent * n + 99) / 100) + 1)  # noqa: E731  beyond the prefix
    sums = counted.where("gram is null").groupBy("x", "y", "nx", "ny").agg(F.sum("shared").alias("shared"))
    found = counted.where("gram is not null").select("gram", F.col("x").alias("key"), F.col("nx").alias("n"), F.col("ny").alias("pos"))
    hot = scratch.save(found.distinct(), "hot")
    if not hot.limit(1).count():
        slack = F.greatest(rest(F.col("nx")), rest(F.col("ny")))
        cold = sums.where(F.col("shared") + slack >= _reach(percent, F.col("nx"), F.col("ny"))).select("x", "y", "shared")
        return scratch.save(_named(cold, classes), "candidates"), None
    # Hot n-grams are not counted in fragments; a pair that shares one may keep up to its whole prefix.
    warm_sets = hot.groupBy("key").agg(F.count("*").alias("w"))
    sums = sums.join(warm_sets.withColumnsRenamed({"key": "x", "w": "wx"}), "x", "left")
    sums = sums.join(warm_sets.withColumnsRenamed({"key": "y", "w": "wy"}), "y", "left")
    slack = F.greatest(rest(F.col("nx")) + F.coalesce("wx", F.lit(0)), rest(F.col("ny")) + F.coalesce("wy", F.lit(0)))
    cold = sums.where(F.col("shared") + slack >= _reach(percent, F.col("nx"), F.col("ny"))).select("x", "y", "shared")

    # Hubs are written before they are joined: then nothing else in the join's stage needs the rows of an
    # n-gram together, and AQE splits the partition of one that many sets share.
    hubs = hot.groupBy("gram").agg(F.min(F.struct(F.col("pos") / F.col("n"), "key", "n")).alias("hub"))
    hubs = scratch.save(hubs.select("gram", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    star = hot.join(hubs, "gram").where("key <> hub").where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent)
    star = scratch.save(star.select(F.least("key", "hub").alias("x"), F.greatest("key", "hub").alias("y")), "star")
    star = star.groupBy("x", "y").agg(F.count("*").alias("shared"))
    both = cold.unionByName(star).groupBy("x", "y").agg(F.sum("shared").alias("shared"))
    return scratch.save(_named(both, classes), "candidates"), hot


def _same_id(members: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between the classes of ids that have several texts."""
    of = members.where("n > 0 and doc_id is not null").select("doc_id", F.struct("k1", "k2", "n").alias("k"))
    several = of.groupBy("doc_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("doc_id")
    reps = of.join(several, "doc_id").select("doc_id", "k.*").distinct().join(classes, ["k1", "k2", "n"]).select("doc_id", "rep")
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return reps.join(least, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds dx, dy, the representatives of the classes x, y."""
    names = classes.where("rep is not null").select(F.col("k1"), F.col("rep"))
    out = pairs.join(names.withColumnsRenamed({"k1": "x", "rep": "dx"}), "x")
    return out.join(names.withColumnsRenamed({"k1": "y", "rep": "dy"}), "y")


def _sorted(pairs: DataFrame) -> DataFrame:
    """dx, dy, x, y with the smaller document first."""
    low = F.col("dx") < F.col("dy")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    return pairs.select(F.least("dx", "dy").alias("dx"), F.greatest("dx", "dy").alias("dy"), pick("x", "y").alias("x"), pick("y", "x").alias("y"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    out = pairs.join(roots.withColumnsRenamed({"node": "dx", "root": "rx"}), "dx", "left")
    out = out.join(roots.withColumnsRenamed({"node": "dy", "root": "ry"}), "dy", "left")
    return out.where(F.coalesce("rx", "dx") != F.coalesce("ry", "dy")).drop("rx", "ry")


def _rest_of_hot(hot: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """x, y: pairs of sets in different components that share a hot n-gram, as far as sizes and positions allow.

    Only n-grams whose sets are in several components count.  Their sets are cut into ranges of size that
    only meet their neighbours (sizes of a linked pair differ by at most 100 / percent) and into blocks of
    BLOCK_SETS, so that no task holds all sets of an n-gram.
    """
    reps = classes.where("rep is not null").select(F.col("k1").alias("key"), "rep")
    at = hot.join(reps, "key").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    at = scratch.save(at.select("gram", "key", "n", "pos", F.coalesce("root", "rep").alias("root")), "rest")
    mixed = at.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("sets")).where("lo <> hi")
    mixed = scratch.save(mixed.select("gram", F.ceil(F.col("sets") / BLOCK_SETS).cast("int").alias("parts")), "mixed")
    width = math.log(100 / percent) * 1.000001 if percent < 100 else 1.0
    size = F.floor(F.log("n") / width).cast("int")
    at = scratch.save(at.join(mixed, "gram").withColumn("range", size), "apart")
    left = at.select("gram", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("root").alias("rx"), "range",
        F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    right = at.select("gram", F.col("key").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("root").alias("ry"),
        F.explode(F.sequence(F.col("range") - 1, F.col("range") + 1)).alias("range"), "parts")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    goal = _reach(percent, F.col("nx"), F.col("ny"))
    fits = (F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry")) & (F.col("nx") - F.col("px") >= goal) & (F.col("ny") - F.col("py") >= goal)
    # Sizes after the explodes are unknown to the planner, which must not broadcast them.
    return left.join(right.hint("merge"), ["gram", "range", "part"]).where(fits).select("x", "y").distinct()


def one_row_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row, all columns, of each group of near duplicates: of the smallest doc_id, or without one if none has any.

    Rows that share an id are one document, whatever their texts.  Rows without an id are documents by
    their text; one without a shingle is linked with nothing and stays.  Of rows that repeat the id
    kept, one with a text stays, the one with the least hash of its columns.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    node = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(F.lit("no id"), "text")).alias("doc_id")
    named = docs.where("doc_id is not null").select(node, "text")
    # A text that many rows without an id share is one node, and is read as one.
    unnamed = docs.where("doc_id is null and text is not null").select(node, "text").groupBy("doc_id").agg(F.min("text").alias("text"))
    unnamed = scratch.save(unnamed, "unnamed")
    found = scratch.save(near_duplicates(named.unionByName(unnamed), percent), "found")

    # An id with several texts links the components of all of them.
    homes = found.groupBy("doc_id").agg(F.min("component_id").alias("home"), F.max("component_id").alias("other"), F.max("n_shingles").alias("n"))
    split = homes.where("home <> other").select("doc_id", "home").join(found.select("doc_id", "component_id"), "doc_id")
    links = scratch.save(split.where("component_id <> home").select(F.col("home").alias("a"), F.col("component_id").alias("b")).distinct(), "links")
    homes = homes.join(unnamed.select("doc_id", F.lit(True).alias("unnamed")), "doc_id", "left").where("n > 0 or unnamed is null")
    if links.limit(1).count():
        roots = scratch.save(components(links, scratch), "roots")
        homes = homes.join(roots, F.col("home") == F.col("node"), "left").withColumn("home", F.coalesce("root", "home"))
    homes = scratch.save(homes.select("doc_id", "home", F.col("unnamed").isNotNull().alias("unnamed")), "homes")
    # Written before it is joined, so that AQE splits the group of a text with very many copies.
    least = homes.groupBy("home").agg(F.min(F.struct("unnamed", "doc_id")).alias("least")).select("home", F.col("least.doc_id").alias("kept"))
    least = scratch.save(least, "least")
    gone = scratch.save(homes.join(least, "home").where("doc_id <> kept").select("doc_id"), "gone")
    often = docs.select(node).groupBy("doc_id").count().where("count > 1").join(homes.select("doc_id"), "doc_id", "left_semi")
    often = scratch.save(often.join(gone, "doc_id", "left_anti").select("doc_id"), "often")

    keyed = docs.select(F.struct(*docs.columns).alias("row"), node.alias("__node"))
    away = gone.unionByName(often).withColumnRenamed("doc_id", "__gone")
    kept = keyed.join(away, F.col("__node") == F.col("__gone"), "left_anti").select("row")
    if often.limit(1).count():
        again = keyed.join(often.withColumnRenamed("doc_id", "__often"), F.col("__node") == F.col("__often"), "left_semi")
        worded = F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        order = F.struct(~worded, F.xxhash64(*[F.col("row")[c] for c in docs.columns]))
        kept = kept.unionByName(again.groupBy("__node").agg(F.min_by("row", order).alias("row")).select("row"))
    return kept.select("row.*")
