"""Exact top-k inner products as a Voronoi kNN join.

Candidates are grouped by their nearest centre (k-means on a sample; the number of centres grows with the
data).  With d the distance of a candidate x in cell j to its centre c_j, a query q scores it between
q.c_j - |q| d and q.c_j + |q| d.  So the cell's smallest distances (its summary) give every query a score t
that its k-th result reaches at least, and x can only matter to q where d >= (t - q.c_j) / |q|.  Queries are
grouped by centre too; the least such bound of a group for each cell decides which candidates are replicated
to the group.  Each group is cut into blocks and solved locally with exact integer scores; block results merge
by query.

Where the bounds would replicate more than plain blocks of queries against all candidates do (vectors that are
spread evenly over a sphere of many dimensions have no near neighbours to speak of), the groups are such
blocks.  Either way every result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

TOP = 5
SCALE = 256
#: Centres: half the root of the number of vectors, within these bounds; vectors sampled for each.
CENTRES, SAMPLED = (16, 1024), 32
#: Queries of a group, about, where bounds hold; candidates and queries of a block.
GROUP, BLOCK, QUERY_BLOCK = 256, 20_000, 4_000


def pack(v: np.ndarray) -> bytes:
    """Whole numbers as 16-bit integers where they fit, else as doubles; the first byte tells which."""
    if not len(v) or np.abs(v).max() < 32768:
        return b"\x02" + v.astype("<i2").tobytes()
    return b"\x08" + v.astype("<f8").tobytes()


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, b in enumerate(rows):
        v = np.frombuffer(b, "<i2" if b[0] == 2 else "<f8", offset=1)
        out[i, : len(v)] = v
    return out


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, v: whole vectors floor(256 x); without rows whose id or vector is null or has a null or non-finite component.  A repeated (id, vector) stays once."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double"))

    @F.arrow_udf("struct<v:binary,dim:int,norm:double>")
    def packed(rows: pa.Array) -> pa.Array:
        vs = [np.array(r, np.float64) for r in rows.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([pack(v) for v in vs], pa.binary()), pa.array([len(v) for v in vs], pa.int32()),
            pa.array([float(v @ v) for v in vs], pa.float64())], ["v", "dim", "norm"])

    good = table.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return good.select("vec_id", packed(whole).alias("p")).select("vec_id", "p.*").dropDuplicates(["vec_id", "v"])


def centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n centres (or as many as there are different vectors): spread out first, then by Lloyd's steps."""
    sample = np.unique(sample, axis=0)
    if len(sample) <= n:
        return sample
    rng = np.random.default_rng(7)
    chosen = sample[rng.integers(len(sample), size=1)]
    near = ((sample - chosen) ** 2).sum(1)
    for _ in range(n - 1):
        pick = sample[rng.choice(len(sample), p=near / near.sum())] if near.sum() > 0 else sample[0]
        chosen = np.vstack([chosen, pick])
        near = np.minimum(near, ((sample - pick) ** 2).sum(1))
    for _ in range(rounds):
        cell = squares(sample, chosen).argmin(1)
        some, size = np.unique(cell, return_counts=True)
        sums = np.zeros_like(chosen)
        np.add.at(sums, cell, sample)
        chosen[some] = sums[some] / size[:, None]
    return chosen


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, not exact: they choose cells only."""
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T


class Cells:
    """Centres, and for each cell the distance within which enough candidates lie for any query."""

    def __init__(self, points: np.ndarray):
        self.points, self.enough = points, np.full(len(points), np.inf)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centre, distance to it)"""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0)
        cell = squares(x, self.points).argmin(1)
        return cell, np.sqrt(((x - self.points[cell]) ** 2).sum(1))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and cell the distance from which on a candidate of the cell can matter (with a margin for doubles)."""
        dots, norm = q @ self.points.T, np.sqrt((q * q).sum(1))[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            sure = np.where(np.isinf(self.enough), -np.inf, dots - norm * self.enough).max(1, keepdims=True)
            out = (sure - dots) / norm
            slack = 1e-9 * (np.abs(sure) / norm + np.sqrt((self.points**2).sum(1))[None]) + 1e-3
        return np.where(np.isfinite(out), out - slack, -np.inf)


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every sum stays below 2^53, else in Python's integers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2**53:
        return q @ x.T
    whole = lambda a: np.array([[int(c) for c in r] for r in a], object).reshape(a.shape)
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1)


def solve(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(index of the query, id, score) of each query's k best among others' ids; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    step = max(1, min(256, (4 << 20) // max(1, len(x))))
    for a in range(0, len(q), step):
        scores = _dots(q[a : a + step], x)
        n = min(k + 1, len(ids))
        floor = scores.min(1) if n == len(ids) or scores.dtype == object else np.partition(scores, len(ids) - n, 1)[:, len(ids) - n]
        for i, row in enumerate(scores):
            near = np.flatnonzero(row >= floor[i])
            near = near[ids[near] != q_ids[a + i]]
            for j in near[np.argsort(-row[near], kind="stable")][:k]:
                yield a + i, int(ids[j]), int(row[j])


def search(table: DataFrame, k: int = TOP, every: int = 50, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best (all, if fewer) for each row whose vec_id is divisible by ``every``.

    Vectors of different lengths are compared as if the shorter went on with zeros.  Candidates are all
    rows with another id than the query's; ties go to the smaller id; no query, or no other vector, gives no
    rows.  Rows with a null id or a null or non-finite component take no part, repeated rows count once, other
    columns are not read.  ``report`` gets the numbers of candidates, groups of queries and replicas.
    """
    spark = table.sparkSession
    scratch = Scratch(spark)
    data = scratch.save(vectors(table), "vectors")
    top = data.agg(F.count("*").alias("n"), F.max("dim").alias("d")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not top.n:
        return spark.createDataFrame([], schema)
    dim = top.d
    # Rows that a query cannot get: its own, as many as repeat an id with other vectors.
    own = data.groupBy("vec_id").count().agg(F.max("count").alias("m")).first().m
    n = int(min(CENTRES[1], max(CENTRES[0], top.n**0.5 / 2)))
    chosen = data.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLED * n).collect()
    cells = Cells(centres(unpack([bytes(r.v) for r in chosen], dim), n))
    shared = spark.sparkContext.broadcast(cells)

    @F.arrow_udf("struct<cell:int,far:double>")
    def placed(rows: pa.Array) -> pa.Array:
        cell, far = shared.value.place(unpack(rows.to_pylist(), dim))
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far)], ["cell", "far"])

    # Of equal vectors only the k + own smallest ids can be among anyone's k best.
    same = Window.partitionBy("v").orderBy("vec_id")
    distinct = data.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + own)
    near = scratch.save(distinct.select("vec_id", "v", placed(F.col("v")).alias("g")).select("vec_id", "v", "g.cell", "g.far"), "candidates")
    asked = data.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = scratch.save(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), placed(F.col("v"))["cell"].alias("cell")), "queries")
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], schema)

    closest = Window.partitionBy("cell").orderBy("far", "vec_id")
    for r in near.select("cell", "far", "vec_id").withColumn("at", F.row_number().over(closest)).where(F.col("at") == k + own).collect():
        cells.enough[r.cell] = r.far * (1 + 1e-9)
    summary = spark.sparkContext.broadcast(cells)
    # Neighbouring cells of queries make a group: cells in the order of their first coordinates' projection.
    line = np.argsort(np.argsort(_line(cells.points)))
    of = queries.groupBy("cell").count().collect()
    group = _groups({r.cell: r["count"] for r in of}, line)
    group_of = F.create_map(*[x for cell, g in group.items() for x in (F.lit(cell), F.lit(g))])
    queries = queries.withColumn("group", group_of[F.col("cell")])

    def least(batches):
        for batch in batches:
            bound = summary.value.bounds(unpack(batch.column("q").to_pylist(), dim))
            at = batch.column("group").to_numpy()
            for g in np.unique(at):
                low = bound[at == g].min(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), g, np.int32)), pa.array(np.arange(len(low), dtype=np.int32)),
                    pa.array(low)], ["group", "cell", "from"])

    reach = queries.select("q", "group").mapInArrow(least, "group int, cell int, from double").groupBy("cell", "group").agg(F.min("from").alias("from"))
    reach = scratch.save(reach.groupBy("cell").agg(F.collect_list(F.struct("group", "from")).alias("groups")), "reach")
    # At most (queries / GROUP + 1) numbers for each of at most 1,024 cells.
    wanted = near.join(reach, "cell").withColumn("groups", F.filter("groups", lambda g: F.col("far") >= g["from"]))
    total = wanted.agg(F.sum(F.size("groups")).alias("t")).first().t or 0
    plain = max(1, -(-n_queries // QUERY_BLOCK))
    if total <= plain * top.n:
        replicas = wanted.select("vec_id", "v", F.explode("groups.group").alias("group"))
    else:
        queries = queries.withColumn("group", F.pmod(F.xxhash64("query_id", "q"), F.lit(plain)).cast("int"))
        replicas = near.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(plain - 1))).alias("group"))
        total = plain * near.count()
    if report is not None:
        report.update(candidates=top.n, groups=len(set(group.values())), plain=plain, replicas=total)

    ours = replicas.groupBy("group").agg(F.count("*").alias("x")).join(queries.groupBy("group").agg(F.count("*").alias("y")), "group")
    plan = scratch.save(ours.select("group", F.ceil(F.col("x") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("y") / QUERY_BLOCK).cast("int").alias("parts")), "plan")
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    ours = replicas.join(plan, "group").select("vec_id", "v", "group", spot("vec_id", "blocks").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    theirs = queries.join(plan, "group").select("query_id", "q", "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        spot("query_id", "parts").alias("part"))

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        found = []
        if len(q_ids) and len(ids):
            raw = left.column("q").to_pylist()
            found = [(int(q_ids[i]), raw[i], j, s) for i, j, s in solve(q_ids, unpack(raw, dim), ids, unpack(right.column("v").to_pylist(), dim), k + own - 1)]
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
            ["query_id", "q", "vec_id", "score"])

    keys = ["group", "block", "part"]
    hits = theirs.groupBy(*keys).cogroup(ours.groupBy(*keys)).applyInArrow(local, "query_id bigint, q binary, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _line(points: np.ndarray) -> np.ndarray:
    """The centres' places along the direction in which they differ most."""
    middle = points - points.mean(0)
    return middle @ np.linalg.svd(middle, full_matrices=False)[2][0] if len(points) > 1 else np.zeros(len(points))


def _groups(queries: dict[int, int], line: np.ndarray) -> dict[int, int]:
    """cell -> group: cells next to each other in ``line`` share a group until it has about GROUP queries."""
    out, g, held = {}, 0, 0
    for cell in sorted(queries, key=lambda c: line[c]):
        if held and held + queries[cell] > GROUP:
            g, held = g + 1, 0
        out[cell] = g
        held += queries[cell]
    return out
