"""Exact top-k inner products by best-first search of a paged M-tree.

Every vector gets one more component that brings all of them to one length; a
query gets a zero there.  Then the largest inner product is the smallest
Euclidean distance, a metric, and an M-tree finds it.

The tree has paged nodes: cells around routing vectors, in each cell pages
around routing vectors of their own, in each page its vectors.  A node keeps
its covering radius and its distance to its parent's routing vector.  A query
opens nodes from the lowest bound upwards.  What the stored distances and the
triangle inequality already rule out is never computed.

A query first searches the cell whose routing vector is nearest.  The k-th
score found there rules out cells as a whole; the query goes on to the others
only.  Bounds are loosened by a margin over rounding errors.  Scores are whole
numbers: while no product can pass 2 ** 53 they come from doubles, which hold
them exactly, and from 64-bit integers otherwise.

Edge cases: null vectors, those with a null, NaN or infinite component and
those with a null id take no part; every row is a candidate of every other
one, whatever its id, and every row that asks gets its own ranks; ties go to
the smaller id; vectors are compared with those of the same number of
components only, empty ones score 0; fewer than k candidates give fewer rows;
an empty table gives an empty table; scores beyond 2 ** 63 aren't defined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Vectors a cell aims at and holds at most; routing vectors at most (a bound
#: on what is broadcast); vectors a page; queries that one task searches for.
CELL, MOST_CELLS, PAGE, QUERIES = 2048, 4096, 64, 4096
HIT = "row bigint, query_id bigint, vec_id bigint, score bigint"
HITS = [x.split()[0] for x in HIT.split(", ")]
#: Products up to this are exact in doubles; and what stands for no score.
EXACT, NONE = 2.0**53, np.iinfo(np.int64).min + 1


def quantised(embedding: Column, scale: int = 64) -> Column:
    """array<bigint>: floor(scale * x) of each component; null if any component
    is null or isn't finite."""
    whole = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    bad = F.exists(embedding, lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    return F.when(embedding.isNotNull() & ~bad, whole)


class Space:
    """Distances between vectors brought to one length."""

    def __init__(self, longest: float):
        self.longest = longest

    def norms(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of stored vectors."""
        na, nb = self.norms(a), self.norms(b)
        extra = np.sqrt(np.maximum(self.longest - na, 0))[:, None] * np.sqrt(np.maximum(self.longest - nb, 0))[None, :]
        return np.sqrt(np.maximum(2 * self.longest - 2 * (a @ b.T + extra), 0))

    def to_queries(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norms(q)[:, None] + self.longest - 2 * (q @ b.T), 0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance that a score means, with the margin."""
        d = np.sqrt(np.maximum(self.norms(q) + self.longest - 2 * score.astype(np.float64), 0))
        return np.where(score > NONE, d, np.inf) + 1e-6 * (1 + math.sqrt(self.longest))

    def scores(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products of whole numbers, as int64."""
        if self.longest < EXACT:
            return (q.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False).T).astype(np.int64)
        return q.astype(np.int64, copy=False) @ b.astype(np.int64, copy=False).T


def whole(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), size)


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return whole(column, size).astype(np.float64)


def by_size(batch) -> dict[int, np.ndarray]:
    """Row numbers of a batch by the number of components of column v."""
    size = np.asarray(pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False))
    return {int(d): np.flatnonzero(size == d) for d in np.unique(size)}


def _cells(points: DataFrame, n: int, longest: float):
    """Routing vectors by number of components: an evenly hashed choice of the
    points, and the zero vector for whatever has none."""
    wanted = min(MOST_CELLS, max(1, -(-n // CELL)))
    chosen = points.orderBy(F.xxhash64("row"), "row").limit(wanted).select("v").collect()
    cells: dict[int, list[list[int]]] = {}
    for r in chosen:
        cells.setdefault(len(r["v"]), []).append(r["v"])
    return {d: np.array(x, np.float64).reshape(len(x), d) for d, x in cells.items()}


def _routing(cells: dict[int, np.ndarray], d: int) -> np.ndarray:
    return cells.get(d, np.zeros((1, d)))


def build(points: DataFrame) -> tuple[DataFrame, list, dict, Space] | None:
    """(pages, cells, routing vectors, space) of points (row, i, v), rows
    distinct; None where there is no point.

    ``pages`` is a written table with a row a page; ``cells`` has size, cell,
    part, rows and radius of each cell or part of one; both lists on the
    driver have at most MOST_CELLS routing vectors' worth of rows.
    """
    total = points.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("m")).first()
    if not total["n"]:
        return None
    space = Space(total["m"] or 0.0)
    routing = _cells(points, total["n"], space.longest)
    shared = points.sparkSession.sparkContext.broadcast((routing, space))

    def assign(batches):
        routing, space = shared.value
        for batch in batches:
            for d, rows in by_size(batch).items():
                part = pa.Table.from_batches([batch]).take(pa.array(rows)).combine_chunks()
                dist = space.between(matrix(part["v"], d), _routing(routing, d))
                cell = dist.argmin(axis=1)
                out = part.append_column("d", pa.array([d] * len(rows), pa.int32())).append_column("c", pa.array(cell, pa.int32())).append_column("r", pa.array(dist[np.arange(len(rows)), cell]))
                yield from out.to_batches()

    placed = written(points.select("row", "i", "v").mapInArrow(assign, "row bigint, i bigint, v array<bigint>, d int, c int, r double"), "cells")
    cells = [r.asDict() for r in placed.groupBy("d", "c").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()]
    parts = F.create_map(*[x for c in cells for x in (F.lit(f"{c['d']}/{c['c']}"), F.lit(-(-c["n"] // (2 * CELL))))])
    dealt = placed.withColumn("p", F.pmod(F.xxhash64("row"), parts[F.concat_ws("/", "d", "c")]).cast("int"))

    def paged(table: pa.Table) -> pa.Table:
        routing, space = shared.value
        d, c, p = (table[x][0].as_py() for x in ("d", "c", "p"))
        exact = whole(table["v"], d)
        v, ids, numbers, up = exact.astype(np.float64), table["i"].to_numpy(), table["row"].to_numpy(), table["r"].to_numpy()
        own = _routing(routing, d)[c : c + 1]
        rows = []
        # routing vectors of pages lie evenly along the distance to the cell's
        order = np.argsort(up, kind="stable")
        heads, exact_heads = v[order[::PAGE]], exact[order[::PAGE]]
        near = space.between(v, heads)
        page = near.argmin(axis=1)
        to_cell = space.between(heads, own)[:, 0]
        for k in np.unique(page):
            mine = np.flatnonzero(page == k)
            for at in range(0, len(mine), 4 * PAGE):
                some = mine[at : at + 4 * PAGE]
                dist = near[some, k]
                rows.append((d, c, p, exact_heads[k], float(dist.max()), float(to_cell[k]), ids[some], numbers[some], exact[some].ravel(), dist))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), PAGE_TYPES, strict=True)], names=PAGE_NAMES)

    pages = written(dealt.groupBy("d", "c", "p").applyInArrow(paged, PAGES), "pages")
    return pages, cells, routing, space


PAGES = "d int, c int, p int, head array<bigint>, radius double, up double, ids array<bigint>, numbers array<bigint>, vectors array<bigint>, dist array<double>"
PAGE_NAMES = [x.split()[0] for x in PAGES.split(", ")]
_L, _D = pa.list_(pa.int64()), pa.list_(pa.float64())
PAGE_TYPES = [pa.int32(), pa.int32(), pa.int32(), _L, pa.float64(), pa.float64(), _L, _L, _L, _D]


def pages_of(table: pa.Table, d: int) -> list[dict]:
    """Pages as arrays: views of the table's columns."""
    table = table.combine_chunks()
    flat = {x: table[x].combine_chunks().flatten().to_numpy(zero_copy_only=False) for x in ("ids", "numbers", "vectors", "dist")}
    size = pc.list_value_length(table["ids"]).to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    heads = matrix(table["head"], d)
    out = []
    for k, (a, b, radius, up) in enumerate(zip((ends - size).tolist(), ends.tolist(), table["radius"].to_pylist(), table["up"].to_pylist(), strict=True)):
        out.append({"head": heads[k], "radius": radius, "up": up, "ids": flat["ids"][a:b], "numbers": flat["numbers"][a:b], "vectors": flat["vectors"][a * d : b * d].reshape(b - a, d), "dist": flat["dist"][a:b]})
    return out


def best_first(pages: list[dict], own: np.ndarray, q: np.ndarray, asking: np.ndarray, least: np.ndarray, k: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), each k a query: the best vectors of a cell's pages with a
    score of ``least`` or more (NONE where there are fewer), but for the row
    ``asking`` itself.  Pages are opened from the lowest bound upwards, all
    queries a step, those that open the same page together."""
    n = len(q)
    exact, q = q, q.astype(np.float64)
    scores, found = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
    floor = least.astype(np.int64)
    reach = space.reach(q, floor)
    to_cell = space.to_queries(q, own)[:, 0]
    up, radius = np.array([x["up"] for x in pages]), np.array([x["radius"] for x in pages])
    bound = np.abs(to_cell[:, None] - up[None, :]) - radius[None, :]
    head = np.full((n, len(pages)), np.nan)
    for j, page in enumerate(pages):  # only where the stored distances leave it open
        some = np.flatnonzero(bound[:, j] <= reach)
        if len(some):
            head[some, j] = space.to_queries(q[some], page["head"][None, :])[:, 0]
            bound[some, j] = np.maximum(bound[some, j], head[some, j] - radius[j])
    order = np.argsort(bound, axis=1, kind="stable")
    live = np.arange(n)
    for step in range(len(pages)):
        live = live[bound[live, order[live, step]] <= reach[live]]
        if not len(live):
            break
        turn = order[live, step]
        for j in np.unique(turn):
            some, page = live[turn == j], pages[j]
            # a vector's distance to its page's routing vector may rule it out
            open_ = np.abs(head[some, j][:, None] - page["dist"][None, :]) <= reach[some][:, None]
            use = np.flatnonzero(open_.any(axis=0))
            if not len(use):
                continue
            new = space.scores(exact[some], page["vectors"][use])
            numbers = page.get("numbers", page["ids"])[use]
            new[(numbers[None, :] == asking[some][:, None]) | (new < floor[some][:, None])] = NONE
            both = np.concatenate([scores[some], new], axis=1)
            names = np.concatenate([found[some], np.broadcast_to(page["ids"][use], new.shape)], axis=1)
            best = np.lexsort((names, -both), axis=1)[:, :k]
            scores[some], found[some] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
            floor[some] = np.maximum(floor[some], scores[some, k - 1])
            reach[some] = space.reach(q[some], floor[some])
    return scores, found


def _searched(pages: DataFrame, asked: DataFrame, shared, k: int) -> DataFrame:
    """Hits of asked (row, query_id, v, d, c, p, least) in the pages of their cells.
    Queries of one cell are dealt to as many tasks as QUERIES wants."""
    many = asked.groupBy("d", "c", "p").agg((F.count("*") / QUERIES).cast("int").alias("more"))
    spread = pages.join(many, ["d", "c", "p"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("more")))).drop("more")
    blocks = asked.join(F.broadcast(many), ["d", "c", "p"]).withColumn("b", F.pmod(F.xxhash64("row"), F.col("more") + 1).cast("int")).drop("more")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        routing, space = shared.value
        empty = pa.table([pa.array([], pa.int64())] * 4, names=HITS)
        if not (left.num_rows and right.num_rows):
            return empty
        d, c = left["d"][0].as_py(), left["c"][0].as_py()
        numbers, ids = right["row"].to_numpy(), right["query_id"].to_numpy()
        scores, found = best_first(pages_of(left.select(PAGE_NAMES), d), _routing(routing, d)[c : c + 1], whole(right["v"], d), numbers, right["least"].to_numpy(), k, space)
        q, j = np.nonzero(scores > NONE)
        return pa.table([pa.array(numbers[q]), pa.array(ids[q]), pa.array(found[q, j]), pa.array(scores[q, j])], names=HITS)

    key = ["d", "c", "p", "b"]
    return spread.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(work, HIT)


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` (a condition
    on the columns of ``vectors``) selects, the k vectors of the largest inner
    product of quantised components, other than the row itself."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = written(rows.where("i IS NOT NULL AND v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "vectors")
    # of equal vectors, only the k + 1 smallest ids can be among the best
    same = Window.partitionBy("v").orderBy("i", "row")
    points = written(rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("row", "i", "v"), "points")
    built = build(points)
    if built is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pages, cells, routing, space = built
    radius = {(c["d"], c["c"]): (c["r"], -(-c["n"] // (2 * CELL))) for c in cells}
    shared, edges = spark.sparkContext.broadcast((routing, space)), spark.sparkContext.broadcast(radius)
    asked = rows.where("asks").select("row", F.col("i").alias("query_id"), "v")
    kind = "row bigint, query_id bigint, v array<bigint>, d int, c int, p int, least bigint"

    def sent(first: bool):
        """To the cell of the nearest routing vector, or to all others that the score leaves open."""

        def work(batches):
            routing, space = shared.value
            for batch in batches:
                for d, at in by_size(batch).items():
                    part = pa.Table.from_batches([batch]).take(pa.array(at)).combine_chunks()
                    q = matrix(part["v"], d)
                    dist = space.to_queries(q, _routing(routing, d))
                    held = [c for c in range(dist.shape[1]) if (d, c) in edges.value]
                    if not held:
                        continue
                    home = np.array(held)[dist[:, held].argmin(axis=1)]
                    least = np.full(len(q), NONE) if first else part["least"].to_numpy()
                    reach = space.reach(q, least)
                    for c in held:
                        r, parts = edges.value[d, c]
                        for p in range(parts):
                            is_home = (home == c) & (p == 0)
                            some = np.flatnonzero(is_home if first else ~is_home & (dist[:, c] - r <= reach))
                            if len(some):
                                own = part.take(pa.array(some))
                                tags = [pa.array([x] * len(some), pa.int32()) for x in (d, c, p)]
                                yield from pa.table([own["row"], own["query_id"], own["v"], *tags, pa.array(least[some])], names=["row", "query_id", "v", "d", "c", "p", "least"]).to_batches()

        return work

    near = written(_searched(pages, asked.mapInArrow(sent(True), kind), shared, k), "near")
    none = F.lit(int(NONE)).cast("bigint")
    last = near.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(none).alias("least"))
    onward = asked.join(last, "row", "left").select("row", "query_id", "v", F.coalesce("least", none).alias("least"))
    far = _searched(pages, written(onward.mapInArrow(sent(False), kind), "onward"), shared, k)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
