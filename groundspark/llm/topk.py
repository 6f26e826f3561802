"""Exact top-k inner products by dual cover-tree search.

The upper levels of one cover tree over all rows, queries among them, are tables: a node with more
than ROWS rows is split by centres that lie far apart (farthest first from a sample of its rows, its
own centre the first of them), and every row goes to the nearest. A kid that still has over half of its
node's rows (vectors near the centre whatever the centres are: short ones, or any round a zero vector) is
cut by distance from its centre into shells of like size instead; one that even that leaves with over half
has rows that can't be told apart so, and is a leaf. There are LEVELS levels at most; larger leaves are
dealt by hash. Nodes are numbered by a counter. Rows are the leaves' content. A first round searches each query's own leaf and gives it a worst kth score. Then pairs of a query
group (a node with ROWS queries at most) and a data node descend level by level; a pair goes when
<c, c'> + |c| r' + |c'| r + r r' (c, c': centres, r, r': covering radii) is below the group's worst
kth score. Pairs of leaves that are left are searched in one task each, where both sides are cover
trees again: radii are halved from level to level, a node's centre is also that of one of its kids,
and kids' centres are more than the kids' radius apart. A node whose rows are too scattered for KIDS
such kids stays a leaf and is multiplied as a matrix. Ties aren't pruned, since the smaller id wins.

Components are integers, floor(1024 x), so scores are exact up to 63 bits. Defined results: rows with
a null id, vector or component, or one that isn't finite, take no part; shorter vectors count as
padded by zeros; rows with a query's own id are its own; a query without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.operators.util import global_index

from .common import written

ROWS = 8192  # rows of a leaf, and queries of a group
KIDS = 64  # of a node
SAMPLE = 2048  # rows of a node that its kids' centres are chosen from, about
LEVELS = 12  # of tables; each splits a node to KIDS, so leaves that are cut short for it are beyond any table that can be split
LEAF, QUERY_LEAF = 48, 4  # rows of a leaf within a task, and of a query leaf: few, so that a group's worst kth score is tight
NONE = -(1 << 62)  # score of no candidate
EXACT = 2.0**53  # products of norms below which doubles are exact


def farthest_first(rows: np.ndarray, start: np.ndarray, most: int, reach: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Rows taken as further centres after start, until all are within reach or there are most; and each row's nearest centre and distance."""
    near = np.sqrt(((rows - start) ** 2).sum(1))
    owner, centres = np.zeros(len(rows), np.int64), []
    while len(centres) + 1 < most and len(rows) and near.max() > reach:
        centres.append(int(near.argmax()))
        d = np.sqrt(((rows - rows[centres[-1]]) ** 2).sum(1))
        closer = d < near
        owner[closer], near[closer] = len(centres), d[closer]
    return centres, owner, near


class CoverTree:
    """Nodes over rows that are reordered so that each node has one range. cover: the level's radius, radius: the distance of the farthest row."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaf, self.points, self.order = leaf, points, np.arange(len(points))
        self.first: list[int] = []
        self.end: list[int] = []
        self.cover: list[float] = []
        self.radius: list[float] = []
        self.centre: list[np.ndarray] = []
        self.kids: list[list[int]] = []
        if len(points):
            self._build()
        self.norm = [float(np.sqrt(c @ c)) for c in self.centre]

    def _build(self) -> None:
        far = float(np.sqrt(((self.points - self.points[0]) ** 2).sum(1)).max())
        todo = [(0, len(self.points), self.points[0], far, -1)]
        while todo:
            a, b, centre, cover, up = todo.pop()
            rows = self.points[self.order[a:b]]
            far = float(np.sqrt(((rows - centre) ** 2).sum(1)).max())
            while far and cover / 2 >= far:  # levels in which the node has itself for its only kid
                cover /= 2
            me = len(self.first)
            self.first.append(a), self.end.append(b), self.cover.append(cover), self.radius.append(far), self.centre.append(centre), self.kids.append([])
            if up >= 0:
                self.kids[up].append(me)
            if b - a <= self.leaf or not far:
                continue
            centres, owner, near = farthest_first(rows, centre, KIDS, cover / 2)
            if near.max() > cover / 2:
                continue
            by = np.argsort(owner, kind="stable")
            self.order[a:b] = self.order[a:b][by]
            cuts = np.searchsorted(owner[by], np.arange(len(centres) + 2))
            for c, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if y > x:
                    todo.append((a + x, a + y, centre if c == 0 else rows[centres[c - 1]], cover / 2, me))


class Best:
    """The k best (score, id) of each query so far, worst last; ids break ties upwards."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score = np.full((n, k), NONE, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor  # worst kth scores that are known from elsewhere

    def worst(self, a: int, b: int) -> int:
        return int(np.maximum(self.score[a:b, -1], self.floor[a:b]).min())

    def offer(self, a: int, b: int, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        k, m = self.score.shape[1], len(ids)
        own_place = own[a:b, None] == ids[None, :]
        if own_place.any():
            scores = np.where(own_place, NONE, scores)
        least = np.maximum(np.maximum(self.score[a:b, -1], self.floor[a:b]), NONE + 1)
        if m > k:
            least = np.maximum(least, np.partition(scores, m - k, 1)[:, m - k])
        row, col = np.nonzero(scores >= least[:, None])
        if not len(row):
            return
        rows = np.unique(row)
        row = np.concatenate([row, np.repeat(rows, k)])
        s = np.concatenate([scores[row[: len(col)], col], self.score[a:b][rows].ravel()])
        i = np.concatenate([ids[col], self.id[a:b][rows].ravel()])
        by = np.lexsort((i, -s, row))
        row, s, i = row[by], s[by], i[by]
        starts = np.searchsorted(row, rows)
        take = starts[:, None] + np.arange(k)[None, :]
        self.score[a + rows], self.id[a + rows] = s[take], i[take]


def dual_search(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, score, id) of candidates that can be among the k best."""
    qt, dt = CoverTree(queries.astype(np.float64), QUERY_LEAF), CoverTree(data.astype(np.float64))
    exact = len(queries) and len(data) and np.sqrt((qt.points**2).sum(1)).max() * np.sqrt((dt.points**2).sum(1)).max() < EXACT
    qs, ds = (qt.points[qt.order], dt.points[dt.order]) if exact else (queries[qt.order], data[dt.order])
    own, floor, ids = own[qt.order], floor[qt.order], ids[dt.order]
    best = Best(len(queries), k, floor)

    def bound(q: int, d: int) -> float:
        most = float(qt.centre[q] @ dt.centre[d]) + qt.norm[q] * dt.radius[d] + dt.norm[d] * qt.radius[q] + qt.radius[q] * dt.radius[d]
        return most + 1e-9 * (qt.norm[q] + qt.radius[q]) * (dt.norm[d] + dt.radius[d]) + 1e-6

    stack = [(bound(0, 0), 0, 0)] if len(queries) and len(data) else []
    while stack:
        most, q, d = stack.pop()
        a, b = qt.first[q], qt.end[q]
        if most < best.worst(a, b):
            continue
        if not qt.kids[q] and not dt.kids[d]:
            for x in range(dt.first[d], dt.end[d], 4096):
                y = min(dt.end[d], x + 4096)
                best.offer(a, b, (qs[a:b] @ ds[x:y].T).astype(np.int64), ids[x:y], own)
            continue
        split_q = bool(qt.kids[q]) and (not dt.kids[d] or qt.radius[q] > dt.radius[d])
        pairs = [(bound(c, d), c, d) for c in qt.kids[q]] if split_q else [(bound(q, c), q, c) for c in dt.kids[d]]
        stack += sorted(pairs)  # the most promising last, so first
    row, at = np.nonzero((best.score > NONE) & (best.score >= floor[:, None]))
    return qt.order[row], best.score[row, at], best.id[row, at]


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows, padded by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy()
    return out


def lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def quantized(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id and v (array of longs) of the rows that take part."""
    sound = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(column, lambda x: F.floor(x.cast("double") * 1024.0)).alias("v"))


def _split(rows: DataFrame, big: DataFrame, width: int, base: int) -> tuple[DataFrame, DataFrame]:
    """rows (id, v, node, away, chain) of the nodes big (node, centre, n, shells) dealt to kids, and the kids, numbered from base: node, parent, centre, of (rows of the parent), shells (the parent was cut in shells)."""
    draw = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < F.ceil(F.lit(SAMPLE << 20) / F.col("n"))

    def choose(key: tuple, node: pa.Table, drawn: pa.Table) -> pa.Table:
        points, centre = matrix(drawn.column("v"), width), matrix(node.column("centre"), width)[0]
        most = min(KIDS, 2 * -(-node.column("n")[0].as_py() // ROWS))
        if node.column("shells")[0].as_py() and len(points):
            away = np.sort(drawn.column("away").to_numpy())
            low = np.unique(away[np.arange(most) * len(away) // most])
            middle = np.searchsorted(away, low) + np.diff(np.append(np.searchsorted(away, low), len(away))) // 2
            centres, low = points[np.argsort(drawn.column("away").to_numpy())[middle]], np.concatenate([[-1.0], low[1:]])
        else:
            taken, _, _ = farthest_first(points.astype(float), centre.astype(float), most)
            centres, low = np.concatenate([centre[None, :], points[taken]]), np.full(len(taken) + 1, -1.0)
        n = len(centres)
        return pa.table({"parent": pa.array([key[0].as_py()] * n, pa.int64()), "i": pa.array(np.arange(n)), "centre": lists(centres), "low": pa.array(low)})

    drawn = rows.join(big.select("node", "n"), "node").where(draw).select("node", "v", "away")
    chosen = big.select("node", "centre", "n", "shells").groupBy("node").cogroup(drawn.groupBy("node")).applyInArrow(choose, "parent long, i long, centre array<bigint>, low double")
    of = big.select(F.col("node").alias("parent"), F.col("n").alias("of"), "shells")
    kids = written(global_index(chosen, F.col("parent"), F.col("i"), name="node").withColumn("node", F.col("node") + base).join(of, "parent"))

    def deal(some: pa.Table, centres: pa.Table) -> pa.Table:
        if not some.num_rows:
            return some.select(["id", "v", "node", "away", "chain"])
        centres = centres.sort_by("kid")
        points, at = matrix(some.column("v"), width).astype(float), matrix(centres.column("centre"), width).astype(float)
        if centres.column("shells")[0].as_py():
            owner = np.searchsorted(centres.column("low").to_numpy(), some.column("away").to_numpy(), "right") - 1
        else:
            owner = ((points**2).sum(1)[:, None] - 2 * points @ at.T + (at**2).sum(1)[None, :]).argmin(1)
        node = centres.column("kid").to_numpy()[owner]
        chain = pa.array([[*c, n] for c, n in zip(some.column("chain").to_pylist(), node.tolist(), strict=True)], pa.list_(pa.int64()))
        return pa.table({"id": some.column("id"), "v": some.column("v"), "node": pa.array(node), "away": pa.array(np.sqrt(((points - at[owner]) ** 2).sum(1))), "chain": chain})

    shares = big.select("node", F.ceil(F.col("n") / (4 * ROWS)).cast("int").alias("shares"))
    salted = rows.join(shares, "node").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).drop("shares")
    copies = kids.withColumnRenamed("node", "kid").join(shares.withColumnRenamed("node", "parent"), "parent").select(F.col("parent").alias("node"), "kid", "centre", "low", "shells", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"))
    dealt = salted.groupBy("node", "salt").cogroup(copies.groupBy("node", "salt")).applyInArrow(deal, "id long, v array<bigint>, node long, away double, chain array<bigint>")
    return dealt, kids.select("node", "parent", "centre", "of", "shells")


def grow(rows: DataFrame, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """id, v, node (leaf), chain (its ancestors, itself last) and part of rows (id, v), and the nodes by level: node, parent, centre, radius, n."""
    first = rows.agg(F.min_by("v", F.xxhash64("id"))).first()[0] or []  # the root's centre: one row
    top = np.array([*first, *[0] * (width - len(first))], np.int64)
    kids = rows.sparkSession.createDataFrame([(0, -1, top.tolist(), 1 << 62, False)], "node long, parent long, centre array<bigint>, of long, shells boolean")

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = (matrix(batch.column(1), width) - top).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(len(away), np.int64)), pa.array(np.sqrt((away**2).sum(1))), pa.array([[0]] * len(away), pa.list_(pa.int64()))], ["id", "v", "node", "away", "chain"])

    data = written(rows.mapInArrow(far, "id long, v array<bigint>, node long, away double, chain array<bigint>"))
    levels, leaves, base = [], [], 1
    while True:
        sizes = data.groupBy("node").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        level = written(kids.join(sizes, "node"))
        levels.append(level.select("node", "parent", "centre", "radius", "n"))
        stuck = F.col("n") > F.col("of") / 2
        big = level.where((F.col("n") > ROWS) & (F.col("radius") > 0) & ~(stuck & F.col("shells"))).select("node", "centre", "n", stuck.alias("shells"))
        if len(levels) == LEVELS:
            big = big.limit(0)
        leaves.append(data.join(big.select("node"), "node", "left_anti"))
        if not big.head(1):
            break
        dealt, kids = _split(data.join(big.select("node"), "node", "left_semi"), big, width, base)
        base += kids.count()
        data = written(dealt)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x)
    parts = F.ceil(F.col("n") / ROWS).cast("int")
    out = out.join(nodes.select("node", "n"), "node").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return written(out.select("id", "v", "node", "chain", "parts", "part")), levels


def _groups(queries: DataFrame) -> DataFrame:
    """query_id, node, g (the highest node above the query with ROWS queries at most, else its leaf) and chunk (of ROWS queries)."""
    above = queries.select("query_id", "node", F.posexplode("chain").alias("depth", "g"))
    counts = above.groupBy("g").agg(F.count("*").alias("n"))
    large = F.col("n") > ROWS
    least = F.min(F.struct(large.alias("large"), F.when(large, -F.col("depth")).otherwise(F.col("depth")).alias("d"), "g", "n")).alias("least")
    chosen = above.join(counts, "g").groupBy("query_id", "node").agg(least)
    return chosen.select("query_id", "node", "least.g", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("least.n") / ROWS)).cast("int").alias("chunk"))


def _bound(a: Column, ra: Column, b: Column, rb: Column) -> Column:
    """Highest inner product of a point of one ball with a point of another."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t), F.lit(0.0), lambda s, t: s + F.coalesce(t, F.lit(0.0)))
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return dot(a, b) + na * rb + nb * ra + ra * rb + 1e-9 * (na + ra) * (nb + rb) + 1e-6


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products with all other rows. is_query: over id."""
    rows = written(quantized(vectors, key, column))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    data, levels = grow(rows, width)
    queries = written(data.where(is_query).withColumnRenamed("id", "query_id"))

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        own = q.column("query_id").to_numpy()
        row, score, ids = dual_search(matrix(q.column("v"), width), own, q.column("floor").to_numpy(), matrix(d.column("v"), width), d.column("id").to_numpy(), k)
        return pa.table({"query_id": own[row].astype(np.int64), "vec_id": ids, "score": score})

    def search(asked: DataFrame, given: DataFrame, where: list[str]) -> DataFrame:
        """Candidates that can be among the k best, from rows of the same key."""
        by = [F.col(c) for c in where]
        asked, given = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (asked, given))  # so that both sides can come from one table
        return asked.groupBy(*by).cogroup(given.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = search(queries.withColumn("floor", F.lit(NONE).cast("long")), data, ["node", "part"])
    kth = home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    asked = queries.select("query_id", "v", "node").join(kth, "query_id", "left").join(_groups(queries), ["query_id", "node"])
    asked = written(asked.select("query_id", "v", F.coalesce("floor", F.lit(NONE).cast("long")).alias("floor"), "g", "chunk"))
    groups = asked.groupBy("g", "chunk").agg(F.min("floor").alias("worst"))
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x)
    groups = groups.join(nodes.select(F.col("node").alias("g"), F.col("centre").alias("c"), F.col("radius").alias("r")), "g")
    pairs = written(groups.withColumn("node", F.lit(0).cast("long")))  # written, so that the first join is one by equality
    for level in levels[1:]:
        kids = level.select(F.col("parent").alias("node"), F.col("node").alias("kid"), "centre", "radius")
        pairs = pairs.join(kids, "node", "left").where(F.col("kid").isNull() | (_bound(F.col("c"), F.col("r"), F.col("centre"), F.col("radius")) >= F.col("worst")))
        pairs = written(pairs.select("g", "chunk", "worst", "c", "r", F.coalesce("kid", "node").alias("node")))
    pairs = pairs.select("g", "chunk", "node")
    parts = nodes.select("node", F.ceil(F.col("n") / ROWS).cast("int").alias("parts"))
    left = asked.join(pairs.join(parts, "node"), ["g", "chunk"]).select("query_id", "v", "floor", "g", "chunk", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = data.join(pairs, "node").select("id", "v", "g", "chunk", "node", "part")
    found = search(left, right, ["g", "chunk", "node", "part"])
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_of_hundredths(embeddings: DataFrame) -> DataFrame:
    """The query: every row whose vec_id is divisible by 100, against all rows."""
    return top_k(embeddings, F.col("id") % 100 == 0)
