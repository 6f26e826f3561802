"""All texts against all bags in blocks, for scores, losses and retrieval without a small batch.

Texts are dealt to blocks of rows at most, bags to blocks of about as many candidates; a bag with more
candidates than that is dealt in pieces. A task holds one block of each side, multiplies them with numpy a
slice at a time and returns, instead of its scores, a partial for every text and every bag: the largest
score, the sum of exp(score - largest), the same weighted by the score, and the best partner. Partials add
up in any order. Scores of bags in pieces are returned as (largest, sum of exp) by pair and closed by a
group before they join the others: only such pairs are ever rows. Each row travels once for every block
of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import draw, global_index, written

ROWS = 4096  # texts or candidates of a block
CELLS = 1 << 20  # scores that a task holds at a time
PARTIAL = "batch {0}, side string, id long, pair long, m double, s double, x double, top double, best long, own double"


def _blocks(units: DataFrame, rows: int) -> DataFrame:
    """units (batch, id, piece, n) with block: consecutive numbers within a batch, of rows at most unless one unit has more."""
    placed = global_index(units, F.col("batch"), draw("block", "id", "piece"), F.col("id"), F.col("piece"), name="start", weight=F.col("n"))
    first = placed.groupBy("batch").agg(F.min("start").alias("first"))
    return written(placed.join(first, "batch").select("batch", "id", "piece", F.floor((F.col("start") - F.col("first")) / rows).alias("block")))


def _dealt(side: DataFrame, blocks: DataFrame, others: DataFrame, mine: str, other: str) -> DataFrame:
    """side with its block as mine, once for every block of the other side."""
    many = others.groupBy("batch").agg(F.max("block").alias("last"))
    return side.join(blocks, ["batch", "id", "piece"]).withColumnRenamed("block", mine).join(many, "batch").withColumn(other, F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")


def _close(pairs: DataFrame, tau: float) -> DataFrame:
    """Partials of single scores: pairs (batch, i, j, m, s) of bags in pieces, added up."""
    top = F.max("m").over(Window.partitionBy("batch", "i", "j"))
    one = pairs.withColumn("top", top).groupBy("batch", "i", "j").agg((F.max("top") + tau * F.log(F.sum(F.col("s") * F.exp((F.col("m") - F.col("top")) / tau)))).alias("l"))
    own = F.when(F.col("i") == F.col("j"), F.col("l"))
    side = lambda name, me, you: one.select("batch", F.lit(name).alias("side"), F.col(me).alias("id"), F.lit(None).cast("long").alias("pair"), F.col("l").alias("m"), F.lit(1.0).alias("s"), F.col("l").alias("x"), F.round("l", 9).alias("top"), F.col(you).alias("best"), own.alias("own"))
    return side("text", "i", "j").unionByName(side("bag", "j", "i"))


def bag_scores(texts: DataFrame, cands: DataFrame, tau: float = 0.05, batch: Column | None = None, rows: int = ROWS) -> DataFrame:
    """Batch, side (text or bag), id, own, lse, best and entropy over the scores tau * logsumexp_r(t . z_r / tau).

    texts: sample_id, t; cands: sample_id, r, z. own: the score with the sample's own partner (null without one); lse and entropy:
    of the softmax over all partners of the batch (all rows without one); best: the partner of the largest score, the lesser
    sample_id of equals (to nine digits). Rows without a vector or an id take no part, nor do texts and bags without a partner.
    """
    tau = max(float(tau), 1e-6)
    group = batch if batch is not None else F.lit(0)
    t = written(texts.where("sample_id is not null and t is not null").select(group.alias("batch"), F.col("sample_id").alias("id"), F.lit(0).alias("piece"), F.col("t").alias("v")))
    c = cands.where("sample_id is not null and z is not null").select(group.alias("batch"), F.col("sample_id").alias("id"), "r", F.col("z").alias("v"))
    sizes = c.groupBy("batch", "id").agg(F.ceil(F.count("*") / rows).cast("int").alias("pieces"))
    c = written(c.join(sizes, ["batch", "id"]).withColumn("piece", F.pmod(F.xxhash64("r"), F.col("pieces")).cast("int")).drop("r"))
    units = lambda df: df.groupBy("batch", "id", "piece").agg(F.count("*").alias("n"))
    tb, cb = _blocks(units(t), rows), _blocks(units(c), rows)
    kind = t.schema["batch"].dataType.simpleString()

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        names = ["batch", "side", "id", "pair", "m", "s", "x", "top", "best", "own"]
        out = []

        def add(side, ids, pair, m, s, x, top, best, own):
            n = len(ids)
            none = np.full(n, np.nan)
            cols = [pa.array([key[0].as_py()] * n, key[0].type), pa.array([side] * n, pa.string()), pa.array(ids, pa.int64()), pa.array(pair, pa.int64()) if pair is not None else pa.nulls(n, pa.int64())]
            cols += [pa.array(none if v is None else v, pa.float64()) for v in (m, s, x, top)]
            cols += [pa.array(best, pa.int64()) if best is not None else pa.nulls(n, pa.int64())]
            cols += [pa.array(own, pa.float64(), mask=np.isnan(own)) if own is not None else pa.nulls(n, pa.float64())]
            out.append(pa.table(dict(zip(names, cols, strict=True))))

        if left.num_rows and right.num_rows:
            stack = lambda table: table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            by_text, by_bag = np.argsort(left.column("id").to_numpy(), kind="stable"), np.argsort(right.column("id").to_numpy(), kind="stable")
            i, a = left.column("id").to_numpy()[by_text], stack(left)[by_text]
            bag, b, pieces = right.column("id").to_numpy()[by_bag], stack(right)[by_bag], right.column("pieces").to_numpy()[by_bag]
            j, starts, counts = np.unique(bag, return_index=True, return_counts=True)
            whole = pieces[starts] == 1
            col_m, col_s, col_x = np.full(len(j), -np.inf), np.zeros(len(j)), np.zeros(len(j))
            col_top, col_best, col_own = np.full(len(j), -np.inf), np.zeros(len(j), np.int64), np.full(len(j), np.nan)
            step = max(1, CELLS // len(b))
            for at in range(0, len(i), step):
                ids, dots = i[at : at + step], a[at : at + step] @ b.T
                m = np.maximum.reduceat(dots, starts, axis=1)
                s = np.add.reduceat(np.exp((dots - np.repeat(m, counts, axis=1)) / tau), starts, axis=1)
                if (~whole).any():
                    open_ = np.flatnonzero(~whole)
                    add("pair", np.repeat(ids, len(open_)), np.tile(j[open_], len(ids)), m[:, open_].ravel(), s[:, open_].ravel(), None, None, None, None)
                if not whole.any():
                    continue
                score, js = (m + tau * np.log(s))[:, whole], j[whole]
                near = np.round(score, 9)
                own = np.where(ids[:, None] == js[None, :], score, np.nan)
                top = score.max(1)
                e = np.exp(score - top[:, None])
                best = near.argmax(1)
                has = (ids[:, None] == js[None, :]).any(1)
                mine = np.full(len(ids), np.nan)
                mine[has] = np.nanmax(own[has], axis=1)
                add("text", ids, None, top, e.sum(1), (e * score).sum(1), near[np.arange(len(ids)), best], js[best], mine)
                new = np.maximum(col_m[whole], score.max(0))
                e = np.exp(score - new[None, :])
                keep = np.exp(col_m[whole] - new)
                col_s[whole] = col_s[whole] * keep + e.sum(0)
                col_x[whole] = col_x[whole] * keep + (e * score).sum(0)
                col_m[whole] = new
                first = near.argmax(0)
                better = near[first, np.arange(len(js))] > col_top[whole]
                col_best[whole] = np.where(better, ids[first], col_best[whole])
                col_top[whole] = np.maximum(near[first, np.arange(len(js))], col_top[whole])
                has = (ids[:, None] == js[None, :]).any(0)
                at_whole = np.flatnonzero(whole)[has]
                col_own[at_whole] = np.nanmax(own[:, has], axis=0)
            if whole.any():
                add("bag", j[whole], None, col_m[whole], col_s[whole], col_x[whole], col_top[whole], col_best[whole], col_own[whole])
        if not out:
            add("text", np.zeros(0, np.int64), None, *[np.zeros(0)] * 4, np.zeros(0, np.int64), np.zeros(0))
        return pa.concat_tables(out)

    left, right = _dealt(t, tb, cb, "a", "b"), _dealt(c, cb, tb, "b", "a")
    by = ["batch", "a", "b"]
    found = written(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, PARTIAL.format(kind)))
    pairs = found.where("side = 'pair'").select("batch", F.col("id").alias("i"), F.col("pair").alias("j"), "m", "s")
    parts = found.where("side <> 'pair'").unionByName(_close(pairs, tau))
    top = F.max("m").over(Window.partitionBy("batch", "side", "id"))
    share = F.exp(F.col("m") - F.col("all"))
    sums = parts.withColumn("all", top).groupBy("batch", "side", "id").agg(
        F.max("own").alias("own"), F.max("all").alias("m"), F.sum(F.col("s") * share).alias("s"), F.sum(F.col("x") * share).alias("x"), F.max_by("best", F.struct("top", -F.col("best"))).alias("best"),
    )
    lse = F.col("m") + F.log("s")
    return sums.select("batch", "side", "id", "own", lse.alias("lse"), "best", (lse - F.col("x") / F.col("s")).alias("entropy"))


def contrastive_summary(scores: DataFrame) -> DataFrame:
    """Batch, n, loss (mean of both directions), accuracy of rows and of columns, mean entropy of texts and of bags. n: samples on both sides."""
    paired = F.col("own").isNotNull()
    of = lambda side, value: F.avg(F.when(paired & (F.col("side") == side), value))
    miss, hit = F.col("lse") - F.col("own"), (F.col("best") == F.col("id")).cast("double")
    return scores.groupBy("batch").agg(
        F.count_if(paired & (F.col("side") == "text")).alias("n"), ((of("text", miss) + of("bag", miss)) / 2).alias("loss"), of("text", hit).alias("row_accuracy"), of("bag", hit).alias("col_accuracy"),
        F.avg(F.when(F.col("side") == "text", F.col("entropy"))).alias("text_entropy"), F.avg(F.when(F.col("side") == "bag", F.col("entropy"))).alias("bag_entropy"),
    )


def weighted_summary(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Side, loss = sum(w * ce) / sum(w) and weighted accuracy of texts to bags and of bags to texts (weights: id, w)."""
    d = scores.where("own is not null").join(weights, "id")
    hit = (F.col("best") == F.col("id")).cast("double")
    return d.groupBy("side").agg(F.try_divide(F.sum((F.col("lse") - F.col("own")) * F.col("w")), F.sum("w")).alias("loss"), F.try_divide(F.sum(hit * F.col("w")), F.sum("w")).alias("accuracy"))


def image_text_scores(images: DataFrame, texts: DataFrame, scale: float, batch: Column | None = None, rows: int = ROWS) -> DataFrame:
    """bag_scores of scale * cosine: images (sample_id, z) are the text side, texts (sample_id, z) bags of one."""
    from groundspark.functions import vectors as V

    a = images.select("*", F.transform(V.l2_normalize("z"), lambda x: x * scale).alias("t"))
    b = texts.select(*[c for c in texts.columns if c != "z"], V.l2_normalize("z").alias("z")).withColumn("r", F.lit(0))
    return bag_scores(a, b, 1.0, batch, rows)


def best_partners(left: DataFrame, right: DataFrame, rows: int = ROWS) -> DataFrame:
    """id, best, score: for every row of left (id, v) the row of right (id, v) with the largest dot product, to nine digits; the lesser id of equals.

    For any number of rows on both sides: blocks as above, one row of each left row and block leaves a task. Ids are unique on
    their side; rows without an id or a vector take no part.
    """
    side = lambda df: written(df.where("id is not null and v is not null").select(F.lit(0).alias("batch"), "id", F.lit(0).alias("piece"), F.col("v").cast("array<double>").alias("v")))
    a, b = side(left), side(right)
    units = lambda df: df.select("batch", "id", "piece", F.lit(1).alias("n"))
    ab, bb = _blocks(units(a), rows), _blocks(units(b), rows)

    def run(key, these, those):
        import numpy as np
        import pyarrow as pa

        stack = lambda table: table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        at, top = np.zeros(0, np.int64), np.zeros(0)
        if those.num_rows and these.num_rows:
            those = those.sort_by("id")
            x, y = stack(these), stack(those)
            step = max(1, CELLS // len(y))
            found = [(n.argmax(1), n.max(1)) for n in (np.round(x[i : i + step] @ y.T, 9) for i in range(0, len(x), step))]
            at, top = (np.concatenate(c) for c in zip(*found, strict=True))
        else:
            these = these.slice(0, 0)
        return pa.table({"id": these.column("id"), "best": those.column("id").take(pa.array(at)), "score": pa.array(top)})

    kind = lambda df: df.schema["id"].dataType.simpleString()
    x, y = _dealt(a, ab, bb, "a", "b"), _dealt(b, bb, ab, "b", "a")
    by = ["a", "b"]
    found = x.groupBy(*by).cogroup(y.groupBy(*by)).applyInArrow(run, f"id {kind(a)}, best {kind(b)}, score double")
    top = found.groupBy("id").agg(F.max("score").alias("score"))
    return found.join(top, ["id", "score"]).groupBy("id").agg(F.min("best").alias("best"), F.first("score").alias("score"))
