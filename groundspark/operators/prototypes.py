"""Prototype codebooks: soft, hard and balanced assignment, losses, EMA updates, k-means, usage.

A codebook (proto_id, p) is small by definition (at most MOST rows, checked) and is sent to the tasks as
one array; objects are never shuffled to be assigned, and a task multiplies its batches with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.functions import vectors as V

from .util import cap_per_group, draw, written

MOST = 4096


def codebook(protos: DataFrame) -> DataFrame:
    """One row: ids and vectors in the order of proto_id."""
    if protos.count() > MOST:
        raise ValueError(f"a codebook has {MOST} prototypes at most")
    return protos.agg(F.sort_array(F.collect_list(F.struct("proto_id", "p"))).alias("cb"))


def similarities(objs: DataFrame, protos: DataFrame, vector: str = "z") -> DataFrame:
    """objs with sims: cosine to each prototype, in the order of proto_id; null for a vector that is null or of another length."""
    book = [_unit(r["p"]) for r in codebook(protos).first()["cb"]]  # at most MOST vectors
    keep = [c for c in objs.columns if c != "sims"]
    at = len(keep)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array(book, float).reshape(len(book), len(book[0]) if book else 0)
        for batch in batches:
            v = batch.column(at)
            fits = v.is_valid().to_numpy(zero_copy_only=False) & (v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == p.shape[1])
            z = v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(fits.sum()), p.shape[1])
            sims = (z / (np.sqrt((z * z).sum(1, keepdims=True)) + 1e-8)) @ p.T
            ends = pa.array(np.concatenate([[0], np.cumsum(fits * len(p))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.ListArray.from_arrays(ends, pa.array(sims.ravel()), mask=pa.array(~fits))], [*keep, "sims"])

    schema = T.StructType([objs.schema[c] for c in keep] + [T.StructField("sims", T.ArrayType(T.DoubleType()))])
    return objs.select(*keep, F.col(vector).alias("__vector")).mapInArrow(run, schema)


def soft_assign(objs: DataFrame, protos: DataFrame, tau: float = 0.07) -> DataFrame:
    """G1: q, the softmax of the cosines."""
    return similarities(objs, protos).withColumn("q", V.softmax("sims", max(tau, 1e-6)))


def hard_assign(objs: DataFrame, protos: DataFrame) -> DataFrame:
    """Proto, the index of the largest cosine (first of equals), and its similarity."""
    return similarities(objs, protos).withColumn("proto", V.argmax("sims")).withColumn("sim", F.array_max("sims"))


def recall(objs: DataFrame, protos: DataFrame, tau: float = 0.07) -> DataFrame:
    """R, the normalised mixture of prototypes by q; a matrix product in each batch."""
    book = [list(map(float, r["p"])) for r in codebook(protos).first()["cb"]]  # at most MOST vectors
    soft = soft_assign(objs, protos, tau)
    keep = soft.columns
    at = keep.index("q")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array(book, float).reshape(len(book), len(book[0]) if book else 0)
        for batch in batches:
            q = batch.column(at)
            known = q.is_valid().to_numpy(zero_copy_only=False)
            mixed = q.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), len(book)) @ p
            mixed /= np.sqrt((mixed * mixed).sum(1, keepdims=True)) + 1e-8
            ends = pa.array(np.concatenate([[0], np.cumsum(known * p.shape[1])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(mixed.ravel()), mask=pa.array(~known))], [*keep, "r"])

    return soft.mapInArrow(run, T.StructType([*soft.schema.fields, T.StructField("r", T.ArrayType(T.DoubleType()))]))


def column_sums(df: DataFrame, vector: Column, name: str = "sums") -> DataFrame:
    """One row: element-wise sums of an array column, added up by position."""
    parts = df.select(F.posexplode(vector).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    return parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias(name))


def sinkhorn(objs: DataFrame, protos: DataFrame, n_iters: int = 3, eps: float = 0.05) -> DataFrame:
    """Balanced assignment q. Only one scale a prototype moves between rounds: rows are scanned, never rewritten.

    q = exp((s - max s) / eps), scaled in turn to prototype mass 1/K and object mass 1/N, at last to rows of one.
    """
    s = similarities(objs, protos).withColumn("e", F.transform("sims", lambda x: F.exp((x - F.array_max("sims")) / eps)))
    s = written(s)  # cosines are computed once
    n, k = s.count(), protos.count()
    row = s.withColumn("v", F.lit(1.0))
    for _ in range(n_iters):
        mass = column_sums(row, F.transform("e", lambda x: x * F.col("v")))
        scale = mass.select(F.transform("sums", lambda x: F.try_divide(F.lit(1.0 / k), x)).alias("u"))
        u = scale.first()["u"]  # K numbers
        row = s.withColumn("u", F.array(*[F.lit(x) for x in u])).withColumn("v", F.try_divide(F.lit(1.0 / n), V.dot("e", "u"))).drop("u")
    last = F.array(*[F.lit(x) for x in (u if n_iters else [1.0] * k)])
    q = F.zip_with("e", last, lambda x, y: x * y)
    return s.withColumn("q", q).withColumn("q", F.transform("q", lambda x: x / V.total("q"))).drop("e")


def proto_loss(objs: DataFrame, protos: DataFrame, tau: float = 0.07, min_samples: int = 1, n_iters: int = 3, eps: float = 0.05) -> DataFrame:
    """Mean cross-entropy of log softmax(sim / tau) against Sinkhorn targets, or the hard ones where objects are too few."""
    n, k = objs.count(), protos.count()
    if n >= max(min_samples, k) and k > 1:
        t = sinkhorn(objs, protos, n_iters, eps)
    else:
        t = hard_assign(objs, protos).withColumn("q", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("proto")).cast("double")))
    logp = F.transform("sims", lambda x: (x - V.logsumexp("sims", tau)) / tau)
    return t.agg(F.avg(-V.dot("q", logp)).alias("loss"))


def batch_sums(objs: DataFrame, protos: DataFrame) -> DataFrame:
    """proto_id, size and element-wise vector sum of the objects assigned to each prototype (normalised vectors)."""
    ids = codebook(protos).select(F.transform("cb", lambda x: x["proto_id"]).alias("ids"))
    a = hard_assign(objs, protos).crossJoin(F.broadcast(ids)).select(F.get("ids", F.col("proto")).alias("proto_id"), V.l2_normalize("z").alias("u"))
    parts = a.select("proto_id", F.posexplode("u").alias("d", "x")).groupBy("proto_id", "d").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy("proto_id").agg(F.max("n").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("sum"))


def ema_update(state: DataFrame, batch: DataFrame, decay: float = 0.99, eps: float = 1e-3) -> DataFrame:
    """(proto_id, p, ema_size, ema_sum) moved towards a batch's sizes and sums; an empty batch changes nothing."""
    if not batch.head(1):
        return state.select("proto_id", "p", "ema_size", "ema_sum")
    j = state.join(batch, "proto_id", "left")
    size = F.col("ema_size") * decay + F.coalesce("size", F.lit(0)) * (1 - decay)
    zero = F.transform("ema_sum", lambda x: F.lit(0.0))
    sums = F.zip_with("ema_sum", F.coalesce("sum", zero), lambda a, b: a * decay + b * (1 - decay))
    moved = j.select("proto_id", size.alias("ema_size"), sums.alias("ema_sum"))
    return moved.select("proto_id", V.l2_normalize(F.transform("ema_sum", lambda x: x / (F.col("ema_size") + eps))).alias("p"), "ema_size", "ema_sum")


def kmeans_cosine(objs: DataFrame, k: int, n_iters: int = 10, seed: int = 0) -> DataFrame:
    """Spherical k-means: farthest-first start (first centre: the least draw), means of the assigned, empty ones moved to the farthest object.

    Each pass sends the K x D centres to the tasks, where numpy adds up vectors by centre; sums by centre and task are added in Spark.
    """
    spark = objs.sparkSession
    empty = spark.createDataFrame([], "proto_id int, p array<double>")
    rows = written(objs.select("obj_id", V.l2_normalize("z").alias("z")))
    first = rows.orderBy(draw(seed, "obj_id"), "obj_id").limit(1).collect()
    if not first:
        return empty
    centres = [first[0]["z"]]
    while len(centres) < k:
        centres.append(_pass(rows, centres)[1])
    for _ in range(n_iters):
        sums, spare = _pass(rows, centres)
        centres = [_unit(sums[i]) if i in sums else spare for i in range(k)]
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "proto_id int, p array<double>")


def _unit(v: list[float]) -> list[float]:
    norm = sum(x * x for x in v) ** 0.5 + 1e-8
    return [x / norm for x in v]


def _pass(rows: DataFrame, centres: list[list[float]]) -> tuple[dict[int, list[float]], list[float]]:
    """Sums of the vectors (obj_id, z) nearest to each centre, and the vector that is farthest from all centres (the least obj_id of equals)."""
    book = [_unit(c) for c in centres]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(book)
        sums, seen, far = np.zeros_like(c), np.zeros(len(c), bool), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, z = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), float)
            sims = (z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-8)) @ c.T
            own = sims.argmax(1)
            np.add.at(sums, own, z)
            seen[own] = True
            best = np.round(sims.max(1), 9)
            i = np.lexsort((ids, best))[0]
            now = (float(best[i]), int(ids[i]), z[i].tolist())
            far = now if far is None or now[:2] < far[:2] else far
        at = np.flatnonzero(seen)
        out = [(int(i), None, None, sums[i].tolist()) for i in at] + ([(-1, *far)] if far else [])
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["i", "s", "obj_id", "v"])

    parts = rows.select("obj_id", "z").mapInArrow(run, "i int, s double, obj_id long, v array<double>")
    added = parts.where("i >= 0").select("i", F.posexplode("v").alias("d", "x")).groupBy("i", "d").agg(F.sum("x").alias("x")).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda t: t["x"]).alias("v"))
    spare = parts.where("i < 0").groupBy("i").agg(F.min_by("v", F.struct("s", "obj_id")).alias("v"))
    found = {r.i: r.v for r in added.unionByName(spare).collect()}  # K + 1 vectors
    return {i: v for i, v in found.items() if i >= 0}, found[-1]


def warm_start(tracks: DataFrame, texts: DataFrame, k: int, min_sim: float = 0.25, need: int = 128, most: int | None = 4096, n_iters: int = 10, seed: int = 0) -> DataFrame | None:
    """K-means of the best track (sample_id, r, z) of each text (sample_id, t) with similarity min_sim, of most texts (None: of all); sizes 1 and sums as vectors. None with too few."""
    j = tracks.join(texts, "sample_id").withColumn("sim", V.cosine("z", "t"))
    best = j.groupBy("sample_id").agg(F.max("sim").alias("sim"), F.max_by("z", F.struct("sim", -F.col("r"))).alias("z")).where(F.col("sim") >= min_sim)
    sample = best if most is None else best.orderBy(draw(seed, "sample_id"), "sample_id").limit(most)
    sample = written(sample.select(F.col("sample_id").alias("obj_id"), "z"))
    n = sample.count()
    if n < max(need, k):
        return None
    return kmeans_cosine(sample, k, n_iters, seed).select("proto_id", "p", F.lit(1.0).alias("ema_size"), F.col("p").alias("ema_sum"))


def usage(objs: DataFrame, protos: DataFrame, tau: float = 0.07) -> DataFrame:
    """proto_id, usage (share of soft assignments), rank."""
    q = soft_assign(objs, protos, tau).select(F.posexplode("q").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    total = q.agg(F.sum("x").alias("t"))
    ids = codebook(protos).select(F.posexplode(F.transform("cb", lambda x: x["proto_id"])).alias("i", "proto_id"))
    u = q.join(ids, "i").crossJoin(F.broadcast(total)).select("proto_id", (F.col("x") / F.col("t")).alias("usage"))
    return u.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("usage", 9)), "proto_id")))  # K rows


def usage_summary(usage_: DataFrame) -> DataFrame:
    """K, effective_k (exp of the entropy of the shares) and gini of a usage table (proto_id, usage, rank); zeros without usage."""
    n, total = F.count("*").alias("k"), F.sum("usage")
    share = usage_.agg(n, total.alias("total"), F.sum((F.lit(1) - F.col("rank")) * F.col("usage")).alias("falling")).crossJoin(usage_.select("usage"))  # K rows
    p = F.try_divide("usage", F.greatest("total", F.lit(1e-12)))
    return share.groupBy("k", "total", "falling").agg(F.exp(-F.sum(p * F.log(F.greatest(p, F.lit(1e-12))))).alias("effective_k")).select(
        "k", "effective_k", F.when(F.col("total") > 0, 2 * (F.col("falling") + F.col("k") * F.col("total")) / (F.col("k") * F.col("total")) - (F.col("k") + 1) / F.col("k")).otherwise(0.0).alias("gini")
    )


def assigned_distances(objs: DataFrame, protos: DataFrame) -> DataFrame:
    """Objects with distance 1 - similarity to their prototype."""
    return hard_assign(objs, protos).withColumn("distance", 1 - F.col("sim"))


def usage_per_concept(protos: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept_id, usage summed over its prototypes (0 without any)."""
    return concepts.join(protos.groupBy("concept_id").agg(F.sum("usage").alias("usage")), "concept_id", "left").na.fill(0.0, ["usage"])


def dump_objects(objs: DataFrame, protos: DataFrame, most: int = 200, seed: int = 0) -> DataFrame:
    """At most a number of objects a concept with their assignment and the concept's total."""
    known = objs.where("concept_id >= 0")
    some = cap_per_group(known, ["concept_id"], most, draw(seed, "obj_id"), F.col("obj_id"))
    return hard_assign(some, protos).join(known.groupBy("concept_id").agg(F.count("*").alias("total")), "concept_id").select("obj_id", "concept_id", "proto", "total")


def dump_state(objs: DataFrame, protos: DataFrame, most: int = 200, seed: int = 0) -> DataFrame:
    """A summary of some objects that adds up with others (merge_dumps): rows of a concept's total and vector sums by place, and its most objects of the least draws with their prototype.

    concept_id, d (null: the total or an object), x (the total or the sum at d), obj_id, draw, proto.
    """
    known = objs.where("concept_id >= 0")
    none = lambda kind: F.lit(None).cast(kind)
    totals = known.groupBy("concept_id").agg(F.count("*").cast("double").alias("x")).select("concept_id", none("int").alias("d"), "x", none("long").alias("obj_id"), none("long").alias("draw"), none("int").alias("proto"))
    sums = known.select("concept_id", F.posexplode("z").alias("d", "x")).groupBy("concept_id", "d").agg(F.sum("x").alias("x")).select("concept_id", "d", "x", none("long").alias("obj_id"), none("long").alias("draw"), none("int").alias("proto"))
    kept = cap_per_group(known.withColumn("draw", draw(seed, "obj_id")), ["concept_id"], most, F.col("draw"), F.col("obj_id"))
    rows = hard_assign(kept, protos).select("concept_id", none("int").alias("d"), none("double").alias("x"), "obj_id", "draw", F.col("proto").cast("int").alias("proto"))
    return totals.unionByName(sums).unionByName(rows)


def merge_dumps(*states: DataFrame, most: int = 200) -> DataFrame:
    """The summary of the objects of all states together, of the same form, whatever their order or grouping."""
    all_ = states[0]
    for s in states[1:]:
        all_ = all_.unionByName(s)
    added = all_.where("obj_id is null").groupBy("concept_id", "d").agg(F.sum("x").alias("x"), F.max("obj_id").alias("obj_id"), F.max("draw").alias("draw"), F.max("proto").alias("proto"))
    return added.unionByName(cap_per_group(all_.where("obj_id is not null"), ["concept_id"], most, F.col("draw"), F.col("obj_id")))


def dumped(state: DataFrame) -> DataFrame:
    """The objects of a summary as dump_objects gives them."""
    totals = state.where("obj_id is null and d is null").select("concept_id", F.col("x").cast("long").alias("total"))
    return state.where("obj_id is not null").select("obj_id", "concept_id", "proto").join(totals, "concept_id").select("obj_id", "concept_id", "proto", "total")


def dumped_means(state: DataFrame) -> DataFrame:
    """concept_id, total and the mean vector of its objects."""
    totals = state.where("obj_id is null and d is null").select("concept_id", F.col("x").alias("total"))
    sums = state.where("d is not null").groupBy("concept_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("sums"))
    return sums.join(totals, "concept_id").select("concept_id", F.col("total").cast("long").alias("total"), F.transform("sums", lambda x: x / F.col("total")).alias("mean"))


def stratified_sample(df: DataFrame, key: str, id_: str, n: int, seed: int = 0) -> DataFrame:
    """N / number of keys rows of each key from 0."""
    kinds = max(1, df.where(F.col(key) >= 0).select(key).distinct().count())
    return cap_per_group(df.where(F.col(key) >= 0), [key], n // kinds, draw(seed, id_), F.col(id_))


def top_tracks(q_track: DataFrame, usage_: DataFrame, n: int = 5, pool: int = 32) -> DataFrame:
    """The n tracks (obj_id, q) of the highest q for each of the pool most used prototypes."""
    used = usage_.where(F.col("rank") <= pool).select("proto_id", "rank")
    rows = q_track.select("obj_id", F.posexplode("q").alias("proto_id", "score")).join(used, "proto_id")
    return cap_per_group(rows, ["proto_id"], n, F.desc(F.round("score", 9)), F.col("obj_id"), name="place").select("proto_id", "obj_id", "score", "place")


def select_diverse(cands: DataFrame, group_key: str, n: int = 4, max_sim: float = 0.92, penalty: float = 0.35) -> DataFrame:
    """From each group's top rows (group, obj_id, score, z): n rows one by one by score - penalty * similarity to those taken; the cap on similarity is eased twice."""

    def pick(pdf):
        import numpy as np

        pdf = pdf.sort_values(["score", "obj_id"], ascending=[False, True])
        z = np.array(pdf["z"].tolist(), float)
        z /= np.linalg.norm(z, axis=1, keepdims=True) + 1e-8
        score, taken = pdf["score"].to_numpy(), []
        for cap in (max_sim, 0.95, 1.0 + 1e-9):
            while len(taken) < min(n, len(pdf)):
                near = (z @ z[taken].T).max(1) if taken else np.zeros(len(pdf))
                value = np.round(score - penalty * near, 9)
                value[[i for i in range(len(pdf)) if i in taken or (taken and near[i] > cap)]] = -np.inf
                if not np.isfinite(value).any():
                    break
                taken.append(int(value.argmax()))
        out = pdf.iloc[taken][[group_key, "obj_id", "score"]].copy()
        out["place"] = np.arange(1, len(taken) + 1, dtype="int32")
        return out

    kind = cands.schema[group_key].dataType.simpleString()
    return cands.select(group_key, "obj_id", "score", "z").groupBy(group_key).applyInPandas(pick, f"{group_key} {kind}, obj_id long, score double, place int")


def top_texts(protos: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """The k texts (obj_id, z) nearest to each prototype; each task cuts to k before the shuffle."""
    s = similarities(texts, protos).select("obj_id", F.posexplode(F.transform("sims", lambda x: F.round(x, 9))).alias("i", "sim"))
    ids = codebook(protos).select(F.posexplode(F.transform("cb", lambda x: x["proto_id"])).alias("i", "proto_id"))
    return cap_per_group(s, ["i"], k, F.desc("sim"), F.col("obj_id"), name="place").join(ids, "i").select("proto_id", "obj_id", "sim", "place")
