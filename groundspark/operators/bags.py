"""Bags of candidates: tracks, null candidates, bag scores against texts, weights and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions import vectors as V

from .prototypes import similarities, soft_assign


def build_tracks(cands: DataFrame, sim_thresh: float = 0.55, max_tracks: int = 16) -> DataFrame:
    """sample_id, r, z, n_obs of greedy tracks over a sample's frames (sample_id, m, k, z, valid).

    In each frame candidates go by their best similarity to the tracks; only that track is tried, once a frame;
    the rest open new tracks; the tracks with the most observations stay. Bags are small; each is one group.
    """

    def track(pdf):
        import numpy as np
        import pandas as pd

        unit = lambda v: v / (np.linalg.norm(v) + 1e-8)
        tracks: list[list] = []  # mean, count
        for _, frame in pdf[pdf["valid"]].sort_values(["m", "k"]).groupby("m", sort=True):
            zs = [unit(np.asarray(z, float)) for z in frame["z"]]
            used, fresh = set(), []
            best = []
            for i, z in enumerate(zs):
                sims = [float(t[0] @ z) for t in tracks]
                j = int(np.argmax(sims)) if sims else -1
                best.append((-(sims[j] if sims else -2.0), i, j))
            for s, i, j in sorted(best):
                if j >= 0 and -s >= sim_thresh and j not in used:
                    used.add(j)
                    m, n = tracks[j]
                    tracks[j] = [unit((m * n + zs[i]) / (n + 1)), n + 1]
                else:
                    fresh.append([zs[i], 1])
            tracks = sorted(tracks + fresh, key=lambda t: -t[1])[:max_tracks]
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[0], "r": np.arange(len(tracks), dtype="int32"), "z": [t[0].tolist() for t in tracks], "n_obs": np.array([t[1] for t in tracks], "int32")})

    return cands.select("sample_id", "m", "k", "z", "valid").groupBy("sample_id").applyInPandas(track, "sample_id long, r int, z array<double>, n_obs int")


def flatten_candidates(cands: DataFrame) -> DataFrame:
    """All valid candidates as the bag."""
    w = Window.partitionBy("sample_id").orderBy("m", "k")
    return cands.where("valid").withColumn("r", F.row_number().over(w) - 1).select("sample_id", "r", "z", F.lit(1).alias("n_obs"))


def with_null(tracks: DataFrame, samples: DataFrame, null_vec: list[float]) -> DataFrame:
    """Tracks with one null candidate last in every sample."""
    n = tracks.groupBy("sample_id").agg((F.max("r") + 1).alias("r"))
    null = samples.select("sample_id").distinct().join(n, "sample_id", "left").select("sample_id", F.coalesce("r", F.lit(0)).alias("r"), F.array(*[F.lit(float(x)) for x in null_vec]).alias("z"), F.lit(0).alias("n_obs"), F.lit(True).alias("is_null"))
    return tracks.withColumn("is_null", F.lit(False)).unionByName(null)


def mil_logits(texts: DataFrame, cands: DataFrame, batch: Column, tau: float = 0.05) -> DataFrame:
    """Batch, i (text), j (bag), logit = tau * logsumexp over the bag's candidates of (t . c / tau), within a batch."""
    t = texts.select(batch.alias("batch"), F.col("sample_id").alias("i"), "t")
    bags = cands.groupBy(batch.alias("batch"), F.col("sample_id").alias("j")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "z"))), lambda x: x["z"]).alias("zs"))
    return t.join(bags, "batch").select("batch", "i", "j", V.logsumexp(F.transform("zs", lambda z: V.dot(F.col("t"), z)), tau).alias("logit"))


def contrastive_loss(logits: DataFrame) -> DataFrame:
    """Batch, n, loss (mean of both directions), accuracy of rows and of columns (first of equals)."""
    row, column = Window.partitionBy("batch", "i"), Window.partitionBy("batch", "j")
    lse = lambda w: F.max("logit").over(w) + F.log(F.sum(F.exp(F.col("logit") - F.col("top"))).over(w))
    a = logits.withColumn("top", F.max("logit").over(row)).withColumn("row_lse", lse(row)).withColumn("row_best", F.first("j").over(row.orderBy(F.desc(F.round("logit", 9)), "j")))
    b = a.withColumn("top", F.max("logit").over(column)).withColumn("col_lse", lse(column)).withColumn("col_best", F.first("i").over(column.orderBy(F.desc(F.round("logit", 9)), "i")))
    d = b.where("i = j")
    return d.groupBy("batch").agg(F.count("*").alias("n"), F.avg((F.col("row_lse") + F.col("col_lse")) / 2 - F.col("logit")).alias("loss"), F.avg((F.col("row_best") == F.col("j")).cast("double")).alias("row_accuracy"), F.avg((F.col("col_best") == F.col("i")).cast("double")).alias("col_accuracy"))


def candidate_weights(texts: DataFrame, cands: DataFrame, tau: float = 0.05) -> DataFrame:
    """sample_id, r, weight: softmax of similarities over the sample's own bag."""
    s = cands.join(texts, "sample_id").withColumn("s", V.dot("t", "z") / tau)
    w = Window.partitionBy("sample_id")
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("sample_id", "r", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def proto_mil(q_text: DataFrame, q_track: DataFrame, batch: Column, tau: float = 0.05) -> DataFrame:
    """Bag scores in the space of prototypes: q (text) against q (tracks)."""
    return mil_logits(q_text.select("sample_id", F.col("q").alias("t")), q_track.select("sample_id", "r", F.col("q").alias("z")), batch, tau)


def weighted_cross_entropy(logits: DataFrame, weights: DataFrame) -> DataFrame:
    """sum(w * ce) / sum(w) and weighted accuracy of texts (weights: i, w)."""
    w = Window.partitionBy("batch", "i")
    r = logits.withColumn("top", F.max("logit").over(w)).withColumn("lse", F.col("top") + F.log(F.sum(F.exp(F.col("logit") - F.col("top"))).over(w))).withColumn("best", F.first("j").over(w.orderBy(F.desc(F.round("logit", 9)), "j")))
    d = r.where("i = j").join(weights, "i")
    return d.agg(F.try_divide(F.sum((F.col("lse") - F.col("logit")) * F.col("w")), F.sum("w")).alias("loss"), F.try_divide(F.sum((F.col("best") == F.col("j")).cast("double") * F.col("w")), F.sum("w")).alias("accuracy"))


def align_weight(texts: DataFrame, tracks: DataFrame, centre: float = 0.10, width: float = 0.05, warm_up: bool = False) -> DataFrame:
    """sample_id, best_track (-1: none), best_sim, weight = sigmoid((sim - centre) / width) in 0.05 .. 1, 0 without tracks, 1 in warm-up."""
    j = texts.join(tracks, "sample_id").withColumn("sim", F.round(V.cosine("t", "z"), 9))
    best = j.groupBy("sample_id").agg(F.max_by("r", F.struct("sim", -F.col("r"))).alias("best_track"), F.max("sim").alias("best_sim"))
    out = texts.select("sample_id").join(best, "sample_id", "left").withColumn("best_track", F.coalesce("best_track", F.lit(-1)))
    w = F.when(F.col("best_sim").isNull(), 0.0).otherwise(F.least(F.greatest(1 / (1 + F.exp(-(F.col("best_sim") - centre) / width)), F.lit(0.05)), F.lit(1.0)))
    return out.withColumn("weight", F.lit(1.0) if warm_up else w)


def concept_weighted(best: DataFrame, tracks: DataFrame, cands: DataFrame, registry: DataFrame, anchor: int = 0) -> DataFrame:
    """Sample weight times the weight of the concept of the anchor frame's candidate nearest to the best track (1 without one)."""
    t = best.join(tracks, (best["sample_id"] == tracks["sample_id"]) & (best["best_track"] == tracks["r"])).select(best["sample_id"], "weight", F.col("z").alias("tz"))
    near = t.join(cands.where((F.col("m") == anchor) & F.col("valid")), "sample_id").withColumn("sim", F.round(V.cosine("tz", "z"), 9)).groupBy("sample_id").agg(F.max_by("gid", F.struct("sim", -F.col("k"))).alias("gid"))
    w = near.join(registry.select(F.col("global_id").alias("gid"), F.col("weight").alias("cw")), "gid", "left").select("sample_id", "gid", F.coalesce("cw", F.lit(1.0)).alias("cw"))
    return best.select("sample_id", "weight").join(w, "sample_id", "left").select("sample_id", "gid", (F.col("weight") * F.coalesce("cw", F.lit(1.0))).alias("weight"))


def kl(p: str | Column, q: str | Column, eps: float = 1e-8) -> Column:
    return V.total(F.zip_with(p, q, lambda a, b: a * (F.log(F.greatest(a, F.lit(eps))) - F.log(F.greatest(b, F.lit(eps))))))


def track_coherence(cands: DataFrame, tracks: DataFrame, protos: DataFrame, weights: DataFrame, min_sim: float = 0.30, tau: float = 0.07) -> DataFrame:
    """Weighted mean over samples of the mean KL(track || its best candidate a frame), for tracks seen in two frames; and the number of pairs."""
    qt = soft_assign(tracks.select("sample_id", "r", "z"), protos, tau).select("sample_id", "r", F.col("z").alias("tz"), F.col("q").alias("tq"))
    qc = soft_assign(cands.where("valid").select("sample_id", "m", "k", "z"), protos, tau).select("sample_id", "m", "k", "z", "q")
    j = qt.join(qc, "sample_id").withColumn("sim", F.round(V.cosine("tz", "z"), 9)).where(F.col("sim") >= min_sim)
    best = j.groupBy("sample_id", "r", "m").agg(F.max_by(kl("tq", "q"), F.struct("sim", -F.col("k"))).alias("kl"))
    per_track = best.groupBy("sample_id", "r").agg(F.count("*").alias("n"), F.avg("kl").alias("kl")).where("n >= 2")
    per = per_track.groupBy("sample_id").agg(F.avg("kl").alias("kl"), F.sum("n").alias("n")).join(weights.select("sample_id", "weight"), "sample_id")
    return per.agg(F.try_divide(F.sum(F.col("kl") * F.col("weight")), F.sum("weight")).alias("coherence"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


def weighted_cosine(df: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Weighted mean cosine of two vectors, and one minus it."""
    sim = F.try_divide(F.sum(V.cosine(a, b) * F.col(weight)), F.sum(weight))
    return df.agg(sim.alias("similarity"), (1 - sim).alias("loss"))


def concept_alignment(cands: DataFrame, concept_vecs: DataFrame, tau: float = 0.07) -> DataFrame:
    """Cross-entropy and accuracy of candidates (gid, z, is_patch) against unique concepts (proto_id, p), masks with an id only."""
    s = similarities(cands.where("not is_patch and gid >= 0"), concept_vecs)
    ids = concept_vecs.agg(F.sort_array(F.collect_list("proto_id")).alias("ids"))
    at = F.array_position("ids", F.col("gid")).cast("int") - 1
    j = s.crossJoin(F.broadcast(ids)).withColumn("at", at).where("at >= 0")
    return j.agg(F.count("*").alias("n"), F.avg((V.logsumexp("sims", tau) - F.get("sims", F.col("at"))) / tau).alias("loss"), F.avg((V.argmax("sims") == F.col("at")).cast("double")).alias("accuracy"))


def contrastive_logits(images: DataFrame, texts: DataFrame, batch: Column, scale: float) -> DataFrame:
    """Batch, i (image), j (text), logit = scale * cosine within a batch."""
    a = images.select(batch.alias("batch"), F.col("sample_id").alias("i"), V.l2_normalize("z").alias("a"))
    b = texts.select(batch.alias("batch"), F.col("sample_id").alias("j"), V.l2_normalize("z").alias("b"))
    return a.join(b, "batch").select("batch", "i", "j", (V.dot("a", "b") * scale).alias("logit"))


def track_frames(cands: DataFrame, tracks: DataFrame, n: int = 4) -> DataFrame:
    """sample_id, r and its n best frames in time order (fewer frames: the best one repeated)."""
    j = tracks.select("sample_id", "r", F.col("z").alias("tz")).join(cands.where("valid"), "sample_id").withColumn("sim", F.round(V.cosine("tz", "z"), 9))
    best = j.groupBy("sample_id", "r", "m").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("sample_id", "r").orderBy(F.desc("sim"), "m")
    top = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    g = top.groupBy("sample_id", "r").agg(F.sort_array(F.collect_list("m")).alias("ms"), F.max_by("m", -F.col("place")).alias("best"))
    return g.select("sample_id", "r", F.concat("ms", F.array_repeat("best", F.lit(n) - F.size("ms"))).alias("frames"))


def text_query(nouns: DataFrame, sentences: DataFrame) -> DataFrame:
    """sample_id, t: normalised mean of the noun vectors, else the normalised sentence vector."""
    parts = nouns.select("sample_id", F.posexplode("z").alias("d", "x")).groupBy("sample_id", "d").agg(F.avg("x").alias("x"))
    mean = parts.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    return sentences.join(mean, "sample_id", "left").select("sample_id", V.l2_normalize(F.coalesce("v", "z")).alias("t"))
