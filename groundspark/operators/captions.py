"""Caption metrics over a corpus: BLEU, ROUGE-L, CIDEr.

Input: key, hyp (tokens) and ref (tokens of one reference) or refs (an array of references). Keys are unique. A caption without
references scores 0; in BLEU it has nothing to hit and a reference length of 0. Null references count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngrams(c: Column, n: int) -> Column:
    return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.array_join(F.slice(c, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def gram_counts(df: DataFrame, column: str, most: int = 4, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """keys, n, gram, c."""
    sized = lambda n: F.transform(ngrams(F.col(column), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    grams = F.flatten(F.array(*[sized(n) for n in range(1, most + 1)]))
    return df.select(*keys, F.explode(grams).alias("g")).groupBy(*keys, "g.n", "g.gram").agg(F.count("*").alias("c"))


def with_references(df: DataFrame) -> DataFrame:
    """key, hyp, refs from either form."""
    refs = F.col("refs") if "refs" in df.columns else F.array("ref")
    return df.select("key", "hyp", F.coalesce(F.filter(refs, lambda r: r.isNotNull()), F.array().cast("array<array<string>>")).alias("refs"))


def reference_counts(df: DataFrame, most: int) -> DataFrame:
    """key, place (of the reference), n, gram, c."""
    return gram_counts(df.select("key", F.posexplode("refs").alias("place", "ref")), "ref", most, ("key", "place"))


def bleu(df: DataFrame, most: int = 4) -> DataFrame:
    """Corpus bleu_1 .. bleu_most: clipped precisions' geometric mean with the brevity penalty; one row.

    A caption's counts are clipped at the largest count in one of its references; its reference length is that closest to
    its own, the shorter of two.
    """
    d = with_references(df)
    h, r = gram_counts(d, "hyp", most), reference_counts(d, most).groupBy("key", "n", "gram").agg(F.max("c").alias("rc"))
    p = h.join(r, ["key", "n", "gram"], "left").groupBy("n").agg(F.sum(F.least("c", F.coalesce("rc", F.lit(0)))).alias("hit"), F.sum("c").alias("all"))
    own = F.coalesce(F.size("hyp"), F.lit(0))
    closest = F.array_min(F.transform("refs", lambda r: F.struct(F.abs(F.size(r) - own).alias("off"), F.size(r).alias("length"))))["length"]
    size = d.agg(F.sum(own).alias("h"), F.sum(F.coalesce(closest, F.lit(0))).alias("r"))
    log = p.select("n", F.log(F.greatest(F.col("hit").cast("double"), F.lit(1e-9)) / F.col("all")).alias("lp"))
    one = log.crossJoin(F.broadcast(size)).groupBy("h", "r").agg(*[F.avg(F.when(F.col("n") <= k, F.col("lp"))).alias(f"m{k}") for k in range(1, most + 1)])
    bp = F.when(F.col("h") < F.col("r"), F.exp(1 - F.col("r") / F.col("h"))).otherwise(1.0)
    return one.select(*[(F.exp(f"m{k}") * bp).alias(f"bleu_{k}") for k in range(1, most + 1)])


def rouge_l(df: DataFrame, beta: float = 1.2) -> DataFrame:
    """Key, rouge_l by the longest common subsequence, computed in Arrow batches; precision and recall are each the largest over the references."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def common(a: list, b: list) -> int:
            if not a or not b:
                return 0
            ids = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
            y = np.array([ids[w] for w in b])
            row = np.zeros(len(b) + 1, np.int64)
            for w in a:  # row by row; the running maximum carries over
                new = row.copy()
                new[1:] = np.maximum(new[1:], row[:-1] + (y == ids[w]))
                row = np.maximum.accumulate(new)
            return int(row[-1])

        for batch in batches:
            h, r = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for a, bs in zip(h, r, strict=True):
                lengths = [common(a or [], b) for b in bs]
                p = max((n / len(a) for n in lengths if n), default=0.0)
                q = max((n / len(b) for n, b in zip(lengths, bs, strict=True) if n), default=0.0)
                out.append((1 + beta**2) * p * q / (q + beta**2 * p) if p else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["key", "rouge_l"])

    return with_references(df).mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, rouge_l double")


def cider(df: DataFrame, most: int = 4, sigma: float | None = None) -> DataFrame:
    """Key, cider: mean over n and over the references of the cosine of tf-idf vectors, times ten.

    Document frequency: captions with the gram in one of their references. With sigma, the form that doesn't reward repeats: the
    caption's weights are clipped at the reference's, and a cosine is damped by exp(-d^2 / (2 sigma^2)), d the difference in length.
    """
    d = with_references(df)
    total = d.agg(F.count("*").alias("docs"))
    h, r = gram_counts(d, "hyp", most), reference_counts(d, most)
    idf = r.select("key", "n", "gram").distinct().groupBy("n", "gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("n", "gram", F.log(F.col("docs").cast("double") / F.col("df")).alias("idf"))
    top = total.select(F.log(F.col("docs").cast("double")).alias("top"))
    weigh = lambda g, name: g.join(idf, ["n", "gram"], "left").crossJoin(F.broadcast(top)).withColumn(name, F.col("c") * F.coalesce("idf", "top")).drop("c", "idf", "top")
    a, b = weigh(h, "a"), weigh(r, "b")
    norms = lambda g, name, *keys: g.groupBy(*keys).agg(F.sqrt(F.sum(F.col(name) * F.col(name))).alias("n" + name))
    shared = F.least("a", "b") if sigma else F.col("a")
    dots = b.join(a, ["key", "n", "gram"]).groupBy("key", "place", "n").agg(F.sum(shared * F.col("b")).alias("ab"))
    pairs = dots.join(norms(a, "a", "key", "n"), ["key", "n"]).join(norms(b, "b", "key", "place", "n"), ["key", "place", "n"])
    damp = F.exp(-F.pow(F.size("hyp") - F.size(F.get("refs", F.col("place"))), F.lit(2)) / (2.0 * sigma**2)) if sigma else F.lit(1.0)
    cosines = pairs.join(d, "key").select("key", F.size("refs").alias("refs"), (F.coalesce(F.try_divide(F.col("ab"), F.col("na") * F.col("nb")), F.lit(0.0)) * damp).alias("cos"))
    sims = cosines.groupBy("key").agg((10 * F.sum(F.col("cos") / F.col("refs")) / most).alias("cider"))
    return d.select("key").join(sims, "key", "left").na.fill(0.0, ["cider"])
