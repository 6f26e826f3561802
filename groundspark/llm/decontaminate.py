"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks, in DataFrame functions only.

A document holds an item when one of its windows of the item's size in words has a weighted Jaccard
similarity of THRESHOLD or more with it over shingles of SHINGLE words (weights: how often each
occurs; the n-th occurrence of a shingle counts as a shingle of its own, so sets say the same).

1. Places: a similar window misses a fifth of the item's shingles at most, so one of any fifth plus
   one of them is in it. Those with the longest word are the item's seeds. Texts are scanned for
   them, which tells where windows of which sizes are worth a look; it loses no window.
2. Windows: every window of such a size that holds such a place is fingerprinted, by SimHash of BITS
   bits over all its shingles. Equal texts are looked at once.
3. Candidates: the index holds the fingerprints of all items of a size, cut into BLOCKS blocks, each
   under every value of the ball of radius BALL around it. A window is looked up under its own block
   values, whatever item's seed led to it. That guarantees every item within RADIUS bits; the whole
   distance is checked next.
4. The exact similarity decides.

At a similarity of 0.8 and windows of equal size the distance has mean 19 and deviation 4, so RADIUS
31 leaves out about one in 700 of such pairs, and far fewer above. Documents that are shorter than
an item and have under FEW shingles can lie further off: their seeds' items are all verified.

Defined results: null and blank texts hold nothing and blank items are never held; an item of fewer
words than a shingle is one shingle; a document shorter than the item is one window; rows of equal
key are reported together; items of equal id are told apart by their words and reported together,
those without an id under a null; empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHINGLE, THRESHOLD = 5, 0.8
BITS, BLOCKS, BALL = 128, 8, 3
RADIUS = BLOCKS * (BALL + 1) - 1
FEW = 8  # shingles of a window for which fingerprints say little
SENT = 200_000  # seeds that are broadcast at most; more are joined by a shuffle
BLANK = " \t\n\r\x0b\f"
WIDTH = BITS // BLOCKS
IN_BYTES = 127  # shingles whose bits can be counted in bytes


def word_array(text: Column) -> Column:
    """Lower-cased words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.lower(text), F.lit(BLANK))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))


def shingle_texts(w: Column, k: Column) -> Column:
    """All runs of k words (the whole where it is shorter)."""
    last = F.greatest(F.size(w) - k, F.lit(0))
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i + 1, k), " "))).otherwise(F.array().cast("array<string>"))


def numbered(shingles: Column) -> Column:
    """Shingles with later occurrences of one told apart by their number, so that all differ."""
    nth = lambda s, i: F.size(F.filter(F.slice(shingles, F.lit(1), i), lambda x: x == s))
    tagged = F.transform(shingles, lambda s, i: F.concat_ws("\n", s, F.when(nth(s, i) > 0, nth(s, i).cast("string"))))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), shingles).otherwise(tagged)


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def simhash(hashes: Column) -> Column:
    """Bits that are set in over half of an array of longs. Up to IN_BYTES of them are counted eight bits at a time, in the bytes of a long."""
    zero = F.lit(0).cast("long")
    spread = F.array(*[F.lit(sum((b >> i & 1) << 8 * i for i in range(8))).cast("long") for b in range(256)])
    even, reached = F.lit(0x00FF00FF00FF00FF), F.lit(0x0080008000800080)
    lack = (F.lit(127).cast("long") - F.shiftright(F.size(hashes), 1)) * F.lit(0x0001000100010001)  # lifts counts over half to 128

    def majority(counts: Column) -> Column:
        over = lambda x: (x.bitwiseAND(even) + lack).bitwiseAND(reached)
        pairs = F.shiftright(over(counts), 7).bitwiseOR(F.shiftright(over(F.shiftrightunsigned(counts, 8)), 6))
        return let(pairs, lambda y: y.bitwiseOR(F.shiftright(y, 14)).bitwiseOR(F.shiftright(y, 28)).bitwiseOR(F.shiftright(y, 42)).bitwiseAND(F.lit(255)))

    bytewise = zero
    for j in range(0, 64, 8):
        counts = F.aggregate(hashes, zero, lambda n, h: n + F.get(spread, F.shiftrightunsigned(h, j).bitwiseAND(F.lit(255)).cast("int")))  # noqa: B023
        bytewise = bytewise.bitwiseOR(F.shiftleft(let(counts, majority), j))
    bit = lambda b: F.when(F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int")) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(zero)
    bitwise = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), zero, lambda x, y: x.bitwiseOR(y))
    return F.when(F.size(hashes) <= IN_BYTES, bytewise).otherwise(bitwise)


def fingerprint(tags: Column) -> Column:
    """struct(lo, hi): SimHash of BITS bits of numbered shingles."""
    return let(F.transform(tags, lambda s: F.xxhash64(s)), lambda h: F.struct(simhash(h).alias("lo"), let(F.transform(h, lambda x: F.xxhash64(x)), simhash).alias("hi")))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a["lo"].bitwiseXOR(b["lo"])) + F.bit_count(a["hi"].bitwiseXOR(b["hi"]))


def block_values(fp: Column) -> Column:
    """(block, value) of the BLOCKS blocks of a fingerprint."""
    part = lambda x, i: F.shiftrightunsigned(x, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")
    n = BLOCKS // 2
    return F.array(*[F.struct(F.lit(i).alias("block"), part(fp["hi" if i >= n else "lo"], i % n).alias("value")) for i in range(BLOCKS)])


def ball() -> list[int]:
    """All values of a block with BALL ones or fewer."""
    return [sum(1 << b for b in bits) for n in range(BALL + 1) for bits in combinations(range(WIDTH), n)]


def items_of(benchmark: DataFrame) -> DataFrame:
    """it (row number), item_id, size, k, tags (numbered shingles), need (shingles that a similar window holds at least), fp of distinct items with words."""
    items = benchmark.select("item_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates()
    items = items.withColumn("size", F.size("w")).withColumn("k", F.least("size", F.lit(SHINGLE))).withColumn("tags", numbered(shingle_texts(F.col("w"), F.col("k"))))
    items = items.withColumn("need", F.ceil(F.size("tags") * THRESHOLD - 1e-9).cast("int"))
    return items.select(F.monotonically_increasing_id().alias("it"), "item_id", "size", "k", "tags", "need", fingerprint(F.col("tags")).alias("fp"))


def seeds_of(items: DataFrame) -> DataFrame:
    """it, word, at (its place in the seed), seed, k, size of the seeds."""
    rows = items.select("it", "size", "k", "need", F.size("tags").alias("m"), F.posexplode("tags").alias("q", "tag"))
    seed = F.split("tag", "\n")[0]
    parts = F.split(seed, " ")
    longest = F.array_max(F.transform(parts, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("w"))))
    rows = rows.select("it", "size", "k", "need", "m", "q", seed.alias("seed"), longest.alias("best"))
    rank = F.row_number().over(Window.partitionBy("it").orderBy(F.desc("best.n"), "q"))
    return rows.withColumn("rank", rank).where("rank <= m - need + 1").select("it", F.col("best.w").alias("word"), (-F.col("best.i")).alias("at"), "seed", "k", "size").distinct()


def seed_places(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """h1, h2, n (words), it, k, size, p of every place of a seed, with segment: the words that windows of that size round it hold, and base: the place of its first."""
    begin = F.col("p") - F.col("at")
    holds = lambda words, first: F.array_join(F.slice(words, first + 1, F.col("k")), " ") == F.col("seed")
    if seeds.count() <= SENT:
        hits = texts.select("h1", "h2", "w", F.posexplode("w").alias("p", "word")).join(F.broadcast(seeds), "word")
        hits = hits.where((begin >= 0) & (begin + F.col("k") <= F.size("w"))).where(holds(F.col("w"), F.greatest(begin, F.lit(0))))
    else:  # a word goes to the shuffle with its neighbours, not with its text
        reach = SHINGLE - 1
        near = F.slice("w", F.greatest(F.col("p") - reach, F.lit(0)) + 1, 2 * reach + 1)
        words = texts.select("h1", "h2", "w", F.posexplode("w").alias("p", "word")).select("h1", "h2", "p", "word", near.alias("near"), F.size("w").alias("n"))
        hits = words.join(seeds, "word").where((begin >= 0) & (begin + F.col("k") <= F.col("n")))
        hits = hits.where(holds(F.col("near"), F.greatest(F.least("p", F.lit(reach)) - F.col("at"), F.lit(0)))).drop("near", "n").join(texts, ["h1", "h2"])
    first = F.greatest(begin + F.col("k") - F.col("size"), F.lit(0))
    return hits.select("h1", "h2", F.size("w").alias("n"), "it", "k", "size", begin.alias("p"), first.alias("base"), F.slice("w", first + 1, begin + F.col("size") - first).alias("segment"))


def windows_of(hits: DataFrame, *names: str) -> DataFrame:
    """The windows round places (columns n, k, size, p, base, segment) that begin behind last, as tags; column names are kept."""
    latest = F.greatest(F.least(F.col("p"), F.col("n") - F.col("size")), F.lit(0))
    first = F.greatest(F.col("base"), F.col("last") + 1)
    hits = hits.where(first <= latest).withColumn("s", F.explode(F.sequence(first, latest)))
    return hits.select(*names, "size", "k", numbered(shingle_texts(F.slice("segment", F.col("s") - F.col("base") + 1, F.col("size")), F.col("k"))).alias("tags"))


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_id and similarity (the highest of any window) of every item that a document holds."""
    items = written(items_of(benchmark))
    # 1: places of seeds in texts, told apart by two hashes
    docs = documents.select(F.col(key).alias("k_doc"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.col(text).alias("text"))
    places = written(seed_places(docs.select("h1", "h2", word_array(F.col("text")).alias("w")).where(F.size("w") > 0), seeds_of(items)).dropDuplicates(["h1", "h2", "it", "p"]))
    # 2: windows behind the last place of the same size, so that each comes once
    each = Window.partitionBy("h1", "h2", "size").orderBy("p")
    last = F.coalesce(F.lag("p").over(each), F.lit(-1))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # places are few bytes but much work: dealt out evenly, also those of one text
    once = windows_of(places.dropDuplicates(["h1", "h2", "size", "p"]).withColumn("last", last).repartition(parts), "h1", "h2")
    once = written(once.withColumn("fp", fingerprint(F.col("tags"))))
    # 3: candidates from the blocks; the index grows with the benchmark, so it is never broadcast
    around = F.array(*[F.lit(x) for x in ball()])
    index = items.select("it", "size", F.col("fp").alias("item_fp"), F.explode(block_values(F.col("fp"))).alias("b"))
    index = index.select("it", "size", "item_fp", "b.block", F.explode(F.transform(around, lambda x: F.col("b.value").bitwiseXOR(x))).alias("value"))
    probes = once.select("size", "fp").distinct().select("size", "fp", F.explode(block_values(F.col("fp"))).alias("b")).select("size", "fp", "b.*")
    found = probes.join(index.hint("merge"), ["size", "block", "value"]).where(distance(F.col("fp"), F.col("item_fp")) <= RADIUS).select("size", "fp", "it").distinct()
    pairs = once.join(found, ["size", "fp"]).select("h1", "h2", "it", "tags")
    short = places.where(F.least("n", "size") - F.col("k") + 1 < FEW).withColumn("last", F.lit(-1))
    pairs = pairs.unionByName(windows_of(short, "h1", "h2", "it").select("h1", "h2", "it", "tags"))
    # 4: exact weighted similarity
    both = F.size(F.array_intersect("tags", "own"))
    judged = pairs.join(items.select("it", "item_id", F.col("tags").alias("own")), "it").withColumn("similarity", both / (F.size("tags") + F.size("own") - both))
    held = written(judged.where(F.col("similarity") >= THRESHOLD - 1e-12).groupBy("h1", "h2", "item_id").agg(F.max("similarity").alias("similarity")))
    return docs.drop("text").join(held, ["h1", "h2"]).groupBy(F.col("k_doc").alias(key), "item_id").agg(F.max("similarity").alias("similarity"))
