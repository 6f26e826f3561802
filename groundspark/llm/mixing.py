"""Mixing sources to target weights by entropy balancing.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share all words; a target
stops at three times its source's words, and the excess is shared again by weight until none is above.
Rates: those nearest to one for every document (least sum of r log r - r) whose words meet the targets.
The dual is convex with one multiplier a source, and the rates are its exponential tilts,
r = min(3, exp(lambda size / mean size)). Newton's steps (on the logarithm of a source's words, kept
within a bracket that every step narrows) read counts by source and size, which hold all that the rates
depend on: Spark adds up words and their derivative by source in every round. Nothing is collected but
one row a partition; the number of sources isn't bounded.

Rounding: documents in the order of source, size and a hash of their id are numbered by running sums of
rates, and each gets the whole numbers that its share of the sum passes: its rate rounded down or up.
As neighbours are of like size, a source is off by its longest document at most; REPAIRS times its
document whose rounding the other way comes nearest to what is missing is turned round. Sums are of
integers (rates in units of 2^-30), so reruns agree at any partitioning.

Defined results: null texts have size 0, taken 0 and count as documents of their source; rows are
documents on their own, also those of one id or of none; sources without words have target 0; an empty
table gives an empty result. The tilt favours short documents where a source is cut and long ones where
it is repeated; a source at three times its size takes everything three times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.operators.util import global_index

from .common import short_batches, with_key, written

UNIT = 1 << 30  # of rates
ROUNDS = 60  # of Newton's steps at most; the bracket is halved at least where they fail
CLOSE = 1e-9  # of a target
REPAIRS = 4
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_counts(column: pa.Array) -> np.ndarray:
    """Words [^\\x20\\x09-\\x0D]+ of every text of a string column, counted in its bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    gap = SPACE[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data else np.zeros(0, bool)
    ends = ends - ends[0]
    starts = ~gap
    starts[1:] &= gap[:-1]
    first = ends[:-1][ends[:-1] < len(gap)]
    starts[first] = ~gap[first]
    at = np.searchsorted(np.flatnonzero(starts), ends)
    return np.diff(at)


def sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """key, source, size and row (a number of its own) of every document, as a written table."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(word_counts(batch.column(2)))], ["key", "source", "size"])

    given = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return written(given.mapInArrow(run, with_key("key", given.schema["key"].dataType, "source string, size long")).withColumn("row", F.monotonically_increasing_id()))


def big(c: str | Column) -> Column:
    """A whole number as a decimal, whose products and sums don't overflow."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def with_targets(sources: DataFrame, most: int) -> DataFrame:
    """sources (total, weight) with target = least(most * total, weight * level): the level rises until the targets share all words."""
    words, weights = sources.agg(F.sum(big("total")), F.sum("weight")).first()
    level, full = (float(words) / weights if weights else 0.0), 0
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("total") * most
        n, taken, free = sources.agg(F.count_if(above), F.sum(F.when(above, big("total") * most)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not free:
            break
        level, full = float(words - taken) / free, n
    return sources.withColumn("target", F.least(F.col("total") * F.lit(float(most)), F.col("weight") * F.lit(level)))


def rate(most: int) -> Column:
    """exp(lam * size / mean) in units, most at most; a source without a lam takes everything most times."""
    tilt = F.least(F.exp(F.col("lam") * F.col("size") / F.col("mean")), F.lit(float(most)))
    return F.when(F.col("lam").isNull(), F.lit(most * UNIT)).otherwise(F.floor(tilt * UNIT + 0.5)).cast("long")


def balance(cells: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """place and lam of every source. cells: place, size, m (documents); sources: place, total, docs, target."""
    full = F.col("target") >= F.col("total") * most
    infinite = F.lit(float("inf"))
    less = F.col("target") < F.col("total")
    state = sources.select(
        "place", "target", (F.col("total") / F.greatest("docs", F.lit(1))).alias("mean"), F.when(~full, F.lit(0.0)).alias("lam"),
        F.when(less, -infinite).otherwise(0.0).alias("low"), F.when(less, 0.0).otherwise(infinite).alias("high"), (full | (F.col("total") == 0)).alias("done"),
    )
    state = written(state)
    for _ in range(ROUNDS):
        if not state.where("not done").head(1):
            break
        each = cells.join(state.where("not done"), "place").withColumn("r", rate(most))
        words = big("m") * big("size") * big("r")
        sums = each.groupBy("place").agg(F.sum(words).alias("words"), F.sum(F.when(F.col("r") < most * UNIT, words * big("size"))).alias("slope"))
        at = state.join(sums, "place", "left").withColumn("words", F.col("words").cast("double") / UNIT).withColumn("slope", F.col("slope").cast("double") / UNIT / F.col("mean"))
        over = F.col("words") > F.col("target")
        at = at.withColumn("low", F.when(~over, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(over, F.col("lam")).otherwise(F.col("high")))
        newton = F.col("lam") - F.try_divide(F.col("words") * F.log(F.try_divide("words", "target")), F.col("slope"))
        middle = F.when(F.col("low") == -infinite, 2 * F.col("high") - 1).when(F.col("high") == infinite, 2 * F.col("low") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("done") | (F.abs(F.col("words") - F.col("target")) <= CLOSE * F.col("target")) | (F.col("high") - F.col("low") <= 1e-14 * F.abs("lam"))
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        at = at.withColumn("done", F.coalesce(done, F.col("done")))
        state = written(at.select("place", "target", "mean", F.when(F.col("done"), F.col("lam")).otherwise(step).alias("lam"), "low", "high", "done"))
    return state.select("place", "mean", "lam")


def rounded(rated: DataFrame, seed: int) -> DataFrame:
    """rated (key, place, size, rate, row) with copies and idx (place in the order of source, size and hash), as a written table."""
    spark = rated.sparkSession
    order = ["place", "size", "h", "row"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rated.withColumn("h", F.xxhash64(F.lit(seed), F.col("key"))).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    before, sums, counts = {}, 0, 0
    for r in ranged.groupBy("part").agg(F.sum(big("rate")).alias("s"), F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        before[r["part"]] = (sums % UNIT, counts)
        sums, counts = sums + int(r["s"]), counts + r["n"]
    start = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for p, v in before.items() for x in (p, v[i])]), F.col("part")) if before else F.lit(0)
    w = Window.partitionBy("part").orderBy(*order)
    passed = (start(0) + F.sum("rate").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long")
    units = lambda c: F.shiftright(c, 30)
    out = ranged.withColumn("idx", (start(1) + F.row_number().over(w) - 1).cast("long")).withColumn("sum", passed)
    return written(out.withColumn("copies", units(F.col("sum")) - units(F.col("sum") - F.col("rate"))).drop("h", "row", "part", "sum"))


def repairs(rounds: DataFrame) -> DataFrame:
    """idx and turn (1 or -1 copies) of the documents whose rounding is turned round. rounds: place, target, size, rate, copies, idx."""
    down = F.shiftright("rate", 30)
    loose = rounds.where((F.col("size") > 0) & (F.col("rate") > down * UNIT))
    cells = written(loose.groupBy("place", "size", (F.col("copies") == down).alias("below")).agg(F.min("idx").alias("idx")))
    off = written(rounds.groupBy("place").agg((F.max("target") - F.sum(big("copies") * big("size")).cast("double")).alias("off")))
    moves = []
    for _ in range(REPAIRS):
        left = F.abs(F.abs("off") - F.col("size"))
        fit = cells.join(off, "place").where((F.col("below") == (F.col("off") > 0)) & (left < F.abs("off")))
        for m in moves:
            fit = fit.join(m.select("idx"), "idx", "left_anti")
        best = fit.groupBy("place").agg(F.min_by(F.struct("idx", "size", F.when(F.col("off") > 0, 1).otherwise(-1).alias("turn")), F.struct(left, "size", "idx")).alias("best"))
        moves.append(written(best.select("place", "best.*")))
        turned = moves[-1].select("place", (F.col("turn") * F.col("size")).alias("by"))
        off = off.join(turned, "place", "left").select("place", (F.col("off") - F.coalesce("by", F.lit(0))).alias("off"))
    out = moves[0]
    for m in moves[1:]:
        out = out.unionByName(m)
    return out.select("idx", "turn")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 13) -> DataFrame:
    """key, size, source_size, target, taken, rate and copies of every document."""
    data = sized(docs, key, source, text)
    cells = written(data.groupBy("source", "size").agg(F.count("*").alias("m")))
    totals = cells.groupBy("source").agg(F.sum(big("m") * big("size")).cast("long").alias("total"), F.sum("m").alias("docs"))
    placed = global_index(totals, F.col("source").isNull(), F.col("source"), name="place")
    weight = F.array(*map(F.lit, weights))[(F.col("place") % len(weights)).cast("int")]
    sources = written(with_targets(written(placed.withColumn("weight", weight)), most))
    counted = written(cells.join(sources, cells["source"].eqNullSafe(sources["source"])).select("place", "size", "m"))
    tilts = balance(counted, sources, most)
    solved = written(sources.join(tilts, "place").select(F.col("source").alias("of"), "place", "total", "target", "mean", "lam"))
    rated = data.join(solved, data["source"].eqNullSafe(solved["of"])).select("key", "place", "size", F.col("total").alias("source_size"), "target", rate(most).alias("rate"), "row")
    whole = rounded(rated, seed)
    copies = (F.col("copies") + F.coalesce("turn", F.lit(0))).cast("long")
    out = whole.join(repairs(whole), "idx", "left").withColumn("copies", copies)
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), (F.col("rate") / UNIT).alias("rate"), "copies")
