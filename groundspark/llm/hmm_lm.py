"""Hidden Markov language model: Baum-Welch counts summed across partitions, scaled forward scores.

The model emits word classes: each of the OWN most frequent training words is a class, all others
fall into BUCKETS classes by the hash of their last letters. Hidden states take up what classes
follow each other and stay together (languages, registers). A word of a bucket has the add-one
probability among the bucket's training words, with one unknown word besides, so the model is a
proper distribution over texts. Word counts are joined, not gathered: the HOT most frequent words
are sent to the tasks (a fixed bound), the others are counted by document and joined by word.

Training: texts are encoded as classes once, in PARTS parts by hash. The first epoch is stepwise
(incremental) Baum-Welch: a part's expected counts are mixed into those of the parts before it and
the model is renewed, so the states come apart within one reading of all training rows; then FULL
rounds each take the expected counts of all of them. Each task sums counts over its rows; Spark adds
them by cell, so the driver gets states x classes numbers whatever the input. No round samples.

Defined results: null text counts as empty and has its end alone; rows of equal key are scored
each; without training rows every token has base probability one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.session import shared_path

from .common import as_bytes, slices, words, written

STATES = 8
OWN, BUCKETS, HOT = 4096, 1024, 150_000
LONGEST = 64  # bytes of a hot word
PARTS, FULL = 8, 2  # parts of the first epoch, rounds over all training rows after it
FADE = 0.4  # a part's weight in the first epoch is its place (from 1) to the power of minus this
END = b"\n"  # no word has a line feed
CLASSES = OWN + BUCKETS + 1
TAKEN = 150_000  # tokens in the matrices at a time
CACHED = 200_000
OUT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def bucket(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % BUCKETS


class Lexicon(dict):
    """Word -> index into class and log10(count + 1); words that aren't hot are added as they come."""

    def __init__(self, hot: list[tuple[bytes, int]], ends: int = 0):
        self.hot, self.ends = hot, ends
        self.start()

    def start(self) -> None:
        self.clear()
        self.update((w, i) for i, (w, _) in enumerate(self.hot))
        self[END] = n = len(self.hot)
        self.cls = np.zeros(n + 1 + CACHED, np.int32)
        self.cls[: n + 1] = [k if k < OWN else bucket(w) for k, (w, _) in enumerate(self.hot)] + [CLASSES - 1]
        self.log = np.zeros(n + 1)
        self.log[:n] = [math.log10(c + 1) for _, c in self.hot]
        self.log[n] = math.log10(self.ends + 1)
        self.fixed = n + 1

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.cls[i] = bucket(word)
        return i

    def of(self, ws: list[bytes]) -> np.ndarray:
        if len(self) + len(ws) > len(self.cls):
            kinds = set(ws)
            if len(self) + len(kinds.difference(self)) > len(self.cls):
                self.start()
                new = len(kinds.difference(self))  # what was remembered is new again
                if self.fixed + new > len(self.cls):
                    self.cls = np.concatenate([self.cls, np.zeros(new, np.int32)])
        return np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))


class Packed:
    """Sequences laid out by time: step t holds the t-th symbols of all sequences longer than t, longest first."""

    def __init__(self, sequences: list[np.ndarray]):
        size = np.array([len(s) for s in sequences])
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.steps = int(size[0])
        self.active = np.searchsorted(-size, -np.arange(self.steps), "left")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        flat = np.concatenate([sequences[i] for i in self.order])
        owner = np.repeat(np.arange(len(size)), size)
        time = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self.symbols = np.empty(len(flat), np.int64)
        self.symbols[self.at[time] + owner] = flat
        self.owner = np.empty(len(flat), np.int64)
        self.owner[self.at[time] + owner] = owner


class Hmm:
    """Start, transition (K x K) and emission (K x classes) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, share: np.ndarray, seed: int = 1) -> Hmm:
        r = np.random.default_rng(seed)
        emit = share[None, :] * r.uniform(0.5, 1.5, (STATES, len(share)))
        return cls(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1)), emit / emit.sum(1, keepdims=True))

    def forward(self, p: Packed, keep: bool = True, kind: type = np.float64) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """Scaled forward variables (if asked to keep them), scales and emission probabilities, by packed place."""
        e = self.emit.T.astype(kind)[p.symbols]
        move, one = self.move.astype(kind), np.ones(STATES, kind)
        alpha, scale = np.empty_like(e) if keep else None, np.empty(len(e), kind)
        at = p.at.tolist()
        before = None
        for t in range(p.steps):
            a, b = at[t], at[t + 1]
            now = (before[: b - a] @ move) if before is not None else np.repeat(self.start.astype(kind)[None, :], b - a, 0)
            now *= e[a:b]
            c = now @ one
            now /= c[:, None]
            scale[a:b] = c
            if keep:
                alpha[a:b] = now
            before = now
        return alpha, scale, e

    def likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 of the exact probability of each class sequence."""
        p = Packed(sequences)
        _, scale, _ = self.forward(p, keep=False)
        out = np.empty(len(sequences))
        out[p.order] = np.bincount(p.owner, np.log10(scale), len(sequences))
        return out

    def counts(self, sequences: list[np.ndarray], into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Adds the expected numbers of starts, moves and emissions (single precision within a group of sequences)."""
        p = Packed(sequences)
        alpha, scale, weighted = self.forward(p, kind=np.float32)
        weighted /= scale[:, None]  # emission over scale, then times the backward variable
        beta = np.ones_like(alpha)
        back = np.ascontiguousarray(self.move.T.astype(np.float32))
        at = p.at.tolist()
        for t in range(p.steps - 1, -1, -1):
            a, b = at[t], at[t + 1]
            if t + 1 < p.steps:
                n = at[t + 2] - b
                np.matmul(weighted[b : b + n], back, out=beta[a : a + n])
            weighted[a:b] *= beta[a:b]
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        start, move, emit = into
        start += gamma[: p.at[1]].sum(0)
        if p.steps > 1:
            later = np.arange(p.at[1], len(alpha))
            step = np.repeat(np.arange(1, p.steps), p.active[1:])
            move += self.move * (alpha[p.at[step - 1] + later - p.at[step]].T @ weighted[later])
        for k in range(STATES):
            emit[k] += np.bincount(p.symbols, gamma[:, k], CLASSES)


def groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like sizes, about TAKEN tokens each."""
    order = np.argsort(-sizes, kind="stable")
    for a, b in slices(sizes[order], TAKEN):
        yield order[a:b]


def token_lists(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Iterator[list[bytes]]]]:
    """Row ranges with the tokens of their texts, one text in memory at a time."""
    raw = as_bytes(batch.column(column))
    for a, b in slices(np.array([len(x) if x else 0 for x in raw]), 4_000_000):
        yield a, b, (words(x.lower() if x else None) + [END] for x in raw[a:b])


def word_counts(training: DataFrame) -> DataFrame:
    """word, c over column text of the training rows (without ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for x in as_bytes(batch.column(0)):
                if x:
                    found.update(x.lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

    return training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def encoded(training: DataFrame, lexicon: list) -> DataFrame:
    """part and cls (array of classes) of the training texts, written in one folder a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(lexicon)
        for batch in batches:
            for a, b, texts in token_lists(batch, 1):
                cls = [known.cls[known.of(ws)].astype(np.int16) for ws in texts]
                ends = np.cumsum([0, *map(len, cls)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cls)))], ["part", "cls"])

    spark = training.sparkSession
    path = shared_path(spark, "classes")
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS)).cast("int").alias("part")
    training.select(part, "text").mapInArrow(run, "part int, cls array<smallint>").write.partitionBy("part").parquet(path)
    return spark.read.schema("cls array<smallint>, part int").parquet(path)


def expected(rows: DataFrame, hmm: Hmm) -> np.ndarray:
    """Expected numbers of starts, moves and emissions over all rows (column cls), summed by cell in Spark, in one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
        for batch in batches:
            column = batch.column(0)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = column.flatten().to_numpy(), np.cumsum(sizes)
            for at in groups(sizes):
                hmm.counts([flat[ends[i] - sizes[i] : ends[i]] for i in at], into)
        cells = np.concatenate([x.ravel() for x in into])
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(cells[full])], ["cell", "value"])

    sums = rows.select("cls").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    cells = np.zeros(STATES + STATES * STATES + STATES * CLASSES)
    cells[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
    return cells


def improved(cells: np.ndarray, share: np.ndarray) -> Hmm:
    """The M-step, with a little of the even or overall distribution mixed in."""
    start, move, emit = cells[:STATES], cells[STATES : STATES + STATES**2].reshape(STATES, STATES), cells[STATES + STATES**2 :].reshape(STATES, CLASSES)
    start, move, emit = start + 0.1, move + 0.1, emit + 5.0 * share[None, :]
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def fitted(rows: DataFrame, share: np.ndarray) -> Hmm:
    """Stepwise Baum-Welch over the parts, then FULL rounds over all rows. A part's counts weigh as if all parts were like it."""
    hmm, cells, turn = Hmm.first(share), None, 0
    for k in range(PARTS):
        new = expected(rows.where(F.col("part") == k), hmm) * PARTS
        if new.any():
            turn += 1
            weight = turn**-FADE
            cells = new if cells is None else (1 - weight) * cells + weight * new
            hmm = improved(cells, share)
    for _ in range(FULL):
        hmm = improved(expected(rows, hmm), share)
    return hmm


class Model:
    def __init__(self, hot: list[tuple[bytes, int]], hmm: Hmm, tokens: int, types: int, bucket_log: np.ndarray):
        self.hot, self.hmm, self.tokens, self.types, self.bucket_log = hot, hmm, tokens, types, bucket_log


def train(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the written table of word counts. training: doc_id, text of the training rows."""
    counts = written(word_counts(training))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    docs = training.count()
    best = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(HOT).toArrow()
    hot = sorted(zip(best.column("word").to_pylist(), best.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    own = {w for w, _ in hot[:OWN]}
    last = F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")
    by = counts.groupBy(F.pmod(F.crc32(last), F.lit(BUCKETS)).cast("int").alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    total, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in by:
        total[r.b], kinds[r.b] = r.c, r.v
    for w, c in hot[:OWN]:
        total[bucket(w) - OWN] -= c
        kinds[bucket(w) - OWN] -= 1
    share = np.zeros(CLASSES)
    share[: len(own)] = [c for _, c in hot[:OWN]]
    share[OWN : OWN + BUCKETS] = total
    share[-1] = docs
    share = (share + 0.5) / (share + 0.5).sum()
    hmm = fitted(encoded(training, hot), share) if docs else Hmm.first(share)
    return Model(hot, hmm, n + docs, v + (docs > 0), np.log10(total + kinds + 1)), counts


def score(documents: DataFrame, model: Model, counts: DataFrame, docs: int) -> DataFrame:
    """documents' other columns with n_tokens, n_known, train_tokens, base_score and score of the column text, which goes. Columns named like results are replaced; all others stay."""
    keep = [c for c in documents.columns if c != "text" and c not in OUT]
    given = [f"c{i}" for i in range(len(keep))]  # so that no column of the user's has the name of a work column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(model.hot, docs)
        m = len(keep) + 1
        for batch in batches:
            for a, b, texts in token_lists(batch, m):
                cls, log, hits, odd = [], [], [], []
                out = np.empty(b - a)
                for k, ws in enumerate(texts):
                    i = known.of(ws)
                    fixed = i < known.fixed
                    c = known.cls[i]
                    inner = known.log[i[fixed]]
                    log.append(inner.sum())
                    hits.append(int(fixed.sum()) - (docs == 0))
                    odd.append([{"word": w, "tf": n} for w, n in Counter([ws[j] for j in np.flatnonzero(~fixed)]).items()])
                    loose = c[(c >= OWN) & (c < OWN + BUCKETS)] - OWN
                    out[k] = inner[(c[fixed] >= OWN) & (c[fixed] < OWN + BUCKETS)].sum() - model.bucket_log[loose].sum()
                    cls.append(c)
                for rows in groups(np.array([len(c) for c in cls])):
                    out[rows] += model.hmm.likelihood([cls[i] for i in rows])
                part = batch.slice(a, b - a)
                sizes = np.array([len(c) for c in cls], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:m], pa.array(sizes), pa.array(hits, pa.int64()), pa.array(log, pa.float64()), pa.array(out), pa.array(odd, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))],
                    [*given, "row", "n_tokens", "hits", "logs", "hmm", "odd"],
                )

    fields = "".join(f"{g} {documents.schema[c].dataType.simpleString()}, " for g, c in zip(given, keep, strict=True))
    rows = documents.select(*[F.col(f"`{c}`").alias(g) for g, c in zip(given, keep, strict=True)], F.monotonically_increasing_id().alias("row"), "text")
    part = written(rows.mapInArrow(run, f"{fields}row long, n_tokens long, hits long, logs double, hmm double, odd array<struct<word:binary,tf:bigint>>"))
    odd = part.select("row", F.explode("odd").alias("o")).select("row", "o.*")
    rare = odd.join(counts, "word").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more_log"))
    all_ = part.drop("odd").join(rare, "row", "left").na.fill({"more": 0, "more_log": 0.0})
    floor = math.log10(model.tokens + model.types + 1)
    results = {"n_tokens": F.col("n_tokens"), "n_known": F.col("hits") + F.col("more"), "train_tokens": F.lit(model.tokens).cast("long"), "base_score": F.col("logs") + F.col("more_log") - F.col("n_tokens") * floor, "score": F.col("hmm") + F.col("more_log")}
    return all_.select(*[F.col(g).alias(c) for g, c in zip(given, keep, strict=True)], *[v.alias(k) for k, v in results.items()])


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    documents = documents.select("doc_id", held_out().alias("held_out"), "text")
    training = documents.where("not held_out").select("doc_id", "text")
    model, counts = train(training)
    return score(documents, model, counts, training.count())
