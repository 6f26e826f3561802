"""Toxicity scores: Levenshtein automata intersected with a trie of a learnt lexicon.

Training reads labelled rows only. A term (a word, or the first four letters of words) enters the
lexicon when its toxic share, counted over distinct contexts (previous and next word) so that
copies of one text count once, is above the base rate by more log-likelihood than the number of
terms tried can explain by chance. Every word of a text is matched against the trie by an
automaton for edit distance one; misspellings that are themselves known clean words don't count.
A hit inside quotation marks or near a word of reporting counts as quoted. The evidence of a
document is three sums (direct, quoted, misspelt), and a logistic model is fitted to the counts of
all labelled rows in the cells of those sums.

A lexicon of TERMS terms or fewer, with CLEAN known clean words near them or fewer, is sent to the
tasks. A larger one stays a table: texts give their distinct words with how often each stands quoted
or not, the words are matched against the trie in shares of TERMS terms, and sums come from a join.
Both ways give the same sums; nothing is cut off.

Defined results: null and empty texts have no evidence and get the model's base score; labels that
are null are no labels; of several labels of a document the highest counts; with no labelled row
of one of the two classes all scores are the share of toxic labels (0 without any label).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, short_batches, written

TERMS = 20_000  # terms that are sent to tasks at a time; a larger lexicon is joined
CLEAN = 100_000  # known clean words near a term that are sent to tasks at most; more are joined
PREFIX = 4  # letters of a prefix term
SHORT = 4  # letters that a misspelt word has at least
SHARE = 0.5  # toxic share of documents, then of contexts, that a term has at least
SURE = 0.95  # toxic share from which a prefix is a term, and a term may be misspelt
STEP, EVEN = 0.5, 24  # width of the cells of each evidence sum, and number of cells of that width: wider ones follow
WINDOW = 8  # words each side in which a word of reporting makes a hit a quotation
CACHED = 200_000  # words remembered by a Python worker

WORD = re.compile(r"[^\W_]+(?:[@$!*'’-]+[^\W_]+)*")
#: Characters written for letters, marks that open and close quotations, and words of reporting.
FOLD = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "-": "", "'": "", "’": ""})
QUOTES = "\"“”„«»‘"
REPORTING = frozenset("said says wrote quote quoted quotes called calls termed reported sagte schrieb zitat zitiert nannte dit disait écrit citation appelé dijo dice escribió cita llamó".split())


def terms_of(word: str) -> str:
    """A word as it is looked up: small letters, letter look-alikes folded where letters are the most."""
    return word if word.isalpha() else word.translate(FOLD) if sum(c.isalpha() for c in word) * 2 > len(word) else word


def tokens(text: str | None) -> list[str]:
    return [terms_of(w) for w in WORD.findall(text.lower())] if text else []


class Trie:
    """Terms as nested dicts; near() walks it together with the automaton of one word."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.heads, self.tails = set(), set()
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
            self.heads.add(t[: len(t) // 2])
            self.tails.add(t[len(t) // 2 :])
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})

    def near(self, word: str) -> str | None:
        """The first term within one edit of the word (itself first); the word keeps one half of such a term whole."""
        if not any(word[:k] in self.heads for k in self.head_sizes) and not any(word[-k:] in self.tails for k in self.tail_sizes):
            return None
        n = len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        found = None
        stack = [(self.root, 1, 2)]  # node, places reached without an edit, and with one
        while stack:
            node, exact, edited = stack.pop()
            for c, child in node.items():
                if c == "":
                    if exact >> n & 1:
                        return child
                    if edited >> n & 1 and (found is None or child < found):
                        found = child
                    continue
                here = at.get(c, 0)
                e = (exact & here) << 1
                d = ((edited & here) << 1 | exact | exact << 1 | e << 1) & ((2 << n) - 1)
                if e or d:
                    stack.append((child, e, d))
        return found


def train_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of labelled documents."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return documents.select("doc_id", "text").join(known.hint("merge"), "doc_id")  # labels have no bound, so they are never broadcast


def _vocabulary(rows: DataFrame) -> DataFrame:
    """term, toxic and clean documents, counted once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (1, 0))]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, ["term", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen = set(tokens(text.as_py()))
                for t in seen | {w[:PREFIX] + "*" for w in seen if len(w) > PREFIX}:
                    counts.setdefault(t, [0, 0])[toxic > 0] += 1
                if len(counts) > CACHED:
                    yield flush()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(rows: DataFrame, terms: set[str]) -> DataFrame:
    """term, toxic and clean contexts of candidate terms. A context goes to the shuffle as one number: place of its term, label, and hash in the bits that are left."""
    names = sorted(terms)
    place = {t: i for i, t in enumerate(names)}
    bits = (2 * len(names)).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, str]] = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = tokens(text)
                for i, w in enumerate(ws):
                    for t in (w, w[:PREFIX] + "*") if len(w) > PREFIX else (w,):
                        if t in place:
                            out.add((2 * place[t] + (toxic > 0), " ".join(ws[max(0, i - 1) : i] + ["_"] + ws[i + 1 : i + 2])))
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], ["code", "context"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in batch.column(0).to_pylist()], pa.string()), *batch.columns[1:]], ["term", "toxic", "clean"])

    key = F.shiftleft("code", 64 - bits).bitwiseOR(F.shiftrightunsigned(F.xxhash64("context"), bits))
    found = rows.select("text", "toxic").mapInArrow(run, "code long, context string").select(key.alias("key")).distinct()
    code = F.shiftrightunsigned("key", 64 - bits)
    counts = found.groupBy(F.shiftright(code, 1).alias("place")).agg(F.sum(code % 2).alias("toxic"), F.sum(1 - code % 2).alias("clean"))
    return counts.mapInArrow(named, "term string, toxic long, clean long")


def _shares(df: DataFrame, column: str, most: int) -> Iterator[list]:
    """Rows of df with a term in its column, in lists of about most, dealt by hash: one list reaches the driver at a time."""
    n = max(1, -(-df.count() // most))
    share = F.pmod(F.xxhash64(column), F.lit(n))
    return (df.where(share == i).collect() for i in range(n))


def _evidence(toxic: F.Column, clean: F.Column, base: float) -> F.Column:
    """Log-likelihood gain over the base rate; below zero where the share is below it or SHARE."""
    share = toxic / (toxic + clean)
    gain = toxic * F.log(share / base) + F.when(clean > 0, clean * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.when((share > base) & (share >= SHARE), gain).otherwise(-1.0)


def raw_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def quoted_places(text: str, plain: list[str]) -> Callable[[int], bool]:
    """Tells of the i-th word whether it stands in quotation marks or near a word of reporting."""
    marks = [i for i, c in enumerate(text) if c in QUOTES] if any(q in text for q in QUOTES) else []
    places = [m.start() for m in WORD.finditer(text.lower())] if marks else []

    def quoted(i: int) -> bool:
        inside = bool(marks) and bisect_left(marks, places[i]) % 2 == 1
        return inside or not REPORTING.isdisjoint(plain[max(0, i - WINDOW) : i + WINDOW + 1])

    return quoted


class Model:
    """Term weights, terms that may be misspelt, clean neighbours of those, and the logistic model; sent to tasks as it is (bounded by TERMS and CLEAN)."""

    def __init__(self, weights: dict[str, float], sure: set[str], clean: set[str], coef: list[float]):
        self.weights, self.sure, self.clean, self.coef = weights, sure, clean, coef
        self.ready = None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def prepare(self) -> None:
        if self.ready is None:
            self.trie = Trie(sorted(self.sure))
            self.hits: dict[str, tuple[float, int]] = {}
            self.seen: set[str] = set()
            self.ready = True

    def look(self, word: str) -> None:
        """Remembers what a new word is: (weight, 1 if misspelt), or nothing."""
        self.seen.add(word)
        if w := self.weights.get(word) or (len(word) > PREFIX and self.weights.get(word[:PREFIX] + "*")):
            self.hits[word] = (w, 0)
        elif len(word) >= SHORT and word not in self.clean and (near := self.trie.near(word)):
            self.hits[word] = (self.weights[near], 1)

    def sums(self, text: str | None) -> tuple[float, float, float]:
        """Evidence of a text: direct, quoted, misspelt."""
        self.prepare()
        if not text:
            return 0.0, 0.0, 0.0
        plain = [terms_of(w) for w in raw_words(text)]
        new = set(plain) - self.seen
        if len(self.seen) + len(new) > CACHED:
            self.seen, self.hits = set(), {}
            new = set(plain)
        for w in new:
            self.look(w)
        if self.hits.keys().isdisjoint(plain):
            return 0.0, 0.0, 0.0
        direct = quoted = misspelt = 0.0
        in_quotes = quoted_places(text, plain)
        for i, w in enumerate(plain):
            if hit := self.hits.get(w):
                if in_quotes(i):
                    quoted += hit[0]
                elif hit[1]:
                    misspelt += hit[0]
                else:
                    direct += hit[0]
        return direct, quoted, misspelt


class LargeModel:
    """The same with tables: terms (term, weight, sure) and counts (term, clean)."""

    def __init__(self, terms: DataFrame, counts: DataFrame, coef: list[float]):
        self.terms, self.counts, self.coef = terms, counts, coef

    def hits(self, words: DataFrame) -> DataFrame:
        """word, weight, misspelt (0 or 1) of the distinct words that are terms or near one."""
        plain = self.terms.select("term", "weight")
        exact = words.join(plain.withColumnRenamed("term", "word"), "word").select("word", "weight", F.lit(0).alias("misspelt"))
        rest = words.join(exact, "word", "left_anti")
        stem = F.concat(F.substring("word", 1, PREFIX), F.lit("*"))
        stems = rest.where(F.length("word") > PREFIX).withColumn("term", stem).join(plain, "term").select("word", "weight", F.lit(0).alias("misspelt"))
        rest = written(rest.join(stems, "word", "left_anti").where(F.length("word") >= SHORT))
        found = None
        for share in _shares(self.terms.where("sure").select("term"), "term", TERMS):
            near = _near(rest, {r.term for r in share})
            found = near if found is None else found.unionByName(near)
        least = found.groupBy("word").agg(F.min("term").alias("term"))
        least = least.join(self.counts.where("clean > 0").select(F.col("term").alias("word")), "word", "left_anti")
        return exact.unionByName(stems).unionByName(least.join(plain, "term").select("word", "weight", F.lit(1).alias("misspelt")))


def _near(words: DataFrame, terms: set[str]) -> DataFrame:
    """word and the first term within one edit, of the words that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sorted(terms))
        for batch in batches:
            pairs = [(w, t) for w in batch.column(0).to_pylist() if (t := trie.near(w))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.string())], ["word", "term"])

    return words.select("word").mapInArrow(run, "word string, term string")


def _with_sums(df: DataFrame, model: Model | LargeModel, with_text: bool = False) -> DataFrame:
    """df with the evidence direct, quoted and misspelt, without its text unless asked for."""
    names = ["direct", "quoted", "misspelt"]
    keep = [c for c in df.columns if (with_text or c != "text") and c not in names]
    if isinstance(model, LargeModel):
        return _joined_sums(df, model, keep)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.array([model.sums(t) for t in batch.column(len(keep)).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(sums[:, k]) for k in range(3))], keep + names)

    return df.select(*keep, F.col("text").alias(free_name(df, "__text"))).mapInArrow(run, schema)


def _joined_sums(df: DataFrame, model: LargeModel, keep: list[str]) -> DataFrame:
    """The same by joins: words of a row, how often each stands quoted and plainly, their weights, and the sums."""
    row = free_name(df, "__row")
    df = written(df.withColumn(row, F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                plain = [terms_of(w) for w in raw_words(text)]
                quoted = quoted_places(text, plain)
                counts: dict[str, list[int]] = {}
                for i, w in enumerate(plain):
                    counts.setdefault(w, [0, 0])[quoted(i)] += 1
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(counts), pa.int64()), pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["row", "word", "plain", "quoted"])

    words = df.select(F.col(row), "text").mapInArrow(run, "row long, word string, plain long, quoted long")
    hits = written(model.hits(words.select("word").distinct()))
    total = lambda count, when: F.sum(F.when(when, F.col("weight") * F.col(count)).otherwise(0.0))
    sums = words.join(hits, "word").groupBy(F.col("row").alias(row)).agg(total("plain", F.col("misspelt") == 0).alias("direct"), total("quoted", F.lit(True)).alias("quoted"), total("plain", F.col("misspelt") == 1).alias("misspelt"))
    names = ["direct", "quoted", "misspelt"]
    return df.select(row, *keep).join(sums, row, "left").select(*keep, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def _cells(df: DataFrame) -> DataFrame:
    """df with its evidence as cells."""
    n = lambda c: F.col(c) / STEP
    even = lambda c: F.when(n(c) <= EVEN, F.ceil(n(c))).otherwise(F.ceil(EVEN * (1 + F.log(F.greatest(n(c), F.lit(1.0)) / EVEN)))).cast("int")
    return df.withColumns({c: even(c) for c in ("direct", "quoted", "misspelt")})


def _features(direct, quoted, misspelt) -> list:
    return [1.0, direct * STEP, quoted * STEP, misspelt * STEP, 1.0 * (direct > 0)]


def _fit(cells: list, steps: int = 50) -> list[float]:
    """Logistic model by Newton steps over the cells' counts, with a slight pull to zero."""
    x = np.array([_features(r.direct, r.quoted, r.misspelt) for r in cells])
    n, y = np.array([r.n for r in cells], float), np.array([r.y for r in cells], float)
    pull = np.diag([0.01, *[0.1] * (x.shape[1] - 1)])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - n * p) - pull @ beta)
        beta += step / max(1, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    beta[1:] = np.maximum(beta[1:], 0)
    return beta.tolist()


def train(rows: DataFrame, most: int = TERMS, most_clean: int = CLEAN) -> Model | LargeModel:
    """rows: doc_id, text, toxic (0 or 1) of the labelled documents. most, most_clean: see TERMS and CLEAN."""
    short_batches(rows.sparkSession)
    rows = written(rows)
    n, toxic = rows.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    base = (toxic or 0) / n if n else 0.0
    if not 0 < base < 1:
        return Model({}, set(), set(), [30.0 if base == 1 else -30.0, 0.0, 0.0, 0.0, 0.0])
    counts = written(_vocabulary(rows))
    tried = math.log(max(2, counts.count()))
    gain = lambda df, least: df.where(_evidence(F.col("toxic"), F.col("clean"), base) > least)
    scored = None
    for share in _shares(gain(counts, tried / 2).select("term"), "term", most):
        found = _contexts(rows, {r.term for r in share})
        scored = found if scored is None else scored.unionByName(found)
    always = F.col("toxic") >= SURE * (F.col("toxic") + F.col("clean"))
    stem = F.col("term").endswith("*")
    weight = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * ((1 - base) / base))
    terms = written(gain(scored, tried).where(~stem | always).select("term", weight.alias("weight"), (~stem & always & (F.length("term") > SHORT)).alias("sure")))
    model = LargeModel(terms, counts, [])
    if terms.count() <= most:
        sure = {r.term for r in terms.where("sure").collect()}
        near = written(_near(counts.where(F.col("clean") > 0).where(~stem).select(F.col("term").alias("word")), sure).select("word"))
        if near.count() <= most_clean:
            model = Model({r.term: r.weight for r in terms.collect()}, sure, {r.word for r in near.collect()}, [])
    cells = _cells(_with_sums(rows.select("toxic", "text"), model)).groupBy("direct", "quoted", "misspelt").agg(F.count("*").alias("n"), F.sum("toxic").alias("y"))
    model.coef = _fit(cells.collect())
    return model


def score(df: DataFrame, model: Model | LargeModel, out: str = "score", threshold: float = 0.3, with_text: bool = False) -> DataFrame:
    """df with score in 0 .. 1 and predicted, and the cells direct, quoted and misspelt; columns of these names are replaced. Its column text goes unless asked for."""
    short_batches(df.sparkSession)
    found = _cells(_with_sums(df, model, with_text))
    x = _features(F.col("direct"), F.col("quoted"), F.col("misspelt"))
    x[4] = (F.col("direct") > 0).cast("double")
    z = sum((F.lit(b) * v for b, v in zip(model.coef, x, strict=True)), F.lit(0.0))
    return found.withColumn(out, 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col(out) >= threshold).cast("int"))


def held_out(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string")) % 4 == 2


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learnt from labelled rows that aren't held out."""
    model = train(train_rows(documents, labels).where(~held_out()))
    return score(documents.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
