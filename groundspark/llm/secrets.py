"""Secret scans with a random forest that removes false positives, in DataFrame functions only.

Candidates are tokens of 8 or more key characters that hold a digit, runs of 16 or more capitals,
tokens of 16 or more in mixed case, and values of any characters that are assigned to a keyword
(four or more; quoted ones may hold blanks). That stage is wide on purpose. A random forest judges
each candidate by its length, mix and transitions of character classes, distinct characters,
coverage by frequent words of the corpus, path-like separators, and the neighbouring words: whether
a keyword is near, and how often each word or mark beside it stood beside secrets and beside other
findings in the training sample.

It is trained on labelled findings: a DataFrame of findings with a column label. Where none is
given, findings whose form alone is a sure label (provider formats, quoted or assigned keys; plainly
other things such as addresses, numbers, dates, telephone and card numbers, prose) label a sample,
from documents that aren't held out (crc32 of the key mod FOLDS is not 0). No feature is a label
rule, and no held-out document is learnt from, so agreement() over those tells what the forest does.

Defined results: null and empty texts have no findings; a candidate that a document holds more than
once is one finding, judged at all its places and given in the one of highest score; equal keys are
reported together; without findings of both labels nothing is trained and sure findings alone count
as secret; rows of null key aren't held out.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

LABELLED = 4000  # findings of each label in the training sample
FREQUENT = 2000  # words of the dictionary
NEIGHBOURS = 400  # words and marks beside findings whose weight is learnt
FOLDS = 5  # one in so many documents is held out of training
BEFORE, AFTER = 32, 12  # characters of context
REDACTED = "[SECRET]"

#: What a candidate looks like, words that go with secrets, and the forms of sure labels.
CANDIDATE = r"(?<![A-Za-z0-9+/_.~-])(?:(?=[A-Za-z+/_.~-]*[0-9])[A-Za-z0-9+/_.~-]{8,}={0,2}|[A-Z]{16,}|(?=[A-Za-z+/_.~-]*[a-z][A-Z])[A-Za-z+/_.~-]{16,}={0,2})"
KEYWORD = r"(?i)(password|passwd|pwd|secret|token|api.?key|access.?key|private.?key|auth|bearer|credential)"
PROVIDER = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^sk_live_[A-Za-z0-9]{16,}$|^xox[abps]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$"
ASSIGNMENT = KEYWORD + r"[A-Za-z0-9_-]*[\"']?\s*(?::=|=>|[=:])\s*(?:(?:bearer|basic)\s+)?[\"']?"
ASSIGNED = ASSIGNMENT + "$"
NEXT = r"[,;&][A-Za-z_.-]+[=:]"  # another assignment behind a value without quotes
VALUE = r"(?<=\")[^\"\r\n\x01]{4,}(?=\")|(?<=')[^'\r\n\x01]{4,}(?=')|(?![^\s\"'<>,;&]{1,3}" + NEXT + r")[^\s\"'<>\x01]{4,}?(?=[,;.)\]}]*(?:[\s\"'<>\x01]|$)|" + NEXT + ")"
MARK = "\x01"  # set round candidates while a text is cut; none of them holds it
ADDRESS = r"^[0-9.]+$|^[0-9()+ .-]+$|^[0-9]{4}-[0-9]{2}|^v?[0-9]+(\.[0-9]+)+"
PROSE = r"^([A-Za-z]?[a-z]+|[A-Z]+)[.,-]*[0-9]{0,2}$"
MIXED = r"[a-z][A-Z]|[A-Za-z].*[0-9]|[0-9].*[A-Za-z]|[!@#$%^&*~+]"


def places(text: F.Column, pattern: str, replacement: str) -> F.Column:
    """candidate, before and after of every match: the text is cut at marks, so that every second part is a candidate."""

    def cut(parts: F.Column) -> F.Column:
        odd = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
        left = lambda i: F.array_join(F.transform(F.slice(parts, F.greatest(F.lit(1), i - 8), F.least(i, F.lit(9))), lambda x: F.right(x, F.lit(BEFORE))), "")
        right = lambda i: F.array_join(F.transform(F.slice(parts, i + 2, F.lit(5)), lambda x: F.left(x, F.lit(AFTER))), "")
        return F.transform(odd, lambda i: F.struct(F.get(parts, i).alias("candidate"), F.right(left(i), F.lit(BEFORE)).alias("before"), F.left(right(i), F.lit(AFTER)).alias("after")))

    marked = F.regexp_replace(F.translate(text, MARK, " "), pattern, replacement)
    return F.flatten(F.transform(F.array(F.split(marked, MARK)), cut))  # a lambda's variable is evaluated once


def findings(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, candidate, before, after of every distinct place of a candidate in a document."""
    tokens = places(F.col(text), CANDIDATE, f"{MARK}$0{MARK}")
    values = places(F.col(text), f"({ASSIGNMENT})({VALUE})", f"$1{MARK}$3{MARK}")
    found = documents.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(tokens, values)).alias("__place"))
    return found.select(key, "__place.candidate", "__place.before", "__place.after").distinct()


def sure_label(candidate: F.Column, before: F.Column, after: F.Column) -> F.Column:
    """1 or 0 where the form alone tells, else null."""
    assigned, quoted = before.rlike(ASSIGNED), before.rlike(r"[\"']$") & after.rlike(r"^[\"']")
    key_like = candidate.rlike(r"[0-9]") & (F.length(candidate) >= 16) & ~candidate.rlike(r"[/.]")
    value = (F.length(candidate) >= 8) & ~candidate.rlike(ADDRESS) & ~candidate.rlike(r"[\s/.]") & (candidate.rlike(MIXED) | (quoted & candidate.rlike("[^A-Za-z]")))
    secret = candidate.rlike(PROVIDER) | (assigned & (key_like | value))
    word = candidate.rlike(PROSE) & ~(assigned & (quoted | before.rlike(r"=\s*[\"']?$")))
    other = candidate.rlike(ADDRESS) | word | after.rlike(r"^@") | before.rlike(r"@$|://\S*$")
    return F.when(secret, 1).when(other, 0)


def held_out(key: F.Column) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def frequent_words(documents: DataFrame, text: str = "text", n: int = FREQUENT) -> list[str]:
    """The n words of three letters or more that are most frequent in all texts."""
    letters = F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("w")
    return [r.w for r in documents.select(letters).where(F.length("w").between(3, 12)).groupBy("w").count().orderBy(F.desc("count"), "w").limit(n).collect()]


def neighbours() -> F.Column:
    """The last four words or marks before a candidate, and the first after it."""
    found = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"\p{L}+|[^\p{L}\s]"), F.lit(0))
    return F.concat(F.reverse(F.slice(F.reverse(found("before")), 1, 4)), F.transform(F.slice(found("after"), 1, 1), lambda x: F.concat(F.lit(">"), x)))


def neighbour_weights(sample: DataFrame) -> dict[str, float]:
    """Log-odds of a secret for the NEIGHBOURS most frequent neighbours of a labelled sample."""
    seen = sample.select("label", F.explode(F.array_distinct(neighbours())).alias("w")).groupBy("w").agg(F.sum("label").alias("hits"), F.count("*").alias("n"))
    weight = F.log((F.col("hits") + 1) / (F.col("n") - F.col("hits") + 1))
    return {r.w: r.x for r in seen.orderBy(F.desc("n"), "w").limit(NEIGHBOURS).select("w", weight.alias("x")).collect()}


def features(df: DataFrame, dictionary: list[str], weights: dict[str, float]) -> DataFrame:
    """df with a column features."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    runs = F.split(F.lower(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")
    known = F.array(*map(F.lit, dictionary)) if dictionary else F.array().cast("array<string>")
    covered = F.aggregate(F.array_intersect(runs, known), F.lit(0), lambda t, w: t + F.length(w)) / n
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map(F.lit(""), F.lit(0.0))
    near = F.transform(neighbours(), lambda w: F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    columns = {
        "f_length": n,
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_lower": share("[a-z]"),
        "f_hex": share("[0-9a-fA-F]"),
        "f_vowels": share("[aeiouAEIOU]"),
        "f_transitions": share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[a-zA-Z])"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "f_longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0)) / n,
        "f_dictionary": covered,
        "f_path": share("[/.]"),
        "f_dashes": share("[-_+~]"),
        "f_marks": share("[^A-Za-z0-9/.+~_-]"),
        "f_keyword": F.col("before").rlike(KEYWORD).cast("double"),
        "f_neighbours": F.aggregate(near, F.lit(0.0), lambda t, x: t + x),
        "f_joined": (F.col("before").rlike(r"\S$") | F.col("after").rlike(r"^[^\s.,;:\"')]")).cast("double"),
    }
    out = df.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()})
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(out).drop(*columns)


def train(labelled: DataFrame, dictionary: list[str], seed: int = 11):
    """A forest and its neighbour weights from findings with label 0 or 1, or None where a label is missing. The sample is bounded by LABELLED a label."""
    parts = [written(labelled.where(F.col("label") == k).orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "after").limit(LABELLED).select("candidate", "before", "after", F.lit(float(k)).alias("label"))) for k in (0, 1)]
    if not all(p.head(1) for p in parts):
        return None
    sample = parts[0].union(parts[1]).coalesce(2)
    weights = neighbour_weights(sample)
    forest = RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed, labelCol="label", featuresCol="features")
    rows = written(features(sample, dictionary, weights).select("label", "features"))  # read several times by the fit
    return forest.fit(rows.coalesce(1)), weights


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, fold: str | None = None) -> DataFrame:
    """key, candidate, before, after, score (share of the forest for a secret) and secret (0 or 1) of every finding. fold: a field of a struct key that tells which documents are held out; by default the key."""
    found = written(findings(documents.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text"))
    dictionary = frequent_words(documents, text)
    sure = sure_label(F.col("candidate"), F.col("before"), F.col("after"))
    if labelled is None:
        labelled = found.where(~held_out(F.col("key")[fold] if fold else F.col("key"))).withColumn("label", sure).where("label is not null")
    trained = train(labelled, dictionary)
    if trained is None:
        judged = found.withColumn("score", F.coalesce(sure, F.lit(0)).cast("double"))
    else:
        judged = trained[0].transform(features(found, dictionary, trained[1])).withColumn("score", vector_to_array("probability")[1])
    best = F.max(F.struct("score", "before", "after")).alias("best")
    best = judged.select("key", "candidate", "before", "after", "score").groupBy("key", "candidate").agg(best)
    return best.select(F.col("key").alias(key), "candidate", "best.before", "best.after", "best.score", (F.col("best.score") >= 0.5).cast("int").alias("secret"))


def agreement(findings_: DataFrame, *by: str) -> DataFrame:
    """right, missed, false, precision and recall of findings with columns secret and truth (0 or 1), by columns."""
    n = lambda secret, truth: F.sum(((F.col("secret") == secret) & (F.col("truth") == truth)).cast("long"))
    counts = findings_.groupBy(*by).agg(n(1, 1).alias("right"), n(0, 1).alias("missed"), n(1, 0).alias("false"))
    return counts.withColumn("precision", F.try_divide("right", F.col("right") + F.col("false"))).withColumn("recall", F.try_divide("right", F.col("right") + F.col("missed")))


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """documents with every secret of their texts replaced by REDACTED; other columns and rows stay as they are.

    Rows are told apart by key and 128 bits of the text's hash, so rows of one key, or of none, aren't gathered.
    """
    place, mine, found_ = (free_name(documents, x) for x in ("place", "mine", "found"))
    keyed = documents.withColumn(place, F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")))
    least_first = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    secrets = scan(keyed, place, text, labelled, "id").where("secret = 1").groupBy(F.col(place).alias(mine)).agg(F.array_sort(F.collect_set("candidate"), least_first).alias(found_))
    escaped = lambda c: F.regexp_replace(c, r"(\p{Punct})", r"\\$1")
    word = lambda c: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), escaped(c), F.lit(r"(?![\p{L}\p{N}])"))
    whole = lambda c: (F.length(c) < 16) & ~c.rlike("[0-9]")  # short letters aren't cut out of longer words
    clean = F.aggregate(found_, F.col(text), lambda t, c: F.when(whole(c), F.regexp_replace(t, word(c), F.lit(REDACTED))).otherwise(F.replace(t, c, F.lit(REDACTED))))
    joined = keyed.join(secrets, F.col(place).eqNullSafe(F.col(mine)), "left")
    return joined.withColumn(text, F.when(F.col(found_).isNull(), F.col(text)).otherwise(clean)).drop(place, mine, found_)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, finding (SHA-256 of the candidate), n_chars of the candidate, score and secret of every finding."""
    return scan(documents).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.sha2("candidate", 256).alias("finding"), F.length("candidate").alias("n_chars"), "score", "secret")
