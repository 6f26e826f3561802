"""Label cascades: ranked candidates of a raw label, the first good one in the vocabulary wins.

Every cascade builds one array of candidates in order as a column; the array is exploded and joined
to the vocabulary by equality. Modes: vocab (the label must be in the vocabulary), canonical (a
usable label, in the vocabulary or not), raw (the cleaned label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions import text as X

#: Aliases of photo classes, aliases of synset names, synonyms of object categories.
CLASS_ALIASES = {
    "automobile": ["car"],
    "airplane": ["plane"],
    "telephone": ["phone", "cellphone", "cell phone"],
    "television": ["tv"],
    "couch": ["sofa"],
    "pickup truck": ["truck"],
    "lawn mower": ["mower"],
    "streetcar": ["tram", "trolley", "car"],
    "sweet pepper": ["pepper"],
    "maple tree": ["tree"],
    "oak tree": ["tree"],
    "palm tree": ["tree"],
    "pine tree": ["tree"],
    "willow tree": ["tree"],
    "aquarium fish": ["fish"],
    "flatfish": ["fish"],
}
NAME_ALIASES = {
    "cat": ["kitty", "kitten"],
    "kitty": ["cat", "kitten"],
    "kitten": ["cat", "kitty"],
    "dog": ["puppy", "doggy"],
    "puppy": ["dog", "doggy"],
    "rabbit": ["bunny"],
    "bunny": ["rabbit"],
    "horse": ["pony"],
    "pony": ["horse"],
    "bicycle": ["bike"],
    "bike": ["bicycle"],
    "automobile": ["car"],
    "car": ["automobile"],
    "airplane": ["plane", "aeroplane", "aircraft"],
    "plane": ["airplane", "aeroplane", "aircraft"],
    "couch": ["sofa"],
    "sofa": ["couch"],
    "television": ["tv"],
    "tv": ["television"],
    "telephone": ["phone", "cellphone", "cell phone"],
    "phone": ["telephone", "cellphone", "cell phone"],
}
WORD_SYNONYMS = {
    "cat": ["kitty", "kitten", "kitties"],
    "dog": ["puppy", "doggy", "doggies"],
    "rabbit": ["bunny", "bunnies"],
    "horse": ["pony", "horses"],
    "bicycle": ["bike", "bikes"],
    "airplane": ["plane", "aeroplane", "aircraft"],
    "couch": ["sofa"],
    "television": ["tv"],
    "refrigerator": ["fridge"],
    "truck": ["lorry", "trucks"],
    "car": ["automobile", "cars"],
    "cellphone": ["phone"],
    "laptop": ["computer", "notebook"],
    "notebook": ["laptop", "computer"],
}
PHRASE_SYNONYMS = {
    "cell phone": ["phone"],
    "cellphone": ["phone"],
    "mobile phone": ["phone"],
    "laptop computer": ["laptop", "computer"],
    "teddy bear": ["teddy", "bear"],
    "wine glass": ["glass"],
    "potted plant": ["plant", "pot"],
    "dining table": ["table"],
    "hot dog": ["sausage"],
}

Lists = dict[str, list[str]]


def array(*columns: Column | str) -> Column:
    return F.array(*columns).cast("array<string>")


def listed(table: Lists, key: Column) -> Column:
    """The table's list of a key, empty without one."""
    if not table:
        return array()
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), array(*map(F.lit, v)))]), key), array())


def words_of(phrase: Column) -> Column:
    """Words of a cleaned phrase, the last first, then the others in order."""
    w = F.filter(F.split(phrase, " "), lambda x: x != "")
    return F.when(F.size(w) > 1, F.concat(F.slice(w, -1, 1), F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))).otherwise(w)


def spellings(phrase: Column) -> Column:
    """A phrase with blanks, with underscores, and in one word."""
    return array(phrase, F.replace(phrase, F.lit(" "), F.lit("_")), F.replace(phrase, F.lit(" "), F.lit("")))


def heads(phrase: Column) -> Column:
    """Singular of the last word, and the plural of that."""
    one = X.singularize(F.element_at(F.split(phrase, " "), -1))
    return array(one, X.pluralize(one))


def each(values: Column, f) -> Column:
    """Candidates of all values, one after the other."""
    return F.flatten(F.transform(values, f))


def with_aliases(value: Column, table: Lists) -> Column:
    phrase = X.clean_phrase(value)
    return F.concat(array(phrase), listed(table, phrase))


def class_candidates(label: Column, table: Lists) -> Column:
    """Spellings and words of the label, then of its aliases, then of its words' aliases."""
    own = lambda p: F.concat(spellings(X.clean_phrase(p)), words_of(X.clean_phrase(p)))
    all_ = lambda p: each(with_aliases(p, table), own)
    return F.concat(own(label), all_(label), each(words_of(X.clean_phrase(label)), all_))


def name_candidates(name: Column, table: Lists) -> Column:
    """Spellings with aliases, heads with aliases, then words with aliases in all spellings. name is a cleaned phrase."""
    aliases = lambda x: with_aliases(x, table)
    return F.concat(each(F.concat(spellings(name), heads(name)), aliases), each(words_of(name), lambda w: each(aliases(w), spellings)))


def synonym_groups(table: Lists) -> Lists:
    """Every word of a group with all words of its groups, itself among them, in the table's order."""
    out: Lists = {}
    for group in ([k, *v] for k, v in table.items()):
        for w in group:
            out[w] = list(dict.fromkeys([*out.get(w, []), *group]))
    return out


def category_candidates(label: Column, phrases: Lists, words: Lists) -> Column:
    """H1d: spellings, spellings and heads of phrase synonyms, the group of a single word, heads."""
    p = X.clean_phrase(label)
    return F.concat(spellings(p), each(listed(phrases, p), lambda s: F.concat(spellings(s), heads(s))), listed(synonym_groups(words), p), heads(p))


def first_known(rows: DataFrame, key: str, candidates: Column, vocab: DataFrame | None, bad: list[str]) -> DataFrame:
    """key and found: the first good candidate, in the vocabulary where one is given (column token)."""
    c = rows.select(key, F.posexplode(candidates).alias("rank", "cand")).where(X.is_good_label("cand", bad))
    if vocab is not None:
        c = c.join(vocab.select(F.col("token").alias("cand")).distinct(), "cand", "left_semi")
    return c.groupBy(key).agg(F.min_by("cand", "rank").alias("found"))


def _checked(target: Column, vocab: DataFrame, mode: str, rows: DataFrame, key: str, bad: list[str]) -> DataFrame:
    """key and target of rows whose target is usable in this mode."""
    t = rows.select(key, target.alias("target")).where(X.is_good_label("target", bad))
    return t.join(vocab.select(F.col("token").alias("target")).distinct(), "target", "left_semi") if mode == "vocab" else t


def map_classes(raw: DataFrame, vocab: DataFrame, mode: str = "vocab", overrides: dict[str, str] | None = None, aliases: Lists = CLASS_ALIASES, bad: list[str] = X.CLASS_STOP) -> DataFrame:
    """raw_label -> mapped (null: dropped). An override is final; canonical keeps the cleaned label where nothing is in the vocabulary."""
    key = X.normalize_name(F.replace("raw_label", F.lit("_"), F.lit(" ")))
    over = F.get(listed({k: [v] for k, v in (overrides or {}).items()}, key), F.lit(0))
    rows = raw.select("raw_label").distinct().withColumn("__over", over)
    own = X.clean_phrase("raw_label")
    usable = F.when(X.is_good_label(own, bad), own)
    fixed = _checked(X.clean_phrase("__over"), vocab, mode, rows.where("__over is not null"), "raw_label", bad)
    found = first_known(rows.where("__over is null"), "raw_label", class_candidates(F.col("raw_label"), aliases), vocab, bad)
    j = rows.join(fixed, "raw_label", "left").join(found, "raw_label", "left")
    derived = {"raw": usable, "canonical": F.coalesce("found", usable), "vocab": F.col("found")}[mode]
    return j.select("raw_label", F.when(F.col("__over").isNotNull(), F.col("target")).otherwise(derived).alias("mapped"))


def map_names(names: DataFrame, vocab: DataFrame, key: str, mode: str = "vocab", by_id: dict[str, str] | None = None, by_name: dict[str, str] | None = None, aliases: Lists = NAME_ALIASES, bad: list[str] = X.NAME_STOP) -> DataFrame:
    """Key, mapped of several names (column names: array in order): an override of the key is final; else the first name that gives a label, by its own override or its candidates."""
    rows = names.select(key, "names", F.get(listed({k: [v] for k, v in (by_id or {}).items()}, F.col(key).cast("string")), F.lit(0)).alias("__over"))
    one = rows.where("__over is null").select(key, F.posexplode("names").alias("i", "raw"))
    each_ = one.select("raw").distinct().select("raw", X.clean_phrase("raw").alias("phrase")).where("phrase <> ''")  # the cascade runs once a name
    own = F.get(listed({plain_phrase(k): [v] for k, v in (by_name or {}).items()}, F.col("phrase")), F.lit(0))
    derived = {"raw": array("phrase"), "canonical": F.concat(spellings(F.col("phrase")), heads(F.col("phrase"))), "vocab": name_candidates(F.col("phrase"), aliases)}[mode]
    labels = first_known(each_, "raw", F.when(own.isNotNull(), array(X.clean_phrase(own))).otherwise(derived), vocab if mode == "vocab" else None, bad)
    found = one.join(labels, "raw").groupBy(key).agg(F.min_by("found", "i").alias("found"))
    fixed = _checked(X.clean_phrase("__over"), vocab, mode, rows.where("__over is not null"), key, bad)
    j = rows.join(fixed, key, "left").join(found, key, "left")
    return j.select(key, F.when(F.col("__over").isNotNull(), F.col("target")).otherwise(F.col("found")).alias("mapped"))


def plain_phrase(phrase: str) -> str:
    """clean_phrase of a Python string, for keys of overrides."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in phrase.lower().replace("_", " "))
    return " ".join(kept.split())


def map_categories(raw: DataFrame, vocab: DataFrame, mode: str = "vocab", overrides: dict[str, str] | None = None, phrases: Lists = PHRASE_SYNONYMS, words: Lists = WORD_SYNONYMS, bad: list[str] = X.BAD_LABELS) -> DataFrame:
    """H1d: raw_label -> mapped (null: dropped) and reason. Raw mode knows no overrides."""
    label = X.normalize_name("raw_label")
    over = F.lit(None).cast("string") if mode == "raw" else F.get(listed({k: [v] for k, v in (overrides or {}).items()}, label), F.lit(0))
    rows = raw.select("raw_label").distinct().withColumn("__over", over)
    target = X.normalize_name("__over") if mode == "vocab" else X.clean_phrase("__over")
    fixed = _checked(target, vocab, mode, rows.where("__over is not null"), "raw_label", bad)
    own = X.clean_phrase("raw_label")
    order = {"raw": array(own), "canonical": F.concat(array(own), category_candidates(label, phrases, words)), "vocab": F.concat(array(label), category_candidates(label, phrases, words))}[mode]
    found = first_known(rows.where("__over is null"), "raw_label", order, vocab if mode == "vocab" else None, bad)
    j = rows.join(fixed, "raw_label", "left").join(found, "raw_label", "left")
    is_over, hit = F.col("__over").isNotNull(), F.col("found")
    mapped = F.when(is_over, F.col("target")).otherwise(hit)
    why = {
        "raw": F.when(hit.isNull(), "raw_bad").otherwise("raw_clean"),
        "canonical": F.when(mapped.isNull(), "canonical_no_match").otherwise("canonical"),
        "vocab": F.when(is_over & F.col("target").isNull(), "override_oov_or_bad").when(is_over, "override").when(hit.isNull(), "vocab_no_match").when(hit == label, "exact").otherwise("synonym_or_variant"),
    }[mode]
    return j.select("raw_label", mapped.alias("mapped"), why.alias("reason"))
