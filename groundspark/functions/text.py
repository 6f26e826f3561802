"""Column functions over labels, utterances and file names (built-in SQL functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Allowed speakers, stop labels, special tokens and word forms of the data model.
SPEAKERS = ["M", "Mom", "mom", "m", "mother", "Mother", "papa", "the mom"]
SPECIAL_TOKENS = ["<pad>", "<unk>", "<sos>", "<eos>"]
COCO_STOP = "a an the and or of to in on for with from by at is it this that these those one two three four five six seven eight nine ten old new young thing stuff piece parking".split()
BAD_LABELS = "a an the and or of to in on for with from by at is it this that these those one two three four five six seven eight nine ten thing stuff piece".split()
NAME_STOP = "a an the and or of to in on for with from by at is it this that these those one two three four five six seven eight nine ten thing stuff piece object old new young".split()
TOKEN_STOP = "a an the and or of to in on for with from by at is it this that these those one two three four five six seven eight nine ten".split()
CLASS_STOP = "a an the and or of to in on for with from by at one two three four five six seven eight nine ten".split()
SHORT_LABELS = ["tv"]
ALIASES = {
    "feet": "foot", "toes": "foot", "toe": "foot",
    "hands": "hand", "fingers": "hand", "finger": "hand", "thumb": "hand",
    "kitty": "cat", "kitties": "cat", "kitten": "cat", "kittie": "cat", "kittys": "cat",
    "stair": "stairs", "steps": "stairs",
    "windows": "window", "doors": "door",
    "fridge": "kitchen", "microwave": "kitchen", "oven": "kitchen", "sink": "kitchen", "pantry": "kitchen", "dishwasher": "kitchen",
    "street": "road", "driveway": "road", "path": "road", "track": "road", "tracks": "road",
    "sandpit": "sand", "sandy": "sand", "beach": "sand",
    "grass": "ground", "dirt": "ground", "cement": "ground",
    "bathroom": "room",
    "seat": "chair", "stool": "chair", "sofa": "chair", "couch": "chair", "bench": "chair",
    "desk": "table", "counter": "table",
    "papers": "paper", "page": "paper", "pages": "paper", "magazine": "paper", "magazines": "paper", "kleenex": "paper",
    "teddy": "toy", "doll": "toy", "dolly": "toy", "puppet": "toy", "robot": "toy", "block": "toy", "blocks": "toy",
    "computers": "computer", "monitor": "computer",
    "basket": "basket", "baskets": "basket",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c: str | Column) -> Column:
    """Seconds of a messy 'mm:ss' text, or null. A lone second digit 1-5 means tens; only what stands before '-' counts."""
    raw = col(c)
    parts = F.split(F.split_part(raw, F.lit("-"), F.lit(1)), "[:.,;]")
    minutes, seconds = F.trim(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
    m = F.when(minutes == "", 0).otherwise(minutes.try_cast("int"))
    s = F.when(seconds.isNull(), 0).when(seconds.rlike("^[1-5]$"), seconds.try_cast("int") * 10).when(F.length(F.trim(seconds)) > 2, None).otherwise(F.trim(seconds).try_cast("int"))
    blank = raw.isNull() | F.lower(F.trim(raw)).isin("", "nan", "-") | (F.trim(F.split_part(raw, F.lit("-"), F.lit(1))) == "")
    return F.when(~blank, m * 60 + s)


def strip_annotations(c: str | Column) -> Column:
    """Text without *...*, [...] and (...) spans; spans with 'inaudible' become INAUDIBLE."""
    out = col(c)
    for start, end in ((r"\*", r"\*"), (r"\[", r"\]"), (r"\(", r"\)")):
        out = F.regexp_replace(out, f"{start}[^)]*inaudible[^)]*{end}", "INAUDIBLE")
        out = F.regexp_replace(out, f"{start}[^)]*{end}", "")
    return F.replace(F.regexp_replace(out, "inaudible", "INAUDIBLE"), F.lit("*"), F.lit(""))


TOKEN = "[a-zA-Z0-9']+|[.,!?;]"


def split_sentences(c: str | Column) -> Column:
    """Sentences as lower-cased tokens joined by one space; INAUDIBLE is <unk>."""
    pieces = F.split(F.regexp_replace(col(c), r"([.!?])\s+", "$1\u0001"), "\u0001")
    one = lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)), lambda t: F.when(t == "INAUDIBLE", "<unk>").otherwise(F.lower(t))), " ")
    return F.filter(F.transform(pieces, one), lambda s: s != "")


def whole_sentences(c: str | Column) -> Column:
    """Sentences as they stand: cut at white space after a full stop, an exclamation or a question mark."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(F.regexp_replace(strip(col(c)), r"([.!?])\s+", "$1\u0001"), "\u0001"), strip), lambda s: s != "")


def tokenize_basic(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def tokenize_ws(c: str | Column) -> Column:
    return F.filter(F.split(F.trim(col(c)), r"\s+"), lambda x: x != "")


def tokenize_alpha(c: str | Column) -> Column:
    """Letter runs in small letters; sub-word marks of vocabularies are taken off first."""
    plain = col(c)
    for mark, by in (("▁", " "), ("Ġ", " "), ("##", "")):
        plain = F.replace(plain, F.lit(mark), F.lit(by))
    return F.filter(F.split(F.lower(plain), "[^a-z]+"), lambda x: x != "")


def canonical(token: Column, aliases: dict[str, str] | None = None, fix_plurals: bool = True) -> Column:
    """Alias of a token, else the token without 'es' (over 3 letters) or 's' (over 2)."""
    table = ALIASES if aliases is None else aliases
    alias = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), token) if table else F.lit(None).cast("string")
    cut = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    plain = F.when(token.rlike("es$") & (F.length(token) > 3), cut(2)).when(token.rlike("s$") & (F.length(token) > 2), cut(1)).otherwise(token)
    return F.coalesce(alias, plain if fix_plurals else token)


def surface_forms(concepts: list[str], aliases: dict[str, str] | None = None) -> dict[str, str]:
    """Every letter token that canonical makes one of the concepts -> that concept: its aliases, and itself, with s and with es where the plural rule leads back."""
    table = ALIASES if aliases is None else aliases
    plain = lambda t: t[:-2] if t.endswith("es") and len(t) > 3 else t[:-1] if t.endswith("s") and len(t) > 2 else t
    forms = {t: c for c in concepts for t in (c, c + "s", c + "es") if t not in table and plain(t) == c}
    return forms | {t: c for t, c in table.items() if c in set(concepts)}


def canon_tokens(c: str | Column, aliases: dict[str, str] | None = None, fix_plurals: bool = True) -> Column:
    """Canonical letter tokens of a text in order."""
    return F.transform(tokenize_alpha(c), lambda t: canonical(t, aliases, fix_plurals))


def normalize_name(c: str | Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(col(c))), r"\s+", " ")


def clean_phrase(c: str | Column) -> Column:
    """Small letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(col(c)), F.lit("_"), F.lit(" ")), "[^a-z0-9 ]+", " "), " +", " "))


def singularize(c: str | Column) -> Column:
    w = normalize_name(c)
    n = F.length(w)
    return F.when(w.rlike("ies$") & (n > 3), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y"))).when(w.rlike("ses$") & (n > 3), F.substring(w, F.lit(1), n - 2)).when(w.rlike("s$") & ~w.rlike("ss$") & (n > 3), F.substring(w, F.lit(1), n - 1)).otherwise(w)


def pluralize(c: str | Column) -> Column:
    w = normalize_name(c)
    return F.when(F.length(w) <= 2, w).when(w.rlike("[^aeiou]y$"), F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit("ies"))).when(w.rlike("(s|x|z|ch|sh)$"), F.concat(w, F.lit("es"))).otherwise(F.concat(w, F.lit("s")))


def is_good_label(c: str | Column, bad: list[str] = BAD_LABELS, allow_short: list[str] = SHORT_LABELS) -> Column:
    w = normalize_name(c)
    return (w != "") & ~w.rlike("^([a-z]|[0-9]+)$") & ((F.length(w) >= 3) | w.isin(allow_short)) & ~w.isin(bad)


def is_reasonable_token(c: str | Column, stop: list[str] = TOKEN_STOP) -> Column:
    """Tokens that can be concepts: small letters, digits, underscores and blanks, three or more or tv, not digits alone, no special token, no stop word."""
    w = F.trim(F.lower(col(c)))
    return w.rlike("^[a-z0-9_ ]+$") & ~w.rlike("^[0-9]+$") & ((F.length(w) >= 3) | w.isin(SHORT_LABELS)) & ~w.isin(stop)


def sanitize_label(c: str | Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), "[ /]", "_"), "[^a-z0-9_-]", "")
    return F.when(s == "", "unknown").otherwise(F.coalesce(s, F.lit("unknown")))


def frame_base(c: str | Column) -> Column:
    """Key of a frame path: separators are '_' and what follows the first dot goes."""
    return F.substring_index(F.regexp_replace(col(c), r"[/\\]", "_"), ".", 1)


def clip_uid(c: str | Column) -> Column:
    """First eight bytes of the md5, little-endian, unsigned."""
    h = F.md5(col(c).cast("binary"))
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def mask_filename(c: str | Column) -> Column:
    """struct(frame, label, number) of '<frame>_obj_<label>_<NNN>[_tag]', nulls where the name has another form."""
    name = col(c)
    pattern = r"^(.+?)_obj_(.+?)_([0-9]{3})(?:_.*)?$"
    ok = name.rlike(pattern)
    part = lambda k: F.when(ok, F.regexp_extract(name, pattern, k))
    return F.struct(part(1).alias("frame"), F.trim(F.lower(part(2))).alias("label"), part(3).cast("int").alias("number"))


def neighbor_key(c: str | Column, offset: Column | int) -> Column:
    """Key with its last number moved by offset, as wide as before; null below zero or without a number."""
    key, by = col(c), F.lit(offset) if isinstance(offset, int) else offset
    digits = F.regexp_extract(key, "([0-9]+)$", 1)
    n = digits.try_cast("long") + by
    text = n.cast("string")
    padded = F.when(F.length(text) < F.length(digits), F.lpad(text, F.length(digits), F.lit("0"))).otherwise(text)
    return F.when((digits != "") & (n >= 0), F.concat(F.regexp_extract(key, "^(.*?)[0-9]+$", 1), padded))


def frame_name(c: str | Column) -> Column:
    """struct(clip, utt, frm) of 'clip_uuu_ff' names; others are their stem with zeros."""
    stem = F.regexp_replace(col(c), r"\.[^.]*$", "")
    pattern = r"^(.+)_([0-9]+)_([0-9]+)$"
    ok = stem.rlike(pattern)
    return F.struct(F.when(ok, F.regexp_extract(stem, pattern, 1)).otherwise(stem).alias("clip"), F.when(ok, F.regexp_extract(stem, pattern, 2).try_cast("int")).otherwise(0).alias("utt"), F.when(ok, F.regexp_extract(stem, pattern, 3).try_cast("int")).otherwise(0).alias("frm"))


def frame_place(c: str | Column, video: str | Column, transcript: str | Column) -> Column:
    """frame_name, whose clip is the stem of the video, else of the transcript, where the name has another form."""
    name = frame_name(c)
    stem = lambda x: F.when(F.length(col(x)) > 0, F.regexp_replace(F.regexp_replace(col(x), "^.*/", ""), r"(?<=.)\.[^.]*$", ""))
    plain = ~F.regexp_replace(col(c), r"\.[^.]*$", "").rlike(r"^(.+)_([0-9]+)_([0-9]+)$")
    return F.struct(F.when(plain, F.coalesce(stem(video), stem(transcript), name["clip"])).otherwise(name["clip"]).alias("clip"), name["utt"].alias("utt"), name["frm"].alias("frm"))


def frame_index(timestamps: Column, utt: Column, frm: Column, fps: float = 5.0) -> Column:
    """floor(timestamp * fps + 1e-6) by the frame's own number, else utt * 1000 + frm."""
    at = F.get(timestamps, frm)
    return F.coalesce(F.floor(at * fps + 1e-6), (utt * 1000 + frm).cast("long"))
