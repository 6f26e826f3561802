"""Sources and sinks: transcripts, metadata, mask indexes, annotations, concept lists, evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.operators.util import written
from groundspark.session import committed

MASK_INDEX = "frame_relpath string, mask_path string, height int, width int, concept_clip string, concept_kind string, category_prefix string, instance_id int, dino_label_raw string, dino_label_norm string, dino_score double, sam_score double, clip_sim double, mask_area long, mask_bbox_xyxy array<double>, is_priority boolean"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """A1: rows of transcript CSVs (Time, Speaker, Utterance, Video Name; a column row_idx gives the order, else Spark's order within a file)."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("transcript_filename", F.col("_metadata.file_name"))
    if "row_idx" not in raw.columns:
        w = Window.partitionBy("transcript_filename").orderBy("__id")
        raw = raw.withColumn("__id", F.monotonically_increasing_id()).withColumn("row_idx", F.row_number().over(w) - 1).drop("__id")
    names = {"Time": "time_raw", "Speaker": "speaker", "Utterance": "utterance", "Video Name": "video_name"}
    return raw.withColumnsRenamed(names).select("transcript_filename", F.col("row_idx").cast("long").alias("row_idx"), "time_raw", "speaker", "utterance", "video_name")


def read_metadata(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A2: rows of {"data": [...]} JSON files."""
    reader = spark.read.option("multiLine", True)
    raw = reader.schema(f"data array<struct<{schema}>>").json(path) if schema else reader.json(path)
    return raw.select(F.explode("data").alias("col")).select("col.*")


def write_splits(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A3: one folder a split."""
    df.write.partitionBy("split").format(kind).save(path)


def read_mask_index(spark: SparkSession, path: str) -> DataFrame:
    """A4: the append-only JSON-lines index; lines that don't parse are left out."""
    return spark.read.schema(MASK_INDEX).option("mode", "DROPMALFORMED").json(path)


def frame_base(path: str | Column) -> Column:
    """The name of a frame: its path with _ for /, up to the first full stop."""
    return F.split_part(F.replace(X.col(path), F.lit("/"), F.lit("_")), F.lit("."), F.lit(1))


def parsed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows of read_mask_index; lines without any closing bracket, as a broken write leaves them, go before they are parsed (each would cost an exception)."""
    lines = spark.read.text(path).select("value").where(F.contains("value", F.lit("}")) | F.contains("value", F.lit("]")))
    strings = getattr(lines._jdf, "as")(spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark.read.schema(MASK_INDEX).option("mode", "DROPMALFORMED")._jreader.json(strings), spark)


def merged_index(spark: SparkSession, path: str, key: list[str] = ("frame_relpath",)) -> DataFrame:
    """One index from generations of JSON lines (path/0, path/1, ...): of each key the rows of the last generation that has it.

    Generations that were not written to their end, and lines that don't parse or lack a key, are left out.
    """
    done = committed(spark, path)
    rows = None
    for n in done:
        part = parsed_lines(spark, f"{path}/{n}").withColumn("generation", F.lit(n)).dropna(subset=list(key))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], MASK_INDEX + ", generation int")
    if len(done) == 1:
        return rows
    rows = written(rows)  # texts are parsed once
    last = rows.groupBy(*key).agg(F.max("generation").alias("generation"))
    return rows.join(last, [*key, "generation"], "left_semi")


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """A5: path and length of the files below root; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path", "length")


def frame_labels(df: DataFrame, json: str = "json") -> DataFrame:
    """frame_key, label from JSON texts: a list under instances, objects, predictions, masks or annotations, labels under label, concept or name."""
    item = "array<struct<label string, concept string, name string>>".replace(" string", ": string")
    keys = ["instances", "objects", "predictions", "masks", "annotations"]
    doc = F.from_json(json, "struct<" + ", ".join(f"{k}: {item}" for k in keys) + ">")
    rows = df.withColumn("__d", doc).select("frame_key", F.explode_outer(F.coalesce(*[F.col(f"__d.{k}") for k in keys])).alias("x"))
    return rows.select("frame_key", F.lower(F.coalesce("x.label", "x.concept", "x.name")).alias("label"))


def coco_instances(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """instance_id, file_name, raw_label, bbox, area, iscrowd."""
    j = annotations.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id")
    return j.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("raw_label")), "category_id").select(F.col("id").alias("instance_id"), "file_name", "raw_label", "bbox", "area", "iscrowd")


def union_boxes(df: DataFrame) -> DataFrame:
    """file_name, label (first object's name, else folder), the union of all boxes as x, y, w, h (at least one). objects: array<name, xmin, ymin, xmax, ymax>."""
    at = lambda f: F.transform("objects", lambda o: o[f])
    x, y = F.array_min(at("xmin")), F.array_min(at("ymin"))
    w, h = F.greatest(F.array_max(at("xmax")) - x, F.lit(1)), F.greatest(F.array_max(at("ymax")) - y, F.lit(1))
    return df.where(F.size("objects") > 0).select("file_name", F.coalesce(F.get("objects", F.lit(0))["name"], F.col("folder")).alias("label"), F.array(x, y, w, h).cast("array<double>").alias("bbox"))


BOXES = "folder string, filename string, object array<struct<name: string, bndbox: struct<xmin: string, ymin: string, xmax: string, ymax: string>>>"


def read_boxes(spark: SparkSession, path: str, row_tag: str = "annotation") -> DataFrame:
    """file_name, label and bbox of annotations in XML, several to a file or one.

    label: the first name of an object, else the folder; bbox: the union of all boxes whose four sides are numbers, as x, y, w, h
    (at least one), or null without any. file_name: the annotation's, else the file's without its ending. Elements that don't parse go.
    """
    raw = spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").schema(BOXES).load(path).withColumn("__file", F.col("_metadata.file_name"))
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    number = lambda o, f: F.trim(o["bndbox"][f]).try_cast("double")
    sides = F.transform(F.coalesce("object", F.array()), lambda o: F.struct(*[number(o, f).alias(f) for f in ("xmin", "ymin", "xmax", "ymax")]))
    whole = raw.withColumn("objects", F.filter(sides, lambda b: b["xmin"].isNotNull() & b["ymin"].isNotNull() & b["xmax"].isNotNull() & b["ymax"].isNotNull()))
    at = lambda f: F.transform("objects", lambda b: b[f])
    x, y = F.array_min(at("xmin")), F.array_min(at("ymin"))
    box = F.array(x, y, F.greatest(F.array_max(at("xmax")) - x, F.lit(1.0)), F.greatest(F.array_max(at("ymax")) - y, F.lit(1.0)))
    names = F.filter(F.transform(F.coalesce("object", F.array()), lambda o: clean(o["name"])), lambda n: n.isNotNull())
    name = F.coalesce(clean(F.col("filename")), F.regexp_replace("__file", r"\.xml$", ""))
    return whole.select(name.alias("file_name"), F.coalesce(F.get(names, F.lit(0)), clean(F.col("folder"))).alias("label"), F.when(F.size("objects") > 0, box).alias("bbox"))


def parse_words(line: str | Column) -> Column:
    """struct(key, names) of a synset line: the key, then names by commas, cleaned, in order, each once."""
    c = X.col(line)
    key = F.regexp_extract(c, r"^(\S+)\s+(.*)$", 1)
    names = F.transform(F.split(F.regexp_extract(c, r"^(\S+)\s+(.*)$", 2), ","), X.clean_phrase)
    return F.struct(key.alias("key"), F.array_distinct(F.filter(names, lambda x: x != "")).alias("names"))


def concept_list(df: DataFrame, json: str = "json") -> DataFrame:
    """A10: concept, concept_id of a JSON text: a list (places), an object of numbers (given ids), another object (places of its keys)."""
    as_list = F.from_json(json, "array<string>")
    keys, values = F.json_object_keys(json), F.from_json(json, "map<string, string>")
    numbers = F.forall(F.map_values(values), lambda v: v.rlike("^-?[0-9]+$"))
    is_list = F.trim(F.col(json)).startswith("[")
    a = df.where(is_list).select(F.posexplode(as_list).alias("concept_id", "concept"))
    b = df.where(~is_list).select(F.posexplode(keys).alias("i", "concept"), values.alias("v"), numbers.alias("n")).select(F.when(F.col("n"), F.element_at("v", F.col("concept")).try_cast("int")).otherwise(F.col("i")).alias("concept_id"), "concept")
    return a.unionByName(b).select("concept", "concept_id")


def write_eval(results: DataFrame, metrics: DataFrame, path: str) -> None:
    """Results as JSON lines, metrics of classes with trials as CSV."""
    results.write.json(f"{path}/results")
    metrics.where("total > 0").write.csv(f"{path}/metrics", header=True)


#: Column names that are tried in this order, in any case.
NAME_COLUMNS = ["category", "class", "label", "name", "cat"]
SCORE_COLUMNS = ["accuracy", "acc", "score", "value", "percent"]


def load_scores(df: DataFrame) -> DataFrame:
    """Category, score of a table with guessed columns; scores that all lie in 0 .. 1.5 are per cent after it; what isn't a number goes.

    A listed name wins; else the only numeric column is the score, and the first column that isn't numeric the category.
    """
    kinds = dict(df.dtypes)
    numeric = [c for c in df.columns if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")]
    by_name = {c.lower(): c for c in df.columns}
    pick = lambda names, other: next((by_name[n] for n in names if n in by_name), other)
    score = pick(SCORE_COLUMNS, numeric[0] if len(numeric) == 1 else None)
    name = pick(NAME_COLUMNS, next((c for c in df.columns if c not in numeric), None))
    if score is None or name is None:
        raise ValueError(f"no category or score column among {df.columns}")
    value = F.col(f"`{score}`").try_cast("double") if kinds[score] == "string" else F.col(f"`{score}`").cast("double")
    rows = df.select(F.col(f"`{name}`").cast("string").alias("category"), value.alias("score")).where("score is not null and not isnan(score)")
    small = rows.agg(F.every(F.col("score").between(0, 1.5)).alias("small"))
    return rows.crossJoin(F.broadcast(small)).select("category", F.when(F.col("small"), F.col("score") * 100).otherwise(F.col("score")).alias("score"))  # small is one row
