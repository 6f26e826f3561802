"""Incremental jobs: batches that are run again, half-written tables, summaries merged in any order, annotations in XML."""

import os

from pyspark.sql import functions as F

from groundspark.operators import prototypes as G
from groundspark.session import committed
from groundspark.sources import files as S
from groundspark.streaming import jobs as J

ROWS = "frame string, concept string"


def counts(spark, path):
    return {r.concept: r.n for r in J.read_counts(spark, path).collect()}


def test_batch_run_twice_gives_the_same_tables(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    batches = [[("a", "x"), ("a", "x"), ("b", "y"), (None, "x")], [("a", "x"), ("c", "x"), (None, "x"), ("b", "z")], []]
    for i, rows in enumerate(batches):
        for _ in range(2):
            J.add_batch(spark.createDataFrame(rows, ROWS), i, ["frame", "concept"], "concept", path)
            seen = {(r.frame, r.concept) for r in J.read_index(spark, path).collect()}
            assert J.read_index(spark, path).count() == len(seen) and seen == {x for b in batches[: i + 1] for x in b}
            assert counts(spark, path) == {c: sum(1 for x in seen if x[1] == c) for c in {x[1] for x in seen}}
    J.add_batch(spark.createDataFrame(batches[1], ROWS), 1, ["frame", "concept"], "concept", path)  # an earlier one again
    assert J.read_index(spark, path).count() == len(seen)


def test_stream_holds_no_state_and_half_written_batches_are_not_read(spark, tmp_path):
    lines = spark.range(40).select((F.col("id") % 13).cast("string").alias("frame"), (F.col("id") % 3).cast("string").alias("concept"))
    lines.repartition(5).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    query = J.ingest_index(stream, ["frame"], "concept", f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert len(query.recentProgress) == 5 and all(p["stateOperators"] == [] for p in query.recentProgress)
    assert J.read_index(spark, f"{tmp_path}/out").count() == 13
    os.makedirs(f"{tmp_path}/out/counts/9")
    assert committed(spark, f"{tmp_path}/out/counts") == [0, 1, 2, 3, 4] and sum(counts(spark, f"{tmp_path}/out").values()) == 13
    assert committed(spark, f"{tmp_path}/nothing") == []


def test_half_written_generations_are_left_out(spark, tmp_path):
    write = lambda n, rows: spark.createDataFrame([(r,) for r in rows], "value string").write.text(f"{tmp_path}/g/{n}")
    write(0, ['{"frame_relpath": "a/1.jpg", "instance_id": 0}', '{"frame_relpath": "b.jpg", "instance_id": 0}', "{broken", '{"instance_id": 4}'])
    write(1, ['{"frame_relpath": "a/1.jpg", "instance_id": 7}', '{"frame_relpath": "a/1.jpg", "instance_id": 8}'])
    write(2, ['{"frame_relpath": "b.jpg", "instance_id": 99}'])
    os.remove(f"{tmp_path}/g/2/_SUCCESS")
    got = {(r.frame, r.instance_id, r.generation) for r in S.merged_index(spark, f"{tmp_path}/g").withColumn("frame", S.frame_base("frame_relpath")).collect()}
    assert got == {("a_1", 7, 1), ("a_1", 8, 1), ("b", 0, 0)}
    assert S.merged_index(spark, f"{tmp_path}/none").count() == 0


def test_merged_summaries_equal_one_pass(spark):
    objs = spark.range(300).select(F.col("id").alias("obj_id"), (F.col("id") % 5 - 1).cast("int").alias("concept_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("z"))
    protos = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0])], "proto_id int, p array<double>")
    parts = [G.dump_state(objs.where(f"obj_id % 4 = {i}"), protos, 20) for i in range(4)]
    whole = G.dump_objects(objs, protos, 20).collect()
    for merged in (G.merge_dumps(*parts, most=20), G.merge_dumps(G.merge_dumps(parts[3], parts[1], most=20), G.merge_dumps(parts[0], parts[2], most=20), most=20)):
        assert sorted(map(tuple, G.dumped(merged).collect())) == sorted(map(tuple, whole))
        means = {r.concept_id: (r.total, r.mean) for r in G.dumped_means(merged).collect()}
        for r in objs.where("concept_id >= 0").groupBy("concept_id").agg(F.count("*").alias("n"), F.avg(F.col("z")[0]).alias("m")).collect():
            assert means[r.concept_id][0] == r.n and abs(means[r.concept_id][1][0] - r.m) < 1e-9


def test_boxes_of_xml(spark, tmp_path):
    box = lambda *v: "<bndbox>" + "".join(f"<{n}>{x}</{n}>" for n, x in zip(("xmin", "ymin", "xmax", "ymax"), v, strict=True)) + "</bndbox>"
    files = {
        "one.xml": f"<annotation><folder>f1</folder>\n<object><name> n01 </name>{box(5, 6, 9, 8)}</object><object><name>n02</name>{box(2, 7, 4, 7)}</object></annotation>",
        "two.xml": f"<annotation><folder> f2 </folder><filename>own</filename><object>{box(1, 1, 1, 'x')}</object></annotation>",
        "three.xml": "<annotation><object><name>n03</name></object></annotation>",
        "four.xml": "<annotation><folder>f4</folder>",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r.file_name: (r.label, r.bbox) for r in S.read_boxes(spark, str(tmp_path)).collect()}
    got.pop("four", None)
    assert got == {"one": ("n01", [2.0, 6.0, 7.0, 2.0]), "own": ("f2", None), "three": ("n03", None)}
