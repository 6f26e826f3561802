"""Work and files that grow with the input, no faster: what is dealt out, written and parsed."""

import glob


from groundspark.operators import labels as L
from groundspark.plans import registry, source_queries
from groundspark.session import committed, shared_folder
from groundspark.sources import files as S

SF = "/root/testdata/sf0.001"


def test_cascade_runs_once_a_name(spark):
    """Equal names of several keys are one row of the cascade."""
    names = spark.createDataFrame([(1, ["gear", "Red box"]), (2, ["nothing", "gears"]), (3, ["gear", None]), (4, [])], "k long, names array<string>")
    vocab = spark.createDataFrame([("gear",), ("box",)], "token string")
    out = L.map_names(names, vocab, "k", "vocab", {}, {}, {})
    assert {r.k: r.mapped for r in out.collect()} == {1: "gear", 2: "gear", 3: "gear", 4: None}
    assert "Aggregate [raw" in out._jdf.queryExecution().optimizedPlan().toString()


def test_annotations_are_dealt_out(spark):
    """A file is read by one task, so the annotations are in several."""
    assert len(registry.QUERIES["a8_xml_boxes"](spark, SF).inputFiles()) > 1


def test_generations_are_parsed_once(spark, tmp_path):
    """Odd lines give what the index's reader gives; the rows are read from a table after that."""
    odd = ['{"frame_relpath": "a", "instance_id": 1}', '{"frame_relpath": "b"', '{"frame_relpath": "c"},', "null", "7", "", "}", '[{"frame_relpath": "d"}, {"frame_relpath": "e"}]', '{"frame_relpath": "f", "instance_id": "x"}', '{"frame_relpath": "g]']
    for i, lines in enumerate((odd, ['{"frame_relpath": "a", "instance_id": 2}'])):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/{i}")
    plain = S.read_mask_index(spark, f"{tmp_path}/0").dropna(subset=["frame_relpath"])
    out = S.merged_index(spark, str(tmp_path))
    want = [(r.frame_relpath, r.instance_id, 0) for r in plain.collect() if r.frame_relpath != "a"] + [("a", 2, 1)]
    assert sorted((r.frame_relpath, r.instance_id, r.generation) for r in out.collect()) == sorted(want, key=str)
    assert not any(str(tmp_path) in f for f in out.inputFiles())


def test_lines_come_packed_in_several_batches(spark):
    """The lines are written once without a shuffle, packed; several batches read them."""
    folder = shared_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/groundspark/*/incoming-*/part-*"))
    out = source_queries.ingested(spark, SF)
    new = set(glob.glob(f"{folder}/groundspark/*/incoming-*/part-*")) - before
    assert new and all(f.endswith(".gz") for f in new) and len(committed(spark, f"{out}/counts")) > 1
    n = source_queries.index_lines(spark, SF).select("frame_relpath", "instance_id", "concept_clip").distinct().count()
    assert spark.read.parquet(*[f"{out}/index/{i}" for i in committed(spark, f"{out}/counts")]).count() == n
