"""Steps whose work must not grow faster than their input, seen in plans and in how rows are dealt."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veinmap.operators import extract, merge, parts, segment
from veinmap.plans import catalog
from veinmap.sources import ontology, star


@pytest.fixture
def parts_dir(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_raw_name_is_computed_once(spark):
    df = spark.createDataFrame([("density: 1.5 g",)], "text string").select(F.inline(extract.properties(F.col("text"))))
    assert plan(df).count("lower(") <= 2
    assert [tuple(r) for r in df.collect()] == [("density", 1.5, "g", "density", "density: 1.5 g")]


def test_an_alloy_is_taken_apart_once_and_reports_are_dealt(spark, parts_dir):
    df = spark.createDataFrame([("U-10Mo-5Zr",)], "name string").select(extract.composition(F.col("name")).alias("c"))
    assert plan(df).count("split(") == 1
    reports = star.reports(spark, parts_dir)
    assert reports.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and reports.count() == 200


def test_merged_properties_are_extracted_once(spark, parts_dir):
    _, properties, _ = merge.merge_results(extract.extract(star.reports(spark, parts_dir)))
    assert plan(properties).count("regexp_extract_all") == 0  # written once; the second aggregate reads that
    raw = extract.extract(star.reports(spark, parts_dir)).select("doc_id", "individuals", "properties", "relationships")
    merged = merge.merge_results(raw)[0]
    assert plan(merged).count("regexp_extract_all") == 2  # of items with and without a key; no list is computed beforehand to see whether it is empty
    assert properties.count() == 100 and merged.count() == 50


class Caught:
    """Stands for a DataFrame and keeps the function that a step maps its rows by."""

    def __init__(self, schema):
        self.schema = schema

    def repartition(self, *names):
        return self

    sortWithinPartitions = select = repartition

    def mapInPandas(self, run, ddl):
        self.run = run

    mapInArrow = mapInPandas


def test_many_rows_of_parts_share_a_frame():
    rows = Caught(StructType().add("doc_id", "long"))
    parts._fed(rows, ["part"], ["text"], parts.Matches.ddl, lambda: parts.Matches(["a"]), "doc_id")
    frames = list(rows.run(iter([pd.DataFrame({"doc_id": [1] * 2000, "text": ["xaxa"] * 2000})])))
    assert len(frames) == 1 and len(frames[0]) == 4000 and frames[0]["at"][:3].tolist() == [1, 3, 5]


@pytest.mark.parametrize("state, text", [(lambda: parts.Fixed(1000, 0), "y" * 1000), (lambda: parts.Pieces(parts.at_cell(1000)), "y" * 1000), (lambda: parts.Pieces(parts.at_heading), "# T\n" + "y" * 1000 + "\n")])
def test_frames_of_parts_are_few_and_bounded(state, text):
    rows = Caught(StructType().add("doc_id", "long"))
    parts._fed(rows, ["part"], ["text"], state().ddl, state, "doc_id")
    frames = list(rows.run(iter([pd.DataFrame({"doc_id": [1] * 9000, "text": [text] * 9000})])))
    assert sum(map(len, frames)) >= 9000 and 2 <= len(frames) <= 5


def test_windows_leave_in_bounded_batches():
    docs = Caught(StructType().add("doc_id", "long"))
    segment.segment_keywords(docs, ["a"], 500)
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, None, 9], "text": [("a" + "x" * 999) * 6000, None, "a"]})
    found = list(docs.run(iter([batch])))
    assert sum(b.num_rows for b in found) == 6001 and 2 <= len(found) <= 4 and found[-1].column("doc_id")[-1].as_py() == 9
    assert found[0].column("match_position")[:2].to_pylist() == [0, 1000] and found[1].column("index")[0].as_py() == found[0].num_rows


@pytest.mark.parametrize("text", ["", "x", "é" * 700, "a\n" * 350 + "b", "𝒳" * 1500])
def test_parts_are_cut_in_linear_time_and_whole(spark, text):
    cut = catalog._in_parts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = [r.text for r in cut.orderBy("part").collect()]
    assert "".join(rows) == text and len(rows) == max(1, -(-len(text) // 700)) and "substring" not in plan(cut)


GOOD = '{\n"classes": [\n{"name": "A, {\\"x\\\\", "subClassOf": ["b"]}\n,{"name": "B"}\n],\n"individuals": [\n{"name": "i", "class": "A", "n": 1.50}\n,{"x": "}"}\n]\n}'


@pytest.mark.parametrize("text, by_lines", [(GOOD, True), (GOOD.replace(',{"x', '{"x'), False), (GOOD.replace(',{"x": "}"}', ',{"x": "}"},{"y": 1}'), False), (GOOD.replace("\n", " "), False)])
def test_large_files_are_read_by_lines(spark, tmp_path, monkeypatch, text, by_lines):
    path = str(tmp_path / "o.json")
    (tmp_path / "o.json").write_text(text)
    rows = lambda o: [sorted(map(str, df.collect())) for df in (o.classes, o.object_properties, o.individuals)]
    whole = rows(ontology.load_ontology(spark, path))
    monkeypatch.setattr(ontology, "WHOLE", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    try:
        assert (ontology._by_lines(spark, path) is not None) == by_lines and rows(ontology.load_ontology(spark, path)) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
