"""Constraint routing, vocabulary matching, records, limits before shuffles, shared paths."""

import random

import pytest
from pyspark.sql import functions as F

from veinmap.model import Graph
from veinmap.operators import extract, graph, links, relational, vocabulary

PROPS = "pos long, id string, material_id string, property_name string"


def reasons(rows, ids=(), parents=None):
    """The definition, row by row."""
    seen, out = set(ids), {}
    for pos, i, m, p in sorted(rows):
        own = [f"null: {c}" for c, v in (("id", i), ("material_id", m), ("property_name", p)) if v is None]
        own += ["duplicate: id"] if i is not None and i in seen else []
        own += ["no parent: material_id"] if parents is not None and m is not None and m not in parents else []
        seen.add(i)
        out[pos] = own
    return out


def test_rows_are_routed_by_their_constraints(spark):
    rng = random.Random(1)
    some = lambda n: rng.choice([None, *(f"k{i}" for i in range(n))])
    rows = [(i, some(150), some(6), some(2)) for i in range(300)]
    df = spark.createDataFrame(rows, PROPS).repartition(4)
    there, parents = ["k1", "k2"], {"k0", "k3", "k5"}
    one = lambda ids: spark.createDataFrame([(i,) for i in [*ids, *ids]], "id string")
    got = relational.routed("material_properties", df, "pos", one(there), {"material_id": one(parents)}).collect()
    assert {r.pos: r.reasons for r in got} == reasons(rows, there, parents) and len(got) == 300
    got = relational.routed("material_properties", df.limit(0), "pos", parents={"material_id": one(parents)})
    assert got.count() == 0


def test_inserting_twice_keeps_keys_unique(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "U", None), (1, "b", None, None), (2, "a", "V", None), (3, None, "W", None)], "pos long, id string, name string, material_type string")
    first = relational.insert("materials", rows, str(tmp_path / "m"), "pos").collect()
    assert sorted((r.pos, r.error, r.reasons) for r in first) == [(1, "Failed to insert: unknown", ["null: name"]), (2, "Failed to insert: V", ["duplicate: id"]), (3, "Failed to insert: W", ["null: id"])]
    assert relational.insert("materials", rows, str(tmp_path / "m"), "pos").count() == 4
    assert [(r.id, r.name) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [("a", "U")]


@pytest.mark.parametrize("lowered, whole", [(False, False), (True, False), (False, True)])
def test_mentions_equal_a_search_of_each_name(spark, lowered, whole):
    rng = random.Random(2)
    names = ["a", "ab", "ba", "aba", "é", "B", "a b", "bb"]
    texts = ["".join(rng.choice("abBé _-") for _ in range(rng.randrange(0, 60))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("name", F.lit("x")).repartition(3)
    want = set()
    for i, t in enumerate(texts):
        t = (t or "").lower() if lowered else t or ""
        for n in names:
            at = [k for k in range(len(t)) if t.startswith(n, k)]
            if whole:
                at = [k for k in at if not (k and (t[k - 1].isalnum() or t[k - 1] == "_")) and not (t[k + len(n) : k + len(n) + 1].isalnum() or t[k + len(n) : k + len(n) + 1] == "_")]
            if at:
                want.add((i, n, len(at), at[0]))
    assert {tuple(r) for r in vocabulary.mentions(df, names, lowered, whole).collect()} == want
    assert vocabulary.mentions(df, []).count() == 0


def test_a_vocabulary_is_bounded(spark, monkeypatch):
    names = spark.createDataFrame([("b",), ("a",), ("",), (None,), ("a",)], "name string")
    assert vocabulary.vocabulary(names) == ["a", "b"]
    monkeypatch.setattr(vocabulary, "MOST_NAMES", 1)
    with pytest.raises(ValueError):
        vocabulary.vocabulary(names)


def test_records(spark):
    df = spark.createDataFrame([(None, "U-10Mo from 25–80 K"), ("p1", None)], "source string, text string")
    got = {r.source: r for r in extract.records(extract.extract(df, "source")).collect()}
    assert set(got) == {"unknown", "p1"} and got["unknown"].total_items == 1
    assert got["unknown"].metadata.method == "rule-based" and got["unknown"].metadata.text_length == 19 and len(got["unknown"].metadata.temperature_ranges) == 1


def test_edges_of_a_hub_are_limited_before_the_shuffle(spark):
    edges = spark.range(2000).select(F.col("id").alias("pos"), F.lit("hub").alias("from"), F.concat(F.lit("n"), "id").alias("to"), F.lit("t").alias("type"))
    nodes = edges.select(F.col("to").alias("id"), F.col("to").alias("name"), F.lit("class").alias("type"))
    top = graph.top_edges(Graph(nodes, edges))
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert [(r["rank"], r.other) for r in top.where("direction = 'out'").orderBy("rank").collect()] == [(i + 1, f"n{i}") for i in range(5)]
    assert top.where("direction = 'in'").count() == 2000


def test_shared_paths_need_a_shared_folder_on_a_cluster():
    class Session:
        def __init__(self, master, folder):
            self.sparkContext = type("C", (), {"master": master})()
            self.conf = type("C", (), {"get": lambda _, key, *other: {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "/w"}[key]})()

    with pytest.raises(ValueError):
        links.shared_path(Session("spark://host:7077", None), "cut")
    with pytest.raises(ValueError):
        links.shared_path(Session("local-cluster[2,1,1024]", None), "cut")
    assert links.shared_path(Session("yarn", "hdfs:///shared/"), "cut").startswith("hdfs:///shared/cut-")
    assert links.shared_path(Session("local[4]", None), "cut").startswith("/w/checkpoints/cut-")
    del links._made[-2:]


def test_indexed_search_equals_the_scan(spark, tmp_path):
    from veinmap.operators import trigrams

    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abcÄ ") for _ in range(rng.randrange(0, 14))) if i % 9 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "pos long, name string")
    folder = str(tmp_path / "index")
    trigrams.add(df.where("pos < 500"), folder, "a")
    trigrams.add(df.where("pos >= 500"), folder, "b")
    trigrams.add(df.where("pos >= 500"), folder, "b")  # again
    for term in ("abc", "ABCA", "cÄb", "ä a", "abcabcabcabcabc", "ab", ""):
        got = sorted(r.pos for r in trigrams.search(df, folder, term).collect())
        assert got == [i for i, t in rows if t is not None and term.lower() in t.lower()], term
    plan = trigrams.candidates(spark, folder, "abca")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(gram" in plan


def test_rows_by_conditions(spark, tmp_path):
    from veinmap.sources import tables

    rows = [(f"k{i}", i, None if i % 3 == 0 else f"n{i}") for i in range(30)]
    spark.createDataFrame(rows, "id string, x int, name string").write.parquet(str(tmp_path / "t"))
    get = lambda **how: [r.id for r in tables.select(spark, str(tmp_path), "t", **how).collect()]
    assert sorted(get()) == sorted(r[0] for r in rows)
    assert get(where={"x": ("gte", 20), "name": ("is", None)}, order=["x"], descending=True, limit=2) == ["k27", "k24"]
    assert get(where={"x": ("in", [3, 5, 99]), "id": ("neq", "k3")}) == ["k5"]
    assert sorted(get(where={"name": ("ilike", "N1%"), "x": ("lt", 12)})) == ["k1", "k10", "k11"]
    assert tables.select(spark, str(tmp_path), "none", columns=["id", "name"]).collect() == []
    assert {r.name: r.n for r in tables.counts(spark, str(tmp_path), ["t", "none"]).collect()} == {"t": 30, "none": 0}
    with pytest.raises(ValueError):
        get(where={"x": ("near", 1)})
    plan = tables.select(spark, str(tmp_path), "t", {"x": ("gt", 5)}, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,5)" in plan and "ReadSchema: struct<id:string,x:int>" in plan
