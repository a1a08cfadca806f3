import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from veinmap import cli
from veinmap.functions import text as fn
from veinmap.operators import extract, graph, links, merge, quality, query, relational, segment, sinks, update
from veinmap.plans import catalog
from veinmap.sources.ontology import default_path, load_graph, load_ontology, load_rows


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    return tmp_path_factory.mktemp("ontology")


def put(files, name, value):
    path = files / name
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


O2 = {
    "classes": {"NuclearFuel": {"uri": "u", "comment": "Fuel class", "parent": "Material"}, "AlloySystem": {"subClassOf": ["Material", "Other"]}, "Material": {}},
    "objectProperties": {"hasPart": {"domain": "a", "range": "b"}},
    "datatypeProperties": {"density": {"domain": "a", "range": "xsd:float"}},
    "individuals": {
        "U10Mo_fuel": {"class": "NuclearFuel", "prop_density": 17.0, "name": "inner"},
        "U10Zr_fuel": {"class": "NuclearFuel", "prop_density": 16.0, "prop_ok": True},
        "HEA_test": {"class": "AlloySystem", "type": ["AlloySystem", "HighEntropyAlloy"]},
        "twice": {"type": ["X", "Y"], "classes": ["x"]},
        "never": {"type": ["Y"], "classes": ["x"]},
        "scalar": 5,
    },
    "metadata": {"v": 1},
}


@pytest.fixture(scope="module")
def o2(spark, files):
    return load_ontology(spark, put(files, "o2.json", O2))


def names(df):
    return [r.name for r in df.orderBy("pos").collect()]


def test_load(spark, files, o2):
    assert names(o2.individuals) == list(O2["individuals"])
    rows = {r.name: r for r in o2.individuals.collect()}
    assert rows["U10Mo_fuel"].attrs == {"prop_density": "17.0"} and rows["U10Mo_fuel"].nums == {"prop_density": 17.0}
    assert rows["U10Zr_fuel"].attrs["prop_ok"] == "True" and rows["U10Zr_fuel"].nums["prop_ok"] == 1.0
    assert rows["scalar"].attrs == {"value": "5"}
    assert tuple(query.stats(o2).first()) == (3, 1, 1, 6)
    listed = load_ontology(spark, put(files, "list.json", {"classes": None, "individuals": [{"name": "A", "type": "Alloy"}, {"x": 1}]}))
    assert [(r.pos, r.name) for r in listed.individuals.collect()] == [(0, "A"), (1, None)] and listed.classes.count() == 0
    repeated = load_ontology(spark, put(files, "twice.json", '{"classes": {}, "individuals": {"A": {"x": 1, "x": 2}}}'))
    assert repeated.individuals.first().attrs == {"x": "2"}
    with pytest.raises(FileNotFoundError):
        default_path(("no.json",), (str(files),))
    assert default_path(("no.json", "o2.json"), (str(files),)).endswith("o2.json")


def test_queries(o2):
    assert names(query.search(o2, "u10mo")) == ["U10Mo_fuel"]
    assert names(query.search(o2, "FUEL", "classes")) == ["NuclearFuel"]
    assert query.search(o2, "").count() == 9
    with pytest.raises(ValueError):
        query.search(o2, "x", "nothing")
    assert len(names(query.by_class(o2, "nuclearfuel"))) == 2 and names(query.by_class(o2, "AlloySystem")) == ["HEA_test"]
    assert names(query.by_class(o2, "X")) == ["twice", "twice"]
    assert names(query.by_property(o2, "density")) == ["U10Mo_fuel", "U10Zr_fuel"]
    assert names(query.by_property(o2, "prop_density", "17")) == ["U10Mo_fuel"]
    assert names(query.by_property(o2, "p")) == ["U10Mo_fuel", "U10Zr_fuel"]
    assert [(r.relation, r.name) for r in query.hierarchy(o2, "material").collect()] == [("class", "Material"), ("child", "AlloySystem")]
    shown, more = query.displayed(query.search(o2, ""), 2)
    assert shown.count() == 2 and more == 7
    assert [r["class"] for r in query.class_distribution(o2).collect()] == ["Unknown", "NuclearFuel", "AlloySystem"]


def test_quality(spark, files):
    o = load_ontology(spark, put(files, "o3.json", {"classes": {"T": {"comment": "c", "parent": "p"}}, "objectProperties": {"a": {"domain": "d", "range": "r"}}, "datatypeProperties": {"b": {}}, "individuals": {"M": {"class": "T"}}}))
    r = quality.validate(o).first()
    assert tuple(r)[:7] == (100, 0, 100, 100, 50, 70, "B") and len(r.issues) == 2
    q = quality.quick_check(o).first()
    assert (q.individuals_per_class, q.properties_per_class, q.healthy) == (1.0, 2.0, True)
    empty = load_ontology(spark, put(files, "none.json", {}))
    assert tuple(quality.validate(empty).first())[:7] == (0, 0, 50, 0, 50, 20, "F")


def test_graph(spark, files):
    g = load_graph(spark, put(files, "g.json", {"nodes": [{"id": "1", "name": "Alpha", "type": "class"}, {"id": "2", "name": "", "type": "individual"}, {"id": "3", "name": "beta", "type": "data_property"}], "rels": [{"from": "1", "to": "2", "type": "t"}, {"from": "2", "to": "3", "type": "t"}, {"from": "1", "to": "9", "type": "t"}], "relationships": None}))
    assert [r.to_name for r in graph.neighbours(g).orderBy("pos").collect()] == ["2", "beta", "9"]
    assert {(r.id, r.degree) for r in graph.degrees(g).collect()} == {("1", 2), ("2", 2), ("3", 1), ("9", 1)}
    assert graph.induced(g, term="a").edges.count() == 0 and graph.filtered_nodes(g, "property").count() == 0
    assert tuple(graph.counts(g).first()) == (3, 3)
    assert graph.top_edges(g, 1, 1).count() == 5


def chunks(spark, text, f, *a):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.asDict() for r in f(df, *a).orderBy("index").collect()]


@pytest.mark.parametrize("text,least,want", [
    ("# Title\nSome content here.", 100, [("Title", "Some content here.", 1, 0, 26)]),
    ("plain text", 100, [("full_document", "plain text", 0, 0, 10)]),
    ("", 100, [("full_document", "", 0, 0, 0)]),
    ("## A\nX\n## B\nY\n## C\nZ", 100, [("A + B + C", "X\n\nY\n\nZ", 2, 0, 20)]),
    ("Preamble text\n# First Section\nContent", 100, [("preamble + First Section", "Preamble text\n\nContent", 0, 0, 37)]),
    ("# T\n## S 1\n" + "X" * 200 + "\n## S 2\n" + "Y" * 200, 100, [("S 1", "X" * 200, 2, 4, 212), ("S 2", "Y" * 200, 2, 212, 419)]),
    ("# A\n\n## B\n", 100, []),
    ("é🎉\n## Ü b\r\nx", 0, [("preamble", "é🎉", 0, 0, 3), ("Ü b", "x", 2, 3, 12)]),
    ("#nothing\n####### seven", 0, [("full_document", "#nothing\n####### seven", 0, 0, 22)]),
])
def test_headings(spark, text, least, want):
    assert [(c["title"], c["content"], c["level"], c["start_char"], c["end_char"]) for c in chunks(spark, text, segment.segment_headings, least)] == want


def test_fixed_and_keywords(spark):
    assert [(c["start_char"], c["end_char"]) for c in chunks(spark, "A" * 10000, segment.segment_fixed, 4000, 0)] == [(0, 4000), (4000, 8000), (8000, 10000)]
    assert [c["start_char"] for c in chunks(spark, "A" * 8000, segment.segment_fixed)] == [0, 3800, 7600]
    assert chunks(spark, "  \n ", segment.segment_fixed) == [] and len(chunks(spark, "abcdef", segment.segment_fixed, 2, 5)) == 5
    text = "U-10Mo " + "x" * 200 + " u-10mo and U-10Zr"
    got = chunks(spark, text, segment.segment_keywords, ["U-10Mo", "u-10zr"], 50)
    assert [(c["keyword"], c["match_position"]) for c in got] == [("U-10Mo", 0), ("U-10Mo", 208)]
    assert got[1]["content"] == text[158:].strip()


def extracted(spark, text):
    return extract.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_extraction(spark):
    r = extracted(spark, "The U-10Mo alloy and U-10Zr, Fe-25Cr-20Ni-0.5C; U-10Mo. xU-10Mo U-10moo")
    assert [i.name for i in r.individuals] == ["U-10Mo", "U-10Zr", "Fe-25Cr-20Ni-0.5C"] and r.individuals[0].composition == {}
    r = extracted(spark, "Density: 15.8 g/cm³. Melting point: 1132°C. Yield strength: 650 MPa.")
    assert [(p.name, p.value, p.unit) for p in r.properties] == [("density", 15.8, "g/cm³"), ("melting_point", 1132.0, "°C"), ("yield_strength", 650.0, "MPa")]
    assert [(p.name, p.value, p.unit) for p in extracted(spark, "density: 15").properties] == [("density", 1.0, "5")]
    assert [(p.name, p.unit) for p in extracted(spark, "thickness: 5 mm").properties] == [("thermal_conductivity", "mm")]
    assert [p.phase for p in extracted(spark, "The alloy has a BCC structure, γ phase is stable and BCC PHASE").relationships] == ["BCC structure", "γ", "BCC PHASE"]
    assert [tuple(t) for t in extracted(spark, "from 25–800°C or 300-500 K").temperature_ranges] == [(25.0, 800.0, "°C"), (300.0, 500.0, "K")]
    assert extracted(spark, None).total_items == 0
    c = spark.range(1).select(extract.composition(F.lit("U90-Mo10")).alias("a"), extract.composition(F.lit("Zr-Mo10")).alias("b")).first()
    assert c.a == {"U": 90.0, "Mo": 10.0} and c.b == {"Mo": 10.0, "Zr": 90.0}


def test_template(spark):
    df = spark.createDataFrame([(1, "density: 15.8 g/cm³")], "doc_id long, text string")
    r = extract.extract_with_template(df, {"density": r"Density:\s*(\d+\.\d+)\s*(\S+)", "x": ["no"]}).collect()
    assert [(x.name, x.value, x.is_scalar, x.position) for x in r] == [("density", ["15.8", "g/cm³"], False, 0)]


def items(spark, rows):
    return spark.createDataFrame([(i, n, a) for i, (n, a) in enumerate(rows)], "pos long, name string, attrs map<string,string>")


def merged(spark, rows, **kw):
    return [(r.name, r.attrs) for r in merge.dedup(items(spark, rows), **kw).orderBy("pos").collect()]


def test_merging(spark):
    v = lambda n: {"v": str(n)}
    assert merged(spark, [("A", v(1)), ("B", v(2)), (" a ", v(3)), (None, v(4)), ("", v(5))]) == [(" a ", v(3)), ("B", v(2)), (None, v(4)), ("", v(5))]
    assert merged(spark, [("A", {"x": "1"}), ("A", {"y": "2", "x": "3"})], conflict="merge", attrs="attrs") == [("A", {"x": "1", "y": "2"})]
    assert merged(spark, [("A", v(1)), ("A", v(2))], conflict="priority") == [("A", v(1))]
    assert merged(spark, [("U-10Mo", v(1)), ("U10Mo", v(2))], strategy="normalized") == [("U-10Mo", v(1))]
    assert merged(spark, [("U10Mo", v(1)), ("U-10Mo", v(2))], strategy="normalized") == [("U-10Mo", v(2))]
    assert merged(spark, [("U-10Mo alloy", v(1)), ("U-10Mo Alloy", v(2))], strategy="fuzzy") == [("U-10Mo Alloy", v(2))]
    assert len(merge.dedup_fuzzy(items(spark, [("U-10Mo", v(1)), ("U-10Zr", v(2))]), threshold=0.9).collect()) == 2
    props = spark.createDataFrame([(0, "b", "1", "u"), (1, "a", "1", "u"), (2, "b", "1", "u"), (3, "b", "2", None)], "pos long, name string, value string, unit string")
    assert [r.pos for r in merge.merge_properties(props).orderBy("name_pos", "pos").collect()] == [0, 3, 1]


def test_normalized_chain_against_a_fold(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice(["a", "b", "-", " ", "_", "A"]) for _ in range(3)), {"v": str(i)}) for i in range(300)]
    want, seen = [], {}
    for name, attrs in rows:
        if not name:
            want.append((name, attrs))
            continue
        key = "".join(c for c in name.strip().lower() if c not in " -_")
        if key not in seen:
            seen[key] = len(want)
            want.append((name, attrs))
        elif want[seen[key]][0].strip().lower() == key:
            want[seen[key]] = (name, attrs)
    assert sorted(merged(spark, rows, strategy="normalized"), key=str) == sorted(want, key=str)


def test_updates(spark, tmp_path):
    have = items(spark, [("U-10Mo", {"type": "A"}), ("dup", {}), ("dup", {})])
    new = items(spark, [("U-10Mo", {"type": "B"}), ("U-10Mo", {"density": "15.8"}), ("", {}), (None, {"t": "Y"}), ("n", {}), ("n", {}), ("u-10mo", {})])
    assert tuple(update.update_stats(have, new).first()) == (3, 1, 3)
    assert [r.attrs for r in update.add_individuals(have, new).where("name = 'U-10Mo'").collect()] == [{"type": "A", "density": "15.8"}]
    assert update.changes(have, new).count() == 3
    props = spark.createDataFrame([(0, "dup", "m", "1"), (1, "dup", "m", "2"), (2, "gone", "m", "3")], "pos long, individual string, name string, value string")
    assert [r.attrs for r in update.add_properties(have, props).orderBy("pos").collect()] == [{"type": "A"}, {"prop_m": "2"}, {}]
    assert tuple(update.property_stats(have, props).first()) == (2, 1)

    from veinmap.streaming import incremental

    folder = str(tmp_path / "state")
    incremental.start(have, folder)
    for i in range(2):
        items(spark, [(f"s{i}", {"k": str(i)}), ("U-10Mo", {f"s{i}": "1"})]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pos long, name string, attrs map<string,string>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.follow(stream, folder, str(tmp_path / "checkpoint")).awaitTermination()
    rows = {r.name: r.attrs for r in incremental.current(spark, folder).collect()}
    assert set(rows) == {"U-10Mo", "dup", "s0", "s1"} and set(rows["U-10Mo"]) == {"type", "s0", "s1"}


def test_relational(spark, o2, tmp_path):
    rows = {"U_10Mo_alloy": "10Mo", "Steel_316": "", "U-10Zr_test": "U10Zr", "UMo_U-10Mo_fuel": "U10Mo", "plain": ""}
    df = spark.createDataFrame([(k,) for k in rows], "name string")
    assert {r.name: r.f for r in df.select("name", fn.formula(F.col("name")).alias("f")).collect()} == rows
    assert tuple(relational.restore_stats(o2).first()) == (6, 3, 0)
    relational.restore(o2, str(tmp_path))
    a, b = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("materials", "material_properties"))
    assert relational.orphans(b, a).count() == 0 and b.count() == 3 and relational.verify(a)[0] == 6
    assert {r.column: r.n for r in relational.missing_values("materials", a).collect()} == {"id": 0, "name": 0}
    assert len(relational.TABLES) == 5 and 'FOREIGN KEY ("material_id") REFERENCES materials(id)' in relational.create_sql("material_properties")
    assert relational.all_sql().count("CREATE TABLE") == 5 and "authors array<string>" in relational.schema("literature_sources")
    with pytest.raises(ValueError):
        relational.create_sql("x")


def test_sinks_and_commands(spark, files, o2, tmp_path, capsys):
    path = put(files, "cli.json", O2)
    lines = [r.line for r in sinks.graphml_lines(o2).orderBy("ord", "pos", "part").collect()]
    assert sum("<node" in x for x in lines) == 9 and sum("<edge" in x for x in lines) == 3
    for kind in ("json", "csv-classes", "csv-individuals", "csv-properties", "graphml", "markdown"):
        assert cli.main(["--ontology", path, "export", kind, str(tmp_path / kind)], spark) == 0
    assert (tmp_path / "csv-classes").read_bytes().startswith(b"name,comment\r\nNuclearFuel,")
    assert (tmp_path / "graphml").read_text().endswith("</graph>\n</graphml>\n") and (tmp_path / "graphml").read_text().startswith("<?xml")
    assert "\n- **U10Mo_fuel** → NuclearFuel\n" in (tmp_path / "markdown").read_text()
    assert cli.main([], spark) == 0 and "usage" in capsys.readouterr().out
    for args in (["stats", "-v"], ["query", "fuel", "-n", "1"], ["query", "--class", "NuclearFuel"], ["query", "--property", "density=17", "--output", str(tmp_path / "q")], ["query", "--hierarchy", "Material"], ["validate"], ["validate", "--quick"]):
        assert cli.main(["--ontology", path, *args], spark) == 0
    out = capsys.readouterr().out
    assert "NuclearFuel: 2" in out and "... and 2 more" in out and "healthy: True" in out and "█" in out
    table = str(tmp_path / "table")
    assert sinks.insert(spark.range(3), table) == 3
    sinks.delete(spark, table, "id = 1")
    assert sorted(r.id for r in sinks.select(spark, table).collect()) == [0, 2]
    assert sinks.save(spark, spark.range(1), table) and sinks.select(spark, table, "id = 0").count() == 1
    assert load_rows(spark, put(files, "rows.json", [{"a": 1}, {"a": 2}])).count() == 2 and load_rows(spark, put(files, "row.json", {"a": 1})).count() == 1


def test_scalar_functions(spark):
    df = spark.createDataFrame([("\x1c  a-B_c \n", 0.35, "tide", "diet")], "s string, x double, a string, b string")
    r = df.select(fn.strip(F.col("s")), fn.normalized_key(F.col("s")), fn.rounded(F.col("x")), fn.printed(F.lit(1e16)), fn.similarity(F.col("a"), F.col("b")), fn.similarity(F.col("b"), F.col("a")), fn.truncated(F.lit("abcdef"), 3), fn.bar(F.lit(50)), fn.line_count(F.lit("a\nb"))).first()
    assert tuple(r) == ("a-B_c", "abc", 0.3, "1e+16", 0.25, 0.5, "abc…", "█" * 10 + "░" * 10, 2)


def greedy(rows, threshold=0.85):
    """(pos, key, value) -> the fold over all rows in order: (pos, key, value, n_merged) with latest."""
    like = lambda a, b: a == b or SequenceMatcher(None, a, b).ratio() >= threshold
    slots, at = [], {}
    for r in rows:
        k = r[1].strip().lower()
        match = next((s for s in at if like(k, s)), None)
        if match is None:
            at[k] = len(slots)
            slots.append([r[0], r, 0])
            continue
        slots[at[match]][2] += 1
        hit = next((s for s in slots if like(s[1][1].strip().lower(), match)), None)
        if hit:
            hit[1] = r
    return sorted((first, r[1], r[2], n) for first, r, n in slots)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 1.0])
def test_fuzzy_against_a_fold_over_all_rows(spark, threshold):
    rng = random.Random(int(threshold * 100))
    rows = [(i, "".join(rng.choice("abcA ") for _ in range(rng.randint(1, 8))) + rng.choice(["", " alloy"]), str(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, name string, source string").repartition(5)
    got = sorted((r.pos, r.name, r.source, r.n_merged) for r in merge.dedup_fuzzy(df, threshold=threshold).collect())
    assert got == greedy(rows, threshold)


def test_fuzzy_query_takes_all_rows(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.p_partkey, r.p_name, r.p_brand) for r in spark.read.parquet(f"{d}/part.parquet").collect())
    got = sorted((r.pos, r.name, r.source, r.n_merged) for r in catalog.QUERIES["m03_dedup_fuzzy"](spark, d).collect())
    assert got == greedy(rows) and sum(r[3] + 1 for r in got) == len(rows)


def test_fuzzy_with_all_conflict_rules(spark):
    rows = [("U-10Mo alloy", {"x": "1"}), ("U-10Mo Alloyy", {"y": "2", "x": "3"}), ("Zr", {"z": "4"}), ("u-10mo alloy", {"y": "5", "w": "6"})]
    assert merged(spark, rows, strategy="fuzzy") == [("u-10mo alloy", {"y": "5", "w": "6"}), ("Zr", {"z": "4"})]
    assert merged(spark, rows, strategy="fuzzy", conflict="priority") == [rows[0], rows[2]]
    assert merged(spark, rows, strategy="fuzzy", conflict="merge", attrs="attrs") == [("U-10Mo alloy", {"x": "1", "y": "2", "w": "6"}), rows[2]]


def same(a, b):
    key = lambda df: sorted(map(str, df.collect()))
    return all(key(getattr(a, c)) == key(getattr(b, c)) for c in ("classes", "object_properties", "datatype_properties", "individuals"))


def test_json_round_trip(spark, o2, files, tmp_path):
    odd = load_ontology(spark, put(files, "odd.json", {"classes": {}, "individuals": [{"name": 'a "quoted"\n, name', "class": ["x"], "n": 1e-5, "b": False, "none": None, "deep": {"k": [1, "é"]}}, {"x": "1,5"}, {}]}))
    for i, o in enumerate((o2, odd)):
        path = str(tmp_path / f"{i}.json")
        assert sinks.export_json(o, path) == len((tmp_path / f"{i}.json").read_bytes())
        assert json.loads((tmp_path / f"{i}.json").read_text())["individuals"] and same(load_ontology(spark, path), o)
    assert sinks.save_ontology(odd, path) and same(load_ontology(spark, path), odd) and len(list(tmp_path.glob("1.json.backup_*"))) == 1


def test_results_follow_the_relation_first(spark, o2):
    got, more = query.displayed(query.search(o2, "l"), 3)
    assert [(r.match_type, r.pos) for r in got.collect()] == [("class", 0), ("class", 1), ("class", 2)] and more == 3
    assert [r.relation for r in query.displayed(query.hierarchy(o2, "Material"))[0].collect()] == ["class", "child"]


def test_update_targets_and_totals(spark):
    have = items(spark, [("a", {}), ("b", {})])
    props = spark.createDataFrame([(0, None, "b", "m", "1"), (1, "", "b", "m", "2"), (2, None, None, "m", "3")], "pos long, individual string, source string, name string, value string")
    attrs = lambda df: [r.attrs for r in df.orderBy("pos").collect()]
    assert attrs(update.add_properties(have, props)) == [{}, {"prop_m": "1"}] and tuple(update.property_stats(have, props).first()) == (1, 2)
    assert attrs(update.add_properties(have, props, "a")) == [{"prop_m": "3"}, {}]
    new = items(spark, [("a", {"x": "1"}), ("", {})])
    assert update.add_individuals(have, new, dedup=False).count() == 3 and update.changes(have, new, dedup=False).count() == 1
    assert tuple(update.totals(update.update_stats(have, new), update.update_stats(have, new, False), update.property_stats(have, props)).first()) == (1, 1, 4, 1)


def test_properties_are_told_apart_as_printed(spark):
    rows = [(0, "n", "a_b", "c"), (1, "n", "a", "b_c"), (2, "n", "a", "b_d")]
    props = spark.createDataFrame(rows, "pos long, name string, value string, unit string")
    assert sorted(r.pos for r in merge.merge_properties(props).collect()) == [0, 2]
    numbers = spark.createDataFrame([(0, "n", 1e16, "u"), (1, "n", 1e16, "u"), (2, None, 1.0, None)], "pos long, name string, value double, unit string")
    assert sorted(r.pos for r in merge.merge_properties(numbers).collect()) == [0, 2]


def test_streams_go_on(spark, tmp_path):
    from veinmap.streaming import incremental

    folder = str(tmp_path / "state")
    incremental.start(items(spark, [(f"n{i}", {}) for i in range(300)]), folder)
    for i in range(2):  # each with a checkpoint of its own
        items(spark, [(f"s{i}", {}), ("n5", {f"k{i}": "1"})]).write.parquet(str(tmp_path / f"in{i}"))
        stream = spark.readStream.schema(incremental.COLUMNS).parquet(str(tmp_path / f"in{i}"))
        for _ in range(2):  # a stream that is started again applies nothing twice
            incremental.follow(stream, folder, str(tmp_path / f"checkpoint{i}")).awaitTermination()
    rows = [(r.name, r.attrs) for r in incremental.current(spark, folder).collect()]
    assert len(rows) == 302 and dict(rows)["n5"] == {"k0": "1", "k1": "1"} and {"s0", "s1"} <= set(dict(rows))
    touched = [len(list(v.glob("bucket=*"))) for v in (tmp_path / "state").glob("version=*-*-*")]
    assert len(touched) == 2 and max(touched) <= 2
    incremental.compact(spark, folder)
    assert sorted(map(str, incremental.current(spark, folder).collect())) == sorted(map(str, [r for r in incremental.current(spark, folder).collect()])) and incremental.current(spark, folder).count() == 302
    assert not [p for p in links._made if "/judged-" in p]
    before = sorted(map(str, incremental.current(spark, folder).collect()))
    assert len(incremental.vacuum(spark, folder)) == 3 and incremental.vacuum(spark, folder) == []
    assert sorted(map(str, incremental.current(spark, folder).collect())) == before
