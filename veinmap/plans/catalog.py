"""Registered queries over the ontology model, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinmap.functions import text as fn
from veinmap.operators import extract, graph, merge, parts, quality, query, relational, segment, sinks, trigrams, update, vocabulary
from veinmap.operators.links import shared_path
from veinmap.sources import star, tables
from veinmap.sources.ontology import load_graph, load_ontology, load_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The star schema as the model, in SQL.
_CLASSES = """classes AS (
  SELECT CAST(r_regionkey AS BIGINT) AS pos, r_name AS name, 'region ' || lower(r_name) AS comment, CAST(NULL AS VARCHAR) AS parent FROM region
  UNION ALL SELECT n_nationkey + 100, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'nation of ' || r_name END, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_INDIVIDUALS = """individuals AS (
  SELECT s_suppkey AS pos, s_name AS name, n_name AS class, CAST(NULL AS VARCHAR) AS t1, CAST(NULL AS VARCHAR) AS t2, s_acctbal AS bal, CAST(NULL AS INTEGER) AS size, CAST(NULL AS DOUBLE) AS price FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 1000000000 + c_custkey, c_name, n_name, c_mktsegment, NULL, c_acctbal, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 2000000000 + p_partkey, p_name || '_' || p_partkey, NULL, p_type, p_brand, NULL, p_size, p_retailprice FROM part)"""
_GRAPH = """nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, 'class' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'class' FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'individual' FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'individual' FROM supplier),
edges AS (
  SELECT CAST(n_nationkey AS BIGINT) AS pos, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'within' AS type FROM nation
  UNION ALL SELECT 1000000000 + c_custkey, 'c' || c_custkey, 'n' || c_nationkey, 'lives_in' FROM customer
  UNION ALL SELECT 2000000000 + s_suppkey, 's' || s_suppkey, 'n' || s_nationkey, 'lives_in' FROM supplier)"""
_TURNS = """turns AS (
  SELECT conv_id, turn, '## ' || role || ' ' || turn || chr(10) || text AS part, role || ' ' || turn AS title, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content,
    coalesce(sum(length('## ' || role || ' ' || turn || chr(10) || text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char,
    length('## ' || role || ' ' || turn || chr(10) || text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM conversations)"""


def _query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@_query("s02_sections", f"WITH {_CLASSES} SELECT pos, name, comment, parent FROM classes")
def _(spark, d):
    return star.ontology(spark, d).classes.select("pos", "name", "comment", F.get("sub_class_of", F.lit(0)).alias("parent"))


@_query("s06_json_rows", "SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value, CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events")
def _(spark, d):
    props = F.from_json("props", "map<string,string>")
    return star.read(spark, d, "events").select("event_id", props.alias("p")).select("event_id", F.get(F.map_values("p"), F.lit(0)).alias("first_value"), F.size("p").alias("n_keys"))


@_query("a01_stats", f"WITH {_CLASSES}, {_INDIVIDUALS} SELECT (SELECT count(*) FROM classes) AS classes, CAST(3 AS BIGINT) AS object_properties, CAST(3 AS BIGINT) AS datatype_properties, (SELECT count(*) FROM individuals) AS individuals")
def _(spark, d):
    return query.stats(star.ontology(spark, d))


@_query("a02_class_distribution", f"WITH {_INDIVIDUALS} SELECT coalesce(class, 'Unknown') AS class, count(*) AS n, min(pos) AS first_pos FROM individuals GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 10")
def _(spark, d):
    return query.class_distribution(star.ontology(spark, d))


@_query("p01_search", f"WITH {_CLASSES}, {_INDIVIDUALS} SELECT 'class' AS match_type, pos, name, comment FROM classes WHERE contains(lower(name), 'an') OR contains(lower(coalesce(comment, '')), 'an') UNION ALL SELECT 'individual', pos, name, NULL FROM individuals WHERE contains(lower(name), 'an')")
def _(spark, d):
    return query.search(star.ontology(spark, d), "AN")


@_query("p02_by_class", f"WITH {_INDIVIDUALS} SELECT pos, name FROM individuals WHERE t2 IS NOT NULL AND lower(t1) = (SELECT lower(min(p_type)) FROM part) UNION ALL SELECT pos, name FROM individuals WHERE t2 IS NOT NULL AND lower(t1) = (SELECT lower(min(p_type)) FROM part)")
def _(spark, d):
    kind = star.read(spark, d, "part").agg(F.min("p_type")).first()[0]
    return query.by_class(star.ontology(spark, d), kind.lower()).select("pos", "name")


@_query("p02_by_direct_class", f"WITH {_INDIVIDUALS} SELECT pos, name FROM individuals WHERE class = (SELECT max(n_name) FROM nation) OR t1 = (SELECT max(n_name) FROM nation)")
def _(spark, d):
    name = star.read(spark, d, "nation").agg(F.max("n_name")).first()[0]
    return query.by_class(star.ontology(spark, d), name.upper()).select("pos", "name")


@_query("p03_by_property", f"WITH {_INDIVIDUALS} SELECT pos, name FROM individuals WHERE contains(CAST(size AS VARCHAR), '7')")
def _(spark, d):
    return query.by_property(star.ontology(spark, d), "size", "7").select("pos", "name")


@_query("p03_by_part_of_property", f"WITH {_INDIVIDUALS} SELECT pos, name FROM individuals WHERE bal IS NOT NULL AND contains(CAST(CAST(floor(bal) AS BIGINT) AS VARCHAR), '99')")
def _(spark, d):
    return query.by_property(star.ontology(spark, d), "EV", "99").select("pos", "name")


@_query("p06_names", f"WITH {_CLASSES} SELECT lower(name) AS key, max(pos) AS pos FROM classes GROUP BY 1")
def _(spark, d):
    return query.name_index(star.ontology(spark, d).classes)


@_query("p09_unpivot_props", f"WITH {_INDIVIDUALS} SELECT name, 'acctbal' AS property_name, bal AS property_value FROM individuals WHERE bal IS NOT NULL UNION ALL SELECT name, 'size', CAST(size AS DOUBLE) FROM individuals WHERE size IS NOT NULL UNION ALL SELECT name, 'retailprice', price FROM individuals WHERE price IS NOT NULL")
def _(spark, d):
    o = star.ontology(spark, d)
    names = relational.materials(o, stamped=False).select(F.col("id").alias("material_id"), "name")
    return relational.material_properties(o).join(names, "material_id").select("name", "property_name", "property_value")


@_query("p10_materials", f"WITH {_INDIVIDUALS} SELECT name, coalesce(class, 'Unknown') AS material_type, coalesce(replace(list_filter(string_split(name, '_'), lambda p: regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[0-9]'))[1], '-', ''), '') AS chemical_formula FROM individuals")
def _(spark, d):
    return relational.materials(star.ontology(spark, d), stamped=False).select("name", "material_type", "chemical_formula")


@_query("p08_filtered_nodes", f"WITH {_GRAPH} SELECT id, name FROM nodes WHERE type = 'individual' AND contains(lower(name), '7')")
def _(spark, d):
    return graph.filtered_nodes(star.graph(spark, d), "individual", "7").select("id", "name")


@_query("k14_restore_stats", f"WITH {_INDIVIDUALS} SELECT count(*) AS materials, CAST(sum(CASE WHEN bal IS NOT NULL THEN 1 ELSE 2 END) AS BIGINT) AS properties, CAST(0 AS BIGINT) AS skipped FROM individuals")
def _(spark, d):
    return relational.restore_stats(star.ontology(spark, d))


@_query("d15_foreign_keys", "SELECT c_custkey AS id, c_nationkey + 5 AS material_id FROM customer WHERE c_nationkey + 5 NOT IN (SELECT n_nationkey FROM nation)")
def _(spark, d):
    return relational.orphans(star.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 5).alias("material_id")), star.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"))).select("id", "material_id")


@_query("j01_hierarchy", f"WITH {_CLASSES} SELECT 'class' AS relation, pos, name FROM classes WHERE lower(name) = 'europe' UNION ALL SELECT 'child', pos, name FROM classes WHERE lower(parent) = 'europe'")
def _(spark, d):
    return query.hierarchy(star.ontology(spark, d), "Europe")


@_query("j01_all_children", f"WITH {_CLASSES} SELECT p.name AS parent, c.pos AS child_pos, c.name AS child FROM classes c JOIN classes p ON lower(c.parent) = lower(p.name)")
def _(spark, d):
    return query.all_children(star.ontology(spark, d))


@_query("j02_membership_edges", f"WITH {_CLASSES}, {_INDIVIDUALS} SELECT pos, name AS source, class AS target FROM individuals WHERE class IN (SELECT name FROM classes)")
def _(spark, d):
    return graph.membership_edges(star.ontology(spark, d))


@_query("j03_induced_subgraph", f"WITH {_GRAPH}, kept AS (SELECT id FROM nodes WHERE contains(lower(name), 'a')) SELECT pos, src AS \"from\", dst AS \"to\", type FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)")
def _(spark, d):
    return graph.induced(star.graph(spark, d), term="A").edges


@_query("j04_neighbours", f"WITH {_GRAPH} SELECT e.pos, src AS \"from\", e.type, coalesce(nullif(n.name, ''), dst) AS to_name FROM edges e LEFT JOIN nodes n ON dst = id")
def _(spark, d):
    return graph.neighbours(star.graph(spark, d))


@_query("a11_degree", f"WITH {_GRAPH}, ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, count(*) AS degree FROM ends GROUP BY id")
def _(spark, d):
    return graph.degrees(star.graph(spark, d))


@_query("a12_graph_counts", f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS relationships")
def _(spark, d):
    return graph.counts(star.graph(spark, d))


@_query("l04_top_edges", f"""WITH {_GRAPH}, b AS (SELECT src AS id, 'out' AS direction, pos, dst AS other FROM edges UNION ALL SELECT dst, 'in', pos, src FROM edges),
r AS (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY pos) AS rank FROM b) SELECT id, direction, CAST(rank AS INTEGER) AS rank, other FROM r WHERE rank <= CASE direction WHEN 'out' THEN 5 ELSE 3 END""")
def _(spark, d):
    return graph.top_edges(star.graph(spark, d))


@_query("a03_a09_quality", f"""WITH {_CLASSES}, {_INDIVIDUALS}, n AS (SELECT (SELECT count(*) FROM classes) AS c, (SELECT count(*) FROM individuals) AS i, (SELECT count(*) FROM classes WHERE parent IS NOT NULL) AS p, (SELECT count(*) FROM classes WHERE comment IS NOT NULL) AS m),
s AS (SELECT CAST(trunc(100 * (1 - 1.0::DOUBLE / (c + 6))) AS INTEGER) AS naming, CAST(trunc(100.0::DOUBLE * p / c) AS INTEGER) AS hierarchy, CAST(50 AS INTEGER) AS semantic, CAST(trunc(100.0::DOUBLE * m / c) AS INTEGER) AS completeness, CAST(greatest(50, least(100, c // 2 + i // 20)) AS INTEGER) AS coverage FROM n),
t AS (SELECT *, CAST((naming + hierarchy + semantic + completeness + coverage) // 5 AS INTEGER) AS total_score FROM s)
SELECT *, CASE WHEN total_score >= 90 THEN 'A+' WHEN total_score >= 80 THEN 'A' WHEN total_score >= 70 THEN 'B' WHEN total_score >= 60 THEN 'C' WHEN total_score >= 50 THEN 'D' ELSE 'F' END AS grade FROM t""")
def _(spark, d):
    return quality.validate(star.ontology(spark, d)).drop("issues")


@_query("p01_indexed_search", f"WITH {_INDIVIDUALS} SELECT pos, name FROM individuals WHERE contains(lower(name), 'idget')")
def _(spark, d):
    own, folder = star.ontology(spark, d).individuals, shared_path(spark, "trigrams")
    trigrams.add(own.where("pos % 3 > 0"), folder, "0")
    trigrams.add(own.where("pos % 3 = 0"), folder, "1")
    return trigrams.search(own, folder, "IDGET").select("pos", "name")


@_query("a09_issues", f"""WITH {_CLASSES}, n AS (SELECT count(*) AS c, count(parent) AS p, count(comment) AS m, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) AS i FROM classes),
s AS (SELECT unnest([('naming', trunc(100 * (1 - 1.0::DOUBLE / (c + 6)))), ('hierarchy', trunc(100.0::DOUBLE * p / c)), ('semantic', 50), ('completeness', trunc(100.0::DOUBLE * m / c)), ('coverage', greatest(50, least(100, c // 2 + i // 20)))]) AS d FROM n),
t AS (SELECT d[1] AS name, CAST(d[2] AS INTEGER) AS score FROM s)
SELECT CASE WHEN score < 70 THEN '⚠️ ' || name || ': ' || score || '/100 — needs improvement' ELSE 'ℹ️ ' || name || ': ' || score || '/100 — good, can improve' END AS issue FROM t WHERE score < 90
UNION ALL SELECT '✅ All dimensions score 90+' WHERE NOT EXISTS (SELECT 1 FROM t WHERE score < 90)""")
def _(spark, d):
    return quality.validate(star.ontology(spark, d)).select(F.explode("issues").alias("issue"))


@_query("a10_quick_check", f"WITH {_INDIVIDUALS} SELECT true AS has_classes, true AS has_individuals, true AS has_properties, round_even((SELECT count(*) FROM individuals) / 30.0::DOUBLE, 1) AS individuals_per_class, 0.2::DOUBLE AS properties_per_class, true AS healthy")
def _(spark, d):
    return quality.quick_check(star.ontology(spark, d))


@_query("w01_sections", f"WITH {_TURNS} SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS index, title, content, CAST(start_char AS INTEGER) AS start_char, CAST(start_char + n + CASE WHEN last THEN 0 ELSE 1 END AS INTEGER) AS end_char FROM turns WHERE content <> ''")
def _(spark, d):
    return segment.segment_headings(star.markdown(spark, d), min_size=0).select("doc_id", "index", "title", "content", "start_char", "end_char")


@_query("w02_folded_sections", f"""WITH RECURSIVE {_TURNS}, t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM turns WHERE content <> ''),
f AS (SELECT conv_id, i, 1 AS g, title, content FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, CASE WHEN length(f.content) < 400 THEN f.g ELSE f.g + 1 END, CASE WHEN length(f.content) < 400 THEN f.title || ' + ' || t.title ELSE t.title END, CASE WHEN length(f.content) < 400 THEN f.content || chr(10) || chr(10) || t.content ELSE t.content END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id AS doc_id, CAST(g - 1 AS INTEGER) AS index, arg_max(title, i) AS title, arg_max(content, i) AS content, CAST(length(arg_max(content, i)) AS INTEGER) AS char_count FROM f GROUP BY conv_id, g""")
def _(spark, d):
    return segment.segment_headings(star.markdown(spark, d), min_size=400).select("doc_id", "index", "title", "content", "char_count")


@_query("w04_fixed_chunks", """WITH RECURSIVE c AS (
  SELECT doc_id, text, length(text) AS n, 0 AS s, CASE WHEN length(text) <= 4000 THEN length(text) ELSE CASE WHEN length(regexp_replace(substr(text, 1, 4000), '[^\\n]*$', '')) - 1 > 2000 THEN length(regexp_replace(substr(text, 1, 4000), '[^\\n]*$', '')) ELSE 4000 END END AS e FROM documents WHERE trim(text) <> ''
  UNION ALL SELECT doc_id, text, n, ns, CASE WHEN n <= ns + 4000 THEN n ELSE CASE WHEN length(regexp_replace(substr(text, ns + 1, 4000), '[^\\n]*$', '')) - 1 > 2000 THEN ns + length(regexp_replace(substr(text, ns + 1, 4000), '[^\\n]*$', '')) ELSE ns + 4000 END END
  FROM (SELECT *, greatest(e - 200, s + 1) AS ns FROM c WHERE e < n))
SELECT doc_id, CAST(s AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char FROM c""".replace("\\\\n", "\\n"))
def _(spark, d):
    return segment.segment_fixed(star.read(spark, d, "documents")).select("doc_id", "start_char", "end_char")


@_query("w05_keyword_windows", """WITH RECURSIVE words(k, keyword) AS (VALUES (0, 'license'), (1, 'than')),
p AS (SELECT doc_id, length(text) AS n, k, keyword, string_split(lower(text), keyword) AS parts FROM documents, words WHERE text IS NOT NULL),
o AS (SELECT doc_id, n, k, keyword, j, len(parts) AS times, length(parts[j]) AS own FROM p, range(1, len(parts) + 1) AS t(j)),
a AS (SELECT *, sum(own) OVER (PARTITION BY doc_id, k ORDER BY j) + (j - 1) * length(keyword) AS place FROM o),
m AS MATERIALIZED (SELECT doc_id, n, keyword, place, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS i FROM a WHERE j < times),
r AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, false AS hit FROM m
  UNION ALL SELECT doc_id, i, CASE WHEN hit THEN list_append(kept, CAST(place AS BIGINT)) ELSE kept END, hit
  FROM (SELECT r.doc_id, m.i, kept, m.place, len(list_filter(kept, lambda s: abs(s - m.place) < 500)) = 0 AS hit FROM r JOIN m ON m.doc_id = r.doc_id AND m.i = r.i + 1))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS index, keyword, CAST(place AS INTEGER) AS match_position, CAST(greatest(0, place - 500) AS INTEGER) AS start_char, CAST(least(n, place + 500) AS INTEGER) AS end_char
FROM r JOIN m USING (doc_id, i) WHERE hit""")
def _(spark, d):
    return segment.segment_keywords(star.read(spark, d, "documents"), ["license", "than"], 500).select("doc_id", "index", "keyword", "match_position", "start_char", "end_char")


@_query("e02_alloys", "SELECT p_partkey AS doc_id, 'U-' || p_size || 'Mo' AS name, CAST(1 AS INTEGER) AS n FROM part")
def _(spark, d):
    return star.reports(spark, d).select("doc_id", extract.alloys(F.col("text")).alias("a")).select("doc_id", F.get("a", F.lit(0))["name"].alias("name"), F.size("a").alias("n"))


@_query("e03_properties", "SELECT p_partkey AS doc_id, 'density' AS name, p_size + 0.5::DOUBLE AS value, 'g/cm3' AS unit FROM part UNION ALL SELECT p_partkey, 'hardness', CAST(p_size AS DOUBLE), 'HV' FROM part")
def _(spark, d):
    return star.reports(spark, d).select("doc_id", F.inline(extract.properties(F.col("text")))).select("doc_id", "name", "value", "unit")


@_query("e04_phases", "SELECT p_partkey AS doc_id, 'γ' AS phase, 'γ phase' AS context FROM part")
def _(spark, d):
    return star.reports(spark, d).select("doc_id", F.inline(extract.phases(F.col("text")))).select("doc_id", "phase", "context")


@_query("e05_temperatures", "SELECT p_partkey AS doc_id, CAST(p_size AS DOUBLE) AS low, CAST(p_size + 100 AS DOUBLE) AS high, 'K' AS unit FROM part")
def _(spark, d):
    return star.reports(spark, d).select("doc_id", F.inline(extract.temperatures(F.col("text")))).select("doc_id", F.col("min").alias("low"), F.col("max").alias("high"), "unit")


@_query("e06_percentages", "SELECT p_partkey AS doc_id, CAST(p_size AS DOUBLE) AS value, 'wt%' AS unit FROM part")
def _(spark, d):
    return star.reports(spark, d).select("doc_id", F.inline(extract.percentages(F.col("text")))).select("doc_id", "value", "unit")


@_query("e08_composition", "SELECT p_partkey AS doc_id, CASE WHEN p_size < 100 THEN CAST(100 - p_size AS DOUBLE) END AS zr, CAST(p_size AS DOUBLE) AS mo FROM part")
def _(spark, d):
    c = extract.composition(F.concat(F.lit("Zr-Mo"), F.col("p_size").cast("string")))
    return star.read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), c["Zr"].alias("zr"), c["Mo"].alias("mo"))


@_query("e09_template", "SELECT p_partkey AS doc_id, 'density' AS name, CAST(p_size AS VARCHAR) || '.5' AS value, CAST(length('The U-' || p_size || 'Mo alloy has ') AS INTEGER) AS position FROM part")
def _(spark, d):
    found = extract.extract_with_template(star.reports(spark, d), {"density": {"patterns": [r"DENSITY:\s*(\d+\.\d+)"]}, "nothing": r"no groups"})
    return found.select("doc_id", "name", F.get("value", F.lit(0)).alias("value"), "position")


@_query("e01_results", "SELECT p_partkey AS doc_id, CAST(1 AS INTEGER) AS individuals, CAST(2 AS INTEGER) AS properties, CAST(1 AS INTEGER) AS relationships, CAST(4 AS INTEGER) AS total_items FROM part")
def _(spark, d):
    return extract.extract(star.reports(spark, d)).select("doc_id", *(F.size(c).alias(c) for c in ("individuals", "properties", "relationships")), "total_items")


_ITEMS = "items AS (SELECT p_partkey AS pos, p_name AS name, p_brand AS source, p_size AS size FROM part)"


@_query("m01_dedup_exact", f"WITH {_ITEMS} SELECT min(pos) AS pos, arg_max(name, pos) AS name, arg_max(source, pos) AS source, count(*) - 1 AS n_merged FROM items GROUP BY lower(trim(name))")
def _(spark, d):
    return merge.dedup(star.results(spark, d)).select("pos", "name", "source", "n_merged")


@_query("m02_dedup_normalized", """WITH i AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '') ELSE replace(p_name, ' ', '-') END AS name, p_brand AS source FROM part),
k AS (SELECT *, regexp_replace(lower(name), '[ _-]', '', 'g') AS k FROM i), s AS (SELECT k, min(pos) FILTER (WHERE lower(name) <> k) AS stop, min(pos) AS first, max(pos) AS last, count(*) - 1 AS n_merged FROM k GROUP BY k)
SELECT first AS pos, k.name, source, n_merged FROM s JOIN k ON k.pos = coalesce(stop, last)""")
def _(spark, d):
    items = star.results(spark, d)
    odd = F.when(F.col("pos") % 3 == 0, F.replace("name", F.lit(" "), F.lit(""))).otherwise(F.replace("name", F.lit(" "), F.lit("-")))
    return merge.dedup(items.withColumn("name", odd), strategy="normalized").select("pos", "name", "source", "n_merged")


#: Of all names in the table, "cold x" and "old x" alone reach a ratio of 0.85, either way.
@_query("m03_dedup_fuzzy", f"WITH {_ITEMS}, k AS (SELECT *, regexp_replace(lower(trim(name)), '^cold ', 'old ') AS k FROM items) SELECT min(pos) AS pos, arg_max(name, pos) AS name, arg_max(source, pos) AS source, count(*) - 1 AS n_merged FROM k GROUP BY k")
def _(spark, d):
    return merge.dedup(star.results(spark, d), strategy="fuzzy").select("pos", "name", "source", "n_merged")


@_query("m05_merge_conflict", f"WITH {_ITEMS} SELECT min(pos) AS pos, arg_min(name, pos) AS name, CAST(arg_min(size, pos) AS VARCHAR) AS size, CAST(count(DISTINCT source) + 1 AS INTEGER) AS n_attrs FROM items GROUP BY lower(trim(name))")
def _(spark, d):
    return merge.dedup(star.results(spark, d), conflict="merge", attrs="attrs").select("pos", "name", F.col("attrs")["size"].alias("size"), F.size("attrs").alias("n_attrs"))


@_query("m06_dedup_priority", f"WITH {_ITEMS} SELECT min(pos) AS pos, arg_min(source, pos) AS source FROM items GROUP BY lower(trim(name))")
def _(spark, d):
    return merge.dedup(star.results(spark, d), conflict="priority").select("pos", "source")


@_query("a16_merge_properties", """WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS pos, l_returnflag || l_linestatus AS name, CAST(l_quantity AS BIGINT) AS value, l_returnflag AS unit FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY name, value, unit ORDER BY pos) AS n, min(pos) OVER (PARTITION BY name) AS name_pos FROM p) SELECT pos, name, value, unit, name_pos FROM r WHERE n = 1""")
def _(spark, d):
    rows = star.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_quantity").cast("long").alias("value"), F.col("l_returnflag").alias("unit"))
    return merge.merge_properties(rows)


@_query("a13_merge_stats", f"WITH {_ITEMS}, n AS (SELECT count(DISTINCT source) AS inputs, count(*) AS individuals_in, count(DISTINCT lower(trim(name))) AS final_individuals FROM items) SELECT inputs, individuals_in, individuals_in - final_individuals AS duplicates_removed, final_individuals, round((individuals_in - final_individuals) / individuals_in::DOUBLE * 100, 1) AS dedup_rate FROM n")
def _(spark, d):
    items = star.results(spark, d)
    return merge.merge_stats(items, merge.dedup(items)).select("inputs", "individuals_in", "duplicates_removed", "final_individuals", "dedup_rate")


def _existing(spark, d):
    items = star.results(spark, d).select("pos", F.concat("name", F.lit(" "), F.col("attrs")["size"]).alias("name"), "attrs")
    return items.where("pos % 2 = 0").withColumn("attrs", F.map_filter("attrs", lambda k, v: k == "size")), items


_UPDATE = """i AS (SELECT p_partkey AS pos, p_name || ' ' || p_size AS name, p_brand AS brand FROM part), e AS (SELECT * FROM i WHERE pos % 2 = 0),
b AS (SELECT name, brand, min(pos) AS pos FROM i WHERE name IN (SELECT name FROM e) GROUP BY 1, 2),
a AS (SELECT i.*, CASE WHEN name NOT IN (SELECT name FROM e) THEN 'add' WHEN EXISTS (SELECT 1 FROM b WHERE b.name = i.name AND b.pos = i.pos) THEN 'update' ELSE 'skip' END AS action FROM i)"""


@_query("n01_update_actions", f"WITH {_UPDATE} SELECT pos, name, action FROM a")
def _(spark, d):
    existing, items = _existing(spark, d)
    return update.judged(existing, items).select("pos", "name", "action")


@_query("n01_updated_individuals", f"""WITH {_UPDATE}, f AS (SELECT name, min(pos) AS pos FROM e GROUP BY 1), n AS (SELECT name, count(DISTINCT brand) AS n FROM i GROUP BY 1)
SELECT e.pos, e.name, CAST(CASE WHEN f.pos IS NULL THEN 1 ELSE 1 + n.n END AS INTEGER) AS n_attrs FROM e LEFT JOIN f ON e.pos = f.pos JOIN n ON n.name = e.name UNION ALL SELECT pos, name, CAST(2 AS INTEGER) FROM a WHERE action = 'add'""")
def _(spark, d):
    existing, items = _existing(spark, d)
    return update.add_individuals(existing, items).select("pos", "name", F.size("attrs").alias("n_attrs"))


@_query("a14_update_stats", f"WITH {_UPDATE} SELECT count(*) FILTER (WHERE action = 'add') AS added_individuals, count(*) FILTER (WHERE action = 'update') AS updated_individuals, count(*) FILTER (WHERE action = 'skip') AS skipped_individuals FROM a")
def _(spark, d):
    return update.update_stats(*_existing(spark, d))


@_query("n02_add_properties", f"WITH {_UPDATE}, f AS (SELECT name, min(pos) AS pos FROM e GROUP BY 1), p AS (SELECT name, arg_max(pos, pos) AS v FROM i WHERE pos % 3 = 0 GROUP BY 1) SELECT e.pos, CAST(CASE WHEN f.pos = e.pos THEN p.v END AS VARCHAR) AS mass FROM e LEFT JOIN f ON f.pos = e.pos LEFT JOIN p ON p.name = e.name")
def _(spark, d):
    existing, items = _existing(spark, d)
    props = items.where("pos % 3 = 0").select("pos", F.col("name").alias("individual"), F.lit("mass").alias("name"), F.col("pos").cast("string").alias("value"))
    return update.add_properties(existing, props).select("pos", F.col("attrs")["prop_mass"].alias("mass"))


@_query("n03_changes", f"WITH {_UPDATE} SELECT 'add' AS action, 'individual' AS type, name FROM a WHERE action = 'add'")
def _(spark, d):
    return update.changes(*_existing(spark, d), stamped=False)


@_query("k03_csv_individuals", f"WITH {_INDIVIDUALS} SELECT pos, name, coalesce(class, '') AS class, coalesce(t1, '') AS type FROM individuals")
def _(spark, d):
    return sinks.csv_individuals(star.ontology(spark, d))


_GRAPHML = f"""WITH {_CLASSES}, {_INDIVIDUALS} SELECT '<node id="' || translate(name, ' /', '__') || '"><data key="label">' || name || '</data><data key="type">class</data></node>' AS line FROM classes
UNION ALL SELECT '<node id="' || translate(name, ' /', '__') || '"><data key="label">' || name || '</data><data key="type">individual</data></node>' FROM individuals
UNION ALL SELECT '<edge source="' || translate(name, ' /', '__') || '" target="' || translate(class, ' /', '__') || '"/>' FROM individuals WHERE class IS NOT NULL
UNION ALL SELECT * FROM (VALUES ('<?xml version="1.0" encoding="UTF-8"?>'), ('<graphml xmlns="http://graphml.graphstruct.org/graphml">'), ('<key id="label" for="node" attr.name="label" attr.type="string"/>'), ('<key id="type" for="node" attr.name="type" attr.type="string"/>'), ('<graph id="ontology" edgedefault="directed">'), ('</graph>'), ('</graphml>'))"""


@_query("k06_graphml", _GRAPHML)
def _(spark, d):
    return sinks.graphml_lines(star.ontology(spark, d)).select("line")


@_query("k06_graphml_lines_of_file", _GRAPHML)
def _(spark, d):
    return spark.read.text(_exported(spark, sinks.export_lines, sinks.graphml_lines(star.ontology(spark, d)))).select(F.col("value").alias("line"))


@_query("k07_markdown", f"""WITH {_CLASSES}, {_INDIVIDUALS} SELECT '- **' || name || '**' || CASE WHEN comment IS NULL THEN '' ELSE ': ' || comment END AS line FROM classes
UNION ALL (SELECT '- **' || name || '**' || CASE WHEN class IS NULL THEN '' ELSE ' → ' || class END FROM individuals ORDER BY pos LIMIT 50)
UNION ALL SELECT '- ... and ' || (count(*) - 50) || ' more' FROM individuals
UNION ALL SELECT '**Classes**: ' || count(*) FROM classes UNION ALL SELECT '**Individuals**: ' || count(*) FROM individuals
UNION ALL SELECT * FROM (VALUES ('# Ontology report'), (''), ('**Object Properties**: 3'), ('**Datatype Properties**: 3'), (''), ('## Classes'), (''), (''), ('## Individuals'), (''))""")
def _(spark, d):
    return sinks.markdown_lines(star.ontology(spark, d)).select("line")


@_query("f_scalar_functions", """SELECT p_partkey, lower(trim(p_name)) AS exact_key, regexp_replace(lower(trim(p_name)), '[ _-]', '', 'g') AS normalized_key, translate(p_type, ' /', '__') AS safe_id,
CASE WHEN length(p_name) > 6 THEN substr(p_name, 1, 6) || '…' ELSE p_name END AS short, CASE WHEN p_size >= 90 THEN 'A+' WHEN p_size >= 80 THEN 'A' WHEN p_size >= 70 THEN 'B' WHEN p_size >= 60 THEN 'C' WHEN p_size >= 50 THEN 'D' ELSE 'F' END AS grade,
repeat('█', p_size * 20 // 100) || repeat('░', 20 - p_size * 20 // 100) AS bar FROM part""")
def _(spark, d):
    p = star.read(spark, d, "part")
    return p.select("p_partkey", fn.exact_key(F.col("p_name")).alias("exact_key"), fn.normalized_key(F.col("p_name")).alias("normalized_key"), fn.safe_id(F.col("p_type")).alias("safe_id"), fn.truncated(F.col("p_name"), 6).alias("short"), fn.grade(F.col("p_size")).alias("grade"), fn.bar(F.col("p_size")).alias("bar"))


@_query("s04_graph_nodes", f"WITH {_GRAPH} SELECT id, name, type FROM nodes")
def _(spark, d):
    return star.graph(spark, d).nodes


@_query("s08_counts", "SELECT 'customer.parquet' AS name, count(*) AS n FROM customer UNION ALL SELECT 'part.parquet', count(*) FROM part UNION ALL SELECT 'supplier.parquet', count(*) FROM supplier UNION ALL SELECT 'nothing', 0")
def _(spark, d):
    return tables.counts(spark, d, ["customer.parquet", "part.parquet", "supplier.parquet", "nothing"])


@_query("s07_selected_rows", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 AND p_size < 40 AND p_type LIKE '%A%' AND lower(p_name) LIKE '%ring%' AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#21', 'Brand#13')")
def _(spark, d):
    where = {"p_type": ("like", "%A%"), "p_name": ("ilike", "%RING%"), "p_brand": ("in", ["Brand#11", "Brand#22", "Brand#33", "Brand#21", "Brand#13"]), "p_size": ("gte", 10)}
    return tables.select(spark, d, "part.parquet", where, ["p_partkey", "p_name", "p_size"]).where(tables.condition({"p_size": ("lt", 40)}))


@_query("s11_page_texts", "SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_chars, CAST(len(regexp_extract_all(html, '<h1[^>]*>')) AS INTEGER) AS n_headings FROM pages")
def _(spark, d):
    bare = F.regexp_replace("html", "<[^>]*>", "")
    return star.read(spark, d, "pages").select("page_id", F.length(bare).cast("long").alias("n_chars"), F.regexp_count("html", F.lit("<h1[^>]*>")).alias("n_headings"))


@_query("k02_csv_classes", f"WITH {_CLASSES} SELECT pos, name, coalesce(comment, '') AS comment FROM classes")
def _(spark, d):
    return sinks.csv_classes(star.ontology(spark, d))


@_query("k04_csv_properties", "SELECT * FROM (VALUES (0::BIGINT, 'locatedIn', 'supplier', 'nation'), (1, 'buysFrom', 'customer', ''), (2, 'partOf', '', '')) AS t(pos, name, domain, range)")
def _(spark, d):
    return sinks.csv_properties(star.ontology(spark, d))


@_query("p04_search_classes", f"WITH {_CLASSES} SELECT 'class' AS match_type, pos, name, comment FROM classes WHERE contains(lower(name), 'eur') OR contains(lower(coalesce(comment, '')), 'eur')")
def _(spark, d):
    return query.search(star.ontology(spark, d), "eur", "classes")


@_query("p07_first_class", f"WITH {_INDIVIDUALS} SELECT pos, coalesce(class, 'Unknown') AS class FROM individuals")
def _(spark, d):
    return star.ontology(spark, d).individuals.select("pos", fn.first_class(F.col("class")).alias("class"))


@_query("p11_table_columns", "SELECT * FROM (VALUES ('materials', 6, 1), ('material_properties', 10, 2), ('material_composition', 5, 2), ('literature_sources', 7, 1), ('irradiation_behavior', 8, 1)) AS t(name, n_columns, n_required)")
def _(spark, d):
    return spark.createDataFrame([(t, len(f), sum(x.required for x in f)) for t, (f, _) in relational.TABLES.items()], "name string, n_columns int, n_required int")


@_query("p13_panel", "SELECT c_custkey, 2 AS n_shown FROM customer")
def _(spark, d):
    c = star.read(spark, d, "customer").select("c_custkey", F.create_map(F.lit("name"), F.col("c_name"), F.lit("_x"), F.col("c_mktsegment"), F.lit("segment"), F.col("c_mktsegment")).alias("fields"))
    return graph.panel(c).select("c_custkey", F.size("fields").alias("n_shown"))


@_query("l02_display_limit", f"WITH {_INDIVIDUALS} SELECT pos, name FROM individuals WHERE contains(lower(name), '7') ORDER BY pos LIMIT 20")
def _(spark, d):
    return query.displayed(query.search(star.ontology(spark, d), "7", "individuals"), 0)[0].select("pos", "name")


@_query("u03_all_properties", "SELECT name FROM (VALUES ('locatedIn'), ('buysFrom'), ('partOf'), ('acctbal'), ('size'), ('')) AS t(name)")
def _(spark, d):
    o = star.ontology(spark, d)
    return o.object_properties.select("name").union(o.datatype_properties.select("name"))


@_query("e10_class_names", f"WITH {_CLASSES} SELECT DISTINCT name FROM classes")
def _(spark, d):
    return star.ontology(spark, d).classes.select(query.class_label().alias("name")).distinct()


@_query("e07_classified_names", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'density' WHEN 1 THEN 'melting_point' WHEN 2 THEN 'thermal_conductivity' ELSE NULL END AS property FROM part""")
def _(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("mass density", "the melting point", "thickness", "size"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return star.read(spark, d, "part").select("p_partkey", extract.classify(name).alias("property"))


@_query("a17_existing_names", f"WITH {_INDIVIDUALS} SELECT DISTINCT name FROM individuals")
def _(spark, d):
    return star.ontology(spark, d).individuals.select("name").distinct()


@_query("m07_dedup_relationships", "SELECT min(p_partkey) AS pos, arg_max(p_type, p_partkey) AS context, count(*) - 1 AS n_merged FROM part GROUP BY lower(p_type)")
def _(spark, d):
    rel = star.read(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.lit("phase").alias("type"), F.col("p_type").alias("context"))
    return merge.dedup(rel, "context").select("pos", "context", "n_merged")


@_query("m08_full_merge", "SELECT lower('U-' || p_size || 'Mo') AS key, count(*) - 1 AS n_merged FROM part GROUP BY 1")
def _(spark, d):
    individuals, _, _ = merge.merge_results(extract.extract(star.reports(spark, d)))
    return individuals.select(F.lower("name").alias("key"), "n_merged")


@_query("m08_named_sources", """WITH i AS (SELECT 'paper-' || p_partkey AS source, 'U-' || p_size || 'Mo' AS name FROM part)
SELECT min(source) AS first_source, max(source) AS source, arg_max(name, source) AS name, count(*) - 1 AS n_merged FROM i GROUP BY lower(name)""")
def _(spark, d):
    papers = star.reports(spark, d).withColumn("doc_id", F.concat(F.lit("paper-"), "doc_id"))
    individuals, _, _ = merge.merge_results(extract.extract(papers))
    return individuals.select(F.col("pos")["source"].alias("first_source"), "source", "name", "n_merged")


@_query("m08_merged_properties", "SELECT 'density' AS name, p_size + 0.5::DOUBLE AS value FROM part GROUP BY p_size UNION ALL SELECT 'hardness', CAST(p_size AS DOUBLE) FROM part GROUP BY p_size")
def _(spark, d):
    _, properties, _ = merge.merge_results(extract.extract(star.reports(spark, d)))
    return properties.select("name", "value")


@_query("p12_merge_record", f"WITH {_ITEMS}, n AS (SELECT count(DISTINCT source) AS i, count(*) AS a, count(DISTINCT lower(trim(name))) AS f FROM items) SELECT i AS input_results, a AS total_individuals_in, a - f AS duplicates_removed, CAST(0 AS BIGINT) AS conflicts_resolved, f AS final_individuals, CAST(0 AS BIGINT) AS final_properties, round((a - f) / a::DOUBLE * 100, 1) AS dedup_rate FROM n")
def _(spark, d):
    items = star.results(spark, d)
    return merge.stats_record(merge.merge_stats(items, merge.dedup(items)))


#: Keywords of properties, and words that the documents do have.
_WORDS = sorted({w for own in extract.KEYWORDS.values() for w in own} | {"license", "than", "the"})


@_query("e07_keyword_mentions", "WITH w(name) AS (VALUES " + ", ".join("('" + w.replace("'", "''") + "')" for w in _WORDS) + """),
t AS (SELECT doc_id, lower(text) AS text FROM documents)
SELECT doc_id, name, CAST((length(text) - length(replace(text, name, ''))) // length(name) AS BIGINT) AS n, CAST(strpos(text, name) - 1 AS BIGINT) AS first FROM t, w WHERE contains(text, name)""")
def _(spark, d):
    return vocabulary.mentions(star.read(spark, d, "documents"), _WORDS, lowered=True)


@_query("e10_class_mentions", f"""WITH {_CLASSES}, o AS (SELECT o_orderkey AS doc_id, 'from ' || n_name || '_' || r_name || ' to ' || r_name || ', ' || n_name AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT doc_id, name, CAST((length(text) - length(replace(text, name, ''))) // length(name) AS BIGINT) AS n FROM o, (SELECT DISTINCT name FROM classes) WHERE contains(text, name)""")
def _(spark, d):
    own = star.ontology(spark, d)
    orders, customer, nation, region = (star.read(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    lived = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    text = F.concat(F.lit("from "), "n_name", F.lit("_"), "r_name", F.lit(" to "), "r_name", F.lit(", "), "n_name").alias("text")
    docs = orders.join(lived, orders.o_custkey == lived.c_custkey).select(F.col("o_orderkey").alias("doc_id"), text)
    return vocabulary.mentions(docs, vocabulary.vocabulary(own.classes)).select("doc_id", "name", "n")


@_query("k13_insert_errors", """WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_partkey % 97 <> 0 THEN CAST(l_orderkey * 4 + l_linenumber % 3 AS VARCHAR) END AS id, CAST(l_partkey AS VARCHAR) AS material_id, CASE WHEN l_suppkey % 5 <> 0 THEN l_returnflag END AS property_name FROM lineitem),
f AS (SELECT id, min(pos) AS first FROM m WHERE id IS NOT NULL GROUP BY id), p AS (SELECT CAST(p_partkey AS VARCHAR) AS material_id FROM part WHERE p_size > 10)
SELECT pos, array_to_string(list_filter([CASE WHEN m.id IS NULL THEN 'null: id' END, CASE WHEN property_name IS NULL THEN 'null: property_name' END, CASE WHEN pos <> first THEN 'duplicate: id' END, CASE WHEN p.material_id IS NULL THEN 'no parent: material_id' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM m LEFT JOIN f USING (id) LEFT JOIN p ON p.material_id = m.material_id""")
def _(spark, d):
    line, part = star.read(spark, d, "lineitem"), star.read(spark, d, "part")
    rows = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_partkey") % 97 != 0, (F.col("l_orderkey") * 4 + F.col("l_linenumber") % 3).cast("string")).alias("id"), F.col("l_partkey").cast("string").alias("material_id"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_returnflag")).alias("property_name"))
    parents = part.where("p_size > 10").select(F.col("p_partkey").cast("string").alias("id"))
    return relational.routed("material_properties", rows, "pos", parents={"material_id": parents}).select("pos", F.array_join("reasons", "; ").alias("reasons"))


@_query("n02_property_stats", f"WITH {_UPDATE} SELECT count(*) FILTER (WHERE name IN (SELECT name FROM e)) AS added_properties, count(*) FILTER (WHERE name NOT IN (SELECT name FROM e)) AS skipped_individuals FROM i WHERE pos % 3 = 0")
def _(spark, d):
    existing, items = _existing(spark, d)
    return update.property_stats(existing, items.where("pos % 3 = 0").select("pos", F.col("name").alias("individual"), F.lit("mass").alias("name"), F.lit("1").alias("value")))


@_query("f06_text_measures", "SELECT doc_id, CAST(length(text) AS INTEGER) AS char_count, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS line_count FROM documents")
def _(spark, d):
    return star.read(spark, d, "documents").select("doc_id", fn.char_count(F.col("text")).alias("char_count"), fn.line_count(F.col("text")).alias("line_count"))


@_query("f13_similarity", None)
def _(spark, d):
    return star.read(spark, d, "part").select("p_partkey", fn.similarity(F.lower("p_name"), F.lower("p_type")).alias("ratio"))


#: What the extraction patterns accept, in DuckDB's dialect (leftmost matches; ASCII word borders).
_RE_ALLOY = r"\b[A-Z][a-z]?(?:-\d+\.?\d*(?:[A-Z][a-z]?)?)+\b"
_RE_FACT = r"([\pL\pN_\s]+?)(?:[:=]\s*| is\s+| of\s+)(\d+\.?\d*)\s*([°%/³²·\pL\pN_]+)"
_RE_RANGE = r"(\d+\.?\d*)\s*[–-]\s*(\d+\.?\d*)\s*(°[CF]|K)"
_NAMED = "CASE " + " ".join(f"WHEN {' OR '.join('contains(raw, ' + chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) + ')' for w in words)} THEN '{prop}'" for prop, words in extract.KEYWORDS.items()) + " END"
_LONG = "long AS (SELECT doc_id, coalesce(text, '') || '. The U-' || (doc_id % 90 + 1) || 'Mo alloy has density: ' || doc_id || '.5 g/cm3, hardness is ' || doc_id || ' HV from 25–' || doc_id || ' K. ' || coalesce(text, '') AS text FROM documents)"
_FACTS = f"""{_LONG},
m AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_RE_FACT}', 0)) AS context FROM long),
p AS (SELECT *, lower(trim(regexp_extract(context, '{_RE_FACT}', 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS raw, CAST(regexp_extract(context, '{_RE_FACT}', 2) AS DOUBLE) AS value, regexp_extract(context, '{_RE_FACT}', 3) AS unit FROM m),
facts AS (SELECT * FROM (SELECT doc_id, {_NAMED} AS name, value, unit, raw AS raw_name, context FROM p) WHERE name IS NOT NULL)"""
_ALLOYS = f"alloys AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_RE_ALLOY}', 0)) AS name FROM long) WHERE length(name) >= 3)"


@_query("p12_extraction_records", f"""WITH {_FACTS}, {_ALLOYS} SELECT CAST(doc_id AS VARCHAR) AS source, 'rule-based' AS method, CAST(length(text) AS INTEGER) AS text_length, CAST(len(regexp_extract_all(text, '{_RE_RANGE}', 0)) AS INTEGER) AS n_ranges, (SELECT string_agg(name, ',' ORDER BY name) FROM alloys a WHERE a.doc_id = d.doc_id) AS alloys, (SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM facts f WHERE f.doc_id = d.doc_id) AS properties FROM long d""")
def _(spark, d):
    r = extract.records(extract.extract(star.long_reports(spark, d)))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["name"]))), ",")
    return r.select("source", "metadata.method", "metadata.text_length", F.size("metadata.temperature_ranges").alias("n_ranges"), names("individuals").alias("alloys"), names("properties").alias("properties"))


@_query("e02_documents", f"WITH {_LONG}, {_ALLOYS} SELECT * FROM alloys")
def _(spark, d):
    return star.long_reports(spark, d).select("doc_id", F.explode(extract.alloys(F.col("text"))).alias("a")).select("doc_id", "a.name")


@_query("e03_documents", f"WITH {_FACTS} SELECT * FROM facts")
def _(spark, d):
    return star.long_reports(spark, d).select("doc_id", F.inline(extract.properties(F.col("text"))))


@_query("e05_documents", f"WITH {_LONG} SELECT doc_id, regexp_extract(m, '{_RE_RANGE}', 3) AS unit, CAST(regexp_extract(m, '{_RE_RANGE}', 1) AS DOUBLE) AS low, CAST(regexp_extract(m, '{_RE_RANGE}', 2) AS DOUBLE) AS high FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_RE_RANGE}', 0)) AS m FROM long)")
def _(spark, d):
    return star.long_reports(spark, d).select("doc_id", F.inline(extract.temperatures(F.col("text")))).select("doc_id", "unit", F.col("min").alias("low"), F.col("max").alias("high"))


@_query("e01_documents", f"WITH {_FACTS}, {_ALLOYS} SELECT doc_id, CAST((SELECT count(*) FROM alloys a WHERE a.doc_id = d.doc_id) AS INTEGER) AS individuals, CAST((SELECT count(*) FROM facts f WHERE f.doc_id = d.doc_id) AS INTEGER) AS properties, CAST(length(text) AS INTEGER) AS text_length FROM long d")
def _(spark, d):
    return extract.extract(star.long_reports(spark, d)).select("doc_id", *(F.size(c).alias(c) for c in ("individuals", "properties")), "text_length")


@_query("a13_full_merge_stats", f"""WITH {_ITEMS}, n AS (SELECT count(DISTINCT source) AS inputs, count(*) AS individuals_in, count(DISTINCT lower(trim(name))) AS final_individuals FROM items),
p AS (SELECT count(*) AS properties_in, count(DISTINCT p_brand || ' ' || p_size) AS final_properties FROM part), r AS (SELECT count(*) AS relationships_in, count(DISTINCT lower(p_type)) AS final_relationships FROM part)
SELECT *, individuals_in - final_individuals + relationships_in - final_relationships AS duplicates_removed, round((individuals_in - final_individuals + relationships_in - final_relationships) / individuals_in::DOUBLE * 100, 1) AS dedup_rate FROM n, p, r""")
def _(spark, d):
    items, part = star.results(spark, d), star.read(spark, d, "part")
    props = part.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("name"), F.col("p_size").alias("value"), F.lit("mm").alias("unit"))
    rel = part.select(F.col("p_partkey").alias("pos"), F.lit("phase").alias("type"), F.col("p_type").alias("context"))
    return merge.merge_stats(items, merge.dedup(items), rel, merge.dedup(rel, "context"), properties=props, merged_properties=merge.merge_properties(props))


@_query("a14_total_stats", f"WITH {_UPDATE} SELECT count(*) FILTER (WHERE action = 'add') + (SELECT count(*) FROM i) AS added_individuals, count(*) FILTER (WHERE action = 'update') AS updated_individuals, count(*) FILTER (WHERE action = 'skip') + count(*) FILTER (WHERE pos % 3 = 0 AND name NOT IN (SELECT name FROM e)) AS skipped_individuals, count(*) FILTER (WHERE pos % 3 = 0 AND name IN (SELECT name FROM e)) AS added_properties FROM a")
def _(spark, d):
    existing, items = _existing(spark, d)
    props = items.where("pos % 3 = 0").select("pos", F.col("name").alias("source"), F.lit("mass").alias("name"), F.col("pos").cast("string").alias("value"))
    return update.totals(update.update_stats(existing, items), update.update_stats(existing, items, dedup=False), update.property_stats(existing, props))


@_query("n02_target_individual", f"WITH {_UPDATE} SELECT pos, CASE WHEN pos = (SELECT min(pos) FROM e WHERE name = (SELECT arg_min(name, pos) FROM e)) THEN (SELECT CAST(max(pos) AS VARCHAR) FROM i WHERE pos % 3 = 0) END AS mass FROM e")
def _(spark, d):
    existing, items = _existing(spark, d)
    props = items.where("pos % 3 = 0").select("pos", F.lit("nobody").alias("individual"), F.lit("mass").alias("name"), F.col("pos").cast("string").alias("value"))
    return update.add_properties(existing, props, existing.orderBy("pos").first()["name"]).select("pos", F.col("attrs")["prop_mass"].alias("mass"))


@_query("l02_mixed_results", f"WITH {_CLASSES}, {_INDIVIDUALS} SELECT match_type, pos, name FROM (SELECT 0 AS k, 'class' AS match_type, pos, name FROM classes WHERE contains(lower(name), 'an') OR contains(lower(coalesce(comment, '')), 'an') UNION ALL SELECT 1, 'individual', pos, name FROM individuals WHERE contains(lower(name), 'an')) ORDER BY k, pos LIMIT 20")
def _(spark, d):
    return query.displayed(query.search(star.ontology(spark, d), "AN"))[0].select("match_type", "pos", "name")


@_query("l04_panel_edges", f"""WITH {_GRAPH}, b AS (SELECT src AS id, 'out' AS direction, pos, dst AS other FROM edges UNION ALL SELECT dst, 'in', pos, src FROM edges),
r AS (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY pos) AS rank, count(*) OVER (PARTITION BY id, direction) AS n FROM b) SELECT id, direction, CAST(rank AS INTEGER) AS rank, other, n, greatest(n - 20, 0) AS more FROM r WHERE rank <= 20""")
def _(spark, d):
    return graph.panel_edges(star.graph(spark, d))


def _exported(spark, write, *args) -> str:
    path = shared_path(spark, "export")
    write(*args, path)
    return path


@_query("s01_loaded_individuals", f"WITH {_INDIVIDUALS} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, name, class, t1 AS type, CAST(size AS DOUBLE) AS size FROM individuals")
def _(spark, d):
    o = load_ontology(spark, _exported(spark, sinks.export_json, star.ontology(spark, d)))
    return o.individuals.select("pos", "name", F.get("class", F.lit(0)).alias("class"), F.get("type", F.lit(0)).alias("type"), F.col("nums")["prop_size"].alias("size"))


@_query("k01_json_round_trip", f"WITH {_CLASSES} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, name, comment, parent FROM classes")
def _(spark, d):
    once = load_ontology(spark, _exported(spark, sinks.export_json, star.ontology(spark, d)))
    return load_ontology(spark, _exported(spark, sinks.export_json, once)).classes.select("pos", "name", "comment", F.get("sub_class_of", F.lit(0)).alias("parent"))


@_query("s04_loaded_graph", f"WITH {_GRAPH} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, src AS \"from\", dst AS \"to\", type FROM edges")
def _(spark, d):
    return load_graph(spark, _exported(spark, sinks.export_graph, star.graph(spark, d))).edges.select("pos", "from", "to", "type")


@_query("s06_loaded_rows", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, d):
    rows = star.read(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), "s_suppkey", "s_name", "s_acctbal")
    return load_rows(spark, _exported(spark, sinks.export_rows, rows)).select("s_suppkey", "s_name", "s_acctbal")


@_query("k05_csv_file", f"WITH {_INDIVIDUALS} SELECT name, coalesce(class, '') AS class, coalesce(t1, '') AS type FROM individuals")
def _(spark, d):
    path = _exported(spark, sinks.export_csv, sinks.csv_individuals(star.ontology(spark, d)))
    return spark.read.csv(path, header=True, escape='"', lineSep="\r\n").na.fill("")


@_query("k06_graphml_file", f"""WITH {_CLASSES}, {_INDIVIDUALS} SELECT (SELECT count(*) FROM classes) + (SELECT count(*) FROM individuals) AS nodes, (SELECT count(*) FROM individuals WHERE class IN (SELECT name FROM classes)) AS edges, CAST(7 AS BIGINT) AS others""")
def _(spark, d):
    lines = spark.read.text(_exported(spark, sinks.export_lines, sinks.graphml_lines(star.ontology(spark, d))))
    return lines.agg(F.count_if(F.col("value").startswith("<node ")).alias("nodes"), F.count_if(F.col("value").startswith("<edge ")).alias("edges"), F.count_if(~F.col("value").startswith("<node ") & ~F.col("value").startswith("<edge ")).alias("others"))


@_query("w05_nearest_windows", """WITH t AS (SELECT doc_id, text, lower(text) AS low, length(text) AS n FROM documents),
parts AS (SELECT doc_id, text, n, unnest(string_split(low, 'license')) AS part, generate_subscripts(string_split(low, 'license'), 1) AS i FROM t),
places AS (SELECT doc_id, text, n, i, sum(length(part) + 7) OVER (PARTITION BY doc_id ORDER BY i) - 7 AS "at", count(*) OVER (PARTITION BY doc_id) AS k FROM parts),
f AS (SELECT doc_id, any_value(text) AS text, any_value(n) AS n, min("at") AS first_at FROM places WHERE i < k GROUP BY doc_id)
SELECT doc_id, CAST(first_at AS INTEGER) AS match_position, CAST(greatest(0, first_at - 1000000000) AS INTEGER) AS start_char, CAST(least(n, first_at + 1000000000) AS INTEGER) AS end_char FROM f""")
def _(spark, d):
    return segment.segment_keywords(star.read(spark, d, "documents"), ["license"], 1_000_000_000).select("doc_id", "match_position", "start_char", "end_char")


def _in_parts(docs):
    """doc_id, part, text: each text in rows of 700 code points."""
    every = F.regexp_extract_all("text", F.lit(r"(?s).{1,700}|\A\z"), F.lit(0))  # linear in the text; an empty one is a part
    return docs.where("text IS NOT NULL").select("doc_id", F.posexplode(every).alias("part", "text"))


@_query("s11_chunks_of_parts", ORACLES["w04_fixed_chunks"])
def _(spark, d):
    return parts.segment_fixed(_in_parts(star.read(spark, d, "documents"))).select("doc_id", F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"))


@_query("s11_windows_of_parts", ORACLES["w05_keyword_windows"])
def _(spark, d):
    found = parts.segment_keywords(_in_parts(star.read(spark, d, "documents")), ["license", "than"], 500)
    return found.select("doc_id", "index", "keyword", *(F.col(c).cast("int").alias(c) for c in ("match_position", "start_char", "end_char")))


@_query("s11_sections_of_parts", ORACLES["w02_folded_sections"])
def _(spark, d):
    return parts.segment_headings(_in_parts(star.markdown(spark, d)), min_size=400).select("doc_id", "index", "title", "content", F.length("content").alias("char_count"))


@_query("s11_facts_of_parts", ORACLES["e01_documents"])
def _(spark, d):
    found = parts.extract(_in_parts(star.long_reports(spark, d)))
    return found.select("doc_id", *(F.size(c).alias(c) for c in ("individuals", "properties")), "text_length")
