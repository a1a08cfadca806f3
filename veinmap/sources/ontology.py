"""Sources: ontology JSON, property-graph JSON, generic JSON rows."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinmap.model import Graph, Ontology
from veinmap.operators.links import cut

#: Sections of the file.
SECTIONS = ("classes", "objectProperties", "datatypeProperties", "individuals")


#: A file of fewer bytes is read whole, by one task.
WHOLE = 16 << 20
#: Lines that are no items, at most, of a file that is read line by line.
MARKS = 64


def default_path(names: tuple[str, ...], folders: tuple[str, ...]) -> str:
    """The first existing file of ``names`` in ``folders``."""
    for folder in folders:
        for name in names:
            if os.path.exists(path := os.path.join(folder, name)):
                return path
    raise FileNotFoundError(f"none of {', '.join(names)} in {', '.join(folders)}")


def _entries(section: Column) -> Column:
    """A section (JSON text) as an array of (name, body): objects by key, lists by position, else none."""
    keyed = F.from_json(section, "map<string,string>", {"mode": "PERMISSIVE"})
    listed = F.from_json(section, "array<string>")
    by_key = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("body")))
    by_place = F.transform(listed, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), b.alias("body")))
    kind = F.substring(F.ltrim(section), 1, 1)
    return F.when(kind == "{", by_key).when(kind == "[", by_place)


def _strings(c: Column) -> Column:
    """A string, or a list of strings, as an array; null if absent."""
    return F.when(c.isNull(), None).when(F.substring(c, 1, 1) == "[", F.from_json(c, "array<string>")).otherwise(F.array(c))


def _is_list(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 1) == "[", F.lit(False))


def _by_lines(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """Section -> pos, name, body of a large file as ``sinks.document`` writes it, an item a line; None of any other.

    Lines are numbered by their place in their split and the lines of the splits before; every line is
    checked, so a file that is laid out otherwise, or no valid JSON, is left to the reader of whole files.
    """
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = own.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(own)
    if not found or len(found) != 1 or found[0].isDirectory() or found[0].getLen() < WHOLE:
        return None
    bare = F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '"[^"]*+"', "")  # without strings
    body = F.get(F.from_json(F.concat(F.lit("["), F.ltrim(F.col("value"), F.lit(",")), F.lit("]")), "array<string>"), F.lit(0))
    item = F.when(bare.rlike(r'\A,?\{[^{}"]*\}\z'), body)
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("m"), F.when(item.isNull(), F.left("value", F.lit(200))).alias("mark"), F.startswith("value", F.lit(",")).alias("later"), item.alias("body"))
    lines = cut(lines)  # parsed once
    splits = lines.groupBy("split").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    base = splits.select("split", (before - F.col("first")).alias("base"))
    placed = lines.join(F.broadcast(base), "split").select((F.col("m") + F.col("base")).alias("at"), "mark", "later", "body")
    marks = [tuple(r) for r in placed.where("body IS NULL").orderBy("at").limit(MARKS + 1).select("at", "mark").collect()]
    heads, ends = marks[1:-1:2], marks[2:-1:2]
    names = [m[1] for _, text in heads if (m := re.fullmatch(r'"([^"\\]*)": \[', text))]
    closed = ["],"] * (len(ends) - 1) + ["]"]
    if not 4 <= len(marks) <= MARKS or len(marks) % 2 or marks[0] != (0, "{") or marks[-1] != (ends[-1][0] + 1, "}") or [t for _, t in ends] != closed:
        return None
    if len(set(names)) != len(heads) or [a for a, _ in heads] != [1, *(a + 1 for a, _ in ends[:-1])] or lines.count() != marks[-1][0] + 1:
        return None
    if not placed.where("body IS NOT NULL").where(F.col("at").isin([a + 1 for a, _ in heads]) == F.col("later")).isEmpty():
        return None  # a comma too many or too few
    of = lambda a, b: placed.where((F.col("at") > a) & (F.col("at") < b)).select((F.col("at") - (a + 1)).cast("long").alias("pos"), F.get_json_object("body", "$.name").alias("name"), "body")
    return {name: of(a, b) for name, (a, _), (b, _) in zip(names, heads, ends)}


def load_ontology(spark: SparkSession, path: str) -> Ontology:
    """Reads one ontology file.  Keys override inner names; a scalar entry becomes {name, value}; unknown sections are dropped.

    Entity names are JSON keys, so nothing is inferred: sections and entities are read as maps of text.
    A large file with an item a line, as exports are, is read by all tasks; any other by one.
    """
    lined = _by_lines(spark, path)
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("doc"))

    def section(name: str) -> DataFrame:
        if lined and name in lined:
            rows = lined[name]
        else:
            own = raw.where(F.lit(False)) if lined else raw
            rows = own.select(F.posexplode(_entries(F.col("doc")[name])).alias("pos", "e")).select(F.col("pos").cast("long").alias("pos"), "e.name", "e.body")
        body = F.when(F.substring(F.ltrim("body"), 1, 1) == "{", F.from_json("body", "map<string,string>")).otherwise(F.create_map(F.lit("value"), F.col("body")))
        return rows.select("pos", "name", body.alias("m"))

    def classes() -> DataFrame:
        m = F.col("m")
        return section("classes").select(
            "pos", "name", m["className"].alias("class_name"), m["comment"].alias("comment"), m["uri"].alias("uri"),
            _strings(m["subClassOf"]).alias("sub_class_of"), F.map_contains_key(m, "subClassOf").alias("sub_class_of_present"), _strings(m["parentClass"]).alias("parent_class"),
        )

    def properties(name: str) -> DataFrame:
        return section(name).select("pos", "name", *(F.col("m")[k].alias(k) for k in ("domain", "range", "uri")))

    def individuals() -> DataFrame:
        rows = section("individuals").withColumn("kinds", F.map_filter("m", lambda k, v: ~k.isin("name", "class", "type", "classes")))
        # Python's text of a value: from_json has unquoted strings already, booleans and null differ
        text = F.transform_values("kinds", lambda k, v: F.when(v == "true", "True").when(v == "false", "False").when(v.isNull(), "None").otherwise(v))
        number = F.transform_values("kinds", lambda k, v: F.when(v == "true", F.lit(1.0)).when(v == "false", F.lit(0.0)).otherwise(v.try_cast("double")))
        m = F.col("m")
        return rows.select(
            "pos", "name", _strings(m["class"]).alias("class"), _is_list(m["class"]).alias("class_is_list"), _strings(m["type"]).alias("type"), _is_list(m["type"]).alias("type_is_list"),
            _strings(m["classes"]).alias("classes"), text.alias("attrs"), F.map_filter(number, lambda k, v: v.isNotNull()).alias("nums"),
        )

    return Ontology(classes(), properties("objectProperties"), properties("datatypeProperties"), individuals())


def load_graph(spark: SparkSession, path: str) -> Graph:
    """Reads nodes and relationships (or ``rels``) of one graph file."""
    raw = spark.read.json(path, multiLine=True)
    lists = [F.col(c) for c in ("relationships", "rels") if dict(raw.dtypes).get(c, "").startswith("array")]
    edges = raw.select(F.posexplode(F.coalesce(*lists)).alias("pos", "e")).select(F.col("pos").cast("long"), "e.*")
    return Graph(raw.select(F.posexplode("nodes").alias("pos", "n")).select(F.col("pos").cast("long"), "n.*"), edges)


def load_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSON file that holds a list of objects, or one object."""
    return spark.read.json(path, multiLine=True, schema=schema)
