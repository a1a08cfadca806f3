"""Exports: JSON, CSV, GraphML, Markdown, rows of a table; saves with a backup."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veinmap.functions.text import safe_id
from veinmap.model import Graph, Ontology
from veinmap.operators.graph import membership_edges
from veinmap.operators.query import class_label, stats


def one_file(spark: SparkSession, folder: str, path: str) -> int:
    """Joins a folder's part files, in order, into the file ``path``; removes the folder; returns the file's size.

    Bytes are streamed part by part; the last line has its end too.
    """
    jvm = spark._jvm
    io, path_of = jvm.org.apache.hadoop.io.IOUtils, jvm.org.apache.hadoop.fs.Path
    fs = path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().getName() for s in fs.listStatus(path_of(folder)) if s.getPath().getName().startswith("part-"))
    out = fs.create(path_of(path), True)
    for name in parts:
        source = fs.open(path_of(f"{folder}/{name}"))
        io.copyBytes(source, out, 1 << 16, False)
        source.close()
    out.close()
    fs.delete(path_of(folder), True)
    return fs.getFileStatus(path_of(path)).getLen()


def _quoted(c: Column) -> Column:
    """A string as JSON; null stays null."""
    text = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substring(text, F.lit(6), F.length(text) - 6))


def _field(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f'"{key}": '), value))


def _names(c: str, listed: Column | None = None) -> Column:
    """An array as a list of strings, or as one if it is no list."""
    many = F.concat(F.lit("["), F.array_join(F.transform(c, _quoted), ", ", "null"), F.lit("]"))
    return F.when(F.coalesce(~listed if listed is not None else F.size(c) == 1, F.lit(False)), _quoted(F.get(c, F.lit(0)))).otherwise(many)


def _entity(*fields: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ", "), F.lit("}"))


def json_lines(o: Ontology) -> DataFrame:
    """ord, pos, line: an ontology as one JSON document, an entity a line, sections as lists of objects.

    Numbers and booleans are written as such, other values as text, so ``load_ontology`` gives the
    same ontology again.
    """
    plain = lambda *names: [_field(k, _quoted(F.col(c))) for c, k in names]
    known = F.when(F.col("sub_class_of_present"), F.concat(F.lit('"subClassOf": '), F.coalesce(_names("sub_class_of"), F.lit("null"))))
    literal = lambda k, v: F.when(~F.map_contains_key("nums", k), _quoted(v)).when(v.isin("True", "False"), F.lower(v)).otherwise(v)
    more = F.transform(F.map_entries("attrs"), lambda e: F.concat(_quoted(e["key"]), F.lit(": "), literal(e["key"], e["value"])))
    bodies = {
        "classes": (o.classes, _entity(*plain(("name", "name"), ("class_name", "className"), ("comment", "comment"), ("uri", "uri")), known, _field("parentClass", _names("parent_class")))),
        "objectProperties": (o.object_properties, _entity(*plain(*((c, c) for c in ("name", "domain", "range", "uri"))))),
        "datatypeProperties": (o.datatype_properties, _entity(*plain(*((c, c) for c in ("name", "domain", "range", "uri"))))),
        "individuals": (o.individuals, _entity(*plain(("name", "name")), _field("class", _names("class", F.col("class_is_list"))), _field("type", _names("type", F.col("type_is_list"))), _field("classes", _names("classes")), F.when(F.size("attrs") > 0, F.array_join(more, ", ")))),
    }
    return document({name: df.select("pos", body.alias("body")) for name, (df, body) in bodies.items()})


def listed(rows: DataFrame, first_ord: int = 1) -> DataFrame:
    """ord, pos, line: rows (pos, body) as the items of a JSON list, without its brackets."""
    first = rows.agg(F.min("pos").alias("first"))  # one row
    return rows.crossJoin(F.broadcast(first)).select(F.lit(first_ord).alias("ord"), F.col("pos").cast("long").alias("pos"), F.concat(F.when(F.col("pos") == F.col("first"), "").otherwise(","), "body").alias("line"))


def document(sections: dict[str, DataFrame]) -> DataFrame:
    """ord, pos, line: a JSON object of lists; sections: name -> rows (pos, body)."""
    fixed, out = [(0, 0, "{")], None
    for i, (name, rows) in enumerate(sections.items()):
        fixed += [(3 * i + 1, 0, f'"{name}": ['), (3 * i + 3, 0, "]" if i == len(sections) - 1 else "],")]
        own = listed(rows, 3 * i + 2)
        out = own if out is None else out.unionByName(own)
    fixed.append((3 * len(sections) + 1, 0, "}"))
    return out.unionByName(out.sparkSession.createDataFrame(fixed, "ord int, pos long, line string"))


def export_graph(g: Graph, path: str) -> int:
    """One JSON file of a property graph, which ``load_graph`` reads."""
    nodes = g.nodes if "pos" in g.nodes.columns else g.nodes.withColumn("pos", F.monotonically_increasing_id())
    body = lambda df: df.select("pos", F.to_json(F.struct(*(c for c in df.columns if c != "pos"))).alias("body"))
    return export_lines(document({"nodes": body(nodes), "relationships": body(g.edges)}), path)


def export_rows(rows: DataFrame, path: str) -> int:
    """One JSON file of a list of objects, in the order of pos, which ``load_rows`` reads."""
    lines = listed(rows.select("pos", F.to_json(F.struct(*(c for c in rows.columns if c != "pos"))).alias("body")))
    ends = rows.sparkSession.createDataFrame([(0, 0, "["), (2, 0, "]")], "ord int, pos long, line string")
    return export_lines(lines.unionByName(ends), path)


def export_json(o: Ontology, path: str) -> int:
    """One JSON file, which ``load_ontology`` reads."""
    return export_lines(json_lines(o), path)


def save_ontology(o: Ontology, path: str, backup: bool = True) -> str | None:
    """Writes the ontology's JSON file through a new file beside it; the old one is kept under a stamped name if wished."""
    export_json(o, f"{path}.new")
    return _replace(o.classes.sparkSession, path, backup)


def _cell(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def csv_classes(o: Ontology) -> DataFrame:
    return o.classes.select("pos", _cell("name").alias("name"), _cell("comment").alias("comment"))


def csv_individuals(o: Ontology) -> DataFrame:
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return o.individuals.select("pos", _cell("name").alias("name"), first("class").alias("class"), first("type").alias("type"))


def csv_properties(o: Ontology) -> DataFrame:
    return o.object_properties.select("pos", *(_cell(c).alias(c) for c in ("name", "domain", "range")))


def export_csv(rows: DataFrame, path: str) -> int:
    """One CSV file with a header and CRLF, in the order of pos, without it; returns its size."""
    names = [c for c in rows.columns if c != "pos"]
    line = F.to_csv(F.struct(*names), {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    head = rows.sparkSession.createDataFrame([(0, 0, ",".join(names))], "ord int, pos long, line string")
    lines = head.unionByName(rows.select(F.lit(1).alias("ord"), F.col("pos").cast("long").alias("pos"), line.alias("line")))
    return export_lines(lines, path, "\r\n")


def graphml_lines(o: Ontology, graph_id: str = "ontology") -> DataFrame:
    """ord, pos, part, line: the document's lines; ids have no spaces and slashes, names aren't escaped."""
    node = lambda kind: F.concat(F.lit('<node id="'), safe_id(F.col("name")), F.lit('"><data key="label">'), F.col("name"), F.lit(f'</data><data key="type">{kind}</data></node>'))
    classes = o.classes.select(F.coalesce("name", F.concat(F.lit("cls_"), F.col("pos").cast("string"))).alias("name"), "pos").groupBy("name").agg(F.min("pos").alias("pos")).select(F.lit(1).alias("ord"), "pos", F.lit(0).alias("part"), node("class").alias("line"))
    individuals = o.individuals.select("pos", F.coalesce("name", F.lit("unknown")).alias("name")).select(F.lit(2).alias("ord"), "pos", F.lit(0).alias("part"), node("individual").alias("line"))
    edges = membership_edges(o).select(F.lit(2).alias("ord"), "pos", F.lit(1).alias("part"), F.concat(F.lit('<edge source="'), safe_id(F.col("source")), F.lit('" target="'), safe_id(F.col("target")), F.lit('"/>')).alias("line"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphstruct.org/graphml">', '<key id="label" for="node" attr.name="label" attr.type="string"/>', '<key id="type" for="node" attr.name="type" attr.type="string"/>', f'<graph id="{graph_id}" edgedefault="directed">']
    frame = o.classes.sparkSession.createDataFrame([*((0, i, 0, s) for i, s in enumerate(head)), (3, 0, 0, "</graph>"), (3, 1, 0, "</graphml>")], "ord int, pos long, part int, line string")
    return frame.unionByName(classes).unionByName(individuals).unionByName(edges)


def markdown_lines(o: Ontology, title: str = "Ontology report", shown: int = 50) -> DataFrame:
    """ord, pos, line: counts, all classes, the first individuals and how many more there are."""
    spark = o.classes.sparkSession
    s = stats(o)
    numbers = s.select(F.lit(1).alias("ord"), F.posexplode(F.array(*(F.concat(F.lit(f"**{label}**: "), F.col(c).cast("string")) for label, c in (("Classes", "classes"), ("Object Properties", "object_properties"), ("Datatype Properties", "datatype_properties"), ("Individuals", "individuals"))))).alias("pos", "line"))
    item = lambda name, rest: F.concat(F.lit("- **"), name, F.lit("**"), rest)
    classes = o.classes.select(F.lit(3).alias("ord"), "pos", item(class_label(), F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(": "), "comment")).otherwise("")).alias("line"))
    own = F.coalesce(F.get("class", F.lit(0)), F.lit(""))
    first = o.individuals.orderBy("pos").limit(shown).select(F.lit(5).alias("ord"), "pos", item(F.coalesce("name", F.lit("?")), F.when(own != "", F.concat(F.lit(" → "), own)).otherwise("")).alias("line"))
    more = s.where(F.col("individuals") > shown).select(F.lit(6).alias("ord"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("- ... and "), (F.col("individuals") - shown).cast("string"), F.lit(" more")).alias("line"))
    fixed = spark.createDataFrame([(0, 0, f"# {title}"), (0, 1, ""), (2, 0, ""), (2, 1, "## Classes"), (2, 2, ""), (4, 0, ""), (4, 1, "## Individuals"), (4, 2, "")], "ord int, pos long, line string")
    return fixed.unionByName(numbers.withColumn("pos", F.col("pos").cast("long"))).unionByName(classes).unionByName(first).unionByName(more)


def export_lines(lines: DataFrame, path: str, line_end: str = "\n") -> int:
    """One text file of the lines, in order; returns its size."""
    order = [c for c in ("ord", "pos", "part") if c in lines.columns]
    lines.orderBy(*order).select("line").write.mode("overwrite").option("lineSep", line_end).text(f"{path}.parts")
    return one_file(lines.sparkSession, f"{path}.parts", path)


def _replace(spark: SparkSession, path: str, backup: bool) -> str | None:
    """Puts ``path``.new in the place of ``path``; the old one's stamped name, if it is kept."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    kept = None
    if fs.exists(path_of(path)):
        kept = f"{path}.backup_{time.strftime('%Y%m%d_%H%M%S')}" if backup else None
        if kept:
            fs.rename(path_of(path), path_of(kept))
        else:
            fs.delete(path_of(path), True)
    fs.rename(path_of(f"{path}.new"), path_of(path))
    return kept


def save(spark: SparkSession, rows: DataFrame, folder: str, backup: bool = True) -> str | None:
    """Overwrites a table's ``folder`` through a new folder beside it; the old one is kept under a stamped name if wished."""
    rows.write.mode("overwrite").parquet(f"{folder}.new")
    return _replace(spark, folder, backup)


def insert(rows: DataFrame, folder: str) -> int:
    """Appends rows to a table's folder; returns their number, counted while they are written."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(folder)
    return seen.get["n"]


def delete(spark: SparkSession, folder: str, predicate: str) -> None:
    """Removes the rows that fulfil ``predicate`` by writing the others anew."""
    save(spark, spark.read.parquet(folder).where(f"NOT coalesce({predicate}, false)"), folder, backup=False)


def select(spark: SparkSession, folder: str, predicate: str | None = None) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows.where(predicate) if predicate else rows
