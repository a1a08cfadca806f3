"""Property-graph operators: membership edges, filters, neighbours, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinmap.model import Graph, Ontology


def membership_edges(o: Ontology) -> DataFrame:
    """Individual -> class for classes that the ontology has: pos, source, target."""
    names = o.classes.select(F.col("name").alias("target")).where("target IS NOT NULL").distinct()
    own = o.individuals.where("class IS NOT NULL").select("pos", F.col("name").alias("source"), F.get("class", F.lit(0)).alias("target"))
    return own.join(names, "target", "left_semi").select("pos", "source", "target")


def filtered_nodes(g: Graph, kind: str = "all", term: str = "") -> DataFrame:
    kept = g.nodes if kind == "all" else g.nodes.where(F.col("type") == kind)
    return kept.where(F.contains(F.lower("name"), F.lit(term.lower()))) if term else kept


def induced(g: Graph, kind: str = "all", term: str = "") -> Graph:
    """The kept nodes and the edges between them."""
    nodes = filtered_nodes(g, kind, term)
    ids = nodes.select("id")
    edges = g.edges.join(ids.select(F.col("id").alias("from")), "from", "left_semi").join(ids.select(F.col("id").alias("to")), "to", "left_semi")
    return Graph(nodes, edges.select(*g.edges.columns))


def neighbours(g: Graph) -> DataFrame:
    """Each edge with its target's name, or the raw id: pos, from, type, to_name."""
    names = g.nodes.select(F.col("id").alias("to"), "name")
    return g.edges.join(names, "to", "left").select("pos", "from", "type", F.coalesce(F.nullif("name", F.lit("")), "to").alias("to_name"))


def degrees(g: Graph) -> DataFrame:
    """id, n_out, n_in, degree of all nodes with an edge."""
    ends = g.edges.select(F.col("from").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(g.edges.select(F.col("to").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count("*").alias("degree"))


def top_edges(g: Graph, out_most: int = 5, in_most: int = 3) -> DataFrame:
    """The first edges of each node by pos: id, direction, rank, other.

    The larger of the limits is a literal, so it is applied before the shuffle: a hub node sends few edges.
    """
    both = g.edges.select(F.col("from").alias("id"), F.lit("out").alias("direction"), "pos", F.col("to").alias("other")).unionByName(g.edges.select(F.col("to").alias("id"), F.lit("in").alias("direction"), "pos", F.col("from").alias("other")))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("id", "direction").orderBy("pos")))
    ranked = ranked.where(F.col("rank") <= max(out_most, in_most))
    if out_most != in_most:
        ranked = ranked.where(F.col("rank") <= F.when(F.col("direction") == "out", out_most).otherwise(in_most))
    return ranked.select("id", "direction", "rank", "other")


def panel_edges(g: Graph, most: int = 20) -> DataFrame:
    """The lists of a node's panel: the first edges of each direction by pos, and how many more there are.

    id, direction, rank, other, n (edges of the direction), more (those that aren't shown).
    """
    n = degrees(g).select("id", F.explode(F.create_map(F.lit("out"), "n_out", F.lit("in"), "n_in")).alias("direction", "n"))
    return top_edges(g, most, most).join(n, ["id", "direction"]).select("id", "direction", "rank", "other", "n", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def counts(g: Graph) -> DataFrame:
    kinds = g.nodes.select(F.lit(1).alias("n")).unionByName(g.edges.select(F.lit(0).alias("n")))
    return kinds.groupBy().agg(F.count_if(F.col("n") == 1).alias("nodes"), F.count_if(F.col("n") == 0).alias("relationships"))


def panel(fields: DataFrame, column: str = "fields") -> DataFrame:
    """The fields of a node whose key does not begin with an underscore."""
    return fields.withColumn(column, F.map_filter(column, lambda k, v: ~k.startswith("_")))
