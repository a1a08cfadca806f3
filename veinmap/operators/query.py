"""Ontology queries: search, by class, by property, hierarchy, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinmap.functions.text import first_class, lowered_contains, property_key
from veinmap.model import Ontology


def class_label() -> Column:
    """A class's name, else its class_name, else empty."""
    return F.coalesce("name", "class_name", F.lit(""))


def search(o: Ontology, query: str, category: str = "all") -> DataFrame:
    """Classes by name or comment, then individuals by name: match_type, pos, name, comment."""
    found = []
    if category in ("all", "classes"):
        found.append(o.classes.where(lowered_contains(class_label(), query) | lowered_contains(F.coalesce("comment", F.lit("")), query)).select(F.lit("class").alias("match_type"), "pos", class_label().alias("name"), "comment"))
    if category in ("all", "individuals"):
        found.append(o.individuals.where(lowered_contains(F.coalesce("name", F.lit("")), query)).select(F.lit("individual").alias("match_type"), "pos", F.coalesce("name", F.lit("")).alias("name")))
    if not found:
        raise ValueError(f"no such category: {category}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def by_class(o: Ontology, class_name: str) -> DataFrame:
    """Individuals of a class; one whose listed types and listed classes both match comes twice."""
    target = class_name.lower()
    hit = lambda c: F.coalesce(F.exists(c, lambda x: F.lower(x) == target), F.lit(False))
    scalar = lambda c: F.lower(F.coalesce(F.get(c, F.lit(0)), F.lit(""))) == target
    in_classes = hit("classes").cast("int")
    times = F.when(~F.col("class_is_list") & scalar(F.col("class")), 1).when(F.col("type_is_list"), F.when(hit("type"), 1 + in_classes).otherwise(0)).when(scalar(F.col("type")), 1).otherwise(in_classes)
    return o.individuals.withColumn("__times", times).where("__times > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__n")


def by_property(o: Ontology, name: str, value: str | None = None) -> DataFrame:
    """Individuals with the property (its exact key decides, else any key that contains the name), and the value in its text."""
    key = property_key(name)
    text = lambda v: F.contains(F.lower(v), F.lit((value or "").lower())) if value is not None else F.lit(True)
    loose = F.size(F.map_filter("attrs", lambda k, v: k.startswith("prop_") & F.contains(F.lower(k), F.lit(name.lower())) & text(v))) > 0
    return o.individuals.where(F.when(F.map_contains_key("attrs", key), text(F.col("attrs")[key])).otherwise(loose))


def hierarchy(o: Ontology, class_name: str) -> DataFrame:
    """The class (the last of that name) and its direct children: relation, pos, name."""
    target = class_name.lower()
    parents = F.when(F.col("sub_class_of_present"), F.col("sub_class_of")).otherwise(F.col("parent_class"))
    named = o.classes.select("pos", class_label().alias("name"), parents.alias("parents"))
    own = named.where(F.lower("name") == target).groupBy().agg(F.max_by(F.struct("pos", "name"), "pos").alias("x")).where("x IS NOT NULL").select(F.lit("class").alias("relation"), "x.*")
    children = named.where((F.lower("name") != target) & F.exists("parents", lambda p: F.lower(p) == target)).select(F.lit("child").alias("relation"), "pos", "name")
    return own.unionByName(children)


def all_children(o: Ontology) -> DataFrame:
    """Every class with its direct children: parent, child (pos and name), by an equi-join on lower-case names."""
    parents = F.when(F.col("sub_class_of_present"), F.col("sub_class_of")).otherwise(F.col("parent_class"))
    edges = o.classes.select(F.col("pos").alias("child_pos"), class_label().alias("child"), F.explode(parents).alias("p")).select("child_pos", "child", F.lower("p").alias("key")).distinct()
    heads = o.classes.select(F.lower(class_label()).alias("key"), "pos", class_label().alias("parent")).groupBy("key").agg(F.max_by("parent", "pos").alias("parent"))
    return heads.join(edges, "key").where(F.lower("child") != F.col("key")).select("parent", "child_pos", "child")


def name_index(df: DataFrame) -> DataFrame:
    """Lower-case name -> position of its last record."""
    return df.groupBy(F.lower(F.coalesce("name", F.lit(""))).alias("key")).agg(F.max("pos").alias("pos"))


def stats(o: Ontology) -> DataFrame:
    """The four sections' sizes in one row."""
    parts = [(o.classes, "classes"), (o.object_properties, "object_properties"), (o.datatype_properties, "datatype_properties"), (o.individuals, "individuals")]
    counted = None
    for df, name in parts:
        own = df.select(F.lit(name).alias("section"))
        counted = own if counted is None else counted.unionByName(own)
    return counted.groupBy().agg(*(F.count_if(F.col("section") == name).alias(name) for _, name in parts))


def class_distribution(o: Ontology, top: int = 10) -> DataFrame:
    """The classes with most individuals; ties in the order of first appearance."""
    counts = o.individuals.groupBy(first_class(F.col("class")).alias("class")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return counts.orderBy(F.desc("n"), "first_pos").limit(top)


def in_order(found: DataFrame) -> list[Column]:
    """What orders a query's rows: classes before individuals, the class before its children, then ``pos``."""
    kinds = [F.when(F.col(c) == "class", 0).otherwise(1) for c in ("match_type", "relation") if c in found.columns]
    return [*kinds, F.col("pos")]


def displayed(found: DataFrame, limit: int = 20) -> tuple[DataFrame, int]:
    """The first rows in order, and how many more there are; a limit of 0 behaves as 20."""
    limit = limit or 20
    return found.orderBy(*in_order(found)).limit(limit), max(0, found.count() - limit)
