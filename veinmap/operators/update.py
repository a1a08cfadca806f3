"""Incremental update of individuals: add, fill in, attach properties, log changes.

existing and incoming: pos, name, attrs (map of all other keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinmap.operators.links import cut


def _first_existing(existing: DataFrame) -> DataFrame:
    return existing.groupBy("name").agg(F.min("pos").alias("first_pos"), F.min_by("attrs", "pos").alias("have"))


def judged(existing: DataFrame, incoming: DataFrame, dedup: bool = True) -> DataFrame:
    """incoming with ``action``: skip, add or update.

    Names are matched as written, against what was there before the batch: two equal new names are
    both added.  An item updates if it brings a key that neither the first existing individual of
    that name nor an earlier item of the batch has.  Without ``dedup`` every named item is added.
    """
    named = F.coalesce(F.col("name") != "", F.lit(False))
    bare = incoming.where(~named).withColumn("action", F.lit("skip"))
    if not dedup:
        return incoming.where(named).withColumn("action", F.lit("add")).unionByName(bare)
    rows = incoming.where(named).join(_first_existing(existing), "name", "left")
    fresh = rows.where("first_pos IS NOT NULL").select("name", "pos", F.explode(F.map_filter("attrs", lambda k, v: ~F.map_contains_key("have", k))).alias("k", "v"))
    bringer = fresh.groupBy("name", "k").agg(F.min("pos").alias("pos")).select("name", "pos").distinct().withColumn("__new", F.lit(True))
    out = rows.join(bringer, ["name", "pos"], "left").withColumn("action", F.when(F.col("first_pos").isNull(), "add").when(F.col("__new"), "update").otherwise("skip"))
    return out.select(*incoming.columns, "action").unionByName(bare)


def add_individuals(existing: DataFrame, incoming: DataFrame, dedup: bool = True, actions: DataFrame | None = None) -> DataFrame:
    """The individuals after the batch: existing ones with the keys they lacked, then the added ones.

    ``actions``: what ``judged`` gave for the batch, if it is there already.
    """
    actions = actions or cut(judged(existing, incoming, dedup))  # written once, for both outputs
    fresh = actions.where("action = 'update'").select("name", "pos", F.explode("attrs").alias("k", "v")).groupBy("name", "k").agg(F.min_by("v", "pos").alias("v"))
    brought = fresh.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("new"))  # distinct keys of one name
    target = _first_existing(existing).select("name", F.col("first_pos").alias("pos")).join(brought, "name")
    kept = existing.join(target.select("pos", "new"), "pos", "left").select("pos", "name", F.when(F.col("new").isNull(), F.col("attrs")).otherwise(F.map_concat("attrs", F.map_filter("new", lambda k, v: ~F.map_contains_key("attrs", k)))).alias("attrs"))
    return kept.unionByName(actions.where("action = 'add'").select("pos", "name", "attrs"))


#: Counts of an update.
COUNTS = ("added_individuals", "updated_individuals", "skipped_individuals", "added_properties")


def update_stats(existing: DataFrame, incoming: DataFrame, dedup: bool = True) -> DataFrame:
    a = judged(existing, incoming, dedup)
    return a.groupBy().agg(*(F.count_if(F.col("action") == k).alias(n) for k, n in zip(("add", "update", "skip"), COUNTS)))


def totals(*stats: DataFrame) -> DataFrame:
    """The sums of several calls' counts (``update_stats``, ``property_stats``) in one row."""
    rows = None
    for df in stats:
        own = df.select(*(F.col(c).cast("long").alias(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in COUNTS))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy().agg(*(F.sum(c).alias(c) for c in COUNTS))


def changes(existing: DataFrame, incoming: DataFrame, stamped: bool = True, dedup: bool = True, actions: DataFrame | None = None) -> DataFrame:
    """A row for each added individual: action, type, name."""
    out = (actions or judged(existing, incoming, dedup)).where("action = 'add'").select(F.lit("add").alias("action"), F.lit("individual").alias("type"), "name")
    return out.withColumn("timestamp", F.current_timestamp()) if stamped else out


def _aimed(props: DataFrame, target: str | None) -> DataFrame:
    """props with ``individual``: the target, else what the property names, else its source; empty if none."""
    own = [F.col(c) for c in ("individual", "source") if c in props.columns]
    return props.withColumn("individual", F.lit(target) if target else F.coalesce(*own, F.lit("")))


def add_properties(existing: DataFrame, props: DataFrame, target: str | None = None) -> DataFrame:
    """existing with prop_<name> set from props (pos, individual or source, name, value); the last value wins; units are dropped.

    With ``target`` all properties go to the individual of that name.
    """
    last = _aimed(props, target).where("individual <> ''").groupBy("individual", "name").agg(F.max_by("value", "pos").alias("value"))
    new = last.groupBy("individual").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("prop_"), "name").alias("k"), F.col("value").alias("v")))).alias("new"))  # distinct names of one individual
    aim = _first_existing(existing).select("name", F.col("first_pos").alias("pos")).join(new, F.col("name") == F.col("individual"))
    return existing.join(aim.select("pos", "new"), "pos", "left").select("pos", "name", F.when(F.col("new").isNull(), F.col("attrs")).otherwise(F.map_concat(F.map_filter("attrs", lambda k, v: ~F.map_contains_key("new", k)), "new")).alias("attrs"))


def property_stats(existing: DataFrame, props: DataFrame, target: str | None = None) -> DataFrame:
    """added_properties, skipped_individuals (properties whose individual isn't there)."""
    names = existing.select(F.col("name").alias("individual"), F.lit(1).alias("hit")).where("individual <> ''").distinct()
    return _aimed(props, target).join(names, "individual", "left").groupBy().agg(F.count("hit").alias("added_properties"), F.count_if(F.col("hit").isNull()).alias("skipped_individuals"))
