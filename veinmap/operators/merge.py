"""Deduplication and merging of extracted facts.

Items carry ``pos`` (their order).  Exact and normalized keys shuffle once by key; items without a
key pass around the shuffle, so a hot empty key costs nothing.  Fuzzy matching depends on the order
of all items; its leaders come from rounds of joins.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinmap.functions.text import exact_key, normalized_key, printed, rounded
from veinmap.operators.fuzzy import alike, leaders, similar
from veinmap.operators.links import components, cut, ranked


def _split(items: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    filled = F.coalesce(F.col(key) != "", F.lit(False))
    return items.where(filled), items.where(~filled)


def dedup(items: DataFrame, key: str = "name", strategy: str = "exact", conflict: str = "latest", attrs: str | None = None) -> DataFrame:
    """One item per key at the key's first position, with n_merged; items without a key all stay.

    ``latest``: content of the last item (normalized: of the chain of items whose predecessor's
    stripped lower-case name equals the key).  ``merge``: the first item's content, and in the map
    ``attrs`` the keys it lacks from later items, first come.  Any other: the first item's content.
    """
    if strategy == "fuzzy":
        return dedup_fuzzy(items, key, conflict=conflict, attrs=attrs)
    full, bare = _split(items, key)
    k = normalized_key(F.col(key)) if strategy == "normalized" else exact_key(F.col(key))
    columns = [c for c in items.columns if c != "pos"]
    row = F.struct("pos", *columns)
    groups = full.withColumn("__k", k).groupBy("__k")
    aggregates = [F.min("pos").alias("__first"), (F.count("*") - 1).alias("n_merged"), F.min_by(row, "pos").alias("__head"), F.max_by(row, "pos").alias("__tail")]
    if conflict == "latest" and strategy == "normalized":
        # the representative is replaced while its own stripped name is the key: the content is the first item's whose name isn't, else the last's
        other = F.when(exact_key(F.col(key)) != F.col("__k"), F.col("pos"))
        kept = groups.agg(*aggregates, F.min(other).alias("__stop"), F.min_by(row, other).alias("__stopped")).withColumn("__row", F.when(F.col("__stop").isNotNull(), F.col("__stopped")).otherwise(F.col("__tail")))
    elif conflict == "merge" and attrs:
        each = full.withColumn("__k", k).select("__k", "pos", F.explode(attrs).alias("a", "v")).groupBy("__k", "a").agg(F.min_by("v", "pos").alias("v"))
        joined = each.groupBy("__k").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("a", "v")))).alias("__attrs"))  # distinct attribute names of one key
        kept = groups.agg(*aggregates).join(joined, "__k", "left").withColumn("__row", F.col("__head").withField(attrs, F.coalesce("__attrs", F.col("__head")[attrs])))
    else:
        kept = groups.agg(*aggregates).withColumn("__row", F.col("__tail" if conflict == "latest" else "__head"))
    kept = kept.select(F.col("__first").alias("pos"), *(F.col("__row")[c].alias(c) for c in columns), "n_merged")
    return kept.unionByName(bare.withColumn("n_merged", F.lit(0).cast("long")))


def _folded(rows: DataFrame, order: str, ddl: str, start) -> DataFrame:
    """Maps rows (__c, ...) in order inside each component; rows stream, only the fold's state is held.

    ``start`` gives two functions: of a row, and of the end; both give rows of ``ddl``.
    """
    names = [f.split(" ")[0] for f in ddl.split(", ")]

    def run(batches):
        now, each, end = None, None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False, name=None):
                if r[0] != now:
                    out += end() if end else []
                    now, (each, end) = r[0], start()
                out += each(*r[1:])
            yield pd.DataFrame(out, columns=names)
        if end:
            yield pd.DataFrame(end(), columns=names)

    return rows.repartition("__c").sortWithinPartitions("__c", order).mapInPandas(run, ddl)


def _latest(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (__c, __seq, __k, __lead, __leader) of leaders that share contents -> __lead, __seq: the item each leader's place ends with.

    An item takes the first place whose content is like its leader; that may be another leader's.
    """

    def start():
        at: dict[int, int] = {}
        content: list[list] = []
        like = lru_cache(maxsize=1 << 18)(lambda a, c: alike(a, c, threshold))

        def each(seq, k, lead, leader):
            if lead not in at:
                at[lead] = len(content)
                content.append([k, seq])
            elif (hit := next((x for x in content if like(x[0], leader)), None)) is not None:
                hit[:] = [k, seq]
            return []

        return each, lambda: [(lead, content[i][1]) for lead, i in at.items()]

    return _folded(rows, "__seq", "__lead long, __seq long", start)


def dedup_fuzzy(items: DataFrame, key: str = "name", threshold: float = 0.85, conflict: str = "latest", block: Column | None = None, attrs: str | None = None, report: dict | None = None) -> DataFrame:
    """Greedy matching by similarity in the order of pos, exact for ``block=None``.

    A key's leader depends on the distinct keys and their first places only (``fuzzy.leaders``);
    ``conflict`` and ``attrs`` are as in ``dedup``.  With ``latest`` the last item of a leader is its
    content, unless a key is like several leaders: such leaders may take each other's places, and
    their items (places and keys) are folded in order, one task for each set of leaders that keys
    connect.  A block (a column) is approximate: items of different blocks never match.  ``report``
    gets how many pairs met in the index and the rounds of settling.
    """
    full, bare = _split(items, key)
    columns = [c for c in items.columns if c != "pos"]
    row = F.struct("pos", *columns)

    def lowered(keys: pd.Series) -> pd.Series:
        return keys.map(lambda x: str(x).strip().lower())

    side = F.lit("") if block is None else F.coalesce(F.concat(F.lit("b"), block.cast("string")), F.lit(""))
    named = full.withColumn("__b", side).withColumn("__k", F.pandas_udf(lowered, "string")(F.col(key)))
    keys = cut(named.groupBy("__b", "__k").agg(F.min("pos").alias("__first"), F.max("pos").alias("__last"), F.count("*").alias("__n"), F.min_by(row, "pos").alias("__head"), F.max_by(row, "pos").alias("__tail")))
    led = leaders(keys.select(F.col("__b").alias("b"), F.col("__k").alias("k"), "__first"), threshold, "__first", report).select(F.col("b").alias("__b"), F.col("k").alias("__k"), F.col("rank").alias("__rank"), F.col("lead").alias("__lead"))
    of = keys.join(led, ["__b", "__k"])
    kept = of.groupBy("__lead").agg(F.min("__first").alias("__first"), (F.sum("__n") - 1).alias("n_merged"), F.min_by("__head", "__first").alias("__head"), F.max_by("__tail", "__last").alias("__tail"))
    if conflict == "latest":
        last = _shared_latest(named, led, threshold)
        kept = (kept.join(last, "__lead", "left") if last else kept.withColumn("__own", F.lit(None))).withColumn("__row", F.coalesce("__own", "__tail"))
    elif conflict == "merge" and attrs:
        each = named.select("__b", "__k", "pos", F.explode(attrs).alias("a", "v")).groupBy("__b", "__k", "a").agg(F.min_by("v", "pos").alias("v"), F.min("pos").alias("pos"))
        each = each.join(led, ["__b", "__k"]).groupBy("__lead", "a").agg(F.min_by("v", "pos").alias("v"))
        joined = each.groupBy("__lead").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("a", "v")))).alias("__attrs"))  # distinct attribute names of one leader
        kept = kept.join(joined, "__lead", "left").withColumn("__row", F.col("__head").withField(attrs, F.coalesce("__attrs", F.col("__head")[attrs])))
    else:
        kept = kept.withColumn("__row", F.col("__head"))
    kept = kept.select(F.col("__first").alias("pos"), *(F.col("__row")[c].alias(c) for c in columns), "n_merged")
    return kept.unionByName(bare.withColumn("n_merged", F.lit(0).cast("long")))


def _shared_latest(named: DataFrame, led: DataFrame, threshold: float) -> DataFrame | None:
    """__lead, __own (a row): the latest content of leaders that keys connect with other leaders; None if there are none."""
    as_keys = led.select(F.col("__b").alias("b"), F.col("__rank").alias("rank"), F.col("__k").alias("k"), F.col("__lead").alias("lead"))
    crossed = similar(as_keys.where("rank <> lead"), as_keys.where("rank = lead"), threshold, earlier=False).withColumnRenamed("x", "rank")
    other = cut(crossed.join(as_keys.select("rank", "lead"), "rank").where("y <> lead").select(F.col("lead").alias("a"), F.col("y").alias("b")).distinct())
    if threshold <= 0 or other.isEmpty():
        return None
    tied = cut(components(other).select(F.col("node").alias("__lead"), F.col("component").alias("__c")))
    leader = led.where("__rank = __lead").select("__lead", F.col("__k").alias("__leader"))
    row = F.struct("pos", *(c for c in named.columns if c not in ("pos", "__b", "__k")))
    own = cut(named.select("__b", "__k", "pos", row.alias("__own")).join(led.join(tied, "__lead").join(leader, "__lead"), ["__b", "__k"]))
    own = cut(ranked(own, "pos", "__seq"))
    ends = cut(_latest(own.select("__c", "__seq", "__k", "__lead", "__leader"), threshold))
    return ends.join(own.select("__seq", "__own"), "__seq").select("__lead", "__own")


def _as_text(df: DataFrame, c: str) -> Column:
    """A value as it is printed: numbers as Python's str(), nothing as None."""
    kind = df.schema[c].dataType.typeName()
    text = printed(F.col(c)) if kind in ("double", "float", "boolean") else F.col(c).cast("string")
    return F.coalesce(text, F.lit("None"))


def merge_properties(props: DataFrame) -> DataFrame:
    """Of each name the first of each value_unit, as printed; ``name_pos`` is the name's first place, by which they follow.

    Two partial aggregates: neither a common name nor a common value goes to one task as rows.  The
    second is over what the first has left, which is written: ``props`` are computed once.
    """
    key = F.concat(_as_text(props, "value"), F.lit("_"), _as_text(props, "unit"))
    rows = props.withColumn("__key", key)
    one = cut(rows.groupBy("name", "__key").agg(F.min_by(F.struct(*props.columns), "pos").alias("__row")).select("__row.*"))
    first = one.groupBy(F.col("name").alias("__name")).agg(F.min("pos").alias("name_pos"))
    return one.join(first, one["name"].eqNullSafe(first["__name"])).select(*(one[c] for c in props.columns), "name_pos")


def merge_stats(individuals: DataFrame, merged: DataFrame, relationships: DataFrame | None = None, merged_relationships: DataFrame | None = None, source: str = "source", properties: DataFrame | None = None, merged_properties: DataFrame | None = None) -> DataFrame:
    """One row: inputs, *_in and final_* of individuals, properties and relationships, duplicates_removed, dedup_rate.

    Tables that are not given count as empty; inputs are the sources of the individuals.
    """
    kinds = {"individuals": (individuals, merged), "properties": (properties, merged_properties), "relationships": (relationships, merged_relationships)}
    out = individuals.agg(F.countDistinct(source).alias("inputs"))
    for kind, (before, after) in kinds.items():
        for df, name in ((before, f"{kind}_in"), (after, f"final_{kind}")):
            out = out.crossJoin(df.agg(F.count("*").alias(name))) if df is not None else out.withColumn(name, F.lit(0).cast("long"))  # one row each
    gone = F.col("individuals_in") - F.col("final_individuals") + F.col("relationships_in") - F.col("final_relationships")
    columns = [f"{k}_in" for k in kinds] + [f"final_{k}" for k in kinds]
    return out.select("inputs", *columns, gone.alias("duplicates_removed"), rounded(gone / F.greatest("individuals_in", F.lit(1)) * 100).alias("dedup_rate"))


def stats_record(stats: DataFrame) -> DataFrame:
    """``merge_stats`` as the record of a merge; conflicts are settled without being counted."""
    names = {"inputs": "input_results", "individuals_in": "total_individuals_in", "duplicates_removed": "duplicates_removed", None: "conflicts_resolved", "final_individuals": "final_individuals", "final_properties": "final_properties", "dedup_rate": "dedup_rate"}
    return stats.select(*(F.col(c).alias(n) if c else F.lit(0).cast("long").alias(n) for c, n in names.items()))


def merge_results(results: DataFrame, strategy: str = "exact", conflict: str = "latest", order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extraction results (source, individuals, properties, relationships) -> merged individuals, properties, relationships.

    The source, the first column, may be a name, a number of any size or null.  Results follow each
    other by ``order`` (a column that tells them apart; else by source, null first), and items by
    their place in the result: ``pos`` is a struct of both, so no number can overflow or collide.
    """
    def flat(column: str) -> DataFrame:
        source = F.col(results.columns[0])
        # outer: an inner generator lets the optimizer test whether the list is empty, by computing it a second time, before any shuffle
        rows = results.select((F.col(order) if order else source).alias("by"), source.alias("source"), F.posexplode_outer(column).alias("i", "x"))
        return rows.where("i IS NOT NULL").select(F.struct("by", "source", "i").alias("pos"), "source", "x.*")

    return dedup(flat("individuals"), "name", strategy, conflict), merge_properties(flat("properties")), dedup(flat("relationships"), "context", strategy, conflict)
