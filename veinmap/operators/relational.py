"""Projection into the relational tables, their DDL and checks of their constraints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinmap.functions.text import bare_property, first_class, formula
from veinmap.model import Ontology
from veinmap.operators.links import cut


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False
    default: str | None = None
    references: str | None = None


def _key() -> Field:
    return Field("id", "uuid", default="gen_random_uuid()")


def _material() -> Field:
    return Field("material_id", "uuid", required=True, references="materials(id)")


#: Tables, their columns and indexed columns.
TABLES: dict[str, tuple[list[Field], list[str]]] = {
    "materials": ([_key(), Field("name", "text", True), Field("chemical_formula", "text"), Field("material_type", "text"), Field("created_at", "timestamptz", default="now()"), Field("updated_at", "timestamptz", default="now()")], ["name", "material_type"]),
    "material_properties": ([_key(), _material(), Field("property_name", "text", True), Field("property_value", "float8"), Field("value_string", "text"), Field("unit", "text"), Field("source", "text"), Field("temperature", "float8"), Field("temperature_unit", "text", default="'K'"), Field("notes", "text")], ["material_id", "property_name"]),
    "material_composition": ([_key(), _material(), Field("element", "text", True), Field("weight_fraction", "float8"), Field("atomic_fraction", "float8")], ["material_id", "element"]),
    "literature_sources": ([_key(), Field("title", "text", True), Field("authors", "text[]"), Field("year", "int4"), Field("doi", "text"), Field("journal", "text"), Field("url", "text")], ["year", "doi"]),
    "irradiation_behavior": ([_key(), _material(), Field("irradiation_type", "text"), Field("fluence", "float8"), Field("fluence_unit", "text", default="'n/cm²'"), Field("temperature", "float8"), Field("property_changed", "text"), Field("change_percent", "float8")], ["material_id", "irradiation_type"]),
}
SPARK_TYPES = {"uuid": "string", "text": "string", "text[]": "array<string>", "float8": "double", "int4": "int", "timestamptz": "timestamp"}


def schema(table: str) -> str:
    """The table's Spark schema as DDL."""
    return ", ".join(f"{f.name} {SPARK_TYPES[f.kind]}" for f in TABLES[table][0])


def create_sql(table: str) -> str:
    """CREATE TABLE with keys, NOT NULL and defaults, and the indexes, for a relational store."""
    if table not in TABLES:
        raise ValueError(f"no such table: {table}")
    fields, indexed = TABLES[table]
    clause = lambda f: " ".join(x for x in (f'"{f.name}"', f.kind, "PRIMARY KEY" if f.name == "id" else "", "NOT NULL" if f.required else "", f"DEFAULT {f.default}" if f.default else "") if x)
    lines = [clause(f) for f in fields] + [f'FOREIGN KEY ("{f.name}") REFERENCES {f.references}' for f in fields if f.references]
    body = ",\n  ".join(lines)
    return "\n".join([f"CREATE TABLE IF NOT EXISTS {table} (\n  {body}\n);", *(f'CREATE INDEX IF NOT EXISTS idx_{table}_{c} ON {table}("{c}");' for c in indexed)])


def all_sql() -> str:
    return "\n\n".join(create_sql(t) for t in TABLES)


def _material_id() -> F.Column:
    """Derived, so that parents and children agree whenever they are computed."""
    return F.sha2(F.concat_ws("\x1f", F.col("name"), F.col("pos").cast("string")), 256)


def materials(o: Ontology, stamped: bool = True) -> DataFrame:
    """Rows of ``materials``; individuals without a name are skipped."""
    rows = o.individuals.where(F.coalesce(F.col("name") != "", F.lit(False)))
    out = rows.select(_material_id().alias("id"), "name", formula(F.col("name")).alias("chemical_formula"), first_class(F.col("class")).alias("material_type"))
    return out.withColumns({c: F.current_timestamp() for c in ("created_at", "updated_at")}) if stamped else out


def material_properties(o: Ontology) -> DataFrame:
    """A row for each numeric (or boolean) property of a named individual."""
    rows = o.individuals.where(F.coalesce(F.col("name") != "", F.lit(False))).select(_material_id().alias("material_id"), F.explode("nums").alias("key", "property_value")).where(F.col("key").startswith("prop_"))
    name = bare_property(F.col("key"))
    return rows.select(F.sha2(F.concat_ws("\x1f", "material_id", "key"), 256).alias("id"), "material_id", name.alias("property_name"), "property_value", F.lit("").alias("unit"), F.lit("ontology").alias("source"))


def restore_stats(o: Ontology) -> DataFrame:
    """What a restore would write: materials, properties, skipped (a dry run)."""
    named = F.coalesce(F.col("name") != "", F.lit(False))
    n_props = F.size(F.map_filter(F.coalesce("nums", F.create_map().cast("map<string,double>")), lambda k, v: k.startswith("prop_")))
    return o.individuals.groupBy().agg(F.count_if(named).alias("materials"), F.coalesce(F.sum(F.when(named, n_props).otherwise(0)), F.lit(0)).alias("properties"), F.count_if(~named).alias("skipped"))


def restore(o: Ontology, folder: str, mode: str = "append") -> None:
    """Writes both tables below ``folder``, parents first."""
    materials(o).write.mode(mode).parquet(f"{folder}/materials")
    material_properties(o).write.mode(mode).parquet(f"{folder}/material_properties")


def routed(table: str, rows: DataFrame, order: str, existing: DataFrame | None = None, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """``rows`` with ``reasons``: the constraints of ``table`` that a row breaks, none for one that can be inserted.

    ``null: <column>`` for a required column or the key; ``duplicate: id`` for a key that an earlier
    row (by ``order``) or an ``existing`` row has; ``no parent: <column>`` for a key that the ids of
    ``parents[column]`` lack.  Keys are summed up before they are joined, so a key of very many rows is
    one row of the index.
    """
    fields = TABLES[table][0]
    out = rows
    reasons = [F.when(F.col(f.name).isNull(), F.lit(f"null: {f.name}")) for f in fields if (f.required or f.name == "id") and f.name in rows.columns]
    first = rows.where("id IS NOT NULL").groupBy("id").agg(F.min(order).alias("__first"))
    out = out.join(first, "id", "left")
    taken = F.col("__first") != F.col(order)
    if existing is not None:
        out = out.join(existing.select("id", F.lit(True).alias("__there")).distinct(), "id", "left")
        taken = taken | F.col("__there")
    reasons.append(F.when(taken, F.lit("duplicate: id")))
    for f in fields:
        if f.references and f.name in (parents or {}):
            ids = parents[f.name].select(F.col("id").alias(f.name), F.lit(True).alias(f"__{f.name}")).distinct()
            out = out.join(ids, f.name, "left")
            reasons.append(F.when(F.col(f.name).isNotNull() & F.col(f"__{f.name}").isNull(), F.lit(f"no parent: {f.name}")))
    return out.select(*rows.columns, F.array_compact(F.array(*reasons)).alias("reasons"))


def insert(table: str, rows: DataFrame, folder: str, order: str, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Appends the rows that break no constraint to ``folder``; gives back the others with their reasons and an error text."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    judged = cut(routed(table, rows, order, spark.read.parquet(folder) if there else None, parents))
    judged.where(F.size("reasons") == 0).drop("reasons", order).write.mode("append").parquet(folder)
    name = F.coalesce(F.col("name"), F.lit("unknown")) if "name" in rows.columns else F.lit("unknown")
    return judged.where(F.size("reasons") > 0).withColumn("error", F.concat(F.lit("Failed to insert: "), name))


def orphans(children: DataFrame, parents: DataFrame, key: str = "material_id") -> DataFrame:
    """Children whose key no parent has (a broken foreign key)."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_anti")


def missing_values(table: str, rows: DataFrame) -> DataFrame:
    """column, n: nulls in required columns."""
    need = [f.name for f in TABLES[table][0] if (f.required or f.name == "id") and f.name in rows.columns]
    return rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in need)).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, need)), F.array(*need))).alias("column", "n"))


def verify(rows: DataFrame, sample: int = 5) -> tuple[int, DataFrame]:
    """The number of rows and a few of them."""
    return rows.count(), rows.limit(sample)
