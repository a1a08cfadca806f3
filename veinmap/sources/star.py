"""The driver's star schema seen as an ontology, a graph, documents and extraction results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinmap.model import Graph, Ontology

#: Positions of customers and parts follow those of suppliers.
CUSTOMERS, PARTS = 1_000_000_000, 2_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows over all cores: millions of them lie in few splits of a file, and each is much work."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ontology(spark: SparkSession, sf_dir: str) -> Ontology:
    region, nation, supplier, customer, part = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer", "part"))
    texts = lambda *c: F.array(*c).cast("array<string>")
    top = region.select(F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("class_name"), F.concat(F.lit("region "), F.lower("r_name")).alias("comment"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("array<string>").alias("sub_class_of"), F.lit(False).alias("sub_class_of_present"), F.lit(None).cast("array<string>").alias("parent_class"))
    below = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    below = below.select((F.col("n_nationkey") + 100).cast("long").alias("pos"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("class_name"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("nation of "), "r_name")).alias("comment"), F.lit(None).cast("string").alias("uri"), texts("r_name").alias("sub_class_of"), F.lit(True).alias("sub_class_of_present"), F.lit(None).cast("array<string>").alias("parent_class"))
    fixed = "pos long, name string, domain string, range string, uri string"
    objects = spark.createDataFrame([(0, "locatedIn", "supplier", "nation", None), (1, "buysFrom", "customer", None, None), (2, "partOf", None, None, None)], fixed)
    datatypes = spark.createDataFrame([(0, "acctbal", "customer", "xsd:double", None), (1, "size", "part", "xsd:int", None), (2, "", None, None, None)], fixed)
    names = nation.select("n_nationkey", "n_name")
    nothing = F.lit(None).cast("array<string>")
    one = lambda key, c: F.create_map(F.lit(key), c)
    sup = supplier.join(F.broadcast(names), supplier.s_nationkey == names.n_nationkey).select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), texts("n_name").alias("class"), F.lit(False).alias("class_is_list"), nothing.alias("type"), F.lit(False).alias("type_is_list"), nothing.alias("classes"), one("prop_level", F.floor("s_acctbal").cast("string")).alias("attrs"), one("prop_acctbal", F.col("s_acctbal")).alias("nums"))
    cus = customer.join(F.broadcast(names), customer.c_nationkey == names.n_nationkey).select((F.col("c_custkey") + CUSTOMERS).alias("pos"), F.col("c_name").alias("name"), texts("n_name").alias("class"), F.lit(False).alias("class_is_list"), texts("c_mktsegment").alias("type"), F.lit(False).alias("type_is_list"), nothing.alias("classes"), one("prop_level", F.floor("c_acctbal").cast("string")).alias("attrs"), one("prop_acctbal", F.col("c_acctbal")).alias("nums"))
    par = part.select((F.col("p_partkey") + PARTS).alias("pos"), F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")).alias("name"), nothing.alias("class"), F.lit(False).alias("class_is_list"), texts("p_type", "p_brand").alias("type"), F.lit(True).alias("type_is_list"), texts("p_type").alias("classes"), one("prop_size", F.col("p_size").cast("string")).alias("attrs"), F.create_map(F.lit("prop_size"), F.col("p_size").cast("double"), F.lit("prop_retailprice"), F.col("p_retailprice")).alias("nums"))
    return Ontology(top.unionByName(below), objects, datatypes, sup.unionByName(cus).unionByName(par))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers and suppliers, joined by their foreign keys."""
    region, nation, supplier, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    node = lambda df, prefix, key, name, kind: df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"))
    edge = lambda df, base, pos, a, key, b, to, kind: df.select((F.col(pos) + base).cast("long").alias("pos"), F.concat(F.lit(a), F.col(key).cast("string")).alias("from"), F.concat(F.lit(b), F.col(to).cast("string")).alias("to"), F.lit(kind).alias("type"))
    nodes = node(region, "r", "r_regionkey", "r_name", "class").unionByName(node(nation, "n", "n_nationkey", "n_name", "class")).unionByName(node(customer, "c", "c_custkey", "c_name", "individual")).unionByName(node(supplier, "s", "s_suppkey", "s_name", "individual"))
    edges = edge(nation, 0, "n_nationkey", "n", "n_nationkey", "r", "n_regionkey", "within").unionByName(edge(customer, CUSTOMERS, "c_custkey", "c", "c_custkey", "n", "c_nationkey", "lives_in")).unionByName(edge(supplier, PARTS, "s_suppkey", "s", "s_suppkey", "n", "s_nationkey", "lives_in"))
    return Graph(nodes, edges)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each conversation as a document with a heading per turn."""
    c = read(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("## "), x["role"], F.lit(" "), x["turn"].cast("string"), F.lit("\n"), x["text"])), "\n").alias("text"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a sentence of facts about each part."""
    size = F.col("p_size").cast("string")
    return dealt(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(F.lit("The U-"), size, F.lit("Mo alloy has density: "), size, F.lit(".5 g/cm3, hardness is "), size, F.lit(" HV and stays γ phase from "), size, F.lit("-"), (F.col("p_size") + 100).cast("string"), F.lit(" K with "), size, F.lit(" wt% Mo.")).alias("text"),
    )


def long_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each document, a sentence of facts, and the document again."""
    i, text = F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    alloy = (F.col("doc_id") % 90 + 1).cast("string")
    fact = F.concat(F.lit(". The U-"), alloy, F.lit("Mo alloy has density: "), i, F.lit(".5 g/cm3, hardness is "), i, F.lit(" HV from 25–"), i, F.lit(" K. "))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(text, fact, text).alias("text"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, source, name, attrs: extracted individuals, one result per brand."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("source"), F.col("p_name").alias("name"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.col("p_brand"), F.col("p_partkey").cast("string")).alias("attrs"))
