"""Quality scores of an ontology, one aggregation per section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinmap.functions.text import grade, rounded
from veinmap.model import Ontology
from veinmap.operators.query import class_label, stats

DIMENSIONS = ("naming", "hierarchy", "semantic", "completeness", "coverage")


def _filled(c) -> F.Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def measures(o: Ontology) -> DataFrame:
    """Counts behind the scores, in one row."""
    parent = F.when(F.col("sub_class_of_present"), F.col("sub_class_of")).otherwise(F.col("parent_class"))
    has_parent = F.coalesce((F.size(parent) > 0) & ~((F.size(parent) == 1) & (F.get(parent, F.lit(0)) == "")), F.lit(False))
    c = o.classes.agg(F.count("*").alias("n_classes"), F.count_if(class_label() == "").alias("bad_classes"), F.count_if(has_parent).alias("with_parent"), F.count_if(_filled("comment")).alias("with_comment"))
    p = o.object_properties.agg(F.count("*").alias("n_object"), F.count_if(~_filled("name")).alias("bad_object"), (F.count_if(_filled("domain")) + F.count_if(_filled("range"))).alias("described"))
    d = o.datatype_properties.agg(F.count("*").alias("n_datatype"), F.count_if(~_filled("name")).alias("bad_datatype"))
    i = o.individuals.agg(F.count("*").alias("n_individuals"))
    return c.crossJoin(p).crossJoin(d).crossJoin(i)  # one row each


def validate(o: Ontology) -> DataFrame:
    """Scores of the five dimensions, total_score, grade and issues, in one row."""
    total = F.col("n_classes") + F.col("n_object") + F.col("n_datatype")
    bad = F.col("bad_classes") + F.col("bad_object") + F.col("bad_datatype")
    share = lambda a, n: F.least(F.lit(100), F.try_divide(F.lit(100.0) * a, n).cast("int"))
    scores = measures(o).select(
        F.when(total == 0, 0).otherwise((F.lit(100) * (F.lit(1.0) - F.try_divide(bad.cast("double"), total))).cast("int")).alias("naming"),
        F.when(F.col("n_classes") == 0, 0).otherwise(share(F.col("with_parent"), F.col("n_classes"))).alias("hierarchy"),
        F.when(F.col("n_object") == 0, 50).otherwise(share(F.col("described"), 2 * F.col("n_object"))).alias("semantic"),
        F.when(F.col("n_classes") == 0, 0).otherwise(share(F.col("with_comment"), F.col("n_classes"))).alias("completeness"),
        F.greatest(F.lit(50), F.least(F.lit(100), (F.floor(F.col("n_classes") / 2) + F.floor(F.col("n_individuals") / 20)))).cast("int").alias("coverage"),
    )
    sum_of = sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0]))
    scored = scores.withColumn("total_score", F.floor(sum_of / 5).cast("int"))
    told = [F.when(F.col(d) < 70, F.concat(F.lit(f"⚠️ {d}: "), F.col(d).cast("string"), F.lit("/100 — needs improvement"))).when(F.col(d) < 90, F.concat(F.lit(f"ℹ️ {d}: "), F.col(d).cast("string"), F.lit("/100 — good, can improve"))) for d in DIMENSIONS]
    issues = F.array_compact(F.array(*told))
    return scored.select("*", grade(F.col("total_score")).alias("grade"), F.when(F.size(issues) == 0, F.array(F.lit("✅ All dimensions score 90+"))).otherwise(issues).alias("issues"))


def quick_check(o: Ontology) -> DataFrame:
    """Three booleans, two ratios and ``healthy``, in one row."""
    s = stats(o)
    n = F.greatest("classes", F.lit(1))
    props = F.col("object_properties") + F.col("datatype_properties")
    out = s.select((F.col("classes") > 0).alias("has_classes"), (F.col("individuals") > 0).alias("has_individuals"), (props > 0).alias("has_properties"), rounded(F.col("individuals") / n).alias("individuals_per_class"), rounded(props / n).alias("properties_per_class"))
    return out.withColumn("healthy", F.col("has_classes") & F.col("has_individuals") & F.col("has_properties"))
