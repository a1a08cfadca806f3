"""Merging of results by any source, and fuzzy leaders on large inputs."""

import random
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinmap.operators import fuzzy, merge

RESULT = "struct<name:string,value:string>"


def results(spark, rows, kind):
    ddl = f"source {kind}, individuals array<{RESULT}>, properties array<struct<name:string,value:double,unit:string>>, relationships array<struct<context:string>>"
    return spark.createDataFrame([(s, [(n, v) for n, v in own], [(n, 1.0, "u") for n, _ in own], [(n,) for n, _ in own]) for s, own in rows], ddl)


@pytest.mark.parametrize("kind, sources", [("string", ["paper-1", "paper-2", "zeta", None]), ("long", [1 << 44, (1 << 44) + 1, (1 << 63) - 1, -5]), ("timestamp", [None])])
def test_results_of_any_source(spark, kind, sources):
    rows = [(s, [("A", f"{s}/0"), ("b", f"{s}/1"), ("A ", f"{s}/2")]) for s in sources]
    individuals, properties, relationships = merge.merge_results(results(spark, rows, kind))
    order = sorted(sources, key=lambda s: (s is not None, s))
    got = sorted((r.name.strip().lower(), r.value, r.n_merged) for r in individuals.collect())
    assert got == [("a", f"{order[-1]}/2", 2 * len(sources) - 1), ("b", f"{order[-1]}/1", len(sources) - 1)]
    assert sorted(r.name for r in properties.collect()) == ["A", "A ", "b"] and relationships.count() == 2


def test_results_by_an_order_of_their_own(spark):
    df = results(spark, [("z", [("A", "1")]), ("a", [("A", "2")])], "string").withColumn("at", F.when(F.col("source") == "z", 0).otherwise(1))
    for strategy in ("exact", "fuzzy"):
        assert [r.value for r in merge.merge_results(df, strategy, order="at")[0].collect()] == ["2"]


def test_a_result_of_two_million_items(spark):
    n = 2_000_000
    df = spark.range(1).select(F.lit("big").alias("source"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.concat(F.lit("x"), (i % 10).cast("string")).alias("name"), i.cast("string").alias("value"))).alias("individuals"))
    df = df.withColumn("properties", F.expr("CAST(array() AS array<struct<name:string,value:double,unit:string>>)")).withColumn("relationships", F.expr("CAST(array() AS array<struct<context:string>>)"))
    got = sorted((r.name, r.value, r.n_merged) for r in merge.merge_results(df)[0].collect())
    assert got == [(f"x{k}", str(n - 10 + k), n // 10 - 1) for k in range(10)]


def fold(keys, threshold):
    out, lead = {}, []
    for k in keys:
        out[k] = next((s for s in lead if fuzzy.ratio_reaches(k, s, threshold)), None)
        if out[k] is None:
            lead.append(k)
            out[k] = k
    return out


@pytest.mark.parametrize("threshold, alphabet, size", [(0.85, "ab1-", 9), (0.7, "abcdefgh", 7), (0.6, "xyz", 5), (1.2, "ab", 4), (0.0, "ab", 4), (0.9, "abcdef ", 60)])
def test_leaders_equal_the_fold(spark, monkeypatch, threshold, alphabet, size):
    monkeypatch.setattr(fuzzy, "FIRST", 40)
    monkeypatch.setattr(fuzzy, "STRETCH", 32)
    rng = random.Random(size)
    base = ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(20)]
    keys = []
    for _ in range(200):
        k = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            k[rng.randrange(len(k))] = rng.choice([*alphabet, ""])
        keys.append("".join(k) or "a")
    keys = list(dict.fromkeys(keys))
    df = spark.createDataFrame([("", k, i) for i, k in enumerate(keys)], "b string, k string, at long").repartition(3)
    found = {r.k: keys[r.lead] for r in fuzzy.leaders(df, threshold, "at").collect()}
    assert found == fold(keys, threshold)


def test_an_independent_set_in_one_large_component(spark):
    n = 100_000
    rng = np.random.default_rng(4)
    edges = {(i, i - 1) for i in range(1, n)} | {(max(a, b), min(a, b)) for a, b in rng.integers(0, n, (n, 2)).tolist() if a != b}
    before = {}
    for x, y in edges:
        before.setdefault(x, []).append(y)
    leads = np.zeros(n, bool)
    for x in range(n):
        leads[x] = not any(leads[y] for y in before.get(x, ()))
    report = {}
    df = spark.createDataFrame(list(edges), "x long, y long").repartition(8)
    got = sorted(r["rank"] for r in fuzzy.independent(spark.range(n).withColumnRenamed("id", "rank"), df, report).collect())
    assert got == np.flatnonzero(leads).tolist() and report["rounds"] <= n // fuzzy.STRETCH + 1


def test_twenty_thousand_distinct_names_in_a_minute(spark):
    rng = random.Random(5)
    names = list(dict.fromkeys("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(6, 14))) for _ in range(20_000)))
    names[100:200] = [f"{n[:-1]}#" for n in names[:100]]
    df = spark.createDataFrame([(i, n, str(i)) for i, n in enumerate(names)], "pos long, name string, source string").repartition(8)
    report, began = {}, time.time()
    got = merge.dedup_fuzzy(df, report=report).collect()
    took = time.time() - began
    assert took < 200, took  # half a minute on four cores
    assert report["met"] < len(names) ** 2 / 100
    assert 50 <= len(names) - len(got) < 1000 and sum(r.n_merged + 1 for r in got) == len(names)


def test_common_subsequences():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert fuzzy.common(fuzzy.places(a), len(a), b) == best[-1][-1]
