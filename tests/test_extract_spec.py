"""Extraction against the patterns as Python's ``re`` reads them, and on texts that make loops long."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veinmap.operators import extract

#: What the patterns accept, in Python's dialect.
ALLOY = re.compile(r"\b([A-Z][a-z]?(?:-\d+\.?\d*(?:[A-Z][a-z]?)?)+)\b")
FACT = re.compile(r"([\w\s]+?)(?:[:=]\s*| is\s+| of\s+)(\d+\.?\d*)\s*([°%\w/³²·]+)")
SPAN = re.compile(r"(\d+\.?\d*)\s*[–\-]\s*(\d+\.?\d*)\s*(°[CF]|K)")
SHARE = re.compile(r"(\d+\.?\d*)\s*(wt%|at%|vol%|mol%)")


def named(name):
    name = name.strip().lower()
    return next((p for p, words in extract.KEYWORDS.items() if any(w in name for w in words)), None)


def expected(text):
    alloys = [n for n in dict.fromkeys(m[1] for m in ALLOY.finditer(text)) if len(n) >= 3]
    facts = [(p, float(m[2]), m[3], m[1].strip().lower(), m[0]) for m in FACT.finditer(text) if (p := named(m[1]))]
    spans = [(float(m[1]), float(m[2]), m[3]) for m in SPAN.finditer(text)]
    return alloys, facts, spans, [(float(m[1]), m[2]) for m in SHARE.finditer(text)]


def found(spark, texts):
    t = F.col("text")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", extract.alloys(t).alias("a"), extract.properties(t).alias("f"), extract.temperatures(t).alias("s"), extract.percentages(t).alias("p"))
    return [([x.name for x in r.a], [(x.name, x.value, x.unit, x.raw_name, x.context) for x in r.f], [(x.min, x.max, x.unit) for x in r.s], [(x.value, x.unit) for x in r.p]) for r in df.orderBy("i").collect()]


def made(rng):
    bits = ["U", "Mo", "-10", "-5Zr", "-1.5", "2.", " ", "  ", "\n", "density", "hardness", "k", " is ", " of ", ": ", "=", ":", "15", "7.5", "8", "GPa", "g/cm³", "°C", "K", "–", "-", " - ", "wt%", " at%", "x", "_", ".", ",", "é", "the"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))


def test_random_texts_against_python(spark):
    rng = random.Random(8)
    texts = [made(rng) for _ in range(6000)] + ["U-10Mo-5x", "U-10. x", "U-10.-5Mo and U-10.x", " of 5 is 6 kg", "density: 5 g: 6 k", "density of 1 is 2 of 3 k", "a k::5 g"]
    got = found(spark, texts)
    wrong = [(t, g, e) for t, g in zip(texts, got) if g != (e := expected(t))]
    assert not wrong[:5]


def test_random_numbers_and_capitals_against_python(spark):
    rng = random.Random(12)
    bits = ["-", "-", "1", "22", ".", ".", "U", "Mo", "A", "x", "_", " ", "é", "-1.", "-2.5", "-3Zr"]
    texts = ["U" + "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    t = F.col("text")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("text", F.transform(extract.alloys(t), lambda a: a["name"]).alias("a"))
    wrong = [(r.text, r.a, e) for r in df.collect() if r.a != (e := expected(r.text)[0])]
    assert not wrong[:5]


@pytest.mark.parametrize("text", ["U-" + "1" * 100_000 + "_", "U-" + "1" * 100_000 + ".x", "U-1." + "2" * 100_000 + "x", "U" + "-1." * 50_000 + "-5Mox", ("U-" + "1" * 300 + "x ") * 300])
def test_digits_take_linear_time(spark, text):
    df = spark.createDataFrame([(text,)], "text string").select(F.size(extract.alloys(F.col("text"))).alias("n"))
    df.collect()
    began = time.time()
    df.collect()
    assert time.time() - began < 2


@pytest.mark.parametrize("text,sizes", [
    ("word " * 20_000 + ". density: 5 g", (0, 1, 0, 0)),
    ("density " * 20_000, (0, 0, 0, 0)),
    ("hardness is " * 20_000 + "5 HV", (0, 1, 0, 0)),
    ("U" + "-10Mo" * 100_000, (1, 0, 0, 0)),
    ("1" * 100_000 + "-2K", (0, 0, 1, 0)),
    ("1.2" * 30_000 + " wt%" + " " * 100_000 + "x", (0, 0, 0, 1)),
    ("density: 5 " + "g" * 200_000, (0, 1, 0, 0)),
    ("density: 5 g, " * 20_000, (0, 20_000, 0, 0)),
], ids=range(8))
def test_long_texts(spark, text, sizes):
    (got,) = found(spark, [text])
    assert tuple(map(len, got)) == sizes
