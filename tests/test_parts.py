"""Documents in many rows: results equal the whole text's for any cut."""

import random

import pytest
from pyspark.sql import functions as F

from veinmap.operators import extract, parts, segment


def cut_at_random(rng, text):
    places = sorted(rng.choices(range(len(text) + 1), k=rng.randrange(0, 12)))
    ends = [*places, len(text)]
    return [text[a:b] or None for a, b in zip([0, *places], ends)]


@pytest.fixture
def both(spark):
    def make(texts, seed=1):
        rng = random.Random(seed)
        rows = [(i, n, p) for i, t in enumerate(texts) for n, p in enumerate(cut_at_random(rng, t))]
        rng.shuffle(rows)
        return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, part int, text string").repartition(3)

    return make


def same(a, b, columns):
    rows = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    one, other = rows(a), rows(b)
    assert not [x for x in zip(one, other) if x[0] != x[1]][:2] and len(one) == len(other)


@pytest.mark.parametrize("size, overlap", [(10, 0), (16, 5), (4, 9), (4000, 200)])
def test_fixed_chunks(both, size, overlap):
    rng = random.Random(size)
    whole, many = both(["".join(rng.choice("ab \né") for _ in range(rng.randrange(0, 90))) for _ in range(80)])
    same(segment.segment_fixed(whole, size, overlap), parts.segment_fixed(many, size, overlap), ["doc_id", "index", "start_char", "end_char", "content"])


@pytest.mark.parametrize("least", [0, 8])
def test_headings(both, least):
    rng = random.Random(least)
    bits = ["# ", "## ", "#", "\n", "\n", "\n\n", "a", "bé c", " ", "####### x", "# T\n", "#tag"]
    whole, many = both(["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(400)])
    same(segment.segment_headings(whole, least), parts.segment_headings(many, least), ["doc_id", "index", "title", "content", "start_char", "end_char", "level"])


@pytest.mark.parametrize("window", [0, 2, 7, 5000])
def test_keywords(both, monkeypatch, window):
    monkeypatch.setattr(parts, "CELL", 16)
    rng = random.Random(window)
    whole, many = both(["".join(rng.choice("aAbk \n") for _ in range(rng.randrange(0, 70))) for _ in range(60)])
    same(segment.segment_keywords(whole, ["ab", "k", "aa"], window), parts.segment_keywords(many, ["ab", "k", "aa"], window), ["doc_id", "index", "keyword", "match_position", "start_char", "end_char", "content"])


def test_extraction(both, monkeypatch):
    monkeypatch.setattr(parts, "PIECE", 5)
    rng = random.Random(5)
    bits = ["U", "Mo", "-10", "-5Zr", ".", " ", "\n", "density", "hardness", " is ", ": ", "15", "7.5", "GPa", "°C", "K", "–", "γ phase", "wt%", ", ", "; ", "(", "the "]
    whole, many = both(["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(400)])
    same(extract.extract(whole), parts.extract(many), ["doc_id", "individuals.name", "properties", "relationships", "temperature_ranges", "text_length", "total_items"])


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, part int, text string")
    assert parts.segment_fixed(none).count() == parts.segment_headings(none).count() == parts.segment_keywords(none, ["a"]).count() == parts.extract(none).count() == 0


def test_a_long_document_is_not_held(spark):
    df = spark.range(400).select(F.lit(1).alias("doc_id"), F.col("id").alias("part"), F.expr("repeat('some text of a line\n', 2000)").alias("text"))
    assert parts.segment_fixed(df).agg(F.max("end_char")).first()[0] == 400 * 2000 * 20
