import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veinmap.operators import segment


def windows(text, keywords, window):
    """Greedy windows, keyword by keyword."""
    low, kept, out = text.lower(), [], []
    for k in keywords:
        at = low.find(k.lower())
        while at >= 0:
            if all(abs(at - s) >= window for s in kept):
                kept.append(at)
                a, b = max(0, at - window), min(len(text), at + window)
                if text[a:b].strip():
                    out.append((len(out), k, at, a, b))
            at = low.find(k.lower(), at + len(k))
    return out


def test_keyword_windows_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {}
    for r in segment.segment_keywords(docs, ["license", "than"], 300).orderBy("doc_id", "index").collect():
        got.setdefault(r.doc_id, []).append((r["index"], r.keyword, r.match_position, r.start_char, r.end_char))
    want = {r.doc_id: w for r in docs.collect() if (w := windows(r.text, ["license", "than"], 300))}
    assert got == want


@pytest.mark.parametrize("window", [0, 1, 3, 50, 10**9])
def test_keyword_windows_on_random_texts(spark, window):
    rng = random.Random(window)
    texts = ["".join(rng.choice("aAb ékK\n") for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in segment.segment_keywords(df, ["ab", "A", "k "], window).orderBy("doc_id", "index").collect():
        got.setdefault(r.doc_id, []).append((r["index"], r.keyword, r.match_position, r.start_char, r.end_char))
        assert r.content == texts[r.doc_id][r.start_char : r.end_char].strip()
    assert got == {i: w for i, t in enumerate(texts) if (w := windows(t, ["ab", "A", "k "], window))}


def test_a_hundred_thousand_matches(spark):
    df = spark.createDataFrame([(1, "keyword abc " * 100_000)], "doc_id long, text string")
    began = time.time()
    assert segment.segment_keywords(df, ["abc", "KEYWORD"], 4).agg(F.count("*"), F.max("index")).first()[:] == (200_000, 199_999)
    assert segment.segment_keywords(df, ["abc", "KEYWORD"], 600).count() == 2_000
    assert time.time() - began < 20


def fold(chunks, least):
    out = []
    for title, content, start, end, level in chunks:
        if out and len(out[-1][1]) < least:
            t, c, s, _, v = out[-1]
            out[-1] = (f"{t} + {title}", f"{c}\n\n{content}", s, end, v)
        else:
            out.append((title, content, start, end, level))
    return out


@pytest.mark.parametrize("least", [1, 5, 40, 10**9])
def test_folding_rows_equals_folding_a_list(spark, least):
    rng = random.Random(least)
    texts = ["".join(rng.choice(["# h\n", "## é\n", "a", "bc\n", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    columns = ("title", "content", "start_char", "end_char", "level")
    rows = lambda least: [(r["index"], *(r[c] for c in columns)) for r in segment.segment_headings(df, least).collect()]
    docs, want = [], []
    for index, *chunk in rows(0):
        if index == 0:
            docs.append([])
        docs[-1].append(tuple(chunk))
    for own in docs:
        want += [(i, *c) for i, c in enumerate(fold(own, least))]
    assert rows(least) == want


def test_a_hundred_thousand_headings(spark):
    df = spark.createDataFrame([(1, "# h\nbody text\n" * 100_000)], "doc_id long, text string")
    began = time.time()
    assert segment.segment_headings(df, 50).count() == 20_000
    assert time.time() - began < 20


def test_fixed_cuts_cover_the_text():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randrange(1, 200)))
        size, overlap = rng.randrange(2, 40), rng.randrange(0, 20)
        cuts = segment.fixed_cuts(text, size, overlap)
        if not text.strip():
            assert cuts == []
            continue
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
        assert all(a < c <= b for (a, b), (c, _) in zip(cuts, cuts[1:])) and all(0 < b - a <= size for a, b in cuts)


def test_headings_do_not_begin_inside_each_other(spark):
    """Sections against Python's ``re``, match by match."""
    rng = random.Random(9)
    bits = ["# ", "## ", "#", "\n", "\n\n", "a", "bé c", " ", "####### x", "# T\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(500)]
    want = []
    for i, t in enumerate(texts):
        found = list(re.finditer(r"^(#{1,6})\s+(.+)$", t, re.MULTILINE))
        own = [("preamble", t[: found[0].start()].strip(), 0, found[0].start(), 0)] if found else [("full_document", t.strip(), 0, len(t), 0)]
        stops = [m.start() for m in found[1:]] + [len(t)]
        own += [(m[2].strip(), t[m.end() : stop].strip(), m.start(), stop, len(m[1])) for m, stop in zip(found, stops)]
        want += [(i, n, *x) for n, x in enumerate(x for x in own if x[1] or not found)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    columns = ("doc_id", "index", "title", "content", "start_char", "end_char", "level")
    assert sorted(tuple(r[c] for c in columns) for r in segment.segment_headings(df, 0).collect()) == sorted(want)
