import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from veinmap.llm import fingerprint as fp


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def likeness(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def held(rows, texts):
    ids = sorted(texts)
    assert sorted(r.doc_id for r in rows) == ids
    near, seen = [], {}
    for r in rows:
        text, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), r.doc_id
        near += [abs(r.near_edited - likeness(text, edited)), abs(r.near_next - likeness(text, after))]
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == 16 * min(fp.K, len(grams(text)))
    assert np.mean(near) < 0.02 and max(near) < 0.25


def test_against_full_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held(fp.fingerprints(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(fp.bucketed, "__defaults__", (3, 7))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 7 < 3 or doc_id > 150")
    held(fp.fingerprints(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_odd_rows(odd, none):
    rows = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = fp.fingerprints(rows).collect()
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    assert {r.doc_id: r.n_chars for r in got} == {i: len(t) for i, t in texts.items()}
    assert {r.doc_id for r in got if r.fingerprint == ""} == {2, 3, 4}
    every = fp.fingerprints(odd).collect()
    apart = next(r for r in every if r.doc_id is None)
    assert len(every) == odd.count() and apart.n_chars == 27 and apart.fingerprint and apart.edited_sha256 is None and apart.near_edited is None and apart.near_next is None
    assert fp.fingerprints(none).count() == 0
    one = fp.fingerprints(rows.where("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256((texts[1][:24] + texts[1][:24]).encode()).hexdigest()


def test_merging_containment_and_counts(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(words[:2000]), " ".join(words[1000:]), " ".join(words[:1000]))], "a string, b string, c string")
    a, b, c = (fp.sketch(F.col(x), 512) for x in "abc")
    r = df.select(fp.resemblance(a, b, 512).alias("r"), fp.containment(c, a, 512).alias("c"), fp.distinct_shingles(a, 512).alias("n"), (fp.merged(a, b, 512) == fp.merged(b, a, 512)).alias("m")).first()
    assert abs(r.r - 1 / 3) < 0.07 and r.c > 0.85 and abs(r.n - 1996) < 300 and r.m
