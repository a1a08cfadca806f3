import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veinmap.llm import simhash
from veinmap.llm.common import table


def print_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for w in words]
    own = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Smallest id reachable; prints: id -> fingerprint."""
    f = np.array(list(prints.values()), np.uint64)
    ids, label = list(prints), np.arange(len(f))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            if label[i] != label[j]:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    least = {}
    for i, c in zip(ids, label):
        least[c] = min(least.get(c, i), i)
    return {i: least[c] for i, c in zip(ids, label)}


def rows_of(df, **options):
    return sorted((tuple(r) for r in simhash.simhash(df, **options).select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    prints = {r.doc_id: print_of(r.text) for r in docs.collect()}
    found = classes(prints)
    assert rows_of(docs) == sorted(((i, f"{f:016x}", found[i]) for i, f in prints.items()), key=repr)


def test_odd_texts(spark, odd, none):
    prints = {r.doc_id: print_of(r.text) for r in odd.collect() if r.doc_id is not None}
    found = classes(prints)
    expected = [(r.doc_id, f"{print_of(r.text):016x}", found.get(r.doc_id)) for r in odd.collect()]
    assert rows_of(odd) == sorted(expected, key=repr)
    assert found[4] == 2 and rows_of(none) == []


def test_extra_columns_and_the_bound(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "A  B\tC"), (3, "")], "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("f", "mask", "key", "component_id", "first")))
    got = {i: (f, c) for i, f, c in rows_of(df)}
    assert got[1] == got[2] and got[1][1] == 1 and got[3] == ("0" * 16, 3)


def test_a_very_long_text_is_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5_000))
    for size in (1, 2, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "PART", size)
        assert all(simhash.fingerprint(t) == print_of(t) for t in (text, "a", " a b ", "a b c", "a b c d", "\n", "A" * 300))


def clouds(rng, n):
    """Fingerprints at random, and around a few centers."""
    f = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    for center in range(5):
        own = f[center] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(n // 10)], np.uint64)
        f[center * (n // 10) : (center + 1) * (n // 10)] = own
    return np.unique(f)


@pytest.mark.parametrize("sizes", [[1, 2, 3, 63, 64, 65, 200, 1], [500], [130] * 4, [2] * 150])
def test_bit_slices_find_all_pairs_of_groups(sizes):
    rng = np.random.default_rng(sum(sizes))
    f = clouds(rng, 3 * sum(sizes))
    f = rng.permutation(f)[: sum(sizes)]
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(f)].clip(max=len(f))
    got = sorted((int(i), int(j)) for a, b in simhash.near(f, ends) for i, j in zip(a, b))
    assert got == [(i, j) for i in range(len(f)) for j in range(i + 1, int(ends[i])) if int(f[i] ^ f[j]).bit_count() <= 3]


@pytest.mark.parametrize("group", [8, 40, 4096])
def test_masks_lose_no_link(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(group)
    f = clouds(rng, 300 if group == 8 else 1500)
    df = spark.createDataFrame([(int(x),) for x in f.astype(np.int64)], "f long").repartition(4)
    report = {}
    links = simhash.components(simhash._links(simhash.groups(df, report)))
    assert (report["divided"] > 0) == (group < 100)
    found = {r.node: r.component for r in links.collect()}
    expected = classes({int(x): int(np.uint64(np.int64(x))) for x in f.astype(np.int64)})
    assert {k: found.get(k, k) for k in expected} == expected


def test_pigeonhole():
    for masks in (simhash.first_masks(), *(simhash.divided(m) for m in simhash.first_masks()[:2])):
        assert all(any(not set(m) & set(bits) for m in masks) for bits in ([0, 1, 2], [5, 6, 7], [61, 62, 63]) if not set(bits) & set.intersection(*map(set, masks)))
