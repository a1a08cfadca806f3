import re

import numpy as np
import pytest

from veinmap.llm import near_dup


def shingle_sets(rows, width=5):
    out = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        out[r.doc_id] = {tuple(w)} - {()} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return out


def alike(x, y):
    both = len(x & y)
    return bool(both) and 100 * both >= 80 * (len(x) + len(y) - both)


def components_by_brute_force(rows, width=5):
    sets = shingle_sets(rows, width)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if alike(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def kept_by_brute_force(rows):
    return {i for i, c in components_by_brute_force(rows).items() if i == c}


def edited(rng, words, most):
    out = list(words)
    for at in rng.integers(0, len(words), rng.integers(0, most + 1)):
        out[at] = f"x{rng.integers(100_000)}"
    return " ".join(out)


def found(df, **how):
    return {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, **how).collect()}


def test_odd_rows(odd, none):
    got = near_dup.near_duplicates(odd, width=4).collect()
    assert len(got) == odd.count() and near_dup.near_duplicates(none).count() == 0
    by_id = {r.doc_id: r for r in got}
    assert by_id[8].component_id == 1 and not by_id[8].kept and by_id[1].kept
    assert all(by_id[i].component_id == i and by_id[i].n_shingles == 0 for i in (2, 3, 4))
    assert by_id[6].n_shingles == by_id[7].n_shingles == 1
    assert by_id[None].component_id is None and by_id[None].kept


@pytest.mark.parametrize("block,spread,turns,most", [(8, 1, 3, 9), (4, 1, 1, 14)])
def test_blocks_turns_and_pairs_of_blocks(spark, monkeypatch, block, spread, turns, most):
    for name, value in (("BLOCK", block), ("SPREAD", spread), ("TURNS", turns), ("LARGE", 3)):
        monkeypatch.setattr(near_dup, name, value)
    rng = np.random.default_rng(most)
    rows = [(i * 3, edited(rng, [f"w{k}" for k in range(120)], most)) for i in range(70)]
    rows += [(1000 + i, edited(rng, [f"u{k}" for k in range(40)], 3)) for i in range(30)]
    rows += [(2000 + i, " ".join(f"v{rng.integers(40)}" for _ in range(100))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == components_by_brute_force(docs.collect())


def test_cost_of_a_large_group(spark):
    """20,000 near copies: all pairs would be 200 million."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(100)]
    rows = [(i, edited(rng, words, 2)) for i in range(20_000)] + [(50_000 + i, edited(rng, words, 40)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    report = {}
    got = found(docs, report=report)
    assert report["turns"] <= near_dup.TURNS and report["pairs"] <= 2000
    assert {got[i] for i in range(20_000)} == {0}
    sets = shingle_sets([r for r in docs.collect() if r.doc_id % 50 == 0 or r.doc_id >= 50_000])
    for i in range(50_000, 50_060):
        if any(alike(sets[i], s) for k, s in sets.items() if k != i and got[k] == 0):
            assert got[i] == 0


def test_recall_against_all_rows(spark):
    """Links of every row whose id is divisible by 50, against all rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = shingle_sets(docs.collect(), 4)
    got = found(docs, width=4)
    links = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and alike(sets[a], sets[b])]
    assert links and all(got[a] == got[b] for a, b in links)


def look_alikes(spark, n):
    """Texts of one template of 300 words, each with 18 words of its own: all pairs are at about 0.7."""
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in range(300)]
        for j, at in enumerate(range(5, 300, 34)):
            words[at : at + 1] = [f"x{i}_{j}", f"y{i}_{j}"]
        rows.append((i, " ".join(words)))
    rows += [(n + i, rows[int(rng.integers(n))][1] + " end") for i in range(50)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("n", [1000, 4000])
def test_look_alikes_that_nothing_links_are_not_compared_in_pairs(spark, n):
    docs = look_alikes(spark, n)
    report = {}
    got = found(docs, report=report)
    assert report["pairs"] <= 200  # of n * n / 2
    sets = shingle_sets([r for r in docs.collect() if r.doc_id < 300 or r.doc_id >= n])
    assert 0.65 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    assert all(got[i] == i for i in range(n)) and all(got[i] < n for i in range(n, n + 50))


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_prefixes_lose_no_link(spark, percent):
    rng = np.random.default_rng(percent)
    sets = {}
    for i in range(150):
        base = set(range(40)) if i % 2 else set(range(20, 70))
        sets[i] = base - set(rng.integers(0, 70, rng.integers(0, 20)).tolist()) | set(rng.integers(70, 4000, rng.integers(0, 8)).tolist())
    tokens = spark.createDataFrame([(i, int(h)) for i, s in sets.items() for h in s], "rep long, h long")
    about = spark.createDataFrame([(i, i, i, len(s)) for i, s in sets.items()], "rep long, component long, block long, n long")
    got = {(r.x, r.y) for r in near_dup.candidates(near_dup.prefixes(tokens, about, percent), percent).collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert links <= got and len(got) < 150 * 149 / 2
