import numpy as np

import corpus_pipeline
from tests.llm.test_near_dup import kept_by_brute_force
from veinmap.llm import quality, toxicity
from veinmap.llm.common import cut

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    functions = [f for _, f in corpus_pipeline.STAGES]

    model = toxicity.learn(docs, labels)
    calm = cut(functions[0](spark, docs, DIR))
    assert {r.doc_id for r in calm.collect()} == {r.doc_id for r in toxicity.toxicity(docs, model).where("predicted = 0").collect()}
    assert calm.columns == docs.columns

    fair = cut(functions[1](spark, calm, DIR))
    judged = {r.doc_id: quality.measures(r.text, 30) for r in calm.collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in fair.collect()} == {i: (m[-1], len(m[-1])) for i, m in judged.items() if m[-2]}
    assert fair.columns == docs.columns

    single = cut(functions[2](spark, fair, DIR))
    assert {r.doc_id for r in single.collect()} == kept_by_brute_force(fair.collect())
    assert single.columns == docs.columns

    from tests.llm.test_suffix_dedup import brute

    rows = single.collect()
    left = cut(functions[3](spark, single, DIR))
    got = {r.doc_id: r for r in left.collect()}
    for r, (n_bytes, n_removed, _, _) in zip(rows, brute([r.text for r in rows]), strict=True):
        assert n_bytes - n_removed - 8 <= len(got[r.doc_id].text.encode()) <= n_bytes - n_removed
        assert got[r.doc_id].n_chars == len(got[r.doc_id].text) and got[r.doc_id].source == r.source
    pieces = functions[4](spark, left, DIR).collect()
    assert {p.doc_id for p in pieces} == set(got)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert len(corpus_pipeline.run(spark, DIR).columns) == 7


def test_components(spark):
    from veinmap.llm.common import components

    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (90, 2))] + [(5, 5)]
    root = {n: n for e in links for n in e}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != 5}
