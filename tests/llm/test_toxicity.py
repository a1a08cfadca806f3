import zlib

import numpy as np

from veinmap.llm import toxicity


def area(score, y):
    """Share of pairs of a toxic and a clean row in which the toxic one scores higher; ties count half."""
    toxic, clean = score[y == 1][:, None], score[y == 0]
    return ((toxic > clean) + (toxic == clean) / 2).mean()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    rows = toxicity.toxicity(docs, model).join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    score, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    assert area(score, y) > 0.97
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97


def test_held_out_labels_are_never_learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) toxic")
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and a[2] == b[2]


def test_offending_sentences_and_odd_rows(spark, odd, none):
    rows = [(i, f"A plain line number {i}. " + ("You utter grubnik! " if i % 2 else "You kind friend! ") + "Then more words.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic"))
    got = toxicity.toxicity(docs, model).collect()
    assert all([o.sentence for o in r.offending] == ([1] if r.doc_id % 2 else []) and r.predicted == r.doc_id % 2 for r in got)
    assert sorted(r.score for r in toxicity.toxicity(odd, model).collect() if r.doc_id in (2, 3, 4)) == [0, 0, 0]
    assert toxicity.toxicity(odd, model).count() == odd.count()
    assert toxicity.toxicity(none, toxicity.learn(none, docs.selectExpr("doc_id", "1 toxic"))).count() == 0


def test_long_clean_texts_stay(spark):
    bucket = lambda w: zlib.crc32(w) % toxicity.BUCKETS
    model = np.array(sorted([bucket(b"grubnik"), bucket(b"meh")]), np.int32), np.zeros(2, np.float32), -8.8
    for word, weight in ((b"grubnik", 14.0), (b"meh", 4.2)):
        model[1][np.searchsorted(model[0], bucket(word))] = weight
    n = 100_000
    plain = ["A plain line of words."] * n
    weak = [("This is meh." if i % 200 == 0 else s) for i, s in enumerate(plain)]
    bad = [*weak[: n // 2], "You grubnik!", *weak[n // 2 :]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((plain, weak, bad, plain[:10]))], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    assert [got[i].predicted for i in range(4)] == [0, 0, 1, 0]
    assert 0 < got[3].score < got[0].score == got[1].score < toxicity.LEAK and got[0].n_sentences == n
    assert [o.sentence for o in got[2].offending] == [n // 2] and not got[1].offending
    assert sorted(r.doc_id for r in toxicity.drop_toxic(docs, model).collect()) == [0, 1, 3]


def test_gradient_of_the_noisy_or():
    rng = np.random.default_rng(2)
    z, doc_of, y = rng.normal(-1, 3, 40), np.arange(40) % 9, rng.integers(0, 2, 9).astype(float)
    n = rng.integers(1, 300, 9)
    value, grad = toxicity.loss(z, doc_of, y, n)
    q = np.maximum((1 / (1 + np.exp(-z)) - toxicity.FLOOR) / (1 - toxicity.FLOOR), 0)
    assert 0 < (q == 0).sum() < 20
    p = [1 - (1 - toxicity.LEAK * n[d] / (n[d] + toxicity.LEAK_HALF)) * np.prod(1 - q[doc_of == d]) for d in range(9)]
    assert np.isclose(value, -np.mean([np.log(p[d]) if y[d] else np.log(1 - p[d]) for d in range(9)]))
    for i in range(40):
        step = np.zeros(40)
        step[i] = 1e-5
        assert np.isclose((toxicity.loss(z + step, doc_of, y, n)[0] - toxicity.loss(z - step, doc_of, y, n)[0]) / 2e-5, grad[i], atol=1e-6)


def test_scores_against_the_definition(spark):
    """Each score from the weights, word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocab, weights, bias = model = toxicity.learn(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    known = dict(zip(vocab.tolist(), weights.tolist()))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    for r in docs.collect():
        n = len(toxicity.sentences(r.text))
        clean = 1 - toxicity.LEAK * n / (n + toxicity.LEAK_HALF)
        for s in toxicity.sentences(r.text):
            own = [known[b] for w in s for b in toxicity.buckets(w) if b in known]
            q = 1 / (1 + np.exp(-bias - sum(own)))
            clean *= 1 - (max(0.0, (q - toxicity.FLOOR) / (1 - toxicity.FLOOR)) if own else 0.0)
        assert np.isclose(got[r.doc_id], 1 - clean, atol=1e-6)


def test_training_and_scoring_are_one_formula(spark):
    """The loss that training minimises is the log loss of the scores that the operator gives."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    rows = toxicity.toxicity(docs, model).join(labels, "doc_id").where("NOT held_out").select("doc_id", "score", "toxic", "n_sentences").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    known, at, z, doc_of = dict(zip(model[0].tolist(), model[1].tolist())), [r.doc_id for r in rows], [], []
    for n, i in enumerate(at):
        for s in toxicity.sentences(texts[i]):
            if own := [known[b] for w in s for b in toxicity.buckets(w) if b in known]:
                z.append(model[2] + sum(own))
                doc_of.append(n)
    y, p = np.array([r.toxic for r in rows], float), np.array([r.score for r in rows]).clip(1e-9, 1 - 1e-9)
    n = np.array([r.n_sentences for r in rows])
    assert np.isclose(toxicity.loss(np.array(z), np.array(doc_of), y, n)[0], -np.mean(y * np.log(p) + (1 - y) * np.log1p(-p)), atol=1e-5)


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [(i, "You utter grubnik. " * 50 if i % 2 else "You kind friend. " * 50) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    assert len(toxicity.learn(docs, labels, max_total=100)[0]) == 0 and len(toxicity.learn(docs, labels)[0])


def test_long_texts_are_scored_but_not_learned_from(spark):
    rows = [(i, "You utter grubnik. " * 20 if i % 2 else "You kind friend. " * 20) for i in range(60)] + [(100 + i, "so long a text " * 400) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id >= 100 or doc_id % 2 = 1 as int) toxic")
    model = toxicity.learn(docs, labels, max_bytes=1000)
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, model).collect()}
    assert all(got[i] == i % 2 for i in range(60)) and all(got[100 + i] == 0 for i in range(40))
