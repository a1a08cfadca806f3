import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np

from veinmap.llm import suffix_dedup as sd
from veinmap.operators import links


def brute(texts):
    """Rows of (n_bytes, n_removed, n_spans, sha256) by counting all strings."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + sd.DEPTH] for r in raws for i in range(len(r) - sd.DEPTH + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - sd.DEPTH + 1):
            if seen[r[i : i + sd.DEPTH]] > 1:
                gone[i : i + sd.DEPTH] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinort") for _ in range(rng.randrange(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(60) for _ in range(4)]
    docs = []
    for _ in range(n):
        parts = [prose(rng.randrange(1, 50))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 60)
            parts += [p[a : a + rng.randrange(150, 400)], prose(rng.randrange(1, 30))]
        docs.append(" ".join(parts))
    return docs + [docs[0], docs[1][: len(docs[1]) // 2], "ab" * 300, "x" * 700, "é" * 99, "é" * 101, "y" * 200, "y" * 200, passages[0] * 3]


def held(spark, texts, block=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(df, block=block).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_against_counting_all_strings(spark):
    held(spark, made(1, 40))


def test_buckets_beyond_a_block_are_halved(spark):
    held(spark, made(2, 40), block=800)


def test_a_passage_cut_everywhere(spark):
    """Every text ends its copy of one passage elsewhere, in texts of very different length."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(700)
    texts = [noise(rng.choice((5, 50, 3000))) + passage[rng.randrange(250) : 450 + rng.randrange(250)] + noise(rng.choice((0, 7, 400))) for _ in range(60)]
    held(spark, [*texts, passage, noise(200_000) + passage[100:350]], block=1200)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 1)
    held(spark, made(3, 10))


def test_heavy_kinds(spark, monkeypatch):
    monkeypatch.setattr(sd, "HEAVY", 2)
    texts = made(5, 12)
    held(spark, texts + texts[:6] * 3, block=800)


def test_classes_are_equal_strings_in_suffix_order():
    rng = np.random.default_rng(2)
    data = np.concatenate([np.frombuffer(b"abcab" * 200, np.uint8), rng.integers(97, 99, 1500).astype(np.uint8), np.frombuffer(b"a" * 700, np.uint8)])
    data = np.concatenate([data, data[300:1200], rng.integers(97, 123, 300).astype(np.uint8), data[900:2200]])
    starts = np.arange(len(data) - sd.DEPTH + 1)
    own = sd.classes(data, starts)
    strings = [data[s : s + sd.DEPTH].tobytes() for s in starts]
    assert len({(a, b) for a, b in zip(own.tolist(), strings)}) == len(set(strings)) == len(set(own.tolist()))
    assert [strings[i] for i in np.argsort(own, kind="stable")] == sorted(strings)


def test_odd_rows(odd, none):
    rows = odd.collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(odd).collect())
    short = [r for r in rows if len(r.text or "") < 10_000]
    assert [g for g in got if g[1] < 10_000] == sorted((str(r.doc_id), *b) for r, b in zip(short, brute([r.text for r in short])))
    assert [g[2] for g in got if g[1] > 10_000] == [150_000]
    assert sd.dedup(none).count() == 0


def test_the_disk_is_freed_on_the_way(spark):
    """Before the last join little is left of what the steps wrote: neither shuffle files nor tables."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passages = [noise(900) for _ in range(40)]
    texts = [noise(8_000) + rng.choice(passages)[rng.randrange(300) :] + noise(2_000) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle")}

    def tables():
        return {p: sum(f.stat().st_size for f in Path(p.removeprefix("file:")).rglob("*.parquet")) for p in links._made}

    before, made_before, conf = shuffled(), set(links._made), spark.conf.get(links._FREE)
    result = sd.dedup(df)
    size, end = sum(map(len, texts)), time.time() + 20
    while (left := sum(n for name, n in shuffled().items() if name not in before)) > size / 10 and time.time() < end:
        time.sleep(0.5)  # files go in the background
    assert left <= size / 10
    assert sum(n for p, n in tables().items() if p not in made_before) <= size / 5
    assert spark.conf.get(links._FREE) == conf
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result.collect()) == sorted(brute(texts))
