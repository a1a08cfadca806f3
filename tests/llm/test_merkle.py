import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from veinmap.llm import merkle
from veinmap.llm.queries import ORACLES


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root, and of each leaf its siblings (left, right) by level."""
    level, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for n, j in enumerate(at):
            k = j - j % 3
            ways[n].append(("".join(level[k:j]), "".join(level[j + 1 : k + 3])))
        level, at = [h("".join(level[k : k + 3])) for k in range(0, len(level), 3)], [j // 3 for j in at]
    return level[0], ways


def expected(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, above = tree([done[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (*_, leaf, r), way in zip(sorted(groups[s], key=lambda x: x[:3]), done[s][1]):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            got = leaf_of((*r[:4], text))
            for left, right in way + up:
                got = h(left + got + right)
            out.append((r[0], leaf, done[s][0], root, h("".join(a + b for a, b in way + up)), got, got == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
DDL = "doc_id long, source string, lang string, n_chars long, text string"


def made(spark, rows, parts=7):
    df = spark.createDataFrame(rows, DDL).repartition(parts)
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle.without_line_feeds(df).collect()), key=repr)


def rows_of(n, sources):
    return [(i * 37 % 1009, sources[i * i % len(sources)], "xy" if i % 3 else None, i if i % 5 else None, None if i % 11 == 0 else "a\n" * (i % 4) + "é") for i in range(n)]


@pytest.mark.parametrize("depth, step", [(1, 1), (2, 1), (6, 6)])
def test_roots_proofs_and_folding_equal_the_definition(spark, monkeypatch, depth, step):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "STEP", step)
    rows = rows_of(300, ["a", "a", "a", None, "b", "ä", "Z", ""])
    assert made(spark, rows) == expected(rows)


def test_sizes_around_powers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "STEP", 1)
    rows = [(i, f"s{n}", None, None, "x\ny") for n in (1, 2, 3, 4, 9, 10, 27, 28, 81, 82) for i in range(n)]
    assert made(spark, rows) == expected(rows)


def test_one_leaf_odd_rows_and_repeated_rows(spark):
    one = [(5, None, None, None, None)]
    assert made(spark, one) == expected(one)
    odd = [(None, "s", "l", 1, "a\nb"), (None, "s", "l", 1, "a\nb"), (1, "s", None, None, ""), (1, "s", None, None, "long\n" * 200_000), (2, None, "l", -4, "\n"), (2, None, "l", -4, "\n")]
    assert made(spark, odd) == expected(odd)


def test_no_rows_and_extra_columns(spark):
    assert made(spark, []) == []
    rows = rows_of(20, ["a", "b"])
    df = spark.createDataFrame(rows, DDL).select("*", *(F.lit("x").alias(c) for c in ("key", "id", "digest", "leaf", "root", "n", "i", "block", "path", "__m")))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in merkle.without_line_feeds(df).collect()), key=repr)
    assert got == expected(rows)


def test_node_records_hold_every_node(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "STEP", 1)
    leaves = [h(str(i)) for i in range(100)]
    df = spark.createDataFrame([("g", i, d) for i, d in enumerate(leaves)], "key string, id long, digest string").repartition(5)
    found = {(r.level, r["at"]): r.digest for r in merkle.forest(df, inner=True).nodes.collect()}
    level, n = leaves, 0
    while True:
        for i, d in enumerate(level):
            assert n == 0 or found[n, i] == d
        if len(level) == 1:
            break
        level, n = [h("".join(level[k : k + 3])) for k in range(0, len(level), 3)], n + 1


def test_proofs_prove_leaves(spark):
    rows = rows_of(50, ["a", "b", None])
    m = merkle.manifest(spark.createDataFrame(rows, DDL))
    root = m.top.roots.first().root
    found = merkle.proofs(m).collect()
    assert len(found) == 50 and all(merkle.folded(r.leaf, r.path) == root for r in found)


def test_range_keeps_its_stack_small():
    stack = merkle.Range(3**9 + 5, 9)
    for i in range(4, 3**9):
        stack.push(0, i, h(str(i)))
        assert sum(map(len, stack.runs)) <= 2 * 9 + 2
    assert len(stack.end()) <= 4 * 9


def test_sql_is_registered():
    assert "op11_merkle_manifest" in ORACLES
