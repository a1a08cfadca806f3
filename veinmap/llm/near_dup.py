"""MinHash near-duplicates by tensored banding.

A table of the classical scheme hashes four minhashes together, and over a hundred tables need
hundreds of them.  Here two small collections of ``SIDE`` half-keys (``HALF`` minhashes each) are
computed, and table (i, j) is keyed by half i of the first collection with half j of the second:
SIDE**2 tables for 2 * SIDE * HALF minhashes.  A pair meets in a table unless all its halves differ
in one of the collections: at similarity 0.8 that is 2 * (1 - 0.8**2)**12, about 1 in 100,000.

Halves that no other document has are dropped before the pairs of halves are formed, so documents
without a near neighbour never reach the tables.  Documents that met are dealt into blocks around an anchor,
compared on full shingle sets and contracted (``links``).  What shares a key but no component then is
joined on the rare ends of its full sets (``prefixes``): texts that resemble each other, but not
enough, have shingles of their own there and never meet.  The pairs that are left are compared on
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinmap.llm.common import components, cut, join_few, map_rows, pieces, sorted_groups

SIDE, HALF = 12, 2
#: Documents of a block; one of n times LONG shingles counts as n.
BLOCK, LONG = 128, 1000
#: Turns of contraction go on while large components with more than SPREAD blocks share a key, TURNS times at most.
SPREAD, TURNS = 8, 4
#: Documents of a large component.
LARGE = 32
#: Words whose hashes a worker keeps.
MEMO = 100_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of all words as one, if they are fewer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only; split at x20 and x09-x0D
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=width)] if words else [], np.uint64)
    ids = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + n]) * _MIX[0] + _MIX[1]
        h ^= h >> np.uint64(29)
    h *= _MIX[2]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def halves(sets: list[np.ndarray]) -> np.ndarray:
    """Half-keys (rows: sets, columns: 2 * SIDE) of non-empty sets."""
    rng = np.random.default_rng(20_240_229)
    a, b = rng.integers(0, 1 << 63, (2, 2 * SIDE * HALF), dtype=np.uint64)
    a = a * np.uint64(2) + np.uint64(1)
    every, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), 2 * SIDE), np.uint64)
    for k in range(2 * SIDE * HALF):
        h = every * a[k] + b[k]
        least = np.minimum.reduceat(h ^ (h >> np.uint64(31)), starts)
        column = k // HALF
        out[:, column] = (out[:, column] ^ least) * _MIX[3]
        out[:, column] ^= out[:, column] >> np.uint64(30)
    return out.astype(np.int64)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_hash, u, v (half-keys); set_hash, u and v are null for an empty set."""

    def start():
        def step(ids, texts):
            sets = [shingles(t, width) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes, u, v = [None] * len(ids), [None] * len(ids), [None] * len(ids)
            if full:
                for i, row in zip(full, halves([sets[i] for i in full]), strict=True):
                    hashes[i], u[i], v[i] = xxhash.xxh3_128_hexdigest(sets[i].tobytes()), row[:SIDE].tolist(), row[SIDE:].tolist()
            return [ids, [len(s) for s in sets], hashes, u, v]

        return step

    return map_rows(docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)], "doc_id long, n_shingles long, set_hash string, u array<long>, v array<long>", start)


def shared_keys(reps: DataFrame) -> DataFrame:
    """rep, key, anchor: table keys that several representatives have.

    A key's anchor is its most famous representative, whose halves stand most often in all: what
    the others were edited from, rather than an edit.
    """

    def shared(column: str) -> DataFrame:
        rows = reps.select("rep", F.posexplode(column).alias("i", "half"))
        twice = rows.groupBy("i", "half").agg(F.count("*").alias("n")).where("n > 1")
        return rows.join(twice, ["i", "half"]).groupBy("rep").agg(F.collect_list(F.struct("i", "half")).alias(column), F.sum("n").alias(f"{column}_n"))  # SIDE at most

    both = shared("u").join(shared("v"), "rep")
    tensor = both.select(F.struct(-(F.col("u_n") + F.col("v_n")).alias("h"), "rep").alias("rep"), F.explode("u").alias("u"), "v").select("rep", "u", F.explode("v").alias("v"))
    keys = cut(tensor.select("rep", F.xxhash64("u.i", "u.half", "v.i", "v.half").alias("key")))
    anchors = keys.groupBy("key").agg(F.min("rep").alias("anchor"), F.count("*").alias("n")).where("n > 1").drop("n")
    return cut(keys.join(anchors, "key").select("rep.rep", "key", "anchor"))


def anchored_anew(keys: DataFrame, turn: int) -> DataFrame:
    """``keys`` with other anchors: the first of each key in an order at random."""
    first = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "rep").alias("h"), "rep")).alias("anchor"))
    return cut(keys.drop("anchor").join(first, "key").select("rep", "key", "anchor"))


def _chunks(weight: Column) -> Column:
    """Over how many blocks a group's representatives are dealt: by number, and by weight where they are long."""
    return F.ceil(F.sum(weight) / BLOCK)


def dealt(keys: DataFrame, sizes: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of a turn (rep, block, anchor, weight), and the anchors of each block (rep, block).

    Each representative joins the group of its first anchor.
    """
    group = keys.groupBy("rep").agg(F.min("anchor").alias("anchor")).select("rep", F.col("anchor.rep").alias("anchor"))
    group = cut(group.join(sizes, "rep"))
    chunks = group.groupBy("anchor").agg(_chunks(F.col("weight")).alias("n"))
    block = lambda number: F.xxhash64(F.lit(turn), "anchor", number)
    blocks = group.join(chunks, "anchor").select("rep", block(F.pmod(F.xxhash64("rep"), "n")).alias("block"), "anchor", "weight")
    every = chunks.select("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return cut(blocks), every.select(F.col("anchor").alias("rep"), block(F.col("i")).alias("block"))


def labelled(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """``blocks`` with component and large: whether the component has LARGE documents."""
    named = blocks.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    large = cut(labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE).select("component", F.lit(True).alias("large")))
    return cut(join_few(named, large, "component", "left").withColumn("large", F.coalesce("large", F.lit(False))))


def tokens(docs: DataFrame, rest: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """rep, h: every shingle of the representatives ``rest`` (rep, ...), as rows of two longs."""
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                for rep, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = shingles(text, width).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rep, np.int64)), pa.array(own)], ["rep", "h"])

    return join_few(texts, rest.select("rep"), "rep", "left_semi").select("rep", "text").mapInArrow(run, "rep long, h long")


def prefixes(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """h, rep, component, block, n, at: of each set (rep, component, block, n) the shingles of its prefix that other sets have too.

    Sets are ordered from rare to common shingles.  A link has more in common than stands behind the
    prefix, so its first common shingle is in both prefixes.  Shingles of one set alone come first:
    they fill prefixes without a row, and a set that has enough of them can have no link at all.
    """
    shared = found.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    own = found.join(shared, "h").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own"))  # of one document
    rows = own.join(sets, "rep").withColumn("alone", F.col("n") - F.size("own"))
    take = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")).cast("int")
    rows = rows.where(take > 0).select("rep", "component", "block", "n", "alone", F.posexplode(F.slice("own", F.lit(1), take)).alias("i", "x"))
    return rows.select("x.h", "rep", "component", "block", "n", (F.col("alone") + F.col("i")).alias("at"))


def candidates(first: DataFrame, percent: int) -> DataFrame:
    """x, y: pairs of sets of different components and blocks whose sizes, and places of a common shingle, allow a link.

    first: ``prefixes``.  What stands behind a pair's first common shingle must hold all it needs in
    common.  That is decided once for all sets of a component with the same size and place; sets are
    paired only where it is so.
    """
    kind = ["component", "n", "at"]
    kinds = cut(first.select("h", *kind).distinct())
    other = kinds.select("h", *(F.col(c).alias(f"{c}_y") for c in kind))
    need = F.ceil((F.col("n") + F.col("n_y")) * percent / (100 + percent))
    sizes = 100 * F.least("n", "n_y") >= percent * F.greatest("n", "n_y")
    met = kinds.join(other, "h").where((F.col("component") < F.col("component_y")) & sizes & (F.least(F.col("n") - F.col("at"), F.col("n_y") - F.col("at_y")) >= need))
    second = first.select("h", *(F.col(c).alias(f"{c}_y") for c in [*kind, "rep", "block"]))
    pairs = cut(met).join(first, ["h", *kind]).join(second, ["h", *(f"{c}_y" for c in kind)]).where("block <> block_y")
    return pairs.select(F.least("rep", "rep_y").alias("x"), F.greatest("rep", "rep_y").alias("y")).distinct()


def verified_links(docs: DataFrame, places: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """a, b: links that connect all texts of a task that full sets connect.

    places: rep, task, side, component (connected before).  If a task has two sides, texts are
    compared across them.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    rows = join_few(texts, places, "rep")

    def start():
        def step(_, reps, texts, sides, components):
            root = list(range(len(reps)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            first_of: dict[int, int] = {}
            for i, c in enumerate(components):
                root[i] = first_of.setdefault(c, i)
            sets = [frozenset(shingles(t, width).tolist()) for t in texts]
            first = [i for i, s in enumerate(sides) if s == 0]
            second = [i for i, s in enumerate(sides) if s == 1]
            a, b = [], []
            for n, i in enumerate(first):
                for j in second or first[:n]:
                    x, y = sets[i], sets[j]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or find(i) == find(j):
                        continue
                    both = len(x & y)
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        root[find(i)] = find(j)
                        a.append(reps[i])
                        b.append(reps[j])
            return [a, b]

        return step

    return sorted_groups(rows, "task", ["side", "rep"], ["rep", "text", "side", "component"], "a long, b long", start)


def links(docs: DataFrame, reps: DataFrame, width: int, percent: int, id_col: str, text_col: str, report: dict | None = None) -> DataFrame:
    """node, component of all representatives (rep, n_shingles, u, v) that verified links connect.

    Turns first: representatives that share a key are dealt into blocks around anchors, compared
    within their block (a group's anchor stands in each of its blocks), and what is linked is
    contracted.  A key all of whose representatives are connected is done.  Another turn, with other
    anchors, follows where large components of many blocks share a key (a group that its anchor did
    not connect).  Then pairs of different components that can still be linked are found by prefixes of
    their full sets and compared.  So a group of near copies, or of texts that resemble each other
    without being linked, costs about its size.  ``report`` gets the numbers of turns and of pairs.
    """
    keys = shared_keys(reps)
    sizes = cut(reps.select("rep", F.greatest(F.lit(1.0), F.col("n_shingles") / LONG).alias("weight")))
    report = {} if report is None else report
    report |= {"turns": 0, "pairs": 0}
    check = lambda places: verified_links(docs, cut(places), width, percent, id_col, text_col)
    found, labels, now = None, None, keys
    while True:
        blocks, anchors = dealt(now, sizes, report["turns"])
        rows = blocks.select("rep", "block").union(anchors).distinct().select("rep", F.col("block").alias("task"), F.lit(0).alias("side"))
        rows = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left") if labels else rows.withColumn("component", F.col("rep"))
        new = cut(check(rows.select("rep", "task", "side", F.coalesce("component", "rep").alias("component"))))
        found = new if found is None else found.union(new)
        labels = components(found)
        report["turns"] += 1
        named = labelled(blocks, labels)
        only = F.when(F.col("large"), F.col("component"))
        kinds = join_few(now.select("rep", "key"), named.select("rep", "component", "large"), "rep")
        kinds = kinds.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count_if("large").alias("n"), (F.min(only) < F.max(only)).alias("apart"))
        mixed = cut(kinds.where("low < high").select("key", ((F.col("n") > SPREAD * BLOCK) & F.col("apart")).alias("apart")))
        now = cut(join_few(now, mixed.select("key"), "key", "left_semi"))
        if report["turns"] == TURNS or new.isEmpty() or mixed.where("apart").isEmpty():
            break
        now = anchored_anew(now, report["turns"])
    rest = cut(named.join(now.select("rep").distinct(), "rep", "left_semi").select("rep", "component", "block"))
    if rest.isEmpty():
        return labels
    sets = rest.join(reps.select("rep", F.col("n_shingles").alias("n")), "rep")
    pairs = cut(candidates(cut(prefixes(cut(tokens(docs, rest, width, id_col, text_col)), sets, percent)), percent))
    report["pairs"] = pairs.count()
    if not report["pairs"]:
        return labels
    chunks = pairs.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    tasks = pairs.join(chunks, "x").select("x", "y", F.xxhash64("x", F.pmod(F.xxhash64("y"), "chunks")).alias("task"))
    sides = tasks.select(F.col("x").alias("rep"), "task", F.lit(0).alias("side")).distinct().union(tasks.select(F.col("y").alias("rep"), "task", F.lit(1).alias("side")))
    more = check(sides.join(rest.select("rep", "component"), "rep").select("rep", "task", "side", "component"))
    return components(found.union(more))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", report: dict | None = None) -> DataFrame:
    """Components of near-duplicate texts: doc_id, n_shingles, component_id, kept, set_hash.

    Texts are linked if 100 * |A & B| >= percent * |A | B| on their sets of ``width``-word shingles
    (A-Z lower-cased; fewer words: the whole sequence as one shingle).  ``component_id`` is the
    smallest doc_id reachable and ``kept`` marks that document.  Equal sets are one class from the
    start.  A null, empty or blank text has an empty set and is linked with nothing.  A null id is
    linked with nothing: component_id null, kept true.  Repeated rows stay and get the same
    component.  No rows give no rows.  Other columns are not looked at.  A very long text is
    compared in small blocks: a set of shingles takes some 70 bytes each.  ``report``, a dict, gets
    the numbers of turns and of pairs that were compared after them.
    """
    rows = cut(signatures(docs, width, id_col, text_col))
    full = rows.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    reps = cut(full.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("u").alias("u"), F.first("v").alias("v")))
    found = links(docs, reps, width, percent, id_col, text_col, report)
    named = reps.select("set_hash", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "set_hash")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that are the smallest of their component or have no id."""
    found = near_duplicates(docs, width, percent, id_col, text_col)
    return join_few(docs, cut(found.where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()), id_col, "left_anti")


def oracle(width: int = 4, percent: int = 80) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, md5(g) AS g FROM (SELECT doc_id, unnest(s) AS g FROM s)),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM pairs JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
way AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""
