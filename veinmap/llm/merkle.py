"""Merkle manifest of a dataset, by mountain ranges.

A leaf digests a row.  The leaves of a group (a source) in the order of their ids, and the groups'
roots in the order of the groups, form trees of ``FANOUT``; a run at the end of a level may be
shorter and is hashed as it is, without padding.

Leaves are dealt by ranges of (group, id) and numbered, so a task holds consecutive leaves of a
group and knows the number of each, but its part may begin and end anywhere inside a run.  It pushes
its leaves onto a mountain range: a stack of unfinished runs, one for each level, where a full run
is carried, as its digest, to the level above.  A task gives back node records only: the peaks of
blocks (``FANOUT ** DEPTH`` leaves) that it completed, and the nodes at its ragged edges.  The edges
of a block meet in one small group and go through the same stack; then peaks are merged, ``STEP``
levels at a time, where each group again is small and leaves every node's siblings (its proof).
Proofs of leaves are read off block by block.  No group of rows is larger than a block, whatever the
size of a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from veinmap.llm.common import cut, join_few, parsed

#: Nodes of a run; levels of a block; levels that one merge of peaks goes up.
FANOUT, DEPTH, STEP = 3, 6, 6
#: Fixed value: the fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of an output batch.
BATCH = 5_000
_NODE = "key string, n long, level int, at long, digest string"
_PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // FANOUT), up + 1
    return up


def width(n: int, level: int) -> int:
    """Nodes of a level over ``n`` leaves."""
    return -(-n // FANOUT**level)


class Range:
    """A mountain range over the nodes of a group that come in order; they may begin and end inside runs.

    ``peaks`` gets the nodes of level ``top`` and those that can't be carried further because their
    run is not whole here; ``inner``, if given, every node that a carry makes.
    """

    def __init__(self, n: int, top: int, inner: list | None = None):
        self.n, self.top, self.inner, self.peaks = n, min(top, height(n)), inner, []
        self.runs: list[list[tuple[int, str]]] = [[] for _ in range(self.top + 1)]

    def push(self, level: int, at: int, own: str) -> None:
        while level < self.top:
            run = self.runs[level]
            if run and run[-1][0] + 1 != at:
                self.spill(level)
            run.append((at, own))
            if (at + 1) % FANOUT and at + 1 < width(self.n, level):
                return
            if run[0][0] % FANOUT:
                self.spill(level)
                return
            own = digest("".join(d for _, d in run))
            run.clear()
            level, at = level + 1, at // FANOUT
            if self.inner is not None:
                self.inner.append((level, at, own))
        self.peaks.append((level, at, own))

    def spill(self, level: int) -> None:
        self.peaks += [(level, at, own) for at, own in self.runs[level]]
        self.runs[level].clear()

    def end(self) -> list[tuple[int, int, str]]:
        for level in range(self.top + 1):
            self.spill(level)
        return self.peaks


def _stream(rows: DataFrame, ddl: str, start: Callable[[], tuple[Callable[[tuple], list[tuple]], Callable[[], list[tuple]]]]) -> DataFrame:
    """Maps rows in their order: ``start`` gives, for each task, a function of a row and one of the end; both give rows."""
    schema = to_arrow_schema(parsed(ddl), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, end = start()
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held.clear()
            return out

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.extend(each(row))
                if len(held) >= BATCH:
                    yield batch()
        held.extend(end())
        if held:
            yield batch()

    return rows.mapInArrow(run, ddl)


def numbered(leaves: DataFrame) -> DataFrame:
    """leaves (key, id, digest, ...) dealt by ranges of (key, id, digest), with i (number in the group, from 0) and n (its size)."""
    rows = cut(leaves.repartitionByRange("key", "id", "digest").sortWithinPartitions("key", "id", "digest").withColumn("__m", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__m", 33))
    parts = rows.groupBy("__part", "key").agg(F.min("__m").alias("__first"), F.count("*").alias("__own"))
    group = Window.partitionBy("key")  # a row for each part that a group touches
    before = F.coalesce(F.sum("__own").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = cut(parts.select("__part", "key", (before - F.col("__first")).alias("__base"), F.sum("__own").over(group).alias("n")))
    return join_few(rows, base, ["__part", "key"]).withColumn("i", F.col("__m") + F.col("__base")).drop("__m", "__part", "__base")


def _peaks(rows: DataFrame, top: int, order: Callable[[tuple], int], inner: bool = False) -> DataFrame:
    """Node records (_NODE) of rows key, n, level, at, digest: a mountain range for each stretch of consecutive nodes.

    ``order``: of a row, the block that it lies in; a stretch ends with it.
    """

    def start():
        now, stack = None, None

        def ended() -> list[tuple]:
            return [(now[0], stack.n, *p) for p in stack.end() + (stack.inner or [])] if stack else []

        def each(row):
            nonlocal now, stack
            key, n, level, at, own = row
            out = []
            if now != (this := (key, order(row))):
                out, now, stack = ended(), this, Range(n, top, [] if inner else None)
            stack.push(level, at, own)
            return out

        return each, ended

    return _stream(rows.select("key", "n", "level", "at", "digest"), _NODE, start)


def _is_top(level: int) -> Column:
    """Of a node record: it reached ``level`` or its group's root."""
    return (F.col("level") == level) | (F.col("at") == 0) & (F.col("n") <= F.pow(F.lit(FANOUT), F.col("level")))


def _merged(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of a level, ``FANOUT ** STEP`` siblings in a group -> key, n, at, path (siblings up to the group's top), up, digest (the top)."""
    span, up = FANOUT**STEP, STEP

    def start():
        held: list[tuple] = []

        def ended() -> list[tuple]:
            if not held:
                return []
            key, n = held[0][:2]
            first, own = held[0][3], [r[4] for r in held]
            held.clear()
            stages = levels(own, min(height(n) - level, up))
            return [(key, n, first + j, path_of(stages, j), first // span, stages[-1][0]) for j in range(len(own))]

        def each(row):
            out = ended() if held and (held[0][0], held[0][3] // span) != (row[0], row[3] // span) else []
            held.append(row)
            return out

        return each, ended

    group = nodes.withColumn("__g", F.floor(F.col("at") / span)).repartition("key", "__g").sortWithinPartitions("key", "at")
    return _stream(group.select("key", "n", "level", "at", "digest"), f"key string, n long, at long, path {_PATH}, up long, digest string", start)


def levels(own: list[str], up: int) -> list[list[str]]:
    """The digests of ``up`` levels above a block's first level, which begins with a run."""
    stages = [own]
    for _ in range(up):
        below = stages[-1]
        stages.append([digest("".join(below[k : k + FANOUT])) for k in range(0, len(below), FANOUT)])
    return stages


def path_of(stages: list[list[str]], j: int) -> list[dict]:
    """The siblings of node ``j``, level by level: what stands left and right of it in its run."""
    out = []
    for below in stages[:-1]:
        k = j - j % FANOUT
        out.append({"left": "".join(below[k:j]), "right": "".join(below[j + 1 : k + FANOUT])})
        j //= FANOUT
    return out


@dataclass
class Forest:
    """rows: key, id, digest, i, n, ... (leaves).  blocks: key, block, path (siblings above the block).  roots: key, n, root.  nodes: node records."""

    rows: DataFrame
    blocks: DataFrame
    roots: DataFrame
    nodes: DataFrame


def forest(leaves: DataFrame, inner: bool = False) -> Forest:
    """The trees of leaves (key, id, digest, ...): one for each key.

    ``nodes`` has the records of all peaks that were carried to a block's top or above (key, n,
    level, at, digest); with ``inner`` those inside blocks too.
    """
    rows, size = cut(numbered(leaves)), FANOUT**DEPTH
    first = cut(_peaks(rows.select("key", "n", F.lit(0).alias("level"), F.col("i").alias("at"), "digest"), DEPTH, lambda r: r[3] // size, inner))
    edges = first.where(~_is_top(DEPTH))
    if inner:  # carried further inside its task: no edge
        parents = first.select("key", (F.col("level") - 1).alias("level"), F.col("at").alias("__up"))
        edges = edges.withColumn("__up", F.floor(F.col("at") / FANOUT)).join(parents, ["key", "level", "__up"], "left_anti").select(*first.columns)
    home = F.floor(F.col("at") * F.pow(F.lit(FANOUT), F.col("level")) / size)
    placed = edges.withColumn("__h", home).repartition("key", "__h").sortWithinPartitions("key", "__h", F.col("at") * F.pow(F.lit(FANOUT), F.col("level")))
    made = cut(_peaks(placed, DEPTH, lambda r: r[3] * FANOUT ** r[2] // size, inner))
    nodes = first.union(made).distinct() if inner else first.union(made)
    top, level = nodes.where(_is_top(DEPTH)).distinct(), DEPTH
    blocks = top.select("key", F.col("at").alias("block"), F.col("at").alias("__at"), F.expr(f"CAST(array() AS {_PATH})").alias("path"))
    done = [top.where(_root())]
    most = rows.agg(F.max("n")).first()[0] or 0
    while width(most, level) > 1:
        step = cut(_merged(top.where(~_root()), level))
        above = step.select("key", F.col("at").alias("__at"), F.col("path").alias("__more"), "up")
        blocks = blocks.join(above, ["key", "__at"], "left").select("key", "block", F.coalesce("up", "__at").alias("__at"), F.concat("path", F.coalesce("__more", F.expr(f"CAST(array() AS {_PATH})"))).alias("path"))
        reached = F.least(F.lit(level + STEP), F.expr(f"CAST({_height_sql()} AS INT)"))
        top = cut(step.where(F.col("at") % FANOUT**STEP == 0).select("key", "n", reached.alias("level"), F.col("up").alias("at"), "digest"))
        done.append(top.where(_root()))
        nodes, level = nodes.union(top), level + STEP
    roots = done[0]
    for more in done[1:]:
        roots = roots.union(more)
    return Forest(rows, cut(blocks.drop("__at")), cut(roots.select("key", "n", F.col("digest").alias("root"))), nodes)


def _root() -> Column:
    return (F.col("at") == 0) & (F.col("level") == F.expr(_height_sql()))


def _height_sql() -> str:
    """height(n) as SQL on ``n``, exact: levels are compared with powers."""
    powers = ", ".join(str(FANOUT**k) for k in range(1, 40))
    return f"CASE WHEN n <= 1 THEN 0 ELSE size(filter(array({powers}), p -> p < n)) + 1 END"


def folded(own: str, path: list[dict]) -> str:
    """The root that a leaf's digest and its siblings give."""
    for level in path:
        own = digest(level["left"] + own + level["right"])
    return own


def proven(rows: DataFrame, blocks: DataFrame, extra: list[str], ddl: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Maps leaves to rows of ``ddl``, block by block.

    blocks: key, block, path and more columns.  ``start`` gives a function of (a leaf's ``extra``
    columns, its siblings up to the path's end, the block's columns by name).
    """
    size, depth = FANOUT**DEPTH, DEPTH
    more = [c for c in blocks.columns if c not in ("key", "block")]
    block_rows = blocks.select("key", "block", F.lit(-1).cast("long").alias("i"), F.lit(0).cast("long").alias("n"), F.lit("").alias("digest"), F.struct(*more).alias("__b"))
    leaf_rows = rows.select("key", F.floor(F.col("i") / size).alias("block"), "i", "n", "digest", *extra)
    both = leaf_rows.unionByName(block_rows, allowMissingColumns=True).repartition("key", "block").sortWithinPartitions("key", "block", "i")

    def begin():
        make, held, about = start(), [], None

        def ended() -> list[tuple]:
            if not held:
                return []
            n = held[0][1]
            stages = levels([r[2] for r in held], min(depth, height(n)))
            out = [make(r[3:], path_of(stages, j) + about["path"], about) for j, r in enumerate(held)]
            held.clear()
            return out

        def each(row):
            nonlocal about
            if row[0] < 0:
                out, about = ended(), row[-1]
                return out
            held.append(row[:-1])
            return []

        return each, ended

    return _stream(both.select("i", "n", "digest", *extra, "__b"), ddl, begin)


def _field(c: str) -> Column:
    value = F.col(c).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: tuple[str, ...], text_col: str | None = None, text: Column | None = None) -> Column:
    """The digest of a row's fields, each as its length and value; of the field ``text_col`` the value ``text``."""
    value = text
    own = [_field(c) if c != text_col else F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)) for c in fields]
    return F.sha2(F.concat(*own), 256)


@dataclass
class Manifest:
    """leaves: the Forest of rows by group (its key is null-safe text).  top: the Forest of the groups' roots.  blocks: key, block, path up to the root, subroot, root."""

    leaves: Forest
    top: Forest
    blocks: DataFrame


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id", inner: bool = False, **more: Column) -> Manifest:
    """The manifest of ``docs``: a tree for each value of ``group_col`` and one over the groups.

    A leaf digests ``fields``: each ``-`` if null, else its UTF-8 length, ``:`` and its value.  Leaves
    ascend by id (nulls first; equal ids by digest, so repeated rows are leaves of their own); groups
    ascend bytewise, null first.  No rows give no tree.  Other columns are not looked at, whatever
    their names; ``more`` names columns that leaves carry.  Texts are digested in the JVM, once, and
    not shuffled; of a very long text only the digest goes on.
    """
    own = cut(docs.select(F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0")).alias("key"), F.col(id_col).alias("id"), leaf_digest(fields).alias("digest"), *(c.alias(name) for name, c in more.items())))
    leaves = forest(own, inner)
    subroots = leaves.roots.select(F.lit("").alias("key"), F.col("key").alias("id"), F.col("root").alias("digest"))
    top = forest(subroots, inner)
    root = top.roots.select("root")
    paths = proven(top.rows, top.blocks, ["id"], f"key string, __above {_PATH}", lambda: lambda leaf, path, about: (leaf[0], path))
    above = cut(join_rows(paths, root).join(leaves.roots.select("key", F.col("root").alias("subroot")), "key"))
    blocks = join_few(leaves.blocks, above, "key").select("key", "block", F.concat("path", "__above").alias("path"), "subroot", "root")
    return Manifest(leaves, top, blocks)


def join_rows(many: DataFrame, one: DataFrame) -> DataFrame:
    """``many`` with the columns of the single row ``one``."""
    return many.join(F.broadcast(one), how="inner") if not one.isEmpty() else many.withColumn("root", F.lit(None).cast("string"))


def proofs(m: Manifest) -> DataFrame:
    """key, id, leaf, path: each leaf's siblings, level by level, up to the root."""
    kind = m.leaves.rows.schema["id"].dataType.simpleString()
    rows = m.leaves.rows.withColumn("__k", F.col("key")).withColumn("__d", F.col("digest"))
    return proven(rows, m.blocks, ["__k", "id", "__d"], f"key string, id {kind}, leaf string, path {_PATH}", lambda: lambda leaf, path, about: (*leaf, path))


def verified(docs: DataFrame, tampered: Column, changed: Column, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proves every row against the manifest after tampering.

    Where ``tampered`` holds the row's ``text_col`` becomes ``changed``.  Returns id, leaf, subroot,
    root, proof_sha256 (digest of all siblings up to the root; all of these untampered), folded_root
    (from the tampered leaf, else the leaf, and the siblings) and verified (it equals root).
    """
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(fields, text_col, changed))
    m = manifest(docs, fields, group_col, id_col, tampered=other)
    rows = m.leaves.rows.withColumn("__d", F.col("digest"))

    def start():
        def make(leaf, path, about):
            key, own, other = leaf
            got = folded(other or own, path)
            proof = hashlib.sha256()
            for level in path:
                proof.update((level["left"] + level["right"]).encode())
            return key, own, about["subroot"], about["root"], proof.hexdigest(), got, got == about["root"]

        return make

    kind = docs.schema[id_col].dataType.simpleString()
    out = proven(rows, m.blocks, ["id", "__d", "tampered"], f"__id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", start)
    return out.withColumnRenamed("__id", id_col)


def without_line_feeds(docs: DataFrame) -> DataFrame:
    """``verified`` with the line feeds of texts deleted where 2 divides the crc32 of the decimal doc_id."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verified(docs, even, F.translate("text", "\n", ""))


#: crc32 of a short ASCII string, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda p: ascii(k[p])::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 1, 2, 3, 4, 5, 6, 7]), lambda r, s: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295)"


def oracle() -> str:
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c if c != "text" else text) for c in FIELDS) + ")"
    return f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('1' || source, '0') AS g, {leaf("text")} AS leaf, {leaf("replace(text, chr(10), '')")} AS other, CAST(doc_id AS VARCHAR) AS k FROM documents),
e AS (SELECT doc_id, g, leaf, CASE WHEN {_CRC} % 2 = 0 THEN other ELSE leaf END AS used, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
low AS (
  SELECT g, 0 AS lvl, i, n AS w, leaf AS h FROM e
  UNION ALL SELECT g, lvl + 1, i // 3, (w + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE w > 1 GROUP BY g, lvl, i // 3, w),
sub AS (SELECT g, lvl AS tall, h AS subroot FROM low WHERE w = 1),
rank AS (SELECT *, row_number() OVER (ORDER BY encode(g)) - 1 AS gi, count(*) OVER () AS gn FROM sub),
high AS (
  SELECT 0 AS lvl, gi AS i, gn AS w, subroot AS h FROM rank
  UNION ALL SELECT lvl + 1, i // 3, (w + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE w > 1 GROUP BY lvl, i // 3, w),
root AS (SELECT h AS root, lvl AS up FROM high WHERE w = 1),
way AS (
  SELECT doc_id, leaf, used, lvl, e.g, e.i // CAST(3 ** lvl AS BIGINT) AS i, true AS below FROM e JOIN rank USING (g), range(0, 40) t(lvl) WHERE lvl < tall
  UNION ALL SELECT doc_id, leaf, used, tall + lvl, '', gi // CAST(3 ** lvl AS BIGINT), false FROM e JOIN rank USING (g), root, range(0, 40) t(lvl) WHERE lvl < up),
nodes AS (SELECT g, lvl, i, h, true AS below, 0 AS tall FROM low UNION ALL SELECT '', high.lvl + tall, i, h, false, tall FROM high, (SELECT DISTINCT tall FROM rank)),
sib AS (
  SELECT w.doc_id, w.leaf, w.lvl, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i < w.i), '') AS l, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i > w.i), '') AS r
  FROM way w JOIN e USING (doc_id, leaf) JOIN rank ON rank.g = e.g JOIN nodes n ON n.g = w.g AND n.lvl = w.lvl AND n.below = w.below AND (w.below OR n.tall = rank.tall) AND n.i // 3 = w.i // 3
  GROUP BY ALL),
proof AS (SELECT doc_id, leaf, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof_sha256, count(*) AS steps FROM sib GROUP BY ALL),
fold AS (
  SELECT doc_id, leaf, 0 AS lvl, used AS h FROM e
  UNION ALL SELECT f.doc_id, f.leaf, f.lvl + 1, sha256(l || f.h || r) FROM fold f JOIN sib ON sib.doc_id = f.doc_id AND sib.leaf = f.leaf AND sib.lvl = f.lvl)
SELECT e.doc_id, e.leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM e JOIN rank USING (g) JOIN root ON true LEFT JOIN proof p ON p.doc_id = e.doc_id AND p.leaf = e.leaf
JOIN fold f ON f.doc_id = e.doc_id AND f.leaf = e.leaf AND f.lvl = coalesce(steps, 0)
"""
