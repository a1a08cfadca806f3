"""Removal of repeated byte strings by blockwise suffix sorting with difference covers.

Sorting every suffix of a corpus moves many times its size.  Two exact steps leave few to sort:

1. Cover samples of the corpus.  Every ``DEPTH``-byte string has one sampled position, the least
   hash of its ``GRAM``-byte grams (leftmost among equals), which depends on the string's content
   alone.  Starts that share a sample form a run.  A string can repeat only if its sample's gram
   does, so runs whose gram stands once are done; runs that are equal as a whole are repeats.
2. The suffixes of the remaining runs, and of one run of each kind of repeat beside them, are dealt
   into buckets by their sample.  A task sorts one block of buckets at a time: by 32 leading bytes,
   and ties by ranks of the block's difference-cover sample, precomputed by doubling.  A comparison
   of two long ties costs one look at both ranks, so memory is some words per byte of the block.

A bucket of more bytes than a block (a passage that very many texts share) is split first, by longer
samples: starts are halved by their distance to the sample, and each half is dealt by all bytes that
its strings have in common.  Equal strings stay together, so after a few halvings every bucket
fits a block and is sorted like the others.

What a step wrote, shuffle files and tables, is removed once the next step is written, so that the
disk holds what two steps need and not all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinmap.llm.common import BROADCAST_ROWS, cut_free, fresh, join_few, map_rows, pieces, remove

DEPTH, GRAM = 200, 24
#: Starts of a run at most.
RUN = DEPTH - GRAM + 1
#: Bytes of a block, about.
BLOCK = 500_000
#: Equal runs; kinds of more are looked up by broadcast.
HEAVY = 1000
#: Bits of a position in a text.
_AT = np.uint64(31)
#: A perfect difference set modulo PERIOD: any two positions reach it by one common shift.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_IN = np.isin(np.arange(PERIOD), COVER)
SHIFT = np.array([[next(s for s in range(PERIOD) if _IN[(a + s) % PERIOD] and _IN[(b + s) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes at each position."""
    n = len(data) - GRAM + 1
    h = _TABLE[data]
    size, out, at, left = 1, np.zeros(n, np.uint64), 0, GRAM
    while left:  # by powers of two: the hash of 2m bytes from those of m
        if left & 1:
            out = out * _ODD + h[at : at + n]
            out ^= out >> np.uint64(29)
            at += size
        left >>= 1
        if left:
            g = h[:-size] * _ODD
            g ^= g >> np.uint64(32)
            h = g + h[size:]
            size *= 2
    out *= _ODD
    return out ^ (out >> np.uint64(31))


def runs_of(raw: bytes) -> tuple[list[int], list[int], list[int], list[int]]:
    """Gram hash, two 64-bit hashes of all bytes, and place of each run.

    A place holds the first start, how far the sample lies behind it (8 bits) and the number of
    starts (8 bits).  The sample is the leftmost gram with the least leading bits of its hash, the
    same number of bits in every text.
    """
    if len(raw) < DEPTH:
        return [], [], [], []
    h = gram_hashes(np.frombuffer(raw, np.uint8))
    n = len(h) - RUN + 1  # starts
    key = (h >> _AT << _AT) | np.arange(len(h), dtype=np.uint64)
    pad = (-len(key)) % RUN
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, RUN)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[RUN - 1 : RUN - 1 + n]) & ((np.uint64(1) << _AT) - np.uint64(1))
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    sizes = np.diff(np.append(first, n))
    text = memoryview(raw)
    signs = b"".join([xxhash.xxh3_128_digest(text[a : a + m + DEPTH - 1]) for a, m in zip(first.tolist(), sizes.tolist(), strict=True)])
    sign, tail = np.frombuffer(signs, np.int64).reshape(-1, 2).T
    sample = least[first].astype(np.int64)
    return h[sample].astype(np.int64).tolist(), sign.tolist(), tail.tolist(), ((first << 16) | (sample - first << 8) | sizes).tolist()


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the rows of ``keys``, the first column leading."""
    rank = np.unique(keys[0], return_inverse=True)[1]
    for k in keys[1:]:
        own = np.unique(k, return_inverse=True)[1]
        rank = np.unique(rank * np.int64(len(own) + 1) + own, return_inverse=True)[1]
    return rank + 1


def cover_ranks(words: np.ndarray) -> np.ndarray:
    """For each sampled position the rank of its 156 bytes, else 0.  words: the 8 bytes at each position."""
    n = len(words)
    at = np.flatnonzero(_IN[np.arange(n) % PERIOD])
    word = lambda shift: words[np.minimum(at + shift, n - 1)]

    def after(rank: np.ndarray, shift: int) -> np.ndarray:
        return np.where(at + shift < n, rank[np.minimum(at + shift, n - 1)], 0)

    def put(rank: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[at] = rank
        return out

    r32 = put(_ranks(word(0), word(8), word(16), word(24)))
    r63 = put(_ranks(r32[at], after(r32, 31)))
    r125 = put(_ranks(r63[at], after(r63, 62)))
    return put(_ranks(r125[at], after(r32, 124)))


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each start, equal exactly where the DEPTH bytes there are equal; their order is the suffixes'."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(data)]
    lead = _ranks(*(words[starts + k] for k in (0, 8, 16, 24)))
    order = np.argsort(lead, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(lead[order]) > 0]))
    low = np.repeat(begin, np.diff(np.append(begin, len(order))))  # first place of the own group, by place
    size = np.diff(np.append(begin, len(order)))
    todo = np.flatnonzero(np.repeat(size, size) > 1)
    rank = cover_ranks(words) if len(todo) else None
    while len(todo):  # three-way split of every group around its middle suffix
        group, members = low[todo], order[todo]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(todo)))
        of = np.repeat(np.arange(len(first)), size)
        i, j = starts[members], starts[members[first + size // 2]][of]
        shift = SHIFT[i % PERIOD, j % PERIOD]
        side = np.sign(rank[i + shift] - rank[j + shift])
        for k in (152, 160, 168, 176, 184, 192):
            same = np.flatnonzero(side == 0)
            if not len(same):
                break
            a, b = words[i[same] + k], words[j[same] + k]
            side[same] = (a > b).astype(np.int64) - (a < b)
        again = np.lexsort((side, of))
        order[todo] = members[again]
        side = side[again]
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(side) != 0)]))
        size = np.diff(np.append(cuts, len(todo)))
        low[todo] = np.repeat(todo[cuts], size)
        todo = todo[(np.repeat(size, size) > 1) & (side != 0)]
    out = np.zeros(len(starts), np.int64)
    out[order] = low
    return out


def repeated_in_block(texts: list[bytes], settled: list[bool]) -> list[np.ndarray]:
    """For each run's bytes, which of its starts repeat in the block (or are those of a settled run)."""
    sizes = np.array([len(t) - DEPTH + 1 for t in texts])
    lengths = np.array([len(t) for t in texts])
    base = np.repeat(np.cumsum(lengths) - lengths, sizes)
    starts = base + np.arange(len(base)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = classes(np.frombuffer(b"".join(texts), np.uint8), starts)
    weight = np.bincount(own, 1 + np.repeat(np.array(settled, np.int64), sizes), len(own))
    return np.split(weight[own] > 1, np.cumsum(sizes)[:-1])


def _spans(flags: np.ndarray, first: int) -> list[int]:
    """Places of maximal runs of flagged starts (256 starts or fewer)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(first + a) * 256 + (b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def sorted_blocks(rows: DataFrame) -> DataFrame:
    """rows (bucket, row, place, settled, raw) -> row, place of repeated starts."""
    import pyarrow as pa

    def run(batches):
        held, size, last = [], 0, None

        def ended():
            ids, places = [], []
            for (row, place, done, _), flags in zip(held, repeated_in_block([h[3] for h in held], [h[2] for h in held]), strict=True):
                if not done:
                    own = _spans(flags, place >> 16)
                    ids += [row] * len(own)
                    places += own
            return pa.RecordBatch.from_pydict({"row": pa.array(ids, pa.int64()), "place": pa.array(places, pa.int64())})

        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last and size > BLOCK:
                    yield ended()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = bucket
        if held:
            yield ended()

    return rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "row", "place", "settled", "raw").mapInArrow(run, "row long, place long")


def _parts() -> tuple[Column, Column, Column]:
    """First start, distance of the sample and number of starts of ``place``."""
    return F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(255))


def judged(runs: DataFrame, at: str) -> tuple[DataFrame, DataFrame, str]:
    """Of runs written to the path ``at``, which is removed, (bucket, sign, tail, row, place, settled and, once known, raw, low, high): repeats, and what is left.

    Repeats (row, place) are runs that another one of the bucket equals as a whole.  Left (bucket,
    n_kinds, row, place, settled, ...) is one run of each kind of a bucket that has several.

    Kinds with more runs than HEAVY and than the BROADCAST_ROWS-th part of all runs can't be more
    than BROADCAST_ROWS: these are broadcast, so no key of the shuffled join holds more runs.
    """
    kind = ["bucket", "sign", "tail"]
    more = [c for c in ("raw", "low", "high") if c in runs.columns]
    kinds, kinds_at = cut_free(runs.groupBy(*kind).agg(F.count("*").alias("n"), F.max("settled").alias("settled"), F.min_by("place", "row").alias("place"), F.min("row").alias("row"), *(F.first(c).alias(c) for c in more)))
    buckets, buckets_at = cut_free(kinds.groupBy("bucket").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1"))
    left = join_few(kinds, buckets, "bucket").select("bucket", "n_kinds", "row", "place", ((F.col("n") > 1) | F.col("settled")).alias("settled"), *more)
    left, left_at = cut_free(left)
    most, own = max(HEAVY, runs.count() // BROADCAST_ROWS), runs.where("NOT settled").select(*kind, "row", "place")
    heavy, heavy_at = cut_free(kinds.where(F.col("n") > most).select(*kind))
    light = kinds.where((F.col("n") > 1) & (F.col("n") <= most)).select(*kind)
    whole = own.join(F.broadcast(heavy), kind, "left_semi").union(own.join(F.broadcast(heavy), kind, "left_anti").join(light, kind, "left_semi"))
    first, _, size = _parts()
    whole, _ = cut_free(whole.select("row", (first * 256 + size).alias("place")))
    for path in (at, kinds_at, buckets_at, heavy_at):
        remove(runs.sparkSession, path)
    return whole, left, left_at


def with_bytes(docs: DataFrame, names: DataFrame, left: DataFrame) -> DataFrame:
    """The rows of ``left`` with the bytes of their runs, ``raw``.  names: row, text_id."""
    wanted, _ = cut_free(join_few(names, left, "row").groupBy("text_id").agg(F.collect_list(F.struct("row", "bucket", "n_kinds", "place", "settled")).alias("wanted")))  # a text's own runs
    texts = join_few(docs, wanted.select("text_id"), "text_id", "left_semi").groupBy("text_id").agg(F.first("text").alias("text"))
    rows = texts.join(wanted, "text_id").select("text", F.inline("wanted"))
    first, _, size = _parts()
    raw = F.substring(F.encode("text", "UTF-8"), (first + 1).cast("int"), (size + (DEPTH - 1)).cast("int"))
    return rows.select("bucket", "n_kinds", "row", "place", "settled", raw.alias("raw"))


def halved(hot: DataFrame) -> DataFrame:
    """Runs (bucket, row, place, settled, raw, low, high) cut in two, by the distance of starts to the sample.

    low, high: the distances of the bucket.  Strings of a half all hold the bytes from ``low`` before
    the sample to DEPTH - high behind its begin; the half's bucket is the hash of these.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2)
    rows = hot.select("bucket", "row", "place", "settled", "raw", F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))).alias("half"))
    first, lead, size = _parts()
    near, far = F.greatest(lead - size + 1, F.col("half.low")), F.least(lead, F.col("half.high"))
    rows = rows.select("bucket", "row", "settled", "raw", "half.low", "half.high", lead.alias("lead"), first.alias("first"), near.alias("near"), far.alias("far")).where("low <= high AND near <= far")
    piece = lambda at, size: F.substring(F.col("raw"), (at + 1).cast("int"), size.cast("int"))
    lead, low, high, near, far = map(F.col, ("lead", "low", "high", "near", "far"))
    rows = rows.select(
        F.xxhash64("bucket", low, piece(lead - low, DEPTH - (high - low))).alias("bucket"), "row", "settled", low, high,
        (F.shiftleft(F.col("first") + lead - far, 16) + far * 256 + (far - near + 1)).alias("place"), piece(lead - far, far - near + DEPTH).alias("raw"),
    )
    return rows.withColumn("sign", F.xxhash64("raw")).withColumn("tail", F.xxhash64(F.lit(1), "raw"))


def repeats(docs: DataFrame, block: int | None = None) -> DataFrame:
    """text_id, places (array) of starts of repeated DEPTH-byte strings.  docs: text_id (128 bits), text."""
    spark, most = docs.sparkSession, (block or BLOCK) // (2 * DEPTH)

    def start():
        first, seen = TaskContext.get().partitionId() << 40, 0

        def step(text_ids, texts):
            nonlocal seen
            rows = list(range(first + seen, first + seen + len(texts)))
            seen += len(texts)
            return [rows, text_ids, *map(list, zip(*(runs_of(t.encode()) for t in texts), strict=True))]

        return step

    long_enough = docs.where(F.octet_length("text") >= DEPTH)
    by_doc, by_doc_at = cut_free(map_rows(long_enough, ["text_id", "text"], "row long, text_id binary, gram array<long>, sign array<long>, tail array<long>, place array<long>", start))
    names, names_at = cut_free(by_doc.select("row", "text_id"))
    runs = by_doc.select("row", F.explode(F.arrays_zip("gram", "sign", "tail", "place")).alias("r")).select("row", F.col("r.gram").alias("bucket"), "r.sign", "r.tail", "r.place")
    # written, so that both sides of a join have their own exchange and a hot key's rows can be split
    often, often_at = cut_free(by_doc.select(F.explode("gram").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    runs, runs_at = cut_free(runs.join(often, "bucket", "left_semi"))
    for path in (by_doc_at, often_at):
        remove(spark, path)
    whole, left, left_at = judged(runs.withColumn("settled", F.lit(False)), runs_at)
    found = [whole, cut_free(sorted_blocks(with_bytes(docs, names, left.where(F.col("n_kinds") <= most))))[0]]
    hot = left.where(F.col("n_kinds") > most)
    if not hot.isEmpty():
        hot, hot_at = cut_free(with_bytes(docs, names, hot).withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(RUN - 1).cast("long")))
        remove(spark, left_at)
        while not hot.isEmpty():  # eight times at most: then low = high, and a bucket is one string
            halves = cut_free(halved(hot))
            remove(spark, hot_at)
            whole, left, left_at = judged(*halves)
            found += [whole, cut_free(sorted_blocks(left.where(F.col("n_kinds") <= most)))[0]]
            hot, hot_at = cut_free(left.where(F.col("n_kinds") > most))
            remove(spark, left_at)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    places, _ = cut_free(names.join(every, "row").groupBy("text_id").agg(F.collect_set("place").alias("places")))  # a text's own runs
    remove(spark, names_at)
    return places


def without(raw: bytes, places: list[int] | None) -> tuple[bytes, int]:
    """The bytes that no string at ``places`` covers, and the number of maximal removed runs."""
    spans: list[list[int]] = []
    for place in sorted(places or ()):
        a, b = place >> 8, (place >> 8) + (place & 255) + DEPTH - 1
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), len(spans)


def text_key(text: Column) -> Column:
    """What tells texts apart: 128 bits."""
    return F.unhex(F.md5(text))


def drop_repeats(docs: DataFrame, text_col: str = "text", block: int | None = None) -> DataFrame:
    """``docs``, with all columns, whose texts lose their repeated bytes (null stays null)."""
    import pyarrow as pa

    text = F.coalesce(F.col(text_col), F.lit(""))
    key, own = fresh(docs, "text_id"), fresh(docs, "places")
    places = repeats(docs.select(text_key(text).alias("text_id"), text.alias("text")), block)
    joined = docs.withColumn(key, text_key(text)).join(places.select(F.col("text_id").alias(key), F.col("places").alias(own)), key, "left")
    column = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                texts, all_places = batch.column(column).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                left = [without(t.encode(), p)[0].decode(errors="ignore") if t and p else t for t, p in zip(texts, all_places, strict=True)]
                columns = [pa.array(left, pa.string()) if i == column else c for i, c in enumerate(batch.columns[:-1])]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.select(*docs.columns, own).mapInArrow(run, docs.schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int | None = None) -> DataFrame:
    """Removes each byte that a DEPTH-byte string covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept_text (the
    kept bytes as text; a character cut in two loses its other bytes).  Matches never cross
    documents; overlapping strings count; all strings are judged on the input.  A null text counts
    as empty.  Repeated rows are copies of each other; null ids stay; no rows give no rows; other
    columns are not looked at.  Long texts are worked at as bytes of one row, with some 40 bytes of
    memory for each.  Texts and runs are told apart by 128-bit hashes.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_id", text_key(F.col("text")))
    places = repeats(named.select("text_id", "text"), block)

    def start():
        def step(ids, texts, all_places):
            out = [[] for _ in range(6)]
            for doc_id, text, places in zip(ids, texts, all_places, strict=True):
                raw = text.encode()
                rest, n_spans = without(raw, places)
                for column, value in zip(out, (doc_id, len(raw), len(raw) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore")), strict=True):
                    column.append(value)
            return out

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(named.join(places, "text_id", "left"), ["doc_id", "text", "places"], f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string", start)


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), {2 * DEPTH})) AS s FROM (SELECT doc_id, h, unnest(range(n - {DEPTH - 1})) AS i FROM d WHERE n >= {DEPTH})),
r AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) AS t ON w.s = t.s),
f AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {DEPTH}, true) AS fresh FROM r),
g AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + {DEPTH} AS b FROM g GROUP BY doc_id, k),
ends AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS b FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS h FROM ends JOIN d USING (doc_id) GROUP BY doc_id),
m AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN m USING (doc_id)
"""
