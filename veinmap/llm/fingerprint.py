"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the ``k`` smallest distinct 64-bit hashes of a text's shingles.  Sketches merge by
keeping the k smallest of their union, and estimate resemblance, containment and the number of
distinct shingles.  Everything is a Column expression; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WIDTH = 128, 5
#: Documents of a bucket, about; a bucket is a window partition.
BUCKET_ROWS = 1000
#: Coarse buckets are cut at so many quantiles of the ids at most; each is cut evenly further.
COARSE = 256
_SPACE = r"[\x20\x09-\x0D]+"


def _bind(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Ascending array of the k smallest distinct shingle hashes; empty for a text without words (or null).

    Words are divided by ASCII white space; a text of fewer than ``width`` words is one shingle.
    """
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{_SPACE}|{_SPACE}$", ""), _SPACE)

    def hashes(w: Column) -> Column:
        whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
        ids = F.transform(w, lambda x: F.xxhash64(x))
        many = _bind(ids, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(h[i + j] for j in range(width)))))
        return F.when((F.size(w) == 1) & (w[0] == ""), F.array().cast("array<long>")).when(F.size(w) < width, whole).otherwise(many)

    return F.slice(F.sort_array(F.array_distinct(_bind(words, hashes))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all, 0 to 1; two empty sketches are alike."""
    both = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(_bind(merged(a, b, k), both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    """The sketch as hex digits, 16 for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def bucketed(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, coarse: int = COARSE) -> DataFrame:
    """docs (id, text) with ``b1`` and ``b2``, which rise with the id: quantiles, then even cuts between."""
    low, high, n = docs.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if not n:
        return docs.select("*", F.lit(0).alias("b1"), F.lit(0).alias("b2"))
    parts = max(1, min(coarse, n // bucket_rows))
    cuts = docs.stat.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = [low, *sorted({int(c) for c in cuts if low < c < high})]
    fine = max(1, n // (bucket_rows * len(cuts)))
    edges = F.array(*(F.lit(c).cast("long") for c in cuts))
    b1 = F.size(F.filter(edges, lambda e: e <= F.col("id"))) - 1
    ends = F.array(*(F.lit(c).cast("long") for c in [*cuts[1:], high + 1]))
    low_of, high_of = F.get(edges, b1), F.get(ends, b1)
    b2 = F.floor((F.col("id") - low_of) / (high_of - low_of) * fine).cast("int")
    return docs.withColumn("b1", b1).withColumn("b2", b2)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (id, text) with sketch, next_text and next_sketch of the next row by id; the first follows the last.

    Texts are shuffled once, by bucket.  Within a bucket ``lead`` finds the next row; the last row
    of each bucket is joined with the first row of the next one (a row per bucket each).
    """
    dealt = bucketed(docs)
    rows = Window.partitionBy("b1", "b2").orderBy("id", "tie")
    base = dealt.withColumn("tie", F.xxhash64("text")).withColumn("next_text", F.lead("text").over(rows)).withColumn("last", F.lead("tie").over(rows).isNull()).withColumn("rank", F.row_number().over(rows))
    sketched = base.withColumn("sketch", sketch(F.col("text"))).withColumn("next_sketch", F.lead("sketch").over(rows))
    inner = sketched.where(~F.col("last")).select("id", "text", "sketch", "next_text", "next_sketch")

    buckets = dealt.groupBy("b1", "b2").agg(F.count("*").alias("n"))
    ends = buckets.groupBy("b1").agg(F.min("b2").alias("first_b2"))  # COARSE rows at most
    whole = Window.orderBy("b1")
    ends = ends.select("b1", F.coalesce(F.lead("b1").over(whole), F.min("b1").over(Window.partitionBy())).alias("after_b1"))
    firsts_of = buckets.groupBy(F.col("b1").alias("after_b1")).agg(F.min("b2").alias("after_b2"))
    inside = buckets.withColumn("n_b2", F.lead("b2").over(Window.partitionBy("b1").orderBy("b2")))
    follows = inside.join(F.broadcast(ends), "b1").join(F.broadcast(firsts_of), "after_b1").select(
        "b1", "b2", F.when(F.col("n_b2").isNotNull(), F.col("b1")).otherwise(F.col("after_b1")).alias("n1"), F.coalesce("n_b2", "after_b2").alias("n2")
    )
    last = base.where("last").select("b1", "b2", "id", "text")
    first = base.where("rank = 1").select(F.col("b1").alias("n1"), F.col("b2").alias("n2"), F.col("text").alias("next_text"))
    outer = last.join(follows, ["b1", "b2"]).join(first, ["n1", "n2"])
    outer = outer.select("id", "text", sketch(F.col("text")).alias("sketch"), "next_text", sketch(F.col("next_text")).alias("next_sketch"))
    return inner.unionByName(outer)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_shingles (estimate).  A null text counts as
    empty.  Rows without an id have no place in the order: they follow nothing and are followed by
    nothing, so their columns on edited and next texts are null.  Repeated ids follow each other in
    the order of a hash of their texts.  No rows give no rows.  Other columns are not looked at.
    """
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = every.where("id IS NOT NULL")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    pairs = with_next(rows).select("id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    pairs = pairs.select("id", "n_chars", "sketch", "next_sketch", F.sha2(F.col("edited"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    null = lambda kind: F.lit(None).cast(kind)
    apart = every.where("id IS NULL").select("id", n.cast("long").alias("n_chars"), sketch(F.col("text")).alias("sketch"), null("array<long>").alias("next_sketch"), null("string").alias("edited_sha256"), null("array<long>").alias("edited_sketch"))
    pairs = pairs.unionByName(apart)
    return pairs.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )
