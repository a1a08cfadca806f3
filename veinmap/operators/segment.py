"""Segmentation of long texts: by headings, by size, around keywords.

Heading cuts are expressions: the headings, what ``split`` leaves between them, and running lengths (an
Arrow function on the lengths alone) give the places; sections leave as rows, and small ones are folded as the rows
stream by.  Fixed-size cuts depend on the cut before and windows on those kept before, so both are
table functions, linear in the text.  Places are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinmap.functions.text import strip

#: Rows, and code points of text, that leave a task at a time, about.
ROWS, CHARS = 4096, 4 << 20
_HASH = r"[ \t\n\x0b\f\r\x1c-\x1f\x85\p{Z}]"
#: A heading: hashes at the start of a line, white space (line feeds too), the rest of the line.
HEADING = rf"^(#{{1,6}})({_HASH}+)([^\n]+)$"


def _running(lengths: Column) -> Column:
    """Running sums of an array, in linear time."""

    def sums(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else np.cumsum(a, dtype=np.int64))

    return F.pandas_udf(sums, "array<long>")(lengths)


def sections(text: Column) -> Column:
    """Chunks of a text before small ones are folded: preamble and one per heading with a body; a text without headings is one."""
    n = F.length(text)
    pattern = rf"(?md){HEADING}"
    heads = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))  # a heading may not begin inside another
    bodies = F.split(text, pattern, -1)
    ends = _running(F.transform(F.arrays_zip(heads.alias("head"), bodies.alias("body")), lambda z: F.length(z["head"]) + F.length(z["body"])))
    pieces = F.arrays_zip(heads.alias("head"), bodies.alias("body"), ends.alias("end"))
    head = rf"(?d)\A(#{{1,6}})({_HASH}+)([^\n]+)"

    def chunk(p: Column) -> Column:
        level = F.length(F.regexp_extract(p["head"], head, 1))
        return F.struct(
            F.when(level == 0, F.lit("preamble")).otherwise(strip(F.regexp_extract(p["head"], head, 3))).alias("title"),
            strip(p["body"]).alias("content"), (p["end"] - F.length(p["head"]) - F.length(p["body"])).cast("int").alias("start_char"), p["end"].cast("int").alias("end_char"), level.cast("int").alias("level"),
        )

    whole = F.array(F.struct(F.lit("full_document").alias("title"), strip(text).alias("content"), F.lit(0).alias("start_char"), n.cast("int").alias("end_char"), F.lit(0).alias("level")))
    return F.when(~text.rlike(pattern), whole).otherwise(F.filter(F.transform(pieces, chunk), lambda c: c["content"] != ""))


def folded(rows: DataFrame, min_size: int, id_col: str) -> DataFrame:
    """Rows of ``sections`` in order, where one joins the one before it while that one is shorter than ``min_size``.

    Rows stream by; a document begins with index 0.  Only the parts of one chunk are held.
    """
    names = rows.columns

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, titles, contents, size, number = None, [], [], 0, 0

        def chunk() -> list[tuple]:
            return [] if head is None else [(head[0], number, " + ".join(titles), "\n\n".join(contents), *head[1:])]

        for pdf in pdfs:
            out = []
            for key, index, title, content, start, end, level in pdf.itertuples(index=False, name=None):
                if head is not None and index and size < min_size:
                    titles.append(title)
                    contents.append(content)
                    size, head[2] = size + 2 + len(content), end
                    continue
                out += chunk()
                head, titles, contents, size, number = [key, start, end, level], [title], [content], len(content), number + 1 if index else 0
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(chunk(), columns=names)

    return rows.mapInPandas(run, rows.schema)


def _each_text(docs: DataFrame, id_col: str, text_col: str, rows: Callable[[str], Iterator[tuple]], ddl: str) -> DataFrame:
    """id and ``rows`` of each text (ddl: of int and string).  A task holds one text and a bounded number of rows as Python objects."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [f.split(" ") for f in ddl.split(", ")]

    def run(batches):
        import pyarrow as pa

        types = [{"int": pa.int32(), "string": pa.string()}[t] for _, t in fields]
        for batch in batches:
            ids, texts, at, out, size = batch.column(0), batch.column(1), [], [], 0

            def made() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *columns], names=[id_col, *(n for n, _ in fields)])

            for i in range(batch.num_rows):
                for row in rows(texts[i].as_py() or ""):
                    at.append(i)
                    out.append(row)
                    size += sum(len(v) for v in row if isinstance(v, str))
                    if len(out) >= ROWS or size >= CHARS:
                        yield made()
                        at, out, size = [], [], 0
            if out:
                yield made()

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {ddl}")


def _counted(out: DataFrame) -> DataFrame:
    return out.withColumn("char_count", F.length("content")).withColumn("line_count", F.regexp_count("content", F.lit("\n")) + 1)


def segment_headings(docs: DataFrame, min_size: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections by heading; a text without headings is one chunk.  A null text has no chunks."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(id_col, F.posexplode(sections(text)).alias("index", "c")).select(id_col, "index", "c.*")
    return _counted(folded(rows, min_size, id_col) if min_size > 0 else rows)


def fixed_cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Places of the cuts: at most ``size`` code points, after the last line feed of the second half if there is one."""
    cuts, start, n = [], 0, len(text)
    while text.strip() and start < n:
        end = min(start + size, n)
        if end < n and (feed := text.rfind("\n", start, end)) > start + size // 2:
            end = feed + 1
        cuts.append((start, end))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return cuts


def segment_fixed(docs: DataFrame, size: int = 4000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of a size with overlap; blank texts and blank chunks give none."""

    def rows(text: str) -> Iterator[tuple]:
        own = ((a, b, c) for a, b in fixed_cuts(text, size, overlap) if (c := text[a:b].strip()))
        return ((i, f"chunk_{i}", c, a, b, 0) for i, (a, b, c) in enumerate(own))

    return _counted(_each_text(docs, id_col, text_col, rows, "index int, title string, content string, start_char int, end_char int, level int"))


def keyword_windows(text: str, keywords: list[str], window: int) -> Iterator[tuple[str, int, int, int]]:
    """keyword, place, start, stop of each match, keyword by keyword, that is at least ``window`` from those kept before.

    Kept places are that far apart, so each stretch of ``window`` holds one at most: a match looks
    into its own stretch and the two beside it.
    """
    kept: dict[int, int] = {}
    for keyword in keywords:
        for m in re.finditer(re.escape(keyword), text, re.IGNORECASE):
            at = m.start()
            if window > 0:
                own = at // window
                if any(abs(at - kept[k]) < window for k in (own - 1, own, own + 1) if k in kept):
                    continue
                kept[own] = at
            yield keyword, at, max(0, at - window), min(len(text), at + window)


def segment_keywords(docs: DataFrame, keywords: list[str], window: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows around keywords (any case), keyword by keyword; a match nearer than ``window`` to a kept one is skipped.

    Blank windows give no chunk; a null text none at all.  Linear in the text and its matches.
    """

    def rows(text: str) -> Iterator[tuple]:
        own = ((k, at, a, b, c) for k, at, a, b in keyword_windows(text, keywords, window) if (c := text[a:b].strip()))
        return ((i, f"keyword:{k}", c, a, b, 0, k, at) for i, (k, at, a, b, c) in enumerate(own))

    return _each_text(docs, id_col, text_col, rows, "index int, title string, content string, start_char int, end_char int, level int, keyword string, match_position int")
