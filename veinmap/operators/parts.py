"""Documents that lie in many rows: id, part (their order), text.

The parts of a document stream through a task in order, and what a border may cut is carried over it:
an open chunk, the end of a keyword, an unfinished heading, a phrase.  Only that is held, never a
document.  Results are those of the whole text, wherever it was cut.  A null part is empty; places
are code points of the whole document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinmap.functions.text import strip
from veinmap.operators import extract as rules
from veinmap.operators.segment import CHARS, ROWS, folded, sections

#: Code points of a cell of the grid that windows are put together from.
CELL = 2048
#: What no extraction pattern takes, nor looks at beyond: a text may be cut behind it.
BORDER = re.compile(r"[^\w\s:=.°%/³²·–\-]")
#: A piece between borders is at least so long.
PIECE = 65_536
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)
_UNFINISHED = re.compile(r"^#{1,6}(?:\s+[^\n]*)?\Z", re.MULTILINE)


class Fixed:
    """index, start, stop, content of chunks of a size with overlap; blank ones are left out."""

    ddl = "index int, start_char long, end_char long, content string"

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap, self.held, self.start, self.index = size, overlap, "", 0, 0

    def cut(self, last: bool) -> Iterator[tuple]:
        while self.held and (last or len(self.held) > self.size):
            end = min(self.size, len(self.held))
            if end < len(self.held) and (feed := self.held.rfind("\n", 0, end)) > (self.start + self.size // 2) - self.start:
                end = feed + 1
            if content := self.held[:end].strip():
                yield self.index, self.start, self.start + end, content
                self.index += 1
            if end == len(self.held):
                self.held = ""
                return
            step = max(end - self.overlap, 1)
            self.held, self.start = self.held[step:], self.start + step

    def feed(self, text: str) -> Iterator[tuple]:
        self.held += text
        return self.cut(False)

    def end(self) -> Iterator[tuple]:
        return self.cut(True)


class Pieces:
    """seq, start, text: the document cut anew, all of it, in order, where ``place`` says by the text held, how far it was seen, and whether it is the last."""

    ddl = "seq int, start long, text string, last boolean"

    def __init__(self, place: Callable[[str, int, bool], tuple[int, int]]):
        self.place, self.held, self.seen, self.start, self.seq = place, "", 0, 0, 0

    def piece(self, n: int, last: bool) -> tuple:
        row = (self.seq, self.start, self.held[:n], last)
        self.held, self.start, self.seq = self.held[n:], self.start + n, self.seq + 1
        return row

    def cut(self, last: bool) -> Iterator[tuple]:
        while True:
            n, self.seen = self.place(self.held, self.seen, last)
            if not n:
                return
            yield self.piece(n, False)
            self.seen = max(0, self.seen - n)

    def feed(self, text: str) -> Iterator[tuple]:
        self.held += text
        return self.cut(False)

    def end(self) -> Iterator[tuple]:
        yield from self.cut(True)
        if self.held or not self.seq:
            yield self.piece(len(self.held), True)


def at_heading(text: str, seen: int, last: bool) -> tuple[int, int]:
    """Length of the section at the text's start, if the next heading is whole; else 0 and from where to look on."""
    for m in _HEADING.finditer(text, seen):
        if not last and (m.end() == len(text) or text[m.end(1) :].isspace()):  # white space may still end elsewhere
            return 0, m.start()
        if m.start():
            return m.start(), m.end()
        seen = m.end()
    line = text.rfind("\n", 0, len(text)) + 1
    open_ = _UNFINISHED.search(text, seen)
    return 0, max(seen, min(line, open_.start()) if open_ else line)


def at_border(least: int) -> Callable[[str, int, bool], tuple[int, int]]:
    """Length up to a border, at least ``least``; else 0 and from where to look on."""

    def place(text: str, seen: int, last: bool) -> tuple[int, int]:
        m = BORDER.search(text, max(seen, least - 1))
        return (m.end(), 0) if m else (0, len(text))

    return place


def at_cell(size: int) -> Callable[[str, int, bool], tuple[int, int]]:
    return lambda text, seen, last: (size, 0) if len(text) >= size else (0, 0)


class Matches:
    """k, at: places of keyword number k, in any case, without overlap."""

    ddl = "k int, at long"

    def __init__(self, keywords: list[str]):
        self.found = [(k, w, re.compile(re.escape(w), re.IGNORECASE)) for k, w in enumerate(keywords)]
        self.held, self.base, self.next = "", 0, [0] * len(keywords)

    def feed(self, text: str) -> Iterator[tuple]:
        self.held += text
        for k, word, pattern in self.found:
            for m in pattern.finditer(self.held, max(0, self.next[k] - self.base)):
                yield k, self.base + m.start()
                self.next[k] = self.base + m.end()
            self.next[k] = max(self.next[k], self.base + len(self.held) - len(word) + 1)
        keep = max(len(w) for _, w, _ in self.found) - 1
        drop = max(0, len(self.held) - keep)
        self.held, self.base = self.held[drop:], self.base + drop

    def end(self) -> Iterator[tuple]:
        return iter(())


class Kept:
    """rank, k, at of the matches at least ``window`` from those kept before; fed by rows of Matches."""

    ddl = "rank int, k int, at long"

    def __init__(self, window: int):
        self.window, self.kept, self.rank = window, {}, 0

    def feed(self, row: tuple[int, int]) -> Iterator[tuple]:
        k, at = row
        if self.window > 0:
            own = at // self.window
            if any(abs(at - self.kept[x]) < self.window for x in (own - 1, own, own + 1) if x in self.kept):
                return
            self.kept[own] = at
        yield self.rank, k, at
        self.rank += 1

    def end(self) -> Iterator[tuple]:
        return iter(())


def _fed(rows: DataFrame, order: list[str], values: list[str], ddl: str, start: Callable[[], object], id_col: str) -> DataFrame:
    """Feeds each document's rows, in order, to a state of its own; gives id and what the state yields."""
    names = [id_col, *(x.split(" ")[0] for x in ddl.split(", "))]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out, size = None, None, [], 0
        for pdf in pdfs:
            for mine, *row in pdf.itertuples(index=False, name=None):
                before = len(out)
                if state is None or mine != key:
                    out += [(key, *x) for x in state.end()] if state else []
                    key, state = mine, start()
                out += [(key, *x) for x in state.feed((row[0] or "") if len(row) == 1 else tuple(row))]
                size += sum(len(v) for x in out[before:] for v in x if isinstance(v, str))
                if len(out) >= ROWS or size >= CHARS:  # a frame is dear: many rows share one, bounded in rows and in text
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        out += [(key, *x) for x in state.end()] if state else []
        if out:
            yield pd.DataFrame(out, columns=names)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.repartition(id_col).sortWithinPartitions(id_col, *order).select(id_col, *values).mapInPandas(run, f"{id_col} {kind}, {ddl}")


def recut(parts: DataFrame, place: Callable[[str, int, bool], tuple[int, int]], id_col: str = "doc_id", part_col: str = "part", text_col: str = "text") -> DataFrame:
    """id, seq, start, text, last: the documents cut anew (``at_heading``, ``at_border``, ``at_cell``)."""
    return _fed(parts, [part_col], [text_col], Pieces.ddl, lambda: Pieces(place), id_col)


def segment_fixed(parts: DataFrame, size: int = 4000, overlap: int = 200, id_col: str = "doc_id", part_col: str = "part", text_col: str = "text") -> DataFrame:
    """id, index, start_char, end_char, content, as of the whole texts."""
    return _fed(parts, [part_col], [text_col], Fixed.ddl, lambda: Fixed(size, overlap), id_col)


def segment_headings(parts: DataFrame, min_size: int = 100, id_col: str = "doc_id", part_col: str = "part", text_col: str = "text") -> DataFrame:
    """id, index, title, content, start_char, end_char, level, as of the whole texts."""
    pieces = recut(parts, at_heading, id_col, part_col, text_col)
    found = pieces.select(id_col, "seq", "start", "last", F.posexplode(sections(F.col("text"))).alias("i", "c"))
    bare = (F.col("c.title") == "full_document") & (F.col("c.level") == 0) & ~F.col("last")  # a heading follows
    rows = found.where(~bare | (F.col("c.content") != "")).select(id_col, "seq", "i", F.when(bare, "preamble").otherwise(F.col("c.title")).alias("title"), "c.content", *((F.col(f"c.{x}") + F.col("start")).cast("int").alias(x) for x in ("start_char", "end_char")), "c.level")
    values = ["title", "content", "start_char", "end_char", "level"]
    numbered = _fed(rows, ["seq", "i"], values, "index int, title string, content string, start_char int, end_char int, level int", _Counted, id_col)
    return folded(numbered, min_size, id_col) if min_size > 0 else numbered


def segment_keywords(parts: DataFrame, keywords: list[str], window: int = 500, id_col: str = "doc_id", part_col: str = "part", text_col: str = "text") -> DataFrame:
    """id, index, keyword, match_position, start_char, end_char, content, as of the whole texts.

    Places first; then the windows' texts from the cells of a grid that they touch.
    """
    length = parts.groupBy(id_col).agg(F.sum(F.length(F.coalesce(text_col, F.lit("")))).alias("__n"))
    found = _fed(parts, [part_col], [text_col], Matches.ddl, lambda: Matches(keywords), id_col)
    kept = _fed(found, ["k", "at"], ["k", "at"], Kept.ddl, lambda: Kept(window), id_col).join(length, id_col)
    spans = kept.select(id_col, "rank", F.get(F.array(*map(F.lit, keywords)), F.col("k")).alias("keyword"), F.col("at").alias("match_position"), F.greatest(F.lit(0), F.col("at") - window).alias("start_char"), F.least(F.col("__n"), F.col("at") + window).alias("end_char"))
    cells = spans.withColumn("seq", F.explode(F.sequence(F.floor(F.col("start_char") / CELL), F.floor(F.greatest(F.col("end_char") - 1, F.col("start_char")) / CELL)).cast("array<int>")))
    grid = recut(parts, at_cell(CELL), id_col, part_col, text_col).select(id_col, "seq", "text")
    texts = cells.join(grid, [id_col, "seq"]).groupBy(id_col, "rank", "keyword", "match_position", "start_char", "end_char").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("__t"))  # the cells of a window
    own = strip(F.substring(F.col("__t"), (F.col("start_char") % CELL + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int")))
    rows = texts.withColumn("content", own).where("content <> ''")
    return _fed(rows, ["rank"], ["keyword", "match_position", "start_char", "end_char", "content"], "index int, keyword string, match_position long, start_char long, end_char long, content string", _Counted, id_col)


class _Counted:
    def __init__(self):
        self.n = 0

    def feed(self, row):
        yield self.n, *row
        self.n += 1

    def end(self):
        return iter(())


def extract(parts: DataFrame, id_col: str = "doc_id", part_col: str = "part", text_col: str = "text") -> DataFrame:
    """The results of rule extraction, as of the whole texts: pieces between borders, put together in order."""
    pieces = recut(parts, at_border(PIECE), id_col, part_col, text_col)
    found = rules.extract(pieces.select(F.struct(id_col, "seq").alias("at"), "text"), "at", "text")
    lists = ["individuals", "properties", "relationships", "temperature_ranges"]
    rows = found.groupBy(F.col("at")[id_col].alias(id_col)).agg(F.array_sort(F.collect_list(F.struct(F.col("at")["seq"].alias("seq"), *lists)), lambda a, b: a["seq"] - b["seq"]).alias("all"), F.sum("text_length").alias("text_length"))  # a document's results
    rows = rows.select(id_col, *(F.flatten(F.col("all")[c]).alias(c) for c in lists), F.col("text_length").cast("int").alias("text_length"))
    rows = rows.withColumn("__names", F.array_distinct(F.col("individuals")["name"]))
    rows = rows.withColumn("individuals", F.transform("__names", lambda n: F.struct(n.alias("name"), F.lit("Alloy").alias("type"), rules.composition(n).alias("composition"), F.lit(0.8).alias("extraction_confidence")))).drop("__names")
    return rows.withColumn("total_items", F.size("individuals") + F.size("properties") + F.size("relationships"))
