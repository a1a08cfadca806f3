"""Finding many names at once: one automaton of all of them goes through each text.

The names are collected on the driver (a vocabulary: classes, properties and their keywords; its size
is checked) and shipped once to each executor; a text is read once, whatever the number of names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most names, and characters of them, that are shipped.
MOST_NAMES, MOST_CHARACTERS = 1_000_000, 50_000_000
_SCHEMA = "name string, n long, first long"


def vocabulary(names: DataFrame, column: str = "name") -> list[str]:
    """The distinct non-empty names of a column, in order; too many of them are an error."""
    rows = names.select(F.col(column).alias("name")).where(F.coalesce(F.col("name") != "", F.lit(False))).distinct()
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("c")).first()
    if size.n > MOST_NAMES or size.c > MOST_CHARACTERS:
        raise ValueError(f"{size.n} names of {size.c} characters are no vocabulary; join them instead")
    return sorted(r.name for r in rows.collect())  # bounded just now


def mentions(docs: DataFrame, names: list[str], lowered: bool = False, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, name, n, first: how often each name stands in each text, overlaps counted, and where first (code points from 0).

    ``lowered``: texts are lower-cased first (a name with capitals then never matches).  ``whole``: no
    letter, digit or underscore may stand next to the name.  A null text has no mention.  Narrow; time
    grows with the text and its mentions.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in shared.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        word = lambda c: c.isalnum() or c == "_"
        for pdf in pdfs:
            out = []
            for key, text in zip(pdf[id_col], pdf[text_col]):
                text = (text.lower() if lowered else text) if text and len(automaton) else ""
                found: dict[str, list[int]] = {}
                for end, name in automaton.iter(text) if text else ():
                    start = end - len(name) + 1
                    if whole and (start and word(text[start - 1]) or end + 1 < len(text) and word(text[end + 1])):
                        continue
                    own = found.setdefault(name, [0, start])
                    own[0] += 1
                out += [(key, name, n, first) for name, (n, first) in found.items()]
            yield pd.DataFrame(out, columns=[id_col, "name", "n", "first"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, {_SCHEMA}")
