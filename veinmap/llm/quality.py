"""Quality rules, line first.

Each line with a word is judged alone by three rules; failing lines are removed, and a document
that loses more than a share of its words is rejected:

* punctuation: over half of the words carry a symbol of ``SYMBOLS``, or end in ``!!``;
* navigation: at least two words are bare separators, and they are over a quarter of the words;
* boilerplate: a line of at most ``SHORT`` words holds a phrase of ``BOILERPLATE``.

No line fails for being in another language, for being short or for lacking a final stop.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinmap.llm.common import map_rows, rewrite_rows

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
SEPARATORS = frozenset([b"|", b">", b"<", b"||", b">>", b"<<"])
BOILERPLATE = (b"cookie policy", b"click here", b"subscribe to our newsletter", b"sign up", b"log in", b"skip to content", b"terms of use", b"privacy policy", b"hier klicken", b"newsletter abonnieren", b"zum inhalt springen", b"cliquez ici", b"aller au contenu", b"haz clic", b"saltar al contenido")
SHORT = 12
#: Whether a text holds none of these is seen at once; then no line of it can fail.
_SUSPECT = (b"!!", *BOILERPLATE)


def line_fails(words: list[bytes], line: bytes) -> bool:
    n = len(words)
    odd = sum(1 for w in words if w.endswith(b"!!") or len(w.translate(None, SYMBOLS)) < len(w))
    bars = sum(map(SEPARATORS.__contains__, words))
    return 2 * odd > n or (bars >= 2 and 4 * bars > n) or (n <= SHORT and any(p in line.lower() for p in BOILERPLATE))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that stand twice or more in the text, the first included."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    m = len(seen)
    pairs = ids[:-1] * m + ids[1:]
    if m >= 1 << 20:  # so that three ids fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    keys = pairs[:-1] * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : k + len(keys)] |= twice
    return int(cover.sum())


def _suspect(raw: bytes) -> bool:
    """Whether a line of the text can fail."""
    if len(raw.translate(None, SYMBOLS)) < len(raw):
        return True
    low = raw.lower()
    return any(p in low for p in _SUSPECT)


def cleaned(text: str | None) -> tuple[str | None, int]:
    """The text without its failing lines (null stays null), and how many words these have."""
    raw = (text or "").encode()
    if not _suspect(raw):
        return text, 0
    kept, removed = [], 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own and line_fails(own, line):
            removed += len(own)
        else:
            kept.append(line)
    return b"\n".join(kept).decode(), removed


def measures(text: str | None, lost_percent: int) -> tuple:
    """The columns of ``quality_rules``, and the cleaned text."""
    raw = (text or "").encode()
    words = raw.split()  # bytes.split() splits at x20 and x09-x0D
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    rest, removed = cleaned(text)
    repeats = repeated_words(words)
    base_failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    return len(words), chars, n_symbols, len(lines) - len(set(lines)), repeats, base_failed, removed, not base_failed and 100 * removed <= lost_percent * len(words), rest


def quality_rules(docs: DataFrame, lost_percent: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of each whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_removed_words (words of failing lines), kept and cleaned_sha256 (of the text without these
    lines).  A null or empty text has no words, so it fails.  Null ids and repeated rows stay; no
    rows give no rows; other columns are not looked at; a very long text is judged whole, in some
    ten times its size.  Narrow: no shuffle.
    """

    def start():
        def step(ids, texts):
            *columns, rest = zip(*(measures(t, lost_percent) for t in texts), strict=True)
            return [ids, *map(list, columns), [hashlib.sha256((t or "").encode()).hexdigest() for t in rest]]

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [F.col(id_col), F.col(text_col)], f"{id_col} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_removed_words long, kept boolean, cleaned_sha256 string", start)


def clean(docs: DataFrame, lost_percent: int = 30, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that the rules keep, their texts without failing lines.  Narrow: no shuffle."""
    return rewrite_rows(docs, text_col, lambda: lambda texts: [(found[-2], found[-1]) for found in (measures(t, lost_percent) for t in texts)])


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text without its failing lines (null stays null)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [F.col(id_col), F.col(text_col)], f"{id_col} {kind}, {text_col} string", lambda: lambda ids, texts: [ids, [cleaned(t)[0] for t in texts]])


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
t AS (SELECT doc_id, i, w, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w1, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM w),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) AS n FROM t WHERE w2 IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT doc_id, line, i, {_WORDS.format("line")} AS words FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT doc_id, line, i, len(words) AS n,
    2 * len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&|<>]') OR suffix(x, '!!'))) > len(words)
    OR (len(list_filter(words, lambda x: list_contains(['|', '>', '<', '||', '>>', '<<'], x))) >= 2
        AND 4 * len(list_filter(words, lambda x: list_contains(['|', '>', '<', '||', '>>', '<<'], x))) > len(words))
    OR (len(words) <= {SHORT} AND regexp_matches(line, '(?i)({"|".join(p.decode() for p in BOILERPLATE)})')) AS fails
  FROM l),
rest AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS rest FROM (SELECT doc_id, line, i FROM l0 ANTI JOIN (SELECT doc_id, i FROM judged WHERE fails) AS f USING (doc_id, i)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE fails), 0) AS n_removed_words FROM judged GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(d.words, '')) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words, sha256(coalesce(rest, '')) AS cleaned_sha256
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN rest USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
  NOT base_failed AND 100 * n_removed_words <= 30 * n_words AS kept, cleaned_sha256
FROM b
"""
