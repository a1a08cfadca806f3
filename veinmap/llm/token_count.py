"""Token counts by a whole-token shortcut.

A piece vocabulary with word-initial markers never merges across two kinds of borders: before a
run of spaces and around a line feed.  ``WholeTokens`` proves both on the vocabulary when it
loads, then proves for each vocabulary string that it encodes alone as exactly that one token.
Texts are cut at those borders; pre-tokens in the proven set count one token, and only the rest
are merged by the library (memoised, for words repeat).
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinmap.llm.common import map_rows

SPACE = "▁"
#: A line feed; spaces and the word after them; spaces at the end of a line.
BORDERS = re.compile(r"\n| *[^ \n]+| +")
#: Memoised pre-tokens beside the proven ones; the memo starts anew beyond it.
MEMO = 300_000
#: Longer pre-tokens are not memoised.
LONG = 64


class WholeTokens(dict):
    """Pre-token -> number of tokens; holds the proven whole tokens and a bounded memo."""

    def __init__(self, model_path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = {i: self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in normal.values()):
            raise ValueError("a piece of this vocabulary spans a border of pre-tokens")
        head = self.model.encode("\n")
        if len(head) != 2 or self.model.encode(" \n a\n") != [*self.model.encode(" \n"), *self.model.encode("\n a")[2:], head[1]]:
            raise ValueError("this model's normalisation does not keep spaces and line feeds as they are")
        texts = [p.replace(SPACE, " ") for p in normal.values()]
        alone = self.model.encode(["\n" + t for t in texts], num_threads=1)
        self.proven = {t: 1 for i, t, ids in zip(normal, texts, alone, strict=True) if ids[2:] == [i]}
        self.update(self.proven)

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode("\n" + word)) - 2
        if len(word) <= LONG:
            if len(self) > MEMO + len(self.proven):
                self.clear()
                self.update(self.proven)
            self[word] = n
        return n

    def count(self, text: str) -> tuple[int, int]:
        """Tokens, and how many of them are proven whole tokens."""
        if not text:
            return 0, 0
        words = BORDERS.findall(" " + text.replace(SPACE, " "))
        return sum(map(self.__getitem__, words)), sum(map(self.proven.__contains__, words))


@lru_cache(maxsize=2)
def loaded(model_path: str) -> WholeTokens:
    """Proven once in each Python worker."""
    return WholeTokens(model_path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text, as the library counts them without begin, end or special tokens.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_whole (tokens taken
    by the shortcut).  A null text counts as empty: 0 bytes, 0 tokens.  Null ids and repeated rows
    stay, a row each; no rows give no rows; other columns are not looked at; a very long text is
    counted whole.  Narrow: no shuffle.
    """

    def start():
        tokens = loaded(model_path)

        def step(ids, texts):
            texts = [t or "" for t in texts]
            counts = [tokens.count(t) for t in texts]
            return [ids, [len(t.encode()) for t in texts], [n for n, _ in counts], [n > limit for n, _ in counts], [w for _, w in counts]]

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [F.col(id_col), F.col(text_col)], f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean, n_whole long", start)
