"""Byte-level BPE by speculation and verification.

Greedy longest match proposes tokens for all new words of a batch at once (a walk over a trie,
vectorised across words).  A sequence of tokens is the encoding exactly if every adjacent pair
would stay a pair when encoded alone; a vectorised check replays, for all distinct pairs, the
merges on both sides of the border and looks for one that would cross it earlier.  Only words with
a failing pair, or with a token that its own merges do not produce, are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinmap.llm.common import map_rows

#: Words whose ids a worker keeps, of at most LONG bytes; longer ones are merged exactly, in n log n.
MEMO, LONG = 300_000, 128
#: Unicode white space, spelt out, for engines differ on the information separators.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_NEVER = np.int64(1) << 40


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in printable} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in printable)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.id_of_byte = [0] * 256
        for t, i in vocab.items():
            if len(t) == 1:
                self.id_of_byte[byte_of[t]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, token
        size = len(self.bytes_of)
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (vocab[x] for x in (m.split(" ") if isinstance(m, str) else m))
            token = vocab["".join(m.split(" ") if isinstance(m, str) else m)]
            self.merges.setdefault((a, b), (r, token))
            if self.rank[token] < 0:
                self.rank[token], self.left[token], self.right[token] = r, a, b
        if any(max(self.rank[a], self.rank[b]) >= r for (a, b), (r, _) in self.merges.items()):
            raise ValueError("a merge stands before the merges of its parts")
        pairs = np.array([(a << 20) | b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self._grow_trie({self.bytes_of[i]: i for i in vocab.values()})
        tokens = [t for t in vocab.values() if self.rank[t] >= 0 or len(self.bytes_of[t]) == 1]
        self.sound = np.zeros(size, bool)  # its own merges produce it
        self.sound[tokens] = [self.exact(self.bytes_of[t]) == [t] for t in tokens]
        self.memo: dict[str, bytes] = {}

    def _grow_trie(self, tokens: dict[bytes, int]) -> None:
        edges, token_at = {}, [-1]
        for raw, token in tokens.items():
            node = 0
            for b in raw:
                to = edges.get((node << 8) | b)
                if to is None:
                    to = edges[(node << 8) | b] = len(token_at)
                    token_at.append(-1)
                node = to
            token_at[node] = token
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edges, self.ends, self.token_at = keys[order], np.array(list(edges.values()), np.int64)[order], np.array(token_at, np.int64)
        self.first = np.full(256, -1, np.int64)
        for b in range(256):
            self.first[b] = edges.get(b, -1)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches: tokens of all words in order, and how many each word has."""
        buffer = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        word, end = np.arange(len(words)), ends
        at = ends - [len(w) for w in words]
        node, token, token_end = np.zeros_like(at), np.full_like(at, -1), at.copy()
        out_word, out_token = [], []
        while len(word):
            b = buffer[at]
            key = (node << 8) | b
            i = np.searchsorted(self.edges, key).clip(max=len(self.edges) - 1)
            to = np.where(node == 0, self.first[b], np.where(self.edges[i] == key, self.ends[i], -1))
            on = (to >= 0) & (at < end)
            node = np.where(on, to, 0)
            at = at + on
            hit = np.where(on, self.token_at[node], -1)
            token, token_end = np.where(hit >= 0, hit, token), np.where(hit >= 0, at, token_end)
            if not on.all():
                off = ~on
                out_word.append(word[off])
                out_token.append(token[off])
                at[off] = token_end[off]
                token[off] = -1
                live = on | (at < end)
                if not live.all():
                    word, end, at, node, token, token_end = (x[live] for x in (word, end, at, node, token, token_end))
        owners, tokens = np.concatenate(out_word), np.concatenate(out_token)
        order = np.argsort(owners, kind="stable")
        return tokens[order], np.bincount(owners, minlength=len(words))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b stay a pair.

        Goes back in time from the finished tokens.  ``a`` and ``b`` are what stands at the border;
        ``until`` is when the earlier of them is consumed by its own side (twice the rank; on the
        right side plus 1, for among equal ranks the left merge comes first).
        """
        a, b = a.copy(), b.copy()
        good, until = np.ones(len(a), bool), np.full(len(a), _NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = (x << 20) | y
            i = np.searchsorted(self.pairs, key).clip(max=len(self.pairs) - 1)
            crossing = np.where(self.pairs[i] == key, 2 * self.pair_rank[i], _NEVER)
            bad = crossing < until[live]
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(~undo_left & (ry >= 0), self.left[y], y)
            until[live] = np.where(undo_left, 2 * rx, 2 * ry + 1)
            live = live[~bad & ((rx >= 0) | (ry >= 0))]
        return good

    def exact(self, word: bytes) -> list[int]:
        """Merges the lowest rank first, the leftmost among equals."""
        ids = [self.id_of_byte[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (merge := self.merges.get((ids[i], ids[j]))) is None or merge[0] != rank:
                continue
            ids[i], ids[j] = merge[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], int]:
        """Ids of each word (little-endian, 32 bits), and how many words had to be merged exactly."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            out = [b""] * len(words)
            for i in long:
                out[i] = np.array(self.exact(words[i]), "<u4").tobytes()
            rest = [i for i, w in enumerate(words) if len(w) <= LONG]
            found, failed = self.encode_words([words[i] for i in rest]) if rest else ([], 0)
            for i, ids in zip(rest, found, strict=True):
                out[i] = ids
            return out, failed + len(long)
        tokens, sizes = self.propose(words)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        wrong = np.zeros(len(words), bool)
        wrong[owner[~self.sound[tokens]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, of = np.unique((tokens[inner] << 20) | tokens[inner + 1], return_inverse=True)
        fine = self.compatible(pairs >> 20, pairs & ((1 << 20) - 1))
        wrong[owner[inner[~fine[of]]]] = True
        raw = tokens.astype("<u4").tobytes()
        out = [raw[4 * s : 4 * (s + n)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        failing = np.flatnonzero(wrong).tolist()
        for i in failing:
            out[i] = np.array(self.exact(words[i]), "<u4").tobytes()
        return out, len(failing)

    def words(self, text: str) -> list[str]:
        """Pre-tokens; special strings stand alone, as the library's default has it."""
        if not self.splits or not any(s in text for s in self.special):
            return WORDS.findall(text)
        out, at = [], 0
        for m in self.splits.finditer(text):
            out += [*WORDS.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + WORDS.findall(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        every = [self.words(t) for t in texts]
        distinct = {w for own in every for w in own}
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo.update({s: np.array([i], "<u4").tobytes() for s, i in self.special.items()})
        new = [w for w in distinct if w not in self.memo]
        ids = dict(zip(new, self.encode_words([w.encode() for w in new])[0], strict=True)) if new else {}
        long = {w: i for w, i in ids.items() if len(w) > LONG}
        self.memo.update((w, i) for w, i in ids.items() if len(w) <= LONG)
        get = (lambda w: long[w] if w in long else self.memo[w]) if long else self.memo.__getitem__
        return [b"".join(map(get, own)) for own in every]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of each whole text; a null text has no ids."""

    def start():
        coder = loaded(path)
        return lambda doc_ids, texts: [doc_ids, coder.encode([t or "" for t in texts])]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [F.col(id_col), F.col(text_col)], f"{id_col} {kind}, ids binary", start)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text and decodes it again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids and decoded text are those of the tokenizers library without added special tokens; special
    strings inside texts become their ids and are decoded too.  A null text counts as empty.  Null
    ids and repeated rows stay; no rows give no rows; other columns are not looked at.  Words of
    any length cost n log n and are not kept.  Narrow: no shuffle.
    """

    def start():
        coder = loaded(path)

        def step(doc_ids, texts):
            ids = coder.encode([t or "" for t in texts])
            return [doc_ids, [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids]]

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [F.col(id_col), F.col(text_col)], f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", start)
