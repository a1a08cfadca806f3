"""Packing along a space-filling curve.

Each document's hashed token vector is projected to ``DIMS`` dimensions; the cell's Hilbert key
orders documents so that neighbours are alike.  Documents are laid end to end in that order (a
distributed running sum), and the line is cut every ``length`` tokens: a sequence then holds
neighbouring documents, and only the last sequence of all has padding.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinmap.llm import bpe
from veinmap.llm.common import cut, map_rows

DIMS, BITS = 4, 10


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of integer cells (rows: points), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


@lru_cache(maxsize=1)
def tokenizer(path: str):
    """The byte-level vocabulary of a tokenizers file, with its special strings.

    Its encoder takes ids for the ranks of merges; that the file's merges give ascending ids, one
    merge a token, is proven here.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in printable} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in printable)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    singles = {i for raw, i in ranks.items() if len(raw) == 1}
    if any(a >= b for a, b in zip(merged, merged[1:])) or (merged and max(singles) > merged[0]) or len(singles) != 256 or singles | set(merged) != set(ranks.values()):
        raise ValueError("this vocabulary's ids don't rise with its merges")
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(path: str, text: str | None) -> np.ndarray:
    """Ids of a text.  The encoder gives up on a very long run of white space; such a text goes to the exact one."""
    if not text:
        return np.zeros(0, np.uint32)
    try:
        return tokenizer(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.frombuffer(bpe.loaded(path).encode([text])[0], "<u4")


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n, key, ids (little-endian, 16 bits if they fit)."""

    def start():
        coder = tokenizer(path)
        towards = np.random.default_rng(7).standard_normal((coder.n_vocab, DIMS)).astype(np.float32)
        kind = "<u2" if coder.n_vocab <= 1 << 16 else "<u4"
        first, seen = (TaskContext.get().partitionId() << 40), 0

        def step(doc_ids, texts):
            nonlocal seen
            found = [ids_of(path, t) for t in texts]
            sums = np.stack([towards[f].sum(axis=0) for f in found])
            norms = np.sqrt(np.maximum([[len(f)] for f in found], 1))
            cells = (((1 << BITS) - 1) / (1 + np.exp(-sums / norms / 4))).astype(np.int64)  # 4: spreads languages over the range
            rows = list(range(first + seen, first + seen + len(texts)))
            seen += len(texts)
            return [rows, doc_ids, [len(f) + 1 for f in found], hilbert_keys(cells, BITS).tolist(), [np.append(f, end_id).astype(kind).tobytes() for f in found]]

        return step

    return map_rows(docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)], "row long, doc_id long, n long, key long, ids binary", start)


def laid_out(rows: DataFrame) -> DataFrame:
    """row, at: the first token's place on the line, by key and doc_id.

    A range sort deals documents (equal keys too, by their ids) over partitions; running sums
    within each and the partitions' totals (one row each) add up to global places.
    """
    order = ["key", "doc_id", "row"]
    dealt = cut(rows.select(*order, "n").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(*order)) - F.col("n")
    return dealt.withColumn("within", within).join(F.broadcast(before), "part").select("row", (F.col("before") + F.col("within")).alias("at"))  # a row per partition


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A document's tokens
    are its ids without added special tokens, then ``end_id``; a null or empty text has that id
    alone.  Repeated rows and null ids are packed like any other row.  No rows give no rows.  Other
    columns are not looked at.  A text of any length is one row of ids, some 12 bytes a token.
    """
    rows = cut(tokenized(docs, path, end_id, id_col, text_col))
    joined = rows.select("row", "doc_id", "ids").join(laid_out(rows).hint("shuffle_hash"), "row")

    def start():
        kind = "<u2" if tokenizer(path).n_vocab <= 1 << 16 else "<u4"

        def step(doc_ids, places, all_ids):
            out = [[] for _ in range(7)]
            for doc_id, at, ids in zip(doc_ids, places, all_ids, strict=True):
                ids = np.frombuffer(ids, kind).astype("<u4")
                done = 0
                while done < len(ids):
                    sequence, offset = divmod(at + done, length)
                    size = min(length - offset, len(ids) - done)
                    for column, value in zip(out, (doc_id, done, size, zlib.crc32(ids[done : done + size].tobytes()), len(ids), sequence, offset), strict=True):
                        column.append(value)
                    done += size
            return out

        return step

    return map_rows(joined, ["doc_id", "at", "ids"], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", start)
