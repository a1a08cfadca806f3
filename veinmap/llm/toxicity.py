"""Toxicity as a multiple-instance problem.

A document is a bag of sentences.  A sentence's probability is zero without known words; else it is
a logistic function of them, of which FLOOR counts as zero, so that faint signs don't add up over a
long text.  The document's is their leaky noisy-or: 1 - (1 - leak) * prod(1 - q_s), where the leak, for
words that nobody knows, grows with the number of sentences, to LEAK at most.  The weights are learned from
document labels alone, through this very noisy-or; the sentence probabilities then tell where the
offence stands.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinmap.llm.common import cut, keep_rows, map_rows

#: Word hashes are taken modulo this; the weights' size is bounded by it (4 bytes each).
BUCKETS = 1 << 20
#: Sentences end at these.
_ENDS = bytes.maketrans(b".!?;\r", b"\n\n\n\n\n")
#: Left out of words.
_MARKS = b"\"'#$%&()*+,-/:<=>@[\\]^_`{|}~0123456789"
#: Words whose weights a worker keeps.
MEMO = 100_000
#: A sentence's logistic score up to this counts as zero.
FLOOR = 0.02
#: What a document scores without any known word, at most, and the sentences at which it scores half of that.
LEAK, LEAK_HALF = 0.05, 100
#: What the weight of a word begins with: above the floor, or nothing would be learned.
START = 2.0


def sentences(text: str | None) -> list[list[bytes]]:
    """Sentences with a word, as lower-case words."""
    raw = (text or "").encode().lower().translate(_ENDS, _MARKS)
    return [w for s in raw.split(b"\n") if (w := s.split())]


@lru_cache(maxsize=MEMO // 2)
def buckets(word: bytes) -> tuple[int, ...]:
    """Of the word and of its first four and five letters: insults are inflected and compounded."""
    letters = word.decode(errors="replace")
    return tuple(zlib.crc32(f.encode()) % BUCKETS for f in (letters, "^" + letters[:4], "^" + letters[:5]))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z.clip(-30, 30)))


def probability(z: np.ndarray) -> np.ndarray:
    """Of sentences with known words, by their logits."""
    return np.maximum((logistic(z) - FLOOR) / (1 - FLOOR), 0)


def leak(sentences: np.ndarray | int) -> np.ndarray | float:
    return LEAK * sentences / (sentences + LEAK_HALF)


def loss(z: np.ndarray, doc_of: np.ndarray, y: np.ndarray, sentences: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log loss of the documents' noisy-or, and its gradient by the logits ``z`` of the sentences with known words."""
    q = probability(z)
    logs = np.bincount(doc_of, np.log1p(-q.clip(max=1 - 1e-9)), len(y)) + np.log1p(-leak(sentences))
    p = (-np.expm1(logs)).clip(1e-9, 1 - 1e-9)
    over_log = np.where(q > 0, logistic(z), 0)  # of -log(1 - q)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log1p(-p))), over_log * ((1 - y) - y * (1 - p) / p)[doc_of] / len(y)


def train(rows: list[tuple[bytes, bytes, int]], steps: int = 150, rate: float = 0.15, decay: float = 1e-3, least_docs: int = 5, least_z: float = 3.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights, and the bias.  rows: buckets (int32), how many in each sentence (int32), label.

    First come the buckets that stand in more toxic documents than chance explains: at least
    ``least_docs`` documents and ``least_z`` standard errors.  Full-batch Adam then fits their
    weights to the documents' log loss.
    """
    empty = np.zeros(0, np.int32), np.zeros(0, np.float32), -8.0
    if not rows or len({y for *_, y in rows}) < 2:
        return empty
    words = [np.unique(np.frombuffer(w, np.int32)) for w, _, _ in rows]
    y = np.array([r[2] for r in rows], np.float64)
    vocab, of = np.unique(np.concatenate(words), return_inverse=True)
    n_docs = np.bincount(of, minlength=len(vocab))
    n_toxic = np.bincount(of, np.repeat(y, [len(w) for w in words]), len(vocab))
    z = (n_toxic - n_docs * y.mean()) / np.sqrt(n_docs * y.mean() * (1 - y.mean()))
    vocab = vocab[(n_docs >= least_docs) & (z >= least_z)]
    if not len(vocab):
        return empty
    lengths = [np.frombuffer(s, np.int32) for _, s, _ in rows]
    doc_of = np.repeat(np.arange(len(rows)), [len(s) for s in lengths])
    sent_of = np.repeat(np.arange(len(doc_of)), np.concatenate(lengths))
    ids = np.concatenate([np.frombuffer(w, np.int32) for w, _, _ in rows])
    at = np.searchsorted(vocab, ids).clip(max=len(vocab) - 1)
    known = vocab[at] == ids
    at, sent_of = at[known], sent_of[known]
    sizes = np.array([len(s) for s in lengths])
    told, sent_of = np.unique(sent_of, return_inverse=True)  # sentences without known words say nothing
    doc_of = doc_of[told]
    weights, bias = np.full(len(vocab), START), float(np.log(max(y.mean(), 1e-3) / max(1, len(doc_of) / len(rows))))
    m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    for t in range(1, steps + 1):
        _, over_z = loss(bias + np.bincount(sent_of, weights[at], len(doc_of)), doc_of, y, sizes)
        grad = np.append(np.bincount(at, over_z[sent_of], len(vocab)) + decay * weights / len(rows) ** 0.5, over_z.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        weights, bias = weights - step[:-1], bias - step[-1]
    return vocab.astype(np.int32), weights.astype(np.float32), float(bias)


def learn(docs: DataFrame, labels: DataFrame, max_train: int = 4000, max_bytes: int = 200_000, max_total: int = 48_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Trains on at most ``max_train`` labelled documents, of at most ``max_bytes`` each.

    What the driver gathers of them (word buckets, some 12 bytes a word) is bounded by ``max_total``
    bytes: the documents that fit, in the sample's order.  Rows of the held-out fifth (crc32 of the id
    as text, modulo 5, is 0), null ids and null labels never take part.  The sample is the smallest
    xxhash64 of the ids.
    """
    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
        .where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (F.crc32(F.col("__id").cast("string").cast("binary")) % 5 != 0))
        .groupBy("__id").agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.coalesce(F.octet_length("__text"), F.lit(0)) <= max_bytes)
    texts = texts.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.first("__y").alias("__y"))  # chosen: max_train rows of a few bytes

    def start():
        def step(ids, texts, ys):
            words, lengths = [], []
            for text in texts:
                own = sentences(text)
                found = [[b for w in s for b in buckets(w)] for s in own]
                words.append(np.array([b for s in found for b in s], np.int32).tobytes())
                lengths.append(np.array([len(s) for s in found], np.int32).tobytes())
            return [ids, words, lengths, ys]

        return step

    rows = cut(map_rows(texts, ["__id", "__text", "__y"], f"id {docs.schema[id_col].dataType.simpleString()}, words binary, lengths binary, y int", start))
    upto = F.sum(F.octet_length("words") + F.octet_length("lengths")).over(Window.orderBy(F.xxhash64("id"), "id"))  # of max_train rows
    fit = rows.select("id", upto.alias("upto")).where(F.col("upto") <= max_total).select("id")
    rows = rows.join(F.broadcast(fit), "id", "left_semi").collect()
    return train([(bytes(r.words), bytes(r.lengths), r.y) for r in sorted(rows, key=lambda r: r.id)])


def scorer(model: tuple[np.ndarray, np.ndarray, float]):
    """A function of a text that gives its sentences' probabilities; words' weights are memoised."""
    vocab, weights, bias = model
    known = dict(zip(vocab.tolist(), weights.tolist(), strict=True))

    class Memo(dict):
        def __missing__(self, word: bytes) -> float | None:
            if len(self) >= MEMO:
                self.clear()
            found = [known[b] for b in buckets.__wrapped__(word) if b in known]
            self[word] = w = sum(found) if found else None
            return w

    weight = Memo().__getitem__

    def scores(text: str | None) -> np.ndarray:
        own = [[w for w in map(weight, s) if w is not None] for s in sentences(text)]
        z = np.array([sum(s) for s in own]) + bias
        return np.where([len(s) > 0 for s in own], probability(z), 0.0) if own else z

    return scores


def noisy_or(scores: np.ndarray) -> float:
    """A document's score by its sentences' probabilities."""
    return float(abs(np.expm1(np.log1p(-scores.clip(max=1 - 1e-12)).sum() + np.log1p(-leak(len(scores))))))


def toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", offending_from: float = 0.5) -> DataFrame:
    """Scores each whole text: doc_id, held_out, score, predicted, n_sentences, offending.

    ``offending`` lists the sentences (number among those with a word, from 0) whose own score
    reaches ``offending_from``.  A null or empty text has no sentence and scores 0.  A null id
    isn't held out.  Repeated rows stay; no rows give no rows; other columns are not looked at.  A
    very long text is scored whole, some 100 bytes a word.  Narrow: no shuffle.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # at most BUCKETS weights

    def start():
        sentence_scores = scorer(shared.value)

        def step(ids, texts):
            scores, sizes, found = [], [], []
            for text in texts:
                q = sentence_scores(text)
                scores.append(noisy_or(q))
                sizes.append(len(q))
                found.append([{"sentence": int(i), "score": float(q[i])} for i in np.flatnonzero(q >= offending_from)])
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            return [ids, held, scores, [int(s >= 0.5) for s in scores], sizes, found]

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [F.col(id_col), F.col(text_col)], f"{id_col} {kind}, held_out boolean, score double, predicted int, n_sentences int, offending array<struct<sentence:int,score:double>>", start)


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", reject_from: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, that score below ``reject_from``.  Narrow: no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS weights

    def start():
        scores = scorer(shared.value)
        return lambda texts: [noisy_or(scores(t)) < reject_from for t in texts]

    return keep_rows(docs, text_col, start)
