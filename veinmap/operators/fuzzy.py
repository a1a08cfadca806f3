"""Greedy leaders among similar keys, exactly as a fold over all keys in order would choose them.

In the fold a key joins the first leader that it is similar to, or becomes a leader.  So leaders are
the lexicographically first maximal independent set of the similarity graph, and are found in
rounds of joins:

* Keys are taken in prefixes that grow by ``GROWTH``.  Once the leaders of a prefix are known, every
  later key that is similar to one of them is settled, so few similar pairs are left to the next.
* Within a prefix a key is settled as soon as all its earlier similar keys are (or one is a leader).
  A task goes through the keys of a stretch of ``STRETCH`` in order and settles what it can; what
  waits for another stretch goes into the next round.

Pairs come from a positional index: two keys whose ratio reaches the threshold differ by at most so
many insertions and deletions, so if one is cut into one more segment than that, some segment stands
unchanged in the other, shifted by no more than those edits allow.  A pair is tested under the first
segment that it shares only, by its longest common subsequence (one machine word operation a
character) before the ratio itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinmap.operators.links import cut, ranked

#: Keys of the first prefix; how much each next one grows; keys of a stretch.
FIRST, GROWTH, STRETCH = 1024, 4, 4096
#: Keys longer than this are found by the rarest of their characters instead of segments.
LONG = 48
#: Letters from rare to common; others come first.
_COMMON = "zqjxkvbpgywfmucldrhsniota e"


def ratio_reaches(a: str, b: str, threshold: float) -> bool:
    return a == b or SequenceMatcher(None, a, b).ratio() >= threshold


def edits(a: int, b: int, threshold: float) -> int:
    """The most insertions and deletions between strings of these lengths whose ratio reaches ``threshold``; below |a - b|: none can."""
    most = math.floor((1 - threshold) * (a + b) + 1e-9)
    return most - (most - (a + b)) % 2


@lru_cache(maxsize=4096)
def segments(size: int, n: int) -> tuple[tuple[int, int], ...]:
    """``n`` segments (start, stop) of a string, of about equal length."""
    return tuple((size * i // n, size * (i + 1) // n) for i in range(n))


@lru_cache(maxsize=4096)
def partners(size: int, threshold: float) -> tuple[tuple[int, int], ...]:
    """Lengths up to LONG that can be similar to ``size``, and the edits between them."""
    return tuple((b, d) for b in range(1, LONG + 1) if (d := edits(size, b, threshold)) >= abs(size - b) and d >= 0)


def indexed(k: str, threshold: float) -> set[str]:
    """Segments of a key, one set of them for each length of a partner."""
    return {f"{a}.{len(k)}.{i}.{k[s:e]}" for a, d in partners(len(k), threshold) for i, (s, e) in enumerate(segments(len(k), d + 1))}


def probes(k: str, threshold: float) -> set[str]:
    """What stands in a key where a partner's segment may."""
    return {f"{len(k)}.{b}.{i}.{k[s + x : e + x]}" for b, d in partners(len(k), threshold) for i, (s, e) in enumerate(segments(b, d + 1)) for x in _shifts(len(k), b, d) if 0 <= s + x and e + x <= len(k)}


def _shifts(a: int, b: int, d: int) -> range:
    return range(-((d - (a - b)) // 2), (d + (a - b)) // 2 + 1)


def first_shared(p: str, q: str, threshold: float) -> int:
    """The first segment of ``q`` that stands in ``p``."""
    d = edits(len(p), len(q), threshold)
    for i, (s, e) in enumerate(segments(len(q), d + 1)):
        own = q[s:e]
        if any(0 <= s + x and p[s + x : e + x] == own for x in _shifts(len(p), len(q), d) if e + x <= len(p)):
            return i
    return -1


def common(masks: dict[str, int], size: int, q: str) -> int:
    """Length of the longest common subsequence of ``q`` and a string given by its characters' places."""
    full = (1 << size) - 1
    s = full
    for c in q:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


@lru_cache(maxsize=1024)
def places(p: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(p):
        out[c] = out.get(c, 0) | 1 << i
    return out


def alike(p: str, q: str, threshold: float) -> bool:
    """Whether the ratio of ``p`` to ``q`` reaches the threshold; the bound on it comes first."""
    return common(places(p), len(p), q) >= threshold * (len(p) + len(q)) / 2 - 1e-9 and ratio_reaches(p, q, threshold)


def letters(k: str, threshold: float) -> list[str]:
    """The rarest of a key's numbered characters: similar keys share one.

    A ratio of ``threshold`` needs 2 M >= threshold * (a + b) equal characters, so M is at least
    a * threshold / (2 - threshold) of either length, and the rest plus one in any fixed order
    meets what is common.
    """
    seen: Counter[str] = Counter()
    own = []
    for c in k:
        seen[c] += 1
        own.append((-seen[c], _COMMON.find(c), c))
    most = len(k) - math.ceil(len(k) * threshold / (2 - threshold) - 1e-9) + 1
    return [f"{-n}{c}" for n, _, c in sorted(own)[:most]]


def _keyed(keys: DataFrame, name: str, probe: bool, threshold: float) -> DataFrame:
    """s (an index entry), <name>_rank, <name> of keys (b, rank, k)."""
    wide = threshold / (2 - threshold)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), 256):
                out = []
                for b, rank, k in pdf.iloc[at : at + 256].itertuples(index=False, name=None):
                    own = (probes if probe else indexed)(k, threshold) if 0 < len(k) <= LONG else set()
                    if len(k) > LONG * wide - 1:  # one of a pair with a long key
                        own |= {f"~{x}" for x in letters(k, threshold)}
                    out += [(f"{b}\x00{s}", rank, k) for s in own]
                yield pd.DataFrame(out, columns=["s", f"{name}_rank", name])

    return keys.select("b", "rank", "k").mapInPandas(run, f"s string, {name}_rank long, {name} string")


def similar(left: DataFrame, right: DataFrame, threshold: float, earlier: bool = True, report: dict | None = None) -> DataFrame:
    """x, y: ranks of pairs of keys (b, rank, k) of the same ``b`` where ``left``'s ratio to ``right``'s reaches the threshold.

    ``earlier``: y comes before x only.  A threshold of 0 or less pairs all; above 1 none.
    ``report`` counts the pairs that met and those that were tested.
    """
    if threshold > 1:
        return left.select(F.col("rank").alias("x"), F.col("rank").alias("y")).limit(0)
    order = F.col("y") < F.col("x") if earlier else F.col("x") != F.col("y")
    if threshold <= 0:
        first = right.groupBy("b").agg(F.min("rank").alias("y"))  # all are alike: the first leads
        return left.select("b", F.col("rank").alias("x")).join(first, "b").where(order).select("x", "y")
    p, q = _keyed(left, "p", True, threshold), _keyed(right, "q", False, threshold)

    def tested(s: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        def one(s: str, p: str, q: str) -> bool:
            entry = s[s.index("\x00") + 1 :]
            if max(len(p), len(q)) <= LONG:
                return entry[0] != "~" and first_shared(p, q, threshold) == int(entry.split(".", 3)[2]) and alike(p, q, threshold)
            if entry[0] != "~" or min(len(p), len(q)) < threshold * (len(p) + len(q)) / 2 - 1e-9:
                return False
            shared = set(letters(q, threshold))
            return next(x for x in letters(p, threshold) if x in shared) == entry[1:] and alike(p, q, threshold)

        return pd.Series([one(*x) for x in zip(s, p, q)], dtype=bool)

    met = p.join(q, "s").select("s", F.col("p_rank").alias("x"), F.col("q_rank").alias("y"), "p", "q").where(order)
    if report is not None:
        report["met"] = report.get("met", 0) + met.count()
    return met.where(F.pandas_udf(tested, "boolean")("s", "p", "q")).select("x", "y")


def independent(nodes: DataFrame, edges: DataFrame, report: dict | None = None) -> DataFrame:
    """rank of the first maximal independent set: nodes (rank) without an earlier neighbour in it; edges: x, y (y < x)."""
    free = cut(nodes.join(edges.select(F.col("x").alias("rank")).distinct(), "rank", "left_anti"))
    settled = [free.select("rank", F.lit(True).alias("leads"))]
    open_ = edges.join(free.select(F.col("rank").alias("y"), F.lit(True).alias("leads")), "y", "left").select("x", "y", "leads")
    stretch = STRETCH

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, bool] = {}
        now, where, led, waits = None, None, False, False

        def ended() -> list[tuple[int, bool]]:
            if now is None or waits and not led:
                return []
            known[now] = not led
            return [(now, not led)]

        for pdf in pdfs:
            out: list[tuple[int, bool]] = []
            for x, y, leads in zip(pdf["x"], pdf["y"], pdf["leads"]):
                if x != now:
                    out += ended()
                    if x // stretch != where:
                        known, where = {}, x // stretch
                    now, led, waits = x, False, False
                own = known.get(y) if leads is None else bool(leads)
                led, waits = led or own is True, waits or own is None
            yield pd.DataFrame(out, columns=["rank", "leads"])
        yield pd.DataFrame(ended(), columns=["rank", "leads"])

    rounds = 0
    while not open_.isEmpty():
        rounds += 1
        dealt = open_.repartition(F.floor(F.col("x") / stretch)).sortWithinPartitions("x", "y")
        new = cut(dealt.select("x", "y", "leads").mapInPandas(run, "rank long, leads boolean"))
        settled.append(new)
        left = open_.join(new.select(F.col("rank").alias("x")), "x", "left_anti")
        told = left.join(new.select(F.col("rank").alias("y"), F.col("leads").alias("now")), "y", "left")
        open_ = cut(told.select("x", "y", F.coalesce("leads", "now").alias("leads")))
    if report is not None:
        report["rounds"] = report.get("rounds", 0) + rounds
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return cut(out.where("leads").select("rank"))


def leaders(keys: DataFrame, threshold: float, order: str, report: dict | None = None) -> DataFrame:
    """keys (b, k, <order>: distinct in (b, k)) -> b, k, rank (by <order>) and lead (the rank of the key's leader, its own if it is one)."""
    keys = cut(ranked(keys.select("b", "k", order), order, "rank").select("b", "k", "rank"))
    waiting, upto, done = keys, FIRST, []
    while True:
        now, rest = waiting.where(F.col("rank") < upto), waiting.where(F.col("rank") >= upto)
        pairs = cut(similar(now, now, threshold, report=report))
        lead = independent(now.select("rank"), pairs, report)
        new = cut(now.join(lead, "rank"))
        own = pairs.join(lead.withColumnRenamed("rank", "y"), "y").groupBy(F.col("x").alias("rank")).agg(F.min("y").alias("lead"))
        done += [cut(own.join(lead, "rank", "left_anti")), lead.select("rank", F.col("rank").alias("lead"))]
        if rest.isEmpty():
            break
        hit = cut(similar(rest, new, threshold, report=report).groupBy(F.col("x").alias("rank")).agg(F.min("y").alias("lead")))
        done.append(hit)
        waiting, upto = cut(rest.join(hit.select("rank"), "rank", "left_anti")), upto * GROWTH
        if waiting.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return cut(keys.join(out, "rank"))
