"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it.
Fingerprints link at ``RADIUS`` or fewer differing bits.

Candidates come from the pigeonhole: of ``PARTS`` parts of the bits, two linked fingerprints agree in
PARTS - RADIUS at least, so they meet under one of the masks that hold so many parts.  Equal
fingerprints are one from the start.  A mask and the bits under it are a group; a group of more than
``GROUP`` fingerprints is divided by the same rule once more: the bits that its mask leaves open fall
into RADIUS + 1 parts, one of which is equal.  Few fingerprints fit under many equal bits, so this
ends with small groups, however many near copies of one text there are; rows grow only in groups
that are divided, and no pair is ever a row.

A task gathers whole groups, and stores their fingerprints as bit planes: word w of plane b holds bit
b of 64 fingerprints.  One fingerprint of a block of 64 is compared with another block in one word
operation for each bit; a distance is counted by carry-save adders in two words, and a third word
marks the distances beyond the radius.  Blocks in which all are marked are abandoned.
Only links that connect what was apart leave a task: fewer than it has fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinmap.llm.common import components, cut, join_few, map_rows

BITS, RADIUS, PARTS = 64, 3, 5
#: Fingerprints of a group, and of the groups that a task compares at once.
GROUP, HELD = 4096, 16384
#: Words of a shingle; fixed value: the seed of its hash.
WIDTH, SEED = 3, 42
#: Bytes of a text whose words are held at a time.
PART = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def parts(text: str | None) -> Iterator[list[bytes]]:
    """The text's words, lower-cased (A-Z), about PART bytes of them at a time."""
    raw, at = (text or "").encode(), 0
    while at < len(raw):
        space = _SPACE.search(raw, at + PART)
        stop = space.start() if space else len(raw)
        yield raw[at:stop].lower().split()  # bytes: A-Z only; split at x20 and x09-x0D
        at = stop


def hashes(text: str | None, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles (repeats included; of all words as one, if they are fewer), part by part."""
    held, found = [], False
    for words in parts(text):
        held += words
        if len(held) >= width:
            joined = b" ".join(held)
            ends = np.cumsum([len(w) + 1 for w in held])
            own = [joined[a : b - 1] for a, b in zip([0, *ends[:-width].tolist()], ends[width - 1 :].tolist(), strict=True)]
            yield np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(SEED)), np.uint64, len(own))
            held, found = held[len(held) - width + 1 :], True
    if held and not found:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bits set in more than half of the hashes; 0 without a word."""
    counts, n = np.zeros(BITS, np.int64), 0
    for h in hashes(text, width):
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > n)))


def _mask(bits) -> int:
    """Bits as a signed 64-bit mask."""
    return int(np.array(sum(1 << b for b in bits), np.uint64).astype(np.int64))


def _cut_bits(bits: list[int], parts: int) -> list[list[int]]:
    """Bits in parts of about equal size, each spread over all of them."""
    return [bits[k::parts] for k in range(parts)]


def first_masks() -> list[list[int]]:
    """The bits under each first mask."""
    parts = _cut_bits(list(range(BITS)), PARTS)
    return [sorted(b for p in own for b in p) for own in combinations(parts, PARTS - RADIUS)]


def divided(bits: list[int]) -> list[list[int]]:
    """The masks that follow one: it and one part of the bits it leaves open."""
    rest = [b for b in range(BITS) if b not in bits]
    return [sorted([*bits, *own]) for own in _cut_bits(rest, RADIUS + 1) if own]


def planes(f: np.ndarray) -> np.ndarray:
    """Bit planes (rows: bits) of fingerprints, 64 to a word; missing ones are 0."""
    full = np.zeros(-(-len(f) // 64) * 64, np.uint64)
    full[: len(f)] = f
    bits = np.unpackbits(full.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def _upto(n: np.ndarray) -> np.ndarray:
    """Words with the lowest ``n`` (clipped to 0..64) bits set."""
    n = n.clip(0, 64).astype(np.uint64)
    return np.where(n == 64, _ALL, (_ONE << (n % np.uint64(64))) - _ONE)


def near(f: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places i < j with f[i] and f[j] at most RADIUS (3) bits apart and j < ends[i], the end of i's group.

    Block by block of 64: first each with itself, then with the next, as far as groups reach.
    """
    sliced, blocks = planes(f), -(-len(f) // 64)
    last = np.full(blocks * 64, 0, np.int64)
    last[: len(f)] = ends
    rows = np.arange(blocks * 64).reshape(blocks, 64)
    last = last.reshape(blocks, 64)
    reach = last.max(axis=1)
    own = np.zeros(blocks * 64, np.uint64)
    own[: len(f)] = f
    own = own.reshape(blocks, 64)
    for step in range(blocks):
        k = np.flatnonzero(reach > (np.arange(blocks) + step) * 64)
        if not len(k):
            return
        base = ((k + step) * 64)[:, None]
        over = ~(_upto(last[k] - base) & ~_upto(rows[k] + 1 - base))  # not in the group, or not after i
        ones, twos = np.zeros_like(over), np.zeros_like(over)
        f_k, against = own[k], sliced[:, k + step]
        for b in range(BITS):
            differ = against[b][:, None] ^ (_ALL * ((f_k >> np.uint64(b)) & _ONE))
            carry = ones & differ
            ones ^= differ
            over |= twos & carry  # a fourth differing bit
            twos ^= carry
            if b % 8 == 7:
                alive = (over != _ALL).any(axis=1)
                if not alive.all():  # blocks beyond the radius are abandoned
                    k, f_k, over, ones, twos, against = k[alive], f_k[alive], over[alive], ones[alive], twos[alive], against[:, alive]
                    if not len(k):
                        break
        if len(k):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(*over.shape, 8), axis=2, bitorder="little")
            at, i, j = np.nonzero(hit)
            yield k[at] * 64 + i, (k[at] + step) * 64 + j


def joined(f: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The smallest place that links inside groups connect each place with."""
    label = np.arange(len(f))
    for i, j in near(f, ends):
        while len(i):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def _links(rows: DataFrame) -> DataFrame:
    """a, b: links that connect the fingerprints of rows (mask, f) that groups (mask, f & mask) connect; each has at most GROUP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compared(mask: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (mask[1:] != mask[:-1]) | ((f & mask)[1:] != (f & mask)[:-1]))
            sizes = np.diff(np.append(np.flatnonzero(new), len(f)))
            some = np.repeat(sizes > 1, sizes)
            f, sizes = f[some], sizes[sizes > 1]
            label = joined(f.astype(np.uint64), np.repeat(np.cumsum(sizes), sizes))
            linked = np.flatnonzero(label != np.arange(len(f)))
            return pa.RecordBatch.from_arrays([pa.array(f[label[linked]]), pa.array(f[linked])], ["a", "b"])

        def whole(end: bool) -> Iterator[pa.RecordBatch]:
            mask, f = np.concatenate(held, axis=1)
            if not end:  # the last group may go on
                key = f & mask
                same = (mask == mask[-1]) & (key == key[-1])
                stop = len(f) - int(same[::-1].argmin()) if not same.all() else 0
            else:
                stop = len(f)
            held[:] = [np.stack([mask[stop:], f[stop:]])]
            if stop:
                yield compared(mask[:stop], f[:stop])

        for batch in batches:
            mask, f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in range(0, len(f), HELD):
                held.append(np.stack([mask[k : k + HELD], f[k : k + HELD]]))
                if sum(x.shape[1] for x in held) >= HELD:
                    yield from whole(False)
        if held:
            yield from whole(True)

    return rows.repartition("mask", F.col("f").bitwiseAND(F.col("mask"))).sortWithinPartitions("mask", F.col("f").bitwiseAND(F.col("mask"))).select("mask", "f").mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, report: dict | None = None) -> DataFrame:
    """mask, f: distinct fingerprints under all masks, in groups of at most GROUP."""
    masks = first_masks()
    rows = prints.select(F.explode(F.array(*(F.lit(_mask(m)) for m in masks))).alias("mask"), "f")
    done, turns = None, 0
    while True:
        key = F.col("f").bitwiseAND(F.col("mask")).alias("key")
        large = cut(rows.groupBy("mask", key).agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("mask", "key", F.lit(True).alias("large")))
        if large.isEmpty():
            break
        turns += 1
        split = cut(join_few(rows.withColumn("key", key), large, ["mask", "key"], "left").select("mask", "f", "large"))
        small = split.where("large IS NULL").select("mask", "f")
        done = small if done is None else done.union(small)
        after = {_mask(m): [_mask(x) for x in divided(m)] for m in masks}
        masks = list({tuple(x): x for m in masks for x in divided(m)}.values())
        table = prints.sparkSession.createDataFrame(list(after.items()), "mask long, masks array<long>")  # a row for each mask
        rows = split.where("large").join(F.broadcast(table), "mask").select(F.explode("masks").alias("mask"), "f").distinct()
    if report is not None:
        report["divided"] = turns
    return rows if done is None else done.union(rows)


def simhash(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", report: dict | None = None) -> DataFrame:
    """Components of documents whose fingerprints link: doc_id, fingerprint (16 hex digits), component_id.

    A text is lower-cased (A-Z) and split at x20 and x09-x0D; shingles of ``width`` words, repeats
    included, are hashed joined by spaces; fewer words are one shingle.  A null, empty or blank text
    has fingerprint zero, which links like any other.  ``component_id`` is the smallest doc_id
    reachable.  A null id links nothing and has a null component.  Repeated rows stay, with the same
    component.  No rows give no rows.  Other columns are not looked at.  A very long text is hashed
    in parts.  ``report``, a dict, gets how often large groups were divided.
    """

    def start():
        def step(ids, texts):
            return [ids, np.array([fingerprint(t, width) for t in texts], np.uint64).astype(np.int64).tolist()]

        return step

    rows = cut(map_rows(docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)], "doc_id long, f long", start))
    prints = cut(rows.where("doc_id IS NOT NULL").groupBy("f").agg(F.min("doc_id").alias("first")))
    found = components(cut(_links(groups(prints.select("f"), report))))
    named = prints.join(found.withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = cut(named.join(least, "component").select("f", "component_id"))
    out = join_few(rows, of, "f", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
