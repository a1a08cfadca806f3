import random
import zlib

import numpy as np
import pytest

from veinmap.llm import packing
from veinmap.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    rng = random.Random(3)
    picks = [*range(32, 600), 0x85, 0xA0, 0x1C, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x663, 9, 10, 13]
    texts = ["".join(rng.choice([chr(rng.choice(picks)), rng.choice(" \n 'stdea10")]) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    coder = packing.tokenizer(PATH)
    for text in [*texts, "<|endoftext|>a <|endoftext|>", "aaaaaaaa" * 50, "I'LL we'll"]:
        assert coder.encode_to_numpy(text, allowed_special="all").tolist() == library.encode(text, add_special_tokens=False).ids


def test_very_long_runs(library):
    n = 5_000_000
    assert packing.ids_of(PATH, "a b " + "x " * 40_000 + "é" * 50_000).tolist() == library.encode("a b " + "x " * 40_000 + "é" * 50_000, add_special_tokens=False).ids
    few = packing.ids_of(PATH, " " * 3000 + "x").tolist()
    for text in (" " * n + "x", "x" * n, "y\n" + "\n" * n + "<|endoftext|>z"):
        ids = packing.ids_of(PATH, text)
        assert packing.bpe.loaded(PATH).decode(ids.astype("<u4").tobytes()) == text
    assert few == library.encode(" " * 3000 + "x", add_special_tokens=False).ids
    assert packing.ids_of(PATH, " " * 700_000 + "x").tolist() == packing.bpe.loaded(PATH).exact(b" " * 699_999) + library.encode(" x", add_special_tokens=False).ids


def test_a_vocabulary_out_of_order(tmp_path):
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"]["merges"][5], spec["model"]["merges"][9] = spec["model"]["merges"][9], spec["model"]["merges"][5]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        packing.tokenizer(str(tmp_path / "v.json"))


def test_hilbert_keys_walk_the_grid():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def held(pieces, texts, library, length=1024):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = np.array([*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    fill = []
    for own in by_sequence.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        fill.append(at)
    assert max(fill) <= length and sum(f < length for f in fill) <= 1


def test_every_id_is_packed_once(spark, odd, none, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held(packing.pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, library)
    held(packing.pack(odd.dropDuplicates(["doc_id"]), PATH).collect(), {r.doc_id: r.text for r in odd.collect()}, library)
    assert packing.pack(odd, PATH).where("doc_id = 8 and start = 0").count() == 2
    assert packing.pack(none, PATH).count() == 0


def test_neighbours_are_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = packing.pack(docs, PATH).where("start = 0").join(docs.select("doc_id", "lang"), "doc_id").orderBy("sequence_id", "offset").collect()
    same = np.mean([a.lang == b.lang for a, b in zip(langs, langs[1:])])
    assert same > 0.75  # by chance 0.43
