import hashlib
import random

import numpy as np
import pytest

from veinmap.llm import bpe
from veinmap.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.loaded(PATH)


def random_texts(n):
    rng = random.Random(3)
    picks = [*range(32, 600), 0x85, 0xA0, 0x1C, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x663, 9, 10, 13, 0]
    return ["".join(rng.choice([chr(rng.choice(picks)), rng.choice(" \n 'stdeahionr10")]) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_ids_and_text_equal_the_library(coder, library):
    texts = [*random_texts(2000), "<|endoftext|>a <|endoftext|>", "aaaaaaaa" * 50, "I'LL we'll", ""]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_speculation_and_exact_merging_agree(coder):
    rng = random.Random(5)
    words = ["".join(rng.choice("aehinorstdlu ") for _ in range(rng.randrange(1, 24))).encode() for _ in range(4000)]
    ids, failed = coder.encode_words(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [coder.exact(w) for w in words]
    assert 0 < failed < len(words)


def test_pairs_against_exact_merging(coder):
    rng = np.random.default_rng(1)
    a, b = rng.choice(np.flatnonzero(coder.sound), (2, 5000))
    want = [coder.exact(coder.bytes_of[x] + coder.bytes_of[y]) == [x, y] for x, y in zip(a, b)]
    assert coder.compatible(a.astype(np.int64), b.astype(np.int64)).tolist() == want


def test_rows(odd, none, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd, PATH).collect())
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(none, PATH).count() == 0
