import re

import pytest

from veinmap.llm import quality, token_count
from veinmap.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_token_counts_equal_the_library(odd, none, library):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(odd, MODEL).collect())
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in odd.collect())
    assert got == want
    assert token_count.count_tokens(none, MODEL).count() == 0


def test_token_counts_on_the_small_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, MODEL).collect()}
    assert got == {r.doc_id: len(library.encode(r.text)) for r in docs.collect()}


def test_memo_starts_anew(monkeypatch, library):
    monkeypatch.setattr(token_count, "MEMO", 3)
    tokens = token_count.WholeTokens(MODEL)
    text = " ".join(f"blorpx{i}q" for i in range(50))
    assert tokens.count(text)[0] == len(library.encode(text))
    assert len(tokens) <= len(tokens.proven) + 5


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(odd, none):
    rows = [r for r in odd.collect() if len(r.text or "") < 10_000]
    got = sorted(tuple(r)[1:6] for r in quality.quality_rules(odd).collect() if r.word_chars < 10_000)
    assert got == sorted(brute(r.text) for r in rows)
    assert quality.quality_rules(none).count() == 0


def test_lines_are_removed_before_documents(spark):
    good = "A calm line of text that says many things in plain words. " * 3
    rows = [(1, "\n".join(f"{good}{i} {i * 7}" for i in range(4)) + "\n| home | about | news |"), (2, "\n".join(f"$$$a{i} b{i}%%% c{i}###" for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed_words for r in quality.quality_rules(docs).collect()} == {1: 7, 2: 120}
    assert {r.doc_id: r.text.count("home") for r in quality.clean_lines(docs).collect()} == {1: 0, 2: 0}


def test_three_ids_that_do_not_fit_in_63_bits():
    words = [str(i).encode() for i in range(1 << 20)] + [b"0", b"1", b"2"]
    assert quality.repeated_words(words) == 6
