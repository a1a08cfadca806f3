import re

import pytest

from veinmap.llm import license_scan as ls


def brute(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in ls.PHRASES.items():
        parts = phrase.split(" ")
        own = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
        places += own
        labels |= {label} if own else set()
    more = set()
    for label, text in ls.TEMPLATES.items():
        t = text.split(" ")
        grams = [tuple(t[i : i + ls.GRAM]) for i in range(len(t) - ls.GRAM + 1)]
        hit = sorted({p - i for i, g in enumerate(grams) for p in range(len(words) - ls.GRAM + 1) if tuple(words[p : p + ls.GRAM]) == g})
        groups = []
        for d in hit:
            if groups and d - groups[-1][-1] <= ls.NEAR:
                groups[-1].append(d)
            else:
                groups.append([d])
        for own in groups:
            if sum(any(0 <= i + d < len(words) and words[i + d] == w for d in own) for i, w in enumerate(t)) >= ls.LEAST * len(t) - 1e-9:
                more.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more))


def rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in df.collect())


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows(ls.scan(docs))
    assert got == sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    assert {x for r in got for x in r[6].split(",")} >= {"mit", "apache"}


def test_odd_rows(odd, none):
    assert rows(ls.scan(odd)) == sorted(((str(r.doc_id), *brute(r.text)) for r in odd.collect()), key=str)
    assert ls.scan(none).count() == 0


@pytest.mark.parametrize("text,labels", [
    ("CC-BY cc by. All Rights\nreserved; all rights reserved", "cc-by,reserved"),
    ("x Permission is hereby granted, free of any charge, to any person obtaining one copy of this software and associated documentation files y", "mit-notice"),
    ("permission is hereby granted free of nothing else at all", ""),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("Kelvin CCby by cc", ""),
])
def test_spans_are_merged_and_verified(spark, text, labels):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = ls.scan(df).first()
    assert r.labels == labels == brute(text)[5]
    assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


LONG = ls.TEMPLATES["bsd"].split(" ")
EDITED = [
    ("Licensed under the Apache License, Version 2.1", "apache"),
    ("Licensed under the Apache Licence, Version 2.0", "apache"),
    ("Licensed under the Apache Software License, Version 2.0", "apache"),
    ("under the Apache License, Version 2.0", "apache"),
    ("under the Apache License", ""),
    ("the Apache License", ""),
    ("licensed under the mozilla license version 2 0", ""),
    ("Licensed under CC-BY-NC 3.0", "cc-by,cc-by-nc"),
    ("Licensed under CC-BY-SA 3.0", "cc-by,cc-by-sa"),
    ("Licensed under CC-BY-ND 4.0", "cc-by"),
    ("Released under an MIT license", "mit"),
    ("Released under MIT license", "mit"),
    ("released under the terms of the MIT license", "mit"),
    ("released under the bsd license", ""),
    (" ".join([*LONG[:10], *"a b c d e f".split(), *LONG[10:]]), "bsd"),
    (" ".join([*LONG[:10], *"a b c d e f".split(), *LONG[14:]]), ""),
    (" ".join([*LONG[10:], *"a b c d e f".split(), *LONG[:10]]), ""),
]


def test_edited_inserted_and_truncated_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EDITED)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in ls.scan(df).collect()}
    assert [got[i][0] for i in range(len(EDITED))] == [labels for _, labels in EDITED]
    assert all((score > 0) == bool(labels) for labels, score in got.values())


def test_a_text_of_very_many_notices(spark):
    notice = "Licensed under the Apache License, Version 2.0. Some words. "
    few, many = 2_000, 50_000
    df = spark.createDataFrame([(n, notice * n) for n in (few, many)], "doc_id long, text string")
    got = {r.doc_id: r for r in ls.scan(df).select("doc_id", "n_words", "labels", "score", "spans").collect()}
    assert all(got[n].labels == "apache" and got[n].score == 1.0 and got[n].n_words == 10 * n and len(got[n].spans) >= 1 for n in (few, many))
