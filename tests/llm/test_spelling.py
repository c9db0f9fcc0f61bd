"""Spelling variants against a search among all edits."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import spelling

TO_LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute(n, ratio=5):
    letters = {c for w in n for c in w}
    near = {}
    for w in n:
        edits = {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for d in (0, 1) for c in ["", *letters]}
        near[w] = {v for v in edits if v != w and v in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_groups(spark):
    n = Counter({"wander": 900, "wandr": 30, "wandre": 5, "wandré": 6, "wanderr": 180, "wanderrs": 20, "wanderrss": 4, "wänder": 4, "abcdef": 10, "abcdeg": 50, "abcdeh": 50, "badcef": 1, "z" * 900: 9, "z" * 901: 45, "z": 3, "zz": 2, "\U0001f642abcde": 1, "abcde": 60})
    got = rows_of(spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n)
    assert ("wanderrss", "wanderrs", "wander", 4, 1, 20) in got  # three forms up
    assert ("abcdef", "abcde", "abcde", 10, 3, 60) in got and ("badcef", None, "badcef", 1, 0, None) in got  # swapped letters are two edits
    # A tie goes to the first in code-point order.
    assert ("abcdef", "abcdeg", "abcdeg", 10, 2, 50) in rows_of(spelling.group_variants(spark.createDataFrame([("abcdef", 10), ("abcdeh", 50), ("abcdeg", 50), (None, 3)], "word string, n long")))


def test_long_chain(spark):
    n = {"a" * (6 + k): 2**k for k in range(30)}
    got = spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"), ratio=2)
    assert rows_of(got) == brute(n, 2) and got.select("root").distinct().count() == 1
    with pytest.raises(ValueError):
        spelling.group_variants(got, ratio=1)


def test_documents(odd_docs, no_docs, odd_rows):
    def occurrences(every):
        for i, t in odd_rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = w.translate(TO_LOWER)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                yield w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w

    for every in (199, 3):
        want = {w: c for w, c in Counter(w for w in occurrences(every) if len(w) >= 6).items() if c >= 5}
        counts = spelling.count_words(spelling.with_slips(spelling.words_in(odd_docs), every))
        assert rows_of(spelling.group_variants(counts)) == brute(want)
    assert spelling.group_variants(spelling.count_words(spelling.words_in(no_docs))).count() == 0


def test_near_words_share_few_keys(spark):
    """A key is met by one word a letter and place at most, so that the join can't be hot."""
    words = spark.createDataFrame([(a + "ordinary" + b,) for a in "abcdefgh" for b in "abcdefgh"], "word string")
    keys = words.select(F.explode(spelling._keys("word")).alias("key")).groupBy("key").count()
    assert keys.agg(F.max("count")).first()[0] <= 8
