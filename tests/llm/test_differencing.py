"""Differencing against sequential partitions; packing against the ids of the public tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import differencing, packing


def by_definition(sizes, windows):
    """Multiway differencing on whole tuples of sums, one merge at a time."""
    parts = [sorted([s] + [0] * (windows - 1), reverse=True) for s in sizes]
    done = list(range(len(parts)))
    while len(done) > 1:
        done.sort(key=lambda i: (-(parts[i][0] - parts[i][-1]), i))
        a, b = done.pop(0), done.pop(0)
        merged = sorted((x + y for x, y in zip(parts[a], reversed(parts[b]))), reverse=True)
        parts.append([x - merged[-1] for x in merged])
        done.append(len(parts) - 1)
    return parts[done[0]][0]


@pytest.mark.parametrize("seed", range(12))
def test_differencing_follows_the_definition(seed):
    r = random.Random(seed)
    sizes, windows = [r.choice([r.randrange(1, 40), r.randrange(1, 1500)]) for _ in range(r.randrange(2, 120))], r.randrange(2, 30)
    sums = np.bincount(differencing.differencing(np.asarray(sizes), windows), sizes, windows)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() == by_definition(sizes, windows)


def test_differencing_balances():
    # Longest first gives 17 and 15 here, differencing 16 and 16.
    assert set(np.bincount(differencing.differencing(np.asarray([8, 7, 6, 5, 4, 2]), 2), [8, 7, 6, 5, 4, 2])) == {16}
    sizes = np.random.default_rng(3).integers(1, 900, 3000)
    windows = -(-sizes.sum() // 2048)
    sums = np.bincount(differencing.differencing(sizes, windows), sizes)
    assert len(sums) == windows and sums.max() - sums.min() < 899 / 6  # a sixth of the greatest size


def test_windows_hold_all_and_rise_with_the_overflow():
    for seed in range(30):
        r = np.random.default_rng(seed)
        sizes = r.integers(1, r.choice([3, 60, 101]), r.integers(1, 300))
        windows = differencing.fill_windows(sizes, 100)
        spans = defaultdict(list)
        for window in windows:
            assert 0 < sum(n for _, _, n in window) <= 100
            for i, first, n in window:
                spans[i].append((first, n))
        for i, size in enumerate(sizes):
            at = 0
            for first, n in sorted(spans[i]):
                assert first == at and n > 0
                at += n
            assert at == size
        assert len(windows) <= -(-sizes.sum() // 100) * 1.1 + 2
    assert differencing.fill_windows(np.asarray([], np.int64), 100) == []


def test_packing(odd_docs, no_docs, odd_rows):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = differencing.pack_windows(odd_docs, size=256, with_ids=True, group_pieces=40).collect()
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in odd_rows)
    windows, pieces = defaultdict(list), defaultdict(list)
    for g in got:
        assert g["ids_crc32"] == zlib.crc32(g["ids"]) and len(g["ids"]) == 4 * g["length"]
        windows[g["sequence_id"]].append((g["offset"], g["length"]))
        pieces[g["doc_id"], g["doc_tokens"], g["start"]].append(bytes(g["ids"]))
    for spans in windows.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(len(ids) for _, ids in want.elements())
    assert len(windows) <= -(-total // 256) + 6
    # Each row's ids are its pieces in a row; rows of one id and length may differ in text, so pieces are taken from where they fit.
    for (key, ids), times in want.items():
        for _ in range(times):
            at = 0
            while at < len(ids):
                there = pieces[key, len(ids), at]
                part = next(p for p in there if tuple(np.frombuffer(p, "<u4")) == ids[at : at + len(p) // 4])
                there.remove(part)
                at += len(part) // 4
    assert not any(pieces.values())
    assert differencing.pack_windows(no_docs).count() == 0


def test_equal_rows_are_dealt_into_all_groups(spark):
    rows = spark.range(4000, numPartitions=3).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"))
    got = differencing.pack_windows(rows, size=64, group_pieces=250).select((F.col("sequence_id") / (1 << 32)).cast("int").alias("g"), "length").groupBy("g").agg(F.count("*").alias("n")).collect()
    assert len(got) == 16 and max(g["n"] for g in got) < 450


def test_equal_rows_are_dealt_into_all_groups_of_the_search_too(spark):
    rows = spark.range(4000, numPartitions=3).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"))
    got = packing.pack_documents(rows, size=64, group_pieces=250)
    by = got.select((F.col("sequence_id") / (1 << 32)).cast("int").alias("g"), "length").groupBy("g").agg(F.count("*").alias("n")).collect()
    assert len(by) == 16 and max(g["n"] for g in by) < 450 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 64").isEmpty()
