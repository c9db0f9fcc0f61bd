"""The operators against brute force, on a small table with nulls, empty and long texts, ties, repeated rows and odd columns."""

import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import context_tree, decontamination, exact_dedup, fixity, lookup, near_dedup, packing, rollups, sharding, tool_calls, toxicity
from lodestrand.llm.shared import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, row int, body string"
WORDS = [a + b for a in "ba ce di fo gu".split() for b in "ra ne ti lo su".split()]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base = say(120)
    texts = [None, "", None, "one", "One", "one two", base, base, base.replace(" ", "  ", 1), " ".join(["new"] + base.split()[1:]), say(30), say(30), say(4000), "ß é\n\n\tñ", "a" * 300, base.upper()]
    return [(i if i != 12 else None, t) for i, t in enumerate(texts)] + [(3, "one"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, False, "x", 1, "b") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty, rows):
    got = exact_dedup.exact_dedup(docs, keep="largest", carry=True).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    kept = Counter()
    for g in got:
        t = g["row"]["text"] or ""
        ids = [i for i in groups[t] if i is not None]
        assert (g["keep_id"], g["group_size"], g["text_sha256"]) == (max(ids, default=None), len(groups[t]), sha256(t.encode()).hexdigest())
        kept[t] += g["kept"]
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_hot_text(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise("hot").alias("text"))
    got = exact_dedup.exact_dedup(many)
    assert got.where("kept").count() == 1001 and got.where("group_size = 2000").select("keep_id").distinct().collect()[0][0] == 1


def test_sharding(spark, docs, empty, rows):
    tree = sharding.even_tree(16)
    got = sharding.shard_documents(docs, tree, sharding.grow(tree)).collect()
    assert sorted((g["size"], g["text_crc32"]) for g in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    many = sharding.shard_documents(ids, tree, sharding.grow(tree)).toPandas().set_index("doc_id").sort_index()
    moved = many[many["shard"] != many["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and abs(len(moved) - 20_000 / 17) < 120
    for _, slots in many.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots))) and abs(len(slots) - 1250) < 150
    assert sharding.shard_documents(empty, sharding.even_tree(3)).count() == 0


def test_sharding_moves_keys_only_where_weights_change(spark):
    tree = sharding.even_tree(16)
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    place = lambda t: sharding.shard_documents(ids, t).toPandas().set_index("doc_id")["shard"].sort_index()
    path = {x.shard: (x.region, x.rack, x.shard) for x in tree}
    before, changed = place(tree), path[5]
    after = place([x._replace(weight=3.0) if x.shard == 5 else x for x in tree])
    fork = Counter()
    for a, b in zip(before, after, strict=True):
        if a != b:
            level = next(k for k in range(3) if path[a][k] != path[b][k])
            assert path[b][: level + 1] == changed[: level + 1]
            fork[level] += 1
    assert min(fork[k] for k in range(3)) > 100  # each level draws anew
    assert abs((after == 5).mean() - 3 / 18) < 0.02


def test_sharding_equals_brute_force(spark):
    """The descent, with draws of single nodes taken one by one."""
    tree = [sharding.Leaf("a", "x", 0, 2.0), sharding.Leaf("a", "y", 1, 0.5), sharding.Leaf("b", "x", 2), sharding.Leaf("b", "x", 3, 0.0), sharding.Leaf("c", "z", 4)]
    ids = spark.createDataFrame([(i,) for i in [*range(300), None]], "doc_id long").withColumn("text", F.lit("t"))
    weights = Counter()
    for x in tree:
        for name in (x.region, f"{x.region}/{x.rack}", f"shard {x.shard}"):
            weights[name] += x.weight
    names = [n for n in weights if weights[n]]
    bits = ids.select("doc_id", *[F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(n)), 12).alias(n) for n in names]).collect()
    draw = lambda row, n: -math.log((row[n] + 0.5) / (1 << 52)) / weights[n]
    want = {}
    for row in bits:
        region = min("abc", key=lambda r: draw(row, r))
        rack = min({x.rack for x in tree if x.region == region}, key=lambda k: draw(row, f"{region}/{k}"))
        want[row["doc_id"]] = min((x.shard for x in tree if (x.region, x.rack) == (region, rack) and x.weight), key=lambda s: draw(row, f"shard {s}"))
    assert {g["doc_id"]: g["shard"] for g in sharding.shard_documents(ids, tree).collect()} == want


def test_packing(docs, empty, rows):
    import numpy as np
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, size=128, with_ids=True).toPandas()
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        n = len(ids) % 128 or 128 if len(ids) > 128 else len(ids)
        cuts = [0, *range(n, len(ids) + 1, 128)]
        want.update((i, k, a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((None if i != i else int(i), p, a, c) for i, p, a, c in zip(got["doc_id"], got["piece"], got["start"], got["ids_crc32"])) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 128 and list(g["offset"]) == [0, *g["length"].cumsum()[:-1]]
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 128) + 1
    assert packing.pack_documents(empty).count() == 0


def test_local_search_empties_bins():
    sizes = [6, 4, 4, 4, 3, 3, 6, 4, 3, 3]
    bins = packing.local_search(sizes, [[i] for i in range(len(sizes))], 10)
    assert sorted(i for b in bins for i in b) == list(range(10)) and len(bins) == 4 and max(sum(sizes[i] for i in b) for b in bins) <= 10


def test_toxicity(spark, empty):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op5_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert got[got["toxic"] == 0]["predicted"].sum() <= 1 and got[got["toxic"] == 1]["predicted"].mean() >= 0.5
    index = toxicity.NeighbourIndex({"a": 0, "b": 1, "c": 2}, __import__("numpy").asarray([1.0, 2.0, 3.0]), [(((0, 1),), 0, 1.0, 1), (((0, 1), (1, 2)), 1, 1.0, 2), (((1, 1),), 1, 1.0, 3), ((), 0, 1.0, 4)] * 60, k=7)
    counts = ((0, 2), (1, 1))
    cos = []
    for e, (c, *_) in enumerate(index.examples):
        (fa, wa), (fb, wb) = index.vector(counts), index.vector(c)
        cos.append((-round(sum(x * dict(zip(fb, wb)).get(f, 0) for f, x in zip(fa, wa)), 12), e))
    assert list(index.nearest(counts, 7)[0]) == [e for s, e in sorted(cos)[:7]]
    assert toxicity.score_toxicity(empty, index).count() == 0


def test_toxicity_matches_words_beyond_the_lexicon(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(WORDS) for _ in range(20)) for _ in range(60)] + ["rare vile wording once", "plain other phrase here"]
    docs = spark.createDataFrame([*enumerate(texts), (100, texts[60]), (101, "rare vile wording once more"), (102, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 60)) for i in range(62)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    # Document frequencies are of all documents, those without a label too.
    want = [sum(w in (t or "").split() for _, t in docs.collect()) for w in ("rare", WORDS[0])]
    assert [round(float(index.idf[index.vocabulary[w]]), 9) for w in ("rare", WORDS[0])] == [round(1 + math.log(66 / (1 + n)), 9) for n in want]
    again = pickle.loads(pickle.dumps(index))
    assert all((getattr(index, x) == getattr(again, x)).all() for x in ("where", "weight", "post", "block", "block_max", "first"))
    got = {g["doc_id"]: g for g in toxicity.score_toxicity(docs, index).collect()}
    assert got[100]["predicted"] == 1 and round(got[100]["similarity"], 9) == 1 and got[100]["evidence"][0] == 60
    assert got[101]["evidence"][0] == 60 and got[61]["predicted"] == 0 and got[102]["evidence"] == []


def test_token_ledger(spark, tmp_path, docs, rows):
    counts = rollups.count_tokens(docs, ("byte_bpe_50k",))
    ledger = rollups.TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    assert ledger.commit("a", rollups.as_changes(counts, ("byte_bpe_50k",), 1)) and not ledger.commit("a", rollups.as_changes(counts, ("byte_bpe_50k",), 1))
    one = ledger.totals().first()
    assert (one["docs"], one["bytes"]) == (len(rows), sum(len((t or "").encode()) for _, t in rows))
    ledger.commit("b", rollups.as_changes(counts, ("byte_bpe_50k",), -1))
    assert ledger.totals().count() == 0


def test_fixity_and_tool_calls_equal_sql(spark):
    con = duckdb.connect()
    for name in ("pages", "conversations"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for ours, sql in ((fixity.op7_fixity, fixity.ORACLE), (tool_calls.op2_tool_calls, tool_calls.ORACLE)):
        a, b = ours(spark, SF).toPandas(), con.sql(sql).df()
        show = lambda f: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in f[sorted(a.columns)].itertuples(index=False))
        assert show(a) == show(b)


def test_tool_calls_cycles_and_schemas(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "f", '{"n":1}', []), (1, "b", 1, "f", '{"n":"x","z":1}', ["a"]), (1, "c", 2, "g", "[]", ["d"]), (1, "d", 3, "f", None, ["c"]), (1, "a", 9, "f", "{}", []), (None, "q", 0, "f", "{}", [])],
        "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", 5, "late"), (1, "a", 4, "early"), (1, "zz", 1, "orphan")], "conv_id long, call_id string, turn long, content string")
    got = {r["call_id"]: r for r in tool_calls.link_tool_calls(calls, results, {"f": {"required": {"n": "integer"}}}).collect()}
    assert set(got) == {*"abcd", "zz"} and not got["zz"]["linked"] and got["zz"]["problems"] == "result without call" and (got["a"]["repeats"], got["a"]["level"], got["b"]["level"], got["c"]["level"]) == (2, 0, 1, None)
    assert got["a"]["record"] == '{"arguments":{"n":1},"depends_on":[],"id":"a","name":"f","result":"late"}'
    assert got["b"]["problems"] == "n is not integer; unexpected z" and got["d"]["problems"] == "arguments are not an object"
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), {}).count() == 0
    chain = spark.createDataFrame([(1, str(n), n, "f", "{}", [str(n - 1), str(n // 2)] if n else []) for n in range(6)], calls.schema).withColumn("level", F.lit("clash"))
    assert [r["level"] for r in tool_calls.link_tool_calls(chain, results, {"f": {}}).where("repeats > 0").orderBy("turn").collect()] == list(range(6))


def test_decontamination(spark, empty):
    r = random.Random(3)
    item = [r.choice(WORDS) + str(i % 7) for i in range(30)]
    noise = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    near, far = list(item), list(item)
    near[0] = "other"
    far[10] = far[20] = "other"
    texts = [f"{noise(40)} {' '.join(item).upper()}. {noise(9)}", " ".join(item), f"{noise(5)} {' '.join(near)}", " ".join(far), noise(200), None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[1])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None)], "item_id long, text string")
    got = {(g["doc_id"], g["item_id"]): (g["start"], g["similarity"]) for g in decontamination.find_leaks(docs, bench).collect()}
    assert got[(0, 1)] == (40, 1.0) and got[(1, 1)] == (0, 1.0) and got[(None, 1)] == (0, 1.0) and got[(2, 1)][1] >= 0.9 and len(got) == 4
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0


def test_decontamination_of_repeated_and_overlapping_items(spark):
    r = random.Random(5)
    item, other = ([r.choice(WORDS) + str(i % 7) for i in range(60)] for _ in range(2))
    near = [*item[:30], "other", *item[31:]]  # 51 of 61 shingles are shared
    items = [(i, " ".join(item)) for i in range(12)] + [(50 + i, " ".join(item[25:36] + other[4 * i : 4 * i + 30])) for i in range(3)] + [(90 + i, " ".join(item[: 20 + i])) for i in range(5)]
    docs = spark.createDataFrame([(1, " ".join(other[:9] + near + other[9:20])), (2, " ".join(other))], "doc_id long, text string")
    got = {(g["doc_id"], g["item_id"]): g for g in decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for d in docs.collect():
        words = d["text"].split()
        for i, text in items:
            want = shingles(text.split())
            windows = [shingles(words[s : s + len(text.split())]) for s in range(max(1, len(words) - len(text.split()) + 1))]
            best = max(len(w & want) / len(w | want) for w in windows)
            assert best < 0.8 or got[(d["doc_id"], i)]["similarity"] >= best - 1e-9
    assert all(got[(1, i)]["start"] == 9 for i in range(12)) and not [g for g in got if g[0] == 2]


def test_language_scores(docs, empty, rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
    c = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((len(words(t)), sum(c[w] > 0 for w in words(t)), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for _, t in rows)
    got = context_tree.language_scores(docs).collect()
    assert sorted((g["n_tokens"], g["n_known"], round(g["base_score"], 6)) for g in got) == want
    assert all(g["train_tokens"] == n and g["score"] < 0 for g in got)
    assert context_tree.language_scores(empty).count() == 0


def test_near_groups(docs, empty, rows):
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == len(rows) and Counter(g["class_id"] for g in got if g["kept"]) == Counter({g["class_id"]: 1 for g in got})
    of = defaultdict(set)
    for g in got:
        of[g["class_id"]].add(g["doc_id"])
    assert {6, 7, 8, 9, 15} in of.values() and {0, 1, 2, None} in of.values() and {3, 4} in of.values() and {5} in of.values()
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(of)
    assert near_dedup.near_groups(empty).count() == 0


def test_near_groups_equal_brute_force(spark, monkeypatch):
    """All pairs by weighted Jaccard, on chains of edits, a large group with few unlike copies, and copies."""
    import numpy as np

    r = random.Random(11)
    say = lambda n: [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]
    base, texts = say(150), []
    for n in range(160):  # edits of one text, most within 0.8 of it, some beyond
        words = list(base)
        for at in r.sample(range(150), r.choice([1, 1, 2, 2, 3, 4])):
            words[at] = r.choice(WORDS) * 2
        texts.append(" ".join(words))
    chain = say(150)
    for n in range(12):  # each near the one before only
        chain = chain[:-2] + say(2) if n % 2 else say(2) + chain[2:]
        texts.append(" ".join(chain))
    texts += [" ".join(say(80)) for _ in range(40)] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, hashes, _ = near_dedup.document_shingles(texts)
    df = dict(zip(*(x.tolist() for x in np.unique(hashes, return_counts=True)), strict=True))
    packed = []
    for t in texts:
        _, h, tf = near_dedup.document_shingles([t])
        v = np.empty(len(h), near_dedup.VECTOR)
        v["hash"], v["tf"], v["code"] = h, tf, near_dedup.df_code(np.asarray([df[x] for x in h.tolist()]))
        packed.append(v.tobytes())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.weighted_jaccard(packed[i], packed[j], len(texts)) >= 0.8 - 1e-9 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    tiles = near_dedup.tiles_for
    for parts in (1, 3):  # a range answered whole, and in parts of the chunks
        with monkeypatch.context() as m:
            m.setattr(near_dedup, "tiles_for", lambda d, s, p=parts: (tiles(d, s)[0], p))
            m.setattr(near_dedup, "into_chunks", lambda d, s: lookup.into_chunks(d, s, 8 << 10))
            got = {g["doc_id"]: g["class_id"] for g in near_dedup.near_groups(docs).collect()}
        assert got == dict(enumerate(label))
    assert 5 < len(set(label[:160])) < 100 and len(set(label[160:172])) < 12


def test_near_copies_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x", True), (2, "a b c d e f", 6, "y", False), (None, None, 7, "z", None)], "doc_id long, text string, k_id long, k_sha string, row boolean")
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["k_id"] for r in kept.collect()) == [5, 7]


def brute_force_tree(train, texts, depth=context_tree.DEPTH):
    """log10 probabilities of texts by context-tree weighting, with a dictionary of nodes and Python's own logarithms of gamma."""
    low = lambda t: [None] * depth + list(bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())) + [None]

    def decisions(t):
        s = low(t)
        for i in range(depth, len(s)):
            symbol, prefix = 255 if s[i] is None else s[i], ""
            for b in f"{symbol:08b}":
                yield tuple(s[i - depth : i]), prefix, int(b)
                prefix += b

    seen = defaultdict(lambda: [0, 0])
    for t in train:
        for before, prefix, b in decisions(t):
            for d in range(depth + 1):
                seen[before[depth - d :], prefix][b] += 1
    children = defaultdict(list)
    for before, prefix in seen:
        if before:
            children[before[1:], prefix].append((before, prefix))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted = {}
    for node in sorted(seen, key=lambda x: -len(x[0])):
        own = kt(*seen[node])
        if len(node[0]) < depth:
            below = sum(weighted[c] for c in children[node])
            top = max(own, below)
            own = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
        weighted[node] = own
    out = []
    for t in texts:
        total = 0.0
        for before, prefix, b in decisions(t):
            p = 0.5
            for d in range(depth, -1, -1):
                node = before[depth - d :], prefix
                if node in seen:
                    zeros, ones = seen[node]
                    stop = 1.0 if d == depth else math.exp(kt(zeros, ones) - math.log(2) - weighted[node])
                    p = stop * (ones + 0.5) / (zeros + ones + 1) + (1 - stop) * p
                else:
                    p = 0.5
            total += math.log10(p if b else 1 - p)
        out.append(total)
    return out


def test_context_tree_equals_brute_force(spark, rows, monkeypatch):
    texts = [(i, (t or "")[:600]) for i, t in rows] + [(40, "a\0b"), (41, "a\0"), (42, "a"), (43, "the theme then the thesis"), (44, "the thermal these")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    train = [t for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 10]
    want = sorted(round(x, 4) for x in brute_force_tree(train, [t for _, t in texts]))
    for parts in (1, 3):  # a range answered whole, and in parts; counts added at once, and in rounds
        tiles = context_tree.tiles_for
        with monkeypatch.context() as m:
            m.setattr(context_tree, "tiles_for", lambda d, s, p=parts: (tiles(d, s)[0], p))
            m.setattr(context_tree, "BATCH_BYTES", 8 << 20 if parts == 1 else 512)
            m.setattr(context_tree, "FAN_IN", 256 if parts == 1 else 2)
            got = context_tree.language_scores(docs).collect()
        assert sorted(round(g["score"], 4) for g in got) == pytest.approx(want, abs=2e-4)


def test_fixity_equals_brute_force(spark):
    """Null, negative and repeated pages; lost, added, altered and repeated records: a finding each, whatever the ordinals after them."""
    r = random.Random(5)
    rows = [(i, f"http://a/{i}", "x" * r.randint(0, 50)) for i in [*range(-1005, -990), *range(40), 2500]] + [(None, f"http://n/{i}", "n") for i in range(8)] + [(None, None, None)] * 3 + [(7, "http://a/7", "twin"), (7, "http://b/7", "other")]
    schema = "page_id long, url string, html string, archive string"
    frame = lambda rs: spark.createDataFrame([(*x, "clash") for x in rs], schema)
    layout = lambda rs: fixity.lay_out(frame(rs))
    assert fixity.fixity_audit(layout(rows), layout(rows[::-1])).count() == 0
    gone = [(-1000, "http://a/-1000"), (3, "http://a/3"), (None, "http://n/2")]
    other = [x for x in rows if x[:2] not in gone]
    other = [(i, u, h + "!") if (i, u, h) in ((20, "http://a/20", h), (None, "http://n/5", "n")) or h == "twin" else (i, u, h) for i, u, h in other]
    other.remove((None, None, None))
    other.append((12, "http://a/new", "new"))

    def want(a, b):
        out = Counter()
        for key in {x[:2] for x in a + b}:
            mine, theirs = (Counter(x[2] or "" for x in t if x[:2] == key) for t in (a, b))
            lost, come = sum((mine - theirs).values()), sum((theirs - mine).values())
            out.update({(key[0], "altered"): min(lost, come), (key[0], "missing"): max(0, lost - come), (key[0], "surplus"): max(0, come - lost)})
        return +out

    def got(a, b):
        out = Counter()
        for g in fixity.fixity_audit(layout(a), layout(b)).collect():
            out[g["page_id"], g["damage"]] += g["copies"]
            assert (g["archive"] is None) == (g["page_id"] is None) and (g["expected"] is None) == (g["damage"] == "surplus") and (g["found"] is None) == (g["damage"] == "missing")
        return out

    assert got(rows, other) == want(rows, other) == Counter({(-1000, "missing"): 1, (3, "missing"): 1, (None, "missing"): 2, (20, "altered"): 1, (None, "altered"): 1, (7, "altered"): 1, (12, "surplus"): 1})
    assert got(rows, []) == want(rows, []) and got([], rows[:5]) == want([], rows[:5]) and not got([], [])
    placed = {(x["page_id"], x["uri"], x["sha256"]): x for x in layout(rows).collect()}
    inside = sorted((x["ordinal"], x["start"], x["bytes"] * x["copies"], x["copies"]) for x in placed.values() if x["key"] == "pages 0")
    assert all(b[0] == a[0] + a[3] and b[1] == a[1] + a[2] for a, b in zip(inside, inside[1:])) and inside[0][:2] == (0, 0)


def test_token_counts_query_equals_brute_force(spark):
    import base64

    import public_tokenizers as public
    import tiktoken

    def whole(name):  # the whole text at once, without cuts or memory
        with open(public.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    toxic = {g["doc_id"] for g in table(spark, SF, "labels").where("toxic = 1").collect()}
    want = defaultdict(lambda: [0, 0, 0])
    encode = {t: whole(t) for t in rollups.TOKENIZERS}
    for d in table(spark, SF, "documents").collect():
        if d["doc_id"] not in toxic:
            text = re.sub(rollups.SIGN_RUNS.removeprefix("(?U)"), r"\1", d["text"] or "")
            for t in encode:
                row = want[d["source"], d["lang"], t]
                for i, n in enumerate((1, len(encode[t](text)), len(text.encode()))):
                    row[i] += n
    got = {(g["source"], g["lang"], g["tokenizer"]): [g["docs"], g["tokens"], g["bytes"]] for g in rollups.op6_token_counts(spark, SF).collect()}
    assert got == dict(want)
