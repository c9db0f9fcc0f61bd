"""Fill-in-the-middle against units cut by pattern."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from lodestrand.llm import fill_middle

PATTERNS = {"word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+", "char": r"(?s:.)"}


def units_of(text, unit):
    return re.findall(PATTERNS[unit], text)


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_runs_cut_where_units_end(unit):
    r = random.Random(5)
    texts = ["", " ", "a", "é", "🙂", " \t\x0b\x0c\r\n", "\xa0\x85 x", "字 字字\n\n🙂é a", "\n\n\nab\n"] + ["".join(r.choice(" \n\tabé字🙂") for _ in range(r.randrange(1, 200))) for _ in range(200)]
    for text in texts:
        utf8, units = text.encode(), units_of(text, unit)
        runs = fill_middle.encode_runs(np.frombuffer(utf8, np.uint8), unit)
        assert runs.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert runs.cut(k) == (len(head.encode()), len(head))


def expected(key, text, rate=50, spm_rate=80, unit="word"):
    text = text or ""
    digest = sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = units_of(text, unit)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < spm_rate
    return key, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"rate": 100, "spm_rate": 0}, {"rate": 100, "spm_rate": 100, "unit": "line"}, {"rate": 100, "unit": "char"}, {"rate": 0}])
def test_equals_brute_force_and_comes_back(odd_docs, odd_rows, options):
    got = fill_middle.fill_in_middle(odd_docs, **options).withColumn("back", fill_middle.restore()).collect()
    assert Counter(tuple(g)[:6] for g in got) == Counter(expected(i, t, **options) for i, t in odd_rows)
    assert Counter((g["doc_id"], g["back"]) for g in got) == Counter((i, t or "") for i, t in odd_rows)


def test_other_marks_empty_tables_and_units(odd_docs, no_docs, odd_rows):
    marks = ("[(pre)]", "[(suf)]", "[(mid)]")
    got = fill_middle.fill_in_middle(odd_docs, rate=100, marks=marks).withColumn("back", fill_middle.restore(marks=marks)).collect()
    assert Counter((g["doc_id"], g["back"]) for g in got) == Counter((i, t or "") for i, t in odd_rows)
    assert any(g["form"] != "plain" and "<P>" in g["back"] for g in got)
    assert fill_middle.fill_in_middle(no_docs).count() == 0
    with pytest.raises(ValueError):
        fill_middle.encode_runs(np.frombuffer(b"a", np.uint8), "page")
