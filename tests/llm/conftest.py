import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, word string, form string, `group` int, n long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    r = random.Random(11)
    words = [a + b + c for a in "ba ce di fo gu".split() for b in "ran net lis".split() for c in "tol pur".split()]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = say(150)
    texts = [None, "", None, "one", "  ", "\n one\ttwo \x0b", base, base, base.upper(), say(40), say(4000), "ß é\n\n\tñ ünïcödé 字字 🙂🙂", "a" * 3000, "a <P> b c d e", "x <S> y", "<M>", "<P <S <M", "line\nline\n\n\nend"]
    texts += [say(r.randrange(1, 60)) for _ in range(60)]
    return [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(3, "one"), (None, None), (None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "w", "f", 1, 2) for i, t in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
