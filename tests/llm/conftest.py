import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Ordinary, repeated, near-repeated, odd and very long texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "é", "ß"]) for _ in range(rng.randint(1, 4)))
    prose = [" ".join(word() for _ in range(rng.randint(12, 90))) + "." for _ in range(60)]
    near = [prose[0] + " " + word() for _ in range(6)]
    odd = [
        None, "", "   \n\t ", "one", "A a A a", "x" * 3000, ("long line of words " * 3000).strip(), "tab\tand\x0bvertical\x0cfeeds\r\nend",
        "it's 'll <|endoftext|> a<|endoftext|>b", "  two  spaces \n\n lines \n", "▁mark ▁▁ inside▁word", " nbsp   wide　space \n\n x", "日本語 テキスト",
        "mail a.b@c.org or +1 (555) 010-9999, card 4111 1111 1111 1111 at 10.0.0.1.", "same line\nsame line\nsame line\nother",
    ]
    return prose + near + odd + [prose[1], prose[1], prose[2]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Null and repeated ids, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", ["s1", "s2", "s3", None][i % 4] if i % 3 else "s1", 0 if t is None else len(t), 7, "x", 1.5) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all, just words", "de", "s2", 5, 7, "x", 1.5), rows[3], rows[3], (5, "another text of doc five", "fr", None, 3, 7, "x", 1.5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, score double"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
