import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, h string"
WORDS = "the and river stone light paper green mountain slow quick über café Straße naïve window garden letter music".split()


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, ties, repeated rows, shared lines and passages."""
    r = random.Random(3)
    sentence = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = "This line is shared by a good many documents, word for word."
    passage = sentence(40)
    base = sentence(120)
    texts = [None, "", " ", "\n\n", "!!! ...", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.\nMIT license mit license", "GNU General Public License gnu general public license"]
    texts += [sentence(r.randint(1, 60)) for _ in range(30)]
    texts += [sentence(r.randint(5, 30)) + "\n" + shared + "\n  " + shared.upper() + "\t\n" + sentence(8) for _ in range(8)]
    texts += [sentence(30) + " " + passage + " " + sentence(20) for _ in range(4)]
    texts += [base] * 5 + [base + " " + w for w in WORDS[:6]]
    texts += ["call +1 (838) 555-9577 or 4111 1111 1111 1111 or a.b@mail.example.com or 10.0.0.1, not 999.1.1.1", "x" * 5000 + " " + sentence(3000)]
    out = [(i * 3, t, None if i % 7 == 0 else "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t), "clash", "clash", "clash") for i, t in enumerate(texts)]
    out += [out[10], out[10], out[40]]  # repeated rows
    out += [(out[12][0], "another text with an id that is taken", "en", "s1", 5, "c", "c", "c"), (None, "no id here at all", "en", "s0", 3, "c", "c", "c")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark, rows):
    passage = next(t for _, t, *_ in rows if t and len(t.split()) == 90)
    words = passage.split()[30:70]
    items = [(1, " ".join(words)), (2, "too short an item"), (3, None), (4, ""), (10, " ".join(words[5:25]).upper()), (11, "café")]
    return spark.createDataFrame(items, "item_id long, text string")
