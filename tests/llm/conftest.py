import random

import pytest

SF = "/root/testdata/sf0.001"
#: The extra columns have names that the operators use themselves.
CLASHING = "digest string, bucket int, fp string, h long, base string, more string, `all` int, gone_id long, GONE_H string, found string, ids int, doc string, old boolean, key string, __dropped long, __more int, i int, k int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def awkward():
    """Nulls, empty and long texts, ties, repeated rows, odd characters; the extra columns clash with internal names."""
    rng = random.Random(5)
    words = ["The", "quick", "brown", "fôx", "jumps", "over", "lazy", "dogs", "été", "über", "42", "a.b", "x@y"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [None, "", " \n\t ", "one", "one two", "One Two three", "one two three", passage, passage.upper(), passage + " end", passage]
    texts += ["line a b c\n" * 9 + "tail", "x" * 5000, "1.2.3.4 " * 40, "naïve 日本語 テキスト   end", "mail bob@example.com, +1 (212) 555-0100 now", "4111 1111 1111 1111 and 10.0.0.256 and 10.0.0.25.7.8.9.1"]
    texts += ["a@b.co_x@y.zz +12345678901+123 1.2.3", "ip 010.001.000.255 4111-1111-1111-1112 <|endoftext|> it's", passage.replace("quick", "slow", 1)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(25)]
    texts += [" ".join(rng.choice(words) for _ in range(30_000))]
    extra = ("d", 1, "f", 5, "b", "m", 2, 7, "g", "x", 3, "y", True, "z", 8, 9, 4, 6)
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", None, *extra) for i, t in enumerate(texts)]
    return rows + [(None, "no id here", None, None, 3, *[None] * len(extra)), rows[7], rows[0]]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
