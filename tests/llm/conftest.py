import random

import pytest

WORDS = "the of and to in that for with this are from have not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use".split()
#: Columns whose names clash with what operators make.
EXTRA = "n_tokens long, kept boolean, text_sha256 string, row long, w string, component_id long, label string"
CLASH = (7, False, "x", 3, "y", 5, "z")


@pytest.fixture(scope="session")
def prose():
    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.6 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text) rows with clashing columns, over several partitions."""

    def make(rows, parts=4):
        return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], f"doc_id long, text string, {EXTRA}").repartition(parts)

    return make


@pytest.fixture(scope="session")
def oddities(prose):
    long = prose(30_000, 1)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, prose(50, 2)), (5, prose(50, 2)), (6, prose(50, 2)), (None, "lost id"), (7, long), (8, "é \U0001f600 ñandú ＡＢ 日本語\x00\x1c"), (9, "<|endoftext|> it's I'LL  x"), (10, long)]
