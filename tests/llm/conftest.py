import random

import pytest

SYLLABLES = "th er in an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, words): made-up words, equal for equal seeds."""

    def make(seed, words):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Documents with every kind of odd row, and extra columns whose names clash with results."""
    long = prose(1, 30_000)
    rows = [(1, prose(2, 80)), (2, None), (3, ""), (None, prose(3, 70)), (5, prose(2, 80)), (5, prose(2, 80)), (6, long), (7, " \t\n\n \x0b"), (8, "\n".join([prose(4, 60)] * 3)), (9, "x" * 70_000), (None, None), (10, "É漢字 \U0001f600 <|endoftext|> 'S")]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k}", len(t or ""), 0.5, True, "x", 1, b"z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, fp string, n_words int, ids binary")
