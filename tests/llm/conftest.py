from __future__ import annotations

import pytest

WORDS = "the cat sat on a mat and then went home to eat some fish with rice while rain fell over old town roofs near green hills".split()


def prose(seed: int, n: int) -> str:
    """n words of deterministic prose with sentences."""
    import random

    rng = random.Random(seed)
    out = [f"{rng.choice(WORDS)}{rng.choice(['', 's', 'ed', 'ing'])}{rng.randint(0, 99)}" for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out))


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) rows, with columns whose names clash with those used inside."""

    def run(rows):
        data = [(i, t, "en", "src1", None if t is None else len(t), 1, 2, 3, 4, 5) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, __rid int, extra int, TEXT int, stream int, rid int")

    return run


@pytest.fixture(scope="session")
def edge(make):
    """Nulls, empty and very long texts, repeated rows, ties."""
    long = prose(5, 30_000)
    return make([(1, prose(1, 80)), (1, prose(1, 80)), (None, prose(2, 70)), (None, None), (3, None), (4, ""), (5, "   \n\t "), (6, long), (7, "x" * 200_000), (8, prose(1, 80)), (9, "é中🙂 ."), (10, "a")])
