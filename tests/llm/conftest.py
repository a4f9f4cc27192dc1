from __future__ import annotations

import random

import pytest

WORDS = "the of and tion ing alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, exact and near copies, shared passages, repeated rows."""
    rng = random.Random(7)
    passage, base, out = prose(rng, 60), prose(rng, 80), []
    for i in range(60):
        out.append((i, prose(rng, rng.randrange(1, 120)), rng.choice(["en", "fr", None]), f"s{min(i % 5, rng.randrange(9) % 5)}"))
    out += [(100 + i, base, "en", "s0") for i in range(6)]
    for i in range(20):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        out.append((200 + i, " ".join(words), "de", "s1"))
    out += [(300 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 40), "en", "s2") for i in range(8)]
    out += [
        (400, None, None, None), (401, "", "en", "s1"), (402, " \t\n\x0b\x0c\r ", "en", "s1"), (403, "one", "en", None), (404, "two words", "en", "s0"), (405, "One", "en", "s0"),
        (406, "Élan vital\r\n\r\nÉlan vital. Ça va? 漢字 😀", "fr", "s3"), (407, prose(rng, 9000), "en", "s4"), (408, "x" * 70_000, "en", "s4"), (409, "a b c d", "en", "s0"), (410, "A B C D", "en", "s0"),
        (None, prose(rng, 40), "en", "s0"), (None, base, "en", "s0"), (411, "same row twice here now", "en", "s0"), (411, "same row twice here now", "en", "s0"),
    ]
    rng.shuffle(out)
    return [(*r, len(r[1]) if r[1] is not None else None) for r in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
