from __future__ import annotations

import random

import pytest

#: Names that operators use inside; inputs hold columns of these names as well.
CLASH = ["hash", "key", "label", "z", "guest", "order", "part", "task", "rank", "start", "same", "name", "at", "next", "lost", "kept", "lines", "carried", "tree", "n", "component", "spans", "template", "toxic_evidence", "labels_", "block", "bucket", "payload"]

WORDS = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green", "silver", "window", "ñandú", "été", "über", "snow", "lamp", "paper", "seven", "light", "music", "garden"]


def prose(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        k = rng.randint(4, 9)
        s = [rng.choice(WORDS) + rng.choice(["", "s", "er", "ing"]) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    base = [prose(rng, rng.randint(5, 200)) for _ in range(24)]
    line = "This line stands in several documents of the corpus."
    rows: list[tuple[int | None, str | None]] = [(10 + i, t) for i, t in enumerate(base)]
    rows += [(100, base[0]), (101, base[0]), (102, base[1] + " Another ending here."), (103, " ".join(base[2].split()[1:]))]
    rows += [(200, ""), (201, None), (202, " \n\t "), (203, "word"), (204, "a  b <|endoftext|> c\n\n d"), (205, "日本語 text Ⅷ ﬁ")]
    rows += [(300, line + "\n" + base[3]), (301, base[4] + "\n  " + line.upper()), (302, line), (303, "short\nshort\n" + line + "\n" + line)]
    rows += [(400, prose(rng, 6000)), (401, "x" * 30000), (402, "same same " * 500)]
    rows += [(None, "a document without an id and some words"), (150, base[5]), (150, base[5])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, None, "src0", None, *["x"] * len(CLASH)) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
