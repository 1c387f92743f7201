from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, bucket int, label int, grams binary, n long, gone_id long, at string"


def table(spark, docs):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "en", None, None, 9, None, 3, None, 1, None, "x") for d, t in docs], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Random prose with copies, near copies, shared passages and lines, repeats, junk, empty and very long texts."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["The", "OF", "and."]

    def prose(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(n)).strip()

    docs = {d: prose(rng.randint(1, 160)) for d in range(60)}
    passage, line = prose(40), "A line of boilerplate that many documents share, word for word."
    for d in range(60, 80):
        docs[d] = prose(30) + " " + passage + " " + prose(20)
    for d in range(80, 90):
        docs[d] = docs[d - 70]
    for d in range(90, 110):  # near copies: each has one or two words changed
        words = docs[20].split(" ") if d < 100 else (prose(200) if d == 100 else docs[100]).split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = prose(1)
        docs[d] = " ".join(words)
    for d in range(110, 120):
        docs[d] = f"{prose(10)}\n{line[: d - 112] + '#' + line[d - 112 :] if d > 112 else line}\n{line}\n{prose(60)}"
    docs |= {120: "", 121: None, 122: "one", 123: "one", 124: " \n\t ", 125: "x " * 300, 126: "ab" * 400, 127: prose(6000), 128: "é" * 150 + "漢" * 90, 129: "é" * 150 + "漢" * 90, 130: "\n".join([line] * 5), 131: "# $ %\n# $ %\n<b>|</b>"}
    return sorted(docs.items())


def by_id(df, *columns):
    rows = df.select("doc_id", *columns).collect()
    out = {r["doc_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out
