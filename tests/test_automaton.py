"""The automaton finds and claims what the surface patterns do, one pattern after the other."""

from __future__ import annotations

import random

import pytest

from corvane.operators import automaton, spans

SCHEMA = "doc_id long, text string, ord int, n int"
ALIASES = "ord long, surface string, token string"


def brute(text, aliases):
    """Longest first, ties in order; every pattern from left to right."""
    taken, out = [False] * len(text), []
    for order, surface, token in sorted(aliases, key=lambda a: (-len(a[1]), a[0])):
        for m in spans._python_pattern(surface).finditer(text):
            a, b = m.span()
            if a < b and not any(taken[a:b]):
                taken[a:b] = [True] * (b - a)
                out.append((a, b, order, token))
    return sorted(out)


def some(rng):
    letters = ["a", "B", "ß", "é", "İ", "ſ", "K", "1", " ", "  ", "\n", "-", " ", "s", "k", "i"]
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    aliases = [(i, text(rng.randint(1, 5)), f"[T{i}]") for i in range(60)] + [(100, "a a", "[A]"), (101, " a", "[B]"), (102, "A A", "[C]"), (103, "", "[D]"), (104, None, "[E]"), (105, "b\na", None)]
    texts = [(i, text(rng.randint(0, 120))) for i in range(60)] + [(90, None), (91, ""), (92, "a a a  a\ta"), (93, "xa a")]
    return texts, aliases


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_claims_equal_the_patterns(spark, block):
    texts, aliases = some(random.Random(5))
    kept = [(o, s, t or "") for o, s, t in aliases if s and s.strip()]
    frame, table = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], SCHEMA), spark.createDataFrame(aliases, ALIASES)
    got = {r["doc_id"]: r["spans"] and [(x["start"], x["stop"], x["ord"], x["token"]) for x in r["spans"]] for r in automaton.claims(frame, table, block_bytes=block).collect()}
    assert {d: x or [] for d, x in got.items()} == {d: brute(t or "", kept) for d, t in texts} and got[90] is None
    count = {(r["doc_id"], r["ord"]): r["n"] for r in automaton.occurrences(frame, table, block_bytes=block).collect()}
    want = {(d, o): n for d, t in texts for o, s, _ in kept if (n := sum(m.end() > m.start() for m in spans._python_pattern(s).finditer(t or "")))}
    assert count == want
    masked = {r["doc_id"]: (r["masked"], r["n"]) for r in automaton.masked(frame, table, "black", block_bytes=block).collect()}
    for d, t in texts:
        found, out = brute(t or "", kept), t
        for a, b, _, _ in reversed(found):
            out = out[:a] + "█" * max(b - a, 3) + out[b:]
        assert masked[d] == (out, len(found))


def test_a_hundred_thousand_aliases(spark):
    """The plan does not grow with the dictionary, and the finds are those of a plain lookup."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(130_000)]
    known = dict.fromkeys(words[:100_000])
    texts = [(d, " ".join(rng.choice(words) for _ in range(200))) for d in range(50)]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], SCHEMA)
    table = spark.createDataFrame([(i, w, f"[{i}]") for i, w in enumerate(known)], ALIASES)
    out = automaton.masked(frame, table)
    small = automaton.masked(frame, table.limit(3))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(automaton.masked(frame, table, block_bytes=1 << 23)) < size(small) + 200
    number = {w: i for i, w in enumerate(known)}
    assert {r["doc_id"]: r["masked"] for r in out.collect()} == {d: " ".join(f"[{number[w]}]" if w in number else w for w in t.split(" ")) for d, t in texts}


def test_empty_dictionary(spark):
    frame = spark.createDataFrame([(1, "a", 1, 1), (2, None, 1, 1)], SCHEMA)
    none = spark.createDataFrame([], ALIASES)
    assert {r["doc_id"]: (r["masked"], r["n"]) for r in automaton.masked(frame, none).collect()} == {1: ("a", 0), 2: (None, 0)}
    assert automaton.occurrences(frame, none).collect() == []
