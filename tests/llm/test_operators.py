from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import public_tokenizers
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, line_dedup, ngram_join, quality_classifier, quality_rules, repeats, sharding, suffixes, token_files
from corvane.llm import kernels as K
from tests.llm import brute
from tests.llm.conftest import by_id, table

#: Texts that every operator must take: nulls, empty and blank texts, ties and repeated rows.
ODD = [(None, None), (None, "a b c"), (5, None), (6, ""), (7, " \n "), (8, "same words here"), (8, "same words here"), (9, "same words here")]
BENCHMARK = "item_id long, text string, doc_id int"
LABELS = "doc_id long, quality int, toxic int"


def odd(spark):
    return table(spark, ODD)


def empty(spark):
    return table(spark, [(1, "x")]).limit(0)


def labels(spark, docs):
    return spark.createDataFrame([(d, int(len((t or "").split()) > 60), 0) for d, t in docs] + [(None, 1, 0), (3, None, None)], LABELS)


def every_operator(spark, docs):
    bench = spark.createDataFrame([(1, "same words here", 0), (None, "x", 0), (2, None, 0)], BENCHMARK)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return {
        "repeats": repeats.remove_repeated_words(docs, with_text=True),
        "bytes": suffixes.remove_repeated_bytes(docs),
        "rules": quality_rules.digest(docs, labels(spark, [])),
        "lines": line_dedup.digest(docs),
        "lines removed": line_dedup.remove_lines(docs),
        "several edits": line_dedup.digest(docs, 2, 20, 1),
        "near": ngram_join.components(docs),
        "classifier": quality_classifier.digest(docs, labels(spark, [])),
        "benchmark": decontaminate.digest(docs, bench),
        "clean": decontaminate.drop_contaminated(docs, spark.createDataFrame([], BENCHMARK)),
        "shards": sharding.assign(docs),
        "tokens": token_files.digest(docs, public_tokenizers.path("word_bpe_49k.json")),
        "bpe": bpe.digest(docs, path, public_tokenizers.PATTERN),
        "encoded": bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path),
    }


def test_odd_rows_keep_their_rows(spark):
    for name, df in every_operator(spark, odd(spark)).items():
        assert sorted(str(r["doc_id"]) for r in df.collect()) == sorted(str(d) for d, _ in ODD), name


def test_different_texts_without_or_under_one_id(spark):
    """Each is a document of its own, in the order of ids and then of text hashes; no verdict hits another's text."""
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line, passage = "a line that stands in several documents, word for word", prose(60)
    docs = [(d, prose(60)) for d in range(5)] + [(3, f"{line}\n{prose(40)}"), (9, f"{prose(30)}\n{line}"), (9, f"{prose(5)} {passage} {prose(30)}")]
    docs += [(None, f"{prose(8)}\n{line}\n{prose(70)}"), (None, f"{prose(90)}\n{prose(9)}\n{line}"), (None, f"{passage} {prose(40)}"), (None, docs[0][1]), (None, docs[1][1] + " more"), (None, None), (None, prose(50)), (None, prose(70))]
    rows = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(docs)], "i int, d long, t string").selectExpr("i", "coalesce(d, 9223372036854775807) as d", "xxhash64(t) as h").collect()
    own = {r["i"]: n for n, r in enumerate(sorted(rows, key=lambda r: (r["d"], r["h"])))}
    numbered = sorted((own[i], t) for i, (_, t) in enumerate(docs))
    real = {own[i]: d for i, (d, _) in enumerate(docs)}
    want = lambda out: sorted(((real[n], *x) for n, x in out.items()), key=str)
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    frame = table(spark, docs)
    assert got(repeats.remove_repeated_words(frame)) == want(brute.substring_dedup(numbered))
    assert got(suffixes.remove_repeated_bytes(frame)) == want(brute.byte_dedup(numbered))
    lines = brute.line_dedup(numbered, 1, 30)
    assert got(line_dedup.digest(frame)) == want(lines)
    cut = {n: (t if not lines[n][3] else "\n".join(x for i, x in enumerate(t.split("\n")) if str(i) not in lines[n][3].split(",")),) for n, t in numbered}
    removed, kept = line_dedup.remove_lines(frame), ngram_join.keep_first(frame)
    assert got(removed.select("doc_id", "text")) == want(cut) and removed.schema == frame.schema
    near = brute.near_components(numbered, 5, 80)
    assert got(kept.select("doc_id", "text")) == want({n: (t,) for n, t in numbered if near[n][1] == n}) and kept.columns == frame.columns


def test_filters_and_files_take_odd_rows(spark, tmp_path):
    """Filters keep rows as they are, or drop them by their rule; files hold every row that has an id."""
    for name, docs, left in (("odd", odd(spark), len(ODD)), ("empty", empty(spark), 0)):
        assert quality_rules.keep_good(docs, labels(spark, [])).collect() == []  # all are under 50 words
        kept = ngram_join.keep_first(docs)
        # Of the texts under 8, 8 and 9 the first stays, with its equal row; those without words stay.
        assert kept.columns == docs.columns and kept.count() == (left - 1 if left else 0)
        sharding.write_shards(docs.drop("bucket"), str(tmp_path / f"{name}-shards"), 5)
        if left:
            back = spark.read.parquet(str(tmp_path / f"{name}-shards"))
            assert sorted(str(r["text"]) for r in back.collect()) == sorted(str(t) for _, t in ODD)
        token_files.write(token_files.encode(docs, public_tokenizers.path("word_bpe_49k.json"), 2), str(tmp_path / name), "delta")
        assert token_files.checksums(token_files.read(spark, str(tmp_path / name))).count() == left


def test_models_hold_out(spark):
    """Floors on the held-out quarter of the labels: the rules' verdict, and the classifier's label and order."""
    folder = "/root/testdata/sf0.1"
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    label = {r["doc_id"]: r["quality"] for r in marks.where("quality is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    rules = {r["doc_id"]: r["kept"] for r in quality_rules.digest(docs, marks).collect()}
    scores = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality_classifier.digest(docs, marks).collect()}
    own = [d for d in label if d in rules]
    assert len(own) > 500
    assert sum(rules[d] == bool(label[d]) for d in own) / len(own) > 0.93
    assert sum(scores[d][1] == label[d] for d in own) / len(own) > 0.94
    good, bad = ([scores[d][0] for d in own if label[d] == y] for y in (1, 0))
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None, :]) > 0.92


def test_empty_tables(spark):
    for name, df in every_operator(spark, empty(spark)).items():
        assert df.collect() == [], name


def test_substring_dedup(spark, corpus):
    got = by_id(repeats.remove_repeated_words(table(spark, corpus)), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(corpus)
    assert by_id(repeats.remove_repeated_words(table(spark, corpus), 5, 2), "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(corpus, 5)


def test_substring_dedup_text(spark):
    docs = [(1, "a b c d e f"), (2, "x a b c d e y")]
    assert by_id(repeats.remove_repeated_words(table(spark, docs), 4, 2, with_text=True), "kept_text") == {1: ("a b c d e f",), 2: ("x y",)}


@pytest.mark.parametrize("size", [200, 40])
def test_suffix_array_dedup(spark, corpus, size):
    got = by_id(suffixes.remove_repeated_bytes(table(spark, corpus), size, min(32, size // 3)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.byte_dedup(corpus, size)


def test_suffixes_sort_by_content():
    rng = np.random.default_rng(7)
    for size in (8, 13, 40):
        raw = rng.choice(np.frombuffer(b"ab\0\xff", np.uint8), 3000, p=[0.6, 0.3, 0.05, 0.05])
        raw[1000:1500] = raw[:500]
        start = np.arange(len(raw) - size)
        words, at = suffixes.words_at(raw), suffixes.word_places(size)
        place = suffixes.sorted_places(len(start), lambda d, rows: words[start[rows] + at[d]], len(at))
        text = raw.tobytes()
        strings = [text[i : i + size] for i in start.tolist()]
        first = {}
        for i, x in enumerate(sorted(strings)):
            first.setdefault(x, i)
        assert place.tolist() == [first[x] for x in strings]


@pytest.mark.parametrize("share", [1, 300])
def test_suffixes_across_shares_and_ranges(spark, monkeypatch, share):
    """Copies that differ in places, in shares of a few runs: ranges meet what shares have left open."""
    monkeypatch.setattr(repeats, "SHARE_RUNS", share)
    rng, docs = random.Random(9), []
    base = "".join(rng.choice("abcdef \n") for _ in range(400))
    for d in range(60):
        text = list(base[rng.randrange(150) : 400 - rng.randrange(150)])
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice("xyzé")
        docs.append((d, "".join(text)))
    got = by_id(suffixes.remove_repeated_bytes(table(spark, docs), 50, 10), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.byte_dedup(docs, 50)


def test_quality_statistics(spark, corpus):
    got = by_id(quality_rules.digest(table(spark, corpus), labels(spark, corpus)), *quality_rules.BASE, "base_failed")
    assert got == {d: brute.statistics(t) for d, t in corpus}


def test_quality_rules_learn_and_filter(spark, corpus):
    docs, marks = table(spark, corpus), labels(spark, corpus)
    kept = {d for d, (k,) in by_id(quality_rules.digest(docs, marks), "kept").items() if k}
    assert kept and not any(brute.statistics(dict(corpus)[d])[-1] for d in kept)
    left = quality_rules.keep_good(docs, marks)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == kept


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 2))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3) | (rng.random(3000) < 0.05)).astype(float)
    trees = quality_rules.grow(x, y, [-1, 0])
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.93
    line = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.6)])
    assert (np.diff(trees.score(line)) <= 1e-12).all()


@pytest.mark.parametrize(("edits", "min_chars"), [(1, 30), (2, 24), (0, 30)])
def test_line_dedup(spark, corpus, edits, min_chars):
    got = by_id(line_dedup.digest(table(spark, corpus), edits, min_chars), "n_lines", "n_exact", "n_near", "removed_lines")
    assert got == brute.line_dedup(corpus, edits, min_chars)
    assert edits == 0 or sum(x[2] for x in got.values()) > 3


def test_line_dedup_random_edits(spark):
    rng, base = random.Random(5), "the quick brown fox jumps over the lazy dog again"
    docs = []
    for d in range(150):
        line = list(base if d % 3 else base[::-1])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(line))
            line[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
        docs.append((d, "".join(line)))
    for edits in (1, 2, 3):
        assert by_id(line_dedup.digest(table(spark, docs), edits), "n_lines", "n_exact", "n_near", "removed_lines") == brute.line_dedup(docs, edits, 30)


@pytest.mark.parametrize(("edits", "min_chars", "n"), [(5, 24, 28), (1, 3, 9), (2, 0, 5), (3, 10, 17)])
def test_line_dedup_in_every_band_and_length(spark, edits, min_chars, n):
    """Lines whose bands are more than two, and lines shorter than two bands."""
    rng, docs = random.Random(edits), []
    for d in range(120):
        line = [rng.choice("abcdefgh") for _ in range(rng.randint(max(0, n - 3), n + 3))] if d % 4 == 0 else list(docs[d - d % 4][1])
        for _ in range(edits if d % 4 else 0):
            at = rng.randrange(len(line) + 1)
            line[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
        docs.append((d, "".join(line)))
    got = by_id(line_dedup.digest(table(spark, docs), edits, min_chars), "n_lines", "n_exact", "n_near", "removed_lines")
    assert got == brute.line_dedup(docs, edits, min_chars)
    assert sum(x[2] for x in got.values()) > 10


@pytest.mark.parametrize(("n", "size"), [(31, 250), (120, 60)])
def test_line_dedup_in_a_large_group_of_near_copies(spark, n, size):
    """Many of lines that differ from one text at any place: settled without meeting pair by pair."""
    rng, docs = random.Random(n), []
    base = "".join(rng.choice("abcdefghij klm") for _ in range(n))
    for d in range(size):
        line = list(base)
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            at = rng.randrange(len(line) + 1)
            line[at : at + rng.randint(0, 1)] = rng.choice(["", "1", "2"])
        docs.append((d, "".join(line)))
    docs = docs[1:] + [(700, base)]  # the text itself comes last
    assert by_id(line_dedup.digest(table(spark, docs)), "n_lines", "n_exact", "n_near", "removed_lines") == brute.line_dedup(docs, 1, 30)
    rows = line_dedup.keyed_lines(line_dedup.lines_of(table(spark, docs)), 1, 30, 30).dropDuplicates(["k1", "k2"])
    assert line_dedup.one_edit_pairs(rows, table(spark, docs))[0].count() < 12 * len(docs)


def rows_cut(spark, since):
    """Rows that cutting keys made in executions from ``since`` on, each time a plan did it, and the next execution's number."""
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    store, made, following = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        if run >= since:
            following, values, nodes = max(following, run + 1), store.executionMetrics(run), store.planGraph(run).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                if node.name().startswith("Generate") and re.search(r"\bbefore\b", node.desc()):
                    metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                    made += sum(int(values.get(m.accumulatorId()).get().replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return made, following


def test_line_dedup_cuts_a_large_group_once(spark):
    """Numbered lines of one length: keys are cut for substitutions alone, once each, and twice the lines make twice the rows."""
    text, made, following = "request {:06d} was answered in time", {}, rows_cut(spark, 0)[1]
    for size in (100, 200):
        docs = [(d, text.format(d * 7919 % 1000000)) for d in range(size)] + [(size, text.format(7919 * 3 + 1))]
        got = by_id(line_dedup.digest(table(spark, docs)), "n_lines", "n_exact", "n_near", "removed_lines")
        assert got == brute.line_dedup(docs, 1, 30) and got[size][2] == 1
        made[size], following = rows_cut(spark, following)
        assert 0 < made[size] < 20 * size
    assert made[200] < 2.2 * made[100]


def test_first_halves_are_parts(spark):
    """What is written out for the first states is the general rule for two pieces."""
    n, zero = F.col("n"), F.lit(0)
    rows = spark.range(40).select(F.col("id").cast("int").alias("n"))
    halves = [F.when(there, F.concat_ws(",", *state)) for there, state in line_dedup._halves(n)]
    parts = [F.get(F.transform(line_dedup._parted(F.lit(kind), short, zero, zero, 2), lambda s: F.concat_ws(",", s.kind, s.short, s.before, s.after)), F.lit(half)) for kind, short in ((0, n), (1, n), (1, n - 1)) for half in (0, 1)]
    for row in rows.select(F.array(*halves).alias("a"), F.array(*parts).alias("b")).collect():
        assert row["a"] == row["b"]


def test_banded_distance(spark):
    rng, pairs = random.Random(6), []
    for _ in range(400):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "漢"])
        pairs.append((a, b))
    frame = spark.createDataFrame(pairs, "x array<string>, y array<string>")
    for edits in (1, 2, 5):
        got = frame.where(f"abs(size(x) - size(y)) <= {edits}").select("x", "y", line_dedup.banded_distance(frame["x"], frame["y"], edits).alias("d")).collect()
        assert len(got) > 100
        for r in got:
            near = [n for n in range(edits + 1) if brute.within(r["x"], r["y"], n)][:1]
            assert [r["d"]] == near if near else r["d"] > edits


def test_short_equal_lines_go_from_their_own_floor(spark):
    docs = table(spark, [(1, "All rights reserved.\n\nHome"), (2, "Text\nAll rights reserved.\n\nHome"), (3, "All rights reserved!")])
    assert by_id(line_dedup.digest(docs, exact_chars=1), "n_exact", "n_near", "removed_lines") == {1: (0, 0, ""), 2: (2, 0, "1,3"), 3: (0, 0, "")}
    assert by_id(line_dedup.remove_lines(docs, exact_chars=1), "text")[2] == ("Text\n",)


def test_removed_lines_leave_the_text(spark):
    line = "a line of more than thirty characters, said twice"
    docs = table(spark, [(1, f"{line}\nshort\n{line}"), (2, f"x\n{line[:-1]}\ny"), (3, None)])
    assert by_id(line_dedup.remove_lines(docs), "text") == {1: (f"{line}\nshort",), 2: ("x\ny",), 3: (None,)}
    assert line_dedup.remove_lines(docs).columns == docs.columns


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_near_duplicates(spark, corpus, k, percent):
    got = by_id(ngram_join.components(table(spark, corpus), k, percent), "n_shingles", "component_id")
    assert got == brute.near_components(corpus, k, percent)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Blocks of a few documents: the chain and the meeting with the rest find every link."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 4)
    rng, base = random.Random(3), [f"w{i}" for i in range(60)]
    docs = []
    for d in range(70):
        words = list(base[: rng.randint(45, 60)])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        docs.append((d, " ".join(words)))
    assert by_id(ngram_join.components(table(spark, docs)), "n_shingles", "component_id") == brute.near_components(docs)


def test_first_of_each_component_stays(spark):
    docs = table(spark, [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words are here now"), (4, None), (None, "a b c d e f g")])
    assert sorted(r["doc_id"] for r in ngram_join.keep_first(docs).collect()) == [1, 2, 4]


def test_documents_below_their_need_connect_others():
    """X is in one share, L and Y in the next: L stands for the signature of Y and X, and cannot link itself."""
    x, low, y = 1, 2, 3
    need = {x: 1, low: 5, y: 1}
    for root in (low, 0):  # the centre of Y in its share is L, or a document with which L shares another signature
        edges = [(y, root), (low, x)] + [(low, root)] * (root != low)
        told = [(x, 1), (low, 2), (y, 1), (0, 1)] + [(d, -n) for d, n in (need | {0: 5}).items()]
        parts = zip(*[np.array(edges, np.int64).T, np.zeros((2, 0), np.int64)])
        a, b = (np.concatenate(p) for p in parts)
        doc, n = np.array(told, np.int64).T
        rows = [(0, ngram_join.EDGES, raw) for _, raw in ngram_join.EDGE.split({"a": a, "b": b}, np.zeros(len(a), np.int64))]
        rows += [(0, ngram_join.NEEDS, raw) for _, raw in ngram_join.NEED.split({"doc": doc, "n": n}, np.zeros(len(doc), np.int64))]
        got = ngram_join._different(ngram_join.pa.Table.from_batches([ngram_join._rows(rows)]))
        pairs = set(zip(got.column("a").to_pylist(), got.column("b").to_pylist()))
        assert {p for p in pairs if p[0] != p[1]} == set(edges)
        assert {p[0] for p in pairs if p[0] == p[1]} == {x, y}


@pytest.mark.parametrize("share", [1, 300])
def test_links_across_shares(spark, monkeypatch, share):
    """Short near copies in shares of a few signatures each: shares meet only through their first documents."""
    monkeypatch.setattr(ngram_join, "SHARE_SIGNATURES", share)
    rng, docs = random.Random(8), []
    for d in range(240):
        words = [f"w{d % 40}x{i}" for i in range(6 + d % 40 % 12)]
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.choice([0, len(words)]), f"y{rng.randint(0, 3)}")
        docs.append((d, " ".join(words)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = by_id(ngram_join.components(table(spark, docs), 2, 60), "n_shingles", "component_id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute.near_components(docs, 2, 60)


@pytest.mark.parametrize("limits", [(1 << 20, 16), (7, 0), (50, 1000)])
def test_products_count_every_overlap(monkeypatch, limits):
    """In chunks of any size, with and without a dense panel, on one side or between two."""
    monkeypatch.setattr(ngram_join, "PRODUCT_ENTRIES", limits[0])
    monkeypatch.setattr(ngram_join, "DENSE_FROM", limits[1])
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < rng.choice([0.2, 0.9, 0.97])], rng.integers(0, 200, rng.integers(1, 6), dtype=np.uint64)])) for _ in range(60)]
    for left, right in ((list(range(60)), list(range(60))), (list(range(0, 60, 3)), list(range(1, 60, 2)))):
        for percent in (50, 85):
            got = {(x, y) for x, y in zip(*ngram_join._product(sets, left, right, percent)) if x != y}
            want = {(x, y) for x in left for y in right if x != y and 100 * len(both := np.intersect1d(sets[x], sets[y])) >= percent * (len(sets[x]) + len(sets[y]) - len(both))}
            assert got == want and want


def test_signatures_lose_no_link():
    rng = np.random.default_rng(2)
    for percent in (50, 80, 85):
        for n in (1, 2, 5, 9, 40, 300):
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                b = a.copy()
                while True:  # take away and add until just linked
                    c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.append(b, rng.integers(0, 1 << 63, 1, dtype=np.uint64))
                    both = len(np.intersect1d(a, c))
                    if 100 * both < percent * (len(a) + len(c) - both):
                        break
                    b = c
                s, r, need = ngram_join.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), ngram_join.Families(percent))
                assert len(set(s[r == 0]) & set(s[r == 1])) >= max(need) >= 1, (percent, n)


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(4)
    good, bad = [[f"{p}{rng.choice('abcdefg')}{rng.choice('abcdefg')}" for _ in range(60)] for p in ("go", "ba")]
    docs = [(d, " ".join(rng.choice(good if d % 2 else bad) for _ in range(40))) for d in range(400)]
    marks = spark.createDataFrame([(d, d % 2, 0) for d, _ in docs], LABELS)
    rows = quality_classifier.digest(table(spark, docs), marks).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["predicted"] == r["doc_id"] % 2 for r in held) / len(held) > 0.95


def test_contamination(spark, corpus):
    words = dict(corpus)[127].split()
    items = [(1, " ".join(words[100:140])), (2, "one"), (10, dict(corpus)[20]), (11, None), (12, "…!"), (3, " ".join(words[105:118]).upper()), (3, "again")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], BENCHMARK)
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contamination(corpus, items)
    assert by_id(decontaminate.digest(table(spark, corpus), bench), *columns) == want
    blocks = decontaminate.judged(decontaminate.contamination(table(spark, corpus), bench, block_bytes=300))
    assert {d: x[:2] for d, x in by_id(blocks, "n_words", "n_hit").items()} == {d: x[:2] for d, x in want.items()}
    left = decontaminate.drop_contaminated(table(spark, corpus), bench)
    assert {r["doc_id"] for r in left.collect()} == {d for d, x in want.items() if not x[-1]} and left.columns == table(spark, corpus).columns


@pytest.mark.parametrize("limit", [1 << 20, 3000, 400, 1])
def test_sharding(spark, corpus, limit, tmp_path):
    sizes = {d: len((t or "").encode()) for d, t in corpus}
    got = by_id(sharding.assign(table(spark, corpus), limit), "shard", "depth", "shard_bytes")
    want = brute.shards(sizes, limit)
    assert got == want
    if limit == 3000:
        sharding.write_shards(table(spark, corpus).drop("bucket"), str(tmp_path / "shards"), limit)
        assert spark.read.parquet(str(tmp_path / "shards")).count() == len(corpus)


def test_sharding_splits_to_the_last_differing_bit(spark):
    """Hashes of 469 and 676 first differ at bit 20."""
    docs = table(spark, [(469, "x" * 600_000), (676, "y" * 600_000), (1, "z" * 1_200_000), (2, "a")])
    got = by_id(sharding.assign(docs), "shard", "depth", "shard_bytes")
    assert got == brute.shards({469: 600_000, 676: 600_000, 1: 1_200_000, 2: 1}, 1 << 20)
    assert got[469][1:] == (20, 600_000) and got[1][1] == sharding.HASH_BITS


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, corpus, encoding, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = [*corpus, (500, "a\x1cb \x1d It's İSTANBUL. ΑΣ! <|endoftext|> é. x́. n't!!")]
    token_files.write(token_files.encode(table(spark, docs), path, 2), str(tmp_path / "t"), encoding)
    got = by_id(token_files.checksums(token_files.read(spark, str(tmp_path / "t"))), "start", "n_tokens", "ids_crc32")
    tokenizer, at, want = Tokenizer.from_file(path), 0, {}
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_byte_level_bpe(spark, corpus):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = [*corpus, (500, "aaaa aaaaaaa  \n\n ''s 😀漢字 <|endoftext|> 12345")]
    got = by_id(bpe.digest(table(spark, docs), path, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    want = {}
    for d, text in docs:
        ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
        want[d] = (len(ids), brute.sha(ids.tobytes()), brute.sha(text or ""))
    assert got == want


def test_bpe_round_trip(spark, corpus):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = by_id(bpe.decode(bpe.encode(table(spark, corpus), path, public_tokenizers.PATTERN), path), "decoded")
    assert {d: bytes(x[0]) for d, x in back.items()} == {d: (t or "").encode() for d, t in corpus}


def test_replay_of_a_rank_that_falls():
    """A vocabulary where a merge brings up a lower rank beside a waiting pair of the same rank."""
    tokens = [bytes([i]) for i in range(256)] + [b"baba", b"xba", b"ab", b"ba", b"aba", b"bab"]
    ranks = bpe.Ranks({t: i for i, t in enumerate(tokens)})
    pieces = [p.encode() for p in ("xbaba", "xbabab", "babab", "ababab", "xbaxba", "aaaa", "b")]
    assert [r.tolist() for r in ranks.replay(pieces)] == [ranks.alone(p) for p in pieces]


def test_gram_and_span_hashes_follow_content():
    rng = np.random.default_rng(3)
    s = K.mix(rng.integers(0, 5, 300).astype(np.uint64))
    for k in (1, 2, 3, 5, 6, 13, 32):
        h = K.gram_hashes(s, k)
        seen: dict = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(tuple(s[i : i + k].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)
    a = K.span_hashes(np.concatenate([s, s]), np.array([10, 310]), np.array([60, 360]))
    assert a[0] == a[1]
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
