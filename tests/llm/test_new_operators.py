"""Ranked search, conversation repair and fingerprints against plain restatements; hashes against texts made to collide."""

from __future__ import annotations

import pathlib
import random
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import conversation_repair, decontaminate, lexical_search, ngram_join, quality_rules, repeats, sharding, simhash, suffixes
from corvane.llm import kernels as K
from tests.llm import brute
from tests.llm.conftest import by_id, table

ITEMS = "item_id long, text string, doc_id int, term string, rank int, score int"
TURNS = "conv_id long, turn long, role string, text string, gone int, copy int, fault string"
ODD = [(None, None), (None, "a b c"), (5, None), (6, ""), (7, " \n "), (8, "same words here"), (8, "same words here"), (9, "same words here")]


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 1, 1) for i, t in rows], ITEMS)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("k,block", [(50, 4 << 20), (3, 400)])
def test_lexical_search(spark, corpus, k, block):
    docs = dict(corpus)
    rows = [(i, docs[d][: 20 * i]) for i, d in enumerate(range(20, 60, 4), 1)] + [(99, "THE of and. #1"), (100, None), (101, "nowhere-else"), (102, ""), (99, "one more é"), (None, "the one")]
    want = {i: x for i, x in brute.lexical_search(corpus, rows, k).items() if x}
    assert found(lexical_search.ranked(table(spark, corpus), items(spark, rows), k, block)) == want


def test_lexical_search_odd_rows(spark):
    asked = [(1, "Same C nothing"), (2, None)]
    want = {i: x for i, x in brute.lexical_search(ODD, asked).items() if x}
    assert found(lexical_search.ranked(table(spark, ODD), items(spark, asked))) == want
    assert lexical_search.ranked(table(spark, ODD), items(spark, [])).collect() == []
    assert lexical_search.ranked(table(spark, [(1, "x")]).limit(0), items(spark, asked)).collect() == []


def test_index_holds_every_term_in_its_bucket(spark, corpus):
    rows = lexical_search.index(table(spark, corpus)).where(F.col("term") != lexical_search.WHOLE).collect()
    want = {(d, t): n for d, text in corpus for t, n in brute.Counter(brute.re.findall(brute.PLAIN, (text or "").translate(brute.LOWER))).items()}
    assert {(r["doc_id"], r["term"]): r["tf"] for r in rows} == want and len(rows) == len(want)
    buckets = {}
    assert all(buckets.setdefault(r["term"], r["bucket"]) == r["bucket"] for r in rows)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 5, 7, "x") for r in rows], TURNS)


def some_turns(rng):
    rows = []
    for conv in range(160):
        said = [f"Text {rng.randrange(6)}{rng.choice(['.', '!', '? ', '', '.,', ' '])}" for _ in range(4)] + ["", " \t", "…", "é?"]
        for turn in range(rng.randrange(1, 9)):
            number = rng.choice([turn, turn, turn, turn + 3, None, -turn])
            rows.append((conv, number, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Sys", None]), rng.choice([*said, None])))
    return rows + [(None, 1, "user", "No id."), (None, None, "assistant", None), (999, 0, "system", "x")] + [(500, t, ("user", "assistant")[t % 2], f"{t // 3}.") for t in range(300)]


def test_conversation_repair(spark):
    rows = some_turns(random.Random(3))
    df = conversation_repair.digest(conversation_repair.damage(conversations(spark, rows)))
    got = {r["conv_id"]: tuple(r)[1:] for r in df.collect()}
    assert got == brute.conversation_repair(rows) and len(got) == df.count()
    assert conversation_repair.digest(conversation_repair.damage(conversations(spark, []))).collect() == []


def test_conversation_repair_returns_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Yes"), (2, 0, "assistant", "Alone."), (3, 0, "user", "")]
    out = conversation_repair.repair(conversation_repair.turns(conversations(spark, rows))).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in out] == [
        (1, 0, "K", "system", "Be brief."), (1, 1, "K", "user", "Hi."), (1, 2, "R", "assistant", "Yes"), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Alone."),
    ]


def fingerprints(df):
    return {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect()}


def test_fingerprints(spark, corpus):
    df = simhash.digest(table(spark, corpus))
    assert fingerprints(df) == brute.fingerprints(corpus) and df.count() == len(corpus)


def test_fingerprints_odd_rows(spark):
    rows = simhash.digest(table(spark, ODD)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, _ in ODD)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (8, 9)}) == 1
    assert simhash.digest(table(spark, [(1, "x")]).limit(0)).collect() == []
    (alone,) = simhash.digest(table(spark, [(1, "x y")])).collect()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == brute.sha("x x")
    many = [(i % 7, f"{i} w{i * i} some words that stand here") for i in range(60)]  # few ids in many ranges
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert len(simhash.digest(table(spark, many)).collect()) == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fingerprints_tell_edits_from_others(spark, corpus):
    rows = [r for r in simhash.digest(table(spark, corpus)).collect() if r["n_chars"] > 300]
    apart = [r["near_edited"] > r["near_next"] or r["near_next"] > 0.6 for r in rows]
    assert sum(apart) >= 0.97 * len(rows)


@pytest.mark.parametrize("radius", [0, 3, 20])
def test_search_finds_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    own = [rng.getrandbits(256) for _ in range(40)]
    near = [x ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(0, 30))) for x in own for _ in range(5)]
    prints = [x.to_bytes(32, "little").hex() for x in own + near]
    frame = spark.createDataFrame([(p, 1) for p in prints] + [(None, 1)], "fingerprint string, differ int")
    queries = frame.limit(20)
    got = {(r["query"], r["found"]): r["differ"] for r in simhash.within(queries, frame, radius).collect()}
    differ = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    asked = [r["fingerprint"] for r in queries.collect()]
    assert got == {(q, p): differ(q, p) for q in asked for p in prints if differ(q, p) <= radius}
    with pytest.raises(ValueError):
        simhash.within(frame, frame, 64)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_made_to_collide(spark, n):
    """A word and its complement are equal under any polynomial modulo 2**64."""
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + other).encode(), np.uint8)
    assert len(set(K.word_hashes(data, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    start = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{start} {word}"), (2, f"{start} {other}"), (3, word), (4, other), (5, f"{word} x\n{other} x\n{word} x")]
    frame = table(spark, docs)
    assert by_id(repeats.remove_repeated_words(frame), "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(docs)
    assert by_id(ngram_join.components(frame), "n_shingles", "component_id") == brute.near_components(docs)
    raw = docs[4][1].encode()
    assert quality_rules.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))["n_dup_lines"].tolist() == [1]


def templates(rng, n, own=20, common=80):
    """Documents of one template: most words in common, too many of their own to link."""
    shared = [f"t{i}" for i in range(common)]
    return [" ".join(shared[:40] + [f"u{rng.randrange(10**9)}" for _ in range(own)] + shared[40:]) for _ in range(n)]


def test_templates_do_not_meet_in_pairs(spark, monkeypatch):
    """Cells of products and verified pairs for each document stay as they are when a group of unlinked sets doubles."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 16)
    verify, cells = ngram_join._verified_pairs, {}

    def counted(pairs, grams, percent):
        cells[n] = cells.get(n, 0) + pairs.count()
        return verify(pairs, grams, percent)

    monkeypatch.setattr(ngram_join, "_verified_pairs", counted)
    rng = random.Random(8)
    # One signature less than a link needs, and a shared one, bring all of a template into one candidate group.
    monkeypatch.setattr(ngram_join, "candidate_groups", lambda texts, k, percent, slots: texts.selectExpr("doc_id as node", "min(doc_id) over () as component"))
    for n in (120, 240):
        docs = list(enumerate(templates(rng, n)))
        assert by_id(ngram_join.components(table(spark, docs)), "n_shingles", "component_id") == brute.near_components(docs)
    assert cells[240] <= 2 * 1.3 * max(cells[120], 12)


def test_many_small_clusters_in_one_group(spark, monkeypatch):
    """A candidate group with no main component: every link between clusters and within them is found."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    monkeypatch.setattr(ngram_join, "candidate_groups", lambda texts, k, percent, slots: texts.selectExpr("doc_id as node", "min(doc_id) over () as component"))
    rng, docs = random.Random(2), []
    for text in templates(rng, 25):
        words = text.split(" ")
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            docs.append(" ".join(copy[: rng.randint(90, 100)]))
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    for k, percent in ((4, 85), (5, 80), (3, 60)):
        assert by_id(ngram_join.components(table(spark, rows), k, percent), "n_shingles", "component_id") == brute.near_components(rows, k, percent)


def test_disk_of_near_duplicates(spark, monkeypatch):
    """Sets of unrelated texts and of copies are neither sent nor written, and shuffle files go once they are read."""
    rng, docs = random.Random(12), []
    prose = [[f"w{rng.randrange(10**6)}" for _ in range(2000)] for _ in range(60)]
    for words in prose[:40] + prose[40:44] * 30 + prose[44:]:
        docs.append(" ".join(words))
    for words in prose[44:48]:  # near copies
        docs.append(" ".join([*words[:-3], "and", "other", "words"]))
    rng.shuffle(docs)  # copies are in different tasks
    rows = list(enumerate(docs))
    folders = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p: p.stat().st_size for f in folders for p in pathlib.Path(f).rglob("shuffle_*.data")}
    before, tables, peaks, sent = shuffled(), [], [], []
    write = ngram_join.materialize

    def watched(df, name):
        out = write(df, name)
        tables.append(sum(pathlib.Path(urlparse(f).path).stat().st_size for f in out.inputFiles()))
        peaks.append(sum(size for p, size in shuffled().items() if p not in before) + sum(tables))
        sent.extend(r["doc_id"] for r in out.collect() if name == "tasks")
        return out

    monkeypatch.setattr(ngram_join, "materialize", watched)
    got = by_id(ngram_join.components(table(spark, rows)), "n_shingles", "component_id")
    assert got == brute.near_components(rows)
    assert {tuple(docs[d].split(" ")[:9]) for d in sent} == {tuple(words[:9]) for words in prose[44:48]} and len(sent) == 8
    assert sum(tables) < 4 * 16_000  # of the sets, which take 16 kB each, none
    assert max(peaks) < sum(len(t) for t in docs) / 4
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_the_largest_id_is_no_null(spark):
    """A document with the largest id and one without are different documents, each with its own verdict."""
    last, rng = (1 << 63) - 1, random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = prose(60)
    docs = [(1, passage), (last, f"{prose(5)} {passage} more of it"), (None, prose(30)), (2, prose(20))]
    frame = table(spark, docs)
    want = brute.substring_dedup([(1, docs[0][1]), (2, docs[3][1]), (3, docs[1][1]), (4, docs[2][1])])
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeated_words(frame).collect()}
    assert got == {1: want[1], 2: want[2], last: want[3], None: want[4]}
    assert {r["doc_id"] for r in suffixes.remove_repeated_bytes(frame).collect()} == {1, 2, last, None}
    same = table(spark, [(last, passage), (None, passage), (5, prose(30))])
    assert sorted(str(r["doc_id"]) for r in ngram_join.keep_first(same).collect()) == sorted(["5", str(last)])


def test_shards_keep_columns_whatever_their_names(spark, tmp_path):
    docs = spark.createDataFrame([(d, f"text {d}", d % 3, f"h{d}", d, 1, 2) for d in range(20)], "doc_id long, text string, Shard int, _h string, bucket int, h int, prefix int")
    name = sharding.write_shards(docs, str(tmp_path / "shards"), 40)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert name == "shard_" and set(back.columns) == {*docs.columns, name}
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert back.select(name).distinct().count() > 2


def test_benchmark_windows_stay_small():
    """Eight megabytes of items take a few bytes for each byte of text, and every window is there."""
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(5000)]
    items = [(str(i), " ".join(words[j] for j in rng.integers(0, 5000, 1400))) for i in range(1000)]
    windows = decontaminate.Windows(items, 13)
    size = len(windows.raw) + windows.starts.nbytes + windows.ends.nbytes + sum(a.nbytes for arrays in windows.by_width.values() for a in arrays)
    text = sum(len(t) for _, t in items)
    assert text > 8_000_000 and size < 6 * text
    keys, places, of = windows.by_width[13]
    assert len(keys) == sum(len(t.split()) - 12 for _, t in items) and (np.diff(keys.astype(object)) >= 0).all()
    place = int(places[123])
    assert " ".join(w.decode() for w in windows.said(place, 13)) in items[of[123]][1]


def test_contamination_beyond_one_block(spark, corpus):
    """A benchmark that stays a table gives what a broadcast one gives: hits, items and verdicts."""
    docs = dict(corpus)
    items = [(i, " ".join(docs[d].split()[3 : 3 + 9 * i])) for i, d in enumerate(range(20, 60, 3), 1)] + [(99, "one"), (98, ""), (97, None), (None, "x"), (1, docs[60]), (2, "Same words")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    rows = lambda size: sorted(((r["doc_id"], r["n_words"], tuple(map(tuple, r["hits"])), tuple(r["items"])) for r in decontaminate.contamination(table(spark, corpus + [(7, docs[20])]), bench, block_bytes=size).collect()), key=str)
    assert rows(100) == rows(1 << 20) and len(rows(100)) == len(corpus) + 1
    clean = decontaminate.drop_contaminated(table(spark, corpus), bench)
    assert clean.columns == table(spark, corpus).columns


@pytest.mark.parametrize("hot", [2, 8])
def test_hot_anchors(spark, corpus, monkeypatch, hot):
    """A passage too short to be a repeat, and one just long enough, in many documents with other surroundings; all results as by brute force."""
    monkeypatch.setattr(repeats, "HOT_SPANS", hot)
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8)))
    short, long = " ".join(word() for _ in range(20))[:121], " ".join(word() for _ in range(60))[:207]
    docs = [(d, " ".join(word() for _ in range(rng.randint(5, 40))) + rng.choice([short, long, " ".join(short.split()[:13])]) + " ".join(word() for _ in range(rng.randint(5, 40)))) for d in range(90)]
    docs += [(200 + d, t) for d, t in docs[:5]] + [(300 + d, t) for d, t in corpus if d < 12]
    frame = table(spark, docs).repartition(5)
    assert by_id(suffixes.remove_repeated_bytes(frame), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.byte_dedup(docs)
    assert by_id(repeats.remove_repeated_words(frame), "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(docs)


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_no_bucket_holds_all_surroundings_of_a_passage(kind):
    """One passage in thousands of documents: neither its runs nor its ends gather in one bucket."""
    rng = np.random.default_rng(4)
    word = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    passage = word(18)[:121]
    texts = [f"{word(40)} {passage} {word(40)}" for _ in range(3000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    if kind == "words":
        r = repeats.Repeats(13, 5, True, repeats.word_symbols, 8)
        ends = repeats.Ends(r)
    else:
        symbols, bounds = suffixes.byte_symbols(data, offsets)
        w = K.winnow(symbols, bounds, 200, 32)
        key = np.sort(suffixes.leading(data, bounds[:-1][w["doc"]] + w["at"], 16))
        r = suffixes.Suffixes(200, 32, 8, key[(np.arange(1, 16) * len(key)) // 16])
        ends = suffixes.SuffixEnds(r)

    def sizes(rows, kinds):
        out: dict[int, int] = {}
        for slot, k, payload in rows:
            if k in kinds:
                out[slot] = out.get(slot, 0) + len(payload)
        return list(out.values())

    rows = lambda batches: [x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("slot", "kind", "payload")))]
    seeds = rows(r.seeds(iter([batch])))
    sent = sizes(seeds, {repeats.SEEDS})
    by_slot: dict[int, list] = {}
    for slot, k, payload in seeds:
        by_slot.setdefault(slot, []).append((slot, k, payload))
    extended = [x for own in by_slot.values() for x in rows(r.extend(pa.Table.from_batches([repeats._batch(own)])).to_batches())]
    records = [repeats.END.unpack(p) for _, k, p in extended if k == repeats.ENDS]
    own = {name: np.concatenate([x[name] for x in records]) for name in records[0]}
    payloads = {d: repeats.END.pack(own, own["doc"] == d) for d in set(own["doc"].tolist())}
    some = sorted(payloads)
    cut = pa.RecordBatch.from_arrays([pa.array(some), pa.array([texts[d] for d in some]), pa.array([payloads[d] for d in some])], names=["doc_id", "text", "payload"])
    ended = sizes(rows(ends.cut(iter([cut]))), {repeats.TEXT_ENDS, repeats.WINDOW_ENDS})
    assert len(some) > 1500
    for found in (sent, ended):
        assert max(found) < 2.5 * np.mean(found)
