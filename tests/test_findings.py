"""Cases of the findings: keys and groups that the small tables do not have."""

from __future__ import annotations

from corvane.plans import catalog
from tests.harness import assert_same, connection


def test_run_mask_map_with_large_keys(spark, tmp_path):
    rows = [(1, 250001, 1, "A"), (1, 4, 2, "A"), (2, 100000, 1, "R"), (2, 1, 2, "R"), (2, 1200001, 7, "N"), (3, 9, 1, "N"), (3, 1000001, 2, "N"), (3, 2, 3, "N"), (4, 7, None, "A"), (4, 2, 3, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert_same(catalog.QUERIES["run_mask_map"](spark, str(tmp_path)), connection(str(tmp_path)), catalog.ORACLE["run_mask_map"])


def test_batches_are_taken_in_pieces():
    import pyarrow as pa

    from corvane.functions.batches import PIECE_BYTES, cuts, mapped

    texts = pa.array(["x" * 1000] * 5000 + [None, "y" * (3 * PIECE_BYTES), ""])
    ranges = list(cuts(texts))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(texts) and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    assert all(sum(len(t or "") for t in texts[a:b].to_pylist()[1:]) <= PIECE_BYTES for a, b in ranges)
    seen = []
    made = mapped(pa.int64(), lambda own: seen.append(len(own)) or [None if t is None else len(t) for t in own], texts)
    assert made.to_pylist() == [None if t is None else len(t) for t in texts.to_pylist()] and len(seen) > 5
    assert mapped(pa.string(), lambda own: own, pa.array([], pa.string())).to_pylist() == []
    runs = pa.array([["a"] * 20000] * 10 + [None, []])
    assert mapped(pa.list_(pa.string()), lambda own: own, runs).to_pylist() == runs.to_pylist() and len(list(cuts(runs))) > 5


def test_sweep_sends_the_first_alias_of_each_entity(spark):
    """One alias of many entities is met once for each occurrence, and blocks agree."""
    from corvane.operators import automaton

    docs = spark.createDataFrame([(1, "alpha Beta alpha beta\n gamma"), (2, None), (3, "beta"), (4, "none")], "doc_id long, text string")
    aliases = spark.createDataFrame([(e, e * 10 + k, s) for e in range(6) for k, s in enumerate(("gamma", "beta", "alpha", "BETA"))] + [(7, 1, " beta  ")], "entity_id int, alias_id long, surface string")
    want = sorted([(1, e, "gamma") for e in range(6)] + [(3, e, "beta") for e in range(6)] + [(1, 7, "beta"), (3, 7, "beta")])
    for size in (1 << 20, 60):
        found = automaton.sweep(docs, aliases, block_bytes=size)
        assert found.dtypes == [("doc_id", "bigint"), ("entity_id", "int"), ("surface", "string")]
        assert sorted(tuple(r) for r in found.collect()) == want


def test_normalized_is_the_same_inside_and_outside_python(spark):
    from corvane.functions import patterns

    texts = [" Ab  c ", "\t\x1cA-b\x1f c.\n", "x\n", "É'té", "a b", "A@b_c.d-e", "", "!?", "\x0b \x1d", "İstanbul", "KK", "a\x1d\x1eb,c", "\x7f[z]", "ﬁ", None, "plain", "O'Neil\r\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(1)
    both = patterns.with_key(rows, "text").withColumn("python", patterns.normalized("text")).collect()
    assert len(both) == len(texts) and [(r["text"], r["key"]) for r in both] == [(r["text"], r["python"]) for r in both]


def _shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_reviews_shuffle_words_once(spark, tmp_path):
    from corvane.plans import governance

    words = "Alpha alpha beta Gamma gamma GAMMA delta, delta one é été Été longer Longer"
    spark.createDataFrame([(1, words), (1, words), (2, words + "\nmore words"), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = connection(str(tmp_path))
    for name, most in (("review_removals", 2), ("review_additions", 2)):
        assert_same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLE[name])
        assert _shuffles(getattr(governance, name)(spark, str(tmp_path))) <= most


def test_packages_are_opened_once(spark, small):
    """The chunks' plan reads parts that were written, and does not open the packages again for each kind of chunk."""
    plan = catalog.QUERIES["package_chunks"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "supplier" not in plan


def test_masked_outputs_share_files(spark, tmp_path):
    import glob

    from corvane.sources import masked

    path = f"file://{tmp_path}/out"
    masked.write_outputs(spark.range(500).selectExpr("id as run_id", "concat('{\"filename\": \"f', id, '\"}') as body").coalesce(2), path)
    assert len(glob.glob(f"{tmp_path}/out/**/part-*", recursive=True)) <= 4
    assert masked.outputs(spark, path).where("filename = concat('f', run_id)").count() == 500


def test_wide_limits_compare_blocks(spark, monkeypatch):
    """Where parts tell little, no hash is probed; several blocks, hashes above 2^63 and equal ones give what the parts give."""
    import random

    from corvane.operators import similarity

    rng = random.Random(3)
    some = [rng.getrandbits(64) for _ in range(40)]
    rows = [(i, f"{h ^ sum(1 << rng.randrange(64) for _ in range(6)) & (2**64 - 1):016x}") for i, h in enumerate(some * 4)] + [(500, "f" * 16), (501, "F" * 16), (502, "bad"), (503, None)]
    frame = spark.createDataFrame(rows, "key long, phash string")
    want = {(r["phash"], r["ref_phash"], r["distance"]) for r in similarity.near_hashes(frame, frame, 15, banded=True).collect()}
    monkeypatch.setattr(similarity, "BLOCK", 50)
    monkeypatch.setattr(similarity, "_met", None)
    found = similarity.near_hashes(frame, frame, 15).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
