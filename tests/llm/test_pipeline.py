from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from corvane.llm import queries
from tests.llm import brute


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns, name
        rows, before = [(r["doc_id"], r["text"]) for r in docs.collect()], rows
        seen.append((name, before, rows))
    good = dict(seen[0][2])
    assert all(not brute.statistics(t)[-1] for t in good.values()) and set(good) <= set(dict(seen[0][1]))
    removed = brute.line_dedup(seen[1][1], 1, 30)
    for d, text in seen[1][1]:
        gone = {int(i) for i in removed[d][3].split(",") if i}
        assert dict(seen[1][2])[d] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    near = brute.near_components(seen[2][1], 5, 80)
    assert set(dict(seen[2][2])) == {d for d, (_, c) in near.items() if c == d}
    dirty = brute.contamination(seen[3][1], items)
    assert set(dict(seen[3][2])) == {d for d, x in dirty.items() if not x[-1]}
    last = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in last} == set(dict(seen[3][2]))
    assert {r["decoded_sha256"] for r in last} == {brute.sha(t) for _, t in seen[3][2]}


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert public_tokenizers.PATTERN
