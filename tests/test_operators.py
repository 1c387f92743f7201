from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import patterns
from corvane.operators import channels, detect, governance, lifecycle, similarity, spans
from corvane.operators.components import connected_components
from corvane.sources import packages


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("surface", "text", "hit"), [("NorthCare", "NorthCare_logo", True), ("NorthCare", "northcare_logo.png", True), ("QTZ", "QTZ Group | Lima", True), ("RIA", "MATERIAL", False), ("Oak Capital", "Oak\nCapital programs", True), ("Caf", "Café", True), ("a.b", "axb", False)])
def test_surface_boundary(spark, surface, text, hit):
    assert one(spark, F.col("t").rlike(patterns.surface_regex(surface)), t=text) is hit


def test_claim_is_longest_first_not_leftmost(spark):
    dictionary = [("Bank of", "[A]"), ("of America Corp", "[B]")]
    assert one(spark, spans.masked(F.col("t"), dictionary), t="Bank of America Corp") == "Bank [B]"


def test_masking_does_not_cascade_but_substitution_does(spark):
    dictionary = [("Acme Corp", "[CLIENT_1]"), ("client", "[CLIENT_2]")]
    assert one(spark, spans.masked(F.col("t"), dictionary), t="Acme Corp") == "[CLIENT_1]"
    assert one(spark, spans.substituted(F.col("t"), dictionary), t="Acme Corp") == "[[CLIENT_2]_1]"


@pytest.mark.parametrize(("style", "want"), [("token", "x [T] y"), ("black", "x ███ y"), ("remove", "x  y"), ("odd", "x [T] y")])
def test_styles(spark, style, want):
    assert one(spark, spans.masked(F.col("t"), [("ab", "[T]")], style), t="x ab y") == want


def claimed(text: str, dictionary: list[tuple[str, str]]) -> list[tuple[int, int]]:
    taken: list[tuple[int, int]] = []
    for surface, _ in sorted(dictionary, key=lambda x: -len(x[0])):
        body = r"\s+".join(map(re.escape, surface.split(" ")))
        for m in re.finditer(rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])", text, re.IGNORECASE):
            if not any(m.start() < e and m.end() > s for s, e in taken):
                taken.append(m.span())
    return sorted(taken)


def test_spans_equal_a_plain_restatement(spark):
    dictionary = [("the", "[1]"), ("of the", "[2]"), ("the of", "[3]"), ("a", "[4]"), ("é b", "[5]")]

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(["the", "of", "THE", "a", "é", "b", "x", "\n", "_", "  "]), max_size=25).map(" ".join), min_size=40, max_size=40))
    def check(texts):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.claimed_spans(F.col("t"), dictionary).alias("s")).collect()
        for row in rows:
            assert [(x["start"], x["stop"]) for x in row["s"]] == claimed(row["t"], dictionary)
            assert all(row["t"][x["start"] : x["stop"]] == x["surface"] for x in row["s"])

    check()


def test_normalized_strips_before_punctuation(spark):
    rows = spark.createDataFrame([("J&J",), ('"  Acme  "',), ("Café Corp",), ("Café Corp",), (None,)], "v string")
    assert [r[0] for r in rows.select(patterns.normalized("v")).collect()] == ["jj", " acme ", "cafe corp", "cafe corp", None]


def test_hamming(spark):
    h = lambda a, b: one(spark, patterns.hamming(F.col("a"), F.col("b")), a=a, b=b)
    assert h("0f1e2d3c4b5a6970", "0f1e2d3c4b5a6978") == 1
    assert h("ffffffffffffffff", "0f1e2d3c4b5a6978") == 32
    assert h("nothex", "0f1e2d3c4b5a6978") is None


@pytest.mark.parametrize(("masked", "left", "score"), [(46, 2, 95.8), (0, 0, 100.0), (0, 5, 0.0)])
def test_completeness(spark, masked, left, score):
    assert spark.range(1).select(channels.completeness(F.lit(masked), F.lit(left)).alias("x")).first()["x"] == score


def test_boundary_leak_keeps_the_period(spark):
    rows = spark.createDataFrame([(1, "the [CLIENT_15] and [CLIENT_25] Turbine Ltd. is"), (2, None), (3, "")], "doc_id int, text string")
    assert [tuple(r) for r in channels.boundary_leaks(rows, ["[CLIENT_15]", "[CLIENT_25]"]).select("doc_id", "token", "leaked").collect()] == [(1, "[CLIENT_25]", "Turbine Ltd.")]


def test_sweep_by_index_equals_sweep(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    aliases = [(1, 1, "the"), (2, 2, "of the"), (3, 3, "ing"), (2, 4, "at the"), (4, 5, "zz")]
    table = spark.createDataFrame(aliases, "entity_id int, alias_id int, surface string")
    key = lambda df: sorted(map(tuple, df.select("doc_id", "entity_id", "surface").collect()))
    assert key(detect.sweep_indexed(docs, table)) == key(detect.sweep(docs, aliases, ("nobody",)))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3), (None, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4, 7: 7, **{n: 20 for n in range(20, 26)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_lose_no_pair(spark):
    refs = spark.createDataFrame([(1, "0f1e2d3c4b5a6970"), (2, "ffffffffffffffff")], "ref long, phash string")
    probe = spark.createDataFrame([(9, "0f1e2d3c4b5a6978")], "probe long, phash string")
    assert [tuple(r) for r in similarity.hamming_matches(probe, refs, 10).collect()] == [(9, 1, 1)]


def test_thresholds_by_type(spark):
    rows = spark.createDataFrame([("CLIENT_NAME", 0.45, False), ("CLIENT_PERSON", 0.45, False), ("OTHER", 0.6, False), ("CLIENT_PERSON", 0.1, True)], "entity_type string, confidence double, known boolean")
    limits = spark.createDataFrame([("CLIENT_NAME", 0.3), ("CLIENT_PERSON", 0.6)], "entity_type string, threshold double")
    assert {(r["entity_type"], r["known"]): r["passes"] for r in detect.gated(rows, limits).collect()} == {("CLIENT_NAME", False): True, ("CLIENT_PERSON", False): False, ("OTHER", False): True, ("CLIENT_PERSON", True): True}


def test_review_additions_and_deltas(spark):
    proposed = spark.createDataFrame([(1, "Acme"), (1, "Bob")], "run_id int, surface string")
    added = spark.createDataFrame([(1, 0, " acme "), (1, 1, "New"), (1, 2, "NEW"), (1, 3, " ")], "run_id int, ord int, surface string")
    assert [r["surface"] for r in governance.review_additions(proposed, added).collect()] == ["New"]


def test_surfaces_without_ascii_tokens_collide(spark):
    proposed = spark.createDataFrame([(1, "Bank of 東京都 East"), (1, "ΟΔΟΣ ΑΒ"), (1, "Plain name")], "entity_id int, replacement string")
    known = spark.createDataFrame([(2, "東京都", None), (3, "οδος", None), (4, "京都府", None), (5, "name", None)], "entity_id int, surface string, custom string")
    got = {(r["replacement"], r["other_id"]) for r in governance.alias_collisions(proposed, known).collect()}
    assert got == {("Bank of 東京都 East", 2), ("ΟΔΟΣ ΑΒ", 3), ("Plain name", 5)}


def test_occurrence_rows_equal_a_plain_restatement(spark, small):
    from corvane.plans import masking
    from corvane.plans.fixtures import approved, literal

    entity: dict[str, int] = {}
    for r in literal(spark, "dictionary").where("status = 'approved'").collect():
        entity[r["surface"].lower()] = min(r["entity_id"], entity.get(r["surface"].lower(), r["entity_id"]))
    want = set()
    for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").collect():
        want |= {(r["doc_id"], a, b, r["text"][a:b], entity.get(r["text"][a:b].lower())) for a, b in claimed(r["text"], approved())}
    rows = [tuple(r) for r in masking.occurrence_rows(spark, small).select("doc_id", "start", "stop", "surface", "entity_id").collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_json_objects_glued_by_a_comma(spark):
    cases = {'x {"a": 1}, "b": {"c": 2}} y': '{"a": 1, "b": {"c": 2}}', 'x {"a": 1}, "a": 2}': '{"a": 2}', '{"a": 1} and {"b": 2}': None, "none": None, "```json\n[1]\n``` {}": "{}", '```{"a": 1}``` ```broken``` {"b": 2}': '{"a": 1}'}
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", lifecycle.last_json("t").alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == cases | {None: None}


def test_parts_of_any_size_and_what_hangs_on_them(spark):
    import io
    import zipfile

    from corvane.sources import chunks

    line = "<w:p><w:r><w:t>" + "long " * 400_000 + "</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{line * 40}</w:body></w:document>')
        z.writestr("word/endnotes.xml", '<w:endnotes xmlns:w="urn:w"><w:p><w:r><w:t>end</w:t></w:r></w:p></w:endnotes>')
        z.writestr("word/footnotes.xml", '<w:footnotes xmlns:w="urn:w"><w:p><w:r><w:t>foot</w:t></w:r></w:p></w:footnotes>')
        z.writestr("word/header1.xml", "<broken")
    files = spark.createDataFrame([("big.docx", out.getvalue()), ("bad.docx", b"no zip")], "path string, content binary")
    got = {(r["path"], r["kind"], r["chunk_id"]): len(r["text"]) for r in chunks.text_chunks(packages.parts(files)).collect()}
    eight = 8 * 2_000_000 + 7 * 2
    assert got == {("big.docx", "paragraph_group", n): eight for n in range(5)} | {("big.docx", "notes", -3): len("foot\nend")}


def inserted_one_by_one(new, tokens):
    """The rule as it reads: each insert counts what its pattern matches, then goes on to a free number."""
    tokens, out = list(tokens), {}
    for surface, kind in sorted((s, k) for k, s in new):
        prefix = governance.PREFIXES.get(kind, "CLIENT")
        number = 1 + sum(bool(re.fullmatch(rf"\[{prefix}..*\]|\[{prefix}.\]", t)) for t in tokens)
        while f"[{prefix}_{number}]" in tokens:
            number += 1
        tokens.append(f"[{prefix}_{number}]")
        out[surface] = tokens[-1]
    return out


@pytest.mark.parametrize(
    ("new", "tokens"),
    [
        ([("CLIENT_PERSON", "a"), ("CLIENT_NAME", "b"), ("CLIENT_NAME", "c")], []),
        ([("CLIENT_NAME", "a"), ("CLIENT_NAME", "b")], ["[CLIENT_1]", "[CLIENT_3]"]),
        ([(k, f"s{i:03}") for i, k in enumerate([*governance.PREFIXES, "ODD", "CLIENT_NAME"] * 12)], ["[CLIENT_7]", "[CLIENT_8]", "[CLIENT_30]", "[CLIENT_31]", "[CLIENT_PERSON_2]", "[CLIENT_PERSON_9]", "[CLIENT_DOMAIN_x]", "[CLIENT_02]", "odd"]),
    ],
)
def test_tokens_are_those_of_single_inserts(spark, new, tokens):
    rows = governance.allocated_tokens(spark.createDataFrame(new, "entity_type string, surface string"), spark.createDataFrame([(t,) for t in tokens], "token string")).collect()
    got = {r["surface"]: r["token"] for r in rows}
    assert got == inserted_one_by_one(new, tokens) and len({*got.values(), *tokens}) == len(got) + len(tokens)


def test_indexed_sweep_finds_names_without_ascii_tokens(spark):
    docs = spark.createDataFrame([(1, "株式漢字社会 Acme"), (2, "漢字 社"), (3, "ÉÉ  é corp"), (4, None)], "doc_id int, text string")
    names = spark.createDataFrame([(1, 1, "漢字社"), (2, 2, "acme"), (3, 3, "éé é"), (4, 4, "!?"), (5, 5, " ")], "entity_id int, alias_id int, surface string")
    assert {(r["doc_id"], r["entity_id"]) for r in detect.sweep_indexed(docs, names).collect()} == {(1, 1), (1, 2), (3, 3)}


def test_masking_is_linear_in_the_text(spark):
    text, dictionary = "the cat of the dog " * 40000, [("the", "[1]"), ("of the", "[2]")]
    began = time.time()
    assert one(spark, F.length(spans.masked(F.col("t"), dictionary)), t=text) == len("[1] cat [2] dog ") * 40000
    assert time.time() - began < 20


def test_masked_pieces(spark):
    rows = spark.createDataFrame([(["x Ac", "me", " Corp and", "", " the Acme"],), ([],), (None,)], "p array<string>")
    got = [r[0] for r in rows.select(spans.masked_pieces(F.col("p"), [("Acme Corp", "[1]"), ("Acme", "[2]")])).collect()]
    assert got == [["x [1]", "", " and", "", " the [2]"], [], None]


def test_token_numbers_count_longer_prefixes(spark):
    have = spark.createDataFrame([("[CLIENT_1]",), ("[CLIENT_PERSON_1]",)], "token string")
    new = spark.createDataFrame([("CLIENT_NAME", "x"), ("CLIENT_PERSON", "y"), ("ODD", "z")], "entity_type string, surface string")
    assert {r["surface"]: r["token"] for r in governance.allocated_tokens(new, have).collect()} == {"x": "[CLIENT_3]", "y": "[CLIENT_PERSON_2]", "z": "[CLIENT_5]"}


@pytest.mark.parametrize(("text", "want"), [('a ```json {"a": 1} ``` b ```json {"b": 2} ```', '{"b":2}'), ('x {"c": 3} y', '{"c":3}'), ("none", None), ('``` nope ``` {"d": 4}', '{"d":4}')])
def test_last_json(spark, text, want):
    got = one(spark, lifecycle.last_json(F.col("t")), t=text)
    assert (got and got.replace(" ", "")) == want


def test_unreadable_package_is_a_row(spark):
    rows = spark.createDataFrame([("bad", bytearray(b"no zip")), ("none", None)], "path string, content binary")
    assert {r["path"]: r["part"] for r in packages.parts(rows).collect()} == {"bad": None, "none": None}


def test_image_format(spark):
    rows = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n1"),), (bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"RIFF0000WEBPxx"),), (bytearray(b"<?xml?><svg/>"),), (bytearray(b"?"),)], "b binary")
    assert [r[0] for r in rows.select(packages.image_format(F.col("b"))).collect()] == ["png", "jpeg", "webp", "svg", None]
