"""Versions of several tables, and remediation done again after it was cut off."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

from corvane.operators import remediation
from corvane.plans import remediation as plans
from corvane.sources.snapshots import Conflict, Snapshots


def rows(df: DataFrame) -> list[str]:
    return sorted(str(r) for r in df.collect())


def test_readers_see_all_tables_of_a_version_or_none(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/store")
    assert store.version() == -1 and store.tables() == {}
    assert store.commit({"a": spark.range(3), "b": spark.range(1)}, -1) == 0
    assert store.commit({"a": spark.range(5)}, 0) == 1
    assert {n: d.count() for n, d in store.tables().items()} == {"a": 5, "b": 1} and store.tables(0)["a"].count() == 3
    with pytest.raises(Conflict):
        store.commit({"a": spark.range(7)}, 0)
    assert store.version() == 1 and store.tables()["a"].count() == 5
    assert len(store.vacuum()) == 1 and store.tables()["a"].count() == 5 and store.vacuum() == []


@pytest.mark.parametrize("written", [0, 3, 6])
def test_a_replay_after_a_kill_gives_the_same_tables(spark, small, tmp_path, monkeypatch, written):
    inputs, requests = plans._inputs(spark, small), plans._requests(spark, small)
    clean, cut = (Snapshots(spark, f"file://{tmp_path}/{n}") for n in ("clean", "cut"))
    for store in (clean, cut):
        store.commit(inputs, -1)
    remediation.remediate_snapshot(clean, requests)

    class Killed(BaseException):
        pass

    done = []
    real = Snapshots.commit

    def killed(self, tables, base):
        class Dies(dict):
            def items(self):
                for name, df in sorted(dict.items(self)):
                    if len(done) == written:
                        raise Killed
                    df.write.parquet(f"{tmp_path}/cut/{name}/torn")
                    done.append(name)
                raise Killed

        return real(self, Dies(tables), base)

    monkeypatch.setattr(Snapshots, "commit", killed)
    with pytest.raises(Killed):
        remediation.remediate_snapshot(cut, requests)
    monkeypatch.undo()
    assert cut.version() == 0 and len(done) == written
    before = cut.tables()
    assert all(rows(before[n]) == rows(df) for n, df in inputs.items())
    remediation.remediate_snapshot(cut, requests)
    assert {n: rows(df) for n, df in cut.tables().items()} == {n: rows(df) for n, df in clean.tables().items()}
    assert sorted(cut.vacuum()) == [f"{n}/torn" for n in sorted(done)]


def test_complete_runs_are_refused_and_left_alone(spark, small, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/again")
    store.commit(plans._inputs(spark, small), -1)
    requests = plans._requests(spark, small)
    remediation.remediate_snapshot(store, requests)
    first = store.tables()
    complete = first["runs"].where("verified").select("run_id")
    assert complete.count() > 0
    assert remediation.refused(complete, first["runs"]).where("reason = 'run is completed'").count() == complete.count()
    again = remediation.remediate(first, complete)
    for name in again:
        assert rows(again[name]) == rows(first[name]), name
    # What could not be verified is repeated: nothing is left to scrub, body texts that show a name are masked once more.
    repeated = remediation.remediate(first, requests)
    dirty = {r["run_id"] for r in first["runs"].where("not verified_text").collect()}
    texts = lambda df: {r["run_id"]: r["text"] for r in df["items"].where("channel = 'text'").collect()}
    old, new = texts(first), texts(repeated)
    assert rows(repeated["items"].where("channel <> 'text'")) == rows(first["items"].where("channel <> 'text'"))
    assert {r for r in old if old[r] != new[r]} == dirty and dirty
    assert repeated["steps"].count() > first["steps"].count() and repeated["runs"].where("not verified_text").isEmpty()


def test_surfaces_with_signs_of_patterns(spark):
    """Surfaces and tokens are taken literally, whatever signs they hold."""
    names = spark.createDataFrame([(1, "a.b", "$1\\", 0), (1, "(x", "[T]", 1), (1, "q\\E r", "[Q]", 2)], "run_id long, surface string, token string, ord long")
    said = "a.b axb (x) q\\E  r A.B"
    items = spark.createDataFrame([(1, c, 0, said) for c in ("metadata", "text")] + [(1, "comments", 0, None)], "run_id long, channel string, item long, text string")
    work = spark.createDataFrame([(1, "token")], "run_id long, style string")
    out = {r["channel"]: (r["text"], r["left"]) for r in remediation.scrubbed_items(items, remediation._maps(names), work).collect()}
    want = "$1\\ axb [T]) [Q] $1\\"
    assert out == {"metadata": (want, []), "text": (want, []), "comments": (None, [])}


def test_an_approved_residual_is_masked_and_the_old_token_stays(spark):
    """One name masked before, one that a reviewer approves: one is applied, it is gone, the old token is kept, a repeat changes nothing."""
    verified = ", ".join(f"verified_{c} boolean" for c in remediation.CHANNELS)
    known = [(r, "sanitization", "completed_with_issues", True, "token", 0, False, *[True] * 5) for r in (1, 2)]
    tables = {
        "runs": spark.createDataFrame(known, f"run_id long, agent string, status string, has_file boolean, style string, images_redacted long, verified boolean, {verified}"),
        "items": spark.createDataFrame([(1, "text", 0, "[CLIENT_1] meets Acme Corp and acme corp. [CLIENT_2] Turbine Ltd."), (1, "metadata", 0, "by Acme Corp"), (2, "text", 0, "Acme Corp stays")], "run_id long, channel string, item long, text string"),
        "mask_map": spark.createDataFrame([(1, "Tata", "[CLIENT_1]", 0), (2, "Tata", "[CLIENT_1]", 0)], "run_id long, surface string, token string, ord long"),
        "flags": spark.createDataFrame([(1, 1, "blocking", "Revalidation found 1 more"), (1, 2, "info", "low confidence"), (2, 1, "blocking", "Revalidation found 1 more")], "run_id long, seq long, severity string, message string"),
    }
    approved = spark.createDataFrame([(1, 0, " Acme Corp ", "[CLIENT_2]"), (1, 1, "Tata", "[X]"), (1, 2, "", "[Y]"), (1, 3, "Acme Corp", "[Z]"), (9, 0, "Acme", "[A]")], "run_id long, ord long, surface string, token string")
    out = remediation.reapply(tables, approved)
    texts = {(r["run_id"], r["channel"]): r["text"] for r in out["items"].collect()}
    assert texts == {(1, "text"): "[CLIENT_1] meets [CLIENT_2] and [CLIENT_2]. [CLIENT_2] Turbine Ltd.", (1, "metadata"): "by [CLIENT_2]", (2, "text"): "Acme Corp stays"}
    assert sorted(r["start"] for r in out["occurrences"].collect()) == [17, 31]
    assert [tuple(r) for r in out["revalidations"].collect()] == [(1, 1, 2, 1, 66.7)]
    flags = sorted((r["run_id"], r["seq"], r["message"]) for r in out["flags"].collect())
    assert flags == [(1, 2, "low confidence"), (1, 3, "Revalidation found 1 more"), (2, 1, "Revalidation found 1 more")]
    again = remediation.reapply(tables | {n: out[n] for n in ("items", "mask_map", "flags", "runs")}, approved)
    assert again["occurrences"].count() == 0 and rows(again["items"]) == rows(out["items"])

