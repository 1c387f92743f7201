"""Queries over uploaded files and over masked output that is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.plans import packages
from corvane.sources import masked, uploads
from corvane.sources.shared import new_folder
from corvane.sources.tables import table

KINDS = ("docx", "pptx", "xlsx")


def _uploaded(spark, folder):
    """One file for each supplier: some cut off, empty, damaged, of another type or of no known one."""
    key = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    rows = packages._files(spark, folder).withColumn("key", key)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("key") % 3 + 1).cast("int"))
    content = F.when(F.col("key") % 11 == 4, F.unhex(F.lit(""))).when(F.col("key") % 7 == 3, F.expr("substring(content, 1, cast(length(content) / 2 as int))")).otherwise(F.col("content"))
    name = F.concat("path", F.lit("."), F.when(F.col("key") % 13 == 5, "txt").when(F.col("key") % 17 == 6, "PDF").when(F.col("key") % 19 == 7, "bin").otherwise(kind))
    types = {v: k for k, v in uploads.TYPES.items()}
    told = F.when(F.col("key") % 19 == 7, F.element_at(F.create_map(*[F.lit(x) for v in KINDS for x in (v, types[v])]), kind)).otherwise("application/octet-stream")
    return rows.select(name.alias("path"), content.alias("content"), told.alias("content_type"))


def uploads_judged(spark, folder):
    return uploads.judged(_uploaded(spark, folder)).select("path", "kind", "outcome")


def uploads_admitted(spark, folder):
    return uploads.admitted(_uploaded(spark, folder)).select("path")


def masked_read_back(spark, folder):
    """Each page is a run whose output is a file; customers ask for runs, their own and others'."""
    pages = table(spark, folder, "pages")
    run = F.col("page_id")
    chunks = F.transform(F.split("html", "\n", -1), lambda t: F.struct(t.alias("text")))
    body = F.to_json(F.struct(F.col("url").alias("filename"), chunks.alias("masked_chunks"), F.array(F.lit("[CLIENT_1]")).alias("entities_masked")))
    body = F.when(run % 19 == 3, F.substring(body, 1, 25)).when(run % 19 == 4, F.lit("[1, 2")).otherwise(body)
    path = new_folder(spark, "masked-output")
    masked.write_outputs(pages.where("page_id % 23 <> 5").select(run.alias("run_id"), body.alias("body")), path)
    status = F.element_at(F.array(*map(F.lit, ("completed", "completed_with_issues", "working", "failed"))), F.least(run % 6 + 1, F.lit(4)).cast("int"))
    runs = pages.select(run.alias("run_id"), (run % 40).alias("created_by"), F.when(run % 8 == 7, "tagging").otherwise("sanitization").alias("agent"), F.when(run % 6 < 4, status).otherwise("completed").alias("status"))
    people = table(spark, folder, "customer")
    requests = people.select(F.col("c_custkey").alias("request"), (F.col("c_custkey") % 40).alias("user_id"), (F.col("c_custkey") * F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(7) % 300).alias("run_id"))
    out = masked.read_back(requests, runs, people.where("c_custkey % 40 < 2").select((F.col("c_custkey") % 40).alias("user_id")), masked.outputs(spark, path))
    return out.select("request", "outcome", "filename", "chunks", F.md5("masked_text").alias("digest"))


_KEY = "(SELECT s_suppkey AS k, s_name, ['docx', 'pptx', 'xlsx'][s_suppkey % 3 + 1] AS kind FROM supplier)"
_JUDGED = (
    f"(SELECT s_name || '.' || CASE WHEN k % 13 = 5 THEN 'txt' WHEN k % 17 = 6 THEN 'PDF' WHEN k % 19 = 7 THEN 'bin' ELSE kind END AS path, CASE "
    f"WHEN k % 19 = 7 THEN kind WHEN k % 13 = 5 THEN NULL WHEN k % 17 = 6 THEN 'pdf' ELSE kind END AS kind, CASE WHEN k % 19 <> 7 "
    f"AND k % 13 = 5 THEN 'unsupported type' WHEN k % 11 = 4 THEN 'empty' WHEN k % 19 <> 7 AND k % 17 = 6 THEN 'no reader' "
    f"WHEN k % 7 = 3 THEN 'extraction failed' ELSE 'admitted' END AS outcome FROM {_KEY})"
)
_READ = """(SELECT c_custkey AS request, CASE WHEN page_id IS NULL THEN 'no such run' WHEN page_id % 40 <> u AND u >= 2 THEN 'not allowed' WHEN page_id % 8 = 7 THEN 'not a sanitization run' WHEN page_id % 6 IN (2, 3) THEN 'run is ' || ['working', 'failed'][page_id % 6 - 1] WHEN page_id % 23 = 5 THEN 'no file' WHEN page_id % 19 IN (3, 4) THEN 'broken file' ELSE 'read' END AS outcome, url, html
FROM (SELECT c_custkey, c_custkey % 40 AS u, c_custkey * CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 7 END % 300 AS r FROM customer) q LEFT JOIN pages ON page_id = r)"""
ORACLE = {
    "uploads_judged": f"SELECT * FROM {_JUDGED} j",
    "uploads_admitted": f"SELECT path FROM {_JUDGED} j WHERE outcome = 'admitted'",
    "masked_read_back": (
        f"SELECT request, outcome, CASE WHEN outcome = 'read' THEN url END AS filename, CASE WHEN outcome = 'read' THEN len(string_split(html, chr(10))) "
        f"END::INTEGER AS chunks, CASE WHEN outcome = 'read' THEN md5(replace(html, chr(10), chr(10) || chr(10))) END AS digest FROM {_READ} r"
    ),
}
QUERIES = {name: globals()[name] for name in ORACLE}
