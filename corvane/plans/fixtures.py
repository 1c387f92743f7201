"""Small literal tables that queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (columns, rows as SQL)
LITERALS = {
    "dictionary": ("entity_id, alias_id, surface, entity_type, token, status, created_days, custom", "(1, 1, 'the', 'CLIENT_NAME', '[CLIENT_1]', 'approved', 30, NULL), (2, 2, 'of the', 'CLIENT_NAME', '[CLIENT_2]', 'approved', 3, 'Partner'), (3, 3, 'ing', 'CLIENT_PERSON', '[CLIENT_PERSON_1]', 'approved', 20, NULL), (4, 4, 'and the', 'CLIENT_NAME', '[CLIENT_3]', 'approved', 1, NULL), (2, 5, 'at the', 'CLIENT_NAME', '[CLIENT_2]', 'approved', 3, 'Partner'), (5, 6, 'mail1.example.com', 'CLIENT_EMAIL_DOMAIN', '[CLIENT_DOMAIN_1]', 'pending_approval', 40, NULL), (6, 7, 'queeuxier', 'CLIENT_NAME', '[CLIENT_4]', 'skipped', 50, ''), (7, 8, 'is', 'CLIENT_NAME', '[CLIENT_5]', 'approved', 9, NULL), (8, 9, 'anon', 'CLIENT_NAME', '[CLIENT_6]', 'approved', 9, NULL)"),
    "thresholds": ("entity_type, threshold", "('CLIENT_NAME', 0.6), ('CLIENT_PERSON', 0.6), ('CLIENT_LOCATION', 0.6), ('CLIENT_EMAIL_DOMAIN', 0.3), ('CLIENT_CONTRACT_ID', 0.8)"),
    "parts": ("part", "('word/document.xml'), ('word/comments.xml'), ('word/people.xml'), ('ppt/authors.xml'), ('ppt/comments/comment1.xml'), ('ppt/comments/modernComment_1_A.xml'), ('ppt/reviewersList.xml'), ('ppt/tags/tag1.xml'), ('xl/persons/person.xml'), ('xl/persons/extra.xml'), ('docProps/core.xml'), ('docProps/owner.xml'), ('[Content_Types].xml'), ('xl/threadedComments/threadedComment1.xml'), ('customXml/editor.xml'), ('ppt/slides/slide1.xml')"),
    "capabilities": ("role, capability", "('km_governance', 'review_queue_manage'), ('km_governance', 'view_all_runs_org_wide'), ('km_reviewer', 'review_queue_manage'), ('practice_lead', 'client_lookup_own'), ('delivery', 'submit_documents'), ('read_only', 'browse_and_search')"),
    "vocabulary": ("category, value, status", "('domain', 'en', 'approved'), ('domain', 'fr', 'approved'), ('domain', 'de', 'pending_approval'), ('technology', 'src0', 'approved'), ('technology', 'src1', 'approved'), ('technology', 'src2', 'approved'), ('geography', 'es', 'approved')"),
    "categories": ("ord, category", "(1, 'domain'), (2, 'use_case'), (3, 'technology'), (4, 'geography'), (5, 'engagement_type')"),
    "verdicts": ("label, flagged, confidence, ocr", "(0, true, 0.9, 'the'), (1, false, 0.5, NULL), (2, false, 0.2, 'firm'), (3, true, 0.4, 'firm'), (4, false, 0.7, NULL), (5, false, 0.3, 'ing'), (6, true, 0.99, NULL), (7, false, 0.1, NULL), (8, true, 0.6, 'xyz'), (9, false, 0.69, NULL)"),
}
#: Names of the firm that runs the engine: never a client.
OWN_FIRM = ("anon", "firm")


def literal(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = LITERALS[name]
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def values(name: str) -> str:
    """The same table as SQL text."""
    columns, rows = LITERALS[name]
    return f"(SELECT * FROM (VALUES {rows}) AS t({columns}))"


def approved(spark_rows: bool = True) -> list[tuple[str, str]]:
    """(surface, token) of the approved aliases that masking uses: nested, never crossing."""
    return [("the", "[CLIENT_1]"), ("of the", "[CLIENT_2]"), ("ing", "[CLIENT_PERSON_1]"), ("and the", "[CLIENT_3]")]
