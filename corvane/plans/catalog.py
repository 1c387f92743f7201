"""All queries of the library by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import annotations, automata, detection, files, governance, masking, packages, remediation, requests, review, similarity, streams, upkeep

_AREAS = (annotations, automata, detection, masking, similarity, governance, review, packages, upkeep, remediation, files, requests, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for area in _AREAS for name, sql in area.ORACLE.items()}
flagship = masking.flagship
