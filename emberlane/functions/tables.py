"""Functions from a row to many, for SQL with LATERAL."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="place int, candidate string, faithful boolean", useArrow=True)
class CandidateRows:
    """A reply's candidates as rows: place in its list from 1, text, whether it says what was intended; blank ones are left out."""

    def eval(self, intended: str, candidates: list[str]) -> Iterator[tuple]:
        wanted = (intended or "").strip(" ")
        for place, text in enumerate(candidates if candidates is not None else [], 1):
            if text is not None and text.strip(" "):
                yield place, text, text.strip(" ") == wanted


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: ``candidate_rows(intended, candidates)``."""
    spark.udtf.register("candidate_rows", CandidateRows)
