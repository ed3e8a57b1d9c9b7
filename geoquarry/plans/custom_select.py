"""A user's own SELECT as the row source: checked by Spark's parser, never run to check."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from geoquarry.model import QueryError

_ONLY_COMMENTS = re.compile(r"(?:\s|;|--[^\n]*(?:\n|$)|/\*.*?\*/)*", re.DOTALL)


def _define(spark: SparkSession, name: str, sql: str) -> None:
    # A view takes a query and nothing else; the line breaks keep a final
    # comment from hiding the parenthesis.
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS (\n{sql}\n)")


def check_select(spark: SparkSession, sql: str) -> str:
    """Return a text as one SELECT without its final semicolon. Nothing runs.

    Raises:
        QueryError: The text does not parse, or is not exactly one SELECT.
    """
    name = f"checked_{uuid.uuid4().hex}"
    endings = [at.start() for at in re.finditer(";", sql)]
    candidates = [sql] + [
        sql[:end] for end in reversed(endings) if _ONLY_COMMENTS.fullmatch(sql, end)
    ]
    failure: Exception | None = None
    for text in candidates:
        if _ONLY_COMMENTS.fullmatch(text):
            continue
        try:
            _define(spark, name, text)
        except ParseException as error:
            failure = failure or error
            continue
        except AnalysisException as error:
            raise QueryError(str(error)) from error
        spark.catalog.dropTempView(name)
        return text.strip()
    raise QueryError(f"Write one SELECT statement: {failure or 'the text is empty'}")


def custom_rows(spark: SparkSession, sql: str, source: DataFrame, view: str = "features") -> DataFrame:
    """Return the rows of a checked SELECT that reads the source as a view."""
    source.createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM (\n{check_select(spark, sql)}\n)")
