"""Tenant scope, point lookups, text and facet filters."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions.tags import any_tag_contains
from loreloom.functions.text import contains_ignore_case, strip


def owned_by(rows: DataFrame, owner) -> DataFrame:
    return rows.filter(F.col("owner") == owner)


def owned_row(rows: DataFrame, owner, row_id) -> DataFrame:
    """The owner's row with that id; empty when it is missing or someone else's."""
    return rows.filter((F.col("owner") == owner) & (F.col("id") == row_id))


def with_status(rows: DataFrame, status: str, column: str = "status") -> DataFrame:
    return rows.filter(F.col(column) == status)


def tri_state(text: Column) -> Column:
    """'true'/'1' is true, 'false'/'0' is false, anything else is null: no filter."""
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def parse_tri_state(text: str | None) -> bool | None:
    return {"true": True, "1": True, "false": False, "0": False}.get(text)


def in_any_field(term: Column, fields: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [contains_ignore_case(field, term) for field in fields])


def memory_filter(entries: DataFrame, query: str | None = "", category: str | None = "",
                  pinned: bool | None = None) -> DataFrame:
    """Category and pin filters, then a literal substring of title, content or any tag."""
    if category:
        entries = entries.filter(F.col("category") == category)
    if pinned is not None:
        entries = entries.filter(F.col("is_pinned") == pinned)
    term = (query or "").strip()
    if term:
        text = F.lit(term)
        entries = entries.filter(
            in_any_field(text, [F.col("title"), F.col("content")]) | any_tag_contains(F.col("tags"), text)
        )
    return entries


def keyword_filter(rows: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Every blank-separated term must occur in at least one of ``fields``."""
    for term in query.split():
        rows = rows.filter(in_any_field(F.lit(term), [F.col(f).cast("string") for f in fields]))
    return rows


def facet_filter(rows: DataFrame, equal: dict | None = None, since=None, until=None,
                 time_column: str = "created_at") -> DataFrame:
    """Equality on facet columns and a half-open time range."""
    for column, value in (equal or {}).items():
        rows = rows.filter(F.col(column) == value)
    if since is not None:
        rows = rows.filter(F.col(time_column) >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.col(time_column) < F.lit(until))
    return rows


def facet_counts(rows: DataFrame, facets: list[str]) -> DataFrame:
    """facet, value, row_count for every facet column, in one pass over ``rows``."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets
    ])
    return (
        rows.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value")
        .agg(F.count("*").alias("row_count"))
    )
