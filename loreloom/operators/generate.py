"""Plug-in points for models that read a text and write a text.

A plug-in is ``load() -> (str -> str)``: loaded once per task, called per row, and a row whose
call fails gets null. Without a plug-in the column is null and callers use their fallback.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom.functions.text import bind
from loreloom.schemas import MEMORY_CANDIDATE

Generator = Callable[[], Callable[[str], str]]

# A run of capitalised words counts as one entity.
ENTITY_PATTERN = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"


def generate(prompt: Column, load: Generator | None) -> Column:
    if load is None:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def reply(text):
            try:
                return None if text is None else model(text)
            except Exception:  # a failed call is an absent reply
                return None

        for batch in batches:
            yield batch.map(reply, na_action="ignore").astype(object)

    return run(prompt)


def answer_or_fallback(reply: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(reply, F.lit("")), fallback)


def capitalised_phrases(text: Column) -> Column:
    """Default entity extractor: graph payload JSON with one topic per capitalised phrase and a
    related_to edge between phrases that follow each other in order of first appearance."""

    def payload(phrases: Column) -> Column:
        rest = F.greatest(F.size(phrases) - 1, F.lit(0))
        nodes = F.transform(phrases, lambda p: F.struct(
            p.alias("title"), F.lit("topic").alias("type"), F.lit("").alias("description")))
        edges = F.zip_with(
            F.slice(phrases, F.lit(1), rest), F.slice(phrases, F.lit(2), rest),
            lambda a, b: F.struct(a.alias("source"), b.alias("target"),
                                  F.lit("related_to").alias("type"), F.lit("").alias("description")),
        )
        return F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges")))

    return bind(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY_PATTERN), F.lit(0))), payload)


def model_extractor(load: Generator, sample_chars: int | None = None) -> Callable[[Column], Column]:
    """Extractor calling a model on the text, or on its first ``sample_chars`` characters for
    models with a small window. A failed call is an empty payload."""

    def extract(text: Column) -> Column:
        sample = F.substring(text, 1, sample_chars) if sample_chars else text
        return F.coalesce(generate(sample, load), F.lit('{"nodes":[],"edges":[]}'))

    return extract


def memory_candidate(reply: Column) -> Column:
    """Reply JSON to struct(title, content, category), or null unless it has title and content."""
    parsed = F.from_json(reply, MEMORY_CANDIDATE)
    return F.when(
        parsed["title"].isNotNull() & parsed["content"].isNotNull(),
        F.struct(
            parsed["title"].alias("title"), parsed["content"].alias("content"),
            F.coalesce(parsed["category"], F.lit("note")).alias("category"),
        ),
    )

