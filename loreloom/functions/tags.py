"""Tag lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.text import contains_ignore_case, strip


def _kept(tags: Column) -> Column:
    return F.filter(tags, lambda tag: tag.isNotNull() & (tag != ""))


def normalize_tags(tags: Column) -> Column:
    """Strip, lower, drop blanks and nulls, keep first occurrences, at most 12."""
    tidy = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda tag: F.lower(strip(tag)))
    return F.slice(F.array_distinct(_kept(tidy)), 1, K.MAX_TAGS)


def normalize_tag_text(text: Column) -> Column:
    """The same for a comma-separated string."""
    return normalize_tags(F.split(text, ","))


def tags_to_text(tags: Column) -> Column:
    return F.array_join(tags, ", ")


def tags_from_text(text: Column) -> Column:
    """Form field to list: trimmed, blanks dropped, case and repeats kept."""
    return _kept(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip))


def any_tag_contains(tags: Column, term: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda tag: contains_ignore_case(tag, term)), F.lit(False))


def any_tag_too_long(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda tag: F.length(tag) > K.TAG_CHARS), F.lit(False))
