"""Rules as columns: the first broken rule of a row, or null. Nothing raises."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.tags import any_tag_too_long
from loreloom.functions.text import file_suffix, is_blank, strip

ERROR = "struct<field:string,message:string>"


def _rules(*rules: tuple[Column, str, Column | str]) -> Column:
    """First rule whose condition is true, as struct(field, message)."""
    chain = None
    for broken, field, message in rules:
        text = F.lit(message) if isinstance(message, str) else message
        error = F.struct(F.lit(field).alias("field"), text.alias("message"))
        condition = F.coalesce(broken, F.lit(False))
        chain = F.when(condition, error) if chain is None else chain.when(condition, error)
    return chain.otherwise(F.lit(None).cast(ERROR))


def document_error(file_type: Column, file_name: Column, file_size: Column, raw_text: Column,
                   source_url: Column, allowed: tuple[str, ...] = K.UPLOAD_TYPES) -> Column:
    backed = file_type.isin(*K.UPLOAD_SUFFIXES)
    wrong_suffix = F.lit(False)
    for kind, suffix in K.UPLOAD_SUFFIXES.items():
        wrong_suffix = wrong_suffix | ((file_type == kind) & (file_suffix(file_name) != suffix))
    no_file = file_name.isNull() | (file_name == "")
    return _rules(
        (file_type.isNull() | ~file_type.isin(*allowed), "file_type",
         K.BAD_TYPE),
        (~no_file & (file_size > K.MAX_UPLOAD_BYTES), "file", K.TOO_LARGE),
        ((file_type == "note") & is_blank(raw_text), "raw_text", K.NOTE_WITHOUT_TEXT),
        (backed & no_file, "file", F.concat(F.upper(file_type), F.lit(K.FILE_MISSING))),
        (backed & wrong_suffix, "file", F.concat(F.lit(K.WRONG_SUFFIX_START), F.upper(file_type), F.lit(K.WRONG_SUFFIX_END))),
        ((file_type == "link") & (F.coalesce(source_url, F.lit("")) == ""), "source_url",
         K.LINK_WITHOUT_URL),
    )


def memory_error(title: Column, content: Column, category: Column, tags: Column) -> Column:
    return _rules(
        (is_blank(title), "title", K.TITLE_REQUIRED),
        (F.length(strip(title)) > K.MEMORY_TITLE_CHARS, "title",
         f"Ensure this field has no more than {K.MEMORY_TITLE_CHARS} characters."),
        (is_blank(content), "content", K.CONTENT_REQUIRED),
        (category.isNotNull() & ~category.isin(*K.MEMORY_CATEGORIES), "category",
         F.concat(F.lit('"'), category, F.lit('" is not a valid choice.'))),
        (any_tag_too_long(tags), "tags", f"Ensure this field has no more than {K.TAG_CHARS} characters."),
    )


def search_query(body_query: Column, body_q: Column, url_query: Column, url_q: Column) -> Column:
    """Query text of a request. The body's ``q`` stands in only for a missing ``query``;
    the URL stands in when the body gave nothing."""
    body = F.coalesce(body_query, body_q)
    return strip(F.coalesce(F.nullif(body, F.lit("")), url_query, url_q, F.lit("")))


def whole_number(text: Column) -> Column:
    """Text to integer as a form's integer field reads it: blanks about it and zeros after a point are nothing."""
    return F.regexp_replace(text, r"\.0*\s*$", "").try_cast("int")


def search_limit(body_limit: Column, url_limit: Column) -> Column:
    return F.coalesce(body_limit, url_limit, F.lit(str(K.DEFAULT_LIMIT)))


def search_error(query: Column, limit_text: Column) -> Column:
    limit = whole_number(limit_text)
    return _rules(
        (F.coalesce(query, F.lit("")) == "", "query", K.FIELD_BLANK),
        (limit.isNull(), "limit", K.INTEGER_REQUIRED),
        (limit < 1, "limit", "Ensure this value is greater than or equal to 1."),
        (limit > K.MAX_LIMIT, "limit", f"Ensure this value is less than or equal to {K.MAX_LIMIT}."),
    )


def _url_limit(limit_text: Column) -> Column:
    return F.coalesce(limit_text, F.lit(str(K.DEFAULT_LIMIT))).try_cast("int")


def clamped_limit(limit_text: Column) -> Column:
    """Limit of the document search: 5 when absent, at most 20, null when it is no integer."""
    limit = _url_limit(limit_text)
    return F.when(limit.isNotNull(), F.least(limit, F.lit(K.MAX_LIMIT)))


def clamped_limit_error(limit_text: Column) -> Column:
    limit = _url_limit(limit_text)
    return _rules(
        (limit.isNull(), "limit", K.LIMIT_NOT_INTEGER),
        (limit < 0, "limit", "limit must not be negative."),
    )


def chat_error(message: Column, conversation_id: Column) -> Column:
    trimmed = F.coalesce(strip(message), F.lit(""))
    return _rules(
        (message.isNull(), "message", K.FIELD_REQUIRED),
        (trimmed == "", "message", K.FIELD_BLANK),
        (F.length(trimmed) > K.MAX_MESSAGE_CHARS, "message",
         f"Ensure this field has no more than {K.MAX_MESSAGE_CHARS} characters."),
        (conversation_id < 1, "conversation_id", "Ensure this value is greater than or equal to 1."),
    )


def split_valid(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one in column ``error``)."""
    checked = rows.withColumn("error", error)
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())


def validate_documents(documents: DataFrame, allowed: tuple[str, ...] = K.UPLOAD_TYPES) -> DataFrame:
    """Adds ``error`` to rows with file_type, file_name, file_size, raw_text, source_url."""
    return documents.withColumn("error", document_error(
        F.col("file_type"), F.col("file_name"), F.col("file_size"), F.col("raw_text"), F.col("source_url"),
        allowed,
    ))
