"""Document row to text, by file type. Failures are a column."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.text import decode_utf8, normalize_text
from loreloom.sources.files import decoder_column, docx_lines


def extract_text(documents: DataFrame, decoders: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Adds ``text`` and ``error``, one of them null.

    Reads raw_text of notes and ``content`` (binary) of file-backed types. Notes, text files
    and refusals never leave the JVM; Python sees the files of a decoded type only.
    """
    decoders = {"docx": docx_lines, **(decoders or {})} if "content" in documents.columns else {}
    kind = F.col("file_type")
    file_text = decode_utf8(F.col("content")) if "content" in documents.columns else F.lit(None).cast("string")
    raw = F.when(kind == "note", F.col("raw_text")).when(kind == "txt", file_text)
    failed = F.when(kind == "link", K.LINK_UNSUPPORTED).when(
        kind.isNull() | ~kind.isin("note", "txt", *decoders),
        F.concat(F.lit(K.UNSUPPORTED_TYPE), F.coalesce(kind, F.lit("None"))))
    empty = F.when(kind == "note", K.EMPTY_NOTE).when(kind == "txt", K.EMPTY_TXT)
    empties = {"pdf": K.EMPTY_PDF, "docx": K.EMPTY_DOCX}
    rows = documents
    for name in sorted(decoders):
        # One pass for all types: a decoder gets nothing but the files of its type.
        out = decoder_column(F.when(kind == name, F.col("content")), decoders[name], f"Failed to extract {name.upper()} text")
        rows = rows.withColumn(f"_out_{name}", out)
        raw = raw.when(kind == name, F.col(f"_out_{name}.text"))
        failed = failed.when(kind == name, F.col(f"_out_{name}.error"))
        empty = empty.when(kind == name, F.lit(empties.get(name, f"{name.upper()} file contains no text.")))
    rows = rows.withColumns({"_raw": normalize_text(raw), "_failed": failed})
    return rows.withColumns({
        "error": F.when(F.col("_failed").isNotNull(), F.col("_failed")).when(F.col("_raw") == "", empty),
        "text": F.when(F.col("_failed").isNull() & (F.col("_raw") != ""), F.col("_raw")),
    }).drop("_raw", "_failed", *[f"_out_{name}" for name in decoders])
