"""Uploaded files: text, DOCX, and formats decoded by a plug-in such as a PDF reader."""

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.constants import BLANKS

EXTRACTED = "struct<text:string,error:string>"
# Files of a batch whose bytes and texts are Python objects at once.
DECODED_AT_ONCE = 256

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, content, file_size of every file below ``path``."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(F.col("path").alias("file"), "content", F.col("length").alias("file_size"))
    )


def _paragraph_text(paragraph) -> str:
    out = []
    for element in paragraph.iter():
        if element.tag == f"{_W}t":
            out.append(element.text or "")
        elif element.tag == f"{_W}tab":
            out.append("\t")
        elif element.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def docx_lines(content: bytes) -> str:
    """Non-blank body paragraphs, then non-blank table cells row by row, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    parts = [_paragraph_text(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        above: dict[int, str] = {}
        for row in table.findall(f"{_W}tr"):
            column = 0
            for cell in row.findall(f"{_W}tc"):
                # A merged cell's text stands at each place it covers.
                span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
                goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue"
                text = "\n".join(_paragraph_text(p) for p in cell.findall(f"{_W}p"))
                for _ in range(int(span.get(f"{_W}val", "1")) if span is not None else 1):
                    text = above.get(column, text) if goes_on else text
                    above[column] = text
                    parts.append(text)
                    column += 1
    return "\n".join(part.strip(BLANKS) for part in parts if part.strip(BLANKS))


def decoder_column(content: Column, decode: Callable[[bytes], str], failure: str) -> Column:
    """struct(text, error) from a ``bytes -> str`` plug-in; an exception becomes error text. A batch is decoded a few files at a
    time: beside its bytes, a worker holds its texts once."""

    def one(data):
        if data is None:
            return None, f"{failure}: no content"
        try:
            return decode(bytes(data)), None
        except Exception as reason:
            return None, f"{failure}: {reason}"

    @F.arrow_udf(EXTRACTED)
    def run(batch: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.struct([("text", pa.string()), ("error", pa.string())]))]
        for start in range(0, len(batch), DECODED_AT_ONCE):
            texts, errors = zip(*[one(data.as_py()) for data in batch.slice(start, DECODED_AT_ONCE)], strict=True)
            parts.append(pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["text", "error"]))
        return pa.concat_arrays(parts)

    return run(content)
