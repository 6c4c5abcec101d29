"""Text expressions. All of them stay JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom import constants as K

# The blanks again. The look-ahead rejects a printable ASCII character in one test, and blanks
# below 256 are listed one by one because the regex engine keeps those in a bit set.
_WORD_GAP = (
    r"(?![!-~])[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"\u1680\u2000-\u200a\u2028-\u2029\u202f\u205f\u3000]+"
)
_LINE_GAP = f"[{K.LINE_ENDS}]+"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda body is re-evaluated per element, so an expensive expression
    captured by it would be too; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(K.BLANKS))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def normalize_text(text: Column) -> Column:
    """Stripped, non-blank lines joined by a newline; null becomes ''."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), _LINE_GAP), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def decode_utf8(content: Column) -> Column:
    """Bytes to text; invalid sequences become U+FFFD instead of an error."""
    return F.make_valid_utf8(content.cast("string"))


def words(text: Column) -> Column:
    stripped = strip(F.coalesce(text, F.lit("")))
    empty = F.array().cast("array<string>")
    return F.when(stripped == "", empty).otherwise(F.split(stripped, _WORD_GAP))


def chunk_window(size: int | None = None, overlap: int | None = None) -> tuple[int, int]:
    """Resolve (size, step). 0 and None mean the default for either value."""
    size = size or K.CHUNK_SIZE
    overlap = overlap or K.CHUNK_OVERLAP
    if size < 1 or overlap < 0:
        raise ValueError("chunk size must be positive and overlap must not be negative")
    if overlap >= size:
        overlap = size // 5
    return size, size - overlap


def chunk_texts(text: Column, size: int | None = None, overlap: int | None = None) -> Column:
    """Overlapping word windows of ``text`` as an array of strings."""
    size, step = chunk_window(size, overlap)

    def windows(tokens: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / F.lit(step)).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(tokens, i * step + 1, F.lit(size)), " "),
        )

    empty = F.array().cast("array<string>")
    return bind(words(text), lambda tokens: F.when(F.size(tokens) == 0, empty).otherwise(windows(tokens)))


def prefix(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def truncate(text: Column, length: int) -> Column:
    """At most ``length`` characters, cut back to the last space and marked with '...'."""
    value = F.coalesce(text, F.lit(""))
    cut = F.regexp_replace(prefix(value, length), r" [^ ]*\z", "")
    return F.when(F.length(value) <= length, value).otherwise(F.concat(cut, F.lit("...")))


def default_if_empty(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def contains_ignore_case(text: Column, term: Column) -> Column:
    """Literal, case-insensitive substring test; null text never matches."""
    return F.coalesce(F.contains(F.lower(text), F.lower(term)), F.lit(False))


def file_suffix(name: Column) -> Column:
    """Last extension with its dot, lower-cased; '' when there is none."""
    base = F.regexp_extract(F.regexp_replace(name, "/+$", ""), "([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))


def upload_type(file_name: Column) -> Column:
    """Type the upload form infers from the file name."""
    return (
        F.when(file_name.isNull(), "note")
        .when(F.endswith(F.lower(file_name), F.lit(".txt")), "txt")
        .otherwise("pdf")
    )


def is_submittable(title: Column, file_name: Column, raw_text: Column) -> Column:
    return ~is_blank(title) & (file_name.isNotNull() | ~is_blank(raw_text))


def percent(score: Column) -> Column:
    return F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%"))


def relationship_label(code: Column) -> Column:
    """First underscore shown as a space."""
    return F.regexp_replace(code, "^([^_]*)_", "$1 ")


def enum_label(code: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), code)


def day_of(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def conversation_label(conversation_id: Column, title: Column, fallback: str | None = None) -> Column:
    """Title, or ``fallback`` / 'Conversation <id>' when it is empty."""
    other = F.lit(fallback) if fallback else F.concat(F.lit("Conversation "), conversation_id.cast("string"))
    return F.coalesce(F.nullif(title, F.lit("")), other)


def chunk_label(document_title: Column, chunk_index: Column) -> Column:
    return F.concat(document_title, F.lit(" - Chunk "), chunk_index.cast("string"))


def message_label(role: Column, content: Column) -> Column:
    return F.concat(role, F.lit(": "), prefix(content, K.MESSAGE_LABEL_CHARS))


def node_label(title: Column, node_type: Column) -> Column:
    return F.concat(title, F.lit(" ("), node_type, F.lit(")"))


def edge_label(source_title: Column, relationship_type: Column, target_title: Column) -> Column:
    return F.concat(source_title, F.lit(" --["), relationship_type, F.lit("]--> "), target_title)


def document_caption(file_type: Column, chunk_count: Column) -> Column:
    return F.concat(F.upper(file_type), F.lit(" · "), chunk_count.cast("string"), F.lit(" chunks"))
