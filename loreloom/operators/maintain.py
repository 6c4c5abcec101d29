"""Inserts, keyed updates, link sets and cascading deletes as DataFrame in, DataFrame out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.tags import normalize_tags
from loreloom.operators.sizing import broadcast_if_bounded
from loreloom.operators.validation import split_valid
from loreloom.sources.tables import stored, with_new_ids

# Parent table -> [(child table, child's foreign key)].
FOREIGN_KEYS = {
    "users": [("documents", "owner"), ("conversations", "owner"), ("memory_entries", "owner"),
              ("nodes", "owner"), ("edges", "owner"), ("notes", "owner"), ("tasks", "owner"),
              ("goals", "owner")],
    "documents": [("document_chunks", "document_id"), ("node_documents", "document_id"),
                  ("note_documents", "document_id")],
    "document_chunks": [("message_chunks", "chunk_id")],
    "conversations": [("messages", "conversation_id")],
    "messages": [("message_chunks", "message_id")],
    "nodes": [("node_documents", "node_id"), ("edges", "source_id"), ("edges", "target_id")],
    "notes": [("note_documents", "note_id")],
}
_PARENTS_FIRST = ["users", "documents", "document_chunks", "conversations", "messages", "nodes", "notes"]


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting the rows of ``table`` whose id is in ``ids`` (column id).

    Only keys travel down the foreign keys: each child is anti-joined with the keys its
    parents lost. Tables nothing reaches come back unchanged.
    """
    lost = {table: [("id", broadcast_if_bounded(ids.select("id").distinct()))]}
    left = dict(tables)
    for parent in _PARENTS_FIRST:
        children = [(c, column) for c, column in FOREIGN_KEYS[parent] if c in tables]
        if parent not in lost or not children:
            continue
        if parent == table:
            gone_ids = lost[table][0][1]
        else:
            gone_ids = None
            for column, keys in lost[parent]:
                matched = tables[parent].join(keys.withColumnRenamed("id", column), column, "left_semi").select("id")
                gone_ids = matched if gone_ids is None else gone_ids.union(matched)
            gone_ids = gone_ids.distinct()
        for child, column in children:
            lost.setdefault(child, []).append((column, gone_ids))
    for name, conditions in lost.items():
        for column, keys in conditions:
            if name in left:
                left[name] = left[name].join(keys.withColumnRenamed("id", column), column, "left_anti")
        if name in left:
            left[name] = left[name].select(*tables[name].columns)
    return left


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows win; ``new`` rows with an unseen key are added. ``new`` is unique by key."""
    added = new.join(existing.select(*key), key, "left_anti")
    return existing.unionByName(added, allowMissingColumns=True)


def first_per_key(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """First row per key in ``order``. An aggregate, so a hot key is reduced before the shuffle."""
    picked = F.min(F.struct(*order, *values)).alias("_first")
    return rows.groupBy(*key).agg(picked).select(*key, "_first.*")


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Set union of two link tables."""
    return links.unionByName(new).distinct()


def replace_links(links: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Each parent in ``parents`` (column ``key``) gets exactly its rows of ``new``."""
    replaced = broadcast_if_bounded(parents.select(key).distinct())
    return links.join(replaced, key, "left_anti").unionByName(new)


def _one_patch_per_row(patches: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Several patches of a row become one: each field has the value of the last patch that names it. Last is the
    greatest ``patched_at``, where patches have one; patches that tie are ordered by their values."""
    at = [F.col("patched_at")] if "patched_at" in patches.columns else []

    def last(column: str) -> Column:
        # Values of any type that can be ordered; the names break ties of equal values.
        named = F.array_contains("fields", column)
        order = F.when(named, F.struct(*at, F.col(column).isNotNull().alias("_given"), F.col(column).alias("_value")))
        return F.max_by(F.struct(F.col(column).alias("v")), order)["v"].alias(f"_{column}")

    return patches.groupBy(*key).agg(
        F.array_distinct(F.flatten(F.collect_set("fields"))).alias("_fields"), *[last(c) for c in columns])


def partial_update(base: DataFrame, patches: DataFrame, columns: list[str], as_of: Column,
                   owned: bool = True) -> DataFrame:
    """Apply patches: id, [owner], ``fields`` (names given), the new values and optionally patched_at.

    A named field takes the patch value even when that is null. Patches for unknown or foreign rows change nothing,
    and several for one row are one (``_one_patch_per_row``). Array column ``tags`` is normalised again.
    """
    key = ["id", "owner"] if owned else ["id"]
    patch = stored(_one_patch_per_row(patches, key, columns), "patches")
    joined = base.join(broadcast_if_bounded(patch), key, "left")

    def value(column: str) -> Column:
        new = F.col(f"_{column}")
        if column == "tags":
            new = normalize_tags(new)
        given = F.coalesce(F.array_contains("_fields", column), F.lit(False))
        return F.when(given, new).otherwise(F.col(column)).alias(column)

    touched = F.when(F.col("_fields").isNotNull(), as_of).otherwise(F.col("updated_at")).alias("updated_at")
    return joined.select(*[
        value(c) if c in columns else touched if c == "updated_at" else F.col(c) for c in base.columns
    ])


def _stamped(rows: DataFrame, owner: Column, as_of: Column, existing: DataFrame | None) -> DataFrame:
    """With owner and times, and an id where the rows have none: the ids after those of ``existing``, the stored
    table."""
    stamped = rows.withColumns({"owner": owner, "created_at": as_of, "updated_at": as_of})
    return stamped if "id" in rows.columns else with_new_ids(stamped, existing)


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fill missing columns, and nulls in present ones, from ``defaults``."""
    return rows.withColumns({
        name: F.coalesce(F.col(name), value) if name in rows.columns else value
        for name, value in defaults.items()
    })


def new_memory_entries(rows: DataFrame, owner: Column, as_of: Column, source: str = "manual",
                       existing: DataFrame | None = None) -> DataFrame:
    filled = with_defaults(rows, {
        "category": F.lit("note"), "tags": F.array().cast("array<string>"), "is_pinned": F.lit(False),
        "source": F.lit(source),
    })
    return _stamped(filled, owner, as_of, existing).withColumn("tags", normalize_tags(F.col("tags")))


def new_tasks(rows: DataFrame, owner: Column, as_of: Column, existing: DataFrame | None = None) -> DataFrame:
    return _stamped(with_defaults(rows, {
        "description": F.lit(""), "status": F.lit("pending"), "priority": F.lit("medium"),
        "due_date": F.lit(None).cast("timestamp"),
    }), owner, as_of, existing)


def new_goals(rows: DataFrame, owner: Column, as_of: Column, existing: DataFrame | None = None) -> DataFrame:
    return _stamped(with_defaults(rows, {
        "description": F.lit(""), "target_date": F.lit(None).cast("date"), "progress": F.lit(0),
        "is_completed": F.lit(False),
    }), owner, as_of, existing)


def note_error(title: Column, content: Column) -> Column:
    """The form refuses notes without title or content."""
    return F.when(F.coalesce(title, F.lit("")) == "", F.struct(F.lit("title").alias("field"), F.lit(K.FIELD_REQUIRED).alias("message"))) \
        .when(F.coalesce(content, F.lit("")) == "", F.struct(F.lit("content").alias("field"), F.lit(K.FIELD_REQUIRED).alias("message")))


def new_notes(rows: DataFrame, owner: Column, as_of: Column, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new notes, refused rows with ``error``)."""
    good, refused = split_valid(rows, note_error(F.col("title"), F.col("content")))
    return _stamped(good, owner, as_of, existing), refused


def toggled_status(status: Column) -> Column:
    return F.when(status == "completed", "pending").otherwise("completed")


def goal_progress(progress: Column, is_completed: Column) -> Column:
    """Completed goals stand at 100; others keep their value within 0..100."""
    return F.when(is_completed, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), progress)))
