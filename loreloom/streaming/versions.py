"""State for each document of a stream of changes: its newest version, and the end of its wait while it is in processing.

Versions of a document may come late, repeatedly and in any order, within a batch or batches apart. A version is let
through once, when it is newer than all seen before, so the last one let through is the newest of all: what a batch
job over the same rows takes. State holds the version's time, tie-break and status, never its text.
"""

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A document that says ``processing`` and has no newer version after so long is given up.
WAIT_MS = 3_600_000
#: Ids are hashed to so many parts. A part's ids go to the state and back together, and their newest rows of a batch are in memory
#: at once: with 10 million documents some 600 ids, about 100 KB of state.
PARTS = 16_384
NEWEST, EXPIRED = "newest", "expired"
#: Spark keeps this kind of state in this store only.
STORE = ("spark.sql.streaming.stateStore.providerClass",
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Newest(StatefulProcessor):
    """Of the ids of one part. Each call to the state is a message to Spark, so a part is asked once and told once in a batch, and
    what comes of it goes back together."""

    def __init__(self, columns: list[str], wait_ms: int):
        self._columns, self._wait_ms = columns, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # Pickled, by id: time, tie-break, status, and when the id is given up, if it is in processing.
        self._part = handle.getValueState("part", "newest binary")

    def _read(self) -> dict:
        held = self._part.get()
        return pickle.loads(bytes(held[0])) if held is not None else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept, best = self._read(), {}
        for row in rows:
            i = row["id"]
            known = kept.get(i)
            # Later times win, then smaller ties.
            if known is None or row["_us"] > known[0] or (row["_us"] == known[0] and row["_tie"] < known[1]):
                # Others of the part may wait for the same time, so a timer is never deleted: it fires for those still waiting.
                timer = row["_seen_ms"] + self._wait_ms if row["_status"] == "processing" else None
                kept[i], best[i] = (row["_us"], row["_tie"], row["_status"], timer), row
        for timer in {kept[i][3] for i in best} - {None}:
            self._handle.registerTimer(timer)
        if best:
            self._part.update((pickle.dumps(kept),))
        for row in best.values():
            yield Row(event=NEWEST, **{c: row[c] for c in self._columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept, now = self._read(), expiredTimerInfo.getExpiryTimeInMs()
        due = [i for i, (*_, timer) in kept.items() if timer is not None and timer <= now]
        if due:
            self._part.update((pickle.dumps(kept | {i: (*kept[i][:2], "failed", None) for i in due}),))
        for i in due:
            yield Row(event=EXPIRED, **{c: i if c == "id" else None for c in self._columns})


def newest_versions(changes: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """The rows of the stream ``changes`` that are newer than all earlier ones of their ``id``, with ``event`` 'newest'; and a
    row with ``event`` 'expired', the id and nulls when a document stayed in processing for ``wait_ms``.

    Versions are ordered by ``updated_at`` (none is oldest), ties by title, then by a digest of the row, so the result is
    that of any order. Rows without id are left out: nothing tells their versions apart. Time is that of arrival, which only
    grows, so no row is too late; a timer fires in the first batch after it is due in which rows arrived.
    """
    columns = changes.columns
    status = F.col("processing_status") if "processing_status" in columns else F.lit(None).cast("string")
    keyed = changes.filter(F.col("id").isNotNull()).withColumns({
        "_us": F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**63))),
        "_tie": F.concat(F.coalesce("title", F.lit("")), F.lit("\x1f"), F.sha2(F.to_json(F.struct(*columns)), 256)),
        "_status": status,
        "_seen": F.current_timestamp(),
        "_part": F.pmod(F.xxhash64("id"), F.lit(PARTS)),
    }).withColumn("_seen_ms", F.unix_millis("_seen")).withWatermark("_seen", "0 seconds")
    schema = T.StructType([T.StructField("event", T.StringType()), *[T.StructField(f.name, f.dataType, True) for f in changes.schema]])
    return keyed.groupBy("_part").transformWithState(_Newest(columns, wait_ms), schema, "Update", "EventTime")
