"""URL filters: host and path rules, and exact list membership by a cascade of Bloom filters."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import column_or_null, stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (verdict, host, path): fixed values of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts with such a label are on the list of the registered query.
AD_HOST = r"(^|[.-])(ads?|track(er|ing)?)([.-]|$)"
#: Bytes of one cascade's first filter that may be broadcast; beyond, keys are split over several cascades.
MOST_BYTES = 64 << 20


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; '' without ``://``
    or for null."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, fields null if none does. A rule fits its host and all
    subdomains of it, if the path starts with the rule's path. Rules are a short list: one expression holds them."""
    result = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        result = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(result)
    return result


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """One Bloom filter: ``bits`` of them, ``hashes`` for a key. ``number`` makes its hashes independent of other
    levels'."""

    number: int
    bits: int
    hashes: int
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @classmethod
    def sized(cls, number: int, keys: int, rate: float) -> Level:
        bits = max(64, math.ceil(-keys * math.log(rate) / math.log(2) ** 2))
        return cls(number, bits, max(1, round(bits / max(keys, 1) * math.log(2))) if keys else 1)

    def places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Bit numbers [keys, hashes] for the keys' two 64-bit hashes."""
        shift = np.uint64(self.number * 0x9E3779B97F4A7C15 % 2**64)
        a, b = _mixed(first + shift), _mixed(second ^ shift) | np.uint64(1)
        return (a[:, None] + np.arange(self.hashes, dtype=np.uint64) * b[:, None]) % np.uint64(self.bits)

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = self.places(first, second)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(1)


def listed(levels: list[Level], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Exact membership of keys of the universe the cascade was built for."""
    open_, result = np.ones(len(first), bool), np.zeros(len(first), bool)
    for level in levels:
        at = np.flatnonzero(open_)
        passed = level.holds(first[at], second[at])
        # What an even level lacks isn't listed; what an odd one lacks is.
        result[at[~passed]] = level.number % 2 == 1
        open_[at[~passed]] = False
    result[open_] = len(levels) % 2 == 1
    return result


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit("first"), key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _arrays(batch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(n)).to_numpy().view(np.uint64) for n in ("h1", "h2"))


def _filled(level: Level, keys: DataFrame) -> Level:
    """The filter of all ``keys`` (h1, h2): each task sets the bits of its keys, and words are joined by a bitwise
    or."""
    def run(batches):
        words = np.zeros(-(-level.bits // 64), np.uint64)
        for batch in batches:
            at = level.places(*_arrays(batch)).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["at", "word"])

    # Its size was checked by the caller: bits / 64 rows.
    got = keys.select("h1", "h2").mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(-(-level.bits // 64), np.uint64)
    words[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return Level(level.number, level.bits, level.hashes, words)


def build(universe: DataFrame) -> list[Level]:
    """Cascade for (h1, h2, listed), a row for each key of the universe.

    The first filter holds the listed keys, the second those unlisted ones that the first lets through, the third
    the listed ones that the second lets through, and so on until none is. The rates are those that make the whole
    smallest: the first by the ratio of listed to other keys, then a half."""
    counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    inside, outside = universe.where("listed"), universe.where("NOT listed")
    held, others = counts.get(True, 0), counts.get(False, 0)
    levels: list[Level] = []
    while True:
        rate = 0.5 if levels else min(0.5, max(1e-6, held * math.sqrt(0.5) / max(others, 1)))
        level = _filled(Level.sized(len(levels), held, rate), inside)
        levels.append(level)
        passed = stored(_passing(level, outside), "passed")
        inside, outside, held = passed, inside, passed.count()
        if not held:
            return levels
        if len(levels) == 100:
            raise RuntimeError("two keys of the universe have equal hashes")


def _passing(level: Level, keys: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(level.holds(*_arrays(batch))))

    return keys.select("h1", "h2").mapInArrow(run, "h1 bigint, h2 bigint")


def with_membership(rows: DataFrame, key: str, is_listed: Column, name: str = "listed", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with a boolean ``name``: whether the key column's value is listed. ``is_listed`` is an expression
    over ``key`` that says so for a key; it is asked once for each distinct key, the universe.

    Rows are answered by the cascade alone, without a join: it is broadcast in the tasks' closure, and its size,
    which follows from the number of listed keys, is checked first. If it would have more than ``most_bytes``, keys
    are split by hash over several cascades; then the distinct keys are answered cascade by cascade and their
    answers are joined to the rows. A null key is the key ''. An empty table stays empty."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    universe = stored(rows.select(text.alias(key)).distinct().select(
        key, *_hashes(F.col(key)), F.coalesce(is_listed, F.lit(False)).alias("listed")), "universe")
    held = universe.where("listed").count()
    # 32 bits a key are more than any rate above takes; later levels are smaller.
    splits = max(1, -(-held * 4 // most_bytes))
    if splits == 1:
        levels = build(universe)

        @F.pandas_udf("boolean")
        def answer(h1, h2):
            import pandas as pd

            return pd.Series(listed(levels, h1.to_numpy(np.int64).view(np.uint64), h2.to_numpy(np.int64).view(np.uint64)))

        h1, h2 = _hashes(text)
        return rows.withColumn(name, answer(h1, h2))
    answered = None
    for split in range(splits):
        own = universe.where(F.pmod("h1", F.lit(splits)) == split)
        part = own.select("h1", "h2").mapInArrow(_answers(build(own)), "h1 bigint, h2 bigint, answer boolean")
        answered = part if answered is None else answered.unionByName(part)
    answered = stored(answered, "answers")
    return rows.withColumns({"_h1": _hashes(text)[0], "_h2": _hashes(text)[1]}).join(
        answered.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("answer").alias(name)), ["_h1", "_h2"]).drop("_h1", "_h2")


def _answers(levels: list[Level]):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed(levels, *_arrays(batch)))], names=["h1", "h2", "answer"])

    return run


def judge_pages(pages: DataFrame, rules=RULES, list_pattern: str = AD_HOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page: the longest fitting rule's verdict, else ``block`` for
    hosts on the list (here: hosts of the pages that match ``list_pattern``) and ``allow`` for the others.

    A null url, or one without ``://``, has an empty host and path. Repeated rows give a row each; null ids stay
    null; other columns are ignored. An empty table gives an empty table."""
    url = column_or_null(pages, "url", "string")
    rows = pages.select(column_or_null(pages, "page_id", "bigint").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path")) \
        .withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    found = with_membership(rows, "host", F.col("host").rlike(list_pattern), "listed", most_bytes)
    rule = ruled(F.col("host"), F.col("path"), rules)
    return found.withColumn("found", rule).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


ORACLE = f"""
WITH rests AS (
    SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
    FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_UPPER.lower()}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '{AD_HOST}') THEN 'block'
    ELSE 'allow'
END AS verdict
FROM ruled
"""
