"""Consistent weighted sampling: signatures whose collision rate is generalised Jaccard similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import column_or_null, stored, word_hash

SAMPLES = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the finaliser of the splitmix generator), in place."""
    shifted = x >> np.uint64(30)
    x ^= shifted
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=shifted)
    x ^= shifted
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=shifted)
    x ^= shifted
    return x


def _gamma_quantiles(levels: int = 65_536) -> np.ndarray:
    """Quantiles of Gamma(2, 1) in the middle of each of ``levels`` equal shares, by Newton's method."""
    share = (np.arange(levels) + 0.5) / levels
    x = np.sqrt(2 * share) + share  # near, and below the root
    for _ in range(60):
        x -= (1 - np.exp(-x) * (1 + x) - share) / (x * np.exp(-x))
        x = np.maximum(x, 1e-6)
    return x.astype(np.float32)


_GAMMA = _gamma_quantiles()
_MINUS_LOG = -np.log((np.arange(65_536) + 0.5) / 65_536).astype(np.float32)


class Sampler:
    """Ioffe's improved consistent weighted sampling of weighted terms.

    For sample d and term k there are r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), drawn from the term's hash alone.
    With weight w: t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)). The term with the least a is
    sampled, and (term, t) is the sample: two weighted sets have the same with probability sum min(w) / sum max(w).
    """

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.steps = (np.arange(samples, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def _least(self, hashes: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least ln a of every sample over the given terms, and the 16-bit code of its (term, t).

        The 64 bits of a term and sample are four uniform numbers: one for r, through its quantiles, two for c, one
        for b."""
        bits = _mixed(hashes[:, None] + self.steps).view(np.uint16).reshape(len(hashes), self.samples, 4)
        r = _GAMMA.take(bits[..., 0])
        c = _MINUS_LOG.take(bits[..., 1])
        c += _MINUS_LOG.take(bits[..., 2])
        b = bits[..., 3] * np.float32(2.0**-16)
        t = logs[:, None] / r
        t += b
        np.floor(t, out=t)
        np.log(c, out=c)
        b -= t
        b -= 1
        b *= r
        c += b
        best = c.argmin(0)
        columns = np.arange(self.samples)
        chosen = t[best, columns].astype(np.int64).view(np.uint64)
        code = _mixed(hashes[best] ^ _mixed(chosen + self.steps))
        return c[best, columns], (code >> np.uint64(48)).astype(np.uint16)

    def signature(self, terms: dict[str, int]) -> np.ndarray:
        """Codes [samples]; a set without terms has zeros, which no other set is likely to have.

        Equal sets have equal signatures: terms are taken in order of their hashes, so equal a fall alike."""
        if not terms:
            return np.zeros(self.samples, np.uint16)
        hashes = np.fromiter(map(word_hash, terms), np.uint64, len(terms))
        logs = np.log(np.fromiter(terms.values(), np.float32, len(terms)))
        order = np.argsort(hashes)
        hashes, logs = hashes[order], logs[order]
        least, codes = self._least(hashes[:256], logs[:256])
        for at in range(256, len(hashes), 256):
            a, code = self._least(hashes[at:at + 256], logs[at:at + 256])
            better = a < least
            least[better], codes[better] = a[better], code[better]
        return codes


def terms_of(text: str) -> dict[str, int]:
    """Weighted terms of a text: its words between white space, as often as they occur."""
    return Counter(text.split())


def as_text(codes: np.ndarray) -> str:
    """Four hex digits a sample."""
    return codes.astype(">u2").tobytes().hex()


def sign(rows: DataFrame, text: str = "text", name: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """``rows`` with the signature of a text column (null: empty) as hex text; nothing else changes."""

    def run(series):
        sampler = Sampler(samples)
        for texts in series:
            yield texts.map(lambda x: as_text(sampler.signature(terms_of(x or ""))))

    import pandas as pd

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(name, F.pandas_udf(run, "string")(F.col(f"`{text}`").cast("string")))


def with_follower(rows: DataFrame, run_rows: int = 2000) -> DataFrame:
    """doc_id, text, fingerprint and the text and fingerprint of the next row in descending doc_id (``next_text``,
    ``next_fingerprint``).

    ``rows`` has doc_id, text and no null text. Repeated ids are ordered by text. The last row's next is the first;
    a row without id has no place in the order and its next is the first, too (itself, if no row has an id).

    Ids are cut into ranges of about ``run_rows`` rows at their quantiles, and a range looks ahead within itself only:
    it also gets a copy of the row after it. So no task sees more than its ranges, whatever the ids are.
    """
    known, bare = rows.where(F.col("doc_id").isNotNull()), rows.where(F.col("doc_id").isNull())
    first_id, n = known.agg(F.max("doc_id"), F.count("*")).first()
    if first_id is None:
        return sign(bare).withColumns({"next_text": F.col("text"), "next_fingerprint": F.col("fingerprint")})
    pieces = max(1, min(20_000, n // run_rows))
    cuts = np.unique(np.array(known.approxQuantile("doc_id", [i / pieces for i in range(1, pieces)], 0.1 / pieces)
                              if pieces > 1 else [], np.int64))

    @F.pandas_udf("int")
    def run_of(ids):
        import pandas as pd

        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy(np.int64), "left")).astype("int32")

    placed = known.withColumn("run", run_of("doc_id"))
    heads = placed.groupBy("run").agg(F.max("doc_id").alias("doc_id"))  # a row for each run, at most 20,000
    before = heads.select(F.lag("run").over(Window.orderBy("run")).alias("before"), F.col("doc_id").alias("head"))
    last = heads.select(F.max("run").alias("before"), F.lit(first_id).alias("head"))
    needed = F.broadcast(stored(before.where("before IS NOT NULL").union(last), "run-heads"))
    copies = known.join(needed, F.col("doc_id") == F.col("head")).groupBy("before", "head").agg(F.min("text").alias("text")) \
        .select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.col("before").alias("run"))
    along = sign(placed).unionByName(sign(copies))
    order = Window.partitionBy("run").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    looked = along.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)}) \
        .where(F.col("doc_id").isNotNull()).drop("run")
    first = sign(known.where(F.col("doc_id") == first_id).agg(F.min("text").alias("text"))).select(
        F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))  # one row
    return looked.unionByName(sign(bare).crossJoin(F.broadcast(first)))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document's, in descending doc_id; see ``with_follower`` for ties and null ids. near_edited and near_next
    are the likenesses of the text's fingerprint to the edited text's and to the next document's.

    Null texts are empty ones; texts without words have a fingerprint of zeros. Equal texts have equal fingerprints.
    Repeated rows give a row each. Other columns are ignored. An empty table gives an empty table."""
    rows = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
                       F.coalesce(column_or_null(docs, "text", "string"), F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    pairs = with_follower(rows).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)).alias("text"))
    signed = sign(pairs, name="edited_fingerprint", samples=samples)

    @F.pandas_udf("double")
    def alike(a, b):
        import pandas as pd

        codes = [np.frombuffer(bytes.fromhex("".join(x)), ">u2").reshape(len(x), -1) for x in (a, b)]
        return pd.Series((codes[0] == codes[1]).mean(1)) if len(a) else pd.Series([], dtype=float)

    return signed.select(
        "doc_id", "n_chars", F.sha2("text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        alike("fingerprint", "edited_fingerprint").alias("near_edited"), alike("fingerprint", "next_fingerprint").alias("near_next"))
