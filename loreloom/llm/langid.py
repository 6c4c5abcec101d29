"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.llm.common import column_or_null, text_batches

#: Bytes the network reads at a time. A longer text is read window by window, all of it.
WINDOW = 128
#: Windows that go through the network together.
LANES = 2048


@dataclass
class Network:
    """Weights, by direction (0 reads forwards, 1 backwards). H units, V byte values, C languages.

    ``inp`` [V, 3H] are the byte's contributions to update gate, reset gate and candidate (bias included),
    ``rec`` [H, 3H] those of the state, ``out`` [2H, C] and ``bias`` [C] label a position.
    """

    languages: list[str]
    inp: list[np.ndarray]
    rec: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    units: int = field(default=0)

    @classmethod
    def fresh(cls, languages: list[str], units: int, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        net = cls(languages, [draw(256, 3 * units) for _ in range(2)], [draw(units, 3 * units) for _ in range(2)],
                  draw(2 * units, len(languages)), np.zeros(len(languages), np.float32), units)
        for table in net.inp:
            table[:, :units] -= 1.0  # states change slowly at first
        return net

    def parameters(self) -> list[np.ndarray]:
        return [*self.inp, *self.rec, self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _states(net: Network, octets: np.ndarray, turn: int) -> tuple[np.ndarray, list]:
    """States [steps + 1, B, H] of one direction over octets [steps, B] in reading order, and what the backward
    pass needs."""
    h = net.units
    states = np.zeros((len(octets) + 1, octets.shape[1], h), np.float32)
    kept = []
    for t, read in enumerate(octets):
        x, prev = net.inp[turn][read], states[t]
        gates = _sigmoid(x[:, :2 * h] + prev @ net.rec[turn][:, :2 * h])
        z, r = gates[:, :h], gates[:, h:]
        c = np.tanh(x[:, 2 * h:] + (r * prev) @ net.rec[turn][:, 2 * h:])
        states[t + 1] = prev + z * (c - prev)
        kept.append((z, r, c))
    return states, kept


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(net: Network, octets: np.ndarray, weights: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions' labels, and its gradients by backpropagation through time.

    octets [steps, B]; weights [steps, B] is 0 at padding; target [B] is each window's language."""
    h = net.units
    forward, kept_f = _states(net, octets, 0)
    backward, kept_b = _states(net, octets[::-1], 1)
    both = np.concatenate([forward[1:], backward[1:][::-1]], 2)
    p = _softmax(both @ net.out + net.bias)
    total = max(weights.sum(), 1.0)
    picked = np.take_along_axis(p, np.broadcast_to(target[None, :, None], (*octets.shape, 1)), 2)[..., 0]
    loss = float(-(np.log(picked + 1e-9) * weights).sum() / total)
    d = p.copy()
    np.put_along_axis(d, np.broadcast_to(target[None, :, None], (*octets.shape, 1)), picked[..., None] - 1, 2)
    d *= (weights / total)[..., None]
    flat = both.reshape(-1, 2 * h)
    grads_out, grads_bias = flat.T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))
    d_both = d @ net.out.T
    grads_inp, grads_rec = [], []
    for turn, states, kept, read, d_states in ((0, forward, kept_f, octets, d_both[..., :h]),
                                               (1, backward, kept_b, octets[::-1], d_both[::-1, :, h:])):
        rec = net.rec[turn]
        g_inp, g_rec = np.zeros_like(net.inp[turn]), np.zeros_like(rec)
        carry = np.zeros_like(states[0])
        for t in range(len(read) - 1, -1, -1):
            z, r, c = kept[t]
            prev = states[t]
            dh = d_states[t] + carry
            da_c = dh * z * (1 - c * c)
            d_rp = da_c @ rec[:, 2 * h:].T
            da_z = dh * (c - prev) * z * (1 - z)
            da_r = d_rp * prev * r * (1 - r)
            da = np.concatenate([da_z, da_r, da_c], 1)
            carry = dh * (1 - z) + d_rp * r + da[:, :2 * h] @ rec[:, :2 * h].T
            g_rec[:, :2 * h] += prev.T @ da[:, :2 * h]
            g_rec[:, 2 * h:] += (r * prev).T @ da_c
            np.add.at(g_inp, read[t], da)
        grads_inp.append(g_inp)
        grads_rec.append(g_rec)
    return loss, [*grads_inp, *grads_rec, grads_out, grads_bias]


def windows_of(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """octets [width, n] of all windows of all texts, valid [n] bytes in each, owner [n] of each. Every byte is in
    one window; the last windows are filled up with spaces."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // width)
    owner = np.repeat(np.arange(len(texts)), counts)
    filled = np.full(int(counts.sum()) * width, 32, np.uint8)
    start = (np.cumsum(counts) - counts) * width
    for at, text in zip(start.tolist(), texts, strict=True):
        filled[at:at + len(text)] = np.frombuffer(text, np.uint8)
    valid = np.full(len(owner), width, np.int64)
    last = np.cumsum(counts) - 1
    has = counts > 0
    valid[last[has]] = (sizes - (counts - 1) * width)[has]
    return np.ascontiguousarray(filled.reshape(-1, width).T), valid, owner


def train(samples: list[tuple[bytes, str]], units: int = 8, epochs: int = 4, batch: int = 64, rate: float = 0.01,
          seed: int = 0) -> Network:
    """Fit by Adam on (text, language) pairs, every position of a text labelled with the text's language.

    No sample gives a network without languages, which predicts ``und`` for every text."""
    languages = sorted({lang for _, lang in samples})
    net = Network.fresh(languages, units, seed)
    octets, valid, owner = windows_of([text for text, _ in samples])
    if not len(owner):
        return net
    target = np.array([languages.index(lang) for _, lang in samples], np.int64)[owner]
    weights = (np.arange(WINDOW)[:, None] < valid[None, :]).astype(np.float32)
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    steps, total = 0, epochs * -(-len(owner) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(owner))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            _, grads = gradients(net, octets[:, chosen], weights[:, chosen], target[chosen])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            steps += 1
            pace = rate * (1 - 0.9 * steps / total)
            for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """A network laid out for reading many windows: arrays are [units, windows], gates' halving of the sigmoid's
    argument is in the weights."""

    def __init__(self, net: Network):
        h = net.units
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
        self.h, self.n = h, len(net.languages)
        self.inp = [np.ascontiguousarray((x * half).T) for x in net.inp]
        # The gate r is (1 + tanh) / 2: the candidate's weights take the half of it.
        self.gates = [np.ascontiguousarray((x * half)[:, :2 * h].T) for x in net.rec]
        self.cand = [np.ascontiguousarray(0.5 * x[:, 2 * h:].T) for x in net.rec]
        self.out = [np.ascontiguousarray(net.out[:h].T), np.ascontiguousarray(net.out[h:].T)]
        self.bias = net.bias[:, None]

    def _direction(self, octets: np.ndarray, turn: int, logits: np.ndarray, backwards: bool) -> None:
        h, lanes = self.h, octets.shape[1]
        state = np.zeros((h, lanes), np.float32)
        x = np.empty((3 * h, lanes), np.float32)
        gate = np.empty((2 * h, lanes), np.float32)
        c, label = np.empty((h, lanes), np.float32), np.empty((self.n, lanes), np.float32)
        for t in range(len(octets) - 1, -1, -1) if backwards else range(len(octets)):
            np.take(self.inp[turn], octets[t], axis=1, out=x, mode="clip")
            np.matmul(self.gates[turn], state, out=gate)
            gate += x[:2 * h]
            np.tanh(gate, out=gate)
            gate += 1.0
            z, r = gate[:h], gate[h:]
            r *= state
            np.matmul(self.cand[turn], r, out=c)
            c += x[2 * h:]
            np.tanh(c, out=c)
            c -= state
            c *= z
            c *= 0.5
            state += c
            np.matmul(self.out[turn], state, out=label)
            logits[t] += label

    def positions(self, octets: np.ndarray) -> np.ndarray:
        """Probabilities [steps, languages, windows] of every position."""
        logits = np.empty((len(octets), self.n, octets.shape[1]), np.float32)
        logits[:] = self.bias
        self._direction(octets, 0, logits, False)
        self._direction(octets, 1, logits, True)
        np.clip(logits, -60, 60, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of all positions' probabilities, and counts of positions labelled, by text and language."""
        sums, counts = np.zeros((len(texts), self.n)), np.zeros((len(texts), self.n), np.int64)
        octets, valid, owner = windows_of(texts)
        for at in range(0, len(owner), LANES):
            part, size, own = octets[:, at:at + LANES], valid[at:at + LANES], owner[at:at + LANES]
            p = self.positions(np.ascontiguousarray(part).astype(np.intp))
            best = p.argmax(1)
            short = np.flatnonzero(size < len(part))
            for i in short:
                p[size[i]:, :, i] = 0
                best[size[i]:, i] = -1
            np.add.at(sums, own, p.sum(0).T)
            for k in range(self.n):
                np.add.at(counts[:, k], own, (best == k).sum(0))
        return sums, counts


def bounded_sample(docs: DataFrame, usable: Column, per_language: int = 250, chars: int = 1024,
                   text: str = "text", lang: str = "lang", identifier: str = "doc_id") -> list[tuple[bytes, str]]:
    """At most ``per_language`` texts of each language of the usable rows, a stretch of ``chars`` code points each.

    The rows with the least hash of identifier and text are taken; where in a text the stretch begins depends on the
    hash too. Rows without language or text don't count."""
    rows = docs.select(column_or_null(docs, text, "string").alias("text"), column_or_null(docs, lang, "string").alias("lang"),
                       column_or_null(docs, identifier, "string").alias("id"), usable.alias("usable")) \
        .where(F.col("usable") & F.col("lang").isNotNull() & (F.length("text") > 0)) \
        .withColumn("order", F.xxhash64("id", F.length("text")))
    first = F.pmod("order", F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    ranked = rows.select("lang", "order", F.substring("text", first, F.lit(chars)).alias("text")) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text")))
    return [(r.text.encode(), r.lang) for r in
            ranked.where(F.col("rank") <= per_language).orderBy("lang", "rank").toLocalIterator()]


def identify(docs: DataFrame, net: Network, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct ``name``: lang_pred, score, positions.

    Every byte of the whole text is labelled; probabilities are averaged over the text and the largest is score, its
    language lang_pred. ``positions`` is the number of bytes labelled with each language. A text that is null, or
    has no letter, is ``und`` with score 0. Equal probabilities: the language first in alphabetical order. Rows and
    other columns are unchanged; an empty table stays empty."""
    result = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("positions", T.MapType(T.StringType(), T.LongType()))])
    column = F.col(f"`{text}`").cast("string")

    def run(series):
        import pandas as pd

        reader = Reader(net)
        for texts in series:
            batch = pa.record_batch({"text": pa.array(texts, pa.string(), from_pandas=True)})
            found = []
            for _, run_of in text_batches(batch, "text", 1_000_000):
                if not net.languages:
                    found += [(None, None, None)] * len(run_of)
                    continue
                octets = [x.encode("utf-8", "surrogatepass") for x in run_of]
                sums, counts = reader.pooled(octets)
                for i, x in enumerate(octets):
                    best = int(sums[i].argmax())
                    found.append((net.languages[best], min(1.0, float(sums[i, best] / max(len(x), 1))),
                                  {k: int(n) for k, n in zip(net.languages, counts[i], strict=True)}))
            yield pd.DataFrame(found, columns=["lang_pred", "score", "positions"])

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    labelled = F.pandas_udf(run, result)(column)
    return docs.withColumn(name, labelled).withColumn(name, F.when(
        F.coalesce(column.rlike(r"\p{L}"), F.lit(False)) & F.col(f"`{name}`.lang_pred").isNotNull(), F.col(f"`{name}`")).otherwise(
            F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.create_map().cast("map<string,bigint>").alias("positions"))))


def held_out(identifier: Column) -> Column:
    """True for the third of the documents that learning leaves out; null identifiers aren't in it."""
    return F.coalesce(F.crc32(identifier.cast("string")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, per_language: int = 250, chars: int = 1024) -> Network:
    """A network learnt from text and lang of the documents that aren't held out."""
    identifier = column_or_null(docs, "doc_id", "string")
    return train(bounded_sample(docs, identifier.isNotNull() & ~held_out(identifier), per_language, chars))


def with_known_language(docs: DataFrame, net: Network | None = None, least_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text has a language: letters, and a score of ``least_score`` or more. Columns are
    kept.

    Where nothing could be learnt, as no row has a language, all texts with a letter are kept."""
    net = net or fitted(docs)
    if not net.languages:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    name = "_language" + "_" * max(map(len, docs.columns))
    return identify(docs, net, name=name).where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least_score)).drop(name)


def predict_languages(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, positions of every document; see ``identify``.

    Repeated rows give a row each. Without ``net`` one is learnt from ``docs``; if no row has a language, all are
    ``und``."""
    rows = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    labelled = identify(rows, net or fitted(docs))
    return labelled.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score",
                           "language.positions")
