"""Packing documents into sequences of bounded length by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import column_or_null, remembered, stored, text_batches

#: Space to Python, but perhaps a mark to a tokenizer.
_OTHER_SPACE = re.compile("[\x0b-\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CAPACITY = 2048
END = 0
#: Pieces that one genetic algorithm packs.
BLOCK_PIECES = 3000
ISLANDS = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others
    for the letters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Tokenizer:
    """Token ids of texts. Merges and normal forms never reach across a blank or a line break, so a text's ids are
    those of its stretches between them, and those of frequent stretches are remembered. Nor do they reach from
    letters to the marks after them, and letters are lower-cased one by one: so a Latin word is looked up without
    its marks and capitals, and its merges are asked for directly."""

    MARKS = ".,;:!?$%#&*"

    def __init__(self, path: str, remember: int = 400_000):
        self.model = shared_model(path)
        self.merges = self.model.model.tokenize
        self.letters = _byte_letters()
        self.known = remembered(self._encode, remember)

    def _encode(self, stretch: str) -> bytes:
        core = stretch.rstrip(self.MARKS)
        if core and core.isalpha() and max(core) < "\u0250" and len(plain := core.lower()) == len(core):
            if plain != stretch:
                marks = stretch[len(core):]
                return self.known[plain] + (self.known[marks] if marks else b"")
            word = plain if plain.isascii() else "".join(map(self.letters.__getitem__, plain.encode()))
            return array("I", [t.id for t in self.merges(word)]).tobytes()
        return array("I", self.model.encode(stretch, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if _OTHER_SPACE.search(text):
            words = [x for x in text.replace("\n", " ").split(" ") if x]
        else:
            words = text.split()
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")


@cache
def shared_model(path: str):
    """One for all tasks of a worker process: reading the vocabulary takes longer than a small task."""
    from tokenizers import Tokenizer as Model

    return Model.from_file(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids and the end id 0, cut every ``capacity``
    ids.

    Null and empty texts are one piece of the end id alone. Repeated rows and rows without id have pieces of their
    own."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        model = Tokenizer(path)  # what it remembers, about 250 bytes a word, goes with the task
        for batch in batches:
            identifiers = batch.column(0)
            for start, texts in text_batches(batch, "text"):
                out = []
                for i, text in enumerate(texts):
                    ids = np.append(model.ids(text), np.uint32(END)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at:at + capacity]
                        out.append((start + i, k, at, len(part), zlib.crc32(part.tobytes())))
                place, *rest = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([identifiers.take(place), rest[0].cast(pa.int32()), *rest[1:]],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


Bins = list[list[int]]


def best_fit(bins: Bins, free: list[int], loose: list[int], sizes: list[int], capacity: int) -> None:
    """Put the loose pieces, largest first, each into the bin with the least room that takes it; else into a new
    bin."""
    rooms = sorted((room, b) for b, room in enumerate(free) if room)
    for piece in sorted(loose, key=lambda p: (-sizes[p], p)):
        at = bisect_left(rooms, (sizes[piece], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(piece)
        else:
            room, b = capacity, len(bins)
            bins.append([piece])
            free.append(capacity)
        free[b] = room - sizes[piece]
        if free[b]:
            insort(rooms, (free[b], b))


def _rooms(bins: Bins, sizes: list[int], capacity: int) -> list[int]:
    return [capacity - sum(sizes[p] for p in b) for b in bins]


def fitness(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals the one whose bins differ most, full ones and nearly empty ones."""
    return len(bins), -sum(((capacity - room) / capacity) ** 2 for room in _rooms(bins, sizes, capacity))


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """A child of a: whole well-filled bins of b are injected; bins of a that hold a piece of them are dissolved,
    and so are a few of a's worst; the pieces that this displaces are put back by best fit."""
    rooms_b, rooms_a = _rooms(b, sizes, capacity), _rooms(a, sizes, capacity)
    full = sorted(range(len(b)), key=lambda i: (rooms_b[i], rng.random()))
    share = max(1, len(b) // 4)
    injected = [b[i] for i in rng.sample(full[:2 * share], min(share, len(full)))]
    taken = {p for bin_ in injected for p in bin_}
    worst = set(sorted(range(len(a)), key=lambda i: (-rooms_a[i], i))[:rng.randint(1, max(2, len(a) // 20))])
    child, loose = [list(x) for x in injected], []
    for i, bin_ in enumerate(a):
        if i in worst or any(p in taken for p in bin_):
            loose += [p for p in bin_ if p not in taken]
        else:
            child.append(list(bin_))
    best_fit(child, _rooms(child, sizes, capacity), loose, sizes, capacity)
    return child


def first_packing(sizes: list[int], capacity: int, rng: random.Random, greedy: bool) -> Bins:
    """Best fit over all pieces, largest first, or (for variety) after a random half of them."""
    bins: Bins = []
    free: list[int] = []
    order = list(range(len(sizes)))
    if not greedy:
        rng.shuffle(order)
        for p in order[:len(order) // 2]:
            best_fit(bins, free, [p], sizes, capacity) if not bins else _append_next(bins, free, p, sizes, capacity)
        order = order[len(order) // 2:]
    best_fit(bins, free, order, sizes, capacity)
    return bins


def _append_next(bins: Bins, free: list[int], piece: int, sizes: list[int], capacity: int) -> None:
    if free[-1] < sizes[piece]:
        bins.append([])
        free.append(capacity)
    bins[-1].append(piece)
    free[-1] -= sizes[piece]


def evolve(sizes: list[int], capacity: int, population: list[Bins], rng: random.Random, children: int = 12,
           most: int = 4) -> list[Bins]:
    """The best ``most`` packings after ``children`` crossovers. Stops when the best needs no bin more than its
    total size does."""
    ranked = sorted(((fitness(x, sizes, capacity), i, x) for i, x in enumerate(population)), key=lambda x: x[:2])
    least, made = -(-sum(sizes) // capacity), len(ranked)
    for _ in range(children):
        if ranked[0][0][0] <= least or len(ranked) < 2:
            break
        (_, _, a), (_, _, b) = rng.sample(ranked, 2)
        child = crossover(a, b, sizes, capacity, rng)
        ranked.append((fitness(child, sizes, capacity), made, child))
        made += 1
        ranked = sorted(ranked, key=lambda x: x[:2])[:most]
    return [x for _, _, x in ranked]


def _island(block: int, island: int, epoch: int, sizes: list[int], capacity: int, elites: list[Bins]) -> Bins:
    """An epoch of an island. There is nothing to evolve where an elite or the first packing has as few bins as the
    sizes allow."""
    rng = random.Random(f"{block}/{island}/{epoch}")
    population = list(elites) or [first_packing(sizes, capacity, rng, island == 0)]
    while len(population) < 4 and min(map(len, population)) > -(-sum(sizes) // capacity):
        population.append(first_packing(sizes, capacity, rng, False))
    return evolve(sizes, capacity, population, rng)[0]


def _streamed(run_group: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str]):
    """For mapInPandas over rows sorted by ``keys``: ``run_group`` on each whole group."""

    def run(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rest):
                continue
            last = (rest[keys] == rest[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(rest) if not last.any() else int(last.argmax())
            if cut:
                for _, group in rest.iloc[:cut].groupby(keys, sort=False):
                    yield run_group(group)
                rest = rest.iloc[cut:]
        if rest is not None and len(rest):
            for _, group in rest.groupby(keys, sort=False):
                yield run_group(group)

    return run


def _pack_blocks(items: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(item, block, size, bin) for (item, block, size), each block packed for itself.

    A block is evolved on ``islands`` islands. After an epoch the best packing of each, its elite, migrates to the
    next island of the ring, and joins that island's own elite in the population of the next epoch; after the last
    epoch the block's best packing is taken. Blocks with as few bins as their sizes allow are done at once. A
    packing is a row a piece: nothing passes through the driver."""
    found, done = None, []
    keys = ["block", "island"]
    schema = "item bigint, block bigint, size bigint, island int, bin int, bins int, quality double"

    def group_of(epoch: int):
        def run_group(group: pd.DataFrame) -> pd.DataFrame:
            block, island = int(group["block"].iloc[0]), int(group["island"].iloc[0])
            own = group[["item", "size"]].drop_duplicates("item").sort_values("item", ignore_index=True)
            place = pd.Series(np.arange(len(own)), index=own["item"])
            elites = []
            if "source" in group:
                for _, packing in group.groupby("source"):
                    bins: Bins = [[] for _ in range(int(packing["bin"].max()) + 1)]
                    for p, b in zip(place.loc[packing["item"]].to_numpy(), packing["bin"], strict=True):
                        bins[b].append(int(p))
                    elites.append([sorted(b) for b in bins])
            sizes = own["size"].tolist()
            best = _island(block, island, epoch, sizes, capacity, elites)
            count, quality = fitness(best, sizes, capacity)
            where = np.empty(len(own), np.int32)
            for i, b in enumerate(best):
                where[b] = i
            return own.assign(block=block, island=np.int32(island), bin=where, bins=np.int32(count), quality=quality)[
                ["item", "block", "size", "island", "bin", "bins", "quality"]]

        return run_group

    for epoch in range(epochs):
        if found is None:
            rows = items.select("item", "block", "size", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
        else:
            moved = found.select("item", "block", "size", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"),
                                 "bin", F.col("island").alias("source"))
            rows = found.select("item", "block", "size", "island", "bin", F.col("island").alias("source")).unionByName(moved)
        found = stored(rows.repartition(*keys).sortWithinPartitions(*keys, "item")
                       .mapInPandas(_streamed(group_of(epoch), keys), schema), "islands")
        best = found.groupBy("block").agg(F.min(F.struct("bins", "quality", "island")).alias("best"), F.sum("size").alias("total"))
        if epoch < epochs - 1:  # each of the islands has all sizes
            best = best.where(F.col("best.bins") <= F.ceil(F.col("total") / (islands * capacity)))
        best = stored(best.select("block", "best.island"), "best")
        done.append(found.join(best, ["block", "island"]).select("item", "block", "size", "bin"))
        found = found.join(best.select("block"), "block", "left_anti")
    return _union(done)


def pack(items: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS,
         epochs: int = 2) -> DataFrame:
    """(item, sequence_id) for items (item: distinct bigint, size: 1 to capacity), few sequences.

    Items are dealt to blocks of about ``block_pieces`` by a hash, and blocks are packed on islands. What then lies
    in bins that aren't well filled (some of each block) is dealt to fewer blocks and packed again, until one block
    holds the rest or a round no longer shrinks it. Sequences hold items of one block: a block is all that a task
    holds."""
    rest, done, level = items.select("item", "size"), [], 0
    rows = rest.count()
    while True:
        blocks = max(1, -(-rows // block_pieces))
        packed = stored(_pack_blocks(rest.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks))),
                                     capacity, islands, epochs), "packed")
        bins = packed.groupBy("block", "bin").agg(F.sum("size").alias("filled"))
        well = packed.join(bins, ["block", "bin"]).withColumn(
            "sequence_id", (F.col("block") * F.lit(1 << 20) + F.col("bin")) * F.lit(16) + F.lit(level))
        if blocks == 1 or level == 3:
            return _union([*done, well.select("item", "sequence_id")])
        good = F.col("filled") >= capacity - max(1, capacity // 50)
        loose = stored(well.where(~good).select("item", "size"), "loose")
        left = loose.count()
        done.append((well if left == 0 else well.where(good)).select("item", "sequence_id"))
        if left == 0:
            return _union(done)
        if left * 2 > rows:  # many large items: another round would find as little
            done[-1] = well.select("item", "sequence_id")
            return _union(done)
        rest, rows, level = loose, left, level + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document (null text: empty) is its token ids and the id 0. Only longer ones than ``capacity`` are cut. The
    pieces of a sequence lie end to end from offset 0, in the order of their document's place in the table. Repeated
    rows and rows without id are documents of their own. Other columns are ignored. An empty table gives an empty
    table."""
    cut = stored(pieces(docs, tokenizer, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut.select("item", F.col("length").alias("size")), capacity)
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(placed, "item").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"))
