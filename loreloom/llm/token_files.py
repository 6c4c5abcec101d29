"""Token ids of a corpus in files: canonical length-limited Huffman codes, blocks that decode by themselves.

A folder holds ``codebook`` (id, bits: the length of its code; canonical codes follow from these) and ``blocks`` (part,
block, first, n_ids, data). Parts follow each other in ascending doc_id, blocks within their part. A block's ``data`` is

    4 bytes  magic, "HTB1"                      4 bytes  CRC-32 of all that follows
    4 bytes  pieces                             4 bytes  runs
    pieces x (doc_id 8, has id 1, ids 4, ids of its document before it 8, and behind it 8)
    runs x 2: the bits that each run of 64 ids takes (checkpoints)
    the codes of all ids

in little-endian numbers, codes from the highest bit down. A document is one piece, or several when it is long.
"""

from __future__ import annotations

import uuid
import zlib
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm.byte_tokens import Words, byte_level, text_runs, vocabulary_file
from loreloom.llm.common import column_or_null, pieces_of
from loreloom.session import shared_folder

END = 0
#: Most bits of a code. The decoding table has 2 ** LIMIT entries.
LIMIT = 18
RUN = 64
PIECE_IDS = 1 << 16
BLOCK_IDS = 1 << 17
PART_IDS = 1 << 24
MAGIC = b"HTB1"
_PIECE = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n", "<u4"), ("before", "<u8"), ("after", "<u8")])
_POLYNOMIAL = 0xEDB88320


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of an optimal prefix code of at most ``limit`` bits for symbols of the given positive counts (package-merge).

    One symbol has one bit. Equal counts: the earlier symbol has no shorter code than the later one.
    """
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.int64)[order]
    row, leaves = weights, []
    for _ in range(limit - 1):
        even = len(row) // 2 * 2
        both = np.concatenate((weights, row[0:even:2] + row[1:even:2]))
        place = np.argsort(both, kind="stable")
        leaves.append(np.cumsum(place < n))
        row = both[place]
    lengths = np.zeros(n, np.int64)
    taken = 2 * n - 2
    for upto in reversed(leaves):
        single = int(upto[taken - 1])
        lengths[:single] += 1
        taken = 2 * (taken - single)
        if not taken:
            break
    lengths[:taken] += 1
    bits = np.empty(n, np.int64)
    bits[order] = lengths
    return bits


class Codebook:
    """Canonical codes of ids: shorter first, ids ascending within a length."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.uint32), bits[order].astype(np.int64)
        self.most = int(self.bits.max()) if len(ids) else 1
        share = np.int64(1) << (self.most - self.bits)
        starts = np.cumsum(share) - share
        codes = starts >> (self.most - self.bits)
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code_of, self.bits_of = np.zeros(size, np.uint32), np.zeros(size, np.uint8)
        self.code_of[self.ids], self.bits_of[self.ids] = codes, self.bits
        self.shares = share

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and bits by the next ``most`` bits of the input."""
        return np.repeat(self.ids, self.shares), np.repeat(self.bits.astype(np.uint8), self.shares)

    def coded(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Codes of ``ids``, and the bits that each run of them takes (2 bytes each)."""
        bits, codes = self.bits_of[ids].astype(np.int64), self.code_of[ids].astype(np.uint64)
        ends = np.cumsum(bits)
        starts = ends - bits
        word, room = starts >> 6, 64 - (starts & 63) - bits
        # Codes of one word share no bit, so their sum is their union; at most one of them goes on in the next word.
        inside = np.where(room >= 0, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros((int(ends[-1]) >> 6) + 1, np.uint64)
        words[word[first]] = np.add.reduceat(inside, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] += codes[over] << (64 + room[over]).astype(np.uint64)
        runs = np.add.reduceat(bits, np.arange(0, len(ids), RUN))
        return words.astype(">u8").tobytes()[:(int(ends[-1]) + 7) // 8], runs.astype("<u2").tobytes()


def decode_runs(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray],
                most: int) -> np.ndarray:
    """Ids of all runs: run i has ``counts[i]`` codes from bit ``starts[i]`` of ``data`` (padded by 4 bytes) on. All runs
    take their next code at once, through the table."""
    symbols, bits = table
    out = np.empty((len(starts), int(counts.max()) if len(counts) else 0), np.uint32)
    at = starts.copy()
    full = bool((counts == out.shape[1]).all())
    for step in range(out.shape[1]):
        byte = at >> 3
        window = ((data[byte].astype(np.uint32) << 24) | (data[byte + 1].astype(np.uint32) << 16)
                  | (data[byte + 2].astype(np.uint32) << 8) | data[byte + 3])
        entry = (window << (at & 7).astype(np.uint32)) >> np.uint32(32 - most)
        out[:, step] = symbols[entry]
        moved = bits[entry]
        at = at + (moved if full else np.where(step + 1 < counts, moved, 0))
    return out.ravel() if full else out[np.arange(out.shape[1]) < counts[:, None]]


def _shifted(crc: int, n_bytes: int) -> int:
    """What ``crc`` adds to the CRC-32 of a message that goes on for ``n_bytes``: the exclusive or of the parts' values is
    the whole's."""
    def product(a: int, b: int) -> int:
        total = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                total ^= b
            b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
        return total

    power = 1 << 23  # x ** 8, a byte
    while n_bytes:
        if n_bytes & 1:
            crc = product(power, crc)
        power = product(power, power)
        n_bytes >>= 1
    return crc


def token_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of at most PIECE_IDS ids of every document, the end id included: doc_id, n, before, after (ids of the document
    before and behind the piece), width (bytes of an id), ids, place (rising within a document, and unlike any other)."""

    def run(batches):
        model = byte_level(tokenizer, False)
        kind = np.dtype("<u2" if model.model.get_vocab_size() <= 1 << 16 else "<u4")
        for batch in batches:
            identifiers = batch.column(0)
            for start, texts in text_runs(batch.column(1)):
                ids, counts = Words(texts, False).ids(model)
                both = np.insert(ids, np.cumsum(counts), END).astype(kind)
                counts = counts + 1
                pieces = -(-counts // PIECE_IDS)
                doc, piece = pieces_of(pieces)
                before = piece * PIECE_IDS
                n = np.minimum(counts[doc] - before, PIECE_IDS)
                ends = np.concatenate(([0], np.cumsum(n))) * kind.itemsize
                column = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(both)])
                yield pa.RecordBatch.from_arrays(
                    [identifiers.take(pa.array(start + doc)), pa.array(n), pa.array(before), pa.array(counts[doc] - before - n),
                     pa.array(np.full(len(n), kind.itemsize, np.int32)), column.cast(pa.binary())],
                    names=["doc_id", "n", "before", "after", "width", "ids"])

    rows = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, before bigint, after bigint, width int, ids binary").withColumn(
        "place", F.monotonically_increasing_id())


def _id_counts(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in use and how often, over the whole corpus. At most as many rows as the vocabulary reach the driver."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for width, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"), minlength=len(total))
                part[:len(total)] += total
                total = part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = tokens.select("width", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return counts["id"].to_numpy(), counts["n"].to_numpy()


def _blocks(tokens: DataFrame, book: Codebook) -> DataFrame:
    """Blocks of each partition of ``tokens``, a part whose pieces come in order."""

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        block = first = n = 0
        for batch in batches:
            for piece in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                held.append(piece)
                n += piece[1]
                if n >= BLOCK_IDS:
                    yield row(part, block, first, n, held)
                    held, block, first, n = [], block + 1, first + n, 0
        if held:
            yield row(part, block, first, n, held)

    def row(part, block, first, n, held):
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
             pa.array([_block(held, book)], pa.binary())], names=["part", "block", "first", "n_ids", "data"])

    return tokens.select("doc_id", "n", "before", "after", "width", "ids").mapInArrow(
        run, "part int, block int, first bigint, n_ids bigint, data binary")


def _block(pieces: list[tuple], book: Codebook) -> bytes:
    head = np.array([(d or 0, d is not None, n, before, after) for d, n, before, after, _, _ in pieces], _PIECE)
    codes, runs = book.coded(np.concatenate([np.frombuffer(ids.as_buffer(), f"<u{width}") for *_, width, ids in pieces]))
    body = len(pieces).to_bytes(4, "little") + (len(runs) // 2).to_bytes(4, "little") + head.tobytes() + runs + codes
    return MAGIC + zlib.crc32(body).to_bytes(4, "little") + body


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, part_ids: int = PART_IDS) -> None:
    """Write the ids of all documents (doc_id, text) to ``folder``, each document's followed by END, in ascending doc_id.

    Null and empty texts have the end id only. Rows without id come first; rows of equal id follow each other, in any
    order that the files then keep. Other columns are ignored. No documents: an empty codebook and no blocks.

    Texts are encoded once and stored in pieces; counts over all of them give the code. The pieces are shuffled into ranges
    of doc_id and place, so that rows of one id can be split, and coded where they arrive."""
    spark = docs.sparkSession
    stored = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    rows = token_rows(docs, tokenizer or vocabulary_file("byte_bpe_50k.json"))
    rows.write.option("compression", "zstd").parquet(stored)
    tokens = spark.read.schema(rows.schema).parquet(stored)
    ids, counts = _id_counts(tokens)
    bits = code_lengths(counts)
    spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "bits": pa.array(bits, pa.int32())})).coalesce(1).write.parquet(
        f"{folder}/codebook")
    parts = int(min(max(1, -(-int(counts.sum()) // part_ids)), 50_000))
    ordered = tokens.repartitionByRange(parts, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    _blocks(ordered, Codebook(ids, bits)).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Pieces of the documents in ``folder``: doc_id, start (ids of all documents before its own), before (ids of its
    document before the piece), n, crc (its share of the CRC-32 of its document's ids), ids (little-endian unsigned
    32-bit numbers; only ``with_ids``).

    Blocks decode on their own; a damaged one is an error. The driver sees the codebook and one number for each part."""
    codebook = spark.read.schema("id bigint, bits int").parquet(f"{folder}/codebook").toArrow()
    blocks = spark.read.schema("part int, block int, first bigint, n_ids bigint, data binary").parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).toArrow()
    order = np.argsort(sizes["part"].to_numpy())
    parts, totals = sizes["part"].to_numpy()[order], sizes["n"].to_numpy()[order]
    offset = dict(zip(parts.tolist(), (np.cumsum(totals) - totals).tolist(), strict=True))
    ids, bits = codebook["id"].to_numpy(), codebook["bits"].to_numpy()

    def run(batches):
        book = Codebook(ids, bits)
        table = book.table()
        for batch in batches:
            for part, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                yield _decoded(data.as_buffer(), offset[part] + first, table, book.most, with_ids)

    return blocks.select("part", "first", "data").mapInArrow(
        run, "doc_id bigint, start bigint, before bigint, n bigint, crc bigint" + (", ids binary" if with_ids else ""))


def _decoded(buffer, first: int, table, most: int, with_ids: bool) -> pa.RecordBatch:
    data = np.frombuffer(buffer, np.uint8)
    view = memoryview(buffer)
    if bytes(view[:4]) != MAGIC or zlib.crc32(view[8:]) != int.from_bytes(view[4:8], "little"):
        raise ValueError("damaged block of token ids")
    pieces, count = np.frombuffer(view[8:16], "<u4").tolist()
    at = 16 + pieces * _PIECE.itemsize
    head = np.frombuffer(view[16:at], _PIECE)
    runs = np.frombuffer(view[at:at + 2 * count], "<u2").astype(np.int64)
    n = head["n"].astype(np.int64)
    sizes = np.full(count, RUN, np.int64)
    sizes[-1] = n.sum() - (count - 1) * RUN
    codes = np.concatenate((data[at + 2 * count:], np.zeros(4, np.uint8)))
    ids = np.ascontiguousarray(decode_runs(codes, np.cumsum(runs) - runs, sizes, table, most), "<u4")
    ends = np.cumsum(n)
    raw = memoryview(ids).cast("B")
    after = head["after"].tolist()
    crcs = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
    crcs = [_shifted(c, 4 * a) if a else c for c, a in zip(crcs, after, strict=True)]
    before = head["before"].astype(np.int64)
    columns = [pa.array(head["doc_id"], mask=head["known"] == 0), pa.array(first + ends - n - before), pa.array(before), pa.array(n),
               pa.array(crcs, pa.int64())]
    names = ["doc_id", "start", "before", "n", "crc"]
    if with_ids:
        offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
        columns.append(pa.BinaryArray.from_buffers(pa.binary(), pieces, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files written to the shared folder and read back.

    A row for each document, repeated ones too. An empty table gives an empty table."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer)
    return read_tokens(spark, folder, with_ids=False).groupBy("start").agg(
        F.min("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")).select(
            "doc_id", "start", "n_tokens", "ids_crc32")
