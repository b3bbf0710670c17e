"""Token files: patched frame-of-reference blocks with an index of block starts.

A file holds one range of documents, by ascending id, as one run of token ids; each document
ends with the end token. Ids are cut into blocks of ``BLOCK``. A block subtracts its minimum
and packs what is left at the width that fits ``PERCENTILE`` of its values; the values that do
not fit keep their low bits in place and stand whole, with their places, in the block's list of
exceptions. The end of the file lists where each block starts, and the ids and lengths of the
documents (the lengths in blocks of the same kind), so that any range of ids is read by itself.

Layout, little-endian: blocks | block starts u64 | document ids i64 | lengths, as blocks with a
u32 count of bytes before each | trailer (see ``TRAILER``). A block: minimum u32, count u16, exceptions u16, width u8, packed
values, places u16, values u32.

Spark sorts the texts by ranges of ids and every task writes the file of its range under a new
name; the table of files, written by Spark, names those that count, so a task that is run twice
leaves an unread file behind and nothing else. The folder may be any that
``pyarrow.fs`` opens (local or mounted paths, hdfs, s3, gs).

Defined cases: a null text is an empty document (the end token alone); null ids come first;
rows that share an id stand one after the other; a text of any length is one document, written
block by block; an empty table makes no file and gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import store, text_slices
from lodeworks.llm.packing import TOKENIZER, text_ids
from lodeworks.session import run_dir

END_ID = 0
BLOCK = 1024
PERCENTILE = 90
# Blocks that are packed or read in one pass.
CHUNK = 256

HEAD = struct.Struct("<IHHB")
# Documents, of them null ids, tokens, blocks, tokens a block, where the index starts, its CRC-32.
TRAILER = struct.Struct("<QQQQIQI4s")
MAGIC = b"PFR1"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values under ``2 ** width`` as rows of bytes, lowest bit first."""
    rows, count = values.shape
    octets = values.astype("<u4").view(np.uint8).reshape(rows, count, 4)[:, :, : (width + 7) // 8]
    bits = np.unpackbits(octets, axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(rows, -1), axis=1, bitorder="little")


def unpack_bits(octets: np.ndarray, width: int, count: int) -> np.ndarray:
    """The values that ``pack_bits`` packed."""
    bits = np.unpackbits(octets, axis=1, count=count * width, bitorder="little")
    wide = np.packbits(bits.reshape(len(octets), count, width), axis=2, bitorder="little")
    out = np.zeros((len(octets), count, 4), dtype=np.uint8)
    out[:, :, : wide.shape[2]] = wide
    return out.view("<u4").reshape(len(octets), count)


def pack_blocks(values: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """One block per row of ``values``, all of which are under 2 ** 32."""
    rows, count = values.shape
    low = values.min(axis=1)
    rest = (values - low[:, None]).astype(np.uint32)
    fits = max(0, -(-count * percentile // 100) - 1)
    common = np.partition(rest, fits, axis=1)[:, fits]
    widths = np.frexp(common.astype(np.float64))[1]
    out: list[bytes] = [b""] * rows
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        group = rest[at]
        mask = np.uint32((1 << int(width)) - 1)
        packed = pack_bits(group & mask, int(width)) if width else np.empty((len(at), 0), np.uint8)
        owner, places = np.nonzero(group > mask)
        ends = np.searchsorted(owner, np.arange(len(at) + 1))
        listed = places.astype("<u2"), group[owner, places].astype("<u4")
        for i, row in enumerate(at):
            a, b = ends[i], ends[i + 1]
            out[row] = b"".join(
                (
                    HEAD.pack(int(low[row]), count, b - a, int(width)),
                    packed[i].tobytes(), listed[0][a:b].tobytes(), listed[1][a:b].tobytes(),
                )
            )
    return out


def unpack_blocks(data: bytes, starts: Iterable[int]) -> np.ndarray:
    """The values of the blocks that start at ``starts`` in ``data``, one after the other."""
    heads = [(at, *HEAD.unpack_from(data, at)) for at in starts]
    raw = np.frombuffer(data, dtype=np.uint8)
    count = np.array([h[2] for h in heads], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(first[-1], dtype=np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, head in enumerate(heads):
        alike.setdefault((head[4], head[2]), []).append(i)
    for (width, size), members in alike.items():
        long = (width * size + 7) // 8
        if width:
            octets = np.stack([raw[heads[i][0] + HEAD.size :][:long] for i in members])
            rest = unpack_bits(octets, width, size)
        else:
            rest = np.zeros((len(members), size), dtype=np.uint32)
        for row, i in zip(rest, members, strict=True):
            at, low, _, exceptions, _ = heads[i]
            places = np.frombuffer(data, "<u2", exceptions, at + HEAD.size + long)
            row[places] = np.frombuffer(data, "<u4", exceptions, at + HEAD.size + long + 2 * exceptions)
            out[first[i] : first[i + 1]] = row + np.uint32(low)
    return out


class Writer:
    """Writes documents to one file; holds a chunk of ids and the documents' lengths."""

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block = stream, block
        self.starts, self.ids, self.lengths = [0], [], []
        self.waiting: list[np.ndarray] = []
        self.held = self.nulls = 0

    def add(self, doc, tokens: np.ndarray):
        self.nulls += doc is None
        self.ids.append(0 if doc is None else doc)
        self.lengths.append(len(tokens))
        self.waiting.append(tokens)
        self.held += len(tokens)
        if self.held >= CHUNK * self.block:
            self._flush(self.held // self.block * self.block)

    def _flush(self, count: int):
        tokens = np.concatenate([*self.waiting, np.empty(0, np.uint32)])
        self.waiting, self.held = [tokens[count:]], len(tokens) - count
        whole = count // self.block * self.block
        for at in range(0, whole, CHUNK * self.block):
            self._write(tokens[at : min(at + CHUNK * self.block, whole)].reshape(-1, self.block))
        if count > whole:
            self._write(tokens[whole:count].reshape(1, -1))

    def _write(self, rows: np.ndarray):
        blocks = pack_blocks(rows)
        self.stream.write(b"".join(blocks))
        for block in blocks:
            self.starts.append(self.starts[-1] + len(block))

    def close(self):
        """Writes the index and the trailer; returns documents, tokens and bytes of the file."""
        self._flush(self.held)
        lengths = np.array(self.lengths, dtype=np.uint32)
        sizes = [pack_blocks(lengths[i : i + BLOCK][None, :])[0] for i in range(0, len(lengths), BLOCK)]
        index = b"".join(
            [np.array(self.starts, "<u8").tobytes(), np.array(self.ids, "<i8").tobytes()]
            + [struct.pack("<I", len(b)) + b for b in sizes]
        )
        tokens = int(lengths.sum(dtype=np.int64))
        self.stream.write(index)
        self.stream.write(
            TRAILER.pack(
                len(self.ids), self.nulls, tokens, len(self.starts) - 1, self.block,
                self.starts[-1], zlib.crc32(index), MAGIC,
            )
        )
        return len(self.ids), tokens, self.starts[-1] + len(index) + TRAILER.size


class Reader:
    """Reads a file's index at once, its ids by ranges of blocks."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - TRAILER.size)
        docs, self.nulls, self.tokens, blocks, self.block, at, check, magic = TRAILER.unpack(file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        file.seek(at)
        index = file.read(size - TRAILER.size - at)
        if zlib.crc32(index) != check:
            raise ValueError("the index of the token file is damaged")
        self.starts = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        self.ids = np.frombuffer(index, "<i8", docs, 8 * (blocks + 1))
        place, sizes = 8 * (blocks + 1 + docs), []
        while place < len(index):
            sizes.append(place + 4)
            place += 4 + struct.unpack_from("<I", index, place)[0]
        self.lengths = unpack_blocks(index, sizes).astype(np.int64)

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids from place ``start`` to before place ``end``."""
        if start >= end:
            return np.empty(0, dtype=np.uint32)
        first, last = start // self.block, -(-end // self.block)
        self.file.seek(int(self.starts[first]))
        data = self.file.read(int(self.starts[last] - self.starts[first]))
        out = unpack_blocks(data, (self.starts[first:last] - self.starts[first]).tolist())
        return out[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Id, place of the first token, tokens and their CRC-32 of each document, in order.

        Ids are read chunk by chunk, however long a document is.
        """
        step = CHUNK * self.block
        base, held = 0, self.read(0, min(step, self.tokens))
        start = 0
        for number, (doc, length) in enumerate(zip(self.ids.tolist(), self.lengths.tolist(), strict=True)):
            at, check = start, 0
            while at < start + length:
                if at >= base + len(held):
                    base, held = at, self.read(at, min(at + step, self.tokens))
                part = held[at - base : start + length - base]
                check = zlib.crc32(part.astype("<u4").tobytes(), check)
                at += len(part)
            yield (None if number < self.nulls else doc), start, length, check
            start += length


def write_files(folder: str, tokenizer: str, end_id: int, block: int):
    """Writes the rows of a task, in their order, to one file; one row tells of it."""

    def write(batches):
        encode = text_ids(tokenizer)
        shard = TaskContext.get().partitionId()
        store_fs, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/tokens-{shard:06d}-{uuid.uuid4().hex}.pfr"
        writer = stream = None
        for part in text_slices(batches):
            if writer is None:
                store_fs.create_dir(root, recursive=True)
                stream = store_fs.open_output_stream(path)
                writer = Writer(stream, block)
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.array(encode(text) + [end_id], dtype=np.uint32)
                writer.add(doc, ids)
        if writer is None:
            return
        docs, tokens, size = writer.close()
        stream.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "file": [f"{folder}/{path.rsplit('/', 1)[1]}"], "n_docs": [docs], "n_tokens": [tokens], "n_bytes": [size]},
            pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]),
        )

    return write


def write_tokens(
    documents: DataFrame,
    folder: str,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    block: int = BLOCK,
) -> DataFrame:
    """Writes ``documents`` (``doc_id``, an integer, and ``text``) to files in ``folder``.

    Returns the table of files, one row each: ``shard, file, n_docs, n_tokens, n_bytes, start``
    (the ids in all files before it).
    """
    by = [F.asc_nulls_first("doc_id"), F.col("_tie")]
    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_tie")
    )
    files = store(
        ordered.mapInArrow(
            write_files(folder, tokenizer, end_id, block),
            "shard int, file string, n_docs long, n_tokens long, n_bytes long",
        ),
        "token-files",
    )
    # One row per file.
    earlier = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def open_file(uri: str) -> Reader:
    file_system, path = fs.FileSystem.from_uri(uri)
    return Reader(file_system.open_input_file(path))


def read_documents(batches):
    """The documents of each named file, with the places of their tokens in the whole run."""
    for batch in batches:
        for row in batch.to_pylist():
            rows: list = []
            for doc, start, length, check in open_file(row["file"]).documents():
                rows.append((doc, row["start"] + start, length, check))
                if len(rows) == 10_000:
                    yield digest_rows(rows)
                    rows = []
            yield digest_rows(rows)


def digest_rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def read_tokens(files: DataFrame) -> DataFrame:
    """One row per document, read back from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = files.sparkSession
    tasks = max(1, min(files.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return (
        files.select("file", "start")
        .repartition(tasks)
        .mapInArrow(read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def round_trip(documents: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the documents and reads them back; ``folder`` defaults to a new shared one."""
    folder = folder or run_dir(documents.sparkSession, "tokens")
    return read_tokens(write_tokens(documents, folder, **options))
