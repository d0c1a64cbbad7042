"""Token ids as canonical, length-limited Huffman codes in files of independent blocks.

Documents are dealt out by ranges of doc_id and their ids written to an intermediate table, in order. The counts of
the vocabulary (a bounded table) give the code lengths by the package-merge method, and the lengths alone give the
canonical codes. A second pass over the table writes the files block after block, so a task holds a few blocks at
most. A block restarts at a whole byte and lists the bit offset of every 256th id (a lane), so all lanes of
many blocks are decoded at once, each step being one look-up in a table of 2^max_bits entries.

File: magic; u32 n, n u32 ids and n u8 code lengths; blocks; index; u64 place of the index; magic. The index has
u64 counts of blocks, lanes and documents; per block its u64 place and u64 number of ids; per lane its u32 bit
offset in the block; per document its i64 id, u64 number of ids and u8 null mark. Numbers are little-endian.

Defined cases: a null text is empty and has the end id only; null ids come first; rows with one id follow each
other as the table has them; an empty table gives no rows; only the named columns are read. An id without a count cannot be
encoded, and none occurs, since the counts cover all rows.
"""

from __future__ import annotations

import gc
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pipescope.llm import files
from pipescope.llm.common import in_small_batches, written
from pipescope.llm.pieces import text_parts, tokenizer_text, worker_encoder
from pipescope.session import scratch_path

MAGIC = b"HUFIDS1\n"
MAX_BITS = 18
LANE = 256
BLOCK = 64 * LANE
BLOCKS_AT_ONCE = 64
PART_BYTES = 4_000_000  # of text encoded at a time
MANIFEST = "part long, seq long, path string, n_ids long, n_docs long"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `max_bits` for positive counts (package-merge)."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.uint8)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit codes of {max_bits} bits")
    if n == 1:
        return np.ones(1, np.uint8)
    rank = np.argsort(counts, kind="stable")
    leaves = counts[rank].astype(np.int64)
    level, are_leaves = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        even = len(level) // 2 * 2
        merged = np.concatenate([leaves, level[0:even:2] + level[1:even:2]])
        order = np.argsort(merged, kind="stable")
        level = merged[order]
        are_leaves.append(order < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(are_leaves):
        lone = int(is_leaf[:take].sum())
        lengths[:lone] += 1
        take = 2 * (take - lone)
    out = np.empty(n, np.uint8)
    out[rank] = lengths
    return out


class Codes:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = np.asarray(ids, np.uint32), np.asarray(lengths, np.uint8)
        order = np.lexsort((self.ids, self.lengths))
        sizes = self.lengths[order].astype(np.int64)
        self.max_bits = int(sizes[-1]) if len(sizes) else 1
        # a code is the sum of the room the earlier ones take, cut to its own length
        room = np.left_shift(np.int64(1), self.max_bits - sizes)
        first = np.cumsum(room) - room
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        self.code, self.size = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        self.code[self.ids[order]] = (first >> (self.max_bits - sizes)).astype(np.uint64)
        self.size[self.ids[order]] = sizes
        self.table_ids = np.zeros(1 << self.max_bits, np.uint32)
        self.table_sizes = np.ones(1 << self.max_bits, np.uint8)
        filled = int(room.sum())
        self.table_ids[:filled] = np.repeat(self.ids[order], room)
        self.table_sizes[:filled] = np.repeat(self.lengths[order], room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of one block, and the bit offset of each lane."""
        sizes = self.size[ids].astype(np.uint64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, used = (starts >> np.uint64(6)).astype(np.int64), (starts & np.uint64(63)) + sizes
        codes = self.code[ids]
        over = used > 64
        left = np.where(over, np.uint64(0), np.uint64(64) - np.minimum(used, np.uint64(64)))
        excess = np.where(over, used - np.uint64(64), np.uint64(0))
        pieces = (codes >> excess) << left
        out = np.zeros(int(ends[-1]) // 64 + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(pieces, first)
        out[word[over] + 1] |= codes[over] << (np.uint64(64) - excess[over])
        return out.astype(">u8").tobytes()[:(int(ends[-1]) + 7) // 8], starts[::LANE].astype(np.uint32)

    def decode(self, data: bytes, lanes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of lanes that begin at the bits `lanes` of `data` and hold `sizes` ids each, in a row."""
        padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        last, mask = (len(window) - 1) * 8, np.int64((1 << self.max_bits) - 1)
        at, steps = lanes.astype(np.int64), int(sizes.max(initial=0))
        out = np.empty((steps, len(lanes)), np.uint32)
        for step in range(steps):
            entry = (window[at >> 3].astype(np.int64) >> (32 - self.max_bits - (at & 7))) & mask
            out[step] = self.table_ids[entry]
            at = np.minimum(at + self.table_sizes[entry], last)
        return out.T[np.arange(steps) < sizes[:, None]]


class IdWriter:
    """Writes one file; holds the ids of a block and the index."""

    def __init__(self, path: str, codes: Codes):
        self.codes, self.out, self.at = codes, files.open_output(path), 0
        self.rest: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.blocks: list[tuple[int, int]] = []
        self.lanes: list[np.ndarray] = []
        self.doc_ids: list[int] = []
        self.nulls: list[int] = []
        self.doc_sizes: list[int] = []
        self._put(MAGIC + struct.pack("<I", len(codes.ids)) + codes.ids.astype("<u4").tobytes() + codes.lengths.tobytes())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.doc_ids += [0 if d is None else d for d in doc_ids]
        self.nulls += [d is None for d in doc_ids]
        self.doc_sizes += sizes.tolist()
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        done = 0
        while len(ids) - done >= least and done < len(ids):
            part = ids[done:done + BLOCK]
            data, lanes = self.codes.encode(part)
            self.blocks.append((self.at, len(part)))
            self.lanes.append(lanes)
            self._put(data)
            done += len(part)
        self.rest, self.held, self.n_ids = [ids[done:]], len(ids) - done, self.n_ids + done

    def close(self) -> None:
        self._flush(1)
        place = self.at
        lanes = np.concatenate(self.lanes) if self.lanes else np.zeros(0, np.uint32)
        self._put(struct.pack("<QQQ", len(self.blocks), len(lanes), len(self.doc_ids)))
        self._put(np.asarray(self.blocks, "<u8").tobytes() + lanes.astype("<u4").tobytes())
        self._put(np.asarray(self.doc_ids, "<i8").tobytes() + np.asarray(self.doc_sizes, "<u8").tobytes())
        self._put(np.asarray(self.nulls, np.uint8).tobytes() + struct.pack("<Q", place) + MAGIC)
        self.out.close()


class IdReader:
    def __init__(self, path: str):
        self.stream = files.open_input(path)
        size = self.stream.size()
        tail = self._get(size - 16, 16)
        head = self._get(0, len(MAGIC) + 4)
        if tail[8:] != MAGIC or not head.startswith(MAGIC):
            raise ValueError(f"{path} is not a complete file of coded ids")
        n = struct.unpack_from("<I", head, len(MAGIC))[0]
        table = self._get(len(MAGIC) + 4, 5 * n)
        self.codes = Codes(np.frombuffer(table, "<u4", n), np.frombuffer(table, np.uint8, n, 4 * n))
        place = struct.unpack("<Q", tail[:8])[0]
        self.end = place
        index = self._get(place, size - 16 - place)
        n_blocks, n_lanes, n_docs = struct.unpack_from("<QQQ", index)
        at = 24
        self.blocks = np.frombuffer(index, "<u8", 2 * n_blocks, at).reshape(-1, 2).astype(np.int64)
        at += 16 * n_blocks
        self.lanes = np.frombuffer(index, "<u4", n_lanes, at).astype(np.int64)
        at += 4 * n_lanes
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, at)
        self.doc_sizes = np.frombuffer(index, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        self.nulls = np.frombuffer(index, np.uint8, n_docs, at + 16 * n_docs).astype(bool)

    def _get(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def parts(self) -> Iterator[np.ndarray]:
        """The ids in order, some blocks at a time."""
        lane = 0
        for first in range(0, len(self.blocks), BLOCKS_AT_ONCE):
            blocks = self.blocks[first:first + BLOCKS_AT_ONCE]
            last = first + len(blocks)
            begin, end = int(blocks[0, 0]), int(self.blocks[last, 0]) if last < len(self.blocks) else self.end
            counts = -(-blocks[:, 1] // LANE)
            total = int(counts.sum())
            of = np.repeat(np.arange(len(blocks)), counts)
            place = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            sizes = np.minimum(LANE, blocks[of, 1] - place * LANE)
            starts = self.lanes[lane:lane + total] + (blocks[of, 0] - begin) * 8
            lane += total
            yield self.codes.decode(self._get(begin, end - begin), starts, sizes)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of every document in order."""
        parts, held = self.parts(), np.zeros(0, np.uint32)
        for doc_id, size, null in zip(self.doc_ids.tolist(), self.doc_sizes.tolist(), self.nulls.tolist()):
            if len(held) < size:
                more = [held]
                while sum(map(len, more)) < size:
                    more.append(next(parts))
                held = np.concatenate(more)
            yield None if null else doc_id, held[:size]
            held = held[size:]


def _values(column: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of an array of packed sequences in a row, and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def encode_ordered(docs: DataFrame, tokenizer_json: str, kind: str, doc_id: str, text: str, end_id: int) -> DataFrame:
    """(part, seq, doc_id, ids): the packed ids of every document with its end id; (part, seq) is its place."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encode(batches):
        encoder, seq, number = worker_encoder(shared.value), 0, TaskContext.get().partitionId()
        gc.disable()  # many short lists and no cycles
        for batch in batches:
            for part, texts in text_parts(batch.column(1), PART_BYTES):
                flat, sizes = encoder.ids(texts)
                data = np.insert(flat.astype(kind), np.cumsum(sizes), end_id)
                n, width = len(sizes), np.dtype(kind).itemsize
                offsets = np.concatenate([[0], np.cumsum((sizes + 1) * width)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, number), pa.int64()), pa.array(np.arange(seq, seq + n), pa.int64()),
                    batch.column(0).slice(part.start, n),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                ], ["part", "seq", "doc_id", "ids"])
                seq += n
        gc.enable()

    # ranges are found from ids and places alone, without reading a text; an id of many rows spreads by their places
    by_id, by_place = F.col("_doc").asc_nulls_first(), F.col("_place").asc()
    placed = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text")).withColumn(
        "_place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(by_id, by_place).sortWithinPartitions(by_id, by_place).select("_doc", "_text")
    return in_small_batches(ordered).mapInArrow(encode, "part long, seq long, doc_id long, ids binary")


def count_ids(encoded: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents; ids are added up per task before the shuffle."""
    def counts(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(_values(batch.column(0), kind)[0], minlength=len(total))
            found[:len(total)] += total
            total = found
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, doc_id: str = "doc_id", text: str = "text",
              end_id: int = 2, max_bits: int = MAX_BITS) -> DataFrame:
    """Write the coded ids of all documents in ascending doc_id order; returns the manifest of the files.

    The manifest is written with the rows of successful attempts, so files of lost or repeated tasks are not
    part of the result. A file holds documents that follow each other.
    """
    spark = docs.sparkSession
    tokenizer_json = tokenizer_text(tokenizer_path)
    most = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1)
    kind = "<u2" if most <= 1 << 16 else "<u4"
    encoded = written(encode_ordered(docs, tokenizer_json, kind, doc_id, text, end_id), "encoded", compression="zstd")
    counts = count_ids(encoded, kind).orderBy("id").toPandas()  # as long as the vocabulary at most
    ids, lengths = counts["id"].to_numpy(), code_lengths(counts["n"].to_numpy(), max_bits)
    folder = folder or scratch_path(spark, "ids")
    files.create_folder(folder)
    shared = spark.sparkContext.broadcast((ids, lengths))

    def write(batches):
        codes, writer, row, after = Codes(*shared.value), None, {}, None
        for batch in batches:
            parts, seqs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            doc_ids, (flat, sizes) = batch.column(2).to_pylist(), _values(batch.column(3), kind)
            ends = np.cumsum(sizes)
            breaks = np.flatnonzero((np.diff(parts) != 0) | (np.diff(seqs) != 1)) + 1
            for begin, end in zip([0, *breaks.tolist()], [*breaks.tolist(), len(parts)]):
                if begin == end:
                    continue
                place = int(parts[begin]), int(seqs[begin])
                if writer is None or place != after:
                    if writer is not None:
                        yield _closed(writer, row)
                    row = {"part": place[0], "seq": place[1], "path": f"{folder}/{uuid.uuid4().hex}.huf"}
                    writer = IdWriter(row["path"], codes)
                after = int(parts[end - 1]), int(seqs[end - 1]) + 1
                for at in range(begin, end, 1000):
                    to = min(at + 1000, end)
                    writer.add(doc_ids[at:to], flat[ends[at] - sizes[at]:ends[to - 1]], sizes[at:to])
        if writer is not None:
            yield _closed(writer, row)

    return written(encoded.mapInArrow(write, MANIFEST), "manifest")


def _closed(writer: IdWriter, row: dict) -> pa.RecordBatch:
    writer.close()
    return pa.RecordBatch.from_pylist([row | {"n_ids": writer.n_ids, "n_docs": len(writer.doc_ids)}], pa.schema([
        ("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))


def read_ids(manifest: DataFrame, each, schema: str) -> DataFrame:
    """Read the files back. `each(doc_id, start, ids)` gives the values of a document's row.

    `start` counts the ids of all documents before it: those of earlier files (a sum over the manifest, one
    row per file) and those before it in its own file.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")), "places")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for doc_id, ids in IdReader(path).documents():
                    rows.append(each(doc_id, start, ids))
                    start += len(ids)
                    held += len(ids)
                    if len(rows) >= 10_000 or held >= 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(zip(*rows))], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(zip(*rows))], names)

    # a file is the unit of work, and the manifest is a few short rows: deal them out evenly
    n_files = placed.count()
    return placed.repartition(max(1, n_files)).mapInArrow(read, schema)


def digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    def row(doc_id, start, ids):
        return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())

    return read_ids(manifest, row, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files."""
    return read_ids(manifest, lambda d, s, ids: (d, s, ids.astype(np.int32)), "doc_id long, start long, ids array<int>")
