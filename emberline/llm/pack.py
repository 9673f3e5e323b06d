"""Operator 10: packing documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole sequences and a rest; the rest is cut into pieces of at most PIECE ids. Each group of
pieces is divided among windows so that their sums are nearly equal: partial partitions are merged largest spread first,
the fullest window of one with the emptiest of the other. Where a window would exceed the capacity, there is one window
more and the group is divided again.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import bounded, plain_text, read_table, row_numbers

CAPACITY = 1024
#: Longest piece of a document's rest, in ids.
PIECE = 256
#: Pieces that are divided among windows together.
GROUP = 1024
END_ID = 0


def _chunk_bounds(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where chunks start: at texts and at spaces whose neighbours can't be white space.

    The tokenizer's words never cross such a space, so the ids of the chunks make up those of the text. Of characters
    beyond ASCII only those of two bytes from U+00C0 count as sure.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        solid = data > 0x20
        ascii_ = solid & (data < 0x7F)
        before = ascii_.copy()
        before[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        after = ascii_ | ((data >= 0xC3) & (data <= 0xDF))
        cut[1 : n - 1] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    cut[firsts] = True
    cut[n] = True
    return np.flatnonzero(cut)


class Ids:
    """The ids of texts by the tokenizer in a file of the tokenizers library.

    Each batch asks once for each different chunk. Chunks of a space and ASCII or Latin-1 characters go through
    tiktoken where ranks, the same vocabulary as that library's file, are given: its ids are the same and it's faster.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
            self.sizes = np.zeros(max(known.values()) + 1, np.int64)
            self.sizes[list(known.values())] = [len(x) for x in known]

    def of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, in the order of the second array, which has how many each chunk has and where they start."""
        offsets = np.frombuffer(chunks.buffers()[1], np.int32, len(chunks) + 1, chunks.offset * 4).astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2], np.uint8)
        sizes, places, parts, total = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), [], 0
        plain = np.zeros(len(chunks), bool)
        if self.fast:
            odd = (data >= 0xC4) | (data == 0xC2) | (data < 0x20) & (data != 0x0A) | (data == 0x7F)
            odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # a special token may start here
            before = np.concatenate([[0], np.cumsum(odd)])
            plain = (before[offsets[1:]] == before[offsets[:-1]]) & (data[offsets[:-1]] == 0x20) & (data[offsets[1:] - 1] > 0x20) & (np.diff(offsets) > 1)
            picked = chunks.filter(pa.array(plain))
            if len(picked):
                ends = np.cumsum(np.diff(offsets)[plain])
                first = np.frombuffer(picked.buffers()[1], np.int32, 1, picked.offset * 4)[0]
                ids = np.array(self.fast(picked.buffers()[2][first : first + ends[-1]].to_pybytes().decode()), np.uint32)
                stops = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
                sizes[plain] = np.diff(stops, prepend=0)
                places[plain] = stops - sizes[plain]
                parts, total = [ids], len(ids)
        rest = np.flatnonzero(~plain)
        if len(rest):
            each = [x.ids for x in self.encode([x.decode() for x in chunks.take(pa.array(rest)).to_pylist()], add_special_tokens=False)]
            sizes[rest] = [len(x) for x in each]
            places[rest] = total + np.cumsum(sizes[rest]) - sizes[rest]
            parts.append(np.array([y for x in each for y in x], np.uint32))
        return np.concatenate(parts), np.stack([sizes, places])

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, flat, each followed by END_ID, and how many each has."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        raw = texts.buffers()[2]
        data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        filled = np.flatnonzero(np.diff(offsets))
        if not len(filled):
            return np.full(len(texts), END_ID, np.uint32), np.ones(len(texts), np.int64)
        bounds = _chunk_bounds(data, offsets[filled])
        chunks = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(chunks)
        flat, (sizes, places) = self.of_chunks(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        size = sizes[which]
        ends = np.cumsum(size)
        ids = flat[np.repeat(places[which] - (ends - size), size) + np.arange(ends[-1])]
        chunk_row = np.searchsorted(offsets[filled], bounds[:-1], side="right") - 1
        counts = np.zeros(len(texts), np.int64)
        counts[filled] = np.bincount(chunk_row, weights=size, minlength=len(filled)).astype(np.int64)
        return np.insert(ids, np.cumsum(counts), END_ID), counts + 1


def karmarkar_karp(sizes: list[int], windows: int) -> list[list[int]]:
    """The numbers of the sizes, divided among windows with nearly equal sums.

    Each partial partition is a list of windows with their sums, emptiest first. The two with the largest spread are
    merged, the fullest window of one with the emptiest of the other, until one is left. Windows that are empty in one
    of them aren't stored; at the end of each list stands the fullest.
    """
    heap = [(-size, k, [(size, [k])]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over > 0:
            # Opposite order: what both have filled are the emptiest `over` windows of each.
            a, b, met = a[over:], b[over:], [(x + y, i + j) for (x, i), (y, j) in zip(a[:over], reversed(b[:over]), strict=True)]
            a = a + met
        merged = sorted(a + b, key=lambda w: w[0])
        spread = merged[-1][0] - (merged[0][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    return [held for _, held in heap[0][2]] if heap else []


def divide(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The numbers of the sizes (each at most capacity) by window, in as few windows as differencing fills within capacity."""
    windows = -(-sum(sizes) // capacity)
    while True:
        held = karmarkar_karp(sizes, windows)
        if all(sum(sizes[k] for k in w) <= capacity for w in held):
            return held
        windows += 1


def _cut(tokens: np.ndarray, capacity: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece of documents of so many ids."""
    whole, rest = tokens // capacity, tokens % capacity
    parts = -(-rest // piece)
    docs = row_numbers(whole + parts)
    number = np.arange(len(docs)) - np.repeat(np.cumsum(whole + parts) - whole - parts, whole + parts)
    k = np.maximum(number - whole[docs], 0)
    full = number < whole[docs]
    # Whole pieces and a smaller last one: pieces of all sizes let the windows' sums come close.
    return docs, np.where(full, number, whole[docs]) * capacity + k * piece, np.where(full, capacity, np.minimum(piece, rest[docs] - k * piece))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids its ids.

    Null and empty texts have END_ID alone and are packed like others. Repeated rows are packed as often as they occur.
    Nothing is shuffled: each task packs its own rows, in groups, and sequence_id holds the task's partition in its
    upper bits, so that a task that runs again gives the same rows. An empty table gives no rows. Other columns of docs
    aren't read.
    """
    ranks = None if tokenizer else public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    inner = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("packed"))
    kind = inner.schema["doc"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * keep_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, sequence = Ids(tokenizer, ranks), TaskContext.get().partitionId() << 36
        waiting: list[tuple] = []  # of the pieces not packed yet: document's id, start, length, crc, document's ids, ids
        names = [x.split()[0] for x in schema.split(", ")]

        def packed(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for held in divide([x[2] for x in pieces], capacity):
                offset = 0
                for k in held:
                    rows.append((*pieces[k][:5], sequence, offset, *pieces[k][5:]))
                    offset += pieces[k][2]
                sequence += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        types: list[pa.DataType] = []
        for batch in bounded(batches, "packed"):
            name = batch.column("doc")
            types = [name.type, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * keep_ids]
            ids, tokens = ids_of.of_texts(plain_text(batch.column("packed")))
            docs_, starts, lengths = _cut(tokens, capacity, piece)
            begins = (np.cumsum(tokens) - tokens)[docs_] + starts
            view = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begins.tolist(), lengths.tolist(), strict=True)), np.int64, len(begins))
            whole = np.flatnonzero(lengths == capacity)
            taken = name.take(pa.array(docs_))
            part = lambda at: [taken.take(pa.array(at)), *(pa.array(x[at]) for x in (starts, lengths, crc, tokens[docs_]))]
            own = lambda at: [[ids[a : a + n].tolist() for a, n in zip(begins[at], lengths[at], strict=True)]] * keep_ids
            if len(whole):
                yield pa.RecordBatch.from_arrays([*part(whole), pa.array(sequence + np.arange(len(whole))), pa.array(np.zeros(len(whole), np.int64)), *(pa.array(x, types[-1]) for x in own(whole))], names)
                sequence += len(whole)
            left = np.flatnonzero(lengths < capacity)
            waiting += zip(*(x.to_pylist() for x in part(left)), *own(left), strict=True)
            while len(waiting) >= 2 * group:
                yield from packed(waiting[:group])
                waiting = waiting[group:]
        if waiting:
            yield from packed(waiting)

    return inner.mapInArrow(run, schema)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
