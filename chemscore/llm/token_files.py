"""Token-ID files: static range asymmetric numeral system (rANS) segments.

A file set is a folder of Parquet files whose rows are self-contained binary
segments in ascending doc_id order.  A segment holds up to ``SEGMENT_TOKENS``
ids of whole documents (a longer document has a segment of its own):

    header   magic "RANS", version, scale bits, lanes, steps, ids, symbols,
             blocks, checkpoints a block                           (little endian)
    table    symbols and frequencies, shared by all blocks of the segment
    blocks   ``LANES`` interleaved coders each, ``STEPS`` ids a lane; per
             block: ids, words, crc32 of its ids, the checkpoints (states of
             all lanes and the word to go on from), the words

Blocks are independent, and each checkpoint is a place inside a block where
decoding can begin; the checksum shows a damaged block.  Coding is vectorised
over all lanes of all blocks of a segment.  States are 64-bit with 32-bit
renormalisation: 2^31 <= state < 2^63.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chemscore.llm.bytebpe import RunCoder
from chemscore.llm.common import pylists, record_batch, shipped, sliced
from chemscore.session import staged_path

MAGIC, VERSION = b"RANS", 1
LANES, STEPS, CHECKPOINTS = 256, 256, 2
#: Blocks that are coded side by side (bounds a worker's memory).
_BESIDE = 64
SCALE_BITS = 18
SEGMENT_TOKENS = 1 << 22
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHIIQIII")
_BLOCK = struct.Struct("<III")


def frequencies(ids: np.ndarray, bits: int = SCALE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): every symbol that occurs gets 1 or more of 2^bits."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << bits
    if len(symbols) > total:
        raise ValueError(f"{len(symbols)} symbols do not fit a table of 2^{bits}")
    if not len(symbols):
        return symbols.astype(np.uint32), counts.astype(np.uint32)
    spare = total - len(symbols)
    freq = 1 + (counts.astype(np.float64) * (spare / counts.sum())).astype(np.int64)
    freq[np.argmax(counts)] += total - freq.sum()
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def pack(ids: np.ndarray) -> bytes:
    """A segment of these ids (uint32, any number of them)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    symbols, freq = frequencies(ids)
    per_block = LANES * STEPS
    blocks = -(-len(ids) // per_block)
    head = _HEAD.pack(MAGIC, VERSION, SCALE_BITS, LANES, STEPS, len(ids), len(symbols), blocks, CHECKPOINTS)
    out = [head, symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes()]
    if not blocks:
        return out[0]
    start = (np.cumsum(freq.astype(np.uint64)) - freq).astype(np.uint64)
    for k in range(0, blocks, _BESIDE):
        out += _pack_blocks(ids[k * per_block:(k + _BESIDE) * per_block], symbols, freq, start)
    return b"".join(out)


def _pack_blocks(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray, start: np.ndarray) -> list[bytes]:
    per_block = LANES * STEPS
    blocks = -(-len(ids) // per_block)
    place = np.zeros(int(symbols[-1]) + 1, dtype=np.uint32)
    place[symbols] = np.arange(len(symbols), dtype=np.uint32)
    at = place[ids]
    fill = np.argmax(freq)                                  # the last block is filled up with a cheap symbol
    at = np.concatenate([at, np.full(blocks * per_block - len(ids), fill, dtype=np.uint32)])
    at = at.reshape(blocks, STEPS, LANES)
    f64, words = freq.astype(np.uint64), np.zeros((STEPS, blocks, LANES), dtype=np.uint32)
    out_mask = np.zeros((STEPS, blocks, LANES), dtype=bool)
    state = np.full((blocks, LANES), _LOW, dtype=np.uint64)
    every, marks = STEPS // CHECKPOINTS, {}
    bits, low32 = np.uint64(SCALE_BITS), np.uint64(32)
    room = np.uint64(63 - SCALE_BITS)
    for step in range(STEPS - 1, -1, -1):                   # coded backwards, decoded forwards
        symbol = at[:, step]
        f = f64[symbol]
        full = state >= (f << room)
        words[step] = state.astype(np.uint32)
        out_mask[step] = full
        state = np.where(full, state >> low32, state)
        q = state // f
        state = (q << bits) + (state - q * f) + start[symbol]
        if step % every == 0:
            marks[step // every] = state
    counts, out = out_mask.sum(axis=2), []                  # words by step and block
    for b in range(blocks):
        mine = ids[b * per_block:(b + 1) * per_block]
        flat = words[:, b][out_mask[:, b]]
        out.append(_BLOCK.pack(len(mine), len(flat), zlib.crc32(mine.astype("<u4").tobytes())))
        for c in range(CHECKPOINTS):
            out.append(struct.pack("<I", int(counts[:c * every, b].sum())))
            out.append(marks[c][b].astype("<u8").tobytes())
        out.append(flat.astype("<u4").tobytes())
    return out


def unpack(segment: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError if a block's checksum does not hold."""
    magic, version, bits, lanes, steps, n, n_symbols, blocks, checkpoints = _HEAD.unpack_from(segment)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token segment of this version")
    if not blocks:
        return np.zeros(0, dtype=np.uint32)
    at = _HEAD.size
    symbols = np.frombuffer(segment, "<u4", n_symbols, at)
    freq = np.frombuffer(segment, "<u4", n_symbols, at + 4 * n_symbols)
    at += 8 * n_symbols
    f64 = freq.astype(np.uint64)
    start = np.cumsum(f64) - f64
    slot_symbol = np.repeat(np.arange(n_symbols, dtype=np.uint32), freq)
    out = []
    for k in range(0, blocks, _BESIDE):
        ids, at = _unpack_blocks(segment, at, min(_BESIDE, blocks - k), bits, lanes, steps, checkpoints,
                                 symbols, f64, start, slot_symbol)
        out += ids
    return np.concatenate(out)


def _unpack_blocks(segment, at, blocks, bits, lanes, steps, checkpoints, symbols, f64, start, slot_symbol):
    sizes, sums, streams, first, marks = [], [], [], [], []
    total = 0
    for _ in range(blocks):
        size, n_words, crc = _BLOCK.unpack_from(segment, at)
        at += _BLOCK.size
        for _ in range(checkpoints):
            first.append(total + struct.unpack_from("<I", segment, at)[0])
            marks.append(np.frombuffer(segment, "<u8", lanes, at + 4))
            at += 4 + 8 * lanes
        streams.append(np.frombuffer(segment, "<u4", n_words, at))
        at += 4 * n_words
        total += n_words
        sizes.append(size)
        sums.append(crc)
    stream = np.concatenate([*streams, np.zeros(1, dtype=np.uint32)]).astype(np.uint64)
    every = steps // checkpoints                            # all checkpoints of these blocks are decoded side by side
    state, pointer = np.stack(marks), np.array(first)
    out = np.empty((blocks * checkpoints, every, lanes), dtype=np.uint32)
    mask, scale, low32 = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
    for step in range(every):
        slot = state & mask
        symbol = slot_symbol[slot]
        out[:, step] = symbols[symbol]
        state = f64[symbol] * (state >> scale) + slot - start[symbol]
        need = state < _LOW
        rank = np.cumsum(need, axis=1)
        where = np.clip(pointer[:, None] + rank - 1, 0, len(stream) - 1)
        state = np.where(need, (state << low32) | stream[where], state)
        pointer = pointer + rank[:, -1]
    out = out.reshape(blocks, -1)
    ids = [out[b, :size] for b, size in enumerate(sizes)]
    for b, part in enumerate(ids):
        if zlib.crc32(part.astype("<u4").tobytes()) != sums[b]:
            raise ValueError(f"block {b}: checksum does not hold")
    return ids, at


_FILE = "part int, before long, n long, doc_ids array<long>, lengths array<long>, data binary"
_FILE_ARROW = pa.schema([
    ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])


@lru_cache(maxsize=2)
def _worker(path: str) -> RunCoder:
    return RunCoder(path)


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = None) -> None:
    """Encode every whole text with the tokenizers library and write the file set.

    Rows are ordered by doc_id (nulls first; repeated ids by their texts).
    Null texts are empty.  ``end_id`` is appended to each document.  Rows are
    dealt by doc_id ranges, so no task holds more than a range, and a task
    holds one segment's ids at a time.  Other columns are ignored; an empty
    table gives a file set without segments.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches):
        coder = _worker(path)
        part, before = TaskContext.get().partitionId(), 0
        keys, lengths, held, n = [], [], [], 0

        def row():
            data = pack(np.frombuffer(b"".join(held), "<u4"))
            return record_batch(_FILE_ARROW, ([part], [before], [n], [keys], [lengths], [data]))

        for batch in sliced(batches, "text"):
            for key, text in zip(*pylists(batch, "doc_id", "text"), strict=True):
                code = coder.text(text or "") + end
                if keys and n + len(code) // 4 > SEGMENT_TOKENS:
                    yield row()
                    before += n
                    keys, lengths, held, n = [], [], [], 0
                keys.append(key)
                lengths.append(len(code) // 4)
                held.append(code)
                n += len(code) // 4
        if keys:
            yield row()

    (shipped(docs).select(F.col("doc_id").cast("long"), "text")
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, _FILE)
     .write.mode("error").parquet(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32
    of every document, all from the decoded files.

    Only one number per written partition (its ids) reaches the driver.
    """
    files = shipped(spark.read.schema(_FILE).parquet(folder))
    offsets, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        offsets[r.part] = total
        total += r.n
    starts = spark.sparkContext.broadcast(offsets)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for part, before, keys, lengths, data in zip(
                    *pylists(batch, "part", "before", "doc_ids", "lengths", "data"), strict=True):
                raw = unpack(data).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                at = ends - lengths
                yield record_batch(schema, (
                    keys, (at + before + starts.value[part]).tolist(), lengths,
                    [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]))

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """Write the documents' ids to a new file set in the shared folder and read it back."""
    spark = docs.sparkSession
    folder = staged_path(spark, "llm-token-files")
    write(docs, path, folder, end_id)
    return read(spark, folder)
