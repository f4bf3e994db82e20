"""Operator 2: token ids in static range-asymmetric-numeral-system shards.

A shard is one binary value (little-endian):

    magic "RLS1" | u8 scale bits | u8 flags | u16 lanes | u32 steps between checkpoints
    u64 tokens | u32 documents | u32 symbols | u32 blocks | u64 start (ids before it in its partition)
    symbols: u32 ids, u32 frequencies (they sum to 2**scale bits); shared by every block of the shard
    documents: i64 doc_ids, u8 null marks, u32 token counts
    blocks: u32 tokens, u32 words, u32 checkpoints each
    checkpoints, block by block: u64 state of each lane, u32 position in the block's words
    words: u32, block by block
    u32 crc32 of each block's decoded ids, u32 crc32 of all that is before

A block holds BLOCK tokens in LANES interleaved coders: token i is coded by lane i % LANES. Blocks
are independent, and each checkpoint of a block has all that is needed to decode on from there, so
the reader decodes every stretch between checkpoints of every block in lockstep.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import work
from rasterlake.llm.chunks import LONE_LIBRARY_CHUNKS, library_encoder

MAGIC = b"RLS1"
HEAD = struct.Struct("<4sBBHIQIIIQ")
LANES, STRIDE, BLOCK = 256, 256, 1 << 18  # a checkpoint every STRIDE steps, i.e. 65,536 tokens
SHARD_TOKENS = 1 << 21
SLICE = 4 << 20  # bytes of text that are encoded at once
FLOOR = np.uint64(1 << 31)
END_ID = 0

SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, payload binary"


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**bits."""
    total, goal = int(counts.sum()), 1 << bits
    freq = np.maximum(1, counts.astype(np.int64) * goal // total)
    while (over := int(freq.sum()) - goal) > 0:  # take from the largest, which lose least
        order = np.argsort(-freq, kind="stable")
        room = freq[order] - np.maximum(1, freq[order] // 2)
        take = np.minimum(room, np.maximum(0, over - (np.cumsum(room) - room)))
        freq[order] -= take
    freq[np.argmax(freq)] += goal - int(freq.sum())
    return freq


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, start: int = 0) -> bytes:
    """The bytes of one shard. ids: every document's ids, one after the other."""
    n = len(ids)
    if n and int(ids.max()) < 1 << 22:
        count = np.bincount(ids)
        symbols = np.flatnonzero(count)
        place = np.zeros(len(count), np.int64)
        place[symbols] = np.arange(len(symbols))
        index, count = place[ids], count[symbols]
    else:
        symbols, index, count = np.unique(ids, return_inverse=True, return_counts=True)
    bits = max(12, int(len(symbols)).bit_length() + 2) if n else 12
    freq = scaled(count, bits) if n else np.zeros(0, np.int64)
    cum = np.cumsum(freq) - freq
    blocks = -(-n // BLOCK)
    steps = BLOCK // LANES
    grid = np.full((blocks, BLOCK), -1, np.int64)
    grid.reshape(-1)[:n] = index
    grid = grid.reshape(blocks, steps, LANES)
    f64, c64, shift = freq.astype(np.uint64), cum.astype(np.uint64), np.uint64(bits)
    state = np.full(blocks * LANES, FLOOR, np.uint64)
    limit = f64 << np.uint64(63 - bits)
    lows: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    marks: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(blocks)]
    written = np.zeros(blocks, np.int64)
    whole = n // BLOCK * BLOCK
    for t in range(steps - 1, -1, -1):
        s = grid[:, t, :].reshape(-1)
        here = None
        if whole < n and n - whole < (t + 1) * LANES:  # the last block hasn't all lanes of this step
            here = s >= 0
            s = np.where(here, s, 0)
        f = f64[s]
        full = state >= limit[s]
        if here is not None:
            full &= here
        out = np.flatnonzero(full)[::-1]
        lows.append(state[out].astype(np.uint32))
        owners.append((out // LANES).astype(np.uint16))
        written += full.reshape(blocks, LANES).sum(axis=1)
        x = np.where(full, state >> np.uint64(32), state)
        q = x // f
        x = (q << shift) + (x - q * f) + c64[s]
        state = x if here is None else np.where(here, x, state)
        if t % STRIDE == 0:
            for b in range(blocks):
                if t * LANES < min(n - b * BLOCK, BLOCK):
                    marks[b].append((state[b * LANES : (b + 1) * LANES].copy(), int(written[b])))
    lows, owners = np.concatenate([*lows, np.empty(0, np.uint32)]), np.concatenate([*owners, np.empty(0, np.uint16)])
    lows = lows[np.argsort(owners, kind="stable")]
    stops = np.cumsum(written)
    body, table, points, crcs = [], [], [], []
    for b in range(blocks):
        words = lows[stops[b] - written[b] : stops[b]][::-1]
        body.append(words.astype("<u4").tobytes())
        part = ids[b * BLOCK : (b + 1) * BLOCK]
        table.append((len(part), len(words), len(marks[b])))
        crcs.append(zlib.crc32(part.astype("<u4").tobytes()))
        for lanes, done in reversed(marks[b]):
            points.append(lanes.astype("<u8").tobytes() + struct.pack("<I", len(words) - done))
    text = b"".join(
        [
            HEAD.pack(MAGIC, bits, 0, LANES, STRIDE, n, len(doc_ids), len(symbols), blocks, start),
            symbols.astype("<u4").tobytes(),
            freq.astype("<u4").tobytes(),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.asarray(counts).astype("<u4").tobytes(),
            np.array(table, "<u4").tobytes(),
            *points,
            *body,
            np.array(crcs, "<u4").tobytes(),
        ]
    )
    return text + struct.pack("<I", zlib.crc32(text))


def decode_shard(payload: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray, int]:
    """ids, doc_ids, ids per document, and the shard's start in its partition; ValueError if a checksum fails."""
    if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("the shard's checksum doesn't match")
    magic, bits, _, lanes, stride, n, docs, symbols, blocks, start = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a shard")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    names, freq = take("<u4", symbols), take("<u4", symbols).astype(np.uint64)
    doc_ids, null, counts = take("<i8", docs), take("u1", docs), take("<u4", docs).astype(np.int64)
    table = take("<u4", 3 * blocks).reshape(blocks, 3).astype(np.int64)
    total = int(table[:, 2].sum())
    point = take(np.dtype([("state", "<u8", lanes), ("at", "<u4")]), total)
    word = take("<u4", int(table[:, 1].sum())).astype(np.uint64)
    crcs = take("<u4", blocks)
    ids = np.empty(n, np.uint32)
    if n:
        word = np.append(word, np.uint64(0))
        slot = np.repeat(np.arange(symbols), freq.astype(np.int64))
        cum = np.cumsum(freq) - freq
        block = np.repeat(np.arange(blocks), table[:, 2])
        nth = np.arange(total) - np.repeat(np.cumsum(table[:, 2]) - table[:, 2], table[:, 2])
        first = np.cumsum(table[:, 0]) - table[:, 0]
        pos = (np.cumsum(table[:, 1]) - table[:, 1])[block] + point["at"]
        begin = first[block] + nth * stride * lanes
        end = np.minimum(begin + stride * lanes, (first + table[:, 0])[block])
        state = point["state"].astype(np.uint64)
        lane, mask, shift = np.arange(lanes), np.uint64((1 << bits) - 1), np.uint64(bits)
        tail = pos[-1:], begin[-1:], end[-1:], state[-1:]
        parts = [(pos, begin, end, state)]
        if total > 1 and (end - begin)[-1] < stride * lanes:  # only the last stretch may be short: the others need no masks
            parts = [(pos[:-1], begin[:-1], end[:-1], state[:-1]), tail]
        for pos, begin, end, state in parts:
            even = bool((end - begin == stride * lanes).all())
            made = np.empty((len(begin), stride, lanes), np.uint32)
            for t in range(stride):
                here = True if even else begin[:, None] + t * lanes + lane < end[:, None]
                if not np.any(here):
                    break
                low = state & mask
                s = slot[low.astype(np.int64)]
                made[:, t, :] = names[s]
                x = freq[s] * (state >> shift) + low - cum[s]
                need = x < FLOOR
                if not even:
                    x = np.where(here, x, state)
                    need &= here
                order = np.cumsum(need, axis=1)
                at = pos[:, None] + order - 1
                state = np.where(need, (x << np.uint64(32)) | word[np.minimum(at, len(word) - 1)], x)
                pos = pos + order[:, -1]
            made = made.reshape(len(begin), -1)
            for k, (i, j) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                ids[i:j] = made[k, : j - i]
        for b in range(blocks):
            if zlib.crc32(ids[first[b] : first[b] + table[b, 0]].astype("<u4").tobytes()) != crcs[b]:
                raise ValueError(f"block {b}: the ids' checksum doesn't match")
    return ids, [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)], counts, start


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes each whole text (null: empty), appends end_id, and writes shards in ascending doc_id order
    (null ids first; equal ids by their text's hash) to the table at path. The texts are dealt out by ranges of both, so
    partitions and the shards in them are in order; Spark's committer keeps one copy of each task's output.
    An empty table gives no shards. Columns other than doc_id and text are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = library_encoder(tokenizer, LONE_LIBRARY_CHUNKS), TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = seq = start = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq, start
            ids, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            names = [d for h in held for d in h[0]]
            row = [[part], [seq], [len(names)], [len(ids)], [encode_shard(ids, names, counts, start)]]
            seq, start, held, size = seq + 1, start + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for piece in work.slices(batch, "text", SLICE):
                names = piece.column("doc_id").to_pylist()
                flat, counts = encode.column(piece.column("text"))
                out = np.full(len(flat) + len(names), end_id, np.uint32)
                out[work.runs(counts, np.cumsum(counts + 1) - counts - 1)] = flat
                held.append((names, out, counts + 1))
                size += len(out)
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    (
        work.pick(docs, "doc_id", "text")
        .withColumn("hash", F.xxhash64("text"))
        .repartitionByRange("doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text")
        .drop("hash")
        .mapInArrow(run, SHARD_SCHEMA)
        .write.parquet(path)
    )


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the shards at path: doc_id, start (ids before it in the whole corpus), n_tokens, ids (u32
    little-endian). What each partition's shards hold is summed first: one number a partition, on the driver."""
    table = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = {r.part: r.n for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, offsets = 0, {}
    for part in sorted(totals):
        offsets[part] = before
        before += totals[part]

    def make():
        def one(c: dict) -> list:
            ids_of, starts, sizes, parts = [], [], [], []
            for part, payload in zip(c["part"], c["payload"], strict=True):
                ids, names, counts, start = decode_shard(payload)
                first = np.cumsum(counts) - counts
                raw = memoryview(ids.astype("<u4").tobytes())
                ids_of += names
                starts += (offsets[part] + start + first).tolist()
                sizes += counts.tolist()
                parts += [bytes(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), counts.tolist(), strict=True)]
            return [ids_of, starts, sizes, parts]

        return one

    return work.map_batches(table.select("part", "payload"), "doc_id long, start long, n_tokens long, ids binary", make, "payload")


def op2_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from shards written for the whole table."""
    import public_tokenizers

    path = work.new_table(spark, "rans")
    write_token_shards(work.read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
