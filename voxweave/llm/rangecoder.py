"""Token ids in files: an adaptive context-mixing range coder in independent, checksummed blocks.

An id's probability is a mixture of three predictions, `w2 * P2 + w1 * P1 + w0 * P0`: P2 and P1 are the id that
followed the two ids before (order 2) or the one before (order 1), as a hashed and a direct table hold it with
the confidence it has earned, and P0 is the adaptive distribution of all ids met so far (order 0). The weights adapt for
each pair of confidences, by how often either prediction was right there. The mixture is one interval of the range for each id:
order 0's share of it, and behind that the weights of the predictions that name it. Ids not met yet are an escape and equal shares.

A block is cut into lanes of equal length, coded side by side by one common model: each array operation is one step of all
lanes, and the model learns from all of them after each step. Every block starts afresh with its own model and ends
with the CRC-32 of its ids, so it can be read alone.

A file is a table of segments in document order (columns part, segment, n_tokens, payload), so any
store that Spark writes will do. A payload is, in little-endian integers:
  magic "VXR2", uint32 version of the model's constants, uint32 documents, uint32 blocks, uint32 ids a block, uint32 ids
  of the vocabulary, int64 id of each document, a byte for each (1: the id is null), uint32 ids of each document,
  then for each block uint32 CRC-32 of its ids, uint32 lanes, uint32 words of each lane and the lanes' 32-bit words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.llm.arrow import pieces, small_batches
from voxweave.llm.common import prefix_sum
from voxweave.llm.pretoken import PIECE, library, vocabulary

MAGIC, VERSION, BLOCK, SEGMENT = b"VXR2", 2, 1 << 21, 2_000_000
LANES, SHORTEST = 8192, 256  # lanes of a block, and the least ids of a lane
SLOTS = 18  # bits of the order-2 table's index
SHARE = 18  # bits of order 0's counts; a weight of 1 / 256 is as large as all of them
TOTAL = np.uint64(SHARE + 8)
MOST = 1 << 16  # ids of a vocabulary
SURE = 7
LEAST, W32, M32 = np.uint64(1 << 32), np.uint64(32), np.uint64(0xFFFFFFFF)


def shape(n: int) -> tuple[int, int, int]:
    """(lanes, ids of the first lanes, how many have so many; the others have one less) of a block of n ids."""
    lanes = max(1, min(LANES, n // SHORTEST))
    longest = -(-n // lanes)
    return lanes, longest, n - lanes * (longest - 1)


class Model:
    """What a block has taught so far. Ids are counted from 1: 0 stands for none, and in order 0 for the escape."""

    def __init__(self, lanes: int, size: int):
        self.size = size
        self.two, self.one = np.zeros(1 << SLOTS, np.uint32), np.zeros(size + 1, np.uint32)  # id * 8 + confidence; 0: nothing yet
        self.count, self.met, self.new = np.zeros(size + 1, np.int64), [], []
        self.p1, self.h2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        sure = np.arange(SURE + 1)
        self.hits = np.zeros((SURE + 1, SURE + 1, 2, 3))
        self.hits[..., 0] = sure[:, None, None]
        self.hits[..., 1] = np.where(np.arange(2) == 1, 0, sure[None, :, None])
        self.hits[..., 2] = 2
        self.hits = self.hits.reshape(-1, 3)
        conf, right = sure[:, None], np.arange(2)[None, :]
        #: What a slot's confidence gains or loses, by confidence * 2 + right; a wrong one of at most 1 is replaced.
        self.move = np.where(right, conf < SURE, -((conf + 1) // 2)).astype(np.int32).view(np.uint32).ravel()
        self.stay = ((right == 1) | (conf > 1)).ravel()
        self.weigh()
        self.tally()

    def weigh(self) -> None:
        """The weights, in 256ths, from the hits; older hits count for less."""
        if self.new:
            n = len(self.hits) * 4
            self.hits += np.bincount(np.concatenate(self.new), minlength=n).reshape(-1, 4)[:, :3]
            self.new = []
        sums = self.hits.sum(1)
        w2, w1 = ((250 * self.hits[:, i] / sums).astype(np.uint32) for i in (0, 1))
        self.w2, self.w1, self.w0 = w2 << np.uint32(SHARE), w1 << np.uint32(SHARE), np.uint32(256) - w2 - w1
        self.hits *= 0.75

    def tally(self) -> None:
        """Order 0's shares from the counts: one for each id met and for the escape, the rest in proportion."""
        if self.met:
            self.count += np.bincount(np.concatenate(self.met), minlength=self.size + 1)
            self.met = []
        self.count[0] = 1 + int(np.count_nonzero(self.count == 1))
        seen = self.count > 0
        spare = (1 << SHARE) - int(seen.sum())
        share = self.count * spare // int(self.count.sum()) + seen
        share[0] += (1 << SHARE) - int(share.sum())
        self.share = share.astype(np.uint32)
        self.upto = np.cumsum(share).astype(np.uint32)
        self.begin = self.upto - self.share
        self.named = None

    def names(self) -> np.ndarray:
        """The id of each of order 0's shares."""
        if self.named is None:
            self.named = np.repeat(np.arange(self.size + 1, dtype=np.uint32), self.share)
        return self.named

    def foretell(self, n: int) -> tuple[np.ndarray, ...]:
        p1 = self.p1[:n]
        at = (self.h2[:n] ^ (p1 * np.uint32(0x9E3779B1))) >> np.uint32(32 - SLOTS)
        e2, e1 = self.two.take(at), self.one.take(p1)
        c2, c1 = e2 & np.uint32(7), e1 & np.uint32(7)
        g2, g1 = e2 >> np.uint32(3), e1 >> np.uint32(3)
        context = (c2 << np.uint32(4)) | (c1 << np.uint32(1)) | (g2 == g1)
        return at, e2, e1, c2, c1, g2, g1, context

    def learn(self, n: int, t: int, x: np.ndarray, seen: tuple[np.ndarray, ...], is2: np.ndarray, is1: np.ndarray) -> None:
        at, e2, e1, c2, c1, _, _, context = seen
        fresh = (x << np.uint32(3)) | np.uint32(1)
        k = (c2 << np.uint32(1)) | is2
        self.two[at] = np.where(self.stay.take(k), e2 + self.move.take(k), fresh)
        k = (c1 << np.uint32(1)) | is1
        self.one[self.p1[:n]] = np.where(self.stay.take(k), e1 + self.move.take(k), fresh)
        self.new.append((context << np.uint32(2)) | np.where(is2, np.uint32(0), np.uint32(2) - is1))
        self.met.append(x)
        self.h2[:n] = self.p1[:n] * np.uint32(0x85EBCA77)
        self.p1[:n] = x
        early = t & (t + 1) == 0
        if early or t % 8 == 7:
            self.weigh()
        if early or t % 32 == 31:
            self.tally()


def _encode_block(ids: np.ndarray, size: int) -> bytes:
    lanes, longest, full = shape(len(ids))
    steps = np.zeros((longest, lanes), np.uint32)
    steps[:, :full] = ids[: full * longest].reshape(full, longest).T
    if full < lanes:
        steps[:-1, full:] = ids[full * longest :].reshape(lanes - full, longest - 1).T
    steps += np.uint32(1)
    model = Model(lanes, size)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    room = 2 * longest + 2  # words of a lane: an id and an escape are at most two
    out, first = np.zeros(lanes * room, np.int64), np.arange(lanes) * room
    at = first + 1  # a carry may reach the word before the first

    def narrow(i: np.ndarray | slice, lo: np.ndarray, start: np.ndarray, r: np.ndarray, size: np.ndarray) -> None:
        """The ranges of lanes i become [start, start + size) of their shares of width r; full words move out."""
        end = lo + start * r
        if len(c := np.flatnonzero(end < lo)):
            out[at[i][c] - 1] += 1
        r = r * size
        if len(small := np.flatnonzero(r < LEAST)):
            own = small if isinstance(i, slice) else i[small]
            w = end[small]
            out[at[own]] = w >> W32
            at[own] += 1
            end[small] = w << W32
            r[small] <<= W32
        low[i], width[i] = end, r

    for t in range(longest):
        n = lanes if t < longest - 1 else full
        x = steps[t, :n]
        seen = model.foretell(n)
        _, _, _, _, _, g2, g1, context = seen
        w2, w1, w0 = model.w2.take(context), model.w1.take(context), model.w0.take(context)
        is2, is1 = g2 == x, g1 == x
        start = model.begin.take(x) * w0 + w2 * (g2 < x) + w1 * (g1 < x)
        own = model.share.take(x) * w0 + w2 * is2 + w1 * is1
        if len(escaped := np.flatnonzero(own == 0)):
            start[escaped] = 0
            own[escaped] = model.share[0] * w0[escaped]
        narrow(slice(0, n), low[:n], start, width[:n] >> TOTAL, own)
        if len(escaped):
            narrow(escaped, low[escaped], (x[escaped] - np.uint32(1)).astype(np.uint64), width[escaped] // np.uint64(size), np.uint64(1))
        model.learn(n, t, x, seen, is2, is1)
    last = low + M32  # the range holds a value whose lower word is 0
    out[at - 1] += last < low
    out[at] = last >> W32
    count = at + 1 - first
    table = out.reshape(lanes, room)
    for j in range(int(count.max()) - 1, 0, -1):
        table[:, j - 1] += table[:, j] >> 32
    used = (np.arange(room) >= 1) & (np.arange(room) < count[:, None])
    body = (table[used] & 0xFFFFFFFF).astype("<u4").tobytes()
    return struct.pack("<2I", zlib.crc32(ids.astype("<u4").tobytes()), lanes) + (count - 1).astype("<u4").tobytes() + body


def _decode_block(payload: bytes, at: int, n: int, size: int) -> tuple[np.ndarray, int]:
    """(ids, where the next block begins)."""
    crc, lanes = struct.unpack_from("<2I", payload, at)
    own, longest, full = shape(n)
    if lanes != own:
        raise ValueError("a block is damaged")
    count = np.frombuffer(payload, "<u4", lanes, at + 8).astype(np.int64)
    room = int(count.max()) + 2
    if room > 2 * longest + 4:
        raise ValueError("a block is damaged")
    begin = at + 8 + 4 * lanes
    words = np.zeros((lanes, room), np.uint64)
    words[np.arange(room) < count[:, None]] = np.frombuffer(payload, "<u4", int(count.sum()), begin)
    words = words.ravel()
    first = np.arange(lanes) * room
    model = Model(lanes, size)
    code, width = words[first] << W32 | words[first + 1], np.full(lanes, ~np.uint64(0))
    at_word = first + 2
    steps = np.zeros((longest, lanes), np.uint32)

    def narrow(i: np.ndarray | slice, start: np.ndarray, r: np.ndarray, size: np.ndarray) -> None:
        end = code[i] - start * r
        r = r * size
        if len(small := np.flatnonzero(r < LEAST)):
            own = small if isinstance(i, slice) else i[small]
            end[small] = end[small] << W32 | words[at_word[own]]
            at_word[own] += 1
            r[small] <<= W32
        code[i], width[i] = end, r

    for t in range(longest):
        live = lanes if t < longest - 1 else full
        seen = model.foretell(live)
        _, _, _, _, _, g2, g1, context = seen
        w2, w1, w0 = model.w2.take(context), model.w1.take(context), model.w0.take(context)
        r = width[:live] >> TOTAL
        v = np.minimum(code[:live] // r, np.uint64((1 << (SHARE + 8)) - 1)).astype(np.uint32)
        a, b = np.minimum(g2, g1), np.maximum(g2, g1)
        wa = np.where(g2 < g1, w2, w1)
        wb = w2 + w1 - wa
        # The weights behind their ids' shares are taken out, the lower id's first; what is left is order 0's.
        ua = model.upto.take(a) * w0
        in_a = v - ua < wa  # unsigned: what is before wraps round
        v -= wa * (v >= ua + wa)
        ub = model.upto.take(b) * w0
        in_b = v - ub < wb
        v -= wb * (v >= ub + wb)
        x = np.where(in_a, a, np.where(in_b, b, model.names().take(v // w0, mode="clip")))
        is2, is1 = g2 == x, g1 == x
        escaped = np.flatnonzero(x == 0)
        start = model.begin.take(x) * w0 + w2 * (g2 < x) + w1 * (g1 < x)
        share = model.share.take(x) * w0 + w2 * is2 + w1 * is1
        if len(escaped):
            start[escaped] = 0
            share[escaped] = model.share[0] * w0[escaped]
        narrow(slice(0, live), start, r, share)
        if len(escaped):
            r = width[escaped] // np.uint64(size)
            rest = np.minimum(code[escaped] // r, np.uint64(size - 1))
            narrow(escaped, rest, r, np.uint64(1))
            x[escaped] = rest.astype(np.uint32) + np.uint32(1)
            is2, is1 = g2 == x, g1 == x
        steps[t, :live] = x
        model.learn(live, t, x, seen, is2, is1)
    steps -= np.uint32(1)
    ids = np.concatenate([steps[:, :full].T.ravel(), steps[:-1, full:].T.ravel()]).astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block does not match its checksum")
    return ids, begin + 4 * int(count.sum())


def encode(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A payload of whole documents; ids are their uint32 ids one after another, all under MOST."""
    size = int(ids.max(initial=0)) + 1
    if size > MOST:
        raise ValueError(f"ids of {MOST} and over are not supported")
    ids = ids.astype(np.uint32)
    parts = [_encode_block(ids[a : a + block], size) for a in range(0, len(ids), block)]
    head = MAGIC + struct.pack("<5I", VERSION, len(doc_ids), len(parts), block, size)
    null = np.array([i is None for i in doc_ids], np.uint8)
    return b"".join([head, np.array([i or 0 for i in doc_ids], "<i8").tobytes(), null.tobytes(), np.array(lengths, "<u4").tobytes(), *parts])


def decode(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a payload. Raises ValueError if it is damaged."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    try:
        version, docs, blocks, block, size = struct.unpack_from("<5I", payload, 4)
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        at = 24
        own = np.frombuffer(payload, "<i8", docs, at).tolist()
        null = np.frombuffer(payload, np.uint8, docs, at := at + 8 * docs)
        lengths = np.frombuffer(payload, "<u4", docs, at := at + docs)
        at += 4 * docs
        total = int(lengths.sum(dtype=np.int64))
        if not block or blocks != -(-total // block):
            raise ValueError("a segment is incomplete")
        found = []
        for i in range(blocks):
            ids, at = _decode_block(payload, at, min(block, total - i * block), size)
            found.append(ids)
    except (IndexError, struct.error, ZeroDivisionError) as e:
        raise ValueError("a segment is damaged") from e
    if at != len(payload):
        raise ValueError("a segment is incomplete")
    return [None if n else i for i, n in zip(own, null.tolist())], lengths, np.concatenate(found) if found else np.zeros(0, "<u4")


def write(docs: DataFrame, path: str, end_id: int = 2, vocab: str | None = None, segment: int = SEGMENT) -> None:
    """Writes the ids of every text, each followed by end_id, in ascending doc_id order; null doc_ids come first.

    Null text counts as empty, which has end_id alone. Rows that repeat a doc_id stand together, in the order that they
    are read; they may be dealt to several tasks. Very long texts are whole in one segment. An empty table makes no segments.
    Other columns than doc_id and text are not read.
    """
    vocab = vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = library(vocab), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, doc_ids, lengths, held
            ids = np.concatenate(held)
            out = pa.record_batch([pa.array([part]), pa.array([number]), pa.array([len(ids)]), pa.array([encode(doc_ids, lengths, ids)], pa.binary())], ["part", "segment", "n_tokens", "payload"])
            number, doc_ids, lengths, held = number + 1, [], [], []
            return out

        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", PIECE):
                flat, at = own.ids(data, offsets)
                held.append(np.insert(flat, at[1:], end_id))
                doc_ids += rows.column(0).to_pylist()
                lengths += (np.diff(at) + 1).tolist()
                if sum(map(len, held)) >= segment:
                    yield flush()
        if held:
            yield flush()

    given = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("row", F.monotonically_increasing_id())
    ordered = given.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    ordered.mapInArrow(run, "part long, segment long, n_tokens long, payload binary").write.parquet(path)


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, from their decoded ids; a damaged segment is an error."""
    base = prefix_sum(files.select("part", "segment", "n_tokens"), [], "part", ["segment"], "n_tokens", "base").select("part", "segment", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, ids = decode(batch.column(1)[i].as_py())
                end = np.cumsum(lengths, dtype=np.int64)
                start = end - lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(start.tolist(), end.tolist())]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(start + batch.column(0)[i].as_py()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(base, ["part", "segment"]).select("base", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
