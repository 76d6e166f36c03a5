"""Exact dedup by content-defined chunk recipes.

Each text, without ASCII white space, is cut where a rolling hash of the last 32 bytes says so; its
recipe is the ordered list of its chunks' fingerprints and lengths. Only texts that share a recipe can
be equal. Their distinct chunks (each sent once per task, however many copies there are) are compared
byte by byte: a fingerprint that stands for one chunk only is a verified identifier, and lists of such
are compared in place of texts. A text with a fingerprint that stands for several chunks is
compared as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.llm.arrow import pieces, small_batches, sums
from voxweave.llm.common import cut, release, spread_join

WHITE = np.ones(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = False
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, np.uint32)
LEAST, MOST, MASK, MARK = 256, 8192, np.uint32(1023 << 22), 16


def fingerprint(chunk: memoryview) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: a gear hash of the 32 bytes up to there has ten zero bits."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            h[s:] += h[:-s] << np.uint32(s)
    return np.flatnonzero((h & MASK) == 0) + 1


def ends(start: int, end: int, may: np.ndarray) -> list[int]:
    """The ends of the chunks of data[start:end]. A chunk is longer than the window, so texts do not affect each other."""
    out, at = [], start
    for x in may[np.searchsorted(may, start) : np.searchsorted(may, end)].tolist():
        while x - at > MOST:
            at += MOST
            out.append(at)
        if x - at >= LEAST:
            out.append(at := x)
    while end - at > MOST:
        at += MOST
        out.append(at)
    return out if at == end and out else [*out, end]


def squeezed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, code points of each text, bytes without white space, offsets)."""
    for rows, data, offsets in pieces(batch, "text"):
        points = sums((data & 0xC0) != 0x80, offsets)
        keep = WHITE[data]
        yield rows, points, data[keep], np.concatenate([[0], np.cumsum(sums(keep, offsets))])


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[memoryview]]:
    view, may = memoryview(np.ascontiguousarray(data)), cuts(data)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        edge = [s, *ends(s, e, may)]
        yield [view[a:b] for a, b in zip(edge, edge[1:])]


def _mark(chunk: memoryview, mark: Callable) -> bytes:
    return mark(chunk).ljust(MARK, b"\0") + len(chunk).to_bytes(4, "little")


def _recipe(parts: list[memoryview], mark: Callable) -> bytes:
    return b"".join(_mark(x, mark) for x in parts)


def exact_dedup(docs: DataFrame, mark: Callable[[memoryview], bytes] = fingerprint) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without [\\x20\\x09-\\x0D]; null counts as empty, and empty texts are
    equal to each other. The longest original (code points) stays, then the smallest doc_id. Rows that
    repeat a doc_id and its text all count, and are kept or dropped together. A null doc_id sorts last. Very long
    texts are read whole. An empty table gives no rows; other columns are not read.
    mark: the chunk fingerprint, of 16 bytes at most; results do not depend on it.
    """
    docs = small_batches(docs.select("doc_id", "text"))

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, points, data, offsets in squeezed(batch):
                view = memoryview(data)
                sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
                made = [_recipe(x, mark) for x in chunks(data, offsets)]
                yield pa.record_batch([rows.column(0), pa.array(points), pa.array(sha), pa.array(made, pa.binary())], ["doc_id", "points", "text_sha256", "recipe"])

    made = cut(docs.mapInArrow(recipes, "doc_id long, points long, text_sha256 string, recipe binary"), "recipes")
    alike = cut(made.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    again = cut(spread_join(made.select("recipe", "doc_id"), alike, "recipe", "n").select("doc_id").distinct(), "alike")

    def distinct_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for _, _, data, offsets in squeezed(batch):
                out: dict[bytes, bytes] = {}
                for parts in chunks(data, offsets):
                    for x in parts:
                        if (whole := hashlib.sha256(x).digest()) not in sent:
                            sent.add(whole)
                            out[whole] = (_mark(x, mark), bytes(x))
                if len(sent) > 200_000:
                    sent.clear()
                if out:
                    yield pa.record_batch([pa.array([a for a, _ in out.values()], pa.binary()), pa.array([b for _, b in out.values()], pa.binary())], ["mark", "chunk"])

    texts = docs.join(again.withColumnRenamed("doc_id", "id").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    kinds = texts.mapInArrow(distinct_chunks, "mark binary, chunk binary").groupBy("mark").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    bad = cut(kinds.where("low <> high").select("mark"), "unverified")
    release(alike, again)
    own = made.withColumn("ident", F.concat(F.lit(b"\x00"), "recipe"))
    if not bad.isEmpty():
        own = _with_whole_texts(docs, made, bad)
    best = F.max(F.struct("points", F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("low"), "doc_id"))
    groups = cut(own.groupBy("ident").agg(F.count("*").alias("group_size"), best["doc_id"].alias("keep_id")), "groups")
    out = spread_join(own.select("doc_id", "text_sha256", "ident"), groups, "ident", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_whole_texts(docs: DataFrame, made: DataFrame, bad: DataFrame) -> DataFrame:
    """ident is the whole text for rows whose recipe has a fingerprint that stands for several chunks."""

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, data, offsets in squeezed(batch):
                view = memoryview(data)
                whole = [bytes(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                sha = [hashlib.sha256(x).hexdigest() for x in whole]
                yield pa.record_batch([rows.column(0), pa.array(sha), pa.array(whole, pa.binary())], ["id", "sha", "whole"])

    steps = F.sequence(F.lit(1), F.length("recipe"), F.lit(MARK + 4))
    marks = made.select("recipe", F.explode(F.transform(steps, lambda i: F.substring("recipe", i, MARK + 4))).alias("mark"))
    rows = made.join(marks.join(bad, "mark", "left_semi").select("recipe").distinct(), "recipe", "left_semi").select("doc_id").distinct()
    texts = docs.join(rows, docs.doc_id.eqNullSafe(rows.doc_id), "left_semi")
    whole = texts.mapInArrow(wholes, "id long, sha string, whole binary").distinct()
    found = made.join(whole, made.doc_id.eqNullSafe(whole.id) & (made.text_sha256 == whole.sha), "left")  # sha only finds the row again
    ident = F.when(F.col("whole").isNotNull(), F.concat(F.lit(b"\x01"), "whole")).otherwise(F.concat(F.lit(b"\x00"), "recipe"))
    return found.withColumn("ident", ident).drop("id", "sha", "whole")
