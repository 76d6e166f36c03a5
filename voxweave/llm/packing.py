"""Packing by power-of-two decomposition: a document of n ids becomes pieces of 2048 ids and one for each
binary digit of the rest. Each piece is a sequence, so no sequence crosses documents and none is padded;
sequences of equal length stand together, to be drawn as batches of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.llm.arrow import pieces, small_batches
from voxweave.llm.common import buckets, cut, prefix_sum
from voxweave.llm.pretoken import PIECE, library, vocabulary

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def lengths(n: int, most: int) -> list[int]:
    """Powers of two that sum to n, the largest first, none over most (itself a power of two)."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def pack(docs: DataFrame, most: int = 2048, end_id: int = 1, path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked for).

    A document is the ids of its whole text and end_id, so null and empty texts have one piece of one id.
    sequence_id counts from 0 without gaps, longest sequences first; offset is 0. Repeated rows are packed
    each. The order of pieces of equal length is by hash, and of equal rows arbitrary. Very long texts are encoded whole.
    An empty table gives no rows; other columns are not read.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library(path)
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", PIECE):
                flat, at = own.ids(data, offsets)
                doc, start, size, crc, total, tokens = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    x = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    s = 0
                    for n in lengths(len(x), most):
                        raw = x[s : s + n].tobytes()
                        doc.append(i)
                        start.append(s)
                        size.append(n)
                        crc.append(zlib.crc32(raw))
                        if ids:
                            tokens.append(x[s : s + n].astype(np.int32))
                        s += n
                    total += [s] * (len(doc) - len(total))
                cols = [rows.column(0).take(pa.array(doc, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, size, crc, total))]
                yield pa.record_batch([*cols, *([pa.array(tokens, pa.list_(pa.int32()))] if ids else [])], NAMES + ["ids"] * ids)

    made = small_batches(docs.select("doc_id", "text")).mapInArrow(run, ", ".join(f"{c} long" for c in NAMES) + ", ids array<int>" * ids)
    made = cut(made.withColumn("mix", F.xxhash64("doc_id", "start")), "pieces")
    count = buckets(made.count())
    made = made.withColumn("bucket", F.lit(count) * (F.lit(most.bit_length()) - F.length(F.bin("length"))) + F.pmod("mix", F.lit(count)))
    out = prefix_sum(made.withColumn("one", F.lit(1)), [], "bucket", ["mix", "doc_id", "start"], "one", "sequence_id")
    return out.select(*NAMES, "sequence_id", F.lit(0).cast("long").alias("offset"), *["ids"] * ids)
