"""Work that needs a model, behind one interface.

A provider is a small picklable description of a model; executors open it once a worker, and texts reach it in
chunks, so a backbone runs once for many sentences. What it returns does not depend on how rows are dealt
to partitions. No weights come with this library: RuleProvider stands in for them by rules, and says nothing of
what a trained model would answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxweave.functions.text import ENDINGS, HETERONYMS, NATIVE_UNITS, UNITS
from voxweave.operators.wordpiece import WordPiece, plain_vocabulary
from voxweave.sources.config import resolve_device

#: What heads may fill, each a list of spans.
HEADS = ("annotations", "numbers", "heteronym", "counter", "morphemes")
SPAN = pa.struct([("span", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("conf", pa.float32())])
SPAN_SQL = "struct<span:string,start:int,end:int,label:string,conf:float>"
FEATURES = "features array<float>, seq_len int, hidden_dim int, word2ph array<int>"


class Encoded(NamedTuple):
    """The hidden states of a text, a row a token, and each token's code points in it (equal ends: a special token)."""

    states: np.ndarray
    starts: list[int]
    ends: list[int]


class Model(Protocol):
    def encode(self, texts: list[str]) -> list[Encoded]:
        """The backbone, once for all texts."""

    def heads(self, text: str, encoded: Encoded) -> Mapping[str, list[tuple[int, int, str, float]]]:
        """(start, end, label, confidence) by name of HEADS, in order; a name that is missing has none."""


class Provider(Protocol):
    def open(self, device: str, threads: int) -> Model: ...


@lru_cache(100_000)
def _state(i: int, dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(i)).standard_normal(dim, np.float32)


@lru_cache(100_000)
def _labels(word: str) -> tuple[str | None, str | None]:
    """A word's ending and its heteronym label."""
    return next((k for k, p in ENDINGS.items() if re.search(p, word)), None), HETERONYMS.get(word.lower())


#: A numeral and the unit after it.
NUMERAL = re.compile(f"([0-9]+(?:[.][0-9]+)?)({'|'.join(sorted([*UNITS, *NATIVE_UNITS], key=lambda u: (-len(u), u)))})?")


@dataclass
class RuleProvider:
    """States from a generator seeded by each token's id; heads from digits, counters, endings and the heteronym table."""

    dim: int = 16
    tokenizer: WordPiece = field(default_factory=lambda: WordPiece(plain_vocabulary()))

    def open(self, device: str = "cpu", threads: int = 0) -> RuleProvider:
        return self

    def encode(self, texts: list[str]) -> list[Encoded]:
        ids, starts, ends, offsets = self.tokenizer.encode_all(texts)
        kinds, which = np.unique(ids, return_inverse=True)
        states = np.array([_state(i, self.dim) for i in kinds.tolist()], np.float32).reshape(-1, self.dim)[which]
        return [Encoded(states[a:b], starts[a:b].tolist(), ends[a:b].tolist()) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]

    def heads(self, text: str, encoded: Encoded) -> dict[str, list]:
        found: dict[str, list] = {name: [] for name in HEADS}
        for m in NUMERAL.finditer(text):
            found["numbers"].append((m.start(1), m.end(1), "decimal" if "." in m[1] else "cardinal", 1.0))
            if m[2]:
                found["counter"].append((m.start(), m.end(), "native" if m[2] in NATIVE_UNITS else "sino", 1.0))
        for m in re.finditer(r"\S+", text):
            ending, heteronym = _labels(m[0]) if m.end() - m.start() <= 100 else _labels.__wrapped__(m[0])
            if ending:
                found["morphemes"].append((m.start(), m.end(), ending, 1.0))
            if heteronym:
                found["heteronym"].append((m.start(), m.end(), heteronym, 1.0))
        found["annotations"] = [(s, e, k, c) for s, e, k, c in found["numbers"]]
        return found


def _schema(df: DataFrame, more: str) -> str:
    names = [x.split(" ")[0] for x in more.split(", ")]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are in the table")
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + more


def _opened(provider: Provider, device: str | None, threads: int) -> Model:
    return provider.open(resolve_device(device, {}), threads)


def features(df: DataFrame, column: str, provider: Provider, device: str | None = None, threads: int = 0, chunk: int = 32) -> DataFrame:
    """df with FEATURES: the flat hidden states, their shape, and how many characters each token stands for (special tokens: 0). Null counts as empty."""
    at, schema = df.columns.index(column), _schema(df, FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _opened(provider, device, threads)
        for batch in batches:
            for s in range(0, batch.num_rows, chunk):
                part = batch.slice(s, chunk)
                got = model.encode([t or "" for t in part.column(at).to_pylist()])
                flat = pa.array([e.states.ravel() for e in got], pa.list_(pa.float32()))
                shape = [pa.array([e.states.shape[i] for e in got], pa.int32()) for i in (0, 1)]
                spread = pa.array([[b - a for a, b in zip(e.starts, e.ends)] for e in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat, *shape, spread], [*part.schema.names, "features", "seq_len", "hidden_dim", "word2ph"])

    return df.mapInArrow(run, schema)


def annotate(df: DataFrame, column: str, provider: Provider, device: str | None = None, threads: int = 0, chunk: int = 32, given: tuple[str, str, str] | None = None, prefix: str = "") -> DataFrame:
    """df with a column of spans for each of HEADS (named with prefix).

    chunk: how many texts the backbone gets at once.
    given: columns with the flat states and each token's start and end, if the backbone has run elsewhere; then only the
    heads run here. Null counts as empty.
    """
    names, at = df.columns, df.columns.index(column)
    schema = _schema(df, ", ".join(f"{prefix}{h} array<{SPAN_SQL}>" for h in HEADS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _opened(provider, device, threads)
        for batch in batches:
            for s in range(0, batch.num_rows, max(chunk, 32)):
                part = batch.slice(s, max(chunk, 32))
                texts = [t or "" for t in part.column(at).to_pylist()]
                if given:
                    flat, starts, ends = (part.column(names.index(c)).to_pylist() for c in given)
                    got = [Encoded(np.array(f or [], np.float32).reshape(len(a or []), -1 if f else 0), a or [], b or []) for f, a, b in zip(flat, starts, ends)]
                else:
                    got = [e for k in range(0, len(texts), chunk) for e in model.encode(texts[k : k + chunk])]
                found = [model.heads(t, e) for t, e in zip(texts, got, strict=True)]
                cols = [pa.array([[{"span": t[a:b], "start": a, "end": b, "label": k, "conf": c} for a, b, k, c in f.get(h, [])] for t, f in zip(texts, found)], pa.list_(SPAN)) for h in HEADS]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*names, *(prefix + h for h in HEADS)])

    return df.mapInArrow(run, schema)
