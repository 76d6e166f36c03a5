"""Byte-level BPE by a pair occurrence index.

All distinct tokens of a piece are laid out as linked symbols. The index maps each pair that some merge
names to all its positions; active ranks are applied in ascending order, each to its whole list at
once, and the neighbours' new pairs are entered into their lists. This equals merging token by token
because a merge never makes a pair of a lower rank than its own, which is checked when a vocabulary
is read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxweave.llm.arrow import pieces, small_batches
from voxweave.llm.pretoken import PIECE, SPECIAL, Words, vocabulary


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        ids, letters = raw["model"]["vocab"], byte_letters()
        self.text = [b""] * (1 + max([*ids.values(), *(t["id"] for t in raw["added_tokens"])]))
        for word, i in ids.items():
            self.text[i] = bytes(letters[c] for c in word)
        self.special = {t["content"].encode(): t["id"] for t in raw["added_tokens"]}
        if set(self.special) - {SPECIAL}:
            raise ValueError("added tokens other than <|endoftext|> are not supported")
        for word, i in self.special.items():
            self.text[i] = word
        self.byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte[b] = ids[c]
        self.rank, self.merge, born = {}, [], {}
        for r, pair in enumerate(raw["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if max(born.get(a, -1), born.get(b, -1)) >= r:
                raise ValueError("a merge uses a symbol that a later merge makes")
            born.setdefault(a + b, r)
            self.rank[ids[a], ids[b]] = r
            self.merge.append((ids[a], ids[b], ids[a + b]))
        self.first = np.full((256, 256), -1, np.int64)
        back = {int(i): b for b, i in enumerate(self.byte)}
        for (a, b), r in self.rank.items():
            if a in back and b in back:
                self.first[back[a], back[b]] = r
        self.words = Words(self.encode)

    def encode(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(size)
        n = len(data)
        if not n:
            return [b""] * len(words)
        inner = np.ones(n, bool)  # positions with a next one in their token
        inner[end[size > 0] - 1] = False
        at = np.flatnonzero(inner)
        rank = self.first[data[at], data[at + 1]]
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        new = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else np.zeros(0, np.int64)
        where = {int(rank[s]): at[s:e].tolist() for s, e in zip(new, np.append(new[1:], len(rank)))}
        symbol = self.byte[data].tolist()
        after = np.where(inner, np.arange(1, n + 1), -1).tolist()
        before = np.concatenate([[-1], np.where(inner[:-1], np.arange(n - 1), -1)]).tolist()
        active, ranks, merge = list(where), self.rank, self.merge
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, made = merge[r]
            for p in sorted(where.pop(r)):
                q = after[p]
                if symbol[p] != a or q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = made, -1
                after[p] = nxt = after[q]
                if nxt >= 0:
                    before[nxt] = p
                    if (x := ranks.get((made, symbol[nxt]))) is not None:
                        if x in where:
                            where[x].append(p)
                        else:
                            where[x] = [p]
                            heapq.heappush(active, x)
                if (prev := before[p]) >= 0 and (x := ranks.get((symbol[prev], made))) is not None:
                    if x in where:
                        where[x].append(prev)
                    else:
                        where[x] = [prev]
                        heapq.heappush(active, x)
        left = np.array(symbol, np.int64)
        kept = left >= 0
        ids = left[kept].astype(np.uint32)
        upto = np.concatenate([[0], np.cumsum(kept)])
        out = [ids[s:e].tobytes() for s, e in zip(upto[end - size].tolist(), upto[end].tolist())]
        return [self.special[w].to_bytes(4, "little") if w in self.special else x for w, x in zip(words, out)] if any(w in self.special for w in words) else out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8; byte sequences that are none are replaced as the library does."""
        raw = b"".join(map(self.text.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()


_OPEN: dict[str, Bpe] = {}


def opened(path: str) -> Bpe:
    if path not in _OPEN:
        _OPEN[path] = Bpe(path)
    return _OPEN[path]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Whole texts are encoded and decoded again; null counts as empty, which has no ids and the hash of "".
    The text <|endoftext|> becomes its special id. Repeated rows give repeated results. An empty table gives no rows;
    other columns are not read.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(path)
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", PIECE):
                kinds, code, first = own.words.lookup(data, offsets)
                lists = [np.frombuffer(k, np.uint32).tolist() for k in kinds]
                said = [",".join(map(str, x)).encode() for x in lists]
                code = code.tolist()
                n, shas, back = [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    ids = [i for c in code[a:b] for i in lists[c]]
                    n.append(len(ids))
                    shas.append(hashlib.sha256(b",".join([said[c] for c in code[a:b]])).hexdigest())
                    back.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.record_batch([rows.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
