"""WordPiece over Arrow batches: ids, mask, type ids and code point offsets of every text.

Runs of whole texts are encoded at once in numpy, and distinct words are split once and kept, up to a bound; what a task
holds does not grow with the table. The vocabulary goes to the executors inside the function, so it should have at most some hundred
thousand entries (it is refused above `most`).
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SCHEMA = "ids array<int>, mask array<int>, type_ids array<int>, starts array<int>, ends array<int>"
#: Rows of an Arrow batch of whole texts, bytes of the texts that are encoded at once, and words that are kept.
ROWS, BYTES, WORDS = 1_000, 400_000, 200_000
#: Kinds of characters. Parts of words and marks stay.
PART, MARK, DROP, BLANK, UNKNOWN = range(5)
#: In place of a character's lower case: not known yet, or more than one character. FEW words are split one by one.
UNFOLDED, SEVERAL, FEW = 0xFFFFFFFF, 0x1FFFFF, 30


def _mark(c: str) -> bool:
    return c.isascii() and not c.isalnum() and c.isprintable() and c != " " or unicodedata.category(c)[0] == "P"


def _drop(c: str) -> bool:
    return c in "\0�" or c not in "\t\n\r" and unicodedata.category(c) in ("Cc", "Cf", "Cn", "Co")


def _han(c: str) -> bool:
    p = ord(c)
    return any(a <= p <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)))


class _Store:
    """Pieces of the words met so far, one after the other, and the kinds of characters. Entry 0 is a word too long to be kept."""

    def __init__(self, unk: int) -> None:
        self.entry: dict[str, int] = {}
        self.ids, self.starts, self.ends, self.at = array("i", [unk]), array("i", [0]), array("i", [0]), array("q", [0, 1])
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.folded = np.full(0x110000, UNFOLDED, np.uint32)

    def add(self, words: Sequence[str], counts: Sequence[int], ids: Sequence[int], ends: Sequence[int]) -> None:
        """Words with how many pieces each has, and the pieces of all in order."""
        at = np.cumsum(counts, dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int32)
        starts[at[:-1]] = 0
        self.entry.update(zip(words, range(len(self.at) - 1, len(self.at) - 1 + len(words))))
        self.at.frombytes((at + self.at[-1]).tobytes())
        for own, x in ((self.ids, ids), (self.starts, starts), (self.ends, ends)):
            own.frombytes(np.asarray(x, np.int32).tobytes())


@dataclass
class WordPiece:
    """Settings; special ids and limits have their usual values."""

    vocab: Mapping[str, int]
    cls: int = 2
    sep: int = 3
    unk: int = 1
    pad: int = 0
    lower: bool = True
    split_han: bool = False
    most_chars: int = 100
    prefix: str = "##"
    special: bool = True
    _store: _Store | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_store": None}

    def _kind(self, c: str) -> int:
        if c.isspace():
            return BLANK
        return MARK if _mark(c) or self.split_han and _han(c) else DROP if _drop(c) else PART

    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        table = self._store.kinds
        if len(new := chars[table[chars] == UNKNOWN]):
            for p in np.unique(new).tolist():
                table[p] = self._kind(chr(p))
        return table[chars]

    def split(self, word: str) -> tuple[list[int], list[int]] | None:
        """(ids, ends) of a word's pieces, the longest first from the left; None if it has no pieces."""
        n = len(word)
        if n > self.most_chars:
            return None
        folded = [c.lower() for c in word] if self.lower else word
        text = "".join(folded)
        ids, ends, at = [], [], 0
        for table, longest in self._tables:
            while at < n:
                for end in range(min(n, at + longest), at, -1):
                    if (i := table.get(text[at:end] if len(text) == n else "".join(folded[at:end]))) is not None:
                        break
                else:
                    return None
                ids.append(i)
                ends.append(end)
                at = end
                if len(ids) == 1:
                    break
        return ids, ends

    @cached_property
    def _tables(self) -> list[tuple[dict[str, int], int]]:
        """The pieces that begin words and those that go on, without their prefix, and the length of the longest."""
        found = [{p.removeprefix(x): i for p, i in self.vocab.items() if p.startswith(x)} for x in ("", self.prefix)]
        return [(t, max(map(len, t), default=0)) for t in found]

    @cached_property
    def _trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, children, ids): a node's number and a character make a key, in order; node 0 begins words, node 1 goes on. An id of -1 is none."""
        edges, ids = {}, {}
        for root, (table, _) in enumerate(self._tables):
            for piece, i in table.items():
                node = root
                for c in piece:
                    node = edges.setdefault(node << 21 | ord(c), len(edges) + 2)
                if node > 1:
                    ids[node] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        order, of = np.argsort(keys), np.full(len(edges) + 2, -1, np.int64)
        of[list(ids)] = list(ids.values())
        return keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order], of

    def _longest(self, chars: np.ndarray, at: np.ndarray, over: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
        """(id, end) of the longest piece from each place before its `over`; the id is -1 if there is none."""
        keys, children, of = self._trie
        ids, ends = np.full(len(at), -1, np.int64), at.copy()
        own, node, k = np.arange(len(at)), np.full(len(at), root, np.int64), 0
        while len(keys):
            inside = at[own] + k < over[own]
            own, node = own[inside], node[inside]
            key = node << 21 | chars[at[own] + k]
            j = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[j] == key
            own, node, k = own[hit], children[j[hit]], k + 1
            if not len(own):
                break
            done = of[node] >= 0
            ids[own[done]], ends[own[done]] = of[node[done]], at[own[done]] + k
        return ids, ends

    def _split_all(self, words: list[str]) -> list[str]:
        """Puts the words into the store as split() has them, all at once; what it leaves to split() is returned: words with a letter whose lower case is longer."""
        store = self._store
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if self.lower:
            for p in np.unique(chars[store.folded[chars] == UNFOLDED]).tolist():
                store.folded[p] = ord(x) if len(x := chr(p).lower()) == 1 else SEVERAL
            chars = store.folded[chars]
        chars, n = chars.astype(np.int64), len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        over = np.cumsum(sizes)
        first = over - sizes
        heads = self._longest(chars, first, over, 0)
        tails = self._longest(chars, np.arange(len(chars)), np.repeat(over, sizes), 1)
        own, (ids, ends), made, bad = np.arange(n), heads, [], np.zeros(n, bool)
        while len(own):
            bad[own[ids < 0]] = True
            own, ids, ends = own[ids >= 0], ids[ids >= 0], ends[ids >= 0]
            made.append((own, ids, ends - first[own]))
            more = ends < over[own]
            own, at = own[more], ends[more]
            ids, ends = tails[0][at], tails[1][at]
        odd = np.bincount(np.repeat(np.arange(n), sizes)[chars == SEVERAL], minlength=n) > 0
        word, ids, ends = (np.concatenate(x) for x in zip(*made))
        fine = ~bad[word]
        lost = np.flatnonzero(bad & ~odd)
        word, ids, ends = (np.concatenate([x[fine & ~odd[word]], y]) for x, y in ((word, lost), (ids, np.full(len(lost), self.unk)), (ends, sizes[lost])))
        order = np.argsort(word, kind="stable")
        store.add([w for w, x in zip(words, odd.tolist()) if not x], np.bincount(word, minlength=n)[~odd], ids[order], ends[order])
        return [words[k] for k in np.flatnonzero(odd)]

    def _entries(self, words: list[str]) -> np.ndarray:
        """Each word's entry in the store; those not met before are split."""
        store, get = self._store, self._store.entry.get
        found = list(map(get, words))
        if None in found:
            new = [w for w in dict.fromkeys(w for w, x in zip(words, found) if x is None) if len(w) <= self.most_chars]
            odd = self._split_all(new) if len(new) > FEW else new
            if odd:
                made = [self.split(w) or ([self.unk], [len(w)]) for w in odd]
                store.add(odd, [len(i) for i, _ in made], [x for i, _ in made for x in i], [x for _, e in made for x in e])
            found = map(get, words, repeat(0))
        return np.fromiter(found, np.int64, len(words))

    def encode_all(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends) of the texts one after the other, and where each text's begin, with the end of the last. Positions
        count code points of a text; special tokens have empty offsets; null counts as empty.

        A word is what stands between blanks without the characters that are dropped; each mark is a word.
        """
        if self._store is None or len(self._store.entry) > WORDS:
            self._store = _Store(self.unk)
        n, texts = len(texts), [t or "" for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, n) + 1
        begins = np.cumsum(sizes) - sizes
        chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self._kinds(chars)
        kept = np.flatnonzero(kinds <= MARK)
        mark, blanks = kinds[kept] == MARK, np.cumsum(kinds == BLANK)[kept]
        new = np.ones(len(kept), bool)
        new[1:] = mark[1:] | mark[:-1] | (blanks[1:] != blanks[:-1])
        first = np.flatnonzero(new)
        apart = np.full(len(kept) + len(first), 32, np.uint32)  # the words, a blank after each
        apart[np.arange(len(kept)) + np.cumsum(new) - 1] = chars[kept]
        entries = self._entries(apart.tobytes().decode("utf-32-le", "surrogatepass").split(" ")[:-1])

        at = np.frombuffer(self._store.at, np.int64)
        counts = at[entries + 1] - at[entries]
        word = np.repeat(np.arange(len(first)), counts)
        piece = np.arange(len(word)) + (at[entries] - np.cumsum(counts) + counts)[word]
        ids, a, b = (np.frombuffer(x, np.int32)[piece] for x in (self._store.ids, self._store.starts, self._store.ends))
        if len(long := np.flatnonzero(entries[word] == 0)):
            b[long] = np.diff(first, append=len(kept))[word[long]]
        row = np.searchsorted(begins, kept[first], "right") - 1
        begin = begins[row][word]
        starts, ends = kept[first[word] + a] - begin, kept[first[word] + b - 1] + 1 - begin
        made = np.bincount(row, counts, n).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(made + 2 * self.special)])
        if self.special:
            to = np.arange(len(word)) + 2 * row[word] + 1
            ids, starts, ends = (_spread(x, to, offsets[-1]) for x in (ids, starts, ends))
            ids[offsets[:-1]], ids[offsets[1:] - 1] = self.cls, self.sep
        return ids.astype(np.int32), starts.astype(np.int32), ends.astype(np.int32), offsets

    def encode(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """(ids, starts, ends) of one text."""
        ids, starts, ends, _ = self.encode_all([text])
        return ids.tolist(), starts.tolist(), ends.tolist()


def _spread(x: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, x.dtype)
    out[to] = x
    return out


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """[a, b) for runs of whole texts with about BYTES bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + BYTES, "right")))
        yield at, end
        at = end


def encoded(batches: Iterator[pa.RecordBatch], at: int, tokenizer: WordPiece) -> Iterator[pa.RecordBatch]:
    """Runs of the batches' rows with the columns of SCHEMA added, by the text in column `at`."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for a, b in _runs(batch.column(at)):
            part = batch.slice(a, b - a)
            ids, starts, ends, offsets = tokenizer.encode_all(part.column(at).to_pylist())
            made = (ids, np.ones_like(ids), np.zeros_like(ids), starts, ends)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(m)) for m in made]
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, *names])


def encode(df: DataFrame, column: str, tokenizer: WordPiece, most: int = 500_000) -> DataFrame:
    """df with the five columns of SCHEMA added. A column of df with one of their names is an error. Bounds the session's Arrow batches to ROWS rows."""
    if len(tokenizer.vocab) > most:
        raise ValueError(f"a vocabulary of {len(tokenizer.vocab)} entries is more than {most}")
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are in the table")
    at = df.columns.index(column)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS:
        conf.set(key, str(ROWS))
    run = partial(encoded, at=at, tokenizer=tokenizer)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{own}, {SCHEMA}")


def plain_vocabulary() -> dict[str, int]:
    """A small vocabulary by rule: four special tokens, every Latin letter, digit and mark alone and as a continuation, and common endings."""
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180))]
    endings = "the and ing ed er en es ion ent ent al ly de le la que der die und".split()
    return {w: i for i, w in enumerate(dict.fromkeys(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *("##" + x for x in letters), *endings, *("##" + x for x in endings)]))}
