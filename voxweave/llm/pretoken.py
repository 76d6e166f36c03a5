"""Splits texts as byte-level BPE does before its merges, on whole Arrow buffers.

The pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`. Its tokens
are runs of one class of characters, so their ends follow from class changes and few corrections, all by
array operations. Distinct tokens are then found by Arrow's dictionary encoding and encoded once.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers.pre_tokenizers import ByteLevel

from voxweave.llm.arrow import runs

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Unicode White_Space (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPECIAL = b"<|endoftext|>"
#: Bytes of text whose tokens are looked up together, and bytes whose boundaries are found together (many arrays a byte).
PIECE, STEP = 4_000_000, 500_000
#: Longer tokens are not stored; so many are encoded at a time.
LONGEST, AT_ONCE = 64, 10_000


@cache
def classes() -> np.ndarray:
    """The class of each code point; letters and digits that are newer than Python's tables are as the library has them."""
    out = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    split = ByteLevel(add_prefix_space=False)
    for c in (ord(c) for c in regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"))):
        for kind, lead in ((LETTER, "a"), (NUMBER, "1")):
            if len(split.pre_tokenize_str(lead + chr(c))) == 1:
                out[c] = kind
    out[WHITE] = SPACE
    return out


def _decode(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points that begin at positions `at` of valid UTF-8."""
    b = np.concatenate([data, np.zeros(3, np.uint8)])
    c = b[at].astype(np.uint32)
    wide = np.flatnonzero(c >= 0x80)
    lead, p = c[wide], at[wide]
    low = [(b[p + i] & 0x3F).astype(np.uint32) for i in (1, 2, 3)]
    c[wide] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | low[0], np.where(lead < 0xF0, (lead & 0x0F) << 12 | low[0] << 6 | low[1], (lead & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2]))
    return c


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where a token begins, over all texts of a piece."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = _decode(data, at)
    kind = classes()[point]
    edges = offsets[:-1]
    if (whole := data.tobytes()).find(SPECIAL) >= 0:
        found, x = [], -1
        while (x := whole.find(SPECIAL, x + 1)) >= 0:
            i = int(np.searchsorted(offsets, x, "right"))
            if x + len(SPECIAL) <= offsets[i]:
                found += [x, x + len(SPECIAL)]
        edges = np.concatenate([edges, np.array(found, np.int64)])
        span = [np.arange(*np.searchsorted(at, found[i : i + 2])) for i in range(0, len(found), 2)]
        if span:
            kind[np.concatenate(span)] = OTHER  # one token
            point[np.concatenate(span)] = 0
    n = len(at)
    cut = np.zeros(n + 1, bool)  # where the pattern cannot look further
    cut[np.searchsorted(at, edges)] = True
    cut[n] = True
    begin = cut[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begin)
    ends = np.append(runs[1:], n)
    own = (kind[runs] == SPACE) & ~cut[ends]  # white space with something after it
    last, nxt = ends[own] - 1, ends[own]
    begin[last] = True  # a single white space, or the last of a run, stands apart
    begin[nxt[point[last] == 0x20]] = False  # and a blank belongs to what follows
    quote = np.flatnonzero((point == 0x27) & begin)
    pad = np.concatenate([point, np.zeros(3, np.uint32)])
    stop = np.concatenate([cut, np.ones(3, bool)])
    one, two = pad[quote + 1], pad[quote + 2]
    free = ~stop[quote + 1]
    short = free & np.isin(one, [ord(c) for c in "stmd"])
    long = free & ~stop[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for q, size in ((quote[short], 2), (quote[long], 3)):
        begin[q + 1] = False
        after = q + size
        after = after[after < n]
        begin[after[kind[after] == LETTER]] = True
    return at[begin]


class Words:
    """Ids of whole pieces through a store of distinct tokens. When a half is full, the half that was filled before it goes; what is still met there moves on."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int = 800_000):
        self.encode, self.most, self.store, self.old = encode, most, {}, {}

    def lookup(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(ids of each distinct token as little-endian uint32, tokens as numbers of these, first token of each text)."""
        found = [boundaries(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) + offsets[a] for a, b in runs(offsets, STEP)]
        starts = np.concatenate(found) if found else np.zeros(0, np.int64)
        edge = np.append(starts, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        _, edges, raw = words.dictionary.buffers()
        raw = raw.to_pybytes() if raw is not None else b""
        edges = np.frombuffer(edges, np.int64)[: len(words.dictionary) + 1].tolist() if len(words.dictionary) else [0]
        kinds = [raw[a:b] for a, b in zip(edges, edges[1:])]
        out = list(map(self.store.get, kinds))
        missing, old = [], self.old
        for i in [i for i, x in enumerate(out) if x is None]:
            if (x := old.get(kinds[i])) is None:
                missing.append(i)
            else:
                out[i] = self.store[kinds[i]] = x
        if len(self.store) + len(missing) > self.most // 2:
            self.old, self.store = self.store, {}
        for at in range(0, len(missing), AT_ONCE):
            part = missing[at : at + AT_ONCE]
            new = [kinds[i] for i in part]
            for i, w, x in zip(part, new, self.encode(new), strict=True):
                out[i] = x
                if len(w) <= LONGEST:
                    self.store[w] = x
        return out, words.indices.to_numpy(), np.searchsorted(starts, offsets)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids)."""
        kinds, code, first = self.lookup(data, offsets)
        flat = np.frombuffer(b"".join(kinds), np.uint32)
        size = np.fromiter(map(len, kinds), np.int64, len(kinds)) // 4
        begin = np.cumsum(size) - size
        n = size[code] if len(code) else np.zeros(0, np.int64)
        end = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(begin[code] - end[:-1], n) + np.arange(end[-1])] if len(code) else np.zeros(0, np.uint32)
        return out, end[first]


_OPEN: dict[str, Words] = {}


#: A blank and letters up to U+023F: such tokens, put together, are split into just these again.
PLAIN = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+")


def library(path: str) -> Words:
    """Tokens encoded by the tokenizers library; one store a worker.

    A call for each token costs several times its merges, so plain tokens go to the library as one text, and the
    ids are dealt to the tokens by the bytes that they stand for.
    """
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads only add CPU time
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        words = own.get_vocab()
        size = np.zeros(max(words.values()) + 1, np.int64)
        for word, i in words.items():
            size[i] = len(word)  # a letter a byte

        def each(words: list[bytes]) -> list[bytes]:
            got = own.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in got]

        def encode(words: list[bytes]) -> list[bytes]:
            plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)]
            text = b"".join([words[i] for i in plain])
            ids = np.array(own.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
            end = np.cumsum(np.fromiter((len(words[i]) for i in plain), np.int64, len(plain)))
            upto = np.cumsum(size[ids])
            at = np.searchsorted(upto, end)
            if len(plain) and not (at[-1] < len(ids) and (upto[at] == end).all()):
                return each(words)  # some id crosses two tokens: not so with this pattern
            raw, cut = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
            out = dict(zip(plain, (raw[a:b] for a, b in zip(cut, cut[1:]))))
            rest = [i for i in range(len(words)) if i not in out]
            out.update(zip(rest, each([words[i] for i in rest])))
            return [out[i] for i in range(len(words))]

        _OPEN[path] = Words(encode)
    return _OPEN[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
