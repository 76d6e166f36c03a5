"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Texts are scanned as UTF-8 bytes (all patterns are ASCII) and offsets are given in code points. A
candidate is a run of key characters with letters and digits or with letters of both cases; a window slides over it, and its entropy
is kept by incremental counts against the threshold of the run's character class.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from voxweave.llm.arrow import pieces, small_batches

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: A run has characters of two of these.
KINDS_OF_CHARACTER = tuple(map(re.compile, (rb"[0-9]", rb"[a-z]", rb"[A-Z]")))
#: Window, and the least entropy in bits of a window for each class of characters that a run is made of.
WINDOW = 20
CLASSES = ((re.compile(rb"[0-9a-f]+|[0-9A-F]+"), 3.0), (re.compile(rb"[A-Z0-9]+|[a-z0-9]+"), 3.5), (re.compile(rb"[A-Za-z0-9+/_=-]+"), 3.8))
#: Runs that look random and are no secrets: UUIDs, dates, paths and slugs of words, words put together, placeholders.
ALLOWED = (
    re.compile(rb"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"),
    re.compile(rb"\d{4}-\d\d-\d\d\S*"),
    re.compile(rb"/?([a-z]+|[A-Z]+|[A-Z][a-z]+|\d{1,4})([-_/=+]+([a-z]+|[A-Z]+|[A-Z][a-z]+|\d{1,4}))*[-_/=+]*"),
    re.compile(rb"(?:[A-Z]?[a-z]{3,}+|[A-Z]{2,4}(?![a-z]))++"),
    re.compile(rb"(?i).*(example|placeholder|changeme|your[-_]?key|x{6}).*"),
)
TERM = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def entropy_peak(run: bytes, window: int = WINDOW) -> float:
    """The highest entropy, in bits a character, of the windows of run; counts change by one character a step."""
    count, total, low = [0] * 256, 0.0, math.inf
    for i, c in enumerate(run):
        if i >= window:
            out = run[i - window]
            total += TERM[count[out] - 1] - TERM[count[out]]
            count[out] -= 1
        total += TERM[count[c] + 1] - TERM[count[c]]
        count[c] += 1
        if i >= window - 1:
            low = min(low, total)
    return math.log2(window) - low / window if low < math.inf else 0.0


def is_random(run: bytes) -> bool:
    if sum(p.search(run) is not None for p in KINDS_OF_CHARACTER) < 2 or any(p.fullmatch(run) for p in ALLOWED):
        return False
    return entropy_peak(run) >= next(least for kind, least in CLASSES if kind.fullmatch(run))


def find(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in bytes, by start and then kind. Entropy spans overlap no other span."""
    found = []
    if b"=" in text or b":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    more, at, upto = [], 0, 0
    for m in RUN.finditer(text):  # in order, so one pass over the spans found is enough
        s, e = m.span()
        while at < len(found) and found[at][0] < e:
            upto = max(upto, found[at][2])
            at += 1
        if upto <= s and is_random(m[0]):
            more.append((s, 3, e))
    return sorted(found + more)


def in_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in bytes as spans in code points; the text is counted once."""
    if text.isascii():
        return found
    points, last, n = {}, 0, 0
    for at in sorted({x for s, _, e in found for x in (s, e)}):
        n += len(text[last:at].decode())
        points[at], last = n, at
    return [(points[s], k, points[e]) for s, k, e in found]


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    spans is `kind:start:end` (code points, end exclusive) by start and then kind, comma-joined; base_sha256
    is of the same without the entropy spans. Null text is empty; a text without spans has the hash of "".
    Repeated rows give repeated results. Very long texts are read whole, in time that grows with their length. An
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                whole = data.tobytes()
                counts, shas, spans = [[], [], [], []], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = whole[a:b]
                    if found := find(text):
                        said = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in in_points(text, found)]
                    else:
                        said = []
                    for k, c in enumerate(counts):
                        c.append(sum(x[0] == k for x in said))
                    shas.append(hashlib.sha256(",".join(x for k, x in said if k < 3).encode()).hexdigest())
                    spans.append(",".join(x for _, x in said))
                yield pa.record_batch([rows.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with every span that scan() finds (overlapping ones as one) replaced by mark; n_chars, if there, is counted again.

    Null texts stay null. Other columns are as they were.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                whole, at = data.tobytes(), names.index("text")
                was, texts = rows.column(at), []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    text, out, done = whole[a:b], [], 0
                    for s, _, e in find(text):
                        if s >= done:
                            out += [text[done:s], mark.encode()]
                        done = max(done, e)
                    texts.append(b"".join([*out, text[done:]]).decode() if was[i].is_valid else None)
                cols = list(rows.columns)
                cols[at] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    n = names.index("n_chars")
                    cols[n] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(rows.column(n).type)
                yield pa.record_batch(cols, names)

    return small_batches(docs).mapInArrow(run, docs.schema)
