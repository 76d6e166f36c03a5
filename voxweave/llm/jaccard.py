"""Similarity join of shingle sets by parity sketches.

A set is spread over the parts of a sketch by a hash; a part holds the exclusive-or of its shingles'
hashes, so one shingle more or less changes one part, and the parts that differ are at most as many as
the symmetric difference. Sets that link are of similar size, so they share a size band, and in a band
with P parts a set of size a can link only to sets that differ in at most d(a) parts.

Candidates. Order the parts' contents by how many sets hold them (then by the content). If x and y
link, x has an equal part among its first d(x) + 1, and so has y; the one of these two parts that comes
later for its own set is among the first parts of both. So each set keeps its d + 1 rarest parts, and
parts of one set alone need not be kept at all: most sets have more than d of them and link with nothing. This
is exact, and passages that many documents share make no candidates.

Copies. A set is named by 64 bits of its text's words, so equal texts and repeated rows are one set
from the start: a task sends a set once, and what several tasks send is made one before anything is joined.

Verification. Buckets are compared in blocks of bounded size by the Hamming distance of parity sketches,
which bounds the symmetric difference from below; a sketch has three bits and more for each shingle that may differ
in its size band, up to 4096, so it stays sharp for texts of some 10,000 words (of longer ones it lets more pairs
through to be verified, and loses none). First all sets of a bucket meet one of its blocks, and a
spanning forest of what passes is verified on the sets themselves. Then sets outside their bucket's
largest component meet all others of the bucket, so no link between components is lost, while a
group of near copies costs in proportion to its size and is not expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxweave.llm.arrow import pieces, small_batches, sums
from voxweave.llm.common import components, cut, release, spread_join

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
ODD = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK, RATIO = 1024, 1.5
#: Bits of a sketch: the least, the most, and for each shingle that may differ.
SKETCH, WIDEST, SHARP = 1024, 4096, 3


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingle hashes of each text, sorted by text and hash; their offsets; 128 bits of each word sequence."""
    data = LOWER[data]
    inside = WORD[data]
    lead = inside.copy()
    lead[1:] &= ~inside[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    lead[starts] = inside[starts]  # a word does not run on into the next text
    first = np.concatenate([[0], np.cumsum(sums(lead, offsets))])
    packed = data[inside]
    at = np.concatenate([(np.cumsum(inside) - inside)[lead], [len(packed)]]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    w = hashes[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    order = [xxhash.xxh3_128_digest(w[a:b].tobytes()) for a, b in zip(first[:-1], first[1:])]
    n = np.diff(first)
    full = max(0, len(w) - k + 1)
    h = np.full(full, ODD[63], np.uint64)
    for i in range(k):
        h += w[i : i + full] * ODD[i]
    doc = np.repeat(np.arange(len(n)), n)
    own = doc[:full] == doc[k - 1 : k - 1 + full] if full else np.zeros(0, bool)
    h, doc_h = mix(h[own]), doc[:full][own]
    few = np.flatnonzero((n > 0) & (n < k))
    rest = np.array([np.sum(w[first[i] : first[i + 1]] * ODD[: n[i]], dtype=np.uint64) ^ ODD[32 + n[i]] for i in few], np.uint64)
    h, doc_h = np.concatenate([h, mix(rest)]), np.concatenate([doc_h, few])
    by = np.lexsort((h, doc_h))
    h, doc_h = h[by], doc_h[by]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc_h[1:] != doc_h[:-1])])
        h, doc_h = h[new], doc_h[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc_h, minlength=len(n)))]).astype(np.int64), order


class Bands:
    """Overlapping size bands: sets that link at num / den or more share one."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 34:
            low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
        self.low = np.array(low[:-1], np.int64)
        self.high = (np.array(low[1:], np.int64) - 1) * den // num + 1
        self.parts = self.differ(self.high - 1) * 11 // 10 + 8

    def differ(self, a):
        """The largest symmetric difference of a set of size a and one that it links to."""
        return (a + a * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def differ_sql(self, a: str) -> str:
        return f"(({a} + ({a} * {self.den}) div {self.num}) * {self.den - self.num}) div {self.den + self.num}"

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last band of each size (1 or more)."""
        return np.searchsorted(self.high, n, "right"), np.searchsorted(self.low, n, "right") - 1


def part_keys(h: np.ndarray, at: np.ndarray, bands: Bands) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(band, texts, parts of each that hold shingles, their keys) for the bands that the sets of a piece fall into."""
    n = np.diff(at)
    lo, hi = bands.of(np.maximum(n, 1))
    if not (n > 0).any():
        return
    for g in range(int(lo[n > 0].min()), int(hi[n > 0].max()) + 1):
        own = np.flatnonzero((n > 0) & (lo <= g) & (hi >= g))
        if not len(own):
            continue
        pick = np.concatenate([np.arange(at[i], at[i + 1]) for i in own])
        doc = np.repeat(np.arange(len(own)), n[own])
        x = h[pick]
        part = ((x >> np.uint64(32)) * np.uint64(bands.parts[g])) >> np.uint64(32)  # in order, as the hashes are
        new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]))
        fold = np.bitwise_xor.reduceat(mix(x ^ ODD[62]), new)
        key = mix(fold ^ mix(part[new] * np.uint64(64) + np.uint64(g)))
        yield g, own, np.bincount(doc[new], minlength=len(own)), key


def sketch(h: np.ndarray, bits: int) -> bytes:
    """A bit for each hash value's parity: the Hamming distance of two sketches is at most the symmetric difference."""
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def folded(raw: bytes, size: int) -> bytes:
    """The sketch with `size` bytes: its halves are laid over each other, which keeps the parities."""
    x = np.frombuffer(raw, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def near_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A set holds the distinct k-word shingles of the lower-cased (A-Z) text; with fewer words, the whole
    sequence as one; null, empty and blank texts have none and link with nothing. Sets link when
    den * intersection >= num * union. component_id is the smallest doc_id that links reach. Rows that
    repeat a doc_id count as one document, which links where any of its texts does; a null doc_id has n_shingles and
    links with nothing. Very long texts are read whole. An empty table gives no rows; other columns are not read.
    Shingles and word sequences are compared by 64-bit hashes.
    """
    docs, bands = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), Bands(num, den)
    made = cut(docs.mapInArrow(_parts(k, bands), "doc_id long, n long, sid long, first int, filled array<int>, band int, key long"), "parts")
    heads = cut(made.where("key is null").select("doc_id", "n", "sid", "first", "filled"), "heads")
    given = heads.where("n > 0 and doc_id is not null")
    sizes = cut(given.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), *(F.first(x).alias(x) for x in ("n", "first", "filled"))), "sizes")

    keys = made.where("key is not null").select("key", "sid", "band")
    rows = cut(_held_by_two(keys), "shared")
    release(made)
    size = sizes.select("sid", "n", "first", "filled", F.expr(bands.differ_sql("n")).alias("d"))
    rows = rows.join(size, "sid").withColumn("full", F.expr("filled[band - first]"))
    own = Window.partitionBy("sid", "band")
    rows = rows.withColumn("keep", F.expr("d + 1 - full") + F.count("*").over(own)).where("keep > 0")
    rows = rows.withColumn("nth", F.row_number().over(own.orderBy("c", "key"))).where("nth <= keep").select("key", "sid")
    poor = size.select("sid", "d", F.posexplode("filled").alias("i", "full"), "first").where("full <= d")
    rows = cut(_held_by_two(rows.union(poor.select(F.expr("cast(-1 - first - i as long)").alias("key"), "sid"))).select("key", "sid"), "buckets")

    want = rows.select("sid").distinct().join(sizes.select("sid", "rep"), "sid").select(F.col("rep").alias("id")).distinct()
    near = docs.join(want.hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left_semi")
    sets = near.mapInArrow(_sets(k, bands), "sid long, n long, sketch binary, shingles array<long>")
    sets = cut(sets.groupBy("sid").agg(*(F.first(x).alias(x) for x in ("n", "sketch", "shingles"))), "sets")
    tried = cut(_compare(rows, sets, bands, None).distinct(), "tried")
    first = cut(_verify(tried, sets, bands), "links")
    known = cut(components(first, "a", "b"), "known")
    more = _compare(rows, sets, bands, known).distinct().join(tried, ["a", "b"], "left_anti")
    links = cut(first.union(_verify(more, sets, bands)), "links")
    release(rows, sets, tried, first, known)
    # The texts of one doc_id belong together.
    least = given.groupBy("doc_id").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high")
    several = given.join(least, "doc_id").select(F.col("sid").alias("a"), F.col("low").alias("b")).where("a <> b")
    joined = cut(components(links.union(several), "a", "b"), "joined")

    named = sizes.select("sid", "rep", "rows").join(joined, F.col("sid") == F.col("node"), "left").withColumn("part", F.coalesce("component", "sid"))
    low = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = cut(named.join(low, "part").select("sid", "rows", "component_id"), "named")
    out = spread_join(given.select("doc_id", "n", "sid"), named, "sid", "rows").select("doc_id", "n", "component_id")
    rest = heads.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.union(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _held_by_two(rows: DataFrame) -> DataFrame:
    """The distinct rows whose key two sets or more hold, with their number c. Rows that tasks sent twice meet in the key's partition."""
    each = rows.repartition("key").distinct()  # grouped by what includes the key: no second shuffle
    return each.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1")


def _parts(k: int, bands: Bands):
    names = ["doc_id", "n", "sid", "first", "filled", "band", "key"]
    most = 200_000  # sets that a task remembers; what it forgets it may send again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                h, at, order = shingle_sets(data, offsets, k)
                n, ids = np.diff(at), rows.column(0)
                sid = np.array([int.from_bytes(x[:8], "little", signed=True) for x in order], np.int64)
                filled = [{} for _ in range(len(n))]
                new = np.asarray(ids.is_valid()).copy()
                for i in np.flatnonzero(new).tolist():
                    if sid[i] in sent:
                        new[i] = False
                    else:
                        sent.add(int(sid[i]))
                if len(sent) > most:
                    sent.clear()
                for g, own, full, key in part_keys(h, at, bands):
                    for i, f in zip(own.tolist(), full.tolist(), strict=True):
                        filled[i][g] = f
                    doc = np.repeat(own, full)
                    keep = new[doc]
                    doc, key = doc[keep], key[keep]
                    nothing = [pa.nulls(len(doc), t) for t in (pa.int32(), pa.list_(pa.int32()))]
                    yield pa.record_batch([pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int64()), pa.array(sid[doc]), *nothing, pa.array(np.full(len(doc), g, np.int32)), pa.array(key.view(np.int64))], names)
                first = pa.array([min(x, default=0) for x in filled], pa.int32())
                lists = pa.array([[x[g] for g in sorted(x)] for x in filled], pa.list_(pa.int32()))
                yield pa.record_batch([ids, pa.array(n), pa.array(sid), first, lists, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())], names)

    return run


def _sets(k: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in pieces(batch, "text"):
                h, at, order = shingle_sets(data, offsets, k)
                n = np.diff(at)
                bits = np.clip(SHARP * bands.differ(n), SKETCH, WIDEST)
                marks = [sketch(h[a:b], 1 << int(x - 1).bit_length()) for a, b, x in zip(at[:-1], at[1:], bits.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))
                sid = pa.array([int.from_bytes(x[:8], "little", signed=True) for x in order], pa.int64())
                yield pa.record_batch([sid, pa.array(n), pa.array(marks, pa.binary()), lists], ["sid", "n", "sketch", "shingles"])

    return run


def _compare(rows: DataFrame, sets: DataFrame, bands: Bands, known: DataFrame | None) -> DataFrame:
    """Pairs a < b whose sketches are near enough: a forest of each block, or, given components, all between two of these.

    The first time, sets meet the first block of their bucket only. The second time, those outside the bucket's
    largest component come in the first blocks and meet all; those inside meet these.
    """
    marks = rows.join(sets.select("sid", "n", "sketch"), "sid")
    if known is None:
        marks = marks.withColumn("comp", F.col("sid"))
        per = marks.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
        marks = marks.join(per, "key").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        marks = marks.withColumn("other", F.explode(F.expr("if(block = 0, sequence(0, blocks - 1), array(0))")))
    else:
        marks = marks.join(known.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
        counts = marks.groupBy("key", "comp").agg(F.count("*").alias("c"))
        top = F.max(F.struct("c", F.col("comp").alias("main")))
        per = counts.groupBy("key").agg(F.sum("c").alias("sets"), top.alias("top")).where("sets > top.c")
        blocks = {"cores": F.expr("cast(ceil((sets - top.c) / double(%d)) as int)" % BLOCK), "guests": F.expr("cast(ceil(top.c / double(%d)) as int)" % BLOCK)}
        marks = marks.join(per.withColumns(blocks).select("key", "top.main", "cores", "guests"), "key")
        marks = marks.withColumn("block", F.expr("cast(if(comp = main, cores + pmod(xxhash64(sid), guests), pmod(xxhash64(sid), cores)) as int)"))
        marks = marks.withColumn("other", F.explode(F.expr("sequence(0, if(comp = main, cores, cores + guests) - 1)")))
    marks = marks.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "sid", "n", "comp", "sketch")
    by = ["key", "left", "right"]
    return marks.repartition(*by).sortWithinPartitions(*by, "sid").mapInArrow(_near(bands, known is None), "a long, b long")


def _near(bands: Bands, forest: bool):
    num, den = bands.num, bands.den

    def group(block: np.ndarray, across: bool, ids: np.ndarray, n: np.ndarray, comp: np.ndarray, marks: list[bytes]) -> tuple[list, list]:
        size = min(map(len, marks))
        bits = np.frombuffer(b"".join(folded(x, size) for x in marks), np.uint64).reshape(len(marks), -1)
        q, near = len(ids), []
        step = max(1, (1 << 21) // (q * bits.shape[1]))  # the words of a step take 16 MB
        for s in range(0, q, step):
            e = min(q, s + step)
            apart = np.bitwise_count(bits[s:e, None, :] ^ bits[None, :, :]).sum(2, dtype=np.int32)
            a, b = n[s:e, None], n[None, :]
            ok = (apart * (den + num) <= (a + b) * (den - num)) & (np.minimum(a, b) * den >= num * np.maximum(a, b)) & (comp[s:e, None] != comp[None, :])
            if across:
                ok &= block[s:e, None] != block[None, :]
            near.append(ok)
        ok = np.concatenate(near)
        if not forest:
            i, j = np.nonzero(np.triu(ok, 1))
            return ids[i].tolist(), ids[j].tolist()
        left, a, b = np.ones(q, bool), [], []
        for root in range(q):
            if not left[root]:
                continue
            left[root], queue = False, [root]
            while queue:
                x = queue.pop(0)
                found = np.flatnonzero(ok[x] & left)
                left[found] = False
                queue += found.tolist()
                a += [ids[x]] * len(found)
                b += ids[found].tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [table.column(x).to_numpy() for x in ("key", "left", "right", "block", "sid", "n", "comp")]
            marks = table.column("sketch").to_pylist()
            key, lo, hi, block, ids, n, comp = cols
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True]]))
            out_a, out_b = [], []
            for s, e in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
                if e - s > 1:
                    a, b = group(block[s:e], lo[s] != hi[s], ids[s:e], n[s:e], comp[s:e], marks[s:e])
                    out_a += a
                    out_b += b
            a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key = [batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("key", "left", "right")]
            same = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
            last = int(np.argmax(same))  # the last group may go on in the next batch
            if last:
                done, held = [*held[:-1], batch.slice(0, last)], [batch.slice(last)]
                yield from work(pa.Table.from_batches(done))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs whose sets link."""
    own = sets.select("sid", "shingles")
    both = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.where(same * (bands.den + bands.num) >= (F.size("sa") + F.size("sb")) * bands.num).select("a", "b").distinct()
