"""Near-duplicate vectors by a pivot-permutation index.

Pivots are vectors of a bounded sample, none within the cosine CORE of another, so a group of near copies
gets one or two however large it is. Each vector is described by its nearest pivots in order and
entered into the inverted list of each; vectors of a list that share enough pivots are compared by cosine
in double precision. A pair is compared in the list of its first shared pivot only, so links are counted
once. A vector within CORE of a crowded pivot has an exact way instead: it is compared with all that the
triangle inequality of angles lets link with it, which are those of the pivot's ball.
Lists are compared in blocks of bounded size, and only counts and spanning forests leave a block,
so groups of near copies are not expanded into pairs. Equal vectors are one entry with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.llm.common import components, cut

BLOCK = 1024
#: Vectors this near to a crowded pivot are its core; a pivot is crowded with so many vectors of the sample in its core.
CORE, CROWD = 0.8, 4
#: The home of vectors in no core.
NONE = 2**31 - 1


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None for what links with nothing."""
    out: list[np.ndarray | None] = []
    for i in range(len(column)):
        x = column[i].values
        if x is None or not len(x) or x.null_count:
            out.append(None)
            continue
        v = x.to_numpy().astype(np.float64)
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(-1, keepdims=True)  # no overflow or underflow in the norm
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


def choose_pivots(vectors: DataFrame, most: int, per: int = 50) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Pivots by dimension, and which are crowded: at most `most`, from a sample of 4 * most rows (the first by hash), one for `per` rows."""
    count = vectors.count()
    n = min(most, max(64, count // per))
    sample = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * n).select("embedding").toArrow()
    found: dict[int, dict] = {}
    for v in _rows(sample.column(0).combine_chunks()) if len(sample) else []:
        if v is not None:
            found.setdefault(len(v), {})[v.tobytes()] = v
    out = {}
    for d, x in found.items():
        own = unit(np.stack(list(x.values())))
        near, taken = np.full(len(own), -1.0), []
        for i in range(len(own)):
            if near[i] < CORE and len(taken) < n:
                taken.append(i)
                near = np.maximum(near, own @ own[i])
        near = own @ own[taken].T
        home = near.argmax(1)[near.max(1) >= CORE]
        out[d] = own[taken], np.bincount(home, minlength=len(taken)) >= CROWD
    return out


def near_vectors(vectors: DataFrame, least: float = 0.93, nearest: int = 10, shared: int = 2, most_pivots: int = 1024) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of one label (not null) and dimension link when their cosine is `least` or more. Null and zero
    vectors and those with null or non-finite components link with nothing. n_links counts the other rows
    linked directly, repeated rows and equal vectors included; component_id is the smallest vec_id that
    links reach; kept: vec_id = component_id. A null vec_id counts as a link but names no component. An empty table
    gives no rows; other columns are not read.
    """
    reach = np.cos(np.arccos(CORE) + np.arccos(least)) - 1e-9  # what links with a core is not farther from its pivot
    given = vectors.select("vec_id", "label", "embedding")
    pivots = choose_pivots(given, most_pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                rows = _rows(part.column(2))
                ok = [v is not None and part.column(1)[i].is_valid for i, v in enumerate(rows)]
                perm: list = [None] * len(rows)
                balls: list = [[]] * len(rows)
                home = [NONE] * len(rows)
                for d in {len(v) for v, x in zip(rows, ok) if x}:
                    own = [i for i, v in enumerate(rows) if ok[i] and len(v) == d]
                    if d not in pivots:  # a dimension that the sample lacks: one list for all
                        for i in own:
                            perm[i] = [0]
                        continue
                    at, crowded = pivots[d]
                    near = unit(np.stack([rows[i] for i in own])) @ at.T
                    first = near.argmax(1)
                    core = (near.max(1) >= CORE) & crowded[first]
                    k = min(nearest, near.shape[1])
                    top = np.argpartition(-near, k - 1, 1)[:, :k]
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), 1, kind="stable"), 1)
                    for j, i in enumerate(own):
                        perm[i] = top[j].tolist()
                        balls[i] = np.flatnonzero((near[j] >= reach) & crowded).tolist()
                        if core[j]:
                            home[i] = int(first[j])
                vec = [v.tobytes() if x else None for v, x in zip(rows, ok)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(vec, pa.binary()), pa.array(perm, pa.list_(pa.int32())), pa.array(balls, pa.list_(pa.int32())), pa.array(home, pa.int32())], ["vec_id", "label", "vec", "perm", "balls", "home"])

    made = cut(given.mapInArrow(describe, f"vec_id long, label {given.schema['label'].dataType.simpleString()}, vec binary, perm array<int>, balls array<int>, home int"), "vectors")
    entries = made.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("perm", "balls", "home")))
    entries = cut(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    outside = F.expr(f"if(home = {NONE}, transform(perm, p -> struct(p as pivot, false as ball, true as core)), array())")
    inside = F.expr("transform(balls, p -> struct(p as pivot, true as ball, p = home as core))")
    lists = entries.withColumn("at", F.explode(F.concat(outside, inside)))
    lists = lists.select(F.struct("label", F.length("vec").alias("dim"), "at.pivot", "at.ball").alias("list"), "at.core", "entry", "times", "perm", "home", "vec")
    size = lists.groupBy("list").agg(F.count_if("core").alias("c"), F.count_if(~F.col("core")).alias("g")).where("c > 0 and c + g > 1")
    # Blocks of the core come first; those of the others meet these only.
    blocks = {"cores": F.ceil(F.col("c") / BLOCK).cast("int"), "guests": F.ceil(F.col("g") / BLOCK).cast("int")}
    lists = lists.join(size, "list").withColumns(blocks).withColumn("block", F.expr("cast(if(core, pmod(xxhash64(entry), cores), cores + pmod(xxhash64(entry), guests)) as int)"))
    lists = lists.withColumn("other", F.explode(F.expr("sequence(0, if(core, cores + guests, cores) - 1)")))
    lists = lists.select(F.xxhash64("list").alias("h"), F.col("list.pivot").alias("pivot"), F.col("list.ball").alias("ball"), F.col("list.dim").alias("dim"), F.col("list.label").cast("string").alias("label"), F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "entry", "times", "perm", "home", "vec")
    by = ["h", "pivot", "ball", "dim", "label", "left", "right"]
    found = cut(lists.repartition(*by).sortWithinPartitions(*by, "entry").mapInArrow(_blocks(least, shared, by), "a long, b long, n long"), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null"), "a", "b")
    named = entries.join(joined, entries.entry == joined.node, "left").withColumn("part", F.coalesce("component", "entry"))
    low = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    done = named.select("entry", "label", "vec", "times", "part").join(links, "entry", "left").join(low, "part")
    done = done.select("label", "vec", "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = made.join(done, ["label", "vec"], "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _blocks(least: float, shared: int, by: list[str]):
    """a, null, n: entry a has n links here; a, b, null: an edge of the spanning forest of the links here."""

    def group(t: pa.Table) -> tuple[list, list, list]:
        ids, times, block = (t.column(c).to_numpy() for c in ("entry", "times", "block"))
        across, pivot = t.column("left")[0].as_py() != t.column("right")[0].as_py(), t.column("pivot")[0].as_py()
        v = unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(len(t), -1))
        ok = v @ v.T >= least
        if t.column("ball")[0].as_py():
            home = t.column("home").to_numpy()
            ok &= np.minimum(home[:, None], home[None, :]) == pivot
        else:
            perm = np.array(t.column("perm").to_pylist())
            kinds, code = np.unique(perm, return_inverse=True)
            has = np.zeros((len(t), len(kinds)), np.float32)
            has[np.arange(len(t))[:, None], code.reshape(perm.shape)] = 1
            low = has[:, kinds < pivot]
            ok &= (has @ has.T >= min(shared, perm.shape[1])) & (low @ low.T == 0)
        np.fill_diagonal(ok, False)
        if across:
            ok &= block[:, None] != block[None, :]
        n = ok @ times
        some = np.flatnonzero(n)
        a, b, c = ids[some].tolist(), [None] * len(some), n[some].tolist()
        left = np.zeros(len(t), bool)
        left[some] = True
        for root in some.tolist():
            if not left[root]:
                continue
            left[root], queue = False, [root]
            while queue:
                x = queue.pop()
                new = np.flatnonzero(ok[x] & left)
                left[new] = False
                queue += new.tolist()
                a += [ids[x]] * len(new)
                b += ids[new].tolist()
                c += [None] * len(new)
        return a, b, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            if len(t) > 1:
                a, b, c = group(t)
                if a:
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["a", "b", "n"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by)))
            s = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != last:
                    if i > s:
                        held.append(batch.slice(s, i - s))
                    if i < len(keys):
                        if held:
                            yield from work()
                        held, last, s = [], keys[i], i
        if held:
            yield from work()

    return run
