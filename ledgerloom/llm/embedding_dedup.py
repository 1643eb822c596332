"""Near-duplicate embeddings by collision-counting projections.

Every vector is projected on many random lines. Two unit vectors at distance d differ on a Gaussian line by a normal
variate of deviation d, so two near vectors fall into each other's window (query-centred, two deviations to each side)
on almost every line, far ones only now and then. Pairs that collide on the calibrated number of lines or more are
candidates and are verified by their cosine.

The projections are sorted into cells: each of `tables` tables orders the vectors of a label by the cells of `depth`
lines, five windows wide and shifted at random, and pairs are counted that share a cell of some table. The depth grows
with the logarithm of the largest label, so that the number of pairs that meet by chance stays in proportion to the
rows; the number of tables follows from the recall that is asked for, and grows with a small power of the label.

What travels through the tables is a vector's number and one byte for each line. Whole vectors are fetched once, for
those that have a candidate, and dealt by component of the candidates: every link lies within one of them. There pairs
are compared in blocks of a bounded size; links are counted and reduced to a spanning forest, never written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import grouped, pair_blocks, salted_join
from ledgerloom.llm.common import Local, cut, longs, mix, trimmed
from ledgerloom.llm.components import components

LINES = 32  # lines on which collisions are counted
STEPS = 8  # a window's half, in the steps of the one-byte numbers


def _normal(x: float) -> float:
    return math.erf(x / math.sqrt(2))


class Plan:
    """Windows, cells, tables and the count, from the cosine and the recall asked for; fill: rows of the largest label
    that meet one by chance in a table, about."""

    def __init__(self, cosine: float, largest: int, recall: float = 0.9999, fill: int = 1024):
        distance = math.sqrt(2 - 2 * cosine)
        self.half = 2 * distance
        self.width = 5 * self.half
        near = 1 - distance * math.sqrt(2 / math.pi) / self.width  # two vectors at the limit share a cell of one line
        x = np.linspace(0, self.width, 2001)
        far = float((2 * (1 - x / self.width) * np.exp(-(x**2) / 4) / math.sqrt(4 * math.pi)).sum() * (x[1] - x[0]))  # for vectors at a right angle
        self.depth = max(1, math.ceil(math.log(max(1, largest) / fill) / -math.log(far)))
        self.tables = max(2, math.ceil(math.log(1 - recall) / math.log(1 - near**self.depth)))
        self.met = 1 - (1 - near**self.depth) ** self.tables
        collide = _normal(self.half / distance)
        tail, self.count = 0.0, LINES + 1
        while self.count > 0 and tail < recall:
            self.count -= 1
            tail += math.comb(LINES, self.count) * collide**self.count * (1 - collide) ** (LINES - self.count)
        #: sum of squared differences, in steps, that pairs at the limit exceed in one case of a million
        self.farthest = (distance / self.half * STEPS) ** 2 * (LINES + 4.76 * math.sqrt(2 * LINES) + 16) + 2 * LINES * STEPS
        rng = np.random.Generator(np.random.PCG64(20_240_601))
        self.shift = rng.random(self.depth * self.tables)

    def lines(self, size: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64([20_240_601, size])).standard_normal((size, LINES + self.depth * self.tables))

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """One byte for each of the counted lines: two numbers in a window differ by STEPS + 1 at most."""
        return np.clip(np.floor(x[:, :LINES] * (STEPS / self.half)), -128, 127).astype(np.int8)

    def keys(self, group: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The cell of each row in each table, as a hash of the row's group, the table and the cells of its lines."""
        cells = np.floor(x[:, LINES:] / self.width + self.shift).astype(np.int64).astype(np.uint64)
        out = np.empty((len(x), self.tables), np.uint64)
        for t in range(self.tables):
            h = mix(group.astype(np.uint64) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64))
            for k in range(t * self.depth, (t + 1) * self.depth):
                h = mix(h ^ cells[:, k] * np.uint64(0xBF58476D1CE4E5B9))
            out[:, t] = h
        return out.astype(np.int64)


# ---------------------------------------------------------------- vectors


def unit_vectors(column: pa.Array):
    """(rows, matrix of unit vectors as float64) for each length, of the vectors that can link."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    sizes = np.where(valid, np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)), 0)
    values = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)  # null components as NaN
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        x = values[starts[at][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1)
        at, x = at[good], x[good]
        top = np.abs(x).max(axis=1, initial=0)
        at, x = at[top > 0], x[top > 0] / top[top > 0, None]  # no overflow, no underflow of the squares
        if len(at):
            yield at, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _marked(embeddings: DataFrame) -> DataFrame:
    """vec_id, g (label and length; null for rows that link with nothing), embedding."""
    g = F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64(F.col("label").cast("string"), F.size("embedding")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), g.alias("g"), "embedding")


def _told(plan: Plan | None, vectors: bool):
    """(vec_id, g, h) of each row; h: 128-bit hash of the unit vector, null if the row links with nothing. With a plan also
    the one-byte numbers and the tables' keys, with vectors the unit vector: then only of rows that can link."""

    def rows(batches):
        for batch in batches:
            n = batch.num_rows
            h, more, keys = [None] * n, [None] * n, [None] * n
            group, here = batch.column(1).fill_null(0).to_numpy(), np.asarray(batch.column(1).is_valid())
            for at, x in unit_vectors(batch.column(2)):
                at, x = at[here[at]], x[here[at]]
                if not len(at):
                    continue
                p = x @ plan.lines(x.shape[1]) if plan else None
                numbers, cells = (plan.numbers(p), plan.keys(group[at], p)) if plan else (None, None)
                raw = x.astype("<f8")
                for k, i in enumerate(at.tolist()):
                    own = raw[k].tobytes()
                    h[i] = xxhash.xxh3_128_digest(own)
                    if plan:
                        more[i], keys[i] = numbers[k].tobytes(), cells[k]
                    elif vectors:
                        more[i] = own
            columns = [batch.column(0), batch.column(1), pa.array(h, pa.binary())]
            if plan or vectors:
                columns.append(pa.array(more, pa.binary()))
            if plan:
                columns.append(pa.array(keys, pa.list_(pa.int64())))
            out = pa.RecordBatch.from_arrays(columns, names=["vec_id", "g", "h", "more" if plan else "vec", "keys"][: len(columns)])
            yield out.filter(out.column(2).is_valid()) if plan or vectors else out

    return rows


# ---------------------------------------------------------------- candidates


def _candidates(plan: Plan):
    """A spanning forest of the candidate pairs in each cell of a table."""

    def work(arrays, starts, ends):
        left, right = [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            node, sub = arrays["node"][a:b], arrays["sub"][a:b]
            same = arrays["i"][a] == arrays["j"][a]
            x = np.frombuffer(b"".join(arrays["more"][a:b]), np.int8).reshape(b - a, LINES)
            wide = x.astype(np.float32)
            squares = np.einsum("ij,ij->i", wide, wide)
            local = Local(b - a)
            step = max(1, (1 << 20) // (b - a))
            for k in range(0, b - a, step):
                part = slice(k, min(b - a, k + step))
                near = squares[part, None] + squares[None, :] - 2 * (wide[part] @ wide.T) <= plan.farthest
                near &= (local.root[part, None] != local.root[None, :]) & (np.arange(part.start, part.stop)[:, None] < np.arange(b - a)[None, :])
                if not same:
                    near &= sub[part, None] != sub[None, :]
                i, j = np.nonzero(near)
                i += k
                for c in range(0, len(i), 1 << 17):
                    p, q = i[c : c + (1 << 17)], j[c : c + (1 << 17)]
                    open_ = local.root[p] != local.root[q]
                    p, q = p[open_], q[open_]
                    collisions = (np.abs(x[p].astype(np.int16) - x[q]) <= STEPS + 1).sum(axis=1)
                    local.add(p[collisions >= plan.count], q[collisions >= plan.count])
            linked = np.flatnonzero(local.root != np.arange(b - a))
            left.append(node[linked])
            right.append(node[local.root[linked]])
        yield pa.RecordBatch.from_arrays([longs(np.concatenate(left)), longs(np.concatenate(right))], names=["a", "b"])

    return work


def candidate_groups(classes: DataFrame, plan: Plan, limit: int) -> DataFrame:
    """(node, component) of the classes (node, more, keys) that have a candidate."""
    rows = classes.select("node", "more", F.explode("keys").alias("key"))
    dealt = pair_blocks(rows, ["key"], "node", limit)
    return components(grouped(dealt, ["key", "i", "j"], _candidates(plan), "a long, b long", ["key", "i", "j", "sub", "node", "more"]))


# ---------------------------------------------------------------- links


def _count(cosine: float):
    """Links of each vector of a block, and a spanning forest of the block's links: rows (node, links, root)."""

    def work(arrays, starts, ends):
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            node, sub, w = arrays["node"][a:b], arrays["sub"][a:b], arrays["w"][a:b]
            same = arrays["i"][a] == arrays["j"][a]
            x = np.frombuffer(b"".join(arrays["vec"][a:b]), "<f8").reshape(b - a, -1)
            links, local = np.zeros(b - a, np.int64), Local(b - a)
            step = max(1, (1 << 20) // (b - a))
            for k in range(0, b - a, step):
                part = slice(k, min(b - a, k + step))
                s = x[part] @ x.T
                close = s >= cosine
                for i, j in zip(*np.nonzero(np.abs(s - cosine) < 1e-9), strict=True):  # at the limit, summed in one order
                    close[i, j] = float(np.dot(x[min(k + i, j)], x[max(k + i, j)])) >= cosine
                close[np.arange(part.stop - part.start), np.arange(part.start, part.stop)] = False
                if not same:
                    close &= sub[part, None] != sub[None, :]
                links[part] = close @ w
                i, j = np.nonzero(close & (local.root[part, None] != local.root[None, :]))
                local.add(i + k, j)
            kept = np.flatnonzero(links)
            if len(kept):
                yield pa.RecordBatch.from_arrays([longs(node[kept]), longs(links[kept]), longs(node[local.root[kept]])], names=["node", "links", "root"])

    return work


def embedding_groups(embeddings: DataFrame, cosine: float = 0.98, limit: int = 1024, recall: float = 0.9999, fill: int = 1024) -> DataFrame:
    """Links vectors of one label with a cosine of at least `cosine`.

    embeddings: vec_id, embedding (array of float or double), label; other columns are ignored. Null labels and vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different lengths
    never link. Exact copies (equal unit vectors) are one node with a weight; their links are counted, never paired.
    Rows that repeat a vec_id with its vector and label are one vector: it counts once, and each row gets its result.
    Different vectors under one vec_id are different vectors: each has its own links, which may be to one another. A row
    without vec_id links with nothing; its component is null. An empty table gives an empty result.

    A pair at the limit is found with probability `recall` squared or more; nothing below the limit is linked. limit:
    rows of a block; fill: see Plan. Returns vec_id, n_links, component_id, kept (vec_id = component_id).
    """
    given = _marked(embeddings)
    largest = given.where("g is not null").groupBy("g").count().agg(F.max("count")).first()[0] or 0
    plan = Plan(cosine, largest, recall, fill)
    told = given.where("g is not null").mapInArrow(trimmed(_told(plan, False)), "vec_id long, g long, h binary, more binary, keys array<long>")
    once = told.groupBy("g", "h", "vec_id").agg(F.first("more").alias("more"), F.first("keys").alias("keys"))  # spread by vec_id: one vector may be very common
    classes = once.groupBy("g", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("more").alias("more"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    near = candidate_groups(classes, plan, limit)
    wanted = cut(classes.select("node", "g", "h", "rep", "w").join(near, "node"))
    vectors = given.where("g is not null").mapInArrow(trimmed(_told(None, True)), "vec_id long, g long, h binary, vec binary")
    fetched = wanted.join(vectors, (vectors.vec_id == wanted.rep) & (vectors.g == wanted.g) & (vectors.h == wanted.h)).select("component", wanted.g, "node", "w", "vec").dropDuplicates(["node"])
    dealt = pair_blocks(fetched, ["component", "g"], "node", limit)
    found = cut(grouped(dealt, ["component", "g", "i", "j"], _count(cosine), "node long, links long, root long", ["component", "g", "i", "j", "sub", "node", "w", "vec"]))
    counts = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "counted")
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "member")
    about = cut(classes.join(counts, classes.node == counts.counted, "left").join(groups, classes.node == groups.member, "left").select(F.col("g").alias("g_"), F.col("h").alias("h_"), "rep", F.coalesce("component", "node").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links")))
    smallest = about.groupBy("group").agg(F.min("rep").alias("component"))
    info = salted_join(about, smallest, ["group"], "h_").select(F.col("g_").alias("g"), F.col("h_").alias("h"), "links", "component")
    rows = given.mapInArrow(trimmed(_told(None, False)), "vec_id long, g long, h binary")
    out = salted_join(rows, info, ["g", "h"], "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
