"""Near-duplicate embeddings by E8 lattice hashing.

Vectors are compared only when their labels are equal and not null.  A vector is normalised; in each of
TABLES tables BLOCKS random projections onto eight dimensions are decoded to points of the E8 lattice, and
the points together name its cell.  A vector is stored in its own cell and looked up in the cells of its
PROBES nearest neighbouring lattice points.  All pairs that meet in a cell are verified by their cosine in
double precision.  A pair that meets more than once is counted at its first meeting only, which both
vectors' cells decide without any list of pairs: what leaves a task are link counts and stars that connect what is linked.

Vectors that are equal after scaling form a class first, and one vector stands for it.  A cell of more than BLOCK
vectors is dealt out to pairs of blocks, so no cell is gathered in one task.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label, link with
nothing.  Vectors of different length never link.  A null vec_id is returned with a null component; repeated rows
are separate vectors, linked with each other.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, arrow_map, components, join_heavy, keep_ids, read

THRESHOLD = 0.93
#: Lattice tables, eight-dimensional blocks of each, probed neighbours, the size of a cell, and the seed.
TABLES, BLOCKS, PROBES, CELL, SEED = 10, 2, 16, 1.8, 7
#: Vectors of a block of a large cell, vectors of cells that are verified all at once by their size, and pairs of one step.
BLOCK, SMALL, STEP = 1000, 16, 1 << 14


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a in (1, -1):
            for b in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    for k in range(256):
        v = np.array([0.5 if k >> i & 1 else -0.5 for i in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


_ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    if len(odd):
        gap = x[odd] - r[odd]
        k = np.abs(gap).argmax(1)
        r[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 to the rows of x: the better of the even integer points and the same moved by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def _name(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 32-bit name for rows of lattice points.  Points that share a name share a cell, which costs time only."""
    with np.errstate(over="ignore"):
        x = (np.rint(points * 2).astype(np.int64).view(np.uint64) * salt).sum(1, dtype=np.uint64)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors: own cells (vectors x TABLES) and probed cells (vectors x TABLES x PROBES)."""
    n, dim = unit.shape
    rng = np.random.default_rng([SEED, dim])
    own = np.empty((n, TABLES), np.int32)
    probed = np.empty((n, TABLES, PROBES), np.int32)
    for t in range(TABLES):
        plane = rng.normal(size=(dim, 8 * BLOCKS)) / CELL
        shift = rng.random(8 * BLOCKS)
        salt = rng.integers(1, 1 << 62, 8 * BLOCKS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        y = unit @ plane + shift
        p = np.concatenate([nearest_e8(y[:, 8 * k : 8 * k + 8]) for k in range(BLOCKS)], 1)
        own[:, t] = _name(p, salt)
        # distance to the neighbour p + r grows with |r|^2 - 2 r.(y - p), and |r|^2 is 2 for every root
        gain = np.concatenate([(y - p)[:, 8 * k : 8 * k + 8] @ _ROOTS.T for k in range(BLOCKS)], 1)
        best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        for q in range(PROBES):
            near = p.copy()
            for k in range(BLOCKS):
                here = np.flatnonzero(best[:, q] // 240 == k)
                near[here, 8 * k : 8 * k + 8] += _ROOTS[best[here, q] % 240]
            probed[:, t, q] = _name(near, salt)
    return own, probed


def _units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision from rows of stored bytes: a letter for the type, then the components."""
    kind = np.float32 if raw[0, 0] == ord("f") else np.float64
    x = np.ascontiguousarray(raw[:, 8:]).view(kind).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of a binary column begin and end, and the bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1], np.frombuffer(data, np.uint8)


def _by_kind(column: pa.Array):
    """Rows of stored vectors that are alike in type and length: where they are, and their bytes as a matrix."""
    at, data = _bytes(column)
    size, letter = np.diff(at), data[at[:-1]]
    if len(size) and (size == size[0]).all() and (letter == letter[0]).all():
        yield np.arange(len(size)), data[at[0] : at[-1]].reshape(len(size), -1)
        return
    for n, c in sorted(set(zip(size.tolist(), letter.tolist()))):
        rows = np.flatnonzero((size == n) & (letter == c))
        yield rows, data[at[rows][:, None] + np.arange(n)]


def _prepare(batches):
    """rid, vec_id, label, the vector as bytes and its key; the last two are null for what links with nothing."""
    next_id = TaskContext.get().partitionId() << 40
    for batch in batches:
        n, column = batch.num_rows, batch.column(1)
        units, keys = [None] * n, [None] * n
        kind, mark = (np.float64, b"d       ") if pa.types.is_float64(column.type.value_type) else (np.float32, b"f       ")
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        x = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy().astype(kind)
        first, row = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(n), size)
        good = (np.bincount(row, ~np.isfinite(x), n) == 0) & (np.bincount(row, x != 0, n) > 0) & batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        for d in np.unique(size[good]).tolist():
            rows = np.flatnonzero(good & (size == d))
            raw = np.ascontiguousarray(x[first[rows][:, None] + np.arange(d)]).view(np.uint8)
            raw = np.concatenate([np.broadcast_to(np.frombuffer(mark, np.uint8), (len(rows), 8)), raw], 1)
            near = np.round(_units(raw), 12) + 0.0
            for k, u, v in zip(rows.tolist(), raw, near):
                units[k], keys[k] = u.tobytes(), hashlib.blake2b(v.tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(next_id, next_id + n)), batch.column(0), batch.column(2).cast(pa.string()), pa.array(units, pa.binary()),
            pa.array(keys, pa.binary())], ["rid", "vec_id", "label", "unit", "key"])
        next_id += n


def _key(label: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """One number for label (its hash), table and cell of an array vectors x TABLES x any: 24, 8 and 32 bits."""
    table = np.arange(TABLES, dtype=np.int64)[None, :, None] << 32
    return ((label >> 40) << 40)[:, None, None] | table | (cells.astype(np.int64) & 0xFFFFFFFF)


def _post(batches):
    """Rows for the cells: of a class (id, label as a hash, copies, unit) its own cell and the probed ones of each table, with all its codes."""
    for batch in batches:
        for rows, raw in _by_kind(batch.column(3)):
            own, probed = cells(_units(raw))
            every = np.concatenate([own[:, :, None], probed], 2)  # vectors x TABLES x (1 + PROBES)
            at = pa.array(rows)
            label = batch.column(1).take(at)
            keys = _key(label.to_numpy(), every).reshape(len(rows), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), label, batch.column(2).take(at), batch.column(3).take(at), pa.array([x.tobytes() for x in every], pa.binary()),
                    pa.array(list(keys), pa.list_(pa.int64()))],
                ["id", "label", "copies", "unit", "codes", "cells"],
            )


def _first_meeting(codes: np.ndarray, x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether pairs of rows, x with the smaller id, meet first in the cell of this key; codes are rows x TABLES x (1 + PROBES).

    The first meeting is in the first table where they meet: in x's own cell if y is stored or looked up there, else in y's.  Tables are
    read one by one, and only for pairs that have not met before.
    """
    table, cell, ours, left = (key >> 32) & 0xFF, (key & 0xFFFFFFFF).astype(np.uint32).view(np.int32), np.zeros(len(x), bool), np.arange(len(x))
    for s in range(TABLES):
        left = left[table[left] >= s]
        if not len(left):
            break
        cx, cy = codes[x[left], s], codes[y[left], s]
        in_x = (cy == cx[:, :1]).any(1)
        met = in_x | (cx == cy[:, :1]).any(1)
        last = table[left] == s
        ours[left[last]] = (met & (np.where(in_x, cx[:, 0], cy[:, 0]) == cell[left]))[last]
        left = left[~last & ~met]
    return ours


class _Links:
    """Pairs that were found: a count for each vector, and stars that connect what is linked."""

    def __init__(self):
        self.pairs: list = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> None:
        if len(a):
            self.pairs.append((a, b, wa, wb))
            self.size += len(a)

    def flush(self) -> pa.RecordBatch:
        a, b, wa, wb = (np.concatenate([p[k] for p in self.pairs]) for k in range(4))
        self.pairs, self.size = [], 0
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        links = np.bincount(at, np.concatenate([wb, wa]), len(ids)).astype(np.int64)
        x, y = at[: len(a)], at[len(a) :]
        low = np.arange(len(ids))
        while True:
            least = np.minimum(low[x], low[y])
            new = low.copy()
            np.minimum.at(new, x, least)
            np.minimum.at(new, y, least)
            new = new[new]
            if (new == low).all():
                break
            low = new
        star = np.flatnonzero(low != np.arange(len(ids)))
        none = pa.nulls(len(star), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(ids), pa.array(ids[low[star]])]), pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids[star])]),
                pa.concat_arrays([pa.array(links), none])], ["a", "b", "links"])


def _cells(batches):
    """Reads rows sorted by (cell, i, j), all cells of a batch at once; gives links of each vector and edges that connect what is linked."""
    links = _Links()

    def verify(m, unit, codes, x, y):
        cell, i, j, block, ids, copies, label = m.T
        ok = (label[x] == label[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
        x, y = x[ok], y[ok]
        x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        ok = _first_meeting(codes, x, y, cell[x])
        x, y = x[ok], y[ok]
        ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= THRESHOLD
        x, y = x[ok], y[ok]
        links.add(ids[x], ids[y], copies[x], copies[y])

    def tiles(m, raw, codes):
        cut = np.flatnonzero((m[1:, :3] != m[:-1, :3]).any(1)) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(m))
        size, unit = ends - starts, _units(raw)
        for s in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
            at, (left, right) = starts[size == s][:, None], np.triu_indices(s, 1)
            step = 1 + STEP // len(left)
            for k in range(0, len(at), step):
                yield verify(m, unit, codes, (at[k : k + step] + left).ravel(), (at[k : k + step] + right).ravel())
        for a, z in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist()):
            for k in range(a, z, 512):  # the product of blocks first: few of a large cell's pairs are close
                x, y = np.nonzero(unit[k : min(k + 512, z)] @ unit[a:z].T >= THRESHOLD - 1e-9)
                x, y = x + k, y + a
                x, y = x[y > x], y[y > x]
                for c in range(0, len(x), STEP):
                    yield verify(m, unit, codes, x[c : c + STEP], y[c : c + STEP])

    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            cell = np.stack([rest.column(k).to_numpy() for k in range(3)], 1)
            last = np.flatnonzero((cell[1:] != cell[:-1]).any(1))
            n = int(last[-1]) + 1 if len(last) else 0
            now, rest = rest.slice(0, n), rest.slice(n)
        else:
            now = rest
        if now is None or not now.num_rows:
            continue
        for rows, raw in _by_kind(now.column(7)):
            part = now if len(rows) == now.num_rows else now.take(pa.array(rows))
            m = np.stack([part.column(k).to_numpy().astype(np.int64) for k in range(7)], 1)
            where, data = _bytes(part.column(8))
            codes = data[where[0] : where[-1]].view(np.int32).reshape(len(rows), TABLES, 1 + PROBES)
            for _ in tiles(m, raw, codes):
                if links.size > 1_000_000:
                    yield links.flush()
    if links.size:
        yield links.flush()


def near_duplicates(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """For each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    rows = scratch.write(arrow_map(vectors, _prepare, "rid long, vec_id long, label string, unit binary, key binary"), "units")
    total = rows.count()
    # the class is named by its smallest row; rows of a class are counted, and the smallest vec_id is kept for the component
    good = rows.where("key is not null")
    classes = good.groupBy("key", "label").agg(F.min("rid").alias("id"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.write(classes, "classes", narrow=True)
    again = join_heavy(good.select("rid", "key", "label"), classes.where("copies > 1").select("key", "label", "id", "copies"), ["key", "label"], "copies", total)
    again = scratch.write(again.where("rid <> id").select("rid"), "again", narrow=True)
    heads = keep_ids(good.select("rid", F.xxhash64("label").alias("label"), "unit"), "rid", again, again.count(), "left_anti").withColumnRenamed("rid", "id")
    heads = heads.join(classes.where("copies > 1").select("id", "copies"), "id", "left").select("id", "label", F.coalesce("copies", F.lit(1)).alias("copies"), "unit")
    posts = scratch.write(arrow_map(heads, _post, "id long, label long, copies long, unit binary, codes binary, cells array<long>"), "posts")
    keys = posts.select("id", F.posexplode("cells").alias("p", "cell")).select("id", "cell", (F.col("p") % (1 + PROBES) == 0).alias("stored"))
    size = keys.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.bool_or("stored").alias("stored")).where("stored and size > 1").drop("stored")
    tiles = keys.drop("stored").join(size, "cell").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("cell", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "id")
    tiles = tiles.join(posts.drop("cells"), "id").select("cell", "i", "j", "block", "id", "copies", "label", "unit", "codes")
    tiles = tiles.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    met = scratch.write(arrow_map(tiles, _cells, "a long, b long, links long"), "met")
    scratch.drop(posts, again)

    links = met.where("links is not null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    comp = components(scratch, met.where("b is not null").select("a", "b"))
    named = classes.join(links, "id", "left").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named = scratch.write(named, "named", narrow=True)
    low = named.groupBy("comp").agg(F.min("low").alias("low"))
    named = named.drop("low").join(low, "comp").select("key", "label", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "low")
    named = scratch.write(named, "results", narrow=True)
    out = join_heavy(good.select("vec_id", "key", "label"), named, ["key", "label"], "copies", total).select("vec_id", "n_links",
        F.when(F.col("vec_id").isNotNull(), F.col("low")).alias("component_id"))
    out = out.unionAll(rows.where("key is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "embeddings"))
