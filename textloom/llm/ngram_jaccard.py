"""Exact Jaccard self-join of documents on word shingles, by size-banded tiles and hashed bitmap signatures.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Two documents link when the
sets' intersection is at least 80 % of their union.  The join loses no link and works in these steps:

1. A count sketch of fixed size over all shingles of all documents gives each shingle a level: the more
   frequent, the higher.  Any order of the shingles is right; this one sends common passages last.
2. Rows with equal sets form a class, known by a number of its own; only classes go on from here.
3. Two sets that link share a shingle among the first n - ceil(0.8 n) + 1 of each.  These are posted, and
   all postings of a shingle make a tile.
4. First pass: within each tile every class meets the tile's smallest one (its hub) only.  Links found give
   preliminary components: a group of thousands of near copies costs its size, not its square.  Where large components still
   share tiles, so that the second pass would make more than FEW pairs a posting, further rounds with other hubs join them:
   one of each tile's largest component meets the rest, one of the rest meets all others, as long as that halves the pairs left.
   The hubs are the classes that share the most shingles with any others, as an original does among its edited copies, and
   every other round random ones.
5. Second pass: in tiles that still hold several components, classes of different components meet if
   their sizes lie in the band of factor 0.8, if enough shingles remain after the shared one, and if they share none
   of their first EARLY postings before it, which makes nearly every pair once.  A tile of more than BLOCK classes is
   cut into size bands, of which only neighbours meet, and a band that is still larger into blocks: those
   outside its largest component against all others.  The largest component never meets itself.
6. Each distinct pair is bounded from above by bit counts of its bitmap signatures; survivors are
   intersected exactly as sorted arrays.

Texts that are null, empty or without words have an empty set and link with nothing.  A null doc_id gets a
null component, but its row links others.  Rows are told apart by a number of their own: those of one doc_id may have
different texts, and repeated rows are returned as often as they come.  Other columns are ignored; an empty table gives an
empty result.  A very long text is read in pieces; its set, eight bytes a shingle, is held by one task at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bytehash
from textloom.llm.common import BROADCAST_IDS, Scratch, arrow_map, components, fresh, join_heavy, keep_ids, read

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Counters of the sketch, in CHUNKS rows: its size is the same for any input.
BUCKETS, CHUNKS = 1 << 20, 64
#: Classes of a tile's block, and earlier postings that a posting carries.
BLOCK, EARLY = 1000, 8
#: Pairs a posting that the second pass may make without further rounds of hubs, and the most of these.
FEW, ROUNDS = 64, 5
#: Rows of tiles for a task of the second pass.
TILE_ROWS = 50_000
#: Rows of tiles that are met all at once, by their size, and pairs of rows for one step.
SMALL, STEP = 16, 1 << 15
#: A little more than the ratio of sizes that still link, so that two such sizes are in one band or in neighbouring ones.
_BAND = 100 / PERCENT + 1e-4
_SHIFT = np.uint64(64 - 20)


def _count(batches):
    counts = np.zeros(BUCKETS, np.uint32)
    for batch in batches:
        data, offsets = bytehash.buffers(batch.column(0))
        for i, j in bytehash.pieces(offsets):
            h, at = bytehash.words(data, offsets[i : j + 1])
            g = bytehash.grams(h)
            inside = np.ones(len(g), bool)
            for k in range(1, bytehash.WIDTH):  # no shingle runs over the border of two rows
                border = at[1:-1] - k
                inside[border[(border >= 0) & (border < len(g))]] = False
            counts += np.bincount((g[inside] >> _SHIFT).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
    yield from _packed({(c, TaskContext.get().partitionId() % 16): part for c, part in enumerate(counts.reshape(CHUNKS, -1))})


def _packed(parts: dict):
    if parts:
        keys = list(parts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([zlib.compress(parts[k].astype(np.uint64).tobytes(), 1) for k in keys], pa.binary())], ["chunk", "salt", "counts"])


def _summed(batches):
    parts: dict = {}
    for batch in batches:
        for c, s, x in zip(*(batch.column(k).to_pylist() for k in range(3))):
            x = np.frombuffer(zlib.decompress(x), np.uint64)
            parts[c, s] = parts[c, s] + x if (c, s) in parts else x
    yield from _packed(parts)


def shingle_levels(docs: DataFrame) -> np.ndarray:
    """The level of each counter: 0 for what is not above the noise of the sketch."""
    schema = "chunk int, salt int, counts binary"
    parts = arrow_map(docs.select("text"), _count, schema)
    parts = arrow_map(parts.repartition("chunk", "salt"), _summed, schema)
    parts = arrow_map(parts.select("chunk", F.lit(0).alias("salt"), "counts").repartition("chunk"), _summed, schema)
    counts = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.float64)
    for r in parts.collect():  # CHUNKS rows
        counts[r["chunk"]] += np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    counts = counts.ravel()
    mean = counts.mean()
    over = (counts - mean) / (8 * np.sqrt(mean) + 8)
    return np.clip(np.where(over > 1, 1 + np.floor(2 * np.log2(np.maximum(over, 1))), 0), 0, 100).astype(np.uint8)


def _features(levels: np.ndarray):
    def run(batches):
        next_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            rid = np.arange(next_id, next_id + batch.num_rows)
            next_id += batch.num_rows
            rows: list = [[], [], [], [], []]
            for s in bytehash.shingle_sets(batch.column(1)):
                n = len(s)
                rows[0].append(n)
                if not n:
                    for r in rows[1:]:
                        r.append(None)
                    continue
                with np.errstate(over="ignore"):
                    rows[1].append(int((s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)))
                    rows[2].append(int(np.bitwise_xor.reduce(bytehash.mix(s + np.uint64(n))).view(np.int64)))
                order = (levels[(s >> _SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                p = n - (PERCENT * n + 99) // 100 + 1
                if p < n:
                    order = np.partition(order, p - 1)[:p]
                rows[3].append(np.sort(order).view(np.int64))
                bits = np.zeros(max(64, 1 << (n - 1).bit_length()), bool)
                bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
                rows[4].append(np.packbits(bits, bitorder="little").tobytes())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rid), batch.column(0), batch.column(2), *map(pa.array, rows, kinds)],
                ["rid", "doc_id", "th", "n", "k1", "k2", "prefix", "bits"])

    return run


def _slices(column: pa.Array, kind) -> list[np.ndarray]:
    """The rows of a binary column as arrays, without a copy."""
    wide = 8 if pa.types.is_large_binary(column.type) else 4
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide == 8 else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return [data[i:j].view(kind) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def _kept(batch, keep: list) -> pa.RecordBatch:
    at = pa.array(keep, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])


def _bounded(batches):
    """Pairs whose bitmaps allow an overlap that is large enough."""
    for batch in batches:
        na, nb = (batch.column(k).to_numpy().tolist() for k in (2, 3))
        xa, xb = (_slices(batch.column(k), np.uint64) for k in (4, 5))
        keep = []
        for k, (x, y, n, m) in enumerate(zip(xa, xb, na, nb)):
            size = min(len(x), len(y))
            if len(x) > size:
                x = np.bitwise_or.reduce(x.reshape(-1, size))
            if len(y) > size:
                y = np.bitwise_or.reduce(y.reshape(-1, size))
            most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
            if 100 * most >= PERCENT * (n + m - most):
                keep.append(k)
        yield _kept(batch, keep)


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in bytehash.shingle_sets(batch.column(1))], pa.binary())], ["cid", "set"])


def _intersected(batches):
    for batch in batches:
        keep = []
        for k, (x, y) in enumerate(zip(*(_slices(batch.column(c), np.uint64) for c in (2, 3)))):
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                keep.append(k)
        yield _kept(batch, keep)


#: The columns of a row of a tile, but for its earlier postings.
ROW = ("token", "band", "i", "j", "block", "cid", "hub", "n", "pos", "comp", "guest")


def _allowed(m: np.ndarray, early: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the pairs of rows x and y (of one tile each) that the second pass makes."""
    _, _, i, j, block, cid, hub, n, pos, comp, guest = m.T
    ok = (comp[x] != comp[y]) & (cid[x] != hub[x]) & (cid[y] != hub[x]) & ((guest[x] == 0) | (guest[y] == 0)) & ((i[x] == j[x]) | (block[x] != block[y]))
    x, y = x[ok], y[ok]
    need = (PERCENT * (n[x] + n[y]) + 99 + PERCENT) // (100 + PERCENT)
    rest = 1 + np.minimum(n[x] - 1 - pos[x], n[y] - 1 - pos[y])
    ok = (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])) & (rest >= need)
    x, y = x[ok], y[ok]
    ok = np.ones(len(x), bool)
    for k in range(EARLY):
        mine = early[x, k]
        ok &= (mine == 0) | ~(early[y] == mine[:, None]).any(1)
    x, y = cid[x[ok]], cid[y[ok]]
    return np.minimum(x, y), np.maximum(x, y)


def _early(column: pa.Array) -> np.ndarray:
    """Lists of up to EARLY numbers as rows, filled up with zeros."""
    out = np.zeros((len(column), EARLY), np.int64)
    size = column.value_lengths().to_numpy()
    out[np.arange(EARLY) < size[:, None]] = column.flatten().to_numpy()
    return out


def _tiles(batches):
    """Reads rows sorted by (token, band, i, j), a tile at a time, over batches."""
    rest, more, out = None, None, []

    def flush():
        pairs = np.unique(np.stack([np.concatenate([x[k] for x in out]) for k in (0, 1)], 1), axis=0)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def tiles(m, early, last):
        cut = np.flatnonzero((m[1:, :4] != m[:-1, :4]).any(1)) + 1
        ends = np.append(cut, len(m)) if last else cut
        starts = np.append(0, cut)[: len(ends)]
        size = ends - starts
        for s in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():  # tiles of one size at once
            at, (left, right) = starts[size == s][:, None], np.triu_indices(s, 1)
            for k in range(0, len(at), 1 + STEP // len(left)):
                part = at[k : k + 1 + STEP // len(left)]
                out.append(_allowed(m, early, (part + left).ravel(), (part + right).ravel()))
        for a, z in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist()):
            step = 1 + STEP // (z - a)
            for k in range(a, z, step):
                x = np.repeat(np.arange(k, min(k + step, z)), z - a)
                y = np.tile(np.arange(a, z), min(k + step, z) - k)
                out.append(_allowed(m, early, x[y > x], y[y > x]))
        a = int(starts[-1] + size[-1]) if len(ends) else 0
        return m[a:], early[a:]

    for batch in batches:
        m = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(ROW))], 1)
        e = _early(batch.column(len(ROW)))
        rest, more = tiles(*((m, e) if rest is None else (np.concatenate([rest, m]), np.concatenate([more, e]))), False)
        if sum(len(x[0]) for x in out) > 200_000:
            yield flush()
    if rest is not None and len(rest):
        tiles(rest, more, True)
    if out:
        yield flush()


def _verified(scratch: Scratch, docs: DataFrame, signs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that link."""
    x = signs.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = signs.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    left = pairs.join(x, "a").join(y, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    left = scratch.write(arrow_map(left.select("a", "b", "na", "nb", "xa", "xb"), _bounded, "a long, b long"), f"{name}-bounded", narrow=True)
    ids = left.select(F.col("a").alias("cid")).unionAll(left.select("b")).distinct()
    ids = scratch.write(signs.join(ids, "cid").select("cid", F.col("doc_id").alias("d"), F.col("th").alias("t")), f"{name}-ids", narrow=True)
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS // 2 else ids
    texts = docs.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("cid", "text")
    sets = scratch.write(arrow_map(texts, _sets, "cid long, set binary").distinct(), f"{name}-sets")
    links = left.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    links = scratch.write(arrow_map(links, _intersected, "a long, b long").distinct(), f"{name}-links", narrow=True)
    scratch.drop(left, ids, sets)
    return links


def _merged(scratch: Scratch, docs: DataFrame, signs: DataFrame, tiles: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rounds of hubs for tiles (token, hub, size, cid, n, pos): the tiles with their components comp, all links found, and their components."""
    last = None
    for r in range(ROUNDS + 1):
        comp = components(scratch, links)
        here = tiles.join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        if r % 2 == 0:
            here = here.join(here.groupBy("cid").agg((-F.count(F.lit(1))).alias("h")), "cid")
        else:
            here = here.withColumn("h", F.xxhash64(F.lit(r), "cid"))
        here = scratch.write(here, "tiles")
        draw = F.struct("h", "cid", "comp")
        top = here.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(draw).alias("d"))
        top = top.groupBy("token").agg(F.max_by("d", F.struct("c", "comp")).alias("d"), F.max("c").alias("most"), F.sum("c").alias("all")).where("most < all")
        top = scratch.write(top.select("token", F.col("d.cid").alias("one"), F.col("d.comp").alias("major"), "most", "all"), "tops", narrow=True)
        sums = top.agg(F.sum(F.expr("(all - most) * cast(all as double)")).alias("pairs"), F.sum("all").alias("posts")).first()
        if r == ROUNDS or not sums["posts"] or sums["pairs"] <= FEW * sums["posts"] or (last is not None and 2 * sums["pairs"] > last):
            scratch.drop(top)
            return here, links, comp
        last = sums["pairs"]
        rest = here.join(top.select("token", "one", "major"), "token")
        others = rest.where("comp <> major").groupBy("token").agg(F.min(draw).alias("d")).select("token", F.col("d.cid").alias("two"), F.col("d.comp").alias("minor"))
        pairs = rest.where("comp <> major").select("cid", F.col("one").alias("other")).unionAll(rest.join(others, "token").where("comp <> minor").select("cid", "two"))
        pairs = pairs.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()
        links = links.unionAll(_verified(scratch, docs, signs, pairs, f"round{r}"))
        scratch.drop(here, top)


def _second_pairs(scratch: Scratch, tiles: DataFrame) -> DataFrame:
    """Distinct pairs of the second pass, from tiles (token, hub, size, cid, n, pos, comp)."""
    small, large = tiles.where(F.col("size") <= BLOCK), tiles.where(F.col("size") > BLOCK)
    several = small.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    rows = small.join(several, "token").unionByName(large)
    mine = rows.groupBy("cid", "n", "comp").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "hub", "size"))).alias("p"))
    # zeros fill up the lists; a shingle of that number is seen as not shared earlier, which makes its pairs twice
    mine = mine.withColumn("first", F.transform(F.slice("p", 1, EARLY), lambda x: x["token"]))
    rows = mine.select("cid", "n", "comp", "first", F.posexplode("p").alias("k", "x"))
    rows = rows.select("cid", "n", "comp", "x.*", F.slice("first", F.lit(1), F.least("k", F.lit(EARLY))).alias("early"))
    rows = scratch.write(rows, "second")

    small = rows.where(F.col("size") <= BLOCK).withColumns({c: F.lit(0) for c in ("band", "i", "j", "block", "guest")})
    large = rows.where(F.col("size") > BLOCK).withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1))))
    large = large.withColumn("band", F.floor(F.log("n") / F.log(F.lit(_BAND))).cast("int") + F.col("guest"))
    counts = large.groupBy("token", "band", "comp").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.groupBy("token", "band").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.max("c").alias("most"),
        F.sum("c").alias("all")).where("most < all")
    counts = counts.select("token", "band", "major", F.ceil(F.col("most") / BLOCK).cast("int").alias("b1"),
        F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("b2"))
    large = large.join(counts, ["token", "band"])
    minor, h = F.col("comp") != F.col("major"), F.xxhash64("cid")
    large = large.withColumn("block", F.when(minor, F.col("b1") + F.pmod(h, "b2")).otherwise(F.pmod(h, "b1")).cast("int"))
    large = large.withColumn("k", F.explode(F.sequence(F.when(minor, F.lit(0)).otherwise(F.col("b1")), F.col("b1") + F.col("b2") - 1)))
    large = large.withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")})
    cut = small.select(*ROW, "early").unionByName(large.select(*ROW, "early"))
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // TILE_ROWS)
    cut = cut.repartition(parts, "token", "band", "i", "j").sortWithinPartitions("token", "band", "i", "j")
    pairs = scratch.write(arrow_map(cut, _tiles, "a long, b long").distinct(), "pairs", narrow=True)
    scratch.drop(rows)
    return pairs


def _classes(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (rid, doc_id, th, n, k1, k2), classes (n, k1, k2, cid, low, copies) and components of classes (id, comp), from docs (doc_id, text, th)."""
    levels = shingle_levels(docs)
    schema = "rid long, doc_id long, th long, n int, k1 long, k2 long, prefix array<long>, bits binary"
    feats = scratch.write(arrow_map(docs, _features(levels), schema), "features")
    rows = feats.select("rid", "doc_id", "th", "n", "k1", "k2")
    classes = rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.write(classes, "classes", narrow=True)
    keys = ["n", "k1", "k2"]
    copies = join_heavy(rows.where("n > 0").select("rid", *keys), classes.where("copies > 1").select(*keys, "cid", "copies"), keys, "copies", _copies(classes))
    copies = scratch.write(copies.where("rid <> cid").select("rid"), "copies", narrow=True)
    heads = keep_ids(feats.where("n > 0"), "rid", copies, copies.count(), "left_anti").withColumnRenamed("rid", "cid")
    signs = scratch.write(heads.select("cid", "doc_id", "th", "n", "bits"), "signs")

    posts = heads.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    hubs = posts.groupBy("token").agg(F.min("cid").alias("hub"), F.max("cid").alias("other"), F.count(F.lit(1)).alias("size")).where("hub <> other")
    shared = scratch.write(posts.join(hubs.drop("other"), "token"), "shared")
    first = _verified(scratch, docs, signs, shared.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), "first")
    tiles, links, comp = _merged(scratch, docs, signs, shared, first)
    scratch.drop(shared)
    pairs = _second_pairs(scratch, tiles)
    scratch.drop(tiles)
    second = _verified(scratch, docs, signs, pairs, "second")
    if second.limit(1).count():
        comp = components(scratch, links.unionAll(second))
    scratch.drop(signs, pairs, copies)
    return rows, classes, comp


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def _copies(classes: DataFrame) -> int:
    return classes.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    scratch = Scratch(spark)
    rows, classes, comp = _classes(scratch, _read(docs))
    joined = classes.join(comp, F.col("cid") == F.col("id"))
    low = joined.groupBy("comp").agg(F.min("low").alias("lowest"))
    lowest = joined.join(low, "comp").select(F.col("cid").alias("id"), "lowest")
    named = classes.join(lowest, F.col("cid") == F.col("id"), "left")
    named = scratch.write(named.select("n", "k1", "k2", "copies", F.coalesce("lowest", "low").alias("component")), "named", narrow=True)
    out = join_heavy(rows.where("n > 0").select("doc_id", "n", "k1", "k2"), named, ["n", "k1", "k2"], "copies", _copies(classes))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    return out.unionAll(rows.where("n = 0").select("doc_id", F.col("n").cast("long"), "doc_id"))


def distinct_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group of linked documents stays.

    It is the row with the smallest doc_id, null last, and of several the smallest text by its hash.  A repeated row stays once; rows
    without words stay all.
    """
    scratch = Scratch(spark)
    rows, classes, comp = _classes(scratch, _read(docs))
    named = classes.join(comp, F.col("cid") == F.col("id"), "left").where("copies > 1 or comp is not null")
    named = scratch.write(named.select("n", "k1", "k2", "copies", F.coalesce("comp", "cid").alias("comp")), "named", narrow=True)
    group = join_heavy(rows.where("n > 0").select("doc_id", "th", "n", "k1", "k2"), named, ["n", "k1", "k2"], "copies", _copies(classes))
    group = scratch.write(group.groupBy("comp", "doc_id", "th").agg(F.count(F.lit(1)).alias("times")), "group", narrow=True)
    best = group.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best"), F.count(F.lit(1)).alias("texts"))
    best = scratch.write(best.select("comp", F.col("best.doc_id").alias("d"), F.col("best.th").alias("t"), "texts"), "best", narrow=True)
    total = best.agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("n")).first()["n"]
    group = join_heavy(group, best, ["comp"], "texts", total)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    group = scratch.write(group.select("doc_id", "th", "times", same.alias("stays")).where("not stays or times > 1"), "copies", narrow=True)
    th, d, t = (fresh(x) for x in ("th", "d", "t"))
    marked = docs.withColumn(th, F.xxhash64("text"))

    def matched(left: DataFrame, part: DataFrame, how: str) -> DataFrame:
        part = part.select(F.col("doc_id").alias(d), F.col("th").alias(t))
        part = F.broadcast(part) if part.count() <= BROADCAST_IDS // 2 else part
        return left.join(part, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t)), how)

    out = matched(marked, group, "left_anti")
    again = group.where("stays")
    if again.limit(1).count():
        out = out.unionByName(matched(marked, again, "left_semi").dropDuplicates(["doc_id", th]))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, read(spark, sf_dir, "documents"))
