"""Embedding near-dedup by NN-descent (operator 5).

Equal vectors join to one node with a multiplicity. The neighbour graph starts from vectors that are next to each other
in sorted orders of random projections and is refined by NN-descent: each node's neighbours, direct and reverse, are
compared with each other (neighbours of neighbours) and every node keeps its best. A node whose whole list lies over the
threshold is saturated and gets a list twice as long. Lists drop links only at saturated nodes, so components with a
saturated node are then compared exactly with all vectors outside them that their mean and radius leave in reach. A bounded set of audit vectors is compared with all vectors in
blocks; while the graph holds too small a share of their true links, as a mean over audit vectors with few links or over
those with many, further projections and rounds follow, and if no attempt reaches it the query fails.

Edges at or over the threshold, verified in double precision, give the components. Links are then counted exactly
within each component, without listing its pairs: vectors within half the threshold's angle of the component's mean
are all linked with each other (triangle inequality on the sphere) and are counted as one core; the others are compared
with their component in blocks of bounded size, each of which yields one count per vector.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing (n_links 0,
a component of their own, kept); vectors of different dimension don't link; rows that repeat a vec_id are nodes of the
same name; a null vec_id is its own component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import components, cut, record

THRESHOLD = 0.9
NEIGHBOURS = 8
#: Longest list of a saturated node; exact counts in components and crossed() between them take care of what longer lists would add.
NEIGHBOURS_MOST = 64
#: Least projections of an attempt, and the probability that a pair at the threshold shares all sign bits in none of them.
PROJECTIONS = 8
MISSED = 0.15
ATTEMPTS = 8
NEXT = 6
ROUNDS = 3
#: Vectors that are compared with all others to measure the recall, and the recall that is asked for.
AUDIT = 512
RECALL = 0.98
BLOCK = 256
#: Vectors of each side of a tile in the comparison of components with what is outside.
TILE = 1024


def nodes_of(table: DataFrame) -> DataFrame:
    """(id, v): usable rows with their components as bytes of float64."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.where(usable).where(fine).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("e")
            flat, at = e.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(e).to_numpy())]) if len(e) else (None, [0])
            yield record(["id", "v"], [batch.column("id"), pa.array([(flat[b:n] + 0.0).tobytes() for b, n in zip(at[:-1], at[1:], strict=True)], pa.binary())])

    return rows.mapInArrow(pack, "id long, v binary")


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension, scaled to length 1 (by their largest component first, so that no square overflows)."""
    v = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def streamed(df: DataFrame, by: list[str], order: list[str], work: Callable[[dict, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, salt: int | None = None) -> DataFrame:
    """work on each group of rows equal in by, streaming over sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            key = np.column_stack([table.column(c).to_numpy() for c in by])
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            at = [0, *new.tolist()]
            for b, e in zip(at[:-1], at[1:], strict=True):
                yield from work(None, table.slice(b, e - b))
            held = table.slice(at[-1])
        if held is not None:
            yield from work(None, held)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def projected(nodes: DataFrame, dims: int, seed: int, n: int, bits: int, ahead: int = NEXT) -> DataFrame:
    """(a, b, s): vectors next to each other in the order of random sign patterns, then of one more projection."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        planes = rng.standard_normal((n, bits + 1, dims))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(batch.column("v"))
            for t in range(n):
                p = x @ planes[t].T
                sign = (p[:, :bits] > 0) @ (1 << np.arange(bits))
                yield record(["t", "k", "id", "v"], [np.full(len(x), t, np.int32), sign + (p[:, bits] + 1.0).clip(0, 2) / 2.001, batch.column("id"), batch.column("v")])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            ids, t, x = table.column("id").to_numpy(), table.column("t").to_numpy(), units(table.column("v").combine_chunks())
            for step in range(1, ahead + 1):
                a, b = np.arange(len(ids) - step), np.arange(step, len(ids))
                same = (t[a] == t[b]) & (ids[a] != ids[b])
                a, b = a[same], b[same]
                s = np.einsum("ij,ij->i", x[a], x[b]).astype(np.float32)
                yield record(["a", "b", "s"], [ids[a], ids[b], s])
                yield record(["a", "b", "s"], [ids[b], ids[a], s])
            held = table.slice(max(0, table.num_rows - ahead))

    keyed = nodes.mapInArrow(keys, "t int, k double, id long, v binary")
    return keyed.repartitionByRange("t", "k", "id").sortWithinPartitions("t", "k", "id").mapInArrow(near, "a long, b long, s float")


def best(edges: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """(a, list, width): every node's best distinct neighbours, as (s, b); saturated lists are twice as long."""
    local = edges.groupBy("a", "b").agg(F.max("s").alias("s"))
    if widths is not None:
        local = local.join(widths.select("a", "width"), "a", "left")
    width = F.coalesce(F.max("width"), F.lit(NEIGHBOURS)) if widths is not None else F.lit(NEIGHBOURS)
    lists = local.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("s", "b")), asc=False).alias("list"), width.alias("width"))
    full = (F.size("list") >= F.col("width")) & (F.element_at("list", F.least(F.size("list"), F.col("width")))["s"] >= THRESHOLD)
    wider = F.when(full, F.least(F.col("width") * 2, F.lit(NEIGHBOURS_MOST))).otherwise(F.col("width"))
    return lists.select("a", F.slice("list", F.lit(1), wider).alias("list"), wider.alias("width"))


def descended(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph after one round: members of each node's neighbourhood compared with each other."""
    direct = graph.select("a", F.explode("list").alias("e"), "width").select("a", F.col("e.b").alias("b"), F.col("e.s").alias("s"), "width")
    spread = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30))
    reverse = direct.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct(spread.alias("r"), "a"))), 1, 2 * NEIGHBOURS).alias("l"))
    reverse = reverse.select(F.col("b").alias("u"), F.explode("l.a").alias("m"))
    members = direct.select(F.col("a").alias("u"), F.col("b").alias("m")).unionByName(reverse).unionByName(graph.select(F.col("a").alias("u"), F.col("a").alias("m"))).distinct()
    rows = members.join(nodes.withColumnRenamed("id", "m"), "m")

    def compare(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("m").to_numpy()
        if len(ids) < 2:
            return
        x = units(table.column("v").combine_chunks()).astype(np.float32)
        s = x @ x.T
        s[ids[:, None] == ids[None, :]] = -2
        top = min(4, len(ids) - 1)
        b = np.argpartition(-s, top - 1, axis=1)[:, :top]
        a = np.repeat(np.arange(len(ids)), top)
        s = s[a, b.ravel()]
        ok = s > -2
        yield record(["a", "b", "s"], [ids[a[ok]], ids[b.ravel()[ok]], s[ok]])

    found = streamed(rows.select("u", "m", "v"), ["u"], ["m"], compare, "a long, b long, s float")
    return cut(best(found.unionByName(direct.select("a", "b", "s")), graph))


def linked(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) whose cosine in double precision is at least threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = np.einsum("ij,ij->i", units(batch.column("v_a")), units(batch.column("v_b"))) >= threshold
                yield record(["a", "b"], [batch.column(c).to_numpy()[ok] for c in ("a", "b")])

    rows = pairs.join(nodes.select(F.col("id").alias("a"), F.col("v").alias("v_a")), "a").join(nodes.select(F.col("id").alias("b"), F.col("v").alias("v_b")), "b")
    return rows.select("a", "b", "v_a", "v_b").mapInArrow(verify, "a long, b long")


def audited(nodes: DataFrame, size: int, threshold: float, total: int) -> DataFrame:
    """(a, b): true links of about size audit vectors with all vectors, in blocks."""
    sample = nodes.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / max(1, total)))).collect()
    ids = np.array([r["id"] for r in sample], dtype=np.int64)
    held = units(pa.array([bytes(r["v"]) for r in sample], pa.binary())) if sample else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or held is None:
                continue
            own, x = batch.column("id").to_numpy(), units(batch.column("v"))
            for i in range(0, len(own), 1024):
                a, b = np.nonzero(held @ x[i : i + 1024].T >= threshold)
                ok = ids[a] != own[i + b]
                yield record(["a", "b"], [ids[a][ok], own[i + b][ok]])

    return nodes.mapInArrow(compare, "a long, b long")


def centres(members: DataFrame) -> DataFrame:
    """(root, mean): sum of the unit vectors of each component of members (root, v)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                root, x = batch.column("root").to_numpy(), units(batch.column("v"))
                own, back = np.unique(root, return_inverse=True)
                total = np.zeros((len(own), x.shape[1]))
                np.add.at(total, back, x)
                dims = x.shape[1]
                yield record(["root", "d", "s"], [np.repeat(own, dims), np.tile(np.arange(dims, dtype=np.int32), len(own)), total.ravel()])

    return members.mapInArrow(sums, "root long, d int, s double").groupBy("root", "d").agg(F.sum("s").alias("s")).groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("mean"))


def tiled(queries: DataFrame, base: DataFrame, work: Callable[[dict, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work on all pairs of rows (g, id, own, r, v) of queries (side 1) and base (side 0) with equal g, in tiles."""
    blocks = lambda df, name: df.groupBy("g").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    sizes = cut(blocks(queries, "qs").join(blocks(base, "bs"), "g"))
    return _tiles(queries.join(sizes, "g"), base.join(sizes, "g"), F.col("qs"), F.col("bs"), work, schema)


def tiled_whole(queries: DataFrame, base: DataFrame, work: Callable[[dict, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """tiled() where g is the same in all rows; the numbers of blocks are counted first, so no row is joined for them."""
    qs, bs = (F.lit(max(1, -(-df.count() // TILE))) for df in (queries, base))
    return _tiles(queries, base, qs, bs, work, schema)


def _tiles(queries: DataFrame, base: DataFrame, qs: F.Column, bs: F.Column, work: Callable[[dict, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    q = queries.select("g", block(qs).alias("qb"), every(bs).alias("bb"), F.lit(1).alias("side"), "id", "own", "r", "v")
    b = base.select("g", every(qs).alias("qb"), block(bs).alias("bb"), F.lit(0).alias("side"), "id", "own", "r", "v")
    return streamed(q.unionByName(b), ["g", "qb", "bb"], ["side", "id"], work, schema)


def crossed(nodes: DataFrame, roots: DataFrame, saturated: DataFrame, threshold: float) -> DataFrame:
    """(a, b): for every vector and every component with a saturated node that it is not in, its closest link to it, if any."""
    own = cut(nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "v"))
    members = cut(own.join(own.join(saturated, "id").select("root").distinct(), "root").select("root", "id", "v"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, c = units(batch.column("v")), batch.column("mean").flatten().to_numpy().reshape(batch.num_rows, -1)
                cos = np.einsum("ij,ij->i", x, c) / np.maximum(np.linalg.norm(c, axis=1), 1e-300)
                yield record(["root", "r"], [batch.column("root"), np.arccos(np.clip(cos, -1, 1))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = batch.column("mean").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield record(["root", "r", "v"], [batch.column("root"), batch.column("r"), pa.array([x.tobytes() for x in c], pa.binary())])

    means = cut(centres(members))
    radii = members.join(means, "root").select("root", "v", "mean").mapInArrow(spread, "root long, r double").groupBy("root").agg(F.max("r").alias("r"))
    balls = cut(means.join(radii, "root").mapInArrow(pack, "root long, r double, v binary"))

    def reach(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
        side = table.column("side").to_numpy()
        if side.min() == side.max():
            return
        q, b = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        v, ids, root, r = table.column("v").combine_chunks(), table.column("id").to_numpy(), table.column("own").to_numpy(), table.column("r").to_numpy()
        x, c = units(v.take(pa.array(q))), np.frombuffer(b"".join(v.take(pa.array(b)).to_pylist()), dtype=np.float64).reshape(len(b), -1)
        angle = np.arccos(np.clip(x @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)).T, -1, 1))
        i, j = np.nonzero((angle <= r[b] + math.acos(threshold) + 1e-6) & (root[q][:, None] != root[b][None, :]))
        yield record(["g", "id"], [root[b][j], ids[q][i]])

    def closest(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
        side = table.column("side").to_numpy()
        if side.min() == side.max():
            return
        x, ids = units(table.column("v").combine_chunks()), table.column("id").to_numpy()
        q, b = side == 1, side == 0
        s = x[q] @ x[b].T
        top = s.argmax(axis=1)
        ok = s[np.arange(len(s)), top] >= threshold
        yield record(["a", "b"], [ids[q][ok], ids[b][top[ok]]])

    row = lambda df, g, own, r: df.select(F.col(g).alias("g") if g else F.lit(0).cast("long").alias("g"), "id", F.col(own).alias("own"), r.cast("double").alias("r"), "v")
    near = cut(tiled_whole(row(own, None, "root", F.lit(0)), row(balls.withColumn("id", F.col("root")), None, "root", F.col("r")), reach, "g long, id long"))
    outside = cut(row(near.join(nodes, "id"), "g", "g", F.lit(0)))
    return cut(tiled(outside, row(members, "root", "root", F.lit(0)), closest, "a long, b long"))


def projections(bits: int, threshold: float) -> int:
    """Projections of so many sign bits that keep the probability of MISSED."""
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return max(PROJECTIONS, math.ceil(math.log(MISSED) / math.log1p(-together)))


def found_share(truth: DataFrame, roots: DataFrame) -> float:
    """Mean share of found links (a, b) of an audit vector a, among those with up to NEIGHBOURS links or the others, whichever is less."""
    # a true link counts as found if both ends are in one component, where all links are counted exactly
    sides = truth.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    each = sides.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("ra") == F.col("rb")).alias("hit"))
    means = each.groupBy(F.col("n") > NEIGHBOURS).agg(F.avg(F.col("hit") / F.col("n")).alias("share")).collect()
    return min((r["share"] for r in means), default=1.0)


def neighbour_graph(nodes: DataFrame, dims: int, total: int, threshold: float) -> tuple[DataFrame, float]:
    """Components (node, root) of the edges at or over the threshold, and the audit's recall, see found_share()."""
    truth = cut(audited(nodes, AUDIT, threshold, total))
    bits = max(1, min(24, int(math.log2(max(2, total))) - 3))
    graph, widths, recall = None, None, 0.0
    for attempt in range(ATTEMPTS):
        fresh = projected(nodes, dims, 17 + attempt, projections(bits, threshold), bits)
        if graph is not None:
            fresh = fresh.unionByName(graph.select("a", F.explode("list").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.s").alias("s")))
        graph = cut(best(fresh, widths))
        for _ in range(ROUNDS):
            graph = descended(graph, nodes)
        widths = graph
        close = graph.select("a", F.explode("list").alias("e")).where(F.col("e.s") >= threshold - 1e-3).select(F.least("a", "e.b").alias("a"), F.greatest("a", "e.b").alias("b")).distinct()
        edges = cut(linked(close, nodes, threshold))
        roots = components(edges)
        across = crossed(nodes, roots, graph.where(F.col("width") > NEIGHBOURS).select(F.col("a").alias("id")), threshold)
        if not across.isEmpty():
            edges = cut(edges.unionByName(across))
            roots = components(edges)
        recall = found_share(truth, roots)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"the audit's recall is {recall:.4f} after {ATTEMPTS} attempts, less than {RECALL}")
    # links of the audit that were not found are links all the same
    return (roots if recall == 1.0 else components(edges.unionByName(truth))), recall


def counted(members: DataFrame, threshold: float) -> DataFrame:
    """(id, n): number of vectors (by multiplicity) that each member (root, id, m, v) of a component is linked to, itself included m times."""

    means = centres(members)
    inner = math.sqrt((1 + threshold) / 2) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, c = units(batch.column("v")), batch.column("mean").flatten().to_numpy().reshape(batch.num_rows, -1)
                cos = np.einsum("ij,ij->i", x, c) / np.maximum(np.linalg.norm(c, axis=1), 1e-300)
                yield record(["root", "id", "m", "v", "core"], [*(batch.column(n) for n in ("root", "id", "m", "v")), cos >= inner])

    placed = cut(members.join(means, "root").select("root", "id", "m", "v", "mean").mapInArrow(place, "root long, id long, m long, v binary, core boolean"))
    sizes = placed.groupBy("root").agg(F.sum(F.when(F.col("core"), F.col("m")).otherwise(0)).alias("core_m"), F.count("*").alias("n"), F.count_if(~F.col("core")).alias("q"))
    with_core = placed.join(sizes, "root").where("core").select("id", F.col("core_m").alias("n"))
    split = placed.join(sizes.where("q > 0").select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("bs"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qs")), "root")
    mine = F.xxhash64("id")
    queries = split.where("NOT core").select("root", F.pmod(mine, F.col("qs")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("bs") - 1)).alias("bb"), F.lit(1).alias("side"), "id", "m", "v", "core")
    base = split.select("root", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), F.pmod(mine, F.col("bs")).cast("int").alias("bb"), F.lit(0).alias("side"), "id", "m", "v", "core")

    def tile(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, core = table.column("side").to_numpy(), table.column("core").to_numpy(zero_copy_only=False)
        if side.min() == side.max():
            return
        x, ids, m = units(table.column("v").combine_chunks()), table.column("id").to_numpy(), table.column("m").to_numpy()
        q, b = side == 1, side == 0
        hit = x[q] @ x[b].T >= threshold
        hit |= ids[q][:, None] == ids[b][None, :]
        own = b & core
        yield record(["id", "n"], [np.concatenate([ids[q], ids[own]]), np.concatenate([hit @ m[b], (hit.T @ m[q])[core[b]]]).astype(np.int64)])

    tiles = streamed(queries.unionByName(base), ["root", "qb", "bb"], ["side", "id"], tile, "id long, n long")
    return with_core.unionByName(tiles).groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) of every row of table, and the audit's recall."""
    usable = cut(nodes_of(table))
    nodes = cut(usable.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("m")))
    roots, recall = None, 1.0
    widths = sorted(r[0] for r in nodes.select(F.length("v")).distinct().collect())
    for width in widths:  # one pass for each dimension
        own = nodes.where(F.length("v") == width).select("id", "v")
        total = own.count()
        if total > 1:
            found, r = neighbour_graph(own, width // 8, total, threshold)
            roots, recall = found if roots is None else roots.unionByName(found), min(recall, r)
    named = usable.join(nodes.withColumnRenamed("id", "rep"), "v").select("id", "rep", "m")
    if roots is None:
        out = named.select("id", (F.col("m") - 1).alias("n"), F.col("rep").alias("root"))
    else:
        members = roots.withColumnRenamed("node", "id").join(nodes, "id").select("root", "id", "m", "v")
        counts = reduce(DataFrame.unionByName, [counted(members.where(F.length("v") == w), threshold) for w in widths])
        per = roots.withColumnRenamed("node", "rep").join(counts.withColumnRenamed("id", "rep"), "rep")
        out = named.join(per, "rep", "left").select("id", (F.coalesce("n", "m") - 1).alias("n"), F.coalesce("root", "rep").alias("root"))
    out = out.groupBy("id").agg(F.max("n").alias("n"), F.min("root").alias("root"))
    rows = table.select("vec_id", F.col("vec_id").cast("long").alias("id")).join(out, "id", "left")
    root = F.coalesce("root", "vec_id")
    return rows.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept")), recall


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))[0]
