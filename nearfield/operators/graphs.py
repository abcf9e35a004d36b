"""Neighbour graphs as edge tables (src, dst, ord)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError, require
from ..functions.vector import squared_l2, top
from ..plans.lineage import materialise, rewritten
from .exact import RESULT, Nearest, differences, matrix, meet_each_other


def check_graph(edges: DataFrame, vertices: DataFrame | None = None) -> None:
    """Refuses an empty graph, self loops, and ends that are no vertex."""
    require(not edges.isEmpty(), "no edges", DataError)
    require(edges.filter("src = dst").isEmpty(), "a self loop", DataError)
    if vertices is not None:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
        require(ends.join(vertices.select("id"), "id", "left_anti").isEmpty(), "an unknown vertex", DataError)


#: Rows of a block of exact_graph: few where there are enough blocks for all cores, and never more than a task can hold twice.
FEW_ROWS, BLOCK_ROWS = 2048, 65_536


def blocks_of(many: int, cores: int) -> int:
    """Blocks of exact_graph, which copies each row as many times: their pairs are four tasks a core, or more where blocks would outgrow BLOCK_ROWS."""
    return max(1, -(-many // BLOCK_ROWS), min(-(-many // FEW_ROWS), int((8 * cores) ** 0.5) + 1))


def exact_graph(vectors: DataFrame, degree: int, block_rows: int | None = None) -> DataFrame:
    """``degree`` nearest other rows of each, nearest first.

    Rows are dealt to blocks by hash; each pair of blocks meets once in a task of its own, in tiles whose
    products serve both directions, and gives the nearest of its rows in both; these are merged.  A task holds
    two blocks, of ``BLOCK_ROWS`` rows at most unless ``block_rows`` are stated, so copies of a row grow with their number.
    """
    require(degree >= 1 and (block_rows is None or block_rows >= 1), "degree and block_rows must be at least 1")
    rows = vectors.filter(F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id"), "v")
    many, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    grid = blocks_of(many, cores) if block_rows is None else max(1, -(-many // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(grid)).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "id", "v")
    cell = (F.col("b") * (F.col("b") + 1) / 2).cast("int") + F.col("a")  # whole cells below b, then those beside it
    placed = cells.select(cell.alias("cell"), (F.col("block") == F.col("b")).alias("right"), (F.col("a") == F.col("b")).alias("same"), "id", "v")

    def meet(sides: list[list[tuple[np.ndarray, np.ndarray]]], same: bool) -> Iterator[pa.RecordBatch]:
        blocks = [(np.concatenate([ids for ids, _ in side]), np.concatenate([v for _, v in side])) for side in sides if side]
        if len(blocks) != (1 if same else 2):
            return
        centre = blocks[0][1].mean(0)
        near = [Nearest(v, degree, centre) for _, v in blocks]
        meet_each_other(near[0], blocks[0][0], near[-1], blocks[-1][0])
        for (ids, _), found in zip(blocks, near, strict=True):
            i, dst, scores = found.found()
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(dst), pa.array(scores)], names=["qid", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[list[tuple[np.ndarray, np.ndarray]]], bool]] = {}  # a task has one cell
        for b in batches:
            cell, right, same = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            for key in np.unique(cell).tolist():
                for side in (0, 1):
                    at = np.flatnonzero((cell == key) & (right == bool(side)))
                    if len(at):
                        own = b.take(pa.array(at))
                        held.setdefault(key, ([[], []], bool(same[at[0]])))[0][side].append((own.column(3).to_numpy(), matrix(own.column(4))))
        while held:
            yield from meet(*held.popitem()[1])

    found = top(placed.repartitionById(grid * (grid + 1) // 2, "cell").mapInArrow(run, RESULT), degree)
    return found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.col("rank").alias("ord"), "score")


def symmetrise(edges: DataFrame) -> DataFrame:
    """(src, dst) with all reverses, once each."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reciprocity(edges: DataFrame) -> DataFrame:
    """One row: share of edges whose reverse is there."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("back", F.lit(1))
    return edges.select("src", "dst").join(back, ["src", "dst"], "left").agg(F.avg(F.coalesce("back", F.lit(0))).alias("reciprocity"))


def degrees(edges: DataFrame) -> DataFrame:
    """One row: edges, vertices with edges, mean and largest out-degree."""
    return edges.groupBy("src").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("edges"), F.count("*").alias("vertices"), F.avg("n").alias("mean_degree"), F.max("n").alias("max_degree")
    )


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex that each is connected to, directions ignored.

    Labels move to neighbours and then to their labels' labels, so rounds grow with the
    logarithm of the longest chain.
    """
    both = materialise(symmetrise(edges).filter("src != dst"))
    labels = materialise(vertices.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("component").alias("m"))
        new = labels.join(near, labels.id == near.src, "left").select("id", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        moved = rewritten(new.join(jump, "c").select("id", "was", F.least("c", "cc").alias("component")))
        labels = moved.select("id", "component")
        if moved.filter("was != component").isEmpty():
            return labels


def prune(vectors: DataFrame, edges: DataFrame, degree: int, alpha: float = 1.0) -> DataFrame:
    """(src, dst, ord): at each vertex the nearest candidate, then each that no kept one covers.

    A candidate is covered where it is no farther from a kept one than 1 / alpha of its own
    distance, which a column ``score`` (squared) of the edges may bring along.  Candidates come sorted by vertex
    and distance, and a task holds the vectors that it keeps, ``degree`` at most: a vertex with very many
    candidates is never one group in memory.  The vertices of a batch take their next candidates together.
    """
    require(degree >= 1 and alpha >= 1, "degree and alpha must be at least 1")
    v = vectors.select(F.col("id").cast("long").alias("id"), "v")
    theirs = v.select(F.col("id").alias("dst"), F.col("v").alias("theirs"))
    if "score" in edges.columns:
        both = edges.groupBy("src", "dst").agg(F.min("score").alias("d")).join(theirs, "dst")
    else:
        both = edges.select("src", "dst").distinct().join(theirs, "dst").join(v.select(F.col("id").alias("src"), F.col("v").alias("own")), "src").withColumn("d", squared_l2("own", "theirs"))
    rows = both.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "d", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty((0, 0))
        for b in batches:
            if not b.num_rows:
                continue
            src, dst, d = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            x, before = matrix(b.column(3)), len(held) if src[0] == last else 0  # kept of a vertex that goes on
            every = np.concatenate((held, x)) if before else x
            starts = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
            ends, many = np.append(starts[1:], len(src)), np.zeros(len(starts), dtype=np.int64)
            slots, place = np.zeros((len(starts), degree), dtype=np.int64), np.zeros(len(src), dtype=np.int32)
            many[0], slots[0, :before] = before, np.arange(before)
            open_, nth = np.arange(len(starts)), 0
            while len(open_ := open_[(starts[open_] + nth < ends[open_]) & (many[open_] < degree)]):
                wide = int(many[open_].max())
                step = max(1, 2_000_000 // max(1, wide * x.shape[1]))
                for first in range(0, len(open_), step):
                    own = open_[first : first + step]
                    at = starts[own] + nth
                    gap = every[slots[own, :wide]] - x[at][:, None]
                    clear = (alpha * alpha * np.einsum("ijk,ijk->ij", gap, gap) > d[at][:, None]) | (np.arange(wide)[None] >= many[own][:, None])
                    own, at = own[clear.all(1)], at[clear.all(1)]
                    slots[own, many[own]] = before + at
                    many[own] += 1
                    place[at] = many[own]
                nth += 1
            last, held = src[-1], every[slots[-1, : many[-1]]]
            kept = np.flatnonzero(place)
            yield pa.RecordBatch.from_arrays([pa.array(src[kept]), pa.array(dst[kept]), pa.array(place[kept])], names=["src", "dst", "ord"])

    return rows.repartition("src").sortWithinPartitions("src", "d", "dst").mapInArrow(run, "src long, dst long, ord int")


#: How many times the neighbours asked for nn_descent keeps between its rounds.
WIDER = 2
#: nn_descent starts from the nearest rows in the cells of so many tables, whose cells have about so many rows.
TABLES, CELL_ROWS = 8, 16_384


def nn_descent(vectors: DataFrame, degree: int, rounds: int = 8, sample: int | None = None, seed: int = 0) -> DataFrame:
    """An approximate graph: neighbours of neighbours are tried until a round changes little.

    The start are the nearest rows in the cells of random directions, which all meet there.  ``sample`` bounds
    the neighbours that each vertex offers in a round, in- and outgoing each, so a vertex with very many of them
    costs no more than others; two neighbours that met in an earlier round are not tried again.  A vertex keeps
    ``WIDER`` times ``degree`` neighbours until the end: with ``degree`` only, rounds get stuck far from the nearest.
    """
    sample = degree if sample is None else sample
    require(rounds >= 1 and sample >= degree >= 1, "rounds, sample and degree")
    v = vectors.filter(F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id"), "v")
    n, pool = v.count(), WIDER * degree
    graph = materialise(_nearest(_near_in_cells(v, n, pool, seed).repartition("src").groupBy("src", "dst").agg(F.min("score").alias("score")), pool).withColumn("new", F.lit(True)))
    for r in range(rounds):
        def some(edges: DataFrame, r: int = r) -> DataFrame:
            w = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + r), "src", "dst"))
            return edges.withColumn("o", F.row_number().over(w)).filter(F.col("o") <= sample).select("src", "dst", "new")

        near = some(graph).unionAll(some(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "new"))).groupBy("src", "dst").agg(F.max("new").alias("new"))
        near = materialise(near)
        if not r:
            near = near.drop("new")  # all are
        edge = graph.groupBy("src").agg(F.when(F.count("*") == pool, F.max("score")).alias("edge"))
        scored = _tried(v, near, edge, True).unionAll(graph.select("src", "dst", "score")).groupBy("src", "dst").agg(F.min("score").alias("score"))
        known = graph.select("src", "dst", F.lit(False).alias("new"))
        new = materialise(_nearest(scored, pool).join(known, ["src", "dst"], "left").fillna(True, ["new"]))
        graph, changed = new, new.filter("new").count()
        if changed <= 0.001 * n * pool:
            break
    return graph.filter(F.col("ord") <= degree).drop("new")


def _near_in_cells(v: DataFrame, many: int, keep: int, seed: int) -> DataFrame:
    """(src, dst, score): the ``keep`` nearest other rows of each in its cell, for each of ``TABLES`` tables.

    A row's cell is the direction, of some random ones at right angles and their opposites, that it lies nearest to
    as seen from the middle of all rows; where width allows too few, a cell has several such parts.  Cells that
    come out much larger than ``CELL_ROWS`` are dealt to several by hash, so a task holds no more.
    """
    if not many:
        return v.sparkSession.createDataFrame([], "src long, dst long, score double")
    cells = -(-many // CELL_ROWS)
    tables = TABLES if cells > 1 else 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                total = total + matrix(b.column(0)).sum(0)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    middle = sum(np.array(r[0]) for r in v.select("v").mapInArrow(summed, "total array<double>").collect()) / many  # a row a task
    parts = 1
    while -(-int(np.ceil(cells ** (1 / parts))) // 2) > len(middle):
        parts += 1
    across = -(-int(np.ceil(cells ** (1 / parts))) // 2)
    draw = np.random.default_rng(seed)
    turns = [[np.linalg.qr(draw.standard_normal((len(middle), len(middle))))[0][:, :across] for _ in range(parts)] for _ in range(tables)]

    def celled(x: np.ndarray) -> np.ndarray:
        """The cell of each row in each table."""
        out = np.zeros((tables, len(x)), dtype=np.int64)
        for t in range(tables if cells > 1 else 0):
            for turn in turns[t]:
                lines = (x - middle) @ turn
                most = np.abs(lines).argmax(1)
                out[t] = out[t] * 2 * across + 2 * most + (lines[np.arange(len(x)), most] > 0)
        return out

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, own in enumerate(celled(matrix(b.column(0))) if b.num_rows else ()):
                names, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), t)), pa.array(names), pa.array(n)], names=["t", "cell", "n"])

    sizes = v.select("v").mapInArrow(counted, "t long, cell long, n long").groupBy("t", "cell").agg(F.sum("n").alias("n")).orderBy("t", "cell").collect()  # a row a cell
    first, dealt, tasks = {}, {}, 0
    for r in sizes:
        first[r.t, r.cell], dealt[r.t, r.cell] = tasks, max(1, round(r.n / CELL_ROWS))
        tasks += dealt[r.t, r.cell]

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for t, own in enumerate(celled(matrix(b.column(1))) if b.num_rows else ()):
                place = np.empty(len(own), dtype=np.int32)
                for cell in np.unique(own).tolist():
                    at = own == cell
                    place[at] = first[t, cell] + (ids[at] * 0x9E3779B1 >> 16) % dealt[t, cell]
                yield pa.RecordBatch.from_arrays([pa.array(place), b.column(0), b.column(1)], names=["task", "id", "v"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}  # a task has one cell
        for b in batches:
            task = b.column(0).to_numpy(zero_copy_only=False)
            for key in np.unique(task).tolist():
                held.setdefault(key, []).append(b.filter(pa.array(task == key)))
        while held:
            own = held.popitem()[1]
            ids, x = np.concatenate([b.column(1).to_numpy() for b in own]), np.concatenate([matrix(b.column(2)) for b in own])
            near = Nearest(x, keep)
            meet_each_other(near, ids, near, ids)
            i, dst, scores = near.found()
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(dst), pa.array(scores)], names=["src", "dst", "score"])

    rows = v.select("id", "v").mapInArrow(filed, f"task int, id long, v {dict(v.dtypes)['v']}")
    return rows.repartitionById(max(1, tasks), "task").mapInArrow(met, "src long, dst long, score double")


#: Vertices in the middle whose neighbours' vectors a task of nn_descent holds, each once.
VIAS = 32_768


def _tried(v: DataFrame, near: DataFrame, edge: DataFrame | None = None, among: bool = False) -> DataFrame:
    """(src, dst, score) of neighbours of neighbours; a pair may come by several ways.

    Vertices in the middle are dealt to tasks, with their links and each vector that one of a task's needs once,
    so the pairs are scored where they meet.  With ``edge`` (src, edge) pairs beyond a vertex's edge are left out
    there; with a column ``new`` of ``near`` pairs are left out both of whose links are not.  With ``among`` the
    neighbours that a vertex offers try each other, so one that very many have for a neighbour is no larger task.
    """
    cores, many = v.sparkSession.sparkContext.defaultParallelism, v.count()
    tasks = max(1, min(cores * -(-many // (cores * VIAS)), -(-many // 2048)))
    every = "new" not in near.columns
    offers = (near.withColumn("new", F.lit(True)) if every else near).select(F.col("src").alias("via"), F.col("dst").alias("id"), "new")
    asks = offers if among else offers.select(F.col("id").alias("via"), F.col("via").alias("id"), "new")
    asks = asks.withColumn("edge", F.lit(np.inf)) if edge is None else asks.join(edge.withColumnRenamed("src", "id"), "id", "left").fillna(np.inf, ["edge"])
    links = asks.select("via", "id", "new", "edge") if among else offers.select("via", "id", "new", F.lit(None).cast("double").alias("edge")).unionAll(asks.select("via", "id", "new", "edge"))
    if not every:
        links = links.join(links.filter("new").select("via").distinct(), "via", "left_semi")
    links = links.withColumn("task", F.pmod(F.xxhash64("via"), F.lit(tasks)).cast("int"))
    needed = links.select("task", "id").distinct().join(v.select(F.col("id").cast("long").alias("id"), "v"), "id")
    nothing = lambda x: F.lit(None).cast(x)
    held = needed.select("task", nothing("long").alias("via"), "id", nothing("boolean").alias("new"), nothing("double").alias("edge"), "v")
    rows = held.unionAll(links.select("task", "via", "id", "new", "edge", nothing(dict(v.dtypes)["v"]).alias("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, links = [], [], []
        for b in batches:
            link = b.column(1).is_valid()
            some, rest = b.filter(pc.invert(link)), b.filter(link)
            if some.num_rows:
                names.append(some.column(2).to_numpy(zero_copy_only=False))
                vectors.append(some.column(5).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1))
            if rest.num_rows:  # an offer has no edge, which is a null: not a number
                links.append([rest.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4)])
        if not links:
            return
        names, x, (via, ids, fresh, edges) = np.concatenate(names), np.concatenate(vectors), (np.concatenate(c) for c in zip(*links, strict=True))
        vectors.clear()
        by = np.argsort(names)
        order = np.lexsort((~np.isnan(edges), via))
        via, ids, fresh, edges = via[order], ids[order], fresh[order].astype(bool), edges[order]
        at = by[np.searchsorted(names, ids, sorter=by)]
        out, waiting = [], 0
        starts = np.flatnonzero(np.append(True, via[1:] != via[:-1]))
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(via)], strict=True):
            middle = a if among else a + int(np.searchsorted(~np.isnan(edges[a:z]), True))
            theirs = slice(a, z if among else middle)
            y = x[at[theirs]].astype(np.float64)
            norms, step = (y * y).sum(1), max(1, 2_000_000 // max(1, y.size))
            for first in range(middle, z, step):
                mine = slice(first, min(first + step, z))
                q = x[at[mine]].astype(np.float64)
                both = (q * q).sum(1)[:, None] + norms[None]
                far = both - 2 * (q @ y.T) - (x.shape[1] + 4) * 1e-15 * both > edges[mine, None]
                i, j = np.nonzero(~far & (ids[mine, None] != ids[None, theirs]) & (fresh[mine, None] | fresh[None, theirs]))
                scores = differences(q, y, i, j)
                kept = scores <= edges[mine][i]
                out.append((ids[mine][i[kept]], ids[theirs][j[kept]], scores[kept]))
                waiting += len(i)
                if waiting > 200_000:
                    yield together(out)
                    out, waiting = [], 0
        if out:
            yield together(out)

    def together(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["src", "dst", "score"])

    return rows.repartitionById(tasks, "task").mapInArrow(run, "src long, dst long, score double")


def _nearest(scored: DataFrame, degree: int) -> DataFrame:
    found = top(scored.select(F.col("src").alias("qid"), F.col("dst").alias("id"), "score"), degree)
    return found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.col("rank").alias("ord"), "score")


def recall_against_exact(graph: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact graph's edges that the graph has."""
    have = graph.select("src", "dst").distinct().withColumn("have", F.lit(1))
    return exact.select("src", "dst").join(have, ["src", "dst"], "left").agg(F.avg(F.coalesce("have", F.lit(0))).alias("recall"))
