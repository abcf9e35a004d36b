"""Graphs, forests and trees as tables: walks are joins in supersteps, leaves are keys.

``EdgeGraph`` holds (src, block, near) rows, ``LeafForest`` the thresholds of its nodes, and
``BoxTree`` a table of leaves with their boxes.  None keeps a structure in memory; each step is
a DataFrame job over all queries at once, so a search over n rows never needs them in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BuildError, ConfigError, require
from ..functions.vector import doubles, dot, squared_l2, top
from ..plans.lineage import materialise, rewritten
from .exact import MET, RESULT, TILE_QUERIES, TILE_ROWS, Nearest, in_blocks, keyed_blocks, matrix, scan_keyed, top_up, with_met
from .graphs import exact_graph, prune, symmetrise
from .index import Found, Index, stats_row

#: Neighbours in a row of an edge table, and queries at a vertex in a round before its edges are broadcast.
BLOCK, CROWD = 64, 10_000
#: Nodes of one level that are broadcast at most; more are joined by shuffle.
NODES = 100_000
#: What each query has seen on its walk, and the vertices that it opens next.
STATE = "qid long, ids array<long>, scores array<double>, opened array<boolean>, dead array<boolean>, taken array<long>"
#: Rows of a node of boxes whose splits are found in one task.
SUBTREE = 16_384


class EdgeGraph(Index):
    """A neighbour graph as an edge table, walked best first by all queries at once.

    A round takes the ``at_once`` best open vertices of each query, joins them with their edges,
    scores what the query has not seen, and closes queries whose best open vertex is worse than
    the worst of the ``ef`` best.  With at_once = 1 that is the walk of a single query with two
    heaps; more needs fewer rounds and some more distances.  Vertices with very many neighbours
    take several rows, and edges of vertices that very many queries open in a round are broadcast.
    """

    name = "edges"

    def __init__(self, dimension: int, degree: int = 16, build_degree: int = 32, ef: int = 32, alpha: float = 1.0, entry: str = "medoid", at_once: int = 4):
        super().__init__(dimension, "l2")
        require(1 <= degree <= build_degree and min(ef, at_once) >= 1 and alpha >= 1, "degree, build_degree, ef, at_once and alpha")
        require(entry in ("medoid", "first"), f"entry {entry!r}")
        self.degree, self.build_degree, self.ef, self.alpha, self.entry_rule, self.at_once = degree, build_degree, ef, alpha, entry, at_once
        self.edges: DataFrame | None = None
        self.version = 0

    def build(self, vectors: DataFrame, edges: DataFrame | None = None) -> EdgeGraph:
        """Symmetrised nearest neighbours pruned for diversity, or the given (src, dst)."""
        self._count = self.check_vectors(vectors)
        if edges is None and self._count <= self.build_degree:
            raise BuildError(f"{self._count} rows cannot fill a build degree of {self.build_degree}")
        self.rows, self.dead, self.version = vectors.select(F.col("id").cast("long").alias("id"), "v"), None, 0
        if edges is None:
            edges = prune(self.rows, materialise(symmetrise(exact_graph(self.rows, self.build_degree))), self.degree, self.alpha)
        self.edges = self._filed(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
        if self.entry_rule == "first":
            self.entry = self.rows.agg(F.min("id")).first()[0]
        else:
            mean = np.array(self.rows.select(F.posexplode(doubles("v")).alias("dim", "x")).groupBy("dim").agg(F.avg("x")).orderBy("dim").toPandas().iloc[:, 1])
            centre = F.array(*[F.lit(float(x)) for x in mean])
            gap = F.aggregate(F.zip_with(doubles("v"), centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
            self.entry = self.rows.agg(F.min_by("id", F.struct(gap, "id"))).first()[0]
        return self

    def _filed(self, edges: DataFrame) -> DataFrame:
        """(src, near, version): neighbours in rows of BLOCK at most."""
        w = Window.partitionBy("src").orderBy("dst")
        placed = edges.distinct().withColumn("block", F.floor((F.row_number().over(w) - 1) / BLOCK))
        return materialise(placed.groupBy("src", "block").agg(F.sort_array(F.collect_list("dst")).alias("near")).select("src", "near", F.lit(self.version).alias("version")))

    def pairs(self) -> DataFrame:
        """(src, dst) of all edges."""
        self.require_built()
        return self.edges.select("src", F.explode("near").alias("dst")).distinct()

    def _taken(self, state: DataFrame, fresh: DataFrame, width: int) -> DataFrame:
        """STATE with the fresh (qid, x: id, score, dead) that it has not seen, and ``taken``, the vertices that each query opens next, marked as opened.

        What a query has seen is kept by score and id; each is sorted for itself.
        """
        own = fresh.groupBy("qid").agg(F.collect_list("x").alias("x"))  # of one query's vertices
        rows = state.join(own, "qid", "left").select("qid", "ids", "scores", "opened", "dead", F.col("x.id").alias("a"), F.col("x.score").alias("b"), F.col("x.dead").alias("c"))
        at_once = self.at_once

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in batch.columns[1:]]
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for row in range(batch.num_rows):
                    ids, scores, opened, dead, new, far, gone = (x[o[row] : o[row + 1]] for o, x in lists)
                    some = ~np.isin(new, ids)
                    ids, scores = np.concatenate((ids, new[some])), np.concatenate((scores, far[some]))
                    order = np.lexsort((ids, scores))
                    ids, scores = ids[order], scores[order]
                    opened = np.concatenate((opened, np.zeros(some.sum(), dtype=bool)))[order].astype(bool)
                    dead = np.concatenate((dead, gone[some]))[order].astype(bool)
                    living = scores[~dead]
                    open_ = ~opened if len(living) < width else ~opened & (scores <= living[width - 1])
                    take = np.flatnonzero(open_)[:at_once]
                    opened[take] = True
                    for held, x in zip(out, (ids, scores, opened, dead, ids[take]), strict=True):
                        held.append(x)
                kinds = (pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64())
                made = [
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held) if held else np.empty(0), kind))
                    for held, kind in zip(out, kinds, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["qid", "ids", "scores", "opened", "dead", "taken"])

        return rows.mapInArrow(run, STATE)

    def walk(self, queries: DataFrame, width: int) -> DataFrame:
        """(qid, id, score, opened, dead): every vertex that each query's walk scores."""
        self.require_built()
        return in_blocks(queries.select("qid", "q"), lambda block: self._walked(block, width))

    def _walked(self, queries: DataFrame, width: int) -> DataFrame:
        """The same for queries that can be broadcast.

        A round moves pairs of ids, and vectors only to be scored where the queries are; a query whose walk is
        over stays in the files of its last round.
        """
        points = self.rows.withColumn("dead", F.lit(False))
        if self.dead is not None:
            points = self.rows.join(self.dead.select("id", F.lit(True).alias("dead")), "id", "left").fillna(False, ["dead"])
            points = materialise(points)
        links = self.edges.select("src", "near")
        asked = F.broadcast(queries)
        met = lambda pairs: pairs.join(points, "id").join(asked, "qid").select("qid", F.struct("id", squared_l2("q", "v").alias("score"), "dead").alias("x"))
        nothing = (F.array().cast(f"array<{kind}>").alias(name) for name, kind in (("ids", "long"), ("scores", "double"), ("opened", "boolean"), ("dead", "boolean")))
        start = met(queries.select("qid", F.lit(self.entry).cast("long").alias("id")))
        state, over = rewritten(self._taken(queries.select("qid", *nothing), start, width)), None
        crowded = queries.count() * self.at_once > CROWD
        while True:
            ended, state = state.filter(F.size("taken") == 0), state.filter(F.size("taken") > 0)
            over = ended if over is None else over.unionAll(ended)
            if state.isEmpty():
                break
            front = state.select("qid", F.explode("taken").alias("src"))
            if crowded:  # edges of the vertices that very many open, (rows of front / CROWD) at most, go to the queries
                crowd = F.broadcast(front.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("src"))
                hops = front.join(crowd, "src", "left_anti").join(links, "src").unionByName(front.join(F.broadcast(links.join(crowd, "src")), "src"))
            else:
                hops = front.join(links, "src")
            reached = hops.select("qid", F.explode("near").alias("id")).dropDuplicates(["qid", "id"])
            state = rewritten(self._taken(state, met(reached), width))
        return over.select("qid", F.explode(F.arrays_zip("ids", "scores", "opened", "dead")).alias("x")).select(
            "qid", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"), "x.opened", "x.dead"
        )

    def visited(self, queries: DataFrame, ef: int | None = None) -> DataFrame:
        """(qid, id) of every vertex that a walk touches."""
        return self.walk(queries, self.ef if ef is None else ef).select("qid", "id")

    def search(self, queries: DataFrame, k: int = 10, ef: int | None = None) -> Found:
        n = self.check_queries(queries, k)
        width = self.ef if ef is None else ef
        if width < max(k, 1):
            raise ConfigError(f"a beam of {width} cannot return {k} rows")
        seen = self.walk(queries, width)
        living = seen.filter("not dead")
        cost = seen.agg(F.count("*").cast("double").alias("distances"), F.count("*").alias("candidates"), F.count_if("opened").alias("hops"), F.lit(n).cast("long").alias("queries"))
        return Found(top_up(top(living.select("qid", "id", "score"), k), queries, self.live(), k), cost)

    def _append(self, vectors: DataFrame) -> None:
        """New rows search the graph as it stands; edges to what they find go in both ways, under a new version."""
        new = vectors.select(F.col("id").cast("long").alias("qid"), F.col("v").alias("q"))
        k = min(self.degree, self.size)
        found = materialise(self.search(new, k, max(self.ef, k)).result.select("qid", "id"))
        super()._append(vectors.select(F.col("id").cast("long").alias("id"), "v"))
        self.version += 1
        both = found.select(F.col("qid").alias("src"), F.col("id").alias("dst")).unionAll(found.select(F.col("id").alias("src"), F.col("qid").alias("dst")))
        self.edges = self.edges.unionByName(self._filed(both))

    def structure_bytes(self) -> int:
        self.require_built()
        return 8 * self.edges.agg(F.sum(F.size("near") + 1)).first()[0]


def _grown(index, made: DataFrame) -> bool:
    """Adds a level's splits; False if there are none.  The keys of nodes bear their level, so all splits are one table.

    Few splits are broadcast, once for all levels of a job; more are joined by shuffle.
    """
    made = rewritten(made)
    if made.isEmpty():
        return False
    every = made if index.splits is None else rewritten(index.splits.unionByName(made))
    index.splits = F.broadcast(every) if every.count() <= NODES else every
    index.levels += 1
    return True


def _medians(own: DataFrame, accuracy: int) -> DataFrame:
    """(node, n, threshold, most) of rows (node, p): the exact lower median and the largest p of each node.

    A sketch brackets the median; what lies in the bracket, a few of ``accuracy`` parts of a node, is
    counted by value.  Merged sketches are exact while twice their error stays below a row, so only
    nodes of up to ``accuracy`` / 4 rows are left to them.
    """
    exact = accuracy // 4
    edges = F.percentile_approx("p", F.array(F.lit(max(0.0, 0.5 - 4 / accuracy)), F.lit(0.5), F.lit(min(1.0, 0.5 + 4 / accuracy))), F.lit(accuracy))
    nodes = materialise(own.groupBy("node").agg(F.count("*").alias("n"), edges.alias("e"), F.max("p").alias("most")))
    wide = nodes.filter(F.col("n") > exact).select("node", "n", F.col("e")[0].alias("low"), F.col("e")[2].alias("high"), "most")
    sketched = nodes.filter(F.col("n") <= exact).select("node", "n", F.col("e")[1].alias("threshold"), "most")
    if wide.isEmpty():
        return sketched

    def counted(wide: DataFrame) -> DataFrame:
        met = own.join(F.broadcast(wide) if wide.count() <= NODES else wide, "node").filter(F.col("p") <= F.col("high"))
        value = F.when(F.col("p") >= F.col("low"), F.col("p"))  # null: below the bracket
        by = met.groupBy("node", value.alias("x")).agg(F.count("*").alias("c"))
        w = Window.partitionBy("node").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        placed = by.withColumn("upto", F.sum("c").over(w)).join(wide, "node")
        target = F.ceil(F.col("n") / 2)
        hit = placed.filter((F.col("upto") >= target) & (F.col("upto") - F.col("c") < target) & F.col("x").isNotNull())
        return hit.select("node", "n", F.col("x").alias("threshold"), "most")

    found = materialise(counted(wide))
    missed = materialise(wide.join(found, "node", "left_anti"))
    if not missed.isEmpty():  # a sketch that was farther off than it says
        every = missed.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
        found = found.unionByName(counted(every))
    return sketched.unionByName(found)


class LeafForest(Index):
    """Random projections, level by level for all trees at once; a row's leaf is a key.

    Each level of a tree has one direction.  Nodes of more than ``leaf_size`` rows are split at
    the exact median of their rows' projections (bracketed by a sketch of ``accuracy``) or at
    the middle of their range.  What stays is (key, threshold, level) for each split; the key of a
    leaf is 1 and a bit a level, and bears the tree in its upper bits.  A query's leaves are found
    the same way, and rows that share one of them are scored in the scan, each once a query.
    """

    name = "leaves"

    def __init__(self, dimension: int, trees: int = 8, leaf_size: int = 64, split_on: str = "median", seed: int = 0, directions: np.ndarray | None = None, accuracy: int = 10_000):
        super().__init__(dimension, "l2")
        require(1 <= trees <= 128 and leaf_size >= 1, "trees and leaf_size")
        require(split_on in ("median", "midpoint"), f"split_on {split_on!r}")
        self.trees, self.leaf_size, self.split_on, self.accuracy = trees, leaf_size, split_on, accuracy
        if directions is None:
            directions = np.random.default_rng(seed).standard_normal((trees, 50, dimension))
            directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        self.directions = directions  # [tree, level, dimension]
        self.splits: DataFrame | None = None
        self.levels = 0

    def _projected(self, rows: DataFrame, ids: str, column: str, depth: int) -> DataFrame:
        """(ids, tree, node, line): a row for each tree, with its projections by level."""
        lines = lambda t: F.array(*[dot(column, F.array(*[F.lit(float(x)) for x in d])) for d in self.directions[t, :depth]])
        each = F.array(*[F.struct(F.lit(t << 56 | 1).cast("long").alias("node"), lines(t).alias("line")) for t in range(self.trees)])
        return rows.select(ids, column, F.explode(each).alias("e")).select(ids, column, "e.node", "e.line")

    @staticmethod
    def _child(node: Column, right: Column) -> Column:
        """A node's child: the tree in the upper 8 bits stays."""
        tree = F.shiftleft(F.shiftright(node, 56), 56)
        return tree + F.shiftleft(node - tree, 1) + right.cast("long")

    def _descended(self, rows: DataFrame) -> DataFrame:
        """rows (node, line) at the nodes that the splits so far lead to."""
        for level in range(self.levels):
            met = rows.join(self.splits, "node", "left")
            right = F.get(F.col("line"), F.lit(level)) > F.col("threshold")
            stays = F.col("threshold").isNull() | (F.col("level") != level)
            rows = met.withColumn("node", F.when(stays, F.col("node")).otherwise(self._child(F.col("node"), right))).drop("threshold", "level")
        return rows

    def build(self, vectors: DataFrame) -> LeafForest:
        self._count = self.check_vectors(vectors)
        if self._count <= self.leaf_size:
            raise BuildError(f"{self._count} rows fit one leaf of {self.leaf_size}")
        self.rows, self.dead, self.splits, self.levels = vectors.select(F.col("id").cast("long").alias("id"), "v"), None, None, 0
        for level in range(self.directions.shape[1]):
            own = self._descended(self._projected(self.rows, "id", "v", level + 1)).select("node", F.get(F.col("line"), F.lit(level)).alias("p"))
            if self.split_on == "median":
                nodes = _medians(own, self.accuracy)
            else:
                nodes = own.groupBy("node").agg(F.count("*").alias("n"), ((F.min("p") + F.max("p")) / 2).alias("threshold"), F.max("p").alias("most"))
            made = nodes.filter((F.col("n") > self.leaf_size) & (F.col("threshold") < F.col("most"))).select("node", F.lit(level).alias("level"), "threshold")
            if not _grown(self, made):
                break
        return self

    def leaves(self, vectors: DataFrame | None = None, ids: str = "id", column: str = "v") -> DataFrame:
        """(ids, leaf, column): each row once a tree."""
        rows = self.live() if vectors is None else vectors
        return self._descended(self._projected(rows, ids, column, max(1, self.levels))).select(ids, F.col("node").alias("leaf"), column)

    def leaf_sizes(self) -> DataFrame:
        """(tree, leaf, n)."""
        return self.leaves().groupBy("leaf").agg(F.count("*").alias("n")).select(F.shiftright("leaf", 56).alias("tree"), "leaf", "n")

    def depth(self) -> int:
        return self.levels

    def search(self, queries: DataFrame, k: int = 10, trees: int | None = None) -> Found:
        n = self.check_queries(queries, k)
        trees = self.trees if trees is None else trees
        require(1 <= trees <= self.trees, f"{trees} of {self.trees} trees")
        mine = lambda rows: rows.filter(F.shiftright("leaf", 56) < trees)
        rows, spark = mine(self.leaves()).select("leaf", "id", "v"), queries.sparkSession
        homes = materialise(mine(self.leaves(queries, "qid", "q")))
        found = None
        asked = homes.groupBy("qid").agg(F.first("q").alias("q"), F.collect_list("leaf").alias("keys"))  # a leaf a tree
        for qids, q, keys in keyed_blocks(asked):
            opened = {int(leaf): np.flatnonzero((keys == leaf).any(1)) for leaf in np.unique(keys)}
            shared = spark.sparkContext.broadcast((qids, q, opened))
            part = scan_keyed(rows, shared, k * trees, "l2", False).select("qid", "id", "score")
            found = part if found is None else found.unionAll(part)
        found = spark.createDataFrame([], RESULT) if found is None else found.groupBy("qid", "id").agg(F.first("score").alias("score"))
        met, sizes = homes.groupBy("leaf").agg(F.count("*").alias("asked")), rows.groupBy("leaf").agg(F.count("*").alias("size"))
        cost = met.join(sizes, "leaf").agg(F.coalesce(F.sum(F.col("asked") * F.col("size")), F.lit(0)).alias("candidates")).select(
            F.col("candidates").cast("double").alias("distances"), "candidates", F.lit(n * trees).cast("long").alias("hops"), F.lit(n).cast("long").alias("queries")
        )
        return Found(top(found, k), cost)

    def insert(self, vectors: DataFrame) -> int:
        """New rows fall into the leaves that the splits lead them to; nothing is rebuilt."""
        return super().insert(vectors)


class BoxTree(Index):
    """An exact kd-tree as a table of leaves: (leaf, ids, vs), neighbours side by side.

    Nodes are split level by level at the median of their widest axis, and those of ``SUBTREE`` rows or
    fewer down to their leaves in one task.  A search takes each query's home leaf first, which gives a k-th
    distance, and then scans the table once: leaves meet queries in tiles, of the queries for which the box of
    a tile, or of a leaf, is no farther than that.
    """

    name = "boxes"

    def __init__(self, dimension: int, leaf_size: int = 16, metric: str = "l2", accuracy: int = 10_000):
        super().__init__(dimension, metric)
        if not self.metric.is_a_metric:
            raise ConfigError(f"{self.name} needs l2, not {self.metric.name}")
        require(leaf_size >= 1, "leaf_size must be at least 1")
        self.leaf_size, self.accuracy = leaf_size, accuracy
        self.splits: DataFrame | None = None
        self.levels = 0

    def _descended(self, rows: DataFrame, column: str) -> DataFrame:
        rows = rows.withColumn("node", F.lit(1).cast("long"))
        for _ in range(self.levels):
            met = rows.join(self.splits, "node", "left")
            right = F.get(F.col(column), F.col("axis")).cast("double") > F.col("threshold")
            rows = met.withColumn("node", F.when(F.col("threshold").isNull(), F.col("node")).otherwise(F.shiftleft("node", 1) + right.cast("long"))).drop("axis", "threshold")
        return rows

    @staticmethod
    def _boxes(rows: DataFrame) -> DataFrame:
        """(node, dim, low, high): tasks return a box a node."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                node, v = b.column(0).to_numpy(), matrix(b.column(1))
                order = np.argsort(node, kind="stable")
                names, first = np.unique(node[order], return_index=True)
                low, high = (f.reduceat(v[order], first, axis=0) for f in (np.minimum, np.maximum))
                many, wide = low.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, wide)), pa.array(np.tile(np.arange(wide, dtype=np.int32), many)), pa.array(low.reshape(-1)), pa.array(high.reshape(-1))], names=["node", "dim", "low", "high"]
                )

        return rows.select("node", "v").mapInArrow(run, "node long, dim int, low double, high double").groupBy("node", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def build(self, vectors: DataFrame) -> BoxTree:
        self._count = self.check_vectors(vectors)
        if self._count < 2:
            raise BuildError(f"{self._count} rows are no tree")
        self.rows, self.dead, self.splits, self.levels = vectors.select(F.col("id").cast("long").alias("id"), "v"), None, None, 0
        while self._count > SUBTREE and self.levels < 62:
            own = self._descended(self.rows, "v")
            full = own.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > max(self.leaf_size, SUBTREE)).select("node")
            # the widest axis of each full node; there are fewer of them than rows / SUBTREE
            widest = self._boxes(own.join(F.broadcast(full), "node", "left_semi")).groupBy("node").agg(F.max_by("dim", F.struct(F.col("high") - F.col("low"), -F.col("dim"))).alias("axis"))
            met = own.join(widest, "node").select("node", "axis", F.get(F.col("v"), F.col("axis")).cast("double").alias("x"))
            middles = met.groupBy("node", "axis").agg(F.percentile_approx("x", F.lit(0.5), F.lit(self.accuracy)).alias("threshold"), F.max("x").alias("most"))
            if not _grown(self, middles.filter("threshold < most").select("node", "axis", "threshold")):
                break
        self._finish()
        self._file()
        return self

    def _finish(self) -> None:
        """Nodes that a task can hold are split down to their leaves; larger ones are left where no split was found."""
        own, leaf_size = self._descended(self.rows, "v"), self.leaf_size
        whole = own.groupBy("node").agg(F.count("*").alias("n")).filter((F.col("n") > leaf_size) & (F.col("n") <= SUBTREE)).select("node")

        def splits(node: int, v: np.ndarray) -> Iterator[tuple[int, int, float]]:
            waiting = [(node, np.arange(len(v)))]
            while waiting:
                node, at = waiting.pop()
                if len(at) <= leaf_size or node.bit_length() > 62:
                    continue
                axis = int((v[at].max(0) - v[at].min(0)).argmax())
                x = v[at, axis]
                line = float(np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2])
                if line < x.max():
                    yield node, axis, line
                    waiting += [(2 * node, at[x <= line]), (2 * node + 1, at[x > line])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, held = None, []

            def done() -> pa.RecordBatch:
                made = list(splits(last, np.concatenate(held))) if held else []
                return pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.float64()))], names=["node", "axis", "threshold"])

            for b in batches:
                node = b.column(0).to_numpy(zero_copy_only=False)
                for key in np.unique(node).tolist():  # sorted
                    if key != last:
                        yield done()
                        last, held = key, []
                    held.append(matrix(b.column(1).filter(pa.array(node == key))))
            yield done()

        rows = own.join(F.broadcast(whole), "node", "left_semi").select("node", "v")
        nodes, cores = whole.count(), rows.sparkSession.sparkContext.defaultParallelism
        made = rows.repartition(max(1, min(nodes, 4 * cores)), "node").sortWithinPartitions("node").mapInArrow(run, "node long, axis int, threshold double")
        if _grown(self, made):
            self.levels = int(self.splits.agg(F.max("node")).first()[0]).bit_length()

    def _file(self) -> None:
        """A row for each leaf with its rows, in the order of the tree; leaves that could not be split take several rows."""
        own, cores = self._descended(self.live(), "v"), self.rows.sparkSession.sparkContext.defaultParallelism
        sizes = own.groupBy("node").agg(F.ceil(F.count("*") / (4 * self.leaf_size)).cast("int").alias("rows"))
        dealt = own.join(sizes, "node").withColumn("row", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int"))
        packed = dealt.groupBy("node", "row").agg(F.collect_list(F.struct("id", "v")).alias("held"))
        packed = packed.select(F.col("node").alias("leaf"), F.col("held.id").alias("ids"), F.flatten("held.v").alias("vs"))
        place = F.expr("shiftleft(leaf, 63 - length(bin(leaf)))")  # where its rows lie among all leaves
        self.leaves = materialise(packed.repartitionByRange(2 * cores, place).sortWithinPartitions(place))

    def _scan(self, shared, k: int, width: int, home: bool) -> DataFrame:
        """(qid, id, score, met): k rows a query and task; a row with a null id bears the rows met."""

        def boxes(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.minimum.reduceat(v, starts, axis=0), np.maximum.reduceat(v, starts, axis=0)

        def gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """Squared distances of queries to a box, a little too small rather than too large."""
            gap = np.maximum(np.maximum(low - q, q - high), 0.0)
            return np.einsum("ij,ij->i", gap, gap) * (1 - 1e-12)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q, homes, least = shared.value
            near, met = Nearest(q, k), np.zeros(len(qids), dtype=np.int64)
            by_home = np.argsort(homes, kind="stable")
            for b in batches:
                leaves, many = b.column(0).to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                every, ends = b.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(many)
                flat, first = b.column(2).flatten().to_numpy(zero_copy_only=False), 0
                while first < len(leaves):  # leaves of a tile of rows, or one larger leaf
                    start = ends[first] - many[first]
                    last = max(first + 1, int(np.searchsorted(ends, start + TILE_ROWS, "right")))
                    ids, v = every[start : ends[last - 1]], flat[start * width : ends[last - 1] * width].astype(np.float64).reshape(-1, width)
                    sizes, starts = many[first:last], ends[first:last] - many[first:last] - start
                    if home:
                        for leaf, a, n in zip(leaves[first:last], starts, sizes, strict=True):
                            at = by_home[slice(*np.searchsorted(homes, (leaf, leaf + 1), sorter=by_home))]
                            if len(at):
                                near.meet(v[a : a + n], ids[a : a + n], at)
                        first = last
                        continue
                    first = last
                    edge = np.minimum(least, near.scores[:, -1])
                    at = np.flatnonzero(gaps(q, v.min(0), v.max(0)) <= edge)
                    if not len(at):
                        continue
                    low, high = boxes(v, starts)
                    some = at[:: max(1, len(at) // 64)]
                    opened = lambda of: np.stack([gaps(q[of], x, y) for x, y in zip(low, high, strict=True)], axis=1) <= edge[of, None]
                    if len(at) > 64 and opened(some).mean() > 0.8:  # boxes tell little here
                        met[at] += len(ids)
                        near.meet(v, ids, at)
                        continue
                    for tile in range(0, len(at), TILE_QUERIES):
                        own = at[tile : tile + TILE_QUERIES]
                        open_ = opened(own)
                        met[own] += open_ @ sizes
                        within = np.flatnonzero(open_.any(1))
                        leaf_of = np.repeat(np.arange(len(sizes)), sizes)
                        kept = np.flatnonzero(open_.any(0)[leaf_of])
                        if len(within):
                            mask = open_[within][:, leaf_of[kept]]
                            near.meet(v[kept], ids[kept], own[within], None, lambda places, rows, mask=mask: mask[:, rows])
            yield with_met(qids, near.scores, near.ids, met)

        return self.leaves.select("leaf", "ids", "vs").mapInArrow(run, MET)

    def search(self, queries: DataFrame, k: int = 10) -> Found:
        n, spark = self.check_queries(queries, k), queries.sparkSession
        at_home = self._descended(queries.select("qid", "q"), "q").select("qid", "q", F.array("node").alias("keys"))
        out = None
        for qids, q, keys in keyed_blocks(at_home):
            homes = keys[:, 0]
            first = materialise(self._scan(spark.sparkContext.broadcast((qids, q, homes, None)), k, self.dimension, True))
            least = np.full(len(qids), np.inf)
            place = {x: i for i, x in enumerate(qids.tolist())}
            for r in top(first.filter("id is not null").select("qid", "id", "score"), k).filter(F.col("rank") == k).collect():  # a row a query of the block
                least[place[r.qid]] = r.score
            rest = materialise(self._scan(spark.sparkContext.broadcast((qids, q, homes, least)), k, self.dimension, False))  # home leaves too
            out = rest if out is None else out.unionAll(rest)
        if out is None:
            return Found(spark.createDataFrame([], "qid long, rank int, id long, score double"), stats_row(spark))
        cost = out.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("candidates")).select(
            F.col("candidates").cast("double").alias("distances"), "candidates", F.lit(n).cast("long").alias("hops"), F.lit(n).cast("long").alias("queries")
        )
        return Found(top(out.filter("id is not null").select("qid", "id", "score"), k), cost)

    def _append(self, vectors: DataFrame) -> None:
        """New rows fall into their leaves, whose boxes follow from their rows."""
        super()._append(vectors.select(F.col("id").cast("long").alias("id"), "v"))
        self._file()

    def remove(self, ids: DataFrame) -> int:
        new = super().remove(ids)
        if new:
            self._file()
        return new
