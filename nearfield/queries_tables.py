"""Queries over graphs, forests and trees that are tables; they join the registry of queries.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vector as V
from .operators import codes, graphs, hashing, ivf, tables
from .plans import evaluate, serving
from .queries import _BOOKS, _OUT, _top, SQL, K, _books, _sweep, asked, centres, corpus, out, query, size, truth

_ALL = "apart AS (SELECT a.id AS src, b.id AS dst, pow(list_distance(a.v, b.v), 2) AS score FROM corpus a, corpus b), "


def _near(degree: int) -> str:
    return _ALL + f"g AS (SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score, dst) AS o FROM apart WHERE src <> dst) WHERE o <= {degree}), "


@query(_OUT + "truth")
def boxes_search(s: SparkSession, d: str) -> DataFrame:
    """Branch and bound over a table of boxes is exact."""
    return out(tables.BoxTree(64, 16).build(corpus(s, d).select("id", "v")).search(asked(s, d), K).result)


_TREES, _LEVELS, _LEAF = 2, 6, 16


def _forest(s: SparkSession, d: str) -> tables.LeafForest:
    """Trees whose directions are the first vectors of the table."""
    few = corpus(s, d).filter(F.col("id") < _TREES * _LEVELS).orderBy("id").select("v").collect()
    directions = np.array([r.v for r in few], dtype=np.float64).reshape(_TREES, _LEVELS, -1)
    return tables.LeafForest(64, _TREES, _LEAF, directions=directions).build(corpus(s, d).select("id", "v"))


_LEAVES = (
    f"lines AS (SELECT c.id, o.id // {_LEVELS} AS tree, o.id % {_LEVELS} AS level, list_inner_product(c.v, o.v) AS p FROM corpus c, corpus o WHERE o.id < {_TREES * _LEVELS}), "
    f"n0 AS (SELECT id, tree, 1::BIGINT AS node FROM corpus, (SELECT unnest(range({_TREES})) AS tree)), "
    + ", ".join(
        f"s{i} AS (SELECT tree, node, count(*) AS n, quantile_disc(p, 0.5) AS line, max(p) AS most FROM n{i} JOIN lines USING (id, tree) WHERE level = {i} GROUP BY tree, node), "
        f"n{i + 1} AS (SELECT id, tree, CASE WHEN n > {_LEAF} AND line < most THEN 2 * node + CASE WHEN p > line THEN 1 ELSE 0 END ELSE node END AS node "
        f"FROM n{i} JOIN lines USING (id, tree) JOIN s{i} USING (tree, node) WHERE level = {i})"
        for i in range(_LEVELS)
    )
)


@query(f"{_LEAVES} SELECT tree, id, node FROM n{_LEVELS}")
def forest_leaves(s, d):
    leaf = F.col("leaf")
    tree = F.shiftright(leaf, 56)
    return _forest(s, d).leaves().select(tree.alias("tree"), "id", (leaf - F.shiftleft(tree, 56)).alias("node"))


@query(
    _LEAVES + f", met AS (SELECT DISTINCT a.id AS qid, b.id FROM n{_LEVELS} a JOIN n{_LEVELS} b USING (tree, node) WHERE a.id % 20 = 0) "
    "SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM met JOIN pairs USING (qid, id)) WHERE rank <= 10"
)
def leaves_search(s, d):
    """A query and the rows of its leaves, each once."""
    return out(_forest(s, d).search(asked(s, d), K).result)


_WALK = (
    _near(5) + "adj AS (SELECT list(near ORDER BY src) AS adj FROM (SELECT src, list(dst) AS near FROM (SELECT src, dst FROM g UNION SELECT dst, src FROM g) GROUP BY src)), "
    "dist AS (SELECT qid, list(score ORDER BY id) AS far FROM pairs GROUP BY qid), "
    "walk AS (SELECT qid, far, [0::BIGINT] AS seen, []::BIGINT[] AS opened, 0 AS round FROM dist UNION ALL "
    "SELECT qid, far, list_distinct(list_concat(seen, flatten(list_transform(taken, lambda t: adj[t + 1])))), list_concat(opened, taken), round + 1 FROM ("
    "SELECT qid, far, seen, opened, round, adj, list_transform(list_sort(list_filter(list_transform(seen, lambda x: {'s': far[x + 1], 'i': x}), "
    "lambda y: NOT list_contains(opened, y.i) AND (len(seen) < 12 OR y.s <= list_sort(list_transform(seen, lambda z: far[z + 1]))[12])))[1:4], lambda y: y.i) AS taken FROM walk, adj) "
    "WHERE len(taken) > 0), last AS (SELECT qid, max_by(seen, round) AS seen FROM walk GROUP BY qid)"
)


def _edges(s: SparkSession, d: str) -> tables.EdgeGraph:
    rows = corpus(s, d).select("id", "v")
    return tables.EdgeGraph(64, ef=12, entry="first", at_once=4).build(rows, graphs.symmetrise(graphs.exact_graph(rows, 5)))


@query(_WALK + " SELECT qid, unnest(seen) AS id FROM last")
def edges_visited(s, d):
    """What walks over the symmetrised graph of five neighbours touch."""
    return _edges(s, d).visited(asked(s, d))


@query(
    _WALK + ", seen AS (SELECT qid, unnest(seen) AS id FROM last) SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM "
    "(SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM seen JOIN pairs USING (qid, id)) WHERE rank <= 10"
)
def edges_search(s, d):
    return out(_edges(s, d).search(asked(s, d), K).result)


@query(
    _near(10) + "alld AS (SELECT list(r ORDER BY src) AS m FROM (SELECT src, list(score ORDER BY dst) AS r FROM apart GROUP BY src)), "
    "cand AS (SELECT src, list(dst ORDER BY score, dst) AS c FROM g GROUP BY src), "
    "pr AS (SELECT src, c, 1 AS i, []::BIGINT[] AS kept FROM cand UNION ALL SELECT src, c, i + 1, CASE WHEN len(kept) < 5 AND "
    "len(list_filter(kept, lambda x: 1.44 * m[x + 1][c[i] + 1] <= m[src + 1][c[i] + 1])) = 0 THEN list_append(kept, c[i]) ELSE kept END FROM pr, alld WHERE i <= len(c)) "
    "SELECT src, unnest(kept) AS dst, CAST(unnest(range(1, len(kept) + 1)) AS INTEGER) AS ord FROM pr WHERE i = len(c) + 1"
)
def graph_prune(s, d):
    """Diversity over given edges: a stream of candidates by vertex and distance."""
    rows = corpus(s, d).select("id", "v")
    return graphs.prune(rows, graphs.exact_graph(rows, 10), 5, 1.2)


_LESS = "list_transform(list_zip({}, c.c), lambda z: z[1] - z[2])"


@query(
    _BOOKS + ", resid AS (SELECT l.id, l.part, " + _LESS.format("l.v") + " AS r FROM lists l JOIN centres c USING (part)), "
    "renc AS (SELECT id, part, s, arg_min(code, {'d': pow(list_distance(r[s * 8 + 1 : s * 8 + 8], c), 2), 'code': code}) AS code FROM resid, books GROUP BY id, part, s), "
    "opened AS (SELECT p.qid, p.part, " + _LESS.format("q.q") + " AS r FROM probes p JOIN queries q USING (qid) JOIN centres c USING (part) WHERE nth <= 3), "
    "near AS (SELECT qid, id, sum(pow(list_distance(r[s * 8 + 1 : s * 8 + 8], c), 2)) AS score FROM opened JOIN renc USING (part) JOIN books USING (s, code) GROUP BY qid, id), "
    "short AS (" + _top("near", 20, "round(score, 9), id") + ") " + _OUT + "(" + _top("(SELECT qid, id, p.score FROM pairs p JOIN short USING (qid, id))") + ")"
)
def composite_given_books(s, d):
    """Residual codes by given books, three lists a query, a shortlist of twenty, exact distances of these."""
    i = codes.CompositeIndex(64, 10, 8, 16, 3, 20).build(corpus(s, d).select("id", "v"), centres(s, d), _books(s, d))
    return out(i.search(asked(s, d), K).result)


# -- reports fed by measured sweeps --------------------------------------------------------------

#: What ivf_probe_sweep measures, as a table.
_MEASURED = "m AS (" + SQL["ivf_probe_sweep"] + ")"


@query(_MEASURED + " SELECT value, recall FROM m ORDER BY recall DESC, distances, value DESC LIMIT 1")
def best_available(s, d):
    rows = _sweep(s, d).select("value", F.round("recall", 6).alias("recall"), F.round("distances", 6).alias("distances"))
    return evaluate.best_available(rows)


@query(_MEASURED + " SELECT min(value) AS depth FROM m WHERE recall >= 0.5")
def smallest_depth(s, d):
    return serving.smallest_depth(_sweep(s, d).select(F.col("value").alias("depth"), F.round("recall", 6).alias("recall")), 0.5)


@query(
    _MEASURED + ", x AS (SELECT distances AS d, recall AS r, lead(distances) OVER w AS d2, lead(recall) OVER w AS r2 FROM m WINDOW w AS (ORDER BY distances)) "
    "SELECT 'ivf' AS index, round(coalesce(max(CASE WHEN d <= 150 AND (d2 IS NULL OR d2 > 150) THEN CASE WHEN d2 IS NULL THEN r ELSE r + (r2 - r) * (150 - d) / (d2 - d) END END), 0), 6) AS recall FROM x"
)
def frontier_at_budget(s, d):
    rows = _sweep(s, d).select(F.lit("ivf").alias("index"), F.round("recall", 6).alias("recall"), F.round("distances", 6).alias("distances"))
    return evaluate.frontier(rows, 150.0).select("index", F.round("recall", 6).alias("recall"))


@query("e AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN 'dear' ELSE 'cheap' END AS tier FROM queries) SELECT round(avg(CASE WHEN tier = 'dear' THEN 1 ELSE 0 END), 6) AS escalation_rate, round(avg(CASE WHEN tier = 'dear' THEN 1000 ELSE 100 END), 6) AS distances_per_query FROM e")
def routing_cost(s, d):
    tiers = asked(s, d).select("qid", F.when(F.col("qid") % 3 == 0, "dear").otherwise("cheap").alias("tier"))
    return serving.routing_cost(tiers, {"cheap": 100.0, "dear": 900.0}).select(*[F.round(c, 6).alias(c) for c in ("escalation_rate", "distances_per_query")])


@query("n AS (SELECT count(*) AS n FROM corpus), p AS (SELECT CAST(pow(2, i) AS INTEGER) AS p, pow(2, i) + 4.0 * n / pow(2, i) AS cost FROM n, range(1, 64) t(i) WHERE pow(2, i - 1) < n AND pow(2, i) <= pow(2, length(bin(n)) - 1)) SELECT p, cost, p = (SELECT p FROM p ORDER BY cost, p LIMIT 1) AS best FROM p")
def cheapest_partitions(s, d):
    r = ivf.cheapest_partition_count(size(s, d), 4)
    return s.createDataFrame([(p, float(c), p == r["best"]) for p, c in r["costs"].items()], "p int, cost double, best boolean")


@query("a AS (SELECT qid, id, acos(least(1.0, greatest(-1.0, list_cosine_similarity(q, v)))) AS angle FROM truth JOIN queries USING (qid) JOIN corpus USING (id)) SELECT qid, id, round(pow(1 - angle / pi(), 6), 4) AS p FROM a")
def lsh_collisions(s, d):
    """The chance that a query and a near row share a bucket of one table, from their angle."""
    pairs = truth(s, d).select("qid", "id").join(corpus(s, d), "id").join(asked(s, d), "qid")
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), V.cosine("q", "v"))))
    return pairs.select("qid", "id", F.round(hashing.collision_probability(angle, 6), 4).alias("p"))


@query("SELECT CAST(len(v) AS INTEGER) AS dimension, CAST(ceil(len(v) / 64) AS INTEGER) AS words, count(*) AS n FROM corpus GROUP BY len(v)")
def words_needed(s, d):
    widths = corpus(s, d).groupBy(F.size("v").alias("dimension")).agg(F.count("*").alias("n")).collect()
    return s.createDataFrame([(r.dimension, codes.words_needed(r.dimension), r.n) for r in widths], "dimension int, words int, n long")


@query("SELECT id, round(list_inner_product(v, v), 6) AS length FROM corpus")
def rotation_random(s, d):
    """A rotation keeps lengths."""
    turned = V.project("v", codes.random_rotation(64, 3).tolist())
    return corpus(s, d).select("id", turned.alias("t")).select("id", F.round(V.dot("t", "t"), 6).alias("length"))
