"""More registered queries, with their SQL: generators, index lives, training, storage, streams.

Generators, samples and splits hash with md5, so SQL makes the same numbers.  A structure that
walks is asked here with settings under which it has to be exact, so SQL can say what is right.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cli, errors
from .functions import vector as V
from .operators import codes, exact, filtered, graphs, hashing, index, ivf, kmeans, sharded
from .plans import churn, evaluate, serving, storage, verify
from .plans.lineage import checkpoint_dir, materialise
from .queries import (
    _BOOKS, _GRAPH, _OPEN, _OUT, _PLANES, _STAGES, _SHORT, _books, _filled, _graph, _index, _planes, _scalar, _served, _stages, _stream, _STREAM,
    _top, K, asked, centres, corpus, fixed, lists, out, query, rough, size, truth,
)
from .sources import datasets, drift
from .streaming import batches


def six(c: str):
    return F.round(c, 6).alias(c)


def long(rows: DataFrame, ids: str = "id", column: str = "v") -> DataFrame:
    """(id, dim, x) of an array column, rounded to 6 digits."""
    return rows.select(F.col(ids).cast("long").alias(ids), F.posexplode(column).alias("dim", "x")).select(ids, "dim", six("x"))


def _long(source: str, ids: str = "id", column: str = "v") -> str:
    return f"SELECT {ids}, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x FROM (SELECT {ids}, unnest({column}) AS x, unnest(range(0, len({column}))) AS dim FROM {source})"


def ints(m: np.ndarray, s) -> DataFrame:
    """(i, j, x) of a matrix, rounded to 6 digits (zero without a sign)."""
    return s.createDataFrame([(i, j, round(float(x), 6) + 0.0) for i, row in enumerate(m) for j, x in enumerate(row)], "i int, j int, x double")


def _eye(n: int, x: str = "1.0") -> str:
    return f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN {x} ELSE 0.0 END::DOUBLE AS x FROM range(0, {n}) a(i), range(0, {n}) b(j)"


def _h(seed: int, *key: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)"


def _u(seed: int, *key: str) -> str:
    return f"(({_h(seed, *key)} + 0.5) / 4503599627370496.0)"


def _normals(d: int, seed: int, key: str = "id") -> str:
    r, a = _u(seed, key, "i", "'r'"), _u(seed, key, "i", "'a'")
    return f"list_transform(range(0, {d}), lambda i: sqrt(-2 * ln({r})) * cos({a} * 2 * pi()))"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


def _sample(source: str, count: str, seed: int, columns: str = "id, v") -> str:
    return f"SELECT {columns} FROM {source} QUALIFY row_number() OVER (ORDER BY {_h(seed, 'id')}, id) <= {count}"


# -- generators, drift, duplicates, transforms -------------------------------------------------

_GAUSS = f"g AS (SELECT range AS id, {_normals(8, 3, 'range')} AS v FROM range(0, (SELECT count(*) FROM corpus)))"


@query(f"{_GAUSS} {_long('g')}")
def gen_gaussian(s, d):
    return long(datasets.gaussian(s, size(s, d), 8, 3))


@query(
    f"c AS (SELECT range AS c_at, {_normals(6, 4, 'range')} AS c FROM range(0, 5)), e AS (SELECT range AS id, {_h(2, 'range')} % 5 AS c_at, {_normals(6, 3, 'range')} AS e FROM range(0, (SELECT count(*) FROM corpus))), "
    f"g AS (SELECT id, list_transform(list_zip(c, e), lambda z: z[1] + 0.15 * z[2]) AS v FROM e JOIN c USING (c_at)) {_long('g')}"
)
def gen_clustered(s, d):
    return long(datasets.clustered(s, size(s, d), 6, 5, 0.15, 2))


@query(f"SELECT range AS id, round(list_inner_product(z, z), 6) AS length FROM (SELECT range, {_normals(4, 1, 'range')} AS z FROM range(0, (SELECT count(*) FROM corpus)))")
def gen_subspace(s, d):
    return datasets.on_a_subspace(s, size(s, d), 24, 4, 0.0, 1).select("id", F.round(V.dot("v", "v"), 6).alias("length"))


@query(f"{_GAUSS}, k AS (SELECT id, list_transform(list_zip(v, range(0, 8)), lambda z: z[1] * pow(0.9, z[2])) AS v FROM g) {_long('k')}")
def gen_skewed(s, d):
    return long(datasets.skewed(s, size(s, d), 8, 0.9, 3))


@query(f"{_GAUSS}, k AS (SELECT id, {_unit('v')} AS v FROM g) {_long('k')}")
def gen_unit(s, d):
    return long(datasets.unit_vectors(s, size(s, d), 8, 3))


@query(f"{_GAUSS}, k AS (SELECT id, list_transform({_unit('v')}, lambda x: x * (1 + 7 * {_u(10, 'id')})) AS v FROM g) {_long('k')}")
def gen_scaled(s, d):
    return long(datasets.scaled_vectors(s, size(s, d), 8, 8.0, 3))


@query(
    f"g AS (SELECT range AS id, {_normals(8, 3, 'range')} AS v FROM range(0, (SELECT count(*) FROM corpus))), r AS (SELECT range AS qid, {_normals(8, 12, 'range')} AS q FROM range(0, 40)) "
    + _OUT + "(" + _top("(SELECT qid, id, pow(list_distance(q, v), 2) AS score FROM r, g)") + ")"
)
def gen_search(s, d):
    queries = datasets.gaussian(s, 40, 8, 12).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return out(exact.search(queries, datasets.gaussian(s, size(s, d), 8, 3), K))


@query("h AS (" + _sample("corpus", "30", 11) + ") SELECT id, 'asked' AS side FROM h UNION ALL SELECT id, 'rest' FROM corpus WHERE id NOT IN (SELECT id FROM h)")
def held_out_split(s, d):
    rest, queries = datasets.held_out(corpus(s, d).select("id", "v"), 30)
    return queries.select(F.col("qid").alias("id"), F.lit("asked").alias("side")).unionByName(rest.select("id", F.lit("rest").alias("side")))


@query(
    "p AS (" + _sample("corpus", "256", 11) + "), t AS (SELECT 0.25 * avg(list_distance(a.v, b.v)) AS step FROM p a, p b WHERE a.id <> b.id), "
    f"m AS (SELECT id, v, {_unit(_normals(64, 14))} AS e FROM ({_sample('corpus', '64', 11)})), "
    "k AS (SELECT id AS qid, list_transform(list_zip(v, e), lambda z: z[1] + z[2] * step) AS q FROM m, t) " + _long("k", "qid", "q")
)
def gen_perturbed(s, d):
    return long(datasets.perturbed_queries(corpus(s, d).select("id", "v"), 64), "qid", "q")


@query(
    "n AS (SELECT a.id, pow(list_distance(a.v, b.v), 2) AS s FROM corpus a, corpus b WHERE a.id <> b.id), r AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY s) AS o FROM n), "
    "x AS (SELECT id, ln(sqrt(max(s) / min(s))) AS x FROM r WHERE o <= 2 GROUP BY id), f AS (SELECT x, row_number() OVER (ORDER BY x, id) / (SELECT count(*) FROM x) AS f FROM x) "
    "SELECT round(sum(x * -ln(1 - f)) / sum(x * x), 6) AS dimension FROM f WHERE f < 0.9"
)
def intrinsic_dimension(s, d):
    return datasets.intrinsic_dimension(corpus(s, d).select("id", "v"), size(s, d)).select(six("dimension"))


@query("SELECT CAST(d AS INTEGER) AS dimension, round(sqrt(2 * d) / greatest(1e-9, sqrt(2 * d) - sqrt(2 * ln(2048))), 6) AS contrast FROM (SELECT unnest([2, 8, 32, 128]) AS d)")
def expected_contrast(s, d):
    return s.createDataFrame([(n, round(datasets.expected_contrast(n), 6)) for n in (2, 8, 32, 128)], "dimension int, contrast double")


_DUP = (
    f"kept AS (SELECT id, v, row_number() OVER (ORDER BY id) - 1 AS number FROM corpus WHERE {_u(0, 'id')} >= 0.3), "
    f"gone AS (SELECT id, {_h(1, 'id')} % (SELECT count(*) FROM kept) AS number FROM corpus WHERE {_u(0, 'id')} < 0.3), "
    "dup AS (SELECT id, id AS original, v FROM kept UNION ALL SELECT g.id, k.id, k.v FROM gone g JOIN kept k USING (number))"
)


@query(_DUP + " SELECT id, original FROM dup")
def exact_duplicates(s, d):
    return drift.exact_duplicates(corpus(s, d).select("id", "v"), 0.3).select("id", "original")


@query(_DUP + f", e AS (SELECT id, original, v, {_unit(_normals(64, 2))} AS e FROM dup), k AS (SELECT id, CASE WHEN id = original THEN v ELSE list_transform(list_zip(v, e), lambda z: z[1] + 0.01 * z[2]) END AS v FROM e) {_long('k')}")
def near_duplicate_rows(s, d):
    return long(drift.near_duplicates(corpus(s, d).select("id", "v"), 0.3))


@query(_DUP + " SELECT original, count(*) AS n FROM dup GROUP BY original")
def duplicate_groups(s, d):
    return drift.duplicate_groups(drift.exact_duplicates(corpus(s, d).select("id", "v"), 0.3))


@query(f"k AS (SELECT qid, list_transform(list_zip(q, {_unit(_normals(64, 0, chr(39) + 'shift' + chr(39)))}), lambda z: z[1] + 4 * z[2]) AS q FROM queries) {_long('k', 'qid', 'q')}")
def drift_shift(s, d):
    return long(drift.drifted(asked(s, d), "shift", 4.0), "qid", "q")


@query("SELECT qid, round(list_inner_product(q, q), 6) AS length FROM queries")
def drift_rotate(s, d):
    return drift.drifted(asked(s, d), "rotate", 1.0).select("qid", F.round(V.dot("q", "q"), 6).alias("length"))


@query("SELECT i, j, round(x, 6) AS x FROM (" + _eye(64, "(SELECT (nc - 1) / nc FROM nc)") + ")")
def whitened_covariance(s, d):
    rows = corpus(s, d).select("id", "v")
    return ints(codes.covariance(drift.fit_whitening(rows).apply(rows))[1], s)


_CENTRED = "mean AS (SELECT list(m ORDER BY dim) AS m FROM (SELECT dim, avg(x) AS m FROM dims GROUP BY dim)), cen AS (SELECT id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS w FROM corpus, mean)"


@query(_CENTRED + " SELECT id, round(list_inner_product(w, w), 6) AS length, CAST(1.0 AS DOUBLE) AS kept_variance FROM cen")
def reduction_to_all(s, d):
    rows = corpus(s, d).select("id", "v")
    t = drift.fit_reduction(rows, 64)
    return t.apply(rows).select("id", F.round(V.dot("v", "v"), 6).alias("length"), F.lit(round(t.kept_variance, 6)).alias("kept_variance"))


@query("SELECT id, round(list_inner_product(v, v), 6) AS length FROM corpus")
def projection_to_all(s, d):
    return drift.fit_random_projection(64, 64, 3).apply(corpus(s, d)).select("id", F.round(V.dot("v", "v"), 6).alias("length"))


@query("SELECT round(avg(hit) / 10.0, 6) AS overlap FROM (SELECT a.qid, count(*) AS hit FROM truth a JOIN truth b USING (qid, id) GROUP BY a.qid)")
def recall_after_rotation(s, d):
    return drift.recall_after(corpus(s, d).select("id", "v"), asked(s, d), drift.fit_random_projection(64, 64, 5), K).select(six("overlap"))


@query("SELECT round(sum(v), 6) AS variance, CAST(64 AS INTEGER) AS directions, CAST(64 AS BIGINT) AS widest_first FROM (SELECT var_samp(x) AS v FROM dims GROUP BY dim)")
def principal_variances(s, d):
    _, directions, variance = drift.principal_directions(corpus(s, d).select("id", "v"))
    return s.createDataFrame([(round(float(variance.sum()), 6), len(directions), int((np.diff(variance) <= 1e-12).sum()) + 1)], "variance double, directions int, widest_first long")


# -- metrics, guards, costs --------------------------------------------------------------------


@fixed("SELECT * FROM (VALUES ('cosine', false, false, false), ('ip', false, false, false), ('l2', true, true, true)) t(name, smaller_is_closer, is_a_metric, prunable)")
def metric_table(s, d):
    prunable = V.which_metrics_allow_pruning()["prunable"]
    rows = [(m.name, m.smaller_is_closer, m.is_a_metric, m.name in prunable) for m in map(V.metric_named, V.METRICS)]
    return s.createDataFrame(rows, "name string, smaller_is_closer boolean, is_a_metric boolean, prunable boolean")


@query("SELECT count(*) AS n, CAST(any_value(len(v)) AS INTEGER) AS width FROM corpus")
def checked_shape(s, d):
    return s.createDataFrame([V.checked(corpus(s, d))], "n long, width int")


@query(
    "SELECT * FROM (VALUES ('bad budget', 'ConfigError'), ('bad metric', 'ConfigError'), ('bad predicate share', 'ConfigError'), ('empty clustering', 'BuildError'), ('insert of a known id', 'ConfigError'), "
    "('insert unbuilt', 'IndexStateError'), ('k above size', 'ConfigError'), ('k of 0', 'ConfigError'), ('narrow queries', 'DataError'), ('no index', 'DataError'), ('null vector', 'DataError'), "
    "('ranking without score', 'DataError'), ('removal of an unknown id', 'ConfigError'), ('self loop', 'DataError'), ('tree by ip', 'ConfigError'), ('unbuilt', 'IndexStateError')) t(case_, raised)"
)
def guards(s, d):
    c, q = corpus(s, d).select("id", "v"), asked(s, d)
    flat, other = index.FlatIndex(64).build(c), index.FlatIndex(64)
    cases = {
        "unbuilt": lambda: other.search(q),
        "insert unbuilt": lambda: other.insert(c),
        "k of 0": lambda: flat.search(q, 0),
        "k above size": lambda: flat.search(q, 10**9),
        "narrow queries": lambda: flat.search(q.select("qid", F.slice("q", 1, 8).alias("q"))),
        "null vector": lambda: index.FlatIndex(64).build(c.select("id", F.when(F.col("id") != 3, F.col("v")).alias("v"))),
        "bad metric": lambda: V.metric_named("manhattan"),
        "tree by ip": lambda: sharded.TreeIndex(64, metric="ip"),
        "removal of an unknown id": lambda: flat.remove(s.range(10**9, 10**9 + 1)),
        "insert of a known id": lambda: flat.insert(c.filter("id = 5")),
        "self loop": lambda: graphs.check_graph(s.createDataFrame([(1, 1, 1)], "src long, dst long, ord int")),
        "empty clustering": lambda: kmeans.Clustering(np.zeros((2, 2)), np.zeros(2), 1, 0.0),
        "bad predicate share": lambda: filtered.random_predicate(c, 0.0),
        "ranking without score": lambda: evaluate.checked_ranking(c),
        "bad budget": lambda: serving.Budget(-1.0),
        "no index": lambda: storage.peek(s, f"{checkpoint_dir(s)}/no-index-here"),
    }
    rows = []
    for name, call in cases.items():
        try:
            call()
            rows.append((name, "nothing"))
        except errors.VectorSearchError as e:
            rows.append((name, type(e).__name__))
    return s.createDataFrame(rows, "case_ string, raised string")


@fixed("SELECT * FROM (VALUES ('BuildError', true), ('ConfigError', true), ('DataError', true), ('IndexStateError', true), ('VectorSearchError', true)) t(name, is_ours)")
def error_classes(s, d):
    kinds = [e for e in vars(errors).values() if isinstance(e, type) and issubclass(e, Exception)]
    return s.createDataFrame([(e.__name__, issubclass(e, errors.VectorSearchError)) for e in kinds], "name string, is_ours boolean")


@fixed("SELECT 1150.0::DOUBLE AS distances, CAST(600 AS BIGINT) AS candidates, CAST(7 AS BIGINT) AS hops, CAST(10 AS BIGINT) AS queries, 115.0::DOUBLE AS distances_per_query")
def cost_algebra(s, d):
    both = index.charge(index.merge_stats(index.stats_row(s, 1000, 300, 3, 4), index.stats_row(s, 100, 200, 4, 6)), 100, 0.5)
    return both.crossJoin(index.distances_per_query(both))


_QUALITY = (
    "t AS (SELECT avg(hit) / 10.0 AS recall FROM (SELECT q.qid, count(r.id) AS hit FROM queries q JOIN truth USING (qid) LEFT JOIN rough r USING (qid, id) GROUP BY q.qid)), gp AS (SELECT avg(r.score - t.score) AS gap FROM truth t JOIN rough r USING (qid, rank)), "
    "c AS (SELECT 10 + count(*) / (SELECT nq FROM nq) AS dpq FROM probes JOIN lists USING (part) WHERE nth <= 2)"
)


@query(_QUALITY + " SELECT round(recall, 6) AS recall, round(gap, 6) AS gap, round(dpq, 6) AS distances_per_query, CAST(nc AS BIGINT) AS corpus_size, round(nc / dpq, 6) AS speedup, round(dpq / nc, 6) AS scanned FROM t, gp, c, nc")
def evaluate_ivf(s, d):
    q = index.evaluate(_index(s, d), corpus(s, d).select("id", "v"), asked(s, d), K)
    row = tuple(round(float(x), 6) for x in (q.recall, q.gap, q.distances_per_query)) + (q.corpus_size, round(q.speedup, 6), round(q.scanned, 6))
    return s.createDataFrame([row], "recall double, gap double, distances_per_query double, corpus_size long, speedup double, scanned double")


@query("SELECT CAST(1.0 AS DOUBLE) AS recall, CAST(0.0 AS DOUBLE) AS gap, nc - 64 AS distances_per_query, CAST(nc - 64 AS BIGINT) AS corpus_size FROM nc")
def evaluate_flat_on(s, d):
    q = index.evaluate_on(index.FlatIndex(64), corpus(s, d).select("id", "v"), K, 64)
    return s.createDataFrame([(q.recall, round(q.gap, 6) + 0.0, q.distances_per_query, q.corpus_size)], "recall double, gap double, distances_per_query double, corpus_size long")


@fixed("SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'b'), (2, 'c'), (3, 'a')) t(place, index)")
def compared(s, d):
    of = index.compare([index.Quality("a", 0.2, 0, 10, 100), index.Quality("b", 0.9, 0, 50, 100), index.Quality("c", 0.5, 0, 0, 100)])
    return s.createDataFrame([(i + 1, q.index) for i, q in enumerate(of)], "place int, index string")


# -- lives of indexes --------------------------------------------------------------------------

#: Rows near the queries go, moved rows come; SQL says what is exact then.
_LIFE = (
    "gone AS (SELECT DISTINCT id FROM truth WHERE rank <= 6), life AS (SELECT id, v FROM corpus WHERE id NOT IN (SELECT id FROM gone) UNION ALL "
    "SELECT id + 1000000, list_transform(v, lambda x: x * 1.01) FROM corpus WHERE id % 20 = 0), "
    "after AS (" + _top("(SELECT qid, id, pow(list_distance(q, v), 2) AS score FROM queries, life)") + ") " + _OUT + "after"
)


def _live(s, d, i: index.Index, **how) -> DataFrame:
    i.build(corpus(s, d).select("id", "v"))
    i.remove(materialise(truth(s, d).filter("rank <= 6").select("id").distinct()))
    i.insert(corpus(s, d).filter("id % 20 = 0").select((F.col("id") + 1_000_000).alias("id"), V.times("v", 1.01).alias("v")))
    return out(i.search(asked(s, d), K, **how).result)


@query(_LIFE)
def flat_life(s, d):
    return _live(s, d, index.FlatIndex(64))


@query(_LIFE)
def tree_life(s, d):
    return _live(s, d, sharded.TreeIndex(64, 16, shards=3))


@query(_LIFE)
def forest_life(s, d):
    return _live(s, d, sharded.ForestIndex(64, 3, 10**6, shards=2))


@query(_LIFE)
def graph_life(s, d):
    return _live(s, d, sharded.GraphIndex(64, 32, 32, shards=2), ef=10**6)


@query(_LIFE)
def hnsw_life(s, d):
    return _live(s, d, sharded.HNSWIndex(64, 16, shards=2), ef=10**6)


@query(_LIFE)
def ivf_life(s, d):
    return _live(s, d, ivf.IVFIndex(64, 6, "l2", 6))


@query(_LIFE)
def spill_life(s, d):
    return _live(s, d, ivf.SpillIndex(64, 6, 6, 2))


@query(_LIFE)
def binary_life(s, d):
    return _live(s, d, codes.BinaryIndex(64), rerank=size(s, d))


@query(_LIFE)
def composite_life(s, d):
    return _live(s, d, codes.CompositeIndex(64, 4, 8, 16, 4, 10**6))


@query(_LIFE)
def rebuilt_life(s, d):
    i = ivf.IVFIndex(64, 5, "l2", 5)
    _live(s, d, i)
    return out(i.rebuild().search(asked(s, d), K).result)


@query("gone AS (SELECT DISTINCT id FROM truth WHERE rank <= 6) SELECT id AS old_id, row_number() OVER (ORDER BY id) - 1 AS id FROM corpus WHERE id NOT IN (SELECT id FROM gone)")
def flat_compact(s, d):
    i = index.FlatIndex(64).build(corpus(s, d).select("id", "v"))
    i.remove(materialise(truth(s, d).filter("rank <= 6").select("id").distinct()))
    return i.compact()[0]


@query(_long("(SELECT id, v FROM corpus WHERE id = 40)"))
def flat_vector(s, d):
    v = index.FlatIndex(64).build(corpus(s, d).select("id", "v")).vector(40)
    return long(s.createDataFrame([(40, [float(x) for x in v])], "id long, v array<double>"))


_SPILLED = "few AS (" + _top("(SELECT DISTINCT qid, p.id, p.score FROM pairs p JOIN probes USING (qid) JOIN filed f ON f.id = p.id AND f.part = probes.part AND f.nth <= 2 WHERE probes.nth <= 2)") + ")"


@query(_SPILLED + ", " + _filled("few"))
def spill_index_search(s, d):
    return out(ivf.SpillIndex(64, 10, 2, 2).build(corpus(s, d).select("id", "v"), centres(s, d)).search(asked(s, d), K).result)


@query("n AS (SELECT count(*) AS n FROM (SELECT DISTINCT qid, f.id FROM probes p JOIN filed f ON f.part = p.part AND f.nth <= 2 WHERE p.nth <= 2)) SELECT n + 10 * nq AS distances, n AS candidates, CAST(2 * nq AS BIGINT) AS hops, CAST(nq AS BIGINT) AS queries FROM n, nq")
def spill_index_cost(s, d):
    return ivf.SpillIndex(64, 10, 2, 2).build(corpus(s, d).select("id", "v"), centres(s, d)).search(asked(s, d), K).stats


@query("SELECT CAST(c.part AS INTEGER) AS part, count(f.id) AS n FROM centres c LEFT JOIN filed f ON f.part = c.part AND f.nth <= 2 GROUP BY c.part")
def spill_lengths(s, d):
    return ivf.SpillIndex(64, 10, 2, 2).build(corpus(s, d).select("id", "v"), centres(s, d)).sizes()


@query("SELECT CAST(id % 10 = 3 AS BOOLEAN) AS moved, count(*) AS rows FROM corpus WHERE id % 10 = 3 GROUP BY 1")
def ivf_inserted(s, d):
    i = _index(s, d)
    i.insert(corpus(s, d).filter("id % 10 = 3").select((F.col("id") + 1_000_000).alias("id"), "v"))
    return s.createDataFrame([(True, i.inserted)], "moved boolean, rows long")


_LSH = _PLANES + ", few AS (" + _top("(SELECT pairs.qid, pairs.id, score FROM pairs JOIN cand USING (qid, id))") + ")"


def _lsh(s, d) -> hashing.LSHIndex:
    return hashing.LSHIndex(64, planes=_planes(s, d)).build(corpus(s, d).select("id", "v"))


@query(_LSH + ", " + _filled("few"))
def lsh_index_search(s, d):
    return out(_lsh(s, d).search(asked(s, d), K).result)


@query(_PLANES + " SELECT count(*)::DOUBLE AS distances, count(*) AS candidates, CAST(4 * any_value(nq) AS BIGINT) AS hops, CAST(any_value(nq) AS BIGINT) AS queries FROM cand, nq")
def lsh_index_cost(s, d):
    return _lsh(s, d).search(asked(s, d), K).stats


@query(_OUT + "rough")
def composite_given_centres(s, d):
    i = codes.CompositeIndex(64, 10, 8, 16, 2, 10**6).build(corpus(s, d).select("id", "v"), centres(s, d))
    return out(i.search(asked(s, d), K).result)


@query("SELECT CAST(nc * (8 + 8) + 4 * 64 * (10 + 16) AS BIGINT) AS structure, CAST(nc * (8 + 8) + 4 * 64 * (10 + 16) + 4 * 64 * nc AS BIGINT) AS memory FROM nc")
def composite_memory(s, d):
    i = codes.CompositeIndex(64, 10, 8, 16, 2).build(corpus(s, d).select("id", "v"), centres(s, d))
    return s.createDataFrame([(i.structure_bytes(), i.memory_bytes())], "structure long, memory long")


@query("SELECT 'flat' AS index, 64 AS dimension, 'l2' AS metric, count(*) AS size, true AS built FROM corpus")
def index_description(s, d):
    r = index.FlatIndex(64).build(corpus(s, d).select("id", "v")).as_dict()
    return s.createDataFrame([tuple(r[k] for k in ("index", "dimension", "metric", "size", "built"))], "index string, dimension int, metric string, size long, built boolean")


# -- churn -------------------------------------------------------------------------------------

_SPLIT = f"h AS ({_sample('corpus', '40', 11)}), rest AS (SELECT id, v, {_u(0, 'id')} < 0.5 AS built FROM corpus WHERE id NOT IN (SELECT id FROM h))"


@query(_SPLIT + " SELECT id, CASE WHEN built THEN 'built' ELSE 'arriving' END AS side FROM rest UNION ALL SELECT id, 'asked' FROM h")
def churn_split(s, d):
    built, arriving, queries = churn.split_for_churn(corpus(s, d).select("id", "v"), 0.5, 40)
    sides = {"built": built.select("id"), "arriving": arriving.select("id"), "asked": queries.select(F.col("qid").alias("id"))}
    parts = [f.select("id", F.lit(n).alias("side")) for n, f in sides.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _degradations(s, steps) -> DataFrame:
    rows = [tuple(float(x) for x in (r["churn"], r["recall"], r["distances"])) + (r["size"],) for r in (x.as_dict() for x in steps)]
    return s.createDataFrame([(i, round(a, 6), b, c, n) for i, (a, b, c, n) in enumerate(rows)], "step int, churn double, recall double, distances double, size long")


@query(
    _SPLIT + f", n AS (SELECT count(*) FILTER (built) AS b FROM rest), a AS (SELECT step, count(id) AS came FROM range(0, 3) r(step) LEFT JOIN rest ON NOT built AND {_h(1, 'id')} % 3 <= step GROUP BY step) "
    "SELECT CAST(step AS INTEGER) AS step, round(came / b, 6) AS churn, 1.0::DOUBLE AS recall, (b + came)::DOUBLE AS distances, b + came AS size FROM a, n"
)
def churn_inserts(s, d):
    built, arriving, queries = churn.split_for_churn(corpus(s, d).select("id", "v"), 0.5, 40)
    return _degradations(s, churn.insert_in_batches(index.FlatIndex(64), built, arriving, queries, 3))


@query(
    f"a AS (SELECT step, count(id) AS went FROM range(0, 3) r(step) LEFT JOIN corpus ON {_u(0, 'id')} < 0.4 AND {_h(1, 'id')} % 3 <= step GROUP BY step) "
    "SELECT CAST(step AS INTEGER) AS step, round(went / nc, 6) AS churn, 1.0::DOUBLE AS recall, nc AS distances, CAST(nc - went AS BIGINT) AS size FROM a, nc"
)
def churn_removals(s, d):
    return _degradations(s, churn.remove_in_batches(index.FlatIndex(64), corpus(s, d).select("id", "v"), asked(s, d), 3))


@query(
    _GRAPH + ", one AS (SELECT src, dst FROM g WHERE ord <= 2 AND src % 3 <> 0 AND dst % 3 <> 0), e AS (SELECT src, dst FROM one UNION SELECT dst, src FROM one), "
    "r AS (SELECT id AS node, id AS seen FROM corpus WHERE id % 3 <> 0 UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.seen) SELECT node AS id, min(seen) AS component FROM r GROUP BY node"
)
def components_of_the_living(s, d):
    c = corpus(s, d)
    return churn.components_over_live(_graph(s, d, 2), c.select("id"), c.filter("id % 3 = 0").select("id"))


# -- k-means and samples -----------------------------------------------------------------------


def _moved(source: str, to: str) -> str:
    """Centres after a round from ``source``, as CTEs; an assignment and its means."""
    return (
        f"as_{to} AS (SELECT id, v, part, d FROM (SELECT id, v, part, pow(list_distance(v, c), 2) AS d, row_number() OVER (PARTITION BY id ORDER BY pow(list_distance(v, c), 2), part) AS nth FROM corpus, {source}) WHERE nth = 1), "
        f"{to} AS (SELECT part, list(m ORDER BY dim) AS c FROM (SELECT part, dim, avg(x) AS m FROM (SELECT part, unnest(v) AS x, unnest(range(1, 65)) AS dim FROM as_{to}) GROUP BY part, dim) GROUP BY part)"
    )


@query(_moved("centres", "c1") + ", " + _moved("c1", "c2") + f", k AS (SELECT CAST(part AS BIGINT) AS id, c AS v FROM c2) {_long('k')}")
def kmeans_two_rounds(s, d):
    c = kmeans.lloyd(corpus(s, d).select("id", "v"), 10, 2, init=centres(s, d))
    return long(kmeans.centre_frame(s, c.centres), "part", "c").withColumnRenamed("part", "id")


@query(_moved("centres", "c1") + ", " + _moved("c1", "c2") + " SELECT CAST(10 AS INTEGER) AS k, CAST(2 AS INTEGER) AS rounds, round((SELECT sum(d) FROM as_c2), 6) AS inertia, (SELECT max(n) FROM (SELECT count(*) AS n FROM as_c2 GROUP BY part)) AS largest, CAST(0 AS BIGINT) AS empty")
def kmeans_report(s, d):
    r = kmeans.lloyd(corpus(s, d).select("id", "v"), 10, 2, init=centres(s, d)).as_dict()
    return s.createDataFrame([(r["k"], r["rounds"], round(r["inertia"], 6), r["largest"], r["empty"])], "k int, rounds int, inertia double, largest long, empty long")


@query(_moved("centres", "c1") + f", far AS (SELECT v FROM as_c1 ORDER BY d DESC, id LIMIT 1), k AS (SELECT CAST(part AS BIGINT) AS id, c AS v FROM c1 UNION ALL SELECT 10, v FROM far) {_long('k')}")
def kmeans_repair(s, d):
    start = np.concatenate((centres(s, d), np.full((1, 64), 50.0)))
    c = kmeans.lloyd(corpus(s, d).select("id", "v"), 11, 1, init=start)
    return long(kmeans.centre_frame(s, c.centres), "part", "c").withColumnRenamed("part", "id")


@query("SELECT * FROM (VALUES ('lloyd', true, CAST(6 AS INTEGER)), ('minibatch', true, 6), ('plus plus', true, 6), ('random', true, 6)) t(how, holds_all, parts)")
def kmeans_trained(s, d):
    c, n = corpus(s, d).select("id", "v"), size(s, d)
    first = kmeans.inertia_of(kmeans.assign(c, kmeans.random_init(c, 6, 1))).first()[0]
    full, few = kmeans.lloyd(c, 6, 8, seed=1), kmeans.minibatch(c, 6, 6, 128)
    seeds = {"plus plus": kmeans.plus_plus_init(c, 6, 2), "random": kmeans.random_init(c, 6, 2)}
    rows = [("lloyd", bool(full.sizes.sum() == n and full.inertia <= first), full.k), ("minibatch", bool(few.sizes.sum() == n), few.k)]
    rounded = F.transform(V.doubles("v"), lambda x: F.round(x, 6)).alias("v")
    for name, m in seeds.items():  # the seeds, not the table, are broadcast
        own = F.broadcast(s.createDataFrame([(x.tolist(),) for x in m], "v array<double>").select(rounded).distinct())
        rows.append((name, c.select(rounded).join(own, "v").distinct().count() == 6, len(m)))
    return s.createDataFrame(rows, "how string, holds_all boolean, parts int")


@query("k AS (" + _sample("corpus", "7", 5) + f") {_long('k')}")
def uniform_sample(s, d):
    return long(kmeans.uniform_sample(corpus(s, d).select("id", "v"), 7, 5))


@query(_CENTRED + f" SELECT id FROM cen ORDER BY -ln({_u(4, 'id')}) * exp(2 * sqrt(list_inner_product(w, w))), id LIMIT 50")
def dense_sample(s, d):
    return kmeans.dense_sample(corpus(s, d).select("id", "v"), 50, 2.0, 4).select("id")


@query("SELECT 5 AS partitions, 200 AS sample_size, CAST(nc AS BIGINT) AS corpus_size, round(200 / nc, 6) AS share, 40.0::DOUBLE AS samples_per_centre FROM nc")
def fit_on_sample(s, d):
    f = kmeans.fit_on_sample(corpus(s, d).select("id", "v"), 5, 200)
    return s.createDataFrame([(f.partitions, f.sample_size, f.corpus_size, round(f.share, 6), f.samples_per_centre)], "partitions int, sample_size int, corpus_size long, share double, samples_per_centre double")


@query("SELECT round(avg(CASE WHEN l.part = p.part THEN 1 ELSE 0 END), 6) AS share FROM truth t JOIN lists l USING (id) JOIN probes p ON p.qid = t.qid AND p.nth = 1")
def same_partition_share(s, d):
    mine = ivf.probes(asked(s, d), centres(s, d), 1).select("qid", "part")
    return kmeans.neighbours_in_the_same_partition(truth(s, d), kmeans.assign(corpus(s, d), centres(s, d)), mine).select(six("share"))


@query(_GRAPH + " SELECT 0.6::DOUBLE AS recall")
def graph_recall(s, d):
    g = _graph(s, d)
    return graphs.recall_against_exact(g.filter("ord <= 3"), g).select(six("recall"))


@query("SELECT true AS close")
def nn_descent_recall(s, d):
    c = corpus(s, d).select("id", "v")
    r = graphs.recall_against_exact(graphs.nn_descent(c, 10, 6, 20), _graph(s, d, 10))
    return r.select((F.col("recall") >= 0.8).alias("close"))


@query(
    "allp AS (SELECT a.id AS src, b.id AS dst, pow(list_distance(a.v, b.v), 2) AS score FROM corpus a, corpus b WHERE a.id <> b.id), g AS (SELECT * FROM allp QUALIFY row_number() OVER (PARTITION BY src ORDER BY score, dst) <= 10), "
    "f AS (SELECT src, dst FROM g QUALIFY row_number() OVER (PARTITION BY src ORDER BY score, dst) = 1), "
    "o AS (SELECT g.src, g.dst FROM g JOIN f USING (src) JOIN allp k ON k.src = f.dst AND k.dst = g.dst WHERE 1.44 * k.score > g.score QUALIFY row_number() OVER (PARTITION BY g.src ORDER BY g.score, g.dst) = 1) "
    "SELECT src, dst, CAST(1 AS INTEGER) AS ord FROM f UNION ALL SELECT src, dst, 2 FROM o"
)
def graph_prune_two(s, d):
    return graphs.prune(corpus(s, d), _graph(s, d, 10), 2, 1.2)


# -- codes -------------------------------------------------------------------------------------


@query(
    "rg AS (SELECT min(x) AS lo, greatest(max(x) - min(x), 1e-12) AS span FROM dims), qr AS (SELECT min(x) AS lo, greatest(max(x) - min(x), 1e-12) AS span FROM (SELECT unnest(q) AS x FROM queries)), "
    "dec AS (SELECT id, list_transform(v, lambda x: least(255, greatest(0, round_even((x - lo) / span * 255, 0))) * (span / 255) + lo) AS v FROM corpus, rg), "
    "dq AS (SELECT qid, list_transform(q, lambda x: least(255, greatest(0, round_even((x - lo) / span * 255, 0))) * (span / 255) + lo) AS q FROM queries, qr) "
    + _OUT + "(" + _top("(SELECT qid, id, pow(list_distance(q, v), 2) AS score FROM dq, dec)") + ")"
)
def scalar_symmetric(s, d):
    return out(codes.scalar_search(asked(s, d), _scalar(s, d), K, True))


@query(
    _STAGES + ", a AS (SELECT avg(list_distance(rest, list_transform(c, lambda x: x * 0.25))) AS two FROM s2 JOIN book ON code = code2), b AS (SELECT avg(sqrt(list_inner_product(rest, rest))) AS one, avg(sqrt(list_inner_product(v, v))) AS whole FROM l1) "
    "SELECT CAST(1 AS INTEGER) AS stage, round(one / whole, 6) AS left FROM b UNION ALL SELECT 2, round(two / whole, 6) FROM a, b"
)
def residual_norms(s, d):
    b = _stages(s, d)
    return codes.residual_norms(corpus(s, d), b, b.encode(corpus(s, d))).select("stage", six("left"))


_RESIDUAL = _STAGES + ", rdec AS (SELECT id, list_transform(list_zip(a.c, b.c), lambda z: z[1] + 0.25 * z[2]) AS v FROM s2 JOIN book a ON a.code = code1 JOIN book b ON b.code = code2), rscan AS (SELECT qid, id, round(pow(list_distance(q, v), 2), 9) AS score FROM queries, rdec)"


@query(_RESIDUAL + " " + _OUT + "(" + _top("rscan") + ")")
def residual_index_scan(s, d):
    i = codes.ResidualIndex(64, 2, 16).build(corpus(s, d).select("id", "v"), _stages(s, d))
    return out(i.search(asked(s, d), K).result)


@query(_RESIDUAL + f", few AS ({_top('(SELECT p.qid, p.id, p.score FROM pairs p JOIN (' + _top('rscan', 60) + ') r USING (qid, id))')}), " + _filled("few"))
def residual_index_rerank(s, d):
    i = codes.ResidualIndex(64, 2, 16, 60).build(corpus(s, d).select("id", "v"), _stages(s, d))
    return out(i.search(asked(s, d), K).result)


_BINARY = "mean AS (SELECT list(m ORDER BY dim) AS m FROM (SELECT dim, avg(x) AS m FROM dims GROUP BY dim)), bscan AS (SELECT qid, id, list_sum(list_transform(list_zip(q, v, m), lambda z: CASE WHEN (z[1] - z[3] > 0) <> (z[2] - z[3] > 0) THEN 1 ELSE 0 END))::DOUBLE AS score FROM queries, corpus, mean)"


@query(_BINARY + " " + _OUT + "(" + _top("(SELECT p.qid, p.id, p.score FROM pairs p JOIN (" + _top("bscan", 40) + ") r USING (qid, id))") + ")")
def binary_index_rerank(s, d):
    return out(codes.BinaryIndex(64, 40).build(corpus(s, d).select("id", "v")).search(asked(s, d), K).result)


@query("SELECT nq * (nc / 32 + 40) AS distances, CAST(nq * nc AS BIGINT) AS candidates, CAST(0 AS BIGINT) AS hops, CAST(nq AS BIGINT) AS queries FROM nq, nc")
def binary_index_cost(s, d):
    return codes.BinaryIndex(64, 40).build(corpus(s, d).select("id", "v")).search(asked(s, d), K).stats


@query("SELECT id, CAST(dim AS INTEGER) AS dim, b FROM (SELECT id, unnest(list_transform(v, lambda x: x > 0)) AS b, unnest(range(0, 64)) AS dim FROM corpus)")
def unpacked_signs(s, d):
    words = codes.SignCodes(64).encode(corpus(s, d))
    return words.select("id", F.posexplode(codes.unpack(F.col("words"), 64)).alias("dim", "b"))


@query(_eye(64))
def rotation_pca(s, d):
    r = codes.pca_rotation(corpus(s, d).select("id", "v"), 8)
    return ints(r @ r.T, s)


@query("SELECT id, round(list_inner_product(v, v), 6) AS length FROM corpus")
def rotated_lengths(s, d):
    return codes.rotate(corpus(s, d), codes.random_rotation(64, 9)).select("id", F.round(V.dot("v", "v"), 6).alias("length"))


@query(_BOOKS + " " + _OUT + "(" + _top("(SELECT qid, id, sum(pow(list_distance(q[s * 8 + 1 : s * 8 + 8], c), 2)) AS score FROM queries, enc JOIN books USING (s, code) GROUP BY qid, id)", order="round(score, 9), id") + ")")
def rotated_search(s, d):
    r = codes.Rotated(_books(s, d), codes.identity_rotation(64))
    return out(r.search(asked(s, d), r.encode(corpus(s, d)), K))


@query("SELECT * FROM (VALUES ('product', true, CAST(8 AS INTEGER)), ('residual', true, 2), ('rotated', true, 8)) t(kind, better_than_mean, codes)")
def trained_books(s, d):
    c = corpus(s, d).select("id", "v")
    spread = codes.subspace_variance(c, 1).first()[1]  # what is left when all rows are coded by their mean
    p, r, t = codes.product_train(c, 8, 16), codes.residual_fit(c, 2, 16), codes.train_rotated(c, 8, 16, "pca")
    turned = codes.rotate(c, t.rotation)
    left = {
        "product": (codes.reconstruction_error(c, p.decode(p.encode(c))), p.encode(c)),
        "residual": (codes.reconstruction_error(c, r.decode(r.encode(c))), r.encode(c)),
        "rotated": (codes.reconstruction_error(turned, t.books.decode(t.encode(c))), t.encode(c)),
    }
    return s.createDataFrame([(k, bool(e.first()[0] < spread), len(x.first().codes)) for k, (e, x) in left.items()], "kind string, better_than_mean boolean, codes int")


# -- predicates --------------------------------------------------------------------------------


@query(f"SELECT id FROM corpus QUALIFY row_number() OVER (ORDER BY {_h(6, 'id')}, id) <= round_even((SELECT nc FROM nc) * 0.1, 0)")
def predicate_random(s, d):
    return filtered.random_predicate(corpus(s, d), 0.1, 6)


@query("SELECT c.id FROM corpus c, (SELECT v FROM corpus WHERE id = 8) p QUALIFY row_number() OVER (ORDER BY pow(list_distance(c.v, p.v), 2), c.id) <= round_even((SELECT nc FROM nc) * 0.1, 0)")
def predicate_clustered(s, d):
    return filtered.clustered_predicate(corpus(s, d), 0.1, 8)


@query("wide AS (" + _top("pairs", 60) + ") " + _OUT + "(" + _top("(SELECT w.* FROM wide w JOIN corpus c USING (id) WHERE label = 3)") + ")")
def filter_during_walk(s, d):
    g = sharded.GraphIndex(64, 32, 32, shards=2).build(corpus(s, d).select("id", "v"))
    return out(filtered.filter_walk(g.search(asked(s, d), 60, ef=10**6).result, corpus(s, d).filter("label = 3"), K))


# -- serving -----------------------------------------------------------------------------------


@fixed("SELECT * FROM (VALUES (CAST(1 AS INTEGER), 60.0::DOUBLE, 40.0::DOUBLE, false), (2, 40.0, 0.0, true), (3, 0.0, 0.0, true)) t(step, allowed, remaining, exhausted)")
def budget_charges(s, d):
    b, rows = serving.Budget(100.0), []
    for i, x in enumerate((60.0, 70.0, 10.0)):
        rows.append((i + 1, b.charge(x), b.remaining, b.exhausted))
    return s.createDataFrame(rows, "step int, allowed double, remaining double, exhausted boolean")


@query(_OPEN + ", a AS (SELECT qid, sum(least(n, greatest(0, 90 - before))) AS took, sum(n) AS every FROM o GROUP BY qid) SELECT qid, CAST(took + 10 AS BIGINT) AS spent, took < every AS truncated FROM a")
def budget_spent(s, d):
    return serving.bounded_search(*_served(s, d), 10, K, 100)[1]


@query("SELECT 1.0::DOUBLE AS slots, 1.0::DOUBLE AS sets")
def fleet_agreement(s, d):
    fleet = serving.build_fleet(corpus(s, d).select("id", "v"), 64, 3, 4, 4)
    return serving.agreement(serving.tagged({n: i.search(asked(s, d), K).result for n, i in fleet.items()})).select(six("slots"), six("sets"))


@query(_OUT + "(SELECT * FROM truth WHERE rank <= 4)")
def shortlist_exact(s, d):
    return out(serving.exact_shortlist(asked(s, d), corpus(s, d), 50, size(s, d)).as_neighbours(4))


@query(_OUT + "rough")
def shortlist_of_lists(s, d):
    return out(serving.partition_shortlist(asked(s, d), materialise(lists(s, d)), centres(s, d), K, 2, 100.0).rows)


@fixed(_eye(12))
def shortlist_projection(s, d):
    p = serving.projection(64, 12, 4)
    return ints(p @ p.T, s)


@query("SELECT qid, rank, id, round(score, 6) AS score, 'flat' AS tier FROM truth")
def route_always(s, d):
    r = serving.always(serving.Tier("flat", index.FlatIndex(64).build(corpus(s, d).select("id", "v")), 1.0), asked(s, d), K)
    return r.found.select("qid", F.col("rank").cast("int").alias("rank"), "id", six("score"), "tier")


_SPREAD = "sg AS (SELECT qid, max(score) - min(score) AS signal FROM rough GROUP BY qid), ch AS (SELECT qid FROM sg QUALIFY row_number() OVER (ORDER BY signal DESC, qid) <= round_even((SELECT nq FROM nq) * 0.25, 0))"


@query(_SPREAD + " SELECT qid, rank, id, round(score, 6) AS score FROM (SELECT * FROM rough WHERE qid NOT IN (SELECT qid FROM ch) UNION ALL SELECT * FROM truth WHERE qid IN (SELECT qid FROM ch))")
def escalated_answers(s, d):
    c = corpus(s, d).select("id", "v")
    cheap, dear = serving.Tier("ivf", _index(s, d), 100.0), serving.Tier("flat", index.FlatIndex(64).build(c), float(size(s, d)))
    return out(serving.escalate(cheap, dear, asked(s, d), K, serving.result_spread, 0.25).found)


@query(_SPREAD + " SELECT round((SELECT count(*) FROM ch) / nq, 6) AS escalation_rate, round(100 + nc * (SELECT count(*) FROM ch) / nq, 6) AS distances_per_query FROM nq, nc")
def escalation_cost(s, d):
    c = corpus(s, d).select("id", "v")
    cheap, dear = serving.Tier("ivf", _index(s, d), 100.0), serving.Tier("flat", index.FlatIndex(64).build(c), float(size(s, d)))
    r = serving.escalate(cheap, dear, asked(s, d), K, serving.result_spread, 0.25)
    return s.createDataFrame([(round(r.escalation_rate, 6), round(r.distances_per_query, 6))], "escalation_rate double, distances_per_query double")


@query(
    _SHORT + ", hit AS (SELECT count(s.id) / (SELECT count(*) FROM truth) AS r FROM truth t JOIN short s USING (qid, id)) "
    "SELECT round(r, 6) AS shortlist_recall, round(r, 6) AS final_recall, nc / 32 AS first_stage_cost, 50.0::DOUBLE AS rerank_cost, nc / 32 + 50 AS total_cost FROM hit, nc"
)
def staged_costs(s, d):
    short = serving.sign_shortlist(asked(s, d), corpus(s, d), 50, size(s, d), 64)
    row = serving.staged_search(asked(s, d), corpus(s, d), truth(s, d), short, 50, K)[1]
    return row.select(six("shortlist_recall"), six("final_recall"), "first_stage_cost", "rerank_cost", "total_cost")


@query("SELECT qid, round(max(score) / greatest(min(score), 1e-9), 6) AS signal FROM truth WHERE rank IN (2, 3) GROUP BY qid")
def margin_signal(s, d):
    return serving.margin(exact.without_own(truth(s, d), 2)).select("qid", six("signal"))


@query(f"SELECT qid FROM queries QUALIFY row_number() OVER (ORDER BY {_h(3, 'qid')} DESC, qid) <= round_even((SELECT nq FROM nq) * 0.4, 0)")
def random_split(s, d):
    return serving.random_split(asked(s, d), 0.4, 3)


# -- storage -----------------------------------------------------------------------------------


@query(f"SELECT CAST({_h(2, 'id')} % 7 AS INTEGER) AS shard, count(*) AS n FROM corpus GROUP BY 1")
def shards_random(s, d):
    return storage.random_shards(corpus(s, d), 7, 2).groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT CAST(part AS INTEGER) AS shard, id FROM lists")
def shards_clustered(s, d):
    return storage.clustered_shards(corpus(s, d), centres(s, d)).select("shard", "id")


@fixed("SELECT CAST(d AS INTEGER) AS dimension, CAST(4096 // (4 * d) AS INTEGER) AS vectors FROM (SELECT unnest([8, 32, 64, 768, 1024]) AS d)")
def vectors_per_page(s, d):
    return s.createDataFrame([(n, storage.vectors_per_page(n)) for n in (8, 32, 64, 768, 1024)], "dimension int, vectors int")


@query(
    "touched AS (SELECT qid, l.id FROM probes JOIN lists l USING (part) WHERE nth <= 2), lay AS (SELECT id, (row_number() OVER (ORDER BY part, id) - 1) // 16 AS page FROM lists), "
    "p AS (SELECT qid, count(*) AS v, count(DISTINCT page) AS p FROM touched JOIN lay USING (id) GROUP BY qid) SELECT round(avg(p), 6) AS pages_per_query, round(avg(v), 6) AS vectors_per_query, count(*) AS queries FROM p"
)
def disk_stats(s, d):
    opened = ivf.probes(asked(s, d), centres(s, d), 2).select("qid", "part")
    return storage.disk_stats(storage.list_page_counts(opened, lists(s, d), storage.clustered_layout(lists(s, d), 64))).select(six("pages_per_query"), six("vectors_per_query"), "queries")


def _saved(s, d) -> dict:
    """Saved and loaded again, rows removed before."""
    import uuid

    made = {
        "flat": index.FlatIndex(64), "ivf": ivf.IVFIndex(64, 5, "l2", 5), "spill": ivf.SpillIndex(64, 5, 5), "binary": codes.BinaryIndex(64, size(s, d)),
        "tree": sharded.TreeIndex(64, shards=2), "forest": sharded.ForestIndex(64, 2, 10**6, shards=2), "graph": sharded.GraphIndex(64, 32, 32, 10**6, shards=2), "hnsw": sharded.HNSWIndex(64, 16, 10**6, shards=2),
    }
    gone, loaded = materialise(corpus(s, d).filter("id % 5 = 0").select("id")), {}
    for name, i in made.items():
        path = f"{checkpoint_dir(s)}/saved-{uuid.uuid4().hex}"
        i.build(corpus(s, d).select("id", "v")).remove(gone)
        storage.save(i, path, {"of": name})
        loaded[name] = storage.load(s, path), storage.peek(s, path)
    return loaded


@query(
    "live AS (" + _top("(SELECT * FROM pairs WHERE id % 5 <> 0)") + ") SELECT k AS kind, qid, rank, id, round(score, 6) AS score FROM live, (SELECT unnest(['flat', 'ivf', 'spill', 'binary', 'tree', 'forest', 'graph', 'hnsw']) AS k)"
)
def saved_indexes(s, d):
    rows = None
    for name, (i, _) in _saved(s, d).items():
        part = i.search(asked(s, d), K).result.select(F.lit(name).alias("kind"), "qid", F.col("rank").cast("int").alias("rank"), "id", six("score"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("SELECT k AS kind, CAST(64 AS INTEGER) AS dimension, CAST(nc AS BIGINT) AS count, CAST(nc - (SELECT count(*) FROM corpus WHERE id % 5 = 0) AS BIGINT) AS live, 'l2' AS metric, k AS note FROM nc, (SELECT unnest(['flat', 'ivf', 'spill', 'binary', 'tree', 'forest', 'graph', 'hnsw']) AS k)")
def saved_headers(s, d):
    rows = [(h.kind, h.dimension, h.count, h.live, h.metric, h.detail["notes"]["of"]) for _, h in _saved(s, d).values()]
    return s.createDataFrame(rows, "kind string, dimension int, count long, live long, metric string, note string")


@query("SELECT * FROM (VALUES ('a number changed', false), ('a row less', false), ('dealt anew', true)) t(what, same)")
def digests(s, d):
    c = corpus(s, d).select("id", "v")
    own = storage.digest_of(c)
    rows = {"dealt anew": c.repartition(5), "a row less": c.filter("id <> 7"), "a number changed": c.select("id", F.when(F.col("id") == 7, V.times("v", 1.5).cast("array<float>")).otherwise(F.col("v")).alias("v"))}
    return s.createDataFrame([(k, storage.digest_of(x) == own) for k, x in rows.items()], "what string, same boolean")


# -- measures and reports ----------------------------------------------------------------------


@query(f"SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_h(7, 'qid', 'id')}, id) AS INTEGER) AS rank FROM truth")
def shuffled_answers(s, d):
    return evaluate.shuffled(truth(s, d), 7).select("qid", "id", F.col("rank").cast("int").alias("rank"))


@query("SELECT 'flat' AS index, CAST(seed AS INTEGER) AS seed, 1.0::DOUBLE AS recall, nc AS distances FROM nc, range(0, 3) r(seed)")
def across_seeds(s, d):
    return evaluate.across_seeds(lambda seed: index.FlatIndex(64), corpus(s, d).select("id", "v"), asked(s, d), K, range(3))


_RUNS = [("a", 0, 0.5, 100.0), ("a", 1, 0.6, 120.0), ("a", 2, 0.7, 90.0), ("b", 0, 0.9, 400.0), ("b", 1, 0.9, 410.0)]
_RUNS_SQL = "r AS (SELECT * FROM (VALUES ('a', 0, 0.5::DOUBLE, 100.0::DOUBLE), ('a', 1, 0.6, 120.0), ('a', 2, 0.7, 90.0), ('b', 0, 0.9, 400.0), ('b', 1, 0.9, 410.0)) t(index, seed, recall, distances))"


def _runs(s) -> DataFrame:
    return s.createDataFrame(_RUNS, "index string, seed int, recall double, distances double")


@fixed(_RUNS_SQL + " SELECT index, count(*) AS seeds, round(avg(recall), 6) AS mean, round(stddev_samp(recall), 6) AS deviation, round(max(recall) - min(recall), 6) AS range, round(max(distances) - min(distances), 6) AS cost_range FROM r GROUP BY index")
def seed_spread(s, d):
    return evaluate.spread(_runs(s)).select("index", "seeds", *map(six, ("mean", "deviation", "range", "cost_range")))


@query(
    "p AS (SELECT unnest([1, 2, 4, 8]) AS value), f AS (SELECT value, qid, p.id, row_number() OVER (PARTITION BY value, qid ORDER BY p.score, p.id) AS rank FROM p v(value), pairs p JOIN probes USING (qid) JOIN lists l ON l.id = p.id AND l.part = probes.part WHERE nth <= value), "
    "r AS (SELECT v.value, t.qid, count(f.id) AS hit FROM p v, truth t LEFT JOIN f ON f.value = v.value AND f.qid = t.qid AND f.id = t.id AND f.rank <= 10 GROUP BY v.value, t.qid), "
    "b AS (SELECT hit < lag(hit) OVER (PARTITION BY qid ORDER BY value) AS fell FROM r) SELECT count(*) FILTER (fell) AS drops FROM b"
)
def recall_drops(s, d):
    rows = None
    for v in (1, 2, 4, 8):
        part = evaluate.per_query_recall(truth(s, d), rough(s, d, v), K).withColumn("value", F.lit(v))
        rows = part if rows is None else rows.unionByName(part)
    return evaluate.drops(rows)


@fixed("SELECT round(0.5 + 0.4 * (400 - 100) / (900 - 100), 6) AS recall, true AS meet, false AS apart, round(0.17 / sqrt(64), 6) AS error")
def small_measures(s, d):
    row = (round(serving.interpolated((100.0, 0.5), (900.0, 0.9), 400.0), 6), evaluate.overlaps((0.1, 0.4), (0.3, 0.6)), evaluate.overlaps((0.1, 0.2), (0.3, 0.6)), round(evaluate.standard_error(64), 6))
    return s.createDataFrame([row], "recall double, meet boolean, apart boolean, error double")


_MEASURED = [("ivf", "g", "p4", 0.5, 300.0, 10, 20), ("ivf", "g", "p8", 0.8, 600.0, 10, 20), ("flat", "g", "all", 1.0, 4096.0, 10, 20), ("lsh", "g", "t8", 0.3, 900.0, 10, 20), ("ivf", "h", "p4", 0.9, 300.0, 10, 20)]
_MEASURED_SQL = "m AS (SELECT * FROM (VALUES ('ivf', 'g', 'p4', 0.5::DOUBLE, 300.0::DOUBLE), ('ivf', 'g', 'p8', 0.8, 600.0), ('flat', 'g', 'all', 1.0, 4096.0), ('lsh', 'g', 't8', 0.3, 900.0), ('ivf', 'h', 'p4', 0.9, 300.0)) t(index, corpus, setting, recall, distances))"


def _report(s) -> evaluate.Report:
    return evaluate.Report(s.createDataFrame(_MEASURED, evaluate.ROW), {"g": 4096, "h": 2048}).checked()


@query(_MEASURED_SQL + " SELECT index, corpus, setting, round(CASE corpus WHEN 'g' THEN 4096 ELSE 2048 END / distances, 6) AS speedup FROM m")
def report_speedup(s, d):
    return _report(s).with_speedup().select("index", "corpus", "setting", six("speedup"))


@query(_MEASURED_SQL + " SELECT index, setting, recall FROM m WHERE index = 'ivf' AND corpus = 'g' UNION ALL SELECT 'new', 'x', 0.1")
def report_rows(s, d):
    new = {"index": "new", "corpus": "g", "setting": "x", "recall": 0.1, "distances": 1.0, "memory_bytes": 1, "queries": 1}
    r = _report(s).add(new)
    return r.for_index("ivf").filter("corpus = 'g'").unionByName(r.for_corpus("g").filter("index = 'new'")).select("index", "setting", "recall")


@fixed("SELECT * FROM (VALUES ('ivf', 0.8::DOUBLE), ('lsh', 0.3), ('flat', 0.0)) t(index, recall)")
def compare_at_a_budget(s, d):
    return evaluate.compare_at_a_budget(_report(s), "g", 1000.0).select("index", six("recall"))


@query("SELECT c.id AS qid FROM corpus c, (SELECT v FROM corpus WHERE id = 8) e ORDER BY pow(list_distance(c.v, e.v), 2) DESC, c.id LIMIT 12")
def far_from_entry(s, d):
    e = corpus(s, d).filter("id = 8").first().v
    return evaluate.far_from(corpus(s, d), codes.literal(e), 12).select("qid")


# -- streams -----------------------------------------------------------------------------------


@fixed("SELECT CAST(b AS INTEGER) AS batch, round((b - 1) / 50, 6) AS worst, round((b - 1) / 100, 6) AS mean FROM (SELECT unnest([1, 8, 32]) AS b)")
def waiting_cost(s, d):
    rows = [(b, round(batches.waiting_cost(50.0, b)["worst"], 6), round(batches.waiting_cost(50.0, b)["mean"], 6)) for b in (1, 8, 32)]
    return s.createDataFrame(rows, "batch int, worst double, mean double")


@fixed("SELECT CAST(40 AS BIGINT) AS queries, CAST(2 AS BIGINT) AS batches, 50.0::DOUBLE AS corpus_bytes_per_query, 20.0::DOUBLE AS mean_batch")
def batch_stats(s, d):
    b = batches.BatchStats()
    b.record(32, 1000)
    b.record(8, 1000)
    return s.createDataFrame([(b.queries, b.batches, b.corpus_bytes_per_query, b.mean_batch)], "queries long, batches long, corpus_bytes_per_query double, mean_batch double")


@query("SELECT qid, (row_number() OVER (ORDER BY qid) - 1) // 8 AS batch FROM queries")
def batch_numbers(s, d):
    c = corpus(s, d)
    return batches.batched_search(asked(s, d), lambda q: exact.search(q, c, 1), 8)[0].select("qid", F.col("batch").cast("long").alias("batch"))


_REPLAY = f"few AS (SELECT q, row_number() OVER (ORDER BY qid) - 1 AS number FROM queries), fw AS (SELECT * FROM few WHERE number < 16), st AS (SELECT range AS qid, q FROM range(0, 256) JOIN fw ON {_h(9, 'range')} % 16 = number)"


@query(_REPLAY + f" {_long('st', 'qid', 'q')}")
def replayed_stream(s, d):
    return long(batches.replayed_stream(asked(s, d), 256, 16, 9), "qid", "q")


@query(_REPLAY + f", k AS (SELECT qid, list_transform(list_zip(q, {_unit(_normals(64, 10, 'qid'))}), lambda z: z[1] + 0.05 * z[2]) AS q FROM st) {_long('k', 'qid', 'q')}")
def perturbed_stream(s, d):
    return long(batches.perturbed_stream(asked(s, d), 256, 16, 0.05, 9), "qid", "q")


@query(_STREAM + ", f AS (SELECT qid, min(qid) OVER (PARTITION BY q) AS served_by FROM st) SELECT qid, served_by, qid <> served_by AS hit, (SELECT count(*) FROM f o WHERE o.qid = o.served_by AND o.qid < f.qid) AS lookup_distances FROM f")
def near_cache_at_zero(s, d):
    return batches.run_cache(_stream(s, d), 0.0, 4096).select("qid", "served_by", "hit", "lookup_distances")


@query(
    _STREAM + ", f AS (SELECT qid, qid <> min(qid) OVER (PARTITION BY q) AS hit FROM st) SELECT count(*) AS queries, count(*) FILTER (hit) AS hits, CAST(0 AS BIGINT) AS lookup_distances, "
    "round(count(*) FILTER (hit) / count(*), 6) AS hit_rate, CAST(500 * count(*) FILTER (hit) AS DOUBLE) AS saved_distances, CAST(500 * count(*) FILTER (hit) AS DOUBLE) AS net_saving FROM f"
)
def cache_stats(s, d):
    r = batches.cache_stats(batches.run_cache(_stream(s, d), None, 4096, 32), 500.0)
    return r.select("queries", "hits", "lookup_distances", six("hit_rate"), "saved_distances", "net_saving")


@query(_OUT + "truth")
def streamed_answers(s, d):
    import uuid

    home = f"{checkpoint_dir(s)}/stream-{uuid.uuid4().hex}"
    asked(s, d).write.parquet(f"{home}/in")
    stream = s.readStream.schema(asked(s, d).schema).parquet(f"{home}/in")
    batches.answer_stream(stream, index.FlatIndex(64).build(corpus(s, d).select("id", "v")), K, f"{home}/out", f"{home}/state")
    return out(s.read.parquet(f"{home}/out").select("qid", "rank", "id", "score"))


# -- verification and command line -------------------------------------------------------------


@fixed("SELECT i AS index, r AS rule, CAST(0 AS BIGINT) AS violations FROM (SELECT unnest(['flat', 'tree']) AS i), (SELECT unnest(['returns_k_results', 'identifiers_are_distinct', 'identifiers_are_in_range', 'scores_agree_with_identifiers', 'results_are_ordered', 'the_nearest_is_within_the_exact_kth']) AS r)")
def verify_sweep(s, d):
    return verify.sweep(s, ("flat", "tree"), 8, 96, 6).groupBy("index", "rule").agg(F.sum("violations").alias("violations"))


@fixed("SELECT CAST(14 AS INTEGER) AS structures, CAST(4 AS INTEGER) AS corpora, CAST(11 AS INTEGER) AS indexes, CAST(5 AS INTEGER) AS awkward, true AS clean")
def verify_lists(s, d):
    report = s.createDataFrame([("a", 0), ("b", 0)], "rule string, violations long")
    row = (len(verify.every_structure(32)), len(verify.standard_corpora(s)), len(verify.every_index()), len(verify.awkward_corpora(s)), verify.clean(verify.by_rule(report)))
    return s.createDataFrame([row], "structures int, corpora int, indexes int, awkward int, clean boolean")


@fixed("SELECT * FROM (VALUES ('bad index', CAST(1 AS INTEGER), false), ('measure', 0, true)) t(command, code, ok)")
def command_line(s, d):
    runs = {"measure": ["measure", "--index", "flat", "--count", "200", "--dimension", "8", "--queries", "20", "--json"], "bad index": ["measure", "--index", "none", "--count", "200", "--dimension", "8"]}
    made = {n: cli.dispatch(a, s) for n, a in runs.items()}
    return s.createDataFrame([(n, o.code, o.ok and '"recall": 1.0' in o.output) for n, o in made.items()], "command string, code int, ok boolean")
