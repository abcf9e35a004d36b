"""Registered queries of the retrieval engine, and the same in DuckDB SQL.

Fixtures come from ``embeddings``: the corpus is all of its rows, queries are those whose id
is divisible by 20, centres the mean vectors of the labels, scaled vectors ``v * (1 + id % 8)``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vector as V
from .operators import codes, exact, filtered, graphs, hashing, index, ivf, kmeans, sharded
from .plans import evaluate, serving, storage, verify
from .plans.lineage import materialise
from .sources import datasets, drift
from .streaming import batches

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = 10


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = "WITH RECURSIVE " + BASE + (", " + sql if not sql.lstrip().upper().startswith("SELECT") else " " + sql)
        return f

    return put


#: Checks of small arithmetic that read no table: run by the tests, registered nowhere.
FIXED: dict = {}
FIXED_SQL: dict[str, str] = {}


def fixed(sql: str):
    def put(f):
        FIXED[f.__name__] = f
        FIXED_SQL[f.__name__] = "WITH RECURSIVE " + BASE + (", " + sql if not sql.lstrip().upper().startswith("SELECT") else " " + sql)
        return f

    return put


# -- fixtures ----------------------------------------------------------------------------------


def table(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label"))


def corpus(s: SparkSession, d: str) -> DataFrame:
    return table(s, d)


def asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d).filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))


def scaled(s: SparkSession, d: str) -> DataFrame:
    return corpus(s, d).select("id", V.times("v", 1 + F.pmod("id", F.lit(8))).alias("v"))


def label_centres(s: SparkSession, d: str) -> DataFrame:
    x = corpus(s, d).select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda e: e["m"]).alias("c")).select(F.col("label").alias("part"), "c")


def centres(s: SparkSession, d: str) -> np.ndarray:
    return kmeans.centres_of(label_centres(s, d))


def lists(s: SparkSession, d: str) -> DataFrame:
    return kmeans.assign(corpus(s, d), centres(s, d)).select("part", "id", "v")


def truth(s: SparkSession, d: str, k: int = K) -> DataFrame:
    return exact.search(asked(s, d), corpus(s, d), k)


def others(s: SparkSession, d: str, k: int = K) -> DataFrame:
    """Exact neighbours of the queries among other rows than their own."""
    return exact.without_own(exact.search(asked(s, d), corpus(s, d), k + 1), k)


def size(s: SparkSession, d: str) -> int:
    return corpus(s, d).count()


def rough(s: SparkSession, d: str, probe: int = 2, k: int = K) -> DataFrame:
    """Neighbours in the ``probe`` nearest lists; lists are kept first, so a task scans them in one Python process, not two."""
    return ivf.ivf_search(asked(s, d), materialise(lists(s, d)), centres(s, d), k, probe)


def out(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("rank").cast("int").alias("rank"), "id", F.round("score", 6).alias("score"))


_TOP = "row_number() OVER (PARTITION BY qid ORDER BY score, id)"


def _top(source: str, k: int = K, order: str = "score, id", by: str = "qid") -> str:
    return f"SELECT qid, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"


BASE = f"""
corpus AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
queries AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
nq AS (SELECT count(*)::DOUBLE AS nq FROM queries),
nc AS (SELECT count(*)::DOUBLE AS nc FROM corpus),
scaled AS (SELECT id, list_transform(v, lambda x: x * (1 + id % 8)) AS v FROM corpus),
pairs AS (SELECT qid, id, label, pow(list_distance(q, v), 2) AS score FROM queries, corpus),
truth AS ({_top('pairs')}),
dims AS (SELECT id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM corpus),
centres AS (SELECT label AS part, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM dims GROUP BY label, dim) GROUP BY label),
filed AS (SELECT id, part, row_number() OVER (PARTITION BY id ORDER BY d, part) AS nth, d FROM
  (SELECT id, part, pow(list_distance(v, c), 2) AS d FROM corpus, centres)),
lists AS (SELECT part, filed.id, v, label FROM filed JOIN corpus USING (id) WHERE nth = 1),
probes AS (SELECT qid, part, row_number() OVER (PARTITION BY qid ORDER BY d, part) AS nth, d FROM
  (SELECT qid, part, pow(list_distance(q, c), 2) AS d FROM queries, centres)),
rough AS ({_top('(SELECT qid, p.id, p.score FROM pairs p JOIN probes USING (qid) JOIN lists l ON l.id = p.id AND l.part = probes.part WHERE nth <= 2)')}),
recalls AS (SELECT qid, count(r.id) / 10.0 AS recall FROM truth LEFT JOIN rough r USING (qid, id) GROUP BY qid)
"""
_OUT = "SELECT qid, rank, id, round(score, 6) AS score FROM "

def _filled(few: str) -> str:
    """A result whose short answers take the smallest ids that they lack."""
    return (
        f"have AS (SELECT q.qid, count(f.id) AS n FROM queries q LEFT JOIN {few} f USING (qid) GROUP BY q.qid), "
        f"spare AS (SELECT p.qid, p.id, p.score, row_number() OVER (PARTITION BY p.qid ORDER BY p.id) AS nth FROM pairs p ANTI JOIN {few} f ON p.qid = f.qid AND p.id = f.id) "
        + _OUT + "(" + _top(f"(SELECT qid, id, score FROM {few} UNION ALL SELECT s.qid, s.id, s.score FROM spare s JOIN have USING (qid) WHERE nth <= 10 - n)") + ")"
    )


# -- exact search ------------------------------------------------------------------------------


@query(_OUT + "truth")
def exact_l2(s, d):
    return out(truth(s, d))


@query("far AS (SELECT id, list_transform(v, lambda x: x + 1e7) AS v FROM corpus) " + _OUT + "(" + _top("(SELECT q.id AS qid, c.id, pow(list_distance(q.v, c.v), 2) AS score FROM far q, far c WHERE q.id % 20 = 0)") + ")")
def exact_far_from_zero(s, d):
    """Vectors whose distances are far smaller than their norms: all are moved by 10^7."""
    far = corpus(s, d).select("id", F.transform(V.doubles("v"), lambda x: x + 1e7).alias("v"))
    found = exact.search(far.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q")), far, K)
    return out(found)


@query(_OUT + "(" + _top("(SELECT qid, id, list_inner_product(q, v) AS score FROM queries, scaled)", order="score DESC, id") + ")")
def exact_ip_scaled(s, d):
    return out(exact.search(asked(s, d), scaled(s, d), K, "ip"))


@query(_OUT + "(" + _top("(SELECT qid, id, list_cosine_similarity(q, v) AS score FROM queries, scaled)", order="score DESC, id") + ")")
def exact_cosine_scaled(s, d):
    return out(exact.search(asked(s, d), scaled(s, d), K, "cosine"))


@query("self AS (SELECT a.id AS qid, b.id AS id, pow(list_distance(a.v, b.v), 2) AS score FROM corpus a, corpus b WHERE a.id <> b.id) " + _OUT + "(" + _top("self", 1) + ")")
def self_nearest(s, d):
    c = corpus(s, d)
    return out(
        graphs.exact_graph(c, 1).select(F.col("src").alias("qid"), F.col("ord").alias("rank"), F.col("dst").alias("id"), "score")
    )


@query("SELECT qid, round(sqrt(list_inner_product(v, v)), 6) AS length, round(list_inner_product(n, n), 6) AS unit FROM (SELECT id AS qid, v, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS n FROM scaled)")
def normalise(s, d):
    c = scaled(s, d).withColumn("n", V.normalise("v"))
    return c.select(F.col("id").alias("qid"), F.round(V.norm("v"), 6).alias("length"), F.round(V.dot("n", "n"), 6).alias("unit"))


_IP = _top("(SELECT qid, id, list_inner_product(q, v) AS score FROM queries, scaled)", order="score DESC, id")
_L2S = _top("(SELECT qid, id, pow(list_distance(q, v), 2) AS score FROM queries, scaled)")


@query(f"a AS ({_L2S}), b AS ({_IP}) SELECT round(avg(hit) / 10.0, 6) AS overlap FROM (SELECT a.qid, count(b.id) AS hit FROM a LEFT JOIN b USING (qid, id) GROUP BY a.qid)")
def overlap_l2_vs_ip(s, d):
    a, b = (exact.search(asked(s, d), scaled(s, d), K, m) for m in ("l2", "ip"))
    return exact.identifier_overlap(a, b, K).select(F.round("overlap", 6).alias("overlap"))


@query(f"a AS ({_L2S}), b AS ({_IP}) SELECT round(avg(CASE WHEN x = y THEN 1 ELSE 0 END), 6) AS agree FROM (SELECT qid, list(id ORDER BY id) AS x FROM a GROUP BY qid) JOIN (SELECT qid, list(id ORDER BY id) AS y FROM b GROUP BY qid) USING (qid)")
def orderings_agree(s, d):
    return exact.orderings_agree(asked(s, d), scaled(s, d), "l2", "ip", K).select(F.round("agree", 6).alias("agree"))


@query("SELECT round(avg(r.score - t.score), 6) AS gap FROM truth t JOIN rough r USING (qid, rank)")
def score_gap(s, d):
    return exact.score_gap(asked(s, d), corpus(s, d), truth(s, d), rough(s, d)).select(F.round("gap", 6).alias("gap"))


@query("SELECT count(*) AS trials, sum(CASE WHEN list_distance(a, c) > list_distance(a, b) + list_distance(b, c) + 1e-9 THEN 1 ELSE 0 END)::BIGINT AS violations FROM (SELECT x.v AS a, y.v AS b, z.v AS c FROM scaled x JOIN scaled y ON y.id = x.id + 1 JOIN scaled z ON z.id = x.id + 2)")
def triangle_inequality(s, d):
    c = scaled(s, d)
    t = c.select("id", F.col("v").alias("a")).join(c.select((F.col("id") - 1).alias("id"), F.col("v").alias("b")), "id").join(c.select((F.col("id") - 2).alias("id"), F.col("v").alias("c")), "id")
    return exact.triangle_violations(t, "l2")


# -- measures ----------------------------------------------------------------------------------


@query(
    "h AS (SELECT r.qid, r.rank, CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS hit FROM rough r LEFT JOIN truth t USING (qid, id)), "
    "m AS (SELECT avg(recall) AS recall, avg(gain) AS gain, avg(rr) AS rr FROM (SELECT qid, coalesce(sum(hit), 0) / 10.0 AS recall, coalesce(sum(hit / log2(rank + 1)), 0) / (SELECT sum(1 / log2(r + 1)) FROM range(1, 11) x(r)) AS gain, coalesce(max(hit / rank), 0) AS rr FROM queries LEFT JOIN h USING (qid) GROUP BY qid)), "
    "z AS (SELECT avg(sqrt(r.score) / greatest(sqrt(t.score), 1e-9)) AS ratio FROM truth t JOIN rough r USING (qid, rank)) "
    "SELECT round(recall, 6) AS recall, round(gain, 6) AS gain, round(rr, 6) AS reciprocal_rank, round(ratio, 6) AS distance_ratio FROM m, z"
)
def recall_gain_mrr_ratio(s, d):
    r = evaluate.score_all(truth(s, d), rough(s, d), K)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("SELECT qid, round(recall, 6) AS recall FROM recalls")
def per_query_recall(s, d):
    return evaluate.per_query_recall(truth(s, d), rough(s, d), K).select("qid", F.round("recall", 6).alias("recall"))


@query("SELECT round(m, 6) AS mean, round(e, 6) AS error, n AS samples, round(m - 1.96 * e, 6) AS low, round(m + 1.96 * e, 6) AS high FROM (SELECT avg(recall) AS m, stddev_samp(recall) / sqrt(count(*)) AS e, count(*) AS n FROM recalls)")
def recall_estimate(s, d):
    r = evaluate.estimate(evaluate.per_query_recall(truth(s, d), rough(s, d), K))
    return r.select(*[(F.round(c, 6) if c != "samples" else F.col(c)).alias(c) for c in r.columns])


@query("SELECT round(quantile_cont(recall, 0.01), 6) AS q0, round(quantile_cont(recall, 0.05), 6) AS q1, round(quantile_cont(recall, 0.1), 6) AS q2, round(quantile_cont(recall, 0.5), 6) AS q3 FROM recalls")
def recall_quantiles(s, d):
    r = evaluate.recall_quantiles(evaluate.per_query_recall(truth(s, d), rough(s, d), K))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


_ONE = _top("(SELECT qid, p.id, p.score FROM pairs p JOIN probes USING (qid) JOIN lists l ON l.id = p.id AND l.part = probes.part WHERE nth <= 1)")


@query(
    f"one AS ({_ONE}), ra AS (SELECT qid, count(r.id) / 10.0 AS a FROM truth LEFT JOIN one r USING (qid, id) GROUP BY qid) "
    "SELECT round(avg(recall - a), 6) AS mean, round(stddev_samp(recall - a) / sqrt(count(*)), 6) AS error, round(sqrt(var_samp(a) + var_samp(recall)) / sqrt(count(*)), 6) AS unpaired_error, count(*) AS samples FROM ra JOIN recalls USING (qid)"
)
def paired_difference(s, d):
    t = truth(s, d)
    r = evaluate.paired_difference(evaluate.per_query_recall(t, rough(s, d, 1), K), evaluate.per_query_recall(t, rough(s, d), K))
    return r.select(*[(F.round(c, 6) if c != "samples" else F.col(c)).alias(c) for c in r.columns])


@query("g AS (SELECT unnest([0.01, 0.02, 0.05, 0.1]) AS gap) SELECT CAST(gap AS DOUBLE) AS gap, CAST(ceil(pow(3.92 * s / CAST(gap AS DOUBLE), 2)) AS BIGINT) AS queries FROM g, (SELECT stddev_samp(recall) AS s FROM recalls)")
def queries_to_detect(s, d):
    return evaluate.queries_to_detect(evaluate.per_query_recall(truth(s, d), rough(s, d), K))


# -- filters -----------------------------------------------------------------------------------

def _match():
    return F.col("label") == 3



@query("SELECT sum(CASE WHEN label = 3 THEN 1 ELSE 0 END)::BIGINT AS matching, count(*) AS rows, round(avg(CASE WHEN label = 3 THEN 1 ELSE 0 END), 6) AS selectivity FROM corpus")
def filter_selectivity(s, d):
    return filtered.selectivity(corpus(s, d), _match()).select("matching", "rows", F.round("selectivity", 6).alias("selectivity"))


@query(_OUT + "(" + _top("(SELECT * FROM pairs WHERE label = 3)") + ")")
def filter_pre(s, d):
    return out(filtered.filter_then_search(asked(s, d), corpus(s, d), _match(), K))


@query(f"wide AS ({_top('pairs', 50)}) " + _OUT + "(" + _top("(SELECT w.* FROM wide w JOIN corpus c USING (id) WHERE label = 3)") + ")")
def filter_post_overfetch(s, d):
    return out(filtered.search_then_filter(asked(s, d), corpus(s, d), _match(), K, 5))


@query(_OUT + "(" + _top("(SELECT qid, p.id, p.score FROM pairs p JOIN probes USING (qid) JOIN lists l ON l.id = p.id AND l.part = probes.part WHERE nth <= 3 AND p.label = 3)") + ")")
def filter_in_lists(s, d):
    labelled = materialise(lists(s, d)).join(corpus(s, d).select("id", "label"), "id")
    return out(filtered.filter_in_lists(asked(s, d), labelled, centres(s, d), _match(), K, 3))


# -- lists -------------------------------------------------------------------------------------


@query("SELECT id, CAST(part AS INTEGER) AS part, round(d, 6) AS score FROM filed WHERE nth = 1")
def ivf_assign(s, d):
    return kmeans.assign(corpus(s, d), centres(s, d)).select("id", "part", F.round("score", 6).alias("score"))


@query("SELECT CAST(centres.part AS INTEGER) AS part, count(id) AS n FROM centres LEFT JOIN lists USING (part) GROUP BY centres.part")
def ivf_sizes(s, d):
    return ivf.list_sizes(lists(s, d), len(centres(s, d)))


@query("SELECT round(stddev_pop(n) / avg(n), 6) AS spread FROM (SELECT count(id) AS n FROM centres LEFT JOIN lists USING (part) GROUP BY centres.part)")
def ivf_spread(s, d):
    return ivf.partition_spread(ivf.list_sizes(lists(s, d), len(centres(s, d)))).select(F.round("spread", 6).alias("spread"))


@query(_OUT + "rough")
def ivf_search(s, d):
    return out(rough(s, d))


@query("SELECT round(sum(d), 6) AS inertia FROM filed WHERE nth = 1")
def ivf_inertia(s, d):
    return kmeans.inertia_of(kmeans.assign(corpus(s, d), centres(s, d))).select(F.round("inertia", 6).alias("inertia"))


@query(
    "p AS (SELECT unnest([1, 2, 4, 8]) AS value), f AS (SELECT value, qid, id, row_number() OVER (PARTITION BY value, qid ORDER BY score, id) AS rank FROM (SELECT value, qid, p.id, p.score FROM p v(value), pairs p JOIN probes USING (qid) JOIN lists l ON l.id = p.id AND l.part = probes.part WHERE nth <= value)), "
    "c AS (SELECT value, count(*) / (SELECT nq FROM nq) + 10 AS distances FROM p v(value), probes JOIN lists USING (part) WHERE nth <= value GROUP BY value) "
    "SELECT CAST(value AS INTEGER) AS value, round(sum(CASE WHEN t.id IS NULL THEN 0 ELSE 1 END) / (10 * (SELECT nq FROM nq)), 6) AS recall, round(any_value(distances), 6) AS distances FROM f LEFT JOIN truth t USING (qid, id) JOIN c USING (value) WHERE f.rank <= 10 GROUP BY value"
)
def ivf_probe_sweep(s, d):
    return _sweep(s, d).select("value", F.round("recall", 6).alias("recall"), F.round("distances", 6).alias("distances"))


def _index(s, d) -> ivf.IVFIndex:
    c = centres(s, d)
    return ivf.IVFIndex(64, len(c), "l2", 2).build(corpus(s, d).select("id", "v"), c)


def _sweep(s, d) -> DataFrame:
    i, q = _index(s, d), asked(s, d)
    return evaluate.sweep_setting(lambda v: i.search(q, K, v), truth(s, d), (1, 2, 4, 8), K)


@query("SELECT CAST(value AS INTEGER) AS value, recall, distances FROM (" + SQL["ivf_probe_sweep"] + ") WHERE recall >= 0.6 ORDER BY distances, value LIMIT 1")
def autotune_cheapest(s, d):
    r = evaluate.cheapest_that_clears(_sweep(s, d), 0.6)
    return r.select("value", F.round("recall", 6).alias("recall"), F.round("distances", 6).alias("distances"))


@query(_OUT + "(" + _top("(SELECT qid, p.id, p.score FROM pairs p JOIN probes USING (qid) JOIN lists l ON l.id = p.id AND l.part = probes.part WHERE nth <= 2 AND p.id % 3 <> 0)") + ")")
def ivf_after_remove(s, d):
    i = _index(s, d)
    i.remove(corpus(s, d).filter("id % 3 = 0").select("id"))
    return out(i.search(asked(s, d), K).result)


_MOVED = "moved AS (SELECT id + 1000000 AS id, list_transform(v, lambda x: -x) AS v FROM corpus WHERE id % 10 = 3), "
_MLISTS = "ml AS (SELECT part, id, v FROM lists UNION ALL SELECT part, id, v FROM (SELECT part, m.id, m.v, row_number() OVER (PARTITION BY m.id ORDER BY pow(list_distance(m.v, c), 2), part) AS nth FROM moved m, centres) WHERE nth = 1), "


@query(_MOVED + _MLISTS.rstrip(", ") + " " + _OUT + "(" + _top("(SELECT q.qid, ml.id, pow(list_distance(q, ml.v), 2) AS score FROM queries q JOIN probes p ON p.qid = q.qid AND p.nth <= 2 JOIN ml ON ml.part = p.part)") + ")")
def ivf_insert(s, d):
    i = _index(s, d)
    i.insert(corpus(s, d).filter("id % 10 = 3").select((F.col("id") + 1_000_000).alias("id"), V.times("v", -1.0).cast("array<float>").alias("v")))
    return out(i.search(asked(s, d), K).result)


@query("SELECT CAST(part AS INTEGER) AS part, id FROM filed WHERE nth <= 2")
def spill_uniform(s, d):
    return ivf.spill_uniformly(corpus(s, d), centres(s, d), 2).select("part", "id")


@query(
    "r AS (SELECT a.id, b.part, row_number() OVER (ORDER BY sqrt(a.d) / greatest(sqrt(b.d), 1e-12) DESC, a.id) AS o FROM filed a JOIN filed b ON a.id = b.id AND a.nth = 1 AND b.nth = 2) "
    "SELECT CAST(part AS INTEGER) AS part, id FROM filed WHERE nth = 1 UNION ALL SELECT CAST(part AS INTEGER), id FROM r WHERE o <= round_even((SELECT count(*) FROM corpus) * 0.3, 0)"
)
def spill_adaptive(s, d):
    return ivf.spill_adaptively(corpus(s, d), centres(s, d), 0.3).select("part", "id")


@query(_OUT + "(" + _top("(SELECT DISTINCT qid, p.id, p.score FROM pairs p JOIN probes USING (qid) JOIN filed f ON f.id = p.id AND f.part = probes.part AND f.nth <= 2 WHERE probes.nth <= 2)") + ")")
def spill_search(s, d):
    spilled = ivf.spill_uniformly(corpus(s, d), centres(s, d), 2)
    return out(ivf.ivf_search(asked(s, d), spilled, centres(s, d), K, 2, copies=2))


# -- shards and replicas -----------------------------------------------------------------------


@query(_OUT + "truth")
def shards_scatter(s, d):
    shards = corpus(s, d).withColumn("shard", F.pmod("id", F.lit(7)).cast("int"))
    return out(storage.scatter_gather(asked(s, d), shards, K))


@query("few AS (SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, id % 7 ORDER BY score, id) AS r FROM pairs) WHERE r <= 2) " + _OUT + "(" + _top("few") + ")")
def shards_fetch_two(s, d):
    shards = corpus(s, d).withColumn("shard", F.pmod("id", F.lit(7)).cast("int"))
    return out(storage.scatter_gather(asked(s, d), shards, K, 2))


@query(_OUT + "rough")
def shards_routed(s, d):
    c = centres(s, d)
    return out(storage.routed(asked(s, d), storage.clustered_shards(corpus(s, d), c), c, K, 2))


_HALF = "half AS (" + _top("(SELECT * FROM pairs WHERE id % 2 = 0)") + ")"


@query(_HALF + " " + _OUT + "(" + _top("(SELECT qid, id, min(score) AS score FROM (SELECT * FROM half UNION ALL SELECT * FROM rough) GROUP BY qid, id)") + ")")
def replica_merge(s, d):
    return out(serving.merge_replicas(_replicas(s, d), K))


def _replicas(s, d) -> DataFrame:
    half = exact.search(asked(s, d), corpus(s, d), K, keep=F.col("id") % 2 == 0)
    return serving.tagged({"a": half, "b": rough(s, d)})


@query(_HALF + " SELECT round(sum(CASE WHEN h.rank = r.rank THEN 1 ELSE 0 END) / (SELECT count(*) FROM half), 6) AS slots, round(count(*) / (SELECT count(*) FROM half), 6) AS sets FROM half h JOIN rough r USING (qid, id)")
def replica_agreement(s, d):
    return serving.agreement(_replicas(s, d)).select(F.round("slots", 6).alias("slots"), F.round("sets", 6).alias("sets"))


# -- hashing and signs -------------------------------------------------------------------------


def _planes(s, d) -> np.ndarray:
    rows = {r.id: np.array(r.v, dtype=float) for r in corpus(s, d).filter("id < 100").collect()}
    return np.array([[rows[20 + 16 * t + 2 * b] - rows[21 + 16 * t + 2 * b] for b in range(6)] for t in range(4)])


_PLANES = (
    "planes AS (SELECT t AS tbl, b, list_transform(list_zip(x.v, y.v), lambda z: z[1] - z[2]) AS p FROM range(4) tt(t), range(6) bb(b) JOIN corpus x ON x.id = 20 + 16 * t + 2 * b JOIN corpus y ON y.id = 21 + 16 * t + 2 * b), "
    "sigs AS (SELECT id, CAST(tbl AS INTEGER) AS tbl, CAST(sum(CASE WHEN list_inner_product(v, p) > 0 THEN pow(2, b) ELSE 0 END) AS INTEGER) AS sig FROM corpus, planes GROUP BY id, tbl), "
    "qsigs AS (SELECT qid, CAST(tbl AS INTEGER) AS tbl, CAST(sum(CASE WHEN list_inner_product(q, p) > 0 THEN pow(2, b) ELSE 0 END) AS INTEGER) AS sig FROM queries, planes GROUP BY qid, tbl), "
    "cand AS (SELECT DISTINCT qid, id FROM qsigs JOIN sigs USING (tbl, sig))"
)


@query(_PLANES + " SELECT id, tbl, sig FROM sigs")
def lsh_signatures(s, d):
    return hashing.signatures(corpus(s, d), _planes(s, d))


@query(_PLANES + " SELECT tbl, count(DISTINCT sig) AS buckets FROM sigs GROUP BY tbl")
def lsh_bucket_counts(s, d):
    return hashing.bucket_counts(hashing.signatures(corpus(s, d), _planes(s, d)))


def _candidates(s, d) -> DataFrame:
    p = _planes(s, d)
    return hashing.lsh_candidates(hashing.keyed(asked(s, d), p, "qid", "q"), hashing.keyed(corpus(s, d), p))


@query(_PLANES + " SELECT qid, id FROM cand")
def lsh_candidates(s, d):
    return _candidates(s, d)


@query(_PLANES + " " + _OUT + "(" + _top("(SELECT pairs.qid, pairs.id, score FROM pairs JOIN cand USING (qid, id))") + ")")
def lsh_search(s, d):
    return out(hashing.lsh_search(asked(s, d), corpus(s, d), _planes(s, d), K))


@query(
    "few AS (SELECT * FROM truth WHERE rank <= qid // 20 % 4), " + _filled("few")
)
def top_up_fill(s, d):
    few = truth(s, d).filter(F.col("rank") <= F.pmod(F.floor(F.col("qid") / 20), F.lit(4)))
    return out(exact.top_up(few, asked(s, d), corpus(s, d).select("id", "v"), K))


_SIGN = "list_sum(list_transform(list_zip(q, v), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))::DOUBLE"
_SHORT = f"short AS ({_top(f'(SELECT qid, id, {_SIGN} AS score FROM queries, corpus)', 50)})"


@query(_SHORT + " " + _OUT + "short")
def sign_shortlist(s, d):
    return out(serving.sign_shortlist(asked(s, d), corpus(s, d), 50, size(s, d), 64).rows)


@query(_SHORT + " " + _OUT + "(" + _top("(SELECT p.qid, p.id, p.score FROM pairs p JOIN short USING (qid, id))") + ")")
def staged_rerank(s, d):
    short = serving.sign_shortlist(asked(s, d), corpus(s, d), 50, size(s, d), 64)
    return out(codes.rerank(asked(s, d), corpus(s, d), short.rows, K))


@query(_SHORT.replace("<= 50", "<= 400") + ", z AS (SELECT unnest([10, 20, 50, 100, 200, 400]) AS depth) SELECT CAST(depth AS INTEGER) AS depth, round(sum(CASE WHEN s.rank <= depth THEN 1 ELSE 0 END) / (10 * (SELECT nq FROM nq)), 6) AS recall FROM z, truth t LEFT JOIN short s USING (qid, id) GROUP BY depth")
def shortlist_depth_sweep(s, d):
    wide = serving.sign_shortlist(asked(s, d), corpus(s, d), 400, size(s, d), 64).rows
    return serving.depth_sweep(truth(s, d), wide, (10, 20, 50, 100, 200, 400)).select("depth", F.round("recall", 6).alias("recall"))


# -- codes -------------------------------------------------------------------------------------

_RANGE = "rg AS (SELECT min(x) AS lo, greatest(max(x) - min(x), 1e-12) AS span FROM dims)"
_SCALAR = _RANGE + ", sc AS (SELECT id, list_transform(v, lambda x: CAST(least(255, greatest(0, round_even((x - lo) / span * 255, 0))) AS INTEGER)) AS codes, lo, span FROM corpus, rg), dec AS (SELECT id, list_transform(codes, lambda x: x * (span / 255) + lo) AS v FROM sc)"


def _scalar(s, d, per_vector: bool = False) -> codes.ScalarCodes:
    return codes.scalar_quantise(corpus(s, d).select("id", V.doubles("v").alias("v")), per_vector)


@query(_SCALAR + " SELECT id, codes FROM sc")
def scalar_encode(s, d):
    return _scalar(s, d).frame.select("id", "codes")


@query("sc AS (SELECT id, list_transform(v, lambda x: CAST(least(255, greatest(0, round_even((x - list_min(v)) / greatest(list_max(v) - list_min(v), 1e-12) * 255, 0))) AS INTEGER)) AS codes FROM corpus) SELECT id, codes FROM sc")
def scalar_encode_per_row(s, d):
    return _scalar(s, d, True).frame.select("id", "codes")


@query(_SCALAR + " " + _OUT + "(" + _top("(SELECT qid, id, pow(list_distance(q, v), 2) AS score FROM queries, dec)") + ")")
def scalar_search(s, d):
    return out(codes.scalar_search(asked(s, d), _scalar(s, d), K))


@query(_SCALAR + f", short AS ({_top('(SELECT qid, id, pow(list_distance(q, v), 2) AS score FROM queries, dec)', 20)}) " + _OUT + "(" + _top("(SELECT p.qid, p.id, p.score FROM pairs p JOIN short USING (qid, id))") + ")")
def scalar_rerank(s, d):
    return out(codes.rerank(asked(s, d), corpus(s, d), codes.scalar_search(asked(s, d), _scalar(s, d), 20), K))


@query(_SCALAR + " SELECT round(avg(pow(list_distance(c.v, dec.v), 2)), 6) AS error FROM corpus c JOIN dec USING (id)")
def scalar_error(s, d):
    return codes.reconstruction_error(corpus(s, d), _scalar(s, d).decoded()).select(F.round("error", 6).alias("error"))


def _books(s, d, subspaces: int = 8, entries: int = 16) -> codes.ProductBooks:
    v = np.array([r.v for r in corpus(s, d).orderBy("id").limit(entries).collect()], dtype=float)
    return codes.ProductBooks(v.reshape(entries, subspaces, -1).transpose(1, 0, 2))


_BOOKS = (
    "books AS (SELECT s, CAST(row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS INTEGER) AS code, v[s * 8 + 1 : s * 8 + 8] AS c FROM (SELECT id, v FROM corpus ORDER BY id LIMIT 16), range(8) r(s)), "
    "enc AS (SELECT id, s, arg_min(code, {'d': pow(list_distance(v[s * 8 + 1 : s * 8 + 8], c), 2), 'code': code}) AS code FROM corpus, books GROUP BY id, s)"
)


@query(_BOOKS + " SELECT id, list(code ORDER BY s) AS codes FROM enc GROUP BY id")
def pq_encode(s, d):
    return _books(s, d).encode(corpus(s, d))


@query(_BOOKS + " " + _OUT + "(" + _top("(SELECT qid, id, sum(pow(list_distance(q[s * 8 + 1 : s * 8 + 8], c), 2)) AS score FROM queries, enc JOIN books USING (s, code) GROUP BY qid, id)", order="round(score, 9), id") + ")")
def pq_adc_search(s, d):
    b = _books(s, d)
    return out(b.search(asked(s, d), b.encode(corpus(s, d)), K))


@query(_BOOKS + ", dec AS (SELECT id, flatten(list(c ORDER BY s)) AS r FROM enc JOIN books USING (s, code) GROUP BY id) SELECT round(avg(pow(list_distance(v, r), 2)), 6) AS error FROM corpus JOIN dec USING (id)")
def pq_error(s, d):
    b = _books(s, d)
    return codes.reconstruction_error(corpus(s, d), b.decode(b.encode(corpus(s, d)))).select(F.round("error", 6).alias("error"))


def _stages(s, d) -> codes.ResidualBooks:
    v = np.array([r.v for r in corpus(s, d).orderBy("id").limit(16).collect()], dtype=float)
    return codes.ResidualBooks(np.stack([v, v * 0.25]))


_STAGES = (
    "book AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS code, v AS c FROM corpus ORDER BY id LIMIT 16), "
    "s1 AS (SELECT id, any_value(v) AS v, arg_min(code, {'d': pow(list_distance(v, c), 2), 'code': code}) AS code1 FROM corpus, book GROUP BY id), "
    "l1 AS (SELECT id, code1, v, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS rest FROM s1 JOIN book ON code = code1), "
    "s2 AS (SELECT id, any_value(code1) AS code1, any_value(v) AS v, any_value(rest) AS rest, arg_min(code, {'d': pow(list_distance(rest, list_transform(c, lambda x: x * 0.25)), 2), 'code': code}) AS code2 FROM l1, book GROUP BY id)"
)


@query(_STAGES + " SELECT id, [code1, code2] AS codes FROM s2")
def residual_encode(s, d):
    return _stages(s, d).encode(corpus(s, d))


@query(_STAGES + " SELECT id, round(list_distance(rest, list_transform(c, lambda x: x * 0.25)), 6) AS left_over FROM s2 JOIN book ON code = code2")
def residual_decode(s, d):
    b = _stages(s, d)
    both = corpus(s, d).join(b.decode(b.encode(corpus(s, d))).withColumnRenamed("v", "r"), "id")
    return both.select("id", F.round(F.sqrt(V.squared_l2("v", "r")), 6).alias("left_over"))


@query("mean AS (SELECT list(m ORDER BY dim) AS m FROM (SELECT dim, avg(x) AS m FROM dims GROUP BY dim)) " + _OUT + "(" + _top("(SELECT qid, id, list_sum(list_transform(list_zip(q, v, m), lambda z: CASE WHEN (z[1] - z[3] > 0) <> (z[2] - z[3] > 0) THEN 1 ELSE 0 END))::DOUBLE AS score FROM queries, corpus, mean)") + ")")
def binary_centred(s, d):
    signs = codes.sign_fit(corpus(s, d))
    return out(signs.search(asked(s, d), signs.encode(corpus(s, d)), K))


@query("SELECT CAST(floor((dim - 1) / 8) AS INTEGER) AS sub, round(sum(var), 6) AS variance FROM (SELECT dim, var_pop(x) AS var FROM dims GROUP BY dim) GROUP BY 1")
def subspace_variance(s, d):
    return codes.subspace_variance(corpus(s, d), 8).select("sub", F.round("variance", 6).alias("variance"))


# -- fusion ------------------------------------------------------------------------------------

_RANKINGS = "half AS (" + _top("(SELECT * FROM pairs WHERE id % 2 = 0)") + "), lists2 AS (SELECT 'a' AS source, * FROM half UNION ALL SELECT 'b', * FROM rough)"


def _rankings(s, d) -> DataFrame:
    return _replicas(s, d).withColumnRenamed("replica", "source")


def _fuse_sql(norm: str) -> str:
    return (
        _RANKINGS + f", n AS (SELECT *, {norm} AS norm FROM lists2), w AS (SELECT source, qid, max(norm) AS worst FROM n GROUP BY source, qid), "
        "u AS (SELECT DISTINCT qid, id FROM lists2), t AS (SELECT u.qid, u.id, round(sum(coalesce(n.norm, w.worst)), 9) AS score FROM u JOIN w USING (qid) LEFT JOIN n ON n.qid = u.qid AND n.id = u.id AND n.source = w.source GROUP BY u.qid, u.id) "
        + _OUT + "(" + _top("t") + ")"
    )


def _fused(s, d, how: str) -> DataFrame:
    f = evaluate.fuse_by_score(_rankings(s, d), 40, None, how)
    return out(V.top(f.select("qid", "id", F.round("score", 9).alias("score")), K))


_OVER = "OVER (PARTITION BY source, qid)"


@query(_fuse_sql(f"score / greatest(max(score) {_OVER}, 1e-12)"))
def fuse_score_max(s, d):
    return _fused(s, d, "max")


@query(_fuse_sql(f"(score - min(score) {_OVER}) / greatest(max(score) {_OVER} - min(score) {_OVER}, 1e-12)"))
def fuse_score_range(s, d):
    return _fused(s, d, "range")


@query(_fuse_sql(f"score / greatest(min(score) {_OVER}, 1e-12)"))
def fuse_score_best(s, d):
    return _fused(s, d, "best")


@query(_fuse_sql("score / greatest(avg(score) OVER (PARTITION BY source), 1e-12)"))
def fuse_score_global(s, d):
    return _fused(s, d, "global")


@query(_RANKINGS + " " + _OUT + "(" + _top("(SELECT qid, id, round(sum(CASE source WHEN 'a' THEN 2.0 ELSE 1.0 END / (10.0 + rank)), 12) AS score FROM lists2 GROUP BY qid, id)", order="score DESC, id") + ")")
def fuse_rank(s, d):
    f = evaluate.fuse_by_rank(_rankings(s, d), 40, {"a": 2.0, "b": 1.0}, 10.0)
    return out(V.top(f.select("qid", "id", F.round("score", 12).alias("score")), K, "ip"))


# -- budgets -----------------------------------------------------------------------------------

_OPEN = (
    "sizes AS (SELECT part, count(*) AS n FROM lists GROUP BY part), placed AS (SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY id) AS place FROM lists), "
    "o AS (SELECT qid, part, nth, coalesce(n, 0) AS n, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY qid ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM probes LEFT JOIN sizes USING (part))"
)


def _scan_sql(o: str) -> str:
    got = _top(f"(SELECT p.qid, p.id, p.score FROM pairs p JOIN {o} o ON o.qid = p.qid JOIN placed l ON l.part = o.part AND l.id = p.id WHERE l.place <= o.take)")
    return f", got AS ({got}), " + _filled("got")


def _served(s, d) -> tuple:
    ls = materialise(lists(s, d))
    return asked(s, d), ls, label_centres(s, d), ls.groupBy("part").agg(F.count("*").alias("n"))


@query(_OPEN + ", a AS (SELECT qid, part, least(n, greatest(0, 90 - before)) AS take FROM o)" + _scan_sql("a"))
def budget_per_query(s, d):
    return out(serving.bounded_search(*_served(s, d), 10, K, 100)[0])


@query(_OPEN + ", a AS (SELECT qid, part, CASE WHEN before + n <= 140 THEN n ELSE 0 END AS take FROM o)" + _scan_sql("a"))
def budget_whole(s, d):
    return out(serving.whole_lists_search(*_served(s, d), 10, K, 150))


@query(
    _OPEN + ", e AS (SELECT qid, sum(n) AS wanted FROM o WHERE nth <= 2 GROUP BY qid), b AS (SELECT qid, greatest(0, 1000 - coalesce(sum(wanted) OVER (ORDER BY qid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM e), "
    "a AS (SELECT o.qid, part, least(n, greatest(0, room - before)) AS take FROM o JOIN b USING (qid) WHERE nth <= 2)" + _scan_sql("a")
)
def budget_shared(s, d):
    return out(serving.shared_budget_search(*_served(s, d), K, 1000, 2)[0])


# -- graphs and pages --------------------------------------------------------------------------

_GRAPH = (
    "allp AS (SELECT a.id AS src, b.id AS dst, pow(list_distance(a.v, b.v), 2) AS score FROM corpus a, corpus b WHERE a.id <> b.id), "
    "g AS (SELECT src, dst, CAST(ord AS INTEGER) AS ord, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score, dst) AS ord FROM allp) WHERE ord <= 5)"
)


def _graph(s, d, degree: int = 5) -> DataFrame:
    return materialise(graphs.exact_graph(corpus(s, d).select("id", "v"), degree))


@query(_GRAPH + " SELECT src, dst, ord, round(score, 6) AS score FROM g")
def knn_graph(s, d):
    return _graph(s, d).select("src", "dst", "ord", F.round("score", 6).alias("score"))


@query(_GRAPH + " SELECT src, dst FROM g UNION SELECT dst, src FROM g")
def graph_symmetrise(s, d):
    return graphs.symmetrise(_graph(s, d))


@query(_GRAPH + " SELECT round(avg(CASE WHEN b.src IS NULL THEN 0 ELSE 1 END), 6) AS reciprocity FROM g a LEFT JOIN g b ON a.src = b.dst AND a.dst = b.src")
def graph_reciprocity(s, d):
    return graphs.reciprocity(_graph(s, d)).select(F.round("reciprocity", 6).alias("reciprocity"))


@query(
    _GRAPH + ", one AS (SELECT src, dst FROM g WHERE ord = 1), e AS (SELECT src, dst FROM one UNION SELECT dst, src FROM one), "
    "r AS (SELECT id AS node, id AS seen FROM corpus UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.seen) SELECT node AS id, min(seen) AS component FROM r GROUP BY node"
)
def graph_components(s, d):
    return graphs.components(corpus(s, d), _graph(s, d, 1))


@query(_GRAPH + " SELECT sum(n)::BIGINT AS edges, count(*) AS vertices, round(avg(n), 6) AS mean_degree, max(n) AS max_degree FROM (SELECT src, count(*) AS n FROM (SELECT src, dst FROM g UNION SELECT dst, src FROM g) GROUP BY src)")
def graph_degrees(s, d):
    return graphs.degrees(graphs.symmetrise(_graph(s, d))).select("edges", "vertices", F.round("mean_degree", 6).alias("mean_degree"), "max_degree")


_TOUCHED = "touched AS (SELECT qid, l.id FROM probes JOIN lists l USING (part) WHERE nth <= 2), "


def _opened(s, d) -> DataFrame:
    return ivf.probes(asked(s, d), centres(s, d), 2).select("qid", "part")


@query(_TOUCHED + "lay AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 16 AS page FROM corpus) SELECT qid, count(*) AS vectors, count(DISTINCT page) AS pages, count(DISTINCT page) * 4096 AS bytes FROM touched JOIN lay USING (id) GROUP BY qid")
def page_counts_sequential(s, d):
    return storage.list_page_counts(_opened(s, d), lists(s, d), storage.sequential_layout(corpus(s, d), 64))


@query(_TOUCHED + "lay AS (SELECT id, (row_number() OVER (ORDER BY part, id) - 1) // 16 AS page FROM lists) SELECT qid, count(*) AS vectors, count(DISTINCT page) AS pages, count(DISTINCT page) * 4096 AS bytes FROM touched JOIN lay USING (id) GROUP BY qid")
def page_counts_clustered(s, d):
    return storage.list_page_counts(_opened(s, d), lists(s, d), storage.clustered_layout(lists(s, d), 64))


# -- diagnostics -------------------------------------------------------------------------------


@query("SELECT round(avg(c), 6) AS contrast FROM (SELECT qid, avg(sqrt(score)) / greatest(min(sqrt(score)), 1e-9) AS c FROM pairs WHERE id <> qid GROUP BY qid)")
def contrast(s, d):
    return datasets.relative_contrast(asked(s, d), corpus(s, d)).select(F.round("contrast", 6).alias("contrast"))


@query("SELECT round(avg((b - a) / greatest(a, 1e-9)), 6) AS margin FROM (SELECT sqrt(min(score)) AS a, sqrt(max(score)) AS b FROM truth WHERE rank IN (2, 3) GROUP BY qid)")
def margin(s, d):
    return datasets.neighbour_margin(others(s, d)).select(F.round("margin", 6).alias("margin"))


@query("SELECT round(avg(list_distance(a.v, b.v)), 6) AS typical_distance FROM corpus a, corpus b WHERE a.id < b.id")
def typical_distance(s, d):
    return datasets.typical_distance(corpus(s, d), size(s, d)).select(F.round("typical_distance", 6).alias("typical_distance"))


_COPIES = "copies AS (SELECT id * 3 + i AS id, v, id AS original FROM corpus, range(3) r(i)), cp AS (SELECT qid, id, pow(list_distance(q, v), 2) AS score FROM queries, copies)"


@query(_COPIES + f", wide AS ({_top('cp', 11, 'round(score, 9), id')}) SELECT round(avg(CASE WHEN gap < 1e-6 THEN 1 ELSE 0 END), 6) AS tied, round(median(gap), 6) AS median_gap FROM (SELECT qid, max(score) - min(score) AS gap FROM wide WHERE rank >= 10 GROUP BY qid)")
def ties(s, d):
    return drift.ties_in_the_truth(exact.search(asked(s, d), datasets.copied(corpus(s, d), 3), K + 1), K).select(F.round("tied", 6).alias("tied"), F.round("median_gap", 6).alias("median_gap"))


@query(_COPIES + " SELECT min(id) AS id FROM copies GROUP BY v")
def dedup_vectors(s, d):
    return drift.deduplicated(datasets.copied(corpus(s, d), 3)).select("id")


@query(_COPIES + f", wide AS ({_top('cp', 10, 'round(score, 9), id')}), z AS (SELECT unnest([3, 6, 10]) AS depth) SELECT CAST(depth AS INTEGER) AS depth, round(avg(n), 6) AS originals FROM (SELECT depth, qid, count(DISTINCT original) AS n FROM z, wide JOIN copies USING (id) WHERE rank <= depth GROUP BY depth, qid) GROUP BY depth")
def distinct_originals(s, d):
    c = datasets.copied(corpus(s, d), 3)
    return drift.distinct_originals(exact.search(asked(s, d), c, K), c, (3, 6, 10)).select("depth", F.round("originals", 6).alias("originals"))


@query(_OUT + "(" + _top("(SELECT qid, id, pow(list_distance(list_transform(q, lambda x: x * 0.25), v), 2) AS score FROM queries, corpus)") + ")")
def drift_scale(s, d):
    return out(exact.search(drift.drifted(asked(s, d), "scale", 0.25), corpus(s, d), K))


@query("mean AS (SELECT list(m ORDER BY dim) AS m FROM (SELECT dim, avg(x) AS m FROM dims GROUP BY dim)) SELECT id, round(list_inner_product(w, w), 6) AS length FROM (SELECT id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS w FROM corpus, mean)")
def centring(s, d):
    return drift.fit_centring(corpus(s, d)).apply(corpus(s, d)).select("id", F.round(V.dot("v", "v"), 6).alias("length"))


# -- routing, calibration, reports -------------------------------------------------------------


@query("sg AS (SELECT qid, min(sqrt(d)) AS signal FROM probes GROUP BY qid), ch AS (SELECT qid FROM sg QUALIFY row_number() OVER (ORDER BY signal DESC, qid) <= round_even((SELECT nq FROM nq) * 0.25, 0)) SELECT qid, rank, id, round(score, 6) AS score, CASE WHEN qid IN (SELECT qid FROM ch) THEN 'dear' ELSE 'cheap' END AS tier FROM (SELECT * FROM rough WHERE qid NOT IN (SELECT qid FROM ch) UNION ALL SELECT * FROM truth WHERE qid IN (SELECT qid FROM ch))")
def router_escalate(s, d):
    chosen = materialise(serving.escalated(serving.centrality(asked(s, d), label_centres(s, d)), 0.25))
    r = serving.route(rough(s, d), truth(s, d), chosen)
    return r.select("qid", F.col("rank").cast("int").alias("rank"), "id", F.round("score", 6).alias("score"), "tier")


_SIGNALS = "sig AS (SELECT qid, max(score) - min(score) AS gap FROM rough GROUP BY qid), vals AS (SELECT qid, gap, recall FROM sig JOIN recalls USING (qid))"


def _values(s, d) -> DataFrame:
    found = materialise(rough(s, d))
    return evaluate.signals(found).join(evaluate.per_query_recall(truth(s, d), found, K), "qid")


@query(_SIGNALS + ", r AS (SELECT gap, recall, rank() OVER (ORDER BY gap) - 1 + (count(*) OVER (PARTITION BY gap) - 1) / 2.0 AS a, rank() OVER (ORDER BY recall) - 1 + (count(*) OVER (PARTITION BY recall) - 1) / 2.0 AS b FROM vals) SELECT round(corr(gap, recall), 6) AS correlation, round(corr(a, b), 6) AS rank_correlation FROM r")
def calibration_correlation(s, d):
    r = evaluate.correlations(_values(s, d), "gap")
    return r.select(F.round("correlation", 6).alias("correlation"), F.round("rank_correlation", 6).alias("rank_correlation"))


@query(
    _SIGNALS + ", f AS (SELECT row_number() OVER (ORDER BY gap DESC, qid) <= greatest(1, round_even((SELECT nq FROM nq) * 0.2, 0)) AS f, recall < 0.5 AS bad FROM vals), c AS (SELECT count(*) FILTER (f) AS flagged, count(*) FILTER (f AND bad) AS caught, count(*) FILTER (NOT f AND bad) AS missed, count(*) FILTER (f AND NOT bad) AS false_alarms FROM f) "
    "SELECT *, round(caught / flagged, 6) AS precision, round(CASE WHEN caught + missed = 0 THEN 0 ELSE caught / (caught + missed) END, 6) AS sensitivity FROM c"
)
def flag_worst(s, d):
    r = evaluate.flag_the_worst(_values(s, d), "gap")
    return r.select("flagged", "caught", "missed", "false_alarms", F.round("precision", 6).alias("precision"), F.round("sensitivity", 6).alias("sensitivity"))


_MEASURED = [("a", 100.0, 0.3), ("a", 400.0, 0.6), ("a", 900.0, 0.7), ("b", 300.0, 0.5), ("b", 800.0, 0.9), ("c", 700.0, 0.8)]


@query("self AS (SELECT a.id AS qid, b.id AS id, pow(list_distance(a.v, b.v), 2) AS score FROM corpus a, corpus b), k AS (SELECT qid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS r FROM self) WHERE r = 11) SELECT qid FROM k ORDER BY score DESC, qid LIMIT 15")
def sparse_region_attack(s, d):
    c = corpus(s, d).select("id", "v")
    return evaluate.from_sparse_regions(c, c, 15).select("qid")


@query("mid AS (SELECT row_number() OVER (ORDER BY a.part, b.part) - 1 AS qid, list_transform(list_zip(a.c, b.c), lambda z: (z[1] + z[2]) * 0.5) AS q FROM centres a JOIN centres b ON a.part < b.part) " + _OUT + "(" + _top("(SELECT qid, id, pow(list_distance(q, v), 2) AS score FROM mid, corpus WHERE qid < 20)", 3) + ")")
def midpoint_attack(s, d):
    return out(exact.search(evaluate.between_partitions(label_centres(s, d), 20), corpus(s, d), 3))


@query("SELECT qid FROM recalls ORDER BY recall, qid LIMIT 5")
def worst_answered_attack(s, d):
    return evaluate.the_worst_answered(asked(s, d), evaluate.per_query_recall(truth(s, d), rough(s, d), K), 5).select("qid")


# -- streams -----------------------------------------------------------------------------------

_STREAM = "st AS (SELECT e.event_id AS qid, v.embedding AS q FROM events e JOIN embeddings v ON v.vec_id = e.user_id % (SELECT count(*) FROM embeddings))"


def _stream(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("qid"), F.pmod("user_id", F.lit(size(s, d))).alias("id"))
    return e.join(table(s, d).select("id", F.col("v").alias("q")), "id").select("qid", "q")


@query(_STREAM + " SELECT count(*) AS queries, count(*) - count(DISTINCT q) AS hits, count(DISTINCT q) AS misses, round((count(*) - count(DISTINCT q)) / count(*), 6) AS hit_rate FROM st")
def exact_cache_hits(s, d):
    return batches.exact_cache_hits(_stream(s, d)).select("queries", "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"))


@query(_STREAM + ", f AS (SELECT qid, min(qid) OVER (PARTITION BY q) AS served_by FROM st) SELECT qid, served_by, qid <> served_by AS hit FROM f")
def exact_cache_run(s, d):
    return batches.run_cache(_stream(s, d), None, 4096, 32).select("qid", "served_by", "hit")


@query()
def near_cache_run(s, d):
    return batches.run_cache(_stream(s, d), 0.8, 64, 32).select("qid", "served_by", "hit", "lookup_distances")


@query(_OUT + "truth")
def batched_search(s, d):
    c = corpus(s, d)
    return out(batches.batched_search(asked(s, d), lambda q: exact.search(q, c, K), 8)[0])


@fixed("g AS (SELECT unnest([10.0, 100.0, 1000.0, 10000.0])::DOUBLE AS rate) SELECT rate, CAST(max(b) AS INTEGER) AS batch FROM g, range(1, 4097) r(b) WHERE (b - 1) / rate * 1000 + 2.0 + 0.05 * b <= 20.0 GROUP BY rate")
def largest_batch(s, d):
    return batches.largest_batch(s, (10.0, 100.0, 1000.0, 10000.0))


# -- structures that tasks walk ----------------------------------------------------------------


@query(_OUT + "truth")
def tree_search(s, d):
    return out(sharded.TreeIndex(64, shards=3).build(corpus(s, d).select("id", "v")).search(asked(s, d), K).result)


@query()
def forest_search(s, d):
    return out(sharded.ForestIndex(64, 8, 32, shards=2).build(corpus(s, d).select("id", "v")).search(asked(s, d), K).result)


@query()
def graph_search(s, d):
    return out(sharded.GraphIndex(64, shards=2).build(corpus(s, d).select("id", "v")).search(asked(s, d), K).result)


@query()
def hnsw_search(s, d):
    return out(sharded.HNSWIndex(64, shards=2).build(corpus(s, d).select("id", "v")).search(asked(s, d), K).result)


@query()
def composite_search(s, d):
    return out(codes.CompositeIndex(64, 10, 8, 16, 4, 60).build(corpus(s, d).select("id", "v")).search(asked(s, d), K).result)


@query()
def kmeans_lloyd(s, d):
    c = kmeans.lloyd(corpus(s, d).select("id", "v"), 10, 8)
    return kmeans.centre_frame(s, c.centres).select("part", F.size("c").alias("width"))


@query()
def nn_descent(s, d):
    return graphs.nn_descent(corpus(s, d).select("id", "v"), 5, 4).select("src", "dst", "ord", F.round("score", 6).alias("score"))


@query("SELECT unnest(['returns_k_results', 'identifiers_are_distinct', 'identifiers_are_in_range', 'scores_agree_with_identifiers', 'results_are_ordered', 'the_nearest_is_within_the_exact_kth']) AS rule, CAST(0 AS BIGINT) AS violations")
def invariant_violations(s, d):
    return verify.violations(truth(s, d), corpus(s, d).select("id", "v"), asked(s, d), K)


@query("SELECT CAST(nc * nq AS BIGINT) AS candidates, CAST(nq AS BIGINT) AS queries FROM nc, nq")
def flat_index_stats(s, d):
    return index.FlatIndex(64).build(corpus(s, d).select("id", "v")).search(asked(s, d), K).stats.select("candidates", "queries")


# -- more of the same families -----------------------------------------------------------------


@query("SELECT round(b - a, 6) AS signal, qid FROM (SELECT qid, min(sqrt(d)) AS a, max(sqrt(d)) AS b FROM probes WHERE nth <= 2 GROUP BY qid)")
def boundary_closeness(s, d):
    return serving.boundary_closeness(asked(s, d), label_centres(s, d)).select("qid", F.round("signal", 6).alias("signal"))


@query("SELECT qid, round(max(score) - min(score), 6) AS spread, round(min(score), 6) AS best FROM rough GROUP BY qid")
def result_signals(s, d):
    r = rough(s, d)
    both = serving.result_spread(r).withColumnRenamed("signal", "spread").join(serving.best_score(r).withColumnRenamed("signal", "best"), "qid")
    return both.select("qid", F.round("spread", 6).alias("spread"), F.round("best", 6).alias("best"))


@query("sg AS (SELECT qid, min(sqrt(d)) AS signal FROM probes GROUP BY qid), ch AS (SELECT qid FROM sg QUALIFY row_number() OVER (ORDER BY signal DESC, qid) <= round_even((SELECT nq FROM nq) * 0.25, 0)) SELECT qid, rank, id, round(score, 6) AS score FROM (SELECT * FROM rough WHERE qid NOT IN (SELECT qid FROM ch) UNION ALL SELECT * FROM truth WHERE qid IN (SELECT qid FROM ch))")
def router_up_front(s, d):
    c = centres(s, d)
    cheap = serving.Tier("ivf", ivf.IVFIndex(64, len(c), "l2", 2).build(corpus(s, d).select("id", "v"), c), 100.0)
    dear = serving.Tier("flat", index.FlatIndex(64).build(corpus(s, d).select("id", "v")), float(size(s, d)))
    return out(serving.choose_up_front(cheap, dear, asked(s, d), K, serving.centrality(asked(s, d), label_centres(s, d)), 0.25).found)


@query("SELECT count(DISTINCT id) AS rows, count(*) AS entries, round(count(*) / count(DISTINCT id), 6) AS growth FROM filed WHERE nth <= 3")
def spill_growth(s, d):
    r = ivf.spill_growth(ivf.spill_uniformly(corpus(s, d), centres(s, d), 3))
    return r.select("rows", "entries", F.round("growth", 6).alias("growth"))


@query("SELECT qid, rank, id, round(score, 6) AS score FROM truth")
def scores_for(s, d):
    return out(exact.scores_for(asked(s, d), corpus(s, d), truth(s, d)))


@query("wide AS (" + _top("pairs", 20) + ") SELECT qid, CAST(rank - 10 AS INTEGER) AS rank, id, round(score, 6) AS score FROM wide WHERE rank > 10")
def near_misses(s, d):
    return out(evaluate.near_misses(truth(s, d, 20), K, 10))


@query("a AS (SELECT qid, round(score, 5) AS s, row_number() OVER (PARTITION BY qid, round(score, 5) ORDER BY rank) AS n FROM truth), b AS (SELECT qid, round(score, 5) AS s, row_number() OVER (PARTITION BY qid, round(score, 5) ORDER BY rank) AS n FROM rough) SELECT round(count(b.qid) / (10 * (SELECT nq FROM nq)), 6) AS recall FROM a LEFT JOIN b USING (qid, s, n)")
def recall_by_distance(s, d):
    return drift.recall_by_distance(truth(s, d), rough(s, d), K).select(F.round("recall", 6).alias("recall"))


@query("SELECT round(avg(CASE WHEN t.id = r.id THEN 1 ELSE 0 END), 6) AS stable FROM truth t JOIN rough r USING (qid) WHERE t.rank = 2 AND r.rank = 2")
def nearest_stability(s, d):
    return datasets.nearest_neighbour_stability(exact.without_own(truth(s, d), K), exact.without_own(rough(s, d), K)).select(F.round("stable", 6).alias("stable"))


@query("SELECT round(min(v) / max(v), 6) AS balance FROM (SELECT floor((dim - 1) / 8) AS sub, sum(var) AS v FROM (SELECT dim, var_pop(x) AS var FROM dims GROUP BY dim) GROUP BY 1)")
def variance_balance(s, d):
    return codes.variance_balance(corpus(s, d), 8).select(F.round("balance", 6).alias("balance"))


@query("low AS (SELECT qid, id, list_inner_product(q[1:8] , q[1:8]) + list_inner_product(v[1:8], v[1:8]) - 2 * list_inner_product(q[1:8], v[1:8]) AS score FROM queries, corpus) " + _OUT + "(" + _top("low", 30) + ")")
def projected_shortlist(s, d):
    return out(serving.projected_shortlist(asked(s, d), corpus(s, d), 30, size(s, d), np.eye(64)[:8]).rows)


_ROWS3 = "m AS (SELECT * FROM (VALUES ('a', 'g', 0.3), ('a', 'h', 0.75), ('b', 'g', 0.7)) t(i, c, r))"


@query(_ROWS3 + " SELECT i AS index, c AS corpus, round(avg(r)::DOUBLE, 6) AS recall FROM m GROUP BY GROUPING SETS ((i), (c))")
def report_means(s, d):
    rows = s.createDataFrame([("a", "g", "x", 0.3, 100.0, 8, 10), ("a", "h", "x", 0.75, 100.0, 8, 10), ("b", "g", "y", 0.7, 300.0, 8, 10)], evaluate.ROW)
    return evaluate.Report(rows).means().select("index", "corpus", F.round("recall", 6).alias("recall"))


@query("SELECT sum(CASE WHEN over THEN 0 ELSE 1 END)::BIGINT AS completed, sum(CASE WHEN over THEN 1 ELSE 0 END)::BIGINT AS truncated, round(avg(CASE WHEN over THEN 1 ELSE 0 END), 6) AS truncated_share FROM (SELECT qid, 90 < nc AS over FROM queries, nc)")
def budget_served(s, d):
    r = serving.served(serving.bounded_search(*_served(s, d), 10, K, 100)[1])
    return r.select("completed", "truncated", F.round("truncated_share", 6).alias("truncated_share"))


@query("SELECT id, round(list_distance(v, c), 6) AS distance, round(list_distance(v, c) / 64 * pi(), 6) AS angle FROM lists JOIN centres USING (part)")
def centre_distances(s, d):
    rows = lists(s, d).join(F.broadcast(label_centres(s, d)), "part").withColumn("x", F.sqrt(V.squared_l2("v", "c")))
    return rows.select("id", F.round("x", 6).alias("distance"), F.round(codes.angle_from_hamming(F.col("x"), 64), 6).alias("angle"))


@query()
def graph_pages(s, d):
    g = sharded.GraphIndex(64, shards=1).build(corpus(s, d).select("id", "v"))
    return storage.page_counts(g.visited(asked(s, d)), storage.sequential_layout(corpus(s, d), 64))
