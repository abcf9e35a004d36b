"""Indexes, structures, states, storage, streams and the command line, on small seeded tables."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield import cli, queries, queries_more  # noqa: F401
from nearfield.errors import ConfigError, DataError, IndexStateError
from nearfield.functions import vector as V
from nearfield.operators import codes, exact, graphs, hashing, index, ivf, kmeans, sharded, structures
from nearfield.plans import churn, evaluate, serving, storage, verify
from nearfield.plans.lineage import materialise
from nearfield.sources import datasets, drift
from nearfield.streaming import batches

D, N = 8, 240


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    v = rng.standard_normal((N, D)) + 0.7 * rng.standard_normal((6, D))[np.arange(N) % 6]
    return v.astype(np.float32)


@pytest.fixture(scope="module")
def corpus(spark, data):
    return materialise(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id long, v array<float>"))


@pytest.fixture(scope="module")
def asked(spark, data):
    return materialise(spark.createDataFrame([(i, (data[i] + 0.1).tolist()) for i in range(12)], "qid long, q array<float>"))


def brute(data, k, rows=None, metric="l2"):
    rows = np.arange(len(data)) if rows is None else np.array(rows)
    out = {}
    for i in range(12):
        q = (data[i] + np.float32(0.1)).astype(np.float64)
        v = data[rows].astype(np.float64)
        s = ((v - q) ** 2).sum(1) if metric == "l2" else -(v @ q)
        out[i] = rows[np.lexsort((rows, s))[:k]].tolist()
    return out


def ids(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.id)
    return out


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_search_is_exact_in_blocks_and_under_predicates(spark, data, corpus, asked, metric):
    assert ids(exact.search(asked, corpus, 5, metric)) == brute(data, 5, metric=metric)
    exact_block = exact.BLOCK_NUMBERS
    try:
        exact.query_blocks.__defaults__ = (3 * D, np.float64)
        assert ids(exact.search(asked, corpus, 5, metric)) == brute(data, 5, metric=metric)
    finally:
        exact.query_blocks.__defaults__ = (exact_block, np.float64)
    even = [i for i in range(N) if i % 2 == 0]
    assert ids(exact.search(asked, corpus, 5, metric, F.col("id") % 2 == 0)) == brute(data, 5, even, metric)
    plan = exact.search(asked, corpus, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ties_go_to_smaller_ids_and_odd_tables_are_defined(spark, asked):
    same = spark.range(50).select("id", F.array(*[F.lit(1.0)] * D).alias("v"))
    assert set(map(tuple, ids(exact.search(asked, same, 4)).values())) == {(0, 1, 2, 3)}
    assert exact.search(asked, same.limit(0), 4).count() == 0
    assert exact.search(asked.limit(0), same, 4).count() == 0
    assert exact.search(asked, same.limit(2), 4).count() == 24
    nulls = same.withColumn("v", F.when(F.col("id") > 40, F.col("v")))
    assert ids(exact.search(asked, nulls, 2))[0] == [41, 42]


def test_guards(spark, corpus, asked):
    with pytest.raises(ConfigError):
        exact.search(asked, corpus, 0)
    with pytest.raises(ConfigError):
        V.metric_named("manhattan")
    with pytest.raises(DataError):
        V.checked(corpus.select("id", F.lit(1).alias("v")))
    with pytest.raises(DataError):
        V.checked(corpus.limit(0))
    with pytest.raises(DataError):
        V.checked(corpus.withColumn("v", F.slice("v", 1, F.when(F.col("id") == 3, 2).otherwise(4))))
    i = index.FlatIndex(D)
    with pytest.raises(IndexStateError):
        i.search(asked)
    with pytest.raises(IndexStateError):
        i.insert(corpus)
    i.build(corpus)
    with pytest.raises(ConfigError):
        i.search(asked, N + 1)
    with pytest.raises(ConfigError):
        i.insert(corpus.limit(1))
    with pytest.raises(ConfigError):
        i.remove(spark.createDataFrame([(999_999,)], "id long"))
    with pytest.raises(ConfigError):
        sharded.TreeIndex(D, metric="ip")
    with pytest.raises(ConfigError):
        ivf.IVFIndex(D, 4, "l2", 5)


def test_flat_index_lives_through_inserts_removals_and_compaction(spark, data, corpus, asked):
    i = index.FlatIndex(D).build(corpus)
    gone = spark.createDataFrame([(0,), (5,), (5,)], "id long")
    assert i.remove(gone) == 2 and i.remove(gone) == 0 and i.size == N - 2
    rest = [x for x in range(N) if x not in (0, 5)]
    found = i.search(asked, 5)
    assert ids(found.result) == brute(data, 5, rest)
    assert found.stats.first().distances == N * 12
    mapping, reclaimed = i.compact()
    assert reclaimed == 2 and sorted(r.id for r in mapping.collect()) == list(range(N - 2))
    assert i.insert(spark.createDataFrame([(5000, data[0].tolist())], "id long, v array<float>")) == 1
    assert i.size == N - 1 and i.vector(5000) == pytest.approx(data[0].tolist())


def test_ivf_with_all_lists_is_exact_and_counts(spark, data, corpus, asked):
    i = ivf.IVFIndex(D, 6, "l2", 6).build(corpus)
    found = i.search(asked, 5)
    assert ids(found.result) == brute(data, 5)
    s = found.stats.first()
    assert s.candidates == N * 12 and s.distances == N * 12 + 6 * 12
    assert i.sizes().agg(F.sum("n")).first()[0] == N
    few = i.search(asked, 5, 1)
    assert few.stats.first().candidates < N * 12
    i.remove(corpus.filter("id < 3").select("id"))
    assert ids(i.search(asked, 5).result) == brute(data, 5, range(3, N))
    i.rebuild()
    assert i.capacity == N - 3


def test_spilled_lists_hold_rows_once_each_in_results(spark, corpus, asked):
    for adaptive in (None, 0.3):
        i = ivf.SpillIndex(D, 6, 2, 2, adaptive).build(corpus)
        r = i.search(asked, 5).result
        assert r.groupBy("qid", "id").count().filter("count > 1").isEmpty() and r.count() == 60
    assert i.lists.count() == N + round(N * 0.3)


@pytest.mark.parametrize("make", [lambda: sharded.TreeIndex(D, 4, shards=3), lambda: hashing.LSHIndex(D, 2, 6), lambda: sharded.GraphIndex(D, 8, 16, 40), lambda: sharded.HNSWIndex(D, 8, 40, 40), lambda: sharded.ForestIndex(D, 8, 40, shards=2), lambda: codes.ResidualIndex(D, 2, 16, 60), lambda: codes.BinaryIndex(D, 120), lambda: codes.CompositeIndex(D, 6, 4, 16, 6, 80)])
def test_structures_build_search_insert_remove(spark, data, corpus, asked, make):
    i = make().build(corpus)
    found = i.search(asked, 5)
    truth = brute(data, 5)
    got = ids(found.result)
    recall = np.mean([len(set(got.get(q, [])) & set(truth[q])) / 5 for q in truth])
    assert recall >= (1.0 if i.name == "tree" else 0.7), (i.name, recall)
    bad = verify.violations(found.result, corpus, asked, 5).filter("violations > 0 AND rule <> 'returns_k_results'")
    assert bad.isEmpty(), (i.name, bad.collect())
    assert found.stats.first().distances > 0
    i.remove(corpus.filter("id = 1").select("id"))
    assert 1 not in {x for v in ids(i.search(asked, 5).result).values() for x in v}
    i.insert(spark.createDataFrame([(9000, (data[2] + 0.1).tolist())], "id long, v array<float>"))
    assert i.size == N and ids(i.search(asked, 5).result)[2][0] == 9000


def test_kd_tree_prunes_and_stays_exact(data):
    t = structures.KdTree(data.astype(float), 8)
    for i in range(20):
        q = data[i].astype(float) + 0.2
        rows, scores, cost = t.search(q, 5)
        d = ((data.astype(float) - q) ** 2).sum(1)
        assert rows.tolist() == np.lexsort((np.arange(N), d))[:5].tolist() and cost < N
    same = structures.KdTree(np.ones((40, 3)), 4)
    assert same.search(np.ones(3), 3)[0].tolist() == [0, 1, 2]


def test_kmeans_never_gets_worse_and_refuses_nonsense(spark, corpus):
    last = math.inf
    for rounds in (1, 2, 5, 10):
        c = kmeans.lloyd(corpus, 6, rounds, 1e-9, init=kmeans.random_init(corpus, 6, 3))
        now = kmeans.inertia_of(kmeans.assign(corpus, c.centres)).first()[0]
        assert now <= last + 1e-6 and c.rounds <= rounds
        last = now
    assert kmeans.minibatch(corpus, 6, 5, 64).sizes.sum() == N
    forced = kmeans.lloyd(corpus, 3, 5, init=np.array([[0.0] * D, [1e6] * D, [-1e6] * D]))
    assert forced.k == 3
    for bad in (lambda: kmeans.lloyd(corpus, 6, 0), lambda: kmeans.lloyd(corpus, 6, 5, 0.0), lambda: kmeans.random_init(corpus, N + 1), lambda: kmeans.fit_on_sample(corpus, 6, 5), lambda: kmeans.uniform_sample(corpus, 0)):
        with pytest.raises(ConfigError):
            bad()
    fit = kmeans.fit_on_sample(corpus, 6, 100)
    assert fit.partitions == 6 and fit.share == 100 / N
    assert kmeans.uniform_sample(corpus, 50, 1).count() == 50 and kmeans.dense_sample(corpus, 50).distinct().count() == 50


def test_graph_tables(spark, corpus):
    g = materialise(graphs.exact_graph(corpus, 4))
    assert g.groupBy("src").count().filter("count <> 4").isEmpty() and g.filter("src = dst").isEmpty()
    both = graphs.symmetrise(g)
    assert graphs.symmetrise(both).count() == both.count() and graphs.reciprocity(both).first()[0] == 1
    found = graphs.nn_descent(corpus, 4, 6, 8)
    assert graphs.recall_against_exact(found, g).first()[0] > 0.8
    thin = graphs.prune(corpus, both, 3)
    assert thin.groupBy("src").count().filter("count > 3").isEmpty()
    assert thin.join(both, ["src", "dst"], "left_anti").isEmpty()
    line = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    vertices = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 500]], "id long")
    c = {r.id: r.component for r in graphs.components(vertices, line).collect()}
    assert set(c.values()) == {0, 100, 500} and c[40] == 0
    with pytest.raises(DataError):
        graphs.check_graph(spark.createDataFrame([(1, 1)], "src long, dst long"))


def test_sign_codes_pack_like_bits(spark):
    rng = np.random.default_rng(1)
    for d in (1, 63, 64, 65, 130):
        bits = rng.random(d) > 0.5
        row = spark.createDataFrame([(bits.tolist(),)], "b array<boolean>").select(codes.pack(F.col("b"), d).alias("w"), codes.unpack(codes.pack(F.col("b"), d), d).alias("b")).first()
        assert row.b == bits.tolist() and len(row.w) == codes.words_needed(d)
        want = [sum(int(b) << i for i, b in enumerate(bits[w : w + 64])) for w in range(0, d, 64)]
        assert [x % 2**64 for x in row.w] == want


def test_rotations_and_transforms_keep_distances(spark, data, corpus, asked):
    for r in (codes.random_rotation(D, 3), codes.pca_rotation(corpus, 4)):
        assert np.allclose(r @ r.T, np.eye(D))
        turned = exact.search(codes.rotate(asked, r, "q"), codes.rotate(corpus, r), 5)
        assert ids(turned) == brute(data, 5)
    mean, cov, n = codes.covariance(corpus)
    assert n == N and np.allclose(mean, data.astype(float).mean(0)) and np.allclose(cov, np.cov(data.T.astype(float), bias=True))
    white = drift.fit_whitening(corpus).apply(corpus)
    _, c, _ = codes.covariance(white)
    assert np.allclose(c * N / (N - 1), np.eye(D), atol=1e-6)
    assert drift.fit_reduction(corpus, D).kept_variance == pytest.approx(1.0)
    assert drift.recall_after(corpus, asked, drift.fit_centring(corpus), 5).first()[0] == 1.0
    model = codes.train_rotated(corpus, 4, 16, "pca")
    assert model.search(asked, model.encode(corpus), 5).count() == 60
    books = codes.residual_fit(corpus, 3, 16)
    left = [r.left for r in codes.residual_norms(corpus, books, books.encode(corpus)).orderBy("stage").collect()]
    assert left == sorted(left, reverse=True) and left[0] < 1


def test_save_and_load_all_kinds(spark, data, corpus, asked, tmp_path):
    for make in (lambda: index.FlatIndex(D, "ip"), lambda: ivf.IVFIndex(D, 6, "l2", 3), lambda: ivf.SpillIndex(D, 6, 3), lambda: codes.BinaryIndex(D, 50, rotate="random"), lambda: sharded.TreeIndex(D), lambda: sharded.GraphIndex(D, 8, 16)):
        i = make().build(corpus)
        i.remove(corpus.filter("id = 2").select("id"))
        path = f"file://{tmp_path}/{i.name}"
        header = storage.save(i, path, {"by": "test"})
        assert storage.peek(spark, path) == header and header.live == N - 1
        again = storage.load(spark, path)
        assert again.metric == i.metric and ids(again.search(asked, 5).result) == ids(i.search(asked, 5).result)
    spark.createDataFrame([(1, [0.0] * D)], "id long, v array<float>").write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(DataError):
        storage.load(spark, path)
    with pytest.raises(DataError):
        storage.peek(spark, f"file://{tmp_path}/nothing")


def test_numbered_is_dense_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1009).alias("id")).repartition(5)
    got = sorted((r.id, r.number) for r in storage.numbered(rows, "id").collect())
    assert [n for _, n in got] == list(range(1000))
    assert storage.numbered(rows.limit(0), "id").count() == 0


def test_streams_answer_once_and_caches_follow_order(spark, data, corpus, asked, tmp_path):
    i = index.FlatIndex(D).build(corpus)
    path = str(tmp_path / "in")
    asked.coalesce(1).write.parquet(path)
    stats = batches.BatchStats()
    stream = spark.readStream.schema(asked.schema).parquet(path)
    for _ in range(2):
        batches.answer_stream(stream, i, 5, str(tmp_path / "out"), str(tmp_path / "check"), stats)
    assert stats.queries == 12 and ids(spark.read.parquet(str(tmp_path / "out"))) == brute(data, 5)
    seen = [(0, [0.0, 0.0]), (1, [5.0, 5.0]), (2, [0.0, 0.0]), (3, [0.1, 0.0]), (4, [9.0, 9.0]), (5, [0.0, 0.0])]
    q = spark.createDataFrame(seen, "qid long, q array<float>")
    got = {r.qid: (r.served_by, r.hit) for r in batches.run_cache(q, None, 2).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (0, True), 3: (3, False), 4: (4, False), 5: (5, False)}
    near = {r.qid: (r.served_by, r.lookup_distances) for r in batches.run_cache(q, 0.5, 8).collect()}
    assert near[3] == (0, 2) and near[5] == (0, 3)
    q.coalesce(1).write.parquet(str(tmp_path / "q"))
    live = batches.cache_over_stream(spark.readStream.schema(q.schema).parquet(str(tmp_path / "q")))
    live.writeStream.format("parquet").option("path", str(tmp_path / "c")).option("checkpointLocation", str(tmp_path / "cc")).trigger(availableNow=True).start().awaitTermination()
    assert {r.qid: (r.first_qid, r.hit) for r in spark.read.parquet(str(tmp_path / "c")).collect()}[5] == (0, True)
    assert batches.exact_cache_hits(q).first().hits == 2


def test_churn_drift_and_stability(spark, corpus, asked):
    built, arriving, q = churn.split_for_churn(corpus, 0.6, 10)
    built, arriving, q = materialise(built), materialise(arriving), materialise(q)
    steps = churn.insert_in_batches(index.FlatIndex(D), built, arriving, q, 2, 5)
    assert [s.quality.recall for s in steps] == [1.0, 1.0] and steps[-1].size == built.count() + arriving.count()
    steps = churn.remove_in_batches(index.FlatIndex(D), built, q, 2, 0.3, 5)
    assert all(s.quality.recall == 1.0 for s in steps) and steps[-1].churn > 0
    for kind in ("shift", "scale", "rotate"):
        assert drift.drifted(asked, kind, 0.5).count() == 12
    with pytest.raises(ConfigError):
        drift.drifted(asked, "melt", 1)
    rows = evaluate.across_seeds(lambda s: ivf.IVFIndex(D, 6, "l2", 2, s), corpus, asked, 5, range(2))
    assert evaluate.spread(rows).first().seeds == 2


def test_generators_and_diagnostics(spark):
    g = materialise(datasets.gaussian(spark, 600, 6))
    assert V.checked(g) == (600, 6)
    rest, held = datasets.held_out(g, 40)
    assert held.count() == 40 and rest.count() == 560 and rest.join(held, rest.id == held.qid).isEmpty()
    flat = materialise(datasets.on_a_subspace(spark, 600, 20, 2))
    low, high = datasets.intrinsic_dimension(flat, 300).first()[0], datasets.intrinsic_dimension(g, 300).first()[0]
    assert 1.5 < low < 3 < high
    d = drift.near_duplicates(g, 0.3)
    assert d.count() == 600 and d.filter("id <> original").count() > 100
    assert datasets.perturbed_queries(g, 16).count() == 16 and datasets.clustered(spark, 100, 4).count() == 100
    for kind in (datasets.skewed, datasets.unit_vectors, datasets.scaled_vectors):
        assert kind(spark, 64, 8).count() == 64


def test_budgets_fleet_and_report(spark, corpus, asked):
    b = serving.Budget(10)
    assert [b.charge(7), b.charge(7), b.exhausted] == [7, 3, True]
    fleet = serving.build_fleet(corpus, D, 2, 6, 2)
    answers = materialise(serving.tagged({n: i.search(asked, 5).result for n, i in fleet.items()}))
    assert serving.merge_replicas(answers, 5).count() == 60
    assert 0 < serving.agreement(answers).first().sets <= 1
    rows = spark.createDataFrame([("a", "g", "x", 0.5, 100.0, 8, 10), ("b", "g", "y", 0.7, 300.0, 8, 10)], evaluate.ROW)
    r = evaluate.Report(rows, {"g": 1000}).checked()
    assert json.loads(r.as_json())[0]["index"] == "a" and "recall" in r.as_table()
    assert {x["index"]: x.recall for x in evaluate.compare_at_a_budget(r, "g", 200).collect()} == {"a": 0.5, "b": 0.0}
    assert r.means().count() == 3 and r.with_speedup().filter("index = 'a'").first().speedup == 10
    with pytest.raises(DataError):
        r.add({"index": "c", "corpus": "g", "setting": "z", "recall": 2.0, "distances": 1.0, "memory_bytes": 1, "queries": 1}).checked()


def test_awkward_corpora_keep_the_invariants(spark):
    report = materialise(verify.sweep(spark, ("flat", "ivf", "tree"), 4, 128, 4, 5))
    assert report.count() == 5 * 3 * 6
    bad = report.filter("violations > 0 AND NOT (index = 'ivf' AND rule = 'returns_k_results')")
    assert bad.isEmpty(), bad.collect()


def test_command_line(spark, tmp_path):
    small = ["--count", "200", "--dimension", "8", "--queries", "8", "--k", "3", "--json"]
    r = cli.dispatch(["measure", "--index", "flat", *small], spark)
    assert r.ok and json.loads(r.output)["recall"] == 1.0
    path = f"file://{tmp_path}/i"
    assert cli.dispatch(["build", "--index", "ivf", "--path", path, *small], spark).ok
    assert json.loads(cli.dispatch(["inspect", "--path", path, *small], spark).output)["kind"] == "ivf"
    s = json.loads(cli.dispatch(["sweep", "--index", "ivf", *small, "--values", "1", "16"], spark).output)
    assert s["rows"][-1]["recall"] == 1.0
    assert json.loads(cli.dispatch(["shortlist", *small], spark).output)["depths"]
    bad = cli.dispatch(["measure", "--index", "nothing", *small], spark)
    assert bad.code == 1 and "unknown index" in bad.error


def test_structures_skip_a_removed_cluster_inside_the_walk():
    v = np.random.default_rng(4).standard_normal((300, 6))
    q = v[0]
    d = ((v - q) ** 2).sum(1)
    order = np.lexsort((np.arange(300), d))
    dead = np.zeros(300, dtype=bool)
    dead[order[:60]] = True
    want = order[60:65].tolist()
    assert structures.KdTree(v, 8).search(q, 5, dead=dead)[0].tolist() == want
    for made in (structures.BeamGraph(v), structures.Hnsw(v), structures.Forest(v, leaf_size=300)):
        assert made.search(q, 5, dead=dead)[0].tolist() == want


def test_a_tree_stays_exact_after_a_cluster_is_removed(spark):
    v = np.random.default_rng(6).standard_normal((200, 4))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    order = np.argsort(((v - v[0]) ** 2).sum(1)).tolist()
    made = sharded.TreeIndex(4, shards=1).build(table)
    made.remove(spark.createDataFrame([(i,) for i in order[:50]], "id long"))
    found = made.search(spark.createDataFrame([(0, v[0].tolist())], "qid long, q array<double>"), 5).result
    assert [r.id for r in sorted(found.collect(), key=lambda r: r["rank"])] == order[50:55]


def test_a_saved_index_with_a_changed_table_is_refused(spark, corpus, tmp_path):
    for name, make, table in (("tree", lambda: sharded.TreeIndex(D, shards=2), "structures"), ("ivf", lambda: ivf.IVFIndex(D, 4, "l2", 4), "lists"), ("binary", lambda: codes.BinaryIndex(D), "codes")):
        paths = [f"{tmp_path}/{name}{i}" for i in (0, 1)]
        for path, rows in zip(paths, (corpus, corpus.select("id", V.times("v", -3.0).cast("array<float>").alias("v"))), strict=True):
            storage.save(make().build(rows), path)
        storage.load(spark, paths[0])
        other = spark.read.parquet(f"{paths[1]}/{table}")
        (other.write.partitionBy("part") if table == "lists" else other.write).mode("overwrite").parquet(f"{paths[0]}/{table}")
        with pytest.raises(DataError):
            storage.load(spark, paths[0])
    manifest = json.loads((tmp_path / "ivf1" / "manifest.json").read_text())
    manifest["detail"]["centres"][0][0] += 1
    (tmp_path / "ivf1" / "manifest.json").write_text(json.dumps(manifest))
    (tmp_path / "ivf1" / ".manifest.json.crc").unlink()
    with pytest.raises(DataError):
        storage.load(spark, paths[1].replace("binary", "ivf"))


def test_many_small_inserts_leave_few_shards(spark, data, corpus, asked):
    index_ = sharded.TreeIndex(D, shard_rows=60).build(corpus.filter("id < 200"))
    for at in range(200, N, 8):
        index_.insert(corpus.filter(F.col("id").between(at, at + 7)))
    assert index_.structures.count() <= 8
    assert ids(index_.search(asked, 5).result) == brute(data, 5)
    held = index_.structures.select(F.explode("ids").alias("id"))
    assert held.count() == held.distinct().count() == N


def test_structures_survive_their_arrays(data):
    v = data.astype(np.float64)
    for made in (structures.KdTree(v, 8), structures.Forest(v, 3, 16), structures.BeamGraph(v, 8, 16), structures.Hnsw(v, 6, 16, 16)):
        again = type(made).restored(structures.unpacked(structures.packed(made.arrays())))
        for q in v[:20] + 0.1:
            a, b = made.search(q, 6), again.search(q, 6)
            assert a[0].tolist() == b[0].tolist() and a[2] == b[2] and np.allclose(a[1], b[1])


def test_numbers_and_totals_go_over_all_tasks(spark):
    rows = spark.range(0, 500, 1, 7).select((F.col("id") * 7919 % 500).alias("id"), (F.col("id") % 9).alias("part"), F.lit(2).alias("n"))
    total = {r.id: r.before for r in storage.running_total(rows, "n", "id").collect()}
    assert total == {i: 2 * i for i in range(500)}
    place = {}
    for r in sorted(storage.placed(rows.select("part", "id")).collect()):
        place.setdefault(r.part, []).append((r.id, r.place))
    assert all([x[1] for x in sorted(p)] == list(range(1, len(p) + 1)) for p in place.values())


@pytest.mark.parametrize("capacity", [1, 3, 64, 1000])
@pytest.mark.parametrize("radius", [0.0, 0.4])
def test_a_near_cache_is_a_queue_of_its_last_keys(capacity, radius):
    cache, keys = batches.NearCache(radius, capacity), []
    for i, q in enumerate(np.random.default_rng(0).integers(0, 4, (500, 4)) / 4):
        d = [float(((k - q) ** 2).sum()) for k, _ in keys]
        want = keys[int(np.argmin(d))][1] if d and min(d) <= radius**2 else None
        assert cache.get(q) == (want, len(keys))
        if want is None:
            cache.put(q, i)
            keys = [*keys, (q, i)][-capacity:]
        assert cache.size == len(keys)


def test_graphs_are_pruned_together_as_one_by_one():
    rng = np.random.default_rng(6)
    v = np.concatenate((rng.standard_normal((400, 6)), np.ones((5, 6))))
    made = structures.BeamGraph(v, 6, 12, alpha=1.1)
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = [set() for _ in v]
    for i in range(len(v)):
        for j in np.lexsort((np.arange(len(v)), d[i]))[:12]:
            near[i].add(int(j))
            near[int(j)].add(i)
    src = np.repeat(np.arange(len(v)), [len(s) for s in near])
    want = [structures.diverse(v, i, np.array(sorted(s)), 6, 1.1) for i, s in enumerate(near)]
    assert structures.pruned(v, src, np.concatenate([sorted(s) for s in near]), 6, 1.1) == want
    assert all(x[: len(w)] == w for x, w in zip(made.links, want, strict=True))


def test_graphs_lead_to_every_row():
    rng = np.random.default_rng(9)
    v = np.concatenate((rng.standard_normal((500, 16)), rng.standard_normal((40, 16)) + 30, np.zeros((30, 16))))
    for made in (structures.BeamGraph(v, 3, 4), structures.Hnsw(v, 2, 8, 8, multiplier=4.0)):
        for x in (v[0], v[520], v[560]):
            rows, _, _ = made.search(x, len(v), ef=10**6)
            assert sorted(rows.tolist()) == list(range(len(v)))


def test_a_beam_of_all_rows_is_one_scan_of_what_its_start_leads_to(monkeypatch):
    rng = np.random.default_rng(7)
    v = np.concatenate((rng.standard_normal((300, 4)), rng.standard_normal((60, 4)) + 50, np.zeros((9, 4))))
    q, dead = np.concatenate((rng.standard_normal((20, 4)), np.full((3, 4), 50.0))), np.zeros(len(v), dtype=bool)
    dead[[1, 2, 301, 365]] = True
    made = [structures.BeamGraph(v, 4, 8), structures.Hnsw(v, 4, 16, 16, multiplier=4.0)]
    want = [[m.search(x, 7, ef=10**6, dead=dead) for x in q] for m in made]
    monkeypatch.setattr(structures, "beam", lambda *a, **k: pytest.fail("a walk a query"))
    for m, w in zip(made, want, strict=True):
        for (rows, scores, cost), (r, s, c) in zip(m.answers(q, 7, dead, ef=10**6), w, strict=True):
            assert rows.tolist() == r.tolist() and np.allclose(scores, s) and cost == c


def test_rows_of_spilled_lists_are_counted_by_sets_of_lists(spark):
    rng = np.random.default_rng(11)
    held = [sorted(set(rng.integers(0, 5, 2).tolist())) for _ in range(400)]
    opens = [sorted(set(rng.integers(0, 5, 2).tolist())) for _ in range(90)]
    lists = spark.createDataFrame([(p, i) for i, ps in enumerate(held) for p in ps], "part int, id long")
    opened = spark.createDataFrame([(i, p) for i, ps in enumerate(opens) for p in ps], "qid long, part int")
    counted = ivf.opened_rows(opened, lists, 2)
    assert counted.first().n == sum(bool(set(a) & set(b)) for a in held for b in opens)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "qid" not in plan.split("Join")[0]  # queries and rows never meet one by one


def test_nearest_meets_rows_in_tiles_and_stays_exact():
    r = np.random.default_rng(3)
    for offset in (0.0, 1e7, 1e25):
        v = r.standard_normal((2500, 6)).astype(np.float32).astype(float) + offset
        v[900:1400] = v[7]  # ties beyond a tile's k
        q, ids = v[::3], r.permutation(len(v)) - 50
        near = exact.Nearest(q, 5)
        for at in range(0, len(v), 1100):
            near.meet(v[at : at + 1100], ids[at : at + 1100])
        d = ((q[:, None] - v[None]) ** 2).sum(2)
        want = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :5]
        assert (near.found()[1].reshape(-1, 5) == ids[want]).all()
        assert (near.found()[2].reshape(-1, 5) == np.take_along_axis(d, want, 1)).all() or np.allclose(near.found()[2].reshape(-1, 5), np.take_along_axis(d, want, 1), rtol=1e-12)
    few = exact.Nearest(v[:2], 5)
    few.meet(v[:3], np.arange(3), own=np.arange(2))
    assert few.many.tolist() == [2, 2]


def test_a_scan_of_lists_keeps_to_tiles():
    import tracemalloc
    from types import SimpleNamespace

    r = np.random.default_rng(4)
    q, v, parts = r.standard_normal((2000, 16)), r.standard_normal((10_000, 16)), r.integers(0, 2, 10_000).astype(np.int32)
    here = SimpleNamespace(mapInArrow=lambda run, schema: run)  # the task's function itself
    opened = {0: np.arange(2000), 1: np.arange(0, 2000, 2)}
    run = exact.scan_keyed(here, SimpleNamespace(value=(np.arange(2000), q, opened)), 5, "l2", False)
    batch = pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.arange(10_000)), pa.array(v.tolist())], names=["part", "id", "v"])
    tracemalloc.start()
    found = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 5 * 2000
    assert most < 64_000_000  # all 2,000 x 10,000 scores alone would be 160 MB


def test_lists_are_kept_before_they_are_scanned(spark):
    sf = "/root/testdata/sf0.001"
    plans = [f(spark, sf)._jdf.queryExecution().optimizedPlan().toString() for f in (queries.rough, queries.QUERIES["shortlist_of_lists"], queries.QUERIES["filter_in_lists"])]
    assert [p.count("MapInArrow") for p in plans] == [1, 1, 1]  # one Python process a task, not one that feeds another


def test_pair_distances_count_each_pair_once_over_blocks_and_tasks(spark, corpus, data):
    v = data.astype(float)
    want = [float(np.sqrt(((v[i] - v[i + 1 :]) ** 2).sum(1)).sum()) for i in range(len(v))]
    for block_rows in (70, 10_000):
        got = exact.pair_distance_sum(corpus, block_rows).first()
        assert got.n == len(data) * (len(data) - 1) // 2 and got.total == pytest.approx(sum(want), rel=1e-12)
    whole = datasets._sampled(corpus, len(data), 5)
    assert "TakeOrdered" not in whole._jdf.queryExecution().toString()  # all rows are not put in order by one task


def test_sparse_regions_leave_out_rows_by_bounds_only(spark, corpus, data):
    d = np.sort(((data[:, None] - data[None]) ** 2).sum(2), axis=1)[:, 4]
    want = set(np.lexsort((np.arange(len(d)), -d))[:6].tolist())
    for first_rows in (8, 40, 10**6):
        assert {r.qid for r in evaluate.from_sparse_regions(corpus, corpus, 6, 4, first_rows).collect()} == want


def test_blocks_of_queries_get_what_single_walks_of_trees_get():
    r = np.random.default_rng(8)
    v = r.standard_normal((3000, 5)).round(1)  # with ties
    dead = r.random(len(v)) < 0.3
    q = r.standard_normal((700, 5))
    for made in (structures.KdTree(v, 8), structures.Forest(v, 3, 40), structures.Forest(v, 3, 10**6)):
        for gone in (None, dead):
            for x, (rows, scores, cost) in zip(q[::50], list(made.answers(q, 6, dead=gone))[::50], strict=True):
                want = made.search(x, 6, dead=gone)
                assert rows.tolist() == want[0].tolist() and np.allclose(scores, want[1], rtol=1e-12) and 0 < cost <= max(len(v), want[2])
    few = structures.KdTree(v[:4], 2)
    assert [rows.tolist() for rows, _, _ in few.answers(v[:2], 9)] == [few.search(x, 9)[0].tolist() for x in v[:2]]


def test_asking_for_few_shards_never_overfills_them(spark, corpus, asked, data):
    made = sharded.TreeIndex(D, shards=1, shard_rows=100).build(corpus)
    assert made.structures.count() >= 3 or made.structures.agg(F.max("n")).first()[0] <= 100
    assert sharded.GraphIndex(D, shards=1).shard_rows <= 16_384 and sharded.HNSWIndex(D, shards=1).shard_rows <= 16_384
    got = {}
    for r in made.search(asked, 5).result.collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id))
    v = data.astype(float)
    for r in asked.collect():
        order = np.lexsort((np.arange(N), ((v - np.array(r.q)) ** 2).sum(1)))[:5]
        assert [x for _, x in sorted(got[r.qid])] == order.tolist()


def test_pages_of_lists_are_counted_without_pairs_of_queries_and_rows(spark, corpus, asked):
    lists = kmeans.assign(corpus, kmeans.random_init(corpus, 5, 1)).select("part", "id", "v")
    opened = spark.createDataFrame([(q, p) for q in range(12) for p in {q % 5, q % 3}], "qid long, part int")
    for layout in (storage.clustered_layout(lists, 64), storage.sequential_layout(corpus, 64)):
        want = storage.page_counts(opened.join(lists.select("part", "id"), "part").select("qid", "id"), layout)
        got = storage.list_page_counts(opened, lists, layout)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert "opens" in got._jdf.queryExecution().optimizedPlan().toString()


def test_bucket_mates_are_tested_in_a_scan_and_meet_once(spark, corpus, asked, data):
    planes = hashing.random_planes(D, 2, 3, 5)
    q, rows = hashing.keyed(asked, planes, "qid", "q"), hashing.keyed(corpus, planes)
    filed, theirs = hashing.signatures(corpus, planes), hashing.signatures(asked, planes, "qid", "q")
    want = {tuple(r) for r in theirs.join(filed, ["tbl", "sig"]).select("qid", "id").distinct().collect()}
    pairs = hashing.lsh_candidates(q, rows)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    best = {}
    for r in hashing.lsh_search(asked, corpus, planes, 4).collect():
        best.setdefault(r.qid, []).append((r["rank"], r.id))
    scores = {r.qid: ((data.astype(float) - np.array(r.q)) ** 2).sum(1) for r in asked.collect()}
    for qid, d in scores.items():
        own = sorted((d[i], i) for a, i in want if a == qid)[:4]
        assert [i for _, i in sorted(best.get(qid, []))] == [i for _, i in own]


def test_neighbours_of_neighbours_are_scored_where_they_meet(spark, corpus, data):
    near = spark.createDataFrame([(0, 1), (1, 2), (1, 0), (2, 3), (5, 1)], "src long, dst long")
    v = data.astype(float)
    got = {(r.src, r.dst): r.score for r in graphs._tried(corpus, near).collect()}
    assert set(got) == {(0, 2), (1, 3), (5, 2), (5, 0)}
    assert all(s == pytest.approx(((v[a] - v[b]) ** 2).sum(), rel=1e-12) for (a, b), s in got.items())


def test_a_layered_graph_links_rows_with_the_nearest_before_them_without_a_walk(monkeypatch):
    monkeypatch.setattr(structures, "beam", lambda *a, **k: pytest.fail("a walk a row"))
    r = np.random.default_rng(13)
    v = np.concatenate(((4 * r.standard_normal((900, 6))).round() / 4, np.zeros((30, 6))))  # with ties, over two tiles of queries
    made, links = structures.Hnsw(v, 3, 8, 5, multiplier=4.0), structures.linked(v, 5, 6)
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    want = [set() for _ in v]
    for i in range(len(v)):
        for j in np.lexsort((np.arange(i), d[i, :i]))[:5].tolist():
            want[i].add(j)
            want[j].add(i)
    want = [sorted(s, key=lambda j, i=i: (d[i, j], j))[:6] for i, s in enumerate(want)]
    assert [x.tolist() for x in links] == want
    assert all(made.layers[0][i][: len(w)] == w for i, w in enumerate(want))
    assert made.entry == int(made.levels.argmax()) and [len(x) for x in made.layers] == [int((made.levels >= n).sum()) for n in range(len(made.layers))]


def test_descent_finds_most_neighbours_where_vectors_have_no_structure(spark):
    r = np.random.default_rng(17).standard_normal((1500, 64))
    v = materialise(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r)], "id long, v array<double>"))
    found = graphs.nn_descent(v, 5, 4, 10)
    assert found.groupBy("src").agg(F.count("*").alias("n"), F.max("ord").alias("last")).filter("n <> 5 or last <> 5").isEmpty()
    assert graphs.recall_against_exact(found, graphs.exact_graph(v, 5)).first()[0] >= 0.6
    edge = spark.createDataFrame([(0, 120.0)], "src long, edge double")
    near = spark.createDataFrame([(0, 1), (3, 1), (1, 2), (1, 4), (1, 5), (1, 6)], "src long, dst long")
    d = ((r[[0, 3]][:, None] - r[[2, 4, 5, 6]][None]) ** 2).sum(2)
    want = {(0, j) for j, x in zip((2, 4, 5, 6), d[0], strict=True) if x <= 120.0} | {(3, j) for j in (2, 4, 5, 6)}
    assert {(x.src, x.dst) for x in graphs._tried(v, near, edge).collect()} == want
