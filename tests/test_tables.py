"""Graphs, forests and trees as tables, kernels of scans, exact distances: against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.errors import BuildError, ConfigError
from nearfield.operators import codes, exact, graphs, kmeans, structures, tables
from nearfield.plans.lineage import materialise


def frame(spark, v, ids="id", name="v", first=0):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], f"{ids} long, {name} array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return rng.standard_normal((600, 8)) + 3 * rng.standard_normal((12, 8))[np.arange(600) % 12]


@pytest.fixture(scope="module")
def corpus(spark, data):
    return materialise(frame(spark, data))


@pytest.fixture(scope="module")
def asked(spark, data):
    return materialise(frame(spark, data[:24] + 0.05, "qid", "q"))


def ids(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.id)
    return out


def nearest(v, q, k, rows=None):
    rows = np.arange(len(v)) if rows is None else np.array(rows)
    return rows[np.lexsort((rows, ((v[rows] - q) ** 2).sum(1)))[:k]].tolist()


def recall(found, v, q, k):
    return np.mean([len(set(found[i]) & set(nearest(v, x, k))) / k for i, x in enumerate(q)])


# -- exact distances -------------------------------------------------------------------------


def test_small_distances_of_large_vectors(spark):
    v = np.array([[10000 + (20 - i) * 1e-4, 10000.0] for i in range(20)])
    found = exact.search(frame(spark, np.array([[10000.0, 10000.0]]), "qid", "q"), frame(spark, v), 3).collect()
    assert [r.id for r in sorted(found, key=lambda r: r["rank"])] == [19, 18, 17]
    assert np.allclose(sorted(r.score for r in found), [1e-8, 4e-8, 9e-8])
    same = exact.search(frame(spark, v[:2], "qid", "q"), frame(spark, np.repeat(v[:2], 3, axis=0)), 3)
    assert ids(same) == {0: [0, 1, 2], 1: [3, 4, 5]} and all(r.score == 0 for r in same.collect())


def test_kept_pairs_are_those_of_all_differences():
    rng = np.random.default_rng(1)
    for shift in (0.0, 1e3, 1e7):
        q, v = rng.standard_normal((20, 6)) + shift, rng.standard_normal((900, 6)) + shift
        v[300:330] = v[0]
        plain = ((q[:, None] - v[None]) ** 2).sum(2)
        got = exact.nearest_scores(q, v, 7)
        assert (np.argsort(got, 1, kind="stable")[:, :7] == np.argsort(plain, 1, kind="stable")[:, :7]).all()
        assert np.allclose(exact.score_matrix(q, v, "l2"), plain, rtol=1e-9, atol=0)


# -- graph -----------------------------------------------------------------------------------


def walked(v, links, entry, q, width, at_once=1):
    """What one query's walk scores, in memory."""
    d = lambda i: float(((v[i] - q) ** 2).sum())
    seen, opened = {entry: d(entry)}, set()
    while True:
        order = sorted(seen, key=lambda i: (seen[i], i))
        worst = seen[order[width - 1]] if len(order) >= width else np.inf
        now = [i for i in order if i not in opened and seen[i] <= worst][:at_once]
        if not now:
            return seen
        opened.update(now)
        for i in {j for o in now for j in links.get(o, [])} - set(seen):
            seen[i] = d(i)


@pytest.fixture(scope="module")
def graph(corpus):
    return tables.EdgeGraph(8, degree=10, build_degree=16, ef=12, at_once=4).build(corpus)


def links_of(graph):
    links = {}
    for r in graph.pairs().collect():
        links.setdefault(r.src, []).append(r.dst)
    return links


def test_a_walk_over_edges_is_the_walk_in_memory(graph, data, asked):
    links = links_of(graph)
    for at_once, ef in ((1, 3), (4, 12)):
        graph.at_once = at_once
        want = {(i, j) for i in range(24) for j in walked(data, links, graph.entry, data[i] + 0.05, ef, at_once)}
        assert {tuple(r) for r in graph.visited(asked, ef).select("qid", "id").collect()} == want


def test_recall_and_distances_of_both_walks(graph, data, asked):
    graph.at_once = 2
    links = [sorted(links_of(graph).get(i, [])) for i in range(600)]
    found = graph.search(asked, 10, ef=16)
    pairs = [structures.beam(data, links, [graph.entry], data[i] + 0.05, 16) for i in range(24)]
    alone = {i: [r for _, r in kept[:10]] for i, (kept, _) in enumerate(pairs)}
    q = data[:24] + 0.05
    assert abs(recall(ids(found.result), data, q, 10) - recall(alone, data, q, 10)) <= 0.02
    assert found.stats.first().distances == pytest.approx(sum(c for _, c in pairs), rel=0.1)


def test_removed_vertices_lead_on_but_are_not_found(spark, corpus, data, asked):
    graph = tables.EdgeGraph(8, degree=10, build_degree=16, ef=600, at_once=200).build(corpus)
    gone = [r for i in range(24) for r in nearest(data, data[i] + 0.05, 2)]
    graph.remove(spark.createDataFrame([(int(i),) for i in set(gone)], "id long"))
    left = sorted(set(range(600)) - set(gone))
    reached = {i: set() for i in range(24)}
    for r in graph.visited(asked, 600).collect():
        reached[r.qid].add(r.id)
    got = ids(graph.search(asked, 5, ef=600).result)
    assert got == {i: nearest(data, data[i] + 0.05, 5, sorted(reached[i] & set(left))) for i in range(24)}


def test_inserts_link_both_ways_over_two_batches(spark, corpus, data):
    graph = tables.EdgeGraph(8, degree=5, build_degree=16, ef=2000, at_once=400).build(corpus, edges=graphs.symmetrise(graphs.exact_graph(corpus, 12)).unionAll(
        spark.createDataFrame([(i, i + 1) for i in range(599)], "src long, dst long")))
    before = {tuple(r) for r in graph.pairs().collect()}
    rng, v = np.random.default_rng(9), data
    for batch in range(2):
        new = rng.standard_normal((7, 8)) + data[rng.integers(0, 600, 7)]
        first = len(v)
        graph.insert(frame(spark, new, first=first))
        for i, x in enumerate(new):
            near = nearest(v, x, 5)
            before |= {(first + i, j) for j in near} | {(j, first + i) for j in near}
        v = np.concatenate((v, new))
        assert {tuple(r) for r in graph.pairs().collect()} == before, batch
    assert graph.version == 2 and graph.edges.select("version").distinct().count() == 3


def test_a_hub_takes_several_rows_and_crowds_are_salted(spark, monkeypatch):
    v = np.random.default_rng(0).standard_normal((300, 4))
    star = [(0, i) for i in range(1, 300)] + [(i, 0) for i in range(1, 300)]
    monkeypatch.setattr(tables, "CROWD", 5)
    graph = tables.EdgeGraph(4, ef=30, entry="first", at_once=64).build(frame(spark, v), spark.createDataFrame(star, "src long, dst long"))
    assert graph.edges.filter("src = 0").count() == 5 and graph.edges.agg(F.max(F.size("near"))).first()[0] == tables.BLOCK
    assert ids(graph.search(frame(spark, v[:40], "qid", "q"), 3).result) == {i: nearest(v, v[i], 3) for i in range(40)}


def test_graph_refusals(spark, corpus, asked):
    with pytest.raises(BuildError):
        tables.EdgeGraph(8, build_degree=600).build(corpus)
    with pytest.raises(ConfigError):
        tables.EdgeGraph(8, ef=4).build(corpus, spark.createDataFrame([(0, 1)], "src long, dst long")).search(asked, 5)


# -- forest ----------------------------------------------------------------------------------


def grown(v, directions, leaf, rule="median"):
    """Leaves of one tree with a direction a level: node of each row."""
    node = np.ones(len(v), dtype=int)
    for direction in directions:
        p, split = v @ direction, False
        for n in np.unique(node):
            at = np.flatnonzero(node == n)
            own = np.sort(p[at])
            line = own[(len(at) - 1) // 2] if rule == "median" else (own[0] + own[-1]) / 2
            if len(at) > leaf and line < own[-1] and n not in grown.done:
                node[at] = 2 * n + (p[at] > line)
                split = True
            else:
                grown.done.add(n)
        if not split:
            break
    return node


@pytest.mark.parametrize("rule", ["median", "midpoint"])
def test_leaves_are_those_of_level_by_level_splits(corpus, data, rule):
    forest = tables.LeafForest(8, trees=2, leaf_size=40, split_on=rule, seed=4).build(corpus)
    got = {}
    for r in forest.leaves().collect():
        got.setdefault(r.leaf >> 56, {})[r.id] = r.leaf & ((1 << 56) - 1)
    for t in range(2):
        grown.done = set()
        assert [got[t][i] for i in range(600)] == grown(data, forest.directions[t], 40, rule).tolist()
    sizes = forest.leaf_sizes().collect()
    if rule == "median":
        assert max(r.n for r in sizes) <= 40 and forest.depth() == 4


def test_forest_answers_are_the_nearest_of_the_union_of_leaves(spark, corpus, data, asked):
    forest = tables.LeafForest(8, trees=4, leaf_size=80, seed=1).build(corpus)
    rows, homes = {}, {}
    for r in forest.leaves().collect():
        rows.setdefault(r.leaf, set()).add(r.id)
    for r in forest.leaves(asked, "qid", "q").collect():
        homes.setdefault(r.qid, []).append(r.leaf)
    for trees in (1, 4):
        found = forest.search(asked, 5, trees)
        own = {i: [x for x in homes[i] if x >> 56 < trees] for i in range(24)}
        assert ids(found.result) == {i: nearest(data, data[i] + 0.05, 5, sorted(set().union(*(rows[x] for x in own[i])))) for i in range(24)}
        assert found.stats.first().candidates == sum(len(rows[x]) for i in range(24) for x in own[i])
    new = np.random.default_rng(5).standard_normal((9, 8))
    depth = forest.depth()
    forest.insert(frame(spark, new, first=600))
    forest.remove(spark.createDataFrame([(0,), (603,)], "id long"))
    got = ids(forest.search(frame(spark, new, "qid", "q"), 1).result)
    assert {i: got[i][0] for i in range(9) if i != 3} == {i: 600 + i for i in range(9) if i != 3} and got[3] != [603]
    assert forest.depth() == depth


# -- tree ------------------------------------------------------------------------------------


def test_boxes_give_exact_answers_from_a_part_of_the_rows(spark, corpus, data, asked):
    tree = tables.BoxTree(8, leaf_size=40).build(corpus)
    found = tree.search(asked, 6)
    assert ids(found.result) == {i: nearest(data, data[i] + 0.05, 6) for i in range(24)}
    assert 0 < found.stats.first().distances < 0.7 * 24 * 600
    assert sum(len(r.ids) for r in tree.leaves.collect()) == 600 and max(len(r.ids) for r in tree.leaves.collect()) <= 40
    new = data[:5] + 0.05
    tree.insert(frame(spark, new, first=600))
    tree.remove(spark.createDataFrame([(1,), (602,)], "id long"))
    every, left = np.concatenate((data, new)), sorted(set(range(605)) - {1, 602})
    assert ids(tree.search(asked, 4).result) == {i: nearest(every, data[i] + 0.05, 4, left) for i in range(24)}


def test_boxes_of_equal_rows_and_ties(spark):
    v = np.repeat(np.array([[0.0, 1.0], [2.0, 2.0]]), 80, axis=0)
    tree = tables.BoxTree(2, leaf_size=4).build(frame(spark, v))
    assert max(len(r.ids) for r in tree.leaves.collect()) < 80
    got = ids(tree.search(frame(spark, np.array([[0.0, 1.0], [1.0, 1.5], [9.0, 9.0]]), "qid", "q"), 3).result)
    assert got == {0: [0, 1, 2], 1: [0, 1, 2], 2: [80, 81, 82]}


# -- seeds -----------------------------------------------------------------------------------


def test_oversampled_seeds_are_as_good_as_one_by_one(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((900, 4)) * 0.1 + 5 * rng.standard_normal((40, 4))[np.arange(900) % 40]
    rows = frame(spark, v)
    inertia = lambda c: ((v[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    many = kmeans.plus_plus_init(rows, 40, sample=100)  # more than a tenth: rounds over all rows
    assert many.shape == (40, 4) and len(np.unique(many, axis=0)) == 40
    assert {tuple(x) for x in many.round(9)} <= {tuple(x) for x in v.round(9)}
    plain = np.mean([inertia(kmeans.plus_plus_init(rows, 40, seed, sample=900)) for seed in range(3)])
    assert inertia(many) <= 1.5 * plain
    assert (kmeans.oversampled_init(rows.repartition(5), 40) == kmeans.oversampled_init(rows, 40)).all()
    same = frame(spark, np.ones((30, 2)))
    assert kmeans.oversampled_init(same, 7).shape == (7, 2)


# -- shortlists of all rows ------------------------------------------------------------------


def test_binary_shortlist_of_all_rows_is_no_table_of_pairs(spark, corpus, data, asked, monkeypatch):
    index = codes.BinaryIndex(8, rerank=599).build(corpus)
    shallow = ids(index.search(asked, 4).result)
    index.remove(spark.createDataFrame([(1,)], "id long"))
    monkeypatch.setattr(index, "_scan", lambda *a: pytest.fail("pairs of every query and row"))
    want = {i: nearest(data, data[i] + 0.05, 4, sorted(set(range(600)) - {1})) for i in range(24)}
    assert ids(index.search(asked, 4).result) == want and shallow[0] == nearest(data, data[0] + 0.05, 4)


def test_composite_takes_codes_only_where_lists_outgrow_the_shortlist(spark, corpus, data, asked, monkeypatch):
    centres = np.array([data[i::12].mean(0) for i in range(12)])
    rows = {p: [i for i in range(600) if ((data[i] - centres) ** 2).sum(1).argmin() == p] for p in range(12)}
    whole = codes.CompositeIndex(8, 12, 4, 16, 2, 10**6).build(corpus, centres)
    near = {i: np.argsort(((data[i] + 0.05 - centres) ** 2).sum(1))[:2] for i in range(24)}
    want = {i: nearest(data, data[i] + 0.05, 5, sorted(rows[near[i][0]] + rows[near[i][1]])) for i in range(24)}
    seen, plain = [], codes.CompositeIndex.shortlisted
    monkeypatch.setattr(codes.CompositeIndex, "shortlisted", lambda self, q, *a: seen.append(q.count()) or plain(self, q, *a))
    assert ids(whole.search(asked, 5).result) == want and not seen
    held = sorted(len(rows[near[i][0]]) + len(rows[near[i][1]]) for i in range(24))
    whole.shortlist = held[12]
    assert set(ids(whole.search(asked, 5).result)) == set(range(24)) and seen == ([sum(n > held[12] for n in held)] if held[-1] > held[12] else [])


def test_blocks_of_queries_shrink_with_what_tasks_keep(asked):
    assert len(list(exact.query_blocks(asked, 1000))) == 1
    assert max(len(b[0]) for b in exact.query_blocks(asked, 1000, kept=100)) == 3


def test_leaves_are_split_at_exact_medians_beyond_the_sketch(spark):
    rng = np.random.default_rng(8)
    p = {0: rng.standard_normal(4001), 1: rng.integers(0, 3, 3000).astype(float), 2: np.zeros(900), 3: rng.standard_normal(7)}
    rows = spark.createDataFrame([(n, float(x)) for n, v in p.items() for x in v], "node long, p double").repartition(7)
    got = {r.node: (r.n, r.threshold, r.most) for r in tables._medians(rows, 50).collect()}
    assert got == {n: (len(v), np.sort(v)[-(-len(v) // 2) - 1], v.max()) for n, v in p.items()}
    v = rng.standard_normal((3000, 8))
    forest = tables.LeafForest(8, trees=1, leaf_size=800, seed=2, accuracy=20).build(frame(spark, v))
    got = {r.id: r.leaf for r in forest.leaves().collect()}
    assert [got[i] for i in range(3000)] == grown(v, forest.directions[0], 800, "median").tolist()


# -- rounds ----------------------------------------------------------------------------------


def guessed(df):
    """Digits of the size that Spark takes a frame for."""
    return len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_guessed_sizes_do_not_grow_with_rounds(spark, corpus, data, monkeypatch):
    chain = graphs.components(spark.range(64), spark.range(63).selectExpr("id AS src", "id + 1 AS dst"))
    assert guessed(chain) < 16 and {r.component for r in chain.collect()} == {0}
    tree = tables.BoxTree(8, leaf_size=80).build(corpus)
    assert tree.levels >= 3 and guessed(tree.splits) < 16


def test_blocks_of_queries_take_what_is_kept_by_name(spark, asked):
    kept = exact.query_blocks.__defaults__
    try:
        exact.query_blocks.__defaults__ = (1000, np.float64)  # as a test sets them that knows no third
        assert sum(len(b[0]) for b in exact.query_blocks(asked)) == asked.count()
    finally:
        exact.query_blocks.__defaults__ = kept


def brute_graph(v, ids, k):
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    return {(int(ids[i]), int(ids[j]), o + 1) for i in range(len(v)) for o, j in enumerate(sorted((j for j in range(len(v)) if j != i), key=lambda j, i=i: (d[i, j], ids[j]))[:k])}


def test_blocks_meet_each_other_and_ties_go_to_smaller_ids(spark, monkeypatch):
    r = np.random.default_rng(5)
    v = np.concatenate((((3 * r.standard_normal((260, 4))).round() / 2), np.zeros((20, 4))))
    ids = r.permutation(len(v)) - 40
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<float>")
    monkeypatch.setattr(exact, "MUTUAL", 32, raising=False)
    for block_rows in (None, 50, 1000):
        got = graphs.exact_graph(rows, 6, **({} if block_rows is None else {"block_rows": block_rows}))
        assert {(x.src, x.dst, x.ord) for x in got.collect()} == brute_graph(v, ids, 6)
    a, b = exact.Nearest(v[:90], 5, v.mean(0)), exact.Nearest(v[90:], 5, v.mean(0))
    exact.meet_each_other(a, ids[:90], b, ids[90:])
    for near, own, far, names in ((a, v[:90], v[90:], ids[90:]), (b, v[90:], v[:90], ids[:90])):
        d = ((own[:, None] - far[None]) ** 2).sum(2)
        assert near.ids.tolist() == [[int(names[j]) for j in np.lexsort((names, x))[:5]] for x in d]


def test_copies_of_rows_grow_with_bounded_blocks():
    # in blocks of 4096 rows each row went to 151 tasks at 615,384 rows
    assert [graphs.blocks_of(n, 12) for n in (0, 1, 5000, 102_564, 615_384)] == [1, 1, 3, 10, 10]
    assert graphs.blocks_of(10_000_000, 12) == -(-10_000_000 // graphs.BLOCK_ROWS)


def test_descent_starts_from_cells(spark, monkeypatch):
    monkeypatch.setattr(graphs, "CELL_ROWS", 400, raising=False)
    monkeypatch.setattr(graphs, "VIAS", 700, raising=False)
    r = np.random.default_rng(23).standard_normal((2400, 24))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r)], "id long, v array<float>").localCheckpoint()
    exact_ones = graphs.exact_graph(v, 8).localCheckpoint()
    first, later = (graphs.nn_descent(v, 8, rounds, 8).localCheckpoint() for rounds in (1, 4))
    assert first.select("src", "dst").distinct().count() == first.count() == 8 * len(r) and first.filter("src = dst").isEmpty()
    one, four = (graphs.recall_against_exact(g, exact_ones).first()[0] for g in (first, later))
    assert 0.8 <= one <= four
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1500)], "id long, v array<float>")  # cells that cannot be split are dealt
    assert graphs.nn_descent(same, 3, 2, 3).groupBy("src").count().filter("count <> 3").isEmpty()


def test_neighbours_of_a_vertex_try_each_other(spark):
    x = np.array([[0.0], [1.0], [3.0], [7.0], [20.0]])
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "id long, v array<double>")
    near = spark.createDataFrame([(0, 1, False), (0, 2, True), (0, 3, False), (4, 1, False), (4, 2, False)], "src long, dst long, new boolean")
    edge = spark.createDataFrame([(1, 30.0), (2, 100.0), (3, 16.0)], "src long, edge double")
    got = {(r.src, r.dst, r.score) for r in graphs._tried(v, near, edge, among=True).collect()}
    assert got == {(1, 2, 4.0), (2, 1, 4.0), (2, 3, 16.0), (3, 2, 16.0)}


def test_pruning_takes_the_distances_of_its_edges(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((400, 6))
    rows = frame(spark, v)
    edges = materialise(graphs.exact_graph(rows, 30))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # vertices go on from batch to batch
    try:
        got = [{(x.src, x.dst, x.ord) for x in graphs.prune(rows, e, 7, 1.1).collect()} for e in (edges, edges.select("src", "dst"))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    d, want = ((v[:, None] - v[None]) ** 2).sum(2), set()
    for i in range(len(v)):
        kept = []
        for j in [j for j in np.argsort(d[i]).tolist() if j != i][:30]:
            if len(kept) < 7 and all(1.1 * 1.1 * d[k, j] > d[i, j] for k in kept):
                kept.append(j)
        want |= {(i, j, o + 1) for o, j in enumerate(kept)}
    assert got[0] == got[1] == want
    joins = lambda e: graphs.prune(rows, e, 7)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert (joins(edges), joins(edges.select("src", "dst"))) == (1, 2)  # a row's own vector is not shuffled to each of its edges


def test_boxes_split_small_nodes_in_one_task_and_meet_queries_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(tables, "SUBTREE", 200, raising=False)
    calls, grown = [], tables._grown
    monkeypatch.setattr(tables, "_grown", lambda index, made: calls.append(1) or grown(index, made))
    r = np.random.default_rng(11)
    for v, wide in ((r.standard_normal((900, 24)), 24), (np.concatenate([c + 0.1 * r.standard_normal((150, 3)) for c in 9 * r.standard_normal((6, 3))]), 3)):
        calls.clear()
        tree = tables.BoxTree(wide, leaf_size=8).build(frame(spark, v))
        assert len(calls) <= 5  # 900 rows: three levels of seven as jobs, and one that finds none, the rest at once
        q = v[:: 2] + 0.01
        found = tree.search(frame(spark, q, "qid", "q"), 5)
        assert ids(found.result) == {i: nearest(v, x, 5) for i, x in enumerate(q)}
        assert found.stats.first().distances <= len(q) * len(v) * (1 if wide == 24 else 0.4)
        assert sorted(x for r in tree.leaves.collect() for x in r.ids) == list(range(900)) and max(len(r.ids) for r in tree.leaves.collect()) <= 8


def test_walks_that_are_over_are_not_written_again(spark, corpus, asked, monkeypatch):
    rows, kept = [], tables.rewritten
    monkeypatch.setattr(tables, "rewritten", lambda df: (lambda x: rows.append(x.count()) or x)(kept(df)))
    graph = tables.EdgeGraph(8, ef=12, entry="first", at_once=4).build(corpus, graphs.symmetrise(graphs.exact_graph(corpus, 5)))
    walked = graph.walk(asked, 12)
    assert rows[0] == 24 and 0 < rows[-1] < 24 and rows == sorted(rows, reverse=True)
    seen = walked.collect()
    assert len({(r.qid, r.id) for r in seen}) == len(seen) and {r.qid for r in seen} == set(range(24))
