"""Command line: measure, report, sweep, build, inspect, verify, drift, stability, shortlist."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError, VectorSearchError
from .operators import codes, hashing, index, ivf, sharded
from .operators.exact import search
from .operators.index import evaluate_on, evaluate_result
from .plans import evaluate, serving, storage, verify
from .plans.lineage import materialise
from .sources import datasets, drift

CORPORA = {"gaussian": datasets.gaussian, "clustered": datasets.clustered, "subspace": datasets.on_a_subspace, "normalised": datasets.unit_vectors, "skewed": datasets.skewed}


def build_corpus(spark: SparkSession, name: str, count: int, dimension: int):
    if name not in CORPORA:
        raise ConfigError(f"unknown corpus {name!r}")
    return materialise(CORPORA[name](spark, count, dimension))


#: The knob of each index that a sweep turns at query time.
KNOBS = {"ivf": "probe", "spill": "probe", "composite": "probe", "graph": "ef", "hnsw": "ef", "forest": "trees", "binary": "rerank", "residual": "rerank"}


def build_index(
    name: str, dimension: int, partitions: int = 16, probe: int = 4, ef: int = 32, rerank: int = 100, degree: int = 16,
    trees: int = 8, leaf: int = 16, bits: int = 12, tables: int = 8, stages: int = 2, entries: int = 64,
):
    kinds = {
        "flat": lambda: index.FlatIndex(dimension),
        "ivf": lambda: ivf.IVFIndex(dimension, partitions, "l2", probe),
        "spill": lambda: ivf.SpillIndex(dimension, partitions, probe),
        "tree": lambda: sharded.TreeIndex(dimension, leaf),
        "forest": lambda: sharded.ForestIndex(dimension, trees, 4 * leaf),
        "graph": lambda: sharded.GraphIndex(dimension, degree, 2 * degree, ef),
        "hnsw": lambda: sharded.HNSWIndex(dimension, degree, ef),
        "lsh": lambda: hashing.LSHIndex(dimension, bits, tables),
        "residual": lambda: codes.ResidualIndex(dimension, stages, entries, rerank),
        "binary": lambda: codes.BinaryIndex(dimension, rerank),
        "composite": lambda: codes.CompositeIndex(dimension, partitions, 8 if dimension % 8 == 0 else 1, entries, probe, rerank),
    }
    if name not in kinds:
        raise ConfigError(f"unknown index {name!r}")
    return kinds[name]()


@dataclass
class Outcome:
    code: int
    output: str
    error: str = ""

    @property
    def ok(self) -> bool:
        return self.code == 0

    def emit(self) -> int:
        if self.output:
            print(self.output)
        if self.error:
            print(self.error, file=sys.stderr)
        return self.code


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nearfield")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("measure", "report", "sweep", "build", "inspect", "verify", "drift", "stability", "shortlist"):
        c = sub.add_parser(name)
        c.add_argument("--json", action="store_true")
        c.add_argument("--index", default="ivf")
        c.add_argument("--corpus", default="gaussian")
        c.add_argument("--count", type=int, default=2048)
        c.add_argument("--dimension", type=int, default=32)
        c.add_argument("--queries", type=int, default=64)
        c.add_argument("--k", type=int, default=10)
        c.add_argument("--partitions", type=int, default=16)
        c.add_argument("--probe", type=int, default=4)
        c.add_argument("--ef", type=int, default=32)
        c.add_argument("--rerank", type=int, default=100)
        c.add_argument("--degree", type=int, default=16)
        c.add_argument("--trees", type=int, default=8)
        c.add_argument("--leaf", type=int, default=16)
        c.add_argument("--bits", type=int, default=12)
        c.add_argument("--tables", type=int, default=8)
        c.add_argument("--stages", type=int, default=2)
        c.add_argument("--entries", type=int, default=64)
        c.add_argument("--target", type=float, default=0.9)
        c.add_argument("--path", default="")
        c.add_argument("--values", type=int, nargs="*", default=[1, 2, 4, 8])
    return p


def report(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """A row for each corpus and each structure that fits its size."""
    out = []
    for label, corpus in verify.standard_corpora(spark, a.count, a.dimension).items():
        corpus = materialise(corpus)
        rest, asked = datasets.held_out(corpus, a.queries)
        truth = materialise(search(asked, rest, a.k))
        for (name, setting), make in verify.every_structure(a.dimension).items():
            i = make().build(rest)
            found = evaluate_result(name, rest, asked, i.search(asked, a.k), a.k, truth=truth)
            out.append({"corpus": label, "setting": setting, "memory_bytes": i.memory_bytes()} | found.as_dict())
    return out


def run(spark: SparkSession, a: argparse.Namespace) -> tuple[int, object]:
    own = {k: getattr(a, k) for k in ("partitions", "probe", "ef", "rerank", "degree", "trees", "leaf", "bits", "tables", "stages", "entries")}
    make = lambda: build_index(a.index, a.dimension, **own)
    if a.command == "inspect":
        return 0, storage.peek(spark, a.path).as_dict()
    if a.command == "verify":
        rows = verify.by_rule(verify.sweep(spark, (a.index,) if a.index != "all" else None)).collect()
        return int(any(r.violations for r in rows)), {r.rule: r.violations for r in rows}
    if a.command == "report":
        return 0, report(spark, a)
    corpus = build_corpus(spark, a.corpus, a.count, a.dimension)
    if a.command == "measure":
        i = make()
        return 0, evaluate_on(i, corpus, a.k, a.queries).as_dict() | {"memory_bytes": i.memory_bytes()}
    if a.command == "build":
        return 0, storage.save(make().build(corpus), a.path).as_dict()
    rest, asked = datasets.held_out(corpus, a.queries)
    truth = materialise(search(asked, rest, a.k))
    if a.command == "sweep":
        i = make().build(rest)
        knob = KNOBS.get(a.index)
        if knob is None:
            raise ConfigError(f"{a.index} has no knob")
        rows = evaluate.sweep_setting(lambda v: i.search(asked, a.k, **{knob: v}), truth, a.values, a.k)
        return 0, {"rows": [r.asDict() for r in rows.collect()], "chosen": evaluate.cheapest_that_clears(rows, a.target).first().asDict()}
    if a.command == "drift":
        i, out = make().build(rest), {}
        for kind, m in (("none", 0.0), ("shift", 4.0), ("scale", 0.25), ("rotate", 1.0)):
            moved = asked if kind == "none" else drift.drifted(asked, kind, m)
            out[kind] = evaluate.per_query_recall(search(moved, rest, a.k), i.search(moved, a.k).result, a.k).agg(F.avg("recall")).first()[0]
        return 0, out
    if a.command == "stability":
        rows = evaluate.across_seeds(lambda s: ivf.IVFIndex(a.dimension, a.partitions, "l2", a.probe, s), rest, asked, a.k, range(3))
        return 0, evaluate.spread(rows).first().asDict()
    depths = tuple(d for d in (10, 20, 50, 100, 200, 400, 800, 1600) if d <= rest.count())
    wide = serving.sign_shortlist(asked, rest, depths[-1], rest.count(), a.dimension)
    table = materialise(serving.depth_sweep(truth, wide.rows, depths))
    return 0, {"depths": {r.depth: r.recall for r in table.orderBy("depth").collect()}, "chosen": serving.smallest_depth(table, a.target).first()[0]}


def dispatch(argv: list[str] | None = None, spark: SparkSession | None = None) -> Outcome:
    a = parser().parse_args(argv)
    try:
        code, out = run(spark or SparkSession.builder.appName("nearfield").getOrCreate(), a)
    except VectorSearchError as e:
        return Outcome(1, "", str(e))
    if a.json:
        return Outcome(code, json.dumps(out))
    rows = out if isinstance(out, list) else [out]
    return Outcome(code, "\n".join("  ".join(f"{k}={v}" for k, v in r.items()) for r in rows))


def main(argv: list[str] | None = None) -> int:
    return dispatch(argv).emit()


if __name__ == "__main__":
    sys.exit(main())
