"""Shards, page layouts and saved indexes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, require
from ..functions.vector import hashed, top
from ..operators.exact import query_blocks, scan_keyed
from ..operators.ivf import ivf_search
from ..operators.kmeans import assign

PAGE_BYTES = 4096


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """rows with number 0, 1, ... in the order of columns that tell rows apart, without one big task.

    Rows are range partitioned and sorted; counts of the partitions give each its offset.
    """
    from .lineage import materialise

    ranged = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    counts = sorted((r["__p"], r["n"], r["first"]) for r in ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("first")).collect())
    offsets, seen = [], 0
    for p, n, first in counts:
        offsets.append((p, seen - first))
        seen += n
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "__p int, __o long")
    return ranged.join(F.broadcast(table), "__p").withColumn("number", F.col("__i") + F.col("__o")).drop("__p", "__i", "__o")


def running_total(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """rows with ``before``, the sum of ``value`` over all rows before each in the order of ``by``.

    Rows are range partitioned; sums of the partitions give each its offset.
    """
    from .lineage import materialise

    ranged = materialise(rows.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()))
    seen, offsets = 0, []
    for p, s in sorted((r["__p"], r["s"]) for r in ranged.groupBy("__p").agg(F.sum(value).alias("s")).collect()):
        offsets.append((p, seen))
        seen += s
    kind = dict(ranged.agg(F.sum(value).alias("s")).dtypes)["s"]
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], f"__p int, __o {kind}")
    w = Window.partitionBy("__p").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return own.join(F.broadcast(table), "__p").withColumn("before", F.col("before") + F.col("__o")).drop("__p", "__o")


def placed(lists: DataFrame) -> DataFrame:
    """lists with ``place`` from 1 in id order within each part; a long list is spread over tasks."""
    sizes = lists.groupBy("part").agg(F.count("*").alias("n"))
    starts = running_total(sizes, "n", "part").select("part", "before")
    return numbered(lists, "part", "id").join(F.broadcast(starts), "part").withColumn("place", F.col("number") - F.col("before") + 1).drop("number", "before")


# -- shards ------------------------------------------------------------------------------------


def random_shards(corpus: DataFrame, count: int = 8, seed: int = 0) -> DataFrame:
    """corpus with shard: an even deal by hash of seed and id."""
    require(count >= 1, "count must be at least 1")
    return corpus.withColumn("shard", F.pmod(hashed(seed, "id"), F.lit(count)).cast("int"))


def clustered_shards(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, v, shard): each row with its nearest centre, whose number is the shard's."""
    return assign(corpus, centres).select("id", "v", F.col("part").alias("shard"))


def scatter_gather(queries: DataFrame, shards: DataFrame, k: int = 10, fetch: int | None = None, metric: str = "l2") -> DataFrame:
    """Each shard's ``fetch`` (k unless stated) best, merged to k; a task sends no more than these."""
    fetch = k if fetch is None else fetch
    require(fetch >= 1 and k >= 1, "k and fetch must be at least 1")
    spark, local = shards.sparkSession, None
    rows = shards.filter(F.col("v").isNotNull()).select(F.col("shard").cast("int").alias("key"), F.col("id").cast("long").alias("id"), "v")
    for qids, q in query_blocks(queries):
        part = scan_keyed(rows, spark.sparkContext.broadcast((qids, q, None)), fetch, metric, True)
        local = part if local is None else local.unionAll(part)
    if local is None:
        local = spark.createDataFrame([], "qid long, key long, id long, score double")
    return merge(top(local, fetch, metric, ("qid", "key")).drop("rank"), k, metric)


def merge(partials: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    return top(partials.select("qid", "id", "score"), k, metric)


def routed(queries: DataFrame, shards: DataFrame, centres: np.ndarray, k: int = 10, visit: int = 2, metric: str = "l2") -> DataFrame:
    """The ``visit`` nearest shards of each query only; an empty shard just adds nothing."""
    lists = shards.select(F.col("shard").alias("part"), "id", "v")
    return ivf_search(queries, lists, centres, k, visit, metric)


# -- pages -------------------------------------------------------------------------------------


def vectors_per_page(dimension: int, page_bytes: int = PAGE_BYTES) -> int:
    require(page_bytes >= 4 * dimension, f"a vector of {dimension} numbers does not fit {page_bytes} bytes")
    return page_bytes // (4 * dimension)


def sequential_layout(corpus: DataFrame, dimension: int, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(id, page): rows in id order."""
    per = vectors_per_page(dimension, page_bytes)
    return numbered(corpus.select("id"), "id").select("id", F.floor(F.col("number") / per).cast("long").alias("page"))


def clustered_layout(lists: DataFrame, dimension: int, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(id, page): rows by list, then id."""
    per = vectors_per_page(dimension, page_bytes)
    rows = numbered(lists.select("part", "id"), "part", "id")
    return rows.select("id", F.floor(F.col("number") / per).cast("long").alias("page"))


def page_counts(touched: DataFrame, layout: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(qid, vectors, pages, bytes) of the rows (qid, id) that each query reads."""
    return touched.join(layout, "id").groupBy("qid").agg(F.count("*").alias("vectors"), F.countDistinct("page").alias("pages")).withColumn("bytes", F.col("pages") * page_bytes)


def list_page_counts(opened: DataFrame, lists: DataFrame, layout: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """page_counts of queries that read the whole lists (qid, part) that they open.

    Rows are counted by list and page first, and queries that open the same lists are counted once, so no pair
    of a query and a row is made.
    """
    pages = lists.select("part", "id").join(layout, "id").groupBy("part", "page").agg(F.count("*").alias("n"))
    asks = opened.groupBy("qid").agg(F.sort_array(F.collect_set("part")).alias("opens"))
    met = asks.select("opens").distinct().withColumn("part", F.explode("opens")).join(pages, "part")
    each = met.groupBy("opens", "page").agg(F.sum("n").alias("n")).groupBy("opens").agg(F.sum("n").alias("vectors"), F.count("*").alias("pages"))
    return asks.join(each, "opens").select("qid", "vectors", "pages", (F.col("pages") * page_bytes).alias("bytes"))


def disk_stats(counts: DataFrame) -> DataFrame:
    """One row: pages and vectors a query, and bytes read for each byte wanted."""
    return counts.agg(F.avg("pages").alias("pages_per_query"), F.avg("vectors").alias("vectors_per_query"), F.count("*").alias("queries"))


# -- saved indexes -----------------------------------------------------------------------------

VERSION = 2


@dataclass
class Header:
    version: int
    kind: str
    dimension: int
    count: int
    live: int
    metric: str
    digest: str
    detail: dict

    def as_dict(self) -> dict:
        return dict(self.__dict__)


def digest_of(rows: DataFrame) -> str:
    """Order-free digest of a whole table: hashes of all columns of its rows summed in two ways, and the count."""
    h = F.xxhash64(*sorted(rows.columns))
    r = rows.agg(F.sum(F.pmod(h, F.lit(1 << 31))).alias("a"), F.bit_xor(h).alias("b"), F.count("*").alias("n")).first()
    return f"{r.n:x}-{(r.a or 0):x}-{(r.b or 0) & (2**64 - 1):x}"


def _tables(spark: SparkSession, path: str, detail: dict) -> dict[str, DataFrame]:
    """Every table of a saved index, as load reads it."""
    names = ["rows"] + ["dead"] * detail["dead"] + [detail["table"]] * bool(detail["table"])
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def _digest(tables: dict[str, DataFrame], detail: dict) -> str:
    """Digest of all tables and of what the manifest itself holds (centres, settings)."""
    parts = {n: digest_of(t) for n, t in sorted(tables.items())}
    return hashlib.sha256(json.dumps([parts, detail], sort_keys=True).encode()).hexdigest()


def _text(spark: SparkSession, path: str, text: str | None = None) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if text is not None:
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        return text
    if not fs.exists(p):
        raise DataError(f"no index at {path}")
    return spark.read.text(path, wholetext=True).first()[0]


def save(index, path: str, detail: dict | None = None) -> Header:
    """Writes rows, tombstones, lists and centres as tables, then the manifest, which makes it valid."""
    index.require_built()
    spark = index.rows.sparkSession
    index.rows.write.mode("overwrite").parquet(f"{path}/rows")
    if index.dead is not None:
        index.dead.write.mode("overwrite").parquet(f"{path}/dead")
    own: dict = {"dead": index.dead is not None, "table": None, "notes": detail or {}}
    if index.name in ("ivf", "spill"):
        own["table"] = "lists"
        index.lists.select(F.col("part").cast("int").alias("part"), "id", "v").write.mode("overwrite").partitionBy("part").parquet(f"{path}/lists")
        own |= {"centres": index.centres.tolist(), "partitions": index.partitions, "probe": index.probe, "seed": index.seed, "inserted": index.inserted}
        if index.name == "spill":
            own |= {"copies": index.copies, "adaptive": index.adaptive}
    elif index.name == "binary":
        own["table"] = "codes"
        index.codes.write.mode("overwrite").parquet(f"{path}/codes")
        s = index.signs
        own |= {"rerank": index.rerank, "centre": None if s.centre is None else s.centre.tolist(), "rotation": None if s.rotation is None else s.rotation.tolist()}
    elif hasattr(index, "structures"):
        own["table"] = "structures"
        index.structures.write.mode("overwrite").parquet(f"{path}/structures")
        own |= {"leaf_size": getattr(index, "leaf_size", None), "how": list(getattr(index, "how", ()))}
    elif index.name != "flat":
        raise ConfigError(f"an index of kind {index.name} is rebuilt, not saved")
    own = json.loads(json.dumps(own))
    header = Header(VERSION, index.name, index.dimension, index.capacity, index.size, index.metric.name, _digest(_tables(spark, path, own), own), own)
    _text(spark, f"{path}/manifest.json", json.dumps(header.as_dict()))
    return header


def peek(spark: SparkSession, path: str) -> Header:
    """The manifest alone."""
    try:
        header = Header(**json.loads(_text(spark, f"{path}/manifest.json")))
    except (ValueError, TypeError) as e:
        raise DataError(f"{path} has no valid manifest") from e
    if header.version != VERSION:
        raise DataError(f"version {header.version}; this reads {VERSION}")
    return header


def load(spark: SparkSession, path: str):
    """The index of a path, once its tables and settings give the digest of the manifest."""
    from ..operators import codes, index, ivf, sharded

    h = peek(spark, path)
    d = h.detail
    try:
        tables = _tables(spark, path, d)
        same = _digest(tables, d) == h.digest
    except (AnalysisException, KeyError) as e:
        raise DataError(f"{path} lacks a table of its manifest") from e
    if not same:
        raise DataError(f"{path} differs from its manifest")
    rows = tables["rows"]
    if h.kind == "flat":
        out = index.FlatIndex(h.dimension, h.metric)
    elif h.kind in ("ivf", "spill"):
        out = ivf.IVFIndex(h.dimension, d["partitions"], h.metric, d["probe"], d["seed"]) if h.kind == "ivf" else ivf.SpillIndex(h.dimension, d["partitions"], d["probe"], d["copies"], d["adaptive"], d["seed"])
        out.centres, out.lists, out.inserted = np.array(d["centres"]), tables["lists"].select("part", "id", "v"), d["inserted"]
    elif h.kind == "binary":
        out = codes.BinaryIndex(h.dimension, d["rerank"])
        out.codes = tables["codes"]
        out.signs = codes.SignCodes(h.dimension, None if d["centre"] is None else np.array(d["centre"]), None if d["rotation"] is None else np.array(d["rotation"]))
    else:
        kinds = {c.name: c for c in (sharded.TreeIndex, sharded.ForestIndex, sharded.GraphIndex, sharded.HNSWIndex)}
        require(h.kind in kinds, f"kind {h.kind!r}")
        out = kinds[h.kind](h.dimension, *([d["leaf_size"]] if h.kind == "tree" else d["how"]))
        out.structures = tables["structures"]
    out.rows, out._count = rows, h.count
    out.dead = tables.get("dead")
    return out
