"""Exact deduplication over a keyed, disk-backed stream state [native].

A Structured Streaming aggregation keeps one state row per digest in RocksDB.  No watermark
is set, so no key ever expires.  The row holds the digest, the stable identifier of the
document that stays, its content locator (file and row position) and a count.  Every run
feeds its digests to the same stream, which goes on from its checkpoint.  A row whose digest
is already held is a *hit*: the text at the held locator, of this run or of an earlier one, is
fetched and compared with it byte for byte, so digests never decide alone.  Where bytes differ
under one digest, all rows of that digest, of all runs, are grouped by their whole text.

The main path has DataFrame operations only.  Before the shuffle the aggregation is partial,
the locator join is split by AQE, and the byte check is salted by the size of the group.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_path, fresh, scratch, shared_dir

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Rows of a group that one salt of the byte check takes.
ROWS_A_SALT = 64


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


LOCATOR = "struct<file: string, row: bigint>"
FEED = f"digest string, doc_id bigint, locator {LOCATOR}, run string"


class DigestState:
    """Keyed state of a digest stream below ``home``: the feed of all runs, the stream's checkpoint, its updates."""

    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark = spark
        self.home = home or scratch(spark, "digest-state")

    def fed(self, run: str | None = None) -> DataFrame:
        """digest, doc_id, locator, run of one run, or of all."""
        rows = self.spark.read.schema(FEED).parquet(f"{self.home}/feed")
        return rows if run is None else rows.filter(F.col("run") == run)

    def clashes(self) -> DataFrame:
        """Digests of which any run found unequal texts."""
        try:
            return self.spark.read.schema("digest string").parquet(f"{self.home}/clashes").distinct()
        except AnalysisException:  # none so far
            return self.spark.createDataFrame([], "digest string")

    def has(self, run: str) -> bool:
        try:
            return not self.fed(run).isEmpty()
        except AnalysisException:  # no feed yet
            return False

    def take(self, rows: DataFrame, run: str) -> None:
        """Feeds (digest, doc_id, locator) of a run; a run that was fed before isn't counted twice."""
        if not self.has(run):
            rows.select("digest", "doc_id", "locator", F.lit(run).alias("run")).write.mode("append").partitionBy("run").parquet(f"{self.home}/feed")
        self.ingest(self.spark.readStream.schema(FEED).parquet(f"{self.home}/feed"))

    def ingest(self, stream: DataFrame) -> None:
        """Takes what ``stream`` (digest, doc_id, locator) holds now; may be called again.

        Each micro-batch writes its changed keys to a folder of its own, so a batch that is
        run again after a failure replaces what it wrote before.
        """
        updates = f"{self.home}/updates"

        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(
                f"{updates}/b={number}"
            )

        state = stream.groupBy("digest").agg(
            F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size")
        )
        before = {k: self.spark.conf.get(k, None) for k in ROCKS}
        for k, v in ROCKS.items():
            self.spark.conf.set(k, v)
        try:
            (
                state.writeStream.outputMode("update")
                .foreachBatch(put)
                .option("checkpointLocation", f"{self.home}/stream")
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def snapshot(self) -> DataFrame:
        """digest, keep_id, keep_locator, group_size as of the last ingest; one row a digest."""
        schema = f"digest string, keeper struct<doc_id: bigint, locator: {LOCATOR}>, group_size bigint, batch bigint"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.home}/updates/b=*")
        except AnalysisException:  # nothing was taken yet
            rows = self.spark.createDataFrame([], schema)
        last = rows.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("s"))
        return last.select(
            "digest",
            F.col("s.keeper.doc_id").alias("keep_id"),
            F.col("s.keeper.locator").alias("keep_locator"),
            F.col("s.group_size").alias("group_size"),
        )


def _place(docs: DataFrame) -> Column:
    source = docs.metadataColumn("_metadata")
    return F.struct(source["file_path"].alias("file"), source["row_index"].alias("row"))


def in_files(docs: DataFrame, path: str, written: bool = False) -> DataFrame:
    """docs itself where each of its rows is a row of a Parquet file; else docs written at ``path``.

    A join or an explode repeats rows of files, which then share a place; such a frame is
    written too, unless ``written`` says that it stands there already.
    """
    try:
        places = docs.select(_place(docs).alias("p"))
        if places.groupBy("p").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return docs
    except AnalysisException:  # no read of Parquet files
        pass
    if not written:
        docs.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def with_locator(docs: DataFrame, name: str) -> DataFrame:
    """docs (see in_files) with a column that tells its rows apart: a row's file and its position in it."""
    return docs.select("*", _place(docs).alias(name))


def texts_at(spark: SparkSession, places: DataFrame, text_col: str) -> DataFrame:
    """locator, body of the rows at ``places`` (locator), read from their files; missing files are an error."""
    files = [unquote(r[0]) for r in places.select("locator.file").distinct().collect()]  # names of files, no rows
    if not files:
        return spark.createDataFrame([], f"locator {LOCATOR}, body string")
    there = spark.read.parquet(*files)
    rows = there.select(_place(there).alias("locator"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    return rows.join(places.select("locator").distinct(), "locator", "left_semi")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256_of,
    state: DigestState | None = None,
    run: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Texts are equal when their bytes are.  A null text counts as the empty text.  Of equal
    texts the row with the largest id stays (a null id is below all others); of rows that
    share that id too, the one with the last locator, so repeated rows are dropped as well.
    An empty table gives an empty result.  Other columns of ``docs`` are not read.

    With ``state`` the rows of earlier runs count too: keep_id may be of one of them, and then
    no row of this run stays.  What earlier runs returned is not called back.  ``run`` names a
    run, so that one that is tried again is not counted twice; the files that a state's rows
    came from must stay where they were, with their texts under ``text_col``.
    """
    lasting, state = state is not None, state or DigestState(docs.sparkSession)
    run = run or uuid.uuid4().hex
    two = in_files(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), f"{state.home}/content/{run}", lasting and state.has(run))
    return _dedup(two, "doc_id", text_col, digest, state, run, lasting)


def _dedup(docs: DataFrame, id_col: str, text_col: str, digest, state: DigestState, run: str, lasting: bool) -> DataFrame:
    """exact_dedup of a frame whose rows are in files; a state that isn't lasting is deleted."""
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"), _place(docs).alias("locator"))
    rows = rows.withColumn("digest", digest(F.col("body")))
    state.take(rows, run)
    narrow, held, far = state.fed(run).drop("run"), state.snapshot(), None
    if lasting:
        ours = narrow.select("digest").distinct()
        others = state.fed().filter(F.col("run") != run).join(ours, "digest", "left_semi").groupBy("digest", "run").agg(F.max("locator").alias("locator"))
        far = cut(others.drop("run"))
        far = far.join(texts_at(spark, far, text_col), "locator")
        held = held.join(ours, "digest", "left_semi")
    held = cut(held)

    clash = _unequal_under_one_digest(rows, narrow, held, far)
    if lasting and not clash.isEmpty():
        clash.write.mode("append").parquet(f"{state.home}/clashes")
    clash = clash.union(state.clashes()).distinct() if lasting else clash
    decided = narrow.join(held, "digest", "left")
    if not clash.isEmpty():
        every = state.fed().join(clash, "digest", "left_semi")
        every = every.join(texts_at(spark, every, text_col), "locator")
        groups = every.groupBy("digest", "body").agg(
            F.max(F.struct("doc_id", "locator")).alias("k"), F.count("*").alias("group_size")
        )
        again = (
            rows.join(clash, "digest", "left_semi")
            .join(groups, ["digest", "body"])
            .withColumn("keep_id", F.col("k.doc_id"))
            .withColumn("keep_locator", F.col("k.locator"))
        )
        columns = decided.columns
        decided = decided.join(clash, "digest", "left_anti").unionByName(again.select(columns))
    sha = F.col("digest") if digest is sha256_of else None
    if sha is None:
        decided = decided.join(rows.select("locator", sha256_of(F.col("body")).alias("sha")), "locator")
        sha = F.col("sha")
    out = decided.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("locator") == F.col("keep_locator")).alias("kept"),
        sha.alias("text_sha256"),
        "locator",
    )
    if not lasting:
        out = cut(out)
        drop_path(spark, state.home)
    return out


def _unequal_under_one_digest(rows: DataFrame, narrow: DataFrame, held: DataFrame, far: DataFrame | None) -> DataFrame:
    """Digests under which some row's bytes differ from those of the last row of this run.

    far (digest, body) holds a fetched text of each earlier run, whose own rows were compared
    when it ran; without it this run is all there is, and its last row is the held one.
    """
    groups = held.filter("group_size > 1").select("digest", F.col("keep_locator").alias("last"), "group_size")
    if far is not None:
        last = narrow.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("k")).select("digest", F.col("k.locator").alias("last"))
        groups = groups.drop("last").join(last, "digest")
    groups = groups.select("digest", "last", F.ceil(F.col("group_size") / ROWS_A_SALT).cast("int").alias("salts"))
    spark = rows.sparkSession
    path = scratch(spark, "hits")  # whole texts move once; only members of groups are written
    rows.join(groups, "digest").write.parquet(path)
    hits = spark.read.parquet(path)
    first = F.col("locator") == F.col("last")
    there = hits.filter(first).select(
        "digest", F.col("body").alias("held_body"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    new = hits.filter(~first).select("digest", "body", F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int").alias("salt"))
    if far is not None:
        new = new.unionByName(far.select("digest", "body", F.lit(0).alias("salt")))
    clash = cut(new.join(there, ["digest", "salt"]).filter("body != held_body").select("digest").distinct())
    drop_path(spark, path)
    return clash


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns; they are found by their locators."""
    docs, state = in_files(docs, scratch(docs.sparkSession, "copies")), DigestState(docs.sparkSession)
    kept = _dedup(docs, id_col, text_col, sha256_of, state, "all", False).filter("kept")
    place = fresh(docs, "place")
    own, kept = with_locator(docs, place), kept.select(F.col("locator").alias(fresh(docs, "kept_place")))
    return own.join(kept, F.col(place) == F.col(kept.columns[0]), "left_semi").drop(place)
