"""Mixing sources to target weights by Poisson replication.

A source with ``n`` documents and target share ``w`` of ``budget * N`` rows has the mean
repetition rate ``w * budget * N / n``.  Each document gets a uniform number hashed from the
seed and its id, and takes the Poisson quantile of it at its source's rate as its count of
copies, so a document's count depends on nothing but its id, the seed and the rate.  Copies
are exploded and dealt out over all partitions by a hash of seed, id and copy, and ordered by
it within each: a global shuffle that any rerun repeats.

Quantiles are looked up in a table of cumulative probabilities made once a source.  A rate
beyond ``PIECE`` is a sum of Poisson pieces with hashes of their own, so no table is long and
no probability underflows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Mean of one Poisson piece at most.
PIECE = 16.0
#: Entries of a piece's table: P(X > 80) at mean 16 is below 2^-52, the numbers' grain.
ENTRIES = 80
#: Sources whose rates are broadcast; with more the rates are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) with 52 bits from the key, the same in any engine that has md5."""
    text = F.concat_ws(":", *[k if isinstance(k, Column) else F.lit(k) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def _quantile(sums: str, u: Column) -> Column:
    """Entries of the column ``sums`` up to u; u is bound once, not worked out for each entry."""
    return F.get(F.transform(F.array(u), lambda x: F.size(F.filter(sums, lambda c: c <= x))), F.lit(0))


def rates(docs: DataFrame, weights: Mapping[str, float] | None, power: float, budget: float, source_col: str) -> DataFrame:
    """source, n, rate.  Named weights are shares in proportion; without any, n ** power are."""
    n = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "source string, w double")
        n = n.join(named.groupBy("source").agg(F.sum("w").alias("w")), "source", "left").fillna(0.0, ["w"])
    n = cut(n)
    whole = n.agg(F.sum("n").alias("n"), F.sum(F.round("w", 6)).alias("w")).first()
    if not whole["w"]:
        return n.select("source", "n", F.lit(0.0).alias("rate"))
    rate = F.round(F.col("w"), 6) * F.lit(budget * whole["n"]) / F.lit(whole["w"]) / F.col("n")
    return n.select("source", "n", F.round(rate, 9).alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    power: float = 0.5,
    budget: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """docs with rate, n_copies, copy (from 1) and shuffle_key; a row for each copy.

    weights: target share of each source, in proportion; a source that is not named gets none.
    Without weights the shares go by size to the power ``power``.  A null source is the source
    "".  Null ids hash as "null"; rows that share an id share the count of copies (at the
    same source).  A rate of 0 leaves no copies; an empty table gives no rows.  Columns of
    docs that bear one of the four new names are replaced.
    """
    table = rates(docs, weights, power, budget, source_col)
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    lam = F.col("rate") / F.col("pieces")
    # p(0), p(1), ... by p(j) = p(j - 1) * lam / j, and their running sums
    sums = F.aggregate(
        F.sequence(F.lit(1), F.lit(ENTRIES)),
        F.struct(F.exp(-lam).alias("p"), F.array(F.exp(-lam)).alias("c")),
        lambda acc, j: F.struct(
            (acc["p"] * lam / j).alias("p"),
            F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * lam / j)).alias("c"),
        ),
        lambda acc: acc["c"],
    )
    key, of, piece, up = (fresh(docs, x) for x in ("of_source", "of_rate", "of_pieces", "of_sums"))
    table = table.withColumn("pieces", pieces).withColumn("sums", sums)
    table = cut(table.select(F.col("source").alias(key), F.col("rate").alias(of), F.col("pieces").alias(piece), F.col("sums").alias(up)))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(piece)),
        F.lit(0),
        lambda acc, i: acc + _quantile(up, uniform(str(seed), name, i.cast("string"))),
    )
    own = [c for c in docs.columns if c.lower() not in ("rate", "n_copies", "copy", "shuffle_key")]
    counted = docs.join(table, F.coalesce(F.col(source_col).cast("string"), F.lit("")) == F.col(key))
    counted = counted.select(*own, F.col(of).alias("rate"), drawn.cast("long").alias("n_copies")).filter("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    deal = F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", deal).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
