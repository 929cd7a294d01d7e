"""Mixing sources to target weights by Poisson replication.

A source of size S with target weight w in a mix of total size M should be repeated w * M / S times on average. Each
document draws its number of copies from the Poisson distribution of that mean: a hash of the seed and the document
gives a uniform number, and the distribution's cumulative function is inverted at it. The copies are rows; a global
sort on a second hash shuffles them. All of it is DataFrame expressions.

A mean above ``PART`` is split into equal parts whose counts add up (a sum of Poisson numbers is a Poisson number), so
that e**-mean never vanishes and the table of cumulative probabilities stays short.

Defined cases: a null text has size 0; a null source is a source of its own; a source of size 0 is repeated as given
by its weight over its number of rows; a source without a target keeps mean 1; rows with equal ids draw independently
if their texts differ and alike otherwise; a null id is hashed as the empty string; input columns keep their names and
values, but those called replica or shuffle_key, in any case, give way to ours; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, numbered, place, shuffle_partitions

#: The largest mean that is inverted at once; and the terms of its table: beyond them less than 2**-60 is left.
PART, TERMS = 16.0, 96


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson number of this mean (at most ``PART``)."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["cdf"])


def source_key(source_col: str) -> Column:
    """The source, with a key of its own for null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))


def rates(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.7, total: float | None = None) -> DataFrame:
    """(source key, rate): the mean repetition of each source's documents.

    Sizes are characters. Without ``weights``, a source's target is its size to the power ``temperature``, as a share;
    the mix's total defaults to the size of all documents.
    """
    length = F.coalesce(F.length(F.col(place(docs, text_col)).cast("string")), F.lit(0))
    sizes = numbered(docs).groupBy(source_key(place(docs, source_col)).alias("_mix_source")).agg(F.sum(length).cast("double").alias("size"), F.count("*").cast("double").alias("rows"))
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(F.col("rows"))
    if weights is None:
        aim = sizes.withColumn("aim", F.pow(size, F.lit(temperature)))
    else:
        given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (f"s{k}", v))) if weights else F.lit(None).cast("map<string,double>")
        aim = sizes.withColumn("aim", F.element_at(given, F.col("_mix_source")).cast("double"))
    # two sums reach the driver
    aims, everything = aim.agg(F.sum("aim"), F.sum("size")).first()
    mix = float(total if total is not None else everything or 0)
    return aim.select("_mix_source", F.coalesce(F.col("aim") / F.lit(aims or 1.0) * F.lit(mix) / size, F.lit(1.0)).alias("rate"))


def replicate(docs: DataFrame, *, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.7, total: float | None = None, shuffle: bool = True) -> DataFrame:
    """``docs`` with each row repeated by its Poisson number: columns ``replica`` (from 1) and ``shuffle_key`` are added.

    With ``shuffle`` the rows are sorted by shuffle_key over all partitions.
    """
    rate = rates(docs, source_col=source_col, text_col=text_col, weights=weights, temperature=temperature, total=total)
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / PART).cast("double"))
    rate = rate.select("_mix_source", parts.cast("int").alias("parts"), poisson_table(F.col("rate") / parts).alias("cdf"))
    ident = F.concat_ws("|", F.coalesce(F.col(place(docs, id_col)).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(place(docs, text_col)).cast("string"), F.lit(""))))
    keyed = numbered(docs).withColumns({"_mix_source": source_key(place(docs, source_col)), "ident": ident})
    rows = join_small(keyed, rate, "_mix_source", how="inner")
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: uniform(F.lit(seed), F.col("ident"), part.cast("string")))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    rows = rows.select(*numbered(docs).columns, "ident", F.posexplode(F.array_repeat(F.lit(0), copies)).alias("at", "zero"))
    rows = rows.withColumn("replica", F.col("at") + 1)
    rows = rows.withColumn("shuffle_key", F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "ident", F.col("replica").cast("string"))), 1, 16))
    if shuffle:
        rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
    added = ["replica", "shuffle_key"]
    given = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c.lower() not in added]
    return rows.select(*(c for c, _ in given), *added).toDF(*(c for _, c in given), *added)
