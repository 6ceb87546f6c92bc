"""Mixing sources to target weights by weighted sampling with exponential keys.

Efraimidis and Spirakis: a document of weight w gets the key -ln(u) / w, u from
a hash of its id; ascending keys are a weighted draw without replacement.
Within a source the sizes are summed in key order up to what the budget asks
for.  A budget beyond the source's size first takes whole epochs of all its
documents and then a fraction selected by key.

The running sums never sort a whole source in one task: keys are cut into
slices of a bounded number of rows, slices are summed first, and a window runs
inside a slice only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.common import text_of, words, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
SLICE_ROWS = 2_000
#: What may be broadcast: rows of five numbers and a source name.
BROADCAST_ROWS = 100_000


def quality_weight(text: str = "text") -> Column:
    """Between 0.1 and 1: the share of characters that are no markup symbols."""
    t = text_of(text)
    plain = F.length(F.translate(t, "#*$%&|<>{}[]=_", ""))
    return F.greatest(F.lit(0.1), plain / F.greatest(F.lit(1), F.length(t)))


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 12 hex digits of md5."""
    hexed = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")
    return (hexed + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to targets that share all sizes by weight.

    Sources by code point, null last, take the weights in turn.  No target is
    above ``most`` times its source's size; what is cut off is shared again by
    weight.  Solved in closed form: in order of size per weight the capped
    sources are a prefix, and the level follows from the sums behind it.
    Sorts one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
    )
    # the first source that stays below its cap sets the level for all behind it
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.min(F.struct(F.when(free.isNull(), 1).otherwise(0).alias("n"), (F.col("cap") / F.col("weight")).alias("o"), free.alias("l"))).over(whole)["l"])
    share = F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))
    return s.select("source", "source_size", F.least(share, F.col("cap")).alias("target"))


def sized(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table written and counted: broadcast if it has at most so many rows, else left to a shuffle join."""
    table = written(table, "sized")
    return F.broadcast(table) if table.count() <= most else table


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    quality: Column | None = None,
    slice_rows: int = SLICE_ROWS,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``df``: id, source, size, source_size, target, taken.

    ``taken`` counts words, repeats included: size times the whole epochs, plus
    size again where the fractional draw takes the document.  The draw stops at
    the document that brings the sum nearest to the budget, so a source's sum
    differs from its target by at most half a document.  Null text has size 0
    and is never taken; a null id or source is a value like any other; equal
    rows keep one result each; an empty table gives an empty result.  ``carry``
    names further columns to keep.
    """
    carry = carry or []
    u = uniform(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    base = df.select(
        *carry,
        F.col(id_col).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(words(text_of(text))).cast("long").alias("size"),
        (quality if quality is not None else quality_weight(text)).alias("__w"),
        u.alias("__u"),
    ).withColumn("__key", -F.log("__u") / F.col("__w"))
    # everything but the last window needs the narrow columns only
    narrow = written(base.select("source", "size", "__w", "__key"), "sizes")
    per = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"), F.avg("__w").alias("__mean"))
    targets = source_targets(per.select("source", "source_size")).join(
        per.select(F.col("source").alias("__s"), "__n", "__mean"), F.col("source").eqNullSafe(F.col("__s"))
    ).drop("__s")
    targets = targets.select(
        F.col("source").alias("__s"),
        "source_size",
        "target",
        "__mean",
        F.floor(F.col("target") / F.greatest(F.lit(1), F.col("source_size"))).cast("long").alias("__epochs"),
        F.ceil(F.col("__n") / F.lit(slice_rows)).cast("long").alias("__slices"),
    ).withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))
    targets = sized(targets)

    def sliced(rows: DataFrame) -> DataFrame:
        rows = rows.join(targets, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        # 1 - exp(-key * mean weight) lies in (0, 1), keeps the order of the keys and is
        # near uniform, so slices hold about as many rows; sums don't depend on the cuts
        place = F.least(F.col("__slices") - 1, F.floor((1 - F.exp(-F.col("__key") * F.col("__mean"))) * F.col("__slices")))
        return rows.withColumn("__slice", place.cast("long"))

    sums = sliced(narrow).groupBy("source", "__slice").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("__s"), F.col("__slice").alias("__l"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")
    )
    rows = sliced(base).join(sized(sums), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__l"))).drop("__s", "__l")
    inside = Window.partitionBy("source", "__slice").orderBy("__key", F.col("doc_id").asc_nulls_last(), "size")
    start = F.col("__before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__start", start)
    drawn = F.when((F.col("size") > 0) & (F.col("__start") + F.col("size") / 2 <= F.col("__rest")), F.col("size")).otherwise(F.lit(0))
    return rows.select(
        *carry, "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("__epochs") + drawn).cast("long").alias("taken")
    )
