"""What each of five filters removes, alone, first, last and in every order.

Five failure flags a document; one CUBE over part and flags gives every grouping set, and
the row of a set whose selected flags are all false counts the survivors of that subset
of filters. A step of an order takes one subset to the next, so each of its counts is a
difference of two survivors' rows, which a join pairs.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and flags a to d of each row; one expression a flag, all in the JVM."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    words = F.filter(F.split("t", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("w", words)
    upper = F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))
    return rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
        (F.size("w") < 200).alias("a"),
        (100 * F.size(F.array_distinct("w")) < 50 * F.size("w")).alias("b"),
        (F.lit(100).cast("long") * upper > 2 * F.length("t").cast("long")).alias("c"),
        F.col("t").rlike("[#$%&*|]").alias("d"),
    )


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that agree in id, part and flags, with their number, flags a to e, good and toxic.

    The smallest id of a text meets its rows by digest and id, so a text in very many rows
    is no large key; labels are one row an id before they meet.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failures(docs).groupBy("doc_id", "part", "digest", "a", "b", "c", "d").agg(F.count("*").alias("n"))
    rows = materialize(rows.join(marks, "doc_id", "left"), "flags")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("part", "a", "b", "c", "d", later.alias("e"), "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def survivors(rows: DataFrame) -> DataFrame:
    """part (null: all parts), subset (bit i for filter i) and how many rows, good and toxic ones pass all of it.

    Subsets that nothing passes have no row.
    """
    flags = [x.lower() for x in FILTERS]
    sums = rows.groupBy("part", *flags, "good", "toxic").agg(F.sum("n").alias("n"))
    sums = sums.select("part", *flags, "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    sets = sums.cube("part", *flags).agg(*(F.sum(x).alias(x) for x in COUNTS), F.grouping("part").alias("all_parts"), *(F.grouping(x).alias(f"any_{x}") for x in flags))
    passes, subset = F.lit(True), F.lit(0)
    for i, x in enumerate(flags):
        selected = F.col(f"any_{x}") == 0
        passes &= ~selected | ~F.col(x)
        subset += F.when(selected, 1 << i).otherwise(0)
    return sets.where(passes).select(F.when(F.col("all_parts") == 0, F.col("part")).alias("part"), subset.alias("subset"), *COUNTS)


def steps(orders: list[str]) -> list[tuple]:
    """filter_order, step, its filter's bit, subset before and after it."""
    out = []
    for order in orders:
        before = 0
        for i, x in enumerate(order):
            bit = 1 << FILTERS.index(x)
            out.append((order, i + 1, bit, before, before | bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, overall: bool = False) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``part`` is each source value (null: empty string); ``overall`` adds rows with a null
    part for the whole table. kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley are counts of rows of ``docs``.

    Defined results: null text is the empty text; a row with a null doc_id is never a
    copy of a smaller id and has no label, and its text is no other row's original; rows
    that repeat a doc_id are counted each, and copies among them aren't smaller ids; of
    several labels of an id any quality=1 makes it good and any toxic=1 toxic; other
    columns aren't read; empty documents give no rows, empty labels no good or toxic ones.
    """
    spark = docs.sparkSession
    found = materialize(survivors(flagged(docs, labels)), "survivors")
    found = found if overall else found.where("part is not null")
    every = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("subset")
    parts = found.where("subset = 0").select("part", every)
    right = found.select(F.col("part").alias("p"), F.col("subset").alias("s"), *COUNTS)
    full = parts.join(right, parts["part"].eqNullSafe(right["p"]) & (parts["subset"] == right["s"]), "left")
    full = full.select("part", "subset", *(F.coalesce(x, F.lit(0)).alias(x) for x in COUNTS))
    # 600 rows, whatever the data: one per order and step
    plan = spark.createDataFrame(steps(["".join(x) for x in permutations(FILTERS)]), "filter_order string, step int, bit int, before int, after int")
    before = full.join(F.broadcast(plan), F.col("subset") == F.col("before")).drop("subset")
    after = full.select(F.col("part").alias("p"), F.col("subset").alias("after"), *(F.col(x).alias(f"{x}_after") for x in COUNTS))
    step = before.join(after, before["part"].eqNullSafe(after["p"]) & (before["after"] == after["after"])).drop("p").drop(after["after"])
    # what fails a filter at all, and what fails it alone
    of = full.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", "n"))).alias("by")).withColumnRenamed("part", "p")
    step = step.join(of, step["part"].eqNullSafe(of["p"])).drop("p")
    removed = F.col("n") - F.col("n_after")
    step = step.select(
        "part",
        "filter_order",
        "step",
        "bit",
        F.col("n_after").alias("kept"),
        removed.alias("removed"),
        (F.element_at("by", F.lit(0)) - F.element_at("by", F.col("bit")) - removed).alias("redundant"),
        (F.element_at("by", 31 - F.col("bit")) - F.element_at("by", F.lit(31))).alias("unique_fails"),
        (F.col("good") - F.col("good_after")).alias("good_lost"),
        (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"),
    )
    total = step.groupBy(F.col("part").alias("p"), F.col("bit").alias("b")).agg(F.sum("removed").alias("shapley"))
    return step.join(total, step["part"].eqNullSafe(total["p"]) & (step["bit"] == total["b"])).drop("p", "b", "bit")
