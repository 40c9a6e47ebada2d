"""Mix sources to target weights by pivotal dependent rounding.

A source that should yield ``r`` times its own words gives every document ``floor(r)`` whole copies and a
fractional copy ``r - floor(r)``.  The pivotal method settles the fractional copies in pairs: of two
documents one gives words to the other until either has no fraction or is a whole copy, in a direction
drawn so that each keeps its expected copies; the one that stays fractional goes on.  No step changes the sum
of words, so a source misses its target by less than the one document that is left at its end.  One fold
settles a group of some hundred documents of like size, largest first, and leaves one residual; the
residuals of a source meet in a reduction tree of the same folds.

DataFrame functions only.  Randomness is a hash of the two ids and a seed: reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Documents that one fold settles, about.
FAN_IN = 256
#: Size classes in a doubling of size: sizes of one class differ by 4.5 % at most.
CLASSES = 16
_EPS = 1e-9


def water_fill(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Targets of sources that share all of ``size`` by weight, none above ``cap`` times its own size.

    ``sizes``: one row a source (source, size).  Sources in code point order, null last, take the weights in
    turn.  Resharing the excess by weight until none is above its cap ends at the level where the
    targets ``min(cap * size, level * weight)`` sum to everything: sources sorted by
    ``cap * size / weight`` fill up one after another, and running sums give the level.
    Works on one row a source, never on documents.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("__cap", F.col("size") * F.lit(float(cap))).withColumn("__full", F.col("__cap") / F.col("__w"))
    filling = Window.orderBy("__full", F.col("source").asc_nulls_last())
    ahead = filling.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("__cap").over(ahead), F.lit(0.0))
    weight_left = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(ahead), F.lit(0.0))
    level = (F.sum("size").over(everything) - filled) / weight_left
    # The level each source would see if all before it were full; the first that isn't full sets it for the rest.
    seen = ranked.withColumn("__level", level).withColumn("__rank", F.row_number().over(filling))
    first = F.min(F.when(F.col("__full") >= F.col("__level"), F.struct("__rank", "__level"))).over(everything)
    settled = seen.withColumn("__final", first["__level"])
    return settled.select("source", "size", F.least("__cap", F.coalesce(F.col("__final") * F.col("__w"), F.col("__cap"))).alias("target"))


def _uniform(*parts: Column | str) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _fold(items: str, seed: int) -> str:
    """SQL that folds an ordered array of struct(size, id, p) pairwise.

    Gives struct(id, size, p of the one left, won: ids that were filled up).  A step moves words from one of
    two to the other until either is empty or full, either way with the chance that keeps both expectations.
    """
    u = f"(shiftrightunsigned(xxhash64({seed}, acc.id, x.id), 11) / {float(1 << 53)!r}D)"
    low, high, none = f"{_EPS!r}D", f"{1 - _EPS!r}D", "cast(array() as array<bigint>)"
    most = "named_struct('up', least((1D - acc.p) * acc.size, x.p * x.size), 'down', least(acc.p * acc.size, (1D - x.p) * x.size))"
    moved = f"transform(array({most}), m -> if({u} * (m.up + m.down) < m.down, m.up, -m.down))[0]"
    after = f"transform(array({moved}), d -> named_struct('a', acc.p + d / acc.size, 'b', x.p - d / x.size))[0]"
    gained = f"concat(acc.won, if(y.a >= {high}, array(acc.id), {none}), if(y.b >= {high}, array(x.id), {none}))"
    a_left = f"named_struct('id', acc.id, 'size', acc.size, 'p', y.a, 'won', {gained})"
    b_left = f"named_struct('id', x.id, 'size', x.size, 'p', if(y.b > {low} and y.b < {high}, y.b, 0D), 'won', {gained})"
    step = f"transform(array({after}), y -> if(y.a > {low} and y.a < {high}, {a_left}, {b_left}))[0]"
    fresh = "named_struct('id', x.id, 'size', x.size, 'p', x.p, 'won', acc.won)"
    zero = f"named_struct('id', cast(null as bigint), 'size', 1L, 'p', 0D, 'won', {none})"
    return f"aggregate({items}, {zero}, (acc, x) -> if(acc.p <= {low}, {fresh}, {step}))"


def pivotal_winners(items: DataFrame, seed: int) -> DataFrame:
    """One column ``id``: the documents whose fraction was rounded up.

    ``items``: id long (unique), source, size long, p double in (0, 1); fractions of one source round
    together.  A third of all rows in one source is dealt out by size class and hash; no task gets more
    than a group of about ``FAN_IN``.
    """
    kept = checkpoint(
        items.withColumn("size", F.greatest("size", F.lit(1)).cast("long"))  # one without words weighs as little as can be
        .withColumn("__class", F.floor(F.log2("size") * CLASSES).cast("int"))
    )
    counts = kept.groupBy(F.col("source").alias("__s"), F.col("__class").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    most = counts.agg(F.max("__n")).head()[0] or 1
    level = (
        kept.join(counts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c")))
        .select("id", "source", "size", "p", "__class", F.ceil(F.col("__n") / FAN_IN).alias("__k"))
        .withColumn("__salt", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("__k")))
    )
    won, rounds = None, max(1, math.ceil(math.log(most, FAN_IN) - 1e-9))
    for turn in range(rounds + 1):
        last = turn == rounds  # all of a source: one residual a size class
        keys = ["source"] if last else ["source", "__class", "__salt"]
        grouped = level.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct("size", "id", "p")), asc=False).alias("__items"), *([] if last else [F.max("__k").alias("__k")])
        )
        settled = checkpoint(grouped.withColumn("__out", F.expr(_fold("__items", seed + turn))).drop("__items"))
        winners = settled.select(F.explode("__out.won").alias("id"))
        won = winners if won is None else won.unionByName(winners)
        rest = settled.where(F.col("__out.p") > _EPS)
        if last:
            coin = rest.where(_uniform(F.lit(seed + turn), F.col("__out.id")) < F.col("__out.p"))
            return won.unionByName(coin.select(F.col("__out.id").alias("id")))
        fewer = F.ceil(F.col("__k") / FAN_IN)
        level = rest.select(
            F.col("__out.id").alias("id"), "source", F.col("__out.size").alias("size"), F.col("__out.p").alias("p"), "__class", F.pmod("__salt", fewer).alias("__salt"), fewer.alias("__k")
        )
    raise AssertionError


def _nth(key: str, size: Column) -> Column:
    """Tells the rows of one key apart by numbers; rows that tie have the same source and size, so it doesn't matter which is which.

    The rows of a key are numbered from 1.  Rows without key, which may be any share of all, are numbered by source and
    size in a thousand parts, each from a number of its own.
    """
    source = F.col("source")
    part = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(source, size), F.lit(1000)) + 1).otherwise(F.lit(0))
    return F.row_number().over(Window.partitionBy(key, part).orderBy(source.asc_nulls_last(), size)) + F.shiftleft(part, 40)


def mix(rows: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """Copies of each row for the mix.  ``rows``: id long, source, size long.

    Returns id, nth (tells rows of one id apart, see ``_nth``), source, size, source_size long, target double,
    copies int.  A row of size 0 gets as many copies as its source's ratio says; a source without words has none.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    targets = water_fill(sizes, weights, cap).select(F.col("source").alias("__s"), F.col("size").alias("source_size"), "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.when(F.abs(ratio - F.round(ratio)) < _EPS, F.round(ratio)).otherwise(ratio)
    numbered = rows.withColumn("nth", _nth("id", F.col("size")))
    # Further rows of an id are told apart by a hash.
    numbered = numbered.withColumn("__uid", F.when((F.col("nth") == 1) & F.col("id").isNotNull(), F.col("id")).otherwise(F.xxhash64("id", "nth", F.lit(seed))))
    with_ratio = numbered.join(targets, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("__r", near)
    with_ratio = checkpoint(with_ratio.withColumn("__whole", F.floor("__r").cast("int")).withColumn("__p", F.col("__r") - F.floor("__r")))
    fractional = with_ratio.where(F.col("__p") > _EPS).select(F.col("__uid").alias("id"), "source", "size", F.col("__p").alias("p"))
    won = pivotal_winners(fractional, seed).select(F.col("id").alias("__w")).distinct()
    return (
        with_ratio.join(won, F.col("__uid") == F.col("__w"), "left")
        .withColumn("copies", F.col("__whole") + F.col("__w").isNotNull().cast("int"))
        .select("id", "nth", "source", "size", "source_size", "target", "copies")
    )


def word_count(text: Column | str) -> Column:
    """Words of a text; none if it is null or empty."""
    # Counting the starts of words needs no array of words.
    spaced = F.concat(F.lit(" "), F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    squeezed = F.regexp_replace(spaced, " +[^ ]+", "w")
    return F.length(F.translate(squeezed, " ", "")).cast("long")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each; a null text has none.

    A row of ``documents`` gives a row, also without doc_id or with one that repeats; null is a source, the last.  Of rows of
    equal doc_id, source and size it is undefined which gets which of their results.  An empty table gives no rows; other columns aren't read.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", word_count("text").alias("size"))
    return mix(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"
    )


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it (0 to 3 times), with all its columns.

    Nulls and repeated ids as in ``op9_mixing``; rows of equal id, source and size are interchangeable, whatever else they hold.
    """
    sized = docs.select(F.col("doc_id").alias("id"), "source", word_count("text").alias("size"))
    copies = mix(sized).where("copies > 0").select(F.col("id").alias("__id"), F.col("nth").alias("__nth"), F.col("copies").alias("__copies"))
    on = F.col("doc_id") == F.col("__id")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1):
        docs_, on = docs.withColumn("__n", _nth("doc_id", word_count("text"))), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__nth"))
    else:
        docs_ = docs
    return docs_.join(copies, on).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)
