"""Mixing sources to target weights by entropy balancing.

Document rates minimise the relative entropy to one copy each, subject to one token constraint per source and
to at most ``most`` copies. The dual is convex with one multiplier per source; its optimum tilts the rates
exponentially: rate = min(most, exp(lambda_source * size / mean size of the source)). Newton steps on the
multipliers, kept inside a shrinking bracket, are distributed sums over the histogram of (source, size).

Rates become copies by systematic rounding: along a source's documents ordered by size, the running sum of
fractional parts crosses as many whole numbers as extra copies are due, so a source misses its target by
less than about one document. All sums are of integers, so reruns agree to the last word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterbox.llm._common import boxed, cut, drop_cut, partitions, running_sums, unboxed

#: fractions of copies are counted in units of 2**-30, words in Newton's sums in units of 2**-8
_UNIT, _WORD = 1 << 30, 256
_BLANK = r"[\x20\x09-\x0D]+"
_STEPS = 60


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0)."""
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _BLANK), ""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def source_targets(base: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, docs, target: shares by cyclic weights in code-point order, null last.

    A target stops at ``most`` times its source's size and the excess is shared out again by weight until no
    target is above. The end of that resharing is one level for all sources below their tops, found by sums.
    """
    found = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # places of all sources in order (sources are far fewer than documents)
    found = found.withColumns({"last": F.col("source").isNull().cast("int"), "one": F.lit(1).cast("long")})
    found = running_sums(found, ["last", "source"], {"place": "one"}, "sources")
    cycle = F.array(*[F.lit(w) for w in weights])
    found = found.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int")).cast("long")).withColumn("top", most * F.col("source_size"))
    total, weighed = cut_totals(found)
    # sources reach their tops in order of top / weight: the level that the others get follows from sums over those before
    found = running_sums(found.withColumn("at", F.col("top") / F.col("weight")), ["at", "place"], {"tops": "top", "heavy": "weight"}, "levels")
    level = (F.lit(total) - F.col("tops")) / (F.lit(weighed) - F.col("heavy"))
    level = found.filter(F.col("at") >= level).agg(F.max(level)).first()[0]  # the first that stays below its top sets it
    target = F.col("top").cast("double") if level is None else F.least(F.col("weight") * F.lit(float(level)), F.col("top").cast("double"))
    return cut(found.select("source", "source_size", "docs", target.alias("target")), "targets")


def cut_totals(found: DataFrame) -> tuple[int, int]:
    row = found.agg(F.sum("source_size"), F.sum("weight")).first()
    return row[0] or 0, row[1] or 0


def multipliers(base: DataFrame, targets: DataFrame, most: int = 3, near: float = 1e-7) -> DataFrame:
    """source, lam, saturated: the dual optimum for each source (saturated: every document ``most`` times)."""
    cells = cut(base.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    state = targets.filter("source_size > 0").select(
        "source", "target", (F.col("source_size") / F.col("docs")).alias("scale"), (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("saturated"),
        F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done"),
    )
    state = cut(state, "dual")
    for _ in range(_STEPS):
        open_ = state.filter(~F.col("done") & ~F.col("saturated"))
        if open_.isEmpty():
            break
        x = F.col("size") / F.col("scale")
        tilt = F.col("lam") * x
        rate = F.when(tilt >= F.log(F.lit(float(most))), F.lit(float(most))).otherwise(F.exp(tilt))
        slope = F.when(tilt >= F.log(F.lit(float(most))), F.lit(0.0)).otherwise(rate * x)
        mass = F.col("n") * F.col("size") * _WORD
        here = open_.select(F.col("source").alias("_s"), "scale", "lam")
        sums = cells.join(here, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(F.sum(F.round(mass * rate).cast("long")).alias("f"), F.sum(F.round(mass * slope).cast("long")).alias("g"))
        new = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        f, g = F.col("f") / _WORD, F.col("g") / _WORD
        fit = F.abs(f - F.col("target")) <= near * F.col("target")
        lo, hi = F.when(f < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(f >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        # Newton on log f, which is close to linear in lambda
        newton = F.col("lam") + F.log(F.col("target") / F.greatest(f, F.lit(1 / _WORD))) * f / F.nullif(g, F.lit(0.0))
        middle = F.when((lo > -1e6) & (hi < 1e6), (lo + hi) / 2).when(lo > -1e6, lo * F.when(lo > 0, 2.0).otherwise(0.5) + 1).otherwise(hi * F.when(hi < 0, 2.0).otherwise(0.5) - 1)
        step = F.when((newton > lo) & (newton < hi), newton).otherwise(middle)
        tight = (hi - lo) <= 1e-12 * F.greatest(F.abs(lo), F.lit(1.0))
        moved = F.col("f").isNotNull()
        done = F.col("done") | (moved & (fit | tight))
        new = new.select("source", "target", "scale", "saturated", F.when(moved & ~fit & ~tight, step).otherwise(F.col("lam")).alias("lam"), F.when(moved, lo).otherwise(F.col("lo")).alias("lo"), F.when(moved, hi).otherwise(F.col("hi")).alias("hi"), done.alias("done"))
        before, state = state, cut(new, "dual")
        drop_cut(before)
    else:
        if not state.filter(~F.col("done") & ~F.col("saturated")).isEmpty():
            raise RuntimeError(f"multipliers have not settled after {_STEPS} steps")
    return state.select("source", "scale", "lam", "saturated")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies * size) of every row.

    Null texts have size 0 and are taken as they are (one copy, no words). Null sources are one source, the
    last. Repeated rows are documents of their own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = cut(sizes(docs), "sizes")
    targets = source_targets(base, weights, most)
    duals = multipliers(base, targets, most)
    table = targets.join(duals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_source")
    rows = base.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.coalesce(F.col("saturated"), F.lit(False)), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.lit(20.0), F.col("lam") * F.col("size") / F.col("scale")))))
    units = F.round(F.coalesce(rate, F.lit(1.0)) * _UNIT).cast("long")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", F.floor(units / _UNIT).cast("int").alias("whole"), (units % _UNIT).alias("part"), F.xxhash64(F.col("doc_id")).alias("h"))
    order = ["size", "h", "doc_id"]
    rows = rows.repartitionByRange(partitions(spark), "source", *order)
    rows = cut(rows.withColumn("p", F.spark_partition_id()), "rates")
    # running sums in two levels: whole range partitions of a source, then the rows of each
    sums = rows.groupBy("source", "p").agg(F.sum("part").alias("s"))
    before = Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("p").alias("_p"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("source", "p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"run": F.sum("part").over(local), "k": F.row_number().over(Window.partitionBy("source", "p").orderBy(*order))})
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("p") == F.col("_p")))
    half = F.lit(_UNIT // 2)
    upto = F.col("base") + F.col("run") + half
    extra = F.floor(upto / _UNIT) - F.floor((upto - F.col("part")) / _UNIT)
    copies = F.least(F.lit(most), F.col("whole") + extra.cast("int"))
    rows = cut(rows.select("doc_id", "source", "size", "source_size", "target", "h", "p", "k", copies.alias("copies")), "copies")
    flips = _repair(rows, most)
    met = rows["source"].eqNullSafe(flips["_source"]) & (rows["p"] == flips["_p"]) & (rows["k"] == flips["_k"])
    copies = F.col("copies") + F.coalesce("_step", F.lit(0))
    rows = rows.join(flips, met, "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _repair(rows: DataFrame, most: int) -> DataFrame:
    """For each source the one document whose copies, one more or less, bring it closest to its target."""
    off = rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("t"))
    off = off.select(F.col("source").alias("_source"), (F.col("n") - F.col("t")).alias("off"))
    steps = F.array(F.when(F.col("copies") > 0, F.lit(-1)), F.when(F.col("copies") < most, F.lit(1)))
    tried = rows.filter("size > 0").join(off, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_step", F.explode(F.array_compact(steps)))
    tried = tried.withColumn("miss", F.abs(F.col("off") + F.col("_step") * F.col("size")))
    best = tried.groupBy("_source").agg(F.min(F.struct("miss", "size", "h", "doc_id", "p", "k", "_step")).alias("b"), F.first("off").alias("off"))
    return best.filter("b.miss < abs(off)").select("_source", F.col("b.p").alias("_p"), F.col("b.k").alias("_k"), F.col("b._step").alias("_step"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``docs`` with each row as often as its copies; rows with none go. Columns stay as they are, whatever their names.

    Rows that repeat doc_id, source and size share the sum of their copies evenly: they are numbered once, for
    good, and dealt to in that order.
    """
    taken = mix(docs, weights, most).filter("copies > 0")
    keys = ["doc", "none", "src", "size"]

    def keyed(doc: str, size) -> list:
        return [F.col(doc).cast("long").alias("doc"), F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), size.alias("size")]

    each = cut(taken.select(*keyed("doc_id", F.col("size")), "copies").groupBy(*keys).agg(F.sum("copies").alias("copies")), "copies")
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _BLANK), "")).cast("long")
    rows = docs.select(boxed(docs), *keyed("doc_id", words))

    def met(left: DataFrame, right: DataFrame):
        return left["doc"].eqNullSafe(right["doc"]) & (left["none"] == right["none"]) & (left["src"] == right["src"]) & (left["size"] == right["size"])

    if rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        out = rows.join(each, met(rows, each)).select("row", "copies")
    else:
        rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
        again = rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")
        tied = rows.join(again, met(rows, again), "left_semi").select("uid", *keys)
        places = running_sums(tied.withColumn("one", F.lit(1).cast("long")), [*keys, "uid"], {"at": "one"}, "ties")
        firsts = places.groupBy(*keys).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
        places = places.join(firsts, met(places, firsts)).select(F.col("uid").alias("tie"), (F.col("at") - F.col("first")).alias("rank"), "rows")
        out = rows.join(each, met(rows, each)).select("row", "uid", "copies").join(places, F.col("uid") == F.col("tie"), "left")
        share = F.floor(F.col("copies") / F.col("rows")) + (F.col("rank") < F.col("copies") % F.col("rows")).cast("int")
        out = out.withColumn("copies", F.coalesce(share.cast("long"), F.col("copies"))).filter("copies > 0")
    return out.withColumn("each", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*unboxed(docs.columns))
