"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a target number of words. Its documents get rates between 0 and 2 that are exponentially tilted by document size,
rate / (2 - rate) = exp(tilt * size / mean size): the rates nearest to one, in relative entropy between those bounds, whose words
add up to the target. The tilt of each source is the root of the convex dual's gradient, found by safeguarded Newton steps; one
step is one distributed aggregation over (source, size) classes. Rates are then rounded into whole copies: classes by systematic
rounding in order of size, the words still missing by changing single copies, and inside a class the documents that a hash puts
first take the odd copies.

Texts are read once, for their sizes; everything then works on narrow rows, and only with `keep` are whole rows joined, once, at
the end. A class that holds much of the table is dealt over parts, whose lengths tell where each part's ranks begin.

Defined cases: null and blank texts have size 0 and take nothing; null sources are one source, the last; equal rows are separate
documents; an empty table gives an empty table; a source without words has target 0. Only doc_id, text and source are read, and
other columns come back under ``in_``, so they can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT, durable, join_counted, numbered, word_count

ROW_CLASSES = 20_000  # classes of one source that one row may hold
MOST = 2.0  # copies of a document, and multiple of its source's size that a target may reach


def source_key(source: Column) -> Column:
    """A text that is never null and keeps code-point order, a null source last."""
    return F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit("")))


def source_targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = MOST, max_rounds: int = 1000) -> DataFrame:
    """(source, source_size) -> with weight and target: `share` of all sizes by weight, capped, the excess reshared.

    One row per source. Sources are weighed in code-point order, null last: ranges of names are numbered apart and the lengths of
    the ranges before added. Resharing raises the level (words per weight) until no further source reaches its cap; a round is one
    aggregation.
    """
    ranged = durable(sources.withColumn("_key", source_key(F.col("source"))).repartitionByRange("_key").withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("_range")) - F.col("n"))  # one row for each range
    nth = F.row_number().over(W.partitionBy("_range").orderBy("_key")) - 1 + F.col("before")
    pattern = F.array(*[F.lit(float(x)) for x in weights])
    w = ranged.join(F.broadcast(before.select("_range", "before")), "_range").withColumn("weight", F.element_at(pattern, (F.pmod(nth, F.lit(len(weights))) + 1).cast("int")))
    w = durable(w.select("source", "source_size", "weight", (most * F.col("source_size")).alias("cap")))
    level = -1.0
    for _ in range(max_rounds):
        full = F.col("cap") <= F.col("weight") * max(level, 0.0)
        sums = w.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (share * float(sums[0] or 0) - float(sums[1] or 0)) / sums[2] if sums[2] else float("inf")
        if raised <= level:
            return w.select("source", "source_size", "weight", F.least("cap", F.col("weight") * max(level, 0.0)).alias("target"))
        level = raised
    raise RuntimeError(f"targets did not settle in {max_rounds} rounds")


def _rate(tilt: Column, z: Column) -> Column:
    return F.lit(MOST) / (1 + F.exp(-tilt * z))


def solve_tilts(classes: DataFrame, targets: DataFrame, tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """(source_key, tilt) by Newton steps on the dual; a step that leaves the bracket around the root becomes a bisection.

    What is left after `max_steps` is within the bracket's last halving: rounding and single copies settle the rest.
    """
    start = targets.select("source_key", "target", "mean_size", F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(False).alias("done"))
    state = durable(start)
    for _ in range(max_steps):
        z = F.col("size") / F.col("mean_size")
        rate = _rate(F.col("tilt"), z)
        words = F.col("n") * F.col("size")
        sums = classes.join(state, "source_key").groupBy("source_key").agg(F.sum(words * rate).alias("sum"), F.sum(words * z * rate * (1 - rate / MOST)).alias("slope"))
        gap = F.col("sum") - F.col("target")
        now = state.join(sums, "source_key", "left").withColumns({"gap": F.coalesce(gap, F.lit(0.0)), "lo": F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo")), "hi": F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))})
        now = now.withColumn("done", F.col("done") | (F.abs("gap") <= tolerance * F.greatest("target", F.lit(1.0))) | (F.abs("tilt") > 1e7))
        bound = 4 + F.abs("tilt")
        step = F.when(F.col("slope") > 0, F.greatest(-bound, F.least(bound, -F.col("gap") / F.col("slope")))).otherwise(-F.signum("gap") * bound)
        newton = F.col("tilt") + step
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        now = now.withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2))
        state = durable(now.select("source_key", "target", "mean_size", "tilt", "lo", "hi", "done"))
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("source_key", "tilt")


def tilts_in_rows(classes: DataFrame, targets: DataFrame, tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """(source_key, tilt), as solve_tilts: all steps of a source in one expression over the array of its classes, in order of size."""
    held = classes.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("c"))
    rows = targets.select("source_key", "target", "mean_size").join(held, "source_key", "left")
    mean, target = F.col("mean_size"), F.col("target")

    def add(acc: Column, x: Column, tilt: Column) -> Column:
        z, words = x["size"] / mean, x["n"] * x["size"]
        rate = _rate(tilt, z)
        return F.struct((acc["sum"] + words * rate).alias("sum"), (acc["slope"] + words * z * rate * (1 - rate / MOST)).alias("slope"))

    def move(s: Column, sums: Column) -> Column:
        gap, tilt = sums["sum"] - target, s["tilt"]
        lo, hi = F.when(gap < 0, tilt).otherwise(s["lo"]), F.when(gap > 0, tilt).otherwise(s["hi"])
        bound = 4 + F.abs(tilt)
        step = F.when(sums["slope"] > 0, F.greatest(-bound, F.least(bound, -gap / sums["slope"]))).otherwise(-F.signum(gap) * bound)
        newton = tilt + step
        done = (F.abs(gap) <= tolerance * F.greatest(target, F.lit(1.0))) | (F.abs(tilt) > 1e7)
        moved = F.when(done, tilt).when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        return F.struct(moved.alias("tilt"), lo.alias("lo"), hi.alias("hi"), done.alias("done"))

    def step(s: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("slope"))
        sums = F.aggregate(F.coalesce("c", F.array().cast("array<struct<size:bigint,n:bigint>>")), zero, lambda acc, x: add(acc, x, s["tilt"]))
        # an array of one, so that the sums are made once for all places that use them
        return F.when(s["done"], s).otherwise(F.element_at(F.transform(F.array(sums), lambda t: move(s, t)), 1))

    start = F.struct(F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(False).alias("done"))
    return rows.select("source_key", F.aggregate(F.sequence(F.lit(1), F.lit(max_steps)), start, lambda s, _: step(s), lambda s: s["tilt"]).alias("tilt"))


def repaired_in_rows(now: DataFrame, repairs: int) -> DataFrame:
    """now (source_key, size, n, target, copies) with the single copies that bring each source nearest to its target, in one expression."""
    held = now.groupBy("source_key").agg(F.first("target").alias("target"), F.array_sort(F.collect_list(F.struct("size", "n", "copies"))).alias("c"))
    far = F.lit(float("inf"))

    def move(c: Column, gap: Column) -> Column:
        def best_of(x: Column) -> Column:
            up = F.coalesce(F.when(x["copies"] < 2 * x["n"], F.abs(gap - x["size"])), far)
            down = F.coalesce(F.when(x["copies"] > 0, F.abs(gap + x["size"])), far)
            return F.struct(F.least(up, down).alias("left"), x["size"].alias("size"), F.when(up <= down, F.lit(1)).otherwise(F.lit(-1)).alias("move"))

        apply = lambda b: F.when(b["left"] < F.abs(gap), F.transform(c, lambda x: x.withField("copies", x["copies"] + F.when(x["size"] == b["size"], b["move"]).otherwise(0)))).otherwise(c)
        return F.element_at(F.transform(F.array(F.array_min(F.transform(c, best_of))), apply), 1)

    def step(c: Column) -> Column:
        words = F.aggregate(c, F.lit(0).cast("long"), lambda t, x: t + x["copies"] * x["size"])
        return F.element_at(F.transform(F.array(F.col("target") - words), lambda gap: move(c, gap)), 1)

    return held.select("source_key", F.inline(F.aggregate(F.sequence(F.lit(1), F.lit(repairs)), F.col("c"), lambda c, _: step(c))))


def class_copies(classes: DataFrame, targets: DataFrame, repairs: int = 6, row_classes: int = ROW_CLASSES) -> DataFrame:
    """(source_key, size, n, copies): whole copies that each class of n equal-sized documents takes together.

    Sources of up to row_classes classes are solved a source a row; where one has more, each step is an aggregation over all
    classes. Tilts are rounded before they decide, so that the order of sums plays no part.
    """
    most = classes.groupBy("source_key").count().agg(F.max("count")).first()[0] or 0
    in_rows = most <= row_classes
    tilts = (tilts_in_rows if in_rows else solve_tilts)(classes, targets)
    tilts = tilts.withColumn("tilt", F.format_string("%.11e", "tilt").cast("double"))
    at_cap = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)
    rate = F.when(at_cap, F.lit(MOST)).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("mean_size")))
    rated = classes.join(targets, "source_key").join(tilts, "source_key").withColumn("want", F.col("n") * rate)
    so_far = W.partitionBy("source_key").orderBy("size")
    whole = F.floor(F.sum("want").over(so_far.rowsBetween(W.unboundedPreceding, 0)) + 0.5)
    rounded = rated.withColumn("whole", whole).withColumn("copies", F.col("whole") - F.coalesce(F.lag("whole").over(so_far), F.lit(0)))
    now = durable(rounded.select("source_key", "size", "n", "target", F.greatest(F.lit(0), F.least(F.col("copies"), 2 * F.col("n"))).cast("long").alias("copies")))
    if in_rows:
        return repaired_in_rows(now, repairs)
    for _ in range(repairs):  # the one copy more or less that brings a source nearest to its target
        gap = now.groupBy("source_key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        up = F.when(F.col("copies") < 2 * F.col("n"), F.abs(F.col("gap") - F.col("size")))
        down = F.when(F.col("copies") > 0, F.abs(F.col("gap") + F.col("size")))
        move = F.when(F.coalesce(up, F.lit(float("inf"))) <= F.coalesce(down, F.lit(float("inf"))), F.lit(1)).otherwise(F.lit(-1))
        tried = now.join(gap, "source_key").withColumns({"left": F.least(up, down), "move": move})
        best = tried.filter(F.col("left") < F.abs("gap")).groupBy("source_key").agg(F.min(F.struct("left", "size", "move")).alias("best"))
        best = durable(best.select("source_key", F.col("best.size").alias("size"), F.col("best.move").alias("move")))
        if best.isEmpty():
            break
        now = durable(now.join(best, ["source_key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move"))
    return now.select("source_key", "size", "n", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, and the columns in `keep`, prefixed ``in_``) for every row."""
    source = F.col(source_col).cast("string")
    mark = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col)))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), source.alias("source"), source_key(source).alias("source_key"), word_count(F.col(text_col)).alias("size"), mark.alias("mark"), *[F.col(c).alias(f"in_{c}") for c in keep])
    rows = durable(rows) if keep else rows
    slim = numbered(rows.select(*([] if not keep else ["uid"]), "doc_id", "source", "source_key", "size", "mark"))
    total = slim.count()
    classes = durable(slim.groupBy("source_key", "source", "size").agg(F.count("*").alias("n")))
    sources = durable(classes.groupBy("source_key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs")))
    targets = source_targets(sources.select("source", "source_size"), weights, share).withColumn("source_key", source_key(F.col("source")))
    targets = durable(targets.join(sources.select("source_key", "docs"), "source_key").withColumn("mean_size", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0))))
    sized = classes.select("source_key", "size", "n")
    copies = class_copies(sized.filter("size > 0"), targets.select("source_key", "target", "source_size", "mean_size"))
    groups = durable(sized.join(copies.select("source_key", "size", "copies"), ["source_key", "size"], "left").join(targets.select("source_key", "source_size", "target"), "source_key"))
    # the place of a document in its class; large classes lie in several parts, HOT of them or a few more in all
    placed = durable(join_counted(slim, groups, ["source_key", "size"], "n", total, [F.col("mark")], part="part").withColumnRenamed("copies", "whole"))
    counts = placed.filter(F.col("n") > max(1, total // HOT)).groupBy("source_key", "size", "part").agg(F.count("*").alias("m"))
    before = counts.withColumn("before", F.sum("m").over(W.partitionBy("source_key", "size").orderBy("part")) - F.col("m")).drop("m")
    rank = F.row_number().over(W.partitionBy("source_key", "size", "part").orderBy("mark", "doc_id"))
    ranked = placed.withColumn("rank", rank).join(F.broadcast(before), ["source_key", "size", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    whole = F.coalesce("whole", F.lit(0))
    own = F.floor(whole / F.col("n")) + F.when(F.col("rank") <= F.pmod(whole, F.col("n")), 1).otherwise(0)
    out = ranked.withColumn("copies", own.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    if keep:  # by an exchange at any size, so that plans don't turn as tables grow
        out = out.hint("merge").join(rows.select("uid", *[f"in_{c}" for c in keep]), "uid")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *[f"in_{c}" for c in keep])
