"""Walks over large edge tables (caller, callee): sets of sources, depths, least paths, cycles, totals below.

Every walk is a loop of rounds. A round joins what the last one changed to the
edges and writes one table, which holds all that is known so far with a mark on
what is new; no round reads those before the last, which are removed. Rows of
(function, root) are never walked: roots travel as blocks of 64 bits, merged by OR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tables import durable, free, fresh_folder, remove, write


def _steps(edges: DataFrame) -> DataFrame:
    return durable(edges.select("caller", "callee").filter("caller <> callee").distinct())


def _over(what: str, rounds: int) -> RuntimeError:
    return RuntimeError(f"{what} did not end in {rounds} rounds")


def numbered_roots(roots: DataFrame) -> DataFrame:
    """(root, block, bit) for each different root, as a written table: 64 roots to a block, in order, without gaps in a block.

    Roots that stand near each other are often met together, and then share blocks.
    """
    ids = roots.select("root").dropna().distinct().repartitionByRange("root").sortWithinPartitions("root").withColumn("_id", F.monotonically_increasing_id())
    return durable(ids.select("root", F.shiftright("_id", 6).alias("block"), F.col("_id").bitwiseAND(F.lit(63)).cast("int").alias("bit")))


def spread(edges: DataFrame, named: DataFrame, through: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """(function, block, bits): which of `named` (root, block, bit) reach each function, each root itself.

    With `through` (function), paths go on only from the functions it lists, and from roots. Cycles need no care.
    """
    step = _steps(edges)
    inner = step if through is None else durable(step.join(through.select(F.col("function").alias("caller")).distinct(), "caller", "left_semi"))
    own = F.expr("bit_or(shiftleft(1L, bit))")
    state = durable(named.groupBy(F.col("root").alias("function"), "block").agg(own.alias("bits")).withColumn("new", F.col("bits")))
    for depth in range(max_rounds):
        moved = state.filter("new <> 0").select(F.col("function").alias("caller"), "block", "new").join(inner if depth else step, "caller")
        come = moved.groupBy(F.col("callee").alias("function"), "block").agg(F.expr("bit_or(new)").alias("come"))
        had, got = F.coalesce("bits", F.lit(0).cast("long")), F.coalesce("come", F.lit(0).cast("long"))
        last, state = state, durable(state.drop("new").join(come, ["function", "block"], "full").select("function", "block", had.bitwiseOR(got).alias("bits"), got.bitwiseAND(F.bitwise_not(had)).alias("new")))
        free(last)
        if state.filter("new <> 0").isEmpty():
            return state.drop("new")
    raise _over("the closure", max_rounds)


def _heights(step: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(function, height) of the functions of step that lead to no cycle, callees first, and (function) of the others.

    A function stands one above the highest of its callees. A round writes only functions that still wait for a callee.
    """
    spark, folder = step.sparkSession, fresh_folder(step.sparkSession)
    waiting = durable(step.groupBy(F.col("caller").alias("function")).agg(F.count("*").alias("open")))
    front = durable(step.select(F.col("callee").alias("function")).distinct().join(waiting, "function", "left_anti"))
    schema, last = StructType([*front.schema]).add("height", "integer"), waiting
    for height in range(max_rounds):
        write(front, f"{folder}/height={height}")
        come = front.withColumnRenamed("function", "callee").join(step, "callee").groupBy(F.col("caller").alias("function")).agg(F.count("*").alias("_n"))
        left = durable(waiting.join(come, "function", "left").select("function", (F.col("open") - F.coalesce("_n", F.lit(0))).alias("open")))
        free(last)
        front, waiting, last = left.filter("open = 0").select("function"), left.filter("open > 0"), left
        if front.isEmpty():
            return spark.read.schema(schema).parquet(folder), waiting.select("function")
    raise _over("heights", max_rounds)


def gathered(edges: DataFrame, held: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(function, block, own, below): what each function holds itself, of held (function, block, bits), and what those that it reaches hold.

    Made from the leaves up: a function is done when all its callees are, so its blocks are merged, written and sent to its callers
    once, whatever the number of rounds. Functions on a cycle reach the same and go as one.
    """
    step, spark = _steps(edges), edges.sparkSession
    own = durable(held.groupBy("function", "block").agg(F.expr("bit_or(bits)").alias("own")))
    heights, rest = _heights(step, max_rounds)
    ring = None
    if not rest.isEmpty():
        inside = step.join(rest.withColumnRenamed("function", "caller"), "caller", "left_semi").join(rest.withColumnRenamed("function", "callee"), "callee", "left_semi")
        ring = durable(cycles(inside, max_rounds).select(F.explode(F.array("caller", "callee")).alias("function"), "component").distinct())
        a, b = ring.toDF("caller", "_a"), ring.toDF("callee", "_b")
        step = _steps(step.join(a, "caller", "left").join(b, "callee", "left").select(F.coalesce("_a", "caller").alias("caller"), F.coalesce("_b", "callee").alias("callee")))
        heights, _ = _heights(step, max_rounds)
    node = own if ring is None else own.join(ring, "function", "left").select(F.coalesce("component", "function").alias("function"), "block", "own")
    of, at = heights.toDF("callee", "of"), heights.toDF("caller", "at")
    up = durable(step.join(of, "callee").join(at, "caller"))
    come, done = fresh_folder(spark), fresh_folder(spark)
    zero = F.lit(0).cast("long")
    first = node.join(heights, "function", "left").select("function", "block", "own", zero.alias("below"), F.coalesce("height", F.lit(0)).alias("at"))
    write(first, come, "at")
    schema, top = first.schema, heights.agg(F.max("height")).first()[0] or 0
    for height in range(top + 1):
        rows = spark.read.schema(schema).parquet(come).filter(F.col("at") == height)
        write(rows.groupBy("function", "block").agg(F.expr("bit_or(own)").alias("own"), F.expr("bit_or(below)").alias("below")), f"{done}/height={height}")
        remove(spark, f"{come}/at={height}")
        if height < top:
            sent = spark.read.schema(StructType(schema.fields[:-1])).parquet(f"{done}/height={height}").withColumnRenamed("function", "callee").join(up.filter(F.col("of") == height), "callee")
            write(sent.select(F.col("caller").alias("function"), "block", zero.alias("own"), F.col("own").bitwiseOR(F.col("below")).alias("below"), "at"), come, "at", mode="append")
    every = spark.read.schema(StructType(schema.fields[:-1]).add("height", "integer")).parquet(done).drop("height")
    if ring is None:
        return every
    whole = every.withColumnRenamed("function", "component").join(ring, "component").select("function", "block", F.col("own").bitwiseOR(F.col("below")).alias("below"))
    whole = whole.join(own, ["function", "block"], "left").select("function", "block", F.coalesce("own", zero).alias("own"), "below")
    return every.join(ring, "function", "left_anti").union(whole)


def pairs_of(spread_over: DataFrame, named: DataFrame) -> DataFrame:
    """(root, function) for every bit of blocks."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.expr("1L").bitwiseAND(F.call_function("shiftright", F.col("bits"), b)) == 1)
    return spread_over.select("function", "block", F.explode(places).alias("bit")).join(named, ["block", "bit"]).select("root", "function")


def roots_reaching(spread_over: DataFrame) -> DataFrame:
    """(function, roots): how many roots reach each function, by counting bits."""
    return spread_over.groupBy("function").agg(F.sum(F.bit_count("bits")).cast("long").alias("roots"))


def depths(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(function, depth): fewest hops from any of roots (root); work in proportion to the edges for each round."""
    step = _steps(edges)
    state = durable(roots.select(F.col("root").alias("function")).dropna().distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_rounds + 1):
        front = state.filter(F.col("depth") == depth - 1).select(F.col("function").alias("caller"))
        found = front.join(step, "caller").select(F.col("callee").alias("function")).distinct()
        last, state = state, durable(state.join(found.withColumn("_now", F.lit(depth)), "function", "full").select("function", F.coalesce("depth", "_now").alias("depth")))
        free(last)
        if state.filter(F.col("depth") == depth).isEmpty():
            return state
    raise _over("the walk", max_rounds)


#: Rounds of least_paths that are written on their own before they are merged.
MERGE_ROUNDS = 8


def least_paths(calls: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(root, function, path, chain): the first place of each function in a depth-first walk of calls (caller, callee, ordinal).

    `path` has the ordinals of the calls from the root on, `chain` the functions from the root to this one. The first place is
    that of the least path, compared call by call, among paths that meet no function twice; a part of a least path is one itself,
    so paths are made longer by a call a round until none is the least. A round writes the least of its own paths only; every
    MERGE_ROUNDS rounds these are merged into the least of all, and those of the last that are not are given up.
    """
    step = durable(calls.filter("caller <> callee").groupBy("caller", "callee").agg(F.min("ordinal").cast("int").alias("ordinal")))
    kind = next(f.dataType for f in roots.schema if f.name == "root")
    empty = F.array().cast("array<int>")
    best = new = durable(roots.select("root").dropna().distinct().select("root", F.col("root").alias("function"), empty.alias("path"), F.array(F.col("root").cast(kind)).alias("chain")))
    apart: list[DataFrame] = []

    def merged() -> DataFrame:
        every = best.withColumn("last", F.lit(False))
        for x in apart:
            every = every.union(x.withColumn("last", F.lit(x is new)))
        least = every.repartition("root", "function").groupBy("root", "function").agg(F.min(F.struct("path", "chain", "last")).alias("x"))
        out = durable(least.select("root", "function", "x.*"))
        free(best, *apart)
        return out

    for _ in range(max_rounds):
        # by an exchange at any size: a table of up to the broadcast threshold in each round would all go through the driver
        moved = new.withColumnRenamed("function", "caller").join(step.hint("merge"), "caller").filter(~F.array_contains("chain", F.col("callee")))
        longer = F.struct(F.array_append("path", F.col("ordinal")).alias("path"), F.array_append("chain", F.col("callee")).alias("chain"))
        come = moved.select("root", F.col("callee").alias("function"), longer.alias("come")).repartition("root", "function")
        new = durable(come.groupBy("root", "function").agg(F.min("come").alias("come")).select("root", "function", "come.path", "come.chain"))
        apart.append(new)
        if len(apart) < MERGE_ROUNDS and not new.isEmpty():
            continue
        both = merged()
        best, new, apart = both.drop("last"), both.filter("last").drop("last"), []
        best._folder = both._folder
        if new.isEmpty():
            free(step)
            return best
    raise _over("paths", max_rounds)


def placed(paths: DataFrame) -> DataFrame:
    """least_paths with `at`, a number that orders the paths of a root as they are ordered themselves, as a written table.

    Rows are sorted in ranges over the whole table, so no task has all paths of a root; rows of many tables then carry a number
    instead of a path and a chain.
    """
    return durable(paths.repartitionByRange("root", "path").sortWithinPartitions("root", "path", "chain").withColumn("at", F.monotonically_increasing_id()))


def _colours(rest: DataFrame, salt: int, max_rounds: int) -> DataFrame:
    """(function, fore, back): the function of greatest hash among those that reach each one, and among those that it reaches."""
    ends = rest.select(F.explode(F.array("caller", "callee")).alias("function")).distinct()
    own = F.struct(F.xxhash64("function", F.lit(salt)).alias("h"), "function")
    state = durable(ends.select("function", own.alias("fore"), own.alias("back"), F.lit(True).alias("new")))
    for _ in range(max_rounds):
        now = state.filter("new")
        down = now.join(rest, F.col("function") == F.col("caller")).select(F.col("callee").alias("at"), "fore", F.lit(None).cast(state.schema["back"].dataType).alias("back"))
        up = now.join(rest, F.col("function") == F.col("callee")).select(F.col("caller").alias("at"), F.lit(None).cast(state.schema["fore"].dataType).alias("fore"), "back")
        come = down.union(up).groupBy(F.col("at").alias("function")).agg(F.max("fore").alias("f"), F.max("back").alias("b"))
        fore, back = F.greatest("fore", "f"), F.greatest("back", "b")  # greatest() leaves nulls out
        last, state = state, durable(state.drop("new").join(come, "function", "left").select("function", fore.alias("fore"), back.alias("back"), ((fore != F.col("fore")) | (back != F.col("back"))).alias("new")))
        free(last)
        if state.filter("new").isEmpty():
            return state.select("function", F.col("fore.function").alias("fore"), F.col("back.function").alias("back"))
    raise _over("colouring", max_rounds)


def cycles(edges: DataFrame, max_rounds: int = 1000, trims: int = 3) -> DataFrame:
    """(caller, callee, component): the edges that lie on a cycle, each with a function that names its strongly connected component.

    Forward and backward colouring: where the greatest ancestor of a function is also its greatest descendant, it is of that
    one's component. Edges of a component are found, and edges between different colours of one kind lie on no cycle; both go,
    and the rest is coloured anew with other hashes, which halves it on average. All that leads to no cycle, or that no cycle leads
    to, is cut before the first colouring, and ends that nothing enters or leaves before each. Edges from a function to itself are
    cycles of their own.
    """
    every = durable(edges.select("caller", "callee").distinct())
    out = every.filter("caller = callee").withColumn("component", F.col("caller"))
    rest = durable(every.filter("caller <> callee"))
    for _ in range(2):  # callees first, then callers first; the second turn gives back the direction
        stay = _heights(rest, max_rounds)[1]
        rest = rest.join(stay.withColumnRenamed("function", "caller"), "caller", "left_semi").join(stay.withColumnRenamed("function", "callee"), "callee", "left_semi")
        rest = durable(rest.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")))
    for salt in range(max_rounds):
        for _ in range(trims):
            rest = rest.join(rest.select(F.col("callee").alias("caller")).distinct(), "caller", "left_semi").join(rest.select(F.col("caller").alias("callee")).distinct(), "callee", "left_semi").select("caller", "callee")
            rest = durable(rest)
        if rest.isEmpty():
            return out
        colour = _colours(rest, salt, max_rounds)
        a, b = colour.toDF("caller", "_fa", "_ba"), colour.toDF("callee", "_fb", "_bb")
        alike = durable(rest.join(a, "caller").join(b, "callee").filter("_fa = _fb AND _ba = _bb").select("caller", "callee", F.col("_fa").alias("component"), (F.col("_fa") == F.col("_ba")).alias("found")))
        out = out.union(alike.filter("found").select("caller", "callee", "component"))
        rest = durable(alike.filter("NOT found").select("caller", "callee"))
    raise _over("components", max_rounds)


def totals_below(nodes: DataFrame, links: DataFrame, values: dict[str, Column], max_rounds: int = 1000) -> DataFrame:
    """(node, height, each value): values of a node and of all places below it, shared nodes once for each place they stand at.

    nodes (node, ...) and links (parent, child; repeated links count) have no cycle, else this raises. Totals are exact decimals,
    made from the leaves up: a node is done when all its children are, so each link is followed once, however many trees share it.
    """
    links = durable(links.select("parent", "child"))
    children = links.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open"))
    wide = {k: v.cast("decimal(38,0)").alias(k) for k, v in values.items()}
    state = durable(nodes.select("node", *wide.values()).join(children, "node", "left").select("node", *values, F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).alias("height")).withColumn("new", F.col("open") == 0))
    names = list(values)
    for _ in range(max_rounds):
        if state.filter("new").isEmpty():
            if not state.filter("open > 0").isEmpty():
                raise ValueError("links form a cycle, or name a child that is no node")
            return state.drop("open", "new")
        up = state.filter("new").withColumnRenamed("node", "child").join(links, "child")
        come = up.groupBy(F.col("parent").alias("node")).agg(*[F.sum(k).alias(f"_of_{k}") for k in names], F.count("*").alias("_links"), F.max("height").alias("_top"))
        add = [(F.col(k) + F.coalesce(f"_of_{k}", F.lit(0))).cast("decimal(38,0)").alias(k) for k in names]
        left = F.col("open") - F.coalesce("_links", F.lit(0))
        last, state = state, durable(state.drop("new").join(come, "node", "left").select("node", *add, left.alias("open"), F.greatest("height", F.col("_top") + 1).alias("height"), (F.col("_links").isNotNull() & (left == 0)).alias("new")))
        free(last)
    raise _over("totals", max_rounds)
