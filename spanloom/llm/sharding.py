"""A uniform shuffle into shards of exact sizes, in DataFrame operations only.

Rows fall into partitions by hash. How many rows of each partition go to each
shard is drawn exactly: the matrix of those counts, with the partitions' sizes
as row sums and the shards' sizes as column sums, is multivariate
hypergeometric. The draw walks down a binary tree over the partitions, whose
nodes are rows: a node's counts for the shards are divided between its halves by
one hypergeometric variate a shard, each found from its distribution around the
mode. Rows are then permuted inside their partition, dealt out by the matrix,
and permuted again inside their shard.

Shard sizes differ by one row at most (law ``rows``); copies of a text are
spread like any other rows.

Defined cases: a null text has size 1 and the checksum of the empty text; equal
rows, null ids and ties are separate rows, placed by a hash of id, text and their
number among equal rows, so a rerun gives the same table; very long texts count whole; an empty table gives an empty table; other columns
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, numbered


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked items among `drawn` of `total`, of which `marked` are: the inverse of its distribution at u.

    Weights are taken relative to the lowest count considered, up to 12 standard deviations from the mode: what lies
    beyond is under 1e-30 of the whole.
    """
    n, k, m = total.cast("double"), marked.cast("double"), drawn.cast("double")
    low, high = F.greatest(F.lit(0.0), m + k - n), F.least(m, k)
    mode = F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")
    spread = F.ceil(12 * F.sqrt(F.greatest(m * k * (n - k) * (n - m) / (n * n * F.greatest(n - 1, F.lit(1.0))), F.lit(0.0)))) + 8
    a, b = F.greatest(low, mode - spread).cast("long"), F.least(high, mode + spread).cast("long")
    zero = F.lit(0.0)
    steps = F.sequence(a, b)

    def grow(s: Column, x: Column) -> Column:
        return (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))

    whole = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), zero.alias("t")), lambda s, x: F.struct((s.w * grow(s, x)).alias("w"), (s.t + s.w).alias("t")), lambda s: s.t)
    start = F.struct(F.lit(1.0).alias("w"), zero.alias("t"), (u * whole).alias("goal"), b.alias("hit"))
    pick = F.aggregate(steps, start, lambda s, x: F.struct((s.w * grow(s, x)).alias("w"), (s.t + s.w).alias("t"), s.goal.alias("goal"), F.when((s.t < s.goal) & (s.t + s.w >= s.goal), x).otherwise(s.hit).alias("hit")), lambda s: s.hit)
    return F.when((drawn <= 0) | (marked <= 0), F.lit(0).cast("long")).when(drawn >= total, marked).when(marked >= total, drawn).otherwise(pick)


def communication_matrix(sizes: DataFrame, shards: int, seed: int = 10) -> DataFrame:
    """(part from 0, rows) -> (part, shard, n): an exact draw. `sizes` has one row per partition; missing ones are empty."""
    last, rows = sizes.agg(F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    deep = int(last).bit_length()
    # rows under each node of the tree: at level l from the root, node i covers parts i << (deep - l) and on
    level = F.explode(F.sequence(F.lit(0), F.lit(deep))).alias("level")
    tree = durable(sizes.select("part", "rows", level).groupBy("level", F.expr(f"shiftright(part, {deep} - level)").alias("node")).agg(F.sum("rows").alias("rows")))
    even = F.array(*[F.lit(rows // shards + (k < rows % shards)).cast("long") for k in range(shards)])
    nodes = durable(tree.filter("level = 0").select("node", even.alias("counts")))
    for depth in range(1, deep + 1):
        left = tree.filter((F.col("level") == depth) & (F.col("node") % 2 == 0)).select((F.col("node") / 2).cast("int").alias("node"), F.col("rows").alias("want"))
        wide = nodes.join(left, "node", "left")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)

        def draw(s: Column, k: Column) -> Column:  # of this shard's rows, those of the left half; then the rest without this shard
            marked = F.col("counts")[k]
            u = _uniform(F.lit(seed), F.lit(depth), F.col("node"), k)
            return F.transform(F.array(hypergeometric(s.total, marked, s.want, u)), lambda n: F.struct((s.total - marked).alias("total"), (s.want - n).alias("want"), F.concat(s.got, F.array(n)).alias("got")))[0]

        begin = F.struct(total.alias("total"), F.coalesce("want", F.lit(0).cast("long")).alias("want"), F.array().cast("array<bigint>").alias("got"))
        got = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), begin, draw, lambda s: s.got)
        wide = wide.select("node", "counts", got.alias("got"))
        halves = F.array(F.struct((2 * F.col("node")).cast("int").alias("node"), F.col("got").alias("counts")), F.struct((2 * F.col("node") + 1).cast("int").alias("node"), F.zip_with("counts", "got", lambda c, n: c - n).alias("counts")))
        nodes = durable(wide.select(F.explode(halves).alias("x")).select("x.*").filter(F.exists("counts", lambda n: n > 0)))
    return nodes.select(F.col("node").alias("part"), F.posexplode("counts").alias("shard", "n"))


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 50_000, seed: int = 10) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; slots have no gaps in a shard.

    `rows_per_part` is what one task permutes at a time, about; the number of partitions follows from the rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text)).alias("mark"))
    base = numbered(base)
    rows = base.count()
    parts = max(1, -(-rows // rows_per_part))
    own = base.withColumns({"part": F.pmod("mark", F.lit(parts)).cast("int"), "first": F.xxhash64("mark", F.lit(1)), "second": F.xxhash64("mark", F.lit(2))})
    sizes = durable(own.groupBy("part").agg(F.count("*").alias("rows")))
    matrix = communication_matrix(sizes, shards, seed)
    upto = F.sum("n").over(W.partitionBy("part").orderBy("shard"))
    cuts = matrix.withColumn("upto", upto).groupBy("part").agg(F.array_sort(F.collect_list("upto")).alias("cuts"))
    local = own.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy("first", "doc_id")))
    dealt = local.join(cuts, "part").withColumn("shard", F.size(F.filter("cuts", lambda x: x < F.col("place"))))
    # the second permutation: ranges of the second hash are ordered groups inside a shard
    pieces = max(1, -(-rows // (shards * rows_per_part)))
    group = F.least(F.floor((F.shiftrightunsigned("second", 11) / F.lit(float(1 << 53))) * pieces), F.lit(pieces - 1)).cast("int")
    dealt = dealt.withColumn("group", group).select("doc_id", "size", "text_crc32", "shard", "group", "second")
    dealt = durable(dealt) if pieces > 1 else dealt
    slot = F.row_number().over(W.partitionBy("shard", "group").orderBy("second", "doc_id")) - 1
    placed = dealt.withColumn("slot", slot)
    if pieces > 1:
        n = dealt.groupBy("shard", "group").agg(F.count("*").alias("n"))
        offset = n.withColumn("offset", F.sum("n").over(W.partitionBy("shard").orderBy("group")) - F.col("n")).drop("n")
        placed = placed.join(offset, ["shard", "group"]).withColumn("slot", F.col("slot") + F.col("offset"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write docs in one folder per shard, in slot order inside each file; id_col must be unique."""
    where = placed.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    docs.join(where, docs[id_col] == where["_id"]).repartition("_shard").sortWithinPartitions("_shard", "_slot").drop("_id", "_slot").withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)
