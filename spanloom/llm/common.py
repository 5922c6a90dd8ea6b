"""What several operators share: durable intermediate tables, word splitting, word arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import durable, shared_dir  # noqa: F401  one way to write tables for all

#: A word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Keys that hold over a HOT-th of all rows are fewer than HOT, at any size: they may be broadcast.
HOT = 1000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, spread_by: list[Column], part: str | None = None) -> DataFrame:
    """rows inner-joined to `table`, which has one row for each key with the number of its rows, `n`, of `total` in all.

    No task meets more than about total / HOT rows of one key: a key of more rows is dealt over several parts by `spread_by`, and
    its one row of the table goes to each. Those keys, under HOT of them, reach the rows by broadcast. Keys are not null; `table`
    is read twice, `rows` once.
    """
    limit = max(1, total // HOT)
    parts = F.ceil(F.col(n) / limit).cast("long")
    hot = F.broadcast(table.filter(F.col(n) > limit).select(*on, parts.alias("_parts")))
    number = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_parts")), F.lit(0).cast("long"))
    dealt = rows.join(hot, on, "left").withColumn("_part", number).drop("_parts")
    copied = table.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    joined = dealt.join(copied, [*on, "_part"])
    return joined.withColumnRenamed("_part", part) if part else joined.drop("_part")


def numbered(base: DataFrame) -> DataFrame:
    """base (mark, ...), where the first of equal marks stays and the others have their number mixed in, written as a table.

    Equal marks are numbered in each partition of the input, and partitions by their counts: none meets all rows of a mark.
    """
    base = durable(base.withColumn("_input", F.spark_partition_id()))
    n = base.groupBy("mark", "_input").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("mark").orderBy("_input")) - F.col("_n")
    offset = n.select("mark", "_input", before.alias("_before")).filter("_before > 0")
    nth = F.row_number().over(W.partitionBy("mark", "_input").orderBy("mark")) - 1
    counted = base.withColumn("_nth", nth).join(offset, ["mark", "_input"], "left").withColumn("_nth", F.col("_nth") + F.coalesce("_before", F.lit(0)))
    mark = F.when(F.col("_nth") > 0, F.xxhash64("mark", "_nth")).otherwise(F.col("mark"))
    return durable(counted.withColumn("mark", mark).drop("_input", "_before", "_nth"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Every fourth document, by the checksum of its id's digits (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def distinct_texts(docs: DataFrame, text_col: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(columns, a, b) for every row, with the text's two hashes, and (a, b, z, copies) for every text, compressed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    a, b = F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for rb in batches:
            z = [pack(t.encode("utf-8", "surrogatepass")) for t in rb.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rb.columns[:2], pa.array(z, pa.binary())], ["a", "b", "z"])

    # the hashes are never null: joins on them then read the exchange of this grouping again
    schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.LongType(), False), T.StructField("z", T.BinaryType())])
    texts = docs.select(a, b, text.alias("text")).mapInArrow(compress, schema).groupBy("a", "b").agg(F.first("z").alias("z"), F.count("*").alias("copies"))
    return docs.select(*columns, a, b), texts


_PRIME, _WPRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """The public 64-bit finaliser of MurmurHash3."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        m = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(m, base), np.full(m, inverse)
        up[0] = down[0] = 1
        have = _POWERS[int(base)] = (np.cumprod(up), np.cumprod(down))
    return have[0][:n], have[1][:n]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end] for each of the given runs."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """The words of several texts: byte ranges in buf, hashes, and where each text's words begin."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def of(self, k: int) -> slice:
        return slice(self.first[k], self.first[k + 1])


def split_words(texts: list, lower: bool = False, hashes: bool = True, block: int = 1 << 20, apart: np.ndarray = _SPACE) -> Words:
    """The words of texts (str or UTF-8 bytes): maximal runs of bytes that `apart`, a table of 256 booleans, does not name."""
    parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else (t or b"") for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    if lower:
        buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    space = apart[buf]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not space[0]:
        start = np.concatenate(([0], start))
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    first = np.searchsorted(start, at)
    h = np.empty(len(start) if hashes else 0, np.uint64)
    k = 0
    while hashes and k < len(start):  # in blocks: eight bytes for each byte of text only for a block
        stop = max(k + 1, int(np.searchsorted(start, start[k] + block)))
        piece = buf[start[k] : end[stop - 1]].astype(np.uint64) + np.uint64(1)
        h[k:stop] = run_hashes(piece, start[k:stop] - start[k], end[k:stop] - start[k], _PRIME)
        k = stop
    return Words(buf, start, end, h, first)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    i = np.arange(n)
    return run_hashes(h, i, i + k, _WPRIME)


def chunks(rows: list, size, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `most`: bounds the arrays made for one step."""
    begin = total = 0
    for k, row in enumerate(rows):
        if total and total + size(row) > most:
            yield begin, k
            begin, total = k, 0
        total += size(row) + 1
    if begin < len(rows):
        yield begin, len(rows)
