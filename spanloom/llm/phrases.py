"""Phrase collocations by mergeable Misra-Gries summaries, then an exact count.

A phrase of n words is frequent only if its parts are, so summaries are made a
level at a time: words, then pairs of surviving words, then phrases of three and
more whose pairs all survive. In each level a task counts the phrases of its own
texts by hash and ships them in blocks, one for each range of hashes; a range
merges its blocks into one Misra-Gries summary whose capacity exceeds the range's
mass divided by the threshold. What is taken off a counter is then less than the
threshold, so every frequent phrase survives. Survivors travel back as a bit set
of bounded size that answers yes for each of them (and for some others, which
costs work only). A second pass counts what survived exactly, by its text: tasks
send their counts in one block for each range of hashes, and a range adds them up.

Defined cases: null and blank texts have no word; a null language is `und`;
equal rows count as often as they stand; whole texts are read, however long;
ties of a cut go to the shorter first part, ties of rank to the phrase that is
less in UTF-8 byte order; an empty table gives no phrase; other columns, of any
name, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, durable, gram_hashes, mix, split_words

#: Characters that end a piece, and those that end a word inside one.
_ENDS = np.zeros(256, bool)
_ENDS[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_APART = _ENDS.copy()
_APART[[0x20, 0x09]] = True

#: Different phrases that a task holds before it ships them; phrases of one range of hashes, repeats counted, on average.
HELD, RANGE_MASS = 2_000_000, 16_000_000
#: A bit set of survivors has 16 bits for each of them, but never more than this (64 MB).
MOST_BITS = 1 << 29


class BitSet:
    """Answers yes for all keys that it was made of, and for few others while it has bits enough."""

    def __init__(self, bits: int, at: np.ndarray, words: np.ndarray):
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(max(1, bits >> 6), np.uint64)
        self.words[at] = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for slot in (keys & self.mask, (keys >> np.uint64(34)) & self.mask):
            found &= (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
        return found


def bit_set(keys: DataFrame, most_bits: int = MOST_BITS) -> BitSet:
    """The bit set of `key` (long) of all rows; tasks merge their bits, so that what reaches the driver is bounded by its size."""
    n = keys.count()
    bits = min(most_bits, max(1 << 10, 1 << (16 * max(n, 1) - 1).bit_length()))
    mask = F.lit(bits - 1).cast("long")
    slots = keys.select(F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 34).bitwiseAND(mask))).alias("slot"))
    word = F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS INT)))")
    found = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(word.alias("word")).toArrow()
    return BitSet(bits, found["at"].to_numpy(), found["word"].to_numpy().view(np.uint64))


class _Text:
    """The words of some texts: their hashes, the pieces they stand in, and the keys of runs of them."""

    def __init__(self, texts: list, seeds: np.ndarray):
        self.w = split_words(texts, lower=True, apart=_APART)
        self.piece = np.cumsum(_ENDS[self.w.buf], dtype=np.int64)[self.w.start]
        self.n_words = np.diff(self.w.first)
        self.of_text, self.seed = seeds, np.repeat(seeds, self.n_words)
        self.made: dict[int, np.ndarray] = {}

    def keys(self, n: int) -> np.ndarray:
        """A key for each run of n words, by its words and language; also for runs over the end of a piece."""
        if n not in self.made:
            grams = gram_hashes(self.w.hash, n)
            self.made[n] = mix(grams ^ self.seed[: len(grams)])
        return self.made[n]

    def possible(self, n: int, words: BitSet | None, pairs: BitSet | None) -> np.ndarray:
        """Where a run of n words lies in one piece and all of its words, or of its pairs, survived."""
        m = max(0, len(self.piece) - n + 1)
        inside = self.piece[:m] == self.piece[n - 1 : n - 1 + m]
        part, known = (2, pairs) if n > 2 else (1, words)
        if n > 1 and known is not None and m:
            has = known.has(self.keys(part))
            for k in range(n - part + 1):
                inside &= has[k : k + m]
        return np.flatnonzero(inside)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, _Text]]:
    """(languages, words) of some two million bytes of (lang, seed, text) at a time."""
    for rb in batches:
        lang, seed, text = rb.column(0).to_pylist(), rb.column(1).to_numpy().view(np.uint64), rb.column(2).to_pylist()
        for lo, hi in chunks(text, lambda t: len(t or b"")):
            yield lang[lo:hi], _Text(text[lo:hi], seed[lo:hi])


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    keys, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Rising keys and their counts: steps between keys, the bytes of one weight together, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps).tobytes() + n.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(z: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    keys, n = (np.ascontiguousarray(half.reshape(8, -1).T) for half in (raw[: len(raw) // 2], raw[len(raw) // 2 :]))
    return np.cumsum(keys.view(np.uint64).ravel(), dtype=np.uint64), n.view(np.int64).ravel()


def summarise(blocks: Iterator[tuple[np.ndarray, np.ndarray]], capacity: int, step: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, int]:
    """The merged Misra-Gries summary of counted blocks: keys, counters, and the most that a counter is too low by.

    At most `capacity` counters are kept after each merge: all are lowered by the next largest one, and those at zero go. Each
    unit of that takes one from over `capacity` counters, so counters are too low by less than the mass divided by the capacity.
    """
    keys, n, low = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    waiting, size = [], 0

    def merge() -> None:
        nonlocal keys, n, low
        keys, n = _counted([(keys, n), *waiting])
        if len(n) > capacity:
            off = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
            keys, n, low = keys[n > off], n[n > off] - off, low + off

    for block in blocks:
        waiting.append(block)
        size += len(block[0])
        if size >= step:
            merge()
            waiting, size = [], 0
    merge()
    return keys, n, low


def _bounds(ranges: int) -> np.ndarray:
    """Where all but the first of equal ranges of keys begin."""
    return np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)


def _to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(table)
    return sink.getvalue().to_pybytes()


def _survivors(texts: DataFrame, lengths: tuple[int, ...], words: BitSet | None, pairs: BitSet | None, threshold: int, ranges: int) -> DataFrame:
    """(key) of all runs of these lengths that may stand `threshold` times or more, with every one that does."""
    bounds = _bounds(ranges)

    def ship(held: list) -> pa.RecordBatch:
        keys, n = _counted(held)
        cut = np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))
        full = np.flatnonzero(np.diff(cut))
        parts = [(keys[cut[r] : cut[r + 1]], n[cut[r] : cut[r + 1]]) for r in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([int(c.sum()) for _, c in parts], pa.int64()), pa.array([pack(*p) for p in parts], pa.binary())], ["range", "mass", "z"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, text in _read(batches):
            for n in lengths:
                at = text.possible(n, words, pairs)
                if len(at):
                    held.append(np.unique(text.keys(n)[at], return_counts=True))
                    size += len(held[-1][0])
            if size > HELD:
                held = [_counted(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield ship(held)
                    held, size = [], 0
        if held:
            yield ship(held)

    def merge(blocks: pa.Table) -> pa.Table:
        mass = sum(blocks["mass"].to_pylist())
        keys, n, low = summarise((unpack(z.as_py()) for z in blocks["z"]), mass // threshold + 1)
        return pa.table({"key": pa.array(keys[n + low >= threshold].view(np.int64))})

    blocks = texts.mapInArrow(count, "range long, mass long, z binary")
    return durable(blocks.groupBy("range").applyInArrow(merge, "key long"))


def count_frequent(docs: DataFrame, threshold: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang", most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, k, phrase, n) of each phrase of k words, 1 to `longest`, that stands `threshold` times or more in its language.

    A row of k = 0 has all words of the language. Phrases are joined by one space.
    """
    lang = F.coalesce(docs[f"`{lang_col}`"].cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("seed"), docs[f"`{text_col}`"].cast("string").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 + size // RANGE_MASS  # over one for each RANGE_MASS words
    session = texts.sparkSession
    ranges = max(ranges, int(session.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(ranges)
    level = lambda lengths, words, pairs: bit_set(_survivors(texts, lengths, words, pairs, threshold, len(lengths) * ranges), most_bits)
    words = level((1,), None, None)
    pairs = level((2,), words, None) if longest > 1 else None
    rest = level(tuple(range(3, longest + 1)), words, pairs) if longest > 2 else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[str, int]] = {}
        names: dict[int, tuple[str, int, str]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def ship() -> pa.RecordBatch:
            total = [(np.array([seed], np.uint64), np.array([n])) for seed, (_, n) in totals.items()]
            keys, n = _counted([*held, *total]) if held or total else (np.empty(0, np.uint64), np.empty(0, np.int64))
            found = [names.get(k) or (totals[k][0], 0, "") for k in keys.tolist()]
            table = pa.table([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.string()), pa.array(n, pa.int64())], ["lang", "k", "phrase", "n"])
            cut = np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))
            full = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([_to_ipc(table.slice(cut[r], cut[r + 1] - cut[r])) for r in full], pa.binary())], ["range", "z"])

        for langs, text in _read(batches):
            for lang, seed, n in zip(langs, text.of_text.tolist(), text.n_words.tolist(), strict=True):
                totals[seed] = lang, totals.get(seed, (lang, 0))[1] + n
            raw, start, end = text.w.buf.tobytes(), text.w.start, text.w.end
            doc = np.searchsorted(text.w.first, np.arange(len(start)), side="right") - 1
            for k in range(1, longest + 1):
                at = text.possible(k, words, pairs)
                at = at[(words, pairs, rest)[min(k, 3) - 1].has(text.keys(k)[at])] if len(at) else at
                if not len(at):
                    continue
                keys, first, n = np.unique(text.keys(k)[at], return_index=True, return_counts=True)
                held.append((keys, n))
                for key, i in zip(keys.tolist(), at[first].tolist(), strict=True):
                    if key not in names:
                        phrase = b" ".join(raw[start[j] : end[j]] for j in range(i, i + k))
                        names[key] = langs[doc[i]], k, phrase.decode("utf-8", "replace")
            if len(held) > 200:
                held[:] = [_counted(held)]
            if len(names) > HELD // 4:
                yield ship()
                totals, names, held = {}, {}, []
        yield ship()

    def add(blocks: pa.Table) -> pa.Table:
        every = pa.concat_tables([pa.ipc.open_stream(z.as_buffer()).read_all() for z in blocks["z"]])
        sums = every.group_by(["lang", "k", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "k", "phrase", "n"])
        return sums.filter((pc.field("k") == 0) | (pc.field("n") >= threshold))

    return durable(texts.mapInArrow(count, "range long, z binary").groupBy("range").applyInArrow(add, "lang string, k int, phrase string, n long"))


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, top: int = 2000, share: int = 100, text_col: str = "text", lang_col: str = "lang", most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words, by their weakest cut.

    A phrase that stands inside a longer one which is found in at least `share` per cent of its places is left out. Joins are on
    (language, phrase); a part that many phrases share is split by Spark's skew join where it needs to be.
    """
    counts = count_frequent(docs, threshold, longest, text_col, lang_col, most_bits)
    found = counts.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    totals = durable(counts.filter("k = 0").select("lang", "n"))  # a small table of its own, which Spark sends to all tasks by its size
    part = lambda name, n: counts.filter("k > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("tail", F.expr("substring_index(phrase, ' ', cut - k)"))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: f"cast({c} AS DECIMAL(20,0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000BD * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("_at"))
    # all runs inside longer phrases, with the most frequent of those phrases
    words = F.split("phrase", " ")
    inside = found.filter("k > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    longer = inside.select("lang", F.array_join(F.slice(words, F.col("i"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(f"_longer IS NULL OR 100 * _longer < {share} * a")
    rows = kept.select("lang", "phrase", "a", F.col("_at.l").alias("l"), F.col("_at.r").alias("r"), "n", F.col("_at.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: the first ones of parts of it are found before its own
    parts = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = rows.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
