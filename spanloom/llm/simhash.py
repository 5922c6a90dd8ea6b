"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are packed into tiles of neighbouring population counts. Only pairs of
tiles whose counts differ by no more than the radius are compared, exactly, with
exclusive-or and bit counts; inside a pair, rows are ordered by the population
count of their upper half and skipped by the same rule. A pair of tiles gives a
spanning forest of its links, so a group of copies never becomes all its pairs.
Fingerprints and texts are taken once, with the number of their rows; what many
rows share is joined back over several parts (`join_counted`).

Defined cases: null and blank texts have fingerprint zero and link like any
other; texts of fewer words than a shingle are one shingle; equal rows share a
fingerprint; an empty table gives an empty table; a component of documents
whose ids are all null has a null id; texts are read whole, however long; bits
that just half the shingles set are 0; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, distinct_texts, durable, gram_hashes, join_counted, split_words


def text_fingerprints(texts: list, shingle_words: int = 4, seed: int = 42, distinct: bool = False) -> np.ndarray:
    """The 64-bit fingerprints of texts: bit set where over half the shingles' XXH64, or the distinct ones, have it set."""
    out = np.zeros(len(texts), np.uint64)
    w = split_words(texts, lower=True, hashes=False)
    digest = xxhash.xxh64_intdigest
    for k in range(len(texts)):
        own = w.of(k)
        start, end = w.start[own], w.end[own]
        if not len(start):
            continue
        # the text with one space between words: shingles are then slices of it
        begin = int(start[0])
        raw = w.buf[begin : end[-1]].tobytes()
        if len(start) > 1 and ((start[1:] - end[:-1]) != 1).any() or (raw.translate(None, b"\t\n\x0b\x0c\r") != raw):
            raw = b" ".join(raw.split())
            length = end - start
            end = np.cumsum(length + 1) - 1
            start = end - length
        else:
            start, end = start - begin, end - begin
        s = shingle_words - 1
        lo, hi = (start.tolist(), end[s:].tolist()) if len(start) > s else ([0], [int(end[-1])])
        h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(lo, hi)), np.uint64, len(hi))
        h = np.unique(h) if distinct else h
        ones = np.zeros(64, np.int64)
        for c in range(0, len(h), 65536):
            ones += np.unpackbits(h[c : c + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fp = [text_fingerprints(texts[i:j], shingle_words, seed) for i, j in chunks(texts, lambda t: len(t or ""))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(fp or [np.empty(0, np.uint64)]).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, f"doc_id {kind}, fp long")


class Forest:
    """A minimum spanning forest of links by distance, grown from batches of links; holds no more than nodes and a buffer."""

    def __init__(self, n: int, most: int = 250_000) -> None:
        self.n, self.most, self.size = n, most, 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.steps, self.joined = np.empty(0, np.int64), np.empty((0, n), np.int32)  # distances, and what links up to each have joined

    def needed(self, d: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Which links do not close a cycle of links that are as near: the others are in no need of a minimum spanning forest."""
        at = np.searchsorted(self.steps, d, side="right") - 1
        if not len(self.steps):
            return np.ones(len(d), bool)
        return (at < 0) | (self.joined[at, u] != self.joined[at, v])

    def add(self, d: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        self.held.append((d, u, v))
        self.size += len(d)
        if self.size > self.most:  # the forest of a part and of the rest have the forest of all
            self.held = [self.edges(note=True)]
            self.size = len(self.held[0][0])

    def edges(self, note: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
        d, u, v = (np.concatenate(x) for x in zip(*self.held))
        root, chosen, joined = np.arange(self.n), [], []
        for k in (steps := np.unique(d)):
            at = np.flatnonzero(d == k)
            while True:
                a, b = root[u[at]], root[v[at]]
                apart = a != b
                at, a, b = at[apart], a[apart], b[apart]
                if not len(at):
                    break
                high, low = np.maximum(a, b), np.minimum(a, b)
                hook, which = np.unique(high, return_index=True)  # every root hooks once, to a smaller one
                root[hook] = low[which]
                chosen.append(at[which])
                while (root[root] != root).any():
                    root = root[root]
            joined.append(root.astype(np.int32))
        if note:
            self.steps, self.joined = steps.astype(np.int64), np.stack(joined)
        at = np.concatenate(chosen) if chosen else np.empty(0, np.int64)
        return d[at], u[at], v[at]


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int, also: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of a, of b) that a spanning forest of two tiles' links joins, nearest links first; rows of b follow those of a.

    `also`, given rows of a and of b, says which links hold.
    """
    half = np.uint64(32)
    up = [np.bitwise_count(x >> half).astype(np.int16) for x in (a, b)]
    ia, ib = np.argsort(up[0], kind="stable"), np.argsort(up[1], kind="stable")
    a, b, ua, ub = a[ia], b[ib], up[0][ia], up[1][ib]
    shift = 0 if same else len(a)
    forest = Forest(len(a) + (0 if same else len(b)))
    step, width = 64, 4096
    for i in range(0, len(a), step):
        rows = a[i : i + step, None]
        lo, hi = np.searchsorted(ub, ua[i] - radius), np.searchsorted(ub, ua[min(i + step, len(a)) - 1] + radius, "right")
        for j in range(max(lo, i) if same else lo, hi, width):
            bits = np.bitwise_count(rows ^ b[None, j : min(j + width, hi)])
            if bits.min() > radius:
                continue
            u, v = (bits <= radius).nonzero()
            d, u, v = bits[u, v], ia[u + i], ib[v + j]
            keep = forest.needed(d, u, v + shift)
            keep &= u != v if same else True
            if also is not None:
                keep[keep] = also(u[keep], v[keep])
            forest.add(d[keep], u[keep], v[keep] + shift)
    _, u, v = forest.edges()
    return u, v


def _near_tiles(tiles: DataFrame, radius: int) -> DataFrame:
    """(a, b), a <= b: the pairs of tiles (tile, class, low, high, fps) that may hold links.

    Their population counts, from low to high, come within the radius, and their classes differ by one at most. Tiles meet in
    ranges of counts and of classes.
    """
    slim = tiles.select("tile", "class", "low", "high")
    ranges = lambda low, high: F.explode(F.sequence(F.floor(low / (radius + 1)), F.floor(high / (radius + 1)))).alias("range")
    left = slim.select(F.col("tile").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)).alias("class"))
    left = left.select("*", ranges(F.greatest(F.lit(0), F.col("la") - radius), F.col("ha") + radius))
    right = slim.select(F.col("tile").alias("b"), "class", "low", "high", ranges(F.col("low"), F.col("high")))
    near = (F.col("a") <= F.col("b")) & (F.col("la") <= F.col("high") + radius) & (F.col("low") <= F.col("ha") + radius)
    return left.join(right, ["class", "range"]).filter(near).select("a", "b").distinct()


def _tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(a, b, fa, fb) for the pairs of tiles that may hold links."""
    pairs = _near_tiles(tiles, radius)
    work = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fa")), "a").repartition("a", "b")
    return work.join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fb")), "b")


def _tile_stripes(tiles: DataFrame, radius: int) -> DataFrame:
    """(a, b, fps): each tile, once, followed by those that may hold links to it, in one partition and in this order."""
    pairs = durable(_near_tiles(tiles, radius).filter("a <> b"))
    other = pairs.join(tiles.select(F.col("tile").alias("b"), "fps"), "b").select("a", "b", "fps")
    own = tiles.select(F.col("tile").alias("a"), F.col("tile").alias("b"), "fps")
    return own.unionAll(other).repartition("a").sortWithinPartitions("a", F.col("a") != F.col("b"), "b")


def _tiled(rows: DataFrame, tile_rows: int, by: str) -> DataFrame:
    """rows (class, pop, ...) with tile: up to about tile_rows rows of one class, of neighbouring population counts or of one, which `by` splits."""
    cells = durable(rows.groupBy("class", "pop").agg(F.count("*").alias("_n")))  # 65 for each class at most
    before = F.sum("_n").over(W.partitionBy("class").orderBy("pop")) - F.col("_n")
    cells = cells.select("class", "pop", F.floor(before / tile_rows).cast("int").alias("_part"), F.ceil(F.col("_n") / tile_rows).alias("_split"))
    named = rows.join(cells, ["class", "pop"])
    return named.withColumn("tile", F.xxhash64("class", "_part", F.when(F.col("_split") > 1, F.col("pop")), F.pmod(F.xxhash64(by), "_split"))).drop("_part", "_split")


def links(values: DataFrame, radius: int = 4, tile_rows: int = 32768) -> DataFrame:
    """Spanning links (u, v) between the distinct fingerprints in `values` (fp long), lost to none: equal connectivity as all links."""
    rows = _tiled(values.select("fp", F.bit_count("fp").cast("int").alias("pop"), F.lit(0).alias("class")), tile_rows, "fp")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tile": pdf["tile"].iloc[:1], "class": pdf["class"].iloc[:1], "low": [pdf["pop"].min()], "high": [pdf["pop"].max()], "fps": [np.sort(pdf["fp"].to_numpy()).tobytes()]})

    tiles = durable(rows.groupBy("tile").applyInPandas(pack, "tile long, class int, low int, high int, fps binary"))
    work = _tile_pairs(tiles, radius)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a, b, fa, fb in zip(pdf["a"], pdf["b"], pdf["fa"], pdf["fb"]):
                x, y = np.frombuffer(fa, np.int64), np.frombuffer(fb, np.int64)
                u, v = _forest(x.view(np.uint64), y.view(np.uint64), a == b, radius)
                nodes = x if a == b else np.concatenate((x, y))
                yield pd.DataFrame({"u": nodes[u], "v": nodes[v]})

    return work.select("a", "b", "fa", "fb").mapInPandas(compare, "u long, v long")


def local_stars(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition, up to `most` at a time, as edges from each node to the smallest one that it reaches by them."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        n = t.num_rows
        names, at = np.unique(np.concatenate((t["u"].to_numpy(), t["v"].to_numpy())), return_inverse=True)
        a, b, root = at[:n], at[n:], np.arange(len(names))
        while (root[a] != root[b]).any():
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        far = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root[far]])], ["u", "v"])

    held: list[pa.RecordBatch] = []
    for rb in batches:
        held.append(rb)
        if sum(len(x) for x in held) > most:
            yield solve(held)
            held = []
    if held:
        yield solve(held)


#: Edges left of all partitions' own stars that one task still takes at once (16 MB); more go by rounds.
FEW_EDGES = 1_000_000


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, root): connected components of (u, v) by alternating large and small stars, each round a durable table.

    Partitions are made stars of their own first, which leaves few rounds, or none: up to `few` edges are joined at once. Rounds
    end when all edges are stars. The smallest node of a component is its root; nodes without edges are not listed.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.union(e.select("v", "u")) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # written: both sides of the join are then exchanges, and AQE splits a hub's rows
        least = durable(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        near = around.join(least, "u")
        moved = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        return moved.filter("u <> v").distinct()

    def settled(e: DataFrame) -> bool:
        """Every node has one edge to a smaller one, or only edges from larger ones: each component is the star of its smallest node."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty()

    e = durable(edges.select("u", "v").filter("u <> v").mapInArrow(local_stars, "u long, v long").distinct())
    named = lambda e: e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
    if e.count() <= min(few, 4_000_000):  # as many as local_stars holds
        return named(durable(e.coalesce(1).mapInArrow(local_stars, "u long, v long")))
    for _ in range(max_rounds):
        if settled(e):
            return named(e)
        e = durable(star(star(e, True), False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42, radius: int = 4, tile_rows: int = 32768) -> DataFrame:
    """(doc_id, fp long, component_id) for every row; component_id is the smallest doc_id that links reach."""
    prints = durable(fingerprints(docs, id_col, text_col, shingle_words, seed))
    values = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(values, radius, tile_rows))
    rooted = durable(values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")))
    classes = durable(join_counted(rooted.drop("least"), least, ["root"], "prints", rooted.count(), [F.col("fp")]).select("fp", "n", "component_id"))
    return join_counted(prints, classes, ["fp"], "n", prints.count(), [F.monotonically_increasing_id()]).select("doc_id", "fp", "component_id")


_BINS, _NONE = 32, 255


def _profiles(texts: list, shingle_words: int, short: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Number of distinct shingles, a one-permutation minhash sketch (8 bits of the least rest in each of 32 bins), and the shingles of texts of at most `short`."""
    w = split_words(texts, lower=True)
    count, sketch, few = np.zeros(len(texts), np.int32), np.full((len(texts), _BINS), 0xFFFF, np.uint16), []
    for k in range(len(texts)):
        h = w.hash[w.of(k)]
        s = np.unique(gram_hashes(h, min(shingle_words, len(h)))) if len(h) else h
        count[k] = len(s)
        few.append(s.tobytes() if 0 < len(s) <= short else None)
        np.minimum.at(sketch[k], (s >> np.uint64(59)).astype(np.int64), (s >> np.uint64(43)).astype(np.uint16))
    # one byte a bin: equal rests stay equal, and few others become so
    small = np.where(sketch == 0xFFFF, _NONE, sketch % _NONE).astype(np.uint8)
    return count, small, few


def jaccard(a: str, b: str, shingle_words: int = 5) -> float:
    """Shared over all distinct shingles of two texts; two texts without words are alike."""
    sets = []
    for t in (a, b):
        h = split_words([t], lower=True).hash
        sets.append(np.unique(gram_hashes(h, min(shingle_words, len(h)))) if len(h) else h)
    both = len(np.intersect1d(*sets, assume_unique=True))
    total = len(sets[0]) + len(sets[1]) - both
    return both / total if total else 1.0


def alike(group: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows of one group, but of different roots, whose sets reach the similarity: shared values are counted.

    Rows are in order of their groups. Rows of a group's most frequent root are compared only to the others.
    """
    size = np.array([len(x) for x in sets], np.int64)
    forest = Forest(len(sets))
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        _, kind, count = np.unique(root[a:b], return_inverse=True, return_counts=True)
        if len(count) < 2:
            continue
        own = size[a:b]
        name = np.unique(np.concatenate(sets[a:b]), return_inverse=True)[1]
        holder = np.repeat(np.arange(b - a), own)[np.argsort(name, kind="stable")]  # rows with each value
        first = np.concatenate(([0], np.cumsum(np.bincount(name))))
        start = np.concatenate(([0], np.cumsum(own)))
        for u in np.flatnonzero(kind != count.argmax()):
            mine = name[start[u] : start[u + 1]]
            n = first[mine + 1] - first[mine]
            at = np.arange(n.sum()) + np.repeat(first[mine] - (np.cumsum(n) - n), n)
            shared = np.bincount(holder[at], minlength=b - a)
            total = own[u] + own - shared
            v = np.flatnonzero((kind != kind[u]) & ((shared / np.maximum(total, 1) >= similarity) | (total == 0)))
            forest.add(np.zeros(len(v), np.uint8), np.full(len(v), a + u), a + v)
    _, u, v = forest.edges()
    return u, v


def _linked(rows: DataFrame, texts: DataFrame, sets_of: Callable[[list], list[np.ndarray]], similarity: float, block_shingles: int) -> DataFrame:
    """(u, v): spanning links of at least `similarity` in each group of rows (group, root, node, n), between different roots.

    `sets_of` makes sets of shingles of the values of texts (node, data). A group is cut into blocks of about block_shingles shingles, and every pair of blocks that may hold two roots is compared.
    """
    rows = durable(rows)
    sizes = durable(rows.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).filter("rows > 1"))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    sized = join_counted(rows, sizes, ["group"], "rows", total, [F.col("node")])
    cut = durable(sized.withColumn("block", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("shingles") / block_shingles)))).drop("rows", "shingles"))
    blocks = cut.groupBy("group", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    other = blocks.select("group", F.col("block").alias("j"), F.col("low").alias("l"), F.col("high").alias("h"))
    pairs = blocks.join(other, "group").filter("block <= j AND (low <> high OR l <> h OR low <> l)").select("group", F.col("block").alias("i"), "j")
    ends = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    work = cut.join(ends, ["group", "block"]).select(F.xxhash64("group", "i", "j").alias("key"), "root", "node").join(texts, "node").select("key", "root", "node", "data")

    def solve(t: pa.Table) -> pa.RecordBatch:
        u, v = alike(t["key"].to_numpy(), t["root"].to_numpy(), sets_of(t["data"].to_pylist()), similarity)
        node = t["node"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rb in batches:
            for c in range(0, len(rb), 1000):
                held.append(rb.slice(c, 1000))
                if sum(len(x) for x in held) < 1000:
                    continue
                t = pa.Table.from_batches(held)
                keys = t["key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if cut:
                    yield solve(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held and sum(len(x) for x in held):
            yield solve(pa.Table.from_batches(held))

    return work.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")


def _rare(seen: DataFrame, similarity: float) -> DataFrame:
    """(group, node, n): each text of seen (node, n, few) under its rarest shingles, so many that similar texts share one of them."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *sets])), b.column(0).take(row), b.column(1).take(row)], ["group", "node", "n"])

    every = durable(seen.filter("few IS NOT NULL").select("node", F.col("n").cast("long"), "few").mapInArrow(unpack, "group long, node long, n long"))
    held = durable(every.groupBy("group").agg(F.count("*").alias("holders")))
    counted = join_counted(every, held, ["group"], "holders", every.count(), [F.col("node")])
    rank = F.row_number().over(W.partitionBy("node").orderBy("holders", "group"))
    # of n shingles, s * n at least are shared: the first n - s * n + 1 in any common order hold a shared one
    return counted.withColumn("rank", rank).filter((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1) & (F.col("holders") > 1)).select("group", "node", "n")


def similar_classes(docs: DataFrame, text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, radius: int = 18, tile_rows: int = 32768, seed: int = 42, block_shingles: int = 1_000_000, short: int = 64) -> DataFrame:
    """(a, b, copies, root) for each text, known by two hashes: classes of texts that links of at least `similarity` join.

    Texts are compared as fingerprints within the radius, in tiles of a population count and a class of sizes (texts
    whose numbers of shingles differ by more than the similarity allows can't reach it). In a pair of tiles, links whose
    minhash sketches rule the similarity out are left, and a minimum spanning forest of the others, nearest first, is
    verified by exact Jaccard similarity of the shingles: linear in the texts, however large a group of copies is. Where a
    link of a forest fails, true links that it stood for may be missing: all texts that such forests join are then compared
    with each other, exactly, save those already known to be of one class.

    The radius loses links of texts with few shingles: where one of two has at most `short` of them, the pair is found
    exactly, under a rare shingle that both have. Fingerprints are of the distinct shingles, as the similarity is.
    """
    # a text's number is its place in a written table: no two texts share one
    texts = durable(distinct_texts(docs, text_col)[1].withColumn("node", F.monotonically_increasing_id()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            packed = b.column(1).to_pylist()
            for i, j in chunks(packed, lambda z: 3 * len(z)):
                own = [unpack(z) for z in packed[i:j]]
                fp = text_fingerprints(own, shingle_words, seed, distinct=True).view(np.int64)
                count, sketch, few = _profiles(own, shingle_words, int(short / similarity + 1e-9))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp), pa.array(count), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(few, pa.binary())], ["node", "fp", "n", "sketch", "few"])

    seen = texts.select("node", "z").mapInArrow(of, "node long, fp long, n int, sketch binary, few binary")
    step = float(-np.log(similarity))
    sized = seen.withColumns({"pop": F.bit_count("fp").cast("int"), "class": F.floor(F.log(F.greatest("n", F.lit(1))) / step).cast("int")})
    sized = durable(sized)
    parts = _tiled(sized.drop("few"), tile_rows, "node")
    kind = np.dtype([("node", "<i8"), ("fp", "<u8"), ("n", "<i4"), ("sketch", "u1", _BINS)])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.zeros(len(pdf), kind)
        rows["node"], rows["fp"], rows["n"] = pdf["node"], pdf["fp"].to_numpy().view(np.uint64), pdf["n"]
        rows["sketch"] = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, _BINS)
        rows = rows[np.argsort(rows["node"])]
        return pd.DataFrame({"tile": pdf["tile"].iloc[:1], "class": pdf["class"].iloc[:1], "low": [pdf["pop"].min()], "high": [pdf["pop"].max()], "fps": [rows.tobytes()]})

    tiles = durable(parts.groupBy("tile").applyInPandas(pack, "tile long, class int, low int, high int, fps binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: dict[int, np.ndarray] = {}
        for rb in batches:
            for a, b, fps in zip(*(rb.column(c).to_pylist() for c in ("a", "b", "fps"))):
                y = by_pop(fps)
                x = y if a == b else x  # the tile itself comes first
                found = [both(p, q, a == b and k == m) for k, p in x.items() for m, q in y.items() if abs(k - m) <= radius and (a != b or k <= m)]
                u, v = np.concatenate([np.empty((0, 2), np.int64), *found]).T
                yield pa.RecordBatch.from_arrays([pa.array(u.copy()), pa.array(v.copy())], ["u", "v"])

    def by_pop(packed: bytes) -> dict[int, np.ndarray]:
        rows = np.frombuffer(packed, kind)
        pop = np.bitwise_count(rows["fp"])
        return {int(k): rows[pop == k] for k in np.unique(pop)}

    def both(x: np.ndarray, y: np.ndarray, same: bool) -> np.ndarray:
        """A forest for each pair of population counts: many forests leave few links that only a failed one stood for."""

        def also(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            small, large = np.minimum(x["n"][u], y["n"][v]), np.maximum(x["n"][u], y["n"][v])
            out = small >= similarity * large
            for c in range(0, len(u), 65536):
                p, q = x["sketch"][u[c : c + 65536]], y["sketch"][v[c : c + 65536]]
                used = ((p != _NONE) | (q != _NONE)).sum(1)
                out[c : c + 65536] &= ((p == q) & (p != _NONE)).sum(1) >= (similarity - 0.3) * used  # over four deviations below
            return out

        u, v = _forest(x["fp"].copy(), y["fp"].copy(), same, radius, also)
        nodes = x["node"] if same else np.concatenate((x["node"], y["node"]))
        return np.stack((nodes[u], nodes[v]), axis=1)

    edges = durable(_tile_stripes(tiles, radius).mapInArrow(compare, "u long, v long").distinct())
    total = edges.count()

    # only texts that have links go on, with their numbers of links: all texts are dealt once for that
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("nu"), F.lit(0).alias("nv")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    linked = durable(texts.select("node", "z").join(ends.groupBy("node").agg(F.sum("nu").alias("nu"), F.sum("nv").alias("nv")), "node"))

    def with_text(rows: DataFrame, end: str) -> DataFrame:  # a hub's text meets its links in several parts
        table = linked.filter(F.col(f"n{end}") > 0).select(F.col("node").alias(end), F.col("z").alias(f"z{end}"), F.col(f"n{end}").alias("degree"))
        return join_counted(rows, table, [end], "degree", total, [F.col("u"), F.col("v")]).drop("degree")

    @F.pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        unpack = zstandard.ZstdDecompressor().decompress
        return pd.Series([jaccard(unpack(x), unpack(y), shingle_words) for x, y in zip(a, b)], dtype=float)

    tried = edges.withColumn("holds", F.lit(True))
    if total:
        tried = durable(with_text(with_text(edges, "v"), "u").select("u", "v", (exact("zu", "zv") >= similarity).alias("holds")))

    def sets_of(own: list) -> list[np.ndarray]:
        w = split_words([zstandard.ZstdDecompressor().decompress(z) for z in own], lower=True)
        words = [w.hash[w.of(k)] for k in range(len(own))]
        return [np.unique(gram_hashes(h, min(shingle_words, len(h)))) if len(h) else h for h in words]

    known = durable(components(tried.filter("holds").select("u", "v"))) if total else edges.toDF("node", "root")
    if total and not tried.filter("NOT holds").isEmpty():
        clusters = durable(components(tried))
        failed = tried.filter("NOT holds").join(clusters, F.col("u") == F.col("node")).select(F.col("root").alias("group")).distinct()
        mixed = clusters.withColumnRenamed("root", "group").join(failed, "group").join(known, "node", "left")
        rows = mixed.join(sized.select("node", "n"), "node").select("group", F.coalesce("root", "node").alias("root"), "node", F.col("n").cast("long").alias("n"))
        found = durable(_linked(rows, linked.select("node", F.col("z").alias("data")), sets_of, similarity, block_shingles))
        known = known if found.isEmpty() else durable(components(known.toDF("u", "v").union(found)))
    rows = _rare(sized, similarity).join(known, "node", "left").select("group", F.coalesce("root", "node").alias("root"), "node", "n")
    few = sized.filter("few IS NOT NULL").select("node", F.col("few").alias("data"))
    found = durable(_linked(rows, few, lambda own: [np.frombuffer(x, np.uint64) for x in own], similarity, block_shingles))
    known = known if found.isEmpty() else components(known.toDF("u", "v").union(found))
    return texts.select("a", "b", "copies", "node").join(known, "node", "left").select("a", "b", "copies", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs, one for each class of similar texts: that of the smallest id, null ids last; of equal ids and texts, the one whose row hashes least.

    Null and blank texts are one class; an empty table gives an empty table; columns keep their names and values, whatever they are.
    What stays is decided on ids and the texts' hashes; whole rows are dealt once, to meet that.
    """
    other = [f for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]  # maps have no hash
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.xxhash64(*[F.col(f"`{f.name}`") for f in other]).alias("order"))
    classes = similar_classes(docs, text_col, **options)
    ids = rows.groupBy("a", "b", "id").agg(F.count("*").alias("rows")).groupBy("a", "b").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rows")).alias("least"))
    best = classes.join(ids, ["a", "b"]).groupBy("root").agg(F.min(F.struct("least", "a", "b", "copies")).alias("best"))
    best = durable(best.select("best.a", "best.b", "best.copies", F.col("best.least.id").alias("least"), F.col("best.least.rows").alias("rows")))
    total = best.agg(F.sum("copies")).first()[0] or 0
    kept = join_counted(rows, best, ["a", "b"], "copies", total, [F.monotonically_increasing_id()]).filter(F.col("id").eqNullSafe(F.col("least")))
    one = kept.filter("rows = 1").select("row.*")
    if best.filter("rows > 1").isEmpty():
        return one
    return one.unionAll(kept.filter("rows > 1").groupBy("a", "b").agg(F.min_by("row", "order").alias("row")).select("row.*"))
