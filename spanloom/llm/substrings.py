"""Removal of repeated passages with prefix-partitioned suffix trees over words.

A suffix of a text takes part by its first `window` words. Suffixes are split into groups by a part of those words of variable
length: first by their anchor, the least k-gram in them (equal windows have equal anchors at equal places, so they meet; suffixes
that share an anchor share one copy of their words). A group of over `max_group` different contexts is split again by more of the
words that its suffixes have in common: the offsets of its anchor are halved, and each half is grouped by all words that its
windows share, until groups are small or hold one window. Anchors that occur once in the corpus are leaves and go no further;
where an anchor has the same words all around in several places, one of them stands for all.

In each group the suffix tree's leaves are put in order and the depths of the nodes between neighbours found (names of 1, 2, 4 ...
words by prefix doubling). A leaf below an internal node at depth `window` or more starts a repeat as long as its deepest such
node; the union of these is the text's maximal repeats, which are removed.

Texts are taken once: a text with copies repeats wholly, and its copies get its result at the end. No task meets all places of a
frequent passage: rows are counted before they move, and frequent keys are dealt over parts (`join_counted`).

Words, anchors and texts are compared by 64-bit hashes (texts by two), of which a wrong repeat needs 35 equal ones in a row.

Defined cases: null and blank texts have no words and keep the empty text; texts shorter than a window lose nothing; equal rows
repeat each other's windows; whole texts are searched, however long; ids may be null or repeated; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, distinct_texts, durable, gram_hashes, join_counted, mix, run_hashes, split_words

_CONTEXT, _CORE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _anchors(h: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are the last least one of some window that lies in one text."""
    g = gram_hashes(h, k)
    span = window - k + 1  # k-grams of a window
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least, width = g, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n]) if width < span else least[:n]
    pending = np.zeros(n, bool)  # windows inside one text
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= window:
            pending[a : b - window + 1] = True
    anchor = np.zeros(len(g), bool)
    todo = np.flatnonzero(pending)
    value = least[todo]
    for o in range(span - 1, -1, -1):
        hit = g[todo + o] == value
        anchor[todo[hit] + o] = True
        todo, value = todo[~hit], value[~hit]
        if not len(todo):
            break
    at = np.flatnonzero(anchor)
    return at, g[at]


def deep_repeats(group: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) for each row, a context of words: the words below internal nodes of depth `window` or more; from = to if none.

    Row r holds the suffixes at offsets low[r] to high[r], which go to end[r]. Suffixes of a group at one offset make a tree. Two
    of a row's repeats overlap, as offsets differ by less than a window: one range is their union.
    """
    rows, width = words.shape
    spans, depth = width - window + 1, 1
    top = 1 << (window.bit_length() - 1)  # the largest power of two in a window
    pieces = -(-width // top)
    padded = np.concatenate((words, np.zeros((rows, top * pieces - width + spans), np.uint64)), axis=1)
    names = {1: np.unique(padded, return_inverse=True)[1].reshape(padded.shape).astype(np.int64)}
    while depth < top:  # names rank runs of `depth` words, in the order of their words
        a, b = names[depth][:, :-depth], names[depth][:, depth:]
        names[2 * depth] = np.unique(a * np.int64(padded.size + 1) + b, return_inverse=True)[1].reshape(a.shape).astype(np.int64)
        depth *= 2
    o = np.arange(spans)
    r, o = ((o >= low[:, None]) & (o <= high[:, None])).nonzero()
    tree = np.unique(group, return_inverse=True)[1][r] * np.int64(spans) + o
    order = np.lexsort([*(names[top][r, o + top * p] for p in range(pieces - 1, -1, -1)), tree])
    x, y = order[:-1], order[1:]  # neighbours in the order of leaves
    deep = np.zeros(len(x), np.int64)  # words that they share
    alive = tree[x] == tree[y]
    for p in range(pieces):
        at = np.flatnonzero(alive)
        alive[at] = names[top][r[x[at]], o[x[at]] + top * p] == names[top][r[y[at]], o[y[at]] + top * p]
        deep[at] += np.where(alive[at], top, 0)
        rest, step = at[~alive[at]], top // 2
        while step:  # where the run differs: how far it is equal
            u, v = x[rest], y[rest]
            same = names[step][r[u], o[u] + deep[rest]] == names[step][r[v], o[v] + deep[rest]]
            deep[rest] += np.where(same, step, 0)
            step //= 2
    deep = np.minimum(deep, np.minimum(end[r[x]] - o[x], end[r[y]] - o[y]))
    leaf = np.zeros(len(r), np.int64)
    np.maximum.at(leaf, x, deep)
    np.maximum.at(leaf, y, deep)
    begin, stop = np.full(rows, width, np.int64), np.zeros(rows, np.int64)
    hit = leaf >= window
    np.minimum.at(begin, r[hit], o[hit])
    np.maximum.at(stop, r[hit], (o + leaf)[hit])
    return np.minimum(begin, stop), stop


_FOUND = "g long, around long, a long, b long, pos int, lo int, hi int"


def _found(g: np.ndarray, around: np.ndarray, a: pa.Array, b: pa.Array, *ints: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(g.view(np.int64)), pa.array(around.view(np.int64)), a, b, *(pa.array(x.astype(np.int32)) for x in ints)]
    return pa.RecordBatch.from_arrays(columns, ["g", "around", "a", "b", "pos", "lo", "hi"])


def _all_around(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, reach: int) -> np.ndarray:
    """Hash of the words of all windows at offsets lo to hi around positions `at` in texts from first to last."""
    low, high = np.maximum(at - reach + lo, first), np.minimum(at - reach + hi + window, last)
    return run_hashes(h, low, high, _CONTEXT) ^ mix((at - low).astype(np.uint64))


def suffix_places(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(g, around, a, b, pos, lo, hi) for every anchor of every text: it stands for the windows at all offsets, from lo to hi."""
    reach = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for rb in batches:
            z = rb.column(2).to_pylist()
            for i, j in chunks(z, lambda t: 3 * len(t)):  # whole texts
                w = split_words([unpack(t) for t in z[i:j]])
                at, g = _anchors(w.hash, w.first, window, k)
                doc = np.searchsorted(w.first, at, "right") - 1
                row, lo = pa.array(doc + i), np.zeros(len(at), np.int64)
                around = _all_around(w.hash, at, lo, lo + reach, w.first[doc], w.first[doc + 1], window, reach)
                yield _found(g, around, rb.column(0).take(row), rb.column(1).take(row), at - w.first[doc], lo, lo + reach)

    return texts.select("a", "b", "z", "copies").mapInArrow(run, _FOUND)


def halved_places(texts: DataFrame, places: DataFrame, window: int, k: int) -> DataFrame:
    """Rows (a, b, pos, lo, hi) of large groups, grouped by more words: (g, around, a, b, pos, lo, hi), one for each half of offsets."""
    reach = window - k
    listed = places.groupBy("a", "b").agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for rb in batches:
            for c in range(rb.num_rows):
                h = split_words([unpack(rb.column(2)[c].as_py())]).hash
                n, own = len(h), rb.column(3)[c].values
                pos, lo, hi = (own.field(x).to_numpy().astype(np.int64) for x in ("pos", "lo", "hi"))
                mid = (lo + hi) // 2
                pos, lo, hi = np.concatenate((pos, pos)), np.concatenate((lo, mid + 1)), np.concatenate((mid, hi))
                fits = np.maximum(lo, reach - pos) <= np.minimum(hi, n - window - pos + reach)
                pos, lo, hi = pos[fits], lo[fits], hi[fits]
                none = np.zeros(len(pos), np.int64)
                core = run_hashes(h, pos - reach + hi, pos + k + lo, _CORE) ^ mix((64 * lo + hi).astype(np.uint64))
                row = pa.array(none + c)
                yield _found(core, _all_around(h, pos, lo, hi, none, none + n, window, reach), rb.column(0).take(row), rb.column(1).take(row), pos, lo, hi)

    return texts.join(listed, ["a", "b"]).select("a", "b", "z", "places", "copies").mapInArrow(run, _FOUND)


def shared_places(found: DataFrame, max_group: int) -> DataFrame | None:
    """Rows of `found` whose g occurs elsewhere: (a, b, pos, lo, hi, g, known, tree, large); None if there are none.

    known: the words all around occur elsewhere too, so every window there repeats. Of equal surroundings one goes to the tree of
    its group if that holds others (tree), or is to be split further if the group has more than max_group (large).
    """
    often = durable(found.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"))
    total = often.agg(F.sum("n")).first()[0]
    if not total:
        return None
    place = [F.col(c) for c in ("a", "b", "pos", "lo", "hi")]
    again = durable(join_counted(found, often, ["g"], "n", total, place).drop("n"))
    kinds = durable(again.groupBy("g", "around").agg(F.count("*").alias("same"), F.min(F.xxhash64(*place)).alias("mark")))
    sizes = durable(kinds.groupBy("g").agg(F.count("*").alias("kinds")))
    graded = durable(join_counted(kinds, sizes, ["g"], "kinds", sizes.agg(F.sum("kinds")).first()[0], [F.col("around")]))
    marked = join_counted(again, graded, ["g", "around"], "same", total, place)
    first = (F.xxhash64(*place) == F.col("mark")) & (F.col("kinds") > 1)
    large = F.col("kinds") > max_group
    marked = marked.select(*place, "g", (F.col("same") > 1).alias("known"), (first & ~large).alias("tree"), (first & large).alias("large"))
    return durable(marked.filter("known OR tree OR large"))


def repeated_ranges(texts: DataFrame, window: int = 35, k: int = 8, max_group: int = 20_000) -> DataFrame:
    """Texts of distinct_texts() -> (a, b, start, stop): words from start to before stop repeat; stop may lie beyond the text's end."""
    reach = window - k
    width = window + reach
    level, levels = shared_places(suffix_places(texts, window, k), max_group), []
    while level is not None:
        levels.append(level)
        large = level.filter("large")
        # each halving leaves half of the offsets: at one offset the group is one window, and no group is large
        level = None if large.isEmpty() else shared_places(halved_places(texts, large, window, k), max_group)
    if not levels:
        return texts.sparkSession.createDataFrame([], "a long, b long, start long, stop long")
    places = levels[0]
    for x in levels[1:]:
        places = places.union(x)
    listed = places.filter("tree").groupBy("a", "b").agg(F.collect_list(F.struct("pos", "lo", "hi", "g", "known")).alias("places"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for rb in batches:
            z = rb.column(2).to_pylist()
            for i, j in chunks(z, lambda t: 3 * len(t)):
                w = split_words([unpack(t) for t in z[i:j]])
                lists = rb.column(3).slice(i, j - i)
                row = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
                own = lists.flatten()
                pos, lo, hi = (own.field(x).to_numpy().astype(np.int64) for x in ("pos", "lo", "hi"))
                for c in range(0, len(row), 20_000):
                    cut = slice(c, c + 20_000)
                    r, p = row[cut], pos[cut]
                    begin, last = w.first[r], w.first[r + 1]
                    low, high = np.maximum(lo[cut], reach - p), np.minimum(hi[cut], last - begin - window - p + reach)
                    index = (begin + p - reach)[:, None] + np.arange(width)
                    inside = (index >= begin[:, None]) & (index < last[:, None])
                    block = np.where(inside, w.hash[np.clip(index, 0, len(w.hash) - 1)], np.uint64(0))
                    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), len(block), [None, pa.py_buffer(np.ascontiguousarray(block).tobytes())]).cast(pa.binary())
                    end = np.minimum(width, last - begin - p + reach)
                    take, part = pa.array(i + r), own.slice(c, 20_000)
                    yield pa.RecordBatch.from_arrays([part.field("g"), data, *(pa.array(x.astype(np.int32)) for x in (low, high, end)), rb.column(0).take(take), rb.column(1).take(take), pa.array(p.astype(np.int32)), part.field("known")], ["key", "words", "low", "high", "end", "a", "b", "pos", "known"])

    suffixes = texts.join(listed, ["a", "b"]).select("a", "b", "z", "places", "copies").mapInArrow(contexts, "key long, words binary, low int, high int, end int, a long, b long, pos int, known boolean")

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole groups, in order of their keys."""
        words = np.frombuffer(b"".join(t["words"].to_pylist()), np.uint64).reshape(-1, width)
        keys, low, high, end, pos = (t[c].to_numpy().astype(np.int64) for c in ("key", "low", "high", "end", "pos"))
        begin, stop = deep_repeats(keys, words, low, high, end, window)
        news = (begin < stop) & ~t["known"].to_numpy()  # of those known to repeat wholly, nothing more is to be said
        start = pos - reach
        out = t.select(["a", "b"]).append_column("start", pa.array(start + begin)).append_column("stop", pa.array(start + stop))
        yield from out.take(pa.array(np.flatnonzero(news))).combine_chunks().to_batches()

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rb in batches:
            held.append(rb)
            if sum(len(x) for x in held) < 8000:
                continue
            t = pa.Table.from_batches(held)
            keys = t["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on: it has max_group rows at most
            if cut:
                yield from solve(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held and sum(len(x) for x in held):
            yield from solve(pa.Table.from_batches(held))

    found = suffixes.repartition("key").sortWithinPartitions("key").mapInArrow(trees, "a long, b long, start long, stop long")
    base = F.col("pos").cast("long") - reach
    sure = places.filter("known").select("a", "b", F.greatest(F.lit(0).cast("long"), base + F.col("lo")).alias("start"), (base + F.col("hi") + window).alias("stop"))
    return found.union(sure)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 8, max_group: int = 20_000, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept if asked for) for every row; spans are [first, past last] words removed."""
    rows, texts = distinct_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "doc_id")
    spans = repeated_ranges(texts, window, k, max_group).groupBy("a", "b").agg(F.collect_list(F.struct("start", "stop")).alias("hits"))
    schema = T.StructType.fromDDL("a long, b long, copies long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>" + ", kept string" * with_text)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for rb in batches:
            out: list[list] = [[] for _ in schema[3:]]
            for c, (z, copies) in enumerate(zip(rb.column(2).to_pylist(), rb.column(3).to_pylist())):
                words, hits, edges = unpack(z).split(), rb.column(4)[c].values, np.empty(0, np.int64)
                if copies > 1 and len(words) >= window:
                    edges = np.array([0, len(words)])
                elif hits is not None:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, hits.field("start").to_numpy(), 1)
                    np.add.at(step, np.minimum(hits.field("stop").to_numpy(), len(words)), -1)
                    edges = np.flatnonzero(np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0))
                pairs = edges.reshape(-1, 2).tolist()
                rest, begin = [], 0
                for a, b in pairs:
                    rest += words[begin:a]
                    begin = b
                kept = b" ".join(rest + words[begin:])
                for o, x in zip(out, [len(words), sum(b - a for a, b in pairs), hashlib.sha256(kept).hexdigest(), pairs, kept.decode("utf-8", "replace")]):
                    o.append(x)
            arrays = [pa.array(o, t) for o, t in zip(out, [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()])]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), rb.column(3), *arrays], schema.names)

    results = durable(texts.join(spans, ["a", "b"], "left").select("a", "b", "z", "copies", "hits").mapInArrow(finish, schema))
    total = results.agg(F.sum("copies")).first()[0] or 0
    return join_counted(rows, results, ["a", "b"], "copies", total, [F.monotonically_increasing_id()]).drop("a", "b", "copies")
