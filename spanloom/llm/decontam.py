"""Benchmark decontamination: windows as long as a benchmark item, by SimHash, verified by weighted shingle similarity.

For each item of m words, every window of m words of a document could hold it. A window whose shingles reach the wanted similarity
has at least a known number of the items' shingles, so only such windows are fingerprinted. Fingerprints of windows find those of
items by a multi-index: the 64 bits are cut into blocks, and each block has a table from its value to the items that hold it. Two
fingerprints within the radius agree in some block up to its share of the radius (radius // blocks bits in the first blocks, one
bit less in those beyond radius % blocks), so looking up each window's block values, and all values within the share, finds every
item within the radius; others found so are left by their distance. What remains is verified: sum of minima over sum of maxima of
the shingles' counts.

The benchmark goes to every task in passes of at most `max_items` items and about `max_words` words each; with more than one pass,
each pass's result is written before the next pass's index is made. Documents are never shuffled.

Defined cases: words are lower-cased (A-Z); items of fewer words than a shingle are one shingle; null and blank items and texts
match nothing; a document with fewer words than an item is one window; equal rows are reported each; of equally similar windows
the first is reported; an empty table on either side gives none; whole texts are searched, however long; only the id and
text columns are read for the search, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, durable, gram_hashes, split_words, word_count


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def _pack(ones: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(2 * ones > n, axis=-1, bitorder="little")).view(np.uint64).reshape(-1)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the counts of two bags of hashes."""
    values, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


def flips(width: int, most: int) -> np.ndarray:
    """All values of `width` bits with at most `most` bits set."""
    return np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)], np.int64)


class MultiIndex:
    """Fingerprints of several kinds by the values of their blocks: finds all of a kind within a radius."""

    def __init__(self, fps: np.ndarray, kind: np.ndarray, radius: int, blocks: int) -> None:
        self.fps, self.kind, self.radius, self.width = fps, kind, radius, 64 // blocks
        if self.width > 16:
            raise ValueError("a block is a table of all its values: take 4 blocks or more")
        self.tables = []
        masks: dict[int, np.ndarray] = {}
        for b in range(blocks):
            share = radius // blocks - (b > radius % blocks)
            value = self.block(fps, b)
            order = np.argsort(value, kind="stable").astype(np.int32)
            first = np.searchsorted(value[order], np.arange((1 << self.width) + 1)).astype(np.int32)
            if share >= 0:
                self.tables.append((b, order, first, masks.setdefault(share, flips(self.width, share))))

    def block(self, fps: np.ndarray, b: int) -> np.ndarray:
        return (fps >> np.uint64(b * self.width) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def near(self, fps: np.ndarray, kind: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(place in fps, item) of this kind within the radius, by place and item; `step` fingerprints are looked up at a time."""
        found = [np.empty(0, np.int64)]
        for c in range(0, len(fps), step):
            part = fps[c : c + step]
            seen = [np.empty(0, np.int64)]
            for b, order, first, masks in self.tables:
                value = (self.block(part, b)[:, None] ^ masks).ravel()
                begin, n = first[value], first[value + 1] - first[value]
                held = np.flatnonzero(n)
                begin, n = begin[held].astype(np.int64), n[held].astype(np.int64)
                at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
                row, item = np.repeat(held // len(masks), n), order[at]
                mine = self.kind[item] == kind
                row, item = row[mine], item[mine]
                close = np.bitwise_count(part[row] ^ self.fps[item]) <= self.radius
                seen.append((c + row[close]) * len(self.fps) + item[close])
            found.append(np.unique(np.concatenate(seen)))
        return np.divmod(np.concatenate(found), max(1, len(self.fps)))


class Index:
    """Items by length: their shingles and fingerprints, and over all of them which shingles they hold."""

    def __init__(self, items: list[tuple], shingle_words: int, similarity: float, radius: int, blocks: int) -> None:
        self.similarity = similarity
        self.names, self.shingles, length, fps = [], [], [], []
        w = split_words([t for _, t in items], lower=True)
        for k, (name, _) in enumerate(items):
            h = w.hash[w.of(k)]
            if len(h):
                own = gram_hashes(h, min(shingle_words, len(h)))
                self.names.append(name)
                self.shingles.append(own)
                length.append(len(h))
                fps.append(_pack(_bits(own).sum(0), len(own))[0])
        self.prints = MultiIndex(np.array(fps, np.uint64), np.array(length, np.int64), radius, blocks)
        lengths: dict[int, dict] = {}
        for m in sorted(set(length)):
            known = np.unique(np.concatenate([s for s, n in zip(self.shingles, length) if n == m]))
            size = min(shingle_words, m)
            lengths[m] = {"size": size, "known": known, "need": self.need(m - size + 1, m - size + 1)}
        self.by_size: dict[int, tuple] = {}
        for size in {g["size"] for g in lengths.values()}:
            mine = {m: g for m, g in lengths.items() if g["size"] == size}
            known = np.unique(np.concatenate([g["known"] for g in mine.values()]))
            mask = (1 << max(16, int(16 * len(known)).bit_length())) - 1
            seen = np.zeros(mask + 1, bool)
            seen[known & np.uint64(mask)] = True
            self.by_size[size] = known, np.uint64(mask), seen, mine

    def need(self, n: int, own: int) -> int:
        """Shared shingles of n and own that make the similarity."""
        return int(np.ceil((n + own) * self.similarity / (1 + self.similarity) - 1e-9))

    def search(self, texts: list) -> Iterator[tuple[int, object, float, int, int]]:
        """(text, item, similarity, first word, number of words): the best window of each text and item."""
        w = split_words(texts, lower=True)
        for size, (known, mask, seen, mine) in self.by_size.items():
            g = gram_hashes(w.hash, size)
            at = np.flatnonzero(seen[g & mask])
            place = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
            at = at[known[place] == g[at]]
            doc = np.searchsorted(w.first, at, "right") - 1
            inside = at + size <= w.first[doc + 1]
            at, doc = at[inside], doc[inside]
            cuts = np.flatnonzero(np.concatenate((doc[1:] != doc[:-1], [True]))) + 1 if len(doc) else []
            begin = 0
            for stop in cuts:
                k, hits = int(doc[begin]), at[begin:stop] - w.first[doc[begin]]
                begin = stop
                n_words = int(w.first[k + 1] - w.first[k])
                own = g[w.first[k] : w.first[k] + n_words - size + 1]
                for m, group in mine.items():
                    if len(hits) >= group["need"] or n_words < m:
                        yield from ((k, *x) for x in self._windows(own, hits, m, group, n_words))

    def _windows(self, own: np.ndarray, hits: np.ndarray, m: int, group: dict, n_words: int, block: int = 4096) -> Iterator[tuple]:
        n = min(len(own), m - group["size"] + 1)
        need = self.need(m - group["size"] + 1, n)  # a document with fewer words than the item needs fewer
        hits = hits[np.isin(own[hits], group["known"])]
        if len(hits) < need:
            return
        # starts of windows with enough hits; a window is n shingles from its start
        inside = np.zeros(len(own) + 1, np.int64)
        inside[hits + 1] = 1
        inside = np.cumsum(inside)
        starts = np.arange(len(own) - n + 1)
        starts = starts[inside[starts + n] - inside[starts] >= need]
        best: dict[int, tuple[float, int]] = {}
        for c in range(0, len(starts), block):
            part = starts[c : c + block]
            for piece in np.split(part, np.flatnonzero(np.diff(part) > n) + 1):
                total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(own[piece[0] : piece[-1] + n]), axis=0)))
                fps = _pack(total[piece - piece[0] + n] - total[piece - piece[0]], n)
                for window, item in zip(*self.prints.near(fps, m)):
                    s = int(piece[window])
                    value = weighted_similarity(own[s : s + n], self.shingles[item])
                    if value >= self.similarity and value > best.get(int(item), (0.0, 0))[0]:
                        best[int(item)] = value, s
        for item, (value, s) in best.items():
            yield self.names[item], value, s, min(m, n_words)


def _indexes(items: DataFrame, item_id_col: str, item_text_col: str, shingle_words: int, similarity: float, radius: int, blocks: int, max_items: int, max_words: int) -> Iterator[tuple[Broadcast, bool]]:
    """(index, last one?) for each pass over the benchmark, made when it is asked for."""
    text = F.col(item_text_col).cast("string")
    listed = durable(items.select(F.col(item_id_col).alias("item_id"), text.alias("text"), word_count(text).alias("n")).filter("n > 0"))
    size = listed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    passes = max(1, -(-size[0] // max_items), -(-size[1] // max_words))
    for p in range(passes):
        own = listed.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).select("item_id", "text").collect()
        yield items.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in own], shingle_words, similarity, radius, blocks)), p == passes - 1


def _settled(df: DataFrame, index: Broadcast, last: bool) -> DataFrame:
    """df itself at the last pass; before, it is written, so that this pass's index can go."""
    if not last:
        df = durable(df)
        index.unpersist()
    return df


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, radius: int = 24, blocks: int = 4, max_items: int = 20_000, max_words: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): one row for each document and item that it holds."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema[item_id_col].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    types, names = list(to_arrow_schema(schema).types)[1:], schema.names
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index, last in _indexes(items, item_id_col, item_text_col, shingle_words, similarity, radius, blocks, max_items, max_words):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1).to_pylist()
                for i, j in chunks(texts, lambda t: len(t or "")):
                    found = list(index.value.search(texts[i:j]))
                    columns = list(zip(*found)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i + k for k in columns[0]], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], types))], names)

        part = _settled(rows.mapInArrow(run, schema), index, last)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, radius: int = 24, blocks: int = 4, max_items: int = 20_000, max_words: int = 4_000_000) -> DataFrame:
    """The rows of docs, all columns, that hold no item; each pass reads what the one before kept.

    Null and blank texts hold nothing and stay; equal rows stay or go together; empty tables: no rows, or all.
    """
    at = docs.columns.index(text_col)
    out = docs
    for index, last in _indexes(items, item_id_col, item_text_col, shingle_words, similarity, radius, blocks, max_items, max_words):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
                for i, j in chunks(texts, lambda t: len(t or "")):
                    keep[[i + k for k, *_ in index.value.search(texts[i:j])]] = False
                yield b.filter(pa.array(keep))

        out = _settled(out.mapInArrow(run, docs.schema), index, last)
    return out
