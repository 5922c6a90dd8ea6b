"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are dealt over shards of bounded size. A shard's index has, for each
term, the documents that hold it with their impacts (what the term adds to the
score), and the greatest impact in each block of 128 documents; for pairs of terms
that queries hold together it has an intersection list: the blocks where both
stand in one document, with the greatest sum of their impacts in one. A query's
terms are matched into disjoint pairs; a pair can add no more than the greatest
of its terms alone and of its joint impact, so bounds are tighter than the sum of
the terms' own. Blocks whose bound is under the score to beat are skipped, as are
documents that hold only terms whose bounds together stay under it. The score to
beat is the k-th best so far: that of a few shards searched first (any documents
give a valid one), then that of the shard itself. Results are exact.

Defined cases: null texts and those without a term are not found and not counted;
equal rows of documents are ranked one by one; equal rows of queries are one
query, and rows with one id and different texts are queries of their own; equal
scores go by rising id, null ids last; queries without a term, an empty table of
documents or of queries give no row; whole texts are read, however long; other
columns, of any name, play no part. Terms are known by 64-bit hashes. Counts over
64 bits raise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, durable, split_words

#: All of ASCII but letters and digits stands between terms.
_APART = np.zeros(256, bool)
_APART[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

BLOCK = 128
#: Postings of a shard, on average; shards searched first for scores to beat; queries and their characters held at once.
SHARD_POSTINGS, FIRST_SHARDS = 500_000, 6
MAX_QUERIES, MAX_CHARS = 20_000, 64_000_000
#: Pairs of a query come from so many of its rarest terms; pairs of all queries that have intersection lists. Only bounds depend on them.
PAIR_TERMS, MAX_PAIRS = 10, 20_000


@dataclass
class Queries:
    """Queries and the different terms of all: hashes in order; each query's terms by their place there."""

    ids: list
    terms: np.ndarray
    of: list[np.ndarray]


def parse(rows: list[tuple]) -> Queries:
    w = split_words([t or "" for _, t in rows], lower=True, apart=_APART)
    terms = np.unique(w.hash)
    of = [np.unique(np.searchsorted(terms, w.hash[w.of(i)])) for i in range(len(rows))]
    return Queries([i for i, _ in rows], terms, of)


def pairs_of(queries: Queries, weight: np.ndarray, pair_terms: int = PAIR_TERMS, most: int = MAX_PAIRS) -> np.ndarray:
    """(a, b) for pairs among the weightiest terms of each query, those of most queries first."""
    seen: Counter = Counter()
    for own in queries.of:
        rare = np.sort(own[np.argsort(-weight[own], kind="stable")[:pair_terms]])
        seen.update(combinations(rare.tolist(), 2))
    return np.array([p for p, _ in seen.most_common(most)], np.int64).reshape(-1, 2)


@dataclass
class Shard:
    """One shard's index: postings, block maxima and pairs' intersection lists, each list as ranges of flat arrays."""

    term: np.ndarray  # terms that stand in it
    at: np.ndarray  # where each term's postings begin
    doc: np.ndarray
    impact: np.ndarray
    block_at: np.ndarray  # where each term's blocks begin
    block: np.ndarray
    block_from: np.ndarray  # where each block's postings begin
    block_max: np.ndarray
    pair: np.ndarray  # a and b of each pair, one after the other
    pair_at: np.ndarray
    pair_block: np.ndarray
    pair_max: np.ndarray
    nth: np.ndarray  # each document's place by rising id

    @classmethod
    def names(cls) -> list[str]:
        return list(cls.__dataclass_fields__)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All of begin[0]..end[0]-1, begin[1]..end[1]-1 and so on."""
    n = end - begin
    return np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def build(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, nth: np.ndarray, pairs: np.ndarray) -> Shard:
    """The index of postings (doc, term, impact) of documents 0 to len(nth) - 1."""
    order = np.lexsort((doc, term))
    doc, term, impact = doc[order], term[order], impact[order]
    terms, at = np.unique(term, return_index=True)
    at = np.append(at, len(doc))
    n_blocks = len(nth) // BLOCK + 1
    keys, start = np.unique(term * n_blocks + doc // BLOCK, return_index=True)
    block_max = np.maximum.reduceat(impact, start) if len(start) else impact
    block_at = np.searchsorted(keys, np.append(terms * n_blocks, np.iinfo(np.int64).max))
    place = np.searchsorted(terms, pairs)
    here = ((place < len(terms)) & (terms[np.minimum(place, len(terms) - 1)] == pairs)).all(1) if len(terms) else np.zeros(len(pairs), bool)
    lists = []
    for a, b in place[here]:
        x, y = slice(at[a], at[a + 1]), slice(at[b], at[b + 1])
        both, i, j = np.intersect1d(doc[x], doc[y], assume_unique=True, return_indices=True)
        blocks, first = np.unique(both // BLOCK, return_index=True)
        lists.append((blocks, np.maximum.reduceat(impact[x][i] + impact[y][j], first) if len(first) else blocks))
    pair_at = np.concatenate(([0], np.cumsum([len(b) for b, _ in lists]))).astype(np.int64)
    flat = lambda k: np.concatenate([x[k] for x in lists]) if lists else np.empty(0, np.int64)
    return Shard(terms, at, doc, impact, block_at, keys % n_blocks, np.append(start, len(doc)), block_max, pairs[here].ravel(), pair_at, flat(0), flat(1), nth)


class Searcher:
    """Searches one shard; `scored` counts the postings that were looked at."""

    def __init__(self, shard: Shard):
        self.s, self.scored = shard, 0
        self.n_blocks = len(shard.nth) // BLOCK + 1
        self.most = np.maximum.reduceat(shard.block_max, shard.block_at[:-1]) if len(shard.term) else np.empty(0, np.int64)
        self.pairs = {(a, b): k for k, (a, b) in enumerate(shard.pair.reshape(-1, 2).tolist())}
        self.score = np.zeros(len(shard.nth), np.int64)
        self.touched = np.zeros(len(shard.nth), bool)

    def _dense(self, at: np.ndarray, k: int, block: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_blocks, np.int64)
        out[block[at[k] : at[k + 1]]] = most[at[k] : at[k + 1]]
        return out

    def _matched(self, own: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(i, j, pair, saved) for disjoint pairs of the query's terms, those that lower its bound most first."""
        s, found = self.s, []
        terms = s.term[own].tolist()
        for i, j in combinations(range(len(own)), 2):
            k = self.pairs.get((terms[i], terms[j]))
            if k is not None:
                x, y = int(self.most[own[i]]), int(self.most[own[j]])
                joint = int(s.pair_max[s.pair_at[k] : s.pair_at[k + 1]].max(initial=0))
                found.append((x + y - max(x, y, joint), i, j, k))
        free, out = set(range(len(own))), []
        for saved, i, j, k in sorted(found, reverse=True):
            if saved > 0 and i in free and j in free:
                free -= {i, j}
                out.append((i, j, k, saved))
        return out

    def find(self, terms: np.ndarray, k: int, beat: int = 1, use_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents and scores of a query, or all that score `beat` or more, if fewer: best first, ties by `nth`."""
        s = self.s
        own = np.searchsorted(s.term, terms)
        own = own[(own < len(s.term)) & (s.term[np.minimum(own, len(s.term) - 1)] == terms)] if len(s.term) else own[:0]
        docs, scores, beat = np.empty(0, np.int64), np.empty(0, np.int64), max(1, beat)
        if not len(own):
            return docs, scores
        block_max = np.array([self._dense(s.block_at, t, s.block, s.block_max) for t in own])
        bound, pairs = block_max.sum(0), self._matched(own) if use_pairs else []
        for i, j, p, _ in pairs:
            joint = self._dense(s.pair_at, p, s.pair_block, s.pair_max)
            bound -= block_max[i] + block_max[j] - np.maximum(np.maximum(block_max[i], block_max[j]), joint)
        # the sum of the bounds of the terms up to each one, by rising maxima
        rising = np.argsort(self.most[own], kind="stable")
        place = np.empty(len(own), np.int64)
        place[rising] = np.arange(len(own))
        upto = np.cumsum(self.most[own][rising])
        for i, j, _, saved in pairs:
            upto[max(place[i], place[j]) :] -= saved
        blocks, width = np.argsort(-bound, kind="stable"), 8
        while True:
            blocks = blocks[bound[blocks] >= beat]
            if not len(blocks):
                return docs, scores
            d, v = self._score(own[rising], upto, np.sort(blocks[:width]), beat)
            docs, scores = np.concatenate((docs, d)), np.concatenate((scores, v))
            best = np.lexsort((s.nth[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(scores) == k:
                beat = max(beat, int(scores[-1]))
            blocks, width = blocks[width:], width * 4

    def _score(self, own: np.ndarray, upto: np.ndarray, blocks: np.ndarray, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of these blocks that score `beat` or more, and their scores."""
        s, wanted = self.s, np.zeros(self.n_blocks, bool)
        wanted[blocks] = True
        idle = int(np.searchsorted(np.maximum.accumulate(upto), beat))  # the terms before this one can't reach `beat` together
        for t in own[idle:]:
            span = np.arange(s.block_at[t], s.block_at[t + 1])
            span = span[wanted[s.block[span]]]
            p = _ranges(s.block_from[span], s.block_from[span + 1])
            self.score[s.doc[p]] += s.impact[p]
            self.touched[s.doc[p]] = True
            self.scored += len(p)
        lo, hi = blocks * BLOCK, np.minimum((blocks + 1) * BLOCK, len(self.touched))
        rows = _ranges(lo, np.maximum(lo, hi))
        all_of = found = rows[self.touched[rows]]
        for k in range(idle - 1, -1, -1):
            found = found[self.score[found] + upto[k] >= beat]
            t = own[k]
            docs = s.doc[s.at[t] : s.at[t + 1]]
            at = np.searchsorted(docs, found)
            hit = (at < len(docs)) & (docs[np.minimum(at, len(docs) - 1)] == found)
            self.score[found[hit]] += s.impact[s.at[t] + at[hit]]
            self.scored += int(hit.sum())
        found = found[self.score[found] >= beat]
        scores = self.score[found]
        self.score[all_of] = 0
        self.touched[all_of] = False
        return found, scores


def _forward(docs: DataFrame, terms, id_type: T.DataType) -> DataFrame:
    """(doc_id, n, terms, tfs, row) for each document of (doc_id, text): its number of terms, and those of `terms` with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for rb in batches:
            texts = rb.column(1).to_pylist()
            for lo, hi in chunks(texts, lambda t: len(t or b"")):
                w = split_words(texts[lo:hi], lower=True, apart=_APART)
                n = np.diff(w.first)
                at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                hit = known[at] == w.hash
                keys, tf = np.unique(np.repeat(np.arange(hi - lo), n)[hit] * len(known) + at[hit], return_counts=True)
                cut = np.searchsorted(keys, np.arange(hi - lo + 1) * len(known))
                term, tf = (keys % len(known)).astype(np.uint32), tf.astype(np.uint32)
                cells = [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *cells], ["doc_id", "n", "terms", "tfs"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("tfs", T.BinaryType())])
    return durable(docs.mapInArrow(count, schema).withColumn("row", F.monotonically_increasing_id()))


def _weights(forward: DataFrame, n_terms: int, n_docs: int) -> np.ndarray:
    """Each term's weight by the number of documents that hold it; one row a term reaches the driver."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for rb in batches:
            df += np.bincount(np.frombuffer(b"".join(rb.column(0).to_pylist()), np.uint32), minlength=n_terms)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    df = forward.select("terms").mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    found, out = df.select("term", weight.alias("w")).toArrow(), np.zeros(n_terms, np.int64)
    out[found["term"].to_numpy()] = found["w"].to_numpy()
    return out


def _indexes(forward: DataFrame, shards: int, n_docs: int, n_terms_all: int, weights, pairs, id_type: T.DataType) -> DataFrame:
    """(shard, doc_id array, index arrays) for each shard of the documents that hold a term of a query."""

    def make(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("m", "ascending"), ("row", "ascending")]))  # like lengths in one block: bounds are closer
        terms, tfs = rows["terms"].to_pylist(), rows["tfs"].to_pylist()
        term, tf = (np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in (terms, tfs))
        doc = np.repeat(np.arange(len(terms)), [len(x) // 4 for x in terms])
        m = rows["m"].to_numpy()[doc]
        impact = weights.value[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        nth = np.empty(len(terms), np.int64)
        nth[pc.sort_indices(rows, [("doc_id", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(terms))
        made = build(doc, term, impact, nth, pairs.value)
        ids = rows["doc_id"].combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.table({"shard": rows["shard"].slice(0, 1), "doc_id": ids, **{x: pa.array([np.ascontiguousarray(getattr(made, x), np.int64).tobytes()], pa.binary()) for x in Shard.names()}})

    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("doc_id", T.ArrayType(id_type)), *[T.StructField(x, T.BinaryType()) for x in Shard.names()]])
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {n_terms_all}L")
    rows = forward.filter(F.octet_length("terms") > 0).select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "doc_id", m.alias("m"), "terms", "tfs")
    return rows.groupBy("shard").applyInArrow(make, schema)


def _find(indexes: DataFrame, queries, beat: np.ndarray, k: int, id_type: T.DataType, query_type: T.DataType) -> DataFrame:
    """(query, item_id, doc_id, score) for what each shard finds."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        for rb in batches:
            for i in range(rb.num_rows):
                row = rb.slice(i, 1)
                searcher = Searcher(Shard(*(np.frombuffer(row.column(x)[0].as_buffer(), np.int64) for x in Shard.names())))
                ids, number, docs, scores = row.column("doc_id").flatten(), [], [], []
                for j, terms in enumerate(q.of):
                    d, v = searcher.find(terms, k, int(beat[j]))
                    number.append(np.full(len(d), j))
                    docs.append(d)
                    scores.append(v)
                number, docs, scores = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (number, docs, scores))
                items = pa.array([q.ids[j] for j in number.tolist()], out_type)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), items, ids.take(pa.array(docs)), pa.array(scores)], ["query", "item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    out_type = to_arrow_type(query_type)
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("item_id", query_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    return indexes.mapInArrow(look, schema)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, text_col: str = "text", id_col: str = "doc_id", query_col: str = "text", query_id: str = "item_id", shard_postings: int = SHARD_POSTINGS, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query by its terms' impacts, exactly.

    At most `max_queries` queries are held at a time; more take several passes over the documents.
    """
    spark = docs.sparkSession
    id_type, query_type = docs.schema[id_col].dataType, queries.schema[query_id].dataType
    docs = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("string").cast("binary").alias("text"))
    queries = queries.select(queries[f"`{query_id}`"].alias("item_id"), queries[f"`{query_col}`"].cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-size["n"] // max_queries), -(-size["chars"] // MAX_CHARS))
    found = [_pass(docs, queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p), k, shard_postings, id_type, query_type) for p in range(passes)]
    found = [f for f in found if f is not None]
    schema = T.StructType([T.StructField("item_id", query_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def _pass(docs: DataFrame, queries: DataFrame, k: int, shard_postings: int, id_type: T.DataType, query_type: T.DataType) -> DataFrame | None:
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    q = parse(sorted(((r["item_id"], r["text"]) for r in queries.collect()), key=repr))
    if not len(q.terms):
        return None
    forward = _forward(docs, share(q.terms), id_type)
    n = forward.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.octet_length("terms")), F.lit(0)).alias("bytes")).first()
    if not n["bytes"]:
        return None
    weight = _weights(forward, len(q.terms), n["docs"])
    shards = 1 + n["bytes"] // 4 // shard_postings
    indexes = lambda rows: _indexes(rows, shards, n["docs"], n["terms"], share(weight), share(pairs_of(q, weight)), id_type)
    queries_at, beat = share(q), np.ones(len(q.ids), np.int64)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = lambda rows: rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    number = F.pmod(F.xxhash64("row"), F.lit(shards))
    if shards <= FIRST_SHARDS:
        found = _find(indexes(forward), queries_at, beat, k, id_type, query_type)
    else:
        first = durable(best(_find(indexes(forward.filter(number < FIRST_SHARDS)), queries_at, beat, k, id_type, query_type)).drop("rank"))
        for r in best(first).filter(F.col("rank") == k).select("query", "score").collect():  # one row a query
            beat[r["query"]] = r["score"]
        found = first.unionAll(_find(indexes(forward.filter(number >= FIRST_SHARDS)), queries_at, beat, k, id_type, query_type))
    return best(found).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
