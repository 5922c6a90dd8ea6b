"""Paths against patterns by a segment trie: a table of edges, walked a level a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import durable

#: Keys of the trie beside literal segments: one segment of any text, all that is left, and, in paths, whatever the trie has.
ANY, REST, EVERY = "*", "**", "\x00"
_ROOT = ""


def _node(parent: Column, key: Column) -> Column:
    return F.concat(parent, F.lit("/"), key)


def trie(patterns: DataFrame, segments: str) -> tuple[DataFrame, int]:
    """(node, key, child), one row for each edge of the patterns' keys, and their greatest number of segments.

    Keys are literal segments, ANY or REST; a node is the keys that lead to it. Every edge also stands under EVERY.
    """
    steps = patterns.select(F.explode(F.transform(segments, lambda _, i: F.slice(segments, F.lit(1), i + 1))).alias("_p"))
    node = lambda keys: F.aggregate(keys, F.lit(_ROOT), _node)
    edges = steps.select(node(F.slice("_p", F.lit(1), F.size("_p") - 1)).alias("node"), F.element_at("_p", -1).alias("key"), node(F.col("_p")).alias("child"), F.size("_p").alias("_level")).distinct()
    edges = durable(edges)
    deepest = edges.agg(F.max("_level")).first()[0] or 0
    return edges.select("node", "key", "child").unionAll(edges.select("node", F.lit(EVERY).alias("key"), "child")), deepest


def ends(segments: Column) -> Column:
    """The node of a pattern with these keys."""
    return F.aggregate(segments, F.lit(_ROOT), _node)


def walk(paths: DataFrame, segments: str, edges: DataFrame, deepest: int) -> DataFrame:
    """paths with `end`: each node of the trie at which a path ends, or at which all that is left of it is taken.

    A level is one join on (node, key): a literal segment goes by its own edge and by ANY, a parameter of the path (ANY) by every
    edge. An empty segment is taken by its own edge alone.
    """
    key = lambda k: F.get(segments, F.lit(k))
    state, out = paths.withColumn("end", F.lit(_ROOT)), []
    for k in range(deepest):
        out.append(state.filter(F.size(segments) == k))
        keys = F.when(key(k) == ANY, F.array(F.lit(EVERY))).when(key(k) == "", F.array(F.lit(""))).otherwise(F.array(key(k), F.lit(ANY), F.lit(REST)))
        step = state.filter(F.size(segments) > k).withColumn("_key", F.explode(keys)).withColumnRenamed("end", "_node")
        met = step.join(edges.select(F.col("node").alias("_node"), F.col("key").alias("_key"), F.col("child").alias("end")), ["_node", "_key"]).drop("_node", "_key")
        whole = F.endswith("end", F.lit("/" + REST))
        out.append(met.filter(whole))
        state = met.filter(~whole)
    out.append(state.filter(F.size(segments) == deepest))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.distinct()
