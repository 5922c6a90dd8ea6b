"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent letter n-grams (one to three letters,
word ends marked) over all labelled texts, counted by one distributed
aggregation. A document's own most frequent n-grams are compared to each profile
by out-of-place distance: the sum of rank differences, `top` for an n-gram that
the profile lacks.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so
is every text where no label was learned. Equal distances go to the language
first in code-point order, equal counts to the n-gram first in code-point order.
Very long texts are counted whole; equal rows are judged alike, and each counts in
a profile; an empty table gives an empty table. Other columns of the input play no
part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

UNDETERMINED = "und"
_SEP = 0x20
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngram_counts(texts: list, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, count), in order of group and n-gram; an n-gram is its code points, 21 bits each, from the left."""
    parts = [" " + t.lower() for t in texts]
    cp = np.frombuffer(("".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[-1] = True
    owner = np.repeat(group, [len(p) for p in parts])
    owner = np.concatenate((owner, owner[-1:] if len(owner) else [0]))[keep]
    y = np.where(letter, cp, _SEP)[keep]
    seen = np.zeros(0x110000, bool)
    seen[y] = True
    alphabet = np.flatnonzero(seen)
    bits = int(len(alphabet)).bit_length()
    if 3 * bits + int(group.max(initial=0)).bit_length() > 63:
        if len(texts) == 1:
            g, gram, n = ngram_counts(texts, np.zeros(1, np.int64))
            return np.full(len(g), group[0]), gram, n
        half = len(texts) // 2
        both = [ngram_counts(texts[a:b], group[a:b]) for a, b in ((0, half), (half, len(texts)))]
        g, gram, n = (np.concatenate(x) for x in zip(*both))
        order = np.lexsort((gram, g))
        g, gram, n = g[order], gram[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (gram[1:] != gram[:-1]))))
        return g[new], gram[new], np.add.reduceat(n, new)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    z, inside, high = number[y], y != _SEP, owner.astype(np.int64) << (3 * bits)
    one = high | z << (2 * bits)
    two = one[:-1] | z[1:] << bits
    codes = np.concatenate((one[inside], two[inside[:-1] | inside[1:]], (two[:-1] | z[2:])[inside[1:-1]]))
    codes.sort()
    new = np.flatnonzero(np.concatenate(([len(codes) > 0], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    n = np.diff(np.concatenate((new, [len(codes)])))
    codes = codes[new]
    mask = (1 << bits) - 1
    back = np.concatenate(([0], alphabet)).astype(np.int64)
    gram = back[codes >> 2 * bits & mask] << 42 | back[codes >> bits & mask] << 21 | back[codes & mask]
    return codes >> 3 * bits, gram, n


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 300) -> DataFrame:
    """(lang, gram, rank from 0) from all rows with a text and a label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            gram, n = (np.concatenate(x) for x in zip(*parts))
            unique, at = np.unique(gram, return_inverse=True)
            return unique, np.bincount(at, n).astype(np.int64)

        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in chunks(texts, len):
                names = sorted(set(langs[i:j]))
                at = np.array([names.index(x) for x in langs[i:j]], np.int64)
                order = np.argsort(at, kind="stable")
                g, gram, n = ngram_counts([texts[i + k] for k in order], at[order])
                for k, name in enumerate(names):
                    own = slice(*np.searchsorted(g, (k, k + 1)))
                    parts = held.setdefault(name, [])
                    parts.append((gram[own], n[own]))
                    if len(parts) > 16:
                        held[name] = [merged(parts)]
        for name, parts in held.items():
            gram, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counts = labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).filter(F.col("rank") < top).select("lang", "gram", "rank")


def _scorer(profiles: dict[str, dict[int, int]], top: int) -> Callable[[list], tuple[list, np.ndarray]]:
    names = sorted(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    ranks = np.array([[p.get(int(g), -1) for g in known] + [-1] for p in (profiles[x] for x in names)], np.int64).reshape(len(names), len(known) + 1)

    def score(texts: list) -> tuple[list, np.ndarray]:
        lang, value = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not names or not texts:
            return lang, value
        doc, gram, n = ngram_counts([t or "" for t in texts], np.arange(len(texts)))
        order = np.argsort(doc << 40 | ((1 << 40) - 1 - n), kind="stable")
        doc, gram = doc[order], gram[order]
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        place = np.arange(len(doc)) - first[doc]
        use = place < top
        doc, gram, place = doc[use], gram[use], place[use]
        at = np.searchsorted(known, gram)
        at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == gram), at, len(known))
        count = np.bincount(doc, minlength=len(texts))
        far = np.empty((len(names), len(texts)))
        for k in range(len(names)):
            r = ranks[k][at]
            far[k] = np.bincount(doc, np.where(r < 0, top, np.minimum(np.abs(r - place), top)), minlength=len(texts))
        best = far.argmin(0)
        for k in np.flatnonzero(count):
            lang[k] = names[best[k]]
            value[k] = 1 - far[best[k], k] / (count[k] * top)
        return lang, value

    return score


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", top: int = 300, max_languages: int = 1000, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of docs with lang_pred and score, under the names in `out`; input columns of those names are replaced. At most `max_languages` profiles of `top` n-grams go to every task."""
    learned: dict[str, dict[int, int]] = {}
    for r in profiles.limit(max_languages * top + 1).collect():
        learned.setdefault(r.lang, {})[r.gram] = r["rank"]
    if len(learned) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    docs = docs.drop(*out)
    text_at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(learned, top)
        for b in batches:
            texts = b.column(text_at).to_pylist()
            parts = [score(texts[i:j]) for i, j in chunks(texts, lambda t: len(t or ""))]
            found = pa.array([x for p in parts for x in p[0]], pa.string()), pa.array(np.concatenate([p[1] for p in parts] or [np.empty(0)]))
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *out])

    return docs.mapInArrow(predict, T.StructType([*docs.schema, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())]))
