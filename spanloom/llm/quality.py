"""Quality rules as a short-circuit cascade.

On a sample, each rule's cost per document and its rejections are measured; the
next rule is always the one that rejects most per cost of what those before it
left. Rules then run in that order, each only on the documents that none before it
rejected. A document is kept if no rule rejects it, so the order changes the cost
and never the result.

Defined cases: null and blank texts have no words and fail the base rule; all
measures are of the whole text, however long; equal rows are judged alike; of
rules that reject as much per cost the first as listed goes first; an empty table
(or sample) gives an empty table with the rules as listed; other columns, of any
name, play no part.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, gram_hashes, split_words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BLANK = " \t\n\x0b\x0c\r"


class Batch:
    """Measures of some texts; those over single bytes and words are made for all at once, the others row by row on demand."""

    def __init__(self, texts: list) -> None:
        self.texts = [t or "" for t in texts]
        self.w = split_words(texts)
        self._lines: dict[int, tuple[int, int, int, int]] = {}
        self._pairs: dict[int, int] = {}
        self._repeats: dict[int, int] = {}

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self._at[1:]] - total[self._at[:-1]]

    @cached_property
    def _at(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in self.texts]))).astype(np.int64)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.w.first)

    @cached_property
    def chars(self) -> np.ndarray:
        """Characters of each word."""
        begins = np.concatenate(([0], np.cumsum((self.w.buf & 0xC0) != 0x80)))
        return begins[self.w.end] - begins[self.w.start]

    @cached_property
    def word_chars(self) -> np.ndarray:
        chars = np.concatenate(([0], np.cumsum(self.chars)))
        return chars[self.w.first[1:]] - chars[self.w.first[:-1]]

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per_text(_SYMBOL[self.w.buf])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._per_text((self.w.buf >= 65) & (self.w.buf <= 90))

    @cached_property
    def n_letters(self) -> np.ndarray:
        low = self.w.buf | 32
        return self._per_text((low >= 97) & (low <= 122))

    def lines(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines with a word, those equal to an earlier one, those that begin with a bullet, and those that end in an ellipsis."""
        for k in rows.tolist():
            if k not in self._lines:
                own = [(x, y) for x in self.texts[k].split("\n") if (y := x.strip(_BLANK))]
                self._lines[k] = len(own), len(own) - len({x for x, _ in own}), sum(y[0] in "-*•" for _, y in own), sum(y.endswith(("...", "…")) for _, y in own)
        return tuple(np.array([self._lines[k] for k in rows.tolist()], np.int64).reshape(-1, 4).T)

    def paragraphs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts between empty lines that have a word, and those equal to an earlier one."""
        found = []
        for k in rows.tolist():
            own = [x for x in self.texts[k].split("\n\n") if x.strip(_BLANK)]
            found.append((len(own), len(own) - len(set(own))))
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    def top_pair(self, rows: np.ndarray) -> np.ndarray:
        """Characters in all places of the pair of neighbouring words that takes most of the text, where one comes twice."""
        for k in rows.tolist():
            if k not in self._pairs:
                own = self.w.of(k)
                g, chars = gram_hashes(self.w.hash[own], 2), self.chars[own]
                _, at, n = np.unique(g, return_index=True, return_counts=True)
                self._pairs[k] = int((n * (chars[at] + chars[at + 1]))[n > 1].max(initial=0)) if len(g) else 0
        return np.array([self._pairs[k] for k in rows.tolist()], np.int64)

    def n_repeat_words(self, rows: np.ndarray, window: int = 3) -> np.ndarray:
        """Words in windows of three words that the text has twice or more."""
        for k in rows.tolist():
            if k not in self._repeats:
                g = gram_hashes(self.w.hash[self.w.of(k)], window)
                cover = np.zeros(len(g) + window, np.int8)
                if len(g):
                    order = np.argsort(g, kind="stable")
                    same = g[order[1:]] == g[order[:-1]]
                    hit = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
                    for i in range(window):
                        cover[hit + i] = 1
                self._repeats[k] = int(cover.sum())
        return np.array([self._repeats[k] for k in rows.tolist()], np.int64)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Batch, np.ndarray], np.ndarray]  # of the batch and the rows to judge


def base_failed(b: Batch, rows: np.ndarray) -> np.ndarray:
    """Under 50 words, or over half of the words in repeated windows."""
    n = b.n_words[rows]
    return (n < 50) | (100 * b.n_repeat_words(rows) > 50 * n)


BASE = Rule("base", base_failed)
RULES: tuple[Rule, ...] = (
    BASE,
    Rule("symbols", lambda b, r: 10 * b.n_symbols[r] > b.n_words[r]),
    Rule("word_length", lambda b, r: (b.word_chars[r] > 15 * b.n_words[r]) | (b.word_chars[r] < 2 * b.n_words[r])),
    Rule("capitals", lambda b, r: 10 * b.n_upper[r] > 4 * b.n_letters[r]),
    Rule("repeated_lines", lambda b, r: (lambda n, same, *_: 2 * same > n)(*b.lines(r))),
    Rule("bullets", lambda b, r: (lambda n, _same, bullets, _end: 10 * bullets > 9 * n)(*b.lines(r))),
    Rule("ellipses", lambda b, r: (lambda n, _same, _bullets, end: 10 * end > 3 * n)(*b.lines(r))),
    Rule("repeated_paragraphs", lambda b, r: (lambda n, same: 2 * same > n)(*b.paragraphs(r))),
    Rule("top_pair", lambda b, r: 5 * b.top_pair(r) > b.word_chars[r]),
)


def order_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 1000, sample_chars: int = 100_000, seed: int = 7) -> list[Rule]:
    """The rules, each the one that rejects most per second of what those before it left of a sample.

    The sample is of about `sample_rows` rows, none of over `sample_chars` characters.
    """
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).sample(min(1.0, 1.5 * sample_rows / total), seed).filter(F.length("text") <= sample_chars).limit(sample_rows)
    texts = [r.text for r in sample.toLocalIterator()]
    if not texts:
        return list(rules)
    seconds, rejected = dict.fromkeys(rules, 1e-9), {r: np.zeros(len(texts), bool) for r in rules}
    for i, j in chunks(texts, lambda t: len(t or "")):
        for rule in rules:
            fresh = Batch(texts[i:j])  # so that no rule gains from what another has measured
            began = time.perf_counter()
            rejected[rule][i:j] = rule.rejects(fresh, np.arange(j - i))
            seconds[rule] += time.perf_counter() - began
    left, out = np.ones(len(texts), bool), []
    while len(out) < len(rules):
        best = max((r for r in rules if r not in out), key=lambda r: int((rejected[r] & left).sum()) / seconds[r])
        out.append(best)
        left &= ~rejected[best]
    return out


def cascade(batch: Batch, rules: Sequence[Rule]) -> np.ndarray:
    """kept, by rules in turn on what is still alive."""
    alive = np.arange(len(batch.texts))
    for rule in rules:
        if not len(alive):
            break
        alive = alive[~rule.rejects(batch, alive)]
    kept = np.zeros(len(batch.texts), bool)
    kept[alive] = True
    return kept


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, measures: bool = True, sample_rows: int = 1000) -> DataFrame:
    """(doc_id, kept) for every row and, if asked for, the base measures, which are then made for rejected rows too."""
    rules = order_rules(docs, text_col, rules, sample_rows)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if measures else []
    fields += [T.StructField(n, T.LongType()) for n in names]
    fields += [T.StructField(n, T.BooleanType()) for n in [*["base_failed"] * measures, "kept"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = rb.column(1).to_pylist()
            for i, j in chunks(texts, lambda t: len(t or "")):
                b = Batch(texts[i:j])
                columns = [rb.column(0).slice(i, j - i)]
                kept, rows = cascade(b, rules), np.arange(j - i)
                if measures:
                    columns += [pa.array(x.astype(np.int64)) for x in (b.n_words, b.word_chars, b.n_symbols, b.lines(rows)[1], b.n_repeat_words(rows))] + [pa.array(base_failed(b, rows))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept)], [f.name for f in fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, T.StructType(fields))
