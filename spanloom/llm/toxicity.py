"""Toxicity by multiple-instance learning: documents are bags of sentences.

A document's score is the noisy-or of its sentences' scores, 1 - prod(1 - p); a
sentence's score is logistic in the weights of its words. Only documents have
labels; the gradient through the noisy-or finds the sentences that explain them,
and the same weights locate offending sentences afterwards.

The classifier is fitted on a bounded sample of labelled documents: at most
`per_class` of each label, those whose ids hash lowest, weighted back to the
labels' real shares. Its vocabulary is the `vocabulary` words that most clearly
depend on the label (log-likelihood ratio), counted by one aggregation over that
sample. Words are runs of letters, lower-cased; sentences end at . ! ? or a line
break.

Defined cases: null and wordless texts have no sentence and score 0; with no
labelled rows, or one label only, every text scores 0; documents labelled more
than once count as toxic if any label says so; null labels and ids are unlabelled;
very long texts are scored whole (the sample leaves them out); equal rows score
alike; an empty table gives an empty table; of equally offending sentences the
last is reported; other columns, of any name, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, durable, split_words

_TO_SPACE = bytes(c if c >= 128 or 97 <= c <= 122 or 65 <= c <= 90 else 32 for c in range(256))
_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".!?\n", np.uint8)] = True


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def _sentences(texts: list) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes; for each word its text, hash and sentence; the words' byte ranges."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    w = split_words([r.translate(_TO_SPACE) for r in raw])
    ends = np.cumsum(_ENDS[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)])
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    return raw, doc, w.hash, ends[w.start] if len(w.start) else w.start, w.start, w.end


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(labels: np.ndarray, importance: np.ndarray, empty: np.ndarray, sentence_doc: np.ndarray, word_sentence: np.ndarray, word: np.ndarray, size: int, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample; `empty` counts a document's sentences without vocabulary words."""
    n_docs, n_sentences = len(labels), len(sentence_doc)
    theta = np.concatenate((np.zeros(size), [-6.0]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = importance / importance.sum()
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(word_sentence, theta[word], minlength=n_sentences)
        total = np.bincount(sentence_doc, _softplus(z), minlength=n_docs) + empty * _softplus(theta[-1])
        d = scale * np.where(labels > 0, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)
        dz = d[sentence_doc] / (1 + np.exp(-z))
        grad = np.concatenate((np.bincount(word, dz[word_sentence], minlength=size), [dz.sum() + (d * empty).sum() / (1 + np.exp(-theta[-1]))]))
        grad[:-1] += l2 * theta[:-1] / size
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 10_000, vocabulary: int = 4096, sample_chars: int = 100_000) -> Model:
    """Word weights from at most per_class labelled documents of each class, none of over sample_chars characters."""
    if vocabulary > 1 << 15:
        raise ValueError("a vocabulary of at most 32,768 words")
    empty = Model(np.empty(0, np.uint64), np.empty(0), float("-inf"))
    known = durable(labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max((F.col("_y") > 0).cast("int")).alias("_y")))
    sizes = dict(known.groupBy("_y").count().collect())
    if len(sizes) < 2:
        return empty
    # from a share of the hashes that holds some more than the sample: no task sends the driver more than its part of that
    most = {y: min(2**63 - 1, int(min(1.0, 1.5 * per_class / n) * 2**64) - 2**63) for y, n in sizes.items()}
    picked = [known.filter((F.col("_y") == y) & (F.xxhash64("_id") <= most[y])).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class ids are broadcast
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter(F.coalesce(F.length("_text"), F.lit(0)) <= sample_chars).join(F.broadcast(picked[0].union(picked[1])), "_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, y = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in chunks(texts, lambda t: len(t or "")):
                _, doc, h, sentence, _, _ = _sentences(texts[i:j])
                at = np.searchsorted(doc, np.arange(j - i + 1))
                words = [h[p:q].view(np.int64) for p, q in zip(at[:-1], at[1:])]
                sentences = [sentence[p:q] - (sentence[p] if q > p else 0) for p, q in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(y[i:j], pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array([s.astype(np.int32) for s in sentences], pa.list_(pa.int32()))], ["y", "words", "sentences"])

    bag = durable(sample.select("_text", "_y").mapInArrow(bags, "y int, words array<long>, sentences array<int>"))
    n = dict(bag.groupBy("y").count().collect())
    if len(n) < 2:
        return empty
    counts = bag.select("y", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter("a + b >= 3")
    a, b, na, nb = F.col("a"), F.col("b"), float(n[1]), float(n[0])
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = 2 * (term(a, (a + b) * (na / (na + nb))) + term(b, (a + b) * (nb / (na + nb))) + term(na - a, (na + nb - a - b) * (na / (na + nb))) + term(nb - b, (na + nb - a - b) * (nb / (na + nb))))
    words = [r.word for r in counts.withColumn("ratio", ratio).filter("ratio > 10.83").orderBy(F.desc("ratio"), "word").limit(vocabulary).collect()]
    if not words:
        return empty
    known_words = np.sort(np.array(words, np.int64).view(np.uint64))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out: list[list] = [[], [], []]
            for ws, ss in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                h, s = np.array(ws, np.int64).view(np.uint64), np.array(ss, np.int64)
                at = np.minimum(np.searchsorted(known_words, h), len(known_words) - 1)
                hit = known_words[at] == h
                out[0].append(at[hit].astype(np.int16).tobytes())
                out[1].append(s[hit].astype(np.int32).tobytes())
                out[2].append(len(np.unique(s)) - len(np.unique(s[hit])))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["y", "at", "sentence", "rest"])

    # the sample's vocabulary words only, six bytes each
    rows = bag.mapInArrow(reduced, "y int, at binary, sentence binary, rest long").collect()
    y = np.array([r.y for r in rows])
    importance = np.array([sizes[k] / n[k] for k in y])
    doc = np.repeat(np.arange(len(rows)), [len(r["at"]) // 2 for r in rows])
    word = np.frombuffer(b"".join(r["at"] for r in rows), np.int16).astype(np.int64)
    sentence = np.frombuffer(b"".join(r.sentence for r in rows), np.int32)
    both, of = np.unique(doc << 32 | sentence, return_inverse=True)
    weights, bias = fit(y, importance, np.array([r.rest for r in rows]), both >> 32, of, word, len(known_words))
    return Model(known_words, weights, bias)


def score_texts(model: Model, texts: list, threshold: float = 0.3) -> tuple[np.ndarray, np.ndarray, list]:
    """(document score, number of offending sentences, text of the worst one or None)."""
    k = len(texts)
    if not len(model.words):
        return np.zeros(k), np.zeros(k, np.int64), [None] * k
    raw, doc, h, sentence, start, end = _sentences(texts)
    if not len(h):
        return np.zeros(k), np.zeros(k, np.int64), [None] * k
    new = np.concatenate(([True], (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1])))
    number = np.cumsum(new) - 1
    owner = doc[new]
    at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
    hit = model.words[at] == h
    z = model.bias + np.bincount(number[hit], model.weights[at[hit]], minlength=len(owner))
    total = np.bincount(owner, _softplus(z), minlength=k)
    bad = np.flatnonzero(z >= np.log(threshold / (1 - threshold)))
    worst: list = [None] * k
    first, last = np.flatnonzero(new), np.concatenate((np.flatnonzero(new)[1:], [len(h)])) - 1
    whole = b"\n".join(raw) if len(bad) else b""
    for s in bad[np.argsort(z[bad], kind="stable")]:
        worst[owner[s]] = whole[start[first[s]] : end[last[s]]].decode("utf-8", "replace")
    return -np.expm1(-total), np.bincount(owner[bad], minlength=k), worst


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, n_offending, worst_sentence) for every row; the sentence is lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chunks(texts, lambda t: len(t or "")):
                p, n, worst = score_texts(model, texts[i:j], threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(worst, pa.string())], ["doc_id", "score", "predicted", "n_offending", "worst_sentence"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_offending long, worst_sentence string")
