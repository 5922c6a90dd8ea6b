"""Token ids in a binary format of zstandard frames that share one trained dictionary.

Each document's ids are compressed on their own, with a dictionary trained on
serialized id arrays, so that one short document can be read without its
neighbours and still compresses well. A file holds a header (magic, width of an
id, hash of the dictionary), the frames, and an index of document ids, places of
the frames and numbers of ids; a folder holds the files, the dictionary and a
manifest that is written last. Reading checks the dictionary against the hash.
The format is a Spark data source, `token_frames`: files are written under names
of their own by each task, and only those that the commit names are ever read, so
tasks that are repeated, or run twice, leave nothing that is seen.

Defined cases: null and empty texts are documents without ids but for the end id;
rows with equal or null ids are documents of their own, in the order of the input,
null ids first; an empty table gives a folder without files, which reads as no
row; very long texts are encoded in pieces cut where no token can reach over;
strings of special tokens in a text are ordinary text; other columns, of any name,
play no part.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import chunks

MAGIC = b"TOKFRM01"
#: Ids of a dictionary's sample: documents at most, and ids of each at most; bytes of the dictionary.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 2_000, 4_096, 112_640
#: Different words whose ids a process keeps (of more, the half that came most often stays), and the longest of them.
KNOWN_WORDS, LONGEST_WORD = 600_000, 64

# --- encoding -------------------------------------------------------------------------------------------------------------------

#: A single blank between characters that are not white space: no token of a byte-level vocabulary reaches over its left side.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the blank.
_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]


def _even(text: str) -> bool:
    """Whether each blank of text stands between characters that are not white space."""
    return not (text[:1].isspace() or text[-1:].isspace() or "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in _WHITE))


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0] and n[0] - 1 numbers more, begin[1] and so on."""
    return np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


class Encoder:
    """Ids of texts by a byte-level vocabulary file; words that come again are looked up.

    A text is cut at single blanks between words; each blank begins the word behind it, as in the vocabulary's own splitting, so
    the ids of the text are those of its words one after the other. New words are encoded together, and their ids told apart by
    the number of bytes of each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words are kept here; a second store costs half of the time
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.n_bytes = np.zeros(size, np.int64)  # in the vocabulary one character stands for one byte
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = 0 if token in special else len(token)
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.by_words = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not made["normalizer"]
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.number[""]  # noqa: B018  stands where a long word was, and has no ids
        self.ids, self.at, self.uses = np.empty(0, np.uint32), np.zeros(2, np.int64), np.zeros(1, np.int64)

    def _keep(self, most: int) -> None:
        """Forget all words but those that came most often."""
        best = np.sort(np.argsort(-self.uses[1:], kind="stable")[:most] + 1)
        words, ids, at, uses = list(self.number), self.ids, self.at, self.uses
        self._clear()
        for k in best.tolist():
            self.number[words[k]]  # noqa: B018
        n = at[best + 1] - at[best]
        self.ids = ids[_ranges(at[best], n)]
        self.at, self.uses = np.concatenate(([0, 0], np.cumsum(n))), np.concatenate(([0], uses[best] // 2))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # the fast one keeps no offsets
        return [np.array(e.ids, np.uint32) for e in batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        parts, lengths = [self.ids], [np.diff(self.at)]
        for lo in range(0, len(words), 4096):
            some = [" " + w for w in words[lo : lo + 4096]]
            ids = self._encode(["".join(some)])[0]
            ends, stop = np.cumsum(self.n_bytes[ids]), np.cumsum([len(w.encode()) for w in some])
            cut = np.searchsorted(ends, stop) + 1
            if not len(ids) or (ends[np.minimum(cut, len(ids)) - 1] != stop).any():  # a vocabulary that is not cut at blanks
                each = self._encode(some)
                ids, cut = np.concatenate(each), np.cumsum([len(x) for x in each])
            parts.append(ids)
            lengths.append(np.diff(cut, prepend=0))
        self.ids = np.concatenate(parts)
        self.at = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))

    def encode(self, texts: list) -> list[np.ndarray]:
        """The ids of each text (None: none)."""
        if not self.by_words:
            return self._encode([t or "" for t in texts])
        words, first, sizes, odd = [], [], [], {}
        for k, text in enumerate(texts):
            text = text or ""
            own = text.split(" ") if _even(text) else _CUT.split(text)
            first.append(own[0])
            if max(map(len, own)) > LONGEST_WORD:
                for i in range(1, len(own)):
                    if len(own[i]) > LONGEST_WORD:
                        odd[k, i] = " " + own[i]
                        own[i] = ""
            words += own[1:]
            sizes.append(len(own) - 1)
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self._learn(list(islice(self.number, known, None)))
        self.uses = np.pad(self.uses, (0, len(self.number) - len(self.uses))) + np.bincount(at, minlength=len(self.number))
        firsts, odds = self._encode(first), dict(zip(odd, self._encode(list(odd.values())), strict=True))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        out = []
        for k in range(len(texts)):
            own = at[bounds[k] : bounds[k + 1]]
            n = self.at[own + 1] - self.at[own]
            ids = self.ids[_ranges(self.at[own], n)]
            mine = [(i, x) for (j, i), x in odds.items() if j == k] if odds else []
            if mine:
                cut = np.cumsum(n)
                pieces = np.split(ids, [cut[i - 1] for i, _ in mine])
                ids = np.concatenate([pieces[0], *[y for (_, x), p in zip(mine, pieces[1:], strict=True) for y in (x, p)]])
            out.append(np.concatenate((firsts[k], ids)).astype(np.uint32))
        if len(self.number) > KNOWN_WORDS:
            self._keep(KNOWN_WORDS // 2)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once a process."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, vocabulary: str, end_id: int | None = 2, text_col: str = "text") -> DataFrame:
    """docs with `ids` for `text_col`: little-endian unsigned 32-bit ids of the whole text, and end_id behind them."""
    end = b"" if end_id is None else struct.pack("<I", end_id)
    other = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for rb in batches:
            texts = rb.column(len(other)).to_pylist()
            for lo, hi in chunks(texts, lambda t: len(t or "")):
                ids = pa.array([x.tobytes() + end for x in own.encode(texts[lo:hi])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[rb.column(k).slice(lo, hi - lo) for k in range(len(other))], ids], [*other, "ids"])

    schema = T.StructType([*[docs.schema[c] for c in other], T.StructField("ids", T.BinaryType(), False)])
    return docs.select(*[docs[f"`{c}`"] for c in other], docs[f"`{text_col}`"].cast("string")).mapInArrow(run, schema)


# --- the format -----------------------------------------------------------------------------------------------------------------


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays; samples too few to train on are the dictionary themselves."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _bytes_of(path: str) -> bytes:
    store, at = _store(path)
    with store.open_input_file(at) as f:
        return f.read()


def _put(path: str, data: bytes) -> None:
    store, at = _store(path)
    with store.open_output_stream(at) as f:
        f.write(data)


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str | None
    docs: int
    ids: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, overwrite: bool, vocabulary: str | None, end_id: int | None):
        self.path, self.width, self.run, self.overwrite, self.vocabulary, self.end_id = path, width, uuid.uuid4().hex, overwrite, vocabulary, end_id

    def _ids(self, rb: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The ids of each row, as they stand or of its text."""
        if "ids" in rb.schema.names:
            yield from (np.frombuffer(cell.as_buffer(), "<u4") for cell in rb.column("ids"))
            return
        own, end = encoder(self.vocabulary), np.array([] if self.end_id is None else [self.end_id], np.uint32)
        texts = rb.column("text")
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for lo, hi in chunks(sizes, lambda n: n):
            yield from (np.concatenate((ids, end)) for ids in own.encode(texts.slice(lo, hi - lo).to_pylist()))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, out, store, at = TaskContext.get().partitionId(), None, *_store(self.path)
        name, place, docs, total = f"{self.run}-{part:06d}-{uuid.uuid4().hex}.tok", 0, 0, 0
        index: list[pa.RecordBatch] = []
        try:
            for rb in iterator:
                if not rb.num_rows:
                    continue
                if out is None:
                    dictionary = _bytes_of(f"{self.path}/dictionary")
                    pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
                    out = store.open_output_stream(f"{at}/{name}")
                    place = out.write(MAGIC + bytes([self.width]) + hashlib.sha256(dictionary).digest())
                places, n = [], []
                for ids in self._ids(rb):
                    if self.width == 2 and len(ids) and ids.max() > 0xFFFF:
                        raise ValueError("an id is over 16 bits: write with width 4")
                    frame = pack(ids.astype(f"<u{self.width}").tobytes())
                    places.append(place)
                    n.append(len(ids))
                    place += out.write(frame)
                docs, total = docs + len(n), total + sum(n)
                index.append(pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(places, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "place", "n"]))
            if out is not None:
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, index[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_table(pa.Table.from_batches(index))
                out.write(sink.getvalue() + struct.pack("<QQ", place, len(sink.getvalue())) + MAGIC)
        finally:
            if out is not None:
                out.close()
        return Written(part, name if docs else None, docs, total)

    def commit(self, messages: list) -> None:
        new = [{"name": m.name, "docs": m.docs, "ids": m.ids} for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part)]
        had = [] if self.overwrite else _manifest(self.path)
        _put(f"{self.path}/manifest.json", json.dumps({"files": had + new}).encode())

    def abort(self, messages: list) -> None:
        store, at = _store(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{at}/{m.name}")


def _manifest(path: str) -> list[dict]:
    store, at = _store(path)
    if store.get_file_info(f"{at}/manifest.json").type == pyarrow.fs.FileType.NotFound:
        return []
    return json.loads(_bytes_of(f"{path}/manifest.json"))["files"]


class _File:
    """One file open for reading."""

    def __init__(self, path: str, name: str, dictionary: bytes):
        store, at = _store(path)
        self.file = store.open_input_file(f"{at}/{name}")
        end = self.file.size()
        head, tail = self.file.read_at(41, 0), self.file.read_at(24, end - 24)
        if head[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{name} is no file of token frames, or not whole")
        if head[9:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.width = head[8]
        self.end, size = struct.unpack("<QQ", tail[:16])
        self.index = pa.ipc.open_stream(self.file.read_at(size, self.end)).read_all()
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.unpack(self.file.read_at(end - begin, begin)), f"<u{self.width}")


@dataclass
class _Part(InputPartition):
    name: str
    start: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, only: list | None):
        self.path, self.id_type, self.only = path, schema["doc_id"].dataType, only

    def partitions(self) -> list[_Part]:
        out, start = [], 0
        for f in _manifest(self.path):
            out.append(_Part(f["name"], start))
            start += f["ids"]
        return out or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        file = _File(self.path, partition.name, _bytes_of(f"{self.path}/dictionary"))
        index, n = file.index, file.index["n"].to_numpy()
        place = np.append(index["place"].to_numpy(), file.end)
        start = partition.start + np.concatenate(([0], np.cumsum(n)))
        rows = np.arange(len(n)) if self.only is None else np.flatnonzero(pc.is_in(index["doc_id"], pa.array(self.only, index["doc_id"].type)).to_numpy(zero_copy_only=False))
        for lo, hi in chunks(rows.tolist(), lambda k: int(n[k]), 1 << 20):
            some = rows[lo:hi]
            ids = [file.ids(int(place[k]), int(place[k + 1])).astype("<u4").tobytes() for k in some]
            doc = index["doc_id"].take(pa.array(some)).combine_chunks()
            yield pa.RecordBatch.from_arrays([doc, pa.array(start[some]), pa.array(n[some]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


class TokenFrames(DataSource):
    """`token_frames`: reads (doc_id, start, n_tokens, ids); writes (doc_id, ids), or (doc_id, text) by a vocabulary.

    ids are little-endian 32-bit numbers. Options: path; id_type (of doc_id, default bigint); width (bytes of an id on disk, 2 or
    4); vocabulary and end_id, for texts; only (JSON list of doc_ids: of other documents nothing but the index is read).
    """

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def schema(self) -> str:
        return f"doc_id {self.options.get('id_type', 'bigint')}, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, json.loads(self.options["only"]) if "only" in self.options else None)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        end = self.options.get("end_id")
        return _Writer(self.options["path"], int(self.options.get("width", "4")), overwrite, self.options.get("vocabulary"), None if end is None else int(end))


# --- whole tables ---------------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> None:
    """Encode every text of docs and write the ids to the new folder `path` in the order of `id_col`.

    Texts are dealt by ranges of ids, equal ids by their place in the input, so no range grows with a repeated id. The
    dictionary comes from a sample: at most `sample_docs` documents, of each at most SAMPLE_IDS ids.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    own = encoder(vocabulary)
    rows = docs.select("doc_id").count()
    # some of the documents by a hash of their ids, cut to the bound
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(1, rows)))
    sample = docs.filter(share).select(F.substring("text", 1, SAMPLE_IDS).alias("text")).limit(sample_docs)
    ids = encode(sample, vocabulary, end_id).select(F.substring("ids", 1, 4 * SAMPLE_IDS).alias("ids")).toArrow()["ids"].to_pylist()
    if _manifest(path):
        raise ValueError(f"{path} holds token frames")
    store, at = _store(path)
    store.create_dir(at, recursive=True)
    _put(f"{path}/dictionary", train([np.frombuffer(x, "<u4").astype(f"<u{own.width}").tobytes() for x in ids]))
    spark.dataSource.register(TokenFrames)
    placed = docs.withColumn("place", F.monotonically_increasing_id()).repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    to = placed.select("doc_id", "text").write.format("token_frames").option("path", path).option("width", own.width).option("vocabulary", vocabulary)
    (to if end_id is None else to.option("end_id", end_id)).mode("append").save()


def read(spark: SparkSession, path: str, id_type: str = "bigint", only: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of a folder, or of those whose id is in `only`."""
    spark.dataSource.register(TokenFrames)
    source = spark.read.format("token_frames").option("path", path).option("id_type", id_type)
    return (source if only is None else source.option("only", json.dumps(only))).load()
