"""Token frames: ids against the tokenizer itself, round trips, single documents, damage."""

import glob
import random
import struct
import zlib

import numpy as np
import pytest

from spanloom.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  a  b ", "a  b c", "x <|endoftext|> y", "don't  'll  we 'll go", "z" * 100 + " " + "y" * 70 + " b", " lead", "trail ", "\n\n a\n b \n",
    "12 34 5.6, 7", "日本 語 テキスト です", "é è \x1c a \x85 b　c  d", "👍 🏽 👨‍👩‍👧 x", "q" * 65 + " " + "r" * 65 + " " + "s" * 66,
]


def plain(path, texts):
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def random_texts(n):
    r = random.Random(11)
    return ["".join(r.choice("ab 1.\n\t' é日  s") for _ in range(r.randint(0, 20))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_those_of_the_tokenizer(path, monkeypatch):
    texts = ODD * 2 + random_texts(800) + ["word " * 3000]
    own = tokens.Encoder(path)
    assert [x.tolist() for x in own.encode(texts)] == plain(path, texts)
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 10)  # forgets all words again and again
    assert [x.tolist() for k in range(0, len(texts), 50) for x in own.encode(texts[k : k + 50])] == plain(path, texts)


def test_round_trip_in_order_of_ids(spark, tmp_path):
    texts = ODD + random_texts(300) + ["a long text, " * 60_000]
    ids = [*range(len(texts))]
    random.Random(1).shuffle(ids)
    rows = [(None if i == 4 else i // 2 * 2, t, "x", 1) for i, t in zip(ids, texts, strict=True)]  # a null id, ids that come twice
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, place int").repartition(6).cache()
    path = f"{tmp_path}/frames"
    tokens.write(df, path, BYTES, end_id=2)
    got = sorted(tokens.read(spark, path).collect(), key=lambda x: x.start)
    placed = sorted(((x.doc_id is not None, x.doc_id or 0, k), x.doc_id, x.text) for k, x in enumerate(df.collect()))
    want = [(i, [*own, 2]) for (_, i, _), own in zip(placed, plain(BYTES, [t for *_, t in placed]), strict=True)]
    assert [(x.doc_id, np.frombuffer(x.ids, "<u4").tolist()) for x in got] == want
    assert [x.start for x in got] == np.cumsum([0, *[len(x) for _, x in want]])[:-1].tolist() and [x.n_tokens for x in got] == [len(x) for _, x in want]
    with pytest.raises(ValueError):
        tokens.write(df, path, BYTES)
    one = tokens.read(spark, path, only=[10]).collect()
    assert [(x.doc_id, x.start, x.ids) for x in one] == [(x.doc_id, x.start, x.ids) for x in got if x.doc_id == 10] and len(one) == 2


def test_no_rows_and_text_ids(spark, tmp_path):
    tokens.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/a", BYTES)
    assert tokens.read(spark, f"{tmp_path}/a").count() == 0
    df = spark.createDataFrame([("b", "two words"), ("a", None)], "name string, body string")
    tokens.write(df, f"{tmp_path}/b", WORDS, end_id=None, text_col="body", id_col="name")
    assert [(x.doc_id, x.n_tokens) for x in tokens.read(spark, f"{tmp_path}/b", id_type="string").orderBy("start").collect()] == [("a", 0), ("b", 2)]


def test_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame([(k, f"some text {k} of one kind") for k in range(400)], "doc_id long, text string").repartition(1)
    path = f"{tmp_path}/frames"
    tokens.write(df, path, BYTES)
    dictionary = open(f"{path}/dictionary", "rb").read()
    assert len(dictionary) > 0
    open(f"{path}/lost-000000-x.tok", "wb").write(b"a task that was run twice")  # not in the manifest
    assert tokens.read(spark, path).count() == 400
    open(f"{path}/dictionary", "wb").write(dictionary + b"x")
    with pytest.raises(Exception, match="another dictionary"):
        tokens.read(spark, path).collect()
    open(f"{path}/dictionary", "wb").write(dictionary)
    name = next(x for x in glob.glob(f"{path}/*.tok") if "lost" not in x)
    whole = open(name, "rb").read()
    open(name, "wb").write(whole[:-30])
    with pytest.raises(Exception, match="not whole"):
        tokens.read(spark, path).collect()


def test_query_columns(spark):
    from spanloom.llm.queries import op11_tokens

    got = op11_tokens(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for x, d, ids in zip(got, docs, plain(BYTES, [d.text for d in docs]), strict=True):
        raw = b"".join(struct.pack("<I", i) for i in [*ids, 2])
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (d.doc_id, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
