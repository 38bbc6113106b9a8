import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from palaver.llm import token_count, token_store, tokens

PATH = tokens.tokenizer_path()
TEXTS = ["", None, "hello world", "two  spaces and \n line", " lead", "trail ", "it's we'll, 'tis.", "<|endoftext|> inside<|endoftext|>", "日本語 text\t tab", "a # b", "x\ny\n\nz", "word " * 5000, "x\x00 y", "…“quoted”… end.", "hello world"]
DOCS = [(k * 3, t) for k, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("slots", [8, 1 << 12])
def test_encoder(library, slots):
    enc = tokens.Encoder(PATH, slots=slots)
    for _ in range(2):
        flat, at = enc.encode([t or "" for t in TEXTS], 2)
        for k, t in enumerate(TEXTS):
            assert flat[at[k] : at[k + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert enc.encode([], 2)[1].tolist() == [0]


@pytest.mark.parametrize("literal", [False, True])
def test_encoder_on_odd_texts(library, literal):
    """Pieces are cut where the library would begin a token, whatever stands there; a table of 64 places forgets most of them."""
    r = random.Random(5)
    some = [" ", " ", "\n", "\t", "a", "Bc", "é", "É", "à", "1", "23", ".", ",", "'s", "'", "\u201c", "日", "<|endoftext|>", "\x00", "(", "-", "\x1c", "\x85", "\u2003", "ß", "😀", "longer" * 4]
    texts = ["".join(r.choices(some, k=r.randint(0, 30))) for _ in range(1500)]
    other = Tokenizer.from_file(PATH)
    other.encode_special_tokens = literal
    enc = tokens.Encoder(PATH, literal, slots=64)
    for a in range(0, len(texts), 500):
        flat, at = enc.encode(texts[a : a + 500])
        for k, t in enumerate(texts[a : a + 500]):
            assert flat[at[k] : at[k + 1]].tolist() == other.encode(t, add_special_tokens=False).ids, t


def test_store_round_trip(spark, library, tmp_path):
    folder = f"file://{tmp_path}"
    df = spark.createDataFrame([*DOCS, (None, "no id"), (6, "hello world")], "doc_id long, text string").repartition(3)
    got = token_store.store_tokens(df, folder=folder).orderBy("start").collect()
    want = sorted([(-1, "no id"), (6, "hello world"), *((i, t or "") for i, t in DOCS)])
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (None if i < 0 else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    raw = (Path(tmp_path) / "dictionary.bin").read_bytes()
    shard = token_store.Shard(next(Path(tmp_path).glob("shard-*")).read_bytes(), raw)
    assert len(shard) and shard.ids(0)[-1] == 2
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Shard(next(Path(tmp_path).glob("shard-*")).read_bytes(), raw + b"x")
    assert token_store.store_tokens(df.where("false")).count() == 0


def test_shards_roll(spark, library, tmp_path):
    """Small shards give the same rows as one; other columns, clashing names among them, aren't used."""
    df = spark.createDataFrame([(k, f"text {k} of some words", 5, "x") for k in range(300)], "doc_id long, text string, start long, shard string").coalesce(1)
    run = token_store.RUN
    token_store.RUN = 1 << 10
    try:
        shards = token_store.write_dataset(df, f"file://{tmp_path}", PATH, shard=1 << 11)
    finally:
        token_store.RUN = run
    got = token_store.read_dataset(spark, f"file://{tmp_path}", shards).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == list(range(300)) and sum(s[2] for s in shards) == 300
    start = 0
    for r in got:
        ids = [*library.encode(f"text {r['doc_id']} of some words", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    ids = [[5, 9, 0], [0], [1, 2, 3, 4, 5, 6, 7, 8, 0], [3, 0], [4, 4]]
    np.array(sum(ids, []), "<u2").tofile(tmp_path / "a.bin")
    np.array([0], "<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"")
    got = token_count.scan(spark, token_count.files_of(f"file://{tmp_path}"), end=0, block=block)
    rows = sorted((r["file"][-5], r["k"], r["start"], r["n_tokens"], r["ended"]) for r in got.collect())
    assert rows == [("a", 0, 0, 3, True), ("a", 1, 3, 1, True), ("a", 2, 4, 9, True), ("a", 3, 13, 2, True), ("a", 4, 15, 2, False), ("b", 0, 0, 1, True)]


def test_counts(spark):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    df = spark.createDataFrame([*DOCS, (6, "hello world")], "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_count.count_tokens(df).collect())
    assert got == sorted((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in [*DOCS, (6, "hello world")])
    assert token_count.count_tokens(df.where("false")).count() == 0
