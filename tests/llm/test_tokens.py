"""Token files and byte-level BPE against the public libraries."""

import base64
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tracelake.llm")
tokenizers = pytest.importorskip("tokenizers")
tiktoken = pytest.importorskip("tiktoken")
vocabularies = pytest.importorskip("public_tokenizers")

from tracelake.llm import bpe, pretokens, token_files  # noqa: E402

HF, RANKS = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("byte_bpe_multi_50k.tiktoken")


def texts():
    rng = random.Random(2)
    signs = [chr(c) for c in range(0x250)] + list("  \n\t  　あ中😀́٠Ⅰ") + [" "] * 120 + list("abcdefgh") * 12
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(300)]
    return out + [None, "", " ", "  ", "\nabc d", " x", "x ", "it's he'll 12 34!", "<|endoftext|> a", "a" * 3000,
                  "ab" * 2000 + "é" * 500, " " * 700 + "x", "word " * 5000]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_published_one():
    assert pretokens.PATTERN == vocabularies.PATTERN


@pytest.mark.parametrize("chunk", [64, 1 << 22])
def test_bpe_equals_the_library(tik, monkeypatch, chunk):
    monkeypatch.setattr(pretokens, "CHUNK", chunk)  # texts that span chunks, too
    monkeypatch.setattr(pretokens, "KEPT", 50)  # and tables that are emptied on the way
    with open(RANKS, "rb") as f:
        ranks = bpe.Ranks(f.read())
    ids, counts = pretokens.UnitTable(ranks.encode_pieces).ids_of(texts())
    ends = np.cumsum(counts)
    for text, a, b in zip(texts(), ends - counts, ends):
        assert ids[a:b].tolist() == tik.encode_ordinary(text or "")
        assert ranks.decode(ids[a:b]) == (text or "").encode()


def test_long_pieces_merge_like_short_ones():
    with open(RANKS, "rb") as f:
        ranks = bpe.Ranks(f.read())
    rng = random.Random(4)
    for _ in range(50):
        piece = "".join(rng.choice("abcétion") for _ in range(rng.randrange(2, 60)))
        ids, _ = ranks.encode_pieces([piece])
        if len(ids) > 1:
            assert ranks.merge_long(piece.encode()) == ids.tolist()


def table(spark):
    rows = list(enumerate(texts(), 10)) + [(3, "first"), (3, "first"), (None, "no id")]
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids string"), rows


def test_bpe_round_trip_in_spark(spark, tik):
    df, rows = table(spark)
    out = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert len(out) == len(rows) and out[0].n_tokens == 1
    want = sorted((i is None, i or 0, tik.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], bytes(r["decoded"])) for r in out) == want
    assert bpe.decode(bpe.encode(df.limit(0), RANKS), RANKS).collect() == []


def test_token_files(spark, tmp_path):
    df, rows = table(spark)
    tokenizer = tokenizers.Tokenizer.from_file(HF)
    path = token_files.write_tokens(df.repartition(7), str(tmp_path / "tokens"), HF, end_id=2)
    read = token_files.read_tokens(spark, path)
    got = sorted(read.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in got:
        assert r["ids"] in ids[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) and r["start"] == at
        at += len(r["ids"])
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.with_crc32(read).collect()}
    assert all(crc[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)


def test_token_files_are_pruned_and_empty_tables_work(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = token_files.write_tokens(df.repartition(4), str(tmp_path / "many"), HF, stripe_bytes=1 << 16)
    one = token_files.read_tokens(spark, path).where("doc_id = 4321")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4321)" in one._jdf.queryExecution().toString()
    assert one.count() == 1
    orc = pytest.importorskip("pyarrow.orc")
    files = sorted((tmp_path / "many").glob("*.orc"))
    assert sum(orc.ORCFile(str(f)).nrows for f in files) == 5000
    path = token_files.write_tokens(df.limit(0), str(tmp_path / "none"), HF)
    assert token_files.read_tokens(spark, path).count() == 0


def test_added_tokens_are_found_as_the_library_finds_them(spark, tmp_path):
    rows = [(0, "<|endoftext|> a"), (1, "plain words here"), (2, "a  b<|endoftext|><|endoftext|>\n  c <|endoftext|"),
            (3, "<|endoftext|>"), (4, None), (5, "it quotes <|endoftext|> and goes on " * 500), (6, " x y z")]
    tokenizer = tokenizers.Tokenizer.from_file(HF)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in token_files.tokenize(df, HF, 2).collect()}
    assert got[0]["ids"] == [50256, 257, 2]
    at = 0
    for i, t in rows:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["ids"], got[i]["n_tokens"], got[i]["file_start"]) == (want, len(want), at)
        at += len(want)
