"""Each registered query over a whole small table: its contract's columns and types, a row for each row it must have."""

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("tracelake.llm")
vocabularies = pytest.importorskip("public_tokenizers")

from tracelake.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3": {"doc_id": "bigint"},
    "op4": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string",
             "folded_root": "string", "verified": "boolean"},
    "op12": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string",
             "formatted_chars": "bigint"},
    "op13": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint",
             "count_sum": "bigint", "groups_sha256": "string"},
}


def test_all_operators_are_registered():
    assert sorted(COLUMNS, key=lambda n: int(n[2:])) == [n.split("_")[0] for n in queries.QUERIES]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_columns_types_and_rows(spark, name):
    op = name.split("_")[0]
    got = queries.QUERIES[name](spark, FOLDER)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[op]} == COLUMNS[op]
    rows = got.collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    if "doc_id" in kinds:
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if "held_out" in kinds:
        of, left = (5, 0) if op == "op8" else (3, 1)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % of == left) for r in rows)
    if op == "op4":
        import base64

        import tiktoken

        with open(vocabularies.path(queries.RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for r in rows:
            ids = library.encode_ordinary(docs[r["doc_id"]] or "")
            want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest())
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
    if op == "op8":
        assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    if op == "op10":
        assert all(0 <= r["score"] <= 1 for r in rows)
