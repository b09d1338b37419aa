"""The Merkle manifest against a plain one in Python, and its query against SQL."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tracelake.llm")

from tracelake.llm import merkle  # noqa: E402

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, place int, node string, leaf int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """The root of a list of digests, and each one's steps to it."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for way, i in zip(steps, at):
            run = runs[i // fanout]
            way.append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
        nodes, at = [h(*r) for r in runs], [i // fanout for i in at]
    return nodes[0], steps


def plain(rows, fanout):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r[:5])))
    done = []
    for source in sorted(trees, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(trees[source])
        done.append((leaves, *climb([d for *_, d in leaves], fanout)))
    root, upper = climb([subroot for _, subroot, _ in done], fanout)
    return [(d if known else None, leaf, subroot, root, tuple(low + up))
            for (leaves, subroot, steps), up in zip(done, upper) for (known, d, leaf), low in zip(leaves, steps)]


def spark_rows(df):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["steps"]))
            for r in df.collect()]


def key(r):
    return r[0] is not None, r[0] or 0, r[1:]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_equals_a_plain_one(spark, fanout):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["a", "a", "a", "B", "é", "", None, f"s{i}"]), rng.choice(["en", None]), i % 7,
             rng.choice(["", None, "x\ny", "día\n", "z" * 30000])) for i in range(120)]
    rows += [rows[3], rows[3], (None, "a", None, None, None), (None, "a", "fr", 3, "t"), (7, "a", "de", 1, "another 7")]
    df = spark.createDataFrame([(*r, 1, 2, "n", 3) for r in rows], SCHEMA).repartition(5)
    proofs = merkle.manifest(df, COLUMNS, "source", "doc_id", fanout, {"other": F.col("text")}).cache()
    assert sorted(spark_rows(proofs), key=key) == sorted(plain(rows, fanout), key=key)
    checked = proofs.select(merkle.fold(F.col("leaf"), F.col("steps")).alias("root"), F.col("root").alias("want"),
                            merkle.fold(F.lit(h("x")), F.col("steps")).alias("wrong"), "steps",
                            merkle.proof_digest(F.col("steps")).alias("proof")).collect()
    assert all(r["root"] == r["want"] != r["wrong"] for r in checked)
    assert all(r["proof"] == h(*(p for s in r["steps"] for p in s)) for r in checked)


@pytest.mark.parametrize("n", [0, 1, 4])
def test_small_tables(spark, n):
    rows = [(i, "one", "en", 1, f"text {i}") for i in range(n)]
    df = spark.createDataFrame([(*r, 1, 2, "n", 3) for r in rows], SCHEMA)
    got = spark_rows(merkle.manifest(df, COLUMNS, "source", "doc_id"))
    assert sorted(got, key=key) == (sorted(plain(rows, 3), key=key) if rows else [])
    if n == 1:  # a lone leaf is its own root, and its proof is empty
        assert got == [(0, plain_leaf(rows[0]), plain_leaf(rows[0]), plain_leaf(rows[0]), ())]


def test_query_equals_sql(spark):
    from tools.check_oracle import duck
    from tracelake.llm import queries

    folder = "/root/testdata/sf0.001"
    want = duck(folder).execute(queries.ORACLES["op11_merkle_manifest"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op11_merkle_manifest"](spark, folder)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    # Only texts with line feeds and an even crc32 fail.
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    hit = docs.where(F.col("text").contains("\n") & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0))
    assert {r["doc_id"] for r in got.where("NOT verified").collect()} == {r["doc_id"] for r in hit.collect()}
