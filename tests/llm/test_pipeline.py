"""The pipeline's stages on a small corpus with planted cases, and on an empty one."""

import random

import pytest

pytest.importorskip("tracelake.llm")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, ids int, _fp string"


def corpus(spark, path):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = {i: "\n".join(text(rng.randrange(20, 45)) for _ in range(rng.randrange(1, 6))) for i in range(200)}
    toxic = {}
    for i in range(200, 260):
        parts = text(120).split()
        for _ in range(5):
            parts.insert(rng.randrange(len(parts)), rng.choice(["jerkface", "dumbhead", "scumball"]))
        toxic[i] = " ".join(parts)
    passage = text(60)
    carriers = {i: "\n".join([text(40), passage, text(40)]) for i in range(300, 312)}
    copies = {i: clean[i - 400] for i in range(400, 410)}
    near = {i: clean[i - 400].replace(" ", "  ", 1) + " x" for i in range(420, 424)}  # longest texts, a word more
    odd = {500: None, 501: "", 502: " \n ", 503: "Short.", 504: text(30_000)}
    rows = [(i, t, "en", f"s{i % 5}" if i != 503 else None, len(t or ""), "r", 1, "f")
            for part in (clean, toxic, carriers, copies, near, odd) for i, t in part.items()]
    rows.append(rows[0])  # a repeated row
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0, 0) for i in range(0, 120)] + [(i, 0, 1) for i in range(200, 248)] + [(5, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return clean, toxic, carriers, copies, odd, passage


def test_stages(spark, tmp_path):
    clean, toxic, carriers, copies, odd, passage = corpus(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = {name: [r["doc_id"] for r in rows] for name, rows in kept.items()}
    assert not set(ids["toxicity"]) & set(toxic)
    assert set(clean) | set(carriers) | set(odd) <= set(ids["toxicity"])

    texts = {}
    for r in kept["line_dedup"]:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert sum(passage in (t or "") for ts in texts.values() for t in ts) == 1 and passage in texts[300][0]
    assert set(carriers) <= set(texts) and texts[500] == [None] and texts[501] == [""]
    assert all(texts[i][0] == t for i, t in clean.items())
    for name in ("toxicity", "line_dedup", "near_dedup", "mix_sources"):
        assert {(r["row_id"], r["ids"], r["_fp"]) for r in kept[name]} == {("r", 1, "f")}
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept["line_dedup"] if r["doc_id"] in carriers)

    left = ids["near_dedup"]
    assert len(left) == len(set(left)) and set(clean) <= set(left) and not set(copies) & set(left)
    assert len({500, 501, 502} & set(left)) == 1  # texts without words are one group

    words = lambda t: len((t or "").split())
    before = {r["doc_id"]: words(r["text"]) for r in kept["near_dedup"]}
    mixed = {}
    for r in kept["mix_sources"]:
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + words(r["text"])
    assert all(n <= 3 * before[i] for i, n in mixed.items())
    assert abs(sum(mixed.values()) - sum(before.values())) < 0.02 * sum(before.values())
    assert len(kept["byte_bpe"]) == len(kept["mix_sources"]) and all(r["round_trip"] for r in kept["byte_bpe"])


def test_run_on_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    from tracelake.llm import exact_dedup

    other = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert other.count() == 2  # a run deletes its own tables only
