"""SimHash, exact and line deduplication against brute force on small tables."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("tracelake.llm")

from tracelake.llm import components, exact_dedup, golay, line_dedup, simhash  # noqa: E402

DOCS = "doc_id long, text string, fp string, row_id int, `key` string, no double"


def docs(spark, rows):
    """A table with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 7, "k", 0.5) for i, t in rows], DOCS)


def vocabulary_texts(rng, n, words, vocabulary=400):
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(words))) for _ in range(n)]


def test_golay_words_one_bit_apart_meet():
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000).astype(np.uint32)
    near, counts = golay.nearby(words)
    assert set(counts.tolist()) == {1, 6}
    for bit in range(golay.LENGTH):
        other = golay.nearest(words ^ np.uint32(1 << bit))
        assert all(o in row[:c] for o, row, c in zip(other, near, counts))


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, distance=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = list(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for p in prints]


def edge_rows():
    rng = random.Random(3)
    texts = vocabulary_texts(rng, 60, 200)
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts[:40]]  # near copies
    texts += texts[:10] + [t.upper() for t in texts[10:20]] + ["a b", "A  B", "é É x"]
    texts += [None, "", " \t\n", None, "very long " * 20_000 + "end"]
    rows = list(enumerate(texts, 5))
    return rows + [rows[3], (None, texts[4]), (None, "alone without an id")]


def test_simhash_equals_brute_force(spark):
    rows = edge_rows()
    got = [tuple(r) for r in simhash.near_duplicates(docs(spark, rows)).collect()]
    prints = [brute_fingerprint(t) for _, t in rows]
    want = [(i, format(p, "016x"), c) for (i, _), p, c in
            zip(rows, prints, brute_components([i for i, _ in rows], prints))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_links_connect_what_all_pairs_connect(spark):
    """A dense group, larger than a bucket: block by block, with the same components."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    group = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(300)}
    chain = [rng.getrandbits(64)]
    for step in range(40):
        chain.append(chain[-1] ^ (1 << step) ^ (1 << (step + 7)) ^ (1 << (step + 19)))
    noise = {rng.getrandbits(64) for _ in range(500)}
    prints = list(group | set(chain) | noise)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.fingerprint_links(nodes, bucket=50)
    found = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    by_root = {}
    for p, s in zip(prints, signed):
        by_root.setdefault(found.get(s, s), set()).add(p)
    ids = list(range(len(prints)))
    brute = {}
    for p, c in zip(prints, brute_components(ids, prints)):
        brute.setdefault(c, set()).add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, brute.values()))


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(pairs).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
    empty = spark.createDataFrame([], "u long, v long")
    assert components.connected_components(empty).collect() == []


def brute_exact(rows):
    import hashlib
    import re

    body = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), b in zip(rows, body):
        groups.setdefault(b, []).append(i)
    out = []
    for (i, _), b in zip(rows, body):
        ids = groups[b]
        out.append((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(b.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("block", "hot"), [(16, 3), (1024, 20_000)])
def test_exact_equals_brute_force(spark, block, hot):
    rows = edge_rows() + [(900 + i, "same text in a block") for i in range(40)]
    rows += [(1000, "same\ttext  in a block "), (1001, "same text in a block\n"), (1002, "a" * 16), (1003, "a" * 32)]
    got = exact_dedup.exact_duplicates(docs(spark, rows), block=block, hot=hot).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == \
        sorted(brute_exact(rows), key=key)
    kept = {}
    for r in got:
        if r["kept"]:
            kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + 1
            assert r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})


def test_exact_empty_table(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).collect() == []


def brute_lines(rows, least):
    """Lines deleted of each row: all runs of lines that reach ``least`` words are compared."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    lines = [[s for s in (x.strip(" \t\n\v\f\r") for x in (t or "").split("\n")) if s] for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for k in order:
        for start in range(len(lines[k])):
            for stop in range(start + 1, len(lines[k]) + 1):
                run = tuple(lines[k][start:stop])
                if sum(len(x.split()) for x in run) < least:
                    continue
                if run in seen:
                    gone[k].update(range(start, stop))
                seen.add(run)
    return gone


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(f"v{rng.randrange(90)}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(2, 8))] for _ in range(6)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(6)):
            lines += rng.choice(runs) if rng.random() < 0.4 else [rng.choice(pool)]
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "  ", "\t"]))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "one two three four\n" * 30), (None, rows[4][1]), (205, rows[5][1])]
    table = docs(spark, rows)
    got = {(r["doc_id"], r["text"]): r for r in line_dedup.dedup_lines(table, min_words=10).collect()}
    found = line_dedup.dedup_lines(table, min_words=10).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for (i, text), gone in zip(rows, brute_lines(rows, 10)):
        r = by_id[i]
        deleted = {p for s in r["deleted"] for p in range(s["first"], s["first"] + s["lines"])}
        assert deleted == gone, i
        left = [x for k, x in enumerate(x for x in (text or "").split("\n") if x.strip()) if k not in gone]
        assert [x for x in (r["text"] or "").split("\n") if x.strip()] == left
        if not gone:
            assert r["text"] == text
    assert got


def test_line_dedup_empty_and_repeated_rows(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []
    text = " ".join(f"a{i}" for i in range(60))
    found = line_dedup.dedup_lines(docs(spark, [(1, text), (1, text), (2, "x\n" + text + "\ny")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == [(1, ""), (1, text), (2, "x\ny")]


def test_line_runs_hold_the_words_they_need():
    after, before = line_dedup.windows([3, 3, 60, 1], 5)
    assert after.tolist() == [2, 2, 1, 0] and before.tolist() == [0, 2, 1, 2]
    assert all(len(x) == 0 for x in line_dedup.windows([], 5))


def test_native_plans_have_no_python(spark):
    plan = exact_dedup.exact_duplicates(docs(spark, [(1, "a")]))
    text = plan._jdf.queryExecution().toString()
    assert not any(word in text for word in ("Python", "Pandas", "Arrow"))
    assert F is not None
