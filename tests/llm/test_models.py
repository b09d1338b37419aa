"""Mixing, URL filter, toxicity, language and vector search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tracelake.llm")

from tracelake.llm import ann, language, mixing, toxicity, url_filter  # noqa: E402


def mix_rows():
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(400)), rng.choice(["a", "b", "c", "é", "hot", "hot", "hot"])) for i in range(600)]
    return rows + [(700, None, "a"), (701, "", None), (702, "x y\tz", None), (703, "tiny", "zz"), (5, rows[5][1], rows[5][2]),
                   (None, "no id at all", "b")]


def brute_targets(sizes, max_epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), float(sum(sizes.values())), {}
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > max_epochs * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(max_epochs * sizes[s])
            left -= out[s]
            free.discard(s)


def test_mix(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, 1, 2.0, "q") for r in rows], "doc_id long, text string, source string, size int, target double, quota string")
    out = mixing.mix(df, shard=5000).collect()
    assert len(out) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    targets = brute_targets(size)
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - targets[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["passes"] * r["size"] + sum(b - a for a, b in r["spans"])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(40, 0.03 * t), s
    again = mixing.mix(df.repartition(5, "text"), shard=5000).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"], str(r["spans"]))
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixing.mix(df.limit(0)).collect() == []


def test_sainte_lague_equals_the_highest_quotients(spark):
    rng = random.Random(6)
    for seats in (0, 1, 7, 50, 1000):
        votes = [(g, p, float(rng.choice([0, 1, 3, 10, 500, 7.5])), seats) for g in (1, 2) for p in range(rng.randrange(1, 9))]
        got = {(r["grp"], r["party"]): r["quota"] for r in
               mixing.sainte_lague(spark.createDataFrame(votes, "grp long, party long, votes double, seats long")).collect()}
        for g in (1, 2):
            mine = [(p, v) for h, p, v, _ in votes if h == g]
            quotients = sorted(((-v / (2 * k + 1), p) for p, v in mine if v for k in range(seats)))[:seats]
            want = {p: sum(q == p for _, q in quotients) for p, _ in mine}
            assert {p: got[g, p] for p, _ in mine} == want, (seats, mine)


def test_taken_texts(spark):
    plan = spark.createDataFrame([(1, 2, [[0, 1], [2, 4]], "a  b c\nd e"), (2, 0, [], "x"), (3, 1, [], None)],
                                 "doc_id long, passes int, spans array<array<long>>, text string")
    got = {r["doc_id"]: r["texts"] for r in mixing.taken_texts(plan).collect()}
    assert got == {1: ["a  b c\nd e", "a  b c\nd e", "a\nc\nd"], 2: [], 3: []}


URLS = ["http://Example.COM/en/a", "http://www.example.com/en/", "https://x.example.com/en/9?q=1#t", "http://foo.com/", "http://foo.com",
        "http://a.net/es/1", "http://a.net/fr/2", "http://a.net/de/2", "http://a.org/en/", "ftp://h?x/y", "no scheme", "", None,
        "http://notcom/", "http://x.com:80/en/", "http://com/", "a://b://c/d", "http://a.net#/es/", "http://é.ORG/É?ü=1&b=2", "http://l.org/" + "x" * 30000]


def brute_judge(url):
    rest = url.partition("://")[2] if url and "://" in url else None
    if rest is None:
        return "", "", None
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [h + p for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    rows = [(i, u, "h", 1.0) for i, u in enumerate(URLS * 3)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, entropy double"))
    verdict = {h + p: v for v, h, p in url_filter.RULES}
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, rule = brute_judge(URLS[r["page_id"] % len(URLS)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict[rule] if rule else r["verdict"] in ("allow", "block")
        assert 0 <= r["block_score"] <= 1
    text = out._jdf.queryExecution().toString()
    assert not any(word in text for word in ("Python", "Pandas", "Arrow"))
    assert url_filter.judge(out.select("page_id", F.lit(None).cast("string").alias("url")).limit(0)).collect() == []


def test_url_trees_learn(spark):
    rng = random.Random(8)
    def url(bad):
        host = "".join(rng.choice("0123456789-x" if bad else "abcdefgh") for _ in range(12))
        return f"http://{host}.org/{'?a=1&b=2&c=3' if bad else 'page'}"
    rows = [(i, url(i % 2), i % 2) for i in range(600)]
    known = spark.createDataFrame([(u, y) for _, u, y in rows[:400]], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows[400:]], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules=(), labelled=known).collect()}
    assert sum(got[i] == ("block" if y else "allow") for i, _, y in rows[400:]) > 190
    only = url_filter.judge(pages, rules=(), labelled=known.where("label = 1"))
    assert {r["verdict"] for r in only.collect()} == {"block"}
    none = url_filter.judge(pages, rules=(), labelled=known.limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_one_blocked_url_among_many_is_learned(spark):
    known = spark.range(30_000).select(
        F.when(F.col("id") == 7, "http://9-9-9-9.zz/?a=1&b=2&c=3&d=4").otherwise(F.concat(F.lit("http://site.org/page"), "id")).alias("url"),
        (F.col("id") == 7).cast("int").alias("label"))
    pages = spark.createDataFrame([(1, "http://9-9-9-9.zz/?a=1&b=2&c=3&d=4"), (2, "http://site.org/page5"), (3, "http://site.org/pageX")],
                                  "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules=(), labelled=known).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def toxic_rows():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 150))]
        if i % 5 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["jerkface", "dumbhead", "rubbish"]))
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    return rows


def test_toxicity_held_out_and_edges(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (1, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    known = toxicity.labelled_texts(docs, labels, F.col("doc_id") >= 350)
    assert known.count() == 350
    model = toxicity.train(known)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5, bool(y)) for i, _, y in rows[350:]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "é" * 2_500_000)], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(odd.limit(0), model).collect() == []
    nothing = toxicity.train(known.limit(0))
    assert {r["score"] < 0.5 for r in toxicity.score(odd, nothing).collect()} == {True}
    bad = toxicity.train(known.where("label = 1"))
    assert {r["score"] > 0.5 for r in toxicity.score(odd, bad).collect()} == {True}


def test_toxicity_scales_are_log_count_ratios():
    clean, toxic = np.array([0, 90, 5, 0]), np.array([0, 10, 5, 9])
    got = toxicity.log_count_ratio(clean, toxic, 900, 100, smoothing=10.0)
    want = [np.log(((t + 1) / 100) / ((c + 9) / 900)) for c, t in zip(clean, toxic)]
    assert np.allclose(got, want) and abs(got[0]) < 1e-12 and abs(got[1]) < 1e-12 and got[3] > got[2] > 1


def test_toxicity_fit_equals_plain_gradient_descent():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(60)]
    y = np.array([float(r[0] < 2) for r in rows])
    scales = np.zeros(1 << toxicity.BITS)
    scales[:40] = rng.normal(size=40)
    at = toxicity._fit(toxicity._Rows([toxicity.zlib.compress(toxicity._bits(r)) for r in rows], scales), y, 0.5, 500)
    x = np.zeros((60, 40))
    for i, r in enumerate(rows):
        x[i, r] = scales[r] / np.sqrt((scales[r] ** 2).sum())
    weight = np.where(y == 1, 30 / y.sum(), 30 / (1 - y).sum())
    w, b = np.zeros(40), 0.0
    for _ in range(60000):
        gap = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 0.05 * (x.T @ gap + 0.5 * w), b - 0.05 * gap.sum()
    assert np.abs(at[:40] - w).max() < 0.02 and abs(at[-1] - b) < 0.02 and not at[40:-1].any()


def test_toxicity_threshold_equals_trying_all():
    rng = np.random.default_rng(3)
    for n in (2, 5, 80):
        y = np.r_[0.0, 1.0, rng.integers(0, 2, n)]
        margin = np.round(rng.normal(size=n + 2) + 0.7 * y, 1)
        at = toxicity.threshold(y, margin, 0.1)
        gain = lambda t: (margin[y == 1] > t).mean() - (margin[y == 0] > t).mean()
        tried = [t for t in np.arange(-9, 9, 0.05) + 0.01 if (margin[y == 0] > t).mean() <= 0.1] + [0.0]
        assert (at == 0 or (margin[y == 0] > at).mean() <= 0.1) and abs(gain(at) - max(map(gain, tried))) < 1e-9


def test_toxicity_on_the_given_labels(spark):
    from tracelake.llm import queries

    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_toxicity"](spark, folder).collect()}
    known = [(r["toxic"], got[r["doc_id"]]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    for label, least in ((0, 0.98), (1, 0.6)):
        right = [r["predicted"] == label for t, r in known if t == label and r["held_out"]]
        assert sum(right) >= least * len(right)


def test_toxicity_learns_many_rare_terms(spark):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    words, terms = [word(rng.randrange(2, 9)) for _ in range(2000)], [word(8) for _ in range(400)]
    rows = []
    for i in range(3000):
        text = [rng.choice(words) for _ in range(rng.randrange(100, 300))]
        for _ in range(2 * (i % 2)):
            text.insert(rng.randrange(len(text)), rng.choice(terms))
        rows.append((i, " ".join(text), i % 2))
    docs = spark.createDataFrame(rows, "key long, text string, label int").repartition(8)
    model = toxicity.train(docs.where("key < 2400").select("text", "label", "key"))
    got = {r["key"]: r["score"] >= 0.5 for r in toxicity.score(docs.where("key >= 2400"), model).collect()}
    assert sum(got[i] for i in got if i % 2) >= 0.9 * 300
    assert sum(not got[i] for i in got if not i % 2) >= 0.9 * 300


def test_long_texts_have_the_n_grams_of_their_pieces(monkeypatch):
    from tracelake.llm import ngrams

    text = "Abc déf, 12 ghi! " * 40
    grams = lambda n: np.sort(np.concatenate(list(ngrams.hashed(text, (n,), 16))))
    whole = [grams(n) for n in (1, 3, 5)]
    monkeypatch.setattr(ngrams, "PIECE", 50)
    assert all(np.array_equal(grams(n), w) for n, w in zip((1, 3, 5), whole))


def test_language(spark):
    rng = random.Random(10)
    stems = {"de": ["schaft", "ung", "heit", "ver"], "en": ["tion", "ing", "the", "ness"], "fr": ["eau", "ent", "oi", "ais"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    model = language.train(df.where("doc_id < 150").select("text", "lang", F.col("doc_id").alias("key")))
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows[150:]]
    assert sum(held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? ²"), (4, "漢字"), (4, "漢字"), (5, "x" * 2_200_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[4]["lang_pred"] in stems
    assert found[4]["rejected"] and found[1]["rejected"]
    assert language.identify(odd.limit(0), model).collect() == []
    empty = language.train(df.limit(0).select("text", "lang", F.col("doc_id").alias("key")))
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    unlabelled = df.select("text", F.lit(None).cast("string").alias("lang"), F.col("doc_id").alias("key"))
    assert language.train(unlabelled).languages == []


def test_texts_of_unlearned_scripts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs.where("doc_id % 3 <> 1").select("text", "lang", F.col("doc_id").alias("key")))
    rng, rows = random.Random(5), []
    for i, (lo, hi) in enumerate([(0x4E00, 0x9FA0), (0x430, 0x450), (0x3B1, 0x3CA)]):
        for n in (300, 1000, 5000, 20000):
            rows.append((10 * i + n, "".join(chr(rng.randrange(lo, hi)) if rng.random() < 0.85 else " " for _ in range(n))))
    for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        assert r["rejected"] and r["score"] < 0.2
    known = language.identify(docs.where("doc_id % 3 = 1"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in known if r["lang"]) >= 0.98 * sum(r["lang"] is not None for r in known)
    assert sum(r["rejected"] for r in known) <= 0.02 * len(known)


def test_every_language_of_many_gets_a_centroid(spark):
    df = spark.range(6000).select(F.col("id").alias("key"), F.concat(F.lit("text number "), F.col("id") % 5000).alias("text"),
                                  F.concat(F.lit("l"), F.col("id") % 5000).alias("lang"))
    assert len(set(language.train(df).languages)) == 5000


def vectors():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 24)) * rng.uniform(0.5, 2.0, (900, 1))
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    common = rows[3][1]
    rows += [(2000 + i, common) for i in range(300)]  # one vector a third of the rows have
    bad = [(5000, None), (5020, []), (5040, [0.0] * 24), (5060, [None] + [1.0] * 23), (5080, [float("nan")] * 24),
           (5100, [float("inf")] * 24), (5120, [1.0, 2.0]), (None, common)]
    return rows, bad


def test_search_recall_ties_and_edges(spark):
    rows, bad = vectors()
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + bad + rows[:2]],
                               "vec_id long, embedding array<double>, rank int, score double")
    out = ann.search(df, F.col("vec_id") % 20 == 0, block=256, chunk=16).collect()
    rows = rows + rows[:2]  # repeated rows are rows of their own
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    by = {}
    for r in out:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i, q in enumerate(ids) if q % 20 == 0]
    assert sorted(by) == sorted({ids[i] for i in queries})
    hits = 0
    for i in queries:
        score = (x * x[i]).sum(axis=1)
        others = np.arange(len(ids)) != i
        best = sorted(zip(-score[others], ids[others]))[:20]
        copies = int((ids == ids[i]).sum())
        found = sorted(by[ids[i]])[::copies]
        assert [r for r, _, _ in found] == list(range(1, 21)) and len(by[ids[i]]) == 20 * copies
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        exact = dict(zip(ids, score))
        assert all(abs(s - exact[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for _, v in best})
    assert hits >= 0.9 * 20 * len(queries)


def test_search_meets_all_rows_of_an_id_and_all_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.99, 0.0]), (20, [1.0, 0.0, 0.0]), (21, [2.0, 1.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == [
        (0, 1, 1, 0.99), (0, 2, 1, 0.9), (20, 1, 21, 2.0)]


def test_search_small_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-5.0, 0.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    out = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(out) == [(0, 1, 20), (0, 2, 1), (0, 3, 2), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert ann.search(few.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_probe_order_is_by_expected_score():
    order = ann.probe_order(4, 40)
    assert order[0] == () and order[1] == (1,) and len(set(order)) == 40
    assert all(9 - j not in ranks for ranks in order for j in ranks)
