"""Alignment of tokenizers against plain loops over the public libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tracelake.llm")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
vocabularies = pytest.importorskip("public_tokenizers")

from tracelake.llm import alignment  # noqa: E402

A, B = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(5)
    signs = [chr(c) for c in range(0x250)] + list("  \n\t  　あ中😀́٠Ⅰ") + [" "] * 150 + list("abcdefgh") * 20
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(120))) for _ in range(150)]
    words = ["the", "tokenization", "réseau", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "  ", "\n\n", "12345", "aaaaaaaaaaaaaaa", "中文字"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(150)]
    return out + [None, "", " ", "  ", "\n", "a▁b", "▁", "x" * 3000, "ab" * 900 + "中" * 300, " " * 500 + "end ", "word " * 4000, "\x00a"]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    names = [b.id_to_piece(i) for i in range(b.vocab_size())]
    piece = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(text):
        e = a.encode(" " + text, add_special_tokens=False)
        ids = b.encode(text)
        return [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens)], [(i, piece[i]) for i in ids]

    return encode


def plain(text, encode):
    """Groups, links and group digest of a text by loops over the bytes."""
    left, right = encode(text) if text else ([], [])
    want = (" " + (text or "")).encode()
    if not text or any(b"".join(x for _, x in side) != want for side in (left, right)):
        return 0, 0, [], [], []

    def spans(side):
        out, at = [], 0
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    left, right = spans(left), spans(right)
    cuts = sorted({e for *_, e in left} & {e for *_, e in right})
    groups = [([i for i, _, e in left if lo < e <= hi], [i for i, _, e in right if lo < e <= hi])
              for lo, hi in zip([0, *cuts], cuts)] if len(left) < 500 else None
    links, k = [], 0
    for i, s, e in left:
        while right[k][2] <= s:
            k += 1
        j = k
        while j < len(right) and right[j][1] < e:
            links.append((i, right[j][0]))
            j += 1
    if groups is None:
        groups, at, k = [], 0, 0
        for hi in cuts:
            one, two = [], []
            while at < len(left) and left[at][2] <= hi:
                one.append(left[at][0])
                at += 1
            while k < len(right) and right[k][2] <= hi:
                two.append(right[k][0])
                k += 1
            groups.append((one, two))
    return len(left), len(right), groups, links, cuts


def digest(groups):
    return hashlib.sha256(";".join("|".join(",".join(map(str, side)) for side in g) for g in groups).encode()).hexdigest() if groups else ""


def plain_rows(rows, encode):
    found = [(i, *plain(t, encode)) for i, t in rows]
    counts = Counter(p for *_, links, _ in found for p in set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(i, n_a, n_b, len(groups), len(links), digest(groups), sum(counts[p] == best[p[0]] for p in links),
             sum(counts[p] for p in links)) for i, n_a, n_b, groups, links, _ in found]


def test_byte_letters_cover_all_bytes():
    assert sorted(alignment.byte_letters().values()) == list(range(256))


@pytest.mark.parametrize("whole", [False, True])
def test_encoders_equal_the_libraries(libraries, whole, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 40)  # tables that are emptied on the way
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        tools = alignment.Aligner(f.read(), g.read())
    assert tools.b.apart
    tools.b.apart = not whole
    given = [t for t in texts() if t and "▁" not in t]
    for encoder, side in ((tools.a, 0), (tools.b, 1)):
        for batch in (given, given[:7], given[::-1]):
            ids, counts = encoder.encode([" " + t for t in batch])
            for t, got in zip(batch, np.split(ids, np.cumsum(counts)[:-1])):
                assert got.tolist() == [i for i, _ in libraries(t)[side]]


def test_division_equals_the_common_ends():
    rng = np.random.default_rng(1)
    for case in range(120):
        n, m = (rng.integers(1, 400, 2) if case % 3 else rng.integers(1, 4, 2))
        length = int(rng.integers(max(n, m), 900))
        ends = [np.sort(np.r_[rng.choice(length - 1, k - 1, replace=False) + 1, length]) if k > 1 else np.array([length])
                for k in (n, m)]
        if case % 4 == 0:  # no shared end inside
            ends[1] = np.r_[np.setdiff1d(ends[1][:-1], ends[0]), length]
        twice = [np.r_[e, e + length] for e in ends]  # two texts end to end
        stops = [np.array([len(e), 2 * len(e)]) for e in ends]
        group_a, group_b = alignment.divide(*twice, *stops)
        common = np.intersect1d(*twice)
        assert twice[0][group_a - 1].tolist() == common.tolist() == twice[1][group_b - 1].tolist()


def test_rows_equal_plain_ones(spark, libraries, monkeypatch):
    rows = list(enumerate(texts())) + [(3, "the réseau"), (3, "the réseau"), (None, "the réseau tokenization")]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows],
                               "doc_id long, text string, n_a int, block int, pairs string").repartition(5)
    aligned = alignment.align(df, A, B)
    size = alignment.vocabulary_size(B)
    got = alignment.link_statistics(aligned, alignment.pair_counts(aligned, size), size).collect()
    want = plain_rows(rows, libraries)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    cuts = {r["doc_id"]: r["cuts"] for r in aligned.where("texts IS NULL").collect()}
    for i, t in rows[:-3]:
        assert i == 3 or cuts[i] == plain(t, libraries)[4]
    none = alignment.align(df.limit(0), A, B)
    assert alignment.link_statistics(none, alignment.pair_counts(none, size), size).collect() == []


def test_blocks_do_not_change_the_counts(spark, libraries):
    from tracelake.llm import queries

    rows = [(i, t) for i, t in enumerate(texts()[140:200] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    size = alignment.vocabulary_size(B)

    def total(aligned):
        return sorted(map(tuple, alignment.link_statistics(aligned, alignment.pair_counts(aligned, size), size).collect()))

    assert total(alignment.align(df, A, B)) == total(alignment.align(df.repartition(16), A, B)) == sorted(plain_rows(rows, libraries))
    assert queries.QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001").columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
