"""Chat formatting: round trips, masks and attachments against plain Python, and the query against SQL."""

import math
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tracelake.llm")

from tracelake.llm import chat  # noqa: E402

T = chat.Template()
SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string, start int, position int"


def plain_escape(text):
    firsts = {c[0] for c in T.controls}
    out = ""
    for i, sign in enumerate(text):
        out += sign
        if sign == "\\" or sign in firsts and any(text.startswith(c, i) for c in T.controls):
            out += "\\"
    return out


def texts():
    rng = random.Random(1)
    bits = [*T.controls, "\\", "\\\\", "<", "[", "|>", "s>", "<s", "INST]", "</", "\\s>", "é", "\n", " ", "ok", "𝄞", "$1"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)] + ["", "\\", "x" * 50000, "</s>" * 5000]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    e = chat.escape(F.col("t"), T)
    for r in df.select("t", e.alias("e"), chat.unescape(e).alias("back")).collect():
        assert r["e"] == plain_escape(r["t"]) and r["back"] == r["t"]
        assert not any(c in T.close + r["e"] + T.close and c in r["e"] for c in T.controls)


def test_template_refuses_what_it_can_not_escape():
    for bad in ({"open": "<"}, {"close": "<x<"}, {"sep": "\\end"}, {"foreign": ("a<",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return kind, text, ref, width, height, seconds, pages


def turns():
    rng, pool = random.Random(3), texts()
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            parts = [rng.choice([part("text", rng.choice(pool[:300])), part("text", ""), part(None, "no kind"),
                                 part("image", ref=f"i{turn}", width=rng.choice([None, 1, 28, 29, 400]), height=60),
                                 part("audio", ref="a", seconds=rng.choice([None, 0.0, 1.01])),
                                 part("document", ref="d", pages=rng.choice([None, 3])), part("video", ref="v")])
                     for _ in range(rng.randrange(4))]
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "</s>\n", None]), parts))
    rows += [(100, 0, "user", None), (100, None, "assistant", [part("text", "first")]), (100, 0, "user", None),
             (None, 0, "assistant", [part("text", pool[-1]), part("text", "x")]), (None, 1, "user", [])]
    return rows


def plain_tokens(p):
    kind, _, _, width, height, seconds, pages = p
    if kind == "image":
        return max(1, math.ceil((width or 0) / 28)) * max(1, math.ceil((height or 0) / 28))
    return {"audio": math.ceil((seconds or 0) * 25), "document": (1 if pages is None else pages) * 512}.get(kind, 1)


def plain_parts(parts):
    """Read back: empty texts are gone and texts side by side are one."""
    out = []
    for p in parts or []:
        if p[0] in (None, "text"):
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + p[1], None)
            elif p[1]:
                out.append(("text", p[1], None))
        else:
            out.append((p[0], None, p[2]))
    return out


def plain_turn(role, parts):
    body = "".join(plain_escape(p[1]) if p[0] in (None, "text") else dict(
        image=T.image, audio=T.audio, document=T.document).get(p[0], T.other) for p in parts or [])
    return T.open + plain_escape(role or "") + T.sep, body, T.close


def test_turns_conversations_and_their_reading(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(4)
    out = chat.format_turns(df)
    out = out.withColumn("back", chat.read_parts(F.col("formatted"), F.col("attachments"))).withColumn(
        "learnt", chat.masked(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))).cache()
    got = {}
    for r in out.orderBy("conv_id", "position").collect():
        got.setdefault(r["conv_id"], []).append(r)
    want = {}
    for conv, turn, role, parts in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", "".join(plain_turn(role, parts)), parts))
    assert sorted(got, key=str) == sorted(want, key=str)
    for conv, rs in got.items():
        start = 0
        for i, (r, (_, turn, role, text, parts)) in enumerate(zip(rs, sorted(want[conv], key=lambda x: x[:4]), strict=True)):
            assert (r["position"], r["start"], r["formatted"]) == (i, start, text)
            start += len(text)
            assert [(p["type"], p["text"], p["ref"]) for p in r["back"]] == plain_parts(parts)
            assert [(a["ordinal"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
                (k, p[0], p[2], plain_tokens(p)) for k, p in enumerate(
                    [p for p in parts or [] if p[0] not in (None, "text")])]
            _, body, _ = plain_turn(role, parts)
            assert r["loss_chars"] == (len(body) if role == "assistant" else 0)
            if role == "assistant" and not r["attachments"]:
                assert r["learnt"] == "".join(p[1] for p in parts or [])
    for r in chat.assemble(out).withColumn("read", chat.read_conversation(F.col("formatted"))).collect():
        rs = got[r["conv_id"]]
        assert r["formatted"] == "".join(x["formatted"] for x in rs)
        assert [x["role"] for x in r["read"]] == [x[2] for x in sorted(want[r["conv_id"]], key=lambda x: x[:4])]
        assert [r["formatted"][a["start"]:a["stop"]] for a in r["loss"]] == [
            x["formatted"][x["loss_start"]:x["loss_start"] + x["loss_chars"]] for x in rs if x["loss_start"] is not None]
        assert len(r["attachments"]) == sum(len(x["attachments"]) for x in rs)
        assert r["attachment_tokens"] == sum(a["tokens"] for x in rs for a in x["attachments"])
    assert chat.assemble(chat.format_turns(df.limit(0))).collect() == []


def test_query_equals_sql_without_python_workers(spark):
    from tools.check_oracle import duck
    from tracelake.llm import queries

    folder = "/root/testdata/sf0.001"
    want = duck(folder).execute(queries.ORACLES["op12_chat_format"])
    got = queries.QUERIES["op12_chat_format"](spark, folder)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
