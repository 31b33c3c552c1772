"""Chats: the log against a plain fold, the format read back, digests against Python."""

import hashlib
import random

import pytest

from tallyforge.llm import chat
from tallyforge.llm.chat import Template, chat_digests, fold_log, format_chats, format_log, read_chats, turns_as_log
from tallyforge.llm.queries import ORACLES, op11_chat_format

LOG = "conv_id long, message long, seq long, kind string, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fold(events):
    """One event after another, a state for each message."""
    state = {}
    for conv, message, _, kind, role, text in sorted(events, key=lambda e: tuple((x is not None, x) for x in e)):
        now = state.setdefault((conv, message), {"role": None, "text": "", "alive": True, "known": False})
        if kind in ("message", "edit", "regenerate", "delta", "delete"):
            now["known"] = True
        if kind == "message":
            now.update(role=role, text=text or "", alive=True)
        elif kind in ("edit", "regenerate"):
            now["text"] = text or ""
        elif kind == "delta":
            now["text"] += text or ""
        elif kind == "delete":
            now["alive"] = False
    return {k: (v["role"], v["text"]) for k, v in state.items() if v["alive"] and v["known"]}


def test_fold_is_the_plain_fold(spark):
    rng = random.Random(3)
    events = [(rng.choice([1, 2, None]), rng.choice([0, 1, 300, None]), rng.randrange(50), rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete", "noise", None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b ", "", None])) for _ in range(300)]
    got = fold_log(spark.createDataFrame(events, LOG)).collect()
    assert {(r.conv_id, r.message): (r.role, r.text) for r in got} == plain_fold(events)
    assert fold_log(spark.createDataFrame([], LOG)).count() == 0 and format_log(spark.createDataFrame([], LOG)).count() == 0


def test_templates_hide_every_mark(spark):
    t = Template()
    rng = random.Random(4)
    bits = [*t.controls(), *[m[1:] for m in t.controls()], "\\", "<", "[", "\n", "x", "é", "𝄞", "</", "$1", "\\\\"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(600)] + ["", "<s>" * 5000, "[" * 3000 + "\\" * 3000 + "INST]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    from pyspark.sql import functions as F

    for r in df.select("text", t.escape(F.col("text")).alias("e"), t.unescape(t.escape(F.col("text"))).alias("u")).collect():
        assert r.u == r.text and not any(m in r.e for m in t.controls())
    messages = spark.createDataFrame([(1, 0, i, rng.choice(["system", "user", "assistant", "tool", "", None, "[TEXT]\\<s>"]), x) for i, x in enumerate(texts)], "conv_id long, part long, message long, role string, text string")
    back = read_chats(format_chats(messages, t), t).first()
    want = messages.orderBy("message").collect()
    assert [(r.role, r.text) for r in back.turns] == [(r.role or "", r.text) for r in want]
    assert back.learnt == [r.text for r in want if r.role == "assistant"]
    for bad in ({"user": ("[A]", "[A]")}, {"user": ("[A[", "[B]")}, {"user": ("[\\A]", "[B]")}, {"user": ("[", "[B]")}):
        with pytest.raises(ValueError):
            Template(marks=bad)


def want_digest(rows):
    rows = [((r[2] or ""), (r[3] or "")) for r in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r[1:]))]
    said, loss = "".join(f"{a}\n{b}\n" for a, b in rows), "".join(b for a, b in rows if a == "assistant")
    return len(rows), sha(said), len(loss), sha(loss)


def test_query_against_python_and_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    got = {r.conv_id: r for r in op11_chat_format(spark, d).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: want_digest(v) for k, v in by.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    assert {r[0]: r for r in con.sql(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({ORACLES['op11_chat_format']})").fetchall()} == {k: tuple(r) for k, r in got.items()}


def test_odd_rows_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 8)
    rng = random.Random(6)
    rows = [(1, i // 2 if i % 9 else None, rng.choice(["user", "assistant", "tool", None, ""]), rng.choice(["same", "", None, f"t{i} <s>", "x" * 2000])) for i in range(120)]
    rows += [(None, 0, "user", "hi"), (None, None, None, None), (2, 5, "user", "again"), (2, 5, "user", "again"), (3, 1, "assistant", "long " * 40000)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, message string, part int")
    t = Template()
    got = chat_digests(read_chats(format_log(turns_as_log(df), t), t)).collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert len(got) == 4 and {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {k: want_digest(v) for k, v in by.items()}
    assert format_log(turns_as_log(df), t).groupBy("conv_id").count().filter("count > 1").count() >= 1
    assert chat_digests(read_chats(format_log(turns_as_log(df.limit(0)), t), t)).count() == 0
