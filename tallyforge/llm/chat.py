"""Chat formatting from a log of events: fold the log into final messages, render them, read them back.

A log holds what streaming leaves behind: a message opens, deltas add to it, an
edit or a regeneration begins its text anew, a deletion withdraws it. The log
is dealt out by conversation and run of messages, sorted by sequence and folded
there; a run has at most RUN message numbers, so one endless conversation is
many tasks' work. Rendered conversations are rows of parts in their order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored
from tallyforge.operators.ordered import POS, in_pieces

#: Message numbers in a part of a conversation, and characters in a delta of a log made from turns.
RUN = 256
DELTA = 256


@dataclass(frozen=True)
class Template:
    """Marks around each turn, by role; other roles carry their name.

    Every mark begins with a character that stands nowhere else in any mark
    but at beginnings, and holds no backslash: so marks can't overlap, and a
    backslash behind the first character both hides a mark inside a text and
    can be taken out again.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    #: Before the name, between name and text, behind the text.
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    learnt: str = "assistant"

    def __post_init__(self) -> None:
        every = self.controls()
        leads = {m[:1] for m in every}
        if len(set(every)) < len(every) or any(len(m) < 2 or "\\" in m or set(m[1:]) & leads for m in every):
            raise ValueError("marks must differ, hold no backslash and no first character of a mark behind their own")

    def controls(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)

    def hidden(self, slashes: str) -> str:
        """Pattern of a control string with backslashes behind its first character."""
        leads, rests = sorted({m[0] for m in self.controls()}), sorted({m[1:] for m in self.controls()})
        return f"([{''.join(map(re.escape, leads))}]){slashes}({'|'.join(map(re.escape, rests))})"

    def escape(self, text: Column) -> Column:
        """One backslash more behind the first character of whatever is a control string but for backslashes there."""
        return F.regexp_replace(text, self.hidden(r"(\\*)"), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.hidden(r"\\(\\*)"), "$1$2$3")

    def head(self, role: Column) -> Column:
        """What stands before a turn's text."""
        out = F.concat(F.lit(self.other[0]), self.escape(role), F.lit(self.other[1]))
        for name, (begin, _) in self.marks.items():
            out = F.when(role == name, F.lit(begin)).otherwise(out)
        return out

    def tail(self, role: Column) -> Column:
        out = F.lit(self.other[2])
        for name, (_, end) in self.marks.items():
            out = F.when(role == name, F.lit(end)).otherwise(out)
        return out

    def turn(self) -> str:
        """Pattern of a turn in a formatted conversation."""
        begins, ends = [self.other[0], *(b for b, _ in self.marks.values())], [self.other[2], *(e for _, e in self.marks.values())]
        return f"(?s)(?:{'|'.join(map(re.escape, begins))}).*?(?:{'|'.join(map(re.escape, ends))})"

    def read(self, turn: Column) -> Column:
        """Role and text of a turn as it stands in a formatted conversation."""
        name, text = F.split_part(turn, F.lit(self.other[1]), F.lit(1)), F.split_part(turn, F.lit(self.other[1]), F.lit(2))
        name = F.substr(name, F.lit(len(self.other[0]) + 1))
        out = F.struct(self.unescape(name).alias("role"), self.unescape(F.left(text, F.length(text) - len(self.other[2]))).alias("text"))
        for role, (begin, end) in self.marks.items():
            inner = F.substr(turn, F.lit(len(begin) + 1), F.length(turn) - len(begin) - len(end))
            out = F.when(turn.startswith(begin), F.struct(F.lit(role).alias("role"), self.unescape(inner).alias("text"))).otherwise(out)
        return out


def turns_as_log(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as the log of their streaming: conv_id, message, seq, kind, role, text.

    Turns are numbered by turn (nulls first), then role and text; numbers rise
    within a conversation and have gaps. Texts come in deltas of DELTA
    characters; one assistant's turn in four, by hash, has a draft that is
    regenerated, and one user's turn in four a draft that an edit replaces.
    """
    placed = in_pieces(rows.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"])
    text = F.coalesce("text", F.lit(""))
    event = lambda kind, said: F.struct(F.lit(kind).alias("kind"), said.alias("text"))
    deltas = lambda said: F.transform(F.regexp_extract_all(said, F.lit(rf"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda d: event("delta", d))
    draft, odd = F.reverse(F.left(text, F.lit(2 * DELTA))), F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col(POS).cast("string"))) % 4 == 0
    streamed = F.when(odd & (F.col("role") == "assistant"), F.concat(deltas(draft), F.array(event("regenerate", F.lit(""))), deltas(text)))
    streamed = streamed.when(odd & (F.col("role") == "user"), F.concat(deltas(draft), F.array(event("edit", text)))).otherwise(deltas(text))
    log = placed.select("conv_id", F.col(POS).alias("message"), "role", F.posexplode(F.concat(F.array(event("message", F.lit(""))), streamed)).alias("seq", "e"))
    return log.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "e.kind", F.when(F.col("e.kind") == "message", F.col("role")).alias("role"), "e.text")


def fold_log(events: DataFrame) -> DataFrame:
    """Final messages of a log: conv_id, part (a run of message numbers), message, role, text.

    Events of a message count in the order of seq (then kind, role, text). The
    text is that of the last message, edit or regenerate event and of the
    deltas behind it; the role that of the last message event; a message whose
    last message or delete event deletes it is gone. Deltas alone make a
    message without a role. Other kinds, nulls among them, do nothing; null
    texts are empty; a null conversation or message number is one of its own.
    """
    dealt = events.select("conv_id", F.expr(f"message DIV {RUN}").alias("part"), "message", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id", "part")
    logs = dealt.groupBy("conv_id", "part", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    begun = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin("message", "edit", "regenerate"), i)))
    told = logs.filter(F.exists("log", lambda e: e["kind"].isin("message", "edit", "regenerate", "delta", "delete"))).withColumn("_begun", F.coalesce(begun, F.lit(0)))
    named = F.filter("log", lambda e: e["kind"].isin("message", "delete"))
    opened = F.filter("log", lambda e: e["kind"] == "message")
    speaking = F.filter("log", lambda e, i: (i >= F.col("_begun")) & e["kind"].isin("message", "edit", "regenerate", "delta"))
    alive = F.coalesce(F.try_element_at(named, F.lit(-1))["kind"], F.lit("message")) == "message"
    return told.filter(alive).select("conv_id", "part", "message", F.try_element_at(opened, F.lit(-1))["role"].alias("role"), F.array_join(F.transform(speaking, lambda e: e["text"]), "").alias("text"))


def format_chats(messages: DataFrame, template: Template) -> DataFrame:
    """Formatted conversations: conv_id, part, formatted, mask.

    The parts of a conversation, put together in order, are its text. `mask` has
    start and length, in characters of the part, of each text that is learnt
    from. A null role is the role without a name; texts are escaped.
    """
    role = F.coalesce("role", F.lit(""))
    each = messages.select("conv_id", "part", "message", template.head(role).alias("head"), template.escape(F.col("text")).alias("said"), template.tail(role).alias("tail"), (role == template.learnt).alias("learnt"))
    parts = each.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("message", "head", "said", "tail", "learnt"))).alias("turns"))
    kind = "struct<at: int, spans: array<struct<start: int, length: int>>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(kind)

    def add(acc: Column, t: Column) -> Column:
        start, length = acc["at"] + F.length(t["head"]), F.length(t["said"])
        span = F.struct(start.alias("start"), length.alias("length"))
        spans = F.when(t["learnt"], F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((start + length + F.length(t["tail"])).alias("at"), spans.alias("spans")).cast(kind)

    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["said"], t["tail"])), "")
    return parts.select("conv_id", "part", formatted.alias("formatted"), F.aggregate("turns", empty, add)["spans"].alias("mask"))


def read_chats(formatted: DataFrame, template: Template) -> DataFrame:
    """Each part's turns (role, text) and the texts under its mask, unescaped: conv_id, part, turns, learnt, formatted_chars."""
    turns = F.transform(F.regexp_extract_all("formatted", F.lit(template.turn()), F.lit(0)), template.read)
    learnt = F.transform("mask", lambda m: template.unescape(F.substr("formatted", m["start"] + 1, m["length"])))
    return formatted.select("conv_id", "part", turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))


def _digest_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one conversation after another, parts in order: a row with sums and digests when a conversation ends. Holds one batch."""
    now, names = None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def out(x: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=names)

    for batch in batches:
        kind = batch.column(0).type
        for i in range(batch.num_rows):
            conv, n, said, chars, loss, size = (batch.column(c)[i].as_py() for c in (0, 1, 2, 3, 4, 5))
            if now is None or now[0] != conv:
                if now is not None:
                    yield out(now)
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1], now[3], now[5] = now[1] + n, now[3] + chars, now[5] + size
            now[2].update(said.encode())
            now[4].update(loss.encode())
    if now is not None:
        yield out(now)


def chat_digests(parts: DataFrame) -> DataFrame:
    """Of what `read_chats` gives, a row for each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation in one part is digested where it is; only those in several
    parts are exchanged, and their digests are computed as parts stream by.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    flat = parts.select("conv_id", "part", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), F.array_join("learnt", "").alias("loss"), "formatted_chars")
    flat = flat.withColumn("loss_chars", F.length("loss").cast("long"))
    long = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("_conv"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    short = flat.join(long, same, "left_anti").select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), "loss_chars", F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    dealt = flat.join(long, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind = parts.schema["conv_id"].dataType.simpleString()
    streamed = dealt.select("conv_id", "n_turns", "said", "loss_chars", "loss", "formatted_chars").mapInArrow(_digest_parts, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return short.unionByName(streamed)


def format_log(events: DataFrame, template: Template | None = None) -> DataFrame:
    """A log's conversations, folded, rendered and stored: conv_id, part, formatted, mask. An empty log gives no rows."""
    return stored(format_chats(fold_log(events), template or Template()), "chats")
