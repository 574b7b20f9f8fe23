"""Chat formatting over a prefix tree.

Conversations sort by the digests of their turns, which puts those that share
initial turns side by side: the sorted order is a depth-first walk of the tree
of all turns.  Each task walks its range of that order and fills packs.  Within
a pack every tree node (a turn after a given history) is emitted once, with

* the span of its text in the pack,
* the position of its first character in its own conversation (position ids
  run on from there), and
* the intervals of the pack that it may attend to: its ancestors, then itself.

A pack closes at ``pack_chars`` characters or ``pack_conversations``
conversations, so no task holds more than one pack; the next pack repeats the
ancestors that it still needs.  Ranges are cut by path and conversation, so
even one conversation repeated over a third of all rows spreads over tasks.

The template is ``<|turn|>role<|text|>text<|end|>``.  In roles and texts a
backslash is doubled and a control string gets a backslash after its first
character; ``unescape`` removes them again.  Turns sort by number (null
first), then role and text; null roles and texts are empty, repeated rows are
turns of their own.  A row with a null ``conv_id`` is a conversation of its
own.  Texts are formatted whole, whatever their length; a conversation lies in one row.  Extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, parts_for

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not appear inside a formatted text: the template's own and those of common chat formats.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BREAK = re.compile(r"\\|" + "|".join(re.escape(x) for x in CONTROL))
_MEND = re.compile(r"\\(.)", re.DOTALL)
PACK_CHARS = 1 << 18
PACK_CONVERSATIONS = 4096


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    # A doubled backslash mends to one; any other backslash vanishes.
    return _MEND.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.removesuffix(END).partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


_NODE = "struct<start: long, length: long, position: long, loss_start: long, loss_length: long, attends: array<struct<start: long, stop: long>>>"
PACKS = f"text string, nodes array<{_NODE}>, conversations array<struct<conv_id: long, leaf: int>>"
_ARROW_INTERVAL = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_ARROW_NODE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("loss_start", pa.int64()), ("loss_length", pa.int64()), ("attends", pa.list_(_ARROW_INTERVAL))])
_ARROW_PACKS = pa.schema([("text", pa.string()), ("nodes", pa.list_(_ARROW_NODE)), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])))])


class _Pack:
    def __init__(self):
        self.texts, self.nodes, self.conversations, self.length = [], [], [], 0

    def grow(self, role: str, text: str, parent: int | None) -> int:
        """Emit a node below ``parent``; returns its number."""
        piece = format_turn(role, text)
        above = self.nodes[parent] if parent is not None else None
        attends = [dict(x) for x in above["attends"]] if above else []
        if attends and attends[-1]["stop"] == self.length:
            attends[-1]["stop"] = self.length + len(piece)
        else:
            attends.append({"start": self.length, "stop": self.length + len(piece)})
        body = len(TURN) + len(escape(role)) + len(TEXT)
        self.nodes.append({
            "start": self.length, "length": len(piece), "position": above["position"] + above["length"] if above else 0,
            "loss_start": self.length + body, "loss_length": len(piece) - body - len(END) if role == "assistant" else 0, "attends": attends,
        })
        self.texts.append(piece)
        self.length += len(piece)
        return len(self.nodes) - 1

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"text": ["".join(self.texts)], "nodes": [self.nodes], "conversations": [self.conversations]}, schema=_ARROW_PACKS)


def pack(turns: DataFrame, pack_chars: int = PACK_CHARS, pack_conversations: int = PACK_CONVERSATIONS) -> DataFrame:
    """Packs of the prefix tree over ``turns (conv_id, turn, role, text)``."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A null identifier names no conversation: its rows are grouped by a number of their own.
    conversation, alone = F.col("conv_id").cast("long"), F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    named = turns.select(conversation.alias("conv_id"), alone.alias("alone"), F.col("turn"), F.col("role"), F.col("text"))
    whole = named.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    one = lambda x: F.substring(F.md5(F.concat(x["role"], F.lit("\n"), x["text"])), 1, 16)
    keyed = materialize(whole.drop("alone").withColumn("path", F.array_join(F.transform("turns", one), "")), "conversations")

    def walk(batches):
        now, line, nodes = _Pack(), [], []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, conversation in enumerate(batch.column(1).to_pylist()):
                mine = [(x["role"], x["text"]) for x in conversation]
                if now.conversations and (now.length >= pack_chars or len(now.conversations) >= pack_conversations):
                    yield now.batch()
                    now, line, nodes = _Pack(), [], []
                shared = 0
                while shared < min(len(line), len(mine)) and line[shared] == mine[shared]:
                    shared += 1
                line, nodes = mine, nodes[:shared]
                for role, text in mine[shared:]:
                    nodes.append(now.grow(role, text, nodes[-1] if nodes else None))
                now.conversations.append({"conv_id": ids[i], "leaf": nodes[-1] if nodes else -1})
        if now.conversations:
            yield now.batch()

    parts = parts_for(keyed, F.coalesce(F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["text"])), F.lit(0)))
    ordered = keyed.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")
    return ordered.mapInArrow(walk, PACKS)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ARROW_READ = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _READ.split(", ")])


def read_packs(packs: DataFrame) -> DataFrame:
    """Per conversation what its packed text says, read along the leaf's attention intervals."""

    def run(batches):
        for batch in batches:
            for text, nodes, conversations in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                loss_at = sorted((n["loss_start"], n["loss_length"]) for n in nodes if n["loss_length"])
                starts = [a for a, _ in loss_at]
                known: dict[int, tuple] = {}
                columns = [[] for _ in _ARROW_READ]
                for c in conversations:
                    if c["leaf"] not in known:
                        known[c["leaf"]] = _digest(text, nodes[c["leaf"]]["attends"] if c["leaf"] >= 0 else [], loss_at, starts)
                    for column, x in zip(columns, (c["conv_id"], *known[c["leaf"]]), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _ARROW_READ, strict=True)], schema=_ARROW_READ)

    return packs.mapInArrow(run, _READ)


def _digest(text: str, attends: list[dict], loss_at: list[tuple[int, int]], starts: list[int]) -> tuple:
    from bisect import bisect_left

    formatted, loss = [], []
    for x in attends:
        formatted.append(text[x["start"] : x["stop"]])
        for a, n in loss_at[bisect_left(starts, x["start"]) : bisect_left(starts, x["stop"])]:
            loss.append(unescape(text[a : a + n]))
    whole, learnt = "".join(formatted), "".join(loss)
    turns = parse_turns(whole)
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(whole)
