"""Chat formatting of reply trees.

Messages form trees through their parents.  Paths from the root to a leaf are
enumerated by iterative self-joins in doubling steps: a table of 2**k-th
ancestors is joined with itself, and the (leaf, ancestor) pairs known so far
with it, so a path of n messages takes log2 n rounds.  Leaves are ranked within
their tree by score (the sum over their path, then length, then message id) and
the best ``paths`` of each tree are formatted, one conversation each.

Template: ``[INST] text [/INST]`` for the user, ``<s>text</s>`` for the
assistant, ``<<role>>text<</role>>`` for any other role.  Inside texts every
control string gets a backslash after its first character (``<\\s>``), one
already there another, so no text can end or open a turn and unescaping gives
the text back.  The loss mask covers the assistant texts.

Defined results: a null text is empty, a null role the role ``none``; a
message whose parent is missing is a root; null ids of trees and messages are
one id, the least; of rows with one id (repeated rows) the one least by parent,
role, text and score is the message; messages whose parents form a cycle, and
what answers them, have no root and are left out; a very long text is one turn
like any other; ties between branches go to the smaller message id; an empty
table gives an empty result; columns besides those named are not carried.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch

_ESCAPE = re.compile(r"([<\[])(\\*)(/?(?:INST\]|s>|<))")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(/?(?:INST\]|s>|<))")
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|<<((?:(?!>>).)*)>>(.*?)<</\3>>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _role_name(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace(">", "\\g")


def _role_of(name: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: ">" if m[1] == "g" else m[1], name))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string, and the spans of it under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "user":
            head, tail = "[INST] ", " [/INST]"
        elif role == "assistant":
            head, tail = "<s>", "</s>"
            spans.append((at + len(head), at + len(head) + len(body)))
        else:
            name = _role_name(role)
            head, tail = f"<<{name}>>", f"<</{name}>>"
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a conversation's string; fails on anything that is not one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        if m[1] is not None:
            turns.append(("user", unescape(m[1])))
        elif m[2] is not None:
            turns.append(("assistant", unescape(m[2])))
        else:
            turns.append((_role_of(m[3]), unescape(m[4])))
        at = m.end()
    return turns


def chain_by_turn(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations as trees: every row answers the row before it by turn.

    Rows of one turn follow by role and text.  Message ids are (conv_id, place).
    """
    order = Window.partitionBy("tree_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.col(conv_id).cast("long").alias("tree_id"), F.col(turn).cast("long").alias("turn"), "role", "text")
    placed = rows.withColumn("msg_id", F.row_number().over(order).cast("long"))
    return placed.select("tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


_LEAST = -(2**63)


def distinct_messages(messages: DataFrame) -> DataFrame:
    """(tree_id, msg_id, parent_id, role, text, score), one row an id and no nulls but in parent_id."""
    ids = [F.coalesce(F.col(c).cast("long"), F.lit(_LEAST)).alias(c) for c in ("tree_id", "msg_id")]
    rows = messages.select(*ids, F.col("parent_id").cast("long").alias("parent_id"), F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    return rows.groupBy("tree_id", "msg_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("m")).select("tree_id", "msg_id", "m.*")


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree_id, leaf_id, branch, msg_id, depth) of the chosen root-to-leaf paths.

    messages: tree_id, msg_id (once each, not null), parent_id, score; ids count
    within a tree.  branch: rank of the path in its tree, 1 the best; ``best``
    keeps that many.
    """
    scratch = Scratch(messages.sparkSession)
    nodes = scratch.put(messages.select("tree_id", "msg_id", "parent_id", "score"), "nodes")
    have = nodes.select("tree_id", F.col("msg_id").alias("parent_id"))
    edges = nodes.join(have, ["tree_id", "parent_id"], "left_semi").select("tree_id", "msg_id", F.col("parent_id").alias("up"))
    # ancestors at distances 1, 2, 4, ...; no path is longer than its tree has messages, so what is left by then stands on a cycle
    most = nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    jumps = [scratch.put(edges, "jump")]
    while not jumps[-1].isEmpty() and 1 << len(jumps) - 1 < most:
        far = jumps[-1].select("tree_id", F.col("msg_id").alias("up"), F.col("up").alias("top"))
        jumps.append(scratch.put(jumps[-1].join(far, ["tree_id", "up"]).select("tree_id", "msg_id", F.col("top").alias("up")), "jump"))
    leaves = nodes.select("tree_id", "msg_id").join(jumps[0].select("tree_id", F.col("up").alias("msg_id")), ["tree_id", "msg_id"], "left_anti")
    rooted_leaves = leaves.join(jumps[-1].select("tree_id", "msg_id"), ["tree_id", "msg_id"], "left_anti")
    known = scratch.put(rooted_leaves.select("tree_id", F.col("msg_id").alias("leaf_id"), "msg_id", F.lit(0).cast("long").alias("above")), "0")
    for k, jump in enumerate(jumps[:-1]):
        # ancestors at distance 0 .. 2**k - 1 are known; their 2**k-th ancestors follow
        more = known.join(jump, ["tree_id", "msg_id"]).select("tree_id", "leaf_id", F.col("up").alias("msg_id"), (F.col("above") + (1 << k)).alias("above"))
        known = scratch.put(known.unionByName(more), str(k + 1))
        scratch.drop(str(k))
    scratch.drop("jump")
    whole = known.join(nodes, ["tree_id", "msg_id"])
    scored = whole.groupBy("tree_id", "leaf_id").agg(F.sum("score").alias("path_score"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("path_score"), F.desc("n"), "leaf_id"))
    ranked = scored.withColumn("branch", rank)
    if best is not None:
        ranked = ranked.where(F.col("branch") <= best)
    return known.join(ranked.select("tree_id", "leaf_id", "branch", "n", "path_score"), ["tree_id", "leaf_id"]).select(
        "tree_id", "leaf_id", "branch", "path_score", "msg_id", (F.col("n") - F.col("above")).alias("depth")
    )


FORMATTED = "tree_id long, leaf_id long, branch int, path_score double, formatted string, loss_spans array<struct<start:int,stop:int>>"


def format_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One row per chosen path: its string and the spans under the loss mask."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    once = Scratch(messages.sparkSession).put(distinct_messages(messages), "messages")
    turns = paths(once, best).join(once.select("tree_id", "msg_id", "role", "text"), ["tree_id", "msg_id"])
    grouped = turns.groupBy("tree_id", "leaf_id", "branch", "path_score").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(FORMATTED))]

    def run(batches):
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(4).to_pylist()]
            columns = [*(batch.column(i) for i in range(4)), pa.array([d[0] for d in done], types[4]), pa.array([[{"start": a, "stop": b} for a, b in d[1]] for d in done], types[5])]
            yield pa.RecordBatch.from_arrays(columns, names=["tree_id", "leaf_id", "branch", "path_score", "formatted", "loss_spans"])

    return grouped.mapInArrow(run, FORMATTED)


READ_BACK = "tree_id long, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest their turns and loss text."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
                for col, x in zip(out, (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["tree_id", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("tree_id", "branch", "formatted", "loss_spans").mapInArrow(run, READ_BACK)


def probe_rows(spark: SparkSession) -> DataFrame:
    """Conversation -7: texts that look like the template."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
