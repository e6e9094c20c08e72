"""Chat formatting over reply trees: iterative self-joins enumerate root-to-leaf paths, scores rank them, a template formats each.

Paths are found by pointer doubling: after k joins a message knows its ancestor 2^k steps up, so a thread of n turns
takes log2(n) joins, over rows without texts. Texts are joined to the chosen paths only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

START, END = "<|im_start|>", "<|im_end|>"
#: Roles whose texts are under the loss mask.
LOSS_ROLES = ("assistant",)


def escape(text: str, line: bool = False) -> str:
    """Reversible: after it, the text holds no ``<|``; with ``line``, line ends are marked too."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\\n") if line else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of it (code points) that are under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role, line=True)}\n", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the formatted text."""
    turns = []
    for part in formatted.split(START)[1:]:
        head = ROLE.match(part)
        if not head or not part.endswith(f"{END}\n"):
            raise ValueError("not a formatted conversation")
        turns.append((unescape(head[1]), unescape(part[head.end() : -len(END) - 1])))
    return turns


def reply_paths(messages: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """(tree, leaf, node, up): for each leaf, the nodes on its path to the root; up: steps above the leaf.

    ``messages``: (tree, node, parent), node unique within its tree. A message whose parent is null or not there is a
    root. Trees of any depth: the number of joins grows with its logarithm. Raises ValueError where parents form a cycle.
    """
    nodes = messages.select("tree", "node", "parent")
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    jump = nodes.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_there"), F.col("parent")).alias("to"))
    jump = written(jump, "jump")
    inner = jump.where("to is not null").select("tree", F.col("to").alias("node")).distinct()
    paths = written(jump.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "leaves")
    n = nodes.count()
    for k in range(max_rounds):
        alive = jump.where("to is not null")
        if alive.isEmpty():
            if n and paths.isEmpty():
                raise ValueError("parents form a cycle")
            return paths
        if 1 << k > n:
            break
        step = paths.join(alive, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = written(paths.union(step), "paths")
        far = alive.select("tree", F.col("node").alias("to"), F.col("to").alias("_next"))
        jump = written(alive.join(far, ["tree", "to"]).select("tree", "node", F.col("_next").alias("to")), "jump")
    raise ValueError("parents form a cycle")


def format_trees(messages: DataFrame, *, best: int | None = None, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(tree, leaf, score, rank, n_turns, text, loss): each chosen root-to-leaf path as one formatted conversation.

    ``messages``: tree, node, parent, role, text, score; other columns are ignored. Paths of a tree are ranked by the mean score of
    their messages (null: 0), ties by leaf; ``best``: how many to keep (None: all). ``loss``: spans of ``text``, in code
    points, that are under the loss mask. Null roles and texts are empty; a null tree is a tree, a message without a node is left out.
    A path is one record, so it must fit in memory. No messages: no rows.
    """
    # A struct is never null, so that joins find the null tree too.
    messages = messages.where("node is not null").select(F.struct("tree").alias("tree"), "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    paths = reply_paths(messages)
    scored = paths.join(messages.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf"))
    scored = scored.withColumn("rank", rank)
    if best is not None:
        scored = scored.where(F.col("rank") <= best)
    turns = paths.join(scored, ["tree", "leaf"]).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    turn = F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("tree", "leaf", "score", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.select("tree.tree", "leaf", "score", "rank", "turns")
    schema = f"tree {dict(whole.dtypes)['tree']}, leaf {dict(whole.dtypes)['leaf']}, score double, rank int, n_turns long, text string, loss array<struct<start:bigint,stop:bigint>>"

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            turns = batch.column("turns").to_pylist()
            done = [render([(t["role"], t["text"]) for t in x], loss_roles) for x in turns]
            out = [batch.column(c) for c in ("tree", "leaf", "score", "rank")]
            out += [pa.array([len(x) for x in turns], pa.int64()), pa.array([x for x, _ in done], pa.string())]
            out.append(pa.array([[{"start": a, "stop": b} for a, b in s] for _, s in done], spans))
            yield pa.RecordBatch.from_arrays(out, ["tree", "leaf", "score", "rank", "n_turns", "text", "loss"])

    return whole.mapInArrow(rendered, schema)


def as_tree(rows: DataFrame, tree: Column, order: list[Column]) -> DataFrame:
    """A plain thread as a tree: each row of ``tree`` (role, text kept) answers the one before it in ``order``; equal rows follow one another."""
    rows = rows.select(tree.alias("tree"), "role", "text", *[c.alias(f"_o{k}") for k, c in enumerate(order)])
    at = F.row_number().over(Window.partitionBy("tree").orderBy(*[f"_o{k}" for k in range(len(order))], "role", "text"))
    rows = rows.withColumn("node", at.cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
