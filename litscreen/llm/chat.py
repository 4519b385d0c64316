"""Chat formatting of reply trees, with DataFrame functions only.

A message replies to its parent; a conversation is the path from a root to a
leaf. Iterative self-joins double, in each round, how far every message sees
towards its root, so the number of rounds is the logarithm of the longest path.
They give each message its depth and root and each leaf the score of its
branch. Branches are ranked by score; a chosen leaf is walked back to its root
by the same jumps, and its path is formatted as one conversation.

Format: ``<|role|>ROLE<|text|>TEXT<|end|>`` per turn. Role and text are escaped:
backslashes are doubled, and a backslash goes after the first character of every
control string, so that none stands in the output but the marks of the template.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litscreen.llm.common import stored, table

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
# Control strings of common chat templates.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")


def escape(text: Column, control: Sequence[str] = CONTROL) -> Column:
    """Reversible; ``unescape`` gives the text back. Null becomes empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for string in control:
        out = F.replace(out, F.lit(string), F.lit(string[0] + "\\" + string[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _same(left: DataFrame, right: DataFrame, column: str):
    """Join condition: same tree, and ``column`` of the left is ``at`` of the right."""
    return left["tree"].eqNullSafe(right["at_tree"]) & (left[column] == right["at"])


def _lookup(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` as the right side of ``_same``, its columns renamed to the keywords."""
    return df.select(
        F.col("tree").alias("at_tree"), F.col("node").alias("at"), *(F.col(c).alias(k) for k, c in columns.items())
    )


def root_distances(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Way of every message to its root, and the jump tables of 1, 2, 4, ... steps (``up`` never null).

    ``messages`` has ``tree, node, parent, score``. The first table has, per
    message: ``up`` (null: the root is reached), ``size`` (messages on the way,
    the root's included), ``total`` (their scores) and ``root``.
    """
    there = _lookup(messages, known="node")
    state = stored(
        messages.join(there, _same(messages, there, "parent"), "left").select(
            "tree",
            "node",
            F.col("known").alias("up"),
            F.lit(1).cast("long").alias("size"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"),
            F.col("node").alias("root"),
        ),
        "replies",
    )
    largest = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    done, under_way = [state.where("up IS NULL")], state.where("up IS NOT NULL")
    jumps = [under_way]
    # only messages that do not see their root yet take part in the next round
    while 1 << (len(jumps) - 1) < largest and under_way.limit(1).count():
        above = _lookup(state, up2="up", size2="size", total2="total", root2="root")
        seen = stored(
            under_way.join(above, _same(under_way, above, "up")).select(
                "tree",
                "node",
                F.col("up2").alias("up"),
                (F.col("size") + F.col("size2")).alias("size"),
                (F.col("total") + F.col("total2")).alias("total"),
                F.col("root2").alias("root"),
            ),
            "replies",
        )
        done.append(seen.where("up IS NULL"))
        under_way = seen.where("up IS NOT NULL")
        jumps.append(under_way)
        state = reduce(DataFrame.union, [*done, under_way])
    return state, jumps


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, rank, node, depth`` of the best root-to-leaf paths of each tree.

    ``messages``: ``tree, node, parent, score``; ``node`` identifies a message
    within its tree, and ids order ties. A parent that is null or not in the
    tree makes a root; a null score counts as 0. A branch's score is the mean
    over its messages; the ``branches`` best per tree are kept, of equal ones
    the smaller leaf. Messages on a cycle have no root and are left out.
    """
    messages = stored(messages.select("tree", "node", "parent", "score"), "messages")
    state, jumps = root_distances(messages)
    rooted = state.where("up IS NULL")
    parents = messages.where("parent IS NOT NULL").select(F.col("tree").alias("at_tree"), F.col("parent").alias("at"))
    leaves = rooted.join(parents.distinct(), _same(rooted, parents, "node"), "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / F.col("size")).desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    parts = [stored(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node"), "paths")]
    for jump in reversed(jumps):
        path, above = reduce(DataFrame.union, parts), _lookup(jump, up="up")
        step = path.join(above, _same(path, above, "node")).select("tree", "leaf", "rank", F.col("up").alias("node"))
        parts.append(stored(step, "paths"))
    path = reduce(DataFrame.union, parts)
    depths = _lookup(rooted, size="size")
    return path.join(depths, _same(path, depths, "node")).select(
        "tree", "leaf", "rank", "node", (F.col("size") - 1).alias("depth")
    )


def format_paths(paths: DataFrame, messages: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """``tree, leaf, rank, segments, formatted``: one row per path.

    ``messages`` has ``tree, node, role, text``. ``segments`` are pieces of
    ``formatted`` in order, each with ``loss``: whether the loss is taken there
    (the escaped texts of ``trained`` roles). A path is one row, so its turns
    meet in one task; null roles and texts are empty.
    """
    said = messages.select(
        F.col("tree").alias("at_tree"),
        F.col("node").alias("at"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = paths.join(said, _same(paths, said, "node")).groupBy("tree", "leaf", "rank")
    ordered = turns.agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def pieces(turn: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(ROLE), escape(turn["role"]), F.lit(TEXT)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), turn["role"].isin(*trained).alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    segmented = ordered.select("tree", "leaf", "rank", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return segmented.withColumn("formatted", F.array_join("segments.text", ""))


def parse_formatted(formatted: Column) -> Column:
    """Array of ``role, text``: the turns read back from the output."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, TEXT, 1)
        start = F.length(role) + len(TEXT) + 1
        text = F.substring(piece, start, F.length(piece) - start + 1 - len(END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    parts = F.split(formatted, ROLE.replace("|", r"\|"))
    return F.transform(F.slice(parts, 2, F.size(parts)), turn)


# The conversation that the query adds.
_ADDED = "</s>[INST] ok [/INST]"


def conversation_chains(conversations: DataFrame) -> DataFrame:
    """Messages of conversations whose turns each reply to the turn before.

    Turns are ordered by turn, role and text; rows that repeat are turns of
    their own. Only ``conv_id, turn, role, text`` take part.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.withColumns(
        {"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)}
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_ADDED).alias("text"),
    )
    messages = stored(conversation_chains(given.unionByName(added)), "turns")
    done = format_paths(best_paths(messages), messages)
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return (
        done.withColumns({"turns": parse_formatted(F.col("formatted")), "learnt": F.array_join(learnt, "")})
        .select(
            F.col("tree").alias("conv_id"),
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(spoken, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("learnt").cast("long").alias("loss_chars"),
            F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def _oracle() -> str:
    def escaped(text: str) -> str:
        out = f"replace({text}, chr(92), chr(92) || chr(92))"
        for string in CONTROL:
            out = f"replace({out}, '{string}', '{string[0]}' || chr(92) || '{string[1:]}')"
        return out

    return f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{_ADDED}' UNION ALL SELECT -7, 1, 'assistant', '{_ADDED}'),
        whole AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
                   sum(length('{ROLE}{TEXT}{END}') + length({escaped("role")}) + length({escaped("text")})) AS chars
            FROM turns GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(learnt) AS loss_chars,
               sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
        FROM whole"""


ORACLE_SQL = _oracle()
