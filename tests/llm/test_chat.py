from pyspark.sql import functions as F

from litscreen.llm.chat import (
    CONTROL,
    best_paths,
    conversation_chains,
    escape,
    format_paths,
    parse_formatted,
    unescape,
)


def test_escape_is_reversible_and_hides_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<|", "<|role|>x<|text|>y<|end|>", "<<|", "<\\|", "|>|>", "é\n", "", None, "\\n$1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == (r.t or "")
        assert not any(c in r.e for c in CONTROL)


def paths_by_walking(nodes):
    """Root-to-leaf paths of ``(tree, node, parent, score)`` by recursion: best leaf per tree."""
    best = {}
    for tree in {n[0] for n in nodes}:
        mine = {n[1]: n for n in nodes if n[0] == tree}
        parents = {n[2] for n in mine.values()}
        ranked = []
        for leaf in (k for k in mine if k not in parents):
            path, at = [], leaf
            while at in mine and at not in path:
                path.append(at)
                at = mine[at][2]
            if at in path:
                continue
            mean = sum(mine[k][3] or 0.0 for k in path) / len(path)
            ranked.append((-mean, leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(ranked)[:2], 1):
            best[tree, rank] = (leaf, path)
    return best


def test_best_paths_equal_walking(spark):
    nodes = [(t, n, None if n == 0 else (n * 7 + t) % n, float((n * 31 + t) % 17) if n % 5 else None) for t in range(5) for n in range(23)]
    nodes += [(None, 1, None, 1.0), (None, 2, 1, 1.0), (8, 1, 99, 0.0), (9, 1, 2, 0.0), (9, 2, 1, 0.0)]
    nodes += [(7, n, n - 1 if n else None, 0.0) for n in range(70)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    got = {}
    for r in best_paths(df, branches=2).collect():
        got.setdefault((r.tree, r["rank"]), (r.leaf, []))[1].append((r.depth, r.node))
    assert {k: (leaf, [n for _, n in sorted(p)]) for k, (leaf, p) in got.items()} == paths_by_walking(nodes)


def test_round_trip_with_edges(spark):
    rows = [(1, 1, "assistant", "B\\<|end|>"), (1, 0, "user", "A"), (1, 2, None, None), (2, 0, "<|text|>", ""), (2, 0, "<|text|>", "")]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y")]
    table = spark.createDataFrame([(*r, "z", 0.5) for r in rows], "conv_id long, turn long, role string, text string, leaf string, score double")
    messages = conversation_chains(table)
    done = format_paths(best_paths(messages), messages).withColumn("turns", parse_formatted(F.col("formatted")))
    got = {r.tree: r for r in done.collect()}
    turns = {k: [tuple(t) for t in r.turns] for k, r in got.items()}
    assert turns[1] == [("user", "A"), ("assistant", "B\\<|end|>"), ("", "")]
    assert turns[2] == [("<|text|>", ""), ("<|text|>", "")]
    assert turns[None] == [("assistant", "y"), ("user", "x")]
    assert [s.text for s in got[1].segments if s.loss] == ["B\\\\<\\|end|\\>"]
    empty = messages.where("false")
    assert format_paths(best_paths(empty), empty).count() == 0
