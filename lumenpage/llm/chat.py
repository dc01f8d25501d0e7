"""Chat formatting of reply trees, in DataFrame operations only.

Nodes (conv_id, node_id, parent_id, role, text, score) form trees: a node whose
parent is null or isn't there is a root, one that nobody answers is a leaf.
Self-joins double the reach of a table of ancestors, so a path of n turns is
complete after about log2(n) rounds; each round is written to shared storage.
Branches are ranked by the sum of their scores (then: longer, smaller leaf id),
and each chosen path becomes one text.

A turn is written ``<s>role\\ntext</s>``. Inside roles and texts every control
string gets a backslash after its first character (and one that has
backslashes there gets one more), so unescaping restores them exactly. In
roles, a newline is written ``\\n`` and a backslash twice. The loss mask holds
code-point spans of the output: the texts of the assistant.

Null roles and texts are empty ones; null turns come first; a null conv_id is
one conversation of its own. Turns that tie stand by role and then text, and
repeated rows are repeated turns. Nodes on a cycle have no root and give no
path. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpage.llm.common import shared_dir, stored

OPEN, CLOSE = "<s>", "</s>"
#: The first character of each control string, and what follows it.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|[a-z_]{1,32}\|>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>|\|[a-z_]{1,32}\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    # \x00 can't stand in for a backslash safely, so pairs are read from the left
    parts = F.split(role, r"\\\\")
    return unescape(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"))


def chains(turns: DataFrame) -> DataFrame:
    """Nodes of plain conversations: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = numbered.withColumn("node_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return numbered.select("conv_id", "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, folder: str) -> DataFrame:
    """Rows (conv_id, leaf_id, node_id, height) of all root-to-leaf paths; height counts from the leaf.

    ``nodes`` should be stored: it is read in every round.
    """
    # structs compare null fields as equal, so a null conv_id joins with itself
    key = lambda node: F.struct("conv_id", F.col(node).alias("n"))
    ids = nodes.select(key("node_id").alias("node"), F.when(F.col("parent_id").isNotNull(), key("parent_id")).alias("up"))
    known = ids.select(F.col("node").alias("up"))
    up = ids.join(known, "up", "left_semi").select("node", "up")
    leaf = ids.select("node").join(up.select(F.col("up").alias("node")), "node", "left_anti")
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = stored(up, folder, "up-0")
    found = stored(leaf.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height")), folder, "path-0")
    all_found, step, k = [found], 1, 0
    while step < most:
        k += 1
        # all nodes so far, moved up by ``step``
        so_far = all_found[0]
        for part in all_found[1:]:
            so_far = so_far.union(part)
        moved = so_far.join(reach, "node").select("leaf", F.col("up").alias("node"), (F.col("height") + step).alias("height"))
        moved = stored(moved, folder, f"path-{k}")
        if moved.isEmpty():
            break
        all_found.append(moved)
        step *= 2
        if step < most:
            further = reach.select("node", F.col("up").alias("mid")).join(reach.select(F.col("node").alias("mid"), "up"), "mid").select("node", "up")
            reach = stored(further, folder, f"up-{k}")
    out = all_found[0]
    for part in all_found[1:]:
        out = out.union(part)
    # one table, as semi-joins would be planned once for each part of a union
    out = stored(out, folder, "paths")
    # a leaf below a cycle never meets a root
    root = ids.select("node").join(up.select("node"), "node", "left_anti")
    rooted = out.join(root, "node", "left_semi").select("leaf").distinct()
    out = out.join(rooted, "leaf", "left_semi")
    return out.select(F.col("leaf.conv_id").alias("conv_id"), F.col("leaf.n").alias("leaf_id"), F.col("node.n").alias("node_id"), "height")


def format_trees(nodes: DataFrame, folder: str, *, branches: int | None = 1, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, leaf_id, rank, score, formatted, loss_mask): the best ``branches`` paths of each tree (None: all)."""
    nodes = stored(nodes, folder, "nodes")
    # the text travels once, to its path; ranks need the scores only
    key = lambda node: F.struct("conv_id", F.col(node).alias("n"))
    path = paths(nodes, folder).withColumn("key", key("node_id"))
    body = nodes.withColumn("key", key("node_id")).select("key", "role", "text", "score")
    turns = path.join(body, "key")
    role, text = _role_out(F.col("role")), escape(F.col("text"))
    turns = turns.select(
        "conv_id", "leaf_id", "height", "score",
        F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE)).alias("piece"),
        (F.lit(len(OPEN) + 1) + F.char_length(role)).alias("skip"), F.char_length(text).alias("chars"), F.col("role").isin(*learn_from).alias("learnt"),
    )
    before = Window.partitionBy("conv_id", "leaf_id").orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)))
    row = F.struct((-F.col("height")).alias("depth"), "piece", (F.col("at") + F.col("skip")).alias("start"), "chars", "learnt")
    grouped = turns.groupBy("conv_id", "leaf_id").agg(F.array_sort(F.collect_list(row)).alias("turns"), F.sum("score").alias("score"))
    best = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("turn_count"), "leaf_id")
    ranked = grouped.withColumn("turn_count", F.size("turns")).withColumn("rank", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    spans = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["start"].cast("long").alias("start"), t["chars"].cast("long").alias("length")))
    return ranked.select("conv_id", "leaf_id", "rank", "score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns of an output, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1))
    return F.transform(
        bare,
        lambda p: F.struct(
            _role_in(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.lit(2**31 - 1))).alias("text"),
        ),
    )


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(loss_mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    made = format_trees(chains(turns.union(more)), shared_dir(spark))
    read = made.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(masked_text(F.col("formatted"), F.col("loss_mask")), "").alias("learnt"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|[a-z_]{1,32}\|>)', '\1\\\2\3', 'g') AS text_out,
    replace(replace(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|[a-z_]{1,32}\|>)', '\1\\\2\3', 'g'), '\', '\\'), chr(10), '\n') AS role_out
  FROM t
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role_out) + length(text_out) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
