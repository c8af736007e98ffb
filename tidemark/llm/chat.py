"""Chat formatting from reply trees.

Messages form trees: each names its parent. Iterative self-joins by pointer
doubling (after round k a node knows its ancestor 2^k steps up, its depth and the
score of the path so far) enumerate every root-to-leaf path in log2(depth)
rounds, without carrying paths around. Leaves are ranked per tree by the score
of their path; the chosen leaves' paths are marked by walking the same jump
tables down again, and each chosen path is formatted as one conversation.

Template, one turn after the other::

    ### <role>: <text></turn>\\n

Inside roles and texts ``\\`` is written ``\\\\``, ``#`` is ``\\h``, ``<`` is ``\\l``
and, in roles only, ``:`` is ``\\c``. No escaped text holds ``#`` or ``<``, so the
control strings can't occur in one and the reading back is exact.

Scale: the rounds move (tree, node, ancestor, depth, score), never texts, and
the joins are equi-joins on (tree, node). A tree's depth adds only its logarithm
in rounds, and a round works on the trees alone that are deeper still. Texts move
to the tree's formatted row at the end. Each round is written to the shared
folder.

Defined results: null texts and roles count as empty. Of several rows with one
tree and node the first counts, by parent (null first), score (highest first),
role and text; rows without a node can't be told apart or replied to and are left
out. A message whose parent is missing (or is itself) starts a tree path of its
own, i.e. is a root; messages on a cycle, or under one, reach no root and are left
out, after as many rounds as the logarithm of their tree's messages. Null scores
count as 0. Ties of scores go to the least leaf. A tree without messages doesn't
exist; a null tree is one; an empty table gives no rows. A conversation is one row
of the result, so it has to fit into a task's memory, twice. Other columns don't
take part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import bound, local_rows, materialise, prefix_sums, table

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(":"), F.lit("\\c"))


def unescape(c: Column) -> Column:
    """Pairs are parted first: outside of them a backslash starts a code."""
    code = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), code), "\\")


def chain(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of linear conversations:
    rows by turn, each replying to the one before. Rows of one turn go by role
    and text, so reruns agree."""
    order = Window.partitionBy(conv_col).orderBy(F.col(turn_col).asc_nulls_first(), F.col(role_col).asc_nulls_first(), F.col(text_col).asc_nulls_first())
    node = F.row_number().over(order).cast("long")
    numbered = rows.select(F.col(conv_col).alias("tree"), node.alias("node"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def messages_of(rows: DataFrame) -> DataFrame:
    """One row for each tree and node of ``rows`` (tree, node, parent, role, text,
    score): the first, as the module says."""
    place = F.struct("parent", (-F.coalesce("score", F.lit(0.0))).alias("s"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))
    first = rows.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min_by(F.struct("parent", "role", "text", "score"), place).alias("m"))
    return first.select("tree", "node", "m.*")


def best_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth) of each message on a chosen path; depth
    counts from the root, from 0. ``messages``: (tree, node, parent, score), a row
    for each tree and node as ``messages_of`` and ``chain`` give them."""
    m = messages.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    known = m.select(F.col("tree").alias("t"), F.col("node").alias("known"))
    m = m.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("known")), "left").select("tree", "node", F.col("known").alias("up"), "score")
    # score: of the messages from the node up to, but without, its ancestor ``up``.
    state = materialise(m.select("tree", "node", "up", F.lit(1).cast("long").alias("steps"), "score"), "chat-state")
    parents, jumps, ends, sizes = state, [], [], None
    while True:
        active = state.where(F.col("up").isNotNull())
        if active.isEmpty():
            break
        if sizes is None:
            sizes = materialise(state.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "chat-sizes")
        jumps.append(active)
        # Trees all of whose messages have found their root are done; the others go on.
        live = active.select("tree").distinct()
        ends.append(_where_tree(state, live, "left_anti"))
        state = _where_tree(state, live, "left_semi")
        a, b = state.where(F.col("up").isNotNull()).alias("a"), state.alias("b")
        on = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node"))
        further = a.join(b, on).select("a.tree", "a.node", "b.up", (F.col("a.steps") + F.col("b.steps")).alias("steps"), (F.col("a.score") + F.col("b.score")).alias("score"))
        # No ancestor is as many steps away as the tree has messages: such a node's way up is a cycle.
        r, n = further.alias("r"), sizes.alias("n")
        further = r.join(n, F.col("r.tree").eqNullSafe(F.col("n.tree"))).where("up IS NULL OR steps < n").select("r.*")
        state = materialise(further.unionByName(state.where(F.col("up").isNull())), "chat-state")
    for e in ends:
        state = state.unionByName(e)
    inner = parents.where(F.col("up").isNotNull()).select("tree", F.col("up").alias("node")).distinct().alias("p")
    roots = state.where(F.col("up").isNull()).alias("e")
    leaves = roots.join(inner, F.col("e.tree").eqNullSafe(F.col("p.tree")) & (F.col("e.node") == F.col("p.node")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "node"))
    marked = leaves.select("tree", F.col("node").alias("leaf"), "node", (F.col("steps") - 1).alias("depth"), rank.alias("rank")).where(F.col("rank") <= per_tree)
    marked = materialise(marked, "chat-leaves")
    # All ancestors within 2^k - 1 steps are marked; one jump of 2^k doubles that.
    for j in jumps:
        a, b = marked.alias("a"), j.alias("b")
        on = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.node") == F.col("b.node"))
        above = a.join(b, on).select("a.tree", "a.leaf", F.col("b.up").alias("node"), (F.col("a.depth") - F.col("b.steps")).alias("depth"), "a.rank")
        marked = marked.unionByName(materialise(above, "chat-paths"))
    return marked


def _where_tree(rows: DataFrame, trees: DataFrame, how: str) -> DataFrame:
    r, t = rows.alias("r"), trees.alias("t")
    return r.join(t, F.col("r.tree").eqNullSafe(F.col("t.tree")), how)


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per chosen path: formatted text, and the spans (start, length in
    code points, from 0) of it that carry loss: assistants' escaped texts."""
    on = F.col("m.tree").eqNullSafe(F.col("p.tree")) & (F.col("m.node") == F.col("p.node"))
    text = escape(F.col("m.text"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("m.role")), F.lit(SEP))
    turns = messages.alias("m").join(paths.alias("p"), on).select("p.tree", "p.leaf", "p.rank", F.struct(
        F.col("p.depth").alias("depth"), F.concat(head, text, F.lit(CLOSE)).alias("s"), F.length(head).alias("h"), F.length(text).alias("n"),
        F.coalesce(F.col("m.role") == LOSS_ROLE, F.lit(False)).alias("loss"),
    ).alias("t"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ends = prefix_sums(F.transform("ts", lambda t: F.length(t["s"])))
    spans = bound(ends, lambda e: F.transform("ts", lambda t, i: F.struct((F.get(e, i) - F.length(t["s"]) + t["h"]).alias("start"), t["n"].alias("length"), t["loss"].alias("loss"))))
    spans = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"]))
    return whole.select("tree", "leaf", "rank", F.array_join(F.transform("ts", lambda t: t["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    at = lambda p: F.instr(body(p), SEP)
    return F.transform(parts, lambda p: F.struct(unescape(F.substr(body(p), F.lit(1), at(p) - 1)).alias("role"), unescape(F.substr(body(p), at(p) + len(SEP))).alias("text")))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = r"\### Assistant: </turn> ok"
    more = local_rows(spark, [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id bigint, turn bigint, role string, text string")
    messages = materialise(chain(rows.unionByName(more)), "chat-messages")
    done = format_paths(messages, best_paths(messages))
    back = done.select(F.col("tree").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("turns"), F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS n_text,
         length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS n_role FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + n_role + 2 + n_text + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op7_chat_formatting": op7_chat_formatting}
ORACLE = {"op7_chat_formatting": SQL}
