"""Reply trees: root-to-leaf paths of messages, each formatted as one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import checkpointed, read

#: A turn is HEAD role MIDDLE text END. In roles and texts the two strings are written as escapes.
HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
PROBE = "\\### Assistant: </turn> ok"


def escape(c: Column, role: bool = False) -> Column:
    """c without ### and </turn> (and, for a role, colons): a backslash is doubled, then they become \\h, \\t, \\c."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for plain, code in (("###", "\\h"), ("</turn>", "\\t"), *(((":", "\\c"),) if role else ())):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    """The inverse: what stands between doubled backslashes is decoded by itself."""
    def plain(piece: Column) -> Column:
        for text, code in (("###", "\\h"), ("</turn>", "\\t"), (":", "\\c")):
            piece = F.replace(piece, F.lit(code), F.lit(text))
        return piece

    return F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, node, depth) of every root-to-leaf path of messages(conv, node, parent).

    Iterative self-joins with doubled steps: link k leads 2^k messages up, and after the longest link
    the leaves' paths are filled in from the widest steps down, so a path of n messages takes log n
    joins and not n. A message whose parent is null or isn't there is a root. Links that form a
    circle have no leaf and give no path. Node ids are unique in a conversation.
    """
    known = messages.select("conv", F.col("node").alias("parent")).withColumn("_there", F.lit(True))
    link = messages.join(known, ["conv", "parent"], "left").select("conv", "node", F.when(F.col("_there"), F.col("parent")).alias("up"))
    link = checkpointed(link)
    parents = link.filter("up IS NOT NULL").select("conv", F.col("up").alias("node")).distinct()
    leaves = link.join(parents, ["conv", "node"], "left_anti").select("conv", F.col("node").alias("leaf"))
    links, rows = [link.filter("up IS NOT NULL")], messages.count()
    while 1 << len(links) <= max(rows, 1):  # no path is longer than all rows; a circle ends here as well
        k = links[-1]
        longer = checkpointed(k.join(k.select("conv", F.col("node").alias("up"), F.col("up").alias("_far")), ["conv", "up"]).select("conv", "node", F.col("_far").alias("up")))
        if longer.isEmpty():
            break
        links.append(longer)
    found = leaves.select("conv", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("steps"))
    for k in reversed(range(len(links))):  # a row stays and, where a link leads on, gives a second one
        at, far = F.struct("node", "steps"), F.struct(F.col("up").alias("node"), (F.col("steps") + (1 << k)).alias("steps"))
        found = found.join(links[k], ["conv", "node"], "left").select("conv", "leaf", F.inline(F.when(F.col("up").isNull(), F.array(at)).otherwise(F.array(at, far))))
        found = checkpointed(found) if k % 3 == 0 else found
    return found


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One formatted conversation for each chosen path: conv, leaf, rank, score, n_turns, formatted, loss_spans.

    messages: conv, node, parent, role, text, score. A branch's score is the sum of its messages'
    (null: 0); branches of a tree rank by it, then by leaf; best of them are chosen (None: all).
    loss_spans are (start from 1, length) in code points of formatted: the assistant texts, escapes
    included. A null role or text is empty. Other columns are ignored.
    """
    m = messages.select("conv", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    on = paths(m.select("conv", "node", "parent"))
    turns = on.join(m.drop("parent"), ["conv", "node"])
    branch = turns.groupBy("conv", "leaf").agg(
        F.sum("score").alias("score"), F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("at"), "role", "text"))).alias("turns"))
    if best is None:
        branch = branch.withColumn("rank", F.lit(None).cast("int"))
    else:
        order = branch.groupBy("conv", "leaf", "score").agg(F.first("n_turns").alias("_n")).withColumn("rank", F.row_number().over(W.partitionBy("conv").orderBy(F.desc("score"), "leaf"))).filter(F.col("rank") <= best)
        branch = branch.join(order.select("conv", "leaf", "rank"), ["conv", "leaf"])
    head = lambda t: F.concat(F.lit(HEAD), escape(t.role, True), F.lit(MIDDLE))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t.text).alias("body"), (t.role == "assistant").alias("loss")))
    branch = branch.withColumn("_pieces", pieces)
    spans = F.aggregate(
        "_pieces", F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a.at + F.length(p.head) + F.length(p.body) + len(END)).alias("at"),
            F.when(p.loss, F.concat(a.spans, F.array(F.struct((a.at + F.length(p.head)).alias("start"), F.length(p.body).alias("length"))))).otherwise(a.spans).alias("spans")),
        lambda a: a.spans)
    formatted = F.array_join(F.transform("_pieces", lambda p: F.concat(p.head, p.body, F.lit(END))), "")
    return branch.select("conv", "leaf", "rank", "score", "n_turns", formatted.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The (role, text) turns back from a formatted conversation."""
    each = F.filter(F.split(formatted, "</turn>\\n"), lambda s: s != "")
    return F.transform(each, lambda s: F.struct(
        unescape(F.substring(s, F.lit(len(HEAD) + 1), F.instr(s, MIDDLE) - len(HEAD) - 1)).alias("role"),
        unescape(F.substring(s, F.instr(s, MIDDLE) + len(MIDDLE), F.length(s))).alias("text")))


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations as messages: each turn replies to the one before; ties in turn go by role and text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.row_number().over(order))
    return c.select(F.col("conv_id").alias("conv"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the query, all read back from formatted and loss_spans."""
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    f = formatted.withColumn("_loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start, s.length))), ""))
    return f.select(
        F.col("conv").alias("conv_id"), F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digest(format_trees(as_trees(c.unionByName(probe))))


_E = r"replace(replace(replace({}, '\', '\\'), '###', '\h'), '</turn>', '\t')"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(HEAD + MIDDLE + END)} + length(replace({_E.format('role')}, ':', '\\c')) + length({_E.format('text')}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
