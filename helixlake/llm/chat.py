"""Chat formatting of reply trees (operator 2).

Messages form trees: each has a parent in its conversation or none. Self-joins with doubling reach
(1, 2, 4, ... replies up) add up each message's score to its root in about log2(depth) rounds, on
ids and scores alone. Leaves are ranked in their conversation by that sum, and the same joins list
the messages of the chosen root-to-leaf paths only, so a root with many leaves isn't repeated
for each of them. Texts move once, to the partition of their conversation, and each chosen path becomes
one text there.

A turn is ``<s>role[newline]text</s>``. Inside roles and texts a backslash is doubled, and one is put
after the first character of each control string, so control strings occur only where the
template puts them and reading back is exact. The loss mask is a list of spans of the text:
those of the assistant's texts.

Edge cases: null texts are empty; a null role is the empty role; a null conv_id is a
conversation of its own; a parent that doesn't exist makes a root; ties in score go to
the smaller leaf; messages in a cycle raise ValueError; empty tables give no rows; other
columns are ignored. msg_id must be unique in its conversation. A very long text is one turn; a
chosen path is one row, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.llm.shared import dropped, saved, table

BEGIN, END = "<s>", "</s>"
#: Control strings of common chat templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return out


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """Tables k = 0, 1, ... of (conv_id, msg_id, up, s) for nodes(conv_id, msg_id, parent_id, score).

    up is the message 2^k replies up, null beyond the root; s is the sum of the scores of the up to 2^k
    messages from msg_id on. In the last table each up is null, so s is the sum of the path to the root.
    """
    known = nodes.select(F.col("conv_id").alias("pc"), F.col("msg_id").alias("pm"))
    tables = [saved(nodes.join(known, same("conv_id", "pc") & (F.col("parent_id") == F.col("pm")), "left").select("conv_id", "msg_id", F.col("pm").alias("up"), F.col("score").alias("s")), "climb")]
    most = tables[0].count().bit_length() + 1
    while not (open_ := tables[-1].where("up is not null")).isEmpty():
        if len(tables) > most:  # a path can't have more replies than there are messages
            raise ValueError("replies form a cycle")
        next_ = tables[-1].select(F.col("conv_id").alias("kc"), F.col("msg_id").alias("km"), F.col("up").alias("k_up"), F.col("s").alias("ks"))
        more = open_.join(next_, same("conv_id", "kc") & (F.col("up") == F.col("km"))).select("conv_id", "msg_id", F.col("k_up").alias("up"), (F.col("s") + F.col("ks")).alias("s"))
        tables.append(saved(tables[-1].where("up is null").union(more), "climb"))
    return tables


def chosen_paths(nodes: DataFrame, keep: int) -> DataFrame:
    """(conv_id, leaf, rank, score, msg_id, up): the messages of the keep best root-to-leaf paths of each conversation; up counts replies from the leaf."""
    tables = climbed(nodes)
    inner = tables[0].where("up is not null").select(F.col("conv_id").alias("ic"), F.col("up").alias("im")).distinct()
    leaves = tables[-1].join(inner, same("conv_id", "ic") & (F.col("msg_id") == F.col("im")), "left_anti")
    best = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("s"), "msg_id"))
    ranked = leaves.withColumn("rank", best).where(F.col("rank") <= keep)
    reach = saved(ranked.select("conv_id", F.col("msg_id").alias("leaf"), "rank", F.col("s").alias("score"), "msg_id", F.lit(0).alias("up")), "paths")
    for k, table_ in enumerate(tables[:-1]):
        jump = table_.where("up is not null").select(F.col("conv_id").alias("jc"), F.col("msg_id").alias("low"), F.col("up").alias("high"))
        more = reach.join(jump, same("conv_id", "jc") & (F.col("msg_id") == F.col("low"))).select("conv_id", "leaf", "rank", "score", F.col("high").alias("msg_id"), (F.col("up") + (1 << k)).alias("up"))
        old, reach = reach, saved(reach.union(more), "paths")
        dropped(old)
    dropped(*tables)
    return reach


def format_paths(messages: DataFrame, keep: int = 1, nodes: DataFrame | None = None) -> DataFrame:
    """The keep best branches of each conversation of messages(conv_id, msg_id, parent_id, role, text, score).

    conv_id, leaf, rank, score, formatted, and mask: spans (start, end) of the assistant's text in it,
    in characters. nodes: where the replies and scores are, if not in messages.
    """
    nodes = messages if nodes is None else nodes
    chosen = chosen_paths(nodes.select("conv_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0)).cast("double").alias("score")), keep)
    # texts move once: they meet the paths they are on in the partition of their conversation
    body = messages.select("conv_id", "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    met = body.unionByName(chosen, allowMissingColumns=True).repartition("conv_id")
    w = Window.partitionBy("conv_id", "msg_id").orderBy(F.col("leaf").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    turn = met.withColumn("body", F.first(F.struct("role", "text")).over(w)).where("leaf is not null").select("conv_id", "leaf", "rank", "score", "up", "body.role", "body.text")
    head = F.concat(F.lit(BEGIN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    turn = turn.select("conv_id", "leaf", "rank", "score", "up", "role", head.alias("head"), escape(F.col("text")).alias("said"))
    size = F.length("head") + F.length("said") + len(END)
    before = F.sum(size).over(Window.partitionBy("conv_id", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)) - size
    start = before + F.length("head")
    placed = turn.select("conv_id", "leaf", "rank", "score", "up", F.concat("head", "said", F.lit(END)).alias("turn"), F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("said")).alias("end"))).alias("span"))
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("up", "turn", "span"))))
    out = placed.groupBy("conv_id", "leaf", "rank", "score").agg(rows.alias("r"))
    return out.select("conv_id", "leaf", "rank", "score", F.array_join("r.turn", "").alias("formatted"), F.filter("r.span", lambda x: x.isNotNull()).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, the unescaped text under the mask, from formatted and mask alone."""
    parts = F.split("formatted", F.lit("</s>"))
    raw = F.slice(parts, F.lit(1), F.size(parts) - 1)
    pattern = r"(?s)^<s>((?:[^\\\n]|\\.)*+)\n(.*)$"
    turns = F.transform(raw, lambda x: F.struct(unescape(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(F.regexp_extract(x, pattern, 2)).alias("text")))
    spans = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(spans, ""))


def linear(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and nodes of plain conversations(conv_id, turn, role, text): each replies to the one before; the score is its length.

    Rows of one turn stand in the order of role, then text.
    """
    ids = rows.select("conv_id", "turn", F.length("text").alias("score"))
    w = Window.partitionBy("conv_id")
    if ids.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1 or turn is null").isEmpty():
        before = F.lag("turn").over(w.orderBy("turn"))
        return rows.select("conv_id", F.col("turn").alias("msg_id"), "role", "text"), ids.select("conv_id", F.col("turn").alias("msg_id"), before.alias("parent_id"), "score")
    n = F.row_number().over(w.orderBy("turn", "role", "text"))
    numbered = rows.select("conv_id", n.alias("msg_id"), F.when(n > 1, n - 1).alias("parent_id"), "role", "text", F.length("text").alias("score"))
    return numbered, numbered


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages, nodes = linear(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    back = read_back(format_paths(messages, nodes=nodes))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: formatted_chars follows from the template: each turn adds its tags, a newline and the escapes.
_ESCAPED = "replace(coalesce({0}, ''), '\\', '\\\\')"
for _s in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_s}', '{_s[0]}\\{_s[1:]}')"
_TEXT, _ROLE = _ESCAPED.format("text"), "replace(" + _ESCAPED.format("role") + ", chr(10), '\\' || chr(10))"
OP2_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length({_TEXT}) + length({_ROLE}) + {len(BEGIN) + 1 + len(END)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
