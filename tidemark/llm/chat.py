"""Chat formatting by prefix-target expansion (operator 9). DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its context, and only the reply is trainable (its
text and nothing around it is under the loss mask). What a conversation has after its last reply, or all of it if it has none, is an
example without a target, so that every turn is in the output.

A turn is  <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>  and a newline. Texts and roles may hold control strings: after the first
character of each a backslash is put, also where backslashes stand there already, so that taking one away gives the text back and
no control string of a text remains one.

Defined results
  text null                    empty
  role null                    an empty role; not an assistant
  repeated turn numbers        in order of role, then text; a null number comes first
  conv_id null                 all such rows are one conversation, in one task as every conversation is
  very long conversations      an array of turns in one row; each reply repeats what stands before it, as the method has it
  empty table                  no rows
  more columns                 ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What follows the first character of a control string, as a pattern (fixed values): turn marks, ends of text, instruction marks.
_REST = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|/?s>|/?INST\]|</?SYS>>|\|begin_of_text\|>|\|eot_id\|>|\|start_header_id\|>|\|end_header_id\|>"
_ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2$3"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, mask_start, mask_end): an example's formatted text, and the characters of its reply
    [mask_start, mask_end), both null without a target."""
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = said.groupBy("conv_id").agg(order.alias("turns"))
    form = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(CLOSE + "\n"))
    convs = convs.select("conv_id", F.transform("turns", lambda t: F.struct(form(t).alias("form"), (t["role"] == "assistant").alias("reply"), F.length(escape(t["text"])).alias("size"))).alias("turns"))
    targets = F.filter(F.transform("turns", lambda t, i: F.when(t["reply"], i + 1)), lambda i: i.isNotNull())
    n = F.size("turns")
    ends = F.array_distinct(F.concat(targets, F.array(n)))
    one = convs.select("conv_id", "turns", F.posexplode(ends).alias("example", "n_turns"))
    last = F.element_at("turns", F.col("n_turns"))
    text = F.array_join(F.transform(F.slice("turns", 1, F.col("n_turns")), lambda t: t["form"]), "")
    one = one.select("conv_id", "example", "n_turns", text.alias("text"), last["reply"].alias("reply"), last["size"].alias("size"))
    stop = F.length("text") - len(CLOSE) - 1
    return one.select("conv_id", "example", "n_turns", "text", F.when(F.col("reply"), stop - F.col("size")).alias("mask_start"), F.when(F.col("reply"), stop).alias("mask_end"))


def parse(text: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    pieces = F.filter(F.split(text, F.lit(r"<\|im_start\|>")), lambda p: p != "")
    at = lambda p: F.instr(p, F.lit(SEP))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(1), at(p) - 1)).alias("role"),
            unescape(F.substring(p, at(p) + len(SEP), F.length(p) - at(p) - len(SEP) - len(CLOSE))).alias("text"),
        ),
    )


def read_back(found: DataFrame) -> DataFrame:
    """What the examples of each conversation hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    whole = F.max_by("text", "n_turns")  # the longest example has every turn
    masked = unescape(F.expr("substring(text, mask_start + 1, mask_end - mask_start)"))
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("mask_start").isNotNull(), F.struct("example", masked.alias("loss"))))), lambda x: x["loss"]), "")
    by = found.groupBy("conv_id").agg(whole.alias("whole"), loss.alias("loss"), F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    by = by.select("conv_id", parse(F.col("whole")).alias("turns"), "loss", "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


# ---------------------------------------------------------------- query

_PROBE = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT cast(-1 AS bigint) AS conv_id, turn, role, '{_PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_back(examples(turns.unionByName(probe)))


ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    {len(OPEN) + len(SEP) + len(CLOSE) + 1} + length(regexp_replace(role, '{_ESCAPE}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{_ESCAPE}', '\1\\\2\3', 'g')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
