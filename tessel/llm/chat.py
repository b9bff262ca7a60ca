"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds the conversation up to its assistant turn; only that reply is trainable. Turns after the last reply form
one more example without a target, so that nothing is lost. Control strings inside texts and roles are escaped reversibly.

Template of a turn: ``<|turn|>`` role newline text ``<|end|>`` newline. Escapes: a backslash becomes ``\\e``; ``<`` before the rest of a
control string ``\\l``; ``[`` before the rest of one ``\\b``; a newline in a role ``\\w``.

Defined cases: null roles and texts are empty; turns are put in order by (turn, role, text), null turns first; rows that
repeat count as turns of their own; a null conv_id is a conversation of its own. An example repeats its prefix, so the text of
all examples grows with the square of a conversation's turns; that is what the format is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
ANGLE, SQUARE = r"<(?=\|turn\|>|\|end\|>|s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)", r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\e"))
    return F.regexp_replace(F.regexp_replace(text, ANGLE, r"\\l"), SQUARE, r"\\b")


def unescape(text: Column) -> Column:
    for mark, plain in (("\\l", "<"), ("\\b", "["), ("\\w", "\n"), ("\\e", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def expand(turns: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), formatted, target_start and target_length (code points; null without a target)."""
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\w")), F.lit("\n"))
    d = turns.select("conv_id", F.struct("turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body")).alias("t"))
    d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    d = d.withColumn("ends", F.expr("filter(transform(ts, (t, i) -> IF(t.role = 'assistant' OR i = size(ts) - 1, i, NULL)), i -> i IS NOT NULL)"))
    d = d.select("conv_id", "ts", F.posexplode("ends").alias("example", "end"))
    whole = F.expr(f"array_join(transform(slice(ts, 1, end + 1), t -> concat(t.head, t.body, '{END.strip()}\\n')), '')")
    last = F.element_at("ts", F.col("end") + 1)
    d = d.select("conv_id", "example", whole.alias("formatted"), last["role"].alias("role"), F.length(last["body"]).alias("n"))
    is_target = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return d.select("conv_id", "example", "formatted", F.when(is_target, F.length("formatted") - F.col("n") - len(END)).alias("target_start"), F.when(is_target, F.col("n")).alias("target_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """Conversations from formatted examples: conv_id, turns (role, text), targets (texts under the loss mask in order) and formatted_chars."""
    target = unescape(F.substring(F.col("formatted"), F.col("target_start") + 1, F.col("target_length")))
    d = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("target_start").isNotNull(), F.struct("example", target.alias("text"))))).alias("targets"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    d = d.withColumn("parts", F.split("whole", r"<\|turn\|>"))
    parts = F.slice("parts", F.lit(2), F.size("parts") - 1)
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END))).alias("text"),
    ))
    return d.select("conv_id", turns.alias("turns"), F.transform("targets", lambda t: t["text"]).alias("targets"), "formatted_chars")
