"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
A conversation that does not end with an assistant turn gets one more example, without trainable text, that holds its
last turns, so the output holds every turn.

An example reads ``<s>`` and then, per turn, ``<|turn|>`` role newline text ``</s>``. A control string inside a text
or role gets a backslash after its first character (and one more if it has some there), which reading back removes.
A newline inside a role is written ``<|nl|>``. Nulls in role and text are empty strings. Turns are ordered by turn
number, null ones last, then by role and text; repeated rows are turns of their own; a null conversation id is one
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's own marks and control strings of common chat formats.
BEGIN, TURN, END, NEWLINE = "<s>", "<|turn|>", "</s>", "<|nl|>"
CONTROL = r"/?s>|unk>|pad>|\|(?:turn|nl|im_start|im_end|endoftext)\|>|/?INST\]|</?SYS>>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", r"$1$2$3")


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: ``conv_id``, ``example`` (from 0), ``is_last``, ``formatted``, ``loss_start``, ``loss_chars``.

    The loss mask covers the code points ``loss_start`` (from 0) to ``loss_start + loss_chars`` of ``formatted``; it is
    empty in an example that trains nothing. No row comes from an empty table.
    """
    said, speaker = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    name = F.replace(escape(speaker), F.lit("\n"), F.lit(NEWLINE))
    piece = F.struct(
        F.col(turn).isNull().alias("late"), F.col(turn).alias("turn"), speaker.alias("role"), said.alias("text"),
        F.concat(F.lit(TURN), name, F.lit("\n"), escape(said), F.lit(END)).alias("piece"),
        F.when(speaker == TRAINED, F.char_length(escape(said))).alias("loss"),
    )
    convs = turns.select(F.col(conv).alias("conv_id"), piece.alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    convs = convs.select("conv_id", F.col("p.piece").alias("pieces"), F.col("p.loss").alias("losses"), F.size("p").alias("n"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == F.col("n")) | F.element_at("losses", i).isNotNull())
    examples = convs.select("conv_id", "pieces", "losses", "n", F.posexplode(ends).alias("example", "end"))
    whole = F.concat(F.lit(BEGIN), F.array_join(F.slice("pieces", F.lit(1), F.col("end")), ""))
    loss = F.coalesce(F.element_at("losses", F.col("end")), F.lit(0))
    return examples.select(
        "conv_id", "example", (F.col("end") == F.col("n")).alias("is_last"), whole.alias("formatted"), loss.alias("loss_chars"),
    ).withColumn("loss_start", F.char_length("formatted") - len(END) - F.col("loss_chars"))


def read_turns(formatted: Column) -> Column:
    """The turns of an example as an array of (role, text)."""
    parts = F.filter(F.split(formatted, TURN.replace("|", r"\|")), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.char_length(part) - len(END))
        role = F.substring_index(body, "\n", 1)
        said = F.substring(body, F.char_length(role) + 2, F.char_length(body))
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(said).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example as it was before escaping."""
    return unescape(F.substring(formatted, start + 1, chars))


def digest(examples: DataFrame) -> DataFrame:
    """What can be read back from ``examples``, one row per conversation."""
    turns = F.when(F.col("is_last"), read_turns(F.col("formatted")))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", F.when(F.col("is_last"), F.size(turns)).alias("n"), F.when(F.col("is_last"), F.sha2(lines, 256)).alias("sha"),
        F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("text")).alias("loss"), F.char_length("formatted").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"),
        F.array_join(F.array_sort(F.collect_list("loss"))["text"], "").alias("learned"), F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


#: DuckDB SQL for ``digest(expand(...))`` over ``conversations`` and the probe conversation -7.
DIGEST_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *,
    length(regexp_replace(text, '([<\[])(\\*)({CONTROL})', '\1\\\2\3', 'g')) AS text_chars,
    length(replace(regexp_replace(role, '([<\[])(\\*)({CONTROL})', '\1\\\2\3', 'g'), chr(10), '{NEWLINE}')) AS role_chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n FROM c),
p AS (SELECT *, {len(BEGIN)} + sum({len(TURN)} + role_chars + 1 + text_chars + {len(END)}) OVER (PARTITION BY conv_id ORDER BY i) AS chars FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  sum(chars) FILTER (role = '{TRAINED}' OR i = n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
