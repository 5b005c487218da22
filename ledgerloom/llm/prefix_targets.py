"""Chat formatting by prefix-target expansion.

A conversation is written turn by turn as ``### role: text</turn>`` and a line end. Inside roles and
texts a backslash is put before a backslash, between two ``#`` and after ``<`` before ``/``, so no
mark can occur there and the text can be read back; in roles one is put before ``:`` as well. Every assistant turn makes an example: all turns
before it as context, then its own, of which only the reply's text is trainable. Turns after the last
reply, or a conversation without one, make a last example without a target.

Defined results: null texts and roles are empty. Turns are ordered by turn, role, text, nulls first;
repeated rows are turns of their own. A null conversation id is a conversation. Other columns are
ignored. An empty table gives no examples.

A conversation is gathered as one value, as the example that holds all its turns is one value too.
Examples are cut from it row by row, so the expansion is never held as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the template
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
TURN = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, "#(?=#)", r"#\\")
    return F.replace(out, F.lit("</"), F.lit("<\\/"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A row per example: conv_id, example, last, text, loss_start, loss_length (code points, 0-based)."""
    body = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    whole = turns.select(F.col(conversation).alias("conv_id"), body.alias("t")).groupBy("conv_id")
    gathered = whole.agg(F.sort_array(F.collect_list("t")).alias("ts"))
    written = F.transform(
        "ts",
        lambda t: F.struct(
            t["role"].alias("role"), F.length(escape(t["text"])).alias("reply"),
            F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\:")), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE)).alias("text"),
        ),
    )
    lines = gathered.select("conv_id", written.alias("ts"))
    # where each turn ends, as a running sum kept in the order of turns
    ends = F.aggregate(
        "ts", F.array(F.lit(0).cast("bigint")),
        lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t["text"]).cast("bigint"))),
    )
    placed = lines.select(
        "conv_id", F.concat_ws("", F.transform("ts", lambda t: t["text"])).alias("whole"), ends.alias("ends"),
        F.transform("ts", lambda t: t["role"]).alias("roles"), F.transform("ts", lambda t: t["reply"]).alias("replies"),
    )
    n = F.size("roles")
    shown = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("roles", i - 1) == TRAINED) | (i == n))
    rows = placed.select("*", F.posexplode(shown).alias("example", "upto"))
    end = F.get("ends", F.col("upto"))
    trained = F.get("roles", F.col("upto") - 1) == TRAINED
    length = F.when(trained, F.get("replies", F.col("upto") - 1)).otherwise(F.lit(0))
    return rows.select(
        "conv_id", "example", (F.col("upto") == n).alias("last"),
        F.substring("whole", F.lit(1), end.cast("int")).alias("text"),
        F.when(trained, end - F.length(F.lit(CLOSE)) - length).alias("loss_start"),
        length.cast("bigint").alias("loss_length"),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Read the examples back: a row per conversation with hashes of its turns and of all trained text."""
    loss = unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    read = examples.select(
        "conv_id", "example", F.length("text").alias("chars"), F.coalesce(loss, F.lit("")).alias("loss"),
        F.when(F.col("last"), F.col("text")).alias("whole"),
    )
    replies = F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"])
    merged = read.groupBy("conv_id").agg(
        F.concat_ws("", replies).alias("loss"), F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole")
    )
    # the last example holds every turn; the final line end leaves an empty part
    parts = F.filter(F.split("whole", "</turn>\n"), lambda p: p != "")
    parsed = F.transform(parts, lambda p: F.concat(
        unescape(F.regexp_extract(p, TURN, 1)), F.lit("\n"), unescape(F.regexp_extract(p, TURN, 2)), F.lit("\n"),
    ))
    return merged.select(
        "conv_id", F.size(parts).cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", parsed).cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
