"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted by (turn, role, text);
adjacent turns of one role are merged into one block by an array aggregation, and the
blocks are concatenated. The template:

    <s>[INST]text[/INST]                user
    <s>[ASSISTANT]text</s>              assistant
    <s>[ROLE:name]text[/ROLE]           any other role

Turns merged into one block are parted by ``[+]``. In texts a backslash is put after
every backslash and after the first character of every control string, so no control
string is left in them and ``read_back`` restores every turn. The loss mask covers the
texts of assistant turns.

Defined results: null text and null role count as empty; a null conv_id is a
conversation of its own; equal turn numbers are ordered by role and text; repeated rows
are turns of their own; conversations without rows do not exist; extra columns are
ignored. One conversation is one row of output and is held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed strings of the template.
BEGIN, JOIN, END = "<s>", "[+]", "</s>"
#: What is escaped in a text: a backslash, or the first character of a control string.
CONTROL = r"\\|\[(?=/?INST\]|ASSISTANT\]|ROLE:|/ROLE\]|\+\])|<(?=/?s>)"


def escape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, CONTROL, r"$0\\")


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(role: F.Column) -> F.Column:
    name = F.regexp_replace(role, r"[\\\]]", r"\\$0")
    return (
        F.when(role == "user", F.lit("[INST]"))
        .when(role == "assistant", F.lit("[ASSISTANT]"))
        .otherwise(F.concat(F.lit("[ROLE:"), name, F.lit("]")))
    )


def _closing(role: F.Column) -> F.Column:
    return F.when(role == "user", F.lit("[/INST]")).when(role == "assistant", F.lit(END)).otherwise(F.lit("[/ROLE]"))


def turns_of(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): sorted array of struct(turn, role, text)."""
    one = F.struct(
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def merge_blocks(turns: F.Column) -> F.Column:
    """Adjacent turns of one role as struct(role, first, last): positions in ``turns``, by array aggregation.

    Positions where the role changes are block starts; a block ends before the next start.
    """
    n = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(turns, a)["role"].alias("role"), a.alias("first"), b.alias("last")))


def format_chats(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, formatted): one templated string for each conversation."""
    turns = turns_of(rows, key, turn, role, text)
    escaped = turns.withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")))
    )
    blocks = escaped.withColumn("blocks", merge_blocks(F.col("turns")))
    texts = F.transform(F.col("turns"), lambda t: t["text"])
    body = F.transform(
        "blocks",
        lambda b: F.concat(
            F.lit(BEGIN), _opening(b["role"]), F.array_join(F.slice(texts, b["first"] + 1, b["last"] - b["first"]), JOIN), _closing(b["role"])
        ),
    )
    return blocks.select(key, F.array_join(body, "").alias("formatted"))


#: One block of formatted text: role mark, then escaped text up to its closing mark.
BLOCK = r"(?s)<s>(\[(?:INST|ASSISTANT|ROLE:(?:\\.|[^\\\]])*+)\])(.*?)(?:\[/INST\]|\[/ROLE\]|</s>)"


def read_back(formatted: F.Column) -> F.Column:
    """The turns of a formatted conversation: array of struct(role, text)."""
    marks = F.regexp_extract_all(formatted, F.lit(BLOCK), 1)
    bodies = F.regexp_extract_all(formatted, F.lit(BLOCK), 2)

    def role(mark: F.Column) -> F.Column:
        return (
            F.when(mark == "[INST]", F.lit("user"))
            .when(mark == "[ASSISTANT]", F.lit("assistant"))
            .otherwise(unescape(F.substring(mark, F.lit(7), F.length(mark) - 7)))
        )

    parts = F.zip_with(
        marks,
        bodies,
        lambda m, b: F.transform(F.split(b, r"\[\+\]", -1), lambda t: F.struct(role(m).alias("role"), unescape(t).alias("text"))),
    )
    return F.flatten(parts)


def digests(formatted: DataFrame, key: str = "conv_id", column: str = "formatted") -> DataFrame:
    """What a reader of the formatted text sees: turns, text under the loss mask, and their digests."""
    read = formatted.withColumn("__turns", read_back(F.col(column)))
    whole = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("__turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.select(
        key,
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length(column).cast("long").alias("formatted_chars"),
    )
