"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is rendered as `<|im_start|>ROLE`, a line feed, TEXT, `<|im_end|>` and a line feed. The rendered
conversation is parsed again by a deterministic grammar; where the turns read back aren't the source, their
content is escaped: a backslash goes into each `<|` (one more where some are there already), and in roles also
line feeds and backslashes are escaped. Reading back takes one away again, so any text survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: The role whose texts are under the loss mask.
LEARNT = "assistant"


def escape(text: Column) -> Column:
    """No `<|` is left: `<|` becomes `<\\|`, `<\\|` becomes `<\\\\|`, and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def render(turns: Column, escaped: bool) -> Column:
    role, text = (escape_role, escape) if escaped else (lambda c: c, lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), role(t["role"]), F.lit("\n"), text(t["text"]), F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, still escaped; null where it isn't a sentence of the grammar (no `<|` in content)."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    bodies = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    rest = lambda s: F.substring(s, F.lit(len(START) + 1), F.length(s))
    role = lambda s: F.substring_index(rest(s), "\n", 1)
    turn = lambda s: F.struct(role(s).alias("role"), F.substring(rest(s), F.length(role(s)) + 2, F.length(s)).alias("text"))
    good = F.forall(bodies, lambda s: F.startswith(s, F.lit(START)) & F.contains(rest(s), F.lit("\n")) & ~F.contains(rest(s), F.lit("<|")))
    return F.when((F.element_at(parts, -1) == "") & good, F.transform(bodies, turn))


def read_back(formatted: Column) -> Column:
    return F.transform(parse(formatted), lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: formatted, escaped (whether content had to be), turns as read back from it, identical.

    Turns stand in the order of turn, then role, then text (nulls first). A null text or role is empty; a null
    conv_id is a conversation of its own; repeated rows are turns of their own; an empty table gives no row. Other
    columns don't matter. identical is true for every row: escaped content always reads back as it was.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    chats = conversations.select("conv_id", F.struct("turn", role, text).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = chats.withColumn("formatted", render(F.col("source"), False)).withColumn("escaped", ~F.col("source").eqNullSafe(read_back(F.col("formatted"))))
    chosen = plain.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("formatted")))
    return chosen.withColumn("turns", read_back(F.col("formatted"))).withColumn("identical", F.col("source").eqNullSafe(F.col("turns"))).drop("source")


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == LEARNT), lambda t: t["text"]), "")


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what format_chats() read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
