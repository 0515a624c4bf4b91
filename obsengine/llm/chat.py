"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens cut a conversation at turn boundaries into spans. A window is the system turn, some
turns of the span before as history, and the span. Only the assistant's turns of the span itself are under the loss
mask: history is repeated, its targets are not. Turns are marked by a template, and a text's own control strings
are escaped so that the template's can always be told apart; `unescape` gives back the text. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>"


def escape(text: Column) -> Column:
    """Backslashes doubled, and a backslash set inside the template's strings: neither `###` nor `</turn>` remains."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("#\\##"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    """Each backslash gives way to the character after it."""
    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda x: F.replace(x, F.lit("\\"), F.lit(""))), "\\")


def escape_role(role: Column) -> Column:
    """A role as `escape` has it, its colons and line ends marked too, so that `:\\n` ends it."""
    return F.replace(escape(role), F.lit(":\n"), F.lit(":\\\n"))


def tokens(text: Column) -> Column:
    """How many words and other signs a text holds: the budget's unit."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def windows(turns: DataFrame, budget: int = 512, history: int = 128, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`(conv_id, window, turns_before, turns_new, n_tokens, formatted, loss)`, a row for each window.

    Prefix sums of the turns' tokens are cut at multiples of `budget - history` less the system turn's tokens. Turns
    between two cuts are a span; a turn across a cut is a span of its own, and is never cut itself. So `n_tokens` keeps
    to the budget wherever the system turn and the longest turn do; a longer one stands alone with the system turn.
    Before the
    span's `turns_new` turns stand `turns_before` others: the system turn and the history, the latest turns of at most
    `history` tokens in the span before, as far as the budget has room. `loss` lists `(start, length)` of the assistant's texts in `formatted`,
    escaped, counted in characters from 0. Turns go by turn, then role and text; nulls come first and count as empty.
    Repeated rows stay, rows of null `conv_id` are one conversation, other columns are left aside whatever their names,
    and an empty table gives an empty result. A conversation without a system turn (its first turn) has none in its windows.
    """
    blank = F.lit("")
    own = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = own.withColumn("n", tokens(F.col("text")).cast("long")).withColumn("nth", F.row_number().over(ordered))
    first = F.first(F.struct("role", "text", "n")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("system", F.when(first["role"] == "system", first)).withColumn("lead", F.coalesce(F.col("system.n"), F.lit(0)))
    rows = rows.withColumn("own", F.when((F.col("nth") == 1) & F.col("system").isNotNull(), 0).otherwise(F.col("n")))
    rows = rows.withColumn("begin", F.coalesce(F.sum("own").over(before), F.lit(0))).withColumn("end", F.col("begin") + F.col("own"))
    size = F.greatest(F.lit(budget - history) - F.col("lead"), F.lit(1))
    cell, last = F.floor(F.col("begin") / size), F.floor(F.greatest(F.col("end") - 1, F.col("begin")) / size)
    rows = rows.withColumn("span", 2 * cell + (last > cell).cast("int")).withColumn("window", (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("span")) - 1).cast("long"))
    rows = rows.withColumn("stop", F.max("end").over(Window.partitionBy("conv_id", "window")))
    following = F.max("stop").over(Window.partitionBy("conv_id").orderBy("window").rangeBetween(1, 1))
    room = F.least(F.lit(history), F.lit(budget) - F.col("lead") - (following - F.col("stop")))
    again = (F.col("stop") - F.col("begin") <= room) & (F.col("nth") > F.when(F.col("system").isNotNull(), 1).otherwise(0))
    rows = rows.withColumn("later", following.isNotNull() & F.coalesce(again, F.lit(False)))
    own_place = F.struct(F.lit(2).alias("kind"), "nth", "role", "text", "n", (F.col("role") == "assistant").alias("target"))
    copies = F.when(F.col("later"), F.array(F.struct(F.col("window").alias("window"), own_place.alias("t")), F.struct((F.col("window") + 1).alias("window"), own_place.withField("kind", F.lit(1)).withField("target", F.lit(False)).alias("t"))))
    placed = rows.select("conv_id", "system", F.explode(copies.otherwise(F.array(F.struct(F.col("window").alias("window"), own_place.alias("t"))))).alias("p"))
    grouped = placed.groupBy("conv_id", F.col("p.window").alias("window")).agg(F.sort_array(F.collect_list("p.t")).alias("turns"), F.first("system", ignorenulls=True).alias("system"))
    grouped = grouped.where(F.exists("turns", lambda t: t["kind"] == 2))
    lead = F.when((F.col("window") > 0) & F.col("system").isNotNull(), F.array(F.struct(F.lit(0).alias("kind"), F.lit(1).alias("nth"), F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.col("system.n").alias("n"), F.lit(False).alias("target"))))
    grouped = grouped.withColumn("turns", F.concat(F.coalesce(lead, F.slice("turns", 1, 0)), F.col("turns")))

    def marked(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(MIDDLE))
        body = escape(t["text"])
        return F.struct(head.alias("head"), body.alias("body"), (F.length(head) + F.length(body) + len(CLOSE) + 1).cast("long").alias("size"), F.length(head).cast("long").alias("lead"), t["target"].alias("target"))

    grouped = grouped.withColumn("marked", F.transform("turns", marked))
    at = F.aggregate("marked", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss")), lambda s, m: F.struct((s["at"] + m["size"]).alias("at"), F.when(m["target"], F.array_append(s["loss"], F.struct((s["at"] + m["lead"]).alias("start"), F.length(m["body"]).cast("long").alias("length")))).otherwise(s["loss"]).alias("loss")))
    formatted = F.array_join(F.transform("marked", lambda m: F.concat(m["head"], m["body"], F.lit(CLOSE + "\n"))), "")
    new = F.size(F.filter("turns", lambda t: t["kind"] == 2))
    spent = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["n"])
    return grouped.select("conv_id", "window", (F.size("turns") - new).alias("turns_before"), new.alias("turns_new"), spent.alias("n_tokens"), formatted.alias("formatted"), at["loss"].alias("loss"))


def parsed(formatted: Column) -> Column:
    """The turns in a formatted text: an array of `(role, text)`."""
    parts = F.filter(F.split(formatted, "</turn>\n"), lambda x: x.startswith(OPEN))

    def one(part: Column) -> Column:
        at = F.instr(part, MIDDLE)
        role, text = F.substr(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1), F.substr(part, at + len(MIDDLE))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, one)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, from `windows`'s output alone: its turns and what is under the loss mask.

    `(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`. The digest of a conversation needs it
    whole, so a conversation is put together in one task, as it is written in one training example after another.
    """
    own = formatted.withColumn("all", parsed(F.col("formatted")))
    own = own.withColumn("new", F.slice("all", F.col("turns_before") + 1, F.greatest(F.col("turns_new"), F.lit(1))))
    said = F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    own = own.select("conv_id", F.struct("window", said.alias("said"), loss.alias("loss"), F.size("new").alias("n"), F.length("formatted").alias("chars")).alias("w"))
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    join = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x[name])
    return own.select("conv_id", total("n").alias("n_turns"), F.sha2(join("said"), 256).alias("turns_sha256"), F.length(join("loss")).cast("long").alias("loss_chars"), F.sha2(join("loss"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"))
