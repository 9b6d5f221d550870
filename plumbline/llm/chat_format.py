"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the rendered text::

    conversation = { turn }
    turn         = "<s>[INST] " role " [/INST] " body "</s>"

``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` are control strings. Roles and
bodies may not hold one, so the parser is deterministic: ``</s>`` ends a turn
and the first `` [/INST] `` ends its role.

Each turn is rendered as it is and parsed again. Where the parser rejects it
or returns another role or body, its content conflicts with the grammar, and
the turn is escaped: every control string gets one backslash after its first
character, also those that hold backslashes there already. Reading takes one
off. Both are inverse to each other whatever the text, so one pass is enough;
the rendered turn is parsed once more and the result is part of the output
(``round_trip``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"

#: A control string, with any number of backslashes after its first character.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"

#: Roles of which the text is trained on.
TRAINED = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), body, F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """The turns of a rendered text, as array<struct<role, text, start, length>>.

    start and length are the body's place in the rendered text, in code
    points. Pieces that break the grammar come back with role and text null.
    """
    pieces = F.split(rendered, CLOSE, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        middle = F.locate(MIDDLE, piece, len(OPEN))
        role = F.substring(piece, F.lit(len(OPEN) + 1), middle - (len(OPEN) + 1))
        body = F.substring(piece, middle + len(MIDDLE), F.length(piece))
        plain = r"[<\[](/?s>|/?INST\])"
        ok = piece.startswith(OPEN) & (middle > 0) & ~role.rlike(plain) & ~body.rlike(plain)
        return F.struct(
            F.when(ok, unescape(role)).alias("role"), F.when(ok, unescape(body)).alias("text"), F.length(body).alias("length"), F.length(piece).alias("size")
        )

    return F.transform(pieces, turn)


def format_turns(rows: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, role, text, rendered, escaped, round_trip.

    Null roles and texts count as empty.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("raw", render(F.col("role"), F.col("text")))

    def same(rendered: Column) -> Column:
        back = parse(rendered)
        return F.coalesce((F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text")), F.lit(False))

    turns = turns.withColumn("escaped", ~same(F.col("raw")))
    safe = render(escape(F.col("role")), escape(F.col("text")))
    turns = turns.withColumn("rendered", F.when(F.col("escaped"), safe).otherwise(F.col("raw")))
    return turns.withColumn("round_trip", ~F.col("escaped") | same(F.col("rendered"))).drop("raw")


def format_conversations(rows: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_starts, loss_lengths, round_trip.

    Turns stand in order of turn, and for equal turns of role and text; rows
    without conv_id are one conversation. The loss mask is given as the place
    (code points of ``formatted``, from 0) of each trained role's body, still
    escaped. A conversation without rows does not appear.
    """
    turns = format_turns(rows).withColumn("size", F.length("rendered"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("n", F.row_number().over(order))
    turns = turns.withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.coalesce("at", F.lit(0)) + len(OPEN) + F.length(F.when(F.col("escaped"), escape(F.col("role"))).otherwise(F.col("role"))) + len(MIDDLE)
    turns = turns.withColumn("start", first).withColumn("body", F.col("size") - (F.col("start") - F.coalesce("at", F.lit(0))) - len(CLOSE))
    parts = F.sort_array(F.collect_list(F.struct("n", "rendered", "start", "body", F.col("role").isin(*trained).alias("trained"))))
    made = turns.groupBy("conv_id").agg(parts.alias("parts"), F.bool_and("round_trip").alias("round_trip"))
    masked = F.filter("parts", lambda p: p["trained"])
    return made.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("formatted"),
        F.transform(masked, lambda p: p["start"].cast("long")).alias("loss_starts"),
        F.transform(masked, lambda p: p["body"].cast("long")).alias("loss_lengths"),
        "round_trip",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the output holds: the parsed turns and the text under the loss mask."""
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    spans = F.arrays_zip("loss_starts", "loss_lengths")
    loss = F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(F.col("formatted"), (s["loss_starts"] + 1).cast("int"), s["loss_lengths"].cast("int")))), ""
    )
    parsed = parsed.withColumn("said", said).withColumn("loss", loss)
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
