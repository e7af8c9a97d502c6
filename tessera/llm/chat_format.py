"""Chat formatting with a grammar round trip, as DataFrame expressions.

A turn is written ``<|im_start|>role⏎text<|im_end|>⏎``. Rendering proposes the plain text
first, parses it again with the grammar, and compares what comes back with the source; a
turn that comes back changed is escaped, rendered and compared once more, and a
conversation that still differs stops the job. So only conflicting content is escaped, and
what is written can always be read back.

Escape: ``<`` followed by backslashes and ``|`` gets one backslash more, which keeps every
``<|`` for the template; reading takes one away. In roles a newline is written ``<\\n|``,
by the same rule read back first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As :func:`escape`; then newlines, and what already looks like one, are spelt out."""
    return F.replace(F.regexp_replace(escape(role), r"<(n+)\|", r"<n$1|"), F.lit("\n"), F.lit("<n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(F.regexp_replace(role, r"<n\|", "\n"), r"<n(n+)\|", r"<$1|"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, unescaped: array of (role, text).

    Deterministic: cut at every end mark, wherever it stands; what is left must begin with
    a start mark, hold a newline and no other ``<|``. Any other piece is returned with a
    null role.
    """
    pieces = F.split(formatted, r"<\|im_end\|>\n?")
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        good = F.startswith(piece, F.lit(OPEN)) & (cut > 0) & (F.locate("<|", piece, 2) == 0)
        role = F.substring(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        return F.struct(
            F.when(good, unescape_role(role)).alias("role"),
            F.when(good, unescape(F.substring(piece, cut + 1, F.length(piece)))).alias("text"),
        )

    return F.transform(whole, turn)


def chat_format(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn_role: str = "assistant",
) -> DataFrame:
    """One row for each conversation: ``conv_col``, n_turns, formatted, loss_spans.

    ``formatted`` is the rendered text; ``loss_spans`` holds (start, end) code points of
    each ``learn_role`` text in it, end exclusive, in order. Turns stand by ``turn_col``;
    ties by role, then text, null first, and repeated rows stay as turns of their own. A
    null role or text counts as empty. Rows with a null conversation id form one
    conversation. Other columns are not read. An empty table gives an empty result.

    One shuffle, by conversation, serves the running positions and the assembly.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), role.alias("r"), text.alias("x"))

    # propose plain text; where a turn doesn't come back as it is, escape it
    def survives(written_role: Column, written_text: Column) -> Column:
        back = parse(render(written_role, written_text))
        return (F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == F.col("r")) & (F.get(back, F.lit(0))["text"] == F.col("x"))

    # only these can clash: a mark, an escape, or a newline in a role
    suspect = F.col("x").contains("<") & F.rlike(F.col("x"), F.lit(r"<\\*\|")) | F.rlike(F.col("r"), F.lit(r"\n|<[\\n]*\|"))
    plain = ~suspect | F.coalesce(survives(F.col("r"), F.col("x")), F.lit(False))
    rows = rows.withColumn("plain", plain)
    rows = rows.select(
        "c",
        "t",
        "r",
        "x",
        F.when(F.col("plain"), F.col("r")).otherwise(escape_role(F.col("r"))).alias("wr"),
        F.when(F.col("plain"), F.col("x")).otherwise(escape(F.col("x"))).alias("wx"),
    ).withColumn("piece", render(F.col("wr"), F.col("wx")))

    order = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "r", "x")
    placed = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    stop = F.col("end") - len(CLOSE)
    placed = placed.select(
        "c",
        F.struct(
            "n",
            "piece",
            F.struct(F.col("r").alias("role"), F.col("x").alias("text")).alias("source"),
            F.when(F.col("r") == learn_role, F.struct((stop - F.length("wx")).alias("start"), stop.alias("end"))).alias("span"),
        ).alias("turn"),
    )
    whole = placed.groupBy("c").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    built = whole.select(
        "c",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.col("turns.piece")).alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.col("turns.source").alias("source"),
    )
    # the whole conversation must come back, too
    proved = F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a formatted conversation doesn't parse back to its turns")).cast(T.StringType())
    )
    return built.select(F.col("c").alias(conv_col), "n_turns", proved.alias("formatted"), "loss_spans")


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws(
        "", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    )
