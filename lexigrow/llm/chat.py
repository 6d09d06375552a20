r"""Conversations as one text each, whose turns can be read back exactly.

A turn is rendered as ``### role: text</turn>`` and a line end. The reader is deterministic: a
backslash makes the next character plain; a role holds no bare ``#`` and ends at a bare ``: ``; a
text ends at a bare ``</turn>`` and holds no bare ``### ``. A turn is rendered as it is and read back; if role and
text do not come back the same, its backslashes are doubled, and if that is not enough, its
control strings get a backslash too. So texts without conflicts stay as they are, and every
turn ends up identical. The text of assistant turns is under the loss mask.

Everything is built-in column functions. Turns are rendered where they lie; one exchange by
conversation orders and joins them. A conversation becomes one value, so it has to fit into one
task, however it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: A whole turn; possessive, so the matcher neither backtracks nor recurses on long texts.
TURN = r"(?s)### ((?:[^\\:#]++|\\.|:(?! ))*+): ((?:[^\\<#]++|\\.|<(?!/turn>)|#(?!## ))*+)</turn>\n"


def _doubled(x: Column) -> Column:
    return F.replace(x, F.lit("\\"), F.lit("\\\\"))


def _guarded(x: Column) -> Column:
    """Backslashes doubled, and one before each control string; also at the end of a text,
    where what follows could complete one."""
    x = F.replace(_doubled(x), F.lit("</turn>"), F.lit("\\</turn>"))
    return F.regexp_replace(x, r"#(?=## |#{0,2}$)", r"\\$0")


def _guarded_role(x: Column) -> Column:
    return F.regexp_replace(_doubled(x), "[#:]", r"\\$0")


def _plain(x: Column) -> Column:
    """The text that an escaped text stands for."""
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(COLON), text, F.lit(CLOSE))


def read_roles(formatted: Column) -> Column:
    """The roles of a formatted conversation."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), _plain)


def read_texts(formatted: Column) -> Column:
    """The texts of a formatted conversation."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2)), _plain)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, each span read back."""
    return F.transform(spans, lambda s: _plain(F.substring(formatted, s["start"] + 1, s["length"])))


def _comes_back(role: Column, text: Column, own_role: Column, own_text: Column) -> Column:
    """Whether a rendered turn is read as one turn of that role and text, with nothing left."""
    whole = _rendered(role, text)
    return (
        (read_roles(whole) == F.array(own_role))
        & (read_texts(whole) == F.array(own_text))
        & (F.regexp_replace(whole, "^" + TURN, "") == "")
    )


def formatted_turns(turns: DataFrame) -> DataFrame:
    """Adds ``safe_role`` and ``safe_text`` to rows with ``role`` and ``text``: the least
    escaped form that comes back."""
    role, text = F.col("role"), F.col("text")
    steps = [(role, text), (_doubled(role), _doubled(text)), (_guarded_role(role), _guarded(text))]
    safe = F.struct(steps[2][0].alias("r"), steps[2][1].alias("t"))
    for r, t in reversed(steps[:2]):
        good = _comes_back(r, t, role, text)
        safe = F.when(good, F.struct(r.alias("r"), t.alias("t"))).otherwise(safe)
    return turns.withColumn("safe", safe).select(
        "*", F.col("safe.r").alias("safe_role"), F.col("safe.t").alias("safe_text")
    ).drop("safe")


def format_conversations(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """``(id, formatted, loss_spans, same)``: one row for each conversation.

    Turns come by ``turn_col``, then role, then text; null numbers first, null roles and texts
    as empty. Rows that repeat are turns of their own, and rows without an id are one
    conversation. ``loss_spans`` are ``(start, length)`` in characters of ``formatted`` of the
    texts of ``loss_role``. ``same`` tells that the whole text, read back, is the source.
    """
    rows = turns.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    piece = _rendered(F.col("safe_role"), F.col("safe_text"))
    pieces = formatted_turns(rows).select(
        "id",
        "turn",
        "role",
        "text",
        piece.alias("piece"),
        (F.length("safe_role") + len(OPEN) + len(COLON)).alias("lead"),
        F.length("safe_text").alias("length"),
    )
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(
        "id",
        F.row_number().over(order).alias("place"),
        F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("base"),
        "role",
        "text",
        "piece",
        "lead",
        "length",
    )
    turn = F.struct("place", "role", "text", "piece", (F.col("base") + F.col("lead")).alias("start"), "length")
    whole = placed.groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.col("turns.piece"), "")
    under_loss = F.filter("turns", lambda t: t["role"] == loss_role)
    spans = F.transform(
        under_loss, lambda t: F.struct(t["start"].cast("int").alias("start"), t["length"].alias("length"))
    )
    joined = whole.select(
        "id",
        formatted.alias("formatted"),
        spans.alias("loss_spans"),
        F.col("turns.role").alias("roles"),
        F.col("turns.text").alias("texts"),
    )
    same = (read_roles(F.col("formatted")) == F.col("roles")) & (
        read_texts(F.col("formatted")) == F.col("texts")
    )
    return joined.select("id", "formatted", "loss_spans", same.alias("same"))
