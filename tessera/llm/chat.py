r"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<s" flag ">[INST]" role "[/INST]" body "</s>"
    flag         := "" | "\"          (with "\", role and body are escaped)

A conversation is rendered with verbatim turns and parsed again by a deterministic parser; where the
recovered turns differ from the source, the turns that do not survive on their own are escaped, and if that
were not enough, all turns.  The first rendering that parses back to the source is the output, so ordinary
text is never changed.  Escaping writes ``\b``, ``\l`` and ``\o`` for the backslash, ``<`` and ``[``; no control
string can remain, and it is undone exactly.

The loss mask is kept as one run a turn: characters to skip in the rendered turn, then characters under the
mask (none but in an assistant's turn).  DataFrame and SQL functions only.  A conversation is one row of the
result, so its turns meet in one task; the partial aggregation before the shuffle sends one row a task.

Defined results for odd input: null roles and texts are empty; turns are ordered by turn (null first), role,
text, so rows with equal turn numbers have one order; a null conversation id is a conversation of its own;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CONTROL_PROBE = r"</s>[INST] ok [/INST]"
PLAIN, ESCAPED, CLOSE, END = "<s>[INST]", "<s\\>[INST]", "[/INST]", "</s>"
TURN = "struct<role:string,text:string>"


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _escape(x: str) -> str:
    return f"replace(replace(replace({x}, '\\\\', '\\\\b'), '<', '\\\\l'), '[', '\\\\o')"


def _unescape(x: str) -> str:
    return f"replace(replace(replace({x}, '\\\\o', '['), '\\\\l', '<'), '\\\\b', '\\\\')"


def _render_turn(role: str, text: str, escaped: bool) -> str:
    if escaped:
        return f"concat({_sql(ESCAPED)}, {_escape(role)}, {_sql(CLOSE)}, {_escape(text)}, {_sql(END)})"
    return f"concat({_sql(PLAIN)}, {role}, {_sql(CLOSE)}, {text}, {_sql(END)})"


def _parts(formatted: str) -> str:
    """The rendered turns without their ends; what follows the last end must be empty and is checked by `_parse`."""
    return f"split({formatted}, '</s>', -1)"


def _turn_of(part: str) -> str:
    """The turn that a part spells, null if it is none."""
    at = f"locate({_sql(CLOSE)}, {part})"
    body = f"substring({part}, {at} + {len(CLOSE)})"
    plain, escaped = len(PLAIN), len(ESCAPED)
    return (
        f"CASE WHEN {at} > 0 AND startswith({part}, {_sql(PLAIN)}) THEN "
        f"named_struct('role', substring({part}, {plain + 1}, {at} - {plain + 1}), 'text', {body}) "
        f"WHEN {at} > 0 AND startswith({part}, {_sql(ESCAPED)}) THEN "
        f"named_struct('role', {_unescape(f'substring({part}, {escaped + 1}, {at} - {escaped + 1})')}, 'text', {_unescape(body)}) END"
    )


def _parse(formatted: str) -> str:
    """The turns of a rendering, null if it does not follow the grammar."""
    return (
        f"CASE WHEN {formatted} = '' THEN CAST(array() AS array<{TURN}>) WHEN endswith({formatted}, '</s>') THEN "
        f"transform(slice({_parts(formatted)}, 1, size({_parts(formatted)}) - 1), p -> {_turn_of('p')}) END"
    )


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned_role: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv``, ``formatted`` and ``loss_runs`` (array of struct skip, take; one a turn)."""
    row = F.struct(
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    chats = df.groupBy(F.col(f"`{conv}`").alias("_conv")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    chats = chats.withColumn("_turns", F.expr("transform(_rows, r -> named_struct('role', r.role, 'text', r.text))")).drop("_rows")
    plain, escaped = _render_turn("t.role", "t.text", False), _render_turn("t.role", "t.text", True)
    alone = _render_turn("t.role", "t.text", False)
    chats = chats.withColumn("_verbatim", F.expr(f"array_join(transform(_turns, t -> {plain}), '')"))
    chats = chats.withColumn("_same", F.expr(f"coalesce({_parse('_verbatim')} = _turns, false)"))
    # Only conversations that fail are rendered again, with the turns escaped that do not come back on their own.
    single = f"coalesce({_parse(alone)} = array(t), false)"
    chats = chats.withColumn("_second", F.expr(f"CASE WHEN NOT _same THEN array_join(transform(_turns, t -> CASE WHEN {single} THEN {plain} ELSE {escaped} END), '') END"))
    chats = chats.withColumn("_second_same", F.expr(f"CASE WHEN NOT _same THEN coalesce({_parse('_second')} = _turns, false) END"))
    chats = chats.withColumn(
        "formatted", F.expr(f"CASE WHEN _same THEN _verbatim WHEN _second_same THEN _second ELSE array_join(transform(_turns, t -> {escaped}), '') END")
    )
    runs = (
        f"transform(slice({_parts('formatted')}, 1, size(_turns)), (p, i) -> named_struct("
        f"'skip', CAST(locate({_sql(CLOSE)}, p) + {len(CLOSE) - 1} AS bigint), "
        f"'take', CASE WHEN _turns[i].role = {_sql(learned_role)} THEN CAST(length(p) - locate({_sql(CLOSE)}, p) - {len(CLOSE) - 1} AS bigint) ELSE 0L END))"
    )
    return chats.withColumn("loss_runs", F.expr(runs)).select(F.col("_conv").alias(conv), "formatted", "loss_runs")


def recovered(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, parsed from ``formatted``, and ``loss_text``, the unescaped text under the mask."""
    masked = "substring(p, CAST(r.skip AS int) + 1, CAST(r.take AS int))"
    loss = (
        f"array_join(zip_with(slice({_parts('formatted')}, 1, size(loss_runs)), loss_runs, (p, r) -> "
        f"CASE WHEN startswith(p, {_sql(ESCAPED)}) THEN {_unescape(masked)} ELSE {masked} END), '')"
    )
    return formatted.withColumn("turns", F.expr(_parse("formatted"))).withColumn("loss_text", F.expr(loss))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL_PROBE).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x"),
    )
    back = recovered(format_chats(chats.unionByName(probe.select("conv_id", "x.*"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
