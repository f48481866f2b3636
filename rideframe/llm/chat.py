"""Chat formatting with a grammar round trip, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The control strings of the template. A turn is START role NEWLINE text END NEWLINE;
#: ESCAPED stands after the role of a turn whose text is escaped.
START, END, ESCAPED, NEWLINE = "<|im_start|>", "<|im_end|>", "<|escaped|>", "\n"


def escape(text: Column) -> Column:
    """Reversible, and free of control strings: no '<|' is left."""
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def _role(role: Column) -> Column:
    """Roles are always escaped, line breaks too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def render_turn(role: Column, text: Column, escaped: Column) -> Column:
    return F.concat(F.lit(START), _role(role), F.when(escaped, F.lit(ESCAPED)).otherwise(F.lit("")), F.lit(NEWLINE), F.when(escaped, escape(text)).otherwise(text), F.lit(END + NEWLINE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, raw>> of a formatted conversation; null if it isn't one.

    Deterministic: cut at every END NEWLINE; each piece must begin with START, hold no other
    control string, and have its header on its first line.
    """
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        line = F.locate(NEWLINE, piece)
        header = F.substring(piece, F.lit(len(START) + 1), line - F.lit(len(START) + 1))
        body = F.substring(piece, line + 1, F.length(piece))
        escaped = header.endswith(ESCAPED)
        return F.struct(_role_back(F.replace(header, F.lit(ESCAPED), F.lit(""))).alias("role"), F.when(escaped, unescape(body)).otherwise(body).alias("text"), body.alias("raw"), escaped.alias("escaped"))

    def fits(piece: Column) -> Column:
        rest = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        return piece.startswith(START) & piece.contains(NEWLINE) & ~rest.contains(START) & ~rest.contains(END)

    return F.when((F.element_at(pieces, -1) == "") & F.forall(turns, fits), F.transform(turns, turn))


def _alike(turns: Column, source: Column) -> Column:
    same = F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))) == source
    return F.coalesce(same, F.lit(False))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (as parsed back), loss_spans.

    Rows come in order of turn, then role and text. Every turn is rendered plain and parsed
    by itself; where the parse differs from the source the turn is escaped. The whole
    conversation is then rendered, parsed and compared again; one that differs raises an
    error (END NEWLINE overlaps no copy of itself, so whole turns stay whole). loss_spans has
    (start, length, escaped) of the text of each turn of ``loss_role`` in ``formatted``, in
    code points from 0.

    Null texts and roles are empty; null conv_ids are one conversation; rows that repeat are
    turns of their own. A conversation is one row by its nature, so it must fit in a task;
    rows of all others are shuffled once, by conv_id, and never meet. An empty table gives an
    empty result; further columns are left out.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = render_turn(F.col("role"), F.col("text"), F.lit(False))
    source = F.array(F.struct("role", "text"))
    rows = rows.withColumn("escaped", ~_alike(parse(one), source))
    rows = rows.withColumn("piece", render_turn(F.col("role"), F.col("text"), F.col("escaped")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct("rank", "role", "text", "piece", "escaped", "end")))
    convs = rows.groupBy("conv_id").agg(listed.alias("all"))
    source = F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    text = F.array_join(F.transform("all", lambda x: x["piece"]), "")
    convs = convs.select("conv_id", "all", source.alias("source"), text.alias("formatted")).withColumn("turns", parse(F.col("formatted")))
    convs = convs.withColumn("turns", F.when(_alike(F.col("turns"), F.col("source")), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation doesn't survive its format")).cast("array<struct<role:string,text:string,raw:string,escaped:boolean>>")))
    tail = len(END) + len(NEWLINE)
    spans = F.transform(
        F.filter(F.arrays_zip("all", "turns"), lambda x: x["turns"]["role"] == loss_role),
        lambda x: F.struct((x["all"]["end"] - tail - F.length(x["turns"]["raw"])).cast("long").alias("start"), F.length(x["turns"]["raw"]).cast("long").alias("length"), x["turns"]["escaped"].alias("escaped")),
    )
    return convs.select("conv_id", "formatted", "turns", spans.alias("loss_spans"))
