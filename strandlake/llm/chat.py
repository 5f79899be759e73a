r"""Operator 9: chat formatting in budgeted windows.

Template: ``### role\n`` + text + ``</turn>\n``.  Inside roles and texts ``\\``, ``#`` and ``<`` become ``\b``, ``\h`` and
``\l`` (in roles a line feed becomes ``\n``), so no control string can occur there, and three replacements undo it.

A turn costs ceil(code points / 4) + 4 tokens, or what a column of counts says.  Prefix sums of the cost put each turn at a
place in its conversation and into a block of ``BLOCK_TOKENS``; inside a block turns are taken in order as long as they fit
beside the system turn and the room kept for history, and a new span begins with the first that doesn't (and with each
block).  A window is the conversation's leading system turn, the whole turns right before the span that fit into ``history``
tokens and into what the budget leaves, and the span.  So no window is over the budget, but for those of a single turn that
doesn't fit beside the system turn: it stands alone with it.  The loss mask covers the texts of the span's assistant turns
only: repeated turns are context, so each target is trained on once.

A window's and a block's rows are bounded by their tokens, so a conversation that holds a third of all rows is still built
in many groups; its running sums are taken block by block of turn numbers.  Turns are written once with their place, and which
turns a window holds is worked out on narrow rows; texts are joined to that at the end.  Only the read-back of the query, whose
digest is defined over a whole conversation, puts one conversation's windows side by side.

Defined cases: null text is empty, null role is an empty role, null turns come first; rows that share a turn number are
ordered by role and text, repeated rows are repeated turns; null conv_id is a conversation; an empty table gives an empty
table; a turn longer than the budget is kept whole, in a window of its own; null or negative counts cost nothing; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

BUDGET, HISTORY = 1024, 256
OPEN, CLOSE = "### ", "</turn>\n"
TARGET = "assistant"
#: Turn numbers of one block of a conversation's running sum, and tokens of one block of turns that are cut into spans together.
BLOCK, BLOCK_TOKENS = 1024, 1 << 14


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column) -> Column:
    return _replace(_replace(_replace(c, "\\", "\\b"), "#", "\\h"), "<", "\\l")


def unescape(c: Column) -> Column:
    return _replace(_replace(_replace(c, "\\l", "<"), "\\h", "#"), "\\b", "\\")


def _escape_role(c: Column) -> Column:
    return _replace(escape(c), "\n", "\\n")


def _unescape_role(c: Column) -> Column:
    return unescape(_replace(c, "\\n", "\n"))


def turns(conversations: DataFrame, tokens: str | None = None) -> DataFrame:
    """Rows with their cost and rendering: __conv (never null), conv_id, turn, role, text, cost, end (running cost), start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cost = F.ceil(F.char_length(text) / 4) + 4 if tokens is None else F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), cost.cast("long").alias("cost"),
    )
    rows = rows.withColumns({"__conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "__block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))})
    # places and running costs: sums of blocks become offsets, and one window runs inside a block only
    before = Window.partitionBy("__conv").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("__conv", "__block").agg(F.count("*").alias("n"), F.sum("cost").alias("c"))
    blocks = blocks.select("__conv", "__block", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"__{x}") for x in ("n", "c")])
    inner = Window.partitionBy("__conv", "__block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"place": F.row_number().over(inner).cast("long"), "end": F.sum("cost").over(inner)}).join(blocks, ["__conv", "__block"])
    end = F.col("end") + F.col("__c")
    return rows.select("__conv", "conv_id", "turn", "role", "text", "cost", (F.col("place") + F.col("__n")).alias("place"), end.alias("end"), (end - F.col("cost")).alias("start"))


def spans(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """(__conv, place, cost, start, leads, system, span) of the ``rows`` of ``turns``: span is the place of its first turn, leads
    says that the turn is the conversation's system turn, and system what that one costs."""
    leads = (F.col("place") == 1) & (F.col("role") == "system")
    narrow = rows.select("__conv", "place", "cost", "start", leads.alias("leads"), F.floor(F.col("start") / BLOCK_TOKENS).alias("block"))
    system = narrow.where("leads").select("__conv", F.col("cost").alias("system"))
    turn = F.struct("place", "start", "cost", "leads")
    groups = narrow.groupBy("__conv", "block").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    groups = groups.join(system, "__conv", "left").withColumn("system", F.coalesce("system", F.lit(0)))
    room = F.lit(budget - history) - F.col("system")
    zero = F.expr("named_struct('span', cast(0 AS bigint), 'used', cast(0 AS bigint), 'out', cast(array() AS array<bigint>))")

    def add(acc: Column, x: Column) -> Column:
        own = F.when(x["leads"], 0).otherwise(x["cost"])  # the system turn has its own share of the budget
        new = (acc["used"] > 0) & (acc["used"] + own > room)
        span = F.when((acc["span"] == 0) | new, x["place"]).otherwise(acc["span"])
        used = F.when(new, own).otherwise(acc["used"] + own)
        return F.struct(span.alias("span"), used.alias("used"), F.concat(acc["out"], F.array(span)).alias("out"))

    cut = groups.withColumn("s", F.aggregate("t", zero, add, lambda acc: acc["out"]))
    return cut.select("__conv", "system", F.inline(F.arrays_zip("t", "s"))).select("__conv", "t.*", "system", F.col("s").alias("span"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """One row a window: conv_id, window (place of its first turn), n_context (turns repeated as context), n_turns, formatted, loss.

    ``loss`` is an array of (start, length) code-point spans of ``formatted``, start counted from 0.  ``tokens`` names a column
    with each turn's count of tokens, template included.
    """
    if not 0 <= history <= budget:
        raise ValueError("history must lie between 0 and the budget")
    with scratch(conversations.sparkSession):
        rows = materialize(turns(conversations, tokens), "turns", keep=True)
        placed = materialize(spans(rows, budget, history), "spans", keep=True)
    own = F.when(F.col("leads"), 0).otherwise(F.col("cost"))
    every = placed.select("__conv", "place", "span", F.lit(2).alias("kind"))
    if history:  # a history lies in two stretches of that length, turns without cost at its end in the second
        asked = placed.groupBy("__conv", "span").agg(F.min("start").alias("begin"), F.sum(own).alias("used"), F.first("system").alias("system"))
        left = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.col("system") - F.col("used")))
        asked = asked.select("__conv", "span", "begin", (F.col("begin") - left).alias("low")).where("begin > low AND span > 1")
        asked = asked.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("low") / history), F.floor(F.col("begin") / history))))
        before = placed.where("NOT leads").select("__conv", "place", "start", F.floor(F.col("start") / history).alias("stretch"))
        before = before.join(asked, ["__conv", "stretch"]).where("start >= low AND place < span")
        every = every.union(before.select("__conv", "place", "span", F.lit(1)))
    texts = ["conv_id", "role", "text"]
    names = ["__conv", "conv_id", "span", "kind", "place", "role", "text"]
    every = every.join(rows.select("__conv", "place", *texts), ["__conv", "place"]).select(*names)
    leading = rows.where("place = 1 AND role = 'system'").select("__conv", *texts)
    again = placed.where("place = span AND span > 1").select("__conv", "span", F.lit(0).alias("kind"), F.lit(1).cast("long").alias("place"))
    every = every.union(again.join(leading, "__conv").select(*names))
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    item = F.struct("kind", "place", head.alias("head"), body.alias("body"), ((F.col("kind") == 2) & (F.col("role") == TARGET)).alias("target"))
    made = every.groupBy("__conv", "span").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(item)).alias("t"))
    made = made.withColumn("formatted", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), ""))
    size = len(CLOSE)
    zero = F.expr("named_struct('at', 0, 'loss', cast(array() as array<struct<start:int,length:int>>))")

    def add(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.char_length(x["head"])
        n = F.char_length(x["body"])
        span = F.array(F.struct(at.alias("start"), n.alias("length")))
        return F.struct((at + n + size).alias("at"), F.when(x["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    return made.select(
        "conv_id", F.col("span").alias("window"), F.size(F.filter("t", lambda x: x["kind"] < 2)).alias("n_context"), F.size("t").alias("n_turns"),
        "formatted", F.aggregate("t", zero, add, lambda a: a["loss"]).alias("loss"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """One row a conversation, from the formatted text and loss spans of its windows alone."""
    parts = F.split("formatted", F.lit(CLOSE.replace("\n", "\\n")))
    fresh = F.slice(parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context"))

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        role = F.substring(x, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        return F.concat(_unescape_role(role), F.lit("\n"), unescape(F.substring(x, cut + 1, F.char_length(x))), F.lit("\n"))

    text = F.array_join(F.transform(fresh, turn), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    rows = made.select("conv_id", F.struct(F.col("window"), F.size(fresh).alias("n"), text.alias("text"), loss.alias("loss"), F.char_length("formatted").alias("size")).alias("w"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))

    def joined(k: str) -> Column:
        return F.array_join(F.transform("w", lambda x: x[k]), "")

    def total(k: str) -> Column:
        return F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[k])

    rows = rows.select("conv_id", total("n").alias("n_turns"), F.sha2(joined("text"), 256).alias("turns_sha256"), joined("loss").alias("l"), total("size").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.char_length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"), "formatted_chars")
