"""Chat formatting in budgeted windows. DataFrame operations only.

``format_windows(conversations)`` gives one row per training window of a conversation. Prefix sums of turn tokens choose
turn-aligned spans: a window opens at the first turn that would pass the budget. It retains the leading system turn,
repeats the last turns before it as history while they fit the history budget and its turn limit, and masks every
repeated turn, so each assistant turn is a target exactly once. A turn is never cut: one that is larger than the
budget fills a window of its own, flagged ``over_budget``.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|`` (a newline in a role becomes ``\\n``), so control strings in texts cannot be mistaken for marks and the
escaping is undone by one pass. Loss spans are code point offsets into the formatted text and cover assistant texts only.

Defined results: null texts and roles count as empty; rows of equal conv_id and turn are ordered by role, then text; a
null turn comes first; null conv_ids form one conversation; repeated rows are turns of their own; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY_TOKENS, HISTORY_TURNS, TURN_OVERHEAD = 1024, 256, 4, 4
#: A token, for budgets: a run of letters, a run of digits, or any other visible character.
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undo ``escape``: one pass over the escape pairs."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)  # between escaped backslashes
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def _boundaries(turns: Column, budget: int, history: int, history_turns: int) -> Column:
    """Fold over the turns' prefix sums; emits one (first turn, first repeated turn) per window."""
    span = F.sequence(F.lit(1), F.size(turns))

    def tokens(i: Column) -> Column:
        return F.element_at(turns, i)["tokens"]

    system = F.when(F.element_at(turns, 1)["role"] == "system", tokens(F.lit(1))).otherwise(0)

    def step(acc: Column, i: Column) -> Column:
        before = F.element_at(turns, i)["before"]  # tokens of all turns before this one
        full = (before - acc["base"] + tokens(i) + system > budget) & (i > acc["open"])
        # history: the furthest turn from which everything up to here fits, turn limit and system turn apart
        first = F.greatest(i - history_turns, F.when(system > 0, 2).otherwise(1))
        back = F.filter(F.sequence(F.least(first, i), i), lambda j: before - F.element_at(turns, j)["before"] <= F.least(F.lit(history), F.greatest(F.lit(0), budget - system - tokens(i))))
        start = F.array_min(back)
        opened = F.struct(F.array_append(acc["out"], F.struct(i.alias("first"), start.alias("back"))).alias("out"), F.element_at(turns, start)["before"].alias("base"), i.alias("open"))
        return F.when(full, opened).otherwise(acc)

    out = F.array(F.struct(F.lit(1).alias("first"), F.lit(1).alias("back")))
    zero = F.struct(out.alias("out"), system.cast("long").alias("base"), F.lit(1).alias("open"))
    return F.aggregate(F.slice(span, 2, F.size(turns)), zero, step, lambda acc: acc["out"])


def format_windows(conversations: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """conv_id, window, n_context (repeated turns in front), tokens, over_budget, formatted, loss_spans array<struct<start,end>>."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.regexp_count(text, F.lit(TOKEN)) + TURN_OVERHEAD).cast("long").alias("tokens"))
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "tokens", "before"))).alias("t"))
    turns = turns.withColumn("n", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["tokens"].alias("tokens"), x["before"].alias("before"))))
    marks = turns.select("conv_id", "t", _boundaries(F.col("n"), budget, history_tokens, history_turns).alias("w"))
    leads = F.element_at("t", 1)["role"] == "system"

    def span(at: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("w", i + 1)["first"], F.size("t") + 1)
        system = F.slice("t", 1, F.when((i > 0) & leads, 1).otherwise(0))
        context = F.concat(system, F.slice("t", at["back"], at["first"] - at["back"]))
        return F.struct(context.alias("context"), F.slice("t", at["first"], stop - at["first"]).alias("new"))

    # (outer: else a filter on the size of the spans is inferred, which computes them again inside itself)
    # the spans of a conversation hold each turn once and its repeats; only they are copied per window
    window = marks.select("conv_id", F.transform("w", span).alias("s")).select("conv_id", F.posexplode_outer("s").alias("window", "s")).select("conv_id", "window", "s.context", "s.new")
    new = F.transform("new", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["tokens"].alias("tokens"), (x["role"] == "assistant").alias("loss")))
    old = F.transform("context", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["tokens"].alias("tokens"), F.lit(False).alias("loss")))
    pieces = F.transform(
        F.concat(old, new),
        lambda x: F.struct(F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), x["tokens"].alias("tokens"), x["loss"].alias("loss")),
    )
    laid = window.select("conv_id", "window", F.size("context").alias("n_context"), pieces.alias("p"))
    tail = END + "\n"
    spans = F.aggregate(
        F.transform("p", lambda x: F.struct(F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"), x["loss"].alias("loss"))),
        F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("a"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(x["loss"], F.array_append(acc["a"], F.struct((acc["at"] + x["head"]).alias("start"), (acc["at"] + x["head"] + x["body"]).alias("end")))).otherwise(acc["a"]).alias("a"),
            (acc["at"] + x["head"] + x["body"] + len(tail)).alias("at"),
        ),
        lambda acc: acc["a"],
    )
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"])
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "")
    return laid.select("conv_id", "window", "n_context", tokens.alias("tokens"), (tokens > budget).alias("over_budget"), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window, unescaped: array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring_index(F.substr(p, F.instr(p, "\n") + 1), END, 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted windows: turns and loss digests and sizes."""
    read = windows.select("conv_id", "window", F.length("formatted").alias("chars"), F.filter(read_turns(F.col("formatted")), lambda _, i: i >= F.col("n_context")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.struct("window", lines.alias("lines"), "loss", F.size("turns").alias("n"), "chars").alias("w"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("w.n").alias("n_turns"), F.sum("w.chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["lines"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
