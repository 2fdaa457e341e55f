"""Chat formatting in budgeted windows, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubitgrid.llm.spans import let, running

#: Control strings, with any number of escapes after the first character. Turns read
#: [SYS]...[/SYS], [INST]...[/INST] and [ANS]...</s>; [TURN]role[/TURN] stands before [INST] for any other role.
CONTROL = r"([\[<])(\\*)(/?(?:SYS|INST|ANS|TURN)\]|/?s>)"
ESCAPED = r"([\[<])\\(\\*)(/?(?:SYS|INST|ANS|TURN)\]|/?s>)"
TURN = r"(?s)(?:\[TURN\].*?\[/TURN\])?\[(?:SYS|INST|ANS)\].*?(?:\[/SYS\]|\[/INST\]|</s>)"
#: What costs a token: up to four letters, a digit, a symbol. Few words of a large vocabulary take more tokens.
PIECE = r"\p{L}{1,4}|\p{N}|[^\x09-\x0d \p{L}\p{N}]"
MARKS = 4


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def _head(role: Column) -> Column:
    return F.when(role == "system", "[SYS]").when(role == "user", "[INST]").when(role == "assistant", "[ANS]").otherwise(F.concat(F.lit("[TURN]"), escape(role), F.lit("[/TURN][INST]")))


def _foot(role: Column) -> Column:
    return F.when(role == "system", "[/SYS]").when(role == "assistant", "</s>").otherwise("[/INST]")


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens: str | None = None) -> DataFrame:
    """(conv_id, window, formatted, targets, n_repeated): each conversation as training windows.

    A turn costs MARKS and its tokens: the column `tokens`, which may hold exact counts, or else its pieces (PIECE), an
    estimate from above. A window holds the system turn, if it would otherwise be missing, then those last turns of
    the span before that cost `history` at most and fit, then its span. The budget less the system turn (half the
    budget, if that turn costs more) is left for both; prefix sums of the costs place a turn in the span of half of it
    in which it begins, and a turn that costs more than that half is a span of its own. So spans are whole turns, and
    a window stays within the budget, but for a turn or system turn that doesn't fit on its own: no turn is cut.
    targets are the (start, length) in code points, from 0, of the escaped assistant texts of the span: repeated
    turns, n_repeated of them at the front, are not learned again.

    Turns are ordered by turn, nulls first, equal ones by role and text; null role and text are empty; rows
    without conv_id are one conversation. An empty table gives no windows.
    """
    count = F.regexp_count("text", F.lit(PIECE)) if tokens is None else F.coalesce(F.col(tokens).cast("bigint"), F.lit(0))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), (count + MARKS).alias("cost"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    up = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = Window.partitionBy("conv_id")
    span = Window.partitionBy("conv_id", "window")
    rows = rows.withColumns({"n": F.row_number().over(by), "end": F.sum("cost").over(up)})
    rows = rows.withColumn("sys", F.min(F.when(F.col("role") == "system", F.struct("n", "text", "cost"))).over(each))
    rows = rows.withColumn("room", F.greatest(F.lit(budget) - F.coalesce(F.col("sys.cost"), F.lit(0)), F.lit(budget // 2)))
    half = F.floor(F.col("room") / 2)
    rows = rows.withColumns({"span": F.floor((F.col("end") - F.col("cost")) / half), "alone": F.col("cost") > half})
    new = (F.col("span") != F.lag("span").over(by)) | F.col("alone") | F.lag("alone").over(by)
    rows = rows.withColumn("new", F.coalesce(new.cast("int"), F.lit(1)))
    rows = rows.withColumn("window", F.sum("new").over(up))
    rows = rows.withColumns({"last": F.max("window").over(each), "span_end": F.max("end").over(span)})
    # what the next window has left for history: the room less its own span
    sizes = Window.partitionBy("conv_id").orderBy("window").rangeBetween(1, 1)
    rows = rows.withColumn("next_cost", F.coalesce(F.sum("cost").over(sizes), F.lit(0)))
    left = F.least(F.lit(history), F.col("room") - F.col("next_cost"))
    again = (F.col("window") < F.col("last")) & (F.col("span_end") - (F.col("end") - F.col("cost")) <= left)
    dealt = rows.withColumn("at", F.explode(F.when(again, F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("again")), F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("again")))).otherwise(F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("again"))))))
    got = dealt.groupBy("conv_id", F.col("at.window").alias("window")).agg(F.array_sort(F.collect_list(F.struct(F.col("n"), F.col("at.again").alias("again"), F.col("role"), F.col("text")))).alias("turns"), F.first("sys").alias("sys"))
    system = F.struct(F.col("sys.n").alias("n"), F.lit(True).alias("again"), F.lit("system").alias("role"), F.col("sys.text").alias("text"))
    got = got.withColumn("turns", F.when(F.col("sys").isNotNull() & (F.col("sys.n") < F.col("turns")[0]["n"]), F.concat(F.array(system), F.col("turns"))).otherwise(F.col("turns")))
    got = got.withColumn("turns", F.transform("turns", lambda t: F.struct(t["again"].alias("again"), t["role"].alias("role"), _head(t["role"]).alias("head"), escape(t["text"]).alias("text"), _foot(t["role"]).alias("foot"))))
    ends = running(F.transform("turns", lambda t: F.char_length(t["head"]) + F.char_length(t["text"]) + F.char_length(t["foot"])))
    placed = let(ends, lambda e: F.transform("turns", lambda t, i: F.struct((F.get(e, i) - F.char_length(t["foot"]) - F.char_length(t["text"])).alias("start"), F.char_length(t["text"]).cast("bigint").alias("length"), ((t["role"] == "assistant") & ~t["again"]).alias("own"))))
    targets = F.transform(F.filter(placed, lambda t: t["own"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))

    return got.select(
        "conv_id",
        F.col("window").cast("bigint").alias("window"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], t["foot"])), "").alias("formatted"),
        targets.alias("targets"),
        F.size(F.filter("turns", lambda t: t["again"])).cast("bigint").alias("n_repeated"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from windows() alone.

    The digest of a conversation needs its turns as one string, which has to fit in a row.
    """
    bare = lambda t: F.regexp_replace(t, r"^\[TURN\](?s:.*?)\[/TURN\]", "")
    role = lambda t: F.when(t.startswith("[SYS]"), "system").when(t.startswith("[INST]"), "user").when(t.startswith("[ANS]"), "assistant").otherwise(unescape(F.regexp_extract(t, r"^\[TURN\]((?s).*?)\[/TURN\]", 1)))
    text = lambda t: unescape(F.regexp_extract(bare(t), r"^\[(?:SYS|INST|ANS)\]((?s).*)(?:\[/SYS\]|\[/INST\]|</s>)$", 1))
    turns = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))
    own = formatted.select("conv_id", "window", F.char_length("formatted").cast("bigint").alias("chars"), F.slice(turns, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(turns) - F.col("n_repeated").cast("int"), F.lit(0))).alias("turns"), F.array_join(F.transform("targets", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "").alias("loss"))
    own = own.select("conv_id", "window", "chars", "loss", F.size("turns").cast("bigint").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(role(t), F.lit("\n"), text(t), F.lit("\n"))), "").alias("turns"))
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda w: w["loss"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda w: w["turns"]), ""), 256).alias("turns_sha256"), F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
