"""Quotation linking: from quoting messages to reply-ordered conversations without quotes, in DataFrame functions.

1. Lines are parsed for their nested quote level (leading `>` marks); a line that announces a quote (`... wrote:`)
   belongs to it. Runs of lines of one level are passages.
2. Passages are normalised (lower case, single spaces) and hashed, and so are the own words of every message:
   whole, by paragraph and by line. So are the lines and the paragraphs of a passage as sequences, and the own
   sequences of the same lengths, for quotes of a part of a message.
3. A passage is joined to the latest earlier message of its conversation that says it itself, or whose own lines
   or paragraphs hold it as consecutive ones. This is an as-of
   join by hash: the latest turn in each span of turns is aggregated first, so that neither a common line nor a
   long conversation makes pairs.
4. A message replies to the latest original among its first-level passages, else to nothing. Threads are
   resolved by pointer doubling, in as many rounds as the logarithm of the longest reply chain.

Edge cases: null and empty texts are empty messages; a very long message is so many lines; of several originals
(ties) the latest turn is taken; an empty table gives an empty result; rows that repeat a whole message count once; other messages
of the same conversation and turn stay side by side; null conversations or turns are kept and link to nothing;
quotes that no earlier message says link to nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import cut, table

MARKS = r"^(?:\x20{0,2}>)+"
ANNOUNCE = r"(?i)^.{0,200}(wrote|writes|a écrit|schrieb|escribió)\x20*:\x20*$"
#: Turns of one span, whose latest saying is aggregated before spans are joined.
TURNS = 256


def normalised(text: Column) -> Column:
    """Lower case, with white space as single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def lines(messages: DataFrame) -> DataFrame:
    """One row per line of (conv_id, turn, key, text): at, depth, body, run (number of its passage)."""
    split = messages.select("conv_id", "turn", "key", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("at", "line"))
    marked = split.withColumn("marks", F.regexp_extract("line", MARKS, 0)).select(
        "conv_id", "turn", "key", "at", (F.length("marks") - F.length(F.replace("marks", F.lit(">"), F.lit("")))).alias("depth"), F.expr("trim(substring(line, length(marks) + 1))").alias("body"), "line"
    )
    in_order = Window.partitionBy("key").orderBy("at")
    following = F.lead("depth").over(in_order)
    announced = marked.withColumn("announces", F.col("body").rlike(ANNOUNCE) & (following > F.col("depth")))
    started = announced.withColumn("new", F.coalesce((F.lag("depth").over(in_order) != F.col("depth")) | F.lag("announces").over(in_order) | F.col("announces") | ((F.col("depth") == 0) & (F.lag("body").over(in_order) == "")), F.lit(True)))
    return started.withColumn("run", F.sum(F.col("new").cast("int")).over(in_order))


def _hash(text: Column) -> Column:
    return F.md5(normalised(text))


def passages(of_lines: DataFrame) -> DataFrame:
    """One row per quoted passage and hash: conv_id, turn, key, run, depth, hash, n.

    The first hash (n = 1) is of the whole; the others are of its lines and of its paragraphs, n of them, if several.
    """
    quoted = of_lines.where("depth > 0 and not announces")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n")
    whole = quoted.groupBy("conv_id", "turn", "key", "run").agg(F.first("depth").alias("depth"), body.alias("passage")).where(F.trim(F.replace("passage", F.lit("\n"), F.lit(" "))) != "")
    lines, paragraphs = (F.transform(F.filter(F.split("passage", p, -1), lambda x: normalised(x) != ""), _hash) for p in (r"\n", r"\n\s*\n"))
    several = F.filter(F.array_distinct(F.array(*[F.struct(_sequence(x).alias("hash"), F.size(x).alias("n")) for x in (lines, paragraphs)])), lambda x: x["n"] > 1)
    every = F.concat(F.array(F.struct(_hash(F.col("passage")).alias("hash"), F.lit(1).alias("n"))), several)
    return whole.select("conv_id", "turn", "key", "run", "depth", F.explode(every).alias("x")).select("conv_id", "turn", "key", "run", "depth", "x.hash", "x.n")


def _sequence(hashes: Column) -> Column:
    return F.md5(F.array_join(hashes, ","))


def sayings(of_lines: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of what messages say themselves: whole, by paragraph and by line."""
    own = of_lines.where("depth = 0 and not announces and trim(body) != ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), " ")
    whole = own.groupBy("conv_id", "turn", "key").agg(joined.alias("said"))
    paragraph = own.groupBy("conv_id", "turn", "key", "run").agg(joined.alias("said"))
    return whole.select("conv_id", "turn", "said").union(paragraph.select("conv_id", "turn", "said")).union(own.select("conv_id", "turn", F.col("body").alias("said"))).select("conv_id", "turn", _hash(F.col("said")).alias("hash")).distinct()


def sequences(of_lines: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of consecutive own lines, and of consecutive own paragraphs, in the lengths that the conversation's passages have."""
    lengths = quoted.where("n > 1").groupBy("conv_id").agg(F.collect_set("n").alias("lengths"))
    own = of_lines.where("depth = 0 and not announces and trim(body) != ''").join(lengths, "conv_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), " ")
    by_line = own.select("conv_id", "turn", "key", "lengths", "at", _hash(F.col("body")).alias("hash"))
    by_paragraph = own.groupBy("conv_id", "turn", "key", "run").agg(F.first("lengths").alias("lengths"), F.min("at").alias("at"), _hash(joined).alias("hash"))

    def of(parts: DataFrame) -> DataFrame:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"])
        held = parts.groupBy("conv_id", "turn", "key").agg(F.first("lengths").alias("lengths"), in_order.alias("parts"))
        starts = lambda n: F.sequence(F.lit(1), F.size("parts") - n + 1)
        some = F.transform(F.filter("lengths", lambda n: n <= F.size("parts")), lambda n: F.transform(starts(n), lambda i: _sequence(F.slice("parts", i, n))))
        return held.select("conv_id", "turn", F.explode(F.flatten(some)).alias("hash"))

    return of(by_line).union(of(by_paragraph.select("conv_id", "turn", "key", "lengths", "at", "hash"))).distinct()


def originals(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """The quoted passages with `original`: the latest earlier turn of the conversation that says them, if any."""
    wanted = said.join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").withColumn("span", F.floor(F.col("turn") / TURNS))
    # Latest saying before each span of turns: one row for each passage and span.
    by_span = wanted.groupBy("conv_id", "hash", "span").agg(F.max("turn").alias("last"))
    asked = quoted.withColumn("span", F.floor(F.col("turn") / TURNS))
    marks = by_span.unionByName(asked.select("conv_id", "hash", "span", F.lit(None).cast(dict(by_span.dtypes)["last"]).alias("last")).distinct()).groupBy("conv_id", "hash", "span").agg(F.max("last").alias("last"))
    before = marks.withColumn("before", F.max("last").over(Window.partitionBy("conv_id", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)))
    # Latest saying within the span: at most TURNS sayings and the span's passages in order.
    both = wanted.select("conv_id", "hash", "span", "turn", F.col("turn").alias("says")).withColumns({"key": F.lit(None).cast("bigint"), "run": F.lit(None).cast("bigint"), "depth": F.lit(None).cast("int")})
    both = both.unionByName(asked.select("conv_id", "hash", "span", "turn", F.lit(None).cast(dict(by_span.dtypes)["last"]).alias("says"), "key", "run", "depth"))
    within = both.withColumn("near", F.max("says").over(Window.partitionBy("conv_id", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))).where("key is not null")
    return within.join(before.select("conv_id", "hash", "span", "before"), ["conv_id", "hash", "span"], "left").groupBy("key", "run", "depth").agg(F.max(F.coalesce("near", "before")).alias("original"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of (conv_id, turn, parent), by pointer doubling.

    A parent is an earlier turn, so the order of turns within a root is a reply order.
    """
    now = cut(parents.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(0).alias("depth"), F.col("turn").alias("root")))
    while now.where("up is not null").limit(1).count():
        above = now.select(F.col("conv_id").alias("conv2"), F.col("turn").alias("turn2"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        step = now.where("up is not null").join(above, F.expr("conv_id = conv2 and up = turn2"), "left").select(
            "conv_id", "turn", F.col("up2").alias("up"), (F.col("depth") + 1 + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("root2", "root").alias("root")
        )
        now = cut(now.where("up is null").unionByName(step))
    return now.drop("up")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """One row per message, without quotes: conv_id, turn, role, text, quote_depth, n_passages, n_linked, reply_to, root, reply_depth.

    Messages in the order of (conv_id, root, turn) are threads in which each reply follows what it replies to.
    """
    typed = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    messages = table(typed.withColumn("key", F.monotonically_increasing_id()), "messages")
    quoting = messages.where(F.col("text").contains(">"))
    # Only conversations that quote need their sayings.
    talking = messages.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    of_lines = table(lines(talking), "lines")
    quoted = table(passages(of_lines), "passages")
    found = table(originals(quoted, sayings(of_lines).union(sequences(of_lines, quoted))), "originals")
    replies = found.groupBy("key").agg(F.max("depth").alias("quote_depth"), F.count("*").alias("n_passages"), F.count("original").alias("n_linked"), F.max(F.when(F.col("depth") == 1, F.col("original"))).alias("reply_to"))
    clean = of_lines.where("depth = 0 and not announces").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("clean"))
    clean = clean.select("key", F.trim(F.regexp_replace("clean", r"\n{3,}", "\n\n")).alias("clean"))
    described = table(
        messages.join(replies, "key", "left").join(clean, "key", "left").join(quoting.select("key", F.lit(True).alias("quotes")), "key", "left")
        .select("conv_id", "turn", "role", F.when(F.col("quotes"), F.coalesce("clean", F.lit(""))).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("quote_depth", F.lit(0)).alias("quote_depth"), F.coalesce("n_passages", F.lit(0)).cast("bigint").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "reply_to"),
        "described",
    )
    # Threads are resolved among the turns that reply or are replied to; all others are threads of their own.
    turns = described.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("parent"))
    replying = turns.where("parent is not null")
    needed = replying.unionByName(replying.select("conv_id", F.col("parent").alias("turn"), F.lit(None).cast("bigint").alias("parent"))).groupBy("conv_id", "turn").agg(F.max("parent").alias("parent"))
    placed = threads(needed)
    return described.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "quote_depth", "n_passages", "n_linked", "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("reply_depth")
    )
