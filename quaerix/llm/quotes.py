"""Quotation linking, in DataFrame functions only.

Lines that begin with ``>`` are quoted; the number of marks is the level. Runs of lines of one
level are passages. Passages and their lines are normalised and hashed and joined to the lines,
paragraphs and whole own texts of the messages of the same conversation; the
earliest message with a unit is its original. A message replies to the latest
original of its passages of level 1; threads are messages that reply to each other, and a
conversation in reply order is its threads by their first turn, each in order of turns. Parents precede
children, so every reply follows what it answers. Quotes are left out of the texts. `conversations` builds
conversations from the numbered messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaerix.llm.common import join_keyed, materialize

MARKS = r"^((?:[ \t]?>)+)"
#: Up to so many quoting conversations are broadcast (16 bytes each) to leave out the others' messages early.
MAX_BROADCAST = 1 << 19


def normal(text: Column) -> Column:
    """Lower case, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\f\x0B]+", " "))


def _hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def parsed(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Adds lines: array of (level, body), clean: the text without quotes, and quote_levels: the deepest level."""
    raw = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    marks = lambda x: F.regexp_extract(x, MARKS, 1)
    line = lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + r"[ \t]?", "").alias("body"))
    quoted = F.coalesce(F.col(text), F.lit("")).rlike(r"(?m)" + MARKS)
    plain = F.array(F.struct(F.lit(0).alias("level"), F.coalesce(F.col(text), F.lit("")).alias("body")))
    out = messages.withColumn("_quoted", quoted).withColumn("_lines", F.when(F.col("_quoted"), F.transform(raw, line)).otherwise(plain))
    own = F.filter("_lines", lambda x: x["level"] == 0)
    kept = F.regexp_replace(F.concat_ws("\n", F.transform(own, lambda x: x["body"])), r"^\n+|\n+$", "")
    clean = F.when(F.col("_quoted"), F.regexp_replace(kept, r"\n{3,}", "\n\n")).otherwise(F.coalesce(F.col(text), F.lit("")))
    return out.withColumn("clean", clean).withColumn("quote_levels", F.array_max(F.transform("_lines", lambda x: x["level"])).cast("long"))


def passages(quoting: DataFrame) -> DataFrame:
    """(conv, turn, passage, level, unit, size): for each run of quoted lines of one level its whole text's hash and its lines'.

    *quoting* is materialised. Where a run begins is found by comparing each line with the one before, and
    a run is a slice of the lines: work in proportion to the message.
    """
    level = lambda i: F.get("_lines", i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    begun = quoting.select("conv", "turn", "_lines", starts.alias("_s"))
    # A generator between the two steps: the starts are found once, not once for each run.
    runs = begun.select("conv", "turn", "_lines", F.posexplode(F.arrays_zip(F.col("_s").alias("a"), F.concat(F.slice("_s", F.lit(2), F.size("_s")), F.array(F.size("_lines"))).alias("b"))).alias("passage", "r"))
    runs = runs.filter(level(F.col("r.a")) > 0).select("conv", "turn", "passage", level(F.col("r.a")).alias("level"), F.slice("_lines", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")).alias("x"))
    bodies = F.filter(F.transform("x", lambda s: normal(s["body"])), lambda s: s != "")
    runs = runs.withColumn("b", bodies).filter(F.size("b") > 0)
    units = F.array_distinct(F.concat(F.array(F.concat_ws(" ", "b")), F.col("b")))
    return runs.select("conv", "turn", "passage", "level", F.explode(F.transform(units, lambda u: F.struct(_hash(u).alias("unit"), F.length(u).alias("size")))).alias("u")).select("conv", "turn", "passage", "level", "u.*")


def originals(messages: DataFrame) -> DataFrame:
    """(conv, unit, original): the first turn whose own text has the unit as a line, a paragraph or the whole."""
    lines = F.transform(F.split("clean", "\n"), normal)
    parts = F.transform(F.split("clean", r"\n[ \t]*\n"), lambda p: normal(F.regexp_replace(p, "\n", " ")))
    whole = F.array(normal(F.regexp_replace("clean", r"\n", " ")))
    units = F.filter(F.array_distinct(F.concat(lines, parts, whole)), lambda u: u != "")
    return messages.select("conv", "turn", F.explode(F.transform(units, _hash)).alias("unit")).groupBy("conv", "unit").agg(F.min("turn").alias("original"))


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, passage, level, original): original is null for a passage that no earlier message has; of several units the longest found counts."""
    quoting = materialize(messages.filter("_quoted").select("conv", "turn", "_lines"), "quoting")
    units = materialize(passages(quoting), "units")
    n = units.count()
    convs = units.select("conv").distinct()
    pool = messages
    if n and convs.count() <= MAX_BROADCAST:
        pool = messages.join(F.broadcast(convs), "conv", "left_semi")
    key = F.md5(F.concat_ws(":", F.col("conv").cast("string"), "unit"))
    asked = units.filter("conv is not null").withColumn("key", key)
    counts = asked.groupBy("key").agg(F.count("*").alias("m"))
    known = originals(pool if n else pool.limit(0)).withColumn("key", key).select("key", "original")
    found = join_keyed(asked, materialize(known.join(counts, "key"), "known"), "key", "m", n)
    found = found.filter(F.col("original") < F.col("turn")).groupBy("conv", "turn", "passage", "level").agg(F.max_by("original", F.struct("size", "original")).alias("original"))
    every = units.select("conv", "turn", "passage", "level").distinct()
    return every.join(found, ["conv", "turn", "passage", "level"], "left")


#: Messages of a conversation that are numbered in one task, and messages of one part of a built conversation, at most.
LARGE, MESSAGES = 1 << 17, 1024


def _numbered(rows: DataFrame, convs: DataFrame, large: int) -> DataFrame:
    """Adds position: 1, 2, ... within conv_id by thread and turn; null without a conversation. *convs* has the conv_id of every row.

    Rows of a conversation with more than *large* messages are sorted into ranges; a range counts its own rows and adds those of the ranges before it.
    """
    order = [F.col(c).asc_nulls_first() for c in ("thread", "turn", "role", "clean_text")]
    heat = materialize(convs.filter("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("_m")).filter(F.col("_m") > large).select("conv_id"), "heat")
    # Fewer than one in *large* rows.
    names = F.broadcast(heat) if heat.count() <= MAX_BROADCAST else heat
    hot = not heat.isEmpty()
    few = rows.filter("conv_id is not null")
    few = few.join(names, "conv_id", "left_anti") if hot else few
    few = few.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long"))
    none = rows.filter("conv_id is null").withColumn("position", F.lit(None).cast("long"))
    out = few.unionByName(none)
    if not hot:
        return out
    many = rows.join(names, "conv_id", "left_semi")
    ranged = materialize(many.repartitionByRange("conv_id", *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("conv_id", "_pid").agg(F.count("*").alias("_k"))
    earlier = Window.partitionBy("conv_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv_id", "_pid", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_pid", "conv_id").orderBy(*order))
    numbered = ranged.withColumn("_at", inside).join(ends, ["conv_id", "_pid"]).withColumn("position", F.col("_at") + F.col("_before"))
    return out.unionByName(numbered.select(out.columns))


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_rounds: int = 64, large: int = LARGE) -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to, thread, position, n_passages, n_linked, quote_levels, clean_text.

    reply_to and thread are turns of the same conversation (thread: the first of
    the replies' chain; the own turn of a message that replies to none); position is the message's place in its conversation in reply order.
    Null text counts as empty; a null conversation or turn is linked with
    nothing, and a message without a conversation has no position. Rows that repeat a turn get the same links
    and places of their own; an empty table gives no rows; other columns are ignored.
    """
    rows = messages.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("_text"))
    rows = parsed(rows, "conv", "turn", "_text")
    links = materialize(quote_links(rows), "links")
    replies = links.groupBy("conv", "turn").agg(
        F.max(F.when(F.col("level") == 1, F.col("original"))).alias("reply_to"), F.count("*").alias("n_passages"), F.count("original").alias("n_linked")
    )
    replies = materialize(replies, "replies")
    # Pointer doubling: after k rounds a pointer spans 2 ** k replies.
    top = replies.filter("reply_to is not null").select("conv", "turn", F.col("reply_to").alias("up"))
    for _ in range(max_rounds):
        if top.isEmpty():
            break
        hop = top.select("conv", F.col("turn").alias("up"), F.col("up").alias("far"))
        joined = materialize(top.join(hop, ["conv", "up"], "left"), "threads")
        top = joined.select("conv", "turn", F.coalesce("far", "up").alias("up"))
        if joined.filter("far is not null").isEmpty():
            break
    threads = materialize(replies.join(top, ["conv", "turn"], "left"), "replies")
    # One row for each quoting turn; other messages meet no row.
    out = rows.join(threads, ["conv", "turn"], "left").select(
        F.col("conv").alias("conv_id"), "turn", "role", "reply_to", F.coalesce("up", "turn").alias("thread"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("quote_levels", F.lit(0)).cast("long").alias("quote_levels"), F.col("clean").alias("clean_text"),
    )
    return _numbered(out, rows.select(F.col("conv").alias("conv_id")), large).select("conv_id", "turn", "role", "reply_to", "thread", "position", "n_passages", "n_linked", "quote_levels", "clean_text")


def conversations(linked: DataFrame, most: int = MESSAGES) -> DataFrame:
    """(conv_id, part, messages) from `link_quotes`: messages in reply order without quotes, as an array of (position, turn, role, text).

    A part has at most *most* messages, so that no conversation is gathered as a whole; messages without a conversation are left out.
    """
    message = F.struct("position", "turn", "role", F.col("clean_text").alias("text"))
    parts = linked.filter("position is not null").withColumn("part", F.floor((F.col("position") - 1) / F.lit(most)).cast("long"))
    return parts.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(message)).alias("messages"))


def quoted_replies(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the messages of a table as they would be sent by mail.

    By conv_id + turn modulo 3, a message quotes the whole message before it, or the first lines of the two before it at levels 1 and 2, or nothing.
    """
    own = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    back = lambda k: own.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"b{k}"))
    both = own.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    first = lambda c: F.get(F.split(c, "\n"), F.lit(0))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    whole = F.concat(F.lit("> "), F.replace(F.col("b1"), F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"), "text")
    nested = F.concat(F.lit(">> "), first("b2"), F.lit("\n> "), first("b1"), F.lit("\n\n"), "text")
    text = F.when((kind == 1) & F.col("b1").isNotNull(), whole).when((kind == 2) & F.col("b2").isNotNull() & F.col("b1").isNotNull(), nested).otherwise(F.col("text"))
    return both.select("conv_id", "turn", "role", text.alias("text"))


_NORM = r"trim(regexp_replace(lower({}), '[ \t\r\f\x0B]+', ' ', 'g'))"
#: Of `link_quotes` over `quoted_replies`.
ORACLE = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations),
m AS (SELECT t.conv_id, t.turn, t.role, CASE WHEN (t.conv_id + t.turn) % 3 = 1 AND p.x IS NOT NULL THEN '> ' || replace(p.x, chr(10), chr(10) || '> ') || chr(10) || chr(10) || t.x
        WHEN (t.conv_id + t.turn) % 3 = 2 AND p.x IS NOT NULL AND g.x IS NOT NULL THEN '>> ' || string_split(g.x, chr(10))[1] || chr(10) || '> ' || string_split(p.x, chr(10))[1] || chr(10) || chr(10) || t.x ELSE t.x END AS t
      FROM t LEFT JOIN t p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1 LEFT JOIN t g ON g.conv_id = t.conv_id AND g.turn = t.turn - 2),
l AS (SELECT conv_id, turn, u.pos, length(regexp_replace(regexp_extract(u.x, '^((?:[ \t]?>)+)', 1), '[^>]', '', 'g')) AS level,
             regexp_replace(u.x, '^((?:[ \t]?>)+)[ \t]?', '') AS body
      FROM m, LATERAL (SELECT unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS pos) u),
q AS (SELECT conv_id, turn, max(level) AS deepest FROM l GROUP BY ALL),
o AS (SELECT m.conv_id, m.turn, m.role, m.t, coalesce(q.deepest, 0) AS deepest, CASE WHEN coalesce(q.deepest, 0) > 0
        THEN regexp_replace(regexp_replace(coalesce(string_agg(l.body, chr(10) ORDER BY l.pos) FILTER (l.level = 0), ''), '^\n+|\n+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') ELSE m.t END AS own
      FROM m LEFT JOIN q USING (conv_id, turn) LEFT JOIN l USING (conv_id, turn) GROUP BY m.conv_id, m.turn, m.role, m.t, q.deepest),
r AS (SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n
      FROM (SELECT *, lag(level, 1, -1) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS before FROM l)),
b AS (SELECT conv_id, turn, n, level, pos, {_NORM.format('body')} AS b FROM r WHERE level > 0 AND {_NORM.format('body')} <> ''),
u AS (SELECT conv_id, turn, n, level, string_agg(b, ' ' ORDER BY pos) AS unit FROM b GROUP BY ALL UNION SELECT conv_id, turn, n, level, b FROM b),
w AS (SELECT conv_id, min(turn) AS original, unit FROM (
        SELECT conv_id, turn, {_NORM.format("replace(own, chr(10), ' ')")} AS unit FROM o
        UNION SELECT conv_id, turn, {_NORM.format('unnest(string_split(own, chr(10)))')} FROM o
        UNION SELECT conv_id, turn, {_NORM.format("replace(unnest(regexp_split_to_array(own, '\n[ \t]*\n')), chr(10), ' ')")} FROM o) GROUP BY ALL),
k AS (SELECT u.conv_id, u.turn, u.n, any_value(u.level) AS level, arg_max(w.original, length(u.unit) * 1000000000 + w.original) FILTER (w.original < u.turn) AS original
      FROM u LEFT JOIN w ON w.conv_id = u.conv_id AND w.unit = u.unit GROUP BY ALL),
f AS (SELECT conv_id, turn, max(CASE WHEN level = 1 THEN original END) AS reply_to, count(*) AS n_passages, count(original) AS n_linked FROM k GROUP BY ALL),
c AS (SELECT conv_id, turn, reply_to AS up FROM f WHERE reply_to IS NOT NULL
      UNION SELECT c.conv_id, c.turn, f.reply_to FROM c JOIN f ON f.conv_id = c.conv_id AND f.turn = c.up WHERE f.reply_to IS NOT NULL),
z AS (SELECT o.conv_id, o.turn, o.role, f.reply_to, coalesce((SELECT min(up) FROM c WHERE c.conv_id = o.conv_id AND c.turn = o.turn), o.turn) AS thread,
       coalesce(f.n_passages, 0) AS n_passages, coalesce(f.n_linked, 0) AS n_linked, o.deepest::BIGINT AS quote_levels, o.own AS clean_text
      FROM o LEFT JOIN f USING (conv_id, turn))
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, role, clean_text) AS position FROM z
"""
