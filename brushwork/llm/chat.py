"""Chat formatting by quotation linking, in DataFrame functions only.

A message's lines carry quote levels, the number of leading `>`. Runs of lines of one level, between blank lines, are passages.
Passages are normalised (lower case, single spaces) and hashed. A quoted passage, or failing that one of its lines, is
joined by hash to the first message of its conversation that has it as its own text. A message answers the latest message
that its shallowest linked quotes come from; deeper levels are linked too and counted. Quotes, and lines like `On ... wrote:`
above them, are taken out. A message that quotes nothing known opens a thread; others are in the thread of what they
answer. In order of (conv_id, thread, turn), every answer follows what it answers.

Links are joined with hot keys apart (a passage that most messages quote, a message that most answer), threads are found by
doubling, in as many rounds as the logarithm of the longest chain of answers; no conversation is gathered anywhere.

Nulls: a null text is empty; a null role is `unknown`; a null turn or conversation answers nothing and is its own thread.
Repeated rows get the same link each. Of equal passages the one with the least turn is the original; messages answer only
earlier turns. An empty table gives no rows. Only the named columns are read, so others can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import once
from ..session import materialise
from .common import meet, table

MARKS = r"^[ \t]{0,3}((?:>[ \t]?)+)"
ATTRIBUTION = r"^[ \t]*(On|Am|Le|El)[ \t].*(wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"  # fixed value: lines above a quote
BLANKS = r"[\x20\x09-\x0D]+"
ENDS = rf"^{BLANKS}|{BLANKS}$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), BLANKS, " "))


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per message: conv_id, turn, role, `clean` (its own text) and `passages`: level, hash, and hashes of single lines."""
    m = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
                        F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n").alias("_text"))
    marks = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))
    m = once(m, _lines=F.transform(F.split("_text", "\n"), lambda x: F.struct(
        marks(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))))
    line = lambda i: F.get(F.col("_lines"), i)
    blank = lambda i: F.coalesce(normalised(line(i)["body"]) == "", F.lit(True))
    edge = lambda i, j: ~blank(i) & (blank(j) | (line(i)["level"] != line(j)["level"]))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    wrote = lambda i: (line(i)["level"] == 0) & line(i)["body"].rlike(ATTRIBUTION) & F.coalesce(line(i + 1)["level"] > 0, F.lit(False))
    m = once(m, _first=F.filter(every, lambda i: edge(i, i - 1)), _last=F.filter(every, lambda i: edge(i, i + 1)),
             _own=F.transform(F.filter(every, lambda i: (line(i)["level"] == 0) & ~wrote(i)), lambda i: line(i)["body"]))
    spans = F.zip_with("_first", "_last", lambda a, b: F.struct(
        line(a)["level"].alias("level"), F.transform(F.slice("_lines", a + 1, b - a + 1), lambda x: normalised(x["body"])).alias("lines")))
    m = once(m, _spans=spans)
    return m.select("conv_id", "turn", "role", F.regexp_replace(F.array_join("_own", "\n"), ENDS, "").alias("clean"), F.transform("_spans", lambda p: F.struct(
        p["level"].alias("level"), F.md5(F.array_join(p["lines"], " ")).alias("hash"),
        F.transform(p["lines"], lambda x: F.md5(x)).alias("lines"))).alias("passages"))


def quotations(messages: DataFrame) -> DataFrame:
    """Every quoted passage of parsed messages: conv_id, turn, level, number, and `source`, the turn it comes from or null."""
    whole = lambda p: F.transform(F.concat(F.array(p["hash"]), p["lines"]), lambda h, i: F.struct(h.alias("hash"), (i == 0).alias("whole")))
    at = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode("passages").alias("number", "p"))
    own = (at.where("p.level = 0").select("conv_id", "turn", F.explode(whole(F.col("p"))).alias("h"))
           .select(F.struct("conv_id", F.col("h.hash").alias("hash")).alias("key"), "turn").groupBy("key").agg(F.min("turn").alias("source")))
    quoted = at.where("p.level > 0").distinct()
    asked = quoted.select("conv_id", "turn", "number", F.col("p.level").alias("level"), F.explode(whole(F.col("p"))).alias("h"))
    asked = materialise(asked.select("conv_id", "turn", "number", "level", F.col("h.whole").alias("whole"),
                                     F.struct("conv_id", F.col("h.hash").alias("hash")).alias("key")), "quotes")
    sizes = asked.groupBy("key").agg(F.count(F.lit(1)).alias("size")).join(own, "key")
    found = meet(asked, sizes, "key", "size", asked.count()).where("source < turn")
    best = found.groupBy("conv_id", "turn", "number", "level").agg(F.max(F.struct("whole", "source")).alias("best"))
    return (asked.select("conv_id", "turn", "number", "level").distinct().join(best, ["conv_id", "turn", "number", "level"], "left")
            .select("conv_id", "turn", "number", "level", F.col("best.source").alias("source")))


def threads(answers: DataFrame) -> DataFrame:
    """Of messages (conv_id, turn, reply_to), the first message of their chain of answers and its length."""
    now = materialise(answers.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")), "answers")
    total = now.count()
    while True:
        above = now.select(F.struct("conv_id", F.col("turn").alias("up")).alias("key"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        keyed = now.withColumn("key", F.struct("conv_id", "up"))
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).join(above, "key")
        moved = materialise(meet(keyed, sizes, "key", "size", total).select("conv_id", "turn", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth")), "moved")
        if moved.isEmpty():
            return now.select("conv_id", "turn", F.col("up").alias("thread"), "depth")
        now = materialise(now.join(moved.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").unionAll(moved), "threads")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per message: conv_id, turn, role, reply_to, thread, depth, n_quotes, n_linked and `formatted`, its own text under its role."""
    m = materialise(parsed(messages, conv, turn, role, text), "messages")
    quotes = materialise(quotations(m), "linked")
    first = F.min(F.when(F.col("source").isNotNull(), F.struct("level", (-F.col("source")).alias("back"))))
    links = quotes.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), (-first["back"]).alias("reply_to"))
    links = materialise(links, "links")
    placed = links.join(threads(links.where("reply_to is not null")), ["conv_id", "turn"], "left")
    none = F.lit(0).cast("long")
    return (m.join(placed, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", none).alias("depth"),
                    F.coalesce("n_quotes", none).alias("n_quotes"), F.coalesce("n_linked", none).alias("n_linked"),
                    F.concat(F.lit("<|"), "role", F.lit("|>\n"), "clean", F.lit("\n")).alias("formatted")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op8_chat_formatting": (op8_chat_formatting, r"""
        WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, 'unknown') AS role,
                                    regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM conversations),
        raw AS (SELECT id, conv_id, turn, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM m),
        l AS (SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '^[ \t]{0,3}((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level,
                     regexp_replace(x, '^[ \t]{0,3}((?:>[ \t]?)+)', '') AS body FROM raw),
        n AS (SELECT *, trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
        e AS (SELECT *, norm <> '' AND (lag(norm, 1, '') OVER w = '' OR lag(level) OVER w <> level) AS opens,
                     coalesce(level = 0 AND regexp_matches(body, '^[ \t]*(On|Am|Le|El)[ \t].*(wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$')
                              AND lead(level) OVER w > 0, false) AS wrote
              FROM n WINDOW w AS (PARTITION BY id ORDER BY i)),
        c AS (SELECT id, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT wrote), ''),
                                        '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS clean FROM e GROUP BY id),
        r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY id ORDER BY i) AS number FROM e QUALIFY norm <> ''),
        p AS (SELECT id, conv_id, turn, number, level, string_agg(norm, ' ' ORDER BY i) AS hash, true AS whole
              FROM r GROUP BY id, conv_id, turn, number, level UNION ALL SELECT id, conv_id, turn, number, level, norm, false FROM r),
        own AS (SELECT conv_id, hash, min(turn) AS source FROM p WHERE level = 0 GROUP BY conv_id, hash),
        q AS (SELECT DISTINCT conv_id, turn, number, level, hash, whole FROM p WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
        b AS (SELECT q.conv_id, q.turn, number, level, max(CASE WHEN source < q.turn THEN struct_pack(w := whole, s := source) END).s AS source
              FROM q LEFT JOIN own USING (conv_id, hash) GROUP BY q.conv_id, q.turn, number, level),
        k AS (SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked,
                     -min(CASE WHEN source IS NOT NULL THEN struct_pack(l := level, b := -source) END).b AS reply_to FROM b GROUP BY conv_id, turn),
        a AS (SELECT conv_id, turn, reply_to AS up, 1 AS depth FROM k WHERE reply_to IS NOT NULL
              UNION ALL SELECT a.conv_id, a.turn, k.reply_to, a.depth + 1 FROM a JOIN k ON k.conv_id = a.conv_id AND k.turn = a.up WHERE k.reply_to IS NOT NULL),
        h AS (SELECT conv_id, turn, max(depth)::BIGINT AS depth, min(up) AS thread FROM a GROUP BY conv_id, turn)
        SELECT m.conv_id, m.turn, m.role, reply_to, coalesce(thread, m.turn) AS thread, coalesce(depth, 0) AS depth,
               coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, '<|' || m.role || '|>' || chr(10) || clean || chr(10) AS formatted
        FROM m JOIN c USING (id) LEFT JOIN k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN h ON h.conv_id = m.conv_id AND h.turn = m.turn"""),
}
