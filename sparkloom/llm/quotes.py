"""Quotation linking of messages, by DataFrame expressions alone.

A line's quote level is the number of ">" signs it begins with. Lines of one level that follow each other, without blank
ones, are a passage; passages of level 0 are the message's own, the rest is quoted. An attribution (a line of level 0 that
ends with ":" and has "wrote" or "said", right before a quoted line) is neither. Passages are normalised (lower case, white space as
one space) and hashed; the original of a quoted passage is the first message of its conversation with that passage among its
own, if that message is earlier. A message replies to the latest original of its passages of the least quoted level.

Messages of a conversation are ordered as a tree: thread_key is the path of turns from the conversation's root message to
this one, so that sorting by it puts each reply after its parent (negative turns first); its length is a message's depth
times a key's. Paths are made by doubling, as many joins as the logarithm of the deepest chain; a path that has reached its
root leaves the joins, so a first message that very many answer is no hot key there, and in the join that finds out who has
reached it, keys are salted. No conversation is gathered: originals are aggregated by (conversation, hash).

Defined results: a null text is empty; a message without own lines has an empty body; a null turn or conversation never is
an original; rows that repeat a (conversation, turn) each get a row, with the parent that any of them has (the latest); an
empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIGITS, SALT = 19, 16


def key_of(turn: Column) -> Column:
    """A turn as a text that sorts like it."""
    negative = (turn.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
    return F.when(turn < 0, F.concat(F.lit("-"), F.lpad(negative, DIGITS, "0"))).otherwise(F.lpad(turn.cast("string"), DIGITS, "0"))


def passages(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """m (a key of the row's content), conv, turn, body and passages (level, hash) of each row; arrays are of one text."""
    df = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col("role"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    mark = F.regexp_extract  # the run of signs at a line's start
    df = df.withColumn("__l", F.transform(F.split("__t", "\n"), lambda x: F.struct(F.length(F.regexp_replace(mark(x, r"^[ \t]*((?:>[ \t]?)*)", 1), "[^>]", "")).alias("level"), F.regexp_replace(x, r"^[ \t]*(?:>[ \t]?)+", "").alias("line"))))
    following = lambda i: F.coalesce(F.get(F.col("__l"), i + 1)["level"], F.lit(0)) > 0
    df = df.withColumn("__l", F.transform("__l", lambda x, i: F.struct(F.when((x["level"] == 0) & following(i) & x["line"].rlike(r"(?i)\b(wrote|said)\b.*:[ \t\r]*$"), F.lit(-1)).otherwise(x["level"]).alias("level"), x["line"].alias("line"))))
    body = F.array_join(F.transform(F.filter("__l", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    df = df.withColumn("body", F.regexp_replace(F.regexp_replace(body, r"\n[ \t\r]*(?:\n[ \t\r]*)+", "\n\n"), r"^\s+|\s+$", ""))
    # A passage starts where the level changes or after a blank line: lines are joined with borders between passages, then split.
    blank = lambda x: F.trim(F.regexp_replace(x["line"], r"\s+", " ")) == ""
    marked = F.transform("__l", lambda x, i: F.when(blank(x) | (x["level"] < 0), F.lit("\x01")).otherwise(F.concat(F.when(F.coalesce(F.get(F.col("__l"), i - 1)["level"], F.lit(-9)) != x["level"], F.lit("\x01")).otherwise(F.lit("")), x["level"].cast("string"), F.lit("\x02"), F.regexp_replace(x["line"], "[\x01\x02]", " "))))
    joined = F.filter(F.split(F.array_join(marked, "\n"), "\x01"), lambda p: p.contains("\x02"))
    plain = lambda p: F.trim(F.regexp_replace(F.lower(F.regexp_replace(p, r"(^|\n)[0-9]+\x02", " ")), r"\s+", " "))
    return df.select("conv_id", "turn", "role", "body", F.transform(joined, lambda p: F.struct(F.substring_index(p, "\x02", 1).cast("int").alias("level"), F.md5(plain(p)).alias("hash"))).alias("passages"))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv_id, turn, role, body, n_quoted (passages), n_linked, parent_turn, root_turn, depth and thread_key of each row."""
    df = written(passages(messages, conv, turn, text), "quotes")
    each = df.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.hash")
    first = each.filter("level = 0 AND turn IS NOT NULL").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = each.filter("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.count("*").alias("n"))
    linked = quoted.join(first, ["conv_id", "hash"]).filter("origin < turn")
    parents = linked.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "origin")).alias("best"), F.count_distinct("hash").alias("n_linked")).select("conv_id", "turn", F.col("best.origin").alias("parent_turn"), "n_linked")
    parents = written(parents, "quotes-parents")
    paths = _paths(parents.select("conv_id", "turn", "parent_turn"))
    known = parents.join(paths, ["conv_id", "turn"], "left")
    out = df.join(known, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "body", F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("bigint").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "parent_turn",
        F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce(F.concat_ws("/", "path", key_of(F.col("turn"))), key_of(F.col("turn"))).alias("thread_key"),
    )


def _paths(edges: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth, path (the ancestors' keys, root first) of every message with a parent."""
    salt = F.pmod(F.xxhash64("turn"), F.lit(SALT)).cast("int")
    replies = edges.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
    at = edges.select("conv_id", "turn", F.col("parent_turn").alias("root"), F.lit(1).cast("bigint").alias("depth"), key_of(F.col("parent_turn")).alias("path"))
    at = at.withColumn("s0", salt).join(replies, (F.col("conv_id") == F.col("c")) & (F.col("root") == F.col("t")) & (F.col("s0") == F.col("s")), "left")
    at = written(at.select("conv_id", "turn", "root", "depth", "path", F.col("t").isNotNull().alias("open")), "quotes-paths")
    while at.filter("open").limit(1).count():  # each round doubles how far an open path reaches
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"), F.col("path").alias("p2"), F.col("open").alias("o2"))
        longer = at.filter("open").join(up, ["conv_id", "root"]).select("conv_id", "turn", F.col("r2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth"), F.concat_ws("/", "p2", "path").alias("path"), F.col("o2").alias("open"))
        at = written(at.filter("NOT open").union(longer), "quotes-paths")
    return at.drop("open")


_KEY = f"CASE WHEN {{t}} < 0 THEN '-' || lpad(CAST(CAST({{t}} AS HUGEINT) + CAST('9223372036854775808' AS HUGEINT) AS VARCHAR), {DIGITS}, '0') ELSE lpad(CAST({{t}} AS VARCHAR), {DIGITS}, '0') END"

ORACLE_SQL = rf"""
WITH RECURSIVE lines0 AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
lines1 AS (SELECT r, conv_id, turn, i, length(regexp_replace(regexp_extract(l[i], '^[ \t]*((?:>[ \t]?)*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(l[i], '^[ \t]*(?:>[ \t]?)+', '') AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lines0)),
lines AS (SELECT r, conv_id, turn, i, line, CASE WHEN level = 0 AND coalesce(lead(level) OVER (PARTITION BY r ORDER BY i), 0) > 0 AND regexp_matches(line, '(?i)\b(wrote|said)\b.*:[ \t\r]*$') THEN -1 ELSE level END AS level FROM lines1),
bodies AS (SELECT r, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), '\n[ \t\r]*(?:\n[ \t\r]*)+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM lines GROUP BY r),
kept AS (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) = '' OR level < 0 AS gap, coalesce(lag(level) OVER (PARTITION BY r ORDER BY i), -9) <> level AS turned FROM lines),
runs AS (SELECT *, sum(CASE WHEN gap OR turned THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM kept),
ps AS (SELECT r, conv_id, turn, level, md5(trim(regexp_replace(lower(string_agg(line, ' ' ORDER BY i)), '\s+', ' ', 'g'))) AS hash FROM runs WHERE NOT gap GROUP BY r, conv_id, turn, g, level),
origins AS (SELECT conv_id, hash, min(turn) AS origin FROM ps WHERE level = 0 AND turn IS NOT NULL GROUP BY conv_id, hash),
linked AS (SELECT DISTINCT p.conv_id, p.turn, p.level, p.hash, o.origin FROM ps p JOIN origins o USING (conv_id, hash) WHERE p.level > 0 AND o.origin < p.turn),
parents AS (SELECT conv_id, turn, arg_max(origin, (-level) * 1000000 + origin) AS parent_turn, count(DISTINCT hash) AS n_linked FROM linked GROUP BY conv_id, turn),
paths AS (SELECT conv_id, turn, parent_turn AS root, 1 AS depth, {_KEY.format(t='parent_turn')} AS path FROM parents
  UNION ALL SELECT p.conv_id, p.turn, q.parent_turn, p.depth + 1, ({_KEY.format(t='q.parent_turn')}) || '/' || p.path FROM paths p JOIN parents q ON p.conv_id = q.conv_id AND p.root = q.turn),
full_paths AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(root, depth) AS root, arg_max(path, depth) AS path FROM paths GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, b.body, CAST((SELECT count(*) FROM ps WHERE ps.r = m.r AND level > 0) AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, parent_turn, coalesce(root, m.turn) AS root_turn,
  CAST(coalesce(f.depth, 0) AS BIGINT) AS depth, concat_ws('/', f.path, {_KEY.format(t='m.turn')}) AS thread_key
FROM lines0 m JOIN bodies b USING (r) LEFT JOIN parents p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN full_paths f ON f.conv_id = m.conv_id AND f.turn = m.turn"""
