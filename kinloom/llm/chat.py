"""Chat formatting by quotation linking.

Replies quote what they answer: a line that starts with one or more `>` belongs to a quote of that level. Neighbouring lines of one level, up
to a line without words, are a passage. Each quoted passage is normalised (case, spaces, marks), hashed as a whole and joined to the messages
of the same conversation that wrote these lines one after the other without quoting them; its origin is the latest of them before the
reply. A message's parent is the origin of its least deep linked passages, so links form trees; each message gets its root and its depth in
its tree, and in order of (conversation, root, turn) every reply follows what it answers. Linked passages leave the message's text; what
links to nothing stays, whatever it starts with.

All of it is DataFrame operations. Conversations in which nobody quotes are not taken apart. Nothing gathers a conversation: origins are found
by windows over the turns of one passage, in blocks of turns, and roots by pointer doubling over the linked messages, whose number of
rounds is logarithmic in the depth. Quotes that break lines elsewhere than the original do not link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Quote marks at the start of a line, with the spaces between them. One class, as repeated groups are matched by recursion, which long lines would exhaust.
MARKS = r"^[\x20\x09>]*>[\x20\x09]?"
#: A text with a quoted line.
QUOTE = r"(?:^|[\r\n])[\x20\x09]*>"
#: Turns of a conversation that are ordered together.
BLOCK = 4_096
#: Lines that mailers put above a quote.
ATTRIBUTION = r"^(?i:on\b.{0,200}\bwrote|.{0,120}\b(?:wrote|schrieb|escribió|a écrit)) ?:\s*$"


def level(line: Column) -> Column:
    """How deep a line is quoted: 0 without marks."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(line: Column) -> Column:
    """Lower case, words joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)), " ")


def hashed(lines: Column) -> Column:
    """A hash of lines that follow each other."""
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)


def split_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def with_segments(messages: DataFrame) -> DataFrame:
    """Messages (text) with `levels` and `norms` of their lines and `segments`: (start, n, level) of neighbouring lines of one level that have words."""
    lines = split_lines(F.col("text"))
    out = messages.withColumn("lines", lines).withColumn("levels", F.transform("lines", level)).withColumn("norms", F.transform("lines", lambda x: normalised(F.regexp_replace(x, MARKS, ""))))
    n, level_at, blank = F.size("lines"), lambda i: F.get("levels", i), lambda i: F.get("norms", i) == ""
    ends = lambda i: (i == 0) | (i == n) | (level_at(i) != level_at(i - 1)) | (blank(i) != blank(i - 1))
    out = out.withColumn("edges", F.filter(F.sequence(F.lit(0), n), ends))
    pairs = F.zip_with("edges", F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 1, F.lit(0))), lambda s, e: F.struct(s.alias("start"), (e - s).alias("n"), level_at(s).alias("level")))
    return out.withColumn("segments", F.filter(pairs, lambda p: p["n"].isNotNull() & ~blank(p["start"]))).drop("edges")


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, part, start, level, n, first, key) of quoted passages: the hash of the first line and that of all lines."""
    quoted = messages.select("conv", "turn", "part", "norms", F.explode(F.filter("segments", lambda s: s["level"] > 0)).alias("s"))
    lines = F.slice("norms", F.col("s.start") + 1, F.col("s.n"))
    return quoted.select("conv", "turn", "part", "s.start", "s.level", "s.n", hashed(F.slice(lines, 1, 1)).alias("first"), hashed(lines).alias("key"))


def written(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv, turn, key): passages that someone quotes, at the messages that wrote them.

    Own lines meet the lengths of the passages that start with such a line, each length once, so a line that is quoted
    a thousand times is looked at once for each message that wrote it.
    """
    asked = quoted.select("conv", "first", "n").distinct()
    own = messages.select("conv", "turn", "part", F.explode(F.filter("segments", lambda s: s["level"] == 0)).alias("s"), "norms")
    lines = F.slice("norms", F.col("s.start") + 1, F.col("s.n"))
    at = own.select("conv", "turn", "part", F.col("s.start").alias("start"), F.posexplode(F.transform(lines, lambda x: hashed(F.array(x)))).alias("k", "first"))
    met = at.join(asked, ["conv", "first"]).select("conv", "turn", "part", "start", "k", "n")
    whole = own.select("conv", "turn", "part", F.col("s.start").alias("start"), lines.alias("own"))
    span = met.join(whole, ["conv", "turn", "part", "start"]).filter(F.col("k") + F.col("n") <= F.size("own"))
    return span.select("conv", "turn", hashed(F.slice("own", F.col("k") + 1, F.col("n"))).alias("key")).distinct()


def origins(quoted: DataFrame, wrote: DataFrame) -> DataFrame:
    """quoted with `origin`, the latest earlier turn that wrote the passage; those without one go.

    The turns of a passage are dealt into blocks; a block's earlier turns are ranked inside it, and what came before it is one row
    a block, so a passage that a conversation repeats without end is not ordered in one task.
    """
    block = F.floor(F.col("turn") / BLOCK)
    asked = quoted.select("conv", "key", "turn").distinct()
    both = asked.withColumn("origin", F.lit(None).cast("long")).unionByName(wrote.select("conv", "key", "turn", F.col("turn").alias("origin"))).withColumn("block", block)
    inside = Window.partitionBy("conv", "key", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = both.groupBy("conv", "key", "block").agg(F.max("origin").alias("last")).withColumn("earlier", F.max("last").over(before)).drop("last")
    near = both.withColumn("near", F.max("origin").over(inside)).filter("origin IS NULL")
    found = near.join(earlier, ["conv", "key", "block"]).select("conv", "key", "turn", F.coalesce("near", "earlier").alias("origin")).filter("origin IS NOT NULL")
    return quoted.join(found, ["conv", "key", "turn"])


def parents(linked_: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked): of a message's linked passages those of the least level decide, by the origin of most lines, the latest of equals."""
    votes = linked_.groupBy("conv", "turn", "level", "origin").agg(F.sum("n").alias("n"), F.count("*").alias("passages"))
    best = votes.groupBy("conv", "turn").agg(F.min(F.struct("level", -F.col("n"), -F.col("origin"), "origin")).alias("b"), F.sum("passages").alias("n_linked"))
    return best.select("conv", "turn", F.col("b.origin").alias("parent"), "n_linked")


def plain_text(segments: Column, lines: Column, levels: Column, norms: Column, starts: Column) -> Column:
    """The lines without the quoted passages that start at `starts`, quoted lines without words, and the attribution right above a removed passage
    (one blank line may stand between); then without blank lines at either end."""
    removed = F.filter(segments, lambda s: F.array_contains(starts, s["start"]))
    above = F.transform(removed, lambda s: F.when(F.get(norms, s["start"] - 1) != "", s["start"] - 1).otherwise(s["start"] - 2))
    above = F.filter(above, lambda i: (i >= 0) & (F.get(levels, i) == 0) & F.coalesce(F.get(lines, i).rlike(ATTRIBUTION), F.lit(False)))
    gone = F.concat(F.flatten(F.transform(removed, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))), above)
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    blank_quotes = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (F.get(levels, i) > 0) & (F.get(norms, i) == ""))
    out = F.map_from_arrays(F.array_distinct(F.concat(gone, blank_quotes)), F.transform(F.array_distinct(F.concat(gone, blank_quotes)), lambda i: F.lit(True)))
    kept = F.filter(numbered, lambda p: ~F.map_contains_key(out, p["i"]))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda p: p["x"]), "\n"), r"^\s+|\s+$", "")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, turn, parent, n_linked, root, depth) by pointer doubling: each round adds to a message's path that of the message it ends at."""
    now, k = scratch.write(links.withColumn("root", F.col("parent")).withColumn("depth", F.lit(1).cast("long")), "paths-0"), 0
    while True:
        ahead = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        step = now.join(ahead, (now["conv"] == ahead["c"]) & (now["root"] == ahead["t"]), "left")
        if step.filter("r IS NOT NULL").isEmpty():
            return now
        k += 1
        step = step.select("conv", "turn", "parent", "n_linked", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"))
        now = scratch.write(step, f"paths-{k}")


def formatted(role: Column, body: Column) -> Column:
    """A message as a chat template has it."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(body, F.lit("")), F.lit("<|im_end|>\n"))


def linked(messages: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(row, body, parent_turn, root_turn, depth, n_linked, formatted) for each row of messages; row is the whole row as a struct.

    A message that quotes nothing, or nothing that an earlier turn wrote, is the root of its tree: parent null, depth 0, and its text stays as
    it is. Quotes of messages of other conversations, of later turns and of the message itself do not link. n_linked counts passages. A
    null text has a null body and no links; an empty one an empty body. Messages without a conversation or turn are roots of their
    own. Rows that share conversation and turn are one message: they share parent and root, each keeps its row, and rows that are alike
    count once. Very long texts are taken apart within their row. An empty table gives no rows.
    """
    part = F.xxhash64("text")
    base = messages.select(F.struct("*").alias("row"), F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    known = base.filter(F.col("conv").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull()).select("conv", "turn", "text", part.alias("part"))
    # written, so that its size is known before the texts are dealt: where few quote, most texts stay where they are
    quoting = scratch.write(known.filter(F.col("text").rlike(QUOTE)).select("conv").distinct(), "quoting")
    some = scratch.write(with_segments(known.join(quoting, "conv", "left_semi").distinct()).drop("lines", "levels", "text"), "segments")
    quoted = passages(some)
    found = scratch.write(origins(quoted, written(some, quoted)), "passages")
    tree = roots(scratch.write(parents(found), "links"), scratch)
    starts = found.groupBy("conv", "turn", "part").agg(F.collect_set("start").alias("starts"))
    out = base.withColumn("part", part).join(tree, ["conv", "turn"], "left").join(starts, ["conv", "turn", "part"], "left")
    cut = F.col("starts").isNotNull()
    taken = with_segments(out.withColumn("kept", F.col("text")).withColumn("text", F.when(cut, F.col("text"))))
    body = F.when(cut, plain_text(F.col("segments"), F.col("lines"), F.col("levels"), F.col("norms"), F.col("starts"))).otherwise(F.col("kept"))
    out = taken.withColumn("body", body)
    return out.select(
        "row", "body", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        formatted(F.col("role"), F.col("body")).alias("formatted"),
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by (conv_id, root_turn, turn), the rows of a conversation are its dialogue in reply order."""
    out = linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Scratch(spark, "chat"))
    return out.select("row.conv_id", "row.turn", "row.role", "body", "parent_turn", "root_turn", "depth", "n_linked", "formatted")


OP8_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id AS conv, turn, role, text, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM conversations
), k AS (
  SELECT conv, turn, text, spot, length(regexp_replace(regexp_extract(line, '^(?:[\x20\x09]*>)+[\x20\x09]?'), '[^>]', '', 'g')) AS level, array_to_string(regexp_extract_all(lower(regexp_replace(line, '^(?:[\x20\x09]*>)+[\x20\x09]?', '')), '[^\x20\x09-\x0D]+'), ' ') AS norm, line
  FROM (SELECT DISTINCT conv, turn, text, unnest(lines) AS line, unnest(range(len(lines))) AS spot FROM m WHERE text IS NOT NULL)
), e AS (
  SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level OR (lag(norm) OVER w = '') IS DISTINCT FROM (norm = '') THEN 1 ELSE 0 END AS edge FROM k WINDOW w AS (PARTITION BY conv, turn, text ORDER BY spot)
), g AS (
  SELECT *, sum(edge) OVER (PARTITION BY conv, turn, text ORDER BY spot) AS seg FROM e
), s AS (
  SELECT conv, turn, text, seg, any_value(level) AS level, string_agg(norm, chr(10) ORDER BY spot) AS passage, count(*) AS n, min(spot) AS start FROM g WHERE norm <> '' GROUP BY conv, turn, text, seg
), o AS (
  SELECT q.conv, q.turn, q.text, q.seg, q.level, q.n, q.start, max(w.turn) AS origin FROM s q JOIN s w ON w.conv = q.conv AND w.turn < q.turn AND w.level = 0 AND contains(chr(10) || w.passage || chr(10), chr(10) || q.passage || chr(10))
  WHERE q.level > 0 GROUP BY ALL
), v AS (
  SELECT conv, turn, level, origin, sum(n) AS n, count(*) AS passages FROM o GROUP BY ALL
), p AS (
  SELECT conv, turn, origin AS parent, linked FROM (
    SELECT *, row_number() OVER (PARTITION BY conv, turn ORDER BY level, n DESC, origin DESC) AS k, sum(passages) OVER (PARTITION BY conv, turn) AS linked FROM v
  ) WHERE k = 1
), r AS (
  SELECT conv, turn, parent AS root, 1 AS depth FROM p UNION ALL SELECT r.conv, r.turn, p.parent, r.depth + 1 FROM r JOIN p ON p.conv = r.conv AND p.turn = r.root
), t AS (
  SELECT conv, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM r GROUP BY ALL
), x AS (
  SELECT g.conv, g.turn, g.text, g.spot, g.line, o.seg IS NOT NULL OR (g.level > 0 AND g.norm = '') OR EXISTS (
    SELECT 1 FROM o z JOIN k b ON b.conv = z.conv AND b.turn = z.turn AND b.text = z.text AND b.spot = z.start - 1
    WHERE z.conv = g.conv AND z.turn = g.turn AND z.text = g.text AND g.spot = CASE WHEN b.norm <> '' THEN z.start - 1 ELSE z.start - 2 END AND g.level = 0 AND regexp_matches(g.line, '^(?i:on\b.{0,200}\bwrote|.{0,120}\b(?:wrote|schrieb|escribió|a écrit)) ?:\s*$')
  ) AS gone FROM g LEFT JOIN o ON o.conv = g.conv AND o.turn = g.turn AND o.text = g.text AND o.seg = g.seg
  WHERE EXISTS (SELECT 1 FROM o y WHERE y.conv = g.conv AND y.turn = g.turn AND y.text = g.text)
), c AS (
  SELECT conv, turn, text, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT gone), ''), '^\s+|\s+$', '', 'g') AS body FROM x GROUP BY conv, turn, text
), b AS (
  SELECT m.conv, m.turn, m.role, coalesce(c.body, m.text) AS body FROM m LEFT JOIN c ON c.conv = m.conv AND c.turn = m.turn AND c.text = m.text
)
SELECT b.conv AS conv_id, b.turn, b.role, b.body, p.parent AS parent_turn, coalesce(t.root, b.turn) AS root_turn, coalesce(t.depth, 0)::BIGINT AS depth, coalesce(p.linked, 0)::BIGINT AS n_linked,
  '<|im_start|>' || coalesce(b.role, 'unknown') || chr(10) || coalesce(b.body, '') || '<|im_end|>' || chr(10) AS formatted
FROM b LEFT JOIN p ON p.conv = b.conv AND p.turn = b.turn LEFT JOIN t ON t.conv = b.conv AND t.turn = b.turn
"""
