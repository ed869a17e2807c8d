r"""Chat formatting by quotation linking, with DataFrame operations only.

A line that begins with ``>`` marks quotes; its level is the number of marks.  A quoted passage
is a run of lines of one level.  Its normalised text (lower case, white space as one space) is
hashed and joined with the hashes of what messages say themselves: the whole message, its
paragraphs and its lines, each without quotes.  A passage that equals none of these is compared
line by line: its lines are joined with those that messages say by (conversation, hash), and a
message says it if all lines follow each other there (empty lines do not count).  A passage's
original is the first message of the conversation that says it, if that stands before the
quoting message.  A message replies to the
latest original of its shallowest linked level; following replies leads to the message that
began the thread.

Conversations come out in reply order: threads by their first turn, messages of a thread by
turn, so that an original always precedes its replies; without quotes this is the order of
turns.  Positions are made from the row counts of range partitions, so a conversation that
holds a third of all messages is not sorted in one task; originals are a minimum per passage,
aggregated before the shuffle, so a passage that everybody quotes makes no pairs.

Defined results: a NULL text stays NULL and quotes nothing; a message whose conversation or turn
is NULL is linked to nothing and is its own thread; rows with equal conversation and turn are
ordered by role and text, and of two that say a passage the first by role and the text's digest
is its original; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecprune.staging import stage_table

MARKS = r"^[ \t]*(?:>[ \t]*)+"
SPACE = r"[ \t\r\n\f\x0B]+"
ORDER = ["conv_id", "thread_turn", "turn", "role", "text"]


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def with_lines(messages: DataFrame) -> DataFrame:
    """Adds ``marked`` (array of level and body per line) and ``said`` (the text without quotes)."""
    marked = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARKS, "").alias("body"),
        ),
    )
    own = F.array_join(F.transform(F.filter("marked", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    quoting = F.exists("marked", lambda x: x["level"] > 0)
    return (
        messages.withColumn("marked", marked)
        # Of messages with one turn the first by role and text counts as the earlier one.
        .withColumn("place", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.md5("text").alias("digest"), "uid"))
        .withColumn("quoting", F.coalesce(quoting, F.lit(False)))
        .withColumn("said", F.when(F.col("quoting"), F.regexp_replace(own, r"^\n+|\n+$", "")).otherwise(F.col("text")))
    )


def passages(lined: DataFrame) -> DataFrame:
    """The quoted passages of each message: ``uid, run, conv_id, turn, level, print``.

    ``lines`` has the hashes of the passage's lines, without those that are empty.
    """
    in_text = Window.partitionBy("uid").orderBy("pos")
    lines = lined.filter("quoting").select("uid", "conv_id", "turn", F.posexplode("marked").alias("pos", "line"))
    level = F.col("line.level")
    new = F.when(level == F.lag(level).over(in_text), 0).otherwise(1)
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(in_text)).filter(level > 0)
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col("line.body").alias("body"))))
    bodies = F.transform(F.col("ordered"), lambda x: x["body"])
    whole = runs.groupBy("uid", "conv_id", "turn", level.alias("level"), "run").agg(ordered.alias("ordered"))
    whole = whole.withColumn("passage", normalised(F.array_join(bodies, " "))).filter("passage <> ''")
    return whole.select(
        "uid", "run", "conv_id", "turn", "level", F.xxhash64("passage").alias("print"), line_prints(bodies).alias("lines")
    )


def line_prints(lines: Column) -> Column:
    """Hashes of the lines that are not empty, in order."""
    said = F.filter(F.transform(lines, normalised), lambda x: x != "")
    return F.transform(said, lambda x: F.xxhash64(x))


def originals(lined: DataFrame, quoted: DataFrame) -> DataFrame:
    """The first message of a conversation that says something: ``conv_id, print, origin``."""
    here = lined.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    units = F.concat(F.array("said"), F.split("said", r"\n[ \t]*\n"), F.split("said", "\n"))
    said = here.select("place", "conv_id", "turn", F.explode(units).alias("unit")).withColumn("unit", normalised(F.col("unit")))
    return (
        said.filter("unit <> '' AND turn IS NOT NULL")
        .groupBy("conv_id", F.xxhash64("unit").alias("print"))
        .agg(F.min("place").alias("origin"))
    )


def line_originals(lined: DataFrame, rest: DataFrame) -> DataFrame:
    """The first message that says the lines of a passage one after another: ``conv_id, lines, origin``.

    Equal passages of a conversation are one, and each is looked for by the rarest two lines of it
    that follow each other; the other lines are compared where these stand.
    """
    wanted = stage_table(rest.select("conv_id", "lines").distinct(), "wanted-lines")
    here = lined.filter("turn IS NOT NULL").join(wanted.select("conv_id").distinct(), "conv_id", "left_semi")
    said = here.select("conv_id", "place", "uid", line_prints(F.split("said", "\n")).alias("own"))
    said = stage_table(said.filter(F.size("own") > 1), "said-lines")
    # Every two lines that follow each other are a key; a passage is looked for by its rarest.
    keys = lambda column: F.expr(f"transform(sequence(1, size({column}) - 1), i -> xxhash64({column}[i - 1], {column}[i]))")
    places = said.select("conv_id", "uid", F.posexplode(keys("own")).alias("at", "key"))
    asked = wanted.filter(F.size("lines") > 1).select("conv_id", "lines", F.posexplode(keys("lines")).alias("nth", "key"))
    counts = places.groupBy("conv_id", "key").agg(F.count("*").alias("n"))
    asked = asked.join(counts, ["conv_id", "key"], "left")
    best = asked.groupBy("conv_id", "lines").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "nth", "key")).alias("rarest")
    )
    best = best.filter("rarest.n > 0").select("conv_id", "lines", F.col("rarest.nth").alias("nth"), F.col("rarest.key").alias("key"))
    met = best.join(places, ["conv_id", "key"]).select("conv_id", "lines", "uid", (F.col("at") - F.col("nth")).alias("start"))
    met = met.filter("start >= 0").join(said.select("uid", "place", "own"), "uid")
    met = met.filter(F.expr("slice(own, start + 1, size(lines)) = lines"))
    return met.groupBy("conv_id", "lines").agg(F.min("place").alias("of_lines"))


def replies(lined: DataFrame) -> DataFrame:
    """Messages that quote: ``uid, n_quotes, n_linked``, and the linked one's ``up, up_turn``."""
    quoted = stage_table(passages(lined), "passages")
    linked = stage_table(quoted.join(originals(lined, quoted), ["conv_id", "print"], "left"), "linked")
    # The first of all messages that say it, be it as a unit or line by line.
    several = linked.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND size(lines) > 1")
    linked = linked.join(line_originals(lined, several), ["conv_id", "lines"], "left")
    linked = linked.withColumn("origin", F.least("origin", "of_lines"))
    good = F.col("origin.turn") < F.col("turn")
    best = F.max(F.when(good, F.struct((-F.col("level")).alias("near"), "origin.*")))
    return linked.groupBy("uid").agg(
        F.count("*").alias("n_quotes"), F.count(F.when(good, 1)).alias("n_linked"), best.alias("best")
    ).select("uid", "n_quotes", "n_linked", F.col("best.uid").alias("up"), F.col("best.turn").alias("up_turn"))


def threads(answers: DataFrame) -> DataFrame:
    """``uid, root_turn`` of the messages that reply, by doubling the steps towards the root."""
    steps = stage_table(answers.filter("up IS NOT NULL").select("uid", "up", "up_turn"), "steps")
    while True:
        above = steps.select(F.col("uid").alias("up"), F.col("up").alias("next"), F.col("up_turn").alias("next_turn"))
        longer = steps.join(above, "up", "left")
        if longer.filter("next IS NOT NULL").isEmpty():
            return steps.select("uid", F.col("up_turn").alias("root_turn"))
        steps = stage_table(
            longer.select("uid", F.coalesce("next", "up").alias("up"), F.coalesce("next_turn", "up_turn").alias("up_turn")),
            "steps",
        )


def in_order(messages: DataFrame, order: list[str], group: str) -> DataFrame:
    """Adds ``position``, counted from 0 within each group, from the counts of range partitions."""
    placed = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage_table(
        placed.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "placed"
    )
    counts = placed.groupBy(F.col(group).alias("of"), "part").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("of", F.col("part").alias("of_part"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    same = placed[group].eqNullSafe(starts["of"]) & (placed["part"] == starts["of_part"])
    return placed.join(starts, same).withColumn("position", F.col("nth") - F.col("first") + F.col("before"))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """One row per message, in reply order by ``(conv_id, position)``.

    ``said`` is the text without quotes, ``formatted`` the same as a chat turn.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    lined = with_lines(stage_table(rows.withColumn("uid", F.monotonically_increasing_id()), "messages"))
    answers = stage_table(replies(lined), "replies")
    found = answers.join(threads(answers), "uid", "left").withColumnRenamed("uid", "of_uid")
    whole = lined.drop("marked", "quoting", "place").join(found, F.col("uid") == F.col("of_uid"), "left")
    whole = whole.withColumn("thread_turn", F.coalesce("root_turn", "turn"))
    zero = F.lit(0).cast("long")
    return in_order(whole, ORDER, "conv_id").select(
        "conv_id", "position", "turn", "role",
        F.col("up_turn").alias("parent_turn"),
        "thread_turn",
        F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        "said",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("said", F.lit(""))).alias("formatted"),
    )


def op10_quotes(spark, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_NORM = "lower(trim(regexp_replace({}, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')))"
OP10_SQL = rf"""
WITH RECURSIVE msgs AS (SELECT conv_id, turn, role, text, row_number() OVER () AS uid FROM conversations),
raw_lines AS (SELECT uid, conv_id, turn, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM msgs),
lines AS (SELECT uid, conv_id, turn, pos, regexp_replace(line, '{MARKS}', '') AS body,
  length(regexp_replace(regexp_extract(line, '{MARKS}'), '[^>]', '', 'g')) AS level FROM raw_lines),
own AS (SELECT uid, max(level) > 0 AS quoting, string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0) AS own
  FROM lines GROUP BY uid),
spoken AS (SELECT m.*, CASE WHEN quoting THEN regexp_replace(coalesce(own, ''), '^\n+|\n+$', '', 'g') ELSE text END AS said
  FROM msgs m LEFT JOIN own USING (uid)),
starts AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY uid ORDER BY pos) THEN 0 ELSE 1 END AS new FROM lines),
runs AS (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY pos) AS run FROM starts),
quoted AS (SELECT uid, run, conv_id, turn, level, {_NORM.format("string_agg(body, ' ' ORDER BY pos)")} AS passage,
  list({_NORM.format("body")} ORDER BY pos) AS bodies
  FROM runs WHERE level > 0 GROUP BY uid, conv_id, turn, level, run HAVING passage <> ''),
places AS (SELECT *, (turn, coalesce(role, ''), md5(text), uid) AS place FROM spoken
  WHERE turn IS NOT NULL AND conv_id IN (SELECT conv_id FROM quoted)),
units AS (SELECT DISTINCT conv_id, place, {_NORM.format("unit")} AS unit FROM (
  SELECT conv_id, place, unnest(list_concat(list_concat([said], string_split_regex(said, '\n[ \t]*\n')), string_split(said, chr(10)))) AS unit
  FROM places)),
origins AS (SELECT conv_id, unit, min(place) AS origin FROM units WHERE unit <> '' GROUP BY conv_id, unit),
own_lines AS (SELECT conv_id, place, list_filter(list_transform(string_split(said, chr(10)),
  lambda x: {_NORM.format("x")}), lambda x: x <> '') AS own FROM places),
asked AS (SELECT uid, run, conv_id, list_filter(bodies, lambda x: x <> '') AS ls FROM quoted),
of_lines AS (SELECT uid, run, min(place) AS of_lines FROM (
  SELECT a.uid, a.run, a.ls, o.place, o.own, unnest(range(1, len(own) - len(ls) + 2)) AS s
  FROM asked a JOIN own_lines o USING (conv_id) WHERE len(ls) > 1)
  WHERE own[s:s + len(ls) - 1] = ls GROUP BY uid, run),
linked AS (SELECT q.uid, q.level, CASE WHEN least(o.origin, l.of_lines)[1] < q.turn THEN least(o.origin, l.of_lines) END AS origin
  FROM quoted q LEFT JOIN origins o ON o.conv_id = q.conv_id AND o.unit = q.passage
  LEFT JOIN of_lines l ON l.uid = q.uid AND l.run = q.run),
best AS (SELECT uid, count(*) AS n_quotes, count(origin) AS n_linked,
  max((-level, origin[1], origin[2], origin[3], origin[4])) FILTER (WHERE origin IS NOT NULL) AS up FROM linked GROUP BY uid),
chain AS (SELECT uid, up[5] AS at, up[2] AS at_turn FROM best WHERE up IS NOT NULL
  UNION ALL SELECT c.uid, b.up[5], b.up[2] FROM chain c JOIN best b ON b.uid = c.at WHERE b.up IS NOT NULL),
roots AS (SELECT uid, min(at_turn) AS root_turn FROM chain GROUP BY uid),
whole AS (SELECT s.*, coalesce(root_turn, turn) AS thread_turn, b.up[2] AS parent_turn, n_quotes, n_linked
  FROM spoken s LEFT JOIN best b USING (uid) LEFT JOIN roots r USING (uid))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position,
  turn, role, parent_turn, thread_turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, said,
  '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(said, '') AS formatted
FROM whole"""
