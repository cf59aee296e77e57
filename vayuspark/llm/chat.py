"""Multi-party perspective rotation of conversations, DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and everybody else
as a named user; system turns stay system turns and take no perspective. The training mask covers exactly the words
the perspective's speaker says, with the end mark, and not its header.

One row is one turn as one participant sees it: the rendered segment, its place (first and last+1 character) in the whole
rendering, the mask span inside the rendering (null where nothing is learnt). Concatenating the segments of a conversation
and perspective by `at` gives the whole rendering; `documents_of` does so in runs of `RUN` turns, so that a very long
conversation is never one value. Places come from one global sort and sums for each of its partitions, so no
conversation, however long, is brought into one task.

Names are made of letters, digits, `_` and `-`: any other character becomes `_x` with its code point and `_`, and a `_` before an
`x` becomes `_x5f_`, so that different roles never have one name. The marks of a turn's start and end inside a text get a
backslash after their `<` (one more, if they have some), so that they are no marks and can be read back.

Defined results: a null text is an empty turn; a null or blank role is the speaker `_x_`, which no other role becomes; white
space around a role does not count; turns with a null conv_id belong to one conversation, null; a null turn comes first;
repeated (conv_id, turn) rows are ordered by speaker and text and stay; a conversation of system turns alone has no
participant and gives no rows; an empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vayuspark.llm.tables import table, written

RUN = 64
SYSTEM, NOBODY = "system", "_x_"
START, END = "<|im_start|>", "<|im_end|>\n"


def speaker_name(role: Column) -> Column:
    """A name that tells different roles apart."""
    plain = F.replace(F.trim(role), F.lit("_x"), F.lit("_x5f_x"))
    other = lambda c: F.concat(F.lit("_x"), F.lower(F.hex(F.ascii(c))), F.lit("_"))
    letters = F.transform(F.sequence(F.lit(1), F.length(plain)), lambda i: F.substring(plain, i, F.lit(1)))
    spelled = F.array_join(F.transform(letters, lambda c: F.when(c.rlike(r"^[A-Za-z0-9_\-]$"), c).otherwise(other(c))), "")
    return F.when(F.coalesce(F.trim(role), F.lit("")) == "", F.lit(NOBODY)).when(plain.rlike(r"^[A-Za-z0-9_\-]*$"), plain).otherwise(spelled)


def turns_of(conversations: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"<(\\*)\|im_(start|end)\|>", r"<$1\\|im_$2|>")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker_name(F.col("role")).alias("speaker"), text.alias("text"))


def participants(turns: DataFrame) -> DataFrame:
    """Speakers of each conversation; the distinct speakers of a task go into the shuffle, not its turns."""
    return turns.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()


def rotate(conversations: DataFrame) -> DataFrame:
    """A row for each turn and participant: conv_id, perspective, turn, at, speaker, seen_as, segment, start, stop, mask_start, mask_stop."""
    turns = turns_of(conversations)
    views = participants(turns).withColumnRenamed("conv_id", "own_id")
    seen = turns.join(views, F.col("conv_id").eqNullSafe(F.col("own_id"))).drop("own_id")
    seen_as = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise(F.concat(F.lit("user name="), "speaker"))
    seen = seen.withColumn("seen_as", seen_as).withColumn("head", F.concat(F.lit(START), "seen_as", F.lit("\n")))
    seen = seen.withColumn("size", (F.length("head") + F.length("text") + len(END)).cast("long"))
    # The last sort column is only there to split rows that are equal in all others.
    line = seen.withColumn("_own", F.monotonically_increasing_id()).orderBy("conv_id", "perspective", "turn", "speaker", "text", "_own").drop("_own")
    line = written(line.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33).cast("int")), "turns")
    by = ["conv_id", "perspective"]
    sums = line.groupBy(*by, "_part").agg(F.sum("size").alias("size_in"), F.count(F.lit(1)).alias("rows_in"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col("conv_id").alias("own_id"), F.col("perspective").alias("own_view"), F.col("_part").alias("own_part"),
        F.coalesce(F.sum("size_in").over(earlier), F.lit(0)).alias("size_before"), F.coalesce(F.sum("rows_in").over(earlier), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy(*by, "_part").orderBy("_row")
    line = line.withColumn("size_to", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rows_to", F.row_number().over(inside))
    placed = line.join(before, F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("perspective") == F.col("own_view")) & (F.col("_part") == F.col("own_part")))
    stop = F.col("size_before") + F.col("size_to")
    start = stop - F.col("size")
    own = F.col("seen_as") == "assistant"
    return placed.select(
        *by, "turn", (F.col("rows_before") + F.col("rows_to") - 1).cast("long").alias("at"), "speaker", "seen_as",
        F.concat("head", "text", F.lit(END)).alias("segment"), start.cast("long").alias("start"), stop.cast("long").alias("stop"),
        F.when(own, start + F.length("head")).cast("long").alias("mask_start"), F.when(own, stop - 1).cast("long").alias("mask_stop"),
    )


def documents_of(rotated: DataFrame, run: int = RUN) -> DataFrame:
    """Renderings in runs of `run` turns: text and the mask spans inside that text."""
    rows = F.sort_array(F.collect_list(F.struct("at", "segment", "start", "mask_start", "mask_stop")))
    parts = rotated.groupBy("conv_id", "perspective", F.floor(F.col("at") / run).alias("part")).agg(rows.alias("rows"))
    base = F.col("rows")[0]["start"]
    learnt = F.filter("rows", lambda x: x["mask_start"].isNotNull())
    spans = F.transform(learnt, lambda x: F.struct((x["mask_start"] - base).alias("start"), (x["mask_stop"] - base).alias("stop")))
    return parts.select("conv_id", "perspective", "part", F.concat_ws("", F.col("rows")["segment"]).alias("text"), spans.alias("mask"))


def op9_perspectives(spark, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
with t as (select conv_id, cast(turn as bigint) turn, regexp_replace(coalesce(text, ''), '<(\\*)\|im_(start|end)\|>', '<\1\\|im_\2|>', 'g') as body,
    case when trim(coalesce(role, '')) = '' then '_x_' else list_aggregate(list_transform(string_split(replace(trim(role), '_x', '_x5f_x'), ''),
        lambda c: case when regexp_full_match(c, '[A-Za-z0-9_\-]?') then c else concat('_x', printf('%x', unicode(c)), '_') end), 'string_agg', '') end speaker from conversations),
p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
s as (select t.*, p.perspective, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else concat('user name=', speaker) end seen_as
      from t join p on t.conv_id is not distinct from p.conv_id),
r as (select *, concat('<|im_start|>', seen_as, chr(10)) head, row_number() over w - 1 at_, sum(length(seen_as) + 13 + length(body) + 11) over w stop_
      from s window w as (partition by conv_id, perspective order by turn nulls first, speaker, body rows between unbounded preceding and current row))
select conv_id, perspective, turn, cast(at_ as bigint) "at", speaker, seen_as, concat(head, body, '<|im_end|>', chr(10)) segment,
    cast(stop_ - length(head) - length(body) - 11 as bigint) "start", cast(stop_ as bigint) "stop",
    case when seen_as = 'assistant' then cast(stop_ - length(body) - 11 as bigint) end mask_start, case when seen_as = 'assistant' then cast(stop_ - 1 as bigint) end mask_stop
from r
"""
