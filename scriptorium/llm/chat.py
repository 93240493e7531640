"""Chat formatting by perspective rotation, in DataFrame operations only.

For every participant of a conversation (a role that speaks in it and is no system
role) the dialogue is rendered once with that participant as the assistant and all
others as users with their names. The result has one row per conversation, participant
and turn, with the turn's place in the rendering, so a conversation of any length is
never gathered into one row or task: offsets are running sums over blocks of ``BLOCK``
turns, plus the sums of earlier blocks. Joined in the order of start, the segments are
the rendering; ``whole`` does that where conversations are known to fit a row.

The mask covers what the assistant is to learn: its text and the end mark.

Defined results. A null text is an empty one; a null role takes no perspective and its
turns are shown as those of a user named ``unknown``. Turns are ordered by number, then
role, then text; null numbers come first, and turns that repeat are all shown. Rows
whose conversation id is null form one conversation. A conversation of system turns
only gives no rows, nor does an empty table. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Turns whose places one window finds.
BLOCK = 256
SYSTEM_ROLES = ("system",)
START, END = "<|im_start|>", "<|im_end|>\n"


def _before(value: Column, *keys: str, order: list) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_roles: tuple[str, ...] = SYSTEM_ROLES, block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, perspective, turn, place, role, name, segment, start, end, mask_start, mask_end, learn).

    place numbers the turns of a block; start and end are character offsets of the segment in the
    rendering, mask_start and mask_end of the part to learn (both equal start where nothing is).
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))))
    who = t.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*system_roles)).select("key", F.col("speaker").alias("perspective")).distinct()
    rows = t.join(who, "key")

    system = F.coalesce(F.col("speaker").isin(*system_roles), F.lit(False))
    learn = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(system, "system").when(learn, "assistant").otherwise("user")
    name = F.when(~system & ~learn, F.coalesce("speaker", F.lit("unknown")))
    head = F.concat(F.lit(START), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), F.col("name"))).otherwise(F.lit("")), F.lit("\n"))
    rows = rows.withColumns({"role": role, "name": name, "learn": learn}).withColumn("head", head)
    rows = rows.withColumn("segment", F.concat("head", "text", F.lit(END))).withColumn("size", F.length("segment").cast("long"))

    order = [F.col("turn").asc_nulls_first(), F.col("speaker").asc_nulls_first(), F.col("text")]
    sums = rows.groupBy("key", "perspective", "block").agg(F.sum("size").alias("total"))
    sums = sums.select("key", "perspective", "block", _before(F.col("total"), "key", "perspective", order=["block"]).alias("earlier"))
    w = Window.partitionBy("key", "perspective", "block").orderBy(*order)
    placed = rows.withColumns({"inside": _before(F.col("size"), "key", "perspective", "block", order=order), "place": F.row_number().over(w)})
    placed = placed.join(sums, ["key", "perspective", "block"]).withColumn("start", F.col("earlier") + F.col("inside"))
    end = F.col("start") + F.col("size")
    return placed.select(
        "conv_id", "perspective", "turn", F.col("place").cast("long").alias("place"), "role", "name", "segment", "start", end.alias("end"),
        F.when(F.col("learn"), F.col("start") + F.length("head")).otherwise(F.col("start")).alias("mask_start"),
        F.when(F.col("learn"), end - 1).otherwise(F.col("start")).alias("mask_end"), "learn",
    )


def whole(segments: DataFrame) -> DataFrame:
    """(conv_id, perspective, rendering, masks): for conversations that are known to fit one row each."""
    s = segments.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end", "learn"))).alias("s"))
    masks = F.transform(F.filter("s", lambda x: x["learn"]), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return s.select("conv_id", "perspective", F.array_join("s.segment", "").alias("rendering"), masks.alias("masks"))
