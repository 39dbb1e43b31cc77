"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation several times, each time with more turns. A
conversation is dropped if another one begins with all of its turns, or if it
equals one with a smaller identifier; the maximal ones are rendered.

A turn's hash has its position, role and text; the hash of a prefix is the XOR of
its turns' hashes (twice 64 bits), which rolls on from turn to turn and adds up
over parts. A conversation is a prefix of another if its own hash and length are
among the other's prefixes: an anti-join. A conversation may be any length: its
turns are ordered within stretches of turn numbers, and hashed and rendered within
stretches of positions, with only each stretch's count and hash carried over.

Places are settled once and kept in the shared folder; after that only hashes move
until it is known which conversations stay. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, small_side

START, END = "<|im_start|>", "<|im_end|>"


def turn_hash(salt: int) -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.xxhash64(F.lit(salt), "position", F.isnull("role"), role, F.isnull("text"), text)


#: A conversation's key, never null: whether its identifier is, and the identifier as text. Joins and windows on it share their partitions.
KEY = ["unnamed", "name"]


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"unnamed": F.isnull("conv_id"), "name": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))})


def running(w, *last) -> Window:
    """From a window's first row to the one before, or to the last given."""
    return w.rowsBetween(Window.unboundedPreceding, *(last or (-1,)))


def positions(turns: DataFrame, stretch: int) -> DataFrame:
    """(conv_id, KEY, position, part, role, text): a turn's place in the conversation from 1, by (turn, role, text), nulls first, and the
    stretch of positions that it is in, from 0. Written once."""
    turns = keyed(turns).withColumn("range", F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-(1 << 62))))
    own = [*KEY, "range"]
    ranked = turns.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))))
    counts = turns.groupBy(*own).agg(F.count("*").alias("n"))
    starts = counts.select(*own, F.coalesce(F.sum("n").over(running(Window.partitionBy(*KEY).orderBy("range"))), F.lit(0)).alias("start"))
    placed = ranked.join(starts, own).withColumn("position", F.col("start") + F.col("rank"))
    return cut(placed.select("conv_id", *KEY, "position", F.floor((F.col("position") - 1) / stretch).cast("int").alias("part"), "role", "text"))


def prefixes(placed: DataFrame) -> DataFrame:
    """(conv_id, KEY, position, h1, h2): the hashes of all prefixes. Written once."""
    own = [*KEY, "part"]
    hashed = placed.select("conv_id", *own, "position", turn_hash(1).alias("t1"), turn_hash(2).alias("t2"))
    sums = hashed.groupBy(*own).agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    before = running(Window.partitionBy(*KEY).orderBy("part"))
    sums = sums.select(*own, *(F.coalesce(F.bit_xor(s).over(before), F.lit(0).cast("long")).alias(s) for s in ("s1", "s2")))
    so_far = running(Window.partitionBy(*own).orderBy("position"), 0)
    rolled = hashed.withColumns({h: F.bit_xor(t).over(so_far) for h, t in (("r1", "t1"), ("r2", "t2"))}).join(sums, own)
    return cut(rolled.select("conv_id", *KEY, "position", F.col("r1").bitwiseXOR(F.col("s1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("s2")).alias("h2")))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that stay: of equal ones the smallest conv_id, none that another extends."""
    key = ["position", "h1", "h2"]
    ends = prefixes.groupBy(*KEY).agg(F.max(F.struct(*key, "conv_id")).alias("last")).select(*KEY, "last.*")
    distinct = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    # prefixes that a turn follows
    inner = prefixes.join(ends.select(*KEY, F.col("position").alias("__n")), KEY).where(F.col("position") < F.col("__n")).select(*key).distinct()
    return distinct.join(inner, key, "left_anti").select("conv_id", F.col("position").alias("n_turns"), "copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n"))


def format_chats(turns: DataFrame, stretch: int = 1024, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, part, n_turns, copies, text) of the maximal conversations.

    text has the turns one after the other, in order of (turn, role, text). A
    conversation of more than ``stretch`` turns gets a row for each stretch of so many,
    with part 0, 1, ... in order; their texts joined are the whole. n_turns is the
    conversation's, and copies how many conversations equal it, itself included. A
    null role is rendered as user, a null text as empty, but neither equals a role or
    text that is given. Null turns come first; repeated turns are turns, however many
    there are: those of one number are ordered in one task, which spills, and no
    more than ``stretch`` of them are ever put together. Rows with a null conv_id are one
    conversation, which is named so only if no other equals it. An empty table gives
    an empty result; other columns are ignored.
    """
    turns = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    placed = positions(turns, stretch)
    stay = small_side(keyed(cut(maximal(prefixes(placed)))).drop("conv_id"))
    kept = placed.join(stay, KEY)
    line = F.struct("position", rendered(F.col("role"), F.col("text")).alias("line"))
    parts = kept.groupBy(*KEY, "part", "n_turns", "copies").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(line)).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
