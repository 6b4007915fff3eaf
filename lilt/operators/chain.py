"""Greedy breaks whose next step depends on the previous one, solved block by block.

Both greedy rules (clause breaks of long sentences, speech chunks of bounded span) carry a small state from one row
to the next. Each block of rows is summarised as a map from every possible entry state to its exit state; the maps
are composed over the blocks, and each block is then replayed from its known entry state. No task sees more than one
block of rows, or one group of block maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lilt.operators.scan import Run, running
from lilt.session import cut

# Fixed value: a clause break needs this many words in the sentence.
CLAUSE_WORDS = 30
CHAIN_ROWS = 1 << 16
FAN = 1024


def entry_states(maps: DataFrame, start: int, closed: int, fan: int = FAN) -> DataFrame:
    """Entry state ``c0`` of every block, from ``maps(recording_id, blk, exits MAP<BIGINT, BIGINT>)``.

    ``start`` is the state before the first block. ``closed`` replaces a state that a block does not list and the
    state after a run of absent blocks.
    """
    lists = (
        maps.withColumn("grp", F.expr(f"blk div {fan}"))
        .groupBy("recording_id", "grp")
        .agg(F.array_sort(F.collect_list(F.struct("blk", F.map_entries("exits").alias("exits")))).alias("list"))
        .withColumn("list", F.transform("list", lambda b: F.struct(b["blk"].alias("blk"),
                                                                   F.map_from_entries(b["exits"]).alias("exits"))))
    )
    key = f"CASE WHEN b.blk = s.at THEN s.c ELSE {closed}L END"
    leave = f"coalesce(b.exits[{key}], b.exits[{closed}L])"
    through = f"(s, b) -> named_struct('c', {leave}, 'at', b.blk + 1)"
    groups = lists.select(
        "recording_id",
        "grp",
        F.expr("list[0].blk").alias("first_blk"),
        F.expr("element_at(list, -1).blk").alias("last_blk"),
        F.expr(
            "transform(map_keys(list[0].exits), k -> named_struct('key', k, 'value',"
            f" aggregate(list, named_struct('c', k, 'at', list[0].blk), {through}, s -> s.c)))"
        ).alias("exits"),
    )
    group_key = f"CASE WHEN b.first_blk = s.at THEN s.c ELSE {closed}L END"
    walk = (
        f"aggregate(gs, named_struct('c', {start}L, 'at', 0L, 'out', cast(array() as array<struct<grp:bigint,c:bigint>>)),"
        f" (s, b) -> named_struct("
        f"'c', coalesce(try_element_at(filter(b.exits, e -> e.key = {group_key}), 1).value,"
        f" try_element_at(filter(b.exits, e -> e.key = {closed}L), 1).value),"
        f" 'at', b.last_blk + 1,"
        f" 'out', concat(s.out, array(named_struct('grp', b.grp, 'c', {group_key})))), s -> s.out)"
    )
    by_group = (
        groups.groupBy("recording_id")
        .agg(F.array_sort(F.collect_list(F.struct("grp", "first_blk", "last_blk", "exits"))).alias("gs"))
        .select("recording_id", F.expr(f"inline({walk})"))
    )
    inner = (
        "aggregate(list, named_struct('c', c, 'at', list[0].blk,"
        " 'out', cast(array() as array<struct<blk:bigint,c0:bigint>>)),"
        f" (s, b) -> named_struct('c', {leave}, 'at', b.blk + 1,"
        f" 'out', concat(s.out, array(named_struct('blk', b.blk, 'c0', {key})))), s -> s.out)"
    )
    return lists.join(by_group, ["recording_id", "grp"]).select("recording_id", F.expr(f"inline({inner})"))


def clause_breaks(flagged: DataFrame, rows: int = CHAIN_ROWS, fan: int = FAN) -> DataFrame:
    """Taken clause breaks as (recording_id, word_idx, _clause).

    ``flagged(recording_id, word_idx, _flag)``: 2 closes a sentence, 1 closes it only after ``CLAUSE_WORDS`` words.
    The state is the number of words already in the sentence, which matters up to ``CLAUSE_WORDS - 1`` only.
    """
    full = CLAUSE_WORDS - 1
    blocks = (
        flagged.filter(F.col("_flag") > 0)
        .select(
            "recording_id",
            F.expr(f"word_idx div {rows}").alias("blk"),
            (F.expr(f"cast(word_idx % {rows} as int)") * 4 + F.col("_flag")).cast("int").alias("p"),
        )
        .groupBy("recording_id", "blk")
        .agg(F.array_sort(F.collect_list("p")).alias("marks"))
    )
    before = f"least(s.c + shiftright(x, 2) - s.at, {full}L)"
    closes = f"((x & 3) = 2 OR {before} >= {full})"
    moved = f"'c', CASE WHEN {closes} THEN 0L ELSE {before} + 1 END, 'at', shiftright(x, 2) + 1"
    step = f"(s, x) -> named_struct({moved})"
    leave = f"s -> least(s.c + {rows} - s.at, {full}L)"
    # A hard mark makes the exit state independent of the entry state: one fold from the last hard mark is enough.
    maps = blocks.withColumn("hard", F.expr("array_max(filter(marks, x -> (x & 3) = 2))")).select(
        "recording_id",
        "blk",
        F.expr(
            f"map_from_arrays(sequence(0L, {full}L), CASE WHEN hard IS NOT NULL THEN array_repeat("
            f"aggregate(filter(marks, x -> x > hard), named_struct('c', 0L, 'at', shiftright(hard, 2) + 1), {step}, {leave}),"
            f" {CLAUSE_WORDS}) ELSE transform(sequence(0L, {full}L), c0 ->"
            f" aggregate(marks, named_struct('c', c0, 'at', 0), {step}, {leave})) END)"
        ).alias("exits"),
    )
    replayed = blocks.join(entry_states(maps, start=0, closed=full, fan=fan), ["recording_id", "blk"])
    taken = (
        "aggregate(marks, named_struct('c', c0, 'at', 0, 'out', cast(array() as array<int>)),"
        f" (s, x) -> named_struct({moved},"
        f" 'out', CASE WHEN (x & 3) = 1 AND {before} >= {full} THEN concat(s.out, array(shiftright(x, 2))) ELSE s.out END),"
        " s -> s.out)"
    )
    return (
        replayed.select("recording_id", "blk", F.explode(F.expr(taken)).alias("off"))
        .select("recording_id", (F.col("blk") * rows + F.col("off")).alias("word_idx"), F.lit(True).alias("_clause"))
    )


def bounded_spans(segments: DataFrame, pause: int, target: int, block: int, fan: int = FAN) -> DataFrame:
    """First start of the group each segment belongs to, as column ``group_start``.

    ``segments(recording_id, start_sample, end_sample, seg_idx, part)`` in order of start. A group closes before a
    segment that follows ``pause`` or more after its predecessor, or whose end lies more than ``target`` after the
    group start. The state is the start of the open group, so only starts within ``target`` of a block matter.
    ``block`` is a span of samples, well above ``target``.
    """
    order = F.struct("start_sample", "seg_idx", "part")
    blk = F.expr(f"start_sample div {block}")
    chained = running(
        segments.withColumn("_at", order),
        ["recording_id"],
        "_at",
        {"_prev": Run("last", F.col("end_sample"), inclusive=False)},
        blocks=[blk, F.expr(f"start_sample div {block * 4096}")],
    ).withColumn("_hard", F.coalesce(F.col("start_sample") - F.col("_prev") >= pause, F.lit(True)))

    late = F.col("start_sample") % block >= block - target
    held = chained.withColumn("blk", F.explode(F.when(late, F.array(blk, blk + 1)).otherwise(F.array(blk))))
    own: Column = F.col("blk") == blk
    item = F.struct("start_sample", "seg_idx", "part", "end_sample", F.col("_hard").alias("hard"))
    blocks = (
        held.groupBy("recording_id", "blk")
        .agg(
            F.array_sort(F.collect_list(F.when(own, item))).alias("segs"),
            F.collect_set(F.when(~own, F.col("start_sample"))).alias("before"),
        )
        .filter(F.size("segs") > 0)
    )
    blocks = cut(blocks, "spans")
    opened = f"s < 0 OR x.hard OR x.end_sample - s > {target}"
    step = f"(s, x) -> CASE WHEN {opened} THEN x.start_sample ELSE s END"
    # A closing pause makes the exit state independent of the entry state: one fold from the last pause is enough.
    paused = F.expr("array_max(transform(filter(segs, x -> x.hard), x -> x.start_sample))")
    maps = blocks.withColumn("paused", paused).select(
        "recording_id",
        "blk",
        F.expr(
            "CASE WHEN paused IS NOT NULL THEN map_from_arrays(concat(array(-1L), before), array_repeat("
            f"aggregate(filter(segs, x -> x.start_sample > paused), paused, {step}), size(before) + 1))"
            " ELSE map_from_entries(transform(concat(array(-1L), before), c ->"
            f" named_struct('key', c, 'value', aggregate(segs, c, {step})))) END"
        ).alias("exits"),
    )
    replayed = blocks.join(entry_states(maps, start=-1, closed=-1, fan=fan), ["recording_id", "blk"])
    replay = (
        "aggregate(segs, named_struct('s', c0, 'out', cast(array() as array<bigint>)),"
        f" (a, x) -> named_struct('s', CASE WHEN {opened.replace('s <', 'a.s <').replace('- s >', '- a.s >')}"
        " THEN x.start_sample ELSE a.s END,"
        f" 'out', concat(a.out, array(CASE WHEN {opened.replace('s <', 'a.s <').replace('- s >', '- a.s >')}"
        " THEN x.start_sample ELSE a.s END))), a -> a.out)"
    )
    return (
        replayed.withColumn("starts", F.expr(replay))
        .select("recording_id", F.inline(F.arrays_zip("segs", "starts")))
        .select("recording_id", "segs.start_sample", "segs.end_sample", "segs.seg_idx", "segs.part",
                F.col("starts").alias("group_start"))
    )
