"""Speech segments of streams of audio blocks, and the streaming twin of sessions.

A segment begins at the first loud block, with the blocks just before it as
far as they are preroll and no part of the segment before. It ends after a run
of quiet blocks once there is enough beside them, or at its longest length. State is
kept per stream; blocks of a micro-batch are taken in order of their number,
and late ones (a number already passed) are dropped, as a microphone has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.scratch import staged


class Limits(NamedTuple):
    threshold: float = 0.01
    block_ms: int = 30
    preroll_ms: int = 300
    silence_ms: int = 700
    longest_ms: int = 15_000
    least_ms: int = 200

    def blocks(self, ms: int) -> int:
        """Whole blocks in so much time, at least one."""
        return max(1, ms // self.block_ms)


STATE = "next_block bigint, first_block bigint, quiet bigint, free_from bigint"
SEGMENT = "stream string, first_block bigint, last_block bigint, speech_ms bigint"
#: Next block, no segment, no quiet blocks, and preroll from the first block on.
FRESH = (0, -1, 0, 0)


def advance(state: tuple, block: int, level: float, limits: Limits) -> tuple[tuple, tuple | None]:
    """One block later: the new (next, first, quiet, free from), and a finished (first, last, ms without the quiet end)."""
    following, first, quiet, free_from = state
    if block < following:
        return state, None
    loud = level >= limits.threshold
    if first < 0:
        start = max(free_from, block - limits.blocks(limits.preroll_ms) + 1) if loud else -1
        return (block + 1, start, 0, free_from), None
    quiet = 0 if loud else quiet + 1
    size = block - first + 1
    over = quiet >= limits.blocks(limits.silence_ms) and size - quiet >= limits.blocks(limits.least_ms)
    if over or size >= limits.longest_ms // limits.block_ms:
        return (block + 1, -1, 0, block + 1), (first, block, (size - quiet) * limits.block_ms)
    return (block + 1, first, quiet, free_from), None


def _run(stream: str, state: tuple, rows: pd.DataFrame, limits: Limits) -> tuple[tuple, pd.DataFrame]:
    out, rows = [], rows.sort_values("block")
    for block, level in zip(rows["block"].tolist(), rows["level"].tolist(), strict=True):
        state, done = advance(state, block, level, limits)
        if done:
            out.append((stream, *done))
    return state, pd.DataFrame(out, columns=[x.split()[0] for x in SEGMENT.split(", ")])


#: Blocks of a stream that a task takes at a time.
PART_BLOCKS = 100_000
#: Finished segments, and in rows of their own the state in which a part was left: as STATE, with the open segment's first block under another name.
CARRIED = f"{SEGMENT}, next_block bigint, open_from bigint, quiet bigint, free_from bigint, carried boolean"
CARRIED_KINDS = {name: {"bigint": "Int64", "string": "object", "boolean": "bool"}[kind] for name, kind in (x.split() for x in CARRIED.split(", "))}


def segments_in_parts(blocks: DataFrame, limits: Limits = Limits(), part_blocks: int = PART_BLOCKS) -> DataFrame:
    """blocks(stream, block, level) of a table to finished segments; a task takes part_blocks of a stream at most.

    Parts of all streams are taken in their order, each part of all streams at
    once: a part begins with the state in which its stream left the part before,
    which is a row of four numbers. Streams of one part take a single round.
    """
    ends = blocks.agg(F.max("block").alias("last")).first().last
    rounds = 1 if ends is None else max(0, ends) // part_blocks + 1
    part = F.floor(F.greatest("block", F.lit(0)) / part_blocks)
    parted = staged(blocks.select("stream", "block", "level", part.alias("part")), "blocks") if rounds > 1 else blocks.select("stream", "block", "level", F.lit(0).alias("part"))
    carried = blocks.sparkSession.createDataFrame([], CARRIED)
    out = None

    def step(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        stream = (rows if len(rows) else before)["stream"].iloc[0]
        state = FRESH if before.empty else tuple(int(before[c].iloc[0]) for c in ("next_block", "open_from", "quiet", "free_from"))
        state, found = _run(stream, state, rows, limits)
        ended = [(*r, None, None, None, None, False) for r in found.itertuples(index=False)]
        return pd.DataFrame([*ended, (stream, None, None, None, *state, True)], columns=list(CARRIED_KINDS)).astype(CARRIED_KINDS)

    for k in range(rounds):
        done = parted.where(F.col("part") == k).groupBy("stream").cogroup(carried.groupBy("stream")).applyInPandas(step, CARRIED)
        done = staged(done, "segments") if rounds > 1 else done
        carried, found = done.where("carried"), done.where("NOT carried").select(*[x.split()[0] for x in SEGMENT.split(", ")])
        out = found if out is None else out.unionAll(found)
    return out


def segments(blocks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """blocks(stream, block, level) to finished segments; as they end where blocks is a stream."""

    def each(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state, out = _run(key[0], tuple(group.get) if group.exists else FRESH, pd.concat(frames), limits)
        group.update(state)
        yield out

    if not blocks.isStreaming:
        return segments_in_parts(blocks, limits)
    return blocks.groupBy("stream").applyInPandasWithState(each, SEGMENT, STATE, "append", GroupStateTimeout.NoTimeout)


def session_stream(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Streaming sessions: closed once the watermark has passed their gap."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")
