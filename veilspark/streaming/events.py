"""Events as they come: what changes in a group, and the stage that each run is at, with state that a watermark bounds.

Events may come late, twice and in any order. What a group's events say depends on their order, so each waits in a state until
the watermark has passed it; then it is final, and whatever comes for a time before the watermark is late and left out. Groups are dealt over
``BUCKETS`` states, so that what a call costs is shared by all groups of a state. A state holds the events of the allowed delay and the last one of each
group, and is kept in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "held binary"
#: States that the groups are dealt over. A checkpoint can only be read with the number that it was written with.
BUCKETS = 1024


def _held(state: GroupState) -> pd.DataFrame:
    with pa.ipc.open_stream(state.get[0]) as found:
        return found.read_pandas()


def _settled(state: GroupState, groups: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The events of a state's groups by group (``g``), time and id, each id once: ``told`` is the last of its group that was settled before,
    ``passed`` are those that the watermark has passed, ``first`` the first of their group, ``head`` the last passed one of it, ``changed`` those not told of that
    have another key than the one before. New events that are late are left out."""
    watermark = state.getCurrentWatermarkMs()
    parts = [_held(state)] if state.exists else []
    if not state.hasTimedOut:
        new = pd.concat(list(groups))[["group", "id", "ms", "key"]]
        parts.append(new[new["ms"] > watermark].assign(told=False, stalled=False))
    parts = [p for p in parts if len(p)] or parts[:1]
    rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].copy()
    rows["g"] = pd.factorize(rows["group"], use_na_sentinel=False)[0]
    if not state.hasTimedOut:
        rows = rows[~rows.duplicated(["told", "g", "id"])]
    rows = rows.iloc[np.lexsort((rows["id"], rows["ms"], rows["g"]))].reset_index(drop=True)
    g, k, passed = rows["g"].to_numpy(), pd.factorize(rows["key"], use_na_sentinel=False)[0], rows["ms"].to_numpy() <= watermark
    first = np.ones(len(rows), bool)
    first[1:] = g[1:] != g[:-1]
    other = first.copy()
    other[1:] |= k[1:] != k[:-1]
    head = passed.copy()
    head[:-1] &= first[1:] | ~passed[1:]
    return rows.assign(passed=passed, first=first, head=head, changed=other & passed & ~rows["told"])


def _keep(state: GroupState, rows: pd.DataFrame, due: int | None = None) -> None:
    """Store what waits and the last settled event of each group, and be called again once the watermark reaches the first that waits, or is beyond ``due``."""
    kept = rows.loc[~rows["passed"] | rows["head"], ["group", "id", "ms", "key", "passed", "stalled"]].rename(columns={"passed": "told"})
    if kept.empty:
        return
    table = pa.Table.from_pandas(kept, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    waits = kept.loc[~kept["told"], "ms"]
    # A state is called when the watermark is beyond its time-out.
    times = ([int(waits.min()) - 1] if len(waits) else []) + ([] if due is None else [due])
    if times:
        state.setTimeoutTimestamp(max(min(times), state.getCurrentWatermarkMs(), 1))


def _timed(stream: DataFrame, group: str, order: str, time: str, key: str, delay: str) -> DataFrame:
    named = stream.select(F.col(group).alias("group"), F.col(order).cast("long").alias("id"), F.col(time).cast("timestamp").alias("time"), F.col(key).cast("string").alias("key"))
    named = named.where("group IS NOT NULL AND id IS NOT NULL AND time IS NOT NULL").withWatermark("time", delay)
    bucket = F.pmod(F.xxhash64("group"), F.lit(BUCKETS)).cast("int")
    return named.select(bucket.alias("bucket"), "group", "id", "time", F.unix_millis("time").alias("ms"), "key")


def changes(stream: DataFrame, key: str, order: str, group: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """(group, order, key): ``report.new_events`` of a stream, by time and then ``order``, a number that names an event.

    Rows without a group, a number or a time are left out; a null key is a key. An event that comes again, or later than ``delay`` behind the
    newest, has no effect.
    """
    rows = _timed(stream, group, order, time, key, delay)
    kind = rows.schema["group"].dataType.simpleString()

    def run(_: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = _settled(state, groups)
        _keep(state, found)
        yield found.loc[found["changed"], ["group", "id", "key"]].set_axis([group, order, key], axis=1)

    schema = f"`{group}` {kind}, `{order}` long, `{key}` string"
    return rows.groupBy("bucket").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_states(stream: DataFrame, stage: str, order: str, run: str, time: str, stages: tuple[str, ...], delay: str = "10 minutes", idle: int = 3_600_000) -> DataFrame:
    """(run, at, stage, state): the states of all stages of a run whenever its stage changes, ``report.stage_state`` of the newest event.

    A run of whose events none has come for ``idle`` milliseconds of event time, and that is not at its last stage, is reported once with the stage that it
    is at as ``stalled``. Events of unknown stages count for nothing.
    """
    rows = _timed(stream.where(F.col(stage).isin(*stages)), run, order, time, stage, delay)
    kind = rows.schema["group"].dataType.simpleString()

    def states(at: pd.DataFrame, here: str) -> pd.DataFrame:
        """A row for each stage, of every event in ``at``."""
        now, n = np.repeat(at["key"].map(stages.index).to_numpy(int), len(stages)), np.tile(np.arange(len(stages)), len(at))
        state = np.select([n < now, n == now], ["done", here], "pending").astype(object)
        return pd.DataFrame({run: at["group"].repeat(len(stages)).to_numpy(), "at": at["ms"].repeat(len(stages)).to_numpy(), stage: np.array(stages, object)[n], "state": state})

    def follow(_: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found, watermark = _settled(state, groups), state.getCurrentWatermarkMs()
        again = found["stalled"].shift(fill_value=False) & ~found["first"] & found["passed"]
        yield states(found[found["changed"] | again], "active")
        # Of runs with no event that waits, and not at their end, those that are stalled by now, and the time when the next one is.
        idles = found["head"] & found["first"].shift(-1, fill_value=True) & ~found["stalled"] & (found["key"] != stages[-1])
        late = idles & (found["ms"] + idle < watermark)
        yield states(found[late], "stalled")
        found["stalled"] |= late
        due = found.loc[idles & ~late, "ms"]
        _keep(state, found, int(due.min()) + idle if len(due) else None)

    schema = f"`{run}` {kind}, at long, `{stage}` string, state string"
    return rows.groupBy("bucket").applyInPandasWithState(follow, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
