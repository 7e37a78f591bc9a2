"""Change windows, numbering, rule health, convergence and run status over arriving rows.

Where an answer depends on log order, rows of one source must arrive in that order over the batches; within a batch they are sorted.
State holds counters and open windows only, never rows. Each operator gives over all batches what its batch form gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from changeproof.operators.fence import FENCE
from changeproof.schema import DEAD_RULE_RUNS

FENCED = "idx long, run_id string, scenario_id string, nonce string, status string, n_rows long"
#: Positions after which an open window without a close is given up, and a closed one is forgotten.
EXPIRY = 10_000_000
#: Buckets of the keys of a stream: so many tasks may share its work, and each batch calls Python so often.
BUCKETS = 512


def _typed(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns)


def _key(key: tuple, columns: list[str]) -> dict:
    return dict(zip(columns, key, strict=True))


def _all(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


def stream_fence_windows(log: DataFrame, source: list[str], expiry: int = EXPIRY) -> DataFrame:
    """log(source, idx, boundary, run_id, scenario_id, nonce), boundary null for rows that are no markers, to tagged positions.

    Status "inside" for each row and each window open at it, "closed" with the number of rows at the first close,
    "unfenced" for a row outside all, "close_before_open" and "missing_close" for windows that are not fenced. Rows of a window
    count once its "closed" row has come. Only positions decide, never time; a row is sent on at once, not held in state.
    """

    def step(key, frames, state):
        kept = json.loads(state.get[0]) if state.exists else []
        windows = {tuple(w[:3]): w[3:] for w in kept}  # opened at, rows so far, closed at
        rows = _all(frames, ["idx"])
        marks = rows.index[rows["boundary"].notna()].tolist()
        out, at = [], 0
        for end in [*marks, len(rows)]:
            part = rows.iloc[at:end][["idx"]]
            if len(part):
                opened = [w for w, (_, _, closed) in windows.items() if closed is None]
                for w in opened:
                    windows[w][1] += len(part)
                    out.append(part.assign(**dict(zip(FENCE, w, strict=True)), status="inside"))
                if not opened:
                    out.append(part.assign(**dict.fromkeys(FENCE), status="unfenced"))
            if end < len(rows):
                mark = rows.iloc[end]
                w, idx = tuple(None if pd.isna(mark[c]) else mark[c] for c in FENCE), int(mark["idx"])
                was = windows.get(w)
                told = None
                if mark["boundary"] == "open" and was is None:
                    windows[w] = [idx, 0, None]
                elif mark["boundary"] == "close" and was is None:
                    windows[w], told = [idx, 0, idx], "close_before_open"
                elif mark["boundary"] == "close" and was[2] is None:
                    was[2], told = idx, "closed"
                if told:
                    out.append(pd.DataFrame([{"idx": idx, **dict(zip(FENCE, w, strict=True)), "status": told, "n_rows": windows[w][1]}]))
            at = end + 1
        last = int(rows["idx"].iloc[-1])
        for w, (opened_at, n, closed) in list(windows.items()):
            if last - (opened_at if closed is None else closed) > expiry:
                del windows[w]
                if closed is None:
                    out.append(pd.DataFrame([{"idx": last, **dict(zip(FENCE, w, strict=True)), "status": "missing_close", "n_rows": n}]))
        state.update((json.dumps([[*w, *v] for w, v in windows.items()]),))
        for part in out:
            yield part.assign(**_key(key, source)).reindex(columns=[*source, "idx", *FENCE, "status", "n_rows"]).astype({"n_rows": "Int64"})

    return log.groupBy(*source).applyInPandasWithState(step, f"{_typed(log, source)}, {FENCED}", "windows string", "append", "NoTimeout")


def stream_rebase_seq(events: DataFrame, source: list[str], drain: str, seq: str = "seq", buckets: int = BUCKETS) -> DataFrame:
    """(source, drain, seq) with seq continued over the drains of a source; the state is one count a source.

    Sources are dealt to buckets by hash, since each call of Python costs milliseconds; a stream that goes on from a checkpoint must keep
    its number of buckets.
    """
    named = "__source"

    def step(key, frames, state):
        kept = json.loads(state.get[0]) if state.exists else {}
        rows = _all(frames, [named, drain, seq])
        rows = rows[rows[drain].notna()]
        parts, starts = rows.groupby([named, drain], sort=False).size(), []
        for (name, number), n in zip(parts.index, parts.tolist(), strict=True):
            before, current, size = kept.get(name, (0, None, 0))
            if number != current:
                before, current, size = before + size, int(number), 0
            starts.append(before)
            kept[name] = (before, current, size + n)
        yield rows.assign(**{seq: rows[seq] + np.repeat(np.array(starts, np.int64), parts.to_numpy())})[[*source, drain, seq]]
        state.update((json.dumps(kept),))

    name = F.to_json(F.array(*[F.col(c).cast("string") for c in source])).alias(named)
    rows = events.select(F.pmod(F.xxhash64(*source), F.lit(buckets)).alias("__bucket"), name, *source, drain, seq)
    return rows.groupBy("__bucket").applyInPandasWithState(step, _typed(events, [*source, drain, seq]), "kept string", "append", "NoTimeout")


def stream_rule_health(runs: DataFrame, dead_after: int = DEAD_RULE_RUNS) -> DataFrame:
    """runs(rule_id, rule_hash, run_idx, fired) to the count of runs without a fire up to each run, and whether the rule is dead by then."""
    columns = ["rule_id", "rule_hash"]

    def step(key, frames, state):
        zeros = state.get[0] if state.exists else 0
        rows = _all(frames, ["run_idx"])
        fires = (rows["fired"] > 0).cumsum()
        count = rows.groupby(fires).cumcount() + (fires == 0).astype(int)
        count = (count + (fires == 0) * zeros).astype("int64")
        state.update((int(count.iloc[-1]),))
        yield pd.DataFrame({**_key(key, columns), "run_idx": rows["run_idx"], "zero_runs": count, "dead": count >= dead_after})

    schema = f"{_typed(runs, columns)}, run_idx long, zero_runs long, dead boolean"
    return runs.groupBy(*columns).applyInPandasWithState(step, schema, "zero_runs long", "append", "NoTimeout")


def stream_quiet_period(events: DataFrame, by: list[str], at: str, quiet_ms: int = 750, cap_ms: int = 5_000, late: str = "10 seconds") -> DataFrame:
    """Runs of events less than quiet_ms apart: when each became quiet, how long that took, and whether the cap came first."""
    sessions = events.withWatermark(at, late).groupBy(*by, F.session_window(at, f"{quiet_ms} milliseconds").alias("w")).agg(F.count("*").alias("n_events"))
    waited = F.floor((F.unix_micros("w.end") - F.unix_micros("w.start")) / 1000)
    return sessions.select(
        *by, F.col("w.start").alias("began"), "n_events", F.least(waited, F.lit(cap_ms).cast("long")).alias("waited_ms"), (waited > cap_ms).alias("noisy")
    )


def stream_pair_requests(requests: DataFrame, replies: DataFrame, key: str, at: str, within: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """Each request with its response or failure within the given time, else with none; durations are never negative.

    ``requests(key, at, ...)``, ``replies(key, at, status)``: both are event-time streams, so state is bounded by the two times.
    """
    left = requests.withWatermark(at, late).alias("q")
    right = replies.withWatermark(at, late).alias("r")
    span = F.expr(f"q.`{key}` = r.`{key}` AND r.`{at}` >= q.`{at}` AND r.`{at}` <= q.`{at}` + interval {within}")
    took = F.greatest(F.unix_millis(f"r.{at}") - F.unix_millis(f"q.{at}"), F.lit(0).cast("long"))
    return left.join(right, span, "left_outer").select(F.col(f"q.{key}"), F.col(f"q.{at}"), F.col("r.status"), F.when(F.col(f"r.{at}").isNotNull(), took).alias("duration_ms"))


def keyed_state(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, which maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[ms]").astype("int64")


class _Convergence(StatefulProcessor):
    """Matches of each expectation in a map; when the window began, how many expectations are met, and whether it is answered; a timer at the limit."""

    def __init__(self, by: list[str], limit_ms: int):
        self.by, self.limit_ms = by, limit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "exp_idx int", "n long")
        self.window = handle.getValueState("window", "began long, met long, done boolean")

    def _answer(self, key, result, took):
        return pd.DataFrame([{**_key(key, self.by), "result": result, "took_ms": took}])

    def handleInputRows(self, key, rows, timerValues):
        frame = _all(rows, ["at", "exp_idx"])
        millis = _millis(frame["at"])
        began, met, done = self.window.get() if self.window.exists() else (int(millis.iloc[0]), 0, False)
        if not self.window.exists():
            self.handle.registerTimer(began + self.limit_ms)
        for e, wanted, n, ms in zip(frame["exp_idx"], frame["wanted"], frame["n_expectations"], millis, strict=True):
            if done:
                break
            if ms - began > self.limit_ms:
                done = True
                yield self._answer(key, "miss", self.limit_ms)
                break
            seen = (self.counts.getValue((int(e),))[0] if self.counts.containsKey((int(e),)) else 0) + 1
            self.counts.updateValue((int(e),), (seen,))
            met += int(seen == wanted)
            if met == n:
                done = True
                yield self._answer(key, "ok", int(ms - began))
        if done:
            self.counts.clear()
        self.window.update((began, met, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, _, done = self.window.get()
        # What is answered is kept as answered, so that a late match does not begin the window again.
        self.counts.clear()
        self.window.update((*self.window.get()[:2], True))
        if not done:
            yield self._answer(key, "miss", self.limit_ms)

    def close(self) -> None:
        pass


def stream_convergence(matches: DataFrame, by: list[str], limit_ms: int = 10_000, late: str = "10 seconds") -> DataFrame:
    """matches(by, at, exp_idx, wanted, n_expectations): "ok" once each expectation of a window has its wanted matches, "miss" at the limit.

    The limit runs from the window's first match; the answer, given once, carries the milliseconds it took.
    """
    keyed_state(matches.sparkSession)
    schema = f"{_typed(matches, by)}, result string, took_ms long"
    return matches.withWatermark("at", late).groupBy(*by).transformWithStateInPandas(_Convergence(by, limit_ms), schema, "Append", "EventTime")


class _RunStatus(StatefulProcessor):
    """A bucket of runs: when each open one was first heard of, the list of those answered, batch by batch, and one timer at the first time by which a verdict must come."""

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "runs string, timer long")
        self.answered = handle.getListState("answered", "run_ids string")

    def _opened(self) -> tuple[dict, int | None]:
        runs, timer = self.open.get() if self.open.exists() else ("[]", None)
        return dict(json.loads(runs)), timer

    def _keep(self, runs: dict, timer: int | None, answers: dict) -> Iterator[pd.DataFrame]:
        """Answers are told and kept as answered, so that a late record does not begin the run again; the timer goes to the first open run."""
        first = min(runs.values()) + self.stale_ms if runs else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.open.update((json.dumps(list(runs.items())), first))
        if answers:
            self.answered.appendValue((json.dumps(list(answers)),))
            yield pd.DataFrame({"run_id": list(answers), "status": list(answers.values())}, dtype=object)

    def handleInputRows(self, key, rows, timerValues):
        frame = _all(rows, ["at"])
        (runs, timer), answers = self._opened(), {}
        before = {r for (part,) in self.answered.get() for r in json.loads(part)} if self.answered.exists() else set()
        for run, ms, status in zip(frame["run_id"], _millis(frame["at"]).tolist(), frame["status"], strict=True):
            if run in before or run in answers:
                continue
            intime = ms - runs.setdefault(run, ms) <= self.stale_ms
            if status != "in_progress" or not intime:
                answers[run] = status if intime else "stale"
                del runs[run]
        yield from self._keep(runs, timer, answers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        runs, _ = self._opened()
        over = timerValues.getCurrentWatermarkInMs() - self.stale_ms
        yield from self._keep({r: began for r, began in runs.items() if began > over}, None, {r: "stale" for r, began in runs.items() if began <= over})

    def close(self) -> None:
        pass


def stream_run_status(records: DataFrame, stale_ms: int = 3_600_000, late: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """records(run_id, at, status): the verdict or interruption that replaces a run's in_progress marker, or "stale" if none comes in time.

    Only event times decide, so the answer does not depend on how records fall into batches. Runs are dealt to buckets by hash, since each call
    of the processor costs milliseconds; a stream that goes on from a checkpoint must keep its number of buckets.
    """
    keyed_state(records.sparkSession)
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket")
    rows = records.withWatermark("at", late).select(F.col("run_id").cast("string").alias("run_id"), "at", "status").select(bucket, "*")
    return rows.groupBy("bucket").transformWithStateInPandas(_RunStatus(stale_ms), "run_id string, status string", "Append", "EventTime")
