"""Per-user state that windows cannot express: milestones, vote limits, vote life cycles.

State is kept by ``transformWithState``, which needs the RocksDB state store
(``agora.session.ROCKSDB_PROVIDER``). The Python code per key is a few lines; Spark
partitions the keys, checkpoints the state and restores it elsewhere if an executor dies.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from agora.schemas import VOTE_TYPES
from agora.session import ROCKSDB_PROVIDER
from agora.streaming.votes import in_time


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


class _Milestones(StatefulProcessor):
    """Running number of a user's interactions."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.count.get()
        before = 0 if state is None else state[0]
        total = before + sum(len(chunk) for chunk in rows)
        self.count.update((total,))
        reached = range(before // self.every + 1, total // self.every + 1)
        if len(reached):
            yield pd.DataFrame(
                {"user_id": [key[0]] * len(reached), "total_interactions": [i * self.every for i in reached]}
            )

    def close(self) -> None:
        pass


def milestones(interactions: DataFrame, every: int = 10) -> DataFrame:
    """One row whenever a user completes another ``every`` interactions."""
    return (
        interactions.select("user_id")
        .groupBy("user_id")
        .transformWithStateInPandas(
            statefulProcessor=_Milestones(every),
            outputStructType="user_id string, total_interactions long",
            outputMode="Update",
            timeMode="None",
        )
    )


class _VoteLimit(StatefulProcessor):
    """Votes wait until the watermark has passed them, then count in order of time.

    A window opens with the first vote after the last window. Timers wake a user's state for
    the earliest waiting vote and for the end of the window; with the last of these the state
    is empty.
    """

    def __init__(self, limit: int, seconds: float):
        self.limit, self.span = limit, round(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "moment long, event_id string")
        self.window = handle.getValueState("window", "opened long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        votes = [(row.moment, row.event_id) for row in rows]
        self.waiting.appendList(votes)
        self._wake_at(min(moment for moment, _ in votes))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1_000
        votes = sorted(tuple(row) for row in self.waiting.get())
        due = [vote for vote in votes if vote[0] <= now]
        opened, count = self.window.get() or (None, 0)
        for moment, event_id in due:
            if opened is None or moment >= opened + self.span:
                opened, count = moment, 0
            count += 1
            yield Row(user_id=key[0], event_id=event_id, moment=moment, window_position=count, is_allowed=count <= self.limit)
        later = votes[len(due) :]
        if later:
            self.waiting.put(later)
            self._wake_at(later[0][0])
        else:
            self.waiting.clear()
        if opened is None or opened + self.span <= now:
            self.window.clear()
        else:
            self.window.update((opened, count))
            self._wake_at(opened + self.span)

    def _wake_at(self, moment: int) -> None:
        self.handle.registerTimer(-(-moment // 1_000))

    def close(self) -> None:
        pass


def limit_votes(events: DataFrame, limit: int = 10, seconds: float = 60, delay: str = "10 minutes") -> DataFrame:
    """Every vote with its position in the user's current window and whether it is allowed.

    The window starts at the user's first vote and lasts ``seconds``; votes beyond ``limit``
    within it are refused. Votes are judged by their own time, in whatever batch they come:
    each one is held until the watermark (``delay`` behind the newest vote) has passed it, and
    votes that come after that are dropped. Votes of one instant count by their id. A user
    whose window has ended has no state.
    """
    found = (
        in_time(events.select("user_id", "event_id", "timestamp"), delay=delay)
        .withColumn("moment", F.unix_micros("timestamp"))
        .groupBy("user_id")
        .transformWithState(
            statefulProcessor=_VoteLimit(limit, seconds),
            outputStructType="user_id string, event_id string, moment long, window_position long, is_allowed boolean",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return found.withColumn("moment", F.timestamp_micros("moment")).withColumnRenamed("moment", "timestamp")


class _History(StatefulProcessor):
    """The newest records of a user; with a life given, a timer drops those that have outlived it."""

    def __init__(self, keep: int, life: int):
        self.keep, self.life = keep, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "moment long, event_id string, category string, words long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self._alive(timerValues)
        new = [(row.moment, row.event_id, row.sentiment_category, row.word_count) for row in rows]
        newest = heapq.nlargest(self.keep, {record[:2]: record for record in known + new}.values(), key=lambda r: r[:2])
        self._keep(newest)
        for place, (moment, event_id, category, words) in enumerate(newest, 1):
            yield Row(user_id=key[0], place=place, event_id=event_id, moment=moment, sentiment_category=category, word_count=words)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._keep(self._alive(timerValues))
        return iter(())

    def _alive(self, timerValues) -> list[tuple]:
        """The records kept; timers run after the rows of a batch, so age is judged here too."""
        records = [tuple(row) for row in self.kept.get()]
        if not self.life:
            return records
        now = timerValues.getCurrentWatermarkInMs() * 1_000
        return [record for record in records if record[0] + self.life > now]

    def _keep(self, records: list[tuple]) -> None:
        if not records:
            self.kept.clear()
            return
        self.kept.put(records)
        if self.life:
            self.handle.registerTimer(-(-(records[-1][0] + self.life) // 1_000))  # the oldest comes last

    def close(self) -> None:
        pass


def recent_thoughts(thoughts: DataFrame, keep: int = 10, hours: float = 0, delay: str = "10 minutes") -> DataFrame:
    """The last ``keep`` thoughts of every user with new ones, newest first.

    ``thoughts`` needs user_id, event_id, timestamp, sentiment_category and word_count; those
    that come late take the place of their time, and a repeated event counts once. With
    ``hours`` given, a thought is forgotten once the watermark (``delay`` behind the newest
    thought of all users) is that far past it, and thoughts behind the watermark are dropped.
    A user's state never holds more than ``keep`` records.
    """
    rows = thoughts.select(
        "user_id", "event_id", "timestamp", "sentiment_category", F.col("word_count").cast("long").alias("word_count")
    )
    if hours:
        rows = in_time(rows, delay=delay)
    found = (
        rows.withColumn("moment", F.unix_micros("timestamp"))
        .groupBy("user_id")
        .transformWithState(
            statefulProcessor=_History(keep, round(hours * 3_600_000_000)),
            outputStructType="user_id string, place int, event_id string, moment long, sentiment_category string, word_count long",
            outputMode="Update",
            timeMode="EventTime" if hours else "None",
        )
    )
    return found.withColumn("moment", F.timestamp_micros("moment")).withColumnRenamed("moment", "timestamp")


class _CurrentVote(StatefulProcessor):
    """The vote that counts for a user and idea, and the change each new event makes.

    Keys are many and their rows few, so this works on rows rather than on small frames.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vote = handle.getValueState("vote", "vote_type string, moment long, event_id string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r.moment, r.event_id))
        state = self.vote.get()
        old = None
        if state is not None:
            old = state[0]
            if (last.moment, last.event_id) < (state[1], state[2]):
                return
        new = None if last.event_type == "vote_removed" else last.vote_type
        self.vote.update((new, last.moment, last.event_id))
        changes = [int(new == kind) - int(old == kind) for kind in VOTE_TYPES]
        if any(changes):
            yield Row(
                idea_id=key[0],
                user_id=key[1],
                upvote_change=changes[0],
                downvote_change=changes[1],
                rating_change=changes[2],
            )

    def close(self) -> None:
        pass


def vote_changes(events: DataFrame) -> DataFrame:
    """Signed changes of an idea's counts from cast, update and remove events.

    The sums of the changes per idea are its current counts. Nothing is written for an
    event that changes no count.
    """
    return (
        events.select(
            "idea_id", "user_id", "event_id", "event_type", "vote_type", F.unix_micros("timestamp").alias("moment")
        )
        .groupBy("idea_id", "user_id")
        .transformWithState(
            statefulProcessor=_CurrentVote(),
            outputStructType="idea_id int, user_id string, upvote_change long,"
            " downvote_change long, rating_change long",
            outputMode="Append",
            timeMode="None",
        )
    )
