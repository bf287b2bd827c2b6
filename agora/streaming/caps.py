"""T8 / W1 on a stream: volume caps per post, topic and cycle in Spark's keyed state.

The stream is keyed by topic. Comments of a cycle (a tumbling stretch of event
time) wait in map state by (cycle, post), sorted and cut to the post's cap, so
what waits is bounded by the caps and the open cycles. When the watermark
passes a cycle's end a timer ends it: its comments are taken in (time, id)
order, and one is stored while its post has fewer than ``per_post`` stored
comments, its topic fewer than ``per_topic`` and the cycle fewer than
``per_cycle`` of that topic. Counts of posts and of the topic last over all
cycles; a post not stored to for ``forget`` seconds is dropped from state.

The result is the same for every order of arrival that keeps within the
watermark's delay, since nothing is decided before a cycle is complete. A
comment that arrives twice in its cycle counts once. The cycle's budget is one
per topic: a common one would send all comments through a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from agora.streaming.streams import run_append

STORED = ("topic_id long, post_id long, comment_id long, created_utc long, cycle_start long, "
          "post_no long, topic_no long, cycle_no long")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Topic of the row that closes the last cycles of a finished stream; it is never stored.
CLOSING_TOPIC = -1


def merged(rows: list[tuple[int, int, int]], cap: int) -> list[tuple[int, int, int]]:
    """(time, id, post) in order, each id once, the first ``cap`` of each post."""
    first: dict[int, tuple[int, int, int]] = {}
    for row in rows:
        first[row[1]] = min(row, first.get(row[1], row))
    seen: dict[int, int] = {}
    out = []
    for row in sorted(first.values()):
        seen[row[2]] = seen.get(row[2], 0) + 1
        if seen[row[2]] <= cap:
            out.append(row)
    return out


def _processor(per_post: int, per_topic: int, per_cycle: int, cycle: int, forget: int | None) -> StatefulProcessor:
    import pandas as pd

    columns = [c.split()[0] for c in STORED.split(", ")]

    class Caps(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "cycle long", "times array<long>, ids array<long>, posts array<long>")
            self.posts = handle.getMapState("posts", "post long", "stored long, last long")
            self.topic = handle.getValueState("topic", "stored long")

        def handleInputRows(self, key, rows, timerValues):
            new: dict[int, list[tuple[int, int, int]]] = {}
            for frame in rows:
                for post, i, at in zip(frame["post_id"], frame["comment_id"], frame["created_utc"]):
                    new.setdefault(int(at) // cycle * cycle, []).append((int(at), int(i), int(post)))
            timers = set(self.handle.listTimers()) if new else set()
            for start, more in new.items():
                held = zip(*self.waiting.getValue((start,))) if self.waiting.containsKey((start,)) else []
                kept = merged([*held, *more], per_post)
                self.waiting.updateValue((start,), tuple(list(column) for column in zip(*kept)))
                end = (start + cycle) * 1000
                if end not in timers:
                    self.handle.registerTimer(end)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = expiredTimerInfo.getExpiryTimeInMs() // 1000
            ended = sorted(start for start, in self.waiting.keys() if start + cycle <= now)
            topic_no = self.topic.get()[0] if self.topic.exists() else 0
            out = []
            for start in ended:
                cycle_no = 0
                waiting = sorted(zip(*self.waiting.getValue((start,))))
                self.waiting.removeKey((start,))
                for at, i, post in waiting:
                    if topic_no >= per_topic or cycle_no >= per_cycle:
                        break
                    post_no, last = self.posts.getValue((post,)) if self.posts.containsKey((post,)) else (0, None)
                    if forget is not None and last is not None and last + forget < start:
                        post_no = 0
                    if post_no >= per_post:
                        continue
                    topic_no, cycle_no = topic_no + 1, cycle_no + 1
                    self.posts.updateValue((post,), (post_no + 1, at))
                    out.append((int(key[0]), post, i, at, start, post_no + 1, topic_no, cycle_no))
            if out:
                self.topic.update((topic_no,))
            if forget is not None:
                for (post,), (_, last) in list(self.posts.iterator()):
                    if last + forget < now - cycle:
                        self.posts.removeKey((post,))
            if out:
                yield pd.DataFrame(out, columns=columns)

    return Caps()


def capped(comments: DataFrame, per_post: int, per_topic: int, per_cycle: int, cycle: int,
           delay: str, forget: int | None = None) -> DataFrame:
    """A stream of (topic_id, post_id, comment_id, created_utc) -> the stored ones with their running numbers.

    ``cycle`` and ``forget`` are in seconds. Rows without a topic, post, id or time are left out.
    """
    spark = comments.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = comments.select("topic_id", "post_id", "comment_id", "created_utc").dropna()
    timed = rows.withColumn("event_time", F.timestamp_seconds("created_utc")).withWatermark("event_time", delay)
    return timed.groupBy("topic_id").transformWithStateInPandas(
        _processor(per_post, per_topic, per_cycle, cycle, forget), STORED, "Append", "EventTime")


def closing_row(spark: SparkSession, after: int) -> DataFrame:
    """A row whose time lets the watermark pass ``after``; appended to the input of a stream that ends."""
    return spark.range(1).select(F.lit(CLOSING_TOPIC).cast("long").alias("topic_id"), F.lit(0).cast("long").alias("post_id"),
                                 F.lit(0).cast("long").alias("comment_id"), F.lit(after).cast("long").alias("created_utc"))


def run_cycle_caps(stream: DataFrame, name: str, work: str | None = None, **caps) -> DataFrame:
    """Run ``capped`` over what has arrived, into an append-only table; the same ``work`` resumes."""
    return run_append(capped(stream, **caps), name, work)
