"""Late and out-of-order events: aggregates per period of happening, corrected up to a cut-off.

K-slack: an event is held in the buffer of its period until the lateness bound has passed, and released in order of
happening; `kslack` runs such buffers over the rows in order of arrival and says of each event whether it came in time,
as a correction of what had been published, or after its period was released. `period_aggregates` has the values
published when the grace ended (provisional) and the order-sensitive results of what was released (final).

Defined cases: events without either instant are left out; an event from the future of its arrival is in
time; ties of happening are ordered by row number; repeated rows count as often as given (see `dedup`);
empty input gives empty output; extra columns pass through `kslack`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from brindle.functions.instants import double_us
from brindle.operators.dedup import first_arrivals
from brindle.operators.timestamps import firehose_instants

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US


@dataclass(frozen=True)
class Slack:
    """period: length of a period; grace: arrival up to then is in time; cutoff: corrections up to then, inclusive."""

    period_us: int = HOUR_US
    grace_us: int = 10 * MINUTE_US
    cutoff_us: int = 24 * HOUR_US


class _Buffer:
    """The K-slack buffer of one task: batches in order of arrival in, released events in order of happening out.

    The clock is the arrival. When it passes the end of a period's grace, the period's provisional values are published
    from what is held; when it passes the cut-off, the held events are released, sorted. What comes for a period
    already released is too late and goes out at once. `flush` lets the remaining periods run out.
    """

    def __init__(self, slack: Slack, happened: str, arrived: str, publish: Sequence[str], fields: pa.Schema):
        self.slack, self.happened, self.arrived, self.publish, self.fields = slack, happened, arrived, list(publish), fields
        self.clock = -(1 << 63)
        self.timers: list[tuple[int, bool, int]] = []  # (due, whether it releases, period)
        self.known: set[int] = set()  # periods with timers still to run
        self.held: dict[int, list[pa.Table]] = {}
        self.out: list[pa.Table] = []
        self.size = 0

    def take(self, batch: pa.Table) -> None:
        """A batch sorted by arrival."""
        at = batch[self.arrived].to_numpy()
        happened = batch[self.happened].to_numpy()
        period = happened - happened % self.slack.period_us
        for p in np.unique(period).tolist():
            end = p + self.slack.period_us
            if p not in self.known and end + self.slack.cutoff_us >= self.clock:
                self.known.add(p)
                for due, releases in ((end + self.slack.grace_us, False), (end + self.slack.cutoff_us, True)):
                    if due >= self.clock:
                        heapq.heappush(self.timers, (due, releases, p))
        begin = 0
        while begin < len(at):
            # events up to and including the instant a timer is due come before it
            stop = int(np.searchsorted(at, self.timers[0][0], side="right")) if self.timers else len(at)
            if stop > begin:
                self._hold(batch.slice(begin, stop - begin), period[begin:stop], int(at[begin]))
                begin = stop
            else:
                self._fire()
        self.clock = max(self.clock, int(at[-1]))

    def flush(self) -> None:
        while self.timers:
            self._fire()

    def drained(self, least: int) -> list[pa.RecordBatch]:
        if self.size < least or not self.out:
            return []
        table, self.out, self.size = pa.concat_tables(self.out).combine_chunks(), [], 0
        return table.to_batches(max_chunksize=10_000)

    def _hold(self, rows: pa.Table, period: np.ndarray, clock: int) -> None:
        order = np.argsort(period, kind="stable")
        edges = np.flatnonzero(np.diff(period[order])) + 1
        for at in np.split(order, edges):
            p = int(period[at[0]])
            part = rows if len(at) == len(period) else rows.take(pa.array(at))
            if p not in self.known:
                self._emit(part, p, "too_late")
            else:
                corrects = clock > p + self.slack.period_us + self.slack.grace_us
                self.held.setdefault(p, []).append(part.append_column("__c", pa.array(np.full(len(at), corrects))))

    def _fire(self) -> None:
        due, releases, p = heapq.heappop(self.timers)
        self.clock = max(self.clock, due)
        if not releases:
            if self.publish and p in self.held:
                self._publish(p)
            return
        self.known.discard(p)
        if p in self.held:
            rows = pa.concat_tables(self.held.pop(p)).sort_by(self.happened)
            corrects = rows["__c"]
            self._emit(rows.drop_columns(["__c"]), p, pc.if_else(corrects, "correction", "in_time"))

    def _publish(self, p: int) -> None:
        rows = pa.concat_tables(self.held[p]).group_by(self.publish).aggregate([([], "count_all")])
        columns = [rows[f.name].cast(f.type) if f.name in self.publish else pa.nulls(len(rows), f.type) for f in self.fields]
        self._emit(pa.table(columns, schema=self.fields), p, "provisional", rows["count_all"].cast(pa.int64()))

    def _emit(self, rows: pa.Table, p: int, verdict, held=None) -> None:
        n = len(rows)
        released = p + self.slack.period_us + self.slack.cutoff_us
        verdicts = pa.array([verdict] * n, pa.string()) if isinstance(verdict, str) else verdict.cast(pa.string())
        rows = rows.append_column("period_us", pa.array(np.full(n, p, dtype=np.int64)))
        rows = rows.append_column("released_us", pa.array(np.full(n, released, dtype=np.int64))).append_column("verdict", verdicts)
        if self.publish:
            rows = rows.append_column("held", pa.nulls(n, pa.int64()) if held is None else held)
        self.out.append(rows)
        self.size += n


def kslack(
    events: DataFrame, slack: Slack = Slack(), happened: str = "happened_us", arrived: str = "arrived_us", publish: Sequence[str] = ()
) -> DataFrame:
    """events + period_us, released_us and verdict (in_time, correction, too_late), through K-slack buffers.

    Each task runs a buffer over its own rows in order of arrival, however they are spread: a period's grace and
    cut-off pass by the clock of arrivals, the same in all of them, and counts add up. A task holds the events of the
    periods not yet released at its clock. With `publish`, columns of the events, the buffers also give out what they
    hold of each period when its grace ends: rows of verdict `provisional` with these columns and their number in `held`.
    """
    rows = events.filter(F.col(happened).isNotNull() & F.col(arrived).isNotNull()).sortWithinPartitions(arrived)
    schema = StructType([*rows.schema.fields, StructField("period_us", LongType()), StructField("released_us", LongType()), StructField("verdict", StringType())])
    if publish:
        schema = schema.add("held", LongType())
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = None
        for batch in batches:
            if batch.num_rows:
                buffer = buffer or _Buffer(slack, happened, arrived, publish, batch.schema)
                buffer.take(pa.Table.from_batches([batch]))
                yield from buffer.drained(10_000)
        if buffer:
            buffer.flush()
            yield from buffer.drained(0)

    return rows.mapInArrow(run, schema)


def period_aggregates(
    events: DataFrame, by: list[str], order: str, slack: Slack = Slack(), happened: str = "happened_us", slices: int = 360
) -> DataFrame:
    """Per (*by, period): provisional and final counts and the order-sensitive results of the released events.

    provisional_n: what was published at the end of the grace (else the events in time); n: released in the end; corrections and too_late:
    counts; first_row, last_row: rows that happened first and last; longest_gap_us: longest time between successive
    events. Order is established within slices of a period, whose borders are then merged, so that no task sorts
    more than a slice; counts of repeated instants are folded before.
    """
    width = max(1, slack.period_us // slices)
    published = F.col("held") if "held" in events.columns else F.lit(None).cast("long")
    points = (
        events.withColumn("__held", published).groupBy(*by, "period_us", F.col(happened).alias("__at"), "verdict")
        .agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__low"), F.max(order).alias("__high"), F.sum("__held").alias("__held"))
        .withColumn("__slice", F.floor((F.col("__at") - F.col("period_us")) / width))
    )
    at = F.when(F.col("verdict").isin("in_time", "correction"), F.col("__at"))
    inside = Window.partitionBy(*by, "period_us", "__slice").orderBy(at.asc_nulls_first())
    sliced = (
        points.withColumn("__gap", F.greatest(at - F.lag(at).over(inside), F.when(at.isNotNull() & (F.col("__n") > 1), F.lit(0).cast("long"))))
        .groupBy(*by, "period_us", "__slice")
        .agg(
            F.sum("__held").alias("held"),
            F.sum(F.when(F.col("verdict") == "in_time", F.col("__n"))).alias("in_time"),
            F.sum(F.when(F.col("verdict") == "correction", F.col("__n"))).alias("correction"),
            F.sum(F.when(F.col("verdict") == "too_late", F.col("__n"))).alias("too_late"),
            F.min(F.when(at.isNotNull(), F.struct(at.alias("at"), F.col("__low").alias("row")))).alias("first"),
            F.max(F.when(at.isNotNull(), F.struct(at.alias("at"), F.col("__high").alias("row")))).alias("last"),
            F.max("__gap").alias("gap"),
        )
    )
    # slices with nothing released have no border; those before them carry theirs over
    along = Window.partitionBy(*by, "period_us").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    seam = F.col("first.at") - F.last("last.at", ignorenulls=True).over(along)
    return (
        sliced.withColumn("__seam", seam)
        .groupBy(*by, "period_us")
        .agg(
            F.coalesce(F.sum("held"), F.sum("in_time"), F.lit(0)).alias("provisional_n"),
            (F.coalesce(F.sum("in_time"), F.lit(0)) + F.coalesce(F.sum("correction"), F.lit(0))).alias("n"),
            F.coalesce(F.sum("correction"), F.lit(0)).alias("corrections"),
            F.coalesce(F.sum("too_late"), F.lit(0)).alias("too_late"),
            F.min("first").alias("__first"),
            F.max("last").alias("__last"),
            F.max(F.greatest("gap", "__seam")).alias("longest_gap_us"),
        )
        .withColumn("first_row", F.col("__first.row"))
        .withColumn("last_row", F.col("__last.row"))
        .drop("__first", "__last")
    )


# ---------------------------------------------------------------------------------------------
# the events of the two logs


def created_events(firehose: DataFrame, clients: DataFrame) -> DataFrame:
    """(src, row_id, happened_us, arrived_us) of the first copy of every create whose createdAt names an instant.

    Instants are settled before copies are folded, so that the fold carries two numbers and not the texts.
    """
    create = F.lower(F.trim(F.col("commit.operation"))) == "create"
    stamped = firehose_instants(firehose.filter((F.col("kind") == "commit") & create), clients)
    rows = stamped.select(
        F.lit("firehose").alias("src"),
        "did",
        F.col("commit.rev").alias("rev"),
        F.col("commit.collection").alias("collection"),
        F.col("commit.rkey").alias("rkey"),
        F.struct("row_id", F.col("created_us").alias("happened_us"), "arrived_us").alias("copy"),
    )
    first = first_arrivals(rows, ["src", "did", "rev", "collection", "rkey"], "copy")
    return first.select("src", "copy.*").filter(F.col("happened_us").isNotNull())


def reaction_events(reactions: DataFrame) -> DataFrame:
    """(src, row_id, happened_us, arrived_us) of the first copy of every reaction with a known time, numbered or not."""
    copy = F.struct(F.col("ordinal").alias("row_id"), double_us(F.col("timestamp")).alias("happened_us"), "arrived_us")
    numbered = F.col("msg_id").isNotNull()
    named = [F.when(numbered, F.col("shard")).alias("shard"), F.col("msg_id")]
    plain = [F.when(~numbered, F.col(c)).alias(c) for c in ("user_id", "post_id", "kind", "timestamp")]
    first = reactions.filter(F.col("timestamp") > 0).groupBy(*named, *plain).agg(F.min(copy).alias("copy"))
    return first.select(F.lit("reactions").alias("src"), "copy.*")


def late_rows(events: DataFrame, slack: Slack = Slack()) -> DataFrame:
    """(src, row_id, verdict) of the events that were not in time."""
    return kslack(events.select("src", "row_id", "happened_us", "arrived_us"), slack).filter(F.col("verdict") != "in_time").select("src", "row_id", "verdict")
