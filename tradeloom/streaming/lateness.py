"""Counts by event-time period that late records correct up to a cut-off, as two layers over one log (lambda views).

The fast layer adds the records of each micro-batch to provisional counts, as increments. The batch layer runs at set times: it recomputes
every period that is still open from the log, replaces what the fast layer had and freezes periods past their cut-off, which are never
read again. Served are frozen periods, the last recomputation of open ones, and the increments of the micro-batches that it hasn't seen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Commits
from ..session import broadcast_up_to, scratch, stored

#: The fixed values of the catalogue feed: periods are UTC days, records correct them for 72 hours after their end.
LATENESS_HOURS = 72
#: Periods and slices of up to so many rows are broadcast.
BROADCAST_ROWS = 500_000

LOG = "record string, grp string, arrival timestamp_ntz, period date, batch long"
FAST = "grp string, period date, added long, batch long"
VIEW = "grp string, period date, on_time long, records long, too_late long, closed_through long, frozen_through long"
REFUSED = "grp string, period date, refused long"
DAY = dt.timedelta(days=1)


class LambdaViews:
    """The two layers, their tables under path. Which micro-batches each batch run has seen is a commit there, so that views can be opened again.

    A record belongs to the UTC day of its event time. Records without event time or arrival belong to no period. A null group is a group
    of its own; repeated rows count each; columns of other names don't matter. An increment, like its part of the log, is written by micro-batch
    id: a micro-batch that runs again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, by: str = "source_id", key: str = "id", event_time: str = "source_updated_at", arrival: str = "received_at", lateness_hours: int = LATENESS_HOURS) -> None:
        self.spark, self.by, self.path = spark, by, path or scratch(spark, "views")
        self.columns, self.lateness = (key, by, event_time, arrival), dt.timedelta(hours=lateness_hours)
        self.commits = Commits(spark, self.path)

    # --- state

    @property
    def runs(self) -> list[tuple[dt.datetime, int]]:
        """Each batch run: its time, and the last micro-batch it has seen."""
        return [(dt.datetime.fromisoformat(at), through) for at, through in self.commits.last()[1].get("runs", [])]

    def _commit(self, number: int, runs: list[tuple[dt.datetime, int]], views: list[str], replayed: int) -> None:
        if not self.commits.make(number + 1, {"runs": [(at.isoformat(), through) for at, through in runs], "views": views, "replayed": replayed}):
            raise RuntimeError(f"another batch run has published to {self.path}")

    def _closed_until(self, at: dt.datetime) -> dt.date:
        """The last period that has ended at an instant."""
        return at.date() - DAY

    def _frozen_until(self, at: dt.datetime) -> dt.date:
        """The last period that is past its cut-off at an instant."""
        return (at - self.lateness).date() - DAY

    def _cut_off(self) -> Column:
        return F.date_add("period", 1).cast("timestamp_ntz") + F.lit(self.lateness)

    def _table(self, kind: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{kind}/{n}" for n in self.commits.folder.names(kind)]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._table("log", LOG)

    def increments(self) -> DataFrame:
        """The fast layer: what each micro-batch adds to each period."""
        return self._table("fast", FAST)

    # --- the fast layer

    def _rows(self, arrived: DataFrame, batch: Column) -> DataFrame:
        key, by, event_time, arrival = (F.col(c) for c in self.columns)
        own = arrived.select(key.cast("string").alias("record"), by.cast("string").alias("grp"), arrival.cast("timestamp_ntz").alias("arrival"), F.to_date(event_time).alias("period"))
        return own.dropna(subset=["arrival", "period"]).withColumn("batch", batch)

    def _add(self, rows: DataFrame, part: str) -> None:
        """Append to the log, sorted by period so that scans of open periods skip the rest, and add the increments."""
        rows.sortWithinPartitions("period").write.mode("overwrite").parquet(f"{self.path}/log/{part}")
        own = self.spark.read.schema(LOG).parquet(f"{self.path}/log/{part}")
        fast = own.filter(F.col("arrival") < self._cut_off()).groupBy("grp", "period", "batch").agg(F.count("*").alias("added"))
        fast.write.mode("overwrite").parquet(f"{self.path}/fast/{part}")

    def on_micro_batch(self, arrived: DataFrame, batch_id: int) -> None:
        """For writeStream.foreachBatch. Micro-batches of a stream are numbered on from those of a log that was replayed before."""
        number = self.commits.last()[1].get("replayed", 0) + batch_id
        self._add(self._rows(arrived, F.lit(number).cast("long")), f"batch-{number:012d}")

    # --- the batch layer

    def run_batch(self, run_at: dt.datetime) -> None:
        """Recompute open periods from the log as far as it has come, and freeze those past their cut-off. A record that comes for a period
        frozen before is refused, whenever it arrived."""
        number, state = self.commits.last()
        runs, views = self.runs, state.get("views", [])
        through = max([int(n.removeprefix("batch-")) for n in self.commits.folder.names("fast") if n.startswith("batch-")] + [t for _, t in runs], default=-1)
        own = self.log().filter(F.col("batch") <= through)
        name = f"run-{number + 1:012d}"
        before = self.spark.createDataFrame([], VIEW)
        if runs:
            last_at, last_through = runs[-1]
            frozen = self._frozen_until(last_at)
            late = own.filter((F.col("period") <= F.lit(frozen)) & (F.col("batch") > last_through))
            late.groupBy("grp", "period").agg(F.count("*").alias("refused")).write.mode("overwrite").parquet(f"{self.path}/refused/{name}")
            own = own.filter(F.col("period") > F.lit(frozen))
            before = self._open_view(views)
        in_time = F.col("arrival") < self._cut_off()
        new = own.groupBy("grp", "period").agg(F.count_if(in_time).alias("records"), F.count_if(~in_time).alias("too_late"))
        old = before.select(F.col("grp").alias("_grp"), F.col("period").alias("_period"), F.col("on_time").alias("_on_time"))
        new = self._with_runs(new, [*runs, (run_at, through)]).join(old, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("period") == F.col("_period")), "left")
        # a period that an earlier run has closed keeps the provisional count it had then; a group which that run hadn't seen had none
        on_time = F.when(F.col("closed_through") < through, F.coalesce("_on_time", F.lit(0))).otherwise(F.col("records"))
        new = new.select("grp", "period", on_time.alias("on_time"), "records", "too_late", "closed_through", "frozen_through")
        new.write.mode("overwrite").parquet(f"{self.path}/view/{name}")
        self._commit(number, [*runs, (run_at, through)], [*views, name], state.get("replayed", 0))

    def _open_view(self, views: list[str]) -> DataFrame:
        return self.spark.read.schema(VIEW).parquet(f"{self.path}/view/{views[-1]}").filter("frozen_through is null")

    def _frozen_view(self, views: list[str]) -> DataFrame:
        return self.spark.read.schema(VIEW).parquet(*[f"{self.path}/view/{v}" for v in views]).filter("frozen_through is not null")

    def batch_view(self) -> DataFrame:
        """The batch layer: frozen periods of all runs, and open ones of the last run."""
        views = self.commits.last()[1].get("views", [])
        return self._frozen_view(views).unionByName(self._open_view(views)) if views else self.spark.createDataFrame([], VIEW)

    def replay(self, past: DataFrame) -> None:
        """A log of the past, as if it had come in micro-batches of a UTC day of arrival and the batch layer had run at each midnight. The views must
        be new. All runs are computed together: a period's row is that of the run that froze it, or of the last.
        The first run is at the midnight before all arrivals; periods past their cut-off by then are frozen empty.
        """
        if self.commits.last()[0]:
            raise ValueError("only new views can replay a log")
        first, last = past.select(F.col(self.columns[3]).cast("timestamp_ntz").alias("a")).agg(F.min("a"), F.max("a")).first()
        day_0 = first.date() if first else dt.date(1970, 1, 1)
        days = (last.date() - day_0).days + 1 if first else 0
        runs = [(dt.datetime.combine(day_0, dt.time()) + k * DAY, k - 1) for k in range(days + 1)]
        self._add(self._rows(past, F.date_diff(F.to_date("arrival"), F.lit(day_0)).cast("long")), "replay")
        frozen = F.col("frozen_through")
        counted = (F.col("arrival") < self._cut_off()) & (frozen.isNull() | (F.col("batch") <= frozen))
        recomputed = self._with_runs(self.log(), runs).groupBy("grp", "period", "closed_through", "frozen_through").agg(F.count_if(counted).alias("records"), F.count_if(~counted).alias("too_late"))
        on_time = F.col("closed_through").isNull() | (F.col("batch") <= F.col("closed_through"))
        provisional = self._with_runs(self.increments(), runs).filter(on_time).groupBy("grp", "period").agg(F.sum("added").alias("on_time"))
        provisional = provisional.select(F.col("grp").alias("_grp"), F.col("period").alias("_period"), "on_time")
        both = recomputed.join(provisional, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("period") == F.col("_period")), "left")
        view = both.select("grp", "period", F.coalesce("on_time", F.lit(0)).alias("on_time"), "records", "too_late", "closed_through", "frozen_through")
        view.write.parquet(f"{self.path}/view/replay")
        self._commit(0, runs, ["replay"], days)

    def _with_runs(self, df: DataFrame, runs: list[tuple[dt.datetime, int]]) -> DataFrame:
        """df (with period) with closed_through and frozen_through: what the first run after the period's end, and the first after its cut-off, had seen."""
        if not runs:
            return df.withColumns({c: F.lit(None).cast("long") for c in ("closed_through", "frozen_through")})
        closed = [(self._closed_until(at), t) for at, t in runs]
        frozen = [(self._frozen_until(at), t) for at, t in runs]
        low, high = frozen[0][0], closed[-1][0] + DAY
        rows, c, f = [], 0, 0
        for k in range((high - low).days + 1):  # a row for each day of the views' life
            day = low + k * DAY
            while c < len(closed) and closed[c][0] < day:
                c += 1
            while f < len(frozen) and frozen[f][0] < day:
                f += 1
            rows.append((day, closed[c][1] if c < len(closed) else None, frozen[f][1] if f < len(frozen) else None))
        calendar = self.spark.createDataFrame(rows, "_day date, closed_through long, frozen_through long")
        day = F.greatest(F.lit(low), F.least(F.lit(high), F.col("period")))
        return df.join(F.broadcast(calendar), day == F.col("_day")).drop("_day")

    # --- what is served

    def serve(self) -> DataFrame:
        """by, period, on_time, corrections, records, too_late, frozen, as known now: on_time is the provisional count when the period ended (so
        far, if it hasn't), corrections what later runs and increments added, records their sum, too_late the records that are refused."""
        runs = self.runs
        names = ["grp", "period"]
        zero = F.lit(0).cast("long")
        fresh, first = self.increments(), F.col("added")
        if runs:
            at, through = runs[-1]
            fresh = fresh.filter((F.col("batch") > through) & (F.col("period") > F.lit(self._frozen_until(at))))
            first = F.when(F.col("period") > F.lit(self._closed_until(at)), F.col("added")).otherwise(zero)
        old = self.batch_view().select(*names, "on_time", "records", "too_late", F.col("frozen_through").isNotNull().alias("frozen"))
        added = fresh.select(*names, first.alias("on_time"), F.col("added").alias("records"), zero.alias("too_late"), F.lit(False).alias("frozen"))
        refused = self._table("refused", REFUSED).select(*names, zero.alias("on_time"), zero.alias("records"), F.col("refused").alias("too_late"), F.lit(True).alias("frozen"))
        g = old.unionByName(added).unionByName(refused).groupBy(*names).agg(F.sum("on_time").alias("on_time"), F.sum("records").alias("records"), F.sum("too_late").alias("too_late"), F.max("frozen").alias("frozen"))
        return g.select(F.col("grp").alias(self.by), "period", "on_time", (F.col("records") - F.col("on_time")).alias("corrections"), "records", "too_late", "frozen")

    def decisions(self) -> DataFrame:
        """raw_record_id, verdict of each record of the log, by comparing the layers: `provisional` if the fast layer had added its micro-batch's slice of
        its period when the period was closed, `corrects` if a later run before the freeze took the slice in, `too_late` if neither layer has."""
        view = self.batch_view().select(F.col("grp").alias("_grp"), F.col("period").alias("_period"), F.col("closed_through").alias("_closed"), F.col("frozen_through").alias("_frozen"))
        # a group that the batch layer hasn't met yet is judged by the runs alone
        fast = self._with_runs(self.increments().select("grp", "period", "batch"), self.runs)
        slices = fast.join(view, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("period") == F.col("_period")), "left")
        closed, frozen = F.coalesce("_closed", "closed_through"), F.coalesce("_frozen", "frozen_through")
        status = F.when(closed.isNull() | (F.col("batch") <= closed), "provisional").when(frozen.isNull() | (F.col("batch") <= frozen), "corrects").otherwise("too_late")
        slices = slices.select(F.col("grp").alias("_grp"), F.col("period").alias("_period"), F.col("batch").alias("_batch"), status.alias("status"))
        slices = broadcast_up_to(stored(slices, "slices"), BROADCAST_ROWS)
        same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("period") == F.col("_period")) & (F.col("batch") == F.col("_batch")) & (F.col("arrival") < self._cut_off())
        return self.log().join(slices, same, "left").select(F.col("record").alias("raw_record_id"), F.coalesce("status", F.lit("too_late")).alias("verdict"))
