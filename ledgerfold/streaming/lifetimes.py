"""Leads that live as long as signals are seen, as keyed state with timers.

A lead is a (parcel, market, type); it is active while its newest signal is at most as old as its type allows. The state keeps the newest sighting and a timer
at the moment that it runs out. Time is the clock of the runs: each run sends a tick. Only ticks carry the event time, so that no
signal is ever late, however old it is: signals from before the lead, out of order or delivered twice give the same leads in the end.
Every change is a row of a log (times in microseconds) with the lead's version; the newest version is the lead.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEYS = ["parcel_number", "market", "signal_type"]
DAY = 86_400_000_000
LOG = "parcel_number string, market string, signal_type string, version bigint, status string, first_seen bigint, last_seen bigint, sightings bigint"
_LOGGED = Row(*[c.split()[0] for c in LOG.split(", ")])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Lifetimes(StatefulProcessor):
    """State of a lead: first and newest sighting (microseconds), sightings, version, whether it is active, and when its timer rings (milliseconds; null without one).

    A call to the state costs more than anything else here, so a lead is read once and written once, and has one timer at most: one that rings before the lead
    runs out, as it was seen since, is set anew then.
    """

    def __init__(self, days: dict[str, int]):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lead = handle.getValueState("lead", "first bigint, last bigint, sightings bigint, version bigint, active boolean, rings bigint")

    def _timer(self, kind: str, last: int) -> int:
        """The first millisecond at which the lead has run out."""
        at = (last + self.days[kind] * DAY) // 1000 + 1
        self.handle.registerTimer(at)
        return at

    def _row(self, key: tuple, first: int, last: int, sightings: int, version: int, active: bool, rings: int | None) -> Row:
        self.lead.update((first, last, sightings, version, active, rings))
        return _LOGGED(*key, version, "active" if active else "retired", first, last, sightings)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = [int(r["seen"]) for r in rows if r["seen"] is not None]
        if not seen:  # ticks
            return
        first, last, sightings, version, _, rings = self.lead.get() or (seen[0], seen[0], 0, 0, False, None)
        first, newest = min(first, *seen), max(last, *seen)
        lasts = self.days.get(key[2])
        now = timerValues.getCurrentWatermarkInMs() * 1000
        alive = lasts is not None and newest + lasts * DAY >= now
        if alive and rings is None:
            rings = self._timer(key[2], newest)
        yield self._row(key, first, newest, sightings + len(seen), version + 1, alive, rings)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, sightings, version, active, _ = self.lead.get()
        if active and last + self.days[key[2]] * DAY < timerValues.getCurrentWatermarkInMs() * 1000:
            yield self._row(key, first, last, sightings, version + 1, False, None)
        else:
            self.lead.update((first, last, sightings, version, active, self._timer(key[2], last) if active else None))

    def close(self) -> None:
        pass


def lead_log(stream: DataFrame, days: dict[str, int], *, seen: str = "last_seen_at", clock: str = "clock") -> DataFrame:
    """The log of changes of all leads in a stream of signals (parcel_number, market, signal_type, ``seen``) and ticks (``clock``, else null).

    ``days`` says how long a type lives; types that it leaves out are switched off, and their leads are retired from the start. Signals without a time or
    a key change nothing.
    """
    signal = F.col(clock).isNull() & F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull() & F.col(KEYS[2]).isNotNull()
    rows = stream.select(*KEYS, F.when(signal, F.unix_micros(F.col(seen).cast("timestamp"))).alias("seen"), F.col(clock).cast("timestamp").alias("clock")).withWatermark("clock", "0 seconds")
    return rows.groupBy(*KEYS).transformWithState(_Lifetimes(dict(days)), LOG, "append", "eventTime")


def run_lifetimes(stream: DataFrame, days: dict[str, int], log: str, checkpoint: str, **columns: str):
    """All that is there now, appended to the log as Parquet; start again to go on. The state is kept in RocksDB, so it may outgrow memory."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        return lead_log(stream, days, **columns).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def current_leads(log: DataFrame) -> DataFrame:
    """The newest version of each lead."""
    rest = [c for c in log.columns if c not in KEYS]
    return log.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*KEYS, "r.*").withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")})
