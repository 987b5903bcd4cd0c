"""Admission in streams: state holds the keys that got in, so it never grows beyond the limits.

A processor for each harvest and combined key looks at the rows of a micro-batch in order of arrival. The first services and
groups that fit are remembered (ids only); all other rows are marked for the overflow of their service, or of the whole key.
What is marked the same adds up in the windowed aggregation that follows, which so keeps a row for each admitted group and
histogram bucket, and one sum and sketch for each overflow bucket. A timer forgets a harvest's keys when it is over.

The keys of a combined key are admitted by one task, as their order decides; partitions divide a large tenant. That task holds
each key of a micro-batch once, as ids, and a frame of rows; the rows wait in a temporary file until all keys have been seen. So
a trigger's keys bound its memory, and not its rows. Rows that no limit can turn away do not pass the processor.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import UNLIMITED, Limits
from ..operators.limits import IN_GROUP, OF_ALL, OF_SERVICE, Distinct
from ..operators.rows import CODES, PRESENCE, columns, with_ids

#: Ids that admission looks at; the rest of a row passes by as text.
IDS = ("sid1", "sid2", "gid1", "gid2", "cgid1", "cgid2")
_SPAN = CODES["service_destination"]
#: Columns that wait in a file, and how much of it stays in memory.
WAITING = pa.schema([("clock", pa.timestamp("ns")), ("code", pa.int32()), ("over", pa.bool_()), ("named", pa.bool_()), *[(c, pa.int64()) for c in IDS[:4]], ("row", pa.large_string())])
HELD_BYTES = 8 << 20


class Admitted:
    """Services and groups that got in, under the limits of one combined key; what has no limit is let in without being remembered."""

    def __init__(self, limits: Limits):
        self.max_services = limits.max_services
        self.limits = {code: limits.of(m) for m, code in CODES.items()}
        self.free = {code for code, both in self.limits.items() if min(both) >= UNLIMITED} | ({PRESENCE} if self.max_services >= UNLIMITED else set())
        self.services, self.groups = set(), {code: set() for code in CODES.values()}
        self.total, self.own, self.new = Counter(), Counter(), []

    def put(self, code: int, key: tuple[int, int], service: tuple[int, int]) -> None:
        """A key that is in already, as state has it."""
        if code == PRESENCE:
            self.services.add(key)
        else:
            self.groups[code].add(key)
            self.total[code] += 1
            self.own[code, service] += 1

    def _let_in(self, code: int, key, service) -> None:
        self.put(code, key, service)
        self.new.append((code, key, service))

    def knows(self, service: tuple[int, int]) -> bool:
        return PRESENCE in self.free or service in self.services

    def service(self, key: tuple[int, int]) -> bool:
        if PRESENCE in self.free:
            return True
        if key not in self.services and len(self.services) < self.max_services:
            self._let_in(PRESENCE, key, key)
        return key in self.services

    def group(self, code: int, key, nameless, service) -> tuple[int, bool]:
        """(place, whether its span's name is blanked) of a group of an admitted service."""
        if code in self.free:
            return IN_GROUP, False
        groups, (total, per_service) = self.groups[code], self.limits[code]
        if key in groups:
            return IN_GROUP, False
        blanked = code == _SPAN and self.own[code, service] >= per_service // 2
        if blanked:
            key = nameless
            if key in groups:
                return IN_GROUP, True
        if self.total[code] >= total or self.own[code, service] >= per_service:
            return OF_SERVICE, False
        self._let_in(code, key, service)
        return IN_GROUP, blanked


class Firsts:
    """Each key of the frames put in, once, by its first arrival."""

    #: Rows that gather before keys are told apart anew.
    LEAST = 1 << 16

    def __init__(self, by: list[str], columns: list[str]):
        self.by, self.columns = by, columns
        self.parts, self.rows, self.most = [], 0, self.LEAST

    def put(self, rows: pd.DataFrame) -> None:
        own = self._told(rows[["first", *self.columns]])
        self.parts.append(own)
        self.rows += len(own)
        if self.rows > self.most:
            self.parts = [self.all()]
            self.rows = len(self.parts[0])
            self.most = max(self.LEAST, 2 * self.rows)

    def _told(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["first", *self.by]).drop_duplicates(self.columns if len(self.columns) == 2 else ["code", *self.by])

    def all(self) -> pd.DataFrame:
        return self._told(pd.concat(self.parts, ignore_index=True)) if self.parts else pd.DataFrame(columns=["first", *self.columns], dtype="int64")

    def __iter__(self) -> Iterator[tuple]:
        """Values of `columns` of each key, in order of arrival."""
        rows = self.all()
        for lo in range(0, len(rows), self.LEAST):
            yield from zip(*[rows[c].iloc[lo : lo + self.LEAST].tolist() for c in self.columns])


class Places:
    """What becomes of the rows of a micro-batch. All frames are seen first, then keys are let in by their arrival, then rows are placed."""

    def __init__(self, admitted: Admitted):
        self.admitted, self.found = admitted, {}
        self.services, self.groups = Firsts(["sid1", "sid2"], ["sid1", "sid2"]), Firsts(["gid1", "gid2"], ["code", *IDS])

    def see(self, rows: pd.DataFrame) -> None:
        fresh = rows[~rows["over"]]
        if PRESENCE not in self.admitted.free:
            self.services.put(fresh[fresh["named"]])
        self.groups.put(fresh[fresh["code"].isin(set(self.admitted.groups) - self.admitted.free)])

    def let_in(self) -> None:
        """Lets in what fits, in order of `first`; remembers places other than the overflow of a service."""
        admitted = self.admitted
        for key in self.services:
            admitted.service(key)
        for code, s1, s2, g1, g2, c1, c2 in self.groups:
            if admitted.knows((s1, s2)):
                place = admitted.group(code, (g1, g2), (c1, c2), (s1, s2))
                if place[0] != OF_SERVICE:
                    self.found[code, g1, g2] = place
        self.services = self.groups = None

    def of(self, rows: pd.DataFrame) -> tuple[list[int], list[bool]]:
        """Place of every row, and whether its span's name is blanked."""
        admitted, found, where, blank = self.admitted, self.found, [], []
        for code, over, named, s1, s2, g1, g2 in zip(*[rows[c].tolist() for c in ("code", "over", "named", "sid1", "sid2", "gid1", "gid2")]):
            known = named and admitted.knows((s1, s2))
            if over:
                place, blanked = OF_SERVICE if known else OF_ALL, False
            elif known and code in admitted.groups and code not in admitted.free:
                place, blanked = found.get((code, g1, g2), (OF_SERVICE, False))
            else:
                place, blanked = IN_GROUP if known or not named else OF_ALL, False
            where.append(place)
            blank.append(blanked)
        return where, blank


def waiting(frames: Iterable[pd.DataFrame], see, ready) -> Iterator[pd.DataFrame]:
    """The frames again, once all were seen and ready() was called; meanwhile they are in a temporary file of the task."""
    with tempfile.SpooledTemporaryFile(HELD_BYTES) as file:
        with pa.ipc.new_stream(file, WAITING, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for frame in frames:
                see(frame)
                out.write_batch(pa.RecordBatch.from_pandas(frame, WAITING, preserve_index=False))
        ready()
        file.seek(0)
        for batch in pa.ipc.open_stream(file):
            yield batch.to_pandas()


class Admission(StatefulProcessor):
    """Rows in, the same rows with place and blanked out; state: the ids of what got in."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("admitted", "code int, id1 long, id2 long", "sid1 long, sid2 long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        admitted, some = Admitted(self.limits), False
        for (code, *own), service in self.state.iterator():
            admitted.put(code, tuple(own), tuple(service))
            some = True
        if not some:
            self.handle.registerTimer(int(key[0]))
        places = Places(admitted)

        def ready() -> None:
            places.let_in()
            for code, own, service in admitted.new:
                self.state.updateValue((code, *own), service)

        for f in waiting(rows, places.see, ready):
            where, blank = places.of(f)
            yield pd.DataFrame({"clock": f["clock"], "place": where, "blanked": blank, "key1": f["gid1"].where(f["code"] != PRESENCE, f["sid1"]), "row": f["row"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def never_turned_away(limits: Limits) -> Column:
    """Whether no limit can turn a row away: neither its service's nor its own."""
    limited = Admitted(limits)
    if PRESENCE not in limited.free:
        return F.lit(False)
    return ~F.col("over") & ~F.col("code").isin([code for code in CODES.values() if code not in limited.free])


def admitted_rows(rows: DataFrame, limits: Limits, distinct: Distinct) -> DataFrame:
    """Rows of the long table with clock, as they come, with `place` and `key1`, an id of the key that a row stands for.

    rows carry `ends_ms`, when their harvest ends. Service and group columns are empty where a row stands for others.
    """
    kinds = columns(distinct)
    times = [c for c, k in kinds.items() if k == "timestamp"]
    free = never_turned_away(limits)
    rest = rows if PRESENCE not in Admitted(limits).free else rows.filter(~free | F.col("clock").isNull())  # the clock keeps conditions above the watermark, which ticks must reach
    told = with_ids(rest).withColumn("named", F.col("svc_name").isNotNull())
    packed = F.to_json(F.struct(*[(F.unix_micros(c) if c in times else F.col(c)).alias(c) for c in kinds]))
    told = told.select("ends_ms", F.coalesce(F.unix_micros("processing_time"), F.lit(0)).alias("bucket_us"), "cm_id", F.coalesce("partition_id", F.lit(0)).alias("partition_id"), "clock", "code", "over", "named", F.coalesce("first", F.lit(0)).alias("first"), *IDS, packed.alias("row"))
    marked = told.groupBy("ends_ms", "bucket_us", "cm_id", "partition_id").transformWithStateInPandas(Admission(limits), "clock timestamp, place int, blanked boolean, key1 long, row string", "Append", "EventTime", eventTimeColumnName="clock")
    ddl = ", ".join(f"{c} {'bigint' if c in times else k}" for c, k in kinds.items())
    out = marked.withColumn("r", F.from_json("row", ddl)).select("clock", "place", "blanked", "key1", "r.*")
    out = out.withColumns({c: F.timestamp_micros(c) for c in times} | {"span_name": F.when(F.col("blanked"), F.lit("")).otherwise(F.col("span_name"))}).drop("blanked")
    if PRESENCE not in Admitted(limits).free:
        return out
    passed = rows.filter(free | F.col("clock").isNull()).select("clock", F.lit(IN_GROUP).alias("place"), F.lit(None).cast("long").alias("key1"), *kinds)
    return out.unionByName(passed)
