"""Distinct molecules of a stream of reads, counted as they come."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Parts of a well: its molecules are dealt by hash, so that one well is several tasks' state.
PARTS = 16


class Counter(StatefulProcessor):
    """State of one part of a well: when each of its molecules was seen last, and how many there have been."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "tag string, gene string", "at long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[tuple[str, str], int] = {}
        for pdf in rows:
            for tag, gene, at in pdf.groupby(["tag", "gene"])["at"].max().reset_index().itertuples(index=False):
                newest[tag, gene] = max(int(at), newest.get((tag, gene), int(at)))
        n = self.count.get()[0] if self.count.exists() else 0
        watching = self.last.exists()
        for molecule, at in newest.items():
            known = self.last.getValue(molecule)
            n += known is None
            if known is None or at > known[0]:
                self.last.updateValue(molecule, (at,))
        self.count.update((n,))
        if newest and not watching:
            self.handle.registerTimer(min(newest.values()) + self.keep_ms)
        yield pd.DataFrame([[*key, n]], columns=["well", "part", "molecules"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Molecules that haven't been seen for so long are forgotten; the next timer is set for the oldest of the others."""
        now, oldest, gone = timerValues.getCurrentWatermarkInMs(), None, []
        for molecule, (at,) in self.last.iterator():
            if at + self.keep_ms <= now:
                gone.append(molecule)
            else:
                oldest = at if oldest is None else min(at, oldest)
        for molecule in gone:
            self.last.removeKey(molecule)
        if oldest is not None:
            self.handle.registerTimer(oldest + self.keep_ms)
        return iter([])

    def close(self) -> None:
        pass


def molecule_counts(reads: DataFrame, time: str, well: str, tag: str, gene: str, late: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """well, part and molecules so far, in update mode: a row for each part of a well that a batch has reads of. Sum the newest rows of its parts for a well's count.

    A molecule is a tag and gene of a well. Its key is kept until the watermark is `keep_ms` past its last read, then dropped: a read after that counts
    again. Reads later than the watermark are dropped by Spark, those with a null in well, tag, gene or time here. The state store must be PROVIDER.
    """
    # the processor is first made in a worker that doesn't get the files sent to executors, so it goes along with its code
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    names = {"well": well, "tag": tag, "gene": gene}
    rows = reads.withWatermark(time, late).select(time, *(F.col(c).cast("string").alias(n) for n, c in names.items()), F.unix_millis(time).alias("at")).na.drop()
    keyed = rows.withColumn("part", F.pmod(F.xxhash64("tag", "gene"), F.lit(PARTS)).cast("int"))
    return keyed.groupBy("well", "part").transformWithStateInPandas(Counter(keep_ms), "well string, part int, molecules long", "Update", "EventTime")


def totals(updates: DataFrame) -> DataFrame:
    """well and molecules, from all updates of molecule_counts() so far: counts only rise."""
    return updates.groupBy("well", "part").agg(F.max("molecules").alias("molecules")).groupBy("well").agg(F.sum("molecules").alias("molecules"))
