"""A stream of reads in several batches against the whole table, and what is forgotten."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from strandloom.streaming import molecules

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def streamed(spark, tmp_path):
    """Feeds batches of (minute, well, tag, gene), one file each, and gives all updates with the state's rows after each batch."""
    before = spark.conf.get(molecules.PROVIDER[0], None)
    spark.conf.set(*molecules.PROVIDER)

    def run(batches, **settings):
        source, sink, schema = str(tmp_path / "in"), str(tmp_path / "out"), "ts timestamp, well string, tag string, gene string"
        kept = []
        for rows in batches:
            spark.createDataFrame([(None if m is None else START + datetime.timedelta(minutes=m), *r) for m, *r in rows], schema).coalesce(1).write.mode("append").parquet(source)
            stream = molecules.molecule_counts(spark.readStream.schema(schema).parquet(source), "ts", "well", "tag", "gene", **settings)
            query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(sink)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            query.awaitTermination()
            kept.append(sum(s.numRowsTotal for p in query.recentProgress[-1:] for s in p.stateOperators))
        return {r.well: r.molecules for r in molecules.totals(spark.read.parquet(sink)).collect()}, kept

    yield run
    spark.conf.unset(molecules.PROVIDER[0]) if before is None else spark.conf.set(molecules.PROVIDER[0], before)


def test_three_batches_give_the_answer_of_the_whole(streamed):
    draw = random.Random(1)
    rows = [(draw.randint(0, 5), draw.choice(["W1", "W1", "W2"]), draw.choice("ACGT") + draw.choice("ACGT"), draw.choice(["g", "h"])) for _ in range(120)]
    rows += [(1, None, "AA", "g"), (1, "W1", None, "g"), (None, "W1", "AC", "zz")]
    want = {}
    for m, w, t, g in rows:
        if None not in (m, w, t, g):
            want.setdefault(w, set()).add((t, g))
    got, _ = streamed([rows[:50], rows[50:90], rows[90:]])
    assert got == {w: len(s) for w, s in want.items()}


def test_molecules_not_seen_for_long_are_forgotten(streamed):
    first = [(i, "W1", f"T{i}", "g") for i in range(5)]
    later = [(600, "W1", "new", "g")]
    again = [(700, "W1", "T1", "g"), (700, "W1", "new", "g")]
    got, kept = streamed([first, later, later, again], late="1 minute", keep_ms=3_600_000)
    assert got == {"W1": 5 + 1 + 1}  # T1 counts again, the other was seen too lately
    assert kept[-1] < kept[0]
