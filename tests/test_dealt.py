"""Keys that hardly repeat are dealt before they are counted: where rows are read, counting them would hold nearly all in memory."""

import itertools
import re

from pyspark.sql import functions as F

from tessera.functions import untrusted as U
from tessera.operators import identity


def counted_where_read(df, *keys):
    """Aggregates by keys that stand on something else than an exchange."""
    lines = [re.sub(r"^[\s:+\-*()\d]*", "", x) for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    by = r"\w*Aggregate\(keys?=\[" + ", ".join(rf"{k}#\d+L?" for k in keys) + r"\]"
    found = [(a, b) for a, b in itertools.pairwise(lines) if re.match(by, a)]
    assert found
    return [a for a, b in found if not re.match(r"(\w*Aggregate|Exchange|Sort|ShuffleQueryStage|AQEShuffleRead)\b", b)]


def test_ids_of_a_cover(spark):
    items = spark.createDataFrame([("d1", 1), ("d1", 1), ("d1", 2), ("d1", 3), ("d2", 1), ("d3", None), (None, 4)], "date string, id long")
    found = spark.createDataFrame([("d1", [1, 1]), ("d1", [3, 9]), ("d2", [1]), ("d3", [None]), (None, [4, 4])], "date string, ids array<long>")
    out = U.uncovered(found, items)
    assert sorted(map(tuple, out.collect()), key=repr) == [("d1", 1, 1), ("d3", 1, 0), (None, 1, 0)]
    assert not counted_where_read(out, "date", "id")


def test_keys_on_several_dates(spark):
    rows = [
        (1, "a", "2024-01-01"), (1, "a", "2024-01-02"), (1, "a", "2024-01-02"),  # strong, all of a's cards are its
        (2, "b", "2024-01-01"), (None, "b", "2024-01-02"), (2, "x", "2024-01-05"),  # strong elsewhere; b has a card without
        (3, "c", "2024-01-01"), (4, "c", "2024-01-02"),  # two strong keys
        (None, "d", "2024-01-01"), (None, "d", "2024-01-03"), (5, "e", "2024-01-01"), (5, "e", "2024-01-01"), (None, "f", "2024-01-01"), (None, "f", None), (None, None, "2024-01-01"), (None, None, "2024-01-02"),
    ]
    card = spark.createDataFrame(rows, "nct long, acronym string, date string").withColumn("date", F.to_date("date"))
    out = identity.cross_date_duplicates(card.withColumn("k", F.col("nct").cast("string")).drop("nct").withColumnRenamed("k", "nct"))
    assert sorted((r.kind, r.key, r.dates, r.cards, str(r.latest)) for r in out.collect()) == [("acronym", "b", 2, 2, "2024-01-02"), ("acronym", "d", 2, 2, "2024-01-03"), ("nct", "1", 2, 3, "2024-01-02"), ("nct", "2", 2, 2, "2024-01-05")]
    assert not counted_where_read(out, "nct", "date") and not counted_where_read(out, "acronym", "date")
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
