"""The exact split has the members of the seeded shuffle at every size."""

import random

from emberlog.operators import training


def test_members_beyond_the_literal(spark, monkeypatch):
    n = 150_000  # three blocks
    order = list(range(n))
    random.Random(42).shuffle(order)
    want = set(order[: training.test_count(n, 0.2)])
    for name in ("LITERAL_ROWS", "MAX_EXACT"):
        monkeypatch.setattr(training, name, 1000, raising=False)
    made = training.with_split(spark.range(n).withColumnRenamed("id", "source_index"), 0.2, 42)
    assert made.columns == ["source_index", "split"] and made.count() == n
    assert {r.source_index for r in made.where("split = 'test'").collect()} == want
