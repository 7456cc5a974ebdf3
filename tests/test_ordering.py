"""Pages of a run are read until one has no valid card."""

from pyspark.sql import functions as F

from rolecall.operators import ordering


def test_pages_until_one_is_empty(spark):
    rows = [("a", p, i, True) for p in (0, 1, 3) for i in range(3)]      # page 2 is missing
    rows += [("b", 0, 0, False), ("b", 1, 1, True)]                      # the first page has no valid card
    rows += [("c", 0, 0, True), ("c", 1, 1, False), ("c", 1, 2, True), ("c", 2, 3, None), ("c", 3, 4, True)]
    rows += [(None, 0, 0, True)]
    cards = spark.createDataFrame(rows, "run string, page int, seq int, ok boolean")

    def read(first=0):
        return sorted((r.run, r.page, r.seq) for r in ordering.pages_until_empty(cards, "run", "page", F.col("ok"), first).collect())

    assert read() == [("a", p, i) for p in (0, 1) for i in range(3)] + [("c", 0, 0), ("c", 1, 2)]
    assert read(1) == [("a", 1, i) for i in range(3)] + [("b", 1, 1), ("c", 1, 2)]
    assert ordering.pages_until_empty(cards.where("false"), "run", "page", F.col("ok")).collect() == []
