import pytest

#: Columns whose names an operator might use itself.
CLASH = ["score", "cls", "sig", "ids", "shard", "slot", "size", "t", "h", "n_words", "pii", "label", "group", "least"]


@pytest.fixture(scope="session")
def documents(spark):
    """Documents frame from texts or (id, text) rows, with columns of clashing names and nulls beside them."""

    def make(rows):
        from pyspark.sql import functions as F

        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}", None if t is None or k % 5 == 4 else len(t)) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
