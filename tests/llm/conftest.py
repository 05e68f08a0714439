import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text) or (doc_id, text, source); extra columns have clashing names."""
    def make(rows):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "s", "en", 7, 1, "x") for r in rows]
        schema = T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
            T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            # names that the operators use inside
            T.StructField("n", T.IntegerType()), T.StructField("tag", T.StringType())])
        return spark.createDataFrame(rows, schema).repartition(3)
    return make


def prose(seed: int, n: int) -> str:
    """``n`` words that don't repeat in runs."""
    import random
    r = random.Random(seed)
    parts = ["ka", "lo", "mi", "ner", "os", "tu", "vel", "zi", "ba", "dre"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))
