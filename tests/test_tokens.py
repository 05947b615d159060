from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators import messages


def test_counts_by_a_tokenizer_or_without_one(spark):
    def words():
        def count(x):
            if "bad" in x:
                raise ValueError("no")
            return len(x.split())

        return count

    def missing():
        raise ImportError("none here")

    rows = spark.createDataFrame([(0, "user", "a b c"), (1, "user", "bad \U0001f600 text"), (2, "user", None), (3, None, "")], "id long, role string, content string").withColumn("m", text.message_text("role", "content"))
    got = {r.id: r for r in rows.select("id", messages.token_counter(words)("m").alias("n"), messages.token_counter(missing)("m").alias("f"), text.fallback_tokens("m").alias("want"), F.lit(1)).collect()}
    assert [got[i].n for i in range(4)] == [4, got[1].want, 1, 0]
    assert all(r.f == r.want for r in got.values())
