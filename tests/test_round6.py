"""Cases of larger tables: what a Python worker gets at a time."""

from pyspark.sql import functions as F

from packetlens.llm.common import BATCH_BYTES, map_batches, record_batch


def test_workers_get_texts_in_small_batches(spark):
    """A batch held up to 10,000 texts or 64 MB."""
    import numpy as np

    def make():
        def each(batch):
            yield record_batch(rows=np.array([batch.num_rows]), size=np.array([batch.nbytes]))

        return each

    docs = spark.range(3000).repartition(1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    got = map_batches(docs, make, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 3000 and max(r.size for r in got) < 2 * BATCH_BYTES < 30_000_000
