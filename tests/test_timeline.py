"""Late rows in any order of arrival end in the batch result."""

import random
from collections import Counter

from stratalens.streaming import timeline

ROWS = "scope_key string, report_period string, source_id string, ordinal long, observation_id string, basis string"


def test_any_order_of_arrival_ends_in_the_batch_result(spark, tmp_path):
    rnd = random.Random(12)
    rows = [(f"s{rnd.randrange(4)}", f"2024-{rnd.randint(1, 9):02d}-01", f"src{rnd.randrange(3)}", rnd.randrange(20), f"o{i}", rnd.choice(["cusip=1", "cusip=1", "figi=2", ""])) for i in range(120)]
    rows += rows[:5]
    want = Counter({tuple(r): 1 for r in timeline.transitions(spark.createDataFrame(rows, ROWS)).collect()})
    assert len(want) > 20
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timeline.state_store(spark)
    try:
        rnd.shuffle(rows)
        for k in range(4):
            spark.createDataFrame(rows[k::4], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        got, batches = Counter(), []

        def take(df, epoch):
            found = [tuple(r) for r in df.collect()]
            batches.append(found)
            for r in found:
                got[r[:5]] += r[5]

        query = timeline.changes(stream).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert len([b for b in batches if b]) == 4 and any(r[5] == -1 for b in batches for r in b)
    assert {k: v for k, v in got.items() if v} == dict(want) and set(got.values()) <= {0, 1}
