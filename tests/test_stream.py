"""The stream of events in batches, out of order, against the batch fold."""

import random

from pyspark.sql import functions as F

from tideline.functions import model
from tideline.operators import strength
from tideline.streaming.strength import stream_strength

COLS = "id string, seq long, op string, ts double, event_time timestamp, created double, rate double"


def test_batches_out_of_order_equal_the_batch_fold(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        ts = 86_400.0 * 10 + i * 1800.0
        rows.append((f"m{rng.randrange(12)}", i, rng.choice(["access"] * 8 + ["pin", "retire"]) if i > 150 else "access", ts))
    # Six batches; an event may come up to twenty hours after its successors.
    batches = [[] for _ in range(6)]
    for i, r in enumerate(rows):
        batches[min(5, (i + rng.randrange(40)) // 70)].append(r)
    assert any(a[3] > b[3] for x, y in zip(batches, batches[1:]) for a in x for b in y)
    for n, b in enumerate(batches):
        rng.shuffle(b)
        df = spark.createDataFrame([(i, q, o, t, 0.0, 0.03) for i, q, o, t in b], "id string, seq long, op string, ts double, created double, rate double")
        df.withColumn("event_time", F.timestamp_seconds("ts")).select(*[c.split()[0] for c in COLS.split(", ")]).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    raw = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    seen = []
    q = stream_strength(raw, "1 day").writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/check").foreachBatch(lambda b, i: seen.append([r.asDict() for r in b.collect()])).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for batch in seen:
        last |= {r["id"]: r for r in batch}
    assert len([b for b in seen if b]) >= 6
    now = 86_400.0 * 30
    m = spark.createDataFrame([(f"m{i}", "t", "general", 0.0) for i in range(12)], "id string, content string, category string, created double")
    want = {r["id"]: r for r in strength.fold(m, spark.createDataFrame([(q_, i, o, t) for i, q_, o, t in rows], "seq long, id string, op string, ts double"), now).collect()}
    assert set(last) == set(want)
    import math

    for i, w in want.items():
        s = 1.0 if last[i]["pinned"] else last[i]["score"] * math.exp(-0.03 * (now - last[i]["score_at"]) / model.DAY)
        assert abs(s - w["strength"]) < 1e-8 and last[i]["n_access"] == w["n_access"] and last[i]["retired"] == w["retired"], (i, last[i], w)
