import random

import pytest

from sievelight.operators import tasks
from sievelight.streaming import requests

SCHEMA = "idempotency_key string, seq long, outcome string, usd double"


def events():
    rng = random.Random(3)
    rows = []
    for k in range(40):
        own = [(f"k{k}", 0, "intent", None)] + [(f"k{k}", s, rng.choice(["submitted", "done", "rejected"]), float(10 * k + s)) for s in range(1, rng.randrange(1, 5))]
        rows += own + own[-1:]  # the last one arrives twice
    rows.append(("never", 1, "done", 1.0))
    rng.shuffle(rows)
    return rows


def test_folding_is_the_batch(spark):
    rows = [r for r in dict.fromkeys(events()) if r[2] != "intent"]
    keys = sorted({r[0] for r in events() if r[2] == "intent"})
    held = spark.createDataFrame([(k, tasks.RESERVED) for k in keys], "idempotency_key string, state int")
    batch = {r.idempotency_key: (r.next, r.cost_usd) for r in tasks.settle(held, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert batch == {k: requests.folded([r[1:] for r in rows if r[0] == k]) for k in keys}


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in requests.PROVIDER}
    for k, v in requests.PROVIDER.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_a_stream_in_any_order_with_a_restart(rocks, tmp_path):
    spark, rows = rocks, events()
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"

    def put(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = requests.request_changes(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    third = len(rows) // 3
    for k in range(3):  # the query ends and starts again from its checkpoint each time
        part = rows[k * third : (k + 1) * third if k < 2 else None]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    last = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r.batch):
        last[r.idempotency_key] = (r.state, r.cost_usd)
    known = [r for r in dict.fromkeys(rows) if r[2] != "intent"]
    assert last == {k: requests.folded([r[1:] for r in known if r[0] == k]) for k in {r[0] for r in rows if r[2] == "intent"}}


def test_expiry(rocks, tmp_path):
    spark = rocks
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("a", 0, "intent", None), ("b", 0, "intent", None), ("b", 1, "submitted", 1.0)], SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)

    def put(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = requests.request_changes(stream, expires_ms=1).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            q.awaitTermination(1)
            try:
                got = {(r.idempotency_key, r.state, r.reason) for r in spark.read.parquet(out).collect()}
            except Exception:
                got = set()
            if ("a", tasks.RELEASED, "expired") in got:
                break
    finally:
        q.stop()
    assert got == {("a", tasks.RESERVED, "intent"), ("b", tasks.SUBMITTED, "outcome"), ("a", tasks.RELEASED, "expired")}
