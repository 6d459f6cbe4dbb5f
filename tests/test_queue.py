from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sluice.functions.fields import parsed
from sluice.model import Action, Campaign, Leaf, Op
from sluice.sources import queue
from sluice.streaming.engine import Builder


def test_queue_feeds_the_engine_in_polls(spark, tmp_path):
    path = str(tmp_path / "q")
    own = [{"event_id": f"e{i:03}", "event_type": "RIDE", "user_id": "u", "payload": {"country": "VN", "n": i}, "ts": datetime(2025, 1, 1) + timedelta(seconds=i)} for i in range(25)]
    assert queue.publish(path, own) == 25 and queue.committed(path) == 0
    sizes = []
    stream = queue.read(spark, path, most=10).withColumn("payload", parsed(F.col("payload")))
    campaign = Campaign("c", "RIDE", Leaf("country", Op.EQ, "vn"), budget=12, actions=(Action("SEND_MESSAGE", "s"),))
    engine = Builder.defaults(spark).campaigns([campaign]).state(str(tmp_path / "state")).build()
    inner = engine.process

    def process(batch, n):
        sizes.append(batch.count())
        inner(batch, n)

    query = stream.writeStream.foreachBatch(process).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    assert [s for s in sizes if s] == [10, 10, 5]
    queue.publish(path, own[:3])  # again: duplicates
    query.processAllAvailable()
    query.stop()
    m = engine.metrics().first()
    assert (m["events_received"], m["duplicates_filtered"], m["rules_matched"], m["actions_triggered"]) == (28, 3, 12, 12)
    assert queue.committed(path) >= 25
    assert queue.committed_keys(path) == {(f"e{i:03}", "RIDE") for i in range(25)} and queue.held(path) == 28
