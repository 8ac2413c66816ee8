import random

from pyspark.sql import functions as F

from revlens.operators.labels import label_state
from revlens.schema import LABEL_EVENTS
from revlens.streaming import ingest, live
from test_dedup import SCHEMA, one_by_one, random_rows


def landed(spark, frames, path, schema):
    """One file per frame, picked up one per micro-batch in order of arrival."""
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").json(f"{path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/in/*")


def test_ingest_equals_loop_over_batches(spark, tmp_path):
    rows = random_rows(random.Random(21), 40, 12, "abcdef")
    batches = [[r for r in rows if r[1] % 3 == k] for k in range(3)]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    schema = frames[0].schema
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.json(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in/*")
        ingest.ingest_changes(stream, f"{tmp_path}/table", f"{tmp_path}/ck").awaitTermination()
    table = spark.read.parquet(f"{tmp_path}/table/rows")
    got = {(r["article"], r["change_ord"]) for r in table.collect()}
    arrival = {}
    for b, batch in enumerate(batches):
        for r in batch:
            arrival[(r[0], r[1])] = (b, r[1])
    ordered = sorted(rows, key=lambda r: arrival[(r[0], r[1])])
    renumbered = [(r[0], n, r[2], r[3], r[4]) for n, r in enumerate(ordered)]
    kept = {(ordered[n][0], ordered[n][1]) for _, n in one_by_one(renumbered)}
    assert got == kept
    # Revision numbers repeat between the articles of this test, so ids are unique per article.
    assert table.select("article", "id").distinct().count() == table.count()


def test_label_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (f"r{rng.randrange(20)}", f"s{i}", f"t{i}", i, "clear" if i == 60 else rng.choice(["label", "label", "skip"]))
        for i in range(120)
    ]
    events = spark.createDataFrame(rows, LABEL_EVENTS)
    parts = [events.filter(F.col("event_seq") % 4 == k) for k in range(4)]
    stream = landed(spark, parts, str(tmp_path), LABEL_EVENTS)
    writes = live.live_label_writes(stream)
    live.publish(writes, f"{tmp_path}/out", f"{tmp_path}/ck", "update").awaitTermination()
    state = live.current_labels(live.published(spark, f"{tmp_path}/out", writes.schema))
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in label_state(events).collect()}


def test_nothing_published_yet(spark, tmp_path):
    assert live.published(spark, f"{tmp_path}/none", LABEL_EVENTS).count() == 0
