"""Streams over files: scoring, normalisation and append-only stores, drained once and then read as tables."""

from pyspark.sql import functions as F

from tabflow.operators.history import Earlier, with_earlier
from tabflow.session import materialize, scratch_path
from tabflow.sources.files import scan_stream
from tabflow.sources.store import Store
from tabflow.streaming.append import dedupe_stream, stream_append
from tabflow.streaming.batches import KeyedState, stream_batches, stream_earlier
from tabflow.streaming.score import stream_normalize, stream_score
from workload.features import events_dataset
from workload.models import scoring_setup
from workload.registry import holed_events, register, table


def arriving(spark, sf, name):
    return scan_stream(spark, sf, table(spark, sf, name).schema, pattern=f"{name}.parquet")


@register("""
SELECT o_orderkey, true AS equals_batch FROM orders
""")
def t_stream_score(spark, sf):
    """The stream gives for every row what the batch job gives."""
    orders, dataset, model = scoring_setup(spark, sf)
    rows = arriving(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    out, state = scratch_path(spark, "scored"), scratch_path(spark, "state")
    stream_score(rows, dataset, model, out, state).awaitTermination()
    from tabflow.plans.model import score

    streamed = spark.read.parquet(out).select(F.col("raw_input.o_orderkey").alias("o_orderkey"), F.col("value").alias("streamed"))
    batch = score(orders.drop("o_totalprice"), dataset, model).select(F.col("raw_input.o_orderkey").alias("o_orderkey"), "value")
    return batch.join(streamed, "o_orderkey", "full_outer").select("o_orderkey", (F.abs(F.col("value") - F.col("streamed")) < 1e-9).alias("equals_batch"))


@register("SELECT event_id, round(least(greatest(value, 0), 300), 6) AS value, event_type = 'click' AS event_type_click, CAST(day(ts) AS BIGINT) AS day FROM events")
def t_stream_normalize(spark, sf):
    dataset = events_dataset().fit(holed_events(spark, sf))
    rows = arriving(spark, sf, "events").drop("props")
    out, state = scratch_path(spark, "normal"), scratch_path(spark, "state")
    stream_normalize(rows, dataset, out, state).awaitTermination()
    return spark.read.parquet(out).select("event_id", F.round("value", 6).alias("value"), "event_type_click", "day")


@register("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY user_id")
def t_stream_append_only(spark, sf):
    """First event per user; the same stream run again into the same store adds nothing."""
    store = Store(spark, scratch_path(spark, "store"), key="user_id")
    for _ in range(2):
        rows = arriving(spark, sf, "events").select("user_id", "event_id", "ts")
        stream_append(rows, store, scratch_path(spark, "state"), order_by=["ts", "event_id"]).awaitTermination()
    return store.read()


@register("SELECT DISTINCT user_id FROM events")
def t_stream_dedupe(spark, sf):
    """One row per user within a horizon longer than the data."""
    rows = arriving(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out, state = scratch_path(spark, "deduped"), scratch_path(spark, "state")
    writer = dedupe_stream(rows, "user_id", "ts", "400 days").writeStream.format("parquet").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("user_id")


def in_steps(spark, rows, step, steps, files=8):
    """A folder that gets the rows of one step after the other, in as many files each, so that a stream meets them in this order."""
    path = scratch_path(spark, "arriving")
    for n in range(steps):
        rows.filter(step == n).repartition(files).write.mode("append").parquet(path)
    return scan_stream(spark, path, rows.schema, files_per_batch=files)


@register("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, ts, value, event_type FROM events)
SELECT event_id, lag(ts) OVER w AS last_time, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase, false AS is_late
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def t_stream_earlier(spark, sf):
    """Half of the events are history, the rest arrive by and by; one user has a third of all rows. The same values as by one window."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id")
    events = table(spark, sf, "events").select("event_id", user, "ts", "value", "event_type")
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    low, length = F.lit(span.low), (span.high - span.low).total_seconds() or 1.0
    seconds = (F.col("ts").cast("timestamp").cast("double") - low.cast("timestamp").cast("double")) / length
    step = F.least(F.floor(seconds * 8), F.lit(7)) - 4
    values = {"last_time": Earlier(F.col("ts")), "last_purchase": Earlier(F.col("value"), F.col("event_type") == "purchase")}
    history, order = events.filter(step < 0), ["ts", "event_id"]
    state = KeyedState(spark, scratch_path(spark, "keyed"), "user_id", order, values, merge_every=3)
    state.prime(history)
    out = scratch_path(spark, "earlier")
    stream_earlier(in_steps(spark, events, step, 4), state, out, scratch_path(spark, "state"), hot_rows=1000).awaitTermination()
    names = ["event_id", "last_time", "last_purchase", "is_late"]
    before = with_earlier(history, "user_id", order, values, hot_rows=1000).withColumn("is_late", F.lit(False))
    return before.select(*names).unionByName(spark.read.parquet(out).select(*names))


@register("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS step FROM orders),
f AS (SELECT o_custkey, step, min(o_orderkey) AS k FROM o GROUP BY 1, 2),
s AS (SELECT o_custkey, min(step) AS step, arg_min(k, step) AS first_order FROM f GROUP BY 1)
SELECT o_orderkey, CASE WHEN s.step < o.step THEN first_order END AS known_order FROM o JOIN s USING (o_custkey)
""")
def t_stream_store_reread(spark, sf):
    """Every micro-batch looks its customers up in a store and then adds the new ones, so later ones of the same run find them."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    first = orders.select("o_custkey", F.col("o_orderkey").alias("known_order"))
    store = Store(spark, scratch_path(spark, "store"), key="o_custkey")

    def attach(batch, number):
        batch = materialize(batch, "batch")
        known = materialize(batch.join(store.read(first.schema), "o_custkey", "left"), "attached")
        store.append_new(batch.select("o_custkey", F.col("o_orderkey").alias("known_order")), order_by=["known_order"])
        return known

    out = scratch_path(spark, "attached")
    stream_batches(in_steps(spark, orders, F.col("o_orderkey") % 3, 3), attach, out, scratch_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("o_orderkey", "known_order")
