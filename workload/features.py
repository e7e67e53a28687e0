"""Features: earlier rows, stored features, lookups, key partitions; and dataset normalisation."""

import datetime as dt

from pyspark.sql import functions as F

from tabflow.functions.dates import days_between
from tabflow.operators.grouped import GroupFunction
from tabflow.operators.history import Earlier, last_where, previous_value, with_earlier
from tabflow.operators.inspect import null_columns
from tabflow.operators.ordering import partition_bounds
from tabflow.operators.split import DateSplitter
from tabflow.plans.columns import ColumnSpec
from tabflow.plans.dataset import Dataset
from tabflow.plans.features import Feature, FeatureList, build_batch
from tabflow.plans.refresh import refresh
from tabflow.session import scratch_path
from tabflow.sources.files import Source
from tabflow.sources.store import read_snapshot, snapshot_versions, write_snapshot
from workload.registry import EVENTS_SQL, holed_events, register, table


@register("""
SELECT floor(o_orderkey / 700)::BIGINT + 1 AS partition, (floor(o_orderkey / 700) * 700)::BIGINT AS partition_start,
       least((floor(o_orderkey / 700) * 700 + 699)::BIGINT, (SELECT max(o_orderkey) FROM orders)) AS partition_end, count(*) AS num_rows
FROM orders GROUP BY 1, 2, 3
""")
def f_partition_bounds(spark, sf):
    return partition_bounds(table(spark, sf, "orders"), "o_orderkey", 700)


_LAG_SQL = "SELECT event_id, user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_time FROM events"


@register(_LAG_SQL)
def f_lag_by_user(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return previous_value(events, "user_id", ["ts", "event_id"], "ts", "last_time").drop("ts")


@register("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, ts FROM events)
SELECT event_id, user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_time FROM e
""")
def f_lag_hot_user(spark, sf):
    """One user has a third of all rows; that group is cut into ranges of time."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id")
    events = table(spark, sf, "events").select("event_id", user, "ts")
    return previous_value(events, "user_id", ["ts", "event_id"], "ts", "last_time", hot_rows=1000).drop("ts")


@register("""
WITH e AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, value,
         CASE WHEN event_id = (SELECT min(event_id) FROM events) THEN 'a' ELSE 'https://host.example/events/' || lpad(CAST((event_id * 7919) % 1000003 AS VARCHAR), 12, '0') || '/' || CAST(event_id AS VARCHAR) END AS place
  FROM events)
SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY place) AS last_value FROM e
""")
def f_lag_text_order(spark, sf):
    """The hot user's rows are ordered by a text whose first bytes are all equal, but for one stray."""
    events = table(spark, sf, "events")
    first = events.agg(F.min("event_id")).first()[0]
    number = F.lpad(((F.col("event_id") * 7919) % 1000003).cast("string"), 12, "0")
    place = F.when(F.col("event_id") == first, "a").otherwise(F.concat(F.lit("https://host.example/events/"), number, F.lit("/"), F.col("event_id").cast("string")))
    user = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    rows = events.select("event_id", user.alias("user_id"), "value", place.alias("place"))
    return previous_value(rows, "user_id", ["place"], "value", "last_value", hot_rows=1000).drop("value", "place")


@register("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, date_trunc('month', ts) AS day, value, event_type FROM events)
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY day, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM e
""")
def f_last_where_hot_time(spark, sf):
    """The hot user's rows also share one time, so the ranges continue on the second order column."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id")
    day = F.date_trunc("month", "ts").cast("timestamp_ntz").alias("day")
    events = table(spark, sf, "events").select("event_id", user, day, "value", "event_type")
    out = last_where(events, "user_id", ["day", "event_id"], "value", F.col("event_type") == "purchase", "last_purchase", hot_rows=1000)
    return out.select("event_id", "user_id", "last_purchase")


@register("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events
""")
def f_last_purchase_before(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = last_where(events, "user_id", ["ts", "event_id"], "value", F.col("event_type") == "purchase", "last_purchase")
    return out.select("event_id", "user_id", "last_purchase")


@register("""
WITH p AS (SELECT event_id, ts, last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bought_at FROM events)
SELECT event_id, bought_at, CAST(trunc(epoch_us(ts) / 86400000000.0 - epoch_us(bought_at) / 86400000000.0) AS BIGINT) AS days FROM p
""")
def f_days_between(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    bought = Earlier(F.col("ts"), F.col("event_type") == "purchase")
    out = with_earlier(events, "user_id", ["ts", "event_id"], {"bought_at": bought})
    return out.select("event_id", "bought_at", days_between(F.col("ts"), F.col("bought_at")).alias("days"))


class OrderHistory(Feature):
    """Per customer: number and total of orders, computed once and stored."""

    name = "order_history"
    primary_key = "o_custkey"
    batch_size = 1000
    needs_columns = ("o_totalprice",)
    computes_columns = ("n_orders", "order_total")

    def fit(self, df):
        return df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("order_total"))

    def transform(self, df, stored):
        return stored.attach(df)


class BigOrder(Feature):
    """A row-local feature that uses the stored one."""

    name = "big_order"
    computes_columns = ("big_order",)

    def transform(self, df, stored):
        return df.withColumn("big_order", F.col("o_totalprice") * F.col("n_orders") > F.col("order_total"))


@register("""
WITH h AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS order_total FROM orders GROUP BY 1)
SELECT o_orderkey, n_orders, order_total, o_totalprice * n_orders > order_total AS big_order FROM orders LEFT JOIN h USING (o_custkey)
""")
def f_stored_feature(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    features = FeatureList([BigOrder()]).prepend(OrderHistory())
    stores = features.stores(spark, scratch_path(spark, "features"))
    features.fit(orders, stores)
    return features.apply(orders, stores).select("o_orderkey", "n_orders", "order_total", "big_order")


@register("""
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS order_total FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1
""")
def f_store_lookup(spark, sf):
    """Stored rows for the keys of another table: a semi-join, not a list of literals."""
    feature = OrderHistory()
    stores = FeatureList([feature]).stores(spark, scratch_path(spark, "features"))
    FeatureList([feature]).fit(table(spark, sf, "orders"), stores)
    keys = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return stores["order_history"].lookup(keys)


@register("""
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS order_total FROM orders WHERE o_custkey BETWEEN 40 AND 130
GROUP BY 1 HAVING count(*) > 9
""")
def f_store_query(spark, sf):
    feature = OrderHistory()
    feature.batch_size = 50
    stores = FeatureList([feature]).stores(spark, scratch_path(spark, "features"))
    FeatureList([feature]).fit(table(spark, sf, "orders"), stores)
    return stores["order_history"].store.between(40, 130).filter(F.col("n_orders") > 9)


@register("""
SELECT o_custkey, n_orders FROM (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS order_total FROM orders
WHERE o_custkey BETWEEN 40 AND 130 GROUP BY 1) WHERE order_total > 100000
""")
def f_store_query_verbs(spark, sf):
    """Key range, filter and selection over stored rows in one call of the feature store."""
    feature = OrderHistory()
    feature.batch_size = 50
    stores = FeatureList([feature]).stores(spark, scratch_path(spark, "features"))
    FeatureList([feature]).fit(table(spark, sf, "orders"), stores)
    return stores["order_history"].query(keys=(40, 130), filter="order_total > 100000", select=["o_custkey", "n_orders"])


def backlog() -> GroupFunction:
    """What is left of the values of a group if 50 are worked off at each event, never less than nothing."""

    def steps(rows):
        return rows["value"].fillna(0).round().astype("int64") - 50

    def reduce(rows):
        total = steps(rows).cumsum()
        return {"total": int(total.iloc[-1]), "low": min(0, int(total.min()))}

    def merge(earlier, later):
        return {"total": earlier["total"] + later["total"], "low": min(earlier["low"], earlier["total"] + later["low"])}

    def apply(rows, before):
        before = before or {"total": 0, "low": 0}
        total = before["total"] + steps(rows).cumsum()
        return rows[["event_id", "site"]].assign(backlog=total - total.cummin().clip(upper=before["low"]))

    return GroupFunction("event_id long, site long, backlog long", apply, reduce, merge)


class SiteBacklog(Feature):
    name = "site_backlog"
    primary_key = "event_id"
    batch_key = "site"
    batch_size = 10
    needs_columns = ("user_id", "ts", "value")
    computes_columns = ("backlog",)
    group_function = backlog()
    group_order = ("ts", "event_id")
    group_hot_rows = 1000

    def batch(self, df):
        return F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id") % 40 + 1).cast("long")

    def transform(self, df, stored):
        return stored.attach(df)


@register("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 40 + 1 END AS site, ts, CAST(round_even(value, 0) AS BIGINT) - 50 AS step FROM events),
t AS (SELECT event_id, site, ts, CAST(sum(step) OVER (PARTITION BY site ORDER BY ts, event_id) AS BIGINT) AS total FROM e)
SELECT event_id, CAST(site AS BIGINT) AS site, total - least(0, min(total) OVER (PARTITION BY site ORDER BY ts, event_id)) AS backlog FROM t
""")
def f_group_function(spark, sf):
    """A function of the rows of a computed batch key; one group has a third of all rows and is computed range by range."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    features = FeatureList([SiteBacklog()])
    stores = features.stores(spark, scratch_path(spark, "features"))
    features.fit(events, stores)
    return features.apply(events, stores).select("event_id", "site", "backlog")


@register("SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 60")
def f_build_batch(spark, sf):
    return build_batch(table(spark, sf, "orders"), OrderHistory(), 10, 60)


@register("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_name < 'K'")
def f_lookup_other_dataset(spark, sf):
    class NationName(Feature):
        name = "nation_name"
        computes_columns = ("n_name",)

        def transform(self, df, stored):
            nation = table(spark, sf, "nation").filter(F.col("n_name") < "K").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
            return df.join(nation, "c_nationkey", "left")

    return FeatureList([NationName()]).apply(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), {})


# ---------------------------------------------------------------- normalisation


class Weekday(Feature):
    name = "weekday"
    computes_columns = ("day",)

    def transform(self, df, stored):
        return df.withColumn("day", F.dayofmonth("ts").cast("long"))


def events_dataset(**options) -> Dataset:
    return Dataset(
        [
            ColumnSpec("event_id", "integer", is_primary_key=True),
            ColumnSpec("ts", "datetime", is_date_column=True, hidden=True),
            ColumnSpec("user_id", "integer", drop_if_null=True),
            ColumnSpec("event_type", "categorical", training={"method": "most_frequent", "encoding": "one_hot"}),
            ColumnSpec("value", "float", is_target=False, training={"method": "mean", "params": {"clip": {"min": 0, "max": 300}}}),
            ColumnSpec("day", "integer", computed_by="weekday"),
        ],
        features=[Weekday()],
        run_date=dt.date(2024, 2, 1),
        **options,
    )


def _users(df):
    return df.withColumn("user_id", F.when(F.col("event_id") % 23 != 0, F.col("user_id")))


_NORMAL_SQL = EVENTS_SQL + """
, c AS (SELECT event_id, ts, split, CASE WHEN event_id % 23 <> 0 THEN user_id END AS user_id, event_type,
               CASE WHEN value IS NOT NULL THEN least(greatest(value, 0), 300) END AS value FROM ev),
m AS (SELECT event_type AS top FROM c WHERE split = 'train' AND event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT event_id, split, user_id, ts, coalesce(event_type, (SELECT top FROM m)) AS t,
             round(coalesce(value, (SELECT avg(value) FROM c WHERE split = 'train')), 6) AS value FROM c)
SELECT event_id, {split} user_id, t = 'click' AS event_type_click, t = 'error' AS event_type_error, t = 'purchase' AS event_type_purchase,
       t = 'signup' AS event_type_signup, t = 'view' AS event_type_view, t = 'other' AS event_type_other, value, CAST(day(ts) AS BIGINT) AS day
FROM f
"""


@register(_NORMAL_SQL.replace("{split}", "split,") + " WHERE user_id IS NOT NULL")
def d_normalize_train(spark, sf):
    events = _users(holed_events(spark, sf))
    return events_dataset().fit(events).normalize(events).withColumn("value", F.round("value", 6))


@register(_NORMAL_SQL.replace("{split}", ""))
def d_normalize_inference(spark, sf):
    """Fitted on training rows; scored rows keep their number, and lack neither columns nor rows."""
    events = _users(holed_events(spark, sf))
    dataset = events_dataset().fit(events)
    return dataset.normalize(events.drop("split"), inference=True).withColumn("value", F.round("value", 6))


@register(EVENTS_SQL + """
, m AS (SELECT event_type AS top FROM ev WHERE split = 'train' AND event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
a AS (SELECT round(avg(least(greatest(value, 0), 300)), 6) AS value FROM ev WHERE split = 'train' AND value IS NOT NULL)
SELECT event_id, CAST(NULL AS BIGINT) AS user_id, top = 'click' AS event_type_click, top = 'error' AS event_type_error,
       top = 'purchase' AS event_type_purchase, top = 'signup' AS event_type_signup, top = 'view' AS event_type_view,
       top = 'other' AS event_type_other, a.value, CAST(day(ts) AS BIGINT) AS day
FROM ev, m, a
""")
def d_missing_columns(spark, sf):
    """Rows to be scored that lack three input columns: they are added, and filled as far as their columns are."""
    events = holed_events(spark, sf)
    dataset = events_dataset().fit(events)
    rows = events.drop("split", "user_id", "event_type", "value")
    return dataset.normalize(rows, inference=True).withColumn("value", F.round("value", 6))


@register(_NORMAL_SQL.replace("{split}", "split,") + " WHERE user_id IS NOT NULL")
def d_process_all_splits(spark, sf):
    """The processed table on disk, read back by its split folders, with the state saved and loaded in between."""
    events = _users(holed_events(spark, sf))
    dataset = events_dataset(root=scratch_path(spark, "dataset")).fit(events)
    dataset.save(spark, f"{dataset.root}/state")
    again = Dataset.load(spark, f"{dataset.root}/state", features=[Weekday()])
    path = f"{dataset.root}/processed"
    again.normalize(events).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).withColumn("value", F.round("value", 6))


@register("""
SELECT o_orderkey, o_custkey, o_totalprice, missing FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 12 = 0 THEN 'o_custkey,o_totalprice' WHEN o_orderkey % 6 = 0 THEN 'o_custkey'
              WHEN o_orderkey % 4 = 0 THEN 'o_totalprice' ELSE '' END AS missing FROM orders)
""")
def d_required_fields(spark, sf):
    """Good rows and rejected rows together are all rows."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )
    dataset = Dataset([ColumnSpec("o_orderkey", "integer"), ColumnSpec("o_custkey", "integer"), ColumnSpec("o_totalprice", "float")])
    good, rejected = dataset.check_required(orders)
    listed = rejected.select("*", F.array_join("missing_fields", ",").alias("missing")).drop("missing_fields")
    return good.withColumn("missing", F.lit("")).unionByName(listed)


@register("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS o_totalprice FROM orders) WHERE o_totalprice IS NOT NULL")
def d_drop_if_null(spark, sf):
    price = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("o_totalprice")
    dataset = Dataset([ColumnSpec("o_orderkey", "integer"), ColumnSpec("o_totalprice", "float", drop_if_null=True)])
    return dataset.normalize(table(spark, sf, "orders").select("o_orderkey", price))


@register("""
SELECT o_orderkey, o_orderpriority = '5-LOW' AS flag, CAST(o_custkey AS VARCHAR) AS o_custkey, TRY_CAST(o_orderstatus AS DOUBLE) AS o_orderstatus
FROM orders
""")
def d_schema_cast(spark, sf):
    """Text is true only when it is exactly ``true``; a value that does not fit its type becomes NULL."""
    flag = F.when(F.col("o_orderpriority") == "5-LOW", "true").when(F.col("o_orderpriority") == "2-HIGH", "TRUE").otherwise("no")
    rows = table(spark, sf, "orders").select("o_orderkey", flag.alias("flag"), "o_custkey", "o_orderstatus")
    specs = [("o_orderkey", "integer"), ("flag", "boolean"), ("o_custkey", "string"), ("o_orderstatus", "float")]
    return Dataset([ColumnSpec(n, t) for n, t in specs]).cast(rows)


_FLAGSHIP_SQL = """
WITH b AS (SELECT max(o_orderdate)::DATE - INTERVAL 6 MONTH AS test_start, max(o_orderdate)::DATE - INTERVAL 12 MONTH AS valid_start FROM orders),
o AS (SELECT o_orderkey, CASE WHEN o_orderdate < valid_start THEN 'train' WHEN o_orderdate < test_start THEN 'valid' ELSE 'test' END AS split,
             CASE WHEN o_orderkey % 7 <> 0 THEN least(greatest(o_totalprice, 0), 400000) END AS price,
             CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders, b),
m AS (SELECT priority AS top FROM o WHERE split = 'train' AND priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT split, coalesce(price, (SELECT avg(price) FROM o WHERE split = 'train')) AS price, coalesce(priority, (SELECT top FROM m)) AS p FROM o)
SELECT split, count(*) AS num_rows, round(avg(price), 4) AS mean_price, count(*) FILTER (p = '1-URGENT') AS n_urgent, count(*) FILTER (p = '2-HIGH') AS n_high,
       count(*) FILTER (p = '3-MEDIUM') AS n_medium, count(*) FILTER (p = '4-NOT SPECIFIED') AS n_not_specified, count(*) FILTER (p = '5-LOW') AS n_low
FROM f GROUP BY split
"""


@register(_FLAGSHIP_SQL)
def flagship_prepare_orders(spark, sf):
    """Split by date, learn on train, clip, fill, one-hot encode, and summarise every split."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderdate",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    dataset = Dataset(
        [
            ColumnSpec("o_orderkey", "integer", is_primary_key=True),
            ColumnSpec("o_orderdate", "datetime", is_date_column=True),
            ColumnSpec("o_totalprice", "float", training={"method": "mean", "params": {"clip": {"min": 0, "max": 400000}}}),
            ColumnSpec("o_orderpriority", "categorical", training={"method": "most_frequent", "encoding": "one_hot"}),
        ],
        splitter=DateSplitter("o_orderdate", months_test=6, months_valid=6),
    )
    rows = dataset.split(orders)
    ready = dataset.fit(rows).normalize(rows)
    return ready.groupBy("split").agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.round(F.avg("o_totalprice"), 4).alias("mean_price"),
        F.count_if("o_orderpriority_1_URGENT").alias("n_urgent"),
        F.count_if("o_orderpriority_2_HIGH").alias("n_high"),
        F.count_if("o_orderpriority_3_MEDIUM").alias("n_medium"),
        F.count_if("`o_orderpriority_4_NOT SPECIFIED`").alias("n_not_specified"),
        F.count_if("o_orderpriority_5_LOW").alias("n_low"),
    )


@register("""
SELECT 'first' AS version, count(*) AS num_rows, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'second', count(*), round(sum(o_totalprice), 2) FROM orders
""")
def d_snapshots(spark, sf):
    """Two versions of one table; a reader names a version or gets the newest."""
    orders, root = table(spark, sf, "orders"), scratch_path(spark, "snapshots")
    write_snapshot(orders.filter("o_orderstatus = 'F'"), root, "first")
    write_snapshot(orders, root, "second")
    versions = snapshot_versions(spark, root)
    parts = [
        read_snapshot(spark, root, v).agg(F.count(F.lit(1)).alias("num_rows"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("version", F.lit(v))
        for v in versions
    ]
    return parts[0].unionByName(parts[1])


_REFRESHED = """
WITH b AS (SELECT max(o_orderdate)::DATE - INTERVAL 2 MONTH AS test_start, max(o_orderdate)::DATE - INTERVAL 4 MONTH AS valid_start FROM orders),
o AS (SELECT o_orderkey, CASE WHEN o_orderdate < valid_start THEN 'train' WHEN o_orderdate < test_start THEN 'valid' ELSE 'test' END AS split,
             CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, o_orderstatus FROM orders, b),
k AS (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY o_orderstatus) - 1 AS label FROM (SELECT DISTINCT o_orderstatus FROM o WHERE split = 'train'))
SELECT o_orderkey, split, coalesce(price, (SELECT median(price) FROM o WHERE split = 'train')) AS o_totalprice,
       coalesce(label, (SELECT count(*) FROM k)) AS o_orderstatus
FROM o LEFT JOIN k ON s = o_orderstatus
"""


@register(_REFRESHED)
def d_refresh(spark, sf):
    """Source to raw and processed snapshots in one job."""
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", price, "o_orderstatus")
    dataset = Dataset(
        [
            ColumnSpec("o_orderkey", "integer", is_primary_key=True),
            ColumnSpec("o_orderdate", "datetime", is_date_column=True, hidden=True),
            ColumnSpec("o_totalprice", "float", training={"method": "median"}),
            ColumnSpec("o_orderstatus", "categorical", training={"method": "most_frequent", "encoding": "ordinal"}),
        ],
        splitter=DateSplitter("o_orderdate"),
    )
    return refresh(spark, Source(frame=orders), dataset, scratch_path(spark, "refresh")).processed


@register(_REFRESHED)
def d_refresh_twice(spark, sf):
    """First the orders before 1997, then all: the second run places its split by its own newest date."""
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", price, "o_orderstatus")
    dataset = Dataset(
        [
            ColumnSpec("o_orderkey", "integer", is_primary_key=True),
            ColumnSpec("o_orderdate", "datetime", is_date_column=True, hidden=True),
            ColumnSpec("o_totalprice", "float", training={"method": "median"}),
            ColumnSpec("o_orderstatus", "categorical", training={"method": "most_frequent", "encoding": "ordinal"}),
        ],
        splitter=DateSplitter("o_orderdate"),
    )
    root = scratch_path(spark, "refresh")
    refresh(spark, Source(frame=orders.filter("o_orderdate < '1997-01-01'")), dataset, root, version="1")
    return refresh(spark, Source(frame=orders), dataset, root, version="2").processed


@register(EVENTS_SQL + "SELECT 'user_id' AS \"column\" WHERE (SELECT count(*) FILTER (event_id % 23 = 0) FROM ev) > 0")
def d_processed_nulls(spark, sf):
    """What still holds NULLs after imputation, before incomplete rows are dropped."""
    events = _users(holed_events(spark, sf))
    ready = events_dataset().fit(events).normalize(events.drop("split"), inference=True)
    return spark.createDataFrame([(c,) for c in null_columns(ready)], "column string")
