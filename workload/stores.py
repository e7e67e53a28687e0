"""Store writes: append, named, partitioned, append-only, compaction, CSV; and embeddings."""

from pyspark.sql import functions as F

from tabflow.operators.embed import Compressor, EmbeddingStore, embed_column, hashing_embedder
from tabflow.operators.inspect import same_rows
from tabflow.plans.columns import ColumnSpec
from tabflow.plans.dataset import Dataset
from tabflow.session import scratch_path
from tabflow.sources.store import Store, append_csv
from workload.registry import register, table


def _custs(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")


@register("SELECT o_orderkey, o_totalprice, 'a' AS tag FROM orders UNION ALL SELECT o_orderkey, o_totalprice, 'b' FROM orders")
def w_append(spark, sf):
    orders, store = table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), Store(spark, scratch_path(spark, "store"))
    store.append(orders.withColumn("tag", F.lit("a")))
    store.append(orders.withColumn("tag", F.lit("b")))
    store.append(orders.withColumn("tag", F.lit("c")).filter("o_orderkey < 0"))
    return store.read()


@register("SELECT n_nationkey AS id FROM nation UNION ALL SELECT r_regionkey FROM region")
def w_append_named(spark, sf):
    store = Store(spark, scratch_path(spark, "store"))
    store.append_named(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id")), "nation")
    store.append_named(table(spark, sf, "region").select(F.col("r_regionkey").alias("id")), "region")
    named = [Store(spark, f"{store.path}/{n}").read() for n in ("nation", "region")]
    return named[0].unionByName(named[1])


@register("""
SELECT o_custkey, first_order, source FROM (
  SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order, 'first' AS source FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1
  UNION ALL SELECT o_custkey, arg_max(o_orderkey, o_orderkey), 'second' FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1)
""")
def w_append_only_dedupe(spark, sf):
    """The first write has two thirds of the customers; the second brings all, and a third write the same again."""
    orders, store = _custs(spark, sf), Store(spark, scratch_path(spark, "store"), key="o_custkey")
    rows = orders.select("o_custkey", F.col("o_orderkey").alias("first_order"))
    store.append_new(rows.filter("o_custkey % 3 <> 0").withColumn("source", F.lit("first")), order_by=["first_order"])
    second = rows.withColumn("source", F.lit("second")).withColumn("order", -F.col("first_order"))
    for _ in range(2):
        store.append_new(second, order_by=["order"])
    return store.read().select("o_custkey", "first_order", "source")


@register("""
SELECT key, o_totalprice, CASE WHEN key IS NULL THEN NULL ELSE floor(key / 2000)::BIGINT + 1 END AS partition
FROM (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS key, o_totalprice FROM orders)
""")
def w_partitioned_roundtrip(spark, sf):
    """Rows without a key are kept, in the NULL partition."""
    key = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")).alias("key")
    store = Store(spark, scratch_path(spark, "store"), key="key", partition_size=2000)
    store.append(table(spark, sf, "orders").select(key, "o_totalprice"))
    return store.read().withColumn("partition", F.col("partition").cast("long"))


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 700 AND 5300")
def w_partition_lookup(spark, sf):
    store = Store(spark, scratch_path(spark, "store"), key="o_orderkey", partition_size=1000)
    store.append(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"))
    return store.between(700, 5300)


@register("""
SELECT o_orderkey, o_totalprice, true AS unchanged FROM orders
""")
def w_compact_roundtrip(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    store = Store(spark, scratch_path(spark, "store"), key="o_orderkey", partition_size=4000)
    for status in ("even", "odd"):
        store.append(orders.filter(F.col("o_orderkey") % 2 == (0 if status == "even" else 1)))
    store.compact(rows_per_file=2000)
    after = store.read().drop("partition")
    return after.withColumn("unchanged", F.lit(same_rows(orders, after)))


@register("SELECT o_orderkey, o_orderpriority, 'append' AS mode, 'the key o_orderpriority is no whole number' AS reason FROM orders")
def w_partition_fallback(spark, sf):
    store = Store(spark, scratch_path(spark, "store"), key="o_orderpriority", partition_size=10)
    result = store.append(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey"))
    return store.read().select("o_orderkey", "o_orderpriority", F.lit(result.mode).alias("mode"), F.lit(result.reason).alias("reason"))


@register("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier")
def w_append_csv(spark, sf):
    path, rows = scratch_path(spark, "csv"), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    append_csv(rows, path)
    append_csv(rows.withColumn("s_suppkey", F.col("s_suppkey") + 1000000), path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@register("SELECT o_orderkey, o_custkey, true AS same FROM orders WHERE o_orderstatus = 'O'")
def w_stored_against_source(spark, sf):
    """Stored rows joined with their source on the key hold the same values."""
    orders, store = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), Store(spark, scratch_path(spark, "store"), key="o_orderkey")
    store.append_new(orders.filter("o_orderstatus = 'O'"))
    stored = store.read().select("o_orderkey", F.col("o_custkey").alias("stored"))
    return orders.join(stored, "o_orderkey").select("o_orderkey", "o_custkey", (F.col("o_custkey") == F.col("stored")).alias("same"))


# ---------------------------------------------------------------- embeddings

_EMBED_SQL = """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN text END AS text FROM documents),
w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM d),
c AS (SELECT doc_id, ('0x' || substr(md5(word), 4, 1))::INT AS slot, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM c GROUP BY 1)
"""


def _texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"))


def _exploded(df):
    return df.select("doc_id", F.posexplode_outer("text_embedding").alias("slot", "value")).select(
        "doc_id", "slot", F.round(F.col("value").cast("double"), 4).alias("value")
    )


@register(_EMBED_SQL + """
SELECT d.doc_id, s.slot::INT AS slot, round(CAST(coalesce(n, 0) / len AS FLOAT)::DOUBLE, 4) AS value
FROM d JOIN l USING (doc_id), range(16) AS s(slot) LEFT JOIN c ON c.doc_id = d.doc_id AND c.slot = s.slot
UNION ALL SELECT doc_id, NULL, NULL FROM d WHERE text IS NULL
""")
def b_embed_distinct(spark, sf):
    """Every distinct text is embedded once, whole; copies and rows without text keep their place."""
    return _exploded(embed_column(_texts(spark, sf), "text", hashing_embedder(16)))


@register("""
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations),
c AS (SELECT conv_id, turn, ('0x' || substr(md5(word), 4, 1))::INT AS slot, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2, 3),
l AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS len FROM c GROUP BY 1, 2)
SELECT l.conv_id, l.turn, s.slot::INT AS slot, round(CAST(coalesce(n, 0) / len AS FLOAT)::DOUBLE, 4) AS value
FROM l CROSS JOIN range(16) AS s(slot) LEFT JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn AND c.slot = s.slot
""")
def n_embedding_encode(spark, sf):
    """A text column of a dataset replaced by the stored vectors of its distinct texts."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text").withColumn("split", F.lit("train"))
    columns = [ColumnSpec("conv_id", "integer"), ColumnSpec("turn", "integer"), ColumnSpec("text", "text", training={"encoding": "embedding"})]
    dataset = Dataset(columns, embedders={"text": hashing_embedder(16)}, root=scratch_path(spark, "dataset")).fit(turns)
    ready = dataset.normalize(turns)
    return ready.select("conv_id", "turn", F.posexplode("text_embedding").alias("slot", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 4)
    )


@register("""
WITH d AS (SELECT doc_id, text FROM documents),
n AS (SELECT count(DISTINCT text) FILTER (doc_id % 2 = 0) AS known, count(DISTINCT text) AS stored,
             count(DISTINCT text) FILTER (text NOT IN (SELECT text FROM d WHERE doc_id % 2 = 0)) AS missing FROM d)
SELECT doc_id, 16 AS dims, known, missing, stored, 0::BIGINT AS missing_after FROM d, n
""")
def b_incremental(spark, sf):
    """First the texts of every second document, then of all: only the others are embedded, and every document gets its vector."""
    docs, embedder = table(spark, sf, "documents").select("doc_id", "text"), hashing_embedder(16)
    store = EmbeddingStore(spark, scratch_path(spark, "embeddings"))
    store.update(docs.filter("doc_id % 2 = 0"), "text", embedder)
    counts = {"known": store.full.read().count(), "missing": store.missing(docs, "text").count()}
    store.update(docs, "text", embedder)
    counts |= {"stored": store.full.read().count(), "missing_after": store.missing(docs, "text").count()}
    rows = store.attach(docs, "text").select("doc_id", F.size("text_embedding").alias("dims"))
    return rows.select("doc_id", "dims", *[F.lit(n).cast("long").alias(c) for c, n in counts.items()])


@register("SELECT count(*) AS num_rows, true AS fewer, true AS keeps_nine_tenths FROM embeddings")
def b_pca_compress(spark, sf):
    """Vectors reduced to the components that explain nine tenths of the variance, measured on the reduced rows."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pca = Compressor(variance=0.9).fit(vectors)
    spread = lambda df: df.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("s")).agg(F.sum("s")).first()[0]
    small = pca.transform(vectors)
    kept = spread(small) / spread(vectors)
    return small.agg(
        F.count(F.lit(1)).alias("num_rows"), (F.max(F.size("embedding")) < 64).alias("fewer"), F.lit(kept >= 0.8999).alias("keeps_nine_tenths")
    )


@register("SELECT count(*) AS num_rows, ceil(64 * 0.85)::BIGINT AS components, true AS ordered FROM embeddings")
def b_pca_preset(spark, sf):
    """A preset keeps a share of the dimensions; components come in falling order of variance."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pca = Compressor(preset="balanced").fit(vectors)
    variance = pca.model.explainedVariance.toArray()
    falling = bool(all(a >= b for a, b in zip(variance, variance[1:])))
    out = pca.transform(vectors).agg(F.count(F.lit(1)).alias("num_rows"), F.max(F.size("embedding")).cast("long").alias("components"))
    return out.withColumn("ordered", F.lit(falling))
