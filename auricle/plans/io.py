"""Source and sink queries: the given tables are written in another form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, sinks
from .fixtures import hash_split, hash_split_sql
from .registry import query, table


@query(
    "src_csv_typed",
    """SELECT CAST(o_orderkey AS VARCHAR) AS source_id, o_orderpriority AS original_label, o_totalprice AS duration FROM orders""",
)
def src_csv_typed(spark, sf):
    path = sinks.scratch_path(spark, "orders.csv")
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey source_id", "o_custkey fold", "o_orderpriority original_label", "o_totalprice duration"
    )
    rows.write.csv(path, header=True)
    schema = "source_id string, fold string, original_label string, duration double"
    return readers.read_csv(spark, path, schema, ["source_id", "original_label", "duration"])


@query("src_csv_headerless", "SELECT n_nationkey AS id, n_name AS label, n_regionkey AS mid FROM nation")
def src_csv_headerless(spark, sf):
    path = sinks.scratch_path(spark, "vocabulary.csv")
    table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=False)
    return readers.read_csv_headerless(spark, path, "id int, label string, mid int")


@query("src_parquet_project", "SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes FROM pages")
def src_parquet_project(spark, sf):
    path = sinks.scratch_path(spark, "shard")
    pages = table(spark, sf, "pages").select(
        "page_id", F.struct(F.col("html").cast("binary").alias("bytes"), F.col("url").alias("path")).alias("audio")
    )
    pages.write.parquet(path)
    shard = readers.read_parquet(spark, path, ["page_id", "audio.bytes"])
    return shard.select(
        "page_id", F.sha2("bytes", 256).alias("sha256"), F.octet_length("bytes").cast("bigint").alias("size_bytes")
    )


@query(
    "src_file_inventory",
    """SELECT url, split_part(url, '/', -1) AS file_name, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes, sha256(html) AS sha256
       FROM pages""",
)
def src_file_inventory(spark, sf):
    pages = table(spark, sf, "pages").select("url", F.col("html").cast("binary").alias("content"))
    return readers.file_inventory(pages, "url")


@query(
    "src_multi_manifest_union",
    """SELECT 'customer' AS source_dataset, c_name AS source_file, CAST(c_custkey AS VARCHAR) AS source_id,
         c_mktsegment AS original_label, CAST(NULL AS VARCHAR) AS license, CAST(c_acctbal AS VARCHAR) AS duration FROM customer
       UNION ALL SELECT 'supplier', s_name, CAST(s_suppkey AS VARCHAR), 'SUPPLIER', 'CC0', NULL FROM supplier""",
)
def src_multi_manifest_union(spark, sf):
    a, b = sinks.scratch_path(spark, "customer_manifest.csv"), sinks.scratch_path(spark, "supplier_manifest.csv")
    table(spark, sf, "customer").selectExpr(
        "'customer' source_dataset", "c_name slice_file_name", "c_custkey fsID", "c_mktsegment class", "c_acctbal duration"
    ).write.csv(a, header=True)
    table(spark, sf, "supplier").selectExpr(
        "'supplier' source_dataset", "s_name source_file", "s_suppkey source_id", "'SUPPLIER' original_label", "'CC0' license"
    ).write.csv(b, header=True)
    # Legacy column names.
    legacy = {"audio_path": "local_path", "slice_file_name": "source_file", "fsID": "source_id", "class": "original_label"}
    sources = {
        a: "source_dataset string, slice_file_name string, fsID string, class string, duration string",
        b: "source_dataset string, source_file string, source_id string, original_label string, license string",
    }
    required = ["source_dataset", "source_file", "source_id", "original_label"]
    return readers.read_manifests(spark, sources, legacy, required, ["license", "duration"])


STATS_SQL = f"""SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) FILTER (WHERE split = 'train') AS train,
  count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test
  FROM (SELECT o_totalprice, {hash_split_sql('o_custkey')} AS split FROM orders)"""


@query("src_json_stats", STATS_SQL)
def src_json_stats(spark, sf):
    path = sinks.scratch_path(spark, "feature_stats.json")
    rows = table(spark, sf, "orders").withColumn("split", hash_split("o_custkey"))
    counts = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    stats = rows.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), *counts)
    sinks.write_stats(stats.select("lo", "hi", F.struct("train", "val", "test").alias("splits")), path)
    schema = "lo double, hi double, splits struct<train: bigint, val: bigint, test: bigint>"
    return readers.read_stats(spark, path, schema).select("lo", "hi", "splits.*")


@query(
    "src_array_table",
    "SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS place, embedding[i] AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)",
)
def src_array_table(spark, sf):
    rows = readers.read_arrays(spark, f"{sf}/embeddings.parquet", "embedding", 64, ["vec_id", "label"])
    return rows.select("vec_id", "label", F.posexplode("embedding").alias("place", "value"))


@query(
    "sink_table",
    """SELECT source, string_agg(lang, ';' ORDER BY lang) AS classes, CAST(sum(n) AS BIGINT) AS n FROM (
         SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""",
)
def sink_table(spark, sf):
    path = sinks.scratch_path(spark, "group_table")
    rows = table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("lang")).alias("classes")
    )
    sinks.write_table(rows, path, ["source", "classes", "n"], fmt="csv")
    return readers.read_csv(spark, path, "source string, classes string, n bigint")


@query("sink_write_once", "SELECT s_suppkey, s_name, s_acctbal, 'refused' AS second_write FROM supplier")
def sink_write_once(spark, sf):
    root = sinks.scratch_path(spark, "runs")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = sinks.write_once(rows, root, "exp01", rows.columns)
    try:
        sinks.write_once(rows, root, "exp01", rows.columns)
        second = "written"
    except sinks.AnalysisException:
        second = "refused"
    return spark.read.parquet(path).withColumn("second_write", F.lit(second))


# What was made of the rows: changes with the model, its dimension or its pooling.
DESCRIPTOR = "orders;priority;v1"
ROW_JSON_SQL = """'{"o_orderkey":"' || o_orderkey || '","o_orderpriority":"' || o_orderpriority || '","o_custkey":"' || o_custkey || '"}'"""


def _folded_sql(text: str, name: str) -> str:
    return f"""bit_xor(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)) AS {name}_xor,
      CAST(sum(CAST('0x' || substr(md5({text}), 16, 5) AS BIGINT)) AS BIGINT) AS {name}_sum"""


@query(
    "dataset_fingerprint",
    f"""SELECT count(*) AS n, {_folded_sql("CAST(o_orderkey AS VARCHAR)", "key")}, {_folded_sql(ROW_JSON_SQL, "value")},
          md5('{DESCRIPTOR}') AS descriptor FROM orders""",
)
def dataset_fingerprint(spark, sf):
    return sinks.dataset_fingerprint(table(spark, sf, "orders"), "o_orderkey", ["o_orderpriority", "o_custkey"], DESCRIPTOR)
