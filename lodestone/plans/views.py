"""The model's tables as views over the test tables: DataFrames for Spark, common table expressions for DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 2, 1)
#: The stored vector that stands for a query's, and a query's text.
QUERY_ID, QUERY_TEXT = 7, "licensedTerms idiot anon"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file versions: a path per sixty ids and source has three; gaps where ids divide by small primes."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    i, block = F.col("doc_id"), F.floor(F.col("doc_id") / 60).cast("string")
    days = lambda base, n: F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(n)
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        i.alias("id"), F.col("source").alias("repo"), F.when(i % 97 != 0, F.concat(F.lit("src/d"), block, F.lit(".txt"))).alias("file_path"),
        F.concat(F.lit("d"), block, F.lit(".txt")).alias("file_name"), F.col("n_chars").alias("size"),
        F.when(i % 89 != 0, days("2024-01-31", -(i % 365).cast("int"))).alias("last_seen_at"), days("2023-01-01", (i % 100).cast("int")).alias("created_at"),
        F.when(F.col("label") == 9, "legacy").when(F.col("label") == 8, None).otherwise("active").alias("embed_model"), "embedding",
        F.when(i % 13 != 0, F.left("text", F.lit(500))).alias("summary"), F.when(i % 11 != 0, F.concat("lang", F.lit(" "), "source")).alias("symbol_spine"),
        F.col("text").alias("content"), F.when(i % 3 == 0, "full").when(i % 3 == 1, "pointer").otherwise("direct").alias("storage_mode"),
    )


BLOBS = """v_blob AS (
  SELECT d.doc_id AS id, d.source AS repo, CASE WHEN d.doc_id % 97 <> 0 THEN 'src/d' || (d.doc_id // 60)::VARCHAR || '.txt' END AS file_path,
    'd' || (d.doc_id // 60)::VARCHAR || '.txt' AS file_name, d.n_chars AS size,
    CASE WHEN d.doc_id % 89 <> 0 THEN TIMESTAMP '2024-01-31' - to_days((d.doc_id % 365)::INTEGER) END AS last_seen_at,
    TIMESTAMP '2023-01-01' + to_days((d.doc_id % 100)::INTEGER) AS created_at,
    CASE WHEN e.label = 9 THEN 'legacy' WHEN e.label = 8 THEN NULL ELSE 'active' END AS embed_model, e.embedding::DOUBLE[] AS embedding,
    CASE WHEN d.doc_id % 13 <> 0 THEN left(d.text, 500) END AS summary, CASE WHEN d.doc_id % 11 <> 0 THEN d.lang || ' ' || d.source END AS symbol_spine,
    d.text AS content, CASE d.doc_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'pointer' ELSE 'direct' END AS storage_mode
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One stored vector (one row reaches the driver)."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).first()["embedding"]]


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: names, types and brands as they are, fifty files a brand."""
    i = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        i.alias("id"), F.col("p_brand").alias("repo"), (i * 7 % 1000).alias("blob_id"), F.concat(F.lit("lib/"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lit("/"), (i % 50).cast("string"), F.lit(".js")).alias("file_path"),
        F.col("p_name").alias("symbol_name"), F.col("p_type").alias("symbol_type"), F.col("p_size").alias("start_line"), (F.col("p_size") + (i % 3).cast("int")).alias("end_line"),
        F.concat(F.lit("def "), "p_name").alias("signature"), F.concat_ws(" ", "p_name", "p_type").alias("content"), F.when(i % 17 != 0, F.sha2("p_name", 256)).alias("symbol_hash"),
    )


SYMBOLS = """v_symbol AS (
  SELECT p_partkey AS id, p_brand AS repo, p_partkey * 7 % 1000 AS blob_id, 'lib/' || lower(replace(p_brand, '#', '')) || '/' || (p_partkey % 50)::VARCHAR || '.js' AS file_path,
    p_name AS symbol_name, p_type AS symbol_type, p_size AS start_line, (p_size + (p_partkey % 3)::INTEGER)::INTEGER AS end_line, 'def ' || p_name AS signature,
    p_name || ' ' || p_type AS content, CASE WHEN p_partkey % 17 <> 0 THEN sha256(p_name) END AS symbol_hash
  FROM part)"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges between the documents' files, in five spellings."""
    b = blobs(spark, sf_dir).where("file_path is not null")
    block = (F.floor(F.col("id") / 60) + F.col("id") % 3).cast("string")
    kind = F.col("id") % 5
    target = (
        F.when(kind == 0, F.concat(F.lit("./d"), block)).when(kind == 1, F.concat(F.lit("../src/d"), block, F.lit(".txt"))).when(kind == 2, F.concat(F.lit("d"), block, F.lit(".txt")))
        .when(kind == 3, F.concat(F.lit("../../src/d"), block, F.lit(".txt"))).otherwise(F.lit("node:fs"))
    )
    return b.select("id", "repo", F.col("file_path").alias("source_path"), target.alias("target_path"), F.when(F.col("id") % 2 == 0, "imports").otherwise("requires").alias("relation"),
        F.array(F.concat(F.lit("sym"), (F.col("id") % 3).cast("string")), F.when(F.col("id") % 2 == 0, "aliasedBridge").otherwise("plain")).alias("symbols"))


IMPORTS = """v_import AS (
  SELECT id, repo, file_path AS source_path, CASE id % 5 WHEN 0 THEN './d' || (id // 60 + id % 3)::VARCHAR WHEN 1 THEN '../src/d' || (id // 60 + id % 3)::VARCHAR || '.txt'
    WHEN 2 THEN 'd' || (id // 60 + id % 3)::VARCHAR || '.txt' WHEN 3 THEN '../../src/d' || (id // 60 + id % 3)::VARCHAR || '.txt' ELSE 'node:fs' END AS target_path,
    CASE WHEN id % 2 = 0 THEN 'imports' ELSE 'requires' END AS relation, 'sym' || (id % 3)::VARCHAR || ' ' || CASE WHEN id % 2 = 0 THEN 'aliasedBridge' ELSE 'plain' END AS symbols
  FROM v_blob WHERE file_path IS NOT NULL)"""

HREF = 'href="([^"]+)"'


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page links in order: the page's URL path to the target."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("source_path"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "target_path"))
    return p.select((F.col("page_id") * 1000 + F.col("pos")).alias("id"), "page_id", "source_path", "target_path", F.lit("references").alias("relation"))


LINKS = f"""v_link AS (
  SELECT page_id * 1000 + (n - 1) AS id, page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS source_path, targets[n] AS target_path, 'references' AS relation
  FROM (SELECT page_id, url, regexp_extract_all(html, '{HREF}', 1) AS targets FROM pages) p, LATERAL (SELECT unnest(range(1, len(targets) + 1)) AS n) u)"""


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-to-part edges."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as tree entries."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rows = r.select(F.lit("root").alias("tree_id"), F.lit("tree").alias("type"), F.col("r_name").alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("object_id"))
    rows = rows.unionByName(n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("tree_id"), F.lit("tree").alias("type"), F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("object_id")))
    return rows.unionByName(c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("tree_id"), F.lit("blob").alias("type"), F.col("c_name").alias("name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("object_id")))


HIERARCHY = """v_tree AS (
  SELECT 'root' AS tree_id, 'tree' AS type, r_name AS name, 'r' || r_regionkey::VARCHAR AS object_id FROM region
  UNION ALL SELECT 'r' || n_regionkey::VARCHAR, 'tree', n_name, 'n' || n_nationkey::VARCHAR FROM nation
  UNION ALL SELECT 'n' || c_nationkey::VARCHAR, 'blob', c_name, 'c' || c_custkey::VARCHAR FROM customer)"""
