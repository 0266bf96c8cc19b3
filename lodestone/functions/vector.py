"""Vector similarity, calibration, deterministic vectors, chunk windows and centroids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import bound

DEFAULT_MODEL = "snowflake-arctic-embed2"
#: Models whose cosines are calibrated, and the line pieces (up to, from, per, to) that do it.
CALIBRATED = ("snowflake-arctic-embed2", "qwen3-embedding")
#: Fixed values: (characters in a chunk, overlap) by model.
CHUNKING = {"snowflake-arctic-embed2": (5000, 350), "qwen3-embedding": (5000, 350), "nomic-embed-text": (4000, 300)}
DEFAULT_CHUNKING, MAX_CHUNKS = (1100, 150), 50
#: What precedes a query by model.
QUERY_PREFIX = {"bge-large": "Represent this sentence for searching relevant passages: ", "snowflake-arctic-embed2": "query: ", "nomic-embed-text": "search_query: "}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 if either vector is zero."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def calibrate(raw: Column, model: str = DEFAULT_MODEL, sparse: Column | None = None) -> Column:
    """Raw cosine to a comparable scale; identity for other models and for sparse synthetic query vectors."""
    if not any(model.startswith(m) or f"/{m}" in model for m in CALIBRATED):
        curve = raw
    else:
        curve = F.when(raw <= 0.12, raw * 3.0).when(raw <= 0.38, 0.36 + (raw - 0.12) / 0.26 * 0.32).when(raw <= 0.60, 0.68 + (raw - 0.38) / 0.22 * 0.16).otherwise(0.84 + (raw - 0.60) / 0.40 * 0.16)
    if sparse is not None:
        curve = F.when(sparse, raw).otherwise(curve)
    return F.when(raw.isNull() | F.isnan(raw) | (raw <= 0), 0.0).when(raw >= 1, 1.0).otherwise(curve)


def is_sparse(v: Column) -> Column:
    """Fewer than min(12, n) non-zero coordinates among the first min(n, 64)."""
    head = F.slice(v, 1, 64)
    return (F.size(v) > 0) & (F.size(F.filter(head, lambda x: F.abs(x) > 1e-7)) < F.least(F.lit(12), F.size(head)))


def validated(v: Column, dim: int) -> Column:
    """The vector, or null if its length differs or a coordinate is not finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(v) == dim) & ~bad, v)


def deterministic(text: Column, dim: int) -> Column:
    """A unit vector from the SHA-256 of a text: coordinate i from the bytes 2i and 2i + 1, modulo 32, rounded to 6 places."""
    def raw(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("double") / 65535.0 * 2.0 - 1.0)

    def unit(v: Column) -> Column:
        return bound(F.struct(v.alias("v"), norm(v).alias("size")), lambda s: F.transform(s["v"], lambda x: F.round(x / F.when(s["size"] == 0, 1.0).otherwise(s["size"]), 6)))

    return F.when(F.length(text) > 0, bound(bound(F.sha2(text, 256), raw), unit)).otherwise(F.array_repeat(F.lit(0.0), dim))


def canonical_model(name: Column) -> Column:
    """Lower case, without provider prefixes and the ':latest' tag; the default for nothing."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "^((ollama|models)/)+", ""), ":latest$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(DEFAULT_MODEL))


def query_input(text: Column, model: str = DEFAULT_MODEL) -> Column:
    """A query with its model's prefix, once."""
    prefix = next((p for m, p in QUERY_PREFIX.items() if model.startswith(m) or f"/{m}" in model), None)
    return text if prefix is None else F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def chunk_header(repo: Column, path: Column) -> Column:
    rel, name = F.trim(F.coalesce(path, F.lit(""))), F.trim(F.coalesce(repo, F.lit("")))
    return F.when(rel == "", "").when(name == "", F.concat(F.lit("["), rel, F.lit("]\n"))).otherwise(F.concat(F.lit("["), name, F.lit(" :: "), rel, F.lit("]\n")))


def chunks(text: Column, header: Column, model: str = "") -> Column:
    """At most fifty overlapping windows, each behind the header; one window if all fits."""
    size, overlap = next((v for m, v in CHUNKING.items() if m in model), DEFAULT_CHUNKING)
    h, n = F.length(header), F.length(text)
    body = F.when((h > 0) & (h < size - overlap), size - h).otherwise(F.lit(size))
    step = F.greatest(F.lit(1), body - overlap)
    count = F.when(h + n <= size, 1).otherwise(F.greatest(F.lit(1), F.ceil((n - body) / step).cast("int") + 1))
    whole = F.when(h + n <= size, n).otherwise(body)
    starts = F.sequence(F.lit(0), F.least(count, F.lit(MAX_CHUNKS)) - 1)
    return F.transform(starts, lambda i: F.concat(header, F.substring(text, (i * step + 1).cast("int"), whole)))


def centroid(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Per key the normalised sum of its vectors; a single vector stays as it is, a zero sum too."""
    sums = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    whole = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"), F.max("n").alias("n_vectors"))
    size = norm(F.col("v"))
    return whole.select(*keys, "n_vectors", F.when((F.col("n_vectors") > 1) & (size > 0), F.transform("v", lambda x: x / size)).otherwise(F.col("v")).alias("centroid"))
