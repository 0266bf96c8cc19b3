"""URL filter: explicit rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled table of URLs (``labelled_urls``, or a DataFrame of at most ``MAX_LABELLED`` rows) with
the DataFrame-based ``pyspark.ml`` estimator; its weights, ``DIM`` numbers, become one constant array of the scoring expression.
All of it runs in the JVM.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and the verdict of the model's
intercept; repeated rows get equal verdicts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import lower_ascii

DIM, GRAM, REGULARISATION, MAX_LABELLED, MAX_RULES = 2048, 3, 1e-3, 1000, 500
#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Fixed values of the small labelled table: words of hosts to block and to allow, paths of either.
BLOCKED_WORDS = (
    "casino poker slots jackpot betting bets roulette bingo lottery winner prize pills pharmacy viagra cialis steroids diet loans payday debt "
    "adult xxx cams singles escorts dating warez crack keygen torrent replica cheap free win bonus discount clicks ads track popup offers spam farm seo"
).split()
ALLOWED_WORDS = (
    "library museum garden science history weather university school college council hospital theatre orchestra choir gallery archive atlas "
    "observatory forest river harbour bridge railway station village market bakery kitchen recipes cooking painting pottery weaving chess football "
    "cycling hiking climbing sailing birds insects mathematics physics chemistry biology geology grammar dictionary poetry novels"
).split()
PATHS = ("/", "/en/12", "/en/853/", "/fr/148.html", "/de/25", "/es/533/", "/index.html", "/about", "/en/7", "/fr/2021/05/item")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1: block): words and pairs of words under the reserved top-level name ``test``, where no real page is. Both classes have
    the same subdomains and paths, so that only the words tell them apart."""
    rows = []
    for block, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, word in enumerate(words):
            other = words[(7 * i + 3) % len(words)]
            for k, host_ in enumerate((f"{word}-{other}", word if i % 2 else f"{other}{word}")):
                rows.append((f"http://{('', 'www.', 'm.', 'blog.')[(i + 2 * k) % 4]}{host_}.test{PATHS[(3 * i + 5 * k) % len(PATHS)]}", block))
    return rows


_PARTS = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def hashed_grams(host_: Column, path_: Column) -> Column:
    """Hash places of the n-grams of both parts; each part is marked, so that equal grams of host and path differ."""
    def of(mark: str, s: Column) -> Column:
        padded = F.concat(F.lit(mark), s, F.lit("$"))
        n = F.length(padded) - GRAM + 1
        return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(padded, i, F.lit(GRAM))), F.lit(DIM)).cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.concat(of("^", host_), of("/", path_))


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and intercept from a labelled table (url, block)."""
    rows = labelled.where("url is not null and block is not null")
    if (n := rows.limit(MAX_LABELLED + 1).count()) > MAX_LABELLED:
        raise ValueError(f"the labelled table may have {MAX_LABELLED} rows")
    if n == 0 or rows.select("block").distinct().count() < 2:
        return [0.0] * DIM, -1.0
    places = rows.select(F.col("block").cast("double").alias("label"), hashed_grams(host(F.col("url")), path(F.col("url"))).alias("p")).where(F.size("p") > 0)
    shares = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda d: F.size(F.filter("p", lambda x: x == d)) / F.sqrt(F.size("p")))
    model = LogisticRegression(regParam=REGULARISATION, standardization=False, maxIter=200).fit(places.select("label", array_to_vector(shares).alias("features")).coalesce(1))
    return model.coefficients.toArray().tolist(), float(model.intercept)


def _rule(host_: Column, path_: Column, rules) -> Column:
    """The longest fitting rule as struct<n, rule, verdict>, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fitting = [F.when(((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array_compact(F.array(*fitting))) if fitting else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def judge(spark: SparkSession, pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score (the model's, for every row)."""
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "url string, block int")
    weights, intercept = fit(labelled)
    w = F.lit(weights)
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    told = parts.select("*", _rule(F.col("host"), F.col("path"), rules).alias("r"), hashed_grams(F.col("host"), F.col("path")).alias("p"))
    z = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + F.element_at(w, x + 1)) / F.sqrt(F.greatest(F.size("p"), F.lit(1))) + intercept
    scored = told.withColumn("block_score", 1 / (1 + F.exp(-z)))
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")
