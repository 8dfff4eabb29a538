"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The regression is trained once for each call from a small labelled URL table (``BLOCK`` and ``ALLOW``, or one that the
caller gives), by Spark ML inside the JVM; scoring is a map over the URLs.  Rules are a short list and become one
expression, so that neither part shuffles the URLs.

A host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows
up to ``?``, ``#`` or the end.  A rule (host, path) fits its host and all subdomains, if the url's path starts with
the rule's; the longest rule wins.

Defined cases: null urls and urls without ``://`` have an empty host and path, fit no rule and are judged by
the model's intercept alone; very long urls are used whole; repeated rows are each judged; an empty table gives an
empty result; extra columns pass through unless named like an output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import free_name, let, others

#: Words of pages to block, and of pages to allow, of which the labelled URL table is made.
BLOCK_WORDS = """
casino poker roulette slots betting jackpot lottery viagra pharmacy pills steroids loans payday forex bitcoin porn adult sex
webcam escort warez keygen crack torrent spam backlinks replica adserver tracker popup clickbait banner
""".split()
ALLOW_WORDS = """
library museum weather recipes history science garden music health school wiki maps data parliament chess theatre birds cooking
code railway astronomy biology poetry novels grammar law economics hospital football cycling bridges painting linux python
algorithms climate rivers forest farm village castle harbour radio cinema council police embassy city university news
""".split()


def _block(shift: int) -> list[str]:
    n = len(BLOCK_WORDS)
    return [f"{w}-{BLOCK_WORDS[(i + shift) % n]}.test/{BLOCK_WORDS[(i + 2 * shift + 1) % n]}" for i, w in enumerate(BLOCK_WORDS)]


def _allow() -> list[str]:
    n, hosts = len(ALLOW_WORDS), ("www", "m", "blog", "shop", "en")
    topics = [f"{w}-{ALLOW_WORDS[(i + 7) % n]}.test/{ALLOW_WORDS[(i + 18) % n]}" for i, w in enumerate(ALLOW_WORDS)]
    plain = [f"{hosts[i % 5]}.{w}.test/{('en', 'fr', 'de', 'es')[i % 4]}/{(i * 7919) % 9973}" for i, w in enumerate(ALLOW_WORDS)]
    return topics + plain


#: The small labelled URL table, without its scheme: every word stands in several hosts and paths of its kind; allowed pages also
#: have the plain addresses of a site in some language.
BLOCK = _block(5) + _block(9)
ALLOW = _allow()


@dataclass(frozen=True)
class UrlParams:
    sizes: tuple[int, ...] = (3, 4, 5)
    features: int = 1 << 14
    reg: float = 0.01
    block_at: float = 0.5
    rules: tuple[tuple[str, str], ...] = (
        ("org/", "allow"),
        ("example.org/es/", "block"),
        ("example.org/en/1", "block"),
        ("com/fr/", "allow"),
        ("com/de/", "block"),
    )


RULES = UrlParams().rules
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, _SHAPE, 1), _UPPER, _LOWER), F.regexp_extract(whole, _SHAPE, 2)


def rule_of(host: Column, path: Column, params: UrlParams) -> Column:
    """The longest fitting rule as struct (n, rule, verdict), or null."""
    fits = []
    for rule, verdict in params.rules:
        at = rule.index("/")
        on = (host == rule[:at]) | host.endswith("." + rule[:at])
        found = F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(on & path.startswith(rule[at:]), found))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n: int, rule: string, verdict: string>")


def char_ngrams(host: Column, path: Column, params: UrlParams) -> Column:
    """Character n-grams of the host (between ^ and $) and of the path, told apart by their first letter."""

    def cut(tag: str, part: Column, n: int) -> Column:
        def grams_of(p: Column) -> Column:
            starts = F.when(F.length(p) >= n, F.sequence(F.lit(1), F.length(p) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.concat(F.lit(tag), F.substr(p, i, F.lit(n))))

        return let(part, grams_of)

    grams = [cut("h", F.concat(F.lit("^"), host, F.lit("$")), n) for n in params.sizes] + [cut("p", path, n) for n in params.sizes]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(*grams))


def shipped_table(spark: SparkSession) -> DataFrame:
    """url, blocked (0 or 1) of the labelled URL table."""
    rows = [(u, 1.0) for u in BLOCK] + [(u, 0.0) for u in ALLOW]
    table = F.array(*(F.struct(F.lit("https://" + u).alias("url"), F.lit(y).alias("blocked")) for u, y in rows))
    return spark.range(1).select(F.inline(table))


def train(spark: SparkSession, params: UrlParams = UrlParams(), labelled: DataFrame | None = None) -> PipelineModel:
    """Fit on a small table (url, blocked 0/1); one partition, so that sums have one order and runs agree."""
    labelled = shipped_table(spark) if labelled is None else labelled
    host, path = host_path(F.col("url"))
    grams = labelled.coalesce(1).select(char_ngrams(host, path, params).alias("grams"), F.col("blocked").cast("double").alias("label"))
    hashed = HashingTF(numFeatures=params.features, binary=True, inputCol="grams", outputCol="features")
    regression = LogisticRegression(regParam=params.reg, maxIter=50, standardization=False)
    return PipelineModel([hashed, regression.fit(hashed.transform(grams))])


def judge(pages: DataFrame, params: UrlParams = UrlParams(), model: PipelineModel | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and p_block (the model's probability of block)."""
    model = model or train(pages.sparkSession, params)
    outputs = "host", "path", "rule", "verdict", "p_block"
    host, path = host_path(F.col("url"))
    kept = others(pages, *outputs)
    carried = free_name(pages, "carried")
    rows = pages.select(F.struct(*kept).alias(carried), host.alias("host"), path.alias("path"))
    scored = model.transform(rows.withColumn("grams", char_ngrams(F.col("host"), F.col("path"), params)))
    found = scored.select(
        f"{carried}.*", "host", "path", rule_of(F.col("host"), F.col("path"), params).alias("fit"), vector_to_array("probability")[1].alias("p_block")
    )
    by_model = F.when(F.col("p_block") >= params.block_at, F.lit("block")).otherwise(F.lit("allow"))
    values = {
        "host": F.col("host"),
        "path": F.col("path"),
        "rule": F.col("fit.rule"),
        "verdict": F.coalesce("fit.verdict", by_model),
        "p_block": F.col("p_block"),
    }
    return found.select(*kept, *(v.alias(n) for n, v in values.items()))
