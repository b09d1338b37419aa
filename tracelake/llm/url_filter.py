"""URL filtering: rules first, gradient-boosted trees on lexical features for the rest.

Features are DataFrame expressions: lengths, path depth, digit ratio, character entropy,
parameter counts, and the share of blocked URLs among the labelled ones of the same
suffix (smoothed). The trees are Spark's own, fitted on at most ``MAX_TRAINING``
labelled URLs; suffix statistics cover all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled URLs that the trees are fitted on, at most.
MAX_TRAINING = 10_000
#: Fixed values: (verdict, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

FEATURES = ["url_length", "host_length", "path_length", "query_length", "depth", "host_labels", "hyphens",
            "digit_ratio", "letter_ratio", "entropy", "parameters", "has_fragment", "has_port", "suffix_rate"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else
    empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (``host``, ``path``) with ``rule`` and ``rule_verdict`` of the longest rule that
    fits: its host is the url's or a parent domain, its path a prefix. Of equally
    long rules the one given first wins. Null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, host, path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(judged)).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def _ratio(text: Column, pattern: str) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(pattern)) / F.length(text)).otherwise(F.lit(0.0))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    signs = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.transform(signs, share), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def lexical(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``suffix`` (the host's last label) and the features that need no labels."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return urls.withColumns({
        "suffix": F.substring_index(F.regexp_replace(host, r":\d*$", ""), ".", -1),
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "query_length": F.length(query).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "host_labels": F.regexp_count(host, F.lit(r"[^.]+")).cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "digit_ratio": _ratio(url, "[0-9]"), "letter_ratio": _ratio(url, "[A-Za-z]"), "entropy": _entropy(url),
        "parameters": F.regexp_count(query, F.lit("[^&=]+=?[^&]*")).cast("double"),
        "has_fragment": url.contains("#").cast("double"), "has_port": host.rlike(r":\d+$").cast("double")})


def suffix_rates(labelled: DataFrame) -> DataFrame:
    """``suffix``, ``suffix_rate``: smoothed share of label 1; one row a suffix."""
    return (labelled.groupBy("suffix").agg(((F.sum("label") + 1.0) / (F.count("*") + 2.0)).alias("suffix_rate")))


def classify(urls: DataFrame, labelled: DataFrame, max_training: int = MAX_TRAINING, trees: int = 10,
             depth: int = 3) -> DataFrame:
    """``urls`` (from :func:`lexical`) with ``block_score`` (0 to 1), learned from ``labelled``
    (the same columns and ``label``, 1 = block).

    Labels of one class only give that class's score for all URLs, none at all 0.0."""
    known = materialize(labelled.where("label is not null").groupBy("url_key", "suffix", *FEATURES[:-1])
                        .agg(F.max("label").alias("label")), "labelled-urls")
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    rates = materialize(suffix_rates(known), "suffix-rates")
    rate = F.coalesce("suffix_rate", F.lit(0.5))
    rows = urls.join(rates, "suffix", "left").withColumn("suffix_rate", rate)
    if positive in (0, n):
        return rows.withColumn("block_score", F.lit(1.0 if n and positive else 0.0))
    # Each class has its part of the sample, so that both are always there, and counts as it does among all URLs.
    half = max_training // 2
    taken = {1: min(positive, max(half, max_training - (n - positive)))}
    taken[0] = min(n - positive, max_training - taken[1])
    mark = F.xxhash64("url_key")
    chosen = reduce(DataFrame.unionByName, (
        known.where(F.col("label") == c).orderBy(mark, "url_key").limit(size)
        .withColumn("weight", F.lit((positive if c else n - positive) / size)) for c, size in taken.items()))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    training = materialize(chosen.join(rates, "suffix", "left").withColumn("suffix_rate", rate)
                           .select(*FEATURES, F.col("label").cast("double").alias("label"), "weight", "url_key")
                           .orderBy("url_key").limit(max_training).drop("url_key"), "url-training")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=42,
                          checkpointInterval=-1, weightCol="weight").fit(vector.transform(training).coalesce(4))
    scored = model.transform(vector.transform(rows))
    return (scored.withColumn("block_score", vector_to_array("probability")[1])
            .drop("features", "rawPrediction", "probability", "prediction"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``block_score``.

    The longest fitting rule decides; other URLs are blocked if the trees' score is at
    least ``threshold``. ``labelled`` (``url``, ``label``) trains the trees; without it they learn
    from the URLs that a rule judges. A null URL, or one without ``://``, has an empty host
    and path, fits no rule and is scored like any other. Repeated rows are judged
    each; an empty table gives no rows; other columns are not read."""
    def prepared(df: DataFrame, *more) -> DataFrame:
        parts = df.select(F.col(url_col).cast("string").alias("url"), *more).withColumns(
            {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        return lexical(with_rules(parts, rules)).withColumn("url_key", F.coalesce("url", F.lit("")))

    rows = prepared(pages, F.col(id_col).alias("page_id"))
    if labelled is None:
        known = rows.where("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("int"))
    else:
        known = prepared(labelled, F.col("label").cast("int").alias("label"))
    scored = classify(rows, known)
    by_trees = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_trees).alias("verdict"),
                         "block_score")
