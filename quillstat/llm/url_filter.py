"""URL filters: prefix rules and gradient-boosted trees on lexical features.

DataFrame functions and Spark ML only.  The trees are trained from labelled
URLs; where no labels are given, the URLs that a rule judges are the labels.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import lower_ascii, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: At most so many labelled URLs train the trees: those with the smallest hashes.
TRAIN_ROWS = 10_000
#: Suffix statistics up to so many rows and bytes are broadcast; larger ones are joined by shuffle, without the suffixes that more than one in HOT_SHARE rows has.
STATS_ROWS, STATS_BYTES, HOT_SHARE, HOT_BYTES = 100_000, 4 << 20, 2_000, 1_024
FEATURES = ("f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_fragment", "f_hyphens", "f_last", "f_suffix_rate", "f_suffix_count")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_string(host: str, path: str) -> str:
    return host + path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(rule_string(r[1], r[2])), rule_string(r[1], r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(rule_string(h, p))).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits: counts from the runs of the sorted characters."""
    n = F.greatest(F.lit(1), F.length(text))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda a, c: a - (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n * F.log2((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n),
    )


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, suffix (last label of the host) and the f_ columns that need no statistics."""
    u = F.coalesce(F.col(url), F.lit(""))
    df = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    last = F.element_at(F.split(F.col("path"), "/"), -1)
    n = F.greatest(F.lit(1), F.length(u))
    return df.withColumns(
        {
            "suffix": F.concat_ws("/", F.element_at(F.split("host", r"\."), -1), F.element_at(F.split(F.concat("path", F.lit("//")), "/"), 2)),
            "f_length": F.length(u).cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "f_labels": F.size(F.split("host", r"\.")).cast("double"),
            "f_digits": (F.length(u) - F.length(F.translate(u, "0123456789", ""))) / n,
            "f_entropy": _entropy(u),
            "f_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
            "f_fragment": F.when(F.instr(u, "#") > 0, 1.0).otherwise(0.0),
            "f_hyphens": (F.length(u) - F.length(F.translate(u, "-_", ""))).cast("double"),
            "f_last": F.length(last).cast("double"),
        }
    )


def train(labelled: DataFrame, url: str = "url", label: str = "label", rows: int = TRAIN_ROWS, trees: int = 12, depth: int = 4):
    """(model, suffix statistics, fallback label) from url and label (1 blocks).

    The trees use at most ``rows`` distinct labelled URLs, those with the
    smallest hashes, so a rerun takes the same ones.  The suffix statistics count
    all distinct labelled URLs.  A training row's own label is left out of its
    suffix rate.  With one class only, or no row, there is no model and the
    fallback holds for all.
    """
    every = (
        labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label"))
        .where(F.col("url").isNotNull() & F.col("label").isNotNull())
        .groupBy("url").agg(F.max("label").alias("label"))
    )
    sample = lexical_features(every.orderBy(F.xxhash64("url"), "url").limit(rows)).cache()
    classes = [r[0] for r in sample.select("label").distinct().collect()]
    stats = written(lexical_features(every).groupBy("suffix").agg(F.sum("label").alias("s_bad"), F.count("*").alias("s_n")), "suffixes")
    if len(classes) < 2:
        return None, stats, (classes[0] if classes else 0.0)
    mine = stats.join(F.broadcast(sample.drop("url", "host", "path")), "suffix").withColumns(
        {"f_suffix_rate": (F.col("s_bad") - F.col("label") + 0.5) / F.col("s_n"), "f_suffix_count": F.log1p(F.col("s_n") - 1)}
    )
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(mine).select("features", "label", *FEATURES).coalesce(1).sortWithinPartitions(*FEATURES, "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, stepSize=0.3).fit(ready)
    sample.unpersist()
    return model, stats, 0.0


def _with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds s_bad and s_n of the suffix to all rows, null where it has no label."""
    n, size = stats.agg(F.count("*"), F.sum(F.octet_length("suffix") + 32)).first()
    if n <= STATS_ROWS and (size or 0) <= STATS_BYTES:
        return rows.join(F.broadcast(stats), "suffix", "left")
    counted = written(rows.groupBy("suffix").agg(F.count("*").alias("n")), "suffix_rows")
    least = (counted.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot = counted.where((F.col("n") > least) & (F.octet_length("suffix") <= HOT_BYTES)).select("suffix")
    hot = written(hot.join(stats, "suffix", "left"), "hot_suffixes")
    hot = F.broadcast(hot.select("suffix", F.struct("s_bad", "s_n").alias("__hot")))
    marked = rows.join(hot, "suffix", "left")
    often = marked.where("__hot IS NOT NULL").select("*", "__hot.s_bad", "__hot.s_n").drop("__hot")
    return often.unionByName(marked.where("__hot IS NULL").drop("__hot").join(stats.hint("merge"), "suffix", "left"))


def predict(df: DataFrame, fitted, url: str = "url") -> DataFrame:
    """Adds host, path and block_probability; other columns stay as they are."""
    model, stats, fallback = fitted
    keep = [c for c in df.columns if c not in ("host", "path", "block_probability")]
    rows = lexical_features(df.select(F.struct(*keep).alias("__row"), F.col(url).alias("url")))
    if model is None:
        return rows.select("__row.*", "host", "path", F.lit(float(fallback)).alias("block_probability"))
    rows = _with_stats(rows, stats).withColumns(
        {"f_suffix_rate": (F.coalesce("s_bad", F.lit(0.0)) + 0.5) / (F.coalesce("s_n", F.lit(0)) + 1), "f_suffix_count": F.log1p(F.coalesce("s_n", F.lit(0)))}
    )
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__v").transform(rows).select("__row", "host", "path", "__v")
    scored = model.setFeaturesCol("__v").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__c").transform(rows)
    return scored.select("__row.*", "host", "path", vector_to_array("__p")[1].alias("block_probability"))


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, labelled: DataFrame | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """Adds host, path, rule, verdict and block_probability.

    The longest fitting rule decides, else the trees (block from 0.5).  A null
    URL, or one without ``://``, has empty host and path and is judged by the
    trees on its remaining features.  Repeated rows are judged alike.  Other
    columns stay, even under the names of features; host, path, rule, verdict
    and block_probability are replaced.
    """
    if labelled is None:
        _, verdict = matching_rule(host_of(F.col(url)), path_of(F.col(url)), rules)
        labelled = df.select(F.col(url).alias("url"), F.when(verdict == "block", 1.0).when(verdict == "allow", 0.0).alias("label"))
    out = predict(df, train(labelled, "url", "label", rows), url)
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return out.withColumns({"rule": name, "verdict": F.coalesce(verdict, own)})
