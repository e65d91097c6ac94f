"""URL filtering: rules by host and path, and gradient-boosted trees for the URLs that no rule covers.

The trees see lexical features only: length, depth, digit ratio, entropy, parameter counts and suffix statistics: how
often URLs with the same last host label occur, and those with the same last label and first path segment, and how many
of the labelled ones are blocked (a labelled URL counts those of other folds only, so that no URL sees its own label). They are trained from labelled URLs; where no labels are
given, the rules' own verdicts are the labels.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, lower_ascii, unit_hash, unused

#: (verdict, host and path prefix).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Most rules that are matched as one expression; more are looked up by host in Python.
MAX_RULES = 200
#: Bound of the training sample, hash buckets of host suffixes (and of suffixes with path heads), and folds that their statistics keep apart.
SAMPLE_ROWS = 20_000
SUFFIX_BUCKETS = 1 << 14
FOLDS = 5
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "query_length", "fragment", "secure", "hyphens", "host_digits", "suffix_share", "suffix_block", "head_share", "head_block"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lowered; path: from there up to ? # or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)
    return lower_ascii(host), path


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. A rule fits its host and all subdomains.

    Of rules of one length that fit, the last one counts.
    """
    if len(rules) > MAX_RULES:
        found = looked_up(rules)(host, path)
        return found["rule"], found["verdict"]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def looked_up(rules: tuple) -> Callable:
    """The same by a table of the rules' hosts, for long lists."""
    table: dict[str, list[tuple[int, int, str, str, str]]] = {}
    for k, (kind, text) in enumerate(rules):
        own, slash, tail = text.partition("/")
        table.setdefault(own, []).append((len(text), k, slash + tail, text, kind))

    @F.pandas_udf("rule string, verdict string")
    def run(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        out = []
        for host, path in zip(hosts, paths, strict=True):
            labels = host.split(".")
            fits = [r for i in range(len(labels)) for r in table.get(".".join(labels[i:]), ()) if path.startswith(r[2])]
            out.append(max(fits)[3:] if fits else (None, None))
        return pd.DataFrame(out, columns=["rule", "verdict"], dtype=object)

    return run


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits: one pass over the sorted characters, run by run."""
    n = F.greatest(F.length(text), F.lit(1))
    state = lambda char, run, bits: F.struct(char.alias("char"), run.alias("run"), bits.alias("bits"))
    ended = lambda a: a["bits"] + F.when(a["run"] > 0, -(a["run"] / n) * F.log2(a["run"] / n)).otherwise(0.0)
    step = lambda a, c: F.when(a["char"] == c, state(a["char"], a["run"] + 1, a["bits"])).otherwise(state(c, F.lit(1.0), ended(a)))
    found = F.aggregate(F.sort_array(F.split(text, "")), state(F.lit(""), F.lit(0.0), F.lit(0.0)), step, ended)
    return F.coalesce(found, F.lit(0.0))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL's text; null URLs count as empty."""
    url = F.coalesce(url, F.lit(""))
    count = lambda c, p: F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.length(url).cast("double")
    return {
        "length": n,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"),
        "labels": count(host, r"\.") + 1,
        "digits": count(url, "[0-9]") / F.greatest(n, F.lit(1.0)),
        "entropy": entropy(F.concat(host, path)),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "query_length": F.length(query).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https")).cast("double"),
        "hyphens": count(host, "-"),
        "host_digits": count(host, "[0-9]"),
    }


def judge(pages: DataFrame, rules: tuple = RULES, labels: Column | None = None, url_col: str = "url", sample_rows: int = SAMPLE_ROWS, trees: int = 12, depth: int = 4, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), and block_score of the trees.

    labels: a column of pages that is 1 for blocked, 0 for allowed URLs and null for unlabelled ones (default: the
    rules' verdicts). The trees are fitted on about sample_rows distinct labelled URLs picked by hash, at most half of
    them of a kind; copies of a URL count as its weight. With labels of one kind or none, the score is that kind's (or 0)
    for every URL. Null URLs and those without :// have an empty host and path and are judged like others, as are URLs of
    any length. Repeated rows stay; columns of the same names are replaced; empty tables give no rows.
    """
    added = {"host", "path", "rule", "verdict", "block_score"}
    own = [c for c in pages.columns if c == url_col or c.lower() not in added]
    names = ["u", "y", "v", "bucket", "part", "features", "probability", "raw", "guess", "copies", "weight", "b", "p", "head"]
    u, y, v, bucket, part, features, prob, raw, guess, copies, weight, b, p, head = unused(pages, *[f"__{n}" for n in names])
    host, path = host_and_path(F.col(u))
    rows = pages.withColumns({u: F.col(url_col).cast("string"), y: (F.lit(None) if labels is None else labels).cast("double")}).select(*own, u, y).withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, v: verdict})
    if labels is None:
        rows = rows.withColumn(y, F.when(F.col(v) == "block", 1.0).when(F.col(v) == "allow", 0.0))
    suffix = F.element_at(F.split("host", r"\."), -1)
    last, first = (F.pmod(h, F.lit(SUFFIX_BUCKETS)).cast("int") for h in (F.xxhash64(suffix), F.xxhash64(suffix, F.regexp_extract("path", "^/([^/]*)/", 1))))
    fold = F.when(F.col(y).isNull(), FOLDS).otherwise(F.floor(unit_hash(F.col(u), seed=71) * FOLDS)).cast("int")
    rows = rows.withColumns({bucket: last, head: first, part: fold})
    # Distinct URLs of each kind, near enough for a rate.
    kinds = [F.approx_count_distinct(F.when(F.col(y) == k, F.col(u))).alias(f"urls_{k}") for k in (0, 1)]
    # At most 2 * SUFFIX_BUCKETS * (FOLDS + 1) rows, whatever the size of pages.
    both = rows.select(F.posexplode(F.array(bucket, head)).alias("kind", b), F.col(part).alias(p), y)
    stats = both.groupBy("kind", b, p).agg(F.count(F.lit(1)).alias("n"), F.count(y).alias("known"), F.coalesce(F.sum(y), F.lit(0.0)).alias("bad"))
    stats = cut_lineage(stats)
    total = stats.where("kind = 0").agg(F.sum("n"), F.sum("known"), F.sum("bad")).first()
    if not total[1] or total[2] in (0, total[1]):
        return finish(rows.withColumn("block_score", F.lit(1.0 if total[2] else 0.0)), own, v, threshold)
    base = total[2] / total[1]
    made = unused(pages, *[f"__{k}" for k in FEATURES])
    known, bad, n = (F.sum(c).over(Window.partitionBy("kind", b)) for c in ("known", "bad", "n"))
    stats = stats.select("kind", b, p, (n / total[0]).alias("share"), ((bad - F.col("bad") + 10 * base) / (known - F.col("known") + 10)).alias("block"))
    kinds_of = [stats.where(F.col("kind") == k).select(F.col(b).alias(f"{b}{k}"), F.col(p).alias(f"{p}{k}"), F.col("share").alias(made[2 * k - 4]), F.col("block").alias(made[2 * k - 3])) for k in (0, 1)]
    columns = dict(zip(made, lexical(F.col(u), F.col("host"), F.col("path")).values(), strict=False))
    assembler = VectorAssembler(inputCols=made, outputCol=features)

    def seen(some: DataFrame) -> DataFrame:
        some = some.withColumns(columns)
        for k, (key, table) in enumerate(zip((bucket, head), kinds_of, strict=True)):
            some = some.join(F.broadcast(table), (F.col(key) == F.col(f"{b}{k}")) & (F.col(part) == F.col(f"{p}{k}")))
        return assembler.transform(some)

    urls = rows.agg(*kinds).first()
    rates = [min(1.0, sample_rows / 2 / max(1, urls[k])) for k in (0, 1)]
    rate = F.when(F.col(y) == 1, rates[1]).otherwise(rates[0])
    # Copies of a URL are one row with their number as weight.
    chosen = rows.where(F.col(y).isNotNull() & (unit_hash(F.col(u), seed=7) < rate)).groupBy(u, "host", "path", bucket, head, part, y).agg(F.count(F.lit(1)).alias(copies))
    sample = cut_lineage(seen(chosen.repartition(4)).select(features, y, (F.col(copies) / rate).alias(weight)))
    if sample.select(y).distinct().count() < 2:
        return finish(rows.withColumn("block_score", F.lit(base)), own, v, threshold)
    trainer = GBTClassifier(featuresCol=features, labelCol=y, weightCol=weight, maxIter=trees, maxDepth=depth, maxBins=32, seed=7, predictionCol=guess)
    model = trainer.setProbabilityCol(prob).setRawPredictionCol(raw).fit(sample)
    out = model.transform(seen(rows)).withColumn("block_score", vector_to_array(prob)[1])
    return finish(out, own, v, threshold)


def finish(rows: DataFrame, own: list[str], judged: str, threshold: float) -> DataFrame:
    verdict = F.coalesce(F.col(judged), F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return rows.withColumn("verdict", verdict).select(*[c for c in own if c not in ("host", "path", "rule")], "host", "path", "rule", "verdict", "block_score")
