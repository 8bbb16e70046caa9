"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes, then confirmed.

A URL is expanded into one expression for each suffix of its host (on label boundaries) and each prefix of its path
that ends in ``/`` (and the empty one), as deep as any rule is. A rule is filed under its host and the part of its path up to the last ``/``;
what follows is confirmed with the full digest. So any rule path is a plain string prefix, whatever it ends in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RULE_SCHEMA = "host string, path string, verdict string"

#: Bytes of a digest that the join uses.
PREFIX_BYTES = 4


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: str, labels: int) -> Column:
    """The last 1, 2, ... and at most ``labels`` labels of a host column."""
    many = f"least({labels}, length({host}) - length(replace({host}, '.', '')) + 1)"
    return F.expr(f"transform(sequence(1, {many}), i -> substring_index({host}, '.', -i))")


def _prefixes(path: str, slashes: int) -> Column:
    """The empty prefix of a path column, and those that end in its first ``slashes`` slashes."""
    many = f"least({slashes}, length({path}) - length(replace({path}, '/', '')))"
    return F.expr(f"transform(sequence(0, {many}), i -> if(i = 0, '', substring_index({path}, '/', i) || '/'))")


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """Returns id, host, path, rule, verdict for every row of ``df``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule wins (host and path together), of equally long ones a block, then the greater text. No rule:
    ``rule`` is null and the verdict is ``default``. A null url, or one without ``://``, has an empty host and path and
    fits no rule with a host. Rules with a null verdict or host are left out, a null path is empty. Repeated rows are
    judged each; an empty table gives an empty result. Other columns of ``df`` are ignored, so their names can't clash.

    A URL is expanded as far as the rules go: to the most labels and slashes that any has, so a long host or path costs
    no more than a short one. Rows are joined on expression hashes: distinct (host, path expression) pairs are matched, not rows, so a hot host
    costs as much as any other. Catalyst broadcasts the rules only while its own size estimate allows it.
    """
    urls = df.select(F.col(id_col).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    filed = (
        rules.where("host is not null and verdict is not null")
        .select(F.translate("host", _UPPER, _UPPER.lower()).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .withColumn("rule_digest", _digest(F.col("rule_host"), F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0)))
        .withColumn("prefix", F.substring("rule_digest", 1, 2 * PREFIX_BYTES))
        .distinct()
    )
    most = filed.agg(
        F.max(F.size(F.split("rule_host", r"\.", -1))), F.max(F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/"), F.lit(""))))
    ).first()
    labels, slashes = most[0] or 1, most[1] or 0
    # A rule's path may continue past its last slash, so whole paths are kept for confirmation.
    hits = (
        urls.select("host", "path").distinct()
        .withColumn("suffix", F.explode(_suffixes("host", labels)))
        .withColumn("folder", F.explode(_prefixes("path", slashes)))
        .withColumn("digest", _digest(F.col("suffix"), F.col("folder")))
        .withColumn("prefix", F.substring("digest", 1, 2 * PREFIX_BYTES))
        .join(filed, "prefix")
        .where((F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    )
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), (F.col("rule_verdict") == "block").cast("int"))
    text = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct(text.alias("rule"), F.col("rule_verdict").alias("verdict")), F.struct(rank, text)).alias("best")
    )
    return (
        urls.join(best, ["host", "path"], "left")
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)
