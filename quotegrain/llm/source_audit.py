"""Source divergence audit: how far the word use of a source is from other sources' and from its language's.

1. Identical texts of a language are one text with the number of its copies in each source, so copies are neither
   tokenized again nor sent again. Numbers of copies and one text of each are summed before they are sent.
2. Each text is tokenized once; its terms count once for each copy in document frequencies and in counts.
3. Terms in few documents of their language go. What is left are counts above zero by (language, source, term).
4. Pairs of sources are evaluated on these only. With p at count 0 written p0, a pair's sum over all terms is
   V f(a0, b0), plus the sum of f(a, b0) - f(a0, b0) over the terms of one, likewise of the other, plus
   f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0) over terms that both have. The middle sums need each different p of a
   source once, with its number of terms; only the last needs a join of terms.

All numbers are integers, and divisions are integer divisions.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shuffle_parts, written

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Counts that a task holds before it sends them.
_HELD = 400_000
#: Groups of which a broadcast table of groups may have so many, at about 100 bytes each; beyond, tables are joined by shuffles.
_FEW_GROUPS = 50_000
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lower-cased, in UTF-8."""
    return _TERM.findall((text or "").encode().lower())


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, copies: array<struct<source, k>>): the different texts of each language."""
    named = docs.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), F.col("text"))})
    key = ["lang", "d1", "d2"]
    per = named.groupBy(*key, "source").agg(F.count("*").alias("k")).groupBy(*key).agg(F.collect_list(F.struct("source", "k")).alias("copies"))
    texts = named.groupBy(*key).agg(F.first("text").alias("text"))
    return texts.join(per, key).select("lang", "text", "copies")


def _counted(texts: DataFrame) -> DataFrame:
    """(lang, term, source, df, n: a value for each source) of each different text's terms, summed as far as a task holds them."""
    kind = pa.list_(pa.int64())

    def batches_of(dfs, ns):
        """A row for each language and term, so that a term is sent once for all its sources."""
        names = ["lang", "term", "source", "df", "n"]
        sizes = np.array([len(per) for per in dfs.values()], np.int64)
        repeated = lambda k: pa.array([at[k] for at in dfs], pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        terms = pa.array([t for per in dfs.values() for t in per], pa.binary()).cast(pa.string())
        df = pa.array([k for per in dfs.values() for k in per.values()], pa.int64())
        n = pa.array([ns[at][t] for at, per in dfs.items() for t in per], pa.int64())
        table = pa.table([repeated(0), terms, repeated(1), df, n], names)
        met = table.group_by(["lang", "term"]).aggregate([(c, "list") for c in names[2:]]).select(["lang", "term", "source_list", "df_list", "n_list"])
        schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.list_(pa.string())), ("df", kind), ("n", kind)])
        yield from met.rename_columns(names).cast(schema).to_batches(10_000)

    def run(batches):
        dfs, ns, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, text, copies in zip(*(batch.column(c) for c in range(3)), strict=True):
                lang, terms = lang.as_py(), terms_of(text.as_py())
                found = set(terms)
                for copy in copies.as_py():
                    at, k = (lang, copy["source"]), copy["k"]
                    if k == 1:
                        dfs[at].update(found)
                        ns[at].update(terms)
                    else:
                        dfs[at].update(dict.fromkeys(found, k))
                        ns[at].update({t: k * c for t, c in Counter(terms).items()})
                    held += len(found)
                if held > _HELD:
                    held = sum(map(len, dfs.values()))
                    if held > _HELD // 2:
                        yield from batches_of(dfs, ns)
                        dfs.clear(), ns.clear()
                        held = 0
        yield from batches_of(dfs, ns)

    return texts.mapInArrow(run, "lang string, term string, source array<string>, df array<long>, n array<long>")


def _p(count: str, n: str, v: str) -> Column:
    """1 + floor(SCALE (count + 2) / (n + 2 v)); null without terms."""
    d = "decimal(28, 0)"
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + ({SCALE} * CAST({count} + 2 AS {d})) div CAST({n} + 2 * {v} AS {d}) END")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _met(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, keys)


def divergence(
    df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP
) -> DataFrame:
    """Returns lang, source, part, item, value, rank: for each source of a language its divergence from each other source
    (part ``pair``), and its ``top`` terms that are more frequent than in the language as a whole (part ``term``).

    Terms in at least ``least_docs`` documents of a language count; p(t) = 1 + floor(10^9 (n + 2) / (N + 2 V)), and the
    divergence of p and q is floor((p - q)^2 / (p + q)), summed over the terms. Ties go by item. Null texts, languages
    and sources are empty ones. Repeated rows count each. A language without such terms has pairs of value 0 and no
    terms, one with a single source has no pairs, an empty table gives an empty result. Other columns are ignored.
    """
    empty = F.lit("")
    docs = df.select(F.coalesce(lang_col, empty).alias("lang"), F.coalesce(source_col, empty).alias("source"), F.coalesce(text_col, empty).alias("text"))
    # dealt once, by term: a term has a row from each task that met it, then one for each source
    dealt = _counted(collapsed(docs)).repartition(shuffle_parts(df.sparkSession), "lang", "term")
    each = dealt.select("lang", "term", F.explode(F.arrays_zip("source", "df", "n")).alias("c")).select("lang", "term", "c.*")
    sums = each.groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    of_term = Window.partitionBy("lang", "term")
    kept = sums.withColumns({"docs": F.sum("df").over(of_term), "total": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    kept = written(kept.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "total", "first"), "terms")

    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("big_n"), F.count_if("first").alias("v"))
    found = docs.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").na.fill(0)
    found = written(found, "found")
    of_lang = found.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("big_n").alias("lang_n"))
    groups = found.select("lang", "source", "big_n").join(of_lang, "lang").withColumn("p0", _p("0L", "big_n", "v"))
    groups = written(groups, "groups")
    few = groups.count() <= _FEW_GROUPS

    terms = _met(kept, groups, ["lang", "source"], few).withColumns({"p": _p("n", "big_n", "v"), "q": _p("total", "lang_n", "v")})
    terms = written(terms.select("lang", "source", "term", "p", "q", "p0"), "shares")
    best = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))

    pair = ["lang", "a", "b"]
    a, b = (groups.select("lang", F.col("source").alias(x), F.col("p0").alias(f"{x}0"), "v") for x in "ab")
    whole = _met(a, b.drop("v"), ["lang"], few).where("a < b").select(*pair, F.expr(f"coalesce(v * ({_f('a0', 'b0')}), 0L)").alias("value"))
    steps = terms.groupBy("lang", F.col("source").alias("x"), F.col("p0").alias("x0"), "p").agg(F.count("*").alias("k"))
    others = groups.select("lang", F.col("source").alias("y"), F.col("p0").alias("y0"))
    one = _met(steps, others, ["lang"], few).where("x <> y").select(
        "lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.expr(f"k * ({_f('p', 'y0')} - {_f('x0', 'y0')})").alias("value")
    )
    a, b = (terms.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p{x}"), F.col("p0").alias(f"{x}0")) for x in "ab")
    both = a.join(b, ["lang", "term"]).where("a < b").select(
        *pair, F.expr(f"{_f('pa', 'pb')} - {_f('pa', 'b0')} - {_f('a0', 'pb')} + {_f('a0', 'b0')}").alias("value")
    )
    # each summed before they meet: as many rows as there are pairs
    parts = [x.groupBy(*pair).agg(F.sum("value").alias("value")) for x in (whole, one, both)]
    value = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*pair).agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = value.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = pairs.withColumn("rank", rank).unionByName(best.withColumn("rank", rank).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
