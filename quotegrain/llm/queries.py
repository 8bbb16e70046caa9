"""The corpus operators as queries over the given tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprint_index, lang_id, line_dedup, periodic_runs, simhash, source_audit, suffix_dedup, token_count, url_filter, vptree, warc

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), keep_text=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.remove_repeated_windows(_read(spark, sf_dir, "documents"), keep_text=False)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_read(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.train(docs.where(~lang_id.held_out()))
    return lang_id.predict(docs.select("doc_id", "text", lang_id.held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), "word_bpe_49k.json", keep_ids=False)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_report(warc.round_trip(_read(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), url_filter.rules_frame(spark, RULES))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_read(spark, sf_dir, "documents"), plant=True, keep=False)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_common_lines(_read(spark, sf_dir, "documents"), keep_text=False).drop("keep")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_substring_dedup, op3_token_counts, op4_nearest_neighbours, op5_language_id, op6_simhash, op7_bpe, op8_decontamination, op9_warc, op10_url_filter, op11_periodic_runs, op12_line_dedup, op13_source_audit)
}

_OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(range(0, length(h) // 2 - 49)) AS t(i)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w JOIN f USING (s) WHERE first < doc_id),
k AS (SELECT r, i, sum((before IS NULL OR i > before + 50)::INTEGER) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
spans AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY r, k),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans),
kept AS (SELECT r, sum(b - a)::BIGINT AS gone, count(*) AS n, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS front FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_OP8_SQL = r"""
WITH words AS (SELECT 'item' AS side, item_id AS id, row_number() OVER () AS r, lower(text) AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
               UNION ALL SELECT 'doc', doc_id, row_number() OVER (), lower(text) FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT side, id, r, list_filter(string_split_regex(regexp_replace(t, '([\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}])', ' \1 ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM words),
nn AS (SELECT DISTINCT least(len(ws), {window}) AS n, CASE WHEN len(ws) >= {window} THEN {most} ELSE {few} END AS most FROM w WHERE side = 'item' AND len(ws) >= {least}),
-- a window of n words that differs in so many has one part of most + 1 unchanged
v AS (SELECT side, id, r, n, most, i, list_slice(ws, i + 1, i + n) AS v FROM w JOIN nn ON len(ws) >= n AND (side = 'doc' OR n = least(len(ws), {window})), unnest(range(0, len(ws) - n + 1)) AS t(i)),
p AS (SELECT *, list_slice(v, j * n // (most + 1) + 1, (j + 1) * n // (most + 1)) AS key FROM v, unnest(range(0, most + 1)) AS t(j)),
m AS (SELECT a.id AS doc_id, a.r, b.id AS item_id, a.i, a.n, a.most, list_sum(list_transform(range(1, a.n + 1), lambda x: (a.v[x] <> b.v[x])::INTEGER)) AS wrong
      FROM p a JOIN p b ON a.side = 'doc' AND b.side = 'item' AND a.n = b.n AND a.j = b.j AND a.key = b.key),
o AS (SELECT doc_id, r, item_id, i, n, min(wrong) AS wrong FROM m WHERE wrong <= most GROUP BY ALL)
SELECT doc_id, item_id, count(*) AS n_windows, min(i)::BIGINT AS first_word, max(i + n - 1)::BIGINT AS last_word, min(wrong)::BIGINT AS substitutions FROM o GROUP BY doc_id, item_id
""".format(window=decontaminate.WINDOW, most=decontaminate.SUBSTITUTIONS, few=decontaminate.SHORT_SUBSTITUTIONS, least=decontaminate.LEAST_WORDS)

_OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS s FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
least AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN least USING (s), range(0, 13) AS r(k) WHERE least < doc_id),
per AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT coalesce(list_contains(gone, i), false)), lambda i: ws[i]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""

_OP4_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT b, min(page_id) AS first FROM p GROUP BY b),
n AS (SELECT page_id, octet_length(b) AS payload_bytes, first, list_transform(range(0, 8), lambda g: ('0x' || substr(h, g * 5 + 1, 5))::BIGINT) AS q FROM p JOIN d USING (b))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((q[i // 4 + 1]) >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM n
"""

_OP10_SQL = """
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM s),
m AS (SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, rule_verdict = 'block' DESC, rule_host || rule_path DESC) AS k
      FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT u.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND k = 1
""".format(rules=", ".join(str(r) for r in RULES))

_OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
hot AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= {chars} AND doc_id IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= {docs}),
j AS (SELECT r, l.doc_id, i, line, coalesce(l.doc_id < last, false) AS gone FROM l LEFT JOIN hot ON l.k = hot.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
""".format(chars=line_dedup.LEAST_CHARS, docs=line_dedup.LEAST_DOCS)

_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {docs}),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n, total FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
own AS (SELECT lang, source, sum(n)::HUGEINT AS big_n FROM full_ GROUP BY ALL),
p AS (SELECT lang, source, term, f.n, 1 + ({scale}::HUGEINT * (f.n + 2)) // (big_n + 2 * v) AS p, 1 + ({scale}::HUGEINT * (total + 2)) // (size.n + 2 * v) AS q
      FROM full_ f JOIN own USING (lang, source) JOIN size USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= {top}
""".format(docs=source_audit.LEAST_DOCS, scale=source_audit.SCALE, top=source_audit.TOP)

ORACLE_SQL = {"op1_suffix_dedup": _OP1_SQL, "op2_substring_dedup": _OP2_SQL, "op4_nearest_neighbours": _OP4_SQL, "op8_decontamination": _OP8_SQL, "op9_warc": _OP9_SQL, "op10_url_filter": _OP10_SQL, "op12_line_dedup": _OP12_SQL, "op13_source_audit": _OP13_SQL}
