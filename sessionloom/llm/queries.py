"""One query for each operator, over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, collocations, decontam, language, packing, quality, repeats, secrets, simhash, url_rules, whitening, wrappers
from sessionloom.llm.common import temporary


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page by its host's wrapper."""
    return wrappers.extract_pages(_read(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, by family, then within it."""
    docs = _read(spark, sf_dir, "documents")
    return language.language_id(docs, language.fit(docs))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url: listed rules, else rules mined from `labels` of the pages' ids."""
    pages, labels = _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")
    bad = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.select("page_id", "url").join(bad, F.col("page_id") == F.col("doc_id")).select("page_id", "url", "bad")
    return url_rules.filter_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of each document."""
    return simhash.simhash_dedup(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document occurs in `benchmark`."""
    out = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document, through a ledger that starts empty."""
    return secrets.digest(secrets.scan_secrets(_read(spark, sf_dir, "documents"), temporary(spark, "ledger")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of each document, by rules learned from `labels`."""
    docs = _read(spark, sf_dir, "documents")
    out = quality.quality_rules(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after copies of 20-word windows are removed, for each document."""
    out = repeats.substring_dedup(_read(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n AS n_words", "n_removed", "kept_sha256")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, ids and decoded bytes of each document under a byte-level BPE."""
    import public_tokenizers

    return bpe.byte_bpe(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after every repeated 200-byte string is removed, for each document."""
    out = repeats.suffix_array_dedup(_read(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n AS n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first whitened components; a deviation that is no long is null."""
    out = whitening.whitening(_read(spark, sf_dir, "embeddings"))
    return out.selectExpr("vec_id", "component", "n", "try_cast(deviation AS long) AS deviation", "whitened", "explained", "identity_error")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.best_fit_packing(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op6_secret_scan alone, which SQL can say."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def secret_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's paths after two runs: texts of one language come in an older version first."""
    docs, ledger = _read(spark, sf_dir, "documents"), temporary(spark, "ledger")
    older = docs.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit(" (draft)"))).otherwise(F.col("text")))
    for version in (older, docs):
        secrets.update_ledger(version, ledger)
    return secrets.read_paths(spark, ledger)


def secret_path_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What new rules find in all versions of all documents, those that are gone too, of a ledger filled under other rules."""
    docs, ledger = _read(spark, sf_dir, "documents"), temporary(spark, "ledger")
    older = docs.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit(" token=abcdefgh"))).otherwise(F.col("text")))
    for version in (older, docs):
        secrets.update_ledger(version, ledger, secrets.RULES[:1])
    secrets.rescan(spark, ledger)
    return secrets.digest(secrets.findings_of_paths(spark, ledger), "version").select("doc_id", "version", "n_assign", "n_access", "n_hex")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base verdict of op7_quality_rules alone, which SQL can say."""
    out = quality.quality_rules(_read(spark, sf_dir, "documents"), [])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    f.__name__: f
    for f in (
        secret_counts,
        secret_history,
        secret_path_findings,
        quality_counts,
        op1_html_extraction,
        op2_language_id,
        op3_url_filter,
        op4_simhash_dedup,
        op5_decontamination,
        op6_secret_scan,
        op7_quality_rules,
        op8_substring_dedup,
        op9_byte_bpe,
        op10_suffix_array_dedup,
        op11_embedding_whitening,
        op12_phrase_collocations,
        op13_best_fit_packing,
    )
}

#: Words of each document, as DuckDB lists.
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '')"

#: The same for decontamination: letters, digits and everything beyond ASCII, A-Z lower-cased.
_FOLDED = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = {
    # labels of the given tables do not depend on URLs, so no mined rule stands: the listed rule decides, else allow
    "op3_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT row_number() OVER () AS r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rule, host, start, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
best AS (
  SELECT r, arg_max(rules.rule, length(rules.rule)) AS rule, arg_max(verdict, length(rules.rule)) AS verdict
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.start) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (r)
""",
    "op12_phrase_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, 1 AS m, unnest(ws) AS g FROM w
  UNION ALL SELECT lang, 2 AS m, unnest(list_transform(range(1, len(ws)), lambda s: ws[s] || ' ' || ws[s + 1])) AS g FROM w
  UNION ALL SELECT lang, 3 AS m, unnest(list_transform(range(1, len(ws) - 1), lambda s: ws[s] || ' ' || ws[s + 1] || ' ' || ws[s + 2])) AS g FROM w),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY lang, m, g HAVING count(*) >= 10),
candidate AS (SELECT *, string_split(g, ' ') AS ws FROM f WHERE m > 1),
parts AS (
  SELECT lang, m, g, f, 1 AS k, ws[1] AS x, array_to_string(ws[2 :], ' ') AS y FROM candidate
  UNION ALL SELECT lang, m, g, f, 2 AS k, ws[1] || ' ' || ws[2] AS x, ws[3] AS y FROM candidate WHERE m = 3),
cuts AS (
  SELECT c.lang, c.m, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.g = c.x JOIN f y ON y.lang = c.lang AND y.g = c.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
held AS (SELECT lang, g, max(f) AS longer FROM (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS g, f FROM candidate WHERE m = 3) GROUP BY lang, g),
ranked AS (
  SELECT best.lang, best.g AS phrase, a, l, r, score
  FROM best LEFT JOIN held ON held.lang = best.lang AND held.g = best.g WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) QUALIFY rank <= 2000
""",
    "op10_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT r, s, md5_number(substr(h, 2 * s + 1, 400)) AS k
  FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS s FROM d WHERE length(h) >= 400)),
again AS (SELECT r, s FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
starts AS (SELECT r, s, s > coalesce(lag(s) OVER (PARTITION BY r ORDER BY s), -1000) + 200 AS fresh FROM again),
runs AS (SELECT r, s, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY s) AS g FROM starts),
spans AS (SELECT r, g, min(s) AS a, max(s) + 200 AS b FROM runs GROUP BY r, g),
cuts AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS p, lead(a) OVER (PARTITION BY r ORDER BY a) AS q FROM spans),
kept AS (
  SELECT d.r, count(*) AS n_spans, sum(b - a) AS n_removed,
         string_agg(substr(h, 2 * p + 1, 2 * (a - p)) || CASE WHEN q IS NULL THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS t
  FROM cuts JOIN d ON d.r = cuts.r GROUP BY d.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
""",
    "secret_counts": r"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
FROM documents
""",
    "secret_path_findings": r"""
WITH old AS (SELECT DISTINCT doc_id, coalesce(CASE WHEN lang = 'de' THEN text || ' token=abcdefgh' ELSE text END, '') AS t FROM documents),
new AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
versions AS (SELECT doc_id, CAST(1 AS INT) AS version, t FROM old UNION ALL SELECT doc_id, CAST(2 AS INT) AS version, t FROM new ANTI JOIN old USING (doc_id, t))
SELECT doc_id, version,
  CAST(len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
FROM versions
""",
    "secret_history": r"""
WITH old AS (SELECT DISTINCT doc_id, sha256(coalesce(CASE WHEN lang = 'de' THEN text || ' (draft)' ELSE text END, '')) AS blob FROM documents),
new AS (SELECT DISTINCT doc_id, sha256(coalesce(text, '')) AS blob FROM documents)
SELECT doc_id, CAST(1 AS INT) AS version, blob FROM old
UNION ALL SELECT doc_id, CAST(2 AS INT) AS version, blob FROM new ANTI JOIN old USING (doc_id, blob)
""",
    "quality_counts": f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
windows AS (SELECT r, s, array_to_string(ws[s : s + 7], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS s FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, s FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(s, s + 8)) AS i FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(ws) AS base_failed
FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN dup ON w.r = dup.r
""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS ws FROM documents),
b AS (SELECT item_id, {_FOLDED} AS ws FROM benchmark),
tests AS (
  SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS k FROM (
    SELECT item_id, ws[s : s + 9] AS w FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS s FROM b WHERE len(ws) >= 10)
    UNION ALL SELECT item_id, ws FROM b WHERE len(ws) BETWEEN 1 AND 9)),
sizes AS (SELECT DISTINCT n FROM tests),
windows AS (
  SELECT doc_id, s, n, array_to_string(ws[s : s + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d JOIN sizes ON len(ws) >= n)),
found AS (SELECT doc_id, s, w.n AS n, item_id FROM windows w JOIN tests t ON w.n = t.n AND w.k = t.k),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op8_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(ws[s : s + 19], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
again AS (
  SELECT doc_id, s FROM windows
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM again),
kept AS (
  SELECT x.doc_id, count(*) AS n_kept, string_agg(x.word, ' ' ORDER BY x.i) AS txt
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) x
  ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i
  GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
       CAST(len(w.ws) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.txt, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
""",
}
