"""Registered queries of the corpus operators: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import decontaminate, fill_middle, html_extract, lm_score, mixing, near_dedup, packing, phrases, quality_classifier, quality_rules, secret_scan, token_store, url_filter
from marketlake.llm.encode import default_path
from marketlake.llm.shared import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, threshold=0.8)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    store = token_store.write_store(docs, scratch_path(spark, "tokens"), default_path("word_bpe_49k.json"), split="words", end_id=1)
    return store.read(docs.select("doc_id"), with_ids=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The rules of the query, as verdict and host/path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, default_path("byte_bpe_50k.json"), split="spaces", with_ids=False)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256")
    spans = secret_scan.listed(secret_scan.by_start(F.col("base"), F.col("random"))).alias("spans")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base, spans)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_token_store": op2_token_store,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_extraction": op4_html_extraction,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_lm_score": op10_lm_score,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_mixing": op13_source_mixing,
}

def _grams(n: int) -> str:
    return f"SELECT lang, words[i:i + {n - 1}] AS p FROM (SELECT lang, words, unnest(range(1, len(words) - {n - 2})) AS i FROM w WHERE len(words) >= {n})"


_PHRASES = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
 g AS (SELECT lang, p, count(*) AS f FROM (""" + " UNION ALL ".join(map(_grams, range(1, 6))) + r""") GROUP BY 1, 2 HAVING count(*) >= 100),
 t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY 1),
 s AS (SELECT lang, p, max(f) AS longer FROM (SELECT lang, f, unnest([p[:-2], p[2:]]) AS p FROM g WHERE len(p) > 2) GROUP BY 1, 2),
 c AS (SELECT g.lang, g.p, g.f AS a, n, unnest(range(1, len(g.p))) AS k FROM g JOIN t USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.p = g.p WHERE len(g.p) > 1 AND (longer IS NULL OR 100 * longer < 100 * g.f)),
 b AS (SELECT c.*, x.f AS l, y.f AS r, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score FROM c JOIN g x ON x.lang = c.lang AND x.p = c.p[:k] JOIN g y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
 m AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, n, min(score) AS score, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r FROM b GROUP BY ALL)
 SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m) WHERE rank <= 2000"""

_FIM = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
 u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in range(4)] AS d FROM t),
 c AS (SELECT *, len(lines) AS n, least(d[1] % (len(lines) + 1), d[2] % (len(lines) + 1)) AS a, greatest(d[1] % (len(lines) + 1), d[2] % (len(lines) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT *, array_to_string(lines[:a], '') AS x, array_to_string(lines[a + 1:b], '') AS y, array_to_string(lines[b + 1:], '') AS z FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

_MIX = r"""WITH d AS (SELECT doc_id AS id, source IS NULL AS none, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(sha256('13:' || doc_id), 1, 15))::BIGINT AS key FROM documents),
 s AS (SELECT none, source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY none, source) - 1) % 3 + 1 AS w FROM d GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER r AS i, sum(3 * source_size) OVER r AS caps, sum(w) OVER () - sum(w) OVER r AS rest, sum(source_size) OVER () AS total FROM s WINDOW r AS (ORDER BY source_size::DOUBLE / w, none, source)),
 c AS (SELECT *, coalesce(lag(caps) OVER (ORDER BY i), 0) AS held, rest + w AS free FROM o),
 f AS (SELECT held, free, i FROM c WHERE 3 * source_size * free >= (total - held) * w ORDER BY i LIMIT 1),
 t AS (SELECT none, source, source_size, total, CASE WHEN c.i < f.i THEN (3 * source_size)::DOUBLE ELSE w::DOUBLE * (total - f.held)::DOUBLE / f.free::DOUBLE END AS target FROM c CROSS JOIN f),
 p AS (SELECT d.*, source_size, total, target, ceil(target)::BIGINT AS quota, row_number() OVER () AS row, sum(size) OVER (PARTITION BY none, source ORDER BY key, id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t USING (none, source)),
 k AS (SELECT *, e * source_size + start AS begins, least(size, quota - e * source_size - start) AS words FROM p CROSS JOIN range(3) AS g(e)),
 m AS (SELECT *, sum(words) OVER (ORDER BY (begins + words) / target, none, source, e, key, id, size ROWS UNBOUNDED PRECEDING) - words AS pos FROM k WHERE words > 0),
 n AS (SELECT row, sum(greatest(least(words, total - pos), 0)) AS taken FROM m GROUP BY 1)
 SELECT id AS doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN n USING (row)"""

ORACLE: dict[str, str] = {"op11_phrase_mining": _PHRASES, "op13_source_mixing": _MIX, "op12_fill_in_middle": _FIM}
