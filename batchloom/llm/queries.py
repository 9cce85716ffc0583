"""The registered queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, bpe, centroids, embed_dedup, langid, mixing, phrases, quality, simhash, substring, token_count, toxicity, url_filter
from .common import table

URL_RULES = [
    url_filter.Rule("com/en/", "block"),
    url_filter.Rule("example.com/en/7", "allow"),
    url_filter.Rule("net/de/", "allow"),
    url_filter.Rule("example.net/de/8", "block"),
    url_filter.Rule("org/es/", "block"),
]


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, as digests. A null text is empty; rows with equal ids are judged one by one."""
    coded = bpe.transcode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the rows that are not held out. Null and letterless texts are "und" with score 0."""
    docs = table(spark, sf_dir, "documents")
    learned = langid.learn_profiles(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, learned).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95. Null, zero and non-finite vectors link with nothing."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text, learned from labels that are not held out. A null text is empty."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.learn_weights(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base conditions and the method's verdict for every text. A null text has no words and fails."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all texts that earlier documents have. Null texts and null ids have none."""
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text. A null text is empty."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all texts at two bits. Texts without a word have fingerprint zero and are linked."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. A null text has size 0, a null source is one of its own."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url. A null url has an empty host and path."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors with 64 finite components, after ten rounds. Other vectors have no row."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, salt="3")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language, phrases of up to five words that occur 100 times. A null lang is "und"."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, within=100, top=2000)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens. A null text is empty; repeated rows are documents of their own."""
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = (op1_bpe_roundtrip, op2_language_id, op3_embedding_near_dedup, op4_toxicity, op5_quality_rules, op6_substring_dedup, op7_token_counts, op8_simhash_near_dedup, op9_source_mixing, op10_url_filter, op11_centroid_clustering, op12_phrase_mining, op13_best_fit_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule_host, rule_path, action) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
judged AS (
  SELECT p.page_id, p.host, p.path,
    (SELECT max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, action := action)) FROM rules
     WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS best
  FROM parts p)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.action, CASE WHEN regexp_matches(host, '(^|[.-])(adult|bets?|casino|gambling|lottery|pills|poker|porn|replica|slots|spam|torrent|viagra|warez|xxx|ads-track|cheap-meds|click-farm|link-farm|payday-loans?)(-[^.]*)?\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, s AS size, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (
    SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS s))),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT f.lang, f.size, f.phrase, f.a, l.a AS l, r.a AS r, t.n, k, 1000::HUGEINT * f.a * t.n // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1) f
  JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.w[:k], ' ') JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.w[k + 1:], ' ')
  JOIN totals t ON t.lang = f.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM (
    SELECT lang, a, w, s, unnest(range(1, size - s + 2)) AS i FROM (SELECT lang, a, size, string_split(phrase, ' ') AS w, unnest(range(2, size)) AS s FROM f WHERE size > 2)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * i.most < 100 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept)
WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": OP10_SQL, "op12_phrase_mining": OP12_SQL}
