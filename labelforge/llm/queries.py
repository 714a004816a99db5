"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import (
    collocations,
    decontaminate,
    html_text,
    language,
    mixing,
    near_duplicates,
    packing,
    quality_model,
    quality_rules,
    secrets,
    toxicity,
    url_filter,
    whitening,
)
from labelforge.sources.tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and boosted trees over every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies over all documents."""
    return near_duplicates.groups(table(spark, sf_dir, "documents")).drop("cls", "tie")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the character language-model ratio, over every page url."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curriculum mix of all documents, sorted by first reading."""
    return mixing.mixed_documents(mixing.curriculum(table(spark, sf_dir, "documents")))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword embedding score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, *quality_model.train(docs, table(spark, sf_dir, "labels")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, weak ones linked within scopes."""
    return secrets.secret_digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to four words that belong together, per lang."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first eight whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids, along a Hilbert curve."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


LLM_QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_near_duplicates, op3_url_filter, op4_toxicity, op5_curriculum_mix, op6_quality_model, op7_language,
    op8_secret_scan, op9_html_text, op10_decontaminate, op11_collocations, op12_whitening, op13_packing)}
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The others hold a learned model or Spark's own hashes; tests/llm has plain versions.
LLM_ORACLE: dict[str, str] = {
    "op2_near_duplicates": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id""",
    "op10_decontaminate": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
                                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, list_slice(w, k, k + 9) AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d),
spots AS (SELECT doc_id, p, l, list_slice(w, p, p + l - 1) AS g FROM p, (SELECT DISTINCT len(win) AS l FROM win)),
hits AS (SELECT doc_id, p, l, item FROM spots JOIN win ON g = win.win),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + l - 1)) AS q FROM hits) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS it FROM hits GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(len(it), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(it, ','), '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM spots, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
total AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS p, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(p, 1, cut), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(p, cut + 1, len(p)), ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, f, array_to_string(list_slice(string_split(phrase, ' '), i, i + m - 1), ' ') AS phrase
  FROM f, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE k > m AND i + m - 1 <= k),
around AS (SELECT lang, phrase, max(f) AS most FROM inner_parts GROUP BY 1, 2),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM worst w LEFT JOIN around s ON s.lang = w.lang AND s.phrase = w.phrase
  WHERE s.most IS NULL OR 100 * s.most < 80 * w.a)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
