"""The opN_ queries of this subpackage and the SQL of those that SQL can express."""

from . import bpe, html, mixing, quality, secrets, simhash, substring, telephony, toxicity, vafile


def queries():
    return {
        "op1_substring_dedup": substring.query,
        "op2_simhash": simhash.query,
        "op3_bpe": bpe.query,
        "op4_html": html.query,
        "op5_mixing": mixing.query,
        "op6_toxicity": toxicity.query,
        "op7_vafile": vafile.query,
        "op8_telephony": telephony.query,
        "op9_quality": quality.query,
        "op10_secrets": secrets.query,
    }


def oracle_sql():
    return {"op1_substring_dedup": SUBSTRING_SQL, "op5_mixing": mixing.SQL, "op7_vafile": vafile.SQL}


SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, list_slice(words, i, i + 12) AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit
), g AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE list_filter(words, lambda x, p: NOT list_contains(ps, p)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
