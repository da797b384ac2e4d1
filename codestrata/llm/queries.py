"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from codestrata.llm import (
    bpe, conversations, decontamination, html, jaccard, licenses, lm, quality, sharding, substrings, suffixes, toxicity, whitening
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.query,
    "op2_bpe": bpe.query,
    "op3_ngram_jaccard": jaccard.query,
    "op4_substring_dedup": substrings.query,
    "op5_lm_scoring": lm.query,
    "op6_suffix_array_dedup": suffixes.query,
    "op7_quality_rules": quality.query,
    "op8_toxicity": toxicity.query,
    "op9_decontamination": decontamination.query,
    "op10_sharding": sharding.query,
    "op11_html_extraction": html.query,
    "op12_conversation_repair": conversations.query,
    "op13_embedding_whitening": whitening.query,
    "pipeline": corpus_pipeline.run,
}

#: Windows of 50 words that also start in a document with a smaller id take their words out.
REPEATS = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), places AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM words
), windows AS (
  SELECT doc_id, i, ws[i] AS word,
    CASE WHEN i + 49 <= len(ws) THEN sha256(array_to_string(ws[i:i + 49], ' ')) END AS w
  FROM places
), owners AS (
  SELECT w, min(doc_id) AS owner FROM windows WHERE w IS NOT NULL GROUP BY w
), marked AS (
  SELECT windows.doc_id, i, word, max(CASE WHEN owner < windows.doc_id THEN 1 ELSE 0 END)
    OVER (PARTITION BY windows.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN owners USING (w)
), sums AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op4_substring_dedup": REPEATS, "op6_suffix_array_dedup": REPEATS}
