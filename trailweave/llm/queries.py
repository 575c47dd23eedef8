"""Registered queries of the corpus operators; SQL where SQL can express the whole query."""

from __future__ import annotations

from . import media, packing, passages, quality, secrets, simhash, tokens, toxicity, urls, warc

QUERIES = {
    "op1_suffix_array_dedup": passages.query,
    "op2_secret_scans": secrets.query,
    "op3_toxicity": toxicity.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_byte_level_bpe": tokens.query,
    "op6_best_fit_packing": packing.query,
    "op7_quality_rules": quality.query,
    "op8_warc": warc.query,
    "op9_media_columns": media.query,
    "op10_url_filters": urls.query,
}

_FIVE_BITS = " + ".join(f"{1 << 4 - b} * CAST(substr(bits, 5 * i + {b + 1}, 1) AS INTEGER)" for b in range(5))

ORACLE_SQL: dict[str, str] = {
    "op8_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, min(page_id) OVER (PARTITION BY body) AS least, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + {_FIVE_BITS} AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN least = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN least <> page_id THEN least END AS refers_to
FROM d""",
}
