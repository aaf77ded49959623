"""Queries of this folder's operators and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dispatchlake.llm import boilerplate, components, encode, history, lookalike, packing, residue, spans, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": boilerplate.found,
        "p3_found": components.found,
        "p4_found": history.found,
        "p5_found": vectors.found,
        "p5_neighbours": vectors.neighbours,
        "p6_found": lookalike.found,
        "p6_forms": lookalike.forms,
        "p7_found": residue.found,
        "p8_ids": encode.ids,
        "p9_containers": packing.containers,
        "p9_report": packing.report,
        "p10_found": spans.found,
        "p10_shares": spans.shares,
    }


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3, "p5_found": P5, "p6_found": p6(), "p10_found": P10}


P3 = """
WITH RECURSIVE said AS (
  SELECT left_id a, right_id b FROM match_pairs WHERE is_same AND left_id IS NOT NULL AND right_id IS NOT NULL
  UNION SELECT n.item_id, c.first_item_id FROM news_items n JOIN clusters c USING (cluster_id) WHERE c.first_item_id IS NOT NULL),
e AS (SELECT a, b FROM said WHERE a <> b UNION SELECT b, a FROM said WHERE a <> b),
reach(v, w) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.v, e.b FROM reach r JOIN e ON e.a = r.w)
SELECT min(w) AS group_item_id, v AS item_id FROM reach GROUP BY v HAVING min(w) < v
"""

P5 = """
WITH v AS (SELECT DISTINCT vec_id, coalesce(model, '') AS model, embedding::DOUBLE[] AS e FROM item_vectors WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.model = b.model AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM c)
SELECT DISTINCT least(a, b) AS vec_lo, greatest(a, b) AS vec_hi FROM r WHERE rn <= 10
"""

P10 = """
WITH w AS (SELECT doc_id, p, md5(substr(text, p::BIGINT + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS p FROM (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200))),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), m AS (SELECT DISTINCT doc_id, p FROM w SEMI JOIN s USING (h)),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM m),
n AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS part FROM g)
SELECT doc_id, min(p)::INT AS span_start, (max(p) + 200)::INT AS span_end FROM n GROUP BY doc_id, part
"""


def p6() -> str:
    """Looks by plain translation: signs of one character, two ligatures and composed accents; enough for the test tables."""
    put = {c: t for c, t in lookalike.TWIN.items()} | dict(lookalike.SIGNS) | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    text = lambda x: x.replace("'", "''")
    gone = r"[\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"
    space = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    look = f"translate(nfc_normalize(replace(replace(regexp_replace(t, '{gone}', '', 'g'), 'ﬁ', 'fi'), 'ﬀ', 'ff')), '{text(''.join(put))}', '{text(''.join(put.values()))}')"
    return f"""
WITH t AS (SELECT 'title' AS field, item_seq AS id, title AS t FROM news_items UNION ALL SELECT 'headline', id, headline FROM summaries),
k AS (SELECT DISTINCT field, id, t, trim(regexp_replace(nfc_normalize({look}), '{space}', ' ', 'g')) AS k FROM t WHERE t IS NOT NULL)
SELECT DISTINCT a.field, a.id AS lo_id, b.id AS hi_id FROM k a JOIN k b ON a.field = b.field AND a.k = b.k AND a.id < b.id AND a.t <> b.t
"""
