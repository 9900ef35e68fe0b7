"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, bpe, chat, counts, extraction, fingerprints, minhash, packing, pii, prefixes, quality, rules, toxicity

QUERIES = {
    "op1_near_dedup": minhash.op1_near_dedup,
    "op2_packing": packing.op2_packing,
    "op3_token_counts": counts.op3_token_counts,
    "op4_pii_surrogates": pii.op4_pii_surrogates,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_html_extraction": extraction.op12_html_extraction,
    "op13_prefix_trie": prefixes.op13_prefix_trie,
}

OP1_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT min(doc_id) AS id, text FROM t GROUP BY text),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM u),
s AS (SELECT id, array_to_string(ws[i:i + 4], ' ') AS g, count(*) AS k FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0) GROUP BY ALL),
n AS (SELECT id, sum(k) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.k, b.k)) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT id, id FROM u UNION SELECT links.b, r.root FROM r JOIN links ON links.a = r.node WHERE r.root < links.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT t.doc_id, c.root AS class_id, count(*) OVER (PARTITION BY c.root) AS class_rows FROM t JOIN u USING (text) JOIN c ON c.node = u.id
"""

ORACLE_SQL = {"op1_near_dedup": OP1_SQL, "op7_quality_rules": rules.OP7_SQL, "op9_chat_formatting": chat.OP9_SQL, "op13_prefix_trie": prefixes.OP13_SQL}
