"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op10_repeated_phrase_automata"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS k FROM win),
twice AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM h WHERE k IN (SELECT k FROM twice)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM hit),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT a.doc_id, count(*) AS n, string_agg(a.word, ' ' ORDER BY a.p) AS t
         FROM word a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p WHERE g.p IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

ORACLES["op5_warc_index_merge"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, coalesce(url, '') AS u FROM pages),
x AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s,
             list_aggregate(list_transform(string_split(sha1(h), ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS bits,
             array_to_string(list_reverse(string_split(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '.')), ',')
             || ')' || regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS url_key FROM p),
y AS (SELECT *, max(page_id) OVER (PARTITION BY s, payload_bytes) AS newest,
             row_number() OVER (ORDER BY url_key, page_id) - 1 AS merge_pos FROM x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
           + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to, url_key, merge_pos
FROM y
"""

ORACLES["op6_pstable_vectors"] = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
walk(root, near) AS (SELECT vec_id, vec_id FROM e UNION SELECT w.root, l.b FROM walk w JOIN link l ON l.a = w.near),
least AS (SELECT root, min(near) AS component_id FROM walk GROUP BY root),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT m.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(l.component_id, m.vec_id) AS component_id,
       m.vec_id = coalesce(l.component_id, m.vec_id) AS kept
FROM embeddings m LEFT JOIN least l ON l.root = m.vec_id LEFT JOIN n ON n.a = m.vec_id
"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES["op11_shared_lists"] = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""

ORACLES["op12_block_pruning"] = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def _mix_level(level: int) -> str:
    """SQL of one level of the tree: shares of the children of each parent."""
    names = ["domain", "lang", "source"][: level + 1]
    keys, own = ", ".join(names), names[-1]
    part = "PARTITION BY " + ", ".join(names[:-1]) if level else ""
    stated = {"domain": "CASE domain WHEN 'domain0' THEN 2.0 ELSE 1.0 END", "lang": "CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 ELSE 1.0 END", "source": "CASE source WHEN 'src0' THEN 0.5 ELSE 1.0 END"}[own]
    above = "(SELECT b AS budget FROM total)" if not level else f"s{level - 1}.share"
    source = f"(SELECT {keys}, sum(room) AS room FROM leaf GROUP BY ALL) k" + (f" JOIN s{level - 1} USING ({', '.join(names[:-1])})" if level else "")
    return f"""
n{level} AS (SELECT {keys}, CAST(room AS DOUBLE) AS room, CAST({stated} AS DOUBLE) AS weight, {above} AS budget FROM {source}),
o{level} AS (SELECT *, coalesce(sum(room) OVER ({part} ORDER BY room / weight, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f,
             sum(weight) OVER ({part} ORDER BY room / weight, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM n{level}),
m{level} AS (SELECT *, max(CASE WHEN room / weight >= (budget - f) / w THEN (budget - f) / w END) OVER ({part}) AS lam FROM o{level}),
s{level} AS (SELECT {keys}, least(room, coalesce(lam * weight, room)) AS share FROM m{level})"""


# DuckDB has no CRC-32 of text, so the domain's checksum is taken from the names' table of remainders by bits.
_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(source, ''), lambda ch: CAST(ord(ch) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

ORACLES["op3_hierarchical_mix"] = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source, md5(coalesce(text, '')) AS th,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
src AS (SELECT DISTINCT source FROM d),
dom AS (SELECT source, 'domain' || (xor({_CRC}, 4294967295) % 4) AS domain FROM src),
r AS (SELECT domain, d.* FROM d JOIN dom USING (source) WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS leaf_tokens, CAST(sum(n_tokens) AS BIGINT) * 2 AS room FROM r GROUP BY ALL),
total AS (SELECT floor(0.6 * sum(leaf_tokens) + 1e-6) AS b FROM leaf),
{_mix_level(0).strip()},{_mix_level(1)},{_mix_level(2)},
goal AS (SELECT domain, lang, source, floor(share + 1e-6) AS goal, leaf_tokens FROM s2 JOIN leaf USING (domain, lang, source)),
x AS (SELECT r.*, g.goal, g.leaf_tokens, e.epoch, ('0x' || substr(md5('mix-1|' || e.epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
      FROM r JOIN goal g USING (domain, lang, source), (VALUES (0), (1)) AS e(epoch)),
y AS (SELECT *, epoch * leaf_tokens + sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY h, doc_id, th ROWS UNBOUNDED PRECEDING) AS upto FROM x)
SELECT domain, lang, source, doc_id, CAST(epoch AS INTEGER) AS epoch, n_tokens, CAST(upto AS BIGINT) AS upto, leaf_tokens FROM y WHERE upto <= goal
"""
