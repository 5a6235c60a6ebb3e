"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .binpacking import op11_best_fit_packing
from .decontam import op10_decontamination
from .divergence import op12_source_divergence
from .htmltext import op4_main_text
from .langid import op5_language_id
from .neardup import op7_near_duplicates
from .ngramlm import op6_lm_scores
from .packing import op1_packing
from .pii import op3_pseudonyms
from .quality import op9_quality
from .sharding import op2_kd_sharding
from .substrings import op8_repeats
from .veccodes import op13_vector_codes

QUERIES = {
    "op1_packing": op1_packing,
    "op2_kd_sharding": op2_kd_sharding,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_main_text": op4_main_text,
    "op5_language_id": op5_language_id,
    "op6_lm_scores": op6_lm_scores,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_repeats": op8_repeats,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_codes": op13_vector_codes,
}

#: The components by reachability, on the whole sets of shingles.
NEAR_DUPLICATES = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, UNNEST(w) AS word, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word,
      4) OVER o AS h FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT DISTINCT doc_id, h FROM g WHERE h IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT t.doc_id, count(h) AS n_shingles FROM t LEFT JOIN u ON u.doc_id = t.doc_id GROUP BY t.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n_shingles + ny.n_shingles - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.node)
SELECT n.doc_id, n.n_shingles, min(r.root) AS component_id, min(r.root) = n.doc_id AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

#: Each 400-byte window by the hashes of its eight parts, on the texts as hexadecimal digits.
REPEATS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
f AS (SELECT doc_id, n, p, hash(substr(x, 2 * p + 1, 100)) AS h FROM (SELECT doc_id, x, n, UNNEST(range(0, n - 49)) AS p FROM d WHERE n >= 400)),
w AS (SELECT doc_id, p, h FROM (SELECT doc_id, n, p, hash(h, lead(h, 50) OVER o, lead(h, 100) OVER o, lead(h, 150) OVER o, lead(h, 200) OVER o,
      lead(h, 250) OVER o, lead(h, 300) OVER o, lead(h, 350) OVER o) AS h FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE p <= n - 400),
m AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
s AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM m),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM s),
z AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY doc_id, g),
q AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM z UNION ALL
      SELECT d.doc_id, coalesce(max(z.b), 0), max(d.n) FROM d LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id),
k AS (SELECT q.doc_id, string_agg(substr(d.x, 2 * q.s + 1, 2 * (q.e - q.s)), ''
      ORDER BY q.s) AS kept, max(d.n) AS n, CAST(max(d.n) - sum(q.e - q.s) AS BIGINT) AS gone, count(*) - 1 AS spans FROM q JOIN d ON d.doc_id = q.doc_id
      GROUP BY q.doc_id)
SELECT doc_id, n AS n_bytes, gone AS n_removed, spans AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""

#: Every group with every kept term, and every pair of groups.
DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT d, lang, source, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
s AS (SELECT lang, count(*) AS v, sum(total) AS m FROM t GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
a AS (SELECT g.lang, g.source, t.term, t.total, coalesce(c.n, 0) AS n FROM g JOIN t ON t.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
z AS (SELECT lang, source, sum(n) AS size FROM a GROUP BY lang, source),
p AS (SELECT a.lang, a.source, a.term, a.n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (a.n + 2)) // (z.size + 2 * s.v) AS BIGINT) AS p,
      CAST(1 + (CAST(1000000000 AS HUGEINT) * (a.total + 2)) // (s.m + 2 * s.v) AS BIGINT) AS q
      FROM a JOIN z ON z.lang = a.lang AND z.source = a.source JOIN s ON s.lang = a.lang),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM b)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

#: Each assignment compares every part with every entry.
ASSIGNED = """a{r} AS MATERIALIZED (SELECT n, p, any_value(a) AS a, min(struct_pack(d := list_inner_product(a, a) - 2 * list_inner_product(a, c) + list_inner_product(c, c), k := k)) AS s
      FROM x JOIN b{r} USING (p) GROUP BY n, p)"""
REPLACED = """m{r} AS (SELECT p, s.k AS k, i, CAST(sum(v) AS HUGEINT) AS t, count(*) AS n FROM (SELECT p, s, UNNEST(a) AS v, generate_subscripts(a, 1) AS i FROM a{r}) GROUP BY p, s.k, i),
    b{next} AS MATERIALIZED (SELECT p, k, coalesce(any_value(y.c), any_value(b{r}.c)) AS c FROM b{r} LEFT JOIN (SELECT p, k,
      list(CAST((t - (t % n + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM m{r} GROUP BY p, k) y USING (p, k) GROUP BY p, k)"""
VECTOR_CODES = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT n, p, e[16 * p + 1 : 16 * p + 16] AS a FROM v, (SELECT UNNEST(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS k, a AS c FROM x WHERE n <= 256),
{", ".join(ASSIGNED.format(r=r) + ", " + REPLACED.format(r=r, next=r + 1) for r in range(4))}, {ASSIGNED.format(r=4)},
h AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, i)) AS h
      FROM (SELECT p, k, UNNEST(c) AS v, generate_subscripts(c, 1) AS i FROM b4)),
r AS (SELECT n, string_agg(printf('%02x', s.k), '' ORDER BY p) AS code, CAST(sum(s.d) AS BIGINT) AS error FROM a4 GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r JOIN v USING (n), h
"""

ORACLES: dict[str, str] = {"op7_near_duplicates": NEAR_DUPLICATES, "op8_repeats": REPEATS, "op12_source_divergence": DIVERGENCE, "op13_vector_codes": VECTOR_CODES}
