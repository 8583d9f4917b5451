"""DuckDB SQL for the operators' queries that SQL can express, written from their contracts.

The classifiers of op2 and op8 and the templates of op1 have no SQL.
"""

from __future__ import annotations

from lettermill.llm.chat import ROTATE_SQL
from lettermill.llm.urls import ALPHABET, RULES, SMOOTH
from lettermill.llm.warc import ARCHIVE_SQL
from lettermill.llm.words import LOWER, UPPER

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents
), placed AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)
), hits AS (SELECT doc_id, i, k, item_id FROM placed JOIN wins USING (k, win)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_SPACE} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
), walk AS (SELECT a AS node, b AS seen FROM links UNION SELECT node, b FROM walk JOIN links ON seen = a
), roots AS (SELECT node, min(seen) AS root FROM walk GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id, doc_id <= coalesce(root, doc_id) AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON node = doc_id
"""

EMBEDDINGS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), walk AS (SELECT a AS node, b AS seen FROM links UNION SELECT node, b FROM walk JOIN links ON seen = a
), roots AS (SELECT node, min(seen) AS root FROM walk GROUP BY node
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id, vec_id <= coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN roots ON node = vec_id LEFT JOIN n ON a = vec_id
"""


def _fits(rule: str) -> str:
    domain, slash, start = rule.partition("/")
    return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{start}')"


_RULE = "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in sorted(RULES, key=len, reverse=True)) + " END"
_SAYS = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items()) + " END"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_FOLD = r"(?s)[^a-z0\-._~:/?#\[\]@!$&''()+,;=%]"


def _order(n: int) -> str:
    """Counts by the last n characters, and by those before the last, of all grams."""
    tail, before = f"substr(g, {4 - n}, {n})", f"substr(g, {4 - n}, {n - 1})"
    return f"t{n} AS (SELECT {tail} AS t, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1), c{n} AS (SELECT {before} AS t, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1)"


def _smooth(kind: str) -> str:
    p = f"(1.0::DOUBLE / {len(ALPHABET)})"
    for n in (1, 2, 3):
        p = f"((t{n}.{kind} + {SMOOTH}::DOUBLE * {p}) / (c{n}.{kind} + {SMOOTH}::DOUBLE))"
    return p


URLS = f"""
WITH split_ AS (
  SELECT row_number() OVER () AS uid, page_id, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path,
    regexp_replace(regexp_replace(lower(coalesce(url, '')), '[0-9]', '0', 'g'), '{_FOLD}', '*', 'g') AS f, substr(md5(coalesce(url, '')), 1, 1) < '3' AS held FROM pages
), ruled AS (SELECT *, {_RULE} AS rule FROM split_
), said AS (SELECT *, {_SAYS} AS ruled FROM ruled
), grams AS (SELECT uid, ruled, held, substr('^^' || f, i, 3) AS g FROM (SELECT uid, ruled, held, f, unnest(range(1, length(f) + 1)) AS i FROM said)
), counts AS (SELECT g, count(*) FILTER (ruled = 'allow' AND NOT held) AS a, count(*) FILTER (ruled = 'block' AND NOT held) AS b FROM grams GROUP BY g
), {_order(1)}, {_order(2)}, {_order(3)}, ratios AS (
  SELECT g, ln({_smooth("a")}) - ln({_smooth("b")}) AS r FROM counts
    JOIN t1 ON t1.t = substr(g, 3, 1) JOIN c1 ON c1.t = '' JOIN t2 ON t2.t = substr(g, 2, 2) JOIN c2 ON c2.t = substr(g, 2, 1) JOIN t3 ON t3.t = g JOIN c3 ON c3.t = substr(g, 1, 2)
), scores AS (SELECT uid, avg(r) AS score FROM grams JOIN ratios USING (g) GROUP BY uid
), scored AS (SELECT s.*, coalesce(score, 0.0) AS score FROM said s LEFT JOIN scores USING (uid)
), steps AS (
  SELECT CAST(floor(score / 0.001) AS BIGINT) AS k, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM scored WHERE held AND ruled IS NOT NULL GROUP BY 1
), errors AS (
  SELECT k, coalesce(lag(k) OVER (ORDER BY k), k) AS prev, coalesce(sum(a) OVER w, 0)::DOUBLE / nullif(sum(a) OVER (), 0) AS missed, 1 - coalesce(sum(b) OVER w, 0)::DOUBLE / nullif(sum(b) OVER (), 0) AS passed
  FROM steps WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), best AS (SELECT min(struct_pack(e := round(missed + passed, 9), k := k, prev := prev)) AS x FROM errors WHERE missed IS NOT NULL AND passed IS NOT NULL
), cut AS (SELECT coalesce((x.k + x.prev) / 2 * 0.001, '-infinity'::DOUBLE) AS cut FROM best)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, round(score, 9) AS score FROM scored, cut
"""

_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _places(phrase: str) -> str:
    words = phrase.split()
    here = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {here})"


LICENSE_BASE = f"""
WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents
), found AS (
  SELECT doc_id, len(w) AS n, [{", ".join(f"struct_pack(label := '{x}', pos := {_places(p)})" for p, x in _PHRASES.items())}] AS f FROM docs
), placed AS (SELECT doc_id, n, list_filter(f, lambda x: len(x.pos) > 0) AS f, flatten(list_transform(f, lambda x: x.pos)) AS pos FROM found)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(pos) AS BIGINT) AS n_base, CAST(list_min(pos) - 1 AS BIGINT) AS first_word, CAST(list_max(pos) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(list_transform(f, lambda x: x.label)), ',') AS base_labels
FROM placed
"""


def _pass(n: int, above: str) -> str:
    """A pass over the documents behind a hash: where the budget ends, and what is left of it."""
    return f"""p{n} AS (
  SELECT d.source, h, upto, budget FROM (SELECT d.source, d.h, s.budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
    FROM d JOIN s{n - 1} s ON d.source IS NOT DISTINCT FROM s.source WHERE d.size <= floor(s.budget + 1e-6) AND {above}) d
), e{n} AS (
  SELECT source, min(h) FILTER (upto > budget + 1e-6) AS stop, coalesce(max(upto) FILTER (upto <= budget + 1e-6), 0) AS used FROM p{n} GROUP BY source
), s{n} AS (
  SELECT s.* EXCLUDE (budget), s.budget - coalesce(used, 0) AS budget, floor(s.budget + 1e-6) AS most{n}, CASE WHEN e.source IS NULL AND used IS NULL THEN NULL ELSE coalesce(stop, 68719476736) END AS stop{n}
  FROM s{n - 1} s LEFT JOIN e{n} e ON s.source IS NOT DISTINCT FROM e.source
)"""


#: Written for tables whose rows don't repeat.
MIXING = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')), 1, 9) AS BIGINT) AS h FROM documents
), src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS cap FROM src
), levels AS (
  SELECT *, cap / weight AS reach, ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), found AS (SELECT arg_min(level, reach) AS level FROM levels WHERE reach >= level
), planned AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM found), cap)) AS target FROM weighed
), s0 AS (
  SELECT *, greatest(0, target - whole * source_size) AS budget FROM (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0) + 1e-9), 0) AS BIGINT) AS whole FROM planned)
), {_pass(1, "true")}, {_pass(2, "d.h > coalesce(s.stop1, 68719476736)")}, marked AS (
  SELECT d.*, s.source_size, s.target, s.whole, s.budget,
    coalesce(h < stop1 AND size <= most1, false) OR coalesce(h > stop1 AND h < stop2 AND size <= most2, false) AS extra
  FROM d JOIN s2 s ON d.source IS NOT DISTINCT FROM s.source
), last AS (
  SELECT source, min(struct_pack(o := abs(size - budget), h := h, doc_id := doc_id)) AS l FROM marked WHERE NOT extra AND size < 2 * budget GROUP BY source
)
SELECT m.doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN extra OR coalesce(m.h = l.h AND m.doc_id = l.doc_id, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM marked m LEFT JOIN last ON m.source IS NOT DISTINCT FROM last.source
"""

ORACLE_SQL = {
    "license_base_phrases": LICENSE_BASE,
    "op9_source_mixing": MIXING,
    "op3_benchmark_decontamination": DECONTAMINATION,
    "op4_minhash_near_dedup": NEAR_DUPLICATES,
    "op5_url_filter": URLS,
    "op6_chat_perspectives": ROTATE_SQL,
    "op7_warc_revisits": ARCHIVE_SQL,
    "op10_embedding_near_dedup": EMBEDDINGS,
}
