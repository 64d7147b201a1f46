"""SQL that gives the rows of those queries whose result it can state, by comparing everything with everything that shares a key."""

from __future__ import annotations

#: Lower-cased words of a text, as `common.hashed_words` cuts them.
_OTHER = r"[\x{80}-\x{a9}\x{ab}-\x{b4}\x{b6}-\x{b9}\x{bb}-\x{bf}\x{d7}\x{f7}\x{2000}-\x{206f}\x{3000}-\x{303f}\x{fe30}-\x{fe4f}\x{ff00}-\x{ff0f}]+"


def words(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower(coalesce({text}, '')), '{_OTHER}', ' ', 'g'), '[0-9_a-z\x{{80}}-\x{{10FFFF}}]+')"


#: (id, comp) of nodes: the smallest id that links reach, by passing on smaller ids until none changes.
def components(nodes: str, links: str) -> str:
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
 reach AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
 comps AS (SELECT a AS id, min(b) AS comp FROM reach GROUP BY a)"""


LINE_DEDUP = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 each AS (SELECT doc_id, unnest(range(0, len(ls)))::INTEGER AS line, unnest(ls) AS t FROM split),
 lines AS (SELECT doc_id, line, ws FROM (SELECT doc_id, line, {words('t')} AS ws FROM each) WHERE len(ws) > 0),
 d AS (SELECT ws, min({{'doc_id': doc_id, 'line': line}}) AS first FROM lines GROUP BY ws),
 cut AS (SELECT ws, first, i, ws[1 : i - 1] || ws[i + 1 :] AS rest FROM (SELECT ws, first, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) >= 5)),
 same AS (SELECT rest, i, min(first) AS m FROM cut GROUP BY rest, i),
 shorter AS (SELECT ws AS rest, first AS m FROM d WHERE len(ws) >= 5),
 longer AS (SELECT rest AS ws, min(first) AS m FROM cut GROUP BY rest),
 met AS (SELECT c.ws, s.m FROM cut c JOIN same s ON c.rest = s.rest AND c.i = s.i UNION ALL SELECT c.ws, s.m FROM cut c JOIN shorter s ON c.rest = s.rest UNION ALL SELECT d.ws, l.m FROM d JOIN longer l ON d.ws = l.ws WHERE len(d.ws) >= 5),
 near AS (SELECT ws, min(m) AS m FROM met GROUP BY ws),
 gone AS (SELECT l.doc_id, l.line FROM lines l JOIN d ON l.ws = d.ws LEFT JOIN near n ON n.ws = d.ws WHERE n.m < d.first OR {{'doc_id': l.doc_id, 'line': l.line}} > d.first)
 SELECT s.doc_id, len(ls)::INTEGER AS n_lines, (len(ls) - count(g.line))::INTEGER AS n_kept, coalesce(string_agg(CAST(g.line AS VARCHAR), ',' ORDER BY g.line), '') AS dropped
 FROM split s LEFT JOIN gone g USING (doc_id) GROUP BY s.doc_id, ls"""

#: (id, run, k) of the runs of five words of a table's texts, the k-th of equal ones; a shorter text is one run.
def runs(table: str, key: str) -> str:
    return f"""(SELECT id, run, row_number() OVER (PARTITION BY id, run) AS k FROM (SELECT id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: hash(array_to_string(ws[i : i + 4], ' ')))) AS run
  FROM (SELECT {key} AS id, {words('text')} AS ws FROM {table}) WHERE len(ws) > 0))"""


NEAR_DUPLICATES = f"""WITH RECURSIVE u AS MATERIALIZED {runs('documents', 'doc_id')}, n AS (SELECT id, count(*) AS n FROM u GROUP BY id),
 links AS MATERIALIZED (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM u x JOIN u y ON x.run = y.run AND x.k = y.k AND x.id < y.id GROUP BY 1, 2) JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE shared >= 0.8 * (p.n + q.n - shared)),
 nodes AS (SELECT doc_id AS id FROM documents), {components('nodes', 'links')}
 SELECT id AS doc_id, comp AS class_id, id = comp AS kept FROM comps"""

EMBEDDING_DUPLICATES = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
 nodes AS (SELECT vec_id AS id FROM embeddings), {components('nodes', 'links')},
 degree AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
 SELECT comps.id AS vec_id, coalesce(degree.n, 0) AS n_links, comp AS component_id, comps.id = comp AS kept FROM comps LEFT JOIN degree USING (id)"""

DECONTAMINATION = f"""WITH doc AS (SELECT doc_id AS id, {words('text')} AS ws FROM documents), item AS (SELECT item_id AS id, {words('text')} AS ws FROM benchmark),
 r AS (SELECT id, unnest(list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i : i + 4], ' ')))) AS run, unnest(range(1, len(ws) - 3)) AS pos, len(ws) - 4 AS n FROM doc WHERE len(ws) >= 5),
 x AS (SELECT id, run, count(*) AS c, any_value(n) AS n FROM (SELECT id, unnest(list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i : i + 4], ' ')))) AS run, len(ws) - 4 AS n FROM item WHERE len(ws) >= 5) GROUP BY id, run),
 hit AS MATERIALIZED (SELECT r.id AS doc, x.id AS item, pos, r.run, c, r.n AS doc_n, x.n AS item_n FROM r JOIN x ON r.run = x.run),
 win AS (SELECT DISTINCT doc, item, doc_n, item_n, unnest(range(greatest(1, pos - item_n + 1), greatest(1, least(pos, doc_n - item_n + 1)) + 1)) AS s FROM hit),
 met AS (SELECT w.doc, w.item, w.s, least(w.item_n, w.doc_n) AS size, w.item_n, h.run, least(count(*), any_value(h.c)) AS shared FROM win w JOIN hit h ON h.doc = w.doc AND h.item = w.item AND h.pos BETWEEN w.s AND w.s + w.item_n - 1 GROUP BY ALL),
 found AS (SELECT DISTINCT doc, item FROM (SELECT doc, item, s, any_value(size) AS size, any_value(item_n) AS item_n, sum(shared) AS shared FROM met GROUP BY doc, item, s) WHERE shared >= 0.8 * (size + item_n - shared))
 SELECT doc_id, count(item) > 0 AS contaminated, coalesce(string_agg(CAST(item AS VARCHAR), ',' ORDER BY item), '') AS item_ids FROM documents LEFT JOIN found ON doc = doc_id GROUP BY doc_id"""

FILL_IN_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, list_transform(range(0, 4), lambda k: CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT)) AS r FROM d),
 c AS (SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS low, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS high FROM u),
 p AS (SELECT *, array_to_string(units[1 : low], '') AS prefix, array_to_string(units[low + 1 : high], '') AS middle, array_to_string(units[high + 1 :], '') AS suffix,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _said(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_said(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Unsigned CRC-32 of a decimal number, bit by bit: eight steps for each of its bytes.
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), range(0, 8)::UBIGINT[]), lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))"

MERKLE = f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS shown FROM documents),
 numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
 nodes AS MATERIALIZED (SELECT tree, 0 AS level, i, n, leaf AS h FROM numbered UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2, n),
 tops AS MATERIALIZED (SELECT 0 AS level, tree AS i, count(*) OVER () AS n, h FROM nodes WHERE n = 1 UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
 steps AS MATERIALIZED (SELECT tree, level, i, n, h, NULL AS o FROM nodes WHERE n > 1 UNION ALL SELECT -1, level, i, n, h, NULL FROM tops WHERE n > 1),
 height AS MATERIALIZED (SELECT tree, max(level) AS top FROM nodes GROUP BY tree),
 walk AS MATERIALIZED (SELECT doc_id, tree, i AS k, 0 AS d, top, 0 AS done, shown AS h, NULL::VARCHAR AS sibling FROM numbered JOIN height USING (tree)
  UNION ALL SELECT w.doc_id, w.tree, w.k, w.d + 1, w.top, 0, CASE WHEN s.h IS NULL THEN sha256(w.h) WHEN w.p % 2 = 1 THEN sha256(s.h || w.h) ELSE sha256(w.h || s.h) END, coalesce(s.h, '')
   FROM (SELECT *, CASE WHEN d < top THEN k >> d ELSE tree >> (d - top) END AS p FROM walk) w LEFT JOIN steps s ON s.tree = CASE WHEN w.d < w.top THEN w.tree ELSE -1 END AND s.level = CASE WHEN w.d < w.top THEN w.d ELSE w.d - w.top END AND s.i = xor(w.p, 1)
   WHERE w.d < w.top + (SELECT max(level) FROM tops)),
 ends AS (SELECT doc_id, k, tree, sha256(coalesce(string_agg(sibling, '' ORDER BY d), '')) AS proof_sha256, max_by(h, d) AS folded_root FROM walk GROUP BY doc_id, k, tree)
 SELECT m.doc_id, leaf, s.h AS subroot, t.h AS root, proof_sha256, folded_root, folded_root = t.h AS verified
 FROM numbered m JOIN ends e ON e.tree = m.tree AND e.k = m.i JOIN nodes s ON s.tree = m.tree AND s.n = 1 JOIN tops t ON t.n = 1"""
