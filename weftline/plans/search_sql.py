"""The searches of the catalog in DuckDB SQL, stage by stage, over the node table."""

from __future__ import annotations

from weftline.operators.hybrid import Question
from weftline.operators.lexical import STOP_WORDS, Rules
from weftline.sources import tables as S

#: Clauses of a query: all have to match, each by any of its words.
Clauses = list[list[str]]

GAP = r"[ \t\n\x0B\f\r]+"
BASIS = "regexp_matches(id, '^sec-[^-]+-(B|SB)(-|$)')"


def _plain(c: str, tag: str = " ") -> str:
    text = f"replace(replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', '{tag}', 'g'), '&nbsp;', ' '), chr(160), ' ')"
    return rf"trim(regexp_replace({text}, '{GAP}', ' ', 'g'))"


def _label(c: str) -> str:
    return f"replace({_plain(c, '')}, '&amp;', '&')"


def _all(tests: list[list[str]], within: str = " OR ", between: str = " AND ") -> str:
    return "(" + between.join("(" + within.join(t) + ")" for t in tests) + ")"


def matched(clauses: Clauses, without: list[str], where: str = "true", relax: bool = False) -> str:
    """CTEs own, hits (id, score, citation_hit) and enough of the nodes that a query matches."""
    words = list(dict.fromkeys([w for c in clauses for w in c] + without))
    at = {w: i for i, w in enumerate(words)}
    split = lambda c: rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    counts = ", ".join(f"len(list_filter({f}, lambda x: x = '{w}')) AS {f}{i}" for w, i in at.items() for f in "abc")
    found = lambda w: f"a{at[w]} + b{at[w]} + c{at[w]} > 0"
    cited = lambda w: f"a{at[w]} > 0"
    none = "".join(f" AND NOT ({found(w)})" for w in without)
    every, some = [[f(w) for w in c] for f in (found,) for c in clauses], [[found(w) for c in clauses for w in c]]
    good = _all(every) + none
    cites = _all([[cited(w) for w in c] for c in clauses])
    if relax:
        good = f"CASE WHEN (SELECT yes FROM enough) THEN {good} ELSE {_all(some)}{none} END"
        cites = f"CASE WHEN (SELECT yes FROM enough) THEN {cites} ELSE {_all([[cited(w) for c in clauses for w in c]])} END"
    positive = [at[w] for w in at if w not in without]
    total = lambda f: " + ".join(f"{f}{i}" for i in positive)
    return rf"""{S.NODES_SQL}, own AS (SELECT * FROM nodes WHERE {where}
), words AS (
  SELECT id, {split("citation")} AS a, {split("title")} AS b, {split("regexp_replace(coalesce(full_text, ''), '<[^>]+>', ' ', 'g')")} AS c FROM own
), tf AS (SELECT id, len(a) + len(b) + len(c) AS n, {counts} FROM words
), enough AS (SELECT count(*) >= 5 AS yes FROM tf WHERE {_all(every)}{none}
), hits AS (
  SELECT id, (({total("a")}) * 1.0::DOUBLE + ({total("b")}) * 0.4::DOUBLE + ({total("c")}) * 0.2::DOUBLE) / (1 + ln(n::DOUBLE)) AS score, {cites} AS citation_hit
  FROM tf WHERE {good}
)"""


PATHS = """up AS (
  SELECT s.id, p.parent_id, p.title, p.citation, 1 AS k FROM nodes s JOIN nodes p ON p.id = s.parent_id
  UNION ALL SELECT up.id, p.parent_id, p.title, p.citation, k + 1 FROM up JOIN nodes p ON p.id = up.parent_id
), paths AS (
  SELECT id, string_agg(CASE WHEN trim(title) = '' THEN citation ELSE trim(title) END, ' › ' ORDER BY k DESC) AS path
  FROM up WHERE parent_id IS NOT NULL AND trim(title) IS DISTINCT FROM trim(citation) GROUP BY id
)"""


def keyword(clauses: Clauses, without: list[str], limit: int, where: str = "true", paths: bool = True) -> str:
    """The keyword search with headings and highlights."""
    wanted = ", ".join(f"'{w}'" for c in clauses for w in c)
    return rf"""WITH RECURSIVE {matched(clauses, without, where)}, {PATHS}, pool AS (
  SELECT h.id, citation, title, reg_key, full_text, sort_order, score * CASE WHEN citation_hit THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS pre
  FROM hits h JOIN own ON own.id = h.id WHERE NOT {BASIS.replace("id", "h.id", 1)} ORDER BY pre DESC, sort_order, h.id LIMIT {3 * limit}
), best AS (
  SELECT pool.*, {"p.path" if paths else "NULL::VARCHAR"} AS path,
    CAST(pre * CASE WHEN {f"regexp_matches(p.path, '{Rules.DEFINITIONS_PATH}')" if paths else "false"} THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END
      * CASE WHEN {f"coalesce(regexp_matches(p.path, '{Rules.SEARCH_PATH}'), false)" if paths else "false"} OR regexp_matches(title, '{Rules.SEARCH_TITLE}') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS FLOAT) AS score
  FROM pool {"LEFT JOIN paths p ON p.id = pool.id" if paths else ""} ORDER BY score DESC, sort_order, pool.id LIMIT {limit}
), cut AS (
  SELECT *, list_filter(regexp_split_to_array({_plain("full_text")}, '[\s\p{{Z}}\x0B\x1c-\x1f\x85]+'), lambda x: x <> '') AS l,
    {_label("full_text")} = {_label("title")} OR {_label("full_text")} = {_label("citation")} AS bare FROM best
), marked AS (
  SELECT *, list_transform(l, lambda w: CASE WHEN regexp_replace(regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}_]+', ''), '[^\p{{L}}\p{{N}}_]+$', '') IN ({wanted}) THEN 1 ELSE 0 END) AS h FROM cut
), summed AS (
  SELECT *, list_transform(range(0, greatest(len(l) - 40, 0) + 1), lambda i: coalesce(list_sum(h[i + 1 : i + 40]), 0)) AS sums FROM marked
), placed AS (SELECT *, list_position(sums, list_max(sums)) - 1 AS s FROM summed)
SELECT id, citation, title, reg_key,
  CASE WHEN NOT bare THEN array_to_string(list_transform(range(s + 1, least(s + 40, len(l)) + 1), lambda i: CASE WHEN h[i] = 1 THEN '<mark>' || l[i] || '</mark>' ELSE l[i] END), ' ') END AS headline,
  round(score::DOUBLE, 4) AS score, path, false AS is_basis FROM placed"""


def _ranked(clauses: Clauses, short: bool, long: bool, federal: bool, state: bool, n: int, vector: int) -> str:
    """CTEs up to ranked: the hybrid search's ordered rows."""
    pool = max(3 * n, 60)
    fused = "1 / (60 + s.sem_rank), 0) + coalesce(1 / (60 + k.kw_rank)"
    if long:
        bonus = "(SELECT CASE WHEN yes THEN 0.04::DOUBLE ELSE 0.02::DOUBLE END FROM enough)"
        value = f"CAST(greatest(coalesce(s.score, kw_score, 0)::DOUBLE - 0.4::DOUBLE, 0.01::DOUBLE) + coalesce({bonus} / (1 + (kw_rank - 1) / 10), 0) AS FLOAT)"
    else:
        value = f"CAST(coalesce({fused}, 0) AS FLOAT)"
    one, level = federal != state, "federal" if federal else "state"
    named = "".join(f" OR jurisdiction_level = '{x}' AND jur_rank <= 20" for x, yes in (("federal", federal), ("state", state)) if yes)
    weight = f"CASE WHEN jurisdiction_level = '{level}' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END" if one else "1.0::DOUBLE"
    keys = "jrank, CASE WHEN jurisdiction_level = 'state' THEN 0 ELSE 1 END, " if federal and state else "CASE WHEN jur_weight > 1 AND jrank <= 3 THEN 0 ELSE 1 END, " if one else ""
    keys += "value DESC, score DESC NULLS LAST, sort_order, id"
    return rf"""{matched(clauses, [], relax=True)}, {PATHS}, vec AS (
  SELECT o.id, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vector})) AS similarity
  FROM embeddings e JOIN own o ON o.doc_id = e.vec_id
), kw1 AS (
  SELECT h.id, row_number() OVER (ORDER BY score DESC, sort_order, h.id) AS raw FROM hits h JOIN own ON own.id = h.id ORDER BY score DESC, sort_order, h.id LIMIT {pool}
), kw2 AS (SELECT kw1.id, raw, CAST(v.similarity AS FLOAT) AS kw_score FROM kw1 LEFT JOIN (SELECT id, max(similarity) AS similarity FROM vec GROUP BY id) v ON v.id = kw1.id
), k AS (SELECT id, row_number() OVER (ORDER BY raw) AS kw_rank, kw_score FROM kw2 WHERE kw_score IS NULL OR kw_score >= 0.5
), sem AS (
  SELECT id, max(score) AS score FROM (SELECT id, CAST(similarity AS FLOAT) AS score FROM vec ORDER BY similarity DESC, id LIMIT {6 * pool}) GROUP BY id ORDER BY max(score) DESC, id LIMIT {2 * pool}
), s AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS sem_rank FROM sem
), legs AS (SELECT coalesce(s.id, k.id) AS id, coalesce(s.score, kw_score) AS score, kw_rank IS NOT NULL AS keyword_hit, {value} AS fused FROM s FULL JOIN k ON k.id = s.id
), loc AS (
  SELECT l.*, o.* EXCLUDE (id, full_text), p.path, {BASIS.replace("id", "l.id", 1)} AS is_basis,
    len(regexp_split_to_array(trim(regexp_replace(coalesce(full_text, ''), '<[^>]+>', ' ', 'g')), '{GAP}')) AS n_words, length(trim(regexp_replace(coalesce(full_text, ''), '<[^>]+>', ' ', 'g'))) AS text_len,
    CAST(fused::DOUBLE * CASE WHEN {BASIS.replace("id", "l.id", 1)} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {str(short).lower()} AND coalesce(c.citation_hit, false) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS FLOAT) AS pre
  FROM legs l JOIN own o ON o.id = l.id LEFT JOIN paths p ON p.id = l.id LEFT JOIN hits c ON c.id = l.id AND c.citation_hit
), stage AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY pre DESC, score DESC NULLS LAST, id) AS all_rank, row_number() OVER (PARTITION BY jurisdiction_level ORDER BY pre DESC, score DESC NULLS LAST, id) AS jur_rank FROM loc)
  WHERE all_rank <= {pool}{named}
), heading AS (SELECT *, n_words <= 20 AND id IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) AS heading_only FROM stage
), content AS (
  SELECT *, CAST(pre::DOUBLE * CASE WHEN coalesce(regexp_matches(path, '{Rules.DEFINITIONS_PATH}'), false) OR regexp_matches(title, '{Rules.DEFINITIONS_TITLE}') THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN regexp_matches(title, '{Rules.APPLIES_TITLE}') OR coalesce(regexp_matches(path, '{Rules.APPLIES_PATH}'), false) THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN NOT keyword_hit AND NOT heading_only AND text_len < 150 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS FLOAT) AS content_score FROM heading
), child AS (
  SELECT id, head_score FROM (SELECT c.id, h.content_score AS head_score, row_number() OVER (PARTITION BY c.parent_id ORDER BY c.content_score DESC, c.score DESC NULLS LAST, c.id) AS r
    FROM content c JOIN content h ON h.heading_only AND h.id = c.parent_id) WHERE r = 1
), scored AS (
  SELECT c.*, CAST(CASE WHEN heading_only THEN content_score::DOUBLE * 0.6::DOUBLE ELSE greatest(content_score, coalesce(head_score, content_score))::DOUBLE END AS FLOAT) AS final FROM content c LEFT JOIN child k ON k.id = c.id
), valued AS (
  SELECT *, row_number() OVER (PARTITION BY jurisdiction_level ORDER BY final DESC, score DESC NULLS LAST, id) AS jrank, {weight} AS jur_weight, CAST(final::DOUBLE * {weight} AS FLOAT) AS value FROM scored
), ranked AS (SELECT *, row_number() OVER (ORDER BY {keys})::INT AS position FROM valued ORDER BY {keys} LIMIT {n}
)"""


def hybrid(clauses: Clauses, short: bool, long: bool, federal: bool, state: bool, n: int = 20, vector: int = 7) -> str:
    return f"""WITH RECURSIVE {_ranked(clauses, short, long, federal, state, n, vector)}
SELECT position, id, citation, title, reg_key, jurisdiction_level, CASE WHEN summary_status IS DISTINCT FROM 'rejected' THEN ai_summary END AS summary,
  round(score::DOUBLE, 4) AS score, is_basis, keyword_hit, round(value::DOUBLE, 4) AS fused, path FROM ranked"""


def completed(clauses: Clauses, short: bool, long: bool, n: int = 20, vector: int = 7) -> str:
    """The hybrid search's rows with families of rows made whole."""
    return f"""WITH RECURSIVE {_ranked(clauses, short, long, False, False, n, vector)}, families AS (
  SELECT parent_id, min(position) AS first FROM ranked WHERE parent_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2
), kids AS (
  SELECT * FROM (SELECT x.id, x.parent_id, x.sort_order, f.first, count(*) OVER (PARTITION BY x.parent_id) AS size FROM nodes x JOIN families f ON f.parent_id = x.parent_id) WHERE size <= 20
), heads AS (SELECT h.id, least(first, coalesce(r.position, first)) AS place FROM (SELECT DISTINCT parent_id AS id, first FROM kids) h LEFT JOIN ranked r ON r.id = h.id
), every AS (
  SELECT id, place, 0 AS step, -1 AS sort_order FROM heads
  UNION ALL SELECT kids.id, h.place, 1, kids.sort_order FROM kids JOIN heads h ON h.id = kids.parent_id
  UNION ALL SELECT id, position, 2, 0 FROM ranked
), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, step, sort_order) AS r FROM every) WHERE r = 1)
SELECT position, id FROM (SELECT row_number() OVER (ORDER BY place, step, sort_order, id)::INT AS position, id FROM once) WHERE position <= (SELECT count(*) FROM ranked)"""


def _split(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _batched(n: int = 20) -> str:
    """CTEs up to ranked for all questions of asked (q, text, vector): the stages of ``_ranked`` by question."""
    pool = max(3 * n, 60)
    text = "regexp_replace(coalesce(full_text, ''), '<[^>]+>', ' ', 'g')"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    basis = BASIS.replace("id", "l.id", 1)
    plain = "trim(regexp_replace(coalesce(full_text, ''), '<[^>]+>', ' ', 'g'))"
    times = lambda test, x: f"CASE WHEN {test} THEN {x}::DOUBLE ELSE 1.0::DOUBLE END"
    return rf"""{S.NODES_SQL}, {PATHS}, asked AS (
  SELECT item_id AS q, text, list_transform(embedding, lambda x, i: x::DOUBLE + 0.001::DOUBLE * ((i * 7 + item_id) % 11 - 5)) AS v FROM benchmark JOIN embeddings ON vec_id = item_id
), modes AS (
  SELECT q, v, len(regexp_split_to_array(trim(text), '\s+')) AS wc, regexp_matches(lower(text), '{Question.FEDERAL}') AS federal, regexp_matches(lower(text), '{Question.STATE}') AS state FROM asked
), aw AS (SELECT DISTINCT q, word FROM (SELECT q, unnest({_split("text")}) AS word FROM asked) WHERE word NOT IN ({stop})
), nw AS (SELECT q, count(*) AS n_asked FROM aw GROUP BY 1
), lists AS (SELECT id, {_split("citation")} AS a, {_split("title")} AS b, {_split(text)} AS c FROM nodes
), posts AS (
  SELECT id, word, sum(a) AS a, sum(b) AS b, sum(c) AS c, n FROM (
    SELECT id, unnest(a) AS word, 1 AS a, 0 AS b, 0 AS c, len(a) + len(b) + len(c) AS n FROM lists UNION ALL SELECT id, unnest(b), 0, 1, 0, len(a) + len(b) + len(c) FROM lists
    UNION ALL SELECT id, unnest(c), 0, 0, 1, len(a) + len(b) + len(c) FROM lists) GROUP BY id, word, n
), met AS (
  SELECT q, id, (sum(a) * 1.0::DOUBLE + sum(b) * 0.4::DOUBLE + sum(c) * 0.2::DOUBLE) / (1 + ln(max(n)::DOUBLE)) AS score, count(*) = max(n_asked) AS every, count(*) FILTER (a > 0) = max(n_asked) AS cites_all, count(*) FILTER (a > 0) > 0 AS cites_any
  FROM posts JOIN aw USING (word) JOIN nw USING (q) GROUP BY q, id
), enough AS (SELECT q, count(*) FILTER (every) >= 5 AS yes FROM met GROUP BY 1
), hits AS (SELECT met.*, yes, CASE WHEN yes THEN cites_all ELSE cites_any END AS citation_hit FROM met JOIN enough USING (q) WHERE every OR NOT yes
), vec AS (SELECT q, o.id, list_cosine_similarity(e.embedding::DOUBLE[], m.v) AS similarity FROM embeddings e JOIN nodes o ON o.doc_id = e.vec_id, modes m
), kw1 AS (
  SELECT * FROM (SELECT q, h.id, row_number() OVER (PARTITION BY q ORDER BY score DESC, sort_order, h.id) AS raw FROM hits h JOIN nodes USING (id)) WHERE raw <= {pool}
), kw2 AS (SELECT q, kw1.id, raw, CAST(v.similarity AS FLOAT) AS kw_score FROM kw1 LEFT JOIN vec v USING (q, id)
), k AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY raw) AS kw_rank, kw_score FROM kw2 WHERE kw_score IS NULL OR kw_score >= 0.5
), sem AS (SELECT q, id, CAST(similarity AS FLOAT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, id) AS r FROM vec) WHERE r <= {6 * pool}
), s AS (SELECT * FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS sem_rank FROM sem) WHERE sem_rank <= {2 * pool}
), two AS (SELECT coalesce(s.q, k.q) AS q, coalesce(s.id, k.id) AS id, coalesce(s.score, kw_score) AS score, kw_rank, sem_rank FROM s FULL JOIN k ON k.q = s.q AND k.id = s.id
), legs AS (
  SELECT b.*, wc <= 3 AS short, federal, state, kw_rank IS NOT NULL AS keyword_hit,
    CASE WHEN wc >= 6 THEN CAST(greatest(coalesce(score, 0)::DOUBLE - 0.4::DOUBLE, 0.01::DOUBLE) + coalesce(CASE WHEN yes THEN 0.04::DOUBLE ELSE 0.02::DOUBLE END / (1 + (kw_rank - 1) / 10), 0) AS FLOAT)
      ELSE CAST(coalesce(1 / (60 + sem_rank), 0) + coalesce(1 / (60 + kw_rank), 0) AS FLOAT) END AS fused
  FROM two b JOIN modes USING (q) LEFT JOIN enough USING (q)
), loc AS (
  SELECT l.*, o.* EXCLUDE (id, full_text), p.path, {basis} AS is_basis, len(regexp_split_to_array({plain}, '{GAP}')) AS n_words, length({plain}) AS text_len,
    CAST(fused::DOUBLE * {times(basis, 0.5)} * {times("short AND coalesce(c.citation_hit, false)", 1.5)} AS FLOAT) AS pre
  FROM legs l JOIN nodes o ON o.id = l.id LEFT JOIN paths p ON p.id = l.id LEFT JOIN hits c ON c.q = l.q AND c.id = l.id AND c.citation_hit
), stage AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pre DESC, score DESC NULLS LAST, id) AS all_rank, row_number() OVER (PARTITION BY q, jurisdiction_level ORDER BY pre DESC, score DESC NULLS LAST, id) AS jur_rank FROM loc)
  WHERE all_rank <= {pool} OR federal AND jurisdiction_level = 'federal' AND jur_rank <= 20 OR state AND jurisdiction_level = 'state' AND jur_rank <= 20
), heading AS (SELECT *, n_words <= 20 AND id IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) AS heading_only FROM stage
), content AS (
  SELECT *, CAST(pre::DOUBLE * {times(f"coalesce(regexp_matches(path, '{Rules.DEFINITIONS_PATH}'), false) OR regexp_matches(title, '{Rules.DEFINITIONS_TITLE}')", 0.8)}
    * {times(f"regexp_matches(title, '{Rules.APPLIES_TITLE}') OR coalesce(regexp_matches(path, '{Rules.APPLIES_PATH}'), false)", 1.15)}
    * {times("NOT keyword_hit AND NOT heading_only AND text_len < 150", 0.95)} AS FLOAT) AS content_score FROM heading
), child AS (
  SELECT q, id, head_score FROM (SELECT c.q, c.id, h.content_score AS head_score, row_number() OVER (PARTITION BY c.q, c.parent_id ORDER BY c.content_score DESC, c.score DESC NULLS LAST, c.id) AS r
    FROM content c JOIN content h ON h.heading_only AND h.q = c.q AND h.id = c.parent_id) WHERE r = 1
), scored AS (
  SELECT c.*, CAST(CASE WHEN heading_only THEN content_score::DOUBLE * 0.6::DOUBLE ELSE greatest(content_score, coalesce(head_score, content_score))::DOUBLE END AS FLOAT) AS final FROM content c LEFT JOIN child USING (q, id)
), weighed AS (
  SELECT *, row_number() OVER (PARTITION BY q, jurisdiction_level ORDER BY final DESC, score DESC NULLS LAST, id) AS jrank,
    {times("federal <> state AND jurisdiction_level = CASE WHEN federal THEN 'federal' ELSE 'state' END", 1.3)} AS jur_weight FROM scored
), valued AS (SELECT *, CAST(final::DOUBLE * jur_weight AS FLOAT) AS value FROM weighed
), ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN federal AND state THEN jrank WHEN federal <> state AND NOT (jur_weight > 1 AND jrank <= 3) THEN 1 ELSE 0 END,
    CASE WHEN federal AND state AND jurisdiction_level <> 'state' THEN 1 ELSE 0 END, value DESC, score DESC NULLS LAST, sort_order, id)::INT AS position FROM valued) WHERE position <= {n}
)"""


BATCH = f"""WITH RECURSIVE {_batched()} SELECT q, position, id, keyword_hit, is_basis, round(score::DOUBLE, 4) AS score, round(value::DOUBLE, 4) AS fused, path FROM ranked"""

EVALUATION = f"""WITH RECURSIVE {_batched()}, e AS (
  SELECT a.q, min(position) FILTER (position <= 10 AND starts_with(r.id, w.id)) AS expected_at, coalesce(bool_or(position <= 10 AND starts_with(r.id, 'sec-src9-')), false) AS forbidden
  FROM asked a JOIN nodes w ON w.doc_id = a.q LEFT JOIN ranked r ON r.q = a.q GROUP BY 1)
SELECT q, expected_at, forbidden, expected_at IS NOT NULL AND NOT forbidden AS passed FROM e"""


def _stripped(c: str) -> str:
    """Links unwrapped, other tags as spaces."""
    links = rf"regexp_replace(regexp_replace(coalesce({c}, ''), '(?is)<a\b[^>]*>(.*?)</a>', '\1', 'g'), '(?is)<span\b[^>]*>(.*?)</span>', '\1', 'g')"
    return f"trim(regexp_replace(replace(replace(regexp_replace({links}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), chr(160), ' '), '{GAP}', ' ', 'g'))"


CHUNKS = rf"""WITH RECURSIVE {S.NODES_SQL}, b AS (
  SELECT id, parent_id, citation, {_stripped("full_text")} AS body, CASE WHEN summary_status <> 'rejected' THEN trim(coalesce(ai_summary, '')) ELSE '' END AS summary,
    trim(CASE jurisdiction_level WHEN 'state' THEN 'Colorado' WHEN 'federal' THEN 'Federal' ELSE jurisdiction_level END || ' regulation ' || split_part(id, '-', 2) || ': ' || citation || ' — ' || title) AS own FROM nodes
), h AS (SELECT b.id, b.body, b.summary, b.own || CASE WHEN p.body <> '' THEN chr(10) || 'Under ' || p.citation || ': ' || substr(p.body, 1, 300) ELSE '' END AS header FROM b LEFT JOIN b p ON p.id = b.parent_id
), cutting AS (
  SELECT id, body, 0 AS start FROM h WHERE length(body) > 6000
  UNION ALL SELECT id, body, CASE WHEN start + cut >= length(body) THEN length(body) ELSE greatest(start + cut - 600, start + 1) END FROM (
    SELECT id, body, start, CASE WHEN start + 6000 < length(body) AND strpos(substr(body, start + 3001, 3000), ' ') > 0 THEN 3000 + 3000 - strpos(reverse(substr(body, start + 3001, 3000)), ' ') ELSE least(6000, length(body) - start) END AS cut FROM cutting
  ) WHERE start + cut < length(body)
), cuts AS (
  SELECT id, start, trim(substr(body, start + 1, CASE WHEN start + 6000 < length(body) AND strpos(substr(body, start + 3001, 3000), ' ') > 0 THEN 3000 + 3000 - strpos(reverse(substr(body, start + 3001, 3000)), ' ') ELSE 6000 END)) AS piece FROM cutting
  UNION ALL SELECT id, 0, body FROM h WHERE length(body) <= 6000
), numbered AS (SELECT id, piece, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS i FROM cuts WHERE piece <> '' OR start = 0
), t AS (SELECT h.id, i, header || CASE WHEN i = 0 AND summary <> '' THEN chr(10) || 'Summary: ' || summary ELSE '' END || CASE WHEN piece <> '' THEN chr(10) || 'Text: ' || piece ELSE '' END AS text FROM h JOIN numbered USING (id))
SELECT id, i::INT AS chunk_index, length(text)::INT AS n_chars, sha256('voyage' || chr(0) || text) AS text_hash FROM t"""


def quality() -> str:
    """The quality checks, each as a count of offenders."""
    at = lambda condition: f"SELECT count(*) FROM n WHERE {condition}"
    target = lambda pattern: f"SELECT unnest(regexp_extract_all(full_text, '{pattern}', 1)) AS t FROM n"
    targets = " UNION ALL ".join(map(target, ['data-xref="([^"]+)"', 'href="#([^"]+)"', 'href="/regulation/[^"#]*#([^"]+)"', 'href="/provision/([^"?#]+)"']))
    marks = r"(\*\*[^*\n]+\*\*|(^|[^\w*])\*[^*\s][^*\n]*\*([^\w*]|$)|`[^`\n]+`|^#{1,6}\s|^\s*[-*+]\s|^\s*\d+\.\s)"
    checks = [
        ("empty_text", "ERROR", at("plain = ''")), ("orphan_parent", "ERROR", at("parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM n)")),
        ("missing_link_target", "ERROR", f"SELECT count(DISTINCT t) FROM ({targets}) WHERE t NOT IN (SELECT id FROM n)"), ("self_parent", "ERROR", at("id = parent_id")),
        ("duplicate_citation", "GUARD", "SELECT count(*) FROM (SELECT 1 FROM n GROUP BY reg_key, citation HAVING count(*) > 1)"),
        ("repeated_block", "GUARD", at("length(full_text) >= 50 AND (length(full_text) - length(replace(full_text, substr(full_text, 1, 50), ''))) / 50 >= 3")),
        ("summary_cut_off", "ERROR", at(r"trim(ai_summary) <> '' AND NOT regexp_matches(rtrim(ai_summary, ' '), '[.!?)\"\]]\*?\z')")),
        ("summary_longer_than_text", "REVIEW", at("length(plain) > 500 AND length(ai_summary) > length(plain)")), ("math_glyphs", "GUARD", at(r"regexp_matches(full_text, '[\x{1D400}-\x{1D7FF}]')")),
        ("split_letters", "REVIEW", at(r"regexp_matches(full_text, '(^|\W)(\p{L} ){4,}\p{L}(\W|$)')")), ("markdown", "REVIEW", at(f"regexp_matches(ai_summary, '(?m){marks}')")),
        ("page_furniture", "GUARD", at(r"regexp_matches(full_text, '(?m)^\s*Page \d+ of \d+\s*$')")), ("pending", "INFO", at("summary_status = 'pending'")),
        ("rejected_visible", "INFO", at("summary_status = 'rejected' AND is_public")),
    ]
    rows = " UNION ALL ".join(f"SELECT '{name}' AS name, '{severity}' AS severity, ({count}) AS n" for name, severity, count in checks)
    return f"""WITH {S.NODES_SQL}, n AS (SELECT *, {_plain("full_text")} AS plain FROM nodes), c AS ({rows})
SELECT name, severity, n, CASE WHEN n = 0 THEN 'ok' WHEN severity IN ('ERROR', 'GUARD') THEN 'fail' ELSE 'look' END AS verdict FROM c"""
