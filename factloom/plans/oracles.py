"""DuckDB SQL for the queries, put together from the same definitions as the Spark expressions."""

from __future__ import annotations

from factloom.functions.text import ABBREVIATIONS, AUXILIARIES
from factloom.operators.evaluate import ADAPTERS, TYPE_WEIGHTS
from factloom.operators.extract import EXTERNAL_VERBS, GROUND_VERBS, VERBS, verb_pattern
from factloom.operators.strategies import MOCK, MOCK_ELSE
from factloom.sources.fixtures import EVALUATION_FACTS, case_rows


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def collapse(c: str) -> str:
    return rf"regexp_replace({c}, '\s+', ' ', 'g')"


def norm(c: str) -> str:
    return rf"""regexp_replace({collapse(f"lower({strip(c)})")}, '["''`,.;:!?()\[\]{{}}]', '', 'g')"""


def canon(c: str) -> str:
    return f"regexp_replace(replace({norm(c)}, ' ', '_'), '^({'|'.join(AUXILIARIES)})_', '')"


def cid(s: str, p: str, o: str) -> str:
    return f"substr(md5({s} || '|' || {p} || '|' || {o}), 1, 12)"


def sentence_list(c: str) -> str:
    safe = rf"regexp_replace({strip(c)}, '\b({'|'.join(ABBREVIATIONS)})\.\s', '\1<PERIOD> ', 'g')"
    parts = rf"string_split(regexp_replace({safe}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))"
    return f"list_filter(list_transform({parts}, lambda p: {strip("replace(p, '<PERIOD>', '.')")}), lambda p: p <> '')"


def triple(s: str) -> str:
    """CASE over the verbs; s must be a column that holds the bare sentence."""
    out = "CASE"
    for predicate, verb in VERBS:
        pattern = lit("(?i)" + verb_pattern(verb))
        a, b = strip(f"regexp_extract({s}, {pattern}, 1)"), strip(f"regexp_extract({s}, {pattern}, 2)")
        out += f" WHEN length({a}) >= 2 AND length({b}) >= 2 THEN {{'subject': {a}, 'predicate': '{predicate}', 'object': {b}}}"
    return out + " END"


def claims(source: str, key: str, column: str = "text") -> str:
    """CTEs ending in claims(key, claim_idx, subject, predicate, object, raw, confidence)."""
    some = lit(r"(?i)\s(?:" + "|".join(v for _, v in VERBS) + r")\s")
    return rf"""cl_s AS (SELECT {key}, unnest(x) AS raw, unnest(range(len(x))) AS idx FROM (SELECT {key}, {sentence_list(column)} AS x FROM {source})),
cl_b AS (SELECT *, {strip("regexp_replace(raw, '[.!?]+$', '')")} AS bare FROM cl_s),
cl_t AS (SELECT *, {triple("bare")} AS t FROM cl_b WHERE regexp_matches(bare, {some})),
claims AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY idx) - 1 AS INTEGER) AS claim_idx, t.subject AS subject, t.predicate AS predicate, t.object AS object, raw, 0.7 AS confidence FROM cl_t WHERE t IS NOT NULL)"""


ROWS = """fact_rows AS (SELECT CAST(n_nationkey AS BIGINT) AS fact_seq, n_name AS subject, 'is part of' AS predicate, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_suppkey + 1000, s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
TEXTS = """texts AS (SELECT s_suppkey AS text_id, CASE s_suppkey % 5 WHEN 0 THEN s_name || ' is located in ' || n_name || '.'
WHEN 1 THEN s_name || ' is located in NATION_' || ((s_nationkey + 1) % 25) || '.' WHEN 2 THEN 'Supplier#9' || substr(s_name, 11, 20) || ' is located in ' || n_name || '.'
WHEN 3 THEN 'Hello there, ' || s_name || '!' ELSE 'Depot ' || s_suppkey || ' is located in Atlantis' || s_suppkey || '.' END AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
REPLIES = r"""judged_k AS (SELECT text_id, s.sample AS sample, (text_id * 7 + s.sample * 3) % 6 AS k FROM texts, (VALUES (0), (1), (2)) AS s(sample)),
replies AS (SELECT text_id, sample, CASE k WHEN 0 THEN 'VERDICT: TRUE' || chr(10) || 'CONFIDENCE: 0.9' || chr(10) || 'REASONING: It holds: see the list.' WHEN 1 THEN 'VERDICT: FALSE' || chr(10) || 'CONFIDENCE: high' || chr(10) || 'REASONING: No.'
WHEN 2 THEN 'verdict: true and false' || chr(10) || 'CONFIDENCE: 0.4' WHEN 3 THEN 'I cannot tell' WHEN 4 THEN NULL ELSE 'VERDICT: FALSE' || chr(10) || 'CONFIDENCE: 0.75' || chr(10) || 'REASONING: Wrong place.' END AS reply FROM judged_k)"""
MEMORY = """memory AS (SELECT 'c' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS claim_id, item_id AS seq, text, CASE item_id % 4 WHEN 0 THEN 'refuted' WHEN 1 THEN 'cached' ELSE 'verified' END AS status,
(item_id % 10 + 1) / 10.0 AS confidence, 'item ' || item_id AS subject, 'is' AS predicate, 'a passage' AS object FROM benchmark)"""


def kb(rows: str = "fact_rows") -> str:
    return f"""f0 AS (SELECT *, 1.0 AS confidence, 'kb' AS source, {norm("subject")} AS s_norm, {norm("object")} AS o_norm, {canon("predicate")} AS p_canon,
'rel:' || substr(md5(CAST(fact_seq AS VARCHAR) || '|' || subject || '|' || predicate || '|' || object), 1, 12) AS rel_id FROM {rows}),
ents AS (SELECT entity, min_by(label, pos) AS label FROM (SELECT s_norm AS entity, fact_seq * 2 AS pos, subject AS label FROM f0 UNION ALL SELECT o_norm, fact_seq * 2 + 1, object FROM f0) GROUP BY entity),
facts AS (SELECT f0.*, {canon("p_canon")} AS p_canon2, a.label AS s_label, b.label AS o_label FROM f0 JOIN ents a ON a.entity = s_norm JOIN ents b ON b.entity = o_norm)"""


TOKENS = r"""list_filter(string_split(regexp_replace(regexp_replace({c}, '[^a-z0-9_ ]+', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w <> '')"""


def words(c: str) -> str:
    return TOKENS.format(c=f"lower({c})")


def tokens(w: str) -> str:
    """w: a column that holds the words."""
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || '_' || {w}[i + 1]))"


def bucketed(name: str, source: str) -> str:
    """name(x, bucket, n, norm2) of the distinct strings x of source."""
    return f"""{name}_w AS (SELECT x, {words("x")} AS w FROM (SELECT DISTINCT x FROM ({source}))),
{name}_c AS (SELECT x, bucket, count(*) AS n FROM (SELECT x, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 512 AS bucket FROM (SELECT x, unnest({tokens("w")}) AS t FROM {name}_w)) GROUP BY x, bucket),
{name} AS (SELECT *, sum(n * n) OVER (PARTITION BY x) AS norm2 FROM {name}_c)"""


def cosines(name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT a.x AS a, b.x AS b, sum(a.n * b.n) / sqrt(CAST(any_value(a.norm2) * any_value(b.norm2) AS DOUBLE)) AS sim FROM {a} a JOIN {b} b USING (bucket) GROUP BY a.x, b.x)"


SCORED = f"""ct AS (SELECT DISTINCT subject, predicate, object, {canon("predicate")} AS c_p FROM claims),
{bucketed("b_cs", "SELECT subject AS x FROM ct")}, {bucketed("b_fs", "SELECT s_label AS x FROM facts")}, {cosines("s_s", "b_cs", "b_fs")},
{bucketed("b_cp", "SELECT c_p AS x FROM ct")}, {bucketed("b_fp", "SELECT p_canon2 AS x FROM facts")}, {cosines("s_p", "b_cp", "b_fp")},
{bucketed("b_co", "SELECT object AS x FROM ct")}, {bucketed("b_fo", "SELECT o_label AS x FROM facts")}, {cosines("s_o", "b_co", "b_fo")},
scores AS (SELECT ct.subject, ct.predicate, ct.object, fact_seq, rel_id, s_label || '|' || p_canon || '|' || o_label AS fact,
CAST(0.30 AS DOUBLE) * coalesce(s_s.sim, 0) + CAST(0.45 AS DOUBLE) * coalesce(s_p.sim, 0) + CAST(0.25 AS DOUBLE) * coalesce(s_o.sim, 0) AS score
FROM ct CROSS JOIN facts LEFT JOIN s_s ON s_s.a = ct.subject AND s_s.b = s_label LEFT JOIN s_p ON s_p.a = c_p AND s_p.b = p_canon2 LEFT JOIN s_o ON s_o.a = ct.object AND s_o.b = o_label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY score DESC, fact_seq) AS rank FROM scores)"""


def probed(key: str, source: str, threshold: float = 0.7, column: str = "text") -> str:
    """CTEs ending in probed(key, claim_idx, subject, predicate, object, verdict, score, matched, reason, proof_rel); facts must be there."""
    return f"""{claims(source, key, column)}, {SCORED},
ck AS (SELECT *, {norm("subject")} AS c_s, {canon("predicate")} AS c_p, {norm("object")} AS c_o FROM claims),
ex AS (SELECT s_norm, p_canon2, o_norm, min_by(rel_id, fact_seq) AS exact_rel FROM facts GROUP BY ALL),
con AS (SELECT {key}, claim_idx, string_agg(s_label || '|' || p_canon || '|' || o_label, ';' ORDER BY fact_seq) AS facts, count(*) AS n FROM ck JOIN facts ON s_norm = c_s AND p_canon2 = c_p AND o_norm <> c_o GROUP BY ALL),
probed AS (SELECT ck.{key}, ck.claim_idx, ck.subject, ck.predicate, ck.object, CASE WHEN exact_rel IS NOT NULL THEN 'PASS' WHEN con.n > 0 THEN 'CONTRADICT' WHEN r.score >= CAST({threshold} AS DOUBLE) THEN 'SOFT_PASS' ELSE 'FAIL' END AS verdict,
CASE WHEN exact_rel IS NOT NULL THEN 1.0 WHEN con.n > 0 THEN 0.0 ELSE coalesce(r.score, 0.0) END AS score,
CASE WHEN exact_rel IS NOT NULL THEN ck.subject || '|' || ck.predicate || '|' || ck.object WHEN con.n > 0 THEN con.facts ELSE coalesce(r.fact, '') END AS matched,
CASE WHEN exact_rel IS NOT NULL THEN 'Exact match found in KB.' WHEN con.n > 0 THEN 'Contradicts ' || con.n || ' fact(s) in KB.' WHEN r.score >= CAST({threshold} AS DOUBLE) THEN 'Soft match (score=' || format('{{:.3f}}', r.score) || ') above threshold={threshold}.' ELSE 'No supporting fact found in KB.' END AS reason,
CASE WHEN exact_rel IS NOT NULL THEN exact_rel WHEN con.n > 0 THEN NULL WHEN r.score >= CAST({threshold} AS DOUBLE) THEN r.rel_id END AS proof_rel
FROM ck LEFT JOIN ex ON s_norm = c_s AND p_canon2 = c_p AND o_norm = c_o LEFT JOIN con ON con.{key} = ck.{key} AND con.claim_idx = ck.claim_idx LEFT JOIN ranked r ON r.rank = 1 AND r.subject = ck.subject AND r.predicate = ck.predicate AND r.object = ck.object
UNION ALL SELECT {key}, 0, '', 'unknown', '', 'UNKNOWN', 0.0, '', 'No claims could be extracted from text.', NULL FROM {source} WHERE {key} NOT IN (SELECT {key} FROM claims))"""


BASE = f"{ROWS}, {kb()}, {TEXTS}"
PROBED = f"WITH {BASE}, {probed('text_id', 'texts')}"
STATUS = "CASE WHEN verdict IN ('PASS', 'SOFT_PASS') THEN 'verified' WHEN verdict IN ('FAIL', 'CONTRADICT') THEN 'refuted' ELSE 'unverifiable' END"
CONFIDENCE = "CASE WHEN verdict = 'PASS' THEN 1.0 WHEN verdict = 'SOFT_PASS' THEN score WHEN verdict IN ('FAIL', 'CONTRADICT') THEN CASE WHEN score > 0 THEN 1.0 - score ELSE 0.9 END ELSE 0.5 END"


def judgement(key: str, source: str) -> str:
    """CTEs ending in judged(key, verdict, confidence, reasoning)."""
    return rf"""jl AS (SELECT {key}, reply, string_split({strip("reply")}, chr(10)) AS lines FROM {source}),
jv AS (SELECT {key}, reply, list_filter(lines, lambda x: contains(upper(x), 'VERDICT:'))[-1] AS v,
list_filter(list_transform(list_filter(lines, lambda x: contains(upper(x), 'CONFIDENCE:') AND NOT contains(upper(x), 'VERDICT:')), lambda x: TRY_CAST({strip("string_split(x, ':')[2]")} AS DOUBLE)), lambda x: x IS NOT NULL)[-1] AS c,
list_filter(lines, lambda x: contains(upper(x), 'REASONING:') AND NOT contains(upper(x), 'CONFIDENCE:') AND NOT contains(upper(x), 'VERDICT:'))[-1] AS r FROM jl),
judged AS (SELECT {key}, CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN contains(upper(v), 'TRUE') THEN 'PASS' WHEN contains(upper(v), 'FALSE') THEN 'FAIL' ELSE 'UNKNOWN' END AS verdict,
CASE WHEN reply IS NULL THEN 0.0 ELSE coalesce(c, 0.5) END AS confidence, CASE WHEN reply IS NULL THEN NULL WHEN r IS NULL THEN reply ELSE {strip("substr(r, strpos(r, ':') + 1)")} END AS reasoning FROM jv)"""


def parsed(column: str, verbs: list[str], lower: bool) -> str:
    out = "CASE"
    for verb in verbs:
        p = lit(rf"(?i)^(.+?)\s+({verb})\s+(.+?)\.?$")
        part = [strip(f"regexp_extract({column}, {p}, {k})") for k in (1, 2, 3)]
        out += f" WHEN regexp_matches({column}, {p}) THEN {{'subject': {part[0]}, 'predicate': {f'lower({part[1]})' if lower else part[1]}, 'object': {part[2]}}}"
    return out + " END"


def mock(column: str) -> str:
    cases = " ".join(f"WHEN contains(lower({column}), '{a}') AND contains(lower({column}), '{b}') THEN {lit(reply)}" for (a, b), reply in MOCK)
    return f"CASE {cases} ELSE {lit(MOCK_ELSE)} END"


INVENTORS = values("inventors", "item_label, value_label, row_seq", [("telephone", "Alexander Graham Bell", 0), ("the telephone", "Antonio Meucci", 1), ("light bulb", "Thomas Edison", 2), ("radio", "Guglielmo Marconi", 3), ("the radio", "Guglielmo Marconi", 4), ("radium", "Marie Curie", 5), ("radium", "Pierre Curie", 6), ("World Wide Web", "Tim Berners-Lee", 7), ("printing press", "Johannes Gutenberg", 8), ("gravity", None, 9), ("theory of relativity", "Albert Einstein", 10)])
CASE_ROWS = values("cases", "case_id, set_key, case_idx, text, is_true, h_type", case_rows())


def external(key: str, source: str) -> str:
    """CTEs ending in ext(key, status, confidence, reason)."""
    return f"""{INVENTORS}, xp AS (SELECT {key}, {parsed("text", EXTERNAL_VERBS, True)} AS t FROM {source}),
xv AS (SELECT {key}, t.subject AS subject, t.object AS object, unnest([t.object, 'the ' || t.object, replace(t.object, 'the ', '')]) AS item_label, unnest([0, 1, 2]) AS variant FROM xp WHERE t.predicate IN ('invented', 'discovered', 'created')),
xj AS (SELECT xv.*, value_label, row_seq, min(variant) OVER (PARTITION BY {key}) AS first FROM xv JOIN inventors USING (item_label)),
xr AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY row_seq) AS r FROM xj WHERE variant = first),
xf AS (SELECT {key}, min_by(lower(coalesce(value_label, '')), r) FILTER (contains(lower(coalesce(value_label, '')), lower(subject)) OR contains(lower(subject), lower(coalesce(value_label, '')))) AS hit, min_by(coalesce(value_label, 'Unknown'), r) AS top FROM xr WHERE r <= 5 GROUP BY {key}),
ext AS (SELECT xp.{key}, CASE WHEN hit IS NOT NULL THEN 'verified' WHEN top IS NOT NULL THEN 'refuted' ELSE 'unverifiable' END AS status, CASE WHEN t IS NULL THEN 0.0 WHEN hit IS NOT NULL THEN 0.95 WHEN top IS NOT NULL THEN 0.9 ELSE 0.5 END AS confidence,
CASE WHEN t IS NULL THEN 'Could not parse claim structure' WHEN t.predicate NOT IN ('invented', 'discovered', 'created') THEN 'Predicate ''' || t.predicate || ''' not yet supported' WHEN hit IS NOT NULL THEN 'The mirror confirms: ' || hit || ' invented ' || t.object
WHEN top IS NOT NULL THEN 'The mirror shows ' || top || ' invented ' || t.object || ', not ' || t.subject ELSE 'Could not find ''' || t.object || ''' in the mirror' END AS reason FROM xp LEFT JOIN xf USING ({key}))"""


def adapter(column: str, name: str) -> str:
    true, false = ADAPTERS[name]
    return f"CASE WHEN {column} IN ({', '.join(map(lit, true))}) THEN true WHEN {column} IN ({', '.join(map(lit, false))}) THEN false END"


EVALUATED = f"""WITH {CASE_ROWS}, {values("evaluation_facts", "fact_seq, subject, predicate, object", [(k, *f) for k, f in enumerate(EVALUATION_FACTS)])}, {kb("evaluation_facts")}, {probed("case_id", "cases")},
mocked AS (SELECT case_id, {mock("text")} AS reply FROM cases), {judgement("case_id", "mocked")}, {external("case_id", "cases")},
predictions AS (SELECT 'kb_probe' AS algo, case_id, verdict, {adapter("verdict", "kb_probe")} AS actual, 1.0 AS latency_ms FROM probed WHERE claim_idx = 0
UNION ALL SELECT 'judge', case_id, verdict, {adapter("verdict", "judge")}, 200.0 FROM judged
UNION ALL SELECT 'self_consistency', case_id, verdict, {adapter("verdict", "self_consistency")}, 500.0 FROM (SELECT case_id, CASE WHEN contains(upper(reply), 'TRUE') THEN 'PASS' WHEN contains(upper(reply), 'FALSE') THEN 'FAIL' ELSE 'UNKNOWN' END AS verdict FROM mocked) UNION ALL SELECT 'external', case_id, status, {adapter("status", "external")}, 130.0 FROM ext),
results AS (SELECT cases.*, algo, verdict, latency_ms, coalesce(actual = is_true, false) AS passed FROM cases JOIN predictions USING (case_id)),
metrics AS (SELECT algo, set_key, h_type, count(*) AS tested, CAST(sum(CAST(passed AS BIGINT)) AS BIGINT) AS passed, avg(CAST(latency_ms AS DOUBLE)) AS latency_ms, CASE grouping_id(set_key, h_type) WHEN 1 THEN 'set' WHEN 2 THEN 'type' ELSE 'all' END AS level_of, sum(CAST(passed AS BIGINT)) / count(*) AS rate
FROM results GROUP BY GROUPING SETS ((algo, set_key), (algo, h_type), (algo)))"""

SHA = "list_transform(range(0, 32), lambda i: CAST('0x' || substr(sha256(lower({c})), 2 * i + 1, 2) AS INTEGER) / CAST(255.0 AS DOUBLE))"


def dot(a: str, b: str) -> str:
    return f"list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])), lambda s, x: s + x)"


def cosine(a: str, b: str, eps: str = "0") -> str:
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}) + {eps}))"


PROPS = "props AS (SELECT fact_seq AS seq, subject, predicate, object, subject || ' ' || replace(predicate, '_', ' ') || ' ' || object AS raw_text, 1.0 AS confidence FROM fact_rows)"
STORE = f"""{ROWS}, {PROPS},
se AS (SELECT lower(name) AS k, min_by(name, pos) AS name, min(pos) AS pos FROM (SELECT seq * 2 AS pos, subject AS name FROM props UNION ALL SELECT seq * 2 + 1, object FROM props) GROUP BY lower(name)),
sp AS (SELECT lower(predicate) AS k, min_by(predicate, seq) AS name, min(seq) AS pos FROM props GROUP BY lower(predicate))"""
KEYWORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda w: w <> ''))"
JSON_SLICE = """jr AS (SELECT event_id, 'user ' || user_id AS u, event_type, event_id % 5 AS k FROM events),
jt AS (SELECT event_id, k, u, event_type, u || ' created a ' || event_type || '. It was on a list.' AS text FROM jr)"""
MODEL_CLAIMS = """SELECT event_id, CAST(0 AS INTEGER) AS claim_idx, u AS subject, 'made' AS predicate, 'a ' || event_type AS object, text AS raw, 0.9 AS confidence FROM jt WHERE k = 0
UNION ALL SELECT event_id, 0, u, 'unknown', '', text, 0.8 FROM jt WHERE k = 1 UNION ALL SELECT event_id, 1, 'x', 'created', event_type, text, 0.8 FROM jt WHERE k = 1"""


def hits(queries: str, key: str, top_k: int = 5, least: float = 0.5) -> str:
    """CTEs ending in hits(key, claim_id, score, rank); memory must be there."""
    return f"""qk AS (SELECT {key}, {KEYWORDS.format(c="text")} AS q FROM {queries}), qe AS (SELECT {key}, len(q) AS n, unnest(q) AS keyword FROM qk),
mk AS (SELECT claim_id, seq, unnest({KEYWORDS.format(c="text")}) AS keyword FROM memory WHERE status IN ('verified', 'cached') AND confidence >= {least}),
ho AS (SELECT {key}, claim_id, seq, count(*) / n AS score FROM qe JOIN mk USING (keyword) GROUP BY {key}, n, claim_id, seq),
hits AS (SELECT {key}, claim_id, score, CAST(row_number() OVER (PARTITION BY {key} ORDER BY score DESC, seq) AS INTEGER) AS rank FROM ho QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, seq) <= {top_k})"""


CONFIDENCE_OF_SEQ = "(seq % 10 + 1) / CAST(10.0 AS DOUBLE)"
CONCEPTS = f"""{ROWS}, {PROPS}, cc AS (SELECT *, CAST({CONFIDENCE_OF_SEQ} AS VARCHAR) AS c FROM props),
concepts AS (SELECT seq, 'claim_' || seq AS uuid, 'Claim' AS prototype, subject || ' ' || predicate || ' ' || object AS text, c AS confidence, subject, predicate, object FROM cc
UNION ALL SELECT seq, 'verification_' || seq, 'Verification_result', 'verified ' || c || ' kb 0.0', c, NULL, NULL, NULL FROM cc
UNION ALL SELECT seq, 'source_' || seq, 'Source', 'kb src' || (seq % 7) || ' ' || c, NULL, NULL, NULL, NULL FROM cc),
asked AS (SELECT n_nationkey, n_name || ' is part of somewhere' AS text FROM nation)"""


def searched(least: float) -> str:
    """CTEs ending in found(n_nationkey, uuid, similarity, rank, subject, predicate, object)."""
    return f"""qe AS (SELECT n_nationkey, {SHA.format(c="text")} AS q FROM asked), ce AS (SELECT *, {SHA.format(c="text")} AS e FROM concepts),
found AS (SELECT n_nationkey, uuid, similarity, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY round(similarity, 12) DESC, uuid) AS INTEGER) AS rank, subject, predicate, object
FROM (SELECT n_nationkey, uuid, {cosine("q", "e")} AS similarity, subject, predicate, object FROM qe, ce) WHERE similarity >= {least} QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY round(similarity, 12) DESC, uuid) <= 5)"""


def made_in_order(pairs: str, nodes: str) -> str:
    """CTEs ending in made(n): of nodes(n), in order, those without an earlier made partner in pairs(a, b)."""
    return f"""adj AS (SELECT b, list(a) AS earlier FROM {pairs} GROUP BY b), ord AS (SELECT n, row_number() OVER (ORDER BY n) AS pos, coalesce(earlier, []) AS earlier FROM {nodes} LEFT JOIN adj ON b = n),
step(pos, done) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT ord.pos, CASE WHEN len(list_intersect(done, earlier)) = 0 THEN list_append(done, n) ELSE done END FROM step JOIN ord ON ord.pos = step.pos + 1),
made AS (SELECT unnest(done) AS n FROM step WHERE pos = (SELECT max(pos) FROM step))"""


def texted(reports: str) -> str:
    rule = lambda c: f"repeat('{c}', 80)"
    return f"""rc AS (SELECT p.text_id, p.claim_idx, '[Claim ' || (p.claim_idx + 1) || ']' || chr(10) || '  Raw: ' || coalesce(c.raw, t.text) || chr(10) || '  Triple: (' || p.subject || ', ' || p.predicate || ', ' || p.object || ')' || chr(10)
|| '  Verdict: ' || verdict || ' (score=' || format('{{:.3f}}', CAST(score AS DOUBLE)) || ')' || CASE WHEN matched <> '' THEN chr(10) || '  Matched: (' || replace(string_split(matched, ';')[1], '|', ', ') || ')' ELSE '' END || chr(10) || '  Reason: ' || reason AS t
FROM probed p LEFT JOIN claims c ON c.text_id = p.text_id AND c.claim_idx = p.claim_idx JOIN texts t ON t.text_id = p.text_id),
rl AS (SELECT text_id, string_agg(t, chr(10) || chr(10) ORDER BY claim_idx) AS claims FROM rc GROUP BY text_id), rr AS ({reports})
SELECT rr.text_id, concat_ws(chr(10), {rule("=")}, 'CONSISTENCY REPORT', {rule("=")}, 'Text: ' || CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END, 'Claims extracted: ' || claims_extracted, 'Overall score: ' || format('{{:.3f}}', overall_score),
'Pass rate: ' || format('{{:.1f}}', pass_rate * 100) || '%', {rule("-")}, rl.claims, {rule("=")}) AS report FROM rr JOIN rl USING (text_id) JOIN texts USING (text_id)"""


REPORTS = "SELECT text_id, CAST(sum(CAST(verdict <> 'UNKNOWN' AS BIGINT)) AS BIGINT) AS claims_extracted, round(avg(score), 4) AS overall_score, round(avg(CAST(verdict IN ('PASS', 'SOFT_PASS') AS DOUBLE)), 4) AS pass_rate FROM probed GROUP BY text_id"
GEXF = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed" mode="static"><attributes class="node" mode="static"><attribute id="0" title="kind" type="string"/></attributes><attributes class="edge" mode="static"><attribute id="1" title="role" type="string"/></attributes>'
BY_SAMPLE = "rk AS (SELECT text_id || ':' || sample AS key, reply FROM replies)"

ORACLE = {
    "sentence_split": f"WITH s AS (SELECT doc_id, {sentence_list('text')} AS x FROM documents) SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS idx, unnest(x) AS sentence FROM s",
    "norm_text": f"SELECT conv_id, turn, {norm('text')} AS norm FROM conversations",
    "canon_predicate": f"WITH p AS (SELECT p_partkey, (['is ', 'Was_', 'be ', 'has '])[p_partkey % 4 + 1] || p_name AS c FROM part) SELECT p_partkey, {canon('c')} AS predicate FROM p",
    "claim_keys": f"WITH {ROWS} SELECT fact_seq, {cid('subject', 'predicate', 'object')} AS claim_id, {collapse(strip('lower(subject)'))} || '|' || {collapse(strip('lower(predicate)'))} || '|' || {collapse(strip('lower(object)'))} AS sig, {strip('lower(subject)')} AS cache_key FROM fact_rows",
    "hash_tokens": f"WITH w AS (SELECT p_partkey, {words("p_name || ' ' || p_type")} AS w FROM part) SELECT p_partkey, array_to_string({tokens('w')}, ',') AS tokens FROM w",
    "hash_embed": f"WITH {bucketed('b', 'SELECT p_name AS x FROM part')} SELECT x AS p_name, CAST(bucket AS INTEGER) AS bucket, round(n / sqrt(CAST(norm2 AS DOUBLE)), 6) AS v FROM b",
    "hash_cosines": f"WITH {bucketed('l', 'SELECT p_name AS x FROM part')}, {bucketed('r', "SELECT p_name || ' ' || p_type AS x FROM part")}, {cosines('c', 'l', 'r')} SELECT a, b, round(sim, 6) AS cos FROM c",
    "sha_embed": f"WITH e AS (SELECT n_nationkey, {SHA.format(c='n_name')} AS v FROM nation) SELECT n_nationkey, CAST(unnest(range(0, 32)) AS INTEGER) AS i, round(unnest(v), 6) AS v FROM e",
    "vector_cosine": f"WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT label, min_by(v, vec_id) AS h FROM e GROUP BY label) SELECT vec_id, round({cosine('v', 'h')}, 6) AS cos, round({cosine('v', 'h', '1e-9')}, 6) AS cos_eps FROM e JOIN h USING (label)",
    "extract_claims_documents": f"WITH {claims('documents', 'doc_id')} SELECT * FROM claims",
    "extract_claims_conversations": f"WITH c AS (SELECT conv_id || ':' || turn AS key, text FROM conversations), {claims('c', 'key')} SELECT * FROM claims",
    "extract_claims_generated": f"WITH {TEXTS}, {claims('texts', 'text_id')} SELECT * FROM claims",
    "json_extract_claims": f"WITH {JSON_SLICE}, fb AS (SELECT event_id, text FROM jt WHERE k >= 3), {claims('fb', 'event_id')} {MODEL_CLAIMS} UNION ALL SELECT event_id, claim_idx, subject, predicate, object, raw, confidence FROM claims",
    "hybrid_extract": f"""WITH {JSON_SLICE}, {claims('jt', 'event_id')}, m AS ({MODEL_CLAIMS} UNION ALL SELECT event_id, claim_idx, subject, predicate, object, raw, confidence FROM claims WHERE event_id % 5 >= 3),
ms AS (SELECT *, {collapse(strip('lower(subject)'))} || '|' || {collapse(strip('lower(predicate)'))} || '|' || {collapse(strip('lower(object)'))} AS sig FROM m),
rs AS (SELECT *, {collapse(strip('lower(subject)'))} || '|' || {collapse(strip('lower(predicate)'))} || '|' || {collapse(strip('lower(object)'))} AS sig FROM claims),
rn AS (SELECT * FROM rs WHERE NOT EXISTS (SELECT 1 FROM ms WHERE ms.event_id = rs.event_id AND ms.sig = rs.sig) QUALIFY row_number() OVER (PARTITION BY event_id, sig ORDER BY claim_idx) = 1),
mc AS (SELECT event_id, count(*) AS before FROM m GROUP BY event_id)
SELECT event_id, claim_idx, subject, predicate, object, raw, confidence, 'model' AS source FROM m
UNION ALL SELECT rn.event_id, CAST(row_number() OVER (PARTITION BY rn.event_id ORDER BY claim_idx) - 1 + coalesce(before, 0) AS INTEGER), subject, predicate, object, raw, confidence, 'rules' FROM rn LEFT JOIN mc USING (event_id)""",
    "parse_triples": f"WITH {TEXTS}, p AS (SELECT text_id, {parsed('text', EXTERNAL_VERBS, True)} AS e, {parsed('text', GROUND_VERBS, False)} AS g FROM texts) SELECT text_id, concat_ws('|', e.subject, e.predicate, e.object) AS external, concat_ws('|', g.subject, g.predicate, g.object) AS ground FROM p",
    "kb_facts": f"WITH {ROWS}, {kb()} SELECT fact_seq, rel_id, subject, predicate, object, confidence, source, s_norm, p_canon, p_canon2, o_norm, s_label, o_label FROM facts",
    "kb_entities": f"WITH {ROWS}, {kb()} SELECT entity, label FROM ents",
    "kb_edges": f"WITH {ROWS}, {kb()} SELECT 'ent:' || s_norm AS src, rel_id AS dst, 'subj' AS role FROM facts UNION ALL SELECT rel_id, 'ent:' || o_norm, 'obj' FROM facts",
    "kb_stats": f"WITH {ROWS}, {kb()} SELECT (SELECT count(*) FROM ents) AS entities, count(*) AS relations, count(*) * 2 AS edges FROM facts",
    "exact_match": f"{PROBED} SELECT text_id, claim_idx, exact_rel AS rel_id FROM ck LEFT JOIN ex ON s_norm = c_s AND p_canon2 = c_p AND o_norm = c_o",
    "contradictions": f"{PROBED} SELECT text_id, claim_idx, facts FROM con",
    "soft_match_topk": f"{PROBED} SELECT subject, predicate, object, CAST(rank AS INTEGER) AS rank, fact_seq, round(score, 6) AS score FROM ranked WHERE rank <= 3 AND score >= CAST(0.7 AS DOUBLE)",
    "closest_fact": f"{PROBED} SELECT subject, predicate, object, rel_id, round(score, 6) AS score FROM ranked WHERE rank = 1",
    "probe_verdicts": f"{PROBED} SELECT text_id, claim_idx, subject, predicate, object, verdict, round(score, 6) AS score, matched, reason FROM probed",
    "probe_report": f"{PROBED} {REPORTS}",
    "proof_subgraph": f"{PROBED}, rel AS (SELECT DISTINCT proof_rel FROM probed WHERE proof_rel IS NOT NULL) SELECT 'ent:' || s_norm AS src, rel_id AS dst, 'subj' AS role FROM facts JOIN rel ON rel_id = proof_rel UNION ALL SELECT rel_id, 'ent:' || o_norm, 'obj' FROM facts JOIN rel ON rel_id = proof_rel",
    "proof_json": f"""{PROBED}, rel AS (SELECT DISTINCT proof_rel FROM probed WHERE proof_rel IS NOT NULL) SELECT rel_id,
'{{"nodes":[{{"id":"ent:' || s_norm || '","kind":"entity","label":"' || s_label || '"}},{{"id":"' || rel_id || '","kind":"relation","label":"' || p_canon || '"}},{{"id":"ent:' || o_norm || '","kind":"entity","label":"' || o_label || '"}}],"edges":[{{"source":"ent:' || s_norm || '","target":"' || rel_id || '","role":"subj"}},{{"source":"' || rel_id || '","target":"ent:' || o_norm || '","role":"obj"}}]}}' AS json FROM facts JOIN rel ON rel_id = proof_rel""",
    "prove": f"{PROBED} SELECT text_id, {STATUS} AS status, round({CONFIDENCE}, 6) AS confidence, verdict, {cid('subject', 'predicate', 'object')} AS claim_id FROM probed WHERE claim_idx = 0",
    "claim_upsert": "SELECT user_id || '|' || event_type AS claim_id, min(event_id) AS seq, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "claim_keywords": f"WITH {MEMORY} SELECT unnest({KEYWORDS.format(c='text')}) AS keyword, claim_id FROM memory",
    "memory_stats": f"WITH {MEMORY} SELECT status, count(*) AS claims FROM memory GROUP BY status",
    "memory_retrieve_keyword": f"WITH {MEMORY}, {hits('documents', 'doc_id')} SELECT doc_id, claim_id, round(score, 6) AS score, rank FROM hits",
    "memory_retrieve_vector": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id AS claim_id, {cosine('q.v', 'e.v')} AS score FROM e q, e WHERE q.vec_id % 20 = 0)
SELECT query_id, claim_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) <= 5""",
    "rag_context": f"WITH {MEMORY}, turns AS (SELECT conv_id || ':' || turn AS key, text FROM conversations), {hits('turns', 'key')} SELECT key, 'Verified facts:' || chr(10) || string_agg('- ' || subject || ' ' || predicate || ' ' || object || ' (confidence: ' || CAST(round(confidence * 100) AS INTEGER) || '%)', chr(10) ORDER BY rank) AS context FROM hits JOIN memory USING (claim_id) GROUP BY key",
    "agent_verify": f"""{PROBED}, {MEMORY}, {hits('texts', 'text_id', 3, 0.8)}, ca AS (SELECT DISTINCT text_id AS cached_id FROM hits),
pr AS (SELECT text_id, {STATUS} AS st, {CONFIDENCE} AS cf, {cid('subject', 'predicate', 'object')} AS claim_id, cached_id IS NOT NULL AS cached FROM probed LEFT JOIN ca ON cached_id = text_id WHERE claim_idx = 0)
SELECT text_id, CASE WHEN st = 'unverifiable' AND text_id % 2 = 0 THEN 'verified' ELSE st END AS status, round(CASE WHEN st = 'unverifiable' AND text_id % 2 = 0 THEN 0.8 ELSE cf END, 6) AS confidence, CASE WHEN st = 'verified' THEN claim_id END AS stored,
CAST(1 + CAST(cached AS INTEGER) + CAST(st = 'verified' AS INTEGER) + CAST(st = 'unverifiable' AS INTEGER) AS INTEGER) AS steps FROM pr""",
    "consensus_ingest": f"""WITH {ROWS}, g AS (SELECT subject, predicate, CASE WHEN fact_seq % 3 = 1 THEN object ELSE 'elsewhere' END AS go, CASE WHEN fact_seq % 2 = 0 THEN 0.95 ELSE 0.6 END AS gc FROM fact_rows WHERE fact_seq % 3 <> 0)
SELECT r.subject, r.predicate, r.object, CASE WHEN go IS NULL THEN 'llm_generated' WHEN go = r.object THEN 'verified' ELSE 'contested' END AS status, round(CASE WHEN go IS NULL THEN 0.5 WHEN go = r.object THEN least(1.0, gc + 0.1) ELSE gc END, 6) AS confidence, CASE WHEN go <> r.object THEN r.object END AS alternative FROM fact_rows r LEFT JOIN g ON g.subject = r.subject AND g.predicate = r.predicate""",
    "trust_report": f"WITH {ROWS}, s AS (SELECT count(*) AS total_claims, count(*) FILTER (fact_seq % 3 = 1) AS verified, count(*) FILTER (fact_seq % 3 = 2) AS contested FROM fact_rows) SELECT *, total_claims - verified - contested AS llm_generated, round(CASE WHEN total_claims > 0 THEN verified / total_claims ELSE 0.0 END, 6) AS trust_ratio FROM s",
    "verbalize": f"WITH {ROWS}, {kb()} SELECT object AS place, string_agg(subject || ' ' || predicate || ' ' || object || '.', ' ' ORDER BY fact_seq) AS text, round(min(CAST(1.0 AS DOUBLE) / (fact_seq % 7 + 1)), 6) AS confidence FROM facts GROUP BY object",
    "provenance": f"WITH {MEMORY} SELECT claim_id, '[kb] ' || claim_id || ' (conf=' || format('{{:.2f}}', CAST(confidence AS DOUBLE)) || ') → [review] ' || claim_id || ' (conf=0.50)' AS chain, status IN ('verified', 'derived') AND confidence >= 0.9 AS trusted FROM memory",
    "ground_truth_store": f"WITH {STORE} SELECT 'prop_' || seq AS uuid, 'entity_' || a.pos AS subject_uuid, 'predicate_' || p.pos AS predicate_uuid, 'entity_' || b.pos AS object_uuid, subject, predicate, object, raw_text, 'verified' AS status, confidence FROM props JOIN se a ON a.k = lower(subject) JOIN se b ON b.k = lower(object) JOIN sp p ON p.k = lower(predicate)",
    "ground_truth_stats": f"WITH {STORE} SELECT 'propositions' AS table, count(*) AS rows FROM props UNION ALL SELECT 'associations', count(*) FROM props UNION ALL SELECT 'verified', count(*) FROM props UNION ALL SELECT 'entities', count(*) FROM se UNION ALL SELECT 'predicates', count(*) FROM sp",
    "ground_truth_check": f"""WITH {ROWS}, {PROPS}, {TEXTS}, c AS (SELECT text_id, text, {parsed('text', GROUND_VERBS, False)} AS t FROM texts),
ce AS (SELECT text_id, {SHA.format(c='text')} AS et, {SHA.format(c='t.subject')} AS es, {SHA.format(c='t.predicate')} AS ep, {SHA.format(c='t.object')} AS eo FROM c WHERE t IS NOT NULL),
pe AS (SELECT seq, raw_text, {SHA.format(c='raw_text')} AS ft, {SHA.format(c='subject')} AS fs, {SHA.format(c='predicate')} AS fp, {SHA.format(c='object')} AS fo FROM props),
n AS (SELECT text_id, seq, raw_text, {cosine('et', 'ft')} AS sim, {cosine('es', 'fs')} AS ss, {cosine('ep', 'fp')} AS ps, {cosine('eo', 'fo')} AS os FROM ce, pe WHERE {cosine('et', 'ft')} > CAST(0.7 AS DOUBLE)),
k AS (SELECT *, CASE WHEN ps > CAST(0.7 AS DOUBLE) AND os > CAST(0.8 AS DOUBLE) AND ss > CAST(0.8 AS DOUBLE) THEN 'verified' WHEN ps > CAST(0.7 AS DOUBLE) AND os > CAST(0.8 AS DOUBLE) AND ss < CAST(0.5 AS DOUBLE) THEN 'refuted' END AS kind FROM n),
b AS (SELECT * FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY kind = 'refuted' DESC, sim DESC, seq) = 1)
SELECT c.text_id, coalesce(kind, 'unverified') AS status, round(CASE WHEN t IS NULL THEN 0.0 WHEN kind IS NULL THEN 0.5 ELSE sim END, 6) AS confidence, raw_text AS matched FROM c LEFT JOIN b ON b.text_id = c.text_id""",
    "ground_truth_decompose": f"""WITH {STORE}, {TEXTS}, c AS (SELECT text_id, {parsed('text', GROUND_VERBS, False)} AS t FROM texts), r AS (SELECT text_id, unnest([0, 1, 2]) AS part, unnest([t.subject, t.predicate, t.object]) AS subject, unnest(['Entity', 'Predicate', 'Entity']) AS object FROM c WHERE t IS NOT NULL)
SELECT text_id, CAST(part AS INTEGER) AS part, subject, 'is_a' AS predicate, object, CASE WHEN known THEN 'verified' ELSE 'unverified' END AS status, CASE WHEN known THEN 1.0 ELSE 0.5 END AS confidence
FROM (SELECT *, CASE WHEN object = 'Entity' THEN lower(subject) IN (SELECT k FROM se) ELSE lower(subject) IN (SELECT k FROM sp) END AS known FROM r)""",
    "entity_resolve": f"""WITH a AS (SELECT DISTINCT unnest([lower(n_name), 'LAND ' || n_nationkey, 'Isle ' || n_nationkey]) AS name FROM nation),
m AS (SELECT a.name, n_nationkey FROM a, nation WHERE lower(a.name) IN (lower(n_name), 'land ' || n_nationkey) OR {cosine(SHA.format(c='a.name'), SHA.format(c='n_name'))} > 0.9)
SELECT a.name, 'entity_' || min(n_nationkey) AS uuid FROM a LEFT JOIN m USING (name) GROUP BY a.name""",
    "judge_parse": f"WITH {TEXTS}, {REPLIES}, rk AS (SELECT text_id || ':' || sample AS key, reply FROM replies), {judgement('key', 'rk')} SELECT key, verdict, confidence, reasoning FROM judged",
    "self_consistency": f"""WITH {TEXTS}, {REPLIES}, n AS (SELECT text_id, CAST(sum(CAST(contains(upper(coalesce(reply, 'ERROR')), 'TRUE') AS INTEGER)) AS BIGINT) AS t, CAST(sum(CAST(contains(upper(coalesce(reply, 'ERROR')), 'FALSE') AS INTEGER)) AS BIGINT) AS f, count(*) AS samples FROM replies GROUP BY text_id)
SELECT text_id, CASE WHEN t = samples THEN 'PASS' WHEN f = samples THEN 'FAIL' WHEN t > f THEN 'SOFT_PASS' WHEN f > t THEN 'FAIL' ELSE 'UNKNOWN' END AS verdict, round(CASE WHEN t = samples OR f = samples THEN 1.0 WHEN t > f THEN t / samples WHEN f > t THEN f / samples ELSE 0.5 END, 6) AS confidence, samples FROM n""",
    "cross_model": f"WITH {TEXTS}, {REPLIES}, n AS (SELECT text_id, avg(CAST(contains(upper(reply), 'TRUE') AS INTEGER)) AS a, count(reply) AS valid FROM replies GROUP BY text_id) SELECT text_id, CASE WHEN a >= 0.8 THEN 'PASS' WHEN a <= 0.2 THEN 'FAIL' ELSE 'UNKNOWN' END AS verdict, round(CASE WHEN a IS NULL THEN 0.0 ELSE abs(a - 0.5) * 2 END, 6) AS confidence, valid FROM n",
    "mock_judge": f"WITH {CASE_ROWS} SELECT case_id, {mock('text')} AS reply FROM cases",
    "hybrid_strategy": f"""{PROBED}, {REPLIES}, {BY_SAMPLE}, {judgement('key', 'rk')}, p AS (SELECT text_id || ':' || sample AS key, verdict, {CONFIDENCE} AS c FROM probed, (VALUES (0), (1), (2)) AS s(sample) WHERE claim_idx = 0)
SELECT p.key, CASE WHEN p.verdict IN ('PASS', 'SOFT_PASS', 'CONTRADICT') THEN p.verdict ELSE j.verdict END AS verdict, round(CASE WHEN p.verdict IN ('PASS', 'SOFT_PASS', 'CONTRADICT') THEN p.c ELSE j.confidence * 0.8 END, 6) AS confidence, CASE WHEN p.verdict IN ('PASS', 'SOFT_PASS', 'CONTRADICT') THEN 'kb' ELSE 'judge' END AS decided_by
FROM p JOIN judged j ON j.key = p.key""",
    "external_verify": f"WITH {CASE_ROWS}, {external('case_id', 'cases')} SELECT case_id, status, confidence, reason FROM ext",
    "cascade": f"""{PROBED}, {REPLIES}, {BY_SAMPLE}, {judgement('key', 'rk')}, {external('text_id', 'texts')}, l AS (SELECT text_id, text_id || ':' || sample AS key, {STATUS} AS status, {CONFIDENCE} AS confidence FROM probed, (VALUES (0), (1), (2)) AS s(sample) WHERE claim_idx = 0)
SELECT l.key, CASE WHEN l.status <> 'unverifiable' THEN l.status WHEN e.status <> 'unverifiable' THEN e.status WHEN j.verdict = 'PASS' THEN 'verified' WHEN j.verdict = 'FAIL' THEN 'refuted' ELSE 'unverifiable' END AS status,
round(CASE WHEN l.status <> 'unverifiable' THEN l.confidence WHEN e.status <> 'unverifiable' THEN e.confidence ELSE j.confidence END, 6) AS confidence, CASE WHEN l.status <> 'unverifiable' THEN 'local_kb' WHEN e.status <> 'unverifiable' THEN 'external' ELSE 'llm_judge' END AS source
FROM l JOIN ext e ON e.text_id = l.text_id JOIN judged j ON j.key = l.key""",
    "semantic_cache": f"""WITH c AS (SELECT event_id, {strip("lower(' User ' || user_id || ' ' || upper(event_type))")} AS k, CASE WHEN value > 50 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events), f AS (SELECT k, min(event_id) AS s, min_by(verdict, event_id) AS v FROM c GROUP BY k)
SELECT event_id, v AS verdict, event_id > s AS hit, round(CASE WHEN event_id > s THEN CAST(0.8 AS DOUBLE) * 0.95 ELSE 0.8 END, 6) AS confidence, CASE WHEN event_id > s THEN 0 ELSE 1 END AS external_calls FROM c JOIN f USING (k)""",
    "eval_verdicts": f"{EVALUATED} SELECT algo, case_id, verdict, passed FROM results",
    "eval_metrics": f"{EVALUATED} SELECT algo, level_of, set_key, h_type, tested, passed, round(rate, 6) AS rate, latency_ms FROM metrics",
    "coverage_score": f"""{EVALUATED}, g AS (SELECT algo, max(rate) FILTER (level_of = 'all') AS a, coalesce(sum(rate * CASE h_type {' '.join(f"WHEN '{t}' THEN {w}" for t, w in TYPE_WEIGHTS.items())} END) FILTER (level_of = 'type'), 0) AS cap, avg(rate) FILTER (level_of = 'set') AS dom,
{', '.join(f"coalesce(max(rate) FILTER (level_of = 'type' AND h_type = '{t}') >= 0.5, false) AS detects_{t}" for t in TYPE_WEIGHTS)} FROM metrics GROUP BY algo)
SELECT algo, round(a, 6) AS accuracy, round(a * 40 + cap * 40 + dom * 20, 4) AS score, CASE WHEN a >= 0.9 THEN 'EXCELLENT' WHEN a >= 0.7 THEN 'GOOD' WHEN a >= 0.5 THEN 'MODERATE' WHEN a >= 0.3 THEN 'WEAK' ELSE 'MINIMAL' END AS level, {', '.join(f'detects_{t}' for t in TYPE_WEIGHTS)} FROM g""",
    "eval_failures": f"""{EVALUATED}, f AS (SELECT *, row_number() OVER (PARTITION BY algo, h_type ORDER BY case_id) AS k FROM results WHERE NOT passed)
SELECT f.algo, f.h_type, count(*) AS failed, string_agg(text, ' | ' ORDER BY case_id) FILTER (k <= 3) AS examples, any_value(t.types) AS types FROM f JOIN (SELECT algo, string_agg(h_type, ',' ORDER BY h_type) AS types FROM (SELECT DISTINCT algo, h_type FROM f) GROUP BY algo) t ON t.algo = f.algo GROUP BY f.algo, f.h_type""",
    "eval_priorities": f"""{EVALUATED} SELECT 'HIGH' AS priority, CASE h_type WHEN 'false_attr' THEN 'Fix false attribution' ELSE 'Fix contradiction detection' END AS task, count(*) AS failures, '1-2 hours' AS time, CASE h_type WHEN 'false_attr' THEN 'Match with regard to the subject' ELSE 'Add facts: birth places, locations, capitals' END AS action FROM results WHERE NOT passed AND h_type IN ('false_attr', 'contradiction') GROUP BY h_type
UNION ALL SELECT 'MEDIUM', 'Deploy the ground-truth store', 0, '4-8 hours', 'Set up its server'""",
    "label_metrics": f"""WITH r AS (SELECT lang AS set_key, CASE WHEN quality = 1 THEN 'true_fact' ELSE 'fabrication' END AS h_type, coalesce(len(list_filter({sentence_list('text')}, lambda s: regexp_matches(s, '(?i)\\s(is|was|are|were)\\s'))) > 0, false) = (quality = 1) AS passed FROM labels JOIN documents USING (doc_id))
SELECT CASE grouping_id(set_key, h_type) WHEN 1 THEN 'set' WHEN 2 THEN 'type' ELSE 'all' END AS level_of, set_key, h_type, count(*) AS tested, CAST(sum(CAST(passed AS BIGINT)) AS BIGINT) AS passed, round(sum(CAST(passed AS BIGINT)) / count(*), 6) AS rate FROM r GROUP BY GROUPING SETS ((set_key), (h_type), ())""",
    "no_encoding": f"SELECT p_partkey, CAST(0.0 AS DOUBLE) AS encoded, {norm('p_name')} AS compared FROM part",
    "report_text": f"{PROBED}, {texted(REPORTS)}",
    "proof_gexf": f"""{PROBED}, rel AS (SELECT DISTINCT proof_rel FROM probed WHERE proof_rel IS NOT NULL) SELECT rel_id, '{GEXF}<nodes><node id="ent:' || s_norm || '" label="' || s_label || '"><attvalues><attvalue for="0" value="entity"/></attvalues></node><node id="' || rel_id || '" label="' || p_canon || '"><attvalues><attvalue for="0" value="relation"/></attvalues></node>'
|| '<node id="ent:' || o_norm || '" label="' || o_label || '"><attvalues><attvalue for="0" value="entity"/></attvalues></node></nodes><edges><edge id="0" source="ent:' || s_norm || '" target="' || rel_id || '"><attvalues><attvalue for="1" value="subj"/></attvalues></edge><edge id="1" source="' || rel_id || '" target="ent:' || o_norm || '"><attvalues><attvalue for="1" value="obj"/></attvalues></edge></edges></graph></gexf>' AS xml FROM facts JOIN rel ON rel_id = proof_rel""",
    "consensus_vote": f"""WITH {ROWS}, said AS (SELECT model, subject, predicate, CASE WHEN (fact_seq * 5 + model * 2) % 7 = 0 THEN 'nowhere' ELSE object END AS object FROM fact_rows, (VALUES (0), (1), (2)) AS m(model) WHERE (fact_seq + model) % 4 <> 0),
ag AS (SELECT subject, predicate, object FROM said GROUP BY ALL HAVING count(DISTINCT model) * 2 > 3), g AS (SELECT subject, predicate, CASE WHEN fact_seq % 3 = 1 THEN object ELSE 'elsewhere' END AS go FROM fact_rows WHERE fact_seq % 3 <> 0)
SELECT ag.subject, ag.predicate, ag.object, CASE WHEN go IS NULL THEN 'llm_generated' WHEN go = ag.object THEN 'verified' ELSE 'contested' END AS status, CAST(CASE WHEN go IS NULL THEN 0.5 WHEN go = ag.object THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence, CASE WHEN go <> ag.object THEN ag.object END AS alternative,
CASE WHEN go IS NULL THEN '[llm_consensus] 3 LLMs agreed (conf=0.50)' WHEN go = ag.object THEN '[confirmation] vote (conf=0.90)' ELSE '[llm_consensus] vote (conf=0.50)' END AS provenance FROM ag LEFT JOIN g ON g.subject = ag.subject AND g.predicate = ag.predicate""",
    "entity_resolve_in_order": f"""WITH RECURSIVE nm AS (SELECT s_suppkey * 2 AS seq, s_name AS name FROM supplier UNION ALL SELECT s_suppkey * 2 + 1, upper(s_name) FROM supplier WHERE s_suppkey % 2 = 0),
ne AS (SELECT name, {SHA.format(c="name")} AS e FROM (SELECT DISTINCT name FROM nm)), te AS (SELECT *, {SHA.format(c="n_name")} AS f, 'supplier#' || lpad(CAST(n_nationkey * 3 AS VARCHAR), 9, '0') AS alias FROM nation),
giv AS (SELECT name, min(n_nationkey) AS k FROM ne, te WHERE lower(name) IN (lower(n_name), alias) OR {cosine("e", "f")} > 0.9 GROUP BY name),
hd AS (SELECT lower(name) AS k, min(seq) AS n FROM nm WHERE name NOT IN (SELECT name FROM giv) GROUP BY lower(name)), he AS (SELECT n, {SHA.format(c="k")} AS e FROM hd),
pr AS (SELECT x.n AS a, y.n AS b FROM he x, he y WHERE x.n < y.n AND {cosine("x.e", "y.e")} > 0.9), {made_in_order("pr", "hd")},
mk AS (SELECT hd.k, coalesce(min(a) FILTER (a IN (SELECT n FROM made)), hd.n) AS maker FROM hd LEFT JOIN pr ON b = hd.n GROUP BY hd.k, hd.n)
SELECT nm.seq, nm.name, CASE WHEN giv.k IS NOT NULL THEN 'entity_' || giv.k ELSE 'entity_new_' || maker END AS uuid, giv.k IS NULL AND nm.seq = maker AS created FROM nm LEFT JOIN giv ON giv.name = nm.name LEFT JOIN mk ON mk.k = lower(nm.name)""",
    "concept_store": f"WITH {CONCEPTS} SELECT uuid, CAST(1 AS INTEGER) AS version, prototype, text, confidence FROM concepts",
    "concept_links": f"WITH {ROWS}, {PROPS} SELECT 'claim_' || seq AS uuid, t.type AS type, t.kind || '_' || seq AS to, round({CONFIDENCE_OF_SEQ}, 6) AS weight FROM props, (VALUES ('verified_by', 'verification'), ('derived_from', 'source')) AS t(type, kind)",
    "concept_history": f"""WITH {CONCEPTS} SELECT uuid, CAST(v AS INTEGER) AS version, prototype, CASE WHEN v = 2 THEN replace(text, 'verified', 'refuted') ELSE text END AS text, CASE WHEN v = 2 THEN text END AS replaced FROM concepts, (VALUES (1), (2)) AS t(v) WHERE prototype = 'Verification_result' AND seq % 3 = 0""",
    "concept_search": f"WITH {CONCEPTS}, {searched(0.7)} SELECT n_nationkey, uuid, round(similarity, 6) AS similarity, rank FROM found",
    "concept_context": f"WITH {CONCEPTS}, {searched(0.5)} SELECT n_nationkey, 'Verified facts from knowledge graph:' || chr(10) || string_agg('- ' || coalesce(subject, '?') || ' ' || coalesce(predicate, '?') || ' ' || coalesce(object, '?') || ' (similarity: ' || CAST(round_even(similarity * 100, 0) AS INTEGER) || '%)', chr(10) ORDER BY rank) AS context FROM found GROUP BY n_nationkey",
    "kb_strategy": f"{PROBED} SELECT text_id, verdict, round({CONFIDENCE}, 6) AS confidence FROM probed WHERE claim_idx = 0",
    "external_cached": f"""WITH {CASE_ROWS}, {external('case_id', 'cases')}, calls AS (SELECT case_id AS call_id, lower(text) AS k FROM cases UNION ALL SELECT case_id + 100, lower(text) FROM cases),
er AS (SELECT lower(text) AS k, case_id, status, confidence FROM ext JOIN cases USING (case_id)), pinned AS (SELECT k, min_by(status, case_id) AS status, min_by(confidence, case_id) AS confidence FROM er GROUP BY k), fk AS (SELECT k, min(call_id) AS first FROM calls GROUP BY k)
SELECT call_id, status, confidence, confidence > 0 AND (k IN (SELECT k FROM er WHERE case_id % 3 = 0 AND confidence > 0) OR call_id > first) AS hit FROM calls JOIN pinned USING (k) JOIN fk USING (k)""",
    "external_cache_after": f"WITH {CASE_ROWS}, {external('case_id', 'cases')} SELECT lower(text) AS cache_key, text AS claim, status, confidence FROM ext JOIN cases USING (case_id) WHERE confidence > 0 QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY case_id) = 1",
    "item_search": """WITH items AS (SELECT 'N' || n_nationkey AS item_id, n_name AS label, n_nationkey AS row_seq FROM nation UNION ALL SELECT 'C' || c_custkey, c_name, c_custkey + 1000 FROM customer),
f AS (SELECT lower(label) AS k, min_by(item_id, row_seq) AS item_id FROM items GROUP BY lower(label)), n AS (SELECT upper(c_name) AS name FROM customer UNION SELECT n_name || 'x' FROM nation UNION SELECT label FROM items)
SELECT name, item_id FROM n LEFT JOIN f ON k = lower(name)""",
    "item_values": """SELECT 'N' || c_nationkey AS item_id, 'inhabitant' AS property, CAST(row_number() OVER w AS INTEGER) AS rank, c_name AS value_label FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) WINDOW w AS (PARTITION BY c_nationkey ORDER BY -c_acctbal, c_custkey) QUALIFY row_number() OVER w <= 10""",
    "semantic_cache_vectors": f"""WITH RECURSIVE e AS (SELECT vec_id AS n, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT n, v, sqrt(list_dot_product(v, v)) AS m FROM e),
pr AS (SELECT x.n AS a, y.n AS b, round(list_dot_product(x.v, y.v) / (x.m * y.m), 12) AS sim FROM l x, l y WHERE x.n < y.n AND x.m * y.m > 0 AND round(list_dot_product(x.v, y.v) / (x.m * y.m), 12) >= 0.9), {made_in_order("pr", "e")},
best AS (SELECT b, a FROM pr WHERE a IN (SELECT n FROM made) QUALIFY row_number() OVER (PARTITION BY b ORDER BY sim DESC, a) = 1)
SELECT e.n AS vec_id, CASE WHEN o.label % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, best.a IS NOT NULL AS hit, o.n AS of, round(CASE WHEN best.a IS NOT NULL THEN CAST(0.8 AS DOUBLE) * 0.95 ELSE 0.8 END, 6) AS confidence, CASE WHEN best.a IS NOT NULL THEN 0 ELSE 1 END AS external_calls
FROM e LEFT JOIN best ON b = e.n JOIN e o ON o.n = coalesce(best.a, e.n)""",
    "eval_statuses": "SELECT * FROM (VALUES ('external', 'available'), ('ground_store', 'unavailable'), ('judge', 'mock_only'), ('kb_probe', 'available'), ('memory', 'available'), ('self_consistency', 'mock_only')) AS t(algo, availability)",
}
