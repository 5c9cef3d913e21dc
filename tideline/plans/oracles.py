"""DuckDB counterparts of the recall engine's queries."""

from __future__ import annotations

from ..functions.text import SPACE, STOPWORDS
from ..operators.stats import PRIME, SHARES

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _flat(c: str) -> str:
    return _trim(f"regexp_replace(coalesce({c}, ''), '{SPACE}+', ' ', 'g')")


_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def _short(c: str, n: int) -> str:
    return f"rtrim(substr({c}, 1, {n - 3})) || '...'"


def _summary(flat: str, n: int) -> str:
    at = f"(length(regexp_extract({flat}, '^[^.!?]*')) + 1)"
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} WHEN regexp_matches({flat}, '[.!?]') AND {at} > 1 AND {at} <= {n + 1} THEN substr({flat}, 1, {at}) ELSE {_short(flat, n)} END"


def _over_docs(expr: str, flat: bool = False) -> str:
    inner = f"SELECT doc_id, text, {_flat('text')} AS flat FROM documents" if flat else "SELECT doc_id, text FROM documents"
    return f"SELECT doc_id, {expr} AS value FROM ({inner})"


_RATE = "CASE category WHEN 'identity' THEN 0.002::DOUBLE WHEN 'preference' THEN 0.010::DOUBLE WHEN 'user' THEN 0.010::DOUBLE WHEN 'task' THEN 0.050::DOUBLE WHEN 'ephemeral' THEN 0.100::DOUBLE ELSE 0.030::DOUBLE END"
NOW = 1711843200


def _base(now: str = f"{NOW}::DOUBLE", name: str = "state") -> str:
    """The fold of mem and ev at a time."""
    return f"""
{name}_life AS (SELECT *, pinned_at IS NOT NULL AND (retired_at IS NULL OR pinned_at < retired_at) AS pinned FROM (
    SELECT e.id, min(CASE WHEN op = 'retire' THEN ts END) AS retired_at, min(CASE WHEN op = 'pin' THEN ts END) AS pinned_at FROM ev e JOIN mem m USING (id) WHERE ts >= created AND ts <= {now} GROUP BY e.id)),
{name}_a AS (SELECT e.id, e.ts, m.rate, row_number() OVER (PARTITION BY e.id ORDER BY e.ts, e.seq) AS k, count(*) OVER (PARTITION BY e.id) AS n
  FROM ev e JOIN mem m USING (id) LEFT JOIN {name}_life l USING (id)
  WHERE op = 'access' AND e.ts >= m.created AND e.ts <= {now} AND (l.retired_at IS NULL OR e.ts < l.retired_at)),
{name}_s AS (SELECT id, sum(pow(0.65::DOUBLE, n - k) * exp(-rate * ({now} - ts) / 86400)) AS gain, count(*) AS n_access, max(ts) AS accessed_at FROM {name}_a GROUP BY id),
{name}_1 AS (SELECT m.*, coalesce(n_access, 0) AS n_access, coalesce(accessed_at, created) AS last_access, coalesce(l.pinned, false) AS pinned, l.retired_at IS NOT NULL AS retired,
    round(CASE WHEN coalesce(l.pinned, false) THEN 1.0::DOUBLE ELSE 0.6::DOUBLE * pow(0.65::DOUBLE, coalesce(n_access, 0)) * exp(-rate * greatest(0, {now} - created) / 86400) + 0.35::DOUBLE * coalesce(gain, 0) END, 9) AS strength
  FROM mem m LEFT JOIN {name}_s USING (id) LEFT JOIN {name}_life l USING (id)),
{name} AS (SELECT *, CASE WHEN pinned OR strength > 0.5 THEN 'active' WHEN strength > 0.1 THEN 'latent' ELSE 'archived' END AS tier FROM {name}_1)"""


_DOCS = f"""SELECT 'm' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, doc_id, {_trim("coalesce(text, '')")} AS content,
    ['identity', 'preference', 'user', 'general', 'task', 'ephemeral'][doc_id % 6 + 1] AS category, (1704067200 + (doc_id % 30) * 86400)::DOUBLE AS created FROM documents"""
_EVENTS = """SELECT * FROM (SELECT event_id AS seq, 'm' || lpad(CAST((event_id * 31 + user_id) % (SELECT count(*) FROM documents) AS VARCHAR), 8, '0') AS id,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'access' WHEN event_type = 'error' AND event_id % 40 = 0 THEN 'retire' WHEN event_type = 'signup' AND event_id % 100 = 0 THEN 'pin' END AS op,
    epoch_us(ts) / 1e6::DOUBLE AS ts FROM events) WHERE op IS NOT NULL"""
_TABLES = f"""WITH RECURSIVE mem AS (SELECT *, {_RATE} AS rate FROM ({_DOCS})),
ev AS ({_EVENTS}),
qs AS (SELECT 'q' || lpad(CAST(item_id AS VARCHAR), 5, '0') AS qid, text AS query FROM benchmark),"""
MEM = f"""{_TABLES}{_base()},
live AS (SELECT * FROM state WHERE NOT retired)"""

#: The log: adds in order, each told whether its text lives in a row; a step an event of a text.
LEDGER = f"""WITH RECURSIVE docs AS ({_DOCS}), plain AS ({_EVENTS}),
e0 AS (SELECT event_id, event_type, 'm' || lpad(CAST((event_id * 31 + user_id) % (SELECT count(*) FROM documents) AS VARCHAR), 8, '0') AS target, epoch_us(ts) / 1e6::DOUBLE AS ts FROM events),
adds AS (SELECT doc_id AS seq, created AS ts, id, content, category, CAST(NULL AS VARCHAR) AS supersedes FROM docs WHERE content <> ''
  UNION ALL SELECT event_id + 1000000000, ts, 'r' || event_id, content, category, NULL FROM e0 JOIN docs ON docs.id = target WHERE event_type = 'signup' AND event_id % 20 = 5 AND content <> ''
  UNION ALL SELECT event_id + 1000000000, ts, 'u' || event_id, 'update ' || event_id, 'task', target FROM e0 WHERE event_type = 'purchase' AND event_id % 50 = 7),
cuts AS (SELECT seq + 1000000000 AS seq, ts, id AS target FROM plain WHERE op = 'retire' UNION ALL SELECT seq, ts, supersedes FROM adds WHERE supersedes IS NOT NULL),
steps AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY ts, o, seq) AS pos FROM (
  SELECT content, ts, 0 AS o, seq, id FROM adds UNION ALL SELECT a.content, c.ts, 1, c.seq, c.target FROM cuts c JOIN adds a ON a.id = c.target)),
run AS (SELECT content, 0::BIGINT AS pos, NULL::VARCHAR AS owner, false AS live, false AS made, NULL::VARCHAR AS of_, 0::BIGINT AS seq, 0::DOUBLE AS ts FROM (SELECT DISTINCT content FROM steps)
  UNION ALL SELECT s.content, s.pos, CASE WHEN o = 0 AND NOT live THEN s.id ELSE owner END, CASE WHEN o = 0 THEN true ELSE live AND s.id <> owner END, o = 0 AND NOT live,
    CASE WHEN o = 0 THEN CASE WHEN live THEN owner ELSE s.id END END, s.seq, s.ts
  FROM run r JOIN steps s ON s.content = r.content AND s.pos = r.pos + 1),
rows_ AS (SELECT a.id, a.content, a.category, a.ts AS created FROM run r JOIN adds a ON a.seq = r.seq AND a.id = r.of_ WHERE r.made),
swaps AS (SELECT a.supersedes AS id, r.of_ AS by_, a.ts, a.seq FROM adds a JOIN run r ON r.seq = a.seq AND r.content = a.content AND r.of_ IS NOT NULL WHERE a.supersedes IN (SELECT id FROM rows_)),
mem AS (SELECT *, {_RATE} AS rate FROM rows_),
ev AS (SELECT seq + 1000000000 AS seq, id, op, ts FROM plain WHERE id IN (SELECT id FROM rows_)
  UNION ALL SELECT seq, of_, 'access', ts FROM run WHERE of_ IS NOT NULL AND NOT made
  UNION ALL SELECT seq, id, 'retire', ts FROM swaps),{_base()}"""

POST = f""",
post AS (SELECT id, term, 1 AS tf FROM (SELECT id, unnest(list_distinct({_TOK.format("content")})) AS term FROM live)),
w AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM live) + 1) / (count(*) + 1)) + 1 AS w FROM post GROUP BY term),
norm AS (SELECT id, sqrt(sum(w * w)) AS dn FROM post JOIN w USING (term) GROUP BY id),
q AS (SELECT qid, term, w AS qw FROM (SELECT qid, unnest(list_distinct({_TOK.format("query")})) AS term FROM qs) JOIN w USING (term)),
qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM q GROUP BY qid),
qt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY qw DESC, term) AS rn FROM q) WHERE rn <= 48),
sims AS (SELECT qid, id, round(dot / (dn * qn), 9) AS sim FROM (SELECT qid, id, sum(w.w * qw) AS dot FROM post JOIN qt USING (term) JOIN w USING (term) GROUP BY qid, id) JOIN norm USING (id) JOIN qn USING (qid))"""

POST_TF = f""",
tpost AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOK.format("content")}) AS term FROM live) GROUP BY id, term),
tdf AS (SELECT term, count(*) AS df FROM tpost GROUP BY term),
tq AS (SELECT qid, term, count(*) AS qf FROM (SELECT qid, unnest({_TOK.format("query")}) AS term FROM qs) GROUP BY qid, term)"""
TF_SIMS = """,
tw AS (SELECT term, ln(((SELECT count(*) FROM live) + 1) / (df + 1)) + 1 AS w FROM tdf),
tnorm AS (SELECT id, sqrt(sum(tf * w * tf * w)) AS dn FROM tpost JOIN tw USING (term) GROUP BY id),
tqw AS (SELECT qid, term, qf * w AS qw, w FROM tq JOIN tw USING (term)),
tqn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM tqw GROUP BY qid),
tsims AS (SELECT qid, id, round(dot / (dn * qn), 9) AS sim FROM (SELECT qid, id, sum(tf * w * qw) AS dot FROM tpost JOIN tqw USING (term) GROUP BY qid, id) JOIN tnorm USING (id) JOIN tqn USING (qid))"""
BM25 = f""",
size AS (SELECT id, length({_TOK.format("content")}) AS dl FROM live),
bw AS (SELECT term, ln(1 + ((SELECT count(*) FROM live) - df + 0.5) / (df + 0.5)) AS w FROM tdf),
bsims AS (SELECT qid, id, round(sum(qf * w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM size)))), 9) AS sim
  FROM tpost JOIN tq USING (term) JOIN bw USING (term) JOIN size USING (id) GROUP BY qid, id),
bm AS (SELECT * FROM (SELECT b.*, content, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, last_access DESC, created DESC, id) AS rank FROM bsims b JOIN live USING (id)) WHERE rank <= 600)"""


def _top(sims: str, k: int = 10) -> str:
    return f" SELECT qid, id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM {sims}) WHERE rank <= {k}"


def _cand(prior: float) -> str:
    rows = "SELECT l.*, q.qid, coalesce(s.sim, 0) AS sim FROM live l CROSS JOIN qs q LEFT JOIN sims s ON s.qid = q.qid AND s.id = l.id"
    return f""",
blend AS (SELECT *, round(sim + {prior}::DOUBLE * strength, 9) AS v FROM ({rows})),
cand AS (SELECT * FROM (SELECT *, v + CASE WHEN pinned THEN 1e6::DOUBLE ELSE 0 END AS utility, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC, v DESC, strength DESC, id) AS rank FROM blend) WHERE rank <= 600)"""


def _bodies(source: str) -> str:
    return f""",
flat AS (SELECT *, {_flat("content")} AS flat FROM {source}),
body AS (SELECT *, length(content) AS c_full, length({_summary("flat", 160)}) AS c_summary, length({_summary("flat", 64)}) AS c_gist FROM flat)"""


#: From items(qid, pos from 1, id, costs[], kinds[]): the first cost that fits is taken; each id once.
FOLD_ROWS = """,
n AS (SELECT qid, max(pos) AS n FROM items GROUP BY qid),
run AS (SELECT qid, 0::BIGINT AS pos, 0::BIGINT AS spent, []::VARCHAR[] AS used, []::VARCHAR[] AS details FROM n
  UNION ALL SELECT r.qid, r.pos + 1,
    r.spent + CASE WHEN x.fits IS NULL OR list_contains(r.used, x.id) THEN 0 ELSE x.fits + CASE WHEN len(r.used) > 0 THEN 1 ELSE 0 END END,
    CASE WHEN x.fits IS NULL OR list_contains(r.used, x.id) THEN r.used ELSE list_append(r.used, x.id) END,
    CASE WHEN x.fits IS NULL OR list_contains(r.used, x.id) THEN r.details ELSE list_append(r.details, x.kinds[list_position(x.costs, x.fits)]) END
  FROM run r JOIN (SELECT qid, pos, id, costs, kinds FROM items) i ON i.qid = r.qid AND i.pos = r.pos + 1,
  LATERAL (SELECT i.id AS id, i.costs AS costs, i.kinds AS kinds, list_filter(i.costs, lambda c: r.spent + c + CASE WHEN len(r.used) > 0 THEN 1 ELSE 0 END <= 2200)[1] AS fits) x),
done AS (SELECT qs.qid, coalesce(d.used, []::VARCHAR[]) AS used, coalesce(d.details, []::VARCHAR[]) AS details, coalesce(d.spent, 0) AS spent FROM qs LEFT JOIN (SELECT run.* FROM run JOIN n ON n.qid = run.qid AND n.n = run.pos) d USING (qid))"""
FOLD = FOLD_ROWS + " SELECT qid, len(used)::BIGINT AS used_count, spent AS chars, array_to_string(used, ',') AS used_ids FROM done"
_COSTS = "CASE tier WHEN 'active' THEN [c_full, c_summary, c_gist] WHEN 'latent' THEN [c_summary, c_gist] ELSE [c_gist] END"
_RANK_TIER = "CASE WHEN rank <= 8 THEN 'active' WHEN rank <= 24 THEN 'latent' ELSE 'archived' END"


def _worth(utility: str = "utility", tier: str = "tier") -> str:
    return f""",
opt AS (SELECT qid, id, ord, detail, cost, round({utility} * worth / cost, 12) AS ratio FROM (
  SELECT b.*, {tier} AS t2 FROM body b) b JOIN (VALUES ('active', 0, 'full', 1.0::DOUBLE), ('active', 1, 'summary', 0.55), ('active', 2, 'gist', 0.25), ('latent', 0, 'summary', 0.55), ('latent', 1, 'gist', 0.25), ('archived', 0, 'gist', 0.25)) l(lt, ord, detail, worth) ON lt = t2,
  LATERAL (SELECT CASE detail WHEN 'full' THEN c_full WHEN 'summary' THEN c_summary ELSE c_gist END AS cost) c WHERE {utility} > 0 AND cost > 0),
items AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ratio DESC, id, ord) AS pos, id, [cost] AS costs, [detail] AS kinds FROM opt)"""


PACK_FULL = MEM + POST_TF + BM25 + _bodies("bm") + ", items AS (SELECT qid, rank AS pos, id, [c_full] AS costs, ['full'] AS kinds FROM body)" + FOLD
PACK_KNAPSACK = MEM + POST + _cand(0.0) + _bodies("cand") + _worth() + FOLD
_TRUNC_ROWS = """, items AS (SELECT qid, rank AS pos, id, flat FROM flat),
n AS (SELECT qid, max(pos) AS n FROM items GROUP BY qid),
run AS (SELECT qid, 0::BIGINT AS pos, 0::BIGINT AS spent, []::VARCHAR[] AS used, []::BIGINT[] AS rooms FROM n
  UNION ALL SELECT qid, p + 1, spent + CASE WHEN ok THEN size + gap ELSE 0 END, CASE WHEN ok THEN list_append(used, id) ELSE used END, CASE WHEN ok THEN list_append(rooms, room) ELSE rooms END FROM (
    SELECT *, room >= 40 AND size > 0 AS ok FROM (SELECT *, CASE WHEN length(flat) <= room THEN length(flat) ELSE length(rtrim(substr(flat, 1, room - 3))) + 3 END AS size FROM (
      SELECT r.qid, r.pos AS p, r.spent, r.used, r.rooms, i.id, i.flat, CASE WHEN len(r.used) > 0 THEN 1 ELSE 0 END AS gap, 2200 - r.spent - CASE WHEN len(r.used) > 0 THEN 1 ELSE 0 END AS room
      FROM run r JOIN items i ON i.qid = r.qid AND i.pos = r.pos + 1)))),
cut AS (SELECT run.* FROM run JOIN n ON n.qid = run.qid AND n.n = run.pos)"""
_TRUNC = _TRUNC_ROWS + " SELECT qs.qid, coalesce(len(used), 0)::BIGINT AS used_count, coalesce(spent, 0) AS chars, coalesce(array_to_string(used, ','), '') AS used_ids FROM qs LEFT JOIN cut USING (qid)"


def _wrapped(sql: str, name: str) -> str:
    return f"{name} AS ({sql})"


_EV = "evid AS (SELECT 'q' || lpad(CAST(item_id AS VARCHAR), 5, '0') AS qid, list('m' || lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS evidence FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1)"
RECORDS = (
    "WITH "
    + ", ".join(
        [
            _EV,
            _wrapped(PACK_FULL, "p1"),
            _wrapped(MEM + POST_TF + BM25 + " SELECT qid, list(id ORDER BY rank) AS ranked FROM bm GROUP BY qid", "r1"),
            _wrapped(PACK_KNAPSACK, "p2"),
            _wrapped(MEM + POST + _cand(0.0) + " SELECT qid, list(id ORDER BY rank) AS ranked FROM cand GROUP BY qid", "r2"),
            "rec AS (SELECT 'bm25' AS arm, p.*, ranked, evidence FROM p1 p JOIN r1 USING (qid) JOIN evid USING (qid) UNION ALL SELECT 'cosine', p.*, ranked, evidence FROM p2 p JOIN r2 USING (qid) JOIN evid USING (qid))",
            "rec2 AS (SELECT *, CASE WHEN used_ids = '' THEN []::VARCHAR[] ELSE string_split(used_ids, ',') END AS used FROM rec)",
            """met AS (SELECT arm, qid, chars, round(CASE WHEN list_has_any(used, evidence) THEN 1.0::DOUBLE ELSE 0 END, 9) AS hit,
  round(coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(evidence, lambda e: list_position(ranked, e)), lambda p: p > 0)), 0), 9) AS mrr,
  CASE WHEN len(used) > 0 THEN round(len(list_filter(used, lambda x: list_contains(evidence, x)))::DOUBLE / len(used), 9) END AS precision,
  round(coalesce(list_sum(list_transform(ranked[1:10], lambda x, i: CASE WHEN list_contains(evidence, x) THEN 1.0::DOUBLE / log2(i + 1) ELSE 0 END)), 0) / list_sum(list_transform(range(1, least(len(evidence), 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 9) AS ndcg10,
  round(coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(evidence, lambda e: list_position(used, e)), lambda p: p > 0)), 0), 9) AS mrr_packed,
  round(coalesce(list_sum(list_transform(used[1:10], lambda x, i: CASE WHEN list_contains(evidence, x) THEN 1.0::DOUBLE / log2(i + 1) ELSE 0 END)), 0) / list_sum(list_transform(range(1, least(len(evidence), 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 9) AS ndcg10_packed FROM rec2)""",
        ]
    )
)
PAIRS = ", pr AS (SELECT x.qid, x.ndcg10 AS a, y.ndcg10 AS b FROM met x JOIN met y ON x.qid = y.qid AND x.arm = 'bm25' AND y.arm = 'cosine')"

def _sketches(key: str, column: str, source: str) -> str:
    """sk(key, sketch): the eight smallest CRC-32 values of the keywords, by the checksum's table of bytes."""
    return f"""crc AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
kw AS (SELECT {key}, CASE WHEN len(k) > 0 THEN k ELSE t[1:4] END AS kw FROM (SELECT {key}, t, list_filter(t, lambda x: x NOT IN ({_STOP})) AS k FROM (SELECT {key}, {_TOK.format(column)} AS t FROM {source}))),
words AS (SELECT DISTINCT {key}, unnest(kw) AS word FROM kw),
sums AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(word, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS v FROM (SELECT DISTINCT word FROM words), crc),
sk AS (SELECT {key}, list_sort(list(DISTINCT v))[1:8] AS sketch FROM words JOIN sums USING (word) GROUP BY {key})"""


ORACLES: dict[str, str] = {
    "sketch_bottom8": "WITH " + _sketches("doc_id", "text", "documents") + " SELECT doc_id, coalesce(array_to_string(sketch, ','), '') AS value FROM documents LEFT JOIN sk USING (doc_id)",
    "sketch_candidates": MEM + ", " + _sketches("id", "content", "mem") + """, ks AS (SELECT id, unnest(sketch) AS key FROM sk), kd AS (SELECT id, key, count(*) OVER (PARTITION BY key) AS df FROM ks),
rd AS (SELECT *, coalesce(sum(df) OVER (PARTITION BY id ORDER BY df, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kd),
pp AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM rd x JOIN ks y ON x.key = y.key AND x.id <> y.id WHERE x.before < 96 GROUP BY 1, 2)
SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rn FROM pp) WHERE rn <= 64""",
    "tokens_per_doc": _over_docs(f"len({_TOK.format('text')})::BIGINT"),
    "normalized_text": _over_docs(f"array_to_string({_TOK.format('text')}, ' ')"),
    "keyword_fallback": f"SELECT doc_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE t[1:4] END, ' ') AS value FROM (SELECT doc_id, t, list_filter(t, lambda x: x NOT IN ({_STOP})) AS k FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents))",
    "summary_160": _over_docs(_summary("flat", 160), True),
    "gist_64": _over_docs(_summary("flat", 64), True),
    "content_id": _over_docs(f"'m-' || substr(sha1(array_to_string({_TOK.format('text')}, ' ')), 1, 10)"),
    "downgrade_100": _over_docs(f"CASE WHEN length(flat) <= 100 THEN flat ELSE {_short('flat', 100)} END", True),
    "jaccard_pairs": f"WITH k AS (SELECT doc_id, list_distinct({_TOK.format('text')}) AS k FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.k) + len(b.k) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.k, b.k))::DOUBLE / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) END, 9) AS jaccard FROM k a JOIN k b ON b.doc_id = a.doc_id + 1",
    "strength_decay": MEM + f" SELECT id, round(0.6::DOUBLE * exp(-rate * greatest(0, {NOW} - created) / 86400), 9) AS strength FROM mem",
    "strength_after_access": MEM + " SELECT id, n_access, strength, last_access FROM state",
    "tier_assignment": MEM + " SELECT id, tier FROM state",
    "tier_histogram": MEM + " SELECT tier, count(*) AS n, round(avg(strength), 7) AS mean_strength FROM state GROUP BY tier",
    "store_stats": MEM + " SELECT count(*) AS total, count(*) FILTER (WHERE retired) AS retired, count(*) FILTER (WHERE pinned) AS pinned, round(avg(strength), 7) AS mean_strength FROM state",
    "retired_excluded": MEM + " SELECT id FROM state WHERE retired",
    "pinned_full_strength": MEM + " SELECT id, strength, tier FROM state WHERE pinned",
    "identity_collapse": MEM + " SELECT id, copies FROM (SELECT id, row_number() OVER (PARTITION BY content ORDER BY created, id) AS rn, count(*) OVER (PARTITION BY content) - 1 AS copies FROM mem) WHERE rn = 1",
    "merge_duplicates": MEM + " SELECT max_by(id, (created, id)) AS id, CAST(sum(n_access) AS BIGINT) AS n_access, max(strength) AS strength, max(last_access) AS last_access, min(created) AS created, bool_or(pinned) AS pinned, false AS retired FROM live GROUP BY content UNION ALL SELECT id, n_access, strength, last_access, created, pinned, true FROM state WHERE retired",
    "prune_weakest": MEM + " SELECT id, strength FROM (SELECT *, row_number() OVER (ORDER BY strength, last_access DESC, id) AS rn FROM state WHERE tier = 'archived' AND NOT pinned) WHERE rn <= (SELECT count(*) - count(*) * 4 // 5 FROM state)",
    "priority_order": MEM + " SELECT id, row_number() OVER (ORDER BY retired, pinned DESC, strength DESC, last_access DESC, created DESC, id) AS rank FROM state",
    "idf": MEM + POST + " SELECT term, df, round(w, 9) AS w FROM w",
    "df_topk": MEM + f" SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct({_TOK.format('content')})) AS term FROM mem) GROUP BY term ORDER BY df DESC, term LIMIT 25",
    "cosine_top10": MEM + POST + _top("sims"),
    "cosine_tf_top10": MEM + POST_TF + TF_SIMS + " SELECT qid, id, sim, rank FROM (SELECT q.qid, l.id, coalesce(t.sim, 0) AS sim, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(t.sim, 0) DESC, last_access DESC, l.id) AS rank FROM live l CROSS JOIN qs q LEFT JOIN tsims t ON t.qid = q.qid AND t.id = l.id) WHERE rank <= 10",
    "bm25_top10": MEM + POST_TF + BM25 + _top("bsims"),
    "dense_top10": "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.id AS qid, v.id, round(list_dot_product(v.e, q.e) / (coalesce(nullif(sqrt(list_dot_product(v.e, v.e)), 0), 1) * coalesce(nullif(sqrt(list_dot_product(q.e, q.e)), 0), 1)), 6) AS sim FROM v JOIN v q ON q.id < 10 AND v.id <> q.id)" + _top("s"),
    "fifo_rank": MEM + " SELECT id, row_number() OVER (ORDER BY created, id) AS rank FROM live",
    "recency_rank": MEM + " SELECT id, row_number() OVER (ORDER BY last_access DESC, created DESC, id) AS rank FROM live",
    "blend_prior_rank": MEM + POST + _cand(0.35) + " SELECT qid, id, rank FROM cand WHERE rank <= 10",
    "query_blind_rank": MEM + " SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY pinned DESC, strength DESC, last_access DESC, created DESC, id) AS rank FROM live) WHERE rank <= 600",
    "pool_600": MEM + POST + _cand(0.0) + " SELECT qid, count(*) AS n, string_agg(id, ',' ORDER BY rank) AS ids FROM cand GROUP BY qid",
    "pack_full": PACK_FULL,
    "pack_tiered": MEM + POST + _cand(0.0) + _bodies("cand") + f", items AS (SELECT qid, rank AS pos, id, {_COSTS} AS costs, []::VARCHAR[] AS kinds FROM body)" + FOLD,
    "pack_knapsack": PACK_KNAPSACK,
    "recall_flagship": MEM + POST + _cand(0.35) + _bodies("cand") + _worth() + FOLD,
    "pack_truncate": MEM + POST_TF + BM25 + _bodies("bm") + _TRUNC,
    "truncated_text": MEM + POST_TF + BM25 + _bodies("bm") + _TRUNC_ROWS + """,
u AS (SELECT qid, unnest(used) AS id, unnest(rooms) AS room, generate_subscripts(used, 1) AS nth FROM cut),
g AS (SELECT u.qid, string_agg(CASE WHEN length(flat) <= room THEN flat ELSE rtrim(substr(flat, 1, room - 3)) || '...' END, chr(10) ORDER BY nth) AS text FROM u JOIN flat f ON f.qid = u.qid AND f.id = u.id GROUP BY u.qid)
SELECT qs.qid, coalesce(spent, 0) AS chars, coalesce(text, '') AS text FROM qs LEFT JOIN cut USING (qid) LEFT JOIN g USING (qid)""",
    "pack_ladder": MEM + POST_TF + BM25 + _bodies("bm") + f", items AS (SELECT qid, rank AS pos, id, [CASE {_RANK_TIER} WHEN 'active' THEN c_full WHEN 'latent' THEN c_summary ELSE c_gist END] AS costs, []::VARCHAR[] AS kinds FROM body)" + FOLD,
    "pack_bm25_knapsack": MEM + POST_TF + BM25 + _bodies("bm") + _worth("(1.0::DOUBLE / rank)", _RANK_TIER) + FOLD,
    "record_metrics": RECORDS + " SELECT * FROM met",
    "summary_by_arm": RECORDS + " SELECT arm, count(*)::DOUBLE AS queries, count(*)::DOUBLE AS scored_queries, round(avg(hit), 9) AS hit_rate, round(avg(mrr), 9) AS mrr, round(avg(ndcg10), 9) AS ndcg10, round(avg(mrr_packed), 9) AS mrr_packed, round(avg(ndcg10_packed), 9) AS ndcg10_packed, round(coalesce(avg(precision), 0), 9) AS evidence_precision, round(avg(chars), 9) AS mean_chars, round(avg(chars / 2200.0::DOUBLE), 9) AS budget_utilisation, CASE WHEN avg(hit) > 0 THEN round(avg(chars) / avg(hit), 6) ELSE 'inf'::DOUBLE END AS chars_per_hit FROM met GROUP BY arm",
    "align_arms": RECORDS + PAIRS + " SELECT * FROM pr",
    "wilcoxon_w": RECORDS + PAIRS + ", d AS (SELECT a - b AS d FROM pr WHERE a <> b), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d) SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0)::DOUBLE AS w_minus FROM r",
    "cliffs_delta": RECORDS + PAIRS + " SELECT round(sum(sign(x.a - y.b))::DOUBLE / count(*), 9) AS delta FROM pr x, pr y",
    "holm": "WITH p AS (SELECT event_type AS name, 1.0::DOUBLE / (1 + count(*) % 97) AS p FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM p) SELECT name, round(p, 12) AS p, round(max(least(1.0::DOUBLE, (m - i + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 12) AS adjusted FROM r",
    "stream_strength": MEM + f" SELECT id, n_access, strength FROM state WHERE id IN (SELECT id FROM ev WHERE ts <= {NOW})",
    "refresh_full": MEM + f""", lim AS (SELECT count(*) * 4 // 5 AS most FROM documents),
mrg AS (SELECT max(strength) AS strength, bool_or(pinned) AS pinned FROM live GROUP BY content UNION ALL SELECT strength, pinned FROM state WHERE retired),
c AS (SELECT CAST(sum(CASE WHEN NOT pinned AND strength * (exp(rate * greatest(0, {NOW} - greatest({NOW - 7 * 86400}::DOUBLE, last_access)) / 86400) - 1) > 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS decayed, count(*) AS total0 FROM state),
w AS (SELECT count(*) AS kept, count(*) FILTER (WHERE NOT pinned AND strength <= 0.1) AS weak FROM mrg),
p AS (SELECT decayed, total0 - kept AS merged, least(greatest(0, kept - most), weak) AS pruned, kept, most FROM c, w, lim)
SELECT decayed, merged, pruned, greatest(0, kept - pruned - most) AS prune_deficit, kept - pruned AS total FROM p""",
    "strength_as_of": _TABLES + _base(f"{NOW - 40 * 86400}::DOUBLE") + " SELECT id, n_access, strength, pinned, retired, tier FROM state",
    "ledger_state": LEDGER + " SELECT id, category, n_access, strength, retired, tier FROM state",
    "supersession": LEDGER + " SELECT id, max_by(by_, (ts, seq)) AS superseded_by FROM swaps GROUP BY id",
    "restate_after_retire": LEDGER + " SELECT id, created FROM rows_ WHERE id LIKE 'r%'",
    "days_dormant": MEM + f" SELECT id, round(greatest(0, {NOW} - last_access) / 86400, 6) AS days FROM state",
    "recall_text": MEM + POST + _cand(0.35) + _bodies("cand") + _worth() + FOLD_ROWS + f""", u AS (SELECT qid, unnest(used) AS id, unnest(details) AS detail, generate_subscripts(used, 1) AS nth FROM done),
b AS (SELECT u.qid, nth, tier, CASE detail WHEN 'full' THEN content WHEN 'summary' THEN {_summary("flat", 160)} ELSE {_summary("flat", 64)} END AS body FROM u JOIN (SELECT id, tier, content, {_flat("content")} AS flat FROM live) l USING (id)),
g AS (SELECT qid, string_agg(body, chr(10) ORDER BY nth) AS text, count(*) FILTER (WHERE tier = 'active') AS active, count(*) FILTER (WHERE tier = 'latent') AS latent, count(*) FILTER (WHERE tier = 'archived') AS archived FROM b GROUP BY qid)
SELECT done.qid, coalesce(text, '') AS text, spent AS chars, coalesce(active, 0) AS active, coalesce(latent, 0) AS latent, coalesce(archived, 0) AS archived, (SELECT count(*) FROM state WHERE retired) AS retired_excluded FROM done LEFT JOIN g USING (qid)""",
    "judge_expressions": """WITH x AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS bef FROM conversations),
y AS (SELECT *, list_distinct(regexp_extract_all(coalesce(text, ''), '\\p{Nd}+')) AS nums, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: w IN ('january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december'))) AS mons,
  array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') AS g, array_to_string(regexp_extract_all(lower(bef), '[a-z0-9]+'), ' ') AS h FROM x)
SELECT conv_id, turn, array_to_string(list_sort(nums), ',') AS numbers, len(mons)::BIGINT AS months,
  g <> '' AND (contains(h, g) OR list_has_any(nums, regexp_extract_all(h, '\\p{Nd}+')) OR list_has_any(mons, string_split(h, ' '))) AS gold,
  CASE WHEN coalesce(text, '') <> '' AND h <> '' AND g = h THEN 1.0::DOUBLE ELSE 0 END AS exact FROM y""",
    "nth_by_kind": "WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(quantile_cont(value, 0.95), 9) AS p95, max(value) FILTER (WHERE i = least(n - 1, floor(0.95::DOUBLE * n)::BIGINT)) AS nth FROM e GROUP BY event_type",
    "formatted_p": "WITH p AS (SELECT event_type AS name, 1.0::DOUBLE / (1 + count(*) % 9973) AS p FROM events GROUP BY 1) SELECT name, CASE WHEN p < 0.001 THEN 'p<0.001' ELSE 'p=' || printf('%.3f', p) END AS p, CASE WHEN 1 / p >= 1000 THEN printf('%.0f', 1 / p) ELSE printf('%.3f', 1 / p) END AS cell FROM p",
    "near_duplicates_090": MEM + f", k AS (SELECT id, list_distinct({_TOK.format('content')}) AS k FROM mem), p AS (SELECT a.id AS a, b.id AS b, CASE WHEN len(a.k) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.k, b.k))::DOUBLE / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) END AS j FROM k a JOIN k b ON a.id < b.id AND least(len(a.k), len(b.k)) >= 0.9 * greatest(len(a.k), len(b.k)) AND len(a.k) > 0) SELECT a, b, round(j, 9) AS jaccard FROM p WHERE round(j, 9) >= 0.9",
    "restatements": MEM + f""", k AS (SELECT id, strength, created, list_distinct({_TOK.format('content')}) AS k FROM live),
p AS (SELECT a.id, b.id AS match, a.strength AS s, a.created AS c, b.strength AS s2, b.created AS c2, len(list_intersect(a.k, b.k)) AS n, len(a.k) AS na, len(b.k) AS nb FROM k a JOIN k b ON a.id <> b.id AND least(len(a.k), len(b.k)) >= 0.9 * greatest(len(a.k), len(b.k)) AND len(a.k) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s2 DESC, c2, match) AS rn FROM p WHERE round(n::DOUBLE / (na + nb - n), 9) >= 0.9)
SELECT id, match, CASE WHEN n = na AND n = nb THEN 'restatement' ELSE 'update' END AS outcome,
  CASE WHEN n = na AND n = nb THEN CASE WHEN s > s2 OR (s = s2 AND c < c2) THEN id ELSE match END WHEN c >= c2 THEN id ELSE match END AS winner FROM f WHERE rn = 1""",
    "oracle_answer": MEM + f""", ln0 AS (SELECT doc_id, id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS n FROM mem),
ln1 AS (SELECT doc_id, id || '-' || lpad(CAST(n AS VARCHAR), 5, '0') AS id, {_trim("line")} AS content FROM ln0),
pr AS (SELECT 'q' || lpad(CAST(item_id AS VARCHAR), 5, '0') AS qid, d.doc_id, list_distinct({_TOK.format("b.text")}) AS k FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
jj AS (SELECT qid, id, content, list_distinct({_TOK.format("content")}) AS c, k FROM ln1 JOIN pr USING (doc_id) WHERE content <> ''),
j2 AS (SELECT qid, id, content, round(CASE WHEN len(c) + len(k) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(c, k))::DOUBLE / (len(c) + len(k) - len(list_intersect(c, k))) END, 9) AS j FROM jj)
SELECT qid, id, j FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY j DESC, length(content) DESC, id) AS rn FROM j2) WHERE rn = 1""",
}

# Wilcoxon's p over all patterns of signs, for up to 20 pairs that differ; Poisson bootstrap by the same draws.
_P_VALUE = """, diffs AS (SELECT a - b AS d FROM pr WHERE a <> b),
ranks AS (SELECT d, (2 * rank() OVER (ORDER BY abs(d)) + count(*) OVER (PARTITION BY abs(d)) - 1)::BIGINT AS r2 FROM diffs),
ranked AS (SELECT list(r2) AS r, coalesce(sum(r2) FILTER (WHERE d > 0), 0) AS w, count(*) AS m FROM ranks),
signs AS (SELECT w, coalesce(list_sum(list_transform(range(0, m), lambda i: ((s.range >> i) & 1) * r[i + 1])), 0) AS v FROM ranked, range(0, (1 << (SELECT count(*) FROM diffs))::BIGINT) s),
pv AS (SELECT round(least(1.0::DOUBLE, 2 * least(avg((v <= w)::INT), avg((v >= w)::INT))), 12) AS p FROM signs)"""
_DRAWS = f""", drawn AS (SELECT a - b AS d, ('0x' || substr(md5(qid), 1, 7))::BIGINT AS x, ('0x' || substr(md5(qid), 9, 7))::BIGINT + 1 AS y, r.range AS r FROM pr, range(1, 10001) r WHERE a IS NOT NULL AND b IS NOT NULL),
placed AS (SELECT r, d, ((x + r * y) % {PRIME})::DOUBLE / {PRIME}::DOUBLE AS u FROM drawn),
weighed AS (SELECT r, d, {" + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in SHARES)} AS w FROM placed),
means AS (SELECT r, sum(d * w) / nullif(sum(w), 0) AS m FROM weighed GROUP BY r),
ci AS (SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means)"""
ORACLES |= {
    "refresh_delta": ORACLES["refresh_full"],
    "wilcoxon_p": RECORDS + PAIRS + _P_VALUE + " SELECT 'bm25-cosine' AS name, (SELECT count(*) FROM pr) AS n, p FROM pv",
    "bootstrap_ci": RECORDS + PAIRS + _DRAWS + " SELECT low, high FROM ci",
    "paired_summary": RECORDS + PAIRS + _P_VALUE + _DRAWS + """, full_ AS (SELECT * FROM pr WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT 'bm25-cosine' AS name, count(*) AS n, round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, round(avg(a - b), 9) AS mean_diff,
  round(avg(CASE WHEN a > b THEN 1.0::DOUBLE WHEN a = b THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 9) AS win_rate, round(coalesce(stddev_samp(a - b), 0), 9) AS sd_diff,
  (SELECT low FROM ci) AS ci_low, (SELECT high FROM ci) AS ci_high, (SELECT round(sum(sign(x.a - y.b))::DOUBLE / count(*), 9) FROM full_ x, full_ y) AS delta, (SELECT p FROM pv) AS p_value FROM full_""",
}

# The order of last use with its uses carried from question to question. A row of the list to fold is an accumulator
# with one row, so that one function folds them.
_NORM = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"
ORACLES["replay_feedback"] = f"""WITH RECURSIVE c AS (SELECT conv_id::VARCHAR AS scenario, conv_id, turn, text, role || ': ' || text AS content FROM conversations),
asked AS (SELECT a.scenario, a.turn * 2 + n.range AS nth, 'c' || a.scenario || '-' || (a.turn * 2 + n.range) AS qid, a.turn - 1 AS session, array_to_string(list_slice(string_split(b.text, ' '), 1, 4), ' ') AS answer
  FROM c a, range(0, 2) n, c b WHERE a.turn > 0 AND b.scenario = a.scenario AND b.turn = CASE WHEN n.range = 0 THEN (a.turn * a.turn + a.conv_id) % a.turn ELSE (a.turn + 3 * a.conv_id) % a.turn END),
q AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY session, nth) AS k,
  (SELECT list(struct_pack(id := 't' || turn, made := turn, body := content)) FROM c WHERE c.scenario = asked.scenario AND c.turn <= asked.session) AS rows FROM asked),
run AS (
  SELECT scenario, 0::BIGINT AS k, ''::VARCHAR AS qid, []::VARCHAR[] AS used, 0::BIGINT AS chars, 0.0::DOUBLE AS score, []::STRUCT(id VARCHAR, day BIGINT)[] AS uses FROM (SELECT DISTINCT scenario FROM q)
  UNION ALL
  SELECT scenario, k, qid, p.ids, p.spent, score, CASE WHEN score >= 1 THEN list_concat(uses, list_transform(p.ids, lambda i: struct_pack(id := i, day := session))) ELSE uses END
  FROM (SELECT *, CASE WHEN contains({_NORM.format("p.body")}, {_NORM.format("answer")}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM (SELECT r.scenario, q.k, q.qid, q.session, q.answer, r.uses,
        list_reduce(list_concat([struct_pack(spent := 0::BIGINT, ids := []::VARCHAR[], body := ''::VARCHAR)], list_transform(list_sort(list_transform(q.rows, lambda x:
            struct_pack(late := -greatest(x.made, coalesce(list_max(list_transform(list_filter(r.uses, lambda u: u.id = x.id), lambda u: u.day)), -1)), young := -x.made, id := x.id, body := x.body))),
          lambda x: struct_pack(spent := length(x.body)::BIGINT, ids := [x.id], body := x.body))),
          lambda acc, x: CASE WHEN acc.spent + x.spent + (len(acc.ids) > 0)::BIGINT <= 700 THEN struct_pack(spent := acc.spent + x.spent + (len(acc.ids) > 0)::BIGINT, ids := list_concat(acc.ids, x.ids), body := CASE WHEN len(acc.ids) > 0 THEN acc.body || chr(10) || x.body ELSE x.body END) ELSE acc END) AS p
      FROM run r JOIN q ON q.scenario = r.scenario AND q.k = r.k + 1)))
SELECT qid, array_to_string(used, ',') AS used_ids, chars, score AS judge_score FROM run WHERE k > 0"""
ORACLES["dense_records"] = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, count(*) OVER () AS n FROM embeddings),
c AS (SELECT conv_id, turn, text, role || ': ' || text AS body, list_transform(e, lambda x: x / CASE WHEN list_dot_product(e, e) > 0 THEN sqrt(list_dot_product(e, e)) ELSE 1 END) AS u
  FROM conversations, v WHERE vec_id = (31 * conv_id + 7 * turn) % n),
q AS (SELECT a.conv_id, a.u, b.turn AS day, b.text AS answer FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.turn = (SELECT max(turn) FROM c x WHERE x.conv_id = a.conv_id)),
pool AS (SELECT q.conv_id, q.answer, list(struct_pack(far := -round(list_dot_product(c.u, q.u), 9), late := -c.turn, id := 't' || c.turn, body := trim(c.body, ' ' || chr(9) || chr(10) || chr(13)))
    ORDER BY -round(list_dot_product(c.u, q.u), 9), -c.turn) AS rows
  FROM q JOIN c ON c.conv_id = q.conv_id AND c.turn <= q.day GROUP BY ALL),
packed AS (SELECT conv_id, answer, list_reduce(list_concat([struct_pack(spent := 0::BIGINT, ids := []::VARCHAR[], body := ''::VARCHAR)],
    list_transform(rows, lambda x: struct_pack(spent := length(x.body)::BIGINT, ids := [x.id], body := x.body))),
  lambda acc, x: CASE WHEN acc.spent + x.spent + (len(acc.ids) > 0)::BIGINT <= 2200 THEN struct_pack(spent := acc.spent + x.spent + (len(acc.ids) > 0)::BIGINT, ids := list_concat(acc.ids, x.ids),
    body := CASE WHEN len(acc.ids) > 0 THEN acc.body || chr(10) || x.body ELSE x.body END) ELSE acc END) AS p FROM pool)
SELECT 'c' || conv_id AS qid, array_to_string(p.ids, ',') AS used_ids, p.spent AS chars,
  CASE WHEN contains({_NORM.format("p.body")}, {_NORM.format("answer")}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS judge_score FROM packed"""
