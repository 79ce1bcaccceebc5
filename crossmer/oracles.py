"""DuckDB SQL giving the same results as the registered queries.

The SQL states each operator literally (all seeds, gaps and islands, the cell
by cell alignment recurrence), while the Spark side uses the rewritten forms,
so the two check each other.
"""

from __future__ import annotations

from crossmer import constants as C

AA = C.AMINO_ACIDS
ORDER = C.MATRIX_ORDER
TAG = "THEANDTHE"

_SCORES = C.blosum62()
_LETTERS = " " + ORDER
MATRIX = "[" + ",".join(
    str(_SCORES.get(x + y, C.UNKNOWN_SCORE)) for x in _LETTERS for y in _LETTERS) + "]"
LAM, K, H = 0.253, 0.038, 0.130


def _score(x: str, y: str) -> str:
    return f"({MATRIX})[instr('{ORDER}', {x}) * 21 + instr('{ORDER}', {y}) + 1]"


def _round(x: str, digits: int) -> str:
    scale = f"{10 ** digits}::double"
    return f"(floor(({x}) * {scale} + 0.5::double) / {scale})"


def _d(value: float) -> str:
    return f"{value!r}::double"


# --- inputs --------------------------------------------------------------------------

_CLEAN = f"regexp_replace(upper(replace({{0}}, 'ß', 'SS')), '[^{AA}]', '', 'g')"
_WORDS = (
    "array_to_string(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), "
    f"lambda w: '{AA}'[('0x' || substr(md5(w), 1, 6))::int % 20 + 1]), '')"
)
LINES = """lines AS (
  SELECT doc_id, source, lang, i - 1 AS pos, 'D' || doc_id || ':' || (i - 1) AS id,
         doc_id * 268435456 + i - 1 AS ordinal, l[i] AS line
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents),
       LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"""
LETTERS = f"""{LINES}, letters AS (
  SELECT * FROM (SELECT id, ordinal, doc_id, pos, {_CLEAN.format('line')} AS sequence FROM lines)
  WHERE length(sequence) >= 8)"""
WORDS = f"""{LINES}, words AS (
  SELECT * FROM (SELECT id, ordinal, doc_id, pos, {_WORDS.format('line')} AS sequence FROM lines)
  WHERE length(sequence) >= 8)"""
MESSAGES = f"""messages AS (
  SELECT * FROM (SELECT 'C' || conv_id || ':' || turn AS id, conv_id * 268435456 + turn AS ordinal,
    conv_id, {_WORDS.format("replace(text, chr(10), ' ')")} AS sequence FROM conversations)
  WHERE length(sequence) >= 8)"""
ITEMS = f"""items AS (
  SELECT * FROM (SELECT 'B' || item_id AS id, item_id AS ordinal,
    {_CLEAN.format('text')} AS sequence FROM benchmark) WHERE length(sequence) >= 8)"""


def _nodes(source: str) -> str:
    return f"""nodes AS (
  SELECT sequence AS s, min(ordinal) AS node, max(ordinal) AS last, min_by(id, ordinal) AS id,
         count(*) AS copies, length(sequence) AS len FROM {source} GROUP BY sequence)"""


def _neighbours(source: str) -> str:
    return f"""neighbours AS (
  SELECT id, next_id, a, b FROM (
    SELECT id, sequence AS a, lead(id) OVER w AS next_id, lead(sequence) OVER w AS b
    FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE next_id IS NOT NULL)"""


def _kmers(text: str, k: int, node: str = "node", source: str = "nodes") -> str:
    return f"""(SELECT *, substr({text}, pos + 1, {k}) AS kmer FROM (
    SELECT *, unnest(range(0, length({text}) - {k - 1})) AS pos FROM {source}))"""


_FROM = "".join("".join(v) for v in C.REDUCED_GROUPS.values())
_TO = "".join(g * len(v) for g, v in C.REDUCED_GROUPS.items())


def _reduce(x: str) -> str:
    return f"translate({x}, '{_FROM}', '{_TO}')"


def _align(pairs: str) -> str:
    """CTEs computing aligned(pid, raw_score, target_end) of a pairs(pid, q, t) relation.

    One recursion step per query residue; columns are target positions.
    """
    return f"""
cols AS (SELECT pid, q, length(q) AS m, j::int AS j, instr('{ORDER}', t[j])::int AS tc
         FROM (SELECT *, unnest(range(1, length(t) + 1)) AS j FROM {pairs})),
dp AS (
  SELECT pid, q, m, j, tc, 0 AS i, 0 AS h, -1000000 AS f FROM cols
  UNION ALL
  SELECT pid, q, m, j, tc, i + 1, greatest(h0, coalesce(max(h0 + j) OVER (
      PARTITION BY pid ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      -1000000) - 10 - (j - 1))::int, f2
  FROM (SELECT *, greatest(0, hd + ({MATRIX})[instr('{ORDER}', q[i + 1]) * 21 + tc + 1], f2)::int AS h0
        FROM (SELECT *, greatest(f - 1, h - 10) AS f2,
                     lag(h, 1, 0) OVER (PARTITION BY pid ORDER BY j) AS hd FROM dp WHERE i < m))),
aligned AS (
  SELECT pid, max(h) AS raw_score,
         CASE WHEN max(h) = 0 THEN 0 ELSE (min(i * 100000 + j) FILTER (h = best)) % 100000 END AS target_end
  FROM (SELECT *, max(h) OVER (PARTITION BY pid) AS best FROM dp) GROUP BY pid)"""


def _eff(length: str, other: str, k: str = None, h: str = None) -> str:
    k, h = k or _d(K), h or _d(H)
    return (f"greatest(trunc(({length}) - ln({k} * ({length}) * ({other})) / {h})::bigint, 1)")


def _evalue(raw: str, m: str, db: str, batch: bool = False) -> str:
    worst = f"{_eff(m, db)} * {_eff(db, m)}" if batch else f"({db}) * ({m})"
    return (f"CASE WHEN {raw} > 0 THEN {_d(K)} * {_eff(m, db)} * {_eff(db, m)} * "
            f"exp({_d(-LAM)} * {raw}) ELSE ({worst})::double END")


def _bits(raw: str) -> str:
    return (f"CASE WHEN {raw} > 0 THEN ({_d(LAM)} * {raw} - ln({_d(K)})) / ln(2::double) "
            "ELSE 0::double END")


def _tier(e: str) -> str:
    cases = " ".join(f"WHEN {e} < {b!r}::double THEN '{label}'" for b, label in C.SIGNIFICANCE_TIERS)
    return f"CASE {cases} ELSE '{C.SIGNIFICANCE_NONE}' END"


# --- physicochemistry ------------------------------------------------------------------

def _values(x: str, scale: dict[str, int]) -> str:
    table = "[0," + ",".join(str(scale.get(r, 0)) for r in ORDER) + "]"
    return f"list_transform(string_split({x}, ''), lambda r: ({table})[instr('{ORDER}', r) + 1])"


def _window(values: str) -> str:
    return (f"list_transform(range(1, len({values}) - 3), "
            f"lambda i: list_sum(({values})[i:i + 4])::int)")


BINARY = dict.fromkeys(C.HYDROPHOBIC, 1)


def _charge(seq: str, ph: str) -> str:
    n = lambda r: f"(length({seq}) - length(replace({seq}, '{r}', '')))"
    terms = [f"1::double / (1::double + pow(10::double, {ph} - 8.0::double))",
             f"- 1::double / (1::double + pow(10::double, 3.1::double - {ph}))"]
    terms += [f"+ {n(r)} * (1::double / (1::double + pow(10::double, {ph} - {p!r}::double)))"
              for r, p in C.PKA_POSITIVE.items()]
    terms += [f"- {n(r)} * (1::double / (1::double + pow(10::double, {p!r}::double - {ph})))"
              for r, p in C.PKA_NEGATIVE.items()]
    return " ".join(terms)


def _pi(source: str) -> str:
    """CTE pis(s, pi) of a relation with column s."""
    return f"""
bisect AS (
  SELECT DISTINCT s, 0 AS step, 0::double AS lo, 14::double AS hi FROM {source}
  UNION ALL
  SELECT s, step + 1, CASE WHEN c > 0 THEN mid ELSE lo END, CASE WHEN c > 0 THEN hi ELSE mid END
  FROM (SELECT *, {_charge('s', 'mid')} AS c
        FROM (SELECT *, (lo + hi) / 2::double AS mid FROM bisect WHERE step < 50))),
pis AS (SELECT s, (lo + hi) / 2::double AS pi FROM bisect WHERE step = 50)"""


def _pearson(n: str, sx: str, sxx: str, sy: str, syy: str, sxy: str) -> str:
    vx, vy = f"({n} * {sxx} - {sx} * {sx})", f"({n} * {syy} - {sy} * {sy})"
    return (f"CASE WHEN {n} < 2 OR {vx} <= 0 OR {vy} <= 0 THEN 0::double ELSE "
            f"({n} * {sxy} - {sx} * {sy})::double / (sqrt({vx}::double) * sqrt({vy}::double)) END")


def _metrics(pairs: str) -> str:
    """CTE metrics(pid, hc, cc, hx, cx, bx, dpi) of pairs(pid, q, t); pis must exist."""
    scales = {"h": C.HYDROPATHY_X10, "c": C.CHARGE_X10, "b": BINARY}
    raw = ", ".join(f"{_values(x, v)} AS {x}{n}" for n, v in scales.items() for x in "qt")
    profile = ", ".join(
        f"{_window(x + n)} AS p{x}{n}" for n in "hc" for x in "qt") + ", qb AS pqb, tb AS ptb"
    direct = "".join(f"""
direct_{n} AS (SELECT pid, {_pearson('n', 'sx', 'sxx', 'sy', 'syy', 'sxy')} AS r FROM (
  SELECT pid, count(*) AS n, sum(x)::bigint AS sx, sum(y)::bigint AS sy, sum(x * x)::bigint AS sxx,
         sum(y * y)::bigint AS syy, sum(x * y)::bigint AS sxy
  FROM (SELECT pid, unnest(q{n}[1:least(len(q{n}), len(t{n}))]) AS x,
               unnest(t{n}[1:least(len(q{n}), len(t{n}))]) AS y FROM raws) GROUP BY pid)),""" for n in "hc")
    cross = "".join(f"""
slide_{n} AS (
  SELECT pid, len(y) AS n, o, x[o:o + len(y) - 1] AS x, y FROM (
    SELECT pid, x, y, unnest(range(1, len(x) - len(y) + 2)) AS o FROM (
      SELECT pid, CASE WHEN len(pt{n}) > len(pq{n}) THEN pt{n} ELSE pq{n} END AS x,
             CASE WHEN len(pt{n}) > len(pq{n}) THEN pq{n} ELSE pt{n} END AS y FROM profiles) WHERE len(y) > 0)),
cross_{n} AS (SELECT pid, greatest(max({_pearson('n', 'sx', 'sxx', 'sy', 'syy', 'sxy')}), -1::double) AS r FROM (
  SELECT pid, n, list_sum(x)::bigint AS sx, list_sum(y)::bigint AS sy, list_dot_product(x::double[], x::double[])::bigint AS sxx,
         list_dot_product(y::double[], y::double[])::bigint AS syy, list_dot_product(x::double[], y::double[])::bigint AS sxy
  FROM slide_{n}) GROUP BY pid),""" for n in "hcb")
    return f"""
raws AS (SELECT pid, q, t, {raw} FROM {pairs}),
profiles AS (SELECT pid, {profile} FROM raws),{direct}{cross}
metrics AS (
  SELECT p.pid, coalesce(dh.r, 0::double) AS hc, coalesce(dc.r, 0::double) AS cc,
    coalesce(xh.r, 0::double) AS hx, coalesce(xc.r, 0::double) AS cx, coalesce(xb.r, 0::double) AS bx,
    abs(a.pi - b.pi) AS dpi
  FROM {pairs} p JOIN pis a ON a.s = p.q JOIN pis b ON b.s = p.t
  LEFT JOIN direct_h dh USING (pid) LEFT JOIN direct_c dc USING (pid)
  LEFT JOIN cross_h xh USING (pid) LEFT JOIN cross_c xc USING (pid) LEFT JOIN cross_b xb USING (pid)),
composed AS (SELECT *, 0.4::double * greatest(bx, 0::double) + 0.2::double * greatest(hx, 0::double)
  + 0.2::double * greatest(cx, 0::double) + 0.1::double * greatest(1::double - dpi / 7::double, 0::double)
  + 0.1::double * greatest((hc + cc) / 2::double, 0::double) AS pc FROM metrics)"""


METRIC_COLUMNS = f"""{_round('hc', 4)} AS hydrophobicity_corr, {_round('cc', 4)} AS charge_corr,
  {_round('dpi', 3)} AS pi_diff, {_round('hx', 4)} AS hydrophobicity_cross_corr,
  {_round('cx', 4)} AS charge_cross_corr, {_round('bx', 4)} AS binary_hydro_cross_corr,
  {_round('pc', 4)} AS pc_composite_score"""


def _source(hit: str) -> str:
    return (f"CASE WHEN {hit} AND pc >= 0.55::double THEN 'both' WHEN pc >= 0.55::double "
            "THEN 'physicochemical' ELSE 'sequence' END")


# --- candidates ---------------------------------------------------------------------------

def _seeds(k: int, text: str) -> str:
    """CTE seeds(q, t, qp, tp): every common k-mer position of directed node pairs."""
    return f"""
posts AS (SELECT node, pos, kmer FROM {_kmers('x', k, source=f'(SELECT node, {text} AS x FROM nodes)')}),
seeds AS (SELECT a.node AS q, b.node AS t, a.pos AS qp, b.pos AS tp
          FROM posts a JOIN posts b ON a.kmer = b.kmer AND a.node <> b.node)"""


ISLANDS = """
islands AS (SELECT q, t, d, min(qp) AS start, count(*) AS chain FROM (
    SELECT q, t, qp - tp AS d, qp, qp - row_number() OVER (PARTITION BY q, t, qp - tp ORDER BY qp) AS g
    FROM seeds) GROUP BY q, t, d, g)"""


def _jaccard(threshold: str = "0.04::double") -> str:
    return f"""
sets AS (SELECT DISTINCT node, kmer FROM {_kmers('s', 6)}),
sizes AS (SELECT node, count(*) AS n FROM sets GROUP BY node),
jac AS (SELECT q, t, shared::double / (a.n + b.n - shared) AS jaccard FROM (
    SELECT a.node AS q, b.node AS t, count(*) AS shared FROM sets a JOIN sets b
    ON a.kmer = b.kmer AND a.node <> b.node GROUP BY 1, 2)
  JOIN sizes a ON a.node = q JOIN sizes b ON b.node = t
  WHERE shared::double / (a.n + b.n - shared) >= {threshold})"""


CHAIN = f"""{_seeds(4, 's')},{ISLANDS},
chain AS (SELECT q, t FROM islands GROUP BY q, t HAVING max(chain) >= 3)"""

def _details(queries: str) -> str:
    """CTEs details, passing of the diagonal filter; seeds must exist."""
    return f"""{ISLANDS},
diag AS (SELECT q, t, d, max(chain) AS chain, min(start) AS first_q,
                arg_min(start, -chain * 1000000 + start) AS start FROM islands GROUP BY q, t, d),
best AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY q, t ORDER BY chain DESC, first_q, first_q - d) AS rk FROM diag) WHERE rk = 1),
regions AS (SELECT q, t, chain, d, start, chain + 4 AS len,
    substr(a.s, start + 1, chain + 4) AS qs, substr(b.s, start - d + 1, chain + 4) AS ts,
    a.id AS query_id, b.id AS target_id
  FROM best JOIN {queries} a ON a.node = q JOIN nodes b ON b.node = t),
details AS (SELECT *, list_sum(list_transform(range(1, len + 1),
    lambda i: {_score('qs[i]', 'ts[i]')}))::double / len AS mean FROM regions),
passing AS (SELECT * FROM details WHERE chain >= 2 OR mean >= 3)"""


_DETAILS = f"{_seeds(5, _reduce('s'))},{_details('nodes')}"


_WORD_NODES = f"{WORDS}, {_nodes('words')}"

# benchmark items as queries against the document lines
_SEARCHED = f"""{_WORD_NODES}, probes AS (SELECT item_id AS node, {_WORDS.format("replace(text, chr(10), ' ')")} AS s FROM benchmark),
tsets AS (SELECT DISTINCT node, kmer FROM {_kmers('s', 6)}),
qsets AS (SELECT DISTINCT node, kmer FROM {_kmers('s', 6, source='probes')}),
jac AS (SELECT q, t, shared::double / (a.n + b.n - shared) AS jaccard FROM (
    SELECT a.node AS q, b.node AS t, count(*) AS shared FROM qsets a JOIN tsets b ON a.kmer = b.kmer GROUP BY 1, 2)
  JOIN (SELECT node, count(*) AS n FROM qsets GROUP BY node) a ON a.node = q
  JOIN (SELECT node, count(*) AS n FROM tsets GROUP BY node) b ON b.node = t
  WHERE shared::double / (a.n + b.n - shared) >= 0.04::double),
seeds AS (SELECT a.node AS q, b.node AS t, a.pos AS qp, b.pos AS tp
  FROM {_kmers('s', 4, source='probes')} a JOIN {_kmers('s', 4)} b ON a.kmer = b.kmer),{ISLANDS},
chain AS (SELECT q, t FROM islands GROUP BY q, t HAVING max(chain) >= 3)"""


# benchmark items, one node each, against the document lines by the diagonal filter
_SEARCHED_DIAGONALS = f"""{_WORD_NODES}, probe_words AS (
  SELECT item_id AS ordinal, item_id AS id, {_WORDS.format("replace(text, chr(10), ' ')")} AS sequence FROM benchmark),
probes AS (SELECT sequence AS s, min(ordinal) AS node, min_by(id, ordinal) AS id, length(sequence) AS len FROM probe_words GROUP BY sequence),
seeds AS (SELECT a.node AS q, b.node AS t, a.pos AS qp, b.pos AS tp
  FROM {_kmers('x', 5, source=f"(SELECT node, {_reduce('s')} AS x FROM probes)")} a
  JOIN {_kmers('x', 5, source=f"(SELECT node, {_reduce('s')} AS x FROM nodes)")} b ON a.kmer = b.kmer),{_details('probes')}"""


def _items(relation: str, scored: bool) -> str:
    score = (f", {_round('jaccard', 6)} AS jaccard, row_number() OVER (PARTITION BY q ORDER BY jaccard DESC, t) AS rank"
             if scored else "")
    return f"""SELECT q AS item_id, b.id AS target_id, b.copies AS target_copies{score} FROM {relation} JOIN nodes b ON b.node = t"""


def _ids(relation: str, columns: str = "") -> str:
    return f"""SELECT a.id AS query_id, b.id AS target_id,
  a.copies AS query_copies, b.copies AS target_copies{columns} FROM {relation}
JOIN nodes a ON a.node = q JOIN nodes b ON b.node = t"""


_RANK = ", row_number() OVER (PARTITION BY q ORDER BY jaccard DESC, t) AS rank"
_PRECEDES = "(a.len > b.len OR (a.len = b.len AND a.node < b.last))"
_SELF = "SELECT node AS q, node AS t FROM nodes WHERE copies > 1"
_DB = "(SELECT sum(len * copies) FROM nodes)"


def _screen(source: str, batch: bool, candidates: str, order: str) -> str:
    """CTE hits of a screen; ``candidates`` are directed (q, t) node pairs."""
    run = """
common AS (SELECT pid, min(start) AS start, d, count(*) AS run FROM (
    SELECT pid, d, i AS start, i - row_number() OVER (PARTITION BY pid, d ORDER BY i) AS g FROM (
      SELECT pid, i, i - j AS d FROM (SELECT pid, q, t, unnest(range(1, length(q) + 1)) AS i FROM pairs),
      LATERAL (SELECT unnest(list_filter(range(1, length(t) + 1), lambda j: t[j] = q[i])) AS j)))
  GROUP BY pid, d, g HAVING count(*) >= 6),
runs AS (SELECT * FROM (SELECT pid, run, start + run - 2 AS qe, start - d + run - 2 AS te, row_number() OVER (
    PARTITION BY pid ORDER BY run DESC, start + run, start - d + run) AS rk FROM common) WHERE rk = 1)"""
    e = _evalue("raw_score", "a.len", _DB, batch)
    keep = "evalue <= 0.01::double OR run IS NOT NULL" if batch else "evalue <= 0.01::double AND target_end >= 8"
    aligned = "least(a.len, b.len)" if batch else "target_end"
    return f"""WITH RECURSIVE {source},{candidates},
pairs AS (SELECT row_number() OVER () AS pid, q AS qn, t AS tn, a.s AS q, b.s AS t FROM cand
  JOIN nodes a ON a.node = q JOIN nodes b ON b.node = t WHERE {order}),{_align('pairs')},{run},
hits AS (SELECT * FROM (
  SELECT pid, p.q, p.t, a.id AS query_id, b.id AS target_id, a.copies AS q_copies, b.copies AS t_copies,
    raw_score, {e} AS evalue, a.len AS query_length, b.len AS target_length, target_end, run, qe, te,
    {aligned} AS aligned_region_len
  FROM pairs p JOIN aligned USING (pid) JOIN nodes a ON a.node = qn JOIN nodes b ON b.node = tn
  LEFT JOIN runs USING (pid)) WHERE {keep}),
ends AS (SELECT q AS s FROM hits UNION SELECT t FROM hits),{_pi('ends')},{_metrics('hits')},
stored AS (SELECT q_copies, t_copies, query_id, target_id, raw_score,
  {_round(_bits('raw_score'), 1)} AS bit_score, evalue, {_round('log10(evalue)', 6)} AS log_evalue,
  query_length, target_length, aligned_region_len,
  {'coalesce(run, 0)' if batch else '0'} AS consec_match_len,
  {'coalesce(qe - run + 1, -1)' if batch else '-1'} AS consec_query_start,
  {'coalesce(qe, -1)' if batch else '-1'} AS consec_query_end,
  {'coalesce(te - run + 1, -1)' if batch else '-1'} AS consec_target_start,
  {'coalesce(te, -1)' if batch else '-1'} AS consec_target_end,
  {METRIC_COLUMNS}, {_source('evalue <= 0.01::double')} AS detection_source
FROM hits JOIN composed USING (pid))"""


_ITEM_NODES = f"{ITEMS}, {_nodes('items')}"
_KMER_ITEMS = _screen(
    _ITEM_NODES, False, f"{CHAIN}, cand AS (SELECT q, t FROM chain UNION ALL {_SELF})", "true")
_SCREEN_OUT = "SELECT * EXCLUDE (evalue) FROM stored"

_REDUCED_CAND = f"""{_DETAILS},
cand AS (SELECT q, t FROM passing UNION ALL {_SELF} AND len > 5)"""
_ALL_CAND = f"cand AS (SELECT a.node AS q, b.node AS t FROM nodes a JOIN nodes b ON a.node <> b.node UNION ALL {_SELF})"

_UNGAPPED = f"""{LETTERS}, {_neighbours('letters')},
raw AS (SELECT id, next_id, length(a) AS len, coalesce(list_sum(list_transform(
  range(1, least(length(a), length(b)) + 1), lambda i: {_score('a[i]', 'b[i]')})), 0)::int AS raw_score FROM neighbours),
ev AS (SELECT *, {_evalue('raw_score', 'len', 'db')} AS pairwise, {_evalue('raw_score', 'len', 'db', True)} AS batch
  FROM raw, (SELECT sum(length(sequence)) AS db FROM letters))"""

_WORD_PAIRS = f"""{WORDS}, {_neighbours('words')},
pairs AS (SELECT id || '/' || next_id AS pid, id, next_id, a AS q, b AS t FROM neighbours)"""
_MESSAGE_NODES = f"{MESSAGES}, {_nodes('messages')}"

_SOURCES = f"""{LINES}, recs AS (SELECT ordinal AS row_num, source AS id, {_CLEAN.format('line')} AS sequence FROM lines),
ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_num) > 1 AS renamed FROM recs WHERE length(sequence) >= 8)"""

_TAG_PAIRS = f"""{LETTERS}, pairs AS (SELECT id AS pid, sequence, '{TAG}' AS q, sequence[1:60] AS t FROM letters)"""
_TAGGED = f"""tagged AS (SELECT id, instr(sequence, '{TAG}') AS place, sequence, raw_score, target_end,
  raw_score >= 20 AS good FROM letters JOIN aligned ON pid = id)"""
_STRIPPED = f"""stripped AS (SELECT id,
  CASE WHEN place > 0 THEN substr(sequence, place + {len(TAG)}) WHEN good THEN substr(sequence, target_end + 1) ELSE sequence END AS stripped,
  place > 0 OR good AS tag_found, CASE WHEN place > 0 THEN 'exact' WHEN good THEN 'sw' ELSE 'none' END AS method_used,
  CASE WHEN place > 0 THEN NULL ELSE raw_score END AS score FROM tagged)"""

# all messages, copies included, and every pair of them
_FAMILY = f"""{_MESSAGE_NODES},{_DETAILS},
members AS (SELECT n.node, m.id, 'C' || m.conv_id AS family FROM messages m JOIN nodes n ON n.s = m.sequence),
node_pairs AS (SELECT DISTINCT least(q, t) AS p, greatest(q, t) AS r FROM passing),
found AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM node_pairs
            JOIN members x ON x.node = p JOIN members y ON y.node = r
          UNION ALL SELECT x.id, y.id FROM members x JOIN members y ON x.node = y.node AND x.id < y.id),
truth AS (SELECT x.id AS a, y.id AS b, x.family FROM members x JOIN members y ON x.family = y.family AND x.id < y.id)"""


def _profile(scale: dict[str, int], window: bool) -> str:
    out = _window("x") if window else "x"
    return (f"WITH {LETTERS}, v AS (SELECT id, {_values('sequence', scale)} AS x FROM letters) "
            f"SELECT id, array_to_string({out}, ',') AS profile FROM v")


def _family_numbers() -> str:
    return f"""WITH {_FAMILY}, n AS (SELECT
  (SELECT count(*) * (count(*) - 1) // 2 FROM members)::bigint AS total_pairs, (SELECT count(*) FROM truth) AS expected_pairs,
  (SELECT count(*) FROM found) AS passing_pairs,
  (SELECT count(*) FROM (SELECT a, b FROM found INTERSECT SELECT a, b FROM truth)) AS true_positives,
  (SELECT count(*) FROM (SELECT a, b FROM truth EXCEPT SELECT a, b FROM found)) AS false_negatives,
  (SELECT count(*) FROM (SELECT a, b FROM found EXCEPT SELECT a, b FROM truth)) AS background_passing)
SELECT *, total_pairs - expected_pairs - background_passing AS background_rejected,
  {_round("CASE WHEN total_pairs > expected_pairs THEN (total_pairs - expected_pairs - background_passing)::double / (total_pairs - expected_pairs) * 100 ELSE 0 END", 4)} AS filter_rate,
  {_round("CASE WHEN expected_pairs > 0 THEN true_positives::double / expected_pairs * 100 ELSE 0 END", 4)} AS sensitivity
FROM n"""


_PASSES = f"""WITH {_FAMILY},
counts AS (SELECT m.id, (coalesce(c.k, 0) + n.copies - 1)::bigint AS passes FROM members m JOIN nodes n ON n.node = m.node
  LEFT JOIN (SELECT p.q, count(*) AS k FROM passing p JOIN members y ON y.node = p.t GROUP BY 1) c ON c.q = m.node)"""


def oracle_queries() -> dict[str, str]:
    edges = (0, 5, 10, 20, 50, 100, 200, 500)
    bins = " ".join(f"WHEN passes >= {e} THEN {e}" for e in reversed(edges))
    ka = " UNION ALL ".join(
        f"SELECT {e} AS existence, {x} AS extension, {_d(l)} AS lam, {_d(k)} AS k, {_d(h)} AS h"
        for (e, x), (l, k, h) in C.KARLIN_ALTSCHUL.items())
    sqls = {
        "clean_sequence": f"WITH {LINES} SELECT id, {_CLEAN.format('line')} AS sequence FROM lines",
        "valid_sequences": f"WITH {LETTERS} SELECT id, length(sequence) AS length FROM letters",
        "clean_load": f"""WITH {_SOURCES} SELECT row_num, CASE WHEN renamed THEN id || '_' || row_num ELSE id END AS id,
            sequence, renamed FROM ok""",
        "fasta_load_ids": f"""WITH {_SOURCES} SELECT row_num, CASE WHEN renamed THEN id || '_dup' ||
            (sum(renamed::int) OVER (ORDER BY row_num))::bigint ELSE id END AS id FROM ok""",
        "load_stats": f"""WITH {_SOURCES} SELECT (SELECT count(*) FROM ok) AS loaded,
            (SELECT count(*) FROM recs WHERE length(sequence) < 8) AS skipped,
            (SELECT count(*) FROM ok WHERE renamed) AS renamed""",
        "strip_tag_exact": f"""WITH {LETTERS} SELECT id, CASE WHEN instr(sequence, '{TAG}') > 0 THEN
            substr(sequence, instr(sequence, '{TAG}') + {len(TAG)}) ELSE sequence END AS stripped,
            instr(sequence, '{TAG}') > 0 AS tag_found FROM letters""",
        "strip_tag_sw": f"""WITH RECURSIVE {_TAG_PAIRS},{_align('pairs')}, {_TAGGED}
            SELECT id, CASE WHEN good THEN substr(sequence, target_end + 1) ELSE sequence END AS stripped,
            good AS tag_found, raw_score AS score FROM tagged""",
        "strip_tag": f"""WITH RECURSIVE {_TAG_PAIRS},{_align('pairs')}, {_TAGGED}, {_STRIPPED} SELECT * FROM stripped""",
        "tag_stats": f"""WITH RECURSIVE {_TAG_PAIRS},{_align('pairs')}, {_TAGGED}, {_STRIPPED}
            SELECT method_used, count(*) AS antigens, count(*) FILTER (tag_found) AS found FROM stripped GROUP BY 1""",
        "blosum_lookup": f"""WITH {LETTERS} SELECT pair, n, {_score('pair[1]', 'pair[2]')} AS score FROM (
            SELECT kmer AS pair, count(*) AS n FROM {_kmers('sequence', 2, source='(SELECT id, sequence FROM letters)')} GROUP BY 1)""",
        "encode_sequence": f"""WITH {LETTERS} SELECT id, array_to_string(list_transform(string_split(sequence, ''),
            lambda r: instr('{ORDER}', r) - 1), ',') AS codes FROM letters""",
        "reduce_sequence": f"WITH {LETTERS} SELECT id, {_reduce('sequence')} AS reduced FROM letters",
        "kmer_sets": f"""WITH {WORDS}, k AS (SELECT id, list_distinct(list_transform(range(1, length(sequence) - 4),
            lambda i: sequence[i:i + 5])) AS ks FROM words)
            SELECT id, len(ks) AS n_kmers, array_to_string(list_sort(ks), ',') AS kmers FROM k""",
        "kmer_positions": f"WITH {WORDS} SELECT id, pos, kmer FROM {_kmers('sequence', 4, source='(SELECT id, sequence FROM words)')}",
        "reduced_kmers": f"""WITH {WORDS} SELECT id, pos, kmer FROM
            {_kmers('x', 5, source=f"(SELECT id, {_reduce('sequence')} AS x FROM words)")}""",
        "jaccard_pair": f"""WITH {LETTERS}, {_neighbours('letters')}, k AS (SELECT id, next_id,
            list_distinct(list_transform(range(1, length(a) - 4), lambda i: a[i:i + 5])) AS x,
            list_distinct(list_transform(range(1, length(b) - 4), lambda i: b[i:i + 5])) AS y FROM neighbours)
            SELECT id, next_id, {_round("len(list_intersect(x, y))::double / len(list_distinct(x || y))", 6)} AS jaccard FROM k""",
        "ka_params": f"""WITH {LETTERS}, ka AS ({ka}) SELECT length, antigens, existence, extension, lam, k, h,
            {_eff('length', 'db', 'k', 'h')} AS m_eff FROM
            (SELECT length(sequence) AS length, count(*) AS antigens FROM letters GROUP BY 1), ka,
            (SELECT sum(length(sequence)) AS db FROM letters)""",
        "effective_length": f"""WITH {LETTERS} SELECT length, antigens, {_eff('length', 'db')} AS m_eff,
            {_eff('db', 'length')} AS d_eff FROM
            (SELECT length(sequence) AS length, count(*) AS antigens FROM letters GROUP BY 1),
            (SELECT sum(length(sequence)) AS db FROM letters)""",
        "bit_score": f"WITH {_UNGAPPED} SELECT id, next_id, raw_score, {_round(_bits('raw_score'), 1)} AS bit_score FROM ev",
        "evalue": f"""WITH {_UNGAPPED} SELECT id, next_id, {_round('log10(pairwise)', 6)} AS log_pairwise,
            {_round('log10(batch)', 6)} AS log_batch FROM ev""",
        "evalue_significance": f"""WITH {_UNGAPPED} SELECT {_tier('pairwise')} AS significance, count(*) AS pairs FROM ev GROUP BY 1""",
        "format_evalue": f"""WITH {_UNGAPPED} SELECT id, next_id, CASE WHEN pairwise = 0 THEN '0.0'
            WHEN pairwise < 1e-100 THEN printf('%.1e', pairwise) WHEN pairwise < 0.001 THEN printf('%.2e', pairwise)
            WHEN pairwise < 10 THEN printf('%.4f', pairwise) WHEN pairwise < 1000 THEN printf('%.1f', pairwise)
            ELSE printf('%.1e', pairwise) END AS text FROM ev""",
        "hydro_profile": _profile(C.HYDROPATHY_X10, True),
        "charge_profile": _profile(C.CHARGE_X10, True),
        "binary_profile": _profile(BINARY, False),
        "net_charge": f"""WITH {LETTERS} SELECT id, {_round(_charge('sequence', '7::double'), 4)} AS charge FROM letters""",
        "isoelectric_point": f"""WITH RECURSIVE {LETTERS}, src AS (SELECT DISTINCT sequence AS s FROM letters),{_pi('src')}
            SELECT id, {_round('pi', 3)} AS pi FROM letters JOIN pis ON s = sequence""",
        "profile_pearson": f"""WITH {LETTERS}, {_neighbours('letters')}, raws AS (SELECT id || '/' || next_id AS pid, id, next_id,
            {', '.join(f"{_values(x, v)} AS {y}{n}" for n, v in (('h', C.HYDROPATHY_X10), ('c', C.CHARGE_X10)) for x, y in (('a', 'q'), ('b', 't')))} FROM neighbours),
            {','.join(f'''d{n} AS (SELECT pid, {_pearson('n', 'sx', 'sxx', 'sy', 'syy', 'sxy')} AS r FROM (
              SELECT pid, count(*) AS n, sum(x)::bigint AS sx, sum(y)::bigint AS sy, sum(x*x)::bigint AS sxx, sum(y*y)::bigint AS syy, sum(x*y)::bigint AS sxy
              FROM (SELECT pid, unnest(q{n}[1:least(len(q{n}), len(t{n}))]) AS x, unnest(t{n}[1:least(len(q{n}), len(t{n}))]) AS y FROM raws) GROUP BY pid))''' for n in 'hc')}
            SELECT id, next_id, {_round('dh.r', 6)} AS hydrophobicity, {_round('dc.r', 6)} AS charge
            FROM raws JOIN dh USING (pid) JOIN dc USING (pid)""",
        "max_xcorr": f"""WITH RECURSIVE {_WORD_PAIRS}, ends AS (SELECT q AS s FROM pairs UNION SELECT t FROM pairs),{_pi('ends')},{_metrics('pairs')}
            SELECT id, next_id, {_round('hx', 6)} AS cross_corr FROM pairs JOIN metrics USING (pid)""",
        "physchem_similarity": f"""WITH RECURSIVE {_WORD_PAIRS}, ends AS (SELECT q AS s FROM pairs UNION SELECT t FROM pairs),{_pi('ends')},{_metrics('pairs')}
            SELECT id, next_id, {METRIC_COLUMNS} FROM pairs JOIN composed USING (pid)""",
        "detection_source": f"""WITH RECURSIVE {_WORD_PAIRS}, ends AS (SELECT q AS s FROM pairs UNION SELECT t FROM pairs),{_pi('ends')},{_metrics('pairs')},{_align('pairs')}
            SELECT {_source('evalue <= 0.01::double')} AS detection_source, count(*) AS pairs FROM (
              SELECT pc, {_evalue('raw_score', 'length(q)', '(SELECT sum(length(sequence)) FROM words)')} AS evalue
              FROM pairs JOIN composed USING (pid) JOIN aligned USING (pid)) GROUP BY 1""",
        "sw_score": f"""WITH RECURSIVE {_WORD_PAIRS},{_align('pairs')}
            SELECT id, next_id, raw_score, target_end FROM pairs JOIN aligned USING (pid)""",
        "sw_batch": f"""WITH RECURSIVE {_WORD_PAIRS},{_align('pairs')},
            common AS (SELECT pid, min(i) AS start, d, count(*) AS run FROM (
              SELECT pid, d, i, i - row_number() OVER (PARTITION BY pid, d ORDER BY i) AS g FROM (
                SELECT pid, i, i - j AS d FROM (SELECT pid, q, t, unnest(range(1, length(q) + 1)) AS i FROM pairs),
                LATERAL (SELECT unnest(list_filter(range(1, length(t) + 1), lambda j: t[j] = q[i])) AS j)))
              GROUP BY pid, d, g HAVING count(*) >= 6),
            runs AS (SELECT * FROM (SELECT pid, run, start + run - 2 AS qe, start - d + run - 2 AS te, row_number() OVER (
              PARTITION BY pid ORDER BY run DESC, start + run, start - d + run) AS rk FROM common) WHERE rk = 1)
            SELECT id, next_id, raw_score, coalesce(run, 0) AS run, coalesce(qe, -1) AS run_query_end,
              coalesce(te, -1) AS run_target_end FROM pairs JOIN aligned USING (pid) LEFT JOIN runs USING (pid)""",
        "align_pair": f"""WITH RECURSIVE {_WORD_PAIRS},{_align('pairs')}
            SELECT id, next_id, raw_score, {_round(_bits('raw_score'), 1)} AS bit_score,
              {_round("log10(" + _evalue('raw_score', 'length(q)', '(SELECT sum(length(sequence)) FROM words)') + ")", 6)} AS log_evalue,
              length(q) AS query_length, length(t) AS target_length, target_end AS aligned_region_len
            FROM pairs JOIN aligned USING (pid)""",
        "contiguous_match": f"""WITH {_WORD_NODES},{_seeds(6, 's')},{ISLANDS},
            best AS (SELECT * FROM (SELECT q, t, chain + 5 AS run, start + chain + 4 AS qe, start - d + chain + 4 AS te,
              row_number() OVER (PARTITION BY q, t ORDER BY chain DESC, start + chain, start - d + chain) AS rk FROM islands) WHERE rk = 1)
            {_ids('best', ', run, qe AS run_query_end, te AS run_target_end')}""",
        "kmer_jaccard_join": f"WITH {_WORD_NODES},{_jaccard()} {_ids('jac', ', ' + _round('jaccard', 6) + ' AS jaccard' + _RANK)}",
        "kmer_chain_join": f"WITH {_WORD_NODES},{CHAIN} {_ids('chain')}",
        "two_pass_candidates": f"""WITH {_WORD_NODES},{_jaccard()},{CHAIN},
            two AS (SELECT q, t, jaccard FROM jac UNION ALL SELECT q, t, 0::double FROM chain ANTI JOIN jac USING (q, t))
            {_ids('two', ', ' + _round('jaccard', 6) + ' AS jaccard' + _RANK)}""",
        "index_jaccard": f"WITH {_SEARCHED} {_items('jac', True)}",
        "index_chain": f"WITH {_SEARCHED} {_items('chain', False)}",
        "index_candidates": f"""WITH {_SEARCHED},
            two AS (SELECT q, t, jaccard FROM jac UNION ALL SELECT q, t, 0::double FROM chain ANTI JOIN jac USING (q, t))
            {_items('two', True)}""",
        "index_diagonals": f"""WITH {_SEARCHED_DIAGONALS} SELECT query_id AS item_id, target_id, chain AS chain_length, d AS diagonal,
            start AS chain_start_qpos, len AS region_len, {_round('mean', 4)} AS blosum62_mean, chain >= 2 AS passed_chain,
            chain < 2 AND mean >= 3 AS rescued,
            row_number() OVER (PARTITION BY q ORDER BY chain DESC, mean DESC NULLS LAST, t) AS rank FROM details""",
        "live_items": f"""WITH RECURSIVE {_SEARCHED},
            pairs AS (SELECT row_number() OVER () AS pid, c.q AS item, c.t AS tn, p.s AS q, n.s AS t FROM chain c
              JOIN probes p ON p.node = c.q JOIN nodes n ON n.node = c.t),{_align('pairs')},
            hits AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY evalue, ordinal) AS rank FROM (
              SELECT item, w.id, w.ordinal, length(q) AS qlen, length(t) AS tlen, raw_score, target_end,
                {_evalue('raw_score', 'length(q)', _DB)} AS evalue
              FROM aligned JOIN pairs USING (pid) JOIN words w ON w.sequence = t) WHERE evalue <= 10 AND target_end >= 8)
            SELECT item AS item_id, rank, id AS target_id, raw_score, {_round(_bits('raw_score'), 1)} AS bit_score,
              {_round('log10(evalue)', 6)} AS log_evalue, {_tier('evalue')} AS significance, target_end AS aligned_region_len,
              qlen AS query_length, tlen AS target_length FROM hits WHERE rank <= 25""",
        "ra_candidates": f"WITH {_MESSAGE_NODES},{_DETAILS} {_ids('passing')}",
        "ra_candidates_documents": f"""WITH {_WORD_NODES},{_DETAILS},
            others AS (SELECT p.q, count(*) AS k FROM passing p JOIN nodes b ON b.node = p.t JOIN words w ON w.sequence = b.s GROUP BY 1)
            SELECT n.id AS query_id, n.copies AS query_copies, (coalesce(k, 0) + n.copies - 1)::bigint AS passes
            FROM nodes n LEFT JOIN others ON q = n.node WHERE coalesce(k, 0) + n.copies > 1""",
        "ra_rescue": f"WITH {_MESSAGE_NODES},{_DETAILS} {_ids('(SELECT * FROM passing WHERE chain < 2)')}",
        "ra_details": f"""WITH {_MESSAGE_NODES},{_DETAILS} SELECT query_id, target_id, chain AS chain_length, d AS diagonal,
            start AS chain_start_qpos, len AS region_len, {_round('mean', 4)} AS blosum62_mean, chain >= 2 AS passed_chain,
            chain < 2 AND mean >= 3 AS rescued,
            row_number() OVER (PARTITION BY q ORDER BY chain DESC, mean DESC NULLS LAST, t) AS rank FROM details""",
        "triangular_pairs": f"""WITH {WORDS} SELECT id, row_number() OVER o - 1 AS rank,
            count(*) OVER () - row_number() OVER o AS targets FROM words WINDOW o AS (ORDER BY length(sequence) DESC, ordinal)""",
        "identical_copies": f"""WITH {WORDS} SELECT id, first_value(id) OVER (PARTITION BY sequence ORDER BY ordinal) AS class_id,
            count(*) OVER (PARTITION BY sequence) AS copies FROM words""",
        "resume_pending": f"""WITH {_WORD_NODES},{_jaccard()} SELECT id, len AS length FROM nodes
            WHERE copies = 1 AND node NOT IN (SELECT q FROM jac)""",
        "filter_quality": _family_numbers(),
        "family_sensitivity": f"""WITH {_FAMILY}, sizes AS (SELECT family, count(*) AS members FROM members GROUP BY 1),
            hit AS (SELECT t.family, count(*) AS found FROM truth t JOIN found f ON f.a = t.a AND f.b = t.b GROUP BY 1)
            SELECT family, members, (members * (members - 1) // 2)::bigint AS expected, coalesce(found, 0) AS found,
            {_round("CASE WHEN members > 1 THEN coalesce(found, 0)::double / (members * (members - 1) // 2) * 100 ELSE 0 END", 4)} AS sensitivity
            FROM sizes LEFT JOIN hit USING (family)""",
        "pass_distribution": f"""{_PASSES} SELECT count(*) AS queries, {_round('avg(passes)', 4)} AS mean,
            list_sort(list(passes))[count(*) // 2 + 1] AS median, min(passes) AS minimum, max(passes) AS maximum,
            {_round('(1 - avg(passes) / (count(*) - 1)) * 100', 4)} AS rejection_rate FROM counts""",
        "pass_histogram": f"{_PASSES} SELECT CASE {bins} END AS from_passes, count(*) AS queries FROM counts GROUP BY 1",
        "family_counts": f"WITH {WORDS} SELECT 'D' || doc_id AS family, count(*) AS members FROM words GROUP BY 1",
        "screen_kmer": f"{_KMER_ITEMS} {_SCREEN_OUT}",
        "screen_vectorized": f"{_screen(_ITEM_NODES, True, _REDUCED_CAND, _PRECEDES)} {_SCREEN_OUT}",
        "screen_exhaustive": f"{_screen(_ITEM_NODES, True, _ALL_CAND, _PRECEDES)} {_SCREEN_OUT}",
        "live_query": f"""WITH RECURSIVE {_WORD_NODES}, probe AS (SELECT {_WORDS.format("replace(text, chr(10), ' ')")} AS q
              FROM benchmark ORDER BY item_id LIMIT 1),
            pairs AS (SELECT node AS pid, q, s AS t FROM nodes, probe),{_align('pairs')},
            hits AS (SELECT *, row_number() OVER (ORDER BY evalue, ordinal) AS rank FROM (
              SELECT w.id, w.ordinal, n.len, raw_score, target_end, {_evalue('raw_score', '(SELECT length(q) FROM probe)', _DB)} AS evalue
              FROM aligned JOIN nodes n ON node = pid JOIN words w ON w.sequence = n.s) WHERE evalue <= 10 AND target_end >= 8)
            SELECT rank, id AS target_id, raw_score, {_round(_bits('raw_score'), 1)} AS bit_score, {_round('log10(evalue)', 6)} AS log_evalue,
              {_tier('evalue')} AS significance, target_end AS aligned_region_len, len AS target_length FROM hits WHERE rank <= 25""",
        "antigen_scan": f"WITH {WORDS} SELECT id, sequence AS stripped FROM words",
        "antigen_upsert": f"""WITH {WORDS}, {MESSAGES},
            m AS (SELECT conv_id::varchar AS id, max_by(sequence, ordinal) AS sequence FROM messages GROUP BY 1),
            d AS (SELECT doc_id::varchar AS id, max_by(sequence, ordinal) AS sequence FROM words GROUP BY 1)
            SELECT id, sequence, sequence AS stripped, 0 AS tag_found, length(sequence) AS length FROM (
              SELECT * FROM d UNION ALL SELECT * FROM m WHERE id NOT IN (SELECT id FROM d))""",
        "sim_insert_ignore": f"""WITH {_WORD_NODES},{_jaccard('0.0::double')},{CHAIN},
            j AS (SELECT * FROM jac WHERE q < t),
            merged AS (SELECT q, t, jaccard, 'pass1' AS origin FROM j WHERE jaccard >= 0.04
              UNION ALL SELECT q, t, CASE WHEN jaccard >= 1 THEN jaccard ELSE 0::double END, 'pass2' FROM chain LEFT JOIN j USING (q, t)
              WHERE q < t AND coalesce(jaccard, 0) < 0.04)
            {_ids('merged', ', ' + _round('jaccard', 6) + ' AS jaccard, origin')}""",
        "store_stats": f"""WITH {_WORD_NODES},{CHAIN} SELECT (SELECT count(*) FROM words) AS antigens,
            (SELECT sum(length(sequence))::bigint FROM words) AS residues, ((SELECT count(*) FROM chain JOIN nodes a ON a.node = q JOIN nodes b ON b.node = t
                JOIN words x ON x.sequence = a.s JOIN words y ON y.sequence = b.s WHERE q < t)
              + (SELECT count(*) FROM words x JOIN words y ON x.sequence = y.sequence AND x.ordinal < y.ordinal))::bigint AS pairs""",
        "completed_queries": f"{_KMER_ITEMS} SELECT DISTINCT query_id FROM stored",
        "query_similar": f"""{_KMER_ITEMS}, both_ways AS (
              SELECT query_id AS id, target_id AS partner_id, 0 AS side, * EXCLUDE (query_id, target_id) FROM stored
              UNION ALL SELECT target_id, query_id, 1, * EXCLUDE (query_id, target_id) FROM stored WHERE query_id <> target_id),
            one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, partner_id ORDER BY evalue, side) AS k FROM both_ways) WHERE k = 1),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY evalue, partner_id) AS rank FROM one)
            SELECT id, rank, partner_id, raw_score, bit_score, log_evalue, query_length, target_length, aligned_region_len,
              pc_composite_score, detection_source, {_tier('evalue')} AS significance FROM ranked WHERE rank <= 50""",
        "export_pairs": f"""{_KMER_ITEMS} SELECT stored.* EXCLUDE (evalue, q_copies, t_copies), a.sequence AS query_stripped,
            b.sequence AS target_stripped FROM stored JOIN items a ON a.id = query_id JOIN items b ON b.id = target_id WHERE evalue <= 10""",
    }
    return sqls
