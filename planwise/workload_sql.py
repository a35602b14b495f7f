"""SQL of generated workloads, histograms and estimates, for the registered queries."""

from __future__ import annotations

from planwise.operators.workloads import masks

#: Columns of lineitem that workloads draw ranges on, and their domains.
DOMAINS = {"l_linenumber": (0, 8), "l_partkey": (0, 2000), "l_suppkey": (0, 100)}
QUERIES = 200
SHAPED = 40


def uniform(key: str, seed: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || ({key})::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)"


def picked(key: str, seed: str, columns: int, most: int) -> str:
    own = masks(columns, most)
    return f"({own})[(floor({uniform(key, seed)} * {len(own)}) + 1)::INTEGER]"


_MASK = f"SELECT q AS query_id, {picked('q', 'w1', len(DOMAINS), 4)} AS mask FROM range({QUERIES}) t(q)"
_W = [f"least(floor(floor({uniform('query_id', f'w1-w-{c}')} * {hi - lo}) * pow(1.5::DOUBLE, bit_count(mask))), {hi - lo - 1})::BIGINT" for c, (lo, hi) in DOMAINS.items()]
_L = [f"({lo} + floor({uniform('query_id', f'w1-l-{c}')} * ({hi - lo} - {w})))::BIGINT" for (c, (lo, hi)), w in zip(DOMAINS.items(), _W, strict=True)]
RANGES = " UNION ALL ".join(f"SELECT query_id, '{c}' AS \"column\", {left} AS lo, ({left}) + ({w}) AS hi FROM ({_MASK}) WHERE mask & {1 << i} > 0" for i, (c, left, w) in enumerate(zip(DOMAINS, _L, _W, strict=True)))
TEXTS = f"""SELECT query_id, 'select * from tpch.lineitem where ' || string_agg("column" || '>' || lo || ' and ' || "column" || '<' || hi, ' and ' ORDER BY list_position({list(DOMAINS)}, "column")) AS query FROM ({RANGES}) GROUP BY query_id"""
_WIDE = "SELECT query_id, " + ", ".join(f"max(CASE WHEN \"column\" = '{c}' THEN {s} END) AS {s}_{c}" for c in DOMAINS for s in ("lo", "hi")) + f" FROM ({RANGES}) GROUP BY query_id"
COUNTS = f"SELECT w.query_id, count(l.l_partkey) AS act_rows FROM ({_WIDE}) w LEFT JOIN lineitem l ON " + " AND ".join(f"(lo_{c} IS NULL OR {c} > lo_{c}) AND (hi_{c} IS NULL OR {c} < hi_{c})" for c in DOMAINS) + " GROUP BY w.query_id"
VALUES = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::BIGINT AS v FROM lineitem" for c in DOMAINS)
HISTOGRAM = f"""WITH c AS (SELECT "column", v, count(*) AS n FROM ({VALUES}) GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY "column" ORDER BY v) AS upto, sum(n) OVER (PARTITION BY "column") AS total FROM c),
b AS (SELECT *, sum(CASE WHEN (upto - n) * 10 >= total THEN 1 ELSE 0 END) OVER (PARTITION BY "column" ORDER BY v) AS bucket FROM u)
SELECT "column", bucket::BIGINT AS bucket, max(upto)::BIGINT AS row_count, min(v) AS lower, max(v) AS upper, max_by(n, v) AS repeats FROM b GROUP BY 1, 2"""
SHARES = f"""WITH h AS (SELECT *, lag(row_count, 1, 0) OVER (PARTITION BY "column" ORDER BY bucket) AS prev FROM ({HISTOGRAM})),
t AS (SELECT "column", count(*) AS total, count(DISTINCT v) AS ndv, min(v) AS low, max(v) AS high FROM ({VALUES}) GROUP BY 1),
p AS (SELECT r.query_id, r."column", s.side, CASE WHEN s.side = 0 THEN coalesce(r.lo + 1, t.low) ELSE coalesce(r.hi, t.high + 1) END AS v, t.total, t.ndv FROM ({RANGES}) r JOIN t USING ("column") CROSS JOIN (VALUES (0), (1)) s(side)),
f AS (SELECT p.*, (SELECT min(h.bucket) FROM h WHERE h."column" = p."column" AND h.upper >= p.v) AS bucket FROM p),
l AS (SELECT f.query_id, f."column", f.side, f.total, f.ndv, CASE WHEN f.bucket IS NULL THEN f.total::DOUBLE WHEN f.v < h.lower THEN h.prev::DOUBLE WHEN f.v = h.upper THEN (h.row_count - h.repeats)::DOUBLE
  ELSE h.prev + (CASE WHEN h.upper <= h.lower THEN 0.5::DOUBLE ELSE (f.v - h.lower)::DOUBLE / (h.upper - h.lower)::DOUBLE END) * (h.row_count - h.repeats - h.prev) END AS below FROM f LEFT JOIN h ON h."column" = f."column" AND h.bucket = f.bucket),
w AS (SELECT query_id, "column", total, ndv, max(CASE WHEN side = 0 THEN below END) AS lo, max(CASE WHEN side = 1 THEN below END) AS hi FROM l GROUP BY 1, 2, 3, 4),
s AS (SELECT query_id, total, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN lo >= hi AND ndv > 0 THEN least(hi, total - lo, total::DOUBLE / ndv) ELSE hi - lo END) / total)) AS sel FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sel) AS i FROM s),
x AS (SELECT query_id, max(total) AS total, max(CASE WHEN i = 1 THEN sel END) AS s1, coalesce(max(CASE WHEN i = 2 THEN sel END), 1.0::DOUBLE) AS s2, coalesce(max(CASE WHEN i = 3 THEN sel END), 1.0::DOUBLE) AS s3 FROM k GROUP BY 1)
SELECT query_id, total, s1 * s2 * s3 AS avi, s1 * pow(s2, 0.5::DOUBLE) * pow(s3, 0.25::DOUBLE) AS ebo, s1 AS min_sel FROM x"""
ESTIMATES = f"SELECT query_id, act_rows, round(avi * total, 4) AS avi, round(ebo * total, 4) AS ebo, round(min_sel * total, 4) AS min_sel FROM ({SHARES}) JOIN ({COUNTS}) USING (query_id)"
_ERRORS = " UNION ALL ".join(f"SELECT '{m}' AS method, round(greatest(act_rows, {m}) / coalesce(nullif(least(act_rows::DOUBLE, {m}), 0), 1.0), 4) AS e FROM x" for m in ("avi", "ebo", "min_sel"))
PERCENTILES = f"""WITH x AS ({ESTIMATES}), e AS ({_ERRORS}), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM e)
SELECT method, {', '.join(f"max(CASE WHEN i = floor(n * {q}::DOUBLE) THEN e END) AS p{int(q * 100)}" for q in (0.5, 0.8, 0.9, 0.99))} FROM r GROUP BY method"""
_BOUNDS = ", ".join(f"round(coalesce(max(CASE WHEN r.\"column\" = '{c}' THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (r.{s} - t.low)::DOUBLE / (t.high - t.low)::DOUBLE)) END), {none}), 6) AS {s}_{c}" for c in DOMAINS for s, none in (("lo", "0.0::DOUBLE"), ("hi", "1.0::DOUBLE")))
FEATURES = f"""SELECT f.*, round(s.avi, 6) AS avi, round(s.ebo, 6) AS ebo, round(s.min_sel, 6) AS min_sel FROM (SELECT r.query_id, {_BOUNDS} FROM ({RANGES}) r JOIN (SELECT "column", min(v) AS low, max(v) AS high FROM ({VALUES}) GROUP BY 1) t USING ("column") GROUP BY 1) f JOIN ({SHARES}) s USING (query_id)"""


def _range(column: str, rate: str, seed: str) -> str:
    lo, hi = DOMAINS[column]
    left = f"({lo} + floor({uniform('i', f'{seed}-{column}')} * greatest(floor({float(hi - lo)}::DOUBLE * (1.0::DOUBLE - {rate})), 1)))::BIGINT"
    return f"'{column}>=' || {left} || ' AND {column}<=' || ({left} + floor({float(hi - lo)}::DOUBLE * {rate})::BIGINT)"


def _some(columns: list[str], rate: str, seed: str) -> str:
    mask = picked("i", f"{seed}-m", len(columns), 2)
    return "concat_ws(' AND ', " + ", ".join(f"CASE WHEN {mask} & {1 << k} > 0 THEN {_range(c, rate, seed)} END" for k, c in enumerate(columns)) + ")"


def shaped(first: str, second: str, seed: str = "w4") -> str:
    every = list(DOMAINS)
    rest, other, most = [c for c in every if c not in (first, second)], [c for c in every if c != first], "0.95::DOUBLE"
    t = "tpch.lineitem"
    texts = [
        ("table_scan", f"'SELECT * FROM {t} USE INDEX(primary) WHERE ' || {_some(every, 'rate', f'{seed}-t')}"),
        ("index_scan", f"'SELECT {first} FROM {t} USE INDEX(idx_{first}) WHERE ' || {_range(first, 'rate', f'{seed}-i1')} || ' AND ' || {_some(rest, most, f'{seed}-i1')}"),
        ("index_scan_2", f"'SELECT {second} FROM {t} USE INDEX(idx_{second}) WHERE ' || {_range(second, 'rate', f'{seed}-i2')} || ' AND ' || {_some(rest, most, f'{seed}-i2')}"),
        ("index_lookup", f"'SELECT * FROM {t} USE INDEX(idx_{first}) WHERE ' || {_range(first, 'rate', f'{seed}-u')} || ' AND ' || {_some(other, most, f'{seed}-u')}"),
        ("hash_agg", f"'SELECT /*+ HASH_AGG() */ {first}, count(*) FROM {t} WHERE ' || {_some(every, 'rate', f'{seed}-a')} || ' GROUP BY {first}'"),
        ("sort", f"'SELECT {first}, {second} FROM {t} USE INDEX(idx_{first}) WHERE ' || {_some(every, 'rate', f'{seed}-s')} || ' ORDER BY {rest[0]}'"),
    ]
    return " UNION ALL ".join(f"SELECT (i * 6 + {k})::BIGINT AS query_id, '{s}' AS shape, {q} AS query FROM (SELECT i, i::DOUBLE / {float(SHAPED)}::DOUBLE AS rate FROM range({SHAPED}) t(i))" for k, (s, q) in enumerate(texts))
