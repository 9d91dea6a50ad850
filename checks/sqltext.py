"""Building blocks of the DuckDB statements that recompute each query independently."""

from __future__ import annotations

# Fixed values of the sampler (stated here again on purpose: the check must not import them).
MASK = 4294967295
ROUNDS = ((2146121005, 16), (830770091, 15), (1540483477, 14))
HIGH = 1013904242
GOLDEN = 2654435761
OPS = ("==", "!=", ">", "<=", "<", ">=")
ALLOWED = {"==": 1, "!=": 14, ">": 4, "<=": 3, "<": 2, ">=": 5}

CLASSES = {
    "lineitem": [("l_orderkey", "I"), ("l_partkey", "I"), ("l_suppkey", "I"), ("l_linenumber", "I"),
                 ("l_quantity", "R"), ("l_extendedprice", "R"), ("l_discount", "R"), ("l_tax", "R"),
                 ("l_returnflag", "S"), ("l_linestatus", "S"), ("l_shipdate", "S")],
    "orders": [("o_orderkey", "I"), ("o_custkey", "I"), ("o_orderstatus", "S"), ("o_totalprice", "R"),
               ("o_orderdate", "S"), ("o_orderpriority", "S")],
    "customer": [("c_custkey", "I"), ("c_name", "S"), ("c_nationkey", "I"), ("c_acctbal", "R"), ("c_mktsegment", "S")],
    "nation": [("n_nationkey", "I"), ("n_name", "S"), ("n_regionkey", "I")],
    "region": [("r_regionkey", "I"), ("r_name", "S")],
    "supplier": [("s_suppkey", "I"), ("s_name", "S"), ("s_nationkey", "I"), ("s_acctbal", "R")],
    "part": [("p_partkey", "I"), ("p_name", "S"), ("p_brand", "S"), ("p_type", "S"), ("p_size", "I"), ("p_retailprice", "R")],
    "events": [("event_id", "I"), ("ts", "S"), ("user_id", "I"), ("event_type", "S"), ("value", "R"), ("props", "S")],
    "conversations": [("conv_id", "I"), ("turn", "I"), ("role", "S"), ("text", "S")],
    "documents": [("doc_id", "I"), ("text", "S"), ("lang", "S"), ("source", "S"), ("n_chars", "I")],
}
NAMES = {"I": "INTEGER", "R": "REAL", "S": "STRING"}


def keys(seed: int) -> list[int]:
    def mix(h: int) -> int:
        for m, s in ROUNDS:
            h = ((h ^ (h >> s)) * m) & MASK
        return h ^ (h >> 16)
    return [mix((seed * GOLDEN + 977 * (k + 1)) & MASK) for k in range(4)]


def encoded(col: str, cls: str) -> str:
    if cls == "I":
        return f"coalesce(CAST({col} AS BIGINT), 0)"
    if cls == "R":
        return f"coalesce(CAST({col} AS DOUBLE), 'nan'::DOUBLE)"
    return f"coalesce(CAST({col} AS VARCHAR), '')"


def predicates(cols: list[tuple[str, str]]) -> list[tuple[int, int, int, str, str, str]]:
    """(pred_id, col_id, op_id, col, op, class)"""
    out = []
    for c, (name, cls) in enumerate(cols):
        for o, op in enumerate(OPS[:2] if cls == "S" else OPS):
            out.append((len(out), c, o, name, op, cls))
    return out


def start(batch: int) -> int:
    full = min(batch, 20)
    return 100 * (2 ** full - 1) + (batch - full) * 100 * 2 ** 20


def batches_for(threshold: float) -> int:
    """Batches after which a predicate that never holds has stopped."""
    b = 0
    while True:
        b += 1
        m = start(b)
        if (m + 1) / (m + 2) ** 2 <= threshold * 0.01:
            return b


def rows_ctes(source: str, cols: list[tuple[str, str]], order: str) -> str:
    values = ", ".join(f"{encoded(n, c)} AS c{k}" for k, (n, c) in enumerate(cols))
    return (f"rows AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS rid, {values} FROM {source}), "
            "size AS (SELECT count(*) AS n FROM rows)")


def pair_ctes(batches: int, seed: int = 42) -> str:
    """CTE ``pairs(batch, i, x, y)`` over ``size(n)``; batches stop at the share of all pairs."""
    steps = []
    for name, key in zip(("xh", "xl", "yh", "yl"), keys(seed)):
        h = f"{name}0"
        steps.append(f"xor(xor(i, (i >> 32) * {HIGH}), {key}::BIGINT) & {MASK} AS {h}")
        for r, (m, s) in enumerate(ROUNDS):
            nxt = f"{name}{r + 1}"
            steps.append(f"(xor({h}, {h} >> {s}) * {m}) & {MASK} AS {nxt}")
            h = nxt
        steps.append(f"xor({h}, {h} >> 16) AS {name}")
    cases = " ".join(f"WHEN i < {start(b + 1)} THEN {b}" for b in range(batches))
    starts = " ".join(f"WHEN {b} THEN {start(b)}" for b in range(batches))
    return (f"draws AS (SELECT i, CASE {cases} END AS batch, {', '.join(steps)} "
            f"FROM (SELECT range AS i FROM range({start(batches)}))), "
            "placed AS (SELECT batch, i, ((xh >> 1) * 2147483648 + (xl >> 1)) % n AS x, "
            "((yh >> 1) * 2147483648 + (yl >> 1)) % (n - 1) AS y0 FROM draws, size "
            f"WHERE n > 1 AND (CASE batch {starts} END) < 0.0325 * n * n), "
            "pairs AS (SELECT batch, i, x, y0 + CASE WHEN y0 >= x THEN 1 ELSE 0 END AS y FROM placed)")


def state(x: str, y: str, cls: str) -> str:
    if cls == "S":
        return f"CASE WHEN {x} = {y} THEN 1 ELSE 8 END"
    body = f"WHEN {x} < {y} THEN 2 WHEN {x} > {y} THEN 4 ELSE 1 END"
    return f"CASE WHEN isnan({x}) OR isnan({y}) THEN 8 {body}" if cls == "R" else f"CASE {body}"


def states_cte(cols: list[tuple[str, str]]) -> str:
    """CTE ``pv(batch, i, s0, s1, ...)``: the state of each column for each pair."""
    parts = ", ".join(f"{state(f'l.c{k}', f'r.c{k}', c)} AS s{k}" for k, (_, c) in enumerate(cols))
    return f"pv AS (SELECT batch, i, {parts} FROM pairs JOIN rows l ON l.rid = x JOIN rows r ON r.rid = y)"


def counts_ctes(cols: list[tuple[str, str]]) -> str:
    """CTE ``counts(batch, pred_id, hits)``, zeros included."""
    preds = predicates(cols)
    wide = ", ".join(f"count(*) FILTER (WHERE (s{c} & {ALLOWED[op]}) <> 0) AS h{p}" for p, c, _, _, op, _ in preds)
    long = " UNION ALL ".join(f"SELECT batch, {p[0]} AS pred_id, h{p[0]} AS hits FROM wide" for p in preds)
    return f"wide AS (SELECT batch, {wide} FROM pv GROUP BY batch), counts AS ({long})"


PSI = ("psi AS (SELECT list(v ORDER BY n) AS g1, list(w ORDER BY n) AS g2 FROM (SELECT n, "
       "-0.5772156649015329 + coalesce(sum(CASE WHEN n > 1 THEN 1.0::DOUBLE / (n - 1) END) OVER w1, 0) AS v, "
       "pi() * pi() / 6 - coalesce(sum(CASE WHEN n > 1 THEN 1.0::DOUBLE / ((n - 1) * (n - 1)) END) OVER w1, 0) AS w "
       "FROM (SELECT range AS n FROM range(1, 1000)) WINDOW w1 AS (ORDER BY n)))")


def digamma(n: str) -> str:
    return f"CASE WHEN {n} >= 1000 THEN ln({n}) ELSE (SELECT g1 FROM psi)[{n}] END"


def trigamma(n: str) -> str:
    return f"CASE WHEN {n} >= 500 THEN 1.0::DOUBLE / {n} ELSE (SELECT g2 FROM psi)[{n}] END"


def mean_log(a: str, b: str) -> str:
    return f"({digamma(a)} - {digamma(f'({a} + {b})')})"


def spread_log(a: str, b: str) -> str:
    return f"({trigamma(a)} - {trigamma(f'({a} + {b})')})"


def stop_ctes(cols: list[tuple[str, str]], threshold: float) -> str:
    """CTEs ``constant`` and ``stats(pred_id, col_id, op, last_batch, a, b, m, s, rank)``."""
    preds = predicates(cols)
    consts = " UNION ALL ".join(
        f"SELECT {k} AS col_id, coalesce(min(c{k}) = max(c{k}){' AND NOT isnan(max(c%d))' % k if c == 'R' else ''}, false) AS flat FROM rows"
        for k, (_, c) in enumerate(cols))
    space = ", ".join(f"({p}, {c}, '{col}', '{op}', {ALLOWED[op]})" for p, c, _, col, op, _ in preds)
    return (f"constant AS ({consts}), space(pred_id, col_id, col, op, allowed) AS (VALUES {space}), "
            "running AS (SELECT pred_id, batch, CAST(1 + sum(hits) OVER w AS BIGINT) AS a, "
            "CAST(1 + sum(100 * (1 << least(batch, 20)) - hits) OVER w AS BIGINT) AS b FROM counts "
            "WINDOW w AS (PARTITION BY pred_id ORDER BY batch)), "
            "graded AS (SELECT *, b::DOUBLE / (a::DOUBLE * (a + b)::DOUBLE * (a + b)::DOUBLE) AS grad FROM running), "
            f"ends AS (SELECT pred_id, coalesce(min(batch) FILTER (WHERE grad <= {threshold * 0.01!r}), max(batch)) AS last_batch FROM graded GROUP BY pred_id), "
            "seen AS (SELECT e.pred_id, sp.col_id, sp.col, sp.op, sp.allowed, flat AND sp.op IN ('!=', '>', '<') AS barred, "
            "e.last_batch AS stop_batch, g.a AS a0, g.b AS b0 "
            "FROM ends e JOIN graded g ON g.pred_id = e.pred_id AND g.batch = e.last_batch "
            "JOIN space sp ON sp.pred_id = e.pred_id JOIN constant k ON k.col_id = sp.col_id), "
            "settled AS (SELECT pred_id, col_id, col, op, allowed, barred, CASE WHEN barred THEN -1 ELSE stop_batch END AS last_batch, "
            "CASE WHEN barred THEN 1 ELSE a0 END AS a, CASE WHEN barred THEN 1000000001 ELSE b0 END AS b FROM seen), "
            f"stats AS (SELECT *, {mean_log('a', 'b')} AS m, {spread_log('a', 'b')} AS s, "
            f"row_number() OVER (ORDER BY CASE WHEN barred THEN 1 ELSE 0 END, round({mean_log('a', 'b')}, 9) DESC, pred_id) - 1 AS rank FROM settled)")


def anchored_cte(cols: list[tuple[str, str]]) -> str:
    """CTE ``anchored(anchor, st, cnt)``: states of the pairs that satisfy each anchor."""
    listed = "[" + ", ".join(f"s{k}" for k in range(len(cols))) + "]"
    parts = " UNION ALL ".join(
        f"SELECT (SELECT rank FROM stats WHERE pred_id = {p}) AS anchor, {listed} AS st, count(*) AS cnt FROM pv "
        f"WHERE (s{c} & {ALLOWED[op]}) <> 0 AND batch <= (SELECT last_batch FROM stats WHERE pred_id = {p}) GROUP BY ALL"
        for p, c, _, _, op, _ in predicates(cols))
    return f"anchored AS MATERIALIZED ({parts})"


def _distance(lm: str, ls: str) -> str:
    return (f"(({lm} - m) / sqrt({ls} * {ls} + s * s) * "
            "CASE WHEN mean > 0.8 THEN exp(-0.2 / (1 - mean)) ELSE 1 END)")


def level_ctes(top: int) -> str:
    """CTEs ``t2 .. t{top}``: judged sets ``(r1 > r2 > ..., a, m, s, score, sound)``."""
    out = ["p AS (SELECT rank AS r, col_id AS col, allowed, a, m, s FROM stats)"]
    for k in range(2, top + 1):
        rs = [f"r{j}" for j in range(1, k + 1)]
        last = f"r{k}"
        if k == 2:
            cand = ("SELECT p1.r AS r1, p2.r AS r2, p1.a AS from_a, p2.m AS lm1, p2.s AS ls1, p1.col AS k1, p2.col AS k2, "
                    "p1.allowed AS w1, p2.allowed AS w2 FROM p p1 JOIN p p2 ON p2.r < p1.r AND p2.col <> p1.col AND p1.a > 1 AND p2.a > 1")
        else:
            # parent S = (r1..r_{k-1}); subsets S - c + p for each c.
            sub = []
            for c in range(1, k):
                kept = [f"r{j}" for j in range(1, k + 1) if j != c]
                cond = " AND ".join(f"u{c}.r{n + 1} = " + (f"q.r" if col == last else f"s.{col}") for n, col in enumerate(kept))
                sub.append(f"JOIN t{k - 1} u{c} ON {cond} AND u{c}.sound AND u{c}.a > 1")
            carry = ", ".join([f"s.r{j}" for j in range(1, k)] + [f"s.k{j}" for j in range(1, k)] + [f"s.w{j}" for j in range(1, k)])
            lows = ", ".join(f"u{c}.m AS lm{c}, u{c}.s AS ls{c}" for c in range(1, k))
            apart = " AND ".join(f"q.col <> s.k{j}" for j in range(1, k))
            cand = (f"SELECT {carry}, q.r AS r{k}, q.col AS k{k}, q.allowed AS w{k}, s.a AS from_a, {lows} "
                    f"FROM t{k - 1} s JOIN p q ON q.r < s.r{k - 1} AND s.a > 1 AND {apart} {' '.join(sub)}")
        test = " AND ".join(f"(e.st[k{j} + 1] & w{j}) <> 0" for j in range(1, k + 1))
        cols = ", ".join(rs + [f"k{j}" for j in range(1, k + 1)] + [f"w{j}" for j in range(1, k + 1)] + ["from_a"] +
                         [f"lm{c}, ls{c}" for c in range(1, k)])
        gaps = ", ".join(_distance(f"lm{c}", f"ls{c}") for c in range(1, k))
        score = f"least({gaps})" if k > 2 else gaps
        edge_b = "(1 + from_a - a)"
        out.append(f"d{k} AS ({cand})")
        out.append(f"h{k} AS (SELECT {cols}, CAST(1 + coalesce(sum(cnt) FILTER (WHERE {test}), 0) AS BIGINT) AS a "
                   f"FROM d{k} LEFT JOIN anchored e ON e.anchor = d{k}.r1 GROUP BY {cols})")
        out.append(f"m{k} AS (SELECT *, {mean_log('a', edge_b)} AS m, {spread_log('a', edge_b)} AS s, "
                   f"a::DOUBLE / (a + {edge_b}) AS mean FROM h{k})")
        out.append(f"t{k} AS MATERIALIZED (SELECT *, {score} AS score, {score} >= 2.0 AS sound FROM m{k})")
    return ", ".join(out)


def found_sql(top: int) -> str:
    """Rows ``(denial_constraint, size, score, anchor, sampled_pairs)`` of the emitted sets."""
    parts = []
    for k in range(2, top + 1):
        joins = " ".join(f"JOIN stats x{j} ON x{j}.rank = t.r{j}" for j in range(1, k + 1))
        text = " || ".join(f"x{j}.col || ' ' || x{j}.op || ' ' || x{j}.col || ' & '" for j in range(k, 0, -1))
        starts = " ".join(f"WHEN {b} THEN {start(b + 1)}" for b in range(0, 26))
        parts.append(f"SELECT '!(' || {text} || ')' AS denial_constraint, {k} AS size, round(t.score, 5) AS score, "
                     f"x1.col || ' ' || x1.op AS anchor, CAST(CASE x1.last_batch {starts} END AS BIGINT) AS sampled_pairs "
                     f"FROM t{k} t {joins} WHERE t.sound AND t.a = 1")
    return " UNION ALL ".join(parts)


def sample_sql(source: str, cols: list[tuple[str, str]], order: str, threshold: float, seed: int = 42) -> str:
    """All CTEs up to ``stats`` (without WITH)."""
    return ", ".join([rows_ctes(source, cols, order), pair_ctes(batches_for(threshold), seed), states_cte(cols),
                      counts_ctes(cols), PSI, stop_ctes(cols, threshold)]).replace("pv AS (", "pv AS MATERIALIZED (")


def discover_sql(source: str, cols: list[tuple[str, str]], order: str, threshold: float, top: int, select: str | None = None) -> str:
    return (f"WITH {sample_sql(source, cols, order, threshold)}, {anchored_cte(cols)}, {level_ctes(top)} "
            f"{select or found_sql(top)}")
