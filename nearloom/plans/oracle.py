"""Plain SQL twins of the registered queries, built from shared table expressions.

Written for DuckDB over the same tables; used only to check results.
"""

from __future__ import annotations

from nearloom.operators import hamming_index
from nearloom.plans import catalog as c

EMB = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
SCALED = (
    "e AS (SELECT vec_id, list_transform(embedding, lambda x: x * (1 + label)::FLOAT)::DOUBLE[] AS v FROM embeddings)"
)
DOT = "list_dot_product(a.v, b.v)"


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


def hadamard(p: int) -> str:
    return (
        f"had AS (SELECT list(h ORDER BY j) AS hm FROM (SELECT j, list((1 - 2 * (bit_count(i & j) % 2))::DOUBLE ORDER BY i) AS h "
        f"FROM range({p}) x(i), range({p}) y(j) GROUP BY j))"
    )


def rotated(n: str, bits: int, seed: int, p: int = 64, src: str = "e", weights: str | None = None) -> list[str]:
    """``{n}_rot(vec_id, r, y)``: all rotated copies."""
    sign = f"CASE WHEN substr(md5(concat_ws(':', {seed}, r, layer, i)), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
    grid = f"(SELECT r, layer, i, {sign} AS s FROM range({bits}) a(r), range(3) b(layer), range({p}) c(i)) g"
    if weights:
        grid = f"(SELECT g.r, g.layer, g.i, coalesce(w.weight, g.s) AS s FROM {grid} LEFT JOIN {weights} w ON g.r = w.r AND g.layer = w.layer AND g.i = w.i) g"
    ctes = [f"{n}_sg AS (SELECT r, layer, list(s ORDER BY i) AS s FROM {grid} GROUP BY r, layer)"]
    prev, col = f"(SELECT r AS rr, vec_id, v AS y FROM {src}, range({bits}) t(r))", "y"
    for layer in range(3):
        ctes.append(
            f"{n}_d{layer} AS (SELECT p.vec_id, p.rr, list_transform(list_zip(p.{col}, g.s), lambda z: z[1] * z[2]) AS d "
            f"FROM {prev} p JOIN {n}_sg g ON g.r = p.rr AND g.layer = {layer})"
        )
        ctes.append(
            f"{n}_h{layer} AS (SELECT vec_id, rr, list_transform(hm, lambda h: list_dot_product(d, h)) AS y FROM {n}_d{layer}, had)"
        )
        prev = f"{n}_h{layer}"
    ctes.append(f"{n}_rot AS MATERIALIZED (SELECT vec_id, rr AS r, y FROM {prev})")
    return ctes


def coded(n: str, bits: int, seed: int, **kw) -> list[str]:
    """``{n}_cp(vec_id, r, axis, neg, mag, comp)``: component of every rotation."""
    return rotated(n, bits, seed, **kw) + [
        f"{n}_ax AS (SELECT vec_id, r, y, list_position(list_transform(y, lambda x: abs(x) >= m * (1 - 1e-9)), true) - 1 AS axis "
        f"FROM (SELECT vec_id, r, y, list_max(list_transform(y, lambda x: abs(x))) AS m FROM {n}_rot))",
        f"{n}_cp AS MATERIALIZED (SELECT vec_id, r, axis, CASE WHEN y[axis + 1] < 0 THEN 1 ELSE 0 END AS neg, abs(y[axis + 1]) AS mag, "
        f"axis * 2 + CASE WHEN y[axis + 1] < 0 THEN 1 ELSE 0 END AS comp FROM {n}_ax)",
    ]


def words(n: str) -> str:
    return f"{n}_w AS (SELECT vec_id, sum(neg::BIGINT << r)::BIGINT AS w FROM {n}_cp GROUP BY vec_id)"


def all_scores(n: str) -> str:
    """``{n}_sc(query_id, vec_id, dist)``: asymmetric distance of every pair."""
    return (
        f"{n}_sc AS MATERIALIZED (SELECT q.vec_id AS query_id, b.vec_id, -sum((1 - 2 * b.neg) * q.y[b.axis + 1]) AS dist "
        f"FROM {n}_rot q JOIN {n}_cp b ON q.r = b.r GROUP BY 1, 2)"
    )


def all_pairs(expr: str) -> str:
    return f"sc AS (SELECT a.vec_id AS query_id, b.vec_id, {expr} AS dist FROM e a, e b)"


def ranked(src: str, k: int, name: str = "top", skip_self: bool = False) -> str:
    where = "WHERE query_id <> vec_id" if skip_self else ""
    return (
        f"{name} AS MATERIALIZED (SELECT query_id, vec_id, dist, rank::INTEGER AS rank FROM (SELECT query_id, vec_id, dist, "
        f"row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM {src} {where}) WHERE rank <= {k})"
    )


def hits(src: str = "top", digits: int = 6) -> str:
    return f"SELECT query_id, vec_id, rank, round(dist, {digits}) AS dist FROM {src}"


def knn(expr: str, digits: int, base: str = EMB) -> str:
    return with_(base, all_pairs(expr), ranked("sc", c.K), select=hits(digits=digits))


COS = f"1 - {DOT}"
L2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
COMP = (hadamard(64), *coded("p", c.COMPONENT_CODE.bits, c.COMPONENT_CODE.seed))
TRUTH = (all_pairs(COS), ranked("sc", c.K, "truth"))
NEAR = (EMB, all_pairs(COS), ranked("sc", c.KNN_K, "nn", skip_self=True),
        "edges AS (SELECT query_id AS src, rank, vec_id AS dst, dist FROM nn)")
CODE_TOP = (EMB, *COMP, all_scores("p"))


def linked(found: str, params=c.GRAPH) -> list[str]:
    """``graph(src, dst, dist)``: best links, both directions, capped."""
    return [
        f"fwd AS (SELECT query_id AS src, vec_id AS dst, dist FROM {found} WHERE rank <= {params.m_links})",
        "both_ways AS (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM fwd UNION ALL SELECT dst, src, dist FROM fwd) GROUP BY 1, 2)",
        f"graph AS MATERIALIZED (SELECT src, dst, dist FROM both_ways QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= {params.max_degree})",
    ]


def graph_out(digits: int) -> str:
    return f"SELECT src, dst, round(dist, {digits}) AS dist FROM graph"


CODE_GRAPH = (*CODE_TOP, ranked("p_sc", c.GRAPH.m_links, "found", skip_self=True), *linked("found"))


def lloyd(n: str, src: str, first: str, width: int, rounds: int) -> list[str]:
    """``{n}(b, cell, m)``: centres after rounds of k-means over ``src(vec_id, b, v)`` from the centres ``first``."""
    step = 1 << 24
    ctes, prev = [f"{n}0 AS MATERIALIZED ({first})"], f"{n}0"
    for t in range(1, rounds + 1):
        name = n if t == rounds else f"{n}{t}"
        score = "0.5::DOUBLE * list_dot_product(c.m, c.m) - list_dot_product(s.v, c.m)"
        ctes += [
            f"{n}a{t} AS (SELECT s.b, c.cell, s.v FROM {src} s JOIN {prev} c USING (b) QUALIFY row_number() OVER (PARTITION BY s.b, s.vec_id ORDER BY {score}, c.cell) = 1)",
            f"{n}s{t} AS (SELECT b, cell, i, count(*) AS k, sum(floor(x * {step}.0::DOUBLE + 0.5::DOUBLE)::BIGINT) AS x FROM (SELECT b, cell, unnest(range({width})) AS i, unnest(v) AS x FROM {n}a{t}) GROUP BY 1, 2, 3)",
            f"{name} AS MATERIALIZED (SELECT c.b, c.cell, coalesce(l.m, c.m) AS m FROM {prev} c LEFT JOIN (SELECT b, cell, list(x::DOUBLE / {step}.0::DOUBLE / k ORDER BY i) AS m FROM {n}s{t} GROUP BY 1, 2) l USING (b, cell))",
        ]
        prev = name
    return ctes


def beams(params=c.BEAM, scores: str = "p_sc", entries: str = "SELECT min(vec_id) FROM e") -> list[str]:
    """``final(query_id, vec_id, dist, rank)``: beams after the last round."""
    turn = "row_number() OVER (PARTITION BY query_id, expanded ORDER BY dist, node)"
    marked = f"(SELECT it, query_id, node, dist, expanded, NOT expanded AND {turn} <= {params.width} AS picked FROM beam)"
    return [
        f"""beam(it, query_id, node, dist, expanded) AS (
  SELECT 0, query_id, vec_id, dist, false FROM {scores} WHERE vec_id IN ({entries})
  UNION ALL
  SELECT it + 1, query_id, node, dist, expanded FROM (
    SELECT it, query_id, node, min(dist) AS dist, bool_or(expanded) AS expanded FROM (
      SELECT it, query_id, node, dist, expanded OR picked AS expanded FROM {marked} m
      UNION ALL
      SELECT m.it, m.query_id, g.dst, s.dist, false FROM {marked} m JOIN graph g ON g.src = m.node
        JOIN {scores} s ON s.query_id = m.query_id AND s.vec_id = g.dst WHERE m.picked
    ) u GROUP BY 1, 2, 3
  ) n WHERE EXISTS (SELECT 1 FROM beam WHERE NOT expanded)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, node) <= {params.ef})""",
        "final AS (SELECT query_id, node AS vec_id, dist, (row_number() OVER (PARTITION BY query_id ORDER BY dist, node))::INTEGER AS rank "
        "FROM beam WHERE it = (SELECT max(it) FROM beam))",
    ]


EXACT_FINAL = (
    f"exact AS (SELECT f.query_id, f.vec_id, {COS} AS dist FROM final f JOIN e a ON a.vec_id = f.query_id JOIN e b ON b.vec_id = f.vec_id)",
    ranked("exact", c.K),
)
RERANKED = (*CODE_GRAPH, *beams(c.RERANKED), *EXACT_FINAL)
FOUR_ENTRIES = "SELECT vec_id FROM e ORDER BY ('0x' || substr(md5(concat_ws(':', 42, vec_id)), 1, 15))::BIGINT, vec_id LIMIT 4"


def probes(n: str, count: int) -> str:
    """``{n}_pr(query_id, r, comp, cost, pos)``: the most promising axes of every rotation."""
    return (
        f"{n}_pr AS MATERIALIZED (SELECT query_id, r, axis * 2 + CASE WHEN x < 0 THEN 1 ELSE 0 END AS comp, (m - level) * (m - level) AS cost, pos FROM ("
        "SELECT *, row_number() OVER (PARTITION BY query_id, r ORDER BY level DESC, axis) AS pos FROM ("
        "SELECT query_id, r, axis, x, m, CASE WHEN abs(x) >= m * (1 - 1e-9) THEN m ELSE abs(x) END AS level FROM ("
        "SELECT vec_id AS query_id, r, unnest(range(64)) AS axis, unnest(y) AS x, list_max(list_transform(y, lambda t: abs(t))) AS m "
        f"FROM {n}_rot))) WHERE pos <= {count})"
    )


def bucket_hits(candidates: str) -> list[str]:
    return [
        f"cand AS (SELECT DISTINCT query_id, vec_id FROM ({candidates}))",
        f"exact AS (SELECT k.query_id, k.vec_id, {COS} AS dist FROM cand k JOIN e a ON a.vec_id = k.query_id JOIN e b ON b.vec_id = k.vec_id)",
    ]


LSH = (
    EMB, hadamard(64), *coded("p", c.LSH_CODE.bits, c.LSH_CODE.seed), probes("p", 4),
    *bucket_hits("SELECT q.query_id, b.vec_id FROM p_pr q JOIN p_cp b ON q.r = b.r AND q.comp = b.comp"),
)
PAIR_LSH = (
    EMB, hadamard(64), *coded("p", c.PAIR_HASH_CODE.bits, c.PAIR_HASH_CODE.seed), probes("p", 12),
    "pairs AS (SELECT x.query_id, x.r // 2 AS t, x.comp * 128 + y.comp AS bucket FROM p_pr x JOIN p_pr y "
    "ON x.query_id = y.query_id AND y.r = x.r + 1 AND x.r % 2 = 0 "
    "QUALIFY row_number() OVER (PARTITION BY x.query_id, x.r ORDER BY x.cost + y.cost, x.pos, y.pos) <= 12)",
    "tables AS (SELECT x.vec_id, x.r // 2 AS t, x.comp * 128 + y.comp AS bucket FROM p_cp x JOIN p_cp y ON x.vec_id = y.vec_id AND y.r = x.r + 1 AND x.r % 2 = 0)",
    *bucket_hits("SELECT q.query_id, b.vec_id FROM pairs q JOIN tables b ON q.t = b.t AND q.bucket = b.bucket"),
)

HASH = "('0x' || substr(md5(concat_ws(':', 42, pair_id, '{}')), 1, 15))::BIGINT"
PAIRS = (
    "numbered AS (SELECT vec_id * 20 + p AS pair_id, (SELECT count(*) FROM e) AS n FROM e, range(20) t(p))",
    f"drawn AS (SELECT pair_id, n, {HASH.format('i')} % n AS i, {HASH.format('j')} % n AS j FROM numbered)",
    "pairs AS (SELECT pair_id, i, CASE WHEN i = j THEN (j + 1) % n ELSE j END AS j FROM drawn)",
)
SIGN = (*coded("s", c.RESIDUAL_CODE.bits, c.RESIDUAL_CODE.seed), words("s"))
RESID = (*coded("t", c.RESIDUAL_CODE.residual_bits, c.RESIDUAL_CODE.seed + c.RESIDUAL_CODE.bits), words("t"))
PAIR_CODES = (
    EMB, *COMP, *SIGN, *RESID, *PAIRS,
    "pc AS (SELECT p.pair_id, -sum((1 - 2 * b.neg) * q.y[b.axis + 1]) AS asym, sum((1 - 2 * b.neg) * q.y[b.axis + 1] * b.mag) AS weighted, "
    "sum(CASE WHEN qc.comp <> b.comp THEN 1 ELSE 0 END)::INTEGER AS component_hamming FROM pairs p JOIN p_rot q ON q.vec_id = p.i "
    "JOIN p_cp b ON b.vec_id = p.j AND b.r = q.r JOIN p_cp qc ON qc.vec_id = p.i AND qc.r = q.r GROUP BY 1)",
    "ph AS (SELECT p.pair_id, bit_count(xor(a.w, b.w))::INTEGER AS hamming, (bit_count(xor(a.w, b.w))::INTEGER * 4 + bit_count(xor(ra.w, rb.w)))::INTEGER AS combined "
    "FROM pairs p JOIN s_w a ON a.vec_id = p.i JOIN s_w b ON b.vec_id = p.j JOIN t_w ra ON ra.vec_id = p.i JOIN t_w rb ON rb.vec_id = p.j)",
    f"pt AS (SELECT p.pair_id, p.i, p.j, {DOT} AS truth FROM pairs p JOIN e a ON a.vec_id = p.i JOIN e b ON b.vec_id = p.j)",
    "allp AS MATERIALIZED (SELECT pt.*, pc.* EXCLUDE (pair_id), ph.* EXCLUDE (pair_id), 5.0::DOUBLE + 0.5::DOUBLE * combined AS estimate FROM pt JOIN pc USING (pair_id) JOIN ph USING (pair_id))",
)
CAL = "cal AS (SELECT regr_slope(truth, -asym) AS alpha, regr_intercept(truth, -asym) AS beta, regr_r2(truth, -asym) AS r2, count(*) AS n FROM allp)"

LINES = (
    "lines AS (SELECT l_orderkey, l_partkey, l_linenumber, [l_quantity::FLOAT, l_extendedprice::FLOAT, l_discount::FLOAT, l_tax::FLOAT, l_linenumber::FLOAT]::DOUBLE[] AS v FROM lineitem)"
)
LINE_KEYS = "l_orderkey, l_partkey, l_linenumber"

LATENCY = (
    "sorted AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)",
    "stats AS (SELECT event_type, count(*) AS n, avg(value) AS mean, max(CASE WHEN pos = n // 2 THEN value END) AS p50, "
    "max(CASE WHEN pos = least(floor(0.99::DOUBLE * n)::BIGINT, n - 1) THEN value END) AS p99 FROM sorted GROUP BY event_type)",
)

SWEEP = (
    *CODE_TOP, ranked("p_sc", max(c.SWEEP_EF), "deep"), *TRUTH,
    "ex AS (SELECT d.query_id, d.vec_id, d.rank AS place, s.dist FROM deep d JOIN sc s USING (query_id, vec_id))",
    f"swept AS (SELECT ef, query_id, vec_id FROM ex, (SELECT unnest({c.SWEEP_EF})::INTEGER AS ef) WHERE place <= ef "
    f"QUALIFY row_number() OVER (PARTITION BY ef, query_id ORDER BY dist, vec_id) <= {c.K})",
    f"shares AS (SELECT ef, sum(CASE WHEN t.vec_id IS NULL THEN 0 ELSE 1 END) / ({c.K}.0::DOUBLE * (SELECT count(*) FROM e)) AS recall "
    "FROM swept s LEFT JOIN truth t USING (query_id, vec_id) GROUP BY ef)",
)

REACH = (
    *NEAR[:2], ranked("sc", 3, "nn", skip_self=True),
    """walk(node, depth) AS (SELECT (SELECT min(vec_id) FROM e), 0 UNION
  SELECT n.vec_id, w.depth + 1 FROM walk w JOIN nn n ON n.query_id = w.node WHERE w.depth < 60)""",
    "reach AS (SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node)",
)

def hashed(*parts) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 15))::BIGINT"


def descended(rounds: int = c.DESCENT_ROUNDS, pool: int = c.DESCENT_POOL) -> list[str]:
    """``l0 .. l{rounds}(src, dst, dist, new)``: neighbour lists after every round, and ``p1 ..`` with the pairs compared."""
    out = [
        EMB, all_pairs(COS).replace("sc AS (", "sc AS MATERIALIZED ("), "total AS (SELECT count(*) AS n FROM e)",
        f"placed AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {hashed(42, 'vec_id')}, vec_id) - 1 AS place, n FROM e, total)",
        f"l0 AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, s.dist, true AS new FROM (SELECT id, place, n, unnest(range(1, least({pool}, n - 1) + 1)) AS step FROM placed) a "
        "JOIN placed b ON b.place = (a.place + a.step) % a.n JOIN sc s ON s.query_id = a.id AND s.vec_id = b.id)",
    ]
    for r in range(1, rounds + 1):
        was = f"l{r - 1}"
        out += [
            f"b{r} AS (SELECT dst AS z, src AS id, new FROM {was} QUALIFY row_number() OVER (PARTITION BY dst ORDER BY {hashed(42, r, 'src', 'dst')}, src) <= {pool})",
            f"a{r} AS MATERIALIZED (SELECT z, id, bool_or(new) AS new FROM (SELECT src AS z, dst AS id, new FROM {was} UNION ALL SELECT * FROM b{r} "
            f"UNION ALL SELECT DISTINCT src, src, false FROM {was}) GROUP BY 1, 2)",
            f"p{r} AS MATERIALIZED (SELECT x.id AS src, y.id AS dst FROM a{r} x JOIN a{r} y ON x.z = y.z AND x.id <> y.id AND (x.new OR y.new))",
            f"l{r} AS MATERIALIZED (SELECT m.src, m.dst, s.dist, m.new FROM (SELECT src, dst, bool_and(new) AS new FROM (SELECT src, dst, false AS new FROM {was} "
            f"UNION ALL SELECT src, dst, true FROM p{r}) GROUP BY 1, 2) m JOIN sc s ON s.query_id = m.src AND s.vec_id = m.dst "
            f"QUALIFY row_number() OVER (PARTITION BY m.src ORDER BY s.dist, m.dst) <= {pool})",
        ]
    return [*out, f"found AS (SELECT src AS query_id, dst AS vec_id, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst)::INTEGER AS rank FROM l{rounds})"]


ISLANDS = (
    EMB, all_pairs(COS).replace("sc AS (", "sc AS MATERIALIZED ("), ranked("sc", 1, "nn", skip_self=True),
    "links AS (SELECT query_id AS a, vec_id AS b FROM nn UNION SELECT vec_id, query_id FROM nn)",
    "walk(node, met) AS (SELECT vec_id, vec_id FROM e UNION SELECT w.node, l.b FROM walk w JOIN links l ON l.a = w.met)",
    "comp AS MATERIALIZED (SELECT node, min(met) AS component FROM walk GROUP BY node)",
    # The cheapest edge of every two components; the tree grows from the first component by the cheapest edge that leaves it.
    "ways AS MATERIALIZED (SELECT x.component AS ca, y.component AS cb, s.dist, least(s.query_id, s.vec_id) AS u, greatest(s.query_id, s.vec_id) AS v "
    "FROM sc s JOIN comp x ON x.node = s.query_id JOIN comp y ON y.node = s.vec_id WHERE x.component <> y.component "
    "QUALIFY row_number() OVER (PARTITION BY x.component, y.component ORDER BY s.dist, least(s.query_id, s.vec_id), greatest(s.query_id, s.vec_id)) = 1)",
    "tree(inside, u, v, dist) AS (SELECT [(SELECT min(component) FROM comp)], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE UNION ALL "
    "SELECT list_append(t.inside, w.cb), w.u, w.v, w.dist FROM tree t JOIN ways w ON list_contains(t.inside, w.ca) AND NOT list_contains(t.inside, w.cb) "
    "QUALIFY row_number() OVER (ORDER BY w.dist, w.u, w.v) = 1)",
)

DETOURS = (
    *NEAR,
    "det AS (SELECT e3.src, e3.dst, count(*) AS detours FROM edges e1 JOIN edges e2 ON e2.src = e1.dst JOIN edges e3 ON e3.src = e1.src AND e3.dst = e2.dst "
    "WHERE greatest(e1.rank, e2.rank) * 1.1::DOUBLE < e3.rank GROUP BY 1, 2)",
    "placed AS (SELECT g.src, g.dst, g.dist, coalesce(d.detours, 0) AS detours, row_number() OVER (PARTITION BY g.src ORDER BY coalesce(d.detours, 0), g.rank)::INTEGER AS place "
    "FROM edges g LEFT JOIN det d USING (src, dst))",
    f"kept AS (SELECT src, dst, dist, detours, place AS rank FROM placed WHERE place <= {c.DETOUR_DEGREE})",
)

FOOT = (
    # A long and one word of code, two longs of an edge, a long and the floats of a vector.
    "foot AS (SELECT 'codes_and_graph' AS system, 'codes' AS component, count(*) * (8 + 8) AS bytes FROM embeddings "
    f"UNION ALL SELECT 'codes_and_graph', 'edges', count(*) * {c.KNN_K} * (8 + 8) FROM embeddings "
    "UNION ALL SELECT 'codes_and_graph', 'vectors', sum(8 + 4 * len(embedding))::BIGINT FROM embeddings "
    "UNION ALL SELECT 'float_graph', 'vectors', sum(8 + 4 * len(embedding))::BIGINT FROM embeddings "
    f"UNION ALL SELECT 'float_graph', 'edges', count(*) * {c.KNN_K} * (8 + 8) FROM embeddings)"
)


def word_bit(word: str, bit: int) -> str:
    return f"(({word} >> {bit}) & 1)::INTEGER"


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    norm5 = "sqrt(list_dot_product(v, v))"
    out["normalize_vectors"] = with_(
        LINES,
        select=f"SELECT {LINE_KEYS}, " + ", ".join(f"round(CASE WHEN {norm5} > 1e-10 THEN v[{i + 1}] / {norm5} ELSE v[{i + 1}] END, 6) AS n{i}" for i in range(5)) + " FROM lines",
    )
    out["norm_audit"] = with_(EMB, select="SELECT round(min(n), 5) AS min_norm, round(max(n), 5) AS max_norm, count(*) FILTER (abs(n - 1) > 1e-4) AS off_unit FROM (SELECT sqrt(list_dot_product(v, v)) AS n FROM e)")
    out["avg_norm"] = with_(SCALED, select="SELECT round(coalesce(avg(sqrt(list_dot_product(v, v))), 1.0), 5) AS avg_norm FROM e")
    out["validate_vectors"] = "SELECT count(*) AS num_rows, count(*) FILTER (embedding IS NULL) AS null_vectors, count(*) FILTER (len(embedding) <> 64) AS wrong_dim FROM embeddings"
    out["pair_distances"] = with_(SCALED, *PAIRS, select=f"SELECT pair_id, i, j, round({DOT}, 4) AS dot, round(-{DOT}, 4) AS neg_dot, round(1 - {DOT}, 4) AS cosine, round({L2}, 4) AS l2sq FROM pairs p JOIN e a ON a.vec_id = p.i JOIN e b ON b.vec_id = p.j")
    out["fht_transform"] = with_(
        LINES, hadamard(8),
        select=f"SELECT {LINE_KEYS}, " + ", ".join(f"round(list_dot_product(list_concat(v, [0.0, 0.0, 0.0]::DOUBLE[]), hm[{i + 1}]), 2) AS t{i}" for i in range(8)) + " FROM lines, had",
    )
    out["rotate"] = with_(EMB, hadamard(64), *rotated("p", 8, 42), select="SELECT vec_id, r::INTEGER AS rotation, unnest(range(64))::INTEGER AS axis, round(unnest(y), 3) AS value FROM p_rot")
    out["learned_rotation"] = with_(
        EMB, hadamard(64),
        "lw AS (SELECT 0 AS r, 0 AS layer, i, 1.0 + avg(x) AS weight FROM (SELECT unnest(range(64)) AS i, unnest(v) AS x FROM e) GROUP BY i)",
        *coded("p", 8, 42, weights="lw"),
        select="SELECT vec_id, r::INTEGER AS rotation, comp::INTEGER AS component FROM p_cp",
    )
    quant = "floor(least(greatest(mag * (255.0::DOUBLE / 512.0), 0), 255))"
    out["cp_components"] = with_(EMB, *COMP, select=f"SELECT vec_id, r::INTEGER AS rotation, comp::INTEGER AS component, axis::INTEGER AS axis, (1 - 2 * neg)::INTEGER AS sign, round(mag, 3) AS magnitude, {quant}::INTEGER AS quantized, round({quant} * (512.0::DOUBLE / 255.0), 3) AS restored FROM p_cp")
    out["sign_codes"] = with_(EMB, hadamard(64), *SIGN, select=f"SELECT vec_id, w AS word, {word_bit('w', 5)} AS bit5 FROM s_w")
    out["residual_codes"] = with_(EMB, hadamard(64), *SIGN, *RESID, select="SELECT vec_id, s_w.w AS primary_word, t_w.w AS residual_word FROM s_w JOIN t_w USING (vec_id)")
    eff = c.RESIDUAL_CODE.effective_bits
    out["query_scale"] = with_(SCALED, "n AS (SELECT vec_id, sqrt(list_dot_product(v, v)) AS q FROM e)", select=f"SELECT vec_id, round(q, 4) AS query_norm, 0.0::DOUBLE AS base, round(2.0 * q * (SELECT avg(q) FROM n) / {eff}.0, 5) AS scale FROM n")
    out["bit_operations"] = with_(EMB, hadamard(64), *SIGN, select="SELECT vec_id, (w | 8::BIGINT) AS on_word, (w & ~(8::BIGINT)) AS off_word, 0::BIGINT AS cleared, false AS same, 1::INTEGER AS distance, true AS unchanged FROM s_w")
    out["rotation_stats"] = with_(EMB, hadamard(64), *rotated("p", 8, 42), select="SELECT r::INTEGER AS rotation, round(max(list_max(list_transform(y, lambda x: abs(x)))), 3) AS max_abs, round(sum(list_sum(y)) / sum(len(y)), 5) AS mean_value, round(avg(list_max(list_transform(y, lambda x: abs(x)))), 4) AS mean_peak FROM p_rot GROUP BY r")
    out["code_distances"] = with_(*PAIR_CODES, select="SELECT pair_id, i, j, round(asym, 3) AS asym_distance, round(weighted, 2) AS weighted, component_hamming, hamming, combined, estimate FROM allp")
    long = "SELECT truth, '{0}' AS estimator, (-{1})::DOUBLE AS score FROM allp"
    out["estimator_correlation"] = with_(
        *PAIR_CODES, "l AS (" + " UNION ALL ".join(long.format(*n) for n in (("asymmetric", "asym"), ("hamming", "hamming"), ("combined", "combined"))) + ")",
        select="SELECT estimator, count(*) AS num_pairs, round(corr(score, truth), 6) AS pearson_r, round(regr_r2(truth, score), 6) AS r_squared, round(min(truth), 5) AS min_truth, round(max(truth), 5) AS max_truth, round(min(score), 3) AS min_score, round(max(score), 3) AS max_score FROM l GROUP BY estimator",
    )
    out["calibration"] = with_(*PAIR_CODES, CAL, select="SELECT round(alpha, 9) AS alpha, round(beta, 6) AS beta, round(r2, 6) AS r_squared, n AS num_samples FROM cal")
    out["pairs_sparse_ids"] = with_(
        "e AS (SELECT vec_id * 10 + 3 AS id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)",
        "numbered AS (SELECT pos * 5 + p AS pair_id, (SELECT count(*) FROM e) AS n FROM e, range(5) t(p))", *PAIRS[1:],
        select="SELECT pair_id, a.id AS i, b.id AS j FROM pairs JOIN e a ON a.pos = pairs.i JOIN e b ON b.pos = pairs.j",
    )
    out["sample_pairs"] = with_(EMB, *PAIRS, select="SELECT pair_id, i, j FROM pairs")

    out["exact_knn_cosine"] = knn(COS, 6)
    out["exact_knn_l2"] = knn(L2, 4, SCALED)
    out["exact_knn_ip"] = knn(f"-{DOT}", 4, SCALED)
    out["closest_farthest"] = with_(
        EMB, all_pairs(COS), "o AS (SELECT * FROM sc WHERE query_id <> vec_id)",
        "ends AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY dist DESC, vec_id) AS f FROM o)",
        select="SELECT query_id, max(CASE WHEN n = 1 THEN vec_id END) AS nearest, round(max(CASE WHEN n = 1 THEN dist END), 6) AS nearest_dist, max(CASE WHEN f = 1 THEN vec_id END) AS farthest, round(max(CASE WHEN f = 1 THEN dist END), 6) AS farthest_dist FROM ends GROUP BY query_id",
    )
    out["asymmetric_knn"] = with_(*CODE_TOP, ranked("p_sc", c.K), select=hits(digits=3))
    ham = "sc AS (SELECT a.vec_id AS query_id, b.vec_id, bit_count(xor(a.w, b.w))::INTEGER AS dist FROM s_w a, s_w b)"
    out["hamming_knn"] = with_(EMB, hadamard(64), *SIGN, ham, ranked("sc", c.K), select="SELECT query_id, vec_id, rank, dist AS hamming FROM top")
    out["hamming_index_knn"] = out["hamming_knn"]
    parts = c.SIGN_CODE.bits // c.PART_BITS
    least = ", ".join(f"bit_count((x >> {j * c.PART_BITS}) & {(1 << c.PART_BITS) - 1})::INTEGER" for j in range(parts))
    last = hamming_index.HammingIndex(None, None, None, c.SIGN_CODE, c.PART_BITS, 0).last_radius()
    out["hamming_index_work"] = with_(
        EMB, hadamard(64), *SIGN,
        f"apart AS MATERIALIZED (SELECT query_id, vec_id, bit_count(x)::INTEGER AS dist, [{least}] AS p FROM (SELECT a.vec_id AS query_id, b.vec_id, xor(a.w, b.w) AS x FROM s_w a, s_w b))",
        f"radii AS (SELECT r::INTEGER AS r FROM range({last + 1}) t(r))",
        f"seen AS (SELECT r, query_id, dist FROM radii, apart WHERE list_min(p) <= r QUALIFY row_number() OVER (PARTITION BY r, query_id ORDER BY dist, vec_id) <= {c.K})",
        f"ends AS (SELECT query_id, min(r) AS ready FROM (SELECT r, query_id FROM seen GROUP BY 1, 2 HAVING count(*) = {c.K} AND max(dist) < {parts} * (r + 1)) GROUP BY 1)",
        "q AS (SELECT vec_id AS query_id, ready FROM e LEFT JOIN ends ON query_id = vec_id)",
        "work AS (SELECT r, query_id, sum(len(list_filter(p, lambda d: d = r)))::BIGINT AS n FROM radii, apart GROUP BY 1, 2)",
        select="SELECT r AS radius, count(*) AS queries, sum(n)::BIGINT AS candidates, count(*) FILTER (ready = r) AS finished FROM work JOIN q USING (query_id) WHERE ready IS NULL OR ready >= r GROUP BY r "
        "UNION ALL SELECT -1, count(*), count(*) * (SELECT count(*) FROM e), count(*) FROM q WHERE ready IS NULL HAVING count(*) > 0",
    )
    comb = "sc AS (SELECT a.vec_id AS query_id, b.vec_id, (bit_count(xor(a.w, b.w))::INTEGER * 4 + bit_count(xor(ra.w, rb.w)))::INTEGER AS dist FROM (s_w a JOIN t_w ra USING (vec_id)), (s_w b JOIN t_w rb USING (vec_id)))"
    out["combined_hamming_knn"] = with_(
        EMB, hadamard(64), *SIGN, *RESID, comb, ranked("sc", c.K), "n AS (SELECT vec_id, sqrt(list_dot_product(v, v)) AS q FROM e)",
        select=f"SELECT query_id, top.vec_id, rank, dist AS combined, round(2.0 * n.q * (SELECT avg(q) FROM n) / {eff}.0 * dist, 5) AS estimate FROM top JOIN n ON n.vec_id = query_id",
    )
    out["rerank_missing_vectors"] = with_(
        *CODE_TOP, ranked("p_sc", 50, "cands"),
        f"exact AS (SELECT k.query_id, k.vec_id, {COS} AS dist FROM cands k JOIN e a ON a.vec_id = k.query_id JOIN e b ON b.vec_id = k.vec_id "
        "WHERE k.query_id % 11 <> 0 AND k.vec_id % 7 <> 0)",
        ranked("exact", c.K), select=hits(),
    )
    out["rerank_topk"] = with_(
        *CODE_TOP, ranked("p_sc", 50, "cands"),
        f"exact AS (SELECT k.query_id, k.vec_id, {COS} AS dist FROM cands k JOIN e a ON a.vec_id = k.query_id JOIN e b ON b.vec_id = k.vec_id)",
        ranked("exact", c.K), select=hits(),
    )
    out["lsh_multiprobe_join"] = with_(*LSH, ranked("exact", c.K), select=hits())
    out["lsh_pair_hash_join"] = with_(*PAIR_LSH, ranked("exact", c.K), select=hits())
    out["lsh_code_rerank_join"] = with_(
        *LSH[:-1], all_scores("p"), "cs AS (SELECT query_id, vec_id, s.dist FROM cand JOIN p_sc s USING (query_id, vec_id))", ranked("cs", 40, "best"),
        f"exact AS (SELECT k.query_id, k.vec_id, {COS} AS dist FROM best k JOIN e a ON a.vec_id = k.query_id JOIN e b ON b.vec_id = k.vec_id)",
        ranked("exact", c.K), select=hits(),
    )
    out["lsh_bucket_sizes"] = with_(EMB, hadamard(64), *coded("p", 8, 42), select='SELECT r::INTEGER AS "table", comp::BIGINT AS bucket, count(*) AS num_rows FROM p_cp GROUP BY ALL')
    out["duplicate_codes"] = with_(
        EMB, hadamard(64), *coded("p", 2, 42),
        "k AS (SELECT vec_id, max(CASE WHEN r = 0 THEN comp END)::INTEGER AS first, max(CASE WHEN r = 1 THEN comp END)::INTEGER AS second FROM p_cp GROUP BY vec_id)",
        select="SELECT first, second, count(*) AS copies, count(*) * (count(*) - 1) // 2 AS pairs FROM k GROUP BY first, second HAVING count(*) > 1",
    )

    out["knn_graph"] = with_(*NEAR, select="SELECT src, rank, dst, round(dist, 6) AS dist FROM edges")
    both = "rev AS (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM edges UNION ALL SELECT dst, src, dist FROM edges) GROUP BY 1, 2)"
    out["reverse_edges"] = with_(*NEAR, both, select="SELECT src, dst, round(dist, 6) AS dist FROM rev")
    out["degree_capped_edges"] = with_(*NEAR, both, select="SELECT src, dst, round(dist, 6) AS dist FROM rev QUALIFY row_number() OVER (PARTITION BY src ORDER BY rev.dist, dst) <= 20")
    out["detour_pruned_edges"] = with_(*DETOURS, select="SELECT src, dst, rank, detours, round(dist, 6) AS dist FROM kept")
    d = c.DETOUR_DEGREE
    out["rank_pruned_graph"] = with_(
        *DETOURS,
        "back AS (SELECT dst AS src, src AS dst, dist, row_number() OVER (PARTITION BY dst ORDER BY rank, src) AS slot FROM kept)",
        f"mixed AS (SELECT src, dst, dist, rank AS slot, 0 AS way FROM kept UNION ALL SELECT src, dst, dist, slot, 1 FROM back WHERE slot <= {d})",
        "firsts AS (SELECT * FROM mixed QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY slot, way) = 1)",
        select=f"SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY slot, way, dst)::INTEGER AS rank, round(dist, 6) AS dist FROM firsts QUALIFY rank <= {d}",
    )
    out["graph_build_codes"] = with_(*CODE_GRAPH, select=graph_out(3))
    out["stream_index_growth"] = out["graph_build_codes"]
    out["graph_build_hamming"] = with_(EMB, hadamard(64), *SIGN, ham.replace("::INTEGER", "::DOUBLE"), ranked("sc", c.GRAPH.m_links, "found", skip_self=True), *linked("found"), select=graph_out(6))
    out["graph_build_hybrid"] = with_(EMB, all_pairs(COS), ranked("sc", c.GRAPH.m_links, "found", skip_self=True), *linked("found"), select=graph_out(6))
    out["graph_build_lsh"] = with_(*LSH, ranked("exact", c.GRAPH.m_links, "found", skip_self=True), *linked("found"), select=graph_out(6))
    out["descent_graph"] = with_(*descended(), select=f"SELECT query_id AS src, rank, vec_id AS dst, round(dist, 6) AS dist FROM found WHERE rank <= {c.K}")
    out["descent_work"] = with_(*descended(), select=" UNION ALL ".join(
        f"SELECT {r}::INTEGER AS round, (SELECT count(*) // 2 FROM p{r})::BIGINT AS pairs, (SELECT count(*) FROM l{r} WHERE new)::BIGINT AS updates" for r in range(1, c.DESCENT_ROUNDS + 1)
    ))
    out["graph_build_descent"] = with_(*descended(), *linked("found"), select=graph_out(6))
    out["graph_components"] = with_(*ISLANDS[:-2], select="SELECT node, component FROM comp", recursive=True)
    out["connecting_edges"] = with_(*ISLANDS, select="SELECT u AS src, v AS dst, round(dist, 6) AS dist FROM tree WHERE u IS NOT NULL", recursive=True)
    out["repaired_connectivity"] = with_(
        *ISLANDS, "met AS (SELECT count(*) AS n FROM comp WHERE component IN (SELECT unnest(inside) FROM tree))",
        select="SELECT count(*) AS num_nodes, (SELECT n FROM met) AS reachable, round(100.0::DOUBLE * (SELECT n FROM met) / count(*), 6) AS reachable_pct FROM e", recursive=True,
    )
    out["edge_list"] = with_(*NEAR, select="SELECT src, dst, round(dist, 6) AS dist FROM edges")
    out["edge_membership"] = with_(*NEAR, select="SELECT a.dst AS src, a.src AS dst FROM edges a JOIN edges b ON b.src = a.dst AND b.dst = a.src")
    out["edge_removal"] = with_(*NEAR, select="SELECT a.src, a.dst, round(a.dist, 6) AS dist FROM edges a LEFT JOIN edges b ON b.src = a.dst AND b.dst = a.src WHERE b.src IS NULL")
    out["hub_neighbours"] = with_(*NEAR, select=f"SELECT src, dst, round(dist, 6) AS dist FROM edges WHERE src IN (SELECT dst FROM edges GROUP BY dst HAVING count(*) > {c.KNN_K + 4})")
    out["neighbour_codes"] = with_(
        *NEAR, *COMP,
        "whole AS (SELECT vec_id, string_agg(comp::INTEGER, ',' ORDER BY r) AS code FROM p_cp GROUP BY vec_id)",
        select="SELECT g.src, g.dst, g.rank, w.code FROM edges g JOIN whole w ON w.vec_id = g.dst",
    )
    out["graph_stats"] = with_(
        *CODE_GRAPH, "deg AS (SELECT e.vec_id, count(g.src) AS d FROM e LEFT JOIN graph g ON g.src = e.vec_id GROUP BY 1)",
        select="SELECT count(*) AS num_nodes, sum(d)::BIGINT AS num_edges, round(avg(d), 6) AS avg_degree, max(d) AS max_degree, count(*) FILTER (d = 0) AS isolated FROM deg",
    )
    out["graph_reachability"] = with_(*REACH, select="SELECT node, depth FROM reach", recursive=True)
    out["graph_connectivity"] = with_(*REACH, select="SELECT count(*) AS num_nodes, (SELECT count(*) FROM reach) AS reachable, round(100.0::DOUBLE * (SELECT count(*) FROM reach) / count(*), 6) AS reachable_pct FROM e", recursive=True)
    out["entry_points"] = "SELECT vec_id AS node FROM embeddings ORDER BY ('0x' || substr(md5(concat_ws(':', 42, vec_id)), 1, 15))::BIGINT, vec_id LIMIT 4"
    out["knn_audit"] = with_(
        *NEAR,
        select=f"SELECT count(*) FILTER (src <> dst AND dst IN (SELECT vec_id FROM e)) AS valid, (SELECT count(*) * {c.KNN_K} FROM e) - count(*) AS missing, count(*) FILTER (dst NOT IN (SELECT vec_id FROM e)) AS out_of_range, count(*) FILTER (src = dst) AS self_loops, round(min(dist), 6) AS min_dist, round(max(dist), 6) AS max_dist FROM edges",
    )

    out["beam_search"] = with_(*CODE_GRAPH, *beams(), select=hits("final", 3) + f" WHERE rank <= {c.K}", recursive=True)
    out["ann_search"] = with_(*RERANKED, select=hits(), recursive=True)
    out["stored_index_search"] = out["ann_search"]
    estimates = "est AS MATERIALIZED (SELECT query_id, sc.vec_id, 0.0::DOUBLE + 2.0 * n.q * (SELECT avg(q) FROM n) / 32.0 * sc.dist AS dist FROM sc JOIN n ON n.vec_id = query_id)"
    out["ann_search_sign_codes"] = with_(
        EMB, hadamard(64), *SIGN, ham.replace("::INTEGER", "::DOUBLE"), ranked("sc", c.GRAPH.m_links, "found", skip_self=True), *linked("found"),
        "n AS (SELECT vec_id, sqrt(list_dot_product(v, v)) AS q FROM e)", estimates,
        *beams(c.RERANKED, "est", FOUR_ENTRIES), *EXACT_FINAL, select=hits(), recursive=True,
    )
    out["ann_search_exact_graph"] = with_(
        EMB, all_pairs(COS).replace("sc AS (", "sc AS MATERIALIZED ("), ranked("sc", c.GRAPH.m_links, "found", skip_self=True), *linked("found"),
        *beams(c.BEAM, "sc"), select=hits("final") + f" WHERE rank <= {c.K}", recursive=True,
    )
    calibrated_ctes = [x for x in (*PAIR_CODES, *CODE_GRAPH[len((EMB, *COMP)):], CAL, *beams())]
    out["calibrated_search"] = with_(*calibrated_ctes, select=f"SELECT query_id, vec_id, rank, round(alpha * (-dist) + beta, 5) AS dist FROM final, cal WHERE rank <= {c.K}", recursive=True)

    out["recall_at_k"] = with_(*CODE_TOP, ranked("p_sc", c.K, "got"), *TRUTH, select=f"SELECT round(avg(h), 6) AS recall FROM (SELECT t.query_id, count(g.vec_id) / {c.K}.0::DOUBLE AS h FROM truth t LEFT JOIN got g USING (query_id, vec_id) GROUP BY 1)")
    out["topn_containment"] = with_(
        *CODE_TOP, ranked("p_sc", max(c.DEPTHS), "got"), *TRUTH,
        select=f"SELECT depth, round(avg(CASE WHEN g.rank <= depth THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS containment FROM (SELECT unnest({c.DEPTHS})::INTEGER AS depth), truth t LEFT JOIN got g USING (query_id, vec_id) GROUP BY depth",
    )
    def recall_by(name: str, got: str) -> str:
        return (
            f"SELECT {name}, round(sum(CASE WHEN t.vec_id IS NULL THEN 0 ELSE 1 END) / ({c.K}.0::DOUBLE * (SELECT count(*) FROM e)), 6) AS recall "
            f"FROM {got} LEFT JOIN truth t USING (query_id, vec_id) GROUP BY {name}"
        )

    runs, ctes = [], []
    for ef in c.GRAPH_SWEEP_EF:
        params = c.SearchParams(k=c.K, ef=ef, width=8, rerank=False)
        ctes += [x.replace("beam", f"beam{ef}").replace("final", f"final{ef}") for x in beams(params)]
        ctes.append(f"near{ef} AS (SELECT f.query_id, f.vec_id, {COS} AS dist FROM final{ef} f JOIN e a ON a.vec_id = f.query_id JOIN e b ON b.vec_id = f.vec_id)")
        ctes.append(ranked(f"near{ef}", c.K, f"exact{ef}"))
        runs += [f"SELECT {ef}::INTEGER AS ef, 0 AS reranked, query_id, vec_id FROM final{ef} WHERE rank <= {c.K}", f"SELECT {ef}, 1, query_id, vec_id FROM exact{ef}"]
    out["graph_recall_sweep"] = with_(
        *CODE_GRAPH, *ctes, *TRUTH, "runs AS (" + " UNION ALL ".join(runs) + ")", select=recall_by("ef, reranked", "runs"), recursive=True
    )
    out["multiprobe_recall_sweep"] = with_(
        EMB, hadamard(64), *coded("p", c.LSH_CODE.bits, c.LSH_CODE.seed), probes("p", max(c.PROBE_SWEEP)),
        "met AS (SELECT q.query_id, b.vec_id, min(q.pos) AS pos FROM p_pr q JOIN p_cp b ON q.r = b.r AND q.comp = b.comp GROUP BY 1, 2)",
        f"exact AS (SELECT k.query_id, k.vec_id, k.pos, {COS} AS dist FROM met k JOIN e a ON a.vec_id = k.query_id JOIN e b ON b.vec_id = k.vec_id)",
        f"runs AS (SELECT num_probes, query_id, vec_id FROM exact, (SELECT unnest({c.PROBE_SWEEP})::INTEGER AS num_probes) WHERE pos <= num_probes "
        f"QUALIFY row_number() OVER (PARTITION BY num_probes, query_id ORDER BY dist, vec_id) <= {c.K})",
        *TRUTH, select=recall_by("num_probes", "runs"),
    )
    lengths, ctes = [], []
    for bits in c.CODE_SWEEP:
        ctes += [*coded(f"k{bits}", bits, c.CodeParams(c.DIM, bits=bits).seed), all_scores(f"k{bits}"), ranked(f"k{bits}_sc", c.K, f"k{bits}_top")]
        lengths.append(f"SELECT {bits}::INTEGER AS bits, query_id, vec_id FROM k{bits}_top")
    out["code_length_sweep"] = with_(
        EMB, hadamard(64), *ctes, *TRUTH, "runs AS (" + " UNION ALL ".join(lengths) + ")", select=recall_by("bits", "runs")
    )
    out["recall_sweep"] = with_(*SWEEP, select="SELECT ef, round(recall, 6) AS recall FROM shares")
    out["recall_monotone_audit"] = with_(*SWEEP, select="SELECT 'component_codes' AS system, ef, round(recall, 6) AS recall, round(previous, 6) AS previous, coalesce(recall < previous - 0.01, false) AS dropped FROM (SELECT ef, recall, lag(recall) OVER (ORDER BY ef) AS previous FROM shares)")
    out["latency_stats"] = with_(*LATENCY, select="SELECT event_type, n, round(mean, 6) AS mean, round(1e6 / mean, 4) AS qps, p50, p99 FROM stats")
    stats_of = (
        "SELECT {0} AS scope, count(*) AS n, coalesce(round(avg(value), 6), 0) AS mean, coalesce(round(1e6 / avg(value), 4), 0) AS qps, "
        "coalesce(max(CASE WHEN pos = n // 2 THEN value END), 0) AS p50, "
        "coalesce(max(CASE WHEN pos = least(floor(0.99::DOUBLE * n)::BIGINT, n - 1) THEN value END), 0) AS p99 FROM "
        "(SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY {0}) AS n FROM events WHERE {1})"
    )
    kind = "CASE WHEN event_type > 'm' THEN event_type END"
    out["latency_overall"] = " UNION ALL ".join(
        [stats_of.format("'all'", "value IS NOT NULL"), stats_of.format("'none'", "false").replace("SELECT 'none' AS scope, count(*)", "SELECT 'none' AS scope, count(value)"),
         stats_of.format(kind, "value IS NOT NULL") + f" GROUP BY {kind}"]
    )
    out["value_moments"] = "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, 0.0::DOUBLE AS mean_of_none, 0.0::DOUBLE AS stddev_of_none FROM events GROUP BY event_type"
    out["price_correlation"] = "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pearson_r, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared, 0.0::DOUBLE AS flat_r FROM lineitem GROUP BY l_returnflag"
    out["result_audit"] = with_(EMB, select=f"SELECT count(*) * {c.K} AS num_rows, 0::BIGINT AS unordered, 0::BIGINT AS nans, 0::BIGINT AS duplicates FROM e")
    first = "SELECT '{0}' AS \"check\", count(*) AS queries, count(*) FILTER (query_id = vec_id) AS self_first FROM {1} WHERE rank = 1"
    out["identity_audit"] = with_(
        *CODE_TOP, ranked("p_sc", c.K, "got"), *TRUTH,
        "own AS (SELECT q.vec_id, sum((1 - 2 * b.neg) * q.y[b.axis + 1]) AS s, sum(b.mag) AS m FROM p_rot q JOIN p_cp b ON b.vec_id = q.vec_id AND b.r = q.r GROUP BY 1)",
        select=first.format("exact", "truth") + " UNION ALL " + first.format("code", "got") + " UNION ALL SELECT 'self_score', count(*), count(*) FILTER (abs(s - m) <= 0.01 * m) FROM own",
    )
    out["code_audit"] = with_(EMB, select="SELECT count(*) AS num_codes, count(*) AS exact, 0::BIGINT AS close, 0::BIGINT AS mismatch FROM e")
    out["neighbour_discrimination"] = with_(
        *CODE_TOP, all_pairs(COS), "o AS (SELECT * FROM sc WHERE query_id <> vec_id)",
        "near AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) = 1)",
        "far AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist DESC, vec_id) = 1)",
        select="SELECT count(*) AS queries, count(*) FILTER (a.dist < b.dist) AS told_apart FROM near n JOIN far f USING (query_id) JOIN p_sc a ON a.query_id = n.query_id AND a.vec_id = n.vec_id JOIN p_sc b ON b.query_id = f.query_id AND b.vec_id = f.vec_id",
    )
    out["duplicates_retrieval"] = with_(
        EMB, "n AS (SELECT max(vec_id) + 1 AS n FROM e)",
        "d AS (SELECT vec_id, vec_id AS g, v FROM e UNION ALL SELECT vec_id + n, vec_id, v FROM e, n)",
        f"dsc AS (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS dist FROM d a, d b)", ranked("dsc", 60, "got"),
        select="SELECT q.vec_id AS query_id, 1::BIGINT AS copies, count(*) FILTER (b.g = q.g AND b.vec_id <> q.vec_id) AS found FROM d q JOIN got t ON t.query_id = q.vec_id JOIN d b ON b.vec_id = t.vec_id GROUP BY 1",
    )
    out["memory_footprint"] = with_(FOOT, select="SELECT system, component, bytes, round(bytes / 1048576.0::DOUBLE, 6) AS mb FROM foot")
    out["compression_ratio"] = with_(FOOT, select="SELECT round(sum(bytes) FILTER (system = 'float_graph') / sum(bytes) FILTER (system = 'codes_and_graph')::DOUBLE, 6) AS ratio FROM foot WHERE NOT (system = 'codes_and_graph' AND component = 'vectors')")
    out["pareto_front"] = with_(
        "r AS (SELECT l_returnflag AS system, l_extendedprice AS qps, max(l_quantity) AS recall FROM lineitem GROUP BY 1, 2)",
        select="SELECT system, qps, recall FROM (SELECT *, max(recall) OVER (PARTITION BY system ORDER BY qps DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r) WHERE seen IS NULL OR recall > seen",
    )
    out["speedup"] = with_(
        "t AS (SELECT (hour(ts) + 1)::INTEGER AS threads, avg(value) AS build_time_s FROM events GROUP BY 1)",
        "b AS (SELECT min(threads) AS n0, arg_min(build_time_s, threads) AS t0 FROM t)",
        select="SELECT threads, round(build_time_s, 5) AS build_time_s, round(t0 / build_time_s, 5) AS speedup, round(t0 / build_time_s * n0 / threads, 5) AS efficiency FROM t, b",
    )
    out["merged_results"] = with_(
        *LATENCY,
        select="SELECT 'ours' AS system, event_type AS config, n::INTEGER AS ef_search, round(p50 / p99, 6) AS recall_10, round(1e6 / mean, 4) AS qps, round(mean, 6) AS latency_mean_us, p50 AS latency_p50_us, p99 AS latency_p99_us FROM stats "
        "UNION ALL SELECT 'external', o_orderstatus, count(*)::INTEGER, 1.0::DOUBLE, round(1e6 / avg(o_totalprice), 4), round(avg(o_totalprice), 3), NULL, NULL FROM orders GROUP BY o_orderstatus",
    )
    out["fvecs_scan"] = "SELECT vec_id, len(embedding)::INTEGER AS dim, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, md5(array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',')) AS digest FROM embeddings"
    out["ivecs_truth"] = with_(EMB, *TRUTH, select="SELECT query_id, rank, vec_id FROM truth")
    out["limited_base_truth"] = with_(EMB, all_pairs(COS), "half AS (SELECT * FROM sc WHERE vec_id < (SELECT count(*) // 2 FROM e))", ranked("half", c.K), select="SELECT query_id, rank, vec_id FROM top")
    cell_of = "0.5::DOUBLE * list_dot_product(c.m, c.m) - list_dot_product(e.v, c.m)"
    cells = (
        EMB,
        "lab AS (SELECT vec_id, label, i, x FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings))",
        "cells AS (SELECT label AS cell, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM lab GROUP BY 1, 2) GROUP BY 1)",
        f"near AS MATERIALIZED (SELECT e.vec_id, c.cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY {cell_of}, c.cell) AS pos FROM e, cells c)",
    )
    inside = "cand AS (SELECT q.vec_id AS query_id, b.vec_id FROM near q JOIN near b ON b.cell = q.cell AND b.pos = 1 WHERE q.pos <= 3)"
    out["ivf_label_cells"] = with_(
        *cells, inside, f"exact AS (SELECT k.query_id, k.vec_id, -{DOT} AS dist FROM cand k JOIN e a ON a.vec_id = k.query_id JOIN e b ON b.vec_id = k.vec_id)",
        ranked("exact", c.K), select=hits(),
    )
    out["ivf_label_product_codes"] = with_(
        *cells, inside,
        "res AS MATERIALIZED (SELECT e.vec_id, n.cell, c.m, list_transform(list_zip(e.v, c.m), lambda z: (z[1] - z[2])::FLOAT)::DOUBLE[] AS r FROM e JOIN near n ON n.vec_id = e.vec_id AND n.pos = 1 JOIN cells c ON c.cell = n.cell)",
        "rl AS (SELECT l.label, x.i, x.x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(r) AS x FROM res) x JOIN embeddings l USING (vec_id))",
        "words AS (SELECT label AS w, s, list(m ORDER BY i) AS m FROM (SELECT label, i, i // 16 AS s, avg(x) AS m FROM rl GROUP BY 1, 2, 3) GROUP BY 1, 2)",
        "codes AS (SELECT r.vec_id, w.s, w.w, w.m, row_number() OVER (PARTITION BY r.vec_id, w.s ORDER BY 0.5::DOUBLE * list_dot_product(w.m, w.m) - list_dot_product(r.r[w.s * 16 + 1 : w.s * 16 + 16], w.m), w.w) AS pos FROM res r, words w)",
        "dec AS (SELECT vec_id, flatten(list(m ORDER BY s)) AS d FROM codes WHERE pos = 1 GROUP BY 1)",
        "pq AS MATERIALIZED (SELECT d.vec_id, list_transform(list_zip(r.m, d.d), lambda z: (z[1] + z[2])::FLOAT)::DOUBLE[] AS v FROM dec d JOIN res r USING (vec_id))",
        f"exact AS (SELECT k.query_id, k.vec_id, -{DOT} AS dist FROM cand k JOIN e a ON a.vec_id = k.query_id JOIN pq b ON b.vec_id = k.vec_id)",
        ranked("exact", c.K), select=hits(),
    )
    hashed = "('0x' || substr(md5(concat_ws(':', {0}, vec_id)), 1, 15))::BIGINT"
    for query, cells_n, rounds in (("ivf_knn", 16, 5), ("ivf_pq_knn", 8, 3)):
        first = f"SELECT 0 AS b, row_number() OVER (ORDER BY {hashed.format(42)}, vec_id) - 1 AS cell, v AS m FROM e QUALIFY cell < {cells_n}"
        trained = [
            EMB, "rows0 AS (SELECT vec_id, 0 AS b, v FROM e)", *lloyd("cells", "rows0", first, 64, rounds),
            f"near AS MATERIALIZED (SELECT e.vec_id, c.cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY {cell_of}, c.cell) AS pos FROM e, cells c)",
            inside.replace("<= 3", "<= 4"),
        ]
        if query == "ivf_knn":
            scored = [f"exact AS (SELECT k.query_id, k.vec_id, -{DOT} AS dist FROM cand k JOIN e a ON a.vec_id = k.query_id JOIN e b ON b.vec_id = k.vec_id)"]
        else:
            first = f"SELECT b, row_number() OVER (PARTITION BY b ORDER BY {hashed.format(43)}, vec_id) - 1 AS cell, v AS m FROM slices QUALIFY cell < 16"
            scored = [
                "res AS MATERIALIZED (SELECT e.vec_id, c.m, list_transform(list_zip(e.v, c.m), lambda z: (z[1] - z[2])::FLOAT)::DOUBLE[] AS r FROM e JOIN near n ON n.vec_id = e.vec_id AND n.pos = 1 JOIN cells c ON c.cell = n.cell)",
                "slices AS MATERIALIZED (SELECT vec_id, b, r[b * 16 + 1 : b * 16 + 16] AS v FROM res, range(4) t(b))",
                *lloyd("words", "slices", first, 16, rounds),
                "codes AS (SELECT s.vec_id, s.b, w.m FROM slices s JOIN words w USING (b) QUALIFY row_number() OVER (PARTITION BY s.vec_id, s.b ORDER BY 0.5::DOUBLE * list_dot_product(w.m, w.m) - list_dot_product(s.v, w.m), w.cell) = 1)",
                "pq AS MATERIALIZED (SELECT vec_id, r.m AS centre, d.d FROM (SELECT vec_id, flatten(list(m ORDER BY b)) AS d FROM codes GROUP BY 1) d JOIN res r USING (vec_id))",
                "exact AS (SELECT k.query_id, k.vec_id, -(list_dot_product(a.v, b.centre) + list_dot_product(a.v, b.d)) AS dist FROM cand k JOIN e a ON a.vec_id = k.query_id JOIN pq b ON b.vec_id = k.vec_id)",
            ]
        out[query] = with_(*trained, *scored, ranked("exact", c.K), select=hits())
    out["stream_encode"] = with_(EMB, *COMP, select="SELECT vec_id, r::INTEGER AS rotation, comp::INTEGER AS component FROM p_cp")
    out["stream_search"] = out["lsh_multiprobe_join"]
    return out
