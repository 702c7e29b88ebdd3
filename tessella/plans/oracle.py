"""DuckDB SQL for the named queries, written from the formulas and not from the plans."""

from __future__ import annotations

from ..functions import blocks

_VALUE = {
    "grey": "CAST(greatest(0, least(255, floor(128 + 512 * CAST(v AS DOUBLE)))) AS BIGINT)",
    "binary": "CASE WHEN v < 0 THEN 0 ELSE 255 END",
    "sparse": "CASE WHEN v < -0.25 THEN 0 ELSE 255 END",
}


def px(variant: str = "grey", name: str = "px") -> str:
    """CTE of pixels: img_id, y, x, v."""
    return f"""{name} AS (SELECT vec_id AS img_id, (p - 1) // 8 AS y, (p - 1) % 8 AS x, CAST({_VALUE[variant]} AS BIGINT) AS v
    FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings))"""


SUMS = "CAST(sum(v * (y * {w} + x + 1)) AS BIGINT) AS checksum, CAST(sum(v) AS BIGINT) AS total"
PAIR = "pr AS (SELECT a.img_id // 2 AS pair_id, a.y, a.x, a.v AS a, b.v AS b FROM px a JOIN px b ON a.img_id % 2 = 0 AND b.img_id = a.img_id + 1 AND a.y = b.y AND a.x = b.x)"
TRIPLE = "tr AS (SELECT a.img_id // 3 AS pair_id, a.y, a.x, a.v AS a, b.v AS b, c.v AS c FROM px a JOIN px b ON a.img_id % 3 = 0 AND b.img_id = a.img_id + 1 AND a.y = b.y AND a.x = b.x JOIN px c ON c.img_id = a.img_id + 2 AND c.y = a.y AND c.x = a.x)"

#: Source row and column of pixel (i, j) of an n x n block under transform ti.
def gather(ti: str, i: str, j: str, n: int) -> tuple[str, str]:
    mi, mj = f"({n - 1} - {i})", f"({n - 1} - {j})"
    row = [i, j, mi, mj, i, mi, mj, j]
    col = [j, mi, mj, i, mj, j, mi, i]
    case = lambda xs: f"CASE {ti} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(xs)) + " END"
    return case(row), case(col)


def _kernel(values, name: str = "kern") -> str:
    k = len(values)
    rows = ", ".join(f"({a - k // 2}, {b - k // 2}, {float(values[a][b])!r})" for a in range(k) for b in range(k))
    return f"{name}(ky, kx, wt) AS (SELECT ky, kx, CAST(wt AS DOUBLE) FROM (VALUES {rows}) AS t(ky, kx, wt))"


def _correlated(source: str, kernels: dict[str, str], key: str = "img_id") -> str:
    """img_id, y, x and one sum per kernel; outside is 255."""
    return f"SELECT p.{key}, p.y, p.x, p.v, " + ", ".join(f"sum({k}.wt * coalesce(q.v, 255)) AS {n}" for n, k in kernels.items()) + f" FROM {source} p CROSS JOIN {next(iter(kernels.values()))}" + "".join(f" JOIN {k} ON {k}.ky = {next(iter(kernels.values()))}.ky AND {k}.kx = {next(iter(kernels.values()))}.kx" for k in list(kernels.values())[1:]) + f" LEFT JOIN {source} q ON q.{key} = p.{key} AND q.y = p.y + {next(iter(kernels.values()))}.ky AND q.x = p.x + {next(iter(kernels.values()))}.kx GROUP BY ALL"


_SOBEL_V = (-blocks.SOBEL.T).tolist()
EDGES = f"""{_kernel(blocks.SOBEL.tolist(), 'kh')}, {_kernel(_SOBEL_V, 'kv')},
both_ AS ({_correlated('px', {'gx': 'kh', 'gy': 'kv'})}),
mag AS (SELECT *, sqrt(gx * gx + gy * gy) AS g FROM both_),
edge AS (SELECT img_id, y, x, v, 255 - g * 255.0::DOUBLE / (max(g) OVER (PARTITION BY img_id) + 1e-6::DOUBLE) AS e FROM mag)"""

G = 4
#: Tiles of the px table: img_id, dx, dy, i, j, v.
TILES = f"tl AS (SELECT img_id, y // {G} * {G} AS dx, x // {G} * {G} AS dy, y % {G} AS i, x % {G} AS j, v FROM px)"


def _match(n: int) -> str:
    """CTEs up to ``best``: winner of each range tile of encodings with n - 1 sources, transforms 0 to 7."""
    r, c = gather("ti", "i", "j", G)
    last = n - 1
    return f"""{TILES},
enc AS (SELECT img_id // {n} AS encoding_id FROM (SELECT DISTINCT img_id FROM px) GROUP BY 1 HAVING count(*) = {n}),
rng AS (SELECT encoding_id, dx, dy, i, j, v FROM enc JOIN tl ON img_id = encoding_id * {n} + {last}),
kept AS (SELECT encoding_id, dx AS sx, dy AS sy FROM enc JOIN tl ON img_id BETWEEN encoding_id * {n} AND encoding_id * {n} + {last - 1} GROUP BY ALL HAVING min(v) <= 128),
dom AS (SELECT encoding_id, img_id - encoding_id * {n} + 1 AS src, dx AS sx, dy AS sy, i, j, v FROM enc JOIN tl ON img_id BETWEEN encoding_id * {n} AND encoding_id * {n} + {last - 1} JOIN kept k USING (encoding_id) WHERE k.sx = dx AND k.sy = dy),
cells AS (SELECT * FROM range(8) t(ti), range({G}) a(i), range({G}) b(j)),
turned AS (SELECT d.encoding_id, d.src, d.sx, d.sy, c.ti, c.i, c.j, d.v FROM (SELECT ti, i, j, {r} AS gi, {c} AS gj FROM cells) c JOIN dom d ON d.i = c.gi AND d.j = c.gj),
far AS (SELECT encoding_id, sqrt(CAST(power(max(dx) - any_value(nx), 2) + power(max(dy) - any_value(ny), 2) AS DOUBLE)) AS d FROM rng JOIN (SELECT encoding_id, min(sx) AS nx, min(sy) AS ny FROM kept GROUP BY 1) USING (encoding_id) GROUP BY encoding_id),
cand AS (SELECT r.encoding_id, r.dx, r.dy, t.src, t.sx, t.sy, t.ti, sum(((r.v - t.v) * (r.v - t.v)) % 256) AS sq, sum(r.v) AS rs, sum(t.v) AS ds
    FROM rng r JOIN turned t ON t.encoding_id = r.encoding_id AND t.i = r.i AND t.j = r.j GROUP BY ALL),
scored AS (SELECT c.*, sqrt(CAST(sq AS DOUBLE)) + (1.0::DOUBLE / (d + 10)) * sqrt(CAST(power(dx - sx, 2) + power(dy - sy, 2) AS DOUBLE)) AS err FROM cand c JOIN far USING (encoding_id)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY encoding_id, dx, dy ORDER BY err, src, sx, sy, ti) = 1)"""


_LIGHT = f"CAST(greatest(-255, least(255, floor((4 * rs - 3 * ds) / {4.0 * G * G}))) AS INTEGER)"
CODES = f"""{_match(2)},
codes AS (SELECT encoding_id, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, CAST(sx AS INTEGER) AS sx, CAST(sy AS INTEGER) AS sy, CAST(ti AS INTEGER) AS ti,
    0.75::DOUBLE AS contrast, {_LIGHT} AS brightness, 0 AS comp, {G} AS grid, err FROM best)"""


def _wavelets(n: int, widths: int, name: str = "cw") -> str:
    """width, row, column, coefficient of the causal wavelet matrices."""
    rows = []
    for w, m in enumerate(blocks.wavelet_matrices(n, widths), 1):
        for i in range(n):
            rows += [f"({w}, {i}, {j}, {float(m[i, j])!r})" for j in range(i + 1) if m[i, j]]
    return f"{name}(wd, i, j, c) AS (SELECT wd, i, j, CAST(c AS DOUBLE) FROM (VALUES {', '.join(rows)}) AS t(wd, i, j, c))"


def _cw_score(source: str, keys: str, n: int, out: str, cw: str = "cw") -> str:
    """CTE ``out`` of ``keys`` and s, from (keys, p, m, t): made and target value at flat position p."""
    return f"""{out}_w AS (SELECT {keys}, c.wd, c.i, sum(c.c * m) AS a, sum(c.c * t) AS b FROM {source} JOIN {cw} c ON c.j = p GROUP BY ALL),
{out}_i AS (SELECT {keys}, i, sum(abs(a * b)) AS ab, abs(sum(a * b)) AS pl, sum(a * a) AS aa, sum(b * b) AS bb FROM {out}_w GROUP BY ALL),
{out} AS (SELECT {keys}, sum((2 * ab + 0.01::DOUBLE) / (aa + bb + 0.01::DOUBLE) * ((2 * pl + 0.01::DOUBLE) / (2 * ab + 0.01::DOUBLE))) / {n} AS s FROM {out}_i GROUP BY ALL)"""


def _features(codes: str = "codes") -> str:
    """SELECT of encoding_id, feature: eleven strings a code."""
    tr = "concat('id=', CASE WHEN ti = 0 THEN 1 ELSE 0 END, '_angle=', CASE WHEN ti BETWEEN 1 AND 3 THEN 90 * ti ELSE 0 END, '_hf=', CAST(ti = 4 AS INTEGER), '_vf=', CAST(ti = 5 AS INTEGER), '_ryx=', CAST(ti = 6 AS INTEGER), '_rynx=', CAST(ti = 7 AS INTEGER), '_fill=', CAST(ti = 8 AS INTEGER), '_unfill=', CAST(ti = 9 AS INTEGER))"
    at = "concat('dx=', dx, '_dy=', dy, '_sx=', sx, '_sy=', sy)"
    b, x, g = f"'brightness=' || {bin_sql('brightness')}", "'img_comp=' || comp", "'grid_size=' || grid"
    shift, size = "concat('dx=', dx - sx, '_dy=', dy - sy)", "concat('dx=', abs(dx - sx), '_dy=', abs(dy - sy))"
    parts = {
        "feat_spec": [at, tr, b, x, g], "pos_ag": [shift, tr, b, x, g], "grid_ag": [at, tr, b, x], "comp_ag": [at, tr, b, g], "bright_ag": [at, tr, x, g],
        "trans_ag": [at, b, x, g], "trans_spec": [tr], "bright_spec": [b], "comp_spec": [x], "feat_pos_abs": [size, tr, b, x, g], "feat_pos_shift": [shift],
    }
    strings = ", ".join(f"concat_ws('_', '{n}', {', '.join(p)})" for n, p in parts.items())
    return f"SELECT encoding_id, unnest([{strings}]) AS feature FROM {codes}"


def bin_sql(b: str) -> str:
    hi = f"CAST(ceil({b} / 20.0) * 20 AS INTEGER)"
    return f"CASE WHEN {b} <= -240 THEN '(-255, -240)' WHEN {b} > 220 THEN '(220, 255)' ELSE concat('(', {hi} - 20, ', ', {hi}, ')') END"


def _analogies(grids: list[int], relations: list[str]) -> str:
    """CTEs up to ``said`` (problem_id, relation, feature): features of relations of two or three figures, in all directions."""
    n = len(relations[0].split(":"))
    names = ", ".join(f"('{x}', " + ", ".join(f"'{f}'" for f in x.split(":")) + ")" for x in relations)
    figures = "fig AS (SELECT vec_id // 9 AS problem_id, ['A', 'B', 'C', '1', '2', '3', '4', '5', '6'][vec_id % 9 + 1] AS figure, vec_id AS img_id FROM embeddings QUALIFY count(*) OVER (PARTITION BY vec_id // 9) = 9)"
    if n == 2:
        whole = f"""rel AS (SELECT * FROM (VALUES {names}) AS t(relation, f1, f2)),
way AS (SELECT a.problem_id, relation, unnest([a.img_id, b.img_id]) AS d1, CAST(NULL AS BIGINT) AS d2, unnest([b.img_id, a.img_id]) AS r FROM rel JOIN fig a ON a.figure = f1 JOIN fig b ON b.problem_id = a.problem_id AND b.figure = f2)"""
    else:
        whole = f"""rel AS (SELECT * FROM (VALUES {names}) AS t(relation, f1, f2, f3)),
way AS (SELECT a.problem_id, relation, unnest([a.img_id, b.img_id, b.img_id, c.img_id, a.img_id, c.img_id]) AS d1, unnest([b.img_id, a.img_id, c.img_id, b.img_id, c.img_id, a.img_id]) AS d2, unnest([c.img_id, c.img_id, a.img_id, a.img_id, b.img_id, b.img_id]) AS r
    FROM rel JOIN fig a ON a.figure = f1 JOIN fig b ON b.problem_id = a.problem_id AND b.figure = f2 JOIN fig c ON c.problem_id = a.problem_id AND c.figure = f3)"""
    number = "((coalesce(d2, 0) * 1048576 + d1) * 1048576 + r)"
    ctes = [figures, whole]
    for g in grids:
        ctes += [f"enc{g} AS (SELECT DISTINCT {number} AS encoding_id, d1, d2, r FROM way)", _full_codes(g, n - 1, 5 if n == 2 else 2, str(g)), f"f{g} AS ({_features(f'codes{g}')})"]
    found = " UNION ALL ".join(f"SELECT * FROM f{g}" for g in grids)
    ctes.append(f"said AS (SELECT DISTINCT problem_id, relation, feature FROM way JOIN ({found}) ON encoding_id = {number})")
    return ",\n".join(ctes)


_PAIRS = ["A:B", *(f"C:{i}" for i in range(1, 7))]
_TRIPLETS = ["A:B:C", "4:5:6"]


def _score(premise: str) -> str:
    return f"""ans AS (SELECT DISTINCT problem_id, relation FROM said WHERE relation <> '{premise}'),
marks AS (SELECT a.problem_id, a.relation, s.feature, bool_or(s.relation = '{premise}') AND bool_or(s.relation <> '{premise}') AS shared FROM ans a JOIN said s ON s.problem_id = a.problem_id AND (s.relation = '{premise}' OR s.relation = a.relation) GROUP BY ALL),
score AS (SELECT problem_id, '{premise}::' || relation AS analogy, round(count(*) FILTER (shared) / CAST(count(*) AS DOUBLE), 9) AS score FROM marks GROUP BY ALL)"""


_WHITE = "count(*) FILTER (v > 10)"
_OUT = "CASE WHEN {} THEN 0 ELSE 255 END"


def _pixelwise(expr: str) -> str:
    return f"WITH {px()}, {PAIR}, c AS (SELECT pair_id, y, x, {expr} AS v FROM pr) SELECT pair_id, {SUMS.format(w=8)} FROM c GROUP BY pair_id"


def _positions(n: int) -> str:
    return f"y * {n} + x"


def _xor(source: str, key: str, tag: str = "") -> str:
    """CTEs ``xb`` (key, y, x, v): exclusive or of a and b of ``source``, blurred; ``side`` by its largest pixel."""
    return f"""{_kernel(blocks.gaussian(5, 1.0).tolist(), f'kg{tag}')},
xm{tag} AS (SELECT {key}, y, x, CASE WHEN (a <> 0) <> (b <> 0) THEN 255 ELSE 0 END AS v FROM {source}),
xs{tag} AS ({_correlated(f'xm{tag}', {'s': f'kg{tag}'}, key)}),
xb{tag} AS (SELECT {key}, y, x, CASE WHEN floor(s) > 90 THEN 0 ELSE 255 END AS v FROM xs{tag})"""


def _all_compositions(source: str, key: str, tag: str = "") -> str:
    """CTE ``made`` (key, xk, y, x, v, t): all six compositions of a, b next to target c."""
    u = "SELECT {key}, {k} AS xk, y, x, {e} AS v, c AS t FROM {s}"
    one = lambda k, e: u.format(key=key, k=k, e=e, s=source)
    return f"""{_xor(source, key, tag)},
made{tag} AS ({one(0, 'a')} UNION ALL {one(2, _OUT.format('a < 128 OR b < 128'))} UNION ALL {one(3, _OUT.format('a < 128 AND b < 128'))} UNION ALL {one(4, _OUT.format('a <= 128 AND b > 128'))}
    UNION ALL {one(5, _OUT.format('b <= 128 AND a > 128'))} UNION ALL SELECT {key}, 6, x.y, x.x, x.v, c FROM xb{tag} x JOIN {source} USING ({key}, y, x))"""


def _full_codes(g: int, sources: int, widths: int, tag: str = "") -> str:
    """CTEs from enc{tag} (encoding_id, d1, d2, r) to codes{tag}: ten transforms and compositions.

    Images are 8 x 8, in px; the domains must have a tile that isn't white.
    """
    t, one = tag, sources == 1
    r, c = gather("ti", "i", "j", g)
    second = "" if one else f" UNION ALL SELECT encoding_id, 2, d2 FROM enc{t}"
    light = f"orig{t}" if one else f"light{t}"
    return f"""{_kernel(blocks.SOBEL.tolist(), f'kh{t}')}, {_kernel(_SOBEL_V, f'kv{t}')}, {_wavelets(g * g, widths, f'cw{t}')},
tl{t} AS (SELECT img_id, y // {g} * {g} AS dx, x // {g} * {g} AS dy, y % {g} AS i, x % {g} AS j, v FROM px),
use{t} AS (SELECT encoding_id, 1 AS src, d1 AS img_id FROM enc{t}{second}),
rng{t} AS (SELECT encoding_id, dx, dy, i, j, v FROM enc{t} JOIN tl{t} ON img_id = r),
kept{t} AS (SELECT encoding_id, dx AS sx, dy AS sy FROM use{t} JOIN tl{t} USING (img_id) GROUP BY ALL HAVING min(v) <= 128),
tile{t} AS (SELECT DISTINCT img_id, dx AS sx, dy AS sy, i, j, v FROM use{t} JOIN tl{t} USING (img_id)),
filled{t} AS (SELECT p.img_id, p.sx, p.sy, p.i, p.j, CASE WHEN bool_or(q.v < 128 AND q.i = p.i AND q.j <= p.j) AND bool_or(q.v < 128 AND q.i = p.i AND q.j >= p.j) AND bool_or(q.v < 128 AND q.j = p.j AND q.i <= p.i) AND bool_or(q.v < 128 AND q.j = p.j AND q.i >= p.i) THEN 0 ELSE 255 END AS v
    FROM tile{t} p JOIN tile{t} q USING (img_id, sx, sy) GROUP BY ALL),
grad{t} AS (SELECT p.img_id, p.sx, p.sy, p.i, p.j, p.v, sum(h.wt * coalesce(q.v, 255)) AS gx, sum(w.wt * coalesce(q.v, 255)) AS gy FROM tile{t} p CROSS JOIN kh{t} h JOIN kv{t} w USING (ky, kx)
    LEFT JOIN tile{t} q ON q.img_id = p.img_id AND q.sx = p.sx AND q.sy = p.sy AND q.i = p.i + ky AND q.j = p.j + kx GROUP BY ALL),
unfilled{t} AS (SELECT img_id, sx, sy, i, j, CASE WHEN v < 128 AND 255 - sqrt(gx * gx + gy * gy) * 255 / (max(sqrt(gx * gx + gy * gy)) OVER (PARTITION BY img_id, sx, sy) + 1e-6::DOUBLE) < 128 THEN 0 ELSE 255 END AS v FROM grad{t}),
turned{t} AS (SELECT d.img_id, d.sx, d.sy, c.ti, c.i, c.j, d.v FROM (SELECT ti, i, j, {r} AS gi, {c} AS gj FROM range(8) t(ti), range({g}) a(i), range({g}) b(j)) c JOIN tile{t} d ON d.i = c.gi AND d.j = c.gj
    UNION ALL SELECT img_id, sx, sy, 8, i, j, v FROM filled{t} UNION ALL SELECT img_id, sx, sy, 9, i, j, v FROM unfilled{t}),
low{t} AS (SELECT encoding_id, sqrt(CAST(power({8 - g} - min(sx), 2) + power({8 - g} - min(sy), 2) AS DOUBLE)) AS far FROM kept{t} GROUP BY encoding_id),
pair{t} AS (SELECT DISTINCT u.img_id, e.r FROM use{t} u JOIN enc{t} e USING (encoding_id)),
size{t} AS (SELECT p.img_id, p.r, b.dx, b.dy, a.sx, a.sy, a.ti, sum(CASE WHEN a.ti = 9 THEN (b.v - a.v) * (b.v - a.v) ELSE ((b.v - a.v) * (b.v - a.v)) % 256 END) AS sq
    FROM pair{t} p JOIN tl{t} b ON b.img_id = p.r JOIN turned{t} a ON a.img_id = p.img_id AND a.i = b.i AND a.j = b.j GROUP BY ALL),
best{t} AS (SELECT e.encoding_id, u.src, s.dx, s.dy, s.sx, s.sy, s.ti, sqrt(CAST(sq AS DOUBLE)) + (1.0::DOUBLE / (far + 10)) * sqrt(CAST(power(dx - s.sx, 2) + power(dy - s.sy, 2) AS DOUBLE)) AS err
    FROM use{t} u JOIN enc{t} e USING (encoding_id) JOIN size{t} s ON s.img_id = u.img_id AND s.r = e.r JOIN kept{t} k ON k.encoding_id = e.encoding_id AND k.sx = s.sx AND k.sy = s.sy JOIN low{t} l ON l.encoding_id = e.encoding_id
    QUALIFY row_number() OVER (PARTITION BY e.encoding_id, dx, dy ORDER BY err, src, s.sx, s.sy, ti) = 1),
tri{t} AS (SELECT (b.encoding_id * 100 + b.dx * 10 + b.dy) AS key, q.i AS y, q.j AS x, t1.v AS a, {'q.v' if one else 't2.v'} AS b, q.v AS c FROM best{t} b JOIN enc{t} e USING (encoding_id) JOIN tl{t} q ON q.img_id = e.r AND q.dx = b.dx AND q.dy = b.dy
    JOIN turned{t} t1 ON t1.img_id = e.d1 AND t1.sx = b.sx AND t1.sy = b.sy AND t1.ti = b.ti AND t1.i = q.i AND t1.j = q.j
    {'' if one else f'JOIN turned{t} t2 ON t2.img_id = e.d2 AND t2.sx = b.sx AND t2.sy = b.sy AND t2.ti = b.ti AND t2.i = q.i AND t2.j = q.j'}),
{_all_compositions(f'tri{t}', 'key', t)},
src{t} AS (SELECT key, xk, y * {g} + x AS p, v AS m, t FROM made{t}), {_cw_score(f'src{t}', 'key, xk', g * g, f'sc{t}', f'cw{t}')},
comp{t} AS (SELECT key, xk FROM sc{t} QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(s, 11) DESC, xk) = 1),
light{t} AS (SELECT key, any_value(xk) AS xk, floor((4 * sum(t) - 3 * sum(v)) / {4.0 * g * g}) AS l FROM made{t} JOIN comp{t} USING (key, xk) GROUP BY key),
orig{t} AS (SELECT key, floor((4 * sum(c) - 3 * sum(a)) / {4.0 * g * g}) AS l FROM tri{t} GROUP BY key),
codes{t} AS (SELECT encoding_id, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, CAST(sx AS INTEGER) AS sx, CAST(sy AS INTEGER) AS sy, CAST(ti AS INTEGER) AS ti, 0.75::DOUBLE AS contrast,
    CAST(greatest(-255, least(255, {light}.l)) AS INTEGER) AS brightness, CAST(xk AS INTEGER) AS comp, {g} AS grid FROM best{t} JOIN light{t} ON light{t}.key = encoding_id * 100 + dx * 10 + dy JOIN orig{t} ON orig{t}.key = light{t}.key)"""


def _neighbours(n: int) -> str:
    """CTE ``enc`` of the encodings of neighbouring images, n - 1 sources."""
    second = "encoding_id * 3 + 1" if n == 3 else "CAST(NULL AS BIGINT)"
    return f"enc AS (SELECT encoding_id, encoding_id * {n} AS d1, {second} AS d2, encoding_id * {n} + {n - 1} AS r FROM (SELECT img_id // {n} AS encoding_id FROM (SELECT DISTINCT img_id FROM px) GROUP BY 1 HAVING count(*) = {n}))"


FULL_CODES = {n: f"{_neighbours(n)}, {_full_codes(G, n - 1, 5 if n == 2 else 2)}" for n in (2, 3)}


ORACLE: dict[str, str] = {
    "px_build": f"WITH {px()} SELECT img_id, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 8 + x + 1)) AS BIGINT) AS checksum FROM px GROUP BY img_id",
    "whitespace_ratio": f"WITH {px()} SELECT img_id, {_WHITE} AS area, {_WHITE} / 64.0::DOUBLE AS ratio FROM px GROUP BY img_id",
    "tile_filter": f"WITH {px('sparse')}, {TILES} SELECT img_id, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, min(v) <= 128 AS kept, CAST(sum(v * (i * 4 + j + 1)) AS BIGINT) AS checksum FROM tl GROUP BY ALL",
    "block_mean_reduce": f"WITH {px()} SELECT img_id, CAST(y // 3 * 2 + x // 3 AS INTEGER) AS p, round(avg(v), 9) AS mean FROM px WHERE y < 6 AND x < 6 GROUP BY ALL",
    "crop_center": f"WITH {px()}, c AS (SELECT img_id, y - 1 AS y, x - 1 AS x, v FROM px WHERE y BETWEEN 1 AND 5 AND x BETWEEN 1 AND 5) SELECT img_id, 5 AS h, 5 AS w, {SUMS.format(w=5)} FROM c GROUP BY img_id",
    "pad_white": f"""WITH {px()}, canvas AS (SELECT img_id, y, x FROM (SELECT DISTINCT img_id FROM px), range(11) a(y), range(9) b(x)),
c AS (SELECT n.img_id, n.y, n.x, coalesce(p.v, 255) AS v FROM canvas n LEFT JOIN px p ON p.img_id = n.img_id AND p.y = n.y - 1 AND p.x = n.x - 0) SELECT img_id, 11 AS h, 9 AS w, {SUMS.format(w=9)} FROM c GROUP BY img_id""",
    "transform_d4": "WITH {}, c AS (SELECT ti, i, j, {} AS gi, {} AS gj FROM range(8) t(ti), range(8) a(i), range(8) b(j)) SELECT img_id, CAST(ti AS INTEGER) AS ti, CAST(sum(v * (i * 8 + j + 1)) AS BIGINT) AS checksum FROM c JOIN px ON y = gi AND x = gj GROUP BY ALL".format(px(), *gather("ti", "i", "j", 8)),
    "translate_xy": f"""WITH {px()}, canvas AS (SELECT img_id, y, x FROM (SELECT DISTINCT img_id FROM px), range(8) a(y), range(8) b(x)),
c AS (SELECT n.img_id, n.y, n.x, coalesce(p.v, 0) AS v FROM canvas n LEFT JOIN px p ON p.img_id = n.img_id AND p.y = n.y + 3 AND p.x = n.x - 2) SELECT img_id, {SUMS.format(w=8)} FROM c GROUP BY img_id""",
    "translations_grid": "SELECT tx, ty FROM (VALUES (-1), (0), (2)) a(tx), (VALUES (0), (3)) b(ty)",
    # rotate by 90, flip left to right, then anti-transpose: three gathers, the last one first
    "compose_transform_args": f"""WITH {px()}, c AS (SELECT img_id, x AS y, 7 - y AS x, v FROM (SELECT img_id, y, 7 - x AS x, v FROM (SELECT img_id, 7 - x AS y, y AS x, v FROM px))),
d AS (SELECT img_id, 7 - x AS y, 7 - y AS x, v FROM (SELECT img_id, y, 7 - x AS x, v FROM (SELECT img_id, 7 - x AS y, y AS x, v FROM px))) SELECT img_id, {SUMS.format(w=8)} FROM d GROUP BY img_id""",
    "transforms_dimension": "SELECT CAST(i AS INTEGER) AS ti, [" + ", ".join(f"'{n}'" for n in blocks.TRANSFORM_NAMES) + "][i + 1] AS name, " + f"{list(blocks.COMPLEXITIES)}[i + 1] AS complexity, CAST(i = 0 AS INTEGER) AS id, 90 * CAST(i = 1 AS INTEGER) AS r90, 180 * CAST(i = 2 AS INTEGER) AS r180, 270 * CAST(i = 3 AS INTEGER) AS r270, CAST(i = 4 AS INTEGER) AS hf, CAST(i = 5 AS INTEGER) AS vf, CAST(i = 6 AS INTEGER) AS f_rynx, CAST(i = 7 AS INTEGER) AS f_ryx, CAST(i = 8 AS INTEGER) AS fill, CAST(i = 9 AS INTEGER) AS unfill FROM range(10) t(i)",
    "compositions_dimension": "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in blocks.COMPOSITIONS.items()) + ") AS t(x, name)",
    "candidate_transforms_n3": "WITH t AS (SELECT i, [" + ", ".join(f"'{n}'" for n in blocks.TRANSFORM_NAMES) + f"][i + 1] AS name, {list(blocks.COMPLEXITIES)}[i + 1] AS c FROM range(10) r(i)) "
    "SELECT 1 AS n, name AS names, c AS complexity FROM t WHERE c < 10 UNION ALL SELECT 2, a.name || '+' || b.name, a.c + b.c FROM t a JOIN t b ON a.i < b.i WHERE a.c + b.c < 10 "
    "UNION ALL SELECT 3, a.name || '+' || b.name || '+' || d.name, a.c + b.c + d.c FROM t a JOIN t b ON a.i < b.i JOIN t d ON b.i < d.i WHERE a.c + b.c + d.c < 10",
    "chain_equality": "SELECT 'Rotate90' AS names UNION ALL SELECT 'Identity+Rotate90'",
    "fill_shape": f"""WITH {px('sparse')}, e AS (SELECT *, CAST(v < 128 AS INTEGER) AS k FROM px),
f AS (SELECT p.img_id, p.y, p.x, max(CASE WHEN q.y = p.y AND q.x <= p.x THEN k END) AS l, max(CASE WHEN q.y = p.y AND q.x >= p.x THEN k END) AS r, max(CASE WHEN q.x = p.x AND q.y <= p.y THEN k END) AS u, max(CASE WHEN q.x = p.x AND q.y >= p.y THEN k END) AS d
    FROM px p JOIN e q ON q.img_id = p.img_id AND (q.y = p.y OR q.x = p.x) GROUP BY ALL)
SELECT img_id, CAST(sum(CASE WHEN l + r + u + d = 4 THEN y * 8 + x + 1 ELSE 0 END) AS BIGINT) AS dark FROM f GROUP BY img_id""",
    "unfill_shape": f"WITH {px()}, {EDGES}, c AS (SELECT img_id, y, x, CASE WHEN v < 128 AND e < 128 THEN 0 ELSE 255 END AS v FROM edge) SELECT img_id, {SUMS.format(w=8)} FROM c GROUP BY img_id",
    "sobel_edges": f"WITH {px()}, {EDGES} SELECT img_id, CAST(y * 8 + x AS INTEGER) AS p, round(e, 6) AS edge FROM edge",
    "blur_gauss": f"WITH {px()}, {_kernel(blocks.gaussian(3, 1.0).tolist(), 'kg')}, c AS ({_correlated('px', {'s': 'kg'})}) SELECT img_id, CAST(y * 8 + x AS INTEGER) AS p, round(s, 6) AS value FROM c",
    "convolve_kernel": f"WITH {px()}, {_kernel([[1, 2, 1], [0, 4, 0], [-1, 0, 3]], 'kg')}, c AS ({_correlated('px', {'s': 'kg'})}) SELECT img_id, CAST(sum(CAST(s AS BIGINT) * (y * 8 + x + 1)) AS BIGINT) AS checksum FROM c GROUP BY img_id",
    "compose_left": _pixelwise("a"),
    "compose_right": _pixelwise("b"),
    "compose_union": _pixelwise(_OUT.format("a < 128 OR b < 128")),
    "compose_intersection": _pixelwise(_OUT.format("a < 128 AND b < 128")),
    "compose_subtract": _pixelwise(_OUT.format("a <= 128 AND b > 128")),
    "compose_backsubtract": _pixelwise(_OUT.format("b <= 128 AND a > 128")),
    "compose_xor": f"WITH {px()}, {PAIR}, half AS (SELECT pair_id, y, x, CASE WHEN a < 128 THEN 0 ELSE a END AS a, CASE WHEN b < 128 THEN 0 ELSE b END AS b FROM pr), {_xor('half', 'pair_id')} SELECT pair_id, {SUMS.format(w=8)} FROM xb GROUP BY pair_id",
    "frobenius_wrap": f"WITH {px()}, {PAIR} SELECT pair_id, sqrt(CAST(sum(((a - b) * (a - b)) % 256) AS DOUBLE)) AS error FROM pr GROUP BY pair_id",
    "frobenius_exact": f"WITH {px()}, {PAIR} SELECT pair_id, sqrt(CAST(sum((a - b) * (a - b)) AS DOUBLE)) AS error FROM pr GROUP BY pair_id",
    "correspondence_weights": f"""WITH {px('sparse')}, {TILES}, enc AS (SELECT img_id // 2 AS encoding_id FROM (SELECT DISTINCT img_id FROM px) GROUP BY 1 HAVING count(*) = 2),
kept AS (SELECT encoding_id, dx, dy FROM enc JOIN tl ON img_id = encoding_id * 2 GROUP BY ALL HAVING min(v) <= 128)
SELECT encoding_id, 1 AS w1, 1.0::DOUBLE / (sqrt(CAST(power(4 - min(dx), 2) + power(4 - min(dy), 2) AS DOUBLE)) + 10) AS w2 FROM kept GROUP BY encoding_id""",
    "color_contraction": f"WITH {px()}, {PAIR} SELECT pair_id, 0.75::DOUBLE AS contrast, CAST(greatest(-255, least(255, floor(sum(b - 0.75::DOUBLE * a) / 64))) AS INTEGER) AS brightness FROM pr GROUP BY pair_id",
    "match_2x1_argmin": f"WITH {px('binary')}, {CODES} SELECT encoding_id, dx, dy, sx, sy, ti, brightness, err FROM codes",
    "match_blank_default": f"""WITH {px('sparse')}, enc AS (SELECT img_id // 2 AS encoding_id FROM px GROUP BY 1 HAVING count(*) = 128),
blank AS (SELECT img_id FROM px GROUP BY 1 HAVING min(v) > 128)
SELECT encoding_id, CAST(a * 4 AS INTEGER) AS dx, CAST(b * 4 AS INTEGER) AS dy, 0 AS sx, 0 AS sy, 0 AS ti, 0.75::DOUBLE AS contrast, 255 AS brightness, 0 AS comp, 4 AS grid FROM enc JOIN blank ON img_id = encoding_id * 2, range(2) r(a), range(2) s(b)""",
    "match_3x1_argmin": f"WITH {px('binary')}, {_match(3)} SELECT encoding_id, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, CAST(src AS INTEGER) AS src, CAST(sx AS INTEGER) AS sx, CAST(sy AS INTEGER) AS sy, CAST(ti AS INTEGER) AS ti, {_LIGHT} AS brightness FROM best",
    "cw_ssim_pair": f"WITH {px()}, {PAIR}, {_wavelets(64, 5)}, src AS (SELECT pair_id, y * 8 + x AS p, a AS m, b AS t FROM pr), {_cw_score('src', 'pair_id', 64, 'sc')} SELECT pair_id, round(s, 6) AS score FROM sc",
    "wavelet_transform": f"WITH {px()}, {_wavelets(64, 3)} SELECT img_id, CAST(wd AS INTEGER) AS width, CAST(i AS INTEGER) AS p, round(sum(c * v), 6) AS value FROM cw JOIN px ON y * 8 + x = j GROUP BY ALL",
    "blur_planes": f"""WITH {px()}, {_kernel(blocks.gaussian(3, 1.0).tolist(), 'kg')}, s AS ({_correlated('px', {'s': 'kg'})}), c AS (SELECT img_id // 3 AS img_id, img_id % 3 AS ch, sum(CAST(trunc(s) AS BIGINT) * (y * 8 + x + 1)) AS k FROM s GROUP BY ALL)
SELECT img_id, CAST(max(k) FILTER (ch = 0) AS BIGINT) AS r, CAST(max(k) FILTER (ch = 1) AS BIGINT) AS g, CAST(max(k) FILTER (ch = 2) AS BIGINT) AS b FROM c GROUP BY img_id HAVING count(*) = 3""",
    "cw_ssim_distinct": f"WITH {px()}, {PAIR}, {_wavelets(64, 2)}, src AS (SELECT pair_id, y * 8 + x AS p, a AS m, b AS t FROM pr), {_cw_score('src', 'pair_id', 64, 'sc')} SELECT pair_id, round(s, 6) AS score FROM sc",
    "ssim_pair": f"""WITH {px()}, {PAIR}, {_kernel(blocks.gaussian(3, 1.0).tolist(), 'kg')},
c AS (SELECT p.pair_id, p.y, p.x, sum(wt * coalesce(q.a, 255)) AS ux, sum(wt * coalesce(q.b, 255)) AS uy, sum(wt * coalesce(q.a * q.a, 255)) AS sxx, sum(wt * coalesce(q.b * q.b, 255)) AS syy, sum(wt * coalesce(q.a * q.b, 255)) AS sxy
    FROM pr p CROSS JOIN kg LEFT JOIN pr q ON q.pair_id = p.pair_id AND q.y = p.y + ky AND q.x = p.x + kx GROUP BY ALL)
SELECT pair_id, round(avg((2 * ux * uy + 6.5025::DOUBLE) * (2 * (sxy - ux * uy) + 58.5225::DOUBLE) / ((ux * ux + uy * uy + 6.5025::DOUBLE) * (sxx - ux * ux + syy - uy * uy + 58.5225::DOUBLE))), 6) AS score FROM c WHERE y BETWEEN 1 AND 5 AND x BETWEEN 1 AND 5 GROUP BY pair_id""",
    "image_jaccard": f"WITH {px()}, {PAIR} SELECT pair_id, count(*) FILTER (NOT (a < 128 AND b < 128)) / CAST(nullif(count(*) FILTER (a >= 128 AND b >= 128), 0) AS DOUBLE) AS score FROM pr GROUP BY pair_id",
    "image_tversky": f"WITH {px()}, {PAIR} SELECT pair_id, count(*) FILTER (NOT (a < 128 AND b < 128)) / (count(*) FILTER (a >= 128 AND b >= 128) + 1e-6::DOUBLE) AS score FROM pr GROUP BY pair_id",
    "best_composition": f"""WITH {px('binary')}, {TRIPLE}, {_all_compositions('tr', 'pair_id')}, {_wavelets(64, 5)}, src AS (SELECT pair_id, xk, y * 8 + x AS p, v AS m, t FROM made), {_cw_score('src', 'pair_id, xk', 64, 'sc')}
SELECT pair_id, xk AS x, CASE xk WHEN 0 THEN 'ImageCompIdentityLeft' WHEN 2 THEN 'ImageUnion' WHEN 3 THEN 'ImageIntersection' WHEN 4 THEN 'ImageSubtract' WHEN 5 THEN 'ImageBacksubtract' ELSE 'ImageXOR' END AS comp_name, round(s, 6) AS score
FROM sc QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY round(s, 11) DESC, xk) = 1""",
    "best_composition_rmse": f"""WITH {px('binary')}, {TRIPLE}, {_all_compositions('tr', 'pair_id')}, sc AS (SELECT pair_id, xk, sqrt(CAST(sum(CASE WHEN xk = 0 THEN ((v - t) * (v - t)) % 256 ELSE (v - t) * (v - t) END) AS DOUBLE)) / 64 AS s FROM made GROUP BY ALL)
SELECT pair_id, xk AS x, round(s, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY round(s, 11), xk) = 1""",
    "feature_strings": f"WITH {px('binary')}, {FULL_CODES[2]} {_features()}",
    "brightness_bins": f"SELECT CAST(b AS INTEGER) AS b, {bin_sql('b')} AS bin FROM range(-255, 256) t(b)",
    "problem_records": "WITH f AS (SELECT vec_id // 9 AS problem_id, ['A', 'B', 'C', '1', '2', '3', '4', '5', '6'][vec_id % 9 + 1] AS figure, vec_id AS img_id FROM embeddings QUALIFY count(*) OVER (PARTITION BY vec_id // 9) = 9) SELECT problem_id, concat('problem ', problem_id) AS name, '2x2' AS ptype, figure, img_id FROM f",
    "mutual_features": f"WITH {px('binary')}, {_analogies([4], _PAIRS)} SELECT problem_id, 'A:B::' || a.relation AS analogy, side, feature FROM (SELECT problem_id, relation, unnest([1, 2]) AS side FROM (SELECT DISTINCT problem_id, relation FROM said WHERE relation <> 'A:B')) a JOIN said s USING (problem_id) WHERE s.relation = CASE side WHEN 1 THEN 'A:B' ELSE a.relation END",
    "analogy_score": f"WITH {px('binary')}, {_analogies([4], _PAIRS)}, {_score('A:B')} SELECT * FROM score",
    "analogy_triplets": f"WITH {px('binary')}, {_analogies([4], _TRIPLETS)}, {_score('A:B:C')} SELECT * FROM score",
    "analogy_multiscale": f"WITH {px('binary')}, {_analogies([4, 8], _PAIRS)}, {_score('A:B')} SELECT * FROM score",
    "best_answers": f"WITH {px('binary')}, {_analogies([4], _PAIRS)}, {_score('A:B')} SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, analogy) = 1",
    "label_components": f"""WITH RECURSIVE {px('sparse')}, whole AS (SELECT img_id // 16 AS m FROM px GROUP BY 1 HAVING count(*) = 1024),
on_ AS (SELECT m AS img_id, (((img_id % 16) // 4) * 8 + y) * 32 + (img_id % 4) * 8 + x AS p FROM px JOIN whole ON m = img_id // 16 WHERE v < 128),
reach AS (SELECT img_id, p, p AS q FROM on_ UNION SELECT r.img_id, r.p, o.p FROM reach r JOIN on_ o ON o.img_id = r.img_id AND abs(o.p // 32 - r.q // 32) <= 1 AND abs(o.p % 32 - r.q % 32) <= 1),
root AS (SELECT img_id, p, min(q) AS f FROM reach GROUP BY ALL)
SELECT img_id, CAST(dense_rank() OVER (PARTITION BY img_id ORDER BY f) AS INTEGER) AS label, n_pixels, first FROM (SELECT img_id, f, count(*) AS n_pixels, CAST(f AS INTEGER) AS first FROM root GROUP BY ALL)""",
    "mosaic_build": f"""WITH {px()}, whole AS (SELECT img_id // 16 AS m FROM px GROUP BY 1 HAVING count(*) = 1024),
c AS (SELECT m AS img_id, ((img_id % 16) // 4) * 8 + y AS y, (img_id % 4) * 8 + x AS x, v FROM px JOIN whole ON m = img_id // 16) SELECT img_id, 32 AS h, 32 AS w, {SUMS.format(w=32)} FROM c GROUP BY img_id""",
    "chunks_of_n": "WITH r AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 7 AS chunk FROM embeddings) SELECT chunk, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM r GROUP BY chunk",
    "repeated_cells": "SELECT vec_id AS img_id, CAST(8 AS BIGINT) AS n_cells FROM embeddings",
}
ORACLE["fill_stacked"] = ORACLE["fill_shape"]
# half a turn, upside down, then transposed; then filled
ORACLE["compose_transform_fill"] = f"""WITH {px('sparse', 'px0')}, px AS (SELECT img_id, 7 - x AS y, y AS x, v FROM px0), e AS (SELECT *, CAST(v < 128 AS INTEGER) AS k FROM px),
f AS (SELECT p.img_id, p.y, p.x, max(CASE WHEN q.y = p.y AND q.x <= p.x THEN k END) AS l, max(CASE WHEN q.y = p.y AND q.x >= p.x THEN k END) AS r, max(CASE WHEN q.x = p.x AND q.y <= p.y THEN k END) AS u, max(CASE WHEN q.x = p.x AND q.y >= p.y THEN k END) AS d
    FROM px p JOIN e q ON q.img_id = p.img_id AND (q.y = p.y OR q.x = p.x) GROUP BY ALL), c AS (SELECT img_id, y, x, CASE WHEN l + r + u + d = 4 THEN 0 ELSE 255 END AS v FROM f) SELECT img_id, {SUMS.format(w=8)} FROM c GROUP BY img_id"""
# three quarters of a turn and left to right: transposed; then unfilled
ORACLE["compose_transform_unfill"] = f"WITH {px('grey', 'px0')}, px AS (SELECT img_id, x AS y, y AS x, v FROM px0), {EDGES}, c AS (SELECT img_id, y, x, CASE WHEN v < 128 AND e < 128 THEN 0 ELSE 255 END AS v FROM edge) SELECT img_id, {SUMS.format(w=8)} FROM c GROUP BY img_id"
ORACLE["grey_of_colours"] = f"WITH {px()}, {TRIPLE}, g AS (SELECT pair_id, y, x, (a * 19595 + b * 38470 + c * 7471 + 32768) >> 16 AS v FROM tr) SELECT pair_id, 3 AS n, {SUMS.format(w=8)} FROM g GROUP BY pair_id"
ORACLE["match_2x1_relational"] = ORACLE["match_2x1_argmin"]
_SETS = f"WITH {px('binary')}, {FULL_CODES[2]}, f AS (SELECT DISTINCT encoding_id // 2 AS k, encoding_id % 2 AS odd, feature FROM ({_features()}))"
_SIDE = "SELECT k, feature FROM f WHERE odd = {}"
for _name, _op in (("union", "UNION"), ("intersection", "INTERSECT"), ("difference", "EXCEPT")):
    ORACLE[f"feature_{_name}"] = f"{_SETS} {_SIDE.format(0)} {_op} {_SIDE.format(1)}"
ORACLE["feature_jaccard"] = f"{_SETS}, n AS (SELECT k, feature, count(*) AS c FROM f GROUP BY ALL) SELECT k, round(count(*) FILTER (c = 2) / CAST(count(*) AS DOUBLE), 9) AS score FROM n GROUP BY k"


for _n, _name in ((2, "encode_2x1"), (3, "encode_3x1")):
    ORACLE[_name] = f"WITH {px('binary')}, {FULL_CODES[_n]} SELECT * FROM codes"


def _decode_steps(steps: int) -> str:
    """CTEs s0 .. s{steps} (encoding_id, y, x, v, u) from ``codes`` and ``enc``: v and u are the two sources of the next step.

    A step composes the tiles of both sources, transforms them, and puts 0.75 of the result plus the brightness at the range tile.
    """
    r, c = gather("ti", "i", "j", G)
    outside = f"SELECT p.i, p.j, CASE WHEN floor(sum(wt) * 255) > 90 THEN 0 ELSE 255 END AS v FROM range({G}) p(i), range({G}) q(j), kdec WHERE i + ky NOT BETWEEN 0 AND {G - 1} OR j + kx NOT BETWEEN 0 AND {G - 1} GROUP BY ALL"
    ctes = [
        f"{_kernel(blocks.SOBEL.tolist(), 'khd')}, {_kernel(_SOBEL_V, 'kvd')}, {_kernel(blocks.gaussian(5, 1.0).tolist(), 'kdec')}",
        f"gath AS (SELECT ti, i, j, {r} AS gi, {c} AS gj FROM range(8) t(ti), range({G}) a(i), range({G}) b(j))",
        "s0 AS (SELECT encoding_id, a.y, a.x, CAST(a.v AS DOUBLE) AS v, CAST(b.v AS DOUBLE) AS u FROM enc JOIN px a ON a.img_id = d1 JOIN px b ON b.img_id = coalesce(d2, d1) AND b.y = a.y AND b.x = a.x)",
    ]
    for k in range(1, steps + 1):
        ctes += [
            f"cut{k} AS (SELECT encoding_id, dx, dy, ti, comp, brightness, y - sx AS i, x - sy AS j, v, u FROM codes JOIN s{k - 1} USING (encoding_id) WHERE y - sx BETWEEN 0 AND {G - 1} AND x - sy BETWEEN 0 AND {G - 1})",
            f"""xor{k} AS (SELECT p.encoding_id, p.dx, p.dy, p.i, p.j, CASE WHEN trunc(sum(wt * CASE WHEN q.v IS NULL THEN 255 WHEN (q.v <> 0) <> (q.u <> 0) THEN 255 ELSE 0 END)) > 90 THEN 0 ELSE 255 END AS v FROM (SELECT * FROM cut{k} WHERE comp = 6) p CROSS JOIN kdec
    LEFT JOIN cut{k} q ON q.encoding_id = p.encoding_id AND q.dx = p.dx AND q.dy = p.dy AND q.i = p.i + ky AND q.j = p.j + kx GROUP BY ALL)""",
            f"""com{k} AS (SELECT p.encoding_id, p.dx, p.dy, p.ti, p.brightness, p.i, p.j, CAST(CASE p.comp WHEN 0 THEN p.v WHEN 2 THEN {_OUT.format('p.v < 128 OR u < 128')} WHEN 3 THEN {_OUT.format('p.v < 128 AND u < 128')}
    WHEN 4 THEN {_OUT.format('p.v <= 128 AND u > 128')} WHEN 5 THEN {_OUT.format('u <= 128 AND p.v > 128')} ELSE o.v END AS DOUBLE) AS v FROM cut{k} p LEFT JOIN xor{k} o USING (encoding_id, dx, dy, i, j))""",
            f"""fil{k} AS (SELECT p.encoding_id, p.dx, p.dy, p.i, p.j, CASE WHEN bool_or(q.v < 128 AND q.i = p.i AND q.j <= p.j) AND bool_or(q.v < 128 AND q.i = p.i AND q.j >= p.j) AND bool_or(q.v < 128 AND q.j = p.j AND q.i <= p.i) AND bool_or(q.v < 128 AND q.j = p.j AND q.i >= p.i) THEN 0 ELSE 255 END AS v
    FROM (SELECT * FROM com{k} WHERE ti = 8) p JOIN com{k} q USING (encoding_id, dx, dy) GROUP BY ALL)""",
            f"""gra{k} AS (SELECT p.encoding_id, p.dx, p.dy, p.i, p.j, p.v, sum(h.wt * coalesce(q.v, 255)) AS gx, sum(w.wt * coalesce(q.v, 255)) AS gy FROM (SELECT * FROM com{k} WHERE ti = 9) p CROSS JOIN khd h JOIN kvd w USING (ky, kx)
    LEFT JOIN com{k} q ON q.encoding_id = p.encoding_id AND q.dx = p.dx AND q.dy = p.dy AND q.i = p.i + ky AND q.j = p.j + kx GROUP BY ALL)""",
            f"""put{k} AS (SELECT c.encoding_id, c.dx, c.dy, g.i, g.j, c.v FROM com{k} c JOIN gath g ON g.ti = c.ti AND g.gi = c.i AND g.gj = c.j UNION ALL SELECT encoding_id, dx, dy, i, j, CAST(v AS DOUBLE) FROM fil{k}
    UNION ALL SELECT encoding_id, dx, dy, i, j, CASE WHEN v < 128 AND 255 - sqrt(gx * gx + gy * gy) * 255 / (max(sqrt(gx * gx + gy * gy)) OVER (PARTITION BY encoding_id, dx, dy) + 1e-6::DOUBLE) < 128 THEN 0.0 ELSE 255.0 END FROM gra{k})""",
            f"s{k} AS (SELECT p.encoding_id, dx + i AS y, dy + j AS x, 0.75::DOUBLE * p.v + brightness AS v, 0.75::DOUBLE * p.v + brightness AS u FROM put{k} p JOIN codes USING (encoding_id, dx, dy))",
        ]
    return ",\n".join(ctes)


def _steps(n: int) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS step, encoding_id, y, x, v FROM s{k}" for k in range(n + 1))


for _n, _name in ((2, "decode_n"), (3, "decode_two_sources")):
    ORACLE[_name] = f"WITH {px('binary')}, {FULL_CODES[_n]}, {_decode_steps(8)} SELECT encoding_id, step, CAST(y * 8 + x AS INTEGER) AS p, round(v, 6) AS value FROM ({_steps(8)})"
ORACLE["decode_quality"] = f"""WITH {px('binary')}, {FULL_CODES[2]}, {_decode_steps(4)}, {_wavelets(64, 5, 'cwd')}, q AS (SELECT s.encoding_id, s.step, s.y * 8 + s.x AS p, s.v AS m, t.v AS t FROM ({_steps(4)}) s JOIN enc USING (encoding_id) JOIN px t ON t.img_id = r AND t.y = s.y AND t.x = s.x),
{_cw_score('q', 'encoding_id, step', 64, 'scd', 'cwd')} SELECT encoding_id, step, round(s, 6) AS score FROM scd"""

ORACLE["neighbour_labels"] = f"""WITH RECURSIVE {px('sparse')}, on_ AS (SELECT img_id, y, x, y * 8 + x AS p FROM px WHERE v = 0),
reach AS (SELECT img_id, y, x, p AS q FROM on_ UNION SELECT r.img_id, r.y, r.x, o.p FROM reach r JOIN on_ o ON o.img_id = r.img_id AND abs(o.y - r.q // 8) <= 1 AND abs(o.x - r.q % 8) <= 1),
root AS (SELECT img_id, y, x, min(q) AS f FROM reach GROUP BY ALL),
near AS (SELECT q.img_id, q.y, q.x, count(DISTINCT f) AS n FROM px q LEFT JOIN root r ON r.img_id = q.img_id AND (r.y = q.y AND r.x = q.x - 1 OR r.y = q.y - 1 AND r.x BETWEEN q.x - 1 AND q.x + 1) GROUP BY ALL)
SELECT img_id, CAST(sum(n) AS BIGINT) AS n_neighbours FROM near GROUP BY img_id"""


def _cubic(n: int, m: int, name: str) -> str:
    """CTE of (to, at, wt): weights of a bicubic resize from n to m, antialiased where it shrinks."""
    scale, wide = n / m, max(1.0, n / m)
    t = f"abs((a + 0.5 - (o + 0.5) * {scale!r}::DOUBLE) / {wide!r}::DOUBLE)"
    inside = f"a >= greatest(0, floor((o + 0.5) * {scale!r}::DOUBLE - {2 * wide!r}::DOUBLE + 0.5)) AND a < least({n}, floor((o + 0.5) * {scale!r}::DOUBLE + {2 * wide!r}::DOUBLE + 0.5))"
    return f"""{name}_raw AS (SELECT o, a, CASE WHEN t < 1 THEN (1.5 * t - 2.5) * t * t + 1 WHEN t < 2 THEN ((-0.5 * t + 2.5) * t - 4) * t + 2 ELSE 0 END AS k FROM (SELECT o, a, {t} AS t FROM range({m}) p(o), range({n}) q(a) WHERE {inside})),
{name} AS (SELECT o, a, CAST(k AS DOUBLE) / sum(CAST(k AS DOUBLE)) OVER (PARTITION BY o) AS wt FROM {name}_raw)"""


_BYTE = "CAST(greatest(0, least(255, floor(round(sum(wt * v), 9) + 0.5))) AS BIGINT)"
ORACLE["resize_bicubic"] = f"""WITH {px()}, {_cubic(8, 5, 'kx')}, {_cubic(8, 12, 'ky')}, wide AS (SELECT img_id, y, o AS x, {_BYTE} AS v FROM px JOIN kx ON a = x GROUP BY ALL),
c AS (SELECT img_id, o AS y, x, {_BYTE} AS v FROM wide JOIN ky ON a = y GROUP BY ALL) SELECT img_id, 12 AS h, 5 AS w, {SUMS.format(w=5)} FROM c GROUP BY img_id"""

_TRIO = f"WITH {px('binary')}, {TRIPLE}, {_all_compositions('tr', 'pair_id')}"
ORACLE["best_composition_tversky"] = f"""{_TRIO}, sc AS (SELECT pair_id, xk, count(*) FILTER (NOT (v < 128 AND t < 128)) / (count(*) FILTER (NOT (v < 128 OR t < 128)) + 1e-6::DOUBLE) AS s FROM made GROUP BY ALL)
SELECT pair_id, xk AS x, round(s, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY round(s, 11) DESC, xk) = 1"""


def _ssim(source: str, keys: str) -> str:
    """CTEs up to ``sim`` (keys, y, x, s): structural similarity of m and t at each pixel."""
    on = " AND ".join(f"q.{k} = p.{k}" for k in keys.split(", "))
    own = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""{_kernel(blocks.gaussian(3, 1.0).tolist(), 'ks')},
loc AS (SELECT {own}, p.y, p.x, sum(wt * coalesce(q.m, 255)) AS ux, sum(wt * coalesce(q.t, 255)) AS uy, sum(wt * coalesce(q.m * q.m, 255)) AS sxx, sum(wt * coalesce(q.t * q.t, 255)) AS syy, sum(wt * coalesce(q.m * q.t, 255)) AS sxy
    FROM {source} p CROSS JOIN ks LEFT JOIN {source} q ON {on} AND q.y = p.y + ky AND q.x = p.x + kx GROUP BY ALL),
sim AS (SELECT {keys}, y, x, (2 * ux * uy + 6.5025::DOUBLE) * (2 * (sxy - ux * uy) + 58.5225::DOUBLE) / ((ux * ux + uy * uy + 6.5025::DOUBLE) * (sxx - ux * ux + syy - uy * uy + 58.5225::DOUBLE)) AS s FROM loc)"""


ORACLE["best_composition_ssim"] = f"""{_TRIO}, mt AS (SELECT pair_id, xk, y, x, v AS m, t FROM made), {_ssim('mt', 'pair_id, xk')}, sc AS (SELECT pair_id, xk, avg(s) AS s FROM sim WHERE y BETWEEN 1 AND 5 AND x BETWEEN 1 AND 5 GROUP BY ALL)
SELECT pair_id, xk AS x, round(s, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY round(s, 11) DESC, xk) = 1"""
ORACLE["ssim_map"] = f"WITH {px()}, {PAIR}, mt AS (SELECT pair_id, y, x, a AS m, b AS t FROM pr), {_ssim('mt', 'pair_id')} SELECT pair_id, CAST(y * 8 + x AS INTEGER) AS p, round(s, 6) AS value FROM sim"
ORACLE["cw_ssim_map"] = f"""WITH {px()}, {PAIR}, {_wavelets(64, 3)}, src AS (SELECT pair_id, y * 8 + x AS p, a AS m, b AS t FROM pr), {_cw_score('src', 'pair_id', 64, 'sc')}
SELECT pair_id, CAST(i AS INTEGER) AS p, round((2 * ab + 0.01::DOUBLE) / (aa + bb + 0.01::DOUBLE) * ((2 * pl + 0.01::DOUBLE) / (2 * ab + 0.01::DOUBLE)), 6) AS value FROM sc_i"""
ORACLE["translate_chain"] = f"""WITH {px()}, turned AS (SELECT img_id, 7 - x AS y, y AS x, v FROM px), canvas AS (SELECT img_id, y, x FROM (SELECT DISTINCT img_id FROM px), range(8) a(y), range(8) b(x)),
c AS (SELECT n.img_id, n.y, n.x, coalesce(p.v, 1) AS v FROM canvas n LEFT JOIN turned p ON p.img_id = n.img_id AND p.y = n.y + 3 AND p.x = n.x - 2) SELECT img_id, {SUMS.format(w=8)} FROM c GROUP BY img_id"""
ORACLE["compose_text"] = ORACLE["candidate_transforms_n3"].replace("SELECT 1 AS n, name AS names, c AS complexity", "SELECT 'Compose(' || replace(names, '+', '()') || '())' AS text, complexity FROM (SELECT 1 AS n, name AS names, c AS complexity") + ") UNION ALL SELECT 'Compose(Translation(tx=' || tx || ', ty=' || ty || '))', 3 FROM (VALUES (-1), (0), (2)) a(tx), (VALUES (0), (3)) b(ty)"
ORACLE["compose_registered"] = _pixelwise("greatest(a, b)")
