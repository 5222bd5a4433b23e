"""Registered queries of tiled solvers, spectra and chains, each next to its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import features, graph, tiles
from sparkloom.plans import queries as core
from sparkloom.plans.queries import PAIRS, RIDGE, query, table

#: Side of the tiles: the embeddings' 64 dimensions are a grid of two by two.
SIDE = 32
DIMS = 64

_PROBLEM = f"""e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INT AS i FROM embeddings WHERE label IS NOT NULL),
a AS (SELECT i, j, s + CASE WHEN i = j THEN {RIDGE} ELSE 0 END AS v FROM (SELECT x.i AS i, y.i AS j, sum(x.v * y.v) AS s FROM e x JOIN e y USING (vec_id) GROUP BY ALL))"""
#: Gauss-Jordan elimination, a step a column.
_SOLVED = f"""WITH RECURSIVE {_PROBLEM}, t AS (SELECT label, row_number() OVER (ORDER BY label) + {DIMS - 1} AS j FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)),
w AS (SELECT i, j, v FROM a UNION ALL SELECT i, j, sum(v) FROM e JOIN t USING (label) GROUP BY ALL),
m AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(coalesce(v, 0) ORDER BY j) AS r FROM (SELECT DISTINCT i FROM a) CROSS JOIN (SELECT DISTINCT j FROM w) LEFT JOIN w USING (i, j) GROUP BY i)),
g AS (SELECT 1 AS k, m FROM m UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(list_zip(r, m[k]), lambda p: p[1] - p[2] * r[k] / m[k][k]) END) FROM g WHERE k <= len(m))
SELECT i::INT AS feature, label AS target, round(m[i + 1][j + 1], 5) AS x FROM (SELECT m FROM g WHERE m IS NOT NULL ORDER BY k DESC LIMIT 1), range(0, {DIMS}) f(i), t"""
#: Squared again and again, a matrix tends to its leading eigenvector's.
_ENDS = f"""WITH RECURSIVE {_PROBLEM}, m AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(v ORDER BY j) AS r FROM a GROUP BY i)),
c AS (SELECT sqrt(sum(v * v)) AS c FROM a),
pm AS (SELECT 1 AS s, a FROM m UNION ALL SELECT -1, list_transform(a, lambda r, i: list_transform(r, lambda x, j: CASE WHEN i = j THEN c - x ELSE -x END)) FROM m, c),
q AS (SELECT s, 0 AS k, a AS m FROM pm UNION ALL SELECT s, k + 1, list_transform(m, lambda r: list_transform(m, lambda d: list_dot_product(r, d) / list_sum(list_transform(m, lambda x: list_dot_product(x, x))))) FROM q WHERE k < 40),
l AS (SELECT s, list_dot_product(v, list_transform(a, lambda r: list_dot_product(r, v))) / list_dot_product(v, v) AS top FROM (SELECT s, m[1] AS v FROM q WHERE k = 40) JOIN pm USING (s)),
f AS (SELECT (SELECT top FROM l WHERE s = 1) AS largest, c - (SELECT top FROM l WHERE s = -1) AS smallest FROM c)
SELECT round(smallest, 5) AS smallest, round(largest, 5) AS largest, round(largest / smallest, 4) AS condition FROM f WHERE largest IS NOT NULL"""


def _tiled(spark, sf_dir):
    """Tiles of A with its ridge and of B, and their grids; None without labelled rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("x"), F.col("label").alias("target_id"))
    most = rows.agg(F.max("target_id")).first()[0]
    if most is None:
        return None
    grid, right = tiles.Grid(DIMS, DIMS, SIDE, SIDE), tiles.Grid(DIMS, most + 1, SIDE, tiles.column_width(DIMS, SIDE))
    sums = core.tables.cut(features.gram(rows), "gram")
    return core.tables.cut(tiles.from_gram(sums, "A", grid, RIDGE), "tiles"), tiles.from_gram(sums, "B", right), grid, right


def _solution(spark, sf_dir, x, right):
    """(feature, target, x) of the targets that have rows."""
    own = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("int").alias("target")).distinct()
    found = tiles.cells(x, right).select(F.col("i").alias("feature"), F.col("j").alias("target"), F.round("value", 5).alias("x"))
    return found.join(own, "target", "left_semi").select("feature", "target", "x")


@query(_SOLVED)
def ridge_solution(spark, sf_dir):
    """The ridge solution itself, by Cholesky on tiles."""
    problem = _tiled(spark, sf_dir)
    if problem is None:
        return spark.createDataFrame([], "feature int, target int, x double")
    a, b, grid, right = problem
    return _solution(spark, sf_dir, tiles.substitute(tiles.cholesky(a, grid), b, grid, right), right)


@query(_SOLVED)
def pcg_solution(spark, sf_dir):
    """The same by conjugate gradients, with the matrix where it lies."""
    problem = _tiled(spark, sf_dir)
    if problem is None:
        return spark.createDataFrame([], "feature int, target int, x double")
    a, b, grid, right = problem
    return _solution(spark, sf_dir, tiles.block_pcg(a, b, grid, right, tol=1e-9).x, right)


@query(_ENDS)
def spectrum(spark, sf_dir):
    """Both ends of the Gram matrix's spectrum and its condition number, by Lanczos steps."""
    problem = _tiled(spark, sf_dir)
    if problem is None:
        return spark.createDataFrame([], "smallest double, largest double, condition double")
    found = tiles.lanczos(problem[0], problem[2], tol=1e-10)
    return spark.createDataFrame([(round(found.smallest, 5), round(found.largest, 5), round(found.condition, 4))], "smallest double, largest double, condition double")


# ---- chains over the dialog's tokens

ROUNDS = 10
_NEXT = f"""WITH {PAIRS}, tk AS (SELECT ['du:'] || list_filter(string_split_regex("user", '\\s+'), lambda x: x <> '') || ['.', 'bot:'] || list_filter(string_split_regex(bot, '\\s+'), lambda x: x <> '') || ['.'] AS t FROM pairs),
ed AS (SELECT a, b, count(*) AS w FROM (SELECT unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM tk) GROUP BY ALL), o AS (SELECT a, sum(w) AS o FROM ed GROUP BY a), p AS (SELECT a, b, w / o AS p FROM ed JOIN o USING (a)),
nd AS (SELECT a AS node FROM ed UNION SELECT b FROM ed), c AS (SELECT count(*) AS c FROM nd), r0 AS (SELECT node, 1.0::DOUBLE / c AS x, 1.0::DOUBLE / c AS total FROM nd, c)"""
_RANKED = _NEXT + "".join(
    f""", r{k} AS (SELECT node, 0.15 / c + 0.85 * (coalesce(m, 0) + (SELECT coalesce(sum(x), 0) FROM r{k - 1} WHERE node NOT IN (SELECT a FROM o)) / c) AS x FROM nd CROSS JOIN c LEFT JOIN (SELECT b AS node, sum(x * p) AS m FROM p JOIN r{k - 1} ON a = node GROUP BY b) USING (node))"""
    for k in range(1, ROUNDS + 1)
)
_VISITED = _NEXT + "".join(
    f""", r{k} AS (SELECT node, 0.85 * coalesce(m, 0) AS x, total + 0.85 * coalesce(m, 0) AS total FROM (SELECT node, total FROM r{k - 1}) LEFT JOIN (SELECT b AS node, sum(x * p) AS m FROM p JOIN r{k - 1} ON a = node GROUP BY b) USING (node))"""
    for k in range(1, ROUNDS + 1)
)


def _transitions(spark, sf_dir):
    """(a, b, w): how often a token follows another inside a dialog pair."""
    mark = lambda t: F.array(F.lit(t))
    row = F.concat(mark("du:"), tx.words(F.col("user")), mark("."), mark("bot:"), tx.words(F.col("bot")), mark("."))
    steps = core._pairs(spark, sf_dir).select(row.alias("t")).select(F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t")).alias("b"))).alias("s"))
    return steps.groupBy("s.a", "s.b").agg(F.count("*").cast("double").alias("w"))


@query(_RANKED + f" SELECT node AS token, round(x, 9) AS rank FROM r{ROUNDS}")
def token_rank(spark, sf_dir):
    """Stationary weight of the dialog's tokens: damped chain of transitions, ten rounds."""
    chain = graph.Chain(_transitions(spark, sf_dir))
    return graph.pagerank(chain, rounds=ROUNDS).select(F.col("node").alias("token"), F.round("rank", 9).alias("rank"))


@query(_VISITED + f" SELECT node AS token, round(total, 9) AS visits FROM r{ROUNDS}")
def token_visits(spark, sf_dir):
    """Discounted visits of a walk that ends where no token follows: a Neumann series."""
    chain = graph.Chain(_transitions(spark, sf_dir))
    return graph.neumann(chain, rounds=ROUNDS).select(F.col("node").alias("token"), F.round("total", 9).alias("visits"))


# ---- predictions and tensors by blocks

_CENTRES = "c AS (SELECT label, dim, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INT AS dim FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL)"


def _centre_tiles(spark, sf_dir):
    """Tiles of the labels' centres, dimensions x labels, and their grid; None without any."""
    rows = core._centroids(spark, sf_dir).where("label is not null")
    most = rows.agg(F.max("label")).first()[0]
    if most is None:
        return None
    grid = tiles.Grid(DIMS, most + 1, SIDE, 4)
    return core.tables.cut(tiles.from_cells(rows, grid, "dim", "label", "mean"), "centres"), grid


@query(f"""WITH {_CENTRES}, w AS (SELECT label, list(m ORDER BY dim) AS w FROM c GROUP BY label), s AS (SELECT vec_id, e.label, w.label AS target, list_dot_product(embedding::DOUBLE[], w) AS s FROM embeddings e, w),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, target) AS r FROM s)
SELECT vec_id, any_value(label) AS label, max(CASE WHEN r = 1 THEN target END) AS predicted, round(max(s), 6) AS score, coalesce(bool_or(target = label), false) AS in_top3 FROM r WHERE r <= 3 GROUP BY vec_id""")
def block_prediction(spark, sf_dir):
    """The best labels by their centres' weights, which lie in blocks of four labels, with the
    top-3 agreement flag."""
    found = _centre_tiles(spark, sf_dir)
    if found is None:
        return spark.createDataFrame([], "vec_id long, label int, predicted int, score double, in_top3 boolean")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("x"))
    done = features.predict_blocks(rows, *found, keep=("vec_id", "label"))
    agrees = F.coalesce(F.array_contains("top", F.col("label")), F.lit(False))
    return done.select("vec_id", "label", F.get("top", F.lit(0)).alias("predicted"), F.round("top_score", 6).alias("score"), agrees.alias("in_top3"))


_STEP = "pow(2, greatest(floor(log2(abs(m))), -14) - 10)"


@query(f"WITH {_CENTRES} SELECT dim AS i, label AS j, CASE WHEN m = 0 THEN 0 ELSE round_even(m / {_STEP}, 0) * {_STEP} END AS value FROM c")
def tensor_file(spark, sf_dir):
    """The labels' centres written as a half-precision tensor, by bands, and read again."""
    found = _centre_tiles(spark, sf_dir)
    if found is None:
        return spark.createDataFrame([], "i int, j int, value double")
    path = core.tables.fresh_path(spark, "tensor")
    core.sinks.write_tensor(*found, path)
    own = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("int").alias("j")).distinct()
    return core.sinks.read_tensor(spark, path, found[1]).join(own, "j", "left_semi").select("i", "j", (F.col("value") + 0.0).alias("value"))


KERNEL_SIGMA, KERNEL_LEAST = 1.5, 0.9


@query(f"""WITH p AS (SELECT x.vec_id AS a, y.vec_id AS b, exp(-list_sum(list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), lambda p: pow(p[1] - p[2], 2))) / {2 * KERNEL_SIGMA**2}) AS k FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)
SELECT a, b, round(k, 6) AS kernel FROM p WHERE k >= {KERNEL_LEAST}""")
def kernel_pairs(spark, sf_dir):
    """Pairs of embeddings with a Gaussian kernel of 0.9 or more."""
    found = features.kernel_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", KERNEL_SIGMA, KERNEL_LEAST)
    return found.select("a", "b", F.round("kernel", 6).alias("kernel"))
