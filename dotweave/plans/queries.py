"""Registered queries of the point-cloud operators and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotweave.functions.materialise import settle
from dotweave.operators import assign, cells, clustering, coexpression, community, components, graph, landmark, mask, neighbors, polygons, sct
from dotweave.plans import derived
from dotweave.plans.segmentation import Config, Segmentation, communities_of_all, label_spots
from dotweave.sources import spots as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(name: str, as_: str | None = None):
    return (F.round(F.col(name), 6) + 0.0).alias(as_ or name)


D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
D3 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def pairs(name: str, radius: float, d: str = D) -> str:
    """Pairs up to ``radius`` apart, met by squares of that size."""
    square = f"CAST(floor(x / {radius}) AS BIGINT) AS gx, CAST(floor(y / {radius}) AS BIGINT) AS gy"
    around = f"(SELECT s.* REPLACE (gx + u AS gx, gy + v AS gy) FROM (SELECT *, {square} FROM spots) s, (VALUES (-1), (0), (1)) AS i(u), (VALUES (-1), (0), (1)) AS j(v))"
    return f"{name} AS (SELECT a.image_id, a.spot_id AS src, b.spot_id AS dst, {d} AS d, a.gene AS ga, b.gene AS gb FROM (SELECT *, {square} FROM spots) a JOIN {around} b ON a.image_id = b.image_id AND a.gx = b.gx AND a.gy = b.gy AND {d} <= {radius})"


def nearest(name: str, of: str, k: int) -> str:
    return f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY image_id, src ORDER BY d, dst) AS rn FROM {of}) WHERE rn <= {k})"


W = f"WITH {derived.SPOTS}"
PAIRS = pairs("pairs", derived.RADIUS)
EDGES = f"{PAIRS}, {nearest('knn', 'pairs', 10)}"
PROX = f"{pairs('wide', derived.WIDE)}, {nearest('wide40', 'wide', 40)}, prox AS (SELECT image_id, src, gb AS gene, sum(({derived.WIDE} - d) / {derived.WIDE}) AS w FROM wide40 GROUP BY ALL)"


def pearson(values: str, guard: bool) -> str:
    none = "-1.0" if guard else "NULL"
    return f"""
singles AS (SELECT gene, sum(v) AS s, sum(v * v) AS q FROM {values} GROUP BY gene),
crossed AS (SELECT a.gene AS gene_a, b.gene AS gene_b, sum(a.v * b.v) AS p FROM {values} a JOIN {values} b USING (image_id, src) GROUP BY ALL),
moments AS (SELECT x.gene AS gene_a, y.gene AS gene_b, x.s AS sa, y.s AS sb, greatest(x.q / n - (x.s / n) * (x.s / n), 0) AS va, greatest(y.q / n - (y.s / n) * (y.s / n), 0) AS vb, coalesce(p, 0) / n - x.s / n * y.s / n AS cov
  FROM singles x CROSS JOIN singles y CROSS JOIN n LEFT JOIN crossed c ON c.gene_a = x.gene AND c.gene_b = y.gene),
coexpr AS (SELECT gene_a, gene_b, CASE WHEN sqrt(va) * sqrt(vb) > 1e-12 THEN greatest(-1.0, least(1.0, cov / (sqrt(va) * sqrt(vb)))) ELSE {none} END AS corr FROM moments)"""


COEXPR = f"{PROX}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT image_id, src FROM prox)), vals AS (SELECT image_id, src, gene, w AS v FROM prox), {pearson('vals', True)}"
WEIGHTED = f"{COEXPR}, {EDGES}, weighted AS (SELECT image_id, src, dst, d, corr AS weight FROM knn JOIN coexpr ON ga = gene_a AND gb = gene_b)"
FLAT = f"{WEIGHTED}, flat AS (SELECT image_id, least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM weighted WHERE weight >= 0 GROUP BY ALL)"
PART = "part AS (SELECT image_id, spot_id AS node, tile AS com FROM spots)"


# --- scans, vocabulary, masks


@query(f"{W} SELECT image_id, spot_id, round(x, 6) AS x, round(y, 6) AS y, gene, prior FROM spots")
def spots_scan(spark, sf):
    return derived.spots(spark, sf).select("image_id", "spot_id", r6("x"), r6("y"), "gene", "prior")


@query(f"{W} SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS gene_idx FROM (SELECT DISTINCT gene FROM spots)")
def gene_vocabulary(spark, sf):
    return sources.vocabulary(derived.spots(spark, sf))


@query(f"{W} SELECT image_id, count(*) AS n FROM spots GROUP BY image_id HAVING count(*) >= 600")
def images_min_spots(spark, sf):
    return sources.enough_spots(derived.spots(spark, sf), 600).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{W} SELECT image_id, spot_id, CAST(trunc(x / 0.103) AS BIGINT) AS x, CAST(trunc(y / 0.103) AS BIGINT) AS y, CAST(trunc(z / 0.3) AS BIGINT) AS z FROM spots")
def pixel_coords(spark, sf):
    return mask.to_pixels(derived.spots(spark, sf), {"x": 0.103, "y": 0.103, "z": 0.3}).select("image_id", "spot_id", "x", "y", "z")


@query(f"{W} SELECT s.image_id, s.spot_id, coalesce(m.label, 0) AS prior FROM spots s LEFT JOIN mask m ON m.image_id = s.image_id AND m.y = CAST(trunc(s.y) AS BIGINT) AND m.x = CAST(trunc(s.x) AS BIGINT)")
def prior_from_mask(spark, sf):
    return mask.add_prior(derived.spots(spark, sf), derived.mask(spark, sf)).select("image_id", "spot_id", "prior")


@query(f"{W} SELECT image_id, label AS cell, round(avg(z), 6) AS z, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM mask GROUP BY ALL")
def mask_label_centroids(spark, sf):
    return mask.label_centroids(derived.mask(spark, sf)).select("image_id", "cell", r6("z"), r6("y"), r6("x"))


@query(f"{W} SELECT image_id, y, x, max(label) AS label FROM mask GROUP BY ALL")
def mask_max_projection(spark, sf):
    return mask.max_projection(derived.mask(spark, sf))


# --- neighbours and co-expression


def _points(spark, sf):
    return neighbors.as_points(derived.spots(spark, sf))


@query(f"{W}, {PAIRS} SELECT image_id, src, dst, round(d, 6) AS distance FROM pairs")
def radius_neighbors(spark, sf):
    points = _points(spark, sf)
    return neighbors.radius_pairs(points, points, derived.RADIUS).select("image_id", "src", "dst", r6("distance"))


@query(f"{W}, {PAIRS} SELECT image_id, src, dst, round(d, 6) AS distance FROM pairs")
def radius_neighbors_grid(spark, sf):
    points = _points(spark, sf)
    return neighbors.radius_pairs(points, points, derived.RADIUS, method="grid").select("image_id", "src", "dst", r6("distance"))


@query(f"{W}, {PAIRS} SELECT image_id, count(*) AS pairs, CAST(sum(7 * src + 13 * dst) AS BIGINT) AS ids, round(sum(d), 3) AS far FROM pairs GROUP BY image_id")
def radius_neighbor_sums(spark, sf):
    """What radius_neighbors finds in each image, summed up."""
    points = neighbors.as_points(derived.spots(spark, sf))
    near = neighbors.radius_pairs(points, points, derived.RADIUS)
    return near.groupBy("image_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(7 * F.col("src") + 13 * F.col("dst")).alias("ids"), F.round(F.sum("distance"), 3).alias("far"))


@query(f"{W}, {EDGES} SELECT image_id, src, dst, round(d, 6) AS distance FROM knn")
def knn_edges(spark, sf):
    points = _points(spark, sf)
    return neighbors.knn(points, points, 10, derived.RADIUS).select("image_id", "src", "dst", r6("distance"))


@query(f"{W}, {pairs('pairs', derived.RADIUS, D3)}, {nearest('knn', 'pairs', 10)} SELECT image_id, src, dst, round(d, 6) AS distance FROM knn")
def knn_edges_3d(spark, sf):
    points = _points(spark, sf)
    return neighbors.knn(points, points, 10, derived.RADIUS, ("x", "y", "z")).select("image_id", "src", "dst", r6("distance"))


@query(f"{W}, {PROX} SELECT image_id, src, gene, round(w, 6) AS w FROM prox")
def proximity_vectors(spark, sf):
    return coexpression.proximity(derived.spots(spark, sf)).select("image_id", "src", "gene", r6("w"))


def _coexpr(spark, sf, spots=None):
    spots = spots if spots is not None else settle(derived.spots(spark, sf))
    return coexpression.correlation(coexpression.proximity_lists(spots))


@query(f"{W}, {COEXPR} SELECT gene_a, gene_b, round(corr, 6) + 0.0 AS corr FROM coexpr")
def coexpr_pearson(spark, sf):
    return _coexpr(spark, sf).select("gene_a", "gene_b", r6("corr"))


RANKS = "ranks AS (SELECT image_id, src, gene, (n - full_) + r + (ties - 1) / 2 - ((n - full_) + 1) / 2 AS v FROM (SELECT *, rank() OVER (PARTITION BY gene ORDER BY w) AS r, count(*) OVER (PARTITION BY gene, w) AS ties, count(*) OVER (PARTITION BY gene) AS full_ FROM prox WHERE w > 0) CROSS JOIN n)"
ROUNDED = PROX.replace(f"sum(({derived.WIDE} - d) / {derived.WIDE}) AS w", f"round(sum(({derived.WIDE} - d) / {derived.WIDE}), 9) AS w")


@query(f"{W}, {ROUNDED}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT image_id, src FROM prox)), {RANKS}, {pearson('ranks', True)} SELECT gene_a, gene_b, round(corr, 6) + 0.0 AS corr FROM coexpr")
def coexpr_spearman(spark, sf):
    prox = coexpression.proximity_lists(settle(derived.spots(spark, sf).select("image_id", "spot_id", "x", "y", "gene")))
    prox = prox.withColumn("near", F.transform("near", lambda g: F.struct(g["gene"].alias("gene"), F.round(g["w"], 9).alias("w"))))  # rounded, so equal sums are ties
    return coexpression.correlation(prox, "spearman").select("gene_a", "gene_b", r6("corr"))


@query(f"{W}, prox AS (SELECT image_id, tile AS src, gene, count(*) * 1.0 AS w FROM spots WHERE condition = 'R' GROUP BY ALL), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT image_id, src FROM prox)), vals AS (SELECT image_id, src, gene, w AS v FROM prox), {pearson('vals', False)} SELECT gene_a, gene_b, round(corr, 6) + 0.0 AS corr FROM coexpr")
def coexpr_reference_condition(spark, sf):
    table = derived.spots(spark, sf).groupBy("image_id", F.col("tile").alias("src"), "gene", "condition").agg((F.count(F.lit(1)) * 1.0).alias("w"))
    return coexpression.external_correlation(settle(table), condition="R").select("gene_a", "gene_b", r6("corr"))


@query()
def deterministic_sample(spark, sf):
    prox = coexpression.proximity(derived.spots(spark, sf))
    return coexpression.sample_rows(prox, 50, ["image_id", "src"], within="image_id").select("image_id", "src", "gene", r6("w"))


# --- graphs


def _edges(spark, sf, spots=None):
    spots = spots if spots is not None else settle(derived.spots(spark, sf))
    return graph.spot_graph(spots, settle(_coexpr(spark, sf, spots)), 10, derived.RADIUS)


@query(f"{W}, {WEIGHTED} SELECT image_id, src, dst, round(d, 6) AS distance, round(weight, 6) + 0.0 AS weight FROM weighted")
def weighted_edges(spark, sf):
    return _edges(spark, sf).select("image_id", "src", "dst", r6("distance"), r6("weight"))


@query(f"{W}, {FLAT} SELECT image_id, src, dst, round(weight, 6) + 0.0 AS weight FROM flat")
def nonneg_undirected_edges(spark, sf):
    return graph.undirected(_edges(spark, sf)).select("image_id", "src", "dst", r6("weight"))


SUPER = "super AS (SELECT image_id, spot_id, CASE WHEN prior = 0 THEN spot_id ELSE min(spot_id) OVER (PARTITION BY image_id, prior) END AS super_id FROM spots)"


@query(f"{W}, {SUPER} SELECT * FROM super")
def prior_supernodes(spark, sf):
    return graph.prior_supernodes(derived.spots(spark, sf))


@query(f"{W}, {FLAT}, {SUPER} SELECT f.image_id, least(a.super_id, b.super_id) AS src, greatest(a.super_id, b.super_id) AS dst, round(sum(weight), 6) + 0.0 AS weight FROM flat f JOIN super a ON a.image_id = f.image_id AND a.spot_id = src JOIN super b ON b.image_id = f.image_id AND b.spot_id = dst GROUP BY ALL")
def supernode_edge_sum(spark, sf):
    spots = settle(derived.spots(spark, sf))
    return graph.contract_sum(graph.undirected(_edges(spark, sf, spots)), graph.prior_supernodes(spots)).select("image_id", "src", "dst", r6("weight"))


@query(f"{W}, c AS (SELECT image_id, tile, prior, count(*) AS c FROM spots GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, tile ORDER BY CASE WHEN prior = 0 THEN 0 ELSE c END DESC, prior) AS rn FROM c) SELECT image_id, tile, prior FROM k WHERE rn = 1")
def supernode_prior_mode(spark, sf):
    return graph.mode_prior(derived.spots(spark, sf), ["image_id", "tile"])


@query(f"{W}, {EDGES} SELECT k.image_id, a.tile AS src, b.tile AS dst, round(sum(CASE WHEN k.src = k.dst THEN 1.0 ELSE d END), 6) AS weight FROM knn k JOIN spots a ON a.image_id = k.image_id AND a.spot_id = k.src JOIN spots b ON b.image_id = k.image_id AND b.spot_id = k.dst GROUP BY ALL")
def multigraph_collapse(spark, sf):
    spots = derived.spots(spark, sf)
    points = neighbors.as_points(spots)
    near = neighbors.knn(points, points, 10, derived.RADIUS)
    of = spots.select("image_id", "spot_id", "tile")
    met = near.join(of.toDF("image_id", "src", "ta"), ["image_id", "src"]).join(of.toDF("image_id", "dst", "tb"), ["image_id", "dst"])
    multi = met.select("image_id", F.col("ta").alias("src"), F.col("tb").alias("dst"), F.when(F.col("src") != F.col("dst"), F.col("distance")).alias("weight"))
    return graph.collapse(multi).select("image_id", "src", "dst", r6("weight"))


NEIGHBOR = f"{FLAT}, {PART}, both_ AS (SELECT image_id, src AS node, dst AS other, weight FROM flat WHERE src <> dst UNION ALL SELECT image_id, dst, src, weight FROM flat WHERE src <> dst), nw AS (SELECT b.image_id, b.node, p.com, sum(weight) AS w FROM both_ b JOIN part p ON p.image_id = b.image_id AND p.node = b.other GROUP BY ALL)"


def _part(spots):
    return spots.select("image_id", F.col("spot_id").alias("node"), F.col("tile").alias("com"))


@query(f"{W}, {NEIGHBOR} SELECT image_id, node, com, round(w, 6) + 0.0 AS weight FROM nw")
def neighbor_community_weights(spark, sf):
    spots = settle(derived.spots(spark, sf))
    return graph.neighbor_weights(graph.undirected(_edges(spark, sf, spots)), _part(spots)).select("image_id", "node", "com", r6("weight"))


@query(f"{W}, {NEIGHBOR}, most AS (SELECT *, max(w) OVER (PARTITION BY image_id, node) AS most FROM nw) SELECT m.image_id, m.node, m.com, round(CASE WHEN s.prior = 0 THEN 0 WHEN s.prior = m.com THEN most ELSE -most END, 6) + 0.0 AS term FROM most m JOIN spots s ON s.image_id = m.image_id AND s.spot_id = m.node")
def prior_factor(spark, sf):
    spots = settle(derived.spots(spark, sf))
    near = graph.neighbor_weights(graph.undirected(_edges(spark, sf, spots)), _part(spots))
    met = near.withColumn("most", F.expr("max(weight) OVER (PARTITION BY image_id, node)")).join(spots.select("image_id", F.col("spot_id").alias("node"), "prior"), ["image_id", "node"])
    return met.withColumn("term", graph.prior_term(F.col("com"), F.col("prior"), F.col("most"))).select("image_id", "node", "com", r6("term"))


@query(f"""{W}, {FLAT}, {PART}, m AS (SELECT image_id, sum(weight) AS m FROM flat GROUP BY 1),
inner_ AS (SELECT f.image_id, a.com, sum(weight) AS l FROM flat f JOIN part a ON a.image_id = f.image_id AND a.node = src JOIN part b ON b.image_id = f.image_id AND b.node = dst WHERE a.com = b.com GROUP BY ALL),
deg AS (SELECT image_id, node, sum(w) AS k FROM (SELECT image_id, src AS node, weight * CASE WHEN src = dst THEN 2 ELSE 1 END AS w FROM flat UNION ALL SELECT image_id, dst, weight FROM flat WHERE src <> dst) GROUP BY ALL),
coms AS (SELECT d.image_id, com, sum(k) AS k FROM deg d JOIN part p ON p.image_id = d.image_id AND p.node = d.node GROUP BY ALL)
SELECT c.image_id, round(sum(coalesce(l, 0) / m - (k / (2 * m)) * (k / (2 * m))), 6) + 0.0 AS modularity FROM coms c JOIN m ON m.image_id = c.image_id LEFT JOIN inner_ i ON i.image_id = c.image_id AND i.com = c.com GROUP BY ALL""")
def modularity_score(spark, sf):
    spots = settle(derived.spots(spark, sf))
    edges = settle(graph.undirected(_edges(spark, sf, spots)))
    return graph.modularity(edges, _part(spots)).select("image_id", r6("modularity"))


@query()
def louvain_with_prior(spark, sf):
    spots = settle(derived.spots(spark, sf))
    return community.communities(settle(_edges(spark, sf, spots)), spots, with_prior=True)


@query()
def louvain_plain(spark, sf):
    spots = settle(derived.spots(spark, sf))
    return community.communities(settle(_edges(spark, sf, spots)), spots, with_prior=False)


# --- community vectors


def _tiles(spots):
    return spots.select("image_id", "spot_id", F.col("tile").alias("index_commu"))


@query(f"{W} SELECT image_id, tile AS index_commu, gene, count(*) AS n FROM spots GROUP BY ALL")
def community_gene_counts(spark, sf):
    spots = derived.spots(spark, sf)
    return community.gene_counts(spots.drop("tile"), _tiles(spots))


KERNEL = f"{PAIRS}, kern AS (SELECT image_id, src, gb AS gene, sum(({derived.RADIUS} - d) / {derived.RADIUS}) AS w FROM pairs WHERE src <> dst GROUP BY ALL)"


@query(f"{W}, {KERNEL} SELECT image_id, src, gene, round(w, 6) AS w FROM kern")
def kernel_linear(spark, sf):
    return community.kernel(derived.spots(spark, sf), derived.RADIUS).select("image_id", "src", "gene", r6("w"))


@query(f"{W}, {PAIRS} SELECT image_id, src, gb AS gene, round(sum(exp(-0.5 * d * d)), 6) AS w FROM pairs WHERE src <> dst GROUP BY ALL")
def kernel_exp(spark, sf):
    return community.kernel(derived.spots(spark, sf), derived.RADIUS, "exp").select("image_id", "src", "gene", r6("w"))


@query(f"{W}, {KERNEL}, size AS (SELECT image_id, tile, count(*) AS n FROM spots GROUP BY ALL) SELECT s.image_id, s.tile AS index_commu, k.gene, round(sum(w) / any_value(z.n), 6) AS w FROM kern k JOIN spots s ON s.image_id = k.image_id AND s.spot_id = k.src JOIN size z ON z.image_id = s.image_id AND z.tile = s.tile GROUP BY ALL")
def community_kernel_mean(spark, sf):
    spots = derived.spots(spark, sf)
    return community.kernel_mean(community.kernel(spots, derived.RADIUS), _tiles(spots)).select("image_id", "index_commu", "gene", r6("w"))


# --- normalisation

COUNTS = "counts AS (SELECT image_id || '/' || tile AS id, gene, count(*) AS n FROM spots GROUP BY ALL)"


def _counts(spark, sf):
    return derived.spots(spark, sf).groupBy(F.concat_ws("/", "image_id", F.col("tile").cast("string")).alias("id"), "gene").agg(F.count(F.lit(1)).alias("n"))


@query(f"{W}, {COUNTS} SELECT gene, count(*) FILTER (n > 1.01) AS cells FROM counts GROUP BY gene HAVING count(*) FILTER (n > 1.01) >= 20")
def sct_gene_filter(spark, sf):
    return sct.gene_filter(_counts(spark, sf), min_expr=1.01, min_cell=20)


PARAMS = "params AS (SELECT gene, 1.5 + idx * 0.1 AS theta, -2.0 + idx * 0.01 AS b0, 0.9 AS b1 FROM (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS idx FROM (SELECT DISTINCT gene FROM counts)))"


@query(f"{W}, {COUNTS}, {PARAMS}, kept AS (SELECT c.* FROM counts c JOIN params USING (gene)), rows_ AS (SELECT id, log10(sum(n)) AS umi FROM kept GROUP BY id), mu AS (SELECT r.id, p.gene, coalesce(k.n, 0) AS n, theta, exp(b0 + b1 * umi) AS mu FROM rows_ r CROSS JOIN params p LEFT JOIN kept k ON k.id = r.id AND k.gene = p.gene) SELECT id, gene, round((n - mu) / sqrt(mu + mu * mu / theta), 6) + 0.0 AS residual FROM mu")
def sct_residuals_given_params(spark, sf):
    counts = settle(_counts(spark, sf))
    params = sources.vocabulary(counts).select("gene", (1.5 + F.col("gene_idx") * 0.1).alias("theta"), (-2.0 + F.col("gene_idx") * 0.01).alias("b0"), F.lit(0.9).alias("b1"))
    return sct.residuals(counts, settle(params)).select("id", "gene", r6("residual"))


@query()
def sct_fit(spark, sf):
    counts = settle(_counts(spark, sf))
    return sct.fit(counts, sct.gene_filter(counts), sample_size=None, steps=8)


# --- vector clustering


@query()
def pca_project(spark, sf):
    out, _, _ = clustering.pca(derived.vectors(spark, sf), 5)
    return out.select("id", F.transform("pca", lambda v: F.round(v, 6)).alias("pca"))


VEC = "vectors AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, CAST(label AS VARCHAR) AS cluster FROM embeddings), far AS (SELECT a.id AS src, b.id AS dst, a.cluster AS ca, b.cluster AS cb, list_distance(a.vec, b.vec) AS d FROM vectors a JOIN vectors b ON a.id <> b.id)"


@query(f"WITH {VEC}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rn FROM far) SELECT src, dst, round(d, 6) AS distance FROM k WHERE rn <= 20")
def knn_graph_vectors(spark, sf):
    vectors = derived.vectors(spark, sf)
    return clustering.vector_knn(vectors, vectors, 20, exclude_self=True).select("src", "dst", r6("distance"))


#: Each vector's scale by bisection, in one list_reduce; then the union of both directions.
FUZZY = f"""WITH {VEC}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rn FROM far),
lists AS (SELECT src, list(d ORDER BY d, dst) AS ds, coalesce(min(d) FILTER (d > 0), 0) AS first, avg(d) AS mean FROM k WHERE rn <= 19 GROUP BY src),
found AS (SELECT src, first, greatest(list_reduce(list_transform(range({clustering.HALVINGS + 1}), lambda i: {{'lo': CAST(0 AS DOUBLE), 'hi': CAST(-1 AS DOUBLE), 'mid': CAST(1 AS DOUBLE)}}),
  lambda s, x: CASE WHEN list_sum([CASE WHEN e <= first THEN 1 ELSE exp(-(e - first) / s.mid) END FOR e IN ds]) > log2(20) THEN {{'lo': s.lo, 'hi': s.mid, 'mid': (s.lo + s.mid) / 2}}
    WHEN s.hi < 0 THEN {{'lo': s.mid, 'hi': s.hi, 'mid': s.mid * 2}} ELSE {{'lo': s.mid, 'hi': s.hi, 'mid': (s.mid + s.hi) / 2}} END).mid, {clustering.LEAST_SCALE} * mean) AS scale FROM lists),
seen AS (SELECT k.src, dst, CASE WHEN d <= first THEN 1 ELSE exp(-(d - first) / scale) END AS w FROM k JOIN found USING (src) WHERE rn <= 19),
twice AS (SELECT src, dst, w AS a, 0 AS b FROM seen UNION ALL SELECT dst, src, 0, w FROM seen)
SELECT src, dst, round(sum(a) + sum(b) - sum(a) * sum(b), 6) AS weight FROM twice GROUP BY src, dst"""


@query(FUZZY)
def fuzzy_neighbor_weights(spark, sf):
    """The weighted neighbour graph that vectors are clustered on."""
    return clustering.neighbor_graph(settle(derived.vectors(spark, sf))).select("src", "dst", r6("weight"))


@query()
def kmeans_clusters(spark, sf):
    return clustering.cluster(derived.vectors(spark, sf), "kmeans", n_clusters=10)


@query()
def leiden_clusters(spark, sf):
    return clustering.cluster(settle(derived.vectors(spark, sf)), "leiden")


CENTRE = "WITH long AS (SELECT CAST(label AS VARCHAR) AS cluster, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)"


@query(f"{CENTRE} SELECT cluster, pos, round(avg(CAST(v AS DOUBLE)), 6) + 0.0 AS v FROM long GROUP BY ALL")
def cluster_centroid_mean(spark, sf):
    return clustering.centroids(derived.vectors(spark, sf)).select("cluster", F.posexplode("vec").alias("pos", "v")).select("cluster", F.col("pos").cast("bigint").alias("pos"), r6("v"))


@query(f"{CENTRE} SELECT cluster, pos, round(median(CAST(v AS DOUBLE)), 6) + 0.0 AS v FROM long GROUP BY ALL")
def cluster_centroid_median(spark, sf):
    return clustering.centroids(derived.vectors(spark, sf), "median").select("cluster", F.posexplode("vec").alias("pos", "v")).select("cluster", F.col("pos").cast("bigint").alias("pos"), r6("v"))


COSINE = f"{CENTRE}, centre AS (SELECT cluster, list(v ORDER BY pos) AS vec FROM (SELECT cluster, pos, avg(CAST(v AS DOUBLE)) AS v FROM long GROUP BY ALL) GROUP BY cluster), cos AS (SELECT a.cluster AS a, b.cluster AS b, 1 - list_cosine_similarity(a.vec, b.vec) AS distance FROM centre a JOIN centre b ON a.cluster < b.cluster)"


@query(f"{COSINE} SELECT a, b, round(distance, 6) + 0.0 AS distance FROM cos")
def centroid_cosine_distance(spark, sf):
    return clustering.cosine_distances(clustering.centroids(derived.vectors(spark, sf))).select("a", "b", r6("distance"))


#: Cosine similarity from which the clusters of the embeddings are merged here.
MERGE_AT = 0.2


@query(f"""{COSINE.replace('WITH long', 'WITH RECURSIVE long')}, ways AS (SELECT a, b FROM cos WHERE distance <= 1 - {MERGE_AT} UNION ALL SELECT b, a FROM cos WHERE distance <= 1 - {MERGE_AT}),
reach(c, root) AS (SELECT cluster, cluster FROM centre UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.c)
SELECT c AS cluster, min(root) AS root FROM reach GROUP BY c""")
def merge_clusters_threshold(spark, sf):
    """Clusters that merge, by the smallest of them; equal to the threshold's components unless all would merge into one."""
    middle = settle(clustering.centroids(derived.vectors(spark, sf)))
    merged = clustering.merge_clusters(clustering.cosine_distances(middle), middle, MERGE_AT)
    first = merged.groupBy("merged").agg(F.min("cluster").alias("root"))
    return merged.join(first, "merged").select("cluster", "root")


@query(f"WITH {VEC}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rn FROM far), v AS (SELECT src, cb, sum(1 / d) AS w FROM k WHERE rn <= 10 GROUP BY ALL), t AS (SELECT *, sum(w) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, cb) AS rn FROM v) SELECT src AS id, cb AS cluster, round(w / total, 6) AS proba FROM t WHERE rn = 1")
def classify_small_knn(spark, sf):
    """Every vector by its nearest labelled ones, itself left out."""
    vectors = settle(derived.vectors(spark, sf))
    return clustering.classify(vectors.drop("cluster"), vectors, exclude_self=True).select("id", "cluster", r6("proba"))


@query(f"{W} SELECT image_id, spot_id, tile AS index_commu, CASE WHEN tile % 4 = 0 THEN '-1' ELSE CAST(tile % 4 AS VARCHAR) END AS label FROM spots")
def label_spots_by_community(spark, sf):
    spots = derived.spots(spark, sf)
    labels = spots.select("image_id", F.col("tile").alias("index_commu")).distinct().where("index_commu % 4 <> 0").withColumn("label", (F.col("index_commu") % 4).cast("string"))
    return label_spots(spots.select("image_id", "spot_id"), _tiles(spots), labels)


# --- landmarks and assignment

C = "sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y))"


def around(name: str, reach: float) -> str:
    return f"{name} AS (SELECT * FROM (SELECT c.image_id, c.cell, s.spot_id, s.label, s.prior, {C} AS d, row_number() OVER (PARTITION BY c.image_id, c.cell ORDER BY {C}, s.spot_id) AS rn FROM centroids c JOIN spots s ON c.image_id = s.image_id AND {C} <= {reach}) WHERE rn <= 15)"


VOTE = f"{around('near7', 7.5)}, weights AS (SELECT image_id, cell, label, sum(7.5 - d) AS w FROM near7 GROUP BY ALL), votes AS (SELECT c.image_id, c.cell, coalesce(v.label, 'unknown') AS label, coalesce(w, 0) AS votes FROM centroids c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY image_id, cell ORDER BY round(w, 9) DESC, label) AS rn FROM weights) v ON v.image_id = c.image_id AND v.cell = c.cell AND rn = 1)"
LINKS = f"{around('near15', 15.0)}, links AS (SELECT image_id, cell, spot_id, CASE WHEN prior = cell THEN 0.0 ELSE d END AS distance FROM near15)"
NODE = "CASE WHEN prior > 0 THEN -prior ELSE spot_id END"
CONTRACT = f"{EDGES}, {LINKS}, nodeof AS (SELECT image_id, spot_id, {NODE} AS node FROM spots), loose AS (SELECT k.image_id, a.node AS na, b.node AS nb, d AS distance FROM knn k JOIN nodeof a ON a.image_id = k.image_id AND a.spot_id = k.src JOIN nodeof b ON b.image_id = k.image_id AND b.spot_id = k.dst UNION ALL SELECT l.image_id, -cell, n.node, distance FROM links l JOIN nodeof n ON n.image_id = l.image_id AND n.spot_id = l.spot_id), cedges AS (SELECT image_id, least(na, nb) AS a, greatest(na, nb) AS b, min(distance) AS distance FROM loose WHERE na <> nb GROUP BY ALL)"
NODES = f"{VOTE}, own AS (SELECT image_id, {NODE} AS node, min(label) AS label FROM spots GROUP BY ALL), nodes AS (SELECT coalesce(o.image_id, v.image_id) AS image_id, coalesce(o.node, -v.cell) AS node, coalesce(o.label, v.label) AS label FROM own o FULL JOIN votes v ON v.image_id = o.image_id AND -v.cell = o.node)"
SAME = "same AS (SELECT e.image_id, a, b, distance FROM cedges e JOIN nodes x ON x.image_id = e.image_id AND x.node = a JOIN nodes y ON y.image_id = e.image_id AND y.node = b WHERE x.label = y.label)"
PATHS = f"""WITH RECURSIVE {derived.SPOTS}, {CONTRACT}, {NODES}, {SAME}, ways AS (SELECT image_id, a AS u, b AS v, distance AS d FROM same UNION ALL SELECT image_id, b, a, distance FROM same),
path_(image_id, node, dist, cell) USING KEY (image_id, node) AS (
  SELECT image_id, node, CAST(0 AS DOUBLE), -node FROM nodes WHERE node < 0
  UNION
  SELECT n.image_id, n.v, n.s.dist, n.s.cell FROM (SELECT p.image_id, w.v, min({{'dist': p.dist + w.d, 'cell': p.cell}}) AS s FROM path_ p JOIN ways w ON w.image_id = p.image_id AND w.u = p.node WHERE p.dist + w.d <= 15 GROUP BY ALL) n
  LEFT JOIN recurring.path_ r ON r.image_id = n.image_id AND r.node = n.v WHERE r.node IS NULL OR n.s < {{'dist': r.dist, 'cell': r.cell}})"""
ASSIGNED = f"{PATHS}, assigned AS (SELECT s.*, coalesce(p.cell, 0) AS cell_index_pred, p.dist FROM spots s LEFT JOIN path_ p ON p.image_id = s.image_id AND p.node = CASE WHEN s.prior > 0 THEN -s.prior ELSE s.spot_id END)"
CELLS = f"{ASSIGNED}, counted AS (SELECT image_id, cell_index_pred AS cell, gene, count(*) AS n FROM assigned WHERE cell_index_pred > 0 GROUP BY ALL), cellgene AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY image_id, cell) AS total FROM counted) WHERE total >= 5)"


@query(f"{W}, {VOTE} SELECT image_id, cell, label, round(votes, 6) AS votes FROM votes")
def landmark_vote(spark, sf):
    return landmark.landmark_vote(derived.spots(spark, sf), derived.centroids(spark, sf)).select("image_id", "cell", "label", r6("votes"))


@query(f"{W}, {LINKS} SELECT image_id, cell, spot_id, round(distance, 6) AS distance FROM links")
def landmark_edges(spark, sf):
    return landmark.landmark_edges(derived.spots(spark, sf), derived.centroids(spark, sf)).select("image_id", "cell", "spot_id", r6("distance"))


def _contracted(spark, sf):
    spots, centres = settle(derived.spots(spark, sf)), derived.centroids(spark, sf)
    points = neighbors.as_points(spots.withColumn("node", assign.node_of()))
    near = neighbors.knn(points, points, 10, derived.RADIUS, carry=["node"], own=["node"]).withColumnsRenamed({"src_node": "na", "node": "nb"})
    links = landmark.landmark_edges(spots, centres)
    return spots, centres, assign.contract_min(near, spots, links), assign.contract_nodes(spots, landmark.landmark_vote(spots, centres))


@query(f"{W}, {CONTRACT} SELECT image_id, a, b, round(distance, 6) AS distance FROM cedges")
def contract_min_distance(spark, sf):
    _, _, edges, _ = _contracted(spark, sf)
    return edges.select("image_id", "a", "b", r6("distance"))


@query(f"WITH RECURSIVE {derived.SPOTS}, {CONTRACT}, {NODES}, {SAME}, ways AS (SELECT image_id, a AS u, b AS v FROM same UNION ALL SELECT image_id, b, a FROM same), comp(image_id, node, root) USING KEY (image_id, node) AS (SELECT image_id, node, node FROM nodes UNION SELECT n.image_id, n.v, n.m FROM (SELECT c.image_id, w.v, min(c.root) AS m FROM comp c JOIN ways w ON w.image_id = c.image_id AND w.u = c.node GROUP BY ALL) n JOIN recurring.comp r ON r.image_id = n.image_id AND r.node = n.v WHERE n.m < r.root) SELECT image_id, node, root AS component FROM comp")
def label_components(spark, sf):
    _, _, edges, nodes = _contracted(spark, sf)
    nodes = settle(nodes)
    links = assign.same_label(edges, nodes).select("image_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    return components.label_components(links, nodes)


def _paths(spark, sf, method="auto"):
    spots, centres, edges, nodes = _contracted(spark, sf)
    return spots, centres, assign.shortest_paths(edges, settle(nodes), method=method)


@query(f"{PATHS} SELECT image_id, node, round(dist, 6) AS dist FROM path_")
def shortest_path_bounded(spark, sf):
    return _paths(spark, sf)[2].select("image_id", "node", r6("dist"))


@query(f"{PATHS} SELECT image_id, node, round(dist, 6) AS dist FROM path_")
def shortest_path_joins(spark, sf):
    return _paths(spark, sf, "joins")[2].select("image_id", "node", r6("dist"))


def _assigned(spark, sf):
    spots, centres, paths = _paths(spark, sf)
    return assign.assign_spots(spots, paths), centres


@query(f"{ASSIGNED} SELECT image_id, spot_id, cell_index_pred, round(coalesce(dist, 'infinity'), 6) AS distance2centroid FROM assigned")
def assign_spots(spark, sf):
    return _assigned(spark, sf)[0].select("image_id", "spot_id", "cell_index_pred", F.round("distance2centroid", 6).alias("distance2centroid"))


@query(f"{CELLS} SELECT image_id, cell, gene, n FROM cellgene")
def cell_gene_counts(spark, sf):
    return cells.cell_genes(*_assigned(spark, sf))


BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


@query(f"{CELLS} SELECT image_id, cell, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (gene = '{b}'), 0) AS BIGINT) AS \"{b}\"" for b in BRANDS) + " FROM cellgene GROUP BY image_id, cell")
def cell_by_gene(spark, sf):
    """How many RNA of each gene each cell contains."""
    return cells.cell_by_gene(cells.cell_genes(*_assigned(spark, sf)), BRANDS)


@query(f"{CELLS} SELECT k.image_id, k.cell, CAST(sum(n) AS BIGINT) AS n_rna, count(*) AS n_genes, any_value(c.z) AS centroid_z, any_value(c.y) AS centroid_y, any_value(c.x) AS centroid_x, k.cell AS CellID, k.image_id || '_' || k.cell AS Name, k.image_id AS image_name FROM cellgene k JOIN centroids c ON c.image_id = k.image_id AND c.cell = k.cell GROUP BY k.image_id, k.cell")
def cell_obs(spark, sf):
    assigned, centres = _assigned(spark, sf)
    return cells.cell_obs(cells.cell_genes(assigned, centres), centres)


@query(f"{ASSIGNED} SELECT image_id, spot_id AS node_index, gene, prior, label, cell_index_pred, round(coalesce(dist, 'infinity'), 6) AS distance2centroid FROM assigned")
def spots_export(spark, sf):
    assigned, centres = _assigned(spark, sf)
    return cells.spots_export(assigned, centres).select("image_id", "node_index", "gene", "prior", "label", "cell_index_pred", F.round("distance2centroid", 6).alias("distance2centroid"))


@query(f"{CELLS} SELECT image_id, count(DISTINCT cell) AS cells, CAST(sum(n) AS BIGINT) AS rna FROM cellgene GROUP BY image_id")
def union_images(spark, sf):
    """Two runs, each over its own images, as one table."""
    assigned, centres = _assigned(spark, sf)
    assigned = settle(assigned)
    runs = [cells.cell_genes(assigned.where(F.pmod(F.xxhash64("image_id"), F.lit(2)) == k), centres) for k in (0, 1)]
    return communities_of_all(runs).groupBy("image_id").agg(F.count_distinct("cell").alias("cells"), F.sum("n").alias("rna"))


def _outlined(spark, sf):
    assigned, centres = _assigned(spark, sf)
    assigned = settle(assigned)
    kept = settle(cells.cell_genes(assigned, centres)).select("image_id", "cell").distinct()
    return assigned.where("cell_index_pred > 0").select("image_id", F.col("cell_index_pred").alias("cell"), "x", "y").join(kept, ["image_id", "cell"])


#: A hull's edges have no point on their right and, on their line, none outside; its area is theirs.
HULL = f"""{CELLS}, p AS (SELECT DISTINCT a.image_id, cell_index_pred AS cell, x, y FROM assigned a JOIN (SELECT DISTINCT image_id, cell FROM cellgene) k ON k.image_id = a.image_id AND k.cell = a.cell_index_pred),
e AS (SELECT a.image_id, a.cell, a.x AS ax, a.y AS ay, b.x AS ux, b.y AS uy, b.x - a.x AS dx, b.y - a.y AS dy FROM p a JOIN p b ON a.image_id = b.image_id AND a.cell = b.cell AND (a.x <> b.x OR a.y <> b.y)),
s AS (SELECT e.*, min(dx * (y - ay) - dy * (x - ax)) AS lowest, max(CASE WHEN abs(dx * (y - ay) - dy * (x - ax)) <= 1e-9 AND ((x - ax) * dx + (y - ay) * dy < -1e-9 OR (x - ax) * dx + (y - ay) * dy > dx * dx + dy * dy + 1e-9) THEN 1 ELSE 0 END) AS beyond FROM e JOIN p USING (image_id, cell) GROUP BY ALL),
h AS (SELECT image_id, cell, sum(ax * uy - ux * ay) / 2 AS area FROM s WHERE lowest >= -1e-9 AND beyond = 0 GROUP BY image_id, cell)
SELECT image_id, cell, round(area, 6) + 0.0 AS area FROM h WHERE area > 1e-9"""


@query(HULL)
def cell_hull_area(spark, sf):
    return polygons.outlines(_outlined(spark, sf), alpha=0).select("image_id", "cell", r6("area"))


@query()
def cell_polygons_json(spark, sf):
    return polygons.geojson(polygons.without_overlap(settle(_outlined(spark, sf)), alpha=0.2))


@query()
def segment_cells(spark, sf):
    """The whole dataflow with its defaults, from spots to the cells' table and outlines."""
    keep = ["image_id", "spot_id", "x", "y", "gene", "prior"]
    run = Segmentation(settle(derived.spots(spark, sf).select(*keep)), derived.centroids(spark, sf), Config.of({"allow_disconnected_polygon": True}))
    out = run.run_all()
    shapes = out["polygons"].select("image_id", "cell", r6("area"))
    return out["obs"].select("image_id", "cell", "n_rna", "n_genes").join(shapes, ["image_id", "cell"], "left")
