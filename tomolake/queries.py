"""Queries that apply each operator to the tables, and the SQL that says the same."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.functions.expressions import positive_log
from tomolake.operators import estep, geometry, mstep, report, scans, symmetry, timeline
from tomolake.plans import artefacts, em, initial, project
from tomolake.plans.store import Store, put
from tomolake.sources import arrays
from tomolake.sources import tables as T
from tomolake.sources.versions import Versioned
from tomolake.streaming import logs
from tomolake.streaming import photons as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def seconds():
    """Seconds since 1970 of events.ts, a time without a zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1e6")


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# SQL of the adapters: photons and templates of embeddings, of lineitem, and what hangs on them.
PH = "ph AS (SELECT vec_id AS d, (u.i - 1)::INT AS i, floor(abs(embedding[u.i]::DOUBLE) * 20)::INT AS k FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u WHERE floor(abs(embedding[u.i]::DOUBLE) * 20) > 0)"
TM = "tm AS (SELECT label AS r, (u.i - 1)::INT AS i, avg(abs(embedding[u.i]::DOUBLE)) AS w FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u GROUP BY ALL)"
WT = "wt AS (SELECT range::INT AS i, 1 - range / 128.0::DOUBLE AS c FROM range(64))"
FR = "fr AS (SELECT d, sum(k)::BIGINT AS ksum, count(*) AS lit FROM ph GROUP BY d)"
FL = "fl AS (SELECT d, ksum, 0.5::DOUBLE + (d % 10) / 10.0::DOUBLE AS fluence FROM fr)"
WS = "ws AS (SELECT r, sum(c * w) AS wsum FROM tm JOIN wt USING (i) GROUP BY r)"
KW = "kw AS (SELECT d, r, sum(k * CASE WHEN w > 0 THEN ln(w) ELSE 0 END) AS kw FROM ph JOIN tm USING (i) GROUP BY d, r)"
LR = "lr AS (SELECT d, r, kw - ksum * CASE WHEN wsum > 0 THEN ln(wsum) ELSE 0 END AS logr FROM kw JOIN fr USING (d) JOIN ws USING (r))"
PO = """p1 AS (SELECT d, r, logr, exp(logr - max(logr) OVER (PARTITION BY d)) AS p FROM lr),
p2 AS (SELECT d, r, logr, CASE WHEN p < 0.05 THEN 0 ELSE p END AS p FROM p1),
po AS (SELECT * FROM (SELECT d, r, logr, p / sum(p) OVER (PARTITION BY d) AS p FROM p2) WHERE p > 0)"""
VX = "vx AS (SELECT r, i, ((r * 7 + i) % 48)::BIGINT AS n FROM tm)"
A = f"WITH {PH}, {TM}, {WT}, {FR}, {FL}, {WS}, {KW}, {LR}, {PO}, {VX}"
BP = "ph AS (SELECT l_suppkey AS d, (l_partkey % 16)::INT AS i, count(*)::INT AS k FROM lineitem GROUP BY ALL)"
BT = "tm AS (SELECT l_linenumber AS r, (l_partkey % 16)::INT AS i, avg(l_quantity) AS w FROM lineitem GROUP BY ALL)"
BW = "wt AS (SELECT range::INT AS i, 1 - range / 128.0::DOUBLE AS c FROM range(16))"
BG = "bg AS (SELECT n_nationkey AS b, range::INT AS i, ((n_nationkey * 7 + range * 3) % 11) / 10.0::DOUBLE AS v FROM nation, range(16))"
BF = "fr AS (SELECT d, ksum, 0.5::DOUBLE + (d % 10) / 10.0::DOUBLE AS fluence, s_nationkey AS bg_id, 0.5::DOUBLE + abs(s_acctbal) / 10000.0::DOUBLE AS bg_weight FROM (SELECT d, sum(k)::BIGINT AS ksum FROM ph GROUP BY d) JOIN supplier ON s_suppkey = d)"
BL = """lr AS (SELECT d, r, kw - ksum * ln(wsum) AS logr FROM (SELECT d, r, sum(k * ln(w)) AS kw FROM ph JOIN tm USING (i) GROUP BY d, r)
  JOIN fr USING (d) JOIN ws USING (r))"""
BPO = "po AS (SELECT d, r, p / sum(p) OVER (PARTITION BY d) AS p FROM (SELECT d, r, exp(0.5 * (logr - max(logr) OVER (PARTITION BY d))) AS p FROM lr))"
B = f"WITH {BP}, {BT}, {BW}, {BG}, {BF}, {WS}, {BL}, {BPO}, {VX}"


class Embeddings:
    """The embedding adapter's inputs; every one is lazy, and what a query does not read is not computed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.photons, self.templates = T.embedding_photons(spark, sf_dir), T.embedding_templates(spark, sf_dir)
        self.weights = T.pixel_weights(64, spark)
        self.frames = estep.frame_sums(self.photons)
        self.fluent = self.frames.select("d", "ksum", (0.5 + F.col("d") % 10 / 10.0).alias("fluence"))
        self.sums = estep.template_sums(self.templates, self.weights)
        self.voxels = self.templates.select("r", "i", ((F.col("r") * 7 + F.col("i")) % 48).cast("long").alias("n"))

    @property
    def kw(self) -> DataFrame:
        return estep.k_dot_log_w(self.photons, self.templates)

    @property
    def logr(self) -> DataFrame:
        return estep.log_likelihood(self.kw, self.frames, self.sums, "Poisson_fluence_free")

    def post(self, beta: float = 1.0, threshold: float = 0.05) -> DataFrame:
        return estep.posterior(self.logr, beta, threshold)

    @property
    def classes(self) -> DataFrame:
        return self.templates.select("r").distinct().select("r", (F.col("r") % 2).alias("c"))


class Lineitems:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.photons, self.templates = T.lineitem_photons(spark, sf_dir), T.lineitem_templates(spark, sf_dir)
        self.weights, self.background = T.pixel_weights(16, spark), T.background_dictionary(spark, sf_dir)
        sums = estep.frame_sums(self.photons).select("d", "ksum", (0.5 + F.col("d") % 10 / 10.0).alias("fluence"))
        self.frames = sums.join(T.supplier_frames(spark, sf_dir), "d")
        self.sums = estep.template_sums(self.templates, self.weights)
        self.voxels = self.templates.select("r", "i", ((F.col("r") * 7 + F.col("i")) % 48).cast("long").alias("n"))

    @property
    def post(self) -> DataFrame:
        logr = estep.log_likelihood(estep.k_dot_log_w(self.photons, self.templates), self.frames, self.sums, "Poisson_fluence_free")
        return estep.posterior(logr, 0.5)


# ---- frames and photons


@query(f"WITH {PH}, {FR} SELECT d, ksum, lit FROM fr")
def photon_sums(spark, sf):
    return Embeddings(spark, sf).frames


@query(f"WITH {PH}, {FR} SELECT d, i, k FROM ph WHERE d IN (SELECT d FROM fr WHERE ksum >= 90)")
def frame_filter(spark, sf):
    e = Embeddings(spark, sf)
    return T.select_frames(e.photons, e.frames.where("ksum >= 90"))


@query(f"WITH {PH} SELECT d, coalesce(sum((k >= 3)::INT), 0) >= 10 AS saturated FROM ph GROUP BY d")
def saturation(spark, sf):
    return report.saturated(Embeddings(spark, sf).photons, 3, 10)


@query(f"WITH {PH} SELECT f.d, g.i::INT AS i, coalesce(ph.k, 0) AS k FROM (SELECT DISTINCT d FROM ph) f CROSS JOIN (SELECT range AS i FROM range(64)) g LEFT JOIN ph ON ph.d = f.d AND ph.i = g.i")
def densify_frames(spark, sf):
    return T.densify(Embeddings(spark, sf).photons, 64)


@query(f"WITH {PH}, {FR} SELECT d, lit, coalesce(sum(lit) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM fr")
def csr_offsets(spark, sf):
    return report.running_offsets(Embeddings(spark, sf).frames.select("d", "lit"), "d", "lit", 128)


@query(f"""WITH {BP}, pt AS (SELECT d, greatest(1, sum(k) // 50)::BIGINT AS parts FROM ph GROUP BY d) SELECT d, part, i, count(*) AS k FROM (
  SELECT d, i, ('0x' || substr(md5('0:' || d || ':' || i || ':' || u.j), 1, 8))::BIGINT % parts AS part
  FROM ph JOIN pt USING (d), LATERAL (SELECT unnest(range(0, k)) AS j) u) GROUP BY ALL""")
def split_frames(spark, sf):
    return mstep.split_frames(T.lineitem_photons(spark, sf), 50)


@query(f"WITH {BP}, {BG}, {BF} SELECT d, bg.i, round(bg_weight * v, 8) AS background FROM fr JOIN bg ON bg_id = b")
def background_frames(spark, sf):
    b = Lineitems(spark, sf)
    return b.frames.join(b.background, F.col("bg_id") == F.col("b")).select("d", "i", F.round(F.col("bg_weight") * F.col("v"), 8).alias("background"))


@query(f"WITH {BP}, {BG}, {BF} SELECT d, round(bg_weight * vsum, 8) AS bsum FROM fr JOIN (SELECT b, sum(v) AS vsum FROM bg GROUP BY b) ON bg_id = b")
def background_sums(spark, sf):
    b = Lineitems(spark, sf)
    totals = b.background.groupBy("b").agg(F.sum("v").alias("vsum"))
    return b.frames.join(totals, F.col("bg_id") == F.col("b")).select("d", F.round(F.col("bg_weight") * F.col("vsum"), 8).alias("bsum"))


# ---- expectation


@query(f"{A} SELECT r, round(wsum, 6) AS wsum FROM ws")
def tomogram_sums(spark, sf):
    return Embeddings(spark, sf).sums.select("r", *r6("wsum"))


@query(f"{A} SELECT d, r, round(kw, 6) AS kw FROM kw")
def k_dot_logw(spark, sf):
    return Embeddings(spark, sf).kw.select("d", "r", *r6("kw"))


@query(f"{A} SELECT d, r, round(kw, 6) AS kw FROM kw")
def k_dot_logw_blocks(spark, sf):
    e = Embeddings(spark, sf)
    return estep.k_dot_log_w_blocks(e.photons, e.templates).select("d", "r", *r6("kw"))


@query(f"{A} SELECT d, r, round(logr, 6) AS logr FROM lr")
def logr_fluence_free(spark, sf):
    return Embeddings(spark, sf).logr.select("d", "r", *r6("logr"))


@query(f"{A} SELECT d, r, round(kw - wsum, 6) AS logr FROM kw JOIN ws USING (r)")
def logr_poisson(spark, sf):
    e = Embeddings(spark, sf)
    return estep.log_likelihood(e.kw, e.frames, e.sums).select("d", "r", *r6("logr"))


@query(f"{A} SELECT d, r, round(kw - fluence * wsum, 6) AS logr FROM kw JOIN fl USING (d) JOIN ws USING (r)")
def logr_fluence(spark, sf):
    e = Embeddings(spark, sf)
    return estep.log_likelihood(e.kw, e.fluent, e.sums, frame_model="fluence").select("d", "r", *r6("logr"))


_BGL = """, lit AS (SELECT ph.d, ph.i, k, c, fluence, bg_weight * v / (fluence * c) AS extra FROM ph JOIN fr USING (d) JOIN bg ON bg_id = b AND bg.i = ph.i JOIN wt ON wt.i = ph.i),
dots AS (SELECT d, r, sum(k * (ln(w + extra) + ln(c))) AS kf FROM lit JOIN tm USING (i) WHERE w + extra > 0 GROUP BY d, r),
known AS (SELECT d, ksum, fluence, bg_weight * vsum AS bsum FROM fr JOIN (SELECT b, sum(v) AS vsum FROM bg GROUP BY b) ON bg_id = b)"""


@query(f"{B}{_BGL} SELECT d, r, round(kf + ksum * ln(fluence) - (fluence * wsum + bsum), 5) AS logr FROM dots JOIN known USING (d) JOIN ws USING (r)")
def logr_background(spark, sf):
    b = Lineitems(spark, sf)
    found = estep.log_likelihood_background(b.photons, b.templates, b.weights, b.frames, b.background, b.sums)
    return found.select("d", "r", F.round("logr", 5).alias("logr"))


@query(f"{B}{_BGL} SELECT d, r, round(kf + ksum * ln(fluence) - ksum * ln(fluence * wsum + bsum), 5) AS logr FROM dots JOIN known USING (d) JOIN ws USING (r)")
def logr_background_fluence_free(spark, sf):
    b = Lineitems(spark, sf)
    found = estep.log_likelihood_background(b.photons, b.templates, b.weights, b.frames, b.background, b.sums, True)
    return found.select("d", "r", F.round("logr", 5).alias("logr"))


@query(f"{A} SELECT d, r, round(p, 6) AS p FROM po")
def posterior(spark, sf):
    return Embeddings(spark, sf).post().select("d", "r", *r6("p"))


@query(f"{A}, q1 AS (SELECT d, r, p, max(p) OVER (PARTITION BY d) AS most FROM p1) SELECT d, r, round(CASE WHEN p < 0.2 * most THEN 0 ELSE p END / sum(CASE WHEN p < 0.2 * most THEN 0 ELSE p END) OVER (PARTITION BY d), 6) AS p FROM q1")
def posterior_dense(spark, sf):
    return estep.posterior(Embeddings(spark, sf).logr, 1.0, 0.2, keep_zero=True).select("d", "r", *r6("p"))


@query(f"{A} SELECT d, r, round(p, 6) AS p FROM po QUALIFY row_number() OVER (PARTITION BY d ORDER BY p DESC, r) = 1")
def most_likely(spark, sf):
    return estep.most_likely(Embeddings(spark, sf).post()).select("d", "r", *r6("p"))


@query(f"{A} SELECT d, r % 2 AS c, round(sum(p), 6) AS p FROM po GROUP BY ALL")
def occupancy_dc(spark, sf):
    e = Embeddings(spark, sf)
    return estep.class_occupancy(e.post(), e.classes).select("d", "c", *r6("p"))


@query(f"{A} SELECT r, round(sum(p), 6) AS p FROM po GROUP BY r")
def occupancy_r(spark, sf):
    return estep.template_occupancy(Embeddings(spark, sf).post()).select("r", *r6("p"))


@query(f"{A} SELECT d, round(sum(p * logr), 6) AS q FROM po GROUP BY d")
def expected_loglik(spark, sf):
    return estep.expected_loglik(Embeddings(spark, sf).post()).select("d", *r6("q"))


@query(f"{A} SELECT round((SELECT avg(q) FROM (SELECT sum(p * logr) AS q FROM po GROUP BY d)), 6) AS q, round((SELECT avg(m) FROM (SELECT max(p) AS m FROM po GROUP BY d)), 6) AS p_max")
def iteration_summary(spark, sf):
    post = Embeddings(spark, sf).post()
    each = post.groupBy("d").agg(F.sum(F.col("p") * F.col("logr")).alias("q"), F.max("p").alias("p_max"))
    return each.agg(F.round(F.avg("q"), 6).alias("q"), F.round(F.avg("p_max"), 6).alias("p_max"))


@query("WITH it AS (SELECT DISTINCT (o_orderkey // 500)::INT AS i FROM orders) SELECT i, round(0.001 * power(0.1 / 0.001, i / greatest((SELECT max(i) FROM it), 1)::DOUBLE), 9) AS beta FROM it")
def beta_schedule(spark, sf):
    """The temperature of every iteration that orders were assigned in."""
    done = T.read(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 500).cast("int").alias("i")).distinct()
    betas = estep.beta_schedule(done.agg(F.max("i")).first()[0] + 1, 0.001, 0.1)
    return done.join(spark.createDataFrame(list(enumerate(betas)), "i int, beta double"), "i").select("i", F.round("beta", 9).alias("beta"))


# ---- maximisation

_NUM = ", num AS (SELECT r, i, sum(p * k) AS num FROM po JOIN ph USING (d) GROUP BY r, i)"


@query(f"{A} SELECT d, round(ksum / sum(p * wsum), 6) AS fluence FROM po JOIN ws USING (r) JOIN fr USING (d) GROUP BY d, ksum")
def fluence_update(spark, sf):
    e = Embeddings(spark, sf)
    return mstep.fluence(e.post(), e.frames, e.sums).select("d", *r6("fluence"))


@query(f"{A}{_NUM} SELECT r, i, round(num, 6) AS num FROM num")
def k_dot_p(spark, sf):
    e = Embeddings(spark, sf)
    return mstep.weighted_sums(e.post(), e.photons).select("r", "i", *r6("num"))


def _merge_sql(mass: str, num: str = "num", value: str = "sum(num) / CASE WHEN sum(den) = 0 THEN 1 ELSE sum(den) END") -> str:
    return f"""{A}{_NUM}, den AS (SELECT r, sum({mass}) AS mass FROM po JOIN fl USING (d) GROUP BY r),
    cells AS (SELECT n, coalesce({num}, 0) AS num, c * mass AS den FROM vx JOIN den USING (r) JOIN wt USING (i) JOIN ws USING (r) LEFT JOIN num USING (r, i))
    SELECT n, round({value}, 6) AS value FROM cells GROUP BY n"""


def _merged(spark, sf, **options) -> DataFrame:
    e = Embeddings(spark, sf)
    return mstep.merged_model(e.post(), e.photons, e.fluent, e.sums, e.weights, e.voxels, **options).select("n", *r6("value"))


@query(_merge_sql("p"))
def merge_poisson(spark, sf):
    return _merged(spark, sf)


@query(_merge_sql("fluence * p"))
def merge_fluence(spark, sf):
    return _merged(spark, sf, frame_model="fluence")


@query(_merge_sql("ksum * p", "num * wsum"))
def merge_fluence_free(spark, sf):
    return _merged(spark, sf, likelihood="Poisson_fluence_free")


@query(_merge_sql("p", value="avg(num / CASE WHEN den = 0 THEN 1 ELSE den END)"))
def merge_maximise_w(spark, sf):
    return _merged(spark, sf, maximise="W")


_TERMS = ", terms AS (SELECT n, p * k AS a, bg_weight * v / (fluence * c) AS b FROM ph JOIN fr USING (d) JOIN bg ON bg_id = bg.b AND bg.i = ph.i JOIN wt ON wt.i = ph.i JOIN po USING (d) JOIN vx ON vx.r = po.r AND vx.i = ph.i)"


@query(f"{B}{_TERMS} SELECT n, count(*) AS terms, round(sum(a), 5) AS a, round(sum(a * b), 5) AS ab FROM terms GROUP BY n")
def bg_terms(spark, sf):
    b = Lineitems(spark, sf)
    terms = mstep.background_terms(b.post, b.photons, b.frames, b.background, b.weights, b.voxels)
    return terms.groupBy("n").agg(F.count("*").alias("terms"), F.round(F.sum("a"), 5).alias("a"), F.round(F.sum(F.col("a") * F.col("b")), 5).alias("ab"))


@query(f"{B}, mass AS (SELECT r, sum(fluence * p) AS mass FROM po JOIN fr USING (d) GROUP BY r) SELECT n, round(sum(c * mass), 5) AS c FROM vx JOIN mass USING (r) JOIN wt USING (i) GROUP BY n")
def bg_cn(spark, sf):
    b = Lineitems(spark, sf)
    return mstep.background_constants(b.post, b.frames, b.weights, b.voxels).select("n", F.round("c", 5).alias("c"))


@query("""WITH t AS (SELECT s_suppkey AS n, abs(s_acctbal) + 1 AS a1, abs(s_acctbal) / 2 + 3 AS a2, s_suppkey % 3 AS b1, 1 + s_suppkey % 5 AS b2, 100.0::DOUBLE AS c FROM supplier),
q AS (SELECT *, b1 + b2 - (a1 + a2) / c AS s, b1 * b2 - (a1 * b2 + a2 * b1) / c AS m FROM t)
SELECT n, round(CASE WHEN b1 > 0 AND a1 / b1 + a2 / b2 <= c THEN 0 ELSE greatest(0, (-s + sqrt(greatest(s * s - 4 * m, 0))) / 2) END, 6) AS x FROM q""")
def solve_closed_form(spark, sf):
    s = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"), F.abs("s_acctbal").alias("v"))
    one = s.select("n", (F.col("v") + 1).alias("a"), (F.col("n") % 3).cast("double").alias("b"))
    two = s.select("n", (F.col("v") / 2 + 3).alias("a"), (1 + F.col("n") % 5).cast("double").alias("b"))
    found = mstep.solve_groups(one.unionByName(two), s.select("n", F.lit(100.0).alias("c")))
    return found.select("n", *r6("x"))


@query(f"""WITH RECURSIVE {B.removeprefix('WITH ')}{_TERMS}, pos AS (SELECT n, a, b + 0.1 AS b FROM terms), packed AS (SELECT n, list(a) AS a, list(b) AS b, sum(a) AS total FROM pos GROUP BY n),
step AS (SELECT n, 0 AS k, 0.0::DOUBLE AS low, total / 20.0::DOUBLE AS high FROM packed
  UNION ALL SELECT s.n, k + 1, CASE WHEN f > 20 THEN (low + high) / 2 ELSE low END, CASE WHEN f > 20 THEN high ELSE (low + high) / 2 END
  FROM step s JOIN packed p USING (n), LATERAL (SELECT list_sum(list_transform(range(1, len(p.a) + 1), lambda j: p.a[j] / ((s.low + s.high) / 2 + p.b[j]))) AS f) WHERE k < 40)
SELECT n, round((low + high) / 2, 5) AS x FROM step WHERE k = 40""")
def solve_native(spark, sf):
    b = Lineitems(spark, sf)
    terms = mstep.background_terms(b.post, b.photons, b.frames, b.background, b.weights, b.voxels).withColumn("b", F.col("b") + 0.1)
    constants = b.voxels.select("n").distinct().withColumn("c", F.lit(20.0))
    return mstep.solve_groups(terms, constants).select("n", F.round("x", 5).alias("x"))


def _roots_sql(name: str, terms: str, constants: str, rounds: int = 70) -> str:
    """CTE name(n, x): by bisection, the root of sum a / (x + b) = c over terms(n, a, b), with constants(n, c)."""
    return f"""{name}_s AS (SELECT n, b, sum(a) AS a FROM ({terms}) WHERE a > 0 GROUP BY n, b),
{name}_p AS (SELECT n, any_value(c) AS c, list(a) AS a, list(b) AS b, coalesce(max(CASE WHEN b = 0 THEN a END) / any_value(c), 0) AS low0, sum(a) / any_value(c) AS high0,
  coalesce(max((b = 0)::INT), 0) = 0 AND sum(CASE WHEN b > 0 THEN a / b ELSE 0 END) <= any_value(c) AS at_zero FROM {name}_s JOIN ({constants}) USING (n) WHERE c > 0 GROUP BY n),
{name}_t AS (SELECT n, 0 AS k, low0 AS low, high0 AS high FROM {name}_p WHERE NOT at_zero
  UNION ALL SELECT s.n, k + 1, CASE WHEN f > c THEN (low + high) / 2 ELSE low END, CASE WHEN f > c THEN high ELSE (low + high) / 2 END
  FROM {name}_t s JOIN {name}_p p USING (n), LATERAL (SELECT list_sum(list_transform(range(1, len(p.a) + 1), lambda j: p.a[j] / ((s.low + s.high) / 2 + p.b[j]))) AS f) WHERE k < {rounds}),
{name} AS (SELECT q.n, coalesce((low + high) / 2, 0) AS x FROM ({constants}) q LEFT JOIN (SELECT * FROM {name}_t WHERE k = {rounds}) t ON t.n = q.n)"""


_CN = "SELECT n, sum(c * mass) AS c FROM vx JOIN (SELECT r, sum(fluence * p) AS mass FROM po JOIN fr USING (d) GROUP BY r) USING (r) JOIN wt USING (i) GROUP BY n"


@query(f"WITH RECURSIVE {B.removeprefix('WITH ')}{_TERMS}, {_roots_sql('rt', 'SELECT n, a, b FROM terms', _CN)} SELECT n, round(x, 5) AS x FROM rt")
def solve_halley(spark, sf):
    b = Lineitems(spark, sf)
    post = b.post
    terms = mstep.background_terms(post, b.photons, b.frames, b.background, b.weights, b.voxels)
    return mstep.solve_groups(terms, mstep.background_constants(post, b.frames, b.weights, b.voxels)).select("n", F.round("x", 5).alias("x"))


_FT = "SELECT ph.d AS n, p * k AS a, bg_weight * v / c / greatest(w, 1e-10::DOUBLE) AS b FROM ph JOIN fr USING (d) JOIN bg ON bg_id = bg.b AND bg.i = ph.i JOIN wt ON wt.i = ph.i JOIN po USING (d) JOIN tm ON tm.r = po.r AND tm.i = ph.i"


@query(f"WITH RECURSIVE {B.removeprefix('WITH ')}, {_roots_sql('rt', _FT, 'SELECT d AS n, sum(p * wsum) AS c FROM po JOIN ws USING (r) GROUP BY d')} SELECT n AS d, round(x, 5) AS x FROM rt")
def fluence_background(spark, sf):
    b = Lineitems(spark, sf)
    found = mstep.background_fluence(b.post, b.photons, b.frames, b.background, b.weights, b.templates, b.sums)
    return found.select("d", F.round("x", 5).alias("x"))


# ---- iterations


def _em_sql(betas: list[float], threshold: float) -> str:
    """CTEs of iterations of a model with a voxel for each template and pixel, from t0 on; m holds their metrics."""
    out = [f"{PH}, {TM}, {WT}, t0 AS (SELECT r, i, w FROM tm)"]
    for k, beta in enumerate(betas):
        out.append(f"""ws{k} AS (SELECT r, sum(c * w) AS wsum FROM t{k} JOIN wt USING (i) GROUP BY r HAVING sum(c * w) > 0),
kw{k} AS (SELECT d, r, sum(k * CASE WHEN w > 0 THEN ln(w) ELSE 0 END) AS kw FROM ph JOIN t{k} USING (i) GROUP BY d, r),
lr{k} AS (SELECT d, r, kw - wsum AS logr FROM kw{k} JOIN ws{k} USING (r)),
pa{k} AS (SELECT d, r, logr, exp({beta!r}::DOUBLE * (logr - max(logr) OVER (PARTITION BY d))) AS p FROM lr{k}),
pb{k} AS (SELECT d, r, logr, CASE WHEN p < {threshold!r}::DOUBLE THEN 0 ELSE p END AS p FROM pa{k}),
po{k} AS (SELECT * FROM (SELECT d, r, logr, p / sum(p) OVER (PARTITION BY d) AS p FROM pb{k}) WHERE p > 0),
nu{k} AS (SELECT r, i, sum(p * k) AS num FROM po{k} JOIN ph USING (d) GROUP BY r, i),
t{k + 1} AS (SELECT t.r, t.i, CASE WHEN mass > 0 THEN coalesce(num, 0) / (c * mass) ELSE w END AS w FROM t{k} t JOIN wt USING (i)
  LEFT JOIN (SELECT r, sum(p) AS mass FROM po{k} GROUP BY r) USING (r) LEFT JOIN nu{k} n ON n.r = t.r AND n.i = t.i),
b{k} AS (SELECT d, r, p FROM po{k} QUALIFY row_number() OVER (PARTITION BY d ORDER BY p DESC, r) = 1),
m{k} AS (SELECT {k} AS iteration, {beta!r}::DOUBLE AS beta, (SELECT avg(q) FROM (SELECT sum(p * logr) AS q FROM po{k} GROUP BY d)) AS q, (SELECT avg(p) FROM b{k}) AS p_max,
  {f"(SELECT count(*) FROM b{k} x JOIN b{k - 1} y USING (d) WHERE x.r <> y.r)" if k else "(SELECT count(*) FROM b0)"} AS changed, {"0" if k else "(SELECT count(*) FROM b0)"} AS class_changes)""")
    return "WITH " + ",\n".join(out)


_BETAS = [0.5, 0.5 * 2**0.5, 1.0]
_EM3 = _em_sql(_BETAS, 1e-4) + " SELECT iteration, round(beta, 6) AS beta, round(q, 5) AS q, round(p_max, 6) AS p_max, changed, class_changes::BIGINT AS class_changes FROM (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(3)) + ")"


def _first_state(e: Embeddings) -> em.State:
    n = (F.col("r") * 64 + F.col("i")).cast("long").alias("n")
    return em.State(e.fluent, e.templates.select("r", "i", n), e.templates.select(n, F.col("w").alias("value")))


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select("iteration", F.round("beta", 6).alias("beta"), F.round("q", 5).alias("q"), F.round("p_max", 6).alias("p_max"), "changed", "class_changes")


@query(_EM3)
def em_iterations(spark, sf):
    e = Embeddings(spark, sf)
    return _rounded(em.run(_first_state(e), e.photons, e.weights, em.Config(iterations=3))[1])


@query(_EM3)
def em_resumed(spark, sf):
    """Two runs: one that ends after the first iteration, and one that finds its store and goes on."""
    e = Embeddings(spark, sf)
    path, config = f"{T.shared_dir(spark)}/em-{uuid.uuid4().hex}", em.Config(iterations=3)
    first = em.Config(iterations=1, beta_start=config.beta_start)
    em.run(_first_state(e), e.photons, e.weights, first, store=Store(spark, path))
    return _rounded(em.run(_first_state(e), e.photons, e.weights, config, store=Store(spark, path))[1])


@query(_em_sql(_BETAS[:2], 1e-4) + " SELECT r * 64 + i AS n, round(w, 5) AS value FROM t2")
def em_model(spark, sf):
    """The model after two iterations; templates that no frame is left to keep theirs."""
    e = Embeddings(spark, sf)
    state, _ = em.run(_first_state(e), e.photons, e.weights, em.Config(iterations=2, beta_stop=_BETAS[1]))
    return state.model.select("n", F.round("value", 5).alias("value"))


_C2 = f"""WITH {PH}, {TM}, {WT}, vx AS (SELECT (r % 2) * 5 + r // 2 AS r, i, (r % 2) * 48 + ((r // 2) * 7 + i) % 48 AS n, w FROM tm),
md AS (SELECT n, avg(w) AS value FROM vx GROUP BY n), tt AS (SELECT r, i, n, value AS w FROM vx JOIN md USING (n)),
ws AS (SELECT r, sum(c * w) AS wsum FROM tt JOIN wt USING (i) GROUP BY r), lr AS (SELECT d, r, kw - wsum AS logr FROM (SELECT d, r, sum(k * CASE WHEN w > 0 THEN ln(w) ELSE 0 END) AS kw FROM ph JOIN tt USING (i) GROUP BY d, r) JOIN ws USING (r)),
pa AS (SELECT d, r, exp(0.5 * (logr - max(logr) OVER (PARTITION BY d))) AS p FROM lr), po AS (SELECT * FROM (SELECT d, r, p / sum(p) OVER (PARTITION BY d) AS p FROM (SELECT d, r, CASE WHEN p < 0.0001 THEN 0 ELSE p END AS p FROM pa)) WHERE p > 0)"""


@query(f"""{_C2}, nu AS (SELECT r, i, sum(p * k) AS num FROM po JOIN ph USING (d) GROUP BY r, i),
new AS (SELECT n, sum(coalesce(num, 0)) / sum(c * mass) AS value FROM tt JOIN wt USING (i) JOIN (SELECT r, sum(p) AS mass FROM po GROUP BY r) USING (r) LEFT JOIN nu USING (r, i) WHERE n < 48 GROUP BY n)
SELECT n, round(coalesce(new.value, md.value), 5) AS value FROM md LEFT JOIN new USING (n)""")
def em_classes(spark, sf):
    """An iteration of two classes, of which the second's model is fixed."""
    e = Embeddings(spark, sf)
    own = e.templates.select((F.col("r") % 2).alias("c"), F.floor(F.col("r") / 2).cast("long").alias("r"), "i", "w")
    own = own.withColumn("n", (F.col("r") * 7 + F.col("i")) % 48)
    parts = [(own.where(F.col("c") == c).select("r", "i", "n"), own.where(F.col("c") == c).groupBy("n").agg(F.avg("w").alias("value")), 5, 48) for c in (0, 1)]
    state, _ = em.run(em.class_major(e.fluent, parts), e.photons, e.weights, em.Config(iterations=1, fixed_classes=(1,)))
    return state.model.select("n", F.round("value", 5).alias("value"))


@query(f"{_C2} SELECT d, c, round(sum(p), 6) AS p FROM (SELECT d, (r >= 5)::INT AS c, p FROM po) GROUP BY d, c")
def class_major_occupancy(spark, sf):
    e = Embeddings(spark, sf)
    own = e.templates.select((F.col("r") % 2).alias("c"), F.floor(F.col("r") / 2).cast("long").alias("r"), "i", "w").withColumn("n", (F.col("r") * 7 + F.col("i")) % 48)
    parts = [(own.where(F.col("c") == c).select("r", "i", "n"), own.where(F.col("c") == c).groupBy("n").agg(F.avg("w").alias("value")), 5, 48) for c in (0, 1)]
    state = em.class_major(e.fluent, parts)
    post = em.expectation(state, e.photons, e.weights, em.Config(), 0.5)[3]
    return estep.class_occupancy(post, state.classes).select("d", "c", *r6("p"))


def _background_sql() -> str:
    tt = "SELECT vx.r, vx.i, coalesce(value, 0) AS w FROM vx LEFT JOIN {model} USING (n)"
    cn = "SELECT n, sum(c * mass) AS c FROM vx JOIN (SELECT r, sum(fluence * p) AS mass FROM pp JOIN fr USING (d) GROUP BY r) USING (r) JOIN wt USING (i) GROUP BY n"
    terms = "SELECT n, p * k AS a, bg_weight * v / (fluence * c) AS b FROM ph JOIN fr USING (d) JOIN bg ON bg_id = bg.b AND bg.i = ph.i JOIN wt ON wt.i = ph.i JOIN pp USING (d) JOIN vx ON vx.r = pp.r AND vx.i = ph.i"
    flu = "SELECT ph.d AS n, p * k AS a, bg_weight * v / c / greatest(t1.w, 1e-10::DOUBLE) AS b FROM ph JOIN fr USING (d) JOIN bg ON bg_id = bg.b AND bg.i = ph.i JOIN wt ON wt.i = ph.i JOIN pp USING (d) JOIN t1 ON t1.r = pp.r AND t1.i = ph.i"
    return f"""WITH RECURSIVE {B.removeprefix('WITH ')}, md AS (SELECT n, avg(w) AS value FROM vx JOIN tm USING (r, i) GROUP BY n), t0 AS ({tt.format(model='md')}),
s0 AS (SELECT r, sum(c * w) AS wsum FROM t0 JOIN wt USING (i) GROUP BY r HAVING sum(c * w) > 0),
li AS (SELECT ph.d, ph.i, k, c, fluence, bg_weight * v / (fluence * c) AS extra FROM ph JOIN fr USING (d) JOIN bg ON bg_id = b AND bg.i = ph.i JOIN wt ON wt.i = ph.i),
dt AS (SELECT d, r, sum(k * (ln(w + extra) + ln(c))) AS kf FROM li JOIN t0 USING (i) WHERE w + extra > 0 GROUP BY d, r),
kn AS (SELECT d, ksum, fluence, bg_weight * vsum AS bsum FROM fr JOIN (SELECT b, sum(v) AS vsum FROM bg GROUP BY b) ON bg_id = b),
ll AS (SELECT d, r, kf + ksum * ln(fluence) - (fluence * wsum + bsum) AS logr FROM dt JOIN kn USING (d) JOIN s0 USING (r)),
pa AS (SELECT d, r, exp(0.05 * (logr - max(logr) OVER (PARTITION BY d))) AS p FROM ll),
pp AS (SELECT * FROM (SELECT d, r, p / sum(p) OVER (PARTITION BY d) AS p FROM (SELECT d, r, CASE WHEN p < 0.0001 THEN 0 ELSE p END AS p FROM pa)) WHERE p > 0),
{_roots_sql('rm', terms, cn)}, m1 AS (SELECT n, coalesce(x, value) AS value FROM md LEFT JOIN rm USING (n)), t1 AS ({tt.format(model='m1')}),
{_roots_sql('rf', flu, 'SELECT d AS n, sum(p * wsum) AS c FROM pp JOIN s0 USING (r) GROUP BY d')}
SELECT 'model' AS kind, n::BIGINT AS id, round(value, 4) AS value FROM m1 UNION ALL SELECT 'fluence', d, round(CASE WHEN x > 0 THEN x ELSE fluence END, 4) FROM fr LEFT JOIN rf ON rf.n = d"""


@query(_background_sql())
def em_background(spark, sf):
    """An iteration under frames with background: the model, then the fluence under it."""
    b = Lineitems(spark, sf)
    model = b.voxels.join(b.templates, ["r", "i"]).groupBy("n").agg(F.avg("w").alias("value"))
    config = em.Config(iterations=1, beta_start=0.05, frame_model="background", inner=1)
    state, _ = em.run(em.State(T.cut(b.frames), b.voxels, T.cut(model)), b.photons, b.weights, config, background=b.background)
    rows = state.model.select(F.lit("model").alias("kind"), F.col("n").alias("id"), "value").unionByName(state.frames.select(F.lit("fluence").alias("kind"), F.col("d").cast("long").alias("id"), F.col("fluence").alias("value")))
    return rows.select("kind", "id", F.round("value", 4).alias("value"))


# ---- geometry

#: A pixel for each number below 256 that a part has, moved a little by the parts' sizes; a voxel for each number below
#: cells that a part has, with the parts' mean price.
_PX = """px AS (SELECT i, (i % 16 - 7.5::DOUBLE) * 0.01 + moved * 1e-5::DOUBLE AS x, (i // 16 - 7.5::DOUBLE) * 0.01 AS y, 0.2::DOUBLE AS z, i % 37 <> 5 AS good FROM (SELECT (p_partkey % 256)::INT AS i, avg(p_size) AS moved FROM part GROUP BY 1)),
q1 AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM px),
q2 AS (SELECT *, x / r / 2 AS qx, y / r / 2 AS qy, (z / r - 1) / 2 AS qz, 0.0001::DOUBLE * z / (r * r * r) * (1 - (x / r) * (x / r)) AS c0 FROM q1),
q3 AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS qr, c0 / (SELECT max(c0) FROM q2 WHERE good) AS c FROM q2)"""


def _detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, part = F.col("i"), (F.col("p_partkey") % 256).cast("int").alias("i")
    rows = T.read(spark, sf_dir, "part").groupBy(part).agg(F.avg("p_size").alias("moved"))
    return rows.select("i", ((i % 16 - 7.5) * 0.01 + F.col("moved") * 1e-5).alias("x"), ((F.floor(i / 16) - 7.5) * 0.01).alias("y"), F.lit(0.2).alias("z"), (i % 37 != 5).alias("good"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.scattering(_detector(spark, sf_dir), 2.0, 0.0001, polarisation="x")


def _vo(cells: int) -> str:
    return f"vo AS (SELECT p_partkey % {cells} AS n, avg(p_retailprice) / 1000 AS value FROM part GROUP BY 1)"


def _part_voxels(spark: SparkSession, sf_dir: str, cells: int) -> DataFrame:
    return T.read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % cells).alias("n")).agg((F.avg("p_retailprice") / 1000).alias("value"))


#: A direction for each supplier.
_DIR = "dir AS (SELECT s_suppkey, cos(s_acctbal) AS v0, sin(s_acctbal) AS v1, (s_suppkey % 7) / 7.0::DOUBLE AS v2 FROM supplier)"


def _turned(spark: SparkSession, sf_dir: str, turns: DataFrame, of: int, name: str = "a", key: str = "r") -> DataFrame:
    """s_suppkey, y0 .. y2: each supplier's direction under the turn of its number."""
    rows = T.read(spark, sf_dir, "supplier").select("s_suppkey", F.cos("s_acctbal").alias("v0"), F.sin("s_acctbal").alias("v1"), (F.col("s_suppkey") % 7 / 7.0).alias("v2"))
    met = rows.join(turns, F.col("s_suppkey") % of == F.col(key))
    return met.select("s_suppkey", *[F.round(sum((F.col(f"{name}{a}{b}") * F.col(f"v{b}") for b in range(1, 3)), F.col(f"{name}{a}0") * F.col("v0")), 6).alias(f"y{a}") for a in range(3)])


def _turned_sql(of: int, key: str = "r", name: str = "a") -> str:
    return "SELECT s_suppkey, " + ", ".join(f"round({name}{a}0 * v0 + {name}{a}1 * v1 + {name}{a}2 * v2, 6) AS y{a}" for a in range(3)) + f" FROM dir JOIN rot ON {key} = s_suppkey % {of}"


@query(f"WITH {_PX} SELECT i, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz, round(qr, 6) AS qr, round(c, 6) AS c FROM q3")
def pixel_geometry(spark, sf):
    return _pixels(spark, sf).select("i", *r6("qx", "qy", "qz", "qr", "c"))


@query(f"WITH {_PX} SELECT i, good AND qr <= 0.15 AS in_mask FROM q3")
def resolution_mask(spark, sf):
    return geometry.masked(_pixels(spark, sf), 0.15).select("i", "in_mask")


@query(f"WITH {_PX}, k AS (SELECT *, good AND qr <= 0.2 AS kept FROM q3), l AS (SELECT *, min(CASE WHEN kept THEN qr END) OVER () AS low FROM k) SELECT i, kept AND qr >= low + 1 * 0.02 AND qr <= 0.2 - 1 * 0.02 AS in_mask, kept AND qr >= low + 2 * 0.02 AND qr <= 0.2 - 2 * 0.02 AS in_p_mask FROM l")
def voxel_cut_mask(spark, sf):
    return geometry.masked(_pixels(spark, sf), 0.2, 0.02, 1, 1, 1, 1).select("i", "in_mask", "in_p_mask")


_FLAT = "rot AS (SELECT range AS r, cos(2 * pi() * range / 12 + 0.37576737726076753) AS a00, -sin(2 * pi() * range / 12 + 0.37576737726076753) AS a01, 0.0 AS a02, sin(2 * pi() * range / 12 + 0.37576737726076753) AS a10, cos(2 * pi() * range / 12 + 0.37576737726076753) AS a11, 0.0 AS a12, 0.0 AS a20, 0.0 AS a21, 1.0 AS a22 FROM range(12))"


@query(f"WITH {_DIR}, {_FLAT} {_turned_sql(12)}")
def rotations_2d(spark, sf):
    """Directions turned in the plane."""
    return _turned(spark, sf, geometry.rotations(spark, 12, 2), 12)


def _rotation_sql(order: int) -> str:
    plane, sphere = geometry.rotation_counts(order)
    phi, phi2, th = geometry.FIXED_PHI, geometry.FIXED_PHI2, geometry.FIXED_THETA
    own = [["ct*cp*cf - st*sf", "-ct*cp*sf - st*cf", "ct*sp"], ["st*cp*cf + ct*sf", "-st*cp*sf + ct*cf", "st*sp"], ["-sp*cf", "sp*sf", "cp"]]
    c, s = math.cos, math.sin
    o = [[c(th) * c(phi) * c(phi2) - s(th) * s(phi2), -c(th) * c(phi) * s(phi2) - s(th) * c(phi2), c(th) * s(phi)], [s(th) * c(phi) * c(phi2) + c(th) * s(phi2), -s(th) * c(phi) * s(phi2) + c(th) * c(phi2), s(th) * s(phi)], [-s(phi) * c(phi2), s(phi) * s(phi2), c(phi)]]
    cells = ", ".join(" + ".join(f"({own[a][k]}) * ({o[k][b]!r}::DOUBLE)" for k in range(3)) + f" AS a{a}{b}" for a in range(3) for b in range(3))
    return f"""g AS (SELECT range AS r, acos(1 - 2 * (range // {plane} + 0.5::DOUBLE) / {sphere}) AS p, 2 * pi() * (range % {plane} + 0.5::DOUBLE) / {plane} AS f, 2 * pi() * (range // {plane} + 0.5::DOUBLE) / {geometry.GOLDEN!r}::DOUBLE AS t FROM range({plane * sphere})),
    h AS (SELECT r, cos(p) AS cp, sin(p) AS sp, cos(f) AS cf, sin(f) AS sf, cos(t) AS ct, sin(t) AS st FROM g), rot AS (SELECT r, {cells} FROM h)"""


@query(f"WITH {_DIR}, {_rotation_sql(4)} {_turned_sql(663)}")
def rotations_3d(spark, sf):
    """Directions turned by near-uniform rotations."""
    return _turned(spark, sf, geometry.rotations(spark, 4, 3), 663)


_OPS = "ops AS (SELECT s, cos(t) AS s00, -sin(t) AS s01, sin(t) AS s10, cos(t) AS s11 FROM (VALUES (0, pi() / 3), (1, 2 * pi() / 3), (2, pi())) v(s, t))"
_MAPQ = ", ".join(f"(scale / 0.04) * (s{i}0 * a0{j} + s{i}1 * a1{j}) AS m{i}{j}" for i in range(2) for j in range(3)) + ", " + ", ".join(f"(scale / 0.04) * a2{j} AS m2{j}" for j in range(3))
_SCALES = "sc AS (SELECT (s_suppkey % 2)::INT AS scale_id, 1 + avg(abs(s_acctbal)) / 100000 AS scale FROM supplier GROUP BY 1)"
_MAP = f"WITH {_rotation_sql(1)}, {_OPS}, {_SCALES}, mp AS (SELECT s, (scale_id * 2 + offset_id) * 20 + r AS r, scale_id, dx, dy, dz, {_MAPQ} FROM rot, ops, sc, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.01::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)) f(offset_id, dx, dy, dz))"


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping rows at two scales, by the suppliers' mean balances."""
    scales = T.read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 2).cast("int").alias("scale_id")).agg((1 + F.avg(F.abs("s_acctbal")) / 100000).alias("scale"))
    offsets = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.01, 0.0, 0.0)], "offset_id int, dx double, dy double, dz double")
    return geometry.mapping(geometry.rotations_3d(spark, 1), symmetry.rotation_operators(spark, "D6"), scales, offsets, 2.0, 0.02, 16)


@query(f"{_MAP} SELECT s, r, dx, " + ", ".join(f"round(8 - m{i}2, 6) AS b{i}" for i in range(3)) + ", " + ", ".join(f"round(m{i}{j}, 6) AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM mp")
def mapping_rows(spark, sf):
    return _mapping(spark, sf).select("s", "r", "dx", *r6("b0", "b1", "b2", *(f"m{i}{j}" for i in range(3) for j in range(3))))


_UV = f"{_MAP}, {_PX.replace('q1 AS', 'q1_ AS').split('q1_ AS')[0].rstrip().rstrip(',')}, co AS (SELECT s, r, i, " + ", ".join(f"(m{k}0 * (x - dx) + m{k}1 * (y - dy) + m{k}2 * (z - dz)) / sqrt((x - dx) * (x - dx) + (y - dy) * (y - dy) + (z - dz) * (z - dz)) + (8 - m{k}2) AS u{k}" for k in range(3)) + " FROM mp, px)"


@query(f"{_UV}, v AS (SELECT s, r, i, round_even(u0, 0)::BIGINT AS a, round_even(u1, 0)::BIGINT AS b, round_even(u2, 0)::BIGINT AS c FROM co) SELECT s, r, i, (a * 16 + b) * 16 + c AS n FROM v WHERE a BETWEEN 0 AND 15 AND b BETWEEN 0 AND 15 AND c BETWEEN 0 AND 15")
def voxel_index(spark, sf):
    return geometry.voxel_index(geometry.voxel_coordinates(_pixels(spark, sf), _mapping(spark, sf)), 16)


_GRID2 = _vo(64).replace("vo AS", "md AS") + ", co AS (SELECT l_partkey * 1000000 + l_suppkey AS i, (l_partkey % 23) * 0.43171::DOUBLE - 0.9 AS u0, (l_suppkey % 19) * 0.51237::DOUBLE - 0.7 AS u1 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))"
_GRID3 = _GRID2.replace("% 64", "% 512").replace("AS u1 FROM", "AS u1, ((l_partkey + l_suppkey) % 17) * 0.57413::DOUBLE - 0.8 AS u2 FROM")


def _points(spark: SparkSession, sf_dir: str, axes: int) -> DataFrame:
    """A point for each part and supplier that met in an order."""
    rows = T.read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    at = ((F.col("l_partkey"), 23, 0.43171, 0.9), (F.col("l_suppkey"), 19, 0.51237, 0.7), (F.col("l_partkey") + F.col("l_suppkey"), 17, 0.57413, 0.8))[:axes]
    return rows.select((F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("i"), *[(c % m * s - o).alias(f"u{k}") for k, (c, m, s, o) in enumerate(at)])


def _corner_sql(axes: int) -> str:
    names = "abc"[:axes]
    parts, at = [], ", ".join(f"floor(u{k})::BIGINT AS {c}0, u{k} - floor(u{k}) AS {c}f" for k, c in enumerate(names))
    for corner in range(1 << axes):
        up = [corner >> (axes - 1 - k) & 1 for k in range(axes)]
        ok = " AND ".join(f"{c}0 + {u} BETWEEN 0 AND 7" for c, u in zip(names, up))
        n = "0"
        for c, u in zip(names, up):
            n = f"({n}) * 8 + {c}0 + {u}"
        share = " * ".join(f"{c}f" if u else f"(1 - {c}f)" for c, u in zip(names, up))
        parts.append(f"SELECT i, CASE WHEN {ok} THEN {n} END AS n, {share} AS share FROM cc")
    return f", cc AS (SELECT i, {at} FROM co), sp AS ({' UNION ALL '.join(parts)}) SELECT i, round(sum(share * coalesce(value, 0)) + 1e-9, 5) AS w FROM sp LEFT JOIN md USING (n) GROUP BY i"


@query(f"WITH {_GRID2}, nn AS (SELECT i, floor(u0 + 0.5)::BIGINT AS a, floor(u1 + 0.5)::BIGINT AS b FROM co) SELECT i, round(coalesce(value, 0), 6) AS w FROM nn LEFT JOIN md ON a BETWEEN 0 AND 7 AND b BETWEEN 0 AND 7 AND n = a * 8 + b")
def sample_nearest(spark, sf):
    return geometry.sampled(_points(spark, sf, 2), _part_voxels(spark, sf, 64), 8, 2, "nearest", ("i",)).select("i", *r6("w"))


@query(f"WITH {_GRID2}{_corner_sql(2)}")
def sample_linear_2d(spark, sf):
    return geometry.sampled(_points(spark, sf, 2), _part_voxels(spark, sf, 64), 8, 2, keys=("i",)).select("i", F.round(F.col("w") + 1e-9, 5).alias("w"))


@query(f"WITH {_GRID3}{_corner_sql(3)}")
def sample_linear_3d(spark, sf):
    return geometry.sampled(_points(spark, sf, 3), _part_voxels(spark, sf, 512), 8, 3, keys=("i",)).select("i", F.round(F.col("w") + 1e-9, 5).alias("w"))


@query(f"SELECT i, round(CASE WHEN w > 1e-9 THEN ln(w) ELSE 0 END, 4) AS lw FROM (WITH {_GRID2}{_corner_sql(2).replace('round(sum(share * coalesce(value, 0)) + 1e-9, 5)', 'sum(share * coalesce(value, 0))')})")
def sample_log(spark, sf):
    w = geometry.sampled(_points(spark, sf, 2), _part_voxels(spark, sf, 64), 8, 2, keys=("i",))
    return w.select("i", F.round(positive_log(F.when(F.col("w") > 1e-9, F.col("w")).otherwise(0.0)), 4).alias("lw"))


# ---- symmetry


def _images_sql(size: int, axes: int, kind: str, of: str | None = None) -> str:
    """(n, m): every voxel, or those of a table, and its image under every operation that keeps it in the grid."""
    flips = {"P1": ["0"], "inversion": ["0", str((1 << axes) - 1)], "D6": [str(k) for k in range(1 << axes)]}[kind]
    index = [f"(n // {size ** (axes - 1 - k)}) % {size}" for k in range(axes)]
    at = [f"CASE WHEN (f >> {k}) & 1 = 1 THEN {2 * (size // 2)} - x{k} ELSE x{k} END AS y{k}" for k in range(axes)]
    n = "0"
    for k in range(axes):
        n = f"({n}) * {size} + y{k}"
    grid = f"SELECT n FROM {of}" if of else f"SELECT range AS n FROM range({size ** axes})"
    inner = f"SELECT n, f, {', '.join(f'{e} AS x{k}' for k, e in enumerate(index))} FROM ({grid}), (VALUES {', '.join(f'({f})' for f in flips)}) v(f)"
    return f"im AS (SELECT n, {n} AS m FROM (SELECT n, {', '.join(at)} FROM ({inner})) WHERE {' AND '.join(f'y{k} < {size}' for k in range(axes))})"


_V16, _V15, _V63 = _vo(16**3), _vo(15**3), _vo(63**2)


@query(f"WITH {_V16} SELECT n FROM vo")
def asym_unit_p1(spark, sf):
    return symmetry.asymmetric_unit(_part_voxels(spark, sf, 16**3), 16, 3, "P1")


@query(f"WITH {_V16} SELECT n FROM vo WHERE n // 256 <= 8")
def asym_unit_inversion(spark, sf):
    return symmetry.asymmetric_unit(_part_voxels(spark, sf, 16**3), 16, 3, "inversion")


@query(f"WITH {_V15} SELECT n FROM vo WHERE n // 225 <= 7 AND (n // 15) % 15 <= 7 AND n % 15 <= 7")
def asym_unit_d6(spark, sf):
    return symmetry.asymmetric_unit(_part_voxels(spark, sf, 15**3), 15, 3, "D6")


@query(f"WITH {_V16}, {_images_sql(16, 3, 'D6', 'vo')} SELECT DISTINCT n, m::BIGINT AS partner FROM im")
def symmetry_partners(spark, sf):
    return symmetry.partners(_part_voxels(spark, sf, 16**3), 16, 3, "D6")


@query(f"WITH {_V63}, {_images_sql(63, 2, 'inversion', 'vo')} SELECT m::BIGINT AS n, round(sum(value), 6) AS value FROM im JOIN vo USING (n) GROUP BY m")
def apply_symmetry_2d(spark, sf):
    return symmetry.symmetrised(_part_voxels(spark, sf, 63**2), ["value"], 63, 2, "inversion").select("n", *r6("value"))


@query(f"WITH {_V16}, {_images_sql(16, 3, 'D6', 'vo')} SELECT m::BIGINT AS n, round(sum(value), 6) AS value FROM im JOIN vo USING (n) GROUP BY m")
def apply_symmetry_3d(spark, sf):
    return symmetry.symmetrised(_part_voxels(spark, sf, 16**3), ["value"], 16, 3, "D6").select("n", *r6("value"))


@query(f"WITH {_V16}, {_images_sql(16, 3, 'D6', 'vo')} SELECT m::BIGINT AS n, count(*) AS times FROM im GROUP BY m")
def multiplicity(spark, sf):
    return symmetry.multiplicity(_part_voxels(spark, sf, 16**3), 16, 3, "D6")


@query(f"WITH {_V15}, {_images_sql(15, 3, 'D6', 'vo')} SELECT n, min(m)::BIGINT AS rep FROM im GROUP BY n")
def orbit_representatives(spark, sf):
    return symmetry.orbit_representative(_part_voxels(spark, sf, 15**3).select("n"), 15, 3, "D6")


# ---- iterations from a first state


def _scene_sql(kind: str, axes: int, photons: str, pad: int = 0, model: str = "coalesce(avg(p_retailprice) / 1000, 0.05)", size: int = 9) -> str:
    """CTEs of a first state, its templates and its voxels: mk pixels with in_p, t0 templates, vx voxels, im images, md model,
    ph photons and fr all frames."""
    ops = _OPS if kind == "D6" and axes == 3 else "ops AS (SELECT 0 AS s, 1.0 AS s00, 0.0 AS s01, 0.0 AS s10, 1.0 AS s11)"
    dq, mid = 2 * 0.12 / (size - 1), size // 2
    m = ", ".join(f"(s{i}0 * a0{j} + s{i}1 * a1{j}) / {2 * dq!r}::DOUBLE AS m{i}{j}" for i in range(2) for j in range(3)) + ", " + ", ".join(f"a2{j} / {2 * dq!r}::DOUBLE AS m2{j}" for j in range(3))
    u = ", ".join(f"(m{k}0 * x + m{k}1 * y + m{k}2 * z) / q + ({mid} - m{k}2) AS u{k}" for k in range(axes))
    n = "0"
    for k in range(axes):
        n = f"({n}) * {size} + v{k}"
    corners = []
    for corner in range(1 << axes):
        up = [corner >> (axes - 1 - k) & 1 for k in range(axes)]
        at, ok, share = "0", " AND ".join(f"floor(u{k}) + {b} BETWEEN 0 AND {size - 1}" for k, b in enumerate(up)), " * ".join(f"(u{k} - floor(u{k}))" if b else f"(1 - u{k} + floor(u{k}))" for k, b in enumerate(up))
        for k, b in enumerate(up):
            at = f"({at}) * {size} + floor(u{k})::BIGINT + {b}"
        corners.append(f"SELECT r, i, CASE WHEN {ok} THEN {at} END AS n, {share} AS share FROM co WHERE s = 0")
    return f"""{photons}, px AS (SELECT (p_partkey % 64)::INT AS i, (p_partkey % 8 - 3.5::DOUBLE) * 0.02 + avg(p_size) * 1e-5::DOUBLE AS x, (p_partkey % 64 // 8 - 3.5::DOUBLE) * 0.02 AS y, 0.2::DOUBLE AS z, p_partkey % 64 % 13 <> 5 AS good FROM part GROUP BY i, p_partkey % 8, p_partkey % 64),
q1 AS (SELECT *, sqrt(x * x + y * y + z * z) AS q FROM px), q2 AS (SELECT *, 0.0001::DOUBLE * z / (q * q * q) AS c0, sqrt(x / q / 2 * x / q / 2 + y / q / 2 * y / q / 2 + (z / q - 1) / 2 * (z / q - 1) / 2) AS qr FROM q1),
q3 AS (SELECT *, c0 / (SELECT max(c0) FROM q2 WHERE good) AS c, (SELECT min(qr) FROM q2 WHERE good AND qr <= 0.12) AS low FROM q2),
mk AS (SELECT i, x, y, z, q, c, qr >= low + {pad * dq!r}::DOUBLE AND qr <= 0.12 - {pad * dq!r}::DOUBLE AS in_p FROM q3 WHERE good AND qr <= 0.12),
{_rotation_sql(1) if axes == 3 else _FLAT}, {ops}, mp AS (SELECT s, r, {m} FROM rot, ops), co AS (SELECT s, r, i, {u} FROM mp, mk),
md AS (SELECT range AS n, {model} AS value FROM range({size**axes}) LEFT JOIN part ON p_partkey % {size**axes} = range GROUP BY range),
t0 AS (SELECT r, i, sum(share * coalesce(value, 0)) AS w FROM ({" UNION ALL ".join(corners)}) LEFT JOIN md USING (n) GROUP BY r, i),
vx AS (SELECT r, i, ({n})::BIGINT AS n FROM (SELECT r, i, {", ".join(f"round_even(u{k}, 0)::BIGINT AS v{k}" for k in range(axes))} FROM co) WHERE {" AND ".join(f"v{k} BETWEEN 0 AND {size - 1}" for k in range(axes))}),
{_images_sql(size, axes, kind)}"""


def _step_sql(beta: float, free: bool = False, fluence: bool = False) -> str:
    """CTEs of one iteration over all pairs of frames and templates: po posteriors, nw the model."""
    offset = "ksum_p * ln(wsum)" if free else "wsum"
    return f"""pe AS (SELECT ph.* FROM ph JOIN mk USING (i) WHERE in_p), pm AS (SELECT ph.* FROM ph JOIN mk USING (i)),
fs AS (SELECT d, coalesce(ksum, 0) AS ksum, coalesce(ksum_p, 0) AS ksum_p FROM fr LEFT JOIN (SELECT d, sum(k) AS ksum FROM pm GROUP BY d) USING (d) LEFT JOIN (SELECT d, sum(k) AS ksum_p FROM pe GROUP BY d) USING (d)),
wp AS (SELECT r, sum(c * w) AS wsum FROM t0 JOIN mk USING (i) WHERE in_p GROUP BY r HAVING sum(c * w) > 0), wm AS (SELECT r, sum(c * w) AS wsum FROM t0 JOIN mk USING (i) GROUP BY r HAVING sum(c * w) > 0),
kw AS (SELECT d, r, sum(CASE WHEN w > 0 THEN k * ln(w) ELSE 0 END) AS kw FROM pe JOIN t0 USING (i) GROUP BY d, r),
lr AS (SELECT fs.d, wp.r, coalesce(kw, 0) - {offset} AS logr FROM fs CROSS JOIN wp LEFT JOIN kw ON kw.d = fs.d AND kw.r = wp.r),
pa AS (SELECT d, r, exp({beta!r}::DOUBLE * (logr - max(logr) OVER (PARTITION BY d))) AS p FROM lr),
po AS (SELECT * FROM (SELECT d, r, p / sum(p) OVER (PARTITION BY d) AS p FROM (SELECT d, r, CASE WHEN p < 0.001 THEN 0 ELSE p END AS p FROM pa)) WHERE p > 0),
fl AS (SELECT d, CASE WHEN ksum > 0 THEN ksum / sum(p * wsum) ELSE 1 END AS fluence FROM po JOIN wm USING (r) JOIN fs USING (d) GROUP BY d, ksum),
ma AS (SELECT r, sum(p * {"ksum" if free else "fluence" if fluence else "1"}) AS mass FROM po JOIN fs USING (d) JOIN fl USING (d) GROUP BY r), nu AS (SELECT r, i, sum(p * k) AS num FROM po JOIN pm USING (d) GROUP BY r, i),
ce AS (SELECT n, coalesce(num, 0) * {"wsum" if free else "1"} AS num, c * mass AS den FROM vx JOIN ma USING (r) JOIN mk USING (i) JOIN wm USING (r) LEFT JOIN nu USING (r, i)),
sy AS (SELECT m::BIGINT AS n, sum(num) AS num, sum(den) AS den FROM ce JOIN im USING (n) GROUP BY m),
nw AS (SELECT n::BIGINT AS n, round(CASE WHEN den > 0 THEN num / den ELSE value END, 5) AS value FROM md LEFT JOIN sy USING (n))"""


_SUPPLIED = "ph AS (SELECT l_suppkey AS d, (l_partkey % 64)::INT AS i, count(*)::INT AS k FROM lineitem GROUP BY ALL), fr AS (SELECT s_suppkey AS d FROM supplier UNION ALL SELECT -1 - n_nationkey FROM nation)"
_ORDERED = "ph AS (SELECT l_orderkey AS d, (l_partkey % 64)::INT AS i, count(*)::INT AS k FROM lineitem GROUP BY ALL), fr AS (SELECT o_orderkey AS d FROM orders UNION ALL SELECT -1 - n_nationkey FROM nation)"


def _part_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of 8 by 8 pixels, moved a little by the sizes of the parts that fall on each."""
    i = (F.col("p_partkey") % 64).cast("int")
    means = T.read(spark, sf_dir, "part").groupBy(i.alias("i")).agg(F.avg("p_size").alias("moved"))
    return means.select("i", ((F.col("i") % 8 - 3.5) * 0.02 + F.col("moved") * 1e-5).alias("x"), ((F.floor(F.col("i") / 8) - 3.5) * 0.02).alias("y"), F.lit(0.2).alias("z"), (F.col("i") % 13 != 5).alias("good"))


def _part_model(spark: SparkSession, sf_dir: str, cells: int, value=None) -> DataFrame:
    """n, value: a voxel for each number below cells, by the prices of its parts."""
    parts = T.read(spark, sf_dir, "part").select((F.col("p_partkey") % cells).alias("n"), "p_retailprice")
    known = parts.groupBy("n").agg((F.avg("p_retailprice") / 1000).alias("price"))
    return spark.range(cells).withColumnRenamed("id", "n").join(known, "n", "left").select("n", (value if value is not None else F.coalesce("price", F.lit(0.05))).alias("value"))


def _scene(spark: SparkSession, sf_dir: str, kind: str, axes: int, key: str, pad: int = 0, value=None) -> tuple[em.State, DataFrame, DataFrame]:
    """State, weights and photons of a detector made of parts, with a frame for each supplier (or order), and some dark ones."""
    owners = {"l_suppkey": ("supplier", "s_suppkey"), "l_orderkey": ("orders", "o_orderkey")}[key]
    photons = T.read(spark, sf_dir, "lineitem").groupBy(F.col(key).alias("d"), (F.col("l_partkey") % 64).cast("int").alias("i")).agg(F.count("*").cast("int").alias("k"))
    frames = T.read(spark, sf_dir, owners[0]).select(F.col(owners[1]).alias("d")).unionByName(T.read(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("d")))
    g = initial.Geometry(2.0, 0.0001, 9, 1 if axes == 3 else 12, axes, kind, q_max=0.12, p_inner=pad, p_outer=pad)
    state, weights = initial.initialise(_part_pixels(spark, sf_dir), frames, g, 0.2, photons=photons, model=T.cut(_part_model(spark, sf_dir, 9**axes, value)))
    return state, weights, photons


def _once(spark: SparkSession, sf_dir: str, beta: float, scene: tuple, **options) -> em.State:
    state, weights, photons = scene
    return em.step(state, photons, weights, em.Config(iterations=1, beta_start=beta, beta_stop=beta, threshold=1e-3, **options), beta)[0]


@query(f"WITH {_scene_sql('D6', 3, _SUPPLIED)}, {_step_sql(0.02)} SELECT n, value FROM nw")
def em_initial_d6(spark, sf):
    """The model after an iteration from a first state: read by interpolation under the first operator, merged under all, on
    orbits of eight."""
    return _once(spark, sf, 0.02, _scene(spark, sf, "D6", 3, "l_suppkey")).model.select("n", F.round("value", 5).alias("value"))


@query(f"WITH {_scene_sql('P1', 3, _SUPPLIED)}, {_step_sql(0.02)} SELECT n, value FROM nw")
def em_initial_p1(spark, sf):
    return _once(spark, sf, 0.02, _scene(spark, sf, "P1", 3, "l_suppkey")).model.select("n", F.round("value", 5).alias("value"))


@query(f"WITH {_scene_sql('inversion', 2, _SUPPLIED)}, {_step_sql(0.02, free=True)} SELECT n, value FROM nw")
def em_symmetry(spark, sf):
    """A fluence-free iteration of a flat model under inversion."""
    return _once(spark, sf, 0.02, _scene(spark, sf, "inversion", 2, "l_suppkey"), likelihood="Poisson_fluence_free").model.select("n", F.round("value", 5).alias("value"))


@query(f"WITH {_scene_sql('P1', 2, _SUPPLIED, pad=1)}, {_step_sql(0.02, fluence=True)} SELECT 'fluence' AS kind, d AS id, round(fluence, 5) AS value FROM fl UNION ALL SELECT 'wsum', r, round(wsum, 5) FROM wp UNION ALL SELECT 'model', n, value FROM nw UNION ALL SELECT 'ksum', d, ksum_p FROM fs WHERE ksum_p > 0")
def em_two_masks(spark, sf):
    """Expectation over fewer pixels than maximisation: fluences and model follow the mask, posteriors, sums and counts behind
    them the padded one."""
    state, weights, photons = scene = _scene(spark, sf, "P1", 2, "l_suppkey", pad=1)
    done = _once(spark, sf, 0.02, scene, frame_model="fluence")
    sums = estep.template_sums(em.templates_of(state), state.p_weights)
    seen = estep.frame_sums(photons.join(state.p_weights, "i", "left_semi"))
    rows = (done.frames.select("d", "fluence"), sums.select("r", "wsum"), done.model.select("n", "value"), seen.select("d", "ksum"))
    named = [x.toDF("id", "value").select(F.lit(k).alias("kind"), F.col("id").cast("long").alias("id"), F.round(F.col("value").cast("double"), 5).alias("value")) for k, x in zip(("fluence", "wsum", "model", "ksum"), rows, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


@query(f"WITH {_scene_sql('P1', 2, _ORDERED, model='CASE WHEN range % 4 = 0 THEN coalesce(avg(p_retailprice) / 1000, 0.05) ELSE 0 END')}, {_step_sql(1.0)} SELECT d, r, round(p, 6) AS p FROM po")
def em_sparse_templates(spark, sf):
    """Posteriors where most frames and templates meet in no pixel, and some frames have no photons at all."""
    scene = _scene(spark, sf, "P1", 2, "l_orderkey", value=F.when(F.col("n") % 4 == 0, F.coalesce("price", F.lit(0.05))).otherwise(0.0))
    return _once(spark, sf, 1.0, scene, update_model=False).post.select("d", "r", *r6("p"))


# ---- reports

_AS = "asg AS (SELECT (o_orderkey // 500)::INT AS iteration, o_orderkey % 500 AS d, o_custkey % 4 AS c, o_custkey % 32 AS r FROM orders)"


def _assigned(spark, sf) -> DataFrame:
    o = T.read(spark, sf, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 500).cast("int").alias("iteration"), (F.col("o_orderkey") % 500).alias("d"), (F.col("o_custkey") % 4).alias("c"), (F.col("o_custkey") % 32).alias("r"))


@query(f"WITH {_AS}, x AS (SELECT *, lag(c) OVER w AS c0, lag(r) OVER w AS r0 FROM asg WINDOW w AS (PARTITION BY d ORDER BY iteration)) SELECT iteration, sum((c IS DISTINCT FROM c0)::INT)::BIGINT AS class_changes, sum((r IS DISTINCT FROM r0)::INT)::BIGINT AS orientation_changes FROM x GROUP BY iteration")
def class_changes(spark, sf):
    return report.assignment_changes(_assigned(spark, sf))


@query(f"WITH {_AS}, x AS (SELECT *, lag(c) OVER w AS c0 FROM asg WINDOW w AS (PARTITION BY d ORDER BY iteration)) SELECT iteration, c0, c, count(*) AS n FROM x WHERE c0 IS NOT NULL GROUP BY ALL")
def class_changes_all(spark, sf):
    """From which class to which frames went in every iteration."""
    return report.class_flows(_assigned(spark, sf))


_HS = f"{A}, hard AS (SELECT d, r AS c FROM po QUALIFY row_number() OVER (PARTITION BY d ORDER BY p DESC, r) = 1), lb AS (SELECT vec_id AS d, label % 3 AS label FROM embeddings), hs AS (SELECT label, c, coalesce(n, 0) AS n FROM (SELECT DISTINCT label FROM lb) CROSS JOIN (SELECT DISTINCT c FROM hard) LEFT JOIN (SELECT label, c, count(*) AS n FROM hard JOIN lb USING (d) GROUP BY ALL) USING (label, c))"


def _histogram(spark, sf) -> DataFrame:
    hard = estep.most_likely(Embeddings(spark, sf).post()).select("d", F.col("r").alias("c"))
    labels = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("d"), (F.col("label") % 3).alias("label"))
    return report.class_histogram(hard, labels)


@query(f"{_HS} SELECT label, c, n FROM hs")
def class_histogram(spark, sf):
    return _histogram(spark, sf)


@query(f"{_HS}, ab AS (SELECT c, sum(CASE WHEN label = 0 THEN n ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN label = 1 THEN n ELSE 0 END)::DOUBLE AS b FROM hs GROUP BY c) SELECT round(1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS dos FROM ab")
def degree_of_separation(spark, sf):
    return report.degree_of_separation(_histogram(spark, sf), 0, 1).select(*r6("dos"))


def _gini_sql(weight: str) -> str:
    return f"""WITH x AS (SELECT s_nationkey AS g, abs(s_acctbal) + s_suppkey / 1e6 AS v, {weight}::DOUBLE AS w FROM supplier),
    y AS (SELECT g, w, sum(v * w) OVER (PARTITION BY g ORDER BY v ROWS UNBOUNDED PRECEDING) - v * w / 2 AS part, sum(v * w) OVER (PARTITION BY g) AS total, sum(w) OVER (PARTITION BY g) AS mass FROM x)
    SELECT g, round(1 - 2 * sum(w * part) / (max(total) * max(mass)), 6) AS gini FROM y GROUP BY g"""


def _balances(spark, sf) -> DataFrame:
    return T.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), (F.abs("s_acctbal") + F.col("s_suppkey") / 1e6).alias("v"), (1 + F.col("s_suppkey") % 4).cast("double").alias("w"))


@query(_gini_sql("1"))
def gini(spark, sf):
    return report.gini(_balances(spark, sf), ["g"], "v").select("g", *r6("gini"))


@query(_gini_sql("(1 + s_suppkey % 4)"))
def gini_weighted(spark, sf):
    return report.gini(_balances(spark, sf), ["g"], "v", "w").select("g", *r6("gini"))


@query("SELECT round(sqrt(avg(power(a.w - b.w, 2))), 6) AS rms FROM (SELECT l_partkey % 64 AS i, avg(l_quantity) AS w FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) a JOIN (SELECT l_partkey % 64 AS i, avg(l_quantity) AS w FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) b USING (i)")
def rms_change(spark, sf):
    rows = T.read(spark, sf, "lineitem")
    mean = lambda cond: rows.where(cond).groupBy((F.col("l_partkey") % 64).alias("i")).agg(F.avg("l_quantity").alias("value"))
    return report.rms_change(mean("l_linenumber <= 3"), mean("l_linenumber > 3"), "i").select(*r6("rms"))


_SL = f"WITH {_V16}, md AS (SELECT value, n // 256 AS i, (n // 16) % 16 AS j, n % 16 AS k FROM vo), sl AS (SELECT 0 AS axis, j AS u, k AS v, value FROM md WHERE i = 8 UNION ALL SELECT 1, i, k, value FROM md WHERE j = 8 UNION ALL SELECT 2, i, j, value FROM md WHERE k = 8)"


@query(f"{_SL} SELECT axis::INT AS axis, u::INT AS u, v::INT AS v, round(value, 6) AS value FROM sl")
def model_slices(spark, sf):
    return report.central_slices(_part_voxels(spark, sf, 16**3), 16).select("axis", "u", "v", *r6("value"))


@query(f"{_SL} SELECT ((axis // 2) * 16 + u)::BIGINT AS row, ((axis % 2) * 16 + v)::BIGINT AS col, round(value, 6) AS value FROM sl")
def mosaic(spark, sf):
    slices = report.central_slices(_part_voxels(spark, sf, 16**3), 16).withColumnRenamed("axis", "tile")
    return report.mosaic(slices, 16, 3).select("row", "col", *r6("value"))


@query(f"WITH {_vo(4096)} SELECT n, round(exp(-(power((n // 64 - 32) / 12.0, 2) + power((n % 64 - 32) / 20.0, 2)) / 2), 6) AS value FROM vo")
def gaussian_blob(spark, sf):
    return report.blob(_part_voxels(spark, sf, 4096), 64, (12.0, 20.0)).select("n", *r6("value"))


@query(f"{A} SELECT d, round(sum(p * cos(2 * pi() * r / 10)), 6) AS x, round(sum(p * sin(2 * pi() * r / 10)), 6) AS y FROM po GROUP BY d")
def occupancy_scatter(spark, sf):
    post = Embeddings(spark, sf).post().withColumnRenamed("r", "c")
    return report.occupancy_scatter(post, 10).select("d", *r6("x", "y"))


@query(f"{A}, hard AS (SELECT d, r AS c FROM po QUALIFY row_number() OVER (PARTITION BY d ORDER BY p DESC, r) = 1) SELECT d, ksum FROM hard JOIN fr USING (d) WHERE c = 3 ORDER BY ksum DESC, d LIMIT 20")
def top_frames(spark, sf):
    e = Embeddings(spark, sf)
    return report.brightest(e.frames, estep.most_likely(e.post()).withColumnRenamed("r", "c"), 3, 20)


@query(f"{A}, hard AS (SELECT d, r AS c FROM po QUALIFY row_number() OVER (PARTITION BY d ORDER BY p DESC, r) = 1) SELECT d, c FROM hard WHERE c IN (1, 4, 7)")
def good_class_frames(spark, sf):
    hard = estep.most_likely(Embeddings(spark, sf).post()).select("d", F.col("r").alias("c"))
    good = spark.createDataFrame([(1,), (4,), (7,)], "c int")
    return hard.join(F.broadcast(good), "c", "left_semi").select("d", "c")


# ---- timelines

_SP = "sp AS (SELECT event_type AS msg, epoch(ts) AS start, epoch(ts) + 300 AS stop FROM events)"


def _spans(spark, sf) -> DataFrame:
    return T.read(spark, sf, "events").select(F.col("event_type").alias("msg"), seconds().alias("start"), (seconds() + 300).alias("stop"))


def _marks(spark, sf) -> DataFrame:
    return T.read(spark, sf, "events").select(F.col("user_id").alias("pid"), F.lit("work").alias("msg"), seconds().alias("t"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("stop").alias("kind"))


@query("""WITH m AS (SELECT user_id AS pid, 'work' AS msg, epoch(ts) AS t, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'stop' END AS kind FROM events),
n AS (SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY pid, msg ORDER BY t, kind DESC ROWS UNBOUNDED PRECEDING) AS number FROM m),
g AS (SELECT pid, msg, number, min(CASE WHEN kind = 'start' THEN t END) AS start, max(CASE WHEN kind = 'stop' THEN t END) AS stop FROM n GROUP BY ALL)
SELECT pid, msg, number::BIGINT AS number, start, stop, CASE WHEN number = 0 THEN 'stop without start' WHEN stop IS NULL AND lead(number) OVER (PARTITION BY pid, msg ORDER BY number) IS NOT NULL THEN 'start while open' END AS fault FROM g""")
def log_intervals(spark, sf):
    return timeline.paired(_marks(spark, sf))


@query(f"""WITH {_SP}, a AS (SELECT *, max(stop) OVER (PARTITION BY msg ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY msg ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT msg, min(start) AS start, max(stop) AS stop, count(*) AS n FROM b GROUP BY msg, island""")
def log_islands(spark, sf):
    return timeline.islands(_spans(spark, sf))


@query(f"WITH {_SP}, n AS (SELECT *, row_number() OVER () AS id FROM sp) SELECT a.msg, count(b.id) AS pairs FROM n a LEFT JOIN n b ON a.msg = b.msg AND a.id < b.id AND a.start < b.stop AND b.start < a.stop GROUP BY a.msg")
def log_overlap_pairs(spark, sf):
    return timeline.overlap_counts(_spans(spark, sf))


@query(f"WITH {_SP} SELECT msg, round(sum(stop - start), 3) AS total FROM sp GROUP BY msg HAVING sum(stop - start) >= 0.02 * (SELECT max(stop) - min(start) FROM sp)")
def log_discard(spark, sf):
    return timeline.longest_messages(_spans(spark, sf), 0.02).select("msg", F.round("total", 3).alias("total"))


@query(f"""WITH RECURSIVE {_SP}, o AS (SELECT msg, start, stop, row_number() OVER (PARTITION BY msg ORDER BY start, stop) AS k FROM sp),
st AS (SELECT msg, 0::BIGINT AS k, []::DOUBLE[] AS ends, NULL::DOUBLE AS start, NULL::DOUBLE AS stop, NULL::INT AS line FROM (SELECT DISTINCT msg FROM sp)
  UNION ALL SELECT o.msg, o.k, CASE WHEN p IS NULL THEN list_append(ends, o.stop) ELSE list_concat(list_concat(ends[1:p - 1], [o.stop]), ends[p + 1:]) END, o.start, o.stop, (coalesce(p, len(ends) + 1) - 1)::INT
  FROM st JOIN o ON o.msg = st.msg AND o.k = st.k + 1, LATERAL (SELECT nullif(list_position(list_transform(ends, lambda e: e <= o.start), true), 0) AS p))
SELECT msg, start, stop, line FROM st WHERE k > 0""")
def log_packing(spark, sf):
    return timeline.packed(_spans(spark, sf))


@query("WITH x AS (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) IS DISTINCT FROM event_type AS new FROM events), y AS (SELECT *, sum(new::INT) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT min(event_id) AS first, max(event_id) AS last, any_value(event_type) AS value FROM y GROUP BY run")
def change_ranges(spark, sf):
    return timeline.change_ranges(T.read(spark, sf, "events").select("event_id", "event_type"), "event_id", "event_type")


@query("WITH n AS (SELECT count(*) AS n, min(c_custkey) AS low FROM customer) SELECT c_custkey - low AS d, (ceil((c_custkey - low + 1) * 7 / n::DOUBLE) - 1)::INT AS chunk FROM customer, n")
def chunk_ranges(spark, sf):
    rows = T.read(spark, sf, "customer").select("c_custkey")
    low = rows.agg(F.min("c_custkey").alias("low"))
    return report.chunks(rows.crossJoin(F.broadcast(low)).select((F.col("c_custkey") - F.col("low")).alias("d")), "d", 7).select("d", "chunk")


# ---- further forms


@query(f"{B} SELECT d, r, i, round(fluence * c * w + bg_weight * v + 1e-9, 5) AS f FROM fr JOIN bg ON bg_id = b JOIN wt USING (i) JOIN tm USING (i)")
def predicted_frames(spark, sf):
    b = Lineitems(spark, sf)
    return estep.predicted_frames(b.frames, b.templates, b.weights, b.background).select("d", "r", "i", F.round(F.col("f") + 1e-9, 5).alias("f"))


@query(f"{B}, be AS (SELECT d, r FROM po QUALIFY row_number() OVER (PARTITION BY d ORDER BY p DESC, r) = 1) SELECT d, r, i, round(fluence * c * w + bg_weight * v + 1e-9, 5) AS f FROM be JOIN fr USING (d) JOIN bg ON bg_id = b JOIN wt USING (i) JOIN tm USING (r, i)")
def predicted_frames_likely(spark, sf):
    """Every frame as its most likely template has it."""
    b = Lineitems(spark, sf)
    return estep.predicted_frames(b.frames, b.templates, b.weights, b.background, estep.most_likely(b.post)).select("d", "r", "i", F.round(F.col("f") + 1e-9, 5).alias("f"))


@query(SQL["predicted_frames"])
def predicted_frames_all(spark, sf):
    """Every frame as every template has it."""
    return predicted_frames(spark, sf)


@query(f"{B} SELECT d, r, round(sum(k * CASE WHEN fluence * c * w + bg_weight * v > 0 THEN ln(fluence * c * w + bg_weight * v) ELSE 0 END), 5) AS kf FROM ph JOIN fr USING (d) JOIN bg ON bg_id = b AND bg.i = ph.i JOIN wt ON wt.i = ph.i JOIN tm ON tm.i = ph.i GROUP BY d, r")
def k_log_f(spark, sf):
    b = Lineitems(spark, sf)
    return estep.k_log_f(b.photons, b.frames, b.templates, b.weights, b.background).select("d", "r", F.round("kf", 5).alias("kf"))


@query(f"{A} SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT d, count(*) AS n FROM po GROUP BY d)")
def posterior_statistics(spark, sf):
    return estep.posterior_statistics(Embeddings(spark, sf).post()).select("least", "most", *r6("mean"))


@query(f"{A} SELECT d, r, round(p, 6) AS p FROM po WHERE p > 0.3")
def posterior_sparse(spark, sf):
    return Embeddings(spark, sf).post().where("p > 0.3").select("d", "r", *r6("p"))


@query(f"WITH {BP}, {BG}, {BF} SELECT d, round(bg_weight * (SELECT sum(v) FROM bg WHERE b = bg_id), 8) AS total FROM fr")
def background_counts(spark, sf):
    b = Lineitems(spark, sf)
    return report.background_counts(b.frames, b.background).select("d", F.round("total", 8).alias("total"))


@query(f"WITH {PH}, {FR} SELECT d, ksum FROM fr ORDER BY ksum DESC, d")
def frames_by_count(spark, sf):
    return Embeddings(spark, sf).frames.orderBy(F.desc("ksum"), "d").select("d", "ksum")


@query(f"WITH {PH} SELECT i, d, k FROM ph")
def transposed(spark, sf):
    """Written by pixel and read back."""
    path = f"{T.shared_dir(spark)}/transposed-{uuid.uuid4().hex}"
    T.write_transposed(Embeddings(spark, sf).photons, path)
    return spark.read.parquet(path)


@query(f"WITH {PH} SELECT i, sum(k)::BIGINT AS total, count(*) AS frames FROM ph GROUP BY i")
def transposed_sums(spark, sf):
    """Sums of every pixel out of the files by pixel."""
    path = f"{T.shared_dir(spark)}/transposed-{uuid.uuid4().hex}"
    T.write_transposed(Embeddings(spark, sf).photons, path)
    return spark.read.parquet(path).groupBy("i").agg(F.sum("k").alias("total"), F.count("*").alias("frames"))


@query(f"WITH {PH} SELECT i, d, k FROM ph")
def transposed_all(spark, sf):
    """Every photon out of the files by pixel."""
    return transposed(spark, sf)


@query(f"WITH {PH} SELECT d, sum(k)::BIGINT AS ksum FROM ph WHERE i % 3 <> 0 GROUP BY d")
def masked_sums(spark, sf):
    mask = spark.range(64).where("id % 3 <> 0").select(F.col("id").cast("int").alias("i"))
    return Embeddings(spark, sf).photons.join(F.broadcast(mask), "i", "left_semi").groupBy("d").agg(F.sum("k").alias("ksum"))


@query(f"{_MAP} SELECT s, r, round(m00, 6) AS m00 FROM mp WHERE scale_id = 1")
def scale_selection(spark, sf):
    return _mapping(spark, sf).where("scale_id = 1").select("s", "r", *r6("m00"))


@query(f"{A}, hard AS (SELECT d, r AS c FROM po QUALIFY row_number() OVER (PARTITION BY d ORDER BY p DESC, r) = 1) SELECT d, 'good' AS label, c IN (1, 4, 7) AS value FROM hard")
def good_frame_labels(spark, sf):
    hard = estep.most_likely(Embeddings(spark, sf).post()).select("d", F.col("r").alias("c"))
    return report.label_frames(hard, spark.createDataFrame([(1,), (4,), (7,)], "c int"), "good")


@query(f"{A} SELECT round(sum(p), 5) AS n FROM po WHERE r IN (SELECT label FROM embeddings WHERE vec_id < 5)")
def selected_count(spark, sf):
    post = Embeddings(spark, sf).post()
    chosen = T.read(spark, sf, "embeddings").where("vec_id < 5").select(F.col("label").alias("c"))
    return report.selected_count(post.select(F.col("r").alias("c"), "p"), chosen).select(F.round("n", 5).alias("n"))


@query(f"WITH {BT}, dr AS (SELECT range AS draw, (range % 7 + 1)::INT AS r, ((range * 7919) % 1000 + 0.5::DOUBLE) / 1000 AS u FROM range(500)), cu AS (SELECT r, i, w, sum(w) OVER (PARTITION BY r ORDER BY i) AS high, sum(w) OVER (PARTITION BY r) AS total FROM tm) SELECT draw, r, i FROM cu JOIN dr USING (r) WHERE u * total >= high - w AND u * total < high")
def pixel_quantiles(spark, sf):
    draw = F.col("id")
    draws = spark.range(500).select(draw.alias("draw"), (draw % 7 + 1).cast("int").alias("r"), ((draw * 7919 % 1000 + 0.5) / 1000).alias("u"))
    return report.pixel_quantiles(T.lineitem_templates(spark, sf), draws)


@query("SELECT user_id AS pid, min(epoch(ts)) AS first, max(epoch(ts) + 300) AS last, round(sum(300.0::DOUBLE), 3) AS busy, count(*) AS n FROM events GROUP BY user_id")
def log_processes(spark, sf):
    rows = T.read(spark, sf, "events").select(F.col("user_id").alias("pid"), seconds().alias("start"), (seconds() + 300).alias("stop"))
    return timeline.processes(rows).withColumn("busy", F.round("busy", 3))


@query("SELECT user_id AS pid, event_type AS msg, epoch(ts) AS start, epoch(ts) + 300 AS stop, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts)::INT - 1 AS number FROM events")
def log_numbered(spark, sf):
    return timeline.numbered(T.read(spark, sf, "events").select(F.col("user_id").alias("pid"), F.col("event_type").alias("msg"), seconds().alias("start"), (seconds() + 300).alias("stop")))


@query(f"WITH {PH}, x AS (SELECT d, k, row_number() OVER (PARTITION BY d ORDER BY k DESC, i) AS n FROM ph) SELECT d, sum(k)::BIGINT AS top FROM x WHERE n <= 5 GROUP BY d")
def brightest_pixels(spark, sf):
    from pyspark.sql import Window

    line = Window.partitionBy("d").orderBy(F.desc("k"), "i")
    return Embeddings(spark, sf).photons.withColumn("n", F.row_number().over(line)).where("n <= 5").groupBy("d").agg(F.sum("k").alias("top"))


# ---- writers, readers and parts of the drivers


@query(f"WITH {PH} SELECT d, i, k FROM ph WHERE d >= 100 AND d <= 299")
def cache_range(spark, sf):
    """A range of frames out of a written cache."""
    path = f"{T.shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    T.write_cache(Embeddings(spark, sf).photons, path, 64)
    return T.read_cache(spark, path, 100, 299)


@query(f"WITH {PH}, {FR}, o AS (SELECT d, ksum, row_number() OVER (ORDER BY d) - 1 AS place, count(*) OVER () AS total FROM fr) SELECT d, ksum FROM o WHERE place * 3 // total = 1")
def ranked_frames(spark, sf):
    """What the second of three workers loads."""
    return T.ranked(Embeddings(spark, sf).frames, 1, 3).select("d", "ksum")


@query(f"{A}, hard AS (SELECT d, r AS c FROM po QUALIFY row_number() OVER (PARTITION BY d ORDER BY p DESC, r) = 1) SELECT label, d, value FROM (SELECT d, 'good' AS label, c IN (1, 4, 7) AS value FROM hard UNION ALL SELECT d, 'saturated', sum((k >= 3)::INT) >= 10 FROM ph GROUP BY d)")
def written_labels(spark, sf):
    """Labels as partitions of one table, one of them written twice."""
    path = f"{T.shared_dir(spark)}/labels-{uuid.uuid4().hex}"
    bad = good_frame_labels(spark, sf).select("d", (~F.col("value")).alias("value"))
    for label, rows in (("good", bad), ("good", good_frame_labels(spark, sf)), ("saturated", saturation(spark, sf).withColumnRenamed("saturated", "value"))):
        put(rows.select("d", "value"), path, label=label)
    return Versioned(spark, path).read().select("label", "d", "value")


@query(f"{_SL} SELECT axis::INT AS axis, u::INT AS u, v::INT AS v, round(value, 6) AS value, it::INT AS iteration FROM sl, (VALUES (0), (1)) q(it)")
def written_slices(spark, sf):
    """Central slices of a model, kept for each iteration."""
    path = f"{T.shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    for iteration in (0, 1):
        put(model_slices(spark, sf), path, iteration=iteration)
    return Versioned(spark, path).read()


@query(f"WITH {_AS} SELECT iteration, r, c FROM asg WHERE d = 7")
def frame_history(spark, sf):
    """What one frame was assigned in every iteration, out of a store."""
    path = f"{T.shared_dir(spark)}/history-{uuid.uuid4().hex}"
    Versioned(spark, f"{path}/assigned").put_each(_assigned(spark, sf).select("iteration", "d", "r", "c", F.lit(1.0).alias("p")), "iteration")
    return Store(spark, path).history(7).select("iteration", "r", "c")


@query(f"WITH {_AS}, lb AS (SELECT range AS d, range % 3 AS label FROM range(500)), ab AS (SELECT iteration, c, sum((label = 0)::INT)::DOUBLE AS a, sum((label = 1)::INT)::DOUBLE AS b FROM asg JOIN lb USING (d) WHERE label < 2 GROUP BY ALL) SELECT iteration, round(1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS dos FROM ab GROUP BY iteration")
def separation_series(spark, sf):
    labels = spark.range(500).select(F.col("id").alias("d"), (F.col("id") % 3).alias("label"))
    return report.separation_series(_assigned(spark, sf), labels, 0, 1).select("iteration", *r6("dos"))


@query("""WITH m AS (SELECT user_id AS pid, event_type AS msg, epoch(ts) AS t, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'stop' END AS kind FROM events),
n AS (SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY pid, msg ORDER BY t, kind DESC ROWS UNBOUNDED PRECEDING) AS number FROM m),
g AS (SELECT pid, msg, number, min(CASE WHEN kind = 'start' THEN t END) AS start, max(CASE WHEN kind = 'stop' THEN t END) AS stop FROM n GROUP BY ALL),
k AS (SELECT pid, msg, start, stop FROM g WHERE number > 0 AND stop IS NOT NULL)
SELECT pid, msg, (row_number() OVER (PARTITION BY pid, msg ORDER BY start, stop) - 1)::INT AS line, start, stop FROM k
WHERE msg IN (SELECT msg FROM k GROUP BY msg HAVING sum(stop - start) >= 0.01 * (SELECT max(t) - min(t) FROM m))""")
def timeline_view(spark, sf):
    e = T.read(spark, sf, "events")
    marks = e.select(F.col("user_id").alias("pid"), F.col("event_type").alias("msg"), seconds().alias("t"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("stop").alias("kind"))
    return timeline.view(marks, discard=0.01)


@query("WITH n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT s_suppkey, s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS d FROM supplier), k AS (SELECT s_suppkey, d, n, (ceil((d + 1) * 7 / n::DOUBLE) - 1)::INT AS chunk FROM c, n) SELECT s_suppkey, chunk, ((d - chunk * n // 7) // 4)::INT AS part FROM k")
def chunk_two_level(spark, sf):
    rows = T.read(spark, sf, "supplier").select("s_suppkey")
    low = rows.agg(F.min("s_suppkey").alias("low"))
    dense = rows.crossJoin(F.broadcast(low)).withColumn("d", F.col("s_suppkey") - F.col("low"))
    return report.chunks(dense, "d", 7, 4).select("s_suppkey", "chunk", "part")


@query("SELECT o_orderkey, ((o_orderkey - 10) // 1000)::INT AS chunk FROM orders WHERE o_orderkey >= 10")
def chunk_fixed(spark, sf):
    return report.fixed_chunks(T.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000, 10)


@query(f"WITH {_V16}, {_images_sql(16, 3, 'D6', 'vo')}, au AS (SELECT n, value FROM vo WHERE n // 256 <= 8 AND (n // 16) % 16 <= 8 AND n % 16 <= 8) SELECT m::BIGINT AS n, round(avg(value), 6) AS value FROM im JOIN au USING (n) GROUP BY m")
def expanded_model(spark, sf):
    """Values on an asymmetric unit spread over the grid."""
    rows = _part_voxels(spark, sf, 16**3)
    unit = symmetry.asymmetric_unit(rows, 16, 3, "D6").join(rows, "n")
    return symmetry.expanded(unit, 16, 3, "D6").select("n", *r6("value"))


@query(f"WITH {_DIR}, {_OPS}, rot AS (SELECT s, s00, s01, 0.0 AS s02, s10, s11, 0.0 AS s12, 0.0 AS s20, 0.0 AS s21, 1.0 AS s22 FROM ops) {_turned_sql(3, 's', 's')}")
def rotation_operators(spark, sf):
    """Directions under the operators that do not act on voxels."""
    return _turned(spark, sf, symmetry.rotation_operators(spark, "D6"), 3, "s", "s")


@query(f"WITH {_DIR} SELECT s_suppkey, round(v0, 6) AS y0, round(v1, 6) AS y1, round(v2, 6) AS y2 FROM dir")
def rotation_identity(spark, sf):
    """Order zero in two dimensions leaves directions as they are."""
    return _turned(spark, sf, geometry.rotations(spark, 0, 2), 1)


@query("SELECT r FROM (SELECT DISTINCT o_custkey % 663 AS r FROM orders) ORDER BY md5('0:' || r), r LIMIT 20")
def orientation_sample(spark, sf):
    """Twenty of the orientations that orders were assigned to."""
    used = T.read(spark, sf, "orders").select((F.col("o_custkey") % 663).alias("r")).distinct()
    return geometry.orientation_sample(geometry.rotations(spark, 4, 3).join(used, "r", "left_semi")).select("r")


@query(f"WITH {_V16} SELECT n, round(value - 0.909, 6) AS value FROM vo WHERE value > 0.909")
def positive_voxels(spark, sf):
    return report.positive_voxels(_part_voxels(spark, sf, 16**3).withColumn("value", F.col("value") - 0.909)).select("n", *r6("value"))


@query("WITH b AS (SELECT s_suppkey AS k, s_nationkey AS v, s_suppkey % 3 AS batch FROM supplier) SELECT v, arg_max(k, batch * 1000000000 + k) AS k FROM b GROUP BY v")
def latest_rows(spark, sf):
    rows = T.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("v"), (F.col("s_suppkey") % 3).alias("batch"), F.col("s_suppkey").alias("k"))
    return streams.latest(rows, ["v"]).select("v", "k")


@query(f"WITH {_PX}, lim AS (SELECT 0.12::DOUBLE AS q, 0.12::DOUBLE / 7 AS dq), kept AS (SELECT i, x, y, z FROM q3, lim WHERE good AND qr <= q), rot AS (SELECT range AS r, 2 * pi() * range / 12 + 0.37576737726076753 AS a FROM range(12)), u AS (SELECT r, i, (cos(a) * x - sin(a) * y) / sqrt(x * x + y * y + z * z) / (2 * dq) + 8 AS u0, (sin(a) * x + cos(a) * y) / sqrt(x * x + y * y + z * z) / (2 * dq) + 8 AS u1 FROM kept, rot, lim), v AS (SELECT r, i, round_even(u0, 0)::BIGINT AS a, round_even(u1, 0)::BIGINT AS b FROM u) SELECT r, i, a * 16 + b AS n FROM v WHERE a BETWEEN 0 AND 15 AND b BETWEEN 0 AND 15")
def initial_voxels(spark, sf):
    """The voxels that a first state gives each orientation and pixel."""
    g = initial.Geometry(2.0, 0.0001, 16, 12, 2, q_max=0.12, polarisation="x")
    state, _ = initial.initialise(_detector(spark, sf), Embeddings(spark, sf).frames, g, 0.2)
    return state.voxels.select("r", "i", "n")


# ---- versions, streams and scans


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey < (SELECT max(o_orderkey) FROM orders) // 2 THEN -1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders) // 2 OR o_orderkey % 2 = 0")
def store_upsert(spark, sf):
    """Orders in a versioned table whose two halves are replaced: the first with other owners, the second by its even keys, in
    two slices, one of which comes twice."""
    orders = T.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    half, end = last // 2, last + 1
    store = Versioned(spark, f"{T.shared_dir(spark)}/orders-{uuid.uuid4().hex}")
    store.upsert(orders, "o_orderkey", 0, end)
    store.upsert(orders.where(F.col("o_orderkey") < half).withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_custkey"))), "o_orderkey", 0, half)
    for number, (a, b) in enumerate(((half, half + (end - half) // 2), (half + (end - half) // 2, end))):
        for _ in range(2 - number):
            store.upsert(orders.where((F.col("o_orderkey") >= a) & (F.col("o_orderkey") < b) & (F.col("o_orderkey") % 2 == 0)), "o_orderkey", a, b, ("halves", number))
    return store.read()


@query("SELECT o_orderkey, h, sum(1) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS place, (sum(o_orderkey) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) - o_orderkey)::BIGINT AS start FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders)")
def scan_of_hashes(spark, sf):
    """Places and running sums in the order of keys that are spread like chance."""
    rows = T.read(spark, sf, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    placed = scans.running_sum(rows.withColumn("one", F.lit(1)), ["h"], "one", "place")
    return scans.running_sum(placed.select("o_orderkey", "h", "place"), ["h"], "o_orderkey").select("o_orderkey", "h", "place", "start")


@query(SQL["log_intervals"])
def log_stream(spark, sf):
    """The intervals of a log that arrives in files, each a batch: open starts are state, closed and open intervals leave it."""
    folder = f"{T.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    marks = _marks(spark, sf)
    logs.in_order(marks, f"{folder}/in", 4)
    stream = spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    logs.keep_intervals(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return logs.intervals(spark, f"{folder}/out")


_RB = "pn AS (SELECT count(DISTINCT p_partkey % 256) AS n FROM part), cn AS (SELECT count(DISTINCT o_custkey) AS n FROM orders)"


@query(f"WITH {_RB} SELECT name, version, n FROM (SELECT 'detector' AS name, 1 AS version, n FROM pn UNION ALL SELECT 'turned', 2, 3 * n FROM pn UNION ALL SELECT 'owners', 1, n FROM cn UNION ALL SELECT 'pairs', 2, 3 * p.n + c.n FROM pn p, cn c)")
def partial_rebuild(spark, sf):
    """Artefacts built, asked for again unchanged, and again after one setting has changed: only what depends on it is made twice."""
    made = artefacts.Artefacts(spark, f"{T.shared_dir(spark)}/artefacts-{uuid.uuid4().hex}")
    detector, owners = _detector(spark, sf), T.read(spark, sf, "orders").select("o_custkey").distinct()
    recipes = [
        artefacts.Recipe("detector", lambda _, s: detector),
        artefacts.Recipe("turned", lambda p, s: p["detector"].select("i", F.explode(F.sequence(F.lit(1), F.lit(s["turns"]))).alias("turn")), ("detector",), ("turns",)),
        artefacts.Recipe("owners", lambda _, s: owners),
        artefacts.Recipe("pairs", lambda p, s: p["turned"].select(F.col("i").cast("long").alias("k")).unionAll(p["owners"].select(F.col("o_custkey").alias("k"))), ("turned", "owners")),
    ]
    inputs = {"detector": T.read(spark, sf, "part"), "owners": T.read(spark, sf, "orders")}
    for turns in (2, 2, 3):
        found = made.build(recipes, {"turns": turns}, inputs)
    rows = [found[r.name].agg(F.count("*").alias("n")).select(F.lit(r.name).alias("name"), F.lit(made.version(r.name)).alias("version"), "n") for r in recipes]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


@query(f"WITH {PH}, q AS (SELECT d, i, k, (SELECT max(vec_id) FROM embeddings) AS most FROM ph) SELECT d, i, k FROM q WHERE d >= most // 4 AND d < most // 2")
def frame_source(spark, sf):
    """Frames written as arrays, and a range of them read back through the source of its own."""
    path = f"{T.shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    e = Embeddings(spark, sf)
    arrays.write_frames(e.photons.select(F.col("d").cast("long").alias("d"), "i", "k"), path)
    last = T.read(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    return arrays.read_frames(spark, path, last // 4, last // 2 - 1).select("d", "i", "k")


# ---- caches, logs and first states from files


@query("WITH a AS (SELECT l_suppkey AS d, (l_partkey % 16)::INT AS i, count(*)::INT AS k FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey AS d, (l_partkey % 16)::INT AS i, count(*)::INT AS k FROM lineitem WHERE l_linenumber <= 6 GROUP BY ALL) SELECT d, i, k FROM (SELECT d, i, k FROM a EXCEPT ALL SELECT d, i, k FROM b)")
def cache_validity(spark, sf):
    """What a cache written from most of the lines lacks or has otherwise; nothing, where it is valid."""
    path = f"{T.shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    whole, rows = T.lineitem_photons(spark, sf), T.read(spark, sf, "lineitem").where("l_linenumber <= 6")
    older = rows.groupBy(F.col("l_suppkey").alias("d"), (F.col("l_partkey") % 16).cast("int").alias("i")).agg(F.count("*").cast("int").alias("k"))
    T.write_cache(older, path)
    cached = T.read_cache(spark, path)
    if T.same_rows(cached, whole) or not T.same_rows(cached, older):
        raise AssertionError("a stale cache passes for a valid one")
    return whole.select("d", "i", "k").exceptAll(cached.select("d", "i", "k"))


@query("SELECT s, count(DISTINCT p_partkey % 256) AS n, true AS own FROM (SELECT p_size % 3 AS s, p_partkey FROM part) GROUP BY s")
def cache_names(spark, sf):
    """Names of masks' caches: the number of pixels, and a hash that keeps different masks of one size apart; masks of the
    same pixels share theirs."""
    parts = T.read(spark, sf, "part").select((F.col("p_size") % 3).alias("s"), (F.col("p_partkey") % 256).alias("i")).distinct()
    masks = T.cut(parts.where("i is not null").select("s", F.explode(F.array(F.lit(0), F.lit(1))).alias("moved"), "i").select("s", "moved", (F.col("i") + F.col("moved")).alias("i")))
    names = T.cut(T.cache_keys(masks, ["s", "moved"]))
    named = masks.alias("a").join(names.alias("k"), F.col("a.s").eqNullSafe(F.col("k.s")) & (F.col("a.moved") == F.col("k.moved"))).select("name", "i")
    # Masks that share a name: every pixel of each must be the others' too.
    least = named.groupBy("name", "i").agg(F.count("*").alias("masks")).groupBy("name").agg(F.min("masks").alias("least"))
    apart = least.join(names.groupBy("name").agg(F.count("*").alias("users")), "name").select("name", (F.col("least") == F.col("users")).alias("own"))
    own = names.join(apart, "name").groupBy("s").agg(F.max(F.when(F.col("moved") == 0, F.col("n"))).alias("n"), F.min("own").alias("own"))
    every = parts.select(F.col("s").alias("g")).distinct()
    return every.join(own, F.col("g").eqNullSafe(F.col("s")), "left").select(F.col("g").alias("s"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("own", F.lit(True)).alias("own"))


@query(f"WITH {PH} SELECT i, sum(k)::BIGINT AS total FROM ph GROUP BY i")
def found_cache(spark, sf):
    """The one cache among several places, by a glob."""
    folder = f"{T.shared_dir(spark)}/caches-{uuid.uuid4().hex}"
    T.write_cache(Embeddings(spark, sf).photons, f"{folder}/mask-a", 64)
    return T.find_cache(spark, [f"{folder}/none*", f"{folder}/mask-a"]).groupBy("i").agg(F.sum("k").alias("total"))


@query("SELECT user_id::VARCHAR AS pid, event_type AS msg, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'stop' END AS kind, count(*) AS n, sum(floor(epoch(ts)) + 0.25) AS t FROM events GROUP BY ALL")
def log_lines(spark, sf):
    """Events as lines of a log among lines that are none, read back and parsed."""
    path = f"{T.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows = T.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("pid"), F.col("event_type").alias("msg"), (F.floor(seconds()) + 0.25).alias("t"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("stop").alias("kind"))
    line = F.concat(F.format_string("%.3f", "t"), F.lit(":INFO:"), "pid", F.lit(":run.py:main:12: at work: "), "msg", F.lit(" ("), "kind", F.lit(")"))
    rows.select(F.explode(F.array(line, F.lit("a line that is none"), F.lit("1.0:INFO:7:run.py:main:3: no mark"))).alias("value")).write.text(path)
    return timeline.read_log(spark, path).groupBy("pid", "msg", "kind").agg(F.count("*").alias("n"), F.sum("t").alias("t"))


@query("SELECT pid, msg, number, start, stop FROM (SELECT user_id AS pid, event_type AS msg, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) - 1 AS number, epoch(ts) AS start, epoch(ts) + 300 AS stop FROM events) ORDER BY start, pid, msg, number LIMIT 100")
def first_spans(spark, sf):
    """The first hundred messages of a log."""
    return timeline.first_messages(log_numbered(spark, sf), 100).select("pid", "msg", F.col("number").cast("long").alias("number"), "start", "stop")


@query("""WITH m AS (SELECT user_id AS pid, event_type AS msg, epoch(ts) AS t, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'stop' END AS kind FROM events),
n AS (SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY pid, msg ORDER BY t, kind DESC ROWS UNBOUNDED PRECEDING) AS number FROM m),
g AS (SELECT pid, msg, number, min(CASE WHEN kind = 'start' THEN t END) AS start, max(CASE WHEN kind = 'stop' THEN t END) AS stop FROM n GROUP BY ALL),
k AS (SELECT msg, start, stop FROM g WHERE number > 0 AND stop IS NOT NULL),
a AS (SELECT *, max(stop) OVER (PARTITION BY msg ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY msg ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT msg, 0::INT AS line, min(start) AS start, max(stop) AS stop FROM b GROUP BY msg, island""")
def timeline_collapsed(spark, sf):
    """A timeline whose overlapping spans of a message are one bar, on one line."""
    e = T.read(spark, sf, "events")
    marks = e.select(F.col("user_id").alias("pid"), F.col("event_type").alias("msg"), seconds().alias("t"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("stop").alias("kind"))
    return timeline.view(marks, collapse_overlap=True).select("msg", "line", "start", "stop")


@query(f"WITH {_scene_sql('P1', 2, _SUPPLIED)}, pm AS (SELECT ph.* FROM ph JOIN mk USING (i)) SELECT d, coalesce(sum(k), 0)::BIGINT AS ksum, 1.0::DOUBLE AS fluence FROM fr LEFT JOIN pm USING (d) GROUP BY d")
def initial_fluence(spark, sf):
    """Frames of a first state: their photons in the mask, none for dark ones, and a fluence of one."""
    return _scene(spark, sf, "P1", 2, "l_suppkey")[0].frames.select("d", "ksum", "fluence")


@query("SELECT o_orderkey, o_custkey FROM orders")
def stream_batches(spark, sf):
    """Orders as a stream of one file a batch, however many wait; the newest row of each."""
    folder = f"{T.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = T.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows.repartitionByRange(5, "o_orderkey").write.parquet(f"{folder}/in")
    stream = streams.photon_stream(spark, f"{folder}/in", "o_orderkey long, o_custkey long", 1)
    query = streams.keep_current(stream, f"{folder}/out", ["o_orderkey"], f"{folder}/checkpoint")
    query.awaitTermination()
    if len([p for p in query.recentProgress if p["numInputRows"]]) < 5:
        raise AssertionError("a batch has taken more files than allowed")
    return streams.latest(spark.read.parquet(f"{folder}/out"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query(SQL["em_initial_d6"])
def em_project(spark, sf):
    """The model of a project: one call sets it up and iterates, a second finds all of it done."""
    photons = T.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("d"), (F.col("l_partkey") % 64).cast("int").alias("i")).agg(F.count("*").cast("int").alias("k"))
    frames = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("d")).unionByName(T.read(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("d")))
    shape = {"wavelength": 2.0, "area": 0.0001, "size": 9, "rotation_order": 1, "dimensions": 3, "symmetry": "D6", "q_max": 0.12}
    options = {"classes": [shape], "z": 0.2, "em": {"iterations": 1, "beta_start": 0.02, "beta_stop": 0.02, "threshold": 1e-3}}
    path = f"{T.shared_dir(spark)}/project-{uuid.uuid4().hex}"
    for _ in range(2):
        state, _ = project.Project(spark, path, options).run(_part_pixels(spark, sf), frames, photons, models={0: _part_model(spark, sf, 9**3)})
    return state.model.select("n", F.round("value", 5).alias("value"))
