"""Registered queries of the imaging operators on the driver's tables, and their SQL.

``embeddings`` stands for signals of 64 samples (also: a video of 64 frames whose pixels are
the vectors, 20 to a row), ``label`` for branches, ``label = 1`` for the artery mask; ``events``
averaged over 6 hours stand for irregular signals.  Results are rounded to six decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import coefficients as C
from .operators import images as I
from .operators import inference as N
from .operators import linear as L
from .operators import morphology
from .operators import masks as M
from .operators import pulse

#: Samples of a signal, pixels of a row, sampling rate in Hz.
T, WIDTH, RATE = 64, 20, 40.0
_queries: dict = {}
_oracles: dict = {}
SIG = "sig AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS t, unnest(embedding)::DOUBLE AS v FROM embeddings)"
EVT = "evt AS (SELECT user_id, floor(epoch(ts) / 21600)::BIGINT AS b, avg(value) AS v FROM events GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark, sf_dir) -> DataFrame:
    """One array per row: vec_id, label, x."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("x"))


def samples(spark, sf_dir) -> DataFrame:
    """Long form: vec_id, label, t, v."""
    return signals(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("t", "v"))


def evt(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600).alias("b")).agg(F.avg("value").alias("v"))


def r6(c: Column) -> Column:
    return (F.round(c, 6) + 0.0).alias("v")


def long(df: DataFrame, array: Column, *keys: str, name: str = "v") -> DataFrame:
    """An array column as rows (keys, t, v)."""
    out = df.select(*keys, F.posexplode(array).alias("t", name))
    return out.withColumn("t", F.col("t").cast("long"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.round("v", 6) + 0.0)


# ---- images and videos


@query(f"WITH {SIG} SELECT vec_id, round(avg(v), 6) + 0.0 AS v FROM sig GROUP BY 1")
def temporal_mean_image(spark, sf_dir):
    return rounded(I.temporal_mean(samples(spark, sf_dir), ["vec_id"]))


@query(f"WITH {SIG}, i AS (SELECT vec_id, avg(v) AS v FROM sig GROUP BY 1) SELECT vec_id, floor((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + 1e-8::DOUBLE) * 255)::SMALLINT AS v FROM i")
def minmax_uint8_image(spark, sf_dir):
    return I.to_uint8(I.temporal_mean(samples(spark, sf_dir), ["vec_id"]))


@query(f"WITH {EVT} SELECT user_id, b, round((v - min(v) OVER (PARTITION BY user_id)) / (max(v) OVER (PARTITION BY user_id) - min(v) OVER (PARTITION BY user_id) + 1e-8::DOUBLE), 6) + 0.0 AS v FROM evt")
def minmax_normalize(spark, sf_dir):
    return rounded(I.minmax(evt(spark, sf_dir), "v", ["user_id"])).select("user_id", "b", "v")


@query(f"WITH {SIG}, e AS (SELECT min(v) AS a, max(v) AS b FROM sig) SELECT vec_id, t::BIGINT AS t, round(CASE WHEN a < 0 OR b > 1 THEN (v - a) / (b - a) ELSE v END, 6) + 0.0 AS v FROM sig, e")
def video_to_unit(spark, sf_dir):
    return rounded(I.video_to_unit(samples(spark, sf_dir))).select("vec_id", F.col("t").cast("long").alias("t"), "v")


@query(f"""WITH {SIG}, n AS (SELECT max(vec_id) // {WIDTH} + 1 AS h FROM embeddings),
g AS (SELECT vec_id, t, v + 1 AS a, (v + 1) / (1 + vec_id % 7) AS b, vec_id // {WIDTH} AS y, vec_id % {WIDTH} AS x, h FROM sig, n),
k AS (SELECT sum(a) / sum(b) AS k FROM g WHERE y >= ceil(0.15::DOUBLE * h) AND y < floor(0.85::DOUBLE * h) AND x >= 3 AND x < 17)
SELECT vec_id, t::BIGINT AS t, round(b * k, 6) + 0.0 AS v FROM g, k""")
def energy_restore(spark, sf_dir):
    s = samples(spark, sf_dir).withColumns({"y": F.floor(F.col("vec_id") / WIDTH), "x": F.col("vec_id") % WIDTH, "a": F.col("v") + 1, "b": (F.col("v") + 1) / (1 + F.col("vec_id") % 7)})
    rows = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] // WIDTH + 1
    return I.energy_restore(s, "a", "b", rows, WIDTH).select("vec_id", F.col("t").cast("long").alias("t"), r6(F.col("b")))


@query(f"WITH {SIG} SELECT t::BIGINT AS t, round(sum(v) / (SELECT count(*) FROM embeddings WHERE label = 1), 6) + 0.0 AS v FROM sig WHERE label = 1 GROUP BY 1")
def mask_pulse(spark, sf_dir):
    s = samples(spark, sf_dir)
    mask = table(spark, sf_dir, "embeddings").where("label = 1").select("vec_id")
    return rounded(I.mask_pulse(s, mask, ["vec_id"], ["t"])).select(F.col("t").cast("long").alias("t"), "v")


@query(f"WITH {EVT}, m AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0) SELECT b, round(sum(v) / (SELECT count(*) FROM m), 6) + 0.0 AS v FROM evt WHERE user_id IN (SELECT user_id FROM m) GROUP BY 1")
def mask_pulse_missing(spark, sf_dir):
    mask = table(spark, sf_dir, "events").where("user_id % 3 = 0").select("user_id").distinct()
    return rounded(I.mask_pulse(evt(spark, sf_dir), mask, ["user_id"], ["b"])).select("b", "v")


@query(f"WITH {SIG} SELECT label, t::BIGINT AS t, round(avg(v), 6) + 0.0 AS v FROM sig GROUP BY 1, 2")
def branch_mean_signal(spark, sf_dir):
    return rounded(I.temporal_mean(samples(spark, sf_dir), ["label", "t"])).withColumn("t", F.col("t").cast("long"))


@query(f"WITH {SIG}, b AS (SELECT label, t, avg(v) AS v FROM sig GROUP BY 1, 2) SELECT label, t::BIGINT AS t, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) + 0.0 AS v FROM b WINDOW w AS (PARTITION BY label)")
def zscore_branch(spark, sf_dir):
    means = I.temporal_mean(samples(spark, sf_dir), ["label", "t"])
    rows = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("x"))  # one row per branch, as long as the video
    return rounded(long(rows, A.zscore(F.col("x")), "label"))


@query(f"""WITH {SIG}, s AS (SELECT t, avg(v) AS s FROM sig WHERE label = 1 GROUP BY 1), g AS (SELECT stddev_pop(v) AS a FROM sig), h AS (SELECT stddev_pop(s) AS b FROM s)
SELECT vec_id, round(covar_pop(v, s) / any_value(a) / any_value(b), 6) + 0.0 AS r FROM sig JOIN s USING (t), g, h GROUP BY 1""")
def zero_lag_correlation(spark, sf_dir):
    s = samples(spark, sf_dir)
    pulse = s.where("label = 1").groupBy("t").agg(F.avg("v").alias("s"))
    return I.correlation(s, pulse, ["vec_id"]).select("vec_id", (F.round("r", 6) + 0.0).alias("r"))


@query(f"WITH {SIG}, m AS (SELECT t, avg(v * v) AS m FROM sig GROUP BY 1) SELECT vec_id, t::BIGINT AS t, round(sqrt(v * v * 4 / m), 6) + 0.0 AS v FROM sig JOIN m USING (t)")
def frms(spark, sf_dir):
    s = samples(spark, sf_dir)
    return rounded(I.frms(s.withColumn("v", F.col("v") * F.col("v")), s.withColumn("v", F.col("v") * F.col("v") * 4), ["vec_id", "t"], ["t"])).select("vec_id", F.col("t").cast("long").alias("t"), "v")


VELOCITY = "2 * 852e-9::DOUBLE / sin(0.25::DOUBLE) * sign({a}) * sqrt(abs({a})) * 1e6::DOUBLE"


@query(f"WITH {SIG}, m AS (SELECT t, avg(abs(v)) AS b FROM sig GROUP BY 1) SELECT vec_id, t::BIGINT AS t, round({VELOCITY.format(a='(v * v - b * b)')}, 6) + 0.0 AS v FROM sig JOIN m USING (t)")
def signed_sqrt_velocity(spark, sf_dir):
    s = samples(spark, sf_dir)
    background = s.groupBy("t").agg(F.avg(F.abs("v")).alias("b"))
    return s.join(F.broadcast(background), "t").select("vec_id", F.col("t").cast("long").alias("t"), r6(I.velocity(F.col("v"), F.col("b"))))


@query(f"""WITH {SIG}, n AS (SELECT (max(vec_id) // {WIDTH} + 1)::DOUBLE AS h FROM embeddings),
k AS (SELECT vec_id FROM embeddings, n WHERE label IN (1, 2) AND ((vec_id % {WIDTH} - 10) / 5.0::DOUBLE) ** 2 + ((vec_id // {WIDTH} - h / 2) / (h / 4)) ** 2 <= 1 AND NOT ((vec_id % {WIDTH} - 10) / 2.0::DOUBLE) ** 2 + ((vec_id // {WIDTH} - h / 2) / (h / 2 * 0.2::DOUBLE)) ** 2 <= 1)
SELECT t::BIGINT AS t, round(sum(v) / (SELECT count(*) FROM k), 6) + 0.0 AS v FROM sig WHERE vec_id IN (SELECT vec_id FROM k) GROUP BY 1""")
def section_velocity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.agg(F.max("vec_id")).first()[0] // WIDTH + 1
    pixels = e.where("label in (1, 2)").select("vec_id", F.floor(F.col("vec_id") / WIDTH).alias("y"), (F.col("vec_id") % WIDTH).alias("x"))
    return rounded(I.mask_pulse(samples(spark, sf_dir), pixels.where(M.section(rows, WIDTH)).select("vec_id"), ["vec_id"], ["t"])).select(F.col("t").cast("long").alias("t"), "v")


@query("SELECT vec_id, CASE WHEN label IN (2, 3) THEN [0, 0, 255] WHEN label IN (1, 3) THEN [255, 0, 0] ELSE [label, label, label] END[1]::INT AS red, (CASE WHEN label IN (2, 3) THEN [0, 0, 255] WHEN label IN (1, 3) THEN [255, 0, 0] ELSE [label, label, label] END)[3]::INT AS blue FROM embeddings")
def av_overlay(spark, sf_dir):
    artery, vein = M.artery_vein(F.col("label"))
    rgb = table(spark, sf_dir, "embeddings").select("vec_id", I.av_overlay(artery, vein, F.col("label")).alias("c"))
    return rgb.select("vec_id", F.col("c")[0].cast("int").alias("red"), F.col("c")[2].cast("int").alias("blue"))


# ---- signals


GRADIENT = "CASE WHEN t = 0 THEN lead(v) OVER w - v WHEN t = 63 THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END"
W = "WINDOW w AS (PARTITION BY vec_id ORDER BY t)"


@query(f"WITH {SIG} SELECT vec_id, t::BIGINT AS t, round({GRADIENT}, 6) + 0.0 AS v FROM sig {W}")
def signal_gradient(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), A.gradient(F.col("x")), "vec_id"))


@query(f"WITH {SIG} SELECT vec_id, t::BIGINT AS t, round(coalesce(v - lag(v) OVER w, 0), 6) + 0.0 AS v FROM sig {W}")
def first_difference(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), A.difference(F.col("x")), "vec_id"))


def _moving(k):
    return f"WITH {SIG} SELECT vec_id, t::BIGINT AS t, round(avg(v) OVER (PARTITION BY vec_id ORDER BY t ROWS BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING), 6) + 0.0 AS v FROM sig"


@query(_moving(5))
def moving_mean(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), A.moving_mean(F.col("x"), 5), "vec_id"))


@query(_moving(6))
def moving_mean_even(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), A.moving_mean(F.col("x"), 6), "vec_id"))


def _biquads(wn: str) -> str:
    """Two second-order sections of the order-4 Butterworth low-pass at a share of the Nyquist frequency, as columns of a table k."""
    return f"""w AS (SELECT tan(pi() * {wn} / 2) AS w), k AS (SELECT w * w / n1 AS b1, 2 * (w * w - 1) / n1 AS p1, (1 - 2 * cos(pi() / 8) * w + w * w) / n1 AS q1, w * w / n2 AS b2, 2 * (w * w - 1) / n2 AS p2, (1 - 2 * cos(3 * pi() / 8) * w + w * w) / n2 AS q2
FROM (SELECT w, 1 + 2 * cos(pi() / 8) * w + w * w AS n1, 1 + 2 * cos(3 * pi() / 8) * w + w * w AS n2 FROM w))"""


def _pass(name: str, source: str, n: int) -> str:
    """Both sections over the lists x of a table, from the steady state of the first value; lists y of n values."""
    def section(k, x):
        return f"b{k} * {x} + s{k}", f"2 * b{k} * {x} - p{k} * (b{k} * {x} + s{k}) + r{k}", f"b{k} * {x} - q{k} * (b{k} * {x} + s{k})"

    y1, s1, r1 = section(1, "x[t + 1]")
    y2, s2, r2 = section(2, f"({y1})")
    return f"""{name}_r AS (SELECT vec_id, x, 0 AS t, NULL::DOUBLE AS y, x[1] * (1 - b1) AS s1, x[1] * (b1 - q1) AS r1, x[1] * (1 - b2) AS s2, x[1] * (b2 - q2) AS r2, b1, p1, q1, b2, p2, q2 FROM {source}, k
UNION ALL SELECT vec_id, x, t + 1, {y2}, {s1}, {r1}, {s2}, {r2}, b1, p1, q1, b2, p2, q2 FROM {name}_r WHERE t < {n}),
{name} AS (SELECT vec_id, list(y ORDER BY t) AS y FROM {name}_r WHERE t > 0 GROUP BY 1)"""


#: Forward and backward over the signal, extended by 15 samples at both ends, point-mirrored; stated as sections, where the code has one recursion.
FILTERED = f"""WITH RECURSIVE {_biquads(f"(15.0::DOUBLE / {RATE / 2})")},
e AS (SELECT vec_id, list_concat(list_concat([2 * v[1] - v[i] for i in range(16, 1, -1)], v), [2 * v[64] - v[64 - i] for i in range(1, 16)]) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
{_pass("f", "e", T + 30)}, g AS (SELECT vec_id, list_reverse(y) AS x FROM f), {_pass("h", "g", T + 30)}, o AS (SELECT vec_id, list_reverse(y) AS y FROM h)"""


@query(f"{FILTERED} SELECT vec_id, t::BIGINT AS t, round(y[t + 16], 6) + 0.0 AS v FROM o, (SELECT unnest(range(64)) AS t)")
def lowpass_filtfilt(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), A.lowpass(F.col("x"), RATE), "vec_id"))


#: The cubic fit of 21 samples in discrete orthogonal polynomials on -10 to 10.
GRAM = """p AS (SELECT j, 1.0::DOUBLE AS p0, j::DOUBLE AS p1, j * j - 110 / 3.0::DOUBLE AS p2, j * j * j - 329 / 5.0::DOUBLE * j AS p3 FROM (SELECT unnest(range(-10, 11)) AS j)),
n AS (SELECT sum(p0 * p0) AS n0, sum(p1 * p1) AS n1, sum(p2 * p2) AS n2, sum(p3 * p3) AS n3 FROM p),
w AS (SELECT a.j AS i, b.j AS j, a.p0 * b.p0 / n0 + a.p1 * b.p1 / n1 + a.p2 * b.p2 / n2 + a.p3 * b.p3 / n3 AS w FROM p a, p b, n),
c AS (SELECT t, greatest(10, least(53, t)) AS c FROM (SELECT unnest(range(64)) AS t))"""
SMOOTHED = f"WITH {SIG}, {GRAM}, s AS (SELECT vec_id, c.t, sum(w * v) AS s FROM c JOIN w ON w.i = c.t - c JOIN sig ON sig.t = c + w.j GROUP BY 1, 2)"


@query(f"{SMOOTHED} SELECT vec_id, t::BIGINT AS t, round(s, 6) + 0.0 AS v FROM s")
def savitzky_golay(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), A.savitzky_golay(F.col("x"), 21, 3), "vec_id"))


@query(f"""{SMOOTHED}, r AS (SELECT vec_id, t, abs(v - s) AS r FROM sig JOIN s USING (vec_id, t))
SELECT vec_id, t::BIGINT AS t, r > 2 * 1.4826::DOUBLE * quantile_cont(r, 0.5) OVER (PARTITION BY vec_id) AS flag FROM r""")
def model_outliers(spark, sf_dir):
    return long(signals(spark, sf_dir), A.model_outliers(F.col("x"), 21, 3, 2.0), "vec_id", name="flag")


@query(f"""WITH {SIG}, j AS (SELECT j, exp(-j * j / (2 * (0.07::DOUBLE * 64) ** 2)) AS w FROM (SELECT unnest(range(-9, 10)) AS j)), n AS (SELECT sum(w) AS n FROM j),
i AS (SELECT t AS o, w / n AS w, CASE WHEN (t + j + 128) % 128 < 64 THEN (t + j + 128) % 128 ELSE 127 - (t + j + 128) % 128 END AS t FROM j, n, (SELECT unnest(range(64)) AS t))
SELECT vec_id, o::BIGINT AS t, round(sum(w * v), 6) + 0.0 AS v FROM i JOIN sig USING (t) GROUP BY 1, 2""")
def gaussian_blur(spark, sf_dir):
    made = L.apply_relation(samples(spark, sf_dir), C.gaussian(T, 0.07 * T), ["vec_id"])
    return rounded(made).select("vec_id", F.col("t").cast("long").alias("t"), "v")


@query(f"""WITH {SIG}, h AS (SELECT max(vec_id) // {WIDTH} + 1 AS h FROM embeddings), m AS (SELECT vec_id // {WIDTH} AS y, vec_id % {WIDTH} AS x, v FROM sig WHERE t = 0),
j AS (SELECT j, exp(-j * j / 8.0::DOUBLE) AS w FROM (SELECT unnest(range(-4, 5)) AS j)), n AS (SELECT sum(w) AS n FROM j),
a AS (SELECT y AS o, CASE WHEN (y + j + 2 * h) % (2 * h) < h THEN (y + j + 2 * h) % (2 * h) ELSE 2 * h - 1 - (y + j + 2 * h) % (2 * h) END AS y, w / n AS w FROM j, n, h, (SELECT DISTINCT y FROM m)),
b AS (SELECT x AS o, CASE WHEN (x + j + 40) % 40 < {WIDTH} THEN (x + j + 40) % 40 ELSE 39 - (x + j + 40) % 40 END AS x, w / n AS w FROM j, n, (SELECT DISTINCT x FROM m)),
d AS (SELECT a.o AS y, x, sum(w * v) AS v FROM a JOIN m USING (y) GROUP BY 1, 2)
SELECT y::INT AS y, b.o::INT AS x, round(sum(w * v), 6) + 0.0 AS v FROM b JOIN d USING (x) GROUP BY 1, 2""")
def frame_blur(spark, sf_dir):
    g, rows = _grid(spark, sf_dir)
    frame = g.join(samples(spark, sf_dir).where("t = 0").select("vec_id", "t", "v"), "vec_id").select(F.lit("a").alias("acq_id"), "t", "y", "x", "v")
    return rounded(morphology.blur(frame, rows, WIDTH, 2.0)).select("y", "x", "v")


@query(f"WITH {SIG} SELECT vec_id, t::BIGINT AS t, round(CASE WHEN t IN (0, 63) THEN v ELSE lag(v) OVER w / 4 + v / 2 + lead(v) OVER w / 4 END, 6) + 0.0 AS v FROM sig {W}")
def waveform_lowpass(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), A.binomial(F.col("x")), "vec_id"))


SPECTRUM = f"""WITH {SIG}, k AS (SELECT unnest(range(33)) AS k), f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * t / 64)) AS c, sum(v * sin(2 * pi() * k * t / 64)) AS s FROM sig, k GROUP BY 1, 2),
p AS (SELECT vec_id, k, (c * c + s * s) / 4096 * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM f)"""


@query(f"{SPECTRUM} SELECT vec_id, k::BIGINT AS t, round(p, 6) + 0.0 AS v FROM p")
def dft_power(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), A.spectrum(F.col("x"), T, power=True), "vec_id"))


@query(f"""WITH {SIG}, b AS (SELECT label, t, avg(v) AS v FROM sig GROUP BY 1, 2), k AS (SELECT unnest(range(1, 32)) AS k),
f AS (SELECT label, k, sqrt(sum(v * cos(2 * pi() * k * t / 64)) ** 2 + sum(v * sin(2 * pi() * k * t / 64)) ** 2) AS a FROM b, k WHERE {RATE} * k / 64 > 0.5 AND {RATE} * k / 64 < 2 GROUP BY 1, 2)
SELECT label, round_even({RATE} / ({RATE} * arg_max(k, a) / 64), 0)::BIGINT AS period FROM f GROUP BY 1""")
def dominant_period(spark, sf_dir):
    means = I.temporal_mean(samples(spark, sf_dir), ["label", "t"])
    rows = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("x"))
    return rows.select("label", pulse.period(F.col("x"), T, RATE).cast("long").alias("period"))


@query(f"""WITH {SIG}, z AS (SELECT vec_id, t, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM sig), k AS (SELECT unnest(range(33)) AS k),
f AS (SELECT vec_id, k, {RATE} * k / 64 AS f, (sum(v * cos(2 * pi() * k * t / 64)) ** 2 + sum(v * sin(2 * pi() * k * t / 64)) ** 2) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM z, k WHERE {RATE} * k / 64 BETWEEN 0.5 AND 2 GROUP BY 1, 2, 3),
q AS (SELECT vec_id, k, f, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM f), d AS (SELECT vec_id, arg_max(f, p) AS f0, count(*) AS n FROM q GROUP BY 1)
SELECT vec_id, 0.7 * sum(CASE WHEN f > f0 - 0.2 AND f < f0 + 0.2 THEN p ELSE 0 END) + 0.3 * (1 + sum(p * ln(p + 2.220446049250313e-16::DOUBLE)) / ln(any_value(n))) > 0.3 AS valid FROM q JOIN d USING (vec_id) GROUP BY 1""")
def periodicity_validity(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", pulse.is_periodic(F.col("x"), T, RATE).alias("valid"))


CLAMPED = f"""c AS (SELECT vec_id, embedding::DOUBLE[] AS x, unnest(range(64)) AS t FROM embeddings),
d AS (SELECT vec_id, t, x[t + 1] AS v, abs(x[t + 1] - list_avg([x[greatest(0, least(63, t + j)) + 1] for j in [-2, -1, 0, 1, 2]])) AS d FROM c),
e AS (SELECT vec_id, t, v, d, quantile_cont(d, 0.5) OVER (PARTITION BY vec_id) AS m FROM d)"""


@query(f"WITH {CLAMPED} SELECT vec_id, t::BIGINT AS t, m <> 0 AND d > 2 * m AS flag FROM e")
def outlier_frames(spark, sf_dir):
    return long(signals(spark, sf_dir), A.moving_outliers(F.col("x")), "vec_id", name="flag")


@query(f"""WITH {CLAMPED}, f AS (SELECT vec_id, t, v, m <> 0 AND d > 2 * m AS flag FROM e),
g AS (SELECT vec_id, t, v, flag, last_value(CASE WHEN NOT flag THEN t END IGNORE NULLS) OVER a AS t0, last_value(CASE WHEN NOT flag THEN v END IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN NOT flag THEN t END IGNORE NULLS) OVER b AS t1, first_value(CASE WHEN NOT flag THEN v END IGNORE NULLS) OVER b AS v1
FROM f WINDOW a AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT vec_id, t::BIGINT AS t, round(CASE WHEN NOT flag THEN v ELSE coalesce(v0 + (t - t0) * (v1 - v0) / (t1 - t0), v0, v1) END, 6) + 0.0 AS v FROM g""")
def outlier_interpolation(spark, sf_dir):
    both = F.zip_with(F.col("x"), A.moving_outliers(F.col("x")), lambda a, b: F.struct(a.alias("v"), b.alias("flag")))
    rows = signals(spark, sf_dir).select("vec_id", F.posexplode(both).alias("t", "p")).select("vec_id", F.col("t").cast("long").alias("t"), F.col("p")["v"].alias("v"), F.col("p")["flag"].alias("flag"))
    return rounded(I.interpolate_flagged(rows, ["vec_id"])).select("vec_id", "t", "v")


@query(f"WITH {SIG}, d AS (SELECT vec_id, t, abs(coalesce(v - lag(v) OVER w, 0)) AS d FROM sig {W}) SELECT vec_id, t::BIGINT AS t, d > 3 * 1.4826::DOUBLE * quantile_cont(d, 0.5) OVER (PARTITION BY vec_id) AS flag FROM d")
def derivative_outliers(spark, sf_dir):
    return long(signals(spark, sf_dir), A.derivative_outliers(F.col("x")), "vec_id", name="flag")


@query(f"WITH {SIG}, b AS (SELECT vec_id, quantile_cont(v, 0.5) AS b FROM sig WHERE t < 32 GROUP BY 1) SELECT vec_id, t::BIGINT AS t, v < 0.9::DOUBLE * b AS flag FROM sig JOIN b USING (vec_id)")
def global_drop(spark, sf_dir):
    return long(signals(spark, sf_dir), A.global_drop(F.col("x")), "vec_id", name="flag")


@query(f"""WITH {SIG}, q AS (SELECT vec_id, t, v, quantile_cont(v, 0.05) OVER w AS a, quantile_cont(v, 0.95) OVER w AS b FROM sig WINDOW w AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))
SELECT vec_id, t::BIGINT AS t, a <> b AND (v < a / 1.5::DOUBLE OR v > b * 1.5::DOUBLE) AS flag FROM q""")
def local_percentile(spark, sf_dir):
    return long(signals(spark, sf_dir), A.local_percentile_outliers(F.col("x")), "vec_id", name="flag")


@query("""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS x, unnest(range(64)) AS t FROM embeddings),
d AS (SELECT vec_id, t, abs(x[t + 1] - list_median([x[greatest(0, least(63, t + j)) + 1] for j in range(-5, 6)])) AS d FROM c),
l AS (SELECT vec_id, list(d ORDER BY t) AS y FROM d GROUP BY 1), s AS (SELECT vec_id, t, d, 1.2::DOUBLE * list_median([y[greatest(0, least(63, t + j)) + 1] for j in range(-5, 6)]) AS s FROM d JOIN l USING (vec_id)),
z AS (SELECT vec_id, quantile_cont(s, 0.5) AS z FROM s WHERE s > 0 GROUP BY 1)
SELECT vec_id, t::BIGINT AS t, d > 3 * CASE WHEN s = 0 THEN coalesce(z, 1) ELSE s END AS flag FROM s LEFT JOIN z USING (vec_id)""")
def hampel(spark, sf_dir):
    return long(signals(spark, sf_dir), A.hampel(F.col("x")), "vec_id", name="flag")


PEAKS = f"""g AS (SELECT vec_id, t, {GRADIENT} AS g FROM sig {W}), h AS (SELECT *, lag(g) OVER w AS a, lead(g) OVER w AS b, quantile_cont(g, {{q}}) OVER (PARTITION BY vec_id) AS q FROM g {W}),
p AS (SELECT vec_id, list_reduce(list([t] ORDER BY g DESC, t DESC), lambda s, c: CASE WHEN len(list_filter(s, lambda j: abs(j - c[1]) < {{d}})) > 0 THEN s ELSE list_concat(s, c) END) AS p FROM h WHERE g > a AND g > b AND g >= q GROUP BY 1)"""
P95 = f"WITH {SIG}, " + PEAKS.format(q="0.95", d="5")
P80 = f"WITH {SIG}, " + PEAKS.format(q="0.8", d="6")


def _peaks(x: Column) -> Column:
    return A.let(A.gradient(x), lambda g: A.find_peaks(g, A.percentile(g, 95), 5))


@query(f"{P95} SELECT vec_id, unnest(p)::BIGINT AS peak FROM p")
def find_peaks(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", F.explode(_peaks(F.col("x")).cast("array<bigint>")).alias("peak"))


@query(f"{P95} SELECT vec_id, unnest(list_reduce([[x] for x in list_sort(p)], lambda s, c: CASE WHEN c[1] - s[-1] < 10 THEN s ELSE list_concat(s, c) END))::BIGINT AS peak FROM p")
def validate_peaks(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", F.explode(A.minimum_gap(_peaks(F.col("x")), 10).cast("array<bigint>")).alias("peak"))


@query(f"{P80}, s AS (SELECT vec_id, list_sort(p) AS p FROM p) SELECT vec_id, i::BIGINT AS beat, round((p[i + 2] - p[i + 1]) * 2 / {RATE}::DOUBLE, 6) + 0.0 AS v FROM s, (SELECT unnest(range(62)) AS i) WHERE i + 1 < len(p)")
def time_per_beat(spark, sf_dir):
    peaks = signals(spark, sf_dir).select("vec_id", A.heartbeat_peaks(F.col("x"), F.lit(10)).alias("p"))
    gaps = A.difference(F.col("p").cast("array<double>"))
    return peaks.select("vec_id", F.posexplode(F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))).alias("beat", "d")).select("vec_id", F.col("beat").cast("long").alias("beat"), r6(F.col("d") * 2 / RATE))


BEATS = f"""{P80}, s AS (SELECT vec_id, list_sort(p) AS p FROM p), k AS (SELECT unnest(range(16)) AS k),
i AS (SELECT vec_id, i, p[i + 1] AS a, p[i + 2] - p[i + 1] AS n FROM s, (SELECT unnest(range(62)) AS i) WHERE i + 1 < len(p)),
l AS (SELECT vec_id, i, k, a, n, k * (n - 1) / 15.0::DOUBLE AS pos FROM i, k),
b AS (SELECT vec_id, i, k, e[(a + floor(pos))::BIGINT + 1]::DOUBLE + (pos - floor(pos)) * (e[(a + least(floor(pos) + 1, n - 1))::BIGINT + 1]::DOUBLE - e[(a + floor(pos))::BIGINT + 1]::DOUBLE) AS v FROM l JOIN (SELECT vec_id, embedding AS e FROM embeddings) USING (vec_id))"""


@query(f"{BEATS} SELECT vec_id, i::BIGINT AS beat, k::BIGINT AS t, round(v, 6) + 0.0 AS v FROM b")
def beat_resample(spark, sf_dir):
    rows = signals(spark, sf_dir).select("vec_id", A.let(A.heartbeat_peaks(F.col("x"), F.lit(10)), lambda p: A.beats(F.col("x"), p, 16)).alias("b"))
    rows = rows.select("vec_id", F.posexplode("b").alias("beat", "x")).withColumn("beat", F.col("beat").cast("long"))
    return rounded(long(rows, F.col("x"), "vec_id", "beat"))


@query(f"{BEATS} SELECT vec_id, k::BIGINT AS t, round(avg(v), 6) + 0.0 AS v FROM b GROUP BY 1, 2")
def mean_beat(spark, sf_dir):
    rows = signals(spark, sf_dir).select("vec_id", A.let(A.heartbeat_peaks(F.col("x"), F.lit(10)), lambda p: A.beats(F.col("x"), p, 16)).alias("b")).where(F.size("b") > 0)
    return rounded(long(rows, A.mean_beat(F.col("b"), 16), "vec_id"))


@query(f"""WITH {SIG}, m AS (SELECT label, t, avg(v) AS p FROM sig GROUP BY 1, 2), r AS (SELECT vec_id, t, p, v - p AS r FROM sig JOIN m USING (label, t)),
s AS (SELECT *, 1.4826::DOUBLE * quantile_cont(abs(r), 0.5) OVER (PARTITION BY vec_id) AS s FROM r)
SELECT vec_id, t::BIGINT AS t, round(p + r * greatest(0, least(1, 1 - abs(r) / (2 * s))), 6) + 0.0 AS v FROM s""")
def soft_rejection(spark, sf_dir):
    s = signals(spark, sf_dir)
    means = I.temporal_mean(samples(spark, sf_dir), ["label", "t"]).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("m"))
    return rounded(long(s.join(means, "label"), A.soft_rejection(F.col("x"), F.col("m")), "vec_id"))


@query()
def heartbeat_correction(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), A.heartbeat_correction(F.col("x"), F.lit(12), T, 10.0), "vec_id"))


#: Peaks of |gradient| at least 9 samples apart, then those that stand out.  The prominence of 1e-6 only leaves out flat tops.
VOTE = f"""WITH {SIG}, g AS (SELECT vec_id, t, {GRADIENT} AS g FROM sig {W}), h AS (SELECT *, abs(g) AS s, lag(abs(g)) OVER w AS a, lead(abs(g)) OVER w AS b FROM g {W}),
p AS (SELECT vec_id, list_reduce(list([t] ORDER BY s DESC, t DESC), lambda r, c: CASE WHEN len(list_filter(r, lambda j: abs(j - c[1]) < 9)) > 0 THEN r ELSE list_concat(r, c) END) AS p FROM h WHERE s > a AND s > b GROUP BY 1),
q AS (SELECT p.vec_id, k.t, g.g, abs(g.g) AS s FROM p, (SELECT unnest(range(64)) AS t) k JOIN g USING (t) WHERE g.vec_id = p.vec_id AND list_contains(p, k.t)),
l AS (SELECT q.vec_id, q.t, any_value(q.g) AS g, any_value(q.s) AS s, max(h.t) FILTER (h.t < q.t AND h.s > q.s) AS lo, min(h.t) FILTER (h.t > q.t AND h.s > q.s) AS hi FROM q JOIN h USING (vec_id) GROUP BY 1, 2),
o AS (SELECT l.vec_id, l.t, any_value(l.g) AS g, any_value(l.s) - greatest(min(h.s) FILTER (h.t <= l.t AND h.t > coalesce(lo, -1)), min(h.s) FILTER (h.t >= l.t AND h.t < coalesce(hi, 64))) AS o FROM l JOIN h USING (vec_id) GROUP BY 1, 2)"""


@query(f"{VOTE}, c AS (SELECT vec_id, count(*) FILTER (g > 0) > count(*) / 2 AS artery FROM o WHERE o >= 1e-6 GROUP BY 1) SELECT vec_id, coalesce(artery, false) AS artery FROM embeddings LEFT JOIN c USING (vec_id)")
def artery_vein_vote(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", A.artery_vote(F.col("x"), F.lit(12)).alias("artery"))


#: Systoles at 16 Hz: peaks of the gradient 8 samples apart, then 10.
P8 = f"WITH {SIG}, " + PEAKS.format(q="0.95", d="8")
SYSTOLE = f"""{P8}, y AS (SELECT vec_id, list_reduce([[x] for x in list_sort(p)], lambda s, c: CASE WHEN c[1] - s[-1] < 10 THEN s ELSE list_concat(s, c) END) AS s FROM p)"""


@query(f"{SYSTOLE} SELECT vec_id, unnest(s)::BIGINT AS peak FROM y")
def systole_index(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", pulse.systole(F.col("x"), 16.0).alias("s")).select("vec_id", F.explode(F.col("s").cast("array<bigint>")).alias("peak"))


@query(f"""{SYSTOLE}, e AS (SELECT vec_id, s, embedding::DOUBLE[] AS x, unnest(range(1, len(s) + 1)) AS i FROM y JOIN embeddings USING (vec_id)),
r AS (SELECT vec_id, x, s[i] AS s, CASE WHEN i = len(s) THEN 64 ELSE s[i] + round_even((s[i + 1] - s[i]) / 2.0, 0)::INT + 1 END AS top, CASE WHEN i = 1 THEN 0 ELSE s[i - 1] + round_even((s[i] - s[i - 1]) / 2.0, 0)::INT END AS low, CASE WHEN i = 1 THEN s[i] + 1 ELSE s[i] END AS stop FROM e)
SELECT vec_id, s::BIGINT AS systole, (s - 1 + list_position(x[s + 1 : top], list_max(x[s + 1 : top])))::BIGINT AS maximum, (low - 1 + list_position(x[low + 1 : stop], list_min(x[low + 1 : stop])))::BIGINT AS minimum FROM r""")
def beat_marks(spark, sf_dir):
    marks = signals(spark, sf_dir).select("vec_id", pulse.beat_marks(F.col("x"), 16.0).alias("b")).select("vec_id", F.explode(F.arrays_zip("b.systole", "b.maximum", "b.minimum")).alias("m"))
    return marks.select("vec_id", *[F.col("m")[c].cast("long").alias(c) for c in ("systole", "maximum", "minimum")])


def _diasys(source: str) -> str:
    """Systole and diastole frames (id, phase, t) from a table (id, x, s) of signals and their systoles."""
    return f"""f AS (SELECT id, x, s, round_even(len(x) / greatest(len(s), 1), 0) AS fp FROM {source}),
z AS (SELECT id, x, unnest(s) AS i, round_even(fp * 0.35::DOUBLE, 0)::INT AS a, round_even(fp * 0.6::DOUBLE, 0)::INT AS b, round_even(fp * 0.95::DOUBLE, 0)::INT AS c FROM f),
u AS (SELECT id, x, 's' AS phase, i AS lo, i + a AS hi FROM z UNION ALL SELECT id, x, 'd', i + b, i + c FROM z),
v AS (SELECT id, phase, x, lo, least(lo, len(x) - 1) AS l, least(hi, len(x) - 1) AS h FROM u),
e AS (SELECT id, phase, lo, len(x) AS n, greatest(lo, l - 1 + CASE phase WHEN 's' THEN list_position(x[l + 1 : greatest(h, l) + 1], list_max(x[l + 1 : greatest(h, l) + 1])) ELSE list_position(x[l + 1 : greatest(h, l) + 1], list_min(x[l + 1 : greatest(h, l) + 1])) END) AS last FROM v),
t AS (SELECT DISTINCT id, phase, unnest(CASE WHEN lo <= n - 1 THEN range(lo, last + 1) ELSE [n - 1] END) AS t FROM e),
m AS (SELECT id, phase, t FROM t UNION ALL SELECT id, phase, 0 FROM f, (SELECT unnest(['s', 'd']) AS phase) WHERE id NOT IN (SELECT id FROM t))"""


@query(f"""{SYSTOLE}, d AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, coalesce(s, []) AS s FROM embeddings LEFT JOIN y USING (vec_id)), {_diasys("d")}
SELECT id AS vec_id, phase, t::BIGINT AS frame FROM m""")
def diasys_frames(spark, sf_dir):
    f = signals(spark, sf_dir).select("vec_id", pulse.diasys_frames(F.col("x"), 16.0).alias("f"))
    one = lambda c: f.select("vec_id", F.lit(c[0]).alias("phase"), F.explode(F.col(f"f.{c}").cast("array<bigint>")).alias("frame"))
    return one("systole").unionByName(one("diastole"))


@query(f"""WITH {SIG.replace("sig AS", "raw AS")}, sig AS (SELECT 0 AS vec_id, 0 AS label, t, avg(v) AS v FROM raw WHERE label = 1 GROUP BY 3), {PEAKS.format(q="0.95", d="8")},
y AS (SELECT vec_id, list_reduce([[x] for x in list_sort(p)], lambda s, c: CASE WHEN c[1] - s[-1] < 10 THEN s ELSE list_concat(s, c) END) AS s FROM p),
b AS (SELECT 0 AS id, list(v ORDER BY t) AS x FROM sig), d AS (SELECT id, x, coalesce(s, []) AS s FROM b LEFT JOIN y ON y.vec_id = id), {_diasys("d")},
a AS (SELECT raw.vec_id, phase, avg(v) AS v FROM raw JOIN m USING (t) GROUP BY 1, 2), n AS (SELECT vec_id, phase, (v - min(v) OVER q) / (max(v) OVER q - min(v) OVER q + 1e-8::DOUBLE) AS v FROM a WINDOW q AS (PARTITION BY phase)),
r AS (SELECT vec_id, sum(v) FILTER (phase = 's') - sum(v) FILTER (phase = 'd') AS v FROM n GROUP BY 1)
SELECT vec_id, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + 1e-8::DOUBLE), 6) + 0.0 AS v FROM r""")
def diasys_image(spark, sf_dir):
    s = samples(spark, sf_dir)
    x = s.where("label = 1").groupBy("t").agg(F.avg("v").alias("v")).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("x"))
    return rounded(pulse.diasys_image(s, x, ["vec_id"], 16.0))


@query()
def cardiac_clean(spark, sf_dir):
    from .operators.cardiac import clean_signals

    rows = clean_signals(signals(spark, sf_dir).select("vec_id", "x"))
    return rounded(long(rows, F.col("x"), "vec_id"))


# ---- masks


GRID = f"g AS (SELECT vec_id, vec_id // {WIDTH} AS y, vec_id % {WIDTH} AS x, label FROM embeddings), n AS (SELECT max(vec_id) // {WIDTH} + 1 AS h FROM embeddings)"


def _grid(spark, sf_dir) -> tuple[DataFrame, int]:
    e = table(spark, sf_dir, "embeddings")
    rows = e.agg(F.max("vec_id")).first()[0] // WIDTH + 1
    return e.select("vec_id", F.floor(F.col("vec_id") / WIDTH).cast("int").alias("y"), (F.col("vec_id") % WIDTH).cast("int").alias("x"), "label"), rows


@query(f"WITH {GRID} SELECT vec_id FROM g, n WHERE (y / (h - 1)::DOUBLE - 0.4::DOUBLE) ** 2 + (x / 19.0::DOUBLE - 0.6::DOUBLE) ** 2 <= 0.45::DOUBLE ** 2 AND (y / (h - 1)::DOUBLE - 0.4::DOUBLE) ** 2 + (x / 19.0::DOUBLE - 0.6::DOUBLE) ** 2 > 0.1::DOUBLE ** 2")
def disk_mask(spark, sf_dir):
    g, rows = _grid(spark, sf_dir)
    return g.where(M.disk(rows, WIDTH, 0.1, (0.4, 0.6), 0.45)).select("vec_id")


@query(f"WITH {GRID} SELECT vec_id FROM g, n WHERE ((x - 10) / 7.0::DOUBLE) ** 2 + ((y - h / 2.0::DOUBLE) / (h / 2.0::DOUBLE * 0.7::DOUBLE)) ** 2 <= 1")
def elliptical_mask(spark, sf_dir):
    g, rows = _grid(spark, sf_dir)
    return g.where(M.ellipse(rows, WIDTH, 0.7)).select("vec_id")


@query(f"WITH {GRID}, o AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS i) b WHERE a.i * a.i + b.i * b.i <= 4) SELECT DISTINCT (y + dy)::INT AS y, (x + dx)::INT AS x FROM g, o, n WHERE label = 1 AND y + dy BETWEEN 0 AND h - 1 AND x + dx BETWEEN 0 AND {WIDTH - 1}")
def dilation(spark, sf_dir):
    g, rows = _grid(spark, sf_dir)
    return M.dilate(g.where("label = 1"), 2, rows, WIDTH)


@query(f"WITH {GRID}, a AS (SELECT y, x FROM g WHERE label IN (1, 3)), b AS (SELECT y, x FROM g WHERE label IN (2, 3)) SELECT 'and' AS op, count(*) AS n FROM a JOIN b USING (y, x) UNION ALL SELECT 'minus', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'or', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def mask_setops(spark, sf_dir):
    g, _ = _grid(spark, sf_dir)
    artery, vein = M.artery_vein(F.col("label"))
    a, b = g.where(artery), g.where(vein)
    out = [(n, f(a, b, ["y", "x"])) for n, f in (("and", M.intersect), ("minus", M.subtract), ("or", M.union))]
    made = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n") for n, d in out]
    return made[0].union(made[1]).union(made[2])


@query(f"""WITH RECURSIVE {GRID}, m AS (SELECT y, x FROM g WHERE label < 3),
r AS (SELECT y, x, y AS sy, x AS sx FROM m UNION SELECT m.y, m.x, r.sy, r.sx FROM r JOIN m ON m.y BETWEEN r.y - 1 AND r.y + 1 AND m.x BETWEEN r.x - 1 AND r.x + 1),
l AS (SELECT y, x, min(sy * {WIDTH} + sx) AS l FROM r GROUP BY 1, 2), c AS (SELECT l, count(*) AS n FROM l GROUP BY 1)
SELECT y::INT AS y, x::INT AS x FROM l WHERE l = (SELECT l FROM c ORDER BY n DESC, l LIMIT 1)""")
def largest_component(spark, sf_dir):
    g, rows = _grid(spark, sf_dir)
    return morphology.per_image(g.where("label < 3").select(F.lit("a").alias("acq_id"), "y", "x"), rows, WIDTH, "largest").select("y", "x")


@query()
def skeleton_labels(spark, sf_dir):
    g, rows = _grid(spark, sf_dir)
    return morphology.per_image(g.where("label < 5").select(F.lit("a").alias("acq_id"), "y", "x"), rows, WIDTH, "skeleton").select("y", "x")


@query()
def frangi_mask(spark, sf_dir):
    g, rows = _grid(spark, sf_dir)
    pixels = g.join(I.temporal_mean(samples(spark, sf_dir), ["vec_id"]), "vec_id")
    return morphology.frangi_mask(pixels.select(F.lit("a").alias("acq_id"), "y", "x", "v"), rows, WIDTH).select("y", "x")


@query()
def biharmonic_inpaint(spark, sf_dir):
    g, rows = _grid(spark, sf_dir)
    pixels = g.join(I.temporal_mean(samples(spark, sf_dir), ["vec_id"]), "vec_id").select(F.lit("a").alias("acq_id"), F.lit(0).alias("t"), "y", "x", "v")
    return rounded(morphology.inpaint(pixels, g.where("label = 1").select(F.lit("a").alias("acq_id"), "y", "x"), rows, WIDTH)).select("y", "x", "v")


@query(f"WITH {GRID}, c AS (SELECT arg_max(x, (embedding[1], -y, -x))::DOUBLE AS cx, arg_max(y, (embedding[1], -y, -x))::DOUBLE AS cy FROM g JOIN embeddings USING (vec_id)) SELECT cx, cy FROM c")
def brightest_center(spark, sf_dir):
    g, _ = _grid(spark, sf_dir)
    image = g.join(signals(spark, sf_dir).select("vec_id", F.col("x")[0].alias("v")), "vec_id").withColumn("acq_id", F.lit("a"))
    return I.argmax_center(image, ["acq_id"]).select(F.col("center.x").alias("cx"), F.col("center.y").alias("cy"))


@query(f"WITH {GRID}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM g WHERE label = 1) SELECT vec_id FROM g, n, c WHERE (y / (h - 1)::DOUBLE - cx / {WIDTH}) ** 2 + (x / 19.0::DOUBLE - cy / h) ** 2 <= 0.45::DOUBLE ** 2")
def disc_diaphragm(spark, sf_dir):
    g, rows = _grid(spark, sf_dir)
    g = g.withColumn("acq_id", F.lit("a"))
    center = g.where("label = 1").groupBy("acq_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return g.join(center, "acq_id").where(M.disk(rows, WIDTH, 0.45, (F.col("cx") / WIDTH, F.col("cy") / rows))).select("vec_id")


@query(f"WITH {SIG} SELECT vec_id, t::BIGINT AS t, round(v, 6) + 0.0 AS v FROM sig WHERE t BETWEEN 10 AND 19")
def frame_crop(spark, sf_dir):
    return rounded(I.crop_frames(samples(spark, sf_dir), 10, 20)).select("vec_id", F.col("t").cast("long").alias("t"), "v")


@query(f"WITH {SIG} SELECT vec_id, t::BIGINT AS t, round(v, 6) + 0.0 AS v FROM sig")
def video_round_trip(spark, sf_dir):
    """To [0, 1] and back."""
    return rounded(I.video_from_unit(I.video_to_unit(samples(spark, sf_dir)))).select("vec_id", F.col("t").cast("long").alias("t"), "v")


@query(f"WITH {SIG}, m AS (SELECT t, avg(v) AS b FROM sig GROUP BY 1) SELECT vec_id, t::BIGINT AS t, round((v + 2) / (b + 2 + 1e-8::DOUBLE), 6) + 0.0 AS v FROM sig JOIN m USING (t)")
def flat_field_divide(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("v", F.col("v") + 2)
    blur = s.groupBy("t").agg(F.avg("v").alias("blur"))
    return rounded(I.flat_divide(s.join(F.broadcast(blur), "t"))).select("vec_id", F.col("t").cast("long").alias("t"), "v")


@query(f"WITH {SIG} SELECT vec_id, t::BIGINT AS t FROM sig WHERE v > 0.1")
def threshold_mask(spark, sf_dir):
    return samples(spark, sf_dir).where(M.over(F.col("v"), 0.1)).select("vec_id", F.col("t").cast("long").alias("t"))


# ---- inference


@query(f"WITH {SIG} SELECT vec_id, t::BIGINT AS t, round(1 / (1 + exp(-v)), 6) + 0.0 AS v FROM sig")
def activation_sigmoid(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), F.transform("x", N.sigmoid), "vec_id"))


@query(f"WITH {SIG} SELECT vec_id, t::BIGINT AS t, round(exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id), 6) + 0.0 AS v FROM sig")
def activation_softmax(spark, sf_dir):
    return rounded(long(signals(spark, sf_dir), N.softmax(F.col("x")), "vec_id"))


@query(f"WITH {SIG}, a AS (SELECT vec_id, (max_by(t, (v, -t)) % 4)::INT AS k FROM sig GROUP BY 1) SELECT vec_id, k IN (1, 3) AS artery, k IN (2, 3) AS vein FROM a")
def argmax_decode(spark, sf_dir):
    artery, vein = M.artery_vein(N.argmax(F.col("x")) % 4)
    return signals(spark, sf_dir).select("vec_id", artery.alias("artery"), vein.alias("vein"))


@query(f"WITH {SIG} SELECT vec_id, t::BIGINT AS t, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8::DOUBLE), 6) + 0.0 AS z, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8::DOUBLE), 6) + 0.0 AS m, round(v / 255, 6) + 0.0 AS r, floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8::DOUBLE) * 255) AS n FROM sig WINDOW w AS (PARTITION BY vec_id)")
def channel_norms(spark, sf_dir):
    x = F.col("x")
    made = signals(spark, sf_dir).select("vec_id", *[N.channel_norm(x, kind).alias(c) for c, kind in (("z", "zscore"), ("m", "minmax"), ("r", "rescale"), ("n", "none"))])
    rows = made.select("vec_id", F.posexplode(F.arrays_zip("z", "m", "r", "n")).alias("t", "p"))
    return rows.select("vec_id", F.col("t").cast("long").alias("t"), *[(F.round(F.col("p")[c], 6) + 0.0).alias(c) for c in "zmrn"])


@query("SELECT label, arg_max(vec_id, (embedding[5], -vec_id)) AS box_id, round(arg_max(embedding[1]::DOUBLE, (embedding[5], -vec_id)), 6) + 0.0 AS cx FROM embeddings GROUP BY 1")
def box_select(spark, sf_dir):
    boxes = signals(spark, sf_dir).select("label", F.col("vec_id").alias("box_id"), *[F.col("x")[i].alias(c) for i, c in enumerate(("x", "y", "dx", "dy", "conf"))])
    return M.select_box(boxes, ["label"]).select("label", "box_id", (F.round("center.x", 6) + 0.0).alias("cx"))


@query("SELECT sha256(string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey)) AS fingerprint FROM nation")
def fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.struct("n_nationkey", F.concat_ws(":", "n_nationkey", "n_name").alias("s")).alias("p"))
    # nation is a fixed list; artifacts are fingerprinted without order, see plans.artifacts
    return rows.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), ","), 256).alias("fingerprint"))


@query()
def artifact_fingerprint(spark, sf_dir):
    """The fingerprint that steps are reused by, of the same rows in two orders."""
    from .plans.artifacts import frame_fingerprint

    nation = table(spark, sf_dir, "nation")
    made = [(n, frame_fingerprint(df)) for n, df in (("as stored", nation), ("reversed", nation.orderBy(F.desc("n_nationkey"))))]
    return spark.createDataFrame(made, "rows string, fingerprint string")


@query("SELECT user_id, time_bucket(INTERVAL '6 hours', ts)::TIMESTAMP AS start, count(*) AS n, round(avg(value), 6) + 0.0 AS v FROM events GROUP BY 1, 2")
def events_tumbling_pulse(spark, sf_dir):
    from .streaming.pulse import tumbling

    out = tumbling(table(spark, sf_dir, "events"), "6 hours")
    return rounded(out).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "v")


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
