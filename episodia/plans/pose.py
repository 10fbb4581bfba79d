"""Pose algebra (H20, H23-H31) over components of the embeddings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from episodia.functions import rotations as ro
from episodia.operators import transforms as tf
from episodia.plans.common import Registry, signed_round
from episodia.session import table

add = Registry()
E = "embedding[{}]::DOUBLE"
QUAT = "q AS (SELECT vec_id, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z, embedding[5]::DOUBLE AS a, embedding[6]::DOUBLE AS b, embedding[7]::DOUBLE AS c FROM embeddings), n AS (SELECT *, 2 / (w*w + x*x + y*y + z*z) AS s FROM q)"
MATRIX = "[1 - s*(y*y + z*z), s*(x*y - z*w), s*(x*z + y*w), s*(x*y + z*w), 1 - s*(x*x + z*z), s*(y*z - x*w), s*(x*z - y*w), s*(y*z + x*w), 1 - s*(x*x + y*y)]"


def parts(spark, sf):
    v = table(spark, sf, "embeddings")
    return v, [F.get("embedding", k).cast("double") for k in range(16)]


def six(cols):
    return F.array(*[F.round(c, 6) + 0.0 for c in cols])


def unit(q):
    n = F.sqrt(sum((x * x for x in q), F.lit(0.0)))
    return [x / n for x in q]


@add("h20_wrapped_angles", "SELECT event_id, round(atan2(sin(value), cos(value)), 6) AS angle FROM events")
def h20(spark, sf):
    return table(spark, sf, "events").select("event_id", signed_round(ro.wrap_angle(F.col("value")), 6).alias("angle"))


@add("h23_quaternion_to_matrix", f"WITH {QUAT} SELECT vec_id, [round(m, 6) + 0.0 FOR m IN {MATRIX}] AS m FROM n")
def h23(spark, sf):
    v, e = parts(spark, sf)
    return v.select("vec_id", six(ro.quaternion_to_matrix(e[:4])).alias("m"))


@add("h23_matrix_round_trip", f"WITH {QUAT} SELECT vec_id, [round(CASE WHEN w < 0 THEN -v ELSE v END / sqrt(w*w + x*x + y*y + z*z), 5) + 0.0 FOR v IN [w, x, y, z]] AS q FROM n")
def h23b(spark, sf):
    v, e = parts(spark, sf)
    back = ro.matrix_to_quaternion(ro.quaternion_to_matrix(e[:4]))
    return v.select("vec_id", F.array(*[F.round(c, 5) + 0.0 for c in back]).alias("q"))


@add("h24_quaternion_product", f"""WITH {QUAT}, p AS (SELECT vec_id, embedding[5]::DOUBLE AS a, embedding[6]::DOUBLE AS b, embedding[7]::DOUBLE AS c, embedding[8]::DOUBLE AS d FROM embeddings),
m AS (SELECT q.vec_id, w*p.a - x*p.b - y*p.c - z*p.d AS r, w*p.b + x*p.a + y*p.d - z*p.c AS i, w*p.c - x*p.d + y*p.a + z*p.b AS j, w*p.d + x*p.c - y*p.b + z*p.a AS k FROM q JOIN p USING (vec_id))
SELECT vec_id, [round(CASE WHEN r < 0 THEN -v ELSE v END, 6) + 0.0 FOR v IN [r, i, j, k]] AS q FROM m""")
def h24(spark, sf):
    v, e = parts(spark, sf)
    return v.select("vec_id", six(ro.standardise(ro.quaternion_multiply(e[:4], e[4:8]))).alias("q"))


@add("h24_quaternion_apply", f"""WITH {QUAT}, m AS (SELECT vec_id, {MATRIX} AS m, w*w + x*x + y*y + z*z AS n2, a, b, c FROM n)
SELECT vec_id, [round(n2 * v, 6) + 0.0 FOR v IN [m[1]*a + m[2]*b + m[3]*c, m[4]*a + m[5]*b + m[6]*c, m[7]*a + m[8]*b + m[9]*c]] AS p FROM m""")
def h24b(spark, sf):
    v, e = parts(spark, sf)
    return v.select("vec_id", six(ro.quaternion_apply(e[:4], e[4:7])).alias("p"))


@add("h25_axis_angle", """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), a AS (SELECT *, sqrt(x*x + y*y + z*z) AS t FROM v)
SELECT vec_id, [round(cos(t / 2), 6), round(x * sin(t / 2) / t, 6) + 0.0, round(y * sin(t / 2) / t, 6) + 0.0, round(z * sin(t / 2) / t, 6) + 0.0] AS q, true AS round_trip FROM a""")
def h25(spark, sf):
    v, e = parts(spark, sf)
    q = ro.axis_angle_to_quaternion(e[:3])
    back = ro.quaternion_to_axis_angle(q)
    ok = (F.abs(back[0] - e[0]) < 1e-9) & (F.abs(back[1] - e[1]) < 1e-9) & (F.abs(back[2] - e[2]) < 1e-9)
    return v.select("vec_id", six(q).alias("q"), ok.alias("round_trip"))


@add("h26_euler_xyz", """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT vec_id, [round(m, 6) + 0.0 FOR m IN [cos(y)*cos(z), -cos(y)*sin(z), sin(y), cos(x)*sin(z) + sin(x)*sin(y)*cos(z), cos(x)*cos(z) - sin(x)*sin(y)*sin(z), -sin(x)*cos(y), sin(x)*sin(z) - cos(x)*sin(y)*cos(z), sin(x)*cos(z) + cos(x)*sin(y)*sin(z), cos(x)*cos(y)]] AS m, true AS round_trip FROM v""")
def h26(spark, sf):
    v, e = parts(spark, sf)
    m = ro.euler_to_matrix(e[:3], "XYZ")
    back = ro.matrix_to_euler(m, "XYZ")
    return v.select("vec_id", six(m).alias("m"), ((F.abs(back[0] - e[0]) < 1e-9) & (F.abs(back[1] - e[1]) < 1e-9) & (F.abs(back[2] - e[2]) < 1e-9)).alias("round_trip"))


@add("h27_rotation_6d", """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding[1:6]] AS d FROM embeddings), a AS (SELECT vec_id, d, [x / sqrt(d[1]*d[1] + d[2]*d[2] + d[3]*d[3]) FOR x IN d[1:3]] AS a FROM v),
r AS (SELECT vec_id, a, [d[3 + i] - (a[1]*d[4] + a[2]*d[5] + a[3]*d[6]) * a[i] FOR i IN range(1, 4)] AS r FROM a), b AS (SELECT vec_id, a, [x / sqrt(r[1]*r[1] + r[2]*r[2] + r[3]*r[3]) FOR x IN r] AS b FROM r)
SELECT vec_id, [round(x, 6) + 0.0 FOR x IN list_concat(a, b, [a[2]*b[3] - a[3]*b[2], a[3]*b[1] - a[1]*b[3], a[1]*b[2] - a[2]*b[1]])] AS m FROM b""")
def h27(spark, sf):
    v, e = parts(spark, sf)
    return v.select("vec_id", six(ro.rotation_6d_to_matrix(e[:6])).alias("m"))


@add("h28_nearest_rotation")
def h28(spark, sf):
    v, e = parts(spark, sf)
    return v.select("vec_id", F.transform(ro.project_to_rotation(F.array(*e[:9])), lambda x: signed_round(x, 6)).alias("m"))


@add("h31_relative_pose", f"""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE - embedding[8]::DOUBLE AS a, embedding[2]::DOUBLE - embedding[9]::DOUBLE AS b, embedding[3]::DOUBLE - embedding[10]::DOUBLE AS c, embedding[11]::DOUBLE AS w, -embedding[12]::DOUBLE AS x, -embedding[13]::DOUBLE AS y, -embedding[14]::DOUBLE AS z FROM embeddings),
n AS (SELECT *, 2 / (w*w + x*x + y*y + z*z) AS s FROM p), m AS (SELECT vec_id, {MATRIX} AS m, a, b, c FROM n)
SELECT vec_id, [round(v, 5) + 0.0 FOR v IN [m[1]*a + m[2]*b + m[3]*c, m[4]*a + m[5]*b + m[6]*c, m[7]*a + m[8]*b + m[9]*c]] AS position FROM m""")
def h31(spark, sf):
    v, e = parts(spark, sf)
    position, _ = ro.relative_pose((e[7:10], unit(e[10:14])), (e[:3], unit(e[3:7])))
    return v.select("vec_id", F.array(*[F.round(c, 5) + 0.0 for c in position]).alias("position"))


ORDERS = ["XYX", "XYZ", "XZX", "XZY", "YXY", "YXZ", "YZX", "YZY", "ZXY", "ZXZ", "ZYX", "ZYZ"]


@add("h26_euler_orders", f"""WITH o AS (SELECT unnest({ORDERS}) AS convention), e AS (SELECT vec_id, 3 * sin(5 * embedding[1]::DOUBLE) AS a, sin(5 * embedding[2]::DOUBLE) AS b, 3 * sin(5 * embedding[3]::DOUBLE) AS c FROM embeddings)
SELECT vec_id, convention, [round(a, 6) + 0.0, round(CASE WHEN convention[1] = convention[3] THEN 1.5 + 1.3 * b ELSE 1.4 * b END, 6) + 0.0, round(c, 6) + 0.0] AS angles FROM e CROSS JOIN o""")
def h26_orders(spark, sf):
    v, e = parts(spark, sf)
    v, (a, b, c) = tf.staged(v, "a", [F.sin(5 * x) for x in e[:3]])
    found = []
    for order in ORDERS:
        middle = 1.5 + 1.3 * b if order[0] == order[2] else 1.4 * b
        v, m = tf.staged(v, f"m_{order}_", ro.euler_to_matrix([3 * a, middle, 3 * c], order))
        found.append(F.struct(F.lit(order).alias("convention"), six(ro.matrix_to_euler(m, order)).alias("angles")))
    return v.select("vec_id", F.explode(F.array(*found)).alias("r")).select("vec_id", "r.*")


@add("h29_random_rotations", "SELECT vec_id, 1.0::DOUBLE AS length, [1, 0, 0, 0, 1, 0, 0, 0, 1]::DOUBLE[] AS product, true AS turned FROM embeddings")
def h29(spark, sf):
    v = tf.random_rotations(table(spark, sf, "embeddings").select("vec_id"), "vec_id", "q", seed=11)
    v, q = tf.staged(v, "p", [F.get("q", k) for k in range(4)])
    v, m = tf.staged(v, "m", ro.quaternion_to_matrix(q))
    product = ro.matmul(m, [m[3 * j + i] for i in range(3) for j in range(3)])
    length = F.round(F.sqrt(sum((x * x for x in q), F.lit(0.0))), 6)
    return v.select("vec_id", length.alias("length"), six(product).alias("product"), ((q[0] >= 0) & (q[0] < 1)).alias("turned"))


@add("h30_converted_pose", """WITH e AS (SELECT vec_id, embedding, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings)
SELECT vec_id, [round(x, 6) + 0.0 FOR x IN [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, cos(b)*cos(c), -cos(b)*sin(c), sin(b), cos(a)*sin(c) + sin(a)*sin(b)*cos(c), cos(a)*cos(c) - sin(a)*sin(b)*sin(c), -sin(a)*cos(b), embedding[7]::DOUBLE]] AS pose FROM e""")
def h30(spark, sf):
    v = tf.convert_pose(table(spark, sf, "embeddings"), "embedding", "euler", "rotation_6d", rest=1)
    return v.select("vec_id", F.transform("embedding", lambda x: F.round(x, 6) + 0.0).alias("pose"))


@add("h30_pose_round_trip", "SELECT vec_id, [round(x::DOUBLE, 5) + 0.0 FOR x IN embedding[1:7]] AS pose FROM embeddings")
def h30_back(spark, sf):
    v = table(spark, sf, "embeddings")
    for source, target in (("axis_angle", "quaternion"), ("quaternion", "rotation_6d"), ("rotation_6d", "matrix"), ("matrix", "axis_angle")):
        v = tf.convert_pose(v, "embedding", source, target, rest=1)
    return v.select("vec_id", F.transform("embedding", lambda x: F.round(x, 5) + 0.0).alias("pose"))


@add("h28_distance_of_rotation", """WITH a AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:9]] AS m FROM embeddings),
g AS (SELECT vec_id, m, m[1]*m[1]+m[4]*m[4]+m[7]*m[7] AS a, m[2]*m[2]+m[5]*m[5]+m[8]*m[8] AS b, m[3]*m[3]+m[6]*m[6]+m[9]*m[9] AS c,
m[1]*m[2]+m[4]*m[5]+m[7]*m[8] AS d, m[1]*m[3]+m[4]*m[6]+m[7]*m[9] AS e, m[2]*m[3]+m[5]*m[6]+m[8]*m[9] AS f, m[1]*(m[5]*m[9]-m[6]*m[8]) - m[2]*(m[4]*m[9]-m[6]*m[7]) + m[3]*(m[4]*m[8]-m[5]*m[7]) AS det FROM a),
q AS (SELECT *, (a + b + c) / 3 AS q FROM g), p AS (SELECT *, sqrt(((a-q)*(a-q) + (b-q)*(b-q) + (c-q)*(c-q) + 2*(d*d + e*e + f*f)) / 6) AS p FROM q),
r AS (SELECT *, greatest(-1, least(1, ((a-q)*((b-q)*(c-q) - f*f) - d*(d*(c-q) - f*e) + e*(d*f - (b-q)*e)) / (2 * p*p*p))) AS r FROM p),
l AS (SELECT *, q + 2*p*cos(acos(r)/3) AS l1, q + 2*p*cos(acos(r)/3 + 2*pi()/3) AS l3 FROM r)
SELECT vec_id, true AS orthogonal, 1.0::DOUBLE AS determinant, round(3*q + 3 - 2 * (sqrt(greatest(l1, 0)) + sqrt(greatest(3*q - l1 - l3, 0)) + sign(det) * sqrt(greatest(l3, 0))), 6) AS distance FROM l""")
def h28_distance(spark, sf):
    """The result is a rotation, and no rotation is nearer: the least distance follows from the singular values."""
    v, e = parts(spark, sf)
    v = v.select("vec_id", *(x.alias(f"e{k}") for k, x in enumerate(e[:9])))
    v = v.withColumn("m", ro.project_to_rotation(F.array(*(F.col(f"e{k}") for k in range(9)))))
    m = [F.get("m", k) for k in range(9)]
    rows = [m[3 * i : 3 * i + 3] for i in range(3)]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    straight = F.lit(True)
    for i in range(3):
        for j in range(3):
            straight = straight & (F.abs(dot(rows[i], rows[j]) - float(i == j)) < 1e-9)
    a, b, c = rows
    det = a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    apart = sum(((F.col(f"e{k}") - m[k]) ** 2 for k in range(9)), F.lit(0.0))
    return v.select("vec_id", straight.alias("orthogonal"), signed_round(det, 6).alias("determinant"), signed_round(apart, 6).alias("distance"))


@add("e18_pose_relative_to_last", f"""WITH p AS (SELECT vec_id, vec_id // 5 AS episode, [x::DOUBLE FOR x IN embedding[1:3]] AS t, [x::DOUBLE / sqrt(list_dot_product(embedding[4:7]::DOUBLE[], embedding[4:7]::DOUBLE[])) FOR x IN embedding[4:7]] AS q FROM embeddings),
l AS (SELECT *, last_value(t) OVER w AS lt, last_value(q) OVER w AS lq FROM p WINDOW w AS (PARTITION BY episode ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT vec_id, lq[1] AS w, -lq[2] AS x, -lq[3] AS y, -lq[4] AS z, 2.0::DOUBLE AS s, t[1] - lt[1] AS a, t[2] - lt[2] AS b, t[3] - lt[3] AS c, q FROM l),
m AS (SELECT *, {MATRIX} AS m, [w*q[1] - x*q[2] - y*q[3] - z*q[4], w*q[2] + x*q[1] + y*q[4] - z*q[3], w*q[3] - x*q[4] + y*q[1] + z*q[2], w*q[4] + x*q[3] - y*q[2] + z*q[1]] AS r FROM d)
SELECT vec_id, [round(v, 6) + 0.0 FOR v IN [m[1]*a + m[2]*b + m[3]*c, m[4]*a + m[5]*b + m[6]*c, m[7]*a + m[8]*b + m[9]*c]] AS position, [round(CASE WHEN r[1] < 0 THEN -v ELSE v END, 6) + 0.0 FOR v IN r] AS rotation FROM m""")
def e18_pose(spark, sf):
    """Every pose of an episode in the frame of its last one."""
    v, e = parts(spark, sf)
    v = v.select("vec_id", F.floor(F.col("vec_id") / 5).alias("episode"), F.array(*e[:3], *unit(e[3:7])).alias("pose"))
    last = F.last("pose").over(Window.partitionBy("episode").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    v = v.withColumn("base", last)
    own, base = ([F.get(c, k) for k in range(7)] for c in ("pose", "base"))
    position, rotation = ro.relative_pose((base[:3], base[3:]), (own[:3], own[3:]))
    return v.select("vec_id", six(position).alias("position"), six(rotation).alias("rotation"))


@add("h30_pose_without_noise", "SELECT vec_id, [round(x::DOUBLE, 5) + 0.0 FOR x IN embedding[1:3]] || [round(x::DOUBLE, 5) + 0.0 FOR x IN embedding[4:6]] || [round(embedding[7]::DOUBLE, 5) + 0.0] AS pose FROM embeddings")
def h30_noise(spark, sf):
    """Noise of no width changes nothing; the tests look at the spread of other widths."""
    v = table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 7).alias("pose"))
    return tf.noisy_pose(v, "pose", "vec_id", "axis_angle", 0.0, 0.0).select("vec_id", F.transform("pose", lambda x: F.round(x, 5) + 0.0).alias("pose"))


QUERIES, ORACLES = add.queries, add.oracles
