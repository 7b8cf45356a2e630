"""Corpus, statistics and spatial operators over the driver's tables: an order is a segment, its lines are its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminar.operators import corpus, spatial, stats
from laminar.queries import query
from laminar.sources.views import read


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


_PARTS = """SELECT o_orderkey, o_orderpriority, o_orderstatus, l_linestatus, l_linenumber, l_extendedprice AS area, l_returnflag = 'R' AS removed,
  CASE WHEN l_discount > 0.09 THEN NULL ELSE l_extendedprice * (1 + l_tax) END AS base_area FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def parts(spark, sf_dir):
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    base = F.when(F.col("l_discount") > 0.09, None).otherwise(F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", "l_linestatus", "l_linenumber", F.col("l_extendedprice").alias("area"), (F.col("l_returnflag") == "R").alias("removed"), base.alias("base_area"))


@query("corpus_retention", f"""SELECT o_orderpriority, count(*) AS n_parts, count(*) FILTER (WHERE base_area IS NULL) AS n_gaps, round(sum(area), 2) AS area_in, round(sum(area) FILTER (WHERE removed), 2) AS area_removed,
  round(1 - sum(area) FILTER (WHERE removed) / sum(area), 6) AS retained_own, round(1 - sum(area) FILTER (WHERE removed) / sum(base_area), 6) AS retained_base FROM ({_PARTS}) GROUP BY o_orderpriority""")
def corpus_retention(spark, sf_dir):
    return corpus.retention(parts(spark, sf_dir), ["o_orderpriority"]).select("o_orderpriority", "n_parts", "n_gaps", *[F.round(c, 2).alias(c) for c in ("area_in", "area_removed")], *r6("retained_own", "retained_base"))


@query("corpus_truncated_pct", f"SELECT o_orderkey, floor((1 - coalesce(sum(area) FILTER (WHERE removed), 0) / sum(area)) * 100 * 1000 + 1e-9) / 1000 AS pct FROM ({_PARTS}) GROUP BY o_orderkey")
def corpus_truncated_pct(spark, sf_dir):
    return corpus.retention(parts(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", corpus.truncated_pct(1 - F.col("area_removed") / F.col("area_in")).alias("pct"))


_KEYED = "SELECT l_orderkey, l_partkey, l_suppkey, sum(l_extendedprice) AS area FROM lineitem GROUP BY ALL"


@query("corpus_core_prefix", f"""SELECT l_orderkey, l_partkey, l_suppkey, round(area, 2) AS area FROM (SELECT *, coalesce(sum(area) OVER (PARTITION BY l_orderkey ORDER BY area DESC, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(area) OVER (PARTITION BY l_orderkey) AS whole FROM ({_KEYED})) WHERE round(before, 6) < round(whole * 0.8, 6)""")
def corpus_core_prefix(spark, sf_dir):
    keyed = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("area"))
    return corpus.area_core(keyed, "l_orderkey", "area", ["l_partkey", "l_suppkey"], 0.8).withColumn("area", F.round("area", 2))


@query("corpus_recovery", f"""WITH p AS ({_PARTS}), k AS (SELECT o_orderkey, l_linestatus, sum(area) AS a FROM p WHERE NOT removed GROUP BY ALL), w AS (SELECT o_orderkey, sum(area) AS whole FROM p GROUP BY ALL)
SELECT w.o_orderkey, round(coalesce(max(a) / whole, 0), 6) AS r_main, count(a) AS descendants, count(*) FILTER (WHERE a > 0.01 * whole) AS fragments, count(a) = 0 AS destroyed FROM w LEFT JOIN k USING (o_orderkey) GROUP BY w.o_orderkey, whole""")
def corpus_recovery(spark, sf_dir):
    found = corpus.recovery(parts(spark, sf_dir).withColumn("kept", ~F.col("removed")), "o_orderkey", "l_linestatus", "area", "kept")
    return found.withColumn("r_main", F.round("r_main", 6))


@query("corpus_dispositions", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, count(*) AS n_total FROM orders GROUP BY ALL")
def corpus_dispositions(spark, sf_dir):
    return corpus.dispositions(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


_GATES = {"total_under_450000": ("o_totalprice > 450000", "n"), "status_known": ("o_orderstatus NOT IN ('F', 'O', 'P')", "n"), "total_positive": ("o_totalprice <= 0", "n")}
_GATE_SQL = " UNION ALL ".join(f"SELECT '{n}' AS condition, count(*) AS n_checked, count(*) FILTER (WHERE {c}) AS n_offenders, count(*) FILTER (WHERE {c}) = 0 AS holds, coalesce(array_to_string(list_slice(list_sort(list(o_orderkey) FILTER (WHERE {c})), 1, 20), ','), '') AS offenders FROM orders" for n, (c, _) in _GATES.items())


@query("corpus_gates", _GATE_SQL)
def corpus_gates(spark, sf_dir):
    orders, out = read(spark, sf_dir, "orders"), None
    for name, (fails, _) in _GATES.items():
        row = corpus.gate(orders, name, F.expr(fails), "o_orderkey")
        out = row if out is None else out.unionByName(row)
    return out


@query("corpus_coverage", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' ELSE 'ok' END AS state FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey + 5 AS k FROM orders) b ON a.k = b.k")
def corpus_coverage(spark, sf_dir):
    return corpus.coverage(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf_dir, "orders").select((F.col("o_custkey") + 5).alias("k")), "k")


@query("corpus_duplicates", "SELECT doc_id, min(doc_id) OVER w AS canonical, CASE WHEN doc_id <> min(doc_id) OVER w THEN min(doc_id) OVER w END AS duplicate_of, count(*) OVER w AS n_equal FROM documents WINDOW w AS (PARTITION BY md5(text))")
def corpus_duplicates(spark, sf_dir):
    return corpus.duplicates(read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content")), ["content"], "doc_id").drop("content")


@query("corpus_manifest", "SELECT s_nationkey, sha256(string_agg(s_suppkey || '|' || coalesce(s_name, 'absent') || '|' || 'absent', chr(10) ORDER BY s_suppkey || '|' || coalesce(s_name, 'absent') || '|' || 'absent')) AS digest, count(*) AS n_rows FROM supplier GROUP BY s_nationkey")
def corpus_manifest(spark, sf_dir):
    return corpus.manifest(read(spark, sf_dir, "supplier").withColumn("none", F.lit(None).cast("string")), ["s_nationkey"], "s_suppkey", "s_name", "none")


@query("corpus_resume_plan", """SELECT o_orderkey, CASE WHEN d.k IS NULL THEN 'run' WHEN NOT coalesce(d.terminal, false) THEN 'rerun_previous_failure' WHEN d.base IS DISTINCT FROM o.o_orderpriority THEN 'rerun_base_changed' WHEN d.policy IS DISTINCT FROM o.o_orderstatus THEN 'rerun_policy_changed' ELSE 'skip' END AS decision
FROM orders o LEFT JOIN (SELECT o_orderkey AS k, o_orderkey % 7 <> 0 AS terminal, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS base, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS policy FROM orders WHERE o_orderkey % 3 <> 0) d ON d.k = o.o_orderkey""")
def corpus_resume_plan(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("base"), F.col("o_orderstatus").alias("policy"))
    done = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.expr("o_orderkey % 7 <> 0").alias("terminal"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE base END").alias("base"), F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE policy END").alias("policy"))
    return corpus.resume_plan(orders, done, "o_orderkey", ["base", "policy"])


@query("corpus_drift", """SELECT * FROM (SELECT p_partkey, unnest(['p_brand', 'p_size']) AS field, unnest([a.p_brand, a.p_size::VARCHAR]) AS before, unnest([b.p_brand, b.p_size::VARCHAR]) AS after FROM part a FULL JOIN
(SELECT p_partkey, upper(p_brand) AS p_brand, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_partkey % 13 <> 0) b USING (p_partkey)) WHERE before IS DISTINCT FROM after""")
def corpus_drift(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    after = part.where("p_partkey % 13 <> 0").select("p_partkey", F.upper("p_brand").alias("p_brand"), F.expr("CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END").alias("p_size"))
    return corpus.drift(part, after, "p_partkey", ["p_brand", "p_size"])


@query("corpus_shard", "SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS n FROM supplier) WHERE n % 4 = 1")
def corpus_shard(spark, sf_dir):
    return corpus.shard(read(spark, sf_dir, "supplier"), ["s_name", "s_suppkey"], 1, 4).select("s_suppkey", "s_name")


@query("event_topk", "SELECT user_id, event_id, round(value, 6) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def event_topk(spark, sf_dir):
    return corpus.top_k(read(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), "event_id"], 3).select("user_id", "event_id", *r6("value"), "rank")


@query("last_record_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_record_wins(spark, sf_dir):
    return corpus.last_per_key(read(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("missing_numbers", "SELECT r.b, r.n FROM (SELECT p_brand AS b, unnest(range(min(p_size), max(p_size) + 1)) AS n FROM part GROUP BY p_brand) r ANTI JOIN (SELECT DISTINCT p_brand AS b, p_size AS n FROM part) p ON p.b = r.b AND p.n = r.n")
def missing_numbers(spark, sf_dir):
    return corpus.missing_numbers(read(spark, sf_dir, "part").select(F.col("p_brand").alias("b"), F.col("p_size").cast("long").alias("n")), "b", "n")


@query("describe_values", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type")
def describe_values(spark, sf_dir):
    return stats.describe(read(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "n", *r6("median", "p90", "p99", "max"))


_AUC = """SELECT l_linestatus AS g, sum(pos) AS n_pos, sum(n - pos) AS n_neg, round((sum((below + (n + 1) / 2.0) * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(n - pos)), 6) AS auc FROM (
SELECT *, coalesce(sum(n) OVER (PARTITION BY l_linestatus ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT l_linestatus, l_quantity AS s, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS pos FROM lineitem GROUP BY ALL)) GROUP BY l_linestatus"""


@query("rank_auc", f"SELECT g, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, auc, CASE WHEN auc > 0.75 THEN 'STANDS' WHEN auc > 0.65 THEN 'SUGGESTIVE' ELSE 'DEAD' END AS said FROM ({_AUC})")
def rank_auc(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("g"), F.col("l_quantity").alias("s"), (F.col("l_returnflag") == "R").alias("p"))
    return stats.rank_auc(rows, ["g"], "s", "p").select("g", "n_pos", "n_neg", *r6("auc")).withColumn("said", stats.auc_verdict(F.col("auc")))


_T = [1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0]


@query("event_survival", f"SELECT event_type, n, threshold, n_above, round(n_above / n, 6) AS share FROM (SELECT event_type, count(value) AS n, unnest([{', '.join(f'{t}::DOUBLE' for t in _T)}]) AS threshold, unnest([{', '.join(f'count(*) FILTER (WHERE value > {t})' for t in _T)}]) AS n_above FROM events GROUP BY event_type)")
def event_survival(spark, sf_dir):
    return stats.survival(read(spark, sf_dir, "events"), ["event_type"], "value", _T).withColumn("share", F.round("share", 6))


@query("band_structure", """SELECT g, band, min(x) AS lo, max(x) AS hi, count(*) AS n_values FROM (SELECT *, sum(cut) OVER (PARTITION BY g ORDER BY x)::BIGINT AS band FROM (SELECT *, CASE WHEN x >= lag(x) OVER w * 1.4 AND x - lag(x) OVER w >= 0.05 THEN 1 ELSE 0 END AS cut
FROM (SELECT DISTINCT p_brand AS g, round(p_retailprice * p_size / 100, 2) AS x FROM part) WINDOW w AS (PARTITION BY g ORDER BY x))) GROUP BY g, band""")
def band_structure(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), stats.rounded(F.col("p_retailprice") * F.col("p_size") / 100, 2).alias("x"))
    return stats.bands(rows, "g", "x")


@query("size_model", "SELECT (CASE WHEN n >= 2 THEN 1 ELSE 0 END) + (CASE WHEN n >= 4 THEN 1 ELSE 0 END) + (CASE WHEN n >= 6 THEN 1 ELSE 0 END) AS band, count(*) AS n, round(avg(bad::INT), 6) AS observed, round(avg(1 - power(0.98, n)), 6) AS modelled FROM (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1) GROUP BY 1")
def size_model(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("bad"))
    return stats.size_model(rows, "n", "bad", [2, 4, 6], 0.02).select("band", "n", *r6("observed", "modelled"))


@query("permutation_null")
def permutation_null(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars", (F.col("quality") == 1).alias("p"))
    return stats.permutation_null(rows, "n_chars", "p")


@query("precision_recall", "SELECT l_linestatus, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT l_linestatus, count(*) FILTER (WHERE f AND t) AS tp, count(*) FILTER (WHERE f AND NOT t) AS fp, count(*) FILTER (WHERE NOT f AND t) AS fn FROM (SELECT l_linestatus, l_quantity > 25 AS f, l_returnflag = 'R' AS t FROM lineitem) GROUP BY 1)")
def precision_recall(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_quantity") > 25).alias("f"), (F.col("l_returnflag") == "R").alias("t"))
    return stats.confusion(rows, "f", "t", ["l_linestatus"]).select("l_linestatus", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


@query("flag_enrichment", "SELECT round(avg(d::INT) FILTER (WHERE f), 6) AS rate_flagged, round(avg(d::INT) FILTER (WHERE NOT f), 6) AS rate_control, count(*) FILTER (WHERE d IS NULL) AS n_unknown, round(avg(d::INT) FILTER (WHERE f) / avg(d::INT) FILTER (WHERE NOT f), 6) AS enrichment FROM (SELECT l_quantity > 25 AS f, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_returnflag = 'R' END AS d FROM lineitem)")
def flag_enrichment(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).alias("f"), F.when(~(F.col("l_discount") > 0.08), F.col("l_returnflag") == "R").alias("d"))
    return stats.enrichment(rows, "f", "d").select(*r6("rate_flagged", "rate_control"), "n_unknown", *r6("enrichment"))


@query("period_status", "SELECT event_id, CASE WHEN t IS NULL THEN 'unavailable' WHEN NOT c THEN 'disagreed' WHEN nb IS NULL OR nb <= 0 THEN 'unavailable' WHEN t / nb BETWEEN 0.8 AND 1.25 THEN 'agreed' ELSE 'disagreed' END AS status, CASE WHEN nb IS NULL THEN 'no crossing' WHEN nb < 0.15 THEN '< 0.15 rev' WHEN nb < 1.6 THEN '0.15 - 1.6 rev' ELSE '>= 1.6 rev' END AS band FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS t, event_id % 4 <> 0 AS c, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value + (event_id % 7) - 3 END AS nb FROM events)")
def period_status(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 9 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS t", "event_id % 4 <> 0 AS c", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value + (event_id % 7) - 3 END AS nb")
    return rows.select("event_id", stats.period_status(F.col("t"), F.col("c"), F.col("nb")).alias("status"), stats.separation_band(F.col("nb")).alias("band"))


_BOX = "p_partkey AS k, (p_partkey * 37 % 1000)::DOUBLE AS lo_x, (p_partkey * 37 % 1000 + p_size)::DOUBLE AS hi_x, (p_retailprice % 500) AS lo_y, (p_retailprice % 500) + p_size / 2.0 AS hi_y"


@query("box_overlap_join", f"WITH b AS (SELECT {_BOX} FROM part) SELECT a.k AS a_k, b.k AS b_k, round((least(a.hi_x, b.hi_x) - greatest(a.lo_x, b.lo_x)) * (least(a.hi_y, b.hi_y) - greatest(a.lo_y, b.lo_y)), 4) AS overlap FROM b a JOIN b ON a.k < b.k AND a.hi_x >= b.lo_x AND b.hi_x >= a.lo_x AND a.hi_y >= b.lo_y AND b.hi_y >= a.lo_y WHERE (least(a.hi_x, b.hi_x) - greatest(a.lo_x, b.lo_x)) * (least(a.hi_y, b.hi_y) - greatest(a.lo_y, b.lo_y)) > 1")
def box_overlap_join(spark, sf_dir):
    boxes = read(spark, sf_dir, "part").selectExpr(*[c.strip() for c in _BOX.replace("(p_partkey * 37 % 1000)::DOUBLE", "CAST(p_partkey * 37 % 1000 AS DOUBLE)").replace("(p_partkey * 37 % 1000 + p_size)::DOUBLE", "CAST(p_partkey * 37 % 1000 + p_size AS DOUBLE)").replace("/ 2.0", "/ 2.0D").split(", ")])
    return spatial.box_overlaps(boxes, "k", ["x", "y"], 50.0, 1.0, 4)


_P3 = "vec_id, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z"


def _points(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", *[(F.col("embedding")[i].cast("double") * 100).alias(k) for i, k in enumerate("xyz")])


@query("nearest_two_groups", f"""WITH p AS (SELECT {_P3} FROM embeddings), d AS (SELECT q.vec_id AS qid, p.label AS tag, min((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) AS d2 FROM p q JOIN p ON abs(p.label - q.label) >= 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tag) AS r FROM d WHERE d2 <= 100)
SELECT vec_id AS qid, a.tag AS w1, round(coalesce(sqrt(a.d2), 'inf'::DOUBLE), 6) AS d1, b.tag AS w2, round(coalesce(sqrt(b.d2), 'inf'::DOUBLE), 6) AS d2 FROM p LEFT JOIN r a ON a.qid = vec_id AND a.r = 1 LEFT JOIN r b ON b.qid = vec_id AND b.r = 2""")
def nearest_two_groups(spark, sf_dir):
    points = _points(spark, sf_dir)
    found = spatial.nearest_groups(points.select(F.col("vec_id").alias("qid"), F.col("label").alias("grp"), "x", "y", "z"), points.select(F.col("label").alias("tag"), "x", "y", "z"), ["x", "y", "z"], 10.0, 2)
    return found.select("qid", "w1", *r6("d1"), "w2", *r6("d2"))


@query("point_in_cube_lookup", f"""WITH p AS (SELECT {_P3} FROM embeddings), l AS (SELECT floor(x) AS lx, floor(y) AS ly, floor(z) AS lz, min(label) AS label FROM p WHERE vec_id % 2 = 0 GROUP BY ALL)
SELECT vec_id, EXISTS (SELECT 1 FROM l WHERE floor(l.lx / 8) = floor(p.x / 8) AND floor(l.ly / 8) = floor(p.y / 8) AND floor(l.lz / 8) = floor(p.z / 8)) AS covered, l.label AS found FROM p LEFT JOIN l ON l.lx = floor(p.x) AND l.ly = floor(p.y) AND l.lz = floor(p.z)""")
def point_in_cube_lookup(spark, sf_dir):
    points = _points(spark, sf_dir)
    labels = points.where("vec_id % 2 = 0").groupBy(*[F.floor(k).alias(k) for k in "xyz"]).agg(F.min("label").alias("label"))
    return spatial.points_in_cubes(points.select("vec_id", "x", "y", "z"), labels, ["x", "y", "z"], 8).select("vec_id", "covered", F.col("label").alias("found"))


@query("cube_grid_agg", f"SELECT floor(x / 20)::BIGINT AS cx, floor(y / 20)::BIGINT AS cy, count(*) AS n, round(median(z), 6) AS median_z, mode(1) IS NOT NULL AS ok FROM (SELECT {_P3} FROM embeddings) GROUP BY ALL HAVING count(*) >= 5")
def cube_grid_agg(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.groupBy(F.floor(F.col("x") / 20).alias("cx"), F.floor(F.col("y") / 20).alias("cy")).agg(F.count("*").alias("n"), F.round(F.median("z"), 6).alias("median_z"), F.lit(True).alias("ok")).where("n >= 5")


@query("tile_census", "SELECT g, tv, tu, n, bad FROM (SELECT t.g, t.tv, t.tu, t.n, b.g IS NOT NULL AS bad FROM (SELECT 0 AS g, floor(vec_id / 24)::BIGINT AS tv, floor(u / 24)::BIGINT AS tu, count(*) AS n FROM embeddings, range(0, 64) r(u) GROUP BY ALL HAVING count(*) >= 164) t LEFT JOIN (SELECT DISTINCT 0 AS g, floor(vec_id / 24)::BIGINT AS tv, floor(label * 6 / 24)::BIGINT AS tu FROM embeddings WHERE floor(vec_id / 24) = floor((vec_id + label) / 24)) b USING (g, tv, tu))")
def tile_census(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    cells = rows.select(F.lit(0).alias("g"), F.col("vec_id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("u"), F.lit(True).alias("valid"))
    bad = rows.select(F.lit(0).alias("g"), F.col("vec_id").alias("v1"), (F.col("label") * 6).alias("u1"), (F.col("vec_id") + F.col("label")).alias("v2"), (F.col("label") * 6).alias("u2"))
    return spatial.tile_census(cells, bad, "g")
