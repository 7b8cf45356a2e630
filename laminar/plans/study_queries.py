"""Study operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from laminar.operators import studies
from laminar.plans.corpus_queries import r6
from laminar.queries import query
from laminar.sources.views import read




@query("profile_contrast", "SELECT vec_id, round(list_sum(u[1:16]) / 16 - list_sum(u[17:]) / 48, 6) AS contrast FROM (SELECT vec_id, [x / list_max([abs(y) FOR y IN e]) FOR x IN e] AS u FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings))")
def profile_contrast(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(studies.contrast(studies.unit(e), 16), 6).alias("contrast"))


@query("descriptor_distance", "SELECT label, vec_id, round(1 - list_dot_product(e, p) / sqrt(list_dot_product(e, e) * list_dot_product(p, p)), 6) AS distance FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) WHERE p IS NOT NULL")
def descriptor_distance(spark, sf_dir):
    last = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = read(spark, sf_dir, "embeddings").withColumn("p", last).where("p IS NOT NULL")
    return rows.select("label", "vec_id", F.round(studies.cosine_distance(F.col("embedding"), F.col("p")), 6).alias("distance"))


@query("profile_bands", """SELECT vec_id, centre, length, row_number() OVER (PARTITION BY vec_id ORDER BY centre) AS band FROM (SELECT vec_id, avg(i)::DOUBLE AS centre, count(*) AS length FROM (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS run FROM
(SELECT vec_id, i, round(avg(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS m FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)) WHERE m > 0.05) GROUP BY vec_id, run)""")
def profile_bands(spark, sf_dir):
    return studies.band_centres(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.05)


@query("declared_measured", "SELECT l_returnflag, count(*) AS n, round(quantile_cont(r, 0.25), 6) AS q1, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.75), 6) AS q3, round(avg((abs(r - 1) <= 0.2)::INT), 6) AS share_within, round(corr(d, m), 6) AS r FROM (SELECT l_returnflag, l_quantity * 1000 AS d, l_extendedprice AS m, l_extendedprice / (l_quantity * 1000) AS r FROM lineitem WHERE l_quantity <> 0) GROUP BY l_returnflag")
def declared_measured(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 1000).alias("d"), F.col("l_extendedprice").alias("m"))
    return studies.agreement(rows, ["l_returnflag"], "d", "m").select("l_returnflag", "n", *r6("q1", "median", "q3", "share_within", "r"))


@query("spectra_compared", "SELECT l_suppkey, round(a.mx, 6) AS max_a, round(a.md, 6) AS median_a, round(b.mx, 6) AS max_b, round(b.md, 6) AS median_b, round(a.mx / b.mx, 6) AS ratio FROM (SELECT l_suppkey, max(l_extendedprice) AS mx, median(l_extendedprice) AS md FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_suppkey, max(l_extendedprice) AS mx, median(l_extendedprice) AS md FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b USING (l_suppkey)")
def spectra_compared(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    found = studies.compared(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), "l_suppkey", "l_extendedprice")
    return found.select("l_suppkey", *r6("max_a", "median_a", "max_b", "median_b", "ratio"))


@query("certificate_problems", "SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN coalesce(o_totalprice < 400000, false) THEN NULL ELSE 'total' END, CASE WHEN coalesce(o_orderstatus <> 'P', false) THEN NULL ELSE 'open' END, CASE WHEN coalesce(o_orderpriority <= '4', false) THEN NULL ELSE 'priority' END], lambda x: x IS NOT NULL)), ',') AS problems, (CASE WHEN coalesce(o_totalprice < 400000, false) THEN 0 ELSE 1 END + CASE WHEN coalesce(o_orderstatus <> 'P', false) THEN 0 ELSE 1 END + CASE WHEN coalesce(o_orderpriority <= '4', false) THEN 0 ELSE 1 END) AS n_problems FROM orders")
def certificate_problems(spark, sf_dir):
    checks = {"total": F.col("o_totalprice") < 400000, "open": F.col("o_orderstatus") != "P", "priority": F.col("o_orderpriority") <= "4"}
    return studies.problems(read(spark, sf_dir, "orders"), "o_orderkey", checks)


@query("census_disagreements", """SELECT k AS o_orderkey, field, recorded, computed, field = 'n' AS hard FROM (SELECT r.k, unnest(['n', 'total']) AS field, unnest([r.n::DOUBLE, r.total]) AS recorded, unnest([c.n::DOUBLE, c.total]) AS computed FROM
(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 4 END AS n, round(o_totalprice) AS total FROM orders) r JOIN (SELECT l_orderkey AS k, count(*) AS n, round(sum(l_extendedprice)) AS total FROM lineitem GROUP BY 1) c USING (k)) WHERE recorded IS NOT NULL AND recorded IS DISTINCT FROM computed""")
def census_disagreements(spark, sf_dir):
    recorded = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 4 END").alias("n"), F.round("o_totalprice").alias("total"))
    computed = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice")).alias("total"))
    return studies.disagreements(recorded, computed, "o_orderkey", ["n", "total"], ["n"])


@query("majority_value", "SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1")
def majority_value(spark, sf_dir):
    return studies.majority(read(spark, sf_dir, "part"), "p_brand", "p_type")


_SWEEP = [5.0, 10.0, 20.0, 30.0, 40.0, 50.0]


@query("threshold_sweep", " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_hit, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS rate FROM lineitem WHERE l_quantity >= {t}" for t in _SWEEP))
def threshold_sweep(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").alias("hit"))
    return studies.sweep(rows, "l_quantity", "hit", _SWEEP).withColumn("rate", F.round("rate", 6))


@query("widest_gaps", "SELECT p_brand, p_retailprice, after, gap, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY gap DESC, p_retailprice) AS rank FROM (SELECT *, round(after - p_retailprice, 6) AS gap FROM (SELECT *, lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS after FROM (SELECT DISTINCT p_brand, p_retailprice FROM part)) WHERE after IS NOT NULL)) WHERE rank <= 3")
def widest_gaps(spark, sf_dir):
    return studies.widest_gaps(read(spark, sf_dir, "part"), "p_brand", "p_retailprice", 3)


@query("segment_names", "SELECT page_id, nullif(regexp_extract(s, '-w(\\d{3})(?:_|$)', 1), '')::INT AS winding, nullif(regexp_extract(s, '(\\d+(?:\\.\\d+)?)um', 1), '')::DOUBLE AS voxel_um, split_part(s, '/', -1) AS name FROM (SELECT page_id, 'v' || (page_id % 9) || '.5um/seg-w' || lpad((page_id % 500)::VARCHAR, 3, '0') || '_' || page_id AS s FROM pages)")
def segment_names(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").selectExpr("page_id", "concat('v', page_id % 9, '.5um/seg-w', lpad(CAST(page_id % 500 AS STRING), 3, '0'), '_', page_id) AS s")
    return rows.select("page_id", *[c.alias(k) for k, c in studies.names(F.col("s")).items()])
