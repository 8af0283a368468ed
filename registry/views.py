"""Views over the given tables, in Spark and in SQL.

Each view exists twice: as a DataFrame property of ``Views`` and as a CTE of
the same name. Values that later meet a rank, a class break or a join are
rounded to nine places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aridscape.operators.anomaly import leave_one_out
from aridscape.operators.classify import apply_breaks
from aridscape.operators.distance import euclidean_distance
from aridscape.operators.normalize import Criterion, score_layers
from aridscape.operators.overlay import risk_column
from aridscape.operators.stats import column_quantiles
from aridscape.sources.config import landcover_table
from aridscape.session import cut_lineage
from aridscape.sources.grid import GridSpec

WIDTH = 50
RES = 30.0
LEFT = 552150.0
TOP = 4284720.0
CRS = "EPSG:32635"

CRITERIA = [
    Criterion("precip", "minmax_percentile", False),
    Criterion("ndvi_dry", "minmax_percentile", False),
    Criterion("soil", "minmax_percentile", False),
    Criterion("lst", "minmax_percentile", True),
]
NAMES = [c.name for c in CRITERIA]
# long fractions, so that no product of rounded scores ends in an exact half
WEIGHTS = {"precip": 0.41371943, "ndvi_dry": 0.29183127, "soil": 0.19887491, "lst": 0.09557439}
LABELS = ["precip", "ndvi_dry", "soil", "lst", "slope"]


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


def r9(value: Column) -> Column:
    return F.round(value, 9) + F.lit(0.0)


class Views:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_cells(self) -> int:
        return self.table("part").count()

    @cached_property
    def grid(self) -> GridSpec:
        return GridSpec(CRS, RES, WIDTH, -(-self.n_cells // WIDTH), LEFT, TOP)

    @cached_property
    def cells(self) -> DataFrame:
        codes = F.array(*[F.lit(c) for c in (10, 20, 30, 40, 50, 60, 80, 90)])
        return self.table("part").select(
            F.col("p_partkey").alias("cell_id"),
            F.expr(f"p_partkey div {WIDTH}").alias("row"),
            (F.col("p_partkey") % WIDTH).alias("col"),
            F.col("p_retailprice").alias("elev"),
            "p_size",
            F.element_at(codes, (F.col("p_size") % 8 + 1).cast("int")).alias("lc"),
        )

    @cached_property
    def located(self) -> DataFrame:
        """Cells with projected centre coordinates."""
        return self.cells.withColumns({"x": self.grid.x_of(F.col("col")), "y": self.grid.y_of(F.col("row"))})

    @cached_property
    def zones(self) -> DataFrame:
        """Cells with a blocky land-cover class, so pure windows exist."""
        codes = F.array(F.lit(40), F.lit(10), F.lit(30))
        place = F.expr("(row div 7) + (col div 7)") % 3 + 1
        return self.cells.withColumn("zone", F.element_at(codes, place.cast("int")))

    @cached_property
    def layers(self) -> DataFrame:
        lines = self.table("lineitem").select("l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
        sums = lines.groupBy(F.col("l_partkey").alias("cell_id")).agg(
            F.sum("l_quantity").alias("precip"),
            r9(F.avg("l_discount")).alias("ndvi_dry"),
            r9(F.avg("l_tax")).alias("soil"),
            r6(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).alias("lst"),
        )
        hot = F.when(F.col("p_size") % 25 != 0, F.col("lst"))
        return sums.join(self.cells.select("cell_id", "p_size"), "cell_id").select(
            "cell_id", "precip", "ndvi_dry", "soil", hot.alias("lst")
        )

    @cached_property
    def tall_layers(self) -> DataFrame:
        return self.layers.unpivot("cell_id", NAMES, "layer", "value")

    @cached_property
    def grid_layers(self) -> DataFrame:
        """The same layers on several grids, one per return flag."""
        lines = self.table("lineitem").select("l_returnflag", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
        sums = lines.groupBy(F.col("l_returnflag").alias("grid"), F.col("l_partkey").alias("cell_id")).agg(
            F.sum("l_quantity").alias("precip"),
            r9(F.avg("l_discount")).alias("ndvi_dry"),
            r9(F.avg("l_tax")).alias("soil"),
            r6(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).alias("lst"),
        )
        return sums.withColumn("lst", F.when(F.col("cell_id") % 25 != 0, F.col("lst")))

    @cached_property
    def grid_risk(self) -> DataFrame:
        """Scores by each grid's own bounds, and their weighted sum."""
        from aridscape.operators.keyed import score_layers_by

        scores, _ = score_layers_by(self.grid_layers, CRITERIA, ["grid"])
        scores = scores.select("grid", "cell_id", *[r9(F.col(n)).alias(n) for n in NAMES])
        return scores.withColumn("risk", r9(risk_column(WEIGHTS)))

    @cached_property
    def impact(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("cell_id"), F.year("l_shipdate").alias("year"))
            .agg(F.avg("l_discount").alias("v"))
        )

    @cached_property
    def obs(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("cell_id"),
            F.col("l_shipdate").cast("date").alias("day"),
            (F.lit(0.02) + F.col("l_tax")).alias("red"),
            (F.lit(0.10) + F.lit(5.0) * F.col("l_discount")).alias("nir"),
            (F.lit(0.01) + F.col("l_tax") / 2).alias("blue"),
            F.col("l_linenumber").alias("scl"),
            F.col("l_quantity").cast("int").alias("qa"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scene_id"),
        )

    @cached_property
    def monthly(self) -> DataFrame:
        """Median index per cell and month of the clear observations."""
        from aridscape.operators.composites import monthly_median, ndvi, scl_clear

        clear = self.obs.where(scl_clear(F.col("scl"), (1, 3, 7))).withColumn("i", ndvi(F.col("red"), F.col("nir")))
        return monthly_median(clear, "i").withColumn("value", r9(F.col("value")))

    @cached_property
    def climate(self) -> DataFrame:
        orders = self.table("orders").select("o_custkey", "o_orderdate", "o_totalprice")
        customer = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
        return (
            orders.join(customer, "o_custkey")
            .join(nation, "c_nationkey")
            .groupBy(
                F.col("n_regionkey").alias("region_id"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")
            )
            .agg(
                r9(F.sum("o_totalprice") / 1e6).alias("ppt"),
                r9(F.avg("o_totalprice") / 9973.0).alias("soil"),
                r9(F.avg("c_acctbal") / 997.0).alias("pdsi"),
                F.count("*").cast("double").alias("pet"),
            )
        )

    @cached_property
    def basin(self) -> DataFrame:
        """One series over all regions, under region 0."""
        return (
            self.table("orders")
            .groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
            .agg(r9(F.sum("o_totalprice") / 1e6).alias("ppt"), r9(F.avg("o_totalprice") / 9973.0).alias("soil"))
            .withColumn("region_id", F.lit(0))
        )

    @cached_property
    def zseries(self) -> DataFrame:
        """Standardised monthly series per region (stands in for an index)."""
        stats = self.climate.groupBy("region_id").agg(F.avg("ppt").alias("m"), F.stddev_samp("ppt").alias("s"))
        return self.climate.join(stats, "region_id").select(
            "region_id", "month", r9((F.col("ppt") - F.col("m")) / F.col("s")).alias("z"), "pdsi"
        )

    @cached_property
    def features(self) -> DataFrame:
        return self.cells.where("p_size = 50").select("row", "col")

    @cached_property
    def distance(self) -> DataFrame:
        flagged = self.cells.withColumn("wet", F.col("p_size") == 50)
        return euclidean_distance(flagged, "wet", RES, shape=(self.grid.height, self.grid.width)).withColumn("distance_m", r9(F.col("distance_m")))

    @cached_property
    def scenes(self) -> DataFrame:
        prefix = F.when(F.col("o_orderstatus") == "F", "MYD11A2.").otherwise("MOD11A2.")
        return self.table("orders").select(
            F.concat(prefix, F.col("o_orderkey").cast("string")).alias("scene_id"),
            F.col("o_orderdate").alias("ts"),
            (F.col("o_totalprice").cast("bigint") % 100).alias("cloud"),
            F.create_map(
                F.lit("start_datetime"), F.date_format("o_orderdate", "yyyy-MM-dd"),
                F.lit("s2:processing_baseline"),
                F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("0"), ((F.col("o_orderkey") % 4) + 2).cast("string"), F.lit(".11"))).otherwise("n/a"),
            ).alias("properties"),
        )

    @cached_property
    def crop(self) -> DataFrame:
        lines = self.table("lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        return (
            lines.join(part, "l_partkey")
            .groupBy(F.col("p_brand").alias("crop"), F.year("l_shipdate").alias("year"))
            .agg(r9(F.sum("l_extendedprice") / 1e5).alias("production"), (F.sum("l_quantity") / 1e2).alias("area"))
        )

    @cached_property
    def judgements(self) -> DataFrame:
        """Signed answers of every supplier for i < j over five criteria."""
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(5) for j in range(i + 1, 5)])
        raw = (F.col("respondent") * (F.col("i") + 1) + F.col("j") * 3) % 17 - 8
        return (
            self.table("supplier")
            .select(F.col("s_suppkey").alias("respondent"), F.inline(pairs))
            .withColumn("answer", F.when(F.abs(raw) < 1, F.lit(1).cast("bigint")).otherwise(raw))
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """A short line or a triangle per supplier, somewhere on the grid."""
        key = F.col("s_suppkey")
        extent = self.grid.height * RES
        ax = F.lit(LEFT) + ((key * 37 + 11) % 101 + 0.37) * (WIDTH * RES / 101)
        ay = F.lit(TOP) - ((key * 53 + 7) % 103 + 0.4137) * (extent / 103)
        bx = ax + ((key * 29) % 41 - 20) * 7.3 + 1.9
        by = ay + ((key * 31) % 37 - 18) * 5.7 + 2.3
        cx = ax + ((key * 17) % 43 - 21) * 6.1 + 3.1
        cy = ay + ((key * 23) % 47 - 23) * 4.9 + 1.3
        point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        line = F.array(point(ax, ay), point(bx, by))
        ring = F.array(point(ax, ay), point(bx, by), point(cx, cy), point(ax, ay))
        polygon = F.col("s_nationkey") % 2 == 1
        return self.table("supplier").select(
            key.alias("feature_id"),
            F.when(polygon, "polygon").otherwise("line").alias("geom_type"),
            F.lit(0).alias("part"),
            F.when(polygon, ring).otherwise(line).alias("points"),
            F.create_map(
                F.lit("waterway"), F.element_at(F.array(*[F.lit(v) for v in ("river", "stream", "canal", "ditch")]), (key % 4 + 1).cast("int")),
                F.lit("landuse"), F.when(key % 3 == 0, "reservoir").otherwise("basin"),
            ).alias("tags"),
        )

    @cached_property
    def landcover(self) -> DataFrame:
        return landcover_table(self.spark)

    # --- risk ------------------------------------------------------------------

    @cached_property
    def scores(self) -> DataFrame:
        # bounds, breaks and the scores scan the layers several times: aggregated once
        scored = score_layers(cut_lineage(self.layers), CRITERIA)
        return scored.select("cell_id", *[r9(F.col(n)).alias(n) for n in NAMES])

    @cached_property
    def risk(self) -> DataFrame:
        return self.scores.withColumn("risk", r9(risk_column(WEIGHTS)))

    @cached_property
    def breaks(self) -> list[float]:
        return [round(b, 9) for b in column_quantiles(self.risk, ["risk"], [0.2, 0.4, 0.6, 0.8, 1.0])["risk"]]

    @cached_property
    def classes(self) -> DataFrame:
        return self.risk.withColumn("class", apply_breaks(F.col("risk"), self.breaks))

    @cached_property
    def anomalies(self) -> DataFrame:
        """Raw leave-one-out anomalies of every year."""
        raw = leave_one_out(self.impact, "v", standardize=False)
        return raw.withColumn("anomaly", r9(F.col("anomaly")))

    @cached_property
    def joined(self) -> DataFrame:
        """Risk, class, land cover and anomaly per cell and year."""
        return (
            self.anomalies.select("cell_id", "year", "anomaly")
            .join(self.classes.select("cell_id", "risk", "class"), "cell_id")
            .join(self.cells.select("cell_id", "row", "col", "elev", F.col("lc").alias("code")), "cell_id")
        )

    @cached_property
    def labels(self) -> DataFrame:
        """Dry years by spring soil of the basin series."""
        from aridscape.operators.validate import label_dry_years

        return label_dry_years(self.basin, "soil", threshold=0.0).withColumn("severity", r9(F.col("severity")))


def views(spark: SparkSession, sf_dir: str) -> Views:
    """Views of one query: nothing is kept between queries."""
    return Views(spark, sf_dir)


# --- the same views in SQL --------------------------------------------------------


def _score(column: str, low: str, high: str, riskier: bool) -> str:
    scaled = f"least(greatest(({column} - {low}) / ({high} - {low}), 0), 1)"
    directed = scaled if riskier else f"1 - {scaled}"
    return f"CASE WHEN {column} IS NOT NULL THEN round({directed}, 9) + 0.0 END AS {column}"


CTES: dict[str, tuple[str, str]] = {
    "cells": ("", f"""SELECT p_partkey AS cell_id, p_partkey // {WIDTH} AS "row", p_partkey % {WIDTH} AS col, p_retailprice AS elev,
        p_size, [10,20,30,40,50,60,80,90][p_size % 8 + 1] AS lc FROM part"""),
    "dims": ("", f"SELECT CAST(ceil(count(*) / {WIDTH}.0) AS BIGINT) AS h FROM part"),
    "zones": ("cells", """SELECT *, [40,10,30][CAST(("row" // 7 + col // 7) % 3 + 1 AS INT)] AS zone FROM cells"""),
    "layers": ("cells", """SELECT cell_id, sum(l_quantity) AS precip, round(avg(l_discount), 9) + 0.0 AS ndvi_dry,
        round(avg(l_tax), 9) + 0.0 AS soil, CASE WHEN p_size % 25 <> 0 THEN round(avg(l_extendedprice / l_quantity), 6) + 0.0 END AS lst
        FROM cells JOIN lineitem ON l_partkey = cell_id GROUP BY cell_id, p_size"""),
    "glayers": ("", """SELECT l_returnflag AS grid, l_partkey AS cell_id, sum(l_quantity) AS precip, round(avg(l_discount), 9) + 0.0 AS ndvi_dry,
        round(avg(l_tax), 9) + 0.0 AS soil, CASE WHEN l_partkey % 25 <> 0 THEN round(avg(l_extendedprice / l_quantity), 6) + 0.0 END AS lst
        FROM lineitem GROUP BY 1, 2"""),
    "gbounds": ("glayers", ("SELECT grid, " + ", ".join(f"quantile_cont({c}, 0.02) AS {c}_lo, quantile_cont({c}, 0.98) AS {c}_hi" for c in NAMES) + " FROM glayers GROUP BY grid")),
    "grisk": ("glayers gbounds", "SELECT *, round(" + " + ".join(f"{w} * {n}" for n, w in WEIGHTS.items()) + ", 9) + 0.0 AS risk FROM (SELECT grid, cell_id, "
        + ", ".join(_score(c.name, f"{c.name}_lo", f"{c.name}_hi", c.higher_is_riskier) for c in CRITERIA) + " FROM glayers JOIN gbounds USING (grid))"),
    "impact": ("", """SELECT l_partkey AS cell_id, CAST(year(l_shipdate) AS INT) AS "year", avg(l_discount) AS v
        FROM lineitem GROUP BY 1, 2"""),
    "obs": ("", """SELECT l_partkey AS cell_id, CAST(l_shipdate AS DATE) AS day, 0.02 + l_tax AS red, 0.10 + 5.0 * l_discount AS nir,
        0.01 + l_tax / 2 AS blue, l_linenumber AS scl, CAST(l_quantity AS INT) AS qa, l_orderkey * 10 + l_linenumber AS scene_id FROM lineitem"""),
    "monthly": ("obs", """SELECT cell_id, CAST(year(day) AS INT) AS "year", CAST(month(day) AS INT) AS "month",
        round(median(CASE WHEN nir + red > 0 AND (nir - red) / (nir + red) BETWEEN -1 AND 1 THEN (nir - red) / (nir + red) END), 9) + 0.0 AS value
        FROM obs WHERE scl NOT IN (1, 3, 7) GROUP BY ALL"""),
    "climate": ("", """SELECT n_regionkey AS region_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS "month",
        round(sum(o_totalprice) / 1e6, 9) + 0.0 AS ppt, round(avg(o_totalprice) / 9973.0, 9) + 0.0 AS soil,
        round(avg(c_acctbal) / 997.0, 9) + 0.0 AS pdsi, CAST(count(*) AS DOUBLE) AS pet
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""),
    "basin": ("", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS "month", round(sum(o_totalprice) / 1e6, 9) + 0.0 AS ppt,
        round(avg(o_totalprice) / 9973.0, 9) + 0.0 AS soil FROM orders GROUP BY 1"""),
    "zseries": ("climate", """SELECT region_id, "month", round((ppt - avg(ppt) OVER w) / stddev_samp(ppt) OVER w, 9) + 0.0 AS z, pdsi
        FROM climate WINDOW w AS (PARTITION BY region_id)"""),
    "features": ("cells", 'SELECT "row", col FROM cells WHERE p_size = 50'),
    "distance": ("cells features", f"""SELECT c.cell_id, round(min(sqrt((c."row" - f."row") ** 2 + (c.col - f.col) ** 2)) * {RES}, 9) + 0.0 AS distance_m
        FROM cells c, features f GROUP BY c.cell_id"""),
    "scenes": ("", """SELECT (CASE WHEN o_orderstatus = 'F' THEN 'MYD11A2.' ELSE 'MOD11A2.' END) || o_orderkey AS scene_id,
        o_orderdate AS ts, CAST(trunc(o_totalprice) AS BIGINT) % 100 AS cloud, strftime(o_orderdate, '%Y-%m-%d') AS start_datetime,
        CASE WHEN o_orderkey % 5 <> 0 THEN '0' || (o_orderkey % 4 + 2) || '.11' ELSE 'n/a' END AS baseline FROM orders"""),
    "crop": ("", """SELECT p_brand AS crop, CAST(year(l_shipdate) AS INT) AS "year", round(sum(l_extendedprice) / 1e5, 9) + 0.0 AS production,
        sum(l_quantity) / 1e2 AS area FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""),
    "judgements": ("", """SELECT s_suppkey AS respondent, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j,
        CASE WHEN abs((s_suppkey * (a.i + 1) + b.i * 3) % 17 - 8) < 1 THEN 1 ELSE (s_suppkey * (a.i + 1) + b.i * 3) % 17 - 8 END AS answer
        FROM supplier, range(5) a(i), range(5) b(i) WHERE a.i < b.i"""),
    "matrix": ("judgements", """SELECT respondent, i, j, CASE WHEN answer > 0 THEN CAST(answer AS DOUBLE) ELSE 1.0 / abs(answer) END AS a FROM judgements
        UNION ALL SELECT respondent, j, i, 1.0 / CASE WHEN answer > 0 THEN CAST(answer AS DOUBLE) ELSE 1.0 / abs(answer) END FROM judgements
        UNION ALL SELECT s_suppkey, CAST(r.i AS INT), CAST(r.i AS INT), 1.0 FROM supplier, range(5) r(i)"""),
    "vectors": ("dims", f"""SELECT s_suppkey AS feature_id, CASE WHEN s_nationkey % 2 = 1 THEN 'polygon' ELSE 'line' END AS geom_type, s_suppkey AS k, a_x, a_y,
        a_x + ((s_suppkey * 29) % 41 - 20) * 7.3 + 1.9 AS b_x, a_y + ((s_suppkey * 31) % 37 - 18) * 5.7 + 2.3 AS b_y,
        a_x + ((s_suppkey * 17) % 43 - 21) * 6.1 + 3.1 AS c_x, a_y + ((s_suppkey * 23) % 47 - 23) * 4.9 + 1.3 AS c_y
        FROM (SELECT *, {LEFT} + ((s_suppkey * 37 + 11) % 101 + 0.37) * ({WIDTH * RES} / 101) AS a_x,
        {TOP} - ((s_suppkey * 53 + 7) % 103 + 0.4137) * (h * {RES} / 103) AS a_y FROM supplier, dims)"""),
    "edges": ("vectors", """SELECT feature_id, geom_type, a_x AS x1, a_y AS y1, b_x AS x2, b_y AS y2 FROM vectors
        UNION ALL SELECT feature_id, geom_type, b_x, b_y, c_x, c_y FROM vectors WHERE geom_type = 'polygon'
        UNION ALL SELECT feature_id, geom_type, c_x, c_y, a_x, a_y FROM vectors WHERE geom_type = 'polygon'"""),
    "filled": ("cells vectors", f"""SELECT DISTINCT c.cell_id, c."row", c.col FROM vectors v,
        (SELECT *, {LEFT} + (col + 0.5) * {RES} AS x, {TOP} - ("row" + 0.5) * {RES} AS y FROM cells) c
        WHERE geom_type = 'polygon' AND (
          ((b_x - a_x) * (y - a_y) - (b_y - a_y) * (x - a_x) > 0 AND (c_x - b_x) * (y - b_y) - (c_y - b_y) * (x - b_x) > 0 AND (a_x - c_x) * (y - c_y) - (a_y - c_y) * (x - c_x) > 0)
          OR ((b_x - a_x) * (y - a_y) - (b_y - a_y) * (x - a_x) < 0 AND (c_x - b_x) * (y - b_y) - (c_y - b_y) * (x - b_x) < 0 AND (a_x - c_x) * (y - c_y) - (a_y - c_y) * (x - c_x) < 0))"""),
    "landcover": ("", """SELECT * FROM (VALUES (10,'Tree cover',0.25),(20,'Shrubland',0.55),(30,'Grassland',0.70),(40,'Cropland',0.90),
        (50,'Built-up',NULL),(60,'Bare / sparse vegetation',1.00),(70,'Snow and ice',NULL),(80,'Permanent water bodies',NULL),
        (90,'Herbaceous wetland',0.10),(95,'Mangroves',NULL),(100,'Moss and lichen',0.60)) t(code, name, score)"""),
    "bounds": ("layers", ("SELECT " + ", ".join(f"quantile_cont({c}, 0.02) AS {c}_lo, quantile_cont({c}, 0.98) AS {c}_hi" for c in NAMES) + " FROM layers")),
    "scores": ("layers bounds", "SELECT cell_id, " + ", ".join(_score(c.name, f"{c.name}_lo", f"{c.name}_hi", c.higher_is_riskier) for c in CRITERIA) + " FROM layers, bounds"),
    "risk": ("scores", f"SELECT *, round({' + '.join(f'{w} * {n}' for n, w in WEIGHTS.items())}, 9) + 0.0 AS risk FROM scores"),
    "rbreaks": ("risk", "SELECT " + ", ".join(f"round(quantile_cont(risk, {q}), 9) AS b{i}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8, 1.0), 1)) + " FROM risk"),
    "classes": ("risk rbreaks", """SELECT risk.*, CASE WHEN risk IS NULL THEN 0 WHEN risk <= b1 THEN 1 WHEN risk <= b2 THEN 2
        WHEN risk <= b3 THEN 3 WHEN risk <= b4 THEN 4 ELSE 5 END AS class FROM risk, rbreaks"""),
    "anomalies": ("impact", """SELECT a.cell_id, a."year", round(any_value(a.v) - avg(b.v), 9) + 0.0 AS anomaly, stddev_samp(b.v) AS std
        FROM impact a LEFT JOIN impact b ON a.cell_id = b.cell_id AND a."year" <> b."year" GROUP BY a.cell_id, a."year" """),
    "joined": ("anomalies classes cells", """SELECT a.cell_id, a."year", a.anomaly, k.risk, k.class, c."row", c.col, c.elev, c.lc AS code
        FROM anomalies a JOIN classes k USING (cell_id) JOIN cells c USING (cell_id)"""),
    "labels": ("basin", """SELECT "year", severity, coalesce(severity <= 0.0, false) AS is_dry FROM (
        SELECT "year", round((m - avg(m) OVER ()) / stddev_samp(m) OVER (), 9) + 0.0 AS severity FROM (
        SELECT CAST(year("month") AS INT) AS "year", avg(soil) AS m FROM basin WHERE month("month") IN (3, 4) GROUP BY 1))"""),
    "ranked": ("joined", """SELECT *, rank() OVER (PARTITION BY "year" ORDER BY risk) + (count(*) OVER (PARTITION BY "year", risk) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY "year" ORDER BY anomaly) + (count(*) OVER (PARTITION BY "year", anomaly) - 1) / 2.0 AS ry
        FROM joined WHERE risk IS NOT NULL AND anomaly IS NOT NULL"""),
    "yearly": ("joined ranked labels", """SELECT m."year", severity, coalesce(is_dry, false) AS is_dry, mean_anomaly, cells, rho, monotone FROM
        (SELECT "year", avg(anomaly) AS mean_anomaly, count(anomaly) AS cells FROM joined WHERE anomaly IS NOT NULL GROUP BY 1) m
        LEFT JOIN (SELECT "year", CASE WHEN count(*) >= 100 THEN corr(rx, ry) END AS rho FROM ranked GROUP BY 1) r USING ("year")
        LEFT JOIN (SELECT "year", bool_and(ok) AS monotone FROM (SELECT "year", coalesce(lag(round(mean, 12)) OVER (PARTITION BY "year" ORDER BY class) >= round(mean, 12), true) AS ok
          FROM (SELECT "year", class, avg(anomaly) AS mean FROM joined WHERE class > 0 AND anomaly IS NOT NULL GROUP BY 1, 2)) GROUP BY 1) q USING ("year")
        LEFT JOIN labels USING ("year")"""),
}


def sql(names: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` behind the named CTEs, everything they build on, and ``extra`` CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in CTES[name][0].split():
            visit(needed)
        ordered.append(name)

    for name in names.split():
        visit(name)
    if not ordered and not extra:
        return body
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered] + ([extra] if extra else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body


# --- registry ---------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, where SQL can state it, its oracle."""

    def register(builder: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return builder(views(spark, sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise KeyError(f"{name} is registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return builder

    return register
