"""Named queries over the driver's tables, and their SQL.

Most compare two halves of lineitem, the orders with even and with odd keys, as a real and a synthetic table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning
from ..operators import acceptance, bayesnet, faithfulness, filters, mechanisms, metrics, models, postprocess, privacy, profile, schema, transforms
from ..sources import tables
from ..sources.tables import table
from . import birth, evaluate, report, selection

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

COLUMNS = ["flag", "line", "disc", "stat"]
NUMBERS = ["line", "disc", "qty", "price"]
QTY_EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, float("inf")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _BASE + sql if "items" in sql else sql
        return f

    return add


#: The projection of lineitem that queries use; half is real for even order keys.
_BASE = """
WITH items AS (
  SELECT l_orderkey, l_returnflag AS flag, l_linenumber::INT AS line, round(l_discount * 100)::INT AS disc, (l_linestatus = 'F')::INT AS stat,
         l_quantity AS qty, l_extendedprice AS price, CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'synth' END AS half,
         CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END AS qbin
  FROM lineitem)
"""


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linenumber").cast("int").alias("line"), F.round(F.col("l_discount") * 100).cast("int").alias("disc"), (F.col("l_linestatus") == "F").cast("int").alias("stat"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))


def halves(spark: SparkSession, d: str, columns=None) -> tuple[DataFrame, DataFrame]:
    df = items(spark, d)
    pick = lambda k: df.filter(F.col("l_orderkey") % 2 == k).select(*(columns or df.columns))
    return pick(0), pick(1)


def numbers(spark, d, columns=NUMBERS) -> tuple[DataFrame, DataFrame]:
    return tuple(h.select(*(F.col(c).cast("double").alias(c) for c in columns)) for h in halves(spark, d))


def one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def r6(c):
    return F.round(c, 6)


SPEC = schema.TableSpec({"line": schema.ColumnSpec("int", 1, 6), "disc": schema.ColumnSpec("int", 1, 9), "qty": schema.ColumnSpec("double", 1, 45), "price": schema.ColumnSpec("double", 1000, 90000)})


# --- validation and filters ---------------------------------------------------------------------------------------
@query("SELECT count(*) FILTER (NOT line BETWEEN 1 AND 6) AS bad_line, count(*) FILTER (NOT disc BETWEEN 1 AND 9) AS bad_disc, count(*) FILTER (NOT qty BETWEEN 1 AND 45) AS bad_qty, count(*) FILTER (NOT price BETWEEN 1000 AND 90000) AS bad_price FROM items")
def validate_ranges(spark, d):
    return schema.violations(items(spark, d), SPEC)


@query("""SELECT l_orderkey, line, array_to_string(list_filter([CASE WHEN NOT line BETWEEN 1 AND 6 THEN 'line' END, CASE WHEN NOT disc BETWEEN 1 AND 9 THEN 'disc' END, CASE WHEN NOT qty BETWEEN 1 AND 45 THEN 'qty' END, CASE WHEN NOT price BETWEEN 1000 AND 90000 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS failed
FROM items WHERE NOT (line BETWEEN 1 AND 6 AND disc BETWEEN 1 AND 9 AND qty BETWEEN 1 AND 45 AND price BETWEEN 1000 AND 90000)""")
def reject_rows(spark, d):
    return schema.rejects(items(spark, d), SPEC).select("l_orderkey", "line", F.concat_ws(",", "failed").alias("failed"))


@query("SELECT count(*) FILTER (o_orderkey IS NULL) AS o_orderkey, count(*) FILTER (o_totalprice IS NULL OR isnan(o_totalprice)) AS o_totalprice, count(*) FILTER (o_orderdate IS NULL) AS o_orderdate FROM orders")
def null_counts(spark, d):
    return schema.null_counts(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"))


@query("SELECT p_partkey, p_name FROM part WHERE (contains(p_name, 'a') OR contains(p_name, 'e')) AND p_brand LIKE 'Brand#%' AND regexp_matches(p_type, '[A-Z]+') AND p_size IN (1, 5, 10, 15)")
def text_selection(spark, d):
    df = filters.matching(table(spark, d, "part"), "p_name", contains=["a", "e"])
    df = filters.matching(filters.matching(df, "p_brand", starts="Brand#"), "p_type", pattern="[A-Z]+")
    return filters.matching(df, "p_size", among=[1, 5, 10, 15]).select("p_partkey", "p_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def single_row(spark, d):
    r = filters.single_row(table(spark, d, "nation"), "n_nationkey = 7")
    return spark.createDataFrame([(r.n_nationkey, r.n_name)], "n_nationkey int, n_name string")


@query("SELECT NOT (qbin <= 1 AND price > 20000) AS kept, count(*) AS n, round(sum(qty), 6) AS qty FROM items GROUP BY 1")
def constraint_split(spark, d):
    """Quantity bins wholly below 20 do not go with prices wholly above 20,000."""
    df = items(spark, d)
    q, p = binning.interval_of(binning.cut(F.col("qty"), QTY_EDGES), QTY_EDGES), F.struct(F.col("price").alias("lo"), F.col("price").alias("hi"))
    kept, lost = postprocess.reject(df.withColumns({"q": q, "p": p}), [filters.not_both("q", 20, "p", 20000)])
    tally = lambda x, k: x.agg(F.lit(k).alias("kept"), F.count(F.lit(1)).alias("n"), r6(F.sum("qty")).alias("qty"))
    return tally(kept, True).union(tally(lost, False)).filter("n > 0")


@query("SELECT l_orderkey, line, disc, qty FROM items QUALIFY count(*) OVER (PARTITION BY line, disc, qty, price) > 1")
def duplicated_rows(spark, d):
    return filters.duplicated(items(spark, d), ["line", "disc", "qty", "price"]).select("l_orderkey", "line", "disc", "qty")


@query("SELECT l_orderkey, line FROM items QUALIFY count(*) OVER (PARTITION BY line, disc, qty, stat) = 1")
def unique_rows(spark, d):
    return filters.duplicated(items(spark, d), ["line", "disc", "qty", "stat"], unique=True).select("l_orderkey", "line")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders")
def row_ids(spark, d):
    return filters.with_row_id(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def first_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(100)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replaced_rows(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return filters.replace_rows(df, "o_orderstatus = 'F'", df.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("done").alias("o_orderstatus")))


@query("SELECT l_linenumber::INT AS l_linenumber, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem")
def pattern_columns(spark, d):
    df = filters.columns_like(table(spark, d, "lineitem"), "^l_(?!.*key)(line|ship)")
    return df.select(F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))


# --- transforms ---------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, line, greatest(5, least(40, qty)) AS qty FROM items")
def clip(spark, d):
    return items(spark, d).select("l_orderkey", "line", binning.clip(F.col("qty"), 5.0, 40.0).alias("qty"))


@query("SELECT l_orderkey, line, round_even(qty / 4, 0)::BIGINT AS code, round_even(qty / 4, 0)::BIGINT * 4 AS back FROM items")
def resolution_half_even(spark, d):
    code = binning.half_even(F.col("qty") / 4)
    return items(spark, d).select("l_orderkey", "line", code.alias("code"), (code * 4).alias("back"))


@query("SELECT l_orderkey, line, qbin FROM items")
def binning_codes(spark, d):
    return items(spark, d).select("l_orderkey", "line", binning.cut(F.col("qty"), QTY_EDGES).alias("qbin"))


@query("SELECT l_orderkey, line, len(list_filter([1000.0, 5000.0, 20000.0, 50000.0], lambda e: e <= price))::INT AS digit FROM items")
def digitize(spark, d):
    return items(spark, d).select("l_orderkey", "line", binning.digitize(F.col("price"), [1000, 5000, 20000, 50000]).alias("digit"))


@query('SELECT l_orderkey, line, (qbin = 0)::BIGINT AS "qty#0", (qbin = 1)::BIGINT AS "qty#1", (qbin = 2)::BIGINT AS "qty#2", (qbin = 3)::BIGINT AS "qty#3", (qbin = 4)::BIGINT AS "qty#4" FROM items')
def one_hot(spark, d):
    df = items(spark, d).select("qty", F.col("l_orderkey").cast("double").alias("l_orderkey"), "line")
    steps = {"qty": [{"name": "binning", "bins": QTY_EDGES}, {"name": "one_hot"}], "l_orderkey": [{"name": "clipping", "lower": 0, "upper": 10**12}], "line": [{"name": "clipping", "lower": 1, "upper": 7}]}
    return transforms.forward(df, steps, ["qty"]).df.withColumn("l_orderkey", F.col("l_orderkey").cast("long"))


@query("SELECT l_orderkey, line, CASE qbin WHEN 0 THEN 5.0 WHEN 1 THEN 15.0 WHEN 2 THEN 25.0 WHEN 3 THEN 35.0 ELSE 40.0 END::DOUBLE AS mid FROM items")
def rev_binning_mid(spark, d):
    df = items(spark, d).select("l_orderkey", "line", binning.interval_of(binning.cut(F.col("qty"), QTY_EDGES), QTY_EDGES).alias("q"))
    return df.select("l_orderkey", "line", binning.interval_to_number(F.col("q")).alias("mid"))


@query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice, dayofyear(o_orderdate)::DOUBLE AS o_orderdate FROM orders")
def numerify(spark, d):
    return binning.numerify(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"))


@query("SELECT o_orderkey, (dayofyear(o_orderdate) - 1)::INT AS day, strftime(o_orderdate, '%U')::INT AS week, (month(o_orderdate) - 1)::INT AS month FROM orders")
def date_codes(spark, d):
    c = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", *(transforms.date_code(c, r).cast("int").alias(n) for n, r in (("day", "dayofyear"), ("week", "week"), ("month", "month"))))


@query("""SELECT o_orderkey, (DATE '2021-01-01' + (dayofyear(o_orderdate) - 1)::INT)::DATE::VARCHAR AS day, make_date(2021, month(o_orderdate)::INT, 15)::VARCHAR AS month,
(CASE WHEN strftime(o_orderdate, '%U')::INT = 0 THEN DATE '2021-01-01' - 2 ELSE DATE '2021-01-03' + (strftime(o_orderdate, '%U')::INT - 1) * 7 + 3 END)::DATE::VARCHAR AS week
FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE dayofyear(o_orderdate) <= 365)""")
def rev_date(spark, d):
    """Codes of any year, undone in 2021."""
    c = F.col("o_orderdate").cast("date")
    back = lambda r: transforms.code_date(transforms.date_code(c, r), r, 2021).cast("string")
    return table(spark, d, "orders").filter(F.dayofyear("o_orderdate") <= 365).select("o_orderkey", back("dayofyear").alias("day"), back("month").alias("month"), back("week").alias("week"))


@query("SELECT qbin, disc, count(*) AS n FROM items GROUP BY ALL")
def round_trip(spark, d):
    """Codes of a forward pass, from what the backward pass gives."""
    df = items(spark, d).select("qty", F.col("disc").cast("double").alias("disc"))
    steps = {"qty": [{"name": "binning", "bins": QTY_EDGES}], "disc": [{"name": "clipping", "lower": 0, "upper": 10}, {"name": "resolution", "scale": 1}]}
    coded = transforms.forward(df, steps, ["qty"])
    back = transforms.backward(coded.df, coded.back)
    code = binning.cut(F.col("qty")["lo"], QTY_EDGES)
    return back.groupBy(code.alias("qbin"), F.col("disc").cast("int").alias("disc")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, line * 100.0::DOUBLE AS line, price / 100 AS price, len(list_filter([0.0, 10.0, 20.0, 30.0, 40.0], lambda e: e <= qty))::DOUBLE AS qty FROM items")
def scaled_columns(spark, d):
    df = items(spark, d).select("line", "price", "qty", "l_orderkey")
    out = binning.scale_by_weights(df, {"line": 100, "price": 0.01, "qty": QTY_EDGES})
    return out.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), "line", r6("price").alias("price"), "qty")


ORACLES["scaled_columns"] = ORACLES["scaled_columns"].replace("price / 100 AS price", "round(price * 0.01, 6) AS price")


# --- histograms and joins -----------------------------------------------------------------------------------------
@query("SELECT flag, line, count(*) AS n FROM items GROUP BY ALL")
def hist_2way(spark, d):
    return profile.histogram(items(spark, d), ["flag", "line"])


@query("SELECT grouping_id(items.flag, items.line, items.disc, items.stat) AS subset, coalesce(items.flag, '*') AS flag, coalesce(items.line::VARCHAR, '*') AS line, coalesce(items.disc::VARCHAR, '*') AS disc, coalesce(items.stat::VARCHAR, '*') AS stat, count(*) FILTER (half = 'real') AS real, count(*) FILTER (half = 'synth') AS synth FROM items GROUP BY CUBE (items.flag, items.line, items.disc, items.stat) HAVING grouping_id(items.flag, items.line, items.disc, items.stat) <> 15")
def cube_frequencies(spark, d):
    x, y = halves(spark, d, COLUMNS)
    cells = profile.subset_cells({"real": x, "synth": y}, COLUMNS)
    return cells.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in COLUMNS})


_CELLS = """, sizes AS (SELECT count(*) FILTER (half = 'real')::DOUBLE AS nr, count(*) FILTER (half = 'synth')::DOUBLE AS ns FROM items),
cells AS (SELECT grouping_id(flag, line, disc, stat) AS subset, flag, line, disc, stat, count(*) FILTER (half = 'real') AS r, count(*) FILTER (half = 'synth') AS s FROM items GROUP BY CUBE (flag, line, disc, stat) HAVING grouping_id(flag, line, disc, stat) <> 15),
vals AS (SELECT subset, CASE WHEN r > 0 AND s > 0 THEN abs(r / nr - s / ns) ELSE 0 END AS diff, greatest((r + 1) / (s + 1), (s + 1) / (r + 1)) AS ratio FROM cells, sizes),
wide AS (SELECT subset, (4 - bit_count(subset::INT))::INT AS ways, max(diff) AS d1, min(diff) AS d2, avg(diff) AS d3, sqrt(avg(diff * diff)) AS d4, max(ratio) AS r1, min(ratio) AS r2, avg(ratio) AS r3, sqrt(avg(ratio * ratio)) AS r4 FROM vals GROUP BY ALL),
long AS (SELECT subset, ways, unnest(['diff/max', 'diff/min', 'diff/mean', 'diff/rmse', 'ratio/max', 'ratio/min', 'ratio/mean', 'ratio/rmse']) AS name, unnest([d1, d2, d3, d4, r1, r2, r3, r4]) AS val FROM wide)
"""


@query(_CELLS + """SELECT array_to_string(list_filter([CASE WHEN subset & 8 = 0 THEN 'flag' END, CASE WHEN subset & 4 = 0 THEN 'line' END, CASE WHEN subset & 2 = 0 THEN 'disc' END, CASE WHEN subset & 1 = 0 THEN 'stat' END], lambda x: x IS NOT NULL), ',') AS targets,
'frequencies/' || name AS name, round(val, 6) AS val FROM long""")
def freq_metrics(spark, d):
    return _frequencies(spark, d).select(F.concat_ws(",", "targets").alias("targets"), "name", r6("val").alias("val"))


def _frequencies(spark, d) -> DataFrame:
    x, y = halves(spark, d, COLUMNS)
    sizes = {"real": x.count(), "synth": y.count()}
    return profile.subset_frequencies({"real": x, "synth": y}, COLUMNS, {"val_r_s": ("real", "synth")}, sizes)


@query(_CELLS + """, sized AS (SELECT ways::VARCHAR AS w, * FROM long UNION ALL SELECT '1234', * FROM long)
SELECT w || 'way/' || split_part(name, '/', 2) || '/frequencies/' || split_part(name, '/', 1) || '/raw' AS name,
round(CASE split_part(name, '/', 2) WHEN 'max' THEN max(val) WHEN 'min' THEN min(val) WHEN 'mean' THEN avg(val) ELSE sqrt(avg(val * val)) END, 6) AS val FROM sized GROUP BY w, name""")
def nway_rollup(spark, d):
    rows = _frequencies(spark, d).withColumn("binning", F.lit(False))
    return profile.roll_up(rows, len(COLUMNS)).select("name", r6("val").alias("val"))


@query("SELECT line, disc, count(*) FILTER (half = 'real') AS nx, count(*) FILTER (half = 'synth') AS ny FROM items GROUP BY ALL")
def paired_histogram(spark, d):
    return profile.paired_histogram(*halves(spark, d), ["line", "disc"])


@query("SELECT flag, stat, count(*) FILTER (half = 'real') AS a, count(*) FILTER (half = 'synth') AS b, count(*) AS c FROM items GROUP BY ALL")
def side_by_side(spark, d):
    x, y = halves(spark, d)
    return profile.n_histograms({"a": x, "b": y, "c": items(spark, d)}, ["flag", "stat"])


@query("SELECT line, disc, round(avg(qty) FILTER (half = 'real'), 6) AS a, round(avg(qty) FILTER (half = 'synth'), 6) AS b FROM items GROUP BY ALL")
def merged_comparisons(spark, d):
    means = [h.groupBy("line", "disc").agg(r6(F.avg("qty")).alias("val")) for h in halves(spark, d)]
    return profile.merge_comparisons(dict(zip("ab", means)), ["line", "disc"])


@query("SELECT l_orderkey, i.line, exists(SELECT 1 FROM items s WHERE s.half = 'synth' AND s.line = i.line AND s.qty = i.qty AND s.disc = i.disc AND s.flag = i.flag) AS matched FROM items i WHERE half = 'real'")
def match_flag(spark, d):
    x, y = halves(spark, d)
    return profile.with_match_flag(x, y, ["line", "qty", "disc", "flag"]).select("l_orderkey", "line", "matched")


_SEMI = "SELECT l_orderkey, line, qty FROM items i WHERE half = 'synth' AND {}EXISTS (SELECT 1 FROM items r WHERE r.half = 'real' AND r.line = i.line AND r.qty = i.qty AND r.disc = i.disc AND r.flag = i.flag)"


@query(_SEMI.format(""))
def plausible_semi(spark, d):
    return privacy.plausible(*halves(spark, d), ["line", "qty", "disc", "flag"]).select("l_orderkey", "line", "qty")


@query(_SEMI.format("NOT "))
def implausible_anti(spark, d):
    return privacy.plausible(*halves(spark, d), ["line", "qty", "disc", "flag"], True).select("l_orderkey", "line", "qty")


@query("SELECT line, disc, count(i.line) AS n FROM (SELECT * FROM (SELECT unnest(range(8))::BIGINT AS line), (SELECT unnest(range(11))::BIGINT AS disc)) g LEFT JOIN items i USING (line, disc) GROUP BY line, disc")
def marginal_zero_filled(spark, d):
    return profile.domain_counts(items(spark, d).select("line", "disc"), {"line": 8, "disc": 11})


@query("SELECT set_name, count(*) AS n FROM (SELECT CASE WHEN bool_or(half = 'real') AND bool_or(half = 'synth') THEN 'both' WHEN bool_or(half = 'real') THEN 'only_a' ELSE 'only_b' END AS set_name FROM items GROUP BY price) GROUP BY 1 UNION ALL SELECT 'union', count(DISTINCT price) FROM items")
def id_sets(spark, d):
    sets = profile.id_sets(*halves(spark, d), "price")
    parts = [s.agg(F.lit(k).alias("set_name"), F.count(F.lit(1)).alias("n")) for k, s in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.filter("n > 0")


# --- aggregates ---------------------------------------------------------------------------------------------------
@query("SELECT least_n FROM (SELECT min(n) AS least_n FROM (SELECT 'flag' AS c, flag::VARCHAR AS v, count(*) AS n FROM items GROUP BY ALL UNION ALL SELECT 'line', line::VARCHAR, count(*) FROM items GROUP BY ALL UNION ALL SELECT 'disc', disc::VARCHAR, count(*) FROM items GROUP BY ALL))")
def min_marginal(spark, d):
    return spark.createDataFrame([(profile.min_marginal(items(spark, d).select("flag", "line", "disc")),)], "least_n long")


@query("SELECT flag, stat, round(count(*) / sum(count(*)) OVER (PARTITION BY stat), 6) AS value FROM items GROUP BY flag, stat")
def contingency(spark, d):
    return profile.contingency(items(spark, d), "flag", "stat", "columns").select("flag", "stat", r6("value").alias("value"))


@query("SELECT flag, count(qty) AS qty_count, count(DISTINCT qty) AS qty_nunique, round(avg(qty), 6) AS qty_mean, round(stddev_samp(qty), 6) AS qty_std, min(qty) AS qty_min, quantile_cont(qty, 0.25) AS qty_q1, median(qty) AS qty_median, quantile_cont(qty, 0.75) AS qty_q3, max(qty) AS qty_max FROM items GROUP BY flag")
def described(spark, d):
    out = profile.describe(items(spark, d).select("flag", "qty"), ["flag"])
    return out.withColumns({"qty_mean": r6("qty_mean"), "qty_std": r6("qty_std")})


@query("SELECT flag, round(avg((qty > 25)::INT), 6) AS big, round(avg((disc = 0)::INT), 6) AS full_price, count(*) AS size FROM items GROUP BY flag")
def pass_rates(spark, d):
    df = items(spark, d).withColumns({"big": F.col("qty") > 25, "full_price": F.col("disc") == 0})
    return profile.pass_rates(df, ["big", "full_price"], ["flag"]).withColumns({"big": r6("big"), "full_price": r6("full_price")})


@query("SELECT l_orderkey, array_to_string(list_sort(list(disc)), ',') AS \"values\", count(disc) AS size, count(DISTINCT disc) AS nunique FROM items GROUP BY l_orderkey")
def group_lists(spark, d):
    return profile.group_lists(items(spark, d), ["l_orderkey"], "disc").withColumn("values", F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))))


@query("SELECT flag, count(*) AS n, round(count(*) / (SELECT count(*) FROM items), 6) AS share FROM items GROUP BY flag")
def normalised_counts(spark, d):
    return profile.normalised_counts(items(spark, d), ["flag"]).withColumn("share", r6("share"))


@query("SELECT a, b, round(avg((va AND vb)::INT), 6) AS share FROM (SELECT unnest(['big', 'cheap', 'open']) AS a, unnest([qty > 25, price < 20000, stat = 0]) AS va, qty, price, stat FROM items), LATERAL (SELECT unnest(['big', 'cheap', 'open']) AS b, unnest([qty > 25, price < 20000, stat = 0]) AS vb) GROUP BY ALL")
def co_occurrence(spark, d):
    df = items(spark, d).select((F.col("qty") > 25).alias("big"), (F.col("price") < 20000).alias("cheap"), (F.col("stat") == 0).alias("open"))
    return profile.co_occurrence(df, ["big", "cheap", "open"]).withColumn("share", r6("share"))


@query("SELECT qty AS value, count(*) AS n, round(sum(count(*)) OVER (ORDER BY qty) / sum(count(*)) OVER (), 6) AS share FROM items GROUP BY qty")
def ecdf(spark, d):
    return profile.ecdf(items(spark, d), "qty").withColumn("share", r6("share"))


@query("SELECT big, cheap, open, count(*) AS n FROM (SELECT qty > 25 AS big, price < 20000 AS cheap, stat = 0 AS open FROM items) GROUP BY ALL")
def venn(spark, d):
    df = items(spark, d).select((F.col("qty") > 25).alias("big"), (F.col("price") < 20000).alias("cheap"), (F.col("stat") == 0).alias("open"))
    return profile.venn(df, ["big", "cheap", "open"])


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS round FROM orders")
def interleaved(spark, d):
    return profile.interleave(table(spark, d, "orders"), "o_orderstatus", "o_orderkey").select("o_orderkey", F.col("round").cast("long").alias("round"))


@query("SELECT flag, round(avg(qty) FILTER (stat = 0), 6) AS open, round(avg(qty) FILTER (stat = 1), 6) AS done FROM items GROUP BY flag")
def pivoted(spark, d):
    means = items(spark, d).groupBy("flag", F.when(F.col("stat") == 1, "done").otherwise("open").alias("s")).agg(r6(F.avg("qty")).alias("v"))
    return profile.to_wide(means, ["flag"], "s", "v", ["open", "done"])


@query("SELECT l_orderkey, line, unnest(['qty', 'price']) AS variable, unnest([qty, price]) AS value FROM items")
def unpivoted(spark, d):
    return profile.to_long(items(spark, d).select("l_orderkey", "line", "qty", "price"), ["l_orderkey", "line"])


@query("SELECT l_orderkey, line FROM items, LATERAL (SELECT unnest(range(line)))")
def replicated(spark, d):
    return profile.replicated(items(spark, d).select("l_orderkey", "line"), F.col("line"))


@query("SELECT half AS name, count(*) AS n, round(avg(price), 6) AS price FROM items GROUP BY half")
def tagged_union(spark, d):
    x, y = halves(spark, d)
    return profile.tagged({"real": x, "synth": y}).groupBy("name").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("price")).alias("price"))


# --- utility metrics ----------------------------------------------------------------------------------------------
_STATS = {"mean": "avg({0})", "median": "median({0})", "max": "max({0})", "min": "min({0})", "q1": "quantile_cont({0}, 0.25)", "q3": "quantile_cont({0}, 0.75)"}


def _one_way_sql() -> str:
    rows = []
    for c in NUMBERS:
        for n, f in _STATS.items():
            e = f.format(f"{c}::DOUBLE")
            rows.append(f"SELECT '{n}' AS metric, '{c}' AS target, round(abs({e} FILTER (half = 'real') - {e} FILTER (half = 'synth')), 6) AS val FROM items")
        s = f"stddev_pop({c}::DOUBLE)"
        rows.append(f"SELECT 'std', '{c}', round({s} FILTER (half = 'real') / {s} FILTER (half = 'synth'), 6) FROM items")
        rows.append(f"SELECT 'nan', '{c}', 0.0::DOUBLE")
    return " UNION ALL ".join(rows)


@query(_one_way_sql())
def oneway_metrics(spark, d):
    x, y = numbers(spark, d)
    row, out = metrics.summary_row(x, y), []
    for c in NUMBERS:
        for n in ("nan", *_STATS, "std"):
            a, b = row[f"{n}|x|{c}"], row[f"{n}|y|{c}"]
            out.append((n, c, round(metrics.ratio_or_inf(a, b) if n == "std" else float(abs(a - b)), 6)))
    return spark.createDataFrame(out, "metric string, target string, val double")


_CDF = """, n AS (SELECT count(*) FILTER (half = 'real')::DOUBLE AS nr, count(*) FILTER (half = 'synth')::DOUBLE AS ns FROM items),
gaps AS (SELECT v, abs(sum(r) OVER (ORDER BY v) / nr - sum(s) OVER (ORDER BY v) / ns) AS gap, lead(v) OVER (ORDER BY v) - v AS width FROM (SELECT {0} AS v, count(*) FILTER (half = 'real') AS r, count(*) FILTER (half = 'synth') AS s FROM items GROUP BY 1), n)
"""


@query(_CDF.format("price") + "SELECT round(max(gap), 6) AS d FROM gaps")
def ks_statistic(spark, d):
    x, y = numbers(spark, d)
    cells = metrics.value_cells(x, y, "price")
    return metrics.cdf_gaps(cells, x.count(), y.count()).agg(r6(F.max("gap")).alias("d"))


@query(_CDF.format("trunc(price)") + "SELECT round(sum(gap * width) * any_value(nr), 4) AS w FROM gaps, n")
def wasserstein(spark, d):
    return one(spark, w=round(metrics.distances(*numbers(spark, d), ["price"])["price"][2], 4))


@query(""", c AS (SELECT qbin, count(*) FILTER (half = 'real')::DOUBLE AS r, count(*) FILTER (half = 'synth')::DOUBLE AS s FROM items GROUP BY qbin), t AS (SELECT sum(r) AS tr, sum(s) AS ts, count(*) AS k FROM c)
SELECT round(sum((r - (r + s) * tr / (tr + ts))^2 / ((r + s) * tr / (tr + ts)) + (s - (r + s) * ts / (tr + ts))^2 / ((r + s) * ts / (tr + ts))), 6) AS stat, any_value(k) - 1 AS dof FROM c, t""")
def chi2_statistic(spark, d):
    coded = [x.select(binning.cut(F.col("qty"), QTY_EDGES).alias("value")) for x in halves(spark, d)]
    return metrics.chi2_statistic(profile.paired_histogram(*coded)).select(r6("stat").alias("stat"), "dof")


@query(""", c AS (SELECT stat AS v, count(*) FILTER (half = 'real')::DOUBLE AS r, count(*) FILTER (half = 'synth')::DOUBLE AS s FROM items GROUP BY stat), t AS (SELECT sum(r) AS tr, sum(s) AS ts FROM c),
e AS (SELECT r, s, (r + s) * tr / (tr + ts) AS er, (r + s) * ts / (tr + ts) AS es FROM c, t)
SELECT round(sum(greatest(0, abs(r - er) - 0.5)^2 / er + greatest(0, abs(s - es) - 0.5)^2 / es), 6) AS stat, 1::BIGINT AS dof FROM e""")
def chi2_yates(spark, d):
    coded = [x.select(F.col("stat").alias("value")) for x in halves(spark, d)]
    return metrics.chi2_statistic(profile.paired_histogram(*coded)).select(r6("stat").alias("stat"), "dof")


def _two_way_sql(f: str) -> str:
    return f"SELECT round(max(coalesce(abs(a - b), 0)), 6) AS val FROM (SELECT qbin, {f}(price) FILTER (half = 'real') AS a, {f}(price) FILTER (half = 'synth') AS b FROM items GROUP BY qbin)"


@query(_two_way_sql("avg"))
def twoway_mean(spark, d):
    return one(spark, val=round(metrics.two_way(metrics.by_groups(*numbers(spark, d), "price", "qty", QTY_EDGES), "mean"), 6))


@query(_two_way_sql("median"))
def twoway_median(spark, d):
    return one(spark, val=round(metrics.two_way(metrics.by_groups(*numbers(spark, d), "price", "qty", QTY_EDGES), "median"), 6))


@query(""", t AS (SELECT ceil(count(*) FILTER (half = 'synth') * 0.01) + 1 AS margin FROM items)
SELECT qbin AS g, greatest(count(*) FILTER (half = 'synth') - any_value(margin), 1)::BIGINT AS size, round(avg(price) FILTER (half = 'synth'), 6) AS mean_y FROM items, t GROUP BY qbin""")
def resized_size(spark, d):
    return metrics.resized(*numbers(spark, d), "price", "qty", QTY_EDGES, 3000.0).select("g", F.col("size").cast("long").alias("size"), r6("mean_y").alias("mean_y"))


def _pairs_sql(f: str, source: str = "items") -> str:
    pairs = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({f.format(a=a, b=b)}, 6) AS val FROM {source}" for a, b in pairs)


def _correlations(spark, d, method, columns=NUMBERS):
    df = items(spark, d).select(*(F.col(c).cast("double").alias(c) for c in columns))
    return spark.createDataFrame([(a, b, round(v, 6)) for (a, b), v in metrics.correlations(df, method).items()], "a string, b string, val double")


@query(_pairs_sql("corr({a}, {b})"))
def corr_pearson(spark, d):
    return _correlations(spark, d, "pearson")


@query(", ranks AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in NUMBERS) + " FROM items) " + _pairs_sql("corr({a}, {b})", "ranks"))
def corr_spearman(spark, d):
    return _correlations(spark, d, "spearman")


@query(""", cells AS (SELECT line AS a, disc AS b, count(*)::DOUBLE AS n FROM items GROUP BY ALL), s AS (SELECT sum(x.n * y.n * sign(x.a - y.a) * sign(x.b - y.b)) / 2 AS net FROM cells x, cells y),
ta AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM cells GROUP BY a)), tb AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM cells GROUP BY b)), n0 AS (SELECT sum(n) * (sum(n) - 1) / 2 AS t FROM cells)
SELECT 'line' AS a, 'disc' AS b, round(net / sqrt((n0.t - ta.t) * (n0.t - tb.t)), 6) AS val FROM s, ta, tb, n0""")
def corr_kendall(spark, d):
    return _correlations(spark, d, "kendall", ["line", "disc"])


@query("SELECT count(*)::DOUBLE AS n, sum(qty) AS x, round(sum(price), 2) AS y, sum(qty * qty) AS xx, round(sum(qty * price), 2) AS xy FROM items")
def ols_sufficient(spark, d):
    s, n = metrics.moments(items(spark, d).select("qty", "price"))
    return one(spark, n=float(n), x=float(s[0, 1]), y=round(float(s[0, 2]), 2), xx=float(s[1, 1]), xy=round(float(s[1, 2]), 2))


@query("SELECT round(abs(regr_slope(price, qty) FILTER (half = 'real') - regr_slope(price, qty) FILTER (half = 'synth')) * stddev_pop(qty) FILTER (half = 'synth'), 4) AS qty, round(abs(regr_r2(price, qty) FILTER (half = 'real') - regr_r2(price, qty) FILTER (half = 'synth')), 6) AS r2 FROM items")
def ols_coef_1x(spark, d):
    got = metrics.linear_regression(*numbers(spark, d, ["qty", "price"]))
    return one(spark, qty=round(got["coef/error/diff/qty"], 4), r2=round(got["R2/diff"], 6))


@query(""", m AS (SELECT regr_slope(price, qty) FILTER (half = 'real') AS br, regr_intercept(price, qty) FILTER (half = 'real') AS ar, regr_slope(price, qty) FILTER (half = 'synth') AS bs, regr_intercept(price, qty) FILTER (half = 'synth') AS a_s FROM items),
e AS (SELECT half, abs(price - ar - br * qty) AS er, abs(price - a_s - bs * qty) AS es FROM items, m)
SELECT round(abs(avg(er) FILTER (half = 'real') - avg(es) FILTER (half = 'real')), 4) AS cross_1_by_2, round(abs(avg(es) FILTER (half = 'synth') - avg(er) FILTER (half = 'synth')), 4) AS cross_2_by_1, round(abs(avg(er) FILTER (half = 'real') - avg(es) FILTER (half = 'synth')), 4) AS mae FROM e""")
def lr_cross_mae(spark, d):
    got = metrics.linear_regression(*numbers(spark, d, ["qty", "price"]))
    return one(spark, cross_1_by_2=round(got["MAE/cross/1-by-2"], 4), cross_2_by_1=round(got["MAE/cross/2-by-1"], 4), mae=round(got["MAE/diff"], 4))


@query()
def utility_table(spark, d):
    """The whole utility table of one comparison but for the classifier: all metrics of four columns."""
    x, y = numbers(spark, d, ["line", "disc", "stat", "qty"])
    domain = evaluate.Domain({"qty": QTY_EDGES, "line": [1, 3, 5, float("inf")], "disc": [0, 5, float("inf")], "stat": [0, 1, 2]}, {"qty": 25.0})
    analyses = [metrics.TwoWay(m, "qty", "line") for m in metrics.TWO_WAY]
    return evaluate.compare({"real": x, "synth": y}, {"val_r_s": ("real", "synth")}, domain, True, analyses)


# --- privacy ------------------------------------------------------------------------------------------------------
_FOF = "SELECT k AS param, count(c) AS value FROM (SELECT unnest(range(1, {k} + 1)) AS k) LEFT JOIN (SELECT {agg} AS c FROM items GROUP BY {keys}) ON k = c GROUP BY k"


@query(_FOF.format(k=6, agg="count(*)", keys="qbin, line, disc, flag, price"))
def face_unique(spark, d):
    df = items(spark, d).select(binning.cut(F.col("qty"), QTY_EDGES).alias("qbin"), "line", "disc", "flag", "price")
    return privacy.uniques(df, 6)


@query(_FOF.format(k=6, agg="count(*)", keys="qty, line, disc, flag"))
def k_anonymity(spark, d):
    return privacy.k_anonymity(items(spark, d), ["qty", "line", "disc", "flag"], 6)


@query(_FOF.format(k=6, agg="count(DISTINCT disc)", keys="qty, line, flag"))
def l_diversity(spark, d):
    return privacy.l_diversity(items(spark, d), ["qty", "line", "flag"], "disc", 6)


def _face_sql() -> str:
    parts = [("unique", "NULL", "NULL", _FOF.format(k=3, agg="count(*)", keys="qty, line, disc, flag")), ("k-anonymity", "'qty;line'", "NULL", _FOF.format(k=3, agg="count(*)", keys="qty, line")), ("l-diversity", "'qty;line'", "'flag'", _FOF.format(k=3, agg="count(DISTINCT flag)", keys="qty, line")), ("l-diversity", "'qty;line'", "'disc'", _FOF.format(k=3, agg="count(DISTINCT disc)", keys="qty, line"))]
    single = " UNION ALL ".join(f"SELECT param, value, '{m}' AS metric, {q}::VARCHAR AS quasi, {s}::VARCHAR AS sensitive, '{m}/' || param AS name, 'single' AS type FROM ({f})" for m, q, s, f in parts)
    return f", single AS ({single}) SELECT * FROM single UNION ALL SELECT param, max(value), metric, NULL, NULL, metric || '/' || param || '/max', 'max' FROM single GROUP BY param, metric"


@query(_face_sql())
def face_table(spark, d):
    return privacy.face_table(items(spark, d).select("qty", "line", "disc", "flag"), 3, [(("qty", "line"), "flag"), (("qty", "line"), "disc")])


_SIDES = ", h AS (SELECT qty, line, disc, count(*) FILTER (half = 'real') AS o, count(*) FILTER (half = 'synth') AS r FROM items GROUP BY ALL) "


@query(_SIDES + "SELECT count(*) FILTER (r = 1) AS unique_release, count(*) FILTER (r = 1 AND o = 1) AS replicated, round(100.0 * count(*) FILTER (r = 1 AND o = 1) / count(*) FILTER (r > 0), 6) AS pct_keys, round(100.0 * count(*) FILTER (r = 1 AND o = 1) / sum(r), 6) AS pct_rows FROM h")
def replicated_uniques(spark, d):
    x, y = halves(spark, d)
    out = privacy.replicated_uniques(x, y, ["qty", "line", "disc"])
    return out.withColumns({"pct_keys": r6("pct_keys"), "pct_rows": r6("pct_rows")})


@query(""", g AS (SELECT qty, disc, count(DISTINCT flag) FILTER (half = 'synth') AS nr, count(DISTINCT flag) FILTER (half = 'real') AS no, min(flag) FILTER (half = 'synth') AS vr, min(flag) FILTER (half = 'real') AS vo, count(*) FILTER (half = 'synth') AS size FROM items GROUP BY ALL)
SELECT count(*) FILTER (nr = 1) AS apparent, count(*) FILTER (nr = 1 AND no = 1 AND vr = vo) AS exact, coalesce(sum(size) FILTER (nr = 1 AND no = 1 AND vr = vo), 0)::BIGINT AS "rows" FROM g""")
def apparent_match(spark, d):
    return privacy.apparent_match(*halves(spark, d), ["qty", "disc"], "flag")


@query("SELECT round(sum(abs(a - b) * n) / sum(n), 6) AS weighted_diff FROM (SELECT avg(disc) FILTER (half = 'real') AS a, avg(disc) FILTER (half = 'synth') AS b, count(*) FILTER (half = 'synth') AS n FROM items GROUP BY qty, line) WHERE a IS NOT NULL AND b IS NOT NULL")
def approximate_match(spark, d):
    return privacy.approximate_match(*halves(spark, d), ["qty", "line"], "disc").select(r6("weighted_diff").alias("weighted_diff"))


@query(", c AS (SELECT n AS k, count(*) AS groups, sum(n)::BIGINT AS \"rows\" FROM (SELECT count(*) AS n FROM items GROUP BY qty, line, disc) GROUP BY n) SELECT k, groups, \"rows\", sum(groups) OVER (ORDER BY k)::BIGINT AS groups_upto, sum(\"rows\") OVER (ORDER BY k)::BIGINT AS rows_upto FROM c")
def kl_cumulative(spark, d):
    return privacy.cumulative(profile.histogram(items(spark, d), ["qty", "line", "disc"]))


@query("SELECT qty, line, disc, stat, (SELECT count(*) FROM items) AS total FROM items GROUP BY ALL HAVING count(*) > 1")
def resampled_uniques(spark, d):
    """After resampling no row is unique, no other value is lost or new, and the size is as before."""
    h = profile.histogram(privacy.resample_uniques(items(spark, d).select("qty", "line", "disc", "stat"), 1)).filter("n > 1")
    total = F.broadcast(h.agg(F.sum("n").alias("total")))
    return h.drop("n").join(total)


def _accounts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Suppliers as real rows and customers as synthetic ones: nation and balance in hundreds."""
    pick = lambda name, key, k: table(spark, d, name).select(F.col(f"{k}_{key}").alias("id"), F.col(f"{k}_nationkey").cast("double").alias("nation"), (F.col(f"{k}_acctbal") / 100).alias("bal"))
    return pick("supplier", "suppkey", "s"), pick("customer", "custkey", "c")


_ACCOUNTS = """
WITH s AS (SELECT s_suppkey AS id, s_nationkey::DOUBLE AS nation, s_acctbal / 100 AS bal FROM supplier),
c AS (SELECT c_custkey AS id, c_nationkey::DOUBLE AS nation, c_acctbal / 100 AS bal FROM customer),
inner_pairs AS (SELECT a.id AS x, b.id AS y, abs(a.nation - b.nation) + abs(a.bal - b.bal) AS d FROM s a, s b WHERE a.id <> b.id),
outer_pairs AS (SELECT a.id AS x, b.id AS y, abs(a.nation - b.nation) + abs(a.bal - b.bal) AS d FROM c a, s b)
"""


@query(_ACCOUNTS + """SELECT round((SELECT avg(m) FROM (SELECT min(d) AS m FROM outer_pairs GROUP BY x)) / (SELECT avg(m) FROM (SELECT min(d) AS m FROM inner_pairs GROUP BY x)), 6) AS ratio""")
def nearest_ratio(spark, d):
    """Mean distance of customers to suppliers by nation and balance, over that among the suppliers."""
    return one(spark, ratio=round(privacy.nearest_ratio(*_accounts(spark, d), ["nation", "bal"]), 6))


@query(_ACCOUNTS + """SELECT edge::DOUBLE AS edge, count(*) FILTER (d <= edge) AS n, round(count(*) FILTER (d <= edge) / count(*), 9) AS share
FROM outer_pairs, (VALUES (0.5), (2.0), (10.0), (40.0), (1000.0)) e(edge) GROUP BY edge""")
def distance_distribution(spark, d):
    """The distribution function of the distances of all customers to all suppliers."""
    s, c = _accounts(spark, d)
    return privacy.distance_counts(c, s, ["nation", "bal"], [0.5, 2.0, 10.0, 40.0, 1000.0]).withColumn("share", F.round("share", 9))


@query(_ACCOUNTS + """, ks AS (SELECT DISTINCT greatest(1, least(k, (SELECT count(*) FROM s) - 1)) AS k FROM generate_series(20, 50) t(k)),
inner_near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, y) AS r FROM inner_pairs) WHERE r <= 50),
outer_near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, y) AS r FROM outer_pairs) WHERE r <= 50),
radii AS (SELECT x, k, max(d) AS dk FROM inner_near, ks WHERE r <= k GROUP BY x, k),
inner_own AS (SELECT i.x, ks.k, 1 / (avg(greatest(d, dk)) + 1e-10) AS own FROM inner_near i JOIN ks ON r <= ks.k JOIN radii t ON t.x = i.y AND t.k = ks.k GROUP BY i.x, ks.k),
outer_own AS (SELECT i.x, ks.k, 1 / (avg(greatest(d, dk)) + 1e-10) AS own, avg(o.own) AS theirs FROM outer_near i JOIN ks ON r <= ks.k JOIN radii t ON t.x = i.y AND t.k = ks.k JOIN inner_own o ON o.x = i.y AND o.k = ks.k GROUP BY i.x, ks.k)
SELECT x AS id, round(max(theirs / own), 6) AS factor, round(least(1.0, 1.5 - max(theirs / own)), 6) AS score FROM outer_own GROUP BY x""")
def outlier_factors(spark, d):
    """Outlier factors of customers among suppliers, over 20 to 50 neighbours."""
    return privacy.outlier_factor(*_accounts(spark, d), ["nation", "bal"]).select("id", r6("factor").alias("factor"), r6("score").alias("score"))


# --- faithfulness -------------------------------------------------------------------------------------------------
def _parts(spark, d) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") / 50).alias("price"), (F.substring("p_brand", 7, 1).cast("double") * 100).alias("brand"))
    return p.filter("id % 2 = 0"), p.filter("id % 2 = 1")


_PARTS = "WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice / 50 AS price, substr(p_brand, 7, 1)::DOUBLE * 100 AS brand FROM part), e AS (SELECT x.id AS x_id, y.id AS y_id, abs(x.size - y.size) + abs(x.price - y.price) + abs(x.brand - y.brand) AS distance FROM p x JOIN p y ON x.id % 2 = 0 AND y.id % 2 = 1 AND x.brand = y.brand WHERE abs(x.size - y.size) + abs(x.price - y.price) + abs(x.brand - y.brand) <= 1.5)"


@query(_PARTS + " SELECT x_id, y_id, round(distance, 6) AS distance FROM e")
def radius_edges(spark, d):
    return faithfulness.radius_edges(*_parts(spark, d), ["size", "price", "brand"], 1.5).select("x_id", "y_id", binning.round_quickly(F.col("distance"), 6).alias("distance"))


@query(_PARTS + " SELECT round((SELECT count(*) FROM e) / (n * (n - 1) / 2), 9) AS density FROM (SELECT count(*) AS n FROM p WHERE id % 2 = 0)")
def radius_density(spark, d):
    cols = ["size", "price", "brand"]
    x, y = (tables.staged(faithfulness.configurations(t, cols)) for t in _parts(spark, d))
    pairs = faithfulness.radius_counts(x, y, cols, [1.5])[1.5][1]
    return one(spark, density=round(faithfulness.density(pairs, x.agg(F.sum("n")).first()[0] or 0), 9))


@query()
def matching_beta(spark, d):
    x, y = _parts(spark, d)
    cols = ["size", "price", "brand"]
    n = min(x.count(), y.count())
    x, y = (t.orderBy("id").limit(n).select(*cols) for t in (x, y))
    rows = faithfulness.evaluate(x, y, {}, [0.5, 1.0, 1.5])
    return spark.createDataFrame([(float(r["alpha"]), float(r["beta"]), float(r["density"]), r["algorithm"]) for r in rows], "alpha double, beta double, density double, algorithm string")


# --- post-processing, acceptance, release, models -----------------------------------------------------------------
@query("SELECT CASE WHEN n > 2 THEN n ELSE 0 END AS n, sum(n)::BIGINT AS rows, TRUE AS above FROM (SELECT count(*) AS n FROM items GROUP BY qty, line, disc, stat) GROUP BY 1")
def min_count_profile(spark, d):
    """After projections of orders 1 and 2 rows that occurred over twice have the counts that they had, and the others fill the
    rest of the size, each over twice."""
    x = items(spark, d).select("qty", "line", "disc", "stat")
    before, after = profile.histogram(x).withColumnRenamed("n", "n0"), profile.histogram(postprocess.project(x, {"name": "min-count", "order": 2}, 3))
    both = after.join(before, ["qty", "line", "disc", "stat"])
    return both.groupBy(F.when(F.col("n0") > 2, F.col("n")).otherwise(0).cast("long").alias("n")).agg(F.sum("n").alias("rows"), (F.min("n") > 2).alias("above"))


@query("""SELECT flag AS name, 25.5::DOUBLE AS expected, avg(qty) AS actual, avg(qty) < 25.5 AS "check" FROM items GROUP BY flag""")
def acceptance_checks(spark, d):
    values = items(spark, d).groupBy("flag").agg(F.avg("qty").alias("v"))
    out = acceptance.checks(values, F.col("flag"), F.col("v"), F.lit(25.5))
    return out.withColumn("actual", r6("actual"))


ORACLES["acceptance_checks"] = _BASE + ", c AS (SELECT flag AS name, 25.5::DOUBLE AS expected, round(avg(qty), 6) AS actual, avg(qty) < 25.5 AS \"check\" FROM items GROUP BY flag) SELECT * FROM c UNION ALL SELECT 'all', NULL, bool_and(\"check\")::INT::DOUBLE, bool_and(\"check\") FROM c"


@query("SELECT m::INT AS min_count, round(2 + s / 0.3 * ln(2 * 0.05), 6) AS pseudo, round(s, 6) AS sensitivity FROM (SELECT m, greatest(1 / m, 2 - 1 / (1 / 2 + 1 / m)) AS s FROM (VALUES (10.0), (50.0), (100.0)) t(m))")
def pseudo_threshold(spark, d):
    rows = [(m, *(round(v, 6) for v in acceptance.pseudo_threshold(0.05, m, 2, 0.3)[::2])) for m in (10, 50, 100)]
    return spark.createDataFrame(rows, "min_count int, pseudo double, sensitivity double")


_JOINT = ", n AS (SELECT count(*)::DOUBLE AS n FROM items), j AS (SELECT line, disc, count(*) / any_value(n) AS p FROM items, n GROUP BY ALL), a AS (SELECT line, sum(p) AS pa FROM j GROUP BY line), b AS (SELECT disc, sum(p) AS pb FROM j GROUP BY disc) "


def _score(spark, d, score):
    domain = bayesnet.Domain(["line", "disc"], [8, 11])
    key = (bayesnet.Attribute(0), bayesnet.Attribute(1))
    got = bayesnet.marginals(bayesnet.cells(items(spark, d).select("line", "disc"), domain), domain, [key])
    return one(spark, score=round(score(got[key]), 6))


@query(_JOINT + "SELECT round(sum(abs(coalesce(p, 0) - pa * pb)), 6) AS score FROM a CROSS JOIN b LEFT JOIN j ON j.line = a.line AND j.disc = b.disc")
def score_R(spark, d):  # noqa: N802
    return _score(spark, d, bayesnet.score_r)


@query(_JOINT + "SELECT round(sum(p * log2(p / (pa * pb))), 6) AS score FROM j JOIN a USING (line) JOIN b USING (disc)")
def score_I(spark, d):  # noqa: N802
    return _score(spark, d, bayesnet.score_i)


@query("""SELECT 'c' || s AS "column", l::INT AS level, v::INT AS code, CASE WHEN l = 0 THEN v ELSE least(v, ((s - 1) // 4 - l + 1) * 4) END::INT AS "group"
FROM (SELECT unnest([3, 12, 32]) AS s), LATERAL (SELECT unnest(range((s - 1) // 4 + 1)) AS l), LATERAL (SELECT unnest(range(s)) AS v)""")
def taxonomy_levels(spark, d):
    return bayesnet.Domain(["c3", "c12", "c32"], [3, 12, 32]).table(spark)


@query()
def bayes_synthesise(spark, d):
    """A synthetic lineitem of codes, as long as the real one."""
    df = items(spark, d).select("line", "disc", "stat", binning.cut(F.col("qty"), QTY_EDGES).alias("qbin"))
    out, _ = models.fit_sample(df, {"line": (0, 7), "disc": (0, 10), "stat": (0, 1), "qbin": (0, 4)}, "PBNTheta", 1.0, 0.0, {"theta": 4, "epsilon_split": 0.25}, df.columns)
    return out


@query()
def dp_release(spark, d):
    """The private acceptance of made-up births against a second draw."""
    real, synth = birth.example(spark, 2000, 1), birth.example(spark, 2000, 2)
    real = filters.with_row_id(real, real.columns)
    domain = evaluate.Domain(birth.EVALUATION_BINS, birth.MIDPOINTS)
    got = evaluate.evaluate(real, synth, real, domain, birth.WEIGHTS, birth.ALPHAS, 2, birth.CRITERIA, 0.5, 0, True, birth.USER_ANALYSES, budget=birth.BUDGET, bounds=birth.BOUNDS, comparisons=["val_pr_s"])
    return got.release


@query("""SELECT t.theta, e.epsilon_split, o.ord, t.i + e.i AS tier, count(*) AS configs, count(*) AS ids FROM
(SELECT unnest([2, 4, 8, 16, 20, 25, 30, 35, 40, 50, 60, 100])::BIGINT AS theta, unnest(range(12)) AS i) t,
(SELECT unnest([0.1, 0.25, 0.5, 0.75])::DOUBLE AS epsilon_split, unnest(range(4)) AS i) e, (SELECT unnest([1, 2])::BIGINT AS ord) o, range(12) data
GROUP BY ALL""")
def config_grid(spark, d):
    """Every parameter by every projection by twelve ways to represent the data, each with an id of its own."""
    rows = [(c["hparams"]["theta"], c["hparams"]["epsilon_split"], c["dataset_projection"]["order"], c["tier"], c["id"]) for c in selection.generation_configs(selection.MODELS, birth.TRANSFORMATIONS, 1.0, 0.0)]
    grid = spark.createDataFrame(rows, "theta long, epsilon_split double, ord long, tier long, id string")
    return grid.groupBy("theta", "epsilon_split", "ord", "tier").agg(F.count(F.lit(1)).alias("configs"), F.count_distinct("id").alias("ids"))


@query("SELECT qbin, least(count(*), 50)::BIGINT AS n FROM items GROUP BY qbin")
def random_top_per_group(spark, d):
    df = items(spark, d).withColumn("qbin", binning.cut(F.col("qty"), QTY_EDGES))
    return postprocess.top_per_group(df, "qbin", 50, 1).groupBy("qbin").agg(F.count(F.lit(1)).alias("n"))


# --- more operators -----------------------------------------------------------------------------------------------
_GRID = "(lo - 0.03 * (hi - lo))"


@query(f", r AS (SELECT min(price) AS lo, max(price) AS hi FROM items) SELECT l_orderkey, line, greatest(0, least(15, floor((price - {_GRID}) / ((1.06 * (hi - lo)) / 16 + 1e-8))))::INT AS cell FROM items, r")
def grid_cells(spark, d):
    df = items(spark, d)
    lo, hi = df.agg(F.min("price"), F.max("price")).first()
    return df.select("l_orderkey", "line", bayesnet.grid_code(F.col("price"), lo, hi).alias("cell"))


@query("SELECT l_orderkey, line, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS qty FROM items")
def average_ranks(spark, d):
    return profile.average_ranks(items(spark, d).select("l_orderkey", "line", "qty"), ["qty"])


@query("SELECT count(*) // 3 AS n, count(*) // 3 AS different, count(*) // 3 AS known, (SELECT bit_xor(hash(o_orderkey)) FROM orders) IS NOT NULL AS every FROM orders")
def exact_sample(spark, d):
    """A third of the orders without replacement: as many different ones, all from the table; and all rows, if all are asked for."""
    df = table(spark, d, "orders").select("o_orderkey")
    n = df.count()
    got, every = privacy.sample(df, n // 3, 4), privacy.sample(df, n, 5)
    lost = df.exceptAll(every).count() + every.exceptAll(df).count()
    return got.join(df.withColumn("known", F.lit(1)), "o_orderkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"), F.sum("known").alias("known")).withColumn("every", F.lit(lost == 0))


@query("SELECT count(*) * 2 AS n, count(*) * 2 AS known FROM orders")
def sample_with_replacement(spark, d):
    """Twice as many draws as there are orders, all from the table."""
    df = table(spark, d, "orders").select("o_orderkey")
    got = privacy.sample(df, 2 * df.count(), 4, True)
    return got.join(df.withColumn("known", F.lit(1)), "o_orderkey", "left").agg(F.count(F.lit(1)).alias("n"), F.sum("known").alias("known"))


@query("SELECT CASE WHEN n > 1 THEN n ELSE 0 END AS n, sum(n)::BIGINT AS rows, TRUE AS fit FROM (SELECT count(*) AS n FROM items GROUP BY qty, line, disc, stat) GROUP BY 1")
def doubled_uniques(spark, d):
    """Half of the unique rows twice: others have the counts that they had, and the rest of the size is made of unique ones,
    of which one at most occurs once, and one may be drawn a third time."""
    x = items(spark, d).select("qty", "line", "disc", "stat")
    before, after = profile.histogram(x).withColumnRenamed("n", "n0"), profile.histogram(privacy.double_uniques(x))
    both = after.join(before, ["qty", "line", "disc", "stat"]).withColumn("low", F.col("n0") == 1)
    out = both.groupBy(F.when(F.col("low"), 0).otherwise(F.col("n")).cast("long").alias("n")).agg(F.sum("n").alias("rows"), F.max("low").alias("low"), F.count_if(F.col("n") == 1).alias("once"), F.max("n").alias("most"))
    return out.select("n", "rows", F.when(F.col("low"), (F.col("once") <= 1) & (F.col("most") <= 3)).otherwise(F.lit(True)).alias("fit"))


@query("SELECT flag, stat FROM (SELECT DISTINCT flag FROM items), (SELECT DISTINCT stat FROM items)")
def baseline_rows(spark, d):
    """Independent columns make every combination, even those that the table lacks."""
    return privacy.baseline(items(spark, d).select("flag", "stat"), 5000, "uniform", 1).distinct()


@query("SELECT flag, stat, round(count(*) / (SELECT count(*) FROM items), 6) AS value FROM items GROUP BY flag, stat")
def contingency_all(spark, d):
    return profile.contingency(items(spark, d), "flag", "stat", "all").select("flag", "stat", r6("value").alias("value"))


@query("""SELECT c AS "column", sum(v) FILTER (flag = 'A') AS "A", sum(v) FILTER (flag = 'N') AS "N", sum(v) FILTER (flag = 'R') AS "R" FROM (SELECT flag, unnest(['n', 'qty']) AS c, unnest([count(*)::DOUBLE, sum(qty)]) AS v FROM items GROUP BY flag) GROUP BY c""")
def transposed(spark, d):
    df = items(spark, d).groupBy("flag").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("qty").alias("qty"))
    return profile.transposed(df, "flag").select(F.col("column"), "A", "N", "R")


_PAIRED = ", p AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice AS price FROM part), m AS (SELECT abs(a.size - b.size) AS ds, abs(a.price - b.price) AS dp FROM p a JOIN p b ON b.id = a.id + 1) "


def _paired(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    pairs = p.select(F.col("id").alias("x_id"), (F.col("id") + 1).alias("y_id"), F.lit(1).alias("pairs"))
    return faithfulness.matched_costs(p, p, pairs, ["size", "price"])


@query("WITH x AS (SELECT 1)" + _PAIRED + "SELECT ((ds > 0)::INT + (dp > 0)::INT)::INT AS changed, count(*) AS pairs FROM m GROUP BY 1")
def matched_changes(spark, d):
    """Each part against the next one: in how many columns they differ."""
    return _paired(spark, d)[0]


@query("WITH x AS (SELECT 1)" + _PAIRED + "SELECT round(avg(ds), 6) AS size_mean, max(ds) AS size_max, round(avg(dp), 6) AS price_mean, round(max(dp), 6) AS price_max FROM m")
def matched_differences(spark, d):
    return _paired(spark, d)[1].select(r6("size_mean").alias("size_mean"), "size_max", r6("price_mean").alias("price_mean"), r6("price_max").alias("price_max"))


@query("SELECT least(disc, 8)::BIGINT AS g, line::BIGINT AS line, count(*) AS n FROM items GROUP BY ALL")
def generalised_marginal(spark, d):
    """Counts of line by the discount's first taxonomy level, where codes 8 to 10 are one."""
    domain = bayesnet.Domain(["disc", "line"], [11, 8])
    key = (bayesnet.Attribute(0, 1), bayesnet.Attribute(1))
    got = bayesnet.marginals(bayesnet.cells(items(spark, d).select("disc", "line"), domain), domain, [key])[key]
    return spark.createDataFrame([(g, l, int(n)) for g, row in enumerate(got.tolist()) for l, n in enumerate(row) if n], "g long, line long, n long")


@query("SELECT half AS name, qbin AS qty_bin, round(avg(price), 6) AS mean, round(median(price), 6) AS median, count(price) AS n FROM items GROUP BY ALL")
def group_means(spark, d):
    x, y = halves(spark, d, ["qty", "price"])
    out = report.group_means(report.stacked({"real": x, "synth": y}, {"qty": QTY_EDGES}), "price", "qty_bin")
    return out.withColumns({"mean": r6("mean"), "median": r6("median")})


@query("SELECT qty, disc, 0::BIGINT AS processed, count(*) AS synth, count(*) FILTER (price > 50000) AS rejected FROM items i WHERE half = 'synth' AND NOT EXISTS (SELECT 1 FROM items r WHERE r.half = 'real' AND r.qty = i.qty AND r.disc = i.disc AND r.price < 5000) GROUP BY qty, disc")
def unseen_pairs(spark, d):
    x, y = halves(spark, d)
    return report.unseen_pairs(x.filter("price < 5000"), y, y.filter("price > 50000"), "qty", "disc")


@query("SELECT half AS name, round(regr_r2(price, qty), 6) AS r2 FROM items GROUP BY half")
def regressions(spark, d):
    x, y = halves(spark, d, ["qty", "price"])
    return report.regressions({"real": x, "synth": y}).select("name", r6("r2").alias("r2"))


@query()
def propensity(spark, d):
    got = metrics.propensity(*numbers(spark, d, ["line", "disc", "qty"]), trees=10)
    return one(spark, **got)


@query()
def cheapest_assignment(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("k"), F.col("n_regionkey").cast("double").alias("r"))
    return spark.createDataFrame(faithfulness.minimum_cost_assignment(n, n.select((24 - F.col("k")).alias("k"), "r"), ["k", "r"], {"r": 10}), "x int, y int, cost double")


@query()
def network_transcript(spark, d):
    df = items(spark, d).select("line", "disc", "stat")
    _, net = models.fit_sample(df, {"line": (0, 7), "disc": (0, 10), "stat": (0, 1)}, "PBNDegree", 1.0, 0.0, {"degree": 2}, df.columns)
    return net.log(spark)


@query()
def copula_rows(spark, d):
    return models.gaussian_copula(items(spark, d).select("qty", "price", "disc"), 1000, 1)


# --- sources and sinks: written, read back ------------------------------------------------------------------------
_KEPT = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_KEPT_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def _kept(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", F.col("o_totalprice").cast("double"))


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice, form FROM orders, (VALUES ('csv'), ('parquet')) f(form)")
def twin_round_trip(spark, d):
    """A table written for people and for machines, read back from both."""
    path = tables.scratch(spark)
    tables.write_twin(_kept(spark, d), path)
    read = {"csv": tables.read_csv(spark, f"{path}.csv", _KEPT_SCHEMA), "parquet": spark.read.parquet(f"{path}.parquet")}
    return read["csv"].withColumn("form", F.lit("csv")).unionByName(read["parquet"].withColumn("form", F.lit("parquet")))


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice FROM orders")
def split_json_round_trip(spark, d):
    """Documents of columns and rows, as a tracker writes them, read back by name; a document for each status and month."""
    columns = F.array(*(F.lit(c) for c in ("o_totalprice", "o_orderkey", "o_orderstatus", "o_custkey")))
    row = F.array(*(F.col(c).cast("string") for c in ("o_totalprice", "o_orderkey", "o_orderstatus", "o_custkey")))
    documents = _kept(spark, d).groupBy("o_orderstatus", F.pmod("o_orderkey", F.lit(12)).alias("k")).agg(F.to_json(F.struct(columns.alias("columns"), F.collect_list(row).alias("data"))).alias("value"))
    path = tables.scratch(spark)
    documents.repartition(36, "o_orderstatus", "k").select("value").write.option("lineSep", "\n\n").text(path)
    return tables.read_split_json(spark, path, _KEPT_SCHEMA, line_sep="\n\n")


@query("SELECT l_orderkey::VARCHAR || chr(9) || line::VARCHAR || chr(9) || disc::VARCHAR AS value FROM items")
def tsv_lines(spark, d):
    path = tables.scratch(spark)
    tables.write_tsv(items(spark, d).select("l_orderkey", "line", "disc"), path)
    return spark.read.text(path)


@query("SELECT CASE WHEN stat = 1 THEN '1' ELSE '0' END || ' ' || (line + 1)::VARCHAR || ':1 ' || (disc + 9)::VARCHAR || ':1' AS value FROM items")
def libsvm_lines(spark, d):
    """One-hot features of line (eight codes) and discount; the label is the status."""
    path = tables.scratch(spark)
    tables.write_libsvm(items(spark, d).select("line", "disc", "stat"), path, "stat", {1}, {"line": 8, "disc": 11})
    return spark.read.text(path)


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000")
def filtered_by_expression(spark, d):
    return filters.query(table(spark, d, "orders"), "o_totalprice >= 50000 AND o_totalprice <= 150000").select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"))


@query("SELECT name, round(total, 6) AS total FROM (VALUES ('a', 2.0::DOUBLE), ('b', 0.6::DOUBLE), ('a b', 2.6::DOUBLE)) t(name, total)")
def spent_budgets(spark, d):
    """What an accountant adds up, and the variance of Laplace noise at those scales."""
    book = mechanisms.Accountant()
    for name, epsilon in (("a", 0.5), ("b", 0.6), ("a", 1.5)):
        book.spend(name, epsilon)
    total = lambda *names: math.fsum(e for n, e in book.spent if n in names)
    return spark.createDataFrame([(" ".join(k), round(total(*k), 6)) for k in (("a",), ("b",), ("a", "b"))], "name string, total double")


@query("""SELECT scale::DOUBLE AS scale, TRUE AS centred, TRUE AS spread FROM (VALUES (0.5), (2.0), (40.0)) t(scale)""")
def laplace_moments(spark, d):
    """Mean and mean absolute value of 20,000 draws lie within six standard errors of 0 and of the scale."""
    rows = []
    for scale in (0.5, 2.0, 40.0):
        draws = [mechanisms.laplace_noise(scale) for _ in range(20_000)]
        mean, size = math.fsum(draws) / len(draws), math.fsum(map(abs, draws)) / len(draws)
        rows.append((scale, abs(mean) < 6 * scale * math.sqrt(2 / len(draws)), abs(size - scale) < 6 * scale / math.sqrt(len(draws))))
    return spark.createDataFrame(rows, "scale double, centred boolean, spread boolean")


@query("SELECT name, avg(v) AS mean, half FROM (SELECT half, unnest(['line', 'disc']) AS name, unnest([line, disc]) AS v FROM items) GROUP BY name, half")
def marginal_means(spark, d):
    """Means of two columns of both halves, from the stacked copies that reports are made of."""
    x, y = halves(spark, d, ["line", "disc"])
    both = x.withColumn("half", F.lit("real")).unionByName(y.withColumn("half", F.lit("synth")))
    return both.select("half", F.explode(F.create_map(*(e for c in ("line", "disc") for e in (F.lit(c), F.col(c))))).alias("name", "v")).groupBy("name", "half").agg(F.avg("v").alias("mean"))
