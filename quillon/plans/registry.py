"""Queries over the given tables by the operators of the inventory, each with DuckDB SQL for the same rows.

A query's name begins with the number of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.functions import scalars as S
from quillon.operators import checks as C
from quillon.operators import evaluation as E
from quillon.operators import groups as G
from quillon.operators import measures as M
from quillon.operators import splits as P
from quillon.operators import summaries as Y
from quillon.operators import tables as T
from quillon.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


class Tables:
    """The given tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(x, name: str | None = None):
    out = F.round(x, DIGITS)
    return out.alias(name) if name else out


# Scans --------------------------------------------------------------------


@query("""SELECT page_id, tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<(h1|p|li|a)[ >]', 1)) AS tag FROM pages) GROUP BY 1, 2""")
def s7_markup_events(t):
    tags = F.regexp_extract_all("html", F.lit(r"<(h1|p|li|a)[ >]"), 1)
    return t.pages.select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def _turn_lines(t):
    return t.conversations.select("conv_id", "turn", F.col("role").alias("line"))


@query("""WITH b AS (SELECT conv_id, role, sum((role = 'user')::int) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations)
SELECT conv_id, block, count(*) AS n_lines, count(*) FILTER (role = 'assistant') AS n_answers FROM b WHERE block > 0 GROUP BY 1, 2""")
def s6_blocks_of_turns(t):
    own = files.blocks(_turn_lines(t), "conv_id", "turn", F.col("line") == "user").filter("block > 0")
    return own.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line") == "assistant").alias("n_answers"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def s9_json_fields(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT p_partkey, TRY_CAST(substr(line, 1, 8) AS DOUBLE) AS a, TRY_CAST(substr(line, 9, 8) AS DOUBLE) AS b FROM (
  SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 8, ' ') || lpad(p_brand, 8, ' ') AS line FROM part)""")
def s8_fixed_width(t):
    lines = t.part.select("p_partkey", F.concat(F.lpad(F.col("p_size").cast("string"), 8, " "), F.lpad("p_brand", 8, " ")).alias("line"))
    return files.fixed_width(lines, "line", {"a": (0, 8), "b": (8, 16)}).drop("line")


# Projections ----------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_totalprice > 300000 THEN 'large' ELSE '' END AS reason,
  (o_orderstatus IS NOT NULL AND o_orderstatus <> '')::int + (o_orderpriority <> '')::int AS n_known FROM orders""")
def p10_ordered_reasons(t):
    rules = [(F.col("o_orderstatus") == "F", "done"), (F.col("o_orderpriority").startswith("1"), "urgent"), (F.col("o_totalprice") > 300000, "large")]
    return t.orders.select("o_orderkey", Y.ordered_reason(rules).alias("reason"), S.presence_score(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("n_known"))


@query("SELECT c_custkey, c_name, coalesce(nullif(trim(c_mktsegment), ''), c_name) AS name, '' AS note FROM customer")
def p2_p4_columns_with_fallback(t):
    df = T.ensure_columns(T.require_columns(t.customer, ["c_custkey"]), ["note"])
    return df.select("c_custkey", "c_name", S.first_known(F.col("c_mktsegment"), F.col("c_name")).alias("name"), "note")


@query("SELECT doc_id, regexp_replace(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+', '[mail]', 'g') AS text FROM documents")
def p8_redact(t):
    return T.redact(t.documents.select("doc_id", "text"), r"[\w.+-]+@[\w-]+\.[\w.]+", "[mail]")


@query(r"""SELECT doc_id, concat_ws('; ', CASE WHEN regexp_matches(text, '(?:[A-Za-z]:\\[A-Z]|/(?:home|Users|mnt|private|var)/[A-Za-z0-9])') THEN 'absolute_path' END,
  CASE WHEN regexp_matches(text, '(?i)(?:api[_-]?key|secret|token|password)\s*[:=]\s*[''"]?[A-Za-z0-9_\-]{12,}') THEN 'credential' END,
  CASE WHEN contains(text, chr(0)) THEN 'nul_byte' END) AS issues FROM documents""")
def p9_policy_scan(t):
    return t.documents.select("doc_id", S.text_issues(F.col("text")).alias("issues"))


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' OR NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT')""")
def p12_preferred_category(t):
    kept, _ = T.preferred_only(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "1-URGENT")
    return kept


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders, c_nationkey IN (SELECT s_nationkey FROM supplier) AS has_local_supplier FROM customer""")
def p14_membership_flags(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_o", F.lit(True))
    nations = t.supplier.select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("_s", F.lit(True))
    joined = t.customer.join(orders, "c_custkey", "left").join(nations, "c_nationkey", "left")
    return joined.select("c_custkey", F.col("_o").isNotNull().alias("has_orders"), F.col("_s").isNotNull().alias("has_local_supplier"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://www\\.') THEN 'www' WHEN regexp_matches(url, '^https?://m\\.') THEN 'mobile' WHEN starts_with(url, 'https') THEN 'secure' ELSE 'other' END AS category FROM pages""")
def p16_category_by_prefix(t):
    rules = [(("http://www.", "https://www."), "www"), (("http://m.", "https://m."), "mobile"), ("https", "secure")]
    return t.pages.select("page_id", Y.category_by_prefix(F.col("url"), rules, "other").alias("category"))


# Joins ----------------------------------------------------------------------


@query("""WITH d AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT c_custkey, d.o_orderkey AS first_order, coalesce(CAST(d.o_orderkey AS VARCHAR), n_name) AS label FROM customer
LEFT JOIN (SELECT * FROM d WHERE n = 1) d ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def j1_first_of_dimension(t):
    first = T.first_per_key(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"))
    named = T.lookup(T.lookup(t.customer, first, ["c_custkey"]), t.nation.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], small=True)
    return named.select("c_custkey", "first_order", F.coalesce(F.col("first_order").cast("string"), "n_name").alias("label"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def j3_semi_join(t):
    return t.part.join(t.lineitem.filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j4_anti_join(t):
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_PAIRS = """WITH pr AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem),
 d AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_size > 10)"""


def _part_pairs(t):
    pairs = t.lineitem.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()
    return pairs, t.part.filter("p_size > 10").select("p_partkey", "p_size")


@query(_PAIRS + " SELECT a, b, x.v AS p_size_a, y.v AS p_size_b FROM pr JOIN d x ON x.k = a JOIN d y ON y.k = b")
def j5_pair_lookup(t):
    return T.pair_lookup(*_part_pairs(t), "p_partkey", "p_size").select("a", "b", "p_size_a", "p_size_b")


@query(_PAIRS + """ SELECT a, b, concat_ws(';', CASE WHEN x.v IS NULL THEN 'missing_a' END, CASE WHEN y.v IS NULL THEN 'missing_b' END) AS reason
FROM pr LEFT JOIN d x ON x.k = a LEFT JOIN d y ON y.k = b""")
def j6_pairs_with_reasons(t):
    return T.pair_lookup_with_reasons(*_part_pairs(t), "p_partkey", "p_size").select("a", "b", "reason")


@query(_PAIRS + " SELECT a, b, x.v AS p_size_a, y.v AS p_size_b FROM pr JOIN d x ON x.k = a JOIN d y ON y.k = b")
def j5_pair_lookup_all(t):
    return T.pair_lookup(*_part_pairs(t), "p_partkey", "p_size").select("a", "b", "p_size_a", "p_size_b")


@query(_PAIRS + """ SELECT a, b, concat_ws(';', CASE WHEN x.v IS NULL THEN 'missing_a' END, CASE WHEN y.v IS NULL THEN 'missing_b' END) AS reason
FROM pr LEFT JOIN d x ON x.k = a LEFT JOIN d y ON y.k = b""")
def j6_pairs_with_reasons_all(t):
    return T.pair_lookup_with_reasons(*_part_pairs(t), "p_partkey", "p_size").select("a", "b", "reason")


@query("""SELECT x.l_orderkey, x.l_linenumber AS a, y.l_linenumber AS b, count(*) AS n FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber GROUP BY 1, 2, 3""")
def j7_pairs_in_groups(t):
    return T.pairs_in_groups(t.lineitem, ["l_orderkey"], "l_linenumber").groupBy("l_orderkey", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT x.s_nationkey, x.s_suppkey AS a, y.s_suppkey AS b, (x.s_acctbal > 0) = (y.s_acctbal > 0) AS same_sign,
 CASE WHEN (x.s_acctbal > 0) = (y.s_acctbal > 0) THEN 'eligible' ELSE 'sign_differs' END AS status
FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey""")
def j8_eligibility(t):
    pairs = T.pairs_in_groups(t.supplier.withColumn("sign", F.col("s_acctbal") > 0), ["s_nationkey"], "s_suppkey", ["sign"])
    same = F.col("sign_a").eqNullSafe(F.col("sign_b"))
    return pairs.select("s_nationkey", "a", "b", same.alias("same_sign"), F.when(same, "eligible").otherwise("sign_differs").alias("status"))


@query("""SELECT n_nationkey, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'absent' WHEN n < 60 THEN 'few' ELSE '' END AS reason FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) ON c_nationkey = n_nationkey""")
def j9_zero_filled_left_join(t):
    counts = t.customer.filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("_n"))
    return t.nation.join(counts, "n_nationkey", "left").select("n_nationkey", F.coalesce("_n", F.lit(0)).alias("n"), F.when(F.col("_n").isNull(), "absent").when(F.col("_n") < 60, "few").otherwise("").alias("reason"))


@query("""WITH l AS (SELECT s_suppkey k, s_nationkey n, rtrim(s_name) s FROM supplier), rr AS (SELECT s_suppkey k, CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey + 1 ELSE s_nationkey END n, rtrim(s_name) s FROM supplier WHERE s_suppkey % 10 > 0),
a AS (SELECT CAST(k AS VARCHAR) AS "row", 'n' AS col, CAST(n AS VARCHAR) v FROM l UNION ALL SELECT CAST(k AS VARCHAR), 's', s FROM l),
b AS (SELECT CAST(k AS VARCHAR) AS "row", 'n' AS col, CAST(n AS VARCHAR) v FROM rr UNION ALL SELECT CAST(k AS VARCHAR), 's', s FROM rr)
SELECT coalesce(a."row", b."row") AS "row", coalesce(a.col, b.col) AS col, coalesce(a.v, '<absent>') AS left_value, coalesce(b.v, '<absent>') AS right_value
FROM a FULL JOIN b ON a."row" = b."row" AND a.col = b.col WHERE coalesce(a.v, '<absent>') <> coalesce(b.v, '<absent>')""")
def j10_cell_diff(t):
    left = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.col("s_name").alias("s"))
    right = left.filter("k % 10 > 0").withColumn("n", F.expr("CASE WHEN k % 7 = 0 THEN n + 1 ELSE n END").cast("double"))
    return T.cell_diff(left, right, "k")


@query("SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 'PRESENT' ELSE 'MISSING' END AS status FROM part")
def j11_reconcile(t):
    return T.reconcile(t.part, t.lineitem.filter("l_returnflag = 'R'").withColumnRenamed("l_partkey", "p_partkey"), ["p_partkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderstatus <> 'P'")
def j12_unaccounted(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return T.unaccounted(t.orders, lines, t.orders.filter("o_orderstatus = 'P'"), keys=["o_orderkey"])


@query("""SELECT 'lineitem.l_orderkey' AS check_name, count(*) AS n_orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def j13_referential_checks(t):
    def orphans(child, key, parent, parent_key, name):
        lost = child.select(F.col(key).alias("k")).join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
        return lost.agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(name).alias("check_name"), "n_orphans")

    one = orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "lineitem.l_orderkey")
    return one.unionByName(orphans(t.orders, "o_custkey", t.customer, "c_custkey", "orders.o_custkey"))


# Aggregates -----------------------------------------------------------------


@query("""SELECT user_id, event_type, count(value) AS n_raters, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value, round(median(value), 6) AS median_value,
 max(value) AS max_value, count(*) FILTER (value > 0) AS n_chosen, round(count(*) FILTER (value > 0) / nullif(count(value), 0), 6) AS share_chosen FROM events GROUP BY 1, 2""")
def a1_rating_summary(t):
    out = M.rating_summary(t.events, ["user_id", "event_type"], "value")
    return out.withColumns({c: r(c) for c in ("mean_value", "sd_value", "median_value", "share_chosen")})


@query("SELECT p_name, count(DISTINCT p_brand) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def a2_key_conflicts(t):
    return M.key_conflicts(t.part, "p_name", "p_brand")


_LABELS = "SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS label FROM part"


def _labels(t):
    return t.part.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("label"))


@query(f"SELECT label, count(*) AS n FROM ({_LABELS}) GROUP BY 1")
def a3_label_frequency(t):
    return _labels(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH l AS (SELECT DISTINCT * FROM ({_LABELS})), v AS (SELECT DISTINCT label FROM l)
SELECT x.label AS a, y.label AS b, (SELECT count(*) FROM l p JOIN l q USING (p_partkey) WHERE p.label = x.label AND q.label = y.label) AS n FROM v x, v y""")
def a4_cooccurrence(t):
    return M.cooccurrence(_labels(t), "p_partkey", "label")


@query("""SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_nations, count(*) AS n, sum((c_acctbal > 0)::int) AS n_positive, sum((c_nationkey IN (1, 2))::int) AS n_first FROM customer GROUP BY 1""")
def a7_coverage(t):
    return t.customer.groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("n_nations"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("n_positive"), F.count_if(F.col("c_nationkey").isin(1, 2)).alias("n_first"))


@query("""SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS n_values, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS value FROM orders GROUP BY 1, 2""")
def a8_consensus(t):
    return M.consensus(t.orders, ["o_custkey", "o_orderpriority"], "o_orderstatus")


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n_rows, count(*) FILTER (l_returnflag <> 'N') AS n_joint, count(*) FILTER (l_returnflag <> 'N' AND (l_returnflag = 'R') = (l_linestatus = 'F')) AS n_same,
 array_to_string(list_sort(list_distinct(list(p_brand) FILTER (l_quantity > 45))), ';') AS brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_suppkey, n_rows, n_joint, n_same, n_joint - n_same AS n_different, round((n_joint - n_same) / nullif(n_joint, 0), 6) AS share_different, coalesce(brands, '') AS brands,
 CASE WHEN n_joint < 2 THEN 'insufficient_data' WHEN n_joint = n_same THEN 'concordant' WHEN (n_joint - n_same) / n_joint >= 0.5 THEN 'divergent' ELSE 'indeterminate' END AS class FROM g""")
def a9_pair_concordance(t):
    rows = t.lineitem.join(t.part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    joint = F.col("l_returnflag") != "N"
    same = joint & ((F.col("l_returnflag") == "R") == (F.col("l_linestatus") == "F"))
    g = rows.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(joint).alias("n_joint"), F.count_if(same).alias("n_same"), S.sorted_set(F.collect_set(F.when(F.col("l_quantity") > 45, F.col("p_brand")))).alias("brands")
    )
    d = F.col("n_joint") - F.col("n_same")
    return g.select("l_suppkey", "n_rows", "n_joint", "n_same", d.alias("n_different"), r(F.try_divide(d, "n_joint"), "share_different"), "brands", S.concordance_class(F.col("n_joint"), d).alias("class"))


@query("SELECT coalesce(nullif(trim(lang), ''), 'missing') AS value, count(*) AS n FROM documents GROUP BY 1")
def a10_value_counts(t):
    return M.value_counts(t.documents, "lang")


@query("""SELECT * FROM (SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, CAST(count(*) FILTER (value > 10) AS DOUBLE) AS large FROM events)
UNPIVOT (value FOR metric IN (rows, users, large))""")
def a11_metrics(t):
    return M.long_metrics(t.events, {"rows": F.count(F.lit(1)), "users": F.countDistinct("user_id"), "large": F.count_if(F.col("value") > 10)})


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg((l_quantity < 10)::int), 6) AS share_a, round(avg((l_quantity >= 10 AND l_quantity < 30)::int), 6) AS share_b,
 round(avg((l_quantity < 10)::int) - avg((l_quantity >= 10 AND l_quantity < 30)::int), 6) AS difference FROM lineitem GROUP BY 1, 2""")
def a12_response_summary(t):
    q, n = F.col("l_quantity"), F.count(F.lit(1))
    a, b = F.count_if(q < 10) / n, F.count_if((q >= 10) & (q < 30)) / n
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(n.alias("n"), r(a, "share_a"), r(b, "share_b"), r(a - b, "difference"))


_PROFILED = ("p_name", "p_brand", "p_type", "p_size")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 1 AS is_constant FROM part" for c in _PROFILED))
def a13_column_profile(t):
    return C.column_profile(t.part, _PROFILED).select("column", "n_rows", "n_missing", "n_distinct", "is_constant")


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_distinct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_duplicates FROM lineitem")
def a16_duplicates(t):
    return M.duplicate_count(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT s_nationkey, count(*) AS n, min(s_acctbal) AS least, round(median(s_acctbal), 6) AS median, round(avg(s_acctbal), 6) AS mean, round(coalesce(stddev_samp(s_acctbal), 0), 6) AS sd FROM supplier GROUP BY 1""")
def a17_energy_summary(t):
    return Y.energy_summary(t.supplier, ["s_nationkey"], "s_acctbal").withColumns({c: r(c) for c in ("median", "mean", "sd")})


@query("""SELECT o_custkey, count(*) AS n_found, CASE WHEN count(*) >= 15 THEN 'complete' WHEN count(*) >= 5 THEN 'partial' ELSE 'few' END AS status, max(o_totalprice) AS best, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best_key,
 round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.75), 6) AS q75 FROM orders GROUP BY 1""")
def a18_run_summary(t):
    n, p = F.count(F.lit(1)), F.col("o_totalprice")
    return t.orders.groupBy("o_custkey").agg(
        n.alias("n_found"), F.when(n >= 15, "complete").when(n >= 5, "partial").otherwise("few").alias("status"), F.max(p).alias("best"),
        F.max_by("o_orderkey", F.struct(p, "o_orderkey")).alias("best_key"), r(F.percentile(p, 0.25), "q25"), r(F.percentile(p, 0.75), "q75"),
    )


@query("""WITH u AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag <> 'N'), d AS (SELECT l_suppkey, count(*) AS n_units FROM u GROUP BY 1),
s AS (SELECT l_suppkey, l_linestatus, count(DISTINCT l_orderkey) AS n_with FROM lineitem GROUP BY 1, 2)
SELECT s.l_suppkey, l_linestatus, n_with, n_units, round(n_with / n_units, 6) AS frequency FROM s LEFT JOIN d USING (l_suppkey)""")
def a19_frequency(t):
    return M.frequency(t.lineitem, t.lineitem.filter("l_returnflag <> 'N'"), "l_suppkey", "l_orderkey", "l_linestatus")


@query("SELECT DISTINCT l_suppkey, l_returnflag || ':' || l_linestatus || ':' || l_linenumber AS feature, 1 AS present FROM lineitem")
def a21_feature_table(t):
    return Y.feature_rows(t.lineitem, ["l_suppkey"], ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("""SELECT o_orderkey, coalesce(n, 0) AS n, 4 AS expected, CASE WHEN coalesce(n, 0) = 4 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def a24_expected_counts(t):
    return M.expected_counts(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", 4)


@query("SELECT p_brand, count(DISTINCT md5(p_type)) AS n_hashes FROM part GROUP BY 1 HAVING count(DISTINCT md5(p_type)) > 1")
def a25_inconsistent_groups(t):
    return Y.inconsistent_groups(t.part, ["p_brand"], F.md5("p_type"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'FAIL' WHEN bool_or(o_orderstatus = 'P') THEN 'WARNING' ELSE 'PASS' END AS status FROM orders GROUP BY 1""")
def a27_worst_status(t):
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "P", "WARNING").otherwise("PASS")
    return M.worst_status(t.orders.withColumn("status", status), ["o_custkey"])


@query("SELECT count(DISTINCT l_partkey) / (SELECT count(*) FROM part) AS coverage FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def a31_coverage(t):
    seen = t.lineitem.filter("l_shipdate < timestamp '1996-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return Y.coverage(t.part, seen, "p_partkey").select("coverage")


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS "min", round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median,
 round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS "max" FROM events GROUP BY 1""")
def a32_describe(t):
    return M.describe(t.events, ["event_type"], "value").withColumns({c: r(c) for c in ("mean", "sd", "q25", "median", "q75")})


@query("""SELECT c_mktsegment, list_sort(list(DISTINCT c_nationkey)) = list_transform(range(25), lambda x: x::int) AS matches FROM customer GROUP BY 1""")
def a35_expected_sets(t):
    return Y.expected_sets(t.customer, ["c_mktsegment"], "c_nationkey", F.sequence(F.lit(0), F.lit(24))).select("c_mktsegment", "matches")


@query("SELECT c_nationkey, count(DISTINCT c_custkey) AS n, CAST(count(DISTINCT c_custkey) * (count(DISTINCT c_custkey) - 1) / 2 AS BIGINT) AS n_pairs FROM customer GROUP BY 1")
def a36_pair_counts(t):
    return Y.pair_counts(t.customer, "c_nationkey", "c_custkey")


# Windows, sorts, reshaping ----------------------------------------------------


@query("SELECT printf('PART_%06d', row_number() OVER (ORDER BY p_name, p_partkey)) AS part_id, p_partkey FROM part")
def w1_numbered_ids(t):
    return T.numbered_ids(t.part.select("p_name", "p_partkey"), [F.col("p_name"), F.col("p_partkey")], "PART_%06d", "part_id").select("part_id", "p_partkey")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) > 1 AS is_repeat, count(*) OVER (PARTITION BY p_name, p_brand) > 1 AS is_shared FROM part")
def w3_w4_repeat_flags(t):
    flagged = T.repeat_flag(t.part, ["p_name", "p_brand"], [F.col("p_partkey")])
    return T.shared_key_flag(flagged, ["p_name", "p_brand"]).select("p_partkey", "is_repeat", "is_shared")


@query("""WITH k AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC) AS rk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
g AS (SELECT l_orderkey, count(DISTINCT l_returnflag || l_linestatus) AS c FROM k WHERE rk = 1 GROUP BY 1)
SELECT k.l_orderkey, l_linenumber, l_partkey, CASE WHEN c > 1 THEN 'conflicting_top_rows' WHEN n > 1 THEN 'lower_priority' ELSE 'kept' END AS outcome FROM k JOIN g USING (l_orderkey)""")
def w6_priority_dedup(t):
    kept, out = T.priority_dedup(t.lineitem, ["l_orderkey"], [F.desc("l_discount")], ["l_returnflag", "l_linestatus"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    rows = kept.withColumn("outcome", F.lit("kept")).unionByName(out.withColumnRenamed("exclusion_reason", "outcome"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "outcome")


_MEANS = "SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY 1, 2"


def _means(t):
    return t.events.groupBy("user_id", "event_type").agg(r(F.avg("value"), "v"))


@query(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS n FROM ({_MEANS}) WHERE v > 0)
SELECT u.user_id, {", ".join(f"max(event_type) FILTER (n = {i}) AS top{i}_label, max(v) FILTER (n = {i}) AS top{i}_value" for i in (1, 2, 3))} FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN k USING (user_id) GROUP BY 1""")
def w7_top_k_wide(t):
    return T.top_k_wide(_means(t), "user_id", "event_type", "v", 3)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o2_w12_top_twenty(t):
    top = t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))  # 20 rows


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def w12_order_places(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return T.numbered_ids(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], "%d", "place").withColumn("place", F.col("place").cast("long"))


@query("""SELECT l_orderkey, 'supplier' AS role, l_suppkey AS value FROM lineitem UNION ALL SELECT l_orderkey, 'part', l_partkey FROM lineitem""")
def t2_roles_to_rows(t):
    return T.roles_to_rows(t.lineitem, ["l_orderkey"], {"supplier": "l_suppkey", "part": "l_partkey"})


@query("""(SELECT l_partkey AS k, 'both' AS part FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, 'both' FROM lineitem WHERE l_linestatus = 'O')
UNION ALL (SELECT l_partkey, 'first' FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_partkey, 'first' FROM lineitem WHERE l_quantity < 2)""")
def t3_set_operations(t):
    keys = lambda where: t.lineitem.filter(where).select(F.col("l_partkey").alias("k"))
    both = Y.set_operation(keys("l_returnflag = 'R'"), keys("l_linestatus = 'O'"), "intersect").withColumn("part", F.lit("both"))
    return both.unionByName(Y.set_operation(keys("l_quantity > 49"), keys("l_quantity < 2"), "except").withColumn("part", F.lit("first")))


@query("""SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, s_nationkey + 100, s_acctbal FROM supplier WHERE s_suppkey % 3 = 0""")
def t5_merge_last(t):
    old = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    return T.merge_last(old, old.filter("s_suppkey % 3 = 0").withColumn("s_nationkey", F.col("s_nationkey") + 100), ["s_suppkey"])


@query("""SELECT c_custkey, 'negative_balance' AS issue FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'even_nation' FROM customer WHERE c_nationkey % 2 = 0""")
def t6_rule_issues(t):
    return T.rule_issues(t.customer, ["c_custkey"], {"negative_balance": F.col("c_acctbal") < 0, "even_nation": F.col("c_nationkey") % 2 == 0})


@query("""SELECT 'orders' AS stage, 'o_orderkey=' || o_orderkey || ' | o_orderstatus=' || o_orderstatus AS details FROM orders WHERE o_totalprice < 2000
UNION ALL SELECT 'supplier', 's_suppkey=' || s_suppkey FROM supplier WHERE s_acctbal < 0""")
def t7_failure_log(t):
    return T.failure_log({"orders": t.orders.filter("o_totalprice < 2000").select("o_orderkey", "o_orderstatus"), "supplier": t.supplier.filter("s_acctbal < 0").select("s_suppkey")})


@query("SELECT l_orderkey, l_linenumber, l_partkey, measure, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (value FOR measure IN (l_quantity, l_discount, l_tax))")
def t8_melt(t):
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")


_KINDS = ("click", "error", "purchase", "signup", "view")


@query(f"SELECT user_id, {', '.join(f'''max(v) FILTER (event_type = '{k}') AS "{k}"''' for k in _KINDS)} FROM ({_MEANS}) GROUP BY 1")
def t9_pivot(t):
    return _means(t).groupBy("user_id").pivot("event_type", list(_KINDS)).agg(F.first("v"))


@query("SELECT user_id, list_sort(list(event_type || '=' || n)) AS cells FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def t11_vectors(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string")))).alias("cells"))


# Scalars ----------------------------------------------------------------------


_ID = "printf('%d-%02d-%d', o_orderkey + 100, o_custkey % 100, o_orderkey % 10)"


@query(f"""SELECT o_orderkey, identifier, regexp_matches(identifier, '^\\d{{2,7}}-\\d{{2}}-\\d$') AS format_ok, regexp_matches(identifier, '^\\d{{2,7}}-\\d{{2}}-\\d$') AND
 (list_sum(list_transform(range(2, length(d) + 1), lambda i: (i - 1) * CAST(d[i] AS INT))) % 10 = CAST(d[1] AS INT)) AS check_ok
FROM (SELECT o_orderkey, {_ID} AS identifier, reverse(replace({_ID}, '-', '')) AS d FROM orders)""")
def f2_f3_identifiers(t):
    code = F.format_string("%d-%02d-%d", F.col("o_orderkey") + 100, F.col("o_custkey") % 100, F.col("o_orderkey") % 10)
    df = t.orders.select("o_orderkey", S.clean_identifier(code).alias("identifier"))
    return df.select("*", S.identifier_format_ok(F.col("identifier")).alias("format_ok"), S.check_digit_ok(F.col("identifier")).alias("check_ok"))


@query("SELECT p_partkey, string_split(lower(p_name), ' ') AS labels FROM part")
def f4_label_lists(t):
    literal = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("; ")))
    return t.part.select("p_partkey", S.parse_labels(literal).alias("labels"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_name WHEN p_partkey % 3 = 2 THEN NULL ELSE p_name || '+x' END AS label, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 2 THEN 1.0 END AS score,
 CASE p_partkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'label_without_score' ELSE 'missing_label' END AS status FROM part""")
def f6_label_scores(t):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat("p_name", F.lit("+x+"), F.col("p_size").cast("string"))).when(k == 1, F.col("p_name")).otherwise("+1")
    return t.part.select("p_partkey", S.parse_label_score(text).alias("s")).select("p_partkey", "s.label", "s.score", "s.status")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS response, CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS level,
 least(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)) || '__' || greatest(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)) AS pair, coalesce(printf('%.2f', CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 'NA') AS price FROM orders""")
def f7_f9_f11_f30_words_and_keys(t):
    k, n = F.col("o_orderkey") % 4, F.col("o_orderkey") % 3
    word = F.when(k == 0, " Yes ").when(k == 1, "0.0").when(k == 2, "responsive").otherwise("maybe")
    level = F.when(n == 0, "HIGH").when(n == 1, " low").otherwise("none")
    key = S.pair_key(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    price = S.fixed_decimal(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), 2)
    return t.orders.select("o_orderkey", S.parse_response(word).alias("response"), S.level_rank(level).alias("level"), key.alias("pair"), price.alias("price"))


@query("""WITH s AS (SELECT user_id, list_distinct(list(CAST(floor(value) AS INT) % 12)) AS x FROM events WHERE value > 20 GROUP BY 1)
SELECT a.user_id AS a, b.user_id AS b, round(len(list_intersect(a.x, b.x)) / nullif(len(list_distinct(list_concat(a.x, b.x))), 0), 6) AS similarity
FROM s a JOIN s b ON a.user_id % 50 = 0 AND a.user_id <> b.user_id""")
def f12_jaccard(t):
    sets = t.events.filter("value > 20").groupBy("user_id").agg(F.collect_set((F.floor("value").cast("int") % 12)).alias("x"))
    pairs = T.pairs_with_asked(sets, "user_id % 50 = 0", [], "user_id", ["x"])
    return pairs.select("a", "b", r(S.jaccard(F.col("x_a"), F.col("x_b")), "similarity"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance,
 CASE WHEN round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) <= 1.0 THEN 'near' WHEN round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) <= 1.3 THEN 'middle' ELSE 'far' END AS class
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id""")
def f15_f17_m13_distances(t):
    v = t.embeddings.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = T.pairs_with_asked(v, "vec_id % 50 = 0", ["label"], "vec_id", ["v"]).withColumn("distance", r(S.euclidean(F.col("v_a"), F.col("v_b"))))
    return pairs.select("a", "b", "distance", S.class_by_thresholds(F.col("distance"), {"near": 1.0, "middle": 1.3}, "far").alias("class"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST('0x' || substr(sha256(l_orderkey || '|' || l_linenumber), 1, 7) AS BIGINT) + 1 AS seed,
 sha256(l_orderkey || '|' || l_linenumber) AS digest, md5(CAST(l_partkey AS VARCHAR)) AS short_digest FROM lineitem""")
def f24_f26_seeds_and_digests(t):
    keys = [F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.seed_from(keys).alias("seed"), F.sha2(F.concat_ws("|", *keys), 256).alias("digest"), F.md5(F.col("l_partkey").cast("string")).alias("short_digest"))


@query("SELECT p_partkey, i AS shard, p_size // 4 + (i < p_size % 4)::int AS n FROM part, range(4) s(i)")
def f25_even_shares(t):
    shards = t.part.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return shards.select("p_partkey", F.col("i").cast("long").alias("shard"), S.even_share(F.col("p_size"), F.lit(4), F.col("i")).alias("n"))


@query("SELECT s_suppkey, CAST(regexp_extract(s_name, 'Supplier#(\\d+)$', 1) AS INT) AS number, round((s_acctbal / 10000 - 0.5) / (1 - 0.5), 6) AS reduction FROM supplier")
def f27_f32_numbers(t):
    return t.supplier.select("s_suppkey", S.trailing_number(F.col("s_name"), "Supplier#").alias("number"), r(S.error_reduction(F.col("s_acctbal") / 10000, F.lit(0.5)), "reduction"))


# Features, splits, model measures ------------------------------------------------


def _line_features(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.col(c) for c in ("l_quantity", "l_discount", "l_tax")])


@query("""WITH p AS (SELECT avg(l_quantity) m1, stddev_pop(l_quantity) s1, avg(l_tax) m2, stddev_pop(l_tax) s2 FROM lineitem WHERE l_orderkey % 3 <> 0)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m1) / s1, 6) AS l_quantity, round((l_tax - m2) / s2, 6) AS l_tax FROM lineitem, p WHERE l_orderkey % 3 = 0""")
def m7_standardize(t):
    df = _line_features(t).drop("l_discount")
    (_, test), _ = M.standardize(df.filter("l_orderkey % 3 <> 0"), [df.filter("l_orderkey % 3 = 0")], ["l_quantity", "l_tax"])
    return test.withColumns({c: r(c) for c in ("l_quantity", "l_tax")})


@query("""SELECT 'copy' AS feature, 'correlated' AS reason, 1.0 AS value, 'l_quantity' AS partner UNION ALL SELECT 'flat', 'zero_variance', 0.0, NULL
UNION ALL SELECT 'holes', 'missing', round(count(*) FILTER (l_quantity > 40) / count(*), 6), NULL FROM lineitem""")
def m3_m6_usable_features(t):
    df = _line_features(t).withColumns({"copy": F.col("l_quantity") * 0.5 + 1, "flat": F.lit(2.0), "holes": F.when(F.col("l_quantity") <= 40, F.col("l_tax"))})
    _, log = M.usable_features(df, ["l_quantity", "l_discount", "l_tax", "copy", "flat", "holes"])
    return log.withColumn("value", r("value"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 OR o_custkey % 7 = 0 THEN 'test' ELSE 'train' END AS part FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 7 = 0 OR o_custkey % 2 = 0""")
def m9_apply_split(t):
    keys = t.orders.select("o_custkey").distinct()
    return M.apply_split(t.orders, keys.filter("o_custkey % 2 = 0 or o_custkey % 5 = 0"), keys.filter("o_custkey % 5 = 0 or o_custkey % 7 = 0"), "o_custkey").select("o_orderkey", "part")


_HALVES = "(SELECT o_custkey AS k FROM orders WHERE o_orderkey % 4 = 0) a", "(SELECT o_custkey AS k FROM orders WHERE o_orderkey % 9 = 0) b"


@query(f"""WITH a AS (SELECT * FROM {_HALVES[0]}), b AS (SELECT * FROM {_HALVES[1]}), u AS (SELECT k FROM a UNION SELECT k FROM b)
SELECT 'train_rows' AS metric, CAST((SELECT count(*) FROM a) AS DOUBLE) AS value UNION ALL SELECT 'test_rows', (SELECT count(*) FROM b)
UNION ALL SELECT 'train_duplicates', (SELECT count(*) - count(DISTINCT k) FROM a) UNION ALL SELECT 'test_duplicates', (SELECT count(*) - count(DISTINCT k) FROM b)
UNION ALL SELECT 'overlap_keys', (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) UNION ALL SELECT 'keys_not_in_reference', (SELECT count(*) FROM u WHERE k NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'coverage', round((SELECT count(*) FROM u WHERE k IN (SELECT c_custkey FROM customer)) / (SELECT count(*) FROM customer), 6)""")
def m11_split_audit(t):
    keys = lambda where: t.orders.filter(where).select(F.col("o_custkey").alias("k"))
    return M.split_audit(keys("o_orderkey % 4 = 0"), keys("o_orderkey % 9 = 0"), t.customer.select(F.col("c_custkey").alias("k")), "k").withColumn("value", r("value"))


@query("SELECT label AS g, count(*) AS n, count(DISTINCT vec_id) AS n_ids FROM embeddings GROUP BY 1")
def m14_average_linkage_groups(t):
    v = t.embeddings.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("g"))
    made = M.average_linkage(v, "g", "vec_id", "v", [0.8, 1.1])
    return made.filter("cutoff = 0.8").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_ids"))


#: Distinct words of every text, the least document with the same words, and pairs of such documents that are alike.
_SETS = """s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(string_split(lower(coalesce(text, '')), ' '))) AS x FROM documents),
 c AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS class, x FROM s), v AS MATERIALIZED (SELECT * FROM c WHERE doc_id = class),
 q AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.x, b.x)) AS i, len(a.x) + len(b.x) AS n FROM v a JOIN v b ON a.doc_id < b.doc_id AND len(a.x) >= 0.8 * len(b.x) AND len(b.x) >= 0.8 * len(a.x)),
 p AS MATERIALIZED (SELECT a, b, i / (n - i) AS similarity FROM q WHERE i / (n - i) > 0.8)"""
_COMPONENTS = f"""{_SETS}, l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), g(id, low) AS (SELECT doc_id, doc_id FROM v UNION SELECT l.b, g.low FROM g JOIN l ON l.a = g.id),
 f AS MATERIALIZED (SELECT id, min(low) AS component FROM g GROUP BY 1), o AS MATERIALIZED (SELECT doc_id AS id, component, CASE WHEN substr(md5('42:' || component), 1, 8) < '4ccccccd' THEN 'test' ELSE 'train' END AS part FROM c JOIN f ON f.id = c.class)"""


def _word_classes(t):
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), " ")
    return files.shared_table(P.set_classes(t.documents.select("doc_id", words.alias("x")), "doc_id", "x"))


def _similar_classes(classes):
    return files.shared_table(M.similar_pairs(classes.filter("id = class"), "id", "items", 0.8))


def _disjoint(t):
    classes = _word_classes(t)
    found = P.components(classes.filter("id = class"), _similar_classes(classes)).withColumnRenamed("id", "class")
    return P.disjoint_split(classes.join(found, "class").select("id", "component"), 0.3)


@query(f"WITH {_SETS} SELECT a, b, round(similarity, 6) AS similarity FROM p")
def d1_similar_pairs(t):
    return _similar_classes(_word_classes(t)).withColumn("similarity", r("similarity"))


@query(f"WITH {_SETS} SELECT doc_id AS id, class FROM c")
def d1_set_classes(t):
    return _word_classes(t).select("id", "class")


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT * FROM o")
def d2_disjoint_split(t):
    return _disjoint(t)


@query(f"""WITH {_SETS}, h AS (SELECT doc_id AS id, CASE WHEN substr(md5('42:' || doc_id), 1, 8) < '4ccccccd' THEN 'test' ELSE 'train' END AS part FROM v),
 e AS (SELECT a, b, similarity FROM p UNION ALL SELECT b, a, similarity FROM p), m AS (SELECT e.a, max(similarity) AS m FROM e JOIN h ON h.id = e.b AND h.part = 'train' GROUP BY 1)
SELECT id, round(m, 6) AS max_train_similarity FROM h LEFT JOIN m ON m.a = h.id WHERE part = 'test'""")
def d2_max_train_similarity(t):
    classes = _word_classes(t)
    parts = P.disjoint_split(classes.filter("id = class").select("id", F.col("id").alias("component")), 0.3)
    return P.max_train_similarity(parts, _similar_classes(classes)).withColumn("max_train_similarity", r("max_train_similarity"))


_STRATA = """e AS (SELECT DISTINCT doc_id, unnest([lang, source]) AS label FROM documents), n AS (SELECT label, count(*) AS n FROM e WHERE label IS NOT NULL GROUP BY 1),
 s AS (SELECT doc_id, coalesce(arg_min(label, (n, label)), '') AS stratum FROM documents LEFT JOIN e USING (doc_id) LEFT JOIN n USING (label) GROUP BY 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM s),
 o AS (SELECT doc_id AS id, stratum, CASE WHEN k <= floor(n * 0.7 + 0.5) THEN 'train' ELSE 'test' END AS part FROM k)"""


def _stratified(t):
    return P.stratified_split(t.documents.select("doc_id", F.array("lang", "source").alias("labels")), "doc_id", "labels", 0.7)


@query(f"WITH {_STRATA} SELECT * FROM o")
def d3_stratified_split(t):
    return _stratified(t)


@query(f"WITH {_STRATA} SELECT stratum, count(*) AS n, count(*) FILTER (part = 'train') AS n_train, round(count(*) FILTER (part = 'train') / count(*), 6) AS train_share FROM o GROUP BY 1")
def d3_split_marginals(t):
    return P.split_marginals(_stratified(t)).withColumn("train_share", r("train_share"))


@query(f"""WITH {_STRATA}, j AS (SELECT md5(d.text) AS text_key, part FROM documents d JOIN o ON o.id = d.doc_id WHERE text IS NOT NULL)
SELECT text_key, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test FROM j GROUP BY 1 HAVING n_train > 0 AND n_test > 0""")
def d8_shared_keys(t):
    keys = t.documents.select(F.col("doc_id").alias("id"), F.md5("text").alias("text_key"))
    return P.shared_keys(keys.join(_stratified(t), "id"), "text_key")


@query("""WITH f AS (SELECT l_returnflag AS model, l_linestatus AS representation, l_linenumber % 5 + 1 AS k, round(avg(l_discount), 6) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT model, representation, round(avg(v), 5) AS mean, round(avg(v), 6) AS mean_computed, round(stddev_pop(v), 6) AS std, abs(round(avg(v), 5) - avg(v)) < 1e-6 AS agrees, max(v) FILTER (k = 1) AS fold_1, max(v) FILTER (k = 2) AS fold_2,
 max(v) FILTER (k = 3) AS fold_3, max(v) FILTER (k = 4) AS fold_4, max(v) FILTER (k = 5) AS fold_5 FROM f GROUP BY 1, 2""")
def d10_metric_documents(t):
    keys = [F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("representation")]
    each = t.lineitem.groupBy(*keys, (F.col("l_linenumber") % 5 + 1).alias("fold")).agg(r(F.avg("l_discount"), "v"))  # five folds
    folds = F.transform(F.array_sort(F.collect_list(F.struct("fold", "v"))), lambda s: s["v"])
    docs = each.groupBy("model", "representation").agg(F.round(F.avg("v"), 5).alias("mean"), folds.alias("folds"))
    made = P.metric_table(docs.select(F.to_json(F.struct("*")).alias("j")), "j", 5)
    return made.withColumns({c: r(c) for c in ("mean_computed", "std")})


@query("""WITH k AS (SELECT source, toxic, n_chars, avg(rk) OVER (PARTITION BY source, n_chars) AS rk FROM (SELECT source, toxic, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS rk FROM documents JOIN labels USING (doc_id)))
SELECT source, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS n_positive, round((sum(rk * toxic) - sum(toxic) * (sum(toxic) + 1) / 2) / nullif(sum(toxic) * (count(*) - sum(toxic)), 0), 6) AS auc FROM k GROUP BY 1""")
def d5_auc(t):
    return E.auc(t.documents.join(t.labels, "doc_id"), ["source"], "toxic", "n_chars").withColumn("auc", r("auc"))


@query("""SELECT l_returnflag, round(2 * covar_pop(l_discount, l_tax) / (var_pop(l_discount) + var_pop(l_tax) + (avg(l_discount) - avg(l_tax)) ** 2), 6) AS concordance FROM lineitem GROUP BY 1""")
def d6_concordance_coefficient(t):
    return M.concordance_coefficient(t.lineitem, ["l_returnflag"], "l_discount", "l_tax").withColumn("concordance", r("concordance"))


@query("""WITH k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS n, v FROM (SELECT user_id, event_type, round(sum(value), 6) AS v FROM events GROUP BY 1, 2)),
e AS (SELECT *, min(n) OVER w AS r0, max(n) OVER w AS r1, first_value(v) OVER (PARTITION BY user_id ORDER BY n) AS v0, first_value(v) OVER (PARTITION BY user_id ORDER BY n DESC) AS v1 FROM k WINDOW w AS (PARTITION BY user_id)),
g AS (SELECT user_id, n, round(coalesce(v0 + (v1 - v0) * (n - r0) / nullif(r1 - r0, 0) - v, 0), 9) AS gap FROM e)
SELECT user_id, CAST(arg_min(n, (-gap, n)) AS INT) AS knee FROM g GROUP BY 1""")
def d4_knee(t):
    from pyspark.sql import Window

    sums = t.events.groupBy("user_id", "event_type").agg(r(F.sum("value"), "v"))
    ranked = sums.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("v"), "event_type")))
    return M.knee(ranked, "user_id", "n", "v")


@query("""WITH d AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, round(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings q JOIN embeddings b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM d) SELECT query, neighbour, distance, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5""")
def d7_nearest(t):
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return E.nearest(v.filter("vec_id % 50 = 0"), v, "vec_id", "v", 5)


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS sd0, round(stddev_samp(l_discount), 6) AS sd1,
 CAST(row_number() OVER (ORDER BY round(avg(l_discount), 6) DESC, l_returnflag, l_linestatus) AS INT) AS rank FROM lineitem GROUP BY 1, 2""")
def d9_importance(t):
    return Y.importance(t.lineitem, ["l_returnflag", "l_linestatus"], "l_discount")


# Groups -----------------------------------------------------------------------


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS ordinal FROM events")
def w8_group_ordinals(t):
    return G.group_ordinals(t.events, ["user_id"], ["ts", "event_id"]).select("event_id", "ordinal")


_CLUSTERS = """n AS (SELECT user_id, event_type, count(*) AS n, min(value) AS low FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2),
 k AS (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, low NULLS LAST, event_type) AS INT) AS cluster FROM n), e AS (SELECT * FROM events LEFT JOIN k USING (user_id, event_type))"""


def _clusters(t):
    return G.stable_labels(t.events, ["user_id"], "event_type", "value")


@query(f"WITH {_CLUSTERS} SELECT event_id, cluster FROM e")
def w9_stable_labels(t):
    return _clusters(t).select("event_id", "cluster")


@query("SELECT user_id, arg_min(event_id, (value, event_id)) FILTER (value IS NOT NULL) AS event_id FROM events GROUP BY 1")
def w10_first_min(t):
    return t.events.groupBy("user_id").agg(G.first_min("value", "event_id", "event_id").alias("event_id"))


@query(f"""WITH {_CLUSTERS}, m AS (SELECT user_id, cluster, arg_min(event_id, (abs(value - 50), event_id)) FILTER (value IS NOT NULL) AS event_id FROM e WHERE cluster <= 3 GROUP BY 1, 2)
SELECT user_id, CASE WHEN cluster = 1 THEN 'dominant_cluster_medoid' ELSE printf('cluster_%03d_medoid', cluster) END AS role, event_id FROM m WHERE event_id IS NOT NULL
UNION ALL SELECT user_id, 'global_lowest_energy', arg_min(event_id, (value, event_id)) FROM events WHERE value IS NOT NULL GROUP BY 1""")
def w11_representatives(t):
    rows = _clusters(t).withColumn("distance", F.abs(F.col("value") - 50))
    return G.representatives(rows, ["user_id"], "cluster", "event_id", "distance", "value", "event_id", top=3)


@query("SELECT o_orderkey, o_orderstatus IS NOT DISTINCT FROM first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS same_as_first FROM orders")
def w13_same_as_first(t):
    return G.same_as_first(t.orders, ["o_custkey"], ["o_orderkey"], "o_orderstatus").select("o_orderkey", "same_as_first")


@query("""WITH m AS (SELECT 'orders' AS section, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'orders', 'repeated_keys', count(*) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'lineitem', 'no_quantity', count(*) - count(l_quantity) FROM lineitem UNION ALL SELECT 'lineitem', 'line_numbers', count(DISTINCT l_linenumber) FROM lineitem), x AS (
SELECT *, CASE metric WHEN 'repeated_keys' THEN 0.0 WHEN 'no_quantity' THEN 0.0 WHEN 'line_numbers' THEN 6.0 END AS expected FROM m) SELECT *, CASE WHEN expected IS NOT NULL THEN value = expected END AS matches FROM x""")
def a26_expected_audit(t):
    n = F.count(F.lit(1))
    orders = M.long_metrics(t.orders, {"rows": n, "repeated_keys": n - F.countDistinct("o_orderkey")}).withColumn("section", F.lit("orders"))
    lines = M.long_metrics(t.lineitem, {"no_quantity": n - F.count("l_quantity"), "line_numbers": F.countDistinct("l_linenumber")}).withColumn("section", F.lit("lineitem"))
    return M.expected_audit(orders.unionByName(lines), {("orders", "repeated_keys"): 0, ("lineitem", "no_quantity"): 0, ("lineitem", "line_numbers"): 6})
