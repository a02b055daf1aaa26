"""Queries of the check suite, feature tables, encoded scans, split tables, evaluation and run summaries, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import audits as A
from quillon.operators import checks as C
from quillon.operators import evaluation as E
from quillon.operators import measures as M
from quillon.operators import splits as P
from quillon.operators import summaries as Y
from quillon.operators import tables as T
from quillon.plans.registry import _line_features, _turn_lines, query, r
from quillon.sources import files, scans

# Checks ---------------------------------------------------------------------------


def _row(check: str, table: str, holds: str, observed: str, expected: str) -> str:
    """SQL for one row of a suite: observed and holds over a one-row FROM."""
    source, _, shown = observed.partition("|")
    return f"SELECT '{check}' AS \"check\", '{table}' AS \"table\", CASE WHEN {holds} THEN 'PASS' ELSE 'FAIL' END AS status, {shown} AS observed, CASE WHEN {holds} THEN '' ELSE '{expected}' END AS message FROM ({source})"


_CHECKS = "\nUNION ALL ".join((
    _row("order keys are known", "orders", "n = 0", "SELECT count(*) FILTER (o_orderkey IS NULL) AS n FROM orders|'missing=' || n", "no order without a key"),
    _row("prices are positive", "orders", "n = 0", "SELECT count(*) FILTER (o_totalprice <= 0) AS n FROM orders|'bad=' || n", "no price of zero or less"),
    _row("orders are as many as ever", "orders", "n = 150000", "SELECT count(*) AS n FROM orders|'rows=' || n", "150000 orders"),
    _row("order keys are unique", "orders", "n = d", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d FROM orders|'n_rows=' || n || '; n_distinct=' || d || '; n_duplicates=' || (n - d)", "each key once"),
    _row("orders have customers", "orders", "n = 0", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)|'orphans=' || n", "every customer is known"),
    "SELECT 'a column that is gone', 'orders', 'ERROR', '', 'UNRESOLVED_COLUMN.WITH_SUGGESTION'",
    _row("quantities are in range", "lineitem", "a >= 1 AND b <= 50", "SELECT CAST(min(l_quantity) AS BIGINT) AS a, CAST(max(l_quantity) AS BIGINT) AS b FROM lineitem|'least=' || a || '; most=' || b", "1 to 50"),
    _row("discounts are shares", "lineitem", "n = 0", "SELECT count(*) FILTER (l_discount < 0 OR l_discount >= 1) AS n FROM lineitem|'bad=' || n", "0 up to 1"),
    _row("flags are known", "lineitem", "n = 0", "SELECT count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS n FROM lineitem|'bad=' || n", "A, N or R"),
    _row("lines have orders", "lineitem", "n = 0", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)|'orphans=' || n", "every order is known"),
    _row("customers are named", "customer", "n = 0", "SELECT count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) AS n FROM customer|'bad=' || n", "Customer# and nine digits"),
    _row("no customer is in debt", "customer", "n = 0", "SELECT count(*) FILTER (c_acctbal < 0) AS n FROM customer|'bad=' || n", "no balance below zero"),
    "SELECT 'names are numbers', 'customer', 'ERROR', '', 'CAST_INVALID_INPUT'",
))


@query(_CHECKS)
def x212_check_suite(t):
    suite = C.CheckSuite()
    none = lambda row: row[0] == 0
    suite.measure("order keys are known", "orders", "no order without a key", none, missing=F.count_if(F.col("o_orderkey").isNull()))
    suite.measure("prices are positive", "orders", "no price of zero or less", none, bad=F.count_if(F.col("o_totalprice") <= 0))
    suite.measure("orders are as many as ever", "orders", "150000 orders", lambda row: row.rows == 150_000, rows=F.count(F.lit(1)))

    @suite.rule("order keys are unique", "orders", "each key once")
    def unique(tables):
        return M.duplicate_count(tables["orders"], ["o_orderkey"]).withColumn("holds", F.col("n_duplicates") == 0)

    def orphans(child: str, key: str, parent: str, parent_key: str):
        def rule(tables):
            gone = tables[child].join(tables[parent].select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
            return gone.agg(F.count(F.lit(1)).alias("orphans")).withColumn("holds", F.col("orphans") == 0)

        return rule

    suite.rule("orders have customers", "orders", "every customer is known")(orphans("orders", "o_custkey", "customer", "c_custkey"))
    suite.measure("a column that is gone", "orders", "never", none, bad=F.count_if(F.col("o_gone") > 0))
    suite.measure("quantities are in range", "lineitem", "1 to 50", lambda row: row.least >= 1 and row.most <= 50, least=F.min("l_quantity").cast("long"), most=F.max("l_quantity").cast("long"))
    suite.measure("discounts are shares", "lineitem", "0 up to 1", none, bad=F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") >= 1)))
    suite.measure("flags are known", "lineitem", "A, N or R", none, bad=F.count_if(~F.col("l_returnflag").isin("A", "N", "R")))
    suite.rule("lines have orders", "lineitem", "every order is known")(orphans("lineitem", "l_orderkey", "orders", "o_orderkey"))
    suite.measure("customers are named", "customer", "Customer# and nine digits", none, bad=F.count_if(~F.col("c_name").rlike("^Customer#[0-9]{9}$")))
    suite.measure("no customer is in debt", "customer", "no balance below zero", none, bad=F.count_if(F.col("c_acctbal") < 0))
    suite.measure("names are numbers", "customer", "never", none, bad=F.count_if(F.col("c_name").cast("long") < 0))
    return suite.run({"orders": t.orders, "lineitem": t.lineitem, "customer": t.customer})


# Features and profiles --------------------------------------------------------------

_FEATURE_SQL = """f AS (SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity - 1, 0) AS price_above_one, CASE WHEN l_discount > 0 THEN ln(l_discount) WHEN l_discount = 0 THEN CAST('-Infinity' AS DOUBLE) END AS log_discount,
 TRY_CAST(nullif(l_returnflag, 'A') AS DOUBLE) AS flag_number, l_quantity * l_tax AS taxed FROM lineitem WHERE l_linenumber < 6)"""
_FEATURE_NAMES = ("price_above_one", "log_discount", "flag_number", "taxed")


def _feature_table(t):
    discount = F.col("l_discount")
    features = {
        "price_above_one": F.try_divide("l_extendedprice", F.col("l_quantity") - 1), "log_discount": F.when(discount > 0, F.ln(discount)).when(discount == 0, F.lit(float("-inf"))),
        "flag_number": F.col("l_returnflag").try_cast("double"), "taxed": F.col("l_quantity") * F.col("l_tax"),
    }
    return C.feature_table(t.lineitem, ["l_orderkey", "l_linenumber"], features, F.col("l_linenumber") < 6, "line_number_too_large")


@query(f"""WITH {_FEATURE_SQL} SELECT l_orderkey, l_linenumber, round(price_above_one, 6) AS price_above_one, round(CASE WHEN isinf(log_discount) THEN NULL ELSE log_discount END, 6) AS log_discount, flag_number, round(taxed, 6) AS taxed FROM f""")
def m2_feature_table(t):
    made, _, _ = _feature_table(t)
    return made.withColumns({c: r(c) for c in ("price_above_one", "log_discount", "taxed")})


@query(f"WITH {_FEATURE_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) AS n_rows, count(*) - count(CASE WHEN NOT isinf({c}) THEN 1 END) AS n_missing, round((count(*) - count(CASE WHEN NOT isinf({c}) THEN 1 END)) / count(*), 6) AS missing_fraction,
 count(*) FILTER (isinf({c})) AS n_infinite, count(*) - count({c}) AS n_failed, count(CASE WHEN NOT isinf({c}) THEN 1 END) = 0 AS all_missing FROM f""" for c in _FEATURE_NAMES
))
def m2_feature_failures(t):
    _, report, _ = _feature_table(t)
    return report.withColumn("missing_fraction", r("missing_fraction"))


@query("SELECT l_orderkey, l_linenumber, 'line_number_too_large' AS reason FROM lineitem WHERE l_linenumber >= 6")
def m2_invalid_rows(t):
    return _feature_table(t)[2]


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"


@query(f"SELECT doc_id, len({_WORDS}) AS on_bits_most, {_WORDS} <> [] AS has_words FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def m1_fingerprint_counts(t):
    made, _ = M.fingerprint_table(t.documents, ["doc_id"], F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), S.blank_to_null(F.col("text")).isNotNull())
    # A set bit stands for one word or more; without collisions there are as many as distinct words.
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    both = t.documents.select("doc_id", F.size(words).cast("long").alias("on_bits_most")).join(made, "doc_id")
    fits = (F.col("on_bits") <= F.least(F.col("on_bits_most"), F.lit(1024))) & (F.abs(F.col("density") - F.col("on_bits") / 1024) < 1e-12)
    return both.filter(fits).select("doc_id", "on_bits_most", (F.col("on_bits") > 0).alias("has_words"))


_BIT_SETS = "s AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey % 1024))) AS x FROM lineitem GROUP BY 1)"


@query(f"WITH {_BIT_SETS} SELECT id, len(x) AS on_bits, round(len(x) / 1024, 9) AS density FROM s")
def m1_fingerprint_table(t):
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set((F.col("l_partkey") % 1024).cast("int")).alias("bits"))
    return sets.select("id", S.packed_bits("bits").alias("words")).select("id", S.bits_on("words").alias("on_bits"), F.round(S.bits_on("words") / 1024, 9).alias("density"))


@query(f"""WITH {_BIT_SETS} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))), 6) AS tanimoto
FROM s a JOIN s b ON a.id % 50 = 0 AND a.id <> b.id WHERE list_has_any(a.x, b.x)""")
def m1_f14_packed_tanimoto(t):
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set((F.col("l_partkey") % 1024).cast("int")).alias("bits"))
    return T.overlapping_with_asked(sets, "id % 50 = 0", "id", "bits", 1024).select("a", "b", S.rounded_share(F.col("shared"), F.col("either")).alias("tanimoto"))


# Evaluation -----------------------------------------------------------------------


def _auc_sql(keys: str) -> str:
    by = f"PARTITION BY model{keys}"
    return f"""SELECT model{keys}, count(*) AS n, sum(y) AS p, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc
 FROM (SELECT *, avg(k) OVER ({by}, s) AS rk FROM (SELECT *, row_number() OVER ({by} ORDER BY s) AS k FROM m)) GROUP BY model{keys}"""


@query(f"""WITH m AS (SELECT source AS label, toxic AS y, unnest([1, 2]) AS model, unnest([n_chars, -doc_id]) AS s FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL),
l AS ({_auc_sql(", label")}), p AS ({_auc_sql("")}), x AS (SELECT 'label' AS scope, label, model, auc FROM l UNION ALL SELECT 'micro', NULL, model, auc FROM p UNION ALL SELECT 'macro', NULL, model, avg(auc) FROM l GROUP BY model)
SELECT scope, label, round(max(auc) FILTER (model = 1), 6) AS auc_first, round(max(auc) FILTER (model = 2), 6) AS auc_second, round(max(auc) FILTER (model = 2) - max(auc) FILTER (model = 1), 6) AS delta FROM x GROUP BY 1, 2""")
def d5_auc_differences(t):
    rows = t.documents.join(t.labels, "doc_id").withColumn("other", -F.col("doc_id"))
    return E.auc_differences(rows, "source", "toxic", "n_chars", "other").withColumns({c: r(c) for c in ("auc_first", "auc_second", "delta")})


@query(f"""WITH d AS (SELECT q.vec_id AS query, b.vec_id AS nb, b.label AS nl, round(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS d FROM embeddings q JOIN embeddings b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, nb) <= 5), q AS (SELECT vec_id AS query, label AS own FROM embeddings WHERE vec_id % 50 = 0),
ls AS (SELECT own AS l FROM q UNION SELECT nl FROM k), m AS (SELECT 1 AS model, CAST(l AS VARCHAR) AS label, (own = l)::int AS y, (SELECT count(*) FROM k WHERE k.query = q.query AND nl = l) AS s FROM q, ls),
lab AS ({_auc_sql(", label")}), p AS ({_auc_sql("")})
SELECT 'label' AS scope, label, n, CAST(p AS BIGINT) AS n_positive, round(auc, 6) AS auc FROM lab UNION ALL SELECT 'micro', NULL, n, CAST(p AS BIGINT), round(auc, 6) FROM p
UNION ALL SELECT 'macro', NULL, CAST(sum(n) AS BIGINT), CAST(sum(p) AS BIGINT), round(avg(auc), 6) FROM lab WHERE auc IS NOT NULL""")
def d7_neighbour_auc(t):
    return E.neighbour_auc(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", "label", 5).withColumn("auc", r("auc"))


@query("SELECT a, b, round(r, 6) AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in (("l_discount", "l_extendedprice"), ("l_discount", "l_quantity"), ("l_extendedprice", "l_quantity"))
) + ")")
def o3_correlation_table(t):
    names = ["l_discount", "l_extendedprice", "l_quantity"]
    return A.correlated_pairs(t.lineitem, names, -1.0).withColumn("r", r("r"))


@query("SELECT label, vec_id // 250 AS block, count(*) AS n, 0 AS n_close, 0 AS n_loose FROM embeddings GROUP BY 1, 2")
def m14_linkage_checks(t):
    """Clusters of blocks of rows of a label at cut 1.1: no two of them lie within the cut on average, and each of several rows has two within it."""
    v = t.embeddings.select("label", F.floor(F.col("vec_id") / 250).alias("block"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = files.shared_table(v.withColumn("g", F.concat_ws("/", "label", "block")))
    made = files.shared_table(M.average_linkage(v.select("g", "vec_id", "v"), "g", "vec_id", "v", [1.1]).join(v.drop("g"), "vec_id"))
    side = lambda s: made.select("g", F.col("vec_id").alias(s), F.col("cluster").alias(f"c{s}"), F.col("v").alias(f"v{s}"))
    pairs = side("a").join(side("b"), "g").filter("a < b")  # groups of bounded size
    between = pairs.filter("ca <> cb").groupBy("g", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.avg(S.euclidean(F.col("va"), F.col("vb"))).alias("d"))
    close = between.groupBy("g").agg(F.count_if(F.col("d") <= 1.1 - 1e-9).alias("n_close"))
    within = pairs.filter("ca = cb").groupBy("g", "ca").agg(F.min(S.euclidean(F.col("va"), F.col("vb"))).alias("d")).groupBy("g").agg(F.count_if(F.col("d") > 1.1 + 1e-9).alias("n_loose"))
    counts = made.groupBy("g", "label", "block").agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(close, "g", "left").join(within, "g", "left").select("label", "block", "n", zero("n_close"), zero("n_loose"))


# Splits ----------------------------------------------------------------------------

_SEEDS = (42, 43, 44, 45, 46)
_SPLIT_SQL = """e AS (SELECT o_orderkey AS id, o_orderpriority AS stratum FROM orders),
k AS (SELECT seed, id, row_number() OVER (PARTITION BY seed, stratum ORDER BY md5(seed || ':' || id), id) AS k, count(*) OVER (PARTITION BY seed, stratum) AS n FROM e, (SELECT unnest([42, 43, 44, 45, 46]) AS seed)),
o AS (SELECT seed, CASE WHEN k <= floor(n * 0.7 + 0.5) THEN 'train' ELSE 'test' END AS part, id FROM k)"""


def _split_table(t):
    rows = t.orders.select("o_orderkey", F.array("o_orderpriority").alias("labels"))
    return P.write_split_table({seed: P.stratified_split(rows, "o_orderkey", "labels", 0.7, seed) for seed in _SEEDS}, files.new_path(t.spark, "splits"))


@query(f"WITH {_SPLIT_SQL} SELECT seed, part, id FROM o")
def s12_split_table(t):
    return _split_table(t)


@query(f"WITH {_SPLIT_SQL} SELECT seed, part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o JOIN orders ON o_orderkey = id WHERE seed IN (43, 45) GROUP BY 1, 2")
def s12_apply_split_table(t):
    asked = files.shared_table(t.spark.createDataFrame([(s, "final" if s in (43, 45) else "trial") for s in _SEEDS], "seed int, use string")).filter("use = 'final'")
    applied = P.apply_split_table(t.orders, _split_table(t), asked, "o_orderkey")
    return applied.groupBy("seed", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_LABEL_LISTS = "SELECT doc_id, list_distinct(list_filter([lang, source, CASE WHEN n_chars % 3 = 0 THEN 'third' END, CASE WHEN n_chars > 2000 THEN 'long' END], lambda x: x IS NOT NULL)) AS labels FROM documents"


@query(f"SELECT seed, label, count(*) AS n, true AS in_bounds FROM ({_LABEL_LISTS}), unnest(labels) AS u(label), (SELECT unnest([42, 43, 44, 45, 46]) AS seed) GROUP BY 1, 2")
def d3_iterative_marginals(t):
    """Every label of every seed is within one row or one in a hundred of 70 to 30."""
    own = F.array("lang", "source", F.when(F.col("n_chars") % 3 == 0, "third"), F.when(F.col("n_chars") > 2000, "long"))
    rows = files.shared_table(t.documents.select("doc_id", own.alias("labels")))
    out = P.label_marginals(P.iterative_splits(rows, "doc_id", "labels", 0.7, _SEEDS), rows, "doc_id", "labels", ["seed"])
    bound = F.greatest(F.lit(1.0), F.col("n") / 100) + 1e-6
    return out.select("seed", "label", "n", (F.abs(F.col("n_train") - 0.7 * F.col("n")) <= bound).alias("in_bounds"))


# Scans and sinks -----------------------------------------------------------------------

#: A word that only one of the encodings reads, for each of them.
_ENCODED = (("utf-8", "naïve"), ("utf-8-sig", "größe"), ("gbk", "香气"), ("latin1", "café"))


@query("""WITH c AS (SELECT c_custkey, c_custkey // 400 AS f, (c_custkey // 400) % 4 AS e, c_name FROM customer)
SELECT CASE e WHEN 2 THEN 'gbk' WHEN 3 THEN 'latin1' ELSE 'utf-8' END AS encoding, CASE e WHEN 0 THEN 'naïve' WHEN 1 THEN 'größe' WHEN 2 THEN '香气' ELSE 'café' END AS word,
 count(DISTINCT f) AS n_files, count(*) AS n_rows, CAST(sum(c_custkey) AS BIGINT) AS keys, min(c_name) AS first_name FROM c GROUP BY 1, 2""")
def s1_encoded_scan(t):
    found, facts = _encoded_files(t)
    named = scans.named_cells(found, facts, ["key", "name", "word"]).join(facts.filter("status = 'PASS'").select("path", "encoding"), "path")
    return named.groupBy("encoding", "word").agg(F.countDistinct("path").alias("n_files"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("key").cast("long")).alias("keys"), F.min("name").alias("first_name"))


def _encoded_files(t):
    """Customers in files of 400 keys, each file in one of four encodings."""
    file = F.floor(F.col("c_custkey") / 400)
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in _ENCODED]), (file % 4 + 1).cast("int"))
    lines = t.customer.select(file.alias("f"), "c_custkey", F.concat_ws(",", "c_custkey", "c_name", pick(1)).alias("line"), pick(0).alias("encoding"))
    texts = lines.groupBy("f", "encoding").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda s: s["line"]), "\n").alias("body"))
    whole = texts.select(F.format_string("part-%05d.csv", "f").alias("name"), F.concat(F.lit("key,name,word\n"), "body", F.lit("\n")).alias("text"), "encoding")
    path = files.new_path(t.spark, "encoded")
    scans.write_encoded(whole, path)
    facts, found = scans.scan_delimited(t.spark, path)
    return found, facts


@query("""SELECT status, issue, name, n_rows, n_columns, n_ragged FROM (
SELECT 'PASS' AS status, NULL AS issue, 'nation.csv' AS name, count(*) AS n_rows, 3 AS n_columns, 0::BIGINT AS n_ragged FROM nation UNION ALL SELECT 'FAIL', 'header only; no data rows', 'empty.tsv', 0, 2, 0
UNION ALL SELECT 'PASS', NULL, 'halogen_bonds.tsv', 0, 2, 0 UNION ALL SELECT 'FAIL', 'empty file', 'nothing.csv', 0, 0, 0
UNION ALL SELECT 'FAIL', count(*) FILTER (n_nationkey % 5 = 0) || ' rows have inconsistent column count', 'ragged.csv', count(*), 3, count(*) FILTER (n_nationkey % 5 = 0) FROM nation)""")
def s4_delimited_report(t):
    cells = lambda extra: F.concat_ws(",", "n_nationkey", "n_name", F.concat("n_regionkey", extra))
    line = {"nation.csv": cells(F.lit("")), "ragged.csv": cells(F.when(F.col("n_nationkey") % 5 == 0, ",more").otherwise(""))}
    body = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", c.alias("line")))), lambda s: s["line"]), "\n")
    whole = None
    for name, c in line.items():
        one = t.nation.agg(F.concat(F.lit("key,name,region\n"), body(c)).alias("text")).withColumn("name", F.lit(name))
        whole = one if whole is None else whole.unionByName(one)
    heads = t.spark.createDataFrame([("a\tb\n", "empty.tsv"), ("a\tb\n", "halogen_bonds.tsv"), ("", "nothing.csv")], "text string, name string")
    path = files.new_path(t.spark, "delimited")
    scans.write_encoded(whole.unionByName(heads).withColumn("encoding", F.lit("utf-8")), path)
    facts, _ = scans.scan_delimited(t.spark, path)
    return facts.select("status", "issue", "name", "n_rows", "n_columns", "n_ragged")


@query("""WITH c AS (SELECT c_custkey // 400 AS f, count(*) AS n, sum(length(c_custkey || ',' || c_name) + 2 + CASE (c_custkey // 400) % 4 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 4 END) + 14 + CASE WHEN (c_custkey // 400) % 4 = 1 THEN 3 ELSE 0 END AS n_bytes FROM customer GROUP BY 1, c_custkey // 400)
SELECT printf('part-%05d.csv', f) AS name, '.csv' AS file_type, CAST(n_bytes AS BIGINT) AS n_bytes, 'readable' AS readable_status, CASE f % 4 WHEN 2 THEN 'gbk' WHEN 3 THEN 'latin1' ELSE 'utf-8' END AS encoding FROM c""")
def s10_file_inventory(t):
    _, facts = _encoded_files(t)
    path = facts.select(F.regexp_replace("path", "/[^/]*$", "").alias("p")).first()
    if path is None:
        return facts.select("name", F.lit(".csv").alias("file_type"), "n_bytes", F.lit("readable").alias("readable_status"), "encoding")
    found = scans.inventory(t.spark, path["p"], [".csv"])
    same = found.join(facts.select("name", F.col("sha256").alias("digest")), "name").filter("sha256 = digest")
    return same.select("name", "file_type", "n_bytes", "readable_status", "encoding")


@query("SELECT event_type AS key, event_id, value FROM events WHERE event_type IS NOT NULL")
def s2_stem_keyed_files(t):
    rows = t.events.filter("event_type is not null").select(F.col("event_type").alias("name"), "event_id", "value")
    lines = rows.withColumn("line", F.concat_ws(",", "event_id", F.coalesce(F.col("value").cast("string"), F.lit(""))))
    texts = lines.groupBy("name").agg(F.concat(F.lit("event_id,value\n"), F.array_join(F.collect_list("line"), "\n")).alias("text"))
    path = files.new_path(t.spark, "stems")
    scans.write_encoded(texts.select(F.concat("name", F.lit(".csv")).alias("name"), "text", F.lit("utf-8").alias("encoding")), path)
    return files.stem_keyed(t.spark, path, "event_id long, value double")


_EVENTS_SQL = """SELECT o_orderkey, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS event_type, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus WHEN l_linenumber % 3 = 1 THEN 'other' ELSE '' END AS name,
 CAST(l_linenumber AS VARCHAR) AS number FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') AND o_orderkey % 97 <> 0"""


@query(_EVENTS_SQL)
def s7_nested_events(t):
    found, _ = scans.nested_events(_order_documents(t), "xml", ["site", "lines"], {"acc": "accepted", "ret": "returned"}, {"name": ["status", "alt"], "number": ["nr"]})
    return found


@query("SELECT DISTINCT o_orderkey, 'no readable markup' AS reason FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 97 = 0")
def s7_broken_documents(t):
    return scans.nested_events(_order_documents(t), "xml", ["site", "lines"], {"acc": "accepted", "ret": "returned"}, {"name": ["status", "alt"], "number": ["nr"]})[1]


def _order_documents(t):
    """An XML document for each order with lines; status may be blank or absent, and some documents are cut off."""
    tag = F.when(F.col("l_returnflag") == "A", "acc").when(F.col("l_returnflag") == "R", "ret").otherwise("new")
    status = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("<status> "), "l_linestatus", F.lit(" </status>"))).when(F.col("l_linenumber") % 3 == 1, F.lit("<status> </status><alt>other</alt>")).otherwise("")
    line = F.concat(F.lit("<"), tag, F.lit(">"), status, F.lit("<nr>"), "l_linenumber", F.lit("</nr></"), tag, F.lit(">"))
    body = t.lineitem.withColumn("line", line).groupBy("l_orderkey").agg(F.array_join(F.collect_list("line"), "").alias("body"))
    xml = F.concat(F.lit("<report><site><lines>"), "body", F.when(F.col("o_orderkey") % 97 == 0, F.lit("</li")).otherwise(F.lit("</lines></site></report>")))
    return t.orders.join(body, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", xml.alias("xml"))


_BLOCKS_SQL = """b AS (SELECT conv_id, turn, role, length(text) AS n, sum((role = 'user')::int) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations),
g AS (SELECT conv_id, block, count(*) FILTER (role = 'user' AND n IS NOT NULL) AS n_values, count(*) FILTER (role = 'assistant' AND n IS NOT NULL) AS n_items, CAST(max(n) FILTER (role = 'user') AS DOUBLE) AS value FROM b WHERE block > 0 GROUP BY 1, 2)"""


def _turn_blocks(t):
    lines = t.conversations.select("conv_id", "turn", F.concat_ws(" ", "role", F.length("text").cast("string")).alias("line"))
    return files.block_table(lines, "conv_id", "turn", "line", "^user", r"^user (\d+)$", r"^assistant \d+$")


@query(f"WITH {_BLOCKS_SQL} SELECT conv_id, block, n_items, value FROM g WHERE n_values = 1 AND n_items > 0")
def s6_block_table(t):
    return _turn_blocks(t)[0]


@query(f"WITH {_BLOCKS_SQL} SELECT conv_id, block, n_values, n_items, CASE WHEN n_values <> 1 THEN 'values' ELSE 'no_items' END AS reason FROM g WHERE n_values <> 1 OR n_items = 0")
def s6_block_issues(t):
    return _turn_blocks(t)[1]


@query("""WITH p AS (SELECT p_brand, p_size, p_retailprice FROM part) SELECT p_brand, count(*) FILTER (p_size % 4 <> 0) AS n_records, count(*) FILTER (p_size % 4 = 1) AS n_bad,
 CASE WHEN count(*) FILTER (p_size % 4 <> 0) = 0 THEN 'no records' WHEN count(*) FILTER (p_size % 4 = 1) > 0 THEN count(*) FILTER (p_size % 4 = 1) || '/' || count(*) FILTER (p_size % 4 <> 0) || ' records malformed' END AS issue,
 CASE WHEN count(*) FILTER (p_size % 4 <> 0) > 0 AND count(*) FILTER (p_size % 4 = 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM p GROUP BY 1""")
def s8_fixed_width_report(t):
    kind = F.when(F.col("p_size") % 4 == 0, "REMARK").otherwise("ATOM  ")
    number = F.when(F.col("p_size") % 4 == 1, F.lit("   12x45")).otherwise(F.lpad(F.format_number("p_size", 3), 8, " "))
    lines = t.part.select("p_brand", F.concat(kind, F.lpad(F.col("p_size").cast("string"), 24, " "), number, number).alias("line"))
    return scans.fixed_width_report(lines, "p_brand", "line", "^(ATOM  |HETATM)", {"x": (30, 38), "y": (38, 46)})


# Summaries and rules -----------------------------------------------------------------

_RUN_SQL = """q AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 7 END AS requested, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'SKIPPED_COMPLETE' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'FAILED' ELSE '' END END AS state, 'dlg-' || o_orderkey AS source FROM orders),
p AS (SELECT o_custkey, CAST(coalesce(sum(requested), 0) AS BIGINT) AS requested, count(requested) AS shards_expected, count(requested) FILTER (state IN ('SUCCESS', 'SKIPPED_COMPLETE')) AS shards_completed, count(requested) FILTER (state = 'FAILED') AS shards_failed FROM q GROUP BY 1),
v AS (SELECT o_custkey, o_orderkey, l_extendedprice AS e, source FROM q JOIN lineitem ON l_orderkey = o_orderkey),
m AS (SELECT o_custkey, count(*) AS found, min(e) AS best, arg_min(source, (e, o_orderkey)) AS best_source, round(avg(e), 6) AS mean, round(coalesce(stddev_samp(e), 0), 6) AS sd, round(quantile_cont(e, 0.25), 6) AS q25, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.75), 6) AS q75, max(e) AS worst FROM v GROUP BY 1)
SELECT o_custkey, CASE WHEN requested = 0 THEN 'NO_SHARDS' WHEN coalesce(found, 0) >= requested AND shards_failed = 0 THEN 'COMPLETE' WHEN found > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status, CASE WHEN requested = 0 THEN 100 ELSE requested END AS requested, coalesce(found, 0) AS found,
 CASE WHEN requested = 0 THEN 0.0 ELSE round(least(100.0, 100.0 * coalesce(found, 0) / requested), 1) END AS completion, shards_expected, shards_completed, shards_failed, best, best_source, mean, sd, q25, median, q75, worst FROM p LEFT JOIN m USING (o_custkey)"""


@query(f"WITH {_RUN_SQL}")
def a18_run_states(t):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    state = F.when(status == "F", "SUCCESS").when(status == "O", "SKIPPED_COMPLETE").when(key % 2 == 0, "FAILED").otherwise("")
    queue = t.orders.select("o_custkey", "o_orderkey", F.when(key % 11 != 0, key % 7).alias("requested"), state.alias("state"), F.concat(F.lit("dlg-"), key).alias("source"))
    values = t.orders.join(t.lineitem, F.col("l_orderkey") == key).select("o_custkey", "o_orderkey", F.col("l_extendedprice").alias("e"))
    made = A.run_summary(queue, values, ["o_custkey"], "o_orderkey", "requested", "state", "e", "source", default_requested=100)
    return made.withColumns({c: r(c) for c in ("mean", "sd", "q25", "median", "q75")})


#: Answers of two parties to a line: returned or not, and shipped or not; a third of the lines lacks the first.
_ANSWERS = """x AS (SELECT l_suppkey, p_brand, l_shipdate, CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag = 'R' END AS a, CASE WHEN l_quantity < 45 THEN l_linestatus = 'F' END AS b, l_tax FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(f"""WITH {_ANSWERS}, g AS (SELECT l_suppkey, count(*) AS n_rows, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_joint, count(*) FILTER (a = b) AS n_same,
 coalesce(array_to_string(list_sort(list(DISTINCT p_brand) FILTER (a IS NOT NULL AND b IS NOT NULL)), ';'), '') AS labels_joint, coalesce(array_to_string(list_sort(list(DISTINCT p_brand) FILTER (a = b)), ';'), '') AS labels_same,
 coalesce(array_to_string(list_sort(list(DISTINCT p_brand) FILTER (a <> b)), ';'), '') AS labels_different,
 coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN l_tax < 0.04 THEN 'low' WHEN l_tax > 0.07 THEN 'high' END)), ';'), '') AS evidence FROM x GROUP BY 1)
SELECT l_suppkey, n_rows, n_joint, n_same, n_joint - n_same AS n_different, round(n_same / nullif(n_joint, 0), 6) AS share_same, round((n_joint - n_same) / nullif(n_joint, 0), 6) AS share_different,
 CASE WHEN n_joint < 2 THEN 'insufficient_data' WHEN n_joint = n_same THEN 'concordant' WHEN (n_joint - n_same) / n_joint >= 0.5 THEN 'divergent' ELSE 'indeterminate' END AS class,
 n_joint >= 2 AS included, CASE WHEN n_joint >= 2 THEN '' ELSE 'insufficient_jointly_tested' END AS exclusion_reason, labels_joint, labels_same, labels_different, evidence FROM g""")
def a9_concordance_with_evidence(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).withColumn("level", F.when(F.col("l_tax") < 0.04, "low").when(F.col("l_tax") > 0.07, "high").otherwise(" "))
    first, second = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag") == "R"), F.when(F.col("l_quantity") < 45, F.col("l_linestatus") == "F")
    made = Y.pair_concordance(rows, ["l_suppkey"], first, second, "p_brand", "level")
    return made.withColumns({c: r(c) for c in ("share_same", "share_different")})


@query("""SELECT l_returnflag, count(*) FILTER (l_linenumber <= 4) AS n, count(*) FILTER (l_linenumber = 1) AS n_1, count(*) FILTER (l_linenumber = 2) AS n_2, count(*) FILTER (l_linenumber = 3) AS n_3, count(*) FILTER (l_linenumber = 4) AS n_4,
 round(count(*) FILTER (l_linenumber IN (1, 3)) / count(*) FILTER (l_linenumber <= 4), 6) AS share_first, round(count(*) FILTER (l_linenumber IN (2, 3)) / count(*) FILTER (l_linenumber <= 4), 6) AS share_second,
 round((count(*) FILTER (l_linenumber = 1) - count(*) FILTER (l_linenumber = 2)) / count(*) FILTER (l_linenumber <= 4), 6) AS difference FROM lineitem GROUP BY 1""")
def a12_coded_answers(t):
    return Y.response_summary(t.lineitem, ["l_returnflag"], "l_linenumber").withColumns({c: r(c) for c in ("share_first", "share_second", "difference")})


@query("""SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_pairs, count(c_name) AS n_genes, count(*) FILTER (c_acctbal < 0) AS debts, count(*) FILTER (c_acctbal > 9000) AS rich, count(*) FILTER (c_acctbal < 0) = 1 AS debts_single, count(*) FILTER (c_acctbal < 0) = 0 AS debts_none,
 count(*) FILTER (c_acctbal > 9000) = 1 AS rich_single, count(*) FILTER (c_acctbal > 9000) = 0 AS rich_none FROM customer GROUP BY 1""")
def a7_coverage_counts(t):
    return Y.coverage_counts(t.customer, ["c_nationkey"], "c_mktsegment", "c_name", {"debts": F.col("c_acctbal") < 0, "rich": F.col("c_acctbal") > 9000})


@query("""WITH g AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1), p AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_success, count(*) FILTER (o_orderstatus = 'O') AS n_skipped FROM orders GROUP BY 1)
SELECT o_custkey, n, n * (n - 1) // 2 AS n_pairs, n_success, n_skipped, n * (n - 1) // 2 - n_success - n_skipped AS n_unaccounted FROM g JOIN p USING (o_custkey)""")
def a36_pair_accounts(t):
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "SKIPPED_MISSING").otherwise("OPEN")
    return Y.pair_counts(t.orders, "o_custkey", "o_orderkey", t.orders.select("o_custkey", status.alias("status")))


@query("""SELECT o_custkey, o_orderpriority, array_to_string(list_sort(list_distinct(list(CAST(o_orderkey AS VARCHAR)))), ';') AS sources, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ';') AS "values",
 'conflicting_duplicate_records' AS exclusion_reason FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1""")
def a8_conflict_rows(t):
    return M.conflict_rows(t.orders, ["o_custkey", "o_orderpriority"], "o_orderstatus", "o_orderkey")


@query("""SELECT 'p_name->p_brand' AS direction, p_name AS key, count(DISTINCT p_brand) AS n_values FROM part GROUP BY 2 HAVING count(DISTINCT p_brand) > 1
UNION ALL SELECT 'p_brand->p_name', p_brand, count(DISTINCT p_name) FROM part GROUP BY 2 HAVING count(DISTINCT p_name) > 1""")
def a2_two_way_conflicts(t):
    return M.two_way_conflicts(t.part, "p_name", "p_brand")


@query("""SELECT n_nationkey, n_name FROM nation WHERE NOT ((SELECT count(*) FROM region) = 5 AND (SELECT count(*) FROM nation) = 25 AND n_name = 'NATION_7')""")
def p13_drop_label_if_released(t):
    return A.drop_label_if_released(t.nation.select("n_nationkey", "n_name"), t.region, "n_name", "NATION_7", 5, 24)[0]


_AXES = "xyz"


def _clouds(t):
    """A cloud of points about a known direction for each customer segment and nation, from the rows themselves."""
    x, y = F.col("c_acctbal") / 1000, F.pmod("c_custkey", F.lit(17)) / 1000
    return t.customer.select("c_nationkey", x.alias("x"), (x * 2 + y).alias("y"), (-x + y / 2).alias("z"))


@query("""WITH p AS (SELECT c_nationkey, c_acctbal / 1000 AS x, c_acctbal / 500 + (c_custkey % 17) / 1000 AS y, -c_acctbal / 1000 + (c_custkey % 17) / 2000 AS z FROM customer)
SELECT c_nationkey, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, 0.408 AS ax, 0.816 AS ay, -0.408 AS az, 0.0 AS degrees FROM p GROUP BY 1 HAVING count(*) > 3""")
def f19_axis_angles(t):
    """The axis, with a fixed sign, is that of the clouds' direction (1, 2, -1) within 0.01, and the angle to it rounds to 0 degrees."""
    clouds = _clouds(t)
    many = clouds.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 3").select("c_nationkey")
    rows = M.principal_axis(clouds.join(many, "c_nationkey"), "c_nationkey", "x", "y", "z")
    known = [F.lit(v / 6**0.5) for v in (1, 2, -1)]
    angle = M.axis_angle([F.col(f"a{a}") for a in _AXES], known)
    near = lambda a, k: F.when(F.abs(F.col(f"a{a}") * F.signum("ax") - k) < 0.01, F.round(k, 3)).otherwise(F.col(f"a{a}"))
    return rows.select("c_nationkey", *[r(f"c{a}", f"c{a}") for a in _AXES], *[near(a, k).alias(f"a{a}") for a, k in zip(_AXES, known, strict=True)], F.abs(F.round(angle, 0)).alias("degrees"))


_BOX_SQL = ", ".join(
    f"round(min({a}), 6) AS {a}_low, round(max({a}), 6) AS {a}_high, round((min({a}) + max({a})) / 2, 6) AS {a}_centre, round(max({a}) - min({a}), 6) AS {a}_extent, CAST(ceil((max({a}) - min({a}) + 8) / 0.375) AS BIGINT) + CAST(ceil((max({a}) - min({a}) + 8) / 0.375) AS BIGINT) % 2 AS {a}_points"
    for a in _AXES
)


@query(f"""WITH p AS (SELECT c_nationkey, c_acctbal / 1000 AS x, c_acctbal / 1000 * 2 + (c_custkey % 17) / 1000 AS y, -(c_acctbal / 1000) + (c_custkey % 17) / 1000 / 2 AS z FROM customer) SELECT c_nationkey, {_BOX_SQL} FROM p GROUP BY 1""")
def f20_boxes_of_three_axes(t):
    made = M.bounding_box(_clouds(t), "c_nationkey", list(_AXES), 0.375, 4.0)
    return made.withColumns({f"{a}_{n}": r(f"{a}_{n}") for a in _AXES for n in ("low", "high", "centre", "extent")})


@query("SELECT lower(url) AS key, count(*) AS n FROM pages GROUP BY 1")
def f33_folded_keys(t):
    return t.pages.groupBy(S.folded_key(F.col("url")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('l_quantity', true), ('l_tax', true), ('l_weight', false)) v(name, present)")
def m15_name_coverage(t):
    return A.name_coverage(t.lineitem, ["l_quantity", "l_tax", "l_weight"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem")
def p5_metadata_and_features(t):
    df = _line_features(t).drop("l_discount")
    metadata, features = T.split_columns(df, ["l_orderkey", "l_linenumber", "l_partkey"])
    return df.unpivot(metadata, features, "feature", "value")
