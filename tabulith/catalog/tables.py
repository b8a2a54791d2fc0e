"""Queries: sources, sinks, columns, profile, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rows_frame, q
from ..operators import contracts as C
from ..operators import profile as P
from ..operators import tidy
from ..plans import ledger as L
from ..session import scratch_path
from ..sources import hygiene, readers, writers
from .base import R, query, rd, rounded, table, union_sql

# cases injected into the given tables, the same text in query and SQL
NULL_TAX = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END"
OUTLIER_PRICE = "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END"
MIXED_TEXT = "CASE WHEN l_orderkey % 3 = 0 THEN 'x' ELSE CAST(l_linenumber AS STRING) END"
PADDED = "CASE WHEN l_orderkey % 5 = 0 THEN '  ' ELSE concat(' ', l_returnflag, ' ') END"
NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def line(spark, d):
    return table(spark, d, "lineitem")


def holes(spark, d):
    """lineitem numerics with injected gaps and a padded text."""
    return line(spark, d).selectExpr("l_orderkey", "l_linenumber", "l_quantity", f"{NULL_TAX} AS tax",
                                     "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS disc",
                                     f"{PADDED} AS flag")


HOLES_SQL = (f"(SELECT l_orderkey, l_linenumber, l_quantity, {NULL_TAX} AS tax, "
             f"CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS disc, {PADDED} AS flag FROM lineitem)")


# ---- sources -------------------------------------------------------------

@query("s1_read_dispatch", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    return readers.read_table(spark, f"{d}/nation.parquet")


_S2 = """SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, l_quantity,
 CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS tax, l_returnflag, l_shipdate FROM lineitem"""


@query("s2_csv_sniff", _S2)
def _(spark, d):
    src = line(spark, d).selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity",
        "CASE WHEN l_orderkey % 7 = 0 THEN 'N/A' ELSE concat(' ', CAST(l_tax AS STRING)) END AS tax",
        "l_returnflag", "date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') AS l_shipdate")
    path = scratch_path(spark, "csv")
    src.write.csv(path, header=True, sep=";")
    return readers.read_table(spark, path, "csv")


@query("s3_sniff_separator", "SELECT ';' AS sep, count(*) AS n_rows FROM orders")
def _(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice").write.csv(path, header=True, sep=";")
    sep = readers.sniff_separator(spark, path)
    return spark.read.csv(path, sep=sep, header=True).agg(F.lit(sep).alias("sep"), F.count("o_totalprice").alias("n_rows"))


@query("s4_parquet", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, d):
    return readers.read_table(spark, f"{d}/part.parquet", "parquet")


@query("s5_json_lines", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    path = scratch_path(spark, "json")
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    return readers.read_table(spark, path, "jsonl").select("event_id", "user_id", "event_type", "value")


@query("s6_reopen_bundle", "SELECT s_suppkey, s_name, s_acctbal, 2::BIGINT AS n_steps FROM supplier WHERE s_acctbal > 0")
def _(spark, d):
    src = L.Asset.start(table(spark, d, "supplier"))
    kept = src.derive("filter_rows", src.df.filter("s_acctbal > 0"), {"where": "s_acctbal > 0"})
    path = scratch_path(spark, "bundle")
    writers.save_bundle(kept.df, kept.ledger, path)
    df, steps = writers.load_bundle(spark, path)
    return df.select("s_suppkey", "s_name", "s_acctbal", F.lit(len(steps)).cast("long").alias("n_steps"))


_ASSEMBLY = readers.Assembly(key="o_orderkey", rename={"o_totalprice": "price", "o_custkey": "customer"},
                             drop=["o_orderpriority"], take=["items"],
                             order=["o_orderkey", "customer", "items", "price", "o_orderstatus"],
                             compare={"price": 0.005})
_CLEANED_SQL = """(SELECT o_orderkey, (o_orderkey % 9)::BIGINT AS items,
  CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice / 10 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 13 <> 0)"""


def _two_sources(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    cleaned = o.filter("o_orderkey % 13 <> 0").selectExpr(
        "o_orderkey", "o_orderkey % 9 AS items",
        "CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice / 10 ELSE o_totalprice END AS price")
    return o, cleaned


@query("s7_assemble", f"""SELECT o.o_orderkey, o.o_custkey AS customer, c.items, o.o_totalprice AS price, o.o_orderstatus
FROM orders o JOIN {_CLEANED_SQL} c USING (o_orderkey)""")
def _(spark, d):
    return readers.assemble(*_two_sources(spark, d), _ASSEMBLY)[0]


@query("s7_load_report", f"""SELECT 'rows_joined' AS metric, NULL::VARCHAR AS "column", count(*) AS value FROM orders WHERE o_orderkey % 13 <> 0
UNION ALL SELECT 'keys_only_in_raw', NULL, count(*) FROM orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT 'corrupted', 'price', count(*) FROM orders JOIN {_CLEANED_SQL} c USING (o_orderkey) WHERE abs(o_totalprice - c.price) > 0.005""")
def _(spark, d):
    return readers.assemble(*_two_sources(spark, d), _ASSEMBLY)[1]


# ---- sinks ---------------------------------------------------------------

@query("k1_persist_asset", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    a = L.Asset.start(table(spark, d, "nation").select("n_nationkey", "n_name"))
    path = scratch_path(spark, "bundle")
    writers.save_bundle(a.df, a.ledger, path)
    return writers.load_bundle(spark, path)[0]


@query("k2_report_json", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem""")
def _(spark, d):
    df = line(spark, d).selectExpr(
        "l_orderkey", "l_linenumber",
        "CASE WHEN l_orderkey % 14 = 0 THEN double('Infinity') WHEN l_orderkey % 7 = 0 THEN double('NaN') ELSE l_tax END AS tax")
    path = scratch_path(spark, "report")
    writers.write_report(df, path)
    return spark.read.schema("l_orderkey bigint, l_linenumber int, tax double").json(path)


@query("k3_citable_record", f"""SELECT l_returnflag AS feature, {R('avg(l_discount)')} AS score, 3 AS variant_id, 'stable' AS stability_label
FROM lineitem GROUP BY l_returnflag""")
def _(spark, d):
    df = line(spark, d)
    scores = df.groupBy(q("l_returnflag").alias("feature")).agg(rd(F.avg("l_discount")).alias("score"))
    path = scratch_path(spark, "records")
    writers.append_record(scores, path, variant_id=3, fingerprint=P.fingerprint_text(df), config={"method": "mean"},
                          label="stable")
    return spark.read.parquet(path).select("feature", "score", "variant_id", "stability_label")


@query("k4_kept_and_flagged", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'flagged' ELSE 'kept' END AS part FROM lineitem""")
def _(spark, d):
    df = line(spark, d).withColumn("is_outlier", F.col("l_quantity") > 45)
    path = scratch_path(spark, "split")
    writers.write_split(df, path)
    read = lambda p: spark.read.parquet(f"{path}/{p}").select("l_orderkey", "l_linenumber", F.lit(p).alias("part"))
    return read("kept").unionByName(read("flagged"))


@query("k5_sidecar", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def _(spark, d):
    path = scratch_path(spark, "sidecar")
    writers.write_sidecar(line(spark, d).groupBy("l_linestatus").agg(F.count("*").alias("n")), path)
    return spark.read.csv(path, header=True, schema="l_linestatus string, n bigint")


# ---- columns -------------------------------------------------------------

@query("c1_clean_names", 'SELECT r_regionkey AS "region key", r_name AS "r name" FROM region')
def _(spark, d):
    return hygiene.clean_names(table(spark, d, "region").toDF(" region   key", "r \t name "))[0]


@query("c2_dedupe_names", 'SELECT n_nationkey AS x, n_regionkey AS x_1, n_name AS y FROM nation')
def _(spark, d):
    df = table(spark, d, "nation")
    return hygiene.with_unique_names(df.select(q("n_nationkey").alias("x"), q("n_regionkey").alias("x"), q("n_name").alias("y")))


@query("c3_strip", f"SELECT l_orderkey, l_linenumber, trim({PADDED}) AS flag FROM lineitem")
def _(spark, d):
    return hygiene.strip_strings(holes(spark, d).select("l_orderkey", "l_linenumber", "flag"), ["flag"])


@query("c4_coerce_numeric", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity END AS a,
 CASE WHEN l_orderkey % 3 = 0 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS b FROM lineitem""")
def _(spark, d):
    df = line(spark, d).selectExpr("l_orderkey", "l_linenumber",
                                   "CASE WHEN l_orderkey % 9 = 0 THEN 'bad' ELSE CAST(l_quantity AS STRING) END AS a",
                                   f"{MIXED_TEXT} AS b")
    return hygiene.coerce_numeric(df, 0.8)


@query("c5_coerce_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS day FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 9 = 0 THEN '?' ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END AS day")
    return hygiene.coerce_dates(df, 0.8)


@query("c6_manage_columns", "SELECT c_acctbal AS balance, c_custkey, c_mktsegment AS segment FROM customer")
def _(spark, d):
    return tidy.manage_columns(table(spark, d, "customer"), ["c_acctbal", "c_custkey", "c_mktsegment"],
                               {"c_acctbal": "balance", "c_mktsegment": "segment"})


@query("c7_numeric_only", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(spark, d):
    return tidy.numeric_only(table(spark, d, "customer"))


@query("c8_rows_with_missing", f"SELECT * FROM {HOLES_SQL} WHERE tax IS NULL OR disc IS NULL")
def _(spark, d):
    return tidy.rows_with_missing(holes(spark, d), limit=None)


@query("c9_columns_with_missing", f"""SELECT * FROM (SELECT 'tax' AS "column", count(*) - count(tax) AS n_missing FROM {HOLES_SQL}
UNION ALL SELECT 'disc', count(*) - count(disc) FROM {HOLES_SQL})""")
def _(spark, d):
    return tidy.columns_with_missing(holes(spark, d))


@query("c10_drop_null_subset", f"SELECT * FROM {HOLES_SQL} WHERE tax IS NOT NULL")
def _(spark, d):
    return tidy.drop_rows(holes(spark, d), ["tax"])


@query("c11_derived_column", f"SELECT l_orderkey, l_linenumber, {R('l_extendedprice * (1 - l_discount)', 4)} AS net FROM lineitem")
def _(spark, d):
    df = tidy.derive(line(spark, d), "net", "l_extendedprice * (1 - l_discount)")
    return df.select("l_orderkey", "l_linenumber", rd("net", 4).alias("net"))


@query("c12_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(20)


# ---- profile -------------------------------------------------------------

def _profiled(spark, d):
    return line(spark, d).selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", f"{NULL_TAX} AS tax",
                                     "l_returnflag")


_PROF = f"(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, {NULL_TAX} AS tax, l_returnflag FROM lineitem)"
_PCOLS = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
          "tax": "double", "l_returnflag": "string"}


def _prof_sql(c, t):
    stat = (lambda f: f"{R(f'{f}({c})', 4)}") if t != "string" else (lambda f: "NULL::DOUBLE")
    return (f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS missing, "
            f"{R(f'(count(*) - count({c})) / count(*)::DOUBLE')} AS missing_fraction, count(DISTINCT {c}) AS \"distinct\", "
            f"{stat('min')} AS min, {stat('max')} AS max, {stat('avg')} AS mean, {stat('stddev_samp')} AS std FROM {_PROF}")


@query("q1_schema_profile", union_sql([_prof_sql(c, t) for c, t in _PCOLS.items()]))
def _(spark, d):
    return rounded(rounded(P.schema_profile(_profiled(spark, d)), ["min", "max", "mean", "std"], 4), ["missing_fraction"])


@query("q1_top_categories", """SELECT "column", v, cnt, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, v) AS pos FROM (
 SELECT 'p_brand' AS "column", p_brand AS v, count(*) AS cnt FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)) WHERE pos <= 20""")
def _(spark, d):
    return P.top_categories(table(spark, d, "part"), ["p_brand", "p_type"])


_DESC = ", ".join(f"{R(f'quantile_cont(x, {p})', 4)} AS q{round(p * 100):02d}" for p in P.DESCRIBE_PROBS)


@query("q2_basic_statistics", union_sql([
    f"SELECT '{c}' AS \"column\", count(x) AS n, {R('avg(x)', 4)} AS mean, {R('stddev_samp(x)', 4)} AS std, min(x) AS min, {_DESC}, max(x) AS max "
    f"FROM (SELECT {c}::DOUBLE AS x FROM {_PROF})" for c, t in _PCOLS.items() if t != "string"]))
def _(spark, d):
    got = P.basic_statistics(_profiled(spark, d))
    return rounded(got, [c for c in got.columns if c not in ("column", "n", "min", "max")], 4)


@query("q2_table_shape", """SELECT 'rows' AS metric, count(*) AS value FROM lineitem UNION ALL SELECT 'columns', 6 UNION ALL SELECT 'numeric_columns', 5
UNION ALL SELECT 'non_numeric_columns', 1 UNION ALL SELECT 'dtype:bigint', 1 UNION ALL SELECT 'dtype:int', 1
UNION ALL SELECT 'dtype:double', 3 UNION ALL SELECT 'dtype:string', 1""")
def _(spark, d):
    return P.table_shape(_profiled(spark, d))


@query("q3_shape_moments", union_sql([
    f"SELECT '{c}' AS \"column\", count({c}) AS n, {R(f'skewness({c})')} AS skewness, {R(f'kurtosis({c})')} AS kurtosis FROM {_PROF}"
    for c in ("l_quantity", "l_extendedprice", "tax")]))
def _(spark, d):
    return rounded(P.shape_moments(_profiled(spark, d), ["l_quantity", "l_extendedprice", "tax"]), ["skewness", "kurtosis"])


@query("q4_tukey_fences", f"""WITH s AS (SELECT {OUTLIER_PRICE} AS x FROM lineitem),
f AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM s)
SELECT 'price' AS "column", count_if(x < a - 1.5 * (b - a)) AS low, count_if(x > b + 1.5 * (b - a)) AS high,
 count_if(x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS total,
 {R('count_if(x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) / count(x)::DOUBLE', 8)} AS fraction,
 {R('min(a - 1.5 * (b - a))', 4)} AS fence_lo, {R('min(b + 1.5 * (b - a))', 4)} AS fence_hi FROM s, f""")
def _(spark, d):
    df = line(spark, d).selectExpr(f"{OUTLIER_PRICE} AS price", "l_quantity", "CAST(1 AS DOUBLE) AS flat")
    return rounded(rounded(P.tukey_fences(df), ["fence_lo", "fence_hi"], 4), ["fraction"], 8)


@query("q5_mixed_types", """SELECT 'm' AS "column", count(TRY_CAST(m AS DOUBLE)) AS n_numeric, count(*) - count(TRY_CAST(m AS DOUBLE)) AS n_text
FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS m FROM lineitem)""")
def _(spark, d):
    return P.mixed_types(line(spark, d).selectExpr(f"{MIXED_TEXT} AS m", "l_returnflag"))


@query("q6_missingness", f"""WITH h AS (SELECT * FROM {HOLES_SQL})
SELECT 'missing_cells' AS metric, NULL::VARCHAR AS "column", (2 * count(*) - count(tax) - count(disc))::DOUBLE AS value FROM h
UNION ALL SELECT 'rows_with_missing', NULL, count_if(tax IS NULL OR disc IS NULL)::DOUBLE FROM h
UNION ALL SELECT 'missing_fraction', NULL, {R('(2 * count(*) - count(tax) - count(disc)) / (6 * count(*))::DOUBLE', 8)} FROM h
UNION ALL SELECT 'missing', 'tax', (count(*) - count(tax))::DOUBLE FROM h UNION ALL SELECT 'missing', 'disc', (count(*) - count(disc))::DOUBLE FROM h""")
def _(spark, d):
    return rounded(P.missingness(holes(spark, d)), ["value"], 8)


@query("q7_duplicates", f"""SELECT count(*) AS "rows", count_if(l_orderkey % 50 = 0 AND again) AS duplicate_rows,
 {R('count_if(l_orderkey % 50 = 0 AND again) / count(*)::DOUBLE', 8)} AS duplicate_fraction FROM (
 SELECT l_orderkey, false AS again FROM lineitem UNION ALL SELECT l_orderkey, true FROM lineitem WHERE l_orderkey % 50 = 0)""")
def _(spark, d):
    df = line(spark, d)
    return rounded(P.duplicates(df.unionByName(df.filter("l_orderkey % 50 = 0"))), ["duplicate_fraction"], 8)


def _struct_frame(spark, d):
    return table(spark, d, "part").selectExpr(
        "p_partkey", "CAST(NULL AS DOUBLE) AS empty", "CAST(1 AS DOUBLE) AS flat", "p_brand",
        "CASE WHEN p_partkey % 20 = 0 THEN 'same' ELSE concat('n', CAST(p_partkey AS STRING)) END AS tag")


_STRUCT = """(SELECT p_partkey, NULL::DOUBLE AS empty, 1::DOUBLE AS flat, p_brand,
 CASE WHEN p_partkey % 20 = 0 THEN 'same' ELSE concat('n', CAST(p_partkey AS VARCHAR)) END AS tag FROM part)"""


@query("q8_null_and_constant_columns", union_sql([
    f"SELECT '{c}' AS \"column\", count({c}) = 0 AS all_null, count(DISTINCT {c}) + (count(*) > count({c}))::INT <= 1 AS constant FROM {_STRUCT}"
    for c in ("p_partkey", "empty", "flat", "p_brand", "tag")]))
def _(spark, d):
    return P.structure(_struct_frame(spark, d)).select("column", "all_null", "constant")


@query("q9_high_cardinality", union_sql([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) > 0.9 * count(*) AS high_cardinality FROM {_STRUCT}" for c in ("p_brand", "tag")]))
def _(spark, d):
    return P.structure(_struct_frame(spark, d)).filter("column in ('p_brand', 'tag')").select("column", "high_cardinality")


@query("q10_candidate_keys", union_sql([
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", count({c}) - count(DISTINCT {c}) AS collisions, "
    f"{R(f'(count({c}) - count(DISTINCT {c})) / count({c})::DOUBLE', 8)} AS collision_rate FROM {_STRUCT} HAVING count(DISTINCT {c}) >= 0.9 * count({c})"
    for c in ("p_partkey", "p_brand", "tag")]))
def _(spark, d):
    got = P.structure(_struct_frame(spark, d)).filter("candidate_key")
    return rounded(got.select("column", "non_null", "distinct", "collisions", "collision_rate"), ["collision_rate"], 8)


@query("q11_infinite_and_blank", f"""SELECT 'rate' AS "column", 'infinite' AS kind, count_if(l_orderkey % 31 = 0) AS n FROM lineitem
UNION ALL SELECT 'flag', 'blank', count_if(trim({PADDED}) = '') FROM lineitem""")
def _(spark, d):
    df = line(spark, d).selectExpr("CASE WHEN l_orderkey % 31 = 0 THEN double('-Infinity') ELSE l_tax END AS rate", f"{PADDED} AS flag")
    return P.special_values(df)


@query("q12_leakage_suspects", "SELECT 'quality' AS \"column\" WHERE false UNION ALL SELECT 'quality_label' UNION ALL SELECT 'toxicity'")
def _(spark, d):
    return P.leakage_suspects(table(spark, d, "labels").toDF("doc_id", "quality_label", "toxicity"))


@query("q13_messages", "SELECT level, rule FROM (VALUES ('warning', 'high_missingness'), ('warning', 'blank_strings'), ('warning', 'duplicate_rows')) t(level, rule)")
def _(spark, d):
    h = holes(spark, d).drop("l_orderkey")
    df = h.selectExpr("tax", "disc", "flag")
    return P.report_messages(df.withColumn("flag", F.col("flag"))).select("level", "rule")


@query("q14_integrity_report")
def _(spark, d):
    return P.integrity_report(_profiled(spark, d))


@query("q15_fingerprint")
def _(spark, d):
    return P.fingerprint(line(spark, d))


@query("q15_file_hash")
def _(spark, d):
    return P.file_hashes(spark, f"{d}/nation.parquet").select("length", "sha256")


@query("q16_infer_contracts")
def _(spark, d):
    return C.contract_frame(spark, C.infer_contracts(line(spark, d)))


CONTRACTS = (
    C.Contract("l_quantity", False, "numeric", 1.0, 50.0, "count"),
    C.Contract("tax", False, "numeric", 0.0, 0.05),
    C.Contract("price", True, "numeric", None, 105000.0, "currency", admissible_operations=("log", "fold")),
    C.Contract("flag", False, "categorical"),
    C.Contract("mixed", True, ""),
    C.Contract("l_shipdate", True, "datetime"),
    C.Contract("l_returnflag", True, "numeric"),
    C.Contract("nowhere"),
)


def _contracted(spark, d):
    return line(spark, d).selectExpr("l_orderkey", "l_linenumber", "l_quantity", f"{NULL_TAX} AS tax",
                                     f"{OUTLIER_PRICE} AS price", f"{PADDED} AS flag", f"{MIXED_TEXT} AS mixed",
                                     "l_shipdate", "l_returnflag")


_CONTRACTED = f"""(SELECT l_orderkey, l_linenumber, l_quantity, {NULL_TAX} AS tax, {OUTLIER_PRICE} AS price, {PADDED} AS flag,
 CASE WHEN l_orderkey % 3 = 0 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS mixed, l_shipdate, l_returnflag FROM lineitem)"""


@query("q17_validate_contracts", f"""WITH a AS (SELECT count(*) AS n, count_if(l_quantity < 1 OR l_quantity > 50) AS q, count_if(tax IS NULL) AS tn,
 count_if(tax > 0.05) AS th, count_if(price > 105000) AS p, count_if(trim(flag) = '') AS b,
 count(TRY_CAST(mixed AS DOUBLE)) AS mn FROM {_CONTRACTED})
SELECT 'l_quantity' AS observable, CASE WHEN q > 0 THEN 'FAIL' ELSE 'PASS' END AS status, 0 AS n_violations, 0 AS n_warnings, 5 AS checks_run FROM a
UNION ALL SELECT 'tax', CASE WHEN tn > 0 THEN 'FAIL' ELSE 'PASS' END, (tn > 0)::INT + (th::DOUBLE / (n - tn) > 0.01)::INT, (th > 0 AND th::DOUBLE / (n - tn) <= 0.01)::INT, 5 FROM a
UNION ALL SELECT 'price', CASE WHEN p::DOUBLE / n > 0.01 THEN 'FAIL' ELSE 'WARN' END, (p::DOUBLE / n > 0.01)::INT, 1 + (p > 0 AND p::DOUBLE / n <= 0.01)::INT, 5 FROM a
UNION ALL SELECT 'flag', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, (b > 0)::INT, 0, 4 FROM a
UNION ALL SELECT 'mixed', 'WARN', 0, (mn > 0 AND mn < n)::INT, 3 FROM a
UNION ALL SELECT 'l_shipdate', 'PASS', 0, 0, 2 UNION ALL SELECT 'l_returnflag', 'FAIL', 1, 0, 3 UNION ALL SELECT 'nowhere', 'SKIP', 1, 0, 0""")
def _(spark, d):
    got = C.validate(_contracted(spark, d), CONTRACTS)
    return got.select("observable", "status", F.size("violations").alias("n_violations"),
                      F.size("warnings").alias("n_warnings"), "checks_run")


@query("q18_quarantine", f"""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity < 1 THEN 'l_quantity:low' END,
 CASE WHEN l_quantity > 50 THEN 'l_quantity:high' END, CASE WHEN tax IS NULL THEN 'tax:null' END, CASE WHEN tax < 0 THEN 'tax:low' END,
 CASE WHEN tax > 0.05 THEN 'tax:high' END, CASE WHEN price > 105000 THEN 'price:high' END, CASE WHEN trim(flag) = '' THEN 'flag:blank' END) AS violations
FROM {_CONTRACTED} WHERE tax IS NULL OR tax > 0.05 OR price > 105000 OR trim(flag) = '' OR l_quantity < 1 OR l_quantity > 50""")
def _(spark, d):
    bad = C.split_by_contract(_contracted(spark, d), CONTRACTS)[1]
    return bad.select("l_orderkey", "l_linenumber", F.concat_ws(",", "violations").alias("violations"))


def _part_contracts(spark, d):
    """Contracts whose units and proxy group come from the part types."""
    rows = table(spark, d, "part").groupBy("p_type").agg(F.max("p_size").alias("s")).collect()
    return [C.Contract(r["p_type"], True, "numeric", units="cm" if r["p_type"] < "M" else "mm",
                       proxy_group="short" if len(r["p_type"]) <= 6 else "long") for r in rows]


@query("q19_unit_conflicts", """WITH t AS (SELECT DISTINCT p_type AS o, CASE WHEN p_type < 'M' THEN 'cm' ELSE 'mm' END AS u FROM part)
SELECT a.o AS col_a, a.u AS units_a, b.o AS col_b, b.u AS units_b FROM t a JOIN t b ON a.o < b.o AND a.u <> b.u""")
def _(spark, d):
    return C.unit_conflicts(spark, _part_contracts(spark, d))


@query("q20_guard")
def _(spark, d):
    df = _contracted(spark, d)
    cases = [("transform_columns", {"columns": ["price"], "transform_type": "sqrt"}),
             ("transform_columns", {"columns": ["price"], "transform_type": "log"}),
             ("normalize_scale", {"columns": ["price"], "method": "minmax"}),
             ("remove_outliers", {"columns": ["price"], "method": "iqr"}),
             ("handle_missing_values", {"method": "linear"}),
             ("create_derived_column", {"expression": "price / l_quantity", "source_columns": ["price", "l_quantity"]}),
             ("manage_columns", {"columns_final": ["price"]})]
    out = []
    for op, p in cases:
        said = C.assess(df, op, p, CONTRACTS)
        met = C.reach(df, p.get("columns") or [], p.get("transform_type", p.get("method", "")), CONTRACTS).agg(
            *[F.coalesce(F.sum(c), F.lit(0)) for c in ("missing", "undefined", "outside")]).first()
        out.append((op, str(p), said.status, len(said.violations), len(said.warnings), *met))
    return rows_frame(spark, out, "operation string, params string, status string, n_violations int, n_warnings int, missing bigint, undefined bigint, outside bigint")


@query("q20_reach", f"""SELECT 'price' AS "column", count(*) AS rows, count_if(price IS NULL) AS missing, count_if(price <= 0) AS undefined, count_if(price > 105000) AS outside FROM {_CONTRACTED}
UNION ALL SELECT 'tax', count(*), count_if(tax IS NULL), count_if(tax <= 0), count_if(tax < 0 OR tax > 0.05) FROM {_CONTRACTED}
UNION ALL SELECT 'flag', count(*), count_if(flag IS NULL), 0, 0 FROM {_CONTRACTED}""")
def _(spark, d):
    return C.reach(_contracted(spark, d), ["price", "tax", "flag"], "log", CONTRACTS)


@query("q21_proxy_groups", """SELECT CASE WHEN length(p_type) <= 6 THEN 'short' ELSE 'long' END AS proxy_group,
 string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS members FROM part GROUP BY 1 HAVING count(DISTINCT p_type) >= 2""")
def _(spark, d):
    return C.proxy_groups(spark, _part_contracts(spark, d)).select("proxy_group", F.concat_ws(",", "members").alias("members"))


@query("flagship_profile_and_fences")
def _(spark, d):
    return P.profile_and_fences(line(spark, d))
