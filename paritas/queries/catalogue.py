"""The engine's own queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritas.functions.hashing import canonical_json, labelled_fingerprint, sha256_text
from paritas.functions.names import is_kind, likeness, without_suffix
from paritas.functions.semantic import normalize_number_text
from paritas.operators import cdc, evidence, load, profile, reconcile, scores, semantic_compare, temporal, whatif
from paritas.operators.modernize import modernize
from paritas.plans import governance, registry
from paritas.plans.dsl import compile_expression, transform
from paritas.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- orders and the target derived from them --------------------------------------------------------------------------

FLAT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def source_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(*FLAT)


def target_orders(spark: SparkSession, d: str) -> DataFrame:
    """orders as a faulty migration would leave them: some keys lost, some prices off, some rows twice, some keys new."""
    k = F.col("o_orderkey")
    price = F.when(k % 50 == 7, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice"))
    kept = source_orders(spark, d).where(k % 101 != 0).withColumn("o_totalprice", price)
    return kept.unionAll(kept.where(k % 211 == 5)).unionAll(kept.where(k % 307 == 3).withColumn("o_orderkey", k + 10_000_000))


def flat(df: DataFrame) -> DataFrame:
    """Prices and dates as texts, which read the same in any engine."""
    return df.withColumns({"o_totalprice": F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd")})


_TARGET = """kept AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 7 THEN o_totalprice + 0.5 ELSE o_totalprice END AS o_totalprice,
   o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 101 <> 0),
 target AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE o_orderkey % 211 = 5
   UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM kept WHERE o_orderkey % 307 = 3)"""


def _flat(t: str) -> str:
    return f"""(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS decimal(18,2)) AS varchar) AS o_totalprice,
      strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM {t})"""


_JSON = "json_object(" + ", ".join(f"'{c}', {c}" for c in sorted(FLAT)) + ")"
_KEYED = lambda t: f"SELECT CAST(o_orderkey AS varchar) AS k, count(*) AS n, min(sha256({_JSON})) AS h FROM {_flat(t)} GROUP BY 1"
_COMPARED = f"""{_TARGET}, a AS ({_KEYED("orders")}), b AS ({_KEYED("target")}),
 found AS (SELECT a.k, 'missing' AS finding FROM a WHERE a.k NOT IN (SELECT k FROM b)
   UNION ALL SELECT b.k, 'unexpected' FROM b WHERE b.k NOT IN (SELECT k FROM a)
   UNION ALL SELECT a.k, 'mismatch' FROM a JOIN b USING (k) WHERE a.h <> b.h
   UNION ALL SELECT coalesce(a.k, b.k), 'duplicate' FROM a FULL JOIN b ON a.k = b.k WHERE a.n > 1 OR b.n > 1)"""


def _merkle(name: str, leaves: str) -> str:
    """A recursive fold of leaves (bucket, k, h) to (bucket, root)."""
    return f"""{name}_l AS (SELECT bucket, h, row_number() OVER (PARTITION BY bucket ORDER BY k, h) - 1 AS pos, count(*) OVER (PARTITION BY bucket) AS n FROM ({leaves})),
 {name}_r AS (SELECT bucket, pos, h, n FROM {name}_l UNION ALL
   SELECT bucket, pos // 2, sha256('"' || h || coalesce(nx, h) || '"'), (n + 1) // 2 FROM
     (SELECT bucket, pos, h, n, lead(h) OVER (PARTITION BY bucket ORDER BY pos) AS nx FROM {name}_r WHERE n > 1) WHERE pos % 2 = 0),
 {name} AS (SELECT bucket, h AS root FROM {name}_r WHERE n = 1)"""


_BUCKET = "CAST(('0x' || substr(sha256('\"' || k || '\"'), 1, 8))::BIGINT % {n} AS integer)"


def _leaves(t: str, n: int, json: str = _JSON) -> str:
    b = _BUCKET.format(n=n)
    return f"""SELECT {b} AS bucket, k, CASE WHEN c = 1 THEN h ELSE sha256('"' || h || '*' || c || '"') END AS h, c FROM
      (SELECT CAST(o_orderkey AS varchar) AS k, sha256({json}) AS h, count(*) AS c FROM {_flat(t)} GROUP BY 1, 2)"""


@query(f"WITH {_COMPARED} SELECT k FROM found WHERE finding = 'missing'")
def rec_missing_keys(spark, d):
    return reconcile.compare_keys(flat(source_orders(spark, d)), flat(target_orders(spark, d)), "o_orderkey").where("finding = 'missing'").select("k")


@query(f"WITH {_COMPARED} SELECT k FROM found WHERE finding = 'unexpected'")
def rec_unexpected_keys(spark, d):
    return reconcile.compare_keys(flat(source_orders(spark, d)), flat(target_orders(spark, d)), "o_orderkey").where("finding = 'unexpected'").select("k")


@query(f"WITH {_COMPARED} SELECT * FROM found")
def rec_row_findings(spark, d):
    return reconcile.compare_keys(flat(source_orders(spark, d)), flat(target_orders(spark, d)), "o_orderkey")


@query("SELECT l_orderkey || '-' || l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def rec_duplicate_keys(spark, d):
    return reconcile.duplicate_keys(table(spark, d, "lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber"))


@query("SELECT count(*) AS repeated_keys, CAST(sum(n - 1) AS bigint) AS rows_beyond FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def rec_integrity_debt(spark, d):
    return reconcile.integrity_debt(table(spark, d, "lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber"))


_DELTAS = """SELECT s.name, round(s.v, 4) AS source_value, round(t.v, 4) AS target_value, round(t.v - s.v, 4) AS delta FROM
 (UNPIVOT (SELECT {e} FROM {a}) ON COLUMNS(*) INTO NAME name VALUE v) s JOIN (UNPIVOT (SELECT {e} FROM {b}) ON COLUMNS(*) INTO NAME name VALUE v) t USING (name)"""


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select("name", *[F.round(c, digits).alias(c) for c in ("source_value", "target_value", "delta")])


@query(f"WITH {_TARGET} " + _DELTAS.format(e=", ".join(f'CAST({s}(o_totalprice) AS double) AS "o_totalprice.{s}"' for s in ("sum", "min", "max", "avg")), a="orders", b="target"))
def rec_aggregate_deltas(spark, d):
    return _rounded(reconcile.aggregate_deltas(source_orders(spark, d), target_orders(spark, d), ["o_totalprice"]), 4)


_QUANTILES = ", ".join(f'quantile_cont(CAST({c} AS double), {q / 100}) AS "{c}.p{q}"' for c in ("l_quantity", "l_extendedprice") for q in (50, 95, 99))


@query(_DELTAS.format(e=_QUANTILES, a="lineitem", b="lineitem WHERE l_orderkey % 97 <> 0"))
def rec_quantile_deltas(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return _rounded(reconcile.quantile_deltas(lines, lines.where("l_orderkey % 97 <> 0"), ["l_quantity", "l_extendedprice"]), 4)


_LINE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey"


@query(f"SELECT {_LINE} AS child_key, CAST(l_orderkey AS varchar) AS reference FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0)")
def rec_referential_errors(spark, d):
    lines, parents = table(spark, d, "lineitem"), table(spark, d, "orders").where("o_orderkey % 97 <> 0")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    return reconcile.referential_errors(lines, key, F.col("l_orderkey"), parents, F.col("o_orderkey"))


def accounts_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Balances made of customers and their orders; every 29th is one off."""
    cents = lambda c: F.col(c).cast("decimal(18,2)")
    even = F.col("o_orderkey") % 2 == 0
    moves = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.sum(F.when(even, cents("o_totalprice"))).alias("credits"), F.sum(F.when(~even, cents("o_totalprice"))).alias("debits")
    )
    zero = F.lit(0).cast("decimal(28,2)")
    joined = table(spark, d, "customer").select("c_custkey", cents("c_acctbal").alias("opening_balance")).join(moves, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = joined.select("c_custkey", "opening_balance", F.coalesce("credits", zero).alias("credits"), F.coalesce("debits", zero).alias("debits"), zero.alias("adjustments"))
    off = F.when(F.col("c_custkey") % 29 == 0, 1).otherwise(0)
    return out.withColumn("closing_balance", F.col("opening_balance") + F.col("credits") - F.col("debits") + off)


_ACCOUNTS = """m AS (SELECT o_custkey, sum(CAST(o_totalprice AS decimal(18,2))) FILTER (o_orderkey % 2 = 0) AS credits,
   sum(CAST(o_totalprice AS decimal(18,2))) FILTER (o_orderkey % 2 <> 0) AS debits FROM orders GROUP BY 1),
 acc AS (SELECT c_custkey, CAST(c_acctbal AS decimal(18,2)) AS opening, coalesce(credits, 0) AS credits, coalesce(debits, 0) AS debits FROM customer LEFT JOIN m ON c_custkey = o_custkey)"""


@query(f"""WITH {_ACCOUNTS} SELECT CAST(c_custkey AS varchar) AS k, round(CAST(opening + credits - debits AS double), 4) AS expected,
  round(CAST(opening + credits - debits + 1 AS double), 4) AS actual, 'balance invariant' AS reason FROM acc WHERE c_custkey % 29 = 0""")
def rec_invariant_failures(spark, d):
    found = reconcile.invariant_failures(accounts_of_orders(spark, d), "c_custkey")
    return found.select("k", F.round("expected", 4).alias("expected"), F.round("actual", 4).alias("actual"), "reason")


@query(f"""WITH {_ACCOUNTS} SELECT CAST(c_custkey AS varchar) AS k FROM acc WHERE c_custkey % 29 = 0 OR c_custkey % 31 = 0""")
def rec_invariant_failures_absolute(spark, d):
    """Within an absolute tolerance alone; every 31st closing balance is no number."""
    closing = F.when(F.col("c_custkey") % 31 == 0, "n/a").otherwise(F.col("closing_balance").cast("string"))
    return reconcile.invariant_failures(accounts_of_orders(spark, d).withColumn("closing_balance", closing), "c_custkey", relative=0).select("k")


@query(f"""WITH {_COMPARED} SELECT (SELECT count(*) FROM orders) AS source_count, (SELECT count(*) FROM target) AS target_count,
  count(*) FILTER (finding = 'missing') AS missing, count(*) FILTER (finding = 'unexpected') AS unexpected, count(*) FILTER (finding = 'duplicate') AS duplicates,
  count(*) FILTER (finding = 'mismatch') AS mismatches, CAST(0 AS bigint) AS referential_errors, CAST(0 AS bigint) AS invariant_errors,
  coalesce(min(k) FILTER (finding = 'missing'), min(k) FILTER (finding = 'mismatch')) AS earliest,
  (SELECT round(sum(t.o_totalprice), 2) FROM target t) - (SELECT round(sum(o_totalprice), 2) FROM orders) AS sum_delta, false AS passed FROM found""")
def rec_verdict(spark, d):
    # Prices stay numbers for the aggregates; rows are compared in the flat form.
    source, target = (flat(x(spark, d)) for x in (source_orders, target_orders))
    report = reconcile.reconcile(source, target, "o_orderkey", ["o_totalprice"], [reconcile.Reference("o_custkey", table(spark, d, "customer"), "c_custkey")])
    return report.select(
        "source_count", "target_count", "missing", "unexpected", "duplicates", "mismatches", "referential_errors", "invariant_errors",
        "earliest", F.round(F.col("deltas")["o_totalprice.sum"], 2).alias("sum_delta"), "passed",
    )


@query(f"""WITH RECURSIVE v AS ({_leaves("orders", 16)}), {_merkle("m", "SELECT bucket, k, h FROM v")}
  SELECT b.bucket, coalesce(x.n, 0) AS n, coalesce(m.root, sha256('""')) AS root FROM (SELECT CAST(range AS integer) AS bucket FROM range(16)) b
  LEFT JOIN (SELECT bucket, CAST(sum(c) AS bigint) AS n FROM v GROUP BY 1) x USING (bucket) LEFT JOIN m USING (bucket)""")
def rec_merkle_buckets(spark, d):
    return reconcile.merkle_buckets(flat(source_orders(spark, d)), "o_orderkey", FLAT, 16)


@query(f"""WITH RECURSIVE {_TARGET}, {_merkle("m", f"SELECT bucket, k, h FROM ({_leaves('orders', 256)})")}, {_merkle("o", f"SELECT bucket, k, h FROM ({_leaves('target', 256)})")}
  SELECT bucket, m.root AS source_root, o.root AS target_root FROM m JOIN o USING (bucket) WHERE m.root <> o.root""")
def rec_differing_buckets(spark, d):
    return reconcile.differing_buckets(flat(source_orders(spark, d)), flat(target_orders(spark, d)), "o_orderkey", FLAT, 256)


@query(f"WITH {_COMPARED} SELECT * FROM found")
def rec_bucket_drilldown(spark, d):
    return reconcile.rows_of_differing_buckets(flat(source_orders(spark, d)), flat(target_orders(spark, d)), "o_orderkey", FLAT, 256)


_KEYJSON = "json_object('o_orderkey', o_orderkey)"


@query(f"""WITH RECURSIVE {_TARGET}, {_merkle("k1", f"SELECT bucket, k, h FROM ({_leaves('orders', 1, _KEYJSON)})")}, {_merkle("k2", f"SELECT bucket, k, h FROM ({_leaves('kept', 1, _KEYJSON)})")},
  {_merkle("r1", f"SELECT bucket, k, h FROM ({_leaves('orders', 1)})")}, {_merkle("r2", f"SELECT bucket, k, h FROM ({_leaves('kept', 1)})")}
  SELECT 'source' AS side, k1.root AS key_hash, r1.root AS row_hash FROM k1, r1 UNION ALL SELECT 'target', k2.root, r2.root FROM k2, r2""")
def rec_key_and_row_hash(spark, d):
    k = F.col("o_orderkey")
    changed = F.when(k % 50 == 7, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice"))
    kept = source_orders(spark, d).where(k % 101 != 0).withColumn("o_totalprice", changed)
    one = lambda df, side: reconcile.key_and_row_hash(flat(df), "o_orderkey", FLAT).select(F.lit(side).alias("side"), "key_hash", "row_hash")
    return one(source_orders(spark, d), "source").unionByName(one(kept, "target"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("customer", "orders", "lineitem")))
def rec_table_counts(spark, d):
    return reconcile.table_counts({t: table(spark, d, t) for t in ("customer", "orders", "lineitem")})


@query("""WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
  SELECT event_type, any_value(n) AS n, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, max(value) FILTER (i = n // 2) AS p50 FROM p GROUP BY 1""")
def obs_metrics(spark, d):
    m = reconcile.upper_median(table(spark, d, "events"), ["event_type"], "value")
    return m.withColumn("mean", F.round("mean", 6))


# --- expressions ------------------------------------------------------------------------------------------------------


def _compiled(df: DataFrame, key: str, expressions: dict[str, str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(key, *[compile_expression(e, types).value.alias(n) for n, e in expressions.items()])


_MESSY = "CASE WHEN c_custkey % 11 = 0 THEN chr(9) || '  ' || c_name || ' ' ELSE c_name END"


def messy_customers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, F.concat(F.lit("\t  "), "c_name", F.lit(" "))).otherwise(F.col("c_name"))
    birthday = F.when(k % 17 == 0, F.lit("31/02/1988")).otherwise(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (k % 9000).cast("int")), "dd/MM/yyyy"))
    return table(spark, d, "customer").select("c_custkey", name.alias("name"), birthday.alias("dob"), F.col("c_acctbal").cast("decimal(12,3)").cast("string").alias("balance"), F.col("c_mktsegment").alias("segment"))


@query(f"SELECT c_custkey, {_MESSY} AS same, trim({_MESSY}, ' ' || chr(9)) AS t, upper(trim({_MESSY}, ' ' || chr(9))) AS u, lower(trim({_MESSY}, ' ' || chr(9))) AS l FROM customer")
def dsl_text(spark, d):
    return _compiled(messy_customers(spark, d), "c_custkey", {"same": "IDENTITY(source.name)", "t": "TRIM(source.name)", "u": "UPPER(source.name)", "l": "LOWER(source.name)"})


_BIRTHDAY = "CASE WHEN c_custkey % 17 <> 0 THEN strftime(DATE '1950-01-01' + CAST(c_custkey % 9000 AS integer), '%Y-%m-%d') END"


@query(f"SELECT c_custkey, {_BIRTHDAY} AS date_of_birth FROM customer")
def dsl_parse_date(spark, d):
    return _compiled(messy_customers(spark, d), "c_custkey", {"date_of_birth": 'PARSE_DATE(source.dob, "DD/MM/YYYY")'})


@query("SELECT c_custkey, CAST(round_even(CAST(c_acctbal AS decimal(12,3)), 2) AS decimal(18,2))::varchar AS two, CAST(CAST(c_acctbal AS decimal(12,3)) AS decimal(18,4))::varchar AS four FROM customer")
def dsl_decimal(spark, d):
    return _compiled(messy_customers(spark, d), "c_custkey", {"two": "DECIMAL(source.balance, scale=2)", "four": "DECIMAL(source.balance)"})


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END AS code FROM customer")
def dsl_map_enum(spark, d):
    return _compiled(messy_customers(spark, d), "c_custkey", {"code": 'MAP_ENUM(source.segment, mapping={"BUILDING": "B", "MACHINERY": "M"})'})


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first_name, CASE WHEN position(' ' IN p_name) > 0 THEN substr(p_name, position(' ' IN p_name) + 1) ELSE '' END AS last_name FROM part")
def dsl_split_name(spark, d):
    return _compiled(table(spark, d, "part"), "p_partkey", {"n": "SPLIT_NAME(source.p_name)"}).select("p_partkey", "n.*")


_RATES = '{"URGENT": "1.1", "HIGH": "0.85"}'


@query("""SELECT o_orderkey, CAST(round_even(CAST(o_totalprice AS decimal(18,2)) * CASE split_part(o_orderpriority, '-', 2) WHEN 'URGENT' THEN 1.1 WHEN 'HIGH' THEN 0.85 ELSE 1 END, 4) AS decimal(20,4))::varchar AS amount FROM orders""")
def dsl_normalize_currency(spark, d):
    df = flat(source_orders(spark, d)).withColumn("code", F.get(F.split("o_orderpriority", "-"), F.lit(1)))
    return _compiled(df, "o_orderkey", {"amount": f"NORMALIZE_CURRENCY(source.o_totalprice, source.code, rates={_RATES})"})


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN CAST(user_id AS varchar) ELSE 'none' END AS v FROM events")
def dsl_coalesce(spark, d):
    i = F.col("event_id")
    df = table(spark, d, "events").select("event_id", F.when(i % 3 == 0, F.col("event_type")).when(i % 3 == 1, F.lit("")).alias("a"), F.when(i % 3 == 1, F.col("user_id")).alias("b"))
    return _compiled(df, "event_id", {"v": 'COALESCE(source.a, source.b, "none")'})


@query(f"""SELECT coalesce(reason, 'loaded') AS reason, count(*) AS rows FROM (SELECT CASE WHEN c_custkey % 17 = 0 THEN 'date_of_birth: invalid date' WHEN c_custkey % 23 = 0 THEN 'balance: invalid decimal' END AS reason FROM customer) GROUP BY 1""")
def dsl_quarantine(spark, d):
    df = messy_customers(spark, d).withColumn("balance", F.when(F.col("c_custkey") % 23 == 0, "n/a").otherwise(F.col("balance")))
    good, bad = transform(df, {"date_of_birth": 'PARSE_DATE(source.dob, "DD/MM/YYYY")', "balance": "DECIMAL(source.balance, scale=2)"})
    return load.audit_balance(good, bad)


@query(f"""SELECT c_custkey, {_BIRTHDAY} AS date_of_birth, upper(trim({_MESSY}, ' ' || chr(9))) AS label, 'date_of_birth=PARSE_DATE(dob), label=UPPER(name)' AS lineage FROM customer WHERE c_custkey % 17 <> 0""")
def dsl_transform(spark, d):
    """The rows that a transformation lets pass, with what made each of their fields."""
    good, _ = transform(messy_customers(spark, d), {"date_of_birth": 'PARSE_DATE(source.dob, "DD/MM/YYYY")', "label": "UPPER(source.name)"})
    made = F.transform("_par_lineage", lambda x: F.concat(x["field"], F.lit("="), x["operation"], F.lit("("), F.array_join(x["inputs"], ", "), F.lit(")")))
    return good.select("c_custkey", "date_of_birth", "label", F.array_join(made, ", ").alias("lineage"))


_STATUS = """CASE WHEN upper(trim(status, ' ' || chr(9) || chr(10) || chr(13))) IN ('Y', 'YES', '1', 'ACTIVE', 'A') THEN 'ACTIVE'
 WHEN upper(trim(status, ' ' || chr(9) || chr(10) || chr(13))) IN ('N', 'NO', '0', 'CLOSED', 'X') THEN 'CLOSED' ELSE 'UNKNOWN' END"""


@query(f"SELECT customer_no AS customer_id, trim(full_name, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS full_name, dob AS date_of_birth, {_STATUS} AS status, phone, country_code FROM legacy_customers")
def map_modernize_customers(spark, d):
    return modernize(table(spark, d, "legacy_customers"), "customers")


@query(f"SELECT acct_no AS account_id, customer_ref AS customer_id, acct_bal AS balance, currency, {_STATUS} AS status, opening_balance, credits, debits, adjustments, closing_balance FROM legacy_accounts")
def map_modernize_accounts(spark, d):
    return modernize(table(spark, d, "legacy_accounts"), "accounts")


@query("SELECT txn_id AS transaction_id, acct_ref AS account_id, amount, currency, txn_type AS type, event_date AS event_time, ingest_date AS ingestion_time FROM legacy_transactions")
def map_modernize_transactions(spark, d):
    return modernize(table(spark, d, "legacy_transactions"), "transactions")


# --- loading ----------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0),
  l AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM b GROUP BY 1)
  SELECT o_custkey, o_orderkey, o_orderstatus FROM l UNION ALL SELECT c_custkey, NULL, 'NONE' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM l)""")
def load_upsert(spark, d):
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("long").alias("o_orderkey"), F.lit("NONE").alias("o_orderstatus"))
    batch = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select("o_custkey", "o_orderkey", "o_orderstatus")
    return load.upsert(target, batch, "o_custkey", [F.col("o_orderkey")])


@query("""WITH l AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1),
  t AS (SELECT c_custkey FROM customer UNION ALL SELECT -c_custkey FROM customer)
  SELECT o_custkey, o_orderkey, o_orderstatus FROM l UNION ALL SELECT c_custkey, NULL, 'NONE' FROM t WHERE c_custkey NOT IN (SELECT o_custkey FROM l)""")
def load_upsert_all(spark, d):
    """All orders; the rows of the target they leave untouched are customers added under keys that no order has."""
    k = F.col("c_custkey")
    customers = table(spark, d, "customer").select("c_custkey")
    target = customers.unionAll(customers.select(-k)).select(k.alias("o_custkey"), F.lit(None).cast("long").alias("o_orderkey"), F.lit("NONE").alias("o_orderstatus"))
    return load.upsert(target, table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", [F.col("o_orderkey")])


@query("SELECT batch, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS bigint) AS batch FROM orders) GROUP BY 1")
def load_batches(spark, d):
    numbered = load.batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000)
    return numbered.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("SELECT user_id AS table_name, 'm1' AS migration_id, max(event_id) AS append_no, max_by(event_type, event_id) AS state FROM events GROUP BY 1")
def load_latest_checkpoint(spark, d):
    points = table(spark, d, "events").select(F.col("user_id").alias("table_name"), F.lit("m1").alias("migration_id"), F.col("event_id").alias("append_no"), F.col("event_type").alias("state"))
    return load.latest_checkpoint(points)


# --- profiles ---------------------------------------------------------------------------------------------------------

PROFILED = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]}
_TYPES = {"n_nationkey": "integer", "n_regionkey": "integer", "c_custkey": "integer", "c_nationkey": "integer", "o_orderkey": "integer", "o_custkey": "integer"}


def _profile_sql() -> str:
    def part(t: str, c: str) -> str:
        return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{_TYPES.get(c, "string")}' AS data_type, count(*) FILTER ({c} IS NULL) > 0 AS nullable, count(*) AS row_count,
          count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT CAST({c} AS varchar)) AS distinct_count, CAST(min({c}) AS varchar) AS min_value, CAST(max({c}) AS varchar) AS max_value,
          (SELECT CAST(to_json(list(struct_pack(value := v, n := n) ORDER BY n DESC, v)) AS varchar) FROM (SELECT CAST({c} AS varchar) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_values FROM {t}"""

    return " UNION ALL ".join(part(t, c) for t, cs in PROFILED.items() for c in cs)


@query(_profile_sql())
def prof_columns(spark, d):
    out = None
    for t, columns in PROFILED.items():
        p = profile.profile_table(table(spark, d, t), columns)
        p = p.select(F.lit(t).alias("table_name"), "column_name", "data_type", "nullable", "row_count", "null_count", "distinct_count", "min_value", "max_value", F.to_json("top_values").alias("top_values"))
        out = p if out is None else out.unionByName(p)
    return out


RELATED = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_nationkey"], "customer": ["c_custkey", "c_nationkey"]}


def _related_sql() -> str:
    text = {"r_name", "n_name"}
    long = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{'string' if c in text else 'integer'}' AS k, CAST({c} AS varchar) AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in RELATED.items() for c in cs)
    return f"""WITH l AS ({long}), s AS (SELECT t, c, k, count(*) AS size FROM l GROUP BY 1, 2, 3),
      x AS (SELECT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2, count(*) AS shared FROM l a JOIN l b ON a.v = b.v AND a.t <> b.t GROUP BY 1, 2, 3, 4),
      p AS (SELECT a.t AS source_table, a.c AS source_column, b.t AS target_table, b.c AS target_column, coalesce(x.shared, 0) AS shared, coalesce(x.shared, 0) / a.size AS coverage,
        0.45 * (CASE WHEN regexp_replace(lower(a.c), '_(ref|id|no|number|key)$', '') = regexp_replace(lower(b.c), '_(ref|id|no|number|key)$', '') THEN 1 ELSE 0 END) + 0.2 * (CASE WHEN a.k = b.k THEN 1 ELSE 0 END) + 0.35 * (coalesce(x.shared, 0) / a.size) AS confidence
        FROM s a JOIN s b ON a.t <> b.t LEFT JOIN x ON x.t1 = a.t AND x.c1 = a.c AND x.t2 = b.t AND x.c2 = b.c)
      SELECT source_table, source_column, target_table, target_column, shared, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence FROM p WHERE confidence >= 0.5"""


@query(_related_sql())
def prof_relationships(spark, d):
    r = profile.relationships({t: table(spark, d, t).select(*c) for t, c in RELATED.items()}, 0.5)
    return r.withColumns({c: F.round(c, 6) for c in ("coverage", "confidence")})


def columns_of_parts(spark: SparkSession, d: str, later: bool = False) -> DataFrame:
    """part as the columns of tables: brands are tables, sizes columns; later some of both have other names or types."""
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "number").when(size % 3 == 1, "string").otherwise("integer")
    table_name, column = F.col("p_brand"), F.concat(F.lit("c"), size)
    if later:
        table_name = F.when(F.col("p_brand").endswith("1"), F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand"))
        column, kind = F.when(size % 11 == 0, F.concat(F.lit("d"), size)).otherwise(column), F.when(size % 7 == 0, "string").otherwise(kind)
    return table(spark, d, "part").select(table_name.alias("table_name"), column.alias("column_name"), kind.alias("data_type")).distinct()


_KINDS_OF_PARTS = "CASE p_size % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'string' ELSE 'integer' END"
_COLUMNS_OF_PARTS = f"""a AS (SELECT DISTINCT p_brand AS t, 'c' || p_size AS c, {_KINDS_OF_PARTS} AS k FROM part),
  b AS (SELECT DISTINCT CASE WHEN p_brand LIKE '%1' THEN p_brand || 'x' ELSE p_brand END AS t, CASE WHEN p_size % 11 = 0 THEN 'd' ELSE 'c' END || p_size AS c, CASE WHEN p_size % 7 = 0 THEN 'string' ELSE {_KINDS_OF_PARTS} END AS k FROM part)"""


@query(f"""WITH {_COLUMNS_OF_PARTS} SELECT DISTINCT t AS table_name, CAST(NULL AS varchar) AS column_name, 'TABLE_REMOVED' AS kind, 'CRITICAL' AS severity FROM a WHERE t NOT IN (SELECT t FROM b)
  UNION ALL SELECT DISTINCT t, NULL, 'TABLE_ADDED', 'SAFE' FROM b WHERE t NOT IN (SELECT t FROM a)
  UNION ALL SELECT t, c, 'COLUMN_REMOVED', 'BREAKING' FROM a WHERE t IN (SELECT t FROM b) AND (t, c) NOT IN (SELECT (t, c) FROM b)
  UNION ALL SELECT t, c, 'COLUMN_ADDED', 'SAFE' FROM b WHERE t IN (SELECT t FROM a) AND (t, c) NOT IN (SELECT (t, c) FROM a)
  UNION ALL SELECT t, c, 'DATATYPE_CHANGED', CASE WHEN 'number' IN (a.k, b.k) AND 'string' IN (a.k, b.k) THEN 'CRITICAL' ELSE 'WARNING' END FROM a JOIN b USING (t, c) WHERE a.k <> b.k""")
def prof_schema_drift(spark, d):
    return profile.compare_schemas(columns_of_parts(spark, d), columns_of_parts(spark, d, True))


@query(f"""WITH {_COLUMNS_OF_PARTS}, m AS (SELECT * FROM (VALUES ('Brand#12.c11', 'Brand#12.d11'), ('Brand#13.c22', 'Brand#13.d22')) AS v(source, target))
  SELECT CASE WHEN m.target IS NULL THEN 'STRUCTURAL_CHANGE' ELSE 'REPRESENTATION_CHANGE' END AS kind, x.source, m.target, m.target IS NULL AS semantic_loss
    FROM (SELECT t || '.' || c AS source FROM a WHERE (t, c) NOT IN (SELECT (t, c) FROM b)) x LEFT JOIN m ON m.source = x.source
  UNION ALL SELECT 'STRUCTURAL_CHANGE', NULL, t || '.' || c, NULL FROM b WHERE (t, c) NOT IN (SELECT (t, c) FROM a) AND t || '.' || c NOT IN (SELECT target FROM m)""")
def prof_semantic_diff(spark, d):
    mappings = {"Brand#12.c11": "Brand#12.d11", "Brand#13.c22": "Brand#13.d22"}
    return profile.semantic_diff(columns_of_parts(spark, d), columns_of_parts(spark, d, True), mappings)


@query("""WITH t AS (SELECT 'legacy_customers' AS t, unnest(['customer_no', 'full_name', 'dob', 'sex', 'status', 'phone', 'country_code', 'updated_at']) AS c)
  SELECT 'pii' AS category, t || '.' || c AS subject, 'LIKELY' AS status, CAST(0.85 AS double) AS confidence FROM t WHERE regexp_matches(c, '(^|_)(name|email|phone|address|ssn|tax|passport|dob|birth|gov|card|account|customer)(_|$)', 'i')
  UNION ALL SELECT 'temporal', t || '.' || c, 'LIKELY', 0.82 FROM t WHERE regexp_matches(c, '(^|_)(date|time|timestamp|created|updated|closed|opened|effective|event)(_|$)', 'i')
  UNION ALL SELECT 'categorical', t || '.' || c, 'OBSERVED', 0.95 FROM t WHERE regexp_matches(c, '(^|_)(status|state|type|stage|phase)(_|$)', 'i')
  UNION ALL SELECT 'business_rule', 'legacy_customers.status', 'INFERRED', 0.55 WHERE EXISTS (SELECT 1 FROM legacy_customers WHERE upper(status) IN ('CLOSED', 'OPEN', 'ACTIVE'))
  UNION ALL SELECT 'identifier', 'legacy_customers.' || c, CASE WHEN u >= 0.99 THEN 'KNOWN' ELSE 'LIKELY' END, round(u, 6) FROM
    (SELECT 'customer_no' AS c, count(DISTINCT customer_no) / count(*) AS u FROM legacy_customers UNION ALL SELECT 'country_code', count(DISTINCT country_code) / count(*) FROM legacy_customers)""")
def prof_findings(spark, d):
    columns = ["customer_no", "full_name", "dob", "sex", "status", "phone", "country_code", "updated_at"]
    found = profile.findings({"legacy_customers": table(spark, d, "legacy_customers").select(*columns)})
    return found.select("category", "subject", "status", F.round("confidence", 6).alias("confidence"))


@query("""SELECT 'legacy_accounts.status' AS subject, (SELECT CAST(to_json(list(v ORDER BY v)) AS varchar) FROM (SELECT DISTINCT status AS v FROM legacy_accounts WHERE status IS NOT NULL ORDER BY v LIMIT 12)) AS detail
  UNION ALL SELECT 'legacy_transactions.txn_type', (SELECT CAST(to_json(list(v ORDER BY v)) AS varchar) FROM (SELECT DISTINCT txn_type AS v FROM legacy_transactions WHERE txn_type IS NOT NULL ORDER BY v LIMIT 12))""")
def prof_categories(spark, d):
    """The first values of columns that are categories by their names: a list of up to 12 is the finding."""
    tables = {"legacy_accounts": table(spark, d, "legacy_accounts").select("acct_no", "status"), "legacy_transactions": table(spark, d, "legacy_transactions").select("txn_id", "txn_type")}
    return profile.findings(tables).where("category = 'categorical'").select("subject", "detail")


_RENAMED = "CASE WHEN column_name LIKE '%_no' THEN replace(column_name, '_no', '_id') WHEN column_name = 'dob' THEN 'date_of_birth' ELSE column_name END"


@query(f"""WITH s AS (SELECT DISTINCT column_name AS a FROM column_profiles), t AS (SELECT DISTINCT {_RENAMED} AS b FROM column_profiles),
  x AS (SELECT a, b, CASE WHEN b LIKE '%date%' THEN 'date' ELSE 'string' END AS k, len(list_intersect(string_split(lower(a), '_'), string_split(lower(b), '_'))) / len(list_distinct(list_concat(string_split(lower(a), '_'), string_split(lower(b), '_')))) AS likeness FROM s, t),
  y AS (SELECT a, b, 0.7 * likeness + 0.3 * CAST(k = 'string' AS integer) AS c FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS r FROM y)
  SELECT a AS source_column, b AS target_column, round(CAST(c AS double), 4) AS confidence, CASE WHEN c < 0.98 THEN 'REVIEW_REQUIRED' ELSE 'PROPOSED' END AS status FROM z WHERE r = 1""")
def prof_mappings(spark, d):
    p = table(spark, d, "column_profiles")
    source = p.select(F.lit(0).alias("position"), F.col("column_name").alias("name"), F.lit("string").alias("data_type")).distinct()
    names = p.select(F.expr(_RENAMED).alias("name")).distinct()
    place = F.row_number().over(Window.orderBy("name"))  # names of columns, a few
    target = names.select(place.alias("position"), "name", F.when(F.col("name").contains("date"), "date").otherwise("string").alias("data_type"))
    return profile.propose_mappings(source, target)


@query("""SELECT metric, round(CAST(distance AS double), 6) AS distance FROM (VALUES ('schema', 5 / 9), ('entity', 1 - 1 / 3), ('relationship', 0.0), ('semantic', 1 - 3 / 6), ('behavioral', (least(1, (SELECT count(*) FROM region)) + least(1, (SELECT count(*) FROM supplier))) / 3)) AS x(metric, distance)""")
def prof_genome_distance(spark, d):
    part = lambda t, *c: table(spark, d, t).select(*c)
    left = {"nation": part("nation", "n_nationkey", "n_name", "n_regionkey"), "region": part("region", "r_regionkey")}
    right = {"nation": part("nation", "n_nationkey", "n_name", "n_regionkey"), "supplier": part("supplier", "s_suppkey", "s_name")}
    found = profile.genome_distance(profile.genome(left), profile.genome(right))
    # The metrics of its twin; prof_genome_distance_legacy has all.
    return found.where("metric in ('schema', 'entity', 'relationship', 'semantic', 'behavioral')").withColumn("distance", F.round("distance", 6))


LEGACY = {
    "legacy_customers": ["customer_no", "full_name", "dob", "sex", "status", "phone", "country_code", "updated_at", "load_id", "loaded_at", "deleted_at"],
    "legacy_accounts": ["acct_no", "customer_ref", "acct_bal", "currency", "status", "opening_balance", "credits", "debits", "adjustments", "closing_balance", "loaded_at", "deleted_at"],
    "legacy_transactions": ["txn_id", "acct_ref", "amount", "currency", "txn_type", "event_date", "ingest_date", "load_id"],
}
_KIND = """CASE WHEN typeof(any_value({c})) IN ('DOUBLE', 'FLOAT') THEN 'number' WHEN typeof(any_value({c})) IN ('INTEGER', 'BIGINT') THEN 'integer' ELSE 'string' END"""


def _legacy_relations_sql() -> str:
    """l, s, x and rel: the relationships of the legacy tables of a confidence of 0.6 or more, from their values."""
    long = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {_KIND.format(c=c)} AS k, CAST({c} AS varchar) AS v FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, cs in LEGACY.items() for c in cs)
    bare = lambda c: f"regexp_replace(lower({c}), '_(ref|id|no|number|key)$', '')"
    return f"""l AS ({long}), s AS (SELECT t, c, k, count(*) AS size FROM l GROUP BY 1, 2, 3),
      x AS (SELECT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2, count(*) AS shared FROM l a JOIN l b ON a.v = b.v AND a.t <> b.t WHERE {bare("a.c")} = {bare("b.c")} GROUP BY 1, 2, 3, 4),
      p AS (SELECT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2, 0.45 + 0.2 * (CASE WHEN a.k = b.k THEN 1 ELSE 0 END) + 0.35 * (coalesce(x.shared, 0) / a.size) AS confidence
        FROM s a JOIN s b ON a.t <> b.t AND {bare("a.c")} = {bare("b.c")} LEFT JOIN x ON x.t1 = a.t AND x.c1 = a.c AND x.t2 = b.t AND x.c2 = b.c),
      rel AS (SELECT * FROM p WHERE confidence >= 0.6)"""


def _legacy_distance_sql() -> str:
    columns = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, CASE WHEN count({c}) = 0 THEN 'unknown' ELSE {_KIND.format(c=c)} END AS k FROM {t}" for t, cs in LEGACY.items() for c in cs)
    sizes = " UNION ALL ".join(f"SELECT '{t}' AS t, CAST(count(*) AS double) AS n FROM {t}" for t in LEGACY)
    pii, identifier = (f"regexp_matches(c, '(^|_)({w})(_|$)', 'i')" for w in ("email|phone|address|ssn|tax|gov|passport|card|account|customer|dob", "id|no|number|code|key|ref"))
    return f"""WITH {_legacy_relations_sql()}, cols AS ({columns}), sizes AS ({sizes}),
      traits AS (SELECT 'entity' AS trait, t AS name, t = 'legacy_transactions' AS gone FROM sizes UNION ALL SELECT 'column', t || '.' || c, t = 'legacy_transactions' FROM cols
        UNION ALL SELECT 'semantic', t || '.' || c || ':' || CASE WHEN {pii} THEN 'pii' WHEN {identifier} THEN 'identifier' ELSE k END, t = 'legacy_transactions' FROM cols
        UNION ALL SELECT 'temporal', t || '.' || c, t = 'legacy_transactions' FROM cols WHERE regexp_matches(c, '(^|_)(date|time|timestamp|created|updated|closed|opened|effective|event)(_|$)', 'i')
        UNION ALL SELECT 'distribution', t || '.' || c, t = 'legacy_transactions' FROM cols WHERE k <> 'unknown'
        UNION ALL SELECT 'invariant', 'balance', false UNION ALL SELECT 'invariant', 'totals', true
        UNION ALL SELECT 'relationship', t1 || ':' || c1 || '->' || t2 || ':' || c2, 'legacy_transactions' IN (t1, t2) FROM rel),
      m AS (SELECT * FROM (VALUES ('schema', 'entity'), ('schema', 'column'), ('entity', 'entity'), ('relationship', 'relationship'), ('semantic', 'semantic'), ('temporal', 'temporal'), ('distribution', 'distribution'), ('invariant', 'invariant')) AS v(metric, trait))
      SELECT metric, round(CAST(count(*) FILTER (gone) / count(*) AS double), 6) AS distance FROM m JOIN traits USING (trait) GROUP BY 1
      UNION ALL SELECT 'behavioral', round(avg(CASE WHEN t = 'legacy_transactions' THEN least(1, n) ELSE 0 END), 6) FROM sizes"""


@query(_legacy_distance_sql())
def prof_genome_distance_legacy(spark, d):
    """Whole tables that have relationships, with and without one of them."""
    tables = {t: table(spark, d, t) for t in LEGACY}
    found = profile.genome_distance(profile.genome(tables, ["balance", "totals"]), profile.genome({t: df for t, df in tables.items() if t != "legacy_transactions"}, ["balance"]))
    return found.withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_legacy_relations_sql()} SELECT t1 || '.' || c1 AS subject, 'INFERRED' AS status, round(CAST(confidence AS double), 6) AS confidence, 'to ' || t2 || '.' || c2 AS detail FROM rel""")
def prof_findings_relationships(spark, d):
    found = profile.findings({t: table(spark, d, t) for t in LEGACY}).where("category = 'relationship'")
    return found.select("subject", "status", F.round("confidence", 6).alias("confidence"), "detail")


@query("""SELECT 2 AS entity_count, 5 AS column_count, 0 AS relationship_count, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS row_count""")
def prof_genome_summary(spark, d):
    tables = {"nation": table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "region": table(spark, d, "region").select("r_regionkey", "r_name")}
    return profile.genome_summary(profile.genome(tables)).select("entity_count", "column_count", "relationship_count", "row_count")


@query("""WITH n AS (SELECT DISTINCT column_name AS name FROM column_profiles)
  SELECT name, regexp_matches(name, '(^|_)(id|no|number|code|key|ref)(_|$)', 'i') AS identifier, regexp_replace(lower(name), '_(ref|id|no|number|key)$', '') AS bare,
  CAST(len(list_filter(['customer', 'date', 'code'], lambda x: list_contains(string_split(lower(name), '_'), x))) AS double) / len(list_distinct(list_concat(['customer', 'date', 'code'], string_split(lower(name), '_')))) AS likeness FROM n""")
def name_functions(spark, d):
    n = F.col("name")
    names = table(spark, d, "column_profiles").select(F.col("column_name").alias("name")).distinct()
    return names.select("name", is_kind(n, "identifier").alias("identifier"), without_suffix(n).alias("bare"), likeness(F.lit("customer_date_code"), n).alias("likeness"))


# --- changes ----------------------------------------------------------------------------------------------------------


def change_log(spark: SparkSession, d: str) -> DataFrame:
    """events as a change log of users: signup inserts, error deletes, others update; some lost, some sent twice."""
    i = F.col("event_id")
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    after = F.when((op != "DELETE") & (i % 41 != 0), F.to_json(F.struct("event_type", "user_id")))
    log = table(spark, d, "events").where((i % 37 != 0) | (i == 0)).select(
        i.cast("string").alias("event_id"), F.concat(F.lit("t"), F.col("user_id") % 2).alias("table_name"), F.col("user_id").cast("string").alias("primary_key"),
        op.alias("operation"), after.alias("after"), i.alias("sequence"),
    )
    return log.unionAll(log.where("sequence % 10 = 0"))


_LOG = """one AS (SELECT CAST(event_id AS varchar) AS event_id, 't' || user_id % 2 AS table_name, CAST(user_id AS varchar) AS primary_key,
   CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
   CASE WHEN event_type <> 'error' AND event_id % 41 <> 0 THEN CAST(json_object('event_type', event_type, 'user_id', user_id) AS varchar) END AS after, event_id AS sequence
   FROM events WHERE event_id % 37 <> 0 OR event_id = 0),
 log AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE sequence % 10 = 0)"""


@query(f"WITH {_LOG} SELECT DISTINCT * FROM log")
def cdc_deduplicate(spark, d):
    return cdc.deduplicate(change_log(spark, d))


@query(f"WITH {_LOG} SELECT table_name, sequence + 1 AS first, nx - 1 AS last FROM (SELECT table_name, sequence, lead(sequence) OVER (PARTITION BY table_name ORDER BY sequence) AS nx FROM one) WHERE nx > sequence + 1")
def cdc_gaps(spark, d):
    return cdc.gaps(change_log(spark, d), width=500)


@query(f"WITH {_LOG} SELECT '*' AS table_name, sequence + 1 AS first, nx - 1 AS last FROM (SELECT sequence, lead(sequence) OVER (ORDER BY sequence) AS nx FROM one) WHERE nx > sequence + 1")
def cdc_gaps_over_tables(spark, d):
    return cdc.gaps(change_log(spark, d), legacy=True, width=500)


_REPLAY = "SELECT table_name, primary_key, after AS row FROM (SELECT *, row_number() OVER (PARTITION BY table_name, primary_key ORDER BY sequence DESC, event_id DESC) AS rn FROM one WHERE {w}) WHERE rn = 1 AND operation <> 'DELETE'"


@query(f"WITH {_LOG} " + _REPLAY.format(w="operation = 'DELETE' OR after IS NOT NULL"))
def cdc_replay_lenient(spark, d):
    return cdc.replay(None, change_log(spark, d), strict=False)


@query(f"""WITH {_LOG}, r AS ({_REPLAY.format(w="sequence % 41 <> 0")}) SELECT * FROM r UNION ALL SELECT 't0', 'new' || r_regionkey, CAST(json_object('r', r_name) AS varchar) FROM region""")
def cdc_replay(spark, d):
    base = table(spark, d, "region").select(F.lit("t0").alias("table_name"), F.concat(F.lit("new"), "r_regionkey").alias("primary_key"), F.to_json(F.struct(F.col("r_name").alias("r"))).alias("row"))
    return cdc.replay(base, change_log(spark, d).where("sequence % 41 <> 0"))


@query(f"WITH {_LOG} SELECT operation, max(sequence) AS applied, greatest(0, (SELECT max(sequence) FROM log) - max(sequence)) AS lag FROM log GROUP BY 1")
def cdc_lag(spark, d):
    log = change_log(spark, d)
    newest = F.broadcast(log.agg(F.max("sequence").alias("captured")))  # one row
    per = log.groupBy("operation").agg(F.max("sequence").alias("applied"))
    return per.crossJoin(newest).select("operation", "applied", cdc.lag(F.col("captured"), F.col("applied")).alias("lag"))


@query(f"WITH {_LOG} SELECT event_id, sequence FROM log WHERE sequence > 500")
def cdc_after_offset(spark, d):
    return cdc.after_offset(change_log(spark, d), 500).select("event_id", "sequence")


@query(f"WITH {_LOG} SELECT sequence, sha256(json_object('after', after, 'operation', operation, 'primary_key', primary_key, 'sequence', sequence, 'table_name', table_name)) AS event_id FROM log")
def cdc_event_ids(spark, d):
    return cdc.make_events(change_log(spark, d).drop("event_id")).select("sequence", "event_id")


@query()
def cdc_stream_replay(spark, d):
    from paritas.session import shared_folder
    from paritas.streaming.cdc import apply_changes, current_rows
    import uuid

    root = f"{shared_folder(spark)}/paritas/stream-{uuid.uuid4().hex}"
    change_log(spark, d).write.parquet(f"{root}/log")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/log").schema).parquet(f"{root}/log")
    apply_changes(stream, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return current_rows(spark, f"{root}/state")


SQL["cdc_stream_replay"] = SQL["cdc_replay_lenient"]


# --- meanings ---------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, p_name, CAST(p_size AS varchar) AS size, CASE p_partkey % 3 WHEN 0 THEN '  ' || upper(p_name) || chr(9) WHEN 1 THEN p_name || '!' ELSE p_name END AS name2,
    CASE WHEN p_partkey % 3 = 0 THEN p_size || '.0' ELSE CAST(p_size AS varchar) END AS size2 FROM part)
  SELECT CAST(p_partkey AS varchar) AS k, p_partkey % 3 = 2 AS byte_equivalent, p_partkey % 3 <> 1 AS semantic_equivalent, sha256(json_object('p_name', p_name, 'p_partkey', p_partkey, 'size', size)) AS source_byte_hash,
    sha256(json_object('p_name', name2, 'p_partkey', p_partkey, 'size', size2)) AS target_byte_hash, sha256(json_object('p_name', lower(p_name), 'p_partkey', CAST(p_partkey AS varchar), 'size', size)) AS source_semantic_hash,
    sha256(json_object('p_name', lower(p_name) || CASE WHEN p_partkey % 3 = 1 THEN '!' ELSE '' END, 'p_partkey', CAST(p_partkey AS varchar), 'size', size)) AS target_semantic_hash FROM p""")
def sem_compare(spark, d):
    k = F.col("p_partkey")
    a = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("string").alias("size"))
    name = F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t"))).when(k % 3 == 1, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    size = F.when(k % 3 == 0, F.concat("size", F.lit(".0"))).otherwise(F.col("size"))
    return semantic_compare.compare_rows(a, a.select("p_partkey", name.alias("title"), size.alias("size")).withColumnRenamed("title", "p_name"), "p_partkey")


@query("""SELECT p_partkey, sha256(json_object('label', lower(p_name), 'size', CAST(p_size AS varchar))) AS meaning FROM part""")
def sem_fingerprints(spark, d):
    from paritas.functions.semantic import semantic_fingerprint

    df = table(spark, d, "part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("p_name"), F.concat("p_size", F.lit(".00")).alias("size"), "p_partkey")
    return df.select("p_partkey", semantic_fingerprint(df.drop("p_partkey"), {"p_name": "label"}).alias("meaning"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size * 100 AS varchar) WHEN 1 THEN '0.0000000000000' || rtrim(CAST(p_partkey AS varchar), '0') WHEN 2 THEN '-' || p_partkey || '.00000000000049'
  WHEN 3 THEN 'σίσυφοσ ffi ' || lower(p_name) WHEN 4 THEN p_partkey || '12345678901234567890123456789' WHEN 5 THEN '0' WHEN 6 THEN '7E+' || (p_partkey + 98) ELSE '2024-02-29T10:00:00+00:00' END AS meaning FROM part""")
def sem_values(spark, d):
    """Notations of one value: exponents, digits beyond any decimal, nought, foldings to several letters, moments."""
    from paritas.functions.semantic import normalize_scalar

    k, say = F.col("p_partkey"), lambda *x: F.concat(*x)
    raw = (
        F.when(k % 8 == 0, say("p_size", F.lit(".0e+2")))
        .when(k % 8 == 1, say(F.lit("+.0000000000000"), "p_partkey"))
        .when(k % 8 == 2, say(F.lit(" -00"), "p_partkey", F.lit(".000000000000490")))
        .when(k % 8 == 3, say(F.lit("ΣΊΣΥΦΟς \t\ufb03 "), F.upper("p_name")))
        .when(k % 8 == 4, say("p_partkey", F.lit("12345678901234567890123456789.00")))
        .when(k % 8 == 5, F.lit("-0.0e7"))
        .when(k % 8 == 6, say(F.lit("0.07E"), k + 100))
        .otherwise(F.lit("2024-02-29 10:00:00"))
    )
    return table(spark, d, "part").select("p_partkey", normalize_scalar(raw, "string").alias("meaning"))


_SEMLEAF = """SELECT CAST(('0x' || substr(sha256('"' || p_partkey || '"'), 1, 8))::BIGINT % 8 AS integer) AS bucket, CAST(p_partkey AS varchar) AS k,
  sha256(json_object('p_name', lower(p_name), 'p_partkey', CAST(p_partkey AS varchar))) AS h FROM part"""


@query(f"""WITH RECURSIVE {_merkle("m", _SEMLEAF)} SELECT m.bucket, x.n, m.root FROM m JOIN (SELECT bucket, count(*) AS n FROM ({_SEMLEAF}) GROUP BY 1) x USING (bucket)""")
def sem_merkle(spark, d):
    return semantic_compare.semantic_buckets(table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("p_name")), "p_partkey", buckets=8)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS varchar) WHEN p_partkey % 4 = 1 THEN CAST(p_size AS varchar) || '.5' WHEN p_partkey % 4 = 2 THEN lower(p_name) END AS v FROM part""")
def sem_number_text(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat("p_size", F.lit(".000"))).when(k % 4 == 1, F.concat(F.lit(" "), "p_size", F.lit(".50"))).when(k % 4 == 2, F.concat(F.lit(" "), F.upper("p_name")))
    return table(spark, d, "part").select("p_partkey", normalize_number_text(raw).alias("v"))


@query("""SELECT n_nationkey, json_object('n_name', n_name, 'n_nationkey', n_nationkey, 'none', NULL)::varchar AS canonical, sha256('"' || n_name || '"') AS digest FROM nation""")
def hash_canonical(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none"))
    return df.select("n_nationkey", canonical_json(df.columns).alias("canonical"), sha256_text(F.col("n_name")).alias("digest"))


@query("SELECT count(*) AS rows, ['n_name', 'n_nationkey', 'n_regionkey']::varchar AS columns FROM nation")
def src_fingerprint(spark, d):
    from paritas.sources.sinks import row_count_and_columns

    told = row_count_and_columns(table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name"))
    return told.select("rows", F.concat(F.lit("["), F.array_join("columns", ", "), F.lit("]")).alias("columns"))


@query("SELECT n_nationkey, sha256(json_object('n_name', n_name, 'n_nationkey', n_nationkey)) AS digest FROM nation")
def hash_without_system_columns(spark, d):
    from paritas.functions.hashing import row_fingerprint, strip_system

    plain = strip_system(table(spark, d, "nation").select("n_nationkey", "n_name", F.lit("x").alias("_par_lineage"), F.col("n_regionkey").alias("_par_batch")))
    return plain.select("n_nationkey", row_fingerprint(plain.columns).alias("digest"))


@query("SELECT count(*) AS rows, count(DISTINCT (o_custkey, o_orderstatus)) AS digests FROM orders")
def hash_fast(spark, d):
    h = labelled_fingerprint({"Customer": F.col("o_custkey"), "Status": F.col("o_orderstatus")})
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(h).alias("digests"))


# --- times, evidence, what-if -----------------------------------------------------------------------------------------

CUTOFF = "2024-01-15 12:00:00"


def temporal_records(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("record_id"), F.col("ts").alias("event_time"), (F.col("ts") + F.expr("interval 1 hour")).alias("data_time"), F.timestamp_add("DAY", (i % 5).cast("int"), F.col("ts")).alias("knowledge_time"))


_KNOWN = f"ts + to_days(CAST(event_id % 5 AS integer)) <= TIMESTAMP '{CUTOFF}'"


@query(f"SELECT event_id AS record_id FROM events WHERE {_KNOWN}")
def time_as_of(spark, d):
    return temporal.as_of(temporal_records(spark, d), CUTOFF).select("record_id")


@query(f"SELECT event_id AS record_id, 'newly_known' AS change FROM events WHERE NOT ({_KNOWN})")
def time_knowledge_delta(spark, d):
    r = temporal_records(spark, d)
    return temporal.knowledge_delta(r, temporal.as_of(r, CUTOFF))


@query(f"SELECT count(*) FILTER ({_KNOWN}) AS known_count_then, count(*) AS known_count_now FROM events")
def time_known_counts(spark, d):
    r = temporal_records(spark, d)
    return temporal.known_counts(r, temporal.as_of(r, CUTOFF))


@query("SELECT event_id, round(0.9 * pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6) / 30), 6) AS decayed FROM events")
def evidence_decay(spark, d):
    r = table(spark, d, "events").select("event_id", F.lit(0.9).alias("confidence"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("last_verified_at"))
    return evidence.refreshed(r, "2024-02-01 00:00:00").select("event_id", F.round("decayed_confidence", 6).alias("decayed"))


@query("SELECT event_id AS evidence_id, CASE WHEN event_id % 100 = 7 THEN 'CONTRADICTED' ELSE 'DERIVED' END AS status FROM events")
def evidence_conflict(spark, d):
    r = table(spark, d, "events").select(F.col("event_id").alias("evidence_id"), F.lit("DERIVED").alias("status"))
    claims = r.where("evidence_id % 100 = 7").select("evidence_id").unionAll(spark.createDataFrame([(-1,)], "evidence_id long"))
    return evidence.conflict(r, claims)[1]


def evidence_records(spark: SparkSession, d: str) -> DataFrame:
    """events as evidence for their types, the more trusted the greater their value."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("evidence_id"), F.col("event_type").alias("subject"), (F.lit(1.0) - F.pmod("event_id", F.lit(7)) / 10).alias("confidence"),
        F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("last_verified_at"),
    )


_EVIDENCE = "SELECT event_id AS evidence_id, event_type AS subject, 1.0 - (event_id % 7) / 10 AS confidence, ts AS created_at FROM events"


@query(f"""SELECT evidence_id, subject, round(CAST(CASE WHEN evidence_id % 20 = 10 THEN 0.5 ELSE confidence END AS double), 6) AS confidence,
  CASE WHEN evidence_id % 10 = 0 THEN created_at + INTERVAL 1 DAY END AS last_verified_at, CASE WHEN evidence_id % 15 = 0 THEN created_at END AS superseded_at FROM ({_EVIDENCE})""")
def evidence_verified_and_superseded(spark, d):
    r = evidence_records(spark, d)
    i, day = F.col("evidence_id"), F.expr("interval 1 day")
    checks = r.where("evidence_id % 10 = 0").select("evidence_id", (F.col("created_at") + day).alias("verified_at"), F.when(i % 20 == 10, 0.5).alias("confidence"))
    checks = checks.unionAll(checks.withColumn("verified_at", F.col("verified_at") - day))
    out = evidence.superseded(evidence.verified(r, checks), r.where("evidence_id % 15 = 0").select("evidence_id", F.col("created_at").alias("at")))
    return out.select("evidence_id", "subject", F.round("confidence", 6).alias("confidence"), "last_verified_at", "superseded_at")


@query(f"SELECT evidence_id, subject FROM ({_EVIDENCE}) WHERE subject IN (SELECT event_type FROM events WHERE event_id IN (1, 2))")
def evidence_of_subjects(spark, d):
    subjects = table(spark, d, "events").where("event_id in (1, 2)").select(F.col("event_type").alias("subject"))
    return evidence.of_subjects(evidence_records(spark, d), subjects).select("evidence_id", "subject")


@query(f"""SELECT evidence_id, round(c, 6) AS decayed FROM (SELECT evidence_id, confidence * pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 86400e6) / 30) AS c FROM ({_EVIDENCE}))
  ORDER BY c DESC, evidence_id LIMIT 50""")
def evidence_most_trusted(spark, d):
    ranked = evidence.by_confidence(evidence_records(spark, d), "2024-02-01 00:00:00").limit(50)
    return ranked.select("evidence_id", F.round("decayed_confidence", 6).alias("decayed"))


@query("""WITH f AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS fell FROM events GROUP BY 1),
  g AS (SELECT e.user_id, fell, count(*) FILTER (event_type = 'purchase' AND (fell IS NULL OR event_id > fell)) AS gains,
    max_by(event_type, event_id) FILTER (event_type IN ('error', 'purchase')) AS last FROM events e JOIN f USING (user_id) GROUP BY 1, 2)
  SELECT user_id AS assumption_id, round(least(1.0, CASE WHEN fell IS NULL THEN 0.9 ELSE 0 END + 0.05 * gains)::double, 6) AS confidence,
    CASE last WHEN 'purchase' THEN 'VALIDATED' WHEN 'error' THEN 'INVALIDATED' ELSE 'INFERRED' END AS status FROM g""")
def assume_states(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "contradicted").when(F.col("event_type") == "purchase", "validated").otherwise("seen")
    events = e.select(F.col("user_id").alias("assumption_id"), F.col("event_id").alias("event_no"), kind.alias("kind"))
    held = e.select(F.col("user_id").alias("assumption_id")).distinct().select("assumption_id", F.lit(0.9).alias("confidence"), F.lit("INFERRED").alias("status"))
    return evidence.assumption_states(held, events).withColumn("confidence", F.round("confidence", 6))


@query("""WITH l AS (SELECT user_id, max_by(event_type, event_id) FILTER (event_type IN ('error', 'purchase')) AS last FROM events GROUP BY 1)
  SELECT DISTINCT c_custkey % 200 AS assumption_id, c_custkey AS result_id FROM customer WHERE c_custkey % 200 IN (SELECT user_id FROM l WHERE last = 'error')""")
def assume_affected(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "contradicted").when(F.col("event_type") == "purchase", "validated")
    events = e.select(F.col("user_id").alias("assumption_id"), F.col("event_id").alias("event_no"), kind.alias("kind"))
    held = e.select(F.col("user_id").alias("assumption_id")).distinct().select("assumption_id", F.lit(0.9).alias("confidence"), F.lit("INFERRED").alias("status"))
    depends = table(spark, d, "customer").select((F.col("c_custkey") % 200).alias("assumption_id"), F.col("c_custkey").alias("result_id"))
    return evidence.affected_results(evidence.assumption_states(held, events), depends)


def mapping_events(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("event_type").isin("purchase", "error"), "approve").otherwise("propose")
    return table(spark, d, "events").select(F.col("user_id").alias("mapping_id"), F.col("event_id").alias("event_no"), action.alias("action"), F.col("event_type").alias("actor"))


_VERSIONS = """k AS (SELECT user_id AS mapping_id, event_id AS event_no, event_type AS actor, event_type IN ('purchase', 'error') AS approves,
    coalesce(lag(event_type NOT IN ('purchase', 'error')) OVER (PARTITION BY user_id ORDER BY event_id), false) AS waiting FROM events),
  v AS (SELECT mapping_id, event_no, CASE WHEN NOT approves THEN 'PROPOSED' WHEN waiting THEN 'APPROVED' ELSE 'REFUSED' END AS status,
    CAST(coalesce(sum(CASE WHEN approves AND waiting THEN 1 ELSE 0 END) OVER (PARTITION BY mapping_id ORDER BY event_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + CASE WHEN approves AND NOT waiting THEN 0 ELSE 1 END AS integer) AS version, CASE WHEN approves AND waiting THEN actor END AS approved_by FROM k)"""


@query(f"WITH {_VERSIONS} SELECT * FROM v")
def map_versions(spark, d):
    return registry.mapping_versions(mapping_events(spark, d)).select("mapping_id", "event_no", "status", "version", "approved_by")


@query(f"""WITH {_VERSIONS}, l AS (SELECT *, row_number() OVER (PARTITION BY mapping_id ORDER BY event_no DESC) AS r FROM v WHERE status <> 'REFUSED')
  SELECT mapping_id, event_no, version, approved_by FROM l WHERE r = 1 AND status = 'APPROVED'""")
def map_approved(spark, d):
    return registry.approved_mappings(mapping_events(spark, d)).select("mapping_id", "event_no", "version", "approved_by")


_STATE_OF = {"signup": "VALIDATING", "view": "PLANNED", "click": "APPROVED", "purchase": "RUNNING", "error": "FAILED"}
_STATE_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATE_OF.items()) + " END"


@query(f"""WITH m AS (SELECT user_id AS migration_id, event_id AS entry_no, {_STATE_CASE} AS new_state FROM events),
  o AS (SELECT *, coalesce(lag(new_state) OVER (PARTITION BY migration_id ORDER BY entry_no), 'DRAFT') AS old_state FROM m)
  SELECT *, old_state || '>' || new_state IN ({", ".join(f"'{a}>{b}'" for a, bs in governance.STATES.items() for b in bs)}) AS allowed FROM o""")
def gov_state_moves(spark, d):
    states = F.create_map(*[F.lit(x) for pair in _STATE_OF.items() for x in pair])
    log = table(spark, d, "events").select(F.col("user_id").alias("migration_id"), F.col("event_id").alias("entry_no"), F.try_element_at(states, F.col("event_type")).alias("new_state"))
    return governance.state_moves(log).select("migration_id", "entry_no", "old_state", "new_state", "allowed")


_ROLE = "CASE n_nationkey % 7 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'OPERATOR' WHEN 2 THEN 'AUDITOR' WHEN 3 THEN 'READ_ONLY' WHEN 4 THEN 'APPROVER' WHEN 5 THEN 'MIGRATION_ENGINEER' ELSE 'NOBODY' END"
_ACTION = "CASE n_regionkey WHEN 0 THEN 'inspect' WHEN 1 THEN 'migrate' WHEN 2 THEN 'approve_cutover' WHEN 3 THEN 'pause' ELSE 'audit' END"


@query(f"""WITH q AS (SELECT n_nationkey, {_ROLE} AS role, {_ACTION} AS action FROM nation)
  SELECT *, role = 'ADMIN' OR role || ':' || action IN ({", ".join(f"'{a}:{b}'" for a, bs in governance.ROLES.items() for b in bs)}) AS allowed FROM q""")
def gov_permitted(spark, d):
    return governance.permitted(table(spark, d, "nation").select("n_nationkey", F.expr(_ROLE).alias("role"), F.expr(_ACTION).alias("action")))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'reconciliation did not pass' END, CASE WHEN o_orderkey % 5 > 2 THEN 'change lag ' || o_orderkey % 5 || ' above 2' END,
   CASE WHEN o_orderkey % 6 = 1 THEN 'breaking schema change' END, CASE WHEN o_orderkey % 7 = 1 THEN 'personal data in logs' END,
   CASE WHEN o_orderkey % 8 = 1 AND o_orderkey % 3 <> 0 THEN 'risk HIGH needs an approval' END], lambda x: x IS NOT NULL), '; ') AS reasons,
   CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 5 > 2 OR o_orderkey % 6 = 1 OR o_orderkey % 7 = 1 OR (o_orderkey % 8 = 1 AND o_orderkey % 3 <> 0) THEN 0 ELSE 10 END AS steps FROM orders""")
def gov_gate(spark, d):
    k = F.col("o_orderkey")
    reports = table(spark, d, "orders").select(
        k, (k % 4 != 0).alias("reconciled"), (k % 5).alias("cdc_lag"), F.lit(2).alias("max_lag"), (k % 6 == 1).alias("breaking_change"), (k % 7 == 1).alias("pii_logging"),
        F.when(k % 8 == 1, "HIGH").otherwise("LOW").alias("risk_level"), F.when(k % 3 == 0, "someone").alias("approved_by"),
    )
    return governance.gate(reports).select("o_orderkey", F.concat_ws("; ", "reasons").alias("reasons"), F.size("steps").alias("steps"))


@query("""WITH m AS (SELECT CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'gauge' ELSE 'timer' END AS kind, event_type AS name, event_id AS pos, value FROM events WHERE value IS NOT NULL),
  t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY name) AS c FROM m WHERE kind = 'timer')
  SELECT kind, name, round(sum(value), 4) AS value, NULL AS n, NULL AS least, NULL AS greatest, NULL AS mean, NULL AS p50 FROM m WHERE kind = 'counter' GROUP BY 1, 2
  UNION ALL SELECT kind, name, round(max_by(value, pos), 4), NULL, NULL, NULL, NULL, NULL FROM m WHERE kind = 'gauge' GROUP BY 1, 2
  UNION ALL SELECT kind, name, NULL, any_value(c), min(value), max(value), round(avg(value), 4), max(value) FILTER (i = c // 2) FROM t GROUP BY 1, 2""")
def obs_measured(spark, d):
    kind = F.when(F.col("event_type") == "click", "counter").when(F.col("event_type") == "view", "gauge").otherwise("timer")
    m = governance.measured(table(spark, d, "events").select(kind.alias("kind"), F.col("event_type").alias("name"), F.col("event_id").alias("at"), "value"))
    return m.withColumns({c: F.round(c, 4) for c in ("value", "mean")})


def audit_entries(spark: SparkSession, d: str) -> DataFrame:
    """nation as a ledger of one chain a region: the links are right but for entries of every tenth nation."""
    n = F.col("n_nationkey")
    text = lambda x: F.lit(x).cast("string")
    return table(spark, d, "nation").select(
        n.alias("entry_no"), F.col("n_regionkey").cast("string").alias("migration_id"), F.col("n_name").alias("actor"), text("MOVE").alias("action"), text(None).alias("old_state"),
        text("RUNNING").alias("new_state"), text("test").alias("reason"), text("e").alias("evidence_hash"), text("2024-01-01").alias("at"), text("").alias("previous_hash"),
    ).withColumn("entry_hash", F.when(F.col("entry_no") % 10 == 3, "broken").otherwise(evidence.entry_hash()))


@query("""SELECT CAST(n_regionkey AS varchar) AS migration_id, n_nationkey AS entry_no, 'previous hash mismatch' AS fault FROM nation n WHERE n_nationkey > (SELECT min(n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey)
  UNION ALL SELECT CAST(n_regionkey AS varchar), n_nationkey, 'entry hash mismatch' FROM nation WHERE n_nationkey % 10 = 3""")
def evidence_chain(spark, d):
    return evidence.verify_chain(audit_entries(spark, d))


@query("""WITH r AS (SELECT * FROM orders WHERE o_orderkey = 7) SELECT '7' AS removed, CAST(r.o_custkey AS varchar) AS account, -r.o_totalprice AS delta,
  (SELECT count(*) FROM orders o WHERE o.o_custkey = r.o_custkey AND o.o_orderkey <> 7) AS touched FROM r""")
def what_remove_transaction(spark, d):
    return whatif.remove_transaction(table(spark, d, "orders"), "o_orderkey", 7, "o_custkey", "o_totalprice")


@query("SELECT CAST(o_orderkey AS varchar) AS k FROM orders WHERE o_orderkey <> 7 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7)")
def what_remove_transaction_touched(spark, d):
    return whatif.touched_transactions(table(spark, d, "orders"), "o_orderkey", 7, "o_custkey")


@query(f"""WITH RECURSIVE rest AS (SELECT * FROM orders WHERE o_orderkey <> 7), {_merkle("m1", f"SELECT bucket, k, h FROM ({_leaves('orders', 1)})")}, {_merkle("m2", f"SELECT bucket, k, h FROM ({_leaves('rest', 1)})")}
  SELECT m1.root AS before, m2.root AS after FROM m1, m2""")
def what_remove_transaction_fingerprints(spark, d):
    return whatif.fingerprints_without(flat(source_orders(spark, d)), "o_orderkey", 7)


@query("""SELECT user_id AS entity, json_object('type', max_by(event_type, event_id))::varchar AS state, CAST(greatest(0, least(1, round(0.55 + 0.1 * count(*) - 0.15, 6))) AS double) AS confidence FROM events GROUP BY 1""")
def what_reconstruct(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("position"), F.to_json(F.struct(F.col("event_type").alias("type"))).alias("state"))
    return whatif.reconstruct_state(s, invariants=["type", "balance"]).withColumn("confidence", F.round("confidence", 6))


_FACTOR = "CASE n_nationkey % 9 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(scores.WEIGHTS)) + " ELSE 'unknown' END"


def _risk_sql() -> str:
    shown = {f: (f"1 - {f}" if f == scores.INVERTED else f) for f in scores.WEIGHTS}
    total = " + ".join(f"greatest(0, least(1, {x})) * {scores.WEIGHTS[f]}" for f, x in shown.items())
    reasons = ", ".join(f"CASE WHEN {x} >= 0.7 THEN '{f}' END" for f, x in shown.items())
    given = ", ".join(f"coalesce(max(v) FILTER (f = '{f}'), 0) AS {f}" for f in scores.WEIGHTS)
    return f"""WITH g AS (SELECT s AS subject, {given} FROM (SELECT n_regionkey AS s, {_FACTOR} AS f, CAST(n_nationkey % 5 AS double) / 4 AS v FROM nation) GROUP BY 1), r AS (SELECT subject, {total} AS raw,
      array_to_string(list_filter([{reasons}], lambda x: x IS NOT NULL), ',') AS reasons FROM g)
      SELECT subject, round(CAST(raw AS double), 4) AS score, CASE WHEN raw >= 0.75 THEN 'CRITICAL' WHEN raw >= 0.5 THEN 'HIGH' WHEN raw >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS level, reasons FROM r"""


@query(_risk_sql())
def score_risk(spark, d):
    factors = table(spark, d, "nation").select(F.col("n_regionkey").alias("subject"), F.expr(_FACTOR).alias("factor"), ((F.col("n_nationkey") % 5) / 4).alias("value"))
    return scores.risk(factors).withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT o_custkey AS migration_id, CASE WHEN coalesce(bool_and(coalesce(o_orderstatus <> 'P' AND o_orderkey % 9 <> 0, false)) FILTER (o_orderkey % 2 = 0), false) THEN 'CERTIFIED' ELSE 'NOT_CERTIFIED' END AS status FROM orders GROUP BY 1""")
def score_certification(spark, d):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    passed = F.when((status != "P") & (k % 9 != 0), True).when(k % 9 == 0, False)
    return scores.certify(table(spark, d, "orders").select(F.col("o_custkey").alias("migration_id"), k.cast("string").alias("name"), passed.alias("passed"), (k % 2 == 0).alias("required")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_size > 5 THEN 'PASSED' ELSE 'INCONCLUSIVE' END AS status FROM part""")
def score_run_status(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k, scores.run_status(k % 2 == 0, F.when(k % 3 == 0, True), F.col("p_size") > 5, F.lit(True)).alias("status"))


_ORDERED = ("region", "nation", "customer", "orders", "lineitem")


@query(" UNION ALL ".join(f"SELECT {i} AS position, '{t}' AS table_name, count(*) AS rows, CAST(ceil(count(*) / 1000) AS bigint) AS batches FROM {t}" for i, t in enumerate(_ORDERED)))
def plan_order(spark, d):
    """The order in which tables that refer to each other load, and their batches."""
    from paritas.plans.migration import build_plan

    counts = {r["table_name"]: r["row_count"] for r in reconcile.table_counts({t: table(spark, d, t) for t in reversed(_ORDERED)}).collect()}
    plan = build_plan(counts, list(zip(_ORDERED, _ORDERED[1:], strict=False)))
    each = [(i, t, counts[t], build_plan({t: counts[t]}).batches) for i, t in enumerate(plan.nodes)]
    return spark.createDataFrame(each, "position int, table_name string, rows long, batches long")


@query("""SELECT CAST(event_id AS varchar) AS event_id, 't' AS table_name, CAST(user_id AS varchar) AS primary_key, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation, event_id AS sequence
  FROM events WHERE event_type <> 'click'""")
def cdc_normalized(spark, d):
    """Events given as JSON texts; those of an unknown operation are left out."""
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "click", "UPSERT").otherwise("UPDATE")
    fields = F.struct(F.col("event_id").cast("string").alias("event_id"), F.lit("t").alias("table"), F.col("user_id").cast("string").alias("primary_key"), op.alias("operation"), F.col("event_id").alias("sequence"))
    raw = table(spark, d, "events").select(F.to_json(fields).alias("json"))
    return cdc.normalize_events(raw, strict=False).select("event_id", "table_name", "primary_key", "operation", "sequence")


@query("SELECT form, n_name, CAST(n_nationkey AS varchar) AS n_nationkey, CAST(n_regionkey AS varchar) AS n_regionkey FROM nation, (VALUES ('csv'), ('lines'), ('list'), ('object'), ('log')) AS f(form)")
def src_file_round_trip(spark, d):
    """nation written as CSV, as JSON lines, as a JSON list behind more blanks than a prefix would show, as a JSON object of
    rows and as a log, and read back through the file source."""
    import uuid

    from paritas.session import shared_folder
    from paritas.sources.files import FileSource
    from paritas.sources.sinks import append_json, read_json_log

    folder = f"{shared_folder(spark)}/paritas/files-{uuid.uuid4().hex}"
    rows = table(spark, d, "nation").select("n_name", "n_nationkey", "n_regionkey")
    rows.write.option("header", True).csv(f"{folder}/csv.csv")
    rows.write.json(f"{folder}/lines.jsonl")
    # A JSON document is one value: nation has 25 rows.
    row = F.to_json(F.struct(*rows.columns))
    rows.agg(F.concat(F.repeat(F.lit(" \n"), F.lit(300)), F.lit("["), F.array_join(F.collect_list(row), ", "), F.lit("]"))).write.text(f"{folder}/list.json")
    named = F.concat(F.lit('"k'), "n_nationkey", F.lit('": '), row)
    rows.agg(F.concat(F.lit(" {"), F.array_join(F.collect_list(named), ", "), F.lit("}"))).write.text(f"{folder}/object.json")
    append_json(rows, f"{folder}-log")
    source = FileSource(spark, folder)
    found = {t: source.read(t) for t in source.tables()} | {"log": read_json_log(spark, f"{folder}-log", "n_nationkey int, n_name string, n_regionkey int")}
    out = None
    for form, df in found.items():
        part = df.select(F.lit(form).alias("form"), *[F.col(c).cast("string").alias(c) for c in rows.columns])
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH i AS (SELECT range AS i FROM range(1, 1001)) SELECT count(*) + count(*) FILTER (i % 23 = 0) AS rows, count(*) FILTER (i % 11 = 0) + count(*) FILTER (i % 23 = 0 AND i % 11 = 0) AS padded,
  count(*) FILTER (i % 17 = 0) + count(*) FILTER (i % 17 = 0 AND i % 23 = 0) AS bad_days, count(*) FILTER (i % 13 = 0) + count(*) FILTER (i % 13 = 0 AND i % 23 = 0) AS bad_phones FROM i""")
def src_synthetic_defects(spark, d):
    from paritas.sources.synthetic import legacy_bank

    n = lambda c: F.count(F.when(c, 1))
    return legacy_bank(spark, customers=1000)["legacy_customers"].agg(
        F.count(F.lit(1)).alias("rows"), n(F.col("full_name").startswith("  ")).alias("padded"), n(F.col("dob") == "31/02/1988").alias("bad_days"), n(F.col("phone") == "INVALID").alias("bad_phones")
    )
