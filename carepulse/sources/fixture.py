"""The canonical admissions view over the driver's TPC-H-like tables.

One line item is one admission; see FIXTURES.md for the mapping.  The same
mapping is written as SQL in :data:`ADMISSIONS_SQL` for the DuckDB oracle, and
here with the DataFrame API, so the two are independent renderings.

At scale the four joins are planned by Catalyst/AQE: dimension sides that are
under ``spark.sql.autoBroadcastJoinThreshold`` are broadcast (Spark checks the
size), the rest become sort-merge joins on their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import COLUMNS

# ------------------------------------------------------------ fixed values
# Blood types by c_nationkey % 8, medications by (l_linenumber + l_partkey) % 5.
BLOOD_TYPES = ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-")
MEDICATIONS = ("Aspirin", "Ibuprofen", "Lipitor", "Paracetamol", "Penicillin")
# Customers by c_custkey % 2, orders by o_orderpriority, line items by l_returnflag.
GENDERS = ("Female", "Male")
ADMISSION_TYPES = ("Emergency", "Urgent", "Elective")
TEST_RESULTS = ("Normal", "Abnormal", "Inconclusive")
ROW_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values, idx):
    """``CASE idx WHEN 0 THEN v0 ... ELSE v_last END`` over a fixed list."""
    out = None
    for i, v in enumerate(values[:-1]):
        out = F.when(idx == i, v) if out is None else out.when(idx == i, v)
    return out.otherwise(values[-1])


def fixture_rows(spark: SparkSession, sf_dir: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """The joined rows in short form, which is what is moved and sorted: age and
    the values from fixed lists as bit fields of ``_kinds`` (gender 1, admission
    type 2, test result 2, blood type 3, age 8 bits), the stay as days;
    :func:`fixture_columns` spells them out.  ``part`` (i, n): the i-th of n parts
    of the orders, by hash."""
    def of_part(df: DataFrame, key: str) -> DataFrame:
        i, n = part
        return df if n == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)

    flag, prio = F.col("l_returnflag"), F.col("o_orderpriority")
    result = F.when(flag == "N", 0).when(flag == "A", 1).otherwise(2)
    kind = F.when(prio.isin("1-URGENT", "2-HIGH"), 0).when(prio == "3-MEDIUM", 1).otherwise(2)
    gender = F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1)
    blood, last = F.col("c_nationkey") % 8, len(BLOOD_TYPES) - 1
    blood = F.when(blood.between(0, last), blood).otherwise(last)
    age = (F.col("c_custkey") * 37 % 90).cast("int")            # -89 to 89
    li = of_part(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        *ROW_KEYS, F.col("l_shipdate").cast("date").alias("date_of_admission"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("billing_amount"),
        (F.floor(F.col("l_quantity") * F.col("l_quantity") / 50).cast("int") + 1).alias("_stay"),
        result.alias("_result"))
    od = of_part(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_custkey", kind.alias("_kind"))
    cu = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("insurance_provider"),
        (gender + blood * 32 + (age + 90) * 256).cast("int").alias("_who"))
    pa = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("medical_condition"),
                                             F.col("p_size").alias("room_number"))
    su = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("hospital"))

    # customers meet the orders first: fewer rows to move than the line items
    oc = od.join(cu, od.o_custkey == cu.c_custkey).select(
        "o_orderkey", "name", "insurance_provider", (F.col("_who") + F.col("_kind") * 2).alias("_who"))
    j = (li.join(oc, li.l_orderkey == oc.o_orderkey)
           .join(pa, li.l_partkey == pa.p_partkey)
           .join(su, li.l_suppkey == su.s_suppkey))
    return j.select(*ROW_KEYS, "name", "medical_condition", "date_of_admission", "hospital",
                    "insurance_provider", "billing_amount", "room_number", "_stay",
                    (F.col("_who") + F.col("_result") * 8).alias("_kinds"))


def fixture_columns(rows: DataFrame) -> DataFrame:
    """The admissions of :func:`fixture_rows`; further columns stay at the end."""
    def field(at: int, bits: int):
        return F.shiftright("_kinds", at).bitwiseAND(F.lit((1 << bits) - 1))
    cols = {
        "age": field(8, 8) - 90,
        "gender": _pick(GENDERS, field(0, 1)),
        "blood_type": _pick(BLOOD_TYPES, field(5, 3)),
        "doctor": F.col("l_partkey").cast("string"),
        "admission_type": _pick(ADMISSION_TYPES, field(1, 2)),
        "discharge_date": F.date_add("date_of_admission", F.col("_stay")),
        "medication": _pick(MEDICATIONS, (F.col("l_linenumber") + F.col("l_partkey")) % 5),
        "test_results": _pick(TEST_RESULTS, field(3, 2)),
    }
    rest = [c for c in rows.columns if c not in (*ROW_KEYS, *COLUMNS, "_stay", "_kinds")]
    return rows.select(*ROW_KEYS, *[cols[c].alias(c) if c in cols else c for c in COLUMNS], *rest)


def fixture_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_columns(fixture_rows(spark, sf_dir))


# The same view as SQL text (DuckDB and Spark SQL both run it unchanged).
ADMISSIONS_SQL = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
  c.c_name AS name,
  CAST(c.c_custkey * 37 % 90 AS INT) AS age,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CASE c.c_nationkey % 8 WHEN 0 THEN 'A+' WHEN 1 THEN 'A-' WHEN 2 THEN 'B+' WHEN 3 THEN 'B-'
       WHEN 4 THEN 'AB+' WHEN 5 THEN 'AB-' WHEN 6 THEN 'O+' ELSE 'O-' END AS blood_type,
  p.p_type AS medical_condition,
  CAST(l.l_shipdate AS DATE) AS date_of_admission,
  CAST(l.l_partkey AS STRING) AS doctor,
  s.s_name AS hospital,
  c.c_mktsegment AS insurance_provider,
  CAST(l.l_extendedprice AS DECIMAL(18,2)) AS billing_amount,
  p.p_size AS room_number,
  CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Emergency'
       WHEN o.o_orderpriority = '3-MEDIUM' THEN 'Urgent' ELSE 'Elective' END AS admission_type,
  CAST(l.l_shipdate AS DATE) + (CAST(FLOOR(l.l_quantity * l.l_quantity / 50) AS INT) + 1) AS discharge_date,
  CASE (l.l_linenumber + l.l_partkey) % 5 WHEN 0 THEN 'Aspirin' WHEN 1 THEN 'Ibuprofen'
       WHEN 2 THEN 'Lipitor' WHEN 3 THEN 'Paracetamol' ELSE 'Penicillin' END AS medication,
  CASE l.l_returnflag WHEN 'N' THEN 'Normal' WHEN 'A' THEN 'Abnormal' ELSE 'Inconclusive' END AS test_results
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""
