"""Register tables derived from the given tables.

customer is the company, orders give its periods and its officers, lineitem the contacts, events the batch log. Every
table is derived whole; expressions on keys only make up attribute values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.functions.company import industry_category, primary_sic, quality_score
from firmlake.functions.hashing import row_hash
from firmlake.operators.latest import latest_per_key
from firmlake.plans.promotion import financial_rows

MONEY = "decimal(15,2)"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has: for small rows that become large documents."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def number(key: str) -> Column:
    return F.expr(f"lpad(CAST({key} AS string), 8, '0')")


def day(c: str) -> Column:
    return F.col(c).cast("date")


def plain(df: DataFrame) -> DataFrame:
    """Types both engines print alike: dates and times as text, money as doubles, whole numbers as bigint."""

    def column(f: T.StructField) -> str:
        c = f"`{f.name}`"
        if isinstance(f.dataType, T.DateType):
            return f"date_format({c}, 'yyyy-MM-dd') AS {c}"
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return f"date_format({c}, 'yyyy-MM-dd HH:mm:ss') AS {c}"
        if isinstance(f.dataType, T.DecimalType):
            return f"CAST({c} AS double) AS {c}"
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return f"CAST({c} AS bigint) AS {c}"
        if isinstance(f.dataType, T.ArrayType):
            return f"array_join(CAST({c} AS array<string>), '|') AS {c}"
        return c

    return df.selectExpr(*[column(f) for f in df.schema])


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """Staging companies, with a few blemishes for the checks to find."""
    customer = read(spark, folder, "customer")
    nation = read(spark, folder, "nation")
    region = read(spark, folder, "region")
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").join(
        region, nation.n_regionkey == region.r_regionkey, "left"
    )
    loaded = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(c_custkey AS int))"
    return rows.selectExpr(
        "concat(CASE WHEN c_acctbal < -900 THEN 'X' ELSE '' END, lpad(CAST(c_custkey AS string), 8, '0')) AS company_number",
        "CASE WHEN NOT c_acctbal BETWEEN 0 AND 50 THEN c_name END AS company_name",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'active' ELSE lower(c_mktsegment) END AS company_status",
        "'Private Limited Company' AS company_type",
        "CASE WHEN c_nationkey = 3 THEN '' ELSE n_name END AS locality",
        "CASE WHEN c_acctbal >= 0 THEN concat('PC', CAST(c_nationkey AS string)) END AS postal_code",
        "r_name AS region",
        """CASE WHEN c_acctbal BETWEEN 9000 AND 9200 THEN CAST(array() AS array<string>)
           ELSE array(concat(CAST(c_custkey * 7 % 90 + 10 AS string), '110'), concat(CAST(c_nationkey + 55 AS string), '200')) END AS sic_codes""",
        "date_add(DATE'1990-01-01', CAST(c_custkey * 37 % 12000 AS int)) AS incorporation_date",
        "'{}' AS raw_data",
        "concat('batch_', lower(c_mktsegment)) AS batch_id",
        "c_acctbal < 0 AS needs_review",
        "CAST(NULL AS string) AS review_notes",
        "c_nationkey < 12 AS change_detected",
        f"{loaded} AS ingested_at",
        f"{loaded} + make_dt_interval(0, c_nationkey) AS last_updated",
        f"CASE WHEN c_acctbal > 5000 THEN {loaded} END AS merged_at",
    )


def hashed(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.withColumn("data_hash", row_hash(rows, fields))


def financials(spark: SparkSession, folder: str) -> DataFrame:
    """Staging financials: one per order, so a company may have two rows for a day."""
    price = "CAST(o_totalprice AS decimal(15,2))"
    owed = f"""CAST({price} * CAST(CASE o_orderpriority WHEN '2-HIGH' THEN 0.20 WHEN '3-MEDIUM' THEN 0.45
        WHEN '4-NOT SPECIFIED' THEN 0.75 WHEN '5-LOW' THEN 1.10 ELSE 0.00 END AS decimal(3,2)) AS decimal(15,2))"""
    unknown = [
        "fixed_assets", "cost_sales", "gross_profit_loss", "operating_profit_loss",
        "profit_loss_on_ordinary_activities_before_tax",
    ]
    return read(spark, folder, "orders").selectExpr(
        "o_orderkey AS financial_id",
        "lpad(CAST(o_custkey AS string), 8, '0') AS company_number",
        "CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS date) ELSE date_sub(CAST(o_orderdate AS date), 365) END AS period_start",
        "CAST(o_orderdate AS date) AS period_end",
        f"CAST({price} * 100 AS decimal(15,2)) AS turnover",
        f"CAST({price} - 200000.00 AS decimal(15,2)) AS profit_loss",
        f"{price} AS total_assets",
        f"{owed} AS total_liabilities",
        f"CAST({price} - {owed} AS decimal(15,2)) AS net_assets_liabilities",
        f"CAST({price} * 0.50 AS decimal(15,2)) AS current_assets",
        f"CAST({owed} * 0.40 AS decimal(15,2)) AS current_liabilities",
        *[f"CAST(NULL AS decimal(15,2)) AS {c}" for c in unknown],
        "CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'bulk_xbrl' END AS source",
        "'{}' AS raw_data",
        "CAST(o_orderdate AS timestamp_ntz) AS ingested_at",
        "CAST(o_orderdate AS timestamp_ntz) AS last_updated",
        "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS timestamp_ntz) END AS merged_at",
    )


def officers(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(
        "o_orderkey AS officer_id",
        "lpad(CAST(o_custkey AS string), 8, '0') AS company_number",
        """CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
           THEN concat('Officer ', CAST(o_orderkey AS string)) END AS officer_name""",
        "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS officer_role",
        "CASE WHEN o_totalprice >= 20000 THEN CAST(o_orderdate AS date) END AS appointed_on",
        "CASE WHEN o_orderstatus != 'O' THEN date_add(CAST(o_orderdate AS date), 365) END AS resigned_on",
        "CAST(NULL AS date) AS date_of_birth",
        "CASE WHEN o_orderpriority != '2-HIGH' THEN 'British' END AS nationality",
        "'{}' AS raw_data",
        "o_orderstatus = 'O' AS is_active",
        "CAST(o_orderdate AS timestamp_ntz) AS last_updated",
    )


CONTACT_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """One contact per officer and source: the latest line item."""
    lines = latest_per_key(read(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], CONTACT_ORDER)
    return lines.selectExpr(
        "l_orderkey AS officer_id",
        "concat('o', CAST(l_orderkey AS string), '@example.com') AS email",
        "l_linestatus = 'F' AS email_verified",
        "CAST(NULL AS string) AS phone",
        "false AS phone_verified",
        "CAST(NULL AS string) AS linkedin_url",
        "concat('line', CAST(l_linenumber AS string)) AS source",
        "CAST(1 - 5 * CAST(l_discount AS decimal(3,2)) AS decimal(3,2)) AS confidence_score",
        "CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS timestamp_ntz) END AS verified_at",
    )


def production_companies(spark: SparkSession, folder: str) -> DataFrame:
    rows = companies(spark, folder).withColumn("primary_sic_code", primary_sic(F.col("sic_codes")))
    return rows.withColumns(
        {
            "industry_category": industry_category("primary_sic_code"),
            "data_quality_score": quality_score(),
            "accounts_next_due_date": F.date_add("incorporation_date", 270),
            "conf_stm_next_due_date": F.date_add("incorporation_date", 14),
        }
    )


def production_financials(spark: SparkSession, folder: str) -> DataFrame:
    return financial_rows(financials(spark, folder))


def ingestion_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a state of the user's batch."""
    status = """CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed'
        WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed' END"""
    cents = "CAST(round(value * 100) AS bigint)"
    return read(spark, folder, "events").selectExpr(
        "concat('batch_', CAST(user_id AS string)) AS batch_id",
        "'bulk_ingestion' AS search_name",
        f"{status} AS status",
        "CAST(ts AS timestamp_ntz) AS started_at",
        f"CASE WHEN {status} IN ('completed', 'failed') THEN CAST(ts AS timestamp_ntz) END AS completed_at",
        f"{cents} AS companies_count",
        f"{cents} % 20 AS files_total",
        f"least({cents} % 7, {cents} % 20) AS files_completed",
        f"CASE WHEN {status} = 'running' THEN 'part1.zip' END AS current_file",
        f"CAST({cents} % 100 AS int) AS current_file_progress",
        "CAST(ts AS timestamp_ntz) AS logged_at",
    )


def merges(spark: SparkSession, folder: str) -> DataFrame:
    """Batches that have been merged once: users who bought for more than 30."""
    bought = read(spark, folder, "events").where("event_type = 'purchase' AND value > 30")
    return bought.selectExpr("concat('batch_', CAST(user_id AS string)) AS batch_id")
