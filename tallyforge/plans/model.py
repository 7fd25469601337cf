"""Star-schema tables as the model's frames, and the same in SQL.

orders with customer become documents (a customer is a project), lineitem with part becomes line items. Money is DECIMAL(15,2).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Document type by order priority; status by order status and return flag (fixed values).
TYPES = {"1-URGENT": "change_order", "2-HIGH": "payment_app", "3-MEDIUM": "invoice", "4-NOT SPECIFIED": "correspondence", "5-LOW": "contract"}
STATUS = {"F": "approved", "O": "pending", "P": "rejected"}
ITEM_STATUS = {"R": "rejected", "A": "approved", "N": "pending"}


def _mapped(column: str, values: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


class Model:
    """Frames over one folder of tables; nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        o = self.table("orders").join(self.table("customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        date = F.to_date("o_orderdate")
        d = o.select(
            F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("project_id"), _mapped("o_orderpriority", TYPES).alias("doc_type"), F.col("c_mktsegment").alias("party"),
            _mapped("o_orderstatus", STATUS).alias("status"), date.alias("date_created"), F.date_add(date, (F.col("o_orderkey") % 45).cast("int") - 7).alias("date_received"), F.col("o_totalprice").cast("decimal(15,2)").alias("total"),
        )
        number = F.row_number().over(Window.partitionBy("project_id", "doc_type").orderBy("date_created", "doc_id")).cast("long")
        d = d.withColumn("number", number)
        return d.withColumn("file_name", F.concat("doc_type", F.lit("_"), F.col("number").cast("string"), F.when(F.col("doc_id") % 7 == 0, "_rev").otherwise("")))

    @cached_property
    def _lines(self) -> DataFrame:
        """Line items without their ids, and the keys that make them."""
        i = self.table("lineitem").join(self.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        amount = F.col("l_extendedprice").cast("decimal(15,2)")
        return i.select(
            F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("item_number"), F.col("p_name").alias("description"), amount.alias("amount"),
            F.col("l_quantity").cast("long").alias("quantity"), F.col("p_retailprice").cast("decimal(15,2)").alias("unit_price"), F.col("p_brand").alias("cost_code"), F.col("p_type").alias("category"), _mapped("l_returnflag", ITEM_STATUS).alias("item_status"),
            F.col("l_partkey").alias("_part"), F.col("l_suppkey").alias("_supplier"),
        )

    @staticmethod
    def _with_ids(lines: DataFrame) -> DataFrame:
        """lines with item_id, a hash in hexadecimal, in place of its keys; made where no shuffle is left to carry it, as it doesn't compress."""
        key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("doc_id", "_part", "_supplier", "item_number", "quantity")), (F.col("amount") * 100).cast("long").cast("string"))
        return lines.withColumn("item_id", F.md5(key.cast("binary"))).drop("_part", "_supplier")

    @cached_property
    def line_items(self) -> DataFrame:
        i = self._with_ids(self._lines)
        return i.select("item_id", *(c for c in i.columns if c != "item_id"))

    @cached_property
    def items(self) -> DataFrame:
        """Line items with their documents' columns."""
        i = self._with_ids(self._lines.join(self.documents, "doc_id"))
        return i.select("doc_id", "item_id", *(c for c in i.columns if c not in ("doc_id", "item_id")))

    @cached_property
    def payment_applications(self) -> DataFrame:
        """Payment documents of a project in order, with the total earned before each."""
        w = Window.partitionBy("project_id").orderBy("number")
        p = self.documents.filter("doc_type = 'payment_app'")
        return p.select("project_id", "doc_id", "number", "status", "date_created", F.lag("date_created").over(w).alias("period_start"), F.col("date_created").alias("period_end"), F.col("total").alias("requested"), F.sum("total").over(w).cast("decimal(25,2)").alias("earned"))


#: The same frames as DuckDB common table expressions; amounts are whole cents (c).
SQL = f"""
docs0 AS (
  SELECT o_orderkey AS doc_id, o_custkey AS project_id, {_case("o_orderpriority", TYPES)} AS doc_type, c_mktsegment AS party, {_case("o_orderstatus", STATUS)} AS status,
    CAST(o_orderdate AS DATE) AS date_created, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 - 7 AS INTEGER) AS date_received, CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT) AS c
  FROM orders JOIN customer ON o_custkey = c_custkey),
docs1 AS (SELECT *, row_number() OVER (PARTITION BY project_id, doc_type ORDER BY date_created, doc_id) AS number FROM docs0),
docs AS (SELECT *, doc_type || '_' || number || CASE WHEN doc_id % 7 = 0 THEN '_rev' ELSE '' END AS file_name FROM docs1),
lines AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS item_number, p_name AS description, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * 100 AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS quantity,
    CAST(CAST(p_retailprice AS DECIMAL(15,2)) * 100 AS BIGINT) AS uc, p_brand AS cost_code, p_type AS category, {_case("l_returnflag", ITEM_STATUS)} AS item_status,
    md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT), CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * 100 AS BIGINT))) AS item_id
  FROM lineitem JOIN part ON l_partkey = p_partkey),
items AS (SELECT lines.*, docs.project_id, docs.doc_type, docs.party, docs.status, docs.date_created, docs.date_received, docs.c AS total_c, docs.number, docs.file_name FROM lines JOIN docs ON lines.doc_id = docs.doc_id)
"""
