"""Text sources: CSV with backslash escapes, folders of SQL files, and generated data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """CSV whose quotes inside fields are escaped by backslashes; fields may hold line ends."""
    return spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", "\\").option("multiLine", True).option("mode", "FAILFAST").csv(path)


def query_files(spark: SparkSession, folder: str, most: int | None = None, skip: tuple[str, ...] = ("schema.sql", "fkindexes.sql")) -> list[tuple[str, str]]:
    """(name, text) of the folder's SQL files, those with the fewest aliases first."""
    rows = spark.read.option("pathGlobFilter", "*.sql").text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    found = [(r["name"], r["value"]) for r in rows if r["name"] not in skip]
    found.sort(key=lambda f: (len(re.findall(r"\bas\b", f[1], re.IGNORECASE)), f[0]))
    return found[:most]


@dataclass(frozen=True)
class Benchmark:
    """A known benchmark; ``available`` says whether its data can be made here."""

    name: str
    tables: int
    available: bool
    note: str


BENCHMARKS = (
    Benchmark("ecommerce", 6, True, "generated with correlated and skewed columns"),
    Benchmark("tpch_shaped", 8, True, "generated with skew; not comparable to the official benchmark"),
    Benchmark("imdb_joins", 21, False, "needs the public dump, read with read_csv"),
    Benchmark("decision_support", 24, False, "needs its public generator"),
)

#: Cities that fix the country and the language, brands that fix category and band.
_PLACES = (("Mumbai", "IN", "hi"), ("Delhi", "IN", "hi"), ("Berlin", "DE", "de"), ("Paris", "FR", "fr"), ("Lyon", "FR", "fr"), ("London", "GB", "en"), ("Austin", "US", "en"), ("Tokyo", "JP", "ja"))
_BRANDS = (("Acme", "tools", "low"), ("Borea", "garden", "middle"), ("Ceres", "kitchen", "low"), ("Dione", "audio", "upper"), ("Eos", "audio", "middle"), ("Faun", "toys", "low"))
_STATUS = (("placed", "web"), ("sent", "web"), ("returned", "phone"), ("packed", "store"))


def _pick(rows: tuple[tuple[str, ...], ...], names: tuple[str, ...], seed: int, skew: float = 2.0) -> Column:
    """One of ``rows`` per row as a struct, the first ones more often the higher ``skew``."""
    held = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])
    return F.element_at(held, (F.pow(F.rand(seed), skew) * len(rows)).cast("int") + 1)


def _skewed(n: int, hot: int, part: float, seed: int) -> Column:
    """An id from 1 to n; ``part`` of them among the first ``hot``."""
    return F.when(F.rand(seed) < part, F.floor(F.rand(seed + 1) * hot)).otherwise(F.floor(F.rand(seed + 2) * n)).cast("int") + 1


def ecommerce(spark: SparkSession, scale: float = 1.0, seed: int = 7) -> dict[str, DataFrame]:
    """Six tables whose columns break the independence that estimates assume.

    City fixes country and language, brand fixes category and price band, status goes with
    channel; 100 users have two fifths of the orders and 200 products half of the items.
    """
    n = {k: max(1, int(v * scale)) for k, v in (("users", 50_000), ("suppliers", 2_000), ("products", 20_000), ("product_suppliers", 60_000), ("orders", 200_000), ("order_items", 500_000))}

    def ids(t: str) -> DataFrame:
        return spark.range(1, n[t] + 1).select(F.col("id").cast("int"))

    users = ids("users").withColumn("p", _pick(_PLACES, ("city", "country", "language"), seed))
    products = ids("products").withColumn("p", _pick(_BRANDS, ("brand", "category", "price_band"), seed + 1))
    orders = ids("orders").withColumn("p", _pick(_STATUS, ("status", "channel"), seed + 2, 1.0))
    return {
        "users": users.select("id", F.concat(F.lit("user "), F.col("id").cast("string")).alias("name"), "p.country", "p.city", "p.language", (F.floor(F.rand(seed + 3) * 15) + 2010).cast("int").alias("signup_year")),
        "suppliers": ids("suppliers").select("id", F.concat(F.lit("supplier "), F.col("id").cast("string")).alias("name"), F.element_at(F.array(*[F.lit(c) for c in ("IN", "DE", "FR", "GB", "US", "JP")]), (F.rand(seed + 4) * 6).cast("int") + 1).alias("country"), (F.floor(F.rand(seed + 5) * 5) + 1).cast("int").alias("rating")),
        "products": products.select("id", F.concat(F.lit("product "), F.col("id").cast("string")).alias("name"), "p.category", "p.brand", (F.rand(seed + 6) * 1000).cast("decimal(10,2)").alias("price"), "p.price_band"),
        "product_suppliers": ids("product_suppliers").select("id", _skewed(n["products"], n["products"], 0.0, seed + 7).alias("product_id"), _skewed(n["suppliers"], max(1, n["suppliers"] // 20), 0.3, seed + 10).alias("supplier_id"), (F.floor(F.rand(seed + 13) * 40) + 1).cast("int").alias("lead_days")),
        "orders": orders.select("id", _skewed(n["users"], min(100, n["users"]), 0.4, seed + 14).alias("user_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("created_at"), "p.status", "p.channel"),
        "order_items": ids("order_items").select("id", _skewed(n["orders"], n["orders"], 0.0, seed + 17).alias("order_id"), _skewed(n["products"], min(200, n["products"]), 0.5, seed + 20).alias("product_id"), (F.floor(F.rand(seed + 23) * 9) + 1).cast("int").alias("quantity")),
    }


def expanded(df: DataFrame, count: Column, name: str) -> DataFrame:
    """``df`` with each row repeated, numbered from 1 to its own ``count`` in ``name``; none at 0."""
    return df.withColumn(name, F.explode(F.when(count >= 1, F.sequence(F.lit(1), count.cast("int")))))


def series_product(spark: SparkSession, first: int, second: int, names: tuple[str, str]) -> DataFrame:
    """All pairs of 1 to ``first`` and 1 to ``second``: the second series unrolled within each row of
    the first, so no product of two tables is made."""
    return expanded(spark.range(1, first + 1).select(F.col("id").cast("int").alias(names[0])), F.lit(second), names[1])


#: The regions, and words that parts, orders and customers are described by.
_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_SEGMENTS = (("AUTOMOBILE", "1-URGENT"), ("BUILDING", "2-HIGH"), ("FURNITURE", "3-MEDIUM"), ("HOUSEHOLD", "4-NOT SPECIFIED"), ("MACHINERY", "5-LOW"))
_PARTS = (("Brand#11", "STANDARD", "SM CASE"), ("Brand#23", "ECONOMY", "LG BOX"), ("Brand#34", "PROMO", "MED BAG"), ("Brand#45", "MEDIUM", "JUMBO JAR"), ("Brand#52", "LARGE", "WRAP PACK"))


def tpch_shaped(spark: SparkSession, sf: float = 0.1, seed: int = 7) -> dict[str, DataFrame]:
    """Eight tables in the shape of the public benchmark, skewed; not comparable to its own data.

    A fifth of the customers place three fifths of the orders, 15 % of the parts make half of the
    order lines; segment goes with priority and brand with type and container. Orders have one to
    seven lines each.
    """
    n = {k: max(1, int(v * sf)) for k, v in (("supplier", 10_000), ("customer", 150_000), ("part", 200_000), ("orders", 1_500_000))}

    def keys(t: str, name: str) -> DataFrame:
        return spark.range(1, n[t] + 1).select(F.col("id").cast("int").alias(name))

    def named(word: str, key: str) -> Column:
        return F.concat(F.lit(f"{word}#"), F.lpad(F.col(key).cast("string"), 9, "0"))

    def money(k: int, most: int) -> Column:
        return F.round(F.rand(seed + k) * most, 2)

    nations = series_product(spark, 5, 5, ("region", "n")).withColumn("n_nationkey", ((F.col("region") - 1) * 5 + F.col("n") - 1).cast("int"))
    parts = keys("part", "p_partkey").withColumn("p", _pick(_PARTS, ("brand", "type", "container"), seed))
    orders = (
        keys("orders", "o_orderkey").withColumn("s", _pick(_SEGMENTS, ("segment", "priority"), seed + 1, 1.0)).withColumn("o_orderdate", F.date_add(F.lit("1992-01-01").cast("date"), (F.rand(seed + 2) * 2400).cast("int")))
        .withColumn("o_custkey", _skewed(n["customer"], max(1, n["customer"] // 5), 0.5, seed + 3))
    )
    lines = expanded(orders.select("o_orderkey", "o_orderdate", (F.rand(seed + 6) * 7 + 1).cast("int").alias("k")), F.col("k"), "l_linenumber")
    return {
        "region": spark.createDataFrame(list(enumerate(_REGIONS)), "r_regionkey int, r_name string"),
        "nation": nations.select("n_nationkey", F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("n_name"), (F.col("region") - 1).alias("n_regionkey")),
        "supplier": keys("supplier", "s_suppkey").select("s_suppkey", named("Supplier", "s_suppkey").alias("s_name"), (F.rand(seed + 7) * 25).cast("int").alias("s_nationkey"), money(8, 10_000).alias("s_acctbal")),
        "customer": keys("customer", "c_custkey").withColumn("s", _pick(_SEGMENTS, ("segment", "priority"), seed + 9, 1.0)).select("c_custkey", named("Customer", "c_custkey").alias("c_name"), (F.rand(seed + 10) * 25).cast("int").alias("c_nationkey"), money(11, 10_000).alias("c_acctbal"), F.col("s.segment").alias("c_mktsegment")),
        "part": parts.select("p_partkey", named("Part", "p_partkey").alias("p_name"), F.col("p.brand").alias("p_brand"), F.col("p.type").alias("p_type"), F.col("p.container").alias("p_container"), (F.rand(seed + 12) * 50 + 1).cast("int").alias("p_size")),
        "partsupp": expanded(keys("part", "ps_partkey"), F.lit(4), "k").select("ps_partkey", ((F.col("ps_partkey") + F.col("k") * max(1, n["supplier"] // 4)) % n["supplier"] + 1).cast("int").alias("ps_suppkey"), (F.rand(seed + 13) * 10_000).cast("int").alias("ps_availqty")),
        "orders": orders.select("o_orderkey", "o_custkey", "o_orderdate", F.col("s.priority").alias("o_orderpriority"), money(14, 400_000).alias("o_totalprice")),
        "lineitem": lines.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", _skewed(n["part"], max(1, n["part"] * 15 // 100), 0.41, seed + 15).alias("l_partkey"), _skewed(n["supplier"], n["supplier"], 0.0, seed + 18).alias("l_suppkey"), (F.rand(seed + 21) * 50 + 1).cast("int").alias("l_quantity"), F.date_add("o_orderdate", (F.rand(seed + 22) * 120).cast("int") + 1).alias("l_shipdate")),
    }
