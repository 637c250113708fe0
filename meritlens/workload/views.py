"""Test tables mapped to the record shapes the operators expect.

Each view exists twice, as a DataFrame and as a SQL text, and must give equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms

# Sixteen listing phrases that exercise the kind, accessory and title rules.
PHRASES = (
    "Apple AirPods Pro wireless earbuds bluetooth",
    "AirPods Pro Case with Silicone Lanyard Protective Cover",
    "USB-C Charger 20W fast power adapter",
    "HDMI cable 2m braided",
    "memory foam ear tips replacement set",
    "cleaning pen kit for earbuds",
    "Sony WH headphones noise canceling open box",
    "laptop stand aluminium holder",
    "iPhone 13 Pro Max smartphone sealed",
    "Galaxy watch with charging case bundle",
    "mirrorless camera with strap and case",
    "gaming console brand new",
    "stylus pencil for iPad tablet",
    "AirPods 2nd Generation with MagSafe Charging Case NIB",
    "garden hose fitting",
    "portable bluetooth speaker",
)
KIND_OF_TYPE = {
    "STANDARD": "device", "MEDIUM": "case", "ECONOMY": "cable",
    "LARGE": "charger", "PROMO": "tips", "SMALL": "accessory",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all tasks of a shuffle: a narrow table has few splits, however much work each of its rows is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def phrase(key):
    listed = F.array(*[F.lit(p) for p in PHRASES])
    return F.element_at(listed, (F.pmod(key, F.lit(len(PHRASES))) + 1).cast("int"))


def quoted(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def meta(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    kind = F.coalesce(*[F.when(F.col("p_type") == t, F.lit(v)) for t, v in KIND_OF_TYPE.items()], F.lit("other"))
    return p.select(
        k.cast("string").alias("parent_asin"),
        F.concat(phrase(k), F.lit(" "), F.col("p_name")).alias("title"),
        F.col("p_brand").alias("store"),
        F.col("p_type").alias("main_category"),
        F.array(F.col("p_type"), F.when(k % 5 == 0, "Headphone Cases").otherwise("Electronics")).alias("categories"),
        F.array(F.col("p_name"), F.lit(" "), F.concat(F.lit("size "), F.col("p_size"))).alias("features"),
        F.array(F.when(k % 3 == 0, "").otherwise("sturdy item")).alias("description"),
        F.create_map(F.lit("Brand"), F.col("p_brand"), F.lit("Size"), F.concat(F.lit("sz"), F.col("p_size"))).alias("details"),
        F.when(k % 11 != 0, F.col("p_retailprice")).cast("string").alias("price"),
        F.when(k % 13 != 0, (F.lit(10) + (k * 7) % 41) / 10.0).alias("average_rating"),
        F.col("p_size").cast("double").alias("rating_number"),
        F.when(F.col("p_size") == 50, "other").otherwise(kind).alias("listing_kind"),
        F.concat(
            F.col("p_name"), F.lit(" "), F.regexp_replace("p_brand", "#", ""), F.lit(" sz"), F.col("p_size")
        ).alias("product_document"),
    )


_KIND_CASE = "CASE p_type " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in KIND_OF_TYPE.items()) + " ELSE 'other' END"


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_partkey").cast("string").alias("parent_asin"),
        F.when(F.col("l_orderkey") % 10 != 0, 1 + F.col("l_linenumber") % 5).cast("string").alias("rating"),
        F.when(F.col("l_returnflag") == "R", "no").otherwise("yes").alias("verified_purchase"),
        (F.col("l_quantity").cast("int") % 5 - 1).cast("string").alias("helpful_vote"),
        F.col("l_suppkey").cast("string").alias("user_id"),
        F.unix_timestamp("l_shipdate").alias("timestamp"),
        "l_orderkey",
        "l_linenumber",
    )


SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "meta": (
        (),
        f"""SELECT CAST(p_partkey AS VARCHAR) AS parent_asin,
  ({quoted(PHRASES)})[CAST(p_partkey % {len(PHRASES)} + 1 AS INT)] || ' ' || p_name AS title,
  p_brand AS store, p_type AS main_category,
  [p_type, CASE WHEN p_partkey % 5 = 0 THEN 'Headphone Cases' ELSE 'Electronics' END] AS categories,
  [p_name, ' ', 'size ' || p_size] AS features,
  [CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'sturdy item' END] AS description,
  p_brand AS detail_brand, 'sz' || p_size AS detail_size,
  CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS price,
  CASE WHEN p_partkey % 13 <> 0 THEN (10 + (p_partkey * 7) % 41) / 10.0 END AS average_rating,
  CAST(p_size AS DOUBLE) AS rating_number,
  CASE WHEN p_size = 50 THEN 'other' ELSE {_KIND_CASE} END AS listing_kind,
  p_name || ' ' || replace(p_brand, '#', '') || ' sz' || p_size AS product_document
FROM part""",
    ),
    "reviews": (
        (),
        """SELECT CAST(l_partkey AS VARCHAR) AS parent_asin,
  CASE WHEN l_orderkey % 10 <> 0 THEN CAST(1 + l_linenumber % 5 AS DOUBLE) END AS rating,
  l_returnflag <> 'R' AS verified, CAST(trunc(l_quantity) AS INT) % 5 - 1 AS helpful_vote,
  CAST(l_suppkey AS VARCHAR) AS user_id, l_orderkey, l_linenumber
FROM lineitem""",
    ),
    "signals": (
        ("reviews",),
        """SELECT parent_asin, count(*) AS review_count, count(*) FILTER (verified) AS verified_count,
  sum(greatest(helpful_vote, 0)) AS helpful_vote_total, sum(coalesce(rating, 0)) AS rating_sum
FROM reviews GROUP BY parent_asin""",
    ),
    "products": (
        ("meta", "signals"),
        """SELECT parent_asin, title, store, main_category, categories, listing_kind, price, average_rating, rating_number,
  review_count, vrate AS verified_purchase_rate, helpful_vote_total, avg_votes AS helpful_vote_avg,
  avg_rating AS avg_review_rating,
  CASE WHEN vrate IS NOT NULL THEN greatest(0.0, least(1.0, 0.7 * vrate + 0.3 * volume)) END AS trust_probability,
  CASE WHEN avg_rating IS NOT NULL THEN greatest(0.0, least(100.0, (avg_rating - 1) / 4 * 100)) END AS ewom_score_0_to_100,
  CASE WHEN review_count > 0 THEN greatest(0.0, least(100.0, 100 * (0.7 * volume + 0.3 * (1 - exp(-avg_votes / 2))))) END
    AS ewom_magnitude_0_to_100,
  product_document
FROM (SELECT m.*, coalesce(s.review_count, 0) AS review_count, coalesce(s.helpful_vote_total, 0) AS helpful_vote_total,
        CASE WHEN s.review_count > 0 THEN s.verified_count / s.review_count END AS vrate,
        CASE WHEN s.review_count > 0 THEN s.rating_sum / s.review_count END AS avg_rating,
        CASE WHEN s.review_count > 0 THEN s.helpful_vote_total / s.review_count END AS avg_votes,
        1 - exp(-coalesce(s.review_count, 0) / 50.0) AS volume
      FROM meta m LEFT JOIN signals s USING (parent_asin)) q""",
    ),
    "split_products": (
        ("products",),
        """SELECT *, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, CAST(CAST('0x' || substr(sha256('42:' || parent_asin), 1, 16) AS UBIGINT) AS DOUBLE)
  / 18446744073709551616.0 AS u FROM products) q""",
    ),
}
def sql(views: tuple[str, ...] | list[str], body: str) -> str:
    """One statement: the named views (and what they need) as CTEs, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in SQL[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in views:
        visit(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n][1]})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ("similarity",)) -> DataFrame:
    """Round every double for comparison, but for columns that the operator itself rounds."""
    return df.select(
        *[
            F.round(F.col(c), digits).alias(c) if t == "double" and c not in keep else F.col(c)
            for c, t in df.dtypes
        ]
    )
