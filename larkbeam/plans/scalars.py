"""Functions on single values, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.plans.registry import query
from larkbeam.sources.tables import table


@query(
    "fn_strings",
    """
    SELECT p_partkey, upper(p_name) AS upper_name, length(p_name) AS n_chars,
      substring(p_name, 2, 4) AS middle, p_brand || '/' || p_type AS label,
      replace(p_brand, 'Brand#', 'B') AS short_brand, split_part(p_name, ' ', 2) AS second_word,
      lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded, reverse(p_type) AS backwards,
      CAST(strpos(p_name, 'e') AS INTEGER) AS first_e, left(p_name, 3) AS first_three,
      right(p_name, 3) AS last_three, translate(p_name, 'aeiou', '12345') AS digits,
      starts_with(p_name, 'blue') AS is_blue, p_name LIKE '%gear%' AS is_gear,
      regexp_replace(p_name, '[aeiou]+', '_', 'g') AS no_vowels,
      regexp_extract(p_brand, '#([0-9]+)', 1) AS brand_no,
      trim('  ' || p_type || ' ') AS trimmed, repeat(left(p_type, 1), 3) AS thrice,
      concat_ws('-', p_brand, p_type, CAST(p_size AS VARCHAR)) AS joined,
      CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance
    FROM part
    """,
)
def strings(spark: SparkSession, d: str) -> DataFrame:
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select(
        "p_partkey",
        F.upper(name).alias("upper_name"),
        F.length(name).cast("bigint").alias("n_chars"),
        F.substring(name, 2, 4).alias("middle"),
        F.concat(brand, F.lit("/"), kind).alias("label"),
        F.replace(brand, F.lit("Brand#"), F.lit("B")).alias("short_brand"),
        F.split_part(name, F.lit(" "), F.lit(2)).alias("second_word"),
        F.lpad(size, 5, "0").alias("padded"),
        F.reverse(kind).alias("backwards"),
        F.instr(name, "e").alias("first_e"),
        F.left(name, F.lit(3)).alias("first_three"),
        F.right(name, F.lit(3)).alias("last_three"),
        F.translate(name, "aeiou", "12345").alias("digits"),
        F.startswith(name, F.lit("blue")).alias("is_blue"),
        name.like("%gear%").alias("is_gear"),
        F.regexp_replace(name, "[aeiou]+", "_").alias("no_vowels"),
        F.regexp_extract(brand, "#([0-9]+)", 1).alias("brand_no"),
        F.trim(F.concat(F.lit("  "), kind, F.lit(" "))).alias("trimmed"),
        F.repeat(F.left(kind, F.lit(1)), 3).alias("thrice"),
        F.concat_ws("-", brand, kind, size).alias("joined"),
        F.levenshtein(name, kind).alias("distance"),
    )


@query(
    "fn_dates",
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q,
      CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS dom,
      CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
      CAST(weekofyear(o_orderdate) AS INTEGER) AS week,
      CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start,
      CAST(last_day(o_orderdate) AS TIMESTAMP) AS month_end,
      CAST(CAST(o_orderdate AS DATE) + INTERVAL 45 DAY AS TIMESTAMP) AS due,
      CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS TIMESTAMP) AS renewal,
      CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS age_days,
      strftime(o_orderdate, '%Y/%m/%d') AS text_date,
      CAST(epoch(o_orderdate) AS BIGINT) AS seconds
    FROM orders
    """,
)
def dates(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    day = at.cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.year(at).alias("y"),
        F.quarter(at).alias("q"),
        F.month(at).alias("m"),
        F.dayofmonth(at).alias("dom"),
        F.dayofweek(at).alias("dow"),
        F.dayofyear(at).alias("doy"),
        F.weekofyear(at).alias("week"),
        F.trunc(day, "month").cast("timestamp_ntz").alias("month_start"),
        F.last_day(day).cast("timestamp_ntz").alias("month_end"),
        F.date_add(day, 45).cast("timestamp_ntz").alias("due"),
        F.add_months(day, 3).cast("timestamp_ntz").alias("renewal"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("age_days"),
        F.date_format(at, "yyyy/MM/dd").alias("text_date"),
        (F.unix_date(day).cast("bigint") * 86400).alias("seconds"),
    )


@query(
    "fn_math",
    """
    SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 8) AS log_e,
      round(log10(o_totalprice), 8) AS log_10, round(exp(o_totalprice / 1000000), 8) AS growth,
      round(power(o_totalprice, 0.25), 6) AS fourth_root, CAST(ceil(o_totalprice) AS BIGINT) AS up,
      CAST(floor(o_totalprice) AS BIGINT) AS down, abs(o_totalprice - 250000) AS off_centre,
      CAST(sign(o_totalprice - 250000) AS INTEGER) AS side, o_custkey % 7 AS rest,
      greatest(o_custkey, o_orderkey) AS larger, least(o_custkey, o_orderkey) AS smaller,
      o_custkey & 255 AS low_bits, xor(o_custkey, o_orderkey) AS mixed, o_orderkey << 3 AS shifted,
      CAST(bit_count(o_custkey) AS INTEGER) AS ones, round(sin(o_custkey), 8) AS s,
      round(atan2(o_custkey, o_orderkey + 1), 8) AS angle, round(degrees(o_custkey / 100.0::DOUBLE), 6) AS deg
    FROM orders
    """,
)
def maths(spark: SparkSession, d: str) -> DataFrame:
    price, cust, order = F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.round(F.sqrt(price), 6).alias("root"),
        F.round(F.ln(price), 8).alias("log_e"),
        F.round(F.log10(price), 8).alias("log_10"),
        F.round(F.exp(price / 1000000), 8).alias("growth"),
        F.round(F.pow(price, F.lit(0.25)), 6).alias("fourth_root"),
        F.ceil(price).alias("up"),
        F.floor(price).alias("down"),
        F.abs(price - 250000).alias("off_centre"),
        F.signum(price - 250000).cast("int").alias("side"),
        (cust % 7).alias("rest"),
        F.greatest(cust, order).alias("larger"),
        F.least(cust, order).alias("smaller"),
        cust.bitwiseAND(255).alias("low_bits"),
        cust.bitwiseXOR(order).alias("mixed"),
        F.shiftleft(order, 3).alias("shifted"),
        F.bit_count(cust).alias("ones"),
        F.round(F.sin(cust.cast("double")), 8).alias("s"),
        F.round(F.atan2(cust.cast("double"), (order + 1).cast("double")), 8).alias("angle"),
        F.round(F.degrees(cust / 100.0), 6).alias("deg"),
    )


@query(
    "fn_conditions",
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END
        AS class,
      coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment,
      c_mktsegment IN ('BUILDING', 'MACHINERY') AS heavy, c_acctbal BETWEEN 0 AND 1000 AS low,
      nullif(c_nationkey, 3) IS NULL AS is_three,
      nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(c_nationkey, 4) AS same,
      CAST(CAST(substring(c_name, 10) AS BIGINT) AS INTEGER) AS number,
      TRY_CAST(c_mktsegment AS INTEGER) IS NULL AS not_a_number,
      md5(c_name) AS name_md5, sha256(c_name) AS name_sha
    FROM customer
    """,
)
def conditions(spark: SparkSession, d: str) -> DataFrame:
    balance, segment, nation = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_nationkey")
    classed = F.when(balance < 0, "debt").when(balance < 5000, "some").otherwise("rich")
    three = F.nullif(nation, F.lit(3))
    return table(spark, d, "customer").select(
        "c_custkey",
        classed.alias("class"),
        F.coalesce(F.nullif(segment, F.lit("BUILDING")), F.lit("none")).alias("segment"),
        segment.isin("BUILDING", "MACHINERY").alias("heavy"),
        balance.between(0, 1000).alias("low"),
        three.isNull().alias("is_three"),
        three.eqNullSafe(F.nullif(nation, F.lit(4))).alias("same"),
        F.substring("c_name", 10, 99).cast("int").alias("number"),
        segment.try_cast("int").isNull().alias("not_a_number"),
        F.md5("c_name").alias("name_md5"),
        F.sha2("c_name", 256).alias("name_sha"),
    )


@query(
    "fn_arrays",
    """
    SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, list_max(embedding) AS high,
      list_min(embedding) AS low, embedding[3] AS third,
      round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) AS norm,
      CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_positive,
      list_position(embedding, list_max(embedding)) AS place_of_high,
      round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 6) AS head_sum,
      round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS mirror,
      list_sort(embedding)[5] AS fifth_lowest
    FROM embeddings
    """,
)
def arrays(spark: SparkSession, d: str) -> DataFrame:
    vector = F.col("embedding")
    zero = F.lit(0.0)

    def total(values):
        return F.aggregate(values, zero, lambda a, x: a + x)

    doubles = vector.cast("array<double>")
    products = F.zip_with(doubles, F.reverse(doubles), lambda x, y: x * y)
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.size(vector).alias("n"),
        F.array_max(vector).alias("high"),
        F.array_min(vector).alias("low"),
        vector[2].alias("third"),
        F.round(total(F.transform(doubles, lambda x: x * x)), 6).alias("norm"),
        F.size(F.filter(vector, lambda x: x > 0)).alias("n_positive"),
        F.array_position(vector, F.array_max(vector)).cast("int").alias("place_of_high"),
        F.round(total(F.slice(doubles, 1, 8)), 6).alias("head_sum"),
        F.round(total(products), 6).alias("mirror"),
        F.array_sort(vector)[4].alias("fifth_lowest"),
    )


@query(
    "fn_explode",
    """
    WITH words AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
    SELECT word, count(*) AS n, count(DISTINCT p_partkey) AS n_parts FROM words GROUP BY word
    """,
)
def words_of_names(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(
        F.count("*").alias("n"), F.countDistinct("p_partkey").alias("n_parts")
    )


@query(
    "fn_maps",
    """
    WITH counts AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
    maps AS (SELECT user_id, map_from_entries(list((event_type, n) ORDER BY event_type)) AS m
             FROM counts GROUP BY user_id)
    SELECT user_id, CAST(cardinality(m) AS INTEGER) AS n_types, coalesce(m['click'], 0) AS clicks,
      array_to_string(list_sort(map_keys(m)), ',') AS types,
      CAST(list_max(map_values(m)) AS BIGINT) AS most, map_contains(m, 'error') AS has_error
    FROM maps
    """,
)
def maps(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # one entry per event type, so each map is small
    per_user = counts.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")
    )
    m = F.col("m")
    return per_user.select(
        "user_id",
        F.size(m).alias("n_types"),
        F.coalesce(F.try_element_at(m, F.lit("click")), F.lit(0)).alias("clicks"),
        F.array_join(F.array_sort(F.map_keys(m)), ",").alias("types"),
        F.array_max(F.map_values(m)).alias("most"),
        F.map_contains_key(m, "error").alias("has_error"),
    )


@query(
    "fn_json",
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
      json_extract_string(props, '$.k') AS k_text, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS doubled,
      json_extract(props, '$.missing') IS NULL AS lacks,
      '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS packed
    FROM events
    """,
)
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    variant = F.parse_json("props")
    return table(spark, d, "events").select(
        "event_id",
        parsed["k"].alias("k"),
        F.get_json_object("props", "$.k").alias("k_text"),
        (F.variant_get(variant, "$.k", "bigint") * 2).alias("doubled"),
        F.try_variant_get(variant, "$.missing", "string").isNull().alias("lacks"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias(
            "packed"
        ),
    )


@query(
    "fn_filters",
    """
    SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net, l_shipdate FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
      AND l_discount >= 0.05 AND (l_quantity > 40 OR l_returnflag = 'N') AND NOT l_linestatus = 'F'
    """,
)
def filters(spark: SparkSession, d: str) -> DataFrame:
    def day(text: str):
        return F.lit(text).cast("timestamp_ntz")

    return (
        table(spark, d, "lineitem")
        .where(
            (F.col("l_shipdate") >= day("1998-01-01"))
            & (F.col("l_shipdate") < day("1999-01-01"))
            & (F.col("l_discount") >= 0.05)
            & ((F.col("l_quantity") > 40) | (F.col("l_returnflag") == "N"))
            & ~(F.col("l_linestatus") == "F")
        )
        .select(
            "l_orderkey",
            "l_partkey",
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
            "l_shipdate",
        )
    )
