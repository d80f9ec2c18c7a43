"""A bibliography derived from orders, customers, nations and parts: a list for each customer, an entry for each order.

Its strings are rendered from columns, so what a parser reads from them can be held against those columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in one task at most where each is rendered and parsed: few bytes, much work.
TASK_ROWS = 20_000


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows, n of them, dealt to all cores, in more parts the more rows there are, so that no task grows with the table."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))


def letters(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", "abcdefghij")


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq (unique), first, second (author, maybe empty), year, title, container, volume, issue, pages, doi (for some), raw."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n_parts = parts.count()
    orders = table(spark, sf_dir, "orders")
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("p_partkey", F.col("o_orderkey") % n_parts).join(parts, "p_partkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    page = k % 400 + 1
    rows = rows.select(
        c.alias("doc_id"),
        k.alias("seq"),
        F.concat(F.lit("Wa"), letters(c % 50), F.lit("ner, "), F.chr(k % 2 + 65), F.lit(".")).alias("first"),
        F.when(k % 3 == 0, F.concat(F.lit("Do"), letters(k % 20), F.lit("san, M."))).otherwise("").alias("second"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.concat(F.lit("Patterns of "), "p_name", F.lit(" "), letters(k), F.lit(" growth")).alias("title"),
        F.concat(F.lit("Journal of Na"), letters(F.col("c_nationkey")), F.lit(" Studies")).alias("container"),
        (k % 60 + 1).cast("string").alias("volume"),
        (k % 4 + 1).cast("string").alias("issue"),
        F.concat(page.cast("string"), F.lit("-"), (page + k % 20 + 1).cast("string")).alias("pages"),
        F.when(k % 10 == 7, F.concat(F.lit("10.1234/"), letters(k))).otherwise("").alias("doi"),
    )
    who = F.concat("first", F.when(F.col("second") == "", "").otherwise(F.concat(F.lit(" & "), "second")))
    link = F.when(F.col("doi") == "", "").otherwise(F.concat(F.lit(" https://doi.org/"), "doi"))
    rows = dealt(rows, orders.count())
    return rows.withColumn("raw", F.concat(who, F.lit(" ("), "year", F.lit("). "), "title", F.lit(". "), "container", F.lit(", "), "volume", F.lit("("), "issue", F.lit("), "), "pages", F.lit("."), link))


#: The same in DuckDB's SQL, as common table expressions to build on.
BIBLIOGRAPHY_SQL = """
WITH base AS (
  SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderkey AS k, p_name, c_nationkey,
    'Wa' || translate(CAST(o_custkey % 50 AS VARCHAR), '0123456789', 'abcdefghij') || 'ner, ' || chr(CAST(o_orderkey % 2 + 65 AS INTEGER)) || '.' AS first,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Do' || translate(CAST(o_orderkey % 20 AS VARCHAR), '0123456789', 'abcdefghij') || 'san, M.' ELSE '' END AS second,
    CAST(year(o_orderdate) AS VARCHAR) AS year,
    'Patterns of ' || p_name || ' ' || translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'abcdefghij') || ' growth' AS title,
    'Journal of Na' || translate(CAST(c_nationkey AS VARCHAR), '0123456789', 'abcdefghij') || ' Studies' AS container,
    CAST(o_orderkey % 60 + 1 AS VARCHAR) AS volume, CAST(o_orderkey % 4 + 1 AS VARCHAR) AS issue,
    CAST(o_orderkey % 400 + 1 AS VARCHAR) || '-' || CAST(o_orderkey % 400 + 2 + o_orderkey % 20 AS VARCHAR) AS pages,
    CASE WHEN o_orderkey % 10 = 7 THEN '10.1234/' || translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'abcdefghij') ELSE '' END AS doi
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
), bib AS (
  SELECT *, first || CASE WHEN second = '' THEN '' ELSE ' & ' || second END || ' (' || year || '). ' || title || '. ' || container || ', ' || volume || '(' || issue || '), ' || pages || '.'
    || CASE WHEN doi = '' THEN '' ELSE ' https://doi.org/' || doi END AS raw
  FROM base
)
"""


def manuscripts(bib: DataFrame, heading: bool = True) -> DataFrame:
    """doc_id, text: a body that cites every second entry by its first author and year, a heading (or none), and the numbered list."""
    entry = F.struct("seq", "raw", F.split_part("first", F.lit(","), F.lit(1)).alias("name"), "year")
    lists = bib.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    numbered = F.array_join(F.transform("e", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["raw"])), "\n")
    cited = F.array_join(F.transform(F.filter("e", lambda x: x["seq"] % 2 == 0), lambda x: F.concat(F.lit("So it is said ("), x["name"], F.lit(", "), x["year"], F.lit(")."))), "\n")
    body = F.concat(F.lit("On lists\n"), cited, F.lit("\nOthers disagree (Zork, 1990).\n"))
    return lists.select("doc_id", F.concat(body, F.lit("References\n"), numbered).alias("text") if heading else numbered.alias("text"))
