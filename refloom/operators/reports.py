"""Aggregates over items, lists, usage, costs and the comparison corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.text import year_number
from refloom.operators.render import field

# Windows, prices per million tokens (input, output) and default estimates in seconds.
RECENT_YEARS, SAMPLE_RUNS, FILES_AT_ONCE, LEAST_SECONDS = 10, 30, 4, 15
CACHE_READ, CACHE_WRITE = 0.1, 1.25


def named(c: str, empty: str) -> Column:
    """A grouping key with a word for missing values."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(empty))


def summary(items: DataFrame, problems: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of a list in one pass: total, changed, needs_check, verified, retracted, suspect, suggestions, tips, and crosscheck_issues from problems."""
    counts = items.groupBy(id_column).agg(
        F.count("*").alias("total"),
        F.count_if("changed").alias("changed"),
        F.count_if("has_issues").alias("needs_check"),
        F.count_if(F.col("status").isin("verified", "link_ok")).alias("verified"),
        F.count_if("severe").alias("retracted"),
        F.count_if(F.col("status") == "suspect").alias("suspect"),
        F.sum("n_suggestions").alias("suggestions"),
        F.sum("n_tips").alias("tips"),
    )
    found = problems.groupBy(id_column).agg(F.count("*").alias("crosscheck_issues"))
    return counts.join(found, id_column, "left").withColumn("crosscheck_issues", F.coalesce("crosscheck_issues", F.lit(0)))


def certificate(items: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """verified, warn and skipped counts of a list's certificate."""
    status = F.col("status")
    return items.groupBy(id_column).agg(
        F.count_if(status.isin("verified", "link_ok")).alias("verified"), F.count_if(status.isin("mismatch", "not_found", "link_dead")).alias("warn"), F.count_if(status.isNull() | (status == "skipped")).alias("skipped")
    )


def health(entries: DataFrame, this_year: int, id_column: str = "doc_id", user_column: str | None = None) -> DataFrame:
    """One row a list: total, year_min, year_max, dated, recent_count, recent_ratio (of the last ten years), n_types, self_cites (authors whose name holds the
    user's)."""
    year = year_number(F.col("year"))
    recent = F.count_if(year >= this_year - (RECENT_YEARS - 1))
    own = F.exists("authors", lambda a: F.contains(a, F.col(user_column))) & (F.col(user_column) != "") if user_column else F.lit(False)
    counts = entries.groupBy(id_column).agg(
        F.count("*").alias("total"), F.min(year).alias("year_min"), F.max(year).alias("year_max"), F.count(year).alias("dated"), recent.alias("recent_count"), F.countDistinct(field("type")).alias("n_types"), F.count_if(own).alias("self_cites")
    )
    return counts.withColumn("recent_ratio", F.when(F.col("dated") > 0, F.round(F.col("recent_count") / F.col("dated"), 3)))


def year_distribution(entries: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return entries.withColumn("year_number", year_number(F.col("year"))).where("year_number IS NOT NULL").groupBy(id_column, "year_number").agg(F.count("*").alias("n"))


def type_counts(entries: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return entries.groupBy(id_column, F.coalesce(F.nullif(field("type"), F.lit("")), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def top_containers(entries: DataFrame, n: int = 5, id_column: str = "doc_id", seq_column: str = "seq") -> DataFrame:
    """The n most frequent journals of each list with their share of its articles; ties by first appearance."""
    own = entries.where((field("type") == "journal") & (field("container") != "")).withColumn("name", F.trim("container"))
    counts = own.groupBy(id_column, "name").agg(F.count("*").alias("n"), F.min(seq_column).alias("_first"))
    total = F.sum("n").over(Window.partitionBy(id_column))
    ranked = counts.withColumn("share", F.round(F.col("n") / total, 3)).withColumn("rank", F.row_number().over(Window.partitionBy(id_column).orderBy(F.desc("n"), "_first")))
    return ranked.where(F.col("rank") <= n).drop("_first")


def usage_totals(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """uses, files, refs and distinct named users, by keys or over all."""
    made = [F.count("*").alias("uses"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"), F.countDistinct(F.nullif(F.col("user"), F.lit(""))).alias("users")]
    return usage.groupBy(*(keys or [])).agg(*made)


def usage_by_org(usage: DataFrame) -> DataFrame:
    return usage_totals(usage.withColumn("org", named("org", "(미입력)")), ["org"])


#: Registers of a distinct sketch as a power of two: about 1.6 % standard error.
SKETCH = 12


def usage_levels(usage: DataFrame) -> DataFrame:
    """level (month, day, org, all), period, org, uses, files, refs, users, users_estimate of all levels in one aggregate.

    Grouping sets add up every level in one pass over the rows. users is exact; users_estimate comes from sketches that can be merged, so totals of new rows can be
    added to old ones without reading those again (merged_levels()). Rows whose time is too short for a level don't count there.
    """
    rows = usage.withColumns({"month": F.substring("time", 1, 7), "day": F.substring("time", 1, 10), "org": named("org", "(미입력)")})
    level = F.when(F.grouping("month") == 0, "month").when(F.grouping("day") == 0, "day").when(F.grouping("org") == 0, "org").otherwise("all")
    user = F.nullif(F.col("user"), F.lit(""))
    sums = rows.groupingSets([["month"], ["day"], ["org"], []], "month", "day", "org").agg(
        level.alias("level"), F.count("*").alias("uses"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"), F.countDistinct(user).alias("users"), F.hll_sketch_agg(user, F.lit(SKETCH)).alias("sketch")
    )
    found = sums.select("level", F.coalesce("month", "day").alias("period"), "org", "uses", "files", "refs", "users", F.hll_sketch_estimate("sketch").alias("users_estimate"), "sketch")
    return found.where((F.col("level") != "month") | (F.length("period") == 7)).where((F.col("level") != "day") | (F.length("period") == 10))


def merged_levels(*parts: DataFrame) -> DataFrame:
    """usage_levels() of several sets of rows as one: sums added, sketches merged; the exact number of users can't be added and is left out."""
    every = reduce(DataFrame.unionByName, (p.drop("users", "users_estimate") for p in parts))
    sums = every.groupBy("level", "period", "org").agg(*(F.sum(c).alias(c) for c in ("uses", "files", "refs")), F.hll_union_agg("sketch").alias("sketch"))
    return sums.withColumn("users_estimate", F.hll_sketch_estimate("sketch"))


def usage_by_period(usage: DataFrame) -> DataFrame:
    """uses, files, refs, users by month and by day in one aggregate: level month or day, period. Rows whose time is too short for a level don't count there."""
    return usage_levels(usage).where("level IN ('month', 'day')").select("level", "period", "uses", "files", "refs", "users")


def newest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order: one partial sort in each task, then one of n rows each."""
    return rows.orderBy(*order).limit(n)


def priced(log: DataFrame, prices: DataFrame) -> DataFrame:
    """log (date, model, input, output, cache_read, cache_write) with usd: rates of the model that hold on the day, the latest of several.

    prices: model, since, until (inclusive, null: open), input_rate, output_rate per million tokens. Cached tokens cost a tenth when read, a
    quarter more when written.
    """
    rates = prices.withColumnRenamed("model", "_model")
    days = log.select("model", "date").distinct()
    holds = F.col("model").eqNullSafe(F.col("_model")) & (F.col("since").isNull() | (F.col("date") >= F.col("since"))) & (F.col("until").isNull() | (F.col("date") <= F.col("until")))
    latest = F.max_by(F.struct("input_rate", "output_rate"), F.struct(F.col("since").isNotNull(), F.col("since")))
    known = days.join(rates, holds).groupBy("model", "date").agg(latest.alias("_rate"))
    own = log.alias("l").join(known.alias("k"), F.col("l.model").eqNullSafe(F.col("k.model")) & F.col("l.date").eqNullSafe(F.col("k.date")), "left")
    cost = (F.col("input") + F.col("cache_read") * CACHE_READ + F.col("cache_write") * CACHE_WRITE) * F.col("_rate.input_rate") + F.col("output") * F.col("_rate.output_rate")
    return own.select("l.*", (cost / 1e6).alias("usd"))


def cost_totals(log: DataFrame) -> DataFrame:
    """Log rows added up by day and model."""
    return log.groupBy("date", "model").agg(*(F.sum(c).alias(c) for c in ("calls", "input", "output", "cache_read", "cache_write", "usd")))


def cost_summary(log: DataFrame, today: str, budget: float) -> DataFrame:
    """One row: usd of today, this month and all, with calls of the month, what is left of the budget and its level (over, warn from 80 %, ok; none without
    a budget)."""
    month = F.substring("date", 1, 7) == today[:7]
    sums = log.agg(
        F.coalesce(F.sum(F.when(F.col("date") == today, F.col("usd"))), F.lit(0.0)).alias("today"),
        F.coalesce(F.sum(F.when(month, F.col("usd"))), F.lit(0.0)).alias("month"),
        F.coalesce(F.sum("usd"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(month, F.col("calls"))), F.lit(0)).alias("month_calls"),
    )
    share = F.col("month") / F.lit(budget) if budget > 0 else F.lit(None).cast("double")
    level = F.when(share.isNull(), "none").when(share >= 1.0, "over").when(share >= 0.8, "warn").otherwise("ok")
    return sums.select(*(F.round(c, 4).alias(c) for c in ("today", "month", "total")), "month_calls", F.round(F.greatest(F.lit(0.0), F.lit(float(budget)) - F.col("month")), 4).alias("remaining"), level.alias("level"))


def cost_by(log: DataFrame, column: str) -> DataFrame:
    return log.groupBy(column).agg(F.sum("calls").alias("calls"), F.round(F.sum("usd"), 4).alias("usd"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """rows, papers (distinct hid and pub where there is a hid), same (pairs that agree), match_rate of all rows."""
    paper = F.when(field("hid") != "", F.struct(field("hid").alias("h"), field("pub").alias("p")))
    same = F.count_if((F.col("kind") == "pair") & F.col("same"))
    stats = corpus.agg(F.count("*").alias("rows"), F.countDistinct(paper).alias("papers"), same.alias("same"))
    return stats.withColumn("match_rate", F.when(F.col("rows") > 0, F.round(F.col("same") / F.col("rows"), 4)))


def corpus_by_org(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy(named("org", "미지정").alias("org")).agg(F.count("*").alias("n"))


def upper_median(values: Column) -> Column:
    """The middle value, the upper one of two."""
    return F.get(F.array_sort(F.collect_list(values)), F.floor(F.count(values) / 2).cast("int"))


def seconds_per_wave(usage: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """per_wave and samples by keys: the upper median over the newest 30 runs of seconds for each four files."""
    runs = usage.where("secs > 0 AND files > 0").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))).where(F.col("_n") <= SAMPLE_RUNS)
    return runs.groupBy(*keys).agg(upper_median(F.col("secs") / F.ceil(F.col("files") / FILES_AT_ONCE)).alias("per_wave"), F.count("*").alias("samples"))


def estimate(per_wave: Column, n_files: Column, ai: Column, verified: Column) -> Column:
    """Expected seconds: waves of four files by the time of one, defaults where there is no history, 15 at least."""
    default = F.when(ai, F.when(verified, 150).otherwise(80)).otherwise(F.when(verified, 25).otherwise(8))
    return F.greatest(F.lit(LEAST_SECONDS), F.floor(F.coalesce(per_wave, default) * F.ceil(F.greatest(n_files, F.lit(1)) / FILES_AT_ONCE)).cast("int"))


def practice(entries: DataFrame, papers_key: str = "doc_id") -> DataFrame:
    """By journal: papers, refs, refs_per_paper, shares of entries with a DOI and of western ones, theses."""
    return entries.groupBy("journal").agg(
        F.countDistinct(papers_key).alias("papers"),
        F.count("*").alias("refs"),
        F.round(F.count("*") / F.countDistinct(papers_key), 1).alias("refs_per_paper"),
        F.round(F.count_if(field("doi") != "") / F.count("*"), 3).alias("doi_share"),
        F.round(F.count_if(field("lang") == "west") / F.count("*"), 3).alias("western_share"),
        F.count_if(field("type") == "thesis").alias("theses"),
    )


def with_journal(rows: DataFrame, journals: DataFrame) -> DataFrame:
    """rows with the journal of their society (column org), null for one that the dimension (org, journal) lacks."""
    return rows.join(journals.select("org", "journal").dropDuplicates(["org"]), "org", "left")


def repeated_patterns(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Patterns that occur often enough to make a rule."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def dashboard(requests: DataFrame, costs: DataFrame, usage: DataFrame, month: str) -> DataFrame:
    """One row: pending requests, uses of the month, mean cost of the jobs that cost something."""
    parts = [
        requests.agg(F.count_if(F.col("status") == "pending").alias("pending")),
        usage.agg(F.count_if(F.substring("time", 1, 7) == month).alias("month_uses")),
        costs.agg(F.avg(F.nullif(F.col("usd"), F.lit(0.0))).alias("mean_cost")),
    ]
    return reduce(lambda a, b: a.join(b, "_k"), [p.withColumn("_k", F.lit(0)) for p in parts]).drop("_k")
