"""Small stores as change logs: validated inserts, updates, deletes, retention, set operations, scoped reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from refloom.functions.text import either, strip, sub
from refloom.operators.render import field

# Known types, lengths that fields are cut to, and the least length of a rule.
KNOWN_TYPES = ["journal", "book", "book_chapter", "thesis", "report", "newspaper", "web", "conference", "law", "standard", "interview", "av", "unknown"]
MOST_DELETED = 500
CAPS = {"topic": 60, "rule": 600, "example": 600, "evidence": 300, "journal": 60}
SHORTEST_RULE, KEPT_RECORDS = 5, 300
SHORTEST_STYLE, LONGEST_STYLE = 100, 40_000
HOUSE_STYLE, OTHER_ORG, NO_ORG, NO_NAME = "munpyeonhyeop", "기타", "기타(미기입)", "이름 없는 기준"


def json_store(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON array file or folder; a missing one is empty, damaged records are dropped."""
    try:
        return spark.read.schema(ddl).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], ddl)


def record_folder(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Records of one JSON file each, with the time they were written, newest first."""
    rows = spark.read.schema(ddl).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("written")).orderBy(F.desc("written"))


def rule_key(c: Column) -> Column:
    """A rule without blanks."""
    return sub(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def validated(rules: DataFrame) -> DataFrame:
    """Rules that may be stored: five characters at least, known types only, fields cut to their lengths, a topic for all."""
    rows = rules.withColumn("rule", F.trim(field("rule"))).where(F.length("rule") >= SHORTEST_RULE)
    rows = rows.withColumns({f: F.substring(F.trim(field(f)), 1, n) for f, n in CAPS.items() if f in rules.columns})
    return rows.withColumns({"topic": F.coalesce(F.nullif("topic", F.lit("")), F.lit("일반")), "types": F.filter(F.coalesce("types", F.array().cast("array<string>")), lambda t: t.isin(KNOWN_TYPES))})


def new_rules(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, skipped): validated incoming rules that neither the store nor an earlier incoming one has, blanks aside, in the same source (and journal, for
    rules of a society); all others."""

    def scope(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_key": rule_key(F.col("rule")), "_scope": F.when(F.col("source") == "org", field("journal")).otherwise("")})

    own = scope(validated(incoming))
    first = Window.partitionBy("source", "_scope", "_key").orderBy("seq")
    fresh = own.withColumn("_n", F.row_number().over(first)).where("_n = 1").join(scope(stored).select("source", "_scope", "_key").distinct(), ["source", "_scope", "_key"], "left_anti")
    added = fresh.select(*incoming.columns)
    return added, incoming.join(added.select("seq"), "seq", "left_anti")


def last_changes(log: DataFrame, key: str, version: str, as_of: int | None = None) -> DataFrame:
    """The last change of each key, up to a version if one is given. Of changes with one version (only a log that accepted() didn't guard has any) the
    deletion counts, then the greatest row, so the result doesn't depend on the order in which rows are read."""
    rows = log if as_of is None else log.where(F.col(version) <= as_of)
    order = [F.desc(version), F.desc(F.col("op") == "delete"), F.desc(F.struct(*(F.col(c).cast("string") for c in sorted(log.columns))))]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def latest(log: DataFrame, key: str, version: str, as_of: int | None = None) -> DataFrame:
    """State of a change log, now or as of a version: the last change of each key; those whose last change is a deletion are gone."""
    return last_changes(log, key, version, as_of).where("op <> 'delete'").drop("op")


def accepted(log: DataFrame, changes: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected): changes that were made on the state as it is.

    changes: key, expected (the version that the writer saw, null for a key that it saw none of), writer, op and values. A change is rejected if its key has another
    version by now; of several writers that expect the same, the first by name is accepted. Accepted rows get the next version of their key.
    """
    now = log.groupBy(key).agg(F.max(version).alias("_now"))
    judged = changes.join(now, key, "left").withColumn("_fits", F.col("expected").eqNullSafe(F.col("_now")))
    judged = judged.withColumn("_n", F.when(F.col("_fits"), F.row_number().over(Window.partitionBy(key, "_fits").orderBy("writer"))))
    good = F.coalesce(F.col("_fits") & (F.col("_n") == 1), F.lit(False))
    appended = judged.where(good).withColumn(version, F.coalesce("_now", F.lit(0)) + 1).select(*log.columns)
    return appended, judged.where(~good).select(*changes.columns)


def compacted(log: DataFrame, key: str, version: str, upto: int) -> DataFrame:
    """A shorter log with the same state as of `upto` and of every later version: of older changes only each key's last one stays. A deletion stays too, as an older
    writer may still expect the version before it."""
    old = log.where(F.col(version) <= upto)
    return last_changes(old, key, version).select(*log.columns).unionByName(log.where(F.col(version) > upto))


def bulk_deleted(state: DataFrame, ids: DataFrame, key: str, version: Column, org: str | None) -> DataFrame:
    """Log rows that delete the first MOST_DELETED of the ids (ids: key, seq) that a viewer may see; others are left alone."""
    asked = first_per_key(ids, [key], F.col("seq")).orderBy("seq", key).limit(MOST_DELETED)
    return changed_rows(scoped(state, org), asked, key, version, "delete")


def changed_rows(state: DataFrame, ids: DataFrame, key: str, version: Column, op: str, **values: Column) -> DataFrame:
    """Log rows for the rows of these ids: op update with new values, or op delete."""
    rows = state.join(ids.select(key).distinct(), key, "left_semi")
    return rows.withColumns(values | {"version": version, "op": F.lit(op)})


def toggled(state: DataFrame, ids: DataFrame, key: str, version: Column) -> DataFrame:
    return changed_rows(state, ids, key, version, "update", enabled=~F.col("enabled"))


def resolved(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """requests with the status of their decision (request_id, action approve or reject, resolver, note); only pending ones change, the first decision counts."""
    first = decisions.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy("seq"))).where("_n = 1").select("request_id", "action", F.col("resolver").alias("_by"), F.col("note").alias("_note"))
    rows = requests.join(first, "request_id", "left")
    acts = (F.col("status") == "pending") & F.col("action").isin("approve", "reject")
    status = F.when(acts, F.when(F.col("action") == "approve", "approved").otherwise("rejected")).otherwise(F.col("status"))
    return rows.withColumns({"status": status, "resolved_by": F.when(acts, F.col("_by")), "note": F.when(acts, F.col("_note"))}).drop("action", "_by", "_note")


def scoped(rows: DataFrame, org: str | None) -> DataFrame:
    """Rows that a viewer may see: all for none (an administrator), else those of the own organisation."""
    return rows if org is None else rows.where(F.col("org") == org)


def enabled_rules(rules: DataFrame, org: str = "") -> DataFrame:
    """Enabled rules; those of a society only for its own manuscripts. label names the society's."""
    kept = rules.where("enabled").where((F.col("source") != "org") | (F.lit(org != "") & (field("journal") == org)))
    return kept.withColumn("label", F.when(F.col("source") == "org", field("journal")).otherwise(F.col("source")))


def routed_rules(rules: DataFrame, org: str) -> DataFrame:
    """Enabled rules with place: specific to a society, common to all, or left out: a society's are specific to it alone; case rules whose journal names it, too."""
    named = F.contains(field("journal"), F.lit(org)) & F.lit(org != "")
    place = F.when((F.col("source") == "org") & (field("journal") == org), "specific").when(F.col("source") == "org", F.lit(None)).when(named, "specific").when(field("journal") == "", "common")
    return rules.where("enabled").withColumn("place", place).where("place IS NOT NULL")


def retained(records: DataFrame, n: int = KEPT_RECORDS) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): the newest n records and the rest. The line between them is the n-th newest, found by partial sorts; no row number over all."""
    key = F.struct("written", "record_id")
    last = records.select(key.alias("k")).orderBy(F.desc("k")).limit(n).agg(F.min("k").alias("line"))
    marked = records.withColumn("_one", F.lit(0)).join(F.broadcast(last.withColumn("_one", F.lit(0))), "_one").withColumn("_kept", key >= F.col("line"))  # one row
    return marked.where("_kept").drop("_one", "line", "_kept"), marked.where("NOT coalesce(_kept, false)").drop("_one", "line", "_kept")


def retained_by(records: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n records of each group."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def tagged_union(**parts: DataFrame) -> DataFrame:
    """All rows of the parts with kind, the part's name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("kind", F.lit(k)) for k, p in parts.items()))


def key_union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def key_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both have."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def all_unique(codes: DataFrame, column: str) -> DataFrame:
    """One row, ok: whether no two of the codes that are set are equal."""
    own = codes.where(field(column) != "")
    return own.agg((F.count("*") == F.countDistinct(column)).alias("ok"))


def styles(texts: DataFrame) -> DataFrame:
    """texts (name, text, source and, for files that could not be read, error) as a user's own styles: style_id, name, source, text, error.

    The id is made of name and text. A style of under 100 characters has an error and no id; a longer one than 40,000 is cut.
    """
    own = strip(field("text"))
    failed = field("error") if "error" in texts.columns else F.lit("")
    error = either(failed, F.when(F.length(own) < SHORTEST_STYLE, "a style needs 100 characters or more").otherwise(""))
    rows = texts.withColumns({"text": F.substring(own, 1, LONGEST_STYLE), "name": either(F.trim(field("name")), F.lit(NO_NAME)), "error": F.nullif(error, F.lit(""))})
    return rows.withColumn("style_id", F.when(F.col("error").isNull(), F.concat(F.lit("st_"), F.substring(F.sha2(F.concat_ws("\n", "name", "text"), 256), 1, 10))))


def job_options(requests: DataFrame) -> DataFrame:
    """requests with the checked options of their job, or an error: switches are on if "1", corrections only with verification, names are cut to their lengths."""
    org, user = F.trim(field("org")), F.trim(field("user_name"))
    org = F.when(org == OTHER_ORG, either(F.trim(field("org_etc")), F.lit(NO_ORG))).otherwise(org)
    on = {s: field(s) == "1" for s in ("verify", "crosscheck", "english", "autofix", "apply_extra")}
    error = F.when(user == "", "a user's name is needed").when(org == "", "an organisation is needed")
    return requests.withColumns(on | {"autofix": on["autofix"] & on["verify"], "style_id": either(field("style_id"), F.lit(HOUSE_STYLE)), "user_name": F.substring(user, 1, 40), "org": F.substring(org, 1, 60), "error": error}).drop("org_etc")


def remembered(rows: DataFrame, key: str, cache: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with answer and failed, cache with the new answers): each key that the cache (key, answer) lacks is asked for once.

    That nothing is known is an answer too (null) and is remembered; an answer that failed is not. ask: keys to key, answer, failed.
    """
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")
    new = ask(keys).select(key, "answer", F.coalesce("failed", F.lit(False)).alias("failed"))
    known = cache.select(key, "answer").withColumn("failed", F.lit(False)).unionByName(new)
    return rows.join(known, key, "left"), cache.select(key, "answer").unionByName(new.where("NOT failed").select(key, "answer"))


CODES = ("access_codes", "editor_codes", "chair_codes")
LONGEST_CODE = 60


def saved_settings(current: DataFrame, changes: DataFrame, models: list[str]) -> DataFrame:
    """Settings after a change: id, model, access_code, monthly_budget_usd, usd_krw, the maps of CODES (society to code), key (what becomes of the service's key: set,
    cleared or kept; the key itself is no setting and is stored nowhere here) and error. With an error nothing is changed.

    current: id and the settings; changes: id, api_key, clear, and settings as text, null for those that were not sent. An unknown model becomes the first of models. An
    empty number or code unsets it. Codes are JSON objects, cut to their length, without empty names or codes. No two codes of a store may be equal, whatever their role.
    """
    sent = changes.select("id", *(F.col(c).alias(f"_{c}") for c in ("api_key", "clear", "model", "access_code", "monthly_budget_usd", "usd_krw", *CODES)))
    rows = current.join(sent, "id")
    made, errors = {}, []
    for c in ("monthly_budget_usd", "usd_krw"):
        text = F.replace(F.trim(F.col(f"_{c}")), F.lit(","), F.lit(""))
        number = text.try_cast("double")
        errors.append(F.when(text.isNotNull() & (text != "") & (number.isNull() | F.isnan(number)), "a budget or a rate is a number"))
        made[c] = F.when(text.isNull(), F.col(c)).when(text != "", F.greatest(F.lit(0.0), number))
    for c in CODES:
        found = F.from_json(F.col(f"_{c}"), "map<string,string>")
        shaped = F.coalesce(F.col(f"_{c}").rlike(r"^\s*\{"), F.lit(False)) & found.isNotNull()
        errors.append(F.when(F.col(f"_{c}").isNotNull() & ~shaped, "codes are an object of names and codes"))
        cut = F.transform(F.map_entries(found), lambda e: F.struct(F.substring(F.trim(e["key"]), 1, LONGEST_CODE).alias("k"), F.substring(F.trim(F.coalesce(e["value"], F.lit(""))), 1, LONGEST_CODE).alias("v")))
        kept = F.filter(cut, lambda e: (e["k"] != "") & (e["v"] != ""))
        made[c] = F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.map_from_entries(kept))
    made["access_code"] = F.when(F.col("_access_code").isNull(), F.col("access_code")).otherwise(F.substring(F.trim("_access_code"), 1, LONGEST_CODE))
    made["model"] = F.when(F.col("_model").isin(models), F.col("_model")).otherwise(F.lit(models[0]))
    every = F.concat(*(F.coalesce(F.map_values(made[c]), F.array().cast("array<string>")) for c in CODES), F.filter(F.array(F.trim(F.coalesce(made["access_code"], F.lit("")))), lambda c: c != ""))
    broken = F.coalesce(*errors)
    judged = rows.withColumn("error", F.coalesce(broken, F.when(broken.isNull() & (F.size(F.array_distinct(every)) < F.size(every)), "two codes are equal")))
    good = F.col("error").isNull()
    key = F.when(good & (F.col("_clear") == "1"), "cleared").when(good & (F.trim(field("_api_key")) != ""), "set").otherwise("kept")
    return judged.select("id", *(F.when(good, made[c]).otherwise(F.col(c)).alias(c) for c in ("model", "access_code", "monthly_budget_usd", "usd_krw", *CODES)), key.alias("key"), "error")


def code_hash(code: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), code), 256)


def file_place(month: Column, name: Column) -> Column:
    """Where an uploaded file is kept: a folder a month, a safe name."""
    from refloom.functions.text import safe_name

    return F.concat(F.lit("uploads/"), month, F.lit("/"), safe_name(name))
