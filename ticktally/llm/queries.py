"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import distinct_rows
from ..session import cut, table
from . import lossy, mix, pack, pii, pii_train, quantile

SUPPORT, ERROR = 0.01, 0.0005
PCTS = (50, 90, 95, 99)
LIMITS = 100_000  # rows of a limits table that may be broadcast
KEYS = ["script_name", "field_name"]


# --- 5: most frequent items -------------------------------------------------------------------


def _items(spark: SparkSession, d: str, support: float) -> tuple[DataFrame, DataFrame, int]:
    fields = ["hostname", "script_name"]
    rows = cut(distinct_rows(table(spark, d, "requests"), ["request_id", *fields]))
    total = rows.count()
    return rows, lossy.frequent_items(rows, fields, support, ERROR, total), total


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Host and script names in at least 1 % of all requests."""
    rows, items, total = _items(spark, d, SUPPORT)
    items = cut(items)  # at most 2/support rows per field
    open_ = [(r["field_name"], r["item"]) for r in items.where(~F.col("guaranteed")).collect()]
    sure = items.where("guaranteed").select("field_name", "item")
    if not open_:
        return sure
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("item")) for f in ("hostname", "script_name")]))
    asked = F.broadcast(spark.createDataFrame(open_, "field_name string, item string"))
    exact = rows.select(pair.alias("p")).select("p.*").join(asked, ["field_name", "item"], "left_semi").groupBy("field_name", "item").count()
    return sure.unionByName(exact.where(F.col("count") >= SUPPORT * total).drop("count"))


def p5_interval_check(spark: SparkSession, d: str) -> DataFrame:
    """Items in at least 0.4 % of all requests: is their exact count within the interval of the counter?"""
    rows, items, total = _items(spark, d, 0.003)
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("item")) for f in ("hostname", "script_name")]))
    exact = rows.select(pair.alias("p")).select("p.*").groupBy("field_name", "item").agg(F.count(F.lit(1)).alias("requests")).where(F.col("requests") >= 0.004 * total)
    return exact.join(items, ["field_name", "item"], "left").where(F.col("item").isNotNull()).select("field_name", "item", "requests", F.coalesce(F.col("requests").between(F.col("low"), F.col("high")), F.lit(False)).alias("within"))


def p5_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Items that may reach 0.3 %, with the interval that holds their true count."""
    return _items(spark, d, 0.003)[1]


# --- 6: percentiles ---------------------------------------------------------------------------


def measured(spark: SparkSession, d: str) -> DataFrame:
    """(script_name, field_name, day, piece, value) of distinct requests and timers."""
    r = distinct_rows(table(spark, d, "requests").where(F.col("script_name").isNotNull()), ["request_id", "script_name", "ts", "request_time"])
    t = distinct_rows(table(spark, d, "timers"), ["request_id", "timer_no", "timer_value"])
    r = r.withColumn("day", F.to_date("ts"))
    own = r.select("script_name", F.lit("request_time").alias("field_name"), "day", F.col("request_time").cast("double").alias("value"))
    timers = t.join(r.select("request_id", "script_name", "day"), "request_id").select("script_name", F.lit("timer_value").alias("field_name"), "day", F.col("timer_value").cast("double").alias("value"))
    return own.unionByName(timers).where((F.col("value") >= 0) & (F.col("value") < float("inf")))


def sketches(part: DataFrame, keys: list[str], k: int = quantile.CAPACITY) -> DataFrame:
    """One sketch per group of ``keys``; the tasks' own sketches are written once, so that they can be numbered."""
    own = cut(quantile.partial_sketches(part, keys, "value", k))
    return quantile.merge_sketches(own, keys, F.spark_partition_id(), own.rdd.getNumPartitions(), k)


def daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    return sketches(measured(spark, d), [*KEYS, "day"])


def total_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The daily sketches combined."""
    days = cut(daily_sketches(spark, d))
    number = F.unix_date("day")
    first, last = days.agg(F.min(number), F.max(number)).first()
    return quantile.merge_sketches(days.where(F.col("day").isNotNull()), KEYS, number - F.lit(first or 0), (last or 0) - (first or 0) + 1)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Limits that the percentile reaches: sketches decide where their bounds do, exact counts the rest."""
    limits = table(spark, d, "percentile_limits").select(*KEYS, "pct", "limit_s").distinct()
    s = sketches(measured(spark, d), KEYS)
    at = s.join(F.broadcast(limits) if limits.count() <= LIMITS else limits, KEYS)
    at = at.select(*KEYS, "pct", "limit_s", "n", "over", "under", quantile.below("limit_s").alias("lt"))
    need = F.col("pct") * F.col("n")
    verdict = F.when((F.col("lt") + F.col("under")) * 100 < need, "yes").when((F.col("lt") - F.col("over")) * 100 >= need, "no").otherwise("open")
    at = cut(at.withColumn("verdict", verdict))  # as many rows as limits
    yes = at.where("verdict = 'yes'").select(*KEYS, "pct")
    unsure = at.where("verdict = 'open'")
    if unsure.isEmpty():
        return yes
    few = F.broadcast(unsure) if unsure.count() <= LIMITS else unsure
    exact = measured(spark, d).join(few.select(*KEYS, "pct", "limit_s", "n"), KEYS)
    exact = exact.groupBy(*KEYS, "pct", "limit_s", "n").agg(F.count_if(F.col("value") < F.col("limit_s")).alias("lt"))
    return yes.unionByName(exact.where(F.col("lt") * 100 < need).select(*KEYS, "pct"))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every script over all days, with the certified rank error."""
    return quantile.percentiles(total_sketches(spark, d), KEYS, PCTS)


def p6_small_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from buffers of 64 values, held against exact ranks: does the certified interval hold the true rank?"""
    part = cut(measured(spark, d))
    s = cut(sketches(part, KEYS, 64))
    found = quantile.percentiles(s, KEYS, PCTS).join(s.select(*KEYS, "over", "under"), KEYS)
    ranks = part.join(found.select(*KEYS, "pct", F.col("value").alias("v")), KEYS).groupBy(*KEYS, "pct").agg(F.count_if(F.col("value") < F.col("v")).alias("lt"), F.count_if(F.col("value") <= F.col("v")).alias("le"))
    need = F.col("pct") * F.col("n")
    within = ((F.col("le") + F.col("over")) * 100 >= need) & ((F.col("lt") - F.col("under")) * 100 < need)
    return found.join(ranks, [*KEYS, "pct"]).select(*KEYS, "pct", "n", within.alias("within_bounds"))


def p6_daily(spark: SparkSession, d: str) -> DataFrame:
    """The same per day."""
    return quantile.percentiles(daily_sketches(spark, d), [*KEYS, "day"], PCTS)


# --- 7 and 8: containers and mixes --------------------------------------------------------------

PATTERNS = 10_000  # membership patterns that a flow is planned for; more of them are refused
PLANS = 1000  # pack plans and mix targets are small tables; more rows than this are refused
SEED = 8


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return pack.sized(table(spark, d, "documents"), "doc_id", "source", "text")


def _small(df: DataFrame) -> list:
    rows = df.limit(PLANS + 1).collect()
    if len(rows) > PLANS:
        raise ValueError("not a small table")
    return rows


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a text above the capacity, with its container in every plan."""
    plans = {r["plan_id"]: (r["capacity_tokens"], r["source"]) for r in _small(table(spark, d, "pack_plans"))}
    return pack.pack_items(_sized(spark, d), "doc_id", "n_tokens", plans, "source")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and their fill, per plan."""
    return pack.fill_report(p7_pack(spark, d), table(spark, d, "pack_plans"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per plan: its texts, whether each text's tokens are placed once and in order, and whether no container is over-full."""
    plans = table(spark, d, "pack_plans").select("plan_id", "capacity_tokens")
    placed = p7_pack(spark, d)
    own = placed.groupBy("plan_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("pieces"), F.max("piece_no").alias("last"), F.count_if((F.col("n_tokens") > 0) != F.col("bin_id").isNotNull()).alias("odd"))
    texts = own.groupBy("plan_id").agg(F.count(F.lit(1)).alias("texts"), F.bool_and((F.col("n") == F.col("end")) & (F.col("pieces") == F.col("last") + 1) & (F.col("odd") == 0)).alias("whole"))
    bins = placed.where("bin_id is not null").groupBy("plan_id", "bin_id").agg(F.sum("n_tokens").alias("used")).groupBy("plan_id").agg(F.max("used").alias("fullest"), F.count(F.lit(1)).alias("bins"), F.max("bin_id").alias("last_bin"))
    return plans.join(texts, "plan_id").join(bins, "plan_id").select("plan_id", "texts", "whole", ((F.col("fullest") <= F.col("capacity_tokens")) & (F.col("bins") == F.col("last_bin") + 1)).alias("within_capacity"))


def _mixes(spark: SparkSession, d: str, families: bool = False) -> tuple[DataFrame, DataFrame]:
    targets: dict[int, list] = {}
    ratio = {}
    for r in sorted(_small(table(spark, d, "mix_targets")), key=lambda r: (r["mix_id"], r["source"])):
        targets.setdefault(r["mix_id"], []).append(mix.Target(r["source"], float(r["target_weight"]), int(r["max_repeats"])))
        ratio[r["mix_id"]] = float(r["budget_ratio"])
    docs = _sized(spark, d)
    known = sorted({t.source for ts in targets.values() for t in ts})
    own = F.when(F.col("source").isin(known), F.array("source")).otherwise(F.array().cast("array<string>"))
    if families:
        family = table(spark, d, "documents").where(F.col("source").isin(known) & F.col("family_id").isNotNull()).groupBy("family_id").agg(F.sort_array(F.collect_set("source")).alias("__all"))  # at most the known sources
        docs = docs.join(table(spark, d, "documents").select("doc_id", "family_id"), "doc_id").join(family, "family_id", "left")
        own = F.coalesce("__all", own)
    docs = docs.select("doc_id", "n_tokens", own.alias("pattern"))
    per = docs.groupBy("pattern").agg(F.sum("n_tokens").alias("s")).limit(PATTERNS + 1).collect()  # one row per membership pattern
    if len(per) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    sums = {tuple(r["pattern"]): int(r["s"]) for r in per}
    total = sum(sums.values())
    patterns = {p: s for p, s in sums.items() if p and s}
    stretches, quotas = [], []
    for m, ts in targets.items():
        quota, flows = mix.route(patterns, ts, round(total * ratio[m]))
        stretches += [(m, *f) for f in flows]
        weights = sum(t.weight for t in ts if t.weight > 0)
        quotas += [(m, t.source, t.weight / weights if weights and t.weight > 0 else 0.0, t.max_repeats, quota[t.source], sum(n for p, n in patterns.items() if t.source in p)) for t in ts]
    chosen = mix.select(docs.where(F.size("pattern") > 0), "doc_id", stretches, SEED)
    return chosen, spark.createDataFrame(quotas, "mix_id int, source string, target_share double, max_repeats int, quota_tokens bigint, source_tokens bigint")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The selection of every mix: documents with the number of times they appear."""
    return _mixes(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of every source of every mix, and whether its quota could be filled."""
    chosen, quotas = _mixes(spark, d)
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    out = quotas.join(F.broadcast(got), ["mix_id", "source"], "left").join(F.broadcast(whole), "mix_id", "left")  # both as long as the targets at most
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "mix_id", "source", "target_share", (zero("tokens") / F.col("mix_tokens")).alias("actual_share"), "quota_tokens", zero("tokens").alias("tokens"),
        zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"), "max_repeats", "source_tokens", (F.col("quota_tokens") <= F.col("source_tokens") * F.col("max_repeats")).alias("reachable"),
    )


def _mix_check(spark: SparkSession, d: str, families: bool) -> DataFrame:
    chosen, quotas = _mixes(spark, d, families)
    chosen = cut(chosen)
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most"), F.max("n_tokens").alias("largest"))
    twice = chosen.groupBy("mix_id", "doc_id", "source").count().where("count > 1").groupBy("mix_id", "source").agg(F.lit(True).alias("twice"))
    out = quotas.join(got, ["mix_id", "source"], "left").join(twice, ["mix_id", "source"], "left")
    tokens = F.coalesce("tokens", F.lit(0))
    reach = F.least("quota_tokens", F.col("source_tokens") * F.col("max_repeats"))
    # each pass of a pattern may end half a document off
    near = tokens <= F.col("quota_tokens") + F.col("largest") * F.greatest("most", F.lit(1))
    full = F.lit(families) | (tokens >= reach - F.coalesce("largest", F.lit(0)) * F.greatest(F.coalesce("most", F.lit(1)), F.lit(1)))
    return out.select("mix_id", "source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_ok"), F.coalesce(near, F.lit(True)).alias("not_over"), full.alias("filled"), F.col("twice").isNull().alias("once"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source: is the limit of repetitions kept, the quota met within a document, no document chosen twice?"""
    return _mix_check(spark, d, False)


def p8_families_check(spark: SparkSession, d: str) -> DataFrame:
    """The same where sources overlap: a document belongs to the sources of all members of its family."""
    return _mix_check(spark, d, True)


# --- 9: personal information ---------------------------------------------------------------------


LEXICON = 2_000_000  # words; the lexicon goes along with every task, 16 bytes a word


def _lexicon(spark: SparkSession, d: str) -> pii.Lexicon:
    words = table(spark, d, "name_lexicon").select("word", "word_kind").limit(LEXICON + 1).collect()
    if len(words) > LEXICON:
        raise ValueError(f"the lexicon has more than {LEXICON} words")
    return pii.Lexicon([tuple(w) for w in words])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pieces of personal information of every text."""
    return pii.find(table(spark, d, "documents"), "doc_id", "text", _lexicon(spark, d), pii_train.fitted())


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its personal information replaced by typed placeholders."""
    return pii.redact(table(spark, d, "documents"), "doc_id", "text", _lexicon(spark, d), pii_train.fitted())


QUERIES = {f.__name__: f for f in (p5_found, p5_intervals, p5_interval_check, p6_found, p6_percentiles, p6_small_buffers, p6_daily, p7_pack, p7_fill, p7_check, p8_mix, p8_shares, p8_check, p8_families_check, p9_found, p9_redacted)}
ORACLES = {
    "p5_found": """
        with r as (select distinct request_id, hostname, script_name from requests),
        n as (select count(*) n from r)
        select 'hostname' as field_name, hostname as item from r where hostname is not null group by hostname having count(*) >= 0.01 * (select n from n)
        union all
        select 'script_name', script_name from r where script_name is not null group by script_name having count(*) >= 0.01 * (select n from n)""",
    "p5_interval_check": """
        with r as (select distinct request_id, hostname, script_name from requests),
        i as (select 'hostname' as field_name, hostname as item from r union all select 'script_name', script_name from r)
        select field_name, item, count(*) requests, true as within from i where item is not null group by all having count(*) >= 0.004 * (select count(*) from r)""",
    "p6_small_buffers": """
        with r as (select distinct request_id, script_name, request_time from requests where script_name is not null),
        t as (select distinct request_id, timer_no, timer_value from timers),
        v as (select script_name, 'request_time' field_name, request_time::double x from r
              union all select script_name, 'timer_value', timer_value::double from t join r using (request_id))
        select script_name, field_name, pct, n, true as within_bounds
        from (select script_name, field_name, count(*) n from v where x >= 0 and not isnan(x) and not isinf(x) group by all), (values (50), (90), (95), (99)) p(pct)""",
    "p7_check": """
        select plan_id, count(*) texts, true as whole, true as within_capacity
        from pack_plans p join documents d on p.source is null or d.source = p.source group by plan_id""",
    "p8_check": "select mix_id, source, true as repeats_ok, true as not_over, true as filled, true as once from mix_targets",
    "p8_families_check": "select mix_id, source, true as repeats_ok, true as not_over, true as filled, true as once from mix_targets",
    "p6_found": """
        with r as (select distinct request_id, script_name, request_time from requests where script_name is not null),
        t as (select distinct request_id, timer_no, timer_value from timers),
        v as (select script_name, 'request_time' field_name, request_time::double x from r
              union all select script_name, 'timer_value', timer_value::double from t join r using (request_id)),
        ok as (select * from v where x >= 0 and not isnan(x) and not isinf(x)),
        c as (select l.script_name, l.field_name, l.pct, l.limit_s, count(*) n, count(*) filter (where x < l.limit_s) lt
              from percentile_limits l join ok using (script_name, field_name) group by all)
        select distinct script_name, field_name, pct from c where lt * 100 < pct * n""",
}
