"""Queries of the data-processing problems in the core: nested records, wide tables, spikes, hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import distinct_rows
from ..operators.nested import EDGES, graph_of, observed_edges, plan_relations
from ..operators.skew import fragment_aggregate, fragment_join, plan_fragments
from ..operators.spikes import SpikeRules, implausible, impossible, stuck_rows
from ..operators.wide import CATALOG, filled_cells, resolved_tags, stitch
from ..session import table
from ..sources.wire_json import bare_key, request_shredder


def _shredded(spark: SparkSession, d: str) -> DataFrame:
    return request_shredder().shred(table(spark, d, "packets"), "packet_id", "payload", "received_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per timer tag of every request object, along the foreign keys request - timer - tag."""
    r = _shredded(spark, d).select("packet_id", F.col("path").alias("request_path"), "parent_path", F.explode_outer("timers").alias("t"))
    r = r.select("packet_id", "request_path", "parent_path", "t", F.explode_outer("t.tags").alias("g"))
    return r.select(
        "packet_id", "request_path", "parent_path",
        F.coalesce("t.ordinal", F.lit(-1)).cast("int").alias("timer_no"),
        F.coalesce("g.ordinal", F.lit(-1)).cast("int").alias("tag_no"),
        F.coalesce("t.hit_count", F.lit(0)).cast("bigint").alias("hit_count"),
        F.coalesce("g.tag_name", F.lit("")).alias("tag_name"), F.coalesce("g.tag_value", F.lit("")).alias("tag_value"),
    )


def p1_requests(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of request objects with the foreign key to the enclosing object."""
    return request_shredder().flat(_shredded(spark, d), "packet_id")["request"]


def p1_timers(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of timers, keyed by packet, request path and timer number."""
    return request_shredder().flat(_shredded(spark, d), "packet_id")["request_timers"]


def p1_request_tags(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the request objects' own tags."""
    return request_shredder().flat(_shredded(spark, d), "packet_id")["request_tags"]


def p1_schema(spark: SparkSession, d: str) -> DataFrame:
    """What shared inlining makes of the schema graph observed in all payloads: which elements become relations, and
    why, and which are inlined into which relation."""
    edges = observed_edges(table(spark, d, "packets"), "payload", bare_key).limit(EDGES + 1).collect()
    if len(edges) > EDGES:
        raise ValueError(f"more than {EDGES} edges in the schema graph")
    plan = plan_relations(graph_of([tuple(e)[:4] for e in edges]), "document")
    rows = [(r.element, "relation", ",".join(r.reasons), ",".join(sorted({p for p, _ in r.under})), len(r.columns)) for r in plan.values()]
    rows += [(".".join(path), "inlined", "singleton", r.element, 0) for r in plan.values() for path in r.inlined]
    return spark.createDataFrame(rows, "element string, decision string, reasons string, under string, columns int")


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    catalog = table(spark, d, "tag_catalog")
    attributes = [(r["tag"], r["value_type"]) for r in catalog.orderBy("tag").limit(CATALOG + 1).collect()]
    cells = resolved_tags(table(spark, d, "request_tags"), table(spark, d, "dictionaries"), catalog)
    return stitch(cells, "request_id", attributes, ["tag_no", "text"]), attributes


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The filled cells of the wide table."""
    wide, attributes = _wide(spark, d)
    return filled_cells(wide, "request_id", attributes)


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table: one row per request with tags, one typed column per tag of the catalogue."""
    return _wide(spark, d)[0].drop("ordinal")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings that can't be right for the host that sent them."""
    return implausible(table(spark, d, "requests"))


def p3_stuck(spark: SparkSession, d: str) -> DataFrame:
    """Rule (c) alone: runs of equal readings, of hosts with enough requests."""
    flagged, rules = stuck_rows(table(spark, d, "requests"))
    enough = flagged.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.least).select("source")
    names = F.array_compact(F.array(*[F.when(F.col(f"stuck_{f}"), F.lit(f)) for f in rules.fields]))
    return flagged.where(F.col("source") != "").join(enough, "source", "left_semi").select(F.col("record").alias("request_id"), F.explode(names).alias("field_name"))


def p3_impossible(spark: SparkSession, d: str) -> DataFrame:
    """The part of rule (a) that looks at a reading alone."""
    rules = SpikeRules()
    rows = distinct_rows(table(spark, d, "requests"), [rules.record, *rules.fields])
    broken = F.array_compact(F.array(*[F.when(impossible(F.col(f).cast("double")), F.lit(f)) for f in rules.fields]))
    return rows.select(rules.record, F.explode(broken).alias("field_name"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "requests").where(F.col("server_name").isNotNull() & F.col("script_name").isNotNull())
    return distinct_rows(r, ["request_id", "server_name", "script_name", "document_size"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Requests and traffic of every pair of server and script."""
    keys = ["server_name", "script_name"]
    raw = table(spark, d, "requests").where(F.col("server_name").isNotNull() & F.col("script_name").isNotNull())
    plan = plan_fragments(raw.select(*keys), keys)
    return fragment_aggregate(
        _pairs(spark, d), keys, ["request_id"],
        [F.count(F.lit(1)).alias("n"), F.sum("document_size").alias("s")],
        [F.sum("n").alias("req_count"), F.coalesce(F.sum("s"), F.lit(0)).alias("traffic")], plan,
    )


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every request with the count of its pair: the matching side is replicated to the shards of hot pairs only."""
    keys = ["server_name", "script_name"]
    raw = table(spark, d, "requests").where(F.col("server_name").isNotNull() & F.col("script_name").isNotNull())
    plan = plan_fragments(raw.select(*keys), keys)
    pairs = _pairs(spark, d)
    totals = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("req_count"))
    return fragment_join(pairs, totals, keys, ["request_id"], plan=plan).select("request_id", *keys, "document_size", "req_count")


ORACLES = {
    "p3_stuck": """
        with r as (select distinct request_id, ts, hostname, request_time, ru_utime, memory_footprint from requests where hostname <> ''),
        big as (select hostname from r group by hostname having count(*) >= 20),
        v as (select request_id, ts, hostname, unnest(['request_time', 'ru_utime', 'memory_footprint']) field_name, unnest([request_time::double, ru_utime::double, memory_footprint::double]) x from r where hostname in (from big)),
        w as (select *, coalesce(x <> lag(x) over o, true)::int new from v where x is not null window o as (partition by hostname, field_name order by ts, request_id)),
        i as (select *, sum(new) over (partition by hostname, field_name order by ts, request_id) island from w),
        n as (select *, count(*) over (partition by hostname, field_name, island) size from i)
        select request_id, field_name from n where size >= 8 and x <> 0 and not isnan(x)""",
    "p3_impossible": """
        select request_id, field_name from (select request_id, unnest(['request_time', 'ru_utime', 'memory_footprint']) field_name, unnest([request_time::double, ru_utime::double, memory_footprint::double]) x
          from (select distinct request_id, request_time, ru_utime, memory_footprint from requests)) where x < 0 or isnan(x) or x = 'inf'::double""",
    "p4_found": """
        select server_name, script_name, count(*) req_count, coalesce(sum(document_size), 0)::bigint traffic
        from (select distinct request_id, server_name, script_name, document_size from requests)
        where server_name is not null and script_name is not null group by all""",
    "p4_shares": """
        with r as (select distinct request_id, server_name, script_name, document_size from requests where server_name is not null and script_name is not null)
        select request_id, server_name, script_name, document_size, count(*) over (partition by server_name, script_name) req_count from r""",
    "p2_found": r"""
        with t as (select distinct request_id, tag_no, tag_name, tag_value from request_tags),
        d as (select distinct request_id, dictionary from dictionaries),
        w as (select request_id, tag_no, case when tag_name >= 0 then dictionary[tag_name + 1] end n, case when tag_value >= 0 then dictionary[tag_value + 1] end v from t join d using (request_id)),
        k as (select request_id, tag, value_type, arg_min(v, tag_no) v from w join tag_catalog on regexp_replace(lower(trim(n)), '[ _.-]+', '_', 'g') = tag where v is not null group by all),
        s as (select *, trim(v, E' \t') x from k),
        y as (select request_id, tag, case value_type
            when 'string' then v
            when 'bool' then case when lower(x) in ('true', 't', 'yes', 'y', 'on', '1') then 'true' when lower(x) in ('false', 'f', 'no', 'n', 'off', '0') then 'false' end
            when 'int' then case when regexp_full_match(x, '[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+|[0-9]+(_[0-9]+)+)([.]0*)?') then cast(cast(replace(replace(x, ',', ''), '_', '') as decimal(30, 4)) as bigint)::varchar
                 when regexp_full_match(x, '[+-]?[0-9]+e[0-9]+') then cast(cast(x as double) as bigint)::varchar end
            when 'float' then case when regexp_full_match(x, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)? ?%?') then cast(round(cast(replace(regexp_replace(x, ' ?%', ''), ',', '.') as double) * case when x like '%\%' escape '\' then 10 else 1000 end) as bigint)::varchar end
            when 'time' then strftime(case when regexp_full_match(x, '[0-9]{13}') then to_timestamp(x::bigint // 1000) when regexp_full_match(x, '[0-9]{9,11}') then to_timestamp(x::bigint)
                 when regexp_full_match(x, '[0-9-]{10} [0-9:]{8}( UTC)?') then (left(x, 19) || '+00')::timestamptz when regexp_full_match(x, '[0-9-]{10}T[0-9:]{8}.*') then x::timestamptz end at time zone 'UTC', '%Y-%m-%d %H:%M:%S') end cell from s)
        select request_id, tag, cell from y where cell is not null""",
}
