"""Audit reports made of orders and their lines, with faults at known keys; files."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallex.operators import reports, routing
from parallex.plans import units as u
from parallex.plans.queries import query
from parallex.shared import written

# Expressions that Spark and DuckDB read alike: k is an order, n a line, s its supplier.
_REPORT = {
    "mode": "'AUDIT'", "status": "case k % 3 when 0 then 'COMPLETED' when 1 then 'FAILED' else 'REVIEW_REQUIRED' end", "qa": "case k % 4 when 1 then 'FAIL' when 2 then 'NOT_RUN' else 'PASS' end",
    "qa_check": "case k % 6 when 0 then 'FAIL' when 1 then '' else 'PASS' end", "coverage": "case when k % 7 = 0 then 'PARTIAL' else 'FULL' end", "repair": "case k % 5 when 0 then 'NOT_REQUESTED' when 1 then 'VERIFIED' when 2 then 'APPLIED' when 3 then 'PROPOSED' else 'FAILED' end",
    "authorized": "k % 3 <> 0", "trip": "case when k % 9 = 0 then 'FAIL' else 'PASS' end", "trip_check": "case when k % 10 = 0 then 'FAIL' else 'PASS' end", "gaps": "k % 8 = 0", "limited": "k % 5 <> 0", "repairs": "k % 2 = 0",
}
_FINDING = {
    "decision": "case (k + n) % 4 when 0 then 'REPLACE' when 1 then 'KEEP' when 2 then 'REVIEW' else 'PROTECT' end", "confidence": "case when s % 2 = 0 then 'HIGH' else 'MEDIUM' end", "verified": "s % 3 = 0", "disputed": "s % 11 = 0",
    "same": "s % 13 = 0", "protected": "s % 5 = 0", "lost": "s % 17 = 0", "kind": "case when s % 19 = 0 then 'search_snippet' else 'vendor' end", "opened": "s % 7 <> 0", "state": "case when s % 23 = 0 then 'CONFLICTING' else 'CURRENT' end",
    "authority": "case when s % 4 = 0 then 'MEDIUM' else 'HIGH' end", "version": "case when s % 6 = 0 then 'ADJACENT' else 'EXACT' end", "stray": "s % 29 = 0", "failed": "s % 9 = 0", "allowed": "s % 10 = 0",
}
_columns = lambda x: ", ".join(f"{e} as {c}" for c, e in x.items())
_CHECKS = " ".join(
    f"union all select k, null, '{name}_FAILED_CHECK' from r where {check} = 'FAIL' and {status} <> 'FAIL' union all select k, null, '{name}_NOT_RUN_CONTRADICTED' from r where {status} = 'NOT_RUN' and {check} <> '' union all select k, null, '{name}_PASS_WITHOUT_CHECKS' from r where {status} = 'PASS' and {check} <> 'PASS'"
    for name, status, check in (("QA", "qa", "qa_check"), ("ROUND_TRIP", "trip", "trip_check"))
)
_BROKEN = {
    "FULL_COVERAGE_WITH_GAPS": "coverage = 'FULL' and gaps", "GAPS_NOT_NAMED": "coverage <> 'FULL' and not gaps", "REPAIR_NOT_REQUESTED": "repairs and repair = 'NOT_REQUESTED'", "STATUS_CONTRADICTS_CHANGES": "repair in ('NOT_REQUESTED', 'PROPOSED') and applied > 0",
    "APPLIED_INCOMPLETE": "repair in ('APPLIED', 'VERIFIED') and (not authorized or applied = 0)", "VERIFIED_WITHOUT_ROUND_TRIP": "repair = 'VERIFIED' and trip <> 'PASS'", "VERIFIED_WITH_FAILED": "repair = 'VERIFIED' and n_failed > 0",
    "FAILURE_NOT_REPORTED": "(qa = 'FAIL' or repair = 'FAILED' or trip = 'FAIL') and status <> 'FAILED'", "COMPLETED_UNRESOLVED": "status = 'COMPLETED' and (coverage <> 'FULL' or qa <> 'PASS' or unresolved > 0)",
    "COMPLETED_UNFINISHED_REPAIR": "status = 'COMPLETED' and repair not in ('NOT_REQUESTED', 'VERIFIED')", "NO_LIMITATIONS": "status <> 'COMPLETED' and not limited",
}
_SQL = f"""with r0 as (select distinct o_orderkey as k from orders), l as (select l_orderkey as k, l_linenumber as n, min(l_suppkey) as s from lineitem group by 1, 2),
  f0 as (select *, {_columns(_FINDING)} from l where k in (select k from r0)),
  f as (select *, not lost and kind = 'vendor' and opened and state = 'CURRENT' as fair, not lost and kind = 'vendor' and opened and state = 'CURRENT' and authority = 'HIGH' and version = 'EXACT' as direct from f0),
  c0 as (select *, case when stray then 99 else n end as m from f where n <= 2),
  c as (select c0.k, c0.m, c0.failed, c0.allowed, c0.n, f.n as known, f.decision, f.confidence, f.disputed, f.direct, f.same, f.protected from c0 left join f on f.k = c0.k and f.n = c0.m),
  sums as (select k, count(*) filter (not failed) as applied, count(*) filter (failed) as n_failed from c group by k), open as (select k, count(*) filter (decision = 'REVIEW') as unresolved from f group by k),
  r as (select r0.k, {_columns(_REPORT)}, coalesce(applied, 0) as applied, coalesce(n_failed, 0) as n_failed, coalesce(unresolved, 0) as unresolved from r0 left join sums using (k) left join open using (k)),
  a as (select c.*, r.authorized from c join r using (k))
select k as report_id, 'F' || n as key, 'DANGLING_EVIDENCE' as rule from f where lost
union all select k, 'F' || n, 'INADEQUATE_EVIDENCE' from f where (decision = 'REPLACE' or decision = 'KEEP' and verified) and not case when confidence = 'HIGH' then direct else fair end
union all select k, 'F' || n, 'UNRESOLVED_CONFLICT' from f where (decision = 'REPLACE' or decision = 'KEEP' and verified) and (disputed or not lost and state = 'CONFLICTING')
union all select k, 'F' || n, 'REPLACEMENT_UNCHANGED' from f where decision = 'REPLACE' and same
union all select k, 'F' || m, 'DUPLICATE_CHANGE' from c group by k, m having count(*) > 1
union all select distinct k, 'F' || m, rule from (select *, unnest(list_filter([case when known is null then 'CHANGE_WITHOUT_FINDING' end, case when known is not null and not failed and not authorized then 'REPAIR_NOT_AUTHORIZED' end,
  case when known is not null and not failed and not (decision = 'REPLACE' and confidence = 'HIGH' and not disputed and direct) then 'FINDING_NOT_ELIGIBLE' end, case when known is not null and not failed and same then 'CHANGE_DIFFERS' end,
  case when known is not null and not failed and protected and not allowed then 'LITERAL_CHANGE_NOT_AUTHORIZED' end], lambda x: x is not null)) as rule from a)
{_CHECKS} {" ".join(f"union all select k, null, '{rule}' from r where {when}" for rule, when in _BROKEN.items())}"""


@query(_SQL)
def report_contract(spark, d):
    orders = u.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    report = orders.selectExpr("k", *[f"{e} as {c}" for c, e in _REPORT.items()]).selectExpr(
        "k as report_id", "mode", "if(repairs, array('REPAIR'), array()) as secondary_modes", "status", "if(limited, array('x'), array()) as limitations", "array('y') as next_actions",
        "named_struct('status', qa, 'checks', if(qa_check = '', array(), array(qa_check))) as qa", "named_struct('status', coverage, 'inspected', array('a'), 'uninspected', if(gaps, array('u'), array())) as coverage",
        "named_struct('status', repair, 'authorized', authorized, 'output_document', 'o', 'round_trip', named_struct('status', trip, 'checks', array(trip_check))) as repair",
    )
    lines = u.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("s")).join(orders, "k", "left_semi")
    lines = written(lines, "report_lines")  # findings, sources and changes are made of them again and again
    rows = lines.selectExpr("k", "n", "s", *[f"{e} as {c}" for c, e in _FINDING.items()])
    findings = rows.selectExpr("k as report_id", "concat('F', n) as id", "decision", "confidence", "verified as verification_required", "if(disputed, array('c'), array()) as conflicts", "concat('a', n) as original", "concat(if(same, 'a', 'b'), n) as recommendation", "concat('l', n) as location", "protected", "array(if(lost, 'S0', concat('S', n))) as evidence_refs")
    sources = rows.selectExpr("k as report_id", "concat('S', n) as id", "kind as source_type", "opened as source_opened", "state as evidence_state", "authority as authority_match", "'HIGH' as context_match", "version as version_match")
    changes = rows.where("n <= 2").withColumn("m", F.expr("if(stray, 99, n)")).selectExpr("k as report_id", "concat('F', m) as finding_id", "if(failed, 'FAILED', 'APPLIED') as status", "concat('l', m) as location", "concat('a', m) as before", "concat('b', m) as after", "allowed as literal_change_authorized")
    none = spark.createDataFrame([], reports.CANDIDATE)
    return reports.report_violations(report, findings, sources, changes, none)


@query("""with l as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as place, count(*) over (partition by user_id) as n from events),
    d as (select user_id, place, event_id as wanted, case when user_id % 3 = 0 and place = n - 1 then null when user_id % 5 = 0 and place % 7 = 4 then -event_id else event_id end as found from l)
  select user_id as doc_id, min(place)::integer as ordinal, arg_min(wanted, place) as wanted, arg_min(coalesce(found, 0), place) as found from d where found is distinct from wanted group by user_id""")
def sequence_departures(spark, d):
    """Lists of events by user that lack their last one, or hold others."""
    from pyspark.sql.window import Window

    own = Window.partitionBy("user_id").orderBy("event_id")
    rows = u.table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(own) - 1).alias("ordinal"), F.lead("event_id").over(own).isNull().alias("last"))
    wanted = rows.select(F.col("user_id").alias("doc_id"), "ordinal", F.col("event_id").alias("id"))
    other = rows.where(~((F.col("user_id") % 3 == 0) & F.col("last"))).select(F.col("user_id").alias("doc_id"), "ordinal", F.when((F.col("user_id") % 5 == 0) & (F.col("ordinal") % 7 == 4), -F.col("event_id")).otherwise(F.col("event_id")).alias("id"))
    return reports.first_departures(wanted, {"outcomes": other}).select("doc_id", "ordinal", "wanted", F.coalesce("found", F.lit(0)).alias("found"))


#: Content by the remainder of the key, what it shows, and how sure that is.
_CONTENTS = [
    ("unhex('255044462D31')", "pdf", "HIGH"), ("unhex('89504E470D0A1A0A00')", "png", "HIGH"), ("unhex('4D4D002A00')", "tiff", "HIGH"), ("unhex('424D00')", "bmp", "HIGH"), ("unhex('D0CF11E0A1B11AE1')", "ole", "HIGH"),
    ("encode(concat('\\n <!DOCTYPE HTML><p>', s_name), 'utf-8')", "html", "HIGH"), ("encode(concat('<a b=\\'1\\'>', s_name, '</a>'), 'utf-8')", "xml", "MEDIUM"), ("encode(concat('{\"a\": \"', s_name, '\"}'), 'utf-8')", "json", "HIGH"),
    ("encode(concat('k;v\\n', s_suppkey, ';', s_name, '\\n1;2\\n'), 'utf-8')", "csv", "MEDIUM"), ("encode(concat('# ', s_name, '\\n\\ntext'), 'utf-8')", "md", "MEDIUM"), ("encode(s_name, 'utf-8')", "txt", "LOW"), ("unhex('0001020300')", "unknown", "NONE"),
]
_SUFFIXES = ["pdf", "png", "tif", "doc", "xls", "htm", "xml", "none", "csv", "markdown", "JSON"]


@query(f"""with f as (select s_suppkey as k, ({[x for _, x, _ in _CONTENTS]})[s_suppkey % 12 + 1] as detected, ({[x for _, _, x in _CONTENTS]})[s_suppkey % 12 + 1] as sure,
    ([{", ".join("NULL" if x == "none" else repr({"tif": "tiff", "htm": "html", "markdown": "md"}.get(x.lower(), x.lower())) for x in _SUFFIXES)}])[s_suppkey % 11 + 1] as declared from supplier),
  s as (select *, case when detected = 'ole' and declared in ('doc', 'xls') then 'CONTAINER_MATCH' when detected = 'unknown' and declared is not null then 'EXTENSION_ONLY' when detected = 'unknown' then 'UNKNOWN'
    when declared is null then 'CONTENT_ONLY' when declared = detected then 'MATCH' else 'CONFLICT' end as status from f)
  select k, coalesce(declared, '') as declared, detected, case when status in ('CONTAINER_MATCH', 'EXTENSION_ONLY') then declared else detected end as effective, status,
    case status when 'CONTAINER_MATCH' then 'MEDIUM' when 'EXTENSION_ONLY' then 'LOW' else sure end as confidence,
    concat_ws('|', case when detected = 'ole' then 'LEGACY_CONTAINER|SUBTYPE_UNVERIFIED' end, case status when 'EXTENSION_ONLY' then 'EXTENSION_ONLY_UNVERIFIED' when 'UNKNOWN' then 'UNKNOWN_FORMAT' when 'CONFLICT' then 'EXTENSION_CONTENT_CONFLICT' end) as risks from s""")
def format_probe(spark, d):
    """Files of all kinds under right and wrong names."""
    content = "case " + " ".join(f"when s_suppkey % 12 = {k} then {e}" for k, (e, _, _) in enumerate(_CONTENTS)) + " end"
    suffix = f"element_at(array({', '.join(map(repr, _SUFFIXES))}), cast(s_suppkey % 11 + 1 as int))"
    files = u.table(spark, d, "supplier").selectExpr("s_suppkey as k", f"concat('f', s_suppkey, '.', {suffix}) as path", f"{content} as content")
    found = routing.probed(files).join(files.select("path", "k"), "path")
    return found.select("k", F.coalesce("declared", F.lit("")).alias("declared"), "detected", "effective", "status", "confidence", F.array_join("risks", "|").alias("risks"))
