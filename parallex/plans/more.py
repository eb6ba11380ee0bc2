"""Queries of the smaller operators: sources, sinks, counts, contracts, composites."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parallex.functions import literals, text
from parallex.operators import align, batching, memory, review, routing, signals, trail, validation, workflow
from parallex.plans import packages
from parallex.plans import units as u
from parallex.plans.queries import query
from parallex.shared import shared_dir
from parallex.sources import records, segments

_CONTEXT = "named_struct('vendor', cast(null as string), 'product', cast(null as string), 'version', cast(null as string), 'domain', cast(null as string), 'text_role', 'PROSE', 'project_id', 'p')"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------

@query(r"select doc_id, place + 1 as place, line as text from (" + packages._LINES_SQL + r") where regexp_matches(line, '\S')")
def office_segments(spark, d):
    """Paragraphs of documents as packages."""
    files = packages._documents(spark, d)[0].select(F.concat("path", F.lit(".docx")).alias("path"), F.length("content").cast("long").alias("length"), "content")
    found, _ = segments.office(files)
    return found.select(F.substring_index("doc_id", ".", 1).cast("long").alias("doc_id"), (F.substring_index("location", "=", -1).cast("int") + 1).alias("place"), "text")


@query("select s_suppkey as id, case s_suppkey % 4 when 0 then 'INVALID_NAME' when 1 then 'INVALID_BASE64' else '' end as error, case when s_suppkey % 4 <> 1 then strlen(s_name) end as length from supplier")
def uploads(spark, d):
    rows = u.table(spark, d, "supplier").selectExpr("s_suppkey", "if(s_suppkey % 4 = 0, concat('a/', s_suppkey), concat('f', s_suppkey)) as name", "if(s_suppkey % 4 = 1, '***', base64(encode(s_name, 'utf-8'))) as data")
    out = segments.upload(rows.select("name", "data"))
    return out.select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("id"), F.coalesce("error", F.lit("")).alias("error"), "length")


_TMX = "concat('<tmx><body><tu><tuv xml:lang=\"EN\"><seg>', s_name, '</seg></tuv><tuv lang=\"fr\"><seg>', if(s_suppkey % 3 = 0, 'a<ph/>b', 'cible'), '</seg></tuv></tu><tu><tuv xml:lang=\"en\"><seg>alone</seg></tuv></tu></body></tmx>')"


@query("select s_suppkey::varchar as doc_id, 1::bigint as total, (case when s_suppkey % 3 = 0 then 0 else 1 end)::bigint as review, (case when s_suppkey % 3 = 0 then 1 else 0 end)::bigint as unsupported from supplier")
def tmx_import_counts(spark, d):
    files = u.table(spark, d, "supplier").selectExpr("cast(s_suppkey as string) as path", f"encode({_TMX}, 'utf-8') as content")
    return segments.tmx_counts(segments.tmx(files, "en", "fr"))


@query("select o_orderkey as ordinal, 'U' || o_orderkey as id, o_orderstatus as source, case when o_orderkey % 2 = 0 then 'ALIGNED' else 'SPLIT' end as alignment from orders")
def unit_files(spark, d):
    """Units written as JSON lines and read with their defaults."""
    path = _folder(spark, "units")
    rows = u.table(spark, d, "orders").selectExpr("concat('U', o_orderkey) as id", "o_orderstatus as source", "if(o_orderkey % 2 = 0, null, 'SPLIT') as alignment")
    records.write_table(rows, path)
    out = records.review_units(records.read_units(spark, path))
    return out.select(F.substr("id", F.lit(2)).cast("long").alias("ordinal"), "id", "source", "alignment")


@query("select c_custkey as id, case c_custkey % 3 when 0 then '''=' || c_name when 1 then c_name else '' end as cell from customer")
def csv_export(spark, d):
    """Cells that a spreadsheet would run are neutral after a round trip."""
    path = _folder(spark, "cells")
    rows = u.table(spark, d, "customer").selectExpr("c_custkey as id", "case c_custkey % 3 when 0 then concat('=', c_name) when 1 then c_name else '' end as cell")
    records.write_table(rows, path, "csv")
    back = spark.read.csv(path, header=True, schema="id long, cell string", escape='"')
    return back.select("id", F.coalesce("cell", F.lit("")).alias("cell"))


@query("select p_partkey as ordinal, 'P' || p_partkey as id, 'TRANSLATE' as behavior, p_name as term, 2::bigint as targets from part where p_partkey % 2 = 0")
def glossary_document(spark, d):
    """Entries written as JSON documents of two hundred keys, read back."""
    rows = u.table(spark, d, "part").where("p_partkey % 2 = 0").selectExpr(
        "floor(p_partkey / 200) as part", "named_struct('id', concat('P', p_partkey), 'behavior', 'TRANSLATE', 'approval', 'PROJECT_APPROVED', 'source', named_struct('language', 'en', 'term', p_name), 'targets', array(named_struct('language', 'fr', 'term', 'a', 'status', 'PREFERRED'), named_struct('language', 'fr', 'term', 'b', 'status', 'FORBIDDEN'))) as e"
    )
    path = _folder(spark, "glossaries")
    rows.groupBy("part").agg(F.collect_list("e").alias("entries")).repartition("part").write.partitionBy("part").json(path)
    back = records.read_glossary_json(spark, path)
    return back.select(F.substr("id", F.lit(2)).cast("long").alias("ordinal"), "id", "behavior", F.col("source.term").alias("term"), F.size("targets").cast("long").alias("targets"))


# --- texts and units ------------------------------------------------------------------------

@query("select c_custkey as id, c_custkey % 3 = 0 as abusive, c_custkey % 5 = 0 as typo from customer")
def text_warnings(spark, d):
    rows = u.table(spark, d, "customer").selectExpr("c_custkey as id", "if(c_custkey % 3 = 0, 'You IDIOT!', 'idiotic name') as a", "if(c_custkey % 5 = 0, '请操用户手册', '用户') as b")
    return rows.select("id", literals.abusive(F.col("a")).alias("abusive"), literals.source_typo(F.col("b")).alias("typo"))


@query("select p_partkey as id, lower(p_name) || ' strasse' as folded from part")
def folded_texts(spark, d):
    rows = u.table(spark, d, "part").selectExpr("p_partkey as id", "concat('  ', upper(p_name), '\\n\\t Straße ') as t")
    return rows.select("id", text.collapsed(F.col("t")).alias("folded"))


@query("select count(*) as extracted, (sum(case l_linenumber when 6 then 2 when 1 then 0 when 2 then 0 else 1 end))::bigint as protected_literals, (select sum(n - 1)::bigint from (select count(*) as n from (" + """
  select case l_linenumber when 1 then 'Wait ' || l_quantity::int || ' ms before retry' when 2 then 'Use port ' || l_partkey || ' here' when 3 then 'Needs version ' || l_linenumber || '.' || l_suppkey % 10 || ' now' when 4 then 'Put {p' || l_partkey || '} twice {p' || l_partkey || '} here'
    when 5 then 'See https://ex.example/d/' || l_partkey || '.' when 6 then 'Open /var/log/p' || l_partkey || ' and r' || l_suppkey || '.csv first' else 'Run with --opt' || l_suppkey || ' now' end as s from lineitem) group by s)) as repeated,
  count(*) filter (l_linenumber = 2 and l_partkey % 4 = 0) as memory_hits from lineitem""")
def local_precheck(spark, d):
    rows = u.literal_units(spark, d)
    context = F.expr(_CONTEXT)
    parts = u.table(spark, d, "lineitem").where("l_linenumber = 2 and l_partkey % 4 = 0").selectExpr("concat('Use port ', l_partkey, ' here') as source", "'en' as source_language", "'fr' as target_language", f"{_CONTEXT} as context").distinct()
    stored = memory.canonical_scope(parts).select("scope_key", "source_language", "target_language", "source", F.lit("PREFERRED").alias("kind"), F.lit("t").alias("target"))
    numbered = rows.select(F.monotonically_increasing_id().alias("ordinal"), "location", F.col("source").alias("text"))
    return workflow.precheck(numbered, stored, "en", "fr", context).select("extracted", "protected_literals", "repeated", "memory_hits")


@query("select 'O' || o_orderkey as unit_id, 'CLI_OPTION_INTEGRITY' as check_id from orders where o_orderkey % 3 = 0")
def post_translation_issues(spark, d):
    rows = u.table(spark, d, "orders").selectExpr("concat('O', o_orderkey) as id", "o_orderkey as ordinal", "concat('Run --opt', o_custkey) as source", "'' as target", "'en' as source_language", "'fr' as target_language", "'x' as location", f"{_CONTEXT} as context", "o_orderkey", "o_custkey")
    proposals = rows.select("id", F.expr("if(o_orderkey % 3 = 0, 'Lancer', concat('Lancer --opt', o_custkey))").alias("suggested_target"))
    return workflow.post_translation(rows.drop("o_orderkey", "o_custkey"), proposals).select(F.col("id").alias("unit_id"), "check_id")


# --- review -----------------------------------------------------------------------------------

@query("select o_orderkey as unit_id, case when o_orderkey % 3 = 0 then 'ERROR' else 'WARNING' end as severity, o_orderkey % 6 = 0 as blocking from orders")
def finding_issues(spark, d):
    rows = u.table(spark, d, "orders").selectExpr("o_orderkey as unit_id", "'OMISSION' as classification", "if(o_orderkey % 3 = 0, 'HIGH', 'LOW') as severity", "if(o_orderkey % 2 = 0, 'REPLACE', 'KEEP') as decision", "'r' as recommendation")
    return review.finding_issues(rows).select("unit_id", "severity", "blocking")


@query("select o_orderkey as unit_id, case when o_orderkey % 4 = 0 then 'approved' when o_orderkey % 4 = 1 then 'current' when o_orderkey % 4 = 2 then 'suggested' else 'current' end as draft from orders")
def draft_targets(spark, d):
    rows = u.table(spark, d, "orders").selectExpr("o_orderkey", "element_at(array('USER_EDITED', 'BLOCKED', 'UNREVIEWED', 'UNREVIEWED'), cast(o_orderkey % 4 + 1 as int)) as status", "if(o_orderkey % 4 = 3, ' ', 'suggested') as suggested")
    return rows.select(F.col("o_orderkey").alias("unit_id"), review.draft_target(F.col("status"), F.lit("approved"), F.col("suggested"), F.lit("current"), F.lit("BILINGUAL_REVIEW")).alias("draft"))


@query("select p_partkey as unit_id, 'cur' as approved_target, 1 as revision from part")
def bulk_decisions(spark, d):
    p = u.table(spark, d, "part")
    units = p.selectExpr("p_partkey as id", "'sug' as suggested_target", "'cur' as current_target")
    asked = p.selectExpr("p_partkey as unit_id", "'KEEP_CURRENT' as status", "'' as approved_target", "'' as waiver_reason")
    none = p.limit(0).selectExpr("p_partkey as unit_id", "'' as approved_target", "0 as revision", "'' as recheck_status")
    done, _ = review.bulk(asked, units, none)
    return done.select("unit_id", "approved_target", "revision")


@query("select distinct 'language' as kind, case when o_orderkey % 2 = 0 then 'fr' else 'de' end as value from orders union all select distinct 'location', o_orderpriority from orders")
def filter_values(spark, d):
    return review.filter_values(u.table(spark, d, "orders").selectExpr("if(o_orderkey % 2 = 0, 'fr', 'de') as target_language", "concat(o_orderpriority, ':', o_orderkey) as location"))


# --- signals, routing, contracts -----------------------------------------------------------------

@query("select p_partkey as id, case when p_partkey % 2 = 0 then 'cell' else 'title' end as signal from part where p_partkey % 3 <> 2")
def context_signals(spark, d):
    rows = u.table(spark, d, "part").selectExpr("p_partkey as id", "named_struct('text_role', case when p_partkey % 3 = 2 then 'PROSE' when p_partkey % 2 = 0 then 'TABLE' else 'HEADING' end) as context")
    return signals.context_signals(rows, spark.createDataFrame([("TABLE", "cell", "A"), ("HEADING", "title", "B")], "text_role string, signal string, detector_id string")).select("id", "signal")


@query("select o_orderkey as id, 'b' as signal from orders where o_orderkey % 2 = 0")
def unmatched_signals(spark, d):
    rows = u.table(spark, d, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 2 = 0, array('a', 'b'), array('a')) as signals")
    return signals.unmatched_signals(rows, rows.selectExpr("id", "array('a') as matched"))


@query("select o_orderkey as id from orders where o_orderkey % 4 < 3 and o_orderkey % 4 > 0")
def span_errors(spark, d):
    rows = u.table(spark, d, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 4 = 1, null, 3) as start", "if(o_orderkey % 4 = 2, 3, 9) as stop")
    return signals.span_errors(rows).select("id")


@query("""select key, rule from (select s_suppkey, unnest(list_filter([case when s_suppkey % 2 = 0 then 'UNKNOWN_MATCH' end, case when s_suppkey % 3 = 0 then 'EMPTY_VALUE' end, case when s_suppkey % 5 = 0 then 'UNKNOWN_SIGNAL' end], lambda x: x is not null)) as rule, 'D' || s_suppkey as key from supplier)""")
def rule_violations(spark, d):
    rows = u.table(spark, d, "supplier").selectExpr("concat('D', s_suppkey) as detector_id", "if(s_suppkey % 2 = 0, 'REGEX', 'TOKEN') as match", "if(s_suppkey % 3 = 0, ' ', 'v') as value", "if(s_suppkey % 5 = 0, 'odd', 'must') as signal")
    return validation.rule_violations(rows, spark.createDataFrame([("must",)], "signal string"))


@query("select 'x' || s_suppkey as key, 'UNKNOWN_FORMAT' as rule from supplier where s_suppkey % 3 = 0 union all select 'f' || s_suppkey, 'UNKNOWN_BACKEND' from supplier where s_suppkey % 4 = 0")
def registry_violations(spark, d):
    s = u.table(spark, d, "supplier")
    extensions = s.selectExpr("concat('x', s_suppkey) as extension", "if(s_suppkey % 3 = 0, 'none', concat('f', s_suppkey)) as format")
    formats = s.selectExpr("concat('f', s_suppkey) as format", "array('b', if(s_suppkey % 4 = 0, 'none', 'b')) as backends")
    return validation.registry_violations(extensions, formats, spark.createDataFrame([("b",)], "backend string"))


@query("select o_orderkey::varchar as key, 'MACHINE_APPROVED' as rule from orders where o_orderkey % 4 = 0 union all select o_orderkey::varchar, 'MACHINE_COMPLETED' from orders where o_orderkey % 6 = 0")
def machine_violations(spark, d):
    rows = u.table(spark, d, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 4 = 0, 'x', null) as approved_target", "o_orderkey % 6 = 0 as completion_allowed")
    return validation.machine_violations(rows, "id")


@query("select 'b' || s_suppkey as backend, case when s_suppkey % 3 = 0 then 'DECLARED' when s_suppkey % 2 = 0 then 'BUILTIN' else 'PROBED' end as origin, case when s_suppkey % 3 = 0 then s_suppkey % 9 = 0 when s_suppkey % 2 = 0 then true else s_suppkey % 5 = 0 end as available from supplier")
def capabilities(spark, d):
    s = u.table(spark, d, "supplier")
    backends = s.selectExpr("concat('b', s_suppkey) as backend", "s_suppkey % 2 = 0 as builtin", "s_suppkey % 5 = 0 as probed")
    return routing.capabilities(backends, s.where("s_suppkey % 3 = 0").selectExpr("concat('b', s_suppkey) as backend", "s_suppkey % 9 = 0 as available"))


@query("select c_custkey as task_id, case when c_custkey % 2 = 0 then 'A1|A2|A3' else 'A2' end as sections from customer")
def example_sections(spark, d):
    tasks = u.table(spark, d, "customer").selectExpr("c_custkey as task_id", "if(c_custkey % 2 = 0, array('a', 'b', 'b2', 'c', 'd'), array('b', 'none')) as risk_tags")
    found = routing.examples(tasks, spark.createDataFrame([("a", "A1"), ("b", "A2"), ("b2", "A2"), ("c", "A3"), ("d", "A4")], "risk string, section string"))
    return found.select("task_id", F.array_join("sections", "|").alias("sections"))


# --- memory, evidence, runs ------------------------------------------------------------------------

@query("select o_orderkey as id from orders where o_orderkey % 3 <> 0 order by o_orderdate desc, o_orderkey desc limit 100")
def memory_latest(spark, d):
    """The newest hundred memories after some were forgotten."""
    rows = u.table(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderdate as updated_at")
    return memory.latest(memory.forget(rows, rows.where("id % 3 = 0")), 100).select("id")


@query("select p_partkey as id, case when p_partkey % 3 = 0 then 'new' else 'old' end as target, p_partkey % 6 = 1 as blocked from part")
def memory_edited(spark, d):
    rows = u.table(spark, d, "part").selectExpr("p_partkey as id", "'PREFERRED' as kind", "'old' as target", "'s' as scope_key", "'en' as source_language", "'fr' as target_language", "'PROSE' as text_role", "cast(p_partkey as string) as source_hash")
    rejected = rows.where("id % 6 = 1").select((-F.col("id")).alias("id"), F.lit("REJECTED").alias("kind"), F.lit("new").alias("target"), "scope_key", "source_language", "target_language", "text_role", "source_hash")
    changes = rows.where("id % 3 = 0 or id % 6 = 1").selectExpr("id", "'new' as target")
    out = memory.edited(rows.unionByName(rejected), changes).where("kind = 'PREFERRED'")
    return out.select("id", "target", F.coalesce("blocked", F.lit(False)).alias("blocked"))


@query("select p_partkey as id, 'LEGACY_UNSCOPED' as scope_kind from part")
def memory_migrated(spark, d):
    return memory.migrated(u.table(spark, d, "part").selectExpr("p_partkey as id", "p_name as source")).select("id", "scope_kind")


@query("select 'CURRENT' as state, (select count(*) from documents where doc_id % 4 <> 0) as n union all select 'STALE', (select count(*) from documents where doc_id % 4 = 0) union all select 'UNVERIFIED', 0 union all select 'REJECTED', 0")
def evidence_state_counts(spark, d):
    rows = u.table(spark, d, "documents").selectExpr("if(doc_id % 4 = 0, 'STALE', 'CURRENT') as current_state")
    return trail.evidence_counts(rows, spark.createDataFrame([(s,) for s in trail.STATES], "state string"))


@query("select 'E' || doc_id as evidence_id from documents where doc_id % 3 = 0")
def evidence_conflicts(spark, d):
    """Evidence whose id an older record with another source has."""
    rows = u.table(spark, d, "documents").selectExpr("doc_id", "concat('E', doc_id) as evidence_id", "'{}' as scope", "cast(doc_id as string) as source_sha256")
    old, _ = trail.record_evidence(spark.createDataFrame([], "cache_id string, evidence_id string"), rows)
    changed = rows.withColumn("source_sha256", F.expr("if(doc_id % 3 = 0, 'changed', source_sha256)"))
    return trail.record_evidence(old.select("cache_id", "evidence_id"), changed)[1].select("evidence_id")


@query("select doc_id::varchar as path, case when doc_id % 6 = 0 then 'GONE' else 'CHANGED' end as state from documents where doc_id % 6 = 0 or doc_id % 4 = 1")
def changed_sources(spark, d):
    rows = u.table(spark, d, "documents").selectExpr("doc_id", "cast(doc_id as string) as path", "encode(coalesce(text, ''), 'utf-8') as content")
    manifest = rows.select("path", F.sha2("content", 256).alias("sha256"))
    return workflow.changed_sources(manifest, rows.where("doc_id % 6 <> 0").selectExpr("path", "if(doc_id % 4 = 1, concat(content, encode('!', 'utf-8')), content) as content"))


@query("select o_orderkey as doc_id, 'l' as location, 'missing' as side from orders where o_orderkey % 5 = 0 union all select o_orderkey, 'l', 'unexpected' from orders where o_orderkey % 5 = 0")
def round_trip_differences(spark, d):
    rows = u.table(spark, d, "orders").selectExpr("o_orderkey as doc_id", "'l' as location", "o_orderstatus as text")
    edits = rows.where("doc_id % 3 = 0").select("doc_id", "location", F.lit("new").alias("text"))
    after = rows.select("doc_id", "location", F.expr("case when doc_id % 5 = 0 then 'other' when doc_id % 3 = 0 then 'new' else text end").alias("text"))
    return align.round_trip_differences(rows, after, edits).select("doc_id", "location", "side")


# --- service ---------------------------------------------------------------------------------------

@query("""select p_brand as doc_id, count(*) as n, (max(b))::integer as batches from (select p_brand, ((row_number() over (partition by p_brand order by p_partkey) - 1) // 20) + 1 as b from part) group by p_brand""")
def request_batches(spark, d):
    """Units of short texts by brand: batches are full at twenty units, and each is
    one request."""
    rows = u.table(spark, d, "part").selectExpr("p_brand as doc_id", "p_partkey as ordinal", "concat('P', p_partkey) as id", "p_name as source", f"{_CONTEXT} as context")
    asked = batching.requests(batching.batches(rows))
    sizes = asked.select("doc_id", "batch", F.size(F.from_json("request", "units array<struct<id:string>>")["units"]).alias("n"))
    return sizes.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("batch").alias("batches"))


@query("select o_orderkey as unit_id, unnest(case o_orderkey % 4 when 0 then ['NO_FINDING_WITH_DETAIL'] when 1 then ['FINDING_WITHOUT_CLASS'] when 2 then ['UNKNOWN_CLASS'] else [] end) as error from orders")
def adjudication_errors(spark, d):
    rows = u.table(spark, d, "orders").selectExpr("o_orderkey as unit_id", "if(o_orderkey % 4 = 0, 'NO_FINDING', 'FINDING') as outcome", "element_at(array('STYLE', null, 'ODD', 'AMBIGUITY'), cast(o_orderkey % 4 + 1 as int)) as classification", "cast(null as string) as next_action")
    return batching.adjudication_errors(rows)


@query("select l_orderkey as doc_id, 'SF' || lpad((row_number() over (partition by l_orderkey order by n))::varchar, 4, '0') as finding_id, n as unit_id, 'AMBIGUOUS_HIGH_RISK' as classification from (select distinct l_orderkey, l_linenumber as n from lineitem) where n % 2 = 1")
def semantic_findings(spark, d):
    rows = u.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().selectExpr("l_orderkey as doc_id", "l_linenumber as ordinal", "l_linenumber as unit_id", "if(l_linenumber % 2 = 1, 'FINDING', 'NO_FINDING') as outcome", "'AMBIGUITY' as classification", "'' as next_action")
    return batching.findings(rows).select("doc_id", "finding_id", "unit_id", "classification")
