"""More queries: contracts, sinks, alignment and trail, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallex.operators import align, glossary, memory, multiset, review, trail, validation
from parallex.plans import units as u
from parallex.plans.queries import query
from parallex.sources import records


@query("""select 'O' || o_orderkey as key, 'NO_TARGET' as rule from orders where o_orderkey % 5 = 1 union all select '-' || o_orderkey, 'BAD_ID' from orders where o_orderkey % 5 = 2
  union all select 'O' || o_orderkey, 'AMBIGUOUS_ALIGNMENT' from orders where o_orderkey % 5 = 3 union all select 'X', 'DUPLICATE_ID' where (select count(*) from orders where o_orderkey % 5 = 4) > 1""")
def unit_violations(spark, d):
    return validation.unit_violations(u.table(spark, d, "orders").selectExpr("case o_orderkey % 5 when 2 then concat('-', o_orderkey) when 4 then 'X' else concat('O', o_orderkey) end as id", "'s' as source", "if(o_orderkey % 5 = 1, null, 't') as target", "if(o_orderkey % 5 = 3, 'AMBIGUOUS', 'ALIGNED') as alignment"))


@query("select p_partkey::varchar as key, unnest(list_filter([case when p_partkey % 3 = 0 then 'BLANK_SOURCE' end, case when p_partkey % 4 = 0 then 'TARGET_NOT_EMPTY' end, case when p_partkey % 5 = 0 then 'NO_CONCRETE_ROLE' end], lambda x: x is not null)) as rule from part")
def translation_violations(spark, d):
    return validation.translation_violations(u.table(spark, d, "part").selectExpr("p_partkey as id", "if(p_partkey % 3 = 0, ' ', 's') as source", "if(p_partkey % 4 = 0, 't', '') as target", "named_struct('text_role', if(p_partkey % 5 = 0, 'ANY', 'PROSE')) as context"))


@query("select doc_id::varchar as key, 'BAD_TARGET_LANGUAGE' as rule from documents where doc_id % 2 = 0 union all select doc_id::varchar, 'SAME_LANGUAGE' from documents where doc_id % 2 = 1 and lang = 'en'")
def language_violations(spark, d):
    return validation.language_violations(u.table(spark, d, "documents").selectExpr("doc_id", "lang as source_language", "if(doc_id % 2 = 0, 'e_n', 'EN') as target_language"), "doc_id")


@query("select o_orderkey::varchar as key, case o_orderstatus when 'F' then 'PASS_INCOMPLETE' when 'O' then 'PARTIAL_EMPTY' else 'FAIL_WITH_SEGMENTS' end as rule from orders where (o_orderstatus = 'F' and o_orderkey % 2 = 0) or (o_orderstatus = 'O' and o_orderkey % 3 = 0) or (o_orderstatus not in ('F', 'O') and o_orderkey % 3 <> 0)")
def ingest_violations(spark, d):
    return validation.ingest_violations(u.table(spark, d, "orders").selectExpr("o_orderkey as id", "case o_orderstatus when 'F' then 'PASS' when 'O' then 'PARTIAL' else 'FAIL' end as status", "o_orderkey % 3 as segments", "o_orderkey % 3 as expected", "if(o_orderkey % 2 = 0, 1, 0) as errors"))


@query("""select 'F' || c_custkey as key, 'UNKNOWN_SOURCE' as rule from customer where c_custkey % 5 = 0 union all select 'F' || c_custkey, 'INADEQUATE_EVIDENCE' from customer where c_custkey % 2 = 0 and (c_custkey % 5 = 0 or c_nationkey % 2 = 1)
  union all select 'K' || c_custkey, 'CHANGE_NOT_REPLACE' from customer where c_custkey % 3 <> 0 union all select 'K' || c_custkey, 'CHANGE_NOT_AUTHORIZED' from customer where c_custkey % 7 = 0""")
def report_violations(spark, d):
    c = u.table(spark, d, "customer")
    findings = c.selectExpr("concat('F', c_custkey) as id", "if(c_custkey % 2 = 0, 'CONFIRMED', 'OPEN') as status", "if(c_custkey % 3 = 0, 'REPLACE', 'REVIEW') as decision", "array(if(c_custkey % 5 = 0, 'none', concat('S', c_nationkey))) as source_refs")
    sources = u.table(spark, d, "nation").selectExpr("concat('S', n_nationkey) as id", "n_nationkey % 2 = 0 as opened", "true as authority_match", "true as version_match")
    return validation.report_violations(findings, sources, c.selectExpr("concat('K', c_custkey) as id", "concat('F', c_custkey) as finding_id", "c_custkey % 7 <> 0 as authorized"))


@query("""select s_suppkey::varchar as key, 'UNKNOWN_ISSUE' as rule from supplier where s_suppkey % 4 = 0 union all select 'I' || s_suppkey, 'ISSUE_WITHOUT_UNIT' from supplier where s_suppkey % 3 = 0
  union all select s_suppkey::varchar, 'UNKNOWN_EVIDENCE' from supplier where s_suppkey % 5 = 0 union all select s_suppkey::varchar, 'NO_DECISION' from supplier where s_suppkey % 6 = 0""")
def bundle_violations(spark, d):
    s = u.table(spark, d, "supplier")
    units = s.selectExpr("s_suppkey as id", "array(if(s_suppkey % 4 = 0, 'gone', concat('I', s_suppkey))) as qa_issue_refs", "array(if(s_suppkey % 5 = 0, 'gone', 'E')) as evidence_refs")
    issues = s.selectExpr("concat('I', s_suppkey) as id", "if(s_suppkey % 3 = 0, -1L, s_suppkey) as unit_id")
    return validation.bundle_violations(units, issues, spark.createDataFrame([("E",)], "id string"), s.where("s_suppkey % 6 <> 0").selectExpr("s_suppkey as unit_id"))


@query("select p_partkey::varchar as key, unnest(list_filter([case when p_partkey % 4 = 0 then 'RISK_DRIFT' end, case when p_partkey % 3 = 0 then 'TRANSFORMATION_NOT_ALLOWED' end, case when p_partkey % 5 = 0 then 'UNKNOWN_DIMENSION' end], lambda x: x is not null)) as rule from part where p_partkey % 7 <> 0 union all select p_partkey::varchar, 'UNKNOWN_TECHNIQUE' from part where p_partkey % 7 = 0")
def technique_violations(spark, d):
    rows = u.table(spark, d, "part").selectExpr("p_partkey as id", "if(p_partkey % 7 = 0, 'Q', 'T') as technique_id", "if(p_partkey % 4 = 0, 'LOW', 'HIGH') as risk", "array('SPLIT', if(p_partkey % 3 = 0, 'OTHER', 'MERGE')) as transformations", "array(if(p_partkey % 5 = 0, 'MOOD', 'STYLE')) as dimensions")
    return validation.technique_violations(rows, spark.createDataFrame([("T", "HIGH", ["SPLIT"], ["MERGE"], ["STYLE"])], "technique_id string, risk string, allowed array<string>, restricted array<string>, dimensions array<string>"))


@query("select o_orderkey::varchar as key, 'REPORT_NOT_BOUND' as rule from orders where o_orderkey % 4 = 0 union all select o_orderkey::varchar, 'REPLACE_WITHOUT_SUGGESTION' from orders where o_orderkey % 6 = 0 union all select o_orderkey::varchar, 'UNKNOWN_TERM' from orders where o_orderkey % 9 = 0")
def delivery_violations(spark, d):
    items = u.table(spark, d, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 2 = 0, 'REPLACE', 'KEEP') as decision", "if(o_orderkey % 3 = 0, ' ', 'x') as suggested_target", "'R' as report_id", "if(o_orderkey % 4 = 0, 'old', 'new') as report_sha256", "array(if(o_orderkey % 9 = 0, 'T9', 'T1')) as term_refs")
    return validation.delivery_violations(items, spark.createDataFrame([("R", "new")], "id string, sha256 string"), spark.createDataFrame([("T1",)], "id string"))


@query("select c_custkey, c_mktsegment || case when c_custkey % 10 = 0 then '!' else '' end as m, 'recomputed' as side from customer where c_custkey % 10 = 0 union all select c_custkey, c_mktsegment, 'stored' from customer where c_custkey % 10 = 0")
def artifact_drift(spark, d):
    c = u.table(spark, d, "customer")
    return validation.drift(c.selectExpr("c_custkey", "c_mktsegment as m"), c.selectExpr("c_custkey", "if(c_custkey % 10 = 0, concat(c_mktsegment, '!'), c_mktsegment) as m"))


@query("select n_nationkey as id, case when n_nationkey % 3 = 0 then 'missing' else 'extra' end as state from nation where n_nationkey % 3 <> 1")
def id_coverage(spark, d):
    n = u.table(spark, d, "nation").selectExpr("n_nationkey as id")
    return multiset.coverage(n.where("id % 3 < 2"), n.where("id % 3 > 0"), "id")


@query("select s_suppkey as finding_id, s_suppkey as unit_id from supplier where s_suppkey % 3 < 2")
def finding_units(spark, d):
    s = u.table(spark, d, "supplier")
    units = s.selectExpr("s_suppkey as id", "concat('line:', s_suppkey) as location", "concat('<', s_name, '>') as source", "'' as current_target")
    return review.map_findings(s.selectExpr("s_suppkey as finding_id", "case s_suppkey % 3 when 0 then concat('line:', s_suppkey) else 'none' end as location", "if(s_suppkey % 3 = 1, s_name, 'Supplier') as original"), units)


@query("select c_custkey as id, 'Buy ' || c_nationkey || ' or y' as suggested_target from customer where c_custkey % 2 = 0")
def merged_suggestions(spark, d):
    c = u.table(spark, d, "customer")
    units = c.selectExpr("c_custkey as id", "concat('Buy x', c_nationkey, ' and y') as current_target")
    found = c.where("c_custkey % 2 = 0").selectExpr("c_custkey as unit_id", "'REPLACE' as decision", "inline(array(struct(1, concat('x', c_nationkey), cast(c_nationkey as string)), struct(2, 'and', 'or'), struct(3, 'or', 'nor'), struct(4, 'nowhere', 'z')))").toDF("unit_id", "decision", "ordinal", "original", "recommendation")
    return review.suggestions(units, found.where("ordinal <> 3"))


@query("select p_partkey as unit_id, case when p_partkey % 4 = 0 then 'OTHER_SESSION' else 'MISSING' end as error from part where p_partkey % 4 = 0 or p_partkey % 4 = 1")
def import_errors(spark, d):
    p = u.table(spark, d, "part")
    return review.import_errors(p.where("p_partkey % 4 <> 1").selectExpr("p_partkey as unit_id", "if(p_partkey % 4 = 0, 's2', 's1') as session_id"), p.selectExpr("p_partkey as id"), "s1")


@query("select s_suppkey as id, 'a|b' as qa_issue_refs, case when s_suppkey % 2 = 0 then 'e1' else '' end as evidence_refs, 'X|Y' as labels from supplier")
def session_units(spark, d):
    s = u.table(spark, d, "supplier")
    issues = s.selectExpr("s_suppkey as unit_id", "inline(array(struct('b', 'DETERMINISTIC', 'Y'), struct('a', 'DETERMINISTIC', 'X'), struct('a', 'DETERMINISTIC', 'X')))").toDF("unit_id", "id", "kind", "label")
    evidence = s.where("s_suppkey % 2 = 0").selectExpr("s_suppkey as unit_id", "'e1' as ref")
    out = review.session_units(s.selectExpr("s_suppkey as id"), issues, evidence, evidence.limit(0))
    return out.select("id", *[F.array_join(c, "|").alias(c) for c in ("qa_issue_refs", "evidence_refs", "labels")])


@query("select 1 as doc_id, 'CARDINALITY:' || n_nationkey as error from nation where n_nationkey % 3 = 0 union all select 1, 'UNCOVERED:target:' || n_nationkey from nation where n_nationkey % 3 = 0")
def edge_errors(spark, d):
    n = u.table(spark, d, "nation").selectExpr("1 as doc_id", "n_nationkey as ordinal", "n_name as text")
    edges = n.selectExpr("doc_id", "cast(ordinal as string) as id", "array(ordinal) as source", "if(ordinal % 3 = 0, cast(array() as array<int>), array(ordinal)) as target", "'ALIGNED' as status")
    return align.edge_errors(edges, n, n)


@query("select c_custkey as doc_id, case when c_custkey % 4 = 0 then 'a' || chr(13) || chr(10) || 'Z' || chr(10) || 'c' else 'a' || chr(13) || chr(10) || 'b' || chr(10) || 'c' end as text, case when c_custkey % 4 = 1 then 'NO_SUCH_LINE' when c_custkey % 4 = 2 then 'LINE_BREAK' else '' end as error from customer")
def patched_lines(spark, d):
    c = u.table(spark, d, "customer")
    edits = c.where("c_custkey % 4 < 3").selectExpr("c_custkey as doc_id", "if(c_custkey % 4 = 1, 9, 1) as line", "if(c_custkey % 4 = 2, 'x\\ny', 'Z') as text")
    out = align.patched_text(c.selectExpr("c_custkey as doc_id", "'a\\r\\nb\\nc' as text"), edits)
    return out.select("doc_id", "text", F.coalesce("error", F.lit("")).alias("error"))


@query("select p_partkey as id, case when p_partkey % 3 = 0 then 'UNRESOLVED' when p_partkey % 3 = 1 then 'RESOLVED' else 'BLOCKED' end as status from part")
def cell_anchors(spark, d):
    p = u.table(spark, d, "part")
    cells = p.where("p_partkey % 3 > 0").selectExpr("1 as doc_id", "'s' as part", "concat('A', p_partkey) as cell", "if(p_partkey % 3 = 1, p_name, '?') as text")
    return align.cell_anchors(p.selectExpr("1 as doc_id", "p_partkey as id", "'s' as part", "concat('A', p_partkey) as cell", "p_name as current_target"), cells).select("id", "status")


@query("select s_suppkey::varchar as stage, case s_suppkey % 4 when 0 then 'OTHER_INPUT' when 1 then 'NOT_A_PREFIX' else 'BATCH_GAP' end as error from supplier where s_suppkey % 4 < 3")
def checkpoint_errors(spark, d):
    s = u.table(spark, d, "supplier")
    stored = s.selectExpr("cast(s_suppkey as string) as stage", "if(s_suppkey % 4 = 0, 'x', 'd') as digest", "if(s_suppkey % 4 = 1, array('b'), array('a', 'b')) as ids", "if(s_suppkey % 4 = 2, array(1, 3), array(1, 2)) as batches")
    return trail.checkpoint_errors(stored, s.selectExpr("cast(s_suppkey as string) as stage", "'d' as digest", "array('a', 'b', 'c') as ids"))


@query("select o_orderkey as id, case when o_orderkey % 4 in (0, 1) then chr(39) else '' end || case o_orderkey % 4 when 0 then '=1+1' when 1 then ' -x' when 2 then 'a=b' else '' end as cell from orders")
def neutral_cells(spark, d):
    from parallex.functions.text import neutral_cell

    rows = u.table(spark, d, "orders").selectExpr("o_orderkey as id", "case o_orderkey % 4 when 0 then '=1+1' when 1 then ' -x' when 2 then 'a=b' else '' end as cell")
    return rows.select("id", neutral_cell(F.col("cell")).alias("cell"))


@query("select o_orderkey as id, case when o_orderkey % 3 = 0 then 'NOT_EXPORTED' when o_orderkey % 3 = 1 then 'CHANGED' else 'UNCHANGED' end as state from orders")
def post_review(spark, d):
    o = u.table(spark, d, "orders")
    return records.post_review(o.selectExpr("o_orderkey as id", "'c' as current_target"), o.where("o_orderkey % 3 > 0").selectExpr("o_orderkey as unit_id", "'USER_EDITED' as status", "if(o_orderkey % 3 = 1, 'n', 'c') as approved_target")).select("id", "state")


@query("select o_orderkey as ordinal, '| ' || o_orderkey || ' | UNREVIEWED | ' || o_orderstatus || ' | x&y |' as value from orders")
def snapshot_markdown(spark, d):
    o = u.table(spark, d, "orders").selectExpr("o_orderkey as ordinal", "cast(o_orderkey as string) as id", "'l' as location", "o_orderstatus as source", "'x&y' as current_target", "cast(null as string) as suggested_target")
    none = o.limit(0).selectExpr("id as unit_id", "'' as status", "'' as approved_target")
    return records.snapshot_text(records.snapshot_rows(o, none), "md")


@query("select doc_id, ordinal, case when t is null then 'AMBIGUOUS' else 'ALIGNED' end as alignment from (select doc_id, unnest(range(0, len(ls))) as ordinal, unnest(list_transform(range(0, len(ls)), lambda i: case when i % 4 < 3 then 1 end)) as t from (select doc_id, string_split(text, chr(10)) as ls from documents))")
def positional_pairs(spark, d):
    rows = u.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"), F.lit("p").alias("kind")).withColumn("ordinal", F.col("ordinal").cast("long"))
    return align.positional(rows, rows.where("ordinal % 4 < 3")).select("doc_id", "ordinal", "alignment")


@query("select c_custkey as id, 'h' || n_nationkey as hint, 1 as rank from customer join nation on c_nationkey = n_nationkey where n_nationkey > 9 union all select c_custkey, 'h' || n_nationkey, 1 from customer join nation on c_nationkey = n_nationkey where n_nationkey <= 9")
def term_hints(spark, d):
    rows = u.table(spark, d, "customer").selectExpr("c_custkey as id", "concat('第', lpad(c_nationkey, 2, '0'), '号') as source", "'zh-CN' as source_language", "'en' as target_language")
    terms = u.table(spark, d, "nation").selectExpr("n_nationkey as term_ordinal", "concat(lpad(n_nationkey, 2, '0'), '号') as term", "concat('h', n_nationkey) as hint")
    return glossary.term_hints(rows, terms).select("id", "hint", "rank")


@query("select p_partkey as id, sha256('{\"context\":{' || case when p_partkey % 2 = 0 then '\"product\":\"' || p_type || '\",' else '' end || '\"project_id\":\"p\",\"text_role\":\"PROSE\",\"vendor\":\"' || p_brand || '\"},\"kind\":\"SCOPED\"}') as scope_key from part")
def canonical_scope(spark, d):
    rows = u.table(spark, d, "part").selectExpr("p_partkey as id", "'s' as source", "named_struct('vendor', concat(' ', p_brand), 'product', if(p_partkey % 2 = 0, p_type, ' '), 'version', cast(null as string), 'domain', cast(null as string), 'text_role', cast(null as string), 'project_id', 'p') as context")
    return memory.canonical_scope(rows).select("id", "scope_key")


@query("select user_id as id, '{\"list\":[{\"Token\":\"[REDACTED]\"}],\"name\":\"u' || user_id || '\"}' as body from (select distinct user_id from events)")
def redacted_events(spark, d):
    rows = u.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().selectExpr("id", "to_json(named_struct('name', concat('u', id), 'list', array(named_struct('Token', 's')))) as body")
    return rows.select("id", trail.redact_json("body").alias("body"))


@query("select o_orderkey as run_id from orders where o_orderkey % 3 = 1 order by o_orderdate desc, o_orderkey limit 50")
def resumable_runs(spark, d):
    rows = u.table(spark, d, "orders").selectExpr("o_orderkey as run_id", "if(o_orderkey % 3 = 0, 'COMPLETED', 'RUNNING') as status", "o_orderkey % 3 = 2 as alive", "o_orderdate as updated_at")
    return trail.resumable(rows).select("run_id")
