"""Searches over the text tables, rechecks, work queues, and files that are written
and read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from parallex.operators import batching, recheck, terms, workqueue
from parallex.plans import units as u
from parallex.plans.queries import _QA_ORDERS, _order_sql, query
from parallex.shared import shared_dir, written
from parallex.sources import records


@query(r"""with w as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) as word from benchmark)
  select doc_id, count(*) as n_terms from documents join w on contains(text, word) group by doc_id""")
def document_terms(spark, d):
    """How many words of the benchmark each document holds."""
    words = u.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("needle")).distinct()
    found = terms.occurring(u.table(spark, d, "documents").select("doc_id", "text"), words.withColumn("form", F.lit(0)), "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"))


_ORDERS = " union all ".join(_order_sql(c) for c in _QA_ORDERS)


@query(f"""with i as (select unit_id, count(*) as e from ({_ORDERS}) group by unit_id),
    o as (select 'O' || o_orderkey as unit_id, o_orderkey % 5 = 2 as copied, o_orderkey % 8 = 0 as waiting, o_orderkey % 3 <> 2 as same from orders)
  select unit_id, case when waiting then 'NOT_RUN' when copied and not same or not copied and e > 0 then 'FAIL' else 'PASS' end as recheck_status,
    (case when waiting then 0 when copied then if(same, 0, 2) else coalesce(e, 0) end)::integer as error_count, 0 as warning_count from o left join i using (unit_id)""")
def recheck_all(spark, d):
    """All units are checked, then each fifth order's decision becomes its source:
    the second recheck checks those alone."""
    units = u.order_units(spark, d).withColumn("key", F.substr("id", F.lit(2)).cast("long"))
    status = F.when(F.col("key") % 8 == 0, "UNREVIEWED").otherwise("USER_EDITED")
    decisions = units.select(F.col("id").alias("unit_id"), status.alias("status"), F.col("target").alias("approved_target"), "key", "source")
    units = units.drop("key", "target")
    receipts = written(recheck.recheck(units, decisions), "receipts")
    changed = decisions.withColumn("approved_target", F.when(F.col("key") % 5 == 2, F.col("source")).otherwise(F.col("approved_target")))
    out = recheck.with_recheck(changed, recheck.recheck(units, changed, receipts=receipts))
    return out.select("unit_id", "recheck_status", "error_count", "warning_count")


@query("""select event_id, line, case when event_id % 7 = 0 then 'INVALID_JSON' else 'NOT_AN_OBJECT' end as error from (
  select *, row_number() over (partition by event_id % 16 order by event_id) as line from events) where event_id % 13 <> 0 and (event_id % 7 = 0 or event_id % 11 = 0)""")
def json_line_numbers(spark, d):
    """Events as JSON lines, a file for each sixteenth of the ids; broken ones are
    found again by file and line."""
    value = "case when event_id % 13 = 0 then ' ' when event_id % 7 = 0 then concat('{\"a\": ', event_id) when event_id % 11 = 0 then concat('[', event_id, ']') else to_json(named_struct('a', event_id)) end"
    rows = u.table(spark, d, "events").selectExpr("event_id", "event_id % 16 as part", f"{value} as value")
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    lines = records.numbered_lines(spark, path)
    return lines.join(records.json_line_errors(lines), ["path", "line"]).select(F.regexp_extract("value", r"\d+", 0).cast("long").alias("event_id"), "line", "error")


class _Scripted(workqueue.Service):
    """Answers by the key at a source's end: breaks off long batches, loses options."""

    def generate(self, request):
        body = json.loads(request)
        units, again = body["units"], "retry_constraint" in body
        keys = [int(x["source"].rsplit("--opt", 1)[1]) for x in units]
        if len(units) > 4 and any(k % 50 == 1 for k in keys):
            raise batching.Interrupted
        lost = [k % 91 == 0 or k % 7 == 0 and not again for k in keys]
        texts = ["Ouvrir " + x["source"].replace("--opt", "opt" if gone else "--opt") for x, gone in zip(units, lost)]
        return json.dumps({"units": [{"id": x["id"], "suggested_target": t, "proposal_decision": "REPLACE", "reason": "r"} for x, t in zip(units, texts)]})


@query("""select 'P' || p_partkey as unit_id, case when p_partkey % 10 = 0 then 'm' || p_partkey else 'Ouvrir ' || p_name || case when p_partkey % 91 = 0 then ' opt' else ' --opt' end || p_partkey end as suggested_target,
  case when p_partkey % 10 = 0 or p_partkey % 91 = 0 then 'REVIEW' else 'REPLACE' end as proposal_decision, case when p_partkey % 10 = 0 then 'MEMORY' else 'SERVICE' end as origin from part""")
def translation_queue(spark, d):
    """Parts as units of a document a brand, asked for by a scripted service."""
    units = u.table(spark, d, "part").selectExpr("p_brand as doc_id", "concat('P', p_partkey) as id", "p_partkey as ordinal", "concat(p_name, ' --opt', p_partkey) as source")
    memory = units.where("ordinal % 10 = 0").selectExpr("id", "concat('m', ordinal) as target")
    folder = f"{shared_dir(spark)}/receipts-{uuid.uuid4().hex}"
    return workqueue.translated(units, memory, _Scripted(), folder).drop("error")
