"""Work for a text service as a queue that executors share and a restart resumes.

Units become batches, batches tasks.  A task asks for its batches in turn, halves one
that the service didn't finish and goes on with smaller ones, asks again for answers
that break the contract, and keeps what it settled as receipts in a folder of its own
choice: a task's receipts are committed when it ends, whatever becomes of the job.  A
run first drops what has a receipt under the same digest (of a unit's request, the
service's settings and the rules), so after a failure only the rest is asked for, and
units that an earlier run had to give up are asked for again.

Defined cases: units with a memory never reach the service; repeated receipts count
once; null and empty sources are asked for like others; a unit that no batch can hold
is an error row; without units nothing is asked.
"""

from __future__ import annotations

import hashlib
import json
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallex.functions import literals
from parallex.operators import batching

_OUTCOME = "unit_id string, digest string, answer string, error string, attempts int, batch_units int, request_sha256 string, response_sha256 string"
_NAMES = [x.split()[0] for x in _OUTCOME.split(", ")]
_KINDS = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 2


class Service(ABC):
    """A text service; must be picklable.  Requests and answers are JSON."""

    @abstractmethod
    def generate(self, request: str) -> str:
        """Raises ``batching.Interrupted`` for an answer that broke off; anything
        else that it raises ends the run."""


class Broken(ValueError):
    """An answer that breaks the contract; the message is a code."""


def _collapsed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().casefold()


_ABUSE = re.compile(rf"(?<!\w)(?i:{literals.ABUSE_EN})(?!\w)|{literals.ABUSE_ZH}")


@dataclass(frozen=True)
class Stage:
    """What a kind of work asks for and accepts."""

    name: str
    max_units: int = batching.MAX_UNITS
    max_chars: int = batching.MAX_SOURCE
    #: How often a single unit is asked for again after a broken answer.
    retries: int = 2
    #: Whether a broken answer makes later batches smaller, as an interruption does.
    shrinks: bool = False
    #: Fields of an answer that must hold text.
    required: tuple[str, ...] = ()
    #: What the digest covers besides the units.
    settings: dict = field(default_factory=dict, hash=False)

    def check(self, unit: dict, answer: dict, last: bool) -> dict:
        """The answer to keep; raises ``Broken``.  ``last``: it isn't asked again."""
        return answer


class Translation(Stage):
    """Literals must stay, rejected texts mustn't come back.  A unit whose literals
    still differ at last is for review; one that repeats a rejection is an error."""

    #: Codes after which a batch is halved and a unit asked for again.
    again = ("LITERAL_CHANGED", "REPEATS_REJECTED", "ABUSIVE")

    def check(self, unit, answer, last):
        source, target = unit["source"] or "", answer["suggested_target"]
        decision = answer.get("proposal_decision")
        if decision not in batching.DECISIONS:
            raise Broken("UNKNOWN_DECISION")
        if decision == "REPLACE" and target == source:
            raise Broken("REPLACE_EQUALS_SOURCE")
        if decision == "PROTECT" and target != source:
            raise Broken("PROTECT_CHANGED")
        told, whole = _collapsed(target), {_collapsed(x) for x in unit.get("rejected") or ()}
        if told in whole or any(x and x in told for x in map(_collapsed, unit.get("rejected_phrases") or ())):
            raise Broken("REPEATS_REJECTED")
        if _ABUSE.search(target):
            raise Broken("ABUSIVE")
        if any(target.count(x) != source.count(x) for x in unit.get("literals") or ()):
            if not last:
                raise Broken("LITERAL_CHANGED")
            return answer | {"proposal_decision": "REVIEW"}
        return answer


class Adjudication(Stage):
    """Semantic outcomes: no finding, or one with a class that is known."""

    again = None  # every broken answer

    def check(self, unit, answer, last):
        outcome, kind = answer["outcome"], answer.get("classification")
        kind = "AMBIGUOUS_HIGH_RISK" if kind == "AMBIGUITY" else kind
        if outcome == "NO_FINDING" and (kind or answer.get("next_action")):
            raise Broken("NO_FINDING_WITH_DETAIL")
        if outcome != "NO_FINDING" and not kind:
            raise Broken("FINDING_WITHOUT_CLASS")
        if kind and kind not in batching.CLASSIFICATIONS:
            raise Broken("UNKNOWN_CLASS")
        if outcome == "OUT_OF_SCOPE_CLAIM" and kind != "TECHNICAL_CLAIM":
            raise Broken("CLAIM_NOT_TECHNICAL")
        return answer | {"classification": kind}


def translation(**settings) -> Translation:
    return Translation("TRANSLATION", required=("suggested_target", "reason"), settings=settings)


def adjudication(**settings) -> Adjudication:
    return Adjudication("ADJUDICATION", max_chars=batching.MAX_SEMANTIC, retries=1, shrinks=True, required=("outcome",), settings=settings)


def _parsed(stage: Stage, response: str, units: list[dict], last: bool) -> list[dict]:
    try:
        answers = json.loads(response)["units"]
        ids = [a["id"] for a in answers]
    except (ValueError, TypeError, KeyError) as e:
        raise Broken("NOT_STRICT_JSON") from e
    if ids != [u["id"] for u in units]:
        raise Broken("IDS_DIFFER")
    for a in answers:
        for name in stage.required:
            if not isinstance(a.get(name), str) or not a[name].strip():
                raise Broken("EMPTY_" + name.upper())
    return [stage.check(u, a, last) for u, a in zip(units, answers)]


def _worked(stage: Stage, service: Service, batches: Iterator[list[dict]]) -> Iterator[list[tuple]]:
    """Rows of outcomes, a list for each settled batch.  What is pending is a stack,
    so halves are asked for in their order."""
    size, tries, constraint = stage.max_units, {}, {}
    for first in batches:
        pending = [first]
        while pending:
            units = pending.pop()
            if len(units) > size:
                pending += [units[k : k + size] for k in range(0, len(units), size)][::-1]
                continue
            own = units[0]["id"]
            body = {"units": [{k: v for k, v in u.items() if k != "digest"} for u in units]}
            request = json.dumps(body | ({"retry_constraint": constraint[own]} if own in constraint else {}), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            asked = tries.get(own, 0) if len(units) == 1 else 0
            response, error = "", None
            try:
                response = service.generate(request)
                answers = _parsed(stage, response, units, len(units) == 1 and asked >= stage.retries)
            except (batching.Interrupted, Broken) as e:
                error = "INTERRUPTED" if isinstance(e, batching.Interrupted) else str(e)
                broken = error != "INTERRUPTED"
                if len(units) > 1 and (not broken or stage.again is None or error in stage.again):
                    middle = len(units) // 2
                    if not broken or stage.shrinks:
                        size = min(size, middle)
                    pending += [units[middle:], units[:middle]]
                    continue
                if len(units) == 1 and broken and (stage.again is None or error in stage.again) and asked < stage.retries:
                    tries[own], constraint[own] = asked + 1, error
                    pending.append(units)
                    continue
                answers = [None] * len(units)
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in (request, response)]
            yield [(u["id"], u["digest"], None if a is None else json.dumps(a, ensure_ascii=False, sort_keys=True), error if a is None else None, asked + 1, len(units), *digests) for u, a in zip(units, answers)]


def _receipts(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _OUTCOME)
    return spark.read.schema(_OUTCOME).parquet(folder)


def worked(units: DataFrame, request: dict[str, str], stage: Stage, service: Service, folder: str, batches_per_task: int = 64) -> DataFrame:
    """Runs the queue and returns ``unit_id``, ``answer`` (JSON), ``error``, ``attempts``,
    ``batch_units`` for every unit.

    ``units``: ``doc_id``, ``id`` (unique), ``ordinal`` and the columns of ``request``,
    which maps a request's fields to columns; ``source`` must be one.  ``folder`` holds
    the receipts, on a file system that driver and executors share."""
    spark = units.sparkSession
    fields = F.struct(F.col("id").cast("string").alias("id"), *[F.col(c).alias(name) for name, c in sorted(request.items())])
    settings = json.dumps({"stage": stage.name, "retries": stage.retries, **stage.settings}, sort_keys=True, default=str)
    asked = F.to_json(fields, {"ignoreNullFields": "false"})
    rows = units.select("doc_id", F.col("id").cast("string").alias("id"), "ordinal", F.coalesce(request["source"], F.lit("")).alias("source"), asked.alias("asked"))
    rows = rows.withColumn("digest", F.sha2(F.concat("asked", F.lit(settings)), 256))
    done = _receipts(spark, folder).where("error is null").select(F.col("unit_id").alias("id"), "digest").distinct()
    todo = batching.batches(rows.join(done, ["id", "digest"], "left_anti"), max_units=stage.max_units, max_chars=stage.max_chars)
    ready = todo.where("batch is not null").groupBy("doc_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "asked", "digest"))), lambda x: F.struct(x["asked"].alias("asked"), x["digest"].alias("digest"))).alias("own"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batches():
            for part in parts:
                for own in part.column("own").to_pylist():
                    yield [{**json.loads(x["asked"]), "digest": x["digest"]} for x in own]

        for settled in _worked(stage, service, batches()):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*settled), _KINDS)], names=_NAMES)

    tasks = max(1, -(-ready.count() // batches_per_task))
    # The second algorithm commits each task's files as it ends, so they outlive a failed job.
    ready.repartition(tasks, "doc_id", "batch").mapInArrow(run, _OUTCOME).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    best = F.min_by(F.struct("answer", "error", "attempts", "batch_units"), F.struct(F.col("error").isNotNull(), "attempts"))
    found = _receipts(spark, folder).groupBy(F.col("unit_id").alias("id"), "digest").agg(best.alias("r"))
    out = rows.select("id", "digest", (F.length("source") > stage.max_chars).alias("large")).join(found, ["id", "digest"], "left")
    return out.select(F.col("id").alias("unit_id"), "r.answer", F.when(F.col("large"), "TOO_LARGE").otherwise(F.col("r.error")).alias("error"), "r.attempts", "r.batch_units")


def translated(units: DataFrame, memory: DataFrame, service: Service, folder: str, rejected: DataFrame | None = None, **settings) -> DataFrame:
    """``unit_id``, ``suggested_target``, ``proposal_decision``, ``origin``, ``error``.
    Units with a memory (``id``, ``target``) get it for review and aren't asked for;
    ``rejected``: ``id``, ``target``, ``phrase`` of texts that mustn't come back."""
    hits = units.join(memory.select("id", F.col("target").alias("suggested_target")).where(~literals.abusive(F.col("suggested_target"))), "id")
    rest = units.join(hits.select("id"), "id", "left_anti").withColumn("_m", literals.masked_literals("source"))
    rest = rest.withColumn("_literals", literals.protected_literals(F.col("source"), F.col("_m"))).drop("_m")
    request = {"source": "source", "literals": "_literals"} | ({"context": "context"} if "context" in units.columns else {})
    if rejected is not None:
        of = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("target"))))
        own = rejected.groupBy("id").agg(of(F.lit(True)).alias("_rejected"), of(F.col("phrase")).alias("_phrases"))
        rest = rest.join(own, "id", "left")
        request |= {"rejected": "_rejected", "rejected_phrases": "_phrases"}
    out = worked(rest, request, translation(**settings), service, folder).withColumn("a", F.from_json("answer", "suggested_target string, proposal_decision string"))
    out = out.select("unit_id", "a.suggested_target", "a.proposal_decision", F.lit("SERVICE").alias("origin"), "error")
    none = F.lit(None).cast("string")
    return hits.select(F.col("id").cast("string").alias("unit_id"), "suggested_target", F.lit("REVIEW").alias("proposal_decision"), F.lit("MEMORY").alias("origin"), none.alias("error")).unionByName(out)


def adjudicated(units: DataFrame, service: Service, folder: str, **settings) -> DataFrame:
    """``unit_id``, ``outcome``, ``classification``, ``next_action``, ``error`` for units
    with ``source`` and ``suggested_target``."""
    request = {"source": "source", "suggested_target": "suggested_target"} | {c: c for c in ("context", "issues") if c in units.columns}
    out = worked(units, request, adjudication(**settings), service, folder)
    return out.withColumn("a", F.from_json("answer", "outcome string, classification string, next_action string")).select("unit_id", "a.*", "error")
