"""The work queue: halving, retries, receipts, restarts."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parallex.operators import batching, workqueue

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Fake(workqueue.Service):
    """Answers by what a source says; logs the ids that it is asked for."""

    def __init__(self, log, fails=False):
        self.log, self.fails = str(log), fails

    def generate(self, request):
        body = json.loads(request)
        units, again = body["units"], body.get("retry_constraint")
        with open(os.path.join(self.log, f"{os.getpid()}.log"), "a") as f:
            f.write(json.dumps([[u["id"] for u in units], again]) + "\n")
        sources = [u["source"] or "" for u in units]
        if self.fails and any("poison" in s for s in sources):
            raise RuntimeError("service gone")
        if any("slow" in s for s in sources) and len(units) > 2 or any("never" in s for s in sources):
            raise batching.Interrupted
        if any("garbage" in s for s in sources):
            return "no json"
        out = []
        for u, s in zip(units, sources):
            text = f"[{s}]"
            if "loses" in s and not again or "always" in s:
                text = text.replace("--opt", "opt")
            if "repeats" in s:
                text = " NO  good" if "insists" in s or not again else "fine"
            out.append({"id": u["id"], "suggested_target": text, "proposal_decision": "REPLACE", "reason": "r"})
        return json.dumps({"units": out})

    def calls(self):
        return [json.loads(x) for name in sorted(os.listdir(self.log)) for x in open(os.path.join(self.log, name))]


def service(tmp_path, name, **more):
    (tmp_path / name).mkdir()
    return Fake(tmp_path / name, **more)


SOURCES = ["plain", "Run --opt loses", "Run --opt always", "slow a", "never", "garbage", "repeats", "repeats insists", None, "plain", "x" * 12_001]


def units(spark, sources=SOURCES, docs=1):
    return spark.createDataFrame([(k % docs, f"U{k}", k, s) for k, s in enumerate(sources)], "doc_id int, id string, ordinal int, source string")


def test_translation(spark, tmp_path):
    fake = service(tmp_path, "log")
    memory = spark.createDataFrame([("U9", "known")], "id string, target string")
    rejected = spark.createDataFrame([("U6", "no good", False), ("U7", "no", True)], "id string, target string, phrase boolean")
    out = workqueue.translated(units(spark), memory, fake, f"file://{tmp_path}/receipts", rejected)
    got = {r.unit_id: (r.suggested_target, r.proposal_decision, r.origin, r.error) for r in out.collect()}
    assert got == {
        "U0": ("[plain]", "REPLACE", "SERVICE", None), "U1": ("[Run --opt loses]", "REPLACE", "SERVICE", None), "U2": ("[Run opt always]", "REVIEW", "SERVICE", None),
        "U3": ("[slow a]", "REPLACE", "SERVICE", None), "U4": (None, None, "SERVICE", "INTERRUPTED"), "U5": (None, None, "SERVICE", "NOT_STRICT_JSON"), "U6": ("fine", "REPLACE", "SERVICE", None),
        "U7": (None, None, "SERVICE", "REPEATS_REJECTED"), "U8": ("[]", "REPLACE", "SERVICE", None), "U9": ("known", "REVIEW", "MEMORY", None), "U10": (None, None, "SERVICE", "TOO_LARGE"),
    }
    assert [c for c in fake.calls() if c[0] == ["U2"]] == [[["U2"], None], [["U2"], "LITERAL_CHANGED"], [["U2"], "LITERAL_CHANGED"]]
    assert not any("U9" in ids or "U10" in ids for ids, _ in fake.calls())
    # What was settled isn't asked for again; what was given up is.
    second = service(tmp_path, "second")
    again = {r.unit_id: (r.suggested_target, r.proposal_decision, r.origin, r.error) for r in workqueue.translated(units(spark), memory, second, f"file://{tmp_path}/receipts", rejected).collect()}
    assert again == got and {i for ids, _ in second.calls() for i in ids} == {"U4", "U5", "U7"}
    third = service(tmp_path, "third")
    workqueue.translated(units(spark), memory, third, f"file://{tmp_path}/receipts", rejected, model="other").count()
    assert {"U0", "U1"} <= {i for ids, _ in third.calls() for i in ids}


def test_failure_keeps_finished_tasks(spark, tmp_path):
    sources = [f"text {k}" for k in range(200)] + ["poison"]
    rows = units(spark, sources, docs=10).withColumn("ordinal", F.col("ordinal"))
    folder, none = f"file://{tmp_path}/receipts", spark.createDataFrame([], "id string, target string")
    first = service(tmp_path, "first", fails=True)
    stage = workqueue.translation()
    with pytest.raises(PySparkException):
        workqueue.worked(rows, {"source": "source"}, stage, first, folder, batches_per_task=1).count()
    kept = {r.unit_id for r in spark.read.parquet(folder).collect()} if os.path.isdir(tmp_path / "receipts") and any(x.endswith(".parquet") for x in os.listdir(tmp_path / "receipts")) else set()
    second = service(tmp_path, "second")
    out = workqueue.worked(rows, {"source": "source"}, stage, second, folder, batches_per_task=1)
    assert out.where("error is null").count() == 201 and none.count() == 0
    asked = [i for ids, _ in second.calls() for i in ids]
    assert sorted(asked) == sorted({f"U{k}" for k in range(201)} - kept) and kept


class Judge(Fake):
    def generate(self, request):
        super().generate(request)
        out = []
        for u in json.loads(request)["units"]:
            kind = {"claim": ("OUT_OF_SCOPE_CLAIM", "TECHNICAL_CLAIM"), "wrong": ("FINDING", None), "ambiguous": ("FINDING", "AMBIGUITY")}.get(u["source"], ("NO_FINDING", None))
            if u["source"] == "wrong" and "retry_constraint" in json.loads(request) or u["source"] == "ok":
                kind = ("NO_FINDING", None)
            out.append({"id": u["id"], "outcome": kind[0], "classification": kind[1] if u["source"] != "odd" else "NONSENSE", "next_action": None})
        return json.dumps({"units": out})


def test_adjudication(spark, tmp_path):
    (tmp_path / "log").mkdir()
    rows = units(spark, ["ok", "claim", "wrong", "ambiguous", "odd"]).withColumn("suggested_target", F.lit("t"))
    out = workqueue.adjudicated(rows, Judge(tmp_path / "log"), f"file://{tmp_path}/receipts")
    got = {r.unit_id: (r.outcome, r.classification, r.error) for r in out.collect()}
    assert got == {"U0": ("NO_FINDING", None, None), "U1": ("OUT_OF_SCOPE_CLAIM", "TECHNICAL_CLAIM", None), "U2": ("NO_FINDING", None, None), "U3": ("FINDING", "AMBIGUOUS_HIGH_RISK", None), "U4": (None, None, "NO_FINDING_WITH_DETAIL")}
    assert workqueue.adjudicated(rows.limit(0), Judge(tmp_path / "log"), f"file://{tmp_path}/none").count() == 0
