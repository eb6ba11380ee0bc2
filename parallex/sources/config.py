"""Rule tables out of configuration files: JSON, or YAML where its reader is installed.

These files are short and belong to a project, not to its data: the driver reads their
text and makes tables, which the operators join.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_config(spark: SparkSession, path: str) -> dict:
    """The mapping in a configuration file, by any path that Spark can open."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise ValueError(f"{path}: empty configuration")
    try:
        value = json.loads(text[0])
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: not JSON, and no YAML reader is installed") from e
        value = yaml.safe_load(text[0])
    if not isinstance(value, dict):
        raise ValueError(f"{path}: configuration must be a mapping")
    return value


def detector_rules(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lexical rules (a row a language and value), text roles with their signals, and
    literal extractors with theirs, as ``signals`` takes them."""
    lexical = [(d["id"], d["signal"], lang, d["match"], v) for d in config.get("lexical_detectors", ()) for lang in d["languages"] for v in d["values"]]
    roles = [(d["equals"], d["signal"], d["id"]) for d in config.get("context_detectors", ()) if d["field"] == "text_role"]
    literal = [(d["id"], d["extractor"], d["signal"]) for d in config.get("literal_detectors", ())]
    return (
        spark.createDataFrame(lexical, "detector_id string, signal string, language string, match string, value string"),
        spark.createDataFrame(roles, "text_role string, signal string, detector_id string"),
        spark.createDataFrame(literal, "detector_id string, extractor string, signal string"),
    )


def routes(spark: SparkSession, config: dict) -> DataFrame:
    """What a fact of a task loads, and in which order kinds of facts count, as
    ``routing.resource_plan`` takes it."""
    rows, seq = [], 0
    for kind, table in (("input", config.get("input_resources")), ("mode", config.get("mode_resources"))):
        rows += [(f"{kind}:{name}", r, seq) for name, own in (table or {}).items() for r in own]
        seq += 1
    if "format_resource" in config:
        rows.append(("structured", config["format_resource"]["reference"], seq))
    rows += [(f"signal:{name}", r, seq + 1) for name, own in config.get("signal_resources", {}).items() for r in own]
    if "aligned_qa" in config:
        rows.append(("aligned_qa", config["aligned_qa"]["resource"], seq + 2))
    rows += [(f"risk:{name}", r, seq + 3) for name, own in config.get("risk_resources", {}).items() for r in own]
    research = config.get("research", {})
    rows += [(fact, research[key], seq + 4 + n) for n, (fact, key) in enumerate((("research", "evidence_resource"), ("search", "search_resource"))) if key in research]
    return spark.createDataFrame(rows, "fact string, resource string, seq int")


def techniques(spark: SparkSession, config: dict) -> DataFrame:
    """The catalogue of techniques, as ``signals.techniques_for`` and
    ``validation.technique_violations`` take it."""
    rows = [
        (t["id"], t.get("risk"), t.get("applies_to_modes", []), t.get("text_roles", []), t.get("triggers", []), t.get("allowed_transformations", []), t.get("restricted_transformations", []), t.get("qa_mapping", {}).get("semantic_dimensions", []))
        for t in config.get("techniques", ())
    ]
    return spark.createDataFrame(rows, "technique_id string, risk string, modes array<string>, roles array<string>, triggers array<string>, allowed array<string>, restricted array<string>, dimensions array<string>")


def formats(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Formats with their risks, preferred backends in order, and extensions."""
    known = [(name, f["family"], f.get("risks", [])) for name, f in config.get("formats", {}).items()]
    preferred = [(name, b, n) for name, f in config.get("formats", {}).items() for n, b in enumerate(f.get("audit_backends", []))]
    return (
        spark.createDataFrame(known, "format string, family string, known array<string>"),
        spark.createDataFrame(preferred, "format string, backend string, rank int"),
        spark.createDataFrame(list(config.get("extensions", {}).items()), "extension string, format string"),
    )


def search_queries(terms: DataFrame, templates: dict[str, str]) -> DataFrame:
    """``term``, ``template`` and the ``query`` that it makes of a term's columns
    (``term``, ``vendor``, ``product``, ``version``, ``official_domain``); what a term
    lacks leaves no gap, and a template without its domain makes none."""
    names = ["term", "vendor", "product", "version", "official_domain"]

    def filled(template: str):
        out = F.lit(template)
        for name in names:
            value = F.coalesce(F.col(name), F.lit("")) if name in terms.columns else F.lit("")
            out = F.replace(out, F.lit("{" + name + "}"), value)
        text = F.trim(F.regexp_replace(out, " +", " "))
        needs = "{official_domain}" in template
        return F.when(F.coalesce(F.col("official_domain"), F.lit("")) != "", text) if needs and "official_domain" in terms.columns else (F.lit(None).cast("string") if needs else text)

    made = F.array(*[F.struct(F.lit(name).alias("template"), filled(t).alias("query")) for name, t in templates.items()])
    return terms.select("term", F.inline(made)).where("query is not null")
