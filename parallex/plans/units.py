"""Bilingual units over the relational tables, with known mutations.

Each line item is a unit whose source holds one kind of literal, by its line
number, and whose target keeps, changes or drops it by its order key; so what
the checks must report follows from columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = "concat('L', l_orderkey, '-', l_linenumber)"
#: Line number: source, target.
FAMILIES = {
    1: ("concat('Wait ', q, ' ms before retry')", "concat('Attendre ', if(l_orderkey % 5 = 0, q + 1, q), ' ms avant')"),
    2: (
        "concat('Use port ', l_partkey, ' here')",
        "case when l_orderkey % 4 = 0 then 'Port ici' when l_orderkey % 4 = 1 then concat('Port +', l_partkey, ' ici') else concat('Port ', l_partkey, ' ici') end",
    ),
    3: (
        "concat('Needs version ', l_linenumber, '.', l_suppkey % 10, ' now')",
        "concat('Exige la version ', l_linenumber, '.', if(l_orderkey % 3 = 0, l_suppkey % 10 + 1, l_suppkey % 10), ' maintenant')",
    ),
    4: (
        "concat('Put {p', l_partkey, '} twice {p', l_partkey, '} here')",
        "if(l_orderkey % 3 = 1, concat('Mettre {p', l_partkey, '} ici'), concat('Mettre {p', l_partkey, '} puis {p', l_partkey, '}'))",
    ),
    5: (
        "concat('See https://ex.example/d/', l_partkey, '.')",
        "concat('Voir https://ex.example/', if(l_orderkey % 6 = 0, 'e', 'd'), '/', l_partkey, '.')",
    ),
    6: (
        "concat('Open /var/log/p', l_partkey, ' and r', l_suppkey, '.csv first')",
        "concat('Ouvrir /var/log/', if(l_orderkey % 7 = 0, 'q', 'p'), l_partkey, ' et r', l_suppkey, if(l_orderkey % 7 = 1, '.tsv', '.csv'))",
    ),
    7: ("concat('Run with --opt', l_suppkey, ' now')", "if(l_orderkey % 5 = 2, 'Lancer', concat('Lancer avec --opt', l_suppkey))"),
}


def case(side: int) -> str:
    return "case l_linenumber " + " ".join(f"when {k} then {v[side]}" for k, v in FAMILIES.items()) + " end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _context(**fields: str) -> str:
    names = ("vendor", "product", "version", "domain", "text_role", "project_id")
    return "named_struct(" + ", ".join(f"'{n}', {fields.get(n, 'cast(null as string)')}" for n in names) + ")"


def literal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    return rows.selectExpr(
        f"{_LINE} as id", "l_orderkey * 10 + l_linenumber as ordinal", f"{case(0)} as source", f"{case(1)} as target",
        "'en' as source_language", "'fr' as target_language", "concat('line:', l_linenumber) as location", f"{_context(text_role="'PROSE'")} as context",
    )


def order_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units with variables, identifiers and, into English, Han text."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('O', o_orderkey) as id", "o_orderkey as ordinal",
        "case o_orderkey % 3 when 0 then concat('Set ${VAR', o_custkey % 50, '} first') when 1 then concat('Read TAB_', o_custkey, ' slowly') else concat('打开文件 ', o_orderpriority, ' 状态') end as source",
        "case o_orderkey % 3 when 0 then if(o_orderkey % 4 = 0, 'Set it first', concat('Set ${VAR', o_custkey % 50, '} first')) when 1 then concat('Read TAB_', if(o_orderkey % 4 = 1, o_custkey + 1, o_custkey), ' slowly') else if(o_orderkey % 4 = 2, concat('Open 文件 ', o_orderpriority), concat('Open file ', o_orderpriority)) end as target",
        "if(o_orderkey % 3 = 2, 'zh-CN', 'en') as source_language", "'en' as target_language", "concat('order:', o_orderkey) as location", f"{_context(text_role="'PROSE'")} as context",
    )


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as terms: even ones protected, odd ones translated; those with a
    key divisible by five hold for one region only, nation 3 isn't approved."""
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    target = lambda p, s: f"named_struct('language', 'fr', 'term', concat('{p}', n_nationkey), 'status', '{s}')"
    return rows.selectExpr(
        "concat('G', n_nationkey) as id", "n_nationkey as ordinal", "if(n_nationkey % 2 = 0, 'PROTECT', 'TRANSLATE') as behavior",
        "if(n_nationkey = 3, 'DISCOVERED', 'PROJECT_APPROVED') as approval", "named_struct('language', 'en', 'term', n_name) as source",
        f"if(n_nationkey % 2 = 0, array(), array({target('Pays-', 'PREFERRED')}, {target('Etat-', 'ADMITTED')}, {target('Coin-', 'FORBIDDEN')})) as targets",
        "named_struct('vendor', if(n_nationkey % 5 = 0, r_name, cast(null as string)), 'product', cast(null as string), 'version', cast(null as string), 'domain', cast(null as string), 'text_roles', cast(array() as array<string>)) as scope",
        "named_struct('mode', 'token', 'case_sensitive', n_nationkey % 2 = 0, 'unicode_normalization', 'NFC') as match",
    )


def term_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as units that name their nation; the target keeps the name, or
    holds the preferred, the forbidden or no designation; every other customer's
    vendor is another region than its nation's."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.selectExpr(
        "concat('C', c_custkey) as id", "c_custkey as ordinal", "concat('Ship to ', n_name, ' today') as source",
        "concat('Envoyer ', case c_custkey % 4 when 0 then n_name when 1 then concat('Pays-', n_nationkey) when 2 then concat('Coin-', n_nationkey) else 'ailleurs' end, ' ici') as target",
        "'en' as source_language", "'fr' as target_language", "concat('cust:', c_custkey) as location",
        _context(vendor="if(c_custkey % 2 = 0, r_name, 'ELSEWHERE')", text_role="'PROSE'") + " as context",
    )
