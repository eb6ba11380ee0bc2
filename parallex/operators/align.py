"""Alignment of sides and anchors for writing back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallex.sources import markup

# How many sides a status joins.
CARDINALITY = {"ALIGNED": "1:1", "SPLIT": "1:n", "MERGED": "n:1", "AMBIGUOUS": "n:m", "UNALIGNED": "1:0"}


def fan_out(segments: DataFrame, languages: DataFrame) -> DataFrame:
    """Every segment for every distinct target language, ids ``U%05d_<lang>``.
    The languages are a short list of their own, so this grows with the
    segments only."""
    pairs = segments.crossJoin(F.broadcast(languages.select("target_language").distinct()))
    return pairs.withColumn("id", F.format_string("U%05d_%s", F.col("ordinal"), F.col("target_language")))


def positional(source: DataFrame, target: DataFrame) -> DataFrame:
    """Segments paired by place; ``alignment`` is AMBIGUOUS where a side lacks
    one, or the kinds of the two (``kind``) differ."""
    s = source.select("doc_id", "ordinal", F.col("text").alias("source"), F.col("kind").alias("s_kind"))
    t = target.select("doc_id", "ordinal", F.col("text").alias("target"), F.col("kind").alias("t_kind"))
    both = s.join(t, ["doc_id", "ordinal"], "full_outer")
    ok = F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("s_kind").eqNullSafe(F.col("t_kind"))
    return both.select("doc_id", "ordinal", "source", "target", F.when(ok, "ALIGNED").otherwise("AMBIGUOUS").alias("alignment"))


def edge_errors(edges: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id`` and ``error`` of alignment edges (``doc_id``, ``id``,
    ``source``, ``target`` arrays of places, ``status``)."""
    ns, nt = F.size("source"), F.size("target")
    fits = (
        F.when(F.col("status") == "ALIGNED", (ns == 1) & (nt == 1))
        .when(F.col("status") == "SPLIT", (ns == 1) & (nt > 1))
        .when(F.col("status") == "MERGED", (ns > 1) & (nt == 1))
        .when(F.col("status") == "UNALIGNED", (ns + nt == 1))
        .when(F.col("status") == "AMBIGUOUS", (ns > 0) & (nt > 0))
        .otherwise(False)
    )
    out = edges.where(~fits).select("doc_id", F.concat(F.lit("CARDINALITY:"), "id").alias("error"))
    for name, side in (("source", source), ("target", target)):
        used = edges.select("doc_id", F.explode(name).alias("ordinal"))
        twice = used.groupBy("doc_id", "ordinal").count().where("count > 1")
        real = side.select("doc_id", "ordinal")
        for label, rows in (("REUSED", twice), ("UNKNOWN", used.join(real, ["doc_id", "ordinal"], "left_anti")), ("UNCOVERED", real.join(used, ["doc_id", "ordinal"], "left_anti"))):
            out = out.unionByName(rows.select("doc_id", F.concat(F.lit(f"{label}:{name}:"), F.col("ordinal").cast("string")).alias("error")))
    return out


def joined_edges(edges: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Units of alignment edges: the texts of a side joined by a blank line."""

    def side(name: str, rows: DataFrame) -> DataFrame:
        places = edges.select("doc_id", "id", F.posexplode(name).alias("k", "ordinal")).join(rows.select("doc_id", "ordinal", "text"), ["doc_id", "ordinal"])
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"])
        return places.groupBy("doc_id", "id").agg(F.array_join(ordered, "\n\n").alias(f"{name}_text"))

    out = edges.select("doc_id", "id", "status").join(side("source", source), ["doc_id", "id"], "left").join(side("target", target), ["doc_id", "id"], "left")
    return out.select("doc_id", "id", F.coalesce("source_text", F.lit("")).alias("source"), F.coalesce("target_text", F.lit("")).alias("target"), F.col("status").alias("alignment"))


def anchors(units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Where each unit's current text stands: by its hinted place (``part``,
    ``place``) if the text there is equal, else by unique equal text.
    ``paragraphs``: ``doc_id``, ``part``, ``place``, ``text``, ``blockers``.

    Two equi-joins; equal texts are counted before the join, so a line that
    occurs everywhere joins once."""
    hint = paragraphs.select("doc_id", "part", "place", F.col("text").alias("hint_text"), F.col("blockers").alias("hint_blockers"))
    rows = units.join(hint, ["doc_id", "part", "place"], "left").withColumn("by_hint", F.coalesce(F.col("hint_text") == F.col("current_target"), F.lit(False)))
    text = paragraphs.groupBy("doc_id", F.col("text").alias("current_target")).agg(F.count("*").alias("n"), F.min(F.struct("part", "place", "blockers")).alias("only"))
    rows = rows.join(text, ["doc_id", "current_target"], "left")
    found = F.when(F.col("by_hint"), F.struct("part", "place", F.col("hint_blockers").alias("blockers"))).when(F.col("n") == 1, F.col("only"))
    rows = rows.withColumn("at", found)
    status = F.when(F.col("at").isNull(), F.when(F.col("n") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")).when(F.size("at.blockers") > 0, "BLOCKED").otherwise("RESOLVED")
    return rows.select("doc_id", "id", status.alias("status"), F.col("at.part").alias("part"), F.col("at.place").alias("place"))


def cell_anchors(units: DataFrame, cells: DataFrame) -> DataFrame:
    """Spreadsheet anchors by part and cell; another text there blocks."""
    out = units.join(cells.select("doc_id", "part", "cell", F.col("text").alias("there")), ["doc_id", "part", "cell"], "left")
    status = F.when(F.col("there").isNull(), "UNRESOLVED").when(F.col("there") == F.col("current_target"), "RESOLVED").otherwise("BLOCKED")
    return out.select("doc_id", "id", status.alias("status"))


def patched_text(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` with whole lines replaced (``line`` from 0, ``text``),
    line ends and everything else untouched; ``error`` for two edits of a line,
    an edit with a line break, or a line that isn't there."""
    lines = edits.groupBy("doc_id", "line").agg(F.min("text").alias("text"), F.count("*").alias("n"))
    own = lines.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("line", "text"))).alias("new"),
        F.bool_or(F.col("text").rlike(r"[\r\n]")).alias("broken"),
        F.max("line").alias("last"),
        F.max("n").alias("most"),
    )
    rows = docs.join(own, "doc_id", "left")
    parts = F.split("text", r"(?<=\n)|(?<=\r)(?!\n)")
    end = lambda x: F.regexp_extract(x, r"(\r\n|\r|\n)?$", 0)
    patched = F.array_join(F.transform(parts, lambda x, i: F.coalesce(F.concat(F.element_at("new", i), end(x)), x)), "")
    error = F.when(F.col("most") > 1, "REPEATED_LINE").when(F.col("broken"), "LINE_BREAK").when(F.col("last") >= F.size(parts), "NO_SUCH_LINE")
    return rows.select("doc_id", F.when(F.col("new").isNull() | error.isNotNull(), F.col("text")).otherwise(patched).alias("text"), error.alias("error"))


def patched_package(data: bytes, edits: dict[str, dict[int, str]]) -> bytes:
    """A document with paragraph texts replaced whole: ``edits`` maps a part to
    paragraph places and new texts.  The paragraph's first text node takes the text,
    its others are emptied, all other bytes stay.  :mod:`writeback` edits within
    nodes and checks anchors."""
    box, patches = markup.package(data), []
    for part, own in edits.items():
        raw = box.read(part)
        paragraphs = markup.WordPart(raw).paragraphs
        for place, text in own.items():
            for k, node in enumerate(paragraphs[place]["nodes"]):
                element = raw[node["begin"] : node["end"]]
                patches.append((part, node["begin"], node["end"], markup.text_element(element, text if k == 0 else "")))
    return markup.patched(data, patches)


def round_trip_differences(before: DataFrame, after: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments (``doc_id``, ``location``, ``text``) that differ although no edit
    (``doc_id``, ``location``, ``text``) says so."""
    wanted = before.join(edits.withColumnRenamed("text", "new"), ["doc_id", "location"], "left").select("doc_id", "location", F.coalesce("new", "text").alias("text"))
    lost = wanted.exceptAll(after.select("doc_id", "location", "text")).withColumn("side", F.lit("missing"))
    return lost.unionByName(after.select("doc_id", "location", "text").exceptAll(wanted).withColumn("side", F.lit("unexpected")))


def cardinality(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CARDINALITY.items() for x in kv])[status]
