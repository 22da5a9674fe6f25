"""Views over note cards: computed columns, filters, orders, the figures of a header, a view's text.

Cards have path, size, mtime, summary, concepts, domain, difficulty, cues, cue_summary, note_type, zettel_id,
neighbours and graph_nodes (lists may be null).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.operators.common import top_per

#: Characters of a word for the density estimate, entities of a graph-rich note.
WORD_CHARS, RICH = 6, 5
TYPES = ("permanent", "literature", "fleeting")


def formulas(cards: DataFrame, now: Column) -> DataFrame:
    """Cards with the computed columns that views filter and sort by."""
    length = lambda name: F.coalesce(F.size(F.col(name)), F.lit(0))
    out = cards.withColumns({
        "ext": T.extension(F.col("path")), "density": F.col("size") / WORD_CHARS, "freshness_days": F.datediff(now, F.to_date("mtime")),
        "neighbour_count": F.greatest(length("neighbours"), F.lit(0)), "graph_node_count": F.greatest(length("graph_nodes"), F.lit(0)),
        "cue_count": F.greatest(length("cues"), F.lit(0)), "domain_primary": F.get("domain", F.lit(0)),
    })
    return out.withColumns({f"is_{kind}": F.coalesce(F.col("note_type") == kind, F.lit(False)) for kind in TYPES})


@dataclass(frozen=True)
class View:
    """What a view shows: a filter in SQL, the columns, what it sorts or groups by (and whether downwards)."""

    where: str = "true"
    columns: tuple[str, ...] = ("path", "summary")
    sort: str = "path"
    down: bool = False
    kind: str = "table"
    group: str = ""


VIEWS = {
    "dense": View(columns=("path", "summary", "domain", "difficulty", "note_type", "neighbour_count", "graph_node_count", "density", "freshness_days"), sort="density", down=True),
    "orphans": View("neighbour_count = 0", ("path", "summary", "density"), kind="cards"),
    "graph_rich": View(f"graph_node_count >= {RICH}", ("path", "summary", "graph_node_count", "neighbour_count"), "graph_node_count", True),
    "by_domain": View(columns=("path", "summary", "concepts", "difficulty"), sort="domain_primary", kind="cards", group="domain_primary"),
    "recent": View(columns=("path", "summary", "freshness_days"), sort="freshness_days"),
    "permanent": View("is_permanent", ("zettel_id", "path", "summary", "concepts", "neighbour_count"), "zettel_id"),
    "literature": View("is_literature", ("path", "summary", "cues", "freshness_days"), kind="cards"),
    "fleeting": View("is_fleeting", ("path", "summary", "freshness_days"), "freshness_days"),
    "cued": View("cue_count > 0", ("path", "cue_summary", "cues", "cue_count"), "cue_count", True),
}


def view(rows: DataFrame, name: str) -> DataFrame:
    """The Markdown rows of a view in its order (ties by path); ``rows`` come from ``formulas``."""
    v = VIEWS[name]
    kept = _kept(rows, v).select(*v.columns, F.col(v.sort).cast("string").alias("sorted_by"), F.col(v.sort).alias("_key"))
    return kept.orderBy(F.desc("_key") if v.down else F.asc("_key"), "path").drop("_key")


def _kept(rows: DataFrame, v: View) -> DataFrame:
    return rows.where("ext = 'md'").where(v.where)


def grouped_view(rows: DataFrame, name: str, show: int = 50) -> DataFrame:
    """(group, n, cards) of a view that groups: how many rows a group has and its first ``show`` of them in path
    order, with the view's columns; rows without a value are the group of null."""
    v = VIEWS[name]
    kept = _kept(rows, v).withColumn("group", F.col(v.group))
    counts = kept.groupBy("group").agg(F.count("*").alias("n"))
    first = top_per(kept.select("group", *v.columns), ["group"], [F.asc("path")], show)
    cards = first.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("rank", *v.columns))).alias("cards"))
    return counts.join(cards, counts["group"].eqNullSafe(cards["group"])).select(counts["group"], "n", "cards")


def view_stats(cards: DataFrame) -> DataFrame:
    """One row of counts that a view's header shows."""
    return cards.agg(
        F.count("*").alias("n"), F.count_if(F.size("concepts") > 0).alias("with_concepts"), F.count_if(F.col("one_line_summary") != "").alias("with_summary"),
        *(F.count_if(F.col("note_type") == kind).alias(kind) for kind in reversed(TYPES)),
    )


def type_histogram(cards: DataFrame) -> DataFrame:
    """(note_type, n) of all types, notes without one included."""
    return cards.groupBy(F.coalesce("note_type", F.lit("none")).alias("note_type")).agg(F.count("*").alias("n"))


def domain_list(cards: DataFrame) -> DataFrame:
    """All domains, sorted."""
    return cards.select(F.explode("domain").alias("domain")).distinct().orderBy("domain")


def view_text(name: str, stats: DataFrame) -> DataFrame:
    """A view's definition as numbered lines of YAML under a header of figures."""
    v = VIEWS[name]
    head = [f"# {k}: {n}" for k, n in stats.first().asDict().items()]
    body = ["views:", f"  - type: {v.kind}", f"    name: {name}", "    filters:", '      - file.ext == "md"', f"      - {v.where}", "    order:", *(f"      - {c}" for c in v.columns), "    sort:", f"      - property: {v.sort}", f"        direction: {'DESC' if v.down else 'ASC'}"]
    if v.group:
        body += ["    groupBy:", f"      property: {v.group}", "      direction: ASC"]
    return stats.sparkSession.createDataFrame(list(enumerate(head + body)), "n int, line string")
