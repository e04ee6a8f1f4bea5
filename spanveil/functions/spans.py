"""Spans of texts: extraction without a UDF, overlap measures, folds over sorted spans, and stitching.

Offsets count code points, start inclusive, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\u0001", "\u0002"


def extract(text: Column, pattern: str, group: int = 0, prefix_group: int | None = None) -> Column:
    """array<struct<start, end, value>> of all matches, by marks put around them.

    The text must hold neither mark (ingestion removes control characters).
    """
    return marked_spans(F.regexp_replace(text, pattern, f"{OPEN}${group}{CLOSE}"))


def marked_spans(marked: Column) -> Column:
    # Everything before the first mark is text; each later part is value, closing mark, text.  The parts are read once.
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start: int, end: int, value: string>>").alias("found"))

    def step(a: Column, p: Column) -> Column:
        n, head = F.instr(p, CLOSE) - 1, a["at"] < 0
        one = F.struct(a["at"].alias("start"), (a["at"] + n).cast("int").alias("end"), F.substring(p, F.lit(1), n).alias("value"))
        return F.struct(
            F.when(head, F.length(p)).otherwise(a["at"] + F.length(p) - 1).cast("int").alias("at"),
            F.when(head, a["found"]).otherwise(F.concat(a["found"], F.array(one))).alias("found"),
        )

    return F.aggregate(F.split(marked, OPEN), start, step)["found"]


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two spans, as a share of characters."""
    inter = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    return inter / (F.greatest(e1, e2) - F.least(s1, s2))


def left_to_right(spans: Column) -> Column:
    """Greedy choice in order of (start, longest first): a span that begins before the last kept one ends is dropped."""
    kept = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.slice(spans, 1, 0).alias("kept")),
        lambda a, s: F.when(s["start"] >= a["end"], F.struct(s["end"].alias("end"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a),
    )
    return kept["kept"]


def greedy(ranked: Column, adjacent: Column | None = None) -> Column:
    """Keep spans in the given order unless they overlap a kept one."""
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s))))


def stitch(text: Column, spans: Column, alias: str = "alias") -> Column:
    """The text with spans (sorted, not overlapping) replaced; a blank follows an alias that would touch a letter or digit."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            s["end"].cast("int").alias("at"),
            F.concat(a["out"], F.substring(text, a["at"] + 1, (s["start"] - a["at"]).cast("int")), s[alias], F.when(F.substring(text, (s["end"] + 1).cast("int"), F.lit(1)).rlike(r"[\p{L}\p{N}]"), " ").otherwise("")).alias("out"),
        ),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def restored(start: Column, end: Column, char_map: Column) -> tuple[Column, Column]:
    """A span of the normalised text in the source, by the source position of each character."""
    n = F.size(char_map)
    return F.element_at(char_map, F.least(start + 1, n)), F.element_at(char_map, F.least(F.greatest(end, F.lit(1)), n)) + 1
