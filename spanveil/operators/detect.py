"""Detectors: documents to rows of detections (doc_id, pattern_no, category, value, start, end, confidence, source)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.functions import checks, spans
from spanveil.operators.patterns import PATTERNS, Pattern

SCHEMA = "doc_id long, pattern_no int, category string, value string, start int, end int, confidence double, source string"

Detector = Callable[[DataFrame], DataFrame]
_REGISTRY: dict[str, Detector] = {}


def register(name: str, detector: Detector) -> None:
    """Add a detector: a function of documents (doc_id, text) that returns rows of SCHEMA."""
    _REGISTRY[name] = detector


def unregister(name: str) -> None:
    _REGISTRY.pop(name, None)


def detect_all(documents: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The union of all registered detectors' rows."""
    return reduce(DataFrame.unionByName, [_REGISTRY[n](documents) for n in names or sorted(_REGISTRY)])


def native_detector(documents: DataFrame, patterns: Sequence[Pattern], source: str = "regex") -> DataFrame:
    """Whole matches of patterns without a group rule, extracted in the JVM; the first pattern wins a span."""

    def of(p: Pattern) -> Column:
        return F.transform(spans.extract(F.col("text"), p.jvm), lambda s: F.struct(F.lit(p.number).alias("pattern_no"), F.lit(p.category).alias("category"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.lit(p.confidence).alias("confidence")))

    rows = documents.select("doc_id", F.explode(F.flatten(F.array(*map(of, patterns)))).alias("x")).select("doc_id", "x.*", F.lit(source).alias("source"))
    return first_pattern(rows)


def first_pattern(rows: DataFrame) -> DataFrame:
    """Of detections of one span, that of the first pattern."""
    w = Window.partitionBy("doc_id", "start", "end").orderBy("pattern_no")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _entity(p: Pattern, m: re.Match) -> tuple[str, int, int] | None:
    """The group rule: text before group 1 leaves group 1; organisations of several groups are joined; else the match."""
    if m.re.groups and m.start(1) > m.start():
        return m[1], m.start(1), m.end(1)
    if p.category == "ORGANIZATION" and m.re.groups >= 2:
        joined = " ".join(g for g in m.groups() if g)
        return (joined, m.start(), m.end()) if len(joined) == m.end() - m.start() else None
    return m[0], m.start(), m.end()


def regex_detector(documents: DataFrame, categories: Sequence[str] | None = None, min_confidence: float = 0.5, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """The whole pattern table with its group rule and checksum validators; one Arrow pass over the documents."""
    chosen = [p for p in patterns if (not categories or p.category in categories) and p.confidence >= min_confidence]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(p, re.compile(p.regex, 0 if p.case_sensitive else re.IGNORECASE), bool(re.search(r"\\d|\[0-9\]", p.regex)), "@" in p.regex) for p in chosen]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                digits, at, seen = bool(re.search(r"\d", text)), "@" in text, set()
                for p, r, needs_digit, needs_at in compiled:
                    if (needs_digit and not digits) or (needs_at and not at):
                        continue
                    for m in r.finditer(text):
                        e = _entity(p, m)
                        if e and e[1] < e[2] and e[1:] not in seen:
                            seen.add(e[1:])
                            out.append((doc, p.number, p.category, *e, p.confidence, p.validator))
            columns = list(zip(*out)) or [[]] * 8
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "pattern_no", "category", "value", "start", "end", "confidence", "validator"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, pattern_no int, category string, value string, start int, end int, confidence double, validator string")
    checked = checks.live_confidence(F.col("confidence"), F.when(F.col("validator").isNotNull(), F.coalesce(checks.valid_by_type(F.col("validator"), F.col("value")), F.lit(False))))
    return rows.withColumn("confidence", checked).filter(F.col("confidence") >= min_confidence).select("doc_id", "pattern_no", "category", "value", "start", "end", "confidence", F.lit("regex").alias("source"))


def chunks(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Fixed-stride chunks: array<struct<chunk_no, offset, chunk>>."""
    n = F.greatest(F.ceil((F.length(text) - overlap) / (size - overlap)), F.lit(1))
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.struct(i.alias("chunk_no"), (i * (size - overlap)).alias("offset"), F.substring(text, i * (size - overlap) + 1, F.lit(size)).alias("chunk")))


def bio_entities(tokens: DataFrame) -> DataFrame:
    """Entities of B-/I-/O labels: sent_id, label, start, end, n_tokens, confidence, by gaps and islands."""
    w = Window.partitionBy("sent_id").orderBy("tok_no")
    kind = F.when(F.col("label") != "O", F.substring("label", 3, 100))
    marked = tokens.withColumn("kind", kind).withColumn("begins", F.when(F.col("label").startswith("B-") | (F.col("kind").isNotNull() & ~F.lag("kind").over(w).eqNullSafe(F.col("kind"))), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("begins").over(w)).filter("kind IS NOT NULL")
    return island.groupBy("sent_id", "island", F.col("kind").alias("entity")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_tokens"), F.avg("confidence").alias("confidence")).drop("island")


def repaired(text: Column, value: Column, start: Column, end: Column) -> Column:
    """A model's span where its text stands there, else where the text first stands, else null."""
    right = F.substring(text, start + 1, end - start) == value
    at = F.coalesce(F.nullif(F.instr(text, value), F.lit(0)), F.nullif(F.instr(F.lower(text), F.lower(value)), F.lit(0)))
    return F.when(right, F.struct(start.alias("start"), end.alias("end"))).when(at.isNotNull(), F.struct((at - 1).alias("start"), (at - 1 + F.length(value)).alias("end")))


def json_entities(answer: Column) -> Column:
    """Entities of the JSON array or object inside a model's prose."""
    item = "array<struct<text: string, category: string, start: int, end: int>>"
    array = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), item)
    return F.coalesce(array, F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), f"struct<entities: {item}>")["entities"])


def hybrid(model: DataFrame, rules: DataFrame, model_weight: float = 0.6, rules_weight: float = 0.4) -> DataFrame:
    """Two detectors on equal spans: one category adds a tenth to the higher confidence, two keep the higher one."""
    a, b = model.alias("a"), rules.alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end"))
    ca, cb = F.col("a.confidence") * model_weight, F.col("b.confidence") * rules_weight
    return a.join(b, on, "full").select(
        F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("a.start", "b.start").alias("start"), F.coalesce("a.end", "b.end").alias("end"),
        F.when(cb.isNull() | (ca >= cb), F.col("a.category")).otherwise(F.col("b.category")).alias("category"),
        F.when(F.col("a.category") == F.col("b.category"), F.least(F.greatest(ca, cb) + 0.1, F.lit(1.0))).otherwise(F.greatest(ca, cb)).alias("confidence"),
    )


register("regex", regex_detector)
