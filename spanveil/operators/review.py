"""Review, export gate, document types, states, and scoring of detections against labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.functions import spans

# Patterns of the export gate (kind, pattern, severity).
GATE = (
    ("DNI/NIE", r"\b[0-9]{8}[A-Za-z]\b", "CRITICAL"),
    ("NIE", r"\b[XYZxyz][0-9]{7}[A-Za-z]\b", "CRITICAL"),
    ("Número Seguridad Social", r"\b\d{2}/\d{8}/\d{2}\b", "CRITICAL"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{2}[-\s]?\d{10}\b", "CRITICAL"),
    ("IBAN España", r"\bES\d{22}\b", "CRITICAL"),
    ("Tarjeta Crédito", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b", "CRITICAL"),
    ("Número Tarjeta", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "CRITICAL"),
    ("Pasaporte", r"\b[A-Z]{2}[0-9]{7}\b", "HIGH"),
    ("Email", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "HIGH"),
    ("Teléfono", r"\b(?:\+34|0034)?[6789]\d{8}\b", "HIGH"),
)
# Values that the gate lets through (aliases, case numbers).
PASSES = (r"^[A-Za-z]+_\d+$", r"^\d+/\d{4}$")
# Patterns of the head of a text by document type.
TYPES = {
    "SENTENCIA": (r"SENTENCIA", r"JUZGADO", r"TRIBUNAL", r"FALLO", r"MAGISTRAD[OA]", r"SALA\s+DE\s+LO", r"AUDIENCIA\s+PROVINCIAL", r"EN\s+NOMBRE\s+DEL\s+REY"),
    "ESCRITURA": (r"ESCRITURA", r"NOTAR[IÍ]", r"PROTOCOLO", r"OTORGAMIENTO", r"FE\s+P[UÚ]BLICA", r"COMPARECE[N]?"),
    "FACTURA": (r"FACTURA", r"BASE\s+IMPONIBLE", r"IVA", r"N[UÚ]MERO\s+DE\s+FACTURA", r"CONCEPTO\s+IMPORTE", r"TOTAL\s+FACTURA"),
    "RECURSO": (r"RECURSO", r"APELACI[OÓ]N", r"CASACI[OÓ]N", r"SUPLICACI[OÓ]N", r"RECURRENTE"),
    "DENUNCIA": (r"DENUNCIA", r"ATESTADO", r"DILIGENCIAS\s+PREVIAS", r"QUERELLA"),
    "CONTRATO": (r"CONTRATO", r"CL[AÁ]USULA", r"PARTES\s+CONTRATANTES", r"ESTIPULACIONES"),
}
# Legal moves of document states, sanity rules.
MOVES = (("PENDING", "INGESTED"), ("INGESTED", "DETECTING"), ("DETECTING", "DETECTED"), ("DETECTED", "ANONYMIZING"), ("ANONYMIZING", "ANONYMIZED"))
SANITY = (("ESCRITURA", "PERSON_NAME", 1, "CRITICAL"), ("ESCRITURA", "DNI_NIE", 1, "CRITICAL"), ("SENTENCIA", "DATE", 1, "WARNING"), ("FACTURA", "ORGANIZATION", 1, "WARNING"), ("DENUNCIA", "PERSON_NAME", 1, "WARNING"))


def violations(text: Column, strict: bool = True) -> Column:
    """Personal data left in a text, by pattern, then place: array<struct<no, kind, severity, value, start>>.

    Case is folded; without ``strict`` only critical kinds count; aliases and
    case numbers are let through.
    """

    def of(no: int, kind: str, pattern: str, severity: str) -> Column:
        found = F.filter(spans.extract(text, f"(?iu){pattern}"), lambda s: ~reduce(lambda a, p: a | s["value"].rlike(p), PASSES, F.lit(False)))
        return F.transform(found, lambda s: F.struct(F.lit(no).alias("no"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), s["value"].alias("value"), s["start"].alias("start")))

    return F.flatten(F.array(*[of(i, *g) for i, g in enumerate(GATE) if strict or g[2] == "CRITICAL"]))


def gate(texts: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of violations: doc_id, no, kind, severity, value, start."""
    return texts.select("doc_id", F.explode(violations(F.col("text"), strict)).alias("x")).select("doc_id", "x.*")


def gate_report(texts: DataFrame, most: int = 10, strict: bool = True) -> DataFrame:
    """Per document with violations: counts by severity and the first ones, redacted."""
    found = texts.select("doc_id", violations(F.col("text"), strict).alias("v")).filter(F.size("v") > 0)
    n = lambda severity: F.size(F.filter("v", lambda x: x["severity"] == severity)).cast("long")
    redacted = lambda v: F.when(F.length(v) > 4, F.concat(F.substring(v, 1, 3), F.lit("***"), F.substring(v, -1, 1))).otherwise("***")
    first = F.transform(F.slice("v", 1, most), lambda x: F.concat_ws(":", x["kind"], redacted(x["value"])))
    return found.select("doc_id", n("CRITICAL").alias("critical"), n("HIGH").alias("high"), F.array_join(first, ",").alias("first"))


def exported(texts: DataFrame, path: str, strict: bool = True) -> int:
    """Write the texts that the gate passes, one a line; the number that it refuses."""
    checked = texts.select("doc_id", "text", F.size(violations(F.col("text"), strict)).alias("n"))
    checked.filter("n = 0").select(F.regexp_replace("text", r"\R", " ").alias("value")).write.text(path)
    return checked.filter("n > 0").count()


def review_summary(reviews: DataFrame) -> DataFrame:
    """Per document: total, reviewed, approved, rejected, corrected, pending, progress (100 if empty), by each entity's latest action."""
    w = Window.partitionBy("doc_id", "entity_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    latest = reviews.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    n = lambda a: F.count_if(F.col("action") == a)
    counts = latest.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), n("approve").alias("approved"), n("reject").alias("rejected"), n("correct").alias("corrected"))
    done = F.col("approved") + F.col("rejected") + F.col("corrected")
    return counts.withColumn("reviewed", done).withColumn("pending", F.col("total") - done).withColumn("progress", F.when(F.col("total") == 0, 100.0).otherwise(F.round(done * 100.0 / F.col("total"), 4)))


def classified(documents: DataFrame, header: int = 500) -> DataFrame:
    """doc_id, type and score: the largest share of a type's patterns in the head of the text; GENERIC at 0."""
    head = F.upper(F.substring("text", 1, header))
    scores = F.array(*[F.struct((sum((F.when(head.rlike(w), 1).otherwise(0) for w in words), F.lit(0)) / len(words)).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("type")) for i, (k, words) in enumerate(TYPES.items())])
    best = F.array_max(scores)
    return documents.select("doc_id", F.when(best["score"] > 0, best["type"]).otherwise("GENERIC").alias("type"), F.round(best["score"], 4).alias("score"))


def illegal_moves(states: DataFrame) -> DataFrame:
    """Changes of state that the machine does not allow; any state may fail.  states: doc_id, ts, event_id, state."""
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    pairs = states.withColumn("before", F.lag("state").over(w)).filter("before IS NOT NULL AND state <> 'FAILED'")
    allowed = F.concat_ws(">", "before", "state").isin(*[f"{a}>{b}" for a, b in MOVES])
    return pairs.filter(~allowed).select("doc_id", "event_id", "before", "state")


def export_checks(types: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document: sanity rules of its type that fail by severity, and whether it can be exported."""
    rules = types.sparkSession.createDataFrame(SANITY, "type string, category string, least int, severity string")
    tested = types.join(F.broadcast(rules), "type", "left").join(counts, ["doc_id", "category"], "left")
    failed = F.col("category").isNotNull() & (F.coalesce("n", F.lit(0)) < F.col("least"))
    return tested.groupBy("doc_id").agg(F.count_if(failed & (F.col("severity") == "CRITICAL")).alias("critical"), F.count_if(failed & (F.col("severity") == "WARNING")).alias("warnings")).withColumn("can_export", F.col("critical") == 0)


def semeval(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per case COR, INC, PAR, MIS, SPU by strict, boundary and partial passes.

    gold and predicted: case_id, start, end, type; spans of one side do not
    overlap, so each pass matches by keys.
    """
    g, p = gold.alias("g"), predicted.alias("p")
    pairs = g.join(p, (F.col("g.case_id") == F.col("p.case_id")) & spans.overlap(F.col("g.start"), F.col("g.end"), F.col("p.start"), F.col("p.end")))
    exact = (F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end"))
    rank = F.when(exact & (F.col("g.type") == F.col("p.type")), 1).when(exact, 2).otherwise(3)
    rows = pairs.select(F.col("g.case_id"), F.col("g.start").alias("gs"), F.col("p.start").alias("ps"), rank.alias("rank"))
    of = lambda side: Window.partitionBy("case_id", side).orderBy("rank", "gs", "ps")
    best = rows.withColumn("a", F.row_number().over(of("gs"))).withColumn("b", F.row_number().over(of("ps"))).filter("a = 1 AND b = 1")
    matched = best.groupBy("case_id").agg(F.count_if(F.col("rank") == 1).alias("cor"), F.count_if(F.col("rank") == 2).alias("inc"), F.count_if(F.col("rank") == 3).alias("par"), F.count(F.lit(1)).alias("m"))
    sizes = gold.groupBy("case_id").agg(F.count(F.lit(1)).alias("pos")).join(predicted.groupBy("case_id").agg(F.count(F.lit(1)).alias("act")), "case_id", "full").join(matched, "case_id", "left").na.fill(0)
    return sizes.select("case_id", "cor", "inc", "par", (F.col("pos") - F.col("m")).alias("mis"), (F.col("act") - F.col("m")).alias("spu"), "pos", "act")


def scores(cases: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1, strict and partial (a partial match counts half); 0 where undefined."""
    s = cases.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("cor", "inc", "par", "mis", "spu", "pos", "act")])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    half = F.col("cor") + 0.5 * F.col("par")
    p, r, pp, pr = share(F.col("cor"), F.col("act")), share(F.col("cor"), F.col("pos")), share(half, F.col("act")), share(half, F.col("pos"))
    f1 = lambda x, y: F.round(F.when(x + y > 0, 2 * x * y / (x + y)).otherwise(0.0), 6)
    return s.select(*by, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), f1(p, r).alias("f1"), f1(pp, pr).alias("partial_f1"))


def boundary(gold: Column, predicted: Column) -> Column:
    return F.when(gold == predicted, "exact").when(predicted.contains(gold), "over_extended").when(gold.contains(predicted), "truncated").otherwise("partial_overlap")
