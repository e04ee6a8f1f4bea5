"""Filters, joins and votes over detections (doc_id, start, end, category, confidence, source, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.functions import spans

# Weights and priorities of the vote and of replacement.
WEIGHTS = {"regex": 5.0, "roberta": 2.0, "presidio": 1.5, "spacy": 1.0}
OTHER_WEIGHT = 0.5
BONUS = {
    "regex": {"DNI_NIE": 3.0, "IBAN": 3.0, "EMAIL": 3.0, "CREDIT_CARD": 2.5, "SOCIAL_SECURITY": 2.5, "CASE_NUMBER": 2.5, "PHONE": 2.0, "LICENSE_PLATE": 2.0, "DATE": 1.5},
    "roberta": {"PERSON_NAME": 1.0, "ORGANIZATION": 0.5, "LOCATION": 0.5},
    "spacy": {"PERSON_NAME": 1.0, "LOCATION": 0.3},
    "presidio": {"DATE": 0.5},
}
RISK = {"PERSON_NAME": 100, "DNI_NIE": 95, "MEDICAL_RECORD": 90, "SOCIAL_SECURITY": 88, "PHONE": 85, "EMAIL": 80, "IBAN": 75, "BANK_ACCOUNT": 70, "CREDIT_CARD": 70, "ADDRESS": 65, "PASSPORT": 60, "ORGANIZATION": 50, "LOCATION": 40, "DATE": 30, "LICENSE_PLATE": 25, "POSTAL_CODE": 20, "MISC": 10}
OVERLAP_PRIORITY = {"PERSON_NAME": 100, "DNI_NIE": 95, "SOCIAL_SECURITY": 90, "PHONE": 85, "EMAIL": 80, "IBAN": 75, "CREDIT_CARD": 70, "ADDRESS": 65, "LOCATION": 60, "PASSPORT": 55, "ORGANIZATION": 50, "DATE": 40, "POSTAL_CODE": 35, "LICENSE_PLATE": 30, "CASE_NUMBER": 20}
TIE = 0.3
COMPATIBLE = ({"LOCATION", "ADDRESS"}, {"DNI_NIE", "PASSPORT"}, {"IBAN", "BANK_ACCOUNT", "CREDIT_CARD"})
CHECKSUM_CATEGORIES = ("DNI_NIE", "IBAN", "SOCIAL_SECURITY", "CREDIT_CARD", "NIG")
ZONES = {
    "doi": r"(?i)\b(?:doi:\s*|https?://(?:dx\.)?doi\.org/)?10\.\d{4,9}/\S+",
    "orcid": r"\b\d{4}-\d{4}-\d{4}-\d{3}[\dX]\b",
    "issn": r"(?i)\bISSN[:\s]*\d{4}-\d{3}[\dX]\b",
    "isbn": r"(?i)\bISBN(?:-1[03])?[:\s]*[\d-]{10,17}\b",
    "url": r"(?i)\bhttps?://[^\s<>\"]+",
}


def lookup(column: Column, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column], F.lit(default))


def weight(source: Column, category: Column) -> Column:
    bonus = F.lit(0.0)
    for s, table in BONUS.items():
        bonus = F.when(source == s, lookup(category, table, 0.0)).otherwise(bonus)
    return lookup(source, WEIGHTS, OTHER_WEIGHT) + bonus


def compatible(a: Column, b: Column) -> Column:
    out = a == b
    for group in COMPATIBLE:
        out = out | (a.isin(*group) & b.isin(*group))
    return out


def outside_zones(detections: DataFrame, zones: DataFrame, contained: bool = False) -> DataFrame:
    """Detections that overlap no zone of their document (or lie in none): a range anti join on the document."""
    d, z = detections.alias("d"), zones.alias("z")
    hit = (F.col("d.start") >= F.col("z.start")) & (F.col("d.end") <= F.col("z.end")) if contained else spans.overlap(F.col("d.start"), F.col("d.end"), F.col("z.start"), F.col("z.end"))
    return d.join(z, (F.col("d.doc_id") == F.col("z.doc_id")) & hit, "left_anti")


def zones_of(documents: DataFrame) -> DataFrame:
    """Places of DOI, ORCID, ISSN, ISBN and URL in texts."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(spans.extract(F.col("text"), pattern), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    found = F.flatten(F.array(*[of(k, p) for k, p in ZONES.items()]))
    return documents.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


def not_nested(detections: DataFrame, least: float = 0.7, key: str = "id") -> DataFrame:
    """Detections strictly inside no longer compatible one of enough confidence."""
    d, c = detections.alias("d"), detections.alias("c")
    inside = (F.col("c.start") <= F.col("d.start")) & (F.col("c.end") >= F.col("d.end")) & (F.col("c.end") - F.col("c.start") > F.col("d.end") - F.col("d.start"))
    return d.join(c, (F.col("d.doc_id") == F.col("c.doc_id")) & inside & (F.col("c.confidence") >= least) & compatible(F.col("d.category"), F.col("c.category")), "left_anti")


def overlap_groups(detections: DataFrame) -> DataFrame:
    """group_no of runs of overlapping spans in a document, by a sweep over starts."""
    w = Window.partitionBy("doc_id").orderBy("start", "end", "id")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return detections.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("group_no", F.sum("_new").over(w)).drop("_new")


def close_pairs(detections: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of spans of a document whose intersection is at least that share of their union."""
    a, b = detections.alias("a"), detections.alias("b")
    near = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.id") < F.col("b.id")) & spans.overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    return a.join(b, near).select(F.col("a.doc_id"), F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), spans.iou(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")).alias("iou")).filter(F.col("iou") >= least)


def voted(grouped: DataFrame) -> DataFrame:
    """Per group of spans the category of most weighted confidence, near ties to the higher risk, and its span."""
    score = F.round(F.sum(F.col("confidence") * weight(F.col("source"), F.col("category"))), 6)
    by = grouped.groupBy("doc_id", "group_no", "category").agg(score.alias("score"), F.max_by(F.struct("start", "end"), F.struct((F.col("end") - F.col("start")).alias("n"), F.round(F.col("confidence") * weight(F.col("source"), F.col("category")), 6).alias("w"), F.col("id"))).alias("span"))
    top = by.groupBy("doc_id", "group_no").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", lookup(F.col("category"), RISK, 0).alias("risk"), "category", "span")), asc=False), 1, 2).alias("top"))
    first, second = F.col("top")[0], F.get(F.col("top"), F.lit(1))
    chosen = F.when(second.isNotNull() & (F.round(first["score"] - second["score"], 6) < TIE) & (second["risk"] > first["risk"]), second).otherwise(first)
    return top.select("doc_id", "group_no", chosen.alias("x")).select("doc_id", "group_no", "x.category", "x.score", "x.span.start", "x.span.end")


def without_overlaps(detections: DataFrame, gap: int = 10) -> DataFrame:
    """Greedy by (priority, confidence, length): overlapping spans of less go, and addresses next to a kept one."""
    rank = F.struct((-lookup(F.col("category"), OVERLAP_PRIORITY, 0)).alias("p"), (-F.col("confidence")).alias("c"), (F.col("start") - F.col("end")).alias("n"), F.col("start"), F.col("end"), F.col("category"), F.col("value"), F.col("confidence"))
    ranked = F.array_sort(F.collect_list(rank))
    places = ("ADDRESS", "LOCATION")
    clash = lambda k, s: ((k["start"] < s["end"]) & (s["start"] < k["end"])) | (k["category"].isin(*places) & s["category"].isin(*places) & (k["category"] != s["category"]) & (F.greatest(k["start"], s["start"]) - F.least(k["end"], s["end"]) <= gap))
    kept = F.aggregate("r", F.slice("r", 1, 0), lambda kept, s: F.when(F.exists(kept, lambda k: clash(k, s)), kept).otherwise(F.concat(kept, F.array(s))))
    return detections.groupBy("doc_id").agg(ranked.alias("r")).select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.start", "x.end", "x.category", "x.value", "x.confidence")


def snapped(detections: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans grown to the tokens they touch."""
    d, t = detections.alias("d"), tokens.alias("t")
    hit = (F.col("d.doc_id") == F.col("t.doc_id")) & spans.overlap(F.col("d.start"), F.col("d.end"), F.col("t.start"), F.col("t.end"))
    grown = d.join(t, hit, "left").groupBy("d.id", "d.doc_id", "d.start", "d.end").agg(F.min("t.start").alias("s"), F.max("t.end").alias("e"))
    return grown.select("id", "doc_id", F.least("start", F.coalesce("s", "start")).alias("start"), F.greatest("end", F.coalesce("e", "end")).alias("end"))


def zone(confidence: Column, category: Column, valid: Column) -> Column:
    """RED below 0.40; AMBER below 0.85 or with a failed checksum; else GREEN."""
    return F.when(confidence < 0.40, "RED").when((confidence < 0.85) | (category.isin(*CHECKSUM_CATEGORIES) & ~F.coalesce(valid, F.lit(True))), "AMBER").otherwise("GREEN")


def boosted(detections: DataFrame) -> DataFrame:
    """Bare first names of persons known with confidence 0.90 rise from below 0.75 to 0.85 in their document."""
    first = F.lower(F.element_at(F.split(F.regexp_replace("value", r"(?iu)^(?:don|doña|d\.|dña\.|sr\.|sra\.)\s+", ""), r"\s+"), 1))
    known = detections.filter((F.col("category") == "PERSON_NAME") & (F.col("confidence") >= 0.90)).select("doc_id", first.alias("name")).filter("length(name) >= 3").distinct()
    same = (F.col("d.doc_id") == F.col("k.doc_id")) & (F.lower("d.value") == F.col("k.name"))
    raised = F.when(F.col("k.name").isNotNull() & (F.col("d.category") == "PERSON_NAME") & (F.col("d.confidence") < 0.75), 0.85).otherwise(F.col("d.confidence"))
    return detections.alias("d").join(known.alias("k"), same, "left").select("d.*", raised.alias("_c")).drop("confidence").withColumnRenamed("_c", "confidence")
