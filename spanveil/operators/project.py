"""Smaller operators of a project: cleaning, refinement, levels, versions, batches, audits and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Categories of the levels, institutions that are no personal data, organisation sectors.
LEVEL_CATEGORIES = {
    "BASIC": ("PERSON_NAME", "DNI_NIE", "PHONE", "EMAIL", "ADDRESS", "BANK_ACCOUNT"),
    "INTERMEDIATE": ("PERSON_NAME", "DNI_NIE", "PHONE", "EMAIL", "ADDRESS", "BANK_ACCOUNT", "ORGANIZATION", "LOCATION", "DATE", "IBAN", "CREDIT_CARD"),
    "ADVANCED": ("PERSON_NAME", "DNI_NIE", "PHONE", "EMAIL", "ADDRESS", "BANK_ACCOUNT", "ORGANIZATION", "LOCATION", "DATE", "IBAN", "CREDIT_CARD", "MEDICAL_RECORD", "LICENSE_PLATE", "SOCIAL_SECURITY"),
}
INSTITUTIONS = ("tribunal supremo", "audiencia nacional", "ministerio fiscal", "agencia tributaria", "seguridad social")
SECTORS = {"BANK": ("banco", "caja"), "INSURANCE": ("seguros", "mutua"), "TECH": ("software", "tecnolog"), "LEGAL": ("abogados", "bufete"), "HEALTH": ("clínica", "hospital"), "BUILDING": ("construcc", "inmobili")}
NUMBER_WORDS = ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince", "dieciséis", "diecisiete", "dieciocho", "diecinueve", "veinte", "veintiuno", "veintidós", "veintitrés", "veinticuatro", "veinticinco", "veintiséis", "veintisiete", "veintiocho", "veintinueve", "treinta", "treinta y uno")


def cleaned_entity(x: Column) -> Column:
    """A model's entity without sub-word marks, leading ordinals, further lines and a single capital at the end."""
    first = F.substring_index(F.regexp_replace(F.replace(x, F.lit("##"), F.lit("")), r"^[ªº.\s]+", ""), "\n", 1)
    return F.trim(F.regexp_replace(first, r"\s+[A-ZÁÉÍÓÚÑ]$", ""))


def entity_kept(text: Column, start: Column, end: Column, value: Column) -> Column:
    """Three letters at least, no institution, and not cut out of a longer word."""
    inside = lambda at: F.coalesce(F.substring(text, at, F.lit(1)).rlike(r"[\p{L}\p{N}]"), F.lit(False))
    cut = ((start > 0) & inside(start)) | inside(end + 1)
    return (F.length(value) >= 3) & ~F.exists(F.array(*map(F.lit, INSTITUTIONS)), lambda i: F.lower(value).contains(i)) & ~cut


def validated(detections: DataFrame) -> DataFrame:
    """Verdicts applied: REJECT goes, RECLASSIFY changes the category, FLAG caps the confidence at 0.70."""
    kept = detections.filter("verdict <> 'REJECT'")
    return kept.withColumn("category", F.when(F.col("verdict") == "RECLASSIFY", F.col("new_category")).otherwise(F.col("category"))).withColumn("confidence", F.when(F.col("verdict") == "FLAG", F.least("confidence", F.lit(0.70))).otherwise(F.col("confidence")))


def in_level(category: Column, level: str) -> Column:
    return category.isin(*LEVEL_CATEGORIES[level])


def refined(value: Column, category: Column, after: Column) -> Column:
    """Persons without title, organisations without trailing marks, DNI and postal codes grown by what follows them."""
    person = F.regexp_replace(value, r"(?iu)^(?:don|doña|d\.|dña\.|sr\.|sra\.)\s+", "")
    grown = F.concat(value, F.regexp_extract(after, r"^\s?-?([A-Z])\b", 1))
    return F.when(category == "PERSON_NAME", person).when(category == "ORGANIZATION", F.regexp_replace(value, r"[\s,;]+$", "")).when((category == "DNI_NIE") & value.rlike(r"^\d{8}$"), grown).when((category == "POSTAL_CODE") & value.rlike(r"^\d{4}$"), F.concat(value, F.regexp_extract(after, r"^(\d)", 1))).otherwise(value)


def versions(history: DataFrame, keys: list[str]) -> DataFrame:
    """Each change with its version (from 2 on, the entry itself being 1)."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    return history.withColumn("version", F.row_number().over(w) + 1)


def batch_progress(documents: DataFrame) -> DataFrame:
    """Per batch: total, processed, failed, percent, and FAILED only if all failed."""
    done, failed = F.count_if(F.col("state") == "ANONYMIZED"), F.count_if(F.col("state") == "FAILED")
    s = documents.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), done.alias("processed"), failed.alias("failed"))
    over = F.col("processed") + F.col("failed")
    return s.withColumn("percent", F.round(100.0 * over / F.col("total"), 4)).withColumn("status", F.when(over < F.col("total"), "RUNNING").when(F.col("failed") == F.col("total"), "FAILED").otherwise("COMPLETED"))


def lenient_match(gold: Column, made: Column) -> Column:
    """Containment, or four fifths of the letters at equal places with at most two letters more or less."""
    same = F.size(F.filter(F.arrays_zip(F.split(gold, "").alias("a"), F.split(made, "").alias("b")), lambda p: p["a"] == p["b"]))
    return gold.contains(made) | made.contains(gold) | ((F.abs(F.length(gold) - F.length(made)) <= 2) & (same >= 0.8 * F.greatest(F.length(gold), F.length(made))))


def repeated_starts(sentences: DataFrame, n: int = 30, more_than: int = 10) -> DataFrame:
    """Starts of sentences that stand too often in a dataset."""
    return sentences.groupBy(F.substring("text", 1, n).alias("head")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def token_labels(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """B-/I-/O labels of tokens from entity spans that touch them; the first token of an entity begins it."""
    t, e = tokens.alias("t"), entities.alias("e")
    hit = (F.col("t.doc_id") == F.col("e.doc_id")) & (F.col("t.start") < F.col("e.end")) & (F.col("e.start") < F.col("t.end"))
    rows = t.join(e, hit, "left").select("t.doc_id", "t.start", "t.end", F.col("e.start").alias("es"), F.col("e.type").alias("type"))
    one = rows.groupBy("doc_id", "start", "end").agg(F.min(F.struct("es", "type")).alias("x")).select("doc_id", "start", "end", "x.*")
    w = Window.partitionBy("doc_id", "es").orderBy("start")
    return one.withColumn("n", F.row_number().over(w)).select("doc_id", "start", F.when(F.col("type").isNull(), "O").when(F.col("n") == 1, F.concat(F.lit("B-"), "type")).otherwise(F.concat(F.lit("I-"), "type")).alias("label"))


def sector(name: Column) -> Column:
    out = F.lit("OTHER")
    for k, words in reversed(SECTORS.items()):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(name).contains(w)), k).otherwise(out)
    return out


def gender(name: Column) -> Column:
    """By title, then by the ending of the first name."""
    first = F.lower(F.substring_index(F.regexp_replace(name, r"(?iu)^(?:don|doña|d\.|dña\.|sr\.|sra\.)\s+", ""), " ", 1))
    return F.when(name.rlike(r"(?iuU)^(?:doña|dña\.|sra\.)"), "F").when(name.rlike(r"(?iuU)^(?:don|d\.|sr\.)(?:\s|$)"), "M").when(first.endswith("a"), "F").otherwise("M")


def in_words(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, NUMBER_WORDS)), n.cast("int"))


def token_sorted(x: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.lower(F.trim(x)), r"\s+")), " ")


def segments(replacements: DataFrame, documents: DataFrame) -> DataFrame:
    """Entity and plain segments of texts in order: doc_id, start, end, is_entity."""
    w = Window.partitionBy("doc_id").orderBy("start")
    r = replacements.select("doc_id", "start", "end").withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    plain = r.select("doc_id", F.col("before").alias("start"), F.col("start").alias("end"), F.lit(False).alias("is_entity"))
    last = r.groupBy("doc_id").agg(F.max("end").alias("start")).join(documents.select("doc_id", F.length("text").alias("end")), "doc_id").select("doc_id", "start", "end", F.lit(False).alias("is_entity"))
    return r.select("doc_id", "start", "end", F.lit(True).alias("is_entity")).unionByName(plain).unionByName(last).filter("end > start")


def resolved_aliases(keys: DataFrame) -> DataFrame:
    """Aliases that equal texts of other categories share: the first category's alias stands for all.

    keys: project_id, category, norm_key, alias, first_doc_seq.
    """
    w = Window.partitionBy("project_id", "norm_key").orderBy("first_doc_seq", "category")
    return keys.withColumn("shared_alias", F.first("alias").over(w))
