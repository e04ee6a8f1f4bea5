"""Recognisers: patterns with a validator and context words, research identifiers, written dates, and overlaps that keep nested spans.

All are column expressions over whole texts.  Texts must hold neither mark of
``spans`` (ingestion removes control characters); null texts give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import checks, spans
from spanveil.operators.merge import lookup

# Label, name, pattern, score; matched without regard to case.
RECOGNISERS = (
    ("ES_DNI", "DNI_WITH_SEPARATOR", r"\b(\d{2}[.\-\s]?\d{3}[.\-\s]?\d{3}[.\-\s]?[A-Za-z])\b", 0.7),
    ("ES_DNI", "DNI_COMPACT", r"\b(\d{8}[A-Za-z])\b", 0.85),
    ("ES_DNI", "DNI_WITH_FINAL_SEPARATOR", r"\b(\d{8}[\-\s][A-Za-z])\b", 0.85),
    ("ES_DNI", "DNI_WITH_PREFIX", r"(?:DNI|NIF|D\.N\.I\.?|N\.I\.F\.?)[:\s]+(\d{8}[\-\s]?[A-Za-z])", 0.95),
    ("ES_NIE", "NIE_WITH_SEPARATOR", r"\b([XYZxyz][.\-\s]?\d{7}[.\-\s]?[A-Za-z])\b", 0.7),
    ("ES_NIE", "NIE_COMPACT", r"\b([XYZxyz]\d{7}[A-Za-z])\b", 0.85),
    ("ES_CIF", "CIF_WITH_SEPARATOR", r"\b([A-HJ-NP-SUVW][.\-\s]?\d{2}[.\-\s]?\d{3}[.\-\s]?\d{3})\b", 0.6),
    ("ES_CIF", "CIF_COMPACT", r"\b([A-HJ-NP-SUVW]\d{7}[A-J0-9])\b", 0.75),
    ("ES_NSS", "NSS_WITH_SEPARATOR", r"\b(\d{2}[/\-\s]\d{8}[/\-\s]\d{2})\b", 0.75),
    ("ES_NSS", "NSS_COMPACT", r"\b(\d{12})\b", 0.4),
    ("ES_IBAN", "IBAN_SPACED", r"\b(ES\d{2}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4})\b", 0.9),
    ("ES_IBAN", "IBAN_COMPACT", r"\b(ES\d{22})\b", 0.85),
    ("ES_IBAN", "CCC_FORMAT", r"\b(\d{4}[\s\-]?\d{4}[\s\-]?\d{2}[\s\-]?\d{10})\b", 0.6),
    ("ES_PHONE", "PHONE_INTERNATIONAL", r"(?<![+\d])(\+34[\s\-.]?\d{3}[\s\-.]?\d{3}[\s\-.]?\d{3})(?!\d)", 0.9),
    ("ES_PHONE", "PHONE_INTERNATIONAL_00", r"(?<!\d)(0034[\s\-.]?\d{3}[\s\-.]?\d{3}[\s\-.]?\d{3})(?!\d)", 0.85),
    ("ES_PHONE", "PHONE_MOBILE_SPACED", r"\b([67]\d{2}[\s\-\.]\d{3}[\s\-\.]\d{3})\b", 0.8),
    ("ES_PHONE", "PHONE_LANDLINE_SPACED", r"\b([89]\d{2}[\s\-\.]\d{3}[\s\-\.]\d{3})\b", 0.7),
    ("ES_PHONE", "PHONE_COMPACT", r"\b([6789]\d{8})\b", 0.6),
)
# Words that raise a score when they stand before a span.
CONTEXT = {
    "ES_DNI": ("dni", "documento", "identidad", "nacional", "nif", "identificación", "identificacion", "número", "numero"),
    "ES_NIE": ("nie", "extranjero", "residencia", "identificación", "identificacion", "número", "numero", "tarjeta"),
    "ES_CIF": ("cif", "fiscal", "empresa", "sociedad", "compañía", "compania", "mercantil", "nif", "identificación fiscal"),
    "ES_NSS": ("seguridad social", "nss", "afiliación", "afiliacion", "número de afiliación", "numero de afiliacion", "ss"),
    "ES_IBAN": ("iban", "cuenta", "bancaria", "banco", "transferencia", "ingreso", "domiciliación", "domiciliacion", "pago", "ccc", "número de cuenta", "numero de cuenta"),
    "ES_PHONE": ("teléfono", "telefono", "móvil", "movil", "celular", "tel", "tfno", "telf", "contacto", "llamar", "número", "numero", "fijo", "particular", "whatsapp"),
}
CONTEXT_RISE, CONTEXT_LEAST, CONTEXT_WORDS = 0.35, 0.4, 5

# Category, name, pattern, confidence of research identifiers; matched without regard to case but for CASE_KEPT.
CASE_KEPT = ("IBAN",)
RESEARCH = (
    ("DNI_NIE", "dni_standard", r"\b(\d{8})\s*([A-Z])\b", 0.95),
    ("DNI_NIE", "dni_spaced_2_3_3", r"\b(\d{2})\s+(\d{3})\s+(\d{3})\s*([A-Z])\b", 0.90),
    ("DNI_NIE", "dni_spaced_4_4", r"\b(\d{4})\s+(\d{4})\s*([A-Z])\b", 0.90),
    ("DNI_NIE", "dni_dashed_2_3_3", r"\b(\d{2})-(\d{3})-(\d{3})-?([A-Z])\b", 0.90),
    ("DNI_NIE", "dni_dashed_4_4", r"\b(\d{4})-(\d{4})-?([A-Z])\b", 0.90),
    ("DNI_NIE", "dni_dotted", r"\b(\d{2})\.(\d{3})\.(\d{3})-?([A-Z])\b", 0.90),
    ("DNI_NIE", "nie_standard", r"\b([XYZ])\s*(\d{7})\s*([A-Z])\b", 0.95),
    ("DNI_NIE", "nie_spaced", r"\b([XYZ])\s+(\d{7})\s+([A-Z])\b", 0.90),
    ("DNI_NIE", "nie_dashed", r"\b([XYZ])-(\d{7})-?([A-Z])\b", 0.90),
    ("IBAN", "iban_standard", r"\b(ES\d{22})\b", 0.95),
    ("IBAN", "iban_spaced_4", r"\b(ES\d{2})\s+(\d{4})\s+(\d{4})\s+(\d{4})\s+(\d{4})\s+(\d{4})\b", 0.95),
    ("IBAN", "iban_mixed", r"\b(ES\d{2})\s*(\d{4})\s*(\d{4})\s*(\d{4})\s*(\d{4})\s*(\d{4})\b", 0.90),
    ("NSS", "nss_standard", r"\b(\d{12})\b(?!\d)", 0.70),
    ("NSS", "nss_separated", r"\b(\d{2})[/-](\d{8})[/-](\d{2})\b", 0.85),
    ("NSS", "nss_spaced", r"\b(\d{2})\s+(\d{8})\s+(\d{2})\b", 0.85),
    ("CIF", "cif_standard", r"\b([A-HJ-NP-SUVW])(\d{7})([0-9A-J])\b", 0.95),
    ("CIF", "cif_dashed", r"\b([A-HJ-NP-SUVW])-(\d{7})-?([0-9A-J])\b", 0.90),
    ("CIF", "cif_spaced", r"\b([A-HJ-NP-SUVW])\s+(\d{7})\s*([0-9A-J])\b", 0.90),
    ("PHONE", "phone_mobile", r"\b([67]\d{8})\b", 0.85),
    ("PHONE", "phone_mobile_spaced_3_3_3", r"\b([67]\d{2})\s+(\d{3})\s+(\d{3})\b", 0.90),
    ("PHONE", "phone_mobile_spaced_3_2_2_2", r"\b([67]\d{2})\s+(\d{2})\s+(\d{2})\s+(\d{2})\b", 0.90),
    ("PHONE", "phone_mobile_intl", r"\b(?:\+34|0034)\s*([67]\d{8})\b", 0.95),
    ("PHONE", "phone_mobile_intl_spaced", r"\b(?:\+34|0034)\s*([67]\d{2})\s+(\d{3})\s+(\d{3})\b", 0.95),
    ("PHONE", "phone_landline", r"\b(9\d{8})\b", 0.80),
    ("PHONE", "phone_landline_spaced", r"\b(9\d{2})\s+(\d{3})\s+(\d{3})\b", 0.85),
)

# Words of written dates.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
DAYS = ("uno", "un", "una", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince", "dieciséis", "dieciseis", "diecisiete", "dieciocho", "diecinueve", "veinte", "veintiuno", "veintiún", "veintidós", "veintidos", "veintitrés", "veintitres", "veinticuatro", "veinticinco", "veintiséis", "veintiseis", "veintisiete", "veintiocho", "veintinueve", "treinta", "treinta y uno")
ORDINALS = ("primero", "primer", "primera", "segundo", "segunda", "tercero", "tercer", "tercera", "cuarto", "cuarta", "quinto", "quinta", "sexto", "sexta", "séptimo", "septimo", "séptima", "octavo", "octava", "noveno", "novena", "décimo", "decimo", "décima")
HUNDREDS = ("cien", "ciento", "doscientos", "trescientos", "cuatrocientos", "quinientos", "seiscientos", "setecientos", "ochocientos", "novecientos")
TENS = ("treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa")
UNITS = ("un", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve")
TEENS = ("diez", "once", "doce", "trece", "catorce", "quince", "dieciséis", "dieciseis", "diecisiete", "dieciocho", "diecinueve", "veinte")
TWENTIES = ("veintiún", "veintiuno", "veintidos", "veintidós", "veintitres", "veintitrés", "veinticuatro", "veinticinco", "veintiseis", "veintiséis", "veintisiete", "veintiocho", "veintinueve")
ROMAN_DAY = r"(?:XXX[I]?|XX[IVX]?|X[IVX]{0,3}|[IVX]{1,4})"
ROMAN_YEAR = r"M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"


def _any(*words: str) -> str:
    return f"(?:{'|'.join(sorted(words, key=lambda w: (-len(w), w)))})"


def _date_patterns() -> tuple[tuple[str, str, str, float], ...]:
    month, spoken, ordinal = _any(*MONTHS), _any(*DAYS), _any(*ORDINALS)
    spelt = rf"(?:dos\s+)?mil(?:\s+{_any(*HUNDREDS)})?(?:\s+{_any(*TENS, *TEENS, *TWENTIES, *UNITS)})?(?:\s+y\s+{_any(*UNITS)})?"
    of = lambda day, year, before="": rf"\b{before}{day}\s+de\s+{month}\s+de\s+{year}\b"
    table = (
        ("date_roman_full", rf"\b{ROMAN_DAY}\s+de\s+{month}\s+del?\s+año\s+{ROMAN_YEAR}\b", 0.95),
        ("date_roman_day_written_year", of(ROMAN_DAY, spelt), 0.90),
        ("date_written_full", of(spoken, spelt), 0.95),
        ("date_ordinal_full", of(ordinal, spelt), 0.95),
        ("date_written_day_numeric_year", of(spoken, r"\d{4}"), 0.90),
        ("date_ordinal_numeric_year", of(ordinal, r"\d{4}"), 0.90),
        ("date_a_written", of(spoken, spelt, r"a\s+"), 0.90),
        ("date_el_dia_written", of(spoken, spelt, r"el\s+día\s+"), 0.90),
        ("date_numeric_standard", of(r"\d{1,2}", r"\d{4}"), 0.85),
        ("date_formal_legal", rf"\bdía\s+\d{{1,2}}\s+del\s+mes\s+de\s+{month}\s+del\s+año\s+\d{{4}}\b", 0.90),
    )
    return tuple(("DATE", *row) for row in table)


#: Category, name, pattern, confidence of dates in words, Roman numerals and ordinals.
DATES = _date_patterns()

# Priority and preferred source of a type; NESTED: both spans of a nested pair stay from this priority on.
PREFERENCE = {
    "DNI_NIE": (10, "regex"), "IBAN": (10, "regex"), "NSS": (10, "regex"), "CIF": (10, "regex"),
    "PHONE": (8, "regex"), "POSTAL_CODE": (8, "regex"), "LICENSE_PLATE": (8, "regex"),
    "EMAIL": (7, "regex"), "CADASTRAL_REF": (7, "regex"), "ECLI": (7, "regex"),
    "DATE": (6, "any"), "PROFESSIONAL_ID": (5, "any"),
    "PERSON": (4, "ner"), "ORGANIZATION": (4, "ner"), "LOCATION": (4, "ner"), "ADDRESS": (4, "ner"),
}
OTHER_PREFERENCE = (5, "any")
NESTED = 6


def _matches(text: Column, table: Sequence[tuple[str, str, str, float]]) -> Column:
    """array<struct<start, back, number, end, category, value, confidence, pattern>>, whose order is by start, then the surer, then the earlier pattern."""

    def of(number: int, row: tuple[str, str, str, float]) -> Column:
        category, name, pattern, score = row
        flags = "msU" if category in CASE_KEPT else "imsU"
        return F.transform(
            spans.extract(text, f"(?{flags}){pattern}"),
            lambda s: F.struct(s["start"].alias("start"), F.lit(-score).alias("back"), F.lit(number).alias("number"), s["end"].alias("end"), F.lit(category).alias("category"), s["value"].alias("value"), F.lit(score).alias("confidence"), F.lit(name).alias("pattern")),
        )

    return F.flatten(F.array(*[of(i, row) for i, row in enumerate(table)]))


def matched(documents: DataFrame, table: Sequence[tuple[str, str, str, float]] = (*RESEARCH, *DATES)) -> DataFrame:
    """doc_id, category, pattern, value, start, end, confidence: from left to right, a span that begins inside the last kept one goes."""
    found = documents.select("doc_id", F.explode(_matches(F.col("text"), table)).alias("x")).select("doc_id", F.struct("x.*").alias("s"))
    kept = found.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return kept.select("doc_id", F.explode(spans.left_to_right(F.col("s"))).alias("x")).select("doc_id", "x.category", "x.pattern", "x.value", "x.start", "x.end", "x.confidence")


def validated(label: Column, value: Column) -> Column:
    """True or false where the label has a validator, else null."""
    plain = F.upper(F.regexp_replace(value, r"[.\-\s:]", ""))
    digits = F.regexp_replace(value, r"[/\-\s]", "")
    blankless = F.upper(F.regexp_replace(value, r"\s", ""))
    spanish = blankless.startswith("ES") & (F.length(blankless) == 24)
    return (
        F.when(label == "ES_DNI", checks.dni_valid(F.regexp_replace(plain, "^(?:DNI|NIF)", "")))
        .when(label == "ES_NIE", checks.nie_valid(plain))
        .when(label == "ES_CIF", F.upper(F.regexp_replace(value, r"[\s\-.]", "")).rlike(r"^[ABCDEFGHJNPQRSUVW]\d{7}.$"))
        .when(label == "ES_NSS", digits.rlike(r"^\d{12}$") & F.substring(digits, 1, 2).cast("int").between(1, 52))
        .when(label == "ES_IBAN", F.when(spanish, checks.iban_valid(blankless)).otherwise(F.length(F.regexp_replace(value, r"[\s\-]", "")) == 20))
    )


def recognised(documents: DataFrame, table: Sequence[tuple[str, str, str, float]] = RECOGNISERS) -> DataFrame:
    """doc_id, category, pattern, value, start, end, confidence of recognisers.

    A failed validator drops a match and a passed one makes it certain; a
    context word (of one word) among the five words before raises the score.  Of overlapping
    spans the first stays, of one start the surer.
    """
    found = documents.select("doc_id", "text", F.explode(_matches(F.col("text"), table)).alias("x")).select("doc_id", "text", "x.*")
    head = F.substring(F.col("text"), F.greatest(F.col("start") - 199, F.lit(1)), F.least(F.col("start"), F.lit(200)))
    words = F.slice(F.reverse(F.split(F.trim(head), r"\s+")), 1, CONTEXT_WORDS)
    sure = found.select("*", F.lower(F.array_join(words, " ")).alias("before"), validated(F.col("category"), F.col("value")).alias("valid")).filter("valid IS NULL OR valid")
    near = F.lit(False)
    for label, context in CONTEXT.items():
        near = F.when(F.col("category") == label, F.col("before").rlike("|".join(w for w in context if " " not in w))).otherwise(near)
    base = F.when(F.col("valid"), 1.0).otherwise(F.col("confidence"))
    sure = sure.withColumn("confidence", F.when(near, F.least(F.greatest(F.round(base + CONTEXT_RISE, 6), F.lit(CONTEXT_LEAST)), F.lit(1.0))).otherwise(base))
    ranked = F.array_sort(F.collect_list(F.struct("start", (-F.col("confidence")).alias("back"), "number", "end", "category", "value", "confidence", "pattern")))
    kept = sure.groupBy("doc_id").agg(ranked.alias("s"))
    return kept.select("doc_id", F.explode(spans.left_to_right(F.col("s"))).alias("x")).select("doc_id", "x.category", "x.pattern", "x.value", "x.start", "x.end", "x.confidence")


def _outcome(kept: Column, new: Column) -> Column:
    """Of two spans: 'kept' or 'new' wins; null where both stay."""
    rank = lambda s: lookup(s["category"], {k: v[0] for k, v in PREFERENCE.items()}, OTHER_PREFERENCE[0])
    prefers = lambda s: lookup(s["category"], {k: v[1] for k, v in PREFERENCE.items()}, OTHER_PREFERENCE[1])
    length = lambda s: s["end"] - s["start"]
    larger = lambda a, b: F.when(a > b, "kept").when(b > a, "new")
    own = lambda s: prefers(s) == s["source"]
    only = lambda a, b: F.when(a & ~b, "kept").when(b & ~a, "new")
    liked = lambda s: own(s) | (prefers(s) == "any")
    other_type = kept["category"] != new["category"]
    inside = ((kept["start"] <= new["start"]) & (kept["end"] >= new["end"])) | ((new["start"] <= kept["start"]) & (new["end"] >= kept["end"]))
    surer = F.when(kept["confidence"] >= new["confidence"], "kept").otherwise("new")
    by_type = F.coalesce(larger(rank(kept), rank(new)), only(liked(kept), liked(new)), larger(length(kept), length(new)))
    usual = F.coalesce(F.when(other_type, by_type).otherwise(only(own(kept), own(new))), surer)
    both_high = (rank(kept) >= NESTED) & (rank(new) >= NESTED)
    nested = F.when(both_high & (rank(kept) == rank(new)), F.coalesce(larger(length(kept), length(new)), usual)).when(~both_high, usual)
    return F.when(spans.overlap(kept["start"], kept["end"], new["start"], new["end"]), F.when(inside & other_type, nested).otherwise(usual))


def keeping_nested(detections: DataFrame) -> DataFrame:
    """Overlaps of (doc_id, id, start, end, category, confidence, source) resolved from the highest priority down; nested spans of two types of high priority both stay."""
    prio = lookup(F.col("category"), {k: v[0] for k, v in PREFERENCE.items()}, OTHER_PREFERENCE[0])
    ranked = F.array_sort(F.collect_list(F.struct((-prio).alias("p"), (-F.col("confidence")).alias("c"), "start", "id", "end", "category", "confidence", "source")))
    fold = F.aggregate("r", F.slice("r", 1, 0), lambda kept, s: F.when(F.exists(kept, lambda k: F.coalesce(_outcome(k, s) == "kept", F.lit(False))), kept).otherwise(F.concat(F.filter(kept, lambda k: F.coalesce(_outcome(k, s) == "kept", F.lit(True))), F.array(s))))
    return detections.groupBy("doc_id").agg(ranked.alias("r")).select("doc_id", F.explode(fold).alias("x")).select("doc_id", "x.id", "x.start", "x.end", "x.category", "x.confidence", "x.source")
