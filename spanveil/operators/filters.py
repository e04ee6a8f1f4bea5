"""False-positive filters, anchors and overrides over detections.  Column to Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_I = "(?iuU)"
# Whole values that are no entities.
FALSE_POSITIVES = (
    r"^(?:FUNDAMENTOS?|ANTECEDENTES?|CONCLUSI[OÓ]N|CONCLUSIONES)\s+(?:DE\s+)?(?:DERECHO|HECHO|HECHOS?)?\s*$",
    r"^HECHOS?\s*(?:PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO)?\s*$",
    r"^(?:SUPLICO|SOLICITO|PIDO)\s+(?:AL\s+)?(?:JUZGADO|TRIBUNAL)?\s*$",
    r"^(?:AL\s+)?JUZGADO\s*$",
    r"^(?:OTROSI|OTROSÍ)\s+DIGO\s*$",
    r"^(?:PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|SÉPTIMO|OCTAVO|NOVENO|DÉCIMO)\s*[.:\-]?\s*$",
    r"^(?:EN\s+)?(?:NOMBRE|REPRESENTACI[OÓ]N)\s+(?:Y\s+)?(?:DE|DEL)?\s*$",
    r"^FALLO\s*$",
    r"^VISTOS?\s*$",
    r"^RESULTANDO\s*$",
    r"^CONSIDERANDO\s*$",
    r"^(?:Sentencia|Auto|Providencia|Decreto)\s*(?:n[úu]m?\.?\s*)?\d+/\d{4}$",
    r"^STS[JC]?\s*\d+/\d{4}$",
    r"^SAP\s+\w+\s+\d+/\d{4}$",
    r"^(?:Ley|L\.?O\.?|Ley\s+Org[áa]nica|R\.?D\.?|Real\s+Decreto|RDL|RD-Ley)\s*\d+/\d{4}$",
    r"^(?:LEC(?:rim)?|LOPJ|CE|CP|CC|ET|LAU|LPH|LSC|TRLSC)\s*$",
    r"^(?:art[íi]culos?|arts?\.?)\s+\d+(?:\.\d+)?(?:\s+(?:y|a|,)\s+\d+(?:\.\d+)?)*(?:\s+(?:CE|CP|CC|LEC|LOPJ|LAU|ET))?$",
    r"^(?:y\s+)?\d+(?:\.\d+)?\s+(?:CC|CE|CP|LEC|LECrim|LOPJ|ET|LAU|LPH|LSC|TRLSC)$",
    r"^\d+(?:\.\d+)?(?:\s*,\s*\d+(?:\.\d+)?)*(?:\s+y\s+\d+(?:\.\d+)?)?\s+(?:CC|CE|CP|LEC|LOPJ)$",
    r"^\d+/\d{4}$",
    r"^(?:Rollo|Recurso|Procedimiento|Autos|Ejecutoria|Diligencias)\s*(?:n[úu]m?\.?\s*)?\d+/\d{4}$",
    r"^NIG[:\s]*[\d\-]+$",
    r"^ECLI:ES:\w+:\d{4}:\d+$",
)
# Words that are no entities.
STOPWORDS = ("quien", "quién", "quienes", "quiénes", "cual", "cuál", "cuales", "cuáles", "que", "qué", "donde", "dónde", "adonde", "adónde", "cuando", "cuándo", "como", "cómo", "cuanto", "cuánto", "cuanta", "cuánta", "yo", "tu", "tú", "el", "él", "ella", "ello", "nosotros", "nosotras", "vosotros", "vosotras", "ellos", "ellas", "usted", "ustedes", "este", "esta", "esto", "estos", "estas", "ese", "esa", "eso", "esos", "esas", "aquel", "aquella", "aquello", "aquellos", "aquellas", "la", "los", "las", "un", "una", "unos", "unas", "asimismo", "además", "también", "tampoco", "demandante", "demandado", "demandada", "actor", "actora", "recurrente", "recurrido", "recurrida", "apelante", "apelado", "querellante", "querellado", "querellada", "denunciante", "denunciado", "denunciada", "ejecutante", "ejecutado", "ejecutada", "subsidiariamente", "alternativamente", "conjuntamente", "solidariamente", "mancomunadamente", "expresamente", "tácitamente", "implícitamente", "explícitamente", "parcialmente", "totalmente", "íntegramente", "terminaba", "finalmente", "inicialmente", "posteriormente", "seguidamente", "inmediatamente", "anteriormente", "sin embargo", "no obstante", "por tanto", "por lo tanto")
SHORT_WORDS = ("para", "pero", "sino", "pues", "tras", "ante", "bajo", "cabe", "con", "contra", "desde", "hasta", "hacia", "según", "sin", "sobre", "durante", "mediante", "excepto", "salvo")
PLATFORMS = ("whatsapp", "telegram", "signal", "messenger", "instagram", "facebook", "twitter", "tiktok", "linkedin", "snapchat", "discord", "slack", "teams", "skype", "zoom", "wechat", "viber", "wallapop", "vinted", "milanuncios", "idealista", "fotocasa", "infojobs", "imessage", "facetime")
GENERIC = ("estado", "estados", "unión", "union", "nación", "nacion", "parlamento", "consejo", "comisión", "comision", "gobierno", "ministerio", "tribunal", "juzgado", "congreso", "senado", "cortes", "europa", "asia", "africa", "américa", "america", "ria", "rgpd", "gdpr", "lopd", "lopdgdd", "lec", "lecrim", "lopj", "ce", "cp", "cc", "et", "conducta", "proceso", "principios", "reglamento", "directiva", "sentencia", "auto", "decreto", "states", "parliament", "council", "commission")
ONE_WORD_ORGANISATIONS = ("ETA", "TEDH", "CNI", "CESID", "NATO", "OTAN", "ONU", "UE", "UNESCO", "UNICEF", "EUROPOL", "INTERPOL", "FRONTEX", "Batasuna", "Sortu", "Bildu", "Podemos", "Ciudadanos", "Vox", "TSJ", "CGPJ", "BOE", "BOCG", "TSJC", "TSJPV")
# Words before an entity that tell its category.
PERSON_ANCHORS = ["don", "doña", "d.", "dña.", "d.ª", "sr.", "sra.", "señor", "señora", "letrado", "letrada", "abogado", "abogada", "procurador", "procuradora", "notario", "notaria", "magistrado", "magistrada", "juez", "jueza", "fray", "sor", "en representación de", "representado por", "representada por", "tutor de", "tutora de", "curador de", "curadora de", "hijo de", "hija de", "cónyuge de", "viudo de", "viuda de", "casado con", "casada con", "perito", "secretario judicial", "letrado de la administración", "LAJ", "agente judicial", "demandante", "demandado", "demandada", "denunciante", "denunciado", "denunciada", "recurrente", "recurrido", "recurrida", "apelante", "apelado", "apelada", "querellante", "querellado", "querellada", "ejecutante", "ejecutado", "ejecutada", "acusado", "acusada", "imputado", "imputada", "testigo", "declarante", "compareciente"]
LOCATION_ANCHORS = ["calle", "c/", "avenida", "av.", "avda.", "plaza", "pza.", "paseo", "camino", "carretera", "ctra.", "glorieta", "travesía", "ronda", "vía", "sito en", "situada en", "situado en", "sita en", "finca registral", "finca catastral", "parcela", "inmueble sito", "local sito", "vivienda sita", "registro de la propiedad de", "registro civil de", "registro mercantil de", "domiciliado en", "domiciliada en", "con domicilio en", "vecino de", "vecina de", "residente en", "natural de", "municipio de", "localidad de", "provincia de", "partido judicial de", "término municipal de", "comunidad autónoma de"]
ORGANISATION_ANCHORS = ["s.a.", "s.l.", "s.l.u.", "s.l.p.", "s.c.", "s.c.p.", "sociedad anónima", "sociedad limitada", "sociedad civil", "comunidad de bienes", "banco", "caja", "caixa", "entidad bancaria", "entidad mercantil", "entidad financiera", "juzgado de", "tribunal", "audiencia provincial", "sala de lo", "fiscalía", "ministerio fiscal", "ayuntamiento de", "diputación de", "consejería de", "ministerio de", "gobierno de", "delegación de", "consejo de administración", "junta de accionistas", "junta directiva", "comité de", "comisión de"]
ORGANISATION_SUFFIXES = ["s.a.", "s.l.", "s.l.u.", "s.l.p.", "s.c.", "s.c.p.", "s.a.u.", "s.coop."]
MONTHS = "(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)"
DATE_SHAPES = (rf"^\d{{1,2}}\s+de\s+{MONTHS}\s+de\s+\d{{4}}$", rf"^\d{{1,2}}\s+{MONTHS}\s+\d{{4}}$", r"^\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4}$")
CASE_SHAPES = (r"^\d{1,5}/\d{4}-[A-Z0-9]{1,4}$", r"^\d{1,5}/\d{4}$")
COURT_BEFORE = (r"(?s)(?:juzgado|sala)\s+.*?n[ºúu]m?\.?\s*\d+\s+de\s*$", r"(?:audiencia\s+provincial|tribunal\s+superior)\s+de\s*$")
YEAR_FOOTNOTE = r"\b((?:19|20)\d{2})(\d{1,2})\b"


def either(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def anchor_pattern(anchors: list[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(a).replace(r"\ ", " ") for a in anchors) + r")\b"


def false_positive(value: Column) -> Column:
    return F.trim(value).rlike(_I + either(FALSE_POSITIVES))


def stopword(value: Column, category: Column) -> Column:
    """Stop words, generic terms, platforms as persons, short common words, and up to three letters not in capitals."""
    v = F.trim(value)
    low = F.lower(v)
    short = (F.length(low) <= 5) & ~low.contains(" ")
    tiny = (F.length(low) <= 3) & low.rlike(r"^\p{L}+$") & (F.upper(v) != v)
    return low.isin(*STOPWORDS) | low.isin(*GENERIC) | ((category == "PERSON_NAME") & low.isin(*PLATFORMS)) | (short & (low.isin(*SHORT_WORDS) | tiny))


def garbage(value: Column, category: Column, confidence: Column, source: Column) -> Column:
    """Scraps of a model: two letters at most, quotes, cut prepositions, small or no letter first, unsure one-word organisations."""
    v = F.trim(value)
    letters = F.regexp_count(v, F.lit(r"\p{L}"))
    one_word = (category == "ORGANIZATION") & ~v.rlike(r"\s") & ~v.isin(*ONE_WORD_ORGANISATIONS) & (confidence < 0.85)
    return (source == "roberta") & ((letters <= 2) | v.rlike("^[\"']") | v.rlike(r"(?U)\s(?:de|del|de la)$") | v.rlike(r"^\p{Ll}") | ~v.rlike(r"^[\p{L}\p{N}]") | one_word)


def anchored_category(text: Column, start: Column, value: Column, category: Column, window: int = 80) -> Column:
    """The category that words in the window before the span force: person, then place, then organisation."""
    n = F.least(start, F.lit(window))
    before = F.substring(text, start - n + 1, n)
    has = lambda x, anchors: x.rlike(_I + anchor_pattern(anchors))
    return F.when(has(before, PERSON_ANCHORS), "PERSON_NAME").when(has(before, LOCATION_ANCHORS), "LOCATION").when(has(before, ORGANISATION_ANCHORS) | has(value, ORGANISATION_SUFFIXES), "ORGANIZATION").otherwise(category)


def overridden(text: Column, start: Column, value: Column, category: Column, window: int = 120) -> Column:
    """Values shaped as dates or case numbers are such; an organisation after a court's name is its place."""
    v, n = F.trim(value), F.least(start, F.lit(window))
    before = F.substring(text, start - n + 1, n)
    return F.when(v.rlike(_I + either(DATE_SHAPES)), "DATE").when(v.rlike(_I + either(CASE_SHAPES)), "CASE_NUMBER").when((category == "ORGANIZATION") & before.rlike(_I + either(COURT_BEFORE)), "LOCATION").otherwise(category)


def research_verdict(kind: Column, value: Column, before: Column, valid: Column) -> Column:
    """The first reason to reject an entity, or OK."""
    least = F.when(kind.isin("PERSON", "ORGANIZATION", "LOCATION"), 3).when(kind == "DATE", 4).otherwise(5)
    return (
        F.when(F.length(value) < least, "TOO_SHORT").when(before.rlike(_I + r"\b(?:art[íi]culo|ley|real decreto|sentencia)\s*$"), "LEGAL_REFERENCE").when(before.rlike(_I + r"\b(?:por ejemplo|ejemplo|p\. ?ej\.)"), "EXAMPLE")
        .when(value.rlike(_I + r"\b(?:fulano|mengano|don quijote)\b"), "FICTIONAL").when(~F.coalesce(valid, F.lit(True)), "CHECKSUM").otherwise("OK")
    )
