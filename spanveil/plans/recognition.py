"""Queries over recognisers, research identifiers, written dates and nested overlaps, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators import recognisers
from spanveil.plans import detections
from spanveil.plans.scalars import _DNI, _IBAN, PEOPLE_SQL, people

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _sentences(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _row(category: str, pattern: str, value: str, start: int, confidence: str, where: str = "true") -> str:
    return f"SELECT id AS doc_id, '{category}' AS category, '{pattern}' AS pattern, {value} AS value, {start}::INT AS \"start\", ({start} + length({value}))::INT AS \"end\", {confidence}::DOUBLE AS confidence FROM people WHERE {where}"


@query(
    "det_03_recognisers",
    f"WITH {PEOPLE_SQL} "
    + " UNION ALL ".join(
        [
            _row("ES_DNI", "DNI_WITH_PREFIX", "'DNI ' || dni", 0, "1.0", _DNI),
            _row("ES_NIE", "NIE_WITH_SEPARATOR", "nie", 19, "1.0", "id % 5 <> 0"),
            _row("ES_IBAN", "IBAN_SPACED", "iban", 35, "1.0", _IBAN),
            _row("ES_PHONE", "PHONE_COMPACT", "'612345678'", 65, "0.95"),
            _row("ES_PHONE", "PHONE_MOBILE_SPACED", "'712 345 678'", 87, "0.8"),
        ]
    ),
)
def _recognisers(spark, sf_dir):
    text = _sentences("DNI ", c("dni"), "; NIE ", c("nie"), "; IBAN ", c("iban"), "; tel 612345678 a b c d e f 712 345 678.")
    return recognisers.recognised(people(spark, sf_dir).select(c("id").alias("doc_id"), text.alias("text")))


_NSS = "substr(nss, 1, 2) || '/' || substr(nss, 3, 8) || '/' || substr(nss, 11, 2)"


@query(
    "det_15_research_identifiers",
    f"WITH {PEOPLE_SQL} "
    + " UNION ALL ".join(
        [
            _row("DNI_NIE", "dni_standard", "lower(dni)", 0, "0.95"),
            _row("IBAN", "iban_standard", "iban", 11, "0.95"),
            _row("NSS", "nss_separated", _NSS, 37, "0.85"),
            _row("PHONE", "phone_mobile_spaced_3_3_3", "'612 345 678'", 53, "0.9"),
        ]
    ),
)
def _research(spark, sf_dir):
    nss = F.concat_ws("/", F.substring("nss", 1, 2), F.substring("nss", 3, 8), F.substring("nss", 11, 2))
    text = _sentences(F.lower("dni"), "; ", c("iban"), "; ", nss, "; 612 345 678; es9121000418450200051332")
    return recognisers.matched(people(spark, sf_dir).select(c("id").alias("doc_id"), text.alias("text")))


SPOKEN = ("uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince", "dieciséis", "diecisiete", "dieciocho", "diecinueve", "veinte", "veintiuno", "veintidós", "veintitrés", "veinticuatro", "veinticinco", "veintiséis", "veintisiete", "veintiocho", "veintinueve", "treinta", "treinta y uno")
_LISTS = [f"[{','.join(repr(w) for w in words)}]" for words in (recognisers.MONTHS, SPOKEN)]
_DATES_SQL = f"""d AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, o_orderkey % 4 AS k, day(o_orderdate) AS d, {_LISTS[0]}[month(o_orderdate)] AS m, year(o_orderdate) AS y, {_LISTS[1]}[day(o_orderdate)] AS w FROM orders),
v AS (SELECT doc_id, k, CASE k WHEN 0 THEN d || ' de ' || m || ' de ' || y WHEN 1 THEN 'día ' || d || ' del mes de ' || m || ' del año ' || y WHEN 2 THEN w || ' de ' || m || ' de ' || y ELSE w || ' de ' || m || ' de mil novecientos ' || w END AS value FROM d)"""


@query(
    "det_16_written_dates",
    f"WITH {_DATES_SQL} SELECT doc_id, 'DATE' AS category, CASE k WHEN 0 THEN 'date_numeric_standard' WHEN 1 THEN 'date_formal_legal' WHEN 2 THEN 'date_written_day_numeric_year' ELSE 'date_written_full' END AS pattern, value, 9::INT AS \"start\", (9 + length(value))::INT AS \"end\", CASE k WHEN 0 THEN 0.85 WHEN 3 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence FROM v",
)
def _dates(spark, sf_dir):
    o = detections.table(spark, sf_dir, "orders")
    at = lambda words, n: F.element_at(F.array(*map(F.lit, words)), n)
    day, month, year, k = F.dayofmonth("o_orderdate"), at(recognisers.MONTHS, F.month("o_orderdate")), F.year("o_orderdate").cast("string"), c("o_orderkey") % 4
    spoken = at(SPOKEN, day)
    value = (
        F.when(k == 0, F.concat(day.cast("string"), F.lit(" de "), month, F.lit(" de "), year))
        .when(k == 1, F.concat(F.lit("día "), day.cast("string"), F.lit(" del mes de "), month, F.lit(" del año "), year))
        .when(k == 2, F.concat(spoken, F.lit(" de "), month, F.lit(" de "), year))
        .otherwise(F.concat(spoken, F.lit(" de "), month, F.lit(" de mil novecientos "), spoken))
    )
    docs = o.select(c("o_orderkey").cast("long").alias("doc_id"), F.concat(F.lit("Otorgado "), value, F.lit(".")).alias("text"))
    return recognisers.matched(docs, recognisers.DATES)


@query("win_06_nested_overlaps")
def _nested(spark, sf_dir):
    return recognisers.keeping_nested(detections.detections(spark, sf_dir))
