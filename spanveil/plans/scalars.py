"""Queries of the scalar functions over identifiers, dates and texts derived from the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import checks, dates, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _zero(x: Column, width: int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


L = checks.DNI_LETTERS


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with identifiers; every fifth has a wrong control."""
    k = F.col("c_custkey").cast("long")
    n, wrong = k * 7919 % 100_000_000, F.when(k % 5 == 0, 1).otherwise(0)
    letter = lambda m: F.substring(F.lit(L), ((m + wrong) % 23 + 1).cast("int"), F.lit(1))
    nss = (k % 52 + 1) * 100_000_000 + n
    account = F.concat(_zero(k * 104729 % 10**10, 10), _zero(n * 31 % 10**10, 10))
    check = 98 - F.concat(account, F.lit("142800")).cast("decimal(38,0)") % 97
    cif = F.concat(_zero(k % 100, 2), _zero(n % 100_000, 5))
    return _table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.concat(_zero(n, 8), letter(n)).alias("dni"),
        F.concat(F.translate((k % 3).cast("string"), "012", "XYZ"), _zero(n % 10**7, 7), letter(k % 3 * 10**7 + n % 10**7)).alias("nie"),
        F.concat(_zero(nss, 10), _zero((nss % 97 + wrong) % 97, 2)).alias("nss"),
        F.concat(F.lit("ES"), _zero((check.cast("int") + wrong) % 98, 2), account).alias("iban"),
        F.concat(F.substring(F.lit("ABEHNPQRSWCDFGJUV"), (k % 17 + 1).cast("int"), F.lit(1)), cif, F.when(k % 2 == 0, (k % 10).cast("string")).otherwise(F.substring(F.lit(checks.CIF_LETTERS), (k % 10 + 1).cast("int"), F.lit(1)))).alias("cif"),
        F.concat(F.lit("4"), _zero(n * 97, 15)).alias("card"),
        _zero(k * 37 % 60000, 5).alias("postal"),
    )


PEOPLE_SQL = f"""
p0 AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_custkey AS BIGINT) * 7919 % 100000000 AS n, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS wrong FROM customer),
p1 AS (SELECT *, (k % 52 + 1) * 100000000 + n AS nssn, lpad(CAST(k * 104729 % 10000000000 AS VARCHAR), 10, '0') || lpad(CAST(n * 31 % 10000000000 AS VARCHAR), 10, '0') AS account FROM p0),
people AS (SELECT k AS id,
  lpad(CAST(n AS VARCHAR), 8, '0') || substr('{L}', CAST((n + wrong) % 23 + 1 AS INT), 1) AS dni,
  translate(CAST(k % 3 AS VARCHAR), '012', 'XYZ') || lpad(CAST(n % 10000000 AS VARCHAR), 7, '0') || substr('{L}', CAST((k % 3 * 10000000 + n % 10000000 + wrong) % 23 + 1 AS INT), 1) AS nie,
  lpad(CAST(nssn AS VARCHAR), 10, '0') || lpad(CAST((nssn % 97 + wrong) % 97 AS VARCHAR), 2, '0') AS nss,
  'ES' || lpad(CAST((98 - CAST(account || '142800' AS HUGEINT) % 97 + wrong) % 98 AS VARCHAR), 2, '0') || account AS iban,
  substr('ABEHNPQRSWCDFGJUV', CAST(k % 17 + 1 AS INT), 1) || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || lpad(CAST(n % 100000 AS VARCHAR), 5, '0') || CASE WHEN k % 2 = 0 THEN CAST(k % 10 AS VARCHAR) ELSE substr('JABCDEFGHI', CAST(k % 10 + 1 AS INT), 1) END AS cif,
  '4' || lpad(CAST(n * 97 AS VARCHAR), 15, '0') AS card,
  lpad(CAST(k * 37 % 60000 AS VARCHAR), 5, '0') AS postal
  FROM p1)"""


def _people(name: str, columns: Callable[[], list[Column]], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: people(spark, sf_dir).select("id", *columns())
    ORACLE_SQL[name] = f"WITH {PEOPLE_SQL} SELECT id, {sql} FROM people"


c = F.col
_DNI = "substr(dni, 9, 1) = substr('{L}', CAST(CAST(substr(dni, 1, 8) AS BIGINT) % 23 + 1 AS INT), 1)".replace("{L}", L)
_NIE = "substr(nie, 9, 1) = substr('{L}', CAST(CAST(translate(substr(nie, 1, 1), 'XYZ', '012') || substr(nie, 2, 7) AS BIGINT) % 23 + 1 AS INT), 1)".replace("{L}", L)
_IBAN = "CAST(substr(iban, 5) || '1428' || substr(iban, 3, 2) AS HUGEINT) % 97 = 1"
_NSS = "CAST(substr(nss, 1, 10) AS BIGINT) % 97 = CAST(substr(nss, 11, 2) AS BIGINT)"
_CIFC = "((10 - (" + " + ".join(f"CAST(substr(cif, {i + 1}, 1) AS INT)" if i % 2 == 0 else f"(CAST(substr(cif, {i + 1}, 1) AS INT) * 2 // 10 + CAST(substr(cif, {i + 1}, 1) AS INT) * 2 % 10)" for i in range(1, 8)) + ") % 10) % 10)"
_CIF = f"CASE WHEN cif[1] IN ('A','B','E','H') THEN cif[9] = CAST({_CIFC} AS VARCHAR) WHEN cif[1] IN ('N','P','Q','R','S','W') THEN cif[9] = substr('JABCDEFGHI', {_CIFC} + 1, 1) ELSE cif[9] = CAST({_CIFC} AS VARCHAR) OR cif[9] = substr('JABCDEFGHI', {_CIFC} + 1, 1) END"
_LUHN = "(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(substr(card, i, 1) AS INT) * 2) // 10 + (CAST(substr(card, i, 1) AS INT) * 2) % 10 ELSE CAST(substr(card, i, 1) AS INT) END)) % 10 = 0)"

_people("chk_01_dni_letter", lambda: [c("dni"), checks.dni_valid(c("dni")).alias("valid")], f"dni, {_DNI} AS valid")
_people("chk_02_nie_letter", lambda: [c("nie"), checks.nie_valid(c("nie")).alias("valid")], f"nie, {_NIE} AS valid")
_people("chk_03_dni_or_nie", lambda: [checks.dni_or_nie_valid(c("dni")).alias("dni_ok"), checks.dni_or_nie_valid(c("nie")).alias("nie_ok")], f"{_DNI} AS dni_ok, {_NIE} AS nie_ok")
_people("chk_04_iban_mod97", lambda: [checks.iban_valid(c("iban")).alias("valid"), (checks.iban_mod97(c("iban")) == 1).alias("valid_any_country")], f"{_IBAN} AS valid, {_IBAN} AS valid_any_country")
_people("chk_05_nss_control", lambda: [c("nss"), checks.nss_valid(c("nss")).alias("valid")], f"nss, {_NSS} AS valid")
_people("chk_06_cif_control", lambda: [c("cif"), checks.cif_valid(c("cif")).alias("valid")], f"cif, {_CIF} AS valid")
_people("chk_07_nss_format", lambda: [checks.nss_format_valid(c("nss")).alias("valid")], "CAST(substr(nss, 1, 2) AS INT) BETWEEN 1 AND 52 AS valid")
_people("chk_08_postal_province", lambda: [c("postal"), checks.postal_province_valid(c("postal")).alias("valid")], "postal, CAST(substr(postal, 1, 2) AS INT) BETWEEN 1 AND 52 AS valid")
_people("chk_09_luhn", lambda: [c("card"), checks.luhn_valid(c("card")).alias("valid")], f"card, {_LUHN} AS valid")
_people(
    "chk_10_checksum_confidence",
    lambda: [F.round(checks.live_confidence(F.lit(0.95), checks.dni_valid(c("dni"))), 4).alias("live"), checks.research_confidence(F.lit(0.9), checks.dni_valid(c("dni")), F.lit(True)).alias("research")],
    f"round(CASE WHEN {_DNI} THEN 1.0 ELSE 0.95::DOUBLE * 0.7::DOUBLE END, 4) AS live, round(CASE WHEN {_DNI} THEN least(0.9::DOUBLE * 1.1::DOUBLE, 0.99::DOUBLE) ELSE 0.9::DOUBLE * 0.8::DOUBLE END, 4) AS research",
)
QUERIES["chk_11_validator_dispatch"] = lambda spark, sf_dir: (
    people(spark, sf_dir).select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c(v).alias("value")) for k, v in (("DNI", "dni"), ("NIE", "nie"), ("IBAN", "iban"), ("NSS", "nss"), ("CIF", "cif"), ("EMAIL", "postal"))])).alias("x"))
    .select("id", "x.kind", F.coalesce(checks.valid_by_type(c("x.kind"), c("x.value")).cast("string"), F.lit("none")).alias("valid"))
)
ORACLE_SQL["chk_11_validator_dispatch"] = f"WITH {PEOPLE_SQL} " + " UNION ALL ".join(f"SELECT id, '{k}' AS kind, coalesce(CAST({e} AS VARCHAR), 'none') AS valid FROM people" for k, e in (("DNI", _DNI), ("NIE", _NIE), ("IBAN", _IBAN), ("NSS", _NSS), ("CIF", _CIF), ("EMAIL", "CAST(NULL AS BOOLEAN)")))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", F.lit("project"), F.col("c_custkey").cast("string"))
    made = [(k, checks.invalid_identifier(F.lit(k), key)) for k in ("DNI_NIE", "IBAN", "SOCIAL_SECURITY", "CREDIT_CARD", "PHONE", "LICENSE_PLATE", "ID_SUPPORT", "NIG", "ECLI", "CSV", "HEALTH_ID", "CADASTRAL_REF", "EMPLOYER_ID")]
    rows = _table(spark, sf_dir, "customer").select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.alias("value")) for k, v in made])).alias("x")).select("x.*")
    accepted = F.when(c("category") == "DNI_NIE", checks.dni_valid(c("value"))).when(c("category") == "IBAN", checks.iban_valid(c("value"))).when(c("category") == "SOCIAL_SECURITY", checks.nss_valid(c("value"))).when(c("category") == "CREDIT_CARD", checks.luhn_valid(c("value"))).otherwise(False)
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("accepted"), F.count_if(c("value").isNull()).alias("missing"))


QUERIES["gen_01_invalid_identifiers"] = _generated
ORACLE_SQL["gen_01_invalid_identifiers"] = "SELECT category, (SELECT count(*) FROM customer) AS n, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS missing FROM (SELECT unnest(['DNI_NIE','IBAN','SOCIAL_SECURITY','CREDIT_CARD','PHONE','LICENSE_PLATE','ID_SUPPORT','NIG','ECLI','CSV','HEALTH_ID','CADASTRAL_REF','EMPLOYER_ID']) AS category)"

# Dates: each order's date in one of four written forms.


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey").cast("long")
    name = F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month(d))
    form = F.when(k % 4 == 0, F.format_string("%d de %s de %d", F.dayofmonth(d), name, F.year(d))).when(k % 4 == 1, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 2, F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return _table(spark, sf_dir, "orders").select(k.alias("id"), d.alias("d"), form.alias("written"), (F.col("o_custkey") % 25).cast("long").alias("project"))


_MONTHS = "[" + ",".join(f"'{m}'" for m in dates.MONTHS) + "]"
DATED_SQL = f"""dated AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey % 25 AS BIGINT) AS project,
  CASE o_orderkey % 4 WHEN 0 THEN day(CAST(o_orderdate AS DATE)) || ' de ' || {_MONTHS}[month(CAST(o_orderdate AS DATE))] || ' de ' || year(CAST(o_orderdate AS DATE)) WHEN 1 THEN strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y')
  WHEN 2 THEN strftime(CAST(o_orderdate AS DATE), '%d-%m-%Y') ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS written FROM orders)"""
_DELTA = "CAST(CAST('0x' || substr(md5(CAST(project AS VARCHAR)), 1, 8) AS BIGINT) % 3651 - 1825 AS INT)"
_SHIFTED = f"(d + {_DELTA})"


def _dated(name: str, columns: Callable[[], list[Column]], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: dated(spark, sf_dir).select("id", *columns())
    ORACLE_SQL[name] = f"WITH {DATED_SQL} SELECT id, {sql} FROM dated"


def _iso(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


_dated("dat_01_parse", lambda: [c("written"), _iso(dates.parse(c("written"))).alias("parsed")], "written, strftime(d, '%Y-%m-%d') AS parsed")
_dated("dat_02_project_delta", lambda: [dates.project_delta(c("project")).alias("delta")], f"{_DELTA} AS delta")
_dated(
    "dat_03_shift",
    lambda: [
        _iso(dates.shift(c("d"), dates.project_delta(c("project")))).alias("shifted"),
        F.weekday(dates.shift(c("d"), dates.project_delta(c("project")), preserve_weekday=True)).alias("weekday"),
        F.dayofmonth(dates.shift(c("d"), dates.project_delta(c("project")), preserve_month_day=True)).alias("day"),
    ],
    f"strftime({_SHIFTED}, '%Y-%m-%d') AS shifted, CAST(isodow(d) - 1 AS INT) AS weekday, CAST(CASE WHEN month(d) = 2 AND day(d) = 29 AND NOT (year({_SHIFTED}) % 4 = 0 AND (year({_SHIFTED}) % 100 <> 0 OR year({_SHIFTED}) % 400 = 0)) THEN 28 ELSE day(d) END AS INT) AS day",
)
_dated(
    "dat_04_format_like_original",
    lambda: [dates.written_like(dates.shift(dates.parse(c("written")), dates.project_delta(c("project"))), c("written")).alias("alias")],
    f"CASE WHEN contains(written, ' de ') THEN day({_SHIFTED}) || ' de ' || {_MONTHS}[month({_SHIFTED})] || ' de ' || year({_SHIFTED}) WHEN contains(written, '/') THEN strftime({_SHIFTED}, '%d/%m/%Y') WHEN starts_with(written, '20') THEN strftime({_SHIFTED}, '%Y-%m-%d') ELSE strftime({_SHIFTED}, '%d-%m-%Y') END AS alias",
)
QUERIES["dat_05_equivalent_dates"] = lambda spark, sf_dir: dated(spark, sf_dir).groupBy(dates.equivalence_key(c("written")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("written").alias("forms"))
ORACLE_SQL["dat_05_equivalent_dates"] = f"WITH {DATED_SQL} SELECT strftime(d, '%Y-%m-%d') AS key, count(*) AS n, count(DISTINCT written) AS forms FROM dated GROUP BY d"
QUERIES["dat_06_plausible"] = lambda spark, sf_dir: _table(spark, sf_dir, "orders").select(c("o_orderkey").cast("long").alias("id"), dates.plausible(c("o_orderkey") % 40, c("o_custkey") % 16).alias("ok"))
ORACLE_SQL["dat_06_plausible"] = "SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 40 BETWEEN 1 AND 31 AND o_custkey % 16 BETWEEN 1 AND 12 AS ok FROM orders"
_dated("dat_07_days_in_month", lambda: [dates.days_in_month(F.year("d"), F.month("d")).alias("days")], "CAST(day(last_day(d)) AS INT) AS days")
QUERIES["mth_05_roman"] = lambda spark, sf_dir: _table(spark, sf_dir, "part").select(c("p_partkey").cast("long").alias("id"), F.coalesce(dates.roman(_roman_text(c("p_partkey"))), F.lit(0)).cast("long").alias("value"))
ORACLE_SQL["mth_05_roman"] = "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 40 AS BIGINT) AS value FROM part"


def _roman_text(k: Column) -> Column:
    n = (k % 40).cast("int")
    units = F.element_at(F.array(*map(F.lit, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))), n % 10 + 1)
    return F.concat(F.expr("''"), F.repeat(F.lit("X"), F.floor(n / 10).cast("int")), units)


# Texts.


def _docs(name: str, columns: Callable[[], list[Column]], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", *columns())
    ORACLE_SQL[name] = f"SELECT doc_id, {sql} FROM documents"


def _digest(x: Column) -> Column:
    return F.sha2(x, 256)


_NOISY = "replace(replace(text, ', ', chr(160) || chr(13) || chr(10)), '. ', chr(8212) || chr(8220) || chr(7))"


def _noisy(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(", "), F.lit(" \r\n")), F.lit(". "), F.lit("—“\x07"))


_docs("str_02_newlines", lambda: [_digest(text.newlines(_noisy(c("text")))).alias("digest")], f"sha256(replace(replace({_NOISY}, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest")
_docs("str_03_spaces", lambda: [_digest(text.spaces(_noisy(c("text")))).alias("digest")], f"sha256(translate({_NOISY}, chr(160) || chr(8199) || chr(8239) || chr(8288), '    ')) AS digest")
_docs("str_04_controls", lambda: [_digest(text.without_controls(_noisy(c("text")))).alias("digest")], f"sha256(replace({_NOISY}, chr(7), '')) AS digest")
_docs("str_05_ingest", lambda: [_digest(text.ingest(_noisy(c("text")), None)).alias("digest")], f"sha256(replace(replace(translate({_NOISY}, chr(160) || chr(8199) || chr(8239) || chr(8288), '    '), chr(13) || chr(10), chr(10)), chr(7), '')) AS digest")
_docs("str_06_quotes", lambda: [_digest(text.quotes(_noisy(c("text")))).alias("digest")], f"sha256(translate({_NOISY}, chr(8220), chr(34))) AS digest")
_docs("str_07_dashes", lambda: [_digest(text.dashes(_noisy(c("text")))).alias("digest")], f"sha256(translate({_NOISY}, chr(8212), '-')) AS digest")
_docs("str_09_joined_lines", lambda: [_digest(text.joined_lines(F.replace("text", F.lit(".\n"), F.lit("\n")))).alias("digest")], "sha256(regexp_replace(replace(text, '.' || chr(10), chr(10)), '([\\p{L}\\p{N}\\p{M}_])\\n([\\p{L}\\p{N}\\p{M}_])', '\\1 \\2', 'g')) AS digest")
_docs("str_10_single_spaces", lambda: [_digest(text.single_spaces(F.replace("text", F.lit(" "), F.lit("   ")))).alias("digest")], "sha256(regexp_replace(replace(text, ' ', '   '), ' +', ' ', 'g')) AS digest")
_docs("str_13_detector_text", lambda: [_digest(text.detector_text(F.replace("text", F.lit("a"), F.lit("​а  ")))).alias("digest")], "sha256(regexp_replace(replace(text, 'a', 'a  '), ' +', ' ', 'g')) AS digest")
_docs("str_17_mask", lambda: [_digest(text.mask(F.regexp_replace(c("text"), r"^\s+|\s+$", ""))).alias("digest")], "sha256(array_to_string(list_transform(regexp_split_to_array(regexp_replace(text, '^[\\t\\n\\v\\f\\r ]+|[\\t\\n\\v\\f\\r ]+$', '', 'g'), '[\\t\\n\\v\\f\\r ]+'), lambda w: repeat('*', greatest(length(w), 5))), ' ')) AS digest")
_docs("str_26_alias_number", lambda: [text.alias_number(c("text")).alias("number")], "CAST(CAST('0x' || substr(sha256(text), 1, 6) AS BIGINT) % 10000 AS BIGINT) AS number")
_docs("str_27_redacted", lambda: [text.redacted(c("text")).alias("redacted")], "substr(text, 1, 3) || '***' || right(text, 1) AS redacted")
_docs("str_25_without_accents", lambda: [_digest(text.without_accents(c("text"))).alias("digest")], "sha256(translate(text, 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN')) AS digest")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey").cast("long")
    title = F.element_at(F.array(*map(F.lit, ("Don ", "Dña. ", "Sr. ", "DOÑA  ", ""))), (k % 5 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, (" S.L.", ", S.A.", " SLU", ""))), (k % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(title, F.lit("  "), c("c_name"), F.lit(" ")).alias("person"), F.concat(c("c_name"), suffix).alias("organisation"))


QUERIES["str_15_glossary_key"] = lambda spark, sf_dir: names(spark, sf_dir).select("id", text.glossary_key(c("person"), F.lit("PERSON_NAME")).alias("person_key"), text.glossary_key(c("organisation"), F.lit("ORGANIZATION")).alias("organisation_key"))
ORACLE_SQL["str_15_glossary_key"] = "SELECT CAST(c_custkey AS BIGINT) AS id, lower(c_name) AS person_key, lower(c_name) AS organisation_key FROM customer"
QUERIES["str_16_lookup_key"] = lambda spark, sf_dir: names(spark, sf_dir).select("id", text.lookup_key(c("person"), F.lit("PERSON_NAME")).alias("key"), (text.glossary_key(c("person")) == text.glossary_key(c("organisation"))).alias("same"))
ORACLE_SQL["str_16_lookup_key"] = "SELECT CAST(c_custkey AS BIGINT) AS id, 'PERSON_NAME:' || lower(c_name) AS key, true AS same FROM customer"
QUERIES["str_20_custom_alias"] = lambda spark, sf_dir: names(spark, sf_dir).select("id", text.custom_alias_valid(c("organisation")).alias("ok"))
ORACLE_SQL["str_20_custom_alias"] = "SELECT CAST(c_custkey AS BIGINT) AS id, NOT regexp_matches(c_name || [' S.L.', ', S.A.', ' SLU', ''][CAST(c_custkey % 4 + 1 AS INT)], '[^\\p{L}\\p{N}_ -]') AS ok FROM customer"
QUERIES["str_21_file_parts"] = lambda spark, sf_dir: _table(spark, sf_dir, "pages").select("page_id", text.file_parts(F.concat(c("page_id").cast("string"), F.lit(".v1.PDF"))).alias("p")).select("page_id", "p.base", "p.ext")
ORACLE_SQL["str_21_file_parts"] = "SELECT page_id, page_id || '.v1' AS base, 'pdf' AS ext FROM pages"
