"""Checksums of identifiers, and seeded generators of identifiers that fail them.  Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control letters of DNI/NIE and of CIF.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"
CIF_DIGIT_TYPES = "ABEH"
CIF_LETTER_TYPES = "NPQRSW"


def compact(x: Column) -> Column:
    """Upper case without blanks, dots and dashes."""
    return F.upper(F.regexp_replace(x, r"[\s.\-/]", ""))


def _num(x: Column) -> Column:
    return x.cast("long")


def dni_letter(number: Column) -> Column:
    return F.substring(F.lit(DNI_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def dni_valid(x: Column) -> Column:
    """Eight digits and their control letter; null for null."""
    c = compact(x)
    return F.when(c.rlike(r"^\d{8}[A-Z]$"), F.substring(c, 9, 1) == dni_letter(_num(F.substring(c, 1, 8)))).otherwise(F.when(x.isNotNull(), False))


def nie_valid(x: Column) -> Column:
    """X, Y or Z stands for 0, 1 or 2 before seven digits, then as a DNI."""
    c = compact(x)
    number = _num(F.concat(F.translate(F.substring(c, 1, 1), "XYZ", "012"), F.substring(c, 2, 7)))
    return F.when(c.rlike(r"^[XYZ]\d{7}[A-Z]$"), F.substring(c, 9, 1) == dni_letter(number)).otherwise(F.when(x.isNotNull(), False))


def dni_or_nie_valid(x: Column) -> Column:
    return F.when(compact(x).rlike("^[XYZ]"), nie_valid(x)).otherwise(dni_valid(x))


def iban_valid(x: Column) -> Column:
    """Spanish IBAN: account digits, 1428 for ES, check digits, modulo 97 is 1."""
    c = compact(x)
    return F.when(c.rlike(r"^ES\d{22}$"), F.concat(F.substring(c, 5, 20), F.lit("1428"), F.substring(c, 3, 2)).cast("decimal(38,0)") % 97 == 1).otherwise(F.when(x.isNotNull(), False))


def iban_mod97(x: Column) -> Column:
    """ISO 7064 remainder of an IBAN of any country, digit by digit; null if it has other characters."""
    c = compact(x)
    moved = F.split(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4)), "")
    code = lambda ch: F.when(ch.rlike("[A-Z]"), F.ascii(ch) - 55).otherwise(ch.cast("int"))
    fold = F.aggregate(moved, F.lit(0), lambda a, ch: F.when(code(ch) > 9, a * 100 + code(ch)).otherwise(a * 10 + code(ch)) % 97)
    return F.when(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), fold)


def nss_valid(x: Column) -> Column:
    """Twelve digits: the last two are the first ten modulo 97."""
    c = compact(x)
    return F.when(c.rlike(r"^\d{12}$"), _num(F.substring(c, 1, 10)) % 97 == _num(F.substring(c, 11, 2))).otherwise(F.when(x.isNotNull(), False))


def nss_format_valid(x: Column) -> Column:
    """Twelve digits of a province from 1 to 52."""
    c = compact(x)
    return F.when(c.rlike(r"^\d{12}$"), _num(F.substring(c, 1, 2)).between(1, 52)).otherwise(F.when(x.isNotNull(), False))


def cif_control(digits: Column) -> Column:
    """The control digit of seven digits: even places as they are, odd places doubled with their digits summed."""
    total = F.lit(0)
    for i in range(1, 8):
        d = F.substring(digits, i, 1).cast("int")
        total = total + (d if i % 2 == 0 else F.floor(d * 2 / 10) + d * 2 % 10)
    return ((10 - total % 10) % 10).cast("int")


def cif_valid(x: Column) -> Column:
    """Organisation letter, seven digits, and a digit, a letter or either as control by the letter."""
    c = compact(x)
    control = cif_control(F.substring(c, 2, 7))
    digit = F.substring(c, 9, 1) == control.cast("string")
    letter = F.substring(c, 9, 1) == F.substring(F.lit(CIF_LETTERS), control + 1, F.lit(1))
    kind = F.substring(c, 1, 1)
    rule = F.when(kind.isin(*CIF_DIGIT_TYPES), digit).when(kind.isin(*CIF_LETTER_TYPES), letter).otherwise(digit | letter)
    return F.when(c.rlike(r"^[ABCDEFGHJKLMNPQRSUVW]\d{7}[0-9A-J]$"), rule).otherwise(F.when(x.isNotNull(), False))


def postal_province_valid(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{5}$"), _num(F.substring(x, 1, 2)).between(1, 52)).otherwise(F.when(x.isNotNull(), False))


def luhn_valid(x: Column) -> Column:
    return F.call_function("luhn_check", compact(x))


def live_confidence(base: Column, valid: Column) -> Column:
    """1.0 for a valid checksum, seven tenths of the base for a failed one, the base where there is none."""
    return F.when(valid.isNull(), base).when(valid, 1.0).otherwise(base * 0.7)


def research_confidence(base: Column, valid: Column, format_ok: Column) -> Column:
    """Raised by a tenth up to 0.99, or lowered to 0.8 (control wrong) or 0.5 (format wrong)."""
    return F.round(F.when(valid, F.least(base * 1.1, F.lit(0.99))).when(format_ok, base * 0.8).otherwise(base * 0.5), 4)


def valid_by_type(kind: Column, x: Column) -> Column:
    """The validator of an identifier type; null for types without a checksum."""
    return F.when(kind == "DNI", dni_valid(x)).when(kind == "NIE", nie_valid(x)).when(kind == "DNI_NIE", dni_or_nie_valid(x)).when(kind == "IBAN", iban_mod97(x) == 1).when(kind == "NSS", nss_valid(x)).when(kind == "CIF", cif_valid(x))


def _seeded(key: Column, slot: str, modulus: int) -> Column:
    """A number below the modulus from the md5 of key and slot: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(slot))), 1, 12), 16, 10).cast("long") % modulus


def _zero(x: Column, width: int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def invalid_dni(key: Column) -> Column:
    n = _seeded(key, "dni", 100_000_000)
    return F.concat(_zero(n, 8), dni_letter(n + 1 + _seeded(key, "letter", 22)))


def invalid_nie(key: Column) -> Column:
    n = _seeded(key, "nie", 30_000_000)
    return F.concat(F.translate(F.substring(_zero(n, 8), 1, 1), "012", "XYZ"), F.substring(_zero(n, 8), 2, 7), dni_letter(n + 1 + _seeded(key, "letter", 22)))


def invalid_iban(key: Column) -> Column:
    account = F.concat(_zero(_seeded(key, "bank", 10**10), 10), _zero(_seeded(key, "account", 10**10), 10))
    right = F.lit(98) - (F.concat(account, F.lit("142800")).cast("decimal(38,0)") % 97).cast("int")
    return F.concat(F.lit("ES"), _zero((right + 1 + _seeded(key, "check", 95)) % 97, 2), account)


def invalid_nss(key: Column) -> Column:
    n = _seeded(key, "province", 52) * 100_000_000 + 100_000_000 + _seeded(key, "nss", 100_000_000)
    return F.concat(_zero(n, 10), _zero((n % 97 + 1 + _seeded(key, "check", 95)) % 97, 2))


def invalid_card(key: Column) -> Column:
    body = F.concat(F.lit("4"), _zero(_seeded(key, "card", 10**14), 14))
    right = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(body, d.cast("string")))), 1)
    return F.concat(body, ((right + 1 + _seeded(key, "digit", 8)) % 10).cast("string"))


def invalid_identifier(category: Column, key: Column) -> Column:
    """A synthetic identifier of the category that no checksum accepts, or null where none is generated."""
    z = lambda slot, width: _zero(_seeded(key, slot, 10**width), width)
    return (
        F.when(category == "DNI_NIE", invalid_dni(key))
        .when(category == "IBAN", invalid_iban(key))
        .when(category == "SOCIAL_SECURITY", invalid_nss(key))
        .when(category == "CREDIT_CARD", invalid_card(key))
        .when(category == "PHONE", F.concat(F.lit("600"), z("phone", 6)))
        .when(category == "LICENSE_PLATE", F.concat(z("plate", 4), F.lit(" ZZZ")))
        .when(category == "ID_SUPPORT", F.concat(F.lit("ZZZ"), z("support", 6)))
        .when(category == "NIG", F.concat(F.lit("99"), z("nig1", 3), F.lit("42120"), z("nig2", 9)))
        .when(category == "ECLI", F.concat(F.lit("ECLI:ES:XX:2099:"), z("ecli", 4)))
        .when(category == "CSV", F.upper(F.concat(F.lit("CSV"), F.substring(F.md5(key), 1, 16))))
        .when(category == "HEALTH_ID", F.concat(F.lit("ZZZZ"), z("health", 10)))
        .when(category == "CADASTRAL_REF", F.concat(F.lit("9999"), z("cadastral", 3), F.lit("ZZ"), z("map", 4), F.lit("Z0001ZZ")))
        .when(category == "EMPLOYER_ID", F.concat(F.lit("99"), z("employer", 9)))
    )
