"""Recognisers, written dates and nested overlaps on hand-made cases and against brute force."""

import random

import pytest

from spanveil.operators import recognisers


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def found(df):
    return sorted((r.doc_id, r.category, r.value, round(r.confidence, 4)) for r in df.collect())


def test_recogniser_drops_failed_and_raises_passed(spark):
    texts = ("NIF 12345678-Z", "12345678A", "su x1234567l", "28/12345678/90 y 99/12345678/90", "ES91 2100 0418 4502 0005 1332", "ES92 2100 0418 4502 0005 1332", "móvil 612345678, fax 712345678", None, "")
    assert found(recognisers.recognised(docs(spark, *texts))) == [
        (0, "ES_DNI", "NIF 12345678-Z", 1.0),
        (2, "ES_NIE", "x1234567l", 1.0),
        (3, "ES_NSS", "28/12345678/90", 1.0),
        (4, "ES_IBAN", "ES91 2100 0418 4502 0005 1332", 1.0),
        (6, "ES_PHONE", "612345678", 0.95),
        (6, "ES_PHONE", "712345678", 0.95),
    ]


@pytest.mark.parametrize(
    ("text", "value", "pattern"),
    [
        ("Otorgado el día XV de marzo del año MMXXIV.", "XV de marzo del año MMXXIV", "date_roman_full"),
        ("El día X de abril de dos mil veinticuatro.", "X de abril de dos mil veinticuatro", "date_roman_day_written_year"),
        ("Primero de ENERO de dos mil veinticuatro", "Primero de ENERO de dos mil veinticuatro", "date_ordinal_full"),
        ("treinta y uno de mayo de mil novecientos ochenta y cuatro", "treinta y uno de mayo de mil novecientos ochenta y cuatro", "date_written_full"),
        ("En Madrid, a quince de marzo de dos mil veinte", "a quince de marzo de dos mil veinte", "date_a_written"),
        ("segundo de junio de 1999", "segundo de junio de 1999", "date_ordinal_numeric_year"),
        ("en mayo de 2020", None, None),
    ],
)
def test_written_dates(spark, text, value, pattern):
    got = [(r.value, r.pattern) for r in recognisers.matched(docs(spark, text), recognisers.DATES).collect()]
    assert got == ([(value, pattern)] if value else [])


def test_first_of_overlapping_identifiers_stays(spark):
    got = found(recognisers.matched(docs(spark, "12 345 678 Z", "+34 612 345 678", "X-1234567-L", "es9121000418450200051332"), recognisers.RESEARCH))
    assert (0, "DNI_NIE", "12 345 678 Z", 0.9) in got and (2, "DNI_NIE", "X-1234567-L", 0.9) in got and not [g for g in got if g[0] == 3]


def brute(rows):
    """rows: id, start, end, category, confidence, source."""
    known = recognisers.PREFERENCE

    def usual(k, s):
        (pk, fk), (ps, fs) = known.get(k[3], (5, "any")), known.get(s[3], (5, "any"))
        if k[3] == s[3]:
            if fk != "any" and (k[5] == fk) != (s[5] == fk):
                return k if k[5] == fk else s
        elif pk != ps:
            return k if pk > ps else s
        else:
            a, b = fk in (k[5], "any"), fs in (s[5], "any")
            if a != b:
                return k if a else s
            if k[2] - k[1] != s[2] - s[1]:
                return max(k, s, key=lambda x: x[2] - x[1])
        return k if k[4] >= s[4] else s

    kept = []
    for s in sorted(rows, key=lambda x: (-known.get(x[3], (5, ""))[0], -x[4], x[1], x[0])):
        out = []
        for k in kept:
            if s[2] <= k[1] or k[2] <= s[1]:
                continue
            inside = (k[1] <= s[1] and s[2] <= k[2]) or (s[1] <= k[1] and k[2] <= s[2])
            pk, ps = known.get(k[3], (5, ""))[0], known.get(s[3], (5, ""))[0]
            if inside and k[3] != s[3] and min(pk, ps) >= 6:
                if pk != ps:
                    continue
                if k[2] - k[1] != s[2] - s[1]:
                    out.append((k, max(k, s, key=lambda x: x[2] - x[1])))
                    continue
            out.append((k, usual(k, s)))
        if all(w is s for _, w in out):
            lost = [k for k, _ in out]
            kept = [k for k in kept if not any(k is x for x in lost)] + [s]
    return sorted(x[0] for x in kept)


def test_nested_overlaps_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for doc in range(150):
        for i in range(rng.randint(1, 9)):
            start = rng.randint(0, 12)
            rows.append((doc, doc * 100 + i, start, start + rng.randint(1, 8), rng.choice(["DNI_NIE", "NSS", "PHONE", "POSTAL_CODE", "DATE", "PERSON", "ADDRESS", "MISC"]), rng.choice([0.5, 0.7, 0.9]), rng.choice(["regex", "ner"])))
    got = recognisers.keeping_nested(spark.createDataFrame(rows, "doc_id long, id long, start int, end int, category string, confidence double, source string"))
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    assert sorted(r.id for r in got.collect()) == sorted(i for d in by.values() for i in brute(d))
