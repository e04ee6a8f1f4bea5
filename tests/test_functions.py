"""Functions and folds on hand-made cases."""

import io
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanveil.functions import checks, dates, spans, text
from spanveil.operators import detect, glossary, merge, review
from spanveil.sources import documents


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("check", "good", "bad"), [(checks.dni_valid, "12345678Z", "12345678A"), (checks.nie_valid, "X1234567L", "X1234567A"), (checks.iban_valid, "ES91 2100 0418 4502 0005 1332", "ES92 2100 0418 4502 0005 1332"), (checks.nss_valid, "281234567840", "281234567841"), (checks.cif_valid, "A58818501", "A58818502"), (checks.luhn_valid, "4111111111111111", "4111111111111112")])
def test_checksums(spark, check, good, bad):
    assert one(spark, check(F.col("v")), v=good) is True and one(spark, check(F.col("v")), v=bad) is False
    assert one(spark, check(F.col("v")), v="x") in (False, None) and one(spark, check(F.col("v")), v=None) is None


def test_generated_identifiers_fail_their_checksum(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    r = keys.agg(*[F.count_if(valid(make(F.col("k")))).alias(n) for n, make, valid in (("d", checks.invalid_dni, checks.dni_valid), ("e", checks.invalid_nie, checks.nie_valid), ("i", checks.invalid_iban, checks.iban_valid), ("s", checks.invalid_nss, checks.nss_valid), ("c", checks.invalid_card, checks.luhn_valid))]).first()
    assert tuple(r) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize(("written", "iso"), [("15 de marzo de 2024", "2024-03-15"), ("03/05/2021", "2021-05-03"), ("3-5-2021", "2021-05-03"), ("2021-05-03", "2021-05-03"), ("2021/05/03", "2021-05-03"), ("31/02/2021", None), ("soon", None), (None, None)])
def test_dates(spark, written, iso):
    d = one(spark, dates.parse(F.col("v")), v=written)
    assert (d and d.isoformat()) == iso


def test_roman_and_keys(spark):
    assert one(spark, dates.roman(F.col("v")), v="MCMXCIV") == 1994 and one(spark, dates.roman(F.col("v")), v="abc") is None
    assert one(spark, text.glossary_key(F.col("v"), F.lit("PERSON_NAME")), v=" Don  Juan   García ") == "juan garcía"
    assert one(spark, text.glossary_key(F.col("v"), F.lit("ORGANIZATION")), v="Acme, S.L.") == "acme"
    assert one(spark, text.unicode_form(F.col("v")), v="ﬁn１") == "fin1"


@given(st.text(alphabet="ab1 .ñ\n", max_size=40))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_extracted_spans_stand_where_they_say(spark, value):
    import re

    got = one(spark, spans.extract(F.col("v"), r"[ab]+1?"), v=value)
    assert [(s.start, s.end, s.value) for s in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[ab]+1?", value)]


def test_stitching_keeps_the_rest(spark):
    df = spark.createDataFrame([("ñ uno dos, x", [(2, 5, "A_1"), (6, 9, "B_1")])], "t string, s array<struct<start: int, end: int, alias: string>>")
    assert df.select(spans.stitch(F.col("t"), F.col("s"))).first()[0] == "ñ A_1 B_1, x"
    glued = spark.createDataFrame([("unodos", [(0, 3, "A_1")])], "t string, s array<struct<start: int, end: int, alias: string>>")
    assert glued.select(spans.stitch(F.col("t"), F.col("s"))).first()[0] == "A_1 dos"


def test_detector_rules(spark):
    texts = ["Comparece D. Juan García Pérez, con DNI 12345678Z y 12345678A.", "La empresa Acme S.L. en c/ Mayor nº 15", "Tel. +34 612 345 678", "", None]
    found = detect.regex_detector(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {(r.category, r.value): round(r.confidence, 4) for r in found}
    assert by[("PERSON_NAME", "Juan García Pérez")] == 0.98
    assert by[("DNI_NIE", "12345678Z")] == 1.0 and by[("DNI_NIE", "12345678A")] == 0.665
    assert by[("PHONE", "+34 612 345 678")] == 0.95
    assert all(texts[r.doc_id][r.start : r.end] == r.value for r in found)


def test_overlap_removal_keeps_the_more_important(spark):
    rows = [(1, 0, 10, "DATE", "d", 0.9), (1, 5, 14, "DNI_NIE", "i", 0.5), (1, 20, 30, "ADDRESS", "a", 0.9), (1, 35, 40, "LOCATION", "l", 0.9), (1, 60, 70, "LOCATION", "m", 0.9)]
    out = merge.without_overlaps(spark.createDataFrame(rows, "doc_id long, start int, end int, category string, value string, confidence double"))
    assert sorted(r.value for r in out.collect()) == ["a", "i", "m"]


def test_aliases_are_unique_and_stable(spark):
    rows = [("p", i // 3, "EMAIL", f"u{i % 7}@x.es", i % 3 * 20) for i in range(60)]
    df = spark.createDataFrame(rows, "project_id string, doc_seq long, category string, value string, start int")
    first = glossary.build(df).select("norm_key", "alias").collect()
    assert len(first) == len({r.alias for r in first}) == 7
    assert sorted(map(tuple, first)) == sorted(map(tuple, glossary.build(df.repartition(5)).select("norm_key", "alias").collect()))
    small = glossary.numbered(df.select("project_id", "doc_seq", "start", "value"), ["project_id"], "doc_seq", [F.col("start").desc()], bucket=4).collect()
    assert sorted(r.number for r in small) == list(range(1, 61))


def test_no_personal_data_after_anonymising(spark):
    docs = spark.createDataFrame([(1, "p", 1, "Mail a@b.es and a@b.es, card 4111 1111 1111 1111.")], "doc_id long, project_id string, doc_seq long, text string")
    found = merge.without_overlaps(detect.regex_detector(docs, categories=["EMAIL", "CREDIT_CARD"])).join(docs.drop("text"), "doc_id")
    for level in glossary.LEVELS:
        out = glossary.anonymized(docs, glossary.replaced(found, glossary.build(found), level))
        left = review.gate(out.select("doc_id", F.col("anonymized").alias("text"))).filter("kind = 'EMAIL'")
        assert left.count() == 0 and out.first().n_entities == 3


def test_files_by_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("año".encode())
    (tmp_path / "b.TXT").write_bytes("año".encode("latin-1"))
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"broken")
    buffer = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Uno</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(buffer.getvalue())
    out = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert out["a.txt"].text == out["b.TXT"].text == "año" and out["c.docx"].text == "Uno\na | b"
    assert out["d.pdf"].error == "no extractor for pdf" and out["e.docx"].error.startswith("BadZipFile")


def test_fuzzy_keys_find_all_pairs(spark):
    import random

    pick = random.Random(3)
    keys = {"jose antonio fernandez lopez", "josé antonio fernandez lópez", "ab", "a", "ñandú gil"}
    for _ in range(40):
        key = " ".join("".join(pick.choice("abcé") for _ in range(pick.randint(2, 9))) for _ in range(pick.randint(1, 4)))
        keys.add(key)
        for _ in range(4):
            at = pick.randrange(len(key))
            key = key[:at] + pick.choice(["", "x", "xy"]) + key[at + pick.randint(0, 1) :]
            keys.add(key)
    keys = sorted(keys)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    ratios = {(a, b): round(100 * (1 - distance(a, b) / max(len(a), len(b))), 4) for i, a in enumerate(keys) for b in keys[i + 1 :]}
    rows = spark.createDataFrame([(p, k) for p in (1, 2) for k in keys], "project_id long, norm_key string")
    for least in (90.0, 75.0):
        want = {(p, *pair) for p in (1, 2) for pair, r in ratios.items() if r >= least}
        assert {(r.project_id, r.key1, r.key2) for r in glossary.fuzzy_keys(rows, least).collect()} == want
    assert ratios["jose antonio fernandez lopez", "josé antonio fernandez lópez"] >= 90


def test_missed_entries_are_replaced_outside_of_replacements(spark):
    from spanveil.operators import glossary

    docs = spark.createDataFrame([(1, "p", "ANA RUIZ vio a ana ruiz lópez y a Ana Ruizz en Acme. x@y.es"), (2, "p", "nada"), (3, "q", "Ana Ruiz"), (4, "p", None), (5, "p", "acme")], "doc_id long, project_id string, text string")
    entries = spark.createDataFrame([("p", "PERSON_NAME", "Ana Ruiz", "Persona_001"), ("p", "PERSON_NAME", "Ana Ruiz López", "Persona_002"), ("p", "ORGANIZATION", "Acme", "Org_001"), ("p", "DATE", "vio a", "Fecha_001")], "project_id string, category string, original string, alias string")
    done = spark.createDataFrame([(1, 0, 8, "Persona_001"), (1, 53, 59, "Email_001")], "doc_id long, start int, end int, alias string")
    assert {(r.doc_id, r.value) for r in glossary.missed(docs, entries, done).collect()} == {(1, "ana ruiz"), (1, "ana ruiz lópez")}
    out = {r.doc_id: r.text for r in glossary.rescanned(docs, entries, done).collect()}
    assert out[1] == "Persona_001 vio a Persona_002 y a Persona_001 z en Acme. Email_001" and out[2] == "nada" and out[3] == "Ana Ruiz" and out[5] == "acme"


def test_names_that_begin_alike_cost_no_candidates(spark, monkeypatch):
    from spanveil.operators import occurrences as o

    names = [f"maria {a}{b}" for a in "abcdefghij" for b in "klmnopqrst"] + ["ana ñu", "ñandú y", "maría de la concepción de los ángeles ruiz", "x" * 70, "a😀b", "x" * 8, "maria " * 3]
    known = spark.createDataFrame([(p, v) for p in ("p", "q", None) for v in names], "project_id string, value string")
    texts = [" ".join(f"maria {chr(97 + i % 26)}{chr(97 + j)}" for j in range(26)) for i in range(26)] + ["banana ñudo", "ñandú yo", "ana ñ", "", None, "la maría de la concepción de los ángeles ruiz", "y" + "x" * 80, "maria " * 5, "xx", "a😀", "a😀bb", "maria", " ak"]
    docs = [(i, p, t) for i, (p, t) in enumerate((p, t) for p in ("p", "r", None) for t in texts)]
    rows = spark.createDataFrame(docs, "doc_id long, project_id string, text string").coalesce(1)
    want = {(i, v) for i, p, t in docs for v in names if p == "p" and t is not None and v in t}
    for n_bits in (1 << 29, 1 << 10):  # wrong bits cost rows, not results
        monkeypatch.setattr(o, "MOST_BITS", n_bits)
        assert sorted((r.doc_id, r.value) for r in o.occurrences(rows, known).collect()) == sorted(want)
    monkeypatch.undo()
    # 26 documents of 100 names that share their first letters: no candidate but those that stand there.
    assert o.candidates(rows, known.filter("project_id IS NOT NULL")).count() <= len(want) + 5
    # A text that is read in pieces.
    long = "é" * (o.PIECE // 2 - 3) + "maria ak" + "é" * o.PIECE + "maria bl maria ak"
    rows = spark.createDataFrame([(1, "q", long), (2, "q", "maria"), (3, "q", " ak")], rows.schema)
    assert sorted((r.doc_id, r.value) for r in o.occurrences(rows, known).collect()) == [(1, "maria ak"), (1, "maria bl")]
    assert not o.occurrences(rows.limit(0), known).count() and not o.occurrences(rows, known.limit(0)).count()


def test_changes_fold_case_and_do_not_chain(spark):
    from spanveil.operators import glossary

    docs = spark.createDataFrame([(1, "p", "PERSONA_1 y persona_10, $Org_1\\E"), (2, "q", "Persona_1")], "doc_id long, project_id string, text string")
    changes = spark.createDataFrame([("p", "Persona_1", "Persona_10"), ("p", "Persona_10", "Org_1"), ("p", "Org_1\\E", "$1")], "project_id string, old string, new string")
    assert {r.doc_id: r.text for r in glossary.apply_changes(docs, changes).collect()} == {1: "Persona_10 y Org_1, $$1", 2: "Persona_1"}


def test_offset_maps_come_in_bounded_pieces(spark):
    import pyarrow as pa

    odd = ["", "  a ​  b", "­­ x", None, "А  — “з” 😀  ⁠ z", " "]
    long = ["a  ​" * (text.PIECE // 8)] * 5

    def plain(t):
        places, kept = [], ""
        table = {"А": "A", " ": " ", "—": "-", "“": '"', "”": '"'}
        for i, ch in enumerate(table.get(ch, ch) for ch in t):
            if ch not in "​­⁠" and not (ch == " " and kept.endswith(" ")):
                kept, places = kept + ch, [*places, i]
        return kept, places

    pieces = list(text.mapped_pieces(iter([pa.array([*odd, *long])])))
    assert len(pieces) > 2 and all(sum(len(m or "") for m in p.field("char_map").to_pylist()) <= 2 * text.PIECE for p in pieces)
    done = [(r["text"], r["char_map"]) for p in pieces for r in p.to_pylist()]
    assert len(done) == len(odd) + len(long) and done[: len(odd)] == [(None, None) if t is None else plain(t) for t in odd]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i long, t string").select("i", text.mapped(F.col("t")).alias("m")).orderBy("i").collect()
    assert [(r["m"]["text"], r["m"]["char_map"]) for r in rows if odd[r["i"]] is not None] == [plain(t) for t in odd if t is not None]
