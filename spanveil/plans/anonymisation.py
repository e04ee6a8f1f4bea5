"""Queries of the glossary, anonymised texts, review, export and evaluation, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.functions import dates, spans, text
from spanveil.operators import detect, glossary, merge, review
from spanveil.plans.detections import D, DOCS_SQL, SIMPLE, detections, documents, found_sql, table
from spanveil.plans.scalars import _DELTA, DATED_SQL, dated
from spanveil.sources import shared

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


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail, IP and card detections of documents, overlaps removed, with project and order."""
    docs = documents(spark, sf_dir)
    rows = merge.without_overlaps(detect.native_detector(docs, SIMPLE)).join(docs.select("doc_id", "project_id", "doc_seq"), "doc_id")
    # Glossary and replacement both read the detections: they are few, and made once.
    return shared.written(rows, "detections")


_P = glossary.PREFIXES
KEPT = f"""WITH {DOCS_SQL}, {found_sql(SIMPLE)},
ranked AS (SELECT f.*, d.project_id, CASE category WHEN 'EMAIL' THEN 80 WHEN 'CREDIT_CARD' THEN 70 ELSE 0 END AS prio FROM found f JOIN docs d USING (doc_id)),
kept AS (SELECT r.* FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM ranked k WHERE k.doc_id = r.doc_id AND k.s < r.e AND r.s < k.e AND (k.s, k.e) <> (r.s, r.e) AND (-k.prio, -k.confidence, k.s - k.e, k.s) < (-r.prio, -r.confidence, r.s - r.e, r.s))),
firsts AS (SELECT project_id, category, lower(trim(value)) AS norm_key, count(*) AS occurrences, min((doc_id, -s)) AS f FROM kept GROUP BY ALL),
gloss AS (SELECT *, CASE category WHEN 'EMAIL' THEN 'Email' WHEN 'CREDIT_CARD' THEN 'Tarjeta' ELSE 'IP' END || '_' || lpad(CAST(row_number() OVER (PARTITION BY project_id, category ORDER BY f, norm_key) AS VARCHAR), 3, '0') AS alias FROM firsts),
repl AS (SELECT k.doc_id, k.s, k.e, k.value, k.category, g.alias FROM kept k JOIN gloss g ON g.project_id = k.project_id AND g.category = k.category AND g.norm_key = lower(trim(k.value)))"""
STITCH = """,
pieces2 AS (SELECT r.doc_id, r.s, substr(d.text, coalesce(lag(r.e) OVER (PARTITION BY r.doc_id ORDER BY r.s), 0) + 1, r.s - coalesce(lag(r.e) OVER (PARTITION BY r.doc_id ORDER BY r.s), 0)) || {alias} || CASE WHEN regexp_matches(substr(d.text, r.e + 1, 1), '[\\p{{L}}\\p{{N}}]') THEN ' ' ELSE '' END AS piece, r.e, d.text FROM repl r JOIN docs d USING (doc_id)),
gone AS (SELECT doc_id, count(*) AS n, string_agg(piece, '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS done FROM pieces2 GROUP BY doc_id),
every AS (SELECT d.doc_id, coalesce(n, 0) AS n_entities, CASE WHEN n IS NULL THEN text ELSE done END AS anonymized FROM docs d LEFT JOIN gone USING (doc_id))
SELECT {columns} FROM every"""
WHOLE = "doc_id, n_entities, anonymized"


def left_sql(text: str, strict: bool = True) -> list[tuple[str, str, str]]:
    """kind, severity and the list of values that the export gate finds in a text, by pattern."""
    passes = " AND ".join(f"NOT regexp_matches(v, '{p}')" for p in review.PASSES)
    return [(k, severity, f"list_filter(regexp_extract_all({text}, '(?i){p}'), lambda v: {passes})") for k, p, severity in review.GATE if strict or severity == "CRITICAL"]


@query("win_01_glossary", KEPT + " SELECT project_id, category, norm_key, alias, occurrences FROM gloss")
def _glossary(spark, sf_dir):
    return glossary.build(found(spark, sf_dir)).select("project_id", "category", "norm_key", "alias", "occurrences")


@query("ano_01_anonymize", KEPT + STITCH.format(alias="r.alias", columns=WHOLE))
def _anonymize(spark, sf_dir):
    rows = found(spark, sf_dir)
    return glossary.anonymized(documents(spark, sf_dir), glossary.replaced(rows, glossary.build(rows)))


@query("ano_02_basic_masks", KEPT + STITCH.format(alias="array_to_string(list_transform(regexp_split_to_array(trim(r.value), '[\\t\\n\\v\\f\\r ]+'), lambda w: repeat('*', greatest(length(w), 5))), ' ')", columns=WHOLE))
def _masked(spark, sf_dir):
    return glossary.anonymized(documents(spark, sf_dir), glossary.replaced(found(spark, sf_dir), None, "BASIC"))


@query("ano_04_synthetic")
def _synthetic(spark, sf_dir):
    rows = found(spark, sf_dir)
    return glossary.anonymized(documents(spark, sf_dir), glossary.replaced(rows, glossary.build(rows), "ADVANCED"))


@query("ano_09_reverse_lookup", KEPT + " SELECT doc_id, s AS \"start\", alias, lower(trim(value)) AS original FROM repl")
def _reverse(spark, sf_dir):
    rows = found(spark, sf_dir)
    g = glossary.build(rows)
    done = glossary.replaced(rows, g).select("doc_id", "project_id", "start", "alias", "category")
    return done.join(g.select("project_id", "category", "alias", c("norm_key").alias("original")), ["project_id", "category", "alias"]).select("doc_id", "start", "alias", "original")


@query("win_09_offset_shift", KEPT + " SELECT doc_id, s AS \"start\", CAST(sum(length(alias) - (e - s)) OVER (PARTITION BY doc_id ORDER BY s) AS BIGINT) AS shift FROM repl")
def _shift(spark, sf_dir):
    rows = found(spark, sf_dir)
    done = glossary.replaced(rows, glossary.build(rows))
    w = Window.partitionBy("doc_id").orderBy("start")
    return done.select("doc_id", "start", F.sum(F.length("alias") - (c("end") - c("start"))).over(w).alias("shift"))


@query("ano_01_anonymize_all_patterns")
def _anonymize_all(spark, sf_dir):
    """The whole pattern table on every document."""
    docs = documents(spark, sf_dir)
    rows = shared.written(merge.without_overlaps(detect.regex_detector(docs)).join(docs.select("doc_id", "project_id", "doc_seq"), "doc_id"), "detections")
    return glossary.anonymized(docs, glossary.replaced(rows, glossary.build(rows)))


@query("det_19_export_gate", KEPT + STITCH.format(alias="r.alias", columns="doc_id, " + ", ".join("CAST(" + " + ".join(f"len({x})" for _, _, x in left_sql("anonymized", strict)) + f" AS BIGINT) AS {name}" for strict, name in ((True, "leaks"), (False, "critical")))))
def _gate(spark, sf_dir):
    """Every kind in every document of which only e-mails, addresses and cards were replaced."""
    n = lambda strict: F.size(review.violations(c("anonymized"), strict)).cast("long")
    return _anonymize(spark, sf_dir).select("doc_id", n(True).alias("leaks"), n(False).alias("critical"))


# A text of each kind and of its near misses, in either case.
KINDS = ("12345678Z", "x1234567l", "28/12345678/40", "GB12 3456 7890 12 1234567890", "es1234567890123456789012", "4111111111111111", "5500-0000-0000-0004", "ab1234567", "Ana.Ruiz@correo.ES", "0034612345678", "812345678", "Persona_001", "61/2019", "1234567Z", "712345678 y 12345678-z", "+34612345678")
_KIND_SQL = "WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN upper(x) ELSE x END AS text FROM (SELECT c_custkey, 'véase ' || [" + ",".join(f"'{k}'" for k in KINDS) + f"][CAST(c_custkey // 2 % {len(KINDS)} + 1 AS INT)] || ', fin.' AS x FROM customer))"


def kinds(spark, sf_dir) -> DataFrame:
    x = F.concat(F.lit("véase "), F.element_at(F.array(*map(F.lit, KINDS)), (F.floor(c("c_custkey") / 2) % len(KINDS) + 1).cast("int")), F.lit(", fin."))
    return table(spark, sf_dir, "customer").select(c("c_custkey").cast("long").alias("doc_id"), F.when(c("c_custkey") % 2 == 0, F.upper(x)).otherwise(x).alias("text"))


@query("det_19_gate_kinds", _KIND_SQL + " SELECT doc_id, " + ", ".join("CAST(" + " + ".join(f"len({x})" for _, _, x in left_sql("text", strict)) + f" AS BIGINT) AS {name}" for strict, name in ((True, "strict"), (False, "lenient"))) + " FROM t")
def _gate_kinds(spark, sf_dir):
    n = lambda strict: F.size(review.violations(c("text"), strict)).cast("long")
    return kinds(spark, sf_dir).select("doc_id", n(True).alias("strict"), n(False).alias("lenient"))


def _report_sql(source: str) -> str:
    sides = left_sql("text")
    n = lambda severity: "CAST(" + " + ".join(f"len({x})" for _, s, x in sides if s == severity) + " AS BIGINT)"
    redacted = "CASE WHEN length(v) > 4 THEN substr(v, 1, 3) || '***' || right(v, 1) ELSE '***' END"
    first = "flatten([" + ", ".join(f"list_transform({x}, lambda v: '{k}:' || {redacted})" for k, _, x in sides) + "])[1:10]"
    return f"SELECT doc_id, {n('CRITICAL')} AS critical, {n('HIGH')} AS high, array_to_string({first}, ',') AS first FROM {source} WHERE {n('CRITICAL')} + {n('HIGH')} > 0"


@query("det_20_gate_report", f"WITH {DOCS_SQL} " + _report_sql("docs"))
def _report(spark, sf_dir):
    return review.gate_report(documents(spark, sf_dir))


@query("snk_01_gated_export", _KIND_SQL + " SELECT count(*) AS written, CAST(sum(length(text)) AS BIGINT) AS chars, (SELECT count(*) FROM t WHERE " + " + ".join(f"len({x})" for _, _, x in left_sql("text")) + " > 0) AS refused FROM t WHERE " + " + ".join(f"len({x})" for _, _, x in left_sql("text")) + " = 0")
def _gated(spark, sf_dir):
    path = shared.fresh(spark, "gated-export")
    refused = review.exported(kinds(spark, sf_dir), path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("written"), F.sum(F.length("value")).alias("chars")).withColumn("refused", F.lit(refused).cast("long"))


@query("ui_02_segments", KEPT + " SELECT doc_id, s AS \"start\", CAST(s - coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS INT) AS plain_before FROM kept")
def _segments(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("start")
    return found(spark, sf_dir).select("doc_id", "start", (c("start") - F.coalesce(F.lag("end").over(w), F.lit(0))).alias("plain_before"))


@query("ano_06_date_aliases", f"WITH {DATED_SQL} SELECT id, strftime(d + {_DELTA}, '%Y-%m-%d') AS moved FROM dated")
def _dates(spark, sf_dir):
    return dated(spark, sf_dir).select("id", F.date_format(dates.shift(dates.parse(c("written")), dates.project_delta(c("project"))), "yyyy-MM-dd").alias("moved"))


@query("win_02_chronological_letters", f"WITH {DATED_SQL}, r AS (SELECT DISTINCT project, d, dense_rank() OVER (PARTITION BY project ORDER BY d) - 1 AS n FROM dated), l AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a) SELECT project AS project_id, strftime(d, '%Y-%m-%d') AS day, CASE WHEN n < 26 THEN a[n + 1] WHEN n < 702 THEN a[n // 26] || a[n % 26 + 1] ELSE a[(n - 26) // 676] || a[(n - 26) // 26 % 26 + 1] || a[n % 26 + 1] END AS letters FROM r, l")
def _letters(spark, sf_dir):
    return glossary.chronological(dated(spark, sf_dir).select(c("project").alias("project_id"), "d").distinct()).select("project_id", F.date_format("d", "yyyy-MM-dd").alias("day"), "letters")


ENTRIES_SQL = "entries AS (SELECT id, doc_id % 20 AS project_id, category, value AS original, substr(category, 1, 3) || '_' || (id % 13) AS alias, id % 7 + 1 AS occurrences FROM det)"


def entries(spark, sf_dir) -> DataFrame:
    return detections(spark, sf_dir).select("id", (c("doc_id") % 20).alias("project_id"), "category", c("value").alias("original"), F.concat(F.substring("category", 1, 3), F.lit("_"), (c("id") % 13).cast("string")).alias("alias"), (c("id") % 7 + 1).alias("occurrences"))


@query("agg_08_merged_entries", f"{D}, {ENTRIES_SQL} SELECT lower(alias) AS alias, lower(category) AS category, arg_min(original, id) AS original, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(DISTINCT original) AS n_originals FROM entries GROUP BY 1, 2")
def _merged(spark, sf_dir):
    return glossary.merged_entries(entries(spark, sf_dir)).withColumn("n_originals", F.size("originals").cast("long")).drop("originals")


@query("agg_09_alias_counters", f"{D}, {ENTRIES_SQL} SELECT regexp_extract(alias, '^(.*)_[0-9]+$', 1) AS prefix, max(CAST(regexp_extract(alias, '_([0-9]+)$', 1) AS BIGINT)) AS last FROM entries GROUP BY 1")
def _counters(spark, sf_dir):
    return glossary.next_numbers(entries(spark, sf_dir))


@query("agg_05_alias_counts", f"{D}, {ENTRIES_SQL} SELECT alias, count(*) AS n, min(original) AS first FROM entries GROUP BY alias")
def _alias_counts(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("original").alias("first"))


@query("join_06_new_and_known_aliases", f"{D}, {ENTRIES_SQL}, known AS (SELECT DISTINCT alias FROM entries WHERE project_id < 1) SELECT CASE WHEN k.alias IS NULL THEN 'new' ELSE 'known' END AS state, count(*) AS n FROM (SELECT DISTINCT alias FROM entries) e LEFT JOIN known k USING (alias) GROUP BY 1")
def _new(spark, sf_dir):
    e = entries(spark, sf_dir)
    known, every = e.filter("project_id < 1").select("alias").distinct(), e.select("alias").distinct()
    rows = every.join(known, "alias", "left_anti").select(F.lit("new").alias("state")).unionByName(every.join(known, "alias", "left_semi").select(F.lit("known").alias("state")))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("join_07_partial_names", "WITH k AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS project_id, 'ana ' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' lopez' ELSE '' END AS k FROM customer) SELECT a.project_id, a.k AS short, b.k AS long FROM k a JOIN k b ON a.project_id = b.project_id AND starts_with(b.k, a.k || ' ')")
def _partial(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select(c("c_nationkey").cast("long").alias("project_id"), F.concat(F.lit("ana "), F.lower("c_mktsegment"), F.when(c("c_custkey") % 2 == 0, " lopez").otherwise("")).alias("norm_key")).distinct()
    return glossary.partial_names(k)


_FUZZY = "WITH k AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS project_id, 'juan garcia ' || lower(c_mktsegment) || (c_custkey % 3) AS k FROM customer)"


@query("join_08_fuzzy_names", _FUZZY + " SELECT a.project_id, a.k AS key1, b.k AS key2, round(100 * (1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k))::DOUBLE), 4) AS ratio FROM k a JOIN k b ON a.project_id = b.project_id AND a.k < b.k WHERE round(100 * (1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k))::DOUBLE), 4) >= 90")
def _fuzzy(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select(c("c_nationkey").cast("long").alias("project_id"), F.concat(F.lit("juan garcia "), F.lower("c_mktsegment"), (c("c_custkey") % 3).cast("string")).alias("norm_key")).distinct()
    return glossary.fuzzy_keys(k)


# Names that the glossary knows: the first two words of every document, under the document's project.
_KNOWN = "known AS (SELECT project_id, lower(regexp_extract(text, '[a-zA-Z]+ [a-zA-Z]+')) AS value, min(doc_id) AS n FROM docs WHERE length(regexp_extract(text, '[a-zA-Z]+ [a-zA-Z]+')) >= 5 GROUP BY 1, 2)"


def known_names(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select("project_id", "doc_id", F.regexp_extract("text", "[a-zA-Z]+ [a-zA-Z]+", 0).alias("original"))
    return d.groupBy("project_id", F.lower("original").alias("original")).agg(F.format_string("Persona_%d", F.min("doc_id")).alias("alias")).withColumn("category", F.lit("PERSON_NAME"))


@query("ano_08_consistency_scan", KEPT + f", {_KNOWN}, cut AS (SELECT doc_id, substr(text, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1, s - coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0)) AS gap, s FROM kept JOIN docs USING (doc_id) UNION ALL SELECT doc_id, substr(any_value(text), max(coalesce(e, 0)) + 1), 1000000000 FROM docs LEFT JOIN kept USING (doc_id) GROUP BY doc_id), gaps AS (SELECT doc_id, lower(string_agg(gap, chr(10) ORDER BY s)) AS gaps FROM cut GROUP BY doc_id) SELECT doc_id, value, 'Persona_' || n AS alias FROM gaps JOIN docs USING (doc_id) JOIN known USING (project_id) WHERE contains(gaps, value)")
def _missed(spark, sf_dir):
    rows = found(spark, sf_dir)
    return glossary.missed(documents(spark, sf_dir), known_names(spark, sf_dir), glossary.replaced(rows, glossary.build(rows)))


@query("ano_10_apply_changes", "SELECT doc_id, sha256(CASE WHEN source < 'src5' THEN regexp_replace(regexp_replace(text, 'tion', 'Persona_001', 'gi'), 'the', 'Org_002', 'gi') ELSE text END) AS digest FROM documents")
def _changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", c("source").alias("project_id"), "text")
    changes = d.filter("project_id < 'src5'").select("project_id").distinct().select("project_id", F.explode(F.create_map(F.lit("Tion"), F.lit("Persona_001"), F.lit("the"), F.lit("Org_002"))).alias("old", "new"))
    return glossary.apply_changes(d, changes).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("ano_12_count_selection", "SELECT doc_id, CAST(len(string_split(lower(text), 'the')) - 1 AS BIGINT) AS n FROM documents WHERE contains(lower(text), 'the')")
def _count(spark, sf_dir):
    n = F.regexp_count("text", F.lit(r"(?iu)\Qthe\E"))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n")).filter("n > 0")


# Review and states from events.
_ACTION = "CASE event_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'correct' ELSE 'open' END"


def reviews(spark, sf_dir) -> DataFrame:
    e = c("event_id")
    return table(spark, sf_dir, "events").select(c("user_id").cast("long").alias("doc_id"), (e % 5).cast("long").alias("entity_id"), F.expr(_ACTION).alias("action"), "ts", e)


@query("agg_07_review_summary", f"WITH l AS (SELECT *, {_ACTION} AS action, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts DESC, event_id DESC) AS n FROM events), s AS (SELECT CAST(user_id AS BIGINT) AS doc_id, count(*) AS total, count(*) FILTER (action = 'approve') AS approved, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action = 'correct') AS corrected FROM l WHERE n = 1 GROUP BY 1) SELECT *, approved + rejected + corrected AS reviewed, total - approved - rejected - corrected AS pending, round((approved + rejected + corrected) * 100.0::DOUBLE / total, 4) AS progress FROM s")
def _summary(spark, sf_dir):
    return review.review_summary(reviews(spark, sf_dir))


_STATES = ("PENDING", "INGESTED", "DETECTING", "DETECTED", "ANONYMIZING", "ANONYMIZED", "FAILED")


@query("join_14_illegal_moves", "WITH s AS (SELECT CAST(user_id AS BIGINT) AS doc_id, event_id, " + "[" + ",".join(f"'{x}'" for x in _STATES) + "][CAST(event_id % 7 + 1 AS INT)] AS state, ts FROM events), p AS (SELECT *, lag(state) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS before FROM s) SELECT doc_id, event_id, before, state FROM p WHERE before IS NOT NULL AND state <> 'FAILED' AND before || '>' || state NOT IN (" + ",".join(f"'{a}>{b}'" for a, b in review.MOVES) + ")")
def _moves(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, _STATES)), (c("event_id") % 7 + 1).cast("int"))
    return review.illegal_moves(table(spark, sf_dir, "events").select(c("user_id").cast("long").alias("doc_id"), "event_id", "ts", state.alias("state")))


@query("agg_11_event_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("stm_03_bounded_history", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1000")
def _history(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(c("ts").desc(), c("event_id").desc())
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n <= 1000").select("event_id")


_TYPED = "upper(substr(CASE doc_id % 4 WHEN 0 THEN 'Sentencia. Fallo ' WHEN 1 THEN 'Factura, IVA, total ' WHEN 2 THEN 'Denuncia ' ELSE '' END || text, 1, 500))"


def _score(words) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches(h, '{w}') THEN 1 ELSE 0 END" for w in words) + f") / {len(words)}.0::DOUBLE"


@query("agg_17_document_type", f"WITH h AS (SELECT doc_id, {_TYPED} AS h FROM documents), s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, {i} AS o, {_score(w)} AS score FROM h" for i, (k, w) in enumerate(review.TYPES.items())) + ") SELECT doc_id, CASE WHEN score > 0 THEN type ELSE 'GENERIC' END AS type, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) = 1")
def _types(spark, sf_dir):
    return review.classified(typed(spark, sf_dir))


def typed(spark, sf_dir) -> DataFrame:
    head = F.when(c("doc_id") % 4 == 0, "Sentencia. Fallo ").when(c("doc_id") % 4 == 1, "Factura, IVA, total ").when(c("doc_id") % 4 == 2, "Denuncia ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, "text").alias("text"))


@query("agg_18_export_checks", f"{D}, n AS (SELECT doc_id, category, count(*) AS n FROM det GROUP BY ALL), t AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, ['ESCRITURA','SENTENCIA','FACTURA','DENUNCIA','GENERIC'][CAST(o_orderkey % 5 + 1 AS INT)] AS type FROM orders), r AS (SELECT * FROM (VALUES " + ",".join(f"('{a}','{b}',{n},'{s}')" for a, b, n, s in review.SANITY) + ") v(type, category, least, severity)), x AS (SELECT t.doc_id, r.severity, r.category IS NOT NULL AND coalesce(n.n, 0) < r.least AS failed FROM t LEFT JOIN r USING (type) LEFT JOIN n ON n.doc_id = t.doc_id AND n.category = r.category) SELECT doc_id, count(*) FILTER (failed AND severity = 'CRITICAL') AS critical, count(*) FILTER (failed AND severity = 'WARNING') AS warnings, count(*) FILTER (failed AND severity = 'CRITICAL') = 0 AS can_export FROM x GROUP BY doc_id")
def _export(spark, sf_dir):
    types = table(spark, sf_dir, "orders").select(c("o_orderkey").cast("long").alias("doc_id"), F.element_at(F.array(*map(F.lit, ("ESCRITURA", "SENTENCIA", "FACTURA", "DENUNCIA", "GENERIC"))), (c("o_orderkey") % 5 + 1).cast("int")).alias("type"))
    return review.export_checks(types, detections(spark, sf_dir).groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n")))


def labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Gold spans of customers and predictions that hit, change the type, shift, miss or invent."""
    k = c("c_custkey").cast("long")
    cust = table(spark, sf_dir, "customer").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(k.alias("case_id"), "j", (k * 7 + c("j")).alias("x"), c("c_mktsegment").alias("category"))
    gold = cust.filter("x % 5 <> 4").select("case_id", (c("j") * 20).alias("start"), (c("j") * 20 + 10).alias("end"), F.lit("PERSON").alias("type"), "category")
    made = cust.filter("x % 5 <> 3").select("case_id", (c("j") * 20 + F.when(c("x") % 5 == 2, 3).otherwise(0)).alias("start"), (c("j") * 20 + 10).alias("end"), F.when(c("x") % 5 == 1, "DATE").otherwise("PERSON").alias("type"), "category")
    return gold, made


_CASES = "WITH x AS (SELECT CAST(c_custkey AS BIGINT) AS case_id, CAST(c_custkey * 7 + j AS BIGINT) % 5 AS r, c_mktsegment AS category FROM customer, (SELECT unnest([0, 1, 2, 3]) AS j)), s AS (SELECT case_id, category, count(*) FILTER (r = 0) AS cor, count(*) FILTER (r = 1) AS inc, count(*) FILTER (r = 2) AS par, count(*) FILTER (r = 3) AS mis, count(*) FILTER (r = 4) AS spu, count(*) FILTER (r <> 4) AS pos, count(*) FILTER (r <> 3) AS act FROM x GROUP BY ALL)"


@query("agg_12_semeval_counts", _CASES + " SELECT case_id, cor, inc, par, mis, spu, pos, act FROM s")
def _semeval(spark, sf_dir):
    return review.semeval(*labelled(spark, sf_dir))


_F1 = "WITH_ round(CASE WHEN {a} + {b} > 0 THEN 2 * {a} * {b} / ({a} + {b}) ELSE 0 END, 6)".replace("WITH_ ", "")


@query("agg_13_scores_by_category", _CASES + ", t AS (SELECT category, sum(cor) / sum(act)::DOUBLE AS p, sum(cor) / sum(pos)::DOUBLE AS r, (sum(cor) + 0.5 * sum(par)) / sum(act)::DOUBLE AS pp, (sum(cor) + 0.5 * sum(par)) / sum(pos)::DOUBLE AS pr FROM s GROUP BY category) SELECT category, round(p, 6) AS precision, round(r, 6) AS recall, " + _F1.format(a="p", b="r") + " AS f1, " + _F1.format(a="pp", b="pr") + " AS partial_f1 FROM t")
def _scores(spark, sf_dir):
    gold, made = labelled(spark, sf_dir)
    category = gold.select("case_id", "category").union(made.select("case_id", "category")).distinct()
    return review.scores(review.semeval(gold, made).join(category, "case_id"), ["category"])


@query("evl_01_boundary_diagnosis", "SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_custkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'over_extended' WHEN 2 THEN 'truncated' ELSE 'partial_overlap' END AS kind FROM customer")
def _boundary(spark, sf_dir):
    k = c("c_custkey") % 4
    seen = F.when(k == 0, c("c_name")).when(k == 1, F.concat(F.lit("Don "), "c_name")).when(k == 2, F.substring("c_name", 2, 5)).otherwise(F.concat(F.substring("c_name", 3, 50), F.lit("!")))
    return table(spark, sf_dir, "customer").select(c("c_custkey").cast("long").alias("id"), review.boundary(c("c_name"), seen).alias("kind"))


@query("evl_02_entity_offsets", "SELECT doc_id, CAST(coalesce(nullif(strpos(text, v), 0), nullif(strpos(lower(text), lower(v)), 0)) - 1 AS INT) AS \"start\" FROM (SELECT doc_id, text, upper(substr(text, 6, 8)) AS v FROM documents) WHERE coalesce(nullif(strpos(text, v), 0), nullif(strpos(lower(text), lower(v)), 0)) IS NOT NULL")
def _offsets(spark, sf_dir):
    v = F.upper(F.substring("text", 6, 8))
    at = F.coalesce(F.nullif(F.instr(c("text"), v), F.lit(0)), F.nullif(F.instr(F.lower("text"), F.lower(v)), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", (at - 1).cast("int").alias("start")).filter("start IS NOT NULL")


@query("gen_03_template_fill", "SELECT CAST(c_custkey AS BIGINT) AS id, 'Comparece ' || c_name || ' el día ' || (c_custkey % 28 + 1) || '.' AS text, 10 AS person_start, CAST(10 + length(c_name) AS INT) AS person_end FROM customer")
def _fill(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(c("c_custkey").cast("long").alias("id"), F.concat(F.lit("Comparece "), "c_name", F.lit(" el día "), (c("c_custkey") % 28 + 1).cast("string"), F.lit(".")).alias("text"), F.length(F.lit("Comparece ")).alias("person_start"), (F.length(F.lit("Comparece ")) + F.length("c_name")).alias("person_end"))


@query("gen_04_hash_split", "SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS part, count(*) AS n FROM (SELECT CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS b FROM orders) GROUP BY 1")
def _split(spark, sf_dir):
    b = F.conv(F.substring(F.md5(c("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return table(spark, sf_dir, "orders").groupBy(F.when(b < 80, "train").when(b < 90, "dev").otherwise("test").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_16_centroids", "WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM u GROUP BY vec_id), m AS (SELECT label, i, avg(x / n) AS m FROM u JOIN n USING (vec_id) WHERE n > 0 GROUP BY label, i), z AS (SELECT label, sqrt(sum(m * m)) AS z FROM m GROUP BY label) SELECT CAST(label AS BIGINT) AS label, CAST(i AS INT) AS i, round(m / z, 6) AS x FROM m JOIN z USING (label)")
def _centroids(spark, sf_dir):
    return centroids(table(spark, sf_dir, "embeddings")).select(c("label").cast("long"), F.posexplode("v").alias("i", "x")).select("label", (c("i") + 1).cast("int").alias("i"), F.round("x", 6).alias("x"))


def unit(v):
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / n)


def centroids(embeddings: DataFrame) -> DataFrame:
    """label and the unit mean of its unit vectors, element by element with map-side sums."""
    units = embeddings.select("label", unit(c("embedding").cast("array<double>")).alias("v")).filter(F.forall("v", lambda x: ~F.isnan(x)))
    means = units.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v")).select("label", unit(c("v")).alias("v"))


@query("flt_08_type_validation")
def _validation(spark, sf_dir):
    """Each vector's nearest centroid: kept, reclassified or flagged by cosine and margin."""
    e = table(spark, sf_dir, "embeddings")
    cs = F.broadcast(centroids(e).agg(F.collect_list(F.struct("label", "v")).alias("cs")))  # one row for each label: bounded by the number of types
    u = unit(c("embedding").cast("array<double>"))
    near = F.reverse(F.array_sort(F.transform("cs", lambda k: F.struct(F.round(F.aggregate(F.zip_with(k["v"], u, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6).alias("cos"), k["label"].alias("label")))))
    best, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    margin = best["cos"] - second["cos"]
    verdict = F.when(best["label"] == c("label"), "KEEP").when((best["cos"] >= 0.75) & (margin >= 0.10), "RECLASSIFY").when(margin < 0.05, "FLAG").otherwise("KEEP")
    return e.join(cs).select("vec_id", "label", "embedding", near.alias("near")).select("vec_id", best["label"].alias("nearest"), verdict.alias("verdict"))
