"""Queries of filters, sources, sinks and streams, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators import filters
from spanveil.plans.anonymisation import ENTRIES_SQL, KEPT, entries
from spanveil.plans.detections import D, SIMPLE, table
from spanveil.sources import documents as files
from spanveil.sources import shared
from spanveil.streaming import flows

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


VALUES = ("FUNDAMENTOS DE DERECHO", "Juan García", "Quien", "12/2020", "fallo", "Sentencia núm. 12/2020", "LEC", "artículos 24 y 25.1 CE", "WhatsApp", "para", "Ana", "ana", "ONU", "Telefónica", "hiza de la", "\"Acme", "ECLI:ES:TS:2020:12", "Unión", "Ley 39/2015", "Lo", "15 de marzo de 2024", "123/2021-AB", "3.5.2020", "Valencia")


def values(spark, sf_dir) -> DataFrame:
    k = c("c_custkey").cast("long")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), pick(VALUES, k).alias("value"), pick(("PERSON_NAME", "ORGANIZATION", "LOCATION"), F.floor(k / 24)).alias("category"), pick(("roberta", "regex"), F.floor(k / 72)).alias("source"), (k % 10 / 10).alias("confidence"), pick(CONTEXTS, k).alias("before"))


CONTEXTS = ("comparece don ", "sito en la calle mayor, ", "el banco ", "Juzgado de lo Social nº 4 de ", "según consta ", "la Audiencia Provincial de ", "hijo de ")


def _list(names) -> str:
    return "[" + ",".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


VALUES_SQL = f"""WITH v AS (SELECT CAST(c_custkey AS BIGINT) AS id, {_list(VALUES)}[CAST(c_custkey % {len(VALUES)} + 1 AS INT)] AS value, ['PERSON_NAME','ORGANIZATION','LOCATION'][CAST((c_custkey // 24) % 3 + 1 AS INT)] AS category,
  ['roberta','regex'][CAST((c_custkey // 72) % 2 + 1 AS INT)] AS source, c_custkey % 10 / 10.0::DOUBLE AS confidence, {_list(CONTEXTS)}[CAST(c_custkey % {len(CONTEXTS)} + 1 AS INT)] AS before FROM customer)"""


def _or(patterns) -> str:
    return " OR ".join(f"regexp_matches(value, '(?i){p}')" for p in patterns)


def _in(words) -> str:
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


@query("flt_01_false_positives", f"{VALUES_SQL} SELECT id, {_or(filters.FALSE_POSITIVES)} AS dropped FROM v")
def _fp(spark, sf_dir):
    return values(spark, sf_dir).select("id", filters.false_positive(c("value")).alias("dropped"))


@query("flt_02_stopwords", f"{VALUES_SQL} SELECT id, lower(value) IN {_in(filters.STOPWORDS)} OR lower(value) IN {_in(filters.GENERIC)} OR (category = 'PERSON_NAME' AND lower(value) IN {_in(filters.PLATFORMS)}) OR (length(value) <= 5 AND NOT contains(value, ' ') AND (lower(value) IN {_in(filters.SHORT_WORDS)} OR (length(value) <= 3 AND regexp_matches(value, '^\\p{{L}}+$') AND upper(value) <> value))) AS dropped FROM v")
def _stop(spark, sf_dir):
    return values(spark, sf_dir).select("id", filters.stopword(c("value"), c("category")).alias("dropped"))


@query("flt_03_model_scraps", f"{VALUES_SQL} SELECT id, source = 'roberta' AND (length(regexp_replace(value, '[^\\p{{L}}]', '', 'g')) <= 2 OR regexp_matches(value, '^[\"'']') OR regexp_matches(value, '\\s(?:de|del|de la)$') OR regexp_matches(value, '^\\p{{Ll}}') OR NOT regexp_matches(value, '^[\\p{{L}}\\p{{N}}]') OR (category = 'ORGANIZATION' AND NOT contains(value, ' ') AND value NOT IN {_in(filters.ONE_WORD_ORGANISATIONS)} AND confidence < 0.85)) AS dropped FROM v")
def _scraps(spark, sf_dir):
    return values(spark, sf_dir).select("id", filters.garbage(c("value"), c("category"), c("confidence"), c("source")).alias("dropped"))


def _anchor_sql(column: str, anchors) -> str:
    # \b of RE2 knows ASCII letters only, so neighbours are tested as letters, digits and underscore.
    w = "[\\p{L}\\p{N}_]"
    return "(" + " OR ".join(f"regexp_matches(lower({column}), '(?:^|[^\\p{{L}}\\p{{N}}_]){a.lower().replace('.', chr(92) + '.')}" + (f"(?:$|[^\\p{{L}}\\p{{N}}_])" if a[-1].isalnum() else w) + "')" for a in anchors) + ")"


@query("prj_01_anchors", f"{VALUES_SQL} SELECT id, CASE WHEN {_anchor_sql('before', filters.PERSON_ANCHORS)} THEN 'PERSON_NAME' WHEN {_anchor_sql('before', filters.LOCATION_ANCHORS)} THEN 'LOCATION' WHEN {_anchor_sql('before', filters.ORGANISATION_ANCHORS)} OR {_anchor_sql('value', filters.ORGANISATION_SUFFIXES)} THEN 'ORGANIZATION' ELSE category END AS category FROM v")
def _anchors(spark, sf_dir):
    return values(spark, sf_dir).select("id", filters.anchored_category(F.concat("before", "value"), F.length("before"), c("value"), c("category")).alias("category"))


@query("prj_02_overrides", f"{VALUES_SQL} SELECT id, CASE WHEN {_or(filters.DATE_SHAPES)} THEN 'DATE' WHEN {_or(filters.CASE_SHAPES)} THEN 'CASE_NUMBER' WHEN category = 'ORGANIZATION' AND (" + " OR ".join(f"regexp_matches(before, '(?i){p}')" for p in filters.COURT_BEFORE) + ") THEN 'LOCATION' ELSE category END AS category FROM v")
def _overrides(spark, sf_dir):
    return values(spark, sf_dir).select("id", filters.overridden(F.concat("before", "value"), F.length("before"), c("value"), c("category")).alias("category"))


@query("flt_10_research_verdict", f"{VALUES_SQL} SELECT CASE WHEN length(value) < 3 THEN 'TOO_SHORT' ELSE 'OK' END AS verdict, count(*) AS n FROM v GROUP BY 1")
def _verdict(spark, sf_dir):
    return values(spark, sf_dir).select(filters.research_verdict(F.lit("PERSON"), c("value"), c("before"), F.lit(True)).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# Sources and sinks.


@query("src_03_decoded_bytes", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _decoded(spark, sf_dir):
    """Every text in one of three encodings; Latin-1 where it can write the text and the bytes are no UTF-8."""
    d = table(spark, sf_dir, "documents")
    latin = c("text").rlike(r"^[\x00-\x7F\xA0-\xFF]*$") & c("text").rlike(r"[\xA0-\xFF](?:[\x00-\x7F]|$)")
    utf8 = F.encode("text", "UTF-8")
    raw = F.when(c("doc_id") % 3 == 0, utf8).when((c("doc_id") % 3 == 1) | ~latin, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(F.encode(F.when(latin, c("text")).otherwise(""), "ISO-8859-1"))
    return d.select("doc_id", F.sha2(files.decoded(raw), 256).alias("digest"))


@query("src_08_project_page", "SELECT doc_id FROM documents WHERE source = 'src1' ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 5")
def _read(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("source = 'src1'").orderBy(c("n_chars").desc(), "doc_id").offset(5).limit(10).select("doc_id")


@query("src_09_latest_version", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _latest(spark, sf_dir):
    return files.latest(table(spark, sf_dir, "events"), ["user_id"], [c("ts"), c("event_id")]).select("user_id", "event_id")


@query("src_12_upload_verdict", "SELECT CASE WHEN doc_id % 4 = 3 THEN 'unsupported' WHEN doc_id % 5 = 0 THEN 'too large' WHEN doc_id % 7 = 0 THEN 'empty' ELSE 'ok' END AS verdict, count(*) AS n FROM documents GROUP BY 1")
def _upload(spark, sf_dir):
    name = F.concat(c("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".PDF", ".docx", ".exe"))), (c("doc_id") % 4 + 1).cast("int")))
    size = F.when(c("doc_id") % 5 == 0, files.MAX_BYTES + 1).otherwise(100)
    return table(spark, sf_dir, "documents").select(files.upload_verdict(name, size, F.when(c("doc_id") % 7 == 0, " ").otherwise(c("text"))).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("src_13_gazetteer_long", "SELECT c_name AS name, decade, CAST(frequency AS BIGINT) AS frequency FROM (SELECT c_name, unnest(['d1950','d1960','d1970']) AS decade, unnest([c_custkey % 3, c_custkey % 4, c_custkey % 5]) AS frequency FROM customer) WHERE frequency > 0")
def _long(spark, sf_dir):
    k = c("c_custkey").cast("long")
    wide = table(spark, sf_dir, "customer").select(c("c_name").alias("name"), (k % 3).alias("d1950"), (k % 4).alias("d1960"), (k % 5).alias("d1970"))
    return files.names_long(wide, "name", ["d1950", "d1960", "d1970"])


@query("src_13_municipalities", "SELECT lpad(CAST(c_custkey % 200 * 37 AS VARCHAR), 5, '0') AS postal, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS names FROM customer GROUP BY 1")
def _towns(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((c("c_custkey") % 200 * 37).alias("postal"), c("c_mktsegment").alias("name"))
    return files.municipalities(rows).withColumn("names", F.array_join("names", ","))


@query("snk_02_glossary_csv", f"{D}, {ENTRIES_SQL} SELECT original, alias, category, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM entries GROUP BY 1, 2, 3")
def _csv(spark, sf_dir):
    path = shared.fresh(spark, "glossary-csv")
    files.write_glossary(entries(spark, sf_dir).groupBy("original", "alias", "category").agg(F.sum("occurrences").alias("occurrences")), path)
    return spark.read.option("header", "true").option("escape", '"').schema("original string, alias string, category string, occurrences long").csv(path)


@query("jsn_01_round_trip", "SELECT event_id, event_type FROM events")
def _json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct("event_id", F.struct("event_type").alias("inner")))
    return e.select(F.from_json(body, "event_id bigint, inner struct<event_type: string>").alias("x")).select("x.event_id", "x.inner.event_type")


# Streams.


@query("stm_03_streaming_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _counts(spark, sf_dir):
    return flows.collected(flows.event_counts(flows.arriving(spark, sf_dir, "events")), "counts", "complete")


@query("stm_01_growing_glossary", KEPT + " SELECT project_id, category, norm_key, alias FROM gloss")
def _growing(spark, sf_dir):
    from spanveil.functions import text
    from spanveil.operators import detect, merge

    def found(batch: DataFrame) -> DataFrame:
        docs = batch.select(c("doc_id").cast("long"), c("source").alias("project_id"), c("doc_id").cast("long").alias("doc_seq"), text.ingest(c("text"), None).alias("text"))
        return merge.without_overlaps(detect.native_detector(docs, SIMPLE)).join(docs.select("doc_id", "project_id", "doc_seq"), "doc_id")

    path = shared.fresh(spark, "glossary")
    flows.growing_glossary(flows.arriving(spark, sf_dir, "documents"), found, path)
    return spark.read.parquet(path).select("project_id", "category", "norm_key", "alias")


@query("stm_06_one_run_at_a_time")
def _once(spark, sf_dir):
    return flows.collected(flows.one_run_at_a_time(flows.arriving(spark, sf_dir, "events").select("event_id", "user_id", "event_type", c("ts").cast("timestamp").alias("ts"))), "once").select("user_id", "event_type")


@query("stm_x_hourly_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _hours(spark, sf_dir):
    """An extension: event-time windows with a watermark."""
    e = flows.arriving(spark, sf_dir, "events").select(c("ts").cast("timestamp").alias("ts"), "event_type")
    per = e.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")
    return flows.collected(per, "hours", "complete")


