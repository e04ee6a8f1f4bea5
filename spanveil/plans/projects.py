"""Queries of the smaller project operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.functions import spans, text
from spanveil.operators import glossary, project
from spanveil.plans.anonymisation import KEPT, found
from spanveil.plans.detections import D, detections, table

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


def pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _list(names) -> str:
    return "[" + ",".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("k", c("c_custkey").cast("long"))


@query("det_07_cleaned_entities", "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS value FROM customer")
def _clean(spark, sf_dir):
    raw = F.concat(F.lit("ª. "), F.substring("c_name", 1, 4), F.lit("##"), F.substring("c_name", 5, 100), F.lit(" B\nrest"))
    return customers(spark, sf_dir).select(c("k").alias("id"), project.cleaned_entity(raw).alias("value"))


@query("det_08_entity_filters", "SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey % 3 = 0 AS kept FROM customer")
def _kept(spark, sf_dir):
    body = F.when(c("k") % 3 == 2, "El Tribunal Supremo").otherwise(c("c_name"))
    line = F.concat(F.lit("ante "), body, F.when(c("k") % 3 == 1, "x").otherwise("."))
    return customers(spark, sf_dir).select(c("k").alias("id"), project.entity_kept(line, F.lit(5), F.lit(5) + F.length(body), body).alias("kept"))


@query("flt_09_applied_verdicts", f"{D} SELECT id, CASE WHEN id % 4 = 1 THEN 'MISC' ELSE category END AS category, CASE WHEN id % 4 = 2 THEN least(confidence, 0.7::DOUBLE) ELSE confidence END AS confidence FROM det WHERE id % 4 <> 0")
def _verdicts(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("verdict", pick(("REJECT", "RECLASSIFY", "FLAG", "KEEP"), c("id"))).withColumn("new_category", F.lit("MISC"))
    return project.validated(d).select("id", "category", "confidence")


@query("flt_11_actionable", f"{D} SELECT count(*) FILTER (confidence >= 0.7 OR id % 2 = 0) AS actionable, count(*) FILTER (confidence < 0.7 AND id % 2 = 1) AS queue FROM det")
def _actionable(spark, sf_dir):
    needs, reviewed = c("confidence") < 0.7, c("id") % 2 == 0
    return detections(spark, sf_dir).agg(F.count_if(~needs | reviewed).alias("actionable"), F.count_if(needs & ~reviewed).alias("queue"))


@query("flt_12_pending_documents", "SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders WHERE o_orderstatus IN ('P', 'F')")
def _pending(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(c("o_orderstatus").isin("P", "F")).select(c("o_orderkey").cast("long").alias("id"))


@query("flt_13_levels", f"{D} SELECT 'BASIC' AS level, count(*) AS n FROM det WHERE category IN ('PERSON_NAME','DNI_NIE','PHONE','EMAIL','ADDRESS') UNION ALL SELECT 'INTERMEDIATE', count(*) FROM det UNION ALL SELECT 'ADVANCED', count(*) FROM det")
def _levels(spark, sf_dir):
    d = detections(spark, sf_dir)
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), project.in_level(c("category"), k).alias("in")) for k in project.LEVEL_CATEGORIES])).alias("x")
    return d.select(levels).filter("x.in").groupBy("x.level").agg(F.count(F.lit(1)).alias("n"))


@query("prj_07_refined_boundaries", "SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN '12345678Z' ELSE '28001' END AS value FROM customer")
def _refined(spark, sf_dir):
    k = c("k") % 4
    value = F.when(k == 0, F.concat(F.lit("Don "), "c_name")).when(k == 1, F.concat("c_name", F.lit(", "))).when(k == 2, "12345678").otherwise("2800")
    return customers(spark, sf_dir).select(c("k").alias("id"), project.refined(value, pick(("PERSON_NAME", "ORGANIZATION", "DNI_NIE", "POSTAL_CODE"), k), F.when(k == 2, "-Z, ").otherwise("1 Madrid")).alias("value"))


@query("prj_08_restored_spans", f"{D} SELECT id, CAST(s * 2 AS INT) AS \"start\", CAST((e - 1) * 2 + 1 AS INT) AS \"end\" FROM det")
def _restored(spark, sf_dir):
    mapping = F.transform(F.sequence(F.lit(0), F.lit(80)), lambda i: i * 2)
    s, e = spans.restored(c("start"), c("end"), mapping)
    return detections(spark, sf_dir).select("id", s.cast("int").alias("start"), e.cast("int").alias("end"))


@query("prj_09_alias_or_placeholder", f"{D}, r AS (SELECT DISTINCT value FROM det WHERE id % 5 = 0) SELECT id, CASE WHEN r.value IS NULL THEN '[' || category || ']' ELSE 'A_' || d.value END AS shown FROM det d LEFT JOIN r USING (value)")
def _shown(spark, sf_dir):
    d = detections(spark, sf_dir)
    known = d.filter("id % 5 = 0").select("value").distinct().withColumn("alias", F.concat(F.lit("A_"), "value"))
    return d.join(known, "value", "left").select("id", F.coalesce("alias", F.format_string("[%s]", c("category"))).alias("shown"))


@query("join_05_lookup_by_key", f"{D}, g AS (SELECT category || ':' || value AS key, count(*) AS n FROM det GROUP BY 1) SELECT id, n FROM det d JOIN g ON g.key = d.category || ':' || d.value")
def _lookup(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("key", text.lookup_key(c("value"), c("category")))
    return d.join(d.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select("id", "n")


@query("join_09_shared_across_categories", KEPT + ", x AS (SELECT project_id, category, norm_key, alias, f FROM gloss) SELECT project_id, category, norm_key, first_value(alias) OVER (PARTITION BY project_id, norm_key ORDER BY f[1], category) AS shared_alias FROM x")
def _shared(spark, sf_dir):
    return project.resolved_aliases(glossary.build(found(spark, sf_dir))).select("project_id", "category", "norm_key", "shared_alias")


@query("join_11_token_labels", "WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(j * 5 AS INT) AS s FROM customer, (SELECT unnest(range(0, 8)) AS j)) SELECT doc_id, s AS \"start\", CASE WHEN s = 10 THEN 'B-PERSON' WHEN s = 15 THEN 'I-PERSON' ELSE 'O' END AS label FROM t")
def _labels(spark, sf_dir):
    cust = customers(spark, sf_dir)
    tokens = cust.select(c("k").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).select("doc_id", (c("j") * 5).alias("start"), (c("j") * 5 + 4).alias("end"))
    return project.token_labels(tokens, cust.select(c("k").alias("doc_id"), F.lit(11).alias("start"), F.lit(18).alias("end"), F.lit("PERSON").alias("type")))


@query("agg_06_aliases_used", f"{D} SELECT category || ':' || lower(value) AS key, count(*) AS n FROM det GROUP BY 1")
def _used(spark, sf_dir):
    return detections(spark, sf_dir).groupBy(F.concat_ws(":", "category", F.lower("value")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


_STATE = "CASE WHEN o_custkey % 50 = 0 OR o_orderkey % 7 = 0 THEN 'FAILED' WHEN o_custkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'DETECTED' ELSE 'ANONYMIZED' END"


@query("agg_10_batch_progress", f"WITH s AS (SELECT CAST(o_custkey AS BIGINT) AS batch_id, count(*) AS total, count(*) FILTER ({_STATE} = 'ANONYMIZED') AS processed, count(*) FILTER ({_STATE} = 'FAILED') AS failed FROM orders GROUP BY 1) SELECT *, round(100.0::DOUBLE * (processed + failed) / total, 4) AS percent, CASE WHEN processed + failed < total THEN 'RUNNING' WHEN failed = total THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM s")
def _batch(spark, sf_dir):
    return project.batch_progress(table(spark, sf_dir, "orders").select(c("o_custkey").cast("long").alias("batch_id"), F.expr(_STATE).alias("state")))


@query("agg_14_lenient_match", "SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey % 3 <> 2 AS hit FROM customer")
def _lenient(spark, sf_dir):
    made = F.when(c("k") % 3 == 0, F.substring("c_name", 3, 8)).when(c("k") % 3 == 1, F.concat(F.lit("X"), F.substring("c_name", 2, 100))).otherwise(F.lit("unlike"))
    return customers(spark, sf_dir).select(c("k").alias("id"), project.lenient_match(c("c_name"), made).alias("hit"))


@query("agg_15_repeated_starts", "SELECT substr(text, 1, 30) AS head, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 3")
def _starts(spark, sf_dir):
    return project.repeated_starts(table(spark, sf_dir, "documents"), more_than=3)


@query("agg_19_distinct_names", "SELECT count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_name) AS names FROM customer")
def _distinct(spark, sf_dir):
    return customers(spark, sf_dir).agg(F.count_distinct("c_mktsegment").alias("segments"), F.count_distinct("c_name").alias("names"))


@query("agg_20_word_confidence", "SELECT CAST(l_orderkey AS BIGINT) AS page, round(avg(CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey % 100 END), 6) AS confidence FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_suppkey % 9 <> 0) > 0")
def _ocr(spark, sf_dir):
    conf = F.when(c("l_suppkey") % 9 == 0, -1).otherwise(c("l_suppkey") % 100)
    return table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").cast("long").alias("page")).agg(F.round(F.avg(F.when(conf != -1, conf)), 6).alias("confidence")).filter("confidence IS NOT NULL")


@query("win_08_versions", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS INT) AS version FROM events")
def _versions(spark, sf_dir):
    return project.versions(table(spark, sf_dir, "events"), ["user_id"]).select("event_id", "version")


@query("top_01_sorted_spans", f"{D} SELECT doc_id, string_agg(s || '-' || e, ',' ORDER BY s, e) AS spans FROM det GROUP BY doc_id")
def _sorted(spark, sf_dir):
    s = F.array_sort(F.collect_list(F.struct("start", "end")))
    return detections(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(s, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))


@query("top_03_first_per_document", f"{D} SELECT doc_id, id FROM det QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s, id) <= 2")
def _first(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("start", "id")
    return detections(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n <= 2").select("doc_id", "id")


@query("top_05_arg_max_category", f"{D} SELECT doc_id, arg_max(category, (confidence, id)) AS category FROM det GROUP BY doc_id")
def _argmax(spark, sf_dir):
    return detections(spark, sf_dir).groupBy("doc_id").agg(F.max_by("category", F.struct("confidence", "id")).alias("category"))


@query("set_02_union_distinct", "SELECT name FROM (SELECT c_mktsegment AS name FROM customer UNION SELECT o_orderpriority FROM orders)")
def _names(spark, sf_dir):
    return customers(spark, sf_dir).select(c("c_mktsegment").alias("name")).union(table(spark, sf_dir, "orders").select("o_orderpriority")).distinct()


@query("set_04_missed_and_spurious", f"{D}, a AS (SELECT DISTINCT doc_id, s FROM det WHERE source = 'regex'), b AS (SELECT DISTINCT doc_id, s FROM det WHERE source = 'roberta') SELECT 'missed' AS kind, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'spurious', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def _missed(spark, sf_dir):
    d = detections(spark, sf_dir)
    a, b = (d.filter(c("source") == s).select("doc_id", "start").distinct() for s in ("regex", "roberta"))
    n = F.count(F.lit(1)).alias("n")
    return a.exceptAll(b).agg(n).select(F.lit("missed").alias("kind"), "n").unionByName(b.exceptAll(a).agg(n).select(F.lit("spurious").alias("kind"), "n"))


@query("set_05_requested_ids", "SELECT CASE WHEN o.o_orderkey IS NULL THEN 'not_found' WHEN o.o_orderstatus = 'O' THEN 'started' ELSE 'skipped' END AS outcome, count(*) AS n FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT -c_custkey FROM customer) r LEFT JOIN orders o ON o.o_orderkey = r.id GROUP BY 1")
def _requested(spark, sf_dir):
    """All orders are asked for, and as many absent ids as there are customers."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").cast("long").alias("id"), "o_orderstatus")
    r = o.select("id").unionByName(customers(spark, sf_dir).select((-c("k")).alias("id"))).join(o, "id", "left")
    return r.groupBy(F.when(c("o_orderstatus").isNull(), "not_found").when(c("o_orderstatus") == "O", "started").otherwise("skipped").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


NAMES = ("Doña Ana López", "Juan Pérez", "Sra. Pérez", "D. Luis", "María Sol")


@query("str_22_gender", f"SELECT CAST(c_custkey AS BIGINT) AS id, ['F','M','F','M','F'][CAST(c_custkey % 5 + 1 AS INT)] AS gender FROM customer")
def _gender(spark, sf_dir):
    return customers(spark, sf_dir).select(c("k").alias("id"), project.gender(pick(NAMES, c("k"))).alias("gender"))


@query("str_23_sector", "SELECT CAST(c_custkey AS BIGINT) AS id, ['BANK','INSURANCE','LEGAL','OTHER'][CAST(c_custkey % 4 + 1 AS INT)] AS sector FROM customer")
def _sector(spark, sf_dir):
    return customers(spark, sf_dir).select(c("k").alias("id"), project.sector(pick(("Banco Uno", "Dos Seguros", "Bufete Tres", "Cuatro"), c("k"))).alias("sector"))


@query("str_24_token_sort", "SELECT CAST(c_custkey AS BIGINT) AS id, array_to_string(list_sort(string_split(lower(c_mktsegment || ' Beta ' || c_name), ' ')), ' ') AS key FROM customer")
def _token_sort(spark, sf_dir):
    return customers(spark, sf_dir).select(c("k").alias("id"), project.token_sorted(F.concat("c_mktsegment", F.lit(" Beta "), "c_name")).alias("key"))


@query("str_28_number_words", f"SELECT CAST(c_custkey AS BIGINT) AS id, {_list(project.NUMBER_WORDS)}[CAST(c_custkey % 32 + 1 AS INT)] AS words FROM customer")
def _words(spark, sf_dir):
    return customers(spark, sf_dir).select(c("k").alias("id"), project.in_words(c("k") % 32).alias("words"))


@query("mth_02_cosine", "WITH a AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT i, x FROM a WHERE vec_id = 0) SELECT a.vec_id, round(sum(a.x * q.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(q.x * q.x)), 6) AS cosine FROM a JOIN q USING (i) GROUP BY a.vec_id")
def _cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("v"))
    one = F.broadcast(e.filter("vec_id = 0").limit(1).select(c("v").alias("q"), F.lit(1).alias("j")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.withColumn("j", F.lit(1)).join(one, "j").select("vec_id", F.round(dot(c("v"), c("q")) / F.sqrt(dot(c("v"), c("v"))) / F.sqrt(dot(c("q"), c("q"))), 6).alias("cosine"))


@query("ano_13_latest_review", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _review(spark, sf_dir):
    from spanveil.sources.documents import latest

    return latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [c("ts"), c("event_id")]).select("user_id", "event_id", "event_type")


@query("evl_05_dataset_profile", f"SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 20")
def _profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "lang").limit(20)


@query("ui_01_glossary_search", f"{D} SELECT value, count(*) AS n FROM det WHERE contains(lower(value), '7') GROUP BY value")
def _search(spark, sf_dir):
    return detections(spark, sf_dir).filter(F.lower("value").contains("7")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("ui_04_diff_segments", KEPT + ", l AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM kept), x AS (SELECT doc_id, s, e, true AS is_entity FROM l UNION ALL SELECT doc_id, b, s, false FROM l UNION ALL SELECT doc_id, max(e), any_value(length(text)), false FROM kept JOIN docs USING (doc_id) GROUP BY doc_id) SELECT doc_id, is_entity, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS chars FROM x WHERE e > s GROUP BY ALL")
def _diff(spark, sf_dir):
    from spanveil.plans.detections import documents

    return project.segments(found(spark, sf_dir), documents(spark, sf_dir)).groupBy("doc_id", "is_entity").agg(F.count(F.lit(1)).alias("n"), F.sum(c("end") - c("start")).alias("chars"))


@query("ops_01_exportable", "SELECT doc_id FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)")
def _exportable(spark, sf_dir):
    """Documents with text that no reviewer refused (quality 0)."""
    refused = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").filter(F.length("text") > 0).join(refused, "doc_id", "left_anti").select("doc_id")


@query("snk_03_mapping_round_trip", f"{D} SELECT substr(category, 1, 3) AS prefix, max(id % 13) AS last FROM det GROUP BY 1")
def _mapping(spark, sf_dir):
    from spanveil.sources import shared

    path = shared.fresh(spark, "mapping")
    detections(spark, sf_dir).select(F.concat(F.substring("category", 1, 3), F.lit("_"), (c("id") % 13).cast("string")).alias("alias")).distinct().write.json(path)
    return glossary.next_numbers(spark.read.schema("alias string").json(path))


@query("src_10_atomic_write", "SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders WHERE o_orderstatus = 'O'")
def _atomic(spark, sf_dir):
    from spanveil.sources import shared

    return shared.written(table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(c("o_orderkey").cast("long").alias("id")), "unit-of-work")


@query("evl_04_token_scores", "WITH t AS (SELECT l_partkey % 4 AS g, l_suppkey % 4 AS p FROM lineitem) SELECT round(count(*) FILTER (g = p AND g <> 0) / count(*) FILTER (p <> 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (g = p AND g <> 0) / count(*) FILTER (g <> 0)::DOUBLE, 6) AS recall, round(count(*) FILTER (g = p) / count(*)::DOUBLE, 6) AS accuracy FROM t")
def _token_scores(spark, sf_dir):
    g, p = c("l_partkey") % 4, c("l_suppkey") % 4
    n = lambda x: F.count_if(x)
    return table(spark, sf_dir, "lineitem").agg(F.round(n((g == p) & (g != 0)) / n(p != 0), 6).alias("precision"), F.round(n((g == p) & (g != 0)) / n(g != 0), 6).alias("recall"), F.round(n(g == p) / F.count(F.lit(1)), 6).alias("accuracy"))


@query("stm_05_state_history", "SELECT user_id, count(*) AS changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> event_type GROUP BY user_id")
def _changes(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w)).filter("before IS NOT NULL AND before <> event_type").groupBy("user_id").agg(F.count(F.lit(1)).alias("changes"))




@query("str_01_nfkc", "SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents")
def _nfkc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.unicode_form(F.translate("text", "aeo", "ａｅｏ")), 256).alias("digest"))


@query("str_08_joined_letters", "SELECT CAST(c_custkey AS BIGINT) AS id, 'Nota: h' || c_mktsegment[1] || 'la, y fin.' AS text FROM customer")
def _joined(spark, sf_dir):
    return customers(spark, sf_dir).select(c("k").alias("id"), text.joined_letters(F.concat(F.lit("Nota: h "), F.substring("c_mktsegment", 1, 1), F.lit(" l a, y fin."))).alias("text"))


@query("str_12_offset_map", "SELECT doc_id, CAST(0 AS BIGINT) AS wrong, CAST(length(regexp_replace(replace(text, 'a', 'a  '), ' +', ' ', 'g')) AS BIGINT) AS chars FROM documents")
def _map(spark, sf_dir):
    """Whole texts: every character of the normalised one against that of the source at its place."""
    source = F.replace("text", F.lit("a"), F.lit("​а  "))
    rows = table(spark, sf_dir, "documents").select("doc_id", source.alias("source")).select("doc_id", "source", text.mapped(c("source")).alias("m"))
    rows = rows.select("doc_id", F.split(F.translate("source", text.CYRILLIC, text.LATIN), "").alias("source"), F.split("m.text", "").alias("chars"), c("m.char_map").alias("places"), F.length("m.text").alias("n"))
    # The array of one binds the split source, which is otherwise split again for each character.
    wrong = F.transform(F.array("source"), lambda every: F.filter("chars", lambda ch, i: ch != F.get(every, F.get("places", i))))[0]
    return rows.select("doc_id", F.size(wrong).cast("long").alias("wrong"), c("n").cast("long").alias("chars"))


@query("det_09_keep_first")
def _keep_first(spark, sf_dir):
    s = F.array_sort(F.collect_list(F.struct("start", (-c("confidence")).alias("c"), "end", "id")))
    return detections(spark, sf_dir).groupBy("doc_id").agg(s.alias("s")).select("doc_id", F.explode(spans.left_to_right(c("s"))).alias("x")).select("doc_id", "x.id")


@query("det_14_legal_titles", "SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'Juan García' AS value, CAST(3 + length(c_mktsegment) AS INT) AS \"start\" FROM customer")
def _titles(spark, sf_dir):
    from spanveil.operators.detect import regex_detector
    from spanveil.operators.patterns import Pattern

    titles = (Pattern(0, "PERSON_NAME", r"([A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]+(?:[^\S\n]+[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]+)+)(?=,\s+(?:letrad[oa]|magistrad[oa]|procurador|procuradora|fiscal|notari[oa])\b)", 0.92, None, True),)
    docs = customers(spark, sf_dir).select(c("k").alias("doc_id"), F.concat(F.lower("c_mktsegment"), F.lit(" y Juan García, letrado, vino.")).alias("text"))
    return regex_detector(docs, patterns=titles).select("doc_id", "value", "start")


@query("ano_05_folded_aliases", "WITH k AS (SELECT CAST(c_nationkey AS BIGINT) AS project_id, 'ana ' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' lopez' ELSE '' END AS norm_key, min(CAST(c_custkey AS BIGINT)) AS first_doc_seq FROM customer GROUP BY 1, 2), m AS (SELECT a.project_id, a.norm_key, min((b.first_doc_seq, b.norm_key)) AS m FROM k a JOIN k b ON a.project_id = b.project_id AND a.norm_key <> b.norm_key AND (starts_with(b.norm_key, a.norm_key || ' ') OR starts_with(a.norm_key, b.norm_key || ' ')) GROUP BY 1, 2) SELECT k.project_id, k.norm_key, CASE WHEN m.m < (first_doc_seq, k.norm_key) THEN m.m[2] ELSE k.norm_key END AS alias_key FROM k LEFT JOIN m USING (project_id, norm_key)")
def _folded(spark, sf_dir):
    k = customers(spark, sf_dir).groupBy(c("c_nationkey").cast("long").alias("project_id"), F.concat(F.lit("ana "), F.lower("c_mktsegment"), F.when(c("k") % 2 == 0, " lopez").otherwise("")).alias("norm_key")).agg(F.min("k").alias("first_doc_seq"))
    return glossary.folded(k, least=99.0)


@query("ano_11_corrected_originals", KEPT + ", ch AS (SELECT project_id, category, norm_key, CASE WHEN length(norm_key) % 2 = 0 THEN norm_key || 'x' ELSE norm_key END AS new_key FROM gloss), n AS (SELECT project_id, category, max(CAST(regexp_extract(alias, '_([0-9]+)$', 1) AS BIGINT)) AS last FROM gloss GROUP BY 1, 2) SELECT project_id, category, norm_key, new_key, regexp_extract(any_value(a.alias), '^(.*)_', 1) || '_' || lpad(CAST(any_value(last) + row_number() OVER (PARTITION BY project_id, category ORDER BY new_key) AS VARCHAR), 3, '0') AS alias FROM ch JOIN n USING (project_id, category) JOIN gloss a USING (project_id, category, norm_key) WHERE new_key <> norm_key GROUP BY project_id, category, norm_key, new_key")
def _corrected(spark, sf_dir):
    g = glossary.build(found(spark, sf_dir))
    changes = g.select("project_id", "category", "norm_key", F.when(F.length("norm_key") % 2 == 0, F.concat("norm_key", F.lit("x"))).otherwise(c("norm_key")).alias("new_key"))
    return glossary.corrected(g, changes)


@query("jsn_03_progress_messages", "SELECT doc_id, '{\"type\":\"progress\",\"document\":' || doc_id || ',\"percent\":' || (doc_id % 101) || '}' AS message FROM documents")
def _messages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.lit("progress").alias("type"), c("doc_id").alias("document"), (c("doc_id") % 101).alias("percent"))).alias("message"))


@query("mth_04_scaled_progress", "SELECT doc_id, CAST(floor(20 + (doc_id % 101) * 0.6) AS INT) AS percent FROM documents")
def _scaled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (20 + (c("doc_id") % 101) * 0.6).cast("int").alias("percent"))


@query("gen_02_corpus", "SELECT CAST(5000 AS BIGINT) AS n, CAST(0 AS BIGINT) AS wrong")
def _corpus(spark, sf_dir):
    """Sentences with known spans from a counter: the spans stand where they say."""
    i = c("id")
    person, place = pick(("Ana Ruiz", "Luis Gil", "Eva Sanz"), F.xxhash64(i, F.lit(1)) % 3 + 3), pick(("Lugo", "Soria", "Teruel"), F.xxhash64(i, F.lit(2)) % 3 + 3)
    rows = spark.range(5000).select("id", person.alias("person"), place.alias("place")).withColumn("text", F.concat(F.lit("Doña "), "person", F.lit(" vive en "), "place", F.lit("."))).withColumn("s2", F.lit(5) + F.length("person") + 9)
    wrong = (F.substring("text", F.lit(6), F.length("person")) != c("person")) | (F.substring("text", c("s2") + 1, F.length("place")) != c("place"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"))


@query("snk_01_text_export", "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT replace(text, chr(10), ' ') AS text FROM documents)")
def _text(spark, sf_dir):
    from spanveil.sources import shared

    path = shared.fresh(spark, "text-export")
    table(spark, sf_dir, "documents").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")).write.text(path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


@query("src_05_files_by_kind", "SELECT 'txt' AS ext, CAST(25 AS BIGINT) AS n, CAST(0 AS BIGINT) AS errors")
def _files(spark, sf_dir):
    from spanveil.sources import documents as files
    from spanveil.sources import shared

    path = shared.fresh(spark, "files")
    table(spark, sf_dir, "nation").select(c("n_name").alias("value"), F.col("n_nationkey")).repartition(25, "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return files.read_documents(spark, path).groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("error").isNotNull()).alias("errors"))


@query("stm_02_published_events", "SELECT 'counts' AS handler, count(DISTINCT event_type) AS n FROM events UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events")
def _published(spark, sf_dir):
    from spanveil.sources import shared
    from spanveil.streaming import flows

    def broken(batch: DataFrame) -> DataFrame:
        raise ValueError("handler fails")

    path = shared.fresh(spark, "published")
    flows.published(flows.arriving(spark, sf_dir, "events"), {"counts": lambda b: b.groupBy("event_type").count(), "broken": broken, "users": lambda b: b.select("user_id").distinct()}, path)
    n = lambda name, col: spark.read.parquet(f"{path}/{name}").agg(F.count_distinct(col).alias("n")).select(F.lit(name).alias("handler"), "n")
    return n("counts", "event_type").unionByName(n("users", "user_id"))


@query("evl_03_match_keys", "SELECT CAST(c_custkey AS BIGINT) AS id, lower(c_name) AS key FROM customer")
def _keys(spark, sf_dir):
    return customers(spark, sf_dir).select(c("k").alias("id"), text.match_key(F.concat(F.lit(" ​"), F.translate("c_name", "Cs", "Сs"), F.lit("­ "))).alias("key"))


@query("ui_03_zone_counts", f"{D} SELECT count(*) FILTER (confidence < 0.4) AS red, count(*) FILTER (confidence >= 0.4 AND confidence < 0.85) AS amber, count(*) FILTER (confidence >= 0.85) AS green FROM det")
def _zones(spark, sf_dir):
    from spanveil.operators.merge import zone

    z = zone(c("confidence"), c("category"), F.lit(True))
    return detections(spark, sf_dir).agg(F.count_if(z == "RED").alias("red"), F.count_if(z == "AMBER").alias("amber"), F.count_if(z == "GREEN").alias("green"))
