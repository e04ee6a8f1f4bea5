"""Queries over detections: extraction from documents, filters, joins and votes, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.functions import spans, text
from spanveil.operators import detect, merge
from spanveil.operators.patterns import PATTERNS

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, project_id, doc_seq and text after the first phase without Unicode forms."""
    d = table(spark, sf_dir, "documents")
    return d.select(c("doc_id").cast("long"), c("source").alias("project_id"), c("doc_id").cast("long").alias("doc_seq"), text.ingest(c("text"), None).alias("text"))


SIMPLE = tuple(p for p in PATTERNS if p.category in ("EMAIL", "IP_ADDRESS", "CREDIT_CARD"))
INGEST_SQL = "regexp_replace(replace(replace(translate(text, chr(160) || chr(8199) || chr(8239) || chr(8288), '    '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"


def found_sql(patterns, docs: str = "docs") -> str:
    """CTE body: whole matches with offsets, by marks as in the extractor."""
    one = "SELECT doc_id, {n} AS pattern_no, '{cat}' AS category, {conf} AS confidence, string_split(regexp_replace(text, '{re}', chr(1) || '\\0' || chr(2), 'gi'), chr(1)) AS parts FROM {docs}"
    union = " UNION ALL ".join(one.format(n=p.number, cat=p.category, conf=p.confidence, re=p.regex, docs=docs) for p in patterns)
    return f"""
parts AS ({union}),
pieces AS (SELECT doc_id, pattern_no, category, confidence, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM parts WHERE len(parts) > 1),
placed AS (SELECT *, sum(CASE WHEN i = 1 THEN length(part) ELSE length(part) - 1 END) OVER (PARTITION BY doc_id, pattern_no ORDER BY i) - (length(part) - 1) AS pos FROM pieces),
found0 AS (SELECT doc_id, pattern_no, category, CAST(pos AS INT) AS s, CAST(pos + strpos(part, chr(2)) - 1 AS INT) AS e, substr(part, 1, strpos(part, chr(2)) - 1) AS value, CAST(confidence AS DOUBLE) AS confidence FROM placed WHERE i > 1),
found AS (SELECT * FROM found0 QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY pattern_no) = 1)"""


DOCS_SQL = f"docs AS (SELECT doc_id, source AS project_id, {INGEST_SQL} AS text FROM documents)"
FOUND = f"WITH {DOCS_SQL}, {found_sql(SIMPLE)}"


@query("det_01_native_patterns", FOUND + ' SELECT doc_id, pattern_no, category, value, s AS "start", e AS "end", confidence, \'regex\' AS source FROM found')
def _native(spark, sf_dir):
    return detect.native_detector(documents(spark, sf_dir), SIMPLE)


@query("det_02_arrow_same_patterns", FOUND + ' SELECT doc_id, pattern_no, category, value, s AS "start", e AS "end", confidence, \'regex\' AS source FROM found')
def _arrow(spark, sf_dir):
    return detect.regex_detector(documents(spark, sf_dir), categories=["EMAIL", "IP_ADDRESS", "CREDIT_CARD"], patterns=PATTERNS)


@query("det_01_all_patterns")
def _all(spark, sf_dir):
    return detect.regex_detector(documents(spark, sf_dir))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per customer with identifiers whose places are known."""
    from spanveil.plans.scalars import people

    return people(spark, sf_dir).select(c("id").alias("doc_id"), F.concat(F.lit("El recurrente, don Juan García, con DNI "), c("dni"), F.lit(" y cuenta "), c("iban"), F.lit(", compareció el 03/05/2021.")).alias("text"), "dni", "iban")


@query(
    "det_03_validated_identifiers",
    None,
)
def _validated(spark, sf_dir):
    return detect.regex_detector(letters(spark, sf_dir), categories=["DNI_NIE", "IBAN", "PERSON_NAME", "DATE"])


def _letters_sql() -> str:
    from spanveil.plans.scalars import _DNI, _IBAN, PEOPLE_SQL

    number = lambda k: next(p.number for p in PATTERNS if p.category == k)
    rows = [("PERSON_NAME", 4, "'Juan García'", 19, "0.98", "regex"), ("DNI_NIE", number("DNI_NIE"), "dni", 40, f"CASE WHEN {_DNI} THEN 1.0 ELSE 0.95::DOUBLE * 0.7::DOUBLE END", ""), ("IBAN", number("IBAN"), "iban", 59, f"CASE WHEN {_IBAN} THEN 1.0 ELSE 0.95::DOUBLE * 0.7::DOUBLE END", ""), ("DATE", number("DATE"), "'03/05/2021'", 99, "0.75", "")]
    return f"WITH {PEOPLE_SQL} " + " UNION ALL ".join(f"SELECT id AS doc_id, CAST({n} AS INT) AS pattern_no, '{k}' AS category, {v} AS value, CAST({s} AS INT) AS \"start\", CAST({s} + length({v}) AS INT) AS \"end\", CAST({conf} AS DOUBLE) AS confidence, 'regex' AS source FROM people" for k, n, v, s, conf, _ in rows)


ORACLE_SQL["det_03_validated_identifiers"] = _letters_sql()


@query("det_06_chunks", "SELECT doc_id, CAST(i AS INT) AS chunk_no, CAST(i * 1300 AS INT) AS \"offset\", sha256(substr(text, i * 1300 + 1, 1500)) AS digest FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 200) / 1300.0), 1) AS BIGINT))) AS i FROM documents)")
def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(detect.chunks(c("text"))).alias("x")).select("doc_id", "x.chunk_no", c("x.offset").cast("int").alias("offset"), F.sha2("x.chunk", 256).alias("digest"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled tokens from order lines: a sentence per order."""
    k = c("l_partkey") % 5
    label = F.when(k == 0, "B-PERSON").when(k == 1, "I-PERSON").when(k == 2, "B-DATE").otherwise("O")
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").cast("long").alias("sent_id"), (c("l_linenumber") * 100_000 + c("l_partkey")).cast("int").alias("tok_no"), label.alias("label"), (c("l_linenumber") * 10).cast("int").alias("start"), (c("l_linenumber") * 10 + 7).cast("int").alias("end"), ((c("l_suppkey") % 10) / 10).alias("confidence"))


TOKENS_SQL = """tokens AS (SELECT CAST(l_orderkey AS BIGINT) AS sent_id, CAST(l_linenumber * 100000 + l_partkey AS INT) AS tok_no, CASE l_partkey % 5 WHEN 0 THEN 'B-PERSON' WHEN 1 THEN 'I-PERSON' WHEN 2 THEN 'B-DATE' ELSE 'O' END AS label,
  CAST(l_linenumber * 10 AS INT) AS s, CAST(l_linenumber * 10 + 7 AS INT) AS e, (l_suppkey % 10) / 10.0::DOUBLE AS confidence FROM lineitem),
kinds AS (SELECT *, CASE WHEN label <> 'O' THEN substr(label, 3) END AS kind FROM tokens),
marks AS (SELECT *, CASE WHEN label LIKE 'B-%' OR (kind IS NOT NULL AND kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY sent_id ORDER BY tok_no)) THEN 1 ELSE 0 END AS b FROM kinds),
islands AS (SELECT *, sum(b) OVER (PARTITION BY sent_id ORDER BY tok_no) AS island FROM marks)"""


@query("det_17_bio_entities", f"WITH {TOKENS_SQL} SELECT sent_id, kind AS entity, min(s) AS \"start\", max(e) AS \"end\", count(*) AS n_tokens, round(avg(confidence), 6) AS confidence FROM islands WHERE kind IS NOT NULL GROUP BY sent_id, island, kind")
def _bio(spark, sf_dir):
    return detect.bio_entities(tokens(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("win_07_bio_legality", f"WITH {TOKENS_SQL} SELECT sent_id, tok_no, label FROM (SELECT *, lag(kind) OVER (PARTITION BY sent_id ORDER BY tok_no) AS before FROM kinds) WHERE label LIKE 'I-%' AND before IS DISTINCT FROM kind")
def _legal(spark, sf_dir):
    w = Window.partitionBy("sent_id").orderBy("tok_no")
    kind = F.when(c("label") != "O", F.substring("label", 3, 100))
    return tokens(spark, sf_dir).withColumn("before", F.lag(kind).over(w)).filter(c("label").startswith("I-") & ~c("before").eqNullSafe(kind)).select("sent_id", "tok_no", "label")


@query("det_13_json_and_repair", "SELECT doc_id, 0 AS \"start\", CAST(length(text) AS INT) AS \"end\" FROM documents WHERE text IS NOT NULL")
def _json(spark, sf_dir):
    """A model's answer that quotes the whole text of each document, with wrong offsets."""
    answer = F.concat(F.lit("Here you are:\n["), F.to_json(F.struct(c("text"), F.lit("MISC").alias("category"), F.lit(3).alias("start"), F.lit(9).alias("end"))), F.lit("] done"))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.explode(detect.json_entities(answer)).alias("x"))
    return rows.select("doc_id", detect.repaired(c("text"), c("x.text"), c("x.start"), c("x.end")).alias("r")).select("doc_id", c("r.start").cast("int").alias("start"), c("r.end").cast("int").alias("end"))


# Detections from order lines: a document per order.
CATEGORIES = ("PERSON_NAME", "ORGANIZATION", "LOCATION", "DATE", "DNI_NIE", "PHONE", "ADDRESS", "EMAIL")
SOURCES = ("regex", "roberta", "spacy", "presidio")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c("l_partkey") * 7 % 60
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        (((c("l_orderkey").cast("long") * 10 + c("l_linenumber")) * 100_000 + c("l_partkey")) * 1000 + c("l_suppkey")).alias("id"), c("l_orderkey").cast("long").alias("doc_id"), s.cast("int").alias("start"), (s + c("l_suppkey") % 15 + 1).cast("int").alias("end"),
        pick(CATEGORIES, c("l_partkey")).alias("category"), ((c("l_orderkey") * 31 + c("l_linenumber") * 17) % 70 / 100 + 0.3).cast("decimal(6,2)").cast("double").alias("confidence"), pick(SOURCES, c("l_suppkey")).alias("source"),
        F.concat(F.lit("v"), (c("l_partkey") % 97).cast("string")).alias("value"),
    )


def _list(names) -> str:
    return "[" + ",".join(f"'{n}'" for n in names) + "]"


DET_SQL = f"""det AS (SELECT ((CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS id, CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_partkey * 7 % 60 AS INT) AS s, CAST(l_partkey * 7 % 60 + l_suppkey % 15 + 1 AS INT) AS e,
  {_list(CATEGORIES)}[CAST(l_partkey % 8 + 1 AS INT)] AS category, CAST(CAST((l_orderkey * 31 + l_linenumber * 17) % 70 / 100.0 + 0.3 AS DECIMAL(6,2)) AS DOUBLE) AS confidence, {_list(SOURCES)}[CAST(l_suppkey % 4 + 1 AS INT)] AS source, 'v' || (l_partkey % 97) AS value FROM lineitem)"""
D = f"WITH {DET_SQL}"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(c("o_orderkey").cast("long").alias("doc_id"), (c("o_custkey") % 50).cast("int").alias("start"), (c("o_custkey") % 50 + 8).cast("int").alias("end"))


ZONES_SQL = "zones AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CAST(o_custkey % 50 AS INT) AS s, CAST(o_custkey % 50 + 8 AS INT) AS e FROM orders)"


@query("flt_04_outside_zones", f"{D}, {ZONES_SQL} SELECT id FROM det d WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.doc_id = d.doc_id AND d.s < z.e AND z.s < d.e)")
def _outside(spark, sf_dir):
    return merge.outside_zones(detections(spark, sf_dir), zones(spark, sf_dir)).select("id")


@query("flt_05_not_inside_zones", f"{D}, {ZONES_SQL} SELECT id FROM det d WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.doc_id = d.doc_id AND d.s >= z.s AND d.e <= z.e)")
def _inside(spark, sf_dir):
    return merge.outside_zones(detections(spark, sf_dir), zones(spark, sf_dir), contained=True).select("id")


@query("flt_04_zones_of_pages", None)
def _zones_of(spark, sf_dir):
    return merge.zones_of(table(spark, sf_dir, "pages").select(c("page_id").alias("doc_id"), F.concat(c("url"), F.lit(" ISSN 1234-567X")).alias("text"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(c("end") - c("start")).alias("chars"))


ORACLE_SQL["flt_04_zones_of_pages"] = "SELECT 'issn' AS kind, count(*) AS n, CAST(14 * count(*) AS BIGINT) AS chars FROM pages UNION ALL SELECT 'url', count(*), CAST(sum(length(url)) AS BIGINT) FROM pages"
_COMPAT = "(d.category = k.category OR (d.category IN ('LOCATION','ADDRESS') AND k.category IN ('LOCATION','ADDRESS')))"


@query("flt_06_not_nested", f"{D} SELECT id FROM det d WHERE NOT EXISTS (SELECT 1 FROM det k WHERE k.doc_id = d.doc_id AND k.s <= d.s AND k.e >= d.e AND k.e - k.s > d.e - d.s AND k.confidence >= 0.7 AND {_COMPAT})")
def _nested(spark, sf_dir):
    return merge.not_nested(detections(spark, sf_dir)).select("id")


@query("flt_07_category_confidence", f"{D} SELECT category, count(*) AS n FROM det WHERE category IN ('PHONE','EMAIL') AND confidence >= 0.5 GROUP BY category")
def _simple(spark, sf_dir):
    return detections(spark, sf_dir).filter(c("category").isin("PHONE", "EMAIL") & (c("confidence") >= 0.5)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("join_02_iou_pairs", f"{D} SELECT a.doc_id, a.id AS id1, b.id AS id2, round((least(a.e, b.e) - greatest(a.s, b.s)) / CAST(greatest(a.e, b.e) - least(a.s, b.s) AS DOUBLE), 6) AS iou FROM det a JOIN det b ON a.doc_id = b.doc_id AND a.id < b.id AND a.s < b.e AND b.s < a.e WHERE (least(a.e, b.e) - greatest(a.s, b.s)) / CAST(greatest(a.e, b.e) - least(a.s, b.s) AS DOUBLE) >= 0.8")
def _pairs(spark, sf_dir):
    return merge.close_pairs(detections(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


GROUPS_SQL = """g0 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM det),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e, id) AS group_no FROM g0)"""


@query("agg_04_overlap_groups", f"{D}, {GROUPS_SQL} SELECT id, CAST(group_no AS BIGINT) AS group_no FROM g")
def _groups(spark, sf_dir):
    return merge.overlap_groups(detections(spark, sf_dir)).select("id", c("group_no").cast("long").alias("group_no"))


def _case(column: str, tab: dict, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tab.items()) + f" ELSE {default} END"


_WEIGHT = f"({_case('source', merge.WEIGHTS, 0.5)} + CASE source " + " ".join(f"WHEN '{s}' THEN {_case('category', t, 0)}" for s, t in merge.BONUS.items()) + " ELSE 0 END)::DOUBLE"
VOTE_SQL = f"""{D}, {GROUPS_SQL},
w AS (SELECT *, confidence * {_WEIGHT} AS w FROM g),
by_cat AS (SELECT doc_id, group_no, category, round(sum(w), 6) AS score, {_case('category', merge.RISK, 0)} AS risk FROM w GROUP BY doc_id, group_no, category),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, group_no ORDER BY score DESC, risk DESC, category DESC) AS n, lead(score) OVER x AS score2, lead(risk) OVER x AS risk2, lead(category) OVER x AS category2 FROM by_cat WINDOW x AS (PARTITION BY doc_id, group_no ORDER BY score DESC, risk DESC, category DESC)),
winner AS (SELECT doc_id, group_no, CASE WHEN score2 IS NOT NULL AND round(score - score2, 6) < 0.3 AND risk2 > risk THEN category2 ELSE category END AS category, CASE WHEN score2 IS NOT NULL AND round(score - score2, 6) < 0.3 AND risk2 > risk THEN score2 ELSE score END AS score FROM ranked WHERE n = 1),
span AS (SELECT doc_id, group_no, category, s, e, row_number() OVER (PARTITION BY doc_id, group_no, category ORDER BY e - s DESC, round(w, 6) DESC, id DESC) AS n FROM w)
SELECT v.doc_id, CAST(v.group_no AS BIGINT) AS group_no, v.category, v.score, s.s AS "start", s.e AS "end" FROM winner v JOIN span s USING (doc_id, group_no, category) WHERE s.n = 1"""


@query("agg_02_weighted_vote", VOTE_SQL)
def _vote(spark, sf_dir):
    return merge.voted(merge.overlap_groups(detections(spark, sf_dir))).withColumn("group_no", c("group_no").cast("long"))


@query("win_03_first_pattern", f"{D} SELECT id FROM det QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY id) = 1")
def _first(spark, sf_dir):
    return detect.first_pattern(detections(spark, sf_dir).withColumn("pattern_no", c("id"))).select("id")


@query("win_04_left_to_right")
def _greedy(spark, sf_dir):
    s = F.array_sort(F.collect_list(F.struct("start", (-c("end")).alias("back"), "end", "id")))
    return detections(spark, sf_dir).groupBy("doc_id").agg(s.alias("s")).select("doc_id", F.explode(spans.left_to_right(c("s"))).alias("x")).select("doc_id", "x.id", "x.start", "x.end")


@query("win_05_priority_overlap")
def _priority(spark, sf_dir):
    return merge.without_overlaps(detections(spark, sf_dir))


@query("prj_04_snapping", f"{D}, t AS (SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber * 10 AS INT) AS ts, CAST(l_linenumber * 10 + 7 AS INT) AS te FROM lineitem) SELECT id, d.doc_id, least(s, coalesce(min(ts), s)) AS \"start\", greatest(e, coalesce(max(te), e)) AS \"end\" FROM det d LEFT JOIN t ON t.doc_id = d.doc_id AND d.s < te AND ts < d.e GROUP BY id, d.doc_id, s, e")
def _snap(spark, sf_dir):
    return merge.snapped(detections(spark, sf_dir), tokens(spark, sf_dir).withColumnRenamed("sent_id", "doc_id"))


_ZONE = "CASE WHEN confidence < 0.40 THEN 'RED' WHEN confidence < 0.85 OR (category IN ('DNI_NIE','IBAN','SOCIAL_SECURITY','CREDIT_CARD','NIG') AND id % 3 = 0) THEN 'AMBER' ELSE 'GREEN' END"


@query("prj_05_confidence_zone", f"{D} SELECT {_ZONE} AS zone, count(*) AS n, count(*) FILTER (confidence < 0.7) AS needs_review, count(*) FILTER (confidence >= 0.9) AS high FROM det GROUP BY 1")
def _zone(spark, sf_dir):
    d = detections(spark, sf_dir)
    return d.groupBy(merge.zone(c("confidence"), c("category"), c("id") % 3 != 0).alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("confidence") < 0.7).alias("needs_review"), F.count_if(c("confidence") >= 0.9).alias("high"))


@query("prj_03_coreference_boost", f"{D}, names AS (SELECT DISTINCT doc_id, lower(value) AS name FROM det WHERE category = 'PERSON_NAME' AND confidence >= 0.9 AND length(value) >= 3) SELECT id, CASE WHEN n.name IS NOT NULL AND category = 'PERSON_NAME' AND confidence < 0.75 THEN 0.85::DOUBLE ELSE confidence END AS confidence FROM det d LEFT JOIN names n ON n.doc_id = d.doc_id AND n.name = lower(d.value)")
def _boost(spark, sf_dir):
    return merge.boosted(detections(spark, sf_dir)).select("id", "confidence")


@query("agg_01_category_counts", f"{D} SELECT doc_id, string_agg(category || '=' || n, ',' ORDER BY category) AS counts, CAST(sum(low) AS BIGINT) AS low FROM (SELECT doc_id, category, count(*) AS n, count(*) FILTER (confidence < 0.7) AS low FROM det GROUP BY doc_id, category) GROUP BY doc_id")
def _counts(spark, sf_dir):
    by = detections(spark, sf_dir).groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("confidence") < 0.7).alias("low"))
    per = by.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("m"), F.sum("low").alias("low"))
    return per.select("doc_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"), "low")


@query("set_01_union_detectors", f"{D} SELECT source, count(*) AS n FROM (SELECT * FROM det WHERE source = 'regex' UNION ALL SELECT * FROM det WHERE source = 'spacy') GROUP BY source")
def _union(spark, sf_dir):
    d = detections(spark, sf_dir)
    return d.filter("source = 'regex'").unionByName(d.filter("source = 'spacy'")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("set_03_delete_ids", f"{D} SELECT count(*) AS n FROM det WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0)")
def _delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").select(c("o_orderkey").cast("long").alias("doc_id"))
    return detections(spark, sf_dir).join(gone, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("top_02_pagination", "SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def _page(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(c("o_orderdate").desc(), "o_orderkey").offset(100).limit(50).select(c("o_orderkey").cast("long").alias("id"))


@query("det_11_hybrid_merge", f"{D}, a AS (SELECT DISTINCT ON (doc_id, s, e) * FROM det WHERE source = 'roberta' ORDER BY doc_id, s, e, id), b AS (SELECT DISTINCT ON (doc_id, s, e) * FROM det WHERE source = 'presidio' ORDER BY doc_id, s, e, id) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.s, b.s) AS \"start\", coalesce(a.e, b.e) AS \"end\", CASE WHEN b.id IS NULL OR a.confidence * 0.6::DOUBLE >= b.confidence * 0.4::DOUBLE THEN a.category ELSE b.category END AS category, round(CASE WHEN a.category = b.category THEN least(greatest(a.confidence * 0.6::DOUBLE, b.confidence * 0.4::DOUBLE) + 0.1, 1.0) ELSE greatest(coalesce(a.confidence * 0.6::DOUBLE, 0), coalesce(b.confidence * 0.4::DOUBLE, 0)) END, 6) AS confidence FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.s = b.s AND a.e = b.e")
def _hybrid(spark, sf_dir):
    d = detect.first_pattern(detections(spark, sf_dir).withColumn("pattern_no", c("id")).filter("source = 'roberta'"))
    e = detect.first_pattern(detections(spark, sf_dir).withColumn("pattern_no", c("id")).filter("source = 'presidio'"))
    return detect.hybrid(d, e).withColumn("confidence", F.round("confidence", 6))
