"""The glossary of a project: keys, aliases in order of first appearance, lookups, edits and anonymised texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.functions import checks, dates, spans, text
from spanveil.operators.merge import lookup
from spanveil.operators.occurrences import occurrences

# Alias prefix by category; others take the first three letters of the category.
PREFIXES = {
    "PERSON_NAME": "Persona", "ORGANIZATION": "Org", "ADDRESS": "Dir", "LOCATION": "Lugar", "POSTAL_CODE": "CP", "DNI_NIE": "ID", "PASSPORT": "Pasaporte",
    "PHONE": "Tel", "EMAIL": "Email", "BANK_ACCOUNT": "Cuenta", "IBAN": "IBAN", "CREDIT_CARD": "Tarjeta", "DATE": "Fecha", "MEDICAL_RECORD": "Historia",
    "LICENSE_PLATE": "Matricula", "SOCIAL_SECURITY": "NSS", "PROFESSIONAL_ID": "IdProf", "CASE_NUMBER": "Proc", "PLATFORM": "Plataforma", "IP_ADDRESS": "IP", "NIG": "NIG", "CSV": "CSV",
}
LEVELS = ("BASIC", "INTERMEDIATE", "ADVANCED")
#: Documents of one bucket of first appearances.
BUCKET = 1 << 16


def prefix(category: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])[category], F.upper(F.substring(category, 1, 3)))


def numbered(keys: DataFrame, by: list[str], place: str, order: list[Column], bucket: int = BUCKET) -> DataFrame:
    """Row numbers within ``by`` in the order of place and order, without one task for a whole group.

    Places are cut into buckets; a bucket's rows are ranked on their own and
    start at the sum of the buckets before it.
    """
    cut = keys.withColumn("_bucket", F.floor(F.col(place) / bucket))
    counts = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(F.col(place), *order)))
    return ranked.join(before, [*by, "_bucket"]).withColumn("number", F.col("_base") + F.col("_rank")).drop("_bucket", "_base", "_rank")


def build(detections: DataFrame) -> DataFrame:
    """project, category, norm_key, alias, original, occurrences, first_doc_seq, first_start.

    detections: project_id, doc_seq, category, value, start.  Aliases count up
    by first appearance: documents in order, within a document from its end.
    """
    keyed = detections.withColumn("norm_key", F.when(F.col("category") == "DATE", dates.equivalence_key(F.col("value"))).otherwise(text.glossary_key(F.col("value"), F.col("category"))))
    first = F.min(F.struct(F.col("doc_seq"), (-F.col("start")).alias("back"), F.col("value")))
    keys = keyed.groupBy("project_id", "category", "norm_key").agg(first.alias("first"), F.count(F.lit(1)).alias("occurrences"))
    flat = keys.select("project_id", "category", "norm_key", "occurrences", F.col("first.doc_seq").alias("first_doc_seq"), (-F.col("first.back")).alias("first_start"), F.col("first.value").alias("original"))
    rows = numbered(flat, ["project_id", "category"], "first_doc_seq", [F.col("first_start").desc(), F.col("norm_key")])
    return rows.withColumn("alias", F.format_string("%s_%03d", prefix(F.col("category")), F.col("number").cast("int")))


def chronological(rows: DataFrame) -> DataFrame:
    """Letters A, B, ... Z, AA, ... by date within a project."""
    n = F.dense_rank().over(Window.partitionBy("project_id").orderBy("d")) - 1
    letter = lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (i + 1).cast("int"), F.lit(1))
    return rows.withColumn("_n", n).withColumn("letters", F.when(F.col("_n") < 26, letter(F.col("_n"))).when(F.col("_n") < 702, F.concat(letter(F.floor(F.col("_n") / 26) - 1), letter(F.col("_n") % 26))).otherwise(F.concat(letter(F.floor((F.col("_n") - 26) / 676) - 1), letter(F.floor((F.col("_n") - 26) / 26) % 26), letter(F.col("_n") % 26)))).drop("_n")


def replaced(detections: DataFrame, glossary: DataFrame, level: str = "INTERMEDIATE") -> DataFrame:
    """Detections with their alias: masks, glossary aliases, or synthetic values keyed by the alias."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    if level == "BASIC":
        return detections.withColumn("alias", text.mask(F.col("value")))
    keyed = detections.withColumn("norm_key", F.when(F.col("category") == "DATE", dates.equivalence_key(F.col("value"))).otherwise(text.glossary_key(F.col("value"), F.col("category"))))
    found = keyed.join(glossary.select("project_id", "category", "norm_key", "alias"), ["project_id", "category", "norm_key"], "left").drop("norm_key")
    if level == "ADVANCED":
        moved = dates.written_like(dates.shift(dates.parse(F.col("value")), dates.project_delta(F.col("project_id"))), F.col("value"))
        made = F.when(F.col("category") == "DATE", moved).otherwise(checks.invalid_identifier(F.col("category"), F.concat_ws("|", F.col("project_id").cast("string"), F.col("alias"))))
        found = found.withColumn("alias", F.coalesce(made, "alias"))
    return found.withColumn("alias", F.coalesce("alias", F.format_string("[%s]", F.col("category"))))


def anonymized(documents: DataFrame, replacements: DataFrame) -> DataFrame:
    """doc_id, n_entities, anonymized of every document (replacements do not overlap; none: the text as it is)."""
    lists = replacements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "alias"))).alias("spans"))
    done = documents.join(lists, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)))
    return done.select("doc_id", F.size("spans").cast("long").alias("n_entities"), spans.stitch(F.col("text"), F.col("spans")).alias("anonymized"))


def quoted(value: Column) -> Column:
    """A pattern that matches the value itself."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def rewritten(text: Column, pattern: Column, aliases: Column, spaced: bool = False) -> Column:
    """The text with every match of the pattern, whatever its case, replaced by ``aliases[lower(match)]``, in one pass.

    spaced: a blank follows an alias that would touch a letter or digit.
    """
    parts = F.split(F.regexp_replace(text, F.concat(F.lit("(?iu)"), pattern), F.lit(f"{spans.OPEN}$0{spans.CLOSE}")), spans.OPEN)

    def part(p: Column) -> Column:
        n = F.instr(p, spans.CLOSE)
        value, after = F.substring(p, F.lit(1), n - 1), F.substring(p, n + 1, F.length(p))
        blank = F.when(after.rlike(r"^[\p{L}\p{N}]"), " ").otherwise("") if spaced else F.lit("")
        return F.when(n > 0, F.concat(F.coalesce(aliases[F.lower(value)], value), blank, after)).otherwise(p)

    return F.array_join(F.transform(parts, part), "")


def _alternation(values: Column) -> Column:
    """Quoted values, longest first, as one pattern; values: array<struct<n, value>> with n the negative length."""
    return F.array_join(F.transform(F.array_sort(values), lambda v: quoted(v["value"])), "|")


def merged_entries(entries: DataFrame) -> DataFrame:
    """Entries of equal alias and category (case aside) are one: the first stays, occurrences add up, originals gather."""
    rows = entries.withColumn("a", F.lower("alias")).withColumn("c", F.lower("category"))
    return rows.groupBy("a", "c").agg(F.min_by("original", "id").alias("original"), F.sum("occurrences").alias("occurrences"), F.array_sort(F.collect_set("original")).alias("originals")).withColumnsRenamed({"a": "alias", "c": "category"})


def next_numbers(entries: DataFrame) -> DataFrame:
    """Per prefix the largest number that an alias ends in."""
    number = F.nullif(F.regexp_extract("alias", r"_(\d+)$", 1), F.lit("")).cast("long")
    return entries.select(F.regexp_extract("alias", r"^(.*)_\d+$", 1).alias("prefix"), number.alias("n")).filter("n IS NOT NULL").groupBy("prefix").agg(F.max("n").alias("last"))


#: Shorter entries are not scanned for.
SHORTEST = 5


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, not anew inside every lambda."""
    return F.transform(F.array(value), use)[0]


def _gaps(documents: DataFrame, replacements: DataFrame) -> DataFrame:
    """doc_id, project_id, spans and the texts between them: gaps, one more than spans."""
    lists = replacements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "alias"))).alias("spans"))
    rows = documents.join(lists, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)))
    n = F.size("spans")
    at = lambda i, name, default: F.when((i >= 0) & (i < n), F.get("spans", i)[name]).otherwise(default)
    begin, end = lambda i: at(i - 1, "end", F.lit(0)), lambda i: at(i, "start", F.length("text"))
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(F.col("text"), begin(i) + 1, end(i) - begin(i)))
    return rows.select("doc_id", "project_id", "spans", gaps.alias("gaps"))


def missed(documents: DataFrame, glossary: DataFrame, replacements: DataFrame) -> DataFrame:
    """Glossary persons and organisations that still stand, whatever their case, in the gaps between a document's replacements."""
    gaps = _gaps(documents, replacements).select("doc_id", "project_id", F.lower(F.array_join("gaps", "\n")).alias("text"))
    known = glossary.filter(F.col("category").isin("PERSON_NAME", "ORGANIZATION") & (F.length("original") >= SHORTEST)).select("project_id", F.lower("original").alias("value"), "alias")
    known = known.groupBy("project_id", "value").agg(F.min("alias").alias("alias"))
    return occurrences(gaps, known).select("doc_id", "value", "alias")


def rescanned(documents: DataFrame, glossary: DataFrame, replacements: DataFrame) -> DataFrame:
    """doc_id and the anonymised text in which missed entries are replaced too, the longest first, outside of replacements."""
    hits = missed(documents, glossary, replacements).groupBy("doc_id").agg(
        _alternation(F.collect_list(F.struct((-F.length("value")).alias("n"), F.col("value")))).alias("pattern"), F.map_from_entries(F.collect_list(F.struct("value", "alias"))).alias("aliases")
    )
    rows = _gaps(documents, replacements).join(hits, "doc_id", "left")
    letter = lambda x: F.when(x.rlike(r"^[\p{L}\p{N}]"), " ").otherwise("")
    cleaned = F.when(F.col("pattern").isNull(), F.col("gaps")).otherwise(F.transform("gaps", lambda g: rewritten(g, F.col("pattern"), F.col("aliases"), spaced=True)))
    piece = lambda z, i: F.concat(F.when(i > 0, F.concat(F.get("spans", i - 1)["alias"], letter(F.get(z["gaps"], i)))).otherwise(""), F.get(z["clean"], i))
    pieces = _bound(F.struct("gaps", cleaned.alias("clean")), lambda z: F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: piece(z, i)))
    return rows.select("doc_id", F.array_join(pieces, "").alias("text"))


def apply_changes(texts: DataFrame, changes: DataFrame) -> DataFrame:
    """Old aliases, whatever their case, to new ones in all texts of a project, longest first, in one pass; doc_id, project_id, text / project_id, old, new."""
    old = F.lower("old")
    once = changes.groupBy("project_id", old.alias("value")).agg(F.min("new").alias("new"))
    lists = once.groupBy("project_id").agg(_alternation(F.collect_list(F.struct((-F.length("value")).alias("n"), F.col("value")))).alias("pattern"), F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias("aliases"))
    return texts.join(lists, "project_id", "left").select("doc_id", "project_id", F.when(F.col("pattern").isNull(), F.col("text")).otherwise(rewritten(F.col("text"), F.col("pattern"), F.col("aliases"))).alias("text"))


def fuzzy_keys(keys: DataFrame, least: float = 90.0) -> DataFrame:
    """Pairs of person keys of a project whose Levenshtein ratio reaches the threshold.

    The ratio allows ``e`` edits for the longer key.  Cut into ``e + 1`` pieces,
    one of them stands unchanged in the other key, at most ``e`` places off.
    """
    rows = keys.select("project_id", "norm_key", F.length("norm_key").alias("m")).distinct()
    edits = F.floor(F.col("n") * ((100 - least + 1e-4) / 100)).cast("int")
    begin = lambda i: F.floor(i * F.col("n") / (F.col("e") + 1)).cast("int")
    # Lengths of longer keys, with their edits and pieces.
    lengths = rows.select("project_id", F.col("m").alias("n")).distinct().withColumn("e", edits)
    pieces = lengths.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e")))).withColumn("at", begin(F.col("i"))).withColumn("len", begin(F.col("i") + 1) - F.col("at"))
    held = rows.withColumnRenamed("m", "n").join(pieces, ["project_id", "n"]).select("project_id", "n", "i", F.substring("norm_key", F.col("at") + 1, F.col("len")).alias("piece"), F.col("norm_key").alias("long"))
    low, high = F.greatest(F.lit(0), F.col("at") - F.col("e")), F.least(F.col("m") - F.col("len"), F.col("at") + F.col("e"))
    tried = rows.join(pieces, "project_id").filter((F.col("m") <= F.col("n")) & (F.col("n") - F.col("m") <= F.col("e")) & (low <= high)).withColumn("p", F.explode(F.sequence(low, high)))
    probes = tried.select("project_id", "n", "i", F.substring("norm_key", F.col("p") + 1, F.col("len")).alias("piece"), F.col("norm_key").alias("short")).distinct()
    pairs = held.join(probes, ["project_id", "n", "i", "piece"]).filter("long <> short").select("project_id", F.least("long", "short").alias("key1"), F.greatest("long", "short").alias("key2")).distinct()
    ratio = 100 * (1 - F.levenshtein("key1", "key2") / F.greatest(F.length("key1"), F.length("key2")))
    return pairs.withColumn("ratio", F.round(ratio, 4)).filter(F.col("ratio") >= least)


def partial_names(keys: DataFrame) -> DataFrame:
    """Pairs of keys of which the shorter's words (two at least) begin the longer's."""
    rows = keys.withColumn("w", F.split("norm_key", " ")).filter("size(w) >= 2").withColumn("head", F.concat_ws(" ", F.slice("w", 1, 2)))
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.head") == F.col("b.head")) & (F.size("a.w") < F.size("b.w")) & F.startswith(F.col("b.norm_key"), F.concat(F.col("a.norm_key"), F.lit(" ")))).select(F.col("a.project_id"), F.col("a.norm_key").alias("short"), F.col("b.norm_key").alias("long"))


def folded(keys: DataFrame, least: float = 90.0) -> DataFrame:
    """Person keys with the key whose alias they take: the earliest of their partial or fuzzy matches, else their own.

    keys: project_id, norm_key, first_doc_seq.  Matches come from blocked joins,
    so no project is folded in one task.
    """
    partial = partial_names(keys).select("project_id", F.col("short").alias("a"), F.col("long").alias("b"))
    near = fuzzy_keys(keys, least).select("project_id", F.col("key1").alias("a"), F.col("key2").alias("b"))
    pairs = partial.unionByName(near)
    both = pairs.unionByName(pairs.select("project_id", F.col("b").alias("a"), F.col("a").alias("b")))
    earlier = both.join(keys.select("project_id", F.col("norm_key").alias("b"), F.col("first_doc_seq").alias("seq")), ["project_id", "b"]).groupBy("project_id", F.col("a").alias("norm_key")).agg(F.min(F.struct("seq", "b")).alias("m"))
    out = keys.join(earlier, ["project_id", "norm_key"], "left")
    sooner = F.col("m").isNotNull() & (F.struct("m.seq", "m.b") < F.struct("first_doc_seq", "norm_key"))
    return out.select("project_id", "norm_key", F.when(sooner, F.col("m.b")).otherwise(F.col("norm_key")).alias("alias_key"))


def corrected(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries whose original text was corrected: an equal key's alias is reused, else the next number is given.

    entries: project_id, category, norm_key, alias; changes: project_id,
    category, norm_key, new_key.
    """
    known = entries.select("project_id", "category", F.col("norm_key").alias("new_key"), F.col("alias").alias("known_alias"))
    last = entries.groupBy("project_id", "category").agg(F.max(F.regexp_extract("alias", r"_(\d+)$", 1).cast("long")).alias("last"))
    rows = changes.filter("new_key <> norm_key").join(known, ["project_id", "category", "new_key"], "left").join(last, ["project_id", "category"], "left")
    fresh = F.row_number().over(Window.partitionBy("project_id", "category", F.col("known_alias").isNull()).orderBy("new_key"))
    return rows.withColumn("n", fresh).select("project_id", "category", "norm_key", "new_key", F.coalesce("known_alias", F.format_string("%s_%03d", prefix(F.col("category")), (F.coalesce("last", F.lit(0)) + F.col("n")).cast("int"))).alias("alias"))
