"""Normalisation, keys, masks and redaction of texts.  Column to Column, native but for Unicode forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import spans

# Characters and words of the normalisers.
SPACES = "   ⁠"
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛′´", "“”„‟«»″"
DASHES = "‐‑‒–—―−"
ZERO_WIDTH = "​‌‍⁠﻿"
CYRILLIC, LATIN = "АВЕКМНОРСТХаеорсухі", "ABEKMHOPCTXaeopcyxi"
#: Characters of a piece of a batch of texts that are mapped at once.
PIECE = 1 << 20
#: No code point: a character that the offset map leaves out.
GONE = 0x110000
HONORIFICS = r"(?iu)^(?:don|doña|dña\.?|d\.ª?|sr\.?|sra\.?|srta\.?|dr\.?|dra\.?)\s+"
LEGAL_SUFFIX = r"(?iu)[\s,]+(?:s\.?l\.?u?\.?|s\.?a\.?u?\.?|s\.?l\.?l\.?|s\.?c\.?|s\.?coop\.?|c\.?b\.?)$"


def unicode_form(x: Column, form: str = "NFKC") -> Column:
    """The Unicode form, by an Arrow function; the JVM has none."""

    def normalize(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize(form, t) for t in texts])

    return F.pandas_udf(normalize, "string")(x)


def newlines(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def spaces(x: Column) -> Column:
    return F.translate(x, SPACES, " " * len(SPACES))


def without_controls(x: Column) -> Column:
    return F.regexp_replace(x, "[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]", "")


def ingest(x: Column, form: str | None = "NFKC") -> Column:
    """First phase: Unicode form, line ends, spaces, control characters."""
    x = spaces(newlines(x))
    return without_controls(unicode_form(x, form) if form else x)


def quotes(x: Column) -> Column:
    return F.translate(x, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def dashes(x: Column) -> Column:
    return F.translate(x, DASHES, "-" * len(DASHES))


def joined_lines(x: Column) -> Column:
    """A line break between word characters is a space."""
    return F.regexp_replace(x, r"(?U)(\w)\n(\w)", "$1 $2")


def joined_letters(x: Column) -> Column:
    """Three or more single letters with blanks between are one word."""
    found = F.transform(spans.extract(x, r"(?U)\b\p{L}(?: \p{L}){2,}\b"), lambda s: F.struct(s["start"], s["end"], F.replace(s["value"], F.lit(" "), F.lit("")).alias("alias")))
    return spans.stitch(x, found)


def _mapped(t: str, plain: np.ndarray) -> tuple[str, np.ndarray]:
    points = plain[np.frombuffer(t.encode("utf-32-le"), "<u4")]
    places = np.flatnonzero(points != GONE)
    blank = points[places] == 32
    # A blank goes if what stands before it, the gone ones aside, is a blank.
    blank[1:] &= blank[:-1].copy()
    blank[:1] = False
    places = places[~blank].astype("int32")
    return points[places].tobytes().decode("utf-32-le"), places


def mapped_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts with their maps, in pieces of about ``PIECE`` characters: the map of a batch takes many times the memory of its texts."""
    plain = np.arange(0x110000, dtype="<u4")
    for chars, to in ((SINGLE_QUOTES, "'"), (DOUBLE_QUOTES, '"'), (DASHES, "-"), (SPACES, " ")):
        plain[[ord(ch) for ch in chars]] = ord(to)
    plain[[ord(ch) for ch in CYRILLIC]] = [ord(ch) for ch in LATIN]
    plain[[ord(ch) for ch in ZERO_WIDTH + "\u00ad"]] = GONE
    for texts in batches:
        begin, size = 0, 0
        for i, n in enumerate(pc.utf8_length(texts).to_pylist(), 1):
            size += n or 0
            if size >= PIECE or i == len(texts):
                done = [(None, None) if t is None else _mapped(t, plain) for t in texts.slice(begin, i - begin).to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([m for _, m in done], pa.list_(pa.int32()))], ["text", "char_map"])
                begin, size = i, 0


def mapped(x: Column) -> Column:
    """The text for detectors with the place of each of its characters in the source: struct<text, char_map>.

    Zero-width characters and soft hyphens go, runs of blanks become one, quotes,
    dashes and Cyrillic twins become plain; an Arrow function over the code points
    of each text.
    """
    return F.arrow_udf(mapped_pieces, "text string, char_map array<int>")(x)


def single_spaces(x: Column) -> Column:
    return F.regexp_replace(x, " +", " ")


def detector_text(x: Column) -> Column:
    """For detectors: no zero-width characters or soft hyphens, Cyrillic twins as Latin, single blanks."""
    x = F.translate(x, ZERO_WIDTH + "­", "")
    return single_spaces(F.translate(x, CYRILLIC, LATIN))


def match_key(x: Column) -> Column:
    """Key under which evaluation compares entity texts."""
    return F.lower(F.trim(detector_text(x)))


def glossary_key(x: Column, category: Column | None = None) -> Column:
    """Trimmed, single-spaced, lower case; persons without honorific, organisations without legal suffix."""
    base = F.trim(x)
    person = F.regexp_replace(base, HONORIFICS, "")
    organisation = lambda v: F.regexp_replace(F.regexp_replace(v, LEGAL_SUFFIX, ""), r"[.,;:\s]+$", "")
    if category is None:
        chosen = organisation(person)
    else:
        chosen = F.when(category == "PERSON_NAME", person).when(category == "ORGANIZATION", organisation(base)).otherwise(base)
    return F.lower(F.trim(F.regexp_replace(chosen, r"\s+", " ")))


def lookup_key(x: Column, category: Column) -> Column:
    return F.concat_ws(":", category, glossary_key(x, category))


def mask(x: Column, least: int = 5) -> Column:
    """A block of stars for each word, five at least."""
    return F.array_join(F.transform(F.split(F.trim(x), r"\s+"), lambda w: F.repeat(F.lit("*"), F.greatest(F.length(w), F.lit(least)))), " ")


def redacted(x: Column) -> Column:
    return F.concat(F.substring(x, 1, 3), F.lit("***"), F.substring(x, -1, 1))


def alias_number(x: Column) -> Column:
    """A number below 10000 from the sha-256 of the text."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 6), 16, 10).cast("long") % 10000


def custom_alias_valid(x: Column) -> Column:
    return (F.length(x) <= 100) & x.rlike(r"(?U)^[\w\s\-]+$") & ~x.contains("@")


def file_parts(x: Column) -> Column:
    """base and lower-case extension of a file name."""
    return F.struct(F.regexp_replace(x, r"\.[^.]*$", "").alias("base"), F.lower(F.regexp_extract(x, r"\.([^.]*)$", 1)).alias("ext"))


def without_accents(x: Column) -> Column:
    return F.translate(x, "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")
