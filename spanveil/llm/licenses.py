"""Fuzzy short-notice search for licence lines.

Texts are normalised to their words joined by one space (A-Z lowered, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``).  A notice of up to ``k`` edits is
split into ``k + 1`` pieces; by the pigeonhole principle one piece stands
unchanged in every match, so exact seeds locate all candidates.  The regex
library's bounded-error matching then verifies each candidate window and
gives span and number of edits.

Defined cases: null text is an empty text (a row with zero words, no labels,
score 0); a null id stays null; repeated rows give repeated results; an empty
table gives an empty result; other columns of the input are ignored.

The operator is a map over rows: no shuffle, memory bounded by one Arrow
batch, so keys of any frequency cost nothing extra.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import bytescan


@dataclass(frozen=True)
class Notice:
    """A label, the words that stand for it, and whether consecutive exact words make it a base label."""

    label: str
    phrase: str
    base: bool = False

    @property
    def edits(self) -> int:
        """One edit for each ten bytes of the phrase, at most three; none for very short ones."""
        return min(3, len(self.phrase.encode()) // 10) if len(self.phrase) >= 12 else 0


# Phrases and labels.
NOTICES = (
    Notice("mit", "under the mit license", True),
    Notice("apache-2", "apache license version 2", True),
    Notice("cc-by-nc", "cc by nc", True),
    Notice("all-rights-reserved", "all rights reserved"),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("gpl", "gnu general public license"),
    Notice("isc", "permission to use copy modify and or distribute this software"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("mpl-2", "mozilla public license version 2"),
    Notice("unlicense", "released into the public domain"),
)

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans array<struct<label: string, first_word: long, text: string, edits: int, similarity: double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("text", pa.string()), ("edits", pa.int32()), ("similarity", pa.float64())]))


def _places(data: bytes, what: bytes) -> Iterator[int]:
    at = data.find(what)
    while at >= 0:
        yield at
        at = data.find(what, at + 1)


def normalised(chunk: bytescan.Chunk) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by single spaces, a line feed after each document; word starts; documents' first words and bounds."""
    lowered = chunk.lowered().data
    flat = np.where(bytescan.ALNUM[lowered] == 1, lowered, np.uint8(0x20))
    flat = np.insert(flat, chunk.offsets[1:], 0x0A)
    before = np.concatenate([np.array([0x0A], np.uint8), flat[:-1]])
    word = flat > 0x20
    flat = flat[word | (flat == 0x0A) | ((flat == 0x20) & (before > 0x20))]
    before = np.concatenate([np.array([0x0A], np.uint8), flat[:-1]])
    starts = np.flatnonzero((flat > 0x20) & (before <= 0x20))
    ends = np.flatnonzero(flat == 0x0A)
    bounds = np.concatenate([[0], ends + 1])
    return flat.tobytes(), starts, np.searchsorted(starts, bounds), bounds


class Finder:
    def __init__(self, notices: Sequence[Notice]):
        self.notices = [(n, n.phrase.encode()) for n in notices]
        self.seeds: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.patterns = []
        for i, (n, phrase) in enumerate(self.notices):
            pieces = n.edits + 1
            cuts = [len(phrase) * j // pieces for j in range(pieces + 1)]
            for a, b in zip(cuts, cuts[1:]):
                self.seeds[phrase[a:b]].append((i, a))
            self.patterns.append(regex.compile(rb"(?b)(?<![^ \n])(?:" + regex.escape(phrase) + rb"){e<=" + str(n.edits).encode() + rb"}(?![^ \n])"))

    def base(self, data: bytes) -> list[tuple[int, str]]:
        found = []
        for n, phrase in self.notices:
            if n.base:
                for p in _places(data, phrase):
                    if (p == 0 or data[p - 1] <= 0x20) and data[p + len(phrase)] <= 0x20:
                        found.append((p, n.label))
        return found

    def fuzzy(self, data: bytes, bounds: np.ndarray) -> list[tuple[int, int, Notice, int, int]]:
        """(start, end, notice, edits, document) of verified matches."""
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for seed, of in self.seeds.items():
            for p in _places(data, seed):
                for i, offset in of:
                    n, phrase = self.notices[i]
                    windows[i].append((p - offset - n.edits - 1, p - offset + len(phrase) + n.edits + 1))
        out = []
        for i, spans in windows.items():
            n, phrase = self.notices[i]
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                doc = int(np.searchsorted(bounds, min(max(a + n.edits + 1, 0), len(data) - 1), "right")) - 1
                for d in {doc, int(np.searchsorted(bounds, min(b, len(data) - 1), "right")) - 1}:
                    lo, hi = max(a, int(bounds[d])), min(b, int(bounds[d + 1]) - 1)
                    if lo >= hi:
                        continue
                    if merged and merged[-1][2] == d and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi, d])
            seen = set()
            for lo, hi, d in merged:
                for m in self.patterns[i].finditer(data, lo, hi):
                    a, b = m.span()
                    while a < b and data[a] <= 0x20:
                        a += 1
                    if a < b and (a, b) not in seen:
                        seen.add((a, b))
                        out.append((a, b, n, sum(m.fuzzy_counts), d))
        return out


def find_notices(documents: DataFrame, notices: Sequence[Notice] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: word count, exact base places, and verified spans with their edits."""
    notices = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices)
        for batch in batches:
            for c in bytescan.chunks(batch.column(1)):
                data, starts, first, bounds = normalised(c)
                n = c.last - c.first
                base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                spans: list[list[dict]] = [[] for _ in range(n)]
                for p, label in finder.base(data):
                    d = int(np.searchsorted(bounds, p, "right")) - 1
                    base[d].append((int(np.searchsorted(starts, p)) - int(first[d]), label))
                for a, b, notice, edits, d in finder.fuzzy(data, bounds):
                    word = int(np.searchsorted(starts, a, "right")) - 1 - int(first[d])
                    spans[d].append({"label": notice.label, "first_word": word, "text": data[a:b].decode("utf-8", "replace"), "edits": edits, "similarity": max(0.0, 1 - edits / len(notice.phrase.encode()))})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.first, n),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([len(x) for x in base], pa.int64()),
                        pa.array([min(x)[0] if x else None for x in base], pa.int64()),
                        pa.array([max(x)[0] if x else None for x in base], pa.int64()),
                        pa.array([sorted({y for _, y in x}) for x in base], pa.list_(pa.string())),
                        pa.array([sorted(x, key=lambda s: (s["first_word"], s["label"], s["text"])) for x in spans], _SPAN),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans"],
                )

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda s: s["label"]))))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0))).alias("score"),
    )
