"""Benchmark decontamination through one FM-index per training shard.

A shard is a run of whole documents of an Arrow batch, of about ``SHARD_WORDS``
words.  Words (A-Z lowered, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) become
symbols of the benchmark's vocabulary; words outside it cannot lie in an
occurrence, so they separate runs, and runs shorter than the shortest test
phrase are left out of the index.  The shard's Burrows-Wheeler transform is held
in a wavelet matrix of packed bit planes; all distinct test windows are searched
backwards together, occurrences are located from sampled suffix positions, the
words found there are compared byte by byte with the benchmark's, and merged
into removal spans.

Scale: documents are never shuffled, and cutting happens in the pass that finds.
The test phrases are broadcast in blocks of at most ``BLOCK_BYTES`` of item text
(a longer single item is its own block) as one array of symbols and the places
of the distinct windows in it; each further block is one more pass over a
written table.  A shard's memory is bounded but for a single longer document.

Defined cases: null texts have no words; items without words never occur; an
item of fewer than ``window`` words is one window; a null item id is the empty
string; items of equal id are one item; very long texts are shards of their
own, never cut; words that share a hash are told apart by their bytes; nothing
here depends on an order, so there are no ties; repeated rows give repeated
results; empty tables give empty results (no benchmark: nothing is hit); other
columns stay, but for those named ``n_words``, ``spans`` and ``items``, which
give way to the operator's in ``find_contamination``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import bytescan, scratch, workers

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_WORDS = 1 << 18
SAMPLE = 8
#: Phrases that are searched together.
TOGETHER = 1 << 16
_U = np.uint64


class BitPlane:
    """Bits in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)]).view(_U)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def rank(self, upto: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = upto >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((_U(1) << (upto & 63).astype(_U)) - _U(1)))


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        present = np.flatnonzero(np.bincount(symbols, minlength=n_symbols))
        self.planes = []
        for b in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> b) & 1 == 1
            plane = BitPlane(bit)
            self.planes.append((b, len(symbols) - plane.ones, plane))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.origin = np.zeros(n_symbols, np.int64)
        self.origin[present] = self._down(present, np.zeros(len(present), np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, zeros, plane in self.planes:
            ones = plane.rank(at)
            at = np.where((symbol >> b) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol, one that occurs, stands before each position."""
        return self._down(symbol, upto) - self.origin[symbol]


def suffix_array(symbols: np.ndarray, separator: int) -> np.ndarray:
    """Sorted suffixes by prefix doubling; each separator counts as a symbol of its own, in order of position."""
    n = len(symbols)
    key = symbols.astype(np.int64)
    seps = np.flatnonzero(symbols == separator)
    key += len(seps)
    key[seps] = np.arange(len(seps))
    step = 1
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    while True:
        in_order = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step *= 2


class FMIndex:
    """Backward search over runs of symbols >= 1; 0 ends each run."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        self.symbols = symbols
        order = suffix_array(symbols, 0)
        self.bwt = symbols[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, n_symbols)
        counts = np.bincount(symbols, minlength=n_symbols)
        self.present = counts > 0
        self.before = np.concatenate([[0], np.cumsum(counts)])
        # A run's first position is sampled too: a walk never crosses a separator.
        kept = (order % sample == 0) | (self.bwt == 0)
        self.kept, self.sampled = BitPlane(kept), order[kept].astype(np.int32)
        self.is_kept = kept

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length (a row of symbols each)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        alive = np.flatnonzero(self.present[phrases].all(1))
        hi[alive] = len(self.symbols)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            both = self.step(np.concatenate([c, c]), np.concatenate([lo[alive], hi[alive]]))
            lo[alive], hi[alive] = both[: len(alive)], both[len(alive) :]
            gone = hi[alive] <= lo[alive]
            hi[alive[gone]] = lo[alive[gone]]
            alive = alive[~gone]
            if not len(alive):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by walking back to a sampled one."""
        rows = rows.astype(np.int64)
        out = np.full(len(rows), -1, np.int64)
        steps = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.is_kept[rows[left]]
            out[left[done]] = self.sampled[self.kept.rank(rows[left[done]])] + steps[left[done]]
            left = left[~done]
            rows[left] = self.step(self.bwt[rows[left]], rows[left])
            steps[left] += 1
        return out


def ranked(symbols: np.ndarray, length: int) -> np.ndarray:
    """Numbers that are equal exactly where the next ``length`` symbols are."""
    if length == 1:
        return symbols.astype(np.int64)
    half = length // 2
    a = ranked(symbols, half)
    b = a if length == 2 * half else ranked(symbols, length - half)
    n = len(symbols) - length + 1
    return np.unique(a[:n] * (int(b.max(initial=0)) + 1) + b[half : half + n], return_inverse=True)[1]


def same_bytes(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Whether the slices of a equal those of b, pair by pair."""
    n = a_to - a_from
    out = n == b_to - b_from
    n = np.where(out, n, 0)
    pair = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    wrong = a[a_from[pair] + step] != b[b_from[pair] + step]
    out[pair[wrong]] = False
    return out


class Phrases:
    """The distinct windows of a block of test items: places in one sequence of symbols of their vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        #: Sorted, so that sorted numbers are sorted ids.
        self.items = sorted({item or "" for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        of = np.array([number[item or ""] for item, _ in items], np.int64)
        texts = [bytescan.Chunk(c.first, c.last, c.data, c.offsets).lowered() for c in bytescan.chunks(pa.array([t or "" for _, t in items], pa.large_string()))]
        words = [bytescan.scan(c, bytescan.ALNUM) for c in texts]
        data = np.concatenate([c.data for c in texts]) if texts else np.zeros(0, np.uint8)
        base = np.cumsum([0, *[len(c.data) for c in texts]])
        starts, ends = (np.concatenate([np.zeros(0, np.int64), *[getattr(w, k) + b for w, b in zip(words, base)]]) for k in ("starts", "ends"))
        counts = np.concatenate([np.zeros(0, np.int64), *[w.counts for w in words]])
        # Two words of one hash would be one symbol: then all are hashed in another way.
        for self.way in range(len(bytescan.BYTE_POWERS)):
            hashes = np.concatenate([np.zeros(0, _U), *[bytescan.word_hashes(c, w, self.way) for c, w in zip(texts, words)]])
            self.vocabulary, first, symbols = np.unique(hashes, return_index=True, return_inverse=True)
            if same_bytes(data, starts, ends, data, starts[first][symbols], ends[first][symbols]).all():
                break
        else:
            raise ValueError("words of the benchmark share all of their hashes")
        self.symbols = (symbols + 1).astype(np.int32)
        size = ends[first] - starts[first]
        self.word_ends = np.cumsum(size)
        self.word_starts = self.word_ends - size
        self.word_bytes = data[np.repeat(starts[first] - self.word_starts, size) + np.arange(int(size.sum()))]
        begins = np.cumsum(counts) - counts
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.minimum(counts, window)
        for n in np.unique(lengths[lengths > 0]).tolist():
            mine = np.flatnonzero(lengths == n)
            many = counts[mine] - n + 1
            place = np.repeat(begins[mine] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            rank = ranked(self.symbols, n)[place]
            _, at, same = np.unique(rank, return_index=True, return_inverse=True)
            pairs = np.unique(same * len(self.items) + np.repeat(of[mine], many))
            self.by_length[n] = place[at].astype(np.int32), np.searchsorted(pairs, np.arange(len(at) + 1) * len(self.items)), (pairs % len(self.items)).astype(np.int32)
        self.shortest = min(self.by_length, default=1)

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


class Shard:
    """Runs of vocabulary words of whole documents, gathered chunk by chunk."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.words, self.bytes = phrases, [], 0, 0

    def add(self, c: bytescan.Chunk) -> np.ndarray:
        """Take the runs of a chunk; the number of words of its documents."""
        w = bytescan.scan(c, bytescan.ALNUM)
        s = self.phrases.symbols_of(bytescan.word_hashes(c, w, self.phrases.way))
        new = np.ones(len(s) + 1, bool)
        new[1:-1] = (s[1:] == 0) | (s[:-1] == 0)
        new[w.first] = True
        begins = np.flatnonzero(new[:-1])
        lengths = np.diff(np.append(begins, len(s)))
        keep = (lengths >= self.phrases.shortest) & (s[begins] > 0) if len(s) else np.zeros(0, bool)
        begins, lengths = begins[keep], lengths[keep]
        if len(begins):
            take = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]), lengths + 1) + np.arange(int((lengths + 1).sum()))
            last = np.cumsum(lengths + 1) - 1
            take[last] = np.minimum(take[last], len(s) - 1)
            symbols = s[take]
            symbols[last] = 0
            doc = np.searchsorted(w.first, take, "right") - 1
            rows = (doc + c.first).astype(np.int32)
            rows[last] = -1
            self.parts.append((symbols, rows, (take - w.first[doc]).astype(np.int32), (w.starts[take] + self.bytes).astype(np.int32), (w.ends[take] + self.bytes).astype(np.int32), c.data))
            self.words += len(symbols)
            self.bytes += len(c.data)
        return w.counts

    def search(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, list[int]]]:
        """For rows with hits their merged spans (first word, words) and numbers of items."""
        if not self.parts:
            return {}, {}
        symbols, rows, at, starts, ends, data = map(np.concatenate, zip(*self.parts))
        p = self.phrases
        index = FMIndex(symbols, len(p.vocabulary) + 1)
        hits = []
        for length, (place, _, _) in p.by_length.items():
            for i in range(0, len(place), TOGETHER):
                lo, hi = index.search(p.symbols[place[i : i + TOGETHER, None] + np.arange(length)])
                found = np.flatnonzero(hi > lo)
                if len(found):
                    count = (hi - lo)[found]
                    where = index.locate(np.repeat(lo[found] - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
                    hits.append((length, np.repeat(found + i, count), where))
        cover = np.zeros(len(symbols) + 1, np.int64)
        for length, _, where in hits:
            np.add.at(cover, where, 1)
            np.add.at(cover, where + length, -1)
        covered = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        word = symbols[covered] - 1
        wrong = np.zeros(len(symbols) + 1, np.int64)
        wrong[covered + 1] = ~same_bytes(data, starts[covered], ends[covered], p.word_bytes, p.word_starts[word], p.word_ends[word])
        wrong = np.cumsum(wrong)
        cover[:] = 0
        pairs = [np.zeros(0, np.int64)]
        for length, which, where in hits:
            right = wrong[where + length] == wrong[where]
            which, where = which[right], where[right]
            np.add.at(cover, where, 1)
            np.add.at(cover, where + length, -1)
            _, first, numbers = p.by_length[length]
            once = np.unique(rows[where].astype(np.int64) * (len(first) - 1) + which)
            row, which = once // (len(first) - 1), once % (len(first) - 1)
            n = first[which + 1] - first[which]
            pairs.append(np.repeat(row, n) * len(p.items) + numbers[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, list[int]] = {}
        covered = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        if len(covered):
            gap = np.flatnonzero((np.diff(covered) > 1) | (np.diff(at[covered]) != 1) | (np.diff(rows[covered]) != 0)) + 1
            for run in np.split(covered, gap):
                spans.setdefault(int(rows[run[0]]), []).append((int(at[run[0]]), len(run)))
        for pair in np.unique(np.concatenate(pairs)).tolist():
            items.setdefault(pair // len(p.items), []).append(pair % len(p.items))
        return spans, items


def search_batch(column: pa.Array, phrases: Phrases, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, list[str]]]:
    """Words per row of a text column, and for rows with hits their merged spans and sorted items."""
    n_words = np.zeros(len(column), np.int64)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, list[str]] = {}

    def close(shard: Shard) -> Shard:
        found, numbers = shard.search()
        spans.update(found)
        items.update({r: [phrases.items[i] for i in x] for r, x in numbers.items()})
        return Shard(phrases)

    shard = Shard(phrases)
    for raw in bytescan.chunks(column):
        n_words[raw.first : raw.last] = shard.add(raw.lowered())
        if shard.words >= shard_words:
            shard = close(shard)
    close(shard)
    return n_words, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, n in sorted(spans):
        if out and first <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], first + n - out[-1][0]))
        else:
            out.append((first, n))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; the cut leaves one space."""
    data = text.encode()
    c = bytescan.Chunk(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)])).lowered()
    w = bytescan.scan(c, bytescan.ALNUM)
    out, at = [], 0
    for first, n in spans:
        out.append(data[at : w.starts[first]].strip())
        at = int(w.ends[first + n - 1])
    out.append(data[at:].strip())
    return b" ".join(x for x in out if x).decode()


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for i in range(n):
        yield [(r.item, r.text) for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()]


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
_MARKS = "_found_words long, _found_spans array<struct<first_word: long, n_words: long>>, _found_items array<string>"


def _search(documents: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int, cut: bool) -> DataFrame:
    """The columns of documents and the marks, or with ``cut`` the columns alone, the spans cut out of the texts."""
    spark = documents.sparkSession
    workers.small_batches(spark)
    names = documents.columns
    marked = spark.createDataFrame([], _MARKS).schema
    plain, k, text_at = documents.schema, len(names), names.index(text_col)
    cast = documents.withColumn(text_col, F.col(text_col).cast("string"))
    df = cast
    every = list(blocks(benchmark, item_col, item_text_col, block_bytes))
    for i, block in enumerate(every):
        held = spark.sparkContext.broadcast(Phrases(block, window))
        last = i == len(every) - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, again=i > 0, ends=last and cut) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, spans, items = search_batch(batch.column(text_at), held.value)
                if again:
                    for r in np.flatnonzero(batch.column(k + 1).value_lengths().to_numpy(zero_copy_only=False)).tolist():
                        spans[r] = merged([(x["first_word"], x["n_words"]) for x in batch.column(k + 1)[r].as_py()] + spans.get(r, []))
                        items[r] = sorted({*batch.column(k + 2)[r].as_py(), *items.get(r, ())})
                columns = batch.columns[:k]
                if not ends:
                    all_spans = [[{"first_word": a, "n_words": b} for a, b in spans.get(r, ())] for r in range(len(batch))]
                    all_items = [items.get(r, []) for r in range(len(batch))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(all_spans, _SPANS), pa.array(all_items, pa.list_(pa.string()))], [*names, *marked.names])
                elif not spans:
                    yield pa.RecordBatch.from_arrays(columns, names)
                else:
                    gone = np.zeros(len(batch), bool)
                    text = columns[text_at].to_pylist()
                    for r, mine in spans.items():
                        gone[r] = sum(n for _, n in mine) == n_words[r]
                        text[r] = without_spans(text[r], mine)
                    columns[text_at] = pa.array(text, columns[text_at].type)
                    yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(~gone))

        schema = cast.schema if last and cut else type(plain)([*cast.schema.fields, *marked.fields])
        df = df.mapInArrow(workers.lean(run), schema)
        if not last:
            df = scratch.written(df, "decontaminate")
            held.destroy()
    return df


def find_contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents with ``n_words``, merged ``spans`` and ``items`` (sorted ids) added; clashing columns give way."""
    rows = documents.drop("n_words", "spans", "items")
    found = _search(rows, benchmark, text_col, item_col, item_text_col, window, block_bytes, False)
    return found.withColumnsRenamed({"_found_words": "n_words", "_found_spans": "spans", "_found_items": "items"})


def remove_contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of documents, the merged spans cut out of the texts; documents with no word left go."""
    return _search(documents, benchmark, text_col, "item_id", "text", window, block_bytes, True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = find_contamination(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM p),
windows AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, w.n, i, item FROM windows w JOIN p ON w.n = p.n AND w.phrase = p.phrase),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
