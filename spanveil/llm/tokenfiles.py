"""Token ids in flat unsigned integer files with 64-bit document offsets.

Format of a set of files (one triple for each part, parts in document order):

* ``part-NNNNN.bin``  the ids of the part's documents, one after another, as
  little-endian unsigned 16-bit (vocabularies of up to 65,536 ids) or 32-bit
  integers, each document closed by the end id;
* ``part-NNNNN.off``  n + 1 signed 64-bit offsets of the part's documents;
* ``part-NNNNN.doc``  n signed 64-bit document ids.

A part's base, the number of ids before it, is the prefix sum over the parts.
Documents stand in ascending order of their id; rows that share an id follow
the hash of their text, then the text.

Texts are encoded where they are read; only ids travel to the part that holds
them, each part to a task of its own.  The number of parts grows with the bytes
of text.  Parts are ranges of document ids cut at percentiles, beyond ``CUTS``
parts at even steps of ids between them; an id that fills several percentiles is
dealt over all their parts.  The library's encoder is
asked once for each distinct piece between ASCII white space, as the
tokenizer's normaliser and pre-tokenizer never look across white space; the
memo is bounded, pieces beyond it are encoded each time.  Memory mapping needs a
mounted folder; of another store a part, which is bounded, is read into memory.

Writes go to a name of the attempt and are moved into place, so lost
executors, retries and speculation leave whole files.

Defined cases: null text is an empty text (only the end id); a very long text is
one document of one part; a null id sorts first and is stored as the smallest
64-bit integer, read back as null; ids that tie are ordered as said; repeated
rows are stored repeatedly; an empty table has no parts; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import os
import random
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import bytescan, scratch, workers

NULL_ID = -(1 << 63)
#: Entries of each of an encoder's two memos.
MEMO = 250_000
#: Bytes of text of a part in a large table, and of a part at least; percentiles that cut parts, at most.
PART_BYTES, LEAST_BYTES, CUTS = 256 << 20, 1 << 20, 4096
#: Pieces of printable ASCII and Latin-1 letters only, which stay as they are but for case, and what the
#: pre-tokenizer makes of them.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def probes(n: int = 1500) -> list[str]:
    """Pieces of all the letters that the short way takes, mixed with marks and digits."""
    r = random.Random(1)
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    words = ["".join(r.choices(r.choice((letters, letters, "aeiost'", "'sdlmrtv0.É")), k=r.randint(1, 9))) for _ in range(n)]
    return ["straße", "Éeuxle", "it'S", "Ñandú.", "Then,", "a12(b)!!", "x''re", *letters, *(w for w in words if "<|" not in w)]


class Encoder(dict):
    """Pieces between white space to the bytes of their ids."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo, self.cores = memo, {}
        self.tokenize, self.pack = self.tokenizer.model.tokenize, lambda ids: struct.pack(f"<{len(ids)}{code}", *ids)
        self.letters = byte_letters()
        # The short way is taken only if it gives what the library gives.
        self.short = True
        self.short = all(self.encode_piece(p.encode()) == self.slow(p) for p in probes())

    def slow(self, piece: str) -> bytes:
        return self.pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def core(self, word: str) -> bytes:
        """Ids of one piece of the pre-tokenizer, in lower case."""
        if (found := self.cores.get(word)) is None:
            written = "".join(map(self.letters.__getitem__, word.encode()))
            found = self.pack([t.id for t in self.tokenize(written)])
            if len(self.cores) < self.memo:
                self.cores[word] = found
        return found

    def encode_piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.short and _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.core, _SPLIT.findall(text.lower())))
        return self.slow(text)

    def __missing__(self, piece: bytes) -> bytes:
        found = self.encode_piece(piece)
        if len(self) < self.memo:
            self[piece] = found
        return found

    def encode(self, text: bytes) -> bytes:
        return b"".join([self[w] for w in text.split()])


def worker_encoder(path: str) -> Encoder:
    """The encoder of a worker process, with what earlier tasks left in its memos."""
    return workers.keep(("encoder", path), lambda: Encoder(path))


def _local(uri: str) -> str | None:
    p = urlparse(uri)
    return p.path if p.scheme in ("", "file") else None


class _Sink:
    """A file under a shared folder, moved into place when closed."""

    def __init__(self, uri: str):
        self.attempt = f"{uri}.{os.getpid()}-{os.urandom(6).hex()}"
        self.uri = uri
        if path := _local(self.attempt):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.file = open(path, "wb")
        else:
            from pyarrow import fs

            self.fs, path = fs.FileSystem.from_uri(self.attempt)
            self.file = self.fs.open_output_stream(path)

    def close(self) -> None:
        self.file.close()
        if _local(self.uri):
            os.replace(_local(self.attempt), _local(self.uri))
        else:
            from pyarrow import fs

            self.fs.move(fs.FileSystem.from_uri(self.attempt)[1], fs.FileSystem.from_uri(self.uri)[1])


def mapped(uri: str, dtype: np.dtype) -> np.ndarray:
    """A flat file as an array, memory-mapped where the folder is mounted."""
    if path := _local(uri):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    f, path = fs.FileSystem.from_uri(uri)
    return np.frombuffer(f.open_input_file(path).read(), dtype)


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are, how wide an id is, and per part: number, base, documents, ids."""

    folder: str
    dtype: str
    parts: tuple[tuple[int, int, int, int], ...]

    def documents(self, spark: SparkSession) -> DataFrame:
        """Read back: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
        folder, dtype = self.folder, np.dtype(self.dtype)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    name = f"{folder}/part-{part:05d}"
                    ids, off, doc = mapped(f"{name}.bin", dtype), mapped(f"{name}.off", np.dtype("<i8")), mapped(f"{name}.doc", np.dtype("<i8"))
                    i = 0
                    while i < len(doc):
                        j = max(i + 1, min(len(doc), int(np.searchsorted(off, off[i] + (1 << 19), "right")) - 1))
                        wide = np.asarray(ids[off[i] : off[j]]).astype("<u4")
                        at = (off[i : j + 1] - off[i]) * 4
                        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(wide)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(doc[i:j]), mask=np.asarray(doc[i:j]) == NULL_ID), pa.array(base + off[i:j]), pa.array(np.diff(off[i : j + 1])), values.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        i = j

        rows = [(p, b) for p, b, _, _ in self.parts]
        manifest = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(rows)], "i int, part int, base long").repartitionById(max(1, len(rows)), "i").select("part", "base")
        return manifest.mapInArrow(workers.lean(read), "doc_id long, start long, n_tokens long, ids binary")


def write_tokens(documents: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> TokenFiles:
    """Encode whole texts and write the file set; the tokenizer file's path must exist on every machine."""
    spark = documents.sparkSession
    workers.small_batches(spark)
    folder = folder or scratch.fresh(spark, "tokens")
    rows = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size, least, greatest = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    parts = parts or max(1, -(-size // PART_BYTES), min(most, size // LEAST_BYTES))
    ranges, steps = min(parts, CUTS), -(-parts // min(parts, CUTS))
    parts = ranges * steps
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    bounds = np.array(sorted(cuts) if ranges > 1 else [], np.int64)
    edges = np.concatenate([[least], bounds, [greatest]]).astype(np.float64)
    dtype = Encoder(tokenizer, 0).dtype

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for c in bytescan.chunks(batch.column(1)):
                n = c.last - c.first
                doc = batch.column(0).slice(c.first, n)
                texts = [c.text(i) for i in range(n)]
                ids = [encoder.encode(t) + end for t in texts]
                order = np.array([zlib.crc32(t) for t in texts], np.int64)
                at = doc.to_numpy(zero_copy_only=False)
                lo, hi = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
                # Documents that share an id are dealt by ranges of their hash, so part order stays document order.
                part = lo + order * (hi - lo + 1) // (1 << 32)
                if steps > 1:
                    step = np.minimum((at - edges[part]) / np.maximum(edges[part + 1] - edges[part], 1) * steps, steps - 1).astype(np.int64)
                    part = part * steps + np.where(lo == hi, step, np.where(part == lo, steps - 1, 0))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), doc, pa.array(order), pa.array(ids, pa.binary())], ["part", "doc_id", "hash", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sinks, total, offsets = None, None, 0, []

        def close() -> pa.RecordBatch:
            np.array(offsets, "<i8").tofile(sinks[1].file) if _local(folder) else sinks[1].file.write(np.array(offsets, "<i8").tobytes())
            for s in sinks:
                s.close()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(offsets) - 1], pa.int64()), pa.array([total], pa.int64())], ["part", "n_documents", "n_tokens"])

        for batch in batches:
            part = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if part[a] != now:
                    if sinks:
                        yield close()
                    now, total, offsets = int(part[a]), 0, [0]
                    sinks = [_Sink(f"{folder}/part-{now:05d}.{x}") for x in ("bin", "off", "doc")]
                ids = batch.column(3).slice(a, b - a)
                for x in ids:
                    data = x.as_buffer()
                    sinks[0].file.write(data)
                    total += data.size // dtype.itemsize
                    offsets.append(total)
                sinks[2].file.write(batch.column(1).slice(a, b - a).to_numpy().astype("<i8").tobytes())
        if sinks:
            yield close()

    placed = rows.mapInArrow(workers.lean(encode, "encoder"), "part int, doc_id long, hash long, ids binary").repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "hash", "ids")
    made = sorted(placed.mapInArrow(workers.lean(write, "encoder"), "part int, n_documents long, n_tokens long").collect())
    bases = np.concatenate([[0], np.cumsum([r.n_tokens for r in made])]).astype(int).tolist()
    return TokenFiles(folder, dtype.str, tuple((r.part, base, r.n_documents, r.n_tokens) for r, base in zip(made, bases)))


def token_table(documents: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files, and read back per document: doc_id, start, n_tokens, ids_crc32."""
    files = write_tokens(documents, tokenizer, **options)
    return files.documents(documents.sparkSession).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
