"""Token ids as ORC: run-length encoded integers, row indexes, a Bloom filter on doc_id, files in ascending doc_id order.

Documents are encoded where they are read and dealt out by ranges of doc_id, so only compressed ids are shuffled. A
file holds one range; each row has its start inside the file, and the few file totals give the start in the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import new_path
from heddle.llm.tokens import Encoder, encoder, slices

#: At most so many files; their boundaries and totals are all that the driver sees.
MAX_FILES = 65536
DOCS_A_FILE = 8192


def _width(library: Encoder, end_id: int) -> int:
    """Bytes of an id on the way to its file."""
    return 2 if max(end_id, library.largest) < 1 << 16 else 4


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int, docs_a_file: int = DOCS_A_FILE) -> None:
    """docs: doc_id long, text. Writes ORC rows (file int, doc_id, start long, n_tokens long, ids array<int>) under path.

    `start` counts the ids before the document in its file. Each document gets `end_id` appended; a null text is
    empty. Documents with a null doc_id come first; rows with equal doc_id stand in the order of their ids' length
    and bytes. An empty table writes a folder without rows. Other columns of docs are not read.
    """
    n = docs.count()
    files = max(1, min(MAX_FILES, math.ceil(n / docs_a_file)))
    cuts = np.zeros(0, dtype=np.int64)
    if files > 1:
        found = docs.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)], max(10_000, 20 * files))).head()[0]
        cuts = np.unique(np.array(found or [], dtype=np.int64))
    files = len(cuts) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        width = f"<u{_width(library, end_id)}"
        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                doc = part.column("doc_id")
                where = np.searchsorted(cuts, np.asarray(doc.fill_null(-(2**63))), "right").astype(np.int32)
                ids, ends = library.encode(part.column("text"), end_id)
                ids = ids.astype(width)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.record_batch([pa.array(where), doc, pa.array(np.diff(ends)), packed], ["file", "doc_id", "n_tokens", "packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, base = f"<u{_width(encoder(tokenizer), end_id)}", 0
        for batch in batches:
            for part in slices(batch, "packed", 2 << 20):
                n = np.asarray(part.column("n_tokens"))
                ids = np.frombuffer(b"".join(part.column("packed").to_pylist()), width).astype(np.int32)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.record_batch([part.column("file"), part.column("doc_id"), pa.array(base + ends - n), pa.array(n), lists], ["file", "doc_id", "start", "n_tokens", "ids"])
                base += int(ends[-1]) if len(ends) else 0

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(encode, "file int, doc_id bigint, n_tokens bigint, packed binary")
        .repartitionById(files, F.col("file"))
        .sortWithinPartitions("doc_id", "n_tokens", "packed")
        .mapInArrow(unpack, "file int, doc_id bigint, start bigint, n_tokens bigint, ids array<int>")
        .write.option("compression", "zstd")
        .option("orc.stripe.size", 16 << 20)
        .option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


SCHEMA = "file int, doc_id bigint, start bigint, n_tokens bigint, ids array<int>"


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a token file with `start` counted over the whole corpus; a filter on doc_id reaches the ORC reader."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = sorted((r["file"], r["n"]) for r in rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())  # MAX_FILES rows at most
    ends = np.cumsum([n for _, n in totals]).tolist()
    bases = spark.createDataFrame([(f, e - n) for (f, n), e in zip(totals, ends, strict=True)], "file int, base bigint")
    return rows.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents: stripes are pruned by their statistics and Bloom filters."""
    return read_token_file(spark, path).where(F.col("doc_id").isin(doc_ids))


def ids_crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, cut = np.asarray(ids.values, "<u4"), np.asarray(ids.offsets)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the token file of docs in the shared folder, reads it back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_file(docs, path, tokenizer, end_id)
    return read_token_file(docs.sparkSession, path).mapInArrow(ids_crc32, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
