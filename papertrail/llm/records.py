"""Token-id output as framed binary records with an offset index.

A data file is a row of records: ``length`` (8 bytes, little-endian), masked checksum of the length (4 bytes), payload,
masked checksum of the payload (4 bytes).  A checksum is crc32 rotated right by 15 bits plus a constant, so that a
checksum of data holding checksums stays useful.  The payload is one flag byte (1: the id is present), the document's id
(8 bytes, signed) and its token ids as unsigned 16-bit integers (32-bit for a vocabulary beyond 65,536).

The index is a Parquet table of its own: one row per record (doc_id, file, position, length, first token in the file,
number of tokens), so a shuffled read seeks to any record.  Files carry ascending doc_ids, within and across.

Defined results: a null text is the empty text (one id, the end); a null doc_id comes first and stays null; rows with the
same doc_id are all kept, in order of their texts; an empty table gives an empty index and no rows; further columns are
not read.  A task that is run again writes files of new names, and the index holds those of the run that succeeded.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from papertrail.llm.coder import tokenizer_path, word_coder
from papertrail.llm.common import partitions, table, texts, utf8
from papertrail.session import shared_dir

_MASK = 0xA282EAD8
_HEAD, _SUM, _ID = "<QI", "<I", "<Bq"
_HEAD_SIZE, _SUM_SIZE, _ID_SIZE = 12, 4, 9
_INDEX = "doc_id long, file string, position long, length long, file_start long, n_tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack(_SUM, masked(length)), payload, struct.pack(_SUM, masked(payload))))


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(position, payload) of each record; raises where a checksum or a length does not hold."""
    position = 0
    while head := stream.read(_HEAD_SIZE):
        if len(head) < _HEAD_SIZE or struct.unpack(_HEAD, head)[1] != masked(head[:8]):
            raise ValueError(f"damaged record length at byte {position}")
        size = struct.unpack(_HEAD, head)[0]
        body = stream.read(size + _SUM_SIZE)
        if len(body) < size + _SUM_SIZE or struct.unpack(_SUM, body[size:])[0] != masked(body[:size]):
            raise ValueError(f"damaged record at byte {position}")
        yield position, body[:size]
        position += _HEAD_SIZE + size + _SUM_SIZE


def decode(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one record."""
    there, doc_id = struct.unpack_from(_ID, payload)
    return (doc_id if there else None), np.frombuffer(payload, f"<u{width}", offset=_ID_SIZE)


@dataclass(frozen=True)
class RecordFiles:
    """What a write left: the folder, the bytes of an id, and the offset index as a table."""

    folder: str
    width: int
    index_path: str

    def index(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_INDEX).parquet(self.index_path)


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
                  files: int | None = None) -> RecordFiles:
    """Encode every text and write it; one shuffle, by ranges of doc_id."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "records")
    width = word_coder(tokenizer).kind.itemsize

    def write(batches):
        coder, out = word_coder(tokenizer), None
        end = np.array([end_id], coder.kind).tobytes()
        fs, base = pafs.FileSystem.from_uri(folder)
        name, position, start = f"part-{uuid.uuid4().hex}.rec", 0, 0
        try:
            for batch in batches:
                data, at = utf8(batch.column("text"))
                rows = []
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    ids = coder.encode(data[at[i]:at[i + 1]].tobytes(), end)
                    record = frame(struct.pack(_ID, doc_id is not None, doc_id or 0) + ids)
                    if out is None:
                        fs.create_dir(f"{base}/data", recursive=True)
                        out = fs.open_output_stream(f"{base}/data/{name}")
                    out.write(record)
                    n = len(ids) // width
                    rows.append((doc_id, name, position, len(record), start, n))
                    position, start = position + len(record), start + n
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(zip(*rows))],
                        ["doc_id", "file", "position", "length", "file_start", "n_tokens"])
        finally:
            if out is not None:
                out.close()

    index_path = f"{folder}/index"
    texts(docs).repartitionByRange(files or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text") \
        .mapInArrow(write, _INDEX).write.parquet(index_path)
    return RecordFiles(folder, width, index_path)


def read_records(spark: SparkSession, written: RecordFiles) -> DataFrame:
    """Every record of the files, checked, with the number of ids before it over all files."""
    per_file = written.index(spark).groupBy("file").agg(
        F.sum("n_tokens").alias("tokens"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"))
    # One row per file: file sizes are set by the writer, so this window holds files, not documents.
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    based = per_file.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    folder, width = written.folder, written.width

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                rows, start = [], base
                with fs.open_input_stream(f"{root}/data/{name}") as stream:
                    for _, payload in frames(stream):
                        doc_id, ids = decode(payload, width)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return based.repartition(partitions(spark), "file").mapInArrow(read, _READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                      ["doc_id", "start", "n_tokens", "ids_crc32"])


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_records(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_records(spark, written)
