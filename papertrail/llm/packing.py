"""Lexical retrieval packing: sequences of a fixed length, filled with documents that resemble each other.

1. Every text is tokenized; its ids, and two min-hashes over its distinct ids, go to a table in the shared folder.
2. How many documents hold each id is counted over all documents (at most one number per vocabulary entry).
3. Documents are dealt out in ranges of (first min-hash, second min-hash, doc_id): texts with much in common lie together,
   and copies beyond a task's share go on in the next.  A task takes them in shards of bounded size and builds a BM25
   inverted index of each.  The next unused document seeds a window; its best unused neighbours fill it, best first, as
   far as they fit whole.  What space remains takes the beginning of the best neighbour left, whose rest stays in the
   index.  Only a task's last window is short.

A document longer than a window fills windows of its own, and its rest is treated like a document.

Defined results: a null or empty text has one token, the end; null doc_ids are kept and null; rows with one doc_id are
packed one by one; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail.llm import scan
from papertrail.llm.coder import tokenizer_path, word_coder
from papertrail.llm.common import cut, partitions, table, texts, utf8

WINDOW = 4096
#: A shard is closed at so many documents or tokens; an index of one is some 20 MB.
SHARD_DOCS, SHARD_TOKENS = 1024, 1_500_000
#: Words a generation of a worker's cache holds, beside its shard.
CACHED_WORDS = 250_000
#: Most terms of a seed that are looked up: all of them.
QUERY_TERMS = None
_K1, _B = 1.2, 0.75
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids as bytes, and two min-hashes of the set of ids."""
    def encode(batches):
        coder = word_coder(tokenizer, CACHED_WORDS)
        end = np.array([end_id], coder.kind).tobytes()
        rank = scan.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) >> np.uint64(33)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            rows = [coder.encode(data[at[i]:at[i + 1]].tobytes(), end) for i in range(len(at) - 1)]
            near = np.zeros((len(rows), 2), np.int64)
            for i, ids in enumerate(rows):
                h = rank[np.frombuffer(ids, coder.kind)[:-1] & 0xFFFF]
                if len(h):
                    near[i, 0] = least = h.min()
                    h = h[h > least]
                    near[i, 1] = h.min() if len(h) else least
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.binary()), pa.array(near[:, 0]), pa.array(near[:, 1])],
                ["doc_id", "ids", "near1", "near2"])

    return texts(docs).mapInArrow(encode, "doc_id long, ids binary, near1 long, near2 long")


def document_frequencies(tokens: DataFrame, kind: str, vocabulary: int) -> tuple[np.ndarray, int, float]:
    """(documents with each id, documents, mean length)."""
    def count(batches):
        seen, n, total = np.zeros(vocabulary, np.int64), 0, 0
        place = np.zeros(vocabulary, np.int32)
        for batch in batches:
            data, at = _binary(batch.column("ids"))
            number = np.arange((int(np.diff(at).max()) if len(at) > 1 else 0) // data[:0].view(kind).itemsize, dtype=np.int32)
            each = [_different(data[i:j].view(kind), place, number) for i, j in zip(at[:-1], at[1:])]
            if each:
                seen += np.bincount(np.concatenate(each), minlength=vocabulary)
                n, total = n + len(each), total + int(at[-1] - at[0]) // data[:0].view(kind).itemsize
        if n:
            terms = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(terms, [-1, -2])), pa.array(np.append(seen[terms], [n, total]))], ["term", "n"])

    rows = tokens.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")) \
        .toArrow().to_pandas()  # at most one row per vocabulary entry
    got = dict(zip(rows["term"].tolist(), rows["n"].tolist()))
    n, total = got.pop(-1, 0), got.pop(-2, 0)
    df = np.zeros(vocabulary)
    df[list(got)] = list(got.values())
    return df, n, total / max(n, 1)


def _different(ids: np.ndarray, place: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The ids, each once: where it stands last.  ``place`` is scratch, one entry per id; ``number`` counts from 0."""
    number = number[:len(ids)]
    place[ids] = number
    return ids[place[ids] == number]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


class Shard:
    """BM25 inverted index of some documents."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, tf = zip(*(np.unique(x, return_counts=True) for x in ids))
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
        term, count = np.concatenate(terms), np.concatenate(tf).astype(np.float32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(self.first))
        length = np.repeat(np.array([_K1 * (1 - _B + _B * len(x) / mean) for x in ids], np.float32), np.diff(self.first))
        weight = idf.astype(np.float32)[term] * count * np.float32(_K1 + 1) / (count + length)
        self.term, self.n = term, len(ids)
        order = np.argsort(term, kind="stable")
        self.docs, self.scores = doc[order], weight[order]
        used, at = np.unique(term[order], return_index=True)
        self.place = dict(zip(used.tolist(), zip(at.tolist(), np.append(at[1:], len(order)).tolist())))

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents by falling score against all terms of the seed; only those that share one."""
        spans = [self.place[t] for t in self.term[self.first[seed]:self.first[seed + 1]].tolist()]
        if not spans:
            return np.empty(0, np.int64)
        score = np.bincount(np.concatenate([self.docs[a:b] for a, b in spans]),
                            np.concatenate([self.scores[a:b] for a, b in spans]), self.n)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Windows of one task.  A piece is (document, start, length, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.filled = window, first_sequence, 0
        self.whole = first_sequence + (1 << 39)  # numbers of windows that one document fills

    def pack(self, lengths: list[int], shard: Shard) -> list[tuple[int, int, int, int, int]]:
        """Pieces of all documents of a shard; a window that is still open goes on with the next shard."""
        window, pieces = self.window, []
        size, start = np.array(lengths, np.int64), np.zeros(len(lengths), np.int64)
        for d in np.flatnonzero(size >= window).tolist():
            n = int(size[d] // window)
            pieces += [(d, i * window, window, self.whole + i, 0) for i in range(n)]
            self.whole += n
            start[d], size[d] = n * window, size[d] - n * window
        left = deque(np.flatnonzero(size).tolist())
        while left:
            seed = best = left.popleft()
            ranked = None
            while best is not None and size[best]:
                take = int(min(size[best], window - self.filled))
                pieces.append((best, int(start[best]), take, self.sequence, self.filled))
                start[best] += take
                size[best] -= take
                self.filled += take
                if self.filled == window:
                    self.sequence, self.filled = self.sequence + 1, 0
                    break
                ranked = shard.neighbours(seed) if ranked is None else ranked
                ranked = ranked[size[ranked] > 0]
                fits = ranked[size[ranked] <= window - self.filled]
                best = int(fits[0]) if len(fits) else int(ranked[0]) if len(ranked) else None
            if size[seed]:
                left.appendleft(seed)
        return pieces


def packed(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's token ids as an array."""
    spark = docs.sparkSession
    coder = word_coder(tokenizer, CACHED_WORDS)
    kind, vocabulary = coder.kind.str, max(coder.tokenizer.get_vocab_size(), end_id + 1)
    tokens = cut(tokenized(docs, tokenizer, end_id), "token-ids")
    df, n_docs, mean = document_frequencies(tokens, kind, vocabulary)
    sent = spark.sparkContext.broadcast((np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), mean))

    def pack(batches):
        idf, mean_ = sent.value
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        rows, ids, total = [], [], 0
        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                x = np.frombuffer(x, kind)
                rows.append(doc_id)
                ids.append(x)
                total += len(x)
                if len(rows) == SHARD_DOCS or total >= SHARD_TOKENS:
                    yield _pieces(packer.pack([len(i) for i in ids], Shard(ids, idf, mean_)), rows, ids, with_ids)
                    rows, ids, total = [], [], 0
        if rows:
            yield _pieces(packer.pack([len(i) for i in ids], Shard(ids, idf, mean_)), rows, ids, with_ids)

    near = ("near1", "near2", "doc_id")
    return tokens.repartitionByRange(partitions(spark), *near).sortWithinPartitions(*near).select("doc_id", "ids") \
        .mapInArrow(pack, _PIECES + (", ids array<int>" if with_ids else ""))


def _pieces(pieces, rows: list, ids: list[np.ndarray], with_ids: bool) -> pa.RecordBatch:
    cuts = [ids[d][s:s + n].astype("<u4") for d, s, n, _, _ in pieces]
    columns = [[rows[p[0]] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces],
               [zlib.crc32(c.tobytes()) for c in cuts], [len(ids[p[0]]) for p in pieces], [p[3] for p in pieces],
               [p[4] for p in pieces]]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    arrays = [pa.array(c, pa.int64()) for c in columns]
    if with_ids:
        return pa.RecordBatch.from_arrays([*arrays, pa.array([c.astype(np.int32) for c in cuts], pa.list_(pa.int32()))],
                                          [*names, "ids"])
    return pa.RecordBatch.from_arrays(arrays, names)


def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
