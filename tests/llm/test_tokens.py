"""Token counts and token records against the libraries, called plainly on whole texts."""

import os
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from papertrail.llm import counts, records
from papertrail.llm.coder import tokenizer_path, word_coder

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORDS, PIECES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = st.text(st.sampled_from(list(" \n\t \x1c'.,<|>aBzZ19é́̌İK▁中😀")) | st.characters(exclude_categories=["Cs"]))


@lru_cache
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORDS)


def plain(text):
    return library().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_word_ids(text):
    coder = word_coder(WORDS)
    assert np.frombuffer(coder.encode(text.encode()), coder.kind).tolist() == plain(text)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_piece_counts(text):
    assert sum(counts.count_pieces(PIECES, counts.pre_tokens(text))) == len(counts.pieces(PIECES).encode(text))


def test_word_cache_is_bounded():
    coder = type(word_coder(WORDS))(WORDS, limit=10)
    for i in range(100):
        coder.encode(f"w{i}x".encode())
    assert len(coder) <= 13


@pytest.mark.parametrize("head", [0, 3, 1 << 16])
def test_token_counts(spark, odd, head):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit)
                 for r in counts.token_counts(odd, PIECES, limit=1000, head=head).collect())
    sp = counts.pieces(PIECES)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 1000)
                  for r in odd.collect())
    assert got == want


def test_token_counts_query(spark, sf_dir, small):
    got = {r.doc_id: r.n_tokens for r in counts.op5_token_counts(spark, sf_dir).collect()}
    assert got == {i: len(counts.pieces(PIECES).encode(t)) for i, t in small}


def brute(rows):
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain(t) + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


def test_records(spark, odd):
    written = records.write_records(odd, WORDS, 2)
    got = [tuple(r) for r in records.read_records(spark, written).orderBy("start").collect()]
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_records_query(spark, sf_dir, small):
    assert [tuple(r) for r in records.op6_token_records(spark, sf_dir).orderBy("start").collect()] == brute(small)


def test_index_seeks_to_any_record(spark, odd):
    import pyarrow.fs as pafs
    written = records.write_records(odd, WORDS, 2)
    fs, root = pafs.FileSystem.from_uri(written.folder)
    for r in written.index(spark).collect():
        with fs.open_input_file(f"{root}/data/{r.file}") as f:
            f.seek(r.position)
            _, payload = next(records.frames(f))
            doc_id, ids = records.decode(payload, written.width)
            assert doc_id == r.doc_id and len(ids) == r.n_tokens and ids[-1] == 2


def test_damage_is_found():
    import io
    data = bytearray(records.frame(b"\x01" + b"12345678" + b"abcd"))
    assert [p for _, p in records.frames(io.BytesIO(bytes(data)))] == [b"\x0112345678abcd"]
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            list(records.frames(io.BytesIO(bytes(broken))))


def test_empty_table(spark, empty):
    assert counts.token_counts(empty, PIECES).collect() == []
    assert records.read_records(spark, records.write_records(empty, WORDS, 2)).collect() == []
