"""Token codes and SentencePiece ids against the libraries and a plain dynamic programme."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pitchfold.llm import queries, token_codes, viterbi_pieces
from pitchfold.llm.token_codes import Encoder, Segment, pack
from pitchfold.llm.unit_memory import UnitMemory

from .helpers import SF, documents, words

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = st.text(alphabet=st.sampled_from(list("ab' \t\n  ᠎\x1f\u0085.1é中𝄞▁<|>")), max_size=40)


def _plain() -> Tokenizer:
    return Tokenizer.from_file(BPE)


def test_codes_of_every_document(spark):
    tokenizer, start = _plain(), 0
    got = {r["doc_id"]: r for r in queries.op5_token_codes(spark, SF).collect()}
    docs = documents().sort_values("doc_id")
    assert len(got) == len(docs)
    for doc_id, text in docs[["doc_id", "text"]].itertuples(index=False):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_many_segments_and_partitions(spark, tmp_path):
    docs = spark.createDataFrame([(k, words(k, k % 90)) for k in range(300)], "doc_id bigint, text string").repartition(5)
    path = f"file://{tmp_path}/codes"
    token_codes.write_codes(docs, BPE, path, segment_ids=500)
    index = {r["doc_id"]: r for r in token_codes.document_index(spark, path).collect()}
    segments = {(r["part"], r["seq"]): Segment(bytes(r["payload"])) for r in spark.read.parquet(path).collect()}
    assert len(segments) > 10
    tokenizer, start = _plain(), 0
    for k in range(300):
        ids = [*tokenizer.encode(words(k, k % 90), add_special_tokens=False).ids, 0]
        r = index[k]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        segment = segments[r["part"], r["seq"]]
        assert segment.document(r["position"]).tolist() == ids and segment.doc_ids[r["position"]] == k
        start += len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=5), st.data())
def test_any_id_without_the_ones_before(docs, data):
    segment = Segment(pack([None, *range(len(docs))][: len(docs)], [np.array(d, np.uint32) for d in docs]))
    flat = [x for d in docs for x in d]
    assert segment.n == len(flat)
    assert segment.slice(0, segment.n).tolist() == flat
    for k, d in enumerate(docs):
        assert segment.document(k).tolist() == d
    if flat:
        i = data.draw(st.integers(0, len(flat) - 1))
        j = data.draw(st.integers(i, len(flat)))
        assert segment[i] == flat[i] and segment.slice(i, j).tolist() == flat[i:j]


ENCODER, PLAIN = Encoder(BPE), _plain()


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=6))
def test_encoder_equals_the_library(these):
    assert [x.tolist() for x in ENCODER.encode(pa.array(these))] == [PLAIN.encode(t, add_special_tokens=False).ids for t in these]


PARTS = st.sampled_from([" ", "  ", "\n", "\r\n", "\t", "the", " and", "'s", "'ll", "'", ".", "...", "12", "Å", "é", "ß", "中文", "\xa0", "\u2003", "\u2014", "\x00", "\x1d", "word" * 9, "<|endoftext|>", "<|", "e\u0301", "\u0e01"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.none() | st.lists(PARTS, max_size=12).map("".join), min_size=1, max_size=6))
def test_cuts_are_those_of_the_pattern(these):
    assert [x.tolist() for x in ENCODER.encode(pa.array(these, pa.string()))] == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in these]


def test_added_tokens_are_the_library_s(spark):
    text = "hello <|endoftext|> there"
    assert ENCODER.encode(pa.array([text]))[0].tolist() == [31373, 220, 50256, 612]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "b")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_codes.encode_documents(docs, BPE).collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4"))
    assert got == {1: (0, 5, crc([31373, 220, 50256, 612, 0])), 2: (5, 1, crc([0])), 3: (6, 2, crc([65, 0]))}


def test_small_memory_of_units():
    """Units that push each other out of the table are learned anew."""
    small = Encoder(BPE)
    small.memory = UnitMemory(small._learn, small.dtype, slots=8)
    these = [words(k, 300) for k in range(5)] + ["x" * 100_000, "a b " * 1000]
    for _ in range(2):
        assert [x.tolist() for x in small.encode(pa.array(these))] == [PLAIN.encode(t, add_special_tokens=False).ids for t in these]


def test_a_large_vocabulary_is_remembered():
    """Of 400,000 different units few push each other out of the table."""
    encoder, asked = Encoder(BPE), []
    encoder.memory.learn = lambda units: asked.append(len(units)) or [np.array([int(u) % 50_000], encoder.dtype) for u in units]
    data = np.frombuffer(b"".join(b"%08d" % k for k in range(400_000)), np.uint8)
    starts = np.arange(0, len(data), 8)
    for _ in range(2):
        flat, counts = encoder.memory.lookup(data, starts, np.full(len(starts), 8))
        assert (flat == np.arange(400_000) % 50_000).all() and (counts == 1).all()
    assert asked[0] == 400_000 and asked[1] < 0.2 * 400_000


def test_another_kind_of_tokenizer_gets_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain = Encoder(path), Tokenizer.from_file(path)
    these = ["A  b\nC don't 12", "", words(1, 40)]
    assert not own.usual and [x.tolist() for x in own.encode(pa.array(these))] == [plain.encode(t, add_special_tokens=False).ids for t in these]


MODEL = viterbi_pieces.Pieces(PIECES)


def _best(model: viterbi_pieces.Pieces, text: str) -> float:
    """Score of the best segmentation, by a whole-text dynamic programme."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - model.longest), end):
            found = model.table.get(text[start:end])
            if found:
                best[end] = max(best[end], best[start] + found[0])
        if text[end - 1] not in model.single:
            best[end] = max(best[end], best[end - 1] + model.unknown)
    return best[-1]


def _score(model: viterbi_pieces.Pieces, ids: list[int]) -> float:
    """Score of ids; the bytes of a character count once."""
    total, k = 0.0, 0
    while k < len(ids):
        if model.fallback[ids[k]]:
            lead = model.bytes[ids[k]][0]
            k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            total += model.unknown
        else:
            total += model.table[model.bytes[ids[k]].decode().replace(" ", viterbi_pieces.MARK)][0]
            k += 1
    return total


@settings(max_examples=200, deadline=None)
@given(ODD | st.text(max_size=60))
def test_best_segmentation_and_round_trip(text):
    text = text.encode("utf-8", "replace").decode()
    ids = MODEL.encode(text)
    if text:
        marked = viterbi_pieces.MARK + text.replace(" ", viterbi_pieces.MARK)
        assert abs(_score(MODEL, ids.tolist()) - _best(MODEL, marked)) < 1e-6 * max(1, len(marked)) * 100
    assert MODEL.decode(ids) == text.replace(viterbi_pieces.MARK, " ")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abeinrst▁", max_size=400), st.integers(1, 30))
def test_streaming_equals_whole(text, step):
    streamed = [i for run in MODEL.stream(text[k : k + step] for k in range(0, len(text), step)) for i in run]
    best, back, ids = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1), [0] * (len(text) + 1)
    MODEL._grow(text, 0, len(text), best, back, ids)
    assert streamed == MODEL._path(text, back, ids, len(text))


def test_the_window_is_bounded():
    held = []

    def characters():
        for k in range(3000):
            yield "internationalisation"[k % 20 :][:1]

    for run in MODEL.stream(characters()):
        held.append(len(run))
    assert max(held) < 60


def test_every_document_comes_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    digest = {r["doc_id"]: r for r in queries.op8_viterbi_pieces(spark, SF).collect()}
    encoded = viterbi_pieces.encode_documents(docs, PIECES)
    decoded = {r["doc_id"]: r["text"] for r in viterbi_pieces.decode_documents(encoded, PIECES).collect()}
    for doc_id, text in documents()[["doc_id", "text"]].itertuples(index=False):
        text = text or ""
        assert digest[doc_id]["round_trip"] == (viterbi_pieces.MARK not in text)
        assert decoded[doc_id] == text.replace(viterbi_pieces.MARK, " ")
    for r in encoded.collect():
        assert zlib.crc32(np.array(r["ids"], "<u4")) == digest[r["doc_id"]]["ids_crc32"]


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole number"):
        token_codes.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError, match="ids"):
        viterbi_pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "IDs"))
