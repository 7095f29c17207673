"""SentencePiece ids of a BPE model against the library's own."""

from __future__ import annotations

import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from pitchfold.llm import viterbi_pieces

from .helpers import SF, documents
from .test_tokens import ODD

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(ODD | st.text(max_size=60) | st.text(alphabet="abeinrst▁ ", max_size=400))
def test_bpe_ids_equal_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert viterbi_pieces.pieces(PIECES).encode(text).tolist() == LIBRARY.encode(text)


def test_bpe_ids_of_documents_equal_the_library():
    model = viterbi_pieces.pieces(PIECES)
    for text in documents(SF.replace("0.001", "0.01"))["text"].dropna().tolist()[:400] + ["x" * 200_000, "internationalisation" * 500 + " 中文𝄞" * 100, "a  b   c    "]:
        assert model.encode(text).tolist() == LIBRARY.encode(text)
        assert model.decode(model.encode(text)) == text.replace(viterbi_pieces.MARK, " ")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abeinrst▁é中\n", max_size=300), st.integers(1, 30))
def test_the_stream_needs_no_cuts(text, step):
    """The search over a whole text, in parts of any length and without look-ups, gives the library's ids."""
    marked = viterbi_pieces.MARK + text.replace(" ", viterbi_pieces.MARK)
    model = viterbi_pieces.pieces(PIECES)
    streamed = [i for run in model.stream(marked[k : k + step] for k in range(0, len(marked), step)) for i in run]
    assert streamed == (LIBRARY.encode(text) if text else [model.table[viterbi_pieces.MARK][1]])


def test_whole_documents_stream_in_a_bounded_window():
    """Of each document, the characters that are held at any time are a few times the longest piece."""
    model = viterbi_pieces.pieces(PIECES)
    for text in documents()["text"].dropna().tolist()[:60]:
        marked = viterbi_pieces.MARK + text.replace(" ", viterbi_pieces.MARK)
        fed = held = 0

        def characters(marked=marked):
            nonlocal fed
            for c in marked:
                fed += 1
                yield c

        ids: list[int] = []
        done = 0
        for run in model.stream(characters()):
            held = max(held, fed - done)
            ids += run
            done = len(b"".join(map(model.bytes.__getitem__, ids[-200:])).decode("utf-8", "ignore")) if len(ids) < 200 else done + len(b"".join(map(model.bytes.__getitem__, run)).decode("utf-8", "replace"))
        assert text == "" or ids == LIBRARY.encode(text)
        assert held <= 6 * model.longest


def test_each_prefix_has_one_open_path():
    """What the search rests on: of all pieces that end at a position, one follows the path before it."""
    model = viterbi_pieces.pieces(PIECES)
    for word in ("▁internationalisation", "▁Straße", "▁aaaaabbbb", "ing.(foo)", "▁▁▁x"):
        last: list[str] = [""]
        for end in range(1, len(word) + 1):
            fits = [word[k:end] for k in range(max(0, end - model.longest), end) if word[k:end] in model.order and model.merged(last[k] + word[k:end]) == [x for x in (last[k], word[k:end]) if x]]
            assert len(fits) == 1
            last += fits


def test_array_steps_equal_the_one_by_one_search():
    """Short units of a whole table, and made-up ones with odd characters, side by side and each for itself."""
    model = viterbi_pieces.pieces(PIECES)
    rng = random.Random(1)
    units = {(" " + w).encode() for t in documents()["text"].dropna() for w in t.split(" ")}
    units |= {"".join(rng.choice(" abcdeéß中𝄞\x00\n<x") for _ in range(rng.randrange(1, 8))).encode() for _ in range(3000)}
    units = sorted(u for u in units if 0 < len(u) <= 16)
    together = model.steps.search(units)
    alone = [model.search(u.decode().replace(" ", viterbi_pieces.MARK)) for u in units]
    assert all(a is None or a.tolist() == b for a, b in zip(together, alone))
    assert sum(a is not None for a in together) > 0.5 * len(units)
    assert [a.tolist() for a in model._learn(units)] == alone
    assert model.steps.search([]) == []
