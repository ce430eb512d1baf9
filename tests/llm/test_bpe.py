import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_round_trip(docs, edge):
    out = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(out) == len(edge)
    enc = bpe.encoding(RANKS, PATTERN)
    want = sorted(((d is None, d or 0), enc.encode_ordinary(t or ""), (t or "").encode()) for d, t in edge)
    import numpy as np

    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), np.frombuffer(bytes(r["ids"]), "<u4").tolist(), bytes(r["decoded"])) for r in out)
    assert got == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 '\n\t.,é s　"), max_size=200), st.integers(1, 20))
def test_cuts_change_nothing(text, limit):
    enc = bpe.encoding(RANKS, PATTERN)
    assert "".join(bpe.pieces(text, limit)) == text
    assert bpe.encode_text(text, enc, limit).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 50000, " " * 5000, "don't stop'll"])
def test_hard_texts(text):
    enc = bpe.encoding(RANKS, PATTERN)
    assert enc.decode_bytes(bpe.encode_text(text, enc).tolist()) == text.encode()


def test_empty(none):
    assert bpe.encode(none, RANKS, PATTERN).count() == 0
