"""Properties that need no Spark."""

import base64
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from columnscout.llm import byte_bpe, mixing, set_pairs, shapes

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{byte_bpe.TOKENIZERS}/{byte_bpe.VOCABULARY}"), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoders():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{byte_bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.encoder(f"{byte_bpe.TOKENIZERS}/{byte_bpe.VOCABULARY}"), public


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=200), max_size=4))
def test_any_text_is_encoded_like_the_public_encoder(encoders, texts):
    ours, public = encoders
    flat, at = ours.encode(texts)
    for i, t in enumerate(texts):
        ids = flat[at[i] : at[i + 1]].tolist()
        assert ids == public.encode_ordinary(t) and public.decode(ids) == t


@needs_vocabulary
@settings(max_examples=60, deadline=None)
@given(st.text("ab=é ", min_size=1, max_size=400))
def test_long_way_equals_matrix(encoders, text):
    """A piece encoded one by one and in a matrix has the same ids."""
    ours, _ = encoders
    piece = text.encode()
    out = [None]
    ours._matrix([piece], np.array([0]), out)
    assert out[0].tolist() == ours._long(ours.byte_ids[np.frombuffer(piece, np.uint8)]).tolist()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.sampled_from([0.5, 0.7, 0.85, 1.0]))
def test_difference_bound(a, b, t):
    """Sets of a and b tokens that are similar enough differ in at most `differ` tokens, and in exactly that at the least overlap."""
    s, n = min(a, b), max(a, b)
    if s < t * n:
        return
    lengths = set_pairs.Lengths(t, 1, n)
    least = next(o for o in range(n + 1) if o >= t * (s + n - o) - 1e-9)
    assert int(lengths.differ(np.array(s), np.array(n))) == s + n - 2 * least
    assert lengths.starts[lengths.range_of(s)] <= s < lengths.starts[lengths.range_of(s) + 1]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_units_are_the_whole_text(text):
    s = shapes.shapes([text, text])
    assert s.length.sum() == 2 * len(text.replace("\r\n", "\n").replace("\r", "\n")) and s.again.dtype == bool


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 10**6), st.integers(1, 8), st.floats(0.01, 1)), min_size=1))
def test_quotas_keep_the_limits(x):
    total = sum(w for _, _, w in x.values())
    parts = mixing.quotas({s: w / total for s, (_, _, w) in x.items()}, {s: (n, 1) for s, (n, _, _) in x.items()}, {s: r for s, (_, r, _) in x.items()})
    size = sum(p.passes * p.tokens + p.rest for p in parts)
    for p in parts:
        used = p.passes * p.tokens + p.rest
        assert used <= x[p.source][1] * p.tokens
        assert abs(used - p.weight * size) <= len(parts) + 1
