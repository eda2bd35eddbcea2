"""The dictionary's suffix order against sorted byte strings."""

import numpy as np
import pytest

from marketflow.llm.prefix_free import LENGTH, suffix_ranks


@pytest.mark.parametrize("letters", [1, 2, 256])
def test_ranks_are_the_byte_order(letters):
    rng = np.random.default_rng(letters)
    text = rng.integers(0, letters, 3000).astype(np.uint8)
    text[1500:2600] = text[200:1300]
    at = rng.permutation(len(text) - LENGTH + 1)[:1800]
    strings = [text[i:i + LENGTH].tobytes() for i in at]
    place = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert suffix_ranks(text, at).tolist() == [place[s] for s in strings]
    assert len(suffix_ranks(text, at[:0])) == 0
