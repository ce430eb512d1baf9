import tracemalloc

import numpy as np

from marlstone.llm import suffix_tree_lm as lm
from marlstone.llm._exchange import Distinct, packed


def test_a_chunk_asks_within_its_share_of_memory():
    """What one task holds while a whole chunk of rare words asks: two of them stand beside a full heap."""
    n = lm.CHUNK_BYTES // 6
    words = Distinct(np.random.default_rng(0).integers(0, 1 << 63, n, dtype=np.uint64)[np.random.default_rng(1).integers(0, n, n)])
    row = (0, [1], [False], [n], len(words.keys), words.keys.cut(slice(None)), packed(words.which))
    docs = lm.table_of([row], lm.CHUNK)
    del words
    tracemalloc.start()
    lm.ask(docs, None, lm.route_of(62), (1, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20
