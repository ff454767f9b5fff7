import random

import numpy as np
import pyarrow as pa

from tests.llm.helpers import ODD, WORD, lower
from weftgraph.llm.words import BY_SPACE, LETTERS_OR_SIGNS, LOWER, shingles, text_slices, words


def texts():
    r = random.Random(1)
    return [t for _, t, *_ in ODD] + ["".join(r.choice("ab \n\t.é") for _ in range(r.randrange(40))) for _ in range(200)]


def test_words_and_hashes_agree_with_a_plain_split():
    col, seen = texts(), {}
    for size in (1, 50, 1 << 20):
        got = [None] * len(col)
        for w in words(pa.array(col), BY_SPACE, LOWER, size):
            h = w.hashes()
            for i in range(w.last - w.first):
                a, b = w.ptr[i], w.ptr[i + 1]
                got[w.first + i] = [bytes(w.data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])]
                for word, x in zip(got[w.first + i], h[a:b]):
                    assert seen.setdefault(word, x) == x
        assert got == [WORD.findall(lower(t)) for t in col]
    assert len(set(seen.values())) == len(seen)


def test_kinds_part_letters_from_signs():
    (w,) = words(pa.array(["of%%% the&&& a|b"]), LETTERS_OR_SIGNS)
    assert [bytes(w.data[s:e]).decode() for s, e in zip(w.starts, w.ends)] == ["of", "%%%", "the", "&&&", "a", "|", "b"]


def test_prefix_hash_is_the_hash_of_the_prefix():
    (w,) = words(pa.array(["abcdefgh abcd"]))
    assert w.hashes(4)[0] == w.hashes()[1]


def test_shingles_by_row():
    col = ["a b c d e f", "a b", "", "b c d e f", "a b"]
    (w,) = words(pa.array(col))
    runs, ptr = shingles(w.hashes(), w.ptr, 5, short=True)
    assert np.diff(ptr).tolist() == [2, 1, 0, 1, 1]
    assert runs[1] == runs[3] and runs[2] == runs[4] and runs[0] != runs[1]
    runs, ptr = shingles(w.hashes(), w.ptr, 5, short=False)
    assert np.diff(ptr).tolist() == [2, 0, 0, 1, 0]


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(texts())], ["text"])
    got = [t for x in text_slices(batch, slice_bytes=30) for t in x.column("text").to_pylist()]
    assert got == texts()
