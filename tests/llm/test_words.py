import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from custlattice.llm.tokens import LETTER, HashTable, grams, word_slices

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.\x0b日 ", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_split_at_ascii_white_space(texts):
    expected = [(t or "").encode().lower().split() for t in texts]
    got, hashes = [], {}
    for rows, w in word_slices(pa.array(texts, pa.string())):
        for r in range(rows):
            span = range(w.rows[r], w.rows[r + 1])
            got.append([bytes(w.raw[w.start[i] : w.end[i]]) for i in span])
            for i in span:
                hashes.setdefault(got[-1][i - w.rows[r]], set()).add(int(w.hashes[i]))
    assert got == expected
    assert all(len(h) == 1 for h in hashes.values())
    assert len(set.union(set(), *hashes.values())) == len(hashes)


def test_letters_and_grams():
    (_, w), = word_slices(pa.array(["ab1cd ***ef***"]), LETTER)
    assert [bytes(w.raw[a:b]) for a, b in zip(w.start, w.end)] == [b"ab", b"cd", b"ef"]
    (_, w), = word_slices(pa.array(["p q r s", "q r s p"]))
    g = grams(w.hashes, 3)
    assert g[1] == g[4] and len(set(g.tolist())) == 5


def test_hash_table_finds_keys_alone():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    other = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    table = HashTable(keys)
    at, which = table.find(np.concatenate([other, keys]))
    assert at.tolist() == list(range(1000, 2000)) and (table.keys[which] == keys).all()
    assert len(HashTable(keys[:0]).find(keys)[0]) == 0
