import bisect
import random
import zlib

import numpy as np
import tokenizers
from pyspark.sql import functions as F

from custlattice.llm import packing
from custlattice.llm.queries import TOKENIZER

from .conftest import ODD, prose

WEIRD = ["", " ", "a", " a", "a ", "a  b", "a   b", "a \n b", "\n\n a\n", "x<|endoftext|>y z", "it's  don't 'll x", "é è  ß \u200b y",
         "日本 語 テスト", "a\t b", "1 23 4,5", "ª º ʰ ٣ x² Ⅷ", "\u00a0a b\u2003c", "e\u0301 x", "a\u0300b c"]


def model():
    return tokenizers.Tokenizer.from_file(TOKENIZER[0])


def test_ids_are_those_of_tokenizers():
    plain, rng = model(), random.Random(2)
    alphabet = "ab Zé\n\t.,'1 日\u00a0  <|>"
    texts = WEIRD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)]
    own = packing.Tokenizer(*TOKENIZER)
    for t in texts:
        assert own.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)
        assert packing.Tokenizer.whole(own, t) == own.encode(t)


def test_pieces_and_places(spark, docs_of):
    texts = [*ODD, *[prose(s, n) for s, n in enumerate((10, 200, 300, 700, 900, 1500, 20, 30))]]
    plain = model()
    out = packing.packed(docs_of(texts), TOKENIZER).withColumn("crc", F.crc32("ids")).collect()
    rows = {}
    for r in out:
        rows.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, packing.END]
        own = sorted(rows[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert all(r.length == packing.CAPACITY for r in own[1:])
        assert all(r.crc == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length for r in own)
    check_sequences(out)


def check_sequences(rows, capacity=packing.CAPACITY):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity=packing.CAPACITY):
    gaps = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


def test_few_sequences(spark, docs_of):
    rng = random.Random(4)
    docs = docs_of([" ".join("a" for _ in range(rng.randrange(1, 1023))) for _ in range(1500)])
    for rows, slack in ((10_000, 1.005), (400, 1.04)):
        out = packing.packed(docs, TOKENIZER, rows=rows).collect()
        assert check_sequences(out) <= slack * best_fit_decreasing([r.length for r in out]) + 1


def test_choice_has_the_smallest_sum_of_squares():
    rng = random.Random(9)
    bins, gaps = packing.SumOfSquares(20), {}
    for _ in range(400):
        n = rng.randrange(1, 21)
        def total(after):
            counts = {}
            for g in after.values():
                if g:
                    counts[g] = counts.get(g, 0) + 1
            return sum(c * c for c in counts.values())
        options = {g: total(gaps | {next(s for s in gaps if gaps[s] == g): g - n}) for g in set(gaps.values()) if g >= n}
        sequence, offset = bins.place(n)
        if options:
            gap = 20 - offset
            assert options[gap] == min(options.values())
        else:
            assert offset == 0 and sequence not in gaps
        gaps[sequence] = 20 - offset - n


def test_empty_table(spark, docs_of):
    assert packing.packed(docs_of(["a"]).limit(0), TOKENIZER).count() == 0
