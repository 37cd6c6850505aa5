import hashlib
import random
import zlib

import numpy as np
import pytest

from custlattice.llm import sharding

from .conftest import ODD, prose


def plain_least_capacity(sizes, shards):
    """Smallest largest shard of several groups, by trying all capacities that a run of groups can have."""

    def shards_needed(capacity):
        n, held = 0, None
        for s in sizes:
            if held is None or held + s > capacity:
                n, held = n + 1, s
            else:
                held += s
        return n

    runs = sorted({0} | {sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 2, len(sizes) + 1)})
    return next(c for c in runs if shards_needed(c) <= shards)


def asker(starts, calls):
    def ask(ranges, width):
        calls.append(len(ranges))
        out = []
        for r, (a, b) in enumerate(ranges):
            cells = {}
            for x in starts:
                if a < x < b:
                    cells.setdefault(x // width, []).append(x)
            out += [(r, c[0], c[-1], len(c)) for c in cells.values()]
        return tuple(np.array(out, dtype=np.int64).reshape(-1, 4).T)

    return ask


@pytest.mark.parametrize("seed", range(40))
def test_cuts_are_minimal(seed, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 16)  # few known starts, so many rounds
    rng = random.Random(seed)
    sizes = [rng.choice((8, 9, rng.randrange(8, 40), rng.randrange(8, 3000))) for _ in range(rng.randrange(1, 90))]
    if seed % 3 == 0:
        sizes[rng.randrange(len(sizes))] = sum(sizes)
    starts = np.cumsum([0, *sizes]).tolist()
    shards, calls = rng.choice((1, 2, 5, 24)), []
    cuts = sharding.minimax(starts[-1], shards, asker(starts[:-1], calls))
    assert cuts[0] == 0 and cuts[-1] == starts[-1] and len(cuts) == shards + 1 and set(cuts) <= set(starts)
    several = [b - a for a, b in zip(cuts, cuts[1:]) if sum(a <= s < b for s in starts[:-1]) > 1]
    assert max(several, default=0) <= plain_least_capacity(sizes, shards)
    if len(sizes) >= shards:
        assert all(a < b for a, b in zip(cuts, cuts[1:]))


def check(texts, rows, shards):
    assert sorted(r.doc_id for r in rows) == sorted(range(len(texts)))
    groups, slots, total = {}, {}, {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        groups.setdefault(raw, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        total[r.shard] = total.get(r.shard, 0) + r["size"]
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    sizes = {}
    for r in rows:
        key = hashlib.md5((texts[r.doc_id] or "").encode()).digest()
        sizes[key] = sizes.get(key, 0) + r["size"]
    least = plain_least_capacity([sizes[k] for k in sorted(sizes)], shards)
    number = {}
    for raw, at in groups.items():
        number.setdefault(min(at), []).append(raw)
    assert all(total[s] <= least for s, held in number.items() if len(held) > 1)
    return total


def test_matches_brute_force(spark, docs_of):
    rng = random.Random(2)
    texts = [prose(i, rng.randrange(1, 300)) for i in range(150)] + ODD + [prose(3, 200)] * 60
    total = check(texts, sharding.sharded(docs_of(texts).repartition(7), 6).collect(), 6)
    assert len(total) == 6


def test_few_groups_and_empty_table(spark, docs_of):
    docs = docs_of(["a b", "a b", None, ""])
    rows = sharding.sharded(docs, 4).collect()
    check(["a b", "a b", None, ""], rows, 4)
    assert sharding.sharded(docs.limit(0)).collect() == []


def test_written_shards_hold_the_rows(spark, docs_of, tmp_path):
    docs = docs_of([prose(i, 1 + i % 40) for i in range(80)] + [None, ""] + [prose(1, 30)] * 20)
    folder = str(tmp_path / "shards")
    sharding.write_shards(docs, folder, 5)
    found = spark.read.parquet(folder)
    assert sorted(found.drop("shard").columns) == sorted(docs.columns)
    key = lambda r: (r.doc_id, r.text)
    assert sorted(map(key, found.collect()), key=str) == sorted(map(key, docs.collect()), key=str)
    assert {(r.doc_id, r.shard) for r in found.collect()} == {(r.doc_id, r.shard) for r in sharding.sharded(docs, 5).collect()}
