"""SimHash near-duplicates by anchor-point covering.

A fingerprint has two halves of 32 bits. Two fingerprints at distance 4 or less have a half at distance 2 or less. On a half, anchors
are the words of a linear code of covering radius 4: the perfect Golay code on 23 bits, a perfect Hamming code on 7 bits
and 2 bits as they are. Two halves at distance d have a point m halfway, at most ceil(d / 2) from both, and m has an anchor within the covering
radius; so it is enough to replicate a half to all anchors within radius 4 + 1, about 15 of 2^18, and every pair within
the threshold meets at an anchor. There whole fingerprints are compared.

Texts of a similarity of 0.8 differ in about 15 % of the bits, far more than such a threshold. `without_similar` therefore takes a fingerprint of
PIECES pieces of 32 bits, replicates each piece to its anchors, and compares whole fingerprints of those that are near in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlattice.llm.components import components
from custlattice.llm.staging import staged
from custlattice.llm.tokens import WORD, grams, mix, text_bytes, word_slices

SHINGLE = 4
THRESHOLD = 4
COVERING_RADIUS = 4
HALF_BITS = 32
#: Pieces of a long fingerprint, words of its shingles, bits that one piece and the whole may differ in. At a Jaccard similarity of 0.8 of two texts' shingles
#: 77 of 512 bits differ, with a deviation of 8, and a piece is near with a chance of 0.12; at 0.9 it is 0.34; 92 bits are a similarity of 0.73.
PIECES = 16
WORDS = 5
PIECE_THRESHOLD = 2
LONG_THRESHOLD = 92
#: Steps in which groups of near pieces that share pieces become one.
MERGES = 3
#: Members of an anchor compared by one task; an anchor with more is split into pairs of chunks.
CHUNK = 8192
#: Pairs of whole fingerprints compared at once.
PAIRS = 1 << 16


def fingerprint(text: bytes) -> int:
    """Majority of the bits of the XXH64 (seed 42) of all 4-word shingles, repeats included; no words: zero."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(w), seed=42)
    joined = b" ".join(w)
    end = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    last = end[SHINGLE - 1 :].tolist()
    first = [0, *(end[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(last))
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(text: pa.Array) -> pa.Array:
    raw, off = text_bytes(text)
    data = memoryview(raw)
    fp = [fingerprint(bytes(data[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return pa.array(np.array(fp, dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, fp): one row per document; copy is a hash of the text, fp the fingerprint as a signed 64-bit number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("copy"), F.arrow_udf(_fingerprints, "bigint")(text).alias("fp"))


class AnchorCode:
    """The code's parity checks, and for each syndrome the error patterns of weight up to `radius`."""

    def __init__(self, radius: int):
        golay = [0] * 23
        rest = 1
        for i in range(23):  # x^i modulo the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
            golay[i] = rest
            rest <<= 1
            if rest >> 11:
                rest ^= 0b101011100011
        checks = golay + [(i + 1) << 11 for i in range(7)] + [0, 0]
        self.bytes = np.zeros((4, 256), dtype=np.uint32)
        for bit, check in enumerate(checks):
            values = np.arange(256)
            self.bytes[bit // 8] ^= np.where(values >> (bit % 8) & 1, check, 0).astype(np.uint32)
        level, patterns = np.zeros(1, dtype=np.uint32), [np.zeros(1, dtype=np.uint32)]
        for _ in range(radius):
            top = np.where(level == 0, 0, np.floor(np.log2(np.maximum(level, 1))).astype(int) + 1)
            level = np.concatenate([level[top <= b] | np.uint32(1 << b) for b in range(HALF_BITS)])
            patterns.append(level)
        patterns = np.concatenate(patterns)
        syndrome = self.syndrome(patterns)
        order = np.argsort(syndrome, kind="stable")
        self.patterns = patterns[order]
        self.starts = np.searchsorted(syndrome[order], np.arange((1 << 14) + 1))

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.uint32)
        for i in range(4):
            out ^= self.bytes[i][(x >> np.uint32(8 * i)) & np.uint32(255)]
        return out

    def anchors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into x and anchor, for every anchor within the radius of every x."""
        s = self.syndrome(x)
        n = self.starts[s + 1] - self.starts[s]
        row = np.repeat(np.arange(len(x)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[s], n)
        return row, x[row] ^ self.patterns[at]


def _replicated(prints: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint at all anchors near one of its halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = AnchorCode(COVERING_RADIUS + (THRESHOLD // 2 + 1) // 2)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(i, 4096).to_numpy(zero_copy_only=False)
                for half in (0, 1):
                    x = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
                    row, anchor = code.anchors(x)
                    key = anchor.astype(np.int64) | (half << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["anchor", "fp"])

    return prints.select("fp").mapInArrow(run, "anchor bigint, fp bigint")


def _smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node of each one's component."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if np.array_equal(after, label):
            return nodes, nodes[label]
        label = after


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by (cell, fp). Per run of cells, a star of links from each linked fingerprint to the smallest it reaches."""

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = fp.view(np.uint64)
        us, vs, shift = [], [], 1
        at = np.arange(len(key))
        while True:
            at = at[at < len(key) - shift]
            at = at[key[at] == key[at + shift]]
            if not len(at):
                break
            near = at[np.bitwise_count(x[at] ^ x[at + shift]) <= THRESHOLD]
            us.append(fp[near])
            vs.append(fp[near + shift])
            if len(us) > 256:
                nodes, low = _smallest_reachable(np.concatenate(us), np.concatenate(vs))
                us, vs = [nodes], [low]
            shift += 1
        if us:
            nodes, low = _smallest_reachable(np.concatenate(us), np.concatenate(vs))
            keep = nodes != low
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], ["u", "v"])

    keys, prints, held = [], [], 0
    for batch in batches:
        keys.append(batch.column(0).to_numpy(zero_copy_only=False))
        prints.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= 1 << 18:
            key, fp = np.concatenate(keys), np.concatenate(prints)
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last cell may go on
            yield from links(key[:cut], fp[:cut])
            keys, prints, held = [key[cut:]], [fp[cut:]], len(key) - cut
    if held:
        yield from links(np.concatenate(keys), np.concatenate(prints))


def _cells(replicated: DataFrame, chunk: int, name: str, member: str = "fp") -> DataFrame:
    """replicated (anchor, member, others) with `cell` for `anchor`.

    An anchor with more than `chunk` members is split: each member goes to the cells of its own chunk and every other chunk,
    so that every pair still meets and no task holds more than two chunks of one anchor.
    """
    hot = staged(
        replicated.groupBy("anchor").count().where(F.col("count") > chunk)
        .select("anchor", F.ceil(F.col("count") / chunk).cast("int").alias("parts")),
        name,
    )
    own = F.pmod(F.xxhash64(member), F.col("parts")).cast("int")
    cells = F.when(F.col("parts").isNull(), F.array(F.xxhash64("anchor"))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1),
            lambda other: F.xxhash64("anchor", F.least(own, other), F.greatest(own, other)),
        )
    )
    rest = [c for c in replicated.columns if c != "anchor"]
    return replicated.join(hot, "anchor", "left").select(F.explode(cells).alias("cell"), *rest)


def near_links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that give the same components as all pairs within the threshold."""
    cells = _cells(_replicated(prints), chunk, "hot-anchors")
    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_compared, "u bigint, v bigint")


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Majority of the bits of PIECES / 2 hashes of all shingles of a word sequence, as 64-bit numbers; no words: zero."""
    out = np.zeros(PIECES // 2, dtype=np.uint64)
    if not len(hashes):
        return out
    shingles = grams(hashes, min(WORDS, len(hashes)))
    counts = np.zeros((len(out), 64), dtype=np.int64)
    for i in range(0, len(shingles), 1 << 14):
        part = shingles[i : i + (1 << 14)]
        for j in range(len(out)):
            bits = np.unpackbits(mix(part + np.uint64(0x632BE59BD9B4E019 * j & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[j] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(shingles), axis=1, bitorder="little").view(np.uint64)[:, 0]


def _long_fingerprints(text: pa.Array) -> pa.Array:
    made = []
    for rows, w in word_slices(text, WORD):
        hashes = w.hashes
        made += [long_fingerprint(hashes[w.rows[r] : w.rows[r + 1]]) for r in range(rows)]
    flat = np.concatenate(made) if made else np.zeros(0, np.uint64)
    offsets = np.arange(len(made) + 1, dtype=np.int32) * (PIECES // 2)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def long_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, bits, fp): one row per document; bits is the long fingerprint, fp its 64-bit hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("copy"), F.arrow_udf(_long_fingerprints, "array<bigint>")(text).alias("bits"))
    return rows.withColumn("fp", F.xxhash64("bits"))


def _pieces(nodes: DataFrame) -> DataFrame:
    """(key, fp): a row for each piece of each fingerprint; key is the piece's number (from bit 32) and its 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(batch.num_rows, PIECES)
            key = bits.astype(np.int64) | (np.arange(PIECES, dtype=np.int64) << 32)
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fp, PIECES))], ["key", "fp"])

    return nodes.select("fp", "bits").mapInArrow(run, "key bigint, fp bigint")


def _replicated_pieces(values: DataFrame) -> DataFrame:
    """(anchor, key, label): each piece of `values` (key, label) at all anchors near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = AnchorCode(COVERING_RADIUS + (PIECE_THRESHOLD + 1) // 2)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                key, label = (batch.column(c).slice(i, 4096).to_numpy(zero_copy_only=False) for c in (0, 1))
                row, anchor = code.anchors(key.astype(np.uint32))
                columns = [anchor.astype(np.int64) | (key[row] >> 32 << 32), key[row], label[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "key", "label"])

    return values.select("key", "label").mapInArrow(run, "anchor bigint, key bigint, label bigint")


def _near_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input (cell, key, label) sorted by (cell, key). Each cell's pieces in groups that near pieces of different labels reach, with each group's smallest
    piece; a group is named by its members, so that equal groups of several cells become one. Pieces that are near no piece of another label are left out."""

    def groups(cell: np.ndarray, key: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        x = key.astype(np.uint32)
        group, shift, at = np.arange(len(key)), 1, np.arange(len(key))
        us, vs, held = [], [], 0
        while True:
            at = at[at < len(key) - shift]
            at = at[cell[at] == cell[at + shift]]
            near = at[(np.bitwise_count(x[at] ^ x[at + shift]) <= PIECE_THRESHOLD) & (label[at] != label[at + shift])]
            us.append(near)
            vs.append(near + shift)
            held += len(near)
            if held > 1 << 21 or not len(at):
                nodes, low = _smallest_reachable(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [nodes], [low], len(nodes)
                if not len(at):
                    break
            shift += 1
        group[nodes] = low
        keep = np.flatnonzero(np.bincount(group, minlength=len(key))[group] > 1)
        name = np.zeros(len(key), dtype=np.uint64)
        np.add.at(name, group[keep], mix(key[keep].view(np.uint64)))
        columns = [name[group[keep]].view(np.int64), key[group[keep]], key[keep]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["near", "low", "key"])

    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows >= 1 << 18:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last cell may go on
            yield groups(*(c[:cut] for c in columns))
            held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
    if rows:
        yield groups(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _alike(root: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of links among the roots of a group's fingerprints: all that pairs near in a piece and in the whole reach, where fingerprints of one root are
    linked already. A root that has been reached is only compared with those that have not been, so a group of near copies costs little more than its
    size, and gives a link less than it has roots."""
    us, vs = [], []
    pieces = bits.view(np.uint32).reshape(len(root), PIECES)
    order = np.argsort(root, kind="stable")
    names, first = np.unique(root[order], return_index=True)
    members = np.split(order, first[1:])
    at = np.empty(len(root), dtype=np.int64)  # the place of each fingerprint's root in names
    at[order] = np.repeat(np.arange(len(names)), np.diff([*first, len(order)]))
    reached = np.zeros(len(names), dtype=bool)
    left = np.arange(len(root))
    for start in range(len(names)):
        if reached[start]:
            continue
        reached[start] = True
        left = left[~reached[at[left]]]
        front = members[start]
        while len(front) and len(left):
            some, front = np.split(front, [max(1, PAIRS // len(left))])
            alike = np.bitwise_count(bits[some, None] ^ bits[None, left]).sum(axis=2, dtype=np.int64) <= LONG_THRESHOLD
            one, other = np.nonzero(alike)
            near = (np.bitwise_count(pieces[some[one]] ^ pieces[left[other]]) <= PIECE_THRESHOLD).any(axis=1)
            new = np.unique(at[left[other[near]]])
            if len(new):
                us.append(names[new])
                vs.append(np.full(len(new), names[start]))
                reached[new] = True
                left = left[~reached[at[left]]]
                front = np.concatenate([front, *(members[i] for i in new)])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input (near, root, bits) sorted by near: the links of each group's roots."""
    name = None
    held: list[tuple[np.ndarray, ...]] = []

    def links() -> Iterator[pa.RecordBatch]:
        u, v = _alike(*(np.concatenate(c) for c in zip(*held, strict=True)))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        near, root = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        bits = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(root), PIECES // 2)
        edges = [0, *(np.flatnonzero(near[1:] != near[:-1]) + 1).tolist(), len(near)] if len(near) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and near[a] != name:
                yield from links()
                held = []
            name = near[a]
            held.append((root[a:b], bits[a:b]))
    if held:
        yield from links()


def _group_links(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): links between the roots of each group of `groups` (near, root, fp)."""
    whole = groups.join(nodes.select("fp", "bits"), "fp").select("near", "root", "bits")
    return whole.repartition("near").sortWithinPartitions("near").mapInArrow(_linked, "u bigint, v bigint")


def similar_links(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links that give the same components as all pairs of fingerprints (columns fp, bits) that are near in a piece and differ in LONG_THRESHOLD bits
    or fewer.

    First the fingerprints that share a piece are compared, which joins nearly all of a large group of near copies. Then cells hold each distinct piece once
    and tell which are near; a piece carries the root of its fingerprints, and two pieces of one root are settled. A cell's group is part of a larger one,
    named by the smallest piece that is reached in MERGES steps, and whole fingerprints are compared there. So a fingerprint comes about once for each of
    its pieces, not once for each of their cells. A larger group of more than `chunk` fingerprints is compared by its cells' groups instead.
    """
    pieces = staged(_pieces(nodes), "pieces")
    shared = pieces.join(pieces.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")
    first = components(_group_links(shared.select(F.col("key").alias("near"), F.col("fp").alias("root"), "fp"), nodes))
    rooted = pieces.join(first.withColumnRenamed("u", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    label = F.when(F.min("root") == F.max("root"), F.min("root")).otherwise(F.xxhash64("key"))  # fingerprints of several roots: like no other piece
    cells = _cells(_replicated_pieces(rooted.groupBy("key").agg(label.alias("label"))), chunk, "hot-pieces", "key")
    cells = cells.select("cell", "key", "label").repartition("cell").sortWithinPartitions("cell", "key")
    near = cells.mapInArrow(_near_pieces, "near bigint, low bigint, key bigint").distinct()
    for _ in range(MERGES):
        for of in ("key", "near"):
            near = near.withColumn("low", F.min("low").over(Window.partitionBy(of)))
    near = staged(near, "near-pieces")
    members = staged(rooted.join(near.select("low", "key").distinct(), "key"), "near-members")
    over = staged(members.groupBy("low").count().where(F.col("count") > chunk).select("low"), "large-groups")
    small = members.join(over, "low", "left_anti").select(F.col("low").alias("near"), "root", "fp")
    large = members.join(over, "low", "left_semi").join(near, ["low", "key"]).select("near", "root", "fp")
    return first.withColumnRenamed("root", "v").unionByName(_group_links(small.unionByName(large), nodes))


def _components(prints: DataFrame, links=near_links) -> DataFrame:
    """(fp, component_id, root): for each fingerprint its component's smallest doc_id, and a number of the component itself."""
    more = [F.any_value("bits").alias("bits")] if "bits" in prints.columns else []
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), *more), "nodes")
    roots = components(links(nodes))
    joined = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return staged(joined.join(smallest, "root").select("fp", "component_id", "root"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs, other columns ignored.

    component_id: smallest doc_id reachable over links of THRESHOLD or fewer differing bits. Null and empty texts have the
    fingerprint zero, and link like any other. A null doc_id takes part but is never the smallest; a component of such rows
    alone has a null id. Repeated rows stay. Equal fingerprints are one node, so copies are never paired.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    named = _components(prints).select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id (null ids count as the largest).

    Of several rows with that doc_id the one with the smallest fingerprint, then text hash, stays; of rows equal in both, one.
    What stays is found on narrow rows; the texts are shuffled once, to meet it.
    """
    return _one_of_each(docs, staged(fingerprints(docs), "fingerprints"), near_links)


def without_similar(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of similar ones, chosen as by `without_near_duplicates`.

    Texts are linked whose WORDS-word shingles have a similarity of about 0.8 or more, as their long fingerprints tell (see LONG_THRESHOLD); groups are what links
    reach. Fewer words than a shingle's are one shingle, so such texts are linked if they have the same words; null, empty and blank texts are alike.
    """
    return _one_of_each(docs, staged(long_fingerprints(docs), "long-fingerprints"), similar_links)


def _one_of_each(docs: DataFrame, prints: DataFrame, links) -> DataFrame:
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "copy")
    kept = prints.join(_components(prints, links).select("fp", "root"), "fp").groupBy("root").agg(F.min(place).alias("kept"))
    keys = {"_no_id": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0))}
    kept = staged(kept.select("kept.*").select(*(c.alias(k) for k, c in keys.items()), F.col("copy").alias("_copy")), "kept")
    keyed = docs.withColumns(keys | {"_copy": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return keyed.join(kept, ["_no_id", "_id", "_copy"], "left_semi").dropDuplicates(["_no_id", "_id", "_copy"]).select(*docs.columns)
