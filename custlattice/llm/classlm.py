"""A Brown class-based bigram model: P(text) = product of P(class | class before) P(word | class), the text's end being a word of its own class.

Exchange clustering moves items between classes while the likelihood of the class bigrams grows. Items are at first the most frequent words and, for all
other words, groups of words with the same ending. Then each of the other words whose counts the tasks hold (``HEAD``) is exchanged by itself: Spark
counts the classes before and after it in all training rows, and it goes to the class that raises the likelihood most, the others staying where they are.
Words beyond these and unseen words keep the class of their ending; so every word has a class that depends on the word and the model alone. Counts of
words, item pairs and classes cover all training rows. A word is known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.llm.staging import staged
from custlattice.llm.tokens import HashTable, Words, mix, signed, slices, words

#: The number of classes is the cube root of the number of distinct training words, within these bounds (which keep a table of class pairs small).
CLASSES = (48, 128)
#: Words that are items from the start, and groups of endings for the others: their pairs are counted in at most 1.7 million cells.
ITEMS = 1_024
ENDINGS = 256
ENDING_BYTES = 3
#: Most frequent words whose counts and classes are sent to the tasks (9 MB); counts of the others are joined.
HEAD = 1 << 19
ROUNDS = 6
#: Counted contexts that are compared with all classes at a time.
BLOCK = 1 << 14
SMOOTHING = 0.5
#: Weight of the class's own share against the class bigram.
BACKOFF = 5.0
#: The hash that stands for the end of a text.
END = np.uint64(0x656E642D6F662D74)


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ending groups of all tokens, an end after each row, and where each row begins."""
    rows = len(w.rows) - 1
    begin = w.rows + np.arange(rows + 1)
    at = np.arange(len(w.start)) + w.row_of
    hashes = np.full(begin[-1], END, dtype=np.uint64)
    hashes[at] = w.hashes
    group = np.zeros(begin[-1], dtype=np.int64)
    ending = w.span(np.maximum(w.start, w.end - ENDING_BYTES), w.end)
    group[at] = (mix(ending + np.uint64(1)) >> np.uint64(32)).astype(np.int64) % ENDINGS
    return hashes, group, begin


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n): every token's hash, group of endings and count; the end of each text is counted. docs: column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def counted() -> pa.RecordBatch:
            word, first, n = np.unique(np.concatenate([h for h, _ in held]), return_index=True, return_counts=True)
            ending = np.concatenate([g for _, g in held])[first].astype(np.int16)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(ending), pa.array(n)], ["word", "ending", "n"])

        for batch in batches:
            for _, raw, off in slices(batch, "text"):
                hashes, group, _ = _tokens(words(raw, off))
                held.append((hashes, group))
                size += len(hashes)
                if size >= 1 << 21:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    counted = docs.select(_text()).mapInArrow(run, "word bigint, ending smallint, n bigint")
    return counted.groupBy("word", "ending").agg(F.sum("n").alias("n"))


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


class Items:
    """Item numbers of tokens: 0 the end, then the listed words, then the groups of endings."""

    def __init__(self, listed: np.ndarray):
        self.table = HashTable(listed)
        self.n = 1 + len(listed) + ENDINGS

    def of(self, hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
        out = group + (1 + len(self.table.keys))
        at, which = self.table.find(hashes)
        out[at] = which + 1
        out[hashes == END] = 0
        return out


def item_pairs(docs: DataFrame, items: Items) -> DataFrame:
    """(pair, n): how often item b follows item a, as a * items.n + b; a text's first word follows the end."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for _, raw, off in slices(batch, "text"):
                hashes, group, _ = _tokens(words(raw, off))
                item = own.of(hashes, group)
                before = np.concatenate([[0], item[:-1]])
                held.append(before * own.n + item)
                size += len(item)
                if size >= 1 << 21:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    return docs.select(_text()).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def classes_for(words: int) -> int:
    root = round(float(np.cbrt(words)))  # the last digit of cbrt differs between machines
    return int(np.clip(root + (root**3 < words), *CLASSES))


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each item: pairs[a, b] counts b after a. Items move, one at a time and most frequent first, to the class that raises the likelihood most.

    Class 0 holds item 0, the end, alone. At the start the most frequent items open the classes and the others are dealt out in turn.
    The likelihood up to a constant is sum f(N(c, d)) - sum f(N(c, .)) - sum f(N(., d)) with f(x) = x log x.
    """
    n = len(pairs)
    size = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = [int(i) for i in np.argsort(-size, kind="stable") if i]
    own = np.zeros(n, dtype=np.int64)
    own[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), own] = 1
    to = pairs @ member  # item -> class
    came = pairs.T @ member
    table = member.T @ to
    for _ in range(rounds):
        moved = 0
        for i in order:
            old = own[i]
            if size[i] == 0:
                continue
            out, into, self_ = to[i].copy(), came[i].copy(), pairs[i, i]
            out[old] -= self_
            into[old] -= self_
            # the table without i
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= self_
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            gain = (
                (_xlogx(table + out) - _xlogx(table)).sum(axis=1)
                + (_xlogx(table + into[:, None]) - _xlogx(table)).sum(axis=0)
                - (_xlogx(rows + into + out.sum() + self_) - _xlogx(rows + into))
                - (_xlogx(columns + out + into.sum() + self_) - _xlogx(columns + out))
            )
            # the diagonal cell gets both directions and i's own pairs
            d = np.diagonal(table)
            gain += _xlogx(d + out + into + self_) + _xlogx(d)
            gain -= _xlogx(d + out) + _xlogx(d + into)
            gain[0] = -np.inf
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else int(old)
            table[new] += out
            table[:, new] += into
            table[new, new] += self_
            if new != old:
                moved += 1
                own[i] = new
                to[:, old] -= pairs[:, i]
                to[:, new] += pairs[:, i]
                came[:, old] -= pairs[i]
                came[:, new] += pairs[i]
        if not moved:
            break
    return own


@dataclass
class Classes:
    """The class of every word: its own if it is one of the ``head``, else that of its group of endings; the end of a text is class 0."""

    n: int
    head: HashTable
    head_class: np.ndarray
    ending_class: np.ndarray

    def of(self, hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
        out = self.ending_class[group]
        at, which = self.head.find(hashes)
        out[at] = self.head_class[which]
        out[hashes == END] = 0
        return out


@dataclass
class ClassModel:
    """Classes, log10 transition probabilities, log10 divisors of the word counts per class, tokens, distinct words, the base's divisor, and counts of the head's words."""

    classes: Classes
    transition: np.ndarray
    norm: np.ndarray
    tokens: int
    words: int
    divisor: float
    head_counts: np.ndarray


def _head(counts: DataFrame) -> pa.Table:
    """(word, ending, n) of the most frequent words, at most HEAD, the bound between whole octave eighths of the count."""
    eighth = F.floor(F.log2("n") * 8).cast("int")
    room, least = HEAD, None
    for r in counts.groupBy(eighth.alias("eighth")).count().orderBy(F.desc("eighth")).collect():  # at most 512 rows
        room -= r["count"]
        if room < 0:
            break
        least = r.eighth
    return counts.where(eighth >= (least if least is not None else 1 << 20)).select("word", "ending", "n").toArrow()


def class_pairs(docs: DataFrame, classes: Classes) -> np.ndarray:
    """How often a word of class d follows one of class c in docs (column text), at [c, d]."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    cells = classes.n**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        n = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for _, raw, off in slices(batch, "text"):
                hashes, group, _ = _tokens(words(raw, off))
                of = own.of(hashes, group)
                n += np.bincount(np.concatenate([[0], of[:-1]]) * own.n + of, minlength=cells)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["pair", "n"])

    got = docs.select(_text()).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(classes.n, classes.n)


def contexts(docs: DataFrame, classes: Classes, listed: np.ndarray) -> DataFrame:
    """(word, cells): per word of the head, by its number there, how often each class comes before it (cell: the class) and after it (cell: n + the class).

    ``listed`` tells the words that have been exchanged already; they and the end have no row. cells has at most 2 n entries.
    """
    sent = docs.sparkSession.sparkContext.broadcast((classes, listed | (classes.head.keys == END)))
    wide = 2 * classes.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = sent.value
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((key // wide).astype(np.int32)), pa.array((key % wide).astype(np.int16)), pa.array(n)], ["word", "cell", "n"])

        for batch in batches:
            for _, raw, off in slices(batch, "text"):
                hashes, group, _ = _tokens(words(raw, off))
                of = own.of(hashes, group)
                at, which = own.head.find(hashes)
                free = ~done[which]
                at, which = at[free], which[free]
                before = np.concatenate([[0], of[:-1]])[at]
                held += [which * wide + before, which * wide + own.n + of[at + 1]]  # after every word comes a word or the end
                size += 2 * len(at)
                if size >= 1 << 21:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    rows = docs.select(_text()).mapInArrow(run, "word int, cell smallint, n bigint").groupBy("word", "cell").agg(F.sum("n").alias("n"))
    return rows.groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))


def best_classes(table: np.ndarray, old: np.ndarray, row: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where each of some words, of classes ``old``, raises the likelihood most while all others stay: its n[i] neighbours of the i-th context are cell[i],
    as in ``contexts``; row[i] is the word, ascending and without gaps. Table cells that both sides of a word meet are taken as two. Nobody opens an empty class, for all that wish to would meet in it."""
    classes = len(table)
    cells = np.hstack([table.T, table])
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    there = cells[:, cell]
    gain = np.add.reduceat(_xlogx(there + n) - _xlogx(there), begin, axis=1).T
    here = cells[old[row], cell]
    stay = np.add.reduceat(_xlogx(here) - _xlogx(np.maximum(here - n, 0)), begin)
    for margin, side in ((table.sum(axis=0), cell < classes), (table.sum(axis=1), cell >= classes)):
        size = np.add.reduceat(np.where(side, n, 0), begin).astype(float)
        gain -= _xlogx(margin + size[:, None]) - _xlogx(margin)
        stay -= _xlogx(margin[old]) - _xlogx(np.maximum(margin[old] - size, 0))
    gain[:, table.sum(axis=0) == 0] = -np.inf
    gain[:, 0] = -np.inf
    gain[np.arange(len(old)), old] = stay
    new = gain.argmax(axis=1)
    return np.where(gain.max(axis=1) > stay + 1e-9, new, old)


def exchange_all(docs: DataFrame, classes: Classes, listed: np.ndarray, table: np.ndarray) -> tuple[Classes, np.ndarray]:
    """Every word of the head that is not ``listed`` in its best class, and the table of class pairs by it; as before if all moves together gain nothing."""
    sent = docs.sparkSession.sparkContext.broadcast((classes.head_class, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs = sent.value
        for batch in batches:
            word = batch.column("word").to_numpy(zero_copy_only=False)
            lists = batch.column("cells")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            cell, n = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = np.concatenate([[0], np.cumsum(size)])
            i = 0
            while i < len(word):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
                some = slice(ends[i], ends[j])
                new = best_classes(pairs, own[word[i:j]], np.repeat(np.arange(j - i), size[i:j]), cell[some].astype(np.int64), n[some])
                yield pa.RecordBatch.from_arrays([pa.array(word[i:j]), pa.array(new.astype(np.int16))], ["word", "class"])
                i = j

    got = contexts(docs, classes, listed).mapInArrow(run, "word int, class smallint").toArrow()  # at most HEAD rows
    own = classes.head_class.copy()
    own[got.column("word").to_numpy()] = got.column("class").to_numpy()
    moved = Classes(classes.n, classes.head, own, classes.ending_class)
    pairs = class_pairs(docs, moved)
    return (moved, pairs) if likelihood(pairs) > likelihood(table) else (classes, table)


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams up to a constant."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def _kinds(counts: DataFrame, classes: Classes) -> np.ndarray:
    """How many distinct words each class has."""
    sent = counts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        n = np.zeros(own.n, dtype=np.int64)
        for batch in batches:
            word, group = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            n += np.bincount(own.of(word.view(np.uint64), group.astype(np.int64)), minlength=own.n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(own.n, dtype=np.int32)), pa.array(n)], ["class", "n"])

    found = counts.select("word", "ending").mapInArrow(run, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes.n)
    out[found.column("class").to_numpy()] = found.column("n").to_numpy()
    return out


def fit(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model, and (word, ending, n) of all words it has counted. docs: training rows with column text.

    Without training rows every word is unknown and the counts are empty.
    """
    counts = staged(word_counts(docs), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = _head(counts)
    word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    listed = word[np.lexsort((word, -n))]
    items = Items(listed[listed != END][:ITEMS])
    got = item_pairs(docs, items).toArrow()
    pairs = np.zeros(items.n * items.n)
    pairs[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    pairs = pairs.reshape(items.n, items.n)
    many = classes_for(int(total[1]))
    own = exchange(pairs, many)
    order = np.argsort(word)
    head = HashTable(word)
    group = top.column("ending").to_numpy()[order].astype(np.int64)
    classes = Classes(many, head, own[items.of(head.keys, group)], own[-ENDINGS:])
    member = np.eye(many)[own]
    classes, table = exchange_all(docs, classes, np.isin(head.keys, items.table.keys), member.T @ pairs @ member)
    tokens = table.sum(axis=0)
    share = (tokens + SMOOTHING) / (tokens.sum() + SMOOTHING * many)
    transition = np.log10((table + BACKOFF * share) / (table.sum(axis=1, keepdims=True) + BACKOFF))
    norm = np.log10(tokens + SMOOTHING * (_kinds(counts, classes) + 1))
    return ClassModel(classes, transition, norm, int(total[0]), int(total[1]), float(total[0]) + SMOOTHING * (int(total[1]) + 1), n[order]), counts


_PART = "part bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, word bigint, n bigint"


def _parts(docs: DataFrame, made: ClassModel) -> DataFrame:
    """Per row of docs one row with what the model alone tells, and one for each of its distinct words whose count must be looked up."""
    sent = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        log = np.log10(model.head_counts + SMOOTHING)
        base = np.log10((model.head_counts + SMOOTHING) / model.divisor)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                hashes, group, begin = _tokens(words(raw, off))
                of = model.classes.of(hashes, group)
                before = np.concatenate([[0], of[:-1]])  # what comes before a row is an end, of class 0
                rows = part.num_rows
                row_of = np.repeat(np.arange(rows), np.diff(begin))
                at, which = model.classes.head.find(hashes)
                known = np.bincount(row_of[at], minlength=rows)
                bases = np.bincount(row_of[at], base[which], minlength=rows).astype(np.float64)
                told = model.transition[before, of] - model.norm[of]
                told[at] += log[which]
                told = np.bincount(row_of, told, minlength=rows).astype(np.float64)
                rare = np.ones(len(hashes), dtype=bool)
                rare[at] = False
                rare = np.flatnonzero(rare)
                order = np.lexsort((hashes[rare], row_of[rare]))
                rare = rare[order]
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (hashes[rare][1:] != hashes[rare][:-1]) | (row_of[rare][1:] != row_of[rare][:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(rare)))
                rare = rare[first]
                key = number + np.arange(rows)
                number += rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), part.column(0), pa.array(np.diff(begin)), pa.array(known), pa.array(bases), pa.array(told), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())],
                    names,
                )
                m = len(rare)
                empty = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(key[row_of[rare]]), *empty, pa.array(signed(hashes[rare])), pa.array(n)], names)

    names = [f.split()[0] for f in _PART.split(", ")]
    return docs.select(F.col("doc_id").cast("bigint"), _text()).mapInArrow(run, _PART)


def scores(docs: DataFrame, made: ClassModel, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), all for whole texts; null counts as empty, one token.

    base_score: log10 probability by smoothed word counts alone; score: by the class model. Repeated rows are scored each.
    """
    parts = staged(_parts(docs, made), "scored")
    rare = parts.where("word is not null").select("part", "word", "n")
    n = F.coalesce(F.col("count"), F.lit(0))
    found = rare.join(counts.select("word", F.col("n").alias("count")), "word", "left").groupBy("part").agg(
        F.sum(F.col("n") * F.log10((n + SMOOTHING) / made.divisor)).alias("rare_base"),
        F.sum(F.col("n") * F.log10(n + SMOOTHING)).alias("rare_score"),
        F.sum(F.when(n > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    whole = parts.where("word is null").join(found, "part", "left")
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(made.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
