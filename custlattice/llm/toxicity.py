"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, other, and the clause's end. Four transducers read a clause one after the
other, each rewriting symbols for the next: threats, negation (what follows a negation within three words is denied), reported
speech (what follows a reporting verb in its clause is quoted) and target (a clause that names a person aims its matches at them). They are composed into one transition
table, which turns each clause into counts of matched patterns; isolated words score only through the clause they stand in.

The insult lexicon (word stems) and the weights of the patterns are learnt from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.llm.staging import staged
from custlattice.llm.tokens import LETTER, HashTable, Words, grams, signed, slices, word_slices, words

#: Rows of the training sample with label 1 and with label 0, at most.
SAMPLE = (4_000, 12_000)
#: Bytes of a word's start that can be a stem, besides the whole word.
STEMS = (4, 5, 6)
LEXICON = 600
#: How many times as often as in other texts a stem of the lexicon occurs in toxic ones; with few texts only stems without a clean one reach it.
RATIO = 50
CUT = 0.3

#: Own small word lists, in English, German, French and Spanish.
THREAT = "kill hurt destroy beat burn shoot stab töten umbringen verletzen tuer frapper matar golpear".split()
TARGET = "you your yours he she they du dich dein ihr euch sie tu toi vous ton usted tú te ustedes".split()
NEGATION = "not no never none nor nicht kein keine nie ne pas jamais nunca ningún tampoco".split()
REPORT = "said says say told called wrote quoted sagte sagt nannte dit disait dijo dice llamó".split()

SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "end")
OTHER, INSULT, THREATS, TARGETS, NEGATIONS, REPORTS, END = range(7)
#: What the composed transducer counts: matches by kind, and how the clause frames them.
PATTERNS = ("plain", "denied", "quoted", "aimed", "threatening")
NEGATION_REACH = 3


class Transducer:
    """step(state, symbol) -> (state, symbol for the next, counts). States and symbols are hashable; the start state is given."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, after: Transducer) -> Transducer:
        """Composition: `after` reads what this one writes; counts add up."""

        def step(state, symbol):
            a, out, counts = self.step(state[0], symbol)
            b, out, more = after.step(state[1], out)
            return (a, b), out, tuple(x + y for x, y in zip(counts, more, strict=True))

        return Transducer((self.start, after.start), step)


def _none() -> tuple[int, ...]:
    return (0,) * len(PATTERNS)


def _count(*names: str) -> tuple[int, ...]:
    return tuple(int(p in names) for p in PATTERNS)


def negation() -> Transducer:
    """State: words for which the last negation still holds. A match inside becomes (symbol, denied)."""

    def step(left, symbol):
        if symbol == NEGATIONS:
            return NEGATION_REACH, symbol, _none()
        if symbol == END:
            return 0, symbol, _none()
        denied = left > 0 and symbol in (INSULT, THREATS)
        return max(0, left - 1), (symbol, denied) if symbol in (INSULT, THREATS) else symbol, _none()

    return Transducer(0, step)


def reported_speech() -> Transducer:
    """State: a reporting verb has been read in this clause. A match inside becomes (symbol, denied, quoted)."""

    def step(open_, symbol):
        if symbol == END:
            return False, symbol, _none()
        if isinstance(symbol, tuple):
            return open_, (*symbol, open_), _none()
        return open_ or symbol == REPORTS, symbol, _none()

    return Transducer(False, step)


def threat() -> Transducer:
    """Counts threats that are neither denied nor quoted; passes everything on."""

    def step(state, symbol):
        plain = isinstance(symbol, tuple) and symbol == (THREATS, False, False)
        return state, symbol, _count("threatening") if plain else _none()

    return Transducer(0, step)


def target() -> Transducer:
    """State: whether the clause has named a target, and held an unaimed match (at most one is remembered). Counts matches by frame."""

    def step(state, symbol):
        named, waiting = state
        if symbol == END:
            return (False, False), symbol, _none()
        if symbol == TARGETS:
            return (True, False), symbol, _count("aimed") if waiting else _none()
        if isinstance(symbol, tuple):
            kind, denied, quoted = symbol
            counts = _count("denied") if denied else _count("quoted") if quoted else _count("plain") if kind == INSULT else _none()
            if named and not denied:
                counts = tuple(x + y for x, y in zip(counts, _count("aimed"), strict=True))
            return (named, waiting or not (named or denied)), OTHER, counts
        return state, symbol, _none()

    return Transducer((False, False), step)


def grammar() -> tuple[np.ndarray, np.ndarray]:
    """The composition as tables: next state by (state, symbol), counts by (state, symbol, pattern); state 0 starts."""
    whole = negation().then(reported_speech()).then(threat()).then(target())
    ids, queue, moves = {whole.start: 0}, [whole.start], []
    for state in queue:
        row = []
        for symbol in range(len(SYMBOLS)):
            after, _, counts = whole.step(state, symbol)
            if after not in ids:
                ids[after] = len(ids)
                queue.append(after)
            row.append((ids[after], counts))
        moves.append(row)
    return np.array([[x[0] for x in r] for r in moves]), np.array([[x[1] for x in r] for r in moves])


def _hash_words(listed: list[str]) -> np.ndarray:
    data = [w.encode() for w in listed]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return words(np.frombuffer(b"".join(data), dtype=np.uint8), off, LETTER).hashes


def stems(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word index, hash) for whole words and for their starts of STEMS bytes; a start and an equal whole word differ."""
    out = [(np.arange(len(w.start)), w.hashes)]
    for k in STEMS:
        at = np.flatnonzero(w.end - w.start > k)
        out.append((at, w.span(w.start[at], w.start[at] + k) ^ np.uint64(k)))
    return out


def patterns(w: Words, lexicon: HashTable, weight: np.ndarray, fixed: tuple[HashTable, np.ndarray], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows x PATTERNS: weighted counts of the clauses' matches; an insult's count has its stem's weight."""
    n = len(w.start)
    symbol = np.full(n, OTHER)
    at, which = fixed[0].find(w.hashes)
    symbol[at] = fixed[1][which]
    strength = np.zeros(n)
    for index, hashes in stems(w):
        at, which = lexicon.find(hashes)
        np.maximum.at(strength, index[at], weight[which])
    symbol[strength > 0] = INSULT
    out = np.zeros((len(w.rows) - 1, len(PATTERNS)))
    matched = np.flatnonzero((symbol == INSULT) | (symbol == THREATS))
    if not len(matched):
        return out
    # a clause ends at the row's end or where . ! ? ; : , or a line feed stands between two words
    stops = np.flatnonzero(np.isin(w.raw, np.frombuffer(b".!?;:,\n", dtype=np.uint8)))
    clause = np.searchsorted(stops, w.start) + np.repeat(np.arange(len(w.rows) - 1), np.diff(w.rows))
    row_of = w.row_of
    nexts, counts = tables
    wanted = np.flatnonzero(np.isin(clause, clause[matched]))
    state, last = 0, None
    for i, c, r, s, x in zip(wanted.tolist(), clause[wanted].tolist(), row_of[wanted].tolist(), symbol[wanted].tolist(), strength[wanted].tolist(), strict=True):
        if (r, c) != last:
            state, last = 0, (r, c)
        got = counts[state, s]
        if got.any():
            out[r] += got * (x if s == INSULT else 1.0)
        state = nexts[state, s]
    return out


@dataclass
class Grammar:
    """A fitted grammar. score(w) gives a probability per row."""

    stems: np.ndarray
    weights: np.ndarray
    coefficients: np.ndarray

    def prepare(self) -> None:
        order = np.argsort(self.stems)
        self.lexicon, self.strength = HashTable(self.stems), self.weights[order]
        listed = [(THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)]
        symbols = {int(h): s for names, s in listed for h in _hash_words(names)}
        keys = np.array(sorted(symbols), dtype=np.uint64)
        self.fixed = HashTable(keys), np.array([symbols[int(k)] for k in keys])
        self.tables = grammar()

    def features(self, w: Words) -> np.ndarray:
        if not hasattr(self, "tables"):
            self.prepare()
        return np.log1p(patterns(w, self.lexicon, self.strength, self.fixed, self.tables))

    def score(self, w: Words) -> np.ndarray:
        z = self.coefficients[0] + self.features(w) @ self.coefficients[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rated(labels: DataFrame, allowed) -> DataFrame:
    rated = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return rated.where(allowed(F.col("doc_id")))


def _label_counts(labels: DataFrame, allowed) -> tuple[int, int]:
    return _rated(labels, allowed).agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()


def _sample(docs: DataFrame, labels: DataFrame, allowed) -> DataFrame:
    """(text, toxic) of at most SAMPLE labelled rows, chosen by hash of doc_id; equal texts count once."""
    rated = _rated(labels, allowed)
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = rated.where("toxic = 1").orderBy(*order).limit(SAMPLE[0]).unionByName(rated.where("toxic = 0").orderBy(*order).limit(SAMPLE[1]))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def _stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, toxic, texts): in how many texts each stem occurs; near copies, which mostly share their smallest hash of three words, count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in slices(batch, "text"):
                w = words(raw, off, LETTER)
                row_of, found = w.row_of, stems(w)
                least = np.full(part.num_rows, np.iinfo(np.uint64).max, dtype=np.uint64)
                three = grams(w.hashes, 3)
                inside = w.left_in_row[: len(three)] >= 3
                np.minimum.at(least, row_of[: len(three)][inside], three[inside])
                for index, hashes in found:
                    if len(index):
                        pairs = np.unique(np.stack([hashes, row_of[index].astype(np.uint64)]), axis=1)
                        row = pairs[1].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(signed(pairs[0])), part.column(1).take(pa.array(row)), pa.array(signed(least[row]))], ["stem", "toxic", "group"])

    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "stem bigint, toxic int, group bigint")
    return rows.distinct().groupBy("stem").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; column 0 of x is the constant."""
    b = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.1)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, allowed=lambda doc_id: F.lit(True)) -> Grammar:
    """Lexicon, stem weights and pattern weights from labelled rows whose doc_id is allowed.

    Without labels of both kinds the lexicon is empty and the score is the share of label 1 (0 if there is none).
    """
    sample = staged(_sample(docs, labels, allowed), "toxic-sample")
    totals = dict(sample.groupBy("toxic").count().collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    nothing = np.zeros(0, dtype=np.uint64), np.zeros(0)
    if not bad or not good:
        share = np.clip(bad / max(1, bad + good), 1e-6, 1 - 1e-6)
        return Grammar(*nothing, np.array([np.log(share / (1 - share)), *[0.0] * len(PATTERNS)]))
    ratio = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1))
    chosen = (
        _stem_counts(sample).withColumn("ratio", ratio).where((F.col("bad") >= 3) & (F.col("ratio") >= RATIO))
        .orderBy(F.desc("bad"), F.desc("ratio"), "stem").limit(LEXICON).collect()
    )
    keys = np.array([r.stem for r in chosen], dtype=np.int64).view(np.uint64)
    made = Grammar(keys, np.array([np.log(float(r.ratio)) / 3 for r in chosen]), np.zeros(len(PATTERNS) + 1))
    got = sample.select(features(made)(F.col("text")).alias("x"), "toxic").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(PATTERNS))
    y = got.column("toxic").to_numpy().astype(float)
    made.coefficients = _logistic(np.hstack([np.ones((len(x), 1)), x]), y)
    all_bad, all_good = _label_counts(labels, allowed)  # the sample may hold one kind more often than all rows do
    made.coefficients[0] += np.log(all_bad / all_good) - np.log(bad / good)
    made.coefficients[1:] = np.maximum(made.coefficients[1:], 0)  # no pattern makes a text less toxic than none
    return made


def features(made: Grammar):
    @F.arrow_udf("array<double>")
    def run(text: pa.Array) -> pa.Array:
        rows = [made.features(w) for _, w in word_slices(text, LETTER)]
        flat = np.concatenate(rows) if rows else np.zeros((0, len(PATTERNS)))
        return pa.array(flat.tolist(), pa.list_(pa.float64()))

    return run


def scorer(made: Grammar):
    """A column function: text to score between 0 and 1. Null counts as empty."""

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        rows = [made.score(w) for _, w in word_slices(text, LETTER)]
        return pa.array(np.concatenate(rows) if rows else np.zeros(0))

    return lambda text: run(F.coalesce(text.cast("string"), F.lit("")))


def toxic_scores(docs: DataFrame, made: Grammar) -> DataFrame:
    """docs with score and predicted (1 from CUT on). Every row has a score; repeated rows and extra columns stay."""
    scored = docs.withColumn("score", scorer(made)(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def without_toxic(docs: DataFrame, made: Grammar) -> DataFrame:
    """docs whose score stays below CUT."""
    return docs.where(scorer(made)(F.col("text")) < CUT)
