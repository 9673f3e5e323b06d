"""Operator 8: toxicity by a weighted finite-state pattern grammar.

Words are insults, verbs of harm, targets, marks of intent, negations, marks of reported speech and so on; marks of
punctuation are symbols too. Transducers read a line from left to right: one tells aimed insults from lone ones, one
makes threats of a verb of harm and the person that is its object, or of a wish, one marks what a negation of the same
clause denies, and one what stands in reported speech. Others read the result from right to left: they find reports that
follow what they report, insults that a comparison aims, and verbs that only mean to win. Each direction is composed to
one transducer, and the matches that come out are weighed, so that a lone word, a denial or a quotation alone doesn't
make a text toxic. Insults are fixed words and what labelled documents teach: words and stems of words that toxic
documents have and others don't. The weights of matches are fitted to the same labels within bounds that keep that order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import bounded, folded_words, kept_columns, materialise, plain_text, read_spread, read_table, row_numbers

#: Labelled documents that are learned from, at most about.
SAMPLE = 30_000
#: Toxic texts that a learned word or stem must be in, and that it must add to those of the ones before it.
SUPPORT, ADDED = 5, 3
STEMS = (4, 5, 6, 7)

#: Symbols of words, then those of marks.
OTHER, INSULT, THREAT, RIVALRY, TARGET, ADDRESS, SELF, INTENT, WISH, DYING, NEGATION, NOBODY, ONLY, BUT, AND, REPORT, THAN, BREAK, CONTEST = range(19)
COMMA, COLON, QUOTE, STOP, LINE = range(19, 24)
#: Words of each class, a later class before an earlier one.
WORDS = {
    REPORT: "said says say wrote claimed called quoted quote reported told sagte sagt schrieb nannte dit écrit traité dijo escribió llamó",
    NEGATION: "not no never neither nor isn aren don doesn didn wasn weren won wouldn couldn shouldn haven hasn hadn ain cannot nicht kein keine keinen niemals pas jamais ni nunca tampoco",
    NOBODY: "nobody none noone niemand personne nadie",
    ONLY: "only merely nur seulement solo",
    BUT: "but yet because although though aber sondern weil mais parce pero sino porque",
    AND: "and und et y",
    INTENT: "will ll gonna going shall werde werden vais allons voy vamos",
    WISH: "hope hopes hoping wish hoffe hoffentlich espère espero ojalá",
    DYING: "die dies died suffer rot stirbst sterbt stirbt meurs crèves mueras muera",
    ADDRESS: "you du ihr tu vous tú usted ustedes vosotros",
    SELF: "yourself yourselves",
    TARGET: "your yours he she they them him her dich dir euch te toi",
    THAN: "as than wie als comme que como",
    BREAK: "the a an this that these those my our its for at to in on with about from der das den dem eine einen le la les un une el los las una por para pour",
    CONTEST: "chess game games match race racing tennis golf football soccer poker cards quiz debate election tournament championship league finals",
    RIVALRY: "beat destroy crush",
    THREAT: "kill hurt shoot stab burn strangle murder töten umbringen tuer frapper matar golpear",
    INSULT: "idiot idiots moron morons stupid loser losers pathetic worthless scum trash clown disgusting imbecile dumb jerk bastard dumbass vermin trottel dummkopf abschaum arschloch imbécile crétin connard abruti idiota imbécil estúpido estúpida",
}
#: Words that a target or a verb of harm reaches, and words between what is said and the report after it.
REACH, TAG = 4, 3
#: Matches: a lone insult, an aimed one, harm to a person, and harm that is announced or wished.
LONE, AIMED, HARM, VOWED = range(4)
#: Bits of a match. NOBODY_DOES, DIRECT (an insult right after the word for who is spoken to) and RIVAL (a verb that may
#: mean to win) are only needed on the way.
NEGATED, REPORTED, NOBODY_DOES, DIRECT, RIVAL = 1, 2, 4, 8, 8
#: Symbols from here on are matches: FIRST, sixteen times the kind, and the bits.
FIRST = 24
MATCHES = 16


@dataclass(frozen=True)
class Transducer:
    """arcs: what a state and a symbol lead to, the next state and the symbol put out; others stay and pass the symbol on."""

    arcs: dict = field(hash=False)
    start: int = 0

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, symbol))


def _alphabet() -> range:
    return range(FIRST + 64)


def _match(kind: int, bits: int = 0) -> int:
    return FIRST + 16 * kind + bits


def _made(start: tuple, step) -> Transducer:
    """The transducer of step, from a state (any tuple) and a symbol to the next state and what is put out."""
    number, todo, arcs = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for symbol in _alphabet():
            after, out = step(state, symbol)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            arcs[number[state], symbol] = (number[after], out)
    return Transducer(arcs)


def _aiming() -> Transducer:
    """Insults become matches: aimed within REACH words after a target. State: words left, and whether they go on from an address."""

    def step(state: tuple, symbol: int) -> tuple[tuple, int]:
        left, spoken_to = state
        if symbol in (COLON, STOP, LINE, BUT):
            return (0, False), symbol
        if symbol in (COMMA, QUOTE):
            return (left, False), symbol
        if symbol in (ADDRESS, TARGET, SELF):
            return (REACH, symbol == ADDRESS), symbol
        after = max(0, left - 1)
        if symbol == INSULT:
            return (after, spoken_to), _match(AIMED if left else LONE, DIRECT if spoken_to else 0)
        return (after, False), symbol

    return _made((0, False), step)


def _threatening() -> Transducer:
    """A person within REACH words after a verb of harm becomes a match, a vow after a mark of intent or a wish.

    An article or a preposition between them gives the verb another object. State: intent, what is open (a verb of harm,
    one of rivalry, a wish, a wish for a person), and the words left.
    """

    def step(state: tuple, symbol: int) -> tuple[tuple, int]:
        intent, opened, left = state
        if symbol in (COLON, STOP, LINE):
            return (0, OTHER, 0), symbol
        if symbol == COMMA:
            return (intent, OTHER, 0), symbol
        if symbol == INTENT:
            return (1, opened, left), OTHER
        if symbol == WISH:
            return (1, WISH, REACH), OTHER
        if symbol in (THREAT, RIVALRY):
            return (intent, symbol, REACH), OTHER
        if symbol in (TARGET, ADDRESS) and opened in (THREAT, RIVALRY):
            return (intent, OTHER, 0), _match(VOWED if intent else HARM, RIVAL if opened == RIVALRY else 0)
        if symbol == SELF and opened == THREAT and left == REACH:
            return (intent, OTHER, 0), _match(VOWED)
        if symbol in (TARGET, ADDRESS) and opened == WISH:
            return (intent, TARGET, REACH), symbol
        if symbol == DYING:
            return (intent, OTHER, 0), _match(VOWED) if opened == TARGET else OTHER
        if symbol == QUOTE:
            return state, symbol
        lasts = left > 1 and not (symbol == BREAK and opened in (THREAT, RIVALRY))
        return (intent, opened if lasts else OTHER, left - 1 if lasts else 0), symbol

    return _made((0, OTHER, 0), step)


def _negating() -> Transducer:
    """Marks matches after a negation of their clause; not what is said straight to someone's face, nor after "not only".

    A clause ends at a mark, at a conjunction like "but", and at "and" before a person. State: what denies, and whether
    it or an "and" stood just before.
    """

    def step(state: tuple, symbol: int) -> tuple[tuple, int]:
        bit, before = state
        if symbol in (COMMA, COLON, STOP, LINE, BUT) or (symbol == ONLY and before == NEGATION) or (symbol in (ADDRESS, TARGET) and before == AND):
            return (0, OTHER), symbol
        if symbol in (NEGATION, NOBODY):
            return (NEGATED if symbol == NEGATION else NOBODY_DOES, NEGATION), symbol
        insult = symbol >= FIRST and (symbol - FIRST) // 16 in (LONE, AIMED)
        out = FIRST + (symbol - FIRST | bit) if symbol >= FIRST and not (insult and (symbol - FIRST) & DIRECT) else symbol
        return (bit, AND if symbol == AND and bit else OTHER), out

    return _made((0, OTHER), step)


def _reporting() -> Transducer:
    """Marks matches after a report: to the sentence's end, or to the end of the quotation that it opens. State: 0, REPORT or QUOTE."""

    def step(state: tuple, symbol: int) -> tuple[tuple, int]:
        (mode,) = state
        if symbol == LINE or (symbol == STOP and mode != QUOTE):
            return (0,), symbol
        if symbol == QUOTE:
            return (QUOTE if mode == REPORT else 0,), symbol
        out = FIRST + (symbol - FIRST | REPORTED) if symbol >= FIRST and mode else symbol
        return (REPORT if symbol == REPORT and not mode else mode,), out

    return _made((0,), step)


def _tagging() -> Transducer:
    """From right to left: marks matches before a report that a comma or a quotation's end joins to them.

    State: 0, COMMA or QUOTE (what is said lies here), or REPORT and the words left to such a mark. What "you" say is no report.
    """

    def step(state: tuple, symbol: int) -> tuple[tuple, int]:
        mode, left = state
        if symbol == LINE or (symbol in (STOP, COLON) and mode != QUOTE):
            return (0, 0), symbol
        if symbol == QUOTE:
            return (QUOTE if mode in (REPORT, COMMA) else 0, 0), symbol
        if mode in (COMMA, QUOTE):
            return state, FIRST + (symbol - FIRST | REPORTED) if symbol >= FIRST else symbol
        if symbol == REPORT:
            return (REPORT, TAG), symbol
        if mode == REPORT:
            return (COMMA, 0) if symbol == COMMA else (0, 0) if symbol == ADDRESS or left == 1 else (REPORT, left - 1), symbol
        return (0, 0), symbol

    return _made((0, 0), step)


def _comparing() -> Transducer:
    """From right to left: an insult just before "as" or "than" and a person is aimed, and "nobody" doesn't deny it.

    Without a comparison "nobody" is a negation. State: OTHER, TARGET after a person, THAN after both.
    """

    def step(state: tuple, symbol: int) -> tuple[tuple, int]:
        (mode,) = state
        after = TARGET if symbol in (TARGET, ADDRESS) else THAN if symbol == THAN and mode == TARGET else OTHER
        if symbol < FIRST:
            return (after,), symbol
        kind, bits = divmod(symbol - FIRST, 16)
        if mode == THAN and kind in (LONE, AIMED):
            return (after,), _match(AIMED, bits & ~NOBODY_DOES)
        return (after,), _match(kind, bits & ~NOBODY_DOES | (NEGATED if bits & NOBODY_DOES else 0))

    return _made((OTHER,), step)


def _winning() -> Transducer:
    """From right to left: a verb of rivalry with a contest later in its sentence is no harm. State: whether a contest was seen."""

    def step(state: tuple, symbol: int) -> tuple[tuple, int]:
        (contest,) = state
        if symbol in (STOP, LINE):
            return (False,), symbol
        rival = symbol >= FIRST and (symbol - FIRST) // 16 in (HARM, VOWED) and (symbol - FIRST) & RIVAL
        return (contest or symbol == CONTEST,), OTHER if rival and contest else symbol

    return _made((False,), step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer whose second part reads what the first puts out; only states that can be reached are made."""
    number, todo, arcs = {(first.start, second.start): 0}, [(first.start, second.start)], {}
    while todo:
        pair = todo.pop()
        for symbol in _alphabet():
            a, middle = first.step(pair[0], symbol)
            b, out = second.step(pair[1], middle)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], symbol] = (number[a, b], out)
    return Transducer(arcs)


FORWARD = reduce(compose, [_aiming(), _threatening(), _negating(), _reporting()])
BACKWARD = reduce(compose, [_tagging(), _comparing(), _winning()])


def run_grammar(symbols: list[int]) -> list[int]:
    """What the grammar puts out for the symbols of a line, read to the right and then to the left."""
    state, out = FORWARD.start, []
    for symbol in symbols:
        state, put = FORWARD.arcs[state, symbol]
        out.append(put)
    state = BACKWARD.start
    for i in range(len(out) - 1, -1, -1):
        state, out[i] = BACKWARD.arcs[state, out[i]]
    return out


#: Fixed values, where the fit starts: the intercept, then of each kind of match the plain, negated, reported and both.
START = np.array([-3.0, 3.0, 1.0, 1.5, 0.5, 6.0, 2.5, 3.0, 1.5, 3.2, 1.0, 1.5, 0.5, 6.5, 2.0, 3.5, 1.5])
#: Which matches make a text toxic by themselves.
STRONG = np.isin(np.arange(MATCHES), (4 * AIMED, 4 * VOWED))


def bounded_weights(weights: np.ndarray) -> np.ndarray:
    """weights moved to where one strong match scores over a half, and one of any other kind below it."""
    out = weights.copy()
    out[0] = np.clip(out[0], -6.0, -2.0)
    edge = -out[0] / np.log(2)
    out[1:] = np.where(STRONG, np.maximum(out[1:], edge + 0.3), np.clip(out[1:], 0.0, edge - 0.3))
    return out


@dataclass
class Grammar:
    """lexicon: weight of each learned word, and of each stem with its end marked by *; weights: of matches, like START."""

    lexicon: dict[str, float]
    weights: np.ndarray

    def classes(self, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each word; an insult's is that of the word or its longest stem."""
        kind, weight = np.zeros(len(dictionary), np.int64), np.ones(len(dictionary))
        for c, listed in WORDS.items():
            kind[pc.is_in(dictionary, value_set=pa.array(listed.split())).to_numpy(zero_copy_only=False)] = c
        for size in (*STEMS, 0):
            known = [x for x in self.lexicon if (x.endswith("*") and len(x) == size + 1 if size else not x.endswith("*"))]
            if known:
                part = pc.if_else(pc.greater(pc.utf8_length(dictionary), size), pc.utf8_slice_codeunits(dictionary, 0, size), "") if size else dictionary
                at = pc.fill_null(pc.index_in(part, value_set=pa.array([x.removesuffix("*") for x in known])), -1).to_numpy(zero_copy_only=False)
                kind[at >= 0] = INSULT
                weight[at >= 0] = np.array([self.lexicon[x] for x in known])[at[at >= 0]]
        return kind, weight

    def matches(self, texts: pa.Array) -> np.ndarray:
        """For each text and kind of match, the logarithm of 1 and the sum of the matches' weights. A word counts once a sentence and kind."""
        words, word_at, marks, rows = line_symbols(texts)
        out = np.zeros((len(texts), MATCHES))
        if not len(words):
            return out
        coded = pc.dictionary_encode(words)
        kind, weight = self.classes(coded.dictionary)
        ids = np.append(coded.indices.to_numpy(zero_copy_only=False), 0)[word_at]
        symbols = np.where(word_at >= 0, kind[ids], marks)
        fresh = np.concatenate([[True], rows[1:] != rows[:-1]])
        line = np.cumsum(fresh | np.concatenate([[False], symbols[:-1] == LINE])) - 1
        hot = np.zeros(line[-1] + 1, bool)
        hot[line[(symbols == INSULT) | (symbols == THREAT) | (symbols == RIVALRY) | (symbols == DYING)]] = True
        # After REACH other words all states are as they will stay, so more of them aren't read.
        at = np.arange(len(symbols))
        spoken = np.maximum.accumulate(np.where((symbols != OTHER) | fresh, at, 0))
        at = np.flatnonzero(hot[line] & (at - spoken <= REACH))
        ends = np.flatnonzero(np.append(line[at][1:] != line[at][:-1], True)) + 1 if len(at) else []
        start = 0
        for end in ends:
            part = at[start:end]
            seen, read = set(), symbols[part].tolist()
            for place, symbol, put in zip(part.tolist(), read, run_grammar(read), strict=True):
                if put >= FIRST:
                    found, bits = divmod(put - FIRST, 16)
                    column = 4 * found + (bits & (NEGATED | REPORTED))
                    if (column, ids[place]) not in seen:
                        seen.add((column, ids[place]))
                        out[rows[place], column] += weight[ids[place]]
                elif symbol == STOP:
                    seen.clear()
            start = end
        return np.log1p(out)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.matches(texts) @ self.weights[1:] + self.weights[0])))


def line_symbols(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words, and of each word and mark in order: the word's number or -1, the mark's symbol, and the text's number.

    Typographic quotation marks, apostrophes and dashes are read like the plain ones. A stop right before a quotation mark
    belongs to what is quoted and ends no sentence.
    """
    texts = pc.utf8_lower(texts)
    for pattern, by in (("[“”„«»]", '"'), ("[‘’]", "'"), ("[–—]", ", ")):
        texts = pc.replace_substring_regex(texts, pattern, by)
    words, counts = folded_words(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    solid = (data >= 0x80) | (data >= 0x30) & (data < 0x3A) | (data >= 0x61) & (data < 0x7B)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = (offsets - offsets[0])[:-1]
    firsts = firsts[firsts < len(data)]
    begins[firsts] = solid[firsts]
    table = np.zeros(256, np.int64)
    for symbol, marks in ((COMMA, b",()"), (COLON, b":"), (QUOTE, b'"'), (STOP, b".!?;"), (LINE, b"\n")):
        table[list(marks)] = symbol
    mark = table[data]
    mark[:-1][(mark[:-1] == STOP) & (mark[1:] == QUOTE)] = 0
    at = np.flatnonzero(begins | (mark > 0))
    word_at = np.where(begins[at], np.cumsum(begins[at]) - 1, -1)
    return words, word_at, mark[at], np.searchsorted(offsets - offsets[0], at, side="right") - 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _parts(word: Column) -> Column:
    """A word and its stems, each stem with a *."""
    stems = [F.when(F.length(word) > k, F.array(F.concat(F.substring(word, 1, k), F.lit("*")))).otherwise(F.array().cast("array<string>")) for k in STEMS]
    return F.concat(F.array(word), *stems)


def _counted(train: DataFrame) -> DataFrame:
    """part (a word, or a stem with *), toxic and n: how many texts have it, of toxic ones and of all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            words, counts = folded_words(pc.utf8_lower(plain_text(batch.column("body"))))
            coded = pc.dictionary_encode(words)
            size = max(1, len(coded.dictionary))
            pair = np.unique(row_numbers(counts) * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[pair // size]
            n, bad = (np.bincount(pair % size, weights=w, minlength=size).astype(np.int64)[: len(coded.dictionary)] for w in (None, toxic))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(bad), pa.array(n)], ["word", "toxic", "n"])

    words = train.select("body", "toxic").mapInArrow(run, "word string, toxic bigint, n bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    return words.where(F.length("word") > 2).select(F.explode(_parts(F.col("word"))).alias("part"), "toxic", "n").groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def _lower_bound(hits: Column, n: Column) -> Column:
    """Wilson's lower bound of a share, with two standard deviations."""
    p = hits / n
    return (p + 2 / n - 2 * F.sqrt(p * (1 - p) / n + 1 / (n * n))) / (1 + 4 / n)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", toxic: str = "toxic", sample: int = SAMPLE) -> Grammar:
    """Lexicon and weights from the labelled documents that aren't held out, one of each text.

    Of more than sample labelled documents, those with the lowest hashes are taken. A label of several rows is toxic if
    one of them says so. Without labels, the fixed words and weights stand.
    """
    told = labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{toxic}`").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = told.count()
    if not n:
        return Grammar({}, START)
    told = told.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(min(1.0, sample / n) * (1 << 30)))
    train = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("body")).where(F.col("body").isNotNull()).join(told, "id")
    train = materialise(train.groupBy(F.xxhash64("body").alias("k1"), F.xxhash64(F.lit("second"), "body").alias("k2")).agg(F.first("body").alias("body"), F.max("toxic").alias("toxic")).drop("k1", "k2"), "labelled")
    return _fitted(train, _covering(train, _counted(train)))


def _covering(train: DataFrame, counted: DataFrame) -> dict[str, float]:
    """Parts that explain the toxic texts, with their share of toxic texts.

    Candidates are in SUPPORT toxic texts and surely in few others. In each round every toxic text without one picks
    the candidate that most such texts have, and those that ADDED texts pick are taken; of equal ones a whole word, then
    the longest stem. Texts and candidates stay on the cluster; a part for every ADDED texts, at most, reaches the driver.
    """
    good = counted.where((F.col("toxic") >= SUPPORT) & (_lower_bound(F.col("toxic"), F.col("n")) >= 0.4)).select("part", (F.col("toxic") / F.col("n")).alias("share"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            words, counts = folded_words(pc.utf8_lower(plain_text(batch.column("body"))))
            coded = pc.dictionary_encode(words)
            size = max(1, len(coded.dictionary))
            pair = np.unique(row_numbers(counts) * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(pair // size)), coded.dictionary.take(pa.array(pair % size))], ["id", "word"])

    texts = train.where("toxic = 1").withColumn("id", F.xxhash64("body")).select("id", "body")
    held = texts.mapInArrow(run, "id bigint, word string").where(F.length("word") > 2).select("id", F.explode(_parts(F.col("word"))).alias("part")).distinct()
    left, lexicon = materialise(held.join(good, "part"), "candidates"), {}
    order = F.struct("many", ~F.col("part").endswith("*"), F.length("part"), "part")
    while True:
        many = left.groupBy("part").agg(F.count("*").alias("many"))
        picks = left.join(many, "part").groupBy("id").agg(F.max(order).getField("part").alias("part"), F.max_by("share", order).alias("share"))
        taken = picks.groupBy("part").agg(F.count("*").alias("n"), F.first("share").alias("share")).where(F.col("n") >= ADDED).select("part", "share").collect()
        if not taken:
            return lexicon
        lexicon |= {r["part"]: r["share"] for r in taken}
        gone = left.sparkSession.createDataFrame([(r["part"],) for r in taken], "part string")
        left = materialise(left.join(left.join(gone, "part", "left_semi").select("id").distinct(), "id", "left_anti"), "candidates")


def _fitted(train: DataFrame, lexicon: dict[str, float], rounds: int = 300) -> Grammar:
    """The weights of matches, by gradient steps on the labelled texts from START, to which they are held, within bounds."""
    shared = train.sparkSession.sparkContext.broadcast(Grammar(lexicon, START))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            found = np.column_stack([batch.column("toxic").to_numpy(zero_copy_only=False), shared.value.matches(plain_text(batch.column("body")))]).round(6)
            kinds, many = np.unique(found, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in kinds], pa.binary()), pa.array(many.astype(np.int64))], ["kind", "n"])

    counted = train.select("body", "toxic").mapInArrow(run, "kind binary, n bigint").groupBy("kind").agg(F.sum("n").alias("n")).sort("kind").collect()
    if not counted:
        return Grammar(lexicon, START)
    kinds = np.stack([np.frombuffer(r["kind"]) for r in counted])
    n = np.array([r["n"] for r in counted], np.float64)
    x, y = np.column_stack([np.ones(len(kinds)), kinds[:, 1:]]), kinds[:, 0]
    weights, squares = START.copy(), np.full(len(START), 1e-8)
    for _ in range(rounds):
        gradient = x.T @ (n * (1 / (1 + np.exp(-(x @ weights))) - y)) / n.sum() + (weights - START) / n.sum()
        squares += gradient * gradient
        weights = bounded_weights(weights - 0.2 * gradient / np.sqrt(squares))
    return Grammar(lexicon, weights)


def score_toxicity(docs: DataFrame, grammar: Grammar, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row of docs with score, from 0 to 1, and predicted, 1 if the score is at least 0.5.

    Null and empty texts have no match and score what the intercept gives. Texts of any length are read whole. Repeated
    rows each get the same result; an empty table gives an empty one. Only the text is looked at; other columns pass
    through, but for those named like a result, which the result replaces.
    """
    keep = kept_columns(docs, keep, ["score", "predicted"])
    kept = [f"c{i}" for i in range(len(keep))]
    inner = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{text}`").cast("string").alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body"):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(shared.value.score(plain_text(batch.column("body"))))], [*kept, "score"])

    out = inner.mapInArrow(run, ", ".join([*(f"{k} {inner.schema[k].dataType.simpleString()}" for k in kept), "score double"]))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = learn(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, grammar, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
