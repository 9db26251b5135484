"""Language-model scores by a hidden Markov model over the words of a corpus.

Words are counted over all training texts, with partial counts per task. The most frequent
words, up to HEAD of them, emit on their own, if they are there twice: words seen once say
how much to expect of words never seen. Every other word is emitted by way of its ending: a state
emits one of TAILS classes, and the class the word, in proportion to its count in the whole
corpus plus one. That factor is the same in every state, so it comes out of the recursion as
a sum over words, joined from the table of all counts; nothing is left out, and what is sent
to the tasks is bounded by HEAD, TAILS and STATES while the counts grow with the corpus.

Baum-Welch: each task runs the scaled forward and backward recursions over its own texts and
adds up expected counts; these are summed by Spark, a row per symbol, and give the next
model. Each of the ROUNDS rounds goes over all training texts, cut into stretches of at most
STRETCH symbols of which none is left out. Scores are exact: the forward recursion runs over whole texts, for very long
ones (LONG) as products of the segments' transition matrices, which are made side by side.

Defined results: a null text is empty and has the end alone; a null doc_id trains and is not
held out; rows that share a doc_id are scored and counted each; very long words count like
others but are never in the head; without training texts every word is unknown and states
are alike; an empty table gives an empty table. Other columns than doc_id and the text are
not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.util import per_worker, stage

STATES, HEAD, TAILS = 8, 32_000, 1024
#: Rounds, each over all training texts, and how many partitions of these a task of a round takes.
ROUNDS, MERGED = 12, 4
#: Symbols of a training sequence, and how many are held at once.
STRETCH, BLOCK = 256, 1 << 17
#: Places from one scaling of chances to the next: the product of that many, and of two such products, stays in the full range of
#: a double, as a state's part in a place is at least about 1e-22 for 1e12 tokens.
SCALED = 4
#: Symbols whose expected counts are added up at once, few enough to stay in a cache.
NEAR = 4096
#: Symbols from which a text is scored by segments, their length, and symbols scored side by side.
LONG, SEGMENT, SCORED = 1 << 16, 1 << 10, 1 << 21
#: Texts split and encoded at once.
ENCODED_ROWS = 500
#: Words that a task counts before it hands them on; bytes of the longest word kept as it is.
COUNTED, MOST_BYTES = 1 << 20, 64
#: Levels of frequency per doubling, at one of which the head ends.
LEVELS = 16
#: The key of the end, which no word can be; keys of long words begin with it.
END = b" "
#: Weight of the words' overall shares in a state, and of each transition, as counts.
PRIOR, STEP_PRIOR = 100.0, 1.0


def key_of(word: bytes) -> bytes:
    return word if len(word) <= MOST_BYTES else END + hashlib.sha256(word).digest()


@cache
def class_of(ending: bytes) -> int:
    """The class of a word by its last two bytes or only one."""
    return crc32(ending) % TAILS


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words one after the other, in lower case; Arrow's functions know ASCII alone."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, starts = split.flatten().cast(pa.binary()), split.offsets.to_numpy()
    there = np.asarray(pc.binary_length(flat)) > 0  # none is before white space at the start of a text and after that at its end
    return np.diff(np.concatenate([[0], np.cumsum(there)])[starts - starts[0]]), flat if there.all() else flat.filter(pa.array(there))


def keys_of(words: pa.Array) -> pa.Array:
    long = np.asarray(pc.binary_length(words)) > MOST_BYTES
    return pc.replace_with_mask(words, pa.array(long), pa.array([key_of(w.as_py()) for w in words.filter(pa.array(long))], pa.binary())) if long.any() else words


def classes_of(words: pa.Array) -> np.ndarray:
    endings = pc.binary_slice(words, -2).dictionary_encode()
    return np.array([class_of(e) for e in endings.dictionary.to_pylist()], "i4")[np.asarray(endings.indices)]


def counted(docs: DataFrame, text: str) -> DataFrame:
    """(key, class, n) of every word of the texts, and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(held: list[pa.Array], ends: int) -> pa.RecordBatch:
            words, n = pc.value_counts(pa.chunked_array(held, pa.binary())).flatten()
            each = [keys_of(words), pa.array(classes_of(words)), n]
            end = [pa.array([END]), pa.array([class_of(END)], pa.int32()), pa.array([ends])]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in zip(each, end)], ["key", "class", "n"])

        held, size, ends = [], 0, 0
        for batch in batches:
            for part in (batch[0].slice(at, ENCODED_ROWS) for at in range(0, batch.num_rows, ENCODED_ROWS)):
                held.append(words_of(part)[1])
                size, ends = size + len(held[-1]), ends + len(part)
                if size > COUNTED:
                    yield handed(held, ends)
                    held, size, ends = [], 0, 0
        if ends:
            yield handed(held, ends)

    slim = docs.select(F.col(text).cast("string"))
    return slim.mapInArrow(run, "key binary, class int, n long").groupBy("key", "class").agg(F.sum("n").alias("n"))


class Corpus(NamedTuple):
    """What the counts say: total tokens and different ones, the head (word, count), how often the end stands, and (tokens, words) of the tail classes."""

    total: int
    different: int
    head: list[tuple[bytes, int]]
    ends: int
    tails: np.ndarray

    @property
    def symbols(self) -> int:
        return TAILS + 1 + len(self.head)

    def counts(self) -> np.ndarray:
        """Training tokens of each symbol: classes, the end, the head."""
        return np.concatenate([self.tails[:, 0], [self.ends], [n for _, n in self.head]]).astype(float)


def surveyed(counts: DataFrame) -> Corpus:
    total, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where(F.col("key") == F.lit(END)).select("n").first()
    plain = counts.where((F.col("n") > 1) & (F.octet_length("key") <= MOST_BYTES) & (F.substring("key", 1, 1) != F.lit(END)))
    level = F.floor(F.log2("n") * LEVELS)  # a few hundred levels, whatever the corpus
    least, left = 0, HEAD
    for r in plain.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        left -= r["count"]
        if left < 0:
            least = r["level"] + 1
            break
    head = sorted((bytes(r["key"]), r["n"]) for r in plain.where(level >= least).select("key", "n").collect())  # HEAD rows at most
    tails = np.zeros((TAILS, 2), dtype="i8")
    for r in counts.where(F.col("key") != F.lit(END)).groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # TAILS rows
        tails[r["class"]] = r["n"], r["v"]
    for word, n in head:
        tails[class_of(word[-2:])] -= n, 1
    return Corpus(total, different, head, ends["n"] if ends else 0, tails)


ENCODED = "doc_id long, held_out boolean, n_tokens long, known long, base double, rest double, symbols binary, tail array<struct<key:binary,times:long>>"


def encoded(docs: DataFrame, corpus: Corpus, text: str) -> DataFrame:
    """Every text as symbols and its tail words, with all but these words' counts that goes into the base score and, beside the symbols, into the score. id numbers the rows."""
    sent = docs.sparkSession.sparkContext.broadcast([w for w, _ in corpus.head])
    shares = (corpus.counts() + 1) / (corpus.total + corpus.different + 1)
    logs = np.where(np.arange(corpus.symbols) < TAILS, -np.log10(corpus.total + corpus.different + 1), np.log10(shares))
    # A class has room for its tokens and words outside of the head, and one for a word never seen.
    room = np.zeros(corpus.symbols)
    room[:TAILS] = -np.log10(corpus.tails.sum(1) + 1)
    known_end, mine = corpus.ends > 0, uuid.uuid4().hex  # workers outlive a run, so what they keep is named after it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = per_worker(("hmm", mine), lambda: pa.array(sent.value, pa.binary()))
        for batch in batches:
            for part in (batch.slice(at, ENCODED_ROWS) for at in range(0, batch.num_rows, ENCODED_ROWS)):
                rows = part.num_rows
                sizes, words = words_of(part[2])
                text_of = np.repeat(np.arange(rows), sizes)
                places = np.asarray(pc.index_in(words, value_set=heads).fill_null(-1))
                rare = np.flatnonzero(places < 0)
                tail = words.take(pa.array(rare)).dictionary_encode()
                codes, classes = np.asarray(tail.indices, "i8"), classes_of(tail.dictionary)
                found = TAILS + 1 + places
                found[rare] = classes[codes]
                ends = np.cumsum(sizes + 1)
                symbols = np.full(len(words) + rows, TAILS, "<u2")
                symbols[np.arange(len(words)) + text_of] = found
                # Each text's different tail words, one after the other.
                pairs, times = np.unique(text_of[rare] * len(classes) + codes, return_counts=True)
                of, codes = np.divmod(pairs, max(len(classes), 1))
                each = [keys_of(tail.dictionary).take(pa.array(codes)), pa.array(times)]
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)), pa.int32()), pa.StructArray.from_arrays(each, ["key", "times"]))
                packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype("i4")), pa.py_buffer(symbols)])
                known = sizes - np.bincount(text_of[rare], minlength=rows) + known_end
                base, rest = (pa.array(np.add.reduceat(of_symbol[symbols], ends - sizes - 1)) for of_symbol in (logs, room))
                yield pa.RecordBatch.from_arrays([part[0], part[1], pa.array(sizes + 1), pa.array(known), base, rest, packed, tails],
                                                 ["doc_id", "held_out", "n_tokens", "known", "base", "rest", "symbols", "tail"])

    slim = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")), F.col(text).cast("string"))
    return slim.mapInArrow(run, ENCODED).withColumn("id", F.monotonically_increasing_id())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False)).alias("held_out")


class Model(NamedTuple):
    """Chances of the first state, of any state, of the next state after each, and of each symbol in each state."""

    first: np.ndarray
    usual: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbols x states


def started(corpus: Corpus) -> Model:
    """Even chances, each symbol scattered over the states by fixed random weights."""
    random = np.random.default_rng(29)
    emit = (corpus.counts()[:, None] + 1) * random.gamma(1.0, size=(corpus.symbols, STATES))
    even = np.full(STATES, 1 / STATES)
    step = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Model(even, even, step, emit / emit.sum(0))


class Packed:
    """Sequences of different lengths, longest first, laid out place by place: rows from ends[t] to ends[t + 1] are place t of all that reach it."""

    def __init__(self, rows: list[np.ndarray]):
        lengths = np.array([len(r) for r in rows])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        reach = np.bincount(self.lengths, minlength=self.lengths[0] + 1)
        self.width = len(rows) - np.cumsum(reach)[:-1]  # at place t: sequences longer than t
        self.ends = np.concatenate([[0], np.cumsum(self.width)])
        flat = np.concatenate([rows[i] for i in self.order])
        begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        places = np.arange(len(flat), dtype="i4") - np.repeat(begins.astype("i4"), self.lengths)
        self.symbols = np.empty(len(flat), flat.dtype)
        self.symbols[self.ends.astype("i4")[places] + np.repeat(np.arange(len(rows), dtype="i4"), self.lengths)] = flat


class Expected:
    """Expected counts of a task under a model. Tables here have a row per place, so that all of a place's sequences lie side by side."""

    def __init__(self, model: Model):
        self.model, self.chances = model, np.ascontiguousarray(model.emit)
        self.first, self.step, self.log = np.zeros(STATES), np.zeros((STATES, STATES)), 0.0
        self.pairs = np.zeros((STATES // 2, len(model.emit)), complex)  # of two states at a time, as the parts of a complex number
        self.room = np.empty((0, STATES))

    @property
    def emit(self) -> np.ndarray:
        return np.ascontiguousarray(self.pairs.T).view(float)

    def add(self, rows: list[np.ndarray], begins: list[bool]) -> None:
        """Forward and backward over the sequences; begins says which start a text.

        Chances are scaled to a sum of 1 at every SCALED-th place only: between them they get small, but far from
        vanishing. What a sequence's last place sums to is where its way back starts.
        """
        laid, m = Packed(rows), self.model
        ends, symbols, fresh = laid.ends.tolist(), laid.symbols.astype("i8"), np.array(begins)[laid.order]
        if len(symbols) > len(self.room):
            self.room = np.empty((len(symbols), STATES))
        forward, here, totals = self.room[: len(symbols)], np.empty((len(rows), STATES)), {}
        back, last = np.ascontiguousarray(m.step.T), np.empty((len(rows), 1))
        near = np.where(fresh[:, None], m.first, m.usual)  # what is expected at the next place; on the way back, what follows
        for t, (at, end) in enumerate(zip(ends, ends[1:])):
            now, met = forward[at:end], ends[min(t + 2, len(ends) - 1)] - end
            chance = self.chances.take(symbols[at:end], axis=0, out=here[: end - at], mode="clip")  # all are in range; "clip" spares a copy
            np.multiply(near[: end - at], chance, out=now)
            if t % SCALED == SCALED - 1:
                total = totals[at] = now.sum(1, keepdims=True)
                now /= total
                self.log += float(np.log10(total).sum())
            if met < end - at:
                last[met : end - at] = now[met:].sum(1, keepdims=True)
            np.matmul(now[:met], m.step, out=near[:met])
        self.log += float(np.log10(last).sum())
        near[:] = 1 / last
        rest, paths, met, done = np.empty_like(near), np.zeros((STATES, STATES)), 0, len(symbols)
        for at, end in zip(ends[-2::-1], ends[:0:-1]):
            now = forward[at:end]
            paths += now[:met].T @ rest[:met]
            np.matmul(rest[:met], back, out=near[:met])
            met = end - at
            chance = self.chances.take(symbols[at:end], axis=0, out=here[:met], mode="clip")  # once more: cheaper than to keep and fetch it
            np.multiply(near[:met], chance, out=rest[:met])
            if at in totals:
                rest[:met] /= totals[at]
            now *= near[:met]
            if done - at >= NEAR or at == 0:
                for total, weights in zip(self.pairs, forward[at:done].view(complex).T.copy()):
                    np.add.at(total, symbols[at:done], weights)
                done = at
        self.first += forward[: ends[1]][fresh].sum(0)
        self.step += paths * m.step


def trained(texts: DataFrame, model: Model, corpus: Corpus) -> tuple[Model, float]:
    """The model after one round of Baum-Welch over the texts (symbols), and their log10 likelihood under the one before."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected, rows, begins, size = Expected(sent.value), [], [], 0
        for batch in batches:
            for value in batch[0]:
                row = np.frombuffer(value.as_buffer(), "<u2")
                for at in range(0, len(row), STRETCH):
                    rows.append(row[at : at + STRETCH])
                    begins.append(at == 0)
                    size += len(rows[-1])
                    if size >= BLOCK:
                        expected.add(rows, begins)
                        rows, begins, size = [], [], 0
        if rows:
            expected.add(rows, begins)
        emit = expected.emit
        met = np.flatnonzero(emit.any(1))
        table = np.concatenate([emit[met], expected.step, [expected.first], [[expected.log] * STATES]])
        labels = np.concatenate([met, -1 - np.arange(STATES), [-1 - STATES, -2 - STATES]])
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), *(pa.array(table[:, k]) for k in range(STATES))], ["row", *names])

    kinds = ", ".join(f"{c} double" for c in names)
    found = texts.select("symbols").mapInArrow(run, f"row int, {kinds}").groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a row per symbol
    sent.unpersist()
    whole = np.zeros((corpus.symbols + STATES + 2, STATES))
    whole[found["row"].to_numpy()] = found[names].to_numpy()  # negative rows count from the end
    emit, log, first, step = whole[: corpus.symbols], whole[-2 - STATES, 0], whole[-1 - STATES], whole[: -1 - STATES : -1]
    share = corpus.counts() + 1
    emit = emit + PRIOR * (share / share.sum())[:, None]
    usual, first, step = emit.sum(0), first + STEP_PRIOR, step + STEP_PRIOR
    return Model(first / first.sum(), usual / usual.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0)), float(log)


def learned(texts: DataFrame, corpus: Corpus) -> Model:
    """ROUNDS rounds of Baum-Welch, each over all of the texts."""
    parts, cores = texts.rdd.getNumPartitions(), texts.sparkSession.sparkContext.defaultParallelism
    # Each task hands on a row per symbol, so a task takes a few files' texts one after the other.
    every, model = texts.coalesce(max(min(parts, cores), parts // MERGED)), started(corpus)
    for _ in range(ROUNDS):
        model, _ = trained(every, model, corpus)
    return model


def likelihoods(rows: list[np.ndarray], model: Model) -> np.ndarray:
    """The log10 likelihood of each sequence, by the scaled forward recursion."""
    laid = Packed(rows)
    logs, near, ends, emit = np.zeros(len(rows)), np.tile(model.first, (len(rows), 1)), laid.ends.tolist(), np.ascontiguousarray(model.emit)
    for t, (at, end) in enumerate(zip(ends, ends[1:])):
        now, met = emit.take(laid.symbols[at:end], axis=0, mode="clip"), ends[min(t + 2, len(ends) - 1)] - end
        now *= near[: end - at]
        if t % SCALED == SCALED - 1:
            total = now.sum(1, keepdims=True)
            now /= total
            logs[: end - at] += np.log10(total[:, 0])
        if met < end - at:
            logs[met : end - at] += np.log10(now[met:].sum(1))
        np.matmul(now[:met], model.step, out=near[:met])
    out = np.empty(len(rows))
    out[laid.order] = logs
    return out


def likelihood_long(row: np.ndarray, model: Model) -> float:
    """The same of one very long sequence: each segment's matrix from state to state first, all side by side, then one after the other."""
    whole = row[: len(row) // SEGMENT * SEGMENT].reshape(-1, SEGMENT)
    made, logs = np.broadcast_to(np.eye(STATES), (len(whole), STATES, STATES)), np.zeros(len(whole))
    for t in range(SEGMENT):  # the step into the segment's first symbol counts to it
        made = (made.reshape(-1, STATES) @ model.step).reshape(-1, STATES, STATES) * model.emit[whole[:, t]][:, None, :]
        total = made.sum((1, 2))
        made, logs = made / total[:, None, None], logs + np.log10(total)
    # No step leads into the first symbol of all: start from what becomes the first chances after one.
    now, log = model.first, float(logs[1:].sum())
    for t in range(SEGMENT):
        now = (now if t == 0 else now @ model.step) * model.emit[whole[0, t]]
        log += float(np.log10(now.sum()))
        now = now / now.sum()
    for matrix in made[1:]:
        now = now @ matrix
        log += float(np.log10(now.sum()))
        now = now / now.sum()
    for symbol in row[whole.size :]:
        now = (now @ model.step) * model.emit[symbol]
        log += float(np.log10(now.sum()))
        now = now / now.sum()
    return log


def forward(texts: DataFrame, model: Model) -> DataFrame:
    """(id, doc_id, held_out, n_tokens, known, base, rest, log): the log10 likelihood of each text's symbols."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    kept = ["id", "doc_id", "held_out", "n_tokens", "known", "base", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            rows = [np.frombuffer(v.as_buffer(), "<u2") for v in table["symbols"]]
            logs = np.empty(len(rows))
            short = [i for i, r in enumerate(rows) if len(r) <= LONG]
            if short:
                logs[short] = likelihoods([rows[i] for i in short], sent.value)
            for i, r in enumerate(rows):
                if len(r) > LONG:
                    logs[i] = likelihood_long(r, sent.value)
            return table.drop_columns("symbols").append_column("log", pa.array(logs)).to_batches()[0]

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("symbols").nbytes // 2
            if size >= SCORED:
                yield scored(held)
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield scored(held)

    return texts.select(*kept, "symbols").mapInArrow(run, "id long, doc_id long, held_out boolean, n_tokens long, known long, base double, rest double, log double")


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    counts = stage(counted(docs.where(~held_out(F.col("doc_id"))), text), "hmm-counts")
    corpus = surveyed(counts)
    texts = stage(encoded(docs, corpus, text), "hmm-texts")
    model = learned(texts.where("NOT held_out"), corpus)
    # A tail word's count goes into both scores alike; one never seen adds log10(0 + 1).
    tail = texts.select("id", F.inline("tail")).join(counts.select("key", F.log10(F.col("n") + 1).alias("seen")), "key", "left")
    added = tail.groupBy("id").agg(F.sum(F.col("times") * F.col("seen")).alias("more"), F.sum(F.when(F.col("seen").isNotNull(), F.col("times"))).alias("more_known"))
    found = forward(texts, model).join(added, "id", "left").na.fill(0, ["more", "more_known"])
    return found.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(corpus.total).cast("long").alias("train_tokens"),
                        (F.col("base") + F.col("more")).alias("base_score"), (F.col("log") + F.col("rest") + F.col("more")).alias("score"))


def op13_language_model_scores(docs: DataFrame) -> DataFrame:
    return score(docs)
