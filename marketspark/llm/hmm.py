"""Language model scoring with a hidden Markov model.

A word is emitted in two steps: a state emits one of the word classes (a hash of the word), whose number grows with
the vocabulary up to a limit that bounds the model, and the class emits the word by its share
in the corpus: p(word) = sum over state paths of start, transition and emission of classes, times p(word | class) =
(c + 0.1) / (C + 0.1 * (V + 1)), where c counts the word, C its class and V the words of the class. Unseen words are
the one further word of their class. The second factor does not depend on the states, so the likelihood is exact: a
scaled forward recursion over the classes plus a sum over the words.

Training: word counts over all training texts; then Baum-Welch, stepwise: texts are dealt to slices, and after each slice the
model is renewed from expected counts in which newer slices weigh more. Every pass goes over all texts. Each partition
runs forward-backward over its whole texts and adds up expected starts, transitions and emissions; Spark adds the
partitions, block by block of the sums that they have; a number of sums for each class reaches the driver.

Counts of all words are a table in the shared folder. The most frequent (a bounded number) are shipped to the
tasks, so that a text only shuffles its rarer words, once each, to join the table. All that does not need the model comes from one
pass over the texts: classes, from which the model learns and by which it scores, and rare words, stored in the order of the words.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from marketspark.llm.common import fold, settled, shared_folder

SMOOTHING = 0.1


@dataclass(frozen=True)
class Settings:
    """states, least number of word classes (class 0 is the end), words of a class on the average beyond it and largest
    number of classes (None: no limit), passes (first_steps + steps, each over all texts; `sample` has no effect), slices of the texts
    after each of which the model is renewed, words of a text after which training keeps only the state it carries on, and the
    largest number of words shipped with the model."""

    states: int = 8
    classes: int = 2048
    class_size: int = 32
    steps: int = 2
    first_steps: int = 10
    sample: int = 2000
    piece: int = 1 << 16
    head: int = 40_000
    head_bytes: int = 64
    most_classes: int | None = None
    slices: int = 1


# Two passes over all texts, a step after each 32nd part of them; model and sums have at most 2 MB.
STEPWISE = Settings(first_steps=1, steps=1, slices=32, most_classes=1 << 15)
TASK_TOKENS = 1 << 22  # of a task of a step, on the average at least; each task shuffles its sums, about 1 MB, in every step
PART_BYTES = 8 << 20  # of texts that are encoded together
TAIL_ROWS = 1 << 16  # rare words that are stored as one row
FORGET = 0.6  # weight of step k's sums among those so far: (k + 1) to the power of minus this


class WordClasses(dict):
    """Class of a word; remembers a bounded number of words."""

    def __init__(self, classes: int):
        super().__init__()
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word) % (self.classes - 1) + 1
        if len(self) < 1 << 18:
            self[word] = found
        return found


class WordNumbers(dict):
    """Numbers words as they come. Each word is looked up once: its class, and its logarithm (not a number for words beyond the head)."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self.class_of, self.log_of = np.empty(0, np.int64), np.empty(0)

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        return found

    def look_up(self, logs: dict[bytes, float], classes: int) -> None:
        new = self.words[len(self.log_of) :]
        self.class_of = np.append(self.class_of, np.array([zlib.crc32(w) % (classes - 1) + 1 for w in new], np.int64))
        self.log_of = np.append(self.log_of, np.array([logs.get(w, np.nan) for w in new], float))


def _parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of a column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)) // most
    for at, end in pairwise([0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]):
        if at < end:
            yield batch.slice(at, end - at)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a whole text with A-Z in lower case; as bytes, lower() and split() know exactly A-Z and the six white spaces."""
    return text.lower().split() if text else []


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = sorted(counts)  # alike words stand together in the shuffle
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*map(counts.__getitem__, words)], pa.int64())], ["word", "c"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(tokens(text.as_py()))
            if len(counts) > 200_000:
                yield out()
                counts = Counter()
    yield out()


def _width(classes: int) -> type:
    return np.uint16 if classes <= 1 << 16 else np.uint32


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class x state

    @classmethod
    def first(cls, frequency: np.ndarray, states: int) -> Hmm:
        """Every state emits the corpus frequencies, disturbed by fixed noise that tells the states apart."""
        noise = np.random.default_rng(1)
        emit = (frequency + SMOOTHING)[:, None] * noise.uniform(0.3, 1.7, (len(frequency), states))
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def of_sums(cls, sums: np.ndarray, states: int, frequency: np.ndarray) -> Hmm:
        """Maximisation; a state's emissions are smoothed by the corpus frequencies, so none is 0."""
        start, move, emit = sums[:states] + SMOOTHING, sums[states : states + states**2].reshape(states, states) + SMOOTHING, sums[states + states**2 :].reshape(-1, states)
        prior = (frequency + SMOOTHING) / (frequency + SMOOTHING).sum()
        emit = emit + prior[:, None] * 10
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _padded(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of sequences of like length, the longest first: their numbers, their lengths and a time-major table."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        group = order[at : at + max(1, (1 << 19) // longest)]
        lengths = np.array([len(sequences[i]) for i in group])
        table = np.zeros((longest, len(group)), np.int64)
        for j, i in enumerate(group):
            table[: lengths[j], j] = sequences[i]
        yield group, lengths, table
        at += len(group)


SCALED = 8  # steps after which forward values are scaled again; no product of so many emissions comes near the least double


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each class sequence by the scaled forward recursion over its whole length."""
    result = np.zeros(len(sequences))
    for group, lengths, table in _padded(sequences):
        active = np.searchsorted(-lengths, -np.arange(len(table) + 1), side="left").tolist()  # sequences longer than t
        total = np.zeros(len(group))
        alpha = None
        for t in range(len(table)):
            n = active[t]
            alpha = (model.start if alpha is None else alpha[:n] @ model.move) * model.emit[table[t, :n]]
            first = 0 if t % SCALED == SCALED - 1 else active[t + 1]  # all, or the sequences that end here
            if first < n:
                scale = alpha[first:].sum(axis=1)
                total[first:n] += np.log10(scale)
                alpha[first:] /= scale[:, None]
        result[group] = total
    return result


def expected(model: Hmm, sequences: list[np.ndarray], piece: int = 1 << 16) -> np.ndarray:
    """Expected starts, transitions and emissions of all sequences by scaled forward-backward, as one array.

    Sequences run over their whole length. Of those longer than `piece` the first run keeps the forward values at the
    starts of pieces only; the pieces are run again from these, the last one first, and carry the backward values on.
    Only the two recursions go step by step, over rows that stand in the order of the steps; sums are over all rows of a piece.
    """
    k, c = len(model.start), len(model.emit)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    back = np.ascontiguousarray(model.move.T)

    def ahead(alpha: np.ndarray | None, edge: int, end: int) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
        """Classes of a piece, where its steps start, its forward values and its emissions, both scaled."""
        held = np.array(active[edge:end])
        seen = table[edge:end][np.arange(table.shape[1]) < held[:, None]]
        at = [0, *np.cumsum(held).tolist()]
        alphas, emit = np.empty((len(seen), k)), model.emit[seen]
        for t in range(edge, end):
            i, j = at[t - edge], at[t - edge + 1]
            here, n = alphas[i:j], j - i
            if alpha is None:
                np.multiply(model.start, emit[i:j], out=here)
            else:
                np.matmul(alpha[:n], model.move, out=here)
                here *= emit[i:j]
            first = 0 if t % SCALED == SCALED - 1 else active[t + 1]
            if first < n:
                scale = here[first:].sum(axis=1, keepdims=True)
                here[first:] /= scale
                emit[i + first : j] /= scale
            alpha = here
        return seen, at, alphas, emit

    for _, lengths, table in _padded(sequences):
        steps = len(table)
        active = np.searchsorted(-lengths, -np.arange(steps + 1), side="left").tolist()
        edges = range(0, steps, piece)
        held = [None]  # the forward values before each piece
        for edge in edges[:-1]:
            _, at, alphas, _ = ahead(held[-1], edge, edge + piece)
            held.append(alphas[at[-2] :].copy())
        later = None  # of the step after, emissions times backward values by its scale
        for edge in reversed(edges):
            alpha = held.pop()
            seen, at, alphas, shares = ahead(alpha, edge, min(edge + piece, steps))
            for i, j in zip(at[-2::-1], at[:0:-1]):  # emissions become those times backward values
                if later is not None:
                    shares[i : i + len(later)] *= later @ back
                later = shares[i:j]
            n, sizes = at[1], np.diff(at)
            later = later.copy()
            rest = alphas[np.arange(n, at[-1]) - np.repeat(sizes[:-1], sizes[1:])]  # the forward values a step before
            del alphas
            moves += rest.T @ shares[n:]
            shares[n:] *= rest @ model.move
            if alpha is None:
                shares[:n] *= model.start
                starts += shares[:n].sum(axis=0)
            else:
                moves += alpha[:n].T @ shares[:n]
                shares[:n] *= alpha[:n] @ model.move
            for s in range(k):
                emits[:, s] += np.bincount(seen, shares[:, s], c)
    return np.concatenate([starts, (moves * model.move).reshape(-1), emits.reshape(-1)])


BLOCK = 256  # rows of sums (start, moves, then one for each class) that are added up together


def _expectation(model: Hmm, piece: int):
    """Per partition the rows of sums that are not 0, by block: places in the block, and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.start) * (1 + len(model.start) + len(model.emit)))
        held, size, width = [], 0, _width(len(model.emit))
        for batch in batches:
            for value in batch.column(0):
                held.append(np.frombuffer(value.as_py(), width))
                size += len(held[-1])
                if size > 1 << 21:
                    total += expected(model, held, piece)
                    held, size = [], 0
        if held:
            total += expected(model, held, piece)
        rows = total.reshape(-1, len(model.start))
        some = np.flatnonzero(rows.any(axis=1))
        blocks, at = np.unique(some // BLOCK, return_index=True)
        parts = np.split(some, at[1:]) if len(some) else []
        places = [(p % BLOCK).astype(np.uint8).tobytes() for p in parts]
        values = [rows[p].astype(np.float32).tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["block", "places", "values"])

    return run


def _added(states: int):
    def run(part: pa.Table) -> pa.Table:
        sums = np.zeros((BLOCK, states))
        for places, values in zip(part["places"], part["values"]):
            sums[np.frombuffer(places.as_py(), np.uint8)] += np.frombuffer(values.as_py(), np.float32).reshape(-1, states)
        return pa.table([part["block"].slice(0, 1), pa.array([sums.tobytes()], pa.binary())], ["block", "sums"])

    return run


def expectations(sequences: DataFrame, model: Hmm, piece: int) -> np.ndarray:
    """Expected starts, transitions and emissions over all rows (classes): sums per partition, added up by Spark."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        return _expectation(shared.value, piece)(batches)

    k = len(model.start)
    rows = 1 + k + len(model.emit)
    sums = np.zeros((-(-rows // BLOCK) * BLOCK, k))
    parts = sequences.select("classes").mapInArrow(run, "block int, places binary, values binary")
    for r in parts.groupBy("block").applyInArrow(_added(k), "block int, sums binary").collect():
        sums[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums).reshape(BLOCK, k)
    shared.destroy()
    return sums[:rows].reshape(-1)


def baum_welch(sequences: DataFrame, model: Hmm, frequency: np.ndarray, piece: int) -> Hmm:
    """One step over all rows (classes)."""
    return Hmm.of_sums(expectations(sequences, model, piece), len(model.start), frequency)


@dataclass
class Corpus:
    """What the training texts give: table of counts (word, c), N, V, texts, class totals, and the words shipped with the model."""

    counts: DataFrame
    n: int
    v: int
    texts: int
    class_counts: np.ndarray
    class_words: np.ndarray
    head: dict[bytes, int]
    head_least: float


def count_corpus(train: DataFrame, settings: Settings) -> Corpus:
    counts = settled(train.select("text").mapInArrow(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).sortWithinPartitions("word"), "hmm-counts")
    texts = train.count()
    classes = max(settings.classes, -(-counts.count() // settings.class_size))
    if settings.most_classes is not None:
        classes = min(classes, settings.most_classes)
    cls = (F.crc32("word") % (classes - 1) + 1).cast("int")
    level = F.floor(F.log2("c") * 16).cast("int")
    class_counts, class_words = np.zeros(classes), np.zeros(classes)
    class_counts[0], class_words[0] = texts, 1
    found = counts.groupBy(cls.alias("cls")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()
    class_counts[found.cls], class_words[found.cls] = found.c, found.v
    # The head is all words from the lowest level of counts on at which they are few enough.
    short = counts.where(F.octet_length("word") <= settings.head_bytes)
    room, least = settings.head, None
    for r in sorted(short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r.level):
        if r.v > room:
            break
        room, least = room - r.v, r.level
    head = {} if least is None else {bytes(r.word): r.c for r in short.where(level >= least).collect()}
    n, v = int(class_counts.sum()), int(class_words[1:].sum()) + (texts > 0)
    return Corpus(counts, n, v, texts, class_counts, class_words, head, least)


@dataclass
class Encoder:
    """What the model's states do not bear on: classes of the words, sums over the words of the head, words beyond it."""

    head: dict[bytes, float]
    class_norm: np.ndarray  # log10(C + 0.1 * (V + 1)) per class; 0 for the end

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows, and apart from them those that teach, are numbered as monotonically_increasing_id does.
        row = teach = TaskContext.get().partitionId() << 33
        of = WordNumbers()
        for batch in batches:
            for part in _parts(batch, 2, PART_BYTES):
                if len(of) > 1 << 18:
                    of = WordNumbers()
                yield from self.encoded(part, of, row, teach)
                row, teach = row + part.num_rows, teach + part.num_rows - part.column(1).true_count

    def encoded(self, part: pa.RecordBatch, of: WordNumbers, row: int, teach: int) -> Iterator[pa.RecordBatch]:
        """The rows, then in further rows their rare words, once for each text, in the order of the words."""
        rows = part.num_rows
        found = [tokens(text.as_py()) for text in part.column(2)]
        lengths = np.array([len(w) for w in found])
        numbers = np.fromiter(map(of.__getitem__, chain.from_iterable(found)), np.int64, int(lengths.sum()))
        of.look_up(self.head, len(self.class_norm))
        doc, classes, logs = np.repeat(np.arange(rows), lengths), of.class_of[numbers], of.log_of[numbers]
        rare = np.isnan(logs)
        known = np.bincount(doc[~rare], minlength=rows)
        head = np.bincount(doc[~rare], logs[~rare], rows).astype(float)  # without words: of integers
        norms = np.bincount(doc, self.class_norm[classes], rows).astype(float)
        sequences = [np.append(c, 0).astype(_width(len(self.class_norm))).tobytes() for c in np.split(classes, np.cumsum(lengths)[:-1])]
        held = part.column(1).to_numpy(zero_copy_only=False)
        taught = pa.array(teach + np.cumsum(~held) - 1, mask=held)
        columns = [pa.array(np.arange(row, row + rows)), part.column(0), part.column(1), taught, pa.array(lengths + 1), pa.array(known), pa.array(head)]
        columns += [pa.array(norms), pa.array(sequences, pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(rows, _TAIL)], _ENCODED_NAMES)
        distinct, place = np.unique(numbers[rare], return_inverse=True)
        words = pa.array([of.words[i] for i in distinct.tolist()], pa.binary())
        order = pc.sort_indices(words)
        rank = np.empty(len(distinct), np.int64)
        rank[order.to_numpy()] = np.arange(len(distinct))
        pairs, tf = np.unique(rank[place] * rows + doc[rare], return_counts=True)
        if len(pairs):
            tail = pa.StructArray.from_arrays([words.take(order).take(pa.array(pairs // rows)), pa.array(pairs % rows + row), pa.array(tf, pa.int32())], fields=list(_TAIL.value_type))
            ends = pa.array([*range(0, len(pairs), TAIL_ROWS), len(pairs)], pa.int32())
            tails = pa.ListArray.from_arrays(ends, tail, type=_TAIL)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(tails), c.type) for c in columns), tails], _ENCODED_NAMES)


_TAIL = pa.list_(pa.struct([("word", pa.binary()), ("row", pa.int64()), ("tf", pa.int32())]))
_ENCODED = "row long, doc_id long, held_out boolean, taught long, n_tokens long, head_known long, head_sum double, norms double, classes binary, tail array<struct<word:binary,row:long,tf:int>>"
_ENCODED_NAMES = ["row", "doc_id", "held_out", "taught", "n_tokens", "head_known", "head_sum", "norms", "classes", "tail"]
HELD_OUT, TAIL = -1, -2  # slices of rows that do not teach


def encoded(rows: DataFrame, corpus: Corpus, settings: Settings) -> DataFrame:
    """Texts (doc_id, held_out, text) as classes of words, and their rare words, stored by the slice that they teach in: every text is split into words once for both."""
    spark = rows.sparkSession
    norm = np.log10(corpus.class_counts + SMOOTHING * (corpus.class_words + 1))
    norm[0] = 0.0
    encoder = spark.sparkContext.broadcast(Encoder({w: float(np.log10(c + SMOOTHING)) for w, c in corpus.head.items()}, norm))

    def run(batches):
        return encoder.value.batches(batches)

    dealt = F.pmod(F.xxhash64("taught"), F.lit(settings.slices)).cast("int")
    dealt = F.when(F.col("tail").isNotNull(), F.lit(TAIL)).when(F.col("held_out"), F.lit(HELD_OUT)).otherwise(dealt)
    path = f"{shared_folder(spark)}/hmm-texts-{uuid.uuid4().hex}"
    found = rows.select("doc_id", "held_out", "text").mapInArrow(run, _ENCODED).withColumn("slice", dealt)
    found.write.option("compression", "zstd").partitionBy("slice").parquet(path)
    encoder.destroy()
    return spark.read.schema(f"{_ENCODED}, slice int").parquet(path)


def train_model(train: DataFrame, corpus: Corpus, settings: Settings) -> Hmm:
    """The model of all texts (text as binary)."""
    rows = train.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    return fitted(encoded(rows, corpus, settings), corpus, settings)


def fitted(texts: DataFrame, corpus: Corpus, settings: Settings) -> Hmm:
    """The model of the encoded texts that teach."""
    model = Hmm.first(corpus.class_counts, settings.states)
    if not corpus.texts:
        return model
    slices = settings.slices
    # A task steps through its texts side by side, as many steps as the longest has words, so small parts of a slice are put together.
    tasks = max(1, -(-corpus.n // (slices * TASK_TOKENS)))
    sums, step = None, 0
    for _ in range(settings.first_steps + settings.steps):
        for i in range(slices):
            found = expectations(texts.where(F.col("slice") == i).coalesce(tasks), model, settings.piece)
            texts_seen = found[: settings.states].sum()
            if texts_seen == 0:
                continue
            # A slice stands for all texts; without slices a step replaces what was before it.
            share = 1.0 if slices == 1 else (step + 1) ** -FORGET
            found *= corpus.texts / texts_seen if slices > 1 else 1.0
            sums = found if sums is None else (1 - share) * sums + share * found
            model, step = Hmm.of_sums(sums, settings.states, corpus.class_counts), step + 1
    return model


def paths(texts: DataFrame, model: Hmm) -> DataFrame:
    """Encoded texts with `path`, log10 probability of their classes and of words in these, but for the words' counts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(len(shared.value.emit))
        for batch in batches:
            for part in _parts(batch, 7, PART_BYTES // 4):
                path = forward(shared.value, [np.frombuffer(value.as_py(), width) for value in part.column(7)])
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(path - part.column(6).to_numpy())], [*names, "path"])

    found = texts.where(F.col("slice") != TAIL).select(*names, "norms", "classes")
    return found.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, path double")


def score(docs: DataFrame, settings: Settings = STEPWISE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of documents (doc_id, text).

    Texts whose id has a crc32 that 10 divides are held out; a row with a null id teaches. A null or blank text is the
    end alone. Repeated rows teach and are scored as often as they stand. Without training texts every word is
    unseen; both scores are defined.
    """
    held = F.coalesce(fold(F.col("doc_id"), 10), F.lit(1)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    train = rows.where(~F.col("held_out"))
    corpus = count_corpus(train, settings)
    texts = encoded(rows, corpus, settings)
    scored = paths(texts, fitted(texts, corpus, settings))
    tail = texts.where(F.col("slice") == TAIL).select(F.inline("tail"))
    if corpus.head:  # words of the head never stand in a tail
        in_head = (F.floor(F.log2("c") * 16) >= corpus.head_least) & (F.octet_length("word") <= settings.head_bytes)
        rest = corpus.counts.where(~in_head)
    else:
        rest = corpus.counts
    # Words without a count add log10(0.1) each, so only the counted ones are joined: (c + 0.1) / 0.1 corrects them.
    lift = F.sum(F.col("tf") * F.log10((F.col("c") + SMOOTHING) / SMOOTHING))
    found = tail.join(rest, "word").groupBy("row").agg(lift.alias("lift"), F.sum("tf").alias("known"))
    rare = F.col("n_tokens") - 1 - F.col("head_known")
    total = F.lit(float(np.log10(corpus.n + SMOOTHING * (corpus.v + 1))))
    words = F.col("head_sum") + F.coalesce("lift", F.lit(0.0)) + rare * F.lit(float(np.log10(SMOOTHING)))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0)) + F.lit(int(corpus.texts > 0))).alias("n_known"),
        F.lit(corpus.n).cast("long").alias("train_tokens"),
        (words + F.lit(float(np.log10(corpus.texts + SMOOTHING))) - F.col("n_tokens") * total).alias("base_score"),
        (F.col("path") + words).alias("score"),
    )
