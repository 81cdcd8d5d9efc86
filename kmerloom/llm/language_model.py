"""A hidden Markov language model. Counts of neighbouring words of all training texts give the latent states to start from, Baum-Welch counts of all training texts, added up over the partitions, train them; the scaled forward recursion gives the exact likelihood of a text.

Words are observed through classes: a word's class is a function of its hash, and a state emits a class, the class a word. P(word | class) is the word's share of the class's counts plus one, so what the model keeps for states is bounded, and counts of single words cover the whole corpus.

Texts are written once as blocks of word numbers, each block with its own dictionary; counts of words are joined to the dictionaries, not to the texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import documents, field, materialize, only
from kmerloom.llm.language_id import remainder
from kmerloom.llm.textkit import slices, words

STATES, CLASSES = 6, 8192
#: Passes of Baum-Welch over all training texts end when one has gained less than this share of the log-likelihood, and after so many.
GAIN, PASSES = 0.002, 12
#: Where the passes start from: states fitted to counts of neighbours in all training texts, a class beside so many contexts. So many fits begin with noise, each makes so many steps, and the likeliest so many more.
CONTEXTS, FITS, STEPS, LAST_STEPS = 128, 4, 40, 80
#: Counts that a row holds on their way to the driver.
PIECE = 512
#: Words of a block of texts, and texts that the recursions run through side by side.
BLOCK, LANES = 1 << 20, 512
END = np.uint64(0x51ED270B27B4F3CF)


def planes(numbers: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers (32-bit) byte by byte, all lowest bytes first: most higher ones are 0, which compresses."""
    return np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()


def from_planes(data: bytes, kind: str = "<i4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Model:
    """Start, transition and emission probabilities; the text's end is a class of its own, the last."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """Smoothed: a state's emissions lean on those of all states."""
        share = (emit.sum(0) + 0.5) / (emit.sum() + 0.5 * emit.shape[1])
        weight = 0.01 * emit.sum(1, keepdims=True) + 50
        emit = (emit + weight * share) / (emit.sum(1, keepdims=True) + weight)
        return Model((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), emit)


def classes(hashes: np.ndarray, n: int = CLASSES) -> np.ndarray:
    return np.where(hashes == END, n, (hashes >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


class Lanes:
    """Texts laid end to end in lanes of about equal length, the longest first: step t takes the t-th word of every lane that has one."""

    def __init__(self, lengths: np.ndarray, lanes: int = LANES):
        order = np.argsort(-lengths, kind="stable")
        lanes = max(1, min(lanes, len(lengths), int(lengths.sum()) // max(1, int(lengths.max())) + 1))
        loads, put = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for d in order:
            load, i = heapq.heappop(loads)
            put[i].append(d)
            heapq.heappush(loads, (load + int(lengths[d]), i))
        put.sort(key=lambda x: -int(lengths[x].sum()))
        size = np.array([int(lengths[x].sum()) for x in put])
        first = np.concatenate([[0], np.cumsum(lengths)])
        active = len(size) - np.searchsorted(size[::-1], np.arange(size.max()), "right")
        self.at = np.concatenate([[0], np.cumsum(active)])
        #: For each text, word by word, the place of its words in the order of steps.
        self.place = np.empty(int(lengths.sum()), np.int64)
        self.opens = np.zeros(len(self.place), bool)
        for lane, texts in enumerate(put):
            t = 0
            for d in texts:
                n = int(lengths[d])
                self.place[first[d] : first[d + 1]] = self.at[t : t + n] + lane
                self.opens[self.at[t] + lane] = True
                t += n


def forward(seen: np.ndarray, lanes: Lanes, model: Model, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The scale of each step's word, in the order of steps (their logarithms add up to the text's log-likelihood); with `keep` also the scaled forward probabilities."""
    emit = np.ascontiguousarray(model.emit.T)
    scale = np.empty(len(seen))
    kept = np.empty((len(seen), len(model.start)), np.float32) if keep else None
    now = np.zeros((0, len(model.start)))
    for t in range(len(lanes.at) - 1):
        a, b = lanes.at[t], lanes.at[t + 1]
        opens = lanes.opens[a:b]
        if t:
            now = now[: b - a] @ model.move
            if opens.any():
                now[opens] = model.start
        else:
            now = np.tile(model.start, (b - a, 1))
        now *= emit[seen[a:b]]
        c = now.sum(1)
        now /= c[:, None]
        scale[a:b] = c
        if keep:
            kept[a:b] = now
    return scale, kept


def expect(seen: np.ndarray, lanes: Lanes, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions, and the log-likelihood."""
    scale, alpha = forward(seen, lanes, model, keep=True)
    emit = np.ascontiguousarray(model.emit.T)
    moves = np.zeros_like(model.move)
    steps = len(lanes.at) - 1
    ahead = None  # of the words one step on: emission times backward probability over scale; 0 where a text opens
    for t in range(steps - 1, -1, -1):
        a, b = lanes.at[t], lanes.at[t + 1]
        back = np.ones((b - a, len(model.start)))
        if ahead is not None:
            n = len(ahead)
            closed = lanes.opens[b : b + n]
            moves += alpha[a : a + n].T @ ahead
            back[:n] = np.where(closed[:, None], 1.0, ahead @ model.move.T)
        ahead = emit[seen[a:b]] * back / scale[a:b, None]
        ahead[lanes.opens[a:b]] = 0
        alpha[a:b] *= back
    starts = alpha[lanes.opens].sum(0, dtype=float)
    emits = np.stack([np.bincount(seen, alpha[:, k], minlength=model.emit.shape[1]) for k in range(len(starts))])
    return starts, moves * model.move, emits, float(np.log(scale).sum())


def contexts(mass: np.ndarray, n: int = CONTEXTS) -> np.ndarray:
    """The context of each class: of n contexts the heaviest classes have half for themselves and the end has the last, the other classes share the rest."""
    n_classes = len(mass) - 1
    n = min(n, n_classes + 1)
    own = n // 2
    rank = np.empty(n_classes, np.int64)
    rank[np.argsort(-mass[:-1], kind="stable")] = np.arange(n_classes)
    return np.append(np.where(rank < own, rank, own + (rank - own) % max(1, n - 1 - own)), n - 1)


def fit_step(before: np.ndarray, after: np.ndarray, context: np.ndarray, pair: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected counts of pairs of states and of emissions, and the log-likelihood of the neighbours. before, after: how often a class stands directly before or after a context; pair: the probability of two states side by side."""
    wide = np.zeros((context.max() + 1, len(pair)))
    np.add.at(wide, context, emit.T)
    wide, small = wide.T, emit.astype(np.float32)
    moves, emits, beside, like = np.zeros_like(pair), np.zeros_like(emit), np.zeros_like(wide), 0.0
    for seen, turn in ((before, pair), (after, pair.T)):  # turn: state of the class, state of the context
        chance = (turn @ wide).T.astype(np.float32) @ small
        like += float((seen * np.log(chance)).sum(dtype=float))
        ratio = seen / chance
        classes_ = (ratio @ small.T).astype(float).T
        own = turn * (classes_ @ wide.T)
        moves += own if turn is pair else own.T
        emits += turn @ (wide.astype(np.float32) @ ratio).astype(float)
        beside += turn.T @ classes_
    return moves, emit * (emits + beside[:, context]), like


def start_model(before: np.ndarray, after: np.ndarray, opens: np.ndarray, context: np.ndarray, states: int = STATES) -> Model:
    """Where training starts: expectation-maximisation over the counts of neighbours, from emissions that differ by noise. opens: how often a class opens a text."""
    rng = np.random.Generator(np.random.PCG64(8))
    often = opens + after.sum(0) + 0.1
    before, after = before.astype(np.float32), after.astype(np.float32)

    def steps(n: int, pair: np.ndarray, emit: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        for _ in range(n):
            moves, emits, like = fit_step(before, after, context, pair, emit)
            pair, emit = (moves + 0.1) / (moves + 0.1).sum(), Model.from_counts(np.ones(states), moves, emits).emit
        return like, pair, emit

    fits = []
    for _ in range(FITS):
        emit = often * (0.5 + rng.gamma(1.0, size=(states, len(opens))))
        pair = np.full((states, states), 0.1) + np.eye(states) * 20
        fits.append(steps(STEPS, pair / pair.sum(), emit / emit.sum(1, keepdims=True)))
    _, pair, emit = steps(LAST_STEPS, *max(fits, key=lambda x: x[0])[1:])
    first = pair.sum(1, keepdims=True) * emit
    start = (first / first.sum(0)) @ opens + 0.1
    return Model(start / start.sum(), pair / pair.sum(1, keepdims=True), emit)


def _blocks(size: int):
    """Rows of the block table: block, ids, held, sizes (words of each text, its end included), tokens (32-bit numbers into words, in planes), words (64-bit hashes), counts (of each in training texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, held, sizes, hashes, total = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, ids, held, sizes, hashes, total
            size, out = np.concatenate(sizes), np.concatenate(held)
            own, number, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(own), np.int32)
            rank[order] = np.arange(len(own), dtype=np.int32)
            own, number = own[order], rank[number]
            counts = np.bincount(number[~np.repeat(out, size)], minlength=len(own))
            columns = [pa.array([block]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([out.tolist()], pa.list_(pa.bool_())), pa.array([size.astype(np.int32).tobytes()], pa.binary()), pa.array([planes(number)], pa.binary())]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(x, pa.int64())) for x in (own.view(np.int64), counts.astype(np.int64))]
            block, ids, held, sizes, hashes, total = block + 1, [], [], [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "held", "sizes", "tokens", "words", "counts"])

        for batch in batches:
            flags = np.array([bool(x) for x in batch.column("__held").to_pylist()], bool)
            for s in slices(batch.column("__text")):
                w = words(s)
                n = np.diff(w.first)
                tokens = np.full(len(w.begins) + len(n), END)
                tokens[np.arange(len(w.begins)) + np.repeat(np.arange(len(n)), n)] = w.hashes()
                ids.append(batch.column("__id").slice(s.lo, s.hi - s.lo))
                held.append(flags[s.lo : s.hi])
                sizes.append(n + 1)
                hashes.append(tokens)
                total += len(tokens)
                if total >= size:
                    yield close()
        if ids:
            yield close()

    return run


def _training(batch: pa.RecordBatch, i: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a block's training texts, end to end, and the texts' lengths."""
    size = np.frombuffer(batch.column("sizes")[i].as_py(), np.int32).astype(np.int64)
    held = np.array(batch.column("held")[i].as_py(), bool)
    if held.all():
        return np.empty(0, np.int32), size[:0]
    cls = classes(batch.column("words")[i].values.to_numpy().view(np.uint64), n_classes)
    return cls[from_planes(batch.column("tokens")[i].as_py())][~np.repeat(held, size)], size[~held]


def _neighbours(context: np.ndarray):
    """Counts of a partition's training texts: for each context how often a class stands directly before it, then after it, and how often a class opens a text. One sequence of numbers, in rows of PIECE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, n = len(context), int(context.max()) + 1
        total = np.zeros((2 * n + 1) * wide, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                seen, size = _training(batch, i, wide - 1)
                opens = np.cumsum(size) - size
                inside = np.ones(len(seen), bool)
                inside[opens] = False
                at = np.flatnonzero(inside)
                left, right = seen[at - 1], seen[at]
                total[: n * wide] += np.bincount(context[right] * wide + left, minlength=n * wide)
                total[n * wide : -wide] += np.bincount(context[left] * wide + right, minlength=n * wide)
                total[-wide:] += np.bincount(seen[opens], minlength=wide)
        pieces = [(i, x) for i in range(-(-len(total) // PIECE)) if (x := total[i * PIECE : (i + 1) * PIECE]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int32()), pa.array([planes(x, "<i8") for _, x in pieces], pa.binary())], names=["i", "v"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each piece in a partition: the sum of its rows."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True):
            own = from_planes(v, "<i8")
            total[i] = total[i] + own if i in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([planes(x, "<i8") for x in total.values()], pa.binary())], names=["i", "v"])


def neighbours(blocks: DataFrame, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often a class stands directly before and after a context and how often it opens a text, in all training texts of the blocks. Pieces of the partitions' counts are added up by the cluster; the driver gets as many numbers as there are classes by contexts, twice."""
    schema, wide, n = "i int, v binary", len(context), int(context.max()) + 1
    total = np.zeros((2 * n + 1) * wide, np.int64)
    for i, v in blocks.select("held", "sizes", "tokens", "words").mapInArrow(_neighbours(context), schema).repartition("i").mapInArrow(_added, schema).collect():
        total[i * PIECE : (i + 1) * PIECE] += from_planes(v, "<i8")
    return total[: n * wide].reshape(n, wide), total[n * wide : -wide].reshape(n, wide), total[-wide:]


def _expect(shared, n_classes: int):
    """Expected counts of a partition's training texts, in one row of numbers: starts, moves, emissions, log-likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, None
        for batch in batches:
            for i in range(batch.num_rows):
                seen, size = _training(batch, i, n_classes)
                if not len(size):
                    continue
                lanes = Lanes(size)
                ordered = np.empty_like(seen)
                ordered[lanes.place] = seen
                starts, moves, emits, like = expect(ordered, lanes, model)
                own = np.concatenate([starts, moves.ravel(), emits.ravel(), [like]])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    return run


def _score(shared, n_classes: int):
    """Scores of a block's texts. shared: model, counts plus one of each class, training words N, distinct training words V."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, mass, n_train, n_distinct = shared.value
        left = left.combine_chunks()
        size = np.frombuffer(left.column("sizes")[0].as_py(), np.int32).astype(np.int64)
        own = left.column("words")[0].values.to_numpy().view(np.uint64)
        number = from_planes(left.column("tokens")[0].as_py())
        count = np.zeros(len(own), np.int64)
        count[right.column("local").to_numpy()] = right.column("c").to_numpy()
        cls = classes(own, n_classes)
        word = np.log10((count + 1) / (n_train + n_distinct + 1))
        inside = np.where(cls == n_classes, 0.0, np.log10((count + 1) / mass[cls]))
        lanes = Lanes(size)
        seen = np.empty(len(number), np.int32)
        seen[lanes.place] = cls[number]
        scale, _ = forward(seen, lanes, model)
        first = np.cumsum(size) - size
        add = lambda x: np.add.reduceat(x, first)
        ids = left.column("ids")[0].values
        return pa.table({"__id": ids, "held_out": left.column("held")[0].values, "n_tokens": size, "n_known": add((count > 0)[number].astype(np.int64)), "base_score": add(word[number]), "score": add(np.log10(scale)[lanes.place]) + add(inside[number])})

    return run


def train(blocks: DataFrame, model: Model, gain: float = GAIN, passes: int = PASSES) -> tuple[Model, list[float]]:
    """The model after Baum-Welch over all training texts of the blocks, and the log-likelihood of these texts before each pass, by the model that the pass began with.

    A pass gathers one row of expected counts from each partition, added up by the cluster; the driver gets as many numbers as the model has. Training ends with the pass that finds that the one before has gained too little; what that pass has counted is used as well.
    """
    spark = blocks.sparkSession
    k, wide = model.emit.shape
    likes: list[float] = []
    while len(likes) < passes and (len(likes) < 2 or likes[-1] - likes[-2] >= gain * abs(likes[-1])):
        shared = spark.sparkContext.broadcast(model)
        sums = blocks.select("held", "sizes", "tokens", "words").mapInArrow(_expect(shared, wide - 1), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros(k + k * k + k * wide + 1)
        total[sums["i"].to_numpy(int)] = sums["v"].to_numpy(float)
        model = Model.from_counts(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : -1].reshape(k, wide))
        likes.append(float(total[-1]))
    return model, likes


def score(df: DataFrame, held_out: str, key: str = "doc_id", text: str = "text", states: int = STATES, n_classes: int = CLASSES, gain: float = GAIN, passes: int = PASSES) -> DataFrame:
    """One row for each row of df: key, held_out, n_tokens, n_known, train_tokens, base_score, score, passes and train_gain, learned from the rows whose column `held_out` is not true.

    Words are runs of anything but white space, A-Z lower-cased; each text is followed by one end, which counts as a token. base_score: sum of log10((c + 1) / (N + V + 1)). score: log10 of the text's probability under the model, exact. passes: of training; train_gain: the share of the training texts' log-likelihood that the last pass but one has gained.
    A null or empty text is its end alone; texts of any length are read whole, a text is never cut. Null in held_out counts as false. Repeated rows are learned from and scored each; without training rows all classes are alike to the model and scores are still finite. Other columns are not read; an empty table gives an empty one.
    """
    df = only(df, [key, text, held_out])
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("__id"), F.coalesce(held_out, F.lit(False)).alias("__held"), F.col(text).alias("__text"))
    spark = df.sparkSession
    schema = T.StructType([field("block", "long"), T.StructField("ids", T.ArrayType(kind)), field("held", "array<boolean>"), field("sizes", "binary"), field("tokens", "binary"), field("words", "array<long>"), field("counts", "array<long>")])
    blocks = materialize(rows.mapInArrow(_blocks(BLOCK), schema), "lm-blocks")
    # A row for each word of each block: a frequent word has one for a million words at most, some megabytes for a terabyte of text.
    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "x")).select("block", "local", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counts = materialize(each.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    known = counts.filter("c > 0")
    n_train, n_distinct = (int(x or 0) for x in known.agg(F.sum("c"), F.count(F.lit(1))).first())
    cls = F.pmod(F.shiftrightunsigned("word", 20), F.lit(n_classes)).cast("int")
    mass = np.ones(n_classes + 1)
    for i, m in known.filter(F.col("word") != int(END.view(np.int64))).groupBy(cls.alias("i")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[i] += m
    context = contexts(mass)
    model, likes = train(blocks, start_model(*neighbours(blocks, context), context, states), gain, passes)
    shared = spark.sparkContext.broadcast((model, mass, n_train, n_distinct))
    local = each.select(F.col("block").alias("at"), "local", "word").join(known, "word").select("at", "local", "c")
    local = materialize(local, "lm-local")
    out = blocks.drop("counts").groupBy("block").cogroup(local.groupBy("at")).applyInArrow(_score(shared, n_classes), T.StructType([T.StructField("__id", kind), field("held_out", "boolean"), field("n_tokens", "long"), field("n_known", "long"), field("base_score", "double"), field("score", "double")]))
    return out.select(F.col("__id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", F.lit(len(likes)).alias("passes"), F.lit((likes[-1] - likes[-2]) / abs(likes[-1]) if len(likes) > 1 and likes[-1] else 0.0).alias("train_gain"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs.withColumn("held_out", remainder(F.col("doc_id"), 7) == 2), "held_out")
