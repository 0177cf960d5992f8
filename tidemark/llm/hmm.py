"""Language-model scoring with a hidden Markov model over word classes.

A word belongs to a class that its own bytes decide (its last three), so classes need no vocabulary and their number is
fixed. Hidden states emit classes, and a class emits its words by smoothed counts of the whole training corpus:
P(text) = sum over state paths of prod P(state | state before) P(class | state), times prod P(word | class).
Every round of Baum-Welch goes over all training documents: expected counts are gathered in each partition and summed by
class, and give the states' next parameters. Training cuts long texts into runs of 512 words; a run that goes on has its own
distribution of first states, so likelihood rises from round to round. The scaled forward recursion over the whole text gives its
exact likelihood: beyond 4,096 words it goes on from every state at once in stretches that are then chained. Words, counts and classes of each chunk of texts travel as rows keyed by word, so no vocabulary is ever
held in one place: a chunk gets back the counts of its own words only.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: A word's 64 bits are its class (the upper 12) and a hash (the lower 52).
CLASS_BITS, HASH_BITS = 12, 52
CLASSES = 1 << CLASS_BITS
END = CLASSES  # the class of the end token, which is its only member
STATES, ROUNDS, SEED = 6, 12, 90_001
LOG = logging.getLogger(__name__)
#: Bytes of text that are worked on at once.
CHUNK = 10 << 20
#: Words of a run in training, and of a stretch in scoring.
RUN, STRETCH = 512, 4096
#: Weight, in tokens, of the class shares of all states together when a state's own are estimated.
LEAN = 50.0


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit id of every word, and words per text."""
    ids, per = [], []
    for i, j in C.pieces(offsets):
        part = data[offsets[i] : offsets[j]]
        h, n, starts, ends = C.words(part, offsets[i : j + 1] - offsets[i])
        low = C._LOWER[part]
        tail = low[ends].astype(C.U) if len(ends) else np.zeros(0, C.U)
        for back in (1, 2):
            at = ends - back
            tail = tail * C.U(257) + np.where(at >= starts, low[np.maximum(at, 0)].astype(C.U) + C.U(1), C.U(0))
        kind = C.mix(tail + C.U(1)) >> C.U(64 - CLASS_BITS)
        ids.append((kind << C.U(HASH_BITS)) | (h >> C.U(64 - HASH_BITS)))
        per.append(n)
    return (np.concatenate(ids), np.concatenate(per)) if ids else (np.zeros(0, C.U), np.zeros(0, np.int64))


class Model:
    """start, again (first states of a run that goes on) (K), move (K x K) and emit (K x classes + 1); each row sums to 1."""

    def __init__(self, start, move, emit, again=None):
        self.start, self.move, self.emit = start, move, emit
        self.again = start if again is None else again

    @staticmethod
    def from_counts(start: np.ndarray, again: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        share = emit.sum(axis=0) + 0.5
        share = share / share.sum()
        emit = emit + LEAN * share
        move, start, again = move + 0.5, start + 0.5, again + 0.5
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True), again / again.sum())

    @staticmethod
    def first(seen: np.ndarray, states: int) -> Model:
        """States that differ by chance about the class shares of the corpus (seen: how often each class occurs)."""
        rng = np.random.default_rng(SEED)
        share = (seen + 0.5) * rng.uniform(0.5, 1.5, size=(states, CLASSES + 1))
        move = rng.uniform(0.9, 1.1, size=(states, states)) + 4 * np.eye(states)
        return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), share / share.sum(axis=1, keepdims=True))


def by_time(kinds: np.ndarray, per: np.ndarray, ends: np.ndarray):
    """Sequences laid out step by step, the longest first: order, active sequences, step offsets, classes. ends: which have an end token."""
    length = per + ends
    order = np.argsort(-length, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    steps = int(length.max()) if len(length) else 0
    active = len(length) - np.cumsum(np.bincount(length, minlength=steps + 1))[:steps]
    off = np.concatenate([[0], np.cumsum(active)])
    out = np.empty(int(length.sum()), np.int32)
    first = np.cumsum(per) - per
    place = np.arange(len(kinds)) - np.repeat(first, per)
    out[off[place] + np.repeat(rank, per)] = kinds
    out[off[per[ends]] + rank[ends]] = END
    return order, active, off, out


def sweep(model: Model, a: np.ndarray, begin: bool, kinds: np.ndarray, per: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward steps from the vectors a (sequences x vectors x K; begin: they are those of the first token, else of the one before):
    the last vectors, scaled to sum 1, and the natural logarithms of what they were scaled by. Every sequence has a token."""
    order, active, off, seen = by_time(kinds, per, ends)
    many, k = a.shape[1], a.shape[2]
    emit, move = model.emit, model.move.T
    last, logs = np.empty((k, len(per) * many)), np.zeros(len(per) * many)
    a = a[order].reshape(-1, k).T
    for t in range(len(active)):
        n = active[t] * many
        if n < a.shape[1]:
            last[:, n : a.shape[1]] = a[:, n:]
            a = a[:, :n]
        e = emit[:, seen[off[t] : off[t + 1]]]
        a = (a if begin and not t else move @ a) * (e if many == 1 else np.repeat(e, many, axis=1))
        scale = a.sum(axis=0)
        logs[:n] += np.log(scale)
        a /= scale
    last[:, : a.shape[1]] = a
    out, total = np.empty((len(per), many, k)), np.empty((len(per), many))
    out[order], total[order] = last.T.reshape(-1, many, k), logs.reshape(-1, many)
    return out, total


def forward(model: Model, kinds: np.ndarray, per: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """Natural log-likelihood of each class sequence with its end, by the scaled forward recursion in double precision.

    Sequences of more than `stretch` tokens are cut into stretches. Later ones start from each state at once, which makes all of
    them ready at the same time; chaining them is exact."""
    k, n = len(model.start), len(per)
    first = np.cumsum(per) - per
    pieces = [(i, at) for i in np.flatnonzero(per >= stretch) for at in range(stretch, int(per[i]) + 1, stretch)]
    cut = np.minimum(per, stretch)
    keep = np.arange(len(kinds)) - np.repeat(first, per) < stretch
    score = np.empty(n)
    if not n:
        return score
    head, logs = sweep(model, np.broadcast_to(model.start, (n, 1, k)), True, kinds[keep], cut, per < stretch)
    score[:] = logs[:, 0]
    if pieces:
        size = np.array([min(stretch, int(per[i]) - at) for i, at in pieces], np.int64)
        last = np.array([at + stretch > per[i] for i, at in pieces])
        tail, more = sweep(model, np.broadcast_to(np.eye(k), (len(pieces), k, k)), False, kinds[~keep], size, last)
        for j, (i, _) in enumerate(pieces):
            top = more[j].max()
            v = (head[i, 0] * np.exp(more[j] - top)) @ tail[j]
            score[i] += top + np.log(v.sum())
            head[i, 0] = v / v.sum()
    return score


def expected(model: Model, kinds: np.ndarray, per: np.ndarray):
    """Baum-Welch counts (start, again, move, emit) of whole class sequences with their ends."""
    whole = np.ones(len(per), bool)
    return expected_and_likelihood(model, kinds, per, whole, whole)[:4]


def expected_and_likelihood(model: Model, kinds: np.ndarray, per: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """start, again, move and emit counts, and the natural log-likelihood of all runs together. begins, ends: which runs begin and end a text."""
    k = len(model.start)
    start, again, move, emit_n = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES + 1))
    if not len(per):
        return start, again, move, emit_n, 0.0
    order, active, off, seen = by_time(kinds, per, ends)
    begins = begins[order]
    emit, step = model.emit.astype(np.float32), np.ascontiguousarray(model.move.T.astype(np.float32))
    alpha = np.empty((k, len(seen)), np.float32)
    scale = np.empty(len(seen), np.float32)
    a = np.where(begins, model.start[:, None], model.again[:, None]).astype(np.float32)
    for t in range(len(active)):
        n, o = active[t], off[t]
        a = (a[:, :n] if not t else step @ a[:, :n]) * emit[:, seen[o : o + n]]
        scale[o : o + n] = s = a.sum(axis=0)
        a /= s
        alpha[:, o : o + n] = a
    likelihood = float(np.log(scale, dtype=np.float64).sum())
    back = model.move.astype(np.float32)
    b = np.ones((k, active[-1]), np.float32)
    for t in range(len(active) - 1, -1, -1):
        n, o = active[t], off[t]
        if t + 1 < len(active):
            m, p = active[t + 1], off[t + 1]
            w = emit[:, seen[p : p + m]] * b
            w /= scale[p : p + m]
            move += alpha[:, o : o + m] @ w.T
            b = np.ones((k, n), np.float32)
            b[:, :m] = back @ w
        alpha[:, o : o + n] *= b  # the shares of the states at this step; its forward values are not needed again
    top = alpha[:, : active[0]]
    start += top[:, begins[: active[0]]].sum(axis=1)
    again += top[:, ~begins[: active[0]]].sum(axis=1)
    for s in range(k):
        emit_n[s] = np.bincount(seen, weights=alpha[s], minlength=CLASSES + 1)
    return start, again, move * model.move, emit_n, likelihood


def runs(kinds: np.ndarray, size: int = RUN):
    """Bounds of the runs of one text of so many words; the last run may be its end token alone, if the text is empty."""
    n = len(kinds)
    return [(a, min(n, a + size)) for a in range(0, max(n, 1), size)]


def sequences(batches, words: int = CHUNK // 6):
    """(classes, lengths, which begin a text, which end one) of about `words` words each from batches of (16-bit classes, flags)."""
    held, flags, n = [], [], 0
    ready = lambda: (np.concatenate(held).astype(np.int64), np.array([len(h) for h in held]), np.array([f & 1 for f in flags], bool), np.array([f & 2 for f in flags], bool))
    for batch in batches:
        for value, flag in zip(batch.column(0), batch.column(1).to_pylist()):
            x = np.frombuffer(value.as_py(), "<u2")
            if held and n + len(x) > words:
                yield ready()
                held, flags, n = [], [], 0
            held.append(x)
            flags.append(flag)
            n += len(x)
    if held:
        yield ready()


def train(texts: DataFrame, states: int, rounds: int) -> tuple[Model, list[float]]:
    """The model after `rounds` rounds of Baum-Welch over every text (column t), and the natural log-likelihood of all texts by the
    model that each round began with. The driver sees sums of classes + states + 4 rows for each round."""

    def classes(batches):
        for batch in batches:
            data, offsets = C.string_parts(batch.column(0))
            for i, j in C.pieces(offsets, CHUNK):
                ids, per = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                kinds, ends = (ids >> C.U(HASH_BITS)).astype("<u2"), np.concatenate([[0], np.cumsum(per)])
                cuts = [(a + x, a + y, (x == 0) + 2 * (a + y == b)) for a, b in zip(ends, ends[1:]) for x, y in runs(kinds[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array([kinds[x:y].tobytes() for x, y, _ in cuts], pa.binary()), pa.array([f for _, _, f in cuts], pa.int32())], ["kinds", "flags"])

    table = C.save(texts.select("t").mapInArrow(classes, "kinds binary, flags int"), "kinds")
    names = np.concatenate([[-1, -2], -3 - np.arange(states), np.arange(CLASSES + 1), [CLASSES + 1]]).astype(np.int32)
    columns = [f"s{s}" for s in range(states)]

    def total(step):
        """Sums over all runs of step(classes, lengths, begins, ends) -> start, again, move, emit, likelihood; None without any."""

        def run(batches):
            own = None
            for part in sequences(batches):
                got = step(*part)
                own = got if own is None else [a + b for a, b in zip(own, got)]
            if own is not None:
                start, again, move, emit, likelihood = own
                rows = np.vstack([start[None], again[None], move, emit.T, np.full((1, states), likelihood)])
                yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(rows[:, s].copy()) for s in range(states)]], ["c", *columns])

        sums = table.mapInArrow(run, "c int, " + ", ".join(f"{c} double" for c in columns)).groupBy("c").agg(*[F.sum(c).alias(c) for c in columns])
        rows = {r["c"]: np.array(r[1:]) for r in sums.collect()}
        if not rows:
            return None
        return rows[-1], rows[-2], np.vstack([rows[-3 - s] for s in range(states)]), np.vstack([rows[c] for c in range(CLASSES + 1)]).T, float(rows[CLASSES + 1][0])

    def count(kinds, per, begins, ends):
        seen = np.bincount(kinds, minlength=CLASSES + 1).astype(float)
        seen[END] = ends.sum()
        return np.zeros(states), np.zeros(states), np.zeros((states, states)), np.broadcast_to(seen, (states, CLASSES + 1)), 0.0

    seen = total(count)
    model, likelihoods = Model.first(np.zeros(CLASSES + 1) if seen is None else seen[3][0], states), []
    for i in range(rounds if seen is not None else 0):
        *counts, likelihood = total(lambda *part, model=model: expected_and_likelihood(model, *part))
        model = Model.from_counts(*counts)
        likelihoods.append(likelihood)
        LOG.info("Baum-Welch round %d: log-likelihood %.6g", i + 1, likelihood)
    C.discard(table)  # the model is all that is needed from here on
    return model, likelihoods


def chunks(batches, size: int = CHUNK):
    """(keys, held-out flags, data, offsets) of about `size` bytes of text."""
    for batch in batches:
        data, offsets = C.string_parts(batch.column(2))
        for i, j in C.pieces(offsets, size):
            yield batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens (words and the end), n_known (tokens seen in training), train_tokens, base_score, score: one row per input row.

    held_out marks the rows that nothing is learned from (null: learned from). base_score is the smoothed unigram model's
    log10 probability, score the hidden Markov model's; a word that training has not seen is its class's unknown word.
    Null texts are empty: their end token alone. Repeated rows are learned from and scored as often as they occur; null
    keys are keys. Only the named columns are read. Each of the `rounds` rounds of Baum-Welch takes all training texts.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    model, _ = train(src.where(~F.col("held")), states, rounds)

    def gather(batches):
        part = TaskContext.get().partitionId()
        for number, (ids_, held_, data, offsets) in enumerate(chunks(batches)):
            chunk = part << 24 | number
            words, per = encode(data, offsets)
            learn = ~held_.to_numpy(zero_copy_only=False).astype(bool)
            taught = np.repeat(learn, per)
            vocabulary, local = np.unique(words, return_inverse=True)
            count = np.bincount(local[taught], minlength=len(vocabulary)).astype("<u4")
            local = local.astype("<u4")
            ends = np.concatenate([[0], np.cumsum(per)])
            n = len(per)
            codes = [local[ends[i] : ends[i + 1]].tobytes() for i in range(n)]
            nothing = pa.nulls(n, pa.binary())
            names = ["chunk", "id", "held", "codes", "words", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), ids_, held_, pa.array(codes, pa.binary()), nothing, nothing], names)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, ids_.type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), pa.array([vocabulary.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], names)

    table = C.save(src.mapInArrow(gather, f"chunk bigint, id {kind}, held boolean, codes binary, words binary, counts binary"), "chunks")

    def unpack(batches):
        for batch in batches:
            for chunk, words, counts in zip(*batch.columns, strict=True):
                w, c = np.frombuffer(words.as_py(), "<i8"), np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
                for a in range(0, len(w), 50_000):
                    n = len(w[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(w[a : a + n]), pa.array(np.full(n, chunk.as_py())), pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array(c[a : a + n])], ["w", "chunk", "at", "n"])

    vocabulary = table.where("words is not null").select("chunk", "words", "counts").mapInArrow(unpack, "w bigint, chunk bigint, at int, n bigint")
    counts = C.save(vocabulary.where("n > 0").groupBy("w").agg(F.sum("n").alias("c")), "counts")
    ends = table.where("held = false and codes is not null").count()
    per_class = counts.groupBy(F.shiftrightunsigned("w", HASH_BITS).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # at most CLASSES rows
    n_of, v_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        n_of[r["k"]], v_of[r["k"]] = r["n"], r["v"]
    all_tokens, distinct = int(n_of.sum()) + ends, int(v_of.sum()) + (ends > 0)
    room = all_tokens + 0.5 * (distinct + 1)
    end_base = float(np.log10((ends + 0.5) / room))
    back = vocabulary.select("w", "chunk", "at").join(counts, "w", "left").select("chunk", "at", F.shiftrightunsigned("w", HASH_BITS).cast("int").alias("k"), F.coalesce("c", F.lit(0)).alias("c"))
    texts = table.where("codes is not null").select("chunk", "id", "held", "codes")

    def judge(t: pa.Table, v: pa.Table) -> pa.Table:
        at = v.column("at").to_numpy()
        kinds_of, count_of = np.zeros(len(at), np.int64), np.zeros(len(at))
        kinds_of[at], count_of[at] = v.column("k").to_numpy(), v.column("c").to_numpy()
        base_of = np.log10((count_of + 0.5) / room)
        word_of = np.log10((count_of + 0.5) / (n_of[kinds_of] + 0.5 * (v_of[kinds_of] + 1)))
        codes = [np.frombuffer(x, "<u4") for x in t.column("codes").to_pylist()]
        per = np.array([len(x) for x in codes], np.int64)
        flat = np.concatenate(codes).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(per)), per)
        add = lambda x: np.bincount(owner, weights=x[flat], minlength=len(per))
        hidden = forward(model, kinds_of[flat], per) / np.log(10)
        known = add((count_of > 0).astype(float)).astype(np.int64) + (ends > 0)
        return pa.table({"id": t.column("id"), "held_out": t.column("held"), "n_tokens": per + 1, "n_known": known, "train_tokens": np.full(len(per), all_tokens), "base_score": add(base_of) + end_base, "score": hidden + add(word_of)})

    out = texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(judge, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", key)
