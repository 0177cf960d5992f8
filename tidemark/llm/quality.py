"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Document evidence is the log-odds of a logistic model, fitted on a bounded sample of labelled rows, over learned weights of hashed
words and hashed runs of three bytes (the mean weight over the whole text) and the text's own statistics. Sites are then weighed: soft counts of good documents by path and host, gathered over all documents, are
shrunk level by level (path to host, host to the whole) with Beta priors whose strengths are estimated by moments from
the same grouped counts. A document's posterior joins its own evidence with its path's posterior without itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Labelled rows that the document model is fitted on, at most.
SAMPLE = 8_000
#: Hashed words and hashed runs of three bytes that have a weight each; their rates are scaled to be of the size of other features.
WORDS, RUNS, SCALE = 2048, 1024, 20.0
FEATURES = ("bias", "upper", "digit", "symbol", "other_bytes", "log_words", "word_length", "long_words", "distinct", "repeats", "two_apart", "per_line", "repeated_symbols", "top_word")

_KIND = np.zeros(256, np.int8)  # 0 lower case and other letters, 1 upper, 2 digit, 3 symbol, 5 byte of a longer character, 6 space, 7 plain punctuation
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = 1
_KIND[97:123] = 0
_KIND[128:] = 5
_KIND[:33] = 6
_KIND[[ord(c) for c in ".,'-;:?\"()"]] = 7


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text, all of its bytes; an empty text has zeros besides the bias."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = 1
    h, per, starts, ends = C.words(data, offsets)
    size = np.diff(offsets).astype(float)
    kind = _KIND[data]
    full = np.flatnonzero(size)
    if len(full):
        cut = offsets[:-1][full]
        solid = np.maximum(size[full] - np.add.reduceat((kind == 6).astype(np.int32), cut), 1)
        for j, k in ((1, 1), (2, 2), (3, 3), (4, 5)):
            out[full, j] = np.add.reduceat((kind == k).astype(np.int32), cut) / solid
        lines = np.add.reduceat((data == 10).astype(np.int32), cut) + 1
        out[full, 11] = np.log1p(per[full] / lines)
        twin = np.zeros(len(data), np.int32)
        twin[1:] = (kind[1:] == 3) & (data[1:] == data[:-1])
        out[full, 12] = np.add.reduceat(twin, cut) / solid
    some = np.flatnonzero(per)
    if len(some):
        first = (np.cumsum(per) - per)[some]
        w = per[some].astype(float)
        length = (ends - starts + 1).astype(np.int64)
        out[some, 5] = np.log1p(w)
        out[some, 6] = np.add.reduceat(length, first) / w
        out[some, 7] = np.add.reduceat((length > 20).astype(np.int32), first) / w
        owner = np.repeat(np.arange(n), per)
        for j, gap in ((9, 1), (10, 2)):
            same = np.zeros(len(h), np.int32)
            same[gap:] = (h[gap:] == h[:-gap]) & (owner[gap:] == owner[:-gap])
            out[some, j] = np.add.reduceat(same, first) / w
        bounds = np.concatenate([[0], np.cumsum(per)])
        for i in some:
            _, c = np.unique(h[bounds[i] : bounds[i + 1]], return_counts=True)
            out[i, 8] = np.log(len(c)) / np.log(max(2, per[i]))  # how vocabulary grows with length
            out[i, 13] = c.max() / per[i]
    return out


def buckets(data: np.ndarray, offsets: np.ndarray):
    """Hashed words of all texts and how many each text has, and the same for runs of three bytes that lie inside a text."""
    h, per, _, _ = C.words(data, offsets)
    runs = np.maximum(np.diff(offsets) - 2, 0)
    low = C._LOWER[data].astype(np.uint32)
    g = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
    g = ((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(22)
    turn = np.zeros(len(data) + 1, np.int8)
    on = np.flatnonzero(runs)
    turn[offsets[:-1][on]] += 1
    np.subtract.at(turn, offsets[:-1][on] + runs[on], 1)
    return (h >> C.U(53)).astype(np.int64), per, g[np.cumsum(turn[: len(g)], dtype=np.int8).view(bool)].astype(np.int64), runs


def rates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: the share of its words and of its runs in each bucket, times SCALE."""
    n = len(offsets) - 1
    w, per, g, runs = buckets(data, offsets)
    out = np.zeros((n, WORDS + RUNS), np.float32)
    for at, size, first, width in ((w, per, 0, WORDS), (g, runs, WORDS, RUNS)):
        c = np.bincount(np.repeat(np.arange(n), size) * width + at, minlength=n * width).reshape(n, width)
        out[:, first : first + width] = SCALE * c / np.maximum(size, 1)[:, None]
    return out


def evidence(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """rates() times weights, without the rows: the mean weight of a text's words and runs."""
    w, per, g, runs = buckets(data, offsets)
    out = np.zeros(len(per))
    for at, size, own in ((w, per, weights[:WORDS]), (g, runs, weights[WORDS:])):
        some = np.flatnonzero(size)
        if len(some):
            out[some] += SCALE * np.add.reduceat(own[at], (np.cumsum(size) - size)[some]) / size[some]
    return out


def pieces_of(column: pa.Array):
    data, offsets = C.string_parts(column)
    for i, j in C.pieces(offsets):
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def features_of(column: pa.Array) -> np.ndarray:
    return np.concatenate([features(*p) for p in pieces_of(column)] or [np.zeros((0, len(FEATURES)))])


def fit_logistic(x: np.ndarray, hashed, y: np.ndarray, ridge: float = 1.0, rounds: int = 400):
    """Ridge-penalised logistic regression on standardized features and hashed rates (an iterable of blocks of rows, each read once) by
    accelerated gradient steps: (mean, scale, weights of the features, weights of the rates)."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale = 0, np.where(scale < 1e-9, 1, scale)
    z = np.empty((len(x), x.shape[1] + WORDS + RUNS), np.float32)  # the one large matrix: SAMPLE rows of 12 kB
    z[:, : x.shape[1]] = (x - mean) / scale
    z[:, 0] = 1
    at = 0
    for block in hashed:
        z[at : at + len(block), x.shape[1] :] = block
        at += len(block)
    pen = np.full(z.shape[1], ridge)
    pen[0] = 1e-6
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):  # the largest curvature, by power iteration
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.26 * float(np.linalg.norm(z.T @ (z @ v))) + ridge)
    w = ahead = np.zeros(z.shape[1])
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead.astype(np.float32), -30, 30)))
        new = ahead - step * (z.T @ (p - y).astype(np.float32) + pen * ahead)
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return mean, scale, w[: x.shape[1]], w[x.shape[1] :]


def log_odds(model, column: pa.Array) -> np.ndarray:
    """The evidence of each text for a good document against the sample's base rate."""
    mean, scale, w, hashed, base = model
    out = []
    for part in pieces_of(column):
        z = (features(*part) - mean) / scale
        z[:, 0] = 1
        out.append(np.clip(z @ w + evidence(*part, hashed), -30, 30) - base)
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE):
    """The document model, from at most `sample` labelled rows (the smallest hashes of the key: the same everywhere).
    None if the labels lack one of the classes: then no document has evidence of its own."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("double").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_k"), "_k", "_y").limit(sample)

    def run(batches):
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = features_of(batch.column(1))
            h = np.concatenate([rates(*p) for p in pieces_of(batch.column(1))] or [np.zeros((0, WORDS + RUNS))]).astype(np.float16)
            for i in range(0, len(y), 500):
                block = y[i : i + 500].tobytes(), x[i : i + 500].tobytes(), pa.compress(h[i : i + 500].tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in block], ["y", "x", "h"])

    # the sample is bounded, and so are its broadcast (16 bytes a row) and what comes back (6 kB a row, less by compression), a block a batch
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k").select("_y", "_t").limit(sample).mapInArrow(run, "y binary, x binary, h binary").toArrow()
    blocks = rows.to_pylist()
    del rows
    y = np.concatenate([np.frombuffer(b["y"]) for b in blocks] or [np.zeros(0)])
    if len(np.unique(y)) < 2:
        return None
    x = np.concatenate([np.frombuffer(b["x"]).reshape(-1, len(FEATURES)) for b in blocks])

    def hashed():
        for b in blocks:
            n = len(b["y"]) // 8
            yield np.frombuffer(pa.decompress(b.pop("h"), n * (WORDS + RUNS) * 2, "zstd"), np.float16).reshape(n, -1)

    return *fit_logistic(x, hashed(), y), float(np.log(y.mean() / (1 - y.mean())))


def score(docs: DataFrame, model, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns, and llr: the evidence of the text for a good document against the sample's base rate. One pass, no shuffle."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", llr double"

    def run(batches):
        for batch in batches:
            llr = np.zeros(len(batch)) if model is None else log_odds(model, batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(llr)], [*keep, "llr"])

    return docs.select(*keep, F.col(text).alias("_text_")).mapInArrow(run, schema)


def strength(groups: DataFrame, good: str, n: str, around) -> float:
    """How many documents the prior of a level is worth: moments of the groups' shares about their parent's mean.
    One row comes to the driver. Between 1 and 1000; 1000 if groups differ no more than chance."""
    m = around
    r = groups.where(F.col(n) >= 2).agg(
        F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - m, 2)).alias("between"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum((F.col(n) - 1) * m * (1 - m)).alias("room"),
    ).first()
    if not r["room"]:
        return 10.0
    rho = (r["between"] - r["noise"]) / r["room"]  # correlation within a group
    return float(min(1000.0, max(1.0, 1 / max(rho, 1e-3) - 1)))


def posteriors(scored: DataFrame, base: float) -> DataFrame:
    """scored (host, path, llr, ...) with p_doc, host_posterior, path_posterior and posterior.

    Sums of soft counts by path are combined before the shuffle, so a hot host costs no more than others; hosts are summed
    from paths. Sites of one document lean on their host, hosts of few documents on the whole.
    """
    p = 1 / (1 + F.exp(-(F.col("llr") + base)))
    scored = scored.withColumn("p_doc", p)
    paths = C.save(scored.groupBy("host", "path").agg(F.sum("p_doc").alias("g"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("g").alias("hg"), F.sum("n").alias("hn"))
    whole = hosts.agg(F.sum("hg").alias("g"), F.sum("hn").alias("n")).first()
    mean = min(1 - 1e-6, max(1e-6, (whole["g"] or 0) / (whole["n"] or 1)))
    k_host = strength(hosts, "hg", "hn", F.lit(mean))
    hosts = hosts.withColumn("host_posterior", (F.col("hg") + k_host * mean) / (F.col("hn") + k_host))
    sites = C.save(paths.join(hosts.select(F.col("host").alias("h"), "host_posterior"), F.col("host").eqNullSafe(F.col("h"))).drop("h"), "sites")
    k_path = strength(sites, "g", "n", F.col("host_posterior"))
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "g", "n", "host_posterior")
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q"))).drop("h", "q")
    own = (F.col("g") - F.col("p_doc") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    own = F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn("path_posterior", own)
    return out.withColumn("posterior", 1 / (1 + F.exp(-(F.col("llr") + F.log(own / (1 - own)))))).drop("g", "n")


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """keep columns (the key by default) of every row, with host, path, llr, p_doc, host_posterior, path_posterior,
    posterior and accepted (posterior >= threshold).

    Null and empty texts are judged by their features (all zero) and site; null hosts and paths are sites of their own.
    Rows of equal keys are judged one by one. keep may name the text: it is then written once to the shared folder with the
    evidence, so that no shuffle ever carries it. Columns of keep that are named like the new ones are replaced by them; the key may not be.
    """
    new = ("host", "path", "llr", "p_doc", "host_posterior", "path_posterior", "posterior", "accepted")
    if key.lower() in new:
        raise ValueError(f"the key may not be named {key}")
    keep = [c for c in keep or [key] if c.lower() not in new]
    host_, path_ = C.free(docs.columns, "host_at", "path_at")
    model = fit(docs, labels, key, text)
    base = 0.0 if model is None else model[4]
    sites = docs.withColumn(host_, host).withColumn(path_, path)
    scored = C.save(score(sites, model, [*keep, host_, path_], text).withColumnsRenamed({host_: "host", path_: "path"}), "scored")
    return posteriors(scored, base).withColumn("accepted", F.col("posterior") >= threshold)
