"""What the operators share: scratch tables in the shared folder, text hashing on Arrow buffers, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- scratch tables

_swept: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session of one machine that names none gets a folder of its own; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _sweep(spark: SparkSession, root: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already when the process ends
        pass


#: Settings while a scratch table is written. Spark drops the shuffle files of a query when the query has ended; batches to
#: Python are small, because a row may hold a long text and several tasks share an executor's memory.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings with some changed, and as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def save(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    Nothing reads the shuffle files of the write once the table is there, so they go with it."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if root not in _swept:
        _swept.add(root)
        atexit.register(_sweep, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(saved: DataFrame) -> None:
    """Delete a table that save() wrote and nothing will read again."""
    _sweep(saved.sparkSession, saved._scratch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(taken, *names: str) -> list[str]:
    """names, each lengthened until no column in taken has it."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- hashing of texts

U = np.uint64
_ODD, _BASE = U(0x9E3779B97F4A7C15), U(0x100000001B3)
#: White space of the contracts is \x20 and \x09-\x0D; A-Z go to lower case, no other letter does.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are hashed in pieces of about so many bytes, which bounds the working memory and keeps it in the cache.
PIECE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same for a seed everywhere."""
    return mix(np.arange(1, n + 1, dtype=U) * _ODD + U(seed)) | U(1)


_POWERS = np.cumprod(np.full(4096, _BASE, dtype=U), dtype=U)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(2 * n, _BASE, dtype=U), dtype=U)
    return _POWERS


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, one after the other, and the offsets (length + 1). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE):
    """Ranges of values that hold about size bytes; a longer value is a range by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: 64-bit hash of each word, words per text, and each word's first and last byte place."""
    n = len(data)
    per = np.zeros(len(offsets) - 1, np.int64)
    if not n:
        return np.zeros(0, U), per, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[data]
    space = _SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~space
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    if not len(starts):
        return np.zeros(0, U), per, starts, starts
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:]))
    length = ends - starts + 1
    pw = powers(int(length.max()) + 1)
    where = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    place = np.arange(len(where)) - np.repeat(first, length)
    h = np.add.reduceat((low[where].astype(U) + U(1)) * pw[place], first)
    bounds = np.searchsorted(starts, offsets)
    return mix(h ^ (length.astype(U) * _ODD)), np.diff(bounds), starts, ends


def shingles(h: np.ndarray, per: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted 64-bit hashes, and how many each text has.
    A text with fewer words than k has its whole sequence as the only one; a text without words has none."""
    c = constants(k + 1, 77 + seed)
    bounds = np.concatenate([[0], np.cumsum(per)])
    total = len(h)
    out, count = [], np.zeros(len(per), np.int64)
    if total >= k:
        s = h[: total - k + 1] * c[0]
        for j in range(1, k):
            s = s + h[j : total - k + 1 + j] * c[j]
        s = mix(s)
    for i, n in enumerate(per):
        if not n:
            continue
        a = bounds[i]
        if n >= k:
            got = np.unique(s[a : a + n - k + 1])
        else:
            got = mix((h[a : a + n] * c[:n]).sum(dtype=U, keepdims=True) + c[k : k + 1] * U(n))
        count[i] = len(got)
        out.append(got)
    return (np.concatenate(out) if out else np.zeros(0, U)), count


def minhashes(sets: np.ndarray, count: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n minima of multiplicative permutations for each non-empty set; a row of zeros for an empty one."""
    out = np.zeros((len(count), n), U)
    full = np.flatnonzero(count)
    if len(full):
        first = (np.cumsum(count) - count)[full]
        for j, a in enumerate(constants(n, seed)):
            out[full, j] = np.minimum.reduceat(sets * a, first)
    return out


def set_prints(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """128 bits for each set that depend on all its members and not on their order."""
    out = np.zeros((len(count), 2), U)
    full = np.flatnonzero(count)
    if len(full):
        first = (np.cumsum(count) - count)[full]
        out[full, 0] = np.add.reduceat(mix(sets ^ U(0x5851F42D4C957F2D)), first)
        out[full, 1] = np.add.reduceat(mix(sets * U(0xD1342543DE82EF95) + U(1)), first)
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ---------------------------------------------------------------- connected components

#: Links that one task joins by itself.
TASK_LINKS = 500_000


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links and the smallest node that each is joined with by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        np.minimum.at(low, low[i], low[j])  # the roots learn first, so that a chain closes up in a few steps
        np.minimum.at(low, low[j], low[i])
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            return nodes, nodes[low]


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, task_links: int = TASK_LINKS, repeated: bool = True) -> DataFrame:
    """node, component (its smallest reachable node) for every node that a link names. Links of null or of a node with itself
    join nothing. If not many links are `repeated`, they are not made distinct, which costs a shuffle.

    Distributed union-find. First every task joins up to task_links links by itself, which leaves one link for each of its nodes;
    if one task held them all, that is the result. Then each round hooks every node to the smallest label next to it and halves
    the paths to the roots. Labels only fall, each round is a written table, and the loop ends when no label changes; each
    round at least halves the longest path, so most_rounds is beyond any graph that can be stored.
    """
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = save(both.distinct() if repeated else both, "edges")
    parts = -(-edges.count() // task_links)
    if not parts:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    kind = edges.schema["u"].dataType.simpleString()

    def join(batches):
        held = [x for x in batches if len(x)]
        if held:
            t = pa.Table.from_batches(held)
            got = local_components(*(np.array(t.column(c).to_pylist()) for c in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.schema.field(0).type) for x in got], ["u", "v"])

    joined = save(edges.repartition(parts).mapInArrow(join, f"u {kind}, v {kind}"), "joined")
    if parts == 1:
        return joined.select(F.col("u").alias("node"), F.col("v").alias("component"))
    star = joined.where("u <> v")
    edges = save(star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = save(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    for _ in range(most_rounds):
        near = edges.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        hook = label.join(near, "u").select("u", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        # the roots' new labels: what any of their members has found
        roots = hook.groupBy(F.col("was").alias("r")).agg(F.min("l").alias("rl"))
        step = hook.join(roots, hook.was == roots.r, "left").select("u", "was", F.least("l", "rl").alias("l"))
        step = save(step, "hooked")
        up = step.select(F.col("u").alias("p"), F.col("l").alias("pl"))
        new = save(step.join(up, step.l == up.p, "left").select("u", "was", F.least("l", "pl").alias("l")), "labels")
        label = new.select("u", "l")
        if new.where("l < was").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
    raise RuntimeError("the components did not settle")
