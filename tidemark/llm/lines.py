"""Fuzzy line dedup by MinHash: one line of each component of near-equal lines stays.

Lines are normalized (A-Z to lower case, runs of white space to one space), and equal lines form one class. Signatures come
from character shingles; bands of three minima find candidates with high recall; candidates are verified by the exact
Jaccard similarity of their shingle sets; distributed union-find joins them, and the first line of a component, by
document and place, is kept.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.linking import BUCKET, PACKED, link, pack_keys, packed_meetings

#: Characters of a shingle; minima of a band; bands. At similarity 0.8 a pair shares a band with probability 0.997, at 0.85 with 0.9995.
SHINGLE, ROWS, BANDS = 9, 3, 8
#: Normalized lines below so many bytes are never dropped unless the caller says otherwise.
LEAST = 30
#: What the query and the pipeline use: every line with a visible sign takes part, and shingles of five characters, so that one changed
#: character links lines from 49 characters on. Unrelated lines share more of these than of longer ones, so a band has six minima;
#: a pair at similarity 0.8 shares one of the 19 bands with probability 0.997.
WHOLE = {"least": 1, "k": 5, "rows": 6, "bands": 19}
SEED = 40_009
#: Lines that a task remembers at most, not to sign them again.
SEEN = 1_000_000
#: Ids of which a place (a document and a line) is one long.
IDS = 2**32
_FOLD = C._LOWER.copy()
_FOLD[C._SPACE] = 32


def split_lines(data: np.ndarray, offsets: np.ndarray):
    """Normalized bytes of all lines of all texts, their offsets, and each line's text and number. Lines end at \\n."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    owner = np.repeat(np.arange(n), per)
    head = np.cumsum(per) - per
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    starts[head] = offsets[:-1]
    low = _FOLD[data]
    solid = low != 32
    keep = solid.copy()
    # the first space of a run stays if signs of the same line stand on both sides
    follows = np.zeros(len(data), bool)
    follows[1:] = solid[:-1]
    follows[offsets[:-1][offsets[:-1] < len(data)]] = False
    space = ~solid & follows & (data != 10)
    inner = solid.copy()  # signs that do not begin a text
    inner[offsets[:-1][offsets[:-1] < len(data)]] = False
    keep[:-1] |= space[:-1] & inner[1:]
    at = np.flatnonzero(space & ~keep)  # followed by further white space: look for the next sign
    if len(at):
        signs = np.flatnonzero(solid)
        after = np.searchsorted(signs, at)
        at, after = at[after < len(signs)], after[after < len(signs)]
        keep[at[signs[after] < ends[np.searchsorted(ends, at, "right")]]] = True
    gone = np.flatnonzero(~keep)  # few: line ends and white space that is not kept
    size = ends - starts - np.searchsorted(gone, ends) + np.searchsorted(gone, starts)
    return low[keep], np.concatenate([[0], np.cumsum(size)]), owner, np.arange(len(owner)) - head[owner]


def characters(data: np.ndarray, offsets: np.ndarray):
    """One number for each character of UTF-8 lines (its bytes joined), and the lines' offsets in characters."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint32), offsets
    head = (data & 0xC0) != 0x80
    head[offsets[:-1][np.diff(offsets) > 0]] = True
    codes = data.astype(np.uint32)
    # the few bytes that continue a character are put to the byte that begins it, the second bytes first
    rest = left = np.flatnonzero(~head)
    back = 1
    while len(left):
        near = head[left - back]
        at = left[near]
        codes[at - back] |= codes[at] << np.uint32(8 * min(back, 3))
        left, back = left[~near], back + 1
    return codes[head], offsets - np.searchsorted(rest, offsets)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def char_shingles(data: np.ndarray, offsets: np.ndarray, k: int, short: bool = False):
    """64-bit hashes (32-bit ones if short) of all k-character shingles of each line, and how many each line has."""
    codes, offsets = characters(data, offsets)
    count = np.maximum(np.diff(offsets) - k + 1, 0)
    if not count.any():
        return np.zeros(0, np.uint32 if short else C.U), count
    full = len(codes) - k + 1
    factors = C.constants(k, SEED + 1)
    if short:
        s = codes[:full] * np.uint32(factors[0] >> C.U(32))
        for j in range(1, k):
            s += codes[j : j + full] * np.uint32(factors[j] >> C.U(32))
        s = mix32(s)
    else:
        codes = codes.astype(C.U)
        s = codes[:full] * factors[0]
        for j in range(1, k):
            s += codes[j : j + full] * factors[j]
        s = C.mix(s)
    turn = np.zeros(len(codes) + 1, np.int8)  # +1 where a line's shingles begin, -1 behind its last
    on = np.flatnonzero(count)
    turn[offsets[:-1][on]] += 1
    np.subtract.at(turn, offsets[:-1][on] + count[on], 1)
    return s[np.cumsum(turn[:full], dtype=np.int8).view(bool)], count


def minima(sets: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """n minima of each line's shingles that has any: n rows, a column for each such line."""
    full = np.flatnonzero(count)
    out = np.zeros((n, len(full)), np.uint32)
    if len(full):
        first, turned = (np.cumsum(count) - count)[full], np.empty_like(sets)
        for j, a in enumerate(C.constants(n, SEED)):
            np.multiply(sets, np.uint32(a & C.U(0xFFFFFFFF)), out=turned)
            np.minimum.reduceat(turned, first, out=out[j])
    return out


def _line_parts(column: pa.Array):
    data, offsets = C.string_parts(column)
    for i, j in C.pieces(offsets):
        low, cut, owner, number = split_lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, low, cut, owner, number


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, line, size, node (64-bit print of the normalized line): one row per line."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            parts = [(owner + i, number.astype(np.int32), np.diff(cut).astype(np.int32), prints(low, cut)) for i, low, cut, owner, number in _line_parts(batch.column(1))]
            if parts:
                owner, *rest = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *map(pa.array, rest)], ["id", "line", "size", "node"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, line int, size int, node bigint")


def prints(low: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """64 bits for each line."""
    raw, ends = low.tobytes(), cut.tolist()
    return np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(ends, ends[1:])]), np.int64)


def line_bands(docs: DataFrame, text: str, least: int, k: int, rows: int, bands: int, buckets: int) -> DataFrame:
    """The bands of all lines of at least `least` bytes and k characters, packed by bucket with the lines' nodes. They are never a table of
    their own: what two lines do not share ends in its bucket. Of equal lines a task signs the first: the others have its node and its bands."""

    def parts(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, low, cut, _, _ in _line_parts(batch.column(0)):
                node, size = prints(low, cut), np.diff(cut)
                if len(seen) > SEEN:
                    seen.clear()
                new = np.array([len(seen) != (seen.add(x) or len(seen)) for x in node.tolist()]) & (size >= least)
                low, node = low[np.repeat(new, size)], node[new]
                sets, count = char_shingles(low, np.concatenate([[0], np.cumsum(size[new])]), k, short=True)
                if len(sets):
                    m = minima(sets, count, rows * bands)
                    keys = np.broadcast_to(np.arange(bands, dtype=C.U)[:, None], (bands, m.shape[1]))
                    for r in range(rows):
                        keys = C.mix(keys * C.U(3) + m[r::rows] + C.U(1))
                    yield node[count > 0], keys.T

    return docs.select(text).mapInArrow(lambda batches: pack_keys(parts(batches), buckets), PACKED)


def line_texts(docs: DataFrame) -> DataFrame:
    """id (node) and raw (normalized bytes) of the lines that the column wanted (array of (line, node)) names; docs: t, wanted."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(1)
            line, node = (x.to_numpy(zero_copy_only=False) for x in wanted.flatten().flatten())
            at = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))])
            raws = []
            for i, low, cut, _, number in _line_parts(batch.column(0)):
                raw, first = low.tobytes(), np.flatnonzero(number == 0)
                j = i + len(first)
                rows = np.repeat(first, np.diff(at[i : j + 1])) + line[at[i] : at[j]]
                raws += [raw[a:b] for a, b in zip(cut[rows].tolist(), cut[rows + 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(raws, pa.binary())], ["id", "raw"])

    return docs.select("t", "wanted").mapInArrow(run, "id bigint, raw binary")


def _raw_parts(column: pa.Array):
    """Bytes and offsets of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def raw_members(column: pa.Array, k: int = SHINGLE):
    """Shingles of each line of a binary column, one line after the other, and how many each has; a line may have one twice."""
    return char_shingles(*_raw_parts(column), k)


def _codes(column: pa.Array, k: int, side: int) -> np.ndarray:
    """Shingles of a binary column's lines: 12 bits of the line's number, 51 of the shingle's hash, and the side."""
    sets, count = char_shingles(*_raw_parts(column), k)
    return np.repeat(np.arange(len(column), dtype=C.U) << C.U(52), count) | (sets >> C.U(13) << C.U(1)) | C.U(side)


def near_raw(x: pa.Array, y: pa.Array, percent: int, k: int) -> np.ndarray:
    """For each place whether the two lines have 100 * intersection >= percent * union of their shingles. At most 4096 places."""
    code = np.sort(np.concatenate([_codes(x, k, 0), _codes(y, k, 1)]))
    code = code[np.diff(code, prepend=~code[:1]) != 0]
    n = lambda some: np.bincount((some >> C.U(52)).astype(np.int64), minlength=len(x))
    common = n(code[1:][code[1:] >> C.U(1) == code[:-1] >> C.U(1)])
    return 100 * common >= percent * (n(code) - common)


def verify_raw(edges: DataFrame, lines: DataFrame, percent: int, k: int = SHINGLE) -> DataFrame:
    """Edges (x, y) whose lines have 100 * intersection >= percent * union of their shingles, compared by 51 bits of a shingle's hash."""
    both = edges.join(lines.select(F.col("id").alias("x"), F.col("raw").alias("rx")), "x").join(lines.select(F.col("id").alias("y"), F.col("raw").alias("ry")), "y")

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 512):
                b = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays(b.columns[:2], ["x", "y"]).filter(pa.array(near_raw(b.column(2), b.column(3), percent, k)))

    return both.select("x", "y", "rx", "ry").mapInArrow(run, "x bigint, y bigint")


def fuzzy_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, least: int = LEAST, k: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per line: key, line (from 0), size (bytes, normalized), first_doc and first_line (the line that stands for its component),
    kept.

    Null texts have one empty line, as empty ones have. Blank lines, lines below `least` bytes and lines of a null key stand
    for themselves and are kept. Equal lines of any other length are one; lines of at least k characters are compared with
    similar ones too (a shorter one is a single shingle, which only equal lines share). Of equal rows of one key only the first line in order is marked kept once for each row:
    rows of one key share their decisions. Only key and text are read, so other columns cannot clash.
    """
    lines = C.save(line_table(docs, key, text), "lines")
    taken = (F.col("size") >= max(least, 1)) & F.col("id").isNotNull()
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    low, high = docs.agg(F.min(key), F.max(key)).first() if whole else (None, None)
    # places in order of documents, as one number where the key is one: a long if all ids are small enough
    if whole and -IDS <= (low or 0) and (high or 0) < IDS:
        place = F.shiftleft(F.col("id").cast("bigint"), 31) + F.col("line")
        doc_of = lambda p: F.shiftright(p, 31).cast(docs.schema[key].dataType)
        line_of = lambda p: p.bitwiseAND(F.lit(2**31 - 1)).cast("int")
    elif whole:
        place = F.col("id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("line")
        doc_of = lambda p: F.floor(p / F.lit(2**31).cast("decimal(11,0)")).cast(docs.schema[key].dataType)
        line_of = lambda p: F.pmod(p, F.lit(2**31).cast("decimal(11,0)")).cast("int")
    else:
        place = F.struct("id", "line")
        doc_of, line_of = (lambda p: p["id"]), (lambda p: p["line"])
    # a node's first place and its copies, which are counted with partial sums
    nodes = C.save(lines.where(taken).groupBy("node").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n")), "nodes")
    buckets = max(1, -(-lines.count() * bands // BUCKET))
    meet = packed_meetings(line_bands(docs.where(F.col(key).isNotNull()), text, max(least, 1), k, rows, bands, buckets), buckets)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))

    def fetch(ids: DataFrame) -> DataFrame:
        one = nodes.select("node", "p").join(ids.withColumnRenamed("id", "node"), "node")
        wanted = one.select(doc_of(F.col("p")).alias("id"), F.struct(line_of(F.col("p")).alias("line"), "node").alias("w")).groupBy("id").agg(F.collect_list("w").alias("wanted"))
        return line_texts(texts.join(wanted, "id"))

    found = link(meet, fetch, lambda edges, full: verify_raw(edges, full, percent, k), "raw", lambda column: raw_members(column, k), percent).withColumnRenamed("node", "linked")
    # places are settled among the nodes that have copies or links; lines meet their node's place last, in a join of two plain shuffles,
    # which Spark splits where a line is very common
    some = nodes.join(found, F.col("node") == F.col("linked"), "left").where("n > 1 or linked is not null")
    some = C.save(some.select("node", F.coalesce("component", "node").alias("c"), "p"), "some")
    first = C.save(some.groupBy("c").agg(F.min("p").alias("p")), "first")
    first = C.save(some.select("node", "c").join(first, "c").select(F.col("node").alias("first_node"), "p"), "first")
    named = lines.select("id", "line", "size", F.when(taken, F.col("node")).alias("node"))
    out = named.join(first, F.col("node") == F.col("first_node"), "left")
    alone = F.col("p").isNull()
    out = out.select("id", "line", "size", F.when(alone, F.col("id")).otherwise(doc_of(F.col("p"))).alias("first_doc"), F.when(alone, F.col("line")).otherwise(line_of(F.col("p"))).alias("first_line"))
    kept = F.col("first_doc").eqNullSafe(F.col("id")) & (F.col("first_line") == F.col("line"))
    return out.select(F.col("id").alias(key), "line", "size", "first_doc", "first_line", kept.alias("kept"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, least: int = LEAST, k: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """docs without the lines that are not kept; a document that loses every line of at least `least` bytes and has no
    other text goes as a whole, one that was blank before stays. Other columns are kept as they are."""
    gone, own = C.free(docs.columns, "gone", "own")
    drop = fuzzy_lines(docs, key, text, percent, least, k, rows, bands).where("not kept").groupBy(F.col(key).alias(own)).agg(F.collect_set("line").alias(gone))
    joined = docs.join(drop, F.col(key) == F.col(own), "left")
    cut = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(cut))
    return out.where(F.col(gone).isNull() | F.col(text).rlike("[^\\x20\\x09-\\x0D]")).select(*docs.columns)
