"""Verified links between representatives that share a bucket key, without expanding buckets into pairs.

First every row of a bucket is compared with the bucket's pivot (one edge for each row), which joins a group of copies, however
large, in linear work. The pivot is the row that meets most others in its buckets: in a group of edited copies the one that
is edited least, which has the most links. Buckets whose rows are then in one component are done. Rows of the others are
gathered by the components of what they still share, dealt into blocks, and compared block with block on their full sets
inside a task: no pair is emitted but a link that joins two components. Where chains of buckets gather more rows than a block
has, which grow with the input, the rows are compared bucket by bucket instead. So no candidate pair is left untested unless its
ends are connected already, and the components are those of all candidate pairs.

Blocks of a bucket of n rows are of the order of n squared, so the rows of buckets of more than CROWD rows are dealt anew before: by the
rarest members of their sets, of which two linked rows share one for sure (prefix and positional filter), with a pivot for each member that
many rows have, unless they share so many members that blocks of them all hold fewer rows. In a large group of edited copies a row shares its rare members with few others, and the others have the pivot's label.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Rows of a block; bytes of the rows of many small cells that a task compares at once.
BLOCK, TOGETHER = 512, 1 << 20
#: Rows of a bucket from which on its rows are dealt by their rarest members; rows whose members a task counts; counters; ratio of the sizes in a class.
CROWD, COUNTED, COUNTERS, CLASS = 1024, 10_000, 1 << 20, 1.05
#: Rows whose keys a task looks through before they are sent; keys of a bucket.
CHUNK, BUCKET = 50_000, 500_000
#: What an entry of a bucket is: a row alone with its key in its chunk; the first of several rows; another one, whose key is shared for sure.
ALONE, FIRST, OTHER = 0, 1, 2


def pack_keys(parts, buckets: int, chunk: int = CHUNK):
    """Record batches (bucket, kind, keys, ids) of the keys of many rows, from pairs of arrays: ids (long) and keys (rows x tables).

    A bucket's entries travel as one value. Of the rows of a chunk that have one key only the first goes to the key's bucket; the others
    are spread over all buckets, so that a key of very many rows fills none."""
    held, n = [], 0
    for ids, keys in parts:
        held.append((ids, keys))
        n += len(ids)
        if n >= chunk:
            yield _packed(held, buckets)
            held, n = [], 0
    if n:
        yield _packed(held, buckets)


def _packed(held, buckets: int) -> pa.RecordBatch:
    ids, first = np.unique(np.concatenate([i for i, _ in held]), return_index=True)
    keys = np.concatenate([k for _, k in held])[first].view(C.U)
    key, row = keys.ravel(), np.repeat(ids, keys.shape[1])
    order = np.argsort(key)
    key, row = key[order], row[order]
    again = np.zeros(len(key) + 1, bool)
    again[1:-1] = key[1:] == key[:-1]
    kind = np.where(again[:-1], OTHER, np.where(again[1:], FIRST, ALONE)).astype(np.int8)
    bucket = np.where(kind == OTHER, np.arange(len(key), dtype=C.U), C.mix(key)) % C.U(buckets)
    at = (bucket * C.U(3) + kind.astype(C.U)).astype(np.int64)
    order = np.argsort(at.astype(np.uint16) if 3 * buckets <= 1 << 16 else at, kind="stable")  # numbers of 16 bits are sorted in linear time
    at, key, row = at[order], key[order], row[order]
    cut = [*np.flatnonzero(np.diff(at, prepend=-1)).tolist(), len(at)]
    spans = list(zip(cut, cut[1:]))
    head = at[cut[:-1]]
    columns = [pa.array((head // 3).astype(np.int32)), pa.array((head % 3).astype(np.int8)), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (key, row))]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "keys", "ids"])


PACKED = "bucket int, kind tinyint, keys binary, ids binary"


def packed_meetings(packed: DataFrame, buckets: int) -> DataFrame:
    """key, id of all rows that share a key with another, from what pack_keys gives: each key is looked at once, and keys of one row alone,
    which most are, never become rows of a table."""

    def run(batches):
        last, held = None, []
        for batch in batches:
            for bucket, kind, keys, ids in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                entry = np.frombuffer(keys, np.int64), np.frombuffer(ids, np.int64)
                if kind == OTHER:
                    yield _entries(*entry)
                    continue
                if bucket != last and held:
                    yield _shared(held)
                    held = []
                last = bucket
                held.append((*entry, np.full(len(entry[0]), kind == FIRST)))
        if held:
            yield _shared(held)

    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "key bigint, id bigint").distinct()


def _entries(key: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(row)], ["key", "id"])


def _shared(held) -> pa.RecordBatch:
    key, row, sure = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1], [True]])
    some = ~(new[:-1] & new[1:]) | sure[order]  # of several chunks, or of several rows of one
    key, order = key[some], order[some]
    row, sure = row[order], sure[order]
    if not len(key):
        return _entries(key, row)
    group = np.flatnonzero(new[:-1][some])
    keep = np.logical_or.reduceat(sure, group) | (np.minimum.reduceat(row, group) < np.maximum.reduceat(row, group))
    keep = np.repeat(keep, np.diff([*group, len(key)]))
    return _entries(key[keep], row[keep])


def meetings(reps: DataFrame) -> DataFrame:
    """key, id of all rows (id, keys: array of bucket keys) that share a key with another."""
    # A key may hold a third of all rows: keys are counted with partial sums, and what is known of a key is a table of its own before the
    # rows meet it, so that both sides of the join are plain shuffles, which Spark splits where a key is hot.
    keyed = reps.select("id", F.explode("keys").alias("key"))
    shared = C.save(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"), "shared")
    return keyed.join(shared, "key").select("key", "id")


def verify_sets(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (x, y) whose full sets have 100 * intersection >= percent * union. sets: id, set (distinct longs)."""
    a = sets.select(F.col("id").alias("x"), F.col("set").alias("sx"))
    b = sets.select(F.col("id").alias("y"), F.col("set").alias("sy"))
    both = edges.join(a, "x").join(b, "y").withColumn("i", F.size(F.array_intersect("sx", "sy")))
    return both.where(100 * F.col("i") >= percent * (F.size("sx") + F.size("sy") - F.col("i"))).select("x", "y")


def link(meet: DataFrame, fetch: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], payload: str, sets_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], percent: int) -> DataFrame:
    """node, component of all representatives that a verified link joins.

    meet: key and id of the rows that share a bucket with another (see meetings and packed_meetings). fetch(ids) gives a table with id and
    the column `payload`; it is asked once, for these rows. verify(edges, table) keeps the edges (x, y) that are links. sets_of(payload
    column) gives the rows' members, one row after the other, and how many each has; a row may have one twice.
    """
    met = C.save(meet, "met")
    # Keys of the same rows are one from here on, of so many keys: near copies share many
    once = C.save(met.join(one_each(met), "key").select("key", "id", "c", "n"), "once")
    C.discard(met)
    weight = C.save(once.groupBy("id").agg(F.sum(F.col("c") * F.col("n")).alias("w")), "weight")
    full = C.save(fetch(weight.select("id")), "full")
    # any row may win a tie: the components are those of all candidate pairs, whatever the pivots are
    pivots = C.save(once.select("key", "id").join(weight, "id").groupBy("key").agg(F.max_by("id", "w").alias("y"), F.max("w").alias("yw")), "pivots")
    # one edge for each row: to the pivot that it shares most keys with
    joint = once.join(pivots, "key").where("id <> y").groupBy("id", "y").agg(F.sum("n").alias("k"), F.max("yw").alias("yw"))
    best = F.shiftleft("k", 48) + F.least("yw", F.lit(2**48 - 1))  # one number, which is summed up without sorting
    edges = joint.groupBy("id").agg(F.max_by("y", best).alias("y")).select(F.least("id", "y").alias("x"), F.greatest("id", "y").alias("y"))
    edges = C.save(edges, "edges")
    links = C.save(verify(edges, full), "links")
    found = C.components(links, "x", "y", repeated=False)
    open_, mixed = mixed_keys(once.select("key", "id"), found)
    hot = mixed.where(F.col("c") > CROWD)
    if not hot.isEmpty():
        crowd = C.save(open_.join(hot, "key", "left_semi").select("id", "label").distinct(), "crowd")
        links, edges = settle(crowd, full, links, edges, verify, payload, sets_of, percent)
        found = C.components(links, "x", "y", repeated=False)
        # all pairs of the crowd are settled now: what is open has a row of others
        others = C.save(open_.join(crowd, "id", "left_anti").select("key").distinct(), "others")
        open_, _ = mixed_keys(open_.join(others, "key", "left_semi").select("key", "id"), found)
    if open_.isEmpty():
        return found
    gathered = C.components(open_, "id", "y", repeated=False).select(F.col("node").alias("id"), F.col("component").alias("g"))
    rows = C.save(open_.select("id", "label").distinct().join(gathered, "id"), "rows")
    large = C.save(rows.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select("g"), "large")
    few = unsettled(C.save(rows.join(large, "g", "left_anti"), "rows"), edges)
    more = C.save(compare_blocks(few, full, payload, sets_of, percent, BLOCK), "links")
    if not large.isEmpty():
        chained = rows.join(large, "g").select("id")
        buckets = C.save(open_.join(chained, "id").select(F.col("key").alias("g"), "id", "label"), "buckets")
        rest = unsettled(buckets, edges)
        more = more.union(C.save(compare_blocks(rest, full, payload, sets_of, percent, BLOCK), "links"))
    return C.components(links.union(more), "x", "y", repeated=False)


def one_each(met: DataFrame) -> DataFrame:
    """key, c (its rows), n (keys of the same rows): one key of each set of rows that the keys of (key, id) have. What is known of a key is a
    table of its own before the rows meet it."""
    same = met.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("i"))
    return C.save(same.groupBy("c", "lo", "hi", "h", "i").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).select("key", "c", "n"), "one")


def mixed_keys(keyed: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, id, label (component), y (a row of the key) of the rows (key, id) whose key has rows of several components; key, y, c (its rows) of these keys."""
    named = keyed.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    named = C.save(named, "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("y"), F.count(F.lit(1)).alias("c"))
    mixed = C.save(mixed.where("lo < hi").select("key", "y", "c"), "mixed")
    return C.save(named.join(mixed.drop("c"), "key").select("key", "id", "label", "y"), "open"), mixed


def settle(crowd: DataFrame, full: DataFrame, links: DataFrame, tested: DataFrame, verify, payload: str, sets_of, percent: int) -> tuple[DataFrame, DataFrame]:
    """links with those that join rows of the crowd (id, label), after which no two rows of it are linked and in different components;
    tested with the pairs that were verified."""
    rare = rare_members(crowd, full, payload, sets_of, percent)
    # most members are those of one row; the others are met by what their rows may be linked to, of which the smallest of a class of sizes tells
    sizes = rare.groupBy("key", F.floor(F.log("size") / F.log(F.lit(CLASS)))).agg(F.min("size").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    sizes = C.save(sizes.groupBy("key").agg(F.collect_set("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("key", "m"), "sizes")
    fits = F.exists("m", lambda m: (m <= F.col("most")) & (m * (CLASS + 0.01) >= F.col("least")))
    fit = C.save(rare.join(sizes, "key").where(fits).groupBy("key", "id", "label").agg(F.max("score").alias("score")), "fit")
    n, top = crowd.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    na, nu = -(-top // BLOCK), -(-(n - top) // BLOCK)
    if fit.count() > 2 * (top * nu + (n - top) * (nu + na)):  # rows that share their members with many others: few enough for blocks of all
        return links.union(C.save(compare_blocks(crowd.withColumn("g", F.lit(0)), full, payload, sets_of, percent, BLOCK), "links")), tested
    once = C.save(fit.join(one_each(fit).where("c > 1"), "key").select("key", "id", "label", "score", "c"), "fit")
    crowded = once.where(F.col("c") > BLOCK)
    heads = C.save(crowded.groupBy("key").agg(F.max_by("id", "score").alias("y"), F.max_by("label", "score").alias("other")), "heads")
    tried = crowded.join(heads, "key").where("id <> y and label <> other").select(F.least("id", "y").alias("x"), F.greatest("id", "y").alias("y"))
    tried = C.save(tried.distinct(), "tried")
    links, tested = links.union(C.save(verify(tried, full), "links")), tested.union(tried)
    open_, _ = mixed_keys(once.select("key", "id"), C.components(links, "x", "y", repeated=False))
    rest = unsettled(open_.select(F.col("key").alias("g"), "id", "label"), tested)
    return links.union(C.save(compare_blocks(rest, full, payload, sets_of, percent, BLOCK), "links")), tested


def rare_members(rows: DataFrame, full: DataFrame, payload: str, sets_of, percent: int) -> DataFrame:
    """key (a member of its set), id, label, size, least, most, score: for each row (id, label) the members that come first, the rarest first,
    as many as two linked sets need to share one.

    An intersection is at least percent / (100 + percent) of the sum of both sizes. So the first member that two linked sets share is one of
    these in both, and a row can only be linked by it to sets of `least` to `most` members. Rareness is told by counters that members may
    share: a wrong order costs time, but any order that is the same for all rows is as exact. score: larger for rows of frequent members.
    """
    kind = rows.schema["id"].dataType.simpleString()
    tasks = max(1, -(-rows.count() // COUNTED))
    ready = C.save(rows.join(full.select("id", payload), "id").select("id", "label", payload), "ready")
    piece = COUNTERS // 16

    def tally(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount((C.mix(sets_of(batch.column(0))[0].astype(C.U)) % C.U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield from _counters(enumerate(total.reshape(16, piece)))

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, n in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                total.setdefault(part, np.zeros(piece, np.int64))[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        yield from _counters(total.items())

    kept = "part int, at binary, n binary"
    often = np.zeros((16, piece), np.int64)
    counters = ready.select(payload).repartition(tasks).mapInArrow(tally, kept).repartition(16, "part").mapInArrow(added, kept)
    for r in C.save(counters, "counters").collect():  # of a size that does not grow
        often[r["part"], np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
    often = often.ravel()

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            members, count = sets_of(batch.column(2))
            row, code = np.repeat(np.arange(len(count)), count), C.mix(members.astype(C.U))
            n = often[(code % C.U(COUNTERS)).astype(np.int64)]
            order = np.lexsort((code, n, row))
            row, code, n = row[order], code[order], n[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
            row, code, n = row[new], code[new], n[new]
            size = np.bincount(row, minlength=len(count))
            least = -(-percent * size // 100)
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            most = (100 + percent) * (size[row] - place) // percent - size[row]
            mean = np.bincount(row, np.log2(n + 1), len(count)) / np.maximum(size, 1)
            print_ = np.zeros(len(count), C.U)
            np.add.at(print_, row, code)
            score = (mean * 2**14).astype(np.int64) << 40 | (C.mix(print_) >> C.U(24)).astype(np.int64)
            keep = most >= least[row]
            at = row[keep]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(C.as_long(code[keep])), batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x) for x in (size[at], least[at], most[keep], score[at]))], ["key", "id", "label", "size", "least", "most", "score"])

    return C.save(ready.mapInArrow(run, f"key bigint, id {kind}, label {kind}, size bigint, least bigint, most bigint, score bigint"), "rare")


def _counters(parts):
    """Record batches of the counters (part, values) that are not 0."""
    for part, n in parts:
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), n[at]))], ["part", "at", "n"])


def unsettled(rows: DataFrame, tested: DataFrame) -> DataFrame:
    """rows (id, label, g) without the groups of two that are an edge in tested (x < y): most groups are two rows that are no link."""
    twos = rows.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("x"), F.max("id").alias("y")).where("c = 2")
    settled = C.save(twos.join(tested, ["x", "y"]).select("g"), "settled")
    return C.save(rows.join(settled, "g", "left_anti").select("id", "label", "g"), "rows")


def compare_blocks(rows: DataFrame, full: DataFrame, payload: str, sets_of, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (x, y) between rows (id, label, g) of one g and different labels: one for each two labels in two blocks that have any.

    Rows of a group's largest label are not compared with each other, so their blocks meet only those of the others; each pair
    of blocks is a group of its own, of at most 2 * block rows."""
    size = rows.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
    top = size.groupBy("g").agg(F.max_by("label", "c").alias("major"), F.max("c").alias("ca"), F.sum("c").alias("call"))
    blocks = C.save(top.select("g", "major", F.ceil(F.col("ca") / block).cast("int").alias("na"), F.ceil((F.col("call") - F.col("ca")) / block).cast("int").alias("nu")), "blocks")
    dealt = rows.join(blocks, "g")
    major = F.col("label") == F.col("major")
    mine = F.when(major, F.pmod(F.hash("id"), "na") + F.col("nu")).otherwise(F.pmod(F.hash("id"), "nu"))
    # blocks below nu hold the others, blocks from nu on the largest label
    dealt = dealt.withColumn("b", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.when(major, F.col("nu")).otherwise(F.col("nu") + F.col("na")) - 1)))
    dealt = dealt.select("g", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "id", "label")
    cells = ["g", "lo", "hi"]
    ready = dealt.join(full.select("id", payload), "id").repartition(*cells).sortWithinPartitions(*cells, "id")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for t, cell in whole_cells(batches, 3):
            x, y = cross_links(t, cell, percent, sets_of)
            if len(x):
                ids = t.column(4)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)).combine_chunks(), ids.take(pa.array(y)).combine_chunks()], ["x", "y"])

    return ready.select("g", "lo", "hi", "b", "id", "label", payload).mapInArrow(run, f"x {kind}, y {kind}")


def whole_cells(batches, keys: int, most: int = TOGETHER):
    """Tables of about `most` bytes, and each row's cell number, from batches in which rows of a cell (those that agree in the first `keys`
    columns) follow each other. No cell is cut: one that is larger comes whole."""
    held: list[pa.Table] = []
    cells: list[np.ndarray] = []
    last, number = None, -1
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        names = [repr(n) for n in zip(*[t.column(i).to_pylist() for i in range(keys)])]
        new = np.array([n != m for n, m in zip(names, [last, *names])])
        cell = number + np.cumsum(new)
        last, number = names[-1], int(cell[-1])
        step, a = max(1, len(t) * most // max(1, t.nbytes)), 0
        for c in np.flatnonzero(new).tolist():
            if sum(map(len, held)) + c - a >= step:
                yield pa.concat_tables([*held, t.slice(a, c - a)]), np.concatenate([*cells, cell[a:c]])
                held, cells, a = [], [], c
        held.append(t.slice(a))
        cells.append(cell[a:])
    if held:
        yield pa.concat_tables(held), np.concatenate(cells)


def numbered(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values."""
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(repr(v), len(seen)) for v in column.to_pylist()], np.int64)


def cross_links(t: pa.Table, cell: np.ndarray, percent: int, sets_of) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links between rows of one cell and different labels: one for each pair of labels of a cell. Columns: g, lo, hi, b, id,
    label, payload; rows of a cell follow each other."""
    none = np.zeros(0, np.int64)
    n, label = len(t), numbered(t.column(5))
    if n < 2 or label.max() == 0:
        return none, none
    members, count = sets_of(t.column(6).combine_chunks())
    if not len(members):
        return none, none
    row = np.repeat(np.arange(n), count)
    # members of different cells differ (but for chance, which only spares fewer); sorted with the row's number in the last bits
    last = C.U(n.bit_length())
    code = C.mix(members.astype(C.U) ^ C.mix((cell - cell[0] + 1).astype(C.U))[row])
    code = np.sort(code >> last << last | row.astype(C.U))
    code = code[np.diff(code, prepend=~code[:1]) != 0]
    row, code = (code & ((C.U(1) << last) - C.U(1))).astype(np.int64), code >> last
    count = np.bincount(row, minlength=n)
    alive = np.ones(n, bool)
    while len(row):
        # a member that one label alone has is in no intersection that counts; a row that is left with too little has no partner in its cell
        turn = np.concatenate([[True], code[1:] != code[:-1]])
        first, of = np.flatnonzero(turn), label[row]
        wanted = np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first)
        keep = wanted[np.cumsum(turn) - 1]
        row, code = row[keep], code[keep]
        stays = alive & (100 * np.bincount(row, minlength=n) >= percent * count)
        fell, alive = alive.sum() - stays.sum(), stays
        keep = alive[row]
        row, code = row[keep], code[keep]
        if 20 * fell <= alive.sum():  # what is left is compared anyway
            break
    left = np.flatnonzero(alive)
    order = np.argsort(row, kind="stable")
    row, code = row[order], code[order]
    b, lo, hi = (t.column(i).to_numpy() for i in (3, 1, 2))
    xs, ys = [none], [none]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(cell[left])) + 1, [len(left)]])
    for rows in (left[i:j] for i, j in zip(cut, cut[1:]) if j - i > 1):
        if (label[rows] == label[rows[0]]).all():
            continue
        i, j = np.searchsorted(row, [rows[0], rows[-1] + 1])
        apart = b[rows] if lo[rows[0]] != hi[rows[0]] else None
        x, y = cell_links(np.searchsorted(rows, row[i:j]), code[i:j], count[rows], label[rows], apart, percent)
        xs.append(rows[x])
        ys.append(rows[y])
    return np.concatenate(xs), np.concatenate(ys)


def cell_links(row: np.ndarray, code: np.ndarray, count: np.ndarray, label: np.ndarray, apart: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of different labels, one for each pair of labels; row and code: the members that may be in an intersection;
    count: sizes of the full sets; apart: only rows that differ in it are compared."""
    n = len(count)
    both = np.zeros((n, n), np.float32)
    if len(code):
        code = np.unique(code, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        top = int(code[-1]) + 1
        width = min(4096, top)
        for a in range(0, top, width):
            i, j = np.searchsorted(code, [a, a + width])
            m = np.zeros((n, width), np.float32)
            m[row[i:j], code[i:j] - a] = 1
            both += m @ m.T
    both = both.astype(np.int64)
    hit = 100 * both >= percent * (count[:, None] + count[None, :] - both)
    if apart is not None:
        hit &= apart[:, None] != apart[None, :]
    x, y = np.nonzero(np.triu(hit, 1) & (label[:, None] != label[None, :]))
    if len(x):
        pair = np.minimum(label[x], label[y]) * np.int64(label.max() + 1) + np.maximum(label[x], label[y])
        first = np.unique(pair, return_index=True)[1]
        x, y = x[first], y[first]
    return x, y
