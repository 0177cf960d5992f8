"""The comparison of lines on their full sets, held against sets of text."""

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import linking as K
from tidemark.llm import lines as L


def jaccard(x, y, k=5):
    a, b = ({s[i : i + k] for i in range(len(s) - k + 1)} for s in (x, y))
    return 100 * len(a & b) >= 80 * len(a | b)


def edited(r):
    a = [r.choice("abcdeä€😀 ") for _ in range(r.choice([0, 1, 4, 5, 6, 30, 80]))]
    b = list(a)
    for _ in range(r.randrange(4)):
        if b:
            b[r.randrange(len(b))] = r.choice("xyzü")
    return "".join(a), "".join(b * r.choice([1, 1, 2]))


def test_lines_compared_many_at_a_time():
    r = random.Random(1)
    pairs = [edited(r) for _ in range(3000)]
    x, y = (pa.array([p[i].encode() for p in pairs], pa.binary()) for i in (0, 1))
    for a in range(0, 3000, 512):  # slices, as batches come
        assert L.near_raw(x.slice(a, 512), y.slice(a, 512), 80, 5).tolist() == [jaccard(*p) for p in pairs[a : a + 512]]


def test_members_that_a_row_has_twice_count_once():
    texts = ["abababababab", "abababab", "abcdefghijkl", "abcdefghijklm", "abababababab", "zzzzzzzz"]
    cell = np.array([0, 0, 0, 0, 1, 1])
    columns = [cell, [0] * 6, [0] * 6, [0] * 6, list(range(6)), list(range(6))]
    t = pa.table([*[pa.array(c, pa.int64()) for c in columns], pa.array([s.encode() for s in texts], pa.binary())], names=["g", "lo", "hi", "b", "id", "label", "raw"])
    x, y = K.cross_links(t, cell, 80, lambda column: L.raw_members(column, 5))
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i in range(6) for j in range(i + 1, 6) if cell[i] == cell[j] and jaccard(texts[i], texts[j])} == {(0, 1), (2, 3)}


def test_keys_of_the_same_rows_are_one(spark, monkeypatch):
    """Near copies share many keys; the tables behind hold such keys once."""
    sets = {1: {1, 2, 3, 4, 5}, 2: {1, 2, 3, 4, 5}, 3: {1, 2, 3, 4}, 4: {7, 8}, 5: {7, 9}, 6: {9, 10}}
    keyed = [(k, i) for k in range(10, 15) for i in (1, 2, 3)] + [(k, i) for k in (20, 21) for i in (4, 5)] + [(30, 5), (30, 6)]
    full = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, set array<bigint>")
    tables, save = {}, K.C.save
    monkeypatch.setattr(K.C, "save", lambda df, name="t": tables.setdefault(name, save(df, name)) if name == "pivots" else save(df, name))
    meet = spark.createDataFrame(keyed, "key bigint, id bigint")
    members = lambda column: (column.flatten().to_numpy().astype(np.uint64), column.value_lengths().to_numpy())
    found = K.link(meet, lambda ids: full.join(ids, "id"), lambda edges, sets: K.verify_sets(edges, sets, 80), "set", members, 80)
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1)}
    assert sorted(r["key"] for r in tables["pivots"].collect()) == [10, 20, 30]


def test_places_of_small_and_large_ids(spark):
    """The first line in order of ids stands for its copies, whether places are longs or not."""
    for ids in ([-(2**32), -1, 0, 2**32 - 1], [-(2**63), -(2**32) - 1, 5, 2**63 - 1], [None, 2, 3, 4]):
        d = spark.createDataFrame([(i, f"x{k}\nthe same line in every one of the documents") for k, i in enumerate(ids)], "doc_id bigint, text string").repartition(4)
        low = min(i for i in ids if i is not None)
        got = {(r["doc_id"], r["line"]): (r["first_doc"], r["first_line"], r["kept"]) for r in L.fuzzy_lines(d, **L.WHOLE).collect()}
        assert got == {(i, n): (low, 1, i == low) if n and i is not None else (i, n, True) for i in ids for n in (0, 1)}


def test_a_line_is_signed_once_in_a_task(spark):
    docs = spark.createDataFrame([("the first line\nthe second line\nthe first line",), ("the second line\nTHE FIRST  line",)], "text string").coalesce(1)
    rows = L.line_bands(docs, "text", 1, 5, 6, 19, 1).collect()
    ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
    assert sorted(np.unique(ids, return_counts=True)[1].tolist()) == [19, 19]


def edited_copies(r, n, size=120, most=14):
    """Texts of one base of `size` words, each with up to `most` words replaced, put in or left out."""
    words = [f"w{i}" for i in range(400)]
    base, out = [r.choice(words) for _ in range(size)], []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randrange(most)):
            i = r.randrange(len(t))
            t[i : i + r.choice([1, 1, 1, 0])] = r.choice([[r.choice(words)]] * 3 + [[]])
        out.append(" ".join(t))
    return out


def test_large_groups_of_edited_copies_equal_brute_force(spark, monkeypatch):
    """Buckets of far more rows than a block, of copies of three bases, edited more and less: components as of all pairs. Keys are strings,
    some have several rows."""
    from tidemark.llm.minhash import near_duplicates

    monkeypatch.setattr(K, "BLOCK", 16)
    monkeypatch.setattr(K, "CROWD", 24, raising=False)
    r = random.Random(5)
    texts = edited_copies(r, 150) + edited_copies(r, 120, 40, 5) + edited_copies(r, 60, 200, 40) + ["w1", "", "w1 w2 w3 w4"]
    rows = [(f"d{r.randrange(100) if i % 11 == 0 else 1000 + i}", t) for i, t in enumerate(texts)]
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set() for w in (t.split() for _, t in rows)]
    low = {k: k for k, _ in rows}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                low[y] = x
    settled, settle = [], K.settle
    monkeypatch.setattr(K, "settle", lambda crowd, *a: settled.append(crowd.count()) or settle(crowd, *a))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), k=4).collect()
    assert {(x["doc_id"], x["component_id"]) for x in got} == {(k, root(k)) for k in low}
    assert settled[0] > 150 and len({root(k) for k in low}) > 50


def test_block_pairs_of_edited_copies_grow_with_the_rows(spark, monkeypatch):
    """Of four times the copies come less than eight times the rows of block pairs (sixteen times, were all blocks compared)."""
    from tidemark.llm.minhash import near_duplicates

    monkeypatch.setattr(K, "BLOCK", 32)
    monkeypatch.setattr(K, "CROWD", 64, raising=False)
    r, dealt = random.Random(6), []
    texts, compare = edited_copies(r, 1600), K.compare_blocks

    def counted(rows, *a):
        sizes = {}
        for x in rows.groupBy("g", "label").count().collect():
            sizes.setdefault(x["g"], []).append(x["count"])
        for c in sizes.values():
            major, minor = max(c), sum(c) - max(c)
            na, nu = -(-major // 32), -(-minor // 32)
            dealt[-1] += major * nu + minor * (nu + na)
        return compare(rows, *a)

    monkeypatch.setattr(K, "compare_blocks", counted)
    for n in (400, 1600):
        dealt.append(0)
        near_duplicates(spark.createDataFrame(list(enumerate(texts[:n])), "doc_id bigint, text string"), k=4).count()
    assert 0 < dealt[1] < 8 * max(dealt[0], 1600), dealt
