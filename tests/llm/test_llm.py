"""The ten operators and the pipeline on small fixtures: brute force, round trips, odd rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
random.seed(3)
WORDS = [f"w{i}" for i in range(400)]
ODD = [None, "", "   \n ", "one", "A a\tB\x0bc", "\x00 ퟿ é日本 ##  !!", "word " * 30000]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, n, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def least_reachable(ids, links):
    at = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(at[a], at[b])
            changed |= at[a] != m or at[b] != m
            at[a] = at[b] = m
    return at


@pytest.fixture(scope="module")
def texts():
    out = []
    for g in range(12):
        base = prose(120 + 10 * g, g)
        out += [base, base] + [edited(base, n, 100 * g + n) for n in (1, 2, 3, 5, 8, 12)]
    base = prose(150, 99)
    out += [edited(base, i % 9, 7000 + i) for i in range(60)]  # one large group of near copies
    return out + ODD


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 5 else "src0", i * 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n double").repartition(5)


# ---------------------------------------------------------------- 1 sharding

def test_flow_is_cheapest():
    from tidemark.llm.sharding import min_cost_flow

    for seed in range(40):
        r = random.Random(seed)
        supply = [r.randrange(0, 4) for _ in range(3)]
        cost = [[r.randrange(0, 6) for _ in range(3)] for _ in range(3)]
        cap = [r.randrange(1, 5) for _ in range(3)]
        if sum(supply) > sum(cap):
            with pytest.raises(ValueError):
                min_cost_flow(supply, cap, cost)
            continue
        flow = min_cost_flow(supply, cap, cost)
        assert [sum(x) for x in flow] == supply and all(sum(f[j] for f in flow) <= cap[j] for j in range(3))
        got = sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        best = min((sum(cost[i][j] for i, j in zip(units, way)) for way in itertools.product(range(3), repeat=len(units)) if all(way.count(j) <= cap[j] for j in range(3))), default=0)
        assert got == best


def test_reshard_is_even_gapless_and_moves_little(spark):
    from tidemark.llm.sharding import reshard, rewrite

    r = random.Random(1)
    rows = [(i, 10 + r.randrange(90), 0 if i % 3 == 0 else i % 6, "x", "clash") for i in range(3000)] + [(None, 20, None, "y", "clash"), (5, 50, 1, "z", "clash"), (5, 50, 1, "z", "clash")]
    d = spark.createDataFrame(rows, "doc_id bigint, size bigint, home int, t string, slot string")
    got = reshard(d, F.col("home"), 8, bucket_rows=100).toPandas()
    assert len(got) == len(rows) and got.t.notna().all()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() <= 200
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    old = got.groupby("old_shard")["size"].sum()
    fewest = sum(max(0, old.get(s, 0) - size.sum() // 8 - 1) for s in range(8)) + 20
    assert got[got.moved]["size"].sum() <= fewest + 8 * 100
    assert reshard(d.limit(0), F.col("home"), 8).count() == 0


def test_rewrite_leaves_untouched_shards(spark, tmp_path):
    from tidemark.llm.sharding import reshard, rewrite

    d = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(10).cast("bigint").alias("size"), F.when(F.col("id") < 100, 0).when(F.col("id") < 250, 1).when(F.col("id") < 300, 2).otherwise(3).alias("home"))
    plan = reshard(d, F.col("home"), 4)
    assert rewrite(plan, str(tmp_path / "o"), file_rows=60) == [1, 2]
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == 200 and {r[0] for r in back.select("shard").distinct().collect()} == {1, 2}


def test_rewrite_in_place_keeps_untouched_shards(spark, tmp_path):
    from tidemark.llm.sharding import reshard, rewrite

    at = str(tmp_path / "o")
    # 0 and 3 stay as they are, 1 gives to 2, and 7 and the null shard lose all they have
    home = F.when(F.col("id") < 100, 0).when(F.col("id") < 250, 1).when(F.col("id") < 270, 2).when(F.col("id") < 290, 7).when(F.col("id") < 300, None).otherwise(3)
    spark.range(400).select(F.col("id").alias("doc_id"), F.lit(10).cast("bigint").alias("size"), home.alias("shard")).write.partitionBy("shard").parquet(at)
    plan = reshard(spark.read.parquet(at).withColumnRenamed("shard", "home"), F.col("home"), 4)
    assert rewrite(plan, at, file_rows=60) == [1, 2, 7]
    back = spark.read.parquet(at)
    assert sorted(r[0] for r in back.select("doc_id").collect()) == list(range(400))
    assert {r[0]: r[1] for r in back.groupBy("shard").count().collect()} == {0: 100, 1: 100, 2: 100, 3: 100}


# ---------------------------------------------------------------- 2 and 6 vectors

@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[7] + 0.15 * rng.normal(size=(60, 16))
    x[160:170] = x[160]
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 2 if i < 100 or i >= 170 else 0) for i in range(300)]
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [float("inf")] * 16, 0), (904, [None] * 16, 0), (905, [], 0), (906, rows[7][1], None), (907, [1.0, 2.0], 0)]
    return rows, spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int").repartition(4)


def test_search_has_recall_and_exact_scores(vectors):
    from tidemark.llm.mih import search

    rows, df = vectors
    got = search(df.where("vec_id <> 906"), "vec_id % 20 = 0 and vec_id < 900", bits=16, least_shard=50).toPandas()
    x = np.array([r[1] for r in rows], np.float64)
    hit = total = 0
    for q in range(0, 300, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((d[j], j) for j in range(300) if j != q)[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for v, s in zip(mine.vec_id, mine.score))
        hit += len({j for _, j in want} & set(mine.vec_id))
        total += 10
    assert hit / total >= 0.9 and set(got.query_id) == set(range(0, 300, 20))


def test_search_falls_back_to_all_rows_and_takes_little(spark, vectors):
    from tidemark.llm.mih import search

    rows, df = vectors
    few = df.where("vec_id < 5")
    got = search(few, "vec_id = 0", radius=0).toPandas()
    x = np.array([r[1] for r in rows[:5]], np.float64)
    assert list(got.sort_values("rank").vec_id) == [j for _, j in sorted((((x[j] - x[0]) ** 2).sum(), j) for j in range(1, 5))]
    assert search(df.limit(0), "vec_id = 0").count() == 0


@pytest.mark.parametrize("n", [300, 1500, 6000])
def test_search_recall_with_the_query_s_own_parameters(spark, n):
    """Vectors without any structure, the hardest case: recall at each size, and the radius that was learned."""
    from tidemark.llm.mih import search

    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(3)
    got = search(d, "vec_id % 100 = 0").toPandas()
    x = x.astype(np.float64)
    hit = 0
    for q in range(0, n, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(far[mine.vec_id], mine.score, rtol=1e-14)
        hit += len(set(np.argsort(far)[:10]) & set(mine.vec_id))
    assert hit / (10 * len(range(0, n, 100))) >= 0.9


def test_tables_find_every_code_within_the_radius():
    from tidemark.llm.mih import Tables

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    codes[:500] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    for width in (4, 8, 16):
        tables = Tables(codes, 64, width)
        for radius in (0, 1, 2, 3, 7, 12, 20, 27, 31, 64):
            for q in (0, 5, 700, 2999):
                assert list(tables.within(codes[q], radius)) == list(np.flatnonzero(np.bitwise_count(codes ^ codes[q]) <= radius))


def test_search_takes_repeated_keys_row_by_row(spark):
    from tidemark.llm.mih import search

    x = np.random.default_rng(4).normal(size=(40, 8))
    x[20:24] = x[3]  # ties
    keys = [*range(36), 0, 0, 7, None]
    d = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "vec_id bigint, embedding array<double>").repartition(4)
    got = search(d.withColumn("id", F.lit(1)).withColumn("row", F.lit(2)), "vec_id in (0, 7)", k=5, bits=8).toPandas()
    want = []
    for q, key in enumerate(keys):
        if key in (0, 7):
            near = sorted((float(np.sqrt(((x[j] - x[q]) ** 2).sum())), k) for j, k in enumerate(keys) if k is not None and k != key)[:5]
            want += [(key, r + 1, k, s) for r, (s, k) in enumerate(near)]
    mine = sorted(got.itertuples(index=False, name=None), key=lambda r: (r[0], r[3], r[1]))
    assert len(mine) == len(want) == 25
    for a, b in zip(mine, sorted(want, key=lambda r: (r[0], r[3], r[1]))):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-12)


def test_near_vectors_equal_brute_force(vectors):
    from tidemark.llm.pstable import near_vectors

    rows, df = vectors
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    at = least_reachable(range(300), [tuple(p) for p in np.argwhere(hit) if p[0] < p[1]])
    got = near_vectors(df).toPandas().set_index("vec_id")
    assert len(got) == 308
    for i in range(300):
        assert (got.n_links[i], got.component_id[i], got.kept[i]) == (hit[i].sum(), at[i], at[i] == i)
    assert all(got.n_links[i] == 0 and got.kept[i] for i in range(900, 908)) and hit.sum() > 500


# ---------------------------------------------------------------- 3, 8 near-duplicates

@pytest.mark.parametrize("task_links", [10**6, 7])
def test_components_equal_brute_force(spark, task_links):
    from tidemark.llm.common import components

    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 - i) for i in range(1, 12)]
    want = least_reachable({x for p in links for x in p if p[0] != p[1]}, links)
    d = spark.createDataFrame([*links, (None, 1), (1, None), (5, 5)], "a bigint, b bigint")
    assert {x["node"]: x["component"] for x in components(d, task_links=task_links).collect()} == want
    assert components(d.limit(0), task_links=task_links).count() == 0
    words = spark.createDataFrame([("b", "é"), ("b", "a"), ("x", "y")], "a string, b string")
    assert {x["node"]: x["component"] for x in components(words).collect()} == {"a": "a", "b": "a", "é": "a", "x": "x", "y": "x"}


def test_near_duplicates_equal_brute_force(docs, texts):
    from tidemark.llm.minhash import near_duplicates

    sets = [shingle_set(t, 4) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    at = least_reachable(range(len(texts)), links)
    got = near_duplicates(docs.withColumn("id", F.lit(1)).withColumn("n", F.lit(1)), k=4).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got.n_shingles[i], got.component_id[i], got.kept[i]) == (len(s), at[i], at[i] == i)


def test_near_duplicates_of_nothing(docs, spark):
    from tidemark.llm.minhash import near_duplicates

    assert near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, near_duplicates(odd).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (2, 0, 2, True), (2, 0, 2, True), (None, 2, None, None)], key=repr)


def test_chained_buckets_are_compared_bucket_by_bucket(spark, monkeypatch):
    """Chains of edits with more rows than a block (of 3 here): the components are those of brute force."""
    from tidemark.llm import linking
    from tidemark.llm.minhash import near_duplicates

    rows = []
    for c, step in enumerate((1, 2, 2, 1, 3)):
        words = [f"c{c}w{i}" for i in range(60)]
        for j in range(8):
            rows.append((c * 100 + j, " ".join(words)))
            for e in range(step):
                words[(7 * (j * step + e)) % 60] = f"e{c}x{j}x{e}"
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    at = least_reachable(list(sets), links)
    calls, compare = [], linking.compare_blocks
    monkeypatch.setattr(linking, "BLOCK", 3)
    monkeypatch.setattr(linking, "compare_blocks", lambda *a: calls.append(a[0].count()) or compare(*a))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == at and len(set(at.values())) > 5
    assert len(calls) == 2 and calls[1] > 3


@pytest.mark.parametrize("chunk, buckets", [(7, 5), (1000, 1), (40, 300)])
def test_packed_keys_give_all_meetings(spark, chunk, buckets):
    """Rows that share a key, by brute force: with a key of a third of all rows, repeated rows, and keys within and across chunks."""
    import numpy as np

    from tidemark.llm import linking

    rng = np.random.default_rng(chunk)
    rows = [(i, [-9 if i % 3 == 0 else i + 10**6, int(rng.integers(0, 150)), -int(rng.integers(10, 10**4))]) for i in range(200)]
    rows += rows[50:90] + rows[:5]
    keyed = {(k, i) for i, ks in rows for k in ks}
    by_key = {}
    for k, i in keyed:
        by_key.setdefault(k, set()).add(i)
    want = sorted((k, i) for k, i in keyed if len(by_key[k]) > 1)
    reps = spark.createDataFrame(rows, "id bigint, keys array<bigint>").repartition(3)

    def run(batches):
        parts = ((b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), np.int64).reshape(-1, 3)) for b in batches if len(b))
        return linking.pack_keys(parts, buckets, chunk)

    got = linking.packed_meetings(reps.mapInArrow(run, linking.PACKED), buckets).select("key", "id")
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, linking.meetings(reps).distinct().collect())) == want
    assert linking.packed_meetings(reps.limit(0).mapInArrow(run, linking.PACKED), buckets).count() == 0


def test_lines_equal_brute_force(spark):
    from tidemark.llm.lines import dedup_lines, fuzzy_lines

    base = [prose(14, 500 + i) for i in range(30)]
    rows = []
    for i in range(60):
        r = random.Random(i)
        ls = [base[r.randrange(30)] for _ in range(4)]
        ls[0] = ls[0].replace("w1", "W2", 1)
        ls[1] = ls[1].replace(" ", "  ") + " "
        rows.append((i, "\n".join(["short", *ls, ""]), "clash"))
    rows += [(100, None, "c"), (101, "", "c"), (102, "\n\n", "c"), (103, base[3] * 400, "c")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, gone string").repartition(3)
    lines = [(i, k, re.sub(r"[ \t\v\f\r]+", " ", lower(x)).strip(" ")) for i, t, _ in rows for k, x in enumerate((t or "").split("\n"))]
    long_ = [x for x in lines if len(x[2].encode()) >= 30]
    sets = {(i, k): {t[j : j + 9] for j in range(len(t) - 8)} for i, k, t in long_}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    at = least_reachable([(i, k) for i, k, _ in lines], links)
    got = {(r["doc_id"], r["line"]): ((r["first_doc"], r["first_line"]), r["kept"]) for r in fuzzy_lines(d).collect()}
    assert got == {x: (at[x], at[x] == x) for x in at}
    out = {r["doc_id"]: r for r in dedup_lines(d).collect()}
    for i, t, _ in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if at[i, k] == (i, k)]
        if len(kept) == len((t or "").split("\n")):
            assert out[i]["text"] == t
        elif not "".join(kept).strip():
            assert i not in out
        else:
            assert out[i]["text"] == "\n".join(kept)
    assert out[0]["gone"] == "clash" and dedup_lines(d.limit(0)).count() == 0


def test_short_lines_take_part(spark):
    from tidemark.llm.lines import WHOLE, dedup_lines, fuzzy_lines

    rows = [(0, "les.\nAll rights reserved.\n\nx"), (1, " LES.\n\nall rights  reserved.\né"), (2, "les.\nAll rights reserved.\n\nx"), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["line"]): (r["first_doc"], r["first_line"], r["kept"]) for r in fuzzy_lines(d, **WHOLE).collect()}
    assert got[1, 0] == got[2, 0] == (0, 0, False) and got[1, 2] == got[2, 1] == (0, 1, False) and got[2, 3] == (0, 3, False)
    assert all(got[x] == (*x, True) for x in [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 3), (2, 2), (None, 0)])
    assert {r["doc_id"]: r["text"] for r in dedup_lines(d, **WHOLE).collect()} == {0: rows[0][1], 1: "\né", None: "x"}


def test_edited_short_lines_are_linked(spark):
    from tidemark.llm.lines import WHOLE, fuzzy_lines

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéüß") for _ in range(n))
    rows = []
    for i in range(60):
        # 49 characters on with one changed character, 81 on with one changed four-letter word
        size = 50 + i % 40 if i < 40 else 84 + i % 6
        line = ""
        while len(line) < size:
            line += word(4) + " "
        line = line[:size].strip().ljust(size, "q")
        at = 5 * (size // 10)
        new = line[: at + 1] + "7" + line[at + 2 :] if i < 40 else line[:at] + "7777" + line[at + 4 :]
        rows += [(2 * i, line), (2 * i + 1, new)]
    got = {x["doc_id"]: x["first_doc"] for x in fuzzy_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), **WHOLE).collect()}
    assert all(got[2 * i] == 2 * i for i in range(60))
    assert sum(got[2 * i + 1] == 2 * i for i in range(40)) >= 38 and sum(got[2 * i + 1] == 2 * i for i in range(40, 60)) >= 19


# ---------------------------------------------------------------- 4 quality

def test_quality_rejects_junk_and_shrinks_sparse_sites(spark):
    from tidemark.llm.quality import classify

    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        junk = i % 5 == 0
        t = " ".join(r.choice(["THE!!", "BUY###", "WIN%%%", "NOW&&&"]) for _ in range(60)) if junk else prose(60, i)
        rows.append((i, t, "bad" if junk and i % 2 else f"h{i % 7}", f"p{i % 40}"))
        if i % 2:
            labels.append((i, int(not junk)))
    rows += [(9000 + i, t, None, None) for i, t in enumerate(ODD)] + [(9000, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = classify(d, lab, F.col("host"), F.concat_ws("/", "host", "path")).toPandas()
    assert len(got) == len(rows)
    real = got[got.doc_id < 9000].set_index("doc_id")
    assert all(real.accepted[i] == (i % 5 != 0) for i in range(600))
    assert got.posterior.between(0, 1).all() and real[real.host == "bad"].host_posterior.max() < 0.5 < real[real.host == "h1"].host_posterior.min()
    none = classify(d, lab.limit(0), F.col("host"), F.col("path")).toPandas()
    assert len(none) == len(rows) and none.posterior.notna().all()
    assert classify(d.limit(0), lab, F.col("host"), F.col("path")).count() == 0


def test_quality_posteriors_equal_a_recomputation(spark):
    """Every posterior from the evidence column alone, level by level, in plain Python; clashing names are replaced."""
    from tidemark.llm.quality import classify

    r = random.Random(11)
    rows = []
    for i in range(400):
        bad = r.random() < (0.8 if i % 9 == 0 else 0.1)
        rows.append((i, "##!! $$%% " * 20 + "x" * (i % 7) if bad else prose(20 + i % 50, i), None if i % 50 == 7 else f"h{i % 9}", f"p{i % 30}", 5.0, "old"))
    rows += [(400, None, "h1", "p9", 5.0, "old"), (400, "", "h1", "p9", 5.0, "old"), (None, "one", "lone", None, 5.0, "old")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, site string, page string, llr double, accepted string").repartition(3)
    lab = spark.createDataFrame([(i, int("#" not in rows[i][1])) for i in range(0, 400, 2)], "doc_id bigint, quality int")
    got = [x.asDict() for x in classify(d, lab, F.col("site"), F.col("page"), keep=["doc_id", "text", "llr", "accepted"]).collect()]
    assert len(got) == len(rows) and {x["text"] for x in got} == {x[1] for x in rows}
    share = sum(int("#" not in rows[i][1]) for i in range(0, 400, 2)) / 200
    base = np.log(share / (1 - share))
    logit = lambda p: np.log(p / (1 - p))
    for x in got:
        x["p"] = 1 / (1 + np.exp(-(x["llr"] + base)))

    def total(*names):
        out = {}
        for x in got:
            g, n = out.get(tuple(x[c] for c in names), (0.0, 0))
            out[tuple(x[c] for c in names)] = (g + x["p"], n + 1)
        return out

    def worth(groups, mean):
        many = [(g, n, mean(k)) for k, (g, n) in groups.items() if n >= 2]
        room = sum((n - 1) * m * (1 - m) for _, n, m in many)
        rho = (sum(n * (g / n - m) ** 2 for g, n, m in many) - sum(m * (1 - m) for _, _, m in many)) / room
        return min(1000.0, max(1.0, 1 / max(rho, 1e-3) - 1))

    hosts, paths = total("host"), total("host", "path")
    mean = sum(x["p"] for x in got) / len(got)
    a = worth(hosts, lambda k: mean)
    of_host = {k: (g + a * mean) / (n + a) for k, (g, n) in hosts.items()}
    b = worth(paths, lambda k: of_host[k[:1]])
    for x in got:
        g, n = paths[x["host"], x["path"]]
        own = min(1 - 1e-6, max(1e-6, (g - x["p"] + b * of_host[x["host"],]) / (n - 1 + b)))
        assert x["host_posterior"] == pytest.approx(of_host[x["host"],], rel=1e-9) and x["path_posterior"] == pytest.approx(own, rel=1e-9)
        assert x["posterior"] == pytest.approx(1 / (1 + np.exp(-(x["llr"] + logit(own)))), rel=1e-9) and x["accepted"] == (x["posterior"] >= 0.5)


def test_quality_learns_words_that_statistics_cannot_tell_apart(spark):
    from tidemark.llm.quality import classify

    r = random.Random(12)
    good, bad = [f"{a}{b}" for a in "bdfg" for b in ("alo", "ire", "unt")], [f"{a}{b}" for a in "klmn" for b in ("eso", "ota", "urn")]
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) if r.random() < 0.7 else r.choice(WORDS[:40]) for _ in range(40)), "h", "p") for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(250)], "doc_id bigint, quality int")
    got = classify(d, lab, F.col("host"), F.col("path")).toPandas().set_index("doc_id")
    assert np.mean([got.accepted[i] == bool(i % 2) for i in range(250, 500)]) > 0.97


# ---------------------------------------------------------------- 5 BPE, 7 packing

def test_bpe_equals_the_library(docs, texts):
    import hashlib

    import tiktoken
    from tidemark.llm.bpe import codec, digests

    path = P.path("byte_bpe_50k.tiktoken")
    c = codec(path, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(2)
    for n in (1, 2, 7, 60, 300, 5000):
        for alphabet in ("ab", "abeinrst", ["é", "日", "a", " ", "  ", "\n", "1", "'s", "ing", "🙂"]):
            t = "".join(r.choice(alphabet) for _ in range(n))
            assert c.encode(t) == enc.encode_ordinary(t) and c.decode(c.encode(t)) == t.encode()
    got = digests(docs, path, P.PATTERN).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got.n_tokens[i] == len(ids) and got.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got.decoded_sha256[i] == hashlib.sha256((t or "").encode()).hexdigest()


def test_best_fill_is_optimal():
    from tidemark.llm.packing import best_fill, plan

    for seed in range(60):
        r = random.Random(seed)
        counts = {r.randrange(1, 15): r.randrange(1, 4) for _ in range(4)}
        room = r.randrange(1, 40)
        used = best_fill(room, dict(counts))
        assert all(used[k] <= counts[k] for k in used)
        best = max(sum(k * n for k, n in zip(counts, way)) for way in itertools.product(*[range(n + 1) for n in counts.values()]) if sum(k * n for k, n in zip(counts, way)) <= room)
        assert sum(k * n for k, n in used.items()) == best
        total = {}
        for pattern, times in plan(counts, 40):
            assert sum(k * n for k, n in pattern.items()) <= 40
            for k, n in pattern.items():
                total[k] = total.get(k, 0) + n * times
        assert total == counts


def test_packing_holds_every_id_once(docs, texts):
    from tokenizers import Tokenizer

    from tidemark.llm.packing import materialize, pack, pack_documents, pieces_of

    path = P.path("byte_bpe_50k.tiktoken")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]
    got = pack_documents(docs, path, P.PATTERN, window=256).toPandas()
    for i, g in got.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    assert got.doc_id.nunique() == len(texts)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 256
    assert got.length.sum() / (got.sequence_id.nunique() * 256) > 0.98
    full = materialize(pack(pieces_of(docs, path, P.PATTERN, window=256, with_ids=True), 256), 256)
    assert full.where("size(ids) <> 256").isEmpty() and full.count() == got.sequence_id.nunique()
    assert pack_documents(docs.limit(0), path, P.PATTERN).count() == 0


def test_packing_knows_added_tokens(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.packing import pieces_of

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n é", "<|endoftext |> <|endoftext", "a  \n<|endoftext|>  b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in pieces_of(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)} and 50256 in got[0]


# ---------------------------------------------------------------- 9 language model

def test_hmm_forward_is_exact_and_training_helps(docs, texts, spark):
    from tidemark.llm import hmm

    rng = np.random.default_rng(0)
    start, move, emit = (rng.random(s) for s in ((3,), (3, 3), (3, hmm.CLASSES + 1)))
    m = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    seqs = [[], [5], [5, 9, 5], [1, 2, 3, 4]]
    got = hmm.forward(m, np.array([k for s in seqs for k in s], np.int64), np.array([len(s) for s in seqs]))
    for s, g in zip(seqs, got):
        o = [*s, hmm.END]
        total = sum(m.start[z[0]] * np.prod([m.emit[z[i], o[i]] for i in range(len(o))]) * np.prod([m.move[z[i], z[i + 1]] for i in range(len(o) - 1)]) for z in itertools.product(range(3), repeat=len(o)))
        assert g == pytest.approx(np.log(total))
    long_ = rng.integers(0, 50, 90)
    sizes = np.array([0, 1, 2, 3, 4, 8, 72])
    for stretch in (1, 2, 3, 4, 1000):  # however it is cut, the recursion is that of the whole text
        assert np.allclose(hmm.forward(m, long_, sizes, stretch), hmm.forward(m, long_, sizes), rtol=1e-12)
    a, _, b, e = hmm.expected(m, np.array([5, 9, 5], np.int64), np.array([3]))
    assert a.sum() == pytest.approx(1, abs=1e-4) and b.sum() == pytest.approx(3, abs=1e-4) and e[:, 5].sum() == pytest.approx(2, abs=1e-4)
    out = hmm.score(docs, F.col("doc_id") % 5 == 1).toPandas().set_index("doc_id")
    counts = {}
    for i, t in enumerate(texts):
        if i % 5 != 1:
            for w in [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        w = [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
        assert (out.n_tokens[i], out.n_known[i], out.train_tokens[i], out.held_out[i]) == (len(w), sum(x in counts for x in w), n, i % 5 == 1)
        assert out.base_score[i] == pytest.approx(sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    assert out.score.sum() > out.base_score.sum() and (out.score < 0).all()
    assert hmm.score(docs.limit(0), F.lit(False)).count() == 0
    nothing = hmm.score(docs, F.lit(True)).toPandas()
    assert (nothing.train_tokens == 0).all() and (nothing.n_known == 0).all()


def test_hmm_trains_on_every_text(spark):
    from tidemark.llm import hmm

    texts = [prose(40, i) for i in range(320)] + [prose(4000, 999)]  # more texts than the sample once held, and one beyond 8,192 bytes
    model, likelihoods = hmm.train(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), 2, 3)
    ids, per = hmm.encode(*hmm.C.string_parts(hmm.pa.array(texts)))
    kinds = (ids >> hmm.C.U(hmm.HASH_BITS)).astype(np.int64)
    base = np.bincount(kinds, minlength=hmm.CLASSES + 1)
    base[hmm.END] = len(texts)
    cut = [(x, a == 0, b == len(x_)) for x_ in np.split(kinds, np.cumsum(per)[:-1]) for a, b in hmm.runs(x_) for x in [x_[a:b]]]
    runs = np.concatenate([x for x, _, _ in cut]), np.array([len(x) for x, _, _ in cut]), np.array([f for _, f, _ in cut]), np.array([e for _, _, e in cut])
    assert len(cut) == 320 + 8 and runs[2].sum() == runs[3].sum() == 321
    want, seen = hmm.Model.first(base, 2), []
    for _ in range(3):
        *counts, likelihood = hmm.expected_and_likelihood(want, *runs)
        want = hmm.Model.from_counts(*counts)
        seen.append(likelihood)
    assert likelihoods == pytest.approx(seen, rel=1e-4) and likelihoods == sorted(likelihoods)
    assert np.allclose(model.emit, want.emit, rtol=1e-2, atol=1e-5) and np.allclose(model.move, want.move, atol=1e-3)


def test_hmm_beats_its_base_on_held_out_texts(spark):
    """Texts of three vocabularies whose word forms alternate: what the states can learn and single words cannot."""
    from tidemark.llm import hmm

    r = random.Random(6)
    forms = [[[f"{c}{i}{e}" for i in range(40)] for e in ends] for c, ends in (("k", ("ing", "ted", "ous")), ("m", ("ung", "lich", "heit")), ("z", ("cion", "mente", "idad")))]
    rows = [(i, " ".join(r.choice(forms[i % 3][j % 3]) for j in range(30 + i % 700))) for i in range(400)]
    out = hmm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1).toPandas()
    held = out[out.held_out]
    assert len(held) > 40 and (held.n_known == held.n_tokens).all()
    bits = -held.score.sum() / np.log10(2) / held.n_tokens.sum()
    base = -held.base_score.sum() / np.log10(2) / held.n_tokens.sum()
    assert bits < base - 1
    mine = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    assert dict(zip(out.doc_id, out.held_out)) == mine


# ---------------------------------------------------------------- 10 chat

def conversation(rows):
    return "".join(r["rendered"] for r in sorted(rows, key=lambda r: (r["out_turn"], r["turn"] if r["turn"] is not None else -1, r["role"] or "", r["text"] or "")))


def test_chat_repair_is_legal_and_cheapest(spark):
    from tidemark.llm import chat

    def cheapest(roles):
        best = {chat.START: 0}
        for role in roles:
            new = {}
            for s, c in best.items():
                for cost, to, _, _ in chat.moves(s, role):
                    new[to] = min(new.get(to, 10**9), c + cost)
            best = new
        return min(c + chat.closing(s)[0] for s, c in best.items())

    for roles in itertools.product(range(4), repeat=4):
        solved = chat.solve(roles, chat.START)
        e = chat.final(solved)
        assert solved[e][0] + chat.closing(e)[0] == cheapest(roles)
    rows, r = [], random.Random(4)
    for c in range(40):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["system", "user", "assistant", "Human", "bot", "weird", None]), f"t{c}.{t}"))
    rows += [(77, t, "user" if t % 3 else "assistant", f"h{t}") for t in range(400)] + [(None, 0, "user", "lost"), (5, None, None, None), (6, 0, "user", "same"), (6, 0, "user", "same")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.repair(d, partitions=7).toPandas()
    assert len(got) == len(rows) and (got.action == "orphan").sum() == 1
    one = chat.repair(d, partitions=1).toPandas()
    key = ["conv_id", "turn", "role", "action", "new_role", "out_turn", "inserted_before", "rendered"]
    assert sorted(map(repr, got[key].astype(str).values.tolist())) == sorted(map(repr, one[key].astype(str).values.tolist()))
    for _, g in got[got.action != "orphan"].groupby("conv_id"):
        text = "".join(g.sort_values(["out_turn", "turn"], na_position="first").rendered)
        roles = re.findall(r"<\|(system|user|assistant)\|>", text)
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2) or roles == ["system", *body]
        assert text.count("<|end|>") == len(roles) and text.endswith("<|end|>\n")
    assert chat.repair(d.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, docs, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    docs = docs.drop("n").withColumn("n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.select("doc_id", F.lit(1).alias("quality")).limit(5).write.parquet(str(tmp_path / "labels.parquet"))
    d = docs.withColumn("gone", F.lit(1)).withColumn("row", F.lit(1)).withColumn("posterior", F.lit(1))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        d = out
    assert 0 < d.count() < docs.count()
    assert cp.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "start"]


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {m[0] for n in names if (m := re.match(r"op\d+_", n))} == {f"op{i}_" for i in range(1, 11)}
    assert "pipeline" in names
