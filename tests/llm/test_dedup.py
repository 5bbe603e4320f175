"""Exact and near dedup, sharding."""

import itertools
import random
import re

from pyspark.sql import functions as F

from zonemill.llm.common import without_ids
from zonemill.llm.exact_dedup import drop_copies, exact_groups
from zonemill.llm.setsketch import components, near_groups
from zonemill.llm.sharding import regular, shard_slots


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_exact_edges(spark, hard):
    got = exact_groups(hard)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert got.count() == 10 and got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert by[1][0]["keep_id"] == 2 and by[2][0]["kept"]  # two spaces: more code points
    assert by[3][0]["keep_id"] == 5 and by[5][0]["group_size"] == 3  # null, empty and blank are equal; blank is longest
    assert sum(r["kept"] for r in by[7]) == 1
    assert by[None][0]["kept"]


def test_exact_ties_and_empty(docs):
    got = {r["doc_id"]: r for r in exact_groups(docs([(9, "a b"), (4, "a b"), (5, "ab ")])).collect()}
    assert {r["keep_id"] for r in got.values()} == {4} and got[4]["group_size"] == 3
    assert exact_groups(docs([(1, "x")]).limit(0)).count() == 0


def test_collisions_are_split_by_bytes(docs):
    texts = [(i, f"text {i % 7}") for i in range(40)]
    weak = exact_groups(docs(texts), content_hash=lambda c: F.substring(F.md5(c), 1, 1))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in weak.collect()} == {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_groups(docs(texts)).collect()}


def test_drop_copies(docs):
    d = docs([(1, "a b"), (1, "a b"), (2, "ab"), (3, "c"), (None, "d"), (None, "d"), (4, None)], extra=True)
    left = drop_copies(d)
    assert sorted(map(str, rows_of(left.select("doc_id", "text")))) == sorted(map(str, [(1, "a b"), (3, "c"), (None, "d"), (4, None)]))
    assert left.columns == d.columns


def test_without_ids(spark, docs):
    d = docs([(i, "x") for i in range(50)] + [(None, "y")])
    assert without_ids(d, spark.createDataFrame([(i,) for i in range(0, 50, 2)], "k long")).count() == 26


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(rows_of(components(spark.createDataFrame(chain, "a long, b long"))))
    assert {got[i] for i in range(2, 61)} == {1} and got[101] == got[102] == 100


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_against_brute_force(docs):
    random.seed(5)
    rows, words = [], [f"w{i}" for i in range(300)]
    for base in range(12):
        text = [random.choice(words) for _ in range(random.choice((8, 60, 200)))]
        for _ in range(12):
            copy = list(text)
            for _ in range(random.randint(0, len(text) // 15)):
                copy[random.randrange(len(copy))] = random.choice(words)
            rows.append((len(rows) + 1, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "Only two"), (903, "only TWO"), (904, "only  two three")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(docs(rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_near_links_at_the_limit(docs):
    """Pairs of similarity 0.80 exactly: 80 words shared, ten of each one's own."""
    rows = []
    for k in range(500):
        shared = [f"s{k}x{i}" for i in range(80)]
        rows += [(2 * k + side, " ".join(shared + [f"o{side}x{k}x{i}" for i in range(10)])) for side in (0, 1)]
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in near_groups(docs(rows), 1, 80).collect())


def test_near_edges(hard, docs):
    got = near_groups(hard)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 10
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and not by[2]["kept"]
    assert by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[3]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_groups(docs([(1, "x")]).limit(0)).count() == 0


def test_shards(hard, docs):
    tree = regular(2, 2, 2)
    got = shard_slots(hard, tree, tree.grow(), lanes=4).collect()
    assert len(got) == 10 and {r["size"] for r in got if r["doc_id"] == 3} == {16}
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} <= {8}
    many = shard_slots(docs([(i, "x") for i in range(2000)]), tree, tree.grow()).collect()
    moved = [r for r in many if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {8} and 120 < len(moved) < 330
    assert all(170 < sum(r["shard"] == s for r in many) < 330 for s in range(8))
    assert shard_slots(docs([(1, "x")]).limit(0), tree, tree.grow()).count() == 0


CLASHING = ("row", "gone", "_hit", "_bucket", "_at", "_bits", "_len", "_id", "_sha", "_rank", "_gone", "id", "sha", "stay_id")


def test_names_of_other_columns_do_not_matter(docs):
    given = docs([(1, "a b"), (2, "a  b"), (3, "c"), (None, "d"), (None, "d"), (4, None)])
    for name in CLASHING:
        given = given.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    want = {(r["doc_id"], *(r[c] for c in CLASHING)) for r in given.collect()}
    got = drop_copies(given).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 2, 3, 4]
    assert {(r["doc_id"], *(r[c] for c in CLASHING)) for r in got} <= want
    left = without_ids(given, given.where("doc_id in (1, 3)").select("doc_id")).collect()
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 0, 2, 4]
    assert {(r["doc_id"], *(r[c] for c in CLASHING)) for r in left} <= want


def test_large_buckets_are_searched_in_tiles(docs, monkeypatch):
    """Near copies of one text that do not link with each other, two by two linked: the same classes in tiles as by brute force."""
    import zonemill.llm.setsketch as S

    monkeypatch.setattr(S, "PART_ROWS", 8)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(24):
        own = list(base)
        for j in rng.sample(range(120), 9):
            own[j] = f"x{k}-{j}"
        rows.append((2 * k, " ".join(own)))
        own[rng.randrange(120)] = "other"
        rows.append((2 * k + 1, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in near_groups(docs(rows), width=2, percent=85).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if c == high else c for i, c in label.items()}
    assert got == label and len(set(label.values())) > 5


def test_hot_keys_join_as_others(spark):
    from zonemill.llm.common import spread

    left = spark.range(3000).selectExpr("case when id < 2000 then 0 else id end as k", "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = spread(left, right, ["k"], "n", 3000)
    assert got.count() == 3000 and got.where("k = 0").agg(F.max("m")).first()[0] == 1999


def python_in_a_row(node):
    """(Python functions on the longest way down ``node``'s own stage, the most in any stage below or here)."""
    children, name = node.children(), node.nodeName()
    below = [python_in_a_row(children.apply(i)) for i in range(children.size())]
    here, most = (max((x[k] for x in below), default=0) for k in (0, 1))
    here = 0 if "Exchange" in name else here + ("InArrow" in name)
    return here, max(most, here)


def test_a_task_runs_one_python_function(docs, monkeypatch):
    """A second function in a task takes a second worker, which then keeps a state in turn for the rest of the session."""
    import zonemill.llm.setsketch as S

    plans, cut = [], S.cut

    def seen(df):
        plan = df._jdf.queryExecution().executedPlan()
        plans.append(python_in_a_row(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)[1])
        return cut(df)

    monkeypatch.setattr(S, "cut", seen)
    text = " ".join(f"w{k}" for k in range(60))
    got = S.near_groups(docs([(1, text), (2, text + " x"), (3, "y " + text), (4, "other words")]), width=2, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert max(plans) == 1


def test_a_dropped_state_is_gone():
    import weakref

    from zonemill.llm import common, setsketch

    class State:
        pass

    for stateless in (lambda: list(setsketch._contract(iter(()))), common.drop_state, lambda: common.worker_state("other", dict)):
        held = weakref.ref(common.worker_state("one", State))
        assert held() is not None
        stateless()
        assert held() is None
    common.drop_state()
