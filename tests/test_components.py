"""Components by contraction, resolution by components, heat by bitmaps."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from topicflow.operators import cluster, graph
from topicflow.operators.scoring import entity_heat


def shapes():
    """A long path, a star, a ring, two cliques with a bridge, repeated edges and loops."""
    edges = [(k, k + 1) for k in range(1000, 1400)] + [(2000, 2001 + k) for k in range(300)] + [(3000 + k, 3000 + (k + 1) % 50) for k in range(50)]
    edges += [(a, b) for base in (4000, 4100) for a in range(base, base + 12) for b in range(a + 1, base + 12)] + [(4005, 4107), (4107, 4005)]
    return [*edges, *edges[:50], (7, 7), (None, 5), (5, None)]


def plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_edges_shrink_every_round_and_components_are_right(spark):
    rows = shapes()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long").repartition(4)
    sizes = [edges.count() for edges, _ in graph.contractions(df)]
    assert all(b < 0.85 * a for a, b in zip(sizes, sizes[1:])) and len(sizes) < 14, sizes
    assert {r["node"]: r["root"] for r in graph.components(df).collect()} == plain(rows)
    assert graph.components(df.limit(0)).count() == 0
    assert {r["node"]: r["root"] for r in graph.components(df.filter("a = 7")).collect()} == {7: 7}


def one_pass(names, near, sure, low, most):
    found = {}
    for n in names:
        canon = [(s, o, same) for s, o, same in near[n] if found.get(o) == o]
        best = max(((s, o) for s, o, _ in canon if s >= sure), default=None)
        if best is None and low is not None:
            asked = sorted(((-s, o, same) for s, o, same in canon if low < s < sure))[:most]
            best = next(((s, o) for s, o, same in asked if same), None)
        found[n] = best[1] if best else n
    return found


def test_resolution_is_the_same_by_components_by_rounds_and_in_one_pass(spark):
    rng = random.Random(3)
    names = [f"n{k:04d}" for k in range(400)]
    near, rows = defaultdict(list), []
    for k in range(1, 400):
        others = {k - 1} if k < 150 else {150 + rng.randrange(k - 150) for _ in range(3)} if k > 151 else set()  # a chain of 150 names, then a thicket
        for o in others:
            s, same = rng.randrange(30, 100) / 100, rng.random() < 0.5
            near[names[k]].append((s, names[o], same))
            rows.append((names[k], names[o], s, same))
    df = spark.createDataFrame([*rows, ("n0001", "stranger", 1.0, True)], "name string, other string, score double, same boolean").repartition(4)
    frame = spark.createDataFrame([(n,) for n in [*names, names[0], "alone"]], "name string")
    for low in (None, 0.4):
        want = one_pass(names, near, 0.8, low, 2) | {"alone": "alone"}
        for bound in (200_000, 250) if low is None else (200_000,):
            got = cluster.resolve(frame, df, 0.8, low, 2, replay_rows=bound).collect()
            assert {r["name"]: r["canonical"] for r in got} == want and len(got) == len(want)


def test_jobs_do_not_grow_with_the_longest_chain(spark):
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for n in (20, 320):
        names = spark.createDataFrame([(f"{k:04d}",) for k in range(n)], "name string")
        pairs = spark.createDataFrame([(f"{k:04d}", f"{k - 1:04d}", 0.9) for k in range(1, n)], "name string, other string, score double")
        spark.sparkContext.setJobGroup(f"chain{n}", "resolution of a chain")
        got = {r["name"]: r["canonical"] for r in cluster.resolve(names, pairs, 0.8).collect()}
        assert got == {f"{k:04d}": f"{k - k % 2:04d}" for k in range(n)}
        counts.append(len(tracker.getJobIdsForGroup(f"chain{n}")))
    spark.sparkContext.setJobGroup("rest", "other tests")
    assert counts[1] < 4 * counts[0], counts  # rounds of contraction grow with the logarithm


def test_heat_counts_articles_over_many_stretches(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(9)]), a, f" E{rng.randrange(14)} ", rng.random() < 0.7) for a in range(300) for _ in range(rng.randint(1, 3))]
    rows += [(100 + k % 3, 1000 + k, "hot", True) for k in range(600)] + [(50, 5000, "hot", False), (51, 5001, "", True)]
    df = spark.createDataFrame(rows, "topic_id long, article_id long, entity string, near boolean").repartition(5)
    own, seen = defaultdict(set), defaultdict(set)
    for t, a, e, near in rows:
        if e.strip():
            own[t].add(e.strip().lower())
            if near:
                seen[t, a].add(e.strip().lower())
    want = {t: sum(bool(own[t] & s) for (u, _), s in seen.items() if u != t) for t in own}
    got = entity_heat(df, F.col("near")).collect()
    assert {r["topic_id"]: r["heat"] for r in got} == want and len(got) == len(want)


def test_sets_of_entities_meet_topics_in_tiles(spark):
    from topicflow.operators.scoring import _met_sets

    rng = random.Random(2)
    own = {t: set(rng.sample("abcdefghij", rng.randint(1, 4))) for t in range(60)}
    sets = {frozenset(rng.sample("abcdefghijkl", rng.randint(2, 4))): rng.randint(1, 9) for _ in range(80)}
    mine = spark.createDataFrame([(t, k) for t, keys in own.items() for k in keys], "topic_id long, key_ string")
    theirs = spark.createDataFrame([(sorted(s), n) for s, n in sets.items()], "keys array<string>, n long")
    want = {t: sum(n for s, n in sets.items() if s & keys) for t, keys in own.items()}
    for sizes in ((4096, 16384), (7, 9)):
        got = defaultdict(int)
        for r in _met_sets(mine, theirs, *sizes).collect():
            got[r["topic_id"]] += r["n"]
        assert dict(got) == want
    assert _met_sets(mine, theirs.limit(0)).count() == 0


def test_resolution_in_rounds_takes_few_jobs_and_gives_one_pass(spark):
    """Every name resembles most before it: decided from the best few, not in a round for each step of the longest chain."""
    rng = random.Random(8)
    names = [f"{k:04d}" for k in range(160)]
    near, rows = defaultdict(list), []
    for k in range(160):
        for o in range(k):
            s, same = rng.randrange(41, 82) / 100, rng.random() < 0.1
            near[names[k]].append((s, names[o], same))
            rows.append((names[k], names[o], s, same))
    df = spark.createDataFrame(rows, "name string, other string, score double, same boolean").repartition(4)
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    spark.sparkContext.setJobGroup("rounds", "resolution in rounds")
    got = {r["name"]: r["canonical"] for r in cluster.resolve(frame, df, 0.81, 0.4, 3, replay_rows=150).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    spark.sparkContext.setJobGroup("rest", "other tests")
    assert got == one_pass(names, near, 0.81, 0.4, 3)
    assert jobs < 800, jobs


def test_a_cut_table_has_its_own_size_however_many_joins_made_it(spark):
    from topicflow.operators.lineage import cut

    df = cut(spark.range(20).selectExpr("id", "id AS up"))
    for _ in range(4):
        df = cut(df.join(df.selectExpr("id AS up", "up AS next"), "up").selectExpr("id", "next AS up"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**6 and df.count() == 20


def test_components_read_their_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = [(k, k + 1) for k in range(100)]
    df = spark.createDataFrame(rows, "a long, b long").mapInPandas(counted, "a long, b long")
    assert graph.largest_component(df).count() == 101 and seen.value == 100
