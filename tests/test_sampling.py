import pytest
from pyspark.sql import functions as F

from evalweave import scratch
from evalweave.operators import grid, lookup, nearest, prompts, sampling, skew
from evalweave.plans import experiment
from workload import fixtures as fx


@pytest.fixture(scope="module")
def problems(spark):
    """A third of all rows in one group, groups of every size from 1 to 9."""
    sizes = {f"g{i}": i for i in range(1, 10)} | {"hot": 400}
    rows = [
        (1000 * j + i, "MEDIUM" if i % 5 else "EASY", group, f"text {group} {i}")
        for j, (group, size) in enumerate(sizes.items())
        for i in range(1, size + 1)
    ]
    return spark.createDataFrame(rows, "id bigint, difficulty string, tags string, input string")


DESIGN = experiment.by_topic("MEDIUM", n_targets=3, min_count=4)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _members(problems):
    groups = {}
    for r in problems.filter("difficulty = 'MEDIUM'").collect():
        groups.setdefault(r.tags, set()).add(r.id)
    return groups


def test_targets_and_contexts(problems):
    groups = {g: ids for g, ids in _members(problems).items() if len(ids) >= 4}
    manifest = experiment.manifest(problems, DESIGN)
    per_target = {}
    for r in manifest.collect():
        per_target.setdefault((r.grp, r.target_id), []).append(r)
    assert {g for g, _ in per_target} == set(groups)
    for group, ids in groups.items():
        targets = [t for g, t in per_target if g == group]
        assert len(targets) == 3 and set(targets) <= ids
    for (group, target), rows in per_target.items():
        contexts = [r.context_id for r in rows]
        assert len(contexts) == len(set(contexts)) == min(4, len(groups[group]) - 1)
        assert target not in contexts and set(contexts) <= groups[group]
        assert sorted(r.context_pos for r in rows) == list(range(len(rows)))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_same_sample_for_any_partitioning(problems, partitions):
    once = _rows(experiment.manifest(problems, DESIGN))
    again = _rows(experiment.manifest(problems.repartition(partitions), DESIGN))
    assert once == again


def test_another_seed_is_another_sample(problems):
    other = experiment.by_topic("MEDIUM", n_targets=3, min_count=4, seed=7)
    assert _rows(experiment.manifest(problems, DESIGN)) != _rows(experiment.manifest(problems, other))


def test_salted_joins_give_the_same(problems, salted):
    salted_rows = _rows(experiment.manifest(problems, DESIGN))
    skew.BROADCAST_BYTES = 1 << 20
    assert salted_rows == _rows(experiment.manifest(problems, DESIGN))


@pytest.mark.parametrize("wanted", ["enough", "too few"])
def test_bounded_draws_give_the_same(problems, monkeypatch, wanted):
    """Large groups are drawn from below a bound; too low a bound is made good."""
    plain = _rows(experiment.manifest(problems, DESIGN))
    monkeypatch.setattr(sampling, "LARGE_GROUP", 1)
    used = []

    def bound(size, n):
        low = F.when(size <= 5, sampling._NO_BOUND).otherwise("05")
        used.append(n)
        return real(size, n) if wanted == "enough" else low

    real = sampling._bound
    monkeypatch.setattr(sampling, "_bound", bound)
    assert _rows(experiment.manifest(problems, DESIGN)) == plain
    assert used == [3, 4]


def test_bound_lets_enough_through(spark):
    sizes = spark.createDataFrame([(n,) for n in (10, 58, 59, 1000, 10**9, 10**13)], "size bigint")
    got = {r.size: r.b for r in sizes.select("size", sampling._bound(F.col("size"), 4).alias("b")).collect()}
    assert got[10] == got[58] == sampling._NO_BOUND
    for size in (59, 1000, 10**9, 10**13):
        assert len(got[size]) == 12
        assert int(got[size], 16) / 2**48 == pytest.approx(58 / size, rel=0.01)


def test_short_groups_are_marked(problems):
    wide = experiment.by_topic("MEDIUM", n_targets=6, min_count=4)
    targets = experiment.targets(problems, wide)
    short = {r.grp for r in targets.filter("short").collect()}
    assert short == {g for g, ids in _members(problems).items() if 4 <= len(ids) < 6}
    with pytest.raises(Exception, match="too few problems"):
        sampling.require_full(targets).collect()
    assert sampling.require_full(experiment.targets(problems, DESIGN)).count() > 0


def test_limit_above_the_window_threshold(spark, problems):
    ids = problems.filter("tags = 'hot'").select("tags", "id")
    plain = _rows(skew.top_n(ids, ["tags"], [F.col("id")], 50, "pos"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        assert _rows(skew.top_n(ids, ["tags"], [F.col("id")], 50, "pos")) == plain
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert [r[-1] for r in plain] == list(range(50))


def test_contexts_from_another_split(problems):
    test = problems.filter("id % 2 = 0")
    train = problems.filter("id % 2 = 1")
    manifest = experiment.manifest(test, DESIGN, candidates=train)
    odd = {r.context_id % 2 for r in manifest.collect() if r.context_id is not None}
    assert odd == {1}


@pytest.mark.parametrize("parts", [1, 5])
def test_global_index(spark, parts):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(parts)
    numbered = skew.global_index(df, ["x"], "i")
    assert numbered.rows == 1000
    assert [tuple(r) for r in numbered.df.orderBy("i").select("x", "i").collect()] == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("hot", [100_000, 20])
@pytest.mark.parametrize("tasks", [200_000, 10])
def test_index_within(spark, monkeypatch, hot, tasks):
    """Places in each group, with one group of a third of the rows, repeated rows and some without a group."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(skew, "TASK_ROWS", tasks)
    made = [(None if i % 50 == 0 else 0 if i % 3 == 0 else i % 40, i * 7919 % 23, None if i % 9 == 0 else i % 2) for i in range(300)]
    rows = spark.createDataFrame(made, "g long, x long, y long")
    got = [tuple(r) for r in skew.index_within(rows, ["g"], ["x", "y"], "i").select("g", "x", "y", "i").collect()]
    want = []
    for g in {g for g, *_ in made if g is not None}:
        inside = sorted((r for r in made if r[0] == g), key=lambda r: (r[1], r[2] is not None, r[2] or 0))
        want += [(*r, i) for i, r in enumerate(inside)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_index_within_no_rows(spark):
    rows = spark.createDataFrame([], "g long, x long")
    assert skew.index_within(rows, ["g"], ["x"], "i").collect() == []


def test_grid_slices(problems):
    targets = experiment.targets(problems, DESIGN)
    n = targets.count()
    whole = grid.run_grid(targets).orderBy("run_index").collect()
    assert [r.run_index for r in whole] == list(range(3 * n))
    assert {r.total_runs for r in whole} == {3 * n}
    keys = [(r.context_type, r.grp, r.target_pos) for r in whole]
    order = {"no_context": 0, "full_problem": 1, "only_solutions": 2}
    assert keys == sorted(keys, key=lambda k: (order[k[0]], k[1], k[2]))
    assert grid.run_grid(targets, start=2, end=5).count() == 3
    assert grid.run_grid(targets, start=2, end=5, end_inclusive=True).count() == 4


def test_requests(problems):
    manifest = experiment.manifest(problems, DESIGN)
    asked = experiment.requests(manifest, 60, 25, start=0, end=2).collect()
    assert len(asked) == 2 * 50
    assert {r.n_left_out for r in asked} == {10}
    assert {(r.gen_idx, r.batch) for r in asked} == {(i, i // 25) for i in range(50)}
    for n, batch in ((10, 25), (0, 1), (10, 0)):
        with pytest.raises(ValueError):
            grid.generation_requests(manifest, n, batch)


def test_nearest_contexts(spark):
    rows = [(i, "a", [float(i), 1.0]) for i in range(8)] + [(8, "a", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, label string, embedding array<float>")
    targets = spark.createDataFrame([("a", 0, 0)], "grp string, target_id bigint, target_pos int")
    got = sampling.nearest_contexts(df, targets, "label", 8).orderBy("context_pos").collect()
    assert [r.context_id for r in got] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert got[0].cosine == pytest.approx(0.707107) and got[-1].cosine is None


def test_lookup_takes_one_text_per_id(spark):
    problems = spark.createDataFrame(
        [(1, "d", "b", "text"), (1, "d", "a", "text"), (2, "d", "a", "other")],
        "id bigint, difficulty string, tags string, input string",
    )
    ids = spark.createDataFrame([(1,), (3,)], "id bigint")
    got = {r.id: (r.input, r.found) for r in lookup.lookup_inputs(problems, ids).collect()}
    assert got == {1: ("text", True), 3: (None, False)}


@pytest.fixture(scope="module")
def picked(spark):
    problems = spark.createDataFrame(
        [(i, "d", "t", f"q{i}") for i in range(1, 6)],
        "id bigint, difficulty string, tags string, input string",
    )
    solutions = spark.createDataFrame(
        [(1, 0, "s1"), (2, 1, "late"), (2, 0, "same"), (3, 0, "same"), (5, 0, "s5")],
        "id bigint, sol_idx int, solution string",
    )
    picks = spark.createDataFrame(
        [("x", 1, 0, [5, 4, 3, 2]), ("y", 2, 0, [])],
        "grp string, target_id bigint, target_pos int, context_ids array<bigint>",
    )
    return problems, solutions, sampling.explicit_manifest(picks)


TEMPLATE = prompts.Template("Q {question}.", "[{group}]", "{i}:{question}={solution};", "<{group}>", "{i}:{solution};")


def test_prompts(picked):
    problems, solutions, manifest = picked
    whole = experiment.all_prompts(problems, solutions, manifest, TEMPLATE)
    got = {(r.grp, r.context_type): r.prompt for r in whole.collect()}
    assert got == {
        ("x", "no_context"): "Q q1.",
        # Problem 4 has no solution; the others are numbered without a gap.
        ("x", "full_problem"): "[x]0:q5=s5;1:q3=same;2:q2=same;Q q1.",
        ("x", "only_solutions"): "<x>0:s5;1:same;Q q1.",
        ("y", "no_context"): "Q q2.",
        ("y", "full_problem"): "[y]Q q2.",
        ("y", "only_solutions"): "<y>Q q2.",
    }


def test_template_text_may_hold_braces(picked):
    problems, _, manifest = picked
    odd = prompts.Template(task="{x} {question}{question} {")
    texts = prompts.gather(problems, manifest)
    got = {r.grp: r.prompt for r in prompts.no_context(texts, manifest, odd).collect()}
    assert got["x"] == "{x} q1q1 {"


def test_unknown_treatment(picked):
    problems, solutions, manifest = picked
    with pytest.raises(ValueError):
        prompts.assemble("other", prompts.Texts(problems), manifest)


def test_written_size(spark):
    written = scratch.write(spark.range(10), "numbers")
    assert written.rows == 10 and written.bytes == 10 * len('{"id":0}')
    assert written.df.count() == 10
    assert scratch.write(spark.range(0), "nothing").bytes == 0
    none = spark.range(10).groupBy("id").count().filter("count > 5")
    assert scratch.write(none.join(spark.range(5), "id"), "nothing").rows == 0


def test_salts_shrink_with_the_copied_table(spark):
    assert skew.salts(spark) == 8
    assert skew.salts(spark, skew.COPIES_BYTES // 5) == 5
    assert skew.salts(spark, skew.COPIES_BYTES * 10) == 2


def test_repeated_ids_are_drawn_once(spark):
    """Each id listed twice; the group has six problems."""
    rows = [(i, "g") for i in range(1, 7)] * 2
    problems = spark.createDataFrame(rows, "id bigint, tags string")
    chosen = sampling.sample_targets(problems, "tags", {}, 6, 4, 42)
    targets = [r.target_id for r in chosen.collect()]
    assert len(targets) == len(set(targets)) == 4
    assert sampling.eligible_groups(problems, "tags", {}, 7).count() == 0
    contexts = sampling.sample_contexts(problems, chosen, "tags", {}, 4, 42).collect()
    pairs = [(r.target_id, r.context_id) for r in contexts]
    assert len(pairs) == len(set(pairs)) == 16


def test_distinct_inputs_with_repeated_rows(spark):
    rows = [(1, "d", "a", "x"), (1, "d", "b", "x"), (2, "d", "a", "x"), (3, "d", "a", "y"), (3, "d", "a", "y"),
            (4, "d", "a", None), (5, "d", None, None), (6, "d", "a", ""), (None, None, None, "z"), (None, None, None, "z")]
    problems = spark.createDataFrame(rows, "id bigint, difficulty string, tags string, input string")
    got = [r.input for r in lookup.distinct_inputs(problems).collect()]
    assert sorted(got, key=repr) == sorted(["x", "y", None, "", "z"], key=repr)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_exchanged_to_tell_them_apart(spark):
    rows = [(i, "d", "a", f"text {i % 50}") for i in range(200)]
    problems = spark.createDataFrame(rows, "id bigint, difficulty string, tags string, input string")
    found = lookup.distinct_inputs(problems)
    assert found.count() == 50
    assert "Exchange hashpartitioning" not in _plan(found)


def test_wanted_texts_are_sifted_below_the_exchange(spark, salted):
    """Beyond the broadcast bound: no sorted aggregate, and a filter of the ids under each exchange of texts."""
    problems = spark.createDataFrame(
        [(i, "d", "t", f"text {i}") for i in range(3000)], "id bigint, difficulty string, tags string, input string"
    )
    solutions = spark.createDataFrame(
        [(i, k, f"solution {i} {k}") for i in range(1000) for k in (2, 0, 1)], "id bigint, sol_idx int, solution string"
    )
    ids = spark.range(0, 100, 7).toDF("id")
    texts = lookup.inputs_by_id(problems, ids)
    firsts = lookup.first_solutions(solutions, ids)
    for found, column in ((texts, "input"), (firsts, "solution")):
        plan = _plan(found)
        assert "SortAggregate" not in plan
        lines = plan.split("\n")
        scans = [i for i, line in enumerate(lines) if "Scan ExistingRDD" in line and column in line]
        assert scans
        for scan in scans:
            # The nearest exchange above each scan of the texts has the filter below it.
            above = next(i for i in range(scan, -1, -1) if "Exchange hashpartitioning" in lines[i])
            assert any("getbit" in line for line in lines[above:scan]) or column not in lines[above + 1]
    assert {r.id: r.input for r in texts.collect()} == {i: f"text {i}" for i in range(0, 100, 7)}
    assert {r.id: r.solution for r in firsts.collect()} == {i: f"solution {i} 0" for i in range(0, 100, 7)}


def test_sift_keeps_all_wanted_and_few_others(spark):
    rows = spark.range(200_000).select("id", F.lit("text").alias("t"))
    keys = scratch.write(spark.range(0, 200_000, 40).toDF("id"), "keys")
    kept = {r.id for r in skew.sift(rows, keys, ["id"]).collect()}
    wanted = set(range(0, 200_000, 40))
    assert wanted <= kept and len(kept - wanted) < 0.1 * 200_000


def test_sift_of_nothing(spark):
    keys = scratch.write(spark.range(0).toDF("id"), "keys")
    assert skew.sift(spark.range(10).toDF("id"), keys, ["id"]).count() == 0


@pytest.mark.parametrize("rows", [100_000, 30])
def test_hot_rows_are_spread_over_copies(spark, monkeypatch, rows):
    monkeypatch.setattr(skew, "HOT_ROWS", rows)
    big = spark.range(200).select(F.when(F.col("id") < 150, 1).otherwise(F.col("id")).alias("k"), "id")
    texts = spark.range(1, 190).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got = sorted((r.k, r.id, r.text) for r in skew.spread(big, texts, ["k"], ["id"]).collect())
    assert got == sorted((1 if i < 150 else i, i, f"t{1 if i < 150 else i}") for i in range(190))


def test_repeated_ids_are_one_place(spark):
    """Repeats of an id are removed after the limit, and nothing is exchanged below it."""
    rows = [("d", f"g{i % 2}", i // 2 % 40) for i in range(400)]
    problems = spark.createDataFrame([(k, d, g, "x") for d, g, k in rows], "id bigint, difficulty string, tags string, input string")
    got = sampling.sample_targets(problems, "tags", {}, 6, 5, 42)
    drawn = {}
    for r in got.collect():
        drawn.setdefault(r.grp, []).append((r.target_pos, r.target_id, r.n_problems))
    assert all(sorted(p for p, *_ in found) == list(range(5)) for found in drawn.values())
    assert all(len({t for _, t, _ in found}) == 5 and {n for *_, n in found} == {40} for found in drawn.values())
    below = _plan(got).split("WindowGroupLimit")[-1]
    assert "Exchange hashpartitioning" not in below


def test_merged_draws_equal_one_draw(spark):
    problems = spark.createDataFrame(
        [(i, "d", f"g{i % 7 % 4}", "x") for i in range(500)], "id bigint, difficulty string, tags string, input string"
    )
    splits = [problems.filter(F.col("id") % 3 == k) for k in range(3)]
    draws = [sampling.bottom_draws(s, "tags", {"difficulty": "d"}, 10, 7) for s in splits]
    for n in (3, 10):
        want = sampling.sample_targets(problems, "tags", {"difficulty": "d"}, 6, n, 7)
        got = sampling.merged_targets(draws, 6, n)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sketches_of_splits_that_share_ids(spark):
    """Within the stated error of the exact number, whatever the splits have in common."""
    problems = spark.createDataFrame(
        [(i, "d", "large" if i % 5 else "small", "x") for i in range(60_000)],
        "id bigint, difficulty string, tags string, input string",
    )
    splits = [problems.filter("id < 40000"), problems.filter("id >= 20000"), problems.filter("id < 100")]
    sketches = [sampling.group_sketches(s, "tags", {}) for s in splits]
    exact = {r.tags: r.n for r in problems.groupBy("tags").agg(F.count_distinct("id").alias("n")).collect()}
    for r in sampling.merged_sizes(sketches).collect():
        assert abs(r.n_problems - exact[r.grp]) <= 0.05 * exact[r.grp]
    assert sampling.n_groups_sketch(sketches, 20_000).first().n_tags == 1
    assert sampling.n_groups_sketch(sketches, 6).first().n_tags == 2


VECTORS = "id bigint, label string, embedding array<float>"


def _vectors(n, size=16, seed=3):
    import numpy as np

    random = np.random.default_rng(seed)
    centres = random.normal(size=(12, size))
    rows = [(i, "ab"[i % 2], (centres[i % 12] + 0.4 * random.normal(size=size)).tolist()) for i in range(n)]
    rows += [(n, "a", [0.0] * size), (n + 1, "a", None), (n + 2, "b", [1.0] * (size - 1)), (n + 3, "b", [])]
    rows += [(3, "b", rows[9][2])]  # another vector of an id
    return rows


def _nearest(rows, grp, target, k):
    """By comparing with every other id of the group, an id by its nearest vector."""
    import numpy as np

    vector = np.array(next(r[2] for r in rows if r[0] == target), dtype=np.float32).astype(float)
    found = {}
    for i, label, other in rows:
        if label == grp and i != target:
            other = np.array(other or [], dtype=np.float32).astype(float)
            usable = len(other) == len(vector) and np.linalg.norm(other) > 0 and np.linalg.norm(vector) > 0
            value = round(float(other @ vector / np.linalg.norm(other) / np.linalg.norm(vector)), 6) if usable else None
            if i not in found or value is not None and (found[i] is None or value > found[i]):
                found[i] = value
    ranked = sorted(found, key=lambda i: (found[i] is None, -(found[i] or 0), i))
    return [(i, found[i]) for i in ranked[:k]]


@pytest.fixture(scope="module")
def vector_rows():
    return _vectors(600)


TARGETS = [("a", 0, 0), ("a", 10, 1), ("b", 5, 0), ("b", 7, 1), ("a", 600, 2)]


@pytest.mark.parametrize("way", ["batches", "blocks", "index", "index of one list"])
def test_nearest_contexts_every_way(spark, vector_rows, monkeypatch, request, way):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 64)
    if way == "blocks":
        request.getfixturevalue("salted")
    df = spark.createDataFrame(vector_rows, VECTORS).repartition(3)
    targets = spark.createDataFrame(TARGETS, "grp string, target_id bigint, target_pos int")
    for k in (4, 305):
        if way.startswith("index"):
            index = nearest.fit(df, 1 if way.endswith("list") else 12, 2)
            got = nearest.indexed_contexts(df, targets, "label", k, index)
        else:
            got = sampling.nearest_contexts(df, targets, "label", k)
        by_target = {}
        for r in got.orderBy("context_pos").collect():
            by_target.setdefault((r.grp, r.target_id, r.target_pos), []).append((r.context_id, r.cosine))
        assert by_target == {(g, t, p): _nearest(vector_rows, g, t, k) for g, t, p in TARGETS}


def test_recall_of_the_probed_lists(spark):
    """Without the second look: recall at 4 against the exact contexts, and every id is in a list."""
    rows = fx.vectors(spark, "/root/testdata/sf0.1")
    targets = sampling.sample_targets(rows, "label", {}, 6, 5, 42)
    index = nearest.fit(rows, lists=64, probes=44)
    exact = {(r.target_id, r.context_id) for r in sampling.nearest_contexts(rows, targets, "label", 4).collect()}
    probed = nearest.indexed_contexts(rows, targets, "label", 4, index, exact=False).collect()
    found = {(r.target_id, r.context_id) for r in probed}
    assert len(exact & found) >= 0.9 * len(exact) > 0
    assert nearest._placed(rows.withColumnRenamed("label", "grp"), index).filter("list >= 0").count() == rows.count()


def test_lists_that_cannot_be_near_are_not_read(spark, vector_rows):
    """Where vectors lie in clusters, the second look reads few of the other lists."""
    import numpy as np

    rows = [r for r in vector_rows if r[2] and len(r[2]) == 16]
    index = nearest.fit(spark.createDataFrame(rows, VECTORS), 12, 2)
    unit = np.array([r[2] for r in rows]) / np.linalg.norm([r[2] for r in rows], axis=1)[:, None].clip(1e-9)
    assert index.centroids.shape == (12, 16) and (unit @ index.centroids.T).max(axis=1).mean() > 0.8


def test_fit_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    index = nearest.fit(empty, 4, 1)
    targets = spark.createDataFrame([], "grp string, target_id bigint, target_pos int")
    assert nearest.indexed_contexts(empty, targets, "label", 4, index).count() == 0
