import math
import random

import pytest
from pyspark.sql import functions as F

from contestry.operators import boosting
from contestry.operators.boosting import LEAF_ROWS, PATIENCE, fit_boosted
from contestry.operators.scoring import score
from contestry.schemas import CLASSES, PROBABILITIES, DataQualityError
from contestry.session import cut_lineage
from contestry.sources.stored_models import read_model, write_model

SCHEMA = "match_id int, target_class string, x double, y double"


def rows_of(n, seed=1, classes=CLASSES):
    """x decides the outcome where it is known; where it is missing, the last class wins."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        x = None if draw.random() < 0.3 else float(draw.randrange(12))
        likely = classes[-1] if x is None else classes[0] if x < 6 else classes[1]
        rows.append((i, likely if draw.random() < 0.8 else draw.choice(classes), x, draw.gauss(0, 1)))
    return rows


def first_split(rows, k, p, l2):
    """The best split of x by trying every cut and both sides for the missing."""
    def gain(part):
        g = sum(p - (c == k) for c, _ in part)
        return g * g / (len(part) * p * (1 - p) + l2)

    best = None
    for cut in sorted({x for _, x in rows if x is not None}):
        for right in (False, True):
            side = [(right if x is None else x > cut) for _, x in rows]
            low = [r for r, s in zip(rows, side) if not s]
            high = [r for r, s in zip(rows, side) if s]
            if min(len(low), len(high)) >= LEAF_ROWS:
                found = (gain(low) + gain(high) - gain(rows), cut, right, low, high)
                best = found if best is None or found[0] > best[0] + 1e-9 else best
    return best


def test_first_trees_are_the_best_splits(spark):
    df = spark.createDataFrame(rows_of(900), SCHEMA).withColumn("match_id", F.lit(None).cast("int"))
    model = fit_boosted(df, ["x"], max_iter=1, max_depth=1, step=0.5, l2=2.0)
    rows = [(c, x) for _, c, x, _ in rows_of(900)]
    assert model.seen == [0, 1, 2]
    for k, name in enumerate(CLASSES):
        p = sum(c == name for c, _ in rows) / len(rows)
        assert model.start[k] == pytest.approx(math.log(p))
        _, cut, right, low, high = first_split(rows, name, p, 2.0)
        tree = model.trees[k][0]
        assert tree["splits"] == [{"input": 0, "cut": cut, "missing_right": right}]
        for leaf, part in zip(tree["leaves"], (low, high)):
            g = sum(p - (c == name) for c, _ in part)
            assert leaf == pytest.approx(-0.5 * g / (len(part) * p * (1 - p) + 2.0))


def test_missing_values_and_written_margins(spark):
    df = spark.createDataFrame(rows_of(1500), SCHEMA)
    model = fit_boosted(df, ["x", "y"], max_iter=24, step=0.3)
    told = model.transform(df.withColumn("p_draw", F.lit(7.0)))
    assert told.columns.count("p_draw") == 1 and told.count() == 1500
    total = sum((F.col(p) for p in PROBABILITIES[1:]), F.col(PROBABILITIES[0]))
    assert told.agg(F.max(F.abs(total - 1))).first()[0] < 1e-9
    assert score(told).first().log_loss < 0.8
    means = told.groupBy(F.col("x").isNull().alias("m")).agg(F.avg(PROBABILITIES[-1]).alias("p"))
    means = {r.m: r.p for r in means.collect()}
    assert means[True] > 0.75 and means[False] < 0.2
    nan = df.withColumn("x", F.coalesce("x", F.lit(float("nan"))))
    assert model.transform(nan).select(*PROBABILITIES).exceptAll(told.select(*PROBABILITIES)).count() == 0


def test_noise_stops_early(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(CLASSES), draw.random(), draw.random()) for i in range(600)]
    model = fit_boosted(spark.createDataFrame(rows, SCHEMA), ["x", "y"], max_iter=300, step=0.5)
    assert {len(own) for own in model.trees} < set(range(3 * PATIENCE))


def test_edges(spark, tmp_path):
    two = spark.createDataFrame(rows_of(300, 2, CLASSES[:2]) + [(900, None, 1.0, 1.0)], SCHEMA)
    model = fit_boosted(two, ["x", "y"], max_iter=2)
    out = model.transform(two)
    assert out.count() == 301 and out.agg(F.max(PROBABILITIES[2])).first()[0] == pytest.approx(0, abs=1e-6)
    again = read_model(spark, write_model(model, str(tmp_path / "m"))).transform(two)
    assert again.exceptAll(out).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert model.transform(empty).count() == 0
    with pytest.raises(DataQualityError):
        fit_boosted(empty, ["x"])
    blank = two.withColumn("x", F.lit(None).cast("double"))
    assert fit_boosted(blank, ["x"], max_iter=3).trees == [[], []]
    one = fit_boosted(two.filter(F.col("target_class") == CLASSES[0]), ["x"], max_iter=2).transform(two)
    assert one.agg(F.min(PROBABILITIES[0])).first()[0] == pytest.approx(1, abs=1e-6)


def test_rows_alike_are_one_with_a_count(spark):
    """Each row five times fits as if every count were five, in as few stored rows as once."""
    df = spark.createDataFrame(rows_of(500), SCHEMA).withColumn("match_id", F.lit(None).cast("int"))
    df = df.withColumn("y", F.round("y"))
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("copy")
    written = []

    def watched(table):
        written.append(cut_lineage(table))
        return written[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(boosting, "cut_lineage", watched)
        model = fit_boosted(many, ["x", "y"], max_iter=12, max_depth=2, step=0.3, l2=5.0)
        tables = [t for t in written if "_w" in t.columns]
        assert len(tables) == 2  # binned, and with the margins of ten rounds
        assert {t.count() for t in tables} == {tables[0].select("_class", "_b").distinct().count()}
        assert tables[0].agg(F.sum("_w")).first()[0] == 2500
        assert tables[0].count() < 500
    # Margins written are those that the trees so far give to a row.
    first = boosting.BoostedModel(model.features, 2, model.seen, model.start, [own[:10] for own in model.trees])
    shares = first.transform(many).groupBy(*PROBABILITIES).count()
    stored = [(r._w, r._m0, r._m1, r._m2) for r in tables[1].collect()]
    told = {}
    for n, *m in stored:
        e = [math.exp(x) for x in m]
        key = tuple(round(x / sum(e), 5) for x in e)
        told[key] = told.get(key, 0) + n
    assert {tuple(round(r[p], 5) for p in PROBABILITIES) for r in shares.collect()} == set(told)


def test_kept_blocks_give_the_trees_of_written_rows(spark):
    """How often margins move into the blocks or are written changes no tree, and few tables are written."""
    df = spark.createDataFrame(rows_of(800), SCHEMA)
    models, written = [], []

    def watched(table):
        written[-1] += "_w" in table.columns
        return cut_lineage(table)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(boosting, "cut_lineage", watched)
        for rounds, moves in ((10, 10), (2, 2), (100, 1)):
            patch.setattr(boosting, "ROUNDS_A_MOVE", rounds)
            patch.setattr(boosting, "MOVES_A_WRITE", moves)
            written.append(0)
            models.append(fit_boosted(df, ["x", "y"], max_iter=23, max_depth=2, step=0.1))
        patch.setattr(boosting, "FEW_TASKS", 1)
        patch.setattr(boosting, "ROWS_A_TASK", 100)
        written.append(0)
        models.append(fit_boosted(df, ["x", "y"], max_iter=23, max_depth=2, step=0.1))
    assert written[0] == 2  # binned, and with the margins of ten rounds, though twenty were moved
    for model in models[1:]:
        assert [len(own) for own in model.trees] == [len(own) for own in models[0].trees]
        for own, others in zip(model.trees, models[0].trees):
            for tree, other in zip(own, others):
                assert tree["splits"] == other["splits"]
                assert tree["leaves"] == pytest.approx(other["leaves"], abs=1e-9)


def test_scores_are_those_of_a_walk_row_by_row(spark):
    """Trees of all shapes over nulls, NaN and infinities; the trees are no expressions of the plan."""
    draw = random.Random(5)
    trees = []
    for _ in CLASSES:
        trees.append([boosting._blank(3) for _ in range(4)])
        for tree in trees[-1]:
            tree["leaves"] = [draw.gauss(0, 1) for _ in tree["leaves"]]
            tree["splits"] = [
                {"input": draw.randrange(2), "cut": draw.choice([-0.5, 0.0, 0.5, 1e308]), "missing_right": draw.random() < 0.5}
                for _ in tree["splits"]
            ]
    model = boosting.BoostedModel(["x", "y"], 3, [0, 1, 2], [0.1, 0.2, 0.3], trees)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, 0.5]
    values = [(x, y) for x in odd for y in odd] + [(draw.gauss(0, 1), draw.gauss(0, 1)) for _ in range(40)]
    df = spark.createDataFrame([(i, CLASSES[0], x, y) for i, (x, y) in enumerate(values)], SCHEMA)
    told = model.transform(df)
    assert "aggregate(" not in told._jdf.queryExecution().optimizedPlan().toString()
    for row in told.collect():
        margins = []
        for start, own in zip(model.start, trees):
            for tree in own:
                node = 0
                while node < 7:
                    split = tree["splits"][node]
                    value = values[row.match_id][split["input"]]
                    missing = value is None or math.isnan(value)
                    node = 2 * node + 1 + (split["missing_right"] if missing else value > split["cut"])
                start += tree["leaves"][node - 7]
            margins.append(math.exp(start))
        assert [row[p] for p in PROBABILITIES] == pytest.approx([m / sum(margins) for m in margins], abs=1e-9)
