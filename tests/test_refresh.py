"""A build and its refreshes hold the rows of a full build of the new panel."""

import random

import pytest
from pulsepanel.operators import labels
from pulsepanel.operators.refresh import PanelStore, shift
from pulsepanel.sources.snapshots import ConflictError
from pyspark.sql import functions as F

SCHEMA = "msno long, safra int, paid double, is_ativo int"
MONTHS = [shift(201510, i) for i in range(9)]


def panel(spark, months, seed=1, customers=25):
    rng = random.Random(seed)
    rows = [(c, m, float(rng.randrange(100)), rng.choice([0, 1, 1, None]))
            for m in months for c in range(customers) if rng.random() < 0.8]
    return spark.createDataFrame(rows, SCHEMA)


def store(tmp_path, name="s"):
    return PanelStore(str(tmp_path / name), ["paid"])


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def check(spark, st, features):
    assert rows_of(st.read(spark, "features")) == rows_of(features)
    assert rows_of(st.read(spark)) == rows_of(labels.model_table(features, ["paid"]))
    diag = labels.label_trust(labels.forward_status(features))
    assert rows_of(st.verdicts(spark)) == rows_of(diag)


def test_shift():
    assert [shift(201611, 3), shift(201701, -1), shift(201612, 0)] == [201702, 201612, 201612]


def test_build(spark, tmp_path):
    features, st = panel(spark, MONTHS), store(tmp_path)
    with pytest.raises(ValueError):
        st.read(spark)
    st.build(features)
    check(spark, st, features)
    assert st.periods(spark) == MONTHS


@pytest.mark.parametrize("changed", [
    [MONTHS[-1]],                        # a new month
    [MONTHS[4]],                         # a corrected month
    [MONTHS[0], MONTHS[3], MONTHS[8]],   # several
    [shift(MONTHS[-1], 3)],              # a month behind a gap: verdicts of the gap appear
])
def test_refresh_equals_full_build(spark, tmp_path, changed):
    st, old = store(tmp_path), panel(spark, MONTHS[:-1], seed=1)
    st.build(old)
    new = panel(spark, changed, seed=2)
    st.refresh(new, changed)
    check(spark, st, old.where(~F.col("safra").isin(changed)).unionByName(new))


def test_withdrawn_month_and_chain_of_refreshes(spark, tmp_path):
    st, now = store(tmp_path), panel(spark, MONTHS[:6])
    st.build(now)
    for seed, changed in ((3, [MONTHS[6]]), (4, [MONTHS[2]]), (5, [MONTHS[7], MONTHS[6]])):
        new = panel(spark, changed, seed)
        st.refresh(new, changed)
        now = now.where(~F.col("safra").isin(changed)).unionByName(new)
    check(spark, st, now)
    st.refresh(now.where("safra = 0"), [MONTHS[3]])
    check(spark, st, now.where(F.col("safra") != MONTHS[3]))
    assert st.refresh(now, []).number == 5


def test_only_touched_months_are_read_and_written(spark, tmp_path):
    st = store(tmp_path)
    st.build(panel(spark, MONTHS))
    before = {t: dict(_parts(spark, st, t)) for t in ("features", "model")}
    st.refresh(panel(spark, [MONTHS[4]], seed=9), [MONTHS[4]])
    after = {t: dict(_parts(spark, st, t)) for t in ("features", "model")}
    moved = {t: {int(p) for p in after[t] if after[t][p] != before[t].get(p)} for t in after}
    assert moved["features"] == {MONTHS[4]}
    assert moved["model"] <= {MONTHS[4], MONTHS[5], MONTHS[1]} and MONTHS[4] in moved["model"]
    files = st.read(spark, "features", periods=[MONTHS[4], MONTHS[5]]).inputFiles()
    assert files and all(f"safra={MONTHS[4]}" in f or f"safra={MONTHS[5]}" in f for f in files)


def _parts(spark, st, table):
    from pulsepanel.sources.snapshots import load

    return load(spark, f"{st.path}/{table}", st.state(spark).parts[table]).parts


def test_a_refresh_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    st, old = store(tmp_path), panel(spark, MONTHS)
    st.build(old)
    new = panel(spark, [MONTHS[4]], seed=7)
    with monkeypatch.context() as m:
        m.setattr(PanelStore, "_rows", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            st.refresh(new, [MONTHS[4]])
    check(spark, st, old)  # features of the torn refresh are written, but not published
    st.refresh(new, [MONTHS[4]])
    check(spark, st, old.where(F.col("safra") != MONTHS[4]).unionByName(new))


def test_two_refreshes_of_one_state(spark, tmp_path):
    st = store(tmp_path)
    st.build(panel(spark, MONTHS))
    state = st.state(spark)
    st.refresh(panel(spark, [MONTHS[1]], seed=8), [MONTHS[1]])
    with pytest.raises(ConflictError):
        st._commit(spark, state.number + 1, dict(state.parts))


def test_new_rows_of_other_months_are_an_error(spark, tmp_path):
    st = store(tmp_path)
    st.build(panel(spark, MONTHS))
    with pytest.raises(ValueError):
        st.refresh(panel(spark, MONTHS[:2]), [MONTHS[0]])


def test_rows_without_a_key_are_not_published(spark, tmp_path):
    st, features = store(tmp_path), panel(spark, MONTHS)
    st.build(features)
    bad = panel(spark, [MONTHS[2]], seed=3).withColumn("msno", F.when(F.col("msno") > 3, F.col("msno")))
    with pytest.raises(ValueError, match="null values in msno"):
        st.refresh(bad, [MONTHS[2]])
    check(spark, st, features)
