"""Models: held-out quality, versions, checkpoint folder."""

import pytest
from pyspark.sql import functions as F

from paths import SF01
from shoplens import session
from shoplens.operators import recommend as R


def _rows(spark, name):
    import __spark_entry__ as E
    return E.queries()[name](spark, SF01)


def test_regressor_beats_the_mean(spark):
    got = {(r.split, r.model): r for r in _rows(spark, "model_metrics").collect()}
    for split in ("dev", "test"):
        assert got[split, "regressor"].rmse < got[split, "mean"].rmse
        assert got[split, "regressor"].mae <= got[split, "regressor"].rmse


def test_als_predictions_are_of_held_out_pairs(spark):
    rows = _rows(spark, "als_model").collect()
    assert rows and {r.split for r in rows} <= {"dev", "test"}
    assert all(r.prediction >= 0 for r in rows)


def test_als_takes_ids_of_any_size(spark):
    big = 1 << 40
    df = spark.createDataFrame([(big + u, big * 2 + p, float((u + p) % 3 + 1)) for u in range(6) for p in range(5)],
                               "user_id long, product_id long, interaction_score double")
    model, ui, pi = R.als_model(df, rank=2, max_iter=3)
    pred = R.als_predict(model, ui, pi, df).collect()
    assert len(pred) == 30 and all(r.prediction >= 0 for r in pred)
    u, p = R.als_vectors(model, ui, pi)
    assert {r.user_id for r in u.collect()} == {big + x for x in range(6)} and p.count() == 5


def test_tuning_draws_differ_and_are_ordered(spark):
    rows = _rows(spark, "tune_random_search").collect()
    assert len({r.params for r in rows}) == len(rows) == 4
    shares = [r.share_of_mean_rmse for r in rows]
    assert shares == sorted(shares) and shares[0] < 1.0


def test_versions_are_never_replaced(spark, tmp_path):
    from pyspark.ml.feature import SQLTransformer
    model = SQLTransformer(statement="select * from __THIS__")
    for base in (str(tmp_path / "m"), f"file://{tmp_path}/m"):
        assert R.model_versions(spark, base)[1] == R.model_versions(spark, str(tmp_path / "m"))[1]
        first = R.save_versioned(spark, model, base)
        assert R.save_versioned(spark, model, base) != first
    assert R.model_versions(spark, f"file://{tmp_path}/m") == R.model_versions(spark, str(tmp_path / "m")) == (4, 5)


def test_expand_query_from_a_file(spark, tmp_path):
    from shoplens.operators.search import expand_query, load_synonyms
    (tmp_path / "words.csv").write_text("token,lemma,synonym\nkids,kid,youngster\nkids,kid,child\nlaptops,laptop,notebook\n"
                                        "laptops,laptop,computer\n")
    q = spark.createDataFrame([(1, "Kids laptops red"), (2, "x")], "query_id long, text string")
    got = {r.query_id: r.expanded for r in expand_query(q, load_synonyms(spark, str(tmp_path / 'words.csv'))).collect()}
    assert got == {1: "kid child youngster laptop computer notebook red", 2: "x"}


def test_unset_folder_raises_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_tower_score_is_the_cosine(spark):
    u = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "user_id long, vector array<double>")
    p = spark.createDataFrame([(7, [4.0, 3.0])], "product_id long, vector array<double>")
    pairs = u.select("user_id", F.lit(7).cast("long").alias("product_id"))
    got = {r.user_id: r.score for r in R.tower_score(pairs, u, p).collect()}
    assert got[1] == pytest.approx(0.96) and got[2] is None


def test_regressor_writes_no_second_copy_of_its_rows(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("the train rows are stored already")

    monkeypatch.setattr(session, "materialize", refused)
    train = spark.createDataFrame([(i, i, float(2 * i), float(i) if i % 3 else None) for i in range(30)],
                                  "user_id long, product_id long, interaction_score double, views double")
    assert R.predict(R.content_regressor(train), train).where("prediction is not null").count() == 30
