"""Per-user tables to the last day read every row; those to an earlier day do not."""

from strata.queries import load_all


def test_no_row_is_left_out(spark, sf_dir, entities):
    queries = load_all()
    total = lambda name, column: queries[name].run(spark, sf_dir).agg({column: "sum"}).first()[0]
    app, tour = entities.app_events().count(), entities.tour_events().count()
    assert total("user_360_to_date", "total_events") == app > total("user_360", "total_events")
    assert total("user_360_travellers_to_date", "total_events") == tour > total("user_360_travellers", "total_events")
    assert total("recommendation_features_to_date", "total_interactions") == tour
