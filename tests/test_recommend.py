"""Recommendation lists against lists over all tours."""

from strata.operators import recommend


def test_lists_are_those_over_all_tours(spark):
    tours = [(t, "r", float(t % 5), [f"w{t % 7}", f"x{t % 3}", f"y{t % 11}"]) for t in range(400)]
    # tours of low numbers have more bookers; user 0 has booked the first 30, the others a few
    booked = {(u, (u * u) % (4 * t + 1)) for u in range(1, 60) for t in range(1, 90, 1 + u % 9)}
    booked |= {(0, t) for t in range(30)} | {(u, t) for u in range(100, 400) for t in range(30) if (u - 100) < 300 - 5 * t}
    events = spark.createDataFrame([(u, t, "booking") for u, t in sorted(booked)] + [(99, 1, "click")], "user_id long, tour_id long, event_type string")
    users = spark.createDataFrame([(u, "p", "r") for u in range(400)], "user_id long, peers string, home_region string")
    tours = spark.createDataFrame(tours, "tour_id long, region string, rating double, tags array<string>")
    got = {(r.user_id, r.rank): (r.tour_id, r.match_score) for r in recommend.recommendations(events, users, tours, 5).collect()}
    # every tour of the group against every user, without depths or bounds
    scores = {r.tour_id: r.match_score for r in recommend.hybrid_scores(events, users, tours).collect()}
    tags = {r.tour_id: set(r.tags) for r in tours.collect()}
    want = {}
    for u in {r.user_id for r in events.collect()}:
        mine = {t for v, t in booked if v == u}
        liked = set().union(*[tags[t] for t in mine])
        scored = [(round(0.7 * s + 0.3 * len(tags[t] & liked) / len(tags[t] | liked), 9), t) for t, s in scores.items() if t not in mine]
        for rank, (score, t) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:5], 1):
            want[u, rank] = (t, score)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-9 for k in want)
    heavy = [got[k][0] for k in got if k[0] == 0]
    assert len(heavy) == 5 and not set(heavy) & set(range(30))


def test_item_scores_add_up_likeness_over_all_bookings(spark):
    pairs = {(u, (u * 7 + k * k) % 40) for u in range(120) for k in range(2 + u % 5)} | {(500, t) for t in range(0, 40, 2)}
    # a tour that a third of the users booked, and a user who asks without bookings
    pairs |= {(u, 3) for u in range(0, 120, 3)}
    rows = [(u, t, "booking") for u, t in pairs for _ in range(1 + t % 2)] + [(7, 39, "click")]
    events = spark.createDataFrame(rows, "user_id long, tour_id long, event_type string").repartition(3)
    asked = [0, 3, 50, 100, 500, 999]
    got = {(r.user_id, r.tour_id): r.item_score for r in recommend.item_scores(events, spark.createDataFrame([(u,) for u in asked], "user_id long")).collect()}
    of = {}
    for u, t in pairs:
        of.setdefault(t, set()).add(u)
    want = {}
    for u in asked:
        mine = {t for v, t in pairs if v == u}
        for t in set(of) - mine:
            score = sum(len(of[t] & of[i]) / (len(of[t]) * len(of[i])) ** 0.5 for i in mine)
            if score:
                want[u, t] = round(score, 6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert recommend.item_scores(events.limit(0), events.select("user_id")).count() == 0


def test_co_bookers_of_every_asked_tour(spark, entities):
    events, asked = entities.tour_events("booking"), entities.tours().where("tour_id % 50 = 0")
    got = {}
    for r in recommend.also_booked_each(events, asked).collect():
        got.setdefault(r.asked_tour_id, {})[r.tour_id] = r.co_bookers
    assert len(got) > 1
    tour = min(got)
    assert got[tour] == {r.tour_id: r.co_bookers for r in recommend.also_booked(events, tour).collect()}


def _bookings(spark):
    pairs = {(u, (u * 7 + k * k) % 60) for u in range(150) for k in range(2 + u % 5)} | {(u, 3) for u in range(0, 150, 3)}
    return pairs, spark.createDataFrame([(u, t, "booking") for u, t in sorted(pairs)], "user_id long, tour_id long, event_type string")


def test_tours_with_few_bookers_need_no_table_of_pairs(spark, monkeypatch):
    _, events = _bookings(spark)
    asked = spark.createDataFrame([(u,) for u in (0, 3, 50, 149)], "user_id long")
    rows = {}
    for light in (0, 5, 1000):
        monkeypatch.setattr(recommend, "LIGHT", light)
        if light == 1000:
            monkeypatch.setattr(recommend, "also_booked_each", None)
        rows[light] = {(r.user_id, r.tour_id): r.item_score for r in recommend.item_scores(events, asked).collect()}
    assert len(rows[0]) > 50 and rows[0].keys() == rows[5].keys() == rows[1000].keys()
    assert all(abs(rows[0][k] - rows[n][k]) < 2e-6 for n in (5, 1000) for k in rows[0])


def test_personal_lists_are_those_over_all_candidates(spark):
    pairs, events = _bookings(spark)
    asked = [0, 3, 50, 149]
    users = spark.createDataFrame([(u,) for u in asked], "user_id long")
    # no row for tour 7, tour 9 without tags, tour 11 without a rating
    tours = [(t, "r", None if t == 11 else float(t % 5), [] if t == 9 else [f"w{t % 7}", f"x{t % 3}"]) for t in range(60) if t != 7]
    frame = spark.createDataFrame(tours, "tour_id long, region string, rating double, tags array<string>")
    got = {(r.user_id, r.rank): (r.tour_id, r.match_score) for r in recommend.personal_recommendations(events, users, frame, 3).collect()}
    of = {t: (rating, set(tags)) for t, _, rating, tags in tours}
    scores = {(r.user_id, r.tour_id): r.item_score for r in recommend.item_scores(events, users).collect()}
    want = {}
    for u in asked:
        liked = set().union(*[of[t][1] for v, t in pairs if v == u and t in of])
        best = max(s for (v, _), s in scores.items() if v == u)
        rows = []
        for (v, t), s in scores.items():
            if v == u and t in of and of[t][0] is not None:
                union = len(of[t][1] | liked)
                rows.append((-round(0.5 * s / best + 0.3 * (len(of[t][1] & liked) / union if union else 0) + 0.2 * of[t][0] / 5, 6), t))
        want |= {(u, n): (t, -s) for n, (s, t) in enumerate(sorted(rows)[:3], 1)}
    assert len(want) == 12 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
