"""Tour recommendations.

Peer scores are computed per group (users of one country) and tour, never per pair of users or pair of tours: the work
is linear in the events.  Lists are ranked once per group and handed to its users by an equi-join; a user's own taste
and bookings then decide about that short list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.enrich import with_region_flag
from strata.operators.serving import MAX_RECOMMENDATIONS
from strata.operators.windows import top_per_key
from strata.session import cut_lineage

# Reason texts, and the constant score of the unranked list.
POPULAR, TRENDING = "Popular in your region", "Trending"
CONSTANT_SCORE = 0.85
# Weights of the hybrid score, our own choice.
PEERS_WEIGHT, CONTENT_WEIGHT, RATING_WEIGHT = 0.5, 0.3, 0.2
# Weight of the user's own taste beside the group's score.
OWN_WEIGHT = 0.3
# Bookers of a tour up to which they are met one by one, so that the work stays linear in the bookings.
LIGHT = 64
# Rows per asked place that bound a user's list from below, and more than personal scores are rounded by.
SPREAD, PERSONAL_ROUNDING = 4, 1e-5
# How much deeper the group lists are fetched for users whose list is not final, and more than scores are rounded by.
DEEPER, ROUNDING = 8, 1e-8


def with_reason(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Labels (user, tour, region) candidates by whether the user was active in the region."""
    flagged = with_region_flag(candidates, events)
    return (
        flagged.withColumn("match_score", F.lit(CONSTANT_SCORE))
        .withColumn("reason", F.when(F.col("in_user_region"), POPULAR).otherwise(TRENDING))
        .drop("in_user_region")
    )


def _tour_tags(tours: DataFrame) -> DataFrame:
    return tours.select("tour_id", F.explode(F.array_distinct("tags")).alias("tag"))


def content_scores(candidates: DataFrame, liked: DataFrame, tours: DataFrame) -> DataFrame:
    """Tag overlap (intersection over union) of each (user, tour) candidate with all tags of the
    tours the user liked.  Set sizes come from counts, so no user's tags are gathered in one row."""
    tags = _tour_tags(tours)
    user_tags = liked.select("user_id", "tour_id").distinct().join(tags, "tour_id").select("user_id", "tag").distinct()
    known = user_tags.groupBy("user_id").agg(F.count("*").alias("user_tags"))
    shared = (
        candidates.select("user_id", "tour_id")
        .join(tags, "tour_id")
        .join(user_tags.withColumn("hit", F.lit(1)), ["user_id", "tag"], "left")
        .groupBy("user_id", "tour_id")
        .agg(F.count("*").alias("tour_tags"), F.count("hit").alias("shared"))
    )
    union = F.col("tour_tags") + F.coalesce("user_tags", F.lit(0)) - F.col("shared")
    return shared.join(known, "user_id", "left").select(
        "user_id", "tour_id", (F.col("shared") / union).alias("content_score")
    )


def peer_scores(events: DataFrame, users: DataFrame) -> DataFrame:
    """Collaborative score: share of a peer group's bookers that booked the tour.

    ``users`` has (user_id, peers).  Bookings fold to distinct (user, tour) map-side before the
    join, and the counts go through (group, tour), so neither a hot user, a hot tour nor a large
    group meets in one task.
    """
    booked = (
        events.where(F.col("event_type") == "booking").select("user_id", "tour_id").distinct().join(users, "user_id")
    )
    bookers = booked.groupBy("peers").agg(F.countDistinct("user_id").alias("bookers"))
    return (
        booked.groupBy("peers", "tour_id")
        .agg(F.count("*").alias("co_bookers"))
        .join(bookers, "peers")
        .select("peers", "tour_id", "co_bookers", (F.col("co_bookers") / F.col("bookers")).alias("peer_score"))
    )


def also_booked(events: DataFrame, tour_id) -> DataFrame:
    """Co-occurrence with one tour: how many of its bookers booked each other tour.  Linear in the
    bookings; the full tour-by-tour table would be quadratic in a user's tours."""
    booked = events.where(F.col("event_type") == "booking").select("user_id", "tour_id").distinct()
    bookers = booked.where(F.col("tour_id") == tour_id).select("user_id")
    return (
        booked.where(F.col("tour_id") != tour_id)
        .join(bookers, "user_id", "left_semi")
        .groupBy("tour_id")
        .agg(F.count("*").alias("co_bookers"))
    )


def _booked(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "booking").select("user_id", "tour_id").distinct()


def item_scores(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Item-based collaborative score of every tour an asked user (``asked``: user_id) has not booked.

    The score adds up, over the user's tours, how alike the tour is to each: co-bookers over the root of the product
    of the two numbers of bookers.  Co-bookers of an asked user's tour are met one by one, each with all its tours, so
    nothing is computed for users that are not linked with an asked one.  A tour with more than ``LIGHT`` bookers
    would meet too many: its co-bookers are counted per other tour first, by joins whose partial sums are formed
    before each shuffle.  Tours that no co-booker links with the user have no row.
    """
    booked = cut_lineage(_booked(events))
    counted = booked.join(booked.groupBy("tour_id").agg(F.count("*").alias("bookers")), "tour_id")
    counted = cut_lineage(counted.select("user_id", "tour_id", "bookers"))
    own = counted.join(asked.select("user_id").distinct(), "user_id", "left_semi")
    light, hot = own.where(F.col("bookers") <= LIGHT), own.where(F.col("bookers") > LIGHT)
    co_bookers = (
        light.withColumnRenamed("bookers", "of_asked")
        .join(counted.select("tour_id", F.col("user_id").alias("co_booker")), "tour_id")
        .where(F.col("co_booker") != F.col("user_id"))
        .select("user_id", "co_booker", "of_asked")
    )
    root = F.sqrt(F.col("of_asked") * F.col("bookers"))
    parts = co_bookers.join(counted.withColumnRenamed("user_id", "co_booker"), "co_booker").select(
        "user_id", "tour_id", (1 / root).alias("part")
    )
    if not hot.isEmpty():
        parts = parts.unionByName(_hot_parts(booked, counted, hot))
    return (
        parts.groupBy("user_id", "tour_id")
        .agg(F.round(F.sum("part"), 6).alias("item_score"))
        .join(own, ["user_id", "tour_id"], "left_anti")
    )


def _hot_parts(booked: DataFrame, counted: DataFrame, own: DataFrame) -> DataFrame:
    """(user_id, tour_id, part): how alike each tour is to each tour of ``own``, for the users of it."""
    pairs = also_booked_each(booked.withColumn("event_type", F.lit("booking")), own)
    bookers = counted.select("tour_id", "bookers").distinct()
    alike = (
        pairs.join(bookers.select(F.col("tour_id").alias("asked_tour_id"), F.col("bookers").alias("of_asked")), "asked_tour_id")
        .join(bookers, "tour_id")
        .select("asked_tour_id", "tour_id", (F.col("co_bookers") / F.sqrt(F.col("of_asked") * F.col("bookers"))).alias("part"))
    )
    asked = own.select("user_id", F.col("tour_id").alias("asked_tour_id"))
    return asked.join(alike, "asked_tour_id").select("user_id", "tour_id", "part")


def personal_recommendations(events: DataFrame, asked: DataFrame, tours: DataFrame, limit: int = 5) -> DataFrame:
    """Top tours per asked user by item score (relative to the user's best), own taste in tags, and rating.

    Every tour with an item score is a candidate; no list per country stands in between.  Taste is compared for the
    candidates that it can bring into the list: a tour whose score with the most that taste can give stays below
    ``limit`` others without it is none.
    """
    known = tours.select("tour_id", "region", "rating", F.lit(True).alias("known"))
    scores = cut_lineage(item_scores(events, asked).join(known, "tour_id", "left"))
    own = cut_lineage(_booked(events).join(asked.select("user_id").distinct(), "user_id", "left_semi"))
    rest = PEERS_WEIGHT * (F.col("item_score") / F.col("best")) + RATING_WEIGHT * (F.col("rating") / 5)
    best = scores.groupBy("user_id").agg(F.max("item_score").alias("best"))
    rows = scores.where("known").drop("known").join(best, "user_id").withColumn("rest", rest)
    rows = rows.join(_least_and_most(rows, own, tours, limit), "user_id", "left")
    reachable = F.col("rest") + F.coalesce("most", F.lit(0.0)) + PERSONAL_ROUNDING >= F.col("least")
    rows = cut_lineage(rows.where(F.coalesce(reachable, F.lit(True))).drop("rest", "least", "most"))
    content = content_scores(rows.select("user_id", "tour_id").distinct(), own, tours)
    score = (
        PEERS_WEIGHT * (F.col("item_score") / F.col("best"))
        + CONTENT_WEIGHT * F.coalesce("content_score", F.lit(0.0))
        + RATING_WEIGHT * (F.col("rating") / 5)
    )
    rows = rows.join(content, ["user_id", "tour_id"], "left").select(
        "user_id", "tour_id", "region", "item_score", F.round(score, 6).alias("match_score")
    )
    return top_per_key(rows, ["user_id"], [F.desc("match_score"), F.col("tour_id")], limit)


def _least_and_most(rows: DataFrame, own: DataFrame, tours: DataFrame, limit: int) -> DataFrame:
    """(user_id, least, most): a bound that ``limit`` tours of the user reach by ``rest``, and the most taste can add.

    Tours are dealt into some slices, whose best ones are different tours; the bound is the ``limit``-th of them.  A
    tour shares no more tags with a user than it has, and the union is no smaller than the user's tags.
    """
    tags = _tour_tags(tours)
    tagged = tags.groupBy("tour_id").count().agg(F.max("count")).first()[0] or 0
    taste = own.join(tags, "tour_id").select("user_id", "tag").distinct().groupBy("user_id").agg(F.count("*").alias("liked"))
    top = F.sort_array(F.collect_list("top"), False)
    least = (
        rows.groupBy("user_id", F.pmod(F.xxhash64("tour_id"), F.lit(SPREAD * limit)).alias("slice"))
        .agg(F.max("rest").alias("top"))
        .groupBy("user_id")
        .agg(F.get(top, F.lit(limit - 1)).alias("least"))
    )
    most = F.when(F.col("liked") > 0, CONTENT_WEIGHT * tagged / F.col("liked"))
    return least.join(taste, "user_id", "left").select("user_id", "least", most.alias("most"))


def also_booked_each(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Co-occurrence with every tour of ``asked`` (tour_id): how many of its bookers booked each other tour.

    Pairs of an asked and another tour are counted in the tasks that make them, before they are shuffled.  The join is
    by user; adaptive execution splits the side of a user with very many tours.
    """
    booked = events.where(F.col("event_type") == "booking").select("user_id", "tour_id").distinct()
    bookers = booked.join(asked.select("tour_id").distinct(), "tour_id").select(
        "user_id", F.col("tour_id").alias("asked_tour_id")
    )
    return (
        booked.join(bookers, "user_id")
        .where(F.col("tour_id") != F.col("asked_tour_id"))
        .groupBy("asked_tour_id", "tour_id")
        .agg(F.count("*").alias("co_bookers"))
    )


def hybrid_scores(events: DataFrame, users: DataFrame, tours: DataFrame) -> DataFrame:
    """Peer score (relative to the group's best tour), home-region match and rating, weighted.
    ``users`` has (user_id, peers, home_region); a group has one home region."""
    peers = peer_scores(events, users)
    best = peers.groupBy("peers").agg(F.max("peer_score").alias("best"))
    home = users.groupBy("peers").agg(F.max("home_region").alias("home_region"))
    rows = peers.join(best, "peers").join(home, "peers").join(tours.select("tour_id", "region", "rating"), "tour_id")
    content = F.when(F.col("region") == F.col("home_region"), 1.0).otherwise(0.0)
    score = (
        PEERS_WEIGHT * (F.col("peer_score") / F.col("best"))
        + CONTENT_WEIGHT * content
        + RATING_WEIGHT * (F.col("rating") / 5)
    )
    return rows.select("peers", "tour_id", "region", F.col("rating").alias("predicted_rating"), F.round(score, 9).alias("match_score"))


def recommendations(events: DataFrame, users: DataFrame, tours: DataFrame, limit: int = 5) -> DataFrame:
    """Top tours per user, best score first, without those the user has booked.

    Candidates are all scored tours of the user's peer group; they are scored by the group's score and by how well
    their tags meet those of the user's bookings.  The group lists are fetched to a depth that grows: a user's list is
    final once no deeper tour can beat its last row, and only users whose list is not final meet the deeper lists.
    More than ``MAX_RECOMMENDATIONS`` rows are refused.
    """
    if not 0 < limit <= MAX_RECOMMENDATIONS:
        raise ValueError(f"limit must be 1 to {MAX_RECOMMENDATIONS}")
    active = events.select("user_id").distinct().join(users.select("user_id", "peers"), "user_id")
    booked = events.where(F.col("event_type") == "booking").select("user_id", "tour_id").distinct()
    # a user's tags are a set of the tag vocabulary, whatever the number of bookings
    taste = booked.join(_tour_tags(tours), "tour_id").groupBy("user_id").agg(F.collect_set("tag").alias("liked"))
    tagged = hybrid_scores(events, users, tours).join(
        tours.select("tour_id", F.array_distinct("tags").alias("tags")), "tour_id"
    )
    # the least score that still counts; none is known yet
    open_users = active.join(taste, "user_id", "left").withColumn("least", F.lit(-1.0))
    order = [F.desc("match_score"), F.col("tour_id")]
    tagged, booked, open_users = cut_lineage(tagged), cut_lineage(booked), cut_lineage(open_users)
    most = tagged.agg(F.max(F.size("tags"))).first()[0] or 0
    done, depth = [], MAX_RECOMMENDATIONS
    while True:
        lists = cut_lineage(top_per_key(tagged, ["peers"], order, depth).drop("rank"))
        best = cut_lineage(_best_unbooked(open_users, lists, booked, limit))
        reach = lists.groupBy("peers").agg(F.count("*").alias("listed"), F.min("match_score").alias("last"))
        filled = best.groupBy("user_id").agg(F.count("*").alias("rows"), F.min("match_score").alias("found"))
        # the upper bound of all tours not fetched, with a margin for rounding
        bound = (1 - OWN_WEIGHT) * F.col("last") + _most_own(F.lit(most)) + ROUNDING
        full = F.coalesce(F.col("rows") == limit, F.lit(False))
        state = cut_lineage(
            open_users.join(reach, "peers", "left")
            .join(filled, "user_id", "left")
            .withColumn("final", F.coalesce(F.col("listed") < depth, F.lit(True)) | (full & (F.col("found") > bound)))
            .withColumn("least", F.when(full, F.col("found")).otherwise(F.lit(-1.0)))
            .select("user_id", "peers", "liked", "least", "final")
        )
        done.append(best.join(state.where("final").select("user_id"), "user_id", "left_semi"))
        open_users = state.where("NOT final").drop("final")
        if open_users.isEmpty():
            return _recommended(reduce(DataFrame.unionByName, done))
        depth *= DEEPER


def _most_own(most: Column) -> Column:
    """Upper bound of the own taste's part: the union is no smaller than the liked tags, and a tour has ``most`` tags."""
    share = F.least(F.lit(1.0), most / F.size("liked"))
    return F.when(F.col("liked").isNotNull() & (F.size("liked") > 0), OWN_WEIGHT * share).otherwise(0.0)


def _best_unbooked(open_users: DataFrame, lists: DataFrame, booked: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` unbooked tours per user among the lists of the groups.  Tours that can't reach the score a
    user has found before are left out first.  How the group lists meet the users is left to the optimizer."""
    reachable = (1 - OWN_WEIGHT) * F.col("match_score") + _most_own(F.size("tags")) + ROUNDING >= F.col("least")
    candidates = open_users.join(lists, "peers").where(reachable).join(booked, ["user_id", "tour_id"], "left_anti")
    shared = F.size(F.array_intersect("tags", "liked"))
    content = F.when(F.col("liked").isNotNull(), shared / (F.size("tags") + F.size("liked") - shared)).otherwise(0.0)
    score = (1 - OWN_WEIGHT) * F.col("match_score") + OWN_WEIGHT * F.coalesce(content, F.lit(0.0))
    scored = candidates.withColumn("match_score", F.round(score, 9)).select(
        "user_id", "tour_id", "match_score", "predicted_rating", "region"
    )
    best = Window.partitionBy("user_id").orderBy(F.desc("match_score"), "tour_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def _recommended(ranked: DataFrame) -> DataFrame:
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.col("tour_id").cast("string"))
    return ranked.select(
        F.md5(key).alias("recommendation_id"),
        "user_id",
        "tour_id",
        "match_score",
        "predicted_rating",
        "region",
        "rank",
    )


def popular(events: DataFrame, key: str, n: int = 10) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key).limit(n)


def zero_result_searches(searches: DataFrame) -> DataFrame:
    """Queries that found nothing, by how often they were asked."""
    return (
        searches.where((F.col("results_count") == 0) & (F.col("query") != ""))
        .groupBy("query")
        .agg(F.count("*").alias("count"))
    )
