"""Recommendations and keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import recommend
from strata.operators.search import search, search_index, write_index
from strata.queries import query
from strata.queries.entity_sql import using
from strata.session import fresh_path


def users(e):
    return e.customers().select(
        F.col("c_custkey").alias("user_id"), F.col("n_name").alias("peers"), F.col("r_name").alias("home_region")
    )


@query("R1 J4", using("tour_events", c="SELECT DISTINCT user_id, tour_id, region FROM tour_events WHERE event_type = 'click'",
                      r="SELECT DISTINCT user_id, region FROM tour_events WHERE event_type = 'booking'") + """
    SELECT c.user_id, c.tour_id, c.region, 0.85::DOUBLE AS match_score,
           CASE WHEN r.user_id IS NOT NULL THEN 'Popular in your region' ELSE 'Trending' END AS reason
    FROM c LEFT JOIN r ON c.user_id = r.user_id AND c.region = r.region""")
def recommendation_reasons(e):
    candidates = e.tour_events("click").select("user_id", "tour_id", "region").distinct()
    return recommend.with_reason(candidates, e.tour_events("booking"))


@query("R2", using("tours", "tour_events", tg="SELECT DISTINCT tour_id, unnest(tags) AS tag FROM tours", u="""
        SELECT DISTINCT user_id, tag FROM tour_events t JOIN tg ON t.tour_id = tg.tour_id WHERE event_type = 'booking'""", c="""
        SELECT DISTINCT user_id, tour_id FROM tour_events WHERE event_type = 'click'""", s="""
        SELECT c.user_id, c.tour_id, count(*) AS nt, count(u.tag) AS shared FROM c JOIN tg ON c.tour_id = tg.tour_id
        LEFT JOIN u ON c.user_id = u.user_id AND u.tag = tg.tag GROUP BY ALL""",
        k="SELECT user_id, count(*) AS nu FROM u GROUP BY user_id") + """
    SELECT s.user_id, tour_id, shared / (nt + coalesce(nu, 0) - shared) AS content_score FROM s LEFT JOIN k ON s.user_id = k.user_id""")
def content_scores(e):
    clicked = e.tour_events("click").select("user_id", "tour_id").distinct()
    return recommend.content_scores(clicked, e.tour_events("booking"), e.tours())


_PEERS = dict(us="""SELECT c_custkey AS user_id, n_name AS peers, r_name AS home FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", b="""
        SELECT DISTINCT us.user_id, peers, tour_id FROM tour_events t JOIN us ON t.user_id = us.user_id WHERE event_type = 'booking'""", p="""
        SELECT peers, tour_id, count(*) AS co_bookers,
               count(*) / (SELECT count(DISTINCT user_id) FROM b x WHERE x.peers = b.peers) AS peer_score FROM b GROUP BY peers, tour_id""")
_HYBRID = dict(_PEERS, h="""
        SELECT p.peers, p.tour_id, tours.region, rating AS predicted_rating,
               round(0.5::DOUBLE * (peer_score / max(peer_score) OVER (PARTITION BY p.peers))
                     + 0.3::DOUBLE * CASE WHEN tours.region = hm.home THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.2::DOUBLE * (rating / 5), 9) AS match_score
        FROM p JOIN tours ON p.tour_id = tours.tour_id JOIN (SELECT peers, max(home) AS home FROM us GROUP BY peers) hm ON hm.peers = p.peers""")


@query("R3", using("tour_events", **_PEERS) + "SELECT peers, tour_id, co_bookers, peer_score FROM p")
def peer_scores(e):
    return recommend.peer_scores(e.tour_events(), users(e).select("user_id", "peers"))


@query("R3", using("tour_events", b="SELECT DISTINCT user_id, tour_id FROM tour_events WHERE event_type = 'booking'") + """
    SELECT o.tour_id, count(*) AS co_bookers FROM b o JOIN b a ON o.user_id = a.user_id
    WHERE a.tour_id = 42 AND o.tour_id <> 42 GROUP BY o.tour_id""")
def also_booked(e):
    return recommend.also_booked(e.tour_events("booking"), 42)


@query("R3", using("tour_events", b="SELECT DISTINCT user_id, tour_id FROM tour_events WHERE event_type = 'booking'") + """
    SELECT a.tour_id AS asked_tour_id, o.tour_id, count(*) AS co_bookers FROM b o JOIN b a ON o.user_id = a.user_id
    WHERE a.tour_id % 50 = 0 AND o.tour_id <> a.tour_id GROUP BY ALL""")
def also_booked_each(e):
    return recommend.also_booked_each(e.tour_events("booking"), e.tours().where("tour_id % 50 = 0"))


@query("R4", using("tours", "tour_events", **_HYBRID) + "SELECT peers, tour_id, region, predicted_rating, match_score FROM h")
def hybrid_scores(e):
    return recommend.hybrid_scores(e.tour_events(), users(e), e.tours())


@query("R4 W3 R2", using("tours", "tour_events", **_HYBRID, a="SELECT DISTINCT user_id FROM tour_events", c="""
        SELECT a.user_id, t.* FROM a JOIN us ON a.user_id = us.user_id JOIN h t ON t.peers = us.peers
        LEFT JOIN b ON b.user_id = a.user_id AND b.tour_id = t.tour_id WHERE b.user_id IS NULL""",
        tg="SELECT DISTINCT tour_id, unnest(tags) AS tag FROM tours",
        u="SELECT DISTINCT b.user_id, tag FROM b JOIN tg ON b.tour_id = tg.tour_id",
        s="""
        SELECT c.user_id, c.tour_id, count(*) AS nt, count(u.tag) AS shared FROM c JOIN tg ON c.tour_id = tg.tour_id
        LEFT JOIN u ON c.user_id = u.user_id AND u.tag = tg.tag GROUP BY ALL""",
        k="SELECT user_id, count(*) AS nu FROM u GROUP BY user_id", f="""
        SELECT c.user_id, c.tour_id, region, predicted_rating,
               round(0.7::DOUBLE * match_score + 0.3::DOUBLE * coalesce(shared / (nt + coalesce(nu, 0) - shared), 0), 9) AS match_score
        FROM c LEFT JOIN s ON s.user_id = c.user_id AND s.tour_id = c.tour_id LEFT JOIN k ON k.user_id = c.user_id""") + """
    SELECT md5(user_id || '|' || tour_id) AS recommendation_id, * FROM (
        SELECT user_id, tour_id, match_score, predicted_rating, region,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, tour_id) AS INT) AS rank FROM f)
    WHERE rank <= 5""")
def recommendations(e):
    return recommend.recommendations(e.tour_events(), users(e), e.tours(), 5)


_ITEMS = dict(b="SELECT DISTINCT user_id, tour_id FROM tour_events WHERE event_type = 'booking'",
              n="SELECT tour_id, count(*) AS bookers FROM b GROUP BY tour_id",
              q="SELECT user_id, tour_id FROM b WHERE user_id % 50 = 0", sim="""
        SELECT x.tour_id AS asked_tour_id, y.tour_id, count(*) / sqrt(any_value(nx.bookers) * any_value(ny.bookers)) AS alike
        FROM b x JOIN b y ON x.user_id = y.user_id AND x.tour_id <> y.tour_id
        JOIN n nx ON nx.tour_id = x.tour_id JOIN n ny ON ny.tour_id = y.tour_id
        WHERE x.tour_id IN (SELECT tour_id FROM q) GROUP BY x.tour_id, y.tour_id""", i="""
        SELECT q.user_id, sim.tour_id, round(sum(alike), 6) AS item_score FROM q JOIN sim ON sim.asked_tour_id = q.tour_id
        WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.user_id = q.user_id AND o.tour_id = sim.tour_id)
        GROUP BY q.user_id, sim.tour_id""")


@query("R3", using("tour_events", **_ITEMS) + "SELECT user_id, tour_id, item_score FROM i")
def item_scores(e):
    return recommend.item_scores(e.tour_events(), users(e).where("user_id % 50 = 0"))


@query("R4 W3 R2 R3", using("tours", "tour_events", **_ITEMS, tg="SELECT DISTINCT tour_id, unnest(tags) AS tag FROM tours",
        u="SELECT DISTINCT q.user_id, tag FROM q JOIN tg ON q.tour_id = tg.tour_id",
        k="SELECT user_id, count(*) AS nu FROM u GROUP BY user_id", s="""
        SELECT i.user_id, i.tour_id, count(u.tag) / (count(*) + any_value(coalesce(nu, 0)) - count(u.tag)) AS content
        FROM i JOIN tg ON i.tour_id = tg.tour_id LEFT JOIN k ON k.user_id = i.user_id
        LEFT JOIN u ON u.user_id = i.user_id AND u.tag = tg.tag GROUP BY i.user_id, i.tour_id""", f="""
        SELECT i.user_id, i.tour_id, region, item_score,
               round(0.5::DOUBLE * (item_score / max(item_score) OVER (PARTITION BY i.user_id))
                     + 0.3::DOUBLE * coalesce(content, 0) + 0.2::DOUBLE * (rating / 5), 6) AS match_score
        FROM i JOIN tours ON tours.tour_id = i.tour_id LEFT JOIN s ON s.user_id = i.user_id AND s.tour_id = i.tour_id""") + """
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, tour_id) AS INT) AS rank FROM f)
    WHERE rank <= 5""")
def personal_recommendations(e):
    return recommend.personal_recommendations(e.tour_events(), users(e).where("user_id % 50 = 0"), e.tours())


@query("R6", using("tours", "tour_events") + """
    SELECT tour_id, count(*) AS count FROM tour_events GROUP BY tour_id ORDER BY count DESC, tour_id LIMIT 10""")
def popular_tours(e):
    return recommend.popular(e.tour_events(), "tour_id")


@query("R6", using("searches") + "SELECT query, count(*) AS count FROM searches GROUP BY query ORDER BY count DESC, query LIMIT 10")
def popular_searches(e):
    return recommend.popular(e.searches(), "query")


@query("R6 P25", using("searches") + "SELECT query, count(*) AS count FROM searches WHERE results_count = 0 AND query <> '' GROUP BY query")
def zero_result_searches(e):
    return recommend.zero_result_searches(e.searches())


def _search_sql(source: str, key: str, fields: dict[str, tuple[float, str]], terms: list[str], size: int) -> str:
    words = " UNION ALL ".join(
        f"SELECT {key}, '{f}' AS field, {boost}::DOUBLE AS boost, unnest({split}) AS term FROM {source}"
        for f, (boost, split) in fields.items()
    )
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""tf AS (SELECT {key}, field, boost, term, count(*) AS tf FROM ({words}) WHERE term IN ({listed}) GROUP BY ALL),
    df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL)
    SELECT {key}, round(sum(boost * tf * ln(1 + (SELECT count(*) FROM {source}) / df)), 6) AS score
    FROM tf JOIN df ON tf.field = df.field AND tf.term = df.term GROUP BY {key} ORDER BY score DESC, {key} LIMIT {size}"""


_SPLIT = r"string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+')"


@query("R5", using("tours")[:-1] + ",\n" + _search_sql("tours", "tour_id", {
    "name": (2.0, _SPLIT.format("name")), "category": (1.0, _SPLIT.format("category")), "tags": (1.0, "tags")},
    ["economy", "red", "ring"], 50))
def tour_search(e):
    return search(e.tours(), "tour_id", {"name": 2.0, "category": 1.0, "tags": 1.0}, "red ring economy", 50)


_DOCUMENTS = "WITH " + _search_sql("documents", "doc_id", {"text": (1.0, _SPLIT.format("text"))}, ["thea", "nicht", "eden"], 100)


@query("R5", _DOCUMENTS)
def document_search(e):
    return search(e.table("documents"), "doc_id", {"text": 1.0}, "thea nicht eden", 100)


@query("R5", _DOCUMENTS)
def indexed_document_search(e):
    """The same answer from an index that is written once and opened at the asked terms."""
    path = fresh_path(e.spark, "index")
    write_index(e.table("documents"), "doc_id", ["text"], path)
    return search_index(e.spark, path, "doc_id", "bigint", {"text": 1.0}, "thea nicht eden", 100)
