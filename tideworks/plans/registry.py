"""Registered queries over the shared tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideworks.operators import custom
from tideworks.operators import multiset as ms
from tideworks.operators import relational as rel
from tideworks.operators import windows as win
from tideworks.plans import auctions as nex
from tideworks.plans import fixtures as fx
from tideworks.plans import sqltexts
from tideworks.plans import workloads as wl
from tideworks.sources import auctions as source
from tideworks.sources import graphs
from tideworks.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ROUNDS, CENTRES = 6, 5
SLICE, SLICES, SIZE, DAY = "2 hours", 5, "10 hours", "1 day"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# The auction queries.

add("nexmark_q0", lambda s, d: nex.q0(fx.bid(s, d)), fx.sql("SELECT auction, bidder, price, dateTime, extra FROM bid", "bid"))
add("nexmark_q1", lambda s, d: nex.q1(fx.bid(s, d)).withColumn("price", F.col("price").cast("double")), fx.sql("SELECT auction, bidder, CAST(CAST(CAST(0.908 AS DECIMAL(4, 3)) * price AS DECIMAL(23, 3)) AS DOUBLE) AS price, dateTime, extra FROM bid", "bid"))
add("nexmark_q1_float", lambda s, d: nex.q1(fx.bid(s, d), exact=False), fx.sql("SELECT auction, bidder, CAST(trunc(CAST(price AS FLOAT) * CAST(0.908 AS FLOAT)) AS BIGINT) AS price, dateTime, extra FROM bid", "bid"))
add("nexmark_q2", lambda s, d: nex.q2(fx.bid(s, d)), fx.sql("SELECT auction, price FROM bid WHERE auction % 123 = 0", "bid"))
add("nexmark_q3", lambda s, d: nex.q3(fx.person(s, d), fx.auction(s, d), ("BUILDING", "MACHINERY")), fx.sql("SELECT name, city, state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE category = 10 AND upper(state) IN ('BUILDING', 'MACHINERY')", "auction", "person"))

_WON = "won AS (SELECT a.id, a.seller, a.category, a.reserve, a.dateTime, a.expires, b.bidder, b.price, b.dateTime AS bidTime FROM auction a JOIN bid b ON a.id = b.auction WHERE b.price >= a.reserve AND b.dateTime >= a.dateTime AND b.dateTime < a.expires QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.price DESC, b.dateTime, b.bidder) = 1)"
_FINAL = "final AS (SELECT a.id, a.seller, a.category, a.expires, max(b.price) AS final FROM auction a JOIN bid b ON a.id = b.auction WHERE b.dateTime BETWEEN a.dateTime AND a.expires GROUP BY ALL)"


def _auction_bid(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(fx.auction(s, d), fx.bid(s, d))


add("nexmark_winning_bids", _auction_bid(nex.winning_bids), fx.sql("SELECT * FROM won", "auction", "bid", more=_WON))
add("nexmark_q4", _auction_bid(nex.q4), fx.sql("SELECT category, avg(price) AS avg_price FROM won GROUP BY category", "auction", "bid", more=_WON))
add("nexmark_q4_sql", _auction_bid(nex.q4_sql), fx.sql("SELECT category, avg(final) AS avg_price FROM final GROUP BY category", "auction", "bid", more=_FINAL))
add("nexmark_q4_running", _auction_bid(nex.running_average), fx.sql("SELECT id, category, avg(price) OVER (PARTITION BY category ORDER BY expires, id ROWS UNBOUNDED PRECEDING) AS avg_price FROM won", "auction", "bid", more=_WON))

_HOPS = "hops AS (SELECT window_start, auction, count(*) AS num FROM (SELECT time_bucket(INTERVAL '2 hours', dateTime, TIMESTAMP '1970-01-01') - k * INTERVAL '2 hours' AS window_start, auction FROM click_bid, range(5) r(k)) GROUP BY ALL)"
_Q5 = "SELECT window_start, auction, num FROM hops QUALIFY num = max(num) OVER (PARTITION BY window_start)"
add("nexmark_q5", lambda s, d: nex.q5(fx.click_bid(s, d), SLICE, SLICES), fx.sql(_Q5, "click_bid", more=_HOPS))
add("nexmark_q5_top1", lambda s, d: nex.q5_top1(fx.click_bid(s, d), SLICE, SLICES), fx.sql(f"SELECT window_start, num, min(auction) AS auction FROM ({_Q5}) GROUP BY ALL", "click_bid", more=_HOPS))
add("nexmark_q6", _auction_bid(nex.q6), fx.sql("SELECT id, seller, avg(price) OVER (PARTITION BY seller ORDER BY expires, id ROWS 9 PRECEDING) AS avg_price FROM won", "auction", "bid", more=_WON))
add("nexmark_q6_sql", _auction_bid(nex.q6_sql), fx.sql("SELECT id, seller, avg(final) OVER (PARTITION BY seller ORDER BY expires, id ROWS 10 PRECEDING) AS avg_price FROM final", "auction", "bid", more=_FINAL))
_W10 = "time_bucket(INTERVAL '10 hours', dateTime, TIMESTAMP '1970-01-01')"
_Q7 = f"SELECT {_W10} AS window_start, auction, price, bidder FROM click_bid QUALIFY price = max(price) OVER (PARTITION BY {_W10})"
add("nexmark_q7", lambda s, d: nex.q7(fx.click_bid(s, d), SIZE), fx.sql(_Q7, "click_bid"))
add("nexmark_q7_top1", lambda s, d: nex.q7_top1(fx.click_bid(s, d), SIZE), fx.sql(f"SELECT * FROM ({_Q7}) QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY auction, bidder) = 1", "click_bid"))
_D = "time_bucket(INTERVAL '1 day', {}.dateTime, TIMESTAMP '1970-01-01')"
add("nexmark_q8", lambda s, d: nex.q8(fx.signup(s, d), fx.listing(s, d), DAY), fx.sql(f"SELECT DISTINCT p.id, p.name, {_D.format('p')} AS starttime FROM signup p JOIN listing a ON p.id = a.seller AND {_D.format('p')} = {_D.format('a')}", "signup", "listing"))
add("nexmark_q8_pairs", lambda s, d: nex.q8_pairs(fx.signup(s, d), fx.listing(s, d), DAY), fx.sql(f"SELECT p.id, p.name, a.reserve FROM signup p JOIN listing a ON p.id = a.seller AND {_D.format('p')} = {_D.format('a')}", "signup", "listing"))

# The same over streams, all that is there once.  The streams' last windows are closed by an event far ahead.

for _name in ("nexmark_q0", "nexmark_q1_float", "nexmark_q2", "nexmark_q3", "nexmark_winning_bids", "nexmark_q4", "nexmark_q5", "nexmark_q6", "nexmark_q7", "nexmark_q8"):
    add(_name.replace("nexmark", "stream"), runs.QUERIES[_name], SQL[_name])
add("auction_source", lambda s, d: nex.q4(*source.views(source.batch(s, 200_000, partitions=8))[1:]))

# Collisions.

_WEEK = "CAST(floor(dayofyear(date) / 7) AS INTEGER)"
_WEEKLY = f"weekly AS (SELECT borough, CAST(year(date) AS INTEGER) AS year, {_WEEK} AS week, count(*) AS accidents, CAST(sum(killed) AS BIGINT) AS lethal FROM accident WHERE borough <> '' GROUP BY ALL)"
add("collisions_q1", lambda s, d: wl.lethal_by_week(fx.accident(s, d)), fx.sql(f"SELECT CAST(year(date) AS INTEGER) AS year, {_WEEK} AS week, CAST(sum(killed) AS BIGINT) AS lethal FROM accident GROUP BY ALL", "accident"))
add("collisions_q2", lambda s, d: wl.by_factor(fx.accident(s, d)), fx.sql("SELECT factor, count(*) AS accidents, CAST(sum(killed) AS BIGINT) AS lethal, 100.0::DOUBLE * sum(killed) / count(*) AS pct FROM (SELECT unnest(list_distinct(factors)) AS factor, killed FROM accident) WHERE factor <> '' GROUP BY factor", "accident"))
add("collisions_q3", lambda s, d: wl.by_borough_and_week(fx.accident(s, d))[0], fx.sql("SELECT * FROM weekly", "accident", more=_WEEKLY))
add("collisions_q3_numbers", lambda s, d: wl.by_borough_and_week(fx.accident(s, d))[1], fx.sql("SELECT borough, week, CAST(sum(accidents) AS BIGINT) AS accidents, CAST(sum(lethal) AS BIGINT) AS lethal, 100.0::DOUBLE * sum(lethal) / sum(accidents) AS pct FROM weekly GROUP BY ALL", "accident", more=_WEEKLY))

# Words, k-means, Collatz.

_WORDS = "SELECT word, count(*) AS count FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents) GROUP BY word"
add("word_count", lambda s, d: wl.word_count(fx.table(s, d, "documents"), "text"), _WORDS)
add("word_count_by_split", lambda s, d: wl.word_count(fx.table(s, d, "documents"), "text", by_split=True), _WORDS)

_KMEANS = f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, x, y FROM points QUALIFY c < {CENTRES})"
for _i in range(ROUNDS):
    _KMEANS += f", a{_i} AS (SELECT p.id, p.x, p.y, c.c FROM points p, c{_i} c QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.c) = 1), c{_i + 1} AS (SELECT c, avg(x) AS x, avg(y) AS y FROM a{_i} GROUP BY c)"
_KMEANS += f", a{ROUNDS} AS (SELECT p.id, c.c FROM points p, c{ROUNDS} c QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.c) = 1)"


def _centres(s: SparkSession, d: str) -> DataFrame:
    centres, _ = wl.kmeans(fx.points(s, d), CENTRES, ROUNDS)
    return s.createDataFrame([(i, round(x, 6), round(y, 6)) for i, (x, y) in centres], "id bigint, x double, y double")


add("kmeans", _centres, fx.sql(f"SELECT CAST(c AS BIGINT) AS id, round(x, 6) AS x, round(y, 6) AS y FROM c{ROUNDS}", "points", more=_KMEANS))
add("kmeans_sizes", lambda s, d: wl.kmeans(fx.points(s, d), CENTRES, ROUNDS)[1].groupBy(F.col("centre").cast("long").alias("centre")).agg(F.count("*").alias("points")), fx.sql(f"SELECT CAST(c AS BIGINT) AS centre, count(*) AS points FROM a{ROUNDS} GROUP BY c", "points", more=_KMEANS))
add("collatz", lambda s, d: wl.collatz(s.range(1, 2000).withColumnRenamed("id", "n")), "WITH RECURSIVE t AS (SELECT range AS n, range AS v, 0::BIGINT AS steps FROM range(1, 2000) UNION ALL SELECT n, CASE WHEN v % 2 = 0 THEN v // 2 ELSE 3 * v + 1 END, steps + 1 FROM t WHERE v > 1 AND steps < 1000), m AS (SELECT n, max(steps) AS steps FROM t GROUP BY n) SELECT steps, n FROM m ORDER BY steps DESC, n DESC LIMIT 1")

# The auction queries as SQL text.

_TEXTS = {
    "q0": ("nexmark_q0", ("bid",), {}), "q1": ("nexmark_q1", ("bid",), {}), "q2": ("nexmark_q2", ("bid",), {}),
    "q3": ("nexmark_q3", ("auction", "person"), {"states": "'BUILDING', 'MACHINERY'"}), "q4": ("nexmark_q4_sql", ("auction", "bid"), {}),
    "q5": ("nexmark_q5", ("click_bid",), {"size": SIZE, "slide": SLICE}), "q6": ("nexmark_q6_sql", ("auction", "bid"), {}),
    "q7": ("nexmark_q7", ("click_bid",), {"size": SIZE}), "q8": ("nexmark_q8", ("signup", "listing"), {"size": DAY}),
}
_VIEWS = {"click_bid": "bid", "signup": "person", "listing": "auction"}


def _text(name: str, tables: tuple[str, ...], settings: dict[str, str]) -> Query:
    return lambda s, d: sqltexts.run(s, name, {_VIEWS.get(t, t): getattr(fx, t)(s, d) for t in tables}, **settings)


for _name, (_same, _tables, _settings) in _TEXTS.items():
    add(f"sql_{_name}", _text(_name, _tables, _settings), SQL[_same])


# Graphs.

_LINKS = "links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM edges), size AS (SELECT count(*) AS n FROM vertices)"


def _rounds(start: str, step: str) -> str:
    return _LINKS + f", r0 AS ({start})" + "".join(f", r{i + 1} AS ({step.format(r=f'r{i}')})" for i in range(ROUNDS))


_ALL = _rounds("SELECT id, 1.0::DOUBLE / n AS rank FROM vertices, size", "SELECT v.id, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * coalesce(sum(p.rank / degree), 0) AS rank FROM vertices v CROSS JOIN size LEFT JOIN links l ON l.dst = v.id LEFT JOIN {r} p ON p.id = l.src GROUP BY v.id")
_IN = _rounds("SELECT id, 1.0::DOUBLE / n AS rank FROM vertices, size", "SELECT l.dst AS id, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * sum(p.rank / degree) AS rank FROM links l JOIN {r} p ON p.id = l.src CROSS JOIN size GROUP BY l.dst")
_INT = _rounds("SELECT id, 6000000::BIGINT AS rank FROM vertices", "SELECT v.id, 1000000 + coalesce(CAST(sum((5 * p.rank) // (6 * degree)) AS BIGINT), 0) AS rank FROM vertices v LEFT JOIN links l ON l.dst = v.id LEFT JOIN {r} p ON p.id = l.src GROUP BY v.id")


def _graph(f: Callable[..., DataFrame], *args) -> Query:
    return lambda s, d: f(fx.vertices(s, d), fx.edges(s, d), *args)


_rounded = lambda f: lambda v, e, n: f(v, e, n).withColumn("rank", F.round("rank", 9))
add("pagerank", _graph(_rounded(wl.pagerank), ROUNDS), fx.sql(f"SELECT id AS page, round(rank, 9) AS rank FROM r{ROUNDS}", "vertices", "edges", more=_ALL))
add("pagerank_inlinks", _graph(_rounded(wl.pagerank_inlinks), ROUNDS), fx.sql(f"SELECT id AS page, round(rank, 9) AS rank FROM r{ROUNDS}", "vertices", "edges", more=_IN))
add("pagerank_integer", _graph(wl.pagerank_integer, ROUNDS), fx.sql(f"SELECT id AS node, rank FROM r{ROUNDS}", "vertices", "edges", more=_INT))
add("connected_components", _graph(wl.connected_components))  # SQL would walk from every vertex to every other
add("transitive_closure", lambda s, d: wl.transitive_closure(fx.steps(s, d)), fx.sql("SELECT x, y FROM paths WHERE x <> y", "steps", recursive=True, more="paths AS (SELECT src AS x, dst AS y FROM steps UNION SELECT x, dst FROM paths JOIN steps ON src = y)"))
add("triangles", lambda s, d: wl.triangles(fx.edges(s, d)), fx.sql("SELECT count(*) AS triangles FROM e p JOIN e q ON p.b = q.a JOIN e r ON r.a = p.a AND r.b = q.b", "edges", more="e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst)"))

# Single operators.


def _routed(s: SparkSession, d: str) -> DataFrame:
    parts = rel.route(fx.table(s, d, "events"), F.col("event_type") == "signup", F.col("event_type") == "view", F.col("event_type").isin("purchase", "click"))
    counts = [p.agg(F.lit(i).alias("route"), F.count("*").alias("n")) for i, p in enumerate(parts)]
    return counts[0].union(counts[1]).union(counts[2])


add("op_route", _routed, "SELECT CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS route, count(*) AS n FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'click') GROUP BY ALL")
add("op_argmin", lambda s, d: rel.argmin(fx.bid(s, d), ["auction"], [F.col("price"), F.col("bidder"), F.col("dateTime")], ["bidder", "price"]), fx.sql("SELECT auction, bidder, price FROM bid QUALIFY row_number() OVER (PARTITION BY auction ORDER BY price, bidder, dateTime) = 1", "bid"))
add("op_left_join_default", lambda s, d: rel.left_join_default(fx.vertices(s, d), fx.edges(s, d).groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("out")), ["id"], out=F.lit("")), fx.sql("SELECT id, coalesce(list_aggregate(list_sort(list(dst) FILTER (dst IS NOT NULL)), 'string_agg', ','), '') AS out FROM vertices LEFT JOIN edges ON id = src GROUP BY id", "vertices", "edges"))
add("op_unordered_pairs", lambda s, d: rel.unordered_pairs(fx.edges(s, d), "src", "dst"), fx.sql("SELECT p.src, p.dst AS a, q.dst AS b FROM edges p JOIN edges q ON p.src = q.src AND p.dst < q.dst", "edges"))
add("op_except", lambda s, d: rel.except_rows(fx.edges(s, d), fx.edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))), fx.sql("SELECT src, dst FROM edges EXCEPT SELECT dst, src FROM edges", "edges"))
add("op_union_distinct", lambda s, d: rel.union_distinct(fx.edges(s, d), fx.edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))), fx.sql("SELECT src, dst FROM edges UNION SELECT dst, src FROM edges", "edges"))
add("op_first_rows", lambda s, d: rel.first_rows(fx.points(s, d), 10, "id"), fx.sql("SELECT * FROM points ORDER BY id LIMIT 10", "points"))
add("op_tumbling", lambda s, d: win.tumbling(fx.click_bid(s, d), "dateTime", SIZE).groupBy("window_start", "window_end").agg(F.count("*").alias("n"), F.max("price").alias("top")), fx.sql(f"SELECT {_W10} AS window_start, {_W10} + INTERVAL '10 hours' AS window_end, count(*) AS n, max(price) AS top FROM click_bid GROUP BY ALL", "click_bid"))
add("op_hopping", lambda s, d: win.hopping_counts(fx.click_bid(s, d), "dateTime", SLICE, SLICES, ["auction"]).select("window_start", "auction", "num"), fx.sql("SELECT window_start, auction, num FROM hops", "click_bid", more=_HOPS))
add("op_count_window", lambda s, d: fx.table(s, d, "events").select("event_id", "user_id", F.round(F.sum(F.round(F.col("value") * 100).cast("long")).over(win.last_rows(["user_id"], ["event_id"], 10)), 0).cast("long").alias("last10")), "SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) AS BIGINT) AS last10 FROM events")


def _weights(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = ms.weighted(fx.edges(s, d))
    return e, ms.concat(e, ms.negate(e.where("src % 2 = 0")), ms.weighted(fx.edges(s, d).where("dst % 3 = 0"), 2))


_WEIGHTS = "w AS (SELECT src, dst, CAST(1 - (src % 2 = 0)::INT + 2 * (dst % 3 = 0)::INT AS BIGINT) AS weight FROM edges)"
add("op_multiset_consolidate", lambda s, d: ms.consolidate(_weights(s, d)[1]), fx.sql("SELECT * FROM w WHERE weight <> 0", "edges", more=_WEIGHTS))
add("op_multiset_semijoin", lambda s, d: ms.semijoin(_weights(s, d)[0], _weights(s, d)[1].select("src", "weight"), ["src"]), fx.sql("SELECT e.src, e.dst, k.weight FROM edges e JOIN (SELECT src, CAST(sum(weight) AS BIGINT) AS weight FROM w GROUP BY src) k ON e.src = k.src WHERE k.weight <> 0", "edges", more=_WEIGHTS))
add("op_multiset_threshold", lambda s, d: ms.threshold(_weights(s, d)[1], lambda w: F.least(w, F.lit(2))), fx.sql("SELECT src, dst, least(weight, 2) AS weight FROM w WHERE weight <> 0", "edges", more=_WEIGHTS))
add("op_fold", lambda s, d: fx.bid(s, d).groupBy("bidder").agg(F.sum("price").alias("total"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("extra")), "").alias("statuses")), fx.sql("SELECT bidder, CAST(sum(price) AS BIGINT) AS total, count(*) AS n, list_aggregate(list_sort(list_distinct(list(extra))), 'string_agg', '') AS statuses FROM bid GROUP BY bidder", "bid"))
add("op_global_fold", lambda s, d: fx.bid(s, d).agg(F.max(F.struct("price", "auction", "bidder")).alias("b")).select("b.*"), fx.sql("SELECT price, auction, bidder FROM bid ORDER BY price DESC, auction DESC, bidder DESC LIMIT 1", "bid"))

add("op_interval_join", lambda s, d: win.within(fx.signup(s, d).select("id", "name", F.col("dateTime").alias("joined")), fx.listing(s, d).select(F.col("seller").alias("id"), "reserve", F.col("dateTime").alias("sold")), ["id"], "joined", "sold", "1 day").select("id", "joined", "sold", "reserve"), fx.sql("SELECT p.id, p.dateTime AS joined, a.dateTime AS sold, a.reserve FROM signup p JOIN listing a ON p.id = a.seller AND a.dateTime < p.dateTime + INTERVAL '1 day'", "signup", "listing"))
add("op_with_previous", lambda s, d: custom.with_previous(fx.table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type", F.lit("")), "SELECT user_id, event_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS previous FROM events")
add("op_ordered_fold", lambda s, d: custom.fold(fx.edges(s, d), ["src"], F.col("dst"), F.lit(0).cast("long"), lambda acc, x: (acc * 31 + x) % 1_000_003), fx.sql("SELECT src, list_reduce(list_prepend(0::BIGINT, list_sort(list(dst))), lambda acc, x: (acc * 31 + x) % 1000003) AS value FROM edges GROUP BY src", "edges"))
add("op_lookup", lambda s, d: custom.lookup(fx.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), fx.table(s, d, "nation"), ["n_nationkey"]).select("c_custkey", "n_name"), "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
add("op_group_reduce", lambda s, d: custom.group_reduce(fx.edges(s, d), ["src"], lambda g: g.nsmallest(2, "dst"), "src bigint, dst bigint"), fx.sql("SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 2", "edges"))
add("op_cogroup", lambda s, d: custom.cogroup(fx.edges(s, d), fx.edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src"], lambda a, b: a[~a["dst"].isin(b["dst"])], "src bigint, dst bigint"), fx.sql("SELECT src, dst FROM edges EXCEPT SELECT dst, src FROM edges", "edges"))
add("op_flat_map", lambda s, d: custom.flat_map(fx.table(s, d, "nation").select("n_nationkey", "n_name"), lambda b: b.assign(part=b["n_name"].str.split(" ")).explode("part")[["n_nationkey", "part"]], "n_nationkey int, part string"), "SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS part FROM nation")
add("random_edges", lambda s, d: wl.pagerank_integer(s.range(200).toDF("id"), graphs.random_edges(s, 2000, 200), 3))

# Reports on runs, over stand-ins: segments as systems, ship years as sizes.


def _runs(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "lineitem").select(F.col("l_returnflag").alias("system"), F.year("l_shipdate").cast("long").alias("cores"), F.col("l_quantity").cast("long").alias("seconds"))


_RUNS = "runs AS (SELECT l_returnflag AS system, CAST(year(l_shipdate) AS BIGINT) AS cores, CAST(l_quantity AS BIGINT) AS seconds FROM lineitem)"
add("report_spread", lambda s, d: wl.spread(_runs(s, d), ["system", "cores"], "seconds").withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)}), fx.sql("SELECT system, cores, round(avg(seconds), 6) AS mean, (max(seconds) - min(seconds)) / 2::DOUBLE AS half_range, round(stddev_samp(seconds), 6) AS stdev, count(*) AS runs FROM runs GROUP BY ALL", more=_RUNS))
add("report_speedup", lambda s, d: wl.speedup(_runs(s, d).groupBy("system", "cores").agg(F.sum("seconds").alias("total")), ["system"], "cores", "total").select("system", "cores", F.round("speedup", 9).alias("speedup")), fx.sql("SELECT system, cores, round(first_value(total) OVER (PARTITION BY system ORDER BY cores)::DOUBLE / total, 9) AS speedup FROM (SELECT system, cores, CAST(sum(seconds) AS BIGINT) AS total FROM runs GROUP BY ALL)", more=_RUNS))
add("report_layout", lambda s, d: wl.layout(_runs(s, d), "cores", "system", ["A", "N", "R"], "seconds"), fx.sql('SELECT cores, CAST(sum(seconds) FILTER (system = \'A\') AS BIGINT) AS "A", CAST(sum(seconds) FILTER (system = \'N\') AS BIGINT) AS "N", CAST(sum(seconds) FILTER (system = \'R\') AS BIGINT) AS "R" FROM runs GROUP BY cores', more=_RUNS))
add("report_latency", lambda s, d: wl.latency(fx.table(s, d, "events").withColumn("v", F.round(F.col("value") * 100).cast("long")), "ts", "v", 86400).select("bucket", F.round("mean", 6).alias("mean"), "least", "greatest", F.round("variance", 3).alias("variance"), F.round("stdev", 6).alias("stdev")), "SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS bucket, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS greatest, round(var_samp(v), 3) AS variance, round(stddev_samp(v), 6) AS stdev FROM (SELECT ts, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY 1")
add("report_code_size", lambda s, d: wl.code_size(fx.table(s, d, "part").select(F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("path"), F.col("p_partkey").alias("lines")), "path", "lines"), "SELECT split_part(p, '/', 1) AS \"group\", split_part(p, '/', 2) AS workload, split_part(p, '/', 3) AS system, CAST(sum(p_partkey) AS BIGINT) AS code FROM (SELECT p_brand || '/' || p_type || '/' || p_size AS p, p_partkey FROM part) GROUP BY ALL")
