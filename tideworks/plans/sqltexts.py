"""The auction queries as SQL text over views, which stand in braces; $name is a setting of the query."""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame, SparkSession

_FINAL = "final AS (SELECT a.id, a.seller, a.category, a.expires, max(b.price) AS final FROM {auction} a, {bid} b WHERE a.id = b.auction AND b.dateTime BETWEEN a.dateTime AND a.expires GROUP BY a.id, a.seller, a.category, a.expires)"

TEXTS = {
    "q0": "SELECT auction, bidder, price, dateTime, extra FROM {bid}",
    "q1": "SELECT auction, bidder, CAST($rate * price AS DOUBLE) AS price, dateTime, extra FROM {bid}",
    "q2": "SELECT auction, price FROM {bid} WHERE auction % $divisor = 0",
    "q3": "SELECT p.name, p.city, p.state, a.id FROM {auction} a JOIN {person} p ON a.seller = p.id WHERE a.category = $category AND upper(p.state) IN ($states)",
    "q4": f"WITH {_FINAL} SELECT category, avg(final) AS avg_price FROM final GROUP BY category",
    "q5": "WITH counted AS (SELECT window(dateTime, '$size', '$slide') AS w, auction, count(*) AS num FROM {bid} GROUP BY window(dateTime, '$size', '$slide'), auction), most AS (SELECT w, max(num) AS num FROM counted GROUP BY w) SELECT w.start AS window_start, auction, num FROM counted JOIN most USING (w, num)",
    "q6": f"WITH {_FINAL} SELECT id, seller, avg(final) OVER (PARTITION BY seller ORDER BY expires, id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS avg_price FROM final",
    "q7": "WITH cut AS (SELECT window(dateTime, '$size') AS w, auction, price, bidder FROM {bid}), best AS (SELECT w, max(price) AS price FROM cut GROUP BY w) SELECT w.start AS window_start, auction, price, bidder FROM cut JOIN best USING (w, price)",
    "q8": "SELECT p.id, p.name, p.starttime FROM (SELECT id, name, window(dateTime, '$size').start AS starttime FROM {person} GROUP BY id, name, window(dateTime, '$size')) p JOIN (SELECT seller, window(dateTime, '$size').start AS starttime FROM {auction} GROUP BY seller, window(dateTime, '$size')) a ON p.id = a.seller AND p.starttime = a.starttime",
}
SETTINGS = {"rate": "0.908", "divisor": "123", "category": "10", "states": "'OR', 'ID', 'CA'", "size": "10 seconds", "slide": "2 seconds"}


def run(spark: SparkSession, name: str, views: dict[str, DataFrame] | None = None, **settings: str) -> DataFrame:
    """The query by its name; without views given, over the session's views person, auction and bid (see register_views)."""
    text = Template(TEXTS[name]).substitute(SETTINGS | settings)
    views = views or {v: spark.table(v) for v in ("person", "auction", "bid") if f"{{{v}}}" in text}
    return spark.sql(text, **{v: df for v, df in views.items() if f"{{{v}}}" in text})
