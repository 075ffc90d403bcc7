"""URL filters against dated lists: validity intervals and an as-of join. DataFrame functions only.

A list is a history of entries (kind, key, listed_on, action, list_name): kind 'prefix' (host and first path segment), 'host' or 'domain' (the last
three or two labels of a host), action 'add' or 'remove'. Each entry holds until the next one of its key on its list. validity() merges the lists of every
(kind, key) into disjoint intervals [valid_from, valid_to) in which the key is on the same lists, with the names of all of them; list_name and listed_since are those of the
latest 'add' among them. screen() joins every capture with the intervals that hold on its day of
fetching, one equality join per kind, so each join finds at most one interval, no capture is multiplied, and none is grouped; a host with much of the captures
only makes a large probe side, which Spark broadcasts against or splits. The most specific listing wins: prefix, host, three labels, two labels.

Defined cases: a null or malformed url, or a null day, is on no list; entries with a null kind, key or day are ignored; of entries of one key of one list on one day the last
by action holds, so 'remove' beats 'add' of the same list only; entries with a null list_name are a list of their own, without a name in list_names; of lists added on one day list_name is the last by name; an interval holds on its first day and not on its last; repeated rows come back one by one; other columns of the captures pass through
(result columns of the same name are replaced); empty tables give empty results or no listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("prefix", "host", "domain3", "domain2")
RESULT = ("blocked", "matched_kind", "matched_key", "list_name", "listed_since", "list_names")


START = r"^[A-Za-z]+://(?:[^/?#]*@)?"


def host_of(url: Column) -> Column:
    """The host behind a user's name and password, if there are any."""
    return F.lower(F.regexp_extract(url, START + r"([^/?#:@]+)", 1))


def keys_of(url: Column) -> dict[str, Column]:
    """The key that each kind looks up; null where a url has none."""
    host = host_of(url)
    filled = lambda c: F.when(c != "", c)
    segment = F.regexp_extract(url, START + r"[^/?#:@]+(?::[0-9]*)?(/[^/?#]+)", 1)
    return {
        "prefix": F.when(segment != "", F.concat(host, segment)),
        "host": filled(host),
        "domain3": filled(F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)),
        "domain2": filled(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)),
    }


def validity(entries: DataFrame) -> DataFrame:
    """(kind, key, valid_from, valid_to, list_name, listed_since, list_names); valid_to is null while nothing changes any more."""
    known = entries.filter("kind IS NOT NULL AND key IS NOT NULL AND listed_on IS NOT NULL")
    daily = known.groupBy("kind", "key", "list_name", F.col("listed_on").alias("day")).agg(F.max("action").alias("action"))
    of_key = Window.partitionBy("kind", "key")
    of_list = Window.partitionBy("kind", "key", "list_name").orderBy("day")
    # the days on which a key changes are numbered; an entry holds over the numbers up to the next entry of its list
    numbered = daily.withColumn("step", F.dense_rank().over(of_key.orderBy("day")))
    numbered = numbered.withColumns({"days": F.sort_array(F.collect_set("day").over(of_key)), "until": F.lead("step").over(of_list)})
    steps = F.sequence("step", F.coalesce(F.col("until") - 1, F.size("days")))
    held = numbered.filter("action = 'add'").select("kind", "key", "list_name", "day", "days", F.explode(steps).alias("step"))
    merged = held.groupBy("kind", "key", "step").agg(
        F.first("days").alias("days"), F.max(F.struct("day", "list_name")).alias("last"), F.sort_array(F.collect_set("list_name")).alias("list_names"))
    return merged.select(
        "kind", "key", F.get("days", F.col("step") - 1).alias("valid_from"), F.get("days", F.col("step")).alias("valid_to"),
        F.col("last.list_name").alias("list_name"), F.col("last.day").alias("listed_since"), "list_names")


def screen(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_on: str = "fetched_on") -> DataFrame:
    """The captures with blocked, matched_kind, matched_key, list_name, listed_since and list_names, all lists that the key is on."""
    intervals = validity(entries)
    kept = [c for c in captures.columns if c not in RESULT]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{fetched_on}`").alias("day"), *[
        c.alias(f"key_{kind}") for kind, c in keys_of(F.col(f"`{url}`")).items()])
    for kind in KINDS:
        own = intervals.filter(F.col("kind") == kind).select(
            F.col("key").alias("k"), F.col("valid_from").alias("f"), F.col("valid_to").alias("t"),
            F.struct(F.lit(kind).alias("kind"), "key", "list_name", "listed_since", "list_names").alias(f"hit_{kind}"))
        holds = (F.col("f") <= F.col("day")) & (F.col("t").isNull() | (F.col("day") < F.col("t")))
        rows = rows.join(own, (F.col(f"key_{kind}") == F.col("k")) & holds, "left").drop("k", "f", "t")
    hit = F.coalesce(*[F.col(f"hit_{kind}") for kind in KINDS])
    return rows.withColumn("hit", hit).select(
        *[F.col("row")[c].alias(c) for c in kept], F.col("hit").isNotNull().alias("blocked"), F.col("hit.kind").alias("matched_kind"),
        F.col("hit.key").alias("matched_key"), F.col("hit.list_name").alias("list_name"), F.col("hit.listed_since").alias("listed_since"),
        F.col("hit.list_names").alias("list_names"))


#: A dated list derived from the pages, for the query and its second engine: keys of their urls are listed, taken off and listed again. {day} gives the date of a number of days.
HISTORY_SQL = """
WITH named AS (SELECT kind, key, min(page_id) AS first_id FROM {keys} WHERE key IS NOT NULL GROUP BY kind, key)
SELECT kind, key, CASE WHEN first_id % 3 = 0 THEN 'ads' WHEN first_id % 3 = 1 THEN 'adult' ELSE 'malware' END AS list_name,
 {day} AS listed_on, CASE WHEN step % 2 = 0 THEN 'add' ELSE 'remove' END AS action
FROM (SELECT kind, key, step, first_id, first_id % 300 + step * (40 + first_id % 90) AS days
 FROM (SELECT kind, key, first_id, 0 AS step FROM named UNION ALL SELECT kind, key, first_id, 1 AS step FROM named WHERE first_id % 4 >= 1
  UNION ALL SELECT kind, key, first_id, 2 AS step FROM named WHERE first_id % 4 >= 2) steps) dated
WHERE (kind = 'domain2' AND first_id % 7 = 1) OR (kind = 'domain3' AND first_id % 5 = 2) OR (kind = 'host' AND first_id % 3 = 0)
 OR (kind = 'prefix' AND first_id % 11 = 4)
"""
DAY = "date_add(DATE '2023-01-01', CAST({days} AS INT))"


def derived(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captures, entries) from a table of pages: every list key is taken from a page's url, the days follow from page_id."""
    captures = pages.select("page_id", "url", F.expr(DAY.format(days="page_id * 37 % 1000")).alias("fetched_on"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys_of(F.col("url")).items()])
    keys = pages.select("page_id", F.inline(kinds))
    return captures, pages.sparkSession.sql(HISTORY_SQL.replace("{day}", DAY.format(days="days")), keys=keys)


#: The same over tables registered by name, from first principles: a window over the history of every key, then the first kind that holds.
ORACLE_SQL = """
WITH hosts AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:@]+)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#:@]+(?::[0-9]*)?(/[^/?#]+)', 1) AS segment, CAST(DATE '2023-01-01' + CAST(page_id * 37 % 1000 AS INT) AS DATE) AS fetched_on FROM pages),
keyed AS (SELECT page_id, url, fetched_on, CASE WHEN segment <> '' THEN concat(host, segment) END AS prefix, CASE WHEN host <> '' THEN host END AS host,
  CASE WHEN regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) <> '' THEN regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) END AS domain3,
  CASE WHEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) <> '' THEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) END AS domain2 FROM hosts),
keys AS (SELECT page_id, 'prefix' AS kind, prefix AS key FROM keyed UNION ALL SELECT page_id, 'host' AS kind, host AS key FROM keyed
  UNION ALL SELECT page_id, 'domain3' AS kind, domain3 AS key FROM keyed UNION ALL SELECT page_id, 'domain2' AS kind, domain2 AS key FROM keyed),
entries AS (""" + HISTORY_SQL.replace("{day}", "CAST(DATE '2023-01-01' + CAST(days AS INT) AS DATE)").replace("{keys}", "keys") + """),
daily AS (SELECT kind, key, listed_on, action, list_name, row_number() OVER (PARTITION BY kind, key, listed_on ORDER BY action DESC, list_name DESC) AS place FROM entries),
history AS (SELECT kind, key, listed_on, action, list_name, lead(listed_on) OVER (PARTITION BY kind, key ORDER BY listed_on) AS until FROM daily WHERE place = 1),
listed AS (SELECT kind, key, list_name, listed_on, until FROM history WHERE action = 'add'),
hits AS (SELECT k.page_id, l.kind, l.key, l.list_name, l.listed_on, row_number() OVER (PARTITION BY k.page_id ORDER BY
  CASE l.kind WHEN 'prefix' THEN 1 WHEN 'host' THEN 2 WHEN 'domain3' THEN 3 ELSE 4 END) AS place
  FROM keys k JOIN keyed d ON d.page_id = k.page_id JOIN listed l ON l.kind = k.kind AND l.key = k.key AND l.listed_on <= d.fetched_on AND (l.until IS NULL OR d.fetched_on < l.until))
SELECT d.page_id, d.url, CAST(d.fetched_on AS VARCHAR) AS fetched_on, h.kind IS NOT NULL AS blocked, h.kind AS matched_kind, h.key AS matched_key, h.list_name, CAST(h.listed_on AS VARCHAR) AS listed_since
FROM keyed d LEFT JOIN hits h ON h.page_id = d.page_id AND h.place = 1
"""
