"""Operator 1: URL filters as a temporal list join (DataFrame operations only).

List entries are dated: (key, action, day, reason), action `block`, `allow` or `lift`. A key is a host, a parent
domain of a host (at least two labels), or host/first-path-segment. The entries of a key become validity
intervals [day, next day of that key); `lift` ends what was in force. A capture is judged by the entry that was
in force at its fetch day for the most specific of its keys, longest first: an as-of join.

Captures shrink to distinct (host, segment, day) and then to distinct (key, day) before they meet the list, so a host or parent domain with a third of all
captures adds one row for each of its days; verdicts then join back. The list side has
one interval in force for a key and day, so no join multiplies rows.

Defined results: a null or unparsable url, or a null day, matches nothing (blocked false, state `none`).
Entries of one key on the same day: the last in the order lift < block < allow holds, reasons by order.
Entries with a null key, action or day are ignored. Repeated captures repeat in the result. Host and segment
compare in lower case. Very long urls are read whole. An empty list blocks nothing; an empty table gives an empty table. Columns of captures other than those named are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """key, state, reason, valid_from, valid_to (null: still in force); no two intervals of a key overlap."""
    rank = F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1).otherwise(0)
    own = entries.where("key is not null and action is not null and day is not null")
    one = own.groupBy(F.lower("key").alias("key"), "day").agg(F.max(F.struct(rank.alias("rank"), "action", "reason")).alias("last"))
    following = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return (
        one.select("key", F.col("last.action").alias("state"), F.col("last.reason").alias("reason"), F.col("day").alias("valid_from"), following.alias("valid_to"))
        .where("state in ('block', 'allow')")
    )


def candidate_keys(host: Column, segment: Column) -> Column:
    """Host, host/segment, and each parent domain of two labels or more."""
    labels = F.split(host, r"\.")
    parents = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    with_segment = F.when(segment != "", F.array(F.concat_ws("/", host, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(with_segment, F.array(host), parents)).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, day) -> page_id, url, day, host, matched_key, state, reason, blocked."""
    low = F.lower(F.coalesce(F.col("url"), F.lit("")))
    own = captures.select("page_id", "url", "day").withColumns({"host": F.regexp_extract(low, HOST, 1), "segment": F.regexp_extract(low, SEGMENT, 1)})
    distinct = own.where("day is not null and host <> ''").select("host", "segment", "day").distinct()
    asked = distinct.select("host", "segment", "day", F.explode(candidate_keys(F.col("host"), F.col("segment"))).alias("key"))
    # Of a popular domain each day is asked once, so its intervals meet as many rows as there are days.
    in_force = asked.select("key", "day").distinct().join(intervals(entries), "key").where("valid_from <= day and (valid_to is null or day < valid_to)").select("key", "day", "state", "reason")
    hit = asked.join(in_force, ["key", "day"])
    best = hit.groupBy("host", "segment", "day").agg(F.max(F.struct(F.length("key").alias("n"), "key", "state", "reason")).alias("best"))
    joined = own.join(best, ["host", "segment", "day"], "left")
    return joined.select("page_id", "url", "day", "host", F.col("best.key").alias("matched_key"), F.coalesce("best.state", F.lit("none")).alias("state"), F.col("best.reason").alias("reason"), F.coalesce(F.col("best.state") == "block", F.lit(False)).alias("blocked"))


# ---- the registered query: list and fetch days are derived from the table by rule, as the tables hold neither ----

#: Days a capture may have: page ids are spread over a year.
DAYS = 365


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", ((F.col("page_id") * 37 + 11) % DAYS).cast("int").alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages: digits of the md5 of a key say whether and when it is blocked, lifted, blocked again or allowed."""
    host = F.regexp_extract(F.lower("url"), HOST, 1)
    hosts = pages.select(host.alias("host"), F.regexp_extract(F.lower("url"), SEGMENT, 1).alias("segment")).where("host <> ''").distinct()
    keys = hosts.select(F.explode(candidate_keys(F.col("host"), F.col("segment"))).alias("key")).distinct()

    def digit(i: int) -> Column:
        return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("key"), i, 1)) - 1

    first = digit(2) * 16 + digit(3)
    second = first + digit(4) * 4 + 1
    third = second + digit(5) * 4 + 1
    rows = F.array(
        F.when(digit(1) < 6, F.struct(F.lit("block").alias("action"), first.alias("day"), F.lit("spam").alias("reason"))),
        F.when((digit(1) < 6) & (digit(6) < 8), F.struct(F.lit("lift").alias("action"), second.alias("day"), F.lit("appeal").alias("reason"))),
        F.when((digit(1) < 6) & (digit(7) < 8), F.struct(F.lit("block").alias("action"), third.alias("day"), F.lit("malware").alias("reason"))),
        F.when(digit(1) == 15, F.struct(F.lit("allow").alias("action"), first.alias("day"), F.lit("trusted").alias("reason"))),
    )
    return keys.select("key", F.inline(F.array_compact(rows)))


ORACLE = r"""
with own as (
  select page_id, url, cast((page_id * 37 + 11) % 365 as int) as day,
         regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) as host,
         regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) as segment
  from pages),
asked as (
  select distinct host, segment, unnest(list_concat(
      case when segment <> '' then [host || '/' || segment] else [] end,
      [host],
      [array_to_string(string_split(host, '.')[i:], '.') for i in range(2, len(string_split(host, '.')))])) as key
  from own where host <> ''),
keys as (select distinct key, md5(key) as m from asked),
digits as (
  select key, strpos('0123456789abcdef', m[1]) - 1 as d1, strpos('0123456789abcdef', m[2]) - 1 as d2, strpos('0123456789abcdef', m[3]) - 1 as d3,
         strpos('0123456789abcdef', m[4]) - 1 as d4, strpos('0123456789abcdef', m[5]) - 1 as d5, strpos('0123456789abcdef', m[6]) - 1 as d6, strpos('0123456789abcdef', m[7]) - 1 as d7
  from keys),
entries as (
  select key, 'block' as action, d2 * 16 + d3 as day, 'spam' as reason from digits where d1 < 6
  union all select key, 'lift', d2 * 16 + d3 + d4 * 4 + 1, 'appeal' from digits where d1 < 6 and d6 < 8
  union all select key, 'block', d2 * 16 + d3 + d4 * 4 + 1 + d5 * 4 + 1, 'malware' from digits where d1 < 6 and d7 < 8
  union all select key, 'allow', d2 * 16 + d3, 'trusted' from digits where d1 = 15),
hit as (
  select o.page_id, o.url, o.day, o.host, o.segment, a.key,
         (select e.action || ':' || e.reason from entries e where e.key = a.key and e.day <= o.day order by e.day desc limit 1) as last
  from (select distinct page_id, url, day, host, segment from own) o join asked a on a.host = o.host and a.segment = o.segment),
best as (
  select page_id, url, arg_max(key, length(key)) as matched_key, arg_max(last, length(key)) as last
  from hit where last is not null and last not like 'lift:%' group by page_id, url)
select o.page_id, o.url, o.day, o.host, b.matched_key, coalesce(split_part(b.last, ':', 1), 'none') as state,
       split_part(b.last, ':', 2) as reason, coalesce(b.last like 'block:%', false) as blocked
from own o left join best b on b.page_id is not distinct from o.page_id and b.url is not distinct from o.url
"""
