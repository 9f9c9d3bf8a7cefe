"""The registered queries: pipelines over the given tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import udfs
from tessera.operators import updates
from tessera.plans.registry import QUERIES, R2, SQL, expression, flat, matching, pipeline, query
from tessera.streaming import changes

# grouping
PRICING = [
    {"$match": {"l_shipdate": {"$lte": datetime(1998, 9, 2)}}},
    {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "base": {"$sum": "$l_extendedprice"}, "disc": {"$sum": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}, "avg_qty": {"$avg": "$l_quantity"}, "n": {"$count": {}}}},
    {"$sort": {"_id.flag": 1, "_id.status": 1}},
    {"$project": {"_id": 0, "l_returnflag": "$_id.flag", "l_linestatus": "$_id.status", "sum_qty": R2("$qty"), "sum_base": R2("$base"), "sum_disc": R2("$disc"), "avg_qty": R2("$avg_qty", 6), "n": 1}},
]
pipeline("pricing_summary", "lineitem", PRICING, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, CAST(count(*) AS INTEGER) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY 1, 2")
pipeline("group_minmax", "orders", [{"$group": {"_id": "$o_orderpriority", "lo": {"$min": "$o_totalprice"}, "hi": {"$max": "$o_totalprice"}, "n": {"$sum": 1}, "avg": {"$avg": "$o_totalprice"}}}, {"$set": {"avg": R2("$avg", 4)}}], "SELECT o_orderpriority AS _id, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, round(avg(o_totalprice), 4) AS avg FROM orders GROUP BY 1")
pipeline("group_stddev", "orders", [{"$group": {"_id": "$o_orderstatus", "p": {"$stdDevPop": "$o_totalprice"}, "s": {"$stdDevSamp": "$o_totalprice"}}}, {"$set": {"p": R2("$p", 3), "s": R2("$s", 3)}}], "SELECT o_orderstatus AS _id, round(stddev_pop(o_totalprice), 3) AS p, round(stddev_samp(o_totalprice), 3) AS s FROM orders GROUP BY 1")
pipeline("group_first_last", "events", [{"$sort": {"ts": 1}}, {"$group": {"_id": "$user_id", "first": {"$first": "$event_id"}, "last": {"$last": "$event_id"}}}], "SELECT user_id AS _id, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY 1")
pipeline("group_push_addtoset", "events", [{"$sort": {"ts": -1}}, {"$group": {"_id": "$user_id", "ids": {"$push": "$event_id"}, "kinds": {"$addToSet": "$event_type"}}}], "SELECT user_id AS _id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, event_id DESC) AS ids, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1", flat(_id="_id", ids="array_join(ids, ',')", kinds="cast(size(kinds) as bigint)"))
TOP = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS a, row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) AS z FROM events)"
pipeline("group_top_bottom_n", "events", [{"$group": {"_id": "$user_id", "top": {"$top": {"sortBy": {"value": -1, "ts": -1}, "output": "$event_id"}}, "bottom": {"$bottom": {"sortBy": {"value": -1, "ts": -1}, "output": "$event_id"}}, "top3": {"$topN": {"n": 3, "sortBy": {"value": -1, "ts": -1}, "output": "$event_id"}}, "bottom2": {"$bottomN": {"n": 2, "sortBy": {"value": -1, "ts": -1}, "output": "$event_id"}}}}], f"SELECT user_id AS _id, max(event_id) FILTER (WHERE a = 1) AS top, max(event_id) FILTER (WHERE z = 1) AS bottom, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY a) FILTER (WHERE a <= 3) AS top3, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY a) FILTER (WHERE z <= 2) AS bottom2 FROM {TOP} GROUP BY 1", flat(_id="_id", top="top", bottom="bottom", top3="array_join(top3, ',')", bottom2="array_join(bottom2, ',')"))
pipeline("group_first_last_n", "events", [{"$sort": {"ts": 1}}, {"$group": {"_id": "$event_type", "first3": {"$firstN": {"n": 3, "input": "$event_id"}}, "last2": {"$lastN": {"n": 2, "input": "$event_id"}}}}], "SELECT event_type AS _id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (WHERE a <= 3) AS first3, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (WHERE z <= 2) AS last2 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS z FROM events) GROUP BY 1", flat(_id="_id", first3="array_join(first3, ',')", last2="array_join(last2, ',')"))
pipeline("group_max_min_n", "orders", [{"$group": {"_id": "$o_custkey", "hi": {"$maxN": {"n": 2, "input": "$o_orderkey"}}, "lo": {"$minN": {"n": 2, "input": "$o_orderkey"}}}}], "SELECT o_custkey AS _id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) FILTER (WHERE z <= 2) AS hi, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE a <= 2) AS lo FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS z FROM orders) GROUP BY 1", flat(_id="_id", hi="array_join(hi, ',')", lo="array_join(lo, ',')"))
pipeline("group_merge_objects", "events", [{"$sort": {"ts": 1}}, {"$group": {"_id": "$user_id", "m": {"$mergeObjects": {"$let": {"vars": {}, "in": "$$ROOT"}}}}}], "SELECT user_id AS _id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY 1", flat(_id="_id", event_type="m.event_type", value="m.value"))
pipeline("group_null_id", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}}, {"$project": {"_id": 0, "n": 1, "total": R2("$total")}}], "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
pipeline("bucket", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 25, 40], "default": 99, "output": {"n": {"$sum": 1}, "avg": {"$avg": "$p_retailprice"}}}}, {"$set": {"avg": R2("$avg", 4)}}], "SELECT CAST(CASE WHEN p_size >= 0 AND p_size < 10 THEN 0 WHEN p_size >= 10 AND p_size < 25 THEN 10 WHEN p_size >= 25 AND p_size < 40 THEN 25 ELSE 99 END AS INTEGER) AS _id, count(*) AS n, round(avg(p_retailprice), 4) AS avg FROM part GROUP BY 1")
pipeline("bucket_auto", "orders", [{"$bucketAuto": {"groupBy": "$o_totalprice", "buckets": 7}}], "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS n, count(*) OVER () AS c FROM orders), b AS (SELECT (n - 1) // CAST(ceil(c / 7.0) AS BIGINT) AS b, min(v) AS lo, max(v) AS last, count(*) AS count FROM r GROUP BY 1) SELECT lo AS min, coalesce(lead(lo) OVER (ORDER BY b), last) AS max, CAST(count AS INTEGER) AS count FROM b", flat(min="_id.min", max="_id.max", count="count"))
pipeline("sort_by_count", "part", [{"$sortByCount": "$p_brand"}], "SELECT p_brand AS _id, CAST(count(*) AS INTEGER) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
pipeline("count_stage", "orders", [{"$match": {"o_totalprice": {"$gt": 200000}}}, {"$count": "n"}], "SELECT CAST(count(*) AS INTEGER) AS n FROM orders WHERE o_totalprice > 200000")


@query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0 AND c_mktsegment IS NOT NULL")
def distinct_field(db):
    return db["customer"].distinct("c_mktsegment", {"c_acctbal": {"$gt": 0}})


# filters
matching("match_compare", "lineitem", "l_orderkey", {"l_quantity": {"$gte": 45}, "l_discount": {"$lt": 0.03}, "l_returnflag": {"$ne": "N"}}, "l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'N'")
matching("match_logical", "orders", "o_orderkey", {"$or": [{"o_orderstatus": "F", "o_totalprice": {"$lt": 50000}}, {"$nor": [{"o_totalprice": {"$lt": 300000}}, {"o_orderpriority": "1-URGENT"}]}]}, "(o_orderstatus = 'F' AND o_totalprice < 50000) OR NOT (o_totalprice < 300000 OR o_orderpriority = '1-URGENT')")
matching("match_in_nin", "part", "p_partkey", {"p_size": {"$in": [1, 5, 9, 13]}, "p_brand": {"$nin": ["Brand#11", "Brand#12"]}}, "p_size IN (1, 5, 9, 13) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
NULLED = [{"$set": {"v": {"$cond": [{"$gt": ["$value", 50]}, "$value", None]}}}]
matching("match_null_exists", "events", "event_id", {"$or": [{"v": None, "event_type": {"$exists": True}}, {"v": {"$exists": True, "$not": {"$lt": 90}}}], "nothing": {"$exists": False}}, "(v IS NULL) OR NOT (v < 90)", NULLED, "(SELECT *, CASE WHEN value > 50 THEN value END AS v FROM events)")
matching("match_regex", "part", "p_partkey", {"p_name": {"$regex": "^[A-M].*L", "$options": "i"}}, "regexp_matches(p_name, '(?i)^[A-M].*L')")
matching("match_mod", "orders", "o_orderkey", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3")
matching("match_bits", "customer", "c_custkey", {"c_custkey": {"$bitsAllSet": [0, 2], "$bitsAnyClear": 10}}, "(c_custkey & 5) = 5 AND (c_custkey & 10) <> 10")
matching("match_expr", "lineitem", "l_orderkey", {"$expr": {"$gt": [{"$multiply": ["$l_quantity", 2000]}, "$l_extendedprice"]}}, "l_quantity * 2000 > l_extendedprice")
matching("match_type_size", "embeddings", "vec_id", {"embedding": {"$type": "array", "$size": 64}, "label": {"$type": "number"}}, "len(embedding) = 64 AND label IS NOT NULL")
BASKETS = [{"$group": {"_id": "$l_orderkey", "parts": {"$push": "$l_partkey"}, "lines": {"$push": {"$let": {"vars": {}, "in": {"$mergeObjects": ["$$ROOT"]}}}}}}]
pipeline("match_array_ops", "lineitem", [*BASKETS, {"$match": {"parts": {"$elemMatch": {"$gte": 100, "$lt": 120}}, "lines": {"$elemMatch": {"l_quantity": {"$gt": 30}, "l_returnflag": "R"}}}}, {"$project": {"_id": 1}}], "SELECT l_orderkey AS _id FROM lineitem GROUP BY 1 HAVING bool_or(l_partkey >= 100 AND l_partkey < 120) AND bool_or(l_quantity > 30 AND l_returnflag = 'R')")
matching("json_schema_filter", "events", "event_id", {"$jsonSchema": {"required": ["user_id", "event_type"], "properties": {"value": {"bsonType": "double", "minimum": 10, "maximum": 60}, "event_type": {"bsonType": "string", "minLength": 4, "pattern": "c"}}}}, "user_id IS NOT NULL AND event_type IS NOT NULL AND value BETWEEN 10 AND 60 AND length(event_type) >= 4 AND regexp_matches(event_type, 'c')")

# projection
pipeline("project_include", "orders", [{"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "SELECT o_orderkey, o_totalprice FROM orders")
pipeline("project_exclude", "part", [{"$project": {"p_name": 0, "p_type": 0}}], "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
pipeline("project_computed", "orders", [{"$project": {"o_orderkey": 1, "band": {"$switch": {"branches": [{"case": {"$lt": ["$o_totalprice", 100000]}, "then": "low"}, {"case": {"$lt": ["$o_totalprice", 250000]}, "then": "mid"}], "default": "high"}}}}], "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'mid' ELSE 'high' END AS band FROM orders")
pipeline("add_fields_unset", "customer", [{"$addFields": {"a.b": "$c_acctbal", "a.c": {"$toUpper": "$c_name"}}}, {"$unset": ["c_name", "c_acctbal"]}], "SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal AS b, upper(c_name) AS c FROM customer", flat(c_custkey="c_custkey", c_nationkey="c_nationkey", c_mktsegment="c_mktsegment", b="a.b", c="a.c"))
pipeline("replace_root", "nation", [{"$replaceRoot": {"newRoot": {"name": "$n_name", "key": "$n_nationkey"}}}], "SELECT n_name AS name, n_nationkey AS key FROM nation")
pipeline("unwind", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}}, {"$group": {"_id": "$i", "n": {"$sum": 1}, "hi": {"$max": "$embedding"}}}], "SELECT i AS _id, count(*) AS n, max(e) AS hi FROM (SELECT unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings) GROUP BY 1")
pipeline("unwind_preserve", "conversations", [{"$group": {"_id": "$conv_id", "long": {"$push": {"$cond": [{"$gt": ["$turn", 2]}, "$turn", None]}}}}, {"$set": {"long": {"$filter": {"input": "$long", "as": "x", "cond": {"$ne": ["$$x", None]}}}}}, {"$unwind": {"path": "$long", "preserveNullAndEmptyArrays": True}}], "SELECT conv_id AS _id, turn AS long FROM conversations WHERE turn > 2 UNION ALL SELECT conv_id, NULL FROM conversations GROUP BY 1 HAVING max(turn) <= 2")
pipeline("redact", "orders", [{"$set": {"detail": {"$mergeObjects": [{"$let": {"vars": {}, "in": "$$ROOT"}}]}}}, {"$redact": {"$cond": [{"$eq": ["$o_orderstatus", "P"]}, "$$PRUNE", {"$cond": [{"$lt": ["$o_totalprice", 100000]}, "$$DESCEND", "$$KEEP"]}]}}, {"$project": {"_id": 0, "o_orderkey": 1, "kept": {"$ne": ["$detail", None]}}}], "SELECT o_orderkey, true AS kept FROM orders WHERE o_orderstatus <> 'P'")
pipeline("sort_skip_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 5}, {"$limit": 20}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")

# windows
EV = "(PARTITION BY user_id ORDER BY ts"


def window(name: str, output: dict, sql: str, before: list[dict] | None = None, source: str = "events", rounded: dict | None = None, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    stages = [*(before or []), {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": output}}, *([{"$set": rounded}] if rounded else [])]
    pipeline(name, "events", [*stages, {"$project": {"_id": 0, "event_id": 1} | dict.fromkeys(output, 1)}], f"SELECT event_id, {sql} FROM {source}", finish)


window("win_running_sum", {"s": {"$sum": "$value", "window": {"documents": ["unbounded", "current"]}}}, f"round(sum(value) OVER {EV} ROWS UNBOUNDED PRECEDING), 4) AS s", rounded={"s": R2("$s", 4)})
window("win_moving_avg", {"a": {"$avg": "$value", "window": {"documents": [-2, 2]}}, "n": {"$count": {}, "window": {"documents": [-2, 2]}}}, f"round(avg(value) OVER {EV} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS a, CAST(count(*) OVER {EV} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS INTEGER) AS n", rounded={"a": R2("$a", 4)})
pipeline("win_rank_dense_rownum", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderpriority": 1}, "output": {"r": {"$rank": {}}, "d": {"$denseRank": {}}}}}, {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderkey": 1}, "output": {"n": {"$documentNumber": {}}}}}, {"$project": {"_id": 0, "o_orderkey": 1, "r": 1, "d": 1, "n": 1}}], "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS d, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS n FROM orders")
window("win_shift", {"p": {"$shift": {"output": "$event_id", "by": -1, "default": -1}}, "q": {"$shift": {"output": "$event_id", "by": 2}}}, f"coalesce(lag(event_id) OVER {EV}), -1) AS p, lead(event_id, 2) OVER {EV}) AS q")
window("win_derivative", {"d": {"$derivative": {"input": "$value"}}}, f"round(value - lag(value) OVER {EV}), 6) AS d", rounded={"d": R2("$d", 6)})
window("win_integral", {"i": {"$integral": {"input": "$value"}, "window": {"documents": ["unbounded", "current"]}}}, f"round(coalesce(sum(a) OVER {EV} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS i", source=f"(SELECT *, (value + lead(value) OVER {EV})) / 2 AS a FROM events)", rounded={"i": R2("$i", 4)})
window("win_cov", {"c": {"$covariancePop": ["$value", "$event_id"]}, "d": {"$covarianceSamp": ["$value", "$event_id"]}}, "round(covar_pop(value, event_id) OVER (PARTITION BY user_id), 2) AS c, round(covar_samp(value, event_id) OVER (PARTITION BY user_id), 2) AS d", rounded={"c": R2("$c"), "d": R2("$d")})
window("win_stddev", {"p": {"$stdDevPop": "$value"}, "s": {"$stdDevSamp": "$value"}}, "round(stddev_pop(value) OVER (PARTITION BY user_id), 6) AS p, round(stddev_samp(value) OVER (PARTITION BY user_id), 6) AS s", rounded={"p": R2("$p", 6), "s": R2("$s", 6)})
NULLED_SQL = "(SELECT *, CASE WHEN value > 50 THEN value END AS v FROM events)"
window("win_locf", {"l": {"$locf": "$v"}}, f"last_value(v IGNORE NULLS) OVER {EV} ROWS UNBOUNDED PRECEDING) AS l", NULLED, NULLED_SQL)
_FILL = f"(SELECT *, last_value(v IGNORE NULLS) OVER {EV} ROWS UNBOUNDED PRECEDING) AS v0, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER {EV} ROWS UNBOUNDED PRECEDING) AS n0, first_value(v IGNORE NULLS) OVER {EV} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER {EV} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n1 FROM (SELECT *, row_number() OVER {EV}) AS n FROM {NULLED_SQL}))"
window("win_linear_fill", {"l": {"$linearFill": "$v"}}, "round(coalesce(v, v0 + (v1 - v0) * (n - n0) / (n1 - n0)), 6) AS l", NULLED, _FILL, rounded={"l": R2("$l", 6)})
window("win_first_last", {"f": {"$first": "$event_id", "window": {"documents": [-3, "current"]}}, "l": {"$last": "$event_id", "window": {"documents": ["current", 3]}}}, f"first_value(event_id) OVER {EV} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f, last_value(event_id) OVER {EV} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l")
window("win_push", {"p": {"$push": "$event_id", "window": {"documents": [-1, 1]}}, "k": {"$addToSet": "$event_type", "window": {"documents": [-1, 1]}}}, f"array_to_string(list(event_id) OVER {EV} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ',') AS p, CAST(len(list_distinct(list(event_type) OVER {EV} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))) AS INTEGER) AS k", finish=flat(event_id="event_id", p="array_join(p, ',')", k="size(k)"))
window("win_range", {"n": {"$count": {}, "window": {"range": [-7, 0], "unit": "day"}}}, f"CAST(count(*) OVER {EV} RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS INTEGER) AS n")
window("win_ema", {"e": {"$expMovingAvg": {"input": "$value", "N": 3}}}, f"list_reduce(list(value) OVER {EV} ROWS UNBOUNDED PRECEDING), lambda a, x: 0.5 * x + 0.5 * a) AS e")

# gaps
DAYS = [{"$group": {"_id": {"u": "$user_id", "d": {"$dateToString": {"date": "$ts", "format": "%Y-%m-%d"}}}, "v": {"$sum": "$value"}}}, {"$project": {"_id": 0, "u": "$_id.u", "d": {"$toInt": {"$dateDiff": {"startDate": {"$toDate": "2020-01-01T00:00:00Z"}, "endDate": {"$toDate": "$_id.d"}, "unit": "day"}}}, "v": R2("$v", 4)}}]
DAYS_SQL = "(SELECT user_id AS u, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INTEGER) AS d, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"
pipeline("densify", "events", [*DAYS, {"$densify": {"field": "d", "partitionByFields": ["u"], "range": {"step": 1, "bounds": "full"}}}], f"WITH k AS (SELECT * FROM {DAYS_SQL}), e AS (SELECT u, min(d) AS lo, max(d) AS hi FROM k GROUP BY u), g AS (SELECT u, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS d FROM e) SELECT g.u, g.d, k.v FROM g LEFT JOIN k USING (u, d)")
HOLES = [*DAYS, {"$set": {"w": {"$cond": [{"$gt": ["$v", 100]}, "$v", None]}}}]
HOLES_SQL = f"(SELECT *, CASE WHEN v > 100 THEN v END AS w FROM {DAYS_SQL})"
pipeline("fill_value", "events", [*HOLES, {"$fill": {"output": {"w": {"value": 0}}}}], f"SELECT u, d, v, coalesce(w, 0) AS w FROM {HOLES_SQL}")
pipeline("fill_locf", "events", [*HOLES, {"$fill": {"partitionByFields": ["u"], "sortBy": {"d": 1}, "output": {"w": {"method": "locf"}}}}], f"SELECT u, d, v, last_value(w IGNORE NULLS) OVER (PARTITION BY u ORDER BY d ROWS UNBOUNDED PRECEDING) AS w FROM {HOLES_SQL}")

# joins
pipeline("lookup_eq", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}, {"$project": {"_id": 0, "c_custkey": 1, "n": {"$size": "$orders"}}}], "SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
pipeline("lookup_unwind_inner", "orders", [{"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$group": {"_id": "$c.c_mktsegment", "total": {"$sum": "$o_totalprice"}, "n": {"$sum": 1}}}, {"$set": {"total": R2("$total")}}], "SELECT c_mktsegment AS _id, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
URGENT = [{"$match": {"o_orderpriority": "1-URGENT", "o_totalprice": {"$gt": 300000}}}, {"$project": {"_id": 0, "o_custkey": 1}}]


def _semi_or_anti(name: str, test: dict, how: str) -> None:
    def run(db):
        db.create("urgent", view_on="orders", pipeline=URGENT)
        return db["customer"].aggregate([{"$lookup": {"from": "urgent", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": test}}, {"$unset": "o"}, {"$project": {"_id": 0, "c_custkey": 1}}])

    run.__name__ = name
    query(f"SELECT c_custkey FROM customer WHERE c_custkey {how} (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")(run)


_semi_or_anti("lookup_semi", {"$ne": []}, "IN")
_semi_or_anti("lookup_anti", {"$eq": []}, "NOT IN")
pipeline("lookup_pipeline_let", "customer", [{"$lookup": {"from": "orders", "let": {"k": "$c_custkey", "least": {"$multiply": ["$c_acctbal", 20]}}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$k"]}, {"$gt": ["$o_totalprice", "$$least"]}]}}}, {"$sort": {"o_totalprice": -1, "o_orderkey": -1}}, {"$limit": 3}, {"$project": {"_id": 0, "o_orderkey": 1, "o_totalprice": 1}}], "as": "best"}}], "SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n <= 3), '') AS best FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 20) GROUP BY 1", flat(c_custkey="c_custkey", best="array_join(best.o_orderkey, ',')"))
pipeline("lookup_array_local", "conversations", [{"$group": {"_id": "$conv_id", "turns": {"$addToSet": "$turn"}}}, {"$lookup": {"from": "nation", "localField": "turns", "foreignField": "n_nationkey", "as": "nations"}}, {"$project": {"_id": 1, "n": {"$size": "$nations"}}}], "SELECT conv_id AS _id, CAST(count(DISTINCT n_nationkey) AS INTEGER) AS n FROM conversations LEFT JOIN nation ON turn = n_nationkey GROUP BY 1")


@query("WITH RECURSIVE p AS (SELECT n_nationkey, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS parent FROM nation), r AS (SELECT n_nationkey AS k, parent, 0 AS d FROM p UNION ALL SELECT r.k, p.parent, d + 1 FROM r JOIN p ON r.parent = p.n_nationkey) SELECT k AS n_nationkey, CAST(count(parent) AS INTEGER) AS above, CAST(max(CASE WHEN parent IS NOT NULL THEN d END) AS BIGINT) AS deepest FROM r GROUP BY 1")
def graph_lookup(db):
    tree = db["nation"].aggregate([{"$project": {"_id": 0, "n_nationkey": 1, "parent": {"$cond": [{"$gt": ["$n_nationkey", 0]}, {"$toInt": {"$floor": {"$divide": ["$n_nationkey", 2]}}}, None]}}}])
    db.register("tree", tree)
    found = db["tree"].aggregate([{"$graphLookup": {"from": "tree", "startWith": "$parent", "connectFromField": "parent", "connectToField": "n_nationkey", "as": "above", "depthField": "d"}}])
    return found.selectExpr("n_nationkey", "size(above) as above", "array_max(above.d) as deepest")


pipeline("union_with", "customer", [{"$project": {"_id": 0, "name": "$c_name", "nation": "$c_nationkey"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$match": {"s_acctbal": {"$gt": 0}}}, {"$project": {"_id": 0, "name": "$s_name", "nation": "$s_nationkey"}}]}}, {"$group": {"_id": "$nation", "n": {"$sum": 1}}}], "SELECT nation AS _id, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
pipeline("facet", "orders", [{"$facet": {"status": [{"$sortByCount": "$o_orderstatus"}], "high": [{"$match": {"o_totalprice": {"$gt": 300000}}}, {"$count": "n"}]}}], "SELECT (SELECT string_agg(o_orderstatus || ':' || c, ',' ORDER BY c DESC, o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1)) AS status, (SELECT CAST(count(*) AS INTEGER) FROM orders WHERE o_totalprice > 300000) AS high", flat(status="array_join(transform(status, x -> concat(x._id, ':', x.count)), ',')", high="high[0].n"))


# expressions
expression("expr_arith", "orders", "o_orderkey", {"a": R2({"$add": ["$o_totalprice", 1.5, "$o_orderkey"]}), "m": {"$mod": ["$o_orderkey", 7]}, "d": R2({"$divide": ["$o_totalprice", 7]}, 6), "f": {"$floor": {"$divide": ["$o_totalprice", 1000]}}, "c": {"$ceil": {"$divide": ["$o_totalprice", 1000]}}, "t": {"$trunc": [{"$subtract": [1000, "$o_totalprice"]}, 0]}, "b": {"$abs": {"$subtract": [1000, "$o_totalprice"]}}}, "round(o_totalprice + 1.5 + o_orderkey, 2) AS a, CAST(o_orderkey % 7 AS DOUBLE) AS m, round(o_totalprice / 7, 6) AS d, floor(o_totalprice / 1000) AS f, ceil(o_totalprice / 1000) AS c, trunc(1000 - o_totalprice) AS t, abs(1000 - o_totalprice) AS b")
expression("expr_trig", "supplier", "s_suppkey", {"s": R2({"$sin": "$s_suppkey"}, 9), "c": R2({"$cos": "$s_suppkey"}, 9), "t": R2({"$atan2": ["$s_suppkey", 3]}, 9), "r": R2({"$degreesToRadians": "$s_suppkey"}, 9), "l": R2({"$ln": "$s_suppkey"}, 9), "g": R2({"$log": ["$s_suppkey", 2]}, 9), "e": R2({"$sqrt": "$s_suppkey"}, 9), "p": {"$pow": ["$s_suppkey", 2]}}, "round(sin(s_suppkey), 9) AS s, round(cos(s_suppkey), 9) AS c, round(atan2(s_suppkey, 3), 9) AS t, round(radians(s_suppkey), 9) AS r, round(CASE WHEN s_suppkey = 0 THEN -1.0/0 ELSE ln(s_suppkey) END, 9) AS l, round(ln(s_suppkey) / ln(2), 9) AS g, round(sqrt(s_suppkey), 9) AS e, pow(s_suppkey, 2) AS p")
expression("expr_string", "part", "p_partkey", {"u": {"$toUpper": "$p_name"}, "n": {"$strLenCP": "$p_name"}, "s": {"$substrCP": ["$p_name", 2, 4]}, "i": {"$indexOfCP": ["$p_name", "a"]}, "r": {"$replaceAll": {"input": "$p_name", "find": "a", "replacement": "<>"}}, "o": {"$replaceOne": {"input": "$p_name", "find": "a", "replacement": "<>"}}, "k": {"$concat": ["$p_brand", "-", "$p_type"]}, "w": {"$size": {"$split": ["$p_type", " "]}}, "z": {"$strcasecmp": ["$p_name", "m"]}, "t": {"$rtrim": {"input": "$p_brand", "chars": "0123456789"}}}, "upper(p_name) AS u, CAST(length(p_name) AS INTEGER) AS n, substr(p_name, 3, 4) AS s, CAST(instr(p_name, 'a') - 1 AS INTEGER) AS i, replace(p_name, 'a', '<>') AS r, CASE WHEN instr(p_name, 'a') > 0 THEN substr(p_name, 1, instr(p_name, 'a') - 1) || '<>' || substr(p_name, instr(p_name, 'a') + 1) ELSE p_name END AS o, p_brand || '-' || p_type AS k, CAST(len(string_split(p_type, ' ')) AS INTEGER) AS w, CAST(CASE WHEN lower(p_name) < 'm' THEN -1 WHEN lower(p_name) > 'm' THEN 1 ELSE 0 END AS INTEGER) AS z, rtrim(p_brand, '0123456789') AS t")
pipeline("expr_regex", "documents", [{"$project": {"_id": 0, "doc_id": 1, "m": {"$regexMatch": {"input": "$text", "regex": "[0-9]{4}"}}, "f": {"$regexFind": {"input": "$text", "regex": "[a-z]+@[a-z0-9.]+"}}, "a": {"$regexFindAll": {"input": "$text", "regex": "[A-Z]{3,}"}}}}], "SELECT doc_id, regexp_matches(text, '[0-9]{4}') AS m, nullif(regexp_extract(text, '[a-z]+@[a-z0-9.]+'), '') AS f, CAST(len(regexp_extract_all(text, '[A-Z]{3,}')) AS INTEGER) AS n, array_to_string(regexp_extract_all(text, '[A-Z]{3,}'), ',') AS a FROM documents", flat(doc_id="doc_id", m="m", f="f.match", n="size(a)", a="array_join(a.match, ',')"))
expression("expr_date_parts", "events", "event_id", {"y": {"$year": "$ts"}, "m": {"$month": "$ts"}, "d": {"$dayOfMonth": "$ts"}, "h": {"$hour": "$ts"}, "w": {"$dayOfWeek": "$ts"}, "j": {"$dayOfYear": "$ts"}, "ms": {"$millisecond": "$ts"}}, "CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(dayofweek(ts) + 1 AS INTEGER) AS w, CAST(dayofyear(ts) AS INTEGER) AS j, CAST(millisecond(ts) % 1000 AS INTEGER) AS ms")
expression("expr_date_math", "orders", "o_orderkey", {"days": {"$dateDiff": {"startDate": "$o_orderdate", "endDate": {"$toDate": "1999-01-01T00:00:00Z"}, "unit": "day"}}, "months": {"$dateDiff": {"startDate": "$o_orderdate", "endDate": {"$toDate": "1999-01-01T00:00:00Z"}, "unit": "month"}}, "later": {"$dateToString": {"date": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "month", "amount": 1}}, "format": "%Y-%m-%d"}}, "sooner": {"$dateToString": {"date": {"$dateSubtract": {"startDate": "$o_orderdate", "unit": "day", "amount": 40}}, "format": "%Y/%m/%d %H:%M:%S"}}}, "(epoch_ms(TIMESTAMP '1999-01-01') - epoch_ms(o_orderdate)) // 86400000 AS days, CAST(12 * (1999 - year(o_orderdate)) + 1 - month(o_orderdate) AS BIGINT) AS months, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS later, strftime(o_orderdate - INTERVAL 40 DAY, '%Y/%m/%d %H:%M:%S') AS sooner")
expression("expr_cond", "customer", "c_custkey", {"a": {"$cond": {"if": {"$gte": ["$c_acctbal", 0]}, "then": "plus", "else": "minus"}}, "b": {"$ifNull": [{"$cond": [{"$gt": ["$c_acctbal", 5000]}, "$c_name", None]}, "none"]}, "c": {"$and": ["$c_nationkey", {"$lt": ["$c_acctbal", 1000]}]}, "d": {"$cmp": ["$c_nationkey", 12]}, "e": {"$gt": ["$c_acctbal", None]}}, "CASE WHEN c_acctbal >= 0 THEN 'plus' ELSE 'minus' END AS a, CASE WHEN c_acctbal > 5000 THEN c_name ELSE 'none' END AS b, c_nationkey <> 0 AND c_acctbal < 1000 AS c, CAST(sign(c_nationkey - 12) AS INTEGER) AS d, true AS e")
expression("expr_array", "embeddings", "vec_id", {"f": {"$first": "$embedding"}, "l": {"$arrayElemAt": ["$embedding", -1]}, "n": {"$size": "$embedding"}, "s": {"$size": {"$slice": ["$embedding", -5]}}, "r": {"$arrayElemAt": [{"$reverseArray": "$embedding"}, 0]}, "i": {"$in": ["$label", [1, 3, 5]]}, "x": {"$arrayElemAt": ["$embedding", 99]}, "g": {"$size": {"$range": [0, 10, 3]}}}, "embedding[1] AS f, embedding[64] AS l, CAST(len(embedding) AS INTEGER) AS n, 5 AS s, embedding[64] AS r, coalesce(label IN (1, 3, 5), false) AS i, CAST(NULL AS FLOAT) AS x, 4 AS g")
expression("expr_map_filter_reduce", "embeddings", "vec_id", {"p": {"$size": {"$filter": {"input": "$embedding", "as": "x", "cond": {"$gt": ["$$x", 0]}}}}, "s": R2({"$reduce": {"input": {"$map": {"input": "$embedding", "as": "x", "in": {"$multiply": ["$$x", 2]}}}, "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 6), "h": {"$arrayElemAt": [{"$sortArray": {"input": "$embedding", "sortBy": -1}}, 0]}}, "CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS p, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 6) AS s, list_max(embedding) AS h")
expression("expr_convert", "events", "event_id", {"i": {"$toInt": {"$floor": "$value"}}, "s": {"$toString": "$user_id"}, "b": {"$toBool": "$user_id"}, "c": {"$convert": {"input": "$event_type", "to": "int", "onError": -1}}, "t": {"$type": "$value"}, "n": {"$isNumber": "$event_type"}, "z": {"$binarySize": "$event_type"}}, "CAST(floor(value) AS INTEGER) AS i, CAST(user_id AS VARCHAR) AS s, user_id <> 0 AS b, -1 AS c, 'double' AS t, false AS n, CAST(strlen(event_type) AS INTEGER) AS z")
expression("expr_object", "nation", "n_nationkey", {"k": {"$getField": {"field": "n_name", "input": "$$ROOT"}}, "m": {"$getField": {"field": "b", "input": {"$mergeObjects": [{"$let": {"vars": {}, "in": "$$ROOT"}}, {"$let": {"vars": {"y": "$n_regionkey"}, "in": "$extra"}}]}}}, "l": {"$let": {"vars": {"a": 2, "b": "$n_regionkey"}, "in": {"$multiply": ["$$a", "$$b"]}}}, "z": {"$bsonSize": "$$ROOT"}}, "n_name AS k, n_regionkey AS m, CAST(2 * n_regionkey AS DOUBLE) AS l, CAST(71 + strlen(n_name) AS INTEGER) AS z", {"extra.b": "$n_regionkey"})


# search, vectors, places
@query()
def vector_search(db):
    probe = [float((i * 37 % 11) - 5) for i in range(64)]
    return db["embeddings"].aggregate([{"$vectorSearch": {"path": "embedding", "queryVector": probe, "limit": 10}}]).selectExpr("vec_id", "round(__vectorSearchScore, 6) as score")


SQL["vector_search"] = "WITH q AS (SELECT list_transform(range(64), lambda i: CAST((i * 37 % 11) - 5 AS DOUBLE)) AS v) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC LIMIT 10"
pipeline("text_match", "documents", [{"$match": {"$text": {"$search": 'license "under the" -apache'}}}, {"$project": {"_id": 0, "doc_id": 1}}], "SELECT doc_id FROM (SELECT doc_id, lower(text || chr(10) || coalesce(lang, '') || chr(10) || coalesce(source, '')) AS t FROM documents) WHERE contains(t, 'license') AND contains(t, 'under the') AND NOT contains(t, 'apache')")


@query("SELECT doc_id, (length(t) - length(replace(t, 'license', ''))) / 7 + CASE WHEN contains(t, 'under the') THEN 5 ELSE 0 END AS score FROM (SELECT doc_id, lower(text || chr(10) || coalesce(lang, '') || chr(10) || coalesce(source, '')) AS t FROM documents) WHERE contains(t, 'license') AND contains(t, 'under the')")
def text_score(db):
    return db["documents"].find({"$text": {"$search": 'license "under the"'}}, {"_id": 0, "doc_id": 1, "score": {"$meta": "textScore"}})


pipeline("search_stage", "documents", [{"$search": {"phrase": {"query": "Public License", "path": "text"}}}, {"$project": {"_id": 0, "doc_id": 1, "score": 1}}], "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'public license')")
PLACE = {"$set": {"place": {"$let": {"vars": {"x": {"$subtract": [{"$mod": [{"$multiply": ["$s_suppkey", 7]}, 360]}, 180]}, "y": {"$subtract": [{"$mod": [{"$multiply": ["$s_suppkey", 11]}, 160]}, 80]}}, "in": ["$$x", "$$y"]}}}}
_XY = "(SELECT *, CAST(s_suppkey * 7 % 360 - 180 AS DOUBLE) AS x, CAST(s_suppkey * 11 % 160 - 80 AS DOUBLE) AS y FROM supplier)"
_HAV = "2 * 6378100.0 * asin(sqrt(pow(sin(radians(20.0 - y) / 2), 2) + cos(radians(y)) * cos(radians(20.0)) * pow(sin(radians(10.0 - x) / 2), 2)))"
pipeline("geo_near", "supplier", [PLACE, {"$geoNear": {"near": {"type": "Point", "coordinates": [10, 20]}, "distanceField": "d", "maxDistance": 6_000_000}}, {"$project": {"_id": 0, "s_suppkey": 1, "d": R2("$d", 1)}}], f"SELECT s_suppkey, round({_HAV}, 1) AS d FROM {_XY} WHERE {_HAV} <= 6000000")
pipeline("geo_within", "supplier", [PLACE, {"$match": {"place": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[[-100, -50], [100, -50], [100, 50], [-100, 50], [-100, -50]], [[-20, -20], [20, -20], [20, 20], [-20, 20], [-20, -20]]]}}}}}, {"$project": {"_id": 0, "s_suppkey": 1}}], f"SELECT s_suppkey FROM {_XY} WHERE x BETWEEN -100 AND 100 AND y BETWEEN -50 AND 50 AND NOT (x BETWEEN -20 AND 20 AND y BETWEEN -20 AND 20)")


pipeline("geo_intersects", "supplier", [PLACE, {"$set": {"route": [["$place.0", "$place.1"], [{"$add": ["$place.0", 30]}, "$place.1"]]}}, {"$match": {"route": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [[[-50, -30.5], [50, -30.5], [50, 30.5], [-50, 30.5], [-50, -30.5]]]}}}}}, {"$project": {"_id": 0, "s_suppkey": 1}}], f"SELECT s_suppkey FROM {_XY} WHERE y BETWEEN -30.5 AND 30.5 AND x <= 50 AND x + 30 >= -50")


# writes
@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal + 100, 2) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'seen' END AS note FROM customer")
def update_set_inc(db):
    out = updates.update(db["customer"].frame, {"c_mktsegment": "BUILDING"}, {"$inc": {"c_acctbal": 100}, "$set": {"note": "seen"}}, key="c_custkey")
    return out.selectExpr("c_custkey", "case when note is null then c_acctbal else round(c_acctbal, 2) end as c_acctbal", "note")


@query("SELECT conv_id AS _id, array_to_string(list_concat(list_sort(list(turn))[2:], [99, 98]), ',') AS turns FROM conversations GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT conv_id, '99,98' FROM conversations GROUP BY 1 HAVING count(*) = 1")
def update_array_ops(db):
    db.register("turns", db["conversations"].aggregate([{"$sort": {"turn": 1}}, {"$group": {"_id": "$conv_id", "turns": {"$push": "$turn"}}}]))
    once = updates.update(db["turns"].frame, {}, {"$pop": {"turns": -1}})
    return updates.update(once, {}, {"$push": {"turns": {"$each": [99, 98]}}}).selectExpr("_id", "array_join(turns, ',') as turns")


@query("SELECT coalesce(o.o_orderkey, n.k) AS o_orderkey, coalesce(n.p, o.o_totalprice) AS o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P') o FULL JOIN (SELECT o_orderkey AS k, round(o_totalprice * 2, 2) AS p FROM orders WHERE o_orderkey % 3 = 0) n ON o.o_orderkey = n.k")
def merge_upsert(db):
    old = db["orders"].aggregate([{"$match": {"o_orderstatus": {"$ne": "P"}}}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}])
    new = db["orders"].aggregate([{"$match": {"o_orderkey": {"$mod": [3, 0]}}}, {"$project": {"o_orderkey": 1, "o_totalprice": R2({"$multiply": ["$o_totalprice", 2]})}}])
    return updates.merge_into(old, new, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def delete_many(db):
    return updates.delete(db["orders"].frame, {"o_orderstatus": "F", "o_totalprice": {"$lt": 100000}}).select("o_orderkey")


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'update' WHEN o_orderkey % 7 = 0 THEN 'delete' ELSE 'insert' END AS operationType, o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def change_diff(db):
    orders = db["orders"].frame.select("o_orderkey", "o_totalprice")
    before = orders.where("o_orderkey % 5 = 0 or o_orderkey % 7 = 0 or o_orderkey % 11 != 0")
    after = orders.where("o_orderkey % 5 = 0 or o_orderkey % 7 != 0").withColumn("o_totalprice", F.expr("if(o_orderkey % 5 = 0, o_totalprice + 1, o_totalprice)"))
    return changes.change_events(before, after, "o_orderkey", "db", "orders").select("operationType", F.col("documentKey.o_orderkey").alias("o_orderkey"))


expression("expr_compare", "events", "event_id", {"c": {"$cmp": ["$value", 50]}, "g": {"$gte": ["$value", {"$multiply": ["$user_id", 1]}]}, "n": {"$ne": ["$event_type", "click"]}, "l": {"$lt": ["$v", 75]}, "o": {"$or": [{"$gt": ["$value", 90]}, {"$eq": ["$v", None]}]}}, "CAST(sign(value - 50) AS INTEGER) AS c, value >= user_id AS g, event_type <> 'click' AS n, CASE WHEN value > 50 THEN value < 75 ELSE true END AS l, value > 90 OR value <= 50 AS o", {"v": {"$cond": [{"$gt": ["$value", 50]}, "$value", None]}})
expression("expr_zip_sort", "embeddings", "vec_id", {"z": {"$size": {"$zip": {"inputs": ["$embedding", {"$slice": ["$embedding", 5]}]}}}, "t": {"$arrayElemAt": [{"$sortArray": {"input": "$embedding", "sortBy": 1}}, 2]}, "c": {"$size": {"$concatArrays": ["$embedding", [1.5]]}}}, "5 AS z, list_sort(embedding)[3] AS t, 65 AS c")
expression("expr_date_format", "orders", "o_orderkey", {"f": {"$dateToString": {"date": "$o_orderdate", "format": "%Y/%m/%d at %H:%M:%S, day %j"}}, "p": {"$dateToString": {"date": {"$dateFromString": {"dateString": {"$concat": [{"$toString": {"$year": "$o_orderdate"}}, "-03-01"]}}}, "format": "%d.%m.%Y"}}}, "strftime(o_orderdate, '%Y/%m/%d at %H:%M:%S, day %j') AS f, '01.03.' || year(o_orderdate) AS p")


@query("SELECT vec_id, 2 AS n, embedding[63] AS a, embedding[64] AS b FROM embeddings")
def find_slice(db):
    return db["embeddings"].find({}, {"vec_id": 1, "embedding": {"$slice": -2}}).selectExpr("vec_id", "size(embedding) as n", "embedding[0] as a", "embedding[1] as b")


@query("SELECT l_orderkey AS _id, CASE WHEN bool_or(l_quantity > 40) THEN 1 ELSE 0 END AS n FROM lineitem GROUP BY 1")
def find_elem_match(db):
    db.register("baskets", db["lineitem"].aggregate([{"$group": {"_id": "$l_orderkey", "lines": {"$push": "$$ROOT"}}}]))
    return db["baskets"].find({}, {"lines": {"$elemMatch": {"l_quantity": {"$gt": 40}}}}).selectExpr("_id", "if(lines is null, 0, size(lines)) as n")


@query("SELECT count(*) AS n FROM documents")
def search_meta(db):
    return db["documents"].aggregate([{"$searchMeta": {"text": {"query": "license", "path": "text"}}}]).selectExpr("count.total as n")


@query("SELECT count(*) AS count FROM lineitem")
def coll_stats(db):
    return db["lineitem"].aggregate([{"$collStats": {"storageStats": {}}}]).select("count")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45")
def distinct_many(db):
    db.register("baskets", db["lineitem"].aggregate([{"$match": {"l_quantity": {"$gt": 45}}}, {"$group": {"_id": "$l_orderkey", "l_partkey": {"$push": "$l_partkey"}}}]))
    return db["baskets"].distinct_many("l_partkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN 'replaced' ELSE s_name END AS s_name, CASE WHEN s_suppkey <> 7 THEN s_acctbal END AS s_acctbal FROM supplier")
def replace_one(db):
    return updates.replace(db["supplier"].frame, {"s_suppkey": 7}, {"s_name": "replaced"}, key="s_suppkey").select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey + 10000000, s_name FROM supplier")
def insert_many(db):
    new = db["supplier"].frame.selectExpr("s_suppkey + 10000000 as c_custkey", "s_name as c_name")
    return updates.insert(db["customer"].frame.select("c_custkey", "c_name"), new, key="c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n BETWEEN 11 AND 30")
def find_sorted(db):
    return db["orders"].find({"o_orderstatus": "O"}, {"_id": 0, "o_orderkey": 1, "o_totalprice": 1}, {"o_totalprice": -1, "o_orderkey": 1}, 10, 20)


@query("SELECT o_custkey AS _id, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, round(-max(o_totalprice), 2) FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'F') = 0")
def out_and_merge(db):
    db["orders"].aggregate([{"$group": {"_id": "$o_custkey", "total": {"$max": "$o_totalprice"}}}, {"$set": {"total": R2({"$multiply": ["$total", -1]})}}, {"$out": "totals"}])
    db["orders"].aggregate([{"$match": {"o_orderstatus": "F"}}, {"$group": {"_id": "$o_custkey", "total": {"$sum": "$o_totalprice"}}}, {"$set": {"total": R2("$total")}}, {"$merge": {"into": "totals", "whenMatched": "replace"}}])
    return db["totals"].frame.select("_id", "total")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def view_scan(db):
    db.create("located", view_on="nation", pipeline=[{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}, {"$project": {"_id": 0, "n_nationkey": 1, "r_name": "$r.r_name"}}])
    return db["located"].find({"r_name": {"$in": ["ASIA", "EUROPE"]}})


# sampling: what holds for every draw
@query("SELECT least(50, count(*)) AS n, least(50, count(*)) AS n_different, least(50, count(*)) AS n_known FROM orders")
def sample(db):
    drawn = db["orders"].aggregate([{"$sample": {"size": 50}}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}])
    known = db["orders"].frame.select("o_orderkey", "o_totalprice", F.lit(1).alias("known"))
    joined = drawn.join(known, ["o_orderkey", "o_totalprice"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_different"), F.count("known").alias("n_known"))


@query("SELECT true AS about_a_tenth, true AS in_range FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def sample_rate(db):
    """The draw's size is within six standard deviations of a tenth, and every random number is in [0, 1)."""
    drawn = db["lineitem"].aggregate([{"$match": {"$expr": {"$sampleRate": 0.1}}}, {"$project": {"l_orderkey": 1, "r": {"$rand": {}}}}])
    got = drawn.agg(F.count(F.lit(1)).alias("k"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    whole = db["lineitem"].frame.agg(F.count(F.lit(1)).alias("n"))
    return got.crossJoin(whole).selectExpr("abs(k - 0.1 * n) <= 6 * sqrt(0.09 * n) as about_a_tenth", "lo >= 0 and hi < 1 as in_range")


# streams
def _events(db):
    schema = db["events"].frame.schema
    return db.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(db.root)


def _folder(db) -> str:
    import uuid

    from tessera.sources.scratch import scratch_dir

    return f"{scratch_dir(db.spark)}/tessera-stream-{uuid.uuid4().hex}"


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_window_tumbling(db):
    out = changes.run_bounded(_events(db), lambda rows: changes.tumbling(rows, "ts", "1 day", "1 hour", "event_type"), "ts", _folder(db))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 50")
def stream_watch(db):
    filtered = changes.tail(db.spark, db.root, db["events"].frame.schema, {"event_type": "click", "value": {"$gt": 50}}, "events.parquet")
    return changes.run_to_end(filtered.select("event_id", "user_id", "value"), _folder(db))


@query("SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events")
def stream_dedup(db):
    """The first event of a user, type and day; the watermark on the day bounds what is remembered."""
    rows = _events(db).select("user_id", "event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).withWatermark("day", "1 day").dropDuplicates(["user_id", "event_type", "day"])
    return changes.run_to_end(rows, _folder(db)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, island")
def stream_session(db):
    out = changes.run_bounded(_events(db), lambda rows: changes.sessions(rows, "ts", "1 hour", "1 hour", "user_id"), "ts", _folder(db))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# registered Python
def _above(s):
    return s["value"] > 50


udfs.register_function("value_above_50", _above, "boolean")
udfs.register_function("scaled", lambda a, b: a * 2 + b, "double")
udfs.register_accumulator("sum_of_squares", lambda: 0.0, lambda state, x: state + x * x, "double")
pipeline("udf_where", "events", [{"$match": {"$where": "value_above_50"}}, {"$project": {"_id": 0, "event_id": 1}}], "SELECT event_id FROM events WHERE value > 50")
pipeline("udf_function", "events", [{"$project": {"_id": 0, "event_id": 1, "x": R2({"$function": {"body": "scaled", "args": ["$value", "$user_id"]}}, 6)}}], "SELECT event_id, round(value * 2 + user_id, 6) AS x FROM events")
pipeline("udf_accumulator", "events", [{"$group": {"_id": "$event_type", "q": {"$accumulator": {"init": "sum_of_squares", "accumulateArgs": ["$value"]}}}}, {"$set": {"q": R2("$q", 2)}}], "SELECT event_type AS _id, round(sum(value * value), 2) AS q FROM events GROUP BY 1")


from tessera.plans import variants  # noqa: E402, F401  registers more queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
