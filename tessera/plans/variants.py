"""More registered queries: operators that share their code with those of the catalogue, each with its own question."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions.scope import PipelineError
from tessera.operators import updates
from tessera.plans.registry import R2, expression, flat, matching, pipeline, query
from tessera.sources.database import Database
from tessera.streaming import changes

# reads
@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_get(db):
    """Equality on the key reaches the scan, where row groups are skipped by their statistics."""
    return db["orders"].find({"o_orderkey": 77}, {"_id": 0, "o_orderkey": 1, "o_totalprice": 1})


@query("SELECT o_orderstatus, count(*) AS n, 1 AS known FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 UNION ALL SELECT 'X', 0, 0")
def documents_stage(db):
    """Literal rows as the left side of a lookup."""
    wanted = db.aggregate([{"$documents": [{"o_orderstatus": "F"}, {"o_orderstatus": "O"}, {"o_orderstatus": "X"}]}, {"$lookup": {"from": "orders", "localField": "o_orderstatus", "foreignField": "o_orderstatus", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}])
    return wanted.groupBy("o_orderstatus").agg(F.count("o.o_orderkey").alias("n"), F.max(F.when(F.col("o.o_orderkey").isNotNull(), 1).otherwise(0)).alias("known"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def lookup_other_database(db):
    Database(db.spark, db.root, "reference", db.siblings)
    joined = db["supplier"].aggregate([{"$lookup": {"from": {"db": "reference", "coll": "nation"}, "localField": "s_nationkey", "foreignField": "n_nationkey", "as": "n"}}, {"$unwind": "$n"}])
    return joined.selectExpr("s_suppkey", "n.n_name as n_name")


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def export_and_load(db):
    """State as JSON lines in the shared folder and back, by the executors."""
    import uuid

    from tessera.sources.scratch import scratch_dir

    folder, frame = f"{scratch_dir(db.spark)}/tessera-export-{uuid.uuid4().hex}", db["customer"].frame
    db.register("saved", frame).database.export(folder)
    again = Database(db.spark)
    again.load(folder, {"saved": frame.schema})
    return again["saved"].find({}, {"_id": 0, "c_custkey": 1, "c_acctbal": 1, "c_mktsegment": 1})


@query("SELECT event_id FROM events WHERE event_type <> 'error'")
def ttl_filter(db):
    """Rows live an hour after their time; errors get one that lies two hours back, others none or now."""
    at = F.when(F.col("event_type") == "error", F.current_timestamp() - F.expr("interval 2 hours")).when(F.col("event_type") == "click", F.current_timestamp())
    db.create("timed", ttl=("at", 3600))
    db.register("timed", db["events"].frame.select("event_id", at.alias("at")))
    return db["timed"].find({}, {"_id": 0, "event_id": 1})


@query("SELECT count(*) FILTER (WHERE c_acctbal > 0) AS plus, count(*) AS whole FROM customer")
def count_call(db):
    counts = [(db["customer"].count({"c_acctbal": {"$gt": 0}}), db["customer"].count())]
    return db.spark.createDataFrame(counts, "plus long, whole long")


@query("SELECT o_orderpriority AS _id, count(*) AS n, true AS pushed FROM orders WHERE o_totalprice > 250000 GROUP BY 1")
def explain_plan(db):
    """The plan of a pipeline, and that its filter and columns reach the scan, beside the pipeline's rows."""
    stages = [{"$match": {"o_totalprice": {"$gt": 250000}}}, {"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}}}]
    text = db.run_command({"explain": {"aggregate": "orders", "pipeline": stages}})
    pushed = "GreaterThan(o_totalprice,250000.0)" in text and "o_custkey" not in text.split("ReadSchema")[1]
    return db["orders"].aggregate(stages).withColumn("pushed", F.lit(pushed))


@query("SELECT n_nationkey, '$badStage,$badOperator,$badAccumulator,$badFilter' AS refused FROM nation")
def unknown_operators(db):
    """What has no meaning is refused when the pipeline is built, not dropped."""
    refused = []
    for name, stages in (("$badStage", [{"$badStage": {}}]), ("$badOperator", [{"$project": {"x": {"$badOperator": 1}}}]), ("$badAccumulator", [{"$group": {"_id": None, "x": {"$badAccumulator": 1}}}]), ("$badFilter", [{"$match": {"n_name": {"$badFilter": 1}}}])):
        try:
            db["nation"].aggregate(stages)
        except PipelineError:
            refused.append(name)
    return db["nation"].find({}, {"_id": 0, "n_nationkey": 1}).withColumn("refused", F.lit(",".join(refused)))


# filters
PARTS = [{"$group": {"_id": "$l_orderkey", "flags": {"$addToSet": "$l_returnflag"}, "numbers": {"$push": "$l_linenumber"}}}]
pipeline("match_all", "lineitem", [*PARTS, {"$match": {"flags": {"$all": ["A", "R"]}, "numbers": {"$all": [1, 2]}}}, {"$project": {"_id": 1}}], "SELECT l_orderkey AS _id FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AND bool_or(l_linenumber = 1) AND bool_or(l_linenumber = 2)")
matching("match_bits_clear_any", "customer", "c_custkey", {"c_custkey": {"$bitsAllClear": [1, 4], "$bitsAnySet": 12}}, "(c_custkey & 18) = 0 AND (c_custkey & 12) <> 0")
matching("match_regex_plain", "documents", "doc_id", {"text": {"$regex": "(?i)licensed under"}, "lang": {"$regex": "^e"}}, "regexp_matches(text, '(?i)licensed under') AND regexp_matches(lang, '^e')")
PLACE = {"$set": {"place": [{"$subtract": [{"$mod": [{"$multiply": ["$s_suppkey", 7]}, 360]}, 180]}, {"$subtract": [{"$mod": [{"$multiply": ["$s_suppkey", 11]}, 160]}, 80]}]}}
_XY = "(SELECT *, CAST(s_suppkey * 7 % 360 - 180 AS DOUBLE) AS x, CAST(s_suppkey * 11 % 160 - 80 AS DOUBLE) AS y FROM supplier)"
_HAV = "2 * 6378100.0 * asin(sqrt(pow(sin(radians(20.0 - y) / 2), 2) + cos(radians(y)) * cos(radians(20.0)) * pow(sin(radians(10.0 - x) / 2), 2)))"
for _name, _spec in (("match_near", {"$near": {"$geometry": {"type": "Point", "coordinates": [10, 20]}, "$minDistance": 500_000, "$maxDistance": 7_000_000}}), ("match_near_sphere", {"$nearSphere": [10, 20], "$minDistance": 500_000, "$maxDistance": 7_000_000})):
    pipeline(_name, "supplier", [PLACE, {"$match": {"place": _spec}}, {"$project": {"_id": 0, "s_suppkey": 1}}], f"SELECT s_suppkey FROM {_XY} WHERE {_HAV} BETWEEN 500000 AND 7000000")
ROUTE = {"$set": {"route": [["$place.0", "$place.1"], [{"$add": ["$place.0", 30]}, "$place.1"]]}}
pipeline("geo_within_edges", "supplier", [PLACE, ROUTE, {"$match": {"route": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[[-170, -79.5], [170, -79.5], [170, 79.5], [20, 79.5], [20, -70.5], [10, -70.5], [10, 79.5], [-170, 79.5], [-170, -79.5]]]}}}}}, {"$project": {"_id": 0, "s_suppkey": 1}}], f"SELECT s_suppkey FROM {_XY} WHERE y BETWEEN -79.5 AND 79.5 AND x >= -170 AND x + 30 <= 170 AND (y < -70.5 OR x + 30 <= 10 OR x >= 20)")
pipeline("geo_intersects_line", "supplier", [PLACE, ROUTE, {"$match": {"route": {"$geoIntersects": {"$geometry": {"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[0.5, -40.5], [0.5, 40.5]]}, {"type": "MultiLineString", "coordinates": [[[100.5, -90], [100.5, 0.5]]]}]}}}}}, {"$project": {"_id": 0, "s_suppkey": 1}}], f"SELECT s_suppkey FROM {_XY} WHERE (x <= 0.5 AND x + 30 >= 0.5 AND y BETWEEN -40.5 AND 40.5) OR (x <= 100.5 AND x + 30 >= 100.5 AND y <= 0.5)")

# windows
pipeline("win_min_max", "events", [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1, "event_id": 1}, "output": {"lo": {"$min": "$value", "window": {"documents": [-3, "current"]}}, "hi": {"$max": "$value", "window": {"documents": ["unbounded", "current"]}}}}}, {"$project": {"_id": 0, "event_id": 1, "lo": 1, "hi": 1}}], "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS lo, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hi FROM events")

# expressions
X = {"$set": {"x": {"$toDouble": {"$arrayElemAt": ["$embedding", 0]}}}}
_X = "(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)"
pipeline("expr_trig_more", "embeddings", [X, {"$project": {"_id": 0, "vec_id": 1, "t": R2({"$tan": "$x"}, 9), "a": R2({"$asin": "$x"}, 9), "c": R2({"$acos": "$x"}, 9), "n": R2({"$atan": "$x"}, 9), "d": R2({"$radiansToDegrees": "$x"}, 7), "e": R2({"$exp": "$x"}, 9), "l": R2({"$log10": {"$add": [{"$abs": "$x"}, 1]}}, 9)}}], f"SELECT vec_id, round(tan(x), 9) AS t, round(asin(x), 9) AS a, round(acos(x), 9) AS c, round(atan(x), 9) AS n, round(degrees(x), 7) AS d, round(exp(x), 9) AS e, round(log10(abs(x) + 1), 9) AS l FROM {_X}")
expression("expr_string_more", "part", "p_partkey", {"lo": {"$toLower": "$p_type"}, "tr": {"$trim": {"input": {"$concat": ["  ", "$p_name", " "]}}}, "lt": {"$ltrim": {"input": "$p_name", "chars": "sb"}}, "ss": {"$substr": ["$p_brand", 0, 5]}, "sb": {"$substrBytes": ["$p_brand", 6, 2]}, "n": {"$strLenBytes": {"$concat": ["$p_name", "é"]}}, "i": {"$indexOfBytes": ["$p_name", "l"]}}, "lower(p_type) AS lo, p_name AS tr, ltrim(p_name, 'sb') AS lt, substring(p_brand, 1, 5) AS ss, substring(p_brand, 7, 2) AS sb, CAST(strlen(p_name) + 2 AS INTEGER) AS n, CAST(instr(p_name, 'l') - 1 AS INTEGER) AS i")
expression("expr_logic_more", "events", "event_id", {"le": {"$lte": ["$value", 50]}, "no": {"$not": [{"$gt": ["$value", 50]}]}, "ln": {"$literal": "$value"}, "ni": {"$not": ["$user_id"]}}, "value <= 50 AS le, NOT (value > 50) AS no, '$value' AS ln, user_id = 0 AS ni")
expression("expr_array_more", "embeddings", "vec_id", {"a": {"$isArray": "$embedding"}, "b": {"$isArray": "$label"}, "l": {"$last": "$embedding"}}, "true AS a, false AS b, embedding[64] AS l")
pipeline("expr_object_arrays", "nation", [{"$project": {"_id": 0, "n_nationkey": 1, "o": {"$objectToArray": {"$let": {"vars": {}, "in": {"$mergeObjects": ["$$ROOT"]}}}}}}, {"$project": {"n_nationkey": 1, "o": 1, "m": {"$arrayToObject": "$o"}}}], "SELECT n_nationkey, 'n_nationkey=' || n_nationkey || ',n_name=' || n_name || ',n_regionkey=' || n_regionkey AS o, n_name AS m FROM nation", flat(n_nationkey="n_nationkey", o="array_join(transform(o, x -> concat(x.k, '=', x.v)), ',')", m="m['n_name']"))
expression("expr_convert_more", "orders", "o_orderkey", {"l": {"$toLong": {"$floor": "$o_totalprice"}}, "d": {"$toDouble": {"$toString": "$o_orderkey"}}, "o": {"$toObjectId": {"$concat": ["ABCDEFABCDEFABCDEFABCDE", {"$substr": [{"$toString": {"$toInt": {"$mod": ["$o_orderkey", 10]}}}, 0, 1]}]}}}, "CAST(floor(o_totalprice) AS BIGINT) AS l, CAST(o_orderkey AS DOUBLE) AS d, 'abcdefabcdefabcdefabcde' || (o_orderkey % 10) AS o")
pipeline("expr_decimal", "orders", [{"$project": {"_id": 0, "o_orderkey": 1, "d": {"$toDecimal": {"$toString": "$o_totalprice"}}}}], "SELECT o_orderkey, o_totalprice AS d FROM orders", flat(o_orderkey="o_orderkey", d="cast(d as double)"))
expression("expr_clock_parts", "events", "event_id", {"m": {"$minute": "$ts"}, "s": {"$second": "$ts"}}, "CAST(minute(ts) AS INTEGER) AS m, CAST(second(ts) AS INTEGER) AS s")
pipeline("expr_set_field", "nation", [{"$project": {"_id": 0, "n_nationkey": 1, "d": {"$setField": {"field": "n_name", "input": {"$mergeObjects": ["$$ROOT"]}, "value": {"$toLower": "$n_name"}}}}}], "SELECT n_nationkey, lower(n_name) AS name, n_regionkey AS region FROM nation", flat(n_nationkey="n_nationkey", name="d.n_name", region="d.n_regionkey"))
pipeline("expr_hashed_key", "customer", [{"$group": {"_id": {"$toHashedIndexKey": "$c_mktsegment"}, "n": {"$sum": 1}, "s": {"$min": "$c_mktsegment"}, "t": {"$max": "$c_mktsegment"}}}, {"$project": {"_id": 0, "n": 1, "s": 1, "t": 1}}], "SELECT count(*) AS n, c_mktsegment AS s, c_mktsegment AS t FROM customer GROUP BY c_mktsegment")


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id AS i FROM events")
def expr_timestamp_parts(db):
    frame = db["events"].frame
    db.register("log", frame.select("event_id", F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("i")).alias("ts")))
    return db["log"].aggregate([{"$project": {"_id": 0, "event_id": 1, "s": {"$tsSecond": "$ts"}, "i": {"$tsIncrement": "$ts"}}}])


# lookups with more stages inside
INSIDE = {"from": "orders", "let": {"k": "$c_custkey"}, "as": "o"}
_SAME = {"$match": {"$expr": {"$eq": ["$o_custkey", "$$k"]}}}
pipeline("lookup_sort_by_count", "customer", [{"$lookup": INSIDE | {"pipeline": [_SAME, {"$sortByCount": "$o_orderstatus"}]}}, {"$project": {"_id": 0, "c_custkey": 1, "o": 1}}], "SELECT c_custkey, coalesce(string_agg(o_orderstatus || ':' || n, ',' ORDER BY n DESC, o_orderstatus) FILTER (WHERE n > 0), '') AS o FROM (SELECT c_custkey, o_orderstatus, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) GROUP BY 1", flat(c_custkey="c_custkey", o="array_join(transform(o, x -> concat(x._id, ':', x.count)), ',')"))
pipeline("lookup_ranked_inside", "customer", [{"$lookup": INSIDE | {"pipeline": [_SAME, {"$setWindowFields": {"sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": {"r": {"$documentNumber": {}}}}}, {"$match": {"r": {"$lte": 2}}}, {"$replaceRoot": {"newRoot": {"k": "$o_orderkey", "r": "$r"}}}, {"$sort": {"r": 1}}]}}, {"$project": {"_id": 0, "c_custkey": 1, "o": 1}}], "SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 2), '') AS o FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM customer LEFT JOIN orders ON c_custkey = o_custkey) GROUP BY 1", flat(c_custkey="c_custkey", o="array_join(o.k, ',')"))
pipeline("lookup_nested", "nation", [{"$lookup": {"from": "customer", "let": {"n": "$n_nationkey"}, "as": "c", "pipeline": [{"$match": {"$expr": {"$eq": ["$c_nationkey", "$$n"]}}}, {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": "$o"}, {"$group": {"_id": None, "total": {"$sum": "$o.o_totalprice"}, "n": {"$sum": 1}}}]}}, {"$project": {"_id": 0, "n_nationkey": 1, "c": 1}}], "SELECT n_nationkey, round(sum(o_totalprice), 2) AS total, nullif(count(o_orderkey), 0) AS n FROM nation LEFT JOIN (customer JOIN orders ON c_custkey = o_custkey) ON c_nationkey = n_nationkey GROUP BY 1", flat(n_nationkey="n_nationkey", total="round(get(c, 0).total, 2)", n="get(c, 0).n"))
pipeline("lookup_once", "nation", [{"$lookup": {"from": "supplier", "as": "s", "pipeline": [{"$facet": {"by": [{"$sortByCount": "$s_nationkey"}], "top": [{"$sort": {"s_acctbal": -1, "s_suppkey": 1}}, {"$limit": 3}]}}]}}, {"$project": {"_id": 0, "n_nationkey": 1, "s": 1}}], "SELECT n_nationkey, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS kinds, (SELECT string_agg(s_suppkey, ',' ORDER BY n) FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) WHERE n <= 3) AS top FROM nation", flat(n_nationkey="n_nationkey", kinds="cast(size(s[0].by) as bigint)", top="array_join(s[0].top.s_suppkey, ',')"))


@query("SELECT l_orderkey AS _id, count(*) AS n FROM (SELECT l_orderkey, unnest(list_distinct(list(l_suppkey))) AS k FROM lineitem GROUP BY 1) JOIN (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT s_suppkey FROM supplier) USING (k) GROUP BY 1")
def lookup_equal_foreign_rows(db):
    """Every supplier twice, met by an array of keys: equal foreign rows are two."""
    db.register("twice", db["supplier"].frame.unionAll(db["supplier"].frame))
    joined = db["lineitem"].aggregate([{"$group": {"_id": "$l_orderkey", "k": {"$addToSet": "$l_suppkey"}}}, {"$lookup": {"from": "twice", "localField": "k", "foreignField": "s_suppkey", "as": "s"}}])
    return joined.selectExpr("_id", "cast(size(s) as bigint) as n")


# updates
SEGMENT = {"c_mktsegment": "BUILDING"}


def _customers(name: str, change: dict | list, sql: str, columns: tuple[str, ...]) -> None:
    def run(db):
        return updates.update(db["customer"].frame, SEGMENT, change, key="c_custkey").selectExpr("c_custkey", *columns)

    run.__name__ = name
    query(f"SELECT c_custkey, {sql} FROM (SELECT *, c_mktsegment = 'BUILDING' AS hit FROM customer)")(run)


_customers("update_mul", {"$mul": {"c_acctbal": 2}}, "CASE WHEN hit THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal", ("c_acctbal",))
_customers("update_min_max", {"$min": {"c_acctbal": 1000}, "$max": {"c_nationkey": 12}}, "CASE WHEN hit THEN least(c_acctbal, 1000) ELSE c_acctbal END AS c_acctbal, CASE WHEN hit THEN greatest(c_nationkey, 12) ELSE c_nationkey END AS c_nationkey", ("c_acctbal", "c_nationkey"))
_customers("update_unset_rename", {"$unset": {"c_acctbal": ""}, "$rename": {"c_name": "label"}}, "CASE WHEN NOT hit THEN c_acctbal END AS c_acctbal, CASE WHEN hit THEN c_name END AS label, CASE WHEN NOT hit THEN c_name END AS c_name", ("c_acctbal", "label", "c_name"))
_customers("update_current_date", {"$currentDate": {"seen": True}}, "hit AS fresh", ("coalesce(abs(unix_seconds(now()) - unix_seconds(seen)) < 86400, false) as fresh",))
_customers("update_bit", {"$bit": {"c_nationkey": {"and": 13, "or": 2}}}, "CASE WHEN hit THEN CAST((c_nationkey & 13) | 2 AS INTEGER) ELSE c_nationkey END AS c_nationkey", ("c_nationkey",))
_customers("update_pipeline", [{"$set": {"c_acctbal": R2({"$multiply": ["$c_acctbal", 3]}), "c_name": {"$toUpper": "$c_name"}}}, {"$unset": "c_nationkey"}], "CASE WHEN hit THEN round(c_acctbal * 3, 2) ELSE c_acctbal END AS c_acctbal, CASE WHEN hit THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN NOT hit THEN c_nationkey END AS c_nationkey", ("c_acctbal", "c_name", "c_nationkey"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT -5, 'new', 1.5")
def update_set_on_insert(db):
    """An upsert that finds a row changes nothing on insert only; one that finds none makes it."""
    once = updates.update(db["customer"].frame, {"c_custkey": 1}, {"$setOnInsert": {"c_name": "never"}}, upsert=True, key="c_custkey")
    return updates.update(once, {"c_custkey": -5}, {"$setOnInsert": {"c_name": "new"}, "$set": {"c_acctbal": 1.5}}, upsert=True, key="c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT conv_id AS _id, array_to_string(list_sort(list_filter(list(turn), lambda x: x NOT IN (1, 2) AND x < 5) || [7]), ',') AS turns FROM conversations GROUP BY 1")
def update_pull_add(db):
    """$pull by a condition, $pullAll of values, and $addToSet twice of one value."""
    db.register("turns", db["conversations"].aggregate([{"$group": {"_id": "$conv_id", "turns": {"$push": "$turn"}}}]))
    out = updates.update(db["turns"].frame, {}, {"$pull": {"turns": {"$gte": 5}}, "$pullAll": {"turns": [1, 2]}})
    out = updates.update(out, {}, {"$addToSet": {"turns": {"$each": [7, 7]}}})
    return out.selectExpr("_id", "array_join(array_sort(turns), ',') as turns")


@query("SELECT n_nationkey, 'key change:66,no operator:9,operator in a replacement:2,taken key:11000,shared key:11000' AS refused FROM nation")
def update_guards(db):
    """Writes that are refused, with their error numbers."""
    frame = db["nation"].frame.withColumnRenamed("n_nationkey", "_id")
    twice = frame.unionAll(frame)
    tries = {
        "key change": lambda: updates.update(frame, {}, {"$set": {"_id": 3}}),
        "no operator": lambda: updates.update(frame, {}, {"n_name": "x"}),
        "operator in a replacement": lambda: updates.replace(frame, {}, {"$set": {"n_name": "x"}}),
        "taken key": lambda: updates.insert(frame, [{"_id": 3, "n_name": "x"}]),
        "shared key": lambda: updates.update(twice, {"_id": 3}, {"$set": {"n_name": "x"}}, one=True),
    }
    refused = []
    for name, run in tries.items():
        try:
            run()
        except PipelineError as e:
            refused.append(f"{name}:{e.code}")
    return frame.select(F.col("_id").alias("n_nationkey"), F.lit(",".join(refused)).alias("refused"))


@query("SELECT c_custkey, 'plain,partial' AS refused FROM customer WHERE c_acctbal > 9000")
def unique_keys(db):
    """Segments as a key: refused for all rows and for those of a filter, not for the rows that lack it when it is sparse."""
    rich = db["customer"].frame.where("c_acctbal > 9000").select("c_custkey", "c_mktsegment")
    other = rich.select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.when(F.col("c_custkey") < 0, F.lit("x")).alias("c_mktsegment"))
    refused = []
    for name, rule, new in (("plain", ["c_mktsegment"], rich.withColumn("c_custkey", -F.col("c_custkey") - 1)), ("sparse", {"keys": ["c_mktsegment"], "sparse": True}, other), ("partial", {"keys": ["c_mktsegment"], "partial": {"c_custkey": {"$gte": 0}}}, other)):
        db.create("rich", unique=[rule])
        db.register("rich", rich.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("c_custkey")).select("c_custkey", "c_mktsegment") if name == "sparse" else rich)
        try:
            db["rich"].insert_many(new, key="c_custkey")
        except PipelineError:
            refused.append(name)
    return rich.select("c_custkey", F.lit(",".join(refused)).alias("refused"))


# change streams
_CHANGED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'update' WHEN o_orderkey % 7 = 0 THEN 'delete' ELSE 'insert' END AS kind FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0"


def _log(db) -> tuple[str, object]:
    """The events between two versions of orders, as a log in the shared folder."""
    import uuid

    from tessera.sources.scratch import scratch_dir

    orders = db["orders"].frame.select("o_orderkey", "o_totalprice")
    before = orders.where("o_orderkey % 5 = 0 or o_orderkey % 7 = 0 or o_orderkey % 11 != 0")
    after = orders.where("o_orderkey % 5 = 0 or o_orderkey % 7 != 0").withColumn("o_totalprice", F.expr("if(o_orderkey % 5 = 0, o_totalprice + 1, o_totalprice)"))
    folder = f"{scratch_dir(db.spark)}/tessera-stream-{uuid.uuid4().hex}"
    events = changes.change_events(before, after, "o_orderkey", "db", "orders")
    events.write.parquet(f"{folder}/log")
    return folder, events.schema


@query(f"SELECT o_orderkey, kind AS operationType FROM ({_CHANGED})")
def watch_all(db):
    folder, schema = _log(db)
    stream = changes.watch(db.spark, f"{folder}/log", schema, db="db", coll="orders")
    return changes.run_to_end(stream, folder).selectExpr("documentKey.o_orderkey as o_orderkey", "operationType")


@query(f"SELECT o_orderkey, kind AS operationType FROM ({_CHANGED}) WHERE kind IN ('update', 'insert')")
def watch_pipeline(db):
    folder, schema = _log(db)
    stream = changes.watch(db.spark, f"{folder}/log", schema, [{"$match": {"operationType": {"$in": ["update", "insert"]}}}, {"$project": {"_id": 0, "o_orderkey": "$documentKey.o_orderkey", "operationType": 1}}], db="db", coll="orders")
    return changes.run_to_end(stream, folder)


@query(f"SELECT o_orderkey, kind AS operationType FROM ({_CHANGED}) WHERE seq > 1000")
def watch_resume(db):
    folder, schema = _log(db)
    stream = changes.watch(db.spark, f"{folder}/log", schema, resume_after=1000, db="db", coll="orders")
    return changes.run_to_end(stream, folder).selectExpr("documentKey.o_orderkey as o_orderkey", "operationType")
