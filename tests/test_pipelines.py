"""Pipelines on small inline tables, and one test for each point where the documented behaviour was chosen over another one."""

import math
from datetime import datetime

import pytest

from tessera.functions.scope import PipelineError
from tessera.sources.database import Database


@pytest.fixture
def db(spark):
    return Database(spark)


def put(db, rows, schema, name="t"):
    return db.register(name, db.spark.createDataFrame(rows, schema))


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_group_sum(db):
    t = put(db, [("A", 10), ("B", 20), ("A", 30), ("B", 40)], "category string, amount int")
    assert {r["_id"]: r["s"] for r in rows(t.aggregate([{"$group": {"_id": "$category", "s": {"$sum": "$amount"}}}]))} == {"A": 40.0, "B": 60.0}


def test_order_dependent_accumulators(db):
    t = put(db, [(1, 5, None), (1, 1, "x"), (1, 9, "y")], "g int, v int, s string")
    (r,) = rows(t.aggregate([{"$sort": {"v": -1}}, {"$group": {"_id": "$g", "f": {"$first": "$s"}, "l": {"$last": "$s"}, "p": {"$push": "$s"}, "a": {"$addToSet": "$g"}, "n": {"$firstN": {"n": 2, "input": "$v"}}, "z": {"$lastN": {"n": 1, "input": "$v"}}, "m": {"$maxN": {"n": 2, "input": "$v"}}}}]))
    assert r == {"_id": 1, "f": "y", "l": "x", "p": ["y", None, "x"], "a": [1], "n": [9, 5], "z": [1], "m": [9, 5]}


def test_group_of_nothing(db):
    t = put(db, [], "a int")
    assert rows(t.aggregate([{"$group": {"_id": None, "n": {"$sum": 1}}}])) == []
    assert rows(t.aggregate([{"$count": "n"}])) == [{"n": 0}]


def test_unwind(db):
    t = put(db, [("a", [1]), ("b", []), ("c", None)], "name string, arr array<int>")
    assert len(rows(t.aggregate([{"$unwind": "$arr"}]))) == 1
    kept = rows(t.aggregate([{"$unwind": {"path": "$arr", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}]))
    assert sorted((r["name"], r["arr"], r["i"]) for r in kept) == [("a", 1, 0), ("b", None, None), ("c", None, None)]


def test_buckets(db):
    t = put(db, [(15,), (25,), (35,), (45,), (55,)], "age int")
    assert [(r["_id"], r["count"]) for r in sorted(rows(t.aggregate([{"$bucket": {"groupBy": "$age", "boundaries": [0, 20, 40, 60]}}])), key=lambda r: r["_id"])] == [(0, 1), (20, 2), (40, 2)]
    with pytest.raises(Exception, match="no bucket"):
        rows(t.aggregate([{"$bucket": {"groupBy": "$age", "boundaries": [0, 20]}}]))
    n = put(db, [(i, i) for i in range(1, 13)], "_id int, value int", "n")
    auto = sorted((r["_id"]["min"], r["_id"]["max"], r["count"]) for r in rows(n.aggregate([{"$bucketAuto": {"groupBy": "$value", "buckets": 3}}])))
    assert auto == [(1, 5, 4), (5, 9, 4), (9, 12, 4)]


def test_facet(db):
    t = put(db, [(i, "even" if i % 2 == 0 else "odd", 10 * i) for i in range(6)], "_id int, category string, value int")
    (r,) = rows(t.aggregate([{"$facet": {"by": [{"$sortByCount": "$category"}], "top": [{"$sort": {"value": -1}}, {"$limit": 2}, {"$project": {"value": 1}}], "none": [{"$match": {"value": -1}}]}}]))
    assert r["by"] == [{"_id": "even", "count": 3}, {"_id": "odd", "count": 3}] and [x["value"] for x in r["top"]] == [50, 40] and r["none"] == []


def test_redact(db):
    t = put(db, [("public", "ok", [("public", 1), ("secret", 2)]), ("secret", "hidden", [])], "level string, data string, parts array<struct<level:string,n:int>>")
    got = rows(t.aggregate([{"$redact": {"$cond": [{"$eq": ["$level", "secret"]}, "$$PRUNE", "$$DESCEND"]}}]))
    assert got == [{"level": "public", "data": "ok", "parts": [{"level": "public", "n": 1}]}]


def test_lookups(db):
    left = put(db, [("apple", 5), ("banana", 10), ("kiwi", 1), (None, 0)], "item string, qty int", "l")
    put(db, [("apple", "A"), ("apple", "B"), ("banana", "C"), (None, "N")], "sku string, warehouse string", "r")
    got = {r["item"]: sorted(x["warehouse"] for x in r["w"]) for r in rows(left.aggregate([{"$lookup": {"from": "r", "localField": "item", "foreignField": "sku", "as": "w"}}]))}
    assert got == {"apple": ["A", "B"], "banana": ["C"], "kiwi": [], None: ["N"]}
    fused = rows(left.aggregate([{"$lookup": {"from": "r", "localField": "item", "foreignField": "sku", "as": "w"}}, {"$unwind": "$w"}]))
    assert len(fused) == 4
    assert {r["item"]: r["w"] for r in rows(left.aggregate([{"$lookup": {"from": "missing", "localField": "item", "foreignField": "x", "as": "w"}}]))}["kiwi"] == []


def test_correlated_lookup(db):
    left = put(db, [("apple", 5.0), ("banana", 3.0), ("fig", 1.0)], "item string, price double", "l")
    put(db, [("apple", 100), ("apple", 50), ("banana", 200), ("cherry", 50)], "name string, instock int", "r")
    stages = [{"$match": {"$expr": {"$eq": ["$name", "$$i"]}}}, {"$sort": {"instock": 1}}, {"$project": {"instock": 1, "cost": {"$multiply": ["$instock", "$$p"]}}}]
    got = {r["item"]: [(x["instock"], x["cost"]) for x in r["s"]] for r in rows(left.aggregate([{"$lookup": {"from": "r", "let": {"i": "$item", "p": "$price"}, "pipeline": stages, "as": "s"}}]))}
    assert got == {"apple": [(50, 250.0), (100, 500.0)], "banana": [(200, 600.0)], "fig": []}, "variables are seen by every stage (G-5)"
    n = {r["item"]: r["s"] for r in rows(left.aggregate([{"$lookup": {"from": "r", "let": {"i": "$item"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$name", "$$i"]}}}, {"$group": {"_id": None, "n": {"$sum": "$instock"}}}], "as": "s"}}]))}
    assert n["apple"] == [{"_id": None, "n": 150.0}] and n["fig"] == []


def test_graph_lookup(db):
    t = put(db, [("Dev", "Eliot"), ("Eliot", "Ron"), ("Ron", None), ("Andrew", "Eliot"), ("X", "Y"), ("Y", "X")], "name string, reportsTo string")
    got = {r["name"]: [(x["name"], x["d"]) for x in r["up"]] for r in rows(t.aggregate([{"$graphLookup": {"from": "t", "startWith": "$reportsTo", "connectFromField": "reportsTo", "connectToField": "name", "as": "up", "depthField": "d"}}]))}
    assert got["Dev"] == [("Eliot", 0), ("Ron", 1)] and got["Ron"] == [] and got["X"] == [("Y", 0), ("X", 1)]
    short = {r["name"]: len(r["up"]) for r in rows(t.aggregate([{"$graphLookup": {"from": "t", "startWith": "$reportsTo", "connectFromField": "reportsTo", "connectToField": "name", "as": "up", "maxDepth": 0}}]))}
    assert short["Dev"] == 1


def test_union_merge_out(db):
    a, _ = put(db, [("A", 1), ("B", 2)], "type string, val int", "a"), put(db, [("A", 3), ("C", 4)], "type string, val int", "b")
    got = rows(a.aggregate([{"$unionWith": {"coll": "b", "pipeline": [{"$match": {"type": "A"}}]}}]))
    assert sorted(r["val"] for r in got) == [1, 2, 3]
    a.aggregate([{"$group": {"_id": "$type", "val": {"$sum": "$val"}}}, {"$out": "totals"}])
    db["b"].aggregate([{"$group": {"_id": "$type", "val": {"$sum": "$val"}}}, {"$merge": {"into": "totals", "whenMatched": "replace"}}])
    assert {r["_id"]: r["val"] for r in rows(db["totals"].find())} == {"A": 3.0, "B": 2.0, "C": 4.0}


def test_densify_fill(db):
    t = put(db, [(0, 1), (5, 2)], "_id int, val int")
    assert sorted(r["_id"] for r in rows(t.aggregate([{"$densify": {"field": "_id", "range": {"step": 1, "bounds": "full"}}}]))) == [0, 1, 2, 3, 4, 5]
    f = put(db, [(1, 10), (2, None), (3, None), (4, 40)], "_id int, val int", "f")
    out = lambda rule: [r["val"] for r in sorted(rows(f.aggregate([{"$fill": {"sortBy": {"_id": 1}, "output": {"val": rule}}}])), key=lambda r: r["_id"])]
    assert out({"method": "locf"}) == [10, 10, 10, 40] and out({"value": 0}) == [10, 0, 0, 40] and out({"method": "linear"}) == [10.0, 20.0, 30.0, 40.0]


def windows(db, data, schema, output, by="i"):
    t = put(db, data, schema)
    return sorted(rows(t.aggregate([{"$setWindowFields": {"sortBy": {by: 1}, "output": output}}])), key=lambda r: r[by])


def test_window_operators(db):
    num = [(i, float(v)) for i, v in enumerate([2, 4, 4, 4, 5, 5, 7, 9])]
    got = windows(db, num, "i int, v double", {"p": {"$stdDevPop": "$v"}, "b": {"$sum": "$v", "window": {"documents": ["current", "unbounded"]}}, "x": {"$integral": {"input": "$v"}}})
    assert got[0]["p"] == 2.0 and [r["b"] for r in got][:2] == [40.0, 38.0] and got[0]["x"] == 34.5
    ema = windows(db, [(1, 10.0), (2, 20.0), (3, None), (4, 40.0)], "i int, v double", {"e": {"$expMovingAvg": {"input": "$v", "N": 3}}})
    assert [r["e"] for r in ema] == [10.0, 15.0, 15.0, 27.5]
    fill = windows(db, [(1, None), (2, 10.0), (3, None), (4, 30.0), (9, None)], "i int, v double", {"l": {"$linearFill": "$v"}, "c": {"$locf": "$v"}, "d": {"$derivative": {"input": "$v"}}})
    assert [r["l"] for r in fill] == [None, 10.0, 20.0, 30.0, None] and [r["c"] for r in fill] == [None, 10.0, 10.0, 30.0, 30.0]
    cov = windows(db, [(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 3.0, 6.0)], "i int, x double, y double", {"c": {"$covariancePop": ["$x", "$y"]}})
    assert abs(cov[0]["c"] - 4 / 3) < 1e-12


def test_g1_rank_after_ties(db):
    got = windows(db, [(100,), (90,), (90,), (80,)], "score int", {"r": {"$rank": {}}, "d": {"$denseRank": {}}}, "score")
    assert [r["r"] for r in got] == [1, 2, 2, 4] and [r["d"] for r in got] == [1, 2, 2, 3]


def test_g8_window_over_nothing(db):
    assert windows(db, [], "i int", {"r": {"$rank": {}}}) == []


def test_g9_range_frames_follow_values(db):
    got = windows(db, [(1,), (2,), (10,)], "i int", {"n": {"$count": {}, "window": {"range": [-1, 0]}}})
    assert [r["n"] for r in got] == [1, 2, 1]


def test_g6_remove_is_null(db):
    assert rows(put(db, [(1,)], "a int").aggregate([{"$project": {"a": "$$REMOVE"}}])) == [{"a": None}]


def test_g2_validators_run(db):
    db.create("v", validator={"$jsonSchema": {"required": ["a"], "properties": {"a": {"bsonType": "int", "minimum": 1}}}})
    put(db, [("x", 3)], "_id string, a int", "v").insert_many([{"_id": "y", "a": 2}])
    with pytest.raises(PipelineError) as e:
        db["v"].insert_many([{"_id": "z", "a": 0}])
    assert e.value.code == 121


def test_g7_views_resolve_everywhere(db):
    put(db, [(1, "a"), (2, "b")], "_id int, s string", "base")
    db.create("view", view_on="base", pipeline=[{"$match": {"_id": 2}}])
    assert rows(db["view"].find()) == [{"_id": 2, "s": "b"}] and rows(db["view"].aggregate([{"$count": "n"}])) == [{"n": 1}]
    got = rows(db["base"].aggregate([{"$lookup": {"from": "view", "localField": "s", "foreignField": "s", "as": "m"}}]))
    assert {r["_id"]: len(r["m"]) for r in got} == {1: 0, 2: 1}


def test_filters(db):
    t = put(db, [(1, ["a", "b", "c"], [("abc", 10), ("xyz", 5)], 7), (2, ["a"], [("abc", 3)], 3), (3, None, None, None)], "_id int, tags array<string>, results array<struct<product:string,score:int>>, flags int")
    ids = lambda f: sorted(r["_id"] for r in rows(t.find(f)))
    assert ids({"tags": {"$all": ["a", "b"]}}) == [1] and ids({"tags": "a"}) == [1, 2] and ids({"tags": {"$size": 1}}) == [2]
    assert ids({"results": {"$elemMatch": {"product": "abc", "score": {"$gte": 5}}}}) == [1] and ids({"flags": {"$bitsAllSet": 4}}) == [1]
    assert ids({"flags": None}) == [3] and ids({"flags": {"$ne": 7}}) == [2, 3] and ids({"flags": {"$nin": [7]}}) == [2, 3] and ids({"flags": {"$in": [None, 3]}}) == [2, 3]
    assert ids({"none": {"$exists": False}}) == [1, 2, 3] and ids({"none": {"$gt": 1}}) == [] and ids({"$nor": [{"flags": {"$gt": 5}}]}) == [2, 3]
    assert ids({"tags": {"$in": ["c"]}}) == [1] and ids({"flags": {"$type": "number"}}) == [1, 2] and ids({"flags": {"$not": {"$gt": 5}}}) == [2, 3]
    with pytest.raises(PipelineError):
        t.find({"flags": {"$unknown": 1}})


def test_geo(db):
    t = put(db, [("in", (["x"], [0.5, 0.5])), ("edge", (["x"], [0.0, 0.5])), ("out", (["x"], [2.0, 2.0]))], "name string, location struct<type:array<string>,coordinates:array<double>>")
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}
    names = lambda f: sorted(r["name"] for r in rows(t.find(f)))
    assert names({"location": {"$geoWithin": {"$geometry": square}}}) == ["edge", "in"]
    assert names({"location": {"$near": {"$geometry": {"type": "Point", "coordinates": [0.5, 0.5]}, "$maxDistance": 100_000}}}) == ["edge", "in"]
    lines = put(db, [(1, ([[-1.0, 0.5], [2.0, 0.5]],)), (2, ([[3.0, 3.0], [4.0, 4.0]],))], "_id int, route struct<coordinates:array<array<double>>>", "lines")
    assert [r["_id"] for r in rows(lines.find({"route": {"$geoIntersects": {"$geometry": square}}}))] == [1]
    near = rows(t.aggregate([{"$geoNear": {"near": {"type": "Point", "coordinates": [2, 2]}, "distanceField": "d", "key": "location"}}]))
    assert [r["name"] for r in near] == ["out", "in", "edge"] and near[0]["d"] == 0


def value(db, e, data=(1,), schema="a int"):
    return rows(put(db, [data], schema).aggregate([{"$project": {"x": e}}]))[0]["x"]


@pytest.mark.parametrize(
    "e,want",
    [
        ({"$add": ["$a", 1]}, 2.0), ({"$add": ["$b", 1]}, None), ({"$trunc": [-1.57, 1]}, -1.5), ({"$round": [2.5]}, 3.0), ({"$substr": [None, 0, 2]}, ""), ({"$indexOfCP": ["abcabc", "c", 3]}, 5), ({"$indexOfCP": ["abc", "z"]}, -1),
        ({"$split": ["a.b.c", "."]}, ["a", "b", "c"]), ({"$ltrim": {"input": "xxaxx", "chars": "x"}}, "axx"), ({"$trim": {"input": " a "}}, "a"), ({"$replaceOne": {"input": "aba", "find": "a", "replacement": "-"}}, "-ba"),
        ({"$cmp": [None, 1]}, -1), ({"$gt": [1, None]}, True), ({"$lt": [None, None]}, False), ({"$lte": [None, None]}, True), ({"$eq": ["$zzz", None]}, True), ({"$and": [1, "x"]}, True), ({"$or": [0, None]}, False), ({"$not": [0]}, True),
        ({"$arrayElemAt": [[1, 2, 3], -1]}, 3), ({"$arrayElemAt": [[1, 2, 3], 7]}, None), ({"$slice": [[1, 2, 3], -2]}, [2, 3]), ({"$slice": [[1, 2, 3], -9, 2]}, [1, 2]), ({"$slice": [[1, 2, 3], 1, 5]}, [2, 3]), ({"$range": [3, 0]}, []), ({"$range": [0, 7, 3]}, [0, 3, 6]), ({"$range": [3, 0, -1]}, [3, 2, 1]),
        ({"$filter": {"input": [1, 5, 9], "as": "v", "cond": {"$gt": ["$$v", 3]}, "limit": 1}}, [5]), ({"$map": {"input": [1, 2], "in": {"$multiply": ["$$this", 2]}}}, [2.0, 4.0]), ({"$reduce": {"input": [1, 2, 3], "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 6.0), ({"$reduce": {"input": ["a", "b"], "initialValue": "", "in": {"$concat": ["$$value", "$$this"]}}}, "ab"),
        ({"$zip": {"inputs": [[1, 2], [3]]}}, [[1, 3]]), ({"$zip": {"inputs": [[1, 2], [3]], "useLongestLength": True, "defaults": [0, 9]}}, [[1, 3], [2, 9]]), ({"$sortArray": {"input": [3, None, 1], "sortBy": 1}}, [None, 1, 3]), ({"$in": [2, [1, 2]]}, True), ({"$isArray": [[1]]}, True), ({"$isArray": "$a"}, False), ({"$concatArrays": [[1], [2]]}, [1, 2]), ({"$reverseArray": [[1, 2]]}, [2, 1]),
        ({"$type": "$a"}, "int"), ({"$type": "$zzz"}, "null"), ({"$convert": {"input": "x", "to": "int", "onError": -1}}, -1), ({"$toBool": None}, False), ({"$toInt": "7"}, 7), ({"$isNumber": "$a"}, True), ({"$switch": {"branches": [{"case": False, "then": 1}], "default": 2}}, 2), ({"$ifNull": [None, None, 3]}, 3), ({"$cond": [0, "a", "b"]}, "b"), ({"$literal": "$a"}, "$a"), ({"$let": {"vars": {"k": 3}, "in": {"$add": ["$$k", "$a"]}}}, 4.0),
        ({"$regexFindAll": {"input": "a1b22", "regex": "[0-9]+"}}, [{"match": "1", "idx": 1, "captures": []}, {"match": "22", "idx": 3, "captures": []}]), ({"$regexFind": {"input": "xyZ", "regex": "z", "options": "i"}}, {"match": "Z", "idx": 2, "captures": []}), ({"$regexMatch": {"input": None, "regex": "a"}}, False),
        ({"$dateDiff": {"startDate": {"$toDate": "2024-01-31T00:00:00Z"}, "endDate": {"$toDate": "2024-02-01T00:00:00Z"}, "unit": "month"}}, 1), ({"$dateToString": {"date": {"$toDate": "2024-03-05T06:07:08Z"}, "format": "%Y-%m-%dT%H:%M:%S day %j"}}, "2024-03-05T06:07:08 day 065"), ({"$dayOfWeek": {"$toDate": "2024-03-03T00:00:00Z"}}, 1), ({"$dateFromString": {"dateString": "no", "onError": None}}, None),
        ({"$objectToArray": {"$mergeObjects": ["$$ROOT"]}}, [{"k": "a", "v": 1}]), ({"$arrayToObject": [[["k", "v"]]]}, {"k": "v"}), ({"$strLenBytes": "é"}, 2), ({"$setUnion": [[1], [1, 2]]}, [1, 2]), ({"$getField": "a"}, 1), ({"$first": [[4, 5]]}, 4), ({"$last": [[4, 5]]}, 5), ({"$size": [[4, 5]]}, 2), ({"$binarySize": "é"}, 2), ({"$bsonSize": "$$ROOT"}, 12),
    ],
)
def test_expressions(db, e, want):
    assert value(db, e) == want


def test_expression_errors(db):
    assert math.isnan(value(db, {"$mod": [1, 0]})) and value(db, {"$ln": 0}) == -math.inf
    for bad in ({"$divide": [1, 0]}, {"$switch": {"branches": [{"case": False, "then": 1}]}}, {"$toObjectId": "x"}):
        with pytest.raises(Exception):  # noqa: B017
            value(db, bad)
    with pytest.raises(PipelineError):
        value(db, {"$nonsense": 1})
    with pytest.raises(PipelineError):
        put(db, [(1,)], "a int").aggregate([{"$nonsense": 1}])


def test_ts_parts(db):
    assert value(db, {"$tsSecond": "$ts"}, ((1000, 42),), "ts struct<t:int,i:int>") == 1000
    assert value(db, {"$tsIncrement": "$ts"}, ((1000, 42),), "ts struct<t:int,i:int>") == 42


def test_documents(db):
    assert sorted(r["x"] for r in rows(db.aggregate([{"$documents": [{"x": 1}, {"x": 2}, {"x": 3}]}, {"$match": {"x": {"$gt": 1}}}]))) == [2, 3]


def test_find_projection(db):
    t = put(db, [(1, [1, 2, 3], [("a", 1), ("b", 5)], ("p", "q"))], "_id int, v array<int>, d array<struct<k:string,n:int>>, s struct<x:string,y:string>")
    assert rows(t.find({}, {"v": {"$slice": -2}, "d": 0, "s": 0})) == [{"_id": 1, "v": [2, 3]}]
    assert rows(t.find({}, {"_id": 0, "d": {"$elemMatch": {"n": {"$gt": 2}}}})) == [{"d": [{"k": "b", "n": 5}]}]
    assert rows(t.find({}, {"s.x": 1})) == [{"_id": 1, "s": {"x": "p"}}]


def test_filters_reach_the_scan(spark):
    df = Database(spark, "/root/testdata/sf0.001")["orders"].aggregate([{"$match": {"o_totalprice": {"$gt": 200000}, "o_orderstatus": "F"}}, {"$project": {"_id": 0, "o_orderkey": 1}}])
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice" in plan and "EqualTo(o" in plan and "ReadSchema: struct<o_orderkey" in plan and "o_custkey" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_updates(db):
    t = put(db, [(1, 5, [3, 1], "x"), (2, None, None, "y")], "_id int, n int, v array<int>, s string")
    got = {r["_id"]: r for r in rows(t.update_many({}, {"$inc": {"n": 2}, "$push": {"v": {"$each": [2], "$sort": 1, "$slice": 2}}, "$rename": {"s": "name"}}))}
    assert got[1] == {"_id": 1, "n": 7, "v": [1, 2], "s": None, "name": "x"} and got[2]["n"] == 2 and got[2]["v"] == [2]
    assert {r["_id"]: r["n"] for r in rows(t.update_one({"n": {"$gt": 0}}, {"$max": {"n": 50}}))} == {1: 50, 2: 2}
    assert sorted(r["_id"] for r in rows(t.update_many({"_id": 9}, {"$set": {"n": 4}}, upsert=True))) == [1, 2, 9]
    assert {r["_id"]: r["v"] for r in rows(t.update_many({}, {"$pull": {"v": {"$gte": 2}}}))}[1] == [1]
    assert {r["_id"]: r["n"] for r in rows(t.replace_one({"_id": 2}, {"n": 77}))}[2] == 77
    assert sorted(r["_id"] for r in rows(t.delete_many({"n": {"$gt": 60}}))) == [1, 9]
    (before,) = rows(t.find_one_and("update", {}, {"$set": {"n": 1}}, sort={"n": 1}))
    assert before["_id"] == 9 and {r["_id"]: r["n"] for r in rows(t.find())}[9] == 1
    for bad, code in (({"$set": {"_id": 3}}, 66), ({"n": 1}, 9)):
        with pytest.raises(PipelineError) as e:
            t.update_many({}, bad)
        assert e.value.code == code
    with pytest.raises(PipelineError) as e:
        t.insert_many([{"_id": 1, "n": 1}])
    assert e.value.code == 11000


def test_pipeline_update(db):
    t = put(db, [(1, 5), (2, 6)], "_id int, n int")
    assert {r["_id"]: r["n"] for r in rows(t.update_many({"_id": 1}, [{"$set": {"n": {"$toInt": {"$multiply": ["$n", 3]}}}}]))} == {1: 15, 2: 6}


def test_ttl_capped_rename(db):
    db.create("t", ttl=("at", 10))
    put(db, [(1, datetime(2000, 1, 1)), (2, datetime(2100, 1, 1)), (3, None)], "_id int, at timestamp")
    assert sorted(r["_id"] for r in rows(db["t"].find())) == [2, 3]
    db.create("c", capped={"max": 2, "by": "_id"})
    put(db, [(1,), (2,)], "_id int", "c").insert_many([{"_id": 3}])
    assert sorted(r["_id"] for r in rows(db["c"].find())) == [2, 3]
    with pytest.raises(PipelineError):
        db["c"].delete_many({})
    with pytest.raises(PipelineError) as e:
        db.rename("c", "t")
    assert e.value.code == 48
    with pytest.raises(PipelineError) as e:
        db.run_command({"whatever": 1})
    assert e.value.code == 59


def test_files(db):
    from tessera.sources import files

    table = db.spark.createDataFrame([(1, "a", datetime(2020, 1, 1), bytearray(b"0123456789")), (2, "a", datetime(2021, 1, 1), bytearray(b""))], "_id int, filename string, uploadDate timestamp, content binary")
    meta, chunks = files.upload(table, 4)
    assert [bytes(r["data"]) for r in chunks.where("files_id = 1").orderBy("n").collect()] == [b"0123", b"4567", b"89"]
    assert {r["_id"]: bytes(r["content"]) for r in files.download(meta, chunks).collect()} == {1: b"0123456789", 2: b""}
    assert [r["_id"] for r in files.newest_by_name(meta).collect()] == [2]
    left, _ = files.delete(meta, chunks, meta.where("_id = 2"))
    assert [r["_id"] for r in left.collect()] == [1]


def test_global_row_number(db):
    from pyspark.sql import functions as F

    from tessera.sources.scratch import global_row_number

    got = global_row_number(db.spark.range(1000).repartition(7), [F.col("id").desc()], "n").collect()
    assert all(r["n"] == 1000 - r["id"] for r in got)


def test_registered_accumulator(db):
    from tessera.functions import udfs

    udfs.register_accumulator("weighted", lambda start: (start, 0.0), lambda st, x, w: (st[0] + x * w, st[1] + w), "double", lambda st: st[0] / st[1])
    t = put(db, [("a", 1.0, 1.0), ("a", 4.0, 2.0), ("b", 5.0, 3.0)], "g string, x double, w double")
    got = rows(t.aggregate([{"$group": {"_id": "$g", "m": {"$accumulator": {"init": "weighted", "initArgs": [0.0], "accumulateArgs": ["$x", "$w"]}}}}]))
    assert {r["_id"]: r["m"] for r in got} == {"a": 3.0, "b": 5.0}


def test_bulk_and_commands(db):
    put(db, [(1, "a"), (2, "b")], "_id int, s string")
    db["t"].bulk_write([("insert_many", [{"_id": 3, "s": "c"}]), ("update_one", {"_id": 1}, {"$set": {"s": "z"}}), ("delete_one", {"_id": 2})])
    assert {r["_id"]: r["s"] for r in rows(db["t"].find())} == {1: "z", 3: "c"}
    assert db.run_command({"count": "t"}) == {"n": 2, "ok": 1} and rows(db.run_command({"distinct": "t", "key": "s"})) and "Physical Plan" in db.run_command({"explain": {"aggregate": "t", "pipeline": []}})
    assert db.run_command({"listCollections": 1}) == ["t"]


def test_export_and_load(db, tmp_path):
    schema = put(db, [(1, ["a"]), (2, None)], "_id int, v array<string>").frame.schema
    db.export(str(tmp_path))
    again = Database(db.spark)
    again.load(str(tmp_path), {"t": schema})
    assert sorted(map(str, again["t"].frame.collect())) == sorted(map(str, db["t"].frame.collect()))


def test_array_updates(db):
    t = put(db, [(1, [1, 2, 2, 3], 12)], "_id int, v array<int>, bits int")
    assert rows(t.update_many({}, {"$addToSet": {"v": {"$each": [3, 4]}}, "$bit": {"bits": {"and": 6, "or": 1}}}))[0] == {"_id": 1, "v": [1, 2, 2, 3, 4], "bits": 5}
    assert rows(t.update_many({}, {"$pullAll": {"v": [2, 9]}}))[0]["v"] == [1, 3, 4]
    assert rows(t.update_many({}, {"$pop": {"v": 1}, "$min": {"bits": 2}, "$mul": {"bits": 1}}))[0]["v"] == [1, 3]
    assert rows(t.update_many({}, {"$push": {"v": {"$each": [8, 9], "$position": 1}}, "$unset": {"bits": ""}, "$set": {"new.deep": 7}}))[0] == {"_id": 1, "v": [1, 8, 9, 3], "bits": None, "new": {"deep": 7}}


def test_lookup_keeps_equal_foreign_rows(db):
    left = put(db, [(1, ["a", "b", "a"]), (2, ["z"]), (3, None)], "_id int, keys array<string>", "l")
    put(db, [("a", 1), ("a", 1), ("b", 2)], "k string, n int", "r")
    put(db, [(["a", "a"], 1), (["a"], 1), (["c"], 3)], "k array<string>, n int", "arrays")
    got = {r["_id"]: sorted(x["n"] for x in r["m"]) for r in rows(left.aggregate([{"$lookup": {"from": "r", "localField": "keys", "foreignField": "k", "as": "m"}}]))}
    assert got == {1: [1, 1, 2], 2: [], 3: []}
    got = {r["_id"]: [x["n"] for x in r["m"]] for r in rows(left.aggregate([{"$unwind": "$keys"}, {"$group": {"_id": "$_id", "keys": {"$first": "$keys"}}}, {"$lookup": {"from": "arrays", "localField": "keys", "foreignField": "k", "as": "m"}}]))}
    assert got == {1: [1, 1], 2: []}


def test_lookup_by_arrays_shuffles_documents_once(db):
    left = put(db, [(1, [0.0, -0.0, 1.0, 1.0]), (2, [2.0, None]), (3, []), (4, [9.0])], "_id int, keys array<double>", "l")
    put(db, [(0.0, "zero"), (1.0, "one"), (1.0, "one"), (2.0, "two"), (None, "none")], "k double, n string", "r")
    put(db, [([0.0, 1.0], "a"), ([0.0, 1.0], "a"), ([2.0, 2.0], "b"), (None, "none")], "k array<double>, n string", "arrays")
    for name, want in (("r", {1: ["one", "one", "zero"], 2: ["none", "two"], 3: ["none"], 4: []}), ("arrays", {1: ["a", "a"], 2: ["b", "none"], 3: ["none"], 4: []})):
        out = left.aggregate([{"$lookup": {"from": name, "localField": "keys", "foreignField": "k", "as": "m"}}])
        assert {r["_id"]: sorted(x["n"] for x in r["m"]) for r in rows(out)} == want
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString(), "no task sorts documents to tell pairs apart"


def test_lookup_runs_an_uncorrelated_pipeline_once(db):
    left = put(db, [(1,), (2,), (3,)], "_id int", "l")
    put(db, [("x", 5), ("y", 7), ("x", 9)], "g string, n int", "r")
    stages = [{"$facet": {"by": [{"$sortByCount": "$g"}], "top": [{"$sort": {"n": -1}}, {"$limit": 1}]}}]
    df = left.aggregate([{"$lookup": {"from": "r", "pipeline": stages, "as": "s"}}])
    assert [r["s"][0]["by"][0]["_id"] for r in rows(df)] == ["x"] * 3 and rows(df)[0]["s"][0]["top"] == [{"g": "x", "n": 9}]
    ordered = rows(left.aggregate([{"$lookup": {"from": "r", "pipeline": [{"$unionWith": "r"}, {"$sort": {"n": -1}}, {"$project": {"_id": 0, "n": 1}}], "as": "s"}}]))
    assert [x["n"] for x in ordered[0]["s"]] == [9, 9, 7, 7, 5, 5]


def test_stages_inside_a_correlated_lookup(db):
    left = put(db, [("x", 1), ("y", 2), ("z", 3)], "g string, _id int", "l")
    put(db, [("x", 5, "p"), ("x", 9, "q"), ("x", 6, "p"), ("y", 7, "q")], "g string, n int, k string", "r")
    put(db, [("p", "P!"), ("q", "Q!")], "k string, name string", "names")

    def inside(*stages):
        spec = {"from": "r", "let": {"g": "$g"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$g", "$$g"]}}}, *stages], "as": "s"}
        return {r["g"]: r["s"] for r in rows(left.aggregate([{"$lookup": spec}]))}

    assert inside({"$sortByCount": "$k"})["x"] == [{"_id": "p", "count": 2}, {"_id": "q", "count": 1}]
    assert sorted(x["m"] for x in inside({"$replaceRoot": {"newRoot": {"m": "$n"}}})["x"]) == [5, 6, 9] and inside({"$replaceWith": {"m": "$n"}})["z"] == []
    assert sorted((x["_id"], x["count"]) for x in inside({"$bucket": {"groupBy": "$n", "boundaries": [0, 7, 10]}})["x"]) == [(0, 2.0), (7, 1.0)]
    ranked = inside({"$setWindowFields": {"sortBy": {"n": 1}, "output": {"r": {"$rank": {}}}}})
    assert sorted((x["n"], x["r"]) for x in ranked["x"]) == [(5, 1), (6, 2), (9, 3)] and ranked["y"][0]["r"] == 1
    parted = inside({"$setWindowFields": {"partitionBy": "$k", "sortBy": {"n": 1}, "output": {"r": {"$rank": {}}}}})
    assert sorted((x["n"], x["r"]) for x in parted["x"]) == [(5, 1), (6, 2), (9, 1)]
    assert len(inside({"$sample": {"size": 2}})["x"]) == 2 and len(inside({"$sample": {"size": 2}})["y"]) == 1
    deep = inside({"$lookup": {"from": "names", "localField": "k", "foreignField": "k", "as": "d"}}, {"$unwind": "$d"}, {"$project": {"_id": 0, "n": 1, "d": "$d.name"}})
    assert sorted((x["n"], x["d"]) for x in deep["x"]) == [(5, "P!"), (6, "P!"), (9, "Q!")] and deep["z"] == []
    deeper = inside({"$lookup": {"from": "names", "let": {"k": "$k"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$k", "$$k"]}}}], "as": "d"}})
    assert sorted((x["n"], x["d"][0]["name"]) for x in deeper["x"]) == [(5, "P!"), (6, "P!"), (9, "Q!")]
    assert inside({"$redact": {"$cond": [{"$gt": ["$n", 6]}, "$$PRUNE", "$$KEEP"]}})["y"] == []


def test_first_values_hold_no_whole_group(db):
    data = [(g, float(i * 37 % 101), i) for g in "ab" for i in range(100)] + [("c", None, 1), ("c", 2.0, None), (None, 1.0, 1)]
    t = put(db, data, "g string, v double, i int")
    df = t.aggregate([{"$sort": {"i": -1}}, {"$group": {"_id": "$g", "top": {"$topN": {"n": 2, "sortBy": {"v": -1}, "output": "$i"}}, "bottom": {"$bottomN": {"n": 2, "sortBy": {"v": 1}, "output": "$v"}}, "f": {"$firstN": {"n": 3, "input": "$i"}}, "l": {"$lastN": {"n": 2, "input": "$i"}}, "hi": {"$maxN": {"n": 2, "input": "$v"}}, "lo": {"$minN": {"n": 2, "input": "$i"}}, "n": {"$sum": 1}}}])
    got = {r["_id"]: r for r in rows(df)}
    best = sorted(range(100), key=lambda i: -(i * 37 % 101))[:2]
    assert got["a"]["top"] == best and got["a"]["bottom"] == sorted(i * 37 % 101 for i in range(100))[-2:] and got["a"]["hi"] == [float(i * 37 % 101) for i in best]
    assert got["b"]["f"] == [99, 98, 97] and got["b"]["l"] == [1, 0] and got["b"]["lo"] == [0, 1] and got["b"]["n"] == 100
    assert got["c"]["hi"] == [2.0] and got["c"]["lo"] == [1] and got[None]["f"] == [1] and got["c"]["top"] == [None, 1]
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString(), "limited before the shuffle"


def test_facet_leaves_no_cache(spark):
    db = Database(spark, "/root/testdata/sf0.001")
    db["orders"].aggregate([{"$facet": {"a": [{"$match": {"o_totalprice": {"$gt": 1000}}}, {"$count": "n"}], "b": [{"$sortByCount": "$o_orderstatus"}]}}]).collect()
    plan = db["orders"].aggregate([{"$match": {"o_totalprice": {"$gt": 1000}}}])._jdf.queryExecution().toString()
    assert "InMemoryTableScan" not in plan and "PushedFilters: [IsNotNull(o_totalprice)" in plan


def test_merge_writes_nulls_and_wants_unique_keys(db):
    from tessera.operators.updates import merge_into

    old, new = put(db, [(1, "a", 1), (2, "b", 2)], "_id int, s string, n int", "o").frame, put(db, [(1, None)], "_id int, s string", "n").frame
    assert sorted(map(tuple, merge_into(old, new, ["_id"]).collect())) == [(1, None, 1), (2, "b", 2)]
    with pytest.raises(PipelineError) as e:
        merge_into(old, new.union(new), ["_id"])
    assert e.value.code == 11000


def test_one_row_needs_a_key_of_its_own(db):
    t = put(db, [(1, 5), (1, 6), (2, 7)], "_id int, n int")
    for write in (lambda: t.update_one({}, {"$set": {"n": 0}}), lambda: t.delete_one({"n": 6}), lambda: t.replace_one({}, {"n": 0})):
        with pytest.raises(PipelineError) as e:
            write()
        assert e.value.code == 11000
    assert {r["n"] for r in rows(t.update_one({"n": 7}, {"$set": {"n": 8}}))} == {5, 6, 8}


def test_many_literal_rows(db):
    data = [{"_id": i, "a": {"b": i}} if i % 2 else {"_id": i, "c": "x"} for i in range(2000)]
    got = db.aggregate([{"$documents": data}])
    assert got.count() == 2000 and got.where("c = 'x'").count() == 1000 and got.agg({"_id": "max"}).first()[0] == 1999
    t = put(db, [(-1, "y")], "_id int, c string").insert_many([{"_id": i, "c": "x"} for i in range(1500)])
    assert t.count() == 1501


def test_sparse_and_partial_keys(db):
    for rule, ok, bad in (({"keys": ["k"], "sparse": True}, {"_id": 4, "k": None}, {"_id": 5, "k": 1}), ({"keys": ["k"], "partial": {"_id": {"$lt": 10}}}, {"_id": 40, "k": 1}, {"_id": 5, "k": 1})):
        db.create("t", unique=[rule])
        t = put(db, [(1, 1), (2, None), (3, 7)], "_id int, k int")
        t.insert_many([ok])
        with pytest.raises(PipelineError) as e:
            t.insert_many([bad])
        assert e.value.code == 11000


def test_geometry_by_edges(db):
    notch = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [2, 1], [0, 4], [0, 0]]]}
    ring = {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], [[3, 3], [6, 3], [6, 6], [3, 6], [3, 3]]]}
    lines = put(db, [("across", ("LineString", [[0.5, 2.0], [3.5, 2.0]])), ("low", ("LineString", [[0.5, 0.5], [3.5, 0.5]])), ("hole", ("LineString", [[1.0, 4.0], [8.0, 4.0]])), ("dots", ("MultiPoint", [[0.5, 2.0], [3.5, 2.0]]))], "_id string, at struct<type:string,coordinates:array<array<double>>>", "lines")
    within = lambda t, g: {r["_id"] for r in rows(t.find({"at": {"$geoWithin": {"$geometry": g}}}))}
    meets = lambda t, g: {r["_id"] for r in rows(t.find({"at": {"$geoIntersects": {"$geometry": g}}}))}
    assert within(lines, notch) == {"low", "dots"} and within(lines, ring) == {"across", "low", "dots"}
    assert meets(lines, {"type": "LineString", "coordinates": [[2, 0], [2, 1.5]]}) == {"low"} and meets(lines, {"type": "MultiLineString", "coordinates": [[[2, 1.9], [2, 2.1]], [[50, 50], [51, 51]]]}) == {"across"}
    assert meets(lines, {"type": "Point", "coordinates": [2, 2]}) == {"across"} and meets(lines, {"type": "MultiPoint", "coordinates": [[3.5, 2], [70, 70]]}) == {"across", "dots"}
    assert meets(lines, {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 0.5]}, {"type": "LineString", "coordinates": [[7, 3], [7, 5]]}]}) == {"low", "hole"}
    areas = put(db, [("big", ("Polygon", [[[-1.0, -1.0], [20.0, -1.0], [20.0, 20.0], [-1.0, 20.0], [-1.0, -1.0]]])), ("round", ("Polygon", [[[2.0, 2.0], [7.0, 2.0], [7.0, 7.0], [2.0, 7.0], [2.0, 2.0]]])), ("open", ("Polygon", [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0], [0.0, 0.0]], [[2.0, 2.0], [7.0, 2.0], [7.0, 7.0], [2.0, 7.0], [2.0, 2.0]]]))], "_id string, at struct<type:string,coordinates:array<array<array<double>>>>", "areas")
    assert within(areas, ring) == {"open"}, "an area around a hole isn't within"
    assert meets(areas, {"type": "Point", "coordinates": [4.5, 4.5]}) == {"big", "round"}, "the inside of a row's hole is outside"
    assert meets(areas, {"type": "Polygon", "coordinates": [[[4, 4], [5, 4], [5, 5], [4, 4]]]}) == {"big", "round"}
    parts = put(db, [("two", ("MultiPolygon", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], [[[8.0, 8.0], [9.0, 8.0], [9.0, 9.0], [8.0, 8.0]]]]))], "_id string, at struct<type:string,coordinates:array<array<array<array<double>>>>>", "parts")
    assert meets(parts, {"type": "LineString", "coordinates": [[3, 6], [6, 3]]}) == set() and meets(parts, {"type": "LineString", "coordinates": [[0.5, -1], [0.5, 5]]}) == {"two"}, "no edge joins two parts"
