"""Left joins whose rows mostly have no key, or one key."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.catalog.derived import frame
from loomwork.catalog.registry import Tables
from loomwork.operators.joins import bundle_values, left_lookup
from loomwork.plans import delay_details as dd
from loomwork.plans.order_check import gather_facts


@pytest.fixture
def plain_plans(spark):
    """No broadcast and no adaptive changes, so that rows lie where the join dealt them."""
    put = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def most_in_a_task(df):
    return max(Counter(r["__at"] for r in df.withColumn("__at", F.spark_partition_id()).collect()).values())


def test_left_lookup_is_a_left_join(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 1), (4, None, None), (5, "", 2), (5, "", 2), (None, None, None)], "id int, k string, n int")
    facts = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, 1, "z"), ("", 2, "b"), (None, None, "c")], "k string, n int, fact string")
    for keys in (["k"], ["k", "n"]):
        other = facts.select(*keys, "fact")
        got = left_lookup(df, other, keys, ["id"]).select("id", "k", "n", "fact")
        want = df.join(other, keys, "left").select("id", "k", "n", "fact")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_left_lookup_wants_one_type(spark):
    with pytest.raises(ValueError, match="one type"):
        left_lookup(spark.range(1), spark.range(1).withColumn("id", F.col("id").cast("int")), ["id"], ["id"])


def test_requests_without_an_open_order_are_dealt_out(spark, plain_plans):
    requests = spark.createDataFrame(
        [(datetime.datetime(2024, 1, 1), n, "SV", n % 9, None, None, "-", "-", "-", "-", "-") for n in range(400)],
        "request_ts timestamp, order_number long, service_id string, address_key int, serial string, reference string, sub_order_type string, product string, "
        "site_visit string, down string, up string")
    units = spark.createDataFrame([("R", "S", "t", "b", "m")], "reference string, serial string, type string, bandwidth string, maker string")
    ports = spark.createDataFrame([("S", 1, "W", "V", "7")], "serial string, port int, status string, service_id string, inflight_order string")
    addresses = spark.createDataFrame([(1, "EX")], "address_key int, exchange string")
    exchanges = spark.createDataFrame([("EX", "ONTmodel", "1G")], "exchange string, name string, value string")
    params = spark.createDataFrame([(7, "OrderBehaviour", "x")], "order_number long, name string, value string")
    facts = gather_facts(requests, units, ports, addresses, exchanges, params, False)
    assert facts.count() == 400 and facts.where("has_open_order").count() == 0
    assert most_in_a_task(facts) < 200


def test_requests_without_a_linked_order_are_dealt_out(spark, plain_plans):
    requests = spark.createDataFrame([(n, f"O{n}", "565 - Delay") for n in range(400)], "request_id long, order_number string, reason string")
    params = spark.createDataFrame([("X1", "ProductName", "SBS")], "order_number string, name string, value string")
    pending = spark.createDataFrame([("G1", "SubType", "Provide")], "key string, name string, value string")
    by_order = spark.createDataFrame([("X1", "G1", "SubType", "Provide")], "order_number string, ref string, name string, value string")
    rows = dd._slots(dd.context(requests, params, pending, by_order), params)
    assert rows.count() == 400
    assert most_in_a_task(rows) < 200


def shuffles_with(df, column):
    """The shuffles of the plan that move ``column``."""
    def walk(node):
        kids = node.children()
        own = node.nodeName() == "Exchange" and any(node.output().apply(i).name() == column for i in range(node.output().size()))
        return own + sum(walk(kids.apply(i)) for i in range(kids.size()))
    return walk(df._jdf.queryExecution().executedPlan())


def delay_tables(spark):
    """Two linked orders, a bundle, an order without attributes, requests that come twice or name no order."""
    requests = spark.createDataFrame(
        [(1, "G1", "9775 - Visit"), (1, "G1", "9775 - Visit"), (2, "W1", "565 - Delay"), (3, "M1", "565 - Delay"), (4, "X9", "565 - Delay"), (5, None, "565 - Delay")],
        "request_id long, order_number string, reason string")
    values = {"G1": {"ProductName": dd.dr.GEA, "SIM2Marker": "Y", "GeSSLoggingRef": "RG", "LinkedOrderReference": "L"},
              "W1": {"ProductName": dd.dr.WLR, "SIM2Marker": "Y", "GeSSLoggingRef": "RW", "LinkedOrderReference": "L", "SMPFLinkOrdRef": "L", "TargetLineServiceID": "T"},
              "M1": {"ProductName": dd.dr.MPF, "BundleId": "B", "Arrivalslot": ""}, "M2": {"ProductName": "SBS", "BundleId": "B", "Arrivalslot": "PM", "RingAhead": "ring"}}
    rows = [(o, n, v) for o, named in values.items() for n, v in named.items()] + [("G1", "SIM2Marker", "N"), (None, "ProductName", dd.dr.GEA)]
    params = spark.createDataFrame(rows, "order_number string, name string, value string")
    pending = spark.createDataFrame([("RG", "SubType", " "), ("RG", "SIM2PCPOnly", "Y"), ("RW", "delayNoteCode", "577"), ("RW", "SubType", "Provide")], "key string, name string, value string")
    by_order = spark.createDataFrame([("G1", "RG", "SubType", "Migration"), ("W1", "RW", "ReappointmentReqd", "CP"), ("W1", "RG", "ReappointmentReqd", "no")],
                                     "order_number string, ref string, name string, value string")
    return requests, params, pending, by_order


def test_orders_are_looked_up_by_their_keys(spark):
    requests, params, pending, by_order = delay_tables(spark)
    rows = dd._slots(dd.context(requests, params, pending, by_order), params)
    got = {r.request_id: r for r in rows.collect()}
    assert rows.count() == 6
    g, w, m = got[1], got[2], got[3]
    assert (g.order2, g.ref, g.product2, g.migrate, g.pcp_only, g.temp_code, g.mpf_reappt, g.target_dn) == ("W1", "RW", dd.dr.WLR, "Migration", "Y", "577", "CP", "Y")
    assert (w.order2, w.ref, w.product2, w.migrate, w.target_dn) == ("G1", "RG", dd.dr.GEA, "Provide", "N")
    assert (m.order2, m.arrival_slot, m.ring_ahead, m.closure) == (None, "PM", "ring", "")
    for other in (got[4], got[5]):
        assert (other.product, other.marker, other.order2, other.ref, other.migrate, other.pcp_only, other.arrival_slot) == (None, "N", None, None, "N", "N", "")


def test_requests_are_shuffled_once_for_all_facts_of_their_order(spark, plain_plans):
    """Each lookup shuffled the whole request with all attributes found so far: eight times."""
    requests, params, pending, by_order = delay_tables(spark)
    rows = dd._slots(dd.context(requests, params, pending, by_order), params)
    assert shuffles_with(rows, "reason") == 1 and shuffles_with(rows, "placed") <= 1


def test_bundle_values_shuffle_one_row_per_owner(spark, plain_plans):
    params = spark.createDataFrame([("o1", "BundleId", "b"), ("o2", "BundleId", "b"), ("o1", "A", "2"), ("o1", "A", "3"), ("o2", "A", "1"), ("o2", "C", ""), ("o3", "A", "0")],
                                   "order_number string, name string, value string")
    found = bundle_values(params, "order_number", "name", "value", "BundleId", ["A", "C"])
    assert [tuple(r) for r in found.collect()] == [("b", "1", None)]
    assert shuffles_with(found, "value") == 0


def test_derived_rows_are_made_in_small_tasks(spark, tmp_path):
    spark.range(1000).selectExpr("id as o_orderkey", "id % 7 as o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    t = Tables(spark, str(tmp_path))
    whole, dealt = frame(t, "pending"), frame(t, "pending", 50)
    assert whole.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == 20
    assert sorted(whole.collect()) == sorted(dealt.collect())
