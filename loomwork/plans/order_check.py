"""Modify-order check: gather the facts of a request, reject by the first matching rule, else accept.

The procedure handles one request; here every request is a row and every
variable a column. A rejected request changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.aggregates import to_wide
from loomwork.operators.changes import odometer
from loomwork.operators.hot import numbered
from loomwork.operators.joins import left_lookup
from loomwork.plans.rules import Rule, first_rule
from loomwork.sources.tables import staged

# Product, bandwidths, types and result texts.
FTTP = "Generic Ethernet Access - FTTP"
SWAP_KEY = "2.5G_ONTbox-swap"
HIGH_BANDWIDTHS = ("2500Mbit/s", "3300Mbit/s", "5500Mbit/s", "8500Mbit/s")
MIDDLE_BANDWIDTHS = ("1200Mbit/s", "1800Mbit/s")
SINGLE_PORT_TYPES = ("SDX 611q GPON ONU", "G-010G-T")
TYPE_BY_MAKER = {"NOKIA": "G-010G-T", "ADTRAN": "SDX 611q GPON ONU"}
NOT_COMPATIBLE = ("The requested service is not compatible with the network infrastructure serving "
                  "the end customer premises.")
INSTALLATION = "Incompatible Installation exists"
OPEN_ORDER = "Order rejected due to conflicting open order"
INSTALL_ONLY = "The requested service can only be ordered as part of an End Customer Install"
NEW_PORT_LAYOUT = "XGSPON_1+0ONT"


def _q(*values: str) -> str:
    return ", ".join(f"'{v}'" for v in values)


# tests that many rules share; each is a column, worked out once per request
TESTS = {
    "is_modify": "sub_order_type like '%Modify%'",
    "to_middle": f"down in ({_q(*MIDDLE_BANDWIDTHS)}) and up = '120Mbit/s'",
    "to_high": f"down in ({_q(*HIGH_BANDWIDTHS)})",
    "no_xgs": "coalesce(bandwidth, '') <> 'XGSPON'",
}
MODIFY, TO_MIDDLE, TO_HIGH, NOT_XGS = TESTS
SWAP = f"coalesce(lookup_key, '') = '{SWAP_KEY}'"


def _reject(code: str, text: str) -> dict[str, str]:
    return {"code": f"'{code}'", "reason": text if text.startswith("concat") else f"'{text}'"}


VISIT = "concat('The Site Visit Reason of ', site_visit, ' is not available for this product.')"

RULES: list[Rule] = [
    (f"coalesce(behaviour, '') = '9739-Incompatible infrastructure' and model = '2.5G' and {MODIFY}", _reject("9739", NOT_COMPATIBLE)),
    (f"coalesce(model, '') = '' and {MODIFY} and {TO_MIDDLE}", _reject("9739", NOT_COMPATIBLE)),
    (f"ports > 1 and working > 1 and model = '2.5G' and {MODIFY}", _reject("113", INSTALLATION)),
    (f"model = '2.5G' and {MODIFY} and voice >= 1", _reject("113", INSTALLATION)),
    ("has_open_order", _reject("7006", OPEN_ORDER)),
    (f"{MODIFY} and site_visit in ('Standard', 'Premium') and coalesce(reference, '') <> '' and coalesce(lookup_key, '') = '' "
     f"and not {TO_HIGH}", _reject("9779", VISIT)),
    (f"{MODIFY} and site_visit in ('Premium', 'Advanced') and coalesce(reference, '') <> '' and {SWAP}", _reject("9779", VISIT)),
    (f"{MODIFY} and coalesce(reference, '') <> '' and {SWAP} and site_visit = 'No site visit'", _reject("9764", INSTALL_ONLY)),
    (f"{TO_HIGH} and {NOT_XGS} and site_visit = 'No site visit' and working = 1", _reject("9764", INSTALL_ONLY)),
    (f"{TO_HIGH} and {NOT_XGS} and site_visit in ('Premium', 'Advanced') and working = 1 "
     "and coalesce(type, '') <> 'SDX 610s GPON SFP ONU'", _reject("9779", VISIT)),
    (f"{TO_HIGH} and bandwidth = 'XGSPON' and site_visit = 'Standard'", _reject("9779", VISIT)),
    (f"{TO_HIGH} and site_visit in ('Standard', 'Premium') and working > 1", _reject("113", INSTALLATION)),
    (f"{TO_HIGH} and site_visit = 'Standard' and working = 1 and coalesce(xgs_enabled, '') <> 'Y' and {NOT_XGS}", _reject("113", INSTALLATION)),
    (f"{TO_HIGH} and voice >= 1 and (coalesce(model, '') = '1G' or coalesce(bandwidth, '') = '1G')", _reject("113", INSTALLATION)),
    (f"{TO_HIGH} and maker in ('Huawei', 'ECI') and working = 1 and site_visit = 'Standard' and {NOT_XGS}", _reject("9739", NOT_COMPATIBLE)),
    (f"{TO_HIGH} and type = 'SDX 610s GPON SFP ONU' and working = 1 and site_visit in ('Standard', 'Advanced', 'Premium')",
     _reject("9739", NOT_COMPATIBLE)),
    (f"{TO_HIGH} and {NOT_XGS} and site_visit = 'Standard' and working = 1 and coalesce(behaviour, '') = '7006-Conflicting open order'",
     _reject("7006", OPEN_ORDER)),
]


def gather_facts(requests: DataFrame, units: DataFrame, ports: DataFrame, addresses: DataFrame, exchange_params: DataFrame,
                 order_params: DataFrame, switch_on: bool) -> DataFrame:
    """Requests with everything the rules look at, one row each.

    Every side is reduced to one row per key before it is joined. Many requests have no serial or open order; they are dealt by what tells requests apart.
    """
    ident = ["order_number", "request_ts", "service_id"]
    by_reference = units.groupBy("reference").agg(F.max("serial").alias("__serial"))
    out = left_lookup(requests, by_reference, ["reference"], ident)
    out = out.withColumn("serial", F.coalesce(F.nullif("serial", F.lit("")), F.col("__serial"))).drop("__serial")
    working = F.col("status") == "W"
    port_facts = ports.groupBy("serial").agg(
        F.count(F.lit(1)).alias("ports"), F.count_if(working).alias("working"),
        F.count_if(working & F.col("service_id").like("OFVA%")).alias("voice"),
        F.min(F.when(F.col("inflight_order") != "", F.col("inflight_order"))).alias("inflight"))
    unit_facts = units.groupBy("serial").agg(*[F.max(c).alias(c) for c in ("type", "bandwidth", "maker")])
    exchange = to_wide(exchange_params, "exchange", "name", "value", ["ONTmodel", "XGS_Enabled", "L2SManufacturer"])
    behaviour = (order_params.where("name = 'OrderBehaviour'").groupBy("order_number")
                 .agg(F.max("value").alias("behaviour")))
    known = order_params.select(F.col("order_number").cast("string").alias("inflight")).distinct().withColumn("__known", F.lit(True))
    place = addresses.groupBy("address_key").agg(F.max("exchange").alias("exchange"))
    out = left_lookup(left_lookup(out, port_facts, ["serial"], ident), unit_facts, ["serial"], ident)
    out = out.join(place, "address_key", "left").join(exchange, "exchange", "left").join(behaviour, "order_number", "left")
    out = left_lookup(out, known, ["inflight"], ident)
    out = out.na.fill(0, ["ports", "working", "voice"])
    model = F.col("ONTmodel")
    if switch_on:
        model = F.when(F.coalesce(model, F.lit("")) == "", "2.5G").otherwise(model)
    return out.select(
        "request_ts", "order_number", "service_id", "address_key", "serial", "reference", "sub_order_type", "product", "site_visit",
        "down", "up", "ports", "working", "voice", "type", "bandwidth", "behaviour",
        F.coalesce(F.nullif("maker", F.lit("")), "L2SManufacturer").alias("maker"), F.col("L2SManufacturer").alias("l2s_maker"),
        F.col("XGS_Enabled").alias("xgs_enabled"), model.alias("model"), F.coalesce("__known", F.lit(False)).alias("has_open_order"))


def decide(facts: DataFrame) -> DataFrame:
    """Facts with ``code``, ``reason``, ``lookup_key`` and the kind of swap.

    The swap key is settled between the rules, so it is a column before they run.
    """
    checked = F.col("product") == FTTP
    facts = facts.withColumns({name: F.expr(test) for name, test in TESTS.items()})
    several = F.expr(f"ports > 1 and model = '2.5G' and working = 1 and {MODIFY} and {TO_MIDDLE}")
    single = F.expr(f"type not in ({_q(*SINGLE_PORT_TYPES)}) and model = '2.5G' and working = 1 and {MODIFY} and {TO_MIDDLE}")
    # a request that an early rule turns away never gets to the swap step
    early = F.expr(" or ".join(f"coalesce({condition}, false)" for condition, _ in RULES[:5]))
    out = facts.withColumns({"early": early, "several": F.coalesce(several, F.lit(False)), "single": F.coalesce(single, F.lit(False))})
    out = out.withColumn("swaps_box", F.coalesce(checked, F.lit(False)) & ~F.col("early") & (F.col("several") | F.col("single")))
    out = out.withColumns({"lookup_key": F.when(F.col("swaps_box"), SWAP_KEY), "prunes_ports": F.col("swaps_box") & F.col("several")})
    out = first_rule(out, [(f"product = '{FTTP}' and {c}", new) for c, new in RULES], ["code", "reason"])
    xgs = F.expr(f"{TO_HIGH} and site_visit = 'Standard' and working = 1 and {NOT_XGS} and coalesce(xgs_enabled, '') = 'Y' "
                 f"and product = '{FTTP}'")
    accepted = F.col("code").isNull()
    kind = F.when(accepted & F.col("lookup_key").isNotNull(), "box").when(accepted & F.coalesce(xgs, F.lit(False)), "xgs")
    return out.withColumn("swap", kind).drop(*TESTS, "early", "several", "single", "swaps_box")


def with_new_serials(decided: DataFrame, prefix: str = "ALCLF101", letters: str = "AA", number: int = 1) -> DataFrame:
    """Accepted swaps get the next serials in the order of the requests."""
    swaps = decided.where("swap is not null")
    swaps = numbered(swaps.select("order_number", "request_ts"), [], ["request_ts", "order_number"], "__n")
    swaps = swaps.select("order_number", odometer(F.col("__n") - 1, prefix, letters, number).alias("new_serial"))
    return decided.join(swaps, "order_number", "left")


def check_orders(requests: DataFrame, units: DataFrame, ports: DataFrame, addresses: DataFrame, exchange_params: DataFrame,
                 order_params: DataFrame, switch_on: bool) -> DataFrame:
    """All requests with decision, swap and new serial.

    The decisions are staged as several steps read them, the facts as the rules read each of them many times (without it a quarter slower).
    """
    facts = staged(gather_facts(requests, units, ports, addresses, exchange_params, order_params, switch_on), "order_facts")
    return with_new_serials(staged(decide(facts), "order_decisions"))


def result_rows(decided: DataFrame) -> DataFrame:
    """One row per request: serial, reason, code, lookup key and (when accepted) the reference."""
    return decided.select(
        "order_number", F.coalesce("new_serial", "serial").alias("serial"), "reason", "code", "lookup_key",
        F.when(F.col("code").isNull(), F.col("reference")).alias("reference"))


def change_set(decided: DataFrame, units: DataFrame, ports: DataFrame, run_ts: str) -> DataFrame:
    """What the accepted swaps do to the unit and port tables, one row per touched row.

    ``box``: the unit keeps its reference and gets the new serial and, by maker,
    a new type; of its ports only the first stays. ``xgs``: unit and ports go,
    and a new unit with one port comes.
    """
    swaps = decided.where("swap is not null").select(
        "order_number", "service_id", "swap", "serial", "reference", "new_serial", "prunes_ports", "l2s_maker")
    box, xgs = swaps.where("swap = 'box'"), swaps.where("swap = 'xgs'")
    new_type = F.lit(None).cast("string")
    for maker, kind in TYPE_BY_MAKER.items():
        new_type = F.when(F.col("l2s_maker") == maker, F.lit(kind)).otherwise(new_type)
    by_serial = units.select("serial", F.col("type").alias("old_type")).groupBy("serial").agg(F.max("old_type").alias("old_type"))
    nothing = F.lit(None).cast("string")

    def rows(df, table, action, serial, port, type_, service, order, installed=nothing):
        return df.select(F.lit(table).alias("table_name"), F.lit(action).alias("action"), F.col("serial").alias("old_serial"),
                         port.cast("string").alias("port"), serial.alias("new_serial"), type_.alias("type"),
                         service.alias("service_id"), order.alias("inflight_order"), installed.alias("installed"),
                         F.when(F.lit(action) != "delete", "I").alias("status"))

    order, new = F.col("order_number"), F.col("new_serial")
    # units are found by reference, so a request without one changes no unit
    box_units = box.where("coalesce(reference, '') <> ''").join(by_serial, "serial", "left")
    box_ports = box.join(ports.select("serial", "port", "port_type", F.col("service_id").alias("port_service")), "serial")
    box_ports = numbered(box_ports, ["order_number"], ["port", "port_type", "port_service"], "__rn")
    box_ports = box_ports.withColumn("__stays", ~F.col("prunes_ports") | (F.col("__rn") == 1))
    old_ports = xgs.join(ports.select("serial", "port"), "serial")
    return (rows(box_units, "units", "update", new, nothing, F.coalesce(new_type, F.col("old_type")), nothing, order,
                 F.when(new_type.isNotNull(), F.lit(run_ts)))
            .unionByName(rows(box_ports.where("__stays"), "ports", "update", new, F.col("port"), nothing, F.col("port_service"), order))
            .unionByName(rows(box_ports.where("not __stays"), "ports", "delete", nothing, F.col("port"), nothing, nothing, nothing))
            .unionByName(rows(old_ports, "ports", "delete", nothing, F.col("port"), nothing, nothing, nothing))
            .unionByName(rows(xgs, "units", "delete", nothing, nothing, nothing, nothing, nothing))
            .unionByName(rows(xgs, "units", "insert", new, nothing, F.lit(NEW_PORT_LAYOUT), nothing, order))
            .unionByName(rows(xgs, "ports", "insert", new, F.lit(1), nothing, F.col("service_id"), order)))
