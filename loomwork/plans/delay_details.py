"""Delay details: context of a request, rule lookup by release, patches, stage gate, sequence and audit.

Requests are rows. A request takes branch ``a`` (severed link, code 9580 on a
linked order), ``b`` (linked order delayed, code 9494) or ``c`` (all others);
a branch-a request goes on into branch c and so has two result rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.dates import COMMITMENT_SHIFT, SURVEY_SHIFT, calendar_days, shifted_text
from loomwork.functions.structured import without_note
from loomwork.functions.text import queue_head
from loomwork.operators.aggregates import to_wide
from loomwork.operators.hot import numbered
from loomwork.operators.joins import bundle_values, left_lookup, with_fallback
from loomwork.plans import delay_rules as dr
from loomwork.plans.eligibility import area_valid
from loomwork.plans.rules import apply_rules, bind, names_in
from loomwork.sources.tables import staged

# What tells orders apart; those without a linked order, a reference or a bundle are dealt by it.
IDENT = ["order_number"]

# Attribute name -> column, for everything the job reads about the order itself.
OWN = {
    "ProductName": "product", "SIM2Marker": "own_marker", "GeSSLoggingRef": "own_ref", "LinkedOrderReference": "link_ref",
    "SMPFLinkOrdRef": "smpf_ref", "FTTPOrderStages": "fttp_stages", "IsSubsequentProvide": "successional",
    "OrderPlacedDate": "placed", "CommitmentDate": "commitment", "RequiredByDate": "required_by", "Arrivalslot": "own_slot",
    "RingAhead": "own_ring", "TaskClosureReason": "own_closure", "BundleId": "bundle", "TRCBand": "own_trc",
    "TRCChargeBand": "own_charge", "Reach": "reach", "EADSet9709DelayReach": "delay_reach", "Newsitesactivities": "site_activities",
    "Complexplanningactivities": "complex_activities", "RecommendMinSvrExistingLine": "min_visit", "PTW9931_541Flag": "ptw",
    "KCIDelaycodes": "queue", "FTTPOnDemand": "on_demand", "ConfiguredKCIDelayReason": "configured",
    "DelayRef9561": "ref_9561", "DelayRef588": "ref_588",
}
OTHER = {"GeSSLoggingRef": "ref2", "ProductName": "product2", "TargetLineServiceID": "target_line", "TargetAccessLineId": "target_access"}
# What the links of an order to others are found by.
KEYS = ("ProductName", "SIM2Marker", "GeSSLoggingRef", "LinkedOrderReference", "SMPFLinkOrdRef")
PENDING = ("SubType", "SIM2PCPOnly", "ReappointmentReqd", "delayNoteCode", "LastDelayNoteCode", "KCI9652Notes")

# Product -> (attribute with the link value, attributes of the other order, products of the other order).
LINKS = {
    dr.GEA: ("link_ref", ("LinkedOrderReference", "SMPFLinkOrdRef"), (dr.MPF, dr.WLR)),
    dr.MPF: ("link_ref", ("LinkedOrderReference",), (dr.GEA,)),
    dr.WLR: ("smpf_ref", ("LinkedOrderReference",), (dr.GEA, dr.SMPF)),
    dr.SMPF: ("link_ref", ("SMPFLinkOrdRef",), (dr.WLR,)),
}

RESULT = {
    "AdditionalNotesXML": "notes_xml", "AppointmentReqd": "appointment", "delayNoteCode": "code", "delayNotes": "notes",
    "delayNoteText": "text", "delayNoteType": "type", "KCIDelayReason": "subsequent", "ReappointmentReqd": "reappt",
    "delayAmendReason": "amend_reason", "AmendRequired": "amend_required", "delayConfirmationRequired": "confirmation",
    "DeemedConsent": "consent", "EngineerNotes": "engineer_notes", "DelayNoteFormat": "note_format", "DelaySequenceNumber": "seq",
    "OrderItemNoteType": "item_type", "OrderItemNoteText": "item_text", "NoteCode": "note_code", "NoteText": "note_text",
    "NoteType": "note_type",
}
RESULT_C = RESULT | {
    "LO_DelayReason": "lo_reason", "externalNotes": "external_notes", "SIM2PCPOnly": "pcp_only", "EUConfirmedDelay": "eu_confirmed",
    "EUOrOpenreachMissed": "missed", "9708Requested": "requested_9708", "AvailableDate2": "available_date",
    "AppointmentFailed": "appointment_failed", "isTOPdelay": "top_delay", "Nextupdatedate": "next_update", "SendEAOS": "send_eaos",
    "EngineerArrivalOnSite": "engineer_arrival", "NoAccessDateTime": "no_access",
}


def linked_orders(params: DataFrame) -> DataFrame:
    """Per link value and product that asks: the other order (the smallest). ``(ask, link, order2)``.

    An order of the asking product is never among the products looked for, so
    no order finds itself; the pairs of orders are never built.
    """
    product = params.where("name = 'ProductName'").select("order_number", F.col("value").alias("p"))
    ends = params.where("name in ('LinkedOrderReference', 'SMPFLinkOrdRef')").join(product, "order_number")
    asks = F.array(*[F.when(F.col("name").isin(*names) & F.col("p").isin(*wanted), F.lit(ask))
                     for ask, (_, names, wanted) in LINKS.items()])
    ends = ends.select(F.explode(F.filter(asks, lambda a: a.isNotNull())).alias("ask"), F.col("value").alias("link"), "order_number")
    return ends.groupBy("ask", "link").agg(F.min("order_number").alias("order2"))


def pending_wide(pending: DataFrame, keys: Sequence[str], prefix: str, names: Sequence[str]) -> DataFrame:
    wide = pending.where(F.col("name").isin(*names)).groupBy(*keys).pivot("name", list(names)).agg(F.max("value"))
    return wide.withColumnsRenamed({n: f"{prefix}{n}" for n in names})


def _marked(rows: DataFrame) -> DataFrame:
    """With ``marker`` and ``lorn``, the link value by which the other order is looked for."""
    p = F.col("product")
    family = p.isin(*LINKS)
    rows = rows.withColumn("marker", F.when(family, F.coalesce("own_marker", F.lit("N"))).otherwise("N"))
    link = F.when(p == dr.WLR, F.col("smpf_ref")).otherwise(F.col("link_ref"))
    return rows.withColumn("lorn", F.when(family & (F.col("marker") == "Y"), F.nullif(link, F.lit(""))))


def order_facts(asked: DataFrame, params: DataFrame, pending: DataFrame, pending_by_order: DataFrame) -> DataFrame:
    """Per order of ``asked`` (``order_number``) that has attributes: the linked order and the pending values of both, ``mine_`` and ``their_``.

    Only keys go through the lookups, so that no shuffle moves the requests or the other attributes.
    """
    orders = to_wide(params, "order_number", "name", "value", list(KEYS)).withColumnsRenamed({k: OWN[k] for k in KEYS})
    orders = _marked(orders.join(asked, "order_number", "left_semi"))
    other = to_wide(params, "order_number", "name", "value", list(OTHER)).withColumnsRenamed({**OTHER, "order_number": "order2"})
    links = linked_orders(params).withColumnsRenamed({"ask": "product", "link": "lorn"})
    # the pending table is keyed by reference, the second source by order and reference
    first_own = pending_wide(pending, ["key"], "a_", ["SubType", "SIM2PCPOnly", "LastDelayNoteCode"]).withColumnRenamed("key", "own_ref")
    first_ref = pending_wide(pending, ["key"], "b_", PENDING[1:]).withColumnRenamed("key", "ref")
    second_own = pending_wide(pending_by_order, ["order_number", "ref"], "c_",
                              ["SubType", "SIM2PCPOnly", "LastDelayNoteCode"]).withColumnRenamed("ref", "own_ref")
    second_ref = (pending_wide(pending_by_order, ["order_number", "ref"], "d_", PENDING[1:])
                  .withColumnRenamed("order_number", "order2"))
    linked = orders.where("lorn is not null").select("order_number", "product", "lorn", "own_ref")
    linked = left_lookup(linked, links, ["product", "lorn"], IDENT).where("order2 is not null").drop("product", "lorn")
    linked = left_lookup(linked, other, ["order2"], IDENT).withColumn("ref", F.coalesce("ref2", "own_ref"))
    linked = left_lookup(linked, second_ref, ["order2", "ref"], IDENT).drop("ref", "own_ref")
    out = orders.select("order_number", "own_ref").join(linked, "order_number", "left")
    out = out.withColumn("ref", F.coalesce("ref2", "own_ref")).drop("ref2")
    out = left_lookup(out, first_own, ["own_ref"], IDENT).join(second_own, ["order_number", "own_ref"], "left")
    out = out.select("order_number", "order2", "ref", *[c for c in other.columns if c not in ("order2", "ref2")], *[f"d_{n}" for n in PENDING[1:]], *[
        with_fallback(F.col(f"a_{n}"), F.col(f"c_{n}")).alias(f"mine_{n}") for n in ("SubType", "SIM2PCPOnly", "LastDelayNoteCode")])
    out = left_lookup(out, first_ref, ["ref"], IDENT)
    return out.withColumns({f"their_{n}": with_fallback(F.col(f"b_{n}"), F.col(f"d_{n}")) for n in PENDING[1:]}).drop(
        *[f"{x}_{n}" for x in "bd" for n in PENDING[1:]])


def context(requests: DataFrame, params: DataFrame, pending: DataFrame, pending_by_order: DataFrame) -> DataFrame:
    """Requests with product, marker, linked order and the pending values of both orders."""
    own = to_wide(params, "order_number", "name", "value", list(OWN)).withColumnsRenamed(OWN)
    facts = order_facts(requests.select("order_number").distinct(), params, pending, pending_by_order)
    p = F.col("product")
    family = p.isin(*LINKS)
    out = _marked(requests.join(own, "order_number", "left").join(facts, "order_number", "left"))

    def mine(name):
        return F.col(f"mine_{name}")

    def theirs(name):
        return F.col(f"their_{name}")

    known = F.coalesce("ref", F.lit("")) != ""
    return out.withColumns({
        "migrate": F.when(family, mine("SubType")).otherwise("N"),
        "pcp_only": (F.when(p == dr.GEA, mine("SIM2PCPOnly")).when(p.isin(dr.MPF, dr.WLR) & known, theirs("SIM2PCPOnly")).otherwise("N")),
        "mpf_reappt": F.when(family & known, theirs("ReappointmentReqd")),
        "temp_code": F.when((p == dr.GEA) | ((p == dr.SMPF) & known), theirs("delayNoteCode")),
        "first_delay": F.when((p == dr.SMPF) & known, theirs("KCI9652Notes")),
        "last_note": F.when((p == dr.WLR) & (F.coalesce("own_ref", F.lit("")) != ""), mine("LastDelayNoteCode")),
        "product2": F.when(p.isin(dr.GEA, dr.WLR, dr.SMPF), F.col("product2")),
        "target_dn": F.when((p == dr.GEA) & (F.coalesce(F.nullif("target_line", F.lit("")), F.nullif("target_access", F.lit(""))).isNotNull()),
                            "Y").otherwise("N"),
        "kci": F.left("reason", F.lit(4)),
    })


def _slots(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Arrival slot, ring-ahead and closure texts: the order's own, for MPF else those of its bundle."""
    p = F.col("product")
    reads = p.isin(dr.WLR, "WLR3 PSTN Multiline Aux", dr.MPF, "WLR3 ISDN 2e Standard", "WLR3 ISDN 2e System") | (
        (p == dr.SOTAP) & F.col("reason").like("%9775%"))
    names = {"Arrivalslot": ("arrival_slot", "own_slot"), "RingAhead": ("ring_ahead", "own_ring"), "TaskClosureReason": ("closure", "own_closure")}
    found = bundle_values(params, "order_number", "name", "value", "BundleId", list(names))
    found = found.withColumnsRenamed({n: f"__{n}" for n in names})
    # the bundles of the orders that ask are looked up, so that the rows stay where they are
    asking = to_wide(params, "order_number", "name", "value", ["ProductName", "Arrivalslot", "BundleId"])
    asking = asking.where((F.col("ProductName") == dr.MPF) & (F.coalesce("Arrivalslot", F.lit("")) == "") & (F.col("BundleId") != ""))
    found = left_lookup(asking.select("order_number", F.col("BundleId").alias("bundle")), found, ["bundle"], IDENT).drop("bundle")
    out = rows.join(found, "order_number", "left")
    # one entry state for all three: the bundle is asked when the order has no slot of its own
    mine = {n: F.when(reads, F.coalesce(own, F.lit(""))).otherwise("") for n, (_, own) in names.items()}
    ask = (p == dr.MPF) & (mine["Arrivalslot"] == "") & (F.coalesce("bundle", F.lit("")) != "")
    return out.withColumns({to: F.when(ask & F.col(f"__{n}").isNotNull(), F.col(f"__{n}")).otherwise(mine[n])
                            for n, (to, _) in names.items()}).drop(*[f"__{n}" for n in names])


def date_texts(run_ts: datetime.datetime, holidays: Sequence[datetime.date] = ()) -> dict[str, str]:
    """Date texts the rules put in. They depend on the run day only, so they become literals of the rules."""
    day = run_ts.date()
    # sixty-one days, looked up here instead of joined to every request
    table = {row[0]: row for row in calendar_days(day, day + datetime.timedelta(60), holidays)}
    open_days = {open_no: on for on, is_open, open_no, _ in table.values() if is_open}
    at = table[day][2]
    plus = {n: day + datetime.timedelta(n) for n in (0, 1, 2, 5, 15, 30, 31, 40)}
    texts = {f"w{n}": open_days[at + n].strftime("%d-%m-%Y") for n in (1, 2, 3, 4, 5, 10, 14, 15, 16, 17)}
    texts |= {f"d{n}_103": plus[n].strftime("%d/%m/%Y") for n in (0, 5, 15, 30, 31, 40)}
    texts |= {f"d{n}_105": plus[n].strftime("%d-%m-%Y") for n in (1, 2)} | {"d30_iso": plus[30].isoformat(), "d40_iso": plus[40].isoformat()}
    return texts | {"next_open": table[day][3].strftime("%d/%m/%Y"), "run_stamp": run_ts.strftime("%d/%m/%Y %H:%M:%S")}


def _rule_found(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests with ``__rule``, the key of the rule that holds for reason and release (the one with the highest lower bound)."""
    release = F.coalesce(F.substring("release", 2, 5).try_cast("int"), F.lit(99999))
    small = rules.select(F.col("reason").alias("__reason"), "min_version", "max_version").distinct()
    hits = (requests.select("request_id", "reason", release.alias("__release"))
            .join(small, (F.col("reason") == F.col("__reason")) & F.col("__release").between(F.col("min_version"), F.col("max_version")))
            .groupBy("request_id").agg(F.max_by(F.struct("reason", "min_version", "max_version"), "min_version").alias("__rule")))
    return requests.join(hits, "request_id", "left")


def _rules_joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The fields of the rule found, those of its reason, and the configured one."""
    fields = [c for c in rules.columns if c not in ("reason", "min_version", "max_version", "send_eaos", "delay_type")]
    held = rules.groupBy(F.struct("reason", "min_version", "max_version").alias("__at")).agg(F.max(F.struct(*fields)).alias("__fields"))
    by_reason = rules.groupBy(F.col("reason").alias("__r")).agg(
        F.max("send_eaos").alias("rule_eaos"), F.max("delay_type").alias("delay_type"))
    set_by = rules.groupBy(F.col("reason").alias("configured")).agg(
        F.max_by(F.struct(*[F.col(c).alias(f"cfg_{c}") for c in ("reappt", "amend_required", "confirmation", "consent")]), "min_version").alias("__cfg"))
    out = (rows.join(held, F.col("__rule") == F.col("__at"), "left").join(by_reason, F.col("reason") == F.col("__r"), "left")
           .join(set_by, "configured", "left"))
    return out.select(
        *[c for c in out.columns if c not in ("__rule", "__at", "__fields", "__r", "__cfg")], F.col("__rule").isNotNull().alias("rule_found"),
        F.col("__cfg").isNotNull().alias("cfg_found"), *[F.col(f"__fields.{c}").alias(f"rule_{c}") for c in fields],
        *[F.col(f"__cfg.cfg_{c}").alias(f"cfg_{c}") for c in ("reappt", "amend_required", "confirmation", "consent")])


def prepare_requests(requests: DataFrame, params: DataFrame, pending: DataFrame, pending_by_order: DataFrame, rules: DataFrame,
                     addresses: DataFrame, exchange_params: DataFrame, answers: DataFrame, eaos_switch: bool = True) -> DataFrame:
    """Everything a rule can look at, one row per request; staged, because the branches share it."""
    scale = exchange_params.where("name = 'ScaleEnabled'").groupBy("exchange").agg(F.max("value").alias("exchange_scale"))
    # while the rows are short: what needs no attribute of the order
    rows = _rule_found(requests.join(addresses, "address_key", "left").join(scale, "exchange", "left"), rules)
    rows = _rules_joined(_slots(context(rows, params, pending, pending_by_order), params), rules)
    rows = area_valid(rows, "address_scale", "exchange_scale", "network_notes", "fttp_stages", "area_ok")
    audit = (params.where(F.col("name").like("KSUDelay-%")).groupBy("order_number")
             .agg(F.when(F.bool_or(F.split("value", r"\|")[1].isin(*dr.OR_MISSED_CODES)), "Y").otherwise("N").alias("or_missed")))
    rows = rows.join(audit, "order_number", "left")
    rows = rows.join(answers.withColumnRenamed("product", "__p"), F.col("product") == F.col("__p"), "left").drop("__p")
    p, reason = F.col("product"), F.col("reason")
    confirmed = (p.isin(dr.SOGEA, dr.GEA, dr.FTTP) & reason.like("%EU Confirmed%")) | (reason == "566 - OR Missed Appt (EU Confirmed LLU)")
    queue = F.col("queue")
    rows = rows.withColumns({
        "or_missed": F.coalesce("or_missed", F.lit("N")),
        "trc_band": (F.col("own_trc").try_cast("int") + 1).cast("string"),
        "charge_band": (F.coalesce(F.nullif("own_charge", F.lit("")), F.lit("0")).try_cast("int") + 1).cast("string"),
        "survey_day": shifted_text(F.col("placed"), SURVEY_SHIFT), "commitment_day": shifted_text(F.col("commitment"), COMMITMENT_SHIFT),
        "arrival": F.replace(F.concat(F.left("required_by", F.lit(10)), F.lit(" "), F.left(F.right("required_by", F.lit(8)), F.lit(5))),
                             F.lit("-"), F.lit("/")),
        "queue_head": queue_head(queue), "xml_without_5197": without_note(F.col("notes_xml"), "5197"),
        "eu_confirmed": F.when(confirmed, "Y").otherwise("N"),
        "requested_9708": F.when((p == dr.SOGEA) & reason.like("%9708%"), "Y").otherwise("N"),
        "top_delay": F.when(reason == "572 - Order delayed due to issue in TOP", "Y").otherwise("N"),
        "send_eaos": F.when((F.col("rule_eaos") == "Y") & F.lit(eaos_switch), "Y").otherwise("N"),
        "engineer_arrival": F.lit(None).cast("string"),
        "no_access": F.when((F.col("rule_eaos") == "Y") & F.lit(eaos_switch) & (F.col("delay_type") == "OpenReach"), ""),
        "seq": F.lit(0).cast("bigint"),
    })
    rows = rows.withColumns({c: F.expr(v) for c, v in dr.START.items()} | {"available_date": F.lit(None).cast("string")})
    # only what rules and results name goes on: below a hundred columns the rules compile into one loop
    every = [dr.SBS_START, dr.TRIGGER, dr.BRANCH_A, dr.BRANCH_B, dr.LOOKUP, dr.BEFORE_GATE, dr.GATE, dr.AFTER_GATE_B, dr.AFTER_GATE_C, dr.LATE]
    kept = (set().union(*map(names_in, every), dr.START, RESULT_C.values())
            | {"request_id", "request_ts", "order_number", "order2", "marker", "kci", "area_ok", "product", "reason"})
    return staged(rows.select(*[c for c in rows.columns if c in kept]), "delay_requests")


def delay_details(ready: DataFrame, run_ts: datetime.datetime, holidays: Sequence[datetime.date] = (),
                  first_sequence: int = 0) -> DataFrame:
    """Rows of all branches after all rules, with their sequence numbers."""
    days = date_texts(run_ts, holidays)
    ready = ready.withColumn("available_date", F.lit(days["d30_iso"]))
    done = staged(reduce(DataFrame.unionByName, _branches(ready, days)), "delay_branches")
    issued = done.where("valid <> 'N'").select("request_id", "branch", "request_ts")
    issued = numbered(issued, [], ["request_ts", "request_id", "branch"], "seq").select(
        "request_id", "branch", (F.col("seq") + first_sequence).alias("__seq"))
    issued = staged(issued, "delay_numbers")  # both halves of the union below read it
    # the late rules up to the first that looks at the number run before it is joined, so that what only they read is not shuffled
    late = bind(dr.LATE, days)
    at = next((i for i, step in enumerate(late) if "seq" in names_in([step])), len(late))

    def with_numbers(rows: DataFrame) -> DataFrame:
        return rows.join(issued, ["request_id", "branch"], "left").withColumn("seq", F.coalesce("__seq", "seq")).drop("__seq")

    early = apply_rules(done.where("branch = 'c'"), late[:at])
    return apply_rules(with_numbers(early), late[at:]).unionByName(with_numbers(done.where("branch <> 'c'")))


def _branches(ready: DataFrame, days: dict[str, str]) -> list[DataFrame]:
    marked = F.col("marker") == "Y"
    start = apply_rules(ready, dr.SBS_START)
    is_a, is_b = marked & (F.col("kci") == "9580"), marked & (F.col("kci") == "9494")
    a = apply_rules(start.where(is_a), dr.TRIGGER + dr.BRANCH_A)
    rest = a.unionByName(start.where(~F.coalesce(is_a, F.lit(False))))
    area = F.col("reason").isin(*dr.AREA_REASONS)
    rest = rest.withColumn("valid", F.when(area, F.col("area_ok")).otherwise(F.col("valid")))
    is_b = F.coalesce(is_b, F.lit(False))
    b = apply_rules(rest.where(is_b), dr.TRIGGER + dr.BRANCH_B + dr.GATE + dr.AFTER_GATE_B)
    c = apply_rules(rest.where(~is_b), dr.TRIGGER + dr.LOOKUP + bind(dr.BEFORE_GATE, days) + dr.GATE + dr.AFTER_GATE_C)
    return [df.withColumn("branch", F.lit(name)) for name, df in (("a", a), ("b", b), ("c", c))]


def result_rows(details: DataFrame) -> DataFrame:
    """The columns handed back: 20 in branches a and b, 33 in branch c (null elsewhere)."""
    in_c = F.col("branch") == "c"
    return details.select("request_id", "branch", *[
        (F.col(col) if name in RESULT else F.when(in_c, F.col(col))).alias(name) for name, col in RESULT_C.items()])


def audit_of(details: DataFrame, run_ts: datetime.datetime) -> DataFrame:
    """The audit row of every issued delay: ``(order_number, name, value)``."""
    stamp = run_ts.strftime("%Y-%m-%dT%H:%M:%S")
    return details.where("seq > 0").select(
        "order_number", F.concat(F.lit("KSUDelay-"), F.col("seq").cast("string")).alias("name"),
        F.concat(F.lit(stamp), F.lit("|"), "code", F.lit("|"), "text").alias("value"))


def param_changes(details: DataFrame) -> DataFrame:
    """Attribute changes of the branch-c rows, ready for ``changes.upsert``: ``(request_ts, order_number, name, value)``."""
    hits = F.array(*[F.when(F.expr(cond), F.struct(F.col(owner).alias("order_number"), F.lit(name).alias("name"), F.expr(value).alias("value")))
                     for cond, owner, name, value in dr.PARAM_CHANGES])
    rows = details.where("branch = 'c'").select("request_ts", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return rows.select("request_ts", "h.order_number", "h.name", "h.value")


def blanked(df: DataFrame, columns: Sequence[str], valid: Column, carried: str, reason: str) -> DataFrame:
    """Empty the columns of rows that are not valid; ``carried`` then takes the reason forward."""
    off = ~F.coalesce(valid, F.lit(False))
    return df.withColumns({c: F.when(off, "").otherwise(F.col(c)) for c in columns}
                          | {carried: F.when(off, F.col(reason)).otherwise(F.col(carried))})


