"""Tables of the delay job: rule rows, and requests and attributes made from events, orders, customers and nations."""

from __future__ import annotations

from loomwork.plans import delay_rules as dr

# Product of an order by its key, twelve in turn; orders of one dozen share a link reference.
PRODUCTS = [dr.GEA, dr.MPF, dr.WLR, dr.SMPF, dr.SOGEA, dr.FTTP, dr.SOTAP, "SBS", "EAD", "Dark Fibre Access", "PIA", "FVA"]

# (reason, note code, note text) of the configured delays.
DELAYS = [
    ("5197 - EU Missed Appt", "5197", "Appointment missed by the end user."),
    ("565 - Delay", "565", "Order is delayed."),
    ("566 - OR Missed Appt (EU Confirmed)", "566", "Appointment missed, confirmed."),
    ("567 - Capacity", "567", "Capacity delay."),
    ("569 - Delay Faulty Tie Pair Amend", "569", "Faulty tie pair."),
    ("572 - Order delayed due to issue in TOP", "572", "Delayed in processing."),
    ("577 - Duct blocked", "577", "Duct is blocked."),
    ("597 - Frames", "597", "Frames issue."),
    ("5463 - Survey", "5463", "Survey needed."),
    ("GEA - Planning or Network Survey Delay", "5463", "Planning delay."),
    ("5466 - Build", "5466", "Build delay."),
    ("5462 Survey Task", "5462", "Survey task."),
    ("9544 - Severed", "9544", "Links between the orders have been severed."),
    ("9494 - Linked order delayed.", "9494", "Linked order delayed."),
    ("9494 - Linked order delayed", "9494", "Linked order delayed."),
    ("9580 - Severed link", "9580", "Order goes on alone."),
    ("5787_Unknown_Parallel", "5787", "Band {RequiredTRCBand} is required."),
    ("9932 - Site Visit Reason and site contact details amend required", "9932", "Visit [%1] until [%2]."),
    ("9790-ORDelayUpdated", "9790", "Delay updated."),
    ("OR delay", "9999", "First of several."),
    ("9808 - Provide valid Handover Port Service ID(9543)", "9808", "Port needed."),
    ("GEA - Awaiting Network Build Activity", "5470", "Awaiting build."),
    ("9775 - Visit", "9775", "Rang %1 for slot %2, closed: %3"),
    ("9931 - Permit", "9931", "Permit %1 before %3."),
    ("8020 - Planned Work Will Delay Order", "8020", "Migration on [MigrationDate]."),
    ("8020 - Planned Work Will Delay Order Twice", "8020", "Migration on [MigrationDate]."),
    ("8016", "8016", "Available {AvailableDate_DDMMYYYY}."),
    ("8016-OrderIsOnHold2nd", "8016", "Available {AvailableDate_DDMMYYYY2}."),
    ("9404 - Note", "9404", "A note."),
    ("9520 - SBS", "9520", "Another note."),
    ("9670 - Activity", "9670", "Done by %1 00:00:00."),
    ("9666 - Activity", "9666", "Done by %2."),
    ("9648 - Activity", "9648", "Done by %2."),
    ("9668 - Activity", "9668", "Done by %2."),
    ("9667 - Activity", "9667", "Activities: %1."),
    ("9652 - Activity", "9652", "Done by %2."),
    ("9663 - Activity", "9663", "Done by %2 00:00:00."),
    ("9681 - Planning", "9681", "Activities %1 until %3."),
    ("5742 - Address Matching Delay", "5742", "Matching until %1."),
    ("9650 - Site", "9650", "Site until %2."),
    ("9709 - Reach", "9709", "Reach."),
    ("9743 - Question", "9743", "Answer before %2."),
    ("9818 - Band", "9818", "Band %1 needed."),
    ("9649 - Work", "9649", "Work %1 until %2."),
    ("Copper Route Verification (EU Confirmed)", "9700", "Verification."),
    ("9816 Sitevisit changed", "9816", "Visit changed."),
    ("5480 - FTTP EU Different Instructions", "5480", "Instructions."),
    ("9561 - ECD", "9561", "Estimated date."),
    ("9562 - ECD", "9562", "Estimated date moved."),
    ("9831 - ECD", "9831", "Estimated date again."),
    ("5750 - ECC", "5750", "Charge."),
    ("Delay_ResponseToKCINotice", "77", "Response."),
    ("593-CPDelay(SupplementaryKSU)", "593", "Provider delay."),
    ("565+9818 - Delay + insufficient TRC", "565", "Delay and band."),
    ("563 - Removal of DACS_SuppPro", "563", "Removal."),
    ("9601 - Additional build works required", "9601", "Build works."),
    ("9877-Required premium SVR", "9877", "Visit [%1] until [%2]."),
    ("9877-Required advanced SVR", "9877", "Visit [%1] until [%2]."),
    ("9902+9700_VRI Faceplate or extension kit is missing", "9902", "Kit missing."),
    ("9903+9700_IP voice is not working", "9903", "No voice."),
    ("9904+9700_Telecare device was found without Prove Telecare SVR", "9904", "Device found."),
    ("Excess Construction Charge with Ruggedised", "5750", "Charge."),
    ("593-Pinch point delay", "593", "Pinch point."),
    ("LLU_Out OF Time", "585", "Out of time."),
]

RULE_COLUMNS = ("reason", "min_version", "max_version", "notes", "type", "text", "code", "reappt", "subsequent", "amend_required",
                "amend_reason", "confirmation", "consent", "stages", "engineer_notes", "note_format", "notes_xml", "send_eaos", "delay_type")
RULE_TYPES = {"min_version": "int", "max_version": "int"}


def rule_rows() -> list[tuple]:
    """Two version ranges per reason; the columns vary so that every kind of rule finds work."""
    rows = []
    for i, (reason, code, text) in enumerate(DELAYS):
        xml = "<Note><NoteId>600</NoteId><NoteText>Band %1</NoteText></Note>" if i % 4 == 0 else (
            "<Note><NoteId>5197</NoteId><NoteType>Warning</NoteType><NoteText>Late.</NoteText></Note>" if i % 4 == 1 else "")
        for low, high in ((0, 2999), (3000, 99999)):
            early = low == 0
            rows.append((reason, low, high, "" if early else "note", "Delayed" if i % 2 else "Warning", text, code,
                         ("CPBT" if i % 3 == 0 else "A1") if early else "N", "9790-ORDelayUpdated" if reason == "OR delay" else "",
                         "N", "Re-appoint" if i % 5 == 0 else None, "Y" if i % 2 else "N", None if i % 7 else "Y",
                         (None, "KSU1,KSU2", "KSU2,KSU1.5", "", "KSU1,KSU1.5,KSU2,KSU3")[i % 5], None if early else "bring keys", "text", xml,
                         "Y" if i % 3 == 1 else "N", "OpenReach" if i % 6 == 1 else "CP"))
    return rows


def _literal(v) -> str:
    return "null" if v is None else str(v) if isinstance(v, int) else dr.q(v)


def _case(value: str, results: list[str]) -> str:
    return f"case {value} " + " ".join(f"when {i} then {dr.q(r)}" for i, r in enumerate(results)) + " end"


WIDE = """
    select o_orderkey as k, case when o_orderkey % 2 = 0 then 'OR' else 'OS' end || o_orderkey as order_number, """ + _case(
    "o_orderkey % 12", PRODUCTS) + """ as ProductName,
    case when o_custkey % 3 <> 0 then 'Y' when o_custkey % 5 = 0 then 'N' end as SIM2Marker,
    case when o_orderkey % 7 <> 0 then 'G' || o_orderkey end as GeSSLoggingRef,
    case when o_orderkey % 5 <> 4 then 'L' || cast(floor(o_orderkey / 12) as bigint) end as LinkedOrderReference,
    case when o_orderkey % 12 in (2, 3) then 'L' || cast(floor(o_orderkey / 12) as bigint) end as SMPFLinkOrdRef,
    case when o_custkey % 4 = 0 then 'T' || o_custkey when o_custkey % 4 = 1 then '' end as TargetLineServiceID,
    case when o_custkey % 7 = 0 then 'A' || o_custkey end as TargetAccessLineId,
    case o_orderstatus when 'O' then '2' when 'P' then '1' end as FTTPOrderStages,
    case when o_orderkey % 4 = 0 then 'Y' end as IsSubsequentProvide,
    cast(cast(o_orderdate as date) as string) || case when o_orderstatus = 'F' then '' else 'T09:30:00' end as OrderPlacedDate,
    case when o_custkey % 5 <> 0 then cast(cast(o_orderdate as date) as string) || 'T12:00:00' end as CommitmentDate,
    cast(cast(o_orderdate as date) as string) || 'T10:15:00' as RequiredByDate,
    case when o_orderstatus = 'F' then 'AM' when o_orderstatus = 'O' then '' end as Arrivalslot,
    case when o_custkey % 2 = 0 then 'no answer' end as RingAhead,
    case when o_custkey % 3 = 0 then 'closed' else '' end as TaskClosureReason,
    case when o_custkey % 6 <> 0 then 'B' || o_custkey end as BundleId,
    case when o_custkey % 3 = 0 then '2' when o_custkey % 3 = 1 then 'none' end as TRCBand,
    case when o_custkey % 4 <> 0 then cast(o_custkey % 4 as string) end as TRCChargeBand,
    case when o_custkey % 2 = 0 then 'Standard' else 'Extended Reach' end as Reach,
    case when o_custkey % 5 = 0 then 'Standard' end as EADSet9709DelayReach,
    case when o_custkey % 3 <> 0 then 'ducting' end as Newsitesactivities,
    case when o_custkey % 3 <> 1 then 'cabling' end as Complexplanningactivities,
    case when o_custkey % 2 = 1 then 'Premium' end as RecommendMinSvrExistingLine,
    case when o_custkey % 2 = 1 then 'Y' end as PTW9931_541Flag,
    case when o_custkey % 3 = 0 then '9650|9667 - Activity|9668' when o_custkey % 3 = 1 then '9650' end as KCIDelaycodes,
    case when o_custkey % 2 = 0 then 'Y' end as FTTPOnDemand,
    case when o_custkey % 2 = 0 then '565 - Delay' end as ConfiguredKCIDelayReason,
    case when o_custkey % 5 = 0 then '41' end as DelayRef9561, case when o_custkey % 3 = 0 then '42' end as DelayRef588 from {orders}"""

NAMES = ("ProductName", "SIM2Marker", "GeSSLoggingRef", "LinkedOrderReference", "SMPFLinkOrdRef", "TargetLineServiceID", "TargetAccessLineId",
         "FTTPOrderStages", "IsSubsequentProvide", "OrderPlacedDate", "CommitmentDate", "RequiredByDate", "Arrivalslot", "RingAhead",
         "TaskClosureReason", "BundleId", "TRCBand", "TRCChargeBand", "Reach", "EADSet9709DelayReach", "Newsitesactivities",
         "Complexplanningactivities", "RecommendMinSvrExistingLine", "PTW9931_541Flag", "KCIDelaycodes", "FTTPOnDemand",
         "ConfiguredKCIDelayReason", "DelayRef9561", "DelayRef588")

SQL = {
    "delay_params": f"""
        select order_number, name, value from ({WIDE}) unpivot (value for name in ({', '.join(NAMES)}))
        union all select case when o_orderkey % 2 = 0 then 'OR' else 'OS' end || o_orderkey, 'KSUDelay-' || o_custkey,
               '2024-05-01T10:00:00|' || case when o_custkey % 2 = 0 then '566' else '9400' end || '|Some text' from {{orders}} where o_orderstatus <> 'F'""",
    "pending": """
        select key, name, value from (select 'G' || o_orderkey as key,
               case o_custkey % 5 when 0 then 'Migration from WLR' when 1 then 'Migration from SOTAP' when 2 then 'Provide' when 3 then ' ' end as SubType,
               case o_custkey % 4 when 0 then 'Y' when 1 then 'N' when 2 then '' end as SIM2PCPOnly,
               case o_custkey % 4 when 0 then 'W' when 1 then 'A1' when 2 then 'N' else '' end as ReappointmentReqd,
               case o_custkey % 6 when 0 then '577' when 1 then '5197' when 2 then '5867' when 3 then '100' end as delayNoteCode,
               case when o_custkey % 2 = 0 then '5463' end as LastDelayNoteCode,
               case o_custkey % 3 when 0 then 'N' when 1 then 'Y' end as KCI9652Notes from {orders})
        unpivot (value for name in (SubType, SIM2PCPOnly, ReappointmentReqd, delayNoteCode, LastDelayNoteCode, KCI9652Notes))""",
    "pending_by_order": """
        select order_number, ref, name, value from (select case when o_orderkey % 2 = 0 then 'OR' else 'OS' end || o_orderkey as order_number, 'G' || o_orderkey as ref,
               case when o_custkey % 2 = 0 then 'Migration from X' end as SubType, 'N' as SIM2PCPOnly, 'CP' as ReappointmentReqd from {orders})
        unpivot (value for name in (SubType, SIM2PCPOnly, ReappointmentReqd))""",
    "delay_addresses": """
        select c_custkey as address_key, 'EX' || c_nationkey as exchange, case when c_acctbal > 5000 then 'Y' when c_acctbal > 2500 then 'N' end as address_scale,
               case c_mktsegment when 'BUILDING' then 'UG congested duct' when 'MACHINERY' then 'UG Feed Not Evaluated' when 'FURNITURE' then 'UG Part proven' end as network_notes from {customer}""",
    "site_visit_texts": """
        select case when n_nationkey % 2 = 0 then 'Generic Ethernet Access - FTTP' else 'SOGEA' end as product, n_nationkey as answer_id, n_name as answer_text,
               case when n_regionkey % 2 = 0 then 'Premium' else 'Advanced' end as svr, case when n_nationkey % 5 = 4 then 'N' else 'Y' end as flag from {nation}""",
    "delay_requests": """
        select event_id as request_id, ts as request_ts, case when event_id % 2 = 0 then 'OR' else 'OS' end || event_id as order_number, user_id as address_key,
               case when user_id % 2 = 0 then 'N' else '' end as appointment, """ + _case(f"cast(floor(event_id / 12) as bigint) % {len(DELAYS)}", [d[0] for d in DELAYS]) + """ as reason,
               case when event_id % 29 = 3 then 'Rnext' else 'R' || (1000 + event_id * 37 % 4000) end as release,
               case event_type when 'signup' then 'KSU1' when 'view' then 'KSU1.5' when 'error' then 'KSU3' else 'KSU2' end as stage,
               case when user_id % 3 = 0 then '' else '<Note><NoteId>1</NoteId></Note>' end as notes_xml,
               case when event_id % 19 = 7 then 'N' when event_id % 19 = 8 then null else '' end as trigger,
               case when event_id % 8 = 0 then 'Y' else '' end as amend_in from {events}""",
    "delay_rules": "select * from (values " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rule_rows())
                   + ") r(" + ", ".join(RULE_COLUMNS) + ")",
}


def answers_wide(texts):
    """Answer texts per product, those with flag Y, in the order of their ids, joined by semicolons."""
    from pyspark.sql import functions as F

    from loomwork.operators.hot import collect_ordered
    lists = collect_ordered(texts.where("flag = 'Y'"), ["product", "svr"], ["answer_id"], F.col("answer_text"))
    part = F.struct("part_no", F.array_join("items", ";").alias("text"))

    def joined(kind):
        own = F.sort_array(F.collect_list(F.when(F.col("svr") == kind, part)))
        return F.when(F.size(own) > 0, F.array_join(own["text"], ";"))

    return lists.groupBy("product").agg(joined("Premium").alias("answer_premium"), joined("Advanced").alias("answer_advanced"))
