"""Rules of the delay job, in order. Conditions and values are SQL text over the columns of a request.

Each rule sees what earlier rules set; a later rule overwrites an earlier one.
Rules in an inner list look at different values of one column, so at most one
of them holds. Texts, codes and product names are fixed values.
"""

from __future__ import annotations

from loomwork.plans.rules import Rule

GEA, FTTP = "Generic Ethernet Access", "Generic Ethernet Access - FTTP"
WLR, MPF, SMPF, SOGEA, SOTAP = "WLR3 PSTN Single Line", "MPF", "SMPF", "SOGEA", "SOTAP"
SEVERED = ("9544 - Links between the orders have been severed. This order is now proceeding as a "
           "stand-alone order")
STAND_ALONE = ("Links between the orders have been severed. This order is now proceeding as a stand-alone "
               "order due to tie pair / frames issues on the SMPF order")
AREA_REASONS = ("Waiting for Permission (FTTP)", "5464 and 5462 FTTP", "5462 Survey Task", "5464 - Underground Network Delay")
OR_MISSED_CODES = ("566", "568", "577", "578", "579", "581", "585", "596", "5462", "5464", "5466")
MISSED_CODES = ("9687", "9689", "9691", "9693", "9695", "9696", "9698", "9701", "9702", "9703", "9447", "9686", "9688", "9690",
                "9692", "9694", "9697", "9699", "9685", "568", "9227", "9705", "5464", "9602", "581", "9707", "577", "578", "9706",
                "9600", "585", "579", "582", "584", "566", "565", "9902", "9903", "9904", "9928")
UPDATED_REASONS = ("9790-ORDelayUpdated", "9791-ORDelayUpdated", "9792-ORDelayUpdated")
NEXT_DAY_REASONS = ("1610 - Test capacity not available_SuppPro", "563 - Removal of DACS_SuppPro", "574 - Delayed During Test_SuppPro",
                    "592 - Delay due to Tie pair in Use_SuppPro", "SOTAP_Health and Safety_SuppPro")
PREMIUM_REASONS = ("9877-Required premium SVR", "9877+9700 - Required Premium SVR", "9877 - Required premium SVR(pre KCI2)",
                   "9877 - Required premium SVR SOGEA(pre KCI2)")
ADVANCED_REASONS = ("9877-Required advanced SVR", "9877+9700 - Required Advanced SVR", "9877 - Required advanced SVR(pre KCI2)",
                    "9877 - Required advanced SVR SOGEA(pre KCI2)")
HIGH_DEMAND = ("Unfortunately due to high product demand we cannot process your FTTP on Demand order until after ",
               ". We will progress the order after this date and send an order status update containing the survey "
               "appointment booking date. The Order Tracker will have the latest update thereafter.")
EXCESS_CHARGE = ("Excess construction charge band supplied value {ECChargeBand} is not within the OR derived charge band value "
                 "{ECCBand}. Please provide authorisation for the required ECChargeBand, if you do not reply before {Delaydate} "
                 "the order will be cancelled.")
REACH_TEXT = ("The Reach value on your order has been changed during planning. The new Reach value is now ",
              ". Please amend your order to reflect the new Reach value.")
BUILD_TEXT = ("Additional build works are required to fulfil the order. The Earliest Available Date is ", ".")
NO_CONTACT = ("600;Notes:Unable to contact EU after 2 attempts. Need to send KCID on this order so that CP can action|3511;"
              "Engineer arrival time onsite,", "|3512;IRC,ASQ")
FIRST_ECC = ("600;This is the first delay sent for ECC Authorisation. Kindly place ECC Amend to confirm the ECC Band entered "
             "by Mobile Planners during ECC Authorisation")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(*values: str) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


NULL = "cast(null as string)"

# All columns that the rules set, with their starting values (SQL).
START = {
    "notes": "''", "type": NULL, "text": NULL, "code": NULL, "reappt": NULL, "subsequent": NULL, "amend_required": NULL,
    "amend_reason": NULL, "confirmation": NULL, "consent": NULL, "stages": NULL, "engineer_notes": NULL, "note_format": NULL,
    "item_type": NULL, "item_text": NULL, "note_code": NULL, "note_text": NULL, "note_type": NULL, "lo_reason": NULL,
    "external_notes": "''", "valid": "'Y'", "missed": "''", "next_update": NULL, "appointment_failed": "'N'",
}

# Columns emptied when a delay does not apply at this stage.
BLANKED = ("notes", "type", "text", "code", "reappt", "amend_required", "amend_reason", "confirmation", "consent", "stages",
           "engineer_notes", "note_format")


def linked(condition: str, reappt: str, stages: str, amend_reason: str = NULL, confirmation: str = "mpf_reappt",
           kind: str = "Warning", item: bool = False, note: bool = True) -> Rule:
    """The linked-order delay 9494 in one of its variants."""
    new = {"notes": "''", "type": q(kind), "text": "'Linked order delayed.'", "code": "'9494'", "reappt": reappt, "subsequent": "''",
           "amend_required": NULL, "amend_reason": amend_reason, "confirmation": confirmation, "consent": NULL, "stages": q(stages),
           "engineer_notes": NULL, "note_format": NULL}
    if item:
        new |= {"item_type": "'Warning'", "item_text": "'9494;Linked order delayed.'"}
    if note:
        new |= {"note_code": "'9494'", "note_text": "'Linked order delayed.'", "note_type": "'Warning'"}
    return condition, new


SBS_START: list[Rule] = [
    ("product = 'SBS' and reason = '9494 - Linked order delayed'",
     linked("", "'N'", "KSU2")[1] | {"subsequent": "reason"}),
]

TRIGGER: list[Rule] = [("trigger = 'N'", {"valid": "'N'"})]

BRANCH_A: list[Rule] = [
    (f"valid = 'Y' and product = {q(WLR)}",
     {"notes": "''", "type": "'Informational'", "text": q(STAND_ALONE), "code": "'9580'", "reappt": "'N'", "subsequent": "''",
      "amend_required": "'N'", "amend_reason": "''", "confirmation": "'N'", "consent": NULL, "stages": "'KSU2'",
      "engineer_notes": NULL, "note_format": NULL, "item_type": "'Informational'", "item_text": q("9580;" + STAND_ALONE)}),
    ("valid = 'Y' and reappt = 'N'", {"appointment": "'N'"}),
]

_GEA, _RESYNC = f"valid = 'Y' and product = {q(GEA)}", "'Re-synchronisation'"
_SMPF_EARLY = f"temp_code in ('5197', '5867') and product2 = {q(WLR)} and marker = 'Y' and stage = 'KSU2'"
_SMPF_FIRST = "first_delay <> 'N' and product2 like 'WLR3 PSTN%' and marker = 'Y' and stage = 'KSU2'"
_WLR_GEA = f"stage = 'KSU2' and marker = 'Y' and product2 = {q(GEA)} and pcp_only = 'N' and reason = '9494 - Linked order delayed.'"

BRANCH_B: list[Rule | list[Rule]] = [
    [linked(f"{_GEA} and stage = 'KSU2' and pcp_only = 'N'", "mpf_reappt", "KSU2", _RESYNC, item=True, note=False),
     linked(f"{_GEA} and stage = 'KSU2'", "'N'", "KSU2", _RESYNC, item=True, note=False),
     linked(f"{_GEA} and stage = 'KSU1.5'", "mpf_reappt", "KSU1.5", _RESYNC, item=True, note=False),
     linked("valid = 'Y' and product = 'MPF'", "'N'", "KSU2"),
     linked(f"valid = 'Y' and product = 'SMPF' and {_SMPF_EARLY}", "'N'", "KSU2", confirmation=NULL, kind="Delayed"),
     linked(f"valid = 'Y' and product = 'SMPF' and {_SMPF_FIRST}", "mpf_reappt", "KSU2"),
     linked("valid = 'Y' and product = 'SMPF'", "mpf_reappt", "KSU1.5"),
     linked(f"valid = 'Y' and product = {q(WLR)} and {_WLR_GEA}", "'N'", "KSU2", _RESYNC, item=True),
     linked(f"valid = 'Y' and product = {q(WLR)}", "mpf_reappt", "KSU1.5")],
    (f"{_GEA} and mpf_reappt in ('W', 'A1')", {"confirmation": "'N'"}),
    (f"{_GEA} and temp_code in ('577', '9544')", {"reappt": "'N'", "confirmation": "'N'", "amend_reason": "''"}),
    (f"{_GEA} and migrate like 'Migration from%'", {"reappt": "'N'", "confirmation": "'N'"}),
]

LOOKUP: list[Rule] = [
    ("valid = 'Y' and rule_found",
     {c: f"rule_{c}" for c in ("notes", "type", "text", "code", "reappt", "subsequent", "amend_required", "amend_reason",
                               "confirmation", "consent", "stages", "engineer_notes", "note_format", "notes_xml")}
     | {"lo_reason": "rule_subsequent"}),
]

_9569 = "code = '569' and reason = '569 - Delay Faulty Tie Pair Amend'"
_MIGRATED = "migrate like 'Migration from%' and migrate <> 'Migration from SOTAP'"

# Follow-on reason and its neighbours: which delay comes next.
FOLLOW_ON: list[Rule | list[Rule]] = [[
    (f"code = '5197' and marker = 'Y' and product2 = {q(GEA)} and product = {q(WLR)} and reason = '5197 - EU Missed Appt'",
     {"amend_required": "'N'", "confirmation": "'N'", "reappt": "'PA10BT'"}),
    ("code = '577' and product = 'MPF' and marker = 'Y'", {"subsequent": q(SEVERED)}),
    (f"code = '597' and product = {q(WLR)} and marker = 'Y'", {"subsequent": q(SEVERED)}),
    ("code = '567' and product = 'MPF' and marker = 'Y' and reappt = 'CPBT'", {"subsequent": q(SEVERED)}),
    ("code = '9544'", {"item_type": "type", "item_text": "code || ';' || text"}),
    (f"code = '566' and product = {q(GEA)} and product2 = {q(WLR)} and marker = 'Y' and target_dn = 'Y' "
     "and reason = '566 - OR Missed Appt (EU Confirmed)'", {"subsequent": q(SEVERED)}),
    (f"code = '569' and {_MIGRATED}", {"subsequent": q(SEVERED)}),
    (f"{_9569} and marker = 'N' and product in ('MPF', 'SMPF')", {"confirmation": "'N'"}),
    (f"{_9569} and marker = 'Y' and product = 'SMPF'", {"confirmation": "'CP'"}),
],
    ("code = '9544' and migrate like 'Migration from%'",
     {"reappt": "'CP'", "amend_required": "'Y'", "confirmation": "'Customer Delay'"}),
    [("marker = 'Y' and ((code = '5463' and stage = 'KSU2') or code = '5466')", {"subsequent": q(SEVERED)}),
     (f"marker = 'Y' and code = '9544' and product = {q(GEA)} and or_missed = 'Y'", {"subsequent": "'9600 - OR Missed Appointment'"}),
     ("marker = 'Y' and code = '572' and stage = 'KSU2' and product = 'SMPF'", {"subsequent": q(SEVERED)})],
    (f"code = '9544' and product = {q(GEA)} and product2 = {q(WLR)} and marker = 'Y' and target_dn = 'Y'", {"subsequent": "''"}),
    ("kci = '9544' and last_note = '5463'", {"reappt": "'VZ'"}),
    ("pcp_only = 'Y' and code in ('5197', '565')", {"subsequent": q(SEVERED), "reappt": "'CP'"}),
    (f"kci = '9544' and product in ('MPF', {q(WLR)})", {"amend_required": "'Y'"}),
]

_BUILD = f"product = {q(FTTP)} and fttp_stages = '2' and coalesce(successional, 'N') <> 'Y'"

BEFORE_GATE: list[Rule | list[Rule]] = [
    [("code = '5787' and reason = '5787_Unknown_Parallel' and product = 'Dark Fibre Access' and trc_band is not null",
     {"text": "replace(text, '{RequiredTRCBand}', trc_band)"}),
    (f"reason = '9932 - Site Visit Reason and site contact details amend required' and product = {q(SOGEA)} and min_visit is not null",
     {"text": "replace(replace(text, '[%1]', min_visit), '[%2]', d15_103)"}),
    (f"reason in {among(*UPDATED_REASONS)} and cfg_found",
     {"reappt": "cfg_reappt", "amend_required": "cfg_amend_required", "confirmation": "cfg_confirmation", "consent": "cfg_consent"})],
    ("code = '9808' and order_number like 'OR%'", {"item_type": "type", "item_text": "'9808; ' || text"}),
    [(f"reason = 'GEA - Awaiting Network Build Activity' and {_BUILD}", {"stages": "'KSU1'", "reappt": "'N'"}),
     ("reason = 'GEA - Awaiting Network Build Activity'", {"stages": "'KSU2'"})],
    ("reason like '%9775%' and text like '%2%'",
     {"text": "replace(replace(replace(text, '%1', ring_ahead), '%2', arrival_slot), '%3', closure)"}),
    ("reason like '%9931%'",
     {"text": "replace(replace(text, '%1', case when ptw = 'Y' then 'is not received' else 'is required' end), '%3', d1_105)"}),
    [("reason = '8020 - Planned Work Will Delay Order'", {"text": "replace(text, '[MigrationDate]', d2_105)"}),
     ("reason = '8020 - Planned Work Will Delay Order Twice'", {"text": "replace(text, '[MigrationDate]', d1_105)"})],
    [("code = '8016' and reason <> '8016-OrderIsOnHold2nd'", {"text": "replace(text, '{AvailableDate_DDMMYYYY}', d30_103)"}),
     ("code = '8016' and reason = '8016-OrderIsOnHold2nd'",
      {"text": "replace(text, '{AvailableDate_DDMMYYYY2}', d40_103)", "available_date": "d40_iso"})],
    ("code = '8016' and order_number like 'OR%'", {"item_type": "type", "item_text": "'8016; ' || text"}),
    (f"product = {q(SOGEA)} and code in {among(*MISSED_CODES)}", {"missed": "'Y'"}),
    ("code = '565' and stage not in ('KSU2', 'KSU3') and product like '%MPF%' and notes_xml like '%5197%'",
     {"notes_xml": "xml_without_5197"}),
    *FOLLOW_ON[:-2],
    [("code = '5463' and reason = 'GEA - Planning or Network Survey Delay'",
     {"notes": f"'600;{HIGH_DEMAND[0]}' || survey_day || {q(HIGH_DEMAND[1])}",
      "external_notes": f"'600;Others. {HIGH_DEMAND[0]}' || survey_day || {q(HIGH_DEMAND[1])}"}),
    (f"product = {q(GEA)} and code = '9404'",
     {"note_code": "code", "note_text": "text", "note_type": "type", "item_text": "code || ';' || text", "item_type": "type"}),
    ("product = 'SBS' and code = '9520'", {"note_code": "code", "note_text": "text", "note_type": "type"})],
    *FOLLOW_ON[-2:],
]

GATE: list[Rule] = [
    ("valid = 'Y' and coalesce(stages, '') <> '' and not (',' || stages || ',' like '%,' || stage || ',%')", {"valid": "'N'"}),
    ("valid = 'N'", {c: "''" for c in BLANKED} | {"subsequent": "reason"}),
]

AFTER_GATE_B: list[Rule] = [
    ("valid <> 'N' and reappt <> 'N'", {"appointment": "'Y'"}),
    ("true", {"amend_required": "'N'"}),
]

AFTER_GATE_C: list[Rule] = [
    ("valid = 'N'", {"lo_reason": "''"}),
    ("valid <> 'N' and reappt <> 'N' and reason not in ('LLU_Out OF Time', 'LLU_Health and Safety Issue')", {"appointment": "'Y'"}),
    ("amend_in = 'Y'", {"amend_required": "amend_in"}),
]


def day_text(condition: str, marker: str, column: str) -> Rule:
    return condition, {"text": f"replace(replace(text, '{marker}', {column}), ' 00:00:00', '')"}


_ADDRESS = "(reason in ('5742 - Address Matching Delay', '561 - Address Matching Delay') or reason like '9650%')"
_DEMAND = f"product = {q(FTTP)} and on_demand = 'Y'"
_SVR = f"code = '9877' and product in {among(FTTP, SOGEA)} and reason in {among(*PREMIUM_REASONS, *ADVANCED_REASONS)}"
_QUEUE = (f"product = {q(SOGEA)} and (queue like '%9650%' or queue like '%9667%' or queue like '%9668%' or queue like '%9669%') "
          "and queue like '%|%'")


def _clear(word: str, ref: str, tail: str) -> str:
    return f"'600;Delay Reference {word}' || {ref} || '. The {tail} is ' || d0_103 || '.'"


def keyword_notes(reason: str, keyword: str) -> Rule:
    def note(code: str, text: str) -> str:
        return f"'<Note><NoteId>{code}</NoteId><NoteType>Engineer Notes</NoteType><NoteText>' || {text} || '</NoteText></Note>'"
    return (f"product = {q(SOGEA)} and reason = {q(reason)}",
            {"notes_xml": f"{note('3511', 'run_stamp')} || {note('3512', q('IRC, ' + keyword))} || "
                          f"{note('600', q('Notes ') + ' || run_stamp')} || notes_xml"})


LATE: list[Rule | list[Rule]] = [[
    day_text("code in ('9670', '9662', '9671')", "%1", "w14"),
    day_text("code = '9666'", "%2", "w3"),
    day_text("code in ('9648', '9651')", "%2", "w15"),
    day_text(f"code in ('9668', '9669') and product <> {q(SOGEA)}", "%2", "w1"),
    day_text(f"code = '9668' and product = {q(SOGEA)}", "%2", "w16"),
    ("code = '9667'", {"text": "replace(text, '%1', site_activities)"}),
    day_text("code = '9652'", "%2", "w4"),
    day_text("code = '9663'", "%2", "w3"),
    ("code = '9681'", {"text": "replace(replace(replace(text, '%1', complex_activities), '%3', w5), ' 00:00:00', '')"}),
], [
    (f"{_ADDRESS} and reason like '9650%'",
     {"text": "replace(replace(replace(text, '%1', w15), '%2', w15), ' 00:00:00', '')", "note_type": "'Warning'"}),
    (f"{_ADDRESS} and not reason like '9650%'",
     {"text": "replace(replace(replace(text, '%1', w2), '%2', w2), ' 00:00:00', '')", "note_type": "'Warning'"}),
], [
    ("code = '9709' and reason <> '9709_DELAY_CLOSURE'",
     {"text": f"{q(REACH_TEXT[0])} || case when reach = 'Standard' then 'Local Access' when reach = 'Extended Reach' and delay_reach = 'Standard' "
              f"then 'Standard' when reach = 'Extended Reach' then 'Local Access' end || {q(REACH_TEXT[1])}"}),
    day_text(f"code = '9743' and product = {q(WLR)}", "%2", "w15"),
    day_text(f"code = '9743' and product in {among(MPF, SOGEA, SOTAP)}", "%2", "w10"),
    (f"code = '9818' and product = {q(SOGEA)}", {"text": "replace(text, '%1', charge_band)"}),
    (f"code = '9649' and product = {q(SOGEA)}", {"text": "replace(replace(text, '%1', 'by Openreach'), '%2', w3)"}),
],
    (_QUEUE, {"reason": "queue_head", "subsequent": "queue_head"}),
    ("reason like '%Copper Route Verification%'", {"eu_confirmed": "'N'"}),
[
    (f"product = {q(FTTP)} and reason = '9816 Sitevisit changed'",
     {"item_text": "code || ';' || text", "item_type": "type", "appointment": "'Y'"}),
    (f"product = {q(FTTP)} and reason = '5480 - FTTP EU Different Instructions'",
     {"item_text": f"{q(NO_CONTACT[0])} || arrival || {q(NO_CONTACT[1])}",
      "item_type": "'Engineer Notes|Engineer Notes|Engineer Notes'"}),
], [
    (f"{_DEMAND} and code in ('9561', '588')",
     {"item_type": "'Delayed'", "item_text": _clear("is ", "cast(seq as string)", "Estimated Clear Date")}),
    (f"{_DEMAND} and code = '9562'",
     {"item_type": "'Update'", "item_text": _clear("", "coalesce(ref_9561, ref_588, cast(seq as string))", "updated Estimated Clear Date")}),
    (f"{_DEMAND} and code = '9831'",
     {"item_type": "'Delayed'", "item_text": _clear("is ", "coalesce(ref_588, cast(seq as string))", "Estimated Clear Date")}),
    (f"{_DEMAND} and code = '5750'", {"item_type": "'Update'", "item_text": q(FIRST_ECC)}),
],
    (f"product in {among(FTTP, 'FVA')} and coalesce(lorn, '') = '' and code = '5750'",
     {"text": f"replace({q(EXCESS_CHARGE)}, '{{Delaydate}}', d31_103)"}),
    ("product = 'PIA' and coalesce(code, '') <> '' and reason in ('Delay_ResponseToKCINotice', 'Delay_InsufficientInformation_Coop', "
     "'Delay_InsufficientInformation_NA')", {"code": "'000' || code"}),
[
    (f"reason = '593-CPDelay(SupplementaryKSU)' and product = {q(SOGEA)}", {"appointment_failed": "'Y'", "eu_confirmed": "'Y'"}),
    (f"product = {q(SOTAP)} and reason = '565+9818 - Delay + insufficient TRC'", {"notes_xml": "replace(notes_xml, '%1', charge_band)"}),
    (f"product = {q(SOTAP)} and reason in {among(*NEXT_DAY_REASONS)}", {"next_update": "next_open || ' 00:00:00'"}),
],
    ("code = '9601' and reason = '9601 - Additional build works required'",
     {"text": f"{q(BUILD_TEXT[0])} || commitment_day || {q(BUILD_TEXT[1])}"}),
    (_SVR, {"text": f"replace(replace(text, '[%1]', case when reason in {among(*PREMIUM_REASONS)} then 'Premium' else 'Advanced' end), '[%2]', d15_103)",
            "item_type": "'Delay Notes'",
            "item_text": f"'600;' || case when reason in {among(*PREMIUM_REASONS)} then answer_premium else answer_advanced end"}),
[
    keyword_notes("9902+9700_VRI Faceplate or extension kit is missing", "TKNP"),
    keyword_notes("9903+9700_IP voice is not working", "DVNW"),
    keyword_notes("9904+9700_Telecare device was found without Prove Telecare SVR", "TDP"),
    ("reason = 'Excess Construction Charge with Ruggedised'",
     {"code": "'5750|9925'", "text": f"replace({q(EXCESS_CHARGE)}, '{{Delaydate}}', d5_103)"}),
]]

_LINKED_ORDER = "marker = 'Y' and order2 is not null and product like 'WLR3 PSTN%'"

# What a request changes in the attribute table: (condition, owner, name, value).
PARAM_CHANGES: list[tuple[str, str, str, str]] = [(condition, "order_number", name, value) for condition, name, value in [
    ("product = 'EAD' and reason = '9275 - Unable to Gain Access'", "Is9275", "'Y'"),
    ("product = 'EAD' and reason = '593-Pinch point delay'", "IsPinchPointValidation", "'Y'"),
    (f"(product = {q(GEA)} and reason = 'POSTKCI2WAITERS_578_EU_Confirmed') or reason = 'POSTKCI2WAITERS_578_EU_UnConfirmed'",
     "578_PostKCIWAITERS_Delayreason", "reason"),
    ("true", "EUConfirmedDelay", "eu_confirmed"),
    (f"product in {among(FTTP, 'FVA')} and reason = 'GEA 572 - Delayed in Processing with Retention'",
     "572_DelayWithRetention_Reason", "reason"),
    (f"subsequent in {among(*UPDATED_REASONS)}", "ConfiguredKCIDelayReason", "reason"),
    (f"(code = '565' and stage = 'KSU2' and (product like '%MPF%' or product like '%Generic Ethernet Access%' or product = {q(SOTAP)})) "
     f"or (code in ('9743', '5480') and stage = 'KSU2' and product = {q(SOTAP)}) or (code = '5197' and product like '%FTTP%')",
     "AbortiveVisitReqd", "'Y'"),
    ("code = '9709' and reason <> '9709_DELAY_CLOSURE'", "EADOldReach", "reach"),
    ("code = '9743' and reason = '9743-delayed with SQ and then cancelling due to no response from CP or EU'", "9743Cancellation", "'Y'"),
    (_QUEUE, "KCIDelayReason", "queue_head"),
    (_QUEUE, "KCIDelaycodes", "substr(queue, length(queue_head) + 2)"),
    (f"{_DEMAND} and code = '9561'", "DelayRef9561", "cast(seq as string)"),
    (f"{_DEMAND} and code = '588'", "DelayRef588", "cast(seq as string)"),
    ("reason = '9398_Unknown_5751_Unknown_9350_Unknown'", "ECCBehaviour", "'outside CP authorised value'"),
    ("reason = '9797_529_Unknown_5787_Unknown'", "OrderBehaviour", "'E2E cross connect outsourcing'"),
    ("code = '9808' and reason = '9808 - Provide valid Handover Port Service ID(9543)'", "iL2SIdModified", "'Y'"),
    ("code = '9808' and reason = '9808 - Provide valid Handover Port Service ID(9543)'", "OrderBehaviour", "'9543 Valid OHP (SIM2)'"),
    ("product = 'PIA' and coalesce(code, '') <> ''", "CurrentKCIDelayReason", "reason"),
    (f"reason = '593-CPDelay(SupplementaryKSU)' and product = {q(SOGEA)}", "AppointmentFailed", "'Y'"),
    ("reason = 'Excess Construction Charge with Ruggedised'", "ECC_CheckFor5750", "'Y'"),
]] + [
    (f"{_LINKED_ORDER} and code in ('9666', '9651', '9681', '9650')", "order2", "KCIDelayReason", "'9494 - Linked order delayed'"),
]
