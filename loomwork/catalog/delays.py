"""The delay job: details, blanking, follow-on reasons, audit and attribute changes."""

import datetime

from pyspark.sql import functions as F

from loomwork.catalog.delay_data import answers_wide
from loomwork.catalog.derived import duck, frame
from loomwork.catalog.registry import query
from loomwork.plans import delay_details as dd
from loomwork.plans import delay_rules as dr
from loomwork.plans.rules import apply_rules, steps_of

c = F.col
RUN = datetime.datetime(2024, 5, 23, 8, 0, 0)
HOLIDAYS = [datetime.date(2024, 5, 27)]
ORDERS_A_TASK = 50_000
INPUT = ("delay_requests", "delay_params", "pending", "pending_by_order", "delay_rules", "delay_addresses", "exchange_params", "site_visit_texts")


def layers(source: str, rules) -> str:
    """The rules as nested SELECTs, each step overwriting its columns."""
    for step in steps_of(rules):
        written = dict.fromkeys(col for _, new in step for col in new)
        sets = []
        for col in written:
            # an alternative that leaves this column alone still keeps later ones out
            cases = " ".join(f"when coalesce({condition}, false) then {new.get(col, col)}" for condition, new in step)
            sets.append(f"case {cases} else {col} end as {col}")
        source = f"select * replace ({', '.join(sets)}) from ({source})"
    return source


def shift(column: str, rules: dict) -> str:
    """Weekday shift of a time text; DuckDB counts Sunday as 0."""
    days = " ".join(f"when {k - 1} then {v}" for k, v in rules.items())
    day = f"cast(substr({column}, 1, 10) as date)"
    return f"case when contains({column}, 'T') then strftime({day} + to_days(case dayofweek({day}) {days} end), '%d-%m-%Y') else {column} end"


def wide(names: dict) -> str:
    return ", ".join(f"max(case when name = '{n}' then value end) as {col}" for n, col in names.items())


def pending_sql(prefix: str, names) -> str:
    return ", ".join(f"max(case when name = '{n}' then value end) as {prefix}{n}" for n in names)


def context_sql() -> str:
    """All facts of the requests as DuckDB SQL."""
    family = dr.among(dr.GEA, dr.MPF, dr.WLR, dr.SMPF)
    gea, mpf, wlr, smpf, sogea, sotap, fttp = (dr.q(p) for p in (dr.GEA, dr.MPF, dr.WLR, dr.SMPF, dr.SOGEA, dr.SOTAP, dr.FTTP))
    three = ["SubType", "SIM2PCPOnly", "LastDelayNoteCode"]

    def mine(n):
        return f"coalesce(nullif(rtrim(a_{n}), ''), c_{n})"

    def theirs(n):
        return f"coalesce(nullif(rtrim(b_{n}), ''), d_{n})"
    working = {1: "24-05-2024", 2: "28-05-2024", 3: "29-05-2024", 4: "30-05-2024", 5: "31-05-2024", 10: "07-06-2024", 14: "13-06-2024",
               15: "14-06-2024", 16: "17-06-2024", 17: "18-06-2024"}
    dates = "".join(f", '{v}' as w{n}" for n, v in working.items()) + "".join(
        f", strftime(date '2024-05-23' + {n}, '%d/%m/%Y') as d{n}_103" for n in (0, 5, 15, 30, 31, 40)) + (
        ", '24-05-2024' as d1_105, '25-05-2024' as d2_105, '2024-07-02' as d40_iso, '24/05/2024' as next_open, '23/05/2024 08:00:00' as run_stamp, '2024-06-22' as available_date")
    slots = {"Arrivalslot": ("arrival_slot", "own_slot"), "RingAhead": ("ring_ahead", "own_ring"), "TaskClosureReason": ("closure", "own_closure")}
    rule_fields = [x for x in ("notes", "type", "text", "code", "reappt", "subsequent", "amend_required", "amend_reason", "confirmation", "consent",
                               "stages", "engineer_notes", "note_format", "notes_xml")]
    scale_notes, other_notes = (dr.among(*x) for x in (
        ("UG congested duct", "UG Potential Wayleave Issues", "UG partial Direct In Ground", "UG Feed Not Evaluated"),
        ("UG congested duct", "UG Potential Wayleave Issues", "UG partial Direct In Ground", "UG Part proven", "UG navigable with camera",
         "UG Linked duct", "OH Potential Wayleave issues")))
    reads = f"(product in ({wlr}, 'WLR3 PSTN Multiline Aux', {mpf}, 'WLR3 ISDN 2e Standard', 'WLR3 ISDN 2e System') or (product = {sotap} and reason like '%9775%'))"
    slot_sql = ", ".join(
        f"case when product = {mpf} and coalesce(case when {reads} then own_slot end, '') = '' and coalesce(bundle, '') <> '' and v_{n} is not null then v_{n} "
        f"when {reads} then coalesce({own}, '') else '' end as {to}" for n, (to, own) in slots.items())
    return "with " + duck(*INPUT) + f""",
    own as (select order_number, {wide(dd.OWN)} from delay_params group by order_number),
    other as (select order_number as order2, {wide(dd.OTHER)} from delay_params group by order_number),
    q1 as (select r.*, own.* exclude (order_number), case when product in {family} then coalesce(own_marker, 'N') else 'N' end as marker from delay_requests r left join own using (order_number)),
    q2 as (select *, case when product in {family} and marker = 'Y' then nullif(case when product = {wlr} then smpf_ref else link_ref end, '') end as lorn from q1),
    q3 as (select *, (select min(e.order_number) from delay_params e join delay_params p on p.order_number = e.order_number and p.name = 'ProductName'
             where e.value = q2.lorn and e.order_number <> q2.order_number and case q2.product
               when {gea} then e.name in ('LinkedOrderReference', 'SMPFLinkOrdRef') and p.value in ({mpf}, {wlr})
               when {mpf} then e.name = 'LinkedOrderReference' and p.value = {gea}
               when {wlr} then e.name = 'LinkedOrderReference' and p.value in ({gea}, {smpf})
               when {smpf} then e.name = 'SMPFLinkOrdRef' and p.value = {wlr} end) as order2 from q2),
    q4 as (select q3.*, other.* exclude (order2), coalesce(ref2, own_ref) as ref from q3 left join other using (order2)),
    q5 as (select q4.*, a.* exclude (key), b.* exclude (key), cc.* exclude (order_number, ref), d.* exclude (order_number, ref) from q4
      left join (select key, {pending_sql('a_', three)} from pending group by key) a on a.key = own_ref
      left join (select key, {pending_sql('b_', dd.PENDING[1:])} from pending group by key) b on b.key = q4.ref
      left join (select order_number, ref, {pending_sql('c_', three)} from pending_by_order group by all) cc on cc.order_number = q4.order_number and cc.ref = own_ref
      left join (select order_number, ref, {pending_sql('d_', dd.PENDING[1:])} from pending_by_order group by all) d on d.order_number = order2 and d.ref = q4.ref),
    q6 as (select * replace (case when product in ({gea}, {wlr}, {smpf}) then product2 end as product2), coalesce(ref, '') <> '' as known,
      case when product in {family} then {mine('SubType')} else 'N' end as migrate,
      case when product = {gea} then {mine('SIM2PCPOnly')} when product in ({mpf}, {wlr}) and coalesce(ref, '') <> '' then {theirs('SIM2PCPOnly')} else 'N' end as pcp_only,
      case when product in {family} and coalesce(ref, '') <> '' then {theirs('ReappointmentReqd')} end as mpf_reappt,
      case when product = {gea} or (product = {smpf} and coalesce(ref, '') <> '') then {theirs('delayNoteCode')} end as temp_code,
      case when product = {smpf} and coalesce(ref, '') <> '' then {theirs('KCI9652Notes')} end as first_delay,
      case when product = {wlr} and coalesce(own_ref, '') <> '' then {mine('LastDelayNoteCode')} end as last_note,
      case when product = {gea} and (coalesce(target_line, '') <> '' or coalesce(target_access, '') <> '') then 'Y' else 'N' end as target_dn, left(reason, 4) as kci from q5),
    bun as (select b.value as bundle, {', '.join(f"min(case when f.name = '{n}' then f.value end) as v_{n}" for n in slots)}
      from delay_params b join delay_params f on b.order_number = f.order_number where b.name = 'BundleId' and f.name in {dr.among(*slots)} and f.value <> '' group by b.value),
    q7 as (select q6.*, {slot_sql} {dates} from q6 left join bun using (bundle)),
    q8 as (select q7.*, r.reason is not null as rule_found, {', '.join(f'r.{x} as rule_{x}' for x in rule_fields)}, s.eaos as rule_eaos, s.delay_type,
      g.reason is not null as cfg_found, {', '.join(f'g.{x} as cfg_{x}' for x in ('reappt', 'amend_required', 'confirmation', 'consent'))} from q7
      left join delay_rules r on r.reason = q7.reason and coalesce(try_cast(substr(release, 2, 5) as int), 99999) between r.min_version and r.max_version
      left join (select reason, max(send_eaos) as eaos, max(delay_type) as delay_type from delay_rules group by reason) s on s.reason = q7.reason
      left join (select * from delay_rules where min_version = 3000) g on g.reason = configured),
    q9 as (select q8.*, coalesce(x.value, a.address_scale, 'N') as scale, a.network_notes, coalesce(u.flag, 'N') as or_missed, answer_premium, answer_advanced from q8
      left join delay_addresses a on a.address_key = q8.address_key left join (select * from exchange_params where name = 'ScaleEnabled') x on x.exchange = a.exchange
      left join (select order_number, case when bool_or(string_split(value, '|')[2] in {dr.among(*dr.OR_MISSED_CODES)}) then 'Y' else 'N' end as flag
                 from delay_params where name like 'KSUDelay-%' group by order_number) u on u.order_number = q8.order_number
      left join (select product, string_agg(answer_text, ';' order by answer_id) filter (where svr = 'Premium') as answer_premium,
                 string_agg(answer_text, ';' order by answer_id) filter (where svr = 'Advanced') as answer_advanced from site_visit_texts where flag = 'Y' group by product) t on t.product = q8.product),
    ready as (select *, case when fttp_stages = '2' and ((scale = 'Y' and network_notes in {scale_notes}) or (scale = 'N' and network_notes in {other_notes})) then 'Y' else 'N' end as area_ok,
      (try_cast(own_trc as int) + 1)::varchar as trc_band, (try_cast(coalesce(nullif(own_charge, ''), '0') as int) + 1)::varchar as charge_band,
      {shift('placed', {7: 3, 1: 2, 2: 2, 3: 2, 4: 2, 5: 4, 6: 4})} as survey_day, {shift('commitment', {7: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 3})} as commitment_day,
      replace(substr(required_by, 1, 10) || ' ' || substr(right(required_by, 8), 1, 5), '-', '/') as arrival,
      case when contains(queue, '|') then string_split(queue, '|')[1] end as queue_head,
      replace(notes_xml, '<Note><NoteId>5197</NoteId><NoteType>Warning</NoteType><NoteText>Late.</NoteText></Note>', '') as xml_without_5197,
      case when (product in ({sogea}, {gea}, {fttp}) and reason like '%EU Confirmed%') or reason = '566 - OR Missed Appt (EU Confirmed LLU)' then 'Y' else 'N' end as eu_confirmed,
      case when product = {sogea} and reason like '%9708%' then 'Y' else 'N' end as requested_9708,
      case when reason = '572 - Order delayed due to issue in TOP' then 'Y' else 'N' end as top_delay,
      case when rule_eaos = 'Y' then 'Y' else 'N' end as send_eaos, null::varchar as engineer_arrival,
      case when rule_eaos = 'Y' and delay_type = 'OpenReach' then '' end as no_access, 0::bigint as seq,
      {', '.join(f'{v} as {k}' for k, v in dr.START.items())} from q9)"""


def details_sql() -> str:
    """The branches as DuckDB SQL, up to a table ``details``."""
    area = dr.among(*dr.AREA_REASONS)
    return context_sql() + f""",
    start as ({layers('select * from ready', dr.SBS_START)}),
    a as ({layers("select * from start where marker = 'Y' and kci = '9580'", dr.TRIGGER + dr.BRANCH_A)}),
    rest as (select * replace (case when reason in {area} then area_ok else valid end as valid) from
      (select * from a union all select * from start where not (marker = 'Y' and kci = '9580'))),
    b as ({layers("select * from rest where marker = 'Y' and kci = '9494'", dr.TRIGGER + dr.BRANCH_B + dr.GATE + dr.AFTER_GATE_B)}),
    cc as ({layers("select * from rest where not (marker = 'Y' and kci = '9494')", dr.TRIGGER + dr.LOOKUP + dr.BEFORE_GATE + dr.GATE + dr.AFTER_GATE_C)}),
    done as (select *, 'a' as branch from a union all select *, 'b' from b union all select *, 'c' from cc),
    issued as (select request_id, branch, row_number() over (order by request_ts, request_id, branch) + 7000 as n from done where valid <> 'N'),
    rows as (select done.* replace (coalesce(n, seq) as seq) from done left join issued using (request_id, branch)),
    details as ({layers("select * from rows where branch = 'c'", dr.LATE)} union all select * from rows where branch <> 'c')"""


def ready(t):
    # an order has some thirty attributes, which are sorted by order before they meet
    requests, params, pending, by_order, rules, addresses, exchanges, texts = (
        frame(t, n, ORDERS_A_TASK if n in ("delay_params", "pending", "pending_by_order") else None) for n in INPUT)
    return dd.prepare_requests(requests, params, pending, by_order, rules, addresses, exchanges, answers_wide(texts))


def details(t):
    return dd.delay_details(ready(t), RUN, HOLIDAYS, 7000)


@query("delay_details", details_sql() + "select request_id, branch, " + ", ".join(
    f"{col} as \"{name}\"" if name in dd.RESULT else f"case when branch = 'c' then {col} end as \"{name}\"" for name, col in dd.RESULT_C.items()) + " from details")
def delay_details(t):
    return dd.result_rows(details(t))


@query("delay_audit", details_sql() + """
    select order_number, 'KSUDelay-' || seq as name, '2024-05-23T08:00:00|' || code || '|' || text as value from details where seq > 0""")
def delay_audit(t):
    return dd.audit_of(details(t), RUN)


@query("delay_param_changes", details_sql() + " union all ".join(
    f" select request_ts, {owner} as order_number, '{name}' as name, {value} as value from details where branch = 'c' and ({cond})"
    for cond, owner, name, value in dr.PARAM_CHANGES))
def delay_param_changes(t):
    return dd.param_changes(details(t))


BLANK_SQL = """
    with d as (select event_id, event_type as code, 'text ' || user_id as text, 'Warning' as type, '' as subsequent, props as reason,
        case event_type when 'view' then '' when 'click' then 'KSU1,KSU2' when 'error' then 'KSU2' end as stages,
        case when user_id % 2 = 0 then 'KSU1' else 'KSU2' end as stage from events),
    v as (select *, coalesce(stages, '') = '' or ',' || stages || ',' like '%,' || stage || ',%' as ok from d)
    select event_id, case when ok then code else '' end as code, case when ok then text else '' end as text, case when ok then type else '' end as type,
           case when ok then subsequent else reason end as subsequent from v"""


@query("delay_blanking", BLANK_SQL)
def delay_blanking(t):
    from loomwork.functions.values import in_text_list
    kind = c("event_type")
    rows = t.events.select(
        "event_id", kind.alias("code"), F.concat(F.lit("text "), c("user_id").cast("string")).alias("text"), F.lit("Warning").alias("type"),
        F.lit("").alias("subsequent"), c("props").alias("reason"),
        F.when(kind == "view", "").when(kind == "click", "KSU1,KSU2").when(kind == "error", "KSU2").alias("stages"),
        F.when(c("user_id") % 2 == 0, "KSU1").otherwise("KSU2").alias("stage"))
    out = dd.blanked(rows, ["code", "text", "type"], in_text_list(c("stages"), c("stage")), "subsequent", "reason")
    return out.select("event_id", "code", "text", "type", "subsequent")


FOLLOW = """
    select event_id, case cast(floor(event_id / 5) as bigint) % 11 when 0 then '5197' when 1 then '577' when 2 then '597' when 3 then '567' when 4 then '9544'
      when 5 then '566' when 6 then '569' when 7 then '5463' when 8 then '5466' when 9 then '572' else '565' end as code,
      case user_id % 4 when 0 then 'Generic Ethernet Access' when 1 then 'MPF' when 2 then 'WLR3 PSTN Single Line' else 'SMPF' end as product,
      case when user_id % 4 = 2 then 'Generic Ethernet Access' else 'WLR3 PSTN Single Line' end as product2, case when user_id % 3 = 0 then 'N' else 'Y' end as marker,
      case event_type when 'view' then 'KSU1' else 'KSU2' end as stage, case when value < 10 then 'Migration from X' when value < 20 then 'Migration from SOTAP' end as migrate,
      case when value > 30 then 'Y' else 'N' end as target_dn, case when value > 25 then 'Y' else 'N' end as or_missed, case when value > 40 then 'Y' else 'N' end as pcp_only,
      case when value < 15 then '5463' end as last_note, 'CPBT' as reappt, '' as subsequent, 'N' as amend_required, 'Y' as confirmation, 'Delayed' as type, 'A text.' as text,
      cast(null as string) as item_type, cast(null as string) as item_text from {events}"""
REASONS = """case code when '5197' then '5197 - EU Missed Appt' when '566' then '566 - OR Missed Appt (EU Confirmed)'
    when '569' then '569 - Delay Faulty Tie Pair Amend' else code || ' - other' end"""
FOLLOW_OUT = ["event_id", "code", "subsequent", "reappt", "amend_required", "confirmation", "item_type", "item_text"]


@query("followon_reason", f"select {', '.join(FOLLOW_OUT)} from (" + layers(
    f"select *, {REASONS} as reason, code as kci from (" + FOLLOW.replace("{events}", "events") + ")", dr.FOLLOW_ON) + ")")
def followon_reason(t):
    rows = t.spark.sql(f"select *, {REASONS} as reason, code as kci from (" + FOLLOW + ")", events=t.events)
    return apply_rules(rows, dr.FOLLOW_ON).select(*FOLLOW_OUT)
