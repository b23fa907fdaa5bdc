"""Composed jobs: token analysis, order check, swaps, eligibility, queues and filters."""

from pyspark.sql import functions as F

from loomwork.catalog.derived import duck, frame
from loomwork.catalog.registry import query, rollup_sql
from loomwork.plans import eligibility as el
from loomwork.plans import order_check as oc
from loomwork.plans import token_analysis as ta

c = F.col
RUN_TS = "2024-05-23 08:00:00"

def rolled(op: str, **more: str) -> str:
    lists = {"nad_key": True, "status": False, "createtype": True}
    return (f"select * rename (nad_key as new_key, n_rows as cnt) from ({rollup_sql(f'select * from token_base where createtype {op} {chr(39)}R{chr(39)}', 'tokenid', lists, more)})")


def token_tables(t):
    return frame(t, "token_base"), frame(t, "repository"), frame(t, "address_list")


@query("token_analysis", "with " + duck("token_base", "repository", "address_list") + ", a as (" + rolled("<>") + """)
    select a.*, cir_key, tr_sub_premise_key, case when c.nad_key is not null then 'Y' else 'N' end as in_baabp from a
    left join (select * from repository where cir_type = 'O') b on a.tokenid = b.cir_key left join address_list c on tr_sub_premise_key = c.nad_key""")
def token_analysis(t):
    return ta.token_analysis(*token_tables(t), kind="R", source="O")


@query("token_analysis_uprn", "with " + duck("token_base", "repository", "address_list") + ", a as (" + rolled("=", uprn="max(uprn)") + """)
    select a.*, cir_key, tr_sub_premise_key, case when c.nad_key is not null then 'Y' else 'N' end as in_baabp, d.nad_key as baabp_key from a
    left join (select * from repository where cir_type = 'O') b on a.tokenid = b.cir_key left join address_list c on tr_sub_premise_key = c.nad_key
    left join address_list d on a.uprn = d.uprn""")
def token_analysis_uprn(t):
    return ta.token_analysis_uprn(*token_tables(t), kind="R", source="O")


CHECK_TABLES = ("requests", "units", "ports", "addresses", "exchange_params", "behaviours")
HIGH = "down in ('2500Mbit/s', '3300Mbit/s', '5500Mbit/s', '8500Mbit/s')"
MIDDLE = "down in ('1200Mbit/s', '1800Mbit/s') and up = '120Mbit/s'"
MODIFY = "contains(sub_order_type, 'Modify')"


def check_sql(switch_on: bool) -> str:
    """The check as one CASE per result column over a fact table."""
    model = "case when coalesce(m.value, '') = '' then '2.5G' else m.value end" if switch_on else "m.value"
    compatible = "'The requested service is not compatible with the network infrastructure serving the end customer premises.'"
    visit = "'The Site Visit Reason of ' || site_visit || ' is not available for this product.'"
    installed, opened = "'Incompatible Installation exists'", "'Order rejected due to conflicting open order'"
    only = "'The requested service can only be ordered as part of an End Customer Install'"
    return "with " + duck(*CHECK_TABLES) + f""",
    r as (select q.* exclude (serial), coalesce(nullif(q.serial, ''), u.serial) as serial from requests q left join units u on q.reference = u.reference),
    p as (select serial, count(*) as ports, count(*) filter (where status = 'W') as working, count(*) filter (where status = 'W' and service_id like 'OFVA%') as voice,
          min(nullif(inflight_order, '')) as inflight from ports group by serial),
    f as (select r.*, coalesce(p.ports, 0) as ports, coalesce(p.working, 0) as working, coalesce(p.voice, 0) as voice, u.type, u.bandwidth, l.value as l2s,
          coalesce(nullif(u.maker, ''), l.value) as maker, x.value as xgs, {model} as model, b.value as behaviour,
          p.inflight in (select cast(order_number as varchar) from behaviours) as open_order
          from r left join p on r.serial = p.serial left join units u on r.serial = u.serial left join addresses a on r.address_key = a.address_key
          left join exchange_params m on m.exchange = a.exchange and m.name = 'ONTmodel' left join exchange_params x on x.exchange = a.exchange and x.name = 'XGS_Enabled'
          left join exchange_params l on l.exchange = a.exchange and l.name = 'L2SManufacturer' left join behaviours b on b.order_number = r.order_number),
    g as (select *, product = 'Generic Ethernet Access - FTTP' as fttp, coalesce(bandwidth, '') <> 'XGSPON' as no_xgs, coalesce(behaviour, '') as bhv,
          case when coalesce(behaviour, '') = '9739-Incompatible infrastructure' and model = '2.5G' and {MODIFY} then 1
               when coalesce(model, '') = '' and {MODIFY} and {MIDDLE} then 2 when ports > 1 and working > 1 and model = '2.5G' and {MODIFY} then 3
               when model = '2.5G' and {MODIFY} and voice >= 1 then 4 when open_order then 5 end as early,
          coalesce(ports > 1 and working = 1 and model = '2.5G' and {MODIFY} and {MIDDLE}, false) as several,
          coalesce(type not in ('SDX 611q GPON ONU', 'G-010G-T') and working = 1 and model = '2.5G' and {MODIFY} and {MIDDLE}, false) as single from f),
    h as (select *, fttp and early is null and (several or single) as sw, fttp and early is null and several as prunes, coalesce(reference, '') <> '' as has_ref from g),
    i as (select *, case when not fttp then null when early is not null then early
          when {MODIFY} and site_visit in ('Standard', 'Premium') and has_ref and not sw and not {HIGH} then 6
          when {MODIFY} and site_visit in ('Premium', 'Advanced') and has_ref and sw then 7
          when {MODIFY} and has_ref and sw and site_visit = 'No site visit' then 8
          when not coalesce({HIGH}, false) then null
          when no_xgs and site_visit = 'No site visit' and working = 1 then 9
          when no_xgs and site_visit in ('Premium', 'Advanced') and working = 1 and coalesce(type, '') <> 'SDX 610s GPON SFP ONU' then 10
          when not no_xgs and site_visit = 'Standard' then 11 when site_visit in ('Standard', 'Premium') and working > 1 then 12
          when site_visit = 'Standard' and working = 1 and coalesce(xgs, '') <> 'Y' and no_xgs then 13
          when voice >= 1 and (coalesce(model, '') = '1G' or coalesce(bandwidth, '') = '1G') then 14
          when maker in ('Huawei', 'ECI') and working = 1 and site_visit = 'Standard' and no_xgs then 15
          when type = 'SDX 610s GPON SFP ONU' and working = 1 and site_visit in ('Standard', 'Advanced', 'Premium') then 16
          when no_xgs and site_visit = 'Standard' and working = 1 and bhv = '7006-Conflicting open order' then 17 end as rule from h),
    j as (select *, case when rule is null and sw then 'box' when rule is null and coalesce({HIGH} and site_visit = 'Standard' and working = 1 and no_xgs and xgs = 'Y' and fttp, false)
          then 'xgs' end as swap from i),
    n as (select order_number, row_number() over (order by request_ts, order_number) - 1 as n from j where swap is not null),
    k as (select j.*, case when n.n is not null then 'ALCLF101' || chr(cast(65 + n.n // 999 // 26 as int)) || chr(cast(65 + n.n // 999 % 26 as int)) || lpad(cast(n.n % 999 + 1 as varchar), 3, '0') end as new_serial,
          case when rule in (1, 2, 15, 16) then '9739' when rule in (3, 4, 12, 13, 14) then '113' when rule in (5, 17) then '7006' when rule in (6, 7, 10, 11) then '9779' when rule in (8, 9) then '9764' end as code,
          case when rule in (1, 2, 15, 16) then {compatible} when rule in (3, 4, 12, 13, 14) then {installed} when rule in (5, 17) then {opened}
               when rule in (6, 7, 10, 11) then {visit} when rule in (8, 9) then {only} end as reason
          from j left join n on j.order_number = n.order_number)"""


def decided(t, switch_on: bool):
    tables = [frame(t, n) for n in CHECK_TABLES]
    return oc.check_orders(*tables, switch_on=switch_on)


@query("order_check", check_sql(False) + """
    select order_number, coalesce(new_serial, serial) as serial, reason, code, case when sw then '2.5G_ONTbox-swap' end as lookup_key,
           case when rule is null then reference end as reference from k""")
def order_check(t):
    return oc.result_rows(decided(t, False))


@query("swap_changes", check_sql(True) + """,
    s as (select * from k where swap is not null),
    q as (select s.*, o.port, o.port_type, o.service_id as port_service,
          row_number() over (partition by s.order_number order by o.port, o.port_type, o.service_id) as rn from s join ports o on s.serial = o.serial)
    select 'units' as table_name, 'update' as action, serial as old_serial, null::varchar as port, new_serial,
           case l2s when 'NOKIA' then 'G-010G-T' when 'ADTRAN' then 'SDX 611q GPON ONU' else type end as type, null::varchar as service_id, order_number as inflight_order,
           case when l2s in ('NOKIA', 'ADTRAN') then '2024-05-23 08:00:00' end as installed, 'I' as status from s where swap = 'box' and has_ref
    union all select 'ports', 'update', serial, port::varchar, new_serial, null, port_service, order_number, null, 'I' from q where swap = 'box' and (not prunes or rn = 1)
    union all select 'ports', 'delete', serial, port::varchar, null, null, null, null, null, null from q where swap = 'xgs' or (prunes and rn > 1)
    union all select 'units', 'delete', serial, null, null, null, null, null, null, null from s where swap = 'xgs'
    union all select 'units', 'insert', serial, null, new_serial, 'XGSPON_1+0ONT', null, order_number, null, 'I' from s where swap = 'xgs'
    union all select 'ports', 'insert', serial, '1', new_serial, null, service_id, order_number, null, 'I' from s where swap = 'xgs'""")
def swap_changes(t):
    return oc.change_set(decided(t, True), frame(t, "units"), frame(t, "ports"), RUN_TS)


@query("area_eligibility", "with " + duck("addresses", "exchange_params") + """,
    f as (select order_number, stages, notes, coalesce(x.value, case when a.balance > 5000 then 'Y' when a.balance > 2500 then 'N' end, 'N') as scale from
      (select o_orderkey as order_number, o_custkey, case o_orderstatus when 'O' then '2' when 'P' then '3' end as stages,
       case o_orderpriority when '1-URGENT' then 'UG congested duct' when '2-HIGH' then 'UG Feed Not Evaluated' when '3-MEDIUM' then 'UG Part proven' when '5-LOW' then 'none' end as notes from orders)
      left join addresses a on o_custkey = a.address_key left join (select * from exchange_params where name = 'ScaleEnabled') x on a.exchange = x.exchange)
    select order_number, case when stages = '2' and ((scale = 'Y' and notes in ('UG congested duct', 'UG Potential Wayleave Issues', 'UG partial Direct In Ground', 'UG Feed Not Evaluated'))
      or (scale = 'N' and notes in ('UG congested duct', 'UG Potential Wayleave Issues', 'UG partial Direct In Ground', 'UG Part proven', 'UG navigable with camera', 'UG Linked duct', 'OH Potential Wayleave issues')))
      then 'Y' else 'N' end as valid from f""")
def area_eligibility(t):
    orders = t.orders.select(
        c("o_orderkey").alias("order_number"), c("o_custkey").alias("address_key"),
        F.when(c("o_orderstatus") == "O", "2").when(c("o_orderstatus") == "P", "3").alias("stages"),
        F.expr("case o_orderpriority when '1-URGENT' then 'UG congested duct' when '2-HIGH' then 'UG Feed Not Evaluated' "
               "when '3-MEDIUM' then 'UG Part proven' when '5-LOW' then 'none' end").alias("notes"))
    address = frame(t, "addresses").withColumn("address_scale", F.when(c("balance") > 5000, "Y").when(c("balance") > 2500, "N"))
    switch = frame(t, "exchange_params").where("name = 'ScaleEnabled'").select("exchange", c("value").alias("exchange_scale"))
    rows = orders.join(address, "address_key", "left").join(switch, "exchange", "left")
    return el.area_valid(rows, "address_scale", "exchange_scale", "notes", "stages", "valid").select("order_number", "valid")


@query("queue_unroll", """
    with q as (select o_orderkey, o_orderpriority || '|' || o_custkey || case when o_orderstatus = 'F' then '' else '|' || o_orderstatus || '|end' end as q from orders),
    s as (select *, unnest(generate_series(1, len(string_split(q, '|')) - 1)) as step from q)
    select o_orderkey, cast(step as int) as step, string_split(q, '|')[step] as head, array_to_string(string_split(q, '|')[step + 1:], '|') as rest from s""")
def queue_unroll(t):
    queue = F.when(c("o_orderstatus") == "F", F.concat_ws("|", "o_orderpriority", c("o_custkey").cast("string"))).otherwise(
        F.concat_ws("|", "o_orderpriority", c("o_custkey").cast("string"), "o_orderstatus", F.lit("end")))
    rows = t.orders.select("o_orderkey", F.split(queue, r"\|").alias("q"))
    # every step at once: the head of step n is entry n, the last entry stays in the queue
    rows = rows.select("o_orderkey", "q", F.posexplode(F.slice("q", F.lit(1), F.size("q") - 1)).alias("at", "head"))
    return rows.select("o_orderkey", (c("at") + 1).alias("step"), "head",
                       F.array_join(F.slice("q", c("at") + 2, F.size("q")), "|").alias("rest"))


@query("optional_filters", """
    select o_orderkey, o_orderdate, o_orderpriority from orders where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH')
    and o_orderdate >= timestamp '1996-01-01' and o_orderdate <= timestamp '1998-12-31'""")
def optional_filters(t):
    import datetime
    rows = el.filtered(t.orders, ["o_orderdate", "o_orderkey"], o_orderstatus="O", o_custkey=None, o_orderpriority=["1-URGENT", "2-HIGH"],
                       o_orderdate_from=datetime.date(1996, 1, 1), o_orderdate_to=datetime.date(1998, 12, 31), o_totalprice_to=None)
    return rows.select("o_orderkey", "o_orderdate", "o_orderpriority")
