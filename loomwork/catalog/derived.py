"""Order-domain tables made from the given tables, in SQL that Spark and DuckDB both read.

Each text is a query over the given tables (written ``{orders}`` etc.), so the
derived tables grow with them.
"""

from __future__ import annotations

from loomwork.catalog import delay_data

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

SQL = {
    # ---- token analysis -------------------------------------------------
    "token_base": """
        select cast(l_orderkey as string) as tokenid, cast(l_partkey as string) as nad_key,
               l_returnflag as createtype, l_linestatus as status, cast(l_suppkey as string) as uprn from {lineitem}""",
    "repository": """
        select cast(o_orderkey as string) as cir_key, cast(o_custkey as string) as tr_sub_premise_key,
               o_orderstatus as cir_type from {orders}""",
    "address_list": """
        select cast(c_custkey as string) as nad_key, cast(c_custkey * 2 as string) as uprn from {customer}
        where c_mktsegment <> 'BUILDING'""",
    # ---- modify-order check ---------------------------------------------
    "requests": """
        select o_orderdate as request_ts, o_orderkey as order_number, 'SV' || o_custkey as service_id, o_custkey as address_key,
               case when o_orderkey % 2 = 0 then '' when o_orderkey % 13 = 1 then null else 'S' || lpad(cast(o_orderkey as string), 9, '0') end as serial,
               case when o_orderkey % 11 = 3 then '' else 'REF' || o_orderkey end as reference,
               case when o_orderstatus = 'F' and o_custkey % 3 = 0 then 'Provide' else 'Modify Bandwidth' end as sub_order_type,
               case when o_orderkey % 16 = 0 then 'FVA' else 'Generic Ethernet Access - FTTP' end as product,
               case o_orderpriority when '1-URGENT' then 'Standard' when '2-HIGH' then 'Premium' when '3-MEDIUM' then 'Advanced'
                    when '4-NOT SPECIFIED' then 'No site visit' else 'Standard' end as site_visit,
               case when o_orderkey % 97 = 5 then null when o_totalprice < 80000 then '550Mbit/s' when o_totalprice < 170000 then '1200Mbit/s'
                    when o_totalprice < 260000 then '1800Mbit/s' when o_totalprice < 330000 then '2500Mbit/s'
                    when o_totalprice < 400000 then '3300Mbit/s' else '8500Mbit/s' end as down,
               case when o_custkey % 4 = 0 then '50Mbit/s' else '120Mbit/s' end as up from {orders}""",
    "units": """
        select 'REF' || o_orderkey as reference, 'S' || lpad(cast(o_orderkey as string), 9, '0') as serial,
               case o_orderkey % 5 when 0 then 'SDX 611q GPON ONU' when 1 then 'G-010G-T' when 2 then 'SDX 610s GPON SFP ONU' when 3 then 'I-240G' end as type,
               case o_custkey % 5 when 0 then 'XGSPON' when 1 then '1G' when 2 then '2.5G' when 3 then '' end as bandwidth,
               case o_orderkey % 7 when 0 then 'Huawei' when 1 then 'ECI' when 2 then '' when 3 then null else 'NOKIA' end as maker from {orders}""",
    "ports": """
        select 'S' || lpad(cast(l_orderkey as string), 9, '0') as serial, l_linenumber as port, l_linestatus as port_type,
               case when l_returnflag = 'A' then 'W' else 'I' end as status,
               case when l_quantity > 47 then 'OFVA' || l_partkey else 'SV' || l_suppkey end as service_id,
               case when l_discount >= 0.095 and l_quantity > 25 then cast(l_partkey as string) else '' end as inflight_order from {lineitem}""",
    "addresses": "select c_custkey as address_key, 'EX' || c_nationkey as exchange, c_mktsegment as segment, c_acctbal as balance from {customer}",
    "exchange_params": """
        select 'EX' || n_nationkey as exchange, 'ONTmodel' as name, case n_nationkey % 3 when 0 then '2.5G' when 1 then '1G' else '' end as value from {nation}
        union all select 'EX' || n_nationkey, 'XGS_Enabled', case when n_nationkey % 2 = 0 then 'Y' else 'N' end from {nation}
        union all select 'EX' || n_nationkey, 'L2SManufacturer', case n_nationkey % 4 when 0 then 'NOKIA' when 1 then 'ADTRAN' else 'ECI' end from {nation}
        union all select 'EX' || n_nationkey, 'ScaleEnabled', case when n_nationkey % 2 = 0 then 'Y' else 'N' end from {nation} where n_nationkey % 3 = 0""",
    "behaviours": """
        select o_orderkey as order_number, 'OrderBehaviour' as name,
               case when o_orderkey % 18 = 0 then '9739-Incompatible infrastructure' else '7006-Conflicting open order' end as value
        from {orders} where o_orderkey % 9 = 0""",
}

SQL |= delay_data.SQL


def duck(*names: str) -> str:
    """``name as (query)`` entries for a DuckDB WITH clause."""
    at = {t: t for t in TABLES}
    return ", ".join(f"{n} as ({_put(SQL[n], at)})" for n in names)


def _put(text: str, names: dict[str, str]) -> str:
    for table, name in names.items():
        text = text.replace("{" + table + "}", name)
    return text


def _dealt(df, task_rows: int):
    rows = df.count()
    return df.repartition(-(-rows // task_rows)) if rows > task_rows else df


def frame(t, name: str, task_rows: int | None = None):
    """The derived table as a DataFrame; with ``task_rows``, made in tasks of about so many given rows.

    A few bytes of a given table may make many rows, which sort in memory only in small parts.
    """
    text = SQL[name]
    used = {x: getattr(t, x) for x in TABLES if "{" + x + "}" in text}
    if task_rows:
        used = {x: _dealt(df, task_rows) for x, df in used.items()}
    return t.spark.sql(text, **used)
