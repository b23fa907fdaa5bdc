"""Math functions."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.functions import maths as m

c = F.col


@query("vector_dot", """
    with e as (select vec_id, embedding::double[] as a, list_reverse(embedding::double[]) as b from embeddings)
    select vec_id, round(list_inner_product(a, b), 4) + 0.0 as dot, round(sqrt(list_inner_product(a, a)), 4) as size, round(list_distance(a, b), 4) as apart from e""")
def vector_dot(t):
    a, b = c("embedding"), F.reverse("embedding")
    return t.embeddings.select("vec_id", (F.round(m.dot(a, b), 4) + 0.0).alias("dot"), F.round(m.magnitude(a), 4).alias("size"),
                               F.round(m.distance(a, b), 4).alias("apart"))


@query("compound_growth", "select c_custkey, round(c_acctbal * pow(1 + 0.05 / 12, 12 * c_nationkey), 4) as grown from customer")
def compound_growth(t):
    return t.customer.select("c_custkey", F.round(m.compound(c("c_acctbal"), F.lit(0.05), c("c_nationkey")), 4).alias("grown"))


@query("clamp", "select l_orderkey, l_linenumber, l_partkey, greatest(10, least(l_quantity, 40)) as qty from lineitem")
def clamp(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", m.clamp(c("l_quantity"), 10.0, 40.0).alias("qty"))


@query("int_divide", """
    with n as (select c_custkey, cast(round(c_acctbal * 100) as bigint) as a from customer)
    select c_custkey, cast(floor(a / 7.0) as bigint) as floored, cast(trunc(a / 7.0) as bigint) as cut, ((a % 7) + 7) % 7 as floor_mod, a % 7 as rest from n""")
def int_divide(t):
    a = F.round(c("c_acctbal") * 100).cast("bigint")
    return t.customer.select("c_custkey", a.alias("a")).select(
        "c_custkey", m.floor_div(c("a"), 7).cast("bigint").alias("floored"), F.expr("a div 7").alias("cut"),
        m.floor_mod(c("a"), 7).alias("floor_mod"), (c("a") % 7).alias("rest"))


@query("bit_flags", """
    select o_orderkey, o_orderkey & 10 as both, o_orderkey | 6 as either, xor(o_orderkey, 6) as one, (o_orderkey << 4) as up, (o_orderkey >> 2) as down, ~o_orderkey as inv from orders""")
def bit_flags(t):
    k = c("o_orderkey")
    return t.orders.select("o_orderkey", k.bitwiseAND(10).alias("both"), k.bitwiseOR(6).alias("either"), k.bitwiseXOR(6).alias("one"),
                           F.shiftleft(k, 4).alias("up"), F.shiftright(k, 2).alias("down"), F.bitwise_not(k).alias("inv"))


@query("wrap_bits", """
    with w as (select o_orderkey, o_orderkey::hugeint * 12345678901234567 as v from orders),
    b as (select o_orderkey, v % 256 as u8, v % 18446744073709551616 as u64 from w)
    select o_orderkey, u8::varchar as u8, (case when u8 >= 128 then u8 - 256 else u8 end)::varchar as i8, u64::varchar as u64,
           (case when u64 >= 9223372036854775808 then u64 - 18446744073709551616 else u64 end)::varchar as i64 from b""")
def wrap_bits(t):
    v = c("o_orderkey").cast("decimal(20,0)") * F.lit(12345678901234567).cast("decimal(17,0)")
    return t.orders.select("o_orderkey", m.wrap_unsigned(v, 8).cast("string").alias("u8"), m.wrap_signed(v, 8).cast("string").alias("i8"),
                           m.wrap_unsigned(v, 64).cast("string").alias("u64"), m.wrap_signed(v, 64).cast("string").alias("i64"))


@query("big_integers", """
    select o_custkey, sum(o_orderkey::hugeint * 9007199254740993)::varchar as total, max(o_orderkey::hugeint * 9007199254740993 + 1)::varchar as top from orders group by o_custkey""")
def big_integers(t):
    v = c("o_orderkey").cast("decimal(19,0)") * F.lit(9007199254740993).cast("decimal(16,0)")
    return t.orders.groupBy("o_custkey").agg(F.sum(v.cast("decimal(38,0)")).cast("string").alias("total"),
                                             F.max(v + 1).cast("decimal(38,0)").cast("string").alias("top"))


@query("safe_divide", """
    with v as (select l_orderkey, l_linenumber, l_partkey, l_quantity as a, l_linenumber - 3 as b, case l_returnflag when 'R' then '/' when 'A' then '-' else '^' end as op from lineitem)
    select l_orderkey, l_linenumber, l_partkey, round(case when b <> 0 then a / b end, 4) as q,
           case when op = '/' and b = 0 then 'Error: Cannot divide by zero.' when op = '/' then round(a / b, 4)::varchar when op = '-' then (a - b)::varchar else 'Unknown operator: ''^''' end as msg from v""")
def safe_divide(t):
    a, b = c("l_quantity"), c("l_linenumber") - 3
    op = F.when(c("l_returnflag") == "R", "/").when(c("l_returnflag") == "A", "-").otherwise("^")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.try_divide(a, b), 4).alias("q"),
                             m.calculate(a, b, op).alias("msg"))


@query("band_increment", """
    select p_partkey, try_cast(string_split(p_brand, '#')[2] as int) + 1 as band, coalesce(try_cast(case when p_type = 'PROMO' then null else string_split(p_brand, '#')[2] end as int) + 1, 4) as required from part""")
def band_increment(t):
    text = F.substring_index("p_brand", "#", -1)
    return t.part.select("p_partkey", m.next_band(text).alias("band"), m.next_band(F.when(c("p_type") != "PROMO", text), 4).alias("required"))


@query("formula_by_type", """
    select p_partkey, round(case p_type when 'SMALL' then pi() * p_size * p_size when 'MEDIUM' then p_size * p_retailprice when 'LARGE' then 0.5 * p_size * p_retailprice
           when 'PROMO' then (p_size + 2) * p_retailprice * p_retailprice / (4 * tan(pi() / (p_size + 2))) end, 4) as area,
           case when (p_size + 50) / pow(1.75, 2) between 18.5 and 24.9 then 'Normal' else 'Outside normal range' end as bmi from part""")
def formula_by_type(t):
    shape = F.create_map(*[F.lit(x) for x in ("SMALL", "circle", "MEDIUM", "rectangle", "LARGE", "triangle", "PROMO", "polygon")])[c("p_type")]
    size = F.when(c("p_type") == "PROMO", c("p_size") + 2).otherwise(c("p_size"))
    bmi = m.body_mass(c("p_size") + 50, F.lit(1.75))
    return t.part.select("p_partkey", F.round(m.area(shape, size, c("p_retailprice")), 4).alias("area"),
                         F.when(bmi.between(18.5, 24.9), "Normal").otherwise("Outside normal range").alias("bmi"))
