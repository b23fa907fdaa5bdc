"""Functions in SQL text, chained steps, user functions and bound parameters."""

import pandas as pd
from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.functions.registered import register
from loomwork.operators.steps import pipe


@query("udtf_pipe_rows", """
    select p_partkey, i::int as id, string_split(p_type || '|' || p_name || '|' || p_brand, '|')[i] as data from part, (values (1), (2), (3)) v(i)""")
def udtf_pipe_rows(t):
    register(t.spark)
    return t.spark.sql("""
        select p_partkey, r.id, r.data from {part},
        lateral pipe_rows(concat_ws('|', p_type, p_name, p_brand)) r""", part=t.part)


@query("pipe_steps", """
    select o_custkey, count(*) as n, round(sum(o_totalprice * 0.9), 4) as total from orders where o_orderstatus <> 'F' group by o_custkey having count(*) > 5""")
def pipe_steps(t):
    steps = pipe(lambda df: df.where("o_orderstatus <> 'F'"),
                 lambda df: df.withColumn("net", F.col("o_totalprice") * 0.9),
                 lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net"), 4).alias("total")),
                 lambda df: df.where("n > 5"))
    return t.orders.transform(steps)


@query("pandas_udf_map", "select doc_id, strip_accents(text) as plain from documents")
def pandas_udf_map(t):
    # ten thousand whole texts in a batch fill a Python worker, so batches are bounded in bytes
    t.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))

    # no built-in takes the accents off letters
    @F.pandas_udf("string")
    def plain(text: pd.Series) -> pd.Series:
        return text.str.normalize("NFD").str.replace(r"[\u0300-\u036f]", "", regex=True).str.normalize("NFC")
    return t.documents.select("doc_id", plain("text").alias("plain"))


@query("sql_scalar_function", "select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem")
def sql_scalar_function(t):
    """A scalar function defined in SQL text and called from SQL text."""
    t.spark.sql("create or replace temporary function loomwork_net(price double, discount double) returns double return round(price * (1 - discount), 4)")
    return t.spark.sql("select l_orderkey, l_linenumber, l_partkey, loomwork_net(l_extendedprice, l_discount) as net from {lineitem}", lineitem=t.lineitem)


@query("user_aggregate", """
    select o_custkey, round(exp(sum(ln(o_totalprice)) / count(*)), 3) as geometric_mean from orders where o_totalprice > 0 group by o_custkey""")
def user_aggregate(t):
    """A user's aggregate as a function of columns: its state is made of built-in aggregates, so Spark combines it before the shuffle."""
    def geometric_mean(value):
        return F.exp(F.avg(F.ln(value)))

    return t.orders.where("o_totalprice > 0").groupBy("o_custkey").agg(F.round(geometric_mean("o_totalprice"), 3).alias("geometric_mean"))


@query("bound_params", "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_acctbal > 1000")
def bound_params(t):
    return t.spark.sql("select c_custkey, c_name from {customer} where c_mktsegment = ? and c_acctbal > ?",
                       args=["BUILDING", 1000], customer=t.customer)
