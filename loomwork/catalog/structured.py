"""JSON, XML and delimited-array functions."""

from pyspark.sql import functions as F

from loomwork.catalog.registry import query
from loomwork.functions import structured as s

c = F.col


@query("json_type", """
    with j as (select event_id, case event_type when 'view' then props when 'click' then '[1, ' || user_id || ', [2]]' when 'purchase' then '"text"'
        when 'error' then case when user_id < 50 then user_id || '.5' when user_id < 100 then 'true' else 'not json' end
        else case when user_id < 75 then 'null' else cast(user_id as varchar) end end as j from events)
    select event_id, json_valid(j) as valid, case when not json_valid(j) then 'not json' else case json_type(j) when 'OBJECT' then 'object{' || len(json_keys(j)) || ' keys}'
        when 'ARRAY' then 'array[' || json_array_length(j) || ']' when 'VARCHAR' then 'str(''' || trim(j, '"') || ''')' when 'BOOLEAN' then 'bool(True)'
        when 'NULL' then 'null' when 'DOUBLE' then 'float(' || j || ')' else 'int(' || j || ')' end end as kind from j""")
def json_type(t):
    user = c("user_id")
    text = (F.when(c("event_type") == "view", c("props")).when(c("event_type") == "click", F.concat(F.lit("[1, "), user.cast("string"), F.lit(", [2]]")))
            .when(c("event_type") == "purchase", '"text"')
            .when(c("event_type") == "error", F.when(user < 50, F.concat(user.cast("string"), F.lit(".5"))).when(user < 100, "true").otherwise("not json"))
            .otherwise(F.when(user < 75, "null").otherwise(user.cast("string"))))
    return t.events.select("event_id", s.is_json(text).alias("valid"), s.describe_json(text).alias("kind"))


@query("json_nodes", """
    select event_id, 6 + 1 + case when user_id < 75 then 2 else 0 end as nodes from events""")
def json_nodes(t):
    # {"id": n, "type": "x:y", "props": {"k": n}, "list": [...]}: object, two scalars, inner object with one, list and its entries
    text = F.concat(F.lit('{"id": '), c("event_id").cast("string"), F.lit(', "type": "x: {1}", "props": '), c("props"), F.lit(', "list": ['),
                    F.when(c("user_id") < 75, '1.5e3, "a\\"b", null').otherwise("true"), F.lit("]}"))
    return t.events.select("event_id", s.json_nodes(text).alias("nodes"))


@query("json_build", """
    select n_nationkey, json_object('id', n_nationkey, 'name', n_name, 'big', cast(n_nationkey::hugeint * 9007199254740993 as varchar), 'tags', [n_regionkey, 1])::varchar as j from nation""")
def json_build(t):
    row = F.struct(c("n_nationkey").alias("id"), c("n_name").alias("name"),
                   (c("n_nationkey").cast("decimal(10,0)") * F.lit(9007199254740993).cast("decimal(16,0)")).cast("string").alias("big"),
                   F.array("n_regionkey", F.lit(1)).alias("tags"))
    return t.nation.select("n_nationkey", F.to_json(row).alias("j"))


@query("xml_build", """
    select n_nationkey, '<Note><NoteId>' || (600 + n_regionkey) || '</NoteId><NoteType>Delay Notes</NoteType><NoteText>' || n_name || ' &lt;&amp;&gt;</NoteText></Note>'
        || '<Note><NoteId>3511</NoteId><NoteType>Engineer Notes</NoteType><NoteText>23/05/2024 08:00:00</NoteText></Note>' as xml from nation""")
def xml_build(t):
    first = s.note((F.lit(600) + c("n_regionkey")).cast("string"), F.lit("Delay Notes"), F.concat("n_name", F.lit(" <&>")))
    stamp = F.date_format(F.lit("2024-05-23 08:00:00").cast("timestamp_ntz"), "dd/MM/yyyy HH:mm:ss")
    return t.nation.select("n_nationkey", F.concat(first, s.note(F.lit("3511"), F.lit("Engineer Notes"), stamp)).alias("xml"))


@query("xml_remove_note", """
    select o_orderkey, '<Note><NoteId>600</NoteId><NoteType>Info</NoteType><NoteText>' || o_orderpriority || '</NoteText></Note>' as xml from orders""")
def xml_remove_note(t):
    # the note to remove comes before, after, or on both sides of the one that stays
    gone, stays = s.note(F.lit("5197"), F.lit("Warning"), c("o_orderstatus")), s.note(F.lit("600"), F.lit("Info"), c("o_orderpriority"))
    xml = (F.when(c("o_orderstatus") == "F", F.concat(gone, stays)).when(c("o_orderstatus") == "O", F.concat(stays, gone))
           .otherwise(F.concat(gone, stays, gone)))
    return t.orders.select("o_orderkey", s.without_note(xml, "5197").alias("xml"))


@query("pipe_rows", """
    select p_partkey, i::int as id, string_split(p_type || '|' || p_name || '|' || p_brand, '|')[i] as data from part, (values (1), (2), (3)) v(i)""")
def pipe_rows(t):
    return s.pipe_rows(t.part.select("p_partkey", F.concat_ws("|", "p_type", "p_name", "p_brand").alias("v")), "v", "p_partkey")
