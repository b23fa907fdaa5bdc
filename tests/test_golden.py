"""Small cases with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomwork.functions import collections as col
from loomwork.functions import dates, maths, structured, text, values
from loomwork.operators import aggregates, changes, graph, ordering, quality, windows
from loomwork.operators.joins import linked_record
from loomwork.plans.eligibility import area_valid, filtered
from loomwork.operators.steps import compose, pipe
from loomwork.plans.rules import apply_rules, bind, first_rule
from loomwork.sources.text import parse_sections


def one(spark, *exprs):
    return tuple(spark.range(1).select(*exprs).first())


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_arrays(spark):
    nested = F.expr("array(array(array(1), array(2, 3)), array(array(4), array(5, 6)))")
    assert one(spark, col.flat(nested, 2))[0] == [1, 2, 3, 4, 5, 6]
    a = F.expr("array('a', 'b', 'c', 'd', 'e')")
    assert one(spark, F.try_element_at(a, F.lit(-1)), F.try_element_at(a, F.lit(-2)), F.try_element_at(a, F.lit(99))) == ("e", "d", None)
    got = one(spark, col.splice(a, 1, 2, F.lit("X")), col.with_at(a, 0, F.lit("Z")), col.index_of(a, F.lit("q")), col.tail(a))
    assert got == (["a", "X", "d", "e"], ["Z", "b", "c", "d", "e"], -1, ["b", "c", "d", "e"])
    assert one(spark, col.zip_short(F.expr("array(1, 2, 3)"), F.expr("array(10, 20)"), lambda x, y: x + y))[0] == [11, 22]


def test_flat_map_and_ranges(spark):
    n = spark.range(1, 7)
    even = n.select(F.explode(F.when(F.col("id") % 2 == 0, F.array(F.col("id") * 2)).otherwise(F.array().cast("array<bigint>"))))
    assert [r[0] for r in even.collect()] == [4, 8, 12]
    r = spark.createDataFrame([(1, 3), (7, 9)], "a int, b int").select(F.explode(F.sequence("a", "b")).alias("v"))
    assert [x.v for x in r.collect()] == [1, 2, 3, 7, 8, 9]


def test_numbers(spark):
    assert one(spark, F.pow(F.lit(2), F.lit(10)), F.pow(F.lit(10), F.lit(-2))) == (1024.0, 0.01)
    n = F.lit(-7)
    assert one(spark, maths.floor_div(n, 2).cast("int"), F.expr("-7 div 2"), maths.floor_mod(n, 2)) == (-4, -3, 1)
    big = F.lit("18446744073709551616").cast("decimal(38,0)")
    assert [int(x) for x in one(spark, maths.wrap_unsigned(big, 64), maths.wrap_unsigned(big + 5, 64), maths.wrap_signed(F.lit(200), 8),
                                maths.wrap_signed(F.lit(127), 8))] == [0, 5, -56, 127]
    assert one(spark, *[maths.calculate(F.lit(6.0), F.lit(x), F.lit(op)) for x, op in ((0.0, "/"), (4.0, "/"), (1.0, "*"))]) == (
        "Error: Cannot divide by zero.", "1.5", "Unknown operator: '*'")


def test_text(spark):
    got = one(spark, text.pad_start(F.lit("5"), 3, "0"), text.pad_end(F.lit("abc"), 10, "123"), text.pad_start(F.lit("longer"), 3, "0"),
              text.mask(F.lit("4242424242424242")), text.pad_start(F.bin(F.lit(5)), 8, "0"), text.zero_fill(F.lit(7), 3))
    assert got == ("005", "abc1231231", "longer", "************4242", "00000101", "007")
    assert one(spark, F.regexp_extract(F.lit("Total: $42.99"), r"(?<=\$)\d+\.\d+", 0))[0] == "42.99"
    assert one(spark, F.regexp_replace(F.lit("2024-03-15"), r"(\d{4})-(\d{2})-(\d{2})", "$3/$2/$1"))[0] == "15/03/2024"
    double = r"\b(?<w>\w+)\s+\k<w>\b"
    assert one(spark, F.lit("the the quick fox").rlike(double), F.lit("the quick brown fox").rlike(double)) == (True, False)
    assert one(spark, text.size_text(F.lit(1536)), text.middle_field(F.lit("t|code|rest")), text.endpoint(F.lit(None).cast("string")),
               text.endpoint(F.lit("/a?b=1"))) == ("1.5 KB", "code", "NA", "/a")
    assert one(spark, text.queue_head(F.lit("a|b|c")), text.queue_rest(F.lit("a|b|c")), text.queue_head(F.lit("a"))) == ("a", "b|c", None)
    assert one(spark, text.fill(F.lit("%1 and %2"), {"%1": F.lit("x"), "%2": F.lit(None).cast("string")}))[0] is None
    assert one(spark, text.query_map(F.lit("http://h/p?a=1&b=2&a=3#x")))[0] == {"a": "3", "b": "2"}
    assert one(spark, text.template_names(F.lit("Hi {{name}}, {{ no }} {{x1}}")))[0] == ["name", "x1"]


def test_defaults(spark):
    df = spark.createDataFrame([(0, "", False), (None, None, None), (3, "x", True)], "n int, s string, b boolean")
    kept = df.select(values.present_or(F.col("n"), F.lit(9)), values.present_or(F.col("s"), F.lit("d")))
    assert [tuple(r) for r in kept.collect()] == [(0, ""), (9, "d"), (3, "x")]
    falsy = df.select(values.truthy_or(F.col("n"), F.lit(9)), values.truthy_or(F.col("s"), F.lit("d"), ""), values.truthy_or(F.col("b"), F.lit(True), False))
    assert [tuple(r) for r in falsy.collect()] == [(9, "d", True), (9, "d", True), (3, "x", True)]
    assert one(spark, values.in_text_list(F.lit(""), F.lit("a")), values.in_text_list(F.lit("ab,c"), F.lit("a")),
               values.as_int_or(F.lit("12x"), 99999)) == (True, False, 99999)


def test_json_and_xml(spark):
    texts = ["null", "true", "42", "3.14", '"hello"', "[1, 2, 3]", '{"a": 1}', "not json"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(structured.describe_json(F.col("t"))).collect()] == [
        "null", "bool(True)", "int(42)", "float(3.14)", "str('hello')", "array[3]", "object{1 keys}", "not json"]
    assert one(spark, structured.json_nodes(F.lit('{"a": [1, "x: {1}", {"b": null}], "c": true}')))[0] == 7
    assert one(spark, structured.json_leaves(F.lit("[1,[2,[3,[4]]],5]")))[0] == ["1", "2", "3", "4", "5"]
    a, b = (structured.note(F.lit(code), F.lit("T"), F.lit(f"<{code}>")) for code in ("5197", "600"))
    assert one(spark, structured.without_note(F.concat(a, b, a), "5197"))[0] == (
        "<Note><NoteId>600</NoteId><NoteType>T</NoteType><NoteText>&lt;600&gt;</NoteText></Note>")


def test_sections(spark):
    lines = ["early=1", "[a]", "x = 1", "x=2", "noise", "[b]", "y=a=b", "[a]", "z=3"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert rows(parse_sections(df, "file")) == [("f", "a", "z", "3"), ("f", "b", "y", "a=b"), ("f", "default", "early", "1")]


def test_working_days(spark):
    closed = [datetime.date(2024, 5, 27)]
    df = spark.createDataFrame([(datetime.date(2024, 5, 23),), (datetime.date(2024, 5, 25),)], "d date")
    got = df.withColumn("due", dates.working_day_after(F.col("d"), 2, closed))
    assert rows(got) == [(datetime.date(2024, 5, 23), datetime.date(2024, 5, 28)), (datetime.date(2024, 5, 25), datetime.date(2024, 5, 29))]
    got = df.withColumn("n", dates.open_day_after(F.col("d"), closed))
    assert rows(got) == [(datetime.date(2024, 5, 23), datetime.date(2024, 5, 24)), (datetime.date(2024, 5, 25), datetime.date(2024, 5, 28))]


@pytest.mark.parametrize("gap", [3, 11, 400])
def test_working_days_of_any_date(spark, gap):
    """Against a walk over the days; holidays in a row, on weekends, given twice; dates before 1970 and far ahead."""
    day, one_day = datetime.date, datetime.timedelta(1)
    bases = [day(1901, 3, 1), day(1969, 12, 20), day(2024, 2, 20), day(9990, 1, 1)]
    closed = {b + one_day * k for b in bases for k in range(0, 120, gap)} | {bases[2] + one_day * k for k in range(40, 52)}

    def walk(at, n):
        while n > 0 or at.weekday() > 4 or at in closed:
            at, n = (at + one_day, n - (1 if (at + one_day).weekday() < 5 and at + one_day not in closed else 0)) if n > 0 else (at - one_day, 0)
        return at

    days = [b + one_day * k for b in bases for k in range(30, 100)]
    df = spark.createDataFrame([(d, n) for d in days for n in (0, 1, 2, 14)] + [(None, 3)], "d date, n int")
    got = df.select("d", "n", dates.working_day_after(F.col("d"), F.col("n"), [*closed, *closed])).collect()
    for d, n, due in got:
        assert due == (None if d is None else walk(d, n)), (d, n)


@pytest.mark.parametrize("day, survey, commitment", [
    ("2024-05-25", "28-05-2024", "27-05-2024"), ("2024-05-26", "28-05-2024", "27-05-2024"), ("2024-05-23", "27-05-2024", "24-05-2024"),
    ("2024-05-24", "28-05-2024", "27-05-2024")])
def test_weekday_shift(spark, day, survey, commitment):
    t = F.lit(day + "T10:00:00")
    assert one(spark, dates.shifted_text(t, dates.SURVEY_SHIFT), dates.shifted_text(t, dates.COMMITMENT_SHIFT),
               dates.shifted_text(F.lit(day), dates.SURVEY_SHIFT)) == (survey, commitment, day)


def test_odometer_steps_like_the_counter(spark):
    def step(num, letters, head):
        after = (1 if num == 999 else num + 1,
                 letters if num < 999 else "AA" if letters == "ZZ" else
                 chr(ord(letters[0]) + 1) + "A" if letters[1] == "Z" else letters[0] + chr(ord(letters[1]) + 1),
                 head[:6] + str(int(head[6:8]) + 1) if letters == "ZZ" and num == 999 else head)
        return head + letters + f"{num:03d}", after
    state, want = (990, "ZX", "ABCDEF12"), []
    for _ in range(3000):
        serial, state = step(*state)
        want.append(serial)
    got = spark.range(3000).select("id", changes.odometer(F.col("id"), "ABCDEF12", "ZX", 990).alias("s")).orderBy("id")
    assert [r.s for r in got.collect()] == want


@pytest.mark.parametrize("prefix", ["ABCDE101", "ABCDE001", "ABCDE908", "ABCDE009", "ABCDE088"])
def test_odometer_goes_on_after_a_one_digit_result(spark, prefix):
    """The first and last serials of every prefix, against the counter: the last two characters as a number, plus one."""
    pairs, head = 26 * 26 * 999, prefix
    want = {}
    for turn in range(100):
        want |= {turn * pairs: head + "AA001", turn * pairs + pairs - 1: head + "ZZ999"}
        if head[-2:] == "99":
            break
        head = head[:6] + str(int(head[-2:]) + 1)
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", changes.odometer(F.col("n"), prefix, "AA", 1).alias("s"))
    assert {r.n: r.s for r in got.collect()} == want and len(set(want.values())) == len(want)
    with pytest.raises(Exception, match="used up"):
        spark.createDataFrame([(max(want) + 1,)], "n long").select(changes.odometer(F.col("n"), prefix, "AA", 1)).collect()


def test_odometer_fails_without_a_digit_to_read(spark):
    pairs = 26 * 26 * 999
    got = spark.range(2 * pairs - 1, 2 * pairs).select(changes.odometer(F.col("id"), "ABCDEF01", "AA", 1).alias("s")).collect()
    assert got[0].s == "ABCDEF2ZZ999"
    with pytest.raises(Exception, match="used up"):
        spark.range(2 * pairs, 2 * pairs + 1).select(changes.odometer(F.col("id"), "ABCDEF01", "AA", 1)).collect()


def test_odometer_fails_when_used_up(spark):
    with pytest.raises(Exception, match="used up"):
        spark.range(2).select(changes.odometer(F.col("id"), "ABCDEF99", "ZZ", 999)).collect()


def test_cart_totals_match_the_fold(spark):
    import random
    rnd = random.Random(4)
    acts = [(u, i, rnd.choice(["add", "add", "remove", "clear"] if rnd.random() < 0.2 else ["add", "add", "remove"]),
             rnd.randint(1, 4), float(rnd.randint(1, 50))) for i in range(600) for u in [rnd.randint(1, 5)]]
    want = {}
    for u, _, act, item, price in acts:
        items, total = want.get(u, ([], 0.0))
        if act == "add":
            items, total = [*items, (item, price)], total + price
        elif act == "remove":
            first = next((p for i, p in items if i == item), 0.0)
            items, total = [x for x in items if x[0] != item], total - first
        else:
            items, total = [], 0.0
        want[u] = (items, total)
    df = spark.createDataFrame(acts, "u int, n int, act string, item int, price double")
    got = aggregates.cart_totals(df, "u", ["n"], "act", "item", "price")
    assert {r.u: (r["items"], r.total) for r in got.collect()} == {u: (len(i), t) for u, (i, t) in want.items()}


def test_linked_record_matches_pairs(spark):
    data = [(i, i * i % 7, i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "o int, v int, p int")
    got = linked_record(df, "o", ["v"], F.col("p") == 1)
    want = []
    for o, v, p in data:
        others = sorted(b for b, w, q in data if w == v and b != o and q == 1)
        want.append((o, others[0] if others else None, len(others)))
    assert rows(got.select("o", "linked", "n_linked")) == sorted(want, key=repr)


def test_commands_in_order(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    feed = spark.createDataFrame([
        (1, 1, "update", "a2"), (1, 2, "reset", None), (2, 3, "delete", None), (2, 4, "update", "zz"), (4, 5, "create", "d"),
        (4, 6, "update", "d2"), (5, 7, "update", "none"), (3, 8, "delete", None), (3, 9, "create", "c2")], "k int, n int, act string, v string")
    got = changes.apply_commands(base, feed, "k", "act", "v", ["n"])
    assert rows(got) == [(1, "a2", True), (3, "c2", False), (4, "d2", False)]


def test_upsert_and_layers(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, None, 2), (3, "c", 1)], "k int, v string, n int")
    assert rows(changes.upsert(base, new, ["k"], "v", ["n"])) == [(1, "a"), (2, None), (3, "c")]
    layers = [spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 2)], [("b", 20), ("c", 3)], [("c", 30), ("d", 4)],
                                                                  [("d", 40), ("e", 5)])]
    assert rows(ordering.layered(layers, "k", "v")) == [("a", 1), ("b", 20), ("c", 30), ("d", 40), ("e", 5)]


def test_sorting(spark):
    df = spark.createDataFrame([(0, "Alice", "B"), (1, "Bob", "A"), (2, "Carol", "B"), (3, "Dave", "A")], "i int, name string, grade string")
    got = ordering.sorted_positions(df, ["grade", "i"]).orderBy("position")
    assert [r.name for r in got.collect()] == ["Bob", "Dave", "Alice", "Carol"]
    n = spark.createDataFrame([(10,), (9,), (100,), (1,)], "n int").withColumn("t", F.col("n").cast("string"))
    assert [r.n for r in ordering.sorted_positions(n, ["t"]).orderBy("position").collect()] == [1, 10, 100, 9]


def test_first_and_last(spark):
    df = spark.createDataFrame([("u", i, x) for i, x in enumerate(["error", "info", "error", "info"])], "u string, i int, level string")
    hit = windows.first_and_last(df, ["u"], ["i"], F.col("level") == "error", "level").first()
    assert (hit.first_index, hit.last_index, hit.first_value) == (0, 2, "error")
    none = windows.first_and_last(df, ["u"], ["i"], F.col("level") == "fatal", "level").first()
    assert (none.first_index, none.last_index, none.first_value, none.last_value) == (-1, -1, None, None)


def test_number_lines(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["1,2,3", "4,x,6", "7, 8,9", "a,b,c"], 1)], "line_no int, line string")
    good, bad = quality.parse_number_lines(df)
    assert rows(good.select("line_no", "numbers")) == [(1, [1, 2, 3]), (3, [7, 8, 9])]
    assert rows(bad.select("line_no", "cause")) == [(2, "not a number: x"), (4, "not a number: a")]


def test_graph(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E"), ("E", "A")], "src string, dst string")
    got = graph.breadth_first(edges, spark.createDataFrame([("A",)], "node string")).orderBy("position")
    assert [(r.node, r.depth) for r in got.collect()] == [("A", 0), ("B", 1), ("C", 1), ("D", 2), ("E", 3)]
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(37)], "node int, parent int")
    assert rows(graph.chain_ends(links)) == sorted([(i, 0, i) for i in range(37)], key=repr)
    tree = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (2, 4, "a1")], "src int, dst int, label string")
    roots = spark.createDataFrame([(1, "root")], "node int, label string")
    assert [r.node for r in graph.walk_tree(tree, roots).orderBy("path").collect()] == [1, 2, 4, 3]


def test_rules(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (5, None)], "n int, v string")
    rules = [("n > 1", {"v": "'big'"}), ("n > 4", {"v": "'huge'"})]
    assert [r.v for r in first_rule(df, rules, ["v"]).orderBy("n").collect()] == [None, "big", "big"]
    assert [r.v for r in apply_rules(df, rules).orderBy("n").collect()] == [None, "big", "huge"]
    assert [r.v for r in apply_rules(df, [rules]).orderBy("n").collect()] == [None, "big", "big"]
    assert bind([("a = 'w1'", {"v": "w1 || 'w1'"})], {"w1": "X"}) == [[("a = 'w1'", {"v": "'X' || 'w1'"})]]


def test_area_and_filters(spark):
    df = spark.createDataFrame([("Y", "N", "UG Part proven", "2"), ("Y", None, "UG Feed Not Evaluated", "2"), (None, None, "UG Part proven", "2"),
                                (None, None, "UG Part proven", "1")], "a string, e string, notes string, st string")
    assert [r.ok for r in area_valid(df, "a", "e", "notes", "st", "ok").collect()] == ["Y", "Y", "Y", "N"]
    n = spark.range(10)
    assert filtered(n, id=None, id_from=3, id_to=5).count() == 3
    assert filtered(n, id=[1, 2]).count() == 2


def test_chained_steps(spark):
    def add(df):
        return df.withColumn("id", F.col("id") + 1)

    def double(df):
        return df.withColumn("id", F.col("id") * 2)
    n = spark.range(1, 2)
    assert (n.transform(pipe(add, double)).first()[0], n.transform(compose(add, double)).first()[0]) == (4, 3)
