from llm.conftest import LONG, same
from loomwork.llm.catalog import op8_quote_links
from loomwork.llm.quote_links import linked, quoting_messages

SCHEMA = "message_id long, body string, parent string, h0 string, root int"


def found(spark, rows):
    return [tuple(r) for r in linked(spark.createDataFrame([(i, b, "own", "own", 5) for i, b in rows], SCHEMA).repartition(3)).collect()]


def test_nested_quotes(spark):
    rows = [(1, "Hello there"), (2, "Hi!\n> hello   THERE"), (3, "How are you?\n> Hi!\n> > Hello there"), (4, "> How are you?\n>> Hi!\nFine\nthanks"),
            (5, "Unrelated"), (6, "Lost original\n> never sent"), (7, "first\n> Unrelated\nlast")]
    assert same(found(spark, rows), [(1, "Hello there", None, 1, 0), (2, "Hi!", 1, 1, 1), (3, "How are you?", 2, 1, 2), (4, "Fine\nthanks", 3, 1, 3),
                                     (5, "Unrelated", None, 5, 0), (6, "Lost original", None, 6, 0), (7, "first\nlast", 5, 5, 1)])


def test_level_two_tells_equal_texts_apart(spark):
    rows = [(1, "Good morning"), (2, "Good evening"), (3, "Thanks\n> Good morning"), (4, "Thanks\n> Good evening"), (5, "ok\n> Thanks\n> > Good evening"), (6, "ok\n> Thanks\n> > Good morning"),
            (7, "ok\n> Thanks"), (8, "Good morning"), (9, "x\n> Good morning")]
    got = {r[0]: r[2] for r in found(spark, rows)}
    assert got == {1: None, 2: None, 3: 1, 4: 2, 5: 4, 6: 3, 7: 3, 8: None, 9: 1}


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "> x"), (4, "x"), (5, "y\n> x"), (5, "y\n> x"), (6, "a\n> b"), (7, "b\n> a"), (8, LONG), (9, "z\n> " + LONG), (10, ">"), (11, "q\n> ")]
    assert same(found(spark, rows), [(1, "", None, 1, 0), (2, "", None, 2, 0), (None, "x", None, None, 0), (None, "x", None, None, 0), (3, "", None, 3, 0), (4, "x", None, 4, 0),
                                     (5, "y", 4, 4, 1), (5, "y", 4, 4, 1), (6, "a", None, 6, 0), (7, "b", 6, 6, 1), (8, LONG, None, 8, 0), (9, "z", 8, 8, 1), (10, "", None, 10, 0), (11, "q", None, 11, 0)])
    assert found(spark, []) == []


def test_a_long_chain_ends_at_its_first_message(spark):
    rows = [(0, "m0")] + [(k, f"m{k}\n> m{k - 1}") for k in range(1, 40)]
    assert {(r[0], r[2], r[3], r[4]) for r in found(spark, rows)} == {(k, k - 1 if k else None, 0, k) for k in range(40)}


def test_messages_quote_the_turns_before(spark):
    turns = [(1, 0, "user", "a\n> odd"), (1, 1, "assistant", "b"), (1, 2, "user", None), (1, 3, "assistant", "d"), (2, 1, "user", "z"), (None, 1, "user", "n"), (1, 4, "user", "e"), (1, 4, "user", "e2")]
    got = {(r.conv_id, r.turn, r.body) for r in quoting_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 2).collect()}
    assert got == {(1, 0, "a\n > odd"), (1, 1, "b\n> a\n>  > odd"), (1, 2, "\n> b\n> > a\n> >  > odd"), (1, 3, "d\n> \n> > b"), (2, 1, "z"), (None, 1, "n"), (1, 4, "e\n> d\n> > "), (1, 4, "e2\n> d\n> > ")}


def test_the_query_passes_each_row_on_once(spark, tmp_path):
    turns = [(1, 0, "user", "a"), (1, 0, "system", "a2"), (1, 1, "user", "b"), *[(None, 0, f"r{k}", "a") for k in range(4)], (1, None, "user", "n")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert same(op8_quote_links(spark, str(tmp_path)).collect(), [
        (1, 0, "user", "a", None, None, 1, 0, 0), (1, 0, "system", "a2", None, None, 1, 0, 0), (1, 1, "user", "b", 1, 0, 1, 0, 1),
        *[(None, 0, f"r{k}", "a", None, None, None, 0, 0) for k in range(4)], (1, None, "user", "n", None, None, 1, None, 0)])


def test_every_level_tells_equal_texts_apart(spark):
    def quote(texts):
        return "\n".join("> " * k + t for k, t in enumerate(texts))

    rows = []
    for first in (1, 2):
        turns = [f"start {first}", "Hello", "How are you?", "Fine", "Good"]
        rows += [(10 * k + first, quote(turns[k::-1])) for k in range(5)]
    rows += [(100, quote(["odd", "Good", "Fine", "never", "said"])), (101, quote(["odd", "Good", "Fine", "How are you?", "Hello", "start 2"]))]
    got = {r[0]: r[2:4] for r in found(spark, rows)}
    assert all(got[10 * k + first] == (10 * (k - 1) + first if k else None, first) for k in range(5) for first in (1, 2))
    assert got[100] == (41, 1) and got[101] == (42, 2)


def test_trimmed_and_mixed_quotes(spark):
    rows = [(1, "Hello\n\nFirst point\nstill first\n\nSecond point\nBye"), (2, "Hello\nOther matter\nBye"), (3, "Yes\n> Second point"), (4, "> First point\nA\n> Second point\nB"),
            (5, "> First point still first\nC"), (6, "D\n> Other matter\n> Bye\n> not there"), (7, "> Hello\nE"), (8, "> Second point\nF\n> Other matter\n> Hello\nG"), (9, "H\n> B\n> > Second point"),
            (10, "> nowhere\nI"), (11, "J\n> A\n> B\n> > First point\n> > Second point")]
    got = {r[0]: (r[2], r[3]) for r in found(spark, rows)}
    assert {k: got[k] for k in (1, 2, 10)} == {1: (None, 1), 2: (None, 2), 10: (None, 10)}
    assert {k: got[k][0] for k in (3, 4, 5, 6, 7, 9, 11)} == {3: 1, 4: 1, 5: 1, 6: 2, 7: 1, 9: 4, 11: 4}
    assert got[8][0] in (1, 2) and got[11][1] == 1
