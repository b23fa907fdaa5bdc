import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from llm.conftest import EDGES, frame, same
from loomwork.llm import token_counts
from loomwork.llm.token_counts import Tokenizer, add_misses, by_pieces, count_tokens, read_cache
from loomwork.session import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_and_edge_rows(spark):
    rows = [*EDGES, (20, "a<|endoftext|>b"), (21, "<|endoftext|>"), (22, "x  \n\n  y" * 50)]
    library = Library.from_file(PATH)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    got = count_tokens(frame(spark, rows), Tokenizer(PATH)).select("doc_id", "n_bytes", "n_tokens").collect()
    assert same(got, want)


def test_the_cache_grows_by_distinct_misses_only(spark):
    cache, tokenizer = fresh_path(spark, "cache"), Tokenizer(PATH)
    first = [(i, f"text {i % 4}") for i in range(12)]
    count_tokens(frame(spark, first), tokenizer, cache).collect()
    assert read_cache(spark, cache).count() == 4
    count_tokens(frame(spark, first), tokenizer, cache).collect()
    assert read_cache(spark, cache).count() == 4
    counted = count_tokens(frame(spark, first + [(50, "new text"), (51, "new text")]), tokenizer, cache).collect()
    assert read_cache(spark, cache).count() == 5 and len(counted) == 14
    other = Tokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    assert other.version != tokenizer.version
    count_tokens(frame(spark, first), other, cache).collect()
    assert read_cache(spark, cache).count() == 9


def test_a_stored_count_is_used_and_not_made_again(spark):
    """A count that no tokenizer would give comes from the cache; the query's second append holds the misses of the first alone."""
    cache, tokenizer = fresh_path(spark, "cache"), Tokenizer(PATH)
    add_misses(frame(spark, [(1, "known text"), (2, "known text"), (3, None)]), tokenizer, cache)
    assert read_cache(spark, cache).count() == 2
    fake = fresh_path(spark, "cache")
    read_cache(spark, cache).withColumn("n_tokens", F.lit(777).cast("long")).write.parquet(fake)
    got = count_tokens(frame(spark, [(1, "known text"), (2, None), (3, "other"), (3, "other")]), tokenizer, fake).select("doc_id", "n_tokens").collect()
    library = Library.from_file(PATH)
    assert same(got, [(1, 777), (2, 777), *[(3, len(library.encode("other", add_special_tokens=False).ids))] * 2])
    assert read_cache(spark, fake).count() == 3


def test_an_empty_table(spark):
    assert count_tokens(frame(spark, []), Tokenizer(PATH)).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_pieces_between_gaps_add_up_to_the_whole_text(monkeypatch):
    """Also around white space of all kinds, special strings, contractions, and when the kept pieces run over."""
    library, rng = Library.from_file(PATH), random.Random(7)
    parts = ["a", "Word", "é", "ß", "中文", "1", "½", "²", "'s", "'ll", "'", ".", "!!", "|", "<|endoftext|>", "<|endo", "e\u0301", "\u0301", "\ufffd", "\x00", "\U0001f600",
             " ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u180e", "\u200b", "\u2028", "\u3000", "\ufeff", "x" * 80]
    texts = ["", " ", "\n", *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(4000))]
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Tokenizer(PATH).counter()(texts) == want
    monkeypatch.setattr(token_counts, "KEPT_PIECES", 50)
    few = Tokenizer(PATH)._load()
    assert [n for i in range(0, len(texts), 100) for n in few(texts[i:i + 100])] == want


def test_a_repeated_piece_is_encoded_once_and_the_others_together():
    seen = []

    def count(pieces):
        seen.extend(p for p in pieces if p)
        return [len(p) for p in pieces]

    counted, long = by_pieces(count), "y" * 100
    assert counted([f"ab ab cd {long} ab cd", f"ef\ncd {long}", ""]) == [115, 106, 0]
    assert sorted(seen) == sorted([" ab", " cd", f"ab {long}", f"ef\ncd {long}"])
    seen.clear()
    assert counted(["ab cd ab", "gh cd"]) == [8, 5]
    assert seen == ["ab", "gh"]


def test_the_counter_is_kept_from_task_to_task_and_cuts_only_where_the_rule_allows():
    one, other = Tokenizer(PATH), Tokenizer(PATH)
    assert one.counter() is other.counter()
    file = json.loads(one.data)
    assert token_counts._cut_at_gaps(file)
    added = file["added_tokens"][0]
    for change in ({"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {**file["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": None},
                   {"added_tokens": [{**added, "content": "two words"}]}, {"added_tokens": [{**added, "lstrip": True}]}, {"model": {"type": "WordPiece"}}):
        assert not token_counts._cut_at_gaps({**file, **change})
    words = public_tokenizers.path("word_bpe_49k.json")
    texts = ["A b  c\n d", "", "two  words <|endoftext|>", "x" * 70]
    assert Tokenizer(words).counter()(texts) == [len(e) for e in Library.from_file(words).encode_batch(texts, add_special_tokens=False)]
