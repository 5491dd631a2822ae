"""Merging of sources and choice of indicators on small threads."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import threads

POST = "conv_id bigint, id string, username string, text string, reply_to string, root_post string, is_reply boolean, has_replies boolean, turn int, hint int, hint_total int"
FACTS = f"conv_id bigint, adapter {threads.INDICATOR}, coverage boolean"


def post(conv, k, text="t", more=True, hint=None, total=None, root=None):
    return (conv, f"{conv}:{k}", "Me", text, f"{conv}:{k - 1}" if k else None, root, k > 0, more, k, hint, total)


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, kind: spark.createDataFrame(rows, kind)


def test_choice_of_indicators(spark):
    s = lambda a, b: F.struct(F.lit(a).alias("index"), F.lit(b).alias("total")) if a is not None else F.lit(None).cast(threads.INDICATOR)
    cases = [((1, 3), (2, 3), (None, None), (1, 3, False)), ((None, None), (2, 3), (1, 3), (2, 3, False)), ((1, 3), (1, 4), (None, None), (None, None, True)), ((4, 3), (0, 9), (None, None), (None, None, False)), ((5, 3), (2, 2), (1, 2), (2, 2, False))]
    for a, b, c, want in cases:
        assert tuple(spark.range(1).select(threads.choose_indicator(s(*a), s(*b), s(*c)).alias("x")).first()[0]) == want


def test_sources_are_merged_until_complete(spark, make):
    first = [post(1, 0), post(1, 1, more=False), post(2, 0, root="2:0"), post(3, 0, more=True), post(4, 0, more=False), post(5, 0, hint=1, total=2), post(6, 0, text="", root="6:0")]
    second = [post(2, 0, "other"), post(2, 1, more=False), post(3, 0), post(3, 1), post(5, 1, hint=2, total=2), post(6, 0, "late", root="6:0"), post(6, 1, more=False)]
    third = [post(3, 2, more=False), post(3, 1), post(1, 2)]
    page = make([(3, (1, 3)), (7, (1, 2))], f"conv_id bigint, page {threads.INDICATOR}")
    facts = make([(3, (1, 4), False)], FACTS)
    none = make([], FACTS)
    found = threads.merge_until_complete([("a", make(first, POST), none), ("b", make(second, POST), facts), ("c", make(third, POST), none)], page)
    got = {r["conv_id"]: (r["detected"], r["status"], r["reason"], r["confidence"], r["method"], r["text"]) for r in found.collect()}
    assert got == {
        1: (2, "COMPLETE_THREAD", None, "medium", "a", "t\n\nt"),
        # The first source's text stays.
        2: (2, "COMPLETE_THREAD", None, "medium", "b", "t\n\nt"),
        # The second source's number of parts is at odds with the page's; the third one names none.
        3: (3, "COMPLETE_THREAD", None, "high", "c", "t\n\nt\n\nt"),
        4: (1, "SINGLE_POST", None, "medium", "a", "t"),
        5: (2, "COMPLETE_THREAD", None, "high", "b", "t\n\nt"),
        6: (2, "COMPLETE_THREAD", None, "medium", "b", "late\n\nt"),
    }
    short = {r["conv_id"]: (r["status"], r["reason"], r["confidence"]) for r in threads.merge_until_complete([("a", make(first, POST), none), ("b", make(second, POST), facts)], page).collect()}
    assert short[3] == ("AMBIGUOUS_THREAD", "indicator_conflict", "low")
    assert threads.merge_until_complete([("a", make([], POST), none)], page.limit(0)).count() == 0
