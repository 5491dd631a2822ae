"""The posts of a chain come with the chain: replies of others, branches and loose posts are not among them."""

from quillmesh.operators import conversations as conv


def test_posts_of_chains(spark):
    rows = [
        (1, "a0", "me", None), (1, "a1", "Me", "a0"), (1, "a2", "me", "a1"), (1, "b1", "you", "a0"), (1, "b2", "me", "b1"),
        (2, "c0", "", None), (2, "c1", "", "c0"), (3, "d0", "me", None), (3, "d1", "me", "d0"), (3, "d2", "me", "d0"), (4, "e1", "me", "gone"),
    ]
    found, posts = conv.chains_and_posts(spark.createDataFrame(rows, "conv_id bigint, id string, username string, reply_to string"))
    assert sorted(map(tuple, found.collect())) == [(1, 3, "a2", False), (2, 1, "c0", False), (3, 1, "d0", True), (4, 0, None, False)]
    assert sorted(r[0] for r in posts.collect()) == ["a0", "a1", "a2", "c0", "d0"]
