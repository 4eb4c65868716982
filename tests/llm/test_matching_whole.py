from pyspark.sql import functions as F

from weftline.llm import matching as M

SYL = "ka ro mi tu ve sho bri la ne do zu pe gi sta".split()


def word(k):
    return SYL[k % 14] + SYL[k // 14 % 14] + SYL[(k * 5 + 3) % 14] + "xq"[k % 2]


def side(spark, rows):
    return M.Side(spark.createDataFrame(rows, "id long, nm string, price double, cat string"), "id", "nm", "price", "cat")


def test_one_common_word_is_enough(spark):
    """Two of three words besides the brand differ, and all of them are words of the left table."""
    n = 190
    left = [(k, f"brand{word(k)} {word(k)}a {word((k + 7) % n)}b", 5.0, "x") for k in range(n)]
    right = [(k, f"brand{word(k)} {word(k)}a {word((k + 50) % n)}b", 5.0, "x") for k in range(n)]
    l, r = M.leading_records(side(spark, left)), M.records(side(spark, right))
    rname = {x.rec: x.name for x in r.collect()}
    met = {(x.lrec, rname[x.rrec]) for x in M.candidates(M.blocks(l, r, set())).collect()}
    assert {(a[0], b[1]) for a, b in zip(left, right)} <= met


def test_wordings_are_learned_from_all_pairs(spark, monkeypatch):
    """The sample is too small to hold three pairs of a wording."""
    left = [(k, f"brand{word(k)} {word(k)}a biscuits", 5.0 + k, "x") for k in range(40)]
    right = [(k, f"brand{word(k)} {word(k)}a cookies", 5.0 + k, "x") for k in range(40)]
    models, train = [], M.train
    monkeypatch.setattr(M, "SAMPLE", 1)
    monkeypatch.setattr(M, "train", lambda *a: models.append(train(*a)) or models[-1])
    M.match_entities(side(spark, left), side(spark, right))
    assert ("cookies", "biscuits") in models[0].wording


def test_nothing_that_grows_is_broadcast(spark):
    """A small table that is exploded or hashed is many times as large as the optimizer takes it to be; broadcast, it would pass through the driver."""
    n = 60
    left = [(k, f"brand{word(k)} {word(k)}a biscuits", 5.0 + k, "x") for k in range(n)]
    right = [(k, f"brand{word(k)} {word(k)[:3]}. cookies", 5.0 + k, "x") for k in range(n)]
    l, r, plans = M.leading_records(side(spark, left)), M.records(side(spark, right)), []
    wanted, given = (x.select(F.explode("words").alias(name)).distinct() for x, name in ((l, "wanted"), (r, "given")))
    linked = M.link_words(wanted, given)
    b = M.blocks(l, r, set())
    for made in (linked, M.pair_features(M.candidates(b), b.known, l, r, set())):
        made.collect()
        plans.append(made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans), plans
    assert {(x.given, x.wanted) for x in linked.collect()} >= {(f"{word(k)[:3]}.", f"{word(k)}a") for k in range(n)}


def test_wordings_stay_in_tables(spark):
    """However many wordings there are, none comes to the driver, and the pairs say which they are."""
    left = [(k, f"brand{word(k)} {word(k)}a biscuits", 5.0 + k, "x") for k in range(40)]
    right = [(k, f"brand{word(k)} {word(k)}a cookies", 5.0 + k, "x") for k in range(40)]
    rated, model = M.rated_pairs(side(spark, left), side(spark, right))
    assert [tuple(x) for x in model.wording.table.select("spare", "lacking").collect()] == [("cookies", "biscuits")] and ("soup", "biscuits") not in model.wording
    said = {(x.spare, x.lacking): x.said for x in rated.collect()}
    assert said[("cookies", "biscuits")] and not any(v for k, v in said.items() if k != ("cookies", "biscuits"))


def test_heavy_blocks_are_compared_all_with_all(spark):
    """Pairs that share one common word alone are rated in heavy blocks as in others: the size of a block decides nothing."""
    n = 60
    left = [(k, f"Hotbrand {word(k)} jam", 3.0 * 1.2**k, "x") for k in range(n)]
    # a third have a word that the left table doesn't know
    right = [(1000 + k, f"hotbrand {word(k)} jam" if k % 3 else f"hotbrand jam {word(k)[::-1]}xxqq", 3.0 * 1.2**k, "x") for k in range(n)]
    right += [(2000, "Hotbrand jam", 3.0, "x")]
    l, r = side(spark, left), side(spark, right)
    got = {}
    for heavy in (9, 100, 1 << 60):
        rows = M.confidences(*M.rated_pairs(l, r, (), heavy)).collect()
        got[heavy] = {(x.lrec, x.rrec): round(x.confidence, 9) for x in rows}
        assert len(rows) == len(got[heavy]) == n * (n + 1)
    assert got[9] == got[100] == got[1 << 60]


def test_slices_of_a_heavy_block_are_small(spark):
    """No slice has many more pairs than a block may have, whichever side is the long one, and every pair is in one slice."""
    for m, n in ((180, 7), (7, 180), (90, 90)):
        left = [(k, f"Hotbrand {word(k)} jam", 3.0, "x") for k in range(m)]
        right = [(k, f"Hotbrand {word(k)} jam", 3.0 + k, "x") for k in range(n)]
        b = M.blocks(M.leading_records(side(spark, left)), M.records(side(spark, right)), set(), 400)
        block = b.heavy.filter("word = 'jam'").first()
        assert (block.lparts, block.rparts) == (-(-m // 20), -(-n // 20))
        assert M.heavy_pairs(b).count() == M.heavy_pairs(b).distinct().count() == m * n
