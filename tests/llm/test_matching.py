import random

import numpy as np
import pandas as pd

from weftline.llm import matching as M

SYL = "ka ro mi tu ve sho bri la ne do zu pe gi sta".split()
FLAVOURS = "mango lemon cherry spinach onion cocoa vanilla pumpkin saffron fennel rhubarb papaya".split()
KINDS = "biscuits jam soup crackers tea mustard noodles pralines cider fudge".split()
OTHER = {"biscuits": "cookies", "tea": "infusion"}
GRADES = ("organic", "mild", "dark")


def typo(w, rnd):
    i = rnd.randrange(1, len(w) - 1)
    kind = rnd.randrange(3)
    return w[:i] + w[i + 1 :] if kind == 0 else w[:i] + rnd.choice("aeiorst") + w[i + 1 :] if kind == 1 else w[:i] + w[i] + w[i:]


def tables(n=600, seed=3):
    """Left products; right ones of which two in three have a left one, written differently."""
    rnd = random.Random(seed)
    brands = ["".join(rnd.choices(SYL, k=3)) + rnd.choice("rnlx") for _ in range(n // 8)]
    goods = set()
    while len(goods) < n:
        goods.add((rnd.choice(brands), rnd.choice(FLAVOURS), rnd.choice(KINDS)))
    goods = sorted(goods)
    rnd.shuffle(goods)
    left, right, truth = [], [], {}
    for i, (b, f, k) in enumerate(goods):
        price = round(rnd.uniform(2, 40), 2)
        if i % 3:
            left.append((i, f"{b.capitalize()} {rnd.choice(GRADES).capitalize() + ' ' if rnd.random() < 0.5 else ''}{f} {k}", price if rnd.random() < 0.95 else None, k[:3]))
        if i % 3 != 1 or rnd.random() < 0.2:
            words = [b, f, OTHER.get(k, k) if rnd.random() < 0.5 else k]
            if rnd.random() < 0.3:
                j = rnd.randrange(3)
                words[j] = typo(words[j], rnd)
            b2, f2, k2 = words
            name = rnd.choice([f"{b2} {f2} {k2}", f"{k2}, {f2} - {b2}", f"{f2} {k2} ({b2})".upper(), f"{b2}'s Mild {f2} {k2}, 12 x 5 oz", f"{b2}/{f2[:4]}. {k2}"])
            right.append((10_000 + i, name, round(price * rnd.uniform(0.96, 1.04), 2), k[:2] if rnd.random() < 0.9 else None))
            if i % 3:
                truth[10_000 + i] = i
    return left, right, truth


def sides(spark, left, right):
    return (
        M.Side(spark.createDataFrame(left, "id long, nm string, price double, cat string"), "id", "nm", "price", "cat"),
        M.Side(spark.createDataFrame(right, "pid long, nm string, price double, cat string"), "pid", "nm", "price", "cat"),
    )


def test_held_out_accuracy(spark):
    left, right, truth = tables()
    got = {r.right_id: (r.left_id, r.confidence) for r in M.match_entities(*sides(spark, left, right), GRADES).collect()}
    right_ones = sum(truth.get(k) == v for k, (v, _) in got.items())
    assert right_ones / len(got) >= 0.97 and right_ones / len(truth) >= 0.9, (len(got), len(truth), right_ones)
    assert all(0.5 <= c <= 1 for _, c in got.values())


def test_nulls_copies_ties_and_clashing_names(spark):
    left, right, truth = tables()
    left += [(90_000, None, 1.0, "x"), (90_001, "", None, None), (90_002, "Organic", None, None), left[0], (90_003, *left[0][1:])]
    right += [(95_000, None, 1.0, "x"), (95_001, " - ", float("nan"), None), (95_002, left[0][1], -1.0, None), (95_002, left[0][1], -1.0, None), (None, left[0][1], 1.0, None), (95_003, "x" * 50_000, 1.0, "x")]
    l, r = sides(spark, left, right)
    l, r = M.Side(l.df.selectExpr("*", "1 as rec", "2 as words"), "id", "nm", "price", "cat"), M.Side(r.df.selectExpr("*", "'a' as known", "1 as id"), "pid", "nm", "price", "cat")
    rows = M.match_entities(l, r, GRADES).collect()
    assert len(rows) == len({x.right_id for x in rows})
    got = {x.right_id: x.left_id for x in rows}
    assert got[95_002] == left[0][0] and not {95_000, 95_001, 95_003, None} & {*got} and 90_003 not in got.values()


def test_empty_tables(spark):
    left, right, _ = tables(60)
    l, r = sides(spark, left, right)
    for a, b in ((l.df.limit(0), r.df), (l.df, r.df.limit(0)), (l.df.limit(0), r.df.limit(0))):
        assert M.match_entities(M.Side(a, "id", "nm", "price", "cat"), M.Side(b, "pid", "nm"), GRADES).count() == 0


def test_no_prices_and_no_categories(spark):
    left, right, truth = tables(300)
    l, r = sides(spark, left, right)
    got = {x.right_id: x.left_id for x in M.match_entities(M.Side(l.df, "id", "nm"), M.Side(r.df, "pid", "nm"), GRADES).collect()}
    assert sum(truth.get(k) == v for k, v in got.items()) / len(got) >= 0.95


def test_word_similarity():
    assert M.word_similarity("honey", "hnoey") == 0.8
    assert M.word_similarity("venison", "veni.") == 0.95
    assert M.word_similarity("tea", "tea") == 1.0
    assert M.word_similarity("coffee", "toffee") > 0.8  # which is why known words must be equal
    assert M.name_features(["b", "sour", "toffee"], ["b", "sour", "coffee"], {"b", "sour", "coffee"}, frozenset())[4:6] == ("toffee", "coffee")


def pairs_of(left, right, optional=GRADES, heavy=M.HEAVY_BLOCK, wording=()):
    lrecs, rrecs = M.leading_records(left), M.records(right)
    b = M.blocks(lrecs, rrecs, {*optional, "s", "mild"}, heavy)
    got = M.candidates(b)
    return got if heavy == M.HEAVY_BLOCK else got.unionByName(M.heavy_candidates(b, set(wording))).distinct()


def test_candidates_reach_the_true_pairs(spark):
    left, right, truth = tables()
    l, r = sides(spark, left, right)
    first = {tuple(x[1].lower().split()): x[0] for x in reversed(left)}
    rid = {x.name: x.rec for x in M.records(r).collect()}
    have = {(x.lrec, x.rrec) for x in pairs_of(l, r).collect()}
    names_l, names_r = {x[0]: x[1] for x in left}, {x[0]: x[1] for x in right}
    hit = sum((first[tuple(names_l[a].lower().split())], rid[names_r[b]]) in have for b, a in truth.items())
    assert hit / len(truth) >= 0.93
    assert len(have) < 20 * len(right)


def test_heavy_blocks_keep_what_can_match(spark):
    """One brand has all the names and a word is in a third of them: pairs that share that word alone aren't compared, the others are."""
    words = [a + b for a in SYL for b in ("nor", "lix", "tam", "vez", "dop")]
    left = [(i, f"Hotbrand {w} {KINDS[i % 3]}", 3.0 + i, None) for i, w in enumerate(words)]
    right = [(1000 + i, f"{KINDS[i % 3] if i % 4 else OTHER.get(KINDS[i % 3], KINDS[i % 3])}, {w} - hotbrand", 3.0 + i, None) for i, w in enumerate(words)]
    left += [(500, "Hotbrand jam", 90.0, None)]
    right += [(1500, "hotbrand's JAM", 90.0, None)]
    l, r = sides(spark, left, right)
    rid = {x.name: x.rec for x in M.records(r).collect()}
    true = {(i, rid[right[i][1]]) for i in range(len(words))} | {(500, rid["hotbrand's JAM"])}
    all_with_all = pairs_of(l, r)
    split = {(x.lrec, x.rrec) for x in pairs_of(l, r, heavy=100, wording={("cookies", "biscuits")}).collect()}
    assert true <= split and len(split) < all_with_all.count() / 4
    rated, model = M.rated_pairs(l, r, (), 100)
    best = {}
    for x in M.confidences(rated, model).collect():
        best[x.rrec] = max(best.get(x.rrec, (0, None)), (x.confidence, x.lrec))
    assert sum(best.get(b, (0, None))[1] == a for a, b in true) >= len(true) - 2


def test_names_of_one_word_and_very_long_words(spark):
    left = [(1, "Solo", 2.0, None), (2, "Brandix " + "q" * 60 + "abc", 3.0, None), (3, "Brandix other", 4.0, None)]
    right = [(11, "SOLO", 2.0, None), (12, "q" * 30 + "z" + "q" * 30 + "abc by brandix", 3.0, None), (13, "solo brandix", 9.0, None)]
    l, r = sides(spark, left, right)
    names = {x.rec: x.name for x in M.records(r).collect()}
    got = {(x.lrec, names[x.rrec][:4]) for x in pairs_of(l, r, ("by",)).collect()}
    assert {(1, "SOLO"), (2, "qqqq")} <= got and (1, "solo") not in got


def test_optional_words_are_learned(spark):
    left, right, _ = tables(900)
    l, r = sides(spark, left, right)
    got = M.learn_optional(M.leading_records(l), M.records(r))
    assert {"mild"} <= got and not got & {*FLAVOURS, *KINDS, *OTHER.values()} and not any(w in got for x in left for w in [x[1].lower().split()[0]])


def test_confidence_is_calibrated(spark):
    """Of matches with known truth (names worn badly), those reported are right about as often as they say; what is rated low is rated too low rather than too high."""
    bins = {}
    for seed in (11, 12):
        left, right, truth = tables(500, seed)
        rnd = random.Random(seed)
        worn = []
        for i, name, price, cat in right:
            words = name.split()
            if rnd.random() < 0.5:  # a word is lost or spoiled, so that many pairs are doubtful
                k = rnd.randrange(len(words))
                words[k] = typo(typo(words[k], rnd), rnd) if len(words[k]) > 4 and rnd.random() < 0.6 else ""
            worn.append((i, " ".join(words), round(price * rnd.uniform(0.8, 1.25), 2), cat))
        for r in M.match_entities(*sides(spark, left, worn), GRADES, threshold=0.05).collect():
            b = bins.setdefault(min(2, int(r.confidence * 3)), [0, 0, 0.0])
            b[0] += 1
            b[1] += truth.get(r.right_id) == r.left_id
            b[2] += r.confidence
    for k, (n, right_ones, said) in bins.items():
        assert n < 15 or right_ones / n > said / n - 0.1 and (k < 2 or right_ones / n < said / n + 0.1), bins
    assert bins[2][1] / bins[2][0] >= 0.93, bins
    print("confidence, right, n:", {k: (round(b[2] / b[0], 3), round(b[1] / b[0], 3), b[0]) for k, b in sorted(bins.items())})


def test_wording_is_learned_from_like_prices():
    rows = [("cookies", "biscuits", 0.02)] * 5 + [("jam", "soup", 0.01)] * 3 + [("jam", "soup", 1.0)] * 9 + [("xyz", "fudge", 0.9)] * 5
    f = pd.DataFrame([{"brand": 1.0, "no_price": 0.0, "price": p, "spare": s, "lacking": x} for s, x, p in rows])
    assert M.learn_wording(f, {"cookies", "xyz"}) == {("cookies", "biscuits")}


def test_bands_follow_the_vocabulary():
    assert M.band_shape(0) == (32, 2) and M.band_shape(5_000) == (80, 3)
    # words that share four of ten letter pairs meet as often at every size
    assert all(1 - (1 - 0.4**r) ** b > 0.99 for b, r in (M.band_shape(10**k) for k in range(7)))


def test_word_keys_meet_as_their_letter_pairs_do():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(300)]
    near = [w[:4] + "x" + w[5:] for w in words]
    a, b = M.word_keys(words, 80, 3), M.word_keys(near, 80, 3)
    assert (a == b).any(axis=1).mean() > 0.98 and (a == np.roll(b, 1, axis=0)).any(axis=1).mean() < 0.1
    assert (M.word_keys(["ab."], 4, 2) == M.word_keys(["ab"], 4, 2)).all() and M.word_keys([], 4, 2).shape == (0, 4)


def test_a_third_of_all_rows_with_one_name(spark):
    left, right, truth = tables(300)
    left += [(50_000 + i, left[0][1], 1.0 + i / 7, "x") for i in range(150)]
    right += [(60_000 + i, left[0][1].upper(), 1.0 + i / 7, "x") for i in range(100)]
    l, r = sides(spark, left, right)
    assert M.leading_records(l).count() == len({tuple(x[1].lower().split()) for x in left})
    got = {x.right_id: x.left_id for x in M.match_entities(l, r, GRADES).collect()}
    copies = [got.get(60_000 + i) for i in range(100)]
    assert copies.count(left[0][0]) >= 95 and set(copies) <= {left[0][0], None}
    same = {x.left_id: x.same_as for x in M.left_members(l).collect()}
    assert len(same) == len(left) and {same[50_000 + i] for i in range(150)} == {left[0][0]}
