import random

import numpy as np
import pytest

from weftline.llm import leakage as L

RND = random.Random(5)
SYL = ["ka", "ro", "mi", "tu", "ve", "sho", "bri", "la", "ne", "do"]
NAMES = ["".join(RND.choices(SYL, k=3)) for _ in range(400)]
STOCK = "Remember to restart and run all of the cells in order."


def sentence(rnd):
    return " ".join(rnd.choices(NAMES, k=11)).capitalize() + "."


def make_items(n=30):
    rnd = random.Random(1)
    return [(i, " ".join([sentence(rnd), sentence(rnd), STOCK if i % 2 else sentence(rnd), sentence(rnd)])) for i in range(n)]


ITEMS = make_items()


def found(text, items=ITEMS):
    work = L.Search(L.build_index(items))
    work.add(0, L.words(text))
    return {items[i][0]: n for _, i, n in work.result()}


def naive_distance(a, b):
    """Edits between a and the best beginning of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def words_of(i):
    return L.words(ITEMS[i][1])


def test_distances_against_brute_force():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (200, 8)), rng.integers(0, 4, (200, 10))
    assert L.edit_distances(a, b).tolist() == [naive_distance(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_whole_and_part():
    assert set(found("foo bar. " + ITEMS[4][1] + " more text")) == {4}
    assert set(found("x " * 50 + " ".join(words_of(4)[10:30]) + " y" * 50)) == {4}
    assert not found("x " * 50 + " ".join(words_of(4)[10:25]) + " y" * 50)


def test_disguises():
    part = words_of(6)[3:33]
    plain = " ".join(part)
    for text in (
        plain.upper(), plain.replace("a", "а"), "\n# ".join(" ".join(part[k : k + 5]) for k in range(0, 30, 5)), "<td>" + "</td><td>".join(part) + "</td>",
        "\\n".join(part), ", ".join(f'"{w}"' for w in part), plain.replace("ro", "r­o"), " &amp; ".join(part), plain.replace("i", "\\u0456"),
        "*" + "* **".join(part), "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalpha() else c for c in plain),
    ):
        assert set(found("before " + text + " after")) == {6}, text


def test_changed_words():
    part = words_of(8)[2:34]
    changed = [("other" if k % 10 == 4 else w) for k, w in enumerate(part)]
    assert set(found(" ".join(changed))) == {8}
    dropped = [w for k, w in enumerate(part) if k % 11 != 5]
    assert set(found(" ".join(dropped))) == {8}
    assert not found(" ".join("other" if k % 3 == 1 else w for k, w in enumerate(part)))


def test_shared_sentences_do_not_count():
    assert not found(STOCK + " " + STOCK)
    own = L.words(ITEMS[1][1])
    at = [k for k in range(len(own)) if own[k : k + 3] == ["remember", "to", "restart"]][0]
    assert not found(" ".join(own[at - 12 : at + 11]))  # 12 own words and the stock sentence
    assert set(found(" ".join(own[at - 14 : at + 11 + 10]))) == {1}


def test_recall_of_the_tables_against_brute_force():
    """Windows within the edit bound meet in a table at least nine times in ten, each taken alone, whatever the edits are."""
    index = L.build_index(ITEMS)
    rng = np.random.default_rng(3)
    pick = rng.choice(len(index.rows), 500)
    hit = {}
    for edits in range(1, L.MOST_EDITS + 1):
        for name, kinds in (("changed", (0, 1)), ("moved", (1, 3)), ("both", (0, 3))):
            rows = index.rows[pick].copy()
            for r in rows:
                for _ in range(edits):
                    k, kind = rng.integers(0, L.WINDOW), rng.integers(*kinds)
                    if kind == 0:
                        r[k] = 0
                    elif kind == 1:
                        r[k:-1] = r[k + 1 :].copy()
                        r[-1] = 0
                    else:
                        r[k + 1 :] = r[k:-1].copy()
                        r[k] = 0
            met = np.zeros(len(rows), bool)
            for t, key in enumerate(index.table_keys(rows)):
                order = index.windows[t]
                lo, hi = np.searchsorted(index.keys[t], key), np.searchsorted(index.keys[t], key, side="right")
                met |= np.array([(order[a:b] == p).any() for a, b, p in zip(lo, hi, pick)])
            hit[edits, name] = round(float(met.mean()), 3)
    assert min(hit.values()) >= 0.9 and min(hit[1, k] for k in ("changed", "moved", "both")) >= 0.99, hit


def test_no_window_is_lost_before_the_tables():
    index = L.build_index(ITEMS)
    rnd = random.Random(9)
    for _ in range(200):
        w = rnd.randrange(len(index.rows))
        seq = index.rows[w].tolist()
        for _ in range(L.MOST_EDITS):
            seq[rnd.randrange(len(seq))] = 0
        x = np.array([0] * 7 + seq + [0] * 9, np.int64)
        if (index.own[index.owner[w]][index.start[w] : index.start[w] + L.WINDOW]).all():
            assert 7 in L.possible_starts(index, x).tolist()


def test_tables_nulls_copies_and_clashing_names(spark):
    docs = [(1, ITEMS[2][1], 5), (1, ITEMS[2][1], 5), (2, None, 5), (None, ITEMS[2][1], 5), (3, "", 5), (4, "short", 5), (5, "word " * 300_000 + ITEMS[3][1] + " " + ITEMS[7][1], 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame([*ITEMS, ITEMS[0], (99, None), (98, "too short"), (None, "x")], "item_id long, item_text string")
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(d, "doc_id", "text", i, "item_id", "item_text").collect()}
    assert got == {(1, 2), (5, 3), (5, 7)}
    assert L.leaked_items(d.limit(0), "doc_id", "text", i, "item_id", "item_text").count() == 0
    assert L.leaked_items(d, "doc_id", "text", i.limit(0), "item_id", "item_text").count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS_AT_ONCE", 12)
    monkeypatch.setattr(L, "WORDS_AT_ONCE", 300)
    d = spark.createDataFrame([(k, f"a b {t} c") for k, t in ITEMS], "doc_id long, text string")
    i = spark.createDataFrame(ITEMS, "item_id long, item_text string")
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(d, "doc_id", "text", i, "item_id", "item_text").collect()}
    assert got == {(k, k) for k, _ in ITEMS}


def test_stock_sentences_are_known_across_blocks():
    statistics = L.item_statistics(t for _, t in ITEMS)
    index = L.build_index(ITEMS[1:2], statistics)  # alone in its block: the stock sentence is still not its own
    assert not index.own[0].all() and index.own[0].sum() == len(L.words(ITEMS[1][1])) - len(L.words(STOCK))


@pytest.mark.parametrize("texts", [[], [(1, "")], [(1, "a b c")]])
def test_tiny_indexes(texts):
    assert L.build_index(texts).rows.shape == (0, L.WINDOW)
    assert found("a b c d", texts) == {}
