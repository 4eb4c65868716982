import math
import random

import numpy as np

from weftline.llm import truncation as T

WORDS = "the basin was fitted first so each station is kept and sorted by record while model lantern signal turn over depot".split()


def notebook(rnd):
    out = ["# Notes on the " + rnd.choice(WORDS)]
    for _ in range(rnd.randrange(4, 14)):
        out.append(" ".join(rnd.choices(WORDS, k=rnd.randrange(8, 20))).capitalize() + ".")
        if rnd.random() < 0.5:
            out.append("```python\n" + "\n".join(f"{rnd.choice(WORDS)} = {rnd.choice(WORDS)}({rnd.randrange(99)}, \"{rnd.choice(WORDS)}\")" for _ in range(3)) + "\n```")
    return "\n\n".join(out)


def corpus(n=900, seed=0):
    rnd = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        t, src = notebook(rnd), ["whole", "limit", "bytes", "loose"][i % 4]
        if src == "limit" and len(t) > 1000:
            t, _ = t[:1000], cut.add(i)
        if src == "bytes":
            t = t.replace(".", " —.")
            if len(t.encode()) > 1200:
                t, _ = t.encode()[:1200].decode(errors="ignore"), cut.add(i)
        if src == "loose" and rnd.random() < 0.2:
            t, _ = t[: rnd.randrange(40, len(t))], cut.add(i)
        rows.append((i, t, src if i % 40 else None, 1))
    return rows, cut


def test_sources_limits_and_loose_cuts(spark):
    rows, cut = corpus()
    extra = [(9001, None, "whole", 1), (9002, "", "whole", 1), (None, "text", "whole", 1), (9003, "x" * 500_000, "whole", 1), (9004, " \n ", "whole", 1)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, source string, ratio int")
    got = T.truncation(df, "doc_id", "text", "source").collect()
    assert sorted(r.doc_id for r in got) == sorted([*(r[0] for r in rows), 9003, 9004])
    said = {r.doc_id for r in got if r.p_cut >= 0.5 and r.doc_id < 9000}
    right = len(said & cut)
    assert right / len(cut) >= 0.9 and right / len(said) >= 0.9, (len(cut), len(said), right)
    at = {r.doc_id for r in got if r.p_limit > 0.5}
    named = {i for i, _, s, _ in rows if s in ("limit", "bytes")}
    assert len((cut & named) - at) <= 1 and not {r.source for r in got if r.p_limit > 0.5} - {"limit", "bytes", None}
    report = {r.source: r for r in T.source_report(spark.createDataFrame(got)).collect()}
    assert report["whole"].share_cut < 0.05 < 0.1 < report["loose"].share_cut and report["limit"].n_at_limit > 20


def test_empty_and_tiny_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert T.truncation(df, "doc_id", "text", "source").count() == 0
    df = spark.createDataFrame([(1, "One text.", None), (2, "Another", "s")], "doc_id long, text string, source string")
    assert all(0 < r.p_cut < 0.5 for r in T.truncation(df, "doc_id", "text", "source").collect())


def test_censored_fit_finds_the_parameters():
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(7, 1.2, 50_000))
    limit = 2000.0
    hist, edges = np.histogram(np.log(x[x < limit]), 60)
    mean, dev = T.censored_lognormal(np.exp((edges[:-1] + edges[1:]) / 2), hist.astype(float), np.array([limit]), np.array([float((x >= limit).sum())]))
    assert math.isclose(mean, 7, abs_tol=0.05) and math.isclose(dev, 1.2, abs_tol=0.05)


def test_json_endings():
    whole = '{"cells": [{"source": ["a"]}]}'
    assert T.ending(whole) == ["json/closed"] and T.ending(whole[:-1]) == ["json/open"] and T.ending(whole[:-2]) == ["json/open"]


def test_every_prefix_has_an_ending():
    text = "# %% [markdown]\n# A b.\n\n# %%\nf(1, 'x')\n\n# Out[1]:\n#> 0  1.25\n#> data:image/png;base64,AAAA"
    for t in (text, text.replace("# %%", "In [1]:"), "```\n" + text):
        for k in range(1, len(t) + 1):
            assert T.ending(t[:k])
