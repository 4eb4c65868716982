"""Texts cut off by field limits or broken transfers.

Two kinds of evidence meet in one posterior.  Lengths: for every source, limits
show as lengths at which far more different texts end than the source's length
distribution allows; a log-normal is fitted by maximum likelihood with the texts
at those limits right-censored, which gives the share of texts at a limit that
were cut.  Endings: a logistic model, trained on true endings against the
endings of texts cut at random places, gives each ending's likelihood ratio;
the share of texts of a source cut at no limit is fitted to these ratios.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialise, ship_package

#: Hashed features of an ending; texts of the training sample (at most about so many); rounds over them.
BUCKETS, SAMPLE, EPOCHS = 1 << 18, 20_000, 10
#: A feature needs this many training texts: what only one text has would let the model learn that text by heart.
LEAST_TEXTS = 4
#: A true ending is left out of the training if a model that didn't see it rates it as cut by more than this; one bound per pass.
PLAINLY_CUT = (2.0, 1.0)
#: Steps per e-fold of length in the histograms; bytes that a limit in bytes may fall short of, as letters aren't split.
LENGTH_STEPS, BYTE_STEP = 8, 4
#: A limit is a candidate if this many different texts end there, and so many deviations more than the neighbourhood lets expect.
LEAST_AT_LIMIT, DEVIATIONS = 3, 6.0
#: Steps of the log-likelihood ratio in the histogram per source, and its bounds.
RATIO_STEP, RATIO_MOST = 0.25, 12.0
#: Prior weight of the share of texts cut at no limit: as if so many cut and whole texts had been seen.
PRIOR_CUT, PRIOR_WHOLE = 0.5, 60.0

_OBJECT = re.compile(r"\s*\{")
_FENCE = re.compile(r"^```", re.M)
_CELL = re.compile(r"^# (%%(?: \[markdown\])?|Out\[[ \d]*\]:)", re.M)
_PROMPT = re.compile(r"^(In|Out) ?\[[ \d]*\]:", re.M)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|_|\s+|[^\w\s]")
_LAST_WORD = re.compile(r"[^\W\d_][\w]*\Z")
_NUMBER = re.compile(r"-?\d+(?:\.(\d+))?\Z")
_BASE64 = re.compile(r"base64,([A-Za-z0-9+/]+)(=*)\Z")


def layout(text: str) -> str:
    """How cells are laid out, told from the text itself."""
    if _OBJECT.match(text):
        return "json"
    if _CELL.search(text):
        return "percent"
    if _PROMPT.search(text):
        return "console"
    return "fenced"  # plain prose too


def last_block(text: str, kind: str) -> tuple[str, str]:
    """What the text ends in (code, output, prose, open or closed) and that block."""
    if kind == "json":
        closed = text.rstrip().endswith("}")
        if closed:
            try:
                json.loads(text)
            except ValueError:
                closed = False
        return ("closed" if closed else "open"), text[-400:]
    if kind == "fenced":
        last = None
        n = 0
        for last in _FENCE.finditer(text):
            n += 1
        if n % 2:
            return "open", text[last.end() :]
        if n and text.rstrip().endswith("```") and text.rstrip().rfind("```") == last.start():
            return "fence", "```"
        return "prose", text[text.rfind("\n\n") + 2 if "\n\n" in text else 0 :]
    if kind == "percent":
        last = None
        for last in _CELL.finditer(text):
            pass
        state = "output" if last[1].startswith("Out") else "prose" if "markdown" in last[1] else "code"
        return state, text[last.end() :]
    at = text.rfind("\n\n")
    block = text[at + 2 if at >= 0 else 0 :]
    m = _PROMPT.match(block)
    if m:
        return ("code" if m[1] == "In" else "output"), block[m.end() :]
    # an output may hold blank lines: look at what the paragraphs before begin with
    if re.match(r"\s*(?:-?\d|\[\d+ rows|\S+  +\S)|Traceback|-{20,}|\.\.\.|\w+(?:Error|Exception|Warning)\b|\S+:\d+: |Epoch \d", block):
        return "output", block
    return "prose", block


def shape(text: str) -> str:
    """Letters and digits by kind: words as a, numbers as 9 with the length of their decimals kept."""
    text = re.sub(r"\d+\.(\d+)", lambda m: "9." + "9" * len(m[1]), text)
    text = re.sub(r"(?<![.9\d])\d+", "9", text)
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\s+", " ", text))


def ending(text: str) -> list[str]:
    """Features of how a text ends; a text of blanks alone has only its layout."""
    kind = layout(text)
    state, block = last_block(text, kind)
    ctx = f"{kind}/{state}"
    out = [ctx]
    if kind == "json":
        return out
    body = block.rstrip("\n")
    if not body.strip():
        return [*out, f"{ctx}|blank"]
    lines = body.split("\n")
    line = re.sub(r"^(?:#> ?|# ?|   \.\.\.: ?|> ?)", "", lines[-1])
    before = re.sub(r"^(?:#> ?|# ?|   \.\.\.: ?|> ?)", "", lines[-2]) if len(lines) > 1 else ""
    form = shape(line)
    tail = _TOKEN.findall(line[-120:])
    kinds = [("a" if t[0].isalpha() else "9" if t[0].isdigit() else " " if t.isspace() else t) for t in tail]
    last = line[-1:] or "none"
    mark = "a" if last.isalpha() else "9" if last.isdigit() else last
    raw = re.sub(r"[0-9]+", "9", line[-80:]).lower()
    for c in (ctx, state):  # what layouts share is learned once
        out += [f"{c}|end={mark}", f"{c}|form={form[-60:]}", f"{c}|2={''.join(kinds[-2:])}", f"{c}|4={''.join(kinds[-4:])}", f"{c}|raw={raw}"]
    out.append(f"{ctx}|starts={(tail and _TOKEN.findall(line[:30]) or ['none'])[0][:8]}|end={mark}")
    opened = sum(block.count(x) for x in "([{") - sum(block.count(x) for x in ")]}")
    own = sum(line.count(x) for x in "([{") - sum(line.count(x) for x in ")]}")
    out += [f"{ctx}|open={max(-1, min(2, opened))}|{max(-1, min(2, own))}", f"{ctx}|quotes={line.count(chr(34)) % 2}{line.count(chr(39)) % 2}{block.count(chr(34)) % 2}"]
    word = _LAST_WORD.search(line)
    if word:
        w = word[0]
        earlier = text[: len(text) - len(w)]
        known = re.search(rf"(?<!\w){re.escape(w)}(?!\w)", earlier) is not None
        longer = not known and re.search(rf"(?<!\w){re.escape(w)}\w", earlier) is not None
        out += [f"{ctx}|word={'known' if known else 'longer' if longer else 'new'}", f"{ctx}|last={w.lower()[-24:]}", f"{ctx}|word={'known' if known else 'longer' if longer else 'new'}|len={min(len(w), 8)}|{form[-8:]}"]
    fields, above = line.split(), before.split()
    if fields and (m := _NUMBER.match(fields[-1])):
        ref = _NUMBER.match(above[-1]) if above else None
        same = "none" if ref is None else "same" if len(m[1] or "") == len(ref[1] or "") else "other"
        out.append(f"{ctx}|row={'same' if len(fields) == len(above) else 'fewer' if len(fields) < len(above) else 'more'}|{same}|{min(4, len(m[1] or ''))}")
    elif len(fields) > 1 and len(above) > 1:
        out.append(f"{ctx}|columns={max(-2, min(2, len(fields) - len(above)))}")
    if b := _BASE64.search(line):
        out.append(f"{ctx}|base64={(len(b[1]) + len(b[2])) % 4}{'=' in b[2]}")
    return out


def codes(features: list[str]) -> list[int]:
    return sorted({zlib.crc32(f.encode()) % BUCKETS for f in features})


def cut_place(doc: int, n: int) -> int:
    """A place in 1..n-1 that depends on the id alone."""
    return 1 + zlib.crc32(b"cut%d" % doc) * (n - 1) // (1 << 32)


def evidence(docs: DataFrame, doc_id: str, text: str, source: str, share: float) -> DataFrame:
    """``(doc_id, source, chars, bytes, hash, found, cut)``: length and ending of whole texts; ``cut`` for the training sample only."""
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("text"))
    d = d.filter("doc_id is not null and text is not null and text <> ''").withColumn("hash", F.xxhash64("text"))
    bound = int(share * (1 << 32))
    out = "doc_id long, source string, chars long, bytes long, hash long, found array<int>, cut array<int>"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, texts, hashes = batch.columns
            chars, size, found, cut = [], [], [], []
            for i, t in zip(ids.to_pylist(), texts):
                s = t.as_py()
                chars.append(len(s))
                size.append(len(t.as_buffer()))
                found.append(codes(ending(s)))
                chosen = zlib.crc32(b"sample%d" % i) < bound and len(s) > 1
                cut.append(codes(ending(s[: cut_place(i, len(s))])) if chosen else None)
            cols = [ids, sources, chars, size, hashes, found, cut]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "source", "chars", "bytes", "hash", "found", "cut"])

    return d.mapInArrow(run, out)


@dataclass
class EndingModel:
    """Weights over hashed features; ``ratio`` is the log-likelihood ratio of cut against whole."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def raw(self, rows: list) -> np.ndarray:
        flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
        which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return self.bias + np.bincount(which, self.weights[flat], minlength=len(rows))

    def ratio(self, rows: list) -> np.ndarray:
        return np.clip(self.scale * self.raw(rows) + self.shift, -RATIO_MOST, RATIO_MOST)


def _descend(whole: list, cut: list, weights: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Adaptive stochastic gradient descent; both classes weigh the same."""
    rows = [np.asarray(r, np.int64) for r in [*whole, *cut]]
    y = np.r_[np.zeros(len(whole)), np.ones(len(cut))]
    per = np.where(y == 1, len(y) / (2 * max(1, len(cut))), len(y) / (2 * max(1, len(whole))))
    bias, rng, seen = 0.0, np.random.default_rng(seed), np.full(len(weights), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            flat = np.concatenate([rows[i] for i in part])
            which = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(which, weights[flat], minlength=len(part)), -30, 30)))
            g = (p - y[part]) * per[part]
            at, back = np.unique(flat, return_inverse=True)
            grad = np.bincount(back, g[which]) + 2e-3 * weights[at] * len(part)
            seen[at] += grad**2
            weights[at] -= 0.3 * grad / np.sqrt(seen[at])
            bias -= 0.02 * g.mean()
    return weights, bias


def _common(rows: list) -> list:
    """The rows without the features that fewer than LEAST_TEXTS of them have."""
    seen = np.bincount(np.concatenate([np.empty(0, np.int64), *(np.asarray(r, np.int64) for r in rows)]), minlength=BUCKETS)
    return [[f for f in r if seen[f] >= LEAST_TEXTS] or r[:1] for r in rows]


def _fit(whole: list, cut: list, seed: int) -> EndingModel:
    rows = _common([*whole, *cut])
    return EndingModel(*_descend(rows[: len(whole)], rows[len(whole) :], np.zeros(BUCKETS), seed), 1.0, 0.0)


def _presumed_whole(whole: list, cut: list, bound: float, seed: int) -> list:
    """The endings that a model fitted on the other half doesn't take for cut: some true endings are cuts."""
    kept = []
    for half in (0, 1):
        model = _fit(whole[1 - half :: 2], cut[1 - half :: 2], seed)
        own = whole[half::2]
        kept += [r for r, s in zip(own, model.raw(own)) if s < bound]
    return kept or whole


def train_endings(whole: list, cut: list, seed: int = 3) -> EndingModel:
    """Fit on two thirds, calibrate on the rest, each without the true endings that look cut to a model that didn't see them.

    The same at every size: ridge and prior hold the ratios of a model near 0
    that has seen little, and at 0 if it has seen nothing.
    """
    train_w, train_c = [r for i, r in enumerate(whole) if i % 3], [r for i, r in enumerate(cut) if i % 3]
    for bound in PLAINLY_CUT:
        train_w = _presumed_whole(train_w, train_c, bound, seed)
    model = _fit(train_w, train_c, seed)
    held_w, held_c = whole[::3], cut[::3]
    sw, sc = model.raw(held_w), model.raw(held_c)
    sw = sw[sw < 0] if (sw < 0).any() else sw
    x, y = np.r_[sw, sc], np.r_[np.zeros(len(sw)), np.ones(len(sc))]
    per = np.where(y == 1, 1 / max(1, len(sc)), 1 / max(1, len(sw)))
    few = 1 / (1 + len(x))  # the prior (scale 1, shift 0) weighs as much as one ending
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt's sigmoid, both classes weighing the same
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = per * (p - y), per * p * (1 - p) + 1e-9
        grad = np.array([(g * x).sum() + (1e-3 + few) * (a - 1), g.sum() + few * b])
        hess = np.array([[(h * x * x).sum() + 1e-3 + few, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6 + few]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return EndingModel(model.weights, model.bias, max(0.1, a), b)


def censored_lognormal(mid: np.ndarray, n: np.ndarray, limit: np.ndarray, at: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of log lengths: ``n`` texts about each ``mid``, ``at`` texts known only to be longer than each ``limit``."""
    x, c = np.log(mid), np.log(limit)
    total = n.sum() + at.sum()
    if total == 0:
        return 0.0, 1.0
    mean = (n @ x + at @ c) / total
    dev = max(0.3, math.sqrt(max(1e-6, (n @ (x - mean) ** 2 + at @ (c - mean) ** 2) / total)))
    for _ in range(100):
        z = (c - mean) / dev
        tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        hazard = np.where(tail > 1e-12, np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-300), z)
        e1, e2 = mean + dev * hazard, mean**2 + dev**2 + dev * (c + mean) * hazard
        new = (n @ x + at @ e1) / total
        spread = (n @ x**2 + at @ e2) / total - new**2
        done = abs(new - mean) < 1e-6
        mean, dev = new, max(0.05, math.sqrt(max(1e-6, spread)))
        if done:
            break
    return float(mean), float(dev)


def length_counts(seen: DataFrame) -> DataFrame:
    """``(source, unit, length, n, rest, is_limit)``: different texts per exact length, in characters and in byte steps, and in its neighbourhood."""
    units = F.explode(F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")),
        F.struct(F.lit("bytes").alias("unit"), (F.ceil(F.col("bytes") / BYTE_STEP) * BYTE_STEP).cast("long").alias("length")),
    ))
    exact = seen.select("source", "hash", units.alias("u")).select("source", "hash", "u.unit", "u.length").distinct()
    exact = exact.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    return exact.withColumn("bin", F.floor(F.ln("length") * LENGTH_STEPS).cast("int"))


def limit_posteriors(seen: DataFrame) -> DataFrame:
    """``(source, unit, length, n, p_limit)``: candidate limits and the share of the texts there that were cut by them."""
    exact = length_counts(seen)
    # a window holds the lengths of one bin of one source, pre-aggregated
    exact = exact.withColumn("bin_n", F.sum("n").over(Window.partitionBy("source", "unit", "bin")))
    bins = exact.groupBy("source", "unit", "bin").agg(F.sum("n").alias("bin_n"))
    step = F.when(F.col("unit") == "bytes", BYTE_STEP).otherwise(1)
    width = F.greatest(F.lit(1.0), (F.exp((F.col("bin") + 1) / LENGTH_STEPS) - F.exp(F.col("bin") / LENGTH_STEPS)) / step)
    near = exact.filter(F.col("n") >= LEAST_AT_LIMIT)
    near = near.withColumn("mean", (F.col("bin_n") - F.col("n") + 0.5) / width)
    limits = near.filter(F.col("n") >= F.col("mean") + DEVIATIONS * F.sqrt("mean") + 2).select("source", "unit", F.col("length").alias("at"), F.col("n").alias("weight"), F.lit(1).alias("is_limit"))
    rows = limits.unionByName(bins.select("source", "unit", F.col("bin").cast("long").alias("at"), F.col("bin_n").alias("weight"), F.lit(0).alias("is_limit")))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        own, hist = frame[frame["is_limit"] == 1], frame[frame["is_limit"] == 0]
        limit, at = own["at"].to_numpy(float), own["weight"].to_numpy(float)
        bin_at, n = hist["at"].to_numpy(float), hist["weight"].to_numpy(float).copy()
        for x, k in zip(limit, at):  # the texts at a limit leave the histogram
            n[bin_at == math.floor(math.log(x) * LENGTH_STEPS)] -= k
        n = np.maximum(n, 0)
        mean, dev = censored_lognormal(np.exp((bin_at + 0.5) / LENGTH_STEPS), n, limit, at)
        step = BYTE_STEP if frame["unit"].iloc[0] == "bytes" else 1
        density = np.exp(-0.5 * ((np.log(limit) - mean) / dev) ** 2) / (limit * dev * math.sqrt(2 * math.pi))
        expected = (n.sum() + at.sum()) * density * step
        p = np.clip(1 - expected / at, 0.0, 0.995)
        return pd.DataFrame({"source": own["source"].astype(object), "unit": own["unit"].astype(object), "length": own["at"], "n": own["weight"], "p_limit": p})

    # a group holds the histogram of one source and unit: a few hundred rows at most, and its limits
    return rows.groupBy("source", "unit").applyInPandas(fit, "source string, unit string, length long, n long, p_limit double")


def loose_shares(rated: DataFrame) -> DataFrame:
    """``(source, p_loose)``: the share of a source's texts that are cut at no limit, by expectation maximisation over ratios."""
    hist = rated.filter("p_limit = 0").groupBy("source", F.round(F.col("ratio") / RATIO_STEP).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        r, n = np.exp(frame["step"].to_numpy(float) * RATIO_STEP), frame["n"].to_numpy(float)
        p = 0.05
        for _ in range(200):
            cut = p * r / (p * r + 1 - p)
            new = (n @ cut + PRIOR_CUT) / (n.sum() + PRIOR_CUT + PRIOR_WHOLE)
            if abs(new - p) < 1e-9:
                break
            p = new
        return pd.DataFrame({"source": frame["source"].iloc[:1].astype(object), "p_loose": [float(p)]})

    return hist.groupBy("source").applyInPandas(fit, "source string, p_loose double")


def truncation(docs: DataFrame, doc_id: str, text: str, source: str, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, source, chars, bytes, p_limit, ratio, p_loose, p_cut)`` of every text: the posterior that it was cut.

    Null and empty texts say nothing and are left out, as are rows without an
    id; texts without a source form a source of their own; copies of a text
    count once for the lengths; every row of ``docs`` comes out once.  The model
    of endings is fitted on about ``sample`` texts at most, chosen by id; all
    else covers every text.
    """
    ship_package(docs.sparkSession)
    n = docs.count()
    seen = materialise(evidence(docs, doc_id, text, source, min(1.0, sample / max(1, n))), "endings")
    limits = materialise(limit_posteriors(seen), "limits")  # a few rows per source, used in several places
    by_chars = limits.filter("unit = 'chars'").select(F.col("source").alias("s1"), F.col("length").alias("l1"), F.col("p_limit").alias("p1"))
    by_bytes = limits.filter("unit = 'bytes'").select(F.col("source").alias("s2"), F.col("length").alias("l2"), F.col("p_limit").alias("p2"))
    placed = seen.join(by_chars, F.col("source").eqNullSafe(F.col("s1")) & (F.col("chars") == F.col("l1")), "left")
    placed = placed.join(by_bytes, F.col("source").eqNullSafe(F.col("s2")) & ((F.ceil(F.col("bytes") / BYTE_STEP) * BYTE_STEP).cast("long") == F.col("l2")), "left")
    placed = placed.withColumn("p_limit", F.greatest(F.coalesce("p1", F.lit(0.0)), F.coalesce("p2", F.lit(0.0))))
    # endings at a limit are no examples of whole texts
    rows = placed.filter("cut is not null").select("found", "cut", "p_limit", "doc_id", F.xxhash64("doc_id", F.lit(29)).alias("h")).orderBy("h").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["found"]))
    model = docs.sparkSession.sparkContext.broadcast(train_endings([r[0] for r in rows if r[2] < 0.5], [r[1] for r in rows]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.value.ratio(batch.column(5).to_pylist()) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(got, pa.float64())], names=["doc_id", "source", "chars", "bytes", "p_limit", "ratio"])

    rated = placed.select("doc_id", "source", "chars", "bytes", "p_limit", "found").mapInArrow(rate, "doc_id long, source string, chars long, bytes long, p_limit double, ratio double")
    loose = loose_shares(rated).select(F.col("source").alias("s3"), "p_loose")
    rated = rated.join(loose, F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
    prior = F.greatest(F.lit(1e-4), F.coalesce("p_loose", F.lit(0.02)))
    prior = 1 - (1 - prior) * (1 - F.col("p_limit"))
    odds = F.ln(prior / (1 - prior)) + F.col("ratio")
    return rated.withColumn("p_cut", 1 / (1 + F.exp(-odds)))


def source_report(cut: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(source, n_texts, n_cut, n_at_limit, share_cut)``: how often each source cuts."""
    is_cut = (F.col("p_cut") >= threshold).cast("long")
    got = cut.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(is_cut).alias("n_cut"), F.sum((is_cut == 1).cast("long") * (F.col("p_limit") > 0).cast("long")).alias("n_at_limit"))
    return got.withColumn("share_cut", F.col("n_cut") / F.col("n_texts"))
