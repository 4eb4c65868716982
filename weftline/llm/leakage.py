"""Held-out test items leaking into a corpus.

Texts and items become sequences of words.  Every window of ``WINDOW`` words of
an item, and every window of a text that could be one, is embedded by random
walks (CGK): the walk copies the current word and steps on or not by a random
bit of (step, word), so that few edits between two windows leave few positions
of their embeddings different.  Samples of embedding positions are hashed into
tables; windows that meet in any table are compared exactly by edit distance.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialise, ship_package

#: Successive words that make a leak, and edits (changed, missing or added words) allowed among them.
WINDOW, MOST_EDITS = 20, 4
#: Random walks, tables per walk, and embedding positions sampled for each table.
WALKS, TABLES, SAMPLED = 8, 8, 5
#: Share of a window's information that must be there: words that many items use (as in questions of one pattern) tell little.
LEAST_WEIGHT = 0.7
#: Windows of texts that are looked up together.
WINDOWS_AT_ONCE = 10_000
#: Items in one block of the index; a task holds one block at a time.
ITEMS_AT_ONCE = 5_000
#: Words of texts that are held, once cut, while the blocks of the index are gone through.
WORDS_AT_ONCE = 4_000_000

#: Cyrillic and Greek letters that look like Latin ones, by the Latin letter; marks that show nothing.
LOOKALIKES = {
    "a": "\u0430\u03b1", "c": "\u0441\u03f2", "d": "\u0501", "e": "\u0435", "h": "\u04bb", "i": "\u0456\u03b9", "j": "\u0458", "k": "\u043a\u03ba", "l": "\u04cf", "m": "\u043c", "o": "\u043e\u03bf",
    "p": "\u0440\u03c1", "q": "\u051b", "s": "\u0455", "t": "\u0442\u03c4", "u": "\u03c5", "v": "\u03bd\u0475", "w": "\u051d", "x": "\u0445\u03c7", "y": "\u0443",
    "A": "\u0410\u0391", "B": "\u0412\u0392", "C": "\u0421", "E": "\u0415\u0395", "H": "\u041d\u0397", "I": "\u0406\u0399", "J": "\u0408", "K": "\u041a\u039a", "M": "\u041c\u039c", "N": "\u039d",
    "O": "\u041e\u039f", "P": "\u0420\u03a1", "S": "\u0405", "T": "\u0422\u03a4", "X": "\u0425\u03a7", "Y": "\u0423\u03a5", "Z": "\u0396",
}
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u200e\u200f"
FOLD = {ord(x): latin for latin, alike in LOOKALIKES.items() for x in alike} | dict.fromkeys(map(ord, UNSEEN))

_ODD = re.compile("[" + "".join(map(chr, FOLD)) + "]")
_ESCAPE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|[nrt])")
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>")
_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_BROKEN = re.compile(r"(?<=[a-z])-\n[#>\s]*(?=[a-z])")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!:])\s+|\n+")


def plain_text(text: str) -> str:
    """Text without escapes, entities, tags, colour codes, unseen marks and look-alike letters, in lower case."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\x1b" in text:
        text = _ANSI.sub("", text)
    if "-\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _ODD.search(text):
            text = text.translate(FOLD)
    return text.lower()


def words(text: str) -> list[str]:
    return _WORD.findall(plain_text(text))


@dataclass
class ItemIndex:
    """Everything a task needs to search for a block of items; its size depends on the items only."""

    ids: list[int]  # item ids
    vocabulary: dict[str, int]
    owner: np.ndarray  # item of each window
    start: np.ndarray  # its first word in the item
    rows: np.ndarray  # its words
    own: list[np.ndarray]  # for each item, which words are its own
    weight: np.ndarray  # information of each word: the logarithm of how rare it is among the items
    grams: np.ndarray  # sorted codes of the items' word triples
    bits: np.ndarray  # (walk, step, word) -> 0 or 1
    positions: np.ndarray  # (table, sampled position)
    factors: np.ndarray
    keys: list[np.ndarray]  # for each table, sorted keys and, beside them, windows
    windows: list[np.ndarray]

    def embed(self, rows: np.ndarray, walk: int) -> np.ndarray:
        """CGK embedding: (n, 3 * WINDOW) words, 0 beyond the end."""
        n, width = rows.shape
        padded = np.zeros((n, width + 1), rows.dtype)
        padded[:, :width] = rows
        at, out, line = np.zeros(n, np.int64), np.empty((n, 3 * width), rows.dtype), np.arange(n)
        bits = self.bits[walk]
        for j in range(3 * width):
            word = padded[line, at]
            out[:, j] = word
            at = np.minimum(at + bits[j, word], width)
        return out

    def table_keys(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For every table, the key of every window."""
        for walk in range(WALKS):
            e = self.embed(rows, walk).astype(np.int64)
            for t in range(walk * TABLES, (walk + 1) * TABLES):
                yield (e[:, self.positions[t]] * self.factors[t]).sum(axis=1)


@dataclass
class ItemStatistics:
    """What all items together say: how many there are, in how many every word is, and the sentences that several share."""

    n: int
    uses: Counter
    shared: set[int]


def _sentences(text: str | None) -> list[list[str]]:
    return [words(s) for s in _SENTENCE.split(text or "")]


def _sentence_code(sentence: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(sentence))


def item_statistics(texts: Iterable[str | None]) -> ItemStatistics:
    n, uses, seen = 0, Counter(), Counter()
    for t in texts:
        per = _sentences(t)
        n += 1
        uses.update({w for s in per for w in s})
        seen.update({_sentence_code(s) for s in per if s})
    return ItemStatistics(n, uses, {c for c, k in seen.items() if k > 1})


def build_index(items: list[tuple[int, str]], statistics: ItemStatistics | None = None, seed: int = 7) -> ItemIndex:
    """Index of ``(id, text)`` pairs; sentences that several items share (of all items, not only these) aren't an item's own words."""
    statistics = statistics or item_statistics(t for _, t in items)
    seqs, own = [], []
    for _, t in items:
        per = _sentences(t)
        seqs.append([w for s in per for w in s])
        own.append(np.array([bool(mine) for s in per for mine in [_sentence_code(s) not in statistics.shared] * len(s)], bool))
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in s], np.int64) for s in seqs]
    size = len(vocabulary) + 1
    owner, start, rows, grams = [], [], [], [np.empty(0, np.int64)]
    for k, (x, mine) in enumerate(zip(coded, own)):
        for j in range(len(x) - WINDOW + 1):
            if mine[j : j + WINDOW].any():
                owner.append(k)
                start.append(j)
                rows.append(x[j : j + WINDOW])
        if len(x) > 2:
            some = mine[:-2] | mine[1:-1] | mine[2:]
            grams.append(((x[:-2] * size + x[1:-1]) * size + x[2:])[some])
    uses = np.ones(size)
    for w, k in vocabulary.items():
        uses[k] = statistics.uses[w]
    weight = np.log((statistics.n + 1) / np.maximum(1, uses))
    rng = np.random.default_rng(seed)
    n_tables = WALKS * TABLES
    index = ItemIndex(
        [i for i, _ in items], vocabulary, np.array(owner, np.int64), np.array(start, np.int64), np.array(rows, np.int64).reshape(-1, WINDOW), own, weight, np.unique(np.concatenate(grams)),
        rng.integers(0, 2, (WALKS, 3 * WINDOW, size), np.int8), np.stack([rng.choice(2 * WINDOW, SAMPLED, replace=False) for _ in range(n_tables)]),
        rng.integers(1 << 20, 1 << 42, (n_tables, SAMPLED)) | 1, [], [],
    )
    for key in index.table_keys(index.rows):
        order = np.argsort(key, kind="stable")
        index.keys.append(key[order])
        index.windows.append(order)
    return index


def possible_starts(index: ItemIndex, x: np.ndarray) -> np.ndarray:
    """Where a window within MOST_EDITS of an item's can begin.

    Loses none: so many edits leave WINDOW - MOST_EDITS known words, and a run of
    at least (WINDOW - MOST_EDITS) / (MOST_EDITS + 1) unchanged ones, hence
    triples that occur in an item.
    """
    n, size = len(x), len(index.vocabulary) + 1
    if n < WINDOW - MOST_EDITS:
        return np.empty(0, np.int64)
    known = x > 0
    at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
    code = (x[at] * size + x[at + 1]) * size + x[at + 2]
    place = np.searchsorted(index.grams, code)
    place[place == len(index.grams)] = 0
    at = at[index.grams[place] == code] if len(index.grams) else at[:0]
    run = -(-(WINDOW - MOST_EDITS) // (MOST_EDITS + 1))
    if len(at) < run - 2 or not len(at):
        return np.empty(0, np.int64)
    hits = np.zeros(n + WINDOW + 1, np.int64)
    hits[at + 1] = 1
    hits = hits.cumsum()
    total = np.zeros(n + WINDOW + 1, np.int64)
    total[1 : n + 1] = known
    total = total.cumsum()
    # only windows that hold a triple are looked at
    near = np.unique((at[:, None] - np.arange(WINDOW - 2)).ravel())
    near = near[near >= 0]
    enough = (hits[near + WINDOW - 2] - hits[near] >= max(1, run - 2)) & (total[near + WINDOW] - total[near] >= WINDOW - MOST_EDITS)
    return near[enough]


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least edits between each row of ``a`` and any beginning of the row of ``b`` beside it."""
    n, la = a.shape
    lb = b.shape[1]
    row = np.tile(np.arange(lb + 1), (n, 1))
    for i in range(1, la + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        change = row[:, :-1] + (a[:, i - 1 : i] != b)
        best = np.minimum(change, row[:, 1:] + 1)
        for j in range(1, lb + 1):
            new[:, j] = np.minimum(best[:, j - 1], new[:, j - 1] + 1)
        row = new
    return row.min(axis=1)


class Search:
    """Looks for the items in texts, the windows of many texts at once."""

    def __init__(self, index: ItemIndex):
        self.index = index
        self.spans: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.waiting = 0
        self.found: dict[tuple[int, int], np.ndarray] = {}

    def add(self, doc: int, said: list[str]) -> None:
        get = self.index.vocabulary.get
        x = np.array([get(w, 0) for w in said], np.int64)
        starts = possible_starts(self.index, x)
        if len(starts) and len(self.index.rows):
            padded = np.concatenate([x, np.zeros(WINDOW + MOST_EDITS, np.int64)])
            self.spans.append(padded[starts[:, None] + np.arange(WINDOW + MOST_EDITS)])
            self.docs.append(np.full(len(starts), doc))
            self.waiting += len(starts)
            if self.waiting >= WINDOWS_AT_ONCE:
                self.flush()

    def flush(self) -> None:
        if self.waiting:
            spans, docs = np.concatenate(self.spans), np.concatenate(self.docs)
            self.spans, self.docs, self.waiting = [], [], 0
            for k in range(0, len(docs), 2 * WINDOWS_AT_ONCE):
                self.windows(spans[k : k + 2 * WINDOWS_AT_ONCE], docs[k : k + 2 * WINDOWS_AT_ONCE])

    def windows(self, spans: np.ndarray, docs: np.ndarray) -> None:
        index, n_items = self.index, len(self.index.rows)
        rows, back = np.unique(spans[:, :WINDOW], axis=0, return_inverse=True)  # copies of a window are looked up once
        pairs = []
        for t, key in enumerate(index.table_keys(rows)):
            lo, hi = np.searchsorted(index.keys[t], key), np.searchsorted(index.keys[t], key, side="right")
            count = hi - lo
            if count.any():
                mine = np.repeat(np.arange(len(rows)), count)
                other = index.windows[t][np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
                pairs.append(np.unique(mine * n_items + other))
        if not pairs:
            return
        pair = np.unique(np.concatenate(pairs))
        kept = []
        for k in range(0, len(pair), 20_000):
            mine, other = pair[k : k + 20_000] // n_items, pair[k : k + 20_000] % n_items
            theirs = index.rows[other]
            there = (rows[mine][:, :, None] == theirs[:, None, :]).any(axis=1)
            weight = index.weight[theirs]
            # a dropped word lets one more in behind the window
            good = (there.sum(axis=1) >= WINDOW - MOST_EDITS - 1) & ((there * weight).sum(axis=1) >= LEAST_WEIGHT * weight.sum(axis=1))
            kept.append(np.stack([mine[good], other[good]], axis=1))
        kept = np.concatenate(kept)
        order = np.argsort(back, kind="stable")
        first, last = np.searchsorted(back[order], kept[:, 0]), np.searchsorted(back[order], kept[:, 0], side="right")
        at = order[np.arange((last - first).sum()) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)]
        other = np.repeat(kept[:, 1], last - first)
        for k in range(0, len(at), 20_000):
            a, o = at[k : k + 20_000], other[k : k + 20_000]
            good = edit_distances(index.rows[o], spans[a]) <= MOST_EDITS
            for doc, w in zip(docs[a[good]].tolist(), o[good].tolist()):
                item, start = int(index.owner[w]), int(index.start[w])
                self.found.setdefault((doc, item), np.zeros(len(index.own[item]), bool))[start : start + WINDOW] = True

    def result(self) -> list[tuple[int, int, int]]:
        """(text, item number, own words found) of every leak."""
        self.flush()
        return [(d, i, int(n)) for (d, i), hit in self.found.items() if (n := (hit & self.index.own[i]).sum()) >= WINDOW]


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``(doc_id, item_id, n_words)``: every text that holds WINDOW successive words of an item or more.

    Case, punctuation, layout, markup, escapes and look-alike letters are
    aside, and up to MOST_EDITS of each WINDOW words may be changed, missing or
    added.  Sentences that several items share don't count towards the words.
    Items and texts shorter than that leak nothing, as do nulls; copies of a
    (doc_id, text) row give one result, an empty table none.  The items are
    indexed in blocks of ITEMS_AT_ONCE, of which the driver and every task hold
    one at a time, so the index may be any size; texts are read and cut into words
    once, whatever the number of blocks.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = materialise(items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).dropna().distinct(), "items")
    statistics = item_statistics(r[0] for r in held.select("t").toLocalIterator())
    blocks, block = [], []
    for r in held.orderBy("i", "t").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEMS_AT_ONCE:
            blocks.append(spark.sparkContext.broadcast(build_index(block, statistics)))
            block = []
    if block:
        blocks.append(spark.sparkContext.broadcast(build_index(block, statistics)))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    names, kind = ["doc_id", "item_id", "n_words"], "doc_id long, item_id long, n_words int"

    def search(ids: list[int], said: list[list[str]]) -> pa.RecordBatch:
        out = []
        for b in blocks:
            work = Search(b.value)
            for k, x in enumerate(said):
                work.add(k, x)
            out += [(ids[d], work.index.ids[i], n) for d, i, n in work.result()]
            if len(blocks) > 1:
                b.__dict__.pop("_value", None)  # read again when it is needed again
        cols = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        said: list[list[str]] = []
        waiting = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                said.append(words(t.as_py()))
                waiting += len(said[-1])
                if waiting >= WORDS_AT_ONCE:
                    yield search(ids, said)
                    ids, said, waiting = [], [], 0
        if ids:
            yield search(ids, said)

    return texts.mapInArrow(run, kind).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
