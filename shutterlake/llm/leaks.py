"""Evaluation texts that leak into documents.

Evaluation items become a set of normalised word windows, which every task
holds. A document's words are looked up in the items' vocabulary; only where at
least a window's length of consecutive words is known are windows looked up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.sources.tables import materialize

WORDS = re.compile(r"[^\W_]+")
CLEAN = ["doc_id", "removed_words", "kept", "clean_text"]
CLEAN_SHAPE = "doc_id bigint, removed_words bigint, kept boolean, clean_text string"


def plain(text: str) -> str:
    """Without case and diacritics, compatibility forms equal."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text)
    text = unicodedata.normalize("NFKD", "".join(c for c in text if not unicodedata.combining(c)).casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits of the normalised text."""
    return WORDS.findall(plain(text))


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """The words of :func:`words_of` with the stretch of the original text that each comes from."""
    if text.isascii():
        return [(m.group(), m.start(), m.end()) for m in WORDS.finditer(text.lower())]
    out, at = [], []
    for k, c in enumerate(text):
        for x in plain(c):
            out.append(x)
            at.append(k)
    joined = "".join(out)
    return [(m.group(), at[m.start()], at[m.end() - 1] + 1) for m in WORDS.finditer(joined)]


class Windows:
    """All windows of ``n`` words of some items, and the items' vocabulary.

    The items' words are numbers in one array; a window is its place there and a
    64-bit hash, sorted by hash. What a hash finds is compared word by word. A
    window takes 20 bytes.
    """

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.n = n
        self.vocabulary: dict[str, int] = {}
        words, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        starts, at = [np.zeros(0, np.int64)], 0
        for item, text in items:
            known = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in listed] if len(listed := words_of(text)) >= n else []
            if known:
                words.append(np.array(known, np.int32))
                starts.append(np.arange(at, at + len(known) - n + 1))
                owners.append(np.full(len(known) - n + 1, item, np.int64))
                at += len(known)
        self.words = np.concatenate(words)
        begin, owner = np.concatenate(starts), np.concatenate(owners)
        self.powers = np.power(np.uint64(0x9E3779B97F4A7C15), np.arange(n, dtype=np.uint64))
        hashes = self._hashes(self.words)[begin] if len(begin) else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.owners = hashes[order], begin[order], owner[order]

    def _hashes(self, words: np.ndarray) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(words.astype(np.uint64) + np.uint64(1), self.n)
        out = np.zeros(len(views), np.uint64)
        for k in range(self.n):
            out += views[:, k] * self.powers[k]
        return out ^ (out >> np.uint64(29))

    def hits(self, words: list[str]) -> list[tuple[int, set[int]]]:
        """(position of a window, items that hold it), in order."""
        found: list[tuple[int, set[int]]] = []
        get, n, run = self.vocabulary.get, self.n, 0
        ids = [get(w, -1) for w in words]
        for k, w in enumerate([*ids, -1]):
            if w >= 0:
                run += 1
                continue
            if run >= n:
                found += self._run(np.array(ids[k - run : k], np.int32), k - run)
            run = 0
        return found

    def _run(self, ids: np.ndarray, offset: int) -> list[tuple[int, set[int]]]:
        hashes = self._hashes(ids)
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        out = []
        for k in np.flatnonzero(low < high):
            window = ids[k : k + self.n]
            items = {int(self.owners[j]) for j in range(low[k], high[k]) if (self.words[self.starts[j] : self.starts[j] + self.n] == window).all()}
            if items:
                out.append((offset + int(k), items))
        return out


def _passes(items: DataFrame, n: int, most_chars: int) -> Iterator[Windows]:
    """Sets of windows of at most ``most_chars`` characters of items each; an item longer than that comes in parts that overlap by a window."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        parts = [r["text"]]
        if len(r["text"]) > most_chars:
            words = words_of(r["text"])
            step = max(n, most_chars // 8)
            parts = [" ".join(words[k : k + step + n - 1]) for k in range(0, max(1, len(words) - n + 1), step)]
        for part in parts:
            if held and size + len(part) > most_chars:
                yield Windows(held, n)
                held, size = [], 0
            held.append((r["item_id"], part))
            size += len(part)
    yield Windows(held, n)


def _scanned(documents: DataFrame, items: DataFrame, n: int, most_chars: int, scan: Callable[[Windows], Callable], shape: str) -> tuple[DataFrame, bool]:
    """The rows of ``scan`` over all documents for each set of windows, and whether there were several; then each pass is written before the next set is read."""
    sets = _passes(items, n, most_chars)
    now, out = next(sets), []
    for following in sets:
        out.append(materialize(documents.mapInPandas(scan(now), shape), "leaks"))
        now = following
    last = documents.mapInPandas(scan(now), shape)
    return reduce(DataFrame.unionByName, [*out, last]), bool(out)


def leaks(documents: DataFrame, items: DataFrame, n: int = 12, most_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, item_id, windows): documents that share at least ``n`` consecutive words with an item, and how many windows they share.

    Null ids and texts take no part; items shorter than ``n`` words leak
    nothing. At most ``most_chars`` characters of items (some 100 MB) go to
    every task at once; further ones are looked for in further passes over the documents.
    """
    known = documents.where("doc_id is not null and text is not null").select("doc_id", "text")

    def scan(windows: Windows):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for doc, text in zip(frame["doc_id"], frame["text"]):
                    counts: dict[int, int] = {}
                    for _, hit in windows.hits(words_of(text)):
                        for item in hit:
                            counts[item] = counts.get(item, 0) + 1
                    out += [(doc, item, c) for item, c in counts.items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "windows"])

        return run

    found, several = _scanned(known, items, n, most_chars, scan, "doc_id bigint, item_id bigint, windows bigint")
    return found.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows")) if several else found


def without_leaks(documents: DataFrame, items: DataFrame, n: int = 12, most_chars: int = 20_000_000, drop_share: float = 0.5) -> DataFrame:
    """(doc_id, removed_words, kept, clean_text): documents that leak, with the leaked spans taken out.

    A span is a maximal run of words covered by shared windows; it goes with
    what stands between its words. A document more than ``drop_share`` of whose
    words leaked isn't kept (clean_text null). Documents without leaks aren't listed.
    Items beyond ``most_chars`` characters are looked for in further passes, as in :func:`leaks`; the places of all passes are cut together.
    """
    known = documents.where("doc_id is not null and text is not null").select("doc_id", "text")

    def places(windows: Windows, text: str) -> tuple[list, list[int]] | None:
        words = words_of(text)
        hits = windows.hits(words)
        if not hits:
            return None
        placed = placed_words(text)
        own = [w for w, _, _ in placed]
        return placed, [k for k, _ in (hits if own == words else windows.hits(own))]

    def scan(windows: Windows):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for doc, text in zip(frame["doc_id"], frame["text"]):
                    found = places(windows, text)
                    if found:
                        out.append((doc, text, found[1]))
                yield pd.DataFrame(out, columns=["doc_id", "text", "ks"])

        return run

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(doc, *_cut(text, placed_words(text), sorted(set(ks)), n, drop_share)) for doc, text, ks in zip(frame["doc_id"], frame["text"], frame["ks"])], columns=CLEAN)

    found, several = _scanned(known, items, n, most_chars, scan, "doc_id bigint, text string, ks array<bigint>")
    if several:
        found = found.groupBy("doc_id", F.xxhash64("text").alias("_text"), "text").agg(F.flatten(F.collect_list("ks")).alias("ks")).select("doc_id", "text", "ks")
    return found.mapInPandas(clean, CLEAN_SHAPE)


def _cut(text: str, placed: list[tuple[str, int, int]], starts: list[int], n: int, drop_share: float) -> tuple[int, bool, str | None]:
    """(removed_words, kept, clean_text) of a text whose windows at ``starts`` are shared."""
    covered = bytearray(len(placed))
    for k in starts:
        covered[k : k + n] = b"\x01" * n
    pieces, at, gone = [], 0, sum(covered)
    for m in re.finditer(rb"\x01+", bytes(covered)):
        pieces.append(text[at : placed[m.start()][1]])
        at = placed[m.end() - 1][2]
    kept = gone <= drop_share * len(placed)
    return gone, kept, "".join(pieces) + text[at:] if kept else None
