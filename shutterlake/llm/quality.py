"""Text quality: statistics of words, symbols and lines that tell running prose from everything else.

A text is read in chunks cut at white space. Each chunk becomes a state of
additive counts: of the whole lines inside, already judged, and of the open
lines at both ends, not yet judged. Two neighbouring states merge into one by
joining the open lines, with the pair of words at the seam counted; so a huge
text is split over many tasks and its states are merged in a tree.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of scripts that write words without blanks, each a word by itself, and marks that belong to the letter before.
SOLID = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
MARKS = "\u0300-\u036f\u0591-\u05bd\u0610-\u061a\u064b-\u065f\u0900-\u0963\u0970-\u09e3\u0a01-\u0a65\u0a70-\u0ae3\u0b01-\u0b65\u0b71-\u0be5\u0c00-\u0c65\u0c80-\u0ce5\u0d00-\u0d65"
WORD = re.compile(rf"[{SOLID}]|(?:[^\W\d_{SOLID}]|[{MARKS}])+(?:['’-](?:[^\W\d_{SOLID}]|[{MARKS}])+)*")
MARK = re.compile(r"^\s*(?:[-*+•–—·]|\(?\d{1,4}[.):]|[a-zA-Z][.)])\s+")
STAMP = re.compile(r"^\s*\[?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\]?\s*")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
ENTITY = re.compile(r"&(?:#\d{1,6}|#x[0-9a-fA-F]{1,5}|[a-zA-Z]{2,8});")
FIELD = re.compile(r"^\s*[\"']?[\w .]{1,30}[\"']?\s*[:=]\s*\S")
BLANKS = re.compile(r"\s+")
BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
TOKEN = re.compile(rf"{WORD.pattern}|[\n\r\x0b\x0c\x85\u2028\u2029]")
STOPS, COMMAS = ".!?…。！？؟।", ",;，、；،"
CLOSERS = " \t\xa0\u3000\"'»”’)]）」』"
#: What a line may have of its head looked at, blanks taken as one.
HEAD = 80

#: Additive counts of a line or part of one.
COUNTS = ("chars", "letters", "digits", "blanks", "symbols", "words", "wordchars", "solid", "common", "pairs", "fit", "commas", "stops", "tags")
SUMS = ("lines", "prose", "loose", "loose_pairs", "loose_fit", "short", "short_lines", "prose_lines", "other", "stopped", "marked", "seen_chars", "seen_words", "seen_wordchars", "seen_common", "seen_symbols", "seen_digits")
#: A pair's fit is kept in so many parts of a bit, so that sums don't depend on their order.
PARTS = 16


class Lexicon:
    """The commonest words of a corpus, and how well each two of them follow one another in it.

    ``fit`` of two words is how many times more often, in bits, they stand side
    by side than they would by chance; from -3 to 3. It is positive on average
    in sentences and not in shuffled words, in any language that the corpus
    holds. Words of other languages are unknown and tell nothing.
    """

    def __init__(self, words: list[str], counts: np.ndarray, core: int = 50) -> None:
        self.size, self.core = len(words), core
        self.index = {w: k for k, w in enumerate(words)}
        before, after, every = counts.sum(1, keepdims=True), counts.sum(0, keepdims=True), max(counts.sum(), 1)
        chance = before * after / every
        bits = np.log2((counts + 0.5) / (chance + 0.5)) if self.size else np.zeros((0, 0))
        self.fit = np.clip(np.rint(bits * PARTS), -3 * PARTS, 3 * PARTS).astype(int).ravel().tolist()

    def pair(self, a: str, b: str) -> int | None:
        """The fit of two words, null unless both are known."""
        i, j = self.index.get(a, -1), self.index.get(b, -1)
        return self.fit[i * self.size + j] if i >= 0 and j >= 0 else None


def _stripped(text: str) -> tuple[str, int]:
    """The text of a stretch without markup, and the characters that tags took."""
    tags = 0
    if "<" in text:
        plain = TAG.sub(" ", text)
        tags, text = len(text) - len(plain), plain
    if "&" in text:
        text = ENTITY.sub("'", text)
    if "**" in text or "__" in text or "`" in text:
        text = text.replace("**", "").replace("__", "").replace("`", "")
    return text, tags


def learn_lexicon(documents: DataFrame, size: int = 400, least_documents: int = 3) -> Lexicon:
    """The lexicon of all documents (text): the ``size`` words that most of them hold, and the counts of their pairs.

    Documents are counted by word in the JVM, partial counts before the
    shuffle; pairs by one matrix a task, summed. ``size`` words and their
    square's counts go to the driver, whatever the corpus.
    """
    texts = documents.where("text is not null").select("text")
    held = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+(?:['’-]\p{L}+)*)"), F.lit(1)))).alias("w"))
    top = held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents).orderBy(F.desc("n"), "w").limit(size)
    words = [r["w"] for r in top.collect()]
    index, v = {w: k for k, w in enumerate(words)}, len(words)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, get = np.zeros(v * v, np.int64), index.get
        for frame in frames:
            at: list[int] = []
            for text in frame["text"]:
                at += [get(w, -1) for w in TOKEN.findall(_stripped(text)[0].lower())]
                at.append(-1)
            known = np.array(at, np.int64)
            both = (known[:-1] >= 0) & (known[1:] >= 0)
            found += np.bincount(known[:-1][both] * v + known[1:][both], minlength=v * v)
        at = np.flatnonzero(found)
        yield pd.DataFrame({"at": at, "n": found[at]})

    counts = np.zeros(v * v, np.int64)
    if v:
        summed = texts.mapInPandas(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        counts[summed["at"].to_numpy(int)] = summed["n"].to_numpy(int)
    return Lexicon(words, counts.reshape(v, v))


def _count(text: str, lexicon: Lexicon) -> tuple[dict[str, int], str, str]:
    """The counts of a stretch without line breaks, its first and its last word."""
    text, tags = _stripped(text)
    words = WORD.findall(text.lower())
    common = pairs = fit = solid = 0
    before, index, fits, v, core = -1, lexicon.index, lexicon.fit, lexicon.size, lexicon.core
    for w in words:
        k = index.get(w, -1)
        if k >= 0:
            common += k < core
            if before >= 0:
                pairs += 1
                fit += fits[before * v + k]
        before = k
    wordchars = sum(map(len, words))
    if not text.isascii():
        solid = sum(len(w) == 1 and w > "\u0dff" for w in words)
    digits = sum(map(text.count, "0123456789"))
    blanks = text.count(" ") + text.count("\t")
    commas, stops = sum(map(text.count, COMMAS)), sum(map(text.count, STOPS))
    counts = (len(text), wordchars, digits, blanks, max(0, len(text) - wordchars - digits - blanks), len(words), wordchars, solid, common, pairs, fit, commas, stops, tags)
    return dict(zip(COUNTS, counts)), words[0] if words else "", words[-1] if words else ""


class Line:
    """A line, or the part of it seen so far."""

    __slots__ = ("n", "first", "last", "head", "end")

    def __init__(self, text: str, lexicon: Lexicon) -> None:
        self.n, self.first, self.last = _count(text, lexicon)
        self.head = BLANKS.sub(" ", text)[:HEAD]
        self.end = text.rstrip(CLOSERS)[-1:]

    def join(self, other: Line, lexicon: Lexicon) -> Line:
        seam = lexicon.pair(self.last, other.first)
        for k in COUNTS:
            self.n[k] += other.n[k]
        if seam is not None:
            self.n["pairs"] += 1
            self.n["fit"] += seam
        self.first, self.last = self.first or other.first, other.last or self.last
        if len(self.head) < HEAD:
            self.head = BLANKS.sub(" ", self.head + other.head)[:HEAD]
        self.end = other.end or self.end
        return self

    def dump(self) -> list:
        return [[self.n[k] for k in COUNTS], self.first, self.last, self.head, self.end]

    @staticmethod
    def load(x: list) -> Line:
        line = Line.__new__(Line)
        line.n, line.first, line.last, line.head, line.end = dict(zip(COUNTS, x[0])), x[1], x[2], x[3], x[4]
        return line


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules by which a line is no running sentence."""

    odd: float = 0.12  # symbols besides punctuation, of all but blanks
    figures: float = 0.2
    letters: float = 0.72
    word: float = 13.0  # mean length
    phrase: float = 4.5  # words between commas in an enumeration
    enumerated: float = 0.38  # common words below which phrases are an enumeration
    fit: float = -0.4  # bits a pair below which words are shuffled
    pairs: int = 8  # known pairs by which a line can be judged by itself
    loose_pairs: int = 6  # the same of all lines too short for that


RULES = Rules()


def judge(line: Line, sums: dict[str, int], rules: Rules = RULES) -> None:
    """Add a whole line to the sums: as prose, as something else, or as too short to tell by itself."""
    n = line.n
    full = n["chars"] - n["blanks"]
    if not full and not n["tags"]:
        sums["lines"] += 1
        return
    weight = n["chars"] + n["tags"]
    head = line.head
    mark, stamp = bool(MARK.match(head)), STAMP.match(head)
    words, commas, common = n["words"], n["commas"], n["common"]
    sums["lines"] += 1
    sums["stopped"] += line.end != "" and (line.end in STOPS or line.end == ":")
    sums["marked"] += mark
    for k in ("chars", "words", "wordchars", "common", "symbols", "digits"):
        sums[f"seen_{k}"] += n[k]
    figures = max(0, n["digits"] - (4 if stamp else 0))
    odd = max(0, n["symbols"] - commas - n["stops"] - (4 if stamp else 0) - n["chars"] // 40)
    wordlike = words and n["wordchars"] / words < rules.word and n["letters"] >= rules.letters * full
    other = not wordlike or odd > rules.odd * full or figures > rules.figures * full or n["tags"] > 0.5 * weight or "#" in head[:2] or head.lstrip()[:1] in "{}|/\\"
    spaced = n["chars"] - n["solid"]
    if spaced >= 16 and n["blanks"] * 24 < spaced and (n["digits"] or spaced > 40):
        other = True  # no blanks where words have them: encoded
    if not other and 2 * n["solid"] < words:
        phrases = words / (commas + 1)
        if commas >= 2 and phrases < rules.phrase and common < rules.enumerated * words:
            other = True
        elif mark and (words < 7 or commas and phrases < rules.phrase and words < 12 and common < rules.enumerated * words):
            other = True  # an item of a list
        elif FIELD.match(head) and words < 9:
            other = True  # a name and its value
    if other:
        sums["other"] += weight
    elif words < 6:
        sums["short"] += weight
        sums["short_lines"] += 1
    elif n["pairs"] >= rules.pairs:
        sums["other" if n["fit"] < rules.fit * PARTS * n["pairs"] else "prose"] += weight
        sums["prose_lines"] += 1
    else:
        sums["loose"] += weight
        sums["loose_pairs"] += n["pairs"]
        sums["loose_fit"] += n["fit"]
        sums["prose_lines"] += 1


class State:
    """What is known of a stretch of text: judged sums, and the open lines at its ends (one and the same if it has no break)."""

    def __init__(self, text: str, lexicon: Lexicon, rules: Rules = RULES) -> None:
        parts = BREAK.split(text)
        self.sums = dict.fromkeys(SUMS, 0)
        self.head = Line(parts[0], lexicon)
        self.tail = Line(parts[-1], lexicon) if len(parts) > 1 else None
        for part in parts[1:-1]:
            judge(Line(part, lexicon), self.sums, rules)

    def merge(self, other: State, lexicon: Lexicon, rules: Rules = RULES) -> State:
        for k in SUMS:
            self.sums[k] += other.sums[k]
        open_line = self.tail or self.head
        open_line.join(other.head, lexicon)
        if other.tail is not None:
            if self.tail is not None:
                judge(self.tail, self.sums, rules)
            self.tail = other.tail
        return self

    def close(self) -> dict[str, int]:
        judge(self.head, self.sums)
        if self.tail is not None:
            judge(self.tail, self.sums)
        return self.sums

    def dump(self) -> str:
        return json.dumps([list(self.sums.values()), self.head.dump(), self.tail and self.tail.dump()])

    @staticmethod
    def load(text: str) -> State:
        sums, head, tail = json.loads(text)
        state = State.__new__(State)
        state.sums, state.head, state.tail = dict(zip(SUMS, sums)), Line.load(head), tail and Line.load(tail)
        return state


def chunks(text: str, size: int, near: int = 4096) -> Iterator[str]:
    """Pieces of about ``size`` characters: cut at a line's start if one begins within ``near`` characters, else before white space outside tags, never within a line end."""
    start = 0
    while len(text) - start > size:
        end = start + size
        last = min(len(text), end + near)
        line = text.find("\n", end - 1, last - 1)
        if line >= 0:
            end = line + 1
        else:
            held = text.rfind("<", start, end) > text.rfind(">", start, end)
            blank = re.compile(r"\s").search(text, end, last)
            if held:  # not within what may be a tag
                close = text.find(">", end, last)
                blank = re.compile(r"\s").search(text, close, last) if close >= 0 else blank
            end = blank.start() if blank else last
            if text[end - 1 : end + 1] == "\r\n":
                end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def outcome(sums: dict[str, int], rules: Rules = RULES) -> dict[str, float]:
    """Ratios and the share of characters that aren't running sentences. Blank texts have none (0)."""
    other, prose = sums["other"], sums["prose"]
    if sums["loose_pairs"] >= rules.loose_pairs and sums["loose_fit"] < rules.fit * PARTS * sums["loose_pairs"]:
        other += sums["loose"]
    else:
        prose += sums["loose"]
    if sums["short_lines"] > 2 * sums["prose_lines"]:
        other += sums["short"]
    else:
        prose += sums["short"]
    words, chars, lines = sums["seen_words"], sums["seen_chars"], sums["lines"]
    return {
        "n_words": words, "mean_word_length": sums["seen_wordchars"] / words if words else 0.0, "symbol_ratio": sums["seen_symbols"] / chars if chars else 0.0, "digit_ratio": sums["seen_digits"] / chars if chars else 0.0,
        "stopped_lines": sums["stopped"] / lines if lines else 0.0, "marked_lines": sums["marked"] / lines if lines else 0.0, "common_words": sums["seen_common"] / words if words else 0.0,
        "not_prose": other / (other + prose) if other + prose else 0.0,
    }


def _local(text: str, size: int, lexicon: Lexicon, rules: Rules = RULES) -> State:
    whole = None
    for piece in chunks(text, size):
        state = State(piece, lexicon, rules)
        whole = state if whole is None else whole.merge(state, lexicon, rules)
    return whole


STATS = "n_words bigint, mean_word_length double, symbol_ratio double, digit_ratio double, stopped_lines double, marked_lines double, common_words double, not_prose double"


def text_quality(documents: DataFrame, lexicon: Lexicon | None = None, rules: Rules = RULES, chunk_chars: int = 16_384, huge_chars: int = 262_144) -> DataFrame:
    """(doc_id, n_words, ratios, not_prose) of every document (doc_id, text); null ids and texts are left out.

    ``not_prose`` is the share of characters outside running sentences. What is
    known of words comes from ``lexicon``, which is learnt from all
    ``documents`` unless given; no language is built in. Texts beyond
    ``huge_chars`` are dealt over tasks in chunks and their states merged 64 at
    a time, then by document; all others are read where they are, chunk by
    chunk, without a shuffle. Chunks never change the result but for a word or
    a tag of more than 4096 characters that a cut divides.
    """
    known = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    lexicon = lexicon or learn_lexicon(known)
    names = [x.split()[0] for x in STATS.split(", ")]

    def row(doc: int, state: State) -> list:
        judge(state.head, state.sums, rules)
        if state.tail is not None:
            judge(state.tail, state.sums, rules)
        found = outcome(state.sums, rules)
        return [doc, *[found[n] for n in names]]

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([row(d, _local(t, chunk_chars, lexicon, rules)) for d, t in zip(frame["doc_id"], frame["text"])], columns=["doc_id", *names])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, t in zip(frame["doc_id"], frame["text"]):
                for k, piece in enumerate(chunks(t, huge_chars)):
                    yield pd.DataFrame({"doc_id": [d], "k": [k], "text": [piece]})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "k": frame["k"], "state": [_local(t, chunk_chars, lexicon, rules).dump() for t in frame["text"]]})

    def fold(frame: pd.DataFrame) -> State:
        merged = None
        for text in frame.sort_values("k")["state"]:
            state = State.load(text)
            merged = state if merged is None else merged.merge(state, lexicon, rules)
        return merged

    def some(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "k": [frame["k"].min()], "state": [fold(frame).dump()]})

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([row(frame["doc_id"].iloc[0], fold(frame))], columns=["doc_id", *names])

    shape = f"doc_id bigint, {STATS}"
    usual = known.where(F.length("text") <= huge_chars).mapInPandas(whole, shape)
    pieces = known.where(F.length("text") > huge_chars).mapInPandas(cut, "doc_id bigint, k bigint, text string").repartition("doc_id", "k")
    states = pieces.mapInPandas(read, "doc_id bigint, k bigint, state string")
    tree = states.groupBy("doc_id", F.floor(F.col("k") / 64).alias("_part")).applyInPandas(some, "doc_id bigint, k bigint, state string")
    return usual.unionByName(tree.groupBy("doc_id").applyInPandas(last, shape))
