"""Mixing sources to target weights.

Documents of a known source belong to it; those without one belong to every
source by a classifier's posterior, learnt from the documents that name theirs.
Each document then gets a rate between 0 and its cap, fitted by projected
gradient least squares, so that the expected tokens of every source meet the
targets; rates become whole repeats by a draw that depends on the document alone.
"""

from __future__ import annotations

import base64
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.sources.tables import materialize

WORD = re.compile(r"[^\W_]+")
#: Documents are dealt into so many bins by their ids; whole bins get one more repeat.
BINS = 4096
RANKS = "byte_bpe_50k.tiktoken"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_ranks() -> str:
    """The vocabulary file of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("mixing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def source_key(col: Column) -> Column:
    """Sources that differ in case, padding or '-' for '_' are the same; blank is null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(F.regexp_replace(col, r"[\s\p{Cntrl}]+", " "), "-", "_"))), F.lit(""))


def _features(text: str, size: int) -> np.ndarray:
    """Hashed words of a text, each once, plus its layout (stable across processes)."""
    words = set(WORD.findall(text.lower()))
    seen = {hash_word(w, size) for w in words}
    lines = text.count("\n") + 1
    layout = (f"#lines{min(9, lines.bit_length())}", f"#length{len(text).bit_length()}", f"#digits{int(10 * sum(map(text.count, '0123456789')) / (len(text) or 1))}")
    return np.array(sorted(seen | {hash_word(x, size) for x in layout}), np.int64)


@lru_cache(maxsize=200_000)
def hash_word(word: str, size: int) -> int:
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) % size


class Posteriors:
    """Naive Bayes over hashed words: log odds of the presence of each, at most ``temper`` words' worth of evidence."""

    def __init__(self, counts: np.ndarray, totals: np.ndarray, temper: float = 30.0) -> None:
        self.temper = temper
        with np.errstate(divide="ignore"):
            self.prior = np.log(totals / max(totals.sum(), 1))  # a source without documents has no posterior
        self.usable = bool(totals.sum())
        self.weights = np.log((counts + 0.5) / (totals[:, None] + 1.0))

    def of(self, text: str) -> np.ndarray:
        if not self.usable:
            return np.zeros(len(self.prior))
        at = _features(text, self.weights.shape[1])
        score = self.weights[:, at].sum(1)
        score = self.prior + score * min(1.0, self.temper / max(1, len(at)))
        p = np.exp(score - score.max())
        return p / p.sum()


def learn(documents: DataFrame, names: list[str], size: int = 4096) -> Posteriors:
    """Counts of hashed words by source over all labelled documents (source in ``names``, text): one small matrix a task, summed as it is merged."""
    place = {n: k for k, n in enumerate(names)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, totals = np.zeros((len(names), size), np.int64), np.zeros(len(names), np.int64)
        for frame in frames:
            for source, text in zip(frame["source"], frame["text"]):
                matrix[place[source], _features(text, size)] += 1
                totals[place[source]] += 1
        k, f = np.nonzero(matrix)
        yield pd.DataFrame({"k": np.concatenate([k, np.arange(len(names))]), "f": np.concatenate([f, np.full(len(names), -1)]), "n": np.concatenate([matrix[k, f], totals])})

    summed = documents.where(F.col("source").isin(names)).select("source", "text").mapInPandas(count, "k bigint, f bigint, n bigint").groupBy("k", "f").agg(F.sum("n").alias("n")).toPandas()
    counts, totals = np.zeros((len(names), size)), np.zeros(len(names))
    for k, f, n in summed.itertuples(index=False):
        if f < 0:
            totals[k] = n
        else:
            counts[k, f] = n
    return Posteriors(counts, totals)


def memberships(documents: DataFrame, targets: DataFrame, ranks: str | None = None) -> tuple[DataFrame, list[tuple[str, float, int]]]:
    """(doc_id, source, tokens, belongs array, cap) of every document that can count, and the targets (name, weight, max_repeats).

    ``targets`` has at most some hundred rows; repeated sources keep the largest
    weight. Documents of a source without target count for nothing. A document
    without source belongs to each target by its posterior; its cap is the
    smallest of the sources that it belongs to by 5 % or more.
    """
    listed = targets.select(source_key(F.col("source")).alias("source"), "target_weight", "max_repeats").where("source is not null and target_weight > 0 and max_repeats > 0")
    if listed.count() > 10_000:
        raise ValueError("a mixture has at most 10,000 targets, as each document has a number for each")
    wanted = [(r["source"], float(r["w"]), int(r["m"])) for r in listed.groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("m")).orderBy("source").collect()]
    names, caps = [n for n, _, _ in wanted], np.array([m for _, _, m in wanted], float)
    known = documents.where("doc_id is not null and text is not null").select("doc_id", "text", source_key(F.col("source")).alias("source"))
    model = learn(known, names) if names else None
    path, place = ranks or default_ranks(), {n: k for k, n in enumerate(names)}

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(path).encode_ordinary
        for frame in frames:
            belongs, cap, tokens = [], [], []
            for source, text in zip(frame["source"], frame["text"]):
                if isinstance(source, str):
                    p = np.zeros(len(names))
                    p[place[source]] = 1.0
                else:
                    p = model.of(text)
                belongs.append(p)
                cap.append(caps[p >= 0.05].min() if (p >= 0.05).any() else 0.0)
                tokens.append(len(encode(text)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "tokens": tokens, "belongs": belongs, "cap": cap})

    countable = known.where(F.col("source").isNull() | F.col("source").isin(names)) if names else known.limit(0)
    return countable.mapInPandas(weigh, "doc_id bigint, source string, tokens bigint, belongs array<double>, cap double"), wanted


def mix(documents: DataFrame, targets: DataFrame, ranks: str | None = None, steps: int = 400, tolerance: float = 1e-4) -> tuple[DataFrame, list[tuple[str, float, int]]]:
    """(doc_id, source, tokens, belongs, rate, repeats) and the targets.

    The mixture is as large as it can be without any source that has documents
    falling short of its share. A document's rate is its cap's projection of
    ``1 - belongs . y``; y gathers the scaled gradients of the squared misses,
    one pass over the documents a step, so no state is kept but y. Steps go on
    (each drawn towards where the last six point together)
    until no source misses by more than ``tolerance`` of all tokens; if ``steps``
    don't reach that, or 20 of them bring the greatest miss down by less than a
    hundredth, no better mixture exists within the caps and a warning names the miss. The fraction
    of a source's rate is one more repeat for bins of documents, dealt by id,
    that hold as near as can be that share of its tokens; documents without
    source are drawn one by one. No document exceeds its cap.
    """
    frame, wanted = memberships(documents, targets, ranks)
    frame = materialize(frame, "memberships")
    n = len(wanted)
    sums = lambda value: F.array(*[F.coalesce(F.sum(value * F.col("belongs")[k]), F.lit(0.0)) for k in range(n)])
    if not n:
        return frame.withColumns({"rate": F.lit(0.0), "repeats": F.lit(0)}), wanted
    size, most = (np.array(x) for x in frame.agg(sums(F.col("tokens")).alias("a"), sums(F.col("tokens") * F.col("cap")).alias("b")).first())
    weight = np.where(size > 0, [w for _, w, _ in wanted], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        goal = weight * np.min(np.where(weight > 0, most / weight, np.inf)) if weight.any() else weight
    pull = np.zeros(n)

    def rate(y: np.ndarray) -> Column:
        along = F.lit(1.0)
        for k in range(n):
            along = along - F.col("belongs")[k] * float(y[k])
        return F.greatest(F.lit(0.0), F.least(F.col("cap"), along))

    worst: list[float] = []
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(steps + 1):
        miss = np.array(frame.agg(sums(F.col("tokens") * rate(pull)).alias("a")).first()[0]) - goal
        worst.append(float(np.abs(miss).max() / max(goal.sum(), 1.0)))
        if worst[-1] <= tolerance:
            break
        if step == steps or len(worst) > 20 and worst[-1] > 0.99 * worst[-21]:
            warnings.warn(f"mixture misses a source by {worst[-1]:.2%} of all tokens after {step} steps", stacklevel=2)
            break
        step_now = np.divide(miss, size, out=np.zeros(n), where=size > 0)
        history.append((pull, step_now))
        pull = _accelerated(history[-6:])
    rated = frame.withColumn("rate", F.round(rate(pull), 9)).withColumn("_bin", F.pmod(F.xxhash64("doc_id", F.lit("repeat")), F.lit(BINS)))
    part = F.col("rate") - F.floor("rate")
    held = rated.where("source is not null").groupBy("source", "_bin").agg(F.sum("tokens").alias("tokens"), F.max(part).alias("part")).orderBy("source", "_bin").toPandas()
    take = part * BINS
    for name, bins in held.groupby("source"):
        filled = np.concatenate([[0], bins["tokens"].to_numpy(float).cumsum()])
        nearest = int(np.argmin(np.abs(filled - bins["part"].max() * filled[-1])))
        edge = int(bins["_bin"].iloc[nearest - 1]) + 1 if nearest else 0
        take = F.when(F.col("source") == name, edge).otherwise(take)
    repeats = (F.floor("rate") + F.when(F.col("_bin") < take, 1).otherwise(0)).cast("int")
    return rated.withColumn("repeats", repeats).drop("_bin"), wanted


def _accelerated(history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The next point of a fixed-point iteration from its last points and steps: the mix of them whose step would be least (Anderson's method), or the plain step."""
    points, steps = (np.array(x) for x in zip(*history))
    plain = points[-1] + steps[-1]
    if len(history) < 2:
        return plain
    turn, bend = np.diff(points, axis=0).T, np.diff(steps, axis=0).T
    mix_of, *_ = np.linalg.lstsq(bend, steps[-1], rcond=1e-10)
    found = plain - (turn + bend) @ mix_of
    return found if np.isfinite(found).all() and np.abs(found - points[-1]).max() <= 1000 * max(np.abs(steps[-1]).max(), 1e-9) else plain


def shares(mixed: DataFrame, wanted: list[tuple[str, float, int]]) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats) of a mixture, tokens by membership and repeated ones counted again."""
    spark = mixed.sparkSession
    total = sum(w for _, w, _ in wanted)
    names = spark.createDataFrame([(k, n, w / total) for k, (n, w, _) in enumerate(wanted)], "k int, source string, target_share double")
    each = mixed.where("repeats > 0").select("source", "tokens", "repeats", F.posexplode("belongs").alias("k", "p")).where("p > 0")
    got = each.groupBy("k").agg(F.sum(F.col("tokens") * F.col("repeats") * F.col("p")).alias("tokens"), F.count_if(F.col("source").isNotNull()).alias("documents"), F.max(F.when(F.col("source").isNotNull(), F.col("repeats"))).alias("most_repeats"))
    whole = got.agg(F.sum("tokens").alias("_all"))
    table = names.join(got, "k", "left").join(F.broadcast(whole))
    return table.select("source", F.round("target_share", 6).alias("target_share"), F.round(F.coalesce(F.col("tokens"), F.lit(0.0)) / F.col("_all"), 6).alias("actual_share"), F.coalesce(F.round("tokens", 3), F.lit(0.0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), "most_repeats")
