"""Problem 9: per-document text quality statistics, and telling natural prose from the rest.

A text is cut into units (lines, and sentences within lines). The function words of
several languages stand for themselves and every other token for its character class; a
unit and its neighbours give a distribution of the transitions between these. It is
compared with structural profiles (prose as a whole and of each language, list, table, junk; made of
labelled documents) through the Jensen-Shannon divergence, and the unit is assigned the nearest.
The tokens of a unit that its text repeats are of a class of their own, so that repetition is part of a profile.
The divergence is weighted by sizes (a unit is small, a profile large) and taken for
each token's successors; with equal weights it misplaces several times as many short units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from columnscout.llm.byte_bpe import _blocks
from columnscout.llm.shapes import IDS, SIZE, WORDS, Shapes, shapes

KINDS = ["prose", "list", "table", "junk"]
#: Profiles are fitted on at most so many labelled documents.
LABELLED = 20_000
#: A language has a prose profile of its own from so many labelled documents on.
LEAST_OF_LANGUAGE = 20
#: What a profile weighs against a unit, in transitions out of a token.
PROFILE_WEIGHT = 10_000.0
#: A unit's distribution takes in its neighbours on either side with these weights.
NEIGHBOURS = {0: 1.0, 1: 0.5, 2: 0.25}
#: The prior weight, in transitions, of repetition in the junk profile, for labels that have no example of it.
REPETITION = 5
#: Divergences are computed for so many transitions at a time.
SLICE = 300_000
#: Texts are measured in blocks of about so many bytes.
BLOCK = 1 << 20


class Profiles:
    """Successor distributions of the structural profiles: q[transition, profile], smoothed by each profile's own token shares.

    Profiles are named by their kind, those of prose in a language by `prose` and the language.
    """

    def __init__(self, counts: dict[str, dict[int, float]]):
        self.counts = counts
        self.names = sorted((k for k in counts if counts[k]), key=lambda k: (KINDS.index(k.split(" ")[0]), k))
        self.kind = np.array([KINDS.index(k.split(" ")[0]) for k in self.names], np.int64)
        table = np.zeros((SIZE, SIZE, len(self.names)))
        for i, k in enumerate(self.names):
            at = np.fromiter(counts[k].keys(), np.int64)
            table[at // SIZE, at % SIZE, i] = np.fromiter(counts[k].values(), np.float64)
        share = (table.sum(axis=0) + 0.5) / (table.sum(axis=(0, 1)) + 0.5 * SIZE)
        self.q = ((table + 5 * share[None]) / (table.sum(axis=1, keepdims=True) + 5)).reshape(SIZE * SIZE, len(self.names)).T.astype(np.float32)
        self.log_q = np.log(self.q)

    def __reduce__(self):
        return Profiles, (self.counts,)  # the counts are far smaller than the tables

    def divergences(self, window: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Size-weighted Jensen-Shannon divergence (nats a transition) of each window from each profile.

        `weight` is in quarters. With c of a window's na transitions out of a token, a profile's weight b and
        r = c / (b q), the divergence of the two is the sum of c (ln(c / na) + ln((na + b) / b) - ln q) - (c + b q) ln(1 + r).
        """
        key = np.sort((window << 24) | (code << 3) | weight)  # 2 ** 21 transitions, windows in the bits above
        name = key >> 3
        new = np.flatnonzero(np.diff(name, prepend=-1))
        c = np.add.reduceat((key & 7).astype(np.float64), new) / 4
        name = name[new]
        w, code = name >> 21, name & ((1 << 21) - 1)
        context = (w << 21) | (code // SIZE)
        first = np.flatnonzero(np.diff(context, prepend=-1))
        held, big = np.add.reduceat(c, first), PROFILE_WEIGHT
        na = np.repeat(held, np.diff(np.append(first, len(c))))
        own = c * (np.log(c / na) + np.log((na + big) / big))
        out = np.empty((len(self.names), n))
        for i in range(len(self.names)):
            bq = big * self.q[i][code].astype(np.float64)
            out[i] = np.bincount(w, weights=own - c * self.log_q[i][code] - (c + bq) * np.log(1 + c / bq), minlength=n)
        # the rest of the profile's transitions out of the window's tokens
        rest = np.bincount(w[first], weights=big * np.log((held + big) / big), minlength=n)
        total = np.bincount(w, weights=c, minlength=n)
        return (out + rest) / np.maximum(total, 1e-9)


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of units with about SLICE transitions each."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
        yield a, min(b, n)
        a = b


def _unit_divergences(profiles: Profiles, text: np.ndarray, code: np.ndarray, ends: np.ndarray, a: int, b: int) -> np.ndarray:
    """Divergences of the units a to b - 1, each with its neighbours of the same text."""
    reach = max(NEIGHBOURS)
    first, last = max(0, a - reach), min(len(text), b + reach)
    unit, own = np.repeat(np.arange(first, last), np.diff(ends[first : last + 1])), code[ends[first] : ends[last]]
    windows, codes, weights = [], [], []
    for distance, weight in NEIGHBOURS.items():
        for shift in {distance, -distance}:
            target = unit + shift
            fine = (target >= a) & (target < b)
            fine[fine] = text[target[fine]] == text[unit[fine]]
            windows.append(target[fine] - a)
            codes.append(own[fine])
            weights.append(np.full(int(fine.sum()), int(weight * 4), np.int64))
    return profiles.divergences(np.concatenate(windows), np.concatenate(codes), np.concatenate(weights), b - a)


def _measure(profiles: Profiles, texts: list[str | None]) -> list[tuple]:
    """(share of running sentences, nearest kind, its share, mean divergence from prose) of each text; nulls for blank ones."""
    out: list[tuple] = [(None, None, None, None)] * len(texts)
    held = [i for i, t in enumerate(texts) if t is not None and t.strip()]
    if not held or 0 not in profiles.kind:
        return out
    s: Shapes = shapes([texts[i] for i in held])
    n, code = len(held), s.codes()
    ends = np.searchsorted(s.unit, np.arange(len(s.text) + 1))
    d = np.concatenate([_unit_divergences(profiles, s.text, code, ends, a, b) for a, b in _slices(ends)], axis=1)
    nearest = profiles.kind[d.argmin(axis=0)]
    far = np.where((profiles.kind == 0)[:, None], d, np.inf).min(axis=0)
    total = np.maximum(np.bincount(s.text, weights=s.length, minlength=n), 1)
    shares = np.stack([np.bincount(s.text, weights=s.length * (nearest == k), minlength=n) for k in range(len(KINDS))], axis=1) / total[:, None]
    top, mean = shares.argmax(axis=1), np.bincount(s.text, weights=s.length * far, minlength=n) / total
    for j, i in enumerate(held):
        out[i] = (float(shares[j, 0]), KINDS[top[j]], float(shares[j, top[j]]), float(mean[j]))
    return out


def fit_profiles(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, most: int = LABELLED) -> Profiles:
    """Profiles of the labelled documents: of each document the kind that most reviewers gave; documents without such a kind don't count.

    With `lang_col` each language that enough documents labelled prose have, after trimming and
    lower-casing, has a profile of its own beside that of all prose. At most `most` labelled documents are used, those first in a hash
    order of the id. What reaches the driver is one number for each transition and profile that occurs.
    """
    votes = labels.where(F.col("kind").isin(KINDS) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"), "kind").agg(F.count("*").alias("n"))
    best = votes.groupBy("id").agg(F.max(F.struct("n", "kind")).alias("m"), F.collect_list("n").alias("all"))  # at most one row a kind
    agreed = best.where(F.size(F.filter("all", lambda n: n == F.col("m.n"))) == 1).select("id", F.col("m.kind").alias("kind"))
    used = agreed.orderBy(F.xxhash64("id"), "id").limit(most)
    lang = F.lower(F.trim(F.col(lang_col).cast("string"))) if lang_col else F.lit(None).cast("string")
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang")).where("text is not null").join(F.broadcast(used), "id")
    texts = texts.select("kind", "text", F.when((F.col("kind") == "prose") & (F.col("lang") != ""), F.col("lang")).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _blocks(whole, 1, BLOCK):
                kinds = np.array([k if lang is None else f"{k} {lang}" for k, lang in zip(b.column(0).to_pylist(), b.column(2).to_pylist())])
                names, at = np.unique(kinds, return_inverse=True)
                s = shapes(b.column(1).to_pylist())
                key, n = np.unique((at[s.text[s.unit]] << 21) | s.codes(), return_counts=True)
                docs = np.bincount(at, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((names[key >> 21], names)).tolist(), pa.string()), pa.array(np.concatenate((key & ((1 << 21) - 1), np.full(len(names), -1)))), pa.array(np.concatenate((n, docs)))], ["profile", "code", "n"])

    rows = texts.mapInArrow(count, "profile string, code long, n long").groupBy("profile", "code").agg(F.sum("n").alias("n")).collect()
    return Profiles(_by_profile([(r["profile"], r["code"], r["n"]) for r in rows]))


def _by_profile(rows: list[tuple[str, int, int]]) -> dict[str, dict[int, float]]:
    """Counts of each profile; those of a language count for prose as a whole too. Code -1 has the number of documents.

    Before any label repetition is junk: that profile starts with REPETITION transitions into a repeated unit.
    """
    counts: dict[str, dict[int, float]] = {"junk": {IDS["start"] * SIZE + IDS["again"]: REPETITION, -1: 1}}
    for name, code, n in rows:
        for k in {name, name.split(" ")[0]}:
            held = counts.setdefault(k, {})
            held[code] = held.get(code, 0) + n
    return {k: c for k, held in counts.items() if held.get(-1, 0) >= (LEAST_OF_LANGUAGE if " " in k else 1) and (c := {t: n for t, n in held.items() if t >= 0})}


def structure(documents: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, running_share, kind, kind_share, prose_divergence) of every row, over the whole text.

    running_share: share of the characters in units nearest to a prose profile; kind: the kind
    with most characters; prose_divergence: the mean one from the nearest prose profile. All four are null for null,
    empty and blank texts, and if no document was labelled prose. No shuffle.
    """
    known = documents.sparkSession.sparkContext.broadcast(profiles)  # as many numbers as transitions and profiles
    id_type = documents.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _blocks(whole, 1, BLOCK):
                found = list(zip(*_measure(known.value, b.column(1).to_pylist()))) or [(), (), (), ()]
                types = (pa.float64(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(found, types))], ["id", "running_share", "kind", "kind_share", "prose_divergence"])

    read = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(measure, f"id {id_type}, running_share double, kind string, kind_share double, prose_divergence double").withColumnRenamed("id", id_col)


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_characters, n_words, mean_word_length, symbol_ratio, n_lines, ended_lines, common_words) of every row.

    Words are runs without space, tab or line end. symbol_ratio: ASCII symbols other than
    sentence punctuation among all characters; ended_lines: share of the lines that
    aren't blank and end in . ! ? or a colon, after trimming; common_words: share of words
    that are function words of a listed language. Counts are 0, and ratios null, for
    null and empty texts. Built-in functions only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit("[^ \\t\\r\\n]+"), F.lit(0))
    lines = F.filter(F.transform(F.split(text, "[\\r\\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    out = documents.select(F.col(id_col), F.length(text).alias("n_characters"), words.alias("w"), lines.alias("l"), F.length(F.regexp_replace(text, "[^#$%&*+/<=>@^_`{|}~\\\\]", "")).alias("s"))
    n, m = F.size("w"), F.size("l")

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.round(part / whole, 6))

    length = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))
    return out.select(
        F.col(id_col), "n_characters", n.alias("n_words"), ratio(length, n).alias("mean_word_length"), ratio(F.col("s"), F.col("n_characters")).alias("symbol_ratio"), m.alias("n_lines"),
        ratio(F.size(F.filter("l", lambda x: F.substring(x, -1, 1).isin(".", "!", "?", ":"))), m).alias("ended_lines"),
        ratio(F.size(F.filter("w", lambda x: F.lower(x).isin(*WORDS))), n).alias("common_words"))
