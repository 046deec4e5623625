"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a labelled sample tells how far a text can be
read on as a substring of that sample. Reading a text greedily in longest matches cuts
it into phrases; the language whose sample needs the fewest phrases describes the text best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from evidentia.llm.common import map_batches, prepare

#: The sample of a language: so many texts, at most so many characters of each, so many in all.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_TOTAL = 200, 400, 60_000
#: A phrase ends where a segment of a text ends; segments of equal length are parsed side by side.
SEGMENT = 1024
#: Letters, the most frequent ones, whose transitions are a dense table; those of all others are hashed.
DENSE = 250


def normalised(text: str) -> str:
    """Lower case; runs of anything but letters are one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: np.ndarray, alphabet: int) -> np.ndarray:
    """The transitions of the minimal automaton of all substrings, ``[state, code]``, -1 where there is none.

    The last row is a state without transitions.
    """
    return _dense(_transitions(codes), alphabet)


def _transitions(codes: np.ndarray) -> list[dict[int, int]]:
    """The transitions of each state."""
    size = 2 * len(codes) + 2
    link, length = [-1] * size, [0] * size
    rows = [dict() for _ in range(size)]
    last, used = 0, 1
    for c in codes.tolist():
        new, used = used, used + 1
        length[new] = length[last] + 1
        p = last
        while p != -1 and c not in rows[p]:
            rows[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = rows[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy, used = used, used + 1
                rows[copy], link[copy], length[copy] = dict(rows[q]), link[q], length[p] + 1
                while p != -1 and rows[p].get(c) == q:
                    rows[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return rows[:used]


def _dense(rows: list[dict[int, int]], alphabet: int) -> np.ndarray:
    """The transitions on codes below ``alphabet``."""
    step = np.full((len(rows) + 1, alphabet), -1, dtype=np.int32)
    for state, row in enumerate(rows):
        for c, to in row.items():
            if c < alphabet:
                step[state, c] = to
    return step


class Hashed:
    """Transitions on codes from ``alphabet`` on, by open addressing with linear probing."""

    def __init__(self, rows: list[dict[int, int]], alphabet: int):
        found = [(state << 32 | c, to) for state, row in enumerate(rows) for c, to in row.items() if c >= alphabet]
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        if not found:
            return
        keys, to = np.array([k for k, _ in found], dtype=np.int64), np.array([t for _, t in found], dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            free = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[free]], self.to[slots[free]] = keys[free], to[free]
            left = np.ones(len(keys), dtype=bool)
            left[free] = False
            keys, to, slots = keys[left], to[left], (slots[left] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where each state goes on its code, -1 where nowhere."""
        keys = states.astype(np.int64) << 32 | codes
        out, at, slots = np.full(len(keys), -1, dtype=np.int32), np.arange(len(keys)), self._slots(keys)
        while len(at):
            there = self.keys[slots]
            same = there == keys[at]
            out[at[same]] = self.to[slots[same]]
            on = ~same & (there >= 0)
            at, slots = at[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out


@dataclass
class Model:
    """One automaton per language over a common alphabet: dense ``steps`` on its first codes, ``rare`` ones on the others."""

    languages: list[str]
    letters: str
    steps: list[np.ndarray]
    rare: list[Hashed] = field(default_factory=list)

    def __post_init__(self):
        self._code = np.zeros(0x110000, dtype=np.uint16 if len(self.letters) < 1 << 16 else np.int32)  # 0: a character that no sample has
        for k, letter in enumerate(self.letters):
            self._code[ord(letter)] = k + 1

    def __reduce__(self):
        return Model, (self.languages, self.letters, self.steps, self.rare)

    def encode(self, text: str) -> np.ndarray:
        return self._code[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """``[text, language]``: the phrases that each normalised text is cut into."""
        coded = [self.encode(t) for t in texts]
        owners, segments = [], []
        for k, codes in enumerate(coded):
            for low in range(0, len(codes), SEGMENT):
                owners.append(k)
                segments.append(codes[low : low + SEGMENT])
        counts = np.zeros((len(texts), len(self.languages)))
        if not segments:
            return counts
        order = np.argsort([-len(s) for s in segments], kind="stable")
        width = np.array([len(segments[k]) for k in order])
        table = np.zeros((width[0], len(order)), dtype=self._code.dtype)
        for column, k in enumerate(order):
            table[: width[column], column] = segments[k]
        alive = np.searchsorted(-width, -np.arange(width[0]), side="left")  # segments longer than each place
        owner = np.array(owners)[order]
        for language, step in enumerate(self.steps):
            cuts = _greedy(step, self.rare[language] if self.rare else None, len(self.letters) + 1, table, alive)
            counts[:, language] = np.bincount(owner, weights=cuts, minlength=len(texts))
        return counts


def _greedy(step: np.ndarray, rare: Hashed | None, letters: int, table: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The phrases of every column of ``table``: a phrase ends where the automaton cannot read on."""
    flat, alphabet = step.reshape(-1), step.shape[1]
    dead = len(step) - 1  # the state behind a character that no sample has, and before the first one
    state = np.full(table.shape[1], dead, dtype=np.int32)
    cuts = np.zeros(table.shape[1], dtype=np.int32)
    root = flat[:alphabet]
    if letters > alphabet:
        more = np.arange(alphabet, letters)
        root = np.concatenate((root, rare.find(np.zeros(len(more), dtype=np.int32), more)))
    root = np.where(root < 0, dead, root)
    mixed = (table >= alphabet).any(axis=1)
    for place in range(table.shape[0]):
        n = alive[place]
        codes = table[place, :n]
        if mixed[place]:
            to = flat[state[:n] * alphabet + np.where(codes < alphabet, codes, 0)]
            other = np.flatnonzero(codes >= alphabet)
            to[other] = rare.find(state[other], codes[other])
        else:
            to = flat[state[:n] * alphabet + codes]
        stuck = to < 0
        cuts[:n] += stuck
        state[:n] = np.where(stuck, root[codes], to)
    return cuts


def learn(
    docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL, text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """The model of all languages in ``docs``, from a bounded sample of texts that have a language and a letter.

    The sample of a language are its ``texts`` different texts smallest by hash, ``chars`` characters of
    each, ``total`` at most: a pseudo-random choice that does not depend on order, partitions or copies.
    """
    prepare(docs.sparkSession)
    labelled = docs.select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("_order"),
    ).filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    smallest = Window.partitionBy("lang").orderBy("_order")
    places = labelled.select("lang", "_order").distinct().withColumn("_n", F.row_number().over(smallest))
    places = places.filter(F.col("_n") <= texts)
    heads = labelled.withColumn("text", F.substring("text", 1, 4 * chars)).join(F.broadcast(places), ["lang", "_order"])
    rows = heads.groupBy("lang", "_n").agg(F.first("text").alias("text")).orderBy("lang", "_n").collect()
    samples: dict[str, list[str]] = {}
    for row in rows:
        samples.setdefault(row["lang"], []).append(normalised(row["text"])[:chars])
    languages = sorted(samples)
    joined = [" ".join(s for s in samples[x] if s)[:total] for x in languages]
    counts: dict[str, int] = {}
    for letter in "".join(joined):
        counts[letter] = counts.get(letter, 0) + 1
    order = sorted(counts, key=lambda x: (-counts[x], x))
    dense = sorted(order[:DENSE])
    model = Model(languages, "".join(dense + order[DENSE:]), [])
    for text in joined:
        transitions = _transitions(model.encode(text))
        model.steps.append(_dense(transitions, len(dense) + 1))
        model.rare.append(Hashed(transitions, len(dense) + 1))
    return model


ADDED = ("lang_pred", "lang_score", "phrase_length")


def predict(docs: DataFrame, model: Model, text_col: str = "text", added: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``phrase_length`` (or other names ``added``) of every whole text.

    Texts are lower-cased and reduced to letters and single blanks. The language needing the fewest
    phrases wins (the alphabetically first one on a tie). ``lang_score`` is its share of
    the weight 2 ** -(bits to write the phrases) among all languages, from 0 to 1;
    ``phrase_length`` is the mean match length in characters. Null texts and texts without a letter are
    ``und`` with score 0, and so are all texts if there is nothing to learn from.
    """
    prepare(docs.sparkSession)
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in added}:
        raise ValueError(f"columns already there: {sorted(clash)}")
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, scores, lengths = _classify(held.value, batch.column(batch.schema.get_field_index(text_col)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64()), pa.array(lengths, type=pa.float64())],
            names=[*batch.schema.names, *added],
        )

    return map_batches(docs, run, ", ".join([*rest, f"`{added[0]}` string, `{added[1]}` double, `{added[2]}` double"]))


def _classify(model: Model, column: pa.Array) -> tuple[list[str], list[float], list[float]]:
    blank = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), r"[^\pL]+", " "))
    texts = blank.to_pylist()
    names, scores, lengths = [], [], []
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    for text, counts in zip(texts, model.phrases(texts)):
        if not text:
            names.append("und")
            scores.append(0.0)
            lengths.append(0.0)
            continue
        best = int(counts.argmin())
        bits = (counts - counts[best]) * math.log2(SAMPLE_TOTAL)
        names.append(model.languages[best])
        scores.append(float(1.0 / np.exp2(-np.minimum(bits, 1000)).sum()))
        lengths.append(float(len(text) / counts[best]))
    return names, scores, lengths
