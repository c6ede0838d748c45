"""One pass over texts in the workers: tokens with all that is known of them, structures and counts of words, without a shuffle.

Texts are cut many at a time: offsets, lines, sentences and positions are running sums over arrays, and what a token looks like is
worked out once for each different one of a part.  A long text goes through in parts, so what a worker holds has a bound."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanforge.functions.text import MARKED, PLAIN, SENTENCE_END, STEM_ENDINGS
from spanforge.runtime import ship

#: Characters that are cut at a time, and rows of a batch that leaves a worker.
CHARACTERS, ROWS = 1 << 21, 1 << 16
_PLAIN = str.maketrans(MARKED, PLAIN)
_BLANKS = re.compile("[ \t\n\x0b\f\r]")


@dataclass
class Looks:
    """Of different tokens: raw, value, how many characters the lemma lacks of it, whether it is letters alone, and whether a
    sentence ends there."""

    raw: pa.Array
    value: pa.Array
    cut: np.ndarray
    letters: pa.Array
    ends: pa.Array

    @classmethod
    def of(cls, raw: pa.Array) -> Looks:
        kept = pc.replace_substring_regex(raw, r"[^\p{L}\p{Nd}\p{Sc}']+", "")
        marked = pc.not_equal(pc.binary_length(kept), pc.utf8_length(kept))  # in ASCII there are no diacritics
        value = pc.replace_with_mask(pc.utf8_lower(kept), marked, pa.array([x.translate(_PLAIN).lower() for x in kept.filter(marked).to_pylist()], pa.string()))
        letters, length = pc.match_substring_regex(value, r"^\p{L}+$"), pc.utf8_length(value).to_numpy()
        cut = np.zeros(len(value), np.int8)
        stems = letters.to_numpy(zero_copy_only=False)
        for ending in STEM_ENDINGS:  # the longest one that leaves three letters
            cut[(cut == 0) & stems & (length >= len(ending) + 3) & pc.ends_with(value, ending).to_numpy(zero_copy_only=False)] = len(ending)
        return cls(raw, value, cut, letters, pc.match_substring_regex(raw, SENTENCE_END))

    def lemma(self) -> pa.Array:
        out = self.value
        for n in range(1, max(map(len, STEM_ENDINGS)) + 1):
            mask = pa.array(self.cut == n)
            out = pc.replace_with_mask(out, mask, pc.utf8_slice_codeunits(self.value.filter(mask), 0, -n))
        return out

    def column(self, name: str) -> pa.Array:
        if name == "other":  # raw where it is not the value
            return pc.if_else(pc.equal(self.raw, self.value), pa.scalar(None, pa.string()), self.raw)
        if name == "pos":
            return pc.if_else(pc.match_substring_regex(self.value, "^[0-9]+$"), pa.scalar("NUM"), pa.scalar(None, pa.string()))
        if name == "cut":
            return pa.array(self.cut)
        if name == "lemma":
            return self.lemma()
        if name in ("lp", "rp"):
            rest = pc.replace_substring_regex(self.raw, r"(?s)[\p{L}\p{Nd}].*" if name == "lp" else r"(?s)^.*[\p{L}\p{Nd}]", "")
            return pc.if_else(pc.equal(rest, ""), pa.scalar(None, pa.string()), rest)
        return getattr(self, name)


@dataclass
class Tokens:
    """Arrays of the tokens of some texts: the text's number, what is counted, and for each the number of a kind of token."""

    text: np.ndarray
    position: np.ndarray
    index: np.ndarray
    length: np.ndarray
    line: np.ndarray
    sentence: np.ndarray
    kind: np.ndarray
    looks: Looks


TYPES = {name: "int" for name in ("position", "index", "length", "line", "sentence")} | {name: "string" for name in ("raw", "value", "other", "pos", "lemma", "lp", "rp")} | {"cut": "tinyint", "letters": "boolean"}


def _parts(texts: Iterable[tuple[int, str]]) -> Iterator[tuple[list[tuple[int, str]], bool, bool]]:
    """Texts with their numbers, so many that they have about CHARACTERS, whether the first goes on from the part before, and whether
    a line ended between the two."""
    held: list[tuple[int, str]] = []
    size = 0
    for number, text in texts:
        if len(text) > CHARACTERS:
            if held:
                yield held, False, False
            held, size, at, goes_on, line = [], 0, 0, False, False
            while at <= len(text):
                m = _BLANKS.search(text, at + CHARACTERS)
                end = m.start() if m else len(text)
                yield [(number, text[at:end])], goes_on, line
                goes_on, line, at = True, end < len(text) and text[end] == "\n", end + 1
            continue
        held.append((number, text))
        size += len(text)
        if size >= CHARACTERS:
            yield held, False, False
            held, size = [], 0
    if held:
        yield held, False, False


def cut(texts: Iterable[str | None]) -> Iterator[Tokens]:
    """The tokens of the texts, in order, in parts."""
    carried = np.zeros(4, np.int64)  # characters, lines, sentence ends and tokens of the text so far

    def before(sums: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], sums[:-1]])

    for part, goes_on, new_line in _parts((k, t) for k, t in enumerate(texts) if t is not None):
        base = carried + (0, new_line, 0, 0) if goes_on else np.zeros(4, np.int64)
        whole = "\n".join(t for _, t in part)
        starts = np.cumsum([0, *(len(t) + 1 for _, t in part[:-1])])
        plain = whole
        for blank in "\t\n\x0b\f\r":
            plain = plain.replace(blank, " ")
        encoded = pc.split_pattern(pa.array([plain], pa.large_string()), " ").flatten().cast(pa.string()).dictionary_encode()
        looks, kind = Looks.of(encoded.dictionary), encoded.indices.to_numpy()
        lengths = pc.utf8_length(looks.raw).to_numpy().astype(np.int64)[kind]
        ends = np.cumsum(lengths + 1)
        at = ends - lengths - 1
        first = np.searchsorted(at, starts)  # of each text its first piece
        text = np.repeat(np.arange(len(part)), np.diff(np.append(first, len(at))))
        codes = np.frombuffer((whole + "\n").encode("utf-32-le"), np.uint32)
        lines = np.cumsum(codes[ends - 1] == 10)  # upto and with the blank behind a piece
        ended = np.cumsum(looks.ends.to_numpy(zero_copy_only=False)[kind])
        there = (pc.binary_length(looks.value).to_numpy() > 0)[kind]
        tokens = np.cumsum(there)
        own = np.zeros((4, len(part)), np.int64)  # what a text begins with
        own[:, 0] = base
        counts = [at, before(lines), before(ended)]
        index, line, sentence = (c - (c[first] - own[k])[text] for k, c in enumerate(counts))
        position = tokens - (before(tokens)[first] - own[3])[text]
        carried = np.array([index[-1] + lengths[-1] + 1, line[-1], (sentence + (ended - before(ended)))[-1], position[-1]])
        kept = np.flatnonzero(there)
        numbers = np.fromiter((k for k, _ in part), np.int64, len(part))
        if len(kept):
            small = [x[kept].astype(np.int32) for x in (position, index, lengths, line + 1, sentence + 1)]
            yield Tokens(numbers[text[kept]], *small, kind[kept], looks)


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, ROWS):
        yield batch.slice(k, ROWS)


def _mapped(docs: DataFrame, text_col: str, columns: Sequence[str], ddl: str, make: Callable) -> DataFrame:
    """make(batch without texts, iterator over the parts of its tokens) gives batches."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = (batch.column(text_col).slice(k, 1 << 8).to_pylist() for k in range(0, batch.num_rows, 1 << 8))
            yield from make(batch.select(list(columns)), cut(chain.from_iterable(slices)))

    return docs.select(*columns, text_col).mapInArrow(run, ddl)


def _ddl(docs: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]


def tokens(docs: DataFrame, id_col: str, text_col: str, carried: Sequence[str], names: Sequence[str]) -> DataFrame:
    """A row for each token: id, carried columns and what is asked for of TYPES; in order of the texts and of their tokens."""
    columns = [id_col, *carried]

    def make(rest: pa.RecordBatch, parts: Iterator[Tokens]) -> Iterator[pa.RecordBatch]:
        for t in parts:
            of_kind = {n: t.looks.column(n) for n in names if not hasattr(t, n)}
            for k in range(0, len(t.text), ROWS):
                at = slice(k, k + ROWS)
                of_text, kind = rest.take(pa.array(t.text[at])), pa.array(t.kind[at])
                yield pa.RecordBatch.from_arrays([*of_text.columns, *(of_kind[n].take(kind) if n in of_kind else pa.array(getattr(t, n)[at]) for n in names)], [*columns, *names])

    return _mapped(docs, text_col, columns, ", ".join([*_ddl(docs, columns), *(f"`{n}` {TYPES[n]}" for n in names)]), make)


def structures(docs: DataFrame, id_col: str, text_col: str, carried: Sequence[str], by: str) -> DataFrame:
    """A row for each line or sentence that has tokens: id, carried columns, p1, p2, index and end (of its characters)."""
    columns = [id_col, *carried]
    own = ["p1", "p2", "index", "end"]

    def make(rest: pa.RecordBatch, parts: Iterator[Tokens]) -> Iterator[pa.RecordBatch]:
        def batch(rows: np.ndarray) -> pa.RecordBatch:
            of_text = rest.take(pa.array(rows[0]))
            return pa.RecordBatch.from_arrays([*of_text.columns, *(pa.array(x.astype(np.int32)) for x in rows[2:])], [*columns, *own])

        held = np.zeros((6, 0), np.int64)  # text, line or sentence, p1, p2, index, end of the last one, which may go on
        for t in parts:
            number = getattr(t, by)
            first = np.flatnonzero(np.concatenate([[True], (np.diff(t.text) != 0) | (np.diff(number) != 0)]))
            last = np.concatenate([first[1:], [len(number)]]) - 1
            rows = np.stack([t.text[first], number[first], t.position[first], t.position[last], t.index[first], t.index[last] + t.length[last]]).astype(np.int64)
            if held.shape[1] and (held[:2, 0] == rows[:2, 0]).all():
                rows[[2, 4], 0] = held[[2, 4], 0]
            else:
                rows = np.concatenate([held, rows], 1)
            held = rows[:, -1:]
            if rows.shape[1] > 1:
                yield from _sliced(batch(rows[:, :-1]))
        if held.shape[1]:
            yield batch(held)

    return _mapped(docs, text_col, columns, ", ".join([*_ddl(docs, columns), *(f"`{n}` int" for n in own)]), make)


def pages(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(document_id, page, low, high, p1, p2, indexes): the tokens that begin on a page of so many characters, least and greatest of
    their indexes and positions, and the indexes; their positions are numbers that follow each other."""

    def make(rest: pa.RecordBatch, parts: Iterator[Tokens]) -> Iterator[pa.RecordBatch]:
        for t in parts:
            page = t.index // size
            first = np.flatnonzero(np.concatenate([[True], (np.diff(t.text) != 0) | (np.diff(page) != 0)]))
            offsets = np.append(first, len(page)).astype(np.int32)
            last = offsets[1:] - 1
            of_text = rest.take(pa.array(t.text[first]))
            arrays = [pa.array(page[first].astype(np.int64)), *(pa.array(x) for x in (t.index[first], t.index[last], t.position[first], t.position[last])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(t.index))]
            yield from _sliced(pa.RecordBatch.from_arrays([*of_text.columns, *arrays], [id_col, "page", "low", "high", "p1", "p2", "indexes"]))

    return _mapped(docs, text_col, [id_col], ", ".join([*_ddl(docs, [id_col]), "page bigint, low int, high int, p1 int, p2 int, indexes array<int>"]), make)


def words(docs: DataFrame, text_col: str, by: Sequence[str]) -> DataFrame:
    """(columns of by, value, pos, lemma, n): the tokens that are letters alone, counted by these columns of their documents; several
    rows of the same are to be summed up."""

    def make(rest: pa.RecordBatch, parts: Iterator[Tokens]) -> Iterator[pa.RecordBatch]:
        keys: dict[tuple, int] = {}  # of each document the first of its group
        group = np.fromiter((keys.setdefault(key, k) for k, key in enumerate(zip(*(c.to_pylist() for c in rest.columns)))), np.int64, rest.num_rows)
        for t in parts:
            encoded = t.looks.value.dictionary_encode()
            word, n_words = encoded.indices.to_numpy(), len(encoded.dictionary)
            lemma = t.looks.lemma().take(pa.array(np.unique(word, return_index=True)[1]))
            kept = t.looks.letters.to_numpy(zero_copy_only=False)[t.kind]
            both, n = np.unique(group[t.text[kept]] * n_words + word[t.kind[kept]], return_counts=True)
            if len(both):
                of_text, number = rest.take(pa.array(both // n_words)), pa.array(both % n_words)
                arrays = [encoded.dictionary.take(number), pa.nulls(len(both), pa.string()), lemma.take(number), pa.array(n.astype(np.int64))]
                yield from _sliced(pa.RecordBatch.from_arrays([*of_text.columns, *arrays], [*by, "value", "pos", "lemma", "n"]))

    return _mapped(docs, text_col, list(by), ", ".join([*_ddl(docs, by), "value string", "pos string", "lemma string", "n bigint"]), make)
