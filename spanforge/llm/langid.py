"""Language identification of mixed-language text: scripts narrow the candidates, Viterbi labels the words.

A word's script (by the code range of its first letter) leaves as candidates the languages that are written in it: those of the
labelled documents, or a common language of the script where no labelled document uses it.  Each candidate scores the
word by its byte trigrams, whose counts by language are taken over all documents in Spark.  The best path through a
document changes the language at a cost of `PENALTY`, so that a few words of another language make a span of their own, but
a single doubtful word doesn't.

Defined cases: words of digits fit any language and score nothing; a document without words (null and empty texts,
punctuation), or with no evidence at all, is one span 'und'; null ids are labelled too; documents of null language don't
take part in the counts; between equally good paths the one that stays, then the language first in the alphabet, is taken;
rows that repeat give the same spans; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import ship
from spanforge.llm.textkernel import Block, blocks

PENALTY = 10.0
UNKNOWN = "und"
_BUCKETS = 1 << 16
_NEVER = np.float32(-1e6)
#: Scripts by number, and the language of a script that no labelled document uses.
SCRIPTS = ("common", "latin", "greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai", "kana", "han", "hangul", "other")
DEFAULTS = ("", "", "el", "ru", "he", "ar", "hi", "th", "ja", "zh", "ko", "")
#: Words whose scores are held at once.
GROUP_WORDS = 1 << 21


def word_scripts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of the script of each word, from its first bytes."""
    b0 = data[starts]
    long = ends - starts > 1
    b1 = np.where(long, data[np.minimum(starts + 1, len(data) - 1)], 0)
    script = np.full(len(starts), SCRIPTS.index("other"), np.int8)
    for name, where in (
        ("latin", (b0 < 0x80) | ((b0 >= 0xC3) & (b0 <= 0xC9)) | ((b0 == 0xE1) & (b1 >= 0xB8))),
        ("greek", (b0 == 0xCE) | (b0 == 0xCF) | (b0 == 0xCD)),
        ("cyrillic", (b0 >= 0xD0) & (b0 <= 0xD3)),
        ("hebrew", (b0 == 0xD7) | ((b0 == 0xD6) & (b1 >= 0x90))),
        ("arabic", (b0 >= 0xD8) & (b0 <= 0xDB)),
        ("devanagari", (b0 == 0xE0) & ((b1 == 0xA4) | (b1 == 0xA5))),
        ("thai", (b0 == 0xE0) & ((b1 == 0xB8) | (b1 == 0xB9))),
        ("kana", (b0 == 0xE3) & (b1 >= 0x81) & (b1 <= 0x83)),
        ("han", ((b0 == 0xE3) & (b1 >= 0x90)) | ((b0 >= 0xE4) & (b0 <= 0xE9))),
        ("hangul", (b0 >= 0xEA) & (b0 <= 0xED) & ~((b0 == 0xEA) & (b1 < 0xB0))),
        ("common", (b0 >= 48) & (b0 <= 57)),
    ):
        script[where] = SCRIPTS.index(name)
    return script


def trigram_buckets(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte the bucket of the trigram around it; bytes outside words count as blanks."""
    b = block.data
    edge = np.zeros(len(b) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    x = np.where(inside, b, 32).astype(np.uint32)
    left, right = np.full(len(b), 32, np.uint32), np.full(len(b), 32, np.uint32)
    left[1:], right[:-1] = x[:-1], x[1:]
    # a word that touches the one before it (scripts without blanks) still begins after a blank
    left[starts] = 32
    right[ends - 1] = 32
    return ((left | x << np.uint32(8) | right << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class LanguageModel:
    """languages in order of the alphabet; scores: of each trigram bucket for each language, centred, so no evidence is 0;
    allowed: for each script which languages are candidates."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray

    def word_scores(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words x languages) and the document of each word."""
        starts, ends, docs = block.words()
        bucket = trigram_buckets(block, starts, ends)
        script = word_scripts(block.data, starts, ends) if len(starts) else np.zeros(0, np.int8)
        out = np.zeros((len(starts), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            total = np.zeros(len(bucket) + 1)
            np.cumsum(self.scores[k][bucket], dtype=np.float64, out=total[1:])
            out[:, k] = total[ends] - total[starts]
        out[script == 0] = 0
        out[~self.allowed[script]] += _NEVER
        return out, docs


def fit(docs: DataFrame) -> LanguageModel:
    """Trigram and script counts by language over all labelled documents."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for block in blocks(batch.column(0)):
                starts, ends, doc = block.words()
                if not len(starts):
                    continue
                bucket = trigram_buckets(block, starts, ends)
                script = word_scripts(block.data, starts, ends)
                sizes = ends - starts
                at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                letter = np.repeat(script != 0, sizes)
                own = langs[block.first : block.last]
                names, number = np.unique(own.astype(str), return_inverse=True)
                of_word = number.ravel()[doc]
                of_byte = np.repeat(of_word, sizes)
                for k, name in enumerate(names):
                    total = seen.setdefault(name, np.zeros(_BUCKETS + len(SCRIPTS), np.int64))
                    total[:_BUCKETS] += np.bincount(bucket[at[(of_byte == k) & letter]], minlength=_BUCKETS)
                    total[_BUCKETS:] += np.bincount(script[of_word == k], minlength=len(SCRIPTS))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], ["lang", "counts"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    labelled = docs.filter("lang is not null and lang <> ''").select("text", "lang")
    ddl = "lang string, counts binary"
    rows = labelled.mapInArrow(count, ddl).groupBy("lang").applyInArrow(add, ddl).collect()
    counts = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    counts = {k: v for k, v in counts.items() if v[:_BUCKETS].sum()}
    trained = sorted(counts)
    names = sorted({*trained, *(d for d in DEFAULTS if d), UNKNOWN})
    scores = np.zeros((len(names), _BUCKETS), np.float32)
    if trained:
        log = np.stack([np.log(counts[k][:_BUCKETS] + 0.5) - np.log(counts[k][:_BUCKETS].sum() + 0.5 * _BUCKETS) for k in trained])
        scores[[names.index(k) for k in trained]] = log - log.mean(axis=0)
    allowed = np.zeros((len(SCRIPTS), len(names)), bool)
    allowed[0] = True
    for s in range(1, len(SCRIPTS)):
        users = [k for k in trained if counts[k][_BUCKETS + s] >= 0.1 * counts[k][_BUCKETS + 1 :].sum()]
        allowed[s, [names.index(k) for k in users or [DEFAULTS[s] or UNKNOWN]]] = True
    return LanguageModel(names, scores, allowed)


def viterbi(scores: np.ndarray, begin: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word.  Documents are runs of rows of scores; all of them advance a word at a time."""
    n, k = scores.shape
    number = np.int8 if k <= 128 else np.int16 if k <= 1 << 15 else np.int32
    state = np.zeros(n, number)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    active = int((lengths > 0).sum())
    begin, lengths = begin[:active], lengths[:active]
    if not active:
        return state
    longest = int(lengths[0])
    # how many documents have a word at each position
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
    stay = np.full((n, k), -1, number)
    value = scores[begin].astype(np.float64)
    final = np.zeros(active, np.int64)
    for t in range(1, longest):
        m = alive[t]
        if m < len(value):
            final[m : len(value)] = value[m:].argmax(axis=1)
            value = value[:m]
        best = value.argmax(axis=1)
        moved = value[np.arange(m), best] - penalty
        switch = moved[:, None] > value
        rows = begin[:m] + t
        if switch.any():
            stay[rows] = np.where(switch, best[:, None].astype(number), number(-1))
            value = np.maximum(value, moved[:, None])
        value = value + scores[rows]
    final[: len(value)] = value.argmax(axis=1)
    current = final
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        rows = begin[:m] + t
        now = current[:m]
        state[rows] = now
        if t:
            back = stay[rows, now]
            current[:m] = np.where(back >= 0, back, now)
    return state


_SPANS = pa.schema([("doc_id", pa.int64()), ("span", pa.int32()), ("lang", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32())])


def spans_of(scores: np.ndarray, docs: np.ndarray, n_docs: int, languages: list[str], penalty: float) -> tuple[np.ndarray, ...]:
    """Document, language number, first and last word (from 1) of all spans; documents without evidence have language -1."""
    lengths = np.bincount(docs, minlength=n_docs)
    begin = np.cumsum(lengths) - lengths
    used = np.flatnonzero((scores > _NEVER / 2).any(axis=0)) if len(scores) else np.zeros(0, int)
    state = used[viterbi(np.ascontiguousarray(scores[:, used]), begin, lengths, penalty)] if len(used) else np.zeros(0, int)
    known = np.bincount(docs, (scores != 0).any(axis=1), n_docs) > 0
    first = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (state[1:] != state[:-1])) & known[docs]) if len(docs) else np.zeros(0, int)
    doc = docs[first]
    last = np.append(first[1:], len(docs)) if len(first) else first
    last = np.minimum(last, begin[doc] + lengths[doc])
    lost = np.flatnonzero(~known)
    d = np.concatenate([doc, lost])
    lang = np.concatenate([state[first], np.full(len(lost), -1)])
    a = np.concatenate([first - begin[doc] + 1, np.minimum(lengths[lost], 1)])
    z = np.concatenate([last - begin[doc], lengths[lost]])
    order = np.lexsort((a, d))
    return d[order], lang[order], a[order], z[order]


def identify_languages(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """A row for each span: doc_id, span (from 1), lang, first_word and last_word (from 1; both 0 where there are no words)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs))  # a fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.languages, UNKNOWN], object)

        def flush(ids: np.ndarray, parts: list) -> pa.RecordBatch:
            scores = np.concatenate([p[0] for p in parts])
            docs_ = np.concatenate([p[1] for p in parts])
            d, lang, a, z = spans_of(scores, docs_, len(ids), m.languages, penalty)
            new = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, int)
            number = np.arange(len(d)) - np.repeat(new, np.diff(np.append(new, len(d)))) + 1
            columns = [ids.take(pa.array(d)), number, names[lang], a, z]
            return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, _SPANS.types)], schema=_SPANS)

        for batch in batches:
            ids, parts, words, low = batch.column(0), [], 0, 0
            for block in blocks(batch.column(1)):
                scores, docs_ = m.word_scores(block)
                parts.append((scores, docs_ + block.first - low))
                words += len(scores)
                if words >= GROUP_WORDS:
                    yield flush(ids.slice(low, block.last - low), parts)
                    parts, words, low = [], 0, block.last
            if parts:
                yield flush(ids.slice(low), parts)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, span int, lang string, first_word int, last_word int")


def brute_force(scores: np.ndarray, penalty: float) -> float:
    """The value of the best path through one document, by the plain recursion, for tests."""
    value = scores[0].astype(float)
    for row in scores[1:]:
        value = np.array([max(value[k], value.max() - penalty) for k in range(len(value))]) + row
    return float(value.max())
