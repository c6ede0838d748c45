"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Voters.  A lexicon voter fires on a word or on words that begin with some bytes, either on one such word or only where they are
   dense (`DENSE`), as beginnings that are mere chance in a long text aren't.  Besides a seed lexicon, voters are found for each
   language among a bounded sample of labelled rows (`MAX_LABELLED`, `MAX_TEXT`): what toxic rows have far more often than clean
   ones, none of them nearly the same as one taken before, and at most `VOTERS` a language.  Pattern voters fire on a second person
   shortly before a word of the seed lexicon, and on runs of exclamation marks.
2. Label model.  The votes on all documents are counted in Spark by language and combination.  For each language, EM fits a latent
   class whose voters depend on each other: in each class a voter fires with a rate (its accuracy) given whether the one that it
   depends on has fired, and which it depends on is the tree of the strongest correlations within the classes (those that are no
   chance).  Rates, correlations and the tree are estimated together in each round, so voters that repeat each other bring their
   evidence once.
3. Classifier.  The posterior of the sampled rows, not their labels, trains a logistic regression over the presence and
   density of hashed words and beginnings of words, at most `FEATURES` of them.  It needs no language and scores all documents,
   whole, in Arrow batches.

The sample has one text of each id (the shortest, then the first in the alphabet), none longer than a 64th of `MAX_TEXT`.

Defined cases: null and empty texts have no features and the score of the intercept, which is not toxic; null languages form
a group that uses the voters of the pooled sample, as do languages with few toxic labels; null ids are scored too; rows
that repeat get the same score; without labels only the seed lexicon and the patterns vote, and without any posterior positive
nothing is toxic; an empty table gives an empty one; `keep_clean` keeps all columns of the rows that it keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import ship
from spanforge.llm.textkernel import Block, blocks

#: Labelled rows that voters and classifier are fitted on: those of the least hashes of their ids.
MAX_LABELLED = 8_000
#: Characters of the sample's texts, in the same order.
MAX_TEXT = 64 << 20
VOTERS = 14
FEATURES = 4096
THRESHOLD = 0.5
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is dense in a document that has it so often and in such a share of its words.
DENSE = (2, 0.01)
SEED_LEXICON = (
    "idiot moron imbecile stupid dumb pathetic worthless loser scum trash disgusting clown filth vermin retard bastard "
    "asshole bitch whore slut cunt fuck fucking shit bullshit motherfucker"
).split()
SECOND_PERSON = "you your youre yourself u ur du dich dir dein deine ihr euch vous tu te toi ton ta tes votre usted tus".split()
#: Words between a second person and a word of the lexicon, at most.
NEAR = 3
#: Voters of each language besides its own: the seed lexicon and the patterns.
COMMON_VOTERS = 3
_PREFIX_SALT = np.uint64(0x5851F42D4C957F2D)
_TABLE = np.uint64((1 << 20) - 1)


def features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and documents of the words, then of their beginnings of each length."""
    starts, ends, docs = block.words()
    yield block.hash_ranges(starts, ends), docs
    for n in PREFIXES:
        longer = ends - starts > n
        s = starts[longer]
        yield block.hash_ranges(s, s + n) ^ _PREFIX_SALT, docs[longer]


def word_hashes(words: list[str]) -> np.ndarray:
    out = [next(features(b))[0] for w in words for b in blocks(pa.array([w]))]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _is_dense(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (counts >= DENSE[0]) & (counts >= DENSE[1] * words)


class Lookup:
    """Which of some features each document has.  Feature k is the presence of the k-th hash, k + n its density."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.n = len(self.hashes)
        self.maybe = np.zeros(int(_TABLE) + 1, bool)
        self.maybe[self.hashes & _TABLE] = True

    def number(self, hashes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hashes, hashes) + self.n * dense

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature), each pair once."""
        pairs, words = [np.zeros(0, np.int64)], np.zeros(block.n_docs, np.int64)
        if self.n:
            for k, (h, docs) in enumerate(features(block)):
                if not k:
                    words = np.bincount(docs, minlength=block.n_docs)
                m = self.maybe[h & _TABLE]
                h, docs = h[m], docs[m]
                at = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
                ok = self.hashes[at] == h
                pairs.append(docs[ok] * self.n + at[ok])
        key, counts = np.unique(np.concatenate(pairs), return_counts=True)
        doc, feature = key // max(self.n, 1), key % max(self.n, 1)
        dense = _is_dense(counts, words[doc])
        return np.concatenate([doc, doc[dense]]), np.concatenate([feature, feature[dense] + self.n])


def patterns(block: Block, seeds: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each document the bits of the seed lexicon (1), a second person shortly before one of its words (2), and !! (4)."""
    out = np.zeros(block.n_docs, np.int64)
    starts, ends, docs = block.words()
    if len(starts):
        h = block.hash_ranges(starts, ends)
        maybe = np.zeros(int(_TABLE) + 1, bool)
        maybe[np.concatenate([seeds, second]) & _TABLE] = True
        some = np.flatnonzero(maybe[h & _TABLE])
        at, you = some[np.isin(h[some], seeds)], np.zeros(len(h), bool)
        you[some[np.isin(h[some], second)]] = True
        out[docs[at]] |= 1
        for k in range(1, NEAR + 1):
            before = at[at >= k]
            hit = before[you[before - k] & (docs[before - k] == docs[before])]
            out[docs[hit]] |= 2
    shout = np.flatnonzero((block.data[:-1] == 33) & (block.data[1:] == 33))
    of = np.searchsorted(block.offsets, shout, side="right") - 1
    out[of[shout + 1 < block.offsets[of + 1]]] |= 4
    return out


@dataclass
class Voters:
    """For each language ('' for the others) its voters: hash, whether it must be dense, how often it fires in toxic
    and in clean sampled rows.  The seed lexicon and the patterns are more voters of each, the last."""

    by_lang: dict[str, list[tuple[np.uint64, bool, float, float]]] = field(default_factory=dict)
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    second: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    common_rates: dict[str, list[tuple[float, float]]] = field(default_factory=dict)

    def rates(self, lang: str) -> np.ndarray:
        """Outside and inside the class, a column for each voter."""
        own = [(base, rate) for _, _, rate, base in self.by_lang[lang]] + self.common_rates.get(lang, [(1e-4, 0.3), (1e-5, 0.1), (1e-2, 0.03)])
        return np.clip(np.array(own).T, 1e-4, 1 - 1e-4)

    def prepare(self) -> tuple[Lookup, dict[str, int], np.ndarray]:
        """The lookup of all features, the number of each language, and the bit of each feature by language."""
        lookup = Lookup(np.concatenate([np.zeros(0, np.uint64), *(np.array([v[0] for v in own], np.uint64) for own in self.by_lang.values())]))
        rows = {lang: k for k, lang in enumerate(sorted(self.by_lang))}
        bits = np.zeros((len(rows), 2 * lookup.n), np.int64)
        for lang, k in rows.items():
            own = self.by_lang[lang]
            for b, (h, dense, _, _) in enumerate(own):
                bits[k, lookup.number(h, int(dense))] |= 1 << b
        return lookup, rows, bits


def votes_of(block: Block, langs: list, voters: Voters, lookup: Lookup, rows: dict[str, int], bits: np.ndarray) -> np.ndarray:
    """For each document the set of its voters that fire, as bits."""
    group = np.array([rows.get(x or "", rows[""]) for x in langs], int)
    own = np.array([len(voters.by_lang[x]) for x in sorted(rows, key=rows.get)], int)
    out = patterns(block, voters.seeds, voters.second) << own[group]
    docs, feature = lookup.hits(block)
    np.bitwise_or.at(out, docs, bits[group[docs], feature])
    return out


def _candidates(texts: pa.Array, rows: np.ndarray, least: float) -> np.ndarray:
    """Hashes of features that at least so many of the rows have."""
    every, counts, found = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        found.clear()
        both, to = np.unique(np.concatenate([every, new]), return_inverse=True)
        return both, np.bincount(to.ravel(), np.concatenate([counts, n]), len(both)).astype(np.int64)

    for b in blocks(texts.take(pa.array(rows))):
        h, d = (np.concatenate(x) for x in zip(*features(b)))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        found.append(h[np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))] if len(h) else h)
        if sum(map(len, found)) > 1 << 21:
            every, counts = merged()
    every, counts = merged()
    return every[counts >= least]


def mine_voters(sample: pa.Table) -> Voters:
    """Voters from labelled rows (text, lang, toxic)."""
    voters = Voters({}, np.unique(word_hashes(SEED_LEXICON)), np.unique(word_hashes(SECOND_PERSON)))
    langs = [x or "" for x in sample["lang"].to_pylist()]
    toxic = sample["toxic"].to_numpy() == 1
    texts = sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string())
    for lang in sorted({"", *langs}):
        member = np.ones(len(langs), bool) if lang == "" else np.array([x == lang for x in langs], bool)
        yes, no = np.flatnonzero(member & toxic), np.flatnonzero(member & ~toxic)
        if len(yes) < 5 and lang:
            continue
        lookup = Lookup(_candidates(texts, yes, max(3, 0.03 * len(yes))))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for b in blocks(texts.take(pa.array(yes))):
            d, f = lookup.hits(b)
            hits.append((d + b.first, f))
        doc, feature = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, int), np.zeros(0, int))
        inside, outside = np.bincount(feature, minlength=2 * lookup.n), np.zeros(2 * lookup.n)
        for b in blocks(texts.take(pa.array(no))):
            outside += np.bincount(lookup.hits(b)[1], minlength=2 * lookup.n)
        fired = [np.zeros(COMMON_VOTERS), np.zeros(COMMON_VOTERS)]
        for c, rows in enumerate((no, yes)):
            for b in blocks(texts.take(pa.array(rows))):
                mask = patterns(b, voters.seeds, voters.second)
                fired[c] += [(mask >> k & 1).sum() for k in range(COMMON_VOTERS)]
        rate, base = inside / max(len(yes), 1), (outside + 0.5) / (len(no) + 1)
        voters.common_rates[lang] = [((a + 0.1) / (len(no) + 1), (z + 0.1) / (len(yes) + 1)) for a, z in zip(*fired)]
        good = np.flatnonzero((rate / base >= 12) & (rate >= 0.1))
        order = np.lexsort((feature,))
        starts = np.searchsorted(feature[order], np.arange(2 * lookup.n + 1))
        chosen: list[np.ndarray] = []
        own: list[tuple[np.uint64, bool, float, float]] = []
        for k in good[np.argsort(-(rate - 4 * base)[good], kind="stable")]:
            docs = np.sort(doc[order[starts[k] : starts[k + 1]]])
            if all(len(np.intersect1d(docs, c)) < 0.9 * len(np.union1d(docs, c)) for c in chosen):
                chosen.append(docs)
                own.append((lookup.hashes[k % lookup.n], bool(k >= lookup.n), float(rate[k]), float(base[k])))
            if len(own) == VOTERS:
                break
        if own or not lang:
            voters.by_lang[lang] = own
    voters.by_lang.setdefault("", [])
    return voters


@dataclass
class LabelModel:
    """Of one language: prior of the toxic class; outside and inside it the rate of each voter and how often each two fire together;
    for each voter the one that it depends on, or -1."""

    prior: float
    rates: np.ndarray
    joint: np.ndarray
    parents: np.ndarray

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        fired = ((masks[:, None] >> np.arange(len(self.parents))) & 1).astype(bool)
        logit = np.full(len(masks), np.log(self.prior / (1 - self.prior)))
        for v, p in enumerate(self.parents):
            given = [self.rates[c, v] if p < 0 else np.where(fired[:, p], self.joint[c, v, p] / self.rates[c, p], (self.rates[c, v] - self.joint[c, v, p]) / (1 - self.rates[c, p])) for c in (0, 1)]
            outside, inside = (np.clip(g, 1e-5, 1 - 1e-5) for g in given)
            logit = logit + np.where(fired[:, v], np.log(inside / outside), np.log((1 - inside) / (1 - outside)))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def strongest_tree(rates: np.ndarray, joint: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each voter its neighbour towards the root in the forest of the largest mutual information within the classes (Chow and Liu);
    weights: how many documents each class has.  Pairs whose information may be chance aren't joined."""
    n = rates.shape[1]
    information = np.zeros((n, n))
    for c in (0, 1):
        for i_fires in (True, False):
            for j_fires in (True, False):
                a, b = (rates[c] if f else 1 - rates[c] for f in (i_fires, j_fires))
                both = {(True, True): joint[c], (True, False): rates[c][:, None] - joint[c], (False, True): rates[c] - joint[c], (False, False): 1 - rates[c][:, None] - rates[c] + joint[c]}[i_fires, j_fires]
                both = np.clip(both, 1e-12, 1)
                information += weights[c] * both * np.log(both / np.clip(a[:, None] * b, 1e-12, 1))
    np.fill_diagonal(information, 0)
    parents = np.full(n, -1)
    reached = np.zeros(n, bool)
    best, towards = np.full(n, -np.inf), np.full(n, -1)
    for _ in range(n):
        v = int(np.where(reached, -np.inf, best).argmax()) if (~reached & np.isfinite(best)).any() else int(np.flatnonzero(~reached)[0])
        parents[v] = towards[v] if best[v] > 12 else -1  # nats, of both classes: far above what chance gives
        reached[v] = True
        better = information[v] > best
        best, towards = np.where(better, information[v], best), np.where(better, v, towards)
    return parents


def fit_label_model(masks: np.ndarray, counts: np.ndarray, rates: np.ndarray, rounds: int = 100, dependent: bool = True) -> LabelModel:
    """EM over combinations of votes and how many documents have each, from the given rates outside and inside the class.

    The given rates also weigh as much as a twentieth of the documents, so the class can't drift to another meaning.
    dependent: voters may depend on each other within the classes."""
    n_voters = rates.shape[1]
    fired = ((masks[:, None] >> np.arange(n_voters)) & 1).astype(float)
    n = counts.sum()
    model = LabelModel(0.1, rates.copy(), rates[:, :, None] * rates[:, None, :], np.full(n_voters, -1))
    if dependent and n:
        # what two voters do together more than the given rates explain is where the dependences come from at first
        together, alone = (fired * counts[:, None]).T @ fired / n, counts @ fired / n
        share = (alone - rates[0]) / np.maximum(rates[1] - rates[0], 1e-9)
        model.prior = float(np.clip(np.median(share), 1e-3, 0.5))
        excess = together - (1 - model.prior) * model.joint[0] - model.prior * model.joint[1]
        for c in (0, 1):
            model.joint[c] = np.clip(model.joint[c] + np.maximum(excess, 0), 0, np.minimum(rates[c][:, None], rates[c]))
        model.parents = strongest_tree(model.rates, model.joint, n * np.array([1 - model.prior, model.prior]))
    q = model.posterior(masks)
    for k in range(rounds):
        weight = [counts * (1 - q), counts * q]
        model.prior = float(np.clip(weight[1].sum() / max(n, 1), 1e-4, 0.5))
        for c in (0, 1):
            held = 1 + 0.05 * n * (model.prior if c else 1 - model.prior)
            total = weight[c].sum() + held
            model.rates[c] = np.clip((weight[c] @ fired + held * rates[c]) / total, 1e-5, 1 - 1e-5)
            model.joint[c] = ((fired * weight[c][:, None]).T @ fired + held * np.outer(rates[c], rates[c])) / total
        model.rates[1] = np.maximum(model.rates[1], np.minimum(model.rates[0] * 1.01, 1 - 1e-5))
        for c in (0, 1):
            model.joint[c] = np.clip(model.joint[c], np.maximum(0, model.rates[c][:, None] + model.rates[c] - 1), np.minimum(model.rates[c][:, None], model.rates[c]))
        if dependent and k < rounds // 2:  # then the tree stays, so that EM converges
            model.parents = strongest_tree(model.rates, model.joint, np.array([w.sum() for w in weight]))
        new = model.posterior(masks)
        if k > rounds // 2 and np.abs(new - q).max(initial=0) < 1e-6:
            break
        q = new
    return model


@dataclass
class Classifier:
    """weights: of the presence of each hash, then of its density."""

    hashes: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, block: Block, lookup: Lookup) -> np.ndarray:
        docs, feature = lookup.hits(block)
        logit = self.intercept + np.bincount(docs, self.weights[feature], block.n_docs)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train_classifier(texts: pa.Array, posterior: np.ndarray, rounds: int = 300, most: int = FEATURES) -> Classifier:
    """Logistic regression on soft labels, over features that the posterior makes likelier in one class."""
    if not len(posterior) or posterior.max() < 0.5:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), -10.0)
    lookup = Lookup(_candidates(texts, np.flatnonzero(posterior >= 0.5), 3))
    inside, outside = np.zeros(2 * lookup.n), np.zeros(2 * lookup.n)
    for b in blocks(texts):
        d, f = lookup.hits(b)
        inside += np.bincount(f, posterior[d + b.first], 2 * lookup.n)
        outside += np.bincount(f, 1 - posterior[d + b.first], 2 * lookup.n)
    n1, n0 = posterior.sum(), (1 - posterior).sum()
    odds = np.log((inside + 0.5) / (n1 + 1)) - np.log((outside + 0.5) / (n0 + 1))
    chosen = np.flatnonzero((odds > 2.5) & (inside >= 3))
    chosen = chosen[np.argsort(-odds[chosen] * np.sqrt(inside[chosen]), kind="stable")[:most]]
    chosen.sort()
    number = np.full(2 * lookup.n, -1)
    number[chosen] = np.arange(len(chosen))
    rows, cols = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for b in blocks(texts):
        d, f = lookup.hits(b)
        keep = number[f] >= 0
        rows.append((d[keep] + b.first).astype(np.int32))
        cols.append(number[f[keep]].astype(np.int32))
    row, col = np.concatenate(rows), np.concatenate(cols)
    w, b0 = np.zeros(len(chosen)), float(np.log(n1 / n0)) if n0 > 0 else 0.0
    g2, gb2 = np.full(len(chosen), 1e-8), 1e-8
    balance = np.where(posterior >= 0.5, min(10.0, n0 / n1), 1.0)
    for _ in range(rounds):  # full-batch AdaGrad
        p = 1 / (1 + np.exp(-np.clip(b0 + np.bincount(row, w[col], len(posterior)), -500, 500)))
        e = (p - posterior) * balance / len(posterior)
        g = np.bincount(col, e[row], len(chosen)) + 1e-5 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        gb2 += e.sum() ** 2
        b0 -= 0.5 * e.sum() / np.sqrt(gb2)
    hashes = np.unique(lookup.hashes[chosen % max(lookup.n, 1)])
    weights = np.zeros(2 * len(hashes))
    weights[np.searchsorted(hashes, lookup.hashes[chosen % max(lookup.n, 1)]) + len(hashes) * (chosen >= lookup.n)] = w
    return Classifier(hashes, weights, b0)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, columns: list[str], most_text: int = MAX_TEXT) -> pa.Table:
    """At most so many labelled rows and characters, of the least hashes of their ids: doc_id, the label columns, text and lang.

    Of an id with several texts the shortest (then first) counts, and texts of more than a 64th of `most_text` don't."""
    ids = (
        labels.select(F.col("doc_id").cast("bigint").alias("__id"), *columns)
        .filter("__id is not null")
        .dropna(subset=columns)
        .dropDuplicates(["__id"])
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most)
    )
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    size = F.coalesce(F.char_length("text"), F.lit(0))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(size.alias("n"), "text", lang.alias("lang")).alias("t")).filter(F.col("t.n") <= most_text // 64)
    one = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).groupBy("doc_id", *columns).agg(F.min("t").alias("t"))
    upto = F.sum("t.n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # of at most `most` rows
    return one.withColumn("__upto", upto).filter(F.col("__upto") <= most_text).select("doc_id", "t.text", "t.lang", *columns).toArrow()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Fits voters and classifier on the sample and the label models on the votes on all documents."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, max_labelled, ["toxic"])
    voters = mine_voters(sample)
    lookup, rows, bits = voters.prepare()
    has_lang = "lang" in docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for b in blocks(batch.column(0)):
                own = langs[b.first : b.last]
                masks = votes_of(b, own, voters, lookup, rows, bits)
                for lang, mask in zip(own, masks.tolist()):
                    key = (rows.get(lang or "", rows[""]), mask)
                    seen[key] = seen.get(key, 0) + 1
        columns = [[k[0] for k in seen], [k[1] for k in seen], list(seen.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["lang_no", "mask", "n"])

    lang = F.col("lang") if has_lang else F.lit(None).cast("string")
    votes = docs.select("text", lang).mapInArrow(count, "lang_no bigint, mask bigint, n bigint").groupBy("lang_no", "mask").agg(F.sum("n").alias("n")).toPandas()
    models: dict[int, LabelModel] = {}
    for name, k in rows.items():
        own = votes[votes["lang_no"] == k].sort_values("mask")
        models[k] = fit_label_model(own["mask"].to_numpy(np.int64), own["n"].to_numpy(float), voters.rates(name))
    posterior = np.zeros(sample.num_rows)
    texts = sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string())
    langs = sample["lang"].to_pylist()
    for b in blocks(texts):
        own = langs[b.first : b.last]
        masks = votes_of(b, own, voters, lookup, rows, bits)
        groups = np.array([rows.get(x or "", rows[""]) for x in own])
        for k in np.unique(groups):
            here = np.flatnonzero(groups == k)
            posterior[b.first + here] = models[int(k)].posterior(masks[here])
    return train_classifier(texts, posterior)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """A row for each document: doc_id, its score and whether it is toxic."""
    model = fit(docs, labels, max_labelled)
    lookup = Lookup(model.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for b in blocks(batch.column(1)):
                scores[b.first : b.last] = model.scores(b, lookup)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(scores >= threshold)], ["doc_id", "score", "toxic"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, score double, toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    model = fit(docs, labels, max_labelled)
    lookup = Lookup(model.hashes)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for b in blocks(batch.column(at)):
                keep[b.first : b.last] = model.scores(b, lookup) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
