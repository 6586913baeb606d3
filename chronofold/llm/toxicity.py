"""Abusive, hateful or sexual content, by non-negative positive-unlabelled learning.

A text is as abusive as its worst passage. Passages are runs of words between
marks of punctuation; a passage's features are its words, word pairs and pairs
with one word between, hashed, after disguises are undone (look-alike and
invisible characters, digits for letters, repeated and spaced-out letters).

Confirmed abusive documents hold such a passage somewhere, so the passage is
latent: it starts as the one whose features are most over-represented in confirmed
documents against all, and each round takes the one the classifier scores
highest. The classifier is linear in numpy, trained from these passages (P) and
passages of unlabelled documents (U) by the non-negative risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]).

The class prior is estimated from confirmed documents left out of training, ranked
among unlabelled ones; that share of all documents is flagged, up to the nearest gap
in the scores of all documents.

Fitting takes at most MAX_CONFIRMED confirmed and MAX_UNLABELLED unlabelled
documents, drawn by a hash of the key, and at most MAX_SINGLE of the passages that
only one unlabelled document holds (weighted up in turn); all three are parameters.
The prior is found among these, no finer than one document; scoring, the cut at that
share and the rates cover every document, whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

MAX_CONFIRMED = 4_000
MAX_UNLABELLED = 8_000
#: Passages that one unlabelled document holds; beyond this they are thinned, and weighted up in turn.
MAX_SINGLE = 40_000
BITS = 20
#: Log lift (three standard errors below its estimate) from which passages of low-scoring confirmed texts count as a missed family.
MISSED = 1.0
#: ... if so many texts share the feature.
LEAST = 4
#: Score of a text without words.
EMPTY = -20.0

# Cyrillic and Greek letters that look like Latin ones, and digits that stand for letters.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһтвкмнпгбυινοατρ", "aeopcyxijsdhtbkmhnrbuivoatp")
LEET = str.maketrans("013457@$", "oieastas")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_FOREIGN = re.compile("[­​-‏⁠-⁤﻿Ͱ-ԯ]")
_TOKEN = re.compile(r"""[\w*@$#]+|[,.!?;:\n"“”„«»\[\]]|(?<!\w)['‘‚]|['’](?!\w)""")
_REPEAT = re.compile(r"(.)\1+")
_MARKS = frozenset(",.!?;:\n\"“”„«»[]'‘‚’")
_MULT = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Token to number: 0 for marks, below 2^20 for single letters, above 2^32 for words."""

    def __missing__(self, t: str) -> int:
        if t in _MARKS:
            n = 0
        elif len(t) == 1 and t.isalpha():
            n = min(ord(t), 2**20 - 1)
        else:
            n = word_id(t)
        if len(self) < 2_000_000:
            self[t] = n
        return n


def word_id(t: str) -> int:
    if t.isdigit():
        t = "0"
    elif not t.isalpha():
        if any(c.isalpha() for c in t):
            t = t.translate(LEET)
    return zlib.crc32(_REPEAT.sub(r"\1", t).encode()) + 2**32


def plain(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _FOREIGN.search(text):
            text = _INVISIBLE.sub("", text).translate(LOOKALIKE)
    return text


def passages(texts: list[str | None], ids: _Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, first word of each passage, text of each passage)."""
    parts, lens = [], []
    get = ids.__getitem__
    for t in texts:
        found = list(map(get, _TOKEN.findall(plain(t)))) if t else []
        found.append(0)
        parts += found
        lens.append(len(found))
    h = np.array(parts, np.uint64)
    owner = np.repeat(np.arange(len(texts)), lens)
    letter = (h > 0) & (h < 2**20)
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    keep = h > 0
    for a, z in zip(edge[::2], edge[1::2]):
        if z - a >= 3:  # a word spelt in single letters
            h[a] = word_id("".join(map(chr, h[a:z].tolist())))
            keep[a + 1 : z] = False
    seg = np.cumsum(h == 0)
    h, seg, owner = h[keep], seg[keep], owner[keep]
    first = np.flatnonzero(np.r_[True, np.diff(seg) > 0]) if len(h) else np.zeros(0, int)
    return h, first, owner[first]


def features(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of words, pairs and skip pairs, and the value of each feature of a passage."""
    n = len(h)
    length = np.diff(np.r_[first, n])
    place = np.arange(n) - np.repeat(first, length)
    shift = np.uint64(64 - BITS)
    one = (h * _MULT) >> shift
    two = np.zeros(n, np.uint64)
    two[1:] = ((h[:-1] * np.uint64(31) + h[1:] + np.uint64(7)) * _MULT) >> shift
    skip = np.zeros(n, np.uint64)
    skip[2:] = ((h[:-2] * np.uint64(131) + h[2:] + np.uint64(77)) * _MULT) >> shift
    f = np.stack([one, two, skip], axis=1).astype(np.int32)
    mask = np.stack([np.ones(n, bool), place >= 1, place >= 2], axis=1)
    count = length + np.maximum(length - 1, 0) + np.maximum(length - 2, 0)
    return f, mask, length, 1 / np.sqrt(np.maximum(count, 1))


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    threshold: float = 0.0

    def passage_scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0)
        f, mask, _, value = features(h, first)
        return np.add.reduceat((self.weights[f] * mask).sum(axis=1), first) * value + self.bias

    def score(self, texts: list[str | None], ids: _Ids) -> np.ndarray:
        out = np.full(len(texts), EMPTY)
        h, first, owner = passages(texts, ids)
        np.maximum.at(out, owner, self.passage_scores(h, first))
        return out


class _Bags:
    """Distinct passages of a set of texts with their features, and which texts hold them."""

    def __init__(self, texts: list[str]):
        ids, parts, lengths, prints, owners = _Ids(), [], [], [], []
        for low in range(0, len(texts), 500):
            h, first, owner = passages(texts[low : low + 500], ids)
            if len(h):
                length = np.diff(np.r_[first, len(h)])
                place = np.arange(len(h)) - np.repeat(first, length)
                prints.append(np.add.reduceat((h + np.uint64(1)) * (_MULT * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))), first))
                parts.append(h), lengths.append(length), owners.append(owner + low)
        none = np.zeros(0, np.int64)
        h, length, owner = (np.concatenate(x) if x else none for x in (parts, lengths, owners))
        _, at, passage = np.unique(np.concatenate(prints) if prints else none, return_index=True, return_inverse=True)
        self.n = len(at)
        pairs = np.unique(owner * max(1, self.n) + passage)
        self.text, self.passage = pairs // max(1, self.n), pairs % max(1, self.n)
        start = np.cumsum(length) - length
        length = length[at]
        take = np.repeat(start[at] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        f, mask, _, self.value = features(h[take].astype(np.uint64), np.cumsum(length) - length)
        self.feature = f[mask]
        self.seg = np.repeat(np.repeat(np.arange(self.n, dtype=np.int32), length)[:, None], 3, axis=1)[mask]

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.seg, weights=w[self.feature], minlength=self.n) * self.value + b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nnpu(bags: _Bags, p: np.ndarray, u: np.ndarray, u_weight: np.ndarray, prior: float, steps: int = 100, rate: float = 0.5, decay: float = 1e-7) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss, over
    the passages p (confirmed) and u (unlabelled, weighted)."""
    live = np.zeros(bags.n, bool)
    live[p] = live[u] = True
    mine = live[bags.seg]
    feature, seg, value = bags.feature[mine], bags.seg[mine], bags.value
    used = np.flatnonzero(np.bincount(feature, minlength=1 << BITS))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    feature = place[feature]
    wu = u_weight / u_weight.sum()
    wp = np.bincount(p, minlength=bags.n) / len(p)
    wu = np.bincount(u, weights=wu, minlength=bags.n)
    w, b = np.zeros(len(used)), -3.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        f = np.bincount(seg, weights=w[feature], minlength=bags.n) * value + b
        up, loss_neg = _sigmoid(f), np.logaddexp(0, f)
        negative = (wu * loss_neg).sum() - prior * (wp * loss_neg).sum()
        if negative >= 0:
            slope = -prior * wp * (1 - up) + wu * up - prior * wp * up
        else:
            slope = -(wu * up - prior * wp * up)
        g = np.bincount(feature, weights=(slope * value)[seg], minlength=len(used)) + decay * w
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.2 * rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    out = np.zeros(1 << BITS)
    out[used] = w
    return out, float(b)


def share_to_flag(held: np.ndarray) -> float:
    """The share of unlabelled texts that is abusive, which is also the class prior.

    held: for each confirmed text the share of unlabelled texts that score as high.
    Confirmed texts are a mixture: readers err, and pick some kinds of abuse more often
    than others, so a rank is judged by its lift, how much denser confirmed texts lie
    there than unlabelled ones. Harmless texts have a lift below 1, the upper three
    quarters of the abusive ones one of `lift`; the share ends where it falls below the
    geometric mean of 1 and `lift`."""
    shares = np.unique(held)
    recall = np.searchsorted(np.sort(held), shares, side="right") / len(held)
    error = min(1.0, 2 * float((held > 0.5).mean()))
    top = int(np.argmin(np.abs(recall - error * shares - 0.75 * (1 - error))))
    lift = max(1.0, float(recall[top] / shares[top]))
    return float(shares[len(shares) - 1 - np.argmax((recall - np.sqrt(lift) * shares)[::-1])])


def _ranks(confirmed: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Shares of unlabelled scores at least as high, no finer than one text."""
    return np.maximum(1 - np.searchsorted(np.sort(unlabelled), confirmed, side="left") / len(unlabelled), 1 / len(unlabelled))


def _lift(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """The log of how much more frequent a in n is than b in m, less three standard errors."""
    return np.log((a + 0.5) / (b + 0.5) * (m + 1) / (n + 1)) - 3 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


class _Trainer:
    """Fits classifiers to subsets of the confirmed texts over one set of bags."""

    def __init__(self, bags: _Bags, n: int, m: int, max_single: int, seed: int):
        self.bags, self.n, self.m = bags, n, m
        self.unlabelled = n + np.arange(m)
        self.rng = np.random.default_rng(seed)
        df_u = np.bincount(bags.passage[bags.text >= n], minlength=bags.n)
        u, single = np.flatnonzero(df_u > 1), np.flatnonzero(df_u == 1)
        kept = self.rng.permutation(single)[:max_single]
        self.u, self.u_weight = np.concatenate([u, kept]), np.concatenate([df_u[u].astype(float), np.full(len(kept), len(single) / max(1, len(kept)))])
        self.per_text = max(1.0, df_u.sum() / max(1, m))
        # (text, feature), each once, for a thousand texts at a time
        starts = np.searchsorted(bags.seg, np.arange(bags.n + 1))
        texts, features_ = [], []
        for low in range(0, n + m, 1000):
            a, z = np.searchsorted(bags.text, [low, low + 1000])
            passage = bags.passage[a:z]
            count = np.diff(starts)[passage]
            at = np.repeat(starts[:-1][passage] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            pair = np.unique((np.repeat(bags.text[a:z] - low, count) << BITS) + bags.feature[at])
            texts.append((low + (pair >> BITS)).astype(np.int32))
            features_.append((pair & ((1 << BITS) - 1)).astype(np.int32))
        self.pair_text, self.pair_feature = np.concatenate(texts), np.concatenate(features_)
        self.starts = starts[:-1]

    def _best(self, score: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, its best passage) of the chosen texts that have passages."""
        part = np.isin(self.bags.text, chosen)
        text, passage = self.bags.text[part], self.bags.passage[part]
        order = np.lexsort((score[passage], text))
        text, passage = text[order], passage[order]
        last = np.flatnonzero(np.r_[np.diff(text) > 0, True]) if len(text) else np.zeros(0, int)
        return text[last], passage[last]

    def _count(self, texts: np.ndarray) -> np.ndarray:
        """How many of the texts hold each feature."""
        chosen = np.zeros(self.n + self.m, bool)
        chosen[texts] = True
        return np.bincount(self.pair_feature[chosen[self.pair_text]], minlength=1 << BITS).astype(float)

    def _odds(self, chosen: np.ndarray) -> np.ndarray:
        """Of each passage: how over-represented its features are in the chosen texts, in sum."""
        share = len(chosen) / (self.n + self.m)
        a = self._count(chosen)
        every = a + self._count(self.unlabelled)
        w = np.log((a + 2 * share) / ((every + 2) * share))
        return self.bags.scores(np.where(every < 2, np.minimum(w, 0.5), w), 0.0)

    def _lifts(self, chosen: np.ndarray, against: np.ndarray) -> np.ndarray:
        """Of each passage: the lift of its most over-represented feature in the chosen texts."""
        a = self._count(chosen)
        lift = np.where(a >= LEAST, _lift(a, self._count(against), len(chosen), len(against)), -np.inf)
        return np.maximum.reduceat(lift[self.bags.feature], self.starts)

    def with_passages(self, texts: np.ndarray) -> np.ndarray:
        return texts[np.isin(texts, self.bags.text)]

    def text_scores(self, model: tuple[np.ndarray, float]) -> np.ndarray:
        worst = np.full(self.n + self.m, EMPTY)
        np.maximum.at(worst, self.bags.text, self.bags.scores(*model)[self.bags.passage])
        return worst

    def _odds(self, chosen: np.ndarray) -> np.ndarray:
        """Of each passage: how over-represented its features are in the chosen texts, in sum."""
        share = len(chosen) / (self.n + self.m)
        count = lambda texts: np.bincount(self.pair_feature[np.isin(self.pair_text, texts)], minlength=1 << BITS).astype(float)
        a = count(chosen)
        every = a + count(self.unlabelled)
        w = np.log((a + 2 * share) / ((every + 2) * share))
        return self.bags.scores(np.where(every < 2, np.minimum(w, 0.5), w), 0.0)

    def train(self, chosen: np.ndarray, prior: float, rounds: int) -> tuple[np.ndarray, float]:
        """The first round learns from the most over-represented passage of each
        confirmed text but the least likely quarter, as readers err. Later ones take
        the passage scored highest where it is abusive, and look among the texts that
        still score low for families of passages missed so far."""
        bags = self.bags
        start = self._odds(chosen)
        p = self._best(start, chosen)[1]
        p = p[start[p] >= np.quantile(start[p], 0.25)]
        for r in range(rounds):
            model = nnpu(bags, p, self.u, self.u_weight, prior / self.per_text)
            if r == rounds - 1:
                break
            score = bags.scores(*model)
            text, found = self._best(score, chosen)
            u_scores = self.text_scores(model)[self.n :]
            rank = _ranks(score[found], u_scores)
            high = rank <= share_to_flag(rank)
            low = text[~high]
            p = found[high]
            if len(low):
                missed = self._lifts(low, self.n + np.flatnonzero(u_scores < score[p].min()))
                more = self._best(missed, low)[1]
                p = np.concatenate([p, more[missed[more] >= MISSED]])
        return model


def fit(confirmed: list[str], unlabelled: list[str], prior: float = 0.05, rounds: int = 2, folds: int = 3, seed: int = 1, max_single: int = MAX_SINGLE) -> tuple[Classifier, np.ndarray]:
    """The classifier and, for each confirmed text, the share of the unlabelled texts
    that score at least as high by a classifier fitted without the text, at least one
    text's share. prior: share of abusive documents that these classifiers are fitted
    with; the last one is fitted with the share estimated by them."""
    n, m = len(confirmed), len(unlabelled)
    bags = _Bags(confirmed + unlabelled)
    if not n or not (bags.text >= n).any():
        return Classifier(np.zeros(1 << BITS), EMPTY), np.zeros(0)
    trainer = _Trainer(bags, n, m, max_single, seed)
    held = np.ones(n)
    fold = trainer.rng.permutation(n) % folds
    for k in range(folds):
        rest, mine = trainer.with_passages(np.flatnonzero(fold != k)), np.flatnonzero(fold == k)
        if len(rest) and len(mine):
            worst = trainer.text_scores(trainer.train(rest, prior, rounds))
            held[mine] = _ranks(worst[mine], worst[n:])
    every = trainer.with_passages(np.arange(n))
    if not len(every):
        return Classifier(np.zeros(1 << BITS), EMPTY), np.zeros(0)
    w, b = trainer.train(every, min(0.5, share_to_flag(held)), rounds)
    return Classifier(w, b), held


def threshold(held: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> float:
    """The cut in the histogram of all scores: about share_to_flag of the texts score
    above it, and within a quarter of that share it is the sparsest place, if one is
    sparse. Without a text that stands out nothing is flagged."""
    if not len(held) or not len(edges):
        return np.inf
    share = share_to_flag(held)
    if share >= 0.5:
        return np.inf
    order = np.argsort(-edges)
    edge, flagged = edges[order], np.cumsum(counts[order]) / counts.sum()
    near = np.flatnonzero((flagged >= 0.75 * share) & (flagged <= 1.25 * share))
    at = int(np.argmin(np.abs(flagged - share)))
    if len(near):
        around = np.array([counts[np.abs(edges - edge[i]) < 0.5].sum() for i in near])
        if around.min() < 0.1 * counts.sum() * share:
            level = np.median(edge[near[around <= 1.25 * around.min()]])
            at = int(near[np.argmin(np.abs(edge[near] - level))])
    return float(edge[at])


def scores(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "abusive", max_confirmed: int = MAX_CONFIRMED, max_unlabelled: int = MAX_UNLABELLED, max_single: int = MAX_SINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, score (log-odds of the worst passage), flagged.

    A document is confirmed if more than half of its non-null labels are 1. A null
    or empty text, or one without words, has score EMPTY and is not flagged; a row
    with a null key is left out; a repeated key gets one row, with its highest
    score. Without confirmed documents nothing is flagged. Tables may be empty."""
    tmp = Scratch(documents.sparkSession, "toxicity")
    votes = labels.select(*[c for c in labels.columns if c in (key, label, "rater", "labelled_at")]).distinct().where(F.col(label).isNotNull()).groupBy(key).agg(F.avg(label).alias("mean_")).where("mean_ > 0.5").select(key)
    votes = F.broadcast(votes.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(max_confirmed))
    confirmed = documents.select(key, text).join(votes, key, "left_semi").dropna().dropDuplicates([key]).orderBy(F.xxhash64(key), key)
    n = documents.count()
    drawn = F.xxhash64(key, F.lit(9))
    some = F.pmod(drawn, F.lit(1_000_000)) < int(min(1_000_000, 1_200_000 * max_unlabelled / max(1, n)) + 1)  # so that few rows are sorted
    others = documents.select(key, text).where(some).dropna().orderBy(drawn, key).limit(max_unlabelled)
    model, held = fit([r[text] for r in confirmed.collect()], [r[text] for r in others.collect()], max_single=max_single)
    weights = model.weights.astype(np.float32)
    at = np.flatnonzero(weights)
    sparse, bias = (at.astype(np.int32), weights[at]), model.bias
    cols = documents.where(F.col(key).isNotNull()).select(key, *keep, F.col(text).alias("text_to_score_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS, np.float32)
        w[sparse[0]] = sparse[1]
        model, ids = Classifier(w, bias), _Ids()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            out = [model.score(texts.slice(a, 256).to_pylist(), ids) for a in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*b.schema.names[:-1], "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    scored = tmp.save(cols.mapInArrow(run, StructType([*cols.schema.fields[:-1], StructField("score", DoubleType())])).groupBy(key).agg(*(F.first(c).alias(c) for c in keep), F.max("score").alias("score")))
    hist = scored.where(F.col("score") > EMPTY).groupBy((F.floor(F.col("score") * 20) / 20).alias("edge")).count().collect()
    cut = threshold(held, np.array([r["edge"] for r in hist]), np.array([float(r["count"]) for r in hist]))
    return scored.withColumn("flagged", F.col("score") >= F.lit(cut))


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    from .mixing import canonical_source

    return scored.groupBy(F.coalesce(canonical_source(source), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
