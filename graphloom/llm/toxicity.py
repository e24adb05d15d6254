"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over the distinct words of a text and their beginnings, which
inflected languages share between forms.  It learns from confirmed toxic texts (P) and
unlabelled ones (U, a mixture with a known share of toxic texts, the class prior) by the
non-negative risk estimator of Kiryo, Niu, du Plessis and Sugiyama (2017):

    prior E_P[l(f)] + max(0, E_U[l(-f)] - prior E_P[l(-f)])

with the logistic loss l; while the second part is negative, its gradient is reversed.

U is a sample of all documents and one of labelled rows, whose labels are not looked at.  The
prior is the share of toxic texts among U, which need not be that among labels: a first
model, fitted on half of a labelled sample, is tried on the other half, and its share of
hits among the documents is corrected by its rates of hits and false alarms there.

Fitting uses bounded samples, MOST_POSITIVE toxic rows, MOST_UNLABELLED documents and
MOST_LABELLED labelled rows, taken by hash of the id; scoring reads every whole text.  Only
ids of hashed features of the samples reach the driver, FEATURES of a text at most (taken
by hash), so 131 MB at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import forget

#: Bounds on the rows that are fitted.
MOST_POSITIVE = 2000
MOST_UNLABELLED = 3000
MOST_LABELLED = 3000
#: Distinct features of one text that fitting looks at; scoring looks at all.
FEATURES = 4096
THRESHOLD = 0.7
#: Weight decay: of 1, 2, 3, 5 and 10 times 1e-4 the best on four folds of the rows that op5 may learn from.
DECAY = 5e-4
#: Words a worker remembers the features of.
MEMO = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> tuple[int, ...]:
    """A word's hashed features: itself and its first four to eight letters."""
    from zlib import crc32

    return tuple(crc32(x.encode()) for x in {word + "$", *(word[:n] for n in range(4, 9))})


@dataclass
class Model:
    """score(text) is the probability, as estimated, that the text is toxic."""

    weights: dict[int, float]
    bias: float
    memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "memo": {}}

    def score(self, text: str | None) -> float:
        memo, found = self.memo, set()
        for word in words(text):
            own = memo.get(word)
            if own is None:
                if len(memo) >= MEMO:
                    memo.clear()
                own = memo[word] = tuple(x for x in features(word) if x in self.weights)
            if own:
                found.update(own)
        return self.of(found)

    def of(self, found) -> float:
        """The probability for a text with these features."""
        z = self.bias + sum(self.weights.get(x, 0.0) for x in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _counted(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of all rows and how often each is there, in little more memory than the ids take."""
    x = np.concatenate(rows)
    x.sort()
    ends = np.flatnonzero(np.append(x[1:] != x[:-1], True))
    return x[ends], np.diff(ends, prepend=-1)


#: A text as (features, rows): the columns of the features that it has, and its number, for all texts one after the other.
Matrix = tuple[np.ndarray, np.ndarray, int]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(w: np.ndarray, b: float, positive: Matrix, unlabelled: Matrix, prior: float, decay: float) -> tuple[float, np.ndarray]:
    """The non-negative risk with decay / 2 |w|^2, and the step to take against: its gradient by w and b, or, where the risk of U as negative is below nothing, what raises that part again."""
    (pc, pr, np_), (uc, ur, nu) = positive, unlabelled
    fp = np.bincount(pr, w[pc], np_) + b
    fu = np.bincount(ur, w[uc], nu) + b
    soft = lambda x: np.logaddexp(0, x)
    # l(f) = log(1 + e^-f), l(-f) = log(1 + e^f)
    negative = soft(fu).mean() - prior * soft(fp).mean()
    value = prior * soft(-fp).mean() + max(0.0, negative) + decay / 2 * (w @ w)
    gp_pos = -prior * _sigmoid(-fp) / np_
    gu, gp_neg = _sigmoid(fu) / nu, -prior * _sigmoid(fp) / np_
    gp, gu = (gp_pos + gp_neg, gu) if negative >= 0 else (gp_pos - gp_neg, -gu)
    grad = np.bincount(pc, gp[pr], len(w)) + np.bincount(uc, gu[ur], len(w)) + decay * w
    return value, np.append(grad, gp.sum() + gu.sum())


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, rounds=400, rate=0.1, decay=DECAY, features=FEATURES) -> Model:
    """Fit on arrays of distinct feature ids, one for each text. Without positives every score is near the prior."""
    prior = min(max(prior, 1e-3), 0.9)
    if not positive or not unlabelled:
        return Model({}, float(np.log(prior / (1 - prior))))
    np_, nu = len(positive), len(unlabelled)
    (ids, counts_p), (all_u, counts_all) = _counted(positive), _counted(unlabelled)
    counts_u = np.zeros(len(ids))
    at = np.searchsorted(all_u, ids)
    there = (at < len(all_u)) & (all_u[np.minimum(at, len(all_u) - 1)] == ids)
    counts_u[there] = counts_all[at[there]]
    p, u = counts_p / np_, counts_u / nu
    z = (p - u) / np.sqrt((p * (1 - p) + 1e-9) / np_ + (u * (1 - u)) / nu + 1.0 / (np_ * nu))
    z[counts_p < 2] = 0
    keep = ids[np.sort(np.argsort(-z, kind="stable")[:features])]
    del all_u, counts_all, there, at

    def matrix(rows):
        cols, where = [], []
        for i, row in enumerate(rows):
            j = np.searchsorted(keep, row)
            ok = (j < len(keep)) & (keep[np.minimum(j, len(keep) - 1)] == row)
            cols.append(j[ok])
            where.append(np.full(ok.sum(), i))
        return np.concatenate(cols), np.concatenate(where), len(rows)

    held = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(keep)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for step in range(1, rounds + 1):
        _, g = risk(w, b, *held, prior, decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({int(k): float(x) for k, x in zip(keep, w, strict=True) if x}, float(b))


def prior_of(unlabelled: list[np.ndarray], labelled: list[np.ndarray], toxic: np.ndarray) -> float:
    """The share of toxic texts among the unlabelled; that among the labelled where these are too few to tell."""
    known = float(toxic.mean()) if len(toxic) else 0.0
    half = np.arange(len(toxic)) % 2 == 0
    first = fit([x for x, a, y in zip(labelled, half, toxic, strict=True) if a and y], [x for x, a in zip(labelled, half, strict=True) if a], known)
    said = lambda rows: np.array([first.of(x.tolist()) >= 0.5 for x in rows], bool)
    told, truth = said([x for x, a in zip(labelled, half, strict=True) if not a]), toxic[~half]
    if not unlabelled or truth.sum() < 20 or (~truth).sum() < 20:
        return known
    hits, alarms = told[truth].mean(), told[~truth].mean()
    if hits - alarms < 0.3:
        return known
    return float(np.clip((said(unlabelled).mean() - alarms) / (hits - alarms), 0.5 * known, 2 * known))


def train(docs: DataFrame, labels: DataFrame, *, id_column="doc_id", text_column="text", label_id="doc_id", label_column="toxic", held_out=None, seed: int = 7,
          most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, most_labelled: int = MOST_LABELLED, features_of_text: int = FEATURES) -> Model:
    """Fit from labels' rows for which held_out (a Column over label_id) is false.

    Null labels and ids take no part; of several labels for one id the greatest counts.
    P: up to most_positive rows labelled 1.  U: up to most_unlabelled documents, whether they
    have a label or not, and up to most_labelled labelled rows; labels are not looked at.
    Of a text the features_of_text of least hash are fitted.  Rows that are held out are in no sample.
    """
    known = labels.select(F.col(label_id).alias("i"), F.col(label_column).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    every = docs.select(F.col(id_column).alias("i")).where("i IS NOT NULL")
    if held_out is not None:
        known, every = known.where(~held_out(F.col("i"))), every.where(~held_out(F.col("i")))
    known = known.groupBy("i").agg((F.max("y") == 1).alias("y")).withColumn("order", F.xxhash64(F.lit(seed), "i"))
    # an id that is repeated is drawn once
    every = every.groupBy("i").agg(F.lit(None).cast("boolean").alias("y")).withColumn("order", F.xxhash64(F.lit(seed + 1), "i"))
    drawn = [("P", known.where("y"), most_positive), ("L", known, most_labelled), ("U", every, most_unlabelled)]
    sets = [rows.orderBy("order", "i").limit(most).select("i", "y", F.lit(name).alias("set")) for name, rows, most in drawn]
    chosen = common.fixed(sets[0].union(sets[1]).union(sets[2]), "sample")  # at most the three bounds

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in common.trimmed(batches):
            rows = [np.array(sorted({f for w in words(t) for f in features(w)})[:features_of_text], "<u4").tobytes() for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(f=rows)

    rows = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "i")
    kind = rows.schema["i"].dataType.simpleString()
    rows = rows.mapInPandas(extract, f"i {kind}, y boolean, set string, f binary")
    # repeated rows of an id are one text of the sample
    rows = common.stored(rows.groupBy("i", "set").agg(F.first("y").alias("y"), F.min("f").alias("f")), "features")

    def of(name: str) -> tuple[list[np.ndarray], np.ndarray]:
        held = sorted(rows.where(F.col("set") == name).select("i", "y", "f").collect(), key=lambda r: str(r["i"]))
        return [np.frombuffer(r["f"], "<u4") for r in held], np.array([bool(r["y"]) for r in held], bool)

    (labelled, toxic), (unlabelled, _) = of("L"), of("U")
    share = prior_of(unlabelled, labelled, toxic)
    prior = (toxic.sum() + share * len(unlabelled)) / max(1, len(toxic) + len(unlabelled))
    model = fit(of("P")[0], unlabelled + labelled, prior)
    del labelled, unlabelled
    common.release()
    return model


def score(docs: DataFrame, model: Model, *, text_column="text", column="score") -> DataFrame:
    """docs with column, a double from 0 to 1; empty and null texts get the score of no words."""
    # the model holds at most FEATURES weights
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        own = held.value
        for texts in common.trimmed(batches):
            yield pd.Series([own.score(t) for t in texts], dtype="float64")
        own.memo.clear()  # the worker lives on

    return docs.withColumn(column, toxic(F.col(text_column)))


def held_out(column):
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % 3 == 1
