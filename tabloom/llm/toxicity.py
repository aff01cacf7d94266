"""Toxicity scores: gradient-boosted trees over dense features, isotonically calibrated.

Features of a whole text: densities of a fixed lexicon and of stems learned
from the training labels, second-person words and their proximity to hits,
capitals, punctuation, and obfuscation (digits or signs inside words, and hits
that show once they are undone).

Training uses a bounded sample of labelled rows (``max_positive`` and
``max_negative``, by a hash of doc_id, so reruns agree).  Stems are chosen by
greedy cover of the positive texts; features for fitting the trees come from
stems of the other folds, and calibration from out-of-fold margins, so neither
sees its own rows.  Scoring is one pass over all texts without a shuffle; the
model (stems, trees, calibration; some kB) goes with the function.

Labels, lang, source and doc_id are never inputs of a score.
Defined results: null text counts as empty and is scored; without labels of
both kinds every score is the share of positives (0 if none); repeated rows
score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, whole_text

#: Insults in four languages; fixed values.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb trash scum loser losers worthless pathetic disgusting clown clowns fool fools jerk bastard"
    " idioten dumm dummkopf trottel abschaum arschloch versager widerlich erbärmlich wertlos depp"
    " imbécile crétin débile connard ordure minable pathétique dégoûtant abruti"
    " idiota imbécil estúpido estúpida basura escoria perdedor patético asqueroso tonto".split()
)
#: Second-person words in four languages; fixed values.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
UNDO = str.maketrans("0134578@$!", "oieastbasi")
MIXED = re.compile(rb"[a-z][0-9@$*!.\-_]+[a-z]")
MIXED_TOKEN = re.compile(r"\S*[a-z][0-9@$*!.\-_]+[a-z]\S*")
_CLEAN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
FEATURES = 18
STEM_SIZES = range(4, 9)
#: Words that a worker remembers as free of hits.
REMEMBERED = 400_000


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()


class Lexicon:
    """Learned stems (a word's beginning) and words, and the fixed lexicon."""

    def __init__(self, stems=(), words=()):
        self.by_size = {}
        for s in stems:
            self.by_size.setdefault(len(s), set()).add(s)
        self.words = frozenset(words)
        self.clean: set[bytes] = set()
        self.fixed = frozenset(w.encode() for w in LEXICON)
        self.second = frozenset(w.encode() for w in SECOND)

    def stem(self, word: bytes):
        """The entry that a word meets, or None."""
        if word in self.words:
            return word
        try:
            w = word.decode()
        except UnicodeDecodeError:
            return None
        for n, stems in self.by_size.items():
            if w[:n] in stems:
                return w[:n]
        return None

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = words_of(text)
        n = len(words)
        unseen = set(words)
        new = unseen - self.clean
        known, fixed = {}, set()
        for w in new:
            s = self.stem(w)
            if w in self.fixed:
                fixed.add(w)
            if s is not None:
                known[w] = s
        for w in fixed | known.keys():
            new.discard(w)
        if len(self.clean) > REMEMBERED:
            self.clean = set()
        self.clean |= new
        hits = [i for i, w in enumerate(words) if w in known] if known else []
        fixed_hits = sum(map(words.count, fixed)) if len(fixed) < 20 else sum(w in fixed for w in words)
        second = self.second & unseen
        at_second = [i for i, w in enumerate(words) if w in second] if second else []
        near = 0
        if hits and at_second:
            where = np.searchsorted(at_second, hits)
            s = np.array(at_second)
            left = np.abs(s[np.maximum(where - 1, 0)] - hits)
            right = np.abs(s[np.minimum(where, len(s) - 1)] - hits)
            near = int((np.minimum(left, right) <= 6).sum())
        h = np.array(hits)
        dense = int((np.searchsorted(h, h + 20) - np.arange(len(h))).max()) if hits else 0
        low = text.lower()
        mixed, undone = 0, 0
        raw = low.encode("utf-8", "surrogatepass")
        if MIXED.search(raw):
            for token in MIXED_TOKEN.findall(low):
                mixed += 1
                plain = re.sub(r"[^\w]|_", "", token.translate(UNDO)).encode("utf-8", "surrogatepass")
                undone += plain in self.fixed or self.stem(plain) is not None
        chars = max(1, len(text))
        # A capital changes when the text is lowered; comparing whole texts is one pass in C.
        lowered = np.frombuffer(raw, np.uint8)
        own = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        capitals = int((own != lowered).sum()) if len(own) == len(lowered) else sum(c.isupper() for c in text)
        per = 1000 / max(1, n)
        marks = sum(map(text.count, "!?"))
        return [
            np.log1p(len(hits) * per),
            np.log1p(len(hits)),
            np.log1p(fixed_hits * per),
            np.log1p(fixed_hits),
            len({known[words[i]] for i in hits}),
            near,
            np.log1p(len(at_second) * per),
            dense,
            capitals / chars,
            text.count("!") / chars,
            text.count("?") / chars,
            (text.count("!!") + text.count("??")) / max(1, marks),
            np.log1p(mixed * per),
            undone,
            sum(map(len, words)) / max(1, n),
            np.log1p(n),
            sum(map(text.count, "#*$%&|<>")) / chars,
            len(unseen) / max(1, n),
        ]


def learn_lexicon(texts: list[set[bytes]], y: np.ndarray, least: int = 2, most: int = 300) -> Lexicon:
    """Stems and words of positive texts that negative texts hardly have; greedy cover, longest on ties."""
    positive = [t for t, v in zip(texts, y) if v]
    negative = [t for t, v in zip(texts, y) if not v]

    def entries(t: set[bytes]) -> set:
        out: set = set(t)
        for w in t:
            try:
                s = w.decode()
            except UnicodeDecodeError:
                continue
            out.update(s[:k] for k in STEM_SIZES if len(s) >= k)
        return out

    have = Counter()
    for t in positive:
        have.update(entries(t))
    have = {e: n for e, n in have.items() if n >= least}
    against = Counter()
    for t in negative:
        against.update(e for e in entries(t) if e in have)
    share = max(1, len(negative)) / max(1, len(positive))
    good = {e for e, n in have.items() if against[e] * 20 <= n * share and against[e] <= max(1, 0.003 * len(negative))}
    of = {}
    for k, t in enumerate(positive):
        for e in entries(t):
            if e in good:
                of.setdefault(e, set()).add(k)
    stems, words, left = [], [], set(range(len(positive)))
    while left and of and len(stems) + len(words) < most:
        best = max(of, key=lambda e: (len(of[e]), len(e), str(e)))
        got = of[best]
        if len(got) < least:
            break
        (words if isinstance(best, bytes) else stems).append(best)
        left -= got
        got = set(got)
        of = {e: v for e, s in of.items() if (v := s - got)}
    return Lexicon(stems, words)


class Trees:
    """Gradient-boosted trees of fixed depth for the logistic loss, over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, leaf: float = 1.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self._bins(x)
        w = np.ones(len(y)) if weight is None else weight / weight.mean()  # ``leaf`` counts sampled rows
        mean = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.start, self.trees, self.depth = float(np.log(mean / (1 - mean))), [], depth
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), w * p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                best = np.full(1 << level, -1e-9), np.zeros(1 << level, np.int64), np.full(1 << level, bins, np.int64)
                for j in range(x.shape[1]):
                    at = node * bins + b[:, j]
                    gs = np.bincount(at, g, (bins << level)).reshape(-1, bins).cumsum(1)
                    hs = np.bincount(at, h, (bins << level)).reshape(-1, bins).cumsum(1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + leaf) + (ga - gs) ** 2 / (ha - hs + leaf) - ga**2 / (ha + leaf)
                    k = gain[:, :-1].argmax(1)
                    v = gain[np.arange(len(k)), k]
                    up = v > best[0] + 1e-9
                    best[0][up], best[1][up], best[2][up] = v[up], j, k[up]
                splits.append((best[1], best[2]))
                node = node * 2 + (b[np.arange(len(y)), best[1][node]] > best[2][node])
            value = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + leaf)
            self.trees.append((splits, value))
            f += value[node]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f, row = self._bins(x), np.full(len(x), self.start), np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for j, cut in splits:
                node = node * 2 + (b[row, j[node]] > cut[node])
            f += value[node]
        return f


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (margin, probability) knots of a non-decreasing curve."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weighted sum, weight, first, last
    w = np.ones(len(y)) if weight is None else weight
    for m, v, n in zip(margin[order], y[order], w[order]):
        blocks.append([float(v * n), float(n), m, m])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    xs = np.array([e for b in blocks for e in (b[2], b[3])])
    return xs, np.repeat([b[0] / b[1] for b in blocks], 2)


class Model:
    """Lexicon, trees and calibration; or a constant where labels of both kinds are missing."""

    def __init__(self, texts: list[str], y: np.ndarray, weight: np.ndarray | None = None, folds: int = 3, seed: int = 11):
        w = np.ones(len(y)) if weight is None else weight
        self.constant = float(np.average(y, weights=w)) if len(y) else 0.0
        self.trees = None
        if len(y) < 6 or y.sum() < 3 or y.sum() > len(y) - 3:
            return
        sets = [set(words_of(t)) for t in texts]
        # Equal texts share a fold, so that none is judged by what its copy taught.
        fold = np.array([zlib.crc32(b" ".join(sorted(s)), seed) % folds for s in sets])
        x, margin = np.zeros((len(y), FEATURES)), np.zeros(len(y))
        for k in range(folds):
            own = fold == k
            lex = learn_lexicon([s for s, o in zip(sets, own) if not o], y[~own])
            for i in np.flatnonzero(own):
                x[i] = lex.features(texts[i])
        for k in range(folds):
            own = fold == k
            if own.any() and 0 < y[~own].sum() < (~own).sum():
                margin[own] = Trees(x[~own], y[~own], w[~own]).margin(x[own])
        self.trees = Trees(x, y, w)
        self.curve = isotonic(margin, y, w)
        self.lexicon = learn_lexicon(sets, y)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.constant)
        x = np.array([self.lexicon.features(t) for t in texts])
        return np.clip(np.interp(self.trees.margin(x), *self.curve), 0, 1)


def _score(batches, model: Model, threshold: float):
    for batch in batches:
        s = model.scores([t.as_py() for t in batch["text"]])
        held = [d is not None and zlib.crc32(str(d).encode()) % 3 == 1 for d in batch["doc_id"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "held_out": pa.array(held, pa.bool_()), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))})


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int, max_negative: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of the bounded sample; never rows that are held out.

    The weights give both classes the share that they have among all usable labels.
    """
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    usable = usable.select(F.col("doc_id").cast("long").alias("__doc"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    some = [usable.where(F.col("toxic") == v).orderBy(F.xxhash64("__doc"), "__doc").limit(n) for v, n in ((1, max_positive), (0, max_negative))]
    count = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = {v: max(1.0, count.get(v, 0) / n) if n else 1.0 for v, n in ((1, max_positive), (0, max_negative))}
    sample = F.broadcast(some[0].union(some[1]))  # max_positive + max_negative rows at most
    rows = docs.select("doc_id", whole_text().alias("text")).join(sample, F.col("doc_id").cast("long") == F.col("__doc")).select("doc_id", "text", "toxic").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows], float), np.array([weight[r["toxic"]] for r in rows], float)


def score_documents(docs: DataFrame, labels: DataFrame, max_positive: int = 1500, max_negative: int = 3000, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    ship_package(docs.sparkSession)
    model = Model(*training_rows(docs, labels, max_positive, max_negative))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_score, model=model, threshold=threshold), "doc_id long, held_out boolean, score double, predicted int")
