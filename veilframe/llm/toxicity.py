"""Toxicity: a support vector machine on a gapped subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import documents, stored
from veilframe.llm.tokens import MARKS
from veilframe.sources.tables import load

ORDER, DECAY = 3, 0.7      # length of the common subsequences, weight of each place they span
FLOOR = 0.3                # similarities below this count as none
TRAIN_DOCS = 8_000         # bound of the labelled sample that the classifier is fitted on
GRAMS = range(3, 13)       # characters of the parts of words that can become landmarks
SHARE = 0.5                # a landmark's least share of toxic documents
SURE, LIKELY = 18.0, 13.0  # least evidence of a landmark, and of one that is looked at again among uncovered documents
WIDTH = 32                 # longest piece of a word compared at once; longer words go in windows
WORDS_CACHED = 600_000
GROUP = 1 << 20            # characters of texts whose new words are compared together

_SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][\W_]{1,3}){3,}[^\W\d_](?![^\W\d_])")


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        out[i, :len(w)] = np.frombuffer(w[:width].encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Subsequence kernel of row pairs of padded code arrays: the sum over common
    subsequences of ORDER characters of DECAY to the places they span in both."""
    # pairs are the last axis, so every step runs over them side by side
    a, b = np.ascontiguousarray(a.T)[:, None, :], np.ascontiguousarray(b.T)[None, :, :]
    same = ((a == b) & (a != 0)) * np.float32(DECAY**2)
    d = same
    for _ in range(ORDER - 1):
        g = d.copy()
        for j in range(1, g.shape[0]):
            g[j] += DECAY * g[j - 1]
        for k in range(1, g.shape[1]):
            g[:, k] += DECAY * g[:, k - 1]
        d = np.zeros_like(g)
        np.multiply(same[1:, 1:], g[:-1, :-1], out=d[1:, 1:])
    return np.ascontiguousarray(d.transpose(2, 0, 1)).sum(axis=(1, 2), dtype=np.float64)


def similarity(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel of word i and landmark i; each string's own kernel is worked out once."""
    out = np.zeros(len(words))
    for i in range(0, len(words), 2000):
        sides = []
        for strings in (words[i:i + 2000], marks[i:i + 2000]):
            single, at = np.unique(np.array(strings, object), return_inverse=True)
            codes = _codes(list(single), max(map(len, strings)))
            sides.append((codes[at], kernel(codes, codes)[at]))
        (x, own_x), (y, own_y) = sides
        own = own_x * own_y
        out[i:i + 2000] = np.divide(kernel(x, y), np.sqrt(own), out=np.zeros(len(x)), where=own > 0)
    return out


def _letter_mask(word: str) -> int:
    m = 0
    for c in set(word):
        m |= 1 << (ord(c) % 61)
    return m


class LandmarkSimilarities:
    """Similarities of words to the landmarks, each distinct word once while cached."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.cache = landmarks, {}
        self.masks = np.array([_letter_mask(x) for x in landmarks], np.uint64)
        self.within: list[dict[int, bool]] = [{} for _ in landmarks]
        self.sizes = np.array([len(x) for x in landmarks], np.int64)
        self.none = np.zeros(2 * len(landmarks))
        self.codes = _codes(landmarks, max(self.sizes, default=0))
        self.own = kernel(self.codes, self.codes) if landmarks else np.zeros(0)
        # own kernel of a string by its length, at least: each place matches itself
        self.own_least = np.array([sum((n - span + 1) * (span - 2) * DECAY ** (2 * span) for span in range(ORDER, n + 1))
                                   for n in range(WIDTH + 1)])

    def _reachable(self, m: int, shared: np.ndarray) -> np.ndarray:
        """Whether pieces that share these letters with landmark m can be FLOOR alike. Common subsequences have
        shared letters only, so by Cauchy-Schwarz the similarity is at most the root of the share of
        the landmark's own kernel that its places with these letters give."""
        kinds, at = np.unique(shared, return_inverse=True)
        known = self.within[m]
        new = np.array([x for x in kinds.tolist() if x not in known], np.uint64)
        if len(new):
            row = self.codes[m, :self.sizes[m]]
            places = (np.uint64(1) << (row.astype(np.uint64) % np.uint64(61))) & new[:, None]
            part = np.where(places != 0, row, 0)
            for c in range(0, len(new), 1000):
                enough = kernel(part[c:c + 1000], part[c:c + 1000]) >= 0.999 * FLOOR**2 * self.own[m]
                known.update(zip(new[c:c + 1000].tolist(), enough.tolist(), strict=True))
        return np.array([known[x] for x in kinds.tolist()], bool)[at]

    def learn(self, words: Iterable[str]) -> None:
        owners: dict[str, list[str]] = {}
        for w in words:
            self.cache[w] = None
            s = w.strip(MARKS)
            if len(s) >= ORDER:
                owners.setdefault(s, []).append(w)
        pieces, core = [], []
        for s in owners:
            for at in range(0, max(1, len(s) - WIDTH // 2), WIDTH // 2):
                pieces.append(s[at:at + WIDTH])
                core.append(s)
        found: dict[str, np.ndarray] = {}
        for at in range(0, len(pieces), 20_000):
            for k, m, v, whole in zip(*self._compare(pieces[at:at + 20_000]), strict=True):
                best = found.get(core[at + k])
                if best is None:
                    best = found[core[at + k]] = np.zeros(2 * len(self.landmarks), np.float32)
                best[m] = max(best[m], v)
                best[len(self.landmarks) + m] = max(best[len(self.landmarks) + m], whole)
        for s, best in found.items():
            for w in owners[s]:
                self.cache[w] = best

    def _compare(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """(piece, landmark, similarity, whole) of all pairs that are at least FLOOR alike or whole: the piece holds as much of the landmark as the landmark itself."""
        flat = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(x) for x in pieces])
        starts = np.cumsum(sizes) - sizes
        masks = np.bitwise_or.reduceat(np.uint64(1) << (flat.astype(np.uint64) % np.uint64(61)), starts)
        letters, at = np.unique(masks, return_inverse=True)  # pieces of the same letters are told together
        p, m = np.nonzero(np.stack([self._reachable(m, letters & mask) for m, mask in enumerate(self.masks)], axis=1)[at])
        order = np.lexsort((self.sizes[m], sizes[p]))  # alike lengths together
        p, m = p[order], m[order]

        def codes(which: np.ndarray) -> np.ndarray:
            place = np.arange(sizes[which].max())
            inside = place < sizes[which][:, None]
            return np.where(inside, flat[np.where(inside, starts[which][:, None] + place, 0)], 0)

        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]
        for c in range(0, len(p), 1000):
            pp, mm = p[c:c + 1000], m[c:c + 1000]
            x = codes(pp)
            both = kernel(x, self.codes[mm, :self.sizes[mm].max()])
            whole = both >= 0.999 * self.own[mm]
            # the others are too far apart whatever the piece's own kernel is
            near = np.flatnonzero(whole | (both >= 0.999 * FLOOR * np.sqrt(self.own_least[sizes[pp]] * self.own[mm])))
            if len(near):
                v = both[near] / np.sqrt(kernel(x[near], x[near]) * self.own[mm[near]])
                keep = (v >= FLOOR) | whole[near]
                out.append((pp[near][keep], mm[near][keep], v[keep], whole[near][keep]))
        return tuple(np.concatenate(column) for column in zip(*out, strict=True))

    def of_texts(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """For each text, ``features``. New words are learned together for about GROUP characters of texts."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > WORDS_CACHED:
            self.cache.clear()
        parts = []
        for text in texts:
            text = text.lower()
            parts.append([*text.split(), *[re.sub(r"[\W_]+", "", x) for x in _SPELLED.findall(text)]])
        self.learn({w for words in parts for w in words if w not in self.cache})
        return [self.features(x) for x in parts]

    def features(self, words: list[str]) -> np.ndarray:
        """By landmark, the largest similarity of a word; then by landmark, how often words hold it whole, for
        every hundred words and on a log scale, which tells repeated use from one use."""
        alike = [v for v in map(self.cache.__getitem__, words) if v is not None]
        if not alike:
            return self.none
        alike, n = np.stack(alike), len(self.landmarks)
        return np.concatenate((alike[:, :n].max(axis=0), np.log1p(alike[:, n:].sum(axis=0) * (100 / max(20, len(words))))))


class ToxicityModel:
    """Landmarks, weights on a text's features (Nystroem map and SVM folded together), calibration."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.weights, self.bias, self.slope, self.shift = landmarks, weights, bias, slope, shift

    def margin(self, features: np.ndarray) -> float:
        return float(features @ self.weights) + self.bias

    def score(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margin) + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by gradient descent; y is +1 or -1."""
    w, b = np.zeros(x.shape[1]), 0.0
    total = cost.sum()
    rate = 1 / (ridge + 2 * ((x * x).sum(axis=1) + 1).max())
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * cost * y * (2 / total)
        w += rate * (slack @ x - ridge * w)
        b += rate * slack.sum()
    return w, float(b)


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    t = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        t += np.linalg.solve(h, x.T @ (y - p) - 1e-3 * t)
    return float(t[0]), float(t[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def grams(text: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of a text's words, GRAMS characters long: the text's characters, and of each distinct part
    a hash, the place where it starts, its length and how often it occurs."""
    chars = "\0".join(x.strip(MARKS) for x in text.lower().split()) + "\0"
    codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    at, h, out = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
    for k in range(1, GRAMS.stop):
        inside = codes[at + k - 1] != 0  # the last code is 0, so a part that goes on has a next place
        at = at[inside]
        h = h[inside] * np.uint64(0x9E3779B97F4A7C15) + codes[at + k - 1] + np.uint64(1)
        if k in GRAMS:
            out.append((h, at, np.full(len(at), k)))
    h, at, size = (np.concatenate(x) for x in zip(*out, strict=True))
    h, first, n = np.unique(h, return_index=True, return_counts=True)
    return chars, h.view(np.int64), at[first], size[first], n


def _sketch(text: str) -> int:
    words = {x.strip(MARKS) for x in text.lower().split()} - {""}
    low = sorted(zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in words)[:4]  # near copies share these
    return zlib.crc32(repr(low).encode())


def evidence(n: float, k: float, share: float) -> float:
    """Chernoff exponent: k or more toxic documents among n have a chance of at most exp(-evidence) at this share."""
    r = k / n if n else 0.0
    if r <= share:
        return 0.0
    return n * (r * math.log(r / share) + ((1 - r) * math.log((1 - r) / (1 - share)) if r < 1 else 0.0))


def find_landmarks(sample: DataFrame) -> list[str]:
    """Parts of words by which the sample's toxic documents stand out; near copies count once.

    A part's evidence is the better one of occurring in a document and of occurring there
    twice or more, so a stem counts over all its endings. The surest
    come first, longer ones among equals; one that the kernel finds alike to a chosen landmark, or that is a part of it, is left out. Then, until
    none has enough evidence left among the documents without a chosen part, the surest there are added, alike or not.
    """
    @F.pandas_udf("long")
    def sketch(text: pd.Series) -> pd.Series:
        return text.map(_sketch).astype("int64")

    single = stored(sample.groupBy(sketch("text").alias("sketch")).agg(F.min_by("text", "doc_id").alias("text"), F.avg("toxic").alias("toxic")), "toxic-single")
    total, pos = single.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    share = pos / total
    if not 0 < share < 1:
        return []

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def summed(parts: list) -> pd.DataFrame:
            h, n, y = (np.concatenate(x) for x in zip(*parts, strict=True))
            gram, at = np.unique(h, return_inverse=True)
            twice = n > 1
            return pd.DataFrame({"gram": gram, "n1": np.bincount(at, minlength=len(gram)), "k1": np.bincount(at, y, len(gram)),
                                 "n2": np.bincount(at, twice, len(gram)).astype(np.int64), "k2": np.bincount(at, twice * y, len(gram))})

        parts, size = [], 0
        for b in batches:
            for text, y in zip(b["text"], b["toxic"], strict=True):
                _, h, _, _, n = grams(text)
                parts.append((h, n, np.full(len(h), y, float)))
                size += len(h)
                if size >= GROUP:
                    yield summed(parts)
                    parts, size = [], 0
        if parts:
            yield summed(parts)

    def sure(n: str, k: str) -> Column:
        r = F.col(k) / F.col(n)
        rest = F.when(r < 1, (1 - r) * F.log((1 - r) / (1 - share))).otherwise(0.0)
        return (r >= SHARE) & (r > share) & (F.col(n) * (r * F.log(r / share) + rest) >= LIKELY)

    counts = single.mapInPandas(count, "gram long, n1 long, k1 double, n2 long, k2 double").groupBy("gram").agg(
        *[F.sum(c).alias(c) for c in ("n1", "k1", "n2", "k2")])
    likely = np.sort(np.array([r["gram"] for r in counts.where(sure("n1", "k1") | ((F.col("n2") > 0) & sure("n2", "k2"))).select("gram").collect()], np.int64))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text, y in zip(b["sketch"], b["text"], b["toxic"], strict=True):
                chars, h, at, size, n = grams(text)
                own = np.flatnonzero(np.isin(h, likely))
                yield pd.DataFrame({"part": pd.Series([chars[at[i]:at[i] + size[i]] for i in own], dtype=object), "sketch": key, "toxic": y, "n": n[own]})

    held: dict[tuple[str, int], dict[int, float]] = {}
    for r in single.mapInPandas(places, "part string, sketch long, toxic double, n long").collect() if len(likely) else []:
        for least in range(1, min(2, r["n"]) + 1):
            held.setdefault((r["part"], least), {})[r["sketch"]] = r["toxic"]
    held = {event: docs for event, docs in held.items()
            if sum(docs.values()) >= SHARE * len(docs) and evidence(len(docs), sum(docs.values()), share) >= LIKELY}

    def rank(event: tuple[str, int], left: dict[int, float], rate: float) -> tuple:
        return -evidence(len(left), sum(left.values()), rate), -len(event[0]), event

    chosen: list[str] = []
    covered: dict[int, float] = {}
    for worth, _, event in sorted(rank(event, docs, share) for event, docs in held.items()):
        if -worth >= SURE and not any(event[0] in c for c in chosen) and (
                not chosen or similarity([event[0]] * len(chosen), chosen).max() < FLOOR):
            chosen.append(event[0])
            covered |= held[event]
    while len(covered) < total and (rate := (pos - sum(covered.values())) / (total - len(covered))) > 1e-9:
        worth, _, event = min((rank(event, {d: y for d, y in docs.items() if d not in covered}, rate) for event, docs in held.items()), default=(0.0, 0, None))
        if -worth < SURE:
            break
        chosen += [event[0]] * (event[0] not in chosen)
        covered |= held[event]
    return chosen


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Fit on at most ``train_docs`` labelled documents outside the held-out fifth, taken
    by the smallest hash of their ids.

    The features of a document are its words' similarities to ``find_landmarks``, and how often
    words hold a landmark. Without labels of both classes the model gives every text 0.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    sample = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(some, "doc_id"), "toxic-sample")
    n, pos = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not pos or pos == n:
        return ToxicityModel([], np.zeros(0), 0.0, 0.0, -30.0)
    landmarks = find_landmarks(sample)
    if not landmarks:
        return ToxicityModel([], np.zeros(0), 0.0, 0.0, float(np.log(pos / (n - pos))))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sims = LandmarkSimilarities(landmarks)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "x": [x.tolist() for x in sims.of_texts(b["text"])]})

    rows = sample.select("doc_id", "text", "toxic").mapInPandas(features, "doc_id long, toxic int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows])
    pairs = [(a, b) for a in landmarks for b in landmarks]
    gram = similarity([a for a, _ in pairs], [b for _, b in pairs]).reshape(len(landmarks), -1)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = np.eye(2 * len(landmarks))
    # Nystroem map: similarities times the Gram matrix's inverse root
    root[:len(landmarks), :len(landmarks)] = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    w, b = _svm(x @ root, sign, cost)
    model = ToxicityModel(landmarks, root @ w, b, 1.0, 0.0)
    model.slope, model.shift = _calibrate(x @ model.weights + b, y.astype(float))
    return model


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Score of a text, 0 to 1; null counts as empty."""
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sims = LandmarkSimilarities(model.landmarks)
        for b in batches:
            found = sims.of_texts(t or "" for t in b) if model.landmarks else (np.zeros(0) for _ in b)
            yield pd.Series(model.score([model.margin(x) for x in found]), dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Only texts and, outside the held-out fifth, labels are inputs. Null and empty texts score
    like a text without any word like a landmark; repeated rows score alike; null ids are
    scored but never learned from; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(docs, labels, train_docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark, sf_dir) -> DataFrame:
    return toxicity(documents(spark, sf_dir), load(spark, sf_dir, "labels"))
