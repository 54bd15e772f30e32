"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the scaled sum of hashed embeddings of the word itself and
of its character 4- to 6-grams, so unseen inflections of a known word are known
too. Filters of width 1, 2 and 3 slide over all words of a text; their largest
values feed one linear unit. Training starts the first embedding coordinate at a
feature's smoothed log-odds and then follows gradients (Adam) through the
winning positions. Thresholds are calibrated by language on labelled rows that
were not trained on; the language is told from the text's own function words,
never from a column. A calibrated threshold is mapped to a score of 0.7.

Every labelled row that is open to training is used, with its whole text, in one
of two ways: three quarters of them give counts (added up over all) and gradients,
one quarter thresholds. Gradients are followed in parts of ``PART`` rows or so, side
by side, from the same model; after each round the parts' changes are averaged
(iterative parameter mixing). Parts and order come from a hash of the id, and
changes are added as integers, so that a model doesn't depend on the cluster.
Thresholds come from a histogram of all their rows in steps of 1 / ``STEPS``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace

WORD = re.compile(r"[^\W_]+")
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 4
#: Words of more characters are read piece by piece.
LONG = 1 << 14
#: Words whose features are found together, by number and by characters.
TOGETHER = 1 << 14
CUT = float(np.log(0.7 / 0.3))
#: Rows in a part, rounds of training, rows and characters of a step.
PART, ROUNDS, STEP, STEP_CHARS = 4096, 2, 64, 1 << 21
#: Steps of a histogram's logit, its largest logit, and the unit in which changes are added.
STEPS, TOP, UNIT = 256, 40, 1 << 36
#: Ids for a word of the filter of labelled ids or so, and most words of it (8 bytes each).
PER_WORD, MOST_WORDS = 4, 1 << 20
#: Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": {"the", "and", "of", "to", "that", "was", "with", "for", "are", "this"},
    "de": {"der", "die", "und", "das", "von", "mit", "nicht", "ist", "auf", "für"},
    "fr": {"le", "les", "des", "et", "est", "pour", "dans", "une", "sur", "que"},
    "es": {"el", "los", "las", "del", "con", "para", "por", "una", "se", "y"},
}
_TONGUE = {w: i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def tongue(words: list[str]) -> int:
    """Index in LANGUAGES of the language whose function words are most frequent."""
    n = [0] * len(FUNCTION_WORDS)
    for w in words:
        if (k := _TONGUE.get(w)) is not None:
            n[k] += 1
    return int(np.argmax(n)) if any(n) else len(n)


def features(word: str) -> list[int]:
    """Buckets of a word and of its character 4- to 6-grams, word ends marked."""
    b = f"^{word}$".encode()
    found = [zlib.crc32(b, 1)]
    for n in (4, 5, 6):
        found += [zlib.crc32(b[i : i + n]) for i in range(len(b) - n + 1)]
    return [x % BUCKETS for x in found]


# CRC-32 is linear: a byte's share depends on the byte and on how many follow it.
_EMPTY = [zlib.crc32(bytes(n)) for n in range(7)]
_SHARE = np.array([[zlib.crc32(bytes([b]) + bytes(k)) ^ _EMPTY[k + 1] for b in range(256)] for k in range(6)], np.uint32)


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of all words one after the other (in another order within a word), and their numbers."""
    marked = [f"^{w}$".encode() for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    b = np.frombuffer(b"".join(marked), np.uint8)
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(b))
    found = np.full((len(b), 4), -1, np.int32)
    found[end - size, 0] = np.fromiter((zlib.crc32(x, 1) for x in marked), np.uint32, len(marked)) % np.uint32(BUCKETS)
    for j, n in enumerate((4, 5, 6), 1):
        if len(b) >= n:
            crc = np.full(len(b) - n + 1, _EMPTY[n], np.uint32)
            for i in range(n):
                crc ^= _SHARE[n - 1 - i][b[i : len(b) - n + 1 + i]]
            found[: len(crc), j] = np.where(left[: len(crc)] >= n, (crc % np.uint32(BUCKETS)).astype(np.int32), -1)
    return found[found >= 0], 1 + sum(np.maximum(size - n + 1, 0) for n in (4, 5, 6))


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # a width x DIM x FILTERS array for each width
    head: np.ndarray  # len(WIDTHS) * FILTERS
    bias: float
    cuts: np.ndarray  # logit of the threshold for each language

    def table(self, words: list[str]) -> np.ndarray:
        """A row for each word: what it adds to each filter at each offset."""
        if any(len(w) > LONG for w in words):  # one by one, so that their features aren't held together
            return np.concatenate([self._long(w) if len(w) > LONG else self.table([w]) for w in words])
        if len(words) > TOGETHER or sum(map(len, words)) > 16 * TOGETHER and len(words) > 1:
            half = len(words) // 2
            return np.concatenate([self.table(words[:half]), self.table(words[half:])])
        flat, n = buckets(words)
        e = np.add.reduceat(self.embed[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
        return np.concatenate([e @ f[j] for f in self.filters for j in range(len(f))], axis=1).astype(np.float32)

    def _long(self, word: str) -> np.ndarray:
        """The row of a word whose features are summed piece by piece."""
        b = f"^{word}$".encode()
        e, n = self.embed[zlib.crc32(b, 1) % BUCKETS].copy(), 1
        for size in (4, 5, 6):
            for at in range(0, len(b) - size + 1, LONG):
                flat = [zlib.crc32(b[i : i + size]) % BUCKETS for i in range(at, min(at + LONG, len(b) - size + 1))]
                e, n = e + self.embed[flat].sum(axis=0), n + len(flat)
        e = e[None] / np.sqrt(n)
        return np.concatenate([e @ f[j] for f in self.filters for j in range(len(f))], axis=1).astype(np.float32)

    def logit(self, t: np.ndarray) -> float:
        """``t``: the table's rows of a text's words in order."""
        pooled, at = np.zeros(len(self.head)), 0
        for i, f in enumerate(self.filters):
            k = len(f)
            if len(t) >= k:
                s = t[: len(t) - k + 1, at : at + FILTERS]
                for j in range(1, k):
                    s = s + t[j : len(t) - k + 1 + j, at + j * FILTERS : at + (j + 1) * FILTERS]
                pooled[i * FILTERS : (i + 1) * FILTERS] = np.maximum(s.max(axis=0), 0)
            at += k * FILTERS
        return float(pooled @ self.head + self.bias)


def _blank(rng) -> Model:
    filters = [rng.normal(0, 0.05, (k, DIM, FILTERS)) for k in WIDTHS]
    for f in filters:
        f[:, 0] += 1 / len(f)
    return Model(rng.normal(0, 0.02, (BUCKETS, DIM)), filters, np.full(len(WIDTHS) * FILTERS, 0.3), -2.0, np.zeros(len(LANGUAGES)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, name, x, g, rows=None):
        m, v = self.state.setdefault(name, (np.zeros_like(x), np.zeros_like(x)))
        k = slice(None) if rows is None else rows
        m[k] = 0.9 * m[k] + 0.1 * g
        v[k] = 0.999 * v[k] + 0.001 * g * g
        x[k] -= self.rate * (m[k] / (1 - 0.9**self.t)) / (np.sqrt(v[k] / (1 - 0.999**self.t)) + 1e-8)


def _tally(docs) -> np.ndarray:
    """Rows (documents of class 0, of class 1) for each bucket, and last for all, of (words, toxic)."""
    seen, docs = np.zeros((2, BUCKETS + 1), np.int64), iter(docs)
    while some := list(islice(docs, STEP)):
        place = {w: i for i, w in enumerate(set().union(*(d for d, _ in some)))}
        words = list(place)
        found = [buckets(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        flat, n = (np.concatenate(x) for x in zip(*found, strict=True))
        start = np.cumsum(n) - n
        for d, y in some:
            x = np.fromiter(map(place.__getitem__, set(d)), np.int64)
            m, held = n[x], np.zeros(BUCKETS + 1, bool)
            held[flat[np.repeat(start[x] - np.cumsum(m) + m, m) + np.arange(m.sum())]] = True
            held[-1] = True
            seen[y] += held
    return seen.T


def _started(seen: np.ndarray, seed: int = 7) -> tuple[Model, float]:
    """The model that counts alone give, and the weight of class 1; 0 if there is but one class."""
    model, (n0, n1) = _blank(np.random.default_rng(seed)), seen[-1].tolist()
    if not n0 or not n1:
        model.head[:] = 0.0
        model.cuts[:] = CUT
        return model, 0.0
    seen = seen[:-1].T
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    model.embed[:, 0] = np.clip(odds, -3, 6) * ((seen.sum(axis=0) >= 2) & (seen[1] >= 1))
    return model, n0 / n1


def _step(model: Model, adam: _Adam, docs: list[list[str]], y: list[int], weight: float) -> None:
    """Follow the gradient of some documents."""
    words = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    if not words:
        return
    flat, n = buckets(list(words))
    start = np.cumsum(n) - n
    e = np.add.reduceat(model.embed[flat], start, axis=0) / np.sqrt(n)[:, None]
    gf, gh, gb = [np.zeros_like(f) for f in model.filters], np.zeros_like(model.head), 0.0
    ge = np.zeros_like(e)
    of = [[e @ f[j] for j in range(len(f))] for f in model.filters]
    for d, truth in zip(docs, y, strict=True):
        x = np.fromiter(map(words.__getitem__, d), np.int64, len(d))
        pooled, won = np.zeros(len(model.head)), []
        for a, f in enumerate(model.filters):
            k = len(f)
            if len(x) < k:
                won.append(None)
                continue
            s = sum(of[a][j][x[j : len(x) - k + 1 + j]] for j in range(k))
            p = s.argmax(axis=0)
            won.append(p)
            pooled[a * FILTERS : (a + 1) * FILTERS] = np.maximum(s[p, np.arange(FILTERS)], 0)
        z = pooled @ model.head + model.bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - truth) * (weight if truth else 1.0) / len(docs)
        gb += g
        gh += g * pooled
        for a, p in enumerate(won):
            if p is None:
                continue
            h = slice(a * FILTERS, (a + 1) * FILTERS)
            to = g * model.head[h] * (pooled[h] > 0)
            for j in range(len(model.filters[a])):
                w = x[p + j]
                gf[a][j] += e[w].T * to
                np.add.at(ge, w, (model.filters[a][j] * to).T)
    adam.t += 1
    hit = np.flatnonzero(np.abs(ge).sum(axis=1))
    if len(hit):
        inner = np.arange(n[hit].sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
        u, inverse = np.unique(flat[np.repeat(start[hit], n[hit]) + inner], return_inverse=True)
        own = np.repeat(ge[hit] / np.sqrt(n[hit])[:, None], n[hit], axis=0)
        g = np.stack([np.bincount(inverse, own[:, i], len(u)) for i in range(DIM)], axis=1)
        adam.step("embed", model.embed, g, u)
    for a, f in enumerate(model.filters):
        adam.step(a, f, gf[a])
    adam.step("head", model.head, gh)
    model.bias -= 0.05 * gb


def _learn(model: Model, docs, weight: float) -> tuple[Model, int]:
    """A copy of the model that has followed the gradients of all (words, toxic) in order, and their number."""
    model = Model(model.embed.copy(), [f.copy() for f in model.filters], model.head.copy(), model.bias, model.cuts.copy())
    adam, some, chars, count = _Adam(0.01), [], 0, 0
    for words, y in docs:
        some.append((words, y))
        count, chars = count + 1, chars + sum(map(len, words))
        if len(some) == STEP or chars > STEP_CHARS:
            _step(model, adam, *zip(*some, strict=True), weight)
            some, chars = [], 0
    if some:
        _step(model, adam, *zip(*some, strict=True), weight)
    return model, count


def _dense(model: Model) -> np.ndarray:
    return np.concatenate([*(f.ravel() for f in model.filters), model.head, [model.bias]])


def _changes(before: Model, after: Model, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose row changed, -1 for the rest of the model; and rows (count, count times the change in units) as integers."""
    moved = np.flatnonzero((before.embed != after.embed).any(axis=1))
    rest = np.zeros((-(-len(_dense(before)) // DIM), DIM))
    rest.ravel()[: len(_dense(before))] = _dense(after) - _dense(before)
    rows = np.concatenate([after.embed[moved] - before.embed[moved], rest])
    change = np.rint(rows * UNIT).astype(np.int64) * count
    return np.concatenate([moved, -1 - np.arange(len(rest))]), np.column_stack([np.full(len(rows), count), change])


def _mixed(model: Model, at: np.ndarray, sums: np.ndarray) -> None:
    """Move the model by the average of the changes of those parts that changed a row, by their numbers of rows."""
    mean = sums[:, 1:] / UNIT / sums[:, :1]
    model.embed[at[at >= 0]] += mean[at >= 0]
    order = np.argsort(-at[at < 0])
    rest, i = mean[at < 0][order].ravel(), 0
    for x in (*model.filters, model.head):
        x += rest[i : i + x.size].reshape(x.shape)
        i += x.size
    model.bias += float(rest[i])


def _bin(z: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(z, -TOP, TOP) * STEPS).astype(np.int64)


def _calibrate(model: Model, rows: np.ndarray) -> None:
    """``rows``: (language, bin of the logit, rows of class 0, rows of class 1)."""
    common = _threshold(rows, 0.0)
    for k in range(len(LANGUAGES)):
        own = rows[rows[:, 0] == k]
        model.cuts[k] = _threshold(own, common) if own[:, 3].sum() >= 20 else common


def _threshold(rows: np.ndarray, default: float) -> float:
    """The middle of the gap with the best F1."""
    if not rows[:, 2].sum() or not rows[:, 3].sum():
        return default
    at, of = np.unique(-rows[:, 1], return_inverse=True)
    n0, n1 = (np.bincount(of, rows[:, i], len(at)) for i in (2, 3))
    s, hits = -at / STEPS, np.cumsum(n1)
    f1 = 2 * hits / (np.cumsum(n0 + n1) + n1.sum())
    gaps = np.append(s[:-1] - s[1:], 1.0)
    best = max(np.flatnonzero(f1 >= f1.max() - 1e-9), key=lambda i: gaps[i])
    return float(s[best] - gaps[best] / 2)


def train(texts: list[str], toxic: list[int], holdback: list[bool], epochs: int = ROUNDS) -> Model:
    """Fit on rows that aren't held back, calibrate thresholds on all others; one part."""
    docs = [(WORD.findall(t.lower()), int(y)) for t, y in zip(texts, toxic, strict=True)]
    fit = [d for d, h in zip(docs, holdback, strict=True) if not h]
    model, weight = _started(_tally(fit))
    if weight:
        for _ in range(epochs):
            model = _learn(model, fit, weight)[0]
        _calibrate(model, np.array([(tongue(d), _bin(model.logit(model.table(d)) if d else model.bias), 1 - y, y) for (d, y), h in zip(docs, holdback, strict=True) if h]).reshape(-1, 4))
    return model


def _rows(batches):
    """(part, (words, toxic)) of rows (part, toxic, text)."""
    for batch in batches:
        for part, y, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            yield part.as_py(), (WORD.findall(text.as_py().lower()), y.as_py())


def _integers(at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(at.astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=["at", *(f"x{i}" for i in range(rows.shape[1]))])


def _tallied():
    def run(batches):
        seen = _tally(d for _, d in _rows(batches))
        at = np.flatnonzero(seen.any(axis=1))
        yield _integers(at, seen[at])

    return run


def _learned(model: Model, weight: float):
    """Rows sorted by part: the changes of each part."""

    def run(batches):
        for _, docs in groupby(_rows(batches), lambda r: r[0]):
            yield _integers(*_changes(model, *_learn(model, (d for _, d in docs), weight)))

    return run


def _binned(model: Model):
    """Rows (toxic, text): the histogram (at, x0, x1), ``at`` made of language and bin."""

    def run(batches):
        known, seen = _Known(model), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                z, lang = known.logits(part.column(1).to_pylist())
                seen.update(zip((lang * 4 * TOP * STEPS + _bin(z)).tolist(), part.column(0).to_pylist(), strict=True))
        at = np.array(sorted({a for a, _ in seen}), np.int64)
        yield _integers(at, np.array([[seen[a, 0], seen[a, 1]] for a in at.tolist()], np.int64).reshape(-1, 2))

    return run


def _summed(found: DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (at, x0, ...) added up by ``at``; their number is bounded by the model's size."""
    sums = found.groupBy("at").agg(*(F.sum(f"x{i}").alias(f"x{i}") for i in range(columns))).toArrow().sort_by("at")
    return sums.column(0).to_numpy(), np.column_stack([sums.column(i + 1).to_numpy() for i in range(columns)])


def _likely(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The ``rows`` with an id of ``known``, and some others: a bit for each id's hash tells, in a filter of bounded size.

    So the join moves few texts without a label. Ids of two types are left to the join.
    """
    if rows.schema["doc_id"].dataType != known.schema["doc_id"].dataType:
        return rows
    words = min(MOST_WORDS, 1 << (known.count() // PER_WORD).bit_length())
    at = f"pmod(xxhash64(doc_id), {64 * words}L)"
    word, bit = f"cast(shiftright({at}, 6) as int)", f"cast({at} & 63 as int)"
    found = known.groupBy(F.expr(word).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy()
    one = rows.sparkSession.createDataFrame(pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))}))
    return rows.join(F.broadcast(one), F.expr(f"shiftright(get(bits, {word}), {bit}) & 1 = 1"), "left_semi")


CACHE_WORDS = 200_000


class _Known:
    """Logits of texts by a model; rows of the words met so far are kept, up to ``CACHE_WORDS`` or so."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.rows, self.tongues = np.zeros((0, sum(WIDTHS) * FILTERS), np.float32), np.zeros(0, np.int64)

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The logit and the language of each text."""
        docs = [WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.place) > CACHE_WORDS:
            self.__init__(self.model)
        place, none = self.place, len(FUNCTION_WORDS)
        if new := list(set().union(*docs).difference(place)):
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.model.table(new)])
            self.tongues = np.concatenate([self.tongues, np.array([_TONGUE.get(w, none) for w in new])])
        z, lang = np.full(len(docs), self.model.bias), np.full(len(docs), none)
        for i, d in enumerate(docs):
            if d:
                x = np.fromiter(map(place.__getitem__, d), np.int64, len(d))
                z[i] = self.model.logit(self.rows[x])
                n = np.bincount(self.tongues[x], minlength=none + 1)[:none]
                lang[i] = n.argmax() if n.any() else none
        return z, lang


def _score(model: Model):
    def run(batches):
        known = _Known(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                z, lang = known.logits(part.column(part.num_columns - 1).to_pylist())
                out = 1 / (1 + np.exp(-np.clip(z - model.cuts[lang] + CUT, -40, 40)))
                yield pa.record_batch([*part.columns[:-1], pa.array(out, pa.float64())], names=[*part.schema.names[:-1], "score"])

    return run


class ToxicityClassifier:
    """Fits on labelled texts and scores whole texts."""

    def __init__(self, rounds: int = ROUNDS):
        self.rounds, self.model = rounds, None

    def fit(self, docs: DataFrame, labels: DataFrame) -> ToxicityClassifier:
        """docs (doc_id, text), labels (doc_id, toxic). Rows without id or label are not used, all others are; without labels of both kinds all texts score alike."""
        work = Workspace(docs.sparkSession, "toxicity")
        # an id with two labels counts as toxic
        known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        known = work.keep(known, "known")
        # one plan at all sizes: a join by broadcast would end where labels get many
        rows = _likely(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), known).join(known.hint("merge"), "doc_id")
        hold = F.floor(F.crc32(F.col("doc_id").cast("string")) / 3) % 4 == 0
        rows = work.keep(rows.select("toxic", "text", hold.alias("hold"), F.xxhash64(F.col("doc_id").cast("string")).alias("of")), "labelled")
        work.release()
        fit = rows.where("not hold")
        seen, kind = np.zeros((BUCKETS + 1, 2), np.int64), "at long, x0 long, x1 long"
        at, sums = _summed(fit.select(F.lit(0).alias("part"), "toxic", "text").mapInArrow(_tallied(), kind), 2)
        seen[at] = sums
        self.model, weight = _started(seen)
        if weight:
            parts = 1 + int(seen[-1].sum()) // PART
            ordered = fit.withColumn("part", F.pmod("of", F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "of", "text")
            for _ in range(self.rounds):
                found = ordered.select("part", "toxic", "text").mapInArrow(_learned(self.model, weight), f"at long, {', '.join(f'x{i} long' for i in range(DIM + 1))}")
                _mixed(self.model, *_summed(found, DIM + 1))
                del found
                work.release()
            at, sums = _summed(rows.where("hold").select("toxic", "text").mapInArrow(_binned(self.model), kind), 2)
            lang = (at + TOP * STEPS) // (4 * TOP * STEPS)
            _calibrate(self.model, np.column_stack([lang, at - lang * 4 * TOP * STEPS, sums]))
        work.drop()
        work.release()
        return self

    def score(self, docs: DataFrame, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
        """Columns ``keep`` and ``name``, the score.

        A null or empty text scores as one without words. Repeated rows keep a row
        each with equal scores, other columns aren't read, an empty table gives an
        empty result.
        """
        chosen = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("t"))
        schema = ", ".join(f"k{i} {chosen.schema[i].dataType.simpleString()}" for i in range(len(keep)))
        found = chosen.mapInArrow(_score(self.model), f"{schema}, score double")
        return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("score").alias(name))


def training_rows(labels: DataFrame) -> DataFrame:
    """Rows open to training: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
