"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word (run of letters, digits and non-ASCII characters, A-Z lower-cased) enters by a word vector and by a character vector,
the mean and maximum over its hashed prefixes, suffixes and inner 4-grams; both tables also hold the class log-odds of
their entry. A recurrent layer in either direction reads windows of 32 words that overlap by half; attention pools its states into
a logit. A text's score is that of its highest window. Only the text is an input.

Training is multiple-instance: of each toxic text the window that the present model rates highest is the positive example,
of each other text random windows and those the model rates highest. It uses a bounded sample of labelled rows.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from weft.llm.common import CHUNK_BYTES, FAMILIES, LOWER, flat, hash_words, mix, pick, plain

WINDOW, STRIDE, HIDDEN, DIMS, BUCKETS, GRAMS = 32, 16, 8, 4, 1 << 17, 10
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def word_bounds(data: np.ndarray, offs: np.ndarray):
    solid = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def gram_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, the buckets of its prefixes of 3 to 7 bytes, suffixes of 3 and 4, and 4-grams at 1, 2 and 3; -1 where it is too short."""
    table, _, _ = FAMILIES[0]
    n = ends - starts
    out = np.full((len(starts), GRAMS), -1, np.int64)
    plan = [(k, None, 0, k) for k in (3, 4, 5, 6, 7)] + [(k, "end", 0, k) for k in (3, 4)] + [(4, None, o, 4) for o in (1, 2, 3)]
    with np.errstate(over="ignore"):
        for c, (k, side, o, need) in enumerate(plan):
            ok = np.flatnonzero(n >= o + need)
            at = ends[ok] - k if side else starts[ok] + o
            h = np.full(len(ok), 100 + k + (7 if side else 0) + (50 if o else 0), np.uint64)
            for i in range(k):
                h = (h ^ table[data[at + i]]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[ok, c] = (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return out


class Texts:
    """Words of many texts: a number for each distinct word, and the windows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        data = LOWER[data]
        starts, ends, self.words = word_bounds(data, offs)
        hashed = hash_words(data, starts, ends)
        own, first, self.number = np.unique(hashed, return_index=True, return_inverse=True)
        self.word = (own & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.grams = gram_buckets(data, starts[first], ends[first])
        self.count = np.diff(self.words)
        per = np.maximum(1, -(-np.maximum(self.count - WINDOW, 0) // STRIDE) + 1)
        self.first_window = np.concatenate([[0], np.cumsum(per)])
        self.doc = np.repeat(np.arange(len(self.count)), per)
        self.start = self.words[self.doc] + STRIDE * (np.arange(len(self.doc)) - self.first_window[self.doc])

    def window(self, k: np.ndarray) -> np.ndarray:
        """Word numbers + 1 of windows k; 0 beyond a text's end."""
        at = self.start[k][:, None] + np.arange(WINDOW)
        inside = at < self.words[self.doc[k] + 1][:, None]
        numbers = self.number if len(self.number) else np.zeros(1, np.int64)
        return np.where(inside, numbers[np.minimum(at, len(numbers) - 1)] + 1, 0)


def sums_of(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the rows of each."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return keys[order[first]], np.add.reduceat(values[order], first) if len(first) else values[:0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Model:
    NAMES = ("w", "b", "u", "wa", "va", "vo", "bo")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        self.odds = np.zeros((2, BUCKETS), np.float32)  # of words, of character n-grams
        self.word, self.gram = (0.05 * r.standard_normal((BUCKETS, DIMS)).astype(np.float32) for _ in range(2))
        d = 2 * (DIMS + 1)
        self.w, self.b, self.u = f(2, d, 3 * HIDDEN) * 0.7, np.zeros((2, 3 * HIDDEN), np.float32), f(2, HIDDEN, 3 * HIDDEN) * 0.7
        self.wa, self.va, self.vo, self.bo = f(2 * HIDDEN, 8), f(8, 1)[:, 0] * 0.3, f(2 * HIDDEN, 1)[:, 0], np.zeros(1, np.float32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, odds=self.odds, word=self.word, gram=self.gram, **{n: getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        model = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as have:
            for n in have.files:
                setattr(model, n, have[n])
        return model

    def inputs(self, word: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """A row for each word, after a row of zeros for padding."""
        have = grams >= 0
        n = np.maximum(1, have.sum(1))[:, None]
        g = np.where(have, grams, 0)
        mean = (self.gram[g] * have[:, :, None]).sum(1) / n
        odds = np.where(have, self.odds[1][g], -9).max(1)[:, None]
        odds = np.where(have.any(1)[:, None], odds, 0)
        x = np.concatenate([self.odds[0][word][:, None], self.word[word], odds, mean], 1)
        return np.concatenate([np.zeros((1, x.shape[1])), x]).astype(np.float32)

    def read(self, gates: np.ndarray, at: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
        """States of one direction, time first. gates: input part of each distinct word."""
        n, h = len(at), np.zeros((len(at), HIDDEN), np.float32)
        out = np.empty((WINDOW, n, HIDDEN), np.float32)
        u = self.u[direction]
        for t in range(WINDOW) if direction == 0 else range(WINDOW - 1, -1, -1):
            x = gates[at[:, t]]
            hu = h @ u
            zr = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def pool(self, states: np.ndarray):
        a = np.tanh(states @ self.wa)
        e = a @ self.va
        p = np.exp(e - e.max(0))
        p /= p.sum(0)
        return a, p, (p[:, :, None] * states).sum(0)

    def logits(self, gates: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.float32)
        with np.errstate(over="ignore"):
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                states = np.concatenate([self.read(gates[0], part, 0), self.read(gates[1], part, 1)], 2)
                out[lo : lo + 4096] = self.pool(states)[2] @ self.vo + self.bo[0]
        return out

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.w[d] + self.b[d] for d in (0, 1)]

    def score(self, t: Texts) -> np.ndarray:
        """Highest logit of each text's windows."""
        gates = self.gates(self.inputs(t.word, t.grams))
        best = np.empty(len(t.doc), np.float32)
        for lo in range(0, len(t.doc), 8192):
            k = np.arange(lo, min(len(t.doc), lo + 8192))
            best[k] = self.logits(gates, t.window(k))
        self.last = best
        return np.maximum.reduceat(best, t.first_window[:-1]) if len(t.count) else best[:0]

    def step(self, t: Texts, k: np.ndarray, y: np.ndarray, state: dict, rate: float) -> float:
        """One gradient step on windows k with labels y."""
        at = t.window(k)
        used, local = np.unique(at, return_inverse=True)
        local = local.reshape(at.shape)
        real = used[used > 0] - 1
        pad = int(used[0] == 0)
        x = self.inputs(t.word[real], t.grams[real])
        if not pad:
            x = x[1:]
        gates = self.gates(x)
        kept: list[list] = [[], []]
        states = np.concatenate([self.read(gates[d], local, d, kept[d]) for d in (0, 1)], 2)
        a, p, pooled = self.pool(states)
        prob = sigmoid(pooled @ self.vo + self.bo[0])
        g = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        dl = ((prob - y) / len(k)).astype(np.float32)
        g["bo"][0], g["vo"] = dl.sum(), pooled.T @ dl
        dpool = dl[:, None] * self.vo
        dstates = p[:, :, None] * dpool
        dp = (states * dpool).sum(2)
        de = p * (dp - (p * dp).sum(0))
        g["va"] = np.einsum("tnk,tn->k", a, de)
        da = de[:, :, None] * self.va * (1 - a * a)
        g["wa"] = np.einsum("tnd,tnk->dk", states, da)
        dstates = dstates + da @ self.wa.T
        at_step = np.ascontiguousarray(local.T).ravel()
        read, dread = x[at_step], np.zeros((len(at_step), x.shape[1]), x.dtype)
        for d in (0, 1):
            u, dh = self.u[d], np.zeros((len(k), HIDDEN), np.float32)
            dgates = np.empty((WINDOW, len(k), 3 * HIDDEN), x.dtype)
            for ti, h, z, r, c, hu in reversed(kept[d]):
                dh = dh + dstates[ti, :, d * HIDDEN : (d + 1) * HIDDEN]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * hu * r * (1 - r)
                dhu = np.concatenate([dz, dr, dc * r], 1)
                dgates[ti, :, : 2 * HIDDEN], dgates[ti, :, 2 * HIDDEN :] = dhu[:, : 2 * HIDDEN], dc
                g["u"][d] += h.T @ dhu
                dh = dh * z + dhu @ u.T
            flat_gates = dgates.reshape(-1, 3 * HIDDEN)
            g["w"][d], g["b"][d] = read.T @ flat_gates, flat_gates.sum(0)
            dread += flat_gates @ self.w[d].T
        dx = sums_of(at_step, dread)[1]  # each distinct word is read, so there is a row for each
        n = state["n"] = state.get("n", 0) + 1
        for name in self.NAMES:
            m, v = state.setdefault(name, [np.zeros_like(g[name]), np.zeros_like(g[name])])
            m += 0.1 * (g[name] - m)
            v += 0.01 * (g[name] ** 2 - v)
            getattr(self, name)[...] -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-7)
        dx = dx[pad:]
        grams, have = t.grams[real], t.grams[real] >= 0
        dg = (dx[:, DIMS + 2 :] / np.maximum(1, have.sum(1))[:, None])[:, None, :] * have[:, :, None]
        for table, rows, grad in ((self.word, t.word[real], dx[:, 1 : DIMS + 1]), (self.gram, np.where(have, grams, 0).ravel(), dg.reshape(-1, DIMS))):
            own, total = sums_of(rows, grad)
            acc = state.setdefault(id(table), np.zeros(BUCKETS, np.float32))
            acc[own] += (total**2).mean(1)
            table[own] -= 0.1 * total / (np.sqrt(acc[own]) + 1e-6)[:, None]
        return float(-np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-9)))


def train(texts: list[str], labels: np.ndarray, rounds: int = 6, seed: int = 7) -> Model:
    model = Model(seed)
    labels = np.asarray(labels, np.float32)
    if not len(texts) or labels.min() == labels.max():
        model.vo[:] = 0  # nothing to tell apart: one score for all
        model.bo[0] = 4.0 if len(texts) and labels.max() > 0 else -4.0
        return model
    data, offs = flat(pa.array(texts, pa.large_string()))
    t = Texts(data, offs)
    r = np.random.default_rng(seed)
    pos = labels > 0
    # class log-odds of words and n-grams by document frequency, shrunk where rare
    owner = np.repeat(np.arange(len(texts)), t.count)
    pairs = np.unique(owner * max(1, len(t.word)) + t.number) if len(owner) else np.zeros(0, np.int64)
    doc, number = pairs // max(1, len(t.word)), pairs % max(1, len(t.word))
    for row, columns in ((0, [t.word]), (1, [t.grams[:, c] for c in range(GRAMS)])):
        a, b = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for column in columns:  # one at a time, to bound memory
            bucket = column[number]
            seen = np.unique((doc * BUCKETS + bucket)[bucket >= 0])
            toxic = pos[seen // BUCKETS]
            a += np.bincount(seen[toxic] % BUCKETS, minlength=BUCKETS)
            b += np.bincount(seen[~toxic] % BUCKETS, minlength=BUCKETS)
        odds = np.log((a + 0.5) / (pos.sum() + 1)) - np.log((b + 0.5) / ((~pos).sum() + 1))
        model.odds[row] = np.clip(odds * (a + b) / (a + b + 4 + 0.008 * len(texts)), -3, 4)
    # first rating: the windows' highest log-odds
    numbers = np.concatenate([[0], np.maximum(model.odds[0][t.word], np.where(t.grams >= 0, model.odds[1][np.maximum(t.grams, 0)], -9).max(1))])
    rating = np.concatenate([numbers[t.window(np.arange(lo, min(len(t.doc), lo + 8192)))].max(1) for lo in range(0, len(t.doc), 8192)])
    state: dict = {}
    negatives = np.flatnonzero(~pos[t.doc])
    for k in range(rounds):
        order = np.lexsort((-rating, t.doc))
        best = order[t.first_window[:-1]]
        take = np.concatenate([best, best[pos], r.choice(negatives, min(len(negatives), 2 * len(texts)))])
        for _ in range(3 if len(texts) > 1500 else 8):
            take = r.permutation(take)
            for lo in range(0, len(take), 128):
                part = take[lo : lo + 128]
                model.step(t, part, labels[t.doc[part]], state, 0.01 if k < rounds - 1 else 0.003)
        scores = model.score(t)
        rating = model.last
    # the threshold that parts the training texts best becomes 0.5
    order = np.argsort(scores)
    s, y = scores[order], pos[order]
    right = np.concatenate([[0], np.cumsum(~y)]) + y.sum() - np.concatenate([[0], np.cumsum(y)])
    top = np.flatnonzero(right == right.max())
    cut_at = top[len(top) // 2]
    lo, hi = s[max(cut_at - 1, 0)], s[min(cut_at, len(s) - 1)]
    model.bo[0] -= lo + 0.8 * (hi - lo)  # nearer to the toxic ones: texts have many windows, and most are clean
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int, max_bytes: int) -> DataFrame:
    """(i, y, t): at most max_rows toxic and 2 * max_rows other labelled texts, of at most max_bytes each, from rows that aren't held out."""
    rows = pick(labels, i=id_col, y="toxic").select("i", F.col("y").cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    rows = rows.where(F.crc32(F.col("i").cast("string")) % 5 != 0)
    # 3 times as many ids of each class as are wanted, as some have no text that fits: a bounded number
    wanted = [rows.where(f"y = {y}").orderBy(F.xxhash64("i"), "i").limit(3 * max_rows * (2 - y)) for y in (0, 1)]
    text = pick(docs, j=id_col, t=text_col).select("j", F.col("t").cast("string").alias("t")).where(F.octet_length("t") <= max_bytes)
    both = wanted[0].unionAll(wanted[1])
    own = text.join(F.broadcast(both), F.col("i") == F.col("j")).groupBy("i").agg(F.first("y").alias("y"), F.min("t").alias("t"))
    picked = [own.where(f"y = {y}").orderBy(F.xxhash64("i"), "i").limit(max_rows * (2 - y)) for y in (0, 1)]
    return picked[0].unionAll(picked[1])


def trained(sample: DataFrame) -> Model:
    """The model of a bounded sample, trained in one task of the cluster: its memory is not the driver's."""

    def fit(batches):
        rows = sorted((i, y, t) for b in batches for i, y, t in zip(*(c.to_pylist() for c in b.columns)))
        texts = {t: y for _, y, t in rows}  # copies would look like evidence
        yield pa.RecordBatch.from_arrays([pa.array([train(list(texts), np.array(list(texts.values()))).dump()], pa.binary())], names=["model"])

    row = sample.select("i", "y", "t").repartition(1).mapInArrow(fit, "model binary").first()
    return Model.load(row[0]) if row else train([], np.zeros(0))  # an empty sample may have no task at all


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The input rows (of them the columns `keep`; None: all) with columns score (0 to 1) and predicted (1 if score >= 0.5)
    added; existing ones are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
    held = [i for i, c in enumerate(docs.columns) if c not in ("score", "predicted") and (keep is None or c in keep)]
    names = [docs.columns[i] for i in held]
    some = plain(docs).select(*[f"c{i}" for i in held], F.col(f"c{docs.columns.index(text_col)}").cast("string").alias("t"))

    def run(batches):
        m = shared.value
        for b in batches:
            data, offs = flat(b.column(b.num_columns - 1))
            at, scores = 0, []
            while at < b.num_rows:
                to = min(max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK_BYTES))), b.num_rows)
                scores.append(m.score(Texts(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])))
                at = to
            logit = np.concatenate(scores).astype(np.float64) if scores else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*schema_names, "score", "predicted"])

    schema_names = [f"c{i}" for i in held]
    schema = StructType([*some.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return some.mapInArrow(run, schema).toDF(*names, "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 1500, max_bytes: int = 16_000, keep: list[str] | None = None) -> DataFrame:
    """The input rows (of them the columns `keep`; None: all) with held_out, score and predicted.

    held_out: crc32 of the id as text is divisible by 5; no label of such a row is learnt. max_rows bounds the toxic rows that
    are learnt from; of the others there are at most twice as many. max_bytes: labelled texts that are longer aren't learnt from (all texts are scored whole). Nulls: a null text is scored like an empty one; a null id isn't held out; null or other labels than
    0 and 1 are ignored, and of contradictory ones 1 counts. Without labels of both classes all rows get one score. Repeated
    rows get equal scores. Other columns are kept; an empty table gives an empty result.
    """
    model = trained(labelled_sample(docs, labels, id_col, text_col, max_rows, max_bytes))
    done = score_toxicity(docs, model, text_col, keep)
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))
    return done.drop("held_out").withColumn("held_out", held)
