"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of letters, digits and + / _ . - (with all non-ASCII characters as letters). Each has a few
categorical features: its shape (length, kinds of characters, alternation of digits and letters, known
prefix), whether it is a credential keyword, what stands before it; those of its neighbours; and of the
file (does it hold any keyword or any digit-rich token). The field tags tokens O, B or I; its weights are trained here by gradient
ascent on the log-likelihood (forward-backward) of generated lines of prose, configuration and code; decoding is by Viterbi.

Decoding is exact but not run where it can't matter: a token whose O score leads by more than all transitions could
return is O in the best path, so paths are only searched between such tokens.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import CHUNK_BYTES, batch_of, flat, in_a_task, pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
KEYWORDS = {*WORDS, b"pwd", b"auth", b"bearer", b"authorization", b"credential", b"credentials", b"key", b"private_key", b"access_key", b"secret_key", b"client_secret", b"access_token", b"passphrase", b"basic"}
PREFIXES = [b"ghp_", b"gho_", b"sk-", b"sk_l", b"pk_l", b"xoxb", b"xoxp", b"eyJ", b"AIza", b"AKIA", b"ASIA", b"glpa", b"npm_", b"hf_"]

# kinds of bytes: 1 lower, 2 upper, 4 digit, 8 symbol of a token, 16 non-ASCII, 32 hex letter
KIND = np.zeros(256, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 4, 16
for _b in b"+/_.-":
    KIND[_b] = 8
SIZES = {"length": 8, "kinds": 32, "turns": 6, "prefix": 2, "keyword": 2, "before": 5, "hex": 2, "file": 4, "prev_keyword": 2, "prev2_keyword": 2, "prev_kinds": 32, "next_kinds": 32, "secretish": 2}
FIRST = dict(zip(SIZES, np.cumsum([0, *SIZES.values()])))
N_FEATURES = sum(SIZES.values())


def tokens_of(data: np.ndarray, offs: np.ndarray):
    """Starts, ends, document of each token, and its features (rows of column numbers)."""
    kind = KIND[data]
    solid = kind > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(s, offs)))
    n = len(s)
    if not n:
        return s, e, doc, np.zeros((0, len(SIZES)), np.int16)
    length = e - s
    kinds = np.bitwise_or.reduceat(kind, s)  # gaps between tokens are 0
    turn = np.zeros(len(data) + 1, np.int32)
    is_digit = kind == 4
    np.cumsum((is_digit[1:] != is_digit[:-1]) & solid[1:] & solid[:-1], out=turn[2:], dtype=np.int32)
    turns = turn[e] - turn[np.minimum(s + 1, e)]
    f = np.zeros((n, len(SIZES)), np.int16)
    f[:, 0] = np.searchsorted([4, 8, 12, 16, 20, 32, 64], length, "right")
    f[:, 1] = kinds
    f[:, 2] = np.searchsorted([1, 2, 4, 7, 12], turns, "right")
    body = None
    keyword, prefix = np.zeros(n, bool), np.zeros(n, bool)
    maybe = np.flatnonzero((length >= 3) & (length <= 16) & ((kinds & 20) == 0) & KEY_FIRST[data[s]] & KEY_LAST[data[e - 1]])
    rare = np.flatnonzero((length >= 12) & PREFIX_FIRST[data[s]] & ((kinds & 16) == 0))
    if len(maybe) or len(rare):
        body = data.tobytes()
        keyword[[i for i in maybe.tolist() if body[s[i] : e[i]].lower() in KEYWORDS]] = True
        prefix[[i for i in rare.tolist() if body.startswith(tuple(PREFIXES), s[i], e[i])]] = True
    f[:, 3], f[:, 4] = prefix, keyword
    gap = np.where(s > 0, data[np.maximum(s - 1, 0)], 32)
    two = np.where(s > 1, data[np.maximum(s - 2, 0)], 32)
    three = np.where(s > 2, data[np.maximum(s - 3, 0)], 32)
    assign = np.isin(gap, [58, 61]) | (np.isin(gap, [32, 34, 39]) & np.isin(two, [58, 61])) | (np.isin(gap, [34, 39]) & (two == 32) & np.isin(three, [58, 61]))
    f[:, 5] = np.select([assign, np.isin(gap, [34, 39, 96]), gap == 10, gap == 32], [1, 2, 3, 4], 0)
    upper_hex = HEXISH[data] | ~solid
    bad = np.concatenate([[0], np.cumsum(~upper_hex)])
    f[:, 6] = (bad[e] == bad[s]) & (length >= 12)
    secretish = ((length >= 12) & (kinds & 4 > 0) & (kinds & 3 > 0)) | prefix
    f[:, 12] = secretish
    has_key, has_rich = (np.bincount(doc[m], minlength=len(offs) - 1) > 0 for m in (keyword, secretish))
    f[:, 7] = (has_key + 2 * has_rich)[doc]
    same = doc[1:] == doc[:-1]
    f[1:, 8] = keyword[:-1] & same
    f[2:, 9] = keyword[:-2] & (doc[2:] == doc[:-2])
    f[1:, 10] = np.where(same, kinds[:-1], 0)
    f[:-1, 11] = np.where(same, kinds[1:], 0)
    return s, e, doc, f


HEXISH = np.zeros(256, bool)
HEXISH[list(b"0123456789abcdefABCDEF")] = True
KEY_FIRST, KEY_LAST, PREFIX_FIRST = (np.zeros(256, bool) for _ in range(3))
for _w in KEYWORDS:
    KEY_FIRST[[_w[0], _w[0] - 32]] = True
    KEY_LAST[[_w[-1], _w[-1] - 32]] = True
for _w in PREFIXES:
    PREFIX_FIRST[_w[0]] = True


def scores(f: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros((len(f), 3), np.float32)
    for k, first in enumerate(FIRST.values()):
        out += w[first + f[:, k]]
    return out


def viterbi(unary: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags of one chain; O, B, I = 0, 1, 2."""
    n = len(unary)
    back = np.zeros((n, 3), np.int8)
    best = unary[0] + np.array([0, 0, -1e9])
    for t in range(1, n):
        step = best[:, None] + trans
        back[t] = step.argmax(0)
        best = step.max(0) + unary[t]
    tags = np.empty(n, np.int8)
    tags[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


def decode(unary: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) token of each tagged span."""
    finite = trans[trans > -1e8]
    margin = 2 * float(finite.max() - finite.min()) + 1e-3
    open_ = np.flatnonzero(unary[:, 0] - unary[:, 1:].max(1) <= margin)
    out = []
    if not len(open_):
        return out
    breaks = np.flatnonzero((np.diff(open_) > 1) | (np.diff(doc[open_]) > 0)) + 1
    for seg in np.split(open_, breaks):
        # a sure O on either side, or the document's end
        lo, hi = int(seg[0]), int(seg[-1]) + 1
        a = lo - 1 if lo > 0 and doc[lo - 1] == doc[lo] else lo
        z = hi + 1 if hi < len(doc) and doc[hi] == doc[lo] else hi
        tags, i = viterbi(unary[a:z], trans), 0
        while i < len(tags):
            j = i + 1
            if tags[i]:
                while j < len(tags) and tags[j] == 2:
                    j += 1
                out.append((a + i, a + j - 1))
            i = j
    return out


# == training


def lines(count: int, seed: int) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """Generated lines and the byte spans of their secrets."""
    r = random.Random(seed)
    low = string.ascii_lowercase
    alnum = string.ascii_letters + string.digits
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "de", "és", "ün", "qu", "la", "mo", "s", "t"]) for _ in range(r.randint(1, 6)))
    mixed = lambda n: pick(alnum, n - 3) + r.choice(string.digits) + r.choice(low) + r.choice(string.ascii_uppercase)

    def secret() -> str:
        return r.choice([
            lambda: "ghp_" + mixed(36), lambda: "sk-" + mixed(r.randint(24, 48)), lambda: "xoxb-" + pick(string.digits, 12) + "-" + mixed(24), lambda: "AIza" + mixed(35), lambda: "hf_" + mixed(34), lambda: "npm_" + mixed(36),
            lambda: "eyJ" + mixed(20) + "." + mixed(30) + "." + mixed(43), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ASIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "sk_live_" + mixed(24),
            lambda: pick("0123456789abcdef", r.choice([18, 32, 40])), lambda: mixed(r.randint(20, 44)), lambda: mixed(40) + "/" + mixed(10),
        ])()

    texts, spans = [], []
    for _ in range(count):
        parts, marks, at = [], [], 0

        def add(x: str, is_secret: bool = False):
            nonlocal at
            raw = x.encode()
            if is_secret:
                marks.append((at, at + len(raw)))
            parts.append(raw)
            at += len(raw)

        for _ in range(r.randint(0, 12)):
            add(word() + r.choice([" ", " ", " ", ", ", ". ", "\n"]))
        kind = r.random()
        if kind < 0.35:
            key = r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "auth", "pwd", "client_secret", "access_token", "Authorization: Bearer", "private_key", "credential"])
            key = r.choice([key, key.upper(), key.title()])
            mark = r.choice(["=", " = ", ": ", ":", '="', ': "', " = '", '": "'])
            add(key + (" " if key.lower().endswith("bearer") else mark))
            add(secret(), True)
            add(r.choice(["", '"', "'"]))
        elif kind < 0.5:
            add(secret(), True)
        elif kind < 0.9:  # what looks like one and isn't
            add(r.choice([
                lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(10, 23)}", lambda: f"{word()}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com", lambda: pick(string.digits, r.randint(4, 16)), lambda: f"+{pick(string.digits, 2)}-{pick(string.digits, 3)}-{pick(string.digits, 7)}",
                lambda: f"/{word()}/{word()}_{r.randint(1, 99)}/{word()}.html", lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 20)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: "password reset " + word(), lambda: "the secret of " + word(), lambda: "token: " + word(), lambda: "key = " + word() + "_" + word(), lambda: word() + word() + word() + word(),
                lambda: f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}", lambda: f"{pick(string.digits, 4)}-{pick(string.digits, 4)}-{pick(string.digits, 4)}-{pick(string.digits, 4)}", lambda: "###" + word() + "$$$" + word(),
            ])())
        for _ in range(r.randint(0, 8)):
            add(r.choice([" ", ". ", ", "]) + word())
        texts.append(b"".join(parts))
        spans.append(marks)
    return texts, spans


def gold(s: np.ndarray, e: np.ndarray, offs: np.ndarray, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    tags = np.zeros(len(s), np.int8)
    for base, own in zip(offs.tolist(), spans):
        for a, z in own:
            inside = np.flatnonzero((s >= base + a) & (e <= base + z))
            tags[inside] = 2
            tags[inside[:1]] = 1
    return tags


@functools.cache
def train(count: int = 3000, rounds: int = 120, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, transitions) that maximise the penalised log-likelihood of `count` generated lines."""
    texts, spans = lines(count, seed)
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s, e, doc, f = tokens_of(data, offs)
    y = gold(s, e, offs, spans)
    size = np.bincount(doc, minlength=count)
    longest = int(size.max())
    place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    inside = np.zeros((count, longest), bool)
    inside[doc, place] = True
    cols = f.astype(np.int64) + np.array(list(FIRST.values()))
    w, t = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    m, v = np.zeros((N_FEATURES + 3, 3)), np.zeros((N_FEATURES + 3, 3))
    onehot = np.eye(3)[y]
    pair = (place[1:] > 0)
    seen_pairs = np.zeros((3, 3))
    np.add.at(seen_pairs, (y[:-1][pair], y[1:][pair]), 1)
    start = np.array([0.0, 0.0, -30.0])
    for k in range(1, rounds + 1):
        flat_u = w[cols].sum(1)
        u = np.zeros((count, longest, 3))
        u[doc, place] = flat_u
        alpha = np.zeros_like(u)
        alpha[:, 0] = u[:, 0] + start
        for i in range(1, longest):
            x = alpha[:, i - 1, :, None] + t
            top = x.max(1)
            now = top + np.log(np.exp(x - top[:, None]).sum(1)) + u[:, i]
            alpha[:, i] = np.where(inside[:, i, None], now, alpha[:, i - 1])
        top = alpha[:, -1].max(1)
        z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
        beta = np.zeros_like(u)
        expect = np.zeros((3, 3))
        for i in range(longest - 2, -1, -1):
            x = t + (u[:, i + 1] + beta[:, i + 1])[:, None, :]
            top = x.max(2)
            now = top + np.log(np.exp(x - top[:, :, None]).sum(2))
            on = inside[:, i + 1]
            beta[:, i] = np.where(on[:, None], now, 0)
            p = np.exp(alpha[:, i, :, None] + x - z[:, None, None])
            expect += p[on].sum(0)
        # alpha is carried on past a line's end, so the marginals of its own tokens are right
        marginal = np.exp(alpha + beta - z[:, None, None])[doc, place]
        g = np.zeros((N_FEATURES + 3, 3))
        diff = onehot - marginal
        for c in range(cols.shape[1]):
            np.add.at(g, cols[:, c], diff)
        g[N_FEATURES:] = seen_pairs - expect
        g[:N_FEATURES] -= 0.3 * w
        g[N_FEATURES:] -= 0.3 * t
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, t = w + step[:N_FEATURES], t + step[N_FEATURES:]
    t = t.copy()
    t[0, 2] = -1e9  # I follows B or I only
    return w.astype(np.float32), t.astype(np.float32)


# == the scan


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    out = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return out


HEX_LOWER = np.zeros(256, bool)
HEX_LOWER[list(b"0123456789abcdef")] = True


def has_hex_run(data: np.ndarray, offs: np.ndarray, n: int = 16) -> np.ndarray:
    """Documents with n hex digits in a row."""
    run, edge = HEX_LOWER[data], np.zeros(len(data) + 1, bool)
    edge[offs] = True  # a run ends with its document
    first, last = run.copy(), run.copy()
    if len(data):
        first[1:] &= ~run[:-1] | edge[1:-1]
        last[:-1] &= ~run[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.zeros(len(offs) - 1, bool)
    out[np.searchsorted(offs, starts[ends - starts >= n], "right") - 1] = True
    return out


RESULT = pa.schema([("id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_lines: int = 3000) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_crf.

    Spans are kind:start:end in code points, end exclusive, by start, then kind (assign, access, hex, crf). base_sha256
    is of the spans of the three patterns; spans has also those that the field adds ("crf"), which never overlap one of the patterns' spans.
    Nulls: a null text counts as empty and has no spans; null ids and repeated rows are kept, each with its row. Whole
    texts are scanned. Other columns are ignored; an empty table gives an empty result. The field is trained on
    `training_lines` generated lines (a bound that doesn't depend on the data).
    """
    w, trans = in_a_task(docs.sparkSession, train, training_lines)

    def run(batches):
        for b in batches:
            data, offs = flat(b.column(1))
            ids = b.column(0).to_pylist()
            at = 0
            while at < len(ids):
                to = min(max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK_BYTES))), len(ids))
                part, own = data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
                yield batch_of(RESULT, scan_chunk(ids[at:to], part, own, w, trans))
                at = to

    rows = pick(docs, i=id_col, t=text_col).select(F.col("i").cast("long").alias("i"), F.col("t").cast("string").alias("t"))
    done = rows.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
    return done.withColumnRenamed("id", id_col)


EMPTY = hashlib.sha256(b"").hexdigest()


def in_points(spans: list[tuple[int, int]], data: np.ndarray, base: int) -> list[tuple[int, int, int]]:
    """Byte spans of a document that begins at `base`, in code points."""
    if not spans:
        return []
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # starts of code points
    return [(int(before[a - base]), int(before[z - base]), 3) for a, z in spans]


def apart(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the spans that overlap none of the others; both by start."""
    # up to each of the others: the furthest end
    starts, ends = [a for a, _, _ in others], list(itertools.accumulate((z for _, z, _ in others), max))
    out = []
    for a, z, kind in spans:
        k = bisect.bisect_left(starts, z)  # those that start before z
        if not k or ends[k - 1] <= a:
            out.append((a, z, kind))
    return out


def scan_chunk(ids: list, data: np.ndarray, offs: np.ndarray, w: np.ndarray, trans: np.ndarray) -> list[tuple]:
    s, e, doc, f = tokens_of(data, offs)
    tagged: dict[int, list[tuple[int, int]]] = {}
    for a, z in decode(scores(f, w), doc, trans) if len(s) else []:
        tagged.setdefault(int(doc[a]), []).append((int(s[a]), int(e[z])))
    body = data.tobytes()
    low = body.lower()
    hexed = has_hex_run(data, offs)
    bounds = offs.tolist()
    rows = []
    words = set()
    for word in WORDS:
        k = low.find(word)
        while k >= 0:
            i = int(np.searchsorted(offs, k, "right")) - 1
            words.add(i)
            k = low.find(word, bounds[i + 1])
    k = body.find(b"AKIA")
    while k >= 0:
        i = int(np.searchsorted(offs, k, "right")) - 1
        words.add(i)
        k = body.find(b"AKIA", bounds[i + 1])
    for i, doc_id in enumerate(ids):
        if not (i in words or hexed[i] or i in tagged):
            rows.append((doc_id, 0, 0, 0, EMPTY, "", 0))
            continue
        lo, hi = bounds[i], bounds[i + 1]
        raw = body[lo:hi]
        text = raw.decode("utf-8", "replace")
        base = sorted(base_spans(text, raw), key=lambda x: (x[0], x[2]))
        extra = apart(in_points(tagged.get(i, []), data[lo:hi], lo), base)
        say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in spans)
        n = [sum(k == x for *_, k in base) for x in range(3)]
        rows.append((doc_id, *n, hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + extra, key=lambda x: (x[0], x[2]))), len(extra)))
    return rows
