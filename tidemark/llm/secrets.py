"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags tokens (runs of letters, digits and + / _ . -) as outside, begin or inside of a secret. Its features
are tables that numpy looks up for a whole batch: a token's shape, its mix of characters, known heads of keys, the
neighbouring words and what stands between them, and features of the whole text. It is trained here, on a bounded
sample of documents: those lines that the patterns label, and variations of lines that they would not. In a variation
the value, the word before it or what stands between them is another one, and the tag is known because it was put there:
a random key of a form that the patterns do not know, or a value that is none (a word, number, date, path or address).

Viterbi decoding runs only where it can matter. If outside beats both other tags at a token by more than any choice of
neighbours could return (by the transitions, and what the next token loses if it has to begin), the best path is
outside there; the tokens between such tokens are decoded, as a chain each. The result is that of decoding whole texts.

Defined results: a null or empty text has no spans and the digest of the empty string. Repeated rows and ties are rows
of their own; other columns are ignored; with an empty table the field stays untrained and no rows come out.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_texts, slices, texts


# The three base patterns; RE2 forms of them only say which texts can have a match.
_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_MAY = (rf"""(?:{_ANY_CASE})["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{{6}}""", "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}")
KINDS = ("assign", "access", "hex", "crf")
# Words before a secret, heads of well-known keys.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "pwd", "auth", "bearer", "credential", "access", "private")
HEADS = ("AKIA", "ghp_", "gho_", "sk_l", "sk-l", "xoxb", "xoxp", "eyJh", "AIza", "glpa")

#: Documents of the sample for training, at most, and bytes of their texts.
SAMPLE_DOCS, SAMPLE_BYTES = 1_500, 32_000_000
#: Lines of the sample that are varied, each in a few ways.
VARIED = 300
#: Tokens in a training chain at most, and passes over the sample.
CHAIN, PASSES = 100, 40

_KIND = np.zeros(256, np.uint8)  # 1 digit, 2 lower, 3 upper, 4 other character of a token
_KIND[48:58], _KIND[97:123], _KIND[65:91] = 1, 2, 3
_KIND[[ord(c) for c in "+/_.-"]] = 4
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_BETWEEN = np.zeros(256, np.uint8)  # bits: 1 = or :, 2 quote, 4 line break, 8 other than a space
_BETWEEN[[ord("="), ord(":")]], _BETWEEN[[ord('"'), ord("'")]], _BETWEEN[10] = 1, 2, 4
_BETWEEN[[i for i in range(256) if chr(i) not in "=:\"'\n \t\r"]] = 8


def base_spans(text: str, may: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    found = []
    if may[0]:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if may[1]:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if may[2]:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _word_key(raw: bytes) -> int:
    h = 0
    for c in raw.lower()[:16]:
        h = (h * 1_000_003 + c + 1) % (1 << 64)
    return h


_WORD_KEYS = np.array([_word_key(w.encode()) for w in WORDS], np.uint64)
_HEAD_KEYS = np.array([int.from_bytes(h.encode(), "big") for h in HEADS], np.uint64)
#: Sizes of the feature tables.
TABLES = (160, 160, 80, len(HEADS) + 1, len(WORDS) + 1, len(WORDS) + 1, 16, 16, 160, 64, len(WORDS) + 1)


class Tokens:
    """The tokens of a batch of texts and their features (one row of each table for a token)."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = data
        kind = _KIND[data]
        inside = kind > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        left = np.concatenate(([True], ~inside[:-1]))[: len(data)] | edge[:-1]
        right = np.concatenate((~inside[1:], [True]))[: len(data)] | edge[1:]
        self.begin, self.end = np.flatnonzero(inside & left), np.flatnonzero(inside & right) + 1
        self.doc = np.searchsorted(self.offsets, self.begin, side="right") - 1
        self.first = np.diff(self.doc, prepend=-1) != 0
        self.rows = self._features(kind) if len(self.begin) else np.zeros((0, len(TABLES)), np.int64)

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=total[1:], dtype=np.int32)
        return total[self.end] - total[self.begin]

    def _features(self, kind: np.ndarray) -> np.ndarray:
        data, begin, end = self.data, self.begin, self.end
        size = end - begin
        digits, lower, upper, other = (self._sum(kind == k) for k in (1, 2, 3, 4))
        hexes = self._sum((kind == 1) | (data >= 97) & (data <= 102))
        turns = self._sum(np.concatenate(([False], kind[1:] != kind[:-1]))) - (begin > 0) * (kind[begin] != kind[begin - 1])
        log = np.minimum(np.searchsorted([2, 4, 6, 8, 12, 16, 20, 24, 32], size, side="right"), 9)
        shape = log * 16 + (digits > 0) * 8 + (lower > 0) * 4 + (upper > 0) * 2 + (other > 0)
        mixture = log * 16 + np.minimum(turns, 15)
        share = log * 8 + np.minimum(8 * digits // size, 3) * 2 + (hexes == size)
        head = np.zeros(len(begin), np.uint64)
        for j in range(4):
            head = head << np.uint64(8) | np.where(size > j, data[np.minimum(begin + j, len(data) - 1)], 0).astype(np.uint64)
        heads = np.zeros(len(begin), np.int64)
        for i, k in enumerate(_HEAD_KEYS):
            heads[(head == k) & (size >= 12)] = i + 1
        key = np.zeros(len(begin), np.uint64)
        for j in range(16):
            more = np.flatnonzero(size > j)
            key[more] = key[more] * np.uint64(1_000_003) + _FOLD[data[begin[more] + j]] + np.uint64(1)
        word = np.zeros(len(begin), np.int64)
        for i, k in enumerate(_WORD_KEYS):
            word[(key == k) & (size <= 16)] = i + 1
        last = np.concatenate(([0], word[:-1])) * ~self.first
        second = np.concatenate(([0], last[:-1])) * ~self.first
        # What stands between a token and the one before it, as bits.
        start = np.where(self.first, self.offsets[self.doc], np.concatenate(([0], end[:-1])))
        between = np.zeros(len(begin), np.int64)
        for bit in (1, 2, 4, 8):
            total = np.concatenate(([0], np.cumsum(_BETWEEN[data] == bit, dtype=np.int32)))
            between |= bit * (total[begin] > total[start])
        after = np.concatenate((between[1:], [4]))
        after[np.concatenate((self.first[1:], [True]))] = 4
        before = np.concatenate(([0], shape[:-1])) * ~self.first
        # The whole text: how many of its tokens are such words, and how many have digits.
        n = np.bincount(self.doc, minlength=len(self.offsets) - 1)
        words = np.minimum(np.bincount(self.doc, word > 0, len(n)).astype(np.int64), 7)
        digital = np.minimum(8 * np.bincount(self.doc, digits > 0, len(n)).astype(np.int64) // np.maximum(n, 1), 7)
        return np.stack((shape, mixture, share, heads, last, second, between, after, before, (words * 8 + digital)[self.doc], word), axis=1)


def _scores(rows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), 3), np.float32)
    for f, table in enumerate(tables):
        out += table[rows[:, f]]
    return out


#: No tag may be inside after outside, or at the beginning.
NEVER = -1e4


_ALPHABETS = {"word": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "hex": "0123456789ABCDEF"}
_ALPHABETS["mixed"] = _ALPHABETS["word"] + _ALPHABETS["upper"] + _ALPHABETS["digit"]
_ALPHABETS["base64"] = _ALPHABETS["mixed"] + "+/"
_ALPHABETS["lower"] = _ALPHABETS["word"] + _ALPHABETS["digit"]
#: Heads, alphabet and least and most length of keys that variations have, and that the patterns need not find.
KEYS = (("ghp_", "mixed", 36, 36), ("sk_live_", "mixed", 24, 24), ("xoxb-", "mixed", 24, 40), ("eyJh", "base64", 40, 90), ("AIza", "mixed", 35, 35), ("", "mixed", 18, 64), ("", "base64", 24, 88), ("", "hex", 20, 64), ("", "lower", 20, 40))
#: What may stand before a value: words of the kind that the patterns know and others, with or without a sign.
LEADS = ('{} = "', "{} is ", "{} -> ", "{}: ", "use {} ", "", "", "id ", "see ")
_LEAD_WORDS = ("password", "passwd", "secret", "token", "apikey", "key", "pwd", "auth", "bearer", "credential", "access", "private")


def _key(rng: random.Random) -> str:
    head, alphabet, least, most = rng.choice(KEYS)
    return head + "".join(rng.choices(_ALPHABETS[alphabet], k=rng.randint(least, most)))


def _harmless(rng: random.Random, words: list[str]) -> str:
    number = lambda n: "".join(rng.choices(_ALPHABETS["digit"], k=n))
    return rng.choice((
        lambda: rng.choice(words), lambda: number(rng.randint(1, 19)), lambda: ".".join(number(rng.randint(1, 3)) for _ in range(4)), lambda: f"20{number(2)}-0{number(1)}-1{number(1)}",
        lambda: "/".join(rng.choices(words, k=4)), lambda: f"{rng.choice(words)}.{rng.choice(words)}", lambda: f"v{number(1)}.{number(2)}.{number(1)}", lambda: "-".join(rng.choices(words, k=3)),
        lambda: "".join(rng.choices(words, k=4))[:30], lambda: rng.choice(words).upper(), lambda: f"{rng.choice(words)}_{number(4)}",
    ))()


def examples(texts: list[str], varied: int = VARIED) -> list[tuple[str, list[tuple[int, int]]]]:
    """The texts and variations of some of their lines, each with the places of its secrets."""
    rng = random.Random(1)
    out, lines, words = [], [], []
    for text in texts:
        spans = []
        for start, kind, end in base_spans(text):
            m = ASSIGN.match(text, start) if kind == 0 else None
            own = (m.start(2), m.end(2)) if m else (start, end)
            if not spans or own[0] >= spans[-1][1]:
                spans.append(own)
        out.append((text, spans))
        for line in text.split("\n")[:50]:
            words += [w for w in re.findall(r"[A-Za-z]{2,}", line[:2_000])[:8]]
            if len(line) > 20:
                lines.append(line[:400])
    if not lines or not words:
        return out
    for line in rng.sample(lines, min(varied, len(lines))):
        at = rng.choice([m.end() for m in re.finditer(r"\s", line)] or [len(line)])
        for k in range(6):
            lead, value = rng.choice(LEADS).format(rng.choice(_LEAD_WORDS)), _key(rng) if k % 2 else _harmless(rng, words)
            text = line[:at].rstrip() + " " + lead
            begin = len(text)
            text += value + ('" ' if lead.endswith('"') else " ") + line[at:]
            spans = [(begin, begin + len(value))] if k % 2 else []
            # What the patterns find counts, whatever was put there.
            spans += [(ASSIGN.match(text, s).start(2) if kind == 0 else s, e) for s, kind, e in base_spans(text)]
            out.append((text, sorted(set(spans))))
    return out


def train(column: pa.Array, passes: int = PASSES, varied: int = VARIED) -> tuple[list[np.ndarray], np.ndarray]:
    """(tables, transitions) that make the tags of the examples from these texts most likely, by full-batch Adam."""
    known = examples([x or "" for x in column.to_pylist()], varied)
    tokens = Tokens(pa.array([t for t, _ in known], pa.large_string()))
    tags = np.zeros(len(tokens.begin), np.int64)
    firsts = np.searchsorted(tokens.doc, np.arange(len(known) + 1))
    for i, (text, spans) in enumerate(known):
        if spans:
            places = np.cumsum([0, *(len(c.encode()) for c in text)]) + tokens.offsets[i]
            own = np.arange(firsts[i], firsts[i + 1])
            for start, end in spans:
                hit = own[(tokens.begin[own] < places[end]) & (tokens.end[own] > places[start])]
                tags[hit[1:]], tags[hit[:1]] = 2, 1
    cut = np.flatnonzero(tokens.first | (tokens.rows[:, 6] & 4 > 0)) if len(tags) else np.zeros(0, np.int64)
    chains = [(b + k, min(b + k + CHAIN, e)) for b, e in zip(cut.tolist(), [*cut[1:].tolist(), len(tags)], strict=False) for k in range(0, e - b, CHAIN)]
    total = np.concatenate(([0], np.cumsum(tags > 0)))
    good = [c for c in chains if total[c[1]] > total[c[0]]]
    rest = [c for c in chains if total[c[1]] == total[c[0]]]
    chains = good + rest[:: max(1, len(rest) // (len(good) + 500))]
    tables, steps = [np.zeros((n, 3)) for n in TABLES], np.zeros((3, 3))
    block = np.zeros((3, 3))
    block[0, 2] = NEVER
    if not chains or not good:
        for t in tables[:1]:
            t[:, 0] = 100.0
        return [t.astype(np.float32) for t in tables], steps + block
    size = np.array([e - b for b, e in chains])
    at = np.array([b for b, _ in chains])[:, None] + np.arange(size.max())
    live = np.arange(size.max()) < size[:, None]
    at = np.where(live, at, 0)
    rows, gold = tokens.rows[at], tags[at]
    gold[gold == 2] = np.where(at[gold == 2] == at[:, :1].repeat(at.shape[1], 1)[gold == 2], 1, 2)  # a chain cannot begin inside
    true = np.zeros(gold.shape + (3,))
    np.put_along_axis(true, gold[..., None], 1.0, axis=2)
    true *= live[..., None]
    pair = np.einsum("nti,ntj->ij", true[:, :-1], true[:, 1:])
    weights = [*tables, steps]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, passes + 1):
        u = sum(w[rows[..., f]] for f, w in enumerate(tables))
        a = steps + block
        # Probabilities, scaled to a sum of 1 at each step.
        e, ways = np.exp(u - u.max(axis=2, keepdims=True)), np.exp(a)
        e[:, 0, 2] = 0
        forward, backward, scale = np.zeros_like(u), np.ones_like(u), np.ones(u.shape[:2])
        now = e[:, 0]
        for t in range(u.shape[1]):
            if t:
                now = np.where(live[:, t, None], (forward[:, t - 1] @ ways) * e[:, t], forward[:, t - 1])
            scale[:, t] = now.sum(axis=1)
            forward[:, t] = now / scale[:, t, None]
        for t in range(u.shape[1] - 2, -1, -1):
            backward[:, t] = np.where(live[:, t + 1, None], ((e[:, t + 1] * backward[:, t + 1]) @ ways.T) / scale[:, t + 1, None], 1)
        seen = forward * backward * live[..., None]
        after = e[:, 1:] * backward[:, 1:] * (live[:, 1:] / scale[:, 1:])[..., None]
        joint = ways * np.einsum("nti,ntj->ij", forward[:, :-1], after)
        missing = (true - seen).reshape(-1, 3)
        slopes = [np.stack([np.bincount(rows[..., f].ravel(), missing[:, y], len(w)) for y in range(3)], axis=1) - 0.1 * w for f, w in enumerate(tables)] + [pair - joint - 0.1 * steps]
        for w, g, m, v in zip(weights, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return [w.astype(np.float32) for w in tables], steps + block


def viterbi(scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best tags of one chain that outside tokens enclose."""
    best = scores[0] + steps[0]
    back = np.zeros((len(scores), 3), np.int64)
    for t in range(1, len(scores)):
        ways = best[:, None] + steps
        back[t] = ways.argmax(axis=0)
        best = ways.max(axis=0) + scores[t]
    tags = [int((best + steps[:, 0]).argmax())]
    for t in range(len(scores) - 1, 0, -1):
        tags.append(int(back[t, tags[-1]]))
    return np.array(tags[::-1])


def _bounds(steps: np.ndarray) -> tuple[float, float]:
    """The most that transitions can return for another tag than outside, where the next token is not, or is, inside.

    With outside in its place, an inside token after it would have to begin; what that changes at the next two
    transitions counts too.
    """
    tags = range(3)
    plain = max(steps[x, y] + steps[y, z] - steps[x, 0] - steps[0, z] for x in tags for y in (1, 2) for z in (0, 1))
    onward = max(steps[x, y] + steps[y, 2] + steps[2, z] - steps[x, 0] - steps[0, 1] - steps[1, z] for x in tags for y in (1, 2) for z in tags)
    return float(plain), float(onward)


def decode(tokens: Tokens, tables: list[np.ndarray], steps: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, first byte, byte after the last) of each tagged secret of the batch."""
    u = _scores(tokens.rows, tables)
    if not len(u):
        return []
    plain, onward = _bounds(steps)
    longer = np.concatenate(((u[1:, 2] - u[1:, 1]), [0.0]))
    open_ = u[:, 0] - np.maximum(u[:, 1], u[:, 2]) <= np.maximum(plain, onward + longer)
    at = np.flatnonzero(open_)
    if not len(at):
        return []
    breaks = np.flatnonzero((np.diff(at) > 1) | tokens.first[at[1:]]) + 1
    out = []
    for chain in np.split(at, breaks):
        if len(chain) == 1:
            i = chain[0]
            tags = [1] if u[i, 1] + steps[0, 1] + steps[1, 0] > u[i, 0] + 2 * steps[0, 0] else [0]
        else:
            tags = viterbi(u[chain].astype(np.float64), steps)
        for i, y in zip(chain.tolist(), tags, strict=True):
            if y == 1 or y == 2 and (not out or out[-1][2] > tokens.begin[i]):
                out.append((int(tokens.doc[i]), int(tokens.begin[i]), int(tokens.end[i])))
            elif y == 2:
                out[-1] = (out[-1][0], out[-1][1], int(tokens.end[i]))
    return out


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE_DOCS) -> tuple[list[np.ndarray], np.ndarray]:
    """Trains on `sample` documents, chosen by the hash of key and text; only they leave their tasks."""
    rows = bounded_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), sample, SAMPLE_BYTES, "text", "key", "text").toArrow()
    return train(rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, model: tuple[list[np.ndarray], np.ndarray] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, and an array of (kind, start, end) in code points, end exclusive, by start and kind; kind crf is the field's."""
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text, key))  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, steps = known.value
        for batch in slices(batches):
            whole = texts(batch)
            column = pa.array(whole, pa.large_string())
            may = np.stack([np.asarray(pc.match_substring_regex(column, p)) for p in _MAY], axis=1)
            found: list[list[tuple[int, int, int]]] = [base_spans(t, tuple(m)) if any(m) else [] for t, m in zip(whole, may.tolist(), strict=True)]
            tokens = Tokens(column)
            for i, begin, end in decode(tokens, tables, steps):
                lead = tokens.data[tokens.offsets[i] : begin]
                start = int(((lead & 0xC0) != 0x80).sum())
                stop = start + end - begin if (tokens.data[begin:end] < 128).all() else start + int(((tokens.data[begin:end] & 0xC0) != 0x80).sum())
                if not any(s < stop and e > start for s, _, e in found[i]):
                    found[i].append((start, 3, stop))
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(x)] for x in found]
            yield pa.record_batch([batch["key"], pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["key", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, spans array<struct<kind string, start long, end long>>").withColumnRenamed("key", key)


def summary(found: DataFrame) -> DataFrame:
    """The counts and digests of find_secrets' spans."""
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("crf"))
