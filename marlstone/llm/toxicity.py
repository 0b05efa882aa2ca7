"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Every string that has
another reading (leetspeak, separators or spaces between letters, repeated
letters) becomes a lattice of what each character may stand for, at the cost of
the channel; a Viterbi search over the whole string under the character model
restores the likeliest text. Where each character has one reading the search has
one path, so plain words are taken as they are; so are strings without a letter,
numbers and punctuation. Words with doubled letters stand for themselves beside
what is restored from them. A logistic model over restored words and their
beginnings, learnt from labelled rows, scores the restored text.

Defined results: null and empty texts have no features and get the model's base
score; rows with a null doc_id are scored and never learnt from; a doc_id
labelled more than once is toxic if any label says so, null labels are ignored;
without labelled rows of both kinds, or without a telling feature, every score
is 0 (to many digits); an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Memo, blocks, cut, drop_cut, rows_of, ship, text_buffer

#: Symbols of the character model: border, other, a to z and Latin-1 letters.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_SYMBOL = {c: i + 2 for i, c in enumerate(_LETTERS)}
SYMBOLS = len(_LETTERS) + 2
_BORDER, _OTHER = 0, 1

#: What a character may stand for besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
_SEPARATORS = " .-_*'`~^·•,/\\"
#: Channel costs (nats) of reading a sign as a letter, and of dropping a
#: separator, the second or a further one of equal letters.
COST_LEET, COST_KEEP, COST_DROP, COST_SECOND, COST_REPEAT = 1.0, 5.0, 0.3, 1.5, 0.1

_EDGE = "\"'`.,;:?%&*#)(]}[{>“”„«»…!-_~^/\\|"
_PLAIN_EDGE = "".join(c for c in _EDGE if c not in LEET)
#: Words without a character that this finds have one reading.
_READINGS = re.compile("[" + re.escape("".join(LEET) + _SEPARATORS) + "]")
_LETTER = re.compile(r"[^\W\d_]")
_TWICE = re.compile(r"(.)\1")
_DOUBLED = re.compile(r"([a-zß-ÿ])\1")
#: Three or more single letters or signs with gaps between them, up to any border
#: of a word; what follows an apostrophe in a word begins none.
_GAP = re.compile(r"[\s._*\-/\\~'`^·•,]+")
_SPACED = re.compile(r"(?<![^\W_])(?<![^\W_]['’])(?:[^\W_]|[@$!|+€£])(?:[\s._*\-/\\~'`^·•,]{1,8}(?:[^\W_]|[@$!|+€£])){2,}(?![^\W_])")


def _symbol_table() -> np.ndarray:
    out = np.zeros(0x250, np.int64)
    out[:] = _OTHER
    for code in range(0x250):
        c = chr(code)
        low = c.lower()
        if len(low) == 1 and low in _SYMBOL:
            out[code] = _SYMBOL[low]
        elif not c.isalpha():
            out[code] = _BORDER
    return out


def trigram_counts(docs: DataFrame) -> DataFrame:
    """Counts of letter trigrams over all whole texts, words bordered; summed
    in each batch, then by key, so at most SYMBOLS**3 rows result."""

    def run(batches):
        table = _symbol_table()
        for batch in batches:
            total = np.zeros(SYMBOLS**3, np.int64)
            _, offsets = text_buffer(batch.column("text"))
            for i, j in blocks(offsets):
                # Each text counts the same wherever a block begins.
                text = "\n\n".join(t or "" for t in batch.column("text").slice(i, j - i).to_pylist())
                codes = np.frombuffer(("\n\n" + text + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
                s = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], _OTHER)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])

    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cost (nats) of the third symbol after two, interpolated."""
    count = np.zeros((SYMBOLS,) * 3)
    count.ravel()[gram] = n
    two, one = count.sum(0), count.sum((0, 1))

    def share(c: np.ndarray) -> np.ndarray:
        total = c.sum(-1, keepdims=True)
        return np.divide(c, total, out=np.full_like(c, 1 / SYMBOLS), where=total > 0)

    p = 0.8 * share(count) + 0.15 * share(two)[None] + 0.04 * share(one)[None, None] + 0.01 / SYMBOLS
    return -np.log(p)


def restore(word: str, cost: list[list[list[float]]]) -> str:
    """The likeliest word (or words) behind a whole string, by a Viterbi search
    over the lattice of its characters, in time linear in its length. A state is
    the last two symbols and links back to what was read before. ``cost`` is the
    language model as lists, whose items are read faster than an array's."""
    states: dict[tuple, tuple[float, tuple | None]] = {(_BORDER, _BORDER): (0.0, None)}
    before = earlier = ""
    for c in word:
        letter = _SYMBOL.get(c)
        if letter is not None:
            choices = [(c, 0.0, letter)]
        else:
            choices = [(x, COST_LEET, _SYMBOL[x]) for x in LEET.get(c, "")]
            choices.append((c, 1.0, _BORDER) if c == " " else (c, COST_KEEP, _OTHER))
        drop = None
        if letter is None and c in _SEPARATORS:
            drop = COST_DROP
        elif c == before:
            drop = COST_REPEAT if c == earlier else COST_SECOND
        earlier, before = before, c
        after: dict[tuple, tuple[float, tuple | None]] = {}
        for (a, b), (so_far, link) in states.items():
            row = cost[a][b]
            for x, price, s in choices:
                total = so_far + price + row[s]
                known = after.get((b, s))
                if known is None or total < known[0] - 1e-12:
                    after[b, s] = (total, (link, x))
            if drop is not None:
                known = after.get((a, b))
                if known is None or so_far + drop < known[0] - 1e-12:
                    after[a, b] = (so_far + drop, link)
        states = after
    best = min(((v + cost[a][b][_BORDER], a, b) for (a, b), (v, _) in states.items()))
    link, out = states[best[1:]][1], []
    while link is not None:
        link, x = link
        out.append(x)
    return "".join(reversed(out))


#: Strings that a restorer or scorer remembers a generation.
ENTRIES = 50_000


def features(word: str) -> list[str]:
    """A word and its beginnings of three to six letters (marked)."""
    return [word, *[word[:n] + "*" for n in range(3, 7) if len(word) > n]]


class Restorer:
    """Restored words of a text; ``known`` remembers those of each string."""

    def __init__(self, cost: np.ndarray):
        self.table = cost.tolist()
        self.known = Memo(self.word, ENTRIES)

    def word(self, raw: str) -> tuple[str, ...]:
        core = raw.strip(_EDGE)
        if core.isalpha() and not _TWICE.search(core) and raw.startswith(core) and not raw[len(core) :].strip(_PLAIN_EDGE):
            return (core,)
        parts: dict[str, None] = {}
        # A sign at either end may be punctuation or a letter.
        for word in dict.fromkeys((core, raw.rstrip(_EDGE).lstrip(_PLAIN_EDGE), raw.lstrip(_EDGE).rstrip(_PLAIN_EDGE))):
            doubled = _DOUBLED.search(word)
            if doubled:
                parts.update(_parts(word))
            if (doubled or _READINGS.search(word) or _TWICE.search(word)) and _LETTER.search(word):
                word = restore(word, self.table)
            parts.update(_parts(word))
        return tuple(parts)

    def spaced(self, text: str) -> set[str]:
        """Words behind the runs of spaced letters of a lower-cased text."""
        out: set[str] = set()
        for m in _SPACED.finditer(text):
            for run in _readings(m.group()):
                out.update(restore(run, self.table).split())
        return out

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        out = self.spaced(low)
        for found in map(self.known.__getitem__, set(low.split())):
            out.update(found)
        return out


def _parts(word: str) -> dict[str, None]:
    return {word: None} if word.isalnum() else dict.fromkeys(x for x in re.split(r"[^\w]+", word) if x)


def _readings(run: str) -> dict[str, None]:
    """Spaced letters with one sign a gap: all of them, without signs at the ends
    that may be punctuation, and the parts between wider spaces."""
    out: dict[str, None] = {}
    for part in (run, run.strip(_EDGE + " "), *re.split(r"\s{2,}", run)):
        short = _GAP.sub(lambda m: m[0][0] if not re.search(r"\s", m[0]) else " ", part)
        if len(short) >= 5:
            out[short] = None
    return out


@dataclass
class Model:
    """Logistic weights of features, a base and the character model."""

    cost: np.ndarray
    weights: dict[str, float]
    base: float

    def scorer(self):
        restorer, weights, base = Restorer(self.cost), self.weights, self.base
        # Every feature of a word begins as the word does.
        heads = {f[:3] for f in weights}

        def hits(words) -> tuple[str, ...]:
            return tuple(f for w in words if w[:3] in heads for f in features(w) if f in weights)

        of = Memo(lambda raw: hits(restorer.word(raw)), ENTRIES)

        def score(text: str | None) -> float:
            low = (text or "").lower()
            active = set(hits(restorer.spaced(low)))
            for hit in map(of.__getitem__, set(low.split())):
                if hit:
                    active.update(hit)
            z = base + sum(weights[f] for f in sorted(active))
            return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))

        return score


#: Most labelled rows that the classifier is fitted on, of each label; the rows
#: with the smallest hashes of their ids are taken.
TRAIN_ROWS = 4000
#: Least toxic rows, their share of all toxic rows, and log odds that a feature
#: needs: one that says less about the label is none. All that pass are used; the
#: training rows bound them.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 3, 0.004, 2.0


#: Base of a model that has learnt nothing.
NONE = -500.0


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Count the character model over all documents, then fit the classifier on
    labelled rows that are not held out."""
    grams = trigram_counts(docs).collect()
    cost = language_model(np.array([r.gram for r in grams], np.int64), np.array([r.n for r in grams], float))
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for y in (0, 1)]
    # At most 2 * train_rows ids.
    chosen = F.broadcast(picks[0].unionByName(picks[1]))

    def run(batches):
        restorer = Restorer(cost)
        for batch in batches:
            for part in rows_of(batch):
                words = [sorted({f for w in restorer.words(t) for f in features(w)}) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array(words, pa.list_(pa.string()))], ["toxic", "features"])

    size = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    if not clean or not toxic:
        return Model(cost, {}, NONE)
    # Written, as the features are counted and then looked up: texts are restored once.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    rows = cut(found.mapInArrow(run, "toxic int, features array<string>"), "features")
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    counts = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    strong = counts.filter((F.col("t") >= max(LEAST_ROWS, LEAST_SHARE * toxic)) & (odds >= LEAST_ODDS)).orderBy(F.desc("t"), "feature")
    names = [r.feature for r in strong.select("feature").collect()]
    if not names:
        drop_cut(rows)
        return Model(cost, {}, NONE)
    place = {f: i for i, f in enumerate(names)}

    def active(batches):
        for batch in batches:
            found = [[place[f] for f in fs if f in place] for fs in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "active"])

    data = rows.mapInArrow(active, "toxic int, active array<int>").toPandas()
    drop_cut(rows)
    weights, base = _logistic([np.asarray(a, np.int64) for a in data.active], data.toxic.to_numpy(float), len(names))
    return Model(cost, {f: float(w) for f, w in zip(names, weights, strict=True) if w > 0}, base)


def _logistic(rows: list[np.ndarray], y: np.ndarray, n: int, decay: float = 1e-5, steps: int = 800, rate: float = 0.03) -> tuple[np.ndarray, float]:
    """Logistic regression with weights of at least zero by projected Adam steps;
    both labels weigh alike. The last weight is the base."""
    order = sorted(range(len(rows)), key=lambda i: (y[i], rows[i].tobytes()))  # the same sums whatever the rows' order
    rows, y = [rows[i] for i in order], y[order]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    w, mean, square = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = -3.0
    floor = np.append(np.zeros(n), -np.inf)
    for step in range(1, steps + 1):
        z = w[n] + np.bincount(row, w[col], len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(col, error[row], n), error.sum()) + decay * w
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        w = np.maximum(floor, w - rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9))
    w, base = w[:n], w[n]
    if len(y) < 2:
        return w, float(base)
    # The score 0.5 lies in the middle of the best gap between the labels.
    z = base + np.bincount(row, w[col], len(y))
    place = np.argsort(z, kind="stable")
    right = np.cumsum(np.where(y[place] > 0, -weight[place], weight[place]))
    at = int(np.argmax(right[:-1]))
    return w, float(base - z[place[at : at + 2]].mean()) if z[place[at]] < z[place[at + 1]] else float(base)


def held_out(folds: int = 5):
    """Rows that nothing is learnt from: crc32 of the id as text divides."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        one = shared.value.scorer()
        for batch in batches:
            for part in rows_of(batch):
                found = np.array([one(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    ship(docs.sparkSession)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        one = shared.value.scorer()
        for batch in batches:
            for part in rows_of(batch):
                yield part.filter(pa.array([one(t) < threshold for t in part.column("text").to_pylist()], pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
