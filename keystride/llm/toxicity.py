"""Toxicity of texts, scored on what a noisy-channel decoder restores.

1. Language model: letter trigrams counted over every word of every text, accents folded, so at most
   28 cubed counts (``letter_counts``); each batch adds up its own before the shuffle.
2. Restoration: a word with digits or marks among its letters, with a letter three times in a row, or
   spelled out letter by letter, becomes a lattice: each sign may stand for itself as a letter, for
   the letters it resembles, or for nothing; a run may be one or two letters. Viterbi decoding under
   the model and the channel's costs picks the word. In spelled-out runs (three signs or more, any white
   space between) a separator may also be a word boundary, scored by the edge symbol, so a run is
   decoded to words. Words cut into pieces by white space or a joint are put together where a telling
   word comes of it and the model finds it likelier than the pieces. Other words stay as they are.
3. Scores: logistic regression over the presence of telling words and word beginnings among written
   and restored words. These are the features whose document counts differ most between the labels.

The classifier is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hashes of their
ids; label rows with a null are left out, and an id with several labels takes the largest. Without rows
of both labels every score is the share of label 1, or 0.5 without labels. Null and empty texts have no
features and get the score of the constant alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride.llm.common import bounded_sample, map_columns, ship, bound_batches
from keystride.session import materialize

SAMPLE = 20_000         # labelled rows the classifier is fitted on, at most
TELLING = 600           # features kept
LEAST_DOCS = 5          # documents a feature must occur in
BEGINNINGS = (4, 5, 6)  # lengths of word beginnings used as features
PENALTY = 1e-3
STEPS = 3000            # of the regression
THRESHOLD = 0.5
MEMO_WORDS = 150_000
MEMO_LENGTH = 40

# Letters that signs are written for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h",
    "€": "e", "£": "l", "¡": "i", "§": "s", "µ": "u", "¢": "c", "%": "x", "&": "e",
}
# Costs of the channel, in nats.
COST_LOOKALIKE = 1.0
COST_WILD = 2.2       # a sign that stands for any vowel
COST_DROP = 2.5       # a sign that stands for nothing
COST_SEPARATOR = 0.5  # a dot, dash, space or the like between letters
COST_JOIN = 1.0       # white space or a joint inside a word of letters
SEPARATORS = " .-_*~,'"

EDGE = "^"
OTHER = "?"
ALPHABET = EDGE + OTHER + "abcdefghijklmnopqrstuvwxyz"
N = len(ALPHABET)
_PLACE = {c: i for i, c in enumerate(ALPHABET)}
_SPELLED = re.compile(r"(?<!\S)\S(?:(?:\s+|[._*~-])\S){2,}(?!\S)")
_SPACES = re.compile(r"\s+")
_RUN = re.compile(r"([^\W\d_])\1\1")
_JOINTS = re.compile("[-'’]")
_STRIP = ".,;:?!\"'()[]{}<>|#%&*$=+-_/\\"


def fold(char: str) -> str:
    """A letter of the model's alphabet for a character: accents off, other letters as one."""
    base = unicodedata.normalize("NFKD", char)[:1]
    return base if base in _PLACE and base not in (EDGE, OTHER) else OTHER


def is_noisy(word: str) -> bool:
    """Whether a word has a letter three times in a row, or signs among its letters."""
    if _RUN.search(word):
        return True
    if word.isalpha() or not any(map(str.isalpha, word)):
        return False
    return not all(p.isalpha() and len(p) > 1 for p in _JOINTS.split(word))


class Folder(dict):
    """A translation table that fills itself."""

    def __missing__(self, code: int) -> str:
        self[code] = out = fold(chr(code))
        return out


def _trigrams(words: Counter) -> np.ndarray:
    """Counts of all trigrams of the words, edges included, as a flat cube."""
    folder, cube = Folder(), np.zeros(N ** 3, dtype=np.int64)
    codes = np.zeros(1 << 16, dtype=np.int64)
    for c, i in _PLACE.items():
        codes[ord(c)] = i
    folded = [(EDGE * 2 + w.translate(folder) + EDGE, n) for w, n in words.items()]
    if not folded:
        return cube
    joined = "".join(w for w, _ in folded)
    at = codes[np.frombuffer(joined.encode("utf-16-le"), dtype="<u2")]
    sizes = np.array([len(w) for w, _ in folded])
    weight = np.repeat([n for _, n in folded], sizes)
    ends = np.cumsum(sizes)
    third = np.ones(len(at), dtype=bool)
    third[ends - sizes] = third[ends - sizes + 1] = False
    where = np.flatnonzero(third)
    np.add.at(cube, (at[where - 2] * N + at[where - 1]) * N + at[where], weight[where])
    return cube


def letter_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``trigram int, n bigint`` over all words of all texts; at most 28 cubed rows."""
    def run(batches):
        for rows in batches:
            words: Counter = Counter()
            for t in rows.column(0).to_pylist():
                words.update((t or "").lower().split())
            clean: Counter = Counter()
            for w, n in words.items():
                w = w.strip(_STRIP)
                if w.isalpha():
                    clean[w] += n
            cube = _trigrams(clean)
            found = np.flatnonzero(cube)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(cube[found])], names=["trigram", "n"])

    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    counted = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "trigram int, n bigint")
    return counted.groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(counts: list[tuple[int, int]]) -> np.ndarray:
    """Costs (negative log probabilities) of a letter after two others, smoothed by the shorter context."""
    cube = np.zeros(N ** 3)
    for at, n in counts:
        cube[at] = n
    cube = cube.reshape(N, N, N)
    single = cube.sum(axis=(0, 1)) + 1.0
    single /= single.sum()
    double = cube.sum(axis=0)
    double = (double + 5 * single) / (double.sum(axis=1, keepdims=True) + 5)
    triple = (cube + 5 * double[None]) / (cube.sum(axis=2, keepdims=True) + 5)
    return -np.log(triple)


class Restorer:
    """Viterbi decoding of noisy words."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """For each position the texts it may stand for, with costs; a run of one letter is one position."""
        steps, i = [], 0
        while i < len(word):
            c, run = word[i], 1
            while i + run < len(word) and word[i + run] == c:
                run += 1
            if c.isalpha():
                steps.append([(c, 0.0)] if run == 1 else [(c, 0.0 if run > 2 else 1.0), (c * 2, 0.0)])
            else:
                near = [(x, COST_LOOKALIKE if c != "*" else COST_WILD) for x in LOOKALIKES.get(c, "")]
                skip = COST_SEPARATOR if c in SEPARATORS else COST_DROP
                steps += [[*near, ("", skip)]] * min(run, 2)
            i += run
        return steps

    def cost(self, word: str) -> float:
        """Of a word as it stands."""
        u, v, total = 0, 0, 0.0
        for c in word:
            w = _PLACE.get(c) or _PLACE[fold(c)]
            total += self.costs[u][v][w]
            u, v = v, w
        return total + self.costs[u][v][0]

    def joins(self, pieces: list[str]) -> bool:
        """Whether pieces are likelier one word than words of their own."""
        return self.cost("".join(pieces)) + COST_JOIN * (len(pieces) - 1) < sum(map(self.cost, pieces))

    def restore(self, word: str, boundaries: bool = False) -> str:
        """The likeliest word behind a noisy one; ties go to the alternative listed first.

        With ``boundaries`` a separator may also end a word; the words come with a space between.
        """
        # State: the last two letters; value: cost and the place of the state before with the letters added.
        states = {(0, 0): 0.0}
        trail = []
        for step in self.lattice(word):
            if boundaries and step == [("", COST_SEPARATOR)]:
                step = [*step, (" ", 0.0)]
            after: dict[tuple[int, int], float] = {}
            back = {}
            for (p, q), cost in states.items():
                for out, extra in step:
                    u, v, total = p, q, cost + extra
                    if out == " ":
                        total += self.costs[u][v][0]
                        u = v = 0
                    else:
                        for c in out:
                            w = _PLACE.get(c) or _PLACE[fold(c)]
                            total += self.costs[u][v][w]
                            u, v = v, w
                    if total < after.get((u, v), math.inf):
                        after[u, v] = total
                        back[u, v] = ((p, q), out)
            states = after
            trail.append(back)
        ends = {s: c + self.costs[s[0]][s[1]][0] for s, c in states.items()}
        at = min(ends, key=ends.get)
        letters = []
        for back in reversed(trail):
            at, out = back[at]
            letters.append(out)
        return "".join(reversed(letters))

    def words(self, text: str | None) -> tuple[list[str], set[str]]:
        """The written words of a whole text in order, and the distinct spelled-out runs."""
        low = (text or "").lower()
        return low.split(), {_SPACES.sub(" ", m.group()) for m in _SPELLED.finditer(low)}


@dataclass
class Features:
    """Features of words, remembered for the words seen last."""

    restorer: Restorer
    wanted: dict[str, int] | None = None  # all, while features are being counted
    memo: dict[str, tuple] = field(default_factory=dict)
    older: dict[str, tuple] = field(default_factory=dict)  # the memo before, for words still in use
    starts: set[str] = field(default_factory=set)  # of wanted words, shorter than these
    heads: set[str] = field(default_factory=set)   # their first letters, as many as the shortest beginning has

    def __post_init__(self):
        for x in self.wanted or ():
            word = x.removesuffix("~")
            self.starts.update(word[:n] for n in range(1, len(word)))
            self.heads.add(word[:BEGINNINGS[0]])

    def of_word(self, word: str) -> tuple:
        """What a written word, and the word restored from it, give."""
        clean = word.strip(_STRIP)
        forms = {clean}
        if is_noisy(clean):
            forms.add(self.restorer.restore(clean))
            lead = word.strip(".,;:?\"'")
            if lead != clean and 0 < len(lead) - len(clean) <= 2:
                forms.add(self.restorer.restore(lead))  # marks at the ends may be letters too
        parts = _JOINTS.split(clean)
        if len(parts) > 1 and all(p.isalpha() for p in parts) and self.restorer.joins(parts):
            forms.add("".join(parts))
        names = set()
        for f in forms:
            if f:
                names.add(f)
                names.update(f"{f[:n]}~" for n in BEGINNINGS if len(f) >= n)
        if self.wanted is None:
            return tuple(names)
        return tuple(self.wanted[x] for x in names if x in self.wanted)

    def of_pieces(self, words: list[str], at: int) -> set:
        """What the word at a place gives together with those after it."""
        joined = words[at].lstrip(_STRIP)
        pieces, found = [joined], set()
        while joined in self.starts and at + len(pieces) < len(words):
            piece = words[at + len(pieces)].strip(_STRIP)
            if not piece.isalpha():
                break
            known, joined = len(joined), joined + piece
            if joined[:BEGINNINGS[0]] not in self.heads and joined not in self.starts:
                break
            pieces.append(piece)
            names = [joined, *(f"{joined[:n]}~" for n in BEGINNINGS if known < n <= len(joined))]
            if any(x in self.wanted for x in names) and self.restorer.joins(pieces):
                found.update(self.wanted[x] for x in names if x in self.wanted)
        return found

    def of_text(self, text: str | None) -> set:
        in_order, spelled = self.restorer.words(text)
        written = set(in_order)
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        found: set = set()
        memo, older = self.memo, self.older
        for w in written:
            got = memo.get(w)
            if got is None:
                got = older.get(w)
                if got is None:
                    got = self.of_word(w)
                if len(w) <= MEMO_LENGTH:
                    memo[w] = got
            if got:
                found.update(got)
        if self.starts:
            lead = {w for w in written if w.lstrip(_STRIP) in self.starts}
            for at in [i for i, w in enumerate(in_order) if w in lead]:
                found.update(self.of_pieces(in_order, at))
        for s in spelled:
            for w in self.restorer.restore(s, boundaries=True).split():
                found.update(self.of_word(w))
            # A word of one letter may stand beside the spelled-out one.
            for run in {s, s[2:], s[:-2], s[2:-2]}:
                found.update(self.of_word(run))
        return found


@dataclass
class Model:
    costs: np.ndarray
    features: dict[str, int]
    weights: np.ndarray
    bias: float

    def scorer(self):
        look = Features(Restorer(self.costs), self.features)

        def score(text: str | None) -> float:
            total = self.bias + sum(self.weights[i] for i in sorted(look.of_text(text)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

        return score


def _telling(sample: DataFrame, costs: np.ndarray, ones: float, zeros: float) -> list[str]:
    """The features whose document counts depend most on the label (likelihood ratio)."""
    def run(batches):
        look = Features(Restorer(costs))
        for rows in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                seen[int(label)].update(look.of_text(text))
            # Words met in one document of a batch only may still add up over batches.
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array([seen[k][x] for x in names], pa.int64()) for k in (0, 1)]],
                names=["feature", "zero", "one"])

    counted = sample.select("_text", "label").mapInArrow(run, "feature string, zero bigint, one bigint")
    summed = counted.groupBy("feature").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    term = lambda k, n, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    share = (F.col("zero") + F.col("one")) / (ones + zeros)
    ratio = term(F.col("one"), ones, share) + term(F.col("zero"), zeros, share) \
        + term(ones - F.col("one"), ones, 1 - share) + term(zeros - F.col("zero"), zeros, 1 - share)
    best = summed.where(F.col("zero") + F.col("one") >= LEAST_DOCS).orderBy(F.desc(F.round(ratio, 6)), "feature")
    return [r.feature for r in best.limit(TELLING).select("feature").collect()]


def _regress(rows: list[list[int]], labels: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps with momentum; rows list the features present."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.array([i for r in rows for i in r], dtype=np.int64)
    w, b, vw, vb = np.zeros(n), math.log(labels.mean() / (1 - labels.mean())), np.zeros(n), 0.0
    for _ in range(STEPS):
        total = b + np.bincount(at, w[which], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels
        grad = np.bincount(which, error[at], minlength=n) / len(rows) + PENALTY * w / 10
        vw, vb = 0.9 * vw - 2.0 * grad, 0.9 * vb - 0.5 * error.mean()
        w, b = w + vw, b + vb
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = SAMPLE) -> Model:
    """The language model of all ``docs``, and the classifier of those that ``labels`` names."""
    # At most 28 cubed rows.
    costs = language_model([(r.trigram, r.n) for r in letter_counts(docs, text).collect()])
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(label).cast("int").alias("label"))
    chosen = bounded_sample(marks, "_id", sample)
    named = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    # At most ``sample`` small rows are sent out.
    used = materialize(named.join(F.broadcast(chosen), "_id").select("_id", "_text", (F.col("label") > 0).cast("int").alias("label")))
    row = used.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    if not row.n or not 0 < row.ones < row.n:
        share = row.ones / row.n if row.n else 0.5
        return Model(costs, {}, np.zeros(0), math.log((share + 1e-6) / (1 - share + 1e-6)))
    names = _telling(used, costs, float(row.ones), float(row.n - row.ones))
    features = {x: i for i, x in enumerate(names)}

    def run(batches):
        look = Features(Restorer(costs), features)
        for rows in batches:
            found = [sorted(look.of_text(t)) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.string()), pa.array(found, pa.list_(pa.int32())), rows.column(2)],
                names=["id", "found", "label"])

    # The presence of a few hundred features in at most ``sample`` rows, in one order on every run.
    seen = used.select("_id", "_text", "label").mapInArrow(run, "id string, found array<int>, label int")
    table = sorted(((r.id, list(r.found), r.label) for r in seen.toLocalIterator()), key=lambda r: (r[0], r[1]))
    weights, bias = _regress([r[1] for r in table], np.array([r[2] for r in table], dtype=float), len(names))
    return Model(costs, features, weights, bias)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Kept columns, ``score double`` and ``predicted int``."""
    def make():
        scorer = model.scorer()

        def compute(texts: pa.Array) -> list[pa.Array]:
            scores = np.array([scorer(t) for t in texts.to_pylist()])
            return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

        return compute

    return map_columns(docs, [F.col(f"`{text}`").cast("string")], keep, "score double, predicted int", make)


def restore(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns and ``restored string``: the whole text with noisy words replaced, lower-cased."""
    def make():
        restorer = Restorer(model.costs)

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            low = _SPELLED.sub(lambda m: restorer.restore(_SPACES.sub(" ", m.group()), boundaries=True), t.lower())
            return re.sub(r"\S+", lambda m: restorer.restore(m.group()) if is_noisy(m.group().strip(_STRIP)) else m.group(), low)

        def compute(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([one(t) for t in texts.to_pylist()], pa.string())]

        return compute

    return map_columns(docs, [F.col(f"`{text}`").cast("string")], keep, "restored string", make)
