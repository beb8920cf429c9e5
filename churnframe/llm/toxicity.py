"""Toxicity: noisy-channel deobfuscation, then a word-evidence score.

Channel.  A token that mixes letters with look-alike signs or other marks,
stretches a letter, doubles most of its letters, or is part of a row of single
spaced-out characters is a character lattice, whatever its length: each sign offers the letters it may
stand for, a run of one letter offers once or twice, a mark inside a token is
dropped or ends a word (its parts, and all of it joined, are read too).  Viterbi finds the likeliest reading under a character trigram
model and fixed channel costs.  A row of three or more spaced-out characters
(signs included, one of them a letter) is one lattice with an optional word end
after each character; all words of its best path are looked up, and evidence
words of ``INNER`` or more letters at every place of it.  What sets characters
apart may be any white space or marks, any number of them.  Words cut into
pieces of up to ``PIECE`` letters are found by joining neighbours: a joined
word counts if it is an evidence word itself.  The model's counts come from every document
(bytes in 28 classes: boundary, a-z, non-ASCII), so they grow with the corpus.

Score.  Evidence is looked up by whole word and by word beginnings of 3 to 6
characters (inflected and compounded forms), in the plain and in the restored
text; a beginning also counts as dense if it starts two or more words and 1 %
of the text's words.  Each feature's log odds come from labelled training
rows; features whose odds are weak at the lower end of their confidence
interval are dropped.  The score is a
calibrated logistic in the summed and the strongest evidence; a calibration
row is judged without its own share of the counts.  Rows whose crc32(doc_id)
mod 3 is 1 are never learned from.  Training reads at most about ``SAMPLE``
labelled rows (hash sample of the labels).

Defined results: NULL and empty texts have no evidence and get the base score;
NULL labels are not learned from; repeated label rows and equal
texts of one label count once; with
no labels or one class only, the score is 0 for all; whole texts are scored,
each distinct word of a text once; extra columns ride in ``row``.  A NULL
doc_id is not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C

SAMPLE = 12_000
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7
MIN_ODDS = 1.5
MIN_DOCS = 3
CONFIDENCE = 1.28  # standard errors below the estimate
PIECE, PIECES = 4, 6  # letters of a piece of a cut word, and pieces, at most
INNER = 4  # letters of the shortest word looked for inside a spaced-out run
CACHE = 400_000  # tokens remembered by a scoring task
COUNTED = 100_000  # tokens, and features being counted, held by a learning task

#: Letters that a sign may stand for.
LOOKALIKES = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "*": "aeiou",
}
SIGN_COST, STRETCH_COST, BREAK_COST, WIDE_COST = 1.0, 0.5, 0.5, 4.0

_EDGE = ".,;:!?\"'()[]{}<>*%&$#|-_/\\+=~`«»“”…"
_MARKS = ".,;:?\"'[]{}<>%&#-_/\\=~`«»“”…"  # never letters
_INNER = re.compile(r"(?:[^\w@$!|+(*]|_)+")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
# single characters (a letter, a digit, a sign) with white space or marks between
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+(*])(?:(?>(?:[^\w@$!|+(]|_)+)(?:[^\W_]|[@$!|+(])(?![^\W_])){2,}")
_SINGLE = re.compile(r"([^\W_]|[@$!|+(*])((?:[^\w@$!|+(*]|_)*)")


# ------------------------------------------------------------ language model

_CLASS = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256)])


def count_trigrams(texts: list[bytes]) -> np.ndarray:
    x = _CLASS[np.frombuffer(b"  ".join([b"", *texts, b""]), np.uint8)]
    return np.bincount(x[:-2] * 784 + x[1:-1] * 28 + x[2:], minlength=28**3)


def language_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """Log probability [previous two classes, class], over all documents.
    The driver gets 28^3 sums at most."""
    schema = T.StructType([C.field("gram", "int"), C.field("n", "long")])

    def make():
        def run(batches):
            total = np.zeros(28**3, np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    total += count_trigrams(whole.column("text").slice(at, 512).to_pylist())
            seen = np.flatnonzero(total)
            yield {"gram": seen.astype(np.int32), "n": total[seen]}

        return run

    grams = C.emit_rows(docs.select(C.utf8(text_col).alias("text")), make, schema)
    counts = np.ones(28**3)
    for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] += r.n
    counts = counts.reshape(28 * 28, 28)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


def _best(steps: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The cheapest path through a lattice (Viterbi on the last two classes);
    a step is a list of (piece, cost), a space in a piece ends a word."""
    # a state's text is its tail after a chain of blocks: linear in the token
    states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, "", None)}
    for options in steps:
        new: dict[tuple[int, int], tuple] = {}
        for (a, b), (cost, text, chain) in states.items():
            if len(text) > 64:
                text, chain = "", (chain, text)
            for piece, extra in options:
                p, q, total = a, b, cost + extra
                for c in piece:
                    k = _letter(c)
                    total -= float(model[p * 28 + q, k])
                    p, q = q, k
                old = new.get((p, q))
                if old is None or total < old[0]:
                    new[(p, q)] = (total, text + piece, chain)
        states = new

    def whole(text: str, chain) -> str:
        out = [text]
        while chain:
            chain, text = chain
            out.append(text)
        return "".join(reversed(out))

    ends = [(cost - float(model[a * 28 + b, 0]), text, chain) for (a, b), (cost, text, chain) in states.items()]
    least = min(ends, key=lambda e: e[0])[0]
    return min(whole(text, chain) for cost, text, chain in ends if cost == least)


def _options(c: str, n: int) -> list[tuple[str, float]]:
    """Readings of a run of one character."""
    if c.isalpha():
        return [(c, 0.0 if n == 1 else STRETCH_COST), (c * 2, 0.0 if n == 2 else STRETCH_COST)][: min(n, 2)]
    if c in LOOKALIKES:
        return [(x * k, SIGN_COST * n) for x in LOOKALIKES[c] for k in range(1, min(n, 2) + 1)]
    return [("", SIGN_COST * n)]


def _runs(token: str) -> list[tuple[str, int]]:
    return [(m.group(1), len(m.group(0))) for m in re.finditer(r"(.)\1*", token, re.S)]


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest plain word behind a token (steps are runs of one character)."""
    return _best([_options(c, n) for c, n in _runs(token)], model)


def readings(token: str, model: np.ndarray) -> list[str]:
    """Plain words to look up for one lower-case token."""
    core = token.strip(_EDGE)
    out = [core] if core else []
    if _STRETCH.search(core):
        out.append(decode(core, model))
    elif len(core) >= 6 and len(_DOUBLE.findall(core)) >= 3 and core.isalpha():
        runs = _runs(core)
        doubled = sum(n == 2 for _, n in runs)
        if doubled >= 3 and 2 * doubled >= len(runs):  # no plain word doubles so many of its letters
            out += [decode(core, model), "".join(c for c, _ in runs)]
    signs = token.strip(_MARKS)
    if signs.isalpha() or not any(c.isalpha() for c in signs):
        return out
    forms = set()
    # signs at the ends may be letters or marks
    for form in {signs, signs.rstrip("!|+(*"), core}:
        parts = [p for p in _INNER.split(form) if p]
        # marks inside part words, or stand between the letters of one, or both
        forms.update(p for p in parts if any(c.isalpha() for c in p))
        forms.add("".join(parts))
        if len(parts) > 2:
            steps = [[("", SIGN_COST * n), (" ", BREAK_COST)] if _INNER.match(c) else _options(c, n) for c, n in _runs(form)]
            out += _best(steps, model).split()
    out += [f if f.isalpha() and not _STRETCH.search(f) else decode(f, model) for f in sorted(forms)]
    return list(dict.fromkeys(out))


def spaced_words(text: str, model: np.ndarray) -> list[str]:
    """Words written as single characters set apart: of each run the joined
    characters, and the words of the best path with an optional word end after
    each character."""
    out: list[str] = []
    for m in _SPACED.finditer(text):
        run = m.group(0)
        if not any(c.isalpha() for c in run):
            continue
        # signs at the end may be letters or marks
        for form in dict.fromkeys((run, run.rstrip(" .-_!|+(*"))):
            chars = [(c, len(gap)) for c, gap in _SINGLE.findall(form)]
            if len(chars) > 2:
                out += _spaced_readings(chars, model)
    return list(dict.fromkeys(out))


def _spaced_readings(chars: list[tuple[str, int]], model: np.ndarray) -> list[str]:
    steps: list[list[tuple[str, float]]] = []
    narrow = min(gap for _, gap in chars[:-1])
    groups: list[list] = []
    for c, gap in chars:
        if groups and groups[-1][0] == c and groups[-1][2] == narrow:
            groups[-1][1:] = [groups[-1][1] + 1, gap]
        else:
            groups.append([c, 1, gap])
    for c, n, gap in groups:
        options = _options(c, n)
        if c.isalpha() and n > 1:
            options.append((f"{c} {c}", STRETCH_COST * (n > 2) + BREAK_COST))
        elif c == "*":
            options.append(("", SIGN_COST * n))
        steps.append(options)
        # a gap wider than the others speaks for a word end
        steps.append([("", 0.0), (" ", BREAK_COST)] if gap <= narrow else [("", WIDE_COST), (" ", 0.0)])
    joined = "".join(c for c, _ in chars)
    joined = joined if joined.isalpha() else decode(joined, model)
    return [joined, *_best(steps[:-1], model).split()]


def _piece(token: str) -> str:
    """The letters of a token that may be a piece of a cut word, or nothing."""
    core = token if token.isalpha() else token.strip(_EDGE)
    return core if len(core) <= PIECE and core.isalpha() else ""


def word_features(word: str) -> list[str]:
    """The word, and its beginnings marked with a dash."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def with_dense(counts: dict[str, int], words: int) -> set[str]:
    """Features of a text from how often each occurs in its words."""
    out = set(counts)
    out.update(f + "+" for f, n in counts.items() if n > 1 and f[-1] == "-" and 100 * n >= words)
    return out


class Reader:
    """Restored features of a text; with ``wanted``, only those listed there
    (as they are or dense), remembering tokens already read."""

    def __init__(self, model: np.ndarray, wanted: dict | None = None):
        self.model, self.known = model, {}
        self.limit = COUNTED if wanted is None else CACHE
        self.wanted = None if wanted is None else {f.rstrip("+") if f.endswith("-+") else f for f in wanted}
        whole = [f for f in self.wanted or () if len(f) >= INNER and f[-1] != "-"]
        self.beginnings = {w[:k] for w in whole for k in range(1, len(w) + 1)}
        self.inner = sorted(set(map(len, whole)))

    def of_word(self, word: str) -> list[str]:
        own = word_features(word)
        return own if self.wanted is None else [f for f in own if f in self.wanted]

    def token(self, token: str) -> tuple[tuple[str, ...], bool]:
        """Features of a token, and whether an evidence word may begin with it
        as its first piece."""
        own = self.known.get(token)
        if own is None:
            if len(self.known) > self.limit:
                self.known.clear()
            found = tuple({f for w in readings(token, self.model) for f in self.of_word(w)})
            own = self.known[token] = (found, _piece(token) in self.beginnings)
        return own

    def spaced(self, text: str) -> list[str]:
        out = []
        for word in spaced_words(text, self.model):
            # a row of single characters may also hold ordinary short words at its ends
            for a in range(min(3, len(word))):
                out += self.of_word(word[a:])
                if a:
                    out += self.of_word(word[:-a])
            if self.wanted is not None:
                # the trigrams alone may cut a row elsewhere: evidence words at every place
                out += [w for a in range(len(word)) for k in self.inner if (w := word[a : a + k]) in self.wanted and len(w) == k]
        return out

    def joined(self, words: list[str], heads: set[str]) -> list[str]:
        """Evidence words that neighbouring short pieces make together; the
        first piece is one of ``heads``."""
        out = []
        for k, word in enumerate(words):
            if word in heads:
                whole = _piece(word)
                for other in words[k + 1 : k + PIECES]:
                    piece = _piece(other)
                    whole += piece
                    if not piece or whole not in self.beginnings:
                        break
                    if len(whole) >= INNER and whole in self.wanted:
                        out += self.of_word(whole)
        return out

    def features(self, text: str) -> set[str]:
        text = text.lower()
        words = text.split()
        tokens = Counter(words)
        counts: dict[str, int] = {}
        heads = set()
        for token, n in tokens.items():
            found, head = self.token(token)
            if head:
                heads.add(token)
            for f in found:
                counts[f] = counts.get(f, 0) + n
        for f in self.spaced(text):
            counts.setdefault(f, 1)
        if heads:
            for f in self.joined(words, heads):
                counts.setdefault(f, 1)
        return with_dense(counts, tokens.total())


# ------------------------------------------------------------------ learning


def held_out(column: Column) -> Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _learn_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """toxic and text of a bounded sample of training rows."""
    key = F.col(C.quoted(id_col))
    usable = labels.where(key.isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(key))
    share = min(1.0, sample / max(1, usable.count()))
    picked = usable.where(C.hash_share(key, share)).select(key.alias("doc"), F.col("toxic").cast("int").alias("toxic")).distinct()
    # at most about `sample` rows of two numbers: a bounded broadcast
    texts = docs.select(key.alias("doc"), C.utf8(text_col).alias("text"))
    return texts.join(F.broadcast(picked), "doc").select("toxic", "text")


def _counts(rows: DataFrame, model) -> DataFrame:
    """Per feature, the documents of each class that have it."""
    schema = T.StructType([C.field("feature", "string"), C.field("toxic", "long"), C.field("clean", "long")])

    def make():
        reader = Reader(model.value)

        def run(batches):
            seen: dict[str, list[int]] = {}
            for batch in batches:
                for toxic, raw in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                    for f in reader.features(raw.decode("utf-8", "replace")):
                        seen.setdefault(f, [0, 0])[1 - toxic] += 1
                    if len(seen) > COUNTED:
                        yield _columns(seen)
                        seen = {}
            yield _columns(seen)

        return run

    return C.emit_rows(rows, make, schema).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _columns(seen: dict[str, list[int]]) -> dict:
    return {"feature": list(seen), "toxic": [v[0] for v in seen.values()], "clean": [v[1] for v in seen.values()]}


def log_odds(toxic: int, clean: int, n1: int, n0: int) -> float:
    """Smoothed log odds of a feature; 0 if there is too little evidence: the
    lower end of their confidence interval must be large enough."""
    value = math.log((toxic + 0.5) / (n1 + 1)) - math.log((clean + 0.5) / (n0 + 1))
    sure = value - CONFIDENCE * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)) >= MIN_ODDS
    return value if toxic >= MIN_DOCS and sure else 0.0


def evidence(found: set[str], odds: dict[str, float]) -> tuple[float, float]:
    """Summed (up to a bound) and strongest evidence."""
    own = [odds[f] for f in found if f in odds]
    return (min(sum(own), 30.0), max(own)) if own else (0.0, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-3
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(h, x.T @ (p - y) + penalty * w)
    return w


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> dict:
    """Language model, evidence and calibration.  The driver gets the kept
    features (strong log odds only) and two numbers per calibration row."""
    spark = C.prepare(docs.sparkSession)
    lm = language_model(docs, text_col)
    rows = _learn_rows(docs, labels, id_col, text_col, sample).dropDuplicates(["toxic", "text"])
    rows = C.materialise(rows)
    # more than the sample only if one id has many texts: bounded again
    rows = rows.where(C.hash_share(F.col("text"), min(1.0, sample / max(1, rows.count()))))
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    model = {"lm": lm, "odds": {}, "weights": None}
    if not n1 or not n0:
        return model
    counted = _counts(rows, spark.sparkContext.broadcast(lm)).where(F.col("toxic") >= MIN_DOCS)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    kept = {r.feature: (r.toxic, r.clean) for r in counted.where(odds >= MIN_ODDS).collect()}
    kept = {f: n for f, n in kept.items() if log_odds(*n, n1, n0)}
    model["odds"] = {f: log_odds(*n, n1, n0) for f, n in kept.items()}

    shipped = spark.sparkContext.broadcast((lm, kept))

    def make():
        lm, kept = shipped.value
        reader = Reader(lm, kept)

        def work(batch):
            out = []
            for toxic, raw in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                found = [f for f in reader.features(raw.decode("utf-8", "replace")) if f in kept]
                # without this row's own share (words inside spaced-out runs have none)
                own = {f: log_odds(max(0, kept[f][0] - toxic), max(0, kept[f][1] - (1 - toxic)), n1 - toxic, n0 - (1 - toxic)) for f in found}
                out.append(evidence(set(found), own))
            return {"total": [a for a, _ in out], "top": [b for _, b in out]}

        return work

    added = [C.field("total", "double"), C.field("top", "double")]
    scored = C.map_batches(rows.select("toxic", "text"), make, added, ("text",))
    data = np.array([(r.total, r.top, r.toxic) for r in scored.collect()])
    data = data[np.lexsort(data.T)]
    model["weights"] = logistic(data[:, :2], data[:, 2])
    return model


# ------------------------------------------------------------------- scoring


def _evidence(df: DataFrame, shipped) -> DataFrame:
    """``df`` with ``total`` and ``top`` evidence in place of ``text``."""

    def make():
        odds = shipped.value["odds"]
        reader = Reader(shipped.value["lm"], odds)

        def work(batch):
            found = [evidence(reader.features(t.decode("utf-8", "replace")), odds) for t in batch.column("text").to_pylist()]
            return {"total": [a for a, _ in found], "top": [b for _, b in found]}

        return work

    return C.map_batches(df, make, [C.field("total", "double"), C.field("top", "double")], ("text",))


def score(docs: DataFrame, model: dict, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, ``score`` and ``predicted``."""
    spark = C.prepare(docs.sparkSession)
    df = docs.select(C.packed(docs, carry), C.utf8(text_col).alias("text"))
    df = _evidence(df, spark.sparkContext.broadcast(model))
    if model["weights"] is None:
        p = F.lit(0.0)
    else:
        a, b, bias = (float(w) for w in model["weights"])
        p = 1 / (1 + F.exp(-(F.col("total") * a + F.col("top") * b + bias)))
    return df.select("row", p.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored toxic go, the rest stay unchanged."""
    model = train(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).where("predicted = 0").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = score(docs, train(docs, C.table(spark, sf_dir, "labels")), carry=["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")
