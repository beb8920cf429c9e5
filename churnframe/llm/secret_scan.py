"""Secret scan: a character convolutional network scores every candidate and
its surrounding context.

Rules (leftmost, non-overlapping, per kind): ``assign`` (a key word, a sign,
a value of 6+ characters), ``access`` (AKIA..., 20+ characters), ``hex`` (24+
characters).  A candidate is every maximal run of ``CANDIDATE`` characters, or
what rule findings leave of it in one piece, of ``SHORTEST`` characters or more.
The network sees views of at most ``BODY`` characters, a new one every
``STRIDE``, with 24 characters before and 8 after; a finding's score is that of
its best view.  What the network accepts becomes a finding of kind ``cnn``.
Rule findings always stay.

Training: labelled findings come from at most about ``SAMPLE_DOCS`` documents
(a hash sample of the rows): rule findings are positive, candidates outside
them negative.  As the rules know three kinds only, both classes are widened
by generated findings (``MADE`` of each, other token formats against words,
numbers, paths and identifiers, and tokens inside longer runs).  The network is
plain numpy with Adam; its logit is calibrated by Platt scaling on a held-out
third.  Thresholds are by kind of finding - upper-case hex or not, which of
lower-case letters, upper case, digits and signs it has, and its length in
steps of four - each the highest one that keeps ``MIN_RECALL`` of ``CALIBRATION`` freshly
generated positives of its kind; a kind that the generator never makes has the
threshold of all held-out positives that no rule covers.

On the given documents nearly all secrets are of the rules' formats, so the
network adds little there: it is for the formats that no rule names.

Defined results: NULL text is empty; texts are scanned whole; an empty table
trains on generated findings alone; equal rows give equal findings; offsets
are code points, end exclusive.  Other columns ride along in ``row``.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C

KINDS = ("assign", "access", "hex", "cnn")
SAMPLE_DOCS = 20_000
SAMPLE_FINDINGS = 4_000  # of each class
MADE = 2_000
CALIBRATION = 24_000  # generated positives that set the thresholds
LEAST_OF_KIND = 100  # of them, for a kind to have a threshold of its own
MIN_RECALL = 0.995
MIN_PROBABILITY = 0.5
VIEWS = 4_096  # scored at once
SEED = 7

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

BODY, STRIDE, BEFORE, AFTER = 48, 24, 24, 8
WIDTH = BEFORE + BODY + AFTER
SYMBOLS = 98  # printable ASCII, space-like, other, padding
EMBED, FILTERS, KERNEL = 8, 24, 5


def rule_findings(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the rules, by start and then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def candidates(text: str, found: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """What the rule findings leave of each run, if it is a candidate itself."""
    starts = [a for a, _, _ in found]
    reach = list(accumulate((b for _, _, b in found), max))  # furthest end so far
    out = []
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        k = bisect_right(starts, at)
        if k:
            at = max(at, reach[k - 1])
        while k < len(starts) and starts[k] < end:
            out.append((at, starts[k]))
            at = max(at, reach[k])
            k += 1
        out.append((at, end))
    return [(a, b) for a, b in out if b - a >= SHORTEST]


def window(text: str, start: int, end: int) -> str:
    """The fixed-width view the network reads, of at most ``BODY`` characters
    and their context; NUL pads."""
    body = text[start : min(end, start + BODY)]
    end = start + len(body)
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    return before + body.ljust(BODY, "\0") + after


def slices(start: int, end: int) -> list[int]:
    """Where the overlapping views of a finding begin."""
    return [*range(start, max(start + 1, end - BODY), STRIDE), *([end - BODY] if end - start > BODY else [])]


def windows(text: str, start: int, end: int) -> list[str]:
    return [window(text, a, end) for a in slices(start, end)]


def codes(windows: list[str]) -> np.ndarray:
    x = np.frombuffer("".join(windows).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64).reshape(-1, WIDTH)
    return np.where(
        x == 0, 97, np.where((x > 32) & (x < 127), x - 32, np.where((x == 32) | ((x > 8) & (x < 14)), 0, 96))
    )


class CharNet:
    """Embedding, one convolution, ReLU, max and mean pooling, one output."""

    def __init__(self, rng: np.random.Generator):
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "emb": 0.5 * rng.standard_normal((SYMBOLS, EMBED)).astype(np.float32),
            "conv": scale(KERNEL * EMBED, FILTERS),
            "bias": np.zeros(FILTERS, np.float32),
            "out": scale(2 * FILTERS, 1),
            "out_bias": np.zeros(1, np.float32),
        }

    def _forward(self, x: np.ndarray):
        e = self.p["emb"][x]
        steps = WIDTH - KERNEL + 1
        cols = np.concatenate([e[:, k : k + steps] for k in range(KERNEL)], axis=2)
        a = np.maximum(cols @ self.p["conv"] + self.p["bias"], 0)
        pooled = np.concatenate([a.max(1), a.mean(1)], axis=1)
        return cols, a, pooled, (pooled @ self.p["out"] + self.p["out_bias"])[:, 0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 1024])[3] for i in range(0, len(x), 1024)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, a, pooled, z = self._forward(x)
        steps = a.shape[1]
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)[:, None]
        dpool = dz @ self.p["out"].T
        da = np.repeat(dpool[:, None, FILTERS:] / steps, steps, axis=1)
        rows, chans = np.ogrid[: len(x), :FILTERS]
        da[rows, a.argmax(1), chans] += dpool[:, :FILTERS]
        da *= a > 0
        flat = da.reshape(-1, FILTERS)
        dcols = (flat @ self.p["conv"].T).reshape(cols.shape)
        demb = np.zeros_like(self.p["emb"])
        for k in range(KERNEL):
            np.add.at(demb, x[:, k : k + steps], dcols[:, :, k * EMBED : (k + 1) * EMBED])
        return {
            "emb": demb,
            "conv": cols.reshape(-1, KERNEL * EMBED).T @ flat,
            "bias": flat.sum(0),
            "out": pooled.T @ dz,
            "out_bias": dz.sum(0),
        }

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 6, rate: float = 0.01):
        moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 128):
                t += 1
                at = order[i : i + 128]
                for k, g in self.gradients(x[at], y[at]).items():
                    moment[k] = 0.9 * moment[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    step = moment[k] / (1 - 0.9**t) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] -= (rate * step).astype(np.float32)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for probability = 1 / (1 + exp(-(a z + b)))."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -5, 5))
    return a, b


def kind_of(body: str) -> str:
    """What a finding consists of, and how long it is."""
    size = f"-{min(len(body), 64) // 4 * 4}"
    if not body.strip("0123456789ABCDEF"):
        return "hex" + size
    has = [any(test(c) for c in body) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())]
    return "".join(n for n, h in zip("lud+", has) if h) + size


UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits


def _pick(alphabet: str, n: int, rng: np.random.Generator) -> str:
    return "".join(rng.choice(list(alphabet), n))


def token(i: int, n: int, rng: np.random.Generator) -> str:
    """A generated secret of ``n`` random characters; seven formats."""
    make = (
        lambda: _pick(UPPER + LOWER + DIGITS, n, rng),
        lambda: _pick(UPPER + LOWER + DIGITS + "+/", n, rng) + "=" * int(rng.integers(0, 3)),
        lambda: _pick("0123456789ABCDEF", n, rng),
        lambda: _pick(LOWER + DIGITS, n, rng),
        lambda: "sk-" + _pick(UPPER + LOWER + DIGITS, n, rng),
        lambda: "ghp_" + _pick(UPPER + LOWER + DIGITS, n, rng),
        lambda: _pick(UPPER + DIGITS, n, rng),
    )
    return make[i % len(make)]()


LEADS = ["key ", "key: ", "auth ", "bearer ", "pwd ", "credential = ", "sig=", "access ", "client id ", '"', "= ", " "]


def _some(words: list[str], n: int, rng: np.random.Generator) -> list[str]:
    return list(rng.choice(words, n))


def _vocabulary(texts: list[str]) -> list[str]:
    return sorted({w for t in texts[:300] for w in re.findall(r"[A-Za-z]{2,12}", t)})[:5000] or ["the", "of", "data"]


def _inside(secret: str, words: list[str], rng: np.random.Generator) -> tuple[str, int, int]:
    """A text with the secret in a longer run; where the run and it begin."""
    before = " ".join(_some(words, 4, rng))
    head, tail = "/".join(_some(words, 6, rng)) + "/", "/" + "-".join(_some(words, 6, rng))
    return f"{before} {head}{secret}{tail}", len(before) + 1, len(before) + 1 + len(head)


def _generated(words: list[str], rng: np.random.Generator) -> tuple[list[list[str]], list[list[str]]]:
    """Findings of other formats, and harmless long runs, in sampled context; a
    finding is the list of its views."""
    positive, negative = [], []
    for i in range(MADE):
        n = int(rng.integers(20, 64))
        secret, parts = token(i, n, rng), _some(words, 6, rng)
        plain = (
            "".join(parts),
            "_".join(parts),
            "-".join(parts).lower(),
            "/".join(parts),
            "".join(p.capitalize() for p in parts),
            _pick(DIGITS, n, rng),
            rng.choice(["-", "=", "_", "+"]) * n,
            "/".join([*parts[:3], _pick(DIGITS, 4, rng)]),
            "+".join(parts),
            "-".join([_pick(DIGITS, 4, rng), _pick(DIGITS, 2, rng), _pick(DIGITS, 2, rng), *parts[:3]]),
        )[i % 10].ljust(16, "a")
        before = " ".join(_some(words, 4, rng))
        for body, lead, into in ((secret, str(rng.choice(LEADS)), positive), (plain, " ", negative)):
            text = f"{before}{lead}{body} {' '.join(_some(words, 2, rng))}"
            at = len(before) + len(lead)
            into.append(windows(text, at, at + len(body)))
        if i % 4 == 0:
            # the token inside a longer run: views that hold much of it, and none
            run, start, a = _inside(secret, words, rng)
            b, inside, outside = a + len(secret), [], []
            for v in slices(start, len(run)):
                shared = min(b, v + BODY) - max(a, v)
                if shared >= min(20, len(secret)):
                    inside.append(window(run, v, len(run)))
                elif shared <= -BEFORE:
                    outside.append(window(run, v, len(run)))
            positive.append(inside)
            negative += [[v] for v in outside]
    return positive, negative


def _calibration(words: list[str], rng: np.random.Generator) -> list[tuple[str, list[str]]]:
    """(kind, views) of positives as the scan would meet them, half of them at
    the shortest length of their kind and an eighth inside longer runs."""
    out = []
    for i in range(CALIBRATION):
        secret = token(i, 20 + 4 * (i // 7 % 11) if i % 2 else int(rng.integers(20, 64)), rng)
        if i % 8 == 0:
            text, start, _ = _inside(secret, words, rng)
            end = len(text)
        else:
            before, lead = " ".join(_some(words, 4, rng)), str(rng.choice(LEADS))
            text, start = f"{before}{lead}{secret} {' '.join(_some(words, 2, rng))}", len(before) + len(lead)
            end = start + len(secret)
        found = rule_findings(text)
        if not any(a < end and start < b for a, _, b in found):  # what no rule covers
            out.append((kind_of(text[start:end]), windows(text, start, end)))
    return out


def _best_views(net: CharNet, groups: list[list[str]]) -> np.ndarray:
    """The logit of each finding's best view."""
    if not groups:
        return np.zeros(0, np.float32)
    sizes = np.array([len(g) for g in groups])
    return np.maximum.reduceat(net.logits(codes([v for g in groups for v in g])), np.cumsum(sizes) - sizes)


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> dict:
    """The fitted network with its calibration and threshold."""
    C.prepare(docs.sparkSession)
    n = max(1, docs.count())
    share = min(1.0, sample_docs / n)
    text = F.coalesce(F.col(C.quoted(text_col)), F.lit(""))
    sample = docs.select(text.alias("t")).where(C.hash_share(F.col("t"), share)).select(F.col("t").cast("binary").alias("text"))
    schema = T.StructType([C.field("label", "int"), C.field("view", "string")])

    def make():
        def run(batches):
            for batch in batches:
                made = {"label": [], "view": []}
                for raw in batch.column("text").to_pylist():
                    whole = raw.decode("utf-8", "replace")
                    found = rule_findings(whole)
                    spans = [(a, b, 1) for a, _, b in found] + [(a, b, 0) for a, b in candidates(whole, found)]
                    for a, b, y in spans:
                        views = windows(whole, a, b)
                        made["label"] += [y] * len(views)
                        made["view"] += views
                yield made

        return run

    views = C.materialise(C.emit_rows(sample, make, schema).distinct())
    # 4,000 views of each class at most, by hash: a bounded training set
    rows = []
    for label in (0, 1):
        own = views.where(F.col("label") == label)
        rows += own.orderBy(F.xxhash64("view"), "view").limit(SAMPLE_FINDINGS).collect()
    rows.sort(key=lambda r: (r.label, r.view))
    rng = np.random.default_rng(SEED)
    positive = [r.view for r in rows if r.label]
    negative = [r.view for r in rows if not r.label]
    words = _vocabulary([v.replace("\0", "") for v in negative + positive])
    more, less = _generated(words, rng)
    groups = [[v] for v in positive] + more + [[v] for v in negative] + less
    y = np.array([1.0] * len(positive + more) + [0.0] * len(negative + less), np.float32)
    # the threshold governs only what no rule covers
    free = np.array([k >= len(positive) and not any(rule_findings(v) for v in g) for k, g in enumerate(groups)])
    order = rng.permutation(len(groups))
    cut = len(groups) // 3
    held, rest = order[:cut], order[cut:]
    net = CharNet(rng)
    net.fit(codes([v for i in rest for v in groups[i]]), np.repeat(y[rest], [len(groups[i]) for i in rest]), rng)
    z = _best_views(net, [groups[i] for i in held])
    y, free = y[held], free[held]
    a, b = platt(z, y)
    probability = lambda z: 1 / (1 + np.exp(-(a * z.astype(np.float64) + b)))

    def keeping(p: np.ndarray) -> float:
        return float(np.sort(p)[int((1 - MIN_RECALL) * len(p))])

    p = probability(z)
    threshold = keeping(p[(y > 0) & free]) if ((y > 0) & free).any() else MIN_PROBABILITY
    fresh = _calibration(words, rng)
    q = probability(_best_views(net, [g for _, g in fresh]))
    kinds = np.array([k for k, _ in fresh])
    thresholds = {str(k): keeping(q[kinds == k]) for k in np.unique(kinds) if (kinds == k).sum() >= LEAST_OF_KIND}
    taken = p >= threshold
    return {
        "params": net.p,
        "a": a,
        "b": b,
        "threshold": threshold,
        "thresholds": thresholds,
        "recalls": {k: float((q[kinds == k] >= t).mean()) for k, t in thresholds.items()},
        "recall": float(taken[(y > 0) & free].mean()) if ((y > 0) & free).any() else 1.0,
        "precision": float(y[taken].mean()) if taken.any() else 1.0,
    }


def scan(docs: DataFrame, model: dict, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, ``text`` and ``findings``: structs (kind, start, end, score) by
    start and kind; the score is the network's calibrated probability."""
    spark = C.prepare(docs.sparkSession)
    finding = T.StructType([C.field("kind", "string"), C.field("start", "int"), C.field("end", "int"), C.field("score", "double")])
    shipped = spark.sparkContext.broadcast(model)

    def make():
        model = shipped.value
        net = CharNet(np.random.default_rng(0))
        net.p = model["params"]
        least = lambda body: model["thresholds"].get(kind_of(body), model["threshold"])

        def work(batch):
            out, found_at, views, owner, best = [], [], [], [], []

            def flush():
                if views:
                    p = 1 / (1 + np.exp(-(model["a"] * net.logits(codes(views)).astype(np.float64) + model["b"])))
                    for k, score in zip(owner, p):
                        best[k] = max(best[k], float(score))
                    views.clear()
                    owner.clear()

            for raw in batch.column("text").to_pylist():
                text = raw.decode("utf-8", "replace")
                found = rule_findings(text)
                spans = [(a, KINDS.index(k), b) for a, k, b in found]
                spans += [(a, KINDS.index("cnn"), b) for a, b in candidates(text, found)]
                for span in spans:
                    found_at.append((len(out), *span, 0.0 if KINDS[span[1]] != "cnn" else least(text[span[0] : span[2]])))
                    best.append(0.0)
                    for a in slices(span[0], span[2]):
                        views.append(window(text, a, span[2]))
                        owner.append(len(best) - 1)
                        if len(views) >= VIEWS:
                            flush()
                out.append([])
            flush()
            for (row, a, k, b, low), score in zip(found_at, best):
                if score >= low:
                    out[row].append((a, k, b, score))
            return {"findings": [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(x)] for x in out]}

        return work

    df = docs.select(C.packed(docs, carry), C.utf8(text_col).alias("text"))
    return C.map_batches(df, make, [C.field("findings", T.ArrayType(finding))]).select("row", "text", "findings")


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each (merged) span replaced by the mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every finding is replaced by ``[SECRET]`` and
    ``n_chars`` counts the new text; every document stays."""
    found = scan(docs, train(docs))

    def make():
        def work(batch):
            texts = (t.decode("utf-8", "replace") for t in batch.column("text").to_pylist())
            spans = batch.column("findings").to_pylist()
            return {"clean": [redacted(t, [(s["start"], s["end"]) for s in x]) if x else None for t, x in zip(texts, spans)]}

        return work

    done = C.map_batches(found, make, [C.field("clean", "string")], ("text", "findings"))
    changed = {
        "text": F.coalesce("clean", "row.text"),
        "n_chars": F.when(F.col("clean").isNotNull(), F.char_length("clean")).otherwise(F.col("row.n_chars")),
    }
    kinds = dict(docs.dtypes)
    return done.select(*[changed[c].cast(kinds[c]).alias(c) if c in changed else F.col(f"row.{C.quoted(c)}") for c in docs.columns])


def joined(findings: Column) -> Column:
    one = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    return F.concat_ws(",", F.transform(findings, one))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = scan(docs, train(docs), carry=["doc_id"])
    rules = F.filter("findings", lambda f: f["kind"] != "cnn")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "row.doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(rules), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        count("cnn").alias("n_cnn"),
    )
