import itertools
import random
import zlib

import numpy as np
import pytest
from helpers import docs, empty, hard, labels, save

from churnframe.llm import common as C
from churnframe.llm import toxicity as X

SF1 = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return X.train(C.table(spark, SF1, "documents"), C.table(spark, SF1, "labels"))


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    rank = (ends - (counts - 1) / 2)[inverse]
    n1 = y.sum()
    del order
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    got = X.query(spark, SF1).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    truth = C.table(spark, SF1, "labels").toPandas()
    both = got[got.held_out].merge(truth, on="doc_id")
    assert auc(both.score.to_numpy(), both.toxic.to_numpy()) >= 0.93
    flagged = both[both.predicted == 1]
    assert flagged.toxic.mean() >= 0.9
    assert flagged.toxic.sum() / both.toxic.sum() >= 0.75


@pytest.mark.parametrize(
    "written, plain",
    [("1d10t", "idiot"), ("5tup1d", "stupid"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("cl0wn", "clown"), ("l0$er", "loser")],
)
def test_viterbi_restores_look_alikes(model, written, plain):
    assert X.decode(written, model["lm"]) == plain
    assert plain in X.readings(written + "!", model["lm"])


def test_viterbi_restores_stretching_and_spacing(model):
    assert X.decode("idiooooot", model["lm"]) in ("idiot", "idioot")
    assert "stupid" in X.spaced_words("you s t u p i d thing", model["lm"])[0]
    assert X.spaced_words("m-o-r-o-n", model["lm"]) == ["moron"]


def test_long_and_marked_tokens_are_read(model):
    read = lambda token: X.readings(token, model["lm"])
    assert {"idiot", "moron", "clown", "loser", "stupid"} <= set(read("id1ot_m0r0n_cl0wn_l0ser_stup1d_m0r0n_1d10t"))
    assert read("st" + "0" * 60 + "pid")[1:] == read("st000pid")[1:] != []
    assert "stupid" in read("st.upid,") and "idiot" in read("(id-iot)") and "stupid" in read("s-t/u.p:id")
    assert {"you", "idiot"} <= set(read("you-idiot!"))
    assert read("plain") == ["plain"] and read("2024-01-01") == ["2024-01-01"]
    assert "m0r0n" not in X.decode("m0r0n." * 20_000, model["lm"])


def test_words_inside_spaced_runs_are_found(model):
    reader = X.Reader(model["lm"], model["odds"])
    assert "stupid" in reader.spaced("y o u a r e s t u p i d")
    assert "idiot" in reader.spaced("so s o m e i d i o t here")
    assert "moron" in reader.spaced("t h e m o r o n w a l k s")
    assert "stupid" in X.spaced_words("$ t u p ! d", model["lm"])
    assert "stupid" in X.spaced_words("s t u u u p i d !", model["lm"])
    assert "stupid" in X.spaced_words("y o u  a r e  s t u p i d", model["lm"])
    assert X.spaced_words("1 + 2 - 3 * 4", model["lm"]) == []


def test_obfuscated_texts_score_like_plain_ones(spark, model):
    base = "the and attion to thanedble the anea eriner thanea then edinth is thndor "
    texts = [base, base + "you idiot moron clown", base + "you 1d10t m0r0n cl0wn", base + "i d i o t and m.o.r.o.n and c l o w n"]
    p = [r.score for r in X.score(docs(spark, texts), model, carry=["doc_id"]).orderBy("row.doc_id").collect()]
    assert p[0] < 0.3 and min(p[1:]) >= 0.7


@pytest.mark.parametrize("gap", [" ", "   ", "\t", "\n", ", ", " / ", "\xa0", "...", "_", " * ", "\u2009", " \U0001f600 "])
def test_any_marks_may_set_characters_apart(model, gap):
    assert "clown" in X.spaced_words("you " + gap.join("clown") + " there", model["lm"])


def test_cut_and_doubled_words_are_read(model):
    reader = X.Reader(model["lm"], model["odds"])
    for text in ("a cl ow n", "cl own.", "(c lo wn)", "clo, wn"):
        assert {"clown", "clo-"} <= reader.features("the " + text + " here"), text
    for text in ("the clock owns", "clo the wn", "clothing wn", "cl 5 own"):
        assert "clown" not in reader.features(text), text
    assert "clown" in X.readings("cclloowwnn", model["lm"]) and "idiot" in X.readings("iidiioott!", model["lm"])
    for plain in ("committee", "bookkeeper", "mississippi", "address"):
        assert plain in X.readings(plain, model["lm"])


def test_viterbi_is_the_least_of_all_paths(model):
    """Full enumeration of short lattices."""
    rng = np.random.default_rng(5)
    lm = model["lm"]

    def cost(path):
        a = b = 0
        total = sum(extra for _, extra in path)
        for c in "".join(piece for piece, _ in path) + " ":
            k = X._letter(c)
            total -= float(lm[a * 28 + b, k])
            a, b = b, k
        return total

    for _ in range(60):
        steps = []
        for _ in range(rng.integers(1, 7)):
            pieces = rng.choice(["a", "e", "n", "th", "", " ", "s ", "é", "q"], rng.integers(1, 4), replace=False)
            steps.append([(str(p), float(rng.choice([0.0, 0.5, 1.0]))) for p in pieces])
        paths = list(itertools.product(*steps))
        least = min(map(cost, paths))
        best = X._best(steps, lm)
        assert any(abs(cost(p) - least) < 1e-9 and "".join(x for x, _ in p) == best for p in paths)


def test_query_is_the_plain_reading(spark, scratch):
    """Counts, odds, evidence and scores of a small table by plain loops, every
    text read by a reader of its own."""
    rng = random.Random(3)
    bad, fine = ["clown", "1d10t", "m o r o n", "sc um"], ["the", "and", "house", "tree", "w4ter", "river"]
    texts, marks = [], []
    for i in range(240):
        toxic = i % 3 == 0
        words = rng.choices(fine, k=rng.randint(3, 20)) + (rng.choices(bad, k=2) if toxic else [])
        rng.shuffle(words)
        texts.append(" ".join([*words, f"n{i}"]))
        marks.append((i, 1, int(toxic)))
    save(docs(spark, texts, range(240)), scratch, "documents")
    save(labels(spark, marks), scratch, "labels")
    got = {r.doc_id: r for r in X.query(spark, scratch).collect()}
    held = {i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1}
    model = X.train(C.table(spark, scratch, "documents"), C.table(spark, scratch, "labels"))
    seen = {}
    rows = [(t, y) for i, (t, (_, _, y)) in enumerate(zip(texts, marks)) if i not in held]
    n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    for t, y in rows:
        for f in X.Reader(model["lm"]).features(t):
            seen.setdefault(f, [0, 0])[1 - y] += 1
    odds = {f: X.log_odds(*n, n1, n0) for f, n in seen.items()}
    odds = {f: o for f, o in odds.items() if o}
    assert model["odds"] == odds and {"clown", "moron"} <= set(odds)
    for i, t in enumerate(texts):
        total, top = X.evidence(X.Reader(model["lm"], odds).features(t), odds)
        p = 1 / (1 + np.exp(-(np.array([total, top, 1.0]) @ model["weights"])))
        assert got[i].score == pytest.approx(float(p)) and got[i].held_out == (i in held)
        assert got[i].predicted == int(got[i].score >= 0.7)


def test_language_model_counts_every_text():
    texts = [b"ab", b"", "é".encode()]
    plain = {}
    whole = [0, 0, 1, 2, 0, 0, 0, 0, 27, 27, 0, 0]  # a text begins and ends at two boundaries
    for a, b, c in zip(whole, whole[1:], whole[2:]):
        plain[a * 784 + b * 28 + c] = plain.get(a * 784 + b * 28 + c, 0) + 1
    counts = X.count_trigrams(texts)
    assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == plain


def test_held_out_labels_are_not_learned_from(spark):
    words = {i: "zzbad zzword" if i % 2 else "fine text here" for i in range(200)}
    df = docs(spark, list(words.values()), list(words))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    right = labels(spark, [(i, 1, i % 2) for i in words])
    wrong = labels(spark, [(i, 1, 1 - i % 2 if held(i) else i % 2) for i in words])
    a, b = X.train(df, right), X.train(df, wrong)
    assert a["odds"] == b["odds"] and np.array_equal(a["weights"], b["weights"])


def test_edge_cases(spark, model):
    df = hard(spark)
    got = X.score(df, model)
    assert got.count() == 10 and got.select("row.*").columns == df.columns
    scores = {r.row.doc_id: r.score for r in got.collect()}
    assert scores[1] == scores[2] == scores[3]
    assert X.score(empty(spark), model).count() == 0
    nothing = X.train(df, labels(spark, [(1, None, None), (None, 1, 1)]))
    assert {r.score for r in X.score(df, nothing).collect()} == {0.0}
    one_class = X.train(df, labels(spark, [(i, 1, 0) for i in range(9)]))
    assert {r.predicted for r in X.score(df, one_class).collect()} == {0}
