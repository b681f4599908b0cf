import random
import zlib

import numpy as np

from quirekit.llm import op9_language

WORDS = {"en": "the and with this that house water under people which".split(), "de": "der und mit dieses dass haus wasser unter leute welche".split(), "fr": "le et avec cette que maison eau sous gens quelle".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_held_out_accuracy_and_rules(make, saved, spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang := rng.choice(list(WORDS)), rng.randrange(3, 80)), lang) for i in range(600)]
    truth = {r[0]: r[2] for r in rows}
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!! 45", "de"), (1003, text(rng, "fr", 60), None), (3, rows[3][1], rows[3][2]), (None, "the house", "en"), (1004, "x" * 200_000, "en")]
    got = op9_language.op9_language(spark, saved(documents=make(rows + odd))).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "fr"
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_mixtures(make):
    rng = random.Random(8)
    train = make([(i, text(rng, lang, 60), lang) for i in range(200) for lang in [rng.choice(list(WORDS))]])
    names, logp = op9_language.trained(train)
    mixed = make([(1, text(rng, "en", 70) + " " + text(rng, "de", 30)), (2, text(rng, "fr", 100))])
    got = {r["doc_id"]: r for r in op9_language.identified(mixed, names, logp, ["doc_id"]).collect()}
    shares = dict(p.split(":") for p in got[1]["languages"].split(","))
    assert got[1]["lang_pred"] == "en" and abs(float(shares["en"]) - 0.7) < 0.08 and abs(float(shares["de"]) - 0.3) < 0.08
    assert got[2]["languages"].split(",")[0].startswith("fr:") and got[2]["score"] > 0.95


def test_mixtures_of_many_languages(make):
    rng = random.Random(12)
    own = {f"l{i}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for i in range(7)}
    line = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    names, logp = op9_language.trained(make([(i, line(lang := f"l{i % 7}", 60), lang) for i in range(140)]))
    mixed = [(k, " ".join(line(f"l{j}", 60) for j in range(k))) for k in range(1, 8)]
    got = {r["doc_id"]: r for r in op9_language.identified(make(mixed), names, logp, ["doc_id"]).collect()}
    for k in range(1, 8):
        shares = dict(p.split(":") for p in got[k]["languages"].split(","))
        assert set(shares) == {f"l{j}" for j in range(k)}, k
        assert all(abs(float(v) - 1 / k) < 0.02 for v in shares.values())


def plain_em(text, names, logp):
    """Shares of the selected set by expectation-maximisation, word by word."""
    fold = [chr(b).lower() if chr(b).isalpha() or chr(b) == "'" else " " for b in range(128)]
    raw = [ord(fold[b]) if b < 128 else b for b in text.encode()]
    padded = [32, *raw, 32]
    bins = [(((padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761) % 2**32) >> 17 for i in range(len(raw))]
    words, at = [], 0
    while at < len(raw):
        end = at
        while end < len(raw) and raw[end] != 32:
            end += 1
        if end > at:
            own = sum(logp[bins[i]].astype(float) for i in range(at, end))
            words.append(np.exp(np.maximum(own - own.max(), -60)))
        at = end + 1
    like, langs = np.array(words), len(names)

    def fit(pi, rounds):
        for _ in range(rounds):
            post = like * pi
            pi = (post / post.sum(1, keepdims=True)).mean(0)
        return pi, np.log((like * pi).sum(1)).sum()

    full, _ = fit(np.full(langs, 1 / langs), op9_language.ITERATIONS)
    order, best = np.argsort(-full, kind="stable"), None
    for k in range(1, langs + 1):
        pi = np.zeros(langs)
        pi[order[:k]] = np.maximum(full[order[:k]], 1e-6)
        pi, fitness = fit(pi / pi.sum(), 0 if k == 1 else 2)
        fitness -= op9_language.PENALTY / 2 * (k - 1) * np.log(len(words) + 1)
        if best is None or fitness > best[0]:
            best = fitness, pi, k
    return {names[j]: best[1][j] for j in order[: best[2]]}


def test_against_plain_em(make):
    rng = random.Random(14)
    train = make([(i, text(rng, lang, 60), lang) for i in range(200) for lang in [rng.choice(list(WORDS))]])
    names, logp = op9_language.trained(train)
    texts = [" ".join(text(rng, rng.choice(list(WORDS)), rng.randrange(1, 30)) for _ in range(rng.randrange(1, 4))) + rng.choice(["", " it's", " Éa", "!  9 x"]) for _ in range(80)]
    for r in op9_language.identified(make(list(enumerate(texts))), names, logp, ["doc_id"]).collect():
        want = plain_em(texts[r["doc_id"]], names, logp)
        got = {k: float(v) for k, v in (p.split(":") for p in r["languages"].split(","))}
        assert got.keys() == want.keys(), (texts[r["doc_id"]], got, want)
        assert all(abs(got[k] - want[k]) < 2e-3 for k in want) and abs(r["score"] - max(want.values())) < 2e-3


def test_nothing_to_learn(make, saved, spark):
    got = op9_language.op9_language(spark, saved(documents=make([(1, "some words", None)]))).collect()
    assert [r["lang_pred"] for r in got] == ["und"]
    assert op9_language.op9_language(spark, saved(documents=make([]))).count() == 0


def test_many_labels_fit_the_model(make):
    rng = random.Random(12)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(12)] for _ in range(900)]
    own = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    names, logp = op9_language.trained(make([(k, own(k, 60), f"l{k:03}") for k in range(900)]))
    assert len(names) == 900 and logp.shape == (op9_language.bins_of(900), 900) and logp.size <= op9_language.MODEL
    got = op9_language.identified(make([(k, own(k, 40)) for k in range(0, 900, 30)]), names, logp, ["doc_id"]).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id']:03}" for r in got) >= 0.95 * len(got)


def test_bins_of():
    assert op9_language.bins_of(4) == op9_language.bins_of(128) == op9_language.BINS
    assert all(op9_language.bins_of(n) * n <= op9_language.MODEL and op9_language.bins_of(n) >= 1 for n in (129, 3000, 70_000, 1 << 22))
