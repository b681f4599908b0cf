import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirekit.llm import op6_katz
from quirekit.llm.common import crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


def discounts(counts):
    n = Counter(counts.values())
    ratio = 6 * n[6] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, 6):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - ratio) / (1 - ratio) if n[r] and ratio < 1 else 0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Model:
    def __init__(self, texts):
        self.uni, self.bi, self.ctx = Counter(), Counter(), Counter()
        for t in texts:
            h = "<s>"
            for w in tokens(t):
                self.uni[w] += 1
                self.bi[h, w] += 1
                self.ctx[h] += 1
                h = w
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.du, self.db = discounts(self.uni), discounts(self.bi)
        self.follow = defaultdict(list)
        for (h, w), c in self.bi.items():
            self.follow[h].append((w, c))
        self.unknown = sum((1 - self.du[c]) * c for c in self.uni.values() if c <= 5) / self.n
        self.weight = {h: self.backoff(h) for h in self.follow}

    def p(self, w):
        c = self.uni[w]
        return self.du.get(c, 1) * c / self.n if c else self.unknown

    def backoff(self, h):
        mass, total = sum(self.db.get(c, 1) * c for _, c in self.follow[h]), self.ctx[h]
        total += mass >= total
        return total, (1 - mass / total) / (1 - sum(self.p(w) for w, _ in self.follow[h]))

    def conditional(self, h, w):
        c = self.bi.get((h, w), 0)
        if c:
            return self.db.get(c, 1) * c / self.weight[h][0]
        return (self.weight[h][1] if h in self.weight else 1.0) * self.p(w)

    def score(self, text):
        out, h = 0.0, "<s>"
        for w in tokens(text):
            out += math.log10(self.conditional(h, w))
            h = w
        return out


def corpus():
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(6000)]
    texts = [" ".join(words[a : a + rng.randrange(0, 60)]) for a in rng.choices(range(5900), k=300)]
    return [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "THE The é W1\tw1　x"), (903, "solo " * 3000), (5, texts[5]), (5, texts[5]), (None, "w1 w2")]


@pytest.mark.parametrize("head, hot", [(op6_katz.HEAD, op6_katz.HOT), (8, op6_katz.HOT), (8, 40), (0, 40)])
def test_against_plain_katz(make, head, hot):
    rows = corpus()
    train = [t for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 5 != 1]
    model = Model(train)
    got = op6_katz.scored(make(rows), crc_mod("doc_id", 5) != 1, head=head, hot=hot).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(t)), sum(model.uni[w] > 0 for w in tokens(t)), model.n)
        assert r["score"] == pytest.approx(model.score(t), abs=1e-6)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.uni[w] + 0.5) / (model.n + 0.5 * (model.v + 1))) for w in tokens(t)), abs=1e-6)


def test_plain_model_is_normalised():
    model = Model([t for _, t in corpus()])
    words = [*model.uni, "never seen"]
    for h in ["<s>", "w1", "w2", "solo", *list(model.follow)[:5]]:
        assert sum(model.conditional(h, w) for w in words) == pytest.approx(1)


@pytest.mark.parametrize("hot", [op6_katz.HOT, 20])
def test_contexts_without_rare_followers(make, hot):
    # "a" is always followed by one of two frequent words, split or not.
    rows = [(i, "a b a c " * 10 + f"z{i}") for i in range(60)] + [(99, "a z1 a new")]
    train = [t for k, t in rows if k < 60]
    model = Model(train)
    assert model.weight["a"][0] == model.ctx["a"] + 1
    got = op6_katz.scored(make(rows), F.col("doc_id") < 60, hot=hot).collect()
    for r in got:
        assert r["score"] == pytest.approx(model.score(dict(rows)[r["doc_id"]]), abs=1e-6)


def test_nothing_to_learn(make):
    rows = make([(1, "a b"), (2, None)])
    got = {r["doc_id"]: r for r in op6_katz.scored(rows, F.lit(False)).collect()}
    assert (got[1]["score"], got[1]["n_known"], got[1]["train_tokens"], got[2]["n_tokens"]) == (0, 0, 0, 1)
    assert op6_katz.scored(make([]), F.lit(True)).count() == 0
