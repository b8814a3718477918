import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidelog.llm import language_model, quality, toxicity
from tidelog.llm import queries as llm

SF = "/root/testdata/sf0.01"


def measured(spark, query, column, cut):
    out = query(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert out.score.between(0, 1).all() and ((out.score >= cut) == out.predicted).all()
    held = out[out.held_out]
    pos, neg = held[held[column] == 1].predicted, held[held[column] == 0].predicted
    return pos.mean(), neg.mean()


def test_quality_on_held_out_rows(spark):
    kept, passed = measured(spark, llm.op7_quality, "quality", 0.5)
    assert kept > 0.97 and passed < 0.1


def test_toxicity_on_held_out_rows(spark):
    found, wrong = measured(spark, llm.op9_toxicity, "toxic", 0.3)
    assert found > 0.6 and wrong < 0.05


def labels(spark, items):
    return spark.createDataFrame(items, "doc_id long, quality int, toxic int")


def test_quality_edges(spark, docs):
    d = docs([None, "", "x" * 30_000, "a b c.", "A!! B!! C!!", "a b c."])
    feats = quality.features(d)
    none = quality.fit(feats, labels(spark, []))
    assert {r["score"] for r in quality.score_features(feats, none).collect()} == {0.5}
    one = quality.fit(feats, labels(spark, [(3, 1, 0), (99, 0, 0), (4, None, 0)]))
    assert {r["score"] for r in quality.score_features(feats, one).collect()} == {1.0}
    both = quality.fit(feats, labels(spark, [(3, 1, 0), (3, 1, 0), (4, 0, 0)]))
    got = quality.score(d.withColumn("x0", F.lit("mine")), both)
    assert got.columns == [*d.columns, "x0", "score"]
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by[3] > 0.5 > by[4] and by[3] == by[5] and by[0] == by[1]
    assert quality.score_features(quality.features(docs([])), both).count() == 0


def test_quadratic_discriminant_against_densities():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, np.zeros(quality.SIZE), np.ones(quality.SIZE))
    covs = [np.cov(rng.normal(size=(quality.SIZE, 60))) + np.eye(quality.SIZE) for _ in range(2)]
    model.means = [rng.normal(size=quality.SIZE) for _ in range(2)]
    model.factors = [np.linalg.inv(np.linalg.cholesky(c)) for c in covs]
    model.logdets = [np.linalg.slogdet(c)[1] for c in covs]
    x = rng.normal(size=(5, quality.SIZE))
    dens = [-0.5 * (np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) + np.linalg.slogdet(c)[1]) for m, c in zip(model.means, covs)]
    assert model.gaps(x) == pytest.approx(dens[1] - dens[0] + math.log(0.3 / 0.7))


def test_fit_against_a_plain_one(spark, docs):
    """Means, shrunken covariances and the scores of new texts, from the statistics of each row."""
    import random

    rng = random.Random(6)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(5, 40))) + "." for _ in range(60)]
    bad = ["".join(rng.choice("!?#0123 \n") for _ in range(rng.randint(10, 200))) for _ in range(50)]
    d = docs([*good, *bad])
    model = quality.fit(quality.features(d), labels(spark, [(i, int(i < 60), 0) for i in range(110)]))
    x = np.array([quality.statistics(t.encode()) for t in [*good, *bad]])
    y = np.arange(110) < 60
    centre, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))
    assert model.centre == pytest.approx(centre, abs=1e-6) and model.scale == pytest.approx(scale, abs=1e-4) and model.prior == pytest.approx(60 / 110)
    covs = [np.cov(((x - centre) / scale)[y == k].T, bias=True) for k in (False, True)]
    pooled = (50 * covs[0] + 60 * covs[1]) / 110
    for k in (0, 1):
        c = (1 - quality.TO_POOLED) * covs[k] + quality.TO_POOLED * pooled
        c = (1 - quality.TO_SPHERE) * c + quality.TO_SPHERE * np.trace(c) / quality.SIZE * np.eye(quality.SIZE) + 1e-9 * np.eye(quality.SIZE)
        precision = model.factors[k].T @ model.factors[k]
        assert precision @ c == pytest.approx(np.eye(quality.SIZE), abs=2e-2)
        assert model.logdets[k] == pytest.approx(np.linalg.slogdet(c)[1], abs=1e-2)
    wrong = lambda shift: int(((model.gaps(x) > shift) != y).sum())
    assert wrong(model.shift) <= min(wrong(s) for s in np.arange(-50, 50, 0.25)) + 1


def test_statistics_by_hand():
    s = quality.statistics(b"Aa bb. Aa\n\nbb")
    assert s[0] == pytest.approx(math.log1p(13)) and s[1] == pytest.approx(math.log1p(4)) and s[2] == pytest.approx((2 + 3 + 2 + 2) / 4)
    counts = Counter(b"Aa bb. Aa\n\nbb")
    assert s[9] == pytest.approx(-sum(c / 13 * math.log2(c / 13) for c in counts.values()))


def test_window_lengths_against_plain_compression():
    """Windows hold all words in order; what a window saves is the difference of two compressions with raw dictionaries."""
    import random

    import zstandard

    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(300)) + " " + "w" * 200
    ws = toxicity.windows(text.upper().encode())
    folded = text.upper().replace("É", "É").encode().translate(toxicity._FOLD).split()
    assert b"".join(w.replace(b" ", b"") for w in ws) == b"".join(folded) and max(map(len, ws)) <= toxicity.WINDOW + 2
    ordinary, toxic = ws[3] * 3 + ws[5], ws[10] + ws[12]
    params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, min_match=3, write_checksum=0, write_content_size=0, write_dict_id=0)
    plain = lambda content, w: len(zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(w))
    want = [plain(ordinary, w) - plain(toxic + ordinary, w) for w in ws]
    got = toxicity.Gains(ordinary, toxic).of(ws).tolist()
    assert max(abs(a - b) for a, b in zip(got, want)) <= 2 and got[10] > 10 and got[12] > 10


def test_pieces_are_measured_on_all_windows():
    """A window that shares no GRAM bytes with a piece isn't shortened by it."""
    import random

    rng = random.Random(9)
    ws = [(" " + " ".join(rng.choice(["lorem", "ipsum", "dolor", "vicious", "amet"]) for _ in range(8)) + " ").encode() for _ in range(200)]
    ordinary = b" lorem ipsum dolor amet lorem dolor ipsum "
    found = toxicity.Measure(ws, ordinary)
    for piece in (b" vicious lor", b" ipsum dolor", b"nothing here"):
        both, base = toxicity.coder(piece + ordinary), toxicity.coder(ordinary)
        want = sum(len(base.compress(w)) - len(both.compress(w)) >= toxicity.SAVED for w in ws if any(piece[i : i + toxicity.GRAM] in w for i in range(len(piece) - toxicity.GRAM + 1)))
        assert found.shortened(piece, both) == want
    assert found.shortened(b" vicious lor", toxicity.coder(b" vicious lor" + ordinary)) > 50


def test_models_with_clashing_names_and_long_texts(spark, docs):
    rng = np.random.default_rng(1)
    long = " ".join(f"w{i}" for i in rng.integers(0, 40_000, 300_000).tolist())
    d = docs([long, long, "x" * 2_000_000, "a b", None])
    more = d.withColumns({c: F.lit("mine") for c in ("part", "block", "data", "held", "label", "x0", "score", "key")})
    ls = labels(spark, [(0, 1, 1), (2, 0, 0), (3, 0, 0)])
    assert rows(lm(more), "doc_id", "n_tokens", "score") == rows(lm(d), "doc_id", "n_tokens", "score")
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        fit = (lambda x: quality.fit(quality.features(x), ls)) if module is quality else (lambda x: toxicity.fit(x, ls))
        a, b = (rows(module.score(x.select("doc_id", "text", *x.columns[5:]), fit(x)), "doc_id", "score") for x in (d, more))
        assert a == b and a[0][1] == a[1][1]


def test_toxicity_edges(spark, docs):
    toxic = [f"you are a horrid fool number{i} and a horrid fool again" for i in range(30)]
    plain = [f"the garden was quiet today and bird{i} sang in the tree" for i in range(60)]
    d = docs([*toxic, *plain, None, "", "!!!", "x" * 30_000])
    ls = labels(spark, [(i, 1, int(i < 30)) for i in range(90)] + [(900, 1, 1), (5, 1, None)])
    by = {r["doc_id"]: r["score"] for r in toxicity.score(d, toxicity.fit(d, ls)).collect()}
    assert min(by[i] for i in range(30)) > 0.5 > max(by[i] for i in range(30, 94))
    for few, want in (([], 0.5), ([(1, 1, 1)], 1.0), ([(40, 1, 0)], 0.0)):
        assert {r["score"] for r in toxicity.score(d, toxicity.fit(d, labels(spark, few))).collect()} == {want}
    assert toxicity.score(docs([]), toxicity.Model(0.1)).count() == 0


def lm(d):
    return language_model.score(d, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def test_base_score_and_counts(docs, real):
    texts = [None, "", "One two  two", "three"] + [r["text"] for r in real.select("text").limit(60).collect()]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    tokens = [[*brute.words(t), None] for t in texts]
    counts = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in lm(docs(texts)).collect():
        i = r["doc_id"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(w in counts for w in tokens[i]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]))
        assert math.isfinite(r["score"]) and r["score"] <= 0


def test_the_model_beats_the_base_on_held_out_rows(spark):
    out = llm.op8_language_model(spark, SF).where("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert out["m"] > out["b"]


def test_probabilities_sum_to_one():
    """Over the known words and the unknown one, in every class."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 5, (30, 4))
    counts[:, 0] += 1
    tables = np.where(counts > 0, rng.integers(1, np.maximum(counts, 1) + 1), 0)
    root_tables = rng.integers(1, tables.sum(1) + 1)
    t = language_model.Totals.__new__(language_model.Totals)
    t.customers, t.open = counts.sum(0).astype(float), tables.sum(0).astype(float)
    t.words, t.root_open, t.root_customers, t.discounts = 30.0, float(root_tables.sum()), float(tables.sum()), (0.6, 0.4)
    root = np.append(t.root(tables.sum(1), root_tables), t.root(np.zeros(1), np.zeros(1)))
    assert root.sum() == pytest.approx(1)
    own = (counts - 0.6 * tables) / (language_model.STRENGTH + t.customers)
    total = (t.backoff()[None, :] * root[:, None]).sum(0) + own.sum(0)
    assert total == pytest.approx(np.ones(4))


def stirling(n, discount):
    """Logarithms of generalised Stirling numbers S(n, 0...n)."""
    row = np.array([0.0])
    for c in range(n):
        with np.errstate(divide="ignore"):
            row = np.logaddexp(np.r_[-np.inf, row], np.r_[row + np.log(np.maximum(c - np.arange(c + 1) * discount, 0)), -np.inf])
    return row


@pytest.mark.parametrize("c", [2, 3, 10, 300, 5000])
def test_stirling_ratios(c):
    s = stirling(c, 0.6)
    t = np.arange(2, c + 1)
    if c > language_model.TABULATED:
        t = t[t < 3 * c**0.6]  # numbers of tables that occur
    got = language_model.stirling_ratio(np.full(len(t), c), t, 0.6)
    assert got == pytest.approx(np.exp(s[t - 1] - s[t]), rel=1e-6 if c <= language_model.TABULATED else 0.06)


@pytest.mark.parametrize("c, mass", [(2, 0.3), (5, 2.0), (40, 0.5), (1500, 1.5)])
def test_reseating_keeps_the_distribution_of_tables(c, mass, monkeypatch):
    """One word in a restaurant with 10 tables of others: chances of t tables are S(c, t) p ** t (strength + d (10 + j)) ..."""
    monkeypatch.setattr(language_model, "RESEATED", max(16, c // 5))
    d, strength, n = 0.5, 1.0, 2000
    p = mass / (strength + d * 10)
    ks = np.arange(1, c + 1)
    weight = stirling(c, d)[1:] + ks * math.log(p) + np.cumsum(np.log(strength + d * (10 + np.arange(c))))
    weight = np.exp(weight - weight.max())
    want = (ks * weight).sum() / weight.sum()
    t = language_model.expected_tables(np.full(n, c), np.full(n, mass), d)
    keys, means = np.arange(n, dtype=np.uint64), []
    for sweep in range(60):
        t = language_model.reseat(np.full(n, c), t, 10.0 + t, strength, d, np.full(n, p), np.full(n, p), keys, sweep)
        means.append(t.mean())
    assert np.mean(means[len(means) // 2 :]) == pytest.approx(want, rel=0.02)


class Restaurant:
    """A Chinese restaurant with every table, for the plain sampler."""

    def __init__(self, strength, discount, parent):
        self.strength, self.discount, self.parent, self.tables = strength, discount, parent, {}
        self.customers = self.opened = 0

    def p(self, w):
        own = self.tables.get(w, [])
        return (max(sum(own) - self.discount * len(own), 0) + (self.strength + self.discount * self.opened) * self.parent.p(w)) / (self.strength + self.customers)

    def add(self, w, rng):
        own = self.tables.setdefault(w, [])
        weights = [x - self.discount for x in own] + [(self.strength + self.discount * self.opened) * self.parent.p(w)]
        k = rng.choices(range(len(weights)), weights)[0]
        self.customers += 1
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            self.opened += 1
            self.parent.add(w, rng)

    def remove(self, w, rng):
        own = self.tables[w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        self.customers -= 1
        if not own[k]:
            own.pop(k)
            self.opened -= 1
            self.parent.remove(w, rng)


class Uniform:
    def __init__(self, words):
        self.share = 1 / (words + 1)

    def p(self, w):
        return self.share

    def add(self, w, rng):
        pass

    remove = add


def test_the_sampler_against_a_plain_one():
    """Mean scores of texts under the sweeps of one part, and under customers that are reseated one by one at real tables."""
    import random

    import pyarrow as pa

    rng = random.Random(4)
    vocabulary = [a + b for a in ("ka", "li", "mo", "nu") for b in ("s", "t", "r")]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(12)], k=12)).encode() for _ in range(40)]
    texts += [t for t in texts[:8]]
    found = [language_model.tokens(t) for t in texts]
    ((_, blob),) = language_model._entries(list(found), 1, len(found), False)
    row = language_model._count(pa.table({"part": pa.array([0]), "data": pa.array([blob], pa.binary())})).to_pylist()[0]
    many, cells, tables = (language_model._unpack(row[k], t) for k, t in (("many", language_model._MANY), ("cells", language_model._CELLS), ("tables", language_model._TABLES)))
    _, contexts, classes, customers, entries, _, _ = language_model._unpack(row["counts"], language_model._PART)
    discounts, places = (0.6, 0.4, 0.7), many[1].astype(np.int64)
    pairs = {}
    for w, c in found:
        before = np.append(language_model.START, w[:-1])
        for u, k, x in zip(before.tolist(), c.tolist(), w.tolist()):
            pairs[(u, k, x)] = pairs.get((u, k, x), 0) + 1

    words = cells[0]
    total, n = {}, 0
    for number in range(160):
        facts = [len(words), int(tables[2].sum())]
        sums = [np.bincount(cells[2], weights=x, minlength=language_model.CLASSES) for x in (tables[3], tables[1])]
        t = language_model.Totals.__new__(language_model.Totals).set(*sums, *facts, len(found), discounts)
        added = np.bincount(many[2], weights=tables[0].astype(np.int64) - 1, minlength=len(places))
        if number >= 60:
            n += 1
            opened = entries.astype(float)
            opened[places] += added
            state = pa.table({k: pa.array([v], pa.binary()) for k, v in (("counts", row["counts"]), ("many", row["many"]), ("cells", row["cells"]), ("tables0", language_model._pack(language_model._TABLES, *tables)), ("sums", language_model._pack((np.uint32, np.uint32), customers, opened)))})
            ((_, asked),) = language_model._entries(list(found), 1, len(found), True)
            docs, _, _, score = language_model._unpack(language_model.Part(state, [t]).sums(asked), language_model._SUMS)
            for i, x in zip(docs.tolist(), score.tolist()):
                total[i] = total.get(i, 0) + x
        tables = language_model.sweep_part(t, number, many, cells, tables, entries.astype(np.int64)[places] + added.astype(np.int64))
    got = np.array([total[i] / n for i in range(len(found))])

    root = Restaurant(language_model.ROOT_STRENGTH, discounts[1], Uniform(len(words)))
    middle = {k: Restaurant(language_model.STRENGTH, discounts[0], root) for _, k, _ in pairs}
    leaf = {u: Restaurant(language_model.CONTEXT_STRENGTH, discounts[2], middle[k]) for u, k, _ in pairs}
    everyone = [(u, x) for (u, _, x), c in pairs.items() for _ in range(c)]
    for u, x in everyone:
        leaf[u].add(x, rng)
    sums, n = np.zeros(len(found)), 0
    for sweep in range(90):
        rng.shuffle(everyone)
        for u, x in everyone:
            leaf[u].remove(x, rng)
            leaf[u].add(x, rng)
        if sweep >= 30:
            n += 1
            sums += [sum(math.log10(leaf[u].p(x)) for u, x in zip([int(language_model.START), *w.tolist()], w.tolist())) for w, _ in found]
    want = sums / n
    assert np.abs(got - want).mean() / np.abs(want).mean() < 0.02
    assert got.sum() == pytest.approx(want.sum(), rel=0.01)


def test_scores_do_not_depend_on_parts(docs, real, monkeypatch):
    texts = [r["text"] for r in real.select("text").limit(80).collect()]
    one = {r["doc_id"]: r["score"] for r in lm(docs(texts)).collect()}
    monkeypatch.setattr(language_model, "_parts", lambda d: 3)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 20_000)
    three = {r["doc_id"]: r["score"] for r in lm(docs(texts).repartition(3)).collect()}
    assert three == pytest.approx(one)


def test_language_model_edges(docs):
    assert lm(docs([])).count() == 0
    out = lm(docs([(None, "a"), (7, "a"), (7, "a")]))
    assert rows(out, "doc_id", "n_tokens") == sorted([(None, 2), (7, 2), (7, 2)], key=repr)
    only = language_model.score(docs(["a b"]), F.lit(True)).first()
    assert (only["n_known"], only["train_tokens"], only["base_score"], only["score"]) == (0, 0, 0.0, 0.0)


def test_the_word_before_counts_itself(docs):
    """Words that end alike, so are of one class, but are followed by different words."""
    train = [(i, f"ab{i % 2}xyz " + ("left" if i % 2 else "right")) for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(400, 600) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    by = {r["doc_id"]: r["score"] for r in lm(docs([*train, (held[0], "ab1xyz left"), (held[1], "ab1xyz right")])).collect()}
    assert by[held[0]] > by[held[1]] + 1


def one_by_one(c, t, others, strength, d, p, p_less, key, sweep):
    """Tables of one word after all of its customers were taken out and seated again, without arrays of words."""
    key = np.array([key], np.uint64)
    for step in range(c):
        head = float(language_model.uniform(key, sweep, 2 * step)[0]) < t / c
        if head and t == 1:
            continue
        t -= head
        mass = (strength + d * (others + t)) * (p_less if head else p)
        chance = language_model.opening(np.array([c - 1]), np.array([t]), np.array([mass]), d)[0]
        t += int(float(language_model.uniform(key, sweep, 2 * step + 1)[0]) < chance)
    return t


@pytest.mark.parametrize("walked", [1 << 17, 200])
def test_every_customer_of_frequent_words_is_reseated(walked, monkeypatch):
    """The customers beyond the first RESEATED as well, in runs of any length, as one by one."""
    monkeypatch.setattr(language_model, "WALKED", walked, raising=False)
    c = np.array([1, 2, 16, 17, 40, 64, 65, 66, 100, 700, 1025, 3000, 700, 3000])
    t = np.array([1, 2, 1, 17, 5, 64, 1, 66, 30, 700, 1, 40, 1, 3000])
    p = np.linspace(0.5, 0.01, len(c))
    keys = np.arange(len(c), dtype=np.uint64) + np.uint64(5)
    got = language_model.reseat(c, t, 10.0 + t, 1.0, 0.6, p, 0.9 * p, keys, 3)
    want = [int(x) if n < 2 else one_by_one(n, int(x), 10.0, 1.0, 0.6, q, 0.9 * q, int(k), 3) for n, x, q, k in zip(c.tolist(), t, p.tolist(), keys)]
    assert got.tolist() == want


def test_frequent_words_reach_their_distribution():
    """From one table, in as many sweeps as words with few customers need."""
    c, d, strength, p, n = 1000, 0.5, 1.0, 0.2, 200
    ks = np.arange(1, c + 1)
    weight = stirling(c, d)[1:] + ks * math.log(p) + np.cumsum(np.log(strength + d * (10 + np.arange(c))))
    weight = np.exp(weight - weight.max())
    t, keys, means = np.ones(n, np.int64), np.arange(n, dtype=np.uint64), []
    for sweep in range(30):
        t = language_model.reseat(np.full(n, c), t, 10.0 + t, strength, d, np.full(n, p), np.full(n, p), keys, sweep)
        means.append(t.mean())
    assert np.mean(means[15:]) == pytest.approx((ks * weight).sum() / weight.sum(), rel=0.02)
