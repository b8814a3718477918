import random

import brute
import pytest
from helpers import rows

from tidelog.llm import common, exact_dedup, line_dedup, near_dup, suffix_dedup


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def changed(rng, text, n):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] = "zz" + str(rng.randint(0, 10**9))
    return " ".join(w)


EDGES = [None, "", " \n\t", "one", "ONE", "two words here", "x" * 50_000, "a b c d e", "A b c d e", "a b c d e f"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(12)]
    out = list(base)
    for t in base[:6]:
        out += [t, changed(rng, t, 1), changed(rng, t, 2), changed(rng, t, 5)]
    passage = prose(rng, 60)
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 25) for _ in range(4)] + [passage.upper(), passage + " " + prose(rng, 300)]
    return out + EDGES


def test_exact(docs, texts):
    from hashlib import sha256

    pairs = list(enumerate([*texts, "B" * 30_000, "b" * 30_000, "b" * 29_999]))
    groups = {}
    for i, t in pairs:
        groups.setdefault((t or "").translate(brute.FOLD), []).append(i)
    want = sorted(((i, max(g), len(g), i == max(g), sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g), key=repr)
    assert rows(exact_dedup.exact_dedup(docs(pairs)), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_with_hashes_that_fail(docs, monkeypatch):
    real = exact_dedup.recipes

    def colliding(d):
        from pyspark.sql import functions as F

        return real(d).withColumn("ids", F.transform("ids", lambda x: F.lit(7).cast("long")))

    monkeypatch.setattr(exact_dedup, "recipes", colliding)
    out = exact_dedup.exact_dedup(docs(["one", "two", "ONE", "three"]))
    assert rows(out, "doc_id", "keep_id", "group_size") == [(0, 2, 2), (1, 1, 1), (2, 2, 2), (3, 3, 1)]


def test_exact_on_repeated_rows_and_nulls(docs):
    out = exact_dedup.exact_dedup(docs([(1, "a"), (1, "a"), (None, "A"), (None, "b")]))
    assert rows(out, "doc_id", "keep_id", "group_size", "kept") == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)], key=repr)
    assert exact_dedup.exact_dedup(docs([])).count() == 0


def test_cut_points_follow_content():
    rng = random.Random(1)
    tail = bytes(rng.choices(b"abcdefgh ", k=60_000))
    cut = lambda t: {t[a:b] for a, b in zip([0, *exact_dedup.cut_points(t)], exact_dedup.cut_points(t))}
    a, b = cut(tail), cut(b"something else before it " * 40 + tail)
    assert b"".join(tail[x:y] for x, y in zip([0, *exact_dedup.cut_points(tail)], exact_dedup.cut_points(tail))) == tail
    assert len(a & b) > 0.6 * len(a)


LINES = ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb", "", None, "\n\n\n\n", "q\nq\nq\nq\nq", "a\nb\nc", "b\nc\nd\ne", "\n\n\n\na\nb\nc", "p\r\nq\nr", "z" * 20_000 + "\nq\nq\nq"]


def test_lines(docs):
    out = line_dedup.dedup_lines(docs(LINES))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == brute.dedup_lines(list(enumerate(LINES)))
    by = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in out.collect()}
    assert by[1] == (5, 3) and by[3] == (1, 0) and by[4] == (0, 0)


def test_lines_on_real_documents(real):
    pairs = [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(real).collect()} == brute.dedup_lines(pairs)


def test_lines_with_clashing_names_and_repeated_rows(docs):
    from pyspark.sql import functions as F

    d = docs([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "a\nb\nc")]).withColumn("n_lines", F.lit("mine")).withColumn("spans", F.lit(1))
    out = line_dedup.dedup_lines(d)
    assert rows(out, "doc_id", "text", "n_removed", "spans") == sorted([(1, "", 3, 1), (1, "", 3, 1), (2, "", 3, 1), (None, "a\nb\nc", 0, 1)], key=repr)
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_near_duplicates(docs, texts):
    pairs = list(enumerate(texts))
    want = brute.components(pairs)
    out = near_dup.near_duplicates(docs(pairs))
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == [(i, len(brute.shingles(t)), want[i], want[i] == i) for i, t in sorted(pairs, key=lambda p: repr((p[0],)))] or {(r["doc_id"], r["component_id"]) for r in out.collect()} == set(want.items())


def test_near_duplicates_in_large_nodes(docs, monkeypatch):
    """Copies that are similar to their origin more than to each other, and documents that share a passage only."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 40)
    texts = [base] + [changed(rng, base, rng.randint(1, 4)) for _ in range(50)] + [passage + " " + prose(rng, 60) for _ in range(40)]
    monkeypatch.setattr(near_dup, "SMALL", 6)
    monkeypatch.setattr(near_dup, "FEW", 2)
    pairs = list(enumerate(texts))
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(pairs)).collect()} == brute.components(pairs)


def test_pairs_at_the_threshold_in_large_nodes(docs, monkeypatch):
    """Pairs at 0.75 to 0.8 among documents that share most of their text, so that nodes stay large through all levels."""
    rng = random.Random(11)
    passage, texts = prose(rng, 144), []
    for _ in range(150):
        both = prose(rng, 7)
        texts += [f"{passage} {both} {prose(rng, 20)}" for _ in range(2)]
    monkeypatch.setattr(near_dup, "SMALL", 8)
    pairs = list(enumerate(texts))
    want = brute.components(pairs)
    near = [len(x & y) / len(x | y) for x, y in zip(map(brute.shingles, texts[::2]), map(brute.shingles, texts[1::2]))]
    assert all(0.75 <= s < 0.8 for s in near) and len(set(want.values())) == 150
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(pairs)).collect()} == want


def test_near_duplicates_of_nothing(docs):
    assert near_dup.near_duplicates(docs([])).count() == 0
    out = near_dup.near_duplicates(docs([(5, None), (6, ""), (7, "a b"), (7, "a b"), (None, "a b")]))
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == sorted([(5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (7, 1, 7, True), (None, 1, 7, False)], key=repr)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_passages(docs, texts):
    pairs = list(enumerate(texts))
    assert rows(suffix_dedup.repeated_passages(docs(pairs)), "doc_id", "start_word", "end_word", "removable") == sorted(brute.repeated_spans(pairs), key=repr)


def test_passages_that_many_share(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    pairs = list(enumerate(texts))
    assert rows(suffix_dedup.repeated_passages(docs(pairs)), "doc_id", "start_word", "end_word", "removable") == sorted(brute.repeated_spans(pairs), key=repr)


def test_passages_on_real_documents(real):
    pairs = [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]
    assert rows(suffix_dedup.repeated_passages(real), "doc_id", "start_word", "end_word", "removable") == sorted(brute.repeated_spans(pairs), key=repr)


def test_passages_within_one_document_are_left(docs):
    p = " ".join(f"w{i}" for i in range(60))
    assert suffix_dedup.repeated_passages(docs([p + " x " + p, "other text"])).count() == 0
    assert suffix_dedup.repeated_passages(docs([(1, p), (1, p)])).count() == 0
    assert suffix_dedup.repeated_passages(docs([])).count() == 0
    assert rows(suffix_dedup.repeated_passages(docs([(None, p), (2, p)])), "doc_id", "removable") == sorted([(None, 0), (2, 60)], key=repr)


def test_removing_passages(docs, texts):
    """What is left holds no passage that an earlier text has, and everything else."""
    pairs = list(enumerate(texts))
    spans = {}
    for i, a, b, _ in brute.repeated_spans(pairs):
        spans.setdefault(i, []).append((a, b))
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_passages(docs(pairs)).collect()}
    assert got[0] == texts[0] and {i for i, t in pairs if t is None} == {i for i, t in got.items() if t is None}
    removable = {}
    for i, _, _, n in brute.repeated_spans(pairs):
        removable[i] = removable.get(i, 0) + n
    for i, t in pairs:
        assert len(brute.words(got[i])) == len(brute.words(t)) - removable.get(i, 0)
        assert i in removable and removable[i] or got[i] == t


def test_removing_passages_keeps_other_columns(docs):
    from pyspark.sql import functions as F

    p = " ".join(f"w{i}" for i in range(60))
    d = docs([(1, p), (2, f"Before.  {p}\nafter"), (None, None)]).withColumn("spans", F.lit("mine"))
    out = suffix_dedup.remove_passages(d)
    assert out.columns == d.columns and rows(out, "doc_id", "text", "spans") == sorted([(1, p, "mine"), (2, "Before.  after", "mine"), (None, None, "mine")], key=repr)


def clashing(df):
    """With columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ("n", "h1", "h2", "sketch", "mins", "cid", "node", "root", "key", "row", "pos", "doc", "size", "weight", "anchor", "hot", "low", "held", "part", "block", "grp", "start", "media", "samples", "label", "score", "kept", "target_source", "source_size", "ids")
    return df.withColumns({c: F.lit("mine") for c in names})


def test_clashing_names(docs, texts):
    d = docs(texts)
    for op in (near_dup.near_duplicates, suffix_dedup.repeated_passages, exact_dedup.exact_dedup):
        assert rows(op(clashing(d))) == rows(op(d))


def test_repeated_rows_and_very_long_texts(docs):
    rng = random.Random(8)
    long = " ".join(f"{rng.getrandbits(40):x}" for _ in range(250_000))  # some 2.7 MB
    other = long.rsplit(" ", 1000)[0]
    d = docs([(1, long), (2, other), (3, long), (3, long), (4, "x" * 3_000_000)])
    assert rows(near_dup.near_duplicates(d), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]
    assert rows(exact_dedup.exact_dedup(d), "doc_id", "keep_id", "group_size") == [(1, 3, 3), (2, 2, 1), (3, 3, 3), (3, 3, 3), (4, 4, 1)]
    assert rows(suffix_dedup.repeated_passages(d), "doc_id", "start_word", "end_word", "removable") == [(1, 0, 250_000, 0), (2, 0, 249_000, 249_000), (3, 0, 250_000, 250_000)]
    assert [r["n_removed"] for r in line_dedup.dedup_lines(d).collect()] == [0] * 5


def test_many_rows_without_an_id(docs):
    texts = [f"text number {i} of those without any id at all" for i in range(60)]
    out = near_dup.near_duplicates(docs([(None, t) for t in texts for _ in range(3)]))
    assert rows(out, "doc_id", "component_id", "kept") == [(None, None, True)] * 180


def test_recall_at_the_threshold(docs, monkeypatch):
    """Pairs at 0.75 to 0.8 that one large node holds, without others to join them: found to 0.9 at least."""
    rng = random.Random(21)
    common_part, texts = prose(rng, 12), []
    for _ in range(120):
        own = prose(rng, 100)
        texts += [f"{common_part} {own} {prose(rng, 15)}" for _ in range(2)]
    monkeypatch.setattr(near_dup, "SMALL", 20)
    monkeypatch.setattr(near_dup, "FEW", 1)
    sims = [len(x & y) / len(x | y) for x, y in zip(map(brute.shingles, texts[::2]), map(brute.shingles, texts[1::2]))]
    pairs = [i for i, s in enumerate(sims) if 0.75 <= s < 0.8]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(texts)).collect()}
    assert len(pairs) > 60 and sum(got[2 * i + 1] == 2 * i for i in pairs) >= 0.97 * len(pairs)
