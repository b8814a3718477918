import brute
import public_tokenizers
from helpers import rows
from oracle import connect, same

import corpus_pipeline
from tidelog.llm import queries as llm
from tidelog.llm import quality
from tidelog.llm.common import table


def test_queries_equal_their_sql(spark, data):
    con = connect(data)
    for name, sql in llm.oracle_sql().items():
        same(llm.queries()[name](spark, data), con, sql)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))


def test_stages_one_by_one(spark, data):
    docs = table(spark, data, "documents")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).cache()
        held[name] = out
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    # quality: what the classifier rejects goes, all else stays as it is
    first = table(spark, data, "documents")
    labels = table(spark, data, "labels").where(llm.remainder("doc_id", 3) != 1)
    feats = quality.features(first)
    kept = {r["doc_id"] for r in quality.score_features(feats, quality.fit(feats, labels)).where("score >= 0.5").collect()}
    assert rows(held["quality"]) == rows(first.where(first.doc_id.isin(list(kept))))
    # lines
    pairs = [(r["doc_id"], r["text"]) for r in held["quality"].collect()]
    assert {r["doc_id"]: r["text"] for r in held["line_dedup"].collect()} == brute.dedup_lines(pairs)
    assert all(r["n_chars"] == len(r["text"]) for r in held["line_dedup"].collect())
    # near duplicates
    pairs = [(r["doc_id"], r["text"]) for r in held["line_dedup"].collect()]
    assert {r["doc_id"] for r in held["near_dup"].collect()} == {i for i, c in brute.components(pairs).items() if i == c}
    # mixing repeats whole rows only
    assert set(rows(held["mixing"])) <= set(rows(held["near_dup"]))
    # packing: every token of every copy is in one piece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = [r["text"] for r in held["mixing"].collect()]
    assert sum(r["length"] for r in held["packing"].collect()) == sum(len(x.ids) + 1 for x in tok.encode_batch(texts, add_special_tokens=False))


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0 and corpus_pipeline.ORACLE_SQL is None


EDGES = [(None, None), (None, ""), (None, "some text here"), (1, None), (1, ""), (2, "a b c"), (2, "a b c"), (2, "other words"), (3, "x" * 20_000), (4, "one\ntwo\nthree\nfour"), (5, "one\ntwo\nthree\nfive"), (6, " \n\t ")]


def test_every_stage_on_odd_rows(spark, docs, data):
    """Nulls, empty texts, repeated rows, one doc_id for different texts, and columns named as the operators' own."""
    from pyspark.sql import functions as F

    given = docs(EDGES).withColumns({c: F.lit("mine") for c in ("score", "size", "copies", "target_source", "target", "kept", "n", "key", "text_key", "dropped_id", "spans", "row", "grp", "start", "ids")})
    out = {name: stage(spark, given, data) for name, stage in corpus_pipeline.STAGES}
    for name in ("quality", "line_dedup", "near_dup", "mixing"):
        assert out[name].columns == list(corpus_pipeline.COLUMNS)
    given = given.select(*corpus_pipeline.COLUMNS)
    assert set(rows(out["quality"])) <= set(rows(given))
    texts = rows(out["line_dedup"], "doc_id", "text")
    assert len(texts) == len(EDGES) and (5, "five") in texts and (4, "one\ntwo\nthree\nfour") in texts and (1, None) in texts
    # of two texts with doc_id 2 both stay, as they are not alike, each with its repetitions
    assert rows(out["near_dup"], "doc_id", "text") == sorted([x for x in EDGES if x != (5, "one\ntwo\nthree\nfive")] + [(5, "one\ntwo\nthree\nfive")], key=repr)
    taken = rows(out["mixing"], "doc_id", "text")
    assert taken and set(taken) <= set(EDGES)
    assert sum(r["length"] for r in out["packing"].collect() if r["start"] + r["length"] == r["doc_tokens"]) > 0 and out["packing"].groupBy("doc_id").count().count() == len({i for i, _ in EDGES})


def test_every_stage_on_nothing(spark, docs, data):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), data).count() == 0, name


def test_near_duplicates_leave_one_document_of_each_group(spark, docs, data):
    text = " ".join(f"w{i}" for i in range(100))
    given = docs([(7, text), (3, text + " more"), (5, text), (5, "other words of the same id"), (9, text.upper())])
    stage = dict(corpus_pipeline.STAGES)["near_dup"]
    assert rows(stage(spark, given, data), "doc_id", "text") == [(3, text + " more"), (5, "other words of the same id")]


def test_mixing_with_a_column_of_its_own_name(spark, docs):
    from pyspark.sql import functions as F

    from tidelog.llm import mixing

    d = docs([(i, "a b c") for i in range(5)]).withColumn("target_source", F.lit("mine")).withColumn("_x", F.lit(1))
    out = mixing.mix(d)
    assert {r["target_source"] for r in out.collect()} == {"mine"} and out.agg(F.sum("copies")).first()[0] == 5
    assert mixing.mix(docs([])).count() == 0
