"""The pipeline's stages on odd rows, against the operators' own verdicts and plain counts."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline as p
from tallyforge.llm.minhash import near_duplicates
from tallyforge.llm.mixing import mix_sources
from tallyforge.llm.toxicity import learnable, score_toxicity

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 5000}" for i in range(40_000))
ODD = [
    (1, None, None, 5), (2, "", "a", 0), (3, LONG, "a", len(LONG)), (4, "one two three four five six seven", "b", 33), (4, "one two three four five six seven", "b", 33),
    (None, "no id here but words", "c", 20), (None, None, None, None), (5, "\n\n \n", "d", 4), (6, "same\nline", "e", 9), (6, "another text of the same id", "e", 27),
]
#: Names that the stages and operators use inside.
CLASHING = ("row", "key", "id", "row_key", "predicted", "times", "score", "lines_total", "lines_removed", "kept", "taken", "size")


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(i, t, "xx", s, n) for i, t, s, n in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    both = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(60))
    return both.selectExpr("*", *(f"'{c}' AS {c}" for c in CLASHING)).repartition(3).persist()


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES[:-1]])
def test_stages_keep_columns_and_take_empty_tables(spark, docs, name):
    stage = dict(p.STAGES)[name]
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.count() == 0
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    got = out.collect()
    assert all(tuple(r[c] for c in CLASHING) == CLASHING for r in got)
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in got} <= ids


def test_toxicity_drops_what_is_predicted(spark, docs):
    labels = learnable(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    bad = {(r.doc_id, r.row_key) for r in score_toxicity(docs, labels).filter("predicted = 1").collect()}
    keyed = docs.selectExpr("*", "xxhash64(doc_id, text) AS k").collect()
    assert rows(p.drop_toxic(spark, docs, SF)) == Counter(tuple(r)[:-1] for r in keyed if (r.doc_id, r.k) not in bad)


def test_common_lines_go(spark):
    line = "This line stands on many sites."
    table = spark.createDataFrame([(i, f"own text {i}\n{line}", f"s{i}", 99) for i in range(12)] + [(50, line, "s50", 31), (51, None, "s1", 7)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in p.drop_common_lines(spark, table, SF).collect()}
    assert got == {0: (f"own text 0\n{line}", 99)} | {i: (f"own text {i}", len(f"own text {i}")) for i in range(1, 12)} | {51: (None, 7)}
    assert p.drop_common_lines(spark, table.drop("n_chars"), SF).columns == ["doc_id", "text", "source"]


def test_one_of_near_copies_stays(spark, docs):
    kept = {(r.doc_id, r.row_key) for r in near_duplicates(docs).filter("kept").collect()}
    want = {(r.doc_id, r.text) for r in docs.selectExpr("*", "xxhash64(doc_id, text) AS k").collect() if (r.doc_id, r.k) in kept}
    got = Counter((r.doc_id, r.text) for r in p.keep_one_of_near_copies(spark, docs, SF).collect())
    assert set(got) == want and set(got.values()) == {1}


def test_documents_repeat_as_the_mix_takes_them(spark, docs):
    one = docs.dropDuplicates(["doc_id", "text"])
    times = Counter()
    for r in mix_sources(one).filter("taken > 0").collect():
        times[r.doc_id, r.row_key] += r.taken // r.size
    got = Counter((r.doc_id, r.k) for r in p.mix(spark, one, SF).selectExpr("doc_id", "xxhash64(doc_id, text) AS k").collect())
    assert got == times and max(got.values()) <= 3


def test_encoding_is_the_librarys(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((r.doc_id, len(x := lib.encode(r.text or "")), sha(",".join(map(str, x))), sha(lib.decode(x))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.encode(spark, docs, SF).collect()) == want
    assert p.encode(spark, docs.limit(0), SF).count() == 0
