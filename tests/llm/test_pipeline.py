"""Every stage of the corpus pipeline against plain Python on the small table."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from riskloom.llm import secrets
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.where("n_chars <> length(text)").isEmpty()
    first, language, lines, near, clean = seen
    assert all(any(c.isalpha() for c in t) for t in language.values()) and len(language) >= 0.98 * len(first)
    gone = {i: set(ks) for i, _, ks in brute.line_dedup(sorted(language.items()))}
    rest = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in language.items()}
    assert lines == {i: t for i, t in rest.items() if not gone[i] or brute.WORD.search(t)}
    assert set(near) == {r[0] for r in brute.near(sorted(lines.items()), 80) if r[3]}
    assert set(clean) == set(near)
    spans = {r[0]: sum(r[1:4]) for r in brute.secret_spans(sorted(near.items()))}
    assert any(spans.values()) and all(clean[i] == near[i] for i, n in spans.items() if not n and secrets.RULES and "[SECRET]" not in clean[i])
    assert not any(sum(r[1:4]) for r in brute.secret_spans(sorted(clean.items())))
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    ids = brute.packed_ids(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), sorted(clean.items()))
    assert {r.doc_id for r in packed} == set(clean)
    for r in packed:
        assert brute.crc(ids[r.doc_id][4 * r.start:4 * (r.start + r.length)]) == r.ids_crc32


def test_run_reads_the_table(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 100


def test_language_rejects(spark):
    """Gibberish and an unlearned script go, nearly all real texts stay; without labels all texts with a letter stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rnd = random.Random(2)
    alphabets = ["abcdefghijklmnopqrstuvwxyz    ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "αβγδεζηθικλμνξοπρστυφχψω    ", "абвгдежзийклмнопрстуфхцчшщъыьэюя    "]
    bad = [(-1 - 10 * k - j, "".join(rnd.choice(a) for _ in range(1500)), None) for k, a in enumerate(alphabets) for j in range(10)]
    more = spark.createDataFrame([*bad, (-100, "123 !?", None), (-101, None, None)], docs.schema)
    ids = [r.doc_id for r in P.identify_language(spark, docs.unionByName(more), SF).collect()]
    assert min(ids) >= 0 and len(ids) >= 0.98 * docs.count()
    bare = spark.createDataFrame([(1, "the cat", None), (2, "12", None), (3, None, None), (4, "ναι", None)], docs.schema)
    assert sorted(r.doc_id for r in P.identify_language(spark, bare, SF).collect()) == [1, 4]


def test_repeated_and_null_ids(spark):
    """Of copies with one id, or with none, one row stays after each dedup stage."""
    rnd = random.Random(9)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    one, two, three = words(40), words(40), words(40)
    data = [(7, one), (7, one), (3, one), (None, two), (None, two), (5, three), (5, three), (None, three), (9, words(40)), (None, words(40))]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    lines = sorted(r.text for r in P.dedup_lines(spark, docs, SF).collect())
    assert lines == sorted({t for _, t in data})
    near = P.near_dedup(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted((r.text, r.doc_id or 0) for r in near.collect()) == sorted([(one, 3), (two, 0), (three, 5), (data[8][1], 9), (data[9][1], 0)])


def test_empty_table(spark):
    """Every stage gives no rows for no rows, with the columns that it has for others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.collect() == []
    assert P.pack(spark, docs, SF).collect() == []


def test_columns_with_names_of_ours_stay(spark):
    """_key, _row, _id, _removed, findings, blob, gone and removed of the user come through the stages; null texts too."""
    names = ["_key", "_row", "_id", "_version", "_nth", "_removed", "_findings", "_blob", "findings", "blob", "gone", "removed", "version", "place", "of", "n"]
    rnd = random.Random(3)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    line = words(20)
    texts = [f"{line}\n{words(30)}", f"{line}\n{words(30)} password: 0123456789abcdef0123", None, "", words(50), words(50)]
    docs = spark.createDataFrame([(k, t, *[f"{n}-{k}" for n in names]) for k, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for stage in (P.dedup_lines, P.near_dedup, P.scan_secrets):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)
    clean = {r.doc_id: r.text for r in P.scan_secrets(spark, docs, SF).collect()}
    assert clean[1].endswith("[SECRET]") and clean[2] is None and clean[3] == ""
