"""Token tables: whole texts against the library, files and their layout, selective reads, odd rows."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clauselake.llm import tokentable

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def plain(rows, library):
    """Rows in ascending id, null ids first, then by length; texts of one id in these tests differ in length."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""))):
        ids = [*library(t), 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_texts_equal_the_library(library):
    rng, one = random.Random(4), tokentable.Encoder(P.path("byte_bpe_50k.json"))
    parts = ["word", "Wörter", " ", "  ", "\n", "\n\n", "\t", "'s", "it's", "don't", ".", ",\"", "42", "a1b", "é", "é", "ж", "漢字",
             "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", "🙂", "_", "-", "ɏx", "ǅ", "×", "\r\n", "x" * 300]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    for at in range(0, 3000, 100):
        ids, sizes = one.encode(texts[at:at + 100])
        got = np.split(ids, np.cumsum(sizes)[:-1])
        assert [g.tolist() for g in got] == [[*library(t), 2] for t in texts[at:at + 100]]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokentable, "MOST", 3)
    one = tokentable.Encoder(P.path("byte_bpe_50k.json"))
    for t in ["some words here", "and others there", "some words here", ""]:
        assert one.encode([t])[0].tolist() == [*library(t), 2]
    assert len(one.pieces) <= 6


def test_words_before_marks_and_lines_are_remembered_once(library):
    one = tokentable.Encoder(P.path("byte_bpe_50k.json"))
    texts = [f"{a} {b}{m}\n{a}{m} été{m}" for a in ("tall", "Wide", "don't", "42") for b in ("tree", "house", "x1") for m in ".,;:!?)"]
    ids, sizes = one.encode(texts)
    assert [g.tolist() for g in np.split(ids, np.cumsum(sizes)[:-1])] == [[*library(t), 2] for t in texts]
    assert len(one.pieces) < 30


def test_pieces_are_cut_where_the_library_cuts(library):
    rng, one = random.Random(5), tokentable.Encoder(P.path("byte_bpe_50k.json"))
    parts = [*"aB1.' \n\t\r\x0b\x0c\x00\x1c", "'s", "'ll", "  ", "\n ", " \n", "\x85", "\xa0", "é", "Ã", "×", "÷", "²", "ŉ", "ж", "漢",
             "\u2003", "\u2028", "\u3000", "\u0301", "’", "🙂"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(20_000)]
    ids, sizes = one.encode(texts)
    assert [g.tolist() for g in np.split(ids, np.cumsum(sizes)[:-1])] == [[*library(t), 2] for t in texts]


def test_other_vocabularies_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    other = Tokenizer(models.BPE())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    texts = ["one.\nTwo, one. two", "", "one. two one.\n", "two, two, one.\nTwo"] * 5
    other.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=300, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    other.save(str(tmp_path / "other.json"))
    ids, sizes = tokentable.Encoder(str(tmp_path / "other.json")).encode(texts)
    assert [g.tolist() for g in np.split(ids, np.cumsum(sizes)[:-1])] == [[*other.encode(t).ids, 2] for t in texts]


def test_slices_and_large_strings(library):
    one, texts = tokentable.Encoder(P.path("byte_bpe_50k.json")), ["left out ", " é first", "", "\n last ", " left out"]
    for kind in (pa.string(), pa.large_string()):
        for low, high in ((1, 4), (2, 3), (0, 0), (0, 5)):
            ids, sizes = one.encode(pa.array(texts, kind)[low:high])
            assert ids.tolist() == [i for t in texts[low:high] for i in [*library(t), 2]]
            assert sizes.tolist() == [len(library(t)) + 1 for t in texts[low:high]]


def test_gulps_hold_the_same_rows():
    texts = ["x" * n for n in (*range(60), 5000, 1, 1, 3000, 0, 0, *[200] * 50)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for size in (1, 7, 64, 200):
        batches = [rows.slice(i, size) for i in range(0, len(texts), size)]
        got = list(tokentable.gulps([rows.slice(0, 0), *batches], 1000))
        assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(texts)))
        assert [t for b in got for t in b.column(1).to_pylist()] == texts
        assert all(b.num_rows == 1 or sum(map(len, b.column(1).to_pylist()[:-1])) <= 1000 for b in got)
        assert len(got) < 40
    assert list(tokentable.gulps([])) == list(tokentable.gulps([rows.slice(0, 0)])) == []


def test_query_equals_brute_force(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    from clauselake.llm.queries import QUERIES

    got = QUERIES["op11_token_table"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, library))


def test_odd_rows(spark, library):
    rows = [(7, "seven"), (None, "no id"), (3, None), (4, ""), (7, "seven again, longer"), (-1, "x y" * 20_000), (None, "nothing here either"),
            *[(9, "the same row")] * 40]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("start", F.lit("x")).withColumn("row", F.lit(1)).repartition(6)
    got = tokentable.token_digests(df)
    assert dict(got.dtypes) == {"doc_id": "int", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    key = lambda r: (r[1], str(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, library), key=key)
    assert tokentable.token_digests(df.limit(0)).count() == 0


def test_files_have_small_groups_pages_and_indexes(spark, tmp_path, library):
    rows = [(i, f"document number {i} holds some words " * (1 + i % 40)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    folder = str(tmp_path / "tokens")
    tokentable.write_token_table(docs, folder, group_bytes=64 << 10, page_rows=64)
    files = sorted(glob.glob(f"{folder}/part-*"))
    last = None
    for f in files:
        meta = pq.ParquetFile(f).metadata
        column = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        assert column["ids.list.element"].dictionary_page_offset is not None
        assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings and "DELTA_BINARY_PACKED" in column["start"].encodings
        assert all(c.has_column_index and c.has_offset_index for c in column.values())
        ids = pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (last is None or ids[0] > last)
        last = ids[-1]
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > len(files)
    whole = {r.doc_id: r for r in tokentable.token_table(spark, folder).collect()}
    assert [whole[i].start for i in range(4000)] == np.cumsum([0] + [whole[i].n_tokens for i in range(3999)]).tolist()
    few = tokentable.documents_between(spark, folder, 100, 104)
    assert sorted((r.doc_id, r.start, r.ids) for r in few.collect()) == [(i, whole[i].start, [*library(rows[i][1]), 2]) for i in range(100, 105)]
    assert "GreaterThanOrEqual(doc_id,100)" in few._jdf.queryExecution().executedPlan().toString()


def test_metadata_is_read_without_tokens(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    tokentable.write_token_table(spark.createDataFrame([(1, "a"), (2, "b c")], "doc_id long, text string"), folder)
    light = tokentable.token_table(spark, folder, tokens=False)
    plan = light._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.replace("doc_ids", "") and sorted(map(tuple, light.collect())) == [(1, 0, 2), (2, 2, 3)]


def test_several_files_of_a_task_count_on(spark, tmp_path):
    folder, key = str(tmp_path / "tokens"), "spark.sql.files.maxRecordsPerFile"
    spark.conf.set(key, 3)
    try:
        tokentable.write_token_table(spark.createDataFrame([(i, "a b") for i in range(40)], "doc_id long, text string"), folder)
    finally:
        spark.conf.unset(key)
    assert len(glob.glob(f"{folder}/part-*")) > 10
    assert sorted((r.doc_id, r.start) for r in tokentable.token_table(spark, folder).collect()) == [(i, 3 * i) for i in range(40)]
