import zlib

import numpy as np
import pytest
from keelgrid.llm.shared import filesystem
from keelgrid.llm.tokenstore import VOCABULARY, TokenStore, cuts
from tokenizers import Tokenizer


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 49_000, n, dtype=np.uint32) for n in (5000, 777, 1234))
    one, two = np.concatenate([a, shared]), np.concatenate([b, shared])
    both = cuts(np.concatenate([one, two]), np.array([len(one), len(two)]))
    assert both == [cuts(one, np.array([len(one)]))[0], cuts(two, np.array([len(two)]))[0]]
    for ids, ends in zip((one, two), both, strict=True):
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(ids) and sizes.max() <= 2048 and (sizes[:-1] >= 64).all()
    tail = [{len(x) - e for e in ends} for x, ends in zip((one, two), both, strict=True)]
    assert len(tail[0] & tail[1]) > 5
    assert cuts(np.zeros(0, np.uint32), np.array([], np.int64)) == [] and max(np.diff([0, *cuts(np.full(9000, 5, np.uint32), np.array([9000]))[0]])) <= 2048


def rows():
    long = " ".join(f"word{i}" for i in range(4000))
    return [(7, "Hello  World"), (-3, None), (900, ""), (5, long), (6, long), (1 << 40, long[:9000] + "x"), (None, "no id"), (8, "twice"), (8, "twice"), (9, "a <|endoftext|> 中文 😀"), (10, "a <|endoftext|> b")]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "b") for r in rows()], "doc_id long, text string, block string").repartition(3)
    store = TokenStore.write(df)
    got = store.documents().collect()
    library = Tokenizer.from_file(VOCABULARY)
    start = 0
    for r, (i, text) in zip(sorted(got, key=lambda r: r.start), sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = np.append(np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    chunks = store.table("chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert chunks.agg({"ids": "sum"}).first()[0] < 0.55 * start
    assert store.table("manifest").where("level = 3").count() == 1


@pytest.mark.parametrize("harm", ["container", "recipe"])
def test_harm_is_noticed(spark, harm):
    store = TokenStore.write(spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(9)], "doc_id long, text string"))
    if harm == "container":
        place = store.table("chunks").orderBy("container", "offset").first()
        fs, path = filesystem(f"{store.folder}/containers/{place.container}")
        with fs.open_input_stream(path, compression=None) as f:
            data = bytearray(f.read())
        data[place.offset + place.size // 2] ^= 0xFF
        with fs.open_output_stream(path, compression=None) as f:
            f.write(bytes(data))
    else:
        changed = store.table("recipes").selectExpr("block", "doc_id + 1 as doc_id", "start", "n_tokens", "digests", "leaf").toPandas()
        spark.createDataFrame(changed, store.table("recipes").schema).write.mode("overwrite").parquet(f"{store.folder}/recipes")
    with pytest.raises(Exception, match=r"(?s)fit|can't|decompress|Zstd|zstd"):
        store.documents().collect()


def test_empty_table(spark):
    assert TokenStore.write(spark.createDataFrame([], "doc_id long, text string")).documents().collect() == []


def test_hashed_ids_and_files_in_ascending_order(spark):
    rng = np.random.default_rng(5)
    ids = sorted({int(x) for x in rng.integers(0, 1 << 62, 3000)})
    df = spark.createDataFrame([(i, f"text {i % 97}") for i in ids] + [(None, f"none {k}") for k in range(900)], "doc_id long, text string").repartition(5)
    store = TokenStore.write(df)
    recipes = store.table("recipes")
    assert recipes.groupBy("block").count().agg({"count": "max"}).first()[0] <= 1024 and recipes.select("block").distinct().count() > 5
    spans = recipes.selectExpr("input_file_name() as f", "start").groupBy("f").agg({"start": "min"}).orderBy("f").collect()
    assert [r[1] for r in spans] == sorted(r[1] for r in spans)
    got = store.documents(with_ids=False).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 900 + ids
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got])[:-1]).tolist()
