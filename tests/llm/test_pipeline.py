"""The pipeline hands on whole, clean documents, down to the ids of their redacted texts."""

import hashlib
import random

import numpy as np

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns, name
    encoded = corpus_pipeline.STAGES[4][1](spark, docs, small)
    assert 0 < encoded.count() == docs.count()


def planted(rng):
    """(doc_id, text, what becomes of it): None where the document goes, else the text that is encoded."""
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi") for b in ("ra", "ne", "to", "su") for c in ("l", "n", "s", "")]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    item = " ".join(words(30))
    rows, labels = [], []
    for k in range(500):  # labelled, a quarter toxic by one of two words
        text = words(60)
        if k % 4 == 0:
            text[rng.randrange(60)] = rng.choice(("vilest", "nastier"))
        rows.append((k, " ".join(text), None if k % 4 == 0 else " ".join(text)))
        labels.append((k, 0, int(k % 4 == 0)))
    n = 1000
    for _ in range(20):  # near copies: the least doc_id stays
        base = words(120)
        rows.append((n, " ".join(base), " ".join(base)))
        rows.append((n + 1, " ".join([*base, *words(6)]), None))
        rows.append((n + 2, " ".join(base[:-6]), None))
        rows.append((n + 3, " ".join(base), None))
        n += 10
    for _ in range(10):  # a benchmark item within
        rows.append((n, " ".join([*words(100), item, *words(100)]), None))
        n += 1
    for k in range(10):  # personal data
        before, after = " ".join(words(40)), " ".join(words(40))
        rows.append((n, f"{before} mail me@host{k}.example.com or 10.1.2.{k} or +1 (555) 123-456{k} {after}", f"{before} mail [EMAIL] or [IP] or [PHONE] {after}"))
        n += 1
    toxic_copy = words(80)
    rows.append((n, " ".join([*toxic_copy, "vilest"]), None))  # a copy of a toxic text is judged on its own
    rows.append((n + 1, " ".join(toxic_copy), " ".join(toxic_copy)))
    rows += [(n + 2, "", ""), (n + 3, None, ""), (n + 4, " \n ", " \n "), (n + 5, "one", "one")]
    return rows, labels, item


def test_run_equals_a_plain_pipeline(spark, tmp_path):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    rows, labels, item = planted(random.Random(8))
    spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t, _ in rows], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = {}
    for i, _, kept in rows:
        if kept is not None:
            ids = library.encode(kept, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert got == want


def test_run_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows and columns of clashing names."""
    odd = [(1, "a few plain words that stay as they are", "x"), (1, "a few plain words that stay as they are", "x"), (None, "no id here", "x"), (2, None, "x")]
    for name, rows in (("empty", []), ("odd", odd)):
        folder = tmp_path / name
        spark.createDataFrame(rows, "doc_id long, text string, sig string").write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        found = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in found) == ([(0, True), (1, True), (1, True), (2, False)] if rows else [])
