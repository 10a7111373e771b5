"""The corpus operators against brute force, round trips and odd rows."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from stagewatch.llm import bpe, decontamination, html_text, jaccard_join, pii, sharding, token_records, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `ids` string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None, "clash") for i, t, l, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k}" for k in range(20000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one two", "en", "a"), (5, long, "en", "a"), (6, long, "de", "b"), (7, "one two", "en", "a"), (None, "x y z", "en", "a"), (8, "mail me a@b.com +1 (555) 123-4567", "en", "a"), (8, "mail me a@b.com +1 (555) 123-4567", "en", "a")]
    return docs_of(spark, rows)


def test_sharding(spark, odd, small):
    rows = sharding.kd_shards(spark.read.parquet(f"{small}/documents.parquet"), 16).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.35 * min(sizes.values())
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sum(r["text_crc32"] == zlib.crc32(b"") for r in sharding.kd_shards(odd, 4).collect()) >= 2
    assert sharding.kd_shards(odd.limit(0), 4).count() == 0


def test_sharding_splits_copies(spark):
    rows = docs_of(spark, [(k, "same text", "en", "a") for k in range(400)])
    counts = Counter(r["shard"] for r in sharding.kd_shards(rows, 5).collect())
    assert set(counts) == set(range(5)) and max(counts.values()) <= 84


def test_decontamination(spark, odd):
    item = "The Quick brown fox jumps over the lazy dog near a river"
    words = item.split()
    rows = docs_of(spark, [(1, "x " * 4000 + item.upper() + " y" * 4000, "en", "a"), (2, " ".join(words[:9]), "en", "a"), (3, "nothing here", "en", "a"), (4, None, "en", "a"), (5, "two words", "en", "a")])
    items = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "two words"), (13, item)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(rows, items).collect()}
    assert found == {(1, 9), (1, 13), (5, 12)}
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(rows, items).collect()) == [2, 3, 4]
    # Items of one to four words are found inside longer documents too.
    short = spark.createDataFrame([(1, "alpha beta gamma"), (2, "two words"), (3, "omega")], "item_id long, text string")
    texts = docs_of(spark, [(1, "so Alpha, beta gamma it is, in a longer text", "en", "a"), (2, "alpha beta gamma", "en", "a"), (3, "beta gamma alpha", "en", "a"), (4, "a omega", "en", "a"), (5, "these two words and omega then", "en", "a"), (6, "two", "en", "a")])
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(texts, short).collect()} == {(1, 1), (2, 1), (4, 3), (5, 2), (5, 3)}
    assert decontamination.contained_items(odd.limit(0), items).count() == 0


def test_jaccard_join(spark, odd):
    rng = random.Random(3)
    words = [f"t{k}" for k in range(3000)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
            rows.append((k, " ".join(copy), "en", "a"))
            k += 1

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t, _, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(docs_of(spark, rows)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    seen = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_join.similar_components(odd).collect())
    assert seen == [(0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 19996, 5), (6, 19996, 5), (7, 1, 4), (8, 2, 8), (8, 2, 8)]


def linked(rows):
    """doc_id to the least doc_id it is linked with, by comparing all pairs of different sets."""
    sets = {}
    for i, text, _, _ in rows:
        w = text.split()
        sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), []).append(i)
    parent = {s: s for s in sets}

    def find(s):
        return s if parent[s] == s else find(parent[s])

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(a), find(b)), key=lambda s: min(sets[s]))
            parent[y] = x
    return {i: min(sets[find(s)]) for s, ids in sets.items() for i in ids}


@pytest.mark.parametrize("counts", [None, 40, 1 << 20])
def test_jaccard_join_of_uneven_match_numbers(spark, monkeypatch, counts):
    """A set that asks for more matches than its partner: appended and truncated copies, sketch cells full, many copies of one side."""
    rng = random.Random(11)
    texts = []
    for n in range(4, 101, 2):
        words = [f"n{n}k{k}" for k in range(n + 4)]
        added = [f"n{n}a{k}" for k in range(rng.randint(1, n // 4 or 1))]
        texts += [words, words + added if n % 4 else words[: len(words) - len(added)]]
    if counts:  # what the pairs share is frequent
        real = jaccard_join.frequencies
        monkeypatch.setattr(jaccard_join, "frequencies", lambda signed: np.where(real(signed) > 1, counts, 1).astype(np.uint32))
    else:
        texts += [texts[40]] * 1000 + [texts[81]] * 1000
    if counts != 40:  # several parts, several packs a task; shingles counted so often are taken for frequent
        monkeypatch.setattr(jaccard_join, "PART_BYTES", 4000)
        monkeypatch.setattr(jaccard_join, "PACKED_BYTES", 5000)
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(docs_of(spark, rows)).collect()}
    assert got == linked(rows)


def test_jaccard_join_of_ids_with_several_texts(spark):
    """A class is verified on a text of its own, whichever text of its doc_id is read first."""
    rows = []
    for i in range(8):
        text = [f"d{i}w{k}" for k in range(40)]
        both = [(i, " ".join(text), "en", "a"), (i, f"d{i} has another text of other words", "en", "a")]
        rows += [*both[:: 1 if i % 2 else -1], (100 + i, " ".join([*text, "more"]), "en", "a")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.similar_components(docs_of(spark, rows).coalesce(1)).collect()}
    assert got == {(j, i) for i in range(8) for j in (i, 100 + i)}


def links_of(rows):
    """Of each row the number of other rows it is linked with, by comparing all pairs."""
    sets = []
    for _, text, _, _ in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    similar = [[bool(a) and 100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    return sorted((i if i is not None else -1, sum(own) - own[k]) for k, (own, (i, *_)) in enumerate(zip(similar, rows, strict=True)))


@pytest.mark.parametrize("tile", [3, 256])
def test_jaccard_join_counts_every_link(spark, monkeypatch, tile):
    """Links within a component count too: a chain, a group of near copies, copies, long and short sets of one component."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    rng = random.Random(5)
    texts = [[f"g{k}" if rng.random() > 0.01 else f"x{rng.random()}" for k in range(60)] for _ in range(40)]
    texts += [[f"c{k}" for k in range(4 * n, 4 * n + 90)] for n in range(12)]
    texts += [[f"s{k}" for k in range(round(20 * 1.1**n))] for n in range(15)]
    texts += [texts[0]] * 4 + [["one", "two"]] * 2 + [[]]
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]
    got = jaccard_join.similar_components(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == links_of(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["n_shingles"]} == linked(rows[:-1])


def test_jaccard_join_links_through_rows_without_ids(spark):
    """Rows without a doc_id are compared like others: two documents may be linked only through one."""
    rows = []
    for i in range(6):
        words = [f"d{i}w{k}" for k in range(120)]
        rows += [(10 + i, " ".join(words[:100]), "en", "a"), (None, " ".join(words[10:110]), "en", "a"), (20 + i, " ".join(words[20:]), "en", "a")]
    got = jaccard_join.similar_components(docs_of(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]} == {j + i: 10 + i for i in range(6) for j in (10, 20)}
    assert sorted((r["doc_id"] or -1, r["n_links"]) for r in got) == links_of(rows)


def test_shingles_ignore_batch_borders():
    import pyarrow as pa

    column = pa.array(["a B c d e f", None, "", "a b c d e f", "A b"])
    for cut in (column, column.slice(1)):
        hashes, starts = jaccard_join.shingle_sets(cut)
        assert list(np.diff(starts)) == [2, 0, 0, 2, 1][len(column) - len(cut) :]
    hashes, starts = jaccard_join.shingle_sets(column)
    assert (hashes[0:2] == hashes[2:4]).all()


def test_warc_round_trip_and_salvage(spark, tmp_path):
    body = "é<p>" + "x" * 1200
    rows = [(1, "http://a", body), (2, None, body), (3, "http://c", "short"), (4, "u", None), (5, "u", "short"), (6, "u\r\nX: y", "WARC/1.1\r\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "archive")
    warc.write_warc(pages, path)
    scanned = warc.read_warc(spark, path)
    assert warc.gaps(scanned).count() == 0
    found = {r["record_id"]: r for r in warc.records(scanned).collect()}
    assert found["<urn:page:1>"]["record_type"] == "revisit" and found["<urn:page:1>"]["refers_to_id"] == "<urn:page:2>"
    assert found["<urn:page:1>"]["payload_digest"] == hashlib.sha1(body.encode()).hexdigest()
    assert found["<urn:page:2>"]["payload"].decode() == body and found["<urn:page:4>"]["payload_bytes"] == 0


def test_warc_keeps_long_headers(spark, tmp_path):
    rows = [(1, "data:" + "x" * 200_000, "one"), (2, "http://b", "two" * 1000), (3, "data:" + "y" * 70_000, None)]
    path = str(tmp_path / "archive")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    scanned = warc.read_warc(spark, path)
    assert warc.gaps(scanned).count() == 0
    assert {r["record_id"]: len(r["target_uri"]) for r in warc.records(scanned).collect()} == {f"<urn:page:{i}>": len(u) for i, u, _ in rows}


def test_warc_checks_base32_digests():
    import base64

    def record(block, digest):
        return b"WARC/1.0\r\nWARC-Block-Digest: sha1:" + digest + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    right = base64.b32encode(hashlib.sha1(b"body").digest())
    found = list(warc.scan(record(b"body", right) + record(b"bodz", right) + record(b"body", b"unknown")))
    assert [f[0] for f in found] == ["record", "gap", "record"]
    # Many version lines, none with a whole header block: read in one pass.
    assert [f[0] for f in warc.scan(b"WARC/1.1\r\na: b\r\n" * 100_000)] == ["gap"]


def test_warc_scan_covers_every_byte():
    def record(block, name=b"1"):
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: " + name + b"\r\nWARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    import gzip

    good = [record(bytes([65 + k]) * 50, b"%d" % k) for k in range(6)]
    bad = bytearray(good[2])
    bad[-20] ^= 1
    squeezed = gzip.compress(good[4])
    torn = gzip.compress(good[3])[:-5]
    data = b"junk" + good[0] + good[1] + bytes(bad) + torn + squeezed + good[5][:60]
    found = list(warc.scan(data))
    assert [f[0] for f in found] == ["gap", "record", "record", "gap", "record", "gap"]
    assert found[0][1] == 0 and all(a[2] == b[1] for a, b in zip(found, found[1:])) and found[-1][2] == len(data)
    assert "digest" in found[3][3]


def test_bpe_equals_the_library(spark, odd):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), bpe.TrieEncoder(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabcé’sİΣ中 <|endoftext|>\n\t019!?.-_") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|startoftext|>a <|endoftext|>", "x" * 3000, "", "  a  b "]
    for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == library.decode(want, skip_special_tokens=False) == encoder.decode(want)
    assert bpe.bpe_encode(odd).count() == 10


def test_token_records(spark, odd, tmp_path):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    path = str(tmp_path / "records")
    token_records.write_records(odd, path, token_records.byte_encoder())
    index = token_records.offset_index(spark, path)
    rows = sorted(index.collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    start = 0
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    got = token_records.fetch(spark, path, index.where("doc_id = 4")).collect()
    assert got[0]["ids"] == library.encode("one two", add_special_tokens=False).ids + [0]


def test_record_checks():
    data = token_records.frame(b"12345") + b"\n"
    assert token_records.unframe(data, 0) == (len(data), b"12345")
    for k in range(len(data)):
        broken = bytearray(data)
        broken[k] ^= 4
        with pytest.raises(ValueError):
            token_records.unframe(bytes(broken), 0)


def test_base_spans_equal_the_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(text):
        out = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip":
                    fine = all(int(x) <= 255 for x in m[0].split("."))
                else:
                    fine = kind == "email" or kind == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
                if fine:
                    out.append((kind, *m.span()))
        return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))

    rng = random.Random(2)
    for alphabet in ("ab.@@-_%1234.. +()9é", "0123456789- "):
        for _ in range(8000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == brute(text)


def test_pii_adds_and_redacts(spark, odd):
    model = pii.fit(odd)
    rows = {r["doc_id"]: r for r in pii.find(odd, model).collect()}
    assert (rows[8]["n_email"], rows[8]["n_phone"], rows[2]["spans"]) == (1, 1, "")
    assert {r["text"] for r in pii.redacted(odd, model).where("doc_id = 8").collect()} == {"mail me [EMAIL] [PHONE]"}
    assert pii.find(odd.limit(0), pii.fit(odd.limit(0))).count() == 0


def test_pii_spans_whole_secrets():
    class Sure(pii.Model):
        def probability(self, row):
            return 1.0

    body = "".join(random.Random(4).choice("abcdefXYZ_-.") + "7k" for _ in range(667))[:2000]
    for text, want in (
        (f"token = {body} end", "[SECRET] end"),
        (f'api_key: "{body}", next', "[SECRET], next"),
        ("see ghp_" + "aB3" * 700 + " end", "see [SECRET] end"),
        (f"password={body}+me@mail.example.com/{body} end", "[SECRET] end"),
        (f"password={body} me@mail.example.com", "[SECRET] [EMAIL]"),
    ):
        assert pii.redact(text, Sure()) == want


def test_segments_equal_recursion():
    """All maximal segments by definition: the best one, then the same on either side of it."""

    def by_definition(s, base=0):
        best = max(((round(sum(s[a:b]), 6), -(b - a), -a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        a, b = -best[2], best[3]
        return [*by_definition(s[:a], base), (base + a, base + b), *by_definition(s[b:], base + b)]

    rng = random.Random(7)
    for _ in range(300):
        s = [rng.uniform(-3, 2) for _ in range(rng.randint(0, 14))]
        assert [x[:2] for x in toxicity.segments(np.array(s))] == by_definition(s)


def test_toxicity(spark, odd):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice("alpha beta gamma delta eps".split()) for _ in range(40)]
        if k % 4 == 0:
            words[10] = rng.choice(("vile", "nasty"))
        rows.append((k, " ".join(words), "en", "a"))
        labels.append((k, k % 4 == 0))
    docs = docs_of(spark, rows)
    given = spark.createDataFrame([(i, int(t)) for i, t in labels], "doc_id long, toxic int")
    model = toxicity.fit(docs, given)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((scores[k] >= 0.5) == (k % 4 == 0) for k in scores)
    passage = toxicity.score(docs.where("doc_id = 4"), model).first()["passages"][0]
    assert rows[4][1][passage["start"] : passage["end"]] in ("vile", "nasty")
    assert toxicity.acceptable(docs, given).count() == 300
    assert {round(r["score"], 2) < 0.5 for r in toxicity.score(odd, toxicity.fit(odd, given.limit(0))).collect()} == {True}


def test_topk(spark):
    rng = np.random.default_rng(4)
    vectors = [(int(k), [float(x) for x in rng.normal(size=12)]) for k in range(300)]
    vectors += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [1.0, 2.0]), (304, list(vectors[3][1]))]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    usable = topk.integer_vectors(frame)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(usable, usable.where("vec_id % 20 = 0"), 7).collect()]
    whole = {r["vec_id"]: r["v"] for r in usable.collect()}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        ranked = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:7]  # noqa: B905
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    assert sorted(got) == sorted(want) and 300 not in whole


def test_topk_answers_each_query_row(spark):
    """Rows that repeat a vec_id are queries of their own and each other's candidates; other columns don't matter."""
    vectors = [(0, [1.0, 0.0], "a"), (0, [0.0, 1.0], "b"), (0, [0.0, 1.0], "b"), (1, [1.0, 0.5], "c"), (3, [0.25, 2.0], "d")]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, `row` string")
    usable = topk.integer_vectors(frame)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(usable, usable.where("vec_id % 20 = 0"), 2).collect())
    one, other = [(0, 1, 1, 4096), (0, 2, 3, 1024)], [(0, 1, 3, 8192), (0, 2, 0, 4096)]
    assert got == sorted([*one, *other, *other])
    none = usable.limit(0)
    assert topk.top_k(none, none, 2).count() == 0


def test_page_text(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    forest = html_text.fit(pages)
    page = (
        '<html><body><header><h1>Site</h1></header><div class="cookie-banner">We use cookies</div><aside><p>Related stories</p></aside><main><article><h1>Title &eacute;</h1>'
        '<p>First long paragraph with <a href=x>a link</a> and words.<p>Second &lt;b&gt;<br>line<ul><li>one<li>two</ul><div class="ad">Buy now</div><form><p>Subscribe</p></form></article>'
        '<section id="comments"><h2>Comments</h2><p>Great post, I liked all of it very much</p></section></main><footer>c</footer><script>var a="<p>no</p>"</script>'
    )
    text = "Title é\nFirst long paragraph with a link and words.\nSecond <b> line\none\ntwo"
    assert html_text.extract([page, "", "plain &amp; simple"], forest) == [text, "", "plain & simple"]
    odd = spark.createDataFrame([(1, None, None), (2, "u", "<p>unclosed <b>bold")], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.main_text(odd, forest).orderBy("page_id").collect()] == ["", "unclosed bold"]
    assert html_text.main_text(odd.limit(0), html_text.fit(odd.limit(0))).count() == 0


def test_names_do_not_take_the_article_away(spark, small):
    forest = html_text.fit(spark.read.parquet(f"{small}/pages.parquet"))
    line = "This is one of the long paragraphs of the article, with a good many words in it. " * 4
    p, text = f"<p>{line}</p>", line.strip()
    bodies = {
        '<article class="news-comments-study">' + p * 3 + "</article>": 3,
        "<article>" + p + '<div class="tags-and-menu-of-the-day">' + p + "</div>" + p + "</article>": 3,
        "<article>" + p + '<section id="search-results-study">' + p + p + "</section></article>": 3,
        '<div class="story-on-related-events">' + p * 2 + "</div>": 2,
        "<main><div><div>" + p * 2 + '</div><div class="comments">' + p + "</div></div></main>": 2,
    }
    for body, n in bodies.items():
        page = f"<html><body><nav><a href=x>Home</a></nav>{body}<footer><p>Copyright</p></footer></body></html>"
        assert html_text.extract([page], forest) == ["\n".join([text] * n)], body
    assert html_text.extract([f"<article>{p}<p>where <math>x=1</math> is a <label>name</label></p></article>"], forest) == [f"{text}\nwhere x=1 is a name"]
    # Variants follow the named content, whatever its tag.
    for source in ('<body><main class="x">one<p>' + line + "</p></main>end</body>", '<body><div id=content><p>' + line + "</div>end"):
        made = html_text.variants(source, 3)
        assert len(made) == 3 and all(text in m and m.endswith(source[-3:]) and m != source for m in made[1:])


@pytest.mark.parametrize("unit", ["<div x='", "<div>", "<p><table><b><div>", "<b></i>", "<ul><li>", "<script>", "<!--", "<", "<a title=\"5\" disk\">x</a>", "</div>"])
def test_parser_is_linear(unit):
    """Eight times the page takes about eight times as long; a quadratic parser takes sixty-four."""
    import time

    def seconds(n):
        source = (unit * (n // len(unit))) + "<p>end"
        start = time.process_time()
        html_text.parse(source)
        return time.process_time() - start

    assert seconds(400_000) < 24 * max(seconds(50_000), 0.005)


def test_attribute_values_are_not_names():
    seen = ('<a href="/stories/hidden/1">one</a>', "<a href=/hidden>two</a>", '<a title="A hidden gem">three</a>', '<div data-hidden="false">four</div>', '<p data-style="display:none" title=\'hidden class="ad"\'>five</p>', '<p alt=x"y hidden" aria-hidden=false>six</p>')
    for source in seen:
        node = html_text.parse(source).nodes[1]
        assert not node.hidden and html_text._named(node) == (0, 0, 0)
        assert html_text.extract([source], None) == [re.sub("<[^>]*>", "", source)]
    for source in ("<p HIDDEN>x", '<p title="a" hidden>x', "<p hidden=''>x", "<p class=a style='Display : none'>x", '<p aria-hidden = "true">x', "<p a=1 hidden/>x"):
        assert html_text.parse(source).nodes[1].hidden
    assert html_text._named(html_text.parse('<a href="/a?id=menu" class="x" role=main>x').nodes[1]) == (0, 0, 1)
    assert html_text._named(html_text.parse('<div title="id=main" id="side-menu" class=\'post\'>x').nodes[1]) == (1, 1, 0)
