"""Tokenizer operators against the libraries, on texts and on random strings."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute

public_tokenizers = pytest.importorskip("public_tokenizers")

from sedimenta.llm import byte_bpe, token_counts, token_store  # noqa: E402
from sedimenta.llm.shared import new_path  # noqa: E402

ALPHABET = [" ", "  ", "\n", "\t", "a", "B", "é", "'s", "'ll", "'", "1", "22", "!", "<|endoftext|>", "<|", " ", "　", "the", "ñ", "日本", "aaaa", "\x1c", "\x85", "  \n ", "Ünder", "İ", "ß", "Σ", "ΣΑΣ", "don't", "́", "😀", "tion", "ا", "لعربية", "Ещё", "и̂", "각", "각", "한국", "क़ि", "ệ", "ở", "ṩ̇"]


def strings(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    c = byte_bpe.codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    return c, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_bpe(spark, bpe, docs, rows, empty, odd):
    c, library = bpe
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    got = {r["doc_id"]: r for r in byte_bpe.encode_report(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert tuple(got[i])[1:] == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or ""))
    encoded = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: library.encode_ordinary(t or "") for i, t in rows}
    back = byte_bpe.decode_documents(encoded, path, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in back.collect()} == {i: (t or "").encode() for i, t in rows}
    assert byte_bpe.encode_report(empty, path, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encode_report(odd, path, public_tokenizers.PATTERN).count() == 9


def test_bpe_random(bpe):
    c, library = bpe
    texts = strings(3000)
    assert list(c.encode_column(pa.array(texts))) == [library.encode_ordinary(t) for t in texts]
    assert [c.encode(t) for t in texts] == [library.encode_ordinary(t) for t in texts]
    long = "ab" * 30_000 + "a" * 50_000
    assert c.merge(long.encode()) == library.encode_ordinary(long)
    assert not any(c.words)


def test_counts(spark, docs, rows, empty, odd):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library = token_counts.counter(path).library
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(docs, path, limit=100).collect()}
    for i, t in rows:
        t = t or ""
        fits = got[i][3]
        assert got[i][:3] == (len(t.encode()), n(t), n(t) > 100)
        assert n(t[:fits]) <= 100 and (fits == len(t) or n(t[: fits + 1]) > 100)
    assert token_counts.count_tokens(empty, path).count() == 0 and token_counts.count_tokens(odd, path).count() == 9


def test_counts_of_every_prefix(rows):
    c = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    n = lambda t: len(c.library.encode(t, add_special_tokens=False).ids)
    for t in [*strings(800, 2), *(t[:300] for _, t in rows if t)]:
        assert c.prefix_counts(t) == [n(t[:i]) for i in range(len(t) + 1)]
        assert c.count(t) == n(t)


def test_long_unspaced_texts_take_linear_time():
    import time

    c = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    c.prefix_counts("é日本")
    for text in ("".join(chr(0x4E00 + i * 37 % 20000) for i in range(20_000)), "ệо̂" * 5000):
        c.count(text[:100])
        began = time.process_time()
        out = c.prefix_counts(text)
        assert time.process_time() - began < 4
        for i in (1, 77, 999, len(text)):
            assert out[i] == len(c.library.encode(text[:i], add_special_tokens=False).ids)


def test_stored_prefixes(spark, docs, rows):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library = token_counts.counter(path).library
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    stored = token_counts.prefix_tables(docs, path)
    for r in stored.collect():
        t = dict(rows)[r["doc_id"]] or ""
        assert r["chars"][0] == r["tokens"][0] == 0 and r["chars"][-1] == len(t)
        for i in range(0, len(r["chars"]), max(1, len(r["chars"]) // 20)):
            assert r["tokens"][i] == n(t[: r["chars"][i]])
    for r in token_counts.cut_at(stored, 50).collect():
        t = dict(rows)[r["doc_id"]] or ""
        assert r["n_tokens"] == n(t) and n(t[: r["fits_chars"]]) <= 50


def test_store(spark, docs, rows, empty, odd):
    path = public_tokenizers.path(token_store.VOCABULARY)
    library = token_store.encoder(path).library
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, token_store.END_ID]
    uri = new_path(spark, "tokens")
    token_store.write(docs, uri, path)
    at, reader = 0, token_store.Reader(uri)
    got = sorted(tuple(r) for r in token_store.read(spark, uri).collect())
    assert sorted(tuple(r)[3] for r in token_store.read(spark, uri, digest_only=True).collect()) == sorted(zlib.crc32(np.array(ids(t), "<u4").tobytes()) for _, t in rows)
    for (i, t), g in zip(rows, got, strict=True):
        assert g == (i, at, len(ids(t)), ids(t))
        assert reader.get(i).tolist() == ids(t)
        at += len(ids(t))
    assert all(reader.get(k) is None for k in range(1000, 3000))
    uri = new_path(spark, "tokens")
    token_store.write(odd, uri, path)
    got = [tuple(r) for r in token_store.read(spark, uri).orderBy("start").collect()]
    assert [g[0] for g in got] == [1, 1, 1, 2, 2, 3, None, None, None]
    assert [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1]]
    for i, texts in {1: 3, 2: 2, 3: 1, None: 3}.items():
        assert sorted(g[3] for g in got if g[0] == i) == sorted(ids(r["text"]) for r in odd.where(F.col("doc_id").eqNullSafe(i)).collect()) and texts
    assert token_store.Reader(uri).get(None).tolist() == ids(None)
    uri = new_path(spark, "tokens")
    token_store.write(empty, uri, path)
    assert token_store.read(spark, uri).count() == 0 and token_store.Reader(uri).get(1) is None


def test_store_reads_through_its_index(spark, docs, rows):
    """Rows follow what the index says; keys that it does not have are an error."""
    path = public_tokenizers.path(token_store.VOCABULARY)
    ends = docs.select(F.when(F.col("doc_id") == 5, 2**63 - 1).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    uri = new_path(spark, "tokens")
    token_store.write(ends, uri, path)
    good = {r["doc_id"]: tuple(r) for r in token_store.read(spark, uri, digest_only=True).collect()}
    assert len(good) == len(rows) and 2**63 - 1 in good and token_store.Reader(uri).get(None) is None
    raw = token_store.fetch(f"{uri}/index-000000.mph")
    h, slots = token_store.open_bucket(raw)
    wrong = slots.copy()
    i = int(np.argmax(wrong["ids"]))
    wrong["ids"][i] -= 1
    token_store.put(f"{uri}/index-000000.mph", iter([raw[: len(raw) - slots.nbytes], wrong.tobytes()]))
    bad = {r["doc_id"]: tuple(r) for r in token_store.read(spark, uri, digest_only=True).collect()}
    assert sum(bad[k] != good[k] for k in good) == 1
    wrong["print"][0] ^= 1
    token_store.put(f"{uri}/index-000000.mph", iter([raw[: len(raw) - slots.nbytes], wrong.tobytes()]))
    with pytest.raises(Exception, match="index does not have"):
        token_store.read(spark, uri, digest_only=True).collect()


def test_store_random():
    e = token_store.encoder(public_tokenizers.path(token_store.VOCABULARY))
    texts = strings(3000)
    found = []
    for ids, count in e.encode(pa.array(texts)):
        found += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    assert found == [[*x.ids, 0] for x in e.library.encode_batch(texts, add_special_tokens=False)]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_structured_strings_are_told_apart(spark, bpe, n):
    """Strings that every polynomial modulo a power of two confuses: as words, as texts of words, and between other words."""
    from sedimenta.llm import decontaminate, lm_score, ngram_join, substring_dedup

    one = thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    named = {"a": "yes", "b": "no"}
    pairs = [(one, two), (" ".join(one), " ".join(two)), (" ".join(f"u{i} {named[c]}" for i, c in enumerate(one)), " ".join(f"u{i} {named[c]}" for i, c in enumerate(two)))]
    texts = [t for p in pairs for t in p]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    key = lambda r: tuple(map(str, r))
    got = lambda x: sorted((tuple(r) for r in x.collect()), key=key)
    assert got(substring_dedup.remove_repeats(df, with_text=False)) == sorted(brute.substring(rows), key=key)
    assert got(ngram_join.jaccard_components(df)) == sorted(brute.components(rows), key=key)
    items = spark.createDataFrame([(0, two), (1, " ".join(two[:10])), (2, texts[5])], "item_id long, text string")
    for most in (100_000, 0):
        assert got(decontaminate.contamination(df, items, broadcast_windows=most)) == sorted(brute.contaminated(rows, [tuple(r) for r in items.collect()]), key=key)
    for a, b in zip(got(lm_score.score_documents(df).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score")), sorted(brute.unigram(rows), key=key)):
        assert a[:4] == (b[0], *b[2:5]) and a[4] == pytest.approx(b[5])
    c, library = bpe
    assert list(c.encode_column(pa.array(texts))) == [library.encode_ordinary(t) for t in texts]
    e = token_store.encoder(public_tokenizers.path(token_store.VOCABULARY))
    found = [x.tolist() for ids, count in e.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(count)[:-1])]
    assert found == [[*x.ids, 0] for x in e.library.encode_batch(texts, add_special_tokens=False)]
    t = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    assert [t.count(x) for x in texts] == [len(t.library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that says nothing, pieces are still told by their bytes."""
    from sedimenta.llm import pieces

    monkeypatch.setattr(pieces, "byte_hashes", lambda data, view, lo, hi: np.zeros(len(lo), np.uint64))
    made = pieces.PieceIds(lambda raw: [np.array([*x], "<i4") for x in raw], "<i4")
    texts = ["a b c a", "", "b c d " + "x" * 100, "a b", "x" * 100 + " a"]
    for _ in range(3):
        out = [x.tolist() for ids, count in made.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(count)[:-1])]
        assert out == [[*t.encode()] for t in texts]
