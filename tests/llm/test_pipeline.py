"""The pipeline against a plain version of its stages, and what its stages keep."""

import pytest

import brute

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sedimenta.llm import quality_rules  # noqa: E402

PROSE = [" ".join(f"p{d}w{i}" for i in range(60)) for d in range(6)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    near = PROSE[0].replace("p0w30", "changed")
    texts = [
        *PROSE, PROSE[0], near, "\n".join(PROSE[1:3]), "\n".join([*PROSE[1:3], "a line of its own that is new and has some more words in it than the others before it had"]),
        "too short", "# $ % & " * 30, "said twice over " * 40, None, "", f"{PROSE[4]} {PROSE[5]} leaked words of the benchmark item are here now and nobody knows why it is so",
    ]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(7, "leaked words of the benchmark item are here now and nobody knows")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def plain(rows, items):
    import tiktoken

    from sedimenta.llm import byte_bpe

    rows = [(i, t) for i, t in rows if brute.good(t, quality_rules)]
    gone = {i: (n, cut) for i, n, cut, _ in brute.lines(rows)}
    digests = {i: d for i, _, _, d in brute.lines(rows)}
    kept = []
    for i, t in rows:
        n, cut = gone[i]
        if cut < n or not cut:
            x = t.split("\n")
            if cut:  # the lines left are those whose digest the report has
                import itertools

                x = next(list(c) for c in itertools.combinations(x, n - cut) if brute.sha("\n".join(c)) == digests[i])
            kept.append((i, "\n".join(x)))
    same = {i: c for i, _, c, _ in brute.components(kept)}
    kept = [(i, t) for i, t in kept if same[i] == i]
    bad = {x[0] for x in brute.contaminated(kept, items) if x[5]}
    import public_tokenizers

    c = byte_bpe.codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    out = []
    for i, t in kept:
        if i not in bad:
            ids = library.encode_ordinary(t)
            out.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t)))
    return sorted(out)


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == plain(rows, items)
    assert {g[0] for g in got} == {0, 1, 2, 3, 4, 5, 8, 9}


def test_stages_keep_columns_and_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
        assert {1, 2, 3, 4, 5} <= {r["doc_id"] for r in now.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())


def test_stages_on_odd_rows(spark, folder, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, empty):
            n = stage(spark, df, folder).count()
            assert n <= df.count(), name
    kept = corpus_pipeline.near_stage(spark, odd, folder)
    assert sorted(len(r["text"]) for r in kept.where("doc_id = 1").collect()) == sorted({len(r["text"]) for r in odd.where("doc_id = 1").collect()})
    assert kept.where("doc_id IN (2, 3)").count() == 0


def test_stages_on_clashing_columns(spark, folder, docs):
    """No stage trips over columns named like its own, or changes one."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        own = {r["doc_id"]: r for r in docs.collect()}
        for r in got.collect():
            for c in docs.columns:
                if name != "line_dedup" or c != "text":
                    assert r[c] == own[r["doc_id"]][c], (name, c)
    assert corpus_pipeline.token_stage(spark, docs, folder).count() == docs.count()


def test_near_copies_of_five_words(spark, folder):
    """Near copies of 5-word Jaccard 0.8 to 0.85, that 4-word shingles at 85 % do not link, lose all but the first."""
    words = [f"n{i}w" for i in range(100)]
    two = ["changed" if i in (30, 70) else w for i, w in enumerate(words)]
    three = ["other" if i in (20, 50, 80) else w for i, w in enumerate(words)]
    added = [*words[:50], *(f"passage{i}" for i in range(14)), *words[50:]]
    rows = [(i, " ".join(x), "en", "src", len(" ".join(x))) for i, x in enumerate((words, two, three, added))]
    alike = lambda x, y, n: (lambda a, b: len(a & b) / len(a | b))(*({tuple(z[i : i + n]) for i in range(len(z) - n + 1)} for z in (x, y)))
    for x in (two, added):
        assert 0.8 <= alike(words, x, 5) < 0.85 and alike(words, x, 4) < 0.85
    assert alike(words, three, 5) < 0.8
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{folder}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert sorted(r["doc_id"] for r in docs.collect()) == [0, 2]


def test_long_single_lines(spark, folder):
    """Later copies of lines of 50 words go without a neighbour; shorter ones stay."""
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    a, b, c = line("a", 50), line("b", 49), line("c", 70)
    texts = [f"x\n{a}\ny", f"{b}\nz", f"u\n{a}\nv", a, f"{b}\nw", c, c, f"p\n{c}\nq\n{c}\nx\n{a}", f"{c}\n{a}"]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{folder}/documents.parquet").schema).repartition(2)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, folder).collect()}
    # the last one would have no line left
    assert got == {0: texts[0], 1: texts[1], 2: "u\nv", 4: texts[4], 5: c, 7: "p\nq", 8: texts[8]}
