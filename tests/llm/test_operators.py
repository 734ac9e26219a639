"""The ten operators against plain versions, on texts chosen for trouble."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from sedimenta.llm import decontaminate, line_dedup, lm_score, ngram_join, quality_rules, secret_scan, substring_dedup
from sedimenta.llm.components import components


def table(df, *columns):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=key)


def same(got, expected):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert got == sorted(expected, key=key)


# 1


def test_secret_scan(spark, docs, rows, empty, odd):
    model = secret_scan.train(secret_scan.labelled_sample(docs))
    got = {r["doc_id"]: r for r in secret_scan.scan(docs, model).collect()}
    for i, t in rows:
        spans = brute.base_spans(t)
        named = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert got[i]["base_sha256"] == brute.sha(named)
        assert {s for s in named.split(",") if s} <= set(got[i]["spans"].split(","))
    assert secret_scan.scan(odd, model).count() == 9
    assert secret_scan.scan(empty, secret_scan.train(secret_scan.labelled_sample(empty))).count() == 0


def test_secret_scan_finds_what_no_pattern_names(spark, docs):
    model = secret_scan.train(secret_scan.labelled_sample(docs))
    texts = ["key Zk9QxT3vLr8WmY2uBn7JcHs5DfGp4E here", "internationalization_of_identifiers is plain", "token=short", "secret: password = abcdefghijklmnop", "😀 token = abcdefghijkl"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(df, model).collect()}
    assert got[0] == "markov:4:34" and got[1] == "" and got[2] == ""
    assert "assign" not in got[3] and not brute.base_spans(texts[3])  # a match that fails uses up its text
    assert got[4] == "assign:2:22"


def test_secret_spans_are_the_models(spark, docs, rows):
    """All spans, the models' included, against a plain version of the ratio."""
    import re

    model = secret_scan.train(secret_scan.labelled_sample(docs))
    r = random.Random(3)
    token = lambda: "".join(r.choice(secret_scan.ALPHABET) for _ in range(r.randrange(14, 40)))
    words = ["internationalization_of_names", "😀", "token=", "deadbeef" * 3, "", "AKIA" + "B7" * 8, "\n"]
    made = [(10**6 + i, " ".join(r.choice([token(), r.choice(words), token() + "é" + token()]) for _ in range(12))) for i in range(60)]
    named = []
    size = secret_scan.START + 1
    for i, t in [*rows, *made]:
        base = brute.base_spans(t)
        spans = list(base)
        for m in re.finditer(secret_scan.TOKEN, t or ""):
            at = [secret_scan.START, *map(secret_scan.ALPHABET.index, m[0])]
            ratio = sum(model[a * size + b] for a, b in zip(at, at[1:]))
            clear = ratio >= secret_scan.MIN_TOTAL and ratio >= secret_scan.MIN_STEP * len(m[0])
            if clear and not any(a <= m.start() and z >= m.end() for a, _, z in base):
                spans.append((m.start(), 3, m.end()))
        named.append((i, ",".join(f"{secret_scan.KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    same(table(secret_scan.scan(df, model), "doc_id", "spans"), named)
    assert sum("markov" in x for _, x in named) > 20


def test_secret_models_tell_held_out_strings_apart(spark, docs):
    """Accuracy on random strings and words that took no part in training."""
    model = secret_scan.train(secret_scan.labelled_sample(docs))
    r = random.Random(1)
    made = ["".join(r.choice(secret_scan.ALPHABET[:62]) for _ in range(28)) for _ in range(200)]
    plain = ["_".join(r.choice(["word", "other", "line", "panic", "brown", "quick"]) for _ in range(5)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(made + plain)), "doc_id long, text string")
    hit = {x["doc_id"] for x in secret_scan.scan(df, model).where("spans LIKE '%markov%'").collect()}
    assert sum(i in hit for i in range(200)) >= 180 and sum(i in hit for i in range(200, 400)) <= 4


# 2


@pytest.mark.parametrize("size", [50, 7, 2])
def test_substring(docs, rows, size):
    got = substring_dedup.remove_repeats(docs, size=size)
    same(table(got, "doc_id", "n_words", "n_removed", "kept_sha256"), brute.substring(rows, size))
    for r in got.where("kept IS NOT NULL").collect():
        assert brute.sha(r["kept"]) == r["kept_sha256"]


def test_substring_odd_rows(odd, empty, docs, rows):
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    same(table(substring_dedup.remove_repeats(odd, size=5, with_text=False)), brute.substring(plain, 5))
    assert substring_dedup.remove_repeats(empty).count() == 0
    same(table(substring_dedup.remove_repeats(docs, size=20, with_text=False, broadcast_ids=0)), brute.substring(rows, 20))


@pytest.mark.parametrize("size,start", [(6, 1), (6, 13), (21, 2), (40, 3)])
def test_substring_random(spark, size, start):
    """From one to four levels, repeats of all lengths around the window's; the largest id is a number like others."""
    r = random.Random(4)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(0, 80))) for _ in range(40)]
    texts += [" ".join(t.split(" ")[r.randrange(5) : r.randrange(20, 70)] + [r.choice("abc") for _ in range(30)]) for t in texts]
    rows = [(2**63 - 1 if i == 17 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(table(substring_dedup.remove_repeats(df, size=size, with_text=False, start=start)), brute.substring(rows, size))


def test_repeat_levels(spark):
    """Reported lengths are repeated, and no repeat is four times as long."""
    r = random.Random(6)
    word = lambda: f"w{r.randrange(5000)}"
    base = [word() for _ in range(400)]
    texts = [" ".join([word() for _ in range(r.randrange(40))] + base[a : a + n] + [word() for _ in range(r.randrange(40))]) for n in (0, 2, 5, 11, 30, 70, 150, 300) for a in (0, 50)]
    got = {x["doc_id"]: x["length"] for x in substring_dedup.repeat_levels(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), start=3).collect()}
    for i, t in enumerate(texts):
        w, others = t.split(" "), [f" {o} " for j, o in enumerate(texts) if j != i]
        has = lambda n: any(f" {' '.join(w[p : p + n])} " in o for o in others for p in range(len(w) - n + 1)) if n <= len(w) else False
        assert got[i] == 0 or has(got[i])
        assert not has(4 * max(got[i], 1.5).__ceil__())
    assert max(got.values()) >= 96


# 3


def test_lines(docs, rows, empty, odd):
    same(table(line_dedup.line_report(docs)), brute.lines(rows))
    for most in (0, 1000):
        kept = line_dedup.without_repeats(docs, broadcast_ids=most).collect()
        own = {r["doc_id"]: r for r in docs.collect()}
        assert len(kept) == len(own) and all(r["row"] == own[r["row"]["doc_id"]] for r in kept)
        got = [(r["row"]["doc_id"], r["n_lines"], r["n_removed"], None if r["kept"] is None else brute.sha(r["kept"])) for r in kept]
        assert sorted(got) == sorted(brute.lines(rows))
    assert line_dedup.line_report(empty).count() == 0
    assert line_dedup.line_report(odd).count() == 9


@pytest.mark.parametrize("run", [1, 2, 3, 4])
def test_lines_random(spark, run):
    r = random.Random(run)
    texts = ["\n".join(r.choice("abcd") for _ in range(r.randrange(1, 30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    same(table(line_dedup.line_report(df, min_lines=run)), brute.lines(list(enumerate(texts)), run))


@pytest.mark.parametrize("size", [1, 2, 3])
def test_suffix_prefixes(spark, size):
    """lcp is the largest of size, 2 size, 4 size, ... lines shared with an earlier suffix."""
    r = random.Random(9)
    texts = [[r.choice("ab") for _ in range(24)] for _ in range(6)]
    rows = [(False, s, 0, i, int("".join(str(ord(x)) for x in t[i : i + size])), 0, [ord(x) for x in t[i : i + size]]) for s, t in enumerate(texts) for i in range(25 - size)]
    windows = spark.createDataFrame(rows, "nul boolean, id long, t1 long, i int, w1 long, w2 long, ids array<long>")
    got = {(x["id"], x["i"]): x["lcp"] for x in line_dedup.repeated_suffixes(windows, size).collect()}
    for s, t in enumerate(texts):
        for i in range(24):
            best = 0
            for s2 in range(s + 1):
                for j in range(24):
                    if (s2, j) < (s, i):
                        n = 0
                        while i + n < 24 and j + n < 24 and t[i + n] == texts[s2][j + n]:
                            n += 1
                        best = max(best, n)
            assert got.get((s, i), 0) == (size << (best // size).bit_length() - 1 if best >= size else 0)


def test_runs_come_from_lcp(spark, monkeypatch):
    """What goes is the union of [i, i + lcp): with every lcp cut to one line less goes."""
    line = [f"line {i}" for i in range(40)]
    docs = spark.createDataFrame([(0, "\n".join(line)), (1, "\n".join(["new", *line[3:20], "end"]))], "doc_id long, text string")
    assert table(line_dedup.line_report(docs), "doc_id", "n_removed") == [(0, 0), (1, 17)]
    real = line_dedup.repeated_suffixes
    monkeypatch.setattr(line_dedup, "repeated_suffixes", lambda w, n: real(w, n).withColumn("lcp", F.lit(1)))
    assert table(line_dedup.line_report(docs), "doc_id", "n_removed") == [(0, 0), (1, 16)]


def test_scan(spark):
    r = random.Random(2)
    for n in (0, 1, 2, 3, 7, 8, 9, 100):
        x = [r.randrange(100) for _ in range(n)]
        got = spark.createDataFrame([(x,)], "x array<int>").select(quality_rules.scan(F.col("x"), F.greatest), quality_rules.scan(F.col("x"), lambda a, b: a + b)).first()
        assert list(got[0]) == [max(x[: i + 1]) for i in range(n)] and list(got[1]) == [sum(x[: i + 1]) for i in range(n)]


# 4


def test_contamination(spark, docs, rows, empty, odd):
    items = [(0, "word3 word4, Word5 word6 word7 word8 word9 word10 word11 word12 word13"), (10, "quick BROWN"), (2, "line 3 of a page"), (3, ""), (None, "don t panic"), (4, "word3 word4, Word5 word6 word7 word8 word9 word10 word11 word12")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1000, 0):
        same(table(decontaminate.contamination(docs, bench, broadcast_windows=most)), brute.contaminated(rows, items))
        plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
        same(table(decontaminate.contamination(odd, bench, broadcast_windows=most)), brute.contaminated(plain, items))
        assert decontaminate.contamination(empty, bench, broadcast_windows=most).count() == 0
    none = bench.where("false")
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {x[0] for x in brute.contaminated(rows, items) if not x[5]}


@pytest.mark.parametrize("most", [10_000, 0])
def test_contamination_random(spark, most):
    """Every shared span of ten words is found, whatever stands around it."""
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = [(i, text(r.randrange(0, 25))) for i in range(12)]
    rows = [(i, text(r.randrange(0, 120))) for i in range(60)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    same(table(decontaminate.contamination(d, b, broadcast_windows=most)), brute.contaminated(rows, items))


@pytest.mark.parametrize("most", [10_000, 0])
def test_contamination_hot_window(spark, most):
    """A window that all items have is one row of the benchmark, and documents still list all items."""
    hot = "a window of ten words that all items have in common"
    items = [(i, f"{hot} and item {i} has words of its own number {i}") for i in range(60)]
    rows = [(i, f"before {hot} after" if i % 2 else f"nothing {i}") for i in range(40)] + [(40, items[7][1])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    same(table(decontaminate.contamination(d, b, broadcast_windows=most)), brute.contaminated(rows, items))


# 5


def test_quality(docs, rows, empty, odd):
    got = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    for i, t in rows:
        n, chars, symbols, dup, again = brute.quality(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, again), i
        assert r["base_failed"] == (n < 20 or 100 * again > 30 * n)
        assert r["kept"] == brute.good(t, quality_rules)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.judged(empty).count() == 0 and quality_rules.judged(odd).count() == 9


def test_quality_of_letters_and_ellipses(spark):
    texts = ["1 2 3 4 " * 5 + "a b c d " * k for k in (1, 4, 5, 6)] + ["\n".join(f"line {i} of words{'...' if i < k else ''} \t" for i in range(10)) for k in (2, 3, 4)] + ["wait\u2026 no\nlast line\u2026 \n" + "w " * 20]
    texts = [t + " " + " ".join(f"own{i}x{j}" if i > 3 else f"{j}{i}9" for j in range(9)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute.good(t, quality_rules) for i, t in enumerate(texts)} and len(set(got.values())) == 2


def test_sample_is_bounded(spark):
    """Neither nulls nor a text of a third of the rows fill the sample."""
    from sedimenta.llm.shared import about

    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("text "), "id")).when(F.col("id") % 3 == 2, "hot").alias("text"))
    for columns in (["text"], ["doc_id", "text"]):
        sample = about(df, 500, columns)
        assert sample.columns == columns and 0 < sample.count() <= 1000
        assert sample.where("text = 'hot'").count() < 600 and sample.where("text IS NULL").count() < 2


def test_quality_order_is_stable(spark):
    """Cheap rules that reject much come first, time after time."""
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(r.choice((10, 400, 900)))) + (" said twice over" * 200 if i % 9 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    rules = quality_rules.default_rules(F.col("text"))
    seen = [[x.name for x in quality_rules.order_rules(df, rules, id_col="doc_id")] for _ in range(5)]
    assert all(x == seen[0] for x in seen), seen
    assert seen[0].index("few_words") < seen[0].index("repeats")


def test_cascade_skips_later_rules(spark):
    """A rule is not evaluated for rows that an earlier one rejects."""
    boom = F.raise_error(F.lit("evaluated")).cast("boolean")
    rules = [quality_rules.Rule("all", F.col("text").isNotNull()), quality_rules.Rule("boom", boom)]
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert df.select(quality_rules.cascade(rules)).first()[0] == "all"


def test_quality_order_changes_nothing(docs):
    rules = quality_rules.default_rules(F.col("text"))
    sets = {frozenset(r["doc_id"] for r in docs.where(quality_rules.cascade(x).isNull()).collect()) for x in (rules, rules[::-1])}
    assert len(sets) == 1
    assert {r.name for r in quality_rules.order_rules(docs, rules)} == {r.name for r in rules}


# 7


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(140)]
    up = list(range(200))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_join(docs, rows, empty, odd):
    same(table(ngram_join.jaccard_components(docs)), brute.components(rows))
    big = 2**63 - 1
    ends = docs.select(F.when(F.col("doc_id") == 4, big).when(F.col("doc_id") > 4, F.col("doc_id")).alias("doc_id"), "text")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(ends).collect()}
    assert (big, 5) in got and not any(c == big for _, c in got)
    assert ngram_join.jaccard_components(empty).count() == 0
    got = table(ngram_join.jaccard_components(odd), "doc_id", "component_id")
    assert got.count((1, 1)) == 3 and got.count((2, 1)) == 2 and got.count((3, 1)) == 1 and (None, 1) in got and got.count((None, None)) == 2


@pytest.mark.parametrize("percent,n", [(85, 4), (80, 5), (50, 1), (100, 2)])
def test_join_random(spark, percent, n, monkeypatch):
    monkeypatch.setattr(ngram_join, "CUT_ROWS", 7)  # blocks are cut, and cuts meet pairwise
    r = random.Random(percent)
    bases = [[r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("abcdefg") for _ in range(r.randrange(1, 90))] for _ in range(8)]
    rows = []
    for i in range(150):
        w = list(r.choice(bases))
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = r.choice("xyz")
        rows.append((i, " ".join(w[r.randrange(0, 3) :])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same(table(ngram_join.jaccard_components(df, n=n, percent=percent)), brute.components(rows, n, percent))


def test_join_common_passage(spark, monkeypatch):
    """A passage that many texts share puts no two of them into one block; near copies still link."""
    r = random.Random(5)
    words = lambda k: ["".join(r.choices("abcdefghij", k=6)) for _ in range(k)]
    passage, seen, keep = words(100), {}, ngram_join.written
    rows = [(i, " ".join(words(160) + passage)) for i in range(200)]
    rows.append((200, rows[7][1] + " end"))
    monkeypatch.setattr(ngram_join, "written", lambda df, what: seen.setdefault(what, keep(df, what)))
    same(table(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))), brute.components(rows))
    assert seen["rows"].count() == 2


# 9


@pytest.mark.parametrize("share", [lm_score.MIN_SHARE, 0.002])
def test_lm_counts(docs, rows, share, empty, odd):
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs, min_share=share).collect()}
    for i, held, n, known, total, base in brute.unigram(rows):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert lm_score.score_documents(empty).count() == 0
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    key = lambda x: (str(x[0]), x[2], x[3])
    got = sorted(([r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")] for r in lm_score.score_documents(odd).collect()), key=key)
    assert got == sorted(([*x[:5]] for x in brute.unigram(plain)), key=key)


def test_lm_learns(spark):
    """Where words depend on those before, held-out texts are more likely than under counts alone."""
    r = random.Random(2)
    after = {w: [r.choice("abcdefghijklmnop") for _ in range(2)] for w in "abcdefghijklmnop"}
    rows = []
    for i in range(400):
        w = [r.choice("abcdefghijklmnop")]
        while len(w) < 120:
            w.append(r.choice(after[w[-1]]))
        rows.append((i, " ".join(w)))
    got = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.3


def test_lm_scores_are_the_model(spark):
    """``score`` is the sum, token by token, of the formula over the model's two softmaxes, for words in the table and others."""
    import math

    import numpy as np
    import pyarrow as pa

    r = random.Random(7)
    texts = [" ".join(r.choice(["the", "of", "and", f"rare{r.randrange(300)}"]) for _ in range(r.randrange(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model, counts, _ = lm_score.fit(df, min_share=0.01)
    packed = np.concatenate([np.frombuffer(x["packed"], np.uint64).reshape(-1, 2) for x in counts.collect()])
    count = dict(packed.tolist())
    assert 0 < len(model.words) < len(count)
    mass, kinds = np.zeros(256), np.zeros(256)
    cell_of = {}
    for h, c in count.items():
        cell_of[h] = int(model.cells(np.array([h], np.uint64))[1][0])
        mass[cell_of[h]] += c
        kinds[cell_of[h]] += 1
    got = {x["doc_id"]: x["score"] for x in lm_score.score_documents(df, min_share=0.01).collect()}
    m32 = lambda x: int(lm_score.mix(np.array([x % 2**64], np.uint64))[0])
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for i, t in enumerate(texts):
        ((_, _, tokens, _),) = lm_score._tokens(pa.array([t]))
        total, seq = 0.0, [0, 0, *tokens.tolist()]
        for two, one, h in zip(seq, seq[1:], seq[2:]):
            features = [m32(one + 1), m32(((one * 3) % 2**64) ^ m32(two + 2)), m32(two + 5)]
            cell = cell_of.get(h, 240 + (h >> 60))
            k = cell >> 4
            top = 64 - model.bits
            p = soft(sum(model.weights[0][f >> top].astype(float) for f in features) + model.class_prior)
            q = soft(sum(model.weights[1][m32(f + k * 0x9E3779B97F4A7C15) >> top].astype(float) for f in features) + model.bucket_prior[k])
            total += math.log10(p[k] * q[cell & 15] * (count.get(h, 0) + 1) / (mass[cell] + kinds[cell] + 1))
        assert got[i] == pytest.approx(total, rel=1e-4)


def test_lm_grows(spark):
    """Rows of weights grow with the training tokens, and the table holds words by their share alone."""
    import numpy as np

    sizes = [lm_score.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(16, np.int64), np.zeros(16, np.int64), n, 0).weights.shape[1] for n in (0, 10**6, 4 * 10**6, 10**8, 10**12)]
    assert sizes == [1 << 14, 1 << 14, 1 << 15, 1 << 17, 1 << 17]


def test_lm_shares_add_up(spark):
    """Over all words of the vocabulary and one unknown a cell, a context's probabilities sum to one."""
    import numpy as np

    rows = [(i, "a b c d e f g " * 5) for i in range(20)]
    model, _, _ = lm_score.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    total = 0.0
    unseen = set(range(256))
    context = model.words[:2]
    for cell in range(256):
        tokens = np.array([*context, context[0]], np.uint64)
        share = 10 ** model.score(tokens, np.array([0, 3]), np.array([0, 0, cell]))[2]
        inside = model.counts[model.cell == cell].astype(float)
        total += share * ((inside + 1).sum() + 1)
        unseen.discard(cell)
    assert total == pytest.approx(1.0, rel=1e-3) and not unseen
