"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

from arbordex.llm import bpe, exact_dedup, fingerprints, language_id, lexicon, line_dedup, mixing, ngram_join, packed, sieve, substring_dedup, token_counts, url_filter  # noqa: E402
from arbordex.llm.components import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "a", "\n\n", "<|endoftext|> x", "日本語 🙂 é", "x" * 3000, "a " * 400, "\x1c\x85\u2028 z"]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with exact and near copies, shared passages, repeated lines, and odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, common = line(120), line(9)
    texts: list = list(ODD)
    for i in range(n):
        body = [line(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 8))]
        if i % 4 == 0:
            body.insert(rng.randrange(len(body) + 1), passage)
        if i % 3 == 0:
            body.insert(0, common)
        text = "\n".join(body)
        texts.append(text)
        if i % 5 == 0:
            words = text.split(" ")
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = "edit"
            texts += [" ".join(words), text, text.upper() if i % 2 else text + " "]
    return [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- language ID --------------------------------------------------------------------------------------------------------------


def test_language_id(spark, empty):
    rng = random.Random(2)
    words = {"aa": ["kala", "mata", "tika", "lima"], "bb": ["strunz", "blork", "grunt", "plomf"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 60))), lang, None, 0) for i in range(200) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(1000, None, "aa", None, 0), (1001, "12 !!", "bb", None, 0), (1002, "", None, None, 0), (1003, "漢字漢字漢字", None, None, 0), (None, "kala mata", "aa", None, 0), (1, rows[1][1], rows[1][2], None, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    model = language_id.fitted(spark, docs)
    found = language_id.predict(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "rejected"]
    got = {r.doc_id: r for r in found.collect()}
    assert all(got[i].lang_pred == rows[i][2] and not got[i].rejected and 0 < got[i].score <= 1 for i in range(200))
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert got[1003].rejected and got[None].lang_pred == "aa"
    none = language_id.fitted(spark, empty)
    assert language_id.predict(empty, none).count() == 0
    assert language_id.predict(docs, none).where("lang_pred <> 'und'").count() == 0
    held = docs.select("doc_id", language_id.held_out().alias("h")).where("doc_id IS NOT NULL").collect()
    assert all(r.h == (language_id.crc_remainder(r.doc_id) == 1) for r in held)


def test_language_id_is_the_plain_version(spark):
    """Vectors, cosines, the best centroid and rejection, for texts of all kinds; junk and foreign texts are rejected, others stay."""
    rng = random.Random(8)
    vocabulary = {lang: ["".join(rng.choice(part) for part in ("bcdfg" if lang == "aa" else "klmnp", "aeiou", "rst" if lang == "aa" else "vxz", "aeiou")) for _ in range(150)] for lang in ("aa", "bb")}
    clean = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.choice([2, 5, 20, 100, 400]))), lang, None, 0) for i in range(300) for lang in [rng.choice(["aa", "bb"])]]
    junk = [" ".join("".join(rng.choice("qwyjhk") for _ in range(rng.randrange(3, 9))) for _ in range(k)) for k in (12, 40, 200) for _ in range(10)] + ["абв где жзи клм " * 9, "漢字 仮名 交じり文 " * 20]
    odd = ["", None, "12 34", "é", "İı ﬁ ß ẞ", "a" * 300, "ba " * 5000]
    rows = clean + [(1000 + i, t, None, None, 0) for i, t in enumerate([*junk, *odd])]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fitted(spark, docs)
    assert model["limits"].shape == (2, 15) and (model["limits"] < 1).all()
    for r in language_id.predict(docs, model).collect():
        lang, score, rejected = brute.language(r.text or "", model)
        assert (r.lang_pred, r.rejected) == (lang, rejected) and r.score == pytest.approx(max(0.0, score), abs=1e-5), r.text
        if r.doc_id < 300:
            assert r.lang_pred == clean[r.doc_id][2] and not r.rejected
        elif r.doc_id < 1000 + len(junk):
            assert r.rejected
    assert (language_id.counts([t or "" for _, t, *_ in rows]).sum(1) == [sum(brute.gram_counts(t or "", language_id.BUCKETS).values()) for _, t, *_ in rows]).all()


def test_limits_of_few_texts():
    """A size without texts takes the next smaller one's limit, a language with few texts all languages' limit."""
    many = np.linspace(0.5, 1, 100), np.full(100, 40)
    got = language_id.limits([many, (np.array([0.1]), np.array([300]))])
    assert got[0, 5] == pytest.approx(language_id.KEEP * 0.505, abs=1e-3) and (got[:, 5:] == got[0, 5]).all()
    assert got[0, 3] == pytest.approx(got[0, 5] / 2)
    assert (language_id.limits([(np.zeros(0), np.zeros(0, np.int64))]) == 0).all()


def test_long_texts_are_read_whole():
    pair = "ab cd " * 300_000
    whole = language_id.counts([pair])[0]
    assert whole.sum() == 300_000 * 2 * (2 + 3 + 2) and np.count_nonzero(whole) <= 14


# --- fingerprints -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "a", "aaaaaaa", "abababab", "hello hello hello", "é🙂é🙂é"])
def test_phrases(text):
    parse = fingerprints.Parse()
    for i in range(0, len(text), 3):
        parse.feed(text[i : i + 3])
    assert parse.phrases == brute.phrases(text)


def test_fingerprints(spark, docs, rows, empty):
    got = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    assert len(got) == len(rows)
    sign = lambda t: fingerprints.fingerprints(t)[0]
    for i, (d, t, *_) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.to_string(sign(t)), fingerprints.to_string(sign(edited)))
        assert r.near_edited == fingerprints.likeness(sign(t), sign(edited)) and r.near_next == fingerprints.likeness(sign(t), sign(after))
    assert fingerprints.compare(empty).count() == 0
    one = fingerprints.compare(spark.createDataFrame([(None, "abc", None, None, 0)], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    twice = fingerprints.compare(spark.createDataFrame([(3, "b", None, None, 0), (3, "a", None, None, 0), (None, "c", None, None, 0)], DOCS)).collect()
    assert len(twice) == 3


@pytest.mark.parametrize("text", ["", "a", "hello hello hello world", "é🙂é🙂é", "ab" * 300])
def test_signature_is_the_plain_version(text):
    got = fingerprints.fingerprints(text)[0]
    assert got.tolist() == brute.signature(text, fingerprints.BINS, fingerprints.EMPTY, 0xD6E8FEB86659FD93)


def test_likeness_estimates_jaccard():
    rng = random.Random(5)
    a = [rng.choice("abcd ") for _ in range(6000)]
    b = a[:4000] + [rng.choice("abcd ") for _ in range(2000)]
    one, two = brute.phrases("".join(a)), brute.phrases("".join(b))
    got = fingerprints.likeness(fingerprints.fingerprints("".join(a))[0], fingerprints.fingerprints("".join(b))[0])
    assert abs(got - len(one & two) / len(one | two)) < 0.15
    assert (fingerprints.from_string(fingerprints.to_string(fingerprints.fingerprints("".join(a))[0])) == fingerprints.fingerprints("".join(a))[0]).all()


# --- mixing ----------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("salted", [False, True])
def test_mixing(docs, rows, empty, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = mixing.with_copies(docs).collect()
    assert len(got) == len(rows)
    size = {d: len(brute.WORD.findall(t or "")) for d, t, *_ in rows}
    held = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    target = brute.targets(held)
    for r in got:
        assert (r.mix_size, r.mix_source_size) == (size[r.doc_id], held[r.source])
        assert r.mix_target == pytest.approx(target[r.source]) and r.mix_copies == brute.taken(r.doc_id, r.mix_target / r.mix_source_size)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.mix_copies for r in got)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("size", [7, 100_000])
def test_mixing_of_many_sources(spark, monkeypatch, size):
    """Ranges of sources give what the plain version gives, with equal sizes, empty and null sources."""
    monkeypatch.setattr(mixing, "RANGE", size)
    rng = random.Random(3)
    held = {f"s{i:03}" if i else None: rng.choice([0, 1, 5, 5, 40, 900]) for i in range(80)}
    rows = spark.createDataFrame([(s, n) for s, n in held.items()], "source string, size long").repartition(5)
    got = {r.source: r for r in mixing.source_targets(rows).collect()}
    want = brute.targets(held)
    assert got.keys() == want.keys() and all(got[s].target == pytest.approx(want[s]) and got[s].source_size == held[s] for s in held)


def test_mixing_keeps_columns(spark):
    rows = [(i, "a b c", f"s{i % 2}", "q") for i in range(9)] + [(None, None, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, c string").select("doc_id", "text", "source", *[F.col("c").alias(x) for x in ("mix_size", "mix_source", "mix_copies", "of", "rate", "size", "target")])
    got = mixing.mix(docs)
    assert got.columns == docs.columns and all(set(tuple(r)[3:]) == {"q"} for r in got.collect())
    plain = mixing.mix(docs.select("doc_id", "text", "source"))
    assert table(got.select("doc_id", "text", "source")) == table(plain)


def test_long_texts_through_spark(spark):
    """A text of some million characters is mixed, fingerprinted and deduplicated whole."""
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, long, "en", "a", 0), (2, long + " ", "en", "b", 0), (3, "short", "en", "a", 0)], DOCS)
    assert {r.doc_id: r.mix_size for r in mixing.with_copies(docs).collect()} == {1: 300_000, 2: 300_000, 3: 1}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()} == {1: (2, 2), 2: (2, 2), 3: (3, 1)}
    got = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    assert got[1].n_chars == len(long) and got[1].near_next > 0.99 and got[2].edited_sha256 == hashlib.sha256(((long + " ")[: len(long) + 1 - (len(long) + 1) // 4] + "short").encode()).hexdigest()
    assert {r.doc_id: r.component_id for r in ngram_join.linked(docs).collect()} == {1: 1, 2: 1, 3: 3}


# --- BPE ----------------------------------------------------------------------------------------------------------------------------------


def test_lexicon(tmp_path):
    entries = {b"": [9], b"tap": [1], b"taps": [2, 3], b"top": [4], b"tops": [5], b"x": []}
    lexicon.compile_lexicon(entries, tmp_path / "a")
    found = lexicon.Lexicon(tmp_path / "a")
    places = found.find([*entries, b"ta", b"topss", b"y"])
    assert (places[-3:] == -1).all() and [found.output(p).tolist() for p in places[:-3]] == list(entries.values())
    assert len(found.final) == 5  # endings of tap(s) and top(s) are shared
    lexicon.compile_lexicon({}, tmp_path / "b")
    assert lexicon.Lexicon(tmp_path / "b").find([b"a"])[0] == -1


@pytest.mark.parametrize("most", [0, 50])
def test_bpe_is_the_library(docs, rows, empty, most):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    got = bpe.encode(docs.withColumn("ids", F.lit(1)), most=most, decode=True)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    for r in got.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty, decode=True).count() == 0
    for r in bpe.digest_columns(got).collect():
        assert r.n_tokens == len(library.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids)


# --- substring dedup ---------------------------------------------------------------------------------------------------------------------


def test_substring_dedup(spark, docs, rows, empty):
    got = substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert table(got) == sorted(brute.substring_dedup([r[:2] for r in rows]), key=repr)
    assert sum(r[2] for r in got.collect()) > 500
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_dedup_of_runs_and_repeated_ids(spark):
    runs = ["a " * 200, "b " + "a " * 120, "x y " * 90, "y x " * 70, "p q r " * 60, " ".join(map(str, range(300))), "z " + " ".join(map(str, range(40, 200)))]
    rows = [(i, t) for i, t in enumerate(runs)] + [(3, "w " * 60 + runs[5]), (None, runs[2]), (9, "w " * 70)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert table(got) == sorted(brute.substring_dedup(rows), key=repr)


def test_hot_symbols_are_found(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    rows = corpus(7, 40)
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS).repartition(2)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert table(got) == sorted(brute.substring_dedup([r[:2] for r in rows]), key=repr)


def test_symbols_depend_on_their_range_only():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 40, 400).astype(np.uint64)
    name, at, low, high = substring_dedup.recompress(h, np.zeros(400, np.int64))
    for _ in range(20):
        k = int(rng.integers(len(name)))
        if low[k] < 0 or high[k] > 400:
            continue
        other = rng.integers(0, 40, 100).astype(np.uint64)
        moved = np.concatenate([other[:50], h[low[k] : high[k]], other[50:]])
        name2, at2, _, _ = substring_dedup.recompress(moved, np.zeros(len(moved), np.int64))
        assert name[k] in name2[at2 == 50 + at[k] - low[k]]


# --- token counts ------------------------------------------------------------------------------------------------------------------------


def test_token_counts_are_the_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = token_counts.default_vocabulary()
    library = tokenizers.Tokenizer(tokenizers.models.Unigram([(p, float(s)) for p, s in vocabulary], unk_id=0, byte_fallback=True))
    library.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend("▁"), tokenizers.normalizers.Replace(" ", "▁")])
    got = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("clash"))).collect()
    assert [r.n_tokens for r in got] == [len(library.encode(r.text or "").ids) for r in got]
    assert token_counts.count_tokens(empty).count() == 0


def test_token_counts_with_ties():
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -0.5), ("▁a", -1.5), ("aa", -1.25)]
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, unk_id=0))
    library.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend("▁"), tokenizers.normalizers.Replace(" ", "▁")])
    counter, rng = token_counts.Counter(vocabulary), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aab z ") for _ in range(rng.randrange(1, 14)))
        assert counter.count(text) == len(library.encode(text).ids), text


# --- exact dedup --------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_dedup(spark, docs, rows, empty, monkeypatch, fan_in):
    monkeypatch.setattr(exact_dedup.exact_groups, "__defaults__", (fan_in,))
    extra = [(500, "A b", None, None, 0), (501, " A\tb", None, None, 0), (502, "Ab  ", None, None, 0), (None, "A b  ", None, None, 0), (500, "A b", None, None, 0)]
    got = exact_dedup.exact_dedup(docs.union(spark.createDataFrame(extra, DOCS)).withColumn("best", F.lit(1))).collect()
    groups: dict = {}
    for d, t, *_ in rows + extra:
        t = t or ""
        groups.setdefault(t.translate({ord(c): None for c in exact_dedup.BLANKS}), []).append((-len(t), d is None, d or 0, d))
    want = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        want += [(m[3], best[3], len(members), m[:3] == best[:3], hashlib.sha256(norm.encode()).hexdigest(), -m[0]) for m in members]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_hot_groups(spark, monkeypatch):
    """A third of all rows are copies; with verdicts by broadcast, by join, and in as many rounds as pairs of runs need, all the same."""
    rows = [(i, "same  text" if i % 3 == 0 else f"own {i // 2}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13).withColumns({c: F.lit(1) for c in ("run", "best", "rows", "norm")})
    got = []
    for hot, fan_in in ((1000, 4), (0, 2)):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        monkeypatch.setattr(exact_dedup.exact_groups, "__defaults__", (fan_in,))
        got.append(table(exact_dedup.exact_dedup(docs)))
    assert got[0] == got[1] and len(got[0]) == 600 and sum(r[2] == 200 and r[1] == 0 for r in got[0]) == 200
    plan = exact_dedup.exact_groups(exact_dedup.digests(docs), 13, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4  # 13 runs become 7, 4, 2 and 1


# --- n-gram join ----------------------------------------------------------------------------------------------------------------------------


def test_ngram_join(docs, rows, empty):
    got = ngram_join.linked(docs).select("doc_id", "n_shingles", "component_id")
    assert table(got) == sorted(brute.jaccard_components([r[:2] for r in rows]), key=repr)
    assert ngram_join.linked(empty).count() == 0


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_ngram_join_of_near_copies(spark, size, percent):
    """Chains of edits: neighbours link, ends don't; pivots alone wouldn't do."""
    rng = random.Random(4)
    rows = []
    for g in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 12, 30, 90, 300]))]
        for _ in range(25):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(len(words))] = f"e{rng.randrange(5000)}"
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).select("doc_id", "n_shingles", "component_id")
    assert table(got) == sorted(brute.jaccard_components(rows, size, percent), key=repr)


@pytest.mark.parametrize("group", [6, 4096])
def test_ngram_links(spark, docs, rows, monkeypatch, group):
    """Links between all different texts, and each row's number of them, copies included."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rng = random.Random(5)
    more, words = [], [f"w{rng.randrange(5000)}" for _ in range(80)]
    for i in range(40):
        more.append((1000 + i, " ".join(words)))
        words[rng.randrange(len(words))] = f"e{rng.randrange(5000)}"
    texts = [r[:2] for r in rows] + more + [(2000, more[3][1])]
    sets = brute.shingles([t for _, t in texts])
    want = sorted((d, len(s), sum(100 * len(s & o) >= 85 * len(s | o) and len(s & o) > 0 for j, o in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(texts, sets, strict=True)))
    got = ngram_join.link_counts(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in got.collect()) == want and max(w[2] for w in want) > 3
    assert ngram_join.link_counts(docs.limit(0)).count() == 0


def test_ngram_join_of_large_groups(spark, monkeypatch):
    """Groups dealt into parts, and blocks by broadcast or join, give the same components."""
    rng = random.Random(12)
    rows = []
    for g in range(3):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for _ in range(50):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(len(words))] = f"e{rng.randrange(5000)}"
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), sorted(brute.jaccard_components(rows), key=repr)
    for hot, group in ((0, 5), (1000, 7)):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "GROUP", group)
        assert table(ngram_join.linked(docs).select("doc_id", "n_shingles", "component_id")) == want


def test_sketch_blocks_find_every_pair():
    """Sets at the limit of the threshold share a block, whatever their sizes."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 100, 333, 1000]:
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop = max(0, len(a) - -(-85 * len(a) // 100))
        b = a[drop:]
        sets = np.concatenate([a, b])
        text = np.repeat([0, 1], [len(a), len(b)])
        owner, code = ngram_join.sketch_blocks(text, sets, np.array([len(a), len(b)]), 85)
        assert not drop or set(code[owner == 0]) & set(code[owner == 1])


def test_ngram_join_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (7, text), (7, text), (8, None), (None, ""), (9, "one two"), (10, "ONE two")]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert table(got) == sorted([(None, 4, 7), (7, 4, 7), (7, 4, 7), (8, 0, 8), (None, 0, None), (9, 1, 9), (10, 1, 9)], key=repr)


def test_one_of_each_group_stays(spark):
    """Repeated rows, null ids, equal ids with other texts, empty texts, and columns named like the operator's own."""
    text, other = "one two three four five six seven eight", "red green blue yellow pink brown grey white"
    rows = [(None, text), (7, text), (7, text), (9, text.upper()), (7, other), (8, None), (8, None), (None, ""), (None, other + " x"), (None, "solo line of five words"), (None, "solo line of five words"), (3, other + " x y z a b c d e f")]
    names = ["doc", "row", "gone", "copy", "least", "component", "class", "n_shingles"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("q").alias(c) for c in names])
    got = ngram_join.keep_one(docs.repartition(3), 5, 80)
    assert got.columns == ["doc_id", "text", *names] and all(r[c] == "q" for r in got.collect() for c in names)
    kept = sorted([(r.doc_id, r.text) for r in got.collect()], key=repr)
    alone = [(8, None), (8, None), (None, ""), (None, "solo line of five words"), rows[-1]]
    one, two = [r for r in kept if r not in alone and r[1].lower() == text], [r for r in kept if r not in alone and r[1].startswith("red")]
    assert sorted(one + two + alone, key=repr) == kept
    assert one == [(7, text)] and two in ([(7, other)], [(7, other), (None, other + " x")])
    linked_ = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert (len(two) == 1) == (linked_[(None, 5)] == 7)
    assert ngram_join.keep_one(docs.limit(0), 5, 80).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 7), (30, 31), (32, 31), (40, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 0, 30: 30, 31: 30, 32: 30}


# --- line dedup ------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [1, 3])
def test_line_dedup(docs, rows, empty, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    got = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("clash")))
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted(brute.line_dedup([r[:2] for r in rows]))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_near_lines(spark):
    rng = random.Random(9)
    rows = []
    for d in range(30):
        words = [f"w{k}" for k in range(rng.randrange(1, 30))]
        lines = []
        for _ in range(8):
            line = list(words)
            for _ in range(rng.randrange(3)):
                line[rng.randrange(len(line))] = f"x{rng.randrange(50)}"
            rng.shuffle(line)
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(brute.line_dedup(rows))


@pytest.mark.parametrize("parts", [1, 6])
def test_line_dedup_of_repeated_rows(spark, parts):
    """Of rows that repeat, one keeps its lines; equal texts of null doc_id are such rows."""
    rows = [(3, "a b c\n\nd e f\na b c")] * 3 + [(None, "g h i\nj k l")] * 2 + [(None, "m n o"), (1, "p q r\ng h i"), (1, "p q r"), (2, None), (2, None), (2, ""), (2, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    want = [(3, "a b c\n\nd e f", 4, 1), (3, "", 4, 3), (3, "", 4, 3), (None, "g h i\nj k l", 2, 0), (None, "", 2, 2), (None, "m n o", 1, 0), (2, None, 0, 0), (2, None, 0, 0), (2, "", 1, 0), (2, "", 1, 0)]
    assert [r for r in table(got) if r[0] != 1] == sorted(want, key=repr)
    ones = sorted(r.text for r in got.where("doc_id = 1").collect())
    assert ones in (["", "p q r"], ["", ""]) and "\n".join(ones).count("p q r") == 1


def test_line_dedup_of_clashing_columns_and_long_texts(spark):
    """Columns named like the operator's own are kept and change nothing; a text of a million words is read whole."""
    rng = random.Random(3)
    line = lambda k: " ".join(f"w{rng.randrange(900)}" for _ in range(k))
    texts = [line(12) for _ in range(30)]
    rows = [(i, "\n".join(rng.sample(texts, 4) + [line(9)])) for i in range(40)]
    rows += [(50, line(200_000) + "\n" + texts[0] + "\n" + "\n".join(line(8) for _ in range(100_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    names = ["doc", "row", "open", "gone", "lost", "again", "line", "words", "copy", "key"]
    got = line_dedup.dedup_lines(docs.select("*", *[(F.col("doc_id") % 3).alias(c) for c in names]))
    assert got.columns == ["doc_id", "text", *names, "n_lines", "n_removed"]
    found = got.collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert all(r[c] == r.doc_id % 3 for r in found for c in names)
    want = dict(brute.line_dedup([r for r in rows if r[0] < 50]))
    assert {r.doc_id: r.text for r in found if r.doc_id < 50} == want
    assert [r.n_lines for r in found if r.doc_id == 50] == [100_002]


def test_line_dedup_of_hot_words_and_full_filters(spark, docs, rows, monkeypatch):
    """Words dealt by size, filters that let nearly everything through, and small pieces change nothing."""
    for name, value in (("HOT", 0), ("GATHER", 50), ("PART", 100), ("_BLOCK", 7), ("NEAR", 2), ("FEW", 1)):
        monkeypatch.setattr(line_dedup, name, value)
    monkeypatch.setattr(sieve, "MOST", 1 << 12)
    monkeypatch.setattr(sieve.sieve, "__defaults__", (1 << 12,))
    assert sorted((r.doc_id, r.text or "") for r in line_dedup.dedup_lines(docs).collect()) == sorted(brute.line_dedup([r[:2] for r in rows]))


def test_sieve(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k"))
    table = sieve.sieve(keys, 1000)
    known = np.array([r.k for r in keys.collect()]).view(np.uint64)
    other = np.array([r.k for r in spark.range(1, 9000, 3).select(F.xxhash64("id").alias("k")).collect()]).view(np.uint64)
    assert sieve.passes(table, known).all() and sieve.passes(table, other).mean() < 0.05


@pytest.mark.parametrize("n", [1, 7, 211])
def test_parts_are_dealt_as_spark_does(spark, n):
    above, below = packed.deal(n)
    for tags in (above, below):
        got = spark.createDataFrame([(int(x),) for x in tags], "shard int").select(F.pmod(F.hash("shard"), F.lit(n)).alias("p")).collect()
        assert [r.p for r in got] == list(range(n))
    assert (above >= 0).all() and (below < 0).all()


# --- url filter --------------------------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = {
        "HTTP://A.example.COM/en/7x": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://xcom/en/": ("xcom", "/en/", None, "allow"),
        "s://b.example.net/de/81?q://z": ("b.example.net", "/de/81", "example.net/de/8", "block"),
        "s://b.net/de/8#f": ("b.net", "/de/8", "net/de/", "allow"),
        "s://x.org?/es/": ("x.org", "", None, "allow"),
        "s://Ä.org/es/\n": ("Ä.org", "/es/\n", "org/es/", "block"),
        "no url": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(url_filter.judge(pages, []).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [tuple(r)[1:] for r in got] == list(urls.values())
    assert url_filter.judge(pages.limit(0), []).count() == 0


def test_url_mining(spark):
    rng = random.Random(1)
    rows = [(f"http://{h}.example.org/{p}/{rng.randrange(99)}.html", h == "spam" and p == "buy") for _ in range(200) for h, p in [(rng.choice(["spam", "news"]), rng.choice(["buy", "read"]))]]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, block boolean"), 0.05, 0.9)
    assert [sorted(r) for r, _ in rules] == [["host:spam", "path:buy"]]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: "block" if b else "allow" for i, (_, b) in enumerate(rows)}
    assert url_filter.mine(spark.createDataFrame([], "url string, block boolean")) == []
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 1), (1, 1, 0), (2, 0, None), (3, None, None)], "doc_id long, quality int, toxic int")
    assert {r.url: r.block for r in url_filter.labelled_pages(pages, labels).collect()} == {rows[0][0]: False, rows[1][0]: True, rows[2][0]: True, rows[3][0]: False}


@pytest.mark.parametrize("n", [100, 1000])
def test_url_rules_need_many_pages(spark, n):
    """By chance no rule, whatever the size; otherwise those of the plain miner."""
    rng = random.Random(n)
    urls = [f"http://{rng.choice('abcdefgh')}.site{rng.randrange(n // 4)}.org/{rng.choice('uvwxyz')}/{rng.choice('klmn')}" for _ in range(n)]
    chance = [(u, rng.random() < 0.25) for u in urls]
    assert url_filter.mine(spark.createDataFrame(chance, "url string, block boolean")) == []
    rows = [(u.replace("http://", "http://bad.") if i % 3 == 0 else u, i % 3 == 0 and i % 4 > 0 or b) for i, (u, b) in enumerate(chance)]
    rows += [(f"http://x/{i}", False) for i in range(3)]
    got = url_filter.mine(spark.createDataFrame(rows, "url string, block boolean"))
    assert {r for r, _ in got} == brute.url_rules([(url_filter.items(u), b) for u, b in rows], url_filter.SUPPORT, url_filter.CONFIDENCE, url_filter.LEAST) != set()


def test_url_rules_have_no_cap(spark, monkeypatch, tmp_path):
    """Shared items don't crowd out other rules, pages of many items count, and the join gives what the broadcast gives."""
    hot = "&".join(f"q{k}" for k in range(70))
    kinds = [("http://hot/?" + "&".join(f"h{k}" for k in range(14)), 30, 30), ("http://warm/y", 28, 40), (f"http://long/z?{hot}", 25, 50), (f"http://long/deep?{hot}", 25, 25), ("none", 0, 40)]
    rows = [(u, i < blocked) for u, blocked, n in kinds for i in range(n)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    got = {r for r, _ in url_filter.mine(labelled)}
    assert {frozenset([x]) for x in ("host:hot", "query:h13", "host:warm", "path:y", "path:deep", "host:long", "query:q69")} <= got
    two = [("http://b/x?" + hot, i < 25) for i in range(50)] + [("http://b/w", False)] * 20 + [("http://a/x", False)] * 20 + [("http://b/x", i < 25) for i in range(30)]
    rules = {r for r, _ in url_filter.mine(spark.createDataFrame(two, "url string, block boolean"))}
    assert rules == {frozenset(["host:b", "path:x"])}
    spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows + two)] + [(9999, None), (0, rows[0][0])], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(not b), 0) for i, (_, b) in enumerate(rows + two)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    few = table(url_filter.op10_url_filter(spark, str(tmp_path)))
    monkeypatch.setattr(url_filter, "MOST_RULES", 3)
    assert table(url_filter.op10_url_filter(spark, str(tmp_path))) == few and len(few) == len(rows + two) + 2


def test_url_of_many_items(spark):
    """Few pages of very many items make no rules, many of them make one rule for each item, at once."""
    long = "http://a.b/?" + "&".join(f"k{i}=1" for i in range(64))
    few = [(long, True)] * 3 + [("http://c/d", False)] * 200
    assert url_filter.mine(spark.createDataFrame(few, "url string, block boolean")) == []
    many = [(long, True)] * 30 + [("http://c/d", False)] * 200
    assert {r for r, _ in url_filter.mine(spark.createDataFrame(many, "url string, block boolean"))} == {frozenset([i]) for i in url_filter.items(long)}


def test_pieces_cover_all_texts():
    from arbordex.llm import words

    texts = pa.array(["a b", None, "", "x" * 100, "é ü"] * 3)
    parts = [(lo, hi, p.to_pylist()) for lo, hi, p in words.pieces(texts)]
    assert [t for _, _, p in parts for t in p] == [t or "" for t in texts.to_pylist()]
