"""The registered queries over the driver's smallest tables: against SQL or a plain version."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

from arbordex.llm import fingerprints, language_id, ngram_join, registry, token_counts  # noqa: E402

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = registry.QUERIES[name](spark, str(SF)), c.sql(registry.ORACLES[name])
    plain = lambda names, rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for _, v in sorted(zip(names, r, strict=True))]) for r in rows)
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())


def result(spark, name, *columns):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, str(SF)).select(*columns).collect())


def test_substring_query(spark, rows):
    assert result(spark, "op5_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(rows))


def test_ngram_query(spark, rows):
    assert result(spark, "op8_ngram_join", "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(rows))


def test_line_query(spark, rows):
    want = sorted((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in brute.line_dedup(rows))
    assert result(spark, "op9_line_dedup", "doc_id", "kept_sha256") == want


def encoded(rows):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    return sorted(want)


def test_bpe_query(spark, rows):
    assert result(spark, "op4_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == encoded(rows)


def test_token_count_query(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer(tokenizers.models.Unigram([(p, float(s)) for p, s in token_counts.default_vocabulary()], unk_id=0, byte_fallback=True))
    library.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend("▁"), tokenizers.normalizers.Replace(" ", "▁")])
    assert result(spark, "op6_token_counts", "doc_id", "n_tokens") == sorted((d, len(library.encode(t or "").ids)) for d, t in rows)


def test_fingerprint_query(spark, rows):
    """Signatures of all documents of up to 3,000 characters by the plain version; digests and likeness of all."""
    got = {r.doc_id: r for r in registry.QUERIES["op2_fingerprints"](spark, str(SF)).collect()}
    assert len(got) == len(rows)
    sign = lambda t: brute.signature(t, fingerprints.BINS, fingerprints.EMPTY, 0xD6E8FEB86659FD93)

    def like(a, b):
        filled = [(x, y) for x, y in zip(a, b, strict=True) if fingerprints.EMPTY not in (x, y) or x != y]
        return sum(x == y for x, y in filled) / len(filled) if filled else 1.0

    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if max(len(t), len(after)) <= 3000:
            own, other, following = sign(t), sign(edited), sign(after)
            assert fingerprints.from_string(got[d].fingerprint).tolist() == own and fingerprints.from_string(got[d].edited_fingerprint).tolist() == other
            assert got[d].near_edited == pytest.approx(like(own, other)) and got[d].near_next == pytest.approx(like(own, following))


def test_language_query(spark):
    want = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = registry.QUERIES["op1_language_id"](spark, str(SF)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(want) and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.95 * len(held)


def test_pipeline_stages(spark, rows, tmp_path):
    """Each stage against a plain version over its own input."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "mix_sources", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(SF)).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        at[name] = docs
        if name != "bpe":
            assert docs.columns == columns
        pairs = sorted((r.doc_id, r.text) for r in before.select("doc_id", "text").collect())
        if name == "language_id":
            model = language_id.fitted(spark, before)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, t in pairs if not brute.language(t or "", model)[2])
        if name == "line_dedup":
            kept = [(d, t) for d, t in brute.line_dedup(pairs) if brute.WORD.search(t) or t == dict(pairs)[d]]
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(kept)
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "ngram_join":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, _, c in brute.jaccard_components(pairs, 5, 80) if d == c)
        if name == "mix_sources":
            size, source = {d: len(brute.WORD.findall(t or "")) for d, t in pairs}, {r.doc_id: r.source for r in before.collect()}
            held = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
            target = brute.targets(held)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d in size for _ in range(brute.taken(d, target[source[d]] / held[source[d]] if held[source[d]] else 0)))
        if name == "bpe":
            assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, docs.collect())) == encoded(pairs)
    assert ngram_join.PERCENT == 85


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, clashing columns, and an empty table go through all stages."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "the first of many lines\nand another one of them", "en", None, None), (None, None, None, None, None), (900, "", "en", "s", 0), (901, "  \n ", None, "s", 4), (902, "twice the same row here now", "en", "s", 27), (902, "twice the same row here now", "en", "s", 27)], docs.schema)
    names = ["doc", "row", "rate", "ids", "score", "gone", "n_lines", "rejected", "mix_size"]
    whole = docs.unionByName(odd).select("*", *[F.lit("q").alias(c) for c in names])
    other = " OR ".join(f"CAST({c} AS STRING) <> 'q'" for c in names)
    for start, most in ((whole, 66), (whole.limit(0), 0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{most}")
            stage(spark, now, str(SF)).write.parquet(path)
            before, now = now, spark.read.parquet(path)
            if name != "bpe":
                assert now.columns == start.columns and now.where(other).count() == 0
            assert now.count() <= before.count() * (3 if name == "mix_sources" else 1)
        assert (now.count() > 0) == (most > 0)
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
