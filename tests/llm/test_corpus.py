"""The corpus operators against brute force, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavox.llm import exact_dedup, ngram_join, packing, pii, quality, queries, secrets, substring_dedup, suffix_dedup, token_shards, tokens
from stratavox.llm.bpe import encode_decode
from . import reference as ref

tokenizers_files = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, key long, digest string, n long, block long, root string"


def corpus():
    """Copies, near copies, shared passages, secrets, personal data, junk, odd characters, empty and null texts, one very long text."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeioustnrl") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) + (".\n" if r.random() < 0.1 else "") for _ in range(n))
    passage, base = prose(70), prose(150)
    texts = [None, "", " \t\n", "one", "One two three", "one two three", base, base.upper(), base.replace(" ", "  "), prose(5000)]
    for i in range(25):
        w = base.split(" ")
        for _ in range(i % 6):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [f"{prose(r.randrange(60))} {passage} {prose(r.randrange(60))}" for _ in range(8)]
    texts += ["ab " * 200, "x" * 3000, "x" * 150, "naïve café – ünïcödé 数字 ½ \x1c\x85 don't we'll  \n\n  end ", "{ \"token\": \"abc\" } password = hunter2xyz; AKIA" + "Q7" * 10 + " 0123456789abcdef01234567ff"]
    texts += ["secret: token: abcdefgh API_KEY='sk.x-yz_1' k9Jx2LmQ8vRt4WzY7bNc3PdF", "mail a.b@c.d_e@f.gh, 10.0.0.255.1.2.3 256.1.1.1 4111 1111-1111 1111 +43 (1) 234-5678-90 iban DE89 3704 0044 0532 0130 00", "| home | about | terms | privacy |\n" + prose(40), "### $$$ %%% " * 20, prose(12) + "\nAll rights reserved."]
    return list(enumerate(texts, 3))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ranks():
    with open(tokenizers_files.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(docs, empty):
    want = ref.exact(DOCS)
    for options in ({}, {"digest": lambda _: b"same"}, {"salts": 1}):
        got = by_id(exact_dedup.exact_dedup(docs, **options))
        assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    assert {i: r.text_sha256 for i, r in by_id(exact_dedup.exact_dedup(docs)).items()} == {i: w[3] for i, w in want.items()}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_repeated_rows_and_rows_without_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")], "doc_id long, text string").repartition(4)
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 3
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 1, 3), (None, 1, 3), (None, None, 1), (2, 2, 1)}
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == [(1, "a"), (2, "c"), (None, "b")]


def test_jaccard_components(docs, empty):
    for k, percent in ((4, 85), (5, 80), (2, 50)):
        want = ref.linked(DOCS, k, percent)
        got = by_id(ngram_join.jaccard_components(docs, k=k, percent=percent))
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert ngram_join.jaccard_components(empty).count() == 0
    kept = {r.doc_id for r in ngram_join.one_of_each(docs, k=5, percent=80).collect()}
    assert kept == {c for _, c in ref.linked(DOCS, 5, 80).values()}


def test_jaccard_of_a_large_family(spark):
    """Near copies with few and many edits, and a second family that shares a passage: more than one leader a column."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(25)]
    rows = []
    for family in range(3):
        base = passage + [r.choice(vocabulary) for _ in range(35)]
        for i in range(40):
            w = list(base)
            for _ in range(i % 5):
                w[r.randrange(len(w))] = f"e{family}_{r.randrange(30)}"
            rows.append((family * 100 + i, " ".join(w)))
    got = by_id(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block_bytes=3000))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == ref.linked(rows)


def test_secrets(docs, empty):
    got = by_id(secrets.secret_scan(docs))
    for i, t in DOCS:
        want = ref.secrets(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(","))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
    assert any("entropy_" in r.spans for r in got.values())
    assert secrets.secret_scan(empty).count() == 0


def test_entropy_by_counts_matches_its_definition():
    from collections import Counter
    from math import log2

    r = random.Random(1)
    for _ in range(50):
        run = "".join(r.choice("abcdef0123") for _ in range(r.randrange(20, 60)))
        want = max(-sum(c / 20 * log2(c / 20) for c in Counter(run[i : i + 20]).values()) for i in range(len(run) - 19))
        assert secrets.best_entropy(run) == pytest.approx(want)
    assert secrets.allowed("123e4567-e89b-12d3-a456-426614174000") and secrets.allowed("some-file-name-with-words") and not secrets.allowed("k9Jx2LmQ8vRt4WzY7bNc3PdF")


def test_private_data(docs, empty):
    got = by_id(pii.find_pii(docs))
    for i, t in DOCS:
        want = ref.private(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(","))
    assert pii.find_pii(empty).count() == 0
    clean = pii.redact_documents(docs)
    assert clean.columns == docs.columns and clean.count() == len(DOCS)
    assert "[EMAIL]" in " ".join(r.text or "" for r in clean.collect())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@+-0123459 ()_%", max_size=40))
def test_private_data_as_regular_expressions_find_it(text):
    spans = [f"{k}:{a}:{b}" for a, b, k in sorted(pii.spans_of(text, pii.automaton()), key=lambda s: (s[0], pii.KINDS.index(s[2]))) if k in pii.BASE]
    assert spans == ref.private(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "secret", "api_key", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789", "abcdef", "0123456789ab", "x", "."]), max_size=12).map("".join))
def test_secrets_as_regular_expressions_find_them(text):
    assert secrets.joined(secrets.base_spans(text)) == ",".join(ref.secrets(text))


def test_quality(docs, empty):
    got = by_id(quality.quality_rules(docs))
    for i, t in DOCS:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == ref.quality(t)
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(empty).count() == 0
    assert quality.line_fails(b"| home | about | terms |") and not quality.line_fails(b"A plain sentence stands here.")
    clean = quality.clean_documents(docs)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.kept}
    assert "All rights reserved." not in " ".join(r.text for r in clean.collect())


@pytest.mark.parametrize(("lang", "line"), [("en", "Share this article"), ("de", "Alle Rechte vorbehalten. © 2024"), ("fr", "TOUS DROITS RÉSERVÉS"), ("es", "Suscríbete a nuestro boletín")])
def test_page_furniture_of_each_language(lang, line):
    prose = "Ein Satz steht hier, nach oben offen, und noch einer."
    assert any(p in line.lower() for p in quality.PHRASES[lang])
    assert quality.clean_lines(f"{prose}\n{line}\n{prose}".encode()) == (f"{prose}\n{prose}".encode(), 1, len(line.split()))
    assert not quality.line_fails(f"{line} {'word ' * 40}.".encode())


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n", max_size=120))
def test_repeated_windows_by_numbers(text):
    assert quality.figures(text.encode())[:6] == ref.quality(text)


def test_word_repeats(docs, empty):
    for block in (1000, 1 << 20):
        got = by_id(substring_dedup.remove_repeats(docs, block_bytes=block))
        assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == ref.word_repeats(DOCS)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_byte_repeats(docs, empty):
    for block, hot in ((1000, 1 << 14), (1 << 20, 1 << 14), (1000, 0), (1000, 6), (1 << 20, 6)):
        got = by_id(suffix_dedup.remove_repeated_bytes(docs, block_bytes=block, hot=hot))
        assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == ref.byte_repeats(DOCS)
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(values):
    text = [*values, 0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_tokens_agree_with_both_libraries(ranks):
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(tokenizers_files.path("byte_bpe_50k.json"), "rb") as f:
        spec = f.read()
    assert tokens.ranks_of(spec) == tokens.ranks_of(ranks)
    whole = Tokenizer.from_file(tokenizers_files.path("byte_bpe_50k.json"))
    encoding = tokens.engine(ranks, tokenizers_files.PATTERN)
    texts = [t or "" for _, t in DOCS]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = []
    for _, _, _, ids, counts in tokens.token_stream([batch], spec, tokenizers_files.PATTERN, chunk_chars=2000, most_words=50):
        got += np.split(ids, np.cumsum(counts)[:-1])
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == encoding.encode_ordinary(text) == whole.encode(text, add_special_tokens=False).ids


def test_splitter_on_latin_code_points():
    import regex

    split, general = tokens.splitter(tokenizers_files.PATTERN), regex.compile(tokenizers_files.PATTERN)
    for cp in range(0x250):
        text = f"a{chr(cp)}1{chr(cp)}{chr(cp)} {chr(cp)}'s  {chr(cp)}"
        assert split(text) == general.findall(text)


def test_bpe(docs, empty, ranks):
    encoding = tokens.engine(ranks, tokenizers_files.PATTERN)
    for block in (500, 1 << 20):
        got = by_id(encode_decode(docs, ranks, tokenizers_files.PATTERN, block_chars=block))
        for i, t in DOCS:
            ids = encoding.encode_ordinary(t or "")
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert encode_decode(empty, ranks, tokenizers_files.PATTERN).count() == 0


def check_pieces(rows, docs, ranks):
    """Every id of every text in one piece, every sequence without gaps and without padding."""
    encoding = tokens.engine(ranks, tokenizers_files.PATTERN)
    for i, t in docs:
        ids = np.array([*encoding.encode_ordinary(t or ""), 1], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sequences.values())


def test_packing(docs, empty, ranks):
    check_pieces(packing.pack_documents(docs, ranks, tokenizers_files.PATTERN).collect(), DOCS, ranks)
    assert packing.pack_documents(empty, ranks, tokenizers_files.PATTERN).count() == 0


def test_hilbert_neighbours_touch():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(points, bits=3)
    assert sorted(key.tolist()) == list(range(512))
    path = points[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5000), st.text(max_size=5))
def test_permutation(n, key):
    index = np.arange(n)
    slots = token_shards.permute(index, n, key)
    assert sorted(slots.tolist()) == index.tolist() and (token_shards.permute(slots, n, key, back=True) == index).all()


def shards_by_force(rows, ranks, key, length, plan):
    """(sequence number, ids) in training order: each partition's documents end to end, cut, and ordered by slot."""
    encoding, streams = tokens.engine(ranks, tokenizers_files.PATTERN), {}
    for r in rows:
        streams.setdefault(r.part, []).extend([*encoding.encode_ordinary(r.text or ""), 50256])
    out = [(p * plan["most"] + i // length, ids[i : i + length]) for p, ids in streams.items() for i in range(0, len(ids), length)]
    slots = token_shards.permute(np.array([i for i, _ in out]), plan["slots"], key).tolist()
    return [x for _, x in sorted(zip(slots, out, strict=True))]


def test_token_shards(docs, empty, ranks, spark, tmp_path):
    make = lambda uri, rows=docs, key="k", **more: token_shards.token_shards(rows, ranks, tokenizers_files.PATTERN, key, 50256, uri, length=64, shard_text_bytes=9000, **more)
    uri = f"file://{tmp_path}/shards"
    make(uri)
    plan = token_shards.read_manifest(uri)
    want = shards_by_force(token_shards.texts(docs, "doc_id", "text").withColumn("part", F.spark_partition_id()).collect(), ranks, "k", 64, plan)
    got = sorted(token_shards.shard_index(spark, uri, with_ids=True).collect(), key=lambda r: r.slot)
    assert plan["n_shards"] > 5 and [(r.sequence_index, r.ids) for r in got] == want
    assert [r.slot for r in got] == list(range(len(got))) and all(r.intact and r.n_tokens == len(r.ids) for r in got)
    # the files, one after another, are the training order; a record is one seek away
    files = sorted(tmp_path.joinpath("shards").glob("shard-*.bin"))
    assert sum(f.stat().st_size for f in files) == len(got) * plan["stride"] and len(list(tmp_path.joinpath("shards").iterdir())) == len(files) + 1
    for r in got[::17]:
        assert token_shards.read_record(uri, r.shard_id, r.byte_offset // plan["stride"]).tolist() == r.ids
    # a writer that was stopped goes on with the shards that are missing, and leaves the others alone
    kept = {f: f.stat().st_mtime_ns for f in files[::2]}
    content = {f: f.read_bytes() for f in files}
    for f in files[1::2]:
        f.unlink()
    make(uri)
    assert {f: f.read_bytes() for f in files} == content and {f: f.stat().st_mtime_ns for f in kept} == kept
    # other rows, another split of them, or another key are refused
    for other in ({"rows": docs.repartition(5)}, {"rows": docs.limit(9)}, {"key": "l"}):
        with pytest.raises(ValueError):
            make(uri, **other)
    assert make(f"file://{tmp_path}/none", rows=empty).count() == 0


def test_pipeline_stage_by_stage(spark, small, ranks):
    """Each stage's rows and texts against brute force on what the stage before it kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "ngram_join", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, small)
        rows = out.collect()
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and all(r.n_chars == len(r.text) for r in rows)
        got = {r.doc_id: r.text for r in rows} if name != "packing" else None
        if name == "quality_rules":
            phrases = [p for lang in quality.PHRASES.values() for p in lang]
            want = {i: ref.cleaned(t, phrases) for i, t in before}
            assert got == {i: t for i, t in want.items() if t is not None} and any(got[i] != t for i, t in before if i in got)
        elif name == "exact_dedup":
            assert got == {i: t for i, t in before if ref.exact(before)[i][2]}
        elif name == "ngram_join":
            stays = {c for _, c in ref.linked(before, 5, 80).values()}
            assert got == {i: t for i, t in before if i in stays}
        elif name == "pii":
            assert got == {i: ref.redacted(t) for i, t in before} and any(got[i] != t for i, t in before)
        else:
            assert {r.doc_id for r in rows} == {i for i, _ in before}
            check_pieces(rows, before, ranks)
        docs = spark.createDataFrame(rows, out.schema) if name != "packing" else docs


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)} and set(queries.queries()) | {"pipeline"} <= names


def test_sql_of_queries(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, small).toPandas(), con.sql(sql).df()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_native_columns_survive(docs):
    assert docs.filter(F.col("text").isNull()).count() == 1
