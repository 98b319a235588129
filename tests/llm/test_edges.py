"""Cases at the edges: odd names, repeated rows, rows without an id, texts larger than a block, hot groups, several levels of the exchange."""

import random
import time

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stratavox.llm import exact_dedup, ngram_join, packing, pii, quality, secrets, substring_dedup, suffix_dedup
from stratavox.llm.bpe import encode_decode

from . import reference as ref

tokenizers_files = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    with open(tokenizers_files.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def prose(r, n, size=300):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def test_stages_keep_columns_of_any_name(spark):
    r = random.Random(3)
    names = ["doc_id", "text", "n_chars", "a.b", "row", "tag", "c0", "`x`", "_id"]
    kind = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_chars", LongType()), *(StructField(n, StringType()) for n in names[3:])])
    base = prose(r, 60) + "."
    rows = [(1, base, len(base), *"abcdef"), (2, base, len(base), *"abcdef"), (None, base + " more", 0, *"uvwxyz"), (4, None, None, *"abcdef"), (5, "", 0, *"abcdef"), (6, prose(r, 40) + ". a@b.cd", 9, *"ghijkl"), (6, prose(r, 40) + ". a@b.cd", 9, *"ghijkl")]
    docs = spark.createDataFrame(rows, kind).repartition(3)
    for stage, ids in (
        (quality.clean_documents, [1, 2, 6, 6, None]),
        (exact_dedup.drop_copies, [1, 4, 6, 6, None]),
        (ngram_join.one_of_each, [1, 4, 5, 6, 6, None]),
        (pii.redact_documents, [1, 2, 4, 5, 6, 6, None]),
    ):
        out = stage(docs)
        got = out.collect()
        assert out.columns == names and out.schema.fieldNames() == names
        assert sorted((x[0] for x in got), key=str) == sorted(ids, key=str), stage
        assert all(tuple(x)[3:] in {tuple("abcdef"), tuple("uvwxyz"), tuple("ghijkl")} for x in got)
        assert stage(docs.limit(0)).count() == 0
    assert {x[1][-7:] for x in pii.redact_documents(docs).filter("doc_id = 6").collect()} == {"[EMAIL]"}


def test_operators_on_repeated_rows_and_rows_without_id(spark, ranks):
    r = random.Random(4)
    text = prose(r, 50)
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text + " x" * 5), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        dealt = docs.repartition(parts)
        ids = sorted((str(i) for i, _ in rows))
        for out in (secrets.secret_scan(dealt), pii.find_pii(dealt), quality.quality_rules(dealt), encode_decode(dealt, ranks, tokenizers_files.PATTERN)):
            assert sorted(str(x.doc_id) for x in out.collect()) == ids
        assert sum(x.length for x in packing.pack_documents(dealt, ranks, tokenizers_files.PATTERN).collect() if x.doc_id in (1, None)) == sum(x.doc_tokens for x in packing.pack_documents(dealt, ranks, tokenizers_files.PATTERN).collect() if x.start == 0 and x.doc_id in (1, None))
        # copies of one id don't remove each other; rows without an id come last
        for hot in (0, substring_dedup.HOT):
            words = sorted((str(x.doc_id), x.n_removed) for x in substring_dedup.remove_repeats(dealt, block_bytes=400, hot=hot).collect())
            assert words == [("1", 0), ("1", 0), ("2", 50), ("3", 0), ("None", 0), ("None", 50), ("None", 50)]
        n = len(text)
        for hot in (0, suffix_dedup.HOT):
            gone = sorted((str(x.doc_id), x.n_removed) for x in suffix_dedup.remove_repeated_bytes(dealt, block_bytes=400, hot=hot).collect())
            assert gone == [("1", 0), ("1", 0), ("2", n), ("3", 0), ("None", 0), ("None", n), ("None", n)]
        linked = sorted((str(x.doc_id), x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(dealt, block_bytes=400).collect() if x.component_id)
        assert linked[:3] == [("1", 47, 1), ("1", 47, 1), ("2", 51, 1)] and [x[2] for x in linked[-2:]] == [1, 1]


def test_a_text_larger_than_a_block_and_several_levels_of_the_exchange(spark, ranks):
    r = random.Random(6)
    passage = prose(r, 40)
    rows = [(0, prose(r, 30_000)), *((i, f"{prose(r, r.randrange(200))} {passage} {prose(r, r.randrange(200))}") for i in range(1, 40))]
    rows.append((40, rows[0][1].upper()[:50_000] + rows[0][1][50_000:]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    small = {"block_bytes": 2000, "digit": 2, "most": 3}
    for hot in (0, 30, substring_dedup.HOT):
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.remove_repeats(docs, **small, hot=hot).collect()}
        assert got == ref.word_repeats(rows)
    for hot in (30, suffix_dedup.HOT):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeated_bytes(docs, **small, hot=hot).collect()}
        assert got == ref.byte_repeats(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(docs, **small).collect()}
    assert got == ref.linked(rows)
    encoded = encode_decode(docs, ranks, tokenizers_files.PATTERN, block_chars=2000, digit=2, most=3)
    whole = encode_decode(docs, ranks, tokenizers_files.PATTERN)
    assert sorted(map(tuple, encoded.collect())) == sorted(map(tuple, whole.collect()))


def test_a_string_at_two_places_of_rows_with_one_id(spark):
    r = random.Random(10)
    passage = prose(r, 60)
    rows = [(7, prose(r, 80) + passage), (7, passage + prose(r, 20)), (9, passage)]
    for parts, hot in ((1, 0), (1, suffix_dedup.HOT), (3, 0), (3, suffix_dedup.HOT)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {x.n_bytes: x.n_removed for x in suffix_dedup.remove_repeated_bytes(docs, hot=hot).collect()}
        n = len(passage.encode())
        assert got == {len(rows[0][1].encode()): n, len(rows[1][1].encode()): 0, n: n}


def test_texts_mixed_from_a_few_phrases_that_are_not_alike(spark):
    """Every text shares rare columns with many others, and few link: no leader is near most of them."""
    r = random.Random(8)
    phrases = [[f"p{i}_{j}" for j in range(12)] for i in range(60)]
    rows = []
    for i in range(1500):
        words = [w for p in r.sample(phrases, 6) for w in p]
        rows.append((i, " ".join(words)))
        if i % 50 == 0:
            words[r.randrange(len(words))] = "odd"
            rows.append((10_000 + i, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), few=16).collect()}
    assert got == ref.linked(rows)


def test_overlaps_are_discarded_only_below_the_bound():
    import numpy as np

    r = random.Random(9)
    texts = [prose(r, r.randrange(5, 60), 12).encode() for _ in range(60)]
    sets = ngram_join._Sets([*range(60)], texts, 2)
    n = len(sets.sizes)
    u, v = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    rows = np.split(sets.key, np.cumsum(sets.sizes)[:-1])
    want = np.array([len(np.intersect1d(rows[a], rows[b])) for a, b in zip(u, v, strict=True)])
    assert (ngram_join.overlaps(sets, u, v, None) == want).all()
    for least in (3, 8, 20):
        got = ngram_join.overlaps(sets, u, v, np.full(len(u), least))
        assert (np.where(want >= least, got == want, got < least)).all()


@pytest.mark.parametrize("piece", ["account 1aaa", "account 1aaaa", "acct1", "passport 12", "ssn-1-", "iban aa11", "ibanaa11", "ssn 1 ", "1", "12.", "+", "+1", "@", "a@b", "://", "a://b:", "1.1", "(", "tax id 4 4", "İaccount 123456"])
def test_private_data_in_time_that_grows_with_the_text(piece):
    text = piece * (1_000_000 // len(piece))
    start = time.time()
    pii.spans_of(text, pii.automaton())
    assert time.time() - start < 20


def test_cues_in_any_case():
    anchors = pii.automaton()
    assert pii.redact("IbAn DE89 3704 0044 0532 0130 00 aCCount 12345678 İ SSN 123-45-6789", anchors) == "IbAn [ACCOUNT] aCCount [ACCOUNT] İ SSN [ACCOUNT]"


def test_a_phrase_in_many_unlike_texts_gathers_nothing(spark):
    """One five-word phrase is an anchor of very many texts: its surroundings must not meet in one group."""
    from collections import Counter

    from stratavox.llm import blocks

    r = random.Random(21)
    phrase = "all rights are reserved here"
    rows = [(i, f"{prose(r, 30, 5000)} {phrase} {prose(r, 30, 5000)}") for i in range(20_000)]
    rows += [(20_000 + i, rows[i * 7][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    table = blocks.pack_blocks(docs, "doc_id", "text", 1 << 18, "probe")
    for hot, least, most in ((1 << 30, 1500, 1 << 30), (500, 0, 500)):
        told = blocks.exchanged(table.mapInArrow(substring_dedup._ask_anchors(6), blocks.MESSAGES), substring_dedup._told(hot, 6), 512)
        asked = table.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(substring_dedup._ask_seeds(6), blocks.MESSAGES)
        at, windows = Counter(), 0
        for x in asked.collect():
            if x.prefix == 0:
                at.update(substring_dedup._read([bytes(x.body)[1:]])[0].tolist())
            else:
                windows += len(bytes(x.body))
        assert least <= max(at.values()) <= most and (windows > 0) == (hot == 500)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.remove_repeats(docs, block_bytes=1 << 18, hot=500).collect()}
    assert got == ref.word_repeats(rows)


def test_grams_of_one_hash_are_told_apart():
    """Two grams whose hashes clash, followed by the same bytes, and two equal ones beside them."""
    import zstandard

    from stratavox.llm import blocks

    tail = bytes(range(100, 168))
    a, b = b"A" * suffix_dedup.GRAM + tail, b"B" * suffix_dedup.GRAM + tail
    same = b"xyz" + a
    ((_, body),) = suffix_dedup._messages([(5, a, 1, 0, 0), (5, b, 2, 0, 0), (5, same, 3, 0, 3)], 0, 6)
    (answer,) = suffix_dedup._repeats([body])
    marks = blocks.split_body(zstandard.ZstdDecompressor().decompress(answer))
    assert marks[:2] == [b"\0", b"\0"] and marks[2][0] == 0 and marks[2][1:] == bytes([0b00010000])
