import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stormlane.llm import bpe

SCHEMA = "doc_id long, text string, ids string, decoded int"
PIECES = ["a", "the", "an", "ing", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "'s", "'t", "é", "é", "İ", "Σ", "ΑΣ", "ß", "中", "😂", "👍🏽", "1", "２", "²", "<|endoftext|>", "<|startoftext|>", "<|", ".", "!!", "_", "ﬁ", "ǅ", "‍", "\x00", "हि", "x" * 50, "th" * 900]


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def pair(request):
    import public_tokenizers

    path = public_tokenizers.path(request.param)
    with open(path) as file:
        return bpe.Tokenizer(file.read()), Tokenizer.from_file(path), path


def test_ids_and_text_equal_the_library(pair):
    own, library, _ = pair
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


#: Signs that the normalizer takes for white space, marks that join what stands before them, and signs that change alone.
ODD = [" ", "\u00a0", "\u3000", "\x85", "\u2028", "\u2003", "\u1680", "\x1c", "\u0301", "\u0308", "e\u0301", "\u00e9", "a", "b", "ab", "\u0130", "\u03a3", "\u4e2d", "1", ".", "\n"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 2, 5, 50])
def test_batches_of_odd_texts_equal_the_library(pair, size):
    """From an empty memory and from a warm one; runs of nothing but white space beyond ASCII among them."""
    own, library, _ = pair
    texts = odd_texts(800, size) + [sign * n for sign in ODD for n in (1, 2)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for cold in (True, False):
        own.forget()
        for at in range(0, len(texts), size):
            if cold:
                own.forget()
            assert [x.tolist() for x in own.encode_many([t.encode() for t in texts[at : at + size]])] == want[at : at + size]
    own.forget()


def test_ids_do_not_depend_on_how_rows_are_dealt(spark, pair):
    _, library, path = pair
    texts = odd_texts(120, 9)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)]
    for tasks in (1, 120):
        assert sorted((r.id, r.ids) for r in bpe.encode_texts(frame.repartition(tasks), path).collect()) == want


def test_emitted_tokens_are_stable_for_any_feed(pair):
    own, library, _ = pair
    rng = random.Random(4)
    for n in (1, 5, 300, 700, 2500):
        word = "".join(rng.choice("thinaeors") for _ in range(n))
        want = library.encode(word, add_special_tokens=False).ids
        for feed in (1, 7, 64, 4096):
            assert list(own.merges.transduce(word, feed)) == want


def test_decoding_bit_by_bit_equals_decoding_at_once(pair):
    own, _, _ = pair
    ids = own.encode("Ünï 😂 code\n text. " * 3)
    machine = own.decoder()
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == own.decode(ids)


def test_edge_rows_and_round_trip(spark, pair):
    _, library, path = pair
    rows = [(1, "Some text, twice.", "x", 1), (1, "Some text, twice.", None, None), (None, "no id", "x", 1), (3, None, None, None), (4, "", None, 1), (5, "ab" * 30000, None, 1), (6, "word " * 20000, None, 2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    encoded = bpe.encode_texts(frame, path).collect()
    assert sorted((str(r.id), r.ids, r.decoded) for r in encoded) == sorted((str(i), (ids := library.encode(t or "", add_special_tokens=False).ids), library.decode(ids, skip_special_tokens=False)) for i, t, *_ in rows)
    back = bpe.decode_ids(bpe.encode_texts(frame, path, decode=False), path).collect()
    assert sorted((str(r.id), r.text) for r in back) == sorted((str(r.id), r.decoded) for r in encoded)
    assert bpe.encode_texts(spark.createDataFrame([], SCHEMA), path).collect() == []
    assert bpe.decode_ids(spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>"), path).orderBy("id").collect() == [(1, None), (2, "")]


def test_query_on_small_tables(spark):
    library = Tokenizer.from_file(bpe.word_tokenizer_path())
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in texts:
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op9_bpe_encoding_and_decoding(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_what_is_not_supported_is_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer('{"model": {"type": "WordPiece"}, "normalizer": null, "pre_tokenizer": null, "added_tokens": []}')
