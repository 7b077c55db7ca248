import random

from stormlane.llm import decontamination as de

DOCS, ITEMS = "doc_id long, text string, items string, _spans int", "item_id long, text string, extra string"


def plain(words, items, window):
    """Hit places and items by comparing every window at every place."""
    hit, names = set(), set()
    for name, item in items:
        k = min(window, len(item))
        for i in range(max(0, len(item) - k + 1) if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == item[i : i + k]:
                    hit |= set(range(j, j + k))
                    names.add(name)
    return hit, names


def test_matches_equal_brute_force():
    rng = random.Random(2)
    for round_ in range(300):
        signs = "abc"[: rng.choice([2, 3])]
        draw = lambda most: [rng.choice(signs).encode() for _ in range(rng.randrange(most))]
        items, window = [(str(i), draw(14)) for i in range(rng.randrange(1, 6))], rng.choice([3, 4, 6])
        automaton = de.Automaton(items, window)
        for _ in range(6):
            words = draw(30) + [b"other"] + draw(10)
            spans, names = automaton.match(words)
            hit, want = plain(words, items, window)
            assert {i for a, b in spans for i in range(a, b)} == hit and names == want


def test_words():
    assert de.words_of("A-B c\x00D_9é É\x7f") == ["a".encode(), b"b", b"c", b"d", "9é".encode(), "É".encode()]
    text = "One, TWO. three!"
    assert [text[a:b] for a, b in de.places(text, [(0, 2), (2, 3)])] == ["One, TWO", "three"]


def test_edge_rows_and_shards(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    items = spark.createDataFrame([(1, passage, None), (2, "Short item", "x"), (3, None, None), (None, "w0 w1 ignored", None), (4, " - ", None), (2, "short item", None), (5, " ".join(f"W{i}" for i in range(3, 20)), None)], ITEMS)
    rows = [(1, f"before. {passage.upper()}! after and some more words here so that most of this text is clean and stays as it is", "x", 1), (1, passage, None, None), (2, None, None, None), (3, "", None, None), (None, "a short, item b and six more clean words", None, 7), (5, "clean " * 50000, None, None), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 nine", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted([("1", 35, 15, ["1", "5"]), ("1", 15, 15, ["1", "5"]), ("2", 0, 0, []), ("3", 0, 0, []), ("None", 9, 2, ["2"]), ("5", 50000, 0, []), ("6", 10, 0, [])])
    for shard_words in (de.SHARD_WORDS, 20, 1):
        got = de.find(docs, items, shard_words=shard_words).collect()
        assert sorted((str(r.id), r.n_words, r.n_hit, r["items"]) for r in got) == want
        assert all((rows[0][1][s.start : s.end] == passage.upper()) for r in got if r.n_words == 35 for s in r.spans)
        kept = de.decontaminate(docs, items, shard_words=shard_words)
        assert kept.schema == docs.schema
        texts = sorted((str(r.doc_id), r.text) for r in kept.collect())
        assert texts == sorted([("1", rows[0][1].replace(passage.upper(), "")), ("2", None), ("3", ""), ("None", "a  b and six more clean words"), ("5", rows[5][1]), ("6", rows[6][1])])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", None, None)], DOCS), spark.createDataFrame([], ITEMS)
    assert [tuple(r) for r in de.find(docs, items).collect()] == [(1, 2, 0, [], [])]
    assert de.find(docs.limit(0), items).collect() == [] and de.decontaminate(docs, items).collect() == docs.collect()
