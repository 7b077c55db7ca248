import random

import numpy as np

import corpus_pipeline
from stormlane.llm import bpe, decontamination, pu, secret_scan, similar
from stormlane.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _node int, node string"


def jaccard(a, b):
    x, y = (set(shingle_hashes(t, 5, 0).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def plain_keepers(rows):
    """The smallest id of each group, every pair of texts compared."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if find(i) != find(j) and jaccard(a, b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if root[i] == i}


def near_copies(spark):
    rng, rows = random.Random(3), []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 400]))]
        for copy in range(rng.choice([1, 2, 5])):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            rows.append((1000 - len(rows), " ".join(changed)))
    return rows


def test_one_of_each_group_stays(spark):
    rows = near_copies(spark)
    got = similar.one_of_each_group(spark.createDataFrame([(i, t, "en", "s", len(t), None, None) for i, t in rows], SCHEMA))
    kept, want = {r.doc_id for r in got.collect()}, plain_keepers(rows)
    assert kept == want


def test_edge_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (7, None), (8, None), (9, ""), (10, " \n"), (11, "short one"), (12, "Short\tone"), (None, "only null id"), (None, "only null id"), (13, "long " * 50000)]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "n") for i, t in rows], SCHEMA)
    got = similar.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)[:12]) for r in got.collect()) == sorted([("3", "WORD0 WORD1 "), ("7", "None"), ("8", "None"), ("9", ""), ("10", " \n"), ("11", "short one"), ("None", "only null id"), ("13", "long long lo")])
    repeated = spark.createDataFrame([(1, text, None, None, None, 1, "n")] * 3, SCHEMA)
    assert similar.one_of_each_group(repeated).count() == 1
    assert similar.one_of_each_group(docs.limit(0)).count() == 0


def test_of_repeated_rows_the_same_one_stays_however_they_are_dealt(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, f"l{k}", f"s{k % 7}", k, None, None) for k in range(50)] + [(2, "other", "x", "y", 1, None, None)], SCHEMA)
    found = {tuple(map(tuple, similar.one_of_each_group(docs.repartition(n)).orderBy("doc_id").collect())) for n in (1, 3, 9)}
    assert len(found) == 1 and len(found.pop()) == 2


def test_stages_handle_odd_rows_and_keep_the_columns(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1, 1, "n"), (1, text, "en", "s", 1, 1, "n"), (None, None, None, None, None, None, None), (3, "", None, None, 0, None, None), (4, "token=abcdefghijklmnop " + "word " * 40000, None, None, 9, None, None)]
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")], name
        left = docs.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(left)
    assert left == []


def test_texts_without_words_pass_the_toxicity_stage(spark):
    """Even under a model that calls everything else toxic."""
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "some words")], "doc_id long, text string")
    model = pu.Model(np.empty(0, dtype=np.int64), np.empty(0), 5.0, 0.99)
    assert sorted(r.doc_id for r in pu.keep_below(docs, model, pu.TOXICITY).collect()) == [1, 2, 3]


def test_encoding_stage_equals_the_library_on_odd_white_space(spark):
    import hashlib

    from tokenizers import Tokenizer

    rng, signs = random.Random(8), [" ", "\u00a0", "\u3000", "\x85", "\u2028", "a", "b", "e\u0301"]
    texts = ["".join(rng.choice(signs) for _ in range(9)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(60)
    library, digest = Tokenizer.from_file(bpe.word_tokenizer_path()), lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    want = [(i, digest(library.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.encoding(spark, docs, SF).collect()) == want


def test_run_equals_its_stages_by_brute_force(spark):
    """Each stage's decisions, worked out row by row from the same models and items."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pu.toxicity_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    known, weight = pu._chosen_only(model, pu.TOXICITY), dict(zip(model.ids.tolist(), model.weights.tolist()))
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.bias + sum(weight[i] for i in pu.toxicity_features(r.text, known)) < 0]
    keep = plain_keepers(sorted(rows))
    items = [(str(r.item_id), decontamination.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    automaton, clean = decontamination.Automaton(items, 10), []
    for i, text in rows:
        words = decontamination.words_of(text)
        spans, _ = automaton.match(words)
        if i in keep and sum(b - a for a, b in spans) <= 0.5 * len(words):
            clean.append((i, decontamination.cut(text, decontamination.places(text, spans))))
    marked = secret_scan.redact(spark.createDataFrame(clean, "doc_id long, text string"))
    want = bpe.digests(bpe.encode_texts(marked, bpe.word_tokenizer_path()))
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
