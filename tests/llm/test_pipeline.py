"""The pipeline, stage by stage, against what brute force keeps of a small corpus."""

import random
import zlib
from array import array
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import quality_classifier, token_packing
from graphloom.llm.common import written
from graphloom.llm.queries import vocabulary

from .test_text_operators import brute_components, brute_spans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    syllables = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(240):
        w = rng.choices(syllables, k=rng.randint(30, 150))
        text = " ".join(w) if i % 4 else " | ".join(w)
        rows.append([i, text, "en", f"s{min(i % 5, 2)}", len(text)])
    for i in range(240, 300):  # copies, near copies, secrets
        text = rows[(i - 240) * 4 + 1][1]
        words = text.split(" ")
        if i % 3 == 1:
            words[0] = "changed"
        if i % 3 == 2:
            words.append(f"password=secret{i}value")
        text = " ".join(words)
        rows.append([i, text, "en", "s0", len(text)])
    rows += [list(rows[1]), [300, None, "en", "s1", 0], [301, "", "en", None, 0]]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        left[name] = docs.collect()
        assert name == "best_fit_packing" or docs.columns == columns
    start = spark.read.parquet(f"{folder}/documents.parquet")
    scores = quality_classifier.classify(start, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    good = {r.doc_id for r in scores if r.predicted}
    kept = left["quality_classifier"]
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in start.collect() if r.doc_id in good)
    assert {i for i in range(240) if i % 4} <= good and not {i for i in range(240) if not i % 4} & good

    want = {c for _, _, c in brute_components([(r.doc_id, r.text, r.source) for r in kept])}
    unique = left["ngram_jaccard_join"]
    assert Counter(r.doc_id for r in unique) == Counter(want)
    assert len(unique) < len(kept)

    clean = {r.doc_id: r for r in left["secret_scan"]}
    for r in unique:
        new, spans = clean[r.doc_id], brute_spans(r.text)
        assert (new.text == r.text) == (not spans) and not brute_spans(new.text)
        assert r.text is None or new.n_chars == len(new.text)

    mixed = left["source_mixing"]
    assert {r.doc_id for r in mixed} == set(clean) and all(r.text == clean[r.doc_id].text for r in mixed)
    tokens = lambda rows: Counter({s: sum(max(1, len((r.text or "").split())) for r in rows if r.source == s) for s in {r.source for r in rows}})
    before, after = tokens(clean.values()), tokens(mixed)
    repeats = {s: after[s] / before[s] for s in before}
    assert min(repeats.values()) == 1 and max(repeats.values()) <= 1.2 + 200 / min(before.values())

    whole, pieces = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), Counter()
    for r in mixed:
        ids = array("I", [*whole.encode(r.text or "", add_special_tokens=False).ids, 2])
        for k, (a, n) in enumerate(token_packing.cut(len(ids), 1024)):
            pieces[r.doc_id, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in left["best_fit_packing"]) == pieces


def test_near_copies_of_five_words(spark, folder):
    rng = random.Random(7)
    words = [rng.choices([f"w{k}" for k in range(900)], k=150) for _ in range(12)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(words)]
    for i, w in enumerate(words):  # 1 to 3 words changed, apart from each other; with three, 0.89 of three words and 0.81 of five
        rows.append((100 + i, " ".join("new" if k in (20, 60, 100)[: 1 + i % 3] else x for k, x in enumerate(w)), "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, folder).collect())
    assert got == Counter({c for _, _, c in brute_components(rows, 5, 80)})
    assert len(got) < len({c for _, _, c in brute_components(rows)})


def test_empty_corpus(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
