import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm.subjects import Hasher, document_cells, document_subjects, fit, hashed, parse, sentences, term_numbers, terms_of
from lodestrata.session import table


def test_sentences_and_terms():
    assert list(sentences("# Title\n\n*   One thing rose. Two fell!\nhttps://x.y/z\n12 %")) == [["one", "thing", "rose"], ["two", "fell"]]
    assert list(sentences("Für 3 Ämter")) == [["fuer", "aemter"]] and list(sentences("Waste Ltd sold water.", " waste ltd ")) == [["sold", "water"]]
    words, sizes, per_text = hashed([("A well rose. It fell well.", None), ("", None), ("One two", None)], Hasher())
    assert sizes.tolist() == [2, 3, 2] and per_text.tolist() == [2, 0, 1]
    terms, sentence = terms_of(words, sizes)
    assert sentence.tolist() == [0, 0, 1, 1, 1, 2, 2, 0, 1, 1, 2] and terms[0] == words[4]
    assert set(term_numbers(["one", "two"]).tolist()) == set(terms[sentence == 2].tolist())
    c = document_cells(np.array([5, 5, 9, 5], dtype=np.uint64), np.array([0, 0, 0, 1]))
    assert sorted(zip(c.terms[c.term].tolist(), c.doc.tolist(), np.round(2.0**c.x - 1).tolist())) == [(5, 0, 2.0), (5, 1, 1.0), (9, 0, 1.0)]


def test_held_out_samples(spark):
    sf = "/root/testdata/sf0.01"
    samples = [(r.subject, r.sample_text) for r in table(spark, sf, "subject_samples").orderBy("sample_id").collect()]
    random.Random(3).shuffle(samples)
    known, held = samples[:200], samples[200:]
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", F.col("company").alias("name"))
    model = fit(parse(docs), known).model
    right = wrong = none = 0
    for subject, text in held:
        for s in text.replace("! ", ". ").split(". "):
            k = model.subject(s)
            right, wrong, none = right + (k == subject), wrong + (k not in (None, subject)), none + (k is None)
    assert right >= 0.85 * (right + wrong + none) and wrong <= 0.05 * (right + wrong + none)


def test_few_held_terms_and_repeated_corpora_change_little(spark):
    sf = "/root/testdata/sf0.01"
    docs, samples = table(spark, sf, "documents").select("doc_id", "text", "company"), table(spark, sf, "subject_samples")
    found = lambda d, **k: {tuple(r) for r in document_subjects(d, samples, **k).where("share >= 0.2").select("doc_id", "subject").collect()}
    want = found(docs)
    for got in (found(docs, held=2000), found(docs.crossJoin(spark.range(10)).select("doc_id", "text", "company"))):
        assert len(want & got) >= 0.97 * len(want | got)


def test_frame_cases(spark):
    topics = {"water": ["wells pumped groundwater", "rainwater ponds hold runoff", "aquifer recharge rose"], "waste": ["skips held rubbish", "landfill tonnes fell", "recycled plastics sorted"]}
    rng = random.Random(1)
    samples = spark.createDataFrame([(s, f"The {p} in town. Also {q} here.") for s, ps in topics.items() for p in ps for q in ps] + [(None, "x y"), ("water", None)], "subject string, sample_text string")
    text = lambda s, n: " ".join(f"The {rng.choice(topics[s])} in year {i}." for i in range(n))
    filler = "Terms are explained in the appendix. " * 4
    rows = [(i, text("water" if i % 2 else "waste", 6) + " " + filler, None, "a") for i in range(60)]
    rows += [(100, text("water", 5) + " " + text("waste", 5), None, "b"), (101, None, None, "b"), (102, "", None, "b"), (103, filler, None, "b"), (None, text("waste", 3), "Waste Ltd", "b"), (104, text("water", 4000), None, "b")]
    df = spark.createDataFrame(rows, "doc_id int, text string, company string, subject string")
    got = {(r.doc_id, r.subject) for r in document_subjects(df, samples).where(F.col("share") >= 0.2).select("doc_id", "subject").collect()}
    assert {x for x in got if x[0] is None or x[0] >= 100} == {(100, "water"), (100, "waste"), (None, "waste"), (104, "water")}
    assert {x for x in got if x[0] is not None and x[0] < 60} == {(i, "water" if i % 2 else "waste") for i in range(60)}
    assert document_subjects(df.where("false"), samples).count() == 0
    assert document_subjects(df, samples.where("false")).count() == 0
