import pickle
import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from tallyroom.llm import langid, toxicity, words

GOOD = "river table window green cloud paper stone music garden letter winter harbour".split()
BAD = "vilex grubbo snarkt".split()


def labelled(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randrange(8, 40))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_scores_and_offsets(spark, frame):
    rows = labelled(random.Random(3), 120)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(1, None), (None, 1), (3, 1), (3, 1)], "doc_id bigint, toxic int")
    more = [(900, None), (901, ""), (902, " \n"), (903, "river " * 40_000 + "vilex"), (904, "green Vilex, snarkt!"), (904, "green Vilex, snarkt!"), (None, "paper")]
    documents = frame([(i, t) for i, t, _ in rows] + more)
    out = toxicity.toxicity(documents, labels, F.col("doc_id") % 4 != 2).collect()
    assert len(out) == len(rows) + len(more)
    score = {r.doc_id: r.score for r in out}
    held = [(i, t) for i, _, t in rows if i % 4 == 2]
    assert all((score[i] >= toxicity.THRESHOLD) == bool(t) for i, t in held)
    assert score[900] == score[901] == score[902] == 0.0 and score[903] >= 0.3 > score[None]
    spans = [[(s.start, s.end) for s in r.offending] for r in out if r.doc_id == 904]
    assert spans == [[(6, 11), (13, 19)]] * 2
    kept = toxicity.reject(documents, toxicity.fit(toxicity.sample_rows(documents, labels, F.lit(True))))
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.score < 0.3}


def test_toxicity_without_rows_or_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxicity(frame([]), none, F.lit(True)).count() == 0
    assert [r.score for r in toxicity.toxicity(frame([(1, "river")]), none, F.lit(True)).collect()] == [0.0]


def test_copies_of_one_text_make_no_offence():
    assert toxicity.offences([(["river", "table", "stone"], 1)] * 30 + [(["green"], 0)] * 30) == set()


def test_language_of_words_and_documents(spark):
    rng = random.Random(4)
    sounds = {"aa": ["ka", "ta", "mo", "ri"], "bb": ["schl", "ung", "eit", "ver"], "cc": ["oux", "eau", "ille", "que"]}
    word = lambda lang: "".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(3, 60))), lang) for i in range(150) for lang in [rng.choice(list(sounds))]]
    mixed = " ".join([word("aa") for _ in range(30)] + [word("cc") for _ in range(8)])
    more = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, mixed, None), (904, "verung " * 30_000, " "), (None, "que", None)]
    documents = spark.createDataFrame([(*r, 1.0, "y") for r in rows + more], "doc_id bigint, text string, lang string, score double, `_text` string")
    out = {r.doc_id: r for r in langid.language(documents, F.col("doc_id") % 5 != 0).collect()}
    assert len(out) == len(rows) + len(more)
    held = [(i, lang) for i, _, lang in rows if i % 5 == 0]
    assert sum(out[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert [(out[i].lang_pred, out[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert out[904].lang_pred == "bb" and 0 <= out[None].score <= 1
    runs = [(r.lang, r.words) for r in out[903].runs]
    assert out[903].lang_pred == "aa" and runs[0][0] == "aa" and runs[-1][0] == "cc" and abs(runs[0][1] - 30) <= 3
    empty = langid.language(documents.limit(0), F.lit(True))
    assert empty.count() == 0
    assert {r.lang_pred for r in langid.predict(documents, None, ["doc_id"]).collect()} == {"und"}


def test_every_language_is_learnt_from_rows_short_enough(spark):
    rows = [(10 * k + i, f"word{k} text", f"l{k:02}") for k in range(70) for i in range(4 if k else 2)]
    rows += [(10_000 + i, "long " * 12_000, "l00") for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    picked = langid.sample_rows(documents, F.lit(True), 2)
    assert sorted(lang for _, lang in picked) == sorted(f"l{k:02}" for k in range(70) for _ in range(2))
    assert all(len(text) < 50 for text, _ in picked)


def test_many_languages_fit_in_bounded_memory(monkeypatch):
    import tracemalloc

    from tallyroom.llm import crf

    monkeypatch.setattr(langid, "BITS", 12)
    rng = random.Random(6)
    sample = [(" ".join(f"{chr(97 + k % 26)}{k}{chr(97 + rng.randrange(26))}o".translate({48 + d: 103 + d for d in range(10)}) for _ in range(60)), f"l{k:02}") for k in range(70) for _ in range(4)]
    tracemalloc.start()
    model = langid.fit(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.languages) == 70 and peak < 1_000_000_000
    assert crf.parts(__import__("numpy").array([True, False, True, False, False, True]), 3) == [(0, 2), (2, 5), (5, 6)]


def test_long_rows_are_left_out_before_rows_are_picked(spark, frame):
    documents = frame([(i, "long " * 5_000) for i in range(40)] + [(100 + i, f"short {i}") for i in range(6)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100 + i, i % 2) for i in range(6)], "doc_id bigint, toxic int")
    assert sorted(toxicity.sample_rows(documents, labels, F.lit(True), 2))[0][0].startswith("short")
    assert len(toxicity.sample_rows(documents, labels, F.lit(True), 3)) == 6


def test_held_out_toxicity_on_the_given_tables(spark):
    from tallyroom.llm import queries

    sf = "/root/testdata/sf0.1"
    held = queries.op1_toxicity(spark, sf).filter("held_out").join(queries.table(spark, sf, "labels"), "doc_id").filter("toxic IN (0, 1)")
    counts = {(r.predicted, r.toxic): r["count"] for r in held.groupBy("predicted", "toxic").count().collect()}
    hits, alarms, misses = (counts.get(k, 0) for k in ((1, 1), (1, 0), (0, 1)))
    assert hits >= 0.9 * (hits + alarms) and hits >= 0.9 * (hits + misses), counts


def test_slices_hold_the_texts_of_one_part():
    batch = pa.RecordBatch.from_pydict({"id": range(44), "text": [None, "", *("x" * 500_000 for _ in range(40)), "\u00e9" * 1_500_000, None]})
    ids, texts = [], []
    tracemalloc.start()
    for part, some in words.slices(batch, "text", 1_000_000):
        assert sum(map(len, some)) <= 1_000_000 or len(some) == 1
        ids += part.column("id").to_pylist()
        texts += [t[:3] + str(len(t)) for t in some]
        del some
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(44)) and texts == ["0", "0", *["xxx500000"] * 40, "\u00e9\u00e9\u00e91500000", "0"]
    assert peak < 8_000_000
    assert not list(words.slices(batch.slice(0, 0), "text")) and [s for _, s in words.slices(batch.slice(0, 2), "text")] == [["", ""]]


def test_a_worker_keeps_one_memory():
    first = words.lasting("a", list)
    assert words.lasting("a", list) is first
    second = words.lasting("b", list)
    assert words.lasting("b", list) is second and words.lasting("a", list) is not first

    class Handle:
        value = pickle.dumps(5)

    kept = words.lasting("a", list)
    assert words.shared(Handle) == 5 and words.lasting("a", list) is not kept
