import collections

import corpus_pipeline
import pytest
import sentencepiece
from oracle import compare, duck
from pyspark.sql import functions as F

from tallyroom.llm import pii, queries, toxicity
from tallyroom.llm.shingles import exact

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), queries.QUERIES[name], queries.ORACLES[name], SF) == ""


def test_pipeline_equals_plain_stages(spark):
    documents = queries.table(spark, SF, "documents")
    labels = queries.table(spark, SF, "labels")
    # toxicity by the scores of the operator, the rest by plain Python
    model = toxicity.fit(toxicity.sample_rows(documents, labels, F.lit(True)))
    scores = {r.doc_id: r.score for r in toxicity.score(documents, model, ["doc_id"]).collect()}
    rows = {r.doc_id: r.text or "" for r in documents.collect() if scores[r.doc_id] < toxicity.THRESHOLD}
    sets, holders, root = {i: exact(t) for i, t in rows.items()}, collections.defaultdict(list), {i: i for i in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        shared = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, k in shared.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    items = [exact(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    rows = {i: t for i, t in rows.items() if top(i) == i}
    rows = {i: t for i, t in rows.items() if not any(4 * len(x & sets[i]) >= 3 * len(x) for x in items if x)}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    found = {r.doc_id: r.pii for r in pii.find(documents).select("doc_id", "pii").collect()}
    expected = {}
    for i, text in rows.items():
        out, at = "", 0
        for s in found[i]:
            if s.start >= at:
                out += text[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        expected[i] = library.encode(out + text[at:], add_eos=True)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == expected and len(got) == len(expected)


def test_stages_keep_columns_and_survive_odd_rows(spark):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, `_pii` int"
    odd = spark.createDataFrame(
        [(1, None, None, None, None, 1.0, "a", 1), (2, "", "en", "s", 0, 1.0, "a", 1), (2, "", "en", "s", 0, 1.0, "a", 1), (None, "x", "en", "s", 1, None, None, None),
         (3, "mail a@b.org", "en", "s", 12, 1.0, "a", 1)], columns,
    )
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == rows.columns, name
            docs = out.cache()
        done = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len(done) == (4 if rows is odd else 0)
        if rows is odd:
            assert docs.filter("doc_id = 3").first().text == "mail [EMAIL]" and docs.filter("doc_id = 3").first().n_chars == 12


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "pii", "sentencepiece"]
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
