import corpus_pipeline
from tarn.llm.common import written
from tarn.llm.toxicity import learned_lexicon, score_text

from .test_chosen_path import plain as near_plain
from .test_grace import plain as exact_plain
from .test_packing import check as check_packing
from .test_secrets import base_spans, entropy_spans

SF = "/root/testdata/sf0.001"


def mask(text):
    spans = sorted((int(a), int(b)) for a, b in (s.split(":")[1:] for s in base_spans(text) + entropy_spans(text)))
    out, at, marked = "", 0, False
    for a, b in spans:
        if a > at or not marked:
            out += text[at:a] + "[SECRET]"
            marked = True
        at = max(at, b)
    return out + text[at:]


def test_run_against_plain_stages(spark, corpus):
    lexicon = learned_lexicon(corpus, SF)
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect() if score_text(r["text"] or "", lexicon) < 0.5]
    stays = {keep for _, keep, _, _ in exact_plain(rows)}
    rows = [r for r in rows if r[0] in stays]
    stays = {i for i, _, component in near_plain(rows) if i == component}
    rows = [(i, mask(t)) for i, t in rows if i in stays]
    found = corpus_pipeline.run(spark, SF).collect()
    check_packing(found, rows)
    assert 0 < len(rows) < corpus.count()


def test_stages_keep_columns_and_bear_all_kinds_of_rows(spark, docs, tmp_path):
    full = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars").dropDuplicates(["doc_id", "text"])
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (full, full.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, str(tmp_path)), name)
            assert now.columns == start.columns and now.schema.simpleString() == start.schema.simpleString()
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
        ids = {r["doc_id"] for r in now.collect()}
        if start is full:
            # Of 1, 2 and 3, and of 7 and 8, one stays; 6 is the longest of the texts without words; 13 is toxic.
            assert ids == {1, 6, 7, None, 9, 10, 11, 12}
