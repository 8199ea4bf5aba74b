import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import toxicity
from tests.llm import test_decontamination, test_line_dedup, test_near_dedup, test_toxicity


def test_stages_on_odd_rows(spark, sf, odd):
    docs = odd.selectExpr("doc_id", "text", "_row as lang", "_row as source", "length(text) as n_chars", "score")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).collect() == []
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_run_against_brute_force(spark, sf, documents, labels):
    """Every stage by its definition, document by document: only the fitted toxicity model is the operator's own."""
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows[0].__fields__ == ["doc_id", "lang", "source", "ids"]
    held = {r["doc_id"]: r for r in documents.collect()}
    model = toxicity.train_model(documents, labels)
    texts = {d: r["text"] for d, r in sorted(held.items()) if test_toxicity.brute_score(model, r["text"])[0] < toxicity.THRESHOLD}
    texts = {d: text for d, (text, _) in test_line_dedup.brute(list(texts.items())).items()}
    texts = {d: texts[d] for d in test_near_dedup.brute_kept(list(texts.items()))}
    items = [(r["item_id"], test_decontamination.dec.words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {d for d, *_ in test_decontamination.every_pair([(d, test_decontamination.dec.words(t)) for d, t in texts.items()], items)}
    texts = {d: t for d, t in texts.items() if d not in found}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    library.no_padding()
    library.no_truncation()
    want = {d: (held[d]["lang"], held[d]["source"], library.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert {r["doc_id"]: (r["lang"], r["source"], r["ids"]) for r in rows} == want and len(rows) == len(want) < len(held)
