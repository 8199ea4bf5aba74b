import math
import time

import numpy as np

from gridloom.llm import toxicity as tox


def test_folding():
    assert tox.fold("IDI0T 1d1ot іdіоt ｉｄｉｏｔ id́iot").split() == ["idiot"] * 5
    assert tox.fold("Loser l0ser 1o5er").split() == ["ioser"] * 3
    assert tox.fold("réel Äch").split() == ["réei", "äch"]


def test_matches():
    matcher = tox.Matcher({f" {tox.fold('clown')} ": 5.0, " stup": 4.0, " stupid ": 6.0}, ("clown fish",))
    assert matcher.weight("You CL0WN!")[1] == 1
    assert matcher.weight("a clown fish swims")[1] == 0 and matcher.weight("a clown fish and a clown")[1] == 1
    assert matcher.weight("clowns unclown")[1] == 0 and matcher.weight("stupidity stupid")[1] == 2
    assert matcher.weight(None) == (0.0, 0) and matcher.weight("") == (0.0, 0)
    assert matcher.weight("clown " + "fine " * 3000)[0] < matcher.weight("clown")[0]
    # brute force over words
    text = " ".join(["stupid", "stupor", "clown", "clowny", "stup"] * 7)
    assert matcher.weight(text)[1] == sum(w == "clown" or w.startswith("stup") for w in text.split())


def test_curve():
    x = np.array([0, 0, 0, 0, 5, 5, 5, 5.0])
    slope, intercept = tox.fit_curve(x, np.array([0, 0, 0, 0, 1, 1, 1, 1.0]))
    assert slope > 0 > intercept and 5 * slope + intercept > 1


def auc(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from gridloom.llm.common import held_out

    model = tox.train_model(docs, labels)
    rows = tox.score(docs, model).where(held_out()).join(labels, "doc_id").select("score", "toxic").collect()
    assert auc([(r["score"], r["toxic"]) for r in rows]) > 0.9
    hits = [r["score"] >= tox.THRESHOLD for r in rows if r["toxic"]]
    assert np.mean(hits) > 0.8 and np.mean([r["score"] >= tox.THRESHOLD for r in rows if not r["toxic"]]) < 0.02
    changed = labels.withColumn("toxic", labels.toxic)
    flipped = changed.where(~held_out()).unionByName(changed.where(held_out()).selectExpr("doc_id", "quality", "1 - toxic as toxic"))
    assert tox.train_model(docs, flipped).lexicon == model.lexicon


def brute_score(model, text):
    """Score and hits by the definition, word by word."""
    words = tox.fold(text or "").split()
    whole = {e.strip(): w for e, w in model.lexicon.items() if e.endswith(" ")}
    beginnings = {e.strip(): w for e, w in model.lexicon.items() if not e.endswith(" ")}
    phrases = [tox.fold(p).split() for p in model.exceptions]
    excused = {k + i for k in range(len(words)) for p in phrases if words[k : k + len(p)] == p for i in range(len(p))}
    hits, seen = {}, 0
    for k, word in enumerate(words):
        own = [(n, word[:n], False) for n in range(1, len(word) + 1) if word[:n] in beginnings]
        own += [(len(word) + 1, word, True)] if word in whole else []
        if own and k not in excused:
            _, entry, is_whole = max(own)
            hits[entry, is_whole] = hits.get((entry, is_whole), 0) + 1
            seen += 1
    weight = sum((whole if w else beginnings)[e] * (1 + math.log(n)) for (e, w), n in hits.items()) / (1 + math.log1p(len(words) / tox.LENGTH_UNIT))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * weight + model.intercept)))), seen


def test_scores_against_brute_force(spark, documents, labels):
    model = tox.train_model(documents, labels)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in tox.score(documents, model, keep_text=False).collect():
        score, hits = brute_score(model, texts[r["doc_id"]])
        assert r["hits"] == hits and abs(r["score"] - score) < 1e-9


def test_exceptions_are_learnt_from_clean_documents(spark):
    harmless, rude = "the rodeo grumbo rides", "you grumbo"
    rows = [(k, f"{harmless} w{k} and more", 0) for k in range(200)] + [(200 + k, f"w{k} {rude} x{k} grumbo y{k} grumbo", 1) for k in range(40)]
    rows += [(300 + k, f"plain text {k}", 0) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = tox.learn_exceptions(frame.withColumnRenamed("toxic", "label"), {" grumbo ": 6.0})
    assert set(found) == {tox.fold("rodeo grumbo"), tox.fold("grumbo rides")}
    matcher = tox.Matcher({" grumbo ": 6.0}, found)
    assert matcher.weight(harmless)[1] == 0 and matcher.weight(rude)[1] == 1


def test_many_exceptions_take_linear_time():
    matcher, took = tox.Matcher({f" {tox.fold('idiot')} ": 5.0}), []
    for n in (5_000, 40_000):
        start = time.time()
        assert matcher.weight("idiot proof " * n)[1] == 0
        took.append(time.time() - start)
    assert took[1] < 24 * took[0] + 0.5


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        model = tox.train_model(odd, rows)
        scored = tox.score(odd, model)
        assert scored.columns == ["doc_id", "text", "_row", "score", "hits"]
        assert all(0 <= r["score"] <= 1 for r in scored.collect()) and scored.count() == odd.count()
        assert tox.drop_toxic(odd, model).columns == odd.columns
    assert tox.score(odd.limit(0), model).collect() == []
