import math
import zlib

import numpy as np

from gridloom.llm import quality_classifier as qc
from gridloom.llm import queries
from gridloom.llm.common import held_out


def test_sum_of_squares_identity():
    machine = qc.Machine(0.3)
    machine.linear = np.random.default_rng(1).normal(size=len(machine.linear))
    machine.factors = np.random.default_rng(2).normal(size=machine.factors.shape)
    index, value, starts = qc.features([b"some words and some more", b"", b"### a"])
    margins = machine.margins(index, value, starts)
    for k in range(3):
        i, x = index[starts[k] : starts[k + 1]], value[starts[k] : starts[k + 1]]
        pairs = sum(machine.factors[i[a]] @ machine.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(margins[k] - (0.3 + machine.linear[i] @ x + pairs)) < 1e-9


def test_held_out_accuracy(spark, documents, labels):
    machine = qc.train_model(documents, labels)
    rows = qc.score(documents, machine).where(held_out()).join(labels, "doc_id").select("score", "quality").collect()
    assert np.mean([(r["score"] >= qc.THRESHOLD) == bool(r["quality"]) for r in rows]) > 0.95
    again = qc.train_model(documents.repartition(7), labels)
    assert np.allclose(machine.linear, again.linear)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, 0)], "doc_id long, quality int")
    for rows in (labels, labels.limit(0), labels.where("quality = 1")):
        scored = qc.score(odd, qc.train_model(odd, rows))
        assert scored.columns == ["doc_id", "text", "_row", "score"]
        assert all(0 <= r["score"] <= 1 for r in scored.collect()) and scored.count() == odd.count()
    assert qc.score(odd.limit(0), qc.Machine()).collect() == []


def test_one_class(spark, odd):
    for label, share in ((1, 1.0), (0, 0.0)):
        labels = spark.createDataFrame([(k, label) for k in range(7)], "doc_id long, quality int")
        scores = [r["score"] for r in qc.score(odd, qc.train_model(odd, labels)).collect()]
        assert all(abs(s - share) <= 1.01e-4 for s in scores), scores
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in qc.score(odd, qc.train_model(odd, labels.limit(0))).collect())


def plain_features(text):
    """{feature: value} of a text, one word and one byte after another."""
    words = text.split()
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in counts.values()))
    out = {}
    for w, n in counts.items():
        k = zlib.crc32(w) % qc.BUCKETS
        out[k] = out.get(k, 0.0) + (1 + math.log(n)) / norm
    n, number = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower, digit = (sum(a <= c <= b for c in text) for a, b in ((65, 90), (97, 122), (48, 57)))
    symbols = sum(c in b"#*$%&|<>{}[]\\^~_=+" for c in text)
    stats = [
        math.log(1 + n) / 10, math.log(1 + len(words)) / 10, n / number / 10, upper / n * 2, upper / max(1, upper + lower), digit / n * 4, symbols / n * 8, text.count(b"!") / n * 20, text.count(b"|") / n * 20,
        (text.count(b".") + text.count(b",")) / n * 10, len(counts) / number, max(counts.values(), default=0) / number * 2, len(lines) / number * 10, 1 - len(set(lines)) / max(1, len(lines)),
        sum(c > 127 for c in text) / n, float(len(words) < 20),
    ]
    return out | {qc.BUCKETS + k: float(x) for k, x in enumerate(stats)}


def plain_margin(model, x):
    """All pairs of features through their factors, as the machine is defined."""
    bias, linear, factors = model
    total = bias + sum(linear.get(i, 0.0) * value for i, value in x.items())
    sums = [sum(factors[i][f] * value for i, value in x.items()) for f in range(qc.FACTORS)]
    return total + 0.5 * sum(sums[f] ** 2 - sum((factors[i][f] * value) ** 2 for i, value in x.items()) for f in range(qc.FACTORS))


def plain_fit(rows):
    """Adam over batches, feature by feature; rows: (features, label). Only what is drawn at random comes from the same generator."""
    start = np.random.default_rng(qc.SEED).normal(0, 0.01, (qc.BUCKETS + 16, qc.FACTORS))
    share = sum(label for _, label in rows) / len(rows)
    bias, linear, factors, moments = math.log(share / (1 - share)), {}, {}, {}
    for x, _ in rows:
        for i in x:
            linear[i], factors[i] = 0.0, start[i].tolist()
            moments[i] = [[0.0, 0.0] for _ in range(1 + qc.FACTORS)]
    rng = np.random.default_rng(qc.SEED)
    for epoch in range(qc.EPOCHS):
        order, rate = rng.permutation(len(rows)), qc.STEP * (1 - epoch / qc.EPOCHS) + 1e-4
        for at in range(0, len(order), qc.BATCH):
            batch = [rows[k] for k in order[at : at + qc.BATCH]]
            errors = [1 / (1 + math.exp(-max(-30, min(30, plain_margin((bias, linear, factors), x))))) - label for x, label in batch]
            slopes = {}
            for (x, _), error in zip(batch, errors):
                sums = [sum(factors[i][f] * value for i, value in x.items()) for f in range(qc.FACTORS)]
                for i, value in x.items():
                    own = slopes.setdefault(i, [0.0] * (1 + qc.FACTORS))
                    own[0] += error / len(batch) * value
                    for f in range(qc.FACTORS):
                        own[1 + f] += error / len(batch) * value * (sums[f] - factors[i][f] * value)
            bias -= rate * sum(errors) / len(errors)
            for i, own in slopes.items():
                for p, g in enumerate(own):
                    g += qc.DECAY * (linear[i] if p == 0 else factors[i][p - 1])
                    m = moments[i][p]
                    m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                    step = rate * m[0] / (math.sqrt(m[1]) * 3 + 1e-8)
                    if p == 0:
                        linear[i] -= step
                    else:
                        factors[i][p - 1] -= step
    return bias, linear, {i: factors.get(i) or start[i].tolist() for i in range(qc.BUCKETS + 16)}


def test_query_against_a_plain_machine(spark):
    """Features, fit and scores of the whole query a second time, without arrays."""
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    known = sorted(d for d in labels if d in docs and zlib.crc32(str(d).encode()) % 3 != 1)
    model = plain_fit([({i: float(np.float32(x)) for i, x in plain_features(docs[d]).items()}, labels[d]) for d in known])
    found = {r["doc_id"]: r for r in queries.op9_quality_classifier(spark, folder).collect()}
    assert found.keys() == docs.keys()
    for d, text in docs.items():
        want = 1 / (1 + math.exp(-max(-30, min(30, plain_margin(model, plain_features(text))))))
        assert abs(found[d]["score"] - want) < 1e-4, d
        assert found[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and found[d]["predicted"] == int(found[d]["score"] >= 0.5)
