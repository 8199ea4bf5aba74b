import duckdb
import numpy as np
import pytest

from gridloom.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["vec_id", "n_links", "component_id", "kept"]


def brute(rows):
    """By all pairs of the (vec_id, vector, label)."""
    fit = lambda x: x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x)
    linked = {k: set() for k in range(len(rows))}
    for k, (_, x, label) in enumerate(rows):
        for m, (_, y, other) in enumerate(rows[:k]):
            if label is not None and label == other and fit(x) and fit(y) and len(x) == len(y):
                a, b = (np.float32(v).astype(float) for v in (x, y))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    linked[k].add(m)
                    linked[m].add(k)
    out = []
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        out.append((row[0], len(linked[k]), min(ids, default=None), bool(ids) and row[0] == min(ids)))
    return sorted(out, key=str)


def found(frame):
    rows = embedding_dedup.near_duplicates(frame)
    assert rows.columns == COLUMNS
    return sorted((tuple(r) for r in rows.collect()), key=str)


def made(seed, groups=12, dim=8):
    """Vectors about a few centres, at distances on both sides of the threshold, and copies."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 25))):
            rows.append((len(rows), [float(np.float32(v)) for v in centre * rng.uniform(0.1, 9) + rng.normal(size=dim) * rng.choice([0, 0.02, 0.08, 0.3])], int(g % 3)))
    return rows + [(1000 + k, rows[k][1], rows[k][2]) for k in range(0, len(rows), 3)] + [(2000, rows[0][1], 99)]


def test_documents(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = found(frame)
    assert rows == brute([(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()])
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    cursor = duckdb.execute(embedding_dedup.ORACLE)
    assert [d[0] for d in cursor.description] == COLUMNS
    assert rows == sorted(cursor.fetchall(), key=str)


@pytest.mark.parametrize("values", [64, 400, 1 << 20])
def test_tiles(spark, monkeypatch, values):
    monkeypatch.setattr(embedding_dedup, "TILE_VALUES", values)
    rows = made(values)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.99, 0.01], 1), (2, [1.0, 0.0], None), (3, [1.0, 0.0, 0.0], 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1),
        (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (None, [2.0, 0.0], 1), (None, [0.0, 1.0], 2), (None, [0.0, 2.0], 2), (10, [1e-30, 0.0], 1), (11, [3e38, 1e37], 1),
        (12, [-0.0, 5.0], 2), (13, [-1.0, 0.0], 1), (14, [5.0], 3), (15, [7.0], 3), (16, [-7.0], 3),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as node", "1 as key")
    assert found(frame) == brute(rows)
    assert found(frame.limit(0)) == []
    assert found(frame.where("label is null")) == [(2, 0, 2, True)]


def test_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE_VALUES", 4096)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    near = [(k, [float(v) for v in centre + rng.normal(size=16) * 1e-3], 0) for k in range(1500)]
    same = [(5000 + k, [float(v) for v in centre], 0) for k in range(1500)]
    assert found(spark.createDataFrame(near + same, SCHEMA)) == sorted([(r[0], 2999, 0, r[0] == 0) for r in near + same], key=str)


def test_partial_products_lose_no_pair():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 30))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.2])
    tile = embedding_dedup.Tile(x, np.linalg.qr(rng.normal(size=(30, 30)))[0])
    i, j = tile.links(tile, 0.98)
    u = embedding_dedup.unit(x)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(u @ u.T >= 0.98))))
