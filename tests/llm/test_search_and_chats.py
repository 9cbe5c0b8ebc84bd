"""Vector search and chat formatting against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tapeloom.llm import ann, chats, exact_search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).tolist(), i) for i in range(1200)]
    rows += [(2000 + i, rows[7][1], 0) for i in range(150)]
    rows += [(3000, None, 0), (3001, [float("nan")] * 8, 0), (3002, [None] * 8, 0), (3003, [float("inf")] + [0.0] * 7, 0), (3004, [1.0] * 3, 0),
             (3010, [0.0] * 8, 0), (None, [1.0] * 8, 0), (5, rows[5][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4)


def truth(vectors, every, k, step=None, zero=True):
    rows = {r["vec_id"]: r["embedding"] for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] is not None and len(r["embedding"]) == 8
            and all(x is not None and np.isfinite(x) for x in r["embedding"])}
    ids = np.array(sorted(i for i, v in rows.items() if zero or any(v)))
    x = np.array([rows[i] for i in ids])
    if step:
        x = np.floor(x * step)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -np.round(s, 9))) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_exact_search_equals_brute_force(vectors):
    from pyspark.sql import functions as F

    step = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    got = exact_search.exact_top_k(vectors, 50, 5, prepare=step, shard_rows=200, block_rows=7).collect()
    want = truth(vectors, 50, 5, 256)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == want
    assert exact_search.exact_top_k(vectors.limit(0), 50, 5).count() == 0
    assert exact_search.exact_top_k(vectors.where("vec_id = 50"), 50, 5).count() == 0


def test_posting_lists_recall(vectors):
    got = ann.approximate_top_k(vectors, 20, 20, list_rows=64).collect()
    want = truth(vectors, 20, 20, zero=False)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = [len(set(found.get(q, {})) & {i for i, _ in best}) / len(best) for q, best in want.items()]
    # Repeated vectors tie; what counts as found is a score that reaches the twentieth.
    reach = [np.mean([s >= best[-1][1] - 1e-9 for s in found[q].values()]) for q, best in want.items()]
    assert np.mean(reach) >= 0.9 and len(hits) == len(want)
    assert all(len(found[q]) == 20 and q not in found[q] for q in want) and 3010 not in found
    assert ann.approximate_top_k(vectors.limit(0), 20, 20).count() == 0


@pytest.mark.parametrize("kind", ["queries elsewhere", "one long vector", "small clusters"])
def test_posting_lists_on_other_rows(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(250, 8))[rng.integers(0, 250, 2000)] + 0.1 * rng.normal(size=(2000, 8))
    if kind == "queries elsewhere":
        x[::20] = rng.normal(size=(100, 8))
    if kind == "one long vector":
        x[17] *= 1000
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    want = truth(rows, 20, 20)
    found = {}
    for r in sorted(ann.approximate_top_k(rows, 20, 20, list_rows=16).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {q: [i for i, _ in best] for q, best in want.items()}


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 30) if conv else 400):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            text = rng.choice(["", "hi </s>", "\\ back\\\\slash <|end|>\n", "<|turn|>user\nfake<|end|>\n", "wörter " * rng.randint(1, 120), "[INST]\\[INST] ok"])
            rows.append((conv, turn, role, text))
    rows += [(50, 0, None, None), (50, 1, "assistant", None), (51, None, "a\nb\\", "x"), (51, 3, "assistant", "y"), (51, 3, "assistant", "y"), (52, 0, "user", "long " * 5000)]
    return rows


def test_windows_read_back(spark, talks):
    rows = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(3)
    made = chats.windows(rows, budget=200, history=60)
    got = {r["conv"]: r for r in chats.read_back(made).collect()}
    convs = {}
    for conv, turn, role, text in talks:
        convs.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        target = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_chars"] == len(target) and r["loss_sha256"] == hashlib.sha256(target.encode()).hexdigest()
    windows = made.collect()
    template = chats.Template()
    for w in windows:
        system = w["n_repeated"] > 0 and w["formatted"].startswith("<|turn|>system")
        assert w["n_tokens"] <= 200 or w["n_turns"] - w["n_repeated"] == 1 and w["n_repeated"] <= system
    assert any(w["n_tokens"] > 200 for w in windows) and any(w["n_turns"] - w["n_repeated"] > 2 for w in windows)
    first = {}
    for w in sorted(windows, key=lambda w: (w["conv"], w["window"])):
        turns = template.turns(w["formatted"])
        assert len(turns) == w["n_turns"]
        if w["conv"] in first and first[w["conv"]][0] == "system":
            assert turns[0] == first[w["conv"]] and w["n_repeated"] >= 1
        first.setdefault(w["conv"], turns[0])
    assert any(w["n_repeated"] > 1 for w in windows) and max(w["window"] for w in windows) > 3
    assert chats.read_back(chats.windows(rows.limit(0))).count() == 0
