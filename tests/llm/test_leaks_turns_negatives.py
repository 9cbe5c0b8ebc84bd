"""Decontamination, conversation repair and hard negatives against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import decontam, hard_negatives, turn_repair

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def brute_leaks(text, items, n=10):
    own = [w for w, _, _ in words_of(text)]
    hit, found = set(), set()
    for item, body in items:
        w = [x for x, _, _ in words_of(body)]
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(own) - size + 1):
                if own[i: i + size] == w[k: k + size]:
                    hit.update(range(i, i + size))
                    if item is not None:
                        found.add(str(item))
    return len(own), hit, sorted(found)


@pytest.fixture(scope="module")
def leak_rows():
    rng = random.Random(5)
    stock = ["wort", "Über", "a1", "the", "of", "日本", "x", "Été", "tree", "42"]

    def text(n):
        return "".join(rng.choice(stock) + rng.choice([" ", ", ", ".\n", "-", "\x00 "]) for _ in range(n))

    items = [(i, text(rng.randint(1, 40))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "?!"), (None, text(15)), (7, items[3][1]), (30, items[3][1]), (31, "Kurz UND gut")]
    docs = [(i, text(rng.randint(0, 60)) + (rng.choice(items)[1] or "") * rng.choice([0, 1, 2]) + text(20), "s") for i in range(60)]
    docs += [(100, None, "s"), (101, "", "s"), (102, items[0][1], None), (102, items[0][1], None), (None, items[1][1], "s"), (103, "kurz, und gut!", "s"),
             (104, text(300) + items[4][1].upper(), "s"), (105, "…" * 50, "s")]
    return items, docs


@pytest.mark.parametrize("part_bytes", [decontam.PART_BYTES, 4000])
def test_leaks_equal_brute_force(spark, leak_rows, part_bytes):
    items, docs = leak_rows
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string, _leak string").repartition(3)
    got = [tuple(r) for r in decontam.summary(rows, bench, part_bytes=part_bytes).collect()]
    want = []
    for key, body, _ in docs:
        n, hit, found = brute_leaks(body, items)
        want.append((key, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[2] for w in want) and not all(w[5] for w in want)

    cut = {(r["doc_id"], r["_leak"]): r["text"] for r in decontam.decontaminate(rows, bench, mark="#", part_bytes=part_bytes).collect()}
    for key, body, other in docs:
        if body is None:
            assert cut[key, other] is None
            continue
        _, hit, _ = brute_leaks(body, items)
        out, at = "", 0
        spans = words_of(body)
        for a, b in decontam.merged([(i, i + 1) for i in hit]):
            out += body[at: spans[a][1]] + "#"
            at = spans[b - 1][2]
        assert cut[key, other] == out + body[at:]
    left = decontam.decontaminate(rows, bench, remove="documents", part_bytes=part_bytes)
    assert left.columns == rows.columns and left.count() == sum(not w[5] for w in want)


def test_leaks_of_empty_tables(spark, leak_rows):
    items, docs = leak_rows
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert decontam.summary(rows.limit(0), bench).count() == 0
    clean = decontam.summary(rows, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] or r["n_items"] for r in clean)
    with pytest.raises(ValueError):
        decontam.find_leaks(rows, bench, "source")


def test_words_of_long_texts_cross_chunks(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["ab", "é", " ", "-", "日本語" * 40, "Zz9"]) for _ in range(3000)).encode()
    data = np.frombuffer(text, np.uint8)
    offsets = np.array([0, len(data)])
    whole = decontam.word_table(data, offsets)
    monkeypatch.setattr(decontam, "CHUNK", 64)
    parts = decontam.word_table(data, offsets)
    for a, b in zip(whole, parts):
        assert (a == b).all()
    assert [(text[:a].decode(), text[a:b].decode().lower()) for a, b in zip(parts[1], parts[2])] == [
        (text.decode()[:a], w) for w, a, _ in words_of(text.decode())]


# ---------------------------------------------------------------- conversations


def plain_cheapest(kinds, initials, start, goals):
    """All labels of the lattice, relaxed until nothing changes."""
    best = {(0, start): (0, "")}

    def offer(node, way):
        if node not in best or way < best[node]:
            best[node] = way
            return True
        return False

    for i in range(len(kinds) + 1):
        changed = True
        while changed:
            changed = False
            for q in range(4):
                if (i, q) in best:
                    for to in "ua":
                        if (q, to) in turn_repair.STEP:
                            changed |= offer((i, turn_repair.STEP[q, to]), (best[i, q][0] + 5, best[i, q][1] + "I"))
        if i == len(kinds):
            break
        for q in range(4):
            if (i, q) not in best:
                continue
            cost, audit = best[i, q]
            offer((i + 1, q), (cost + 2, audit + "D"))
            if kinds[i] in (0, 3):
                extra = 5 if kinds[i] == 3 else 0
                for letter, price, to in [("K", 0, initials[i]), ("R", 1, "u"), ("R", 1, "a")]:
                    if (q, to) in turn_repair.STEP:
                        offer((i + 1, turn_repair.STEP[q, to]), (cost + price + extra, audit + letter))
    return min((best[len(kinds), q] for q in goals if (len(kinds), q) in best), default=None)


def test_search_equals_plain_labels():
    rng = random.Random(9)
    for _ in range(1500):
        n = rng.randint(0, 9)
        kinds = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        initials = [rng.choice(["u", "a", "s", "u", "a", "t", ""]) for _ in range(n)]
        assert turn_repair.cheapest(kinds, initials, 0, (0, 3)) == plain_cheapest(kinds, initials, 0, (0, 3))
        q, p = rng.randrange(4), rng.randrange(4)
        assert turn_repair.cheapest(kinds, initials, q, (p,)) == plain_cheapest(kinds, initials, q, (p,))


def brute_report(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        name = [" " if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(name).encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        kinds, seen = [], set()
        for _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            kinds.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = plain_cheapest(kinds, initials, 0, (0, 3))
        made, q, rest = [], 0, iter(own)
        for letter in audit:
            row = next(rest) if letter != "I" else None
            if letter == "D":
                continue
            role = row[1] if letter == "K" else "assistant" if q == 2 else "user"
            made.append((role, "" if letter == "I" else row[2]))
            q = turn_repair.STEP[q, role[0]]
        turns = [t for t, _, _ in own if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count(1), kinds.count(2), kinds.count(3),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out, convs


@pytest.fixture(scope="module")
def talk_rows():
    rng = random.Random(4)
    lines = ["Yes.", "No!", "what?", "cut off", "", "  ", "Ünder. ", "x.\n", "line\nline."]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 12)):
            if rng.random() < 0.9:
                rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None]), rng.choice([*lines, None])))
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t // 3}." if t % 7 else "cut") for t in range(900)]
    rows += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (90, None, None, None), (91, None, "", "x."), (92, 5, "user", "same."), (92, 5, "user", "same.")]
    rows += [(93, 1, "user", "hot.")] * 700
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_report_equals_brute_force(spark, talk_rows, block, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    monkeypatch.setattr(turn_repair, "SMALL_RANGE", 100)
    monkeypatch.setattr(turn_repair, "RANGE", 300)
    rows = spark.createDataFrame(talk_rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1)).repartition(3)
    want, _ = brute_report(talk_rows)
    names = rows.select(F.col("conv_id").alias("conv"))
    got = {r["conv"]: tuple(r)[1:] for r in turn_repair.report(turn_repair.damage(rows), names, "conv").collect()}
    assert got == want
    turns = turn_repair.repair(turn_repair.damage(rows), "conv").collect()
    for conv, own in want.items():
        mine = sorted((r["place"], f"{r['role']}:{r['text']}") for r in turns if r["conv"] == (None if conv is None else str(conv)))
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(x for _, x in mine).encode()).hexdigest() == own[7]


def test_report_of_nothing(spark, talk_rows):
    rows = spark.createDataFrame(talk_rows, "conv_id long, turn long, role string, text string")
    assert turn_repair.report(rows.limit(0), rows.select("conv_id").limit(0)).count() == 0
    gone = turn_repair.report(rows.limit(0), rows.select("conv_id").where("conv_id = 3")).collect()
    assert [tuple(r) for r in gone] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# ---------------------------------------------------------------- negatives


@pytest.fixture(scope="module")
def marked(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 6))
    rows = [(i, (centres[i % 9] + 0.4 * rng.normal(size=6)).tolist(), int(rng.integers(0, 4)), "x") for i in range(900)]
    rows += [(2000 + i, rows[10][1], i % 3, "x") for i in range(400)]
    rows += [(5000, None, 1, "x"), (5100, rows[3][1], None, "x"), (5200, [float("nan")] * 6, 0, "x"), (5300, [None] * 6, 0, "x"), (5400, [1.0] * 2, 0, "x"),
             (5500, [0.0] * 6, 0, "x"), (5600, [1.0] * 6, 99, "x"), (None, [1.0] * 6, 0, "x"), (100, rows[100][1], rows[100][2], "y")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string").repartition(4)


def brute_negatives(rows, every, n_pos, n_neg, low, high):
    own = {r["vec_id"]: (np.floor(np.array(r["embedding"]) * 256), r["label"]) for r in rows if r["vec_id"] is not None and r["label"] is not None
           and r["embedding"] is not None and len(r["embedding"]) == 6 and all(x is not None and np.isfinite(x) for x in r["embedding"])}
    ids = np.array(sorted(own))
    points, labels = np.array([own[i][0] for i in ids]), np.array([own[i][1] for i in ids])
    out = set()
    for a in np.flatnonzero(ids % every == 0):
        scores = (points @ points[a]).astype(np.int64)
        order = np.lexsort((ids, -scores))
        for p in [i for i in order if i != a and labels[i] == labels[a]][:n_pos]:
            fits = [i for i in order if labels[i] != labels[a] and low * scores[p] <= 100 * scores[i] <= high * scores[p]][:n_neg]
            out |= {(int(ids[a]), int(ids[p]), r + 1, int(ids[i]), int(scores[p]), int(scores[i])) for r, i in enumerate(fits)}
    return out


@pytest.mark.parametrize("shard_rows", [4096, 120])
def test_negatives_equal_brute_force(marked, shard_rows):
    steps = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    got = hard_negatives.mine(marked, every=20, prepare=steps, shard_rows=shard_rows).collect()
    want = brute_negatives(marked.collect(), 20, 5, 10, 30, 90)
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 500
    assert hard_negatives.mine(marked.limit(0)).count() == 0
    assert hard_negatives.mine(marked.where("vec_id = 100")).count() == 0


def test_cover_tree_invariants_and_pruning():
    rng = np.random.default_rng(3)
    points = np.round(np.repeat(rng.normal(size=(12, 5)), 150, axis=0) * 40 + rng.normal(size=(1800, 5)))
    norm2 = float((points ** 2).sum(axis=1).max())
    tree = hard_negatives.CoverTree.build(np.arange(1800), np.zeros(1800, np.int64), points, norm2, leaf=16)
    lifted = np.hstack([tree.points, np.sqrt(np.maximum(norm2 - (tree.points ** 2).sum(axis=1), 0))[:, None]])
    assert sorted(tree.ids) == list(range(1800))
    anchor = points[5]
    scaled = np.append(anchor * (tree.norm / np.linalg.norm(anchor)), 0.0)
    low, high = tree.bounds(slice(None), scaled, np.linalg.norm(anchor) / tree.norm)
    for i, ((first, last), (begin, end)) in enumerate(zip(tree.children, tree.runs)):
        assert np.sqrt(((lifted[begin:end] - tree.centres[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-6
        scores = tree.points[begin:end] @ anchor
        assert low[i] <= scores.min() and scores.max() <= high[i]
        if last > first:
            assert tree.runs[first][0] == begin and tree.runs[last - 1][1] == end and (tree.centres[first] == tree.centres[i]).all()
            apart = np.linalg.norm(tree.centres[first:last, None] - tree.centres[None, first:last], axis=2)
            assert (apart[np.triu_indices(last - first, 1)] > tree.radius[i] / hard_negatives.SHRINK - 1e-6).all()
    seen = []
    real = tree.points
    tree.points = type("Counted", (), {"__getitem__": lambda self, s: (seen.append(s.stop - s.start), real[s])[1]})()
    best = np.sort(np.delete(real @ anchor, np.flatnonzero(tree.ids == 5)))[::-1][:5]
    got = list(tree.search(5, 0, anchor, [(None, None, -np.inf, np.inf, -np.inf)], 5, True))
    assert [g[3] for g in got] == best.tolist() and sum(seen) < 600
