"""Operators on documents against brute force, with nulls, empties, repeats, clashing names and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tapeloom.llm import langid, mixing, near_dups, pieces, secrets, sharding, toxicity
from tapeloom.llm.mixing import _settle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stock):
    return [rng.choice(stock) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    stock = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)]
             for lang, letters in (("en", "abcdefgh"), ("de", "hijklmnü"), ("fr", "opqrstué"))}
    out, base = [], {}
    for i in range(160):
        lang = ("en", "de", "fr")[i % 3]
        if i % 8 == 7 and lang in base:
            text = list(base[lang])
            for _ in range(i % 5):
                text[rng.randrange(len(text))] = "changed%d" % rng.randrange(50)
        else:
            text = words(rng, rng.randint(60, 120), stock[lang])
            base[lang] = text
        out.append((i, " ".join(text), lang, f"src{i % 4}", 0))
    out += [(200, None, None, None, None), (201, "", "en", "", 0), (202, "  \n\t ", "en", "src0", 5), (203, "one two", None, None, 7),
            (204, "One  TWO", "en", "src1", 8), (205, "!!! 123", "de", "src2", 7), (206, "x" * 5000, "en", "src0", 5000),
            (207, out[0][1], "en", "src1", 0), (207, out[0][1], "en", "src1", 0), (None, "lost words here", "fr", "src3", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) >= 5:
        return {tuple(w[i: i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def test_near_duplicates_equal_brute_force(docs, rows):
    unique = {r[0]: r[1] for r in rows if r[0] is not None}
    sets = {i: shingle_set(t) for i, t in unique.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_dups.near_duplicates(docs.withColumnRenamed("lang", "kept").withColumnRenamed("source", "node")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == find(r["doc_id"]) and r["kept"] == (r["doc_id"] == find(r["doc_id"]))
    assert sum(not r["kept"] for r in got) > 5
    assert sorted(near_dups.one_of_each(docs).columns) == sorted(docs.columns)


def test_texts_under_one_id_are_judged_one_by_one(spark):
    """Of id 5 one text copies id 1 and goes; the other two are nowhere else and stay, however rows are dealt."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(1, text["a"], 1), (5, text["a"], 1), (5, text["b"], 3), (5, text["b"], 2), (5, text["c"], 1), (6, text["c"], 1),
            (7, None, 1), (7, text["d"], 1), (None, text["d"], 1), (None, text["d"], 1)]
    want = [(None, text["d"], 1)] * 2 + [(1, text["a"], 1), (5, text["b"], 2), (5, text["c"], 1), (7, None, 1), (7, text["d"], 1)]
    for order in rows, rows[::-1]:
        got = near_dups.one_of_each(spark.createDataFrame(order, "doc_id long, text string, n int").repartition(3)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rest_join_finds_links_between_members(spark):
    """Three texts in a chain: the ends differ too much, every link counts."""
    base = [f"w{i}" for i in range(200)]
    a, c = list(base), list(base)
    for k in range(3):
        a[10 + 60 * k], c[30 + 60 * k] = f"a{k}", f"c{k}"
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(base)), (3, " ".join(c))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_scan_equals_brute_force(spark, rows):
    key = "AKIA" + "ABCD1234EFGH5678"
    hexes = hashlib.sha256(b"x").hexdigest()[:40]
    odd = "q7Zt+9Lw/Kd2Xv8RbN4mYc1HsJ6gPf3Te5Ua0Wo"
    more = [f'é {key} token = "{hexes}" end', f"password=abc secret=token: abcdefgh {hexes}", f"API_KEY:'{hexes}'" * 300, odd + " plain text",
            "Secret=" + "x" * 6, "passwd : y", "_".join(rows[0][1].split()[:6]) + " plain", "tokenſecret=abcdefg", "api-key=abcdefgh", "apikey=abcdef"]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    got = secrets.scan(docs).collect()
    texts = {**{r[0]: r[1] for r in rows}, **{1000 + i: t for i, t in enumerate(more)}}
    for r in got:
        want = base_spans(texts[r["doc_id"]] or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w[1] == k for w in want) for k in range(3)]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    by = {r["doc_id"]: r["spans"] for r in got}
    assert by[1003] == f"markov:0:{len(odd)}" and by[1006] == ""
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs.withColumnRenamed("text", "t").withColumnRenamed("t", "text")).collect()}
    assert clean[1000] == 'é [SECRET] [SECRET]" end' and clean[200] is None and clean[0] == texts[0]


def test_mix_reaches_targets(spark, docs, rows):
    plan = mixing.mix_plan(docs).collect()
    assert sum(r["n"] for r in plan) == len(rows)
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in plan:
        s = r["source"]
        assert 0 <= r["copies"] <= 2
        sizes[s] = sizes.get(s, 0) + r["n"] * r["size"]
        taken[s] = taken.get(s, 0) + r["n"] * r["size"] * r["copies"]
        target[s], largest[s] = r["target"], max(largest.get(s, 0), r["n"] * r["size"])
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(order, [3, 1, 2] * 3))
    goal, free = 1.5 * sum(sizes.values()), set(order)
    want = {}
    while True:
        level = (goal - sum(want.values())) / max(1e-12, sum(weight[s] for s in free))
        full = {s for s in free if weight[s] * level > 2 * sizes[s] + 1e-9}
        if not full:
            break
        want.update({s: 2.0 * sizes[s] for s in full})
        free -= full
    want.update({s: weight[s] * level for s in free})
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    again = {(r["id"], r["source"], r["size"]): r["copies"] for r in mixing.mix_plan(docs.repartition(5)).collect()}
    assert again == {(r["id"], r["source"], r["size"]): r["copies"] for r in plan}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["n"] * r["copies"] for r in plan)


def test_pivotal_pairs_keep_the_words(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(0)
    n = 500
    group = pd.DataFrame({"id": range(n), "source": "s", "size": rng.integers(1, 50, n), "n": 1, "p": 0.3, "sid": 1, "node": 0})
    out = _settle(group, False)
    assert ((out["p"] > 1e-9) & (out["p"] < 1 - 1e-9)).sum() <= 1
    assert (out["size"] * out["p"]).sum() == pytest.approx((group["size"] * 0.3).sum())


def test_shards_are_even_and_gapless(docs, rows):
    got = sharding.text_shards(docs.withColumnRenamed("lang", "shard").withColumnRenamed("source", "weight"), shards=4).collect()
    assert len(got) == len(rows)
    total = {}
    for r in got:
        total.setdefault(r["shard"], []).append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    for shard in total.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    byte_sums = [sum(r["size"] for r in s) for s in total.values()]
    assert max(byte_sums) - min(byte_sums) <= 2 * 5001
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in got)
    empty = sharding.text_shards(docs.limit(0))
    assert empty.count() == 0


def test_pieces_round_trip_and_equal_the_library(spark, docs):
    import sentencepiece

    plain = pieces.encode(docs, dropout=0.0).select("text", "piece_ids").collect()
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    assert all(r["piece_ids"] == (None if r["text"] is None else sp.encode(r["text"])) for r in plain)
    hard = spark.createDataFrame([(1, "▁a ▁▁b  c"), (2, "日本 🤖\n\tx"), (3, " lead and trail "), (4, "ab" * 400), (5, None), (6, "")], "doc_id long, text string")
    got = pieces.summary(hard.unionByName(docs.select("doc_id", "text"))).collect()
    assert all(r["lossless"] for r in got)
    varied = pieces.encode(docs, dropout=0.3).select("doc_id", "piece_ids").collect()
    assert sum(len(r["piece_ids"] or []) for r in varied) > sum(len(r["piece_ids"] or []) for r in plain)
    again = pieces.encode(docs.repartition(5), dropout=0.3).select("doc_id", "piece_ids").collect()
    assert {r["doc_id"]: r["piece_ids"] for r in varied} == {r["doc_id"]: r["piece_ids"] for r in again}


def test_every_occurrence_drops_at_the_rate(spark):
    """One merge of a frequent word is skipped at the rate of dropout, and occurrences do not share their ways."""
    merger = pieces.Merger(pieces.model_bytes(), 0.1, 7)
    for unit in "a", "i":
        docs = spark.createDataFrame([(k, " ".join([unit] * 2000)) for k in range(20)], "doc_id long, text string")
        rows = [r["piece_ids"] for r in pieces.encode(docs, dropout=0.1).collect()]
        assert abs(sum(len(r) - 2000 for r in rows) / 40000 - 0.1) < 0.008
    word, long = " international", "https://" + "ab" * 60
    texts = [word[1:] + (word * 499) for _ in range(20)] + [long] * 40
    ids, counts = merger.encode(texts, np.arange(60, dtype=np.uint64))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert len({tuple(p) for p in parts[20:]}) == 40
    cut = [merger.text[i] for p in parts[:20] for i in p.tolist()]
    ways, own = set(), ()
    for piece in cut:
        own += (piece,)
        if b"".join(own) == word.encode():
            ways.add(own)
            own = ()
    assert not own and len(ways) > 40


def test_joint_and_single_agendas_agree():
    merger = pieces.Merger(pieces.model_bytes(), 0.3, 7)
    unit = [pieces.SPACE, *map(ord, "unbelievablyinternational")]
    symbols = merger.char[unit]
    keys = pieces.mix(np.arange(300, dtype=np.uint64))
    out, counts = merger.segment(np.tile(symbols, (300, 1)), np.full(300, len(unit)), keys)
    assert all(merger.agenda(symbols.tolist(), int(k)) == o[:n].tolist() for k, o, n in zip(keys, out, counts))
    assert len({tuple(o[:n]) for o, n in zip(out, counts)}) > 100


def test_languages_are_told_apart(docs):
    got = {r["doc_id"]: r for r in langid.identify(docs.withColumnRenamed("source", "score")).collect()}
    labels = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held)
    assert sum(got[i]["lang_pred"] == labels[i] for i in held) >= 0.95 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 202, 205))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(docs.limit(0)).count() == 0


def test_long_texts_count_like_short_ones(monkeypatch):
    text = "Ein Satz, der länger ist — als das Stück. " * 40
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.array_equal(np.sort(np.concatenate(list(langid.grams(text)))), whole)
    words_whole = np.unique(np.concatenate(list(toxicity.slots(text))))
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert np.array_equal(np.unique(np.concatenate(list(toxicity.slots(text)))), words_whole)


def test_toxicity_learns_from_allowed_labels_only(spark):
    rng = random.Random(5)
    stock = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    bad = ["vilest", "rotten", "scummy", "foulest"]
    texts, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = words(rng, 40, stock) + (rng.sample(bad, 3) if toxic else [])
        rng.shuffle(text)
        texts.append((i, " ".join(text)))
        # Labels of held-out rows are wrong on purpose: they must not matter.
        labels.append((i, int(toxic) if zlib.crc32(str(i).encode()) % 3 != 1 else int(not toxic)))
    docs = spark.createDataFrame(texts + [(2000, None), (2001, "")], "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, told).collect()}
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in range(900)) >= 890
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[2000]["score"] == got[2001]["score"] < 0.5
    none = toxicity.score(docs, told.limit(0)).collect()
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in none)


def test_texts_with_very_many_secrets(spark):
    """Twenty thousand hits in one text: places, counts and redaction, in near linear time."""
    rng = random.Random(8)
    parts, at, spans = [], 0, []
    for i in range(20_000):
        gap = rng.choice([" ", "\n", "é ", " word ", ", "])
        hit = hashlib.md5(str(i).encode()).hexdigest()
        spans.append((at + len(gap), at + len(gap) + 32))
        parts += [gap, hit]
        at += len(gap) + 32
    text = "".join(parts)
    rows = spark.createDataFrame([(1, text, "x"), (2, "nothing here", "y"), (3, None, "z")], "doc_id long, text string, _base string")
    got = {r["doc_id"]: r for r in secrets.scan(rows).collect()}
    listed = ",".join(f"hex:{a}:{b}" for a, b in spans)
    assert got[1]["n_hex"] == 20_000 and got[1]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and got[3]["n_hex"] == 0
    clean = {r["doc_id"]: r for r in secrets.redact(rows).collect()}
    assert clean[1]["text"] == "".join(parts[i] if i % 2 == 0 else secrets.MARK for i in range(len(parts)))
    assert clean[2]["text"] == "nothing here" and clean[3]["text"] is None and clean[1]["_base"] == "x"
