"""Filter audit, clustering over zone maps and language identification against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from findlake.llm import filter_audit, language_id, queries, zone_maps

CLASHING = "row string, sha string, part string, good string, toxic string, earlier string, letter string, first string, n string, v string, key string, ids string, body string, total string, code string, score string, place string"


def clash(df):
    for field in CLASHING.split(", "):
        name, kind = field.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


# --- filter audit ----------------------------------------------------------------------------


def audited(rows, labels):
    def fails(text):
        ws = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        return {
            "A": len(ws) < 100,
            "B": 100 * len(set(ws)) < 80 * len(ws),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
        }

    quality, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        quality[i] = max(quality[i], int(q == 1))
        toxic[i] = max(toxic[i], int(t == 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    judged = []
    for i, text, lang in rows:
        bad = {k for k, v in fails(text or "").items() if v}
        if i is not None and first[text or ""] < i:
            bad.add("E")
        judged.append((lang or "", bad, quality[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out, shapley = {}, Counter()
    for part in {j[0] for j in judged}:
        for order in itertools.permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            for k, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                own = [j for j in judged if j[0] == part and f in j[1]]
                alone = sum(j[1] == {f} for j in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(own) - len(gone), alone, sum(j[2] for j in gone), sum(j[3] for j in gone)]
                shapley[part, f] += len(gone)
    return {key: (*value, shapley[key[0], key[1][key[2] - 1]]) for key, value in out.items()}


FILTERS = {"A": filter_audit.few_words(100), "B": filter_audit.repeated_words(80), "C": filter_audit.many_capitals(10), "D": filter_audit.holds("[#$%&*|]")}
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_of(spark, rows, labels, folder):
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs.write.parquet(f"{folder}/docs")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(spark.read.parquet(f"{folder}/docs"), marks, FILTERS, copies="E")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in out.collect()}


def test_audit_is_the_filters_applied_in_every_order(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " ", "word", "WORD " * 120, "a# b", "x" * 200_000, " ".join(f"w{k}" for k in range(30_000)), "é ü " * 101, "😀 " * 150]
    for _ in range(120):
        n = rng.choice([5, 99, 100, 140])
        words = [rng.choice(["Aa", "BB", "c", "d%"]) + str(rng.randint(0, rng.choice([20, 400]))) for _ in range(n)]
        texts.append(rng.choice([" ", "\t\n", "\x0b "]).join(words))
    texts += [texts[20]] * 40 + [texts[21]] * 3  # a hot text
    rows = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    rows += [(None, "", "en"), (None, texts[20], "en"), (5, texts[5], "de"), (5, "other", "de")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, len(rows), 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert audit_of(spark, rows, labels, tmp_path) == audited(rows, labels)


def test_audit_of_nothing_and_of_no_failures(spark, tmp_path):
    assert audit_of(spark, [], [], tmp_path / "none") == {}
    fine = [(1, " ".join(f"w{k}" for k in range(100)), "en")]
    got = audit_of(spark, fine, [], tmp_path / "fine")
    assert len(got) == 600 and set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}


# --- clustering ------------------------------------------------------------------------------


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = zone_maps.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(1)
    few = 0
    for _ in range(200):
        v = rng.integers(-40, 40, 6) + rng.integers(-9, 9, (20, 6))
        c = rng.integers(-60, 60, (8, 6))
        near = zone_maps.candidates(v.min(0), v.max(0), c)
        few += len(near) < 8
        want, best = zone_maps.compare(v, c)
        at, distance = zone_maps.compare(v, c[near])
        assert (near[at] == want).all() and (distance == best).all()
    assert few > 100


def clustered(rows, k, rounds, width):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if all(abs(x) < zone_maps.LIMIT for x in r[1])]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "x", r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    cost = Counter()
    for d, c in at:
        cost[c] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, cost[c], sum(cost.values()), shas[c]) for (i, _), (d, c) in zip(kept, at, strict=True))


@pytest.mark.parametrize("scale", [0.3, 90_000.0])
def test_clusters_are_lloyds(spark, scale):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6)) * scale
    rows = [(k, [float(np.float32(x)) for x in centres[k % 5] + rng.normal(size=6) * scale / 8]) for k in range(700)]
    rows += [(1000 + k, rows[3][1]) for k in range(400)]  # a hot vector
    odd = [None, [], [1.0] * 5, [1.0] * 7, [None, *[1.0] * 5], [math.nan, *[1.0] * 5], [math.inf, *[1.0] * 5], [1e30, *[1.0] * 5], [-0.00001] * 6, [0.0] * 6]
    rows += [(2000 + k, v) for k, v in enumerate(odd)] + [(7, rows[9][1]), (7, rows[7][1]), (None, rows[1][1]), (None, rows[1][1])]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    place = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    out = zone_maps.cluster(df, k=4, rounds=10, width=6, place=place)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert Counter(tuple(r) for r in out.collect()) == clustered(single, 4, 10, 6)


def test_clusters_of_few_vectors(spark):
    place = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 0.0])], [(1, [1.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        out = zone_maps.cluster(df, k=8, rounds=10, width=2, place=place)
        assert Counter(tuple(r) for r in out.collect()) == clustered(rows, 8, 10, 2)


# --- language --------------------------------------------------------------------------------


def code_length(counts, text):
    """Bits of ``text`` by the definition, byte by byte; ``counts`` are of the grams of one language."""
    body = text.encode("utf-8").translate(language_id._FOLD)
    bits = 0.0
    for k in range(len(body)):
        gram = (b"\0" * language_id.ORDER + body)[k : k + language_id.ORDER + 1]
        for order in range(language_id.ORDER, -1, -1):
            seen = Counter()
            for g, n in counts.items():
                if g[-order - 1 : -1] == gram[-order - 1 : -1]:
                    seen[g[-1]] += n
            if gram[-1] in seen:
                bits -= math.log2(seen[gram[-1]] / (sum(seen.values()) + len(seen)))
                break
            if seen:
                bits -= math.log2(len(seen) / (sum(seen.values()) + len(seen)))
        else:
            bits += 8
    return bits


LEARNT = [("en", "The quick brown fox, 12 times"), ("en", "over the lazy dog"), ("de", "Der schnelle Fuchs über den Hund"), ("fr", "le chien, là-bas"), (None, "zzz"), ("fr", None), ("de", "")]


def learning(rows):
    """Rows with ids whose remainder is not 1."""
    ids = (i for i in itertools.count() if zlib.crc32(str(i).encode()) % 3 != 1)
    return [(next(ids), text, lang) for lang, text in rows]


def test_code_lengths_are_those_of_the_context_trees(spark):
    held = next(i for i in itertools.count() if zlib.crc32(str(i).encode()) % 3 == 1)
    rows = [*learning(LEARNT), (held, "qqqq xxxx", "xx")]
    model = language_id.train(clash(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert model.languages == ["de", "en", "fr"]
    for text in ("the fox", "über", "x", "日本 là", "12 ?", "The lazy chien " * 3):
        want = []
        for lang in model.languages:
            counts = Counter()
            for name, own in LEARNT:
                body = b"\0" * language_id.ORDER + (own or "").encode().translate(language_id._FOLD)
                if name == lang:
                    counts.update(body[k : k + language_id.ORDER + 1] for k in range(len(body) - language_id.ORDER))
            want.append(code_length(counts, text))
        assert np.allclose(model.lengths(text), want, rtol=1e-4), text


def test_pieces_of_a_text_are_the_whole(monkeypatch):
    text = "Ünd the fox, " * 50
    whole = np.concatenate(list(language_id.grams(text)))
    monkeypatch.setattr(language_id, "_PIECE", 7)
    assert (np.concatenate(list(language_id.grams(text))) == whole).all()
    assert not list(language_id.grams(""))


def test_partial_counts_handed_on_early_add_up(spark, monkeypatch):
    rows = [("en", "the quick fox"), ("de", "der Fuchs"), ("en", "the dog")]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})

    def summed():
        total = Counter()
        for out in language_id._counted(iter([batch, batch])):
            for lang, code, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                total[lang, code] += n
        return total

    whole = summed()
    monkeypatch.setattr(language_id, "_PIECE", 2)
    monkeypatch.setattr(language_id, "_HELD", 1)
    assert summed() == whole


def test_language_of_odd_texts(spark):
    model = language_id.train(spark.createDataFrame(learning(LEARNT), "doc_id long, text string, lang string"))
    texts = [None, "", " ", "123 !?", "the the", "le chien " * 200_000, "漢字", "the the"]
    docs = clash(spark.createDataFrame([(k % 7, t, "qq") for k, t in enumerate(texts)] + [(None, "der Hund", None)], "doc_id long, text string, lang string"))
    got = sorted((tuple(r) for r in language_id.predict(docs, model).collect()), key=repr)
    assert len(got) == 9 and [g[1] for g in got if g[0] in (1, 2, 3)] == ["und"] * 3
    assert {g[1] for g in got if g[0] == 5} == {"fr"} and {g[1] for g in got if g[0] == 4} == {"en"} and {g[1] for g in got if g[0] is None} == {"de"}
    assert all(0 <= g[2] <= 1 and (g[2] == 0) == (g[1] == "und") for g in got)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.predict(empty, language_id.train(empty)).isEmpty()
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(empty)).collect()} == {"und"}


def test_held_out_languages_are_found(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and length(text) > 20").select("doc_id", "lang")
    got = queries.op13(spark, sf_dir).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.95
