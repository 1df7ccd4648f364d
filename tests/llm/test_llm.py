"""The training-data operators against brute force, on hand-made rows and on the smallest tables."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from findlake.llm import (
    components,
    decontaminate,
    exact_dedup,
    grams,
    jaccard,
    language_model,
    pii,
    queries,
    sentencepiece_bpe,
    sharding,
    toxicity,
    url_filter,
    web_archive,
)

SF = "/root/testdata/sf0.001"
MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")

#: Names that the operators use inside; as extra columns they must not matter.
CLASHING = "row string, rest string, node string, digit string, n int, first string, shared string, token string, block string, base string, label int, score string, gone string, value string, size string, rank string, stratum string, bin string, mark string, root string, word string, side string, positive string"


def documents(spark, texts, folder=None, ids=None, extra=True):
    """Rows ``doc_id, text, lang, source, n_chars`` and clashing columns; from files if ``folder`` is given."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None if k % 3 == 0 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for field in CLASHING.split(", "):
            name, kind = field.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    if folder is None:
        return df
    df.write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def long_text(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


ODD = [None, "", " ", "\t\n", "word", "a b c", "x" * 30_000, long_text(20_000), "ß ü 漢字 😀", "same text here now ok", "same text here now ok"]


# --- shared helpers --------------------------------------------------------------------------


def test_word_hashes_follow_the_words():
    texts = ["The  cat\tsat", "the cat", None, "", "THE", "cat\x0bsat", "é É"]
    hashes, sizes = grams.words(texts)
    assert sizes.tolist() == [3, 2, 0, 0, 1, 2, 2]
    assert hashes[0] == hashes[3] == hashes[5] and hashes[1] == hashes[4] == hashes[6] and hashes[8] != hashes[9]


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = [long_text(300, k) for k in range(5)] + ["y" * 5000, "end"]
    whole = grams.words(texts)
    monkeypatch.setattr(grams, "_BLOCK", 64)
    pieces = grams.words(texts)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 9), (1, 2), (2, 1), (7, 7), (9, 3), *((100 + k, 99) for k in range(50))], "u long, v long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 1: 1, 2: 1, **{k: 99 for k in range(99, 150)}}


# --- 1 ---------------------------------------------------------------------------------------


def plain_spans(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15],
    }


def test_plain_identifiers_match_their_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        letters = rng.choice(["a@. b", "a@.-%+1", "01. ", "12345 -", "+1 ()2.-", "0+.@a 1-", "9.25 0"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.detect(text) == plain_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("mail jane dot roe at example dot co dot uk please", "email", "jane dot roe at example dot co dot uk"),
        ("ＪＯＨＮ＠ｅｘａｍｐｌｅ．ｃｏｍ ok", "email", "ＪＯＨＮ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("jоhn@exаmple.com yes", "email", "jоhn@exаmple.com"),
        ("see john@ex​ample.com", "email", "john@ex​ample.com"),
        ("call plus one four one five five five five two six seven one ok", "phone", "plus one four one five five five five two six seven one"),
        ("card four one one one 1111 one one one one one one one one end", "card", "four one one one 1111 one one one one one one one one"),
        ("host 192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1"),
        ("host one nine two dot one six eight dot one dot two up", "ip", "one nine two dot one six eight dot one dot two"),
    ],
)
def test_disguised_identifiers_map_back(text, kind, value):
    assert [(s.kind, text[s.start : s.end]) for s in pii.scan(text) if s.disguised] == [(kind, value)]


@pytest.mark.parametrize("address", ["jane@example[dot]com", "jane@example (dot) com", "jane@example dot com", "jane @ example dot com", "jane dot roe@example[.]com"])
def test_spelled_dots_behind_a_plain_mark(address):
    text = f"mail {address}, or bob@example.org, or call"
    assert [(s.kind, text[s.start : s.end], s.disguised) for s in pii.scan(text)] == [("email", address, True), ("email", "bob@example.org", False)]
    assert pii.scan("see you @ noon. Dot by dot, @example or 5 @ 2.50") == []


@pytest.mark.parametrize(
    ("kind", "number"),
    [
        ("phone", "+1 415 five five 5 2671"),
        ("phone", "+1-415-five-55-2671"),
        ("card", "4111 1111 1111 111 one"),
        ("card", "411111111111111 one"),
        ("card", "four 111-1111-1111-1111"),
        ("ip", "192.168.0.one"),
        ("ip", "192 dot 168 dot 0 dot one"),
        ("ip", "10.two.3.4"),
    ],
)
def test_numbers_with_few_spelled_digits(kind, number):
    for text in (f"see {number} now", f"({number}; ok)", f'"{number}", 20 people'):
        assert [(s.kind, text[s.start : s.end], s.disguised) for s in pii.scan(text)] == [(kind, number, True)], text


def test_prose_with_few_spelled_digits_has_no_spans():
    for text in ("one of 12 345 678 people", "4111 1111 1111 111 two", "version 1.two.3 of 5", "one 1, two 2, three 3 and 2024", "300.one.2.3"):
        assert pii.scan(text) == []


def test_clean_texts_have_no_spans():
    for text in ("we met at noon", "the dot on the map", "one two three", "un deux trois quatre", "m² and 1² at home", "point by point"):
        assert pii.scan(text) == []


def test_personal_data_of_odd_rows(spark):
    docs = documents(spark, [*ODD, "a@b.co and a@b.co", "漢 +1 (724) 555-7058"])
    got = {r.doc_id: [(s.kind, s.start, s.end, s.value) for s in r.spans] for r in pii.find(docs).collect()}
    assert len(got) == len(ODD) + 2 and all(got[k] == [] for k in range(len(ODD)))
    assert got[len(ODD)] == [("email", 0, 6, "a@b.co"), ("email", 11, 17, "a@b.co")] and got[len(ODD) + 1] == [("phone", 2, 19, "+1 (724) 555-7058")]


@needs_tables
def test_personal_data_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op1_pii"](spark, SF).collect():
        plain = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in plain[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(plain[k]) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))


# --- 2 ---------------------------------------------------------------------------------------


def check_shards(rows, texts, shards):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(sizes.values(), default=0) - min((sizes[k] for k in range(shards)), default=0) <= 1
    slots = defaultdict(list)
    strata = defaultdict(Counter)
    for r in rows:
        slots[r.shard].append(r.slot)
        strata[r.stratum][r.shard] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for counts in strata.values():  # within two of the proportional share
        share = sum(counts.values()) / shards
        assert all(abs(counts[k] - share) <= 2 for k in range(shards))


def test_shards_of_odd_rows(spark):
    texts = ODD * 30
    rows = sharding.stratified_shards(documents(spark, texts), shards=7).collect()
    check_shards(rows, texts, 7)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))
    again = sharding.stratified_shards(documents(spark, texts).repartition(5), shards=7).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == {r.doc_id: (r.shard, r.slot) for r in again}


def test_shards_of_repeated_and_null_ids(spark):
    rows = sharding.stratified_shards(documents(spark, ["a", "a", "b", None], ids=[1, 1, None, None]), shards=3).collect()
    check_shards(rows, range(4), 3)


@needs_tables
def test_sharding_query_follows_the_plain_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    by = defaultdict(list)
    for r in docs:
        by["=" + r.source].append((hashlib.md5(f"1:{r.doc_id}".encode()).hexdigest(), r.doc_id))
    order = sorted(((2 * k + 1) / (2 * len(v)), s, k, i) for s, v in by.items() for k, (_, i) in enumerate(sorted(v)))
    want = {i: p * 24 // len(docs) for p, (*_, i) in enumerate(order)}
    rows = queries.QUERIES["op2_sharding"](spark, SF).collect()
    assert {r.doc_id: r.shard for r in rows} == want and {r.law for r in rows} == {"rows"}


# --- 3 ---------------------------------------------------------------------------------------


def marked(spark, n=600):
    rng = random.Random(5)
    texts, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        words = long_text(40, k).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(["vilestuff", "vilething", "vileword"])
        texts.append(" ".join(words))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    return texts, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    texts, labels = marked(spark)
    docs = documents(spark, [*texts, *ODD])
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    held = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all((got[k] >= 0.7) == (k % 5 == 0) for k in held)
    kept = {r.doc_id for r in toxicity.clean(docs, model, 0.7).collect()}
    assert kept == {k for k, s in got.items() if s < 0.7} and toxicity.clean(docs, model, 0.7).columns == docs.columns
    # held-out labels are not looked at
    turned = labels.withColumn("toxic", F.when(toxicity.learning_part(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, turned)).collect()}
    assert again == got


def test_every_confirmed_document_counts_for_the_features(spark, monkeypatch):
    # a term in few of the confirmed documents, of which the fit sees still fewer
    texts = [f"{long_text(20, k)} {('rareslur' if k % 60 == 0 else 'vilestuff') if k % 5 == 0 else 'kind'}" for k in range(3000)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(3000) if k % 2 == 0 or k % 5 == 0], "doc_id long, toxic int")
    docs = documents(spark, texts)
    every = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "MOST_POSITIVE", 100)
    few = toxicity.train(docs, labels)
    assert few.features.tolist() == every.features.tolist()
    for model in (every, few):
        assert model.score([f"{long_text(20, 1)} rareslur", f"{long_text(20, 1)} kind"])[0] >= 0.7 > model.score([f"{long_text(20, 1)} kind"])[0]


def test_toxicity_without_labels_is_constant(spark):
    docs = documents(spark, ODD)
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score(docs, toxicity.train(docs, nothing)).collect()}) == 1
    some = spark.createDataFrame([(k, None) for k in range(5)] + [(None, 1)], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score(docs, toxicity.train(docs, some)).collect()}) == 1


def test_the_unlabelled_risk_stays_non_negative():
    # every unlabelled row that looks like a positive is one: the model must not call it clean
    rows = [np.array([0])] * 30 + [np.array([1])] * 270
    positive = np.array([k < 20 for k in range(300)])
    weights, bias = toxicity.fit(rows, positive, 2, prior=10 / 280)
    assert weights[0] + bias > 0 > weights[1] + bias


# --- 4 ---------------------------------------------------------------------------------------


def same_texts(ids, texts):
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted(
        (i, min((k for k in v if k is not None), default=None), len(v), i == min((k for k in v if k is not None), default=None), hashlib.sha256(t.encode()).hexdigest())
        for t, v in groups.items()
        for i in v
    )


@pytest.mark.parametrize("widths", [(64, 8), (1, 2)])
def test_exact_copies(spark, monkeypatch, widths):
    monkeypatch.setattr(exact_dedup, "FIRST_WIDTH", widths[0])
    monkeypatch.setattr(exact_dedup, "GROWTH", widths[1])
    base = long_text(200, 1)
    texts = [*ODD, base, base + "!", base, base.replace(" ", " \n\t", 3), " a", "a", "a ", "ab", *[base] * 40, base[:64], base[:64], base[:65], "é" * 40, "é" * 40]
    got = [tuple(r) for r in exact_dedup.exact_dedup(documents(spark, texts)).collect()]
    assert sorted(got) == same_texts(range(len(texts)), texts)


def test_exact_copies_of_repeated_and_null_ids(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup(documents(spark, ["a", "a", "b", "b", "c", "d"], ids=[3, 3, None, 7, None, 3])).select("doc_id", "keep_id", "group_size", "kept").collect()), key=repr)
    assert got == sorted([(3, 3, 2, True), (3, 3, 2, True), (None, 7, 2, False), (7, 7, 2, True), (None, None, 1, True), (3, 3, 1, True)], key=repr)


# --- 5 ---------------------------------------------------------------------------------------


def plain_scores(texts):
    lists = [(t or "").encode().lower().split() for t in texts]
    one, two = Counter(w for ws in lists for w in ws), Counter(p for ws in lists for p in zip(ws, ws[1:], strict=False))
    total = sum(one.values())
    units = lambda x: int(np.rint(math.log(x) * 1e6))
    out = []
    for ws in lists:
        s = units(0.4 * one[ws[0]] / total) - units(0.4) if ws else 0
        for p, k in Counter(zip(ws, ws[1:], strict=False)).items():
            rest = two[p] - k
            s += k * (units(rest / one[p[0]]) if rest else units(0.4 * one[p[1]] / total))
        out.append((len(ws), s))
    return out


@pytest.mark.parametrize("frequent", [50_000, 5])
def test_backoff_scores(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    monkeypatch.setattr(language_model, "SLICE", 2000)
    texts = [*ODD, *[" ".join(random.Random(k).choice(["the", "of", "a", "cat", "dog", f"w{k}"]) for _ in range(60)) for k in range(40)]]
    got = {r.doc_id: (r.n_words, r.log_score) for r in language_model.score(documents(spark, texts, tmp_path / "d")).collect()}
    assert [got[k] for k in range(len(texts))] == plain_scores(texts)


# --- 6 ---------------------------------------------------------------------------------------


def test_arc_versions_and_lengths():
    for version, fields in ((1, 5), (2, 10)):
        body = web_archive.http_head(7, 9) + "a\n\nb\r\n\r\n"
        data = web_archive.arc_head(version, "x.arc", "20200102030405") + web_archive.arc_line(version, "http://a b/é", len(body.encode()), "20200102030405", "text/html", 0, "x.arc") + body + "\n"
        data += web_archive.arc_line(version, "", 0, "20200102030405", "text/html", 0, "x.arc") + "\n"
        (first, block), (second, empty) = web_archive.read_arc(data.encode())
        assert len(first) == fields and first["URL"] == "http://a%20b/é" and block == body.encode() and second["URL"] == "-" and empty == b""
        assert web_archive.split_http(block)[2] == b"a\n\nb\r\n\r\n"
    with pytest.raises(ValueError, match="declares"):
        list(web_archive.read_arc(data.encode() + web_archive.arc_line(2, "u", 50, "1", "m", 0, "n").encode()))
    assert web_archive.iso("19991231235958") == "1999-12-31T23:59:58Z"


def plain_records(pages):
    first = {}
    for i, _, html in pages:
        first[html or ""] = max(first.get(html or "", i), i)
    for i, _, html in pages:
        body = (html or "").encode()
        own = first[html or ""] == i
        yield i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else first[html or ""]


def test_archives_of_odd_pages(spark, tmp_path):
    html = [None, "", "<p>\r\n\r\nWARC/1.1\r\n</p>", "<p>é😀</p>", "<p>é😀</p>", "x" * 3_000_000, "\n\n", *["<b>copy</b>"] * 40]
    pages = [(k, None if k == 1 else f"http://h/{k} x\n", h) for k, h in enumerate(html)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("content", F.lit(1)).withColumn("page", F.lit(2)).withColumn("digest", F.lit(3))
    rows = web_archive.archived(df, keep=str(tmp_path / "warc")).collect()
    got = sorted((int(r.page), r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in rows)
    assert got == sorted(plain_records(pages))
    again = web_archive.warc_records(spark, str(tmp_path / "warc")).collect()
    assert len(again) == len(pages) and len({r.record_id for r in again}) == len(pages)


# --- 7 ---------------------------------------------------------------------------------------


def plain_links(ids, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, i in enumerate(ids)}


def near_texts():
    rng = random.Random(9)
    base = long_text(60, 2).split()
    texts = [" ".join(base)]
    for _ in range(60):  # near copies, many of which link through others only
        words = list(base if rng.random() < 0.6 else texts[-1].split())
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(40)}"
        texts.append(" ".join(words))
    passage = long_text(30, 3)
    texts += [f"{long_text(80, 100 + k)} {passage} {long_text(80, 200 + k)}" for k in range(25)]
    texts += [f"{passage} {long_text(6, 300 + k)}" for k in range(12)]
    return texts + ["A b c d e f", "a B c d e f", "a b", "A  B", "a"]


def test_jaccard_links(spark, tmp_path):
    texts = [*ODD, *near_texts()]
    ids = [1000 - k for k in range(len(texts))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(spark, texts, tmp_path / "d", ids)).collect()}
    assert got == plain_links(ids, texts)


@needs_tables
def test_jaccard_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op7_jaccard"](spark, SF).collect()}
    assert got == plain_links([r.doc_id for r in docs], [r.text for r in docs])


# --- 8 ---------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [None, "", "no scheme/de/", "http://a.org/x", "http://A.Example.ORG/es/1?q", "https://example.org/en/12#t", "https://example.org/en/2", "http://x.com/fr/9", "http://x.com/de/9", "http://xcom/de/", "http://org", "http://org?/", "http://b.net/q"]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("h")).withColumn("gram", F.lit(1)), queries.URL_RULES).collect()}
    assert [rows[k].rule for k in range(len(urls))] == [None, None, None, "org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None]
    assert [rows[k].verdict for k in range(3, 9)] == ["allow", "block", "block", "allow", "allow", "block"]
    assert (rows[4].host, rows[4].path, rows[0].host, rows[2].path, rows[11].host, rows[11].path) == ("a.example.org", "/es/1", "", "", "org", "")
    assert rows[0].verdict == "allow" and rows[0].score is None


@needs_tables
def test_url_scores_follow_the_plain_model(spark):
    rows = queries.QUERIES["op8_url_filter"](spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    size = url_filter.SYMBOLS

    def codes(url):
        rest = url.partition("://")[2]
        return [url_filter.START] * 2 + [url_filter.ALPHABET.find(c.lower() if c.isascii() else c) + 1 for c in rest]

    counts = {k: Counter() for k in ("allow", "block")}
    for r in rows:
        if r.rule:
            c = codes(urls[r.page_id])
            counts[r.verdict].update(zip(c, c[1:], c[2:], strict=False))
    tables = {}
    for kind, three in counts.items():
        two, one = Counter(), Counter()
        context, before = Counter(), Counter()
        for (a, b, c), n in three.items():
            context[a, b] += n
            two[b, c] += n
            before[b] += n
            one[c] += n
        tables[kind] = (three, context, two, before, one, sum(one.values()))

    def log_p(kind, a, b, c):
        three, context, two, before, one, total = tables[kind]
        p1 = (one[c] + 0.5) / (total + 0.5 * size)
        p2 = (two[b, c] + url_filter.LEAN * p1) / (before[b] + url_filter.LEAN)
        return math.log((three[a, b, c] + url_filter.LEAN * p2) / (context[a, b] + url_filter.LEAN))

    for r in rows:
        c = codes(urls[r.page_id])
        want = np.mean([log_p("allow", *g) - log_p("block", *g) for g in zip(c, c[1:], c[2:], strict=False)])
        assert abs(r.score - want) < 2e-6


# --- 9 ---------------------------------------------------------------------------------------


def test_contamination_exact_edited_and_absent(spark):
    items = [long_text(30, 1000 + k) for k in range(6)] + ["too short", None, ""]
    words = items[1].split()
    edited = " ".join(w for k, w in enumerate(words) if k not in (5, 17))
    swapped = " ".join("other" if k % 9 == 4 else w for k, w in enumerate(items[2].split()))
    texts = [
        *ODD,
        f"{long_text(50, 1)} {items[0].upper()}! {long_text(50, 2)}",
        f"{long_text(50, 3)} {edited} {long_text(50, 4)}",
        f"{swapped}, {long_text(10, 5)} {items[3]}",
        f"{long_text(50, 6)} {' '.join(items[4].split()[:8])} {long_text(50, 7)}",
        "too short",
    ]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("seed", F.lit(1))
    docs = documents(spark, texts)
    found = decontaminate.matches(docs, benchmark).collect()
    n = len(ODD)
    assert {(r.doc_id, r.item_id) for r in found} == {(n, 0), (n + 1, 1), (n + 2, 2), (n + 2, 3)}
    by = {(r.doc_id, r.item_id): r for r in found}
    assert by[n, 0].similarity == 1 and (by[n, 0].first_word, by[n, 0].end_word) == (50, 80) and by[n + 1, 1].similarity < 1
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == set(range(len(texts))) - {n, n + 1, n + 2}


def test_contamination_in_blocks_and_of_a_frequent_passage(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    items = [long_text(25, 2000 + k) for k in range(4)]
    texts = [f"{long_text(20, k)} {items[k % 2]} {long_text(20, 100 + k)}" for k in range(30)] + [long_text(60, 500 + k) for k in range(5)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.matches(documents(spark, texts), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, k % 2) for k in range(30)}
    assert {r.doc_id for r in decontaminate.clean(documents(spark, texts), benchmark).collect()} == set(range(30, 35))


def plain_similarity(item, text):
    """Of the best alignment, over all of the text."""
    a, b = item.lower().split(), (text or "").lower().split()
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best / (2 * len(a))


def test_contamination_where_every_copy_is_edited(spark):
    """Most seeds of such an item stand in no document."""
    items = [long_text(n, 3000 + n) for n in (18, 24, 30, 41)]
    texts = [f"{long_text(30, k)} {' '.join('other' if i % 6 == 5 else w for i, w in enumerate(t.split()))} {long_text(30, 50 + k)}" for k, t in enumerate(items)]
    # a frequent half and a rare half of one item
    halved = long_text(32, 4000)
    items.append(halved)
    texts += [f"{long_text(9, 90 + k)} {' '.join(halved.split()[:17])} {long_text(9, 120 + k)}" for k in range(6)] + [" ".join(halved.split()[15:])]
    texts += [long_text(80, 200 + k) for k in range(5)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, texts)
    want = {(d, i): s for d, t in enumerate(texts) for i, item in enumerate(items) if (s := plain_similarity(item, t)) >= decontaminate.SIMILAR}
    assert len(want) == 11
    assert {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(docs, benchmark).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == set(range(11, 16))


def test_alignment_scores_like_the_full_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
                best = max(best, table[i][j])
        assert decontaminate.align(np.array(a), np.array(b))[0] == best


# --- 10 --------------------------------------------------------------------------------------


def test_encoding_matches_the_library():
    own = sentencepiece_bpe.encoder(MODEL)
    rng = random.Random(1)
    texts = ["", " ", "\n", "  a  b ", "▁a▁b", "a\n\nb\tc\r\n", "<s>hi</s> <0x0A>", "\x00a", "ä😀x", "a" * 2000, " " * 300, "==" * 333, "日本語テキスト 한국어", "é̂"]
    for _ in range(3000):
        letters = rng.choice(["abcde ", "aeinrst ", "=-_ \n", "éèàa bn", "0123456789 .", "аеинос ", "▁ a\nß", "the of and ing er "])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))))
    for text in texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == own.library.encode(text, add_bos=True, add_eos=True), text
        assert own.decode(ids) == own.library.decode(own.library.encode(text))


def test_words_are_kept_apart_from_their_marks(monkeypatch):
    own = sentencepiece_bpe.Encoder(MODEL)
    texts = [f"house{a}{b} (house{b}" for a in ".,;:!?)" for b in "\"'1-=/"]
    check = lambda: all(np.frombuffer(own.encode(t), "<u4").tolist() == own.library.encode(t, add_bos=True, add_eos=True) for t in texts)
    assert check() and {w for w in own.kept if "house" in w} == {"house", "▁house"}
    monkeypatch.setattr(sentencepiece_bpe, "KEPT_WORDS", 8)
    for k in range(50):
        own.encode(f"house k{k}x")
    assert len(own.kept) <= 4 and len(own.kept.before) <= 4 and check()


def test_encoding_of_odd_rows(spark):
    lib = sentencepiece_bpe.encoder(MODEL).library
    got = {r.doc_id: r for r in sentencepiece_bpe.encode_documents(documents(spark, ODD), MODEL).collect()}
    for k, text in enumerate(ODD):
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        assert (got[k].n_tokens, np.frombuffer(got[k].ids, "<u4").tolist(), got[k].decoded) == (len(ids), ids, lib.decode(ids))


# --- all of them -----------------------------------------------------------------------------


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, [], tmp_path / "none")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert sharding.stratified_shards(docs).isEmpty() and exact_dedup.exact_dedup(docs).isEmpty() and pii.find(docs).isEmpty()
    assert toxicity.score(docs, toxicity.train(docs, labels)).isEmpty() and language_model.score(docs).isEmpty() and jaccard.near_duplicates(docs).isEmpty()
    assert decontaminate.matches(docs, items).isEmpty() and decontaminate.clean(docs, items).isEmpty() and sentencepiece_bpe.encode_documents(docs, MODEL).isEmpty()
    assert url_filter.judge(pages, queries.URL_RULES).isEmpty() and web_archive.archived(pages).isEmpty()
    some = documents(spark, ODD)
    assert decontaminate.matches(some, items).isEmpty() and decontaminate.clean(some, items).count() == len(ODD)


def pipeline_tables(spark, folder, extra):
    texts, labels = marked(spark, 300)
    benchmark = [(k, long_text(30, 5000 + k)) for k in range(4)]
    clean = [f"{long_text(50, 700 + k)}" for k in range(20)]
    base = clean[0].split()
    near = [" ".join([*base[:-1], f"end{k}"]) for k in range(5)]
    leaks = [f"{long_text(20, 900 + k)} {t}" for k, t in benchmark]
    every = [*texts, *clean, clean[1], clean[1].replace(" ", "\t ", 1), None, "", *near, *leaks]
    documents(spark, every, folder / "documents.parquet", extra=extra)
    labels.withColumn("quality", F.lit(1)).write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return texts, len(every)


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_stages(spark, tmp_path, extra):
    texts, n = pipeline_tables(spark, tmp_path, extra)
    start = len(texts)
    toxic = {k for k in range(start) if k % 5 == 0}
    copies, nulls, near, leaks = {start + 20, start + 21}, {start + 23}, set(range(start + 24, start + 29)), set(range(start + 29, start + 33))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = docs.columns, set(range(n))
    for (name, stage), gone in zip(corpus_pipeline.STAGES, (toxic, copies | nulls, near, leaks, set()), strict=True):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left -= gone
        assert {r.doc_id for r in docs.select("doc_id").collect()} == left, name
        assert name == "sentencepiece" or docs.columns == columns
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids_sha256 for r in rows} == {r.doc_id: r.ids_sha256 for r in docs.collect()}
