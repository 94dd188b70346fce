"""The operators against plain versions of what they compute."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.llm import decontam, langid, mixing, pii, queries, quotes, warc
from trailmark.llm.components import components

WORD = re.compile(r"[^ \t-\r]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


AUTOMATON = pii.anchors()


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1234567890@.+-() %é\n0055", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    found = [x for x in pii.spans_of(text, AUTOMATON) if x[1] < 4]
    assert found == base_spans(text)


def test_spans_that_the_method_adds():
    text = "IBAN: DE89370400440532013000, see https://a.example/x?y=1. SSN 123-45-6789 token = \"abcdef0123456789\" at 12 Main Street (826) 555-7388"
    kinds = [pii.KINDS[k] for _, k, _ in pii.spans_of(text, AUTOMATON)]
    assert {"iban", "url", "ssn", "secret", "address", "local_phone"} <= set(kinds)
    assert pii.redacted("mail a@b.c now", pii.spans_of("mail a@b.c now", AUTOMATON)) == "mail [EMAIL] now"


def test_query_pii(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op1_pii(spark, sf).collect():
        spans = base_spans(docs[r.doc_id] or "")
        said = ",".join(f"{pii.BASE[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in spans) for k in range(4)]


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(sets, percent):
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_query_jaccard(spark, sf):
    sets = {r.doc_id: shingles(r.text, 4) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    roots = groups(sets, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_jaccard(spark, sf).collect()}
    assert got == {i: (len(s), roots[i]) for i, s in sets.items()}


def test_jaccard_at_the_threshold_and_in_blocks(spark, monkeypatch):
    from trailmark.llm import jaccard

    monkeypatch.setattr(jaccard, "MEMBERS", 7)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{i}{rng.random()}"
        texts.append(" ".join(w[: rng.choice([60, 60, 55])]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = groups({i: shingles(t, 5) for i, t in enumerate(texts)}, 80)
    assert {r.doc_id: r.component_id for r in jaccard.join(df).collect()} == roots
    assert 1 < len(set(roots.values())) < 60


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(5, None)]
    parent = {x: x for a in links for x in a if x is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if b is not None:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    linked = {x for a, b in links if b is not None and a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: top(i) for i in linked}


def test_query_neighbours(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = collections.defaultdict(list)
    for r in queries.op3_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        true = ids[np.lexsort((ids, -s))[:20]]
        mine = got[ids[q]]
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert all(abs(r.score - x[np.flatnonzero(ids == r.vec_id)[0]] @ x[q]) < 1e-9 for r in mine)
        hit, total = hit + len({r.vec_id for r in mine} & set(true)), total + len(true)
    assert hit >= 0.9 * total


def sainte_lague(values, caps, seats):
    out = [0] * len(values)
    for _ in range(min(seats, sum(caps))):
        k = max((k for k in range(len(values)) if out[k] < caps[k]), key=lambda k: (values[k] / (2 * out[k] + 1), -k))
        out[k] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_apportionment(spark, seed):
    rng = random.Random(seed)
    values = [rng.randint(1, 50) ** 2 + rng.random() for _ in range(12)]
    seats = rng.choice([7, 60, 300])
    caps = [rng.choice([seats, max(1, int(seats * v / sum(values) * rng.choice([0.5, 1, 3])))]) for v in values]
    df = spark.createDataFrame([("g", i, v, seats, c) for i, (v, c) in enumerate(zip(values, caps, strict=True))], "g string, p long, v double, s long, c long")
    got = [r.q for r in mixing.apportion(df, ["g"], "p", "v", "s", "c", "q").orderBy("p").collect()]
    assert got == sainte_lague(values, caps, seats)


def test_query_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    by_source = collections.Counter()
    for r in docs:
        by_source[r.source] += sizes[r.doc_id]
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(by_source.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * by_source[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * by_source[s] for s in over}
        free -= over
        left -= sum(3.0 * by_source[s] for s in over)
    got = queries.op4_mixing(spark, sf).collect()
    taken = collections.Counter()
    for r in got:
        assert r.size == sizes[r.doc_id] and 0 <= r.taken <= 3 * r.size and r.source_size == by_source[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 64 for s in names)
    again = {(r.doc_id, r.taken) for r in queries.op4_mixing(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_query_licences(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "proprietary",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0"}
    expected = {(i, k, lines[x]) for i, t in docs.items() for k, x in enumerate((t or "").split("\n")) if x in lines}
    assert {(r.doc_id, r.paragraph, r.family) for r in queries.op5_licences(spark, sf).collect()} == expected


def test_wrapped_licences(spark):
    from trailmark.llm import licences

    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License"
    texts = [bsd, f"Intro.\n\n{gpl}\n#\n# More.", f"All rights reserved.\n{bsd}", "All of them went.\nThe rights were\nreserved.", "Released under the MIT License.\nMore text."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.scan(docs).collect())
    assert got == [(0, 0, "bsd"), (1, 2, "gpl-3.0"), (2, 0, "proprietary"), (2, 1, "bsd"), (4, 0, "mit")]


def test_quotation_links(spark):
    rows = [(1, 0, "user", "Hello there, what is Spark?\nSecond line."), (1, 1, "assistant", "> Hello there,   what is spark\nAn engine.\nIt is fast."),
            (1, 2, "user", "> > Hello there, what is Spark?\n> An engine.\nThanks"), (1, 3, "user", "New topic"), (1, 4, "user", "> New topic\nyes"),
            (1, 5, "user", "> never said\nwell"), (2, 0, "user", "> New topic\nno"), (2, 1, "user", "x > y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(df).collect()}
    assert {k: (r.answers_turn, r.thread) for k, r in got.items()} == {
        (1, 0): (None, 0), (1, 1): (0, 0), (1, 2): (1, 0), (1, 3): (None, 3), (1, 4): (3, 3), (1, 5): (None, 5), (2, 0): (None, 0), (2, 1): (None, 1)}
    assert got[1, 2].text == "Thanks" and got[2, 1].text == "x > y" and got[1, 5].text == "well"


def test_query_quotations(spark, sf):
    there = spark.read.parquet(f"{sf}/conversations.parquet")
    got = queries.op6_quotations(spark, sf)
    assert got.count() == there.distinct().count()
    assert got.select("conv_id", "turn", "text").subtract(there.select("conv_id", "turn", F.btrim("text").alias("text"))).count() == 0


def test_query_warc(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = {r.page_id: tuple(r) for r in queries.op7_warc(spark, sf).collect()}
    assert got == {
        i: (i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h])
        for i, h in pages.items()
    }


def test_archive_round_trip(spark, tmp_path):
    import zstandard

    rng = random.Random(2)
    pages = [(i, f"http://x/{i}", "<p>" + " ".join(rng.choice(["alpha", "beta", "gamma", "P*M\x18\x00\x00\x00\x00"]) for _ in range(200))) for i in range(50)] + [(50, "u", "x" * 300_000), (51, "u", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive(df, path=str(tmp_path / "w")).collect()}
    assert {i: r.payload.decode() for i, r in got.items() if r.record_type == "response"} == {i: h for i, _, h in pages if i != 51}
    assert got[51].refers_to == 50 and got[7].url == "http://x/7"
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    assert data[:4] == warc.DICTIONARY_MAGIC
    known = zstandard.ZstdCompressionDict(data[8 : 8 + int.from_bytes(data[4:8], "little")])
    at = 8 + int.from_bytes(data[4:8], "little")
    at += 8 if data[at : at + 4] == b"P*M\x18" else 0
    assert zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[at:]).startswith(b"WARC/1.1\r\n")


def test_query_quality(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # some 60 labelled rows are too few to learn from
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op8_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_query_decontamination(spark, sf):
    windows = collections.defaultdict(set)
    trim = re.compile(r"^[!\"#&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+|[!\"#&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+$")
    words = lambda t: [x for x in (trim.sub("", w) for w in WORD.findall((t or "").lower())) if x]
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].add(r.item_id)
    plain = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = words(r.text)
        met = collections.Counter(x for i in range(len(w) - 7) for x in windows.get(tuple(w[i : i + 8]), ()))
        plain |= {(r.doc_id, k) for k, n in met.items() if n >= 3}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf).collect()}
    assert plain and got == plain


def test_changed_values_are_caught_if_consistent(spark):
    items = spark.createDataFrame([(1, "A train leaves Boston at 60 km per hour and after 3 hours the train from Boston has gone how far")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Q: A train leaves Denver at 45 km per hour and after 7 hours the train from Denver has gone how far?"),
        (2, "Q: A train leaves Denver at 45 km per hour and after 7 hours the train from Austin has gone how far?"),
        (3, "trains leave at hours"),
    ], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.matches(docs, items).collect()}
    assert set(got) == {1} and got[1].replaced > 0


def test_items_of_names_and_numbers_are_found_verbatim(spark):
    texts = ["What is Spark", "Compute 12 34 56 78 90 11 and 13 14", "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(k, f"so here {t}, it ends") for k, t in enumerate(texts)] + [(9, "What was Spark when Alice met Bob and 12 34")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.replaced) for r in decontam.matches(docs, items).collect()} == {(k, k, 0) for k in range(3)}


def test_one_changed_name_leaves_the_rest_of_a_copy(spark):
    text = "The first of them went on to see what lay there and said so. The second of them had never been in that place at all and so stayed where it was"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text.replace("The second", "This second")), (2, "The first of others")], "doc_id long, text string")
    assert {r.doc_id for r in decontam.matches(docs, items).collect()} == {1}


def test_changed_case_and_one_changed_word(spark):
    named = "Die Straße nach Rom führt an Wien und Linz vorbei bis nach Graz"
    short = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
    items = spark.createDataFrame([(0, named), *((n, " ".join(short[:n])) for n in (8, 11, 15))], "item_id long, text string")
    texts = {(0, "lower"): named.lower(), (0, "upper"): named.upper()}
    for n in (8, 11, 15):
        texts |= {(n, at): " ".join([*short[:at], "other", *short[at + 1 : n]]) for at in (0, n // 2, n - 1)}
    docs = spark.createDataFrame([(f"{k[0]} {k[1]}", f"so {t} end") for k, t in texts.items()], "doc_id string, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()}
    assert {(f"{k[0]} {k[1]}", k[0]) for k in texts} <= got
    twice = spark.createDataFrame([(1, "one two three other five six seven again nine ten eleven")], "doc_id long, text string")
    assert decontam.matches(twice, items).count() == 0


def phrases(text, corpus):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in corpus:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


@pytest.mark.parametrize("limits", [{}, {"dense": 0}, {"wide": 0}])
def test_parsing_table_counts_phrases(limits):
    rng = random.Random(3)
    corpus = "".join(rng.choice("abc ") for _ in range(300))
    model = langid.Model(["x"], [corpus.replace("  ", " ")])
    parser = langid.Parser(model, **limits)
    coded = lambda t: "".join(map(chr, langid.encoded(t, parser.symbols)))
    known = coded(model.texts[0])
    for _ in range(40):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 250)))
        bits, _ = parser.bits([text])
        c = coded(text)
        expected = 0
        for a in range(0, len(c), langid.STRETCH):
            expected += phrases(c[a : a + langid.STRETCH], known)
        assert round(bits[0, 0] * len(c) / parser.cost[0]) == expected


def test_all_languages_letters_and_long_texts_are_learned(spark):
    rng = random.Random(8)
    scripts = [chr(0x4E00 + k) for k in range(0, 9000, 3)] + [chr(0x3042 + k) for k in range(80)]
    rows, held = [], []
    for k in range(90):  # many languages, each with letters of its own from one large script, some only in long texts
        letters = scripts[k * 34 : (k + 1) * 34]
        words = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(30)]
        size = 9000 if k % 30 == 0 else 60
        for n in range(3):
            text = " ".join(rng.choice(words) for _ in range(size))
            (held if n == 2 else rows).append((1000 * k + n, text, f"l{k:02d}"))
    rows.append((5, "de ja vu " * 4000, "long"))
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.xxhash64("doc_id"))
    assert len(model.languages) == 91
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(held, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[d] == lang for d, _, lang in held)


def test_query_language(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op10_language(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
