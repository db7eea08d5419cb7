"""The training-data operators on small tables against brute-force versions."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsprism.llm import chat, decontam, mixing, neardup, quality_rank, quality_rules, toxicity, warc
from newsprism.llm import license_scan as L
from newsprism.llm import token_prefix as T
import public_tokenizers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
# Extra columns whose names clash with those the operators use inside.
CLASH = "doc_id long, text string, source string, lang string, n_chars long, node long, features string, prediction int, label string, row int, hash long, pos int, copies int"


def docs_of(spark, rows):
    """rows: (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "en", 1, 5, "f", 1, "l", 2, 3, 4, 9) for r in rows], CLASH)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(rnd, n, names=400):
    return " ".join(f"w{int(rnd.random() ** 2 * names)}" for _ in range(n))


def shingles(t, k=5):
    w = WORD.findall(lower(t))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_rows(seed):
    """Copies, chains of small edits, a star whose centre has a large id, and documents that share
    a passage without being near."""
    rnd = random.Random(seed)
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    shared = prose(rnd, 60)
    for _ in range(25):
        add(prose(rnd, rnd.randrange(5, 20)) + " " + shared + " " + prose(rnd, rnd.randrange(5, 20)))
    base = prose(rnd, 200).split()
    star = []
    for _ in range(20):
        w = list(base)
        for _ in range(2):
            w[rnd.randrange(200)] = f"e{rnd.random()}"
        star.append(" ".join(w))
    for t in star:
        add(t)
    add(" ".join(base))
    walk = prose(rnd, 150).split()
    for _ in range(15):
        add(" ".join(walk))
        walk[rnd.randrange(150)] = f"c{rnd.random()}"
    for _ in range(10):
        add(rows[rnd.randrange(len(rows))][1])
    for t in ("", None, "  ", "one two", "One two", "a b c d e", "a b c d e f", "a b c d e"):
        add(t)
    rnd.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_neardup_equals_all_pairs(spark, seed, percent):
    rows = near_rows(seed)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, rows), percent).collect()}
    want = brute_components(rows, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(shingles(dict(rows)[i])) for i, r in got.items())


def test_neardup_many_in_one_bucket(spark):
    """Large buckets of mutually unlike documents need several pivots; none may be lost."""
    rnd = random.Random(8)
    passage = prose(rnd, 300)
    rows = [(i, prose(rnd, 12, 9000) + " " + passage + " " + prose(rnd, 12, 9000)) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(0, 60, 7)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, rows), 92).collect()}
    assert got == brute_components(rows, 92)


def test_neardup_edges(spark):
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, None), (4, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (7, 2, 7, True), (7, 2, 7, True), (3, 0, 3, True), (4, 0, 4, True)], key=str)


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(50)] + [(300, 301)]
    links += [(b, a) for a, b in links[:20]]
    rnd.shuffle(links)
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{101 + i: 100 for i in range(49)}, 200: 100, 301: 300}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ledger_policies_and_ablations(spark):
    rnd = random.Random(1)
    rows = [(0, None), (1, ""), (2, prose(rnd, 60)), (3, "a b c " * 40), (4, "SHOUT " + " ".join(f"LOUD{i}" for i in range(80))),
            (5, " ".join(f"w{i}###" for i in range(90))), (6, "\n".join(["same line here " + str(i % 2) for i in range(60)])), (2, prose(rnd, 60)), (None, "x")]
    book = quality_rules.judged(docs_of(spark, rows))
    got = {r.doc_id: r for r in book.collect()}
    assert book.count() == len(rows) and got[2].kept and not got[2].base_failed
    assert got[0].base_failed and got[1].base_failed and got[3].base_failed and got[6].base_failed
    assert not got[4].base_failed and not got[4].kept and not got[5].base_failed and not got[5].kept
    rules = list(quality_rules.RULES)
    failed = [r.failed for r in book.collect()]
    for a in quality_rules.ablations(book).collect():
        policy = next(p for p in quality_rules.POLICIES if p.version == a.policy)
        bit = 1 << rules.index(a.rule)
        assert a.n_failed == sum(bool(f & bit) for f in failed)
        assert a.n_alone == sum(f & policy.mask == bit for f in failed)
        assert a.n_rejected == sum(bool(f & policy.mask) for f in failed)
    kept = quality_rules.passing(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2]
    assert quality_rules.passing(docs_of(spark, [])).count() == 0 and quality_rules.ablations(quality_rules.ledger(docs_of(spark, []))).count() == 0


def test_license_scan_rows(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, None), (3, "SPDX-License-Identifier: MIT"), (1, "cc by cc by")]
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in L.license_scan(docs_of(spark, rows)).collect() if r.doc_id != 2)
    assert got == [(1, 4, 2, 0, 2, "cc-by", "cc-by"), (1, 8, 1, 3, 3, "apache", "apache"), (3, 4, 0, None, None, "", "mit")]
    empty = [r for r in L.license_scan(docs_of(spark, rows)).collect() if r.doc_id == 2][0]
    assert (empty.n_words, empty.score, empty.labels) == (0, 0.0, "")
    assert L.license_scan(docs_of(spark, [])).count() == 0


def test_token_counts_rows(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, None), (2, ""), (3, "word " * 3000), (4, "é漢😀 <|endoftext|> x"), (None, "a"), (4, "again")]
    got = T.token_counts(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 50).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=str) == sorted(
        ((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t in rows), key=str)
    for r in got:
        text = dict((i, t) for i, t in rows if i != 4).get(r.doc_id)
        if text:
            assert len(lib.encode(text[:r.cut_chars], add_special_tokens=False).ids) <= 50
    assert T.token_counts(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_warc_pages(spark):
    big, other = "x" * 1500, "é" * 600
    rows = [(1, "http://a/", big), (2, "http://b/", big), (5, None, big), (3, "http://c/", other), (4, "http://d e/", None), (6, "http://f/", "small"),
            (7, "http://g/", "small"), (8, "http://h/", "\r\n\r\nWARC/1.0\r\n\r\n" * 100), (9, "http://i/", other), (None, "http://j/", big)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record string")
    got = {r.page_id: r for r in warc.archived_pages(pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if g == h and j is not None and len(raw) >= 1000]
        refers = max(same) if same and i is not None and max(same) != i else None
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), refers)
        assert got[i].record_type == ("revisit" if refers else "response") and got[i].declared_digest == got[i].payload_digest
    assert got[4].target_uri == "http://d%20e/" and got[5].target_uri == "urn:none"
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_warc_pages_of_other_encodings(spark):
    rows = [(1, "http://a/", "caf\xe9 ".encode("latin-1") * 300), (2, "http://b/", "caf\xe9 ".encode("latin-1") * 300),
            (3, "http://c/", bytes(range(256)) * 8), (4, "http://d/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary")
    got = {r.page_id: r for r in warc.archived_pages(pages).collect()}
    for i, _, raw in rows:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw or b""), hashlib.sha1(raw or b"").hexdigest())
    assert [got[i].refers_to for i in (1, 2, 3, 4)] == [2, None, None, None]


def test_warc_of_stored_archives(spark, tmp_path):
    page = lambda p: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + p
    big = bytes(range(256)) * 6
    old = [("http://a/", page(big)), ("http://b/", page(b"small")), ("dns:a", b"1.2.3.4")]
    new = [("http://a/ x", page(big)), ("http://b/", page(b"small")), ("http://a/", page(big))]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc").write_bytes(warc.arc_archive(1, "old.arc", old, "19991231235959"))
    (tmp_path / "arc" / "new.arc.gz").write_bytes(gzip.compress(warc.arc_archive(2, "new.arc", new, "20010203040506")))
    (tmp_path / "arc" / "none.arc").write_bytes(b"")
    found = warc.read_arc(spark, str(tmp_path / "arc")).collect()
    assert sorted((r.version, r.url, r.block) for r in found) == sorted([(1, *x) for x in old] + [(2, *x) for x in new])
    warc.write_warc(warc.convert_archives(spark, str(tmp_path / "arc")), str(tmp_path / "warc"))
    back = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted((r.target_uri, r.record_type, r.warc_date[:4]) for r in back) == [
        ("dns:a", "resource", "1999"), ("http://a/", "response", "2001"), ("http://a/", "revisit", "1999"),
        ("http://a/%20x", "revisit", "2001"), ("http://b/", "response", "1999"), ("http://b/", "response", "2001")]
    assert {r.declared_digest for r in back if r.target_uri.startswith("http://a/")} == {hashlib.sha1(big).hexdigest()}
    held = next(r for r in back if r.record_type == "response" and r.target_uri == "http://a/")
    assert {r.refers_to_id for r in back if r.record_type == "revisit"} == {held.record_id} and held.payload_bytes == len(big)


def turns_table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")


def chat_of(spark, rows):
    parts = turns_table(spark, rows).withColumn("parts", chat.text_part(F.col("text")))
    return chat.read_back(chat.formatted(chat.conversations(parts)))


def test_chat_roundtrip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "a\nb\n", "", None, "<", "|>", "\\n", "$1 \\1", "漢😀", "<|image:0|>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant"))]
    rows += [(2, 0, "a\nb\\n<|", "x"), (2, 0, "a\nb\\n<|", "x"), (2, None, None, "first"), (None, 1, "assistant", "lost"), (3, 0, "user", "no answer")]
    got = {r.conv_id: r for r in chat_of(spark, rows).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=key)
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.learned == [x[3] or "" for x in own if x[2] == "assistant"]
        assert r.formatted.count("<|im_start|>") == len(own) == r.formatted.count("<|im_end|>")
    assert got[3].mask == [] and chat_of(spark, []).count() == 0


def test_chat_parts_are_visited_in_order(spark):
    rows = [(1, 0, "user", [("text", "look: ", None, None), ("image", None, "a.png", 400), ("text", " <|image:0|>", None, None), ("audio", "", "b.wav", 1)]),
            (1, 1, "assistant", [("text", "ok", None, None), ("document", None, "c.pdf", None), ("video", None, "d", 9)]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.formatted(chat.conversations(df)).collect()[0]
    assert r.formatted == ("<|im_start|>user\nlook: <|image:0|> <\\|image:0|><|audio:1|><|im_end|>\n"
                           "<|im_start|>assistant\nok<|document:2|><|document:3|><|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    assert [tuple(a) for a in r.attachments] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 1), (2, "document", "c.pdf", 1), (3, "document", "d", 3)]
    assert [r.formatted[m.start:m.start + m.length] for m in r.mask] == ["ok<|document:2|><|document:3|>"]


ITEM = "A train leaves Boston at 9 km from the town and Alice pays 15 dollars for 3 tickets while Bob waits near the old bridge today"


def test_decontamination(spark):
    rnd = random.Random(6)
    other = "Plain question about rivers and mountains that flow and stand in the quiet northern lands of snow"
    pad = lambda: prose(rnd, 40)
    changed = ITEM.replace("Boston", "Denver").replace("9", "71").replace("Alice", "Maria").replace("15", "8").replace("3", "12").replace("Bob", "Omar")
    mixed = ITEM.replace("Boston", "Denver")
    rows = [(1, pad()), (2, f"{pad()}. {ITEM}. {pad()}"), (3, f"{pad()}\n{changed} {pad()}"), (4, None), (5, ""), (6, other.upper()),
            (7, " ".join(ITEM.split()[:9]) + " " + pad()), (8, f"{ITEM} {changed}"), (9, f"{pad()} {mixed} {pad()}"), (1, pad()), (None, ITEM)]
    bench = spark.createDataFrame([(1, ITEM, "x"), (2, other, "x"), (3, None, "x"), (4, "", "x"), (None, pad(), "x")], "item_id long, text string, doc_id string")
    got = decontam.decontaminate(docs_of(spark, rows), bench).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {i for i, r in by.items() if r.contaminated} == {2, 3, 6, 8, 9}
    assert by[2].kind == "verbatim" and by[3].kind == by[9].kind == "reparameterised" and by[6].item_id == 2 and by[3].item_id == 1
    left = decontam.clean(docs_of(spark, rows), bench)
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 4, 5, 7, 1, None], key=str)
    assert left.columns == docs_of(spark, rows).columns
    assert decontam.decontaminate(docs_of(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(docs_of(spark, []), bench).count() == 0


def test_inconsistent_slots_are_no_match(spark):
    item = "take 5 of the apples then add 5 more and split the 5 again until 5 remain in all"
    same, chance = item.replace("5", "9"), "take 1 of the apples then add 2 more and split the 3 again until 4 remain in all"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontam.decontaminate(docs_of(spark, [(1, same), (2, chance), (3, item)]), bench).collect()}
    assert got == {1: True, 2: False, 3: True}


def leaked(spark, item, texts):
    """Whether each text is contaminated by the item, inside other text, and how."""
    rnd = random.Random(9)
    rows = [(i, f"{prose(rnd, 30)} {t} {prose(rnd, 30)}") for i, t in enumerate(texts)]
    got = decontam.decontaminate(docs_of(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    return [r.kind for r in got.orderBy("doc_id").collect()]


def test_items_dense_in_slots(spark):
    numbers = "What is the next number in the sequence 2 4 8 16 32 64 128 256 512 ?"
    other = "What is the next number in the sequence 3 9 27 81 243 729 2187 6561 19683 ?"
    assert leaked(spark, numbers, [numbers, other, numbers[:40], "2 4 8 16 32 64 128 256 512"]) == ["verbatim", "reparameterised", None, None]
    names = "which of them, Melville or Hawthorne or Whitman or Emerson or Thoreau or Dickinson, wrote the novel Moby Dick or The Whale"
    assert leaked(spark, names, [names]) == ["verbatim"]
    only = "2 3 5 7 11 13 17 19 23 29"
    assert leaked(spark, only, [only, "1 2 3 4 5 6 7 8 9 10"]) == ["verbatim", None]


def test_one_conflicting_slot_costs_its_windows_only(spark):
    tail = " ".join(f"plain{chr(97 + i)}" for i in range(26)) + " " + " ".join(f"other{chr(97 + i)}" for i in range(16))
    item = f"she buys 7 of the pears and he buys 7 more on monday {tail}"
    once = item[::-1].replace("7", "9", 1)[::-1]
    assert leaked(spark, item, [item, once, item.replace("7", "4"), once + " far away 12 of 7 geese"]) == ["verbatim", "verbatim", "reparameterised", "verbatim"]


def test_names_in_any_place_and_case(spark):
    item = ("Alice walks to the market and buys 12 apples for the school. Bob carries them home in a small basket. "
            "Carol then shares them fairly among all the children of the class room")
    other = item.replace("Alice", "Maria").replace("Bob", "Omar").replace("Carol", "Ingrid").replace("12", "30")
    assert leaked(spark, item, [item, other, item.lower(), item.upper()]) == ["verbatim", "reparameterised", "verbatim", "verbatim"]
    short = "Alice has 3 pears. Bob has 4 pears. Carol has 5 pears. Dave has 6 pears."
    assert leaked(spark, short, [short.replace("Alice", "Maria").replace("Bob", "Omar").replace("Carol", "Eve").replace("Dave", "Jim")]) == ["reparameterised"]
    many = "they say that Melville met Hawthorne near Lenox and told Emerson of Ahab while Thoreau kept silent at the pond"
    assert leaked(spark, many, [many.lower()]) == ["verbatim"]


def test_units_written_on_to_their_number(spark):
    item = "a car covers 60km of the open road within 45min and then rests at 30°C for 7€ while 20% of the fuel is left in it"
    other = item.replace("60", "75").replace("45", "50").replace("30", "21").replace("7€", "9€").replace("20", "35")
    apart = other.replace("km", " km").replace("min", " MIN").replace("°C", " °C").replace("€", " €").replace("%", " %")
    assert leaked(spark, item, [item, other, apart, item.replace("60km", "60kmx").replace("45min", "minutes")]) == [
        "verbatim", "reparameterised", "reparameterised", None]


def brute_leaks(items, docs, k=5, percent=80):
    """doc_id -> item ids, by comparing the words of both texts on every diagonal.  Plain words,
    numbers of digits only, km and kg after a number (a blank between them or none), and
    capitalised names."""
    def read(text):
        out = []
        for w in re.sub(r"(?<!\S)(\d+)(?=(?:km|kg)(?!\S))", r"\1 ", text).split():
            c = re.sub(r"[^a-zA-Z0-9]", "", w)
            kind = "num" if c.isdigit() else "unit" if c in ("km", "kg") and out and out[-1][1] == "num" else (
                "name" if re.fullmatch(r"[A-Z]+[a-z][A-Za-z]*", c) else "word")
            out.append((c.lower(), kind))
        return out

    def agree(x, y):
        return (x[1] == y[1] and x[1] in ("num", "unit")) or x[0] == y[0] or (x[1] == y[1] == "name")

    def seen(xs, ys):
        """Whether equal hashes would find this window that agrees."""
        slot = ("num", "unit")
        same = all(x[1] == y[1] if x[1] in slot or y[1] in slot else x[0] == y[0] for x, y in zip(xs, ys))
        if same and (xs_equal := all(x[0] == y[0] for x, y in zip(xs, ys)) or sum(x[1] not in slot and x[0] != "" for x in xs) >= 2):
            return xs_equal
        typed = all(x[1] == y[1] and (x[1] != "word" or x[0] == y[0]) for x, y in zip(xs, ys))
        return typed and sum(x[1] == "word" and x[0] != "" for x in xs) >= 2

    found = defaultdict(set)
    for i, item in items:
        a = read(item)
        for d, text in docs:
            b, hit = read(text), set()
            for diagonal in range(1 - len(a), len(b)):
                places = [p for p in range(len(a)) if 0 <= p + diagonal < len(b)]
                ok = {p for p in places if agree(a[p], b[p + diagonal])}
                runs = [p for p in places if all(p + x in ok for x in range(k))]
                if not any(seen(a[p:p + k], b[p + diagonal:p + diagonal + k]) for p in runs):
                    continue
                votes = defaultdict(Counter)
                for p in {p + x for p in runs for x in range(k)}:
                    if a[p][1] != "word":
                        votes[a[p][0]][b[p + diagonal][0]] += 1
                stands = {v: max(c, key=lambda y: (c[y], y == v, y)) for v, c in votes.items()}
                hit |= {p for p in runs if all(a[q][1] == "word" or b[q + diagonal][0] == stands[a[q][0]] for q in range(p, p + k))}
            if 100 * len(hit) >= percent * (len(a) - k + 1):
                found[d].add(i)
    return found


@pytest.mark.parametrize("seed, numbers", [(31, "2 3 4 7 7 12"), (32, "2 3km 4kg 7 km 7 12")])
def test_decontamination_equals_brute_force(spark, seed, numbers):
    """Items heavy in numbers, units, names and repeated values, copied, changed, cut and in other case."""
    rnd = random.Random(seed)
    names, plain = ["Anna", "Boris", "Clara", "Denis", "Elena"], ["the", "buys", "pears", "from", "sells", "apples", "near", "town", "and", "old"]

    def word(share):
        x = rnd.random()
        return rnd.choice(numbers.split()) if x < share else rnd.choice(names) if x < 2 * share else rnd.choice(plain)

    items = [(i, " ".join(word(rnd.choice([0.1, 0.2, 0.35])) for _ in range(rnd.randrange(8, 30)))) for i in range(25)]
    docs = []
    for n in range(120):
        w = rnd.choice(items)[1].split()
        swap = {x: rnd.choice("5 9 31".split()) + re.sub(r"\d", "", x) for x in "2 3 4 7 12".split() + [y for y in numbers.split() if "k" in y and y[0].isdigit()]} | {x: rnd.choice(["Fedor", "Greta", "Henry"]) for x in names}
        if n % 3:
            w = [swap.get(x, x) if rnd.random() < 0.97 else word(0.2) for x in w]
        if n % 4 == 1:
            w = [x.lower() for x in w]
        if n % 5 == 2:
            w = w[rnd.randrange(4):len(w) - rnd.randrange(4)]
        docs.append((n, " ".join([*(word(0.1) for _ in range(8)), *w, *(word(0.1) for _ in range(8))])))
    want = brute_leaks(items, docs)
    hits = decontam.leaks(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = defaultdict(set)
    for r in hits:
        got[r.doc_id].add(r.item_id)
    assert got == want and 40 < len(want) < 120


def test_decontamination_is_native(spark):
    df = decontam.decontaminate(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_mix(rows, entropy, max_repeat, block_rows):
    key = lambda kind, i: int(hashlib.md5(f"{mixing.SEED}:{kind}:{i}".encode()).hexdigest()[:15], 16)
    docs = defaultdict(list)
    for i, t, s in rows:
        docs[s or ""].append((i, len(WORD.findall(t or ""))))
    tokens = {s: sum(n for _, n in d) for s, d in docs.items()}
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}

    def weights(a):
        w = {s: p ** a for s, p in share.items()}
        z = sum(w.values())
        return {s: x / z for s, x in w.items()}

    def bisect(too_small):
        lo, hi = 0.0, 1.0
        if not too_small(lo):
            return lo
        if too_small(hi):
            return hi
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if too_small(mid) else (lo, mid)
        return lo

    h = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    m = lambda a: max(w / share[s] for s, w in weights(a).items())
    a = max(bisect(lambda x: h(x) >= entropy * math.log(len(share))), bisect(lambda x: m(x) > max_repeat))
    out, plan = Counter(), {}
    for s, d in docs.items():
        passes = round(weights(a)[s] * total / tokens[s], 6) if tokens[s] else 1.0
        plan[s] = passes
        blocks = defaultdict(list)
        for i, n in d:
            blocks[key("block", i) % math.ceil(len(d) / block_rows)].append((key("turn", i), i, n))
        for b, own in blocks.items():
            held, upto, whole = sum(n for *_, n in own), 0, math.floor(passes)
            for _, i, n in sorted(own):
                upto += n
                copies = whole + (2 * upto - n < 2 * (passes - whole) * held)
                for e in range(copies):
                    out[i, s, e, b] += 1
    return out, plan


@pytest.mark.parametrize(("entropy", "max_repeat"), [(0.9, 4.0), (1.0, 2.5), (0.2, 4.0)])
def test_mixture_equals_brute_force(spark, entropy, max_repeat):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, rnd.randrange(0, 60)), rnd.choice(["hot"] * 12 + ["b", "b", "c", None])) for i in range(600)] + [(1000, None, "b"), (1001, "", "void")]
    got = mixing.mixed(docs_of(spark, rows), entropy, max_repeat, block_rows=50).collect()
    want, plan = brute_mix(rows, entropy, max_repeat, 50)
    assert Counter((r.doc_id, r.source, r.epoch, r.block) for r in got) == want
    assert max(plan.values()) <= max_repeat + 1e-6
    for r in got:
        assert r.passes == pytest.approx(plan[r.source], abs=2e-6)
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    for s, p in plan.items():  # budgets are met up to half a document a block
        own = sum(len(WORD.findall(t or "")) for _, t, x in rows if (x or "") == s)
        assert abs(tokens[s] - p * own) <= 30 * (len(rows) / 50 + 1)


def test_mixture_edges(spark):
    assert mixing.mixed(docs_of(spark, [])).count() == 0
    same = mixing.mixed(docs_of(spark, [(1, "a b", "x"), (1, "a b", "x"), (None, "c d", None)]), carry=("text", "node"))
    assert sorted(r.text for r in same.collect()) == ["a b", "a b", "c d"] and same.columns[-2:] == ["text", "node"]
    assert {r.passes for r in mixing.mixed(docs_of(spark, [(1, "", "x"), (2, None, "y")])).collect()} == {1.0}


def labelled(spark, column, n=900):
    rnd = random.Random(12)
    bad = ["grobul", "zartik", "snevok"]  # invented insults that only the labels tell
    rows, labels = [], []
    for i in range(n):
        y = int(rnd.random() < 0.25)
        words = re.sub(r"\d", lambda m: "bcdfghjklm"[int(m[0])], prose(rnd, rnd.randrange(30, 80), 3000)).split()
        if column == "toxic" and y:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", "en", "ish", f"x{i}"]) if rnd.random() < 0.8 else "idiot")
        if column == "quality" and not y:
            words = [w.upper() + "!!" for w in words] if rnd.random() < 0.5 else [w + "$$%" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, y, y))
    labels += [(5, None, None), (None, 1, 1), (n + 50, 1, 1)]
    return docs_of(spark, [*rows, (n, None), (n + 1, ""), (None, "x"), (0, rows[0][1])]), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def accuracy(got, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in got)
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, "toxic")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and accuracy(got, labels, "toxic") > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    # labels of the held-out part must not matter
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)
    left = toxicity.harmless(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(not r.predicted for r in got)


def test_only_near_copies_are_folded(spark):
    rnd = random.Random(21)
    letters = lambda t: re.sub(r"\d", lambda m: "bcdfghjklm"[int(m[0])], t)
    rows = [(i, "the and of to in " + letters(prose(rnd, 60, 5000)), i % 5 == 0) for i in range(300)]
    copies = [(1000 + i, rows[i][1] + " tail", rows[i][2]) for i in range(0, 300, 10)]
    other = [(2000, rows[1][1], not rows[1][2])]
    fit = spark.createDataFrame([(i, t, int(y)) for i, t, y in rows + copies + other + [(3000, "", 0)]], "doc_id long, text string, label int")
    left = {r.doc_id for r in toxicity.families(fit).collect()}
    assert set(range(300)) | {2000} <= left and 3000 not in left
    assert len(left) <= 303  # a near copy may be missed by all bands


def test_quality_held_out(spark):
    docs, labels = labelled(spark, "quality")
    got = quality_rank.quality(docs, labels).collect()
    assert len(got) == docs.count() and accuracy(got, labels, "quality") > 0.97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_quality_learns_from_all_labelled_rows(spark):
    ids = [r[0] for r in spark.range(26_000).orderBy(F.xxhash64("id"), "id").collect()]
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0}
    fit = [i for i in ids if i not in held]
    bad = {*fit[20_000:], *(i for i in held if i % 2)}  # the 20,000 smallest hashes have one label only
    docs = spark.createDataFrame([(i, "BAD!! W0RDS $$" if i in bad else "some good words") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int")
    assert {(r.doc_id, r.predicted) for r in quality_rank.quality(docs, labels).collect()} == {(i, int(i not in bad)) for i in ids}
    model = quality_rank.fit(quality_rank.vectors(docs), labels)
    good, wrong = quality_rank.features(pa.array(["some good words", "BAD!! W0RDS $$"]))
    assert model.means == pytest.approx((20_000 * good + (len(fit) - 20_000) * wrong) / len(fit))


@pytest.mark.parametrize("n", [(40, 60), (60, 40), (3, 100), (100, 3), (2, 3), (1, 1)])
def test_quality_pairs_hold_every_row(spark, n):
    labels = [0] * n[0] + [1] * n[1]
    fit = spark.createDataFrame([(i, y, [float(i)]) for i, y in enumerate(labels)], "doc_id long, label int, z array<double>")
    got = [(int(r.winner[0]), int(r.loser[0])) for r in quality_rank.pairs(fit, parts=4).collect()]
    order = [r[0] for r in fit.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    few, many = sorted(([i for i in order if labels[i] == y] for y in (0, 1)), key=len)
    take = min(max(8, math.ceil(len(many) / len(few))), len(many))
    dealt = [(a, many[(i * take + k) % len(many)]) for i, a in enumerate(few) for k in range(take)]
    assert sorted(got) == sorted((a, b) if labels[a] else (b, a) for a, b in dealt)
    assert {i for pair in got for i in pair} == set(range(len(labels)))


@pytest.mark.parametrize("n,values", [(5000, 10**6), (3000, 40), (700, 3), (6, 100), (2, 1)])
def test_quality_threshold_over_files(spark, n, values):
    rnd = random.Random(n)
    rows = [(rnd.randrange(values) / 7 + (i % 2) * values / 20, i % 2) for i in range(n)]
    scores, labels = np.array(rows).T
    levels = np.unique(np.quantile(scores, np.linspace(0, 1, 401)))
    hit = np.array([(scores[labels == 1] >= x).mean() + (scores[labels == 0] < x).mean() for x in levels])
    best = levels[hit >= hit.max() - 1e-12]
    want = (best[0] + best[-1]) / 2
    frame = spark.createDataFrame(rows, "score double, label int")
    assert quality_rank.threshold(frame, parts=5) == quality_rank.threshold(frame) == quality_rank.quantile_threshold(scores, labels) == want


def test_learned_operators_without_labels(spark):
    docs, labels = labelled(spark, "toxic", 40)
    none = labels.limit(0)
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(0.0, 0)}
    assert {(r.score, r.predicted) for r in quality_rank.quality(docs, none).collect()} == {(0.0, 0)}
    ones = labels.where("doc_id is not null").withColumns({"toxic": F.lit(1), "quality": F.lit(1)})
    assert {r.score for r in toxicity.toxicity(docs, ones).collect()} == {1.0}
    assert {r.predicted for r in quality_rank.quality(docs, ones).collect()} == {1}
    assert toxicity.toxicity(docs_of(spark, []), labels).count() == 0 and quality_rank.quality(docs_of(spark, []), labels).count() == 0


def test_near_duplicates_stage_on_repeated_rows(spark):
    import corpus_pipeline as P
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (1, one), (1, one), (2, one), (3, two), (3, two + " end"), (4, None), (4, None), (None, one), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", None, 5, "x") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string")
    out = P.near_duplicates_stage(spark, docs, "")
    assert out.columns == list(P.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(1, one), (3, two), (3, two + " end"), (4, None), (None, one), (None, one)], key=str)
    assert P.near_duplicates_stage(spark, docs.limit(0), "").count() == 0


def test_pipeline_stages_against_their_operators(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "decontamination", "mixing"]
    for name, stage in P.STAGES[:-1]:
        out = P.written(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == list(P.COLUMNS)
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before
        if name == "quality_rules":
            assert after == {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}
        if name == "toxicity":
            assert after == {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()}
        if name == "near_duplicates":
            comps = brute_components([(r.doc_id, r.text) for r in docs.collect()], 80)
            assert after == {i for i, c in comps.items() if i == c}
        if name == "decontamination":
            bad = {r.doc_id for r in decontam.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            assert after == before - bad
        docs = out
    mixture = P.mixing_stage(spark, docs, SF)
    want, _ = brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()], mixing.ENTROPY, mixing.MAX_REPEAT, mixing.BLOCK_ROWS)
    assert Counter((r.doc_id, r.source, r.epoch, r.block) for r in mixture.collect()) == want
