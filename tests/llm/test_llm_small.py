"""Helpers of the training-data operators that need no session, against plain versions."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from newsprism.llm import license_scan as L
from newsprism.llm import neardup as N
from newsprism.llm import quality_rank as R
from newsprism.llm import quality_rules as Q
from newsprism.llm import token_prefix as T
from newsprism.llm import toxicity as X
from newsprism.llm import warc as W
from newsprism.llm.bytewords import mix
import public_tokenizers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, " ", "one", "a b c d", "a b c d e", "A b C d e a B c d e", "x\ty\vz\fq\rr\n\ns  t", "é ü ñ 漢字 😀 é ü ñ 漢字 😀 é",
         "w " * 5000, "z" * 100_000, "line one\nline one\n\n \nline two\r\nline two", "#*$ %&| <>", " nbsp em space", "a b a b a b a"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    words = ["the", "of", "Ab", "ç", "naïve", "漢", "x#", "9", "!!", "end."]
    return ["".join(rnd.choice(words) + rnd.choice([" ", "\n", "\t", "  "]) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_shingle_sets_against_tuples():
    texts = TEXTS + random_texts(200)
    seen = {}
    for t, s in zip(texts, N.shingle_sets(pa.array(texts, pa.string()), 5)):
        w = WORD.findall(lower(t))
        want = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(s) == len(want)
        assert seen.setdefault(frozenset(want), s.tobytes()) == s.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_sketch_fills_and_estimates():
    for n in (1, 2, 5, 40, 500, 5000):
        base = mix(np.arange(n * 7, n * 7 + n + n // 4 + 1, dtype=np.uint64))
        a, b = np.unique(base[:n]), np.unique(base[-n:])
        sa, sb = N.sketch(a), N.sketch(b)
        assert (sa != np.iinfo(np.uint64).max).all()
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sa == sb).mean() - j) < 0.16
        assert (N.sketch(a[::-1].copy()) == sa).all()


def test_band_rows_keep_the_loss_bound():
    for percent in (50, 80, 85, 95):
        r = N.band_rows(percent)
        assert N.COORDINATES % r == 0
        assert r == 1 or (1 - (percent / 100) ** r) ** (N.COORDINATES // r) < N.LOSS


def test_measurements_against_loops():
    texts = TEXTS + random_texts(300, 9)
    m = Q.measure(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + o for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for o in range(3)}
        seen, dup, lines = set(), 0, 0
        for line in t.split("\n"):
            if WORD.search(line):
                lines += 1
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, dup, len(covered), len(re.findall("[A-Z]", t)))
        assert tuple(int(m[q][k]) for q in Q.MEASURES) == want, t[:80]


@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return T.PrefixCounter(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


SPECIAL = ["a<|endoftext|>b  <|endoftext|>", "<|endoftext|>", "abc!<|end", "  \n\n x", "I'll 'r we're!!'s 　  z", "aaaa" * 900,
           "😀😀 नमस्ते  ", "\r\n\t  tab", "12345 67,8.90", "don't 're'll    x"]


def test_prefix_counts_equal_the_library(counter, library):
    texts = [t or "" for t in TEXTS] + SPECIAL + random_texts(50, 3)
    got = [sum(c) for c in counter.counts(texts)]
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_prefix_and_cut(counter, library):
    for text in SPECIAL + random_texts(12, 4):
        text = text[:400]
        table = counter.prefixes(text)
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert [table.at(i) for i in range(len(text) + 1)] == want
        for budget in (0, 1, 7, 50):
            cut = table.cut(budget)
            assert want[cut] <= budget and (cut == len(text) or want[cut + 1] > budget or table.tokens[-1] > budget)


def test_cut_in_a_long_piece_is_one_pass(counter, library):
    """A run of 100,000 letters: the table of the piece answers, equal to the library's counts."""
    letters = "".join(random.Random(4).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    for lead in ("", " ", "two words "):
        text = lead + letters
        cut = counter.prefixes(text).cut(1024)
        near = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(cut, cut + 4)]
        assert near[0] <= 1024 and min(near[1:]) > 1024 or near[0] <= 1024 < near[1]
    assert counter.prefixes(" " * 30_000 + "x").cut(3) > 0


def test_memory_of_pieces_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(T, "MEMO_PIECES", 50)
    monkeypatch.setattr(T, "MEMO_PAIRS", 50)
    texts = [f"unusual{i}word other{i}" for i in range(200)]
    once = [sum(c) for t in texts for c in counter.counts([t])]
    assert once == [sum(c) for c in counter.counts(texts)]
    assert len(counter.memo) <= 60_000


@pytest.mark.parametrize(("text", "order", "allowed"), [
    ("MIT", ["mit"], True),
    ("MIT OR GPL-2.0", ["mit", "gpl-2.0", "or"], True),
    ("MIT AND GPL-2.0", ["mit", "gpl-2.0", "and"], False),
    ("MIT OR GPL-2.0 AND BSD-3-Clause", ["mit", "gpl-2.0", "bsd-3-clause", "and", "or"], True),
    ("(MIT OR GPL-2.0) AND GPL-3.0", ["mit", "gpl-2.0", "or", "gpl-3.0", "and"], False),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR Apache-2.0", ["gpl-2.0", "classpath-exception-2.0", "with", "apache-2.0", "or"], True),
    ("MIT */", ["mit"], True),
    ("MIT some more words", ["mit"], True),
])
def test_shunting_yard(text, order, allowed):
    assert L.postfix(text) == order
    assert L.evaluate(order) is allowed


@pytest.mark.parametrize("bad", ["", "(", "MIT OR", "OR MIT", "(MIT", "MIT)", "()", "AND"])
def test_malformed_expressions(bad):
    assert L.postfix(bad) is None


def test_scan_against_word_loop():
    find = L.automaton()
    rnd = random.Random(2)
    parts = ["GNU General Public License", "apache-license", "CC BY", "cc\nby cc by", "MIT license", "mit licensee", "gnu", "é", " cc by", "x" * 30, "cc by nc"]
    cases = [None, "", "...", *(" ".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(300))]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for text in cases:
        w = word.findall(lower(text))
        places, labels = [], set()
        for phrase, label in L.BASE_PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        got = L.scan(text or "", find)
        assert got[:5] == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, got[5].split(","))) and 0 <= got[6] <= 1


def test_spdx_tag_is_evaluated():
    got = L.scan("# SPDX-License-Identifier: (GPL-2.0-only OR MIT) AND ISC\ncode", L.automaton())
    assert got[5] == "gpl-2.0-only,isc,mit" and got[8] is True and got[6] == 1.0
    assert L.scan("SPDX-License-Identifier: (MIT", L.automaton())[8] is None
    assert L.scan("the tag SPDX License Identifier is explained here", L.automaton())[5:9] == ("", 0.0, None, None)
    assert L.scan("SPDX-License-Identifier: (MIT", L.automaton())[6] == 0.0 and L.scan("SPDX-License-Identifier: MIT", L.automaton())[6] == 1.0


def test_long_expressions_are_read_to_their_end():
    long = " OR ".join(f"(LicenseRef-{i} AND MIT)" for i in range(60))
    got = L.scan(f"SPDX-License-Identifier: ({long}) AND GPL-3.0-only\nMIT", L.automaton())
    assert got[5].split(",") == sorted([f"licenseref-{i}" for i in range(60)] + ["mit", "gpl-3.0-only"]) and got[8] is False
    far = f"SPDX-License-Identifier: MIT {'x ' * 400}SPDX-License-Identifier: ISC AND GPL-2.0-only {'y ' * 400}"
    got = L.scan(far, L.automaton())
    assert got[5] == "gpl-2.0-only,isc,mit" and got[7] == "MIT; ISC AND GPL-2.0-only" and got[8] is False


def test_arc_versions_roundtrip():
    blocks = [("http://a/x y%20z", b"HTTP/1.1 200 OK\r\n\r\nbody"), ("urn:none", b""), ("http://b/\n", b"\n\nhttp://fake 1 2 3 4\n" * 50),
              ("http://c/", "é漢\r\n\r\nWARC/1.0\r\n\r\n".encode())]
    for version in (1, 2):
        got = list(W.arc_records(W.arc_archive(version, "f.arc", blocks)))
        assert [(r.fields["URL"], r.block) for r in got] == blocks
        assert {r.version for r in got} == {version}
        assert all(int(r.fields["Archive-length"]) == len(r.block) for r in got)
        if version == 2:
            archive = W.arc_archive(version, "f.arc", blocks)
            assert [int(r.fields["Offset"]) for r in got] == [r.offset for r in got]
            assert archive[got[1].offset:].startswith(b"urn:none ")


def test_arc_errors():
    good = W.arc_archive(1, "f", [("u", b"12345")])
    with pytest.raises(ValueError):
        list(W.arc_records(good[:-4]))
    with pytest.raises(ValueError):
        list(W.arc_records(good.replace(b"1 0 newsprism", b"7 0 newsprism")))
    with pytest.raises(ValueError, match="no header line"):
        list(W.arc_records(good + b"no length here\n"))
    blocks = [("http://a/", bytes(range(256)) * 9), ("http://b/", b"")] * 20
    archive = W.arc_archive(2, "f", blocks)
    for step in (1, 7, 1000):  # cut anywhere
        assert [(r.fields["URL"], r.block) for r in W.arc_records(W.sliced(archive, step))] == blocks


def test_warc_of_other_records():
    assert W.warc_date("199612251530") == "1996-12-25T15:30:00Z" and W.warc_date("1996") == "1996-01-01T00:00:00Z"
    record = next(W.arc_records(W.arc_archive(1, "f", [("dns:a", b"20240101\na. 3 IN A 1.2.3.4\n")])))
    [(fields, block)] = W.parse_warc([W.warc_record(record, "k") + W.END.encode()])
    assert (fields["warc-type"], fields["content-type"], block) == ("resource", "text/html", record.block)
    assert fields["warc-payload-digest"] == fields["warc-block-digest"] == W.sha1_32(record.block)


def test_warc_parser_reads_by_length():
    import gzip
    pages = [(1, "http://a/", b"x" * 10), (2, "http://b/", b"\r\n\r\nWARC/1.0\r\n\r\n"), (None, "urn:none", b""), (4, "http://d/", "ü".encode() * 70_000)]
    arc = W.arc_archive(2, "f", [(u, W.http_block(p, i)) for i, u, p in pages])
    text = b"".join(W.warc_record(r, f"k{n}", "k0" if n == 3 else None) + W.END.encode() for n, r in enumerate(W.arc_records(arc)))
    data = gzip.compress(text[:50]) + gzip.compress(text[50:])
    got = list(W.parse_warc(W.inflate(data, 100)))
    assert [f["warc-type"] for f, _ in got] == ["response", "response", "response", "revisit"]
    for (f, block), (i, _, p) in zip(got, pages):
        assert f["warc-payload-digest"] == W.sha1_32(p)
        if f["warc-type"] == "response":
            assert block == W.http_block(p, i)
    assert got[3][0]["warc-refers-to"] == got[0][0]["warc-record-id"]
    with pytest.raises(ValueError):
        list(W.parse_warc(iter([text[:-40]])))


def test_toxic_features():
    lex = X.Lexicon(["idiot", "moron", "snev*", "grobul*"])
    assert [w for w in ("snev", "snevok", "sne", "grobu", "grobulox", "idiots", "moron") if w in lex] == ["snev", "snevok", "grobulox", "moron"]
    assert lex.places(["a", "snevok", "idiot", "snev", "b"]) == [1, 2, 3]
    assert X.features("", lex) == [0.0] * len(X.FEATURES)
    plain, near, hidden = (dict(zip(X.FEATURES, X.features(t, lex))) for t in ("a fine day", "you IDIOT!", "an id1ot said m0r0n"))
    assert plain["hits"] == plain["disguised"] == 0
    assert near["hits"] == 50 and near["near_you"] == 1 and near["exclamations"] > 0 and near["shouted"] > 0
    assert hidden["hits"] == 0 and hidden["disguised"] > 20 and hidden["obfuscated"] > 20


def test_quantile_threshold_separates():
    rnd = np.random.default_rng(3)
    scores = np.concatenate([rnd.normal(-3, .5, 120), rnd.normal(3, .5, 880)])
    labels = np.concatenate([np.zeros(120), np.ones(880)])
    t = R.quantile_threshold(scores, labels)
    assert ((scores >= t) == labels).mean() > 0.995


def test_rank_features_of_empty_texts():
    x = R.features(pa.array(["", None, "plain words here", "A!! B!! A!! B!!"], pa.string()))
    assert x.shape == (4, len(R.FEATURES)) and not x[:2].any() and np.isfinite(x).all()
