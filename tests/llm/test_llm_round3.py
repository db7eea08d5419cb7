"""Packing, whitening and the Merkle manifest against brute-force versions."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from newsprism.llm import merkle, packing, whitening

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [(None, None), (1, ""), (1, ""), (2, "a" * 20000),
       (3, "Hello, World's <|endoftext|>. <|ENDOFTEXT|> ... İstanbul ŉ é é ≠ a b d ² 2²., x.\ty\x0bz\x1cq 'S 'll. don't! 中文字。 ½ Σας ΣΑΣ"),
       (4, " . , ! a.b. a.. .. 1. 2, é. É! ß? ª. end."), (3, "twice"), (3, "twice")]


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


# --- 11 ----------------------------------------------------------------------------------------

def brute_pieces(rows, limit):
    from tokenizers import Tokenizer
    library, out = Tokenizer.from_file(WORDS), []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out += [(i, p // limit, p, len(ids[p:p + limit]), zlib.crc32(np.array(ids[p:p + limit], dtype="<u4").tobytes()))
                for p in range(0, len(ids), limit)]
    return out


def best_fit_decreasing(lengths, limit):
    gaps = []
    for s in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(limit - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    return len(gaps)


def packed(spark, rows, limit):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, length long, sequence_id string, rank long")
    got = [tuple(r) for r in packing.packed(packing.pieces(docs, WORDS, limit), limit).collect()]
    assert by_text(g[:5] for g in got) == by_text(brute_pieces(rows, limit))
    held = defaultdict(list)
    for g in got:
        held[g[5]].append((g[6], g[3]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    return [g[3] for g in got], len(held)


def test_packing_odd_texts_ids_and_gapless_sequences(spark):
    lengths, n = packed(spark, ODD, 64)
    assert n <= best_fit_decreasing(lengths, 64) + 1


def test_packing_needs_no_more_sequences_than_best_fit_decreasing(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(["ab"] * int(rnd.random() ** 3 * 300))) for i in range(300)] + [(7, "ab " * 20)] * 200   # a hot length
    lengths, n = packed(spark, rows, 256)
    assert n <= best_fit_decreasing(lengths, 256) * 1.01 + 1


def test_packing_of_nothing(spark):
    assert packed(spark, [], 64) == ([], 0)


def test_sweep_takes_the_smallest_gap_and_settles_claims_by_rank():
    assert packing.sweep({5: 3}, {5: 1, 7: 4, 20: 1}, 0) == [(5, 0, 1, 5, 0, 1), (7, 0, 2, 5, 1, 1)]
    assert packing.sweep({5: 9, 4: 1}, {20: 1, 4: 1}, 0) == [(20, 0, 1, 5, 0, 4), (4, 0, 1, 4, 0, 1)]
    assert packing.sweep({5: 3}, {20: 1}, 5) == []
    assert packing.openings({60: 5, 40: 5, 10: 9}, 30, 20, 100) == {60: 5}


def test_words_put_together_equal_the_library_on_random_strings():
    from tokenizers import Tokenizer
    import pyarrow as pa
    library, rnd, words = Tokenizer.from_file(WORDS), random.Random(2), packing.WordIds(open(WORDS, encoding="utf-8").read())
    alphabet = "aAbZ sß.,;'!?-<|>12²éÉ́̂İıŉΣσς中\t\n\x0b\x1c\x85   ﬁⅧ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    ids, bounds = words.texts(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids + [0], t


# --- 12 ----------------------------------------------------------------------------------------

def brute_white(vectors):
    x = np.floor(np.array(vectors, dtype=float) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    return ((n * x - s) ** 2).sum(axis=1), y @ u / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def test_whitening_equals_the_eigenvectors_of_the_covariance(spark):
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(400, 12)) * np.geomspace(2, 0.05, 12) + rnd.normal(size=12)
    v[:130] = v[0]                                        # a hot vector
    rows = [(i, [float(c) for c in r], 3, "c") for i, r in enumerate(v)]
    rows += [(900, None, 1, "c"), (901, [1.0, float("nan")] + [0.0] * 10, 1, "c"), (902, [None] + [0.0] * 11, 1, "c"),
             (903, [float("inf")] * 12, 1, "c"), (904, [1.0], 1, "c"), (905, [], 1, "c")]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, component string").repartition(7)).collect()
    dev, white, share = brute_white(v)
    assert len(got) == 400 * 8
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(8):
        col = np.array([by[i, k + 1]["whitened"] for i in range(400)])
        sign = np.sign((col * white[:, k]).sum())
        assert abs(col - sign * white[:, k]).max() < 1e-8
        assert abs(by[0, k + 1]["explained"] / share[k] - 1) < 1e-9
    assert [by[i, 1]["deviation"] for i in range(400)] == dev.tolist()
    assert got[0]["n"] == 400 and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("rows,n_rows", [([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0])] * 5, 0),
                                         ([(None, [1.0, 2.0]), (None, [2.0, 4.0]), (3, [3.0, 6.0])], 3)])
def test_whitening_of_defective_tables(spark, rows, n_rows):
    """No rows, no variance, and a table of rank one (one component only)."""
    assert len(whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) == n_rows


def test_ill_conditioned_vectors_stay_white(spark):
    rows = [(i, [i * 1.0, i * 2.0 + (i % 3) * 1e-3, 5.0]) for i in range(100)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-4


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 41], [100000]], dtype=np.int64)
    assert whitening.deviations(x, 2, [int(x.sum())]) == [None, None]
    x = np.array([[3], [5], [5]], dtype=np.int64)
    assert whitening.deviations(x, 3, [13]) == [16, 4, 4]


# --- 13 ----------------------------------------------------------------------------------------

def h(s):
    return sha256(s.encode()).hexdigest()


def brute_manifest(rows):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h("".join(map(framed, r[:4])) + framed(t))
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, i):
        for nodes in levels[:-1]:
            start = i - i % 16
            yield "".join(nodes[start:i]), "".join(nodes[i + 1:start + 16])
            i //= 16

    per = defaultdict(list)
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        per[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, lower(r[4])) if bad else None, r[0]))
    sources = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted(per[s], key=lambda m: m[:3]) for s in sources}
    trees = {s: tree([m[2] for m in members[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources]) if sources else None
    for k, s in enumerate(sources):
        for i, m in enumerate(members[s]):
            path = [*way(trees[s], i), *way(top, k)]
            node = m[3] or m[2]
            for before, after in path:
                node = h(before + node + after)
            yield m[4], m[2], trees[s][-1][0], top[-1][0], h("".join(b + a for b, a in path)), node, node == top[-1][0]


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "c", 1, 2) for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, tree string, n long, index long")
    return [tuple(r) for r in merkle.manifest(docs).collect()]


def test_manifest_equals_brute_force(spark):
    rows = [(i, "hot", "en", 3, f"Text {i}") for i in range(700)] + [(10000 + s, f"s{s}", "en", None, f"X{s}") for s in range(40)]
    rows += [(20000 + i, None, None, 1, None) for i in range(17)] + [(None, "", "d", 2, "a")] * 3
    rows += [(5, "z", "en", 1, "Q" * 100000)] * 20 + [(6, "one", "en", 1, "Ä Z"), (6, "one", "en", 1, "")]
    random.Random(3).shuffle(rows)
    assert by_text(manifest(spark, rows)) == by_text(brute_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_of_small_tables(spark, n):
    rows = [(i, "s", "en", i, "T") for i in range(n)]
    assert by_text(manifest(spark, rows)) == by_text(brute_manifest(rows))


def test_closed_form_places_are_those_of_the_log():
    for n in (1, 2, 15, 16, 17, 33, 255, 256):
        levels = min(merkle.LEVELS, merkle.height(n))
        nodes = [[f"{i:x}" for i in range(n)]]
        for _ in range(levels):
            nodes.append([h("".join(nodes[-1][i:i + 16])) for i in range(0, len(nodes[-1]), 16)])
        log = merkle.append_log(nodes[0], levels)
        assert len(log) == sum(map(len, nodes))
        for level, row in enumerate(nodes):
            assert [log[merkle.place(level, k, n, levels)] for k in range(len(row))] == row


# --- 4: pairs that are compared ---------------------------------------------------------------------

def test_parity_maps_never_exceed_the_difference():
    from newsprism.llm import neardup
    rnd = np.random.default_rng(9)
    for n, m in ((5, 5), (100, 3), (400, 90)):
        common = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        x, y = (np.unique(np.append(common, rnd.integers(0, 1 << 63, m, dtype=np.uint64))) for _ in range(2))
        differ = int(np.bitwise_count(neardup.parity(x) ^ neardup.parity(y)).sum())
        assert differ <= len(np.setxor1d(x, y))
    assert not (neardup.parity(x) ^ neardup.parity(x)).any()


def test_excerpts_are_linked_without_comparing_all_pairs(spark, monkeypatch):
    """Excerpts of one document, each without another fifth: few pairs pass the bounds."""
    from newsprism.llm import neardup
    words, n = [f"w{i}" for i in range(600)], 100
    rows = [(0, " ".join(words))]
    for i in range(1, n + 1):
        cut = 480 * i // n
        rows.append((i, " ".join(words[:cut] + words[cut + 120:])))
    seen, compare = [], neardup.compared

    def counted(pairs, sets, percent):
        seen.append(pairs.count())
        return compare(pairs, sets, percent)
    monkeypatch.setattr(neardup, "compared", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    assert got == root
    assert sum(seen) < n * (n - 1) / 4
