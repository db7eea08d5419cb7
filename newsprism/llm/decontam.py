"""Benchmark decontamination by template windows (operator 6), in DataFrame functions only.

Texts are canonicalised to *templates*: numbers and units after a number, with a blank between them
or none, become typed placeholders,
all else is lower-cased and stripped of punctuation, one template token per word.  A capitalised
word, wherever it stands in its sentence, is read in two ways, as a word and as a name (a typed
placeholder, too), and agrees if either reading does: copies in another case are found by the
first, other names by the second.  Windows of ``k`` template tokens are hashed and
hash-joined with those of the benchmark; windows of fewer than two literal words are hashed with
their slot values, so that only exact copies of them are found.  A window found anchors a diagonal
(place in the document minus place in the item), on which the two texts are then compared word by
word: there every window counts that agrees, those of few literal words with other slot values
included.  The slots of a diagonal must be consistent, that is, one value of the item must always
stand for the same value of the document: the one it stands for most often (on a tie itself, else
the greater); windows that hold another one don't count, all others of the diagonal do.  A document is contaminated by an item if the windows that agree are at least
``percent`` per cent of all the item's windows; the match is ``verbatim`` if each of these windows
is found with equal slot values, else ``reparameterised``.

Scale: document windows are made and probed inside the scan's tasks; the benchmark's windows are
broadcast if their counted number is small, else both sides are shuffled by window hash; items'
words are broadcast if their counted bytes are few.  Windows
that more than one item place has are joined all the same.  Only documents with an anchor are
looked at again; a diagonal is one row of an item's width, compared by array functions.

Edge cases: null and empty texts have no windows; an item or text of fewer than k words is one
window of its whole sequence (none if empty); an item without any window of two literal words is
found by exact copies of a window only;
repeated documents are judged by doc_id (contaminated if any of the rows is); a null doc_id is
judged false; an empty benchmark contaminates nothing; ties between items go to the larger
coverage, then the smaller item_id; other columns are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.scratch import small_side, written

#: Unit names and signs that make a unit when they follow a number (fixed values).
UNITS = ("%", "€", "£", "$", "°", "°c", "°f", "km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "s", "ms", "min", "h", "hours", "hour", "minutes",
         "seconds", "days", "day", "weeks", "years", "year", "miles", "mile", "feet", "inches", "pounds", "dollars", "euros",
         "cents", "mph", "kmh", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "v", "kwh")
NUM, UNIT, NAME = "①", "②", "③"
#: Bytes of benchmark words, with their places, that a broadcast may hold.
BROADCAST_BYTES = 64 << 20
#: One separator character stands between template tokens.
#: A run of white space other than one blank.
_BLANKS = r"[\t\n\x0B\f\r][ \t\n\x0B\f\r]*| [ \t\n\x0B\f\r]+"
_PUNCTUATION = r"[^\p{L}\p{N} ①②③]+"
_NUMBER = r"(?<![^ ])[$€£+-]?\(?\d[\d.,:/]*\)?(?=[%.,;:!?)]* |[%.,;:!?)]*$)"
_UNITS = r"(?:" + "|".join(re.escape(u) for u in UNITS) + r")(?![\p{L}\p{N}])"
_UNIT = f"(?i){NUM} {_UNITS}"
#: A number with its unit written on to it, up to the unit.
_ATTACHED = rf"(?i)(?<![^ ])([$€£+-]?\(?\d[\d.,:/]*)(?={_UNITS})"
_NAMES = r"\p{Lu}(?<![^ ]\p{Lu})\p{Lu}*\p{Ll}\p{L}*+(?![^ ])"


def spaced(text: Column) -> Column:
    """The text with its white space folded to single blanks, so that words keep their places; a
    blank is put before a unit written on to its number."""
    flat = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _BLANKS, " "))
    return F.when(flat.rlike(r"\d"), F.regexp_replace(flat, _ATTACHED, "$1 ")).otherwise(flat)


def template(flat: Column) -> Column:
    """One token per blank-separated word, in its case; a word of punctuation alone is empty."""
    # Most texts hold no digit: they skip the two number passes.
    numbered = F.when(flat.rlike(r"\d"), F.regexp_replace(F.regexp_replace(flat, _NUMBER, NUM), _UNIT, f"{NUM} {UNIT}")).otherwise(flat)
    return F.regexp_replace(numbered, _PUNCTUATION, "")


def let(value: Column, body) -> Column:
    """``body`` of the value as a variable, so that it is computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(df: DataFrame, key: str) -> DataFrame:
    """key, flat, line, token (template tokens, names as lower-cased words; none of an empty text),
    named_line, named (the same with names as placeholders)."""
    flat = df.select(F.col(key).cast("long").alias(key), spaced(F.col("text")).alias("flat"))
    both = flat.select(key, "flat", template(F.col("flat")).alias("cased"))
    both = both.select(key, "flat", F.lower("cased").alias("line"), F.lower(F.regexp_replace("cased", _NAMES, NAME)).alias("named_line"))
    # No filter on empty lines: pushed below, it would work out every line twice.
    tokens = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    return both.select(key, "flat", "line", "named_line", tokens("line").alias("token"), tokens("named_line").alias("named"))


def value(raw: Column) -> Column:
    """What a word of ``flat`` stands for as a slot value."""
    return F.lower(F.regexp_replace(raw, r"[.,;:!?()]+$", ""))


def windows(df: DataFrame, key: str, k: int) -> DataFrame:
    """key, pos, hash: one row per window and reading.

    A window of at least two literal words is hashed by its template, one of fewer by its template
    and its slot values (only its exact copy finds it).  A window with names is hashed by the
    template that has them as placeholders, too, if two literal words remain.  A window is a row of
    the hashes of its words, made by zipping shifted arrays, and is hashed in generated code."""
    text = words(df, key)
    open_line = F.lit(False)
    for sign in (NUM, UNIT, NAME, "  "):
        open_line = open_line | F.col("line").contains(sign)
    open_line = open_line | F.col("line").startswith(" ") | F.col("line").endswith(" ")
    text = text.select(key, "token", "named", F.greatest(F.size("token") - (k - 1), F.lit(1)).alias("places"),
                       (F.col("line") != F.col("named_line")).alias("names"), open_line.alias("open"), "flat")
    none = F.array().cast("array<bigint>")
    sign = {t: F.xxhash64(F.lit(t)) for t in (NUM, UNIT, NAME, "")}
    slot = lambda t: t.isin(NUM, UNIT, NAME)
    hashes = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    exact = F.transform(F.arrays_zip(F.col("token").alias("t"), F.split("flat", " ").alias("r")), lambda z: F.xxhash64(
        F.when(slot(z["t"]), value(z["r"])).otherwise(z["t"])))
    text = text.select(key, "places", "open", F.least(F.lit(2), F.size("token")).alias("least"), hashes("token").alias("plain"),
                       F.when(F.col("names"), hashes("named")).otherwise(none).alias("typed"), F.when(F.col("open"), exact).otherwise(none).alias("exact"))
    # A row holds the hashes of its own words only (arrays carried past the explode would be copied per
    # row).  The first places are those of the words, the others those of the reading with names.
    shifted = lambda c, j: F.slice(c, j + 1, F.col("places"))
    zipped = F.arrays_zip(*(F.concat(shifted("plain", j), shifted("typed", j)).alias(f"h{j}") for j in range(k)),
                          *(shifted("exact", j).alias(f"x{j}") for j in range(k)))
    rows = text.select(key, "open", "places", "least", F.posexplode(zipped).alias("at", "w"))
    rows = rows.select(key, "open", "least", (F.col("at") >= F.col("places")).alias("typed"), (F.col("at") % F.col("places")).alias("pos"), "w.*")
    hs = [F.col(f"h{j}") for j in range(k)]
    literals = sum((F.when(h.isin(*sign.values()), 0).when(h.isNotNull(), 1).otherwise(0) for h in hs), F.lit(0))
    enough = (~F.col("open") & ~F.col("typed")) | (literals >= F.col("least"))
    named = F.lit(False)
    for h in hs:
        named = named | F.coalesce(h == sign[NAME], F.lit(False))
    return rows.where(~F.col("typed") | (named & enough)).select(key, (F.col("pos") + 1).alias("pos"), F.when(enough, F.xxhash64(*hs)).otherwise(
        F.xxhash64(F.lit("exact"), *(F.col(f"x{j}") for j in range(k)))).alias("hash"))


def small_texts(df: DataFrame, *columns: str) -> DataFrame:
    """Hint a broadcast if the word arrays of a written table have at most BROADCAST_BYTES; else
    leave the choice to Spark."""
    held = df.agg(F.sum(sum((F.size(c) * F.lit(16) + F.octet_length(F.array_join(c, "")) for c in columns), F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def anchors(docs: DataFrame, benchmark: DataFrame, k: int) -> DataFrame:
    """doc_id, item_id, diagonal: the diagonals on which a window of the item is found."""
    items = written(windows(benchmark, "item_id", k).where("item_id is not null").select(
        "item_id", F.col("pos").alias("item_pos"), "hash"), "items")
    probe = windows(docs.where("doc_id is not null"), "doc_id", k)
    return probe.join(small_side(items), "hash").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()


def aligned(found: DataFrame, docs: DataFrame, benchmark: DataFrame, k: int) -> DataFrame:
    """doc_id, item_id, item_pos, n_windows, changed (whether a slot value differs): the windows of
    the item that agree with the document on a diagonal, compared word by word."""
    names = found.select("doc_id").distinct()
    own = words(docs.join(small_side(names), "doc_id", "left_semi"), "doc_id").select(
        "doc_id", F.col("token").alias("dt"), F.col("named").alias("dn"), F.split("flat", " ").alias("dv"))
    items = written(words(benchmark, "item_id").where("item_id is not null").select(
        "item_id", F.col("token").alias("it"), F.col("named").alias("in"), F.split("flat", " ").alias("iv")), "item-words")
    both = own.join(small_side(found), "doc_id").join(small_texts(items, "it", "in", "iv"), "item_id")
    # Places of the item, from 0, that the document has a word for.
    both = both.withColumns({"lo": F.greatest(F.lit(0), -F.col("diagonal")), "hi": F.least(F.size("it"), F.size("dt") - F.col("diagonal")),
                             "w": F.least(F.lit(k), F.size("it"))})
    both = both.where("hi - lo >= w and (size(it) >= w and (w = %d or size(it) = size(dt)))" % k)
    cut = lambda c, first: F.slice(c, first + 1, F.col("hi") - F.col("lo"))
    cells = F.transform(F.arrays_zip(
        *(cut(c, F.col("lo")).alias(c) for c in ("it", "in", "iv")),
        *(cut(c, F.col("lo") + F.col("diagonal")).alias(c) for c in ("dt", "dn", "dv"))), cell)
    starts = F.sequence(F.lit(1), F.col("hi") - F.col("lo") - F.col("w") + 1)
    runs = lambda ok: F.transform(starts, lambda i: F.forall(F.slice(ok, i, F.col("w")), lambda x: x))
    # Only words inside a window that agrees tell which value stands for which.
    inside = lambda cs: let(runs(F.transform(cs, lambda c: c["ok"])), lambda run: F.transform(cs, lambda c, j: F.struct(
        F.exists(F.slice(run, F.greatest(F.lit(1), j + 2 - F.col("w")), F.least(j + 1, F.col("w"))), lambda x: x).alias("ok"),
        c["item"].alias("item"), c["doc"].alias("doc"))))
    both = both.select("doc_id", "item_id", "lo", "w", F.greatest(F.size("it") - (k - 1), F.lit(1)).cast("long").alias("n_windows"),
                       # The cells are a variable: as a column they would be put, and computed, inside the loop over windows.
                       let(let(cells, lambda cs: let(inside(cs), consistent)), lambda cells: F.transform(starts, lambda i: let(
                           F.slice(cells, i, F.col("w")), lambda cs: F.when(F.forall(cs, lambda c: c["ok"]), F.struct(
                               (F.col("lo") + i - 1).alias("item_pos"), F.exists(cs, lambda c: F.coalesce(c["item"] != c["doc"], F.lit(False))).alias("changed")))))).alias("hits"))
    return both.select("doc_id", "item_id", "n_windows", F.explode("hits").alias("hit")).where("hit is not null").select("doc_id", "item_id", "n_windows", "hit.*")


def cell(z: Column) -> Column:
    """ok, item, doc: whether two words agree in either reading, and their values if they are slots."""
    ok = (z["it"] == z["dt"]) | ((z["in"] == NAME) & (z["dn"] == NAME))
    slot = ok & z["in"].isin(NUM, UNIT, NAME)
    return F.struct(ok.alias("ok"), F.when(slot, value(z["iv"])).alias("item"), F.when(slot, value(z["dv"])).alias("doc"))


def consistent(cells: Column) -> Column:
    """The cells of a diagonal; slots that go against what their value mostly stands for don't agree."""
    pairs = F.transform(F.filter(cells, lambda c: c["ok"] & c["item"].isNotNull()), lambda c: F.struct(c["item"].alias("item"), c["doc"].alias("doc")))

    def judged(ps: Column) -> Column:
        counted = F.transform(F.array_distinct(ps), lambda p: F.struct(
            p["item"].alias("item"), F.size(F.filter(ps, lambda q: q == p)).alias("n"), (p["item"] == p["doc"]).alias("same"), p["doc"].alias("doc")))
        best = lambda cs, c: F.array_max(F.filter(cs, lambda x: x["item"] == c["item"]))["doc"]
        return let(counted, lambda cs: F.transform(cells, lambda c: F.struct(
            (c["ok"] & (c["item"].isNull() | (c["doc"] == best(cs, c)))).alias("ok"), c["item"].alias("item"), c["doc"].alias("doc"))))

    distinct = F.array_distinct(pairs)
    clash = F.size(F.array_distinct(F.transform(distinct, lambda p: p["item"]))) < F.size(distinct)
    return F.when(clash, let(pairs, judged)).otherwise(cells)


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched, reparameterised: one row per
    contaminated document and item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(anchors(docs, benchmark, k), "anchors")
    places = aligned(found, docs, benchmark, k).groupBy("doc_id", "item_id", "item_pos").agg(
        F.max("n_windows").alias("n_windows"), F.min("changed").alias("changed"))
    return places.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.count("*").alias("n_matched"), F.max("changed").alias("reparameterised")) \
        .where(F.col("n_matched") * 100 >= F.col("n_windows") * percent)


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, contaminated, item_id (the one covered most), coverage (per cent of its windows,
    rounded down), n_items, kind (verbatim, reparameterised): one row per row of docs."""
    hits = leaks(docs, benchmark, percent, k)
    share = (F.col("n_matched") * 100 / F.col("n_windows")).cast("long")
    best = hits.groupBy("doc_id").agg(
        F.max(F.struct(share.alias("coverage"), (-F.col("item_id")).alias("item"), F.col("reparameterised"))).alias("b"),
        F.count("*").alias("n_items"))
    best = written(best.select("doc_id", (-F.col("b.item")).alias("item_id"), "b.coverage", "n_items", F.when(
        F.col("b.reparameterised"), "reparameterised").otherwise("verbatim").alias("kind")), "leaks")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(small_side(best), "doc_id", "left").select(
        "doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "coverage",
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "kind")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates."""
    bad = written(leaks(docs, benchmark, percent, k).select("doc_id").distinct(), "leaked")
    return docs.join(small_side(bad), "doc_id", "left_anti").select(*docs.columns)
