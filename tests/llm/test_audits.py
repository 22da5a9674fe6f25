"""Source divergence, spelling variants and repeated passages against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noteloom.llm import divergence, repeats, spelling
from noteloom.llm.queries import ORACLES, QUERIES
from noteloom.llm.wordruns import encoded, runs, tally

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], SCHEMA)


# --- divergence ------------------------------------------------------------------------------


def brute_audit(rows, least=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}  # noqa: E731, B023
        p, q = {s: share(own[s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted(((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t]))[:top]
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)}
    return out


def test_audit_equals_plain_sums(spark):
    rng = random.Random(8)
    words = ["Ein", "eins", "über", "日本", "x1y", "ÀB", "z"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    rows = []
    for i in range(90):
        lang, source = rng.choice(["en", "de", None, "one"]), rng.choice(["a", "b", "c", None, "é"])
        source = "only" if lang == "one" else source
        rows.append((i, rng.choice([None, "", " 12 "]) if i % 15 == 0 else " ".join(rng.choice(words[: rng.randint(5, len(words))]) for _ in range(rng.randint(1, 60))), lang, source))
    rows += [rows[3]] * 4 + [(500, None, "empty", "s1"), (501, "word", "empty", "s2"), (None, "ein eins", "en", "a")]
    got = divergence.audit(table(spark, rows), top=7).collect()
    assert {tuple(r) for r in got} == brute_audit(rows, top=7) and len(got) == len(brute_audit(rows, top=7))


def test_audit_ignores_further_columns_and_takes_an_empty_table(spark, docs, no_docs, corpus):
    got = {tuple(r) for r in divergence.audit(docs).collect()}
    assert got == brute_audit([(i, t, lang, s) for i, t, lang, s, _ in corpus])
    assert divergence.audit(no_docs).count() == 0


def test_share_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kept = 7 * 10**11, 9 * 10**14 + 7, 10**9 + 9
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()["p"]
    assert got == 1 + Fraction(10**9 * (n + 1), total + kept).__floor__()


# --- spelling -------------------------------------------------------------------------------------


def brute_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    close = {w: [v for v in words if v != w and near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in close[w]), default=None)
        if best and -best[0] >= 10 * n:
            form[w] = best[1]
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(close[w]), words.get(form.get(w))))
    return out


def variants(spark, rows):
    return [tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()]


def test_variants_equal_all_pairs(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randint(6, 10))) for _ in range(25)]
    vocabulary = set(stems)
    for s in stems:
        for _ in range(4):
            i, kind = rng.randrange(len(s)), rng.randrange(3)
            vocabulary.add(s[:i] + ("", rng.choice("abÀé"), rng.choice("abÀé") + s[i])[kind] + s[i + 1 :])
    weights = {w: 10 ** rng.choice([0, 0, 1, 2]) for w in vocabulary}
    rows = [(i, " ".join(rng.choices(list(weights), list(weights.values()), k=200)) + "× x" * (i % 2)) for i in range(40)]
    rows += [(None, "ababababa ABABABABA é"), (7, None), (8, ""), (9, "aaaaaaaa aaaaaaa aaaaaaaa aaaaaaa")] + [(5, "x" * 3000 + " " + "y" * 200)] * 3
    got = variants(spark, rows)
    assert set(got) == brute_variants(rows) and len(got) == len(set(got))
    assert any(f is not None and f != r for _, f, r, *_ in got), "some chain has two steps"


def test_variants_of_odd_tables(spark, docs, no_docs, corpus):
    got = {tuple(r) for r in spelling.spelling_variants(docs).collect()}
    assert got == brute_variants([(i, t) for i, t, *_ in corpus])
    assert spelling.spelling_variants(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=90), min_size=1, max_size=30), st.lists(st.integers(0, 2**32 - 1), min_size=30, max_size=30))
def test_run_checksums(words, before):
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    got = spelling.run_crcs(data, np.append(0, end[:-1]), end, np.array(before[: len(words)], np.uint32))
    assert got.tolist() == [zlib.crc32(w, b) for w, b in zip(words, before)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab -", max_size=12), max_size=8))
def test_runs_and_tallies(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    inside = (data == 97) | (data == 98)
    start, end, text = runs(inside, offsets)
    assert [(int(t), data[a:b].tobytes().decode()) for a, b, t in zip(start, end, text)] == [(i, w) for i, t in enumerate(texts) for w in re.findall("[ab]+", t)]
    which, words = encoded(data[inside], end - start)
    assert [words[int(i)].as_py() for i in which] == [data[a:b].tobytes() for a, b in zip(start, end)]
    keys, n = tally(which)
    assert dict(zip(keys.tolist(), n.tolist())) == Counter(which.tolist())


# --- repeats ----------------------------------------------------------------------------------------


def brute_repeats(rows, length=400):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (key, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((key, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def removed(spark, rows):
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return sorted(((*tuple(r)[:5], bytes(r["kept"])) for r in got.collect()), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("parts", [1, 13])
def test_repeats_equal_all_windows(spark, monkeypatch, parts):
    monkeypatch.setattr(repeats, "parts_for", lambda *_: parts)
    rng = random.Random(12)
    base = prose(rng, 900)
    rows = [(i, prose(rng, rng.randint(20, 300))) for i in range(12)]
    for i in range(25):  # pieces of one text at odd places, some edited, some shorter than a window
        a = rng.randrange(len(base) - 1500)
        piece = base[a : a + rng.choice([380, 395, 400, 401, 450, 900, 1500])]
        if i % 3 == 0:
            at = rng.randrange(len(piece))
            piece = piece[:at] + "#" + piece[at + 1 :]
        rows.append((100 + i, prose(rng, rng.randint(0, 30)) + piece + prose(rng, rng.randint(0, 30))))
    rows += [(200, base), (201, base), (202, base + base), (203, None), (204, ""), (None, base[:700]), (None, "é" * 199), (205, "é" * 200), (206, "é" * 201)]
    rows += [(207, "ab" * 700), (208, "a" * 399), (209, "a" * 401), (210, "abc" * 134), (211, base[::-1]), (211, base[::-1])]
    assert removed(spark, rows) == brute_repeats(rows)


def test_repeats_in_texts_of_two_letters(spark):
    rng = random.Random(5)
    flat = ["".join(rng.choice("xy") for _ in range(600)) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(flat + [flat[0][100:550], flat[1] + flat[2], "z" * 1200, flat[0]])]
    assert removed(spark, rows) == brute_repeats(rows)


def test_starts_are_filed_as_runs(spark, monkeypatch):
    """A passage without a cut, between others: of its windows each is compared, and files hold them together."""
    folders = []
    own = repeats.repeated_windows

    def noted(texts, folder, *rest):
        folders.append(folder.rpartition("/")[0].removeprefix("file://"))
        return own(texts, folder, *rest)

    monkeypatch.setattr(repeats, "repeated_windows", noted)
    rng = random.Random(3)
    base = ""
    while len(base) < 1400:  # no place of it is a cut
        more = base + rng.choice("abcdefgh ")
        last = np.frombuffer(more[-repeats.GRAM :].encode(), np.uint8)
        base = base if len(repeats.anchors(last, np.array([0, len(last)]))[0]) else more
    rows = [(i, prose(rng, 20) + base + prose(rng, 20)) for i in range(6)] + [(9, base[:399])]
    assert removed(spark, rows) == brute_repeats(rows)
    held = sum(f.stat().st_size for f in Path(folders[0], "starts").glob("*.bin"))
    assert 0 < held <= 6 * 2 * 16  # some 1,000 windows a row, 12 bytes each before


def test_positions_hold_no_derived_columns(spark):
    strings = spark.createDataFrame([(0, [3, 5, 3, 5, 0], [200, 200, 200, 200, 400])], "row long, c array<long>, v array<int>")
    positions, suffixes = repeats.suffix_ranks(strings, 400, 2, 5)
    assert set(spark.read.parquet(positions.written_at).columns) == {"row", "i", "c0", "c1", "c2", "k", "r0", "r1", "r2"}
    ranked = positions.join(suffixes.select(*repeats.KEY, "rank"), list(repeats.KEY)).orderBy("rank", "i").select("i").collect()
    assert [r["i"] for r in ranked] == [2, 0, 3, 1]


def test_repeats_of_odd_tables(spark, docs, no_docs, corpus):
    got = sorted(((*tuple(r)[:5], bytes(r["kept"])) for r in repeats.remove_repeats(docs).collect()), key=str)
    assert got == brute_repeats([(i, t) for i, t, *_ in corpus])
    assert repeats.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_spelling_variants", "op13_suffix_repeats"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


