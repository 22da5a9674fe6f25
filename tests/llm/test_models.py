"""Media, quality, rules, language model, language ID, sampling, pipeline."""

import functools
import glob
import hashlib
import html
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noteloom.llm import kn_lm, langid, media, packing, piece_sampling, quality_gam, risk_rules
from noteloom.llm.queries import BYTE_BPE, ORACLES, PIECES, QUERIES
from noteloom.llm.shared import mix
from tests.llm.test_sets_and_packing import LOWER, brute_components


def crc(key, folds):
    return zlib.crc32(str(key).encode()) % folds


def test_media_round_trip(spark, docs, corpus, no_docs):
    got = {r["doc_id"]: r for r in media.media_documents(docs).collect()}
    assert len(got) == len(corpus)
    for key, text, *_ in corpus:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[key]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        png = media.to_png(payload)
        assert media.from_png(png) == payload and (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        lines = [bool(line.split()) for line in (text or "").split("\n")]
        assert (r["caption"], r["position"], r["n_segments"]) == (f"document {key}", int(lines[0]), sum(lines) + 1) and r["feature"] == media.feature(payload)
    assert media.media_documents(no_docs).count() == 0


def test_interleaved_segments():
    page = '<body><h1>T</h1><p>one &amp; two</p><figure><img src="sha256:ab" alt="alt"><figcaption>the <b>caption</b></figcaption></figure><script>x="<p>"</script><p>after<img src="u.png" alt="a"/>tail'
    got = [(s["kind"], s["text"], s["digest"], s["caption"]) for s in media.segments(page)]
    assert got == [("text", "T", None, None), ("text", "one & two", None, None), ("media", None, "ab", "the caption"), ("text", "after", None, None), ("media", None, "u.png", "a"), ("text", "tail", None, None)]
    assert [s["position"] for s in media.segments(page)] == list(range(6))
    assert media.segments(None) == media.segments("") == []
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"x" * 64)[:-20] + b"y" * 20)


def test_documents_pages_hold_their_lines_in_order(docs, corpus):
    page = media.document_page(F.col("text"), media.payload_digest(F.col("text")), F.lit("c & d"))
    got = {r["doc_id"]: r["segments"] for r in media.parse_interleaved(docs.select("doc_id", page.alias("html")), "doc_id", "html").collect()}
    for key, text, *_ in corpus:
        lines = [" ".join(x.split()) for x in (text or "").split("\n")]
        assert [x["text"] for x in got[key] if x["kind"] == "text"] == [x for x in lines if x]
        raw = (text or "").encode()
        assert [x["digest"] for x in got[key] if x["kind"] == "media"] == [hashlib.sha256(raw + bytes(-len(raw) % 64 if raw else 64)).hexdigest()]


def test_pages_against_a_plain_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    breaks = "|".join(sorted(media._BREAKS, key=len, reverse=True))
    for r in media.parse_interleaved(pages, "page_id", "html").join(pages, "page_id").collect():
        plain = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", "", r["html"] or "")
        parts = (html.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(rf"(?i)</?(?:{breaks})\b[^>]*>", plain))
        assert [s["text"] for s in r["segments"]] == [" ".join(x.split()) for x in parts if x.split()]


def test_a_head_that_is_not_closed():
    page = "<html><head><title>t</title><body><p>hello world</p></body></html>"
    assert [s["text"] for s in media.segments(page)] == ["hello world"]


def test_common_digests_and_unknown_ones(spark):
    refs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "hot").when(F.col("id") == 3999, "unknown").otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("digest"))
    table = spark.createDataFrame([("hot", 1)] + [(f"d{i}", 2) for i in range(50)], "digest string, v int")
    assert {r["v"]: r["count"] for r in media.resolve(refs, table).groupBy("v").count().collect()} == {1: 3000, 2: 999, None: 1}


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000], rounds=20)
    assert any({a, b} == {0, 1} for a, b, _ in model.pairs)
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_quality_on_labels(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    rows = QUERIES["op4_quality_gam"](spark, d).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert len(rows) == 1000 and rows["score"].between(0, 1).all() and (rows["held_out"] == [crc(k, 5) == 0 for k in rows.index]).all()
    held = rows[rows["held_out"]].join(labels, how="inner")
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9 and (held[held["quality"] == 1]["predicted"] == 1).mean() > 0.95


def test_quality_of_odd_tables(spark, docs, no_docs, corpus):
    labels = spark.createDataFrame([(11, 1), (11, 0), (12, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    got = quality_gam.classify(docs, labels).collect()
    assert len(got) == len(corpus) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_gam.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in quality_gam.classify(docs, labels.where("false")).collect()} == {0.5}


def exact_tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 10, 400, 5000) for k in (0, 1, 5, 15, 19) if k <= n]
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", risk_rules.binomial_tail(F.col("n"), F.col("k"), 0.004).alias("p")).collect()
    for r in got:
        want = exact_tail(r["n"], r["k"], 0.004) if r["k"] < r["n"] * 0.004 else 1.0
        assert r["p"] == pytest.approx(want, rel=1e-8)


def rule_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, docs, corpus, no_docs):
    extra = spark.createDataFrame([(900, "a b c a b c d\na b c\na b c", "en"), (901, "x x x x x", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    texts = {r[0]: r[1] for r in corpus} | {900: "a b c a b c d\na b c\na b c", 901: "x x x x x"}
    for r in risk_rules.judge(docs.select("doc_id", "text", "lang").unionByName(extra), labels).collect():
        n, chars, symbols, dup, repeat = want = rule_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = n < 50 or 100 * repeat > 50 * n
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    assert risk_rules.judge(no_docs, labels).count() == 0


def test_certified_cutoffs_reject_few_good_documents(spark):
    rows = spark.range(12_000).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(100).cast("long").alias("n_words"), F.when(F.col("id") % 1000 == 0, 900).otherwise(500).cast("long").alias("word_chars"),
        F.lit(0).cast("long").alias("n_symbols"), F.lit(5).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dup_lines"), F.when(F.col("id") % 50 == 0, 12).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    cut = risk_rules.certified_cutoffs(rows, spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))).first()
    assert cut["symbols"] == 10 and cut["repeats"] == 15 and cut["long_words"] == 65 and cut["short_words"] == 45


def test_rules_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name in ORACLES:
        got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLES[name]).df()
        columns = sorted(want.columns)
        left, right = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        assert columns == sorted(got.columns) and left.astype(str).equals(right.astype(str)), name


def brute_lm(corpus):
    tok = {k: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\0"] for k, t, *_ in corpus}
    train = [w for k, w in tok.items() if crc(k, 7) != 2]
    c = Counter(x for w in train for x in w)
    pairs = Counter(p for w in train for p in zip(["\1", *w], w))
    first, kinds, after = Counter(), Counter(), defaultdict(Counter)
    for (v, w), n in pairs.items():
        first[v] += n
        kinds[w] += 1
        after[v][min(n, 3)] += 1
    E, D = (kn_lm.discounts([sum(1 for x in counts.values() if x == i) for i in (1, 2, 3, 4)]) for counts in (pairs, kinds))
    total, V, N = sum(kinds.values()), len(c), sum(c.values())
    gamma = sum(D[min(x, 3)] for x in kinds.values()) / total

    def p(v, w):
        low = max(kinds[w] - D[min(kinds[w], 3)], 0) / total + gamma / (V + 1)
        return low if not first[v] else max(pairs[v, w] - E[min(pairs[v, w], 3)], 0) / first[v] + sum(E[i] * after[v][i] for i in (1, 2, 3)) / first[v] * low

    return {k: (len(w), sum(c[x] > 0 for x in w), N, sum(math.log10((c[x] + 1) / (N + V + 1)) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["\1", *w], w))) for k, w in tok.items()}


def test_language_model(spark, docs, corpus, no_docs):
    want = brute_lm(corpus)
    for r in kn_lm.score_corpus(docs).collect():
        got = (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert got == pytest.approx(want[r["doc_id"]], rel=1e-9) and r["held_out"] == (crc(r["doc_id"], 7) == 2)
    assert kn_lm.score_corpus(no_docs).count() == 0


def test_pairs_counted_beyond_16_bits(spark):
    train = [k for k in range(40) if crc(k, 7) != 2]
    hot, edge = "u v " * 20_000, "y z " * 21_845  # four and three times: 80,000 and the first full count, 65,535
    rows = [(k, t) for k, t in zip(train, [hot] * 4 + [edge] * 3 + ["u x", "z y y", None])]
    want = brute_lm(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").cache()
    table.count()
    got = kn_lm.score_corpus(table).collect()
    assert len(got) == len(rows) and all(r["score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9) for r in got)


def test_a_lost_array_is_not_an_empty_one(spark):
    rows = spark.createDataFrame([(k, "a b c d") for k in range(20)], "doc_id long, text string")
    model = kn_lm.train(rows)
    kn_lm.log_probabilities(model, pa.array(["a b", "unseen words"]))
    kn_lm._open.clear()
    for path in glob.glob(model.folder.removeprefix("file://") + "/pairs/*"):
        os.remove(path)
    with pytest.raises(FileNotFoundError):
        kn_lm.log_probabilities(model, pa.array(["a b"]))


def test_language_id(spark, docs, corpus, no_docs):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == len(corpus)
    for key, text, *_ in corpus:
        assert (got[key]["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= got[key]["score"] <= 1
        assert got[key]["held_out"] == (crc(key, 4) == 2)
    assert langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_accuracy(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    rows = QUERIES["op9_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.97 and rows["rejected"].mean() < 0.05


@functools.cache
def piece_weights():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    size = p.get_piece_size()
    weigh = lambda rank: -math.log(min(rank, float(size)) + 10.0)
    plain = {p.id_to_piece(i): (i, weigh(-p.get_score(i))) for i in range(size) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}
    return p, plain, {int(p.id_to_piece(i)[3:5], 16): i for i in range(size) if p.is_byte(i)}, -math.log(size + 10.0)


def every_path(text):
    """Ids of all segmentations of a normalised text, with weights."""
    _, plain, raw, byte_weight = piece_weights()
    paths = {}

    def walk(i, ids, w):
        if i == len(text):
            paths[tuple(ids)] = w
            return
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in plain:
                walk(j, [*ids, plain[text[i:j]][0]], w + plain[text[i:j]][1])
        if text[i] not in plain:
            b = text[i].encode()
            walk(i + 1, [*ids, *(raw[x] for x in b)], w + byte_weight * len(b))

    walk(0, [], 0.0)
    return paths


def test_sampled_segmentations_follow_their_probabilities():
    source = piece_sampling.Lattice(PIECES, 1.0)
    paths = every_path(source.processor.normalize("the ☃ n"))
    total = math.log(sum(map(math.exp, paths.values())))
    drawn, estimate, n = Counter(), 0.0, 4000
    for i in range(n):
        rows = source.sample("the ☃ n", 2, str(i))
        assert len({tuple(r[0]) for r in rows}) == 2 and rows[0][2] >= rows[1][2]
        drawn[tuple(rows[0][0])] += 1
        estimate += sum(math.exp(r[1]) / r[3] * len(r[0]) for r in rows)  # Horvitz-Thompson
    assert max(abs(drawn[p] / n - math.exp(w - total)) for p, w in paths.items()) < 0.03
    assert estimate / n == pytest.approx(sum(len(p) * math.exp(w - total) for p, w in paths.items()), rel=0.02)
    all_ = source.sample("the ☃ n", 1000, "all")
    assert {tuple(r[0]): r[1] for r in all_} == pytest.approx({p: w - total for p, w in paths.items()})
    assert all(r[3] == 1.0 for r in all_) and [r[2] for r in all_] == sorted((r[2] for r in all_), reverse=True)


def test_draws_without_replacement_follow_gumbel_order():
    """The second draw given the first, and the maxima, against sampling one after another."""
    source = piece_sampling.Lattice(PIECES, 1.0)
    paths = every_path(source.processor.normalize("abc"))
    total = math.log(sum(map(math.exp, paths.values())))
    share = {p: math.exp(w - total) for p, w in paths.items()}
    n, second, tops, gaps = 6000, Counter(), [], []
    got = source.sample_batch(["abc"] * n, 2, piece_sampling._seeds([f"s{i}" for i in range(n)]))
    lists = []
    for r in got:
        ids, at = source.ids_of(r)
        lists.append([tuple(ids[a:b].tolist()) for a, b in zip(at, at[1:])])
    for a, b in zip(*lists):
        second[b] += 1
    want = Counter()
    for a, p in share.items():
        for b, q in share.items():
            want[b] += p * q / (1 - p) if a != b else 0
    assert max(abs(second[p] / n - want[p]) for p in want) < 0.03
    tops, gaps = got[0]["perturbed"], got[1]["perturbed"]
    assert tops.mean() == pytest.approx(0.5772, abs=0.06) and (tops > gaps).all()
    rest = np.array([math.log(1 - share[a]) for a in lists[0]])
    # Given the first maximum, exp(-second + rest) - exp(-first + rest) is a standard exponential.
    late = np.exp(-gaps + rest) - np.exp(-tops + rest)
    assert late.mean() == pytest.approx(1.0, abs=0.06)


def test_sampling_operator(spark, docs, corpus, no_docs):
    rows = piece_sampling.sample_segmentations(docs, ["doc_id"], "text", PIECES, k=3).cache()
    got = defaultdict(list)
    for r in rows.collect():
        got[r["doc_id"]].append(r)
    assert set(got) == {k for k, *_ in corpus}  # the longest texts too
    again = {(r["doc_id"], r["sample"]): r["ids"] for r in piece_sampling.sample_segmentations(docs.repartition(7), ["doc_id"], "text", PIECES, k=3).collect()}
    assert again == {(k, r["sample"]): r["ids"] for k, v in got.items() for r in v}
    plain = {r["doc_id"]: r["text"] for r in piece_sampling.decode_pieces(piece_sampling.encode_pieces(docs, ["doc_id"], "text", PIECES), ["doc_id"], PIECES).collect()}
    decoded = {(r["doc_id"], r["sample"]): r["text"] for r in piece_sampling.decode_pieces(rows, ["doc_id", "sample"], PIECES).collect()}
    assert all(text == plain[key] for (key, _), text in decoded.items())
    p, pieces, raw, byte_weight = piece_weights()
    weigh = {i: w for i, w in pieces.values()} | {i: byte_weight for i in raw.values()}
    for key, v in got.items():
        assert len({tuple(r["ids"]) for r in v}) == len(v) and [r["sample"] for r in v] == list(range(1, len(v) + 1))
        assert all(0 <= r["inclusion"] <= 1 and r["log_prob"] <= 1e-9 and (r["inclusion"] > 0 or r["log_prob"] < -600) for r in v)
        # log-probabilities differ as the weights of the pieces do
        sums = [sum(weigh[i] for i in r["ids"]) - r["log_prob"] for r in v]
        assert sums == pytest.approx([sums[0]] * len(v), rel=1e-9)
    digests = {(r["doc_id"], r["sample"]): (r["n_pieces"], r["ids_crc32"], r["text_crc32"]) for r in piece_sampling.sample_digests(docs, ["doc_id"], "text", PIECES, k=3).collect()}
    assert digests == {(k, r["sample"]): (len(r["ids"]), zlib.crc32(np.array(r["ids"], "<i4").tobytes()), zlib.crc32(decoded[k, r["sample"]].encode())) for k, v in got.items() for r in v}
    assert piece_sampling.sample_segmentations(no_docs, ["doc_id"], "text", PIECES).count() == 0


def test_sampling_query_covers_documents_and_decodes(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000").limit(30).write.parquet(str(tmp_path / "documents.parquet"))
    texts = spark.read.parquet(str(tmp_path / "documents.parquet"))
    own = piece_sampling.decode_pieces(piece_sampling.encode_pieces(texts, ["doc_id"], "text", PIECES), ["doc_id"], PIECES).collect()
    want = {r["doc_id"]: zlib.crc32(r["text"].encode()) for r in own}
    got = QUERIES["op8_piece_sampling"](spark, str(tmp_path)).collect()
    assert len(want) == 30 and {r["doc_id"] for r in got} == set(want) and all(r["text_crc32"] == want[r["doc_id"]] for r in got)


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name == "quality":
            model = quality_gam.fit_quality(quality_gam.feature_table(before), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            texts = before.toPandas()
            scores = model.scores(quality_gam.features(pa.array(texts["text"])))
            assert set(docs.toPandas()["doc_id"]) == set(texts["doc_id"][scores >= P.THRESHOLD])
        if name == "duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == {k for (k, _), (_, c, _) in zip(rows, brute_components(rows)) if k == c}
        if name != "packing":
            assert docs.columns == list(P.COLUMNS)
    assert {r["doc_id"] for r in kept["packing"].collect()} == {r["doc_id"] for r in kept["duplicates"].collect()}


def test_pipeline_stages_on_odd_rows(spark, docs, corpus, no_docs, sf_dir):
    import corpus_pipeline as P

    twice = docs.select(*P.COLUMNS).unionByName(docs.select(*P.COLUMNS).where("doc_id = 30"))
    odd = twice.unionByName(twice.where("doc_id in (11, 40)").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in P.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0
        if name in ("quality", "language"):  # what one row's verdict is, so is that of its repeats
            got = Counter((r["doc_id"], r["text"]) for r in stage(spark, odd, sf_dir).collect())
            all_ = Counter((r["doc_id"], r["text"]) for r in odd.collect())
            assert all(got[k] == all_[k] for k in got)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    firsts = {}
    for (key, text), (n, component, _) in zip(rows, brute_components(rows)):
        group = component if n else (key, text)
        firsts[group] = min(firsts.get(group, (True, 0)), (key is None, key or 0))
    got = Counter(r["doc_id"] for r in P.STAGES[2][1](spark, odd, sf_dir).collect())
    assert got == Counter(None if none else key for none, key in firsts.values())


def test_duplicates_keep_one_row_a_component(spark, sf_dir):
    import corpus_pipeline as P

    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(3, text("a")), (7, text("a") + " more"), (7, text("b")), (5, text("c")), (5, text("d")), (None, text("e")), (None, text("a")), (None, text("f")), (None, text("f")), (9, ""), (9, ""), (None, "")]
    frame = spark.createDataFrame([(k, t, None, None, len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()
    frame.count()
    got = Counter((r["doc_id"], r["text"]) for r in P.duplicates(spark, frame, sf_dir).collect())
    assert got == Counter([(3, text("a")), (7, text("b")), (5, text("c")), (5, text("d")), (None, text("e")), (None, text("f")), (9, ""), (None, "")])


def test_rows_with_null_and_repeated_ids_count_each(spark):
    text = "one two three four five six seven eight nine ten " * 6
    rows = [(None, text, "en"), (None, text, "en"), (7, text, "en"), (7, "short\ntext here", None), (7, None, "fr"), (8, "", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    frame.count()
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    ids = Counter(k for k, *_ in rows)
    made = {
        "media": media.media_documents(frame).select("doc_id", "payload_sha256"), "quality": quality_gam.classify(frame, labels).select("doc_id", "held_out"), "rules": risk_rules.judge(frame, labels).select("doc_id", "n_words"),
        "lm": kn_lm.score_corpus(frame).select("doc_id", "n_tokens"), "language": langid.identify(frame).select("doc_id", "lang_pred"), "pieces": packing.pack_documents(frame, BYTE_BPE).where("piece = 0").select("doc_id", "ids_crc32"),
    }
    words = [len((t or "").split()) for _, t, _ in rows]
    for name, out in made.items():
        got = [tuple(r) for r in out.collect()]
        assert Counter(k for k, _ in got) == ids, name
        if name in ("rules", "lm"):
            assert Counter(got) == Counter((k, n + (name == "lm")) for (k, *_), n in zip(rows, words))
        if name in ("media", "pieces"):
            assert len(set(x for _, x in got)) == (3 if name == "media" else 3)


def test_language_scores_against_plain_sums():
    rng = np.random.default_rng(3)
    texts = ["Der Hund und", "the dog AND cat", "", "a", "x y zz éé"]
    model = langid.LanguageModel(["a", "b"], rng.normal(size=(1 << 10, 2)), np.array([0.3, -0.1]), 10)
    got = model.logits(pa.array(texts))
    for text, z in zip(texts, got):
        total, n = np.zeros(2), 0
        for word in text.translate(LOWER).split():
            raw = word.encode()
            s = np.arange(1) * 0
            grams, _ = langid.word_grams(np.frombuffer(raw, np.uint8), s, s + len(raw), 10)
            total, n = total + model.table[grams].sum(axis=0), n + len(grams)
            marked = [1, *(b + 3 for b in raw), 2]
            keys = []
            for size in langid.GRAMS:
                for i in range(len(marked) - size + 1):
                    key = size
                    for m in marked[i : i + size]:
                        key = (key * 0x100000001B3 + m) % 2**64
                    keys.append(int(mix(np.array([key], np.uint64))[0]) >> 54)
            assert sorted(keys) == sorted(grams.tolist())
        assert z == pytest.approx(total / max(n, 1) + model.bias)


def test_quality_scores_are_sums_of_tables():
    rng = np.random.default_rng(4)
    x = rng.random((600, 4)).astype(np.float32)
    model = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=5, pair_rounds=5)
    assert model.pairs
    for row, score in zip(x[:50], model.scores(x[:50])):
        at = [sum(cut <= v for cut in edges) for edges, v in zip(model.edges, row)]
        z = model.base + sum(table[i] for table, i in zip(model.tables, at)) + sum(table[model.coarse[a][at[a]], model.coarse[b][at[b]]] for a, b, table in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-z)))
