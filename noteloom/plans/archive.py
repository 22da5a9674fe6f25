"""Queries on note files and stored artefacts, headers and markup, views, and model seams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import hashing, misc
from noteloom.functions import text as T
from noteloom.operators import blockindex, enrich, graph, lexical, profile, upkeep, vector, views
from noteloom.operators.common import scratch
from noteloom.plans import tables as D
from noteloom.sources import store, vault
from noteloom.streaming import events as S
from noteloom.streaming.leases import STATE_STORE, lease_stream
from noteloom.streaming.watcher import watched


def _s(column: str) -> Column:
    return F.col(column).cast("string")


def _headed(spark: SparkSession, sf: str) -> DataFrame:
    """Notes with a header block, an inline tag and links at the end."""
    n = D.notes(spark, sf).withColumns({"lang": F.element_at(F.split("path", "/"), 2), "source": F.element_at(F.split("path", "/"), 1)})
    head = F.concat(F.lit("---\ntags: ["), "lang", F.lit(", '"), "source", F.lit('\']\ntitle: "T '), _s("doc_id"), F.lit('"\naliases:\n  - A'), _s("doc_id"), F.lit("\n  - "), "lang", F.lit("\npinned: true\n---\n"))
    body = F.concat("body", F.lit("\n#"), "lang", F.lit("/x [["), "source", F.lit("#part|alias]] [[ b ]]"))
    return n.select("doc_id", "path", "lang", "source", body.alias("body"), F.concat(head, body).alias("content"))


def header_fields(spark: SparkSession, sf: str) -> DataFrame:
    fm = T.header(F.col("content"))
    rows = _headed(spark, sf).select("path", fm.alias("fm"), T.body_of(F.col("content")).alias("b"))
    joined = lambda key: F.array_join(F.col("fm")[key], ",").alias(key)
    return rows.select("path", joined("tags"), joined("title"), joined("aliases"), joined("pinned"), F.length("b").alias("chars"), F.md5("b").alias("digest"))


def listed_values(spark: SparkSession, sf: str) -> DataFrame:
    """A header value given as a list or as one comma-separated string."""
    rows = D.notes(spark, sf).select("path", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a, b,,c "), F.col("title"))).otherwise(F.array(F.col("title"))).alias("v"))
    return rows.select("path", F.array_join(T.as_list(F.col("v")), "|").alias("items"))


def note_markup(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("body")
    return _headed(spark, sf).select("path", F.array_join(T.inline_tags(b), ",").alias("tags"), F.array_join(T.wikilinks(b), ",").alias("links"))


def note_ids(spark: SparkSession, sf: str) -> DataFrame:
    at = F.expr("timestamp'2024-01-02 03:04:05' + make_interval(0, 0, 0, 0, 0, cast(doc_id as int))")
    return D.notes(spark, sf).select("path", T.note_id(at, F.when(F.col("doc_id") % 5 == 0, F.lit("given"))).alias("zettel_id"))


def cue_layouts(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat("body", F.when(F.col("doc_id") % 3 == 0, "\n## Perguntas-chave\nx").when(F.col("doc_id") % 3 == 1, "\n### SUMMARY\nx").otherwise(""))
    return D.notes(spark, sf).select("path", T.has_cue_layout(body).alias("formatted"))


def concept_candidates(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("body", F.lit(" The NASA and X9b used DataFrame, HttpServer2 and IDs."))
    return D.notes(spark, sf).select("path", F.array_join(T.acronyms(text), ",").alias("acronyms"), F.array_join(T.camel_case(text), ",").alias("camel"))


def language_guesses(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.notes(spark, sf).select("path", F.posexplode(T.language_hypotheses(F.col("body"))).alias("n", "h"))
    return rows.select("path", (F.col("n") + 1).alias("rank"), "h.lang", "h.score")


def byte_figures(spark: SparkSession, sf: str) -> DataFrame:
    return D.notes(spark, sf).select("path", F.octet_length("body").alias("bytes"), misc.byte_tokens(F.col("body")).alias("tokens"), T.compact_count(F.octet_length("body") * 100).alias("shown"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    v = F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string"), F.lit("."), (F.col("doc_id") % 12).cast("string"))
    return D.notes(spark, sf).select("path", misc.next_version(v).alias("next"), misc.version_at_least(v, "v1.9").alias("enough"))


def rolling_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return D.notes(spark, sf).select("path", hashing.rolling32(F.col("path")).alias("h"))


# -- files and stored artefacts


def _vault(spark: SparkSession, sf: str) -> str:
    """The notes as files below a new folder, some in hidden or left-out folders, some no notes."""
    root = scratch(spark, "vault")
    rows = _headed(spark, sf)
    place = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit(".hidden/"), "path")).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("a/trash/"), "path")).when(F.col("doc_id") % 7 == 0, F.regexp_replace("path", "md$", "PNG")).when(F.col("doc_id") % 17 == 0, F.regexp_replace("path", "md$", "txt")).otherwise(F.col("path"))
    vault.write_notes(rows.select(place.alias("path"), "content"), root)
    return root


def vault_files(spark: SparkSession, sf: str) -> DataFrame:
    return vault.files(spark, _vault(spark, sf), skip=("trash",)).select("path", "ext", "size")


def vault_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = vault.notes(spark, _vault(spark, sf), skip=("trash",), most_bytes=20_000, most_body=3000)
    return rows.select("path", "title", F.length("body").alias("body_chars"), F.md5("content").alias("digest"), "sha")


def vault_content(spark: SparkSession, sf: str) -> DataFrame:
    rows = vault.notes(spark, _vault(spark, sf), skip=("trash",))
    got = vault.content(rows, rows.where("path like '%2.md'"), 500)
    return got.select("path", F.md5("content").alias("digest"), "full_chars", "truncated", F.array_join(F.col("header")["aliases"], ",").alias("aliases"))


def valid_results(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/"), "path")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("a/../"), "path")).when(F.col("doc_id") % 4 == 2, F.concat("path", F.lit(".txt"))).otherwise(F.col("path"))
    return D.notes(spark, sf).select(odd.alias("path")).select("path", vault.valid_result(F.col("path")).alias("valid"))


def modal_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Every third file is an image, every fifth of the others a PDF; some were read before."""
    n = D.notes(spark, sf)
    ext = F.when(F.col("doc_id") % 3 == 0, "png").when(F.col("doc_id") % 5 == 0, "pdf").when(F.col("doc_id") % 7 == 0, "m4a").otherwise("md")
    files = n.select("doc_id", F.regexp_replace("path", "md$", ext).alias("path"), ext.alias("ext"), F.timestamp_seconds(F.col("doc_id") * 60).alias("mtime"), "body")
    seen = files.where("ext <> 'md' and doc_id % 2 = 0")
    label = F.array(F.struct(F.concat(F.lit("l"), (F.col("doc_id") % 4).cast("string")).alias("label")))
    observed = seen.select("path", F.substring("body", 1, 40).alias("ocr"), label.alias("labels"), (F.col("doc_id") % 3).cast("int").alias("faces"))
    cache = files.where("doc_id % 9 = 0").select(vault.read_key(F.col("path"), F.col("mtime")).alias("read_key"), F.lit("known text").alias("text"))
    return vault.readings(files, n.select("path", "body"), observed, cache).select("path", "modality", F.md5("text").alias("digest"), "fresh")


def file_metadata(spark: SparkSession, sf: str) -> DataFrame:
    names = ["kind", "pixels", "missing"]
    dump = F.concat(F.lit('kind = "Image '), _s("doc_id"), F.lit('"\npixels   = '), (F.col("doc_id") * 10).cast("string"), F.lit("\nother = 1"))
    rows = D.notes(spark, sf).select("path", vault.metadata(dump, names).alias("m"))
    return rows.select("path", *(F.col("m")[n].alias(n) for n in names))


def stored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as JSON lines, every fifth written again later, with lines that aren't JSON between."""
    c = D.read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    n = c.count()
    later = c.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 10 * n).alias("at"), "c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    lines = c.select(F.col("c_custkey").alias("at"), "c_custkey", "c_acctbal").unionByName(later)
    text = F.when(F.col("c_custkey") % 97 == 0, F.concat(F.lit('{"key": '), _s("c_custkey"))).otherwise(F.concat(F.lit('{"key": '), _s("c_custkey"), F.lit(', "balance": '), _s("c_acctbal"), F.lit("}")))
    path = scratch(spark, "lines")
    lines.select("at", text.alias("value")).repartitionByRange(4, "at").sortWithinPartitions("at").select("value").write.text(path)
    return vault.json_lines(spark, path, "key long, balance double", "key")


def manifest_merge(spark: SparkSession, sf: str) -> DataFrame:
    n = D.notes(spark, sf)
    stored = n.where("doc_id % 4 <> 0").select("path", F.lit(1).alias("version"))
    changes = n.where("doc_id % 3 = 0").select("path", F.lit(2).alias("version"))
    path = scratch(spark, "manifest")
    store.rewrite(store.merged_manifest(stored, changes), path)
    return spark.read.parquet(path)


def keyword_store(spark: SparkSession, sf: str) -> DataFrame:
    """The keyword index written by domain, one domain written again, one removed."""
    items = D.notes(spark, sf).select("path", F.substring_index("path", "/", 1).alias("domain"), F.lit(1).alias("version"))
    path = scratch(spark, "keywords")
    store.write_keywords(items, path)
    store.write_keywords(items.where("domain = 'src1' and path like '%1.md'").withColumn("version", F.lit(2)), path)
    return store.purge_keywords(spark, path, "src2").select("path", _s("domain").alias("domain"), "version")


def capture_log(spark: SparkSession, sf: str) -> DataFrame:
    c = D.conversations(spark, sf).withColumn("provider", F.when(F.col("ts") % 2 == 0, "teacher").otherwise("other"))
    path = scratch(spark, "captures")
    store.append_captures(c, path, True)
    store.append_captures(c, path, True, "teacher")
    store.append_captures(c, path, False)
    return spark.read.schema(c.schema).json(path).groupBy("task", "provider").agg(F.count("*").alias("n"), F.sum("ts").alias("ts"))


def _pack_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = D.conversations(spark, sf).where("input <> '' and output <> ''")
    example = F.struct("input", "output", F.lit("i").alias("instructions"), F.lit("s").alias("style"))
    packs = c.groupBy("task").agg(F.sort_array(F.collect_list(example)).alias("examples"))
    body = F.to_json(F.struct("task", F.lit("teacher").alias("captured_from"), F.lit("2024").alias("captured_at"), "examples"), {"pretty": "true"})
    return packs.select(F.concat("task", F.lit(".json")).alias("path"), body.alias("content"))


def example_packs(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "packs")
    vault.write_notes(_pack_texts(spark, sf), root)
    return vault.example_packs(spark, root).select("task", "captured_from", F.md5("input").alias("input"), F.md5("output").alias("output"))


def queue_folder(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "queue")
    o = D.read(spark, sf, "supplier").select(F.concat(_s("s_suppkey"), F.when(F.col("s_suppkey") % 10 == 0, ".tmp").otherwise(".json")).alias("path"), F.concat(F.lit('{"n": '), _s("s_suppkey"), F.lit("}")).alias("content"))
    vault.write_notes(o, root)
    return store.queue_files(spark, root)


def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings stored, some appended again with another hash, then compacted."""
    v = D.vectors(spark, sf).select("path", F.lit("old").alias("sha"), "vec", F.lit(1).cast("long").alias("at"))
    path = scratch(spark, "vectors")
    store.append_vectors(v.where("path % 7 <> 0"), path)
    store.append_vectors(v.where("path % 3 = 0").withColumns({"sha": F.lit("new"), "at": F.lit(2).cast("long")}), path)
    return store.compacted(spark, path, scratch(spark, "vectors")).select("path", "sha", F.size("vec").alias("dims"))


# -- views


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    p, n = D.passports(spark, sf), D.notes(spark, sf).select("path", "doc_id")
    many = lambda k: F.transform(F.when(F.col("doc_id") % k > 0, F.sequence(F.lit(1), (F.col("doc_id") % k).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: i.cast("string"))
    kind = F.when(F.col("doc_id") % 10 == 1, "permanent").when(F.col("doc_id") % 10 == 2, "literature").otherwise(F.col("note_type"))
    path = F.when(F.col("doc_id") % 23 == 0, F.concat("path", F.lit(".txt"))).otherwise(F.col("path"))
    return p.join(n, "path").select(
        path.alias("path"), F.col("char_count").alias("size"), F.expr("timestamp'2024-06-30 12:00:00' - make_dt_interval(cast(doc_id % 400 as int))").alias("mtime"), F.col("one_line_summary").alias("summary"), "one_line_summary", "concepts", "domain", "difficulty",
        many(4).alias("cues"), F.lit("s").alias("cue_summary"), kind.alias("note_type"), F.concat(F.lit("z"), F.lpad(_s("doc_id"), 9, "0")).alias("zettel_id"), many(3).alias("neighbours"), many(9).alias("graph_nodes"),
    )


def view_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of all views with the value they are sorted by."""
    rows = views.formulas(_cards(spark, sf), F.to_date(F.lit("2024-07-01")))
    out = None
    for name in views.VIEWS:
        part = views.view(rows, name).select(F.lit(name).alias("view"), "path", "sorted_by")
        out = part if out is None else out.unionByName(part)
    return out


def dense_view(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the view of all profiles."""
    rows = views.view(views.formulas(_cards(spark, sf), F.to_date(F.lit("2024-07-01"))), "dense")
    return rows.drop("sorted_by").withColumns({"domain": F.array_join("domain", ","), "density": F.round("density", 6)})


def view_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.grouped_view(views.formulas(_cards(spark, sf), F.to_date(F.lit("2024-07-01"))), "by_domain", 20)
    card = lambda c: F.concat_ws("|", c["path"], c["summary"], F.array_join(c["concepts"], ","), c["difficulty"].cast("string"))
    return rows.select("group", "n", F.md5(F.array_join(F.transform("cards", card), "\n")).alias("digest"))


def view_headers(spark: SparkSession, sf: str) -> DataFrame:
    return views.view_text("graph_rich", views.view_stats(_cards(spark, sf)))


def view_stats(spark: SparkSession, sf: str) -> DataFrame:
    return views.view_stats(D.passports(spark, sf))


def type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return views.type_histogram(_cards(spark, sf))


def domain_list(spark: SparkSession, sf: str) -> DataFrame:
    return views.domain_list(D.passports(spark, sf))


# -- search and graph variants


def bm25_lane(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(lexical.lane_corpus(D.notes(spark, sf), 2000, 30_000), D.queries(spark)).select("query_id", "path", "score", "rank")


def lexical_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The index is written to a folder and searched from there, without the texts; it keeps all tokens of a note."""
    index = blockindex.build(D.notes(spark, sf), scratch(spark, "lexical-index"), keep=None)
    rows, _ = blockindex.search(spark, index, D.queries(spark))
    return rows.select("query_id", "path", "score", "rank", F.array_join("matched", ",").alias("matched"))


def lexical_index_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of note events keeps a stored index up: all notes are created, then every tenth changes to
    its title and every seventh goes, then some of those come back; the second batch comes once more."""
    n, source = D.notes(spark, sf), scratch(spark, "note-events")
    title, gone = F.col("title"), F.lit(None).cast("string")
    turns = [
        n.select(F.lit(1).alias("ts"), "path", F.lit("create").alias("kind"), "body"),
        n.where("doc_id % 10 = 0 or doc_id % 7 = 0").select(F.lit(2).alias("ts"), "path", F.when(F.col("doc_id") % 10 == 0, "modify").otherwise("delete").alias("kind"), F.when(F.col("doc_id") % 10 == 0, title).otherwise(gone).alias("body")),
        n.where("doc_id % 21 = 0").select(F.lit(3).alias("ts"), "path", F.lit("create").alias("kind"), "body"),
    ]
    index, state = blockindex.Index(scratch(spark, "lexical-index"), max(1, -(-n.count() // blockindex.SEGMENT_NOTES))), scratch(spark, "note-events-state")
    for rows in turns:  # all files of a turn are one batch; the stream goes on where it stopped
        rows.write.mode("append").parquet(source)
        events = spark.readStream.schema("ts int, path string, kind string, body string").parquet(source)
        blockindex.follow(events, index, state).awaitTermination()
    blockindex.apply_batch(index, turns[1].select("path", "kind", "body"), 1)
    rows, _ = blockindex.search(spark, index, D.queries(spark))
    return rows.select("query_id", "path", "score", "rank", F.array_join("matched", ",").alias("matched"))


def passport_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.with_concepts(D.passports(spark, sf), list(CONCEPTS)).select("path")


CONCEPTS = ("THE", "Que", "ändern", "In")


def keyword_average(spark: SparkSession, sf: str) -> DataFrame:
    return profile.keyword_average(profile.keyword_items(D.notes(spark, sf), D.passports(spark, sf)))


def neighbours_of_type(spark: SparkSession, sf: str) -> DataFrame:
    """Among all notes of the folder."""
    edges = graph.merge([graph.leading_folder_edges(D.dated(spark, sf), 5)], by_source=True)
    near = graph.neighbours_by_dst(edges, ["folder_path"], 5)
    listed = F.array_join(F.transform("edges", lambda e: F.concat(e["type"], F.lit(":"), e["weight"].cast("string"), F.lit(":"), F.array_join(e["why"], "+"))), ";")
    return near.select("src", "dst", "weight", "rank", listed.alias("edges"))


def block_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks to write or remove against those stored, and the removal of all."""
    n = D.notes(spark, sf).select("doc_id", "path", F.col("title").alias("block"))
    new = n.where("doc_id % 3 <> 0").select("path", "block", F.sha2("block", 256).alias("block_key"))
    stored = n.where("doc_id % 4 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("block", 256)).alias("block_key"))
    changed = graph.changed_blocks(new, stored).withColumn("what", F.lit("change"))
    return changed.unionByName(graph.cleared_blocks(stored).withColumn("what", F.lit("clear")))


def label_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Entity graphs that a model answered, cached by content, with labels resolved to notes."""
    n = D.notes(spark, sf).select("path", "title", "doc_id", F.sha2("body", 256).alias("sha"), F.col("body").alias("content"))
    name = T.stem_name(F.col("path"))
    cache = n.where("doc_id % 3 = 0").select("path", "sha", F.concat(F.lit('{"edges": [{"source": "'), name, F.lit('", "target": "none", "label": "kept"}]}')).alias("answer"))
    model = lambda c: F.concat(F.lit('so: {"relations": [{"source": "1", "target": "'), F.length(c).cast("string"), F.lit('", "type": "t"}]}'))
    edges = enrich.entity_edges(enrich.cached(n, cache, model))
    to = graph.resolve_labels(edges.select(F.col("src").alias("label")).distinct(), n).select(F.col("label").alias("src"), F.col("path").alias("note"))
    return edges.join(to, "src").select("path", "src", "dst", "kind", "note")


def community_changes(spark: SparkSession, sf: str) -> DataFrame:
    from noteloom.operators import community

    o = D.read(spark, sf, "orders").select(F.concat(F.lit("o"), _s("o_orderkey")).alias("path"), (F.col("o_custkey") % 20).cast("int").alias("community_id"), F.lit(0.5).alias("modularity"), "o_orderkey")
    stored = o.where("o_orderkey % 4 <> 0").select("path", F.when(F.col("o_orderkey") % 3 == 0, F.lit(99)).otherwise(F.col("community_id")).alias("community_id"))
    return community.changed_members(o, stored)


# -- queues, leases, streams as tables


def done_tasks(spark: SparkSession, sf: str) -> DataFrame:
    n = D.notes(spark, sf).select("doc_id", "path", F.sha2("body", 256).alias("sha"))
    cards = n.where("doc_id % 2 = 0").select("path", "sha", F.when(F.col("doc_id") % 6 == 0, "local").otherwise("model").alias("source"))
    return upkeep.already_done(n.select("path", "sha"), cards).select("path", "done")


def _leases(spark: SparkSession, sf: str) -> DataFrame:
    n = D.notes(spark, sf).where("doc_id % 2 = 0")
    return n.select(F.col("path").alias("note_path"), F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")).alias("device_id"), (F.col("doc_id") * 10).alias("claimed_at"), (F.col("doc_id") * 10 + 1000).alias("expires_at"))


def lease_stats(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.lease_stats(_leases(spark, sf), F.lit(2000))


def sweep_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = D.notes(spark, sf).select("doc_id", "path", F.sha2("body", 256).alias("sha"))
    swept = upkeep.sweep(n, n.where("doc_id % 5 = 0"), _leases(spark, sf), "d1", 2000)
    return enrich.sweep_stats(swept, n.where("doc_id % 7 <> 0"))


def renamed_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "rename").otherwise("modify")
    e = D.read(spark, sf, "events").select("ts", kind.alias("kind"), _s("user_id").alias("path"), F.concat(F.lit("old"), _s("user_id")).alias("old_path"))
    return S.expand_renames(e).groupBy("kind", "path").agg(F.count("*").alias("n"))


def threshold_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """Run as a stream: a file source, the state of every key, a file sink."""
    source, sink = scratch(spark, "events"), scratch(spark, "triggers")
    rows = D.read(spark, sf, "events").select(_s("user_id").alias("domain"), "ts")
    rows.write.parquet(source)
    fired = S.threshold_triggers(spark.readStream.schema(rows.schema).parquet(source))
    fired.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(spark, "triggers-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(fired.schema).parquet(sink)


def _fed(spark: SparkSession, turns: list[DataFrame]) -> DataFrame:
    """A stream that reads tables one after another, a batch each."""
    source = scratch(spark, "stream-in")
    for rows in turns:
        rows.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(turns[0].schema).option("maxFilesPerTrigger", 1).parquet(source)


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows of a stream, run to its end with the state store that timers need."""
    sink, name = scratch(spark, "stream-out"), STATE_STORE[0]
    before = spark.conf.get(name)
    spark.conf.set(*STATE_STORE)
    try:
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(sink)


def _thirds(e: DataFrame) -> list[DataFrame]:
    """Events in three parts by day."""
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.dayofmonth("ts")
    return [e.where(day <= 10), e.where((day > 10) & (day <= 20)), e.where(day > 20)]


def lease_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Claims and releases of notes as a stream; leases of six hours end by a timer."""
    turns = [t.select(F.concat(F.lit("n"), _s("user_id")).alias("note_path"), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("device_id"), F.when(F.col("event_type") == "error", "release").otherwise("claim").alias("action"), "ts") for t in _thirds(D.read(spark, sf, "events"))]
    return _drained(spark, lease_stream(_fed(spark, turns), 6 * 3_600_000, "1 hour"))


def watcher_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """System events (all but errors) and the app's (errors) of thirty roots, three tracked paths each, as a stream."""
    turns = [t.select(F.concat(F.lit("r"), (F.col("user_id") % 30).cast("string")).alias("root"), F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("path"), "ts", (F.col("event_type") == "error").alias("own")) for t in _thirds(D.read(spark, sf, "events"))]
    return _drained(spark, watched(_fed(spark, turns), 5 * 3_600_000, 4 * 3_600_000, 3, "1 hour"))


def last_runs(spark: SparkSession, sf: str) -> DataFrame:
    log = D.read(spark, sf, "events").select(F.col("event_type").alias("key"), (F.col("event_id") * 1000).alias("at_ms"), (F.col("user_id") % 500).cast("long").alias("took_ms"), F.when(F.col("user_id") % 4 == 0, F.lit("failed")).alias("error"))
    return S.last_runs(log, 100_000_000)


def missed_paths(spark: SparkSession, sf: str) -> DataFrame:
    e = D.read(spark, sf, "events")
    seen = S.missed_events(e.where("event_type <> 'error'").select(_s("event_id").alias("path"), "ts"), e.where("event_type = 'error'").select(_s("event_id").alias("path"), F.col("ts").alias("own_ts")))
    return S.missed_paths(seen).select("path", _s("ts").alias("ts"))


# -- model seams


def embedded_notes(spark: SparkSession, sf: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # The order of the slots by value tells all values but for their common scale, which is the norm.
    order = F.transform(F.sort_array(F.transform("vec", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), lambda s: s["i"])
    return vector.embed(D.notes(spark, sf)).select("path", F.size("vec").alias("dims"), F.round(norm, 3).alias("norm"), F.array_join(order.cast("array<string>"), ",").alias("slots"))


def embedded_parts(spark: SparkSession, sf: str) -> DataFrame:
    n = D.notes(spark, sf).withColumn("title", F.when(F.col("doc_id") % 4 != 0, F.col("title")).otherwise(" "))
    rows = vector.embed_parts(n, n.where("doc_id % 3 = 0").select("path", F.lit("a summary").alias("summary")))
    return rows.select("path", *(F.coalesce(F.size(f"{x}_vec"), F.lit(-1)).alias(x) for x in ("title", "body", "summary")))


def expanded_queries(spark: SparkSession, sf: str) -> DataFrame:
    cache = spark.createDataFrame([(D.QUERY_TEXTS[0][1], "known answer")], "query string, text string")
    return enrich.expanded(D.queries(spark), cache, lambda q: F.when(F.length(q) > 14, F.concat(F.lit(" about "), q)).otherwise(F.lit(" ")))


def classified_notes(spark: SparkSession, sf: str) -> DataFrame:
    n = D.notes(spark, sf)
    return enrich.classified(n, ["Long", "short"], lambda c: F.when(F.length(c) > 2000, "it is LONG").when(F.length(c) < 500, "SHORT one").otherwise("?"))


def prompted_notes(spark: SparkSession, sf: str) -> DataFrame:
    """A model's answers, then revised once."""
    n = D.notes(spark, sf)
    drafts = enrich.prompted(n, "Summarise.", lambda t: F.when(F.length(t) % 3 == 0, "  ").otherwise(F.concat(F.lit("s"), F.length(t).cast("string"))))
    return enrich.refined(n, drafts, lambda text, draft: F.when(F.length(text) % 2 == 0, F.concat(draft, F.lit("+"))).otherwise(F.lit("")))


def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.when(F.col("doc_id") % 3 == 0, "no object").otherwise(F.concat(F.lit('ok {"links": ["a'), _s("doc_id"), F.lit('"], "tags": ["t", "u"]} end')))
    rows = enrich.parsed(D.notes(spark, sf).select("path", answer.alias("answer")))
    return rows.select("path", F.array_join("result.links", ",").alias("links"), F.size(F.coalesce("result.tags", F.array().cast("array<string>"))).alias("n_tags"))


def sentiments(spark: SparkSession, sf: str) -> DataFrame:
    parts = D.read(spark, sf, "events").select(_s("user_id").alias("path"), ((F.col("event_id") % 21 - 10) / 10.0).alias("score"))
    return enrich.mean_sentiment(parts)


def annotated_notes(spark: SparkSession, sf: str) -> DataFrame:
    n = D.notes(spark, sf).select("doc_id", "path", F.sha2("body", 256).alias("sha"))
    notes_ = n.where("doc_id % 2 = 0").select("path", F.when(F.col("doc_id") % 10 == 0, F.lit("stale")).otherwise(F.col("sha")).alias("sha"), F.lit("xx").alias("language"), ((F.col("doc_id") % 5 - 2) / 4.0).alias("sentiment"))
    return enrich.annotated(n, notes_).select("path", "language", "sentiment", "sentiment_label")


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.notes(spark, sf).select("path", "doc_id", ((F.col("doc_id") % 8) / 2.0).alias("seconds"))
    return enrich.transcribed(rows, rows.where("doc_id % 3 = 0").select("path", F.concat(F.lit("said "), _s("doc_id")).alias("text")))


def routed_profiles(spark: SparkSession, sf: str) -> DataFrame:
    n = D.notes(spark, sf).select("doc_id", "path", F.sha2("body", 256).alias("sha"), F.lit("rule").alias("summary"), F.lit("local").alias("source"))
    answered = n.where("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 2 == 0, F.lit("stale")).otherwise(F.col("sha")).alias("sha"), F.lit("model").alias("summary"))
    return enrich.profiles(n.drop("doc_id"), answered).select("path", "summary", "source")


def rendered_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.prompt(upkeep.examples(upkeep.example_ring(D.conversations(spark, sf)))).select("task", F.md5("prompt").alias("digest"))


def training_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = D.conversations(spark, sf).select("input", "output", F.lit("teacher").alias("provider"), F.timestamp_seconds(F.col("ts")).alias("captured_at"))
    rows = upkeep.training_pairs(c, "teacher", F.timestamp_seconds(F.lit(5000)), 1000, 7)
    message = F.from_json("line", "messages array<struct<role:string,content:string>>")["messages"]
    return rows.select(F.md5(message[0]["content"]).alias("input"), F.md5(message[1]["content"]).alias("output"), "ready")


QUERIES = {f.__name__: f for f in (
    header_fields, listed_values, note_markup, note_ids, cue_layouts, concept_candidates, language_guesses, byte_figures, versions, rolling_hashes,
    vault_files, vault_notes, vault_content, valid_results, modal_readings, file_metadata, stored_lines, manifest_merge, keyword_store, capture_log, example_packs, queue_folder, vector_index,
    view_rows, dense_view, view_groups, view_headers, view_stats, type_histogram, domain_list, bm25_lane, lexical_index_search, lexical_index_stream, lease_expiry, watcher_outcomes, passport_concepts, keyword_average, neighbours_of_type, block_changes, label_edges, community_changes,
    done_tasks, lease_stats, sweep_stats, renamed_events, threshold_triggers, last_runs, missed_paths,
    embedded_notes, embedded_parts, expanded_queries, classified_notes, prompted_notes, parsed_answers, sentiments, annotated_notes, transcripts, routed_profiles, rendered_prompts, training_lines,
)}
